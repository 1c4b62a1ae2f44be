"""Where intermediate tables live: on the driver while they are small, else written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows that may be held as a local table. Beyond, a table is written and read again.
LOCAL_ROWS = 20_000


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset and one machine runs all."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            return jsc.getCheckpointDir().get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='rulespark-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base


def settle(df: DataFrame, expect_large: bool = False, large: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, int]:
    """The same rows without lineage, and their number.

    At most LOCAL_ROWS rows come to the driver, by one job; a larger table is written as Parquet. expect_large: write at
    once, so that a table that is known to be large isn't computed twice. large: makes of a larger table what is written.
    """
    spark = df.sparkSession
    if not expect_large:
        rows = df.limit(LOCAL_ROWS + 1).toArrow()
        if rows.num_rows <= LOCAL_ROWS:
            if rows.num_rows == 0:
                return spark.createDataFrame([], df.schema), 0
            return spark.createDataFrame(rows, df.schema), rows.num_rows
    df = large(df) if large else df
    uri = f"{shared_base(spark).rstrip('/')}/table-{uuid.uuid4().hex}.parquet"
    df.write.parquet(uri)
    out = spark.read.schema(df.schema).parquet(uri)
    return out, out.count()


def cut(df: DataFrame) -> DataFrame:
    return settle(df)[0]


def written(df: DataFrame) -> DataFrame:
    return settle(df, expect_large=True)[0]
