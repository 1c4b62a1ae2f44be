"""What the operators share: tables, the shared folder, cached word rows and Arrow batches.

A *word* is a maximal run of characters other than space and U+0009 to U+000D. ``bytes.split()`` without an
argument splits UTF-8 at exactly these six characters, so Python code and the SQL pattern below agree.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and DuckDB patterns of one word and of what separates words.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP, -1), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset and one machine runs all."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        jsc = spark.sparkContext._jsc.sc()
        base = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='rulespark-')}"
            spark.sparkContext.setCheckpointDir(base)
    return (base if "://" in base else f"file://{base.removeprefix('file:')}").rstrip("/")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new empty folder of this name in the shared folder."""
    uri = f"{shared_base(spark)}/{kind}-{uuid.uuid4().hex}"
    store, path = pafs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    return uri


def cut(df: DataFrame, kind: str, codec: str = "snappy") -> DataFrame:
    """The rows of df from a table written to the shared folder: lineage ends there, and nothing is computed twice."""
    uri = f"{shared_base(df.sparkSession)}/{kind}-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", codec).parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def write_file(uri: str, parts: Iterator[bytes]) -> None:
    """Write a file whole or not at all: a task that runs twice, or is lost, leaves one complete file."""
    store, path = pafs.FileSystem.from_uri(uri)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with store.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    store.move(draft, path)


def map_file(uri: str, dtype) -> np.ndarray:
    """A file as an array: mapped into memory in a mounted folder, else read whole (shards are bounded)."""
    address = urlparse(uri)
    store, path = pafs.FileSystem.from_uri(uri)
    if store.get_file_info(path).size == 0:
        return np.empty(0, dtype)
    if address.scheme == "file":
        return np.memmap(address.path, dtype=dtype, mode="r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


class WordRows(dict):
    """Word -> row number of an array that fill() computes for each batch of unseen words.

    Held by one Python worker; emptied once it has more than limit words, so memory is bounded.
    """

    def __init__(self, fill: Callable[[list], np.ndarray], limit: int = 250_000):
        super().__init__()
        self.fill, self.limit, self.unseen, self.data = fill, limit, [], None

    def __missing__(self, word) -> int:
        row = self[word] = len(self)
        self.unseen.append(word)
        return row

    def forget(self) -> None:
        self.clear()
        self.unseen, self.data = [], None

    def rows(self, found: list) -> np.ndarray:
        if len(self) > self.limit:
            self.forget()
        at = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        if self.unseen:
            new = self.fill(self.unseen)
            self.unseen = []
            if self.data is None or len(self.data) < len(self):
                held = 0 if self.data is None else len(self) - len(new)
                grown = np.empty((max(2 * len(self), 1024), *new.shape[1:]), new.dtype)
                if held:
                    grown[:held] = self.data[:held]
                self.data = grown
            self.data[len(self) - len(new) : len(self)] = new
        elif self.data is None:
            self.data = self.fill([])
        return at

    def values(self, found: list) -> np.ndarray:  # type: ignore[override]
        at = self.rows(found)
        return self.data[at]


def hash_words(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with at most so many bytes of text, but one row at least."""
    sizes = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: len(batch) + 1].astype(np.int64) if len(batch) else np.zeros(1, np.int64)
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + most, "right")) - 1)
        yield start, min(end, len(batch))
        start = min(end, len(batch))
