"""Function tables: rows with keys c0, c1, ..., a result `out` (but relations), the time `ts` of their last change, and for
constructors and relations the flag `sub` (subsumed).

A table is a list of parts. New rows make a new part, so a scan of the changes since some time reads only the parts since
then, and their sizes are known without a job. A changed row is a row of a new part, and its key goes on a list of what
scans leave out of the parts before, by an anti-join. So what an iteration writes grows with its changes, not with the
table. Parts are merged when there are many, or when half of the rows are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.functions.sorts import Sort
from rulespark.operators.storage import LOCAL_ROWS, settle

MOST_PARTS = 16
#: Lists of keys that a scan leaves out, before the table is written anew.
MOST_GONE = 8
#: Rows of keys that are broadcast for an anti-join or a join, when a count shows that there are no more.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Part:
    """n rows, without those whose keys are gone; first and last: least and greatest time of its rows."""

    df: DataFrame
    n: int
    first: int
    last: int
    gone: tuple[tuple[DataFrame, int], ...] = ()

    def view(self, keys: list[str]) -> DataFrame:
        if not self.gone:
            return self.df
        some = reduce(DataFrame.unionByName, [d for d, _ in self.gone])
        return self.df.join(F.broadcast(some) if sum(n for _, n in self.gone) <= BROADCAST_ROWS else some, keys, "left_anti")


@dataclass
class Table:
    name: str
    takes: tuple[Sort, ...]
    out: Sort
    kind: str  # constructor, relation or custom
    merge: Any = None
    cost: int = 1
    extractable: bool = True
    parts: list[Part] = field(default_factory=list)
    hidden: bool = False
    moved: bool = False  # whether some id of it isn't the hash of its row any more
    sure: bool = True  # whether each key is known to be in it once, and not only said to be
    lost: int = 0  # rows of its parts that are gone
    counted: tuple[int, dict[str, int]] | None = None  # rows when values were counted, and about how many a column had

    def copy(self) -> Table:
        return Table(self.name, self.takes, self.out, self.kind, self.merge, self.cost, self.extractable, list(self.parts), self.hidden, self.moved, self.sure, self.lost)

    @property
    def keys(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.takes))]

    @property
    def values(self) -> list[str]:
        return [] if self.kind == "relation" else ["out"]

    @property
    def schema(self) -> str:
        columns = [f"c{i} {s.ddl}" for i, s in enumerate(self.takes)]
        columns += [f"out {self.out.ddl}"] if self.values else []
        return ", ".join([*columns, "ts bigint", "sub boolean"])

    @property
    def n(self) -> int:
        return sum(p.n for p in self.parts) - self.lost

    def clear(self) -> None:
        self.parts, self.lost = [], 0

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema)

    def df(self, spark: SparkSession) -> DataFrame:
        return reduce(DataFrame.unionByName, [p.view(self.keys) for p in self.parts]) if self.parts else self.empty(spark)

    def since(self, spark: SparkSession, ts: int) -> tuple[DataFrame, int]:
        """Rows changed at ts or later, and at most how many."""
        some = [p for p in self.parts if p.last >= ts]
        if not some:
            return self.empty(spark), 0
        return reduce(DataFrame.unionByName, [p.view(self.keys) if p.first >= ts else p.view(self.keys).where(F.col("ts") >= ts) for p in some]), min(self.n, sum(p.n for p in some))

    def before(self, spark: SparkSession, ts: int) -> tuple[DataFrame, int]:
        some = [p for p in self.parts if p.first < ts]
        if not some:
            return self.empty(spark), 0
        return reduce(DataFrame.unionByName, [p.view(self.keys) if p.last < ts else p.view(self.keys).where(F.col("ts") < ts) for p in some]), min(self.n, sum(p.n for p in some))

    def values_of(self, spark: SparkSession, columns: list[str]) -> dict[str, int]:
        """About how many values columns have; counted again once the table is twice or half as large."""
        n, known = self.counted or (0, {})
        if not n <= 2 * self.n <= 4 * n:
            n, known = self.n, {}
        if left := [c for c in columns if c not in known]:
            known = known | self.df(spark).agg(*[F.approx_count_distinct(c).alias(c) for c in left]).head().asDict()
        self.counted = n, known
        return known

    def add(self, df: DataFrame, n: int, ts: int) -> None:
        if n:
            self.parts.append(Part(df, n, ts, ts))
        if len(self.parts) > MOST_PARTS:
            self.compact()

    def compact(self) -> None:
        if not self.parts:
            return
        first, last = min(p.first for p in self.parts), max(p.last for p in self.parts)
        df, n = settle(reduce(DataFrame.unionByName, [p.view(self.keys) for p in self.parts]), expect_large=self.n > LOCAL_ROWS)
        self.parts, self.lost = [Part(df, n, first, last)] if n else [], 0

    def remove(self, keys: DataFrame, n: int) -> None:
        """Take out the rows with these n keys, which the table has; keys: a table without lineage."""
        if not n:
            return
        self.parts = [replace(p, gone=(*p.gone, (keys, n))) for p in self.parts]
        self.lost += n
        if 2 * self.lost > sum(p.n for p in self.parts) or max(len(p.gone) for p in self.parts) > MOST_GONE:
            self.compact()
