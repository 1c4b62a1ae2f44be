"""Mixing sources to target weights by a splitting tree over exact block quotas, in DataFrame functions only.

1. Sizes of sources; weights by the sources' order; targets by water-filling: the total is shared by weight, no source
   gets more than max_repeat times its size, and what it can't take goes to the others by weight.
2. Each document has a fixed pseudo-random position in [0, 2^52) from its id and text. A source's range of positions is
   cut into blocks, so blocks are disjoint ranges of a permutation of the source, each sure to be small: all sources
   together have `blocks` blocks, and one more for each source at most.
3. A source's quota of blocks: every block once for each whole time that the target holds the source's size, then the
   blocks from the lowest positions on until the rest is used up; the last of these is drawn in part, up to a position.
4. The splitting tree: the drawn blocks of all sources start in one node; in each level a node draws half of its blocks
   without replacement for its left child, by ranks of pseudo-random keys. So the children's quotas by source follow the
   multivariate hypergeometric distribution, and sum to the parent's exactly. Leaves are the output shards.
5. Each shard orders its documents by pseudo-random keys.

Only tables of blocks and of sources are windowed; documents are summed by block, after which each finds its shards by
joins with the tables of sources and of blocks, so that texts are shuffled once, into their shards. A hot source has more blocks, not larger ones.

Defined results: a null or empty text has size 0; null sources form one source, last in order; a source of size 0 has
target 0. Equal rows (same id and text) share a position and are taken alike. An empty table gives an empty result.
Null ids are ids like others. Input columns are kept, and those that start with ``mix_`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespark.llm.common import GAP, WORD, cut

#: Positions have 13 hexadecimal digits.
POSITIONS = 1 << 52


def n_words(text: Column) -> Column:
    """Number of words of a text, as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def position(id_: Column, text: Column, seed: int) -> Column:
    """A pseudo-random number below 2^52 that depends on the id and on the whole text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")


def _targets(sources: DataFrame, weights: tuple[int, ...], share: float, max_repeat: int, blocks: int) -> DataFrame:
    """mix_source, mix_size, mix_target and mix_blocks of each source. There is one row for each source."""
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    ranked = sources.withColumn("mix_rank", F.row_number().over(by_name).cast("long"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("mix_rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    everything = Window.partitionBy()
    full = Window.orderBy("mix_full", "mix_rank")  # sources that fill up first come first
    ranked = (
        ranked.withColumn("mix_weight", weight)
        .withColumn("mix_total", F.sum("mix_size").over(everything))
        .withColumn("mix_full", F.lit(float(max_repeat)) * F.col("mix_size") / F.col("mix_weight"))
        .withColumn("mix_before", F.coalesce(F.sum(max_repeat * F.col("mix_size")).over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("mix_from", F.sum("mix_weight").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        # The level rises while sources fill up and falls after, so the largest is the last with no source above its bound.
        .withColumn("mix_level", F.max((F.lit(float(share)) * F.col("mix_total") - F.col("mix_before")) / F.col("mix_from")).over(everything))
    )
    target = F.least(F.lit(float(max_repeat)) * F.col("mix_size"), F.greatest(F.col("mix_weight") * F.col("mix_level"), F.lit(0.0)))
    n = F.greatest(F.lit(1), F.ceil(F.col("mix_size") * F.lit(float(blocks)) / F.greatest(F.col("mix_total"), F.lit(1))))
    return ranked.select("mix_source", "mix_size", target.alias("mix_target"), n.cast("long").alias("mix_blocks"))


def _block(pos: Column, n: Column) -> Column:
    return F.least(F.floor(pos / F.lit(float(POSITIONS)) * n), n - 1).cast("long")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """docs with each row's source and position as mix_source and mix_position; other columns that start with mix_ go."""
    own = [docs[c] for c in docs.columns if not c.startswith("mix_")]
    return docs.select(*own, docs[source_col].alias("mix_source"), position(docs[id_col], docs[text_col], seed).alias("mix_position"))


def draw(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2, blocks: int = 4096, levels: int = 4, seed: int = 0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables: a row for each row of docs (id, source, words, position), sources, and blocks with their shards."""
    lean = cut(
        docs.select(docs[id_col].alias("mix_id"), docs[source_col].alias("mix_source"), n_words(docs[text_col]).alias("mix_words"), position(docs[id_col], docs[text_col], seed).alias("mix_position")),
        "mix-sizes",
    )
    sources = cut(_targets(lean.groupBy("mix_source").agg(F.sum("mix_words").alias("mix_size")), weights, share, max_repeat, blocks), "mix-targets")

    rows = _in_blocks(lean, sources)
    sums = rows.groupBy("mix_source", "mix_block", "mix_size", "mix_target").agg(F.sum("mix_words").alias("mix_in_block"))
    along = Window.partitionBy("mix_source").orderBy("mix_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.least(F.floor(F.col("mix_target") / F.greatest(F.col("mix_size"), F.lit(1))), F.lit(max_repeat)).cast("long")
    sums = sums.withColumn("mix_before", F.coalesce(F.sum("mix_in_block").over(along), F.lit(0))).withColumn("mix_whole", whole)
    sums = sums.withColumn("mix_left", F.col("mix_target") - F.col("mix_whole") * F.col("mix_size") - F.col("mix_before"))  # for this block on
    drawn = F.when(F.col("mix_left") <= 0, 0).when(F.col("mix_left") >= F.col("mix_in_block"), 2).otherwise(1)
    sums = cut(sums.select("mix_source", "mix_block", "mix_whole", "mix_left", drawn.alias("mix_drawn")), "mix-blocks")

    # The last drawn block of each source is drawn up to a position: a document is in if less than half of it is too much.
    parts = sums.where("mix_drawn = 1").alias("s")
    inside = rows.alias("d").join(parts, F.col("d.mix_source").eqNullSafe(F.col("s.mix_source")) & (F.col("d.mix_block") == F.col("s.mix_block")))
    inside = inside.select("d.mix_source", "d.mix_position", "d.mix_words", "s.mix_left")
    upto = Window.partitionBy("mix_source").orderBy("mix_position")
    inside = inside.withColumn("mix_upto", F.sum("mix_words").over(upto))
    last = inside.where(F.col("mix_upto") - F.col("mix_words") / 2 <= F.col("mix_left")).groupBy("mix_source").agg(F.max("mix_position").alias("mix_last"))

    # The splitting tree, over one token for each drawn block and time.
    times = F.transform(F.sequence(F.lit(0), F.col("mix_whole").cast("int")), lambda i: F.when((i < F.col("mix_whole")) | (F.col("mix_drawn") > 0), i))
    tokens = sums.select("mix_source", "mix_block", "mix_whole", "mix_drawn", F.explode(F.filter(times, lambda i: i.isNotNull())).alias("mix_time")).withColumn("mix_node", F.lit(0))
    for level in range(levels):
        key = F.xxhash64(F.lit(seed), F.lit(level), "mix_source", "mix_block", "mix_time")
        rank = F.row_number().over(Window.partitionBy("mix_node").orderBy(key, "mix_source", "mix_block", "mix_time"))
        size = F.count(F.lit(1)).over(Window.partitionBy("mix_node"))
        tokens = tokens.withColumn("mix_left", rank <= F.floor((size + 1) / 2)).withColumn("mix_node", 2 * F.col("mix_node") + F.when(F.col("mix_left"), 0).otherwise(1)).drop("mix_left")
    by_time = F.sort_array(F.collect_list(F.struct(F.col("mix_time").alias("t"), F.col("mix_node").alias("n"))))  # max_repeat + 1 at most
    shards = tokens.groupBy("mix_source", "mix_block", "mix_whole", "mix_drawn").agg(by_time.alias("mix_nodes"))
    shards = shards.alias("b").join(last.alias("s"), F.col("b.mix_source").eqNullSafe(F.col("s.mix_source")), "left").select("b.*", "s.mix_last")
    return lean, sources, cut(shards, "mix-shards")


def _in_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's size and target, and the block that holds their position."""
    rows = rows.alias("d").join(sources.alias("s"), F.col("d.mix_source").eqNullSafe(F.col("s.mix_source")))
    return rows.select("d.*", "s.mix_size", "s.mix_target", _block(F.col("mix_position"), F.col("s.mix_blocks")).alias("mix_block"))


def _in_shards(rows: DataFrame, sources: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows with mix_shards, by joins with the tables of sources and of blocks: rows themselves need no shuffle."""
    out = _in_blocks(rows, sources).alias("d").join(shards.alias("s"), F.col("d.mix_source").eqNullSafe(F.col("s.mix_source")) & (F.col("d.mix_block") == F.col("s.mix_block")), "left")
    more = (F.col("s.mix_drawn") == 2) | ((F.col("s.mix_drawn") == 1) & F.coalesce(F.col("d.mix_position") <= F.col("s.mix_last"), F.lit(False)))
    taken = F.filter(F.col("s.mix_nodes"), lambda x: (x["t"] < F.col("s.mix_whole")) | more)
    return out.select("d.*", F.coalesce(F.transform(taken, lambda x: x["n"]), F.array().cast("array<int>")).alias("mix_shards"))


def plan(docs: DataFrame, **options) -> DataFrame:
    """A row for each row of docs: id, mix_source, mix_words, mix_position, the source's size and target, and mix_shards.

    mix_shards lists the output shards (of 2^levels) that hold the document, one entry for each time it is taken.
    """
    return _in_shards(*draw(docs, **options))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, drawn: tuple[DataFrame, DataFrame, DataFrame] | None = None, **options) -> DataFrame:
    """The mix: rows of docs, as often as they are taken, in shards and shuffled in each shard.

    mix_shard and mix_order are added; a shard is sorted by mix_order, a pseudo-random key. drawn: what draw() gave, if it
    is known.
    """
    _, sources, shards = drawn or draw(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    own = [c for c in docs.columns if not c.startswith("mix_")]
    placed = _in_shards(_keyed(docs, id_col, text_col, source_col, seed), sources, shards)
    taken = placed.select(*[placed[f"`{c}`"] for c in own], "mix_position", F.posexplode("mix_shards").alias("mix_time", "mix_shard"))
    order = F.xxhash64(F.lit(seed), F.col("mix_shard"), F.col("mix_position"), F.col("mix_time"))
    taken = taken.withColumn("mix_order", order).drop("mix_position", "mix_time")
    # Ranges of (shard, order) keep shards apart and in order, and split a shard over as many tasks as it needs.
    return taken.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")


def digest_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **options) -> DataFrame:
    """Write the mix, read it back, and count what it holds of each row of docs.

    The columns of draw()'s rows, mix_size and mix_target of the source, mix_taken (words) and mix_times. Equal rows share
    their order in a shard, so copies are counted once.
    """
    names = dict(id_col=id_col, text_col=text_col, source_col=source_col, seed=seed)
    tables = draw(docs, **names, **options)
    written = cut(mix(docs, **names, drawn=tables), "mix-drawn", codec="zstd")  # whole texts
    key = [written[id_col].alias("mix_id"), written[source_col].alias("mix_source"), position(written[id_col], written[text_col], seed).alias("mix_position")]
    held = written.select(*key, n_words(written[text_col]).alias("mix_words"), F.struct("mix_shard", "mix_order").alias("mix_place"))
    held = held.groupBy("mix_id", "mix_source", "mix_position", "mix_words").agg(F.size(F.collect_set("mix_place")).cast("long").alias("mix_times"))
    rows = _in_blocks(tables[0], tables[1]).drop("mix_block").alias("d")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("mix_id", "mix_source", "mix_position")]
    rows = rows.join(held.alias("h"), same, "left").select("d.*", F.col("h.mix_words").alias("mix_each"), F.coalesce("mix_times", F.lit(0)).alias("mix_times"))
    return rows.withColumn("mix_taken", F.coalesce(F.col("mix_each") * F.col("mix_times"), F.lit(0))).drop("mix_each")
