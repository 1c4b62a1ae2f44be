"""N-gram Jaccard join by MinHash banding: every two documents whose sets of word n-grams are similar enough.

1. Each text becomes its set of n-grams, as 64-bit hashes, and a MinHash signature; rows and bands of the signature are
   chosen so that two sets at the threshold meet in some band with at least the target recall.
2. Documents with equal sets form a class; a class goes on as one row, however many copies it has.
3. A shuffle on band hashes finds the buckets with two classes or more. Of buckets that hold the same classes one stays.
4. Each class's full n-gram set goes to its buckets. A bucket beyond a bound of classes or n-grams is cut into blocks by
   hash, and each pair of its blocks is a group of its own, so no bucket is ever held whole. A group's task verifies its
   pairs on the full sets; a pair that meets in several buckets is verified in the first of them only. It returns what it
   adds to each class's number of links, and a spanning forest of the links instead of the links. So no link is lost but
   by the recall of banding, and only classes that share a band ever meet.
5. Components of the forests are the groups of documents.

A text of fewer than n words has one n-gram, all its words. Defined results: a null or empty text, or one without words,
has no n-grams and links with nothing, nor does a row with a null id (its class_id is null); rows that repeat an id and
text are copies of each other; rows that share an id with different sets are documents of their own. An empty table gives
an empty result. Columns other than the two named are ignored. Classes are named by 64-bit hashes of their sets inside the
join, and by least ids in results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespark.llm.bpe import bounded_batches, held, tidy
from rulespark.llm.common import WordRows, cut, hash_words, mix, pieces
from rulespark.operators.components import components, union_find

#: Odd multipliers for the words of a window.
_BY_WORD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Rows of a band and number of bands: the most selective choice with the recall at the threshold in `most` hashes."""
    best = None
    for rows in range(1, most + 1):
        meet = threshold**rows
        bands = 1 if meet >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-meet))
        if rows * bands > most:
            break  # longer bands need more of them
        best = rows, bands
    if best is None:
        raise ValueError("no banding has this recall with so few hashes")
    return best


def gram_sets(found: list[list[bytes]], n: int, hashes: WordRows) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-grams of each list of words."""
    flat = hashes.values([w for words in found for w in words]) if any(found) else np.empty(0, np.uint64)
    out, start = [], 0
    with np.errstate(over="ignore"):
        for words in found:
            own = flat[start : start + len(words)]
            start += len(words)
            if not len(own):
                out.append(np.empty(0, np.uint64))
            elif len(own) < n:
                out.append(mix((own * _BY_WORD[: len(own)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(own))))
            else:
                k = len(own) - n + 1
                total = own[:k] * _BY_WORD[0]
                for i in range(1, n):
                    total = total + own[i : i + k] * _BY_WORD[i]
                out.append(np.unique(mix(total)))
    return out


def band_hashes(grams: np.ndarray, rows: int, bands: int, seed: int) -> np.ndarray:
    """A hash for each band of the MinHash signature of a set, as int64."""
    k = rows * bands
    by, plus = mix(np.arange(k, dtype=np.uint64) + np.uint64(1 + seed)) | np.uint64(1), mix(np.arange(k, dtype=np.uint64) + np.uint64(1_000_003 + seed))
    least = np.full(k, 2**32 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(grams), 4096):
            part = grams[start : start + 4096, None] * by
            part += plus
            np.minimum(least, (part >> np.uint64(32)).min(axis=0), out=least)
        mixed = mix(least.reshape(bands, rows) + mix(np.arange(rows, dtype=np.uint64)))
        return mix((mixed * _BY_WORD[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def _words(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    for start, end in pieces(batch, batch.schema.names[column]):
        yield start, end, [(x or b"").split() for x in batch.column(column).slice(start, end - start).to_pylist()]


def text_key(docs: DataFrame, text_col: str) -> Column:
    """A hash of a row's text; 0 without words."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return F.when(text.rlike(r"[^ \t-\r]"), F.xxhash64(text)).otherwise(0)


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, rows: int, bands: int, seed: int) -> DataFrame:
    """id, n_grams, two checksums of the set, the band hashes, and a hash of the text, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held("jaccard", ("hash",), lambda: WordRows(hash_words))
        names = ["id", "n_grams", "set_a", "set_b", "bands", "text_key"]
        for batch in batches:
            for start, end, found in _words(batch, 1):
                sets = gram_sets(found, n, hashes)
                with np.errstate(over="ignore"):
                    a = [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                    b = [int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x9E3779B97F4A7C15))).astype(np.int64)) if len(s) else 0 for s in sets]
                signed = [band_hashes(s, rows, bands, seed) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(signed, pa.list_(pa.int64())), batch.column(2).slice(start, end - start)], names=names)

    lean = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("text"), text_key(docs, text_col).alias("text_key"))
    return lean.mapInArrow(tidy(run), "id long, n_grams long, set_a long, set_b long, bands array<bigint>, text_key long")


def similar_pairs(sets: list[np.ndarray], bands: np.ndarray, left: np.ndarray, right: np.ndarray | None, per_mille: int, band: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of similar pairs and their intersections: pairs in left, or of left and right, which all share a band.

    A pair counts if per_mille of its union is in the intersection, and if it shares no band before; 0 is no band.
    """
    own = right is None
    right = left if right is None else right
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    small, large = np.minimum(sizes[left][:, None], sizes[right][None, :]), np.maximum(sizes[left][:, None], sizes[right][None, :])
    near = small * 1000 >= large * per_mille
    if own:
        near = np.triu(near, 1)
    for t in range(band):
        near &= (bands[left, t][:, None] != bands[right, t][None, :]) | (bands[left, t] == 0)[:, None]
    x, y = np.nonzero(near)
    if not len(x):
        return x, y, x
    if len(x) <= 8 * (len(left) + len(right)):
        both = np.fromiter((len(np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True)) for i, j in zip(x, y, strict=True)), np.int64, len(x))
    else:  # as products of 0/1 matrices, over runs of the n-grams that two or more sets have
        rows = np.unique(np.concatenate([left, right]))
        flat, row = np.concatenate([sets[i] for i in rows]), np.repeat(np.arange(len(rows)), sizes[rows])
        _, gram, times = np.unique(flat, return_inverse=True, return_counts=True)
        kept = times[gram] > 1
        order = np.argsort(gram[kept], kind="stable")
        gram, row = gram[kept][order], row[kept][order]
        number = np.cumsum(np.append(0, np.diff(gram) != 0)) if len(gram) else gram
        at, total = {r: k for k, r in enumerate(rows.tolist())}, np.zeros((len(left), len(right)), np.float32)
        l, r, width = np.array([at[i] for i in left.tolist()]), np.array([at[i] for i in right.tolist()]), 4096
        for start in range(0, int(number[-1]) + 1 if len(number) else 0, width):
            lo, hi = np.searchsorted(number, [start, start + width])
            part = np.zeros((len(rows), width), np.float32)
            part[row[lo:hi], number[lo:hi] - start] = 1
            total += part[l] @ part[r].T
        both = total[x, y].astype(np.int64)
    union = sizes[left[x]] + sizes[right[y]] - both
    real = both * 1000 >= union * per_mille
    return x[real], y[real], both[real]


def _verify(per_mille: int, pairs: bool):
    """For mapInArrow over rows sorted by (bucket, i, j): links of each group of equal keys."""

    def group(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        rows = list({r[0]: r for r in rows}.values())  # (rep, block, copies, bands, grams), once for each class
        reps, copies, side = (np.array([r[k] for r in rows], np.int64) for k in (0, 2, 1))
        left, right = np.flatnonzero(side == key[1]), np.flatnonzero(side == key[2]) if key[1] != key[2] else None
        if len(rows) < 2 or not len(left) or right is not None and not len(right):
            return
        sets, bands = [np.frombuffer(r[4], np.uint64) for r in rows], np.stack([np.frombuffer(r[3], np.int64) for r in rows])
        x, y, both = similar_pairs(sets, bands, left, right, per_mille, int(np.flatnonzero(bands[0] == key[0])[0]))
        a, b = left[x], (left if right is None else right)[y]
        if pairs:
            for i, j, n in zip(a.tolist(), b.tolist(), both.tolist(), strict=True):
                yield int(min(reps[i], reps[j])), int(max(reps[i], reps[j])), n / (len(sets[i]) + len(sets[j]) - n)
            return
        links = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
        roots = union_find(list(zip(a.tolist(), b.tolist(), strict=True)))
        for i in np.flatnonzero(links).tolist():
            yield int(reps[i]), int(links[i]), int(reps[roots[i]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())] if pairs else [("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        key, rows, out = None, [], []

        def flush(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for own, row in zip(zip(*columns[:3], strict=True), zip(*columns[3:], strict=True), strict=True):
                if own != key:
                    if rows:
                        out += group(key, rows)
                    key, rows = own, []
                    if len(out) > 10_000:
                        yield flush(out)
                        out = []
                rows.append(row)
        if rows:
            out += group(key, rows)
        if out:
            yield flush(out)

    return run


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, marked for a broadcast if a count shows that it has so many rows at most; a few bytes each, or fewer rows."""
    return F.broadcast(df) if df.count() <= rows else df


def _join(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float, block: int, block_grams: int, seed: int, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures with their class, classes, and what the verified pairs say."""
    rows, bands = choose_bands(threshold, recall)
    bounded_batches(docs.sparkSession)
    signed = cut(signatures(docs, id_col, text_col, n, rows, bands, seed), "jaccard-signatures")
    own = ["n_grams", "set_a", "set_b"]
    classes = signed.where("n_grams > 0 AND id IS NOT NULL").groupBy(*own).agg(F.min(F.struct("id", "text_key")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    classes = cut(classes.select(*own, F.xxhash64(*own).alias("rep"), F.col("first.id").alias("least"), F.col("first.text_key").alias("text_key"), "copies", "bands"), "jaccard-classes")

    members = classes.select("rep", "n_grams", F.posexplode("bands").alias("band", "bucket"))
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("grams"), F.min("band").alias("band"), F.min("rep").alias("low"), F.max("rep").alias("high"), F.bit_xor(F.xxhash64("rep")).alias("sum")).where("n > 1")
    buckets = buckets.groupBy("n", "grams", "low", "high", "sum").agg(F.min(F.struct("band", "bucket")).alias("b"))
    blocks = F.least("n", F.greatest(F.ceil(F.col("n") / F.lit(block)), F.ceil(F.col("grams") / F.lit(block_grams)))).cast("int")
    buckets = cut(buckets.select("b.bucket", blocks.alias("blocks")), "jaccard-buckets")
    placed = members.join(small(buckets), "bucket").groupBy("rep").agg(F.collect_list(F.struct("band", "bucket", "blocks")).alias("own"))
    # Rows of a class's least id can have other texts; the class's set is matched to one that has it by its checksum.
    placed = cut(placed.join(classes, "rep").select("least", "rep", "copies", "own", "set_a"), "jaccard-placed")
    found = docs.select(docs[id_col].cast("long").alias("least"), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("text")).join(small(placed, 50_000), "least")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held("jaccard", ("hash",), lambda: WordRows(hash_words))
        for batch in batches:
            for start, end, words in _words(batch, 0):
                part = batch.slice(start, end - start)
                grams = gram_sets(words, n, hashes)
                sums = [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in grams]
                right = pa.array([s == t for s, t in zip(sums, part.column(4).to_pylist(), strict=True)], pa.bool_())
                shared = np.zeros((len(part), bands), np.int64)
                for k, kept in enumerate(part.column(3).to_pylist()):
                    for b in kept:
                        shared[k, b["band"]] = b["bucket"]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in (1, 2, 3)], pa.array([x.tobytes() for x in shared], pa.binary()), pa.array([s.tobytes() for s in grams], pa.binary())], names=["rep", "copies", "own", "bands", "grams"]).filter(right)

    found = found.select("text", "rep", "copies", "own", "set_a").mapInArrow(tidy(sets), "rep long, copies long, own array<struct<band:int,bucket:long,blocks:int>>, bands binary, grams binary")
    found = found.withColumn("own", F.explode("own")).withColumn("block", F.expr("cast(pmod(xxhash64(rep), own.blocks) as int)"))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("own.blocks") - 1)))
    key = [F.col("own.bucket").alias("bucket"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    found = found.select(*key, "rep", "block", "copies", "bands", "grams").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    verified = found.mapInArrow(tidy(_verify(round(threshold * 1000), pairs)), "a long, b long, similarity double" if pairs else "rep long, links long, root long")
    return signed, classes, verified


def link_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = 256, block_grams: int = 1 << 20, seed: int = 0) -> DataFrame:
    """a < b and similarity of every two classes of equal sets, each named by its least id, that are similar enough.

    a = b, if the least id is the same. block and block_grams: classes and n-grams of a block, about.
    """
    _, classes, verified = _join(docs, id_col, text_col, n, threshold, recall, block, block_grams, seed, True)
    found = verified.distinct()
    for c in ("a", "b"):
        found = found.join(classes.select(F.col("rep").alias(c), F.col("least").alias(f"{c}_id")), c)
    return found.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "similarity")


def _grouped(docs: DataFrame, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = 256, block_grams: int = 1 << 20, seed: int = 0) -> DataFrame:
    """Signatures with their class, its number of links, and the first document of its group (by id, class and text)."""
    signed, classes, verified = _join(docs, id_col, text_col, n, threshold, recall, block, block_grams, seed, False)
    verified = cut(verified, "jaccard-verified")
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(verified.select("rep", "root"), lambda x: cut(x, "jaccard-groups")).select(F.col("id").alias("rep"), F.col("root").alias("group"))
    own = F.struct("least", "rep", "text_key")
    groups = cut(groups.join(classes.select("rep", own.alias("own")), "rep"), "jaccard-members")
    firsts = cut(groups.groupBy("group").agg(F.min("own").alias("first")), "jaccard-firsts")
    groups = groups.join(small(firsts, 100_000), "group").select("rep", "first")
    named = classes.join(links, "rep", "left").join(groups, "rep", "left").select("n_grams", "set_a", "set_b", "least", "copies", "links", F.coalesce("first", own).alias("first"))
    return signed.select("id", "n_grams", "set_a", "set_b", "text_key").join(named, ["n_grams", "set_a", "set_b"], "left")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, class_id, copy_of and n_links of each row; options as of link_classes.

    class_id: least id of the documents that links connect with this one; copy_of: least id of those with the same set;
    n_links: number of other documents that are similar enough, copies included.
    """
    known = F.col("id").isNotNull()
    return _grouped(docs, id_col, text_col, **options).select(
        F.col("id").alias(id_col),
        F.when(known, F.coalesce("first.least", "id")).alias("class_id"),
        F.when(known, F.coalesce("least", "id")).alias("copy_of"),
        F.when(known, F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with one document of each group, the one of least id; rows that repeat it go as well.

    Rows are told apart by id and text, so one that only shares its id with another stays.
    """
    key = ["_id", "_key"]
    found = _grouped(docs, id_col, text_col, **options).select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), "first")
    first = F.col("first").isNull() | (F.col("first.least") == F.col("_id")) & (F.col("first.text_key") == F.col("_key"))
    found = cut(found.where("_id IS NOT NULL").select(*key, first.alias("_first")), "jaccard-kept")
    gone = small(found.where("NOT _first").select(*key).distinct())
    kept = docs.withColumn("_id", F.col(id_col).cast("long")).withColumn("_key", text_key(docs, text_col)).join(gone, key, "left_anti")
    again = found.where("_first").groupBy(*key).count().where("count > 1").select(*key)
    if not again.isEmpty():
        again = cut(again, "jaccard-again")
        once = kept.join(small(again), key).dropDuplicates(key)
        kept = kept.join(small(again), key, "left_anti").unionByName(once)
    return kept.select(*[kept[c] for c in docs.columns])
