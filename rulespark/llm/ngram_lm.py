"""An interpolated modified Kneser-Ney n-gram model, counted in Spark, kept as sorted hash arrays, mapped by workers.

Tokens are words in lower case (A-Z) and an end after each text; a text starts after order - 1 start marks, which are
never predicted.

Vocabulary. Tokens are counted by 64-bit hashes in one shuffle. A token's id is (its place among its shard's tokens, the
most frequent first) x shards + shard, so ids need no coordination, and frequent tokens have small ones.

Counting. A task counts its n-grams of the highest order in runs, and sends each shard a block of each run: distinct rows of
ids, sorted, as differences, compressed. A shard's task sums blocks, writes the n-grams' sorted hashes and counts, and sends
on what lower levels need: for each context its total and how many of its n-grams occur once, twice and more; and, without
their first tokens, the n-grams of the next lower order, whose continuation count is the number of different first tokens.
So each level is one shuffle, of blocks that only hold distinct n-grams. A context's n-grams are dealt to SPLIT shards, so
frequent contexts don't make a shard hot, and the number of shards grows with the tokens, so a shard's task doesn't. Files
are written whole, and again alike if a task runs again.

Files. A table of n-grams or contexts holds 32 bits of each hash, sorted, and the first place of each value of the bits
before them; which of the numbers that contexts have is a code into the distinct ones. What is known of single tokens is
an array by id. A hash meets another's 32 bits in about one lookup of 500 million.

Scoring. A worker maps the files of the shared folder into memory (a folder that isn't mounted is read, shard by shard), and
looks up each n-gram of all orders.

    p(w | c) = max(n(c w) - D(n(c w)), 0) / n(c) + (D1 N1(c) + D2 N2(c) + D3 N3+(c)) / n(c) * p(w | c without its first)

with counts of n-grams in the highest order and continuation counts below, discounts of each order from its counts of
counts, and 1 / (V + 1) below order 1, V being the number of different training tokens; a context that never occurred
gives way to the next shorter one. Nothing but sums over shards comes to the driver.

Defined results: a null or empty text has the end as its only token; rows with a null id are training rows; repeated rows
count repeatedly in training, and get equal scores; without training rows every token has probability 1; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespark.llm.bpe import bounded_batches, held, tidy
from rulespark.llm.common import WordRows, hash_words, map_file, mix, pieces, shared_folder, write_file

#: Hashes of the start and end marks, which no word has but by chance; and the words that stand for them.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
MARKS = {b" start": START, b" end": END}
#: The id of a token that training doesn't have.
UNKNOWN = np.uint64(1 << 62)
#: Shards of one context, a power of 2.
SPLIT = 16
#: n-grams of a shard, about, counted with repeats.
SHARD = 8_000_000
#: Words that a worker knows at once.
CACHED = 500_000
BLOCKS = "kind string, shard int, block binary"
_BY = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def gram_keys(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of ids."""
    with np.errstate(over="ignore"):
        total = columns[0].astype(np.uint64) * _BY[0]
        for i, c in enumerate(columns[1:], 1):
            total += c.astype(np.uint64) * _BY[i]
        return mix(total)


def gram_shards(columns: list[np.ndarray], shards: int) -> np.ndarray:
    """Shards of n-grams of two tokens or more."""
    with np.errstate(over="ignore"):
        return (mix(gram_keys(columns[:-1]) + (columns[-1] & columns[-1].dtype.type(SPLIT - 1)).astype(np.uint64)) % np.uint64(shards)).astype(np.uint32)


def key_shards(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys) % np.uint64(shards)).astype(np.uint32)


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def lex_order(columns: list[np.ndarray]) -> np.ndarray:
    """An order that sorts rows by their columns: by the first 64 bits, then by the rest where those are equal."""
    widths = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(widths) > 128:
        return np.lexsort(columns[::-1])
    keys, left = [np.zeros(len(columns[0]), np.uint64) for _ in range(2)], [min(64, sum(widths)), max(0, sum(widths) - 64)]
    for c, width in zip(columns, widths, strict=True):
        c = c.astype(np.uint64)
        first = min(width, left[0])
        rest = width - first
        if first:
            keys[0] = (keys[0] << np.uint64(first % 64) if first < 64 else 0) | c >> np.uint64(rest)
        if rest:
            keys[1] = (keys[1] << np.uint64(rest % 64) if rest < 64 else 0) | c & np.uint64((1 << rest) - 1)
        left[0] -= first
    order = np.argsort(keys[0])
    if left[1]:
        again = keys[0][order[1:]] == keys[0][order[:-1]]
        tied = np.flatnonzero(np.append(again, False) | np.append(False, again))
        if len(tied):
            group = np.cumsum(np.append(True, ~again))[tied]
            order[tied] = order[tied][np.lexsort((keys[1][order[tied]], group))]
    return order


def counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in ascending order, and how often each occurs."""
    widths = [int(c.max(initial=0)).bit_length() for c in columns]
    own: list[np.ndarray | None] = [None] * len(columns)
    for i, c in enumerate(columns):  # numbers of few distinct ids take fewer bits
        if sum(widths) > 64:
            own[i] = np.unique(c)
            widths[i] = int(len(own[i]) - 1).bit_length()
    if sum(widths) > 64:
        order = lex_order(columns)
        columns = [c[order] for c in columns]
        first = starts_of(columns)
        return [c[first] for c in columns], np.diff(first, append=len(order))
    key = np.zeros(len(columns[0]), np.uint64)
    for c, width, distinct in zip(columns, widths, own, strict=True):
        key = key << np.uint64(width % 64) | (c if distinct is None else np.searchsorted(distinct, c)).astype(np.uint64)
    key.sort()
    first = starts_of([key])
    key, out = key[first], []
    for width, distinct in zip(reversed(widths), reversed(own), strict=True):
        c = key & np.uint64((1 << width) - 1)
        out.append(c if distinct is None else distinct[c])
        key = key >> np.uint64(width % 64)
    return out[::-1], np.diff(first, append=len(columns[0]))


def starts_of(columns: list[np.ndarray]) -> np.ndarray:
    """Places of sorted rows that differ from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def summed(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows in ascending order, and the sums of their values."""
    order = lex_order(columns)
    columns = [c[order] for c in columns]
    first = starts_of(columns)
    return [c[first] for c in columns], [np.add.reduceat(v[order].astype(np.uint64), first) if len(first) else v for v in values]


def pack(columns: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Rows in ascending order of columns: each as its difference from the row before while earlier columns are equal."""
    arrays, same = [], np.arange(len(columns[0])) > 0
    for c in columns:
        d = c.copy()
        d[same] -= c[np.flatnonzero(same) - 1]
        arrays.append(d)
        same[1:] &= c[1:] == c[:-1]
    arrays = [_narrow(a) for a in (*arrays, *values)]
    head = struct.pack("<BBQ", len(columns), len(arrays), len(arrays[0])) + bytes(a.itemsize for a in arrays)
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays)
    return head + zstandard.ZstdCompressor(level=3).compress(planes)


def unpack(block: bytes) -> list[np.ndarray]:
    """The columns, then the values, of pack()."""
    n_columns, n, size = struct.unpack_from("<BBQ", block)
    widths, at, out = block[10 : 10 + n], 0, []
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[10 + n :], max_output_size=size * sum(widths)), np.uint8)
    same = np.arange(size) > 0
    for k, width in enumerate(widths):
        x = np.ascontiguousarray(planes[at : at + size * width].reshape(width, size).T).view(f"<u{width}").ravel()
        at += size * width
        if k < n_columns and size:
            first, x = np.flatnonzero(~same), x.astype(np.uint64)
            total = np.cumsum(x)
            same &= x == 0
            x = total - np.repeat(total[first] - x[first], np.diff(first, append=size))
        out.append(x)
    return out


def _joined(blocks: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*map(unpack, blocks), strict=True)]


def write_arrays(uri: str, arrays: list[np.ndarray]) -> None:
    """Unsigned arrays in one file, each as narrow as its values allow, at multiples of 8 bytes."""
    own = [_narrow(a) for a in arrays]
    head = struct.pack("<Q", len(own)) + b"".join(struct.pack("<QQ", a.itemsize, len(a)) for a in own)
    write_file(uri, iter([head, *(x for a in own for x in (a.tobytes(), bytes(-a.nbytes % 8)))]))


def map_arrays(uri: str) -> list[np.ndarray] | None:
    """The arrays of a file; None if there is none, as when no token or n-gram belongs there."""
    try:
        data = map_file(uri, np.uint8)
    except FileNotFoundError:
        return None
    n, out = int(data[:8].view("<u8")[0]), []
    at = 8 + 16 * n
    for width, size in data[8:at].view("<u8").reshape(-1, 2).tolist():
        out.append(np.asarray(data[at : at + width * size]).view(f"<u{width}"))
        at += width * size + -(width * size) % 8
    return out


def hash_table(keys: np.ndarray) -> list[np.ndarray]:
    """Sorted keys as the first place of each value of their first bits, and the 32 bits that follow."""
    bits = np.uint64(max(1, (len(keys) // 8).bit_length()))
    starts = np.searchsorted(keys >> (np.uint64(64) - bits), np.arange((1 << int(bits)) + 1, dtype=np.uint64))
    return [starts, (keys << bits) >> np.uint64(32)]


def find(table: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Places of the keys in a hash table, -1 where they aren't."""
    starts, tails = table[:2]
    bits = np.uint64((len(starts) - 1).bit_length() - 1)
    bucket, tail = (keys >> (np.uint64(64) - bits)).astype(np.int64), ((keys << bits) >> np.uint64(32)).astype(np.uint32)
    low, end, last = starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64), max(len(tails) - 1, 0)
    high = end
    for _ in range(int((end - low).max(initial=0)).bit_length()):  # bisection of all buckets at once
        middle = (low + high) >> 1
        less = (tails[np.minimum(middle, last)] < tail) & (middle < high)
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
    if not len(tails):
        return np.full(len(keys), -1)
    return np.where((low < end) & (tails[np.minimum(low, last)] == tail), low, -1)


def _by_shard(kind: str, shard: np.ndarray, block: Callable[[np.ndarray], bytes]) -> Iterator[tuple[str, int, bytes]]:
    """block(rows) of each shard's rows, which keep their order."""
    for s, rows in _groups(shard):
        yield kind, s, block(rows)


def _groups(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    shard = _narrow(shard)
    order = np.argsort(shard, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(shard[order].astype(np.int64))) + 1, len(order)) if len(order) else []
    for start, end in zip([0, *ends], ends, strict=False):
        yield int(shard[order[start]]), order[start:end]


def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kinds, shards, blocks = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(shards, pa.int32()), pa.array(blocks, pa.binary())], names=["kind", "shard", "block"])


def _batched(rows: Iterator[tuple[str, int, bytes]], most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[2])
        if size > most:
            yield _batch(out)
            out, size = [], 0
    if out:
        yield _batch(out)


def _grouped(batches: Iterator[pa.RecordBatch], merge: Callable[[str, int, list[bytes]], Iterator[tuple[str, int, bytes]]]) -> Iterator[pa.RecordBatch]:
    """merge(kind, shard, blocks) of rows sorted by kind and shard."""

    def rows() -> Iterator[tuple[str, int, bytes]]:
        key, blocks = None, []
        for batch in batches:
            for kind, shard, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (kind, shard) != key:
                    if blocks:
                        yield from merge(*key, blocks)
                    key, blocks = (kind, shard), []
                blocks.append(block)
        if blocks:
            yield from merge(*key, blocks)

    return _batched(rows())


def hashes_of(found: list[bytes]) -> np.ndarray:
    """Token hashes of words, and of the marks."""
    out = hash_words([w.lower() for w in found])
    for i, w in enumerate(found):
        if w in MARKS:
            out[i] = MARKS[w]
    return out


# ---- the vocabulary


def _count_tokens(shards: int, most: int = 400_000):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, int, bytes]]:
            own: Counter = Counter()

            def flush() -> Iterator[tuple[str, int, bytes]]:
                keys, (n,) = summed([hashes_of(list(own))], [np.fromiter(own.values(), np.uint64, len(own))])
                yield from _by_shard("v", key_shards(keys[0], shards), lambda k: pack([keys[0][k]], [n[k]]))
                own.clear()

            for batch in batches:
                for start, end in pieces(batch, "text"):
                    texts = batch.column(0).slice(start, end - start).to_pylist()
                    for t in texts:
                        own.update(t.split())
                    own[b" end"] += len(texts)
                    if len(own) > most:
                        yield from flush()
            if own:
                yield from flush()

        yield from _batched(rows())

    return count


def _write_tokens(folder: str):
    """Each shard's token hashes in ascending order, with their places by frequency, and counts by place; place 0 is no token's."""

    def merge(kind: str, shard: int, blocks: list[bytes]) -> Iterator[tuple[str, int, bytes]]:
        keys, n = _joined(blocks)
        (keys,), (n,) = summed([keys], [n])
        order = np.lexsort((keys, np.iinfo(np.uint64).max - n))
        place = np.empty(len(keys), np.uint64)
        place[order] = np.arange(1, len(keys) + 1, dtype=np.uint64)
        write_arrays(f"{folder}/v-{shard:06d}", [keys, place, np.append(np.uint64(0), n[order])])
        yield "s", 0, pack([np.array([0], np.uint64)], [np.array([x], np.uint64) for x in (len(keys), n.sum())])

    return lambda batches: _grouped(batches, merge)


def token_ids(hashes: np.ndarray, folder: str, v_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of tokens (UNKNOWN where training has none, 0 for the start), and how often they occur."""
    out, mass = np.full(len(hashes), UNKNOWN), np.zeros(len(hashes), np.uint64)
    for s, rows in _groups(key_shards(hashes, v_shards)):
        if (own := _arrays(folder, "v", s)) is None:
            continue
        at = np.minimum(np.searchsorted(own[0], hashes[rows]), len(own[0]) - 1)
        hit = own[0][at] == hashes[rows]
        place = own[1][at[hit]].astype(np.uint64)
        out[rows[hit]], mass[rows[hit]] = place * np.uint64(v_shards) + np.uint64(s), own[2][place]
    out[hashes == START] = 0
    return out, mass


def _arrays(folder: str, kind: str, shard: int) -> list[np.ndarray] | None:
    return held(f"ngrams {folder}", (kind, shard), lambda: map_arrays(f"{folder}/{kind}-{shard:06d}"))


# ---- n-grams


def tokens(texts: list[bytes], order: int, words: WordRows) -> tuple[np.ndarray, np.ndarray]:
    """Rows in words of the texts' tokens, each text's with its start and end marks; and each text's tokens without starts."""
    found = [(t or b"").split() for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    own = words.rows([*MARKS, *chain.from_iterable(found)])
    flat = np.full(int(sizes.sum()) + len(found) * (order - 1), own[0], np.int64)
    ends = np.cumsum(sizes + order - 1)
    kept = np.ones(len(flat), bool)
    kept[ends - 1] = False
    for i in range(order - 1):
        kept[ends - sizes - 1 - i] = False
    flat[kept] = own[2:]
    flat[ends - 1] = own[1]
    return flat, sizes


def _grams(flat: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """The n-gram that ends at each token that is no start, by columns."""
    at = np.arange(int(sizes.sum())) + np.repeat((np.arange(len(sizes)) + 1) * (order - 1), sizes)
    return [flat[at - order + 1 + i] for i in range(order)]


def _deal(level: int, columns: list[np.ndarray], count: np.ndarray, shards: int, v_shards: int) -> Iterator[tuple[str, int, bytes]]:
    """Blocks of distinct sorted n-grams; single tokens go where their ids say."""
    shard = gram_shards(columns, shards) if level > 1 else columns[0] % np.uint64(v_shards)
    yield from _by_shard(f"g{level}", shard, lambda k: pack([c[k] for c in columns], [count[k]]))


def _count(order: int, shards: int, v_shards: int, folder: str, run: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(f"ngrams {folder}", ("ids",), lambda: WordRows(lambda found: token_ids(hashes_of(found), folder, v_shards)[0], CACHED))

        def rows() -> Iterator[tuple[str, int, bytes]]:
            some: list[list[np.ndarray]] = []
            n = 0

            def flush() -> Iterator[tuple[str, int, bytes]]:
                columns = [_narrow(np.concatenate(c)) for c in zip(*some, strict=True)]
                some.clear()
                shard = gram_shards(columns, shards) if order > 1 else columns[0] % np.uint64(v_shards)
                for s, k in _groups(shard):
                    own, times = counted([c[k] for c in columns])
                    yield f"g{order}", s, pack(own, [times])

            for batch in batches:
                for start, end in pieces(batch, "text"):
                    flat, sizes = tokens(batch.column(0).slice(start, end - start).to_pylist(), order, words)
                    some.append(_grams(_narrow(words.data[flat]), sizes, order))
                    n += len(some[-1][0])
                    if n > run:
                        yield from flush()
                        n = 0
            if some:
                yield from flush()

        yield from _batched(rows())

    return count


def _sum_level(level: int, shards: int, v_shards: int, folder: str):
    """For blocks sorted by (kind, shard): sum each shard's, write its file, send on what lower levels need."""

    def dense(ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        place = (ids // np.uint64(v_shards)).astype(np.int64)
        out = np.zeros(int(place.max()) + 1, np.uint64)
        out[place] = values
        return out

    def grams(name: str, blocks: list[bytes]) -> Iterator[tuple[str, int, bytes]]:
        *columns, count = _joined(blocks)
        columns, (count,) = summed([_narrow(c) for c in columns], [count])
        numbers = [len(count), *((count == i).sum() for i in (1, 2, 3, 4)), (count > 2).sum(), count.sum()]
        yield "s", level, pack([np.array([0], np.uint64)], [np.array([x], np.uint64) for x in numbers])
        if level == 1:
            write_arrays(name, [dense(columns[0].astype(np.uint64), count)])
            return
        keys = gram_keys(columns)
        order = np.argsort(keys)
        own = count[order]
        large = np.flatnonzero(own > 254)  # a byte a count; larger ones beside, with their places
        write_arrays(name, [*hash_table(keys[order]), np.minimum(own, 255), large, own[large]])
        del keys, order, own
        first = starts_of(columns[:-1])
        context = [c[first] for c in columns[:-1]]
        sums = [np.add.reduceat(x, first) for x in (count, (count == 1).astype(np.uint64), (count == 2).astype(np.uint64), (count > 2).astype(np.uint64))]
        shard = key_shards(gram_keys(context), shards) if level > 2 else context[0] % np.uint64(v_shards)
        yield from _by_shard(f"c{level}", shard, lambda k: pack([c[k] for c in context], [x[k] for x in sums]))
        rest, times = counted(columns[1:])
        yield from _deal(level - 1, rest, times, shards, v_shards)

    def contexts(name: str, blocks: list[bytes]) -> None:
        found = _joined(blocks)
        columns, sums = summed([_narrow(c) for c in found[:-4]], found[-4:])
        del found
        code, more = np.ones(len(total := sums[0]), np.uint64), np.flatnonzero(total > 1)  # 0: no context, 1: one n-gram, once
        _, first, other = np.unique(gram_keys([x[more] for x in sums]), return_index=True, return_inverse=True)
        code[more] = other.astype(np.uint64) + np.uint64(2)
        table = [np.append(np.array([0, one], np.uint64), x[more][first]) for x, one in zip(sums, (1, 1, 0, 0), strict=True)]
        if len(columns) == 1:
            write_arrays(name, [dense(columns[0].astype(np.uint64), code), *table])
            return
        keys = gram_keys(columns)
        order = np.argsort(keys)
        write_arrays(name, [*hash_table(keys[order]), code[order], *table])

    def merge(kind: str, shard: int, blocks: list[bytes]) -> Iterator[tuple[str, int, bytes]]:
        name = f"{folder}/{kind}-{shard:06d}"
        if kind == f"g{level}":
            yield from grams(name, blocks)
        elif kind[0] == "c":
            contexts(name, blocks)
        else:
            for b in blocks:
                yield kind, shard, b

    return lambda batches: _grouped(batches, merge)


@dataclass
class Model:
    """order, shards (of n-grams, of tokens), folder, and for each level the discounts D1, D2, D3; sums over all shards."""

    order: int
    shards: int
    v_shards: int
    folder: str
    discounts: dict[int, tuple[float, float, float]]
    total: float  # counts of order 1
    ones: tuple[float, float, float]  # tokens with a count of 1, 2, more
    n_tokens: int
    n_distinct: int

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """For each token hash: id, occurrences, count, and as a context of one token: total, N1, N2, N3+."""
        out = np.zeros((len(hashes), 7), np.uint64)
        out[:, 0], out[:, 1] = token_ids(hashes, self.folder, self.v_shards)
        seen = np.flatnonzero(out[:, 0] != UNKNOWN)
        ids = out[seen, 0]
        for s, rows in _groups((ids % np.uint64(self.v_shards)).astype(np.uint32)):
            place = (ids[rows] // np.uint64(self.v_shards)).astype(np.int64)
            for kind, column in (("g1", 2), ("c2", 3)):
                if (own := _arrays(self.folder, kind, s)) is None:
                    continue
                at = np.where(place < len(own[0]), own[0][np.minimum(place, len(own[0]) - 1)], 0)
                if kind == "g1":
                    out[seen[rows], column] = at
                else:
                    out[seen[rows], column : column + 4] = np.stack([x[at] for x in own[1:]], 1)
        return out

    def counts(self, level: int, columns: list[np.ndarray]) -> np.ndarray:
        """Counts of n-grams of ids of a level beyond 1; 0 if unknown."""
        out, keys = np.zeros(len(columns[0])), gram_keys(columns)
        for s, rows in _groups(gram_shards(columns, self.shards)):
            if (own := _arrays(self.folder, f"g{level}", s)) is None:
                continue
            at = find(own, keys[rows])
            rows, at = rows[at >= 0], at[at >= 0]
            found = own[2][at].astype(np.float64)
            if (big := found == 255).any():
                found[big] = own[4][np.searchsorted(own[3], at[big])]
            out[rows] = found
        return out

    def contexts(self, level: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Totals of contexts of two ids or more, and their numbers of n-grams that occur once, twice and more."""
        total, ones, keys = np.zeros(len(columns[0])), np.zeros((len(columns[0]), 3)), gram_keys(columns)
        for s, rows in _groups(key_shards(keys, self.shards)):
            if (own := _arrays(self.folder, f"c{level}", s)) is None:
                continue
            at = find(own, keys[rows])
            rows, code = rows[at >= 0], own[2][at[at >= 0]]
            total[rows] = own[3][code]
            for k in range(3):
                ones[rows, k] = own[4 + k][code]
        return total, ones

    def probabilities(self, grams: list[np.ndarray], known: np.ndarray) -> np.ndarray:
        """Probability of the last token of each n-gram of the highest order; grams: columns of rows in known."""
        p, last = np.full(len(grams[0]), 1 / (self.n_distinct + 1)), grams[-1]
        ids = [known[c, 0] for c in grams]
        for level in range(1, self.order + 1):
            d = np.array([0.0, *self.discounts.get(level, (0.5, 0.5, 0.5))])
            if level == 1:
                seen, count = np.arange(len(p) if self.total else 0), known[last, 2].astype(np.float64)
                total, ones = np.full(len(p), self.total), np.tile(self.ones, (len(p), 1))
            else:
                if level == 2:
                    total, ones = known[grams[-2], 3].astype(np.float64), known[grams[-2], 4:].astype(np.float64)
                else:
                    total, ones = self.contexts(level, ids[self.order - level : -1])
                seen = np.flatnonzero(total)
                count = self.counts(level, [c[seen] for c in ids[self.order - level :]])
                total, ones = total[seen], ones[seen]
            p[seen] = (np.maximum(count[: len(seen)] - d[np.minimum(count[: len(seen)], 3).astype(np.int64)], 0) + sum(ones[: len(seen), k] * d[k + 1] for k in range(3)) * p[seen]) / total[: len(seen)]
        return p


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """D1, D2 and D3 from the numbers of n-grams with counts 1 to 4; a half, where one is missing."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))  # type: ignore[return-value]


def _sums(blocks: DataFrame) -> dict[int, list[float]]:
    """The sums of a line for each level and shard."""
    out: dict[int, list[float]] = {}
    for r in blocks.collect():
        own = [float(x[0]) for x in unpack(bytes(r.block))[1:]]
        out[r.shard] = [a + b for a, b in zip(out.get(r.shard, [0.0] * len(own)), own, strict=True)]
    return out


def fit(docs: DataFrame, *, text_col: str = "text", order: int = 3, shards: int | None = None, run: int = 4_000_000) -> Model:
    """A model of all texts of docs. run: n-grams that a task holds at once. shards: by the number of tokens, if not given."""
    spark = docs.sparkSession
    bounded_batches(spark)
    v_shards, folder = shards or int(spark.conf.get("spark.sql.shuffle.partitions")), shared_folder(spark, "ngrams")
    lean = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("text"))
    blocks = lean.mapInArrow(tidy(_count_tokens(v_shards)), BLOCKS).repartition(v_shards, "kind", "shard").sortWithinPartitions("kind", "shard")
    n_distinct, n_tokens = _sums(blocks.mapInArrow(tidy(_write_tokens(folder)), BLOCKS)).get(0, (0.0, 0.0))
    shards = shards or max(v_shards, int(-(-n_tokens // SHARD)))
    blocks = lean.mapInArrow(tidy(_count(order, shards, v_shards, folder, run), keep=True), BLOCKS)
    for level in range(order, 0, -1):
        blocks = blocks.repartition(shards, "kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(tidy(_sum_level(level, shards, v_shards, folder)), BLOCKS)
    sums = _sums(blocks)
    one = sums.get(1, [0.0] * 7)
    found = {level: discounts(*s[1:5]) for level, s in sums.items()}
    return Model(order, shards, v_shards, folder, found, one[6], (one[1], one[2], one[5]), int(n_tokens), int(n_distinct))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the text) of each row.

    Perplexity is 10 ** (-score / n_tokens).
    """
    most = min(16_000_000, max(2_000_000, 10_000 * model.shards))  # more text at a time, where more shards share it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(f"ngrams {model.folder}", ("known",), lambda: WordRows(lambda found: model.known(hashes_of(found)), CACHED))
        for batch in batches:
            for start, end in pieces(batch, "_text", most):
                flat, sizes = tokens(batch.column(1).slice(start, end - start).to_pylist(), model.order, words)
                grams = _grams(flat, sizes, model.order)
                p, mass = model.probabilities(grams, words.data), words.data[grams[-1], 1]
                first = np.cumsum(sizes) - sizes
                base = np.log10((mass + 0.5) / (model.n_tokens + 0.5 * (model.n_distinct + 1)))
                columns = [pa.array(sizes), pa.array(np.add.reduceat((mass > 0).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p), first))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), *columns], names=[id_col, "n_tokens", "n_known", "base_score", "score"])

    bounded_batches(docs.sparkSession)
    lean = docs.select(docs[id_col].alias(id_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("_text"))
    one = F.lit(1).cast("long")
    scored = lean.mapInArrow(tidy(run, keep=True), lean.select(id_col, one.alias("n_tokens"), one.alias("n_known"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score")).schema)
    return scored.select(id_col, "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(id_: Column) -> Column:
    """True for ids whose crc32, as text, is 1 modulo 5; false for null."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 1, F.lit(False))
