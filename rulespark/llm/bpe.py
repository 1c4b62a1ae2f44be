"""Byte-level BPE encoding and decoding, by rounds of merges over length-bucketed numpy matrices.

Texts are split by the tokenizer's pattern; each distinct piece is merged once for each batch of texts. Pieces of like
length form a padded matrix with one row for each piece. In each round every row merges its leftmost pair of minimum
rank; ranks of pairs come from a hash table in arrays, rows without a mergeable pair leave the matrix, and a merge
closes its gap. Pieces beyond LONG bytes would make wide, nearly empty matrices; they are merged one by one with a heap,
in the same order of merges.

Results of parts of texts are cached in each Python worker, in two generations of bounded bytes that outlive a task.

Defined results: a null text counts as empty and has no ids; rows are encoded each for itself, so repeated rows give
repeated results; an empty table gives an empty result; columns other than those named are ignored. Bytes that aren't
UTF-8 are read as U+FFFD. Null ids decode to no bytes.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.llm.common import mix, pieces

#: White space of the splitting patterns, as a character class.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Bytes of a piece, beyond which a heap takes the place of a matrix.
LONG = 256
#: Bytes of a generation of cached segments.
CACHED = 32 << 20
#: A rank that no pair has.
NONE = np.int32(2**31 - 1)


class PairTable:
    """Open addressing from pairs of ids to the rank of their merge."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << bits, NONE, np.int32)
        at, left = mix(keys) & self.mask, np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == np.uint64(2**64 - 1)]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.ranks[at[won]] = keys[won], ranks[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + np.uint64(1)) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where an id is negative or the pair doesn't merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = mix(keys) & self.mask
        out = np.where(self.keys[at] == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.ranks[at] != NONE))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & self.mask
            held = self.keys[at[open_]]
            out[open_] = np.where(held == keys[open_], self.ranks[at[open_]], NONE)
            open_ = open_[(held != keys[open_]) & (self.ranks[at[open_]] != NONE)]
        return np.where((left < 0) | (right < 0), NONE, out)


class Ranks:
    """A rank file: base64 of a token's bytes, a space and its id, by line."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(np.array([p for p, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int32))
        self._dict: dict[int, int] | None = None

    def encode(self, found: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = [b""] * len(found)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        widths = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        for i in np.flatnonzero(sizes > LONG):
            out[i] = self._by_heap(found[i])
        for width in np.unique(widths[(sizes > 0) & (sizes <= LONG)]):
            rows, step = np.flatnonzero((widths == width) & (sizes > 0)), max(1, 250_000 // int(width))
            for start in range(0, len(rows), step):
                self._by_matrix([found[i] for i in rows[start : start + step]], rows[start : start + step], sizes, int(width), out)
        return out

    def decode(self, found: list[bytes | None]) -> list[bytes]:
        """The bytes that each row of ids stands for; none for null."""
        token = self.tokens.__getitem__
        return [b"".join(map(token, np.frombuffer(x, "<u4").tolist())) if x else b"" for x in found]

    def _by_matrix(self, found: list[bytes], rows: np.ndarray, sizes: np.ndarray, width: int, out: list[bytes]) -> None:
        ids = np.full((len(found), width), -1, np.int32)
        ids[np.arange(width) < sizes[rows][:, None]] = self.byte[np.frombuffer(b"".join(found), np.uint8)]
        ranks = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            if (ended := best == NONE).any():  # compaction: these rows are done
                lengths = (ids[ended] >= 0).sum(axis=1)
                flat, ends = ids[ended][ids[ended] >= 0].astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
                for row, start, end in zip(rows[ended].tolist(), [0, *ends], ends, strict=False):
                    out[row] = flat[start:end]
                going = ~ended
                ids, ranks, rows, at, best = ids[going], ranks[going], rows[going], at[going], best[going]
                if not len(rows):
                    return
            n, r = ids.shape[1] - 1, np.arange(len(rows))
            take = np.arange(n) + (np.arange(n) > at[:, None])
            ids = np.take_along_axis(ids, take, axis=1)
            ids[r, at] = best
            take = np.arange(n - 1)
            ranks = np.take_along_axis(ranks, take + (take >= at[:, None]), axis=1)
            has = at < n - 1  # the pair that starts with the new token
            ranks[r[has], at[has]] = self.pairs.find(ids[r[has], at[has]], ids[r[has], at[has] + 1])
            has = at > 0  # the pair that ends with it
            ranks[r[has], at[has] - 1] = self.pairs.find(ids[r[has], at[has] - 1], ids[r[has], at[has]])

    def _by_heap(self, piece: bytes) -> bytes:
        if self._dict is None:
            used = self.pairs.ranks != NONE
            self._dict = dict(zip(self.pairs.keys[used].tolist(), self.pairs.ranks[used].tolist(), strict=True))
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before, rank = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), self._dict.get
        heap = [(x, i) for i in range(len(ids) - 1) if (x := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            x, i = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) >= len(ids) or rank(ids[i] << 32 | ids[j]) != x:
                continue
            ids[i], ids[j], after[i] = x, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (y := rank(x << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (y, i))
            if before[i] >= 0 and (y := rank(ids[before[i]] << 32 | x)) is not None:
                heapq.heappush(heap, (y, before[i]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()


class Segments(dict):
    """Ids of texts, put together from ids of their segments, which are cached in two generations.

    A cut before a space never changes how the pattern splits, if the white space there is one or two characters
    long. A key is a segment without its first space; after NUL or newline it stands for itself. Keys map to
    numbers of entries of ``held``, so a text's segments are looked up once, also those that are yet to be resolved.

    Once a generation has about ``limit`` bytes it becomes the older one and the one before is dropped; what is looked
    up again moves to the younger. So two generations bound memory, and frequent segments stay, also between tasks.
    Texts that hold one of the strings ``whole`` are resolved as they are.
    """

    RUN = re.compile(f"[{SPACE}]{{3}}|[{SPACE}]{{2}}\\Z")
    PAIR = re.compile(f"[{SPACE}]{{2}}")
    PAIRS = ("  ", " \n", "\n ", "\n\n")
    #: White space other than space and newline; a search for one character is far cheaper than for a class.
    RARE = tuple(c for c in map(chr, [*range(0x9, 0xE), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]) if c != "\n")
    COARSE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
    #: Bytes of an entry besides its characters and ids: objects, and their places in the tables.
    ENTRY = 200

    def __init__(self, resolve: Callable[[list[str]], list[bytes]], limit: int = 96 << 20, whole: tuple[str, ...] = ("\0",)):
        super().__init__()
        self.resolve, self.limit, self.whole = resolve, limit, whole
        self.held: list[bytes | None] = []
        self.new: list[str] = []
        self.places: list[int] = []
        self.size = 0
        self.older: dict[str, int] = {}
        self.older_held: list[bytes | None] = []

    def __missing__(self, key: str) -> int:
        held = self.held
        at = self[key] = len(held)
        before = self.older.get(key)
        if before is None:
            self.new.append(key)
            self.places.append(at)
            held.append(None)
        else:
            held.append(self.older_held[before])
        return at

    def keys_of(self, text: str) -> list[str]:
        pair = self.PAIR.search(text) if any(c in text for c in self.RARE) else any(p in text for p in self.PAIRS)
        if pair and self.RUN.search(text):
            return [x[1:] if x[0] == " " and x[1:2] not in ("", "\n") else f"\0{x}" for x in self.COARSE.findall(text)]
        found = text.replace("\n", " \n").split(" ")
        if found[0][:1] != "\n":
            found[0] = f"\0{found[0]}"
        return found

    def turn(self) -> None:
        """What is cached becomes the older generation."""
        self.older, self.older_held = dict(self), self.held
        self.clear()
        self.held, self.size = [], 0

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.size > self.limit:
            self.turn()
        number, whole, before = self.__getitem__, self.whole, len(self.held)
        at = [None if any(w in t for w in whole) else list(map(number, self.keys_of(t))) for t in texts]
        if self.new:
            found = self.resolve([k[1:] if k[:1] == "\0" else k if k[:1] == "\n" else f" {k}" for k in self.new])
            for place, ids in zip(self.places, found, strict=True):
                self.held[place] = ids
            self.size += sum(map(len, self.new)) + sum(map(len, found))
            self.new, self.places = [], []
        ids = self.held.__getitem__
        self.size += self.ENTRY * (len(self.held) - before)
        return [self.resolve([t])[0] if found is None else b"".join(map(ids, found)) for t, found in zip(texts, at, strict=True)]


def split_resolver(ranks: Ranks, pattern: str) -> Callable[[list[str]], list[bytes]]:
    """Segments -> ids, each match of the pattern merged separately."""
    split = regex.compile(pattern)

    def resolve(segments: list[str]) -> list[bytes]:
        cuts = [[s] if s[1:].isalpha() and (s[0] == " " or s[0].isalpha()) else split.findall(s) for s in segments]
        distinct = list(dict.fromkeys(p for found in cuts for p in found))
        ids = dict(zip(distinct, ranks.encode([p.encode() for p in distinct]), strict=True))
        return [ids[found[0]] if len(found) == 1 else b"".join([ids[p] for p in found]) for found in cuts]

    return resolve


def tidy(run: Callable, keep: bool = False) -> Callable:
    """run, for mapInArrow; at the end of a task the worker, which Spark keeps, lets go of freed memory.

    So it does of tables of words, which are cheap to make again, unless keep is set.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for x in _HELD.values():
                if not keep and hasattr(x, "forget"):
                    x.forget()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library can give memory back
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let the session's Arrow batches have so many bytes at most: both sides of a Python worker hold some at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > most:
        spark.conf.set(key, f"{most}b")


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a string column; null is empty."""
    try:
        return [t or "" for t in column.to_pylist()]
    except UnicodeDecodeError:
        return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


#: In each Python worker: what one operator keeps between batches, by its parameters.
_HELD: dict = {}
_OWNER: list[str] = [""]


def held(owner: str, key: tuple, make: Callable):
    """make(), kept for this key. A worker that goes on to another operator lets go of what the last one kept."""
    if _OWNER[0] != owner:
        _HELD.clear()
        _OWNER[0] = owner
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """id_col and ids, a binary of little-endian unsigned 32-bit ids, for each row of docs.

    decoded_col: a column of the bytes that the ids stand for, decoded from them in the same worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = held("bpe", ("ranks", ranks_path), lambda: Ranks(ranks_path))
        encoder = held("bpe", ("encode", ranks_path, pattern), lambda: Segments(split_resolver(ranks, pattern), CACHED))
        for batch in batches:
            for start, end in pieces(batch, "_text", 1_000_000):
                ids = encoder.encode(texts_of(batch.column(1).slice(start, end - start)))
                columns = [pa.array(ids, pa.binary()), *([pa.array(ranks.decode(ids), pa.binary())] if decoded_col else [])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), *columns], names=names)

    bounded_batches(docs.sparkSession)
    names = [id_col, "ids", *([decoded_col] if decoded_col else [])]
    lean = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("_text"))
    return lean.mapInArrow(tidy(run), lean.select(id_col, *[F.lit(b"").alias(c) for c in names[1:]]).schema)


def decode(encoded: DataFrame, ranks_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows of encoded with out_col, the bytes that ids_col stands for; an older out_col is replaced."""
    kept = [c for c in encoded.columns if c != out_col]
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = held("bpe", ("ranks", ranks_path), lambda: Ranks(ranks_path))
        for batch in batches:
            step = max(1, len(batch) * 4_000_000 // max(1, batch.column(at).nbytes))
            for start in range(0, len(batch), step):
                part = batch.slice(start, step)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ranks.decode(part.column(at).to_pylist()), pa.binary())], names=[*kept, out_col])

    lean = encoded.select(*kept)
    return lean.mapInArrow(tidy(run), lean.withColumn(out_col, F.lit(b"")).schema)
