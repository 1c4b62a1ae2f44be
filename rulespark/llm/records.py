"""Token ids in files of length-delimited binary records, with an offset index for reads in any order.

A file has an 8-byte head (magic, version, bytes of an id) and records:

    length of the payload   8 bytes, little-endian
    masked crc32 of those   4 bytes
    payload                 id of the sequence (8 bytes, signed), 1 if that id is null else 0 (1 byte), the token ids
    masked crc32 of it      4 bytes

A crc is masked (rotated and shifted by a constant), so that a crc over bytes that hold a crc stays useful. Beside each
file an index has, for each record, three 8-byte numbers: the record's offset, its tokens, and all tokens before it in
the file; so records can be read in any order without a scan.

Rows are dealt by ranges of (id, hash of the text), sorted, encoded and written as they stream by: no task holds more
than an Arrow batch. A file appears under its name only when it is whole, and a task that runs again writes the same.

Defined results: a null text counts as empty, so it has the end id only; null ids come first; rows with one id follow
each other in the order of their texts' hashes, and equal rows are all written; an empty table gives no files and an
empty result; other columns are ignored. Strings of special tokens inside texts give those tokens, as the library does by
default; texts that hold one are encoded whole.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from rulespark.llm.bpe import SPACE, Segments, held, texts_of, tidy
from rulespark.llm.common import pieces, shared_folder, write_file

MAGIC, VERSION = b"RSPREC", 1
MANIFEST = "shard int, file string, n_records long, n_tokens long"


def masked(crc: int) -> int:
    """crc32 rotated right by 15 bits plus a constant, modulo 2^32."""
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(zlib.crc32(length))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def unframe(data, offset: int) -> tuple[bytes, int]:
    """The payload of the record at an offset, and the next record's offset. Raises ValueError if a checksum is wrong."""
    length = bytes(data[offset : offset + 8])
    if len(length) < 8 or struct.unpack("<I", data[offset + 8 : offset + 12])[0] != masked(zlib.crc32(length)):
        raise ValueError(f"length at {offset}: wrong checksum")
    end = offset + 12 + struct.unpack("<Q", length)[0]
    payload = bytes(data[offset + 12 : end])
    if struct.unpack("<I", data[end : end + 4])[0] != masked(zlib.crc32(payload)):
        raise ValueError(f"record at {offset}: wrong checksum")
    return payload, end + 4


def whole_texts(path: str) -> tuple[str, ...]:
    """Strings of added tokens, at which the library splits a text first; and NUL, which marks keys of segments."""
    from tokenizers import Tokenizer

    added = [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]
    if any(re.search(f"[{SPACE}]", t) for t in added):  # segments that follow each other could make one up
        return ("",)
    return "\0", *added


def hf_resolver(path: str, width: int) -> Callable[[list[str]], list[bytes]]:
    """Segments -> ids by the tokenizers library.

    Segments that start with white space and go on and end without it split alike alone and in a row. They are encoded
    in rows; the tokens' bytes tell where each ends. Others are encoded alone.
    """
    from tokenizers import Tokenizer

    tokenizer, kind = Tokenizer.from_file(path), f"<u{width}"
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        n_bytes[i] = len(token)  # a character of a byte-level token is a byte

    def resolve(segments: list[str]) -> list[bytes]:
        out, row = [b""] * len(segments), []
        for i, s in enumerate(segments):
            if s[:1] in (" ", "\n") and len(s) > 1 and not s[1].isspace() and not s[-1].isspace():
                row.append(i)
            elif s:
                out[i] = np.array(tokenizer.encode(s, add_special_tokens=False).ids, kind).tobytes()
        rows = [row[k : k + 256] for k in range(0, len(row), 256)]
        for own, e in zip(rows, tokenizer.encode_batch_fast(["".join([segments[i] for i in r]) for r in rows], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, kind)
            sizes = [len(segments[i]) if segments[i].isascii() else len(segments[i].encode()) for i in own]
            ends = np.searchsorted(np.cumsum(n_bytes[ids]), np.cumsum(sizes)) + 1
            flat, ends = ids.tobytes(), (ends * width).tolist()
            for i, start, end in zip(own, [0, *ends], ends, strict=False):
                out[i] = flat[start:end]
        return out

    return resolve


def write_records(docs: DataFrame, tokenizer_path: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, shards: int | None = None, width: int = 2) -> str:
    """Write the sequences of docs in ascending order of id_col; returns the folder, with manifest.json in it.

    width: bytes of an id, 2 or 4. shards: files at most, the session's shuffle partitions by default. The manifest has
    a line for each file; nothing else comes to the driver.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "records")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], f"<u{width}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = held("records", ("records", tokenizer_path, width), lambda: Segments(hf_resolver(tokenizer_path, width), 128 << 20, whole_texts(tokenizer_path)))
        index: list[np.ndarray] = []
        state = [8, 0, 0]  # offset, tokens, records

        def parts() -> Iterator[bytes]:
            yield struct.pack("<6sBB", MAGIC, VERSION, width)
            for batch in batches:
                for first_row, last_row in pieces(batch, "_text", 6_000_000):
                    ids = batch.column(0).slice(first_row, last_row - first_row).to_pylist()
                    texts = texts_of(batch.column(1).slice(first_row, last_row - first_row))
                    framed = [frame(b"".join((struct.pack("<qB", i or 0, i is None), x, end))) for i, x in zip(ids, encoder.encode(texts), strict=True)]
                    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
                    tokens = (sizes - 25) // width
                    index.append(np.stack([state[0] + np.cumsum(sizes) - sizes, tokens, state[1] + np.cumsum(tokens) - tokens], 1))
                    state[:] = [state[0] + int(sizes.sum()), state[1] + int(tokens.sum()), state[2] + len(ids)]
                    yield b"".join(framed)

        name = f"{folder}/shard-{shard:06d}"
        first = next(batches, None)
        if first is None:
            return
        rest = batches

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from rest

        batches = again()
        write_file(f"{name}.rec", parts())
        write_file(f"{name}.idx", (x.astype("<i8").tobytes() for x in index))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name, "n_records": state[2], "n_tokens": state[1]}], schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64())]))

    from pyspark.sql import functions as F

    lean = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text"))
    key = F.xxhash64("_text")
    sorted_ = lean.repartitionByRange(n, "_id", key).sortWithinPartitions("_id", key)
    found = sorted(sorted_.mapInArrow(tidy(run), MANIFEST).collect())
    starts = accumulate([r.n_tokens for r in found], initial=0)
    lines = [{"shard": r.shard, "file": r.file.rpartition("/")[2], "n_records": r.n_records, "n_tokens": r.n_tokens, "start": s} for r, s in zip(found, starts, strict=False)]
    write_file(f"{folder}/manifest.json", iter([json.dumps(lines).encode()]))
    return folder


def read_shard(name: str, order_seed: int | None = None, start: int = 0) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(id, tokens before it, token ids) of the records of a shard, in their order or, by a seed, shuffled by the index."""
    store, path = pafs.FileSystem.from_uri(name)
    with store.open_input_file(f"{path}.idx") as f:
        index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
    order = np.arange(len(index)) if order_seed is None else np.random.default_rng(order_seed).permutation(len(index))
    with store.open_input_file(f"{path}.rec") as f:
        magic, version, width = struct.unpack("<6sBB", f.read(8))
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError(f"{name}: not a file of records")
        for k in order.tolist():
            offset, n, before = index[k].tolist()
            payload, _ = unframe(memoryview(f.read_at(12 + 9 + n * width + 4, offset)), 0)
            id_, null = struct.unpack_from("<qB", payload)
            yield None if null else id_, start + before, np.frombuffer(payload, f"<u{width}", offset=9)


def read_records(spark: SparkSession, folder: str, *, id_col: str = "doc_id", order_seed: int | None = None) -> DataFrame:
    """id_col, start (tokens of all sequences before it) and ids (binary, little-endian unsigned 32-bit) of each record.

    order_seed: read each file in a shuffled order, by its index.
    """
    store, path = pafs.FileSystem.from_uri(f"{folder}/manifest.json")
    with store.open_input_file(path) as f:
        lines = json.loads(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(id_col, pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for line in batch.to_pylist():
                rows, size = [], 0
                for id_, before, ids in read_shard(f"{folder}/{line['file']}", order_seed, line["start"]):
                    rows.append((id_, before, ids.astype("<u4").tobytes()))
                    size += len(rows[-1][2])
                    if size > 4_000_000 or len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = [(x["file"], x["start"]) for x in lines]
    from pyspark.sql import functions as F

    # A file a task: ranges of row numbers deal out the list of files.
    shards = spark.range(0, len(files), 1, max(1, len(files)))
    if files:
        shards = shards.select(F.get(F.array(*[F.lit(f) for f, _ in files]), F.col("id").cast("int")).alias("file"), F.get(F.array(*[F.lit(s).cast("long") for _, s in files]), F.col("id").cast("int")).alias("start"))
    else:
        shards = shards.select(F.lit("").alias("file"), F.col("id").alias("start"))
    return shards.mapInArrow(run, f"`{id_col}` long, start long, ids binary")
