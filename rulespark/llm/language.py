"""Language identification by Bayesian fusion of evidence.

The posterior of a language is proportional to the product of

- the likelihood of the text: byte n-grams of its words, from a model fitted on a bounded sample of labelled texts, with
  one more class ``und`` (no known language) under which all n-grams are alike;
- the likelihood of the declared language (of the markup, or a column), from a table of how often texts of each language
  declare which, so unreliable declarations weigh little;
- the likelihood of the address's suffix;
- a prior of the host, smoothed by that of its domain, which is smoothed by that of all addresses.

Tables of declarations, suffixes, domains and hosts are grouped sums over all rows of what the text alone says; from its
host's sums a row's own share is taken out. Sums are combined before the shuffle; only the table of declarations, which
has a row for each pair of known languages at most, comes to the driver.

Defined results: a null or empty text says nothing, so the other evidence decides; a null or unknown declaration is one
value, none; a null or malformed address has no host and no suffix; rows that repeat count repeatedly in the tables and get
equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespark.llm.bpe import held, tidy
from rulespark.llm.common import WordRows, cut, mix, pieces

UNKNOWN = "und"
#: Orders of byte n-grams; a word's n-grams of all orders overlap, so each counts for this part.
ORDERS = (1, 2, 3, 4)

_DROP = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript|nav)\b.*?</\1\s*>")
_TAG = re.compile(r"(?s)<[^>]*>")
_DECLARED = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b")
_CONTENT = re.compile(r"(?is)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([a-z]{2,3})\b")


@dataclass(frozen=True)
class TextModel:
    """languages, and log-probabilities of n-gram buckets: a column for each language, then one for UNKNOWN."""

    languages: tuple[str, ...]
    table: np.ndarray

    def rows(self, found: list[bytes]) -> np.ndarray:
        """Log-likelihoods of each word."""
        out = np.zeros((len(found), self.table.shape[1]), np.float32)
        for start in range(0, len(found), 20_000):
            part = found[start : start + 20_000]
            for bucket, word in buckets(part, len(self.table)):
                _add(out[start : start + len(part)], word, self.table[bucket])
        return out / len(ORDERS)


def _add(out: np.ndarray, word: np.ndarray, values: np.ndarray) -> None:
    """out[word] += values, for ascending word numbers."""
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] += np.add.reduceat(values, first, axis=0)


def buckets(found: list[bytes], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, word number) of all n-grams of the words, for each order; words get a mark at both ends."""
    flat = np.frombuffer(b"".join(b"\x02" + w.lower() + b"\x03" for w in found), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 2
    word = np.repeat(np.arange(len(found)), sizes)
    for k in ORDERS:
        total = np.zeros(max(0, len(flat) - k + 1), np.uint64)
        for i in range(k):
            total = (total << np.uint64(8)) | flat[i : i + len(total)]
        whole = word[: len(total)] == word[k - 1 :] if len(total) else np.zeros(0, bool)
        yield (mix(total[whole] + np.uint64(k << 40)) % np.uint64(n)).astype(np.int64), word[: len(total)][whole]


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = 300, n_buckets: int = 1 << 15, smooth: float = 0.05) -> TextModel:
    """A model of all labelled languages, from the texts of most_docs ids of each at most.

    The sample is those texts whose ids have the least hashes, so it is the same in each run; nulls are left out. Of an
    id's texts in a language the least counts.
    """
    rows = labelled.select(labelled[id_col].cast("string").alias("id"), labelled[lang_col].cast("string").alias("lang"), labelled[text_col].cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    languages = tuple(sorted(r.lang for r in rows.select("lang").distinct().collect() if r.lang != UNKNOWN))
    number = {x: i for i, x in enumerate(languages)}
    key = F.xxhash64("id")
    some = rows.where(F.col("lang") != UNKNOWN).select("id", "lang", F.dense_rank().over(Window.partitionBy("lang").orderBy(key, "id")).alias("n")).where(F.col("n") <= most_docs)
    texts = rows.join(F.broadcast(some.select("id", "lang").distinct()), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))  # ids may repeat
    counts = np.zeros((n_buckets, len(languages)))
    for r in texts.toLocalIterator():
        for bucket, _ in buckets(r.text.encode().split(), n_buckets):
            counts[:, number[r.lang]] += np.bincount(bucket, minlength=n_buckets)
    table = np.log((counts + smooth) / (counts.sum(axis=0) + smooth * n_buckets))
    return TextModel(languages, np.hstack([table, np.full((n_buckets, 1), -math.log(n_buckets))]).astype(np.float32))


def plain(page: str) -> str:
    """The text of a page, without markup."""
    return html.unescape(_TAG.sub(" ", _DROP.sub(" ", page)))


def _evidence(rows: DataFrame, model: TextModel, markup: bool) -> DataFrame:
    """text of a row becomes p, what the text alone says of each language, and declared the number of a language."""
    names, known = [c for c in rows.columns if c != "text"], {x: i for i, x in enumerate(model.languages)}
    at, told = names.index("declared"), len(model.languages)
    token = hash((model.languages, model.table.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(f"language {token}", ("words",), lambda: WordRows(model.rows))
        for batch in batches:
            for start, end in pieces(batch, "text"):
                part = batch.slice(start, end - start)
                texts = [x or b"" for x in part.column("text").to_pylist()]
                declared = part.column("declared").to_pylist()
                if markup:
                    pages = [x.decode("utf-8", "replace") for x in texts]
                    declared = [m[1] if (m := _DECLARED.search(p) or _CONTENT.search(p)) else d for p, d in zip(pages, declared, strict=True)]
                    texts = [plain(p).encode() for p in pages]
                found = [t.split() for t in texts]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                values = words.values([w for f in found for w in f]).astype(np.float64)
                ends = np.concatenate([np.zeros((1, told + 1)), np.cumsum(values, axis=0)]) if len(values) else np.zeros((1, told + 1))
                last = np.cumsum(sizes)
                total = ends[last] - ends[last - sizes]
                total -= total.max(axis=1, keepdims=True)
                likely = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), told + 1).cast(pa.list_(pa.float64()))
                number = pa.array([known.get((d or "").strip().lower().replace("_", "-").partition("-")[0], told) for d in declared], pa.int32())
                columns = [part.column(n) for n in names]
                columns[at] = number
                yield pa.RecordBatch.from_arrays([*columns, likely, pa.array(sizes)], names=[*names, "likely", "n_words"])

    fields = ", ".join(f"`{f.name}` {'int' if f.name == 'declared' else f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    out = rows.select(*names, "text").mapInArrow(tidy(run), f"{fields}, likely array<double>, n_words long")
    weights = F.transform("likely", lambda x: F.exp(x))
    return out.withColumn("p", F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)))


def _sums(n: int, prefix: str) -> list[Column]:
    return [F.sum(F.get("p", F.lit(i))).alias(f"{prefix}{i}") for i in range(n)]


def identify(
    docs: DataFrame, model: TextModel, *, id_col: str, text_col: str = "text", markup: bool = False, url_col: str | None = None, host_col: str | None = None, declared_col: str | None = None,
    strength: float = 10.0, prior_unknown: float = 0.001,
) -> DataFrame:
    """id, row_key, row_size, lang, confidence, text_lang, declared and host of each row.

    markup: text_col is a page, whose markup may declare a language. url_col gives hosts and suffixes; else host_col gives
    hosts. strength: rows' worth of the prior of a level of the hierarchy. row_key and row_size tell rows apart: a hash of
    id and text, and the text's length.
    """
    names = (*model.languages, UNKNOWN)
    n = len(names)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    host = F.regexp_extract(docs[url_col].cast("string"), r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1) if url_col else docs[host_col].cast("string") if host_col else F.lit("")
    rows = docs.select(
        docs[id_col].alias("id"), F.xxhash64(docs[id_col].cast("string"), text).alias("row_key"), F.length(text).alias("row_size"), F.lower(F.coalesce(host, F.lit(""))).alias("host"),
        (docs[declared_col].cast("string") if declared_col else F.lit(None).cast("string")).alias("declared"), text.cast("binary").alias("text"),
    )
    rows = rows.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.when(F.lit(url_col is not None), F.substring_index("host", ".", -1)).otherwise(""))
    seen = cut(_evidence(rows, model, markup), "language-evidence")

    # What all rows say, by language; and by language and declaration: (n + 1) * n numbers at most.
    told = {r.declared: [r[f"s{i}"] for i in range(n)] for r in seen.groupBy("declared").agg(*_sums(n, "s")).collect()}
    totals = np.sum([told.get(d, [0.0] * n) for d in range(n)], axis=0) + 1.0
    totals[-1] = max(totals[-1], 1e-9)
    base = totals / totals.sum()
    base = np.append(base[:-1] / base[:-1].sum() * (1 - prior_unknown), prior_unknown)
    declared = np.array([told.get(d, [0.0] * n) for d in range(n)]) + 0.5
    declared = np.log(declared / declared.sum(axis=0))  # row: declaration, column: language

    def prior(sums: str, size: Column, outer: list[Column]) -> list[Column]:
        return [(F.col(f"{sums}{i}") + strength * outer[i]) / (size + strength) for i in range(n)]

    total = lambda prefix: sum((F.col(f"{prefix}{i}") for i in range(1, n)), F.col(f"{prefix}0"))
    domains = seen.groupBy("domain").agg(*_sums(n, "d"))
    domains = domains.select("domain", *[x.alias(f"o{i}") for i, x in enumerate(prior("d", total("d"), [F.lit(float(b)) for b in base]))])
    hosts = seen.groupBy("domain", "host").agg(*_sums(n, "h")).join(domains, "domain").drop("domain")
    suffixes = seen.groupBy("suffix").agg(*_sums(n, "u"))
    rate = [(F.col(f"u{i}") + 10 * total("u") / F.lit(float(totals.sum()))) / F.lit(float(totals[i] + 10)) for i in range(n)]
    suffixes = suffixes.select("suffix", *[F.log(F.greatest(x, F.lit(1e-12))).alias(f"x{i}") for i, x in enumerate(rate)])

    joined = seen.join(hosts, "host").join(suffixes, "suffix")
    others = [F.greatest(F.col(f"h{i}") - F.get("p", F.lit(i)), F.lit(0.0)) for i in range(n)]  # without the row itself
    size = sum(others[1:], others[0])
    by_host = [F.log(F.greatest((others[i] + strength * F.col(f"o{i}")) / (size + strength), F.lit(1e-12))) for i in range(n)]
    matrix = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in declared])
    score = [F.get("likely", F.lit(i)) + by_host[i] + F.get(F.get(matrix, F.col("declared")), F.lit(i)) + (F.col(f"x{i}") if url_col else F.lit(0.0)) for i in range(n)]
    scored = joined.select("id", "row_key", "row_size", "host", "declared", "likely", F.array(*score).alias("score"))
    code = lambda c: F.get(F.array(*[F.lit(x) for x in names]), (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    most = F.array_max("score")
    share = 1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - most))
    return scored.select(
        F.col("id").alias(id_col), "row_key", "row_size", code(F.col("score")).alias("lang"), F.round(share, 6).alias("confidence"), code(F.col("likely")).alias("text_lang"),
        F.when(F.col("declared") < n - 1, F.get(F.array(*[F.lit(x) for x in names]), F.col("declared"))).alias("declared"), "host",
    )


def keep_languages(docs: DataFrame, model: TextModel, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, **evidence) -> DataFrame:
    """The rows of docs, with all their columns, that are in one of the model's languages with this confidence at least."""
    from rulespark.llm.jaccard import small

    found = identify(docs, model, id_col=id_col, text_col=text_col, **evidence)
    gone = cut(found.where((F.col("lang") == UNKNOWN) | (F.col("confidence") < least)).select("row_key", "row_size").distinct(), "language-rejected")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.join(small(gone), (F.xxhash64(docs[id_col].cast("string"), text) == gone["row_key"]) & (F.length(text) == gone["row_size"]), "left_anti")
