"""Quality rules: a threshold table compiled into one projection of built-in functions.

Each rule bounds one metric of a text; a text is kept if every metric lies within its bounds. All metrics are
computed together, in the row, with no shuffle and no Python.

Defined results: a null text counts as empty; a text without words has ratios of 0 and fails the length rule; rows are
judged each for itself, so repeated rows and ties get equal results; an empty table gives an empty result; columns
other than the two named are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespark.llm.common import GAP, WORD, let

#: Common words of the four languages; they are matched as they stand, so text in capitals has none.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on are this from or an at",
    "der die und das den von zu mit ist im für auf ein eine sich nicht des dem als",
    "le la les de des et en un une que qui dans pour pas est du au avec sur",
    "el los las del y que en por con para una un se su al es no lo como",
)

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """least <= metric <= most for texts of from_words words or more; None is no bound."""

    metric: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The threshold table.
RULES = (
    Rule("n_words", least=10),
    Rule("mean_word_chars", least=1.5, most=20),
    Rule("symbol_ratio", most=0.3),
    Rule("stop_ratio", least=0.02, from_words=30),
    Rule("dup_line_ratio", most=0.5),
    Rule("repeat_ratio", most=0.2),
)


def _repeat_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more; the first occurrence counts too.

    Windows are compared by 64-bit hashes. Only a text that has some equal windows pays for sorting them.
    """
    size = F.size(hashes)
    grams = F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def covered(grams: Column) -> Column:
        def count(ordered: Column) -> Column:
            def shared(x, k):
                return F.coalesce(F.get(ordered, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["g"] == x["g"], F.lit(False))

            starts = F.sort_array(F.transform(F.filter(ordered, shared), lambda x: x["i"]))
            begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
            step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"))
            return F.aggregate(starts, begin, step, lambda a: a["n"])

        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(ordered, count))

    return F.when(size < WINDOW, F.lit(0).cast("long")).otherwise(let(grams, covered))


def metrics(text: Column) -> Column:
    """A struct of counts of a text, as long, and of the ratios that the rules bound."""
    text = F.coalesce(text, F.lit(""))
    stop = list(dict.fromkeys(" ".join(STOP_WORDS).split()))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def counts(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_words"),
            F.length(F.array_join(found, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.greatest(F.size(lines), F.lit(1)).alias("n_lines"),
            let(F.transform(found, lambda w: F.xxhash64(w)), _repeat_words).alias("n_repeat_words"),
            F.size(F.filter(found, lambda w: w.isin(*stop))).cast("long").alias("n_stop"),
        )

    return let(F.array_remove(F.split(text, GAP, -1), ""), counts)


def ratios(m: Column) -> dict[str, Column]:
    n = F.greatest(m["n_words"], F.lit(1))
    return {
        "n_words": m["n_words"],
        "mean_word_chars": m["word_chars"] / n,
        "symbol_ratio": m["n_symbols"] / n,
        "stop_ratio": m["n_stop"] / n,
        "dup_line_ratio": m["n_dup_lines"] / m["n_lines"],
        "repeat_ratio": m["n_repeat_words"] / n,
    }


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule of the table holds."""
    by, kept = ratios(m), F.lit(True)
    for rule in rules:
        short = m["n_words"] < F.lit(rule.from_words)
        if rule.least is not None:
            kept = kept & (short | (by[rule.metric] >= F.lit(rule.least)))
        if rule.most is not None:
            kept = kept & (short | (by[rule.metric] <= F.lit(rule.most)))
    return kept


def quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct for each row: the counts, base_failed and kept."""
    m = metrics(docs[text_col])

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
        return F.struct(m.alias("counts"), failed.alias("base_failed"), (~failed & verdict(m, rules)).alias("kept"))

    return let(m, judged)


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of each row."""
    found = docs.select(docs[id_col].alias(id_col), quality(docs, text_col, rules).alias("q"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select(id_col, *[F.col(f"q.counts.{n}").alias(n) for n in names], "q.base_failed", "q.kept")


def keep_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    return docs.where(quality(docs, text_col, rules)["kept"])
