"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression of the row alone, so the operator is one narrow stage: nothing is shuffled,
no row meets another, and a source that holds a third of all rows costs what its bytes cost.

Defined cases: a null text counts as an empty one (no words, base_failed, not kept); texts of any length are
measured whole; repeated rows are judged each on its own; a null doc_id is kept as it is; an empty table gives an empty result; columns of the
input that clash with the measures' names stay out of the way, as measures live in one struct until the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import BLANK_CLASS, WORD_CLASS, let, table, unused

#: Frequent function words of the corpus languages (English, German, French, Spanish).
STOP_WORDS = (
    "the be to of and that have with in is it for was on are as this by from or at an not "
    "der die das und ist nicht ein eine mit von zu den im sich auf für dem als "
    "le la les de et un une que est pour dans en des du qui par pas sur au avec "
    "el los las y del se por con una al lo su no es"
).split()

#: What lies between symbols.
SYMBOL_GAPS = "[^#*$%&|<>]+"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; None leaves a side open. Measures over no words or lines are 0."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The verdict: ratios of length, symbols, stop words and lines. They are wide, so that ordinary prose of any
#: language passes, tables and symbol noise don't.
RULES = (
    Rule("word_length", "word_chars / n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols / n_words", None, 0.3),
    Rule("stop_words", "n_stop / n_words", 0.02, None),
    Rule("dup_lines", "n_dup_lines / n_lines", None, 0.5),
    Rule("stutter", "n_stutter / n_words", None, 0.2),
    Rule("shouting", "n_upper / word_chars", None, 0.5),
    Rule("marks", "n_marks / n_words", None, 0.5),
)


def covered(grams: Column, window: int = WINDOW) -> Column:
    """Words under windows whose hash stands in the array twice or more. n log n: equal hashes meet by sorting."""
    keyed = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(
        keyed,
        lambda z: F.transform(
            F.filter(z, lambda x, k: (F.get(z, k - 1)["h"] == x["h"]) | (F.get(z, k + 1)["h"] == x["h"])),
            lambda x: x["i"],
        ),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
    return F.aggregate(
        F.array_sort(twice),
        start,
        lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last")),
    )["n"]


def window_hashes(ids: Column, at: tuple[int, ...]) -> Column:
    """For each window the hash of the words at these places in it."""
    starts = F.sequence(F.lit(0), F.size(ids) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(ids, i + k) for k in at]))
    return F.when(F.size(ids) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def left_over(text: Column, pattern: str) -> Column:
    """Characters that stay when all matches of the pattern go."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def measured(docs: DataFrame, text: str = "text", to: str = "quality", stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """docs with a struct of all counts. Words are compared by 64-bit hashes within one text.

    The steps are projections of their own, each used more than once by the next, so that they stay apart and are
    compiled: arrays of hashes are made once. A hash of four of a window's eight words is looked at first; where no
    two are equal, no two windows are.
    """
    t, w, ids, few, ln = (F.col(f"`{to}.{n}`") for n in ("t", "w", "ids", "few", "ln"))
    stops = [f for x in sorted(set(stop_words)) for f in (x, x.capitalize())]
    steps = (
        docs.withColumn(f"{to}.t", F.coalesce(F.col(f"`{text}`"), F.lit("")))
        .withColumn(f"{to}.w", F.array_remove(F.split(t, BLANK_CLASS + "+"), ""))
        .withColumn(f"{to}.ids", F.transform(w, lambda x: F.xxhash64(x)))
        .withColumns({
            f"{to}.few": window_hashes(ids, (0, 2, 5, 7)),
            f"{to}.ln": F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(WORD_CLASS))),
        })
    )
    repeats = F.when(
        F.size(F.array_distinct(few)) < F.size(few), let(window_hashes(ids, tuple(range(WINDOW))), lambda h: covered(h))
    ).otherwise(0)
    counts = F.struct(
        F.size(ids).cast("long").alias("n_words"),
        left_over(t, BLANK_CLASS + "+").alias("word_chars"),
        left_over(t, SYMBOL_GAPS).alias("n_symbols"),
        F.size(ln).cast("long").alias("n_lines"),
        (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: x.isin(stops))).cast("long").alias("n_stop"),
        F.size(F.filter(ids, lambda x, i: x == F.get(ids, i - 1))).cast("long").alias("n_stutter"),
        left_over(t, r"[^\p{Lu}]+").alias("n_upper"),
        left_over(t, "[^!|]+").alias("n_marks"),
    )
    return steps.withColumn(to, counts).drop(*[f"{to}.{n}" for n in ("t", "w", "ids", "few", "ln")])


def compiled(rules: tuple[Rule, ...], m: Column) -> Column:
    """The threshold table as one boolean expression over the struct of measures."""
    verdict = F.lit(True)
    for r in rules:
        top, bottom = (m[x.strip()].cast("double") for x in r.measure.split("/"))
        ratio = F.when(bottom > 0, top / bottom).otherwise(0.0)
        if r.low is not None:
            verdict = verdict & (ratio >= r.low)
        if r.high is not None:
            verdict = verdict & (ratio <= r.high)
    return verdict


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", to: str = "quality") -> DataFrame:
    """docs with one struct column more: the measures, base_failed, and kept."""
    m = measured(docs, text, to)
    s = F.col(f"`{to}`")
    failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
    return m.withColumn(to, s.withField("base_failed", failed)).withColumn(
        to, s.withField("kept", ~s["base_failed"] & compiled(rules, s))
    )


def kept_only(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that the rules keep, with the columns of docs.

    A filter on the verdict alone would be pushed below the projections, with all their expressions put into it and
    evaluated again for each use; next to a column that isn't deterministic it stays above them.
    """
    of, row = unused(docs, "quality of"), unused(docs, "quality row")
    q = judged(docs, rules, text, of).withColumn(row, F.monotonically_increasing_id())
    return q.filter(F.col(f"`{of}`")["kept"] & (F.col(f"`{row}`") >= 0)).drop(of, row)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return q.select("doc_id", *[F.col("quality")[n].alias(n) for n in names])
