"""Toxicity by a weighted finite-state pattern grammar.

A text is read as clauses of symbols: a word is an INSULT of some level, a THREAT, a TARGET, a NEGATION, a verb of REPORT, or
OTHER; punctuation ends a clause. Six transducers are composed, each reading what the one before writes, marks included:

* negation marks symbols within NEAR words after a negation;
* reported speech marks symbols after a verb of report, up to the end of the clause, unless that verb is negated;
* target marks what follows someone who is addressed, and, from right to left, what such a one follows, near or anywhere
  in the clause;
* threat writes its class, with a weight of one, where a target follows near and no negation precedes it;
* insult writes the class that its marks make it (negated, reported, addressed, plain), with the weight of its level.

The first three read a clause from left to right, the others what these wrote from right to left. Weights stand on
arcs, and a clause's weight in a class is the sum over its path. A document's features are these sums over its clauses, and
a logistic function turns them into a score.

Insult weights and the logistic weights are learned from labelled documents: word beginnings and words that stand in
toxic documents far more often than in others. Learning uses at most SAMPLE labelled documents, those with the smallest
hash of doc_id, of the rows that the caller gives; that bound is why their labels may be broadcast. Scoring covers all
rows with the fitted model, one narrow pass.

Defined cases: null and empty texts get the score that no finding gives; texts are read whole; rows with equal doc_id, or
without one, are scored each by itself, and repeated rows equally; other columns are left aside, whatever their names; without
labels of both kinds the lexicon is empty and all scores are the share of toxic
labels, or 0; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import dropped, saved, table

SAMPLE = 20_000
NEAR = 3
#: Bound of a worker's cache of words.
CACHED = 1 << 17
#: Lengths of word beginnings that are tried; 0 stands for the whole word.
BEGINNINGS = (4, 5, 6, 7, 8)
TOKENS = re.compile(r"\w+|[.!?;\n]")
END = "."
#: Closed classes of the grammar (English, German, French, Spanish).
THREATS = set("kill hurt destroy murder shoot stab burn beat attack töten umbringen schlagen tuer détruire frapper matar destruir golpear".split())
TARGETS = set("you your yourself he she him her they them du dich dir ihr euch tu toi te vous ils elles usted ustedes tú ellos ellas".split())
NEGATIONS = set("not never no nobody nothing nicht nie kein keine niemals pas jamais aucun nunca jamás ningún".split())
REPORTS = set("said says wrote writes called calls claims claimed quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())

#: Symbols read: kinds, of which the last LEVELS are insults by rising weight; marks stand above them.
OTHER, THREAT, TARGET, NEGATION, REPORT, STOP, INSULT = range(7)
LEVELS, LEAST_ODDS, STEP = 16, 2.5, 0.35
#: Symbols written by the last transducers: the classes.
FEATURES = ("plain", "addressed", "negated", "reported", "threats", "density")
CLASSES = INSULT + LEVELS
KIND, NEGATED, REPORTED, ADDRESSED, NEAR_TARGET = 31, 32, 64, 128, 256
SYMBOLS = range(512)


@dataclass(frozen=True)
class Transducer:
    """Deterministic and weighted: arcs[state][symbol] is (next state, symbol written, weight)."""

    arcs: tuple[tuple[tuple[int, int, float], ...], ...]

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what self writes. States are pairs, weights add up."""
        n = len(other.arcs)

        def arc(a: int, b: int, symbol: int) -> tuple[int, int, float]:
            p, between, v = self.arcs[a][symbol]
            q, out, w = other.arcs[b][between]
            return p * n + q, out, v + w

        return Transducer(tuple(tuple(arc(a, b, s) for s in SYMBOLS) for a in range(len(self.arcs)) for b in range(n)))

    def run(self, symbols: list[int]) -> list[tuple[int, float]]:
        """What it writes for each symbol, with the weight of the arc."""
        state, out = 0, []
        for s in symbols:
            state, symbol, weight = self.arcs[state][s]
            out.append((symbol, weight))
        return out


def after(trigger: int, mark: int, span: int | None, unless: int = 0) -> Transducer:
    """Marks what stands within so many symbols after the trigger, or, for None, up to the end of the clause. A trigger
    that has a mark of `unless` is none."""
    last = 1 if span is None else span

    def arc(left: int, s: int) -> tuple[int, int, float]:
        kind = s & KIND
        if kind == STOP:
            return 0, s, 0.0
        out = s | mark if left else s
        if kind == trigger and not s & unless:
            return last, out, 0.0
        return (left if span is None else max(0, left - 1)), out, 0.0

    return Transducer(tuple(tuple(arc(left, s) for s in SYMBOLS) for left in range(last + 1)))


def writes(classed: Callable[[int], tuple[int, float] | None]) -> Transducer:
    """One state: a symbol becomes the class that `classed` gives, with its weight, or stays."""
    return Transducer((tuple((0, *(classed(s) or (s, 0.0))) for s in SYMBOLS),))


def threat(s: int) -> tuple[int, float] | None:
    return (CLASSES + FEATURES.index("threats"), 1.0) if s & KIND == THREAT and s & NEAR_TARGET and not s & NEGATED else None


def insult(s: int) -> tuple[int, float] | None:
    level = (s & KIND) - INSULT
    if not 0 <= level < LEVELS:
        return None
    kind = "negated" if s & NEGATED else "reported" if s & REPORTED else "addressed" if s & ADDRESSED else "plain"
    return CLASSES + FEATURES.index(kind), LEAST_ODDS + STEP * (level + 0.5)


FORWARD = after(NEGATION, NEGATED, NEAR).then(after(REPORT, REPORTED, None, unless=NEGATED)).then(after(TARGET, ADDRESSED, None))
BACKWARD = after(TARGET, NEAR_TARGET, NEAR).then(after(TARGET, ADDRESSED, None)).then(writes(threat)).then(writes(insult))


@dataclass
class Model:
    """The lexicon (word beginnings, whole words with a space after) and the logistic weights, bias last."""

    lexicon: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0] * (len(FEATURES) + 1))
    cache: dict[str, int] = field(default_factory=dict)

    def symbol(self, word: str) -> int:
        if (known := self.cache.get(word)) is None:
            if len(self.cache) > CACHED:
                self.cache.clear()
            weight = max([self.lexicon.get(word + " ", 0.0), *(self.lexicon.get(word[:n], 0.0) for n in BEGINNINGS if len(word) >= n)])
            kinds = ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))
            level = INSULT + max(0, min(LEVELS - 1, int((weight - LEAST_ODDS) / STEP)))
            known = level if weight > 0 else next((k for k, w in kinds if word in w), STOP if word in ".!?;\n" else OTHER)
            self.cache[word] = known
        return known

    def features(self, text: str | None) -> list[float]:
        found = [self.symbol(w) for w in TOKENS.findall((text or "").lower())]
        sums = [0.0] * len(FEATURES)
        start = 0
        for k in [*(i for i, s in enumerate(found) if s == STOP), len(found)]:
            clause, start = found[start:k], k + 1
            if any(s == THREAT or s >= INSULT for s in clause):
                ahead = [s for s, _ in FORWARD.run(clause)]
                for s, weight in BACKWARD.run(ahead[::-1]):
                    if s >= CLASSES and weight:
                        sums[s - CLASSES] += weight
        sums[-1] = 100 * sum(sums[:4]) / (len(found) + 50)
        return [log(1 + x) for x in sums]

    def score(self, text: str | None) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.features(text))) + self.weights[-1]
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def lexicon_of(counts: list[tuple[str, int, int]], toxic: int, clean: int, least: float = LEAST_ODDS) -> dict[str, float]:
    """Weights of beginnings and words by log odds of documents; counts: (entry, toxic documents, clean documents).

    An entry is left out where a shorter beginning of it says as much.
    """
    odds = {e: log((t + 0.5) / (toxic + 1)) - log((c + 0.5) / (clean + 1)) for e, t, c in counts}
    kept: dict[str, float] = {}
    for e in sorted((e for e in odds if odds[e] >= least), key=lambda e: (len(e), e)):
        if all(kept.get(e[:n], 0.0) < odds[e] - 0.7 for n in BEGINNINGS if n < len(e)):
            kept[e] = odds[e]
    return kept


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> list[float]:
    """Newton's method with a ridge; x without the column of ones."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / len(x) + ridge * np.eye(len(w)), x.T @ (p - y) / len(x) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text") -> Model:
    """Learns from at most `sample` labelled documents; labels: doc_id and toxic (0 or 1, nulls are left out)."""
    spark = docs.sparkSession
    drawn = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(F.broadcast(drawn), "doc_id").select("text", "toxic")
    known = saved(known, "labelled")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    model = Model()
    share = toxic / (toxic + clean) if toxic + clean else 0.0
    model.weights[-1] = log(share / (1 - share)) if 0 < share < 1 else 30.0 if share else -30.0
    if 0 < share < 1:
        word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), F.lit(1))))
        words = known.select(F.monotonically_increasing_id().alias("row"), "toxic", word.alias("word"))
        forms = F.array(F.concat("word", F.lit(" ")), *[F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in BEGINNINGS])
        entries = words.select("row", "toxic", F.explode(F.array_compact(forms)).alias("entry")).distinct()
        counts = entries.groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        # enough documents to tell, and at most one clean document in six
        telling = counts.filter((F.col("t") >= max(5, toxic // 100)) & (F.col("c") * 6 <= F.col("t")))
        model.lexicon = lexicon_of([tuple(r) for r in telling.collect()], toxic, clean)
        shared = spark.sparkContext.broadcast(model.lexicon)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Model(shared.value)
            for batch in batches:
                rows = [own.features(t) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], ["x", "y"])

        rows = known.mapInArrow(measure, "x array<double>, y int").collect()
        x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
        order = np.lexsort([*x.T, y])  # sums in one order, whatever the partitions were
        model.weights = logistic(x[order], y[order])
    dropped(known)
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.weights))
    rows = docs.select(*keep, F.col(f"`{text}`").cast("string").alias("scored text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            scores = pa.array([own.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*keep, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(score, f"{fields}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fitted(docs, labels.filter(~held_out(F.col("doc_id"))))
    out = scored(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
