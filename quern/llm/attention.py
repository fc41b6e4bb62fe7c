"""Quality by attention-based multiple-instance learning: a document is a bag of passages, and only the bag has a label.

A passage is PASSAGE words. Its features are rates of kinds of characters, of capitals, of words said twice in a row, of
distinct words, and counts of its words in BUCKETS hashed buckets. An encoder makes h = tanh(W x + b) of them; gated attention
gives each passage the weight softmax(w . (tanh(V h) * sigmoid(U h))) among those of its document; a logistic function of
the weighted sum of h is the score. All layers are learned together from the labels of documents, by Adam over small
batches.

Learning takes at most SAMPLE labelled documents, those with the smallest hash of doc_id, and of each at most LEARNED
passages, evenly spaced; both bounds are parameters and are why the learned rows fit the driver. Scoring covers every passage
of every row with the fitted model, one narrow pass. Features are computed for many texts at a time, over their bytes. A text
beyond SLICE bytes is read in pieces that end with a word, and the pieces' softmaxes are merged, so that memory doesn't grow
with its length.

Defined cases: null texts, and texts without words, are one passage of zeros, all with the same score; rows with equal
doc_id, or without one, are scored each by itself, and repeated rows equally; of labels that contradict each other 1 counts;
without labels of both kinds the score is the share of 1 for all rows (0.5 without any); other columns are left aside,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table

PASSAGE, BUCKETS = 64, 128
SAMPLE, LEARNED = 4000, 16
HIDDEN, GATES = 24, 12
EPOCHS, BATCH, RATE, DECAY, SEED = 25, 128, 0.01, 1e-4, 7
SLICE = 1 << 18
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Kinds of bytes that are counted, each by its own characters.
KINDS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>", "|", "!", ".?;", ",", "\n", "()[]{}\"'-_/\\=+~^`@:")
DENSE = len(KINDS) + 6
ROW = DENSE + BUCKETS


def byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte: its kind (0: none), whether it is a blank, and what it counts for in a word's hash (letters, digits)."""
    kind, blank, said = np.zeros(256, np.uint8), np.zeros(256, bool), np.zeros(256, np.uint64)
    for k, letters in enumerate(KINDS, 1):
        kind[list(letters.encode())] = k
    blank[list(b" \t\n\v\f\r")] = True
    for b in range(256):
        if b >= 0x80 or chr(b).isalnum():
            said[b] = b if b >= 0x80 else ord(chr(b).lower())
    return kind, blank, said


KIND, IS_BLANK, SAID = byte_tables()
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def cut(text: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about `size` bytes that end with a word."""
    start = 0
    while len(text) - start > size:
        found = BLANK.search(text, start + size)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage of the texts, in order, and the number of passages of each text (one at least)."""
    b = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = IS_BLANK[b]
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    words = np.bincount(np.searchsorted(ends, first, side="right"), minlength=len(texts))
    passages = np.maximum(1, -(-words // PASSAGE))
    out = np.zeros((passages.sum(), ROW), np.float32)
    if not len(first):
        return out, passages
    place = np.arange(len(first)) - np.repeat(np.cumsum(words) - words, words)
    of = np.repeat(np.cumsum(passages) - passages, words) + place // PASSAGE  # passage of each word
    opens = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    at, n = of[opens], np.bincount(of, minlength=len(out))[of[opens]].astype(np.float32)
    starts = np.zeros(len(out), np.int64)  # a text's first passage begins with the text, others with a word
    starts[at] = first[opens]
    starts[np.cumsum(passages) - passages] = np.concatenate([[0], ends[:-1]])

    def by_passage(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, starts, dtype=np.float32)[at]

    def by_word(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, opens, dtype=np.float32)

    kind = KIND[b]
    kind[ends - 1] = 0  # the ends of texts were added here
    for k in range(1, len(KINDS) + 1):
        out[at, k - 1] = by_passage(kind == k) / n
    since = np.zeros(len(b), np.int64)
    since[first] = first
    shift = (np.arange(len(b)) - np.maximum.accumulate(since)) & 63  # place in the word
    hashes = np.add.reduceat(SAID[b] * POWERS[shift], first)
    same = np.zeros(len(first), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    new = np.ones(len(first), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    length = by_passage(~blank)
    rates = (np.log1p(n) / 5, length / n / 10, by_passage(b >= 0x80) / length, by_word(kind[first] == 1) / n, by_word(same) / n, by_word(new) / n)
    for k, rate in enumerate(rates, len(KINDS)):
        out[at, k] = rate
    bucket = ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % BUCKETS
    hits = np.bincount(of * BUCKETS + bucket, minlength=len(out) * BUCKETS).reshape(len(out), BUCKETS)
    out[at, DENSE:] = hits[at] / n[:, None]
    return out, passages


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """mean and scale of features; encoder W, b; gates V, U, w; output c, c0."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(ROW, np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.ones(ROW, np.float32))
    layers: dict[str, np.ndarray] = field(default_factory=dict)

    def drawn(self, seed: int) -> Model:
        r = np.random.default_rng(seed)
        near = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.layers = {"W": near(ROW, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": near(HIDDEN, GATES), "U": near(HIDDEN, GATES), "w": near(GATES), "c": near(HIDDEN), "c0": np.zeros(1, np.float32)}
        return self

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """h, the two gates, and the attention's exponent of each passage; x is standardised."""
        m = self.layers
        h = np.tanh(x @ m["W"] + m["b"])
        a, g = np.tanh(h @ m["V"]), sigmoid(h @ m["U"])
        return h, a, g, (a * g) @ m["w"]

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) * self.scale

    def gathered(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For bags of `counts` passages each: highest exponent, sum of exp of the others less it, weighted sum of h."""
        h, _, _, e = self.encoded(self.standardised(x.astype(np.float64)))
        starts = np.cumsum(counts) - counts
        top = np.maximum.reduceat(e, starts)
        weight = np.exp(e - np.repeat(top, counts))
        return top, np.add.reduceat(weight, starts), np.add.reduceat(weight[:, None] * h, starts, axis=0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if "W" not in self.layers:
            return np.full(len(texts), float(sigmoid(self.layers["c0"])[0]) if self.layers else 0.5)
        pieces = [(k, p) for k, t in enumerate(texts) for p in cut(t, SLICE)]
        top, total, z = np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros((len(texts), HIDDEN))
        start = 0
        while start < len(pieces):
            end, size = start, 0
            while end < len(pieces) and (end == start or size + len(pieces[end][1]) <= SLICE):
                size, end = size + len(pieces[end][1]), end + 1
            x, counts = features([p for _, p in pieces[start:end]])
            for (k, _), t, s, v in zip(pieces[start:end], *self.gathered(x, counts)):
                high = max(top[k], t)
                old, new = np.exp(top[k] - high), np.exp(t - high)
                top[k], total[k], z[k] = high, total[k] * old + s * new, z[k] * old + v * new
            start = end
        # texts that are scored together differ by the partitions, and with them the last digits of products
        return np.round(sigmoid(z / total[:, None] @ self.layers["c"].astype(np.float64) + self.layers["c0"]), 9)


def gradients(model: Model, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Log loss of the bags and its gradient by layer; x is standardised, counts are passages of each bag."""
    m = model.layers
    h, a, g, e = model.encoded(x)
    starts, of = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    weight = np.exp(e - np.maximum.reduceat(e, starts)[of])
    weight = weight / np.add.reduceat(weight, starts)[of]
    z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
    p = sigmoid(z @ m["c"] + m["c0"])
    loss = float(-np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)))
    d = (p - y) / len(y)
    dz = (d[:, None] * m["c"])[of]
    dweight = (h * dz).sum(axis=1)
    de = weight * (dweight - np.add.reduceat(weight * dweight, starts)[of])
    gated = de[:, None] * m["w"]
    da, dg = gated * g * (1 - a**2), gated * a * g * (1 - g)
    before = (weight[:, None] * dz + da @ m["V"].T + dg @ m["U"].T) * (1 - h**2)
    return loss, {"W": x.T @ before, "b": before.sum(axis=0), "V": h.T @ da, "U": h.T @ dg, "w": (a * g).T @ de, "c": z.T @ d, "c0": d.sum(keepdims=True)}


def learned(bags: list[tuple[int, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A model of (label, features of passages) bags, which stand in an order of their own."""
    y = np.array([label for label, _ in bags], np.float32)
    share = y.mean() if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return Model(layers={"c0": np.array([60 * (share - 0.5)], np.float32)})
    x = np.concatenate([rows for _, rows in bags])
    spread = x.std(axis=0)
    model = Model(x.mean(axis=0), (1 / np.maximum(spread, 1e-2)).astype(np.float32)).drawn(seed)
    held = [model.standardised(rows) for _, rows in bags]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.layers.items()}
    r, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = r.permutation(len(y))
        for start in range(0, len(y), BATCH):
            some = order[start : start + BATCH]
            _, slopes = gradients(model, np.concatenate([held[k] for k in some]), np.array([len(held[k]) for k in some]), y[some])
            step += 1
            for k, slope in slopes.items():
                slope = slope + DECAY * model.layers[k] * (k not in ("b", "c0"))
                mean, square = moments[k]
                mean += 0.1 * (slope - mean)
                square += 0.001 * (slope**2 - square)
                model.layers[k] = (model.layers[k] - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages: int = LEARNED, text: str = "text") -> Model:
    """Learns from at most `sample` labelled documents, `passages` of each; labels: doc_id and quality (0 or 1, others are
    left out)."""
    drawn = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select("doc_id", F.col(f"`{text}`").cast("binary").alias("text")).join(F.broadcast(drawn), "doc_id").select("quality", "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for held in batch.column(1):
                x = np.concatenate([features([p])[0] for p in cut(held.as_py() or b"", SLICE)])
                rows.append(x[np.unique(np.linspace(0, len(x) - 1, min(passages, len(x))).round().astype(int))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["quality", "x"])

    found = known.mapInArrow(measured, "quality int, x binary").collect()
    bags = sorted((r["quality"], bytes(r["x"])) for r in found)  # one order, whatever the partitions were
    return learned([(label, np.frombuffer(x, np.float32).reshape(-1, ROW)) for label, x in bags])


def scored(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(f"`{text}`").cast("binary").alias("scored text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                texts = [t or b"" for t in some.column(some.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(shared.value.scores(texts), pa.float64())], [*keep, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(score, f"{fields}, score double").withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fitted(docs, labels.filter(~held_out(F.col("doc_id"))))
    out = scored(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
