"""Benchmark decontamination by greedy string tiling.

Seeds are runs of SEED equal words of a document and a benchmark item. Running Karp-Rabin hashes name the runs of both
sides, and Spark joins them by name: documents send only the runs that a Bloom filter of the items' names lets through, a
filter of at most FILTER_BITS, whatever the benchmark's size; one that is overfull lets more through and loses none. Where
the items are few, the planner sends them to every task; else both sides are dealt by name, and adaptive execution splits
names that very many documents say. Texts don't move: what meets for a document and an item are places.

A seed comes with the words before and after it, and the join keeps only hits where these differ on one side: the first and the
last of each maximal match. A document and an item that say the same words over and over have as many hits as the
product of their lengths, but no more matches than the sum. Tiling then takes the longest match that overlaps no tile so far, again
and again; a match that partly overlaps one is cut to what is free and goes back in line. The share of an item's words
under tiles is its coverage, whatever their order in the document, so that a passage whose parts were moved about
counts like one in order. A document leaks an item if the coverage is COVER or more.

Defined cases: words are runs of letters, digits and _, lower-cased; null and empty texts have none; texts of any length are
read whole; items with fewer than SEED words have no seed and match nothing; a null doc_id or item_id stays null; rows
that share a doc_id are judged by their own texts (column row tells them apart), and rows that are equal in doc_id and
text are one, as are items that are equal in item_id and text; other columns are left aside, whatever their names;
empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table
from quern.llm.shingles import forget, mix, word_hashes

SEED = 5
COVER = 0.6
#: Bits of the filter for each seed of the benchmark, and of the whole filter at most.
BITS_A_SEED, FILTER_BITS = 16, 1 << 25
WORDS = re.compile(r"\w+")
LEAKS = "doc_id long, row long, item_id long, coverage double, n_tiles int, first_word int"
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def tokens(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def rolled(values: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of all runs of SEED values: a running sum of values, each times a power, gives each window from
    the one before it by what leaves and what comes in."""
    n = len(values)
    if n < SEED:
        return np.empty(0, np.uint64)
    ones = np.ones(n, np.uint64)
    ones[1:] = np.uint64(_BACK)
    falling = np.multiply.accumulate(ones)
    running = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(values * falling)])
    ones[1:] = np.uint64(_BASE)
    rising = np.multiply.accumulate(ones)
    return mix((running[SEED:] - running[:-SEED]) * rising[SEED - 1 :])


def tiles(matches: list[tuple[int, int, int]], words: int | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiling of maximal matches (length, place in the document, place in the item); words: of the item, after which
    nothing is left to do."""
    line = [(-n, p, t) for n, p, t in matches]
    heapify(line)
    free_p = np.ones(max((p + n for n, p, _ in matches), default=0), bool)
    free_t = np.ones(max((t + n for n, _, t in matches), default=0), bool)
    out, left = [], words
    while line and left != 0:
        n, p, t = heappop(line)
        n = -n
        free = free_p[p : p + n] & free_t[t : t + n]
        if free.all():
            out.append((n, p, t))
            free_p[p : p + n] = free_t[t : t + n] = False
            left = left - n if left is not None else None
            continue
        ends = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for start, end in zip(ends[::2].tolist(), ends[1::2].tolist()):
            if end - start >= SEED:
                heappush(line, (start - end, p + start, t + start))
    return out


def matches_of(ends: np.ndarray) -> np.ndarray:
    """Maximal matches (length, place in the document, place in the item) of the first and last seeds of all, as rows
    (place in the document, place in the item, 1 for a first one, 1 for a last one)."""
    ends = np.unique(ends, axis=0)
    ends = ends[np.lexsort((ends[:, 0], ends[:, 0] - ends[:, 1]))]  # along each diagonal first and last ones take turns
    first, last = ends[ends[:, 2] == 1], ends[ends[:, 3] == 1]
    return np.stack([last[:, 0] - first[:, 0] + SEED, first[:, 0], first[:, 1]], axis=1)


def covered_at_most(matches: np.ndarray) -> int:
    """Words of the item that lie under any match: tiles can't cover more."""
    rises = np.zeros((matches[:, 0] + matches[:, 2]).max() + 1, np.int64)
    np.add.at(rises, matches[:, 2], 1)
    np.add.at(rises, matches[:, 0] + matches[:, 2], -1)
    return int((rises.cumsum() > 0).sum())


def seeds(texts: DataFrame, edge: int, wanted: np.ndarray | None = None) -> DataFrame:
    """(id, row, n_words, seed, place, before, after) of all runs of SEED words, of those that the filter lets through; before
    and after are hashes of the words next to the run, or `edge` where there is none."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                said = [tokens(t) for t in part.column(2).to_pylist()]
                sizes = np.array([len(w) for w in said])
                named = word_hashes([w for ws in said for w in ws])
                hashes = rolled(named)
                ends = np.cumsum(sizes)
                # of all words in a row, the runs that lie in one text
                own = np.repeat(np.arange(len(said)), np.maximum(sizes - SEED + 1, 0))
                place = np.arange(len(own)) - np.repeat(np.cumsum(np.maximum(sizes - SEED + 1, 0)) - np.maximum(sizes - SEED + 1, 0), np.maximum(sizes - SEED + 1, 0))
                h = hashes[(ends - sizes)[own] + place] if len(own) else hashes[:0]
                if shared is not None:
                    ok = np.flatnonzero(passes(shared.value, h))
                    own, place, h = own[ok], place[ok], h[ok]
                at = (ends - sizes)[own] + place
                words = np.concatenate([named.view(np.int64), [edge]])
                before = np.where(place > 0, words[at - 1], edge)
                after = np.where(place + SEED < sizes[own], words[np.minimum(at + SEED, len(named))], edge)
                columns = [part.column(0).take(pa.array(own)), part.column(1).take(pa.array(own)), pa.array(sizes[own], pa.int32()), pa.array(h.view(np.int64)), pa.array(place, pa.int32()), pa.array(before), pa.array(after)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "row", "n_words", "seed", "place", "before", "after"])
        forget()

    return texts.mapInArrow(send, "id long, row long, n_words int, seed long, place int, before long, after long")


def bits_of(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in a filter of so many bits, a power of 2."""
    return h & np.uint64(size - 1), (h >> np.uint64(32)) & np.uint64(size - 1)


def passes(wanted: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = ((wanted[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 for x in bits_of(h, 8 * len(wanted)))
    return (a & b).astype(bool)


def filter_of(items: DataFrame) -> np.ndarray:
    """A Bloom filter of the items' seeds: each task sets its own bits, and a few arrays of bounded size come together."""
    n = items.count()
    size = 1 << min(max((n * BITS_A_SEED).bit_length(), 13), FILTER_BITS.bit_length() - 1)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, bool)
        for batch in batches:
            for at in bits_of(batch.column(0).to_numpy().view(np.uint64), size):
                own[at.astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["bits"])

    parts = items.select("seed").coalesce(4).mapInArrow(fill, "bits binary").collect()
    wanted = np.zeros(size // 8, np.uint8)
    for r in parts:
        wanted |= np.frombuffer(r["bits"], np.uint8)
    return wanted


def leaked(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, text: str = "text") -> DataFrame:
    """One row per document and benchmark item that it leaks: doc_id, row (hash of the text), item_id, coverage, n_tiles,
    first_word."""

    def named(df: DataFrame, name: str, said: str) -> DataFrame:
        said = F.col(f"`{said}`").cast("string")
        return df.select(F.col(name).cast("long").alias("id"), F.xxhash64(said).alias("row"), said.alias("text"))

    items = seeds(named(benchmark, "item_id", "text").distinct(), -1).toDF("item_id", "item", "n_words", "seed", "t", "item before", "item after")
    hits = seeds(named(docs, "doc_id", text), -2, filter_of(items)).toDF("doc_id", "row", "own", "seed", "p", "before", "after")
    opens, closes = F.col("before") != F.col("item before"), F.col("after") != F.col("item after")
    met = hits.join(items, (hits["seed"] == items["seed"]) & (opens | closes))
    met = met.groupBy("doc_id", "row", "item_id", "item", "n_words").agg(F.collect_list(F.struct("p", "t", opens.cast("int").alias("opens"), closes.cast("int").alias("closes"))).alias("ends"))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            starts = batch.column(4).offsets.to_numpy()
            flat = np.stack([c.to_numpy() for c in batch.column(4).values.flatten()], axis=1).astype(np.int64)
            for k, (doc_id, row, item_id, n) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
                found = matches_of(flat[starts[k] : starts[k + 1]])
                if covered_at_most(found) >= cover * n:
                    laid = tiles([tuple(m) for m in found.tolist()], n)
                    share = sum(k for k, _, _ in laid) / n
                    if share >= cover:
                        out.append((doc_id, row, item_id, share, len(laid), min(p for _, p, _ in laid)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            columns = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in LEAKS.split(", ")])

    return met.select("doc_id", "row", "item_id", "n_words", "ends").mapInArrow(tile, LEAKS)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "n_tiles", "first_word")
