"""Exact substring dedup: distributed prefix doubling over byte positions.

A string of THRESHOLD bytes goes where it also starts earlier: in a document with a smaller doc_id, or earlier in its own.
Ranks are Karp-Miller-Rosenberg names. The name of 2 m bytes at a position is made from the pair of names of m bytes
there and m bytes on; equal names mean equal bytes. Doubling goes from single bytes to 32 and 64 bytes, and the last
step pairs the names of 64 bytes at offsets 0 and 36, which covers 100.

Sorting every position's pairs in Spark would move many times the text. So ranks meet in three rounds, and positions
that are unique in one don't take part in the next:

1. 32 bytes: of the 69 positions at which a string's 32-byte names start, the one with the least name (by a hash, the
   leftmost on ties) stands for the string, and so for the whole run of strings that agree on it: equal strings agree
   on their representative, wherever they are. About one position in 35 is one.
2. Up to 168 bytes: a run's own bytes, named by pairs of 64-byte names that cover them. Spark sorts (32-byte name, run
   name, position). A run equal to an earlier one goes whole. A run that is alone with its 32-byte name is unique and
   ends here. The others go on: some of their strings may be repeated.
3. 100 bytes: the other strings by the pair of 64-byte names at offsets 0 and 36. Spark sorts the pairs, and
   all but the first position of equal pairs go.

In rounds 2 and 3 a task sends at most one position of equal ranks on for each few megabytes of text it reads, the
first; of the others it already knows that they go. So a passage that a third of all documents share makes no large
group. A 32-byte name that stands among many different contexts (a sample of documents finds such names) isn't dealt
by name but by run: all strings of its runs go on to round 3, whatever the sample says results are the same.

Defined cases: texts are their UTF-8 bytes, null ones empty; rows that share a doc_id are documents of their own, at
its place, in the order of a hash, and rows without doc_id come last, likewise; rows that are equal in doc_id and text are one document;
other columns are left aside, whatever their names; documents under the threshold lose nothing; texts are read in segments, so that their length is bounded by one row's memory alone; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import identified, saved, table, tasks_for
from quern.llm.shingles import mix

THRESHOLD = 100
GRAM = 32
#: 32-byte names in a string of THRESHOLD bytes.
SPAN = THRESHOLD - GRAM + 1
#: Strings of a text that are looked at at once, and bytes of text after which a task compares what it has.
SEGMENT, CHUNK = 1 << 21, 8 << 20
PLACE_BITS = 22
#: A run's place and its number of strings in one integer.
RUN = 128
#: Bytes beside a 32-byte name that one side or the other of a string has at least, and bits kept of that side's name.
SIDE, SIDE_BITS = 34, 9
#: Share of documents that is asked for common 32-byte names, and how often a name is common there.
ASKED, COMMON = 64, 64
_draw = np.random.default_rng(1)
_BYTES = _draw.integers(0, 2**64, 256, np.uint64)
_TIMES = _draw.integers(0, 2**64, 8, np.uint64) | np.uint64(1)


def doubled(names: np.ndarray, length: int, step: int) -> np.ndarray:
    """Names of twice the length from pairs of names."""
    return names[:-length] * _TIMES[step] + names[length:]


def names_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of 32 and of 64 bytes at all positions that have so many."""
    names = _BYTES[text]
    for step in range(5):
        names = doubled(names, 1 << step, step)
    return names, doubled(names, GRAM, 5) if len(names) > GRAM else names[:0]


def side_name(short: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
    """A few bits, never all 0, of the pair of 32-byte names at `at` and SIDE bytes on; 0 where it isn't there."""
    at = np.where(there, at, 0)
    name = mix(short[at] * _TIMES[7] + short[at + SIDE]) >> np.uint64(64 - SIDE_BITS)
    return np.where(there, np.maximum(name, np.uint64(1)), np.uint64(0)).astype(np.int64)


def runs_of(text: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one representative: its 32-byte name, the run's own name, and the run packed (see `unpacked`)."""
    n = len(text) - THRESHOLD + 1
    short, long = names_of(text)
    places = np.arange(len(short), dtype=np.uint64)
    low = mix(short) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | places
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[SPAN - width : SPAN - width + n])
    at = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(start, n))
    size = count + THRESHOLD - 1
    name = mix(((at[start] - start) * 256 + count).astype(np.uint64))
    for place in (start, start + 36, start + size - 64, start + size - 100):
        name = mix(name * _TIMES[6] + long[place])
    offset = at[start] - start
    left = side_name(short, at[start] - SIDE, offset >= SIDE)
    right = side_name(short, at[start], offset - count + 1 < SIDE)
    return short[at[start]], name, (((first + start) * RUN + offset) * RUN + count << 2 * SIDE_BITS) | left << SIDE_BITS | right


def unpacked(packed: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, offset of the representative, number of strings, and the side names, of packed runs."""
    bits = (1 << SIDE_BITS) - 1
    whole = packed >> 2 * SIDE_BITS
    return whole // RUN // RUN, whole // RUN % RUN, whole % RUN, packed >> SIDE_BITS & bits, packed & bits


def repeated_with(x: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether another row has the same x and the same side name."""
    order = np.lexsort((side, x))
    new = firsts(x[order], side[order])
    alone = np.empty(len(x), bool)
    alone[order] = new & np.append(new[1:], True)[: len(x)]
    return ~alone & (side > 0)


def segments(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    whole = np.frombuffer(text, np.uint8)
    for first in range(0, max(0, len(text) - THRESHOLD + 1), SEGMENT):
        yield first, whole[first : first + SEGMENT + THRESHOLD - 1]


def firsts(*keys: np.ndarray) -> np.ndarray:
    """In sorted rows, whether one differs from the row before it."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def bytes_of(docs: DataFrame, text: str) -> DataFrame:
    """doc (own in `identified`), doc_id, and the text's bytes as body."""
    named = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("body")))
    return named.select(F.col("own").alias("doc"), "d.doc_id", F.coalesce("d.body", F.lit(b"")).alias("body"))


def _rows(x: np.ndarray, y: np.ndarray, doc: np.ndarray, place: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    """Rows (x, y, doc, place) as they are sent on; of those known to go, place is negative and x spreads them."""
    x = np.where(gone, mix(doc.view(np.uint64) + place.view(np.uint64)).view(np.int64), x)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (x, np.where(gone, 0, y), doc, np.where(gone, -place - 1, place))], ["x", "y", "doc", "place"])


def _compared(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """What a task has read so far: of equal (x, y) all but the first position are known to go."""
    x, y, doc, place = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((place, doc, y, x))
    x, y, doc, place = x[order], y[order], doc[order], place[order]
    return _rows(x, y, doc, place, ~firsts(x, y))


SENT = "x long, y long, doc long, place long"


def run_rows(bodies: DataFrame) -> DataFrame:
    """Round 2's rows: 32-byte name, run name, document, and the packed run as place."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                doc, body = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                held += len(body)
                for first, text in segments(body):
                    gram, name, run = runs_of(text, first)
                    parts.append((gram.view(np.int64), name.view(np.int64), np.full(len(gram), doc, np.int64), run))
                if held > CHUNK and parts:
                    yield _compared(parts)
                    parts, held = [], 0
        if parts:
            yield _compared(parts)

    return bodies.select("doc", "body").mapInArrow(send, SENT)


def string_rows(met: DataFrame) -> DataFrame:
    """Round 3's rows for (doc, body, runs): the two 64-byte names, document, and place * RUN + 1."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                doc, body = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                runs = np.sort(np.array(batch.column(2)[k].as_py(), np.int64))
                start, count = runs // RUN, runs % RUN
                held += int(count.sum()) * RUN // 4
                for first, text in segments(body):
                    last = first + len(text) - THRESHOLD + 1
                    here = (start < last) & (start + count > first)
                    s, e = np.maximum(start[here], first), np.minimum(start[here] + count[here], last)
                    if len(s):
                        n = e - s
                        q = np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())
                        _, long = names_of(text)
                        parts.append((long[q - first].view(np.int64), long[q - first + 36].view(np.int64), np.full(len(q), doc, np.int64), q * RUN + 1))
                if held > CHUNK and parts:
                    yield _compared(parts)
                    parts, held = [], 0
        if parts:
            yield _compared(parts)

    return met.mapInArrow(send, SENT)


def ranked(rows: DataFrame, tasks: int, common: set[int] | None, name: str) -> DataFrame:
    """Sorts the rows by rank in Spark: (doc, place) of positions that go, and with -place - 1 of runs that round 3 looks at.

    common: 32-byte names that aren't dealt by name; None in round 3, where nothing goes on. A task reads its sorted rows
    batch by batch and holds those of one 32-byte name at most, of a common one none.
    """
    by_run = F.col("x").isin(sorted(common)) if common else F.lit(False)
    by = [F.when(by_run, F.col("y")).otherwise(F.col("x"))] if common is not None else [F.col("x"), F.col("y")]
    known = np.array(sorted(common or ()), np.int64)
    plain = (lambda p: p) if common is None else (lambda p: unpacked(p)[0] * RUN + unpacked(p)[2])

    def told(x: np.ndarray, y: np.ndarray, doc: np.ndarray, place: np.ndarray, before: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
        first = firsts(x, y)
        if before is not None and len(x):
            first[0] = (x[0], y[0]) != before
        out = [(doc[~first], plain(place[~first]))]
        if common is not None:
            x, doc = x[first], doc[first]
            start, offset, count, left, right = unpacked(place[first])
            every = np.isin(x, known)
            # strings that start SIDE bytes or more before the representative have the left side, the others the right one
            n_left = np.clip(offset - SIDE + 1, 0, count)
            for side, s, n in ((left, start, n_left), (right, start + n_left, count - n_left)):
                go_on = (repeated_with(x, side) | every) & (n > 0)
                out.append((doc[go_on], -(s[go_on] * RUN + n[go_on]) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["doc", "place"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            gone = columns[3] < 0
            if gone.any():
                yield pa.RecordBatch.from_arrays([pa.array(columns[2][gone]), pa.array(plain(-columns[3][gone] - 1))], ["doc", "place"])
            columns = [c[~gone] for c in columns]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns)]
            x = columns[0]
            if not len(x):
                continue
            # the last name's rows wait for those to come, unless they need none of each other
            waits = 0 if common is None or np.isin(x[-1:], known)[0] else len(x) - int(np.searchsorted(x, x[-1]))
            ready = len(x) - waits
            held = [c[ready:] for c in columns]
            if ready:
                yield from told(*(c[:ready] for c in columns), before)
                before = (int(x[ready - 1]), int(columns[1][ready - 1]))
        if held is not None and len(held[0]):
            yield from told(*held, before)

    dealt = rows.repartition(tasks, *by).sortWithinPartitions("x", "y", "doc", "place")
    found = saved(dealt.mapInArrow(sort, "doc long, place long"), name)
    return found


def common_names(bodies: DataFrame) -> set[int]:
    """32-byte names that COMMON runs or more have in one of ASKED documents; a bounded set, as each takes COMMON rows."""
    some = run_rows(bodies.filter(F.pmod(F.xxhash64("doc"), F.lit(ASKED)) == 0)).filter("place >= 0")
    counted = some.groupBy("x").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    return {r["x"] for r in counted.orderBy(F.desc("n"), "x").limit(10_000).collect()}


def repeated_spans(bodies: DataFrame) -> DataFrame:
    """(doc, place) for runs of strings that go: place is start * RUN + number of strings."""
    tasks = tasks_for(bodies, 1 << 24)
    second = ranked(run_rows(bodies), tasks, common_names(bodies), "runs")
    open_runs = second.filter("place < 0").groupBy("doc").agg(F.collect_list(-F.col("place") - 1).alias("runs"))
    met = bodies.join(open_runs, "doc").select("doc", "body", "runs")
    third = ranked(string_rows(met), tasks, None, "strings")
    return second.filter("place >= 0").unionByName(third)


def cut(body: bytes, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs of bytes."""
    start = np.sort(runs) // RUN
    end = np.maximum.accumulate(start + np.sort(runs) % RUN + THRESHOLD - 1) if len(runs) else start
    new = np.concatenate([[True], start[1:] > end[:-1]]) if len(runs) else np.zeros(0, bool)
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)] if len(runs) else start


DONE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>"


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), spans (start, end, start, end ...)."""
    bodies = bytes_of(docs, text)
    gone = repeated_spans(bodies).groupBy("doc").agg(F.collect_list("place").alias("runs"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out = []
                for doc_id, body, runs in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)):
                    a, b = cut(body, np.array(runs or (), np.int64))
                    ends = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(body)]
                    kept = b"".join(body[i:j] for i, j in zip(ends[::2], ends[1::2]))
                    out.append((doc_id, len(body), len(body) - len(kept), len(a), kept, ends[1:-1]))
                kinds = (pa.int64(),) * 4 + (pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [c.split()[0] for c in DONE.split(", ")])

    return bodies.join(gone, "doc", "left").select("doc_id", "body", "runs").mapInArrow(apply, DONE)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
