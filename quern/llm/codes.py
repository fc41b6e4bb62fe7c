"""Vector code compression: product quantisation in whole numbers, with partial-distance search.

A component x becomes floor(SCALE * x); a vector is cut into PARTS equal parts, each of which has a codebook of at most
ENTRIES entries. Codebooks start as the parts of the vectors with the smallest ids. A round assigns every part of every
vector to its nearest entry and moves each entry to the mean of its parts, rounded down; entries that nothing was
assigned to stay.

The search adds up squared differences one dimension at a time, in descending order of the variance that the codebook has
there. After each dimension the entry that is ahead is completed, which gives the best complete distance so far, and a mask
drops the entries whose sum strictly exceeds it; ties are left, so that the lowest index wins among equals.

What scales: a round is one narrow pass in which each task adds up its own parts, so that it sends one row at most for each
entry; the driver holds codebooks alone (ENTRIES rows of one vector's length). All numbers are whole, so that no order of
tasks or batches changes a result. Errors by label are summed first and joined then, so that a hot label gathers nothing.

Defined cases: vectors that are null, empty, or hold null or non-finite components are left out, and so are vectors whose
length isn't that of the kept vector with the smallest id (all of them if PARTS doesn't divide that); components beyond
LARGEST / SCALE count as that bound, so that squared distances fit 64 bits; fewer vectors than ENTRIES make codebooks of
so many entries; vectors that share an id are ordered by their components, ids that are null come last, and each row is
encoded; repeated rows count as often as they stand; null labels are one label; an empty table gives no rows; other columns
are left aside, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import saved, table

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
LARGEST = 1 << 27
#: Vectors that are searched at a time.
BLOCK = 2048


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry, position]."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry to each row of values, and its squared distance; the lowest index among equals."""
    order = np.argsort(-entries.astype(float).var(axis=0), kind="stable")
    n = len(values)
    first = order[0]
    gone = (values[:, first, None] - entries[None, :, first]) ** 2
    rows, picked = np.divmod(np.arange(gone.size), len(entries))
    sums = gone.ravel()
    best = np.full(n, np.iinfo(np.int64).max)
    for k, dimension in enumerate(order):
        if k:
            sums = sums + (values[rows, dimension] - entries[picked, dimension]) ** 2
        starts = np.searchsorted(rows, np.arange(n))
        least = np.minimum.reduceat(sums, starts)
        ahead = np.flatnonzero(sums == least[rows])
        ahead = ahead[np.searchsorted(rows[ahead], np.arange(n))]  # the first of each row: entries ascend within it
        if k + 1 == len(order):
            return picked[ahead], least
        rest = order[k + 1 :]
        complete = least + ((values[:, rest] - entries[picked[ahead]][:, rest]) ** 2).sum(axis=1)
        best = np.minimum(best, complete)
        left = sums <= best[rows]
        rows, picked, sums = rows[left], picked[left], sums[left]
    raise ValueError("entries without dimensions")


def assigned(values: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """codes[row, part] and distances[row, part]."""
    parts, _, wide = books.entries.shape
    codes, far = np.empty((len(values), parts), np.int64), np.empty((len(values), parts), np.int64)
    for start in range(0, len(values), BLOCK):
        for p in range(parts):
            held = np.ascontiguousarray(values[start : start + BLOCK, p * wide : (p + 1) * wide])
            codes[start : start + BLOCK, p], far[start : start + BLOCK, p] = nearest(held, books.entries[p])
    return codes, far


def integers(vector: Column) -> Column:
    """floor(SCALE * x) of each component as long; null where the vector is to be left out."""
    usable = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * SCALE))))
    return F.when(usable & (F.size(vector) > 0), whole)


def prepared(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and whole (the components as integers) of the rows that aren't left out for null or non-finite values."""
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), integers(F.col(f"`{vector}`")).alias("whole"))
    return rows.filter("whole is not null")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of prepared() rows; None where there is nothing to learn from."""
    smallest = F.col("vec_id").asc_nulls_last()
    head = [r["whole"] for r in rows.select("vec_id", "whole").orderBy(smallest, "whole").limit(1).collect()]
    if not head or len(head[0]) % parts:
        return None
    width = len(head[0])
    rows = rows.filter(F.size("whole") == width)
    first = np.array([r["whole"] for r in rows.select("vec_id", "whole").orderBy(smallest, "whole").limit(entries).collect()], np.int64)
    books = Codebooks(np.ascontiguousarray(first.reshape(len(first), parts, width // parts).transpose(1, 0, 2)))
    for _ in range(rounds):
        books = moved(rows, books)
    return books


def moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, every entry to the mean of its parts."""
    parts, entries, wide = books.entries.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, wide), np.int64)
        for batch in batches:
            values = matrix(batch.column(0), parts * wide)
            codes, _ = assigned(values, shared.value)
            for p in range(parts):
                at = p * entries + codes[:, p]
                counts += np.bincount(at, minlength=len(counts))
                np.add.at(sums, at, values[:, p * wide : (p + 1) * wide])
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), *(pa.array(sums[used, k]) for k in range(wide))], ["entry", "n", *(f"s{k}" for k in range(wide))])

    kinds = ", ".join(f"s{k} long" for k in range(wide))
    found = rows.select("whole").mapInArrow(totals, f"entry int, n long, {kinds}").groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(wide)])
    flat = books.entries.reshape(-1, wide).copy()
    for r in found.collect():  # one row for each entry at most
        flat[r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(wide)]
    return Codebooks(flat.reshape(books.entries.shape))


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error of prepared() rows of the codebooks' length."""
    parts, entries, _ = books.entries.shape
    if entries > 256:
        raise ValueError("a code has two hex digits for each part: at most 256 entries")
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, far = assigned(matrix(batch.column(2), shared.value.width), shared.value)
            text = codes.astype(np.uint8).tobytes().hex()
            said = pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), said, pa.array(far.sum(axis=1))], ["vec_id", "label", "code", "error"])

    held = rows.filter(F.size("whole") == books.width).select("vec_id", "label", "whole")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields[:2])
    return held.mapInArrow(code, f"{kinds}, code string, error long")


def decoded(rows: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """rows with `approximate` added, the vector that the code stands for, in units of the input; a code of another length gives null."""
    parts, _, wide = books.entries.shape
    flat = F.array(*[F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in entry]) for entry in part]) for part in books.entries.tolist()])
    digits = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.conv(F.substr(F.col(f"`{code}`"), 2 * p + 1, F.lit(2)), 16, 10).cast("int"))
    picked = F.flatten(F.transform(digits, lambda d, p: F.get(F.get(flat, p), d)))
    return rows.withColumn("approximate", F.when(F.length(F.col(f"`{code}`")) == 2 * parts, picked))


def compressed(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that isn't left out."""
    spark = df.sparkSession
    rows = prepared(df, vec_id, vector, label)
    books = trained(rows)
    if books is None:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    codes = saved(encoded(rows, books), "codes")
    sums = saved(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same label"), "label-errors")
    both = codes.join(sums, F.col("label").eqNullSafe(F.col("same label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))
