"""Ranked lexical search: the K best documents for each item, by a threshold-seeded join.

A term that stands in df of N documents weighs w; a document's score is the sum of its impacts, w times a share that grows
with the term's frequency and falls with the document's length, over the item's terms, repeats included. All but w is
whole-number arithmetic, so that scores have no order of summation.

1. One narrow pass takes every whole text apart and writes its vector: number of terms, the terms that any item asks for,
   their frequencies. Counts over all documents (N, all terms, df) come from that table.
2. For each term its K highest impacts are stored. An item's K-th score is at least the K-th impact of any of its terms,
   and at least the K-th score among the documents that head its terms' lists, which are scored exactly: its threshold.
3. An item's terms stand by descending bound (highest impact times repeats). Where the sum of the bounds from a term to the
   last stays below the threshold, no document that has these alone can be among the K best. Terms from where that sum
   stays below SHARE of the threshold are pruned: with less left out, sums say more about what a document can reach.
4. The other terms are joined with the vectors and summed by item and document: candidates, where the sum and the pruned
   terms' bounds together reach the threshold. The K-th highest of these sums is a threshold too, and a better one.
5. What still reaches it is scored exactly, over all terms, and ranked; equal scores by ascending doc_id.

What scales: the join of step 4 makes at most one row for each item's term and document that has it, which grows with
documents times items' terms and never with pairs of documents. Vectors lie in buckets of their documents, so that these rows
are summed where they are made: no shuffle carries them. A frequent term's list is cut in each task to K rows before it
moves (step 2), and joins meet the lists by the terms of items, which the planner broadcasts or not by their known size.
The set of items' terms goes to the tasks of step 1 only below VOCABULARY_BYTES; beyond, vectors hold all terms, and the
joins leave the others out. Either way gives the same rows.

Defined cases: null texts have no terms and texts without terms aren't counted; items without terms, or whose terms nobody
has, have no rows; rows that share a doc_id, or have none, are documents of their own (without doc_id last among equal scores,
equal doc_ids in any order); items that share an item_id, or have none, are items of their own; texts of any length are read
whole, a slice at a time; empty tables give no rows; other columns are left aside, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, dropped, saved, saved_by, table, tasks_for

K = 20
#: Any share up to 1 gives the same rows.
SHARE = 0.5
#: Bytes of documents for each bucket of vectors.
BUCKET = 16 << 20
TERM_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Largest size of the items' terms, in bytes of UTF-8, that is sent to every task.
VOCABULARY_BYTES = 16 << 20
#: Bytes of text that are split at a time.
SLICE = 1 << 22


def folded() -> bytes:
    """A table for bytes.translate: letters and digits in lower case, bytes of other characters as they are, else a blank."""
    return bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 0x80 else b if b >= 0x80 else 0x20 for b in range(256))


def counted(text: bytes, fold: bytes) -> Counter[bytes]:
    """Terms of a text in UTF-8 with their frequencies."""
    found: Counter[bytes] = Counter()
    start = 0
    while start < len(text):
        end = min(start + SLICE, len(text))
        piece = text[start:end].translate(fold)
        while end < len(text) and not piece.endswith(b" "):  # up to the end of the term
            more = text[end : end + 4096].translate(fold)
            cut = more.find(b" ") + 1 or len(more)
            piece, end = piece + more[:cut], end + cut
        found.update(piece.split())
        start = end
    return found


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """q (names a row of items), item_id, term, times."""
    rows = items.select(F.monotonically_increasing_id().alias("q"), F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))
    terms = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM_CLASS), F.lit(0))
    return rows.select("q", "item_id", F.explode(terms).alias("term")).groupBy("q", "item_id", "term").agg(F.count("*").alias("times"))


def vectors(docs: DataFrame, asked: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, n (all terms), terms and tfs (those that asked has, or all) of every document with a term."""
    spark = docs.sparkSession
    size = asked.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    wanted = frozenset(r["term"].encode() for r in asked.collect()) if size <= VOCABULARY_BYTES else None
    shared, fold = spark.sparkContext.broadcast(wanted), folded()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value
        for batch in batches:
            at, n, terms, tfs = [], [], [], []
            for k, held in enumerate(batch.column(2)):
                found = counted(held.as_py() or b"", fold)
                if found:
                    at.append(k)
                    n.append(found.total())
                    known = found.keys() if keep is None else found.keys() & keep
                    terms.append([t.decode() for t in known])
                    tfs.append([found[t] for t in known])
            rest = batch.select([0, 1]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))], ["row", "doc_id", "n", "terms", "tfs"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(taken, f"row long, doc_id {kind}, n long, terms array<string>, tfs array<long>")


def postings(held: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """row, term and share (what the term's weight is multiplied by) of every term that a vector has."""
    by_length = held.withColumn("m", F.expr(f"75L + (25L * n * {n_docs}L) div {max(n_terms, 1)}L"))
    each = by_length.select("row", "m", F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    return each.select("row", F.col("t.terms").alias("term"), F.expr("(1000000000L * t.tfs) div (1000L * t.tfs + 12L * m)").alias("share"))


def best(scores: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each `by` in the given order, with their place from 1; a task sends k rows of each at most."""
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= k)


def searched(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents with a score above 0."""
    asked = saved(item_terms(items, item_id, item_text), "asked")
    tasks = tasks_for(docs, BUCKET)
    taken = vectors(docs, asked.select("term").distinct(), doc_id, text)
    held = saved_by(taken.repartition(tasks, "row"), "row", tasks, "vectors")
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = saved(asked.join(df, "term").select("q", "item_id", "term", "times", weight.alias("w")), "weighed")
    shares = postings(held, n_docs, n_terms)

    def scored(pairs: DataFrame) -> DataFrame:
        """q, row and score of pairs (q, row), over all terms of both."""
        met = pairs.join(held, "row")
        by_length = postings(met.withColumn("row", F.struct("q", "row", "doc_id")), n_docs, n_terms)
        each = by_length.select("row.*", "term", "share").join(weighed.select("q", "term", "times", "w"), ["q", "term"])
        return each.groupBy("q", "row", "doc_id").agg(F.sum(F.col("times") * F.col("w") * F.col("share")).alias("score"))

    terms = weighed.select("term", "w").distinct()
    ranked = shares.join(terms, "term").select("term", "row", (F.col("w") * F.col("share")).alias("impact"))
    heads = saved(best(ranked, "term", k, F.desc("impact"), F.col("row")), "heads")
    ends = heads.groupBy("term").agg(F.max("impact").alias("highest"), F.max(F.when(F.col("place") == k, F.col("impact"))).alias("kth"))
    bounds = saved(weighed.join(ends, "term").withColumn("bound", F.col("times") * F.col("highest")), "bounds")

    seeds = saved(bounds.select("q", "term").join(heads.select("term", "row"), "term").select("q", "row").distinct(), "seeds")
    reached = best(scored(seeds), "q", k, F.desc("score"), F.col("row")).filter(F.col("place") == k).select("q", F.col("score").alias("reached"))
    floors = bounds.groupBy("q").agg(F.max(F.col("times") * F.coalesce("kth", F.lit(0))).alias("stored")).join(reached, "q", "left")
    floors = saved(floors.select("q", F.greatest("stored", F.coalesce("reached", F.lit(0))).alias("floor")), "floors")

    onward = Window.partitionBy("q").orderBy(F.desc("bound"), "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ordered = bounds.join(floors, "q").withColumn("suffix", F.sum("bound").over(onward)).withColumn("pruned", F.col("suffix") < F.col("floor") * SHARE)
    rest = F.coalesce(F.sum(F.when(F.col("pruned"), F.col("bound"))).over(Window.partitionBy("q")), F.lit(0))
    kept = ordered.withColumn("rest", rest).filter(~F.col("pruned"))
    kept = saved(kept.select("q", "term", (F.col("times") * F.col("w")).alias("weight"), "floor", "rest"), "kept-terms")

    sums = shares.join(kept, "term").groupBy("row", "q").agg(F.sum(F.col("weight") * F.col("share")).alias("sum"), F.first("floor").alias("floor"), F.first("rest").alias("rest"))
    reaching = saved(sums.filter(F.col("sum") + F.col("rest") >= F.col("floor")).select("q", "row", "sum", "rest"), "reaching")
    raised = best(reaching, "q", k, F.desc("sum"), F.col("row")).filter(F.col("place") == k).select("q", F.col("sum").alias("raised"))
    within = F.col("sum") + F.col("rest") >= F.coalesce("raised", F.lit(0))
    candidates = saved(reaching.join(raised, "q", "left").filter(within).select("q", "row"), "candidates")
    ranks = best(scored(candidates).filter("score > 0"), "q", k, F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("row"))
    names = weighed.select("q", "item_id").distinct()
    out = saved(ranks.join(names, "q").select("item_id", F.col("place").cast("int").alias("rank"), "doc_id", "score"), "ranked")
    for done in (asked, held, weighed, heads, bounds, seeds, floors, kept, reaching, candidates):
        dropped(done)
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
