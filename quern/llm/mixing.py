"""Mixing sources to target weights: fixed-length blocks, multinomial shards, pseudorandom index permutations.

1. Each source's words, in a fixed order of its documents, form one stream that is cut into blocks of `block` words. Its
   target is a number of slots: whole passes over its blocks, then part of one more; the last slot takes only a
   beginning of its block, so that a source's words come within one of its target.
2. The counts of each source's slots in each output shard are drawn, multinomial for a source: every shard is as likely
   for every slot.
3. A shard's slots of a source are a run of the source's slots, as long as was drawn. A slot's block is that which a
   pseudorandom permutation of the source's block indices gives it.
4. Slots and blocks meet in a join by (source, index).

The shards' slots are a table, which everything reads: `sharded` gives the mix itself, block by block in its shards; `mix`
counts what the shards hold of each document, and `resampled` says the same as rows of documents.

Nothing here is gathered by source or doc_id alone: stream offsets are summed in two levels, source by bucket (as many
buckets as the square root of the number of rows) of a hash of id, text and copy; slots are drawn in chunks, and the join's
key is the block.

Defined cases: a null text has size 0; a null source is a source like others and sorts last; documents and sources
of size 0 take 0; in `mix` repeated rows, and rows that share a doc_id or have none, count each on its own, in the other two
rows that are equal in all columns are one; texts of any length are taken apart once; columns with other
names are kept or left aside, whatever their names; an empty table gives an empty result. Equal input rows
give equal results whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import BLANK_CLASS, WORD_CLASS, identified, let, n_words, saved, table, words

BLOCK = 128
SHARD_SLOTS = 1 << 16
SEED = 20
ROUNDS = 24
#: A word with the blanks before it.
PIECE = BLANK_CLASS + "*" + WORD_CLASS
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def permuted(index: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 for any n: swap-or-not rounds, each of which is its own inverse."""

    def swap(x: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, i, F.lit(1)), n) - x, n)
        heads = F.pmod(F.xxhash64(key, i, F.greatest(x, other), F.lit(2)), F.lit(2)) == 0
        return F.when(heads, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), index.cast("long"), swap)


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, n, size) with rank, weight and target: share of all sizes by weight, none above most times its size.

    Resharing excess until none is above its bound ends at min(bound, level * weight). The level follows from the
    sources in the order of bound / weight: the first ones are at their bounds, all after them get the level. The
    windows run over one row per source.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.get(cycle, F.pmod(F.col("rank"), F.lit(len(weights)))))
    by_ratio = W.orderBy(F.col("bound") / F.col("weight"), "rank")
    everything = W.partitionBy()
    filled = (
        ranked.withColumn("bound", (most * F.col("size")).cast("double"))
        .withColumn("asked", share * F.sum("size").over(everything))
        .withColumn("bounds_before", F.sum("bound").over(by_ratio) - F.col("bound"))
        .withColumn("weights_after", F.sum("weight").over(everything) - F.sum("weight").over(by_ratio) + F.col("weight"))
        .withColumn("level", (F.col("asked") - F.col("bounds_before")) / F.col("weights_after"))
        .withColumn("fits", F.col("level") <= F.col("bound") / F.col("weight"))
    )
    level = F.min(F.when(F.col("fits"), F.struct(F.col("bound") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything)
    target = F.least(F.col("bound"), F.coalesce(level["level"] * F.col("weight"), F.col("bound")))
    return filled.select("source", "n", "size", "rank", "weight", target.alias("target"))


def needs(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rank, words, whole, passes, rest, blocks, n_slots) of each source with words: what its target comes to in slots."""
    s = sources.filter("size > 0").select(
        "rank", "size",
        F.floor(F.col("target") + 0.5).cast("long").alias("words"),
        F.floor(F.col("size") / block).cast("long").alias("whole"),
    )
    return (
        s.withColumn("passes", F.floor(F.col("words") / F.col("size")).cast("long"))
        .withColumn("rest", F.col("words") - F.col("passes") * F.col("size"))
        .withColumn("blocks", F.ceil(F.col("size") / block).cast("long"))
        .withColumn("n_slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
        .filter("n_slots > 0")
    )


def drawn(needed: DataFrame, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(rank, shard, count, first): how many slots of each source each output shard has, and the first of them.

    A multinomial draw: each of a source's slots throws a hash for its shard, and the throws are counted.
    """
    chunk = 4096
    n_shards = F.ceil(F.sum("n_slots").over(W.partitionBy()) / shard_slots).cast("long")  # a row for each source
    chunks = needed.select("rank", "n_slots", n_shards.alias("shards")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / chunk).cast("long")))
    )
    first = F.col("chunk") * chunk
    # as many tasks as a shuffle has: chunks are few and small, what they become isn't
    tasks = int(needed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    throws = chunks.repartition(tasks, "rank", "chunk").withColumn("throw", F.explode(F.sequence(first, F.least(first + chunk, F.col("n_slots")) - 1)))
    shard = F.pmod(F.xxhash64(F.lit(seed), F.col("rank"), F.col("throw"), F.lit("shard")), F.col("shards"))
    counts = throws.groupBy("rank", shard.alias("shard")).agg(F.count("*").alias("count"))
    return counts.withColumn("first", F.sum("count").over(W.partitionBy("rank").orderBy("shard")) - F.col("count"))


def slots(sources: DataFrame, block: int = BLOCK, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per slot: rank, slot, index of the block, words it takes at most, and the output shard."""
    needed = needs(sources, block)
    counts = drawn(needed, seed, shard_slots).join(needed, "rank")
    part = 4096  # of a shard's run at a time, so that a source that fills shards alone is dealt out too
    parts = counts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / part).cast("long"))))
    start = F.col("first") + F.col("part") * part
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = parts.repartition(tasks, "rank", "shard", "part").withColumn("slot", F.explode(F.sequence(start, F.least(start + part, F.col("first") + F.col("count")) - 1)))
    nth = F.pmod(F.col("slot"), F.col("blocks"))
    turn = F.floor(F.col("slot") / F.col("blocks")).cast("long")
    key = F.xxhash64(F.lit(seed), F.col("rank"))
    return one.select(
        "rank", "slot",
        F.when(nth < F.col("whole"), permuted(nth, F.col("whole"), key)).otherwise(nth).alias("index"),
        F.when(turn < F.col("passes"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("rest") - nth * block)).cast("long").alias("take"),
        "shard",
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, size, hash, copy) of every row; rows with equal doc_id, source and text are numbered as copies."""
    said = F.col(f"`{text}`")
    rows = docs.select("doc_id", "source", n_words(said).alias("size"), F.xxhash64(said).alias("hash"))
    counted = rows.groupBy("doc_id", "source", "size", "hash").agg(F.count("*").alias("n"))
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")


def offsets(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of `measured` with rank and the place of the document's first word in its source's stream."""
    n = sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, int(n**0.5))
    named = sources.select(F.col("source").alias("its"), "rank", F.col("size").alias("source_size"), "target")
    bucket = F.pmod(F.xxhash64("doc_id", "hash", "copy"), F.lit(buckets))
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("its"))).drop("its").withColumn("bucket", bucket)
    total = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(W.partitionBy("rank").orderBy("bucket")) - F.col("bucket_size")
    within = W.partitionBy("rank", "bucket").orderBy("doc_id", "hash", "copy", "size").rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.withColumn("within", F.sum("size").over(within) - F.col("size"))
        .withColumn("row", F.count("*").over(within))
        .join(total.select("rank", "bucket", before.alias("before")), ["rank", "bucket"])
        .withColumn("offset", F.col("before") + F.col("within"))
        .drop("before", "within", "hash", "copy")
    )


def pieces(placed: DataFrame, dealt: DataFrame, block: int = BLOCK) -> DataFrame:
    """Joins blocks by index: for each document and block the words low to high of the block that are the document's,
    the times that slots take the whole block, and the length of the beginning that a last slot takes."""
    uses = dealt.groupBy("rank", "index").agg(
        F.count_if(F.col("take") == block).alias("times"),
        F.coalesce(F.max(F.when(F.col("take") < block, F.col("take"))), F.lit(0)).alias("head"),
    )
    last = F.floor((F.col("offset") + F.col("size") - 1) / block).cast("long")
    split = placed.withColumn(
        "index",
        F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("offset") / block).cast("long"), last))),
    )
    return (
        # the planner can't tell how many slots a source becomes, and would broadcast them
        split.join(uses.hint("merge"), ["rank", "index"], "left")
        .withColumn("low", F.greatest(F.col("offset") - F.col("index") * block, F.lit(0)))
        .withColumn("high", F.least(F.col("offset") + F.col("size") - F.col("index") * block, F.lit(block)))
        .withColumns({x: F.coalesce(x, F.lit(0)) for x in ("times", "head")})
    )


def sharded(docs: DataFrame, block: int = BLOCK, seed: int = SEED, shard_slots: int = SHARD_SLOTS, text: str = "text", weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """The mix: shard, place (from 0 in the shard), source, n_words and text of every slot. Blocks are packed once, of the
    words of the documents that they span, and joined to the slots that name them."""
    held = identified(docs)
    sized = saved(measured(held.select(F.col("own").alias("doc_id"), "d.source", F.col("d")[text].alias("text"))), "sizes")
    sources = saved(targets(sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")), weights), "sources")
    dealt = saved(slots(sources, block, seed, shard_slots), "shards")
    placed = offsets(sized, sources).filter("size > 0").select("rank", F.col("doc_id").alias("placed id"), "size", "offset")
    met = held.select("own", words(F.col("d")[text]).alias("words")).join(placed, F.col("own") == F.col("placed id"))
    first, last = (F.floor(x / block).cast("long") for x in (F.col("offset"), F.col("offset") + F.col("size") - 1))

    def part(i: Column) -> Column:
        low = F.greatest(i * block - F.col("offset"), F.lit(0)).cast("int")
        high = F.least((i + 1) * block - F.col("offset"), F.col("size")).cast("int")
        return F.struct(i.alias("index"), (F.col("offset") + low).alias("at"), F.slice("words", low + 1, high - low).alias("w"))

    parts = met.select("rank", F.explode(F.transform(F.sequence(first, last), part)).alias("p")).select("rank", "p.*")
    packed = parts.groupBy("rank", "index").agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("parts"))
    blocks = packed.select("rank", "index", F.flatten(F.transform("parts", lambda x: x["w"])).alias("w"))
    taken = dealt.hint("merge").join(blocks, ["rank", "index"]).join(sources.select("rank", "source"), "rank")
    mixed_up = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "rank", "slot"), "rank", "slot")
    said = F.slice("w", F.lit(1), F.col("take").cast("int"))
    return taken.select("shard", (F.row_number().over(mixed_up) - 1).alias("place"), "source", F.size(said).cast("long").alias("n_words"), F.array_join(said, " ").alias("text"))


def mixed(found: DataFrame) -> DataFrame:
    """Words that the slots take of each document, repeats counted."""
    head = F.greatest(F.least("high", "head") - F.col("low"), F.lit(0))
    words = F.col("times") * (F.col("high") - F.col("low")) + head
    keys = ["rank", "bucket", "row", "doc_id", "size", "source_size", "target"]
    return found.groupBy(*keys).agg(F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken"))


def planned(docs: DataFrame, block: int, seed: int, text: str, weights: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """The sources with their targets, and the pieces of all documents."""
    sized = saved(measured(docs, text), "sizes")
    sources = saved(
        targets(sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")), weights), "sources"
    )
    return sources, pieces(offsets(sized, sources), saved(slots(sources, block, seed), "shards"), block)


def resampled(docs: DataFrame, block: int = BLOCK, seed: int = SEED, text: str = "text", weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """The mix as rows of docs: a document whole for every whole pass over its source, and a row for each run of its
    words that the last pass takes, cut at word boundaries with the blanks kept; n_chars follows the text.

    Rows without doc_id, or with one that several rows have, are documents of their own; equal rows are one.
    """
    held = identified(docs)
    said = F.col("d")[text]
    sources, found = planned(held.select(F.col("own").alias("doc_id"), "d.source", said.alias(text)), block, seed, text, weights)
    passes = sources.select(
        "rank", F.when(F.col("size") > 0, F.floor(F.floor(F.col("target") + 0.5) / F.col("size"))).otherwise(0).cast("int").alias("passes")
    )
    start = F.col("index") * block - F.col("offset")
    until = F.when(F.col("times") > F.col("passes"), F.col("high")).otherwise(F.least("high", "head"))
    run = F.struct((start + F.col("low")).cast("int").alias("a"), (start + until).cast("int").alias("b"))
    takes = found.join(passes, "rank").groupBy("rank", "doc_id", "passes").agg(
        F.sort_array(F.collect_list(F.when(until > F.col("low"), run))).alias("runs")
    )
    none = F.array().cast("array<struct<a:int,b:int>>")

    def join_run(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), r["b"].alias("b"))))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["b"] == r["a"]), longer).otherwise(F.concat(done, F.array(r)))

    takes = takes.select(F.col("doc_id").alias("mixed id"), "passes", F.aggregate("runs", none, join_run).alias("runs"))
    met = held.join(takes.filter((F.col("passes") > 0) | (F.size("runs") > 0)), F.col("own") == F.col("mixed id"))
    cut = let(
        F.regexp_extract_all(said, F.lit(PIECE), F.lit(0)),
        lambda w: F.transform("runs", lambda r: F.array_join(F.slice(w, r["a"] + 1, r["b"] - r["a"]), "")),
    )
    none_cut = F.array().cast("array<string>")
    texts = F.concat(F.array_repeat(said, F.col("passes")), F.when(F.size("runs") > 0, cut).otherwise(none_cut))
    out = met.select("d", F.explode(texts).alias("said"))
    row = F.col("d").withField(f"`{text}`", F.col("said"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("said").cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("d")).select("d.*")


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED, text: str = "text", weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken. docs needs doc_id, source and the text."""
    _, found = planned(docs, block, seed, text, weights)
    return mixed(found).select("doc_id", "size", "source_size", "target", "taken")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
