"""MinHash near-dedup with b-bit signatures, links confirmed on full sets, and connected components.

1. Each text becomes its set of word shingles, a fingerprint of that set, band keys of its minima, and a b-bit
   signature: the low bits of the minima, packed. Texts with equal sets are one node, named by the fingerprint's 64 bits.
2. In each band bucket every node meets the first one, its centre.
3. A pair's similarity is estimated by counting equal low bits and correcting for those that are equal by chance; pairs
   whose estimate is four and a half standard deviations below the threshold, or whose sizes exclude it, go. The others are
   confirmed: the centre's and the members' texts meet, and their full sets are compared.
4. Confirmed links give components. What could still join two of them are pairs that share a bucket and lie in
   different components. Buckets that hold several components are looked at again, in blocks of bounded size: first all
   their nodes meet the one that agrees most with the block's prevailing signature, which in a group of near copies is
   the text they were made from; that is done ROUNDS times, with other blocks. Then all cross pairs that are left.

No step makes all pairs of a group: copies are one node, and near copies mostly are one component before cross pairs
count. Pairs at the threshold share one of the 32 bands of 6 minima with probability 1 - 1e-6 or more, above it sooner.

The texts stand in a table in buckets of their node, and don't move when pairs ask for them; only texts of pairs that
are to be confirmed are sent.

Defined cases: texts without words, null ones too, link with nothing; texts of any length are compared whole; rows that
share a doc_id are documents of their own, each with its own links; rows without doc_id can't be named by a component: they
take no part and are kept; repeated rows are in one component; other columns are left aside, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import dropped, saved, saved_by, table, tasks_for
from quern.llm.graphs import components
from quern.llm.shingles import forget, mix, shingles, split

BANDS, ROWS = 32, 6
#: Minima of a signature; the bands take the first of them.
MINIMA = 2 * BANDS * ROWS
#: Low bits kept of each minimum.
BITS = 4
#: Links at 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Members of one block, of a centre's salt and of a bucket.
BLOCK = 512
#: Fixed multipliers and addends of the hash functions, drawn from a seed.
_draw = np.random.default_rng(6)
_TIMES = _draw.integers(0, 2**32, MINIMA, np.uint32) | np.uint32(1)
_PLUS = _draw.integers(0, 2**32, MINIMA, np.uint32)
_ODD = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
#: Nibbles of a byte that aren't 0.
_NIBBLES = np.array([(x & 15 > 0) + (x >> 4 > 0) for x in range(256)], np.uint8)

#: Rounds in which components of a bucket meet its hub.
ROUNDS_OF_HUBS = 3

SIGNED = "doc_id long, n_shingles long, node long, keys array<long>, bits binary, body binary"


def minima(values: np.ndarray) -> np.ndarray:
    """The minima of a set under all hash functions."""
    low, x = np.full(MINIMA, 2**32 - 1, np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 256):
        low = np.minimum(low, (x[k : k + 256, None] * _TIMES + _PLUS).min(axis=0))
    return low


def packed(low: np.ndarray) -> bytes:
    """The low bits of the minima, two to a byte. The minima are mixed first: that of many values is small."""
    few = (low * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.uint8)
    return (few[0::2] | few[1::2] << 4).tobytes()


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by the share of equal values, less those equal by chance; a and b: signatures as rows of bytes."""
    equal = 1 - _NIBBLES[a ^ b].sum(axis=-1, dtype=np.int32) / MINIMA
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def floor_of(percent: int) -> float:
    """Four and a half standard deviations below the threshold."""
    s, chance = percent / 100, 2.0**-BITS
    equal = s + (1 - s) * chance
    return s - 4.5 * (equal * (1 - equal) / MINIMA) ** 0.5 / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common >= percent * (len(a) + len(b) - common)


def signed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, node (of the set), band keys, b-bit signature, and the text compressed.

    Of copies that a task reads in a row only the first with a doc_id has the last three: a large group of copies stays
    light. Rows without doc_id never have them.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        seeds = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some, rows, seen = batch.slice(k, 512), [], set()
                for doc_id, body in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    s = shingles(split(body or b""))
                    node = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None
                    if node is not None and (node in seen or doc_id is None):
                        rows.append((doc_id, len(s), node, None, None, None))
                    elif node is not None:
                        seen.add(node)
                        low = minima(s)
                        keys = mix((low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64) * _ODD).sum(axis=1) ^ seeds)
                        rows.append((doc_id, len(s), node, keys.view(np.int64), packed(low), pack.compress(body)))
                    else:
                        rows.append((doc_id, 0, None, None, None, None))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "n_shingles", "node", "keys", "bits", "body"]
                )
        forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("body"))
    return rows.mapInArrow(sign, SIGNED)


def confirmed(edges: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough. b's texts go to a's, in salts of at most BLOCK or so members."""
    counted = edges.groupBy("a").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / BLOCK).cast("int"))
    bodies = nodes.select("node", "body")
    members = edges.join(counted.select("a", "salts"), "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")
    )
    members = members.join(bodies, members["b"] == bodies["node"]).select("a", "salt", "b", "body")
    centres = counted.join(bodies, counted["a"] == bodies["node"]).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "body"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        at, sets = None, []
        for batch in batches:
            out = []
            for a, salt, b, body in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingles(split(unpack.decompress(body)))
                if at != (a, salt):
                    at, sets = (a, salt), []
                if b is None:
                    sets.append(s)
                elif any(linked(x, s, percent) for x in sets):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        forget()

    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # nulls come first: a centre before its members
    meeting = members.unionByName(centres).select("a", "salt", "b", "body").repartition(tasks, "a", "salt").sortWithinPartitions("a", "salt", "b")
    return meeting.mapInArrow(check, "a long, b long").distinct()


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those that their signatures and sizes allow."""
    few = nodes.select("node", "n_shingles", "bits")
    a, b = (few.select(*[F.col(c).alias(f"{x}_{c}") for c in few.columns]) for x in "ab")
    met = pairs.join(a, pairs["a"] == a["a_node"]).join(b, pairs["b"] == b["b_node"])
    sizes = F.greatest("a_n_shingles", "b_n_shingles") * percent <= 100 * F.least("a_n_shingles", "b_n_shingles")
    least = floor_of(percent)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(estimated(x, y) >= least if batch.num_rows else [], pa.bool_()))

    return met.filter(sizes).select("a", "b", "a_bits", "b_bits").mapInArrow(keep, "a long, b long").distinct()


def hub_of(bits: np.ndarray) -> int:
    """The row that has the most frequent value in the most places of four bits."""
    parts = np.concatenate([bits & 15, bits >> 4], axis=1)
    counts = np.stack([(parts == v).sum(axis=0) for v in range(16)])
    return int((parts == counts.argmax(axis=0)).sum(axis=1).argmax())


def padded(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lists as rows of one array, and which of its places they fill."""
    sizes = np.array([len(x) for x in lists])
    has = np.arange(sizes.max()) < sizes[:, None]
    rows = np.zeros(has.shape, np.int64)
    rows[has] = np.concatenate([np.array(x, np.int64) for x in lists])
    return rows, has


def cross_pairs(shared: DataFrame, nodes: DataFrame, near: Callable[[np.ndarray, np.ndarray], np.ndarray], percent: int, turn: int | None = None) -> DataFrame:
    """Pairs that share a bucket, lie in different components, and are near by their bits; shared: (key, node, component).

    nodes: (node, n_shingles, bits); sizes must be within the percentage of each other.

    A bucket's members are dealt into blocks, and every two blocks meet in a task of their own. With a turn, each block
    stays by itself, and its members meet its hub alone; another turn deals them into other blocks. Without one, a pair
    that shares several buckets is made in the first of them.
    """
    counted = shared.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = counted.filter("low <> high").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = shared.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit(turn or 0)), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1) if turn is None else F.array("block")
    other = F.explode(others).alias("other")
    rows = rows.select("key", "node", "component", "block", other).withColumns(
        {"i": F.least("block", "other"), "j": F.greatest("block", "other")}
    )
    few = nodes.select("node", "n_shingles", "bits")
    if turn is None:
        few = few.join(rows.groupBy("node").agg(F.collect_set("key").alias("keys")), "node")  # as many as a node has keys
    else:
        few = few.withColumn("keys", F.lit(None).cast("array<bigint>"))
    rows = rows.join(few, "node")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(key: int, group: list) -> pa.RecordBatch:
            node, comp, block, size = (np.array([g[i] for g in group], np.int64) for i in range(4))
            bits = np.frombuffer(b"".join(g[4] for g in group), np.uint8).reshape(len(group), -1)
            keys, has = padded([g[5] for g in group]) if group[0][5] is not None else (None, None)
            a, b = [], []
            for k in range(len(group)) if turn is None else [hub_of(bits)]:
                if turn is not None:  # the hub meets those before it too
                    order = np.r_[k, 0:k, k + 1 : len(group)]
                    node, comp, block, size, bits, k = node[order], comp[order], block[order], size[order], bits[order], 0
                ok = (comp[k + 1 :] != comp[k]) & (np.maximum(size[k + 1 :], size[k]) * percent <= 100 * np.minimum(size[k + 1 :], size[k]))
                if block.min() != block.max():  # pairs within a block belong to the task of that block alone
                    ok &= block[k + 1 :] != block[k]
                met = np.flatnonzero(ok) + k + 1
                met = met[near(bits[met], bits[k])]
                if keys is not None and len(met):
                    shared = (keys[met][:, :, None] == keys[k][has[k]]).any(axis=2) & has[met]
                    met = met[np.where(shared, keys[met], 2**63 - 1).min(axis=1) == key]
                a += [np.minimum(node[met], node[k])]
                b += [np.maximum(node[met], node[k])]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])

        at, group = None, []
        for batch in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != at:
                    if len(group) > 1:
                        yield of(at[0], group)
                    at, group = (key, i, j), []
                group.append(row)
        if len(group) > 1:
            yield of(at[0], group)

    tasks = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "i", "j", "node", "component", "block", "n_shingles", "bits", "keys").repartition(tasks, "key", "i", "j")
    return dealt.sortWithinPartitions("key", "i", "j").mapInArrow(pairs, "a long, b long").distinct()


def bucket_members(rows: DataFrame, percent: int = 0) -> DataFrame:
    """(key, node, centre) for the rows (key, node, size) of all buckets with two nodes or more; the centre is the first node.

    A bucket's nodes lie in the order of their sizes, and it is cut where one is below the percentage of the next: nodes
    on either side can't be similar. The key of such a part is made of the bucket's key and its centre.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key = held_first = held_size = None
        for batch in batches:
            key, node, size = (c.to_numpy() for c in batch.columns)
            if not len(key):
                continue
            apart = np.concatenate([[held_key is None or key[0] != held_key or size[0] * percent > 100 * held_size], (key[1:] != key[:-1]) | (size[1:] * percent > 100 * size[:-1])])
            group, starts = np.cumsum(apart) - 1, node[apart]
            first = starts[group] if apart[0] else np.concatenate([[held_first], starts])[group + 1]
            held_key, held_first, held_size = key[-1], first[-1], size[-1]
            own = mix(key.view(np.uint64) ^ mix(first.view(np.uint64))).view(np.int64) if percent else key
            yield pa.RecordBatch.from_arrays([pa.array(x[~apart]) for x in (own, node, first)], ["key", "node", "centre"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "node", "size").repartition(tasks, "key").sortWithinPartitions("key", "size", "node")
    members = saved(dealt.mapInArrow(meet, "key long, node long, centre long"), "bucket-members")
    # the centres belong to their buckets too
    met = saved(members.unionByName(members.select("key", F.col("centre").alias("node"), "centre").distinct()), "buckets")
    dropped(members)
    return met


def near_duplicates(docs: DataFrame, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id)."""
    everything = saved(signed(docs, text), "signed")
    rows = saved(everything.select("doc_id", "n_shingles", "node"), "rows")
    tasks = tasks_for(docs, 16 << 20)
    nodes = saved_by(
        everything.filter("doc_id is not null and body is not null")
        .select("node", "n_shingles", "keys", "bits", "body")
        .repartition(tasks, "node").dropDuplicates(["node"]),
        "node", tasks, "nodes",
    )
    dropped(everything)
    least = floor_of(percent)

    met = bucket_members(nodes.select(F.explode("keys").alias("key"), "node", F.col("n_shingles").alias("size")), percent)
    tried = met.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    tried = saved(likely(tried, nodes, percent), "likely")
    links = saved(confirmed(tried, nodes, percent), "links")
    found = components(links)
    made = [tried, links]
    for turn in [*range(1, ROUNDS_OF_HUBS + 1), None]:
        placed = met.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        counted = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        # components only grow: buckets that hold one alone are done
        still = saved(placed.join(counted.filter("low <> high").select("key"), "key", "left_semi"), "open-buckets")
        dropped(met)
        met = still
        if still.isEmpty():
            break
        pairs = cross_pairs(still, nodes, lambda x, y: estimated(x, y) >= least, percent, turn)
        pairs = saved(pairs.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
        more = saved(confirmed(pairs, nodes, percent), "more-links")
        tried = tried.unionByName(pairs)
        made += [pairs, more]
        if not more.isEmpty():
            links = saved(links.unionByName(more), "links")
            made.append(links)
            found = components(links)

    named = rows.filter("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    reached = named.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    reached = saved(reached, "reached")
    for done in (nodes, met, *made):
        dropped(done)
    ids = reached.groupBy("component").agg(F.min("least").alias("reached"))
    by_node = reached.join(ids, "component").select("node", "reached")
    own_id = F.col("doc_id")
    return rows.join(by_node, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(own_id.isNotNull(), F.coalesce("reached", own_id)).alias("component_id"),
        F.coalesce(F.coalesce("reached", own_id) == own_id, F.lit(True)).alias("kept"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
