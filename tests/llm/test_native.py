"""Quality rules, license scans, chat formatting and mixing against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from quern.llm import chat, common, licenses, mixing, quality

WORD = r"[^\x20\x09-\x0D]+"


def test_quality_counts(spark, docs, empty):
    for r in quality.judged(docs, to="quality of").collect():
        t, m = r["text"] or "", r["quality of"]
        w = re.findall(WORD, t)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        many, covered = Counter(grams), set()
        for i, g in enumerate(grams):
            if many[g] > 1:
                covered.update(range(i, i + 8))
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == want
        assert m["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (m["kept"] and m["base_failed"])
    kept = quality.kept_only(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality.kept_only(empty).count() == 0


def test_license_places(spark, empty):
    texts = [None, "", "Released under the MIT License. under the mit license", "CC-BY-NC x cc by nc", "the Apache License, Version 2.0", "mit license",
             "This work is licensed under the GNU General Public License, version 3.", "x " * 5000 + "under the MIT license"]
    df = spark.createDataFrame([(i % 6, t) for i, t in enumerate(texts)] + [(2, texts[2])], "doc_id long, text string")
    found = Counter(tuple(r) for r in licenses.scanned(df).collect())
    want = Counter()
    for i, t in [(i % 6, t) for i, t in enumerate(texts)] + [(2, texts[2])]:
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        at, labels = [], set()
        for base in (x for x in licenses.TEMPLATES if x.base):
            p = base.words.split()
            places = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += places
            labels |= {base.label} if places else set()
        want[(i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))] += 1
    assert Counter(k[:6] for k in found.elements()) == want
    assert any(k[6] == "gpl-3" for k in found)
    assert licenses.scanned(empty).count() == 0


def test_chat_round_trip(spark):
    bad = [("us\ner<|n|>", r"a<|b<\|c<\\|<"), ("assistant", "<|im_start|>x\n<|im_end|>\n"), ("", ""), ("user<", "|im_end|>"), ("assistant", "<|im_end|>"), (None, None)]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(bad)] + [(2, 0, "user", "hi"), (2, 0, "user", "hi"), (None, 1, "assistant", "x")]
    done = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert all(r["identical"] for r in done.collect())
    out = {r["conv_id"]: r for r in chat.digests(done).collect()}
    turns = [(r or "", t or "") for r, t in bad]
    said = "".join(r + "\n" + t + "\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    assert out[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert (out[1]["loss_chars"], out[1]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert out[2]["n_turns"] == 2 and out[None]["loss_chars"] == 1
    text = {r["conv_id"]: r["text"] for r in done.collect()}[1]
    assert text.count("<|im_end|>") == len(bad)
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_mask_cuts_the_trained_texts(spark):
    """Run lengths, walked by hand over the formatted text; rows without conv_id don't meet."""
    texts = ["plain", "<|im_end|><|im_start|>x", "é<\\|ß😀", "", None, "a\nb"]
    rows = [(i % 2, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(texts * 3)]
    rows += [(None, 1, "assistant", "x"), (None, 1, "assistant", "y"), (None, 1, "user", "z"), (-1, 0, "user", "before")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").unionByName(chat.hostile(spark))
    done = chat.formatted(df)
    said = {}
    for r in done.collect():
        at, out = 0, []
        for m in r["mask"]:
            at += m["before"]
            out += [re.sub(r"<\\(\\*)\|", r"<\1|", r["text"][at : at + m["chars"]])] if m["trained"] else []
            at += m["chars"]
        assert out == [t["text"] for t in r["turns"] if t["role"] == "assistant"]
        said.setdefault(r["conv_id"], []).append("".join(out))
    assert sorted(said[None]) == ["", "x", "y"] and len(said[-1]) == 1
    found = sorted((str(r["conv_id"]), r["loss_chars"], r["loss_sha256"]) for r in chat.digests(done).collect())
    assert found == sorted((str(k), len(x), hashlib.sha256(x.encode()).hexdigest()) for k, v in said.items() for x in v)


def test_permutation_is_one(spark):
    for n in (1, 2, 97, 1000):
        p = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long"))).collect()]
        assert sorted(p) == list(range(n))


def test_mix_meets_targets(spark, docs, empty):
    out = mixing.mix(docs, block=16).collect()
    assert out and sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3), block=16).collect()), key=str)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    bound, fixed = {s: 2 * size[s] for s in size}, set()
    while True:  # reshare by weight until none is above its bound
        rest = 1.5 * sum(size.values()) - sum(bound[s] for s in fixed)
        level = rest / sum(weights[s] for s in size if s not in fixed)
        above = {s for s in size if s not in fixed and level * weights[s] > bound[s]}
        if not above:
            break
        fixed |= above
    for s in size:
        assert abs(target[s] - (bound[s] if s in fixed else level * weights[s])) < 1e-6
        assert abs(taken[s] - target[s]) <= 0.5
    assert mixing.mix(empty).count() == 0


def test_shards_hold_the_mix(spark, docs, empty):
    """Blocks of fixed length by shard: they say what mix counts, word for word, and slots fall on shards evenly."""
    unique = docs.dropDuplicates(["doc_id"])
    rows = mixing.sharded(unique, block=16, shard_slots=50).collect()
    stream = Counter()
    for r in unique.collect():
        stream.update((r["source"], w) for w in re.findall(WORD, r["text"] or ""))
    taken, by_shard = Counter(), Counter()
    for r in rows:
        w = r["text"].split(" ")
        assert r["n_words"] == len(w) <= 16 and all((r["source"], x) in stream for x in w)
        taken[r["source"]] += len(w)
        by_shard[r["shard"]] += 1
    source = {r["doc_id"]: r["source"] for r in unique.collect()}
    want = Counter()
    for r in mixing.mix(unique, block=16).collect():
        want[source[r["doc_id"]]] += r["taken"]
    assert taken == Counter({k: v for k, v in want.items() if v})
    assert sorted((r["shard"], r["place"]) for r in rows) == [(s, i) for s in sorted(by_shard) for i in range(by_shard[s])]
    n = sum(by_shard.values())
    assert all(abs(v - n / len(by_shard)) < 6 * (n / len(by_shard)) ** 0.5 for v in by_shard.values())
    assert mixing.sharded(empty).count() == 0


def test_shard_counts_are_multinomial(spark):
    sources = spark.createDataFrame([(0, 40_000, 30_000.0), (1, 9_000, 18_000.0)], "rank long, size long, target double")
    dealt = mixing.slots(sources, block=10, shard_slots=300)
    counts = {(r["rank"], r["shard"]): r["count"] for r in mixing.drawn(mixing.needs(sources, 10), shard_slots=300).collect()}
    assert {(r["rank"], r["shard"]): r["count"] for r in dealt.groupBy("rank", "shard").count().collect()} == counts
    slots_of, shards = {0: 3000, 1: 1800}, len({s for _, s in counts})
    assert shards == 16 and {k: sum(v for (q, _), v in counts.items() if q == k) for k in slots_of} == slots_of
    for rank, n in slots_of.items():  # chi-squared against equal chances, 15 degrees of freedom
        assert 3 < sum((counts.get((rank, s), 0) - n / shards) ** 2 / (n / shards) for s in range(shards)) < 45
    index = {r[0]: r[1] for r in dealt.filter("rank = 0").groupBy("index").count().collect()}
    assert set(index.values()) == {1} and len(index) == 3000


def test_mix_by_a_plain_reading(spark, docs):
    """Streams, slots, permutation and blocks by loops, with the hash as it is published: what mix takes of each row."""

    def hashed(*values):
        h = 42
        for v in values:
            if v is not None:
                h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, seed=h)
        return h - (1 << 64) if h >> 63 else h

    whole, short = (lambda x: None if x is None else struct.pack("<q", x)), (lambda x: struct.pack("<i", x))
    block = 16
    extra = spark.createDataFrame([(None, "one two three", "s"), (None, "one two three", "s"), (None, "four", "s"), (3, "five six", "s"), (3, "five six", "s"), (3, "seven", None)], "doc_id long, text string, source string")
    rows = docs.select("doc_id", "text", "source").unionByName(extra)
    found = mixing.mix(rows, block=block).collect()
    said = [(r["doc_id"], r["text"], r["source"]) for r in rows.collect()]
    sizes = [len(re.findall(WORD, t or "")) for _, t, _ in said]
    by_source = defaultdict(int)
    for (_, _, s), n in zip(said, sizes):
        by_source[s] += n
    ranks = {s: k for k, s in enumerate(sorted(by_source, key=lambda s: (s is None, s or "")))}
    asked, weights, bounds = 1.5 * sum(sizes), {s: (3.0, 1.0, 2.0)[k % 3] for s, k in ranks.items()}, {s: 2.0 * n for s, n in by_source.items()}
    full = set()
    while True:
        level = (asked - sum(bounds[s] for s in full)) / sum(w for s, w in weights.items() if s not in full)
        above = {s for s in weights if s not in full and level * weights[s] > bounds[s]}
        if not above:
            break
        full |= above
    buckets, copies, streams = max(1, int(len(said) ** 0.5)), Counter(), defaultdict(list)
    for (i, t, s), n in zip(said, sizes):
        h = hashed(t)
        copies[i, s, h] += 1
        c = copies[i, s, h]
        streams[s].append((hashed(whole(i), whole(h), whole(c)) % buckets, i is not None, i or 0, h, c, n, i))
    want = []
    for s, stream in streams.items():
        stream.sort()
        size, key = by_source[s], hashed(short(20), short(ranks[s]))
        taken = [0] * size
        words = int(bounds[s] if s in full else math.floor(level * weights[s] + 0.5))
        passes, rest, blocks = (words // size, words % size, -(-size // block)) if size else (0, 0, 0)
        for slot in range(passes * blocks + -(-rest // block)):
            nth, turn, n = slot % blocks, slot // blocks, size // block
            x = nth
            for i in range(24) if nth < n else ():
                other = (hashed(whole(key), short(i), short(1)) % n - x) % n
                x = other if hashed(whole(key), short(i), whole(max(x, other)), short(2)) % 2 == 0 else x
            for w in range(x * block, min(size, x * block + (block if turn < passes else min(block, rest - nth * block)))):
                taken[w] += 1
        start = 0
        for *_, n, i in stream:
            want.append((i, n, size, sum(taken[start : start + n])))
            start += n
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in found), key=str) == sorted(want, key=str)


def test_rows_without_an_id_of_their_own_are_spread(spark):
    """Thousands of rows with one id, or none, fall in many buckets, repeated ones too."""
    rows = spark.range(3000).selectExpr("cast(if(id % 3 = 0, null, 7) as bigint) as doc_id", "concat('w', id % 500, ' x') as text", "'s' as source")
    sized = mixing.measured(rows)
    sources = mixing.targets(sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    per = [r["count"] for r in mixing.offsets(sized, sources).groupBy("bucket").count().collect()]
    assert sum(per) == 3000 and len(per) > 45 and max(per) < 150


def test_rows_are_ordered_by_id_and_hash(spark):
    rows = [(5, "b", {"k": 1}), (None, "c", {"k": 1}), (3, "x", {"k": 1, "l": 2}), (3, "y", {"k": 1}), (3, "y", {"k": 1}), (None, "d", None), (9, None, {})]
    schema = "doc_id long, own string, m map<string,int>"
    df = spark.createDataFrame(rows, schema).withColumn("deep", F.array(F.struct(F.col("m").alias("m"), F.array("m").alias("ms"))))
    found = sorted((r["own"], r["d"]["doc_id"], r["d"]["own"]) for r in common.identified(df.repartition(3)).collect())
    assert [n for n, _, _ in found] == list(range(6)) and [i for _, i, _ in found] == [3, 3, 5, 9, None, None]
    assert found == sorted((r["own"], r["d"]["doc_id"], r["d"]["own"]) for r in common.identified(df.repartition(5)).collect())
    alone = df.filter("doc_id > 3")
    assert sorted(r["own"] for r in common.identified(alone).collect()) == [5, 9]


def test_resampled_says_what_mix_counts(spark, docs):
    unique = docs.dropDuplicates(["doc_id"])
    rows = mixing.resampled(unique, block=16)
    assert rows.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in unique.collect()}
    words = Counter()
    for r in rows.collect():
        assert (r["text"] or "") in (texts[r["doc_id"]] or "") and r["n_chars"] in (None, len(r["text"] or ""))
        words[r["doc_id"]] += len(re.findall(WORD, r["text"] or ""))
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(unique, block=16).collect() if r["taken"]} == {k: v for k, v in words.items() if v}
