"""Substrings, lines, near duplicates, toxicity, decontamination and token output against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import common, decontamination, lines, neardup, substrings, tokens, toxicity
from tests.llm.conftest import prose


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def test_substrings(spark, docs, empty):
    q = "".join(chr(97 + (k * k * 7 + k) % 26) for k in range(400))
    extra = [(100, q), (101, "x" * 250), (102, "zz" + q[100:300] + "é" * 80), (103, "ab" * 120), (104, q[20:119]), (105, "é" * 80 + "k" + q[20:120]), (None, q[:150])]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*extra, (3, q[30:300]), (3, "k" * 101), (3, "kk" + "é" * 80)], "doc_id long, text string"))
    rows = {(r["doc_id"] is None, r["doc_id"], r["own"]): (r["text"] or "").encode() for r in common.identified(df).select("own", "d.*").collect()}
    seen, want = set(), []
    for i in sorted(rows):
        b = rows[i]
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((i[1], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    found = substrings.deduplicated(df).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in found), key=str) == sorted(want, key=str)
    once = prose(31, 80)[:200]
    shared = spark.createDataFrame([(3, once), (3, "another"), (5, once)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in substrings.deduplicated(shared).collect()) == [(3, 0), (3, 0), (5, 200)]
    assert substrings.deduplicated(empty).count() == 0


def test_substrings_over_segments_and_in_many_documents(spark):
    """A text of more than one segment with repeats across its border, and a passage that hundreds of documents say amid
    other words, by all strings' own hashes."""
    r = random.Random(21)
    letters = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    border, passage = substrings.SEGMENT, letters(150)
    text = letters(border + 60_000)
    text = text[: border - 150] + text[1000:1300] + text[border + 150 :]
    rows = [(1, text), (2, letters(50) + text[border - 120 : border + 130]), *((i, letters(90) + passage[i % 7 :] + letters(90)) for i in range(3, 303))]
    seen, want = set(), {}
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 1, np.int32)
        for k in range(len(b) - 99):
            h = hash(b[k : k + 100])
            if h in seen:
                gone[k] += 1
                gone[k + 100] -= 1
            seen.add(h)
        want[i] = int((np.cumsum(gone) > 0).sum())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x["doc_id"]: x["n_removed"] for x in substrings.deduplicated(df).collect()} == want and want[1] == 300 and want[2] > 200 and want[302] > 140


def test_runs_stand_for_all_strings():
    text = np.frombuffer((prose(9, 300) + "ab" * 200).encode(), np.uint8)
    start, offset, count, _, _ = substrings.unpacked(substrings.runs_of(text)[2])
    assert start[0] == 0 and (start[1:] == start[:-1] + count[:-1]).all() and start[-1] + count[-1] == len(text) - 99
    assert (offset - count + 1 >= 0).all() and (offset < substrings.SPAN).all()


def test_near_duplicates(spark, docs, empty):
    groups, sets = Groups(), {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    for a in sets:
        groups.find(a)
        for b in sets:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                groups.link(a, b)
    found = neardup.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), groups.find(r["doc_id"]))
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert neardup.near_duplicates(empty).count() == 0


def test_first_copy_without_doc_id(spark):
    """A set whose first copy has no doc_id is a node all the same, and keeps its links to near copies."""
    w = prose(31, 120).split()
    rows = [(None, " ".join(w)), (2, " ".join(w)), (1, " ".join([*w[:-1], "other"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()}
    assert found == {None: (None, True), 1: (1, True), 2: (1, False)}


def test_estimates_come_near():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.9):
        common = rng.integers(0, 2**64, int(4000 * share), np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**64, int(2000 * (1 - share)), np.uint64)]) for _ in range(2))
        x, y = (np.frombuffer(neardup.packed(neardup.minima(np.unique(s))), np.uint8) for s in (a, b))
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(neardup.estimated(x[None], y[None])[0] - truth) < 0.15


def test_hub_and_cross_pairs_find_what_stars_miss(spark):
    bits = [bytes([v]) * (neardup.MINIMA // 2) for v in (0, 0, 0)]
    nodes = spark.createDataFrame([(i, 10, bytearray(b)) for i, b in enumerate(bits)], "node long, n_shingles long, bits binary")
    shared = spark.createDataFrame([(7, i, i) for i in range(3)], "key long, node long, component long")
    near = lambda x, y: neardup.estimated(x, y) >= 0.7
    assert {tuple(r) for r in neardup.cross_pairs(shared, nodes, near, 85).collect()} == {(0, 1), (0, 2), (1, 2)}
    star = {tuple(r) for r in neardup.cross_pairs(shared, nodes, near, 85, 1).collect()}
    assert len(star) == 2 and set.intersection(*map(set, star))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return row[-1]


def test_lines(spark, docs, empty):
    """Brute force by edit similarity alone, over nulls, repeated rows, shared and missing ids, with either set of keys."""
    base = prose(4, 40)
    words = base.split()
    extra = [(200, base + "\nfresh line of words"), (201, " ".join([*words[:-1], "other"]) + "\n" + base.upper() + "!"), (202, "x\nx\nx"),
             (None, "quite another line\n" + base), (None, "a line without an id"), (202, "y\nfresh line of word")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    hashed = df.select("doc_id", "text", lines.row_hash()).distinct().collect()
    said, groups, rows = set(), Groups(), []
    for r in sorted(hashed, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["row"])):
        for k, line in enumerate((r["text"] or "").split("\n")):
            if w := lines.WORD.findall(line.lower()):
                rows.append((r["doc_id"], r["row"], k, " ".join(w)))
                said.add(" ".join(w))
    said = sorted(said)
    for i, a in enumerate(said):
        groups.find(a)
        for b in said[:i]:
            longer = max(len(a), len(b))
            if len(a) * len(b) < 10**6 and 5 * abs(len(a) - len(b)) <= longer and 5 * distance(a, b) <= longer:
                groups.link(a, b)
    seen, want = set(), set()
    for i, row, k, s in rows:
        if groups.find(s) in seen:
            want.add((i, row, k))
        seen.add(groups.find(s))
    for keys in (lines.THOROUGH, lines.PRODUCTION):
        assert {tuple(r) for r in lines.repeated_lines(df, keys=keys).collect()} == want and len(want) > 5
    assert lines.repeated_lines(empty).count() == 0


def test_lines_leave_texts_and_columns(spark):
    rows = [(1, "one same line\nkept", "a"), (2, "One same line!\n\nother", "b"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string").withColumn("gone row", F.lit(3))
    out = lines.without_repeats(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: rows[0][1], 2: "\nother", None: None}


def test_recall_of_line_keys():
    """Lines of the smallest table against each other, by edit similarity alone: pairs that keys and sketches let through."""
    import duckdb

    text = [r[0] or "" for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    said = sorted({" ".join(lines.WORD.findall(x.lower())) for t in text for x in t.split("\n")} - {""}, key=len)
    said = [s for s in said if len(s) <= 600]
    pairs = duckdb.sql("select a.i, b.i from (select unnest($s) s, unnest(range(len($s))) i) a, (select unnest($s) s, unnest(range(len($s))) i) b "
                       "where a.i < b.i and len(b.s) * 80 <= len(a.s) * 100 and levenshtein(a.s, b.s) * 100 <= 20 * len(b.s)", params={"s": said}).fetchall()
    assert len(pairs) > 20
    bits = lines.sketches(said)
    for keys in (lines.THOROUGH, lines.PRODUCTION):
        of = defaultdict(set)
        for line, key in zip(*lines.gram_keys(said, keys)):
            of[line].add(key)
        found = [bool(of[a] & of[b]) and lines.near(bits[a], bits[b], keys.floor) for a, b in pairs]
        assert np.mean(found) >= 0.95


def test_lines_by_edit_similarity_alone(spark):
    """Brute force over all pairs, short and long lines, edits of words and of characters; no candidates are assumed."""
    r = random.Random(11)
    said = []
    for n in (4, 5, 6, 8, 10, 12, 20, 40):
        for k in range(6):
            w = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]
            said += [" ".join(w), " ".join("replaced" if i == k % n else x for i, x in enumerate(w))]
            c = list(" ".join(w))
            for i in r.sample(range(len(c)), len(c) // 8):
                c[i] = "z" if c[i] != " " else c[i]
            said.append("".join(c))

    groups, want = Groups(), set()
    for i, a in enumerate(said):
        groups.find(i)
        for j, b in enumerate(said[:i]):
            longer = max(len(a), len(b))
            if 5 * abs(len(a) - len(b)) <= longer and 5 * distance(a, b) <= longer:
                groups.link(j, i)
    want = {i for i in range(len(said)) if groups.find(i) != i}
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    assert {x["doc_id"] for x in lines.repeated_lines(df).collect()} == want and len(want) > 60


def test_lines_of_one_or_two_words(spark):
    said = ["Menu", "menu!", "\u4e00\u4e8c\u4e09\u56db\u4e94\u516d", "\u4e00\u4e8c\u4e09\u56db\u4e94\u516d\u3002", "read more", "Read  more", "reed more", "--", "--", "", "x", "y"]
    df = spark.createDataFrame([(7, "\n".join(said))], "doc_id long, text string")
    assert {r["line"] for r in lines.repeated_lines(df).collect()} == {1, 3, 5, 6}


def test_bounds_of_edit_distance():
    r = random.Random(8)
    for _ in range(200):
        a = "".join(r.choice("ab ") for _ in range(r.randint(0, 12)))
        b = "".join(c for c in a if r.random() < 0.8) + r.choice(["", "a", " b"])
        i, j = lines.ends_alike(a, b)
        assert a[:i] == b[:i] and a[len(a) - j :] == b[len(b) - j :]
        assert distance(a, b) == distance(a[i : len(a) - j], b[i : len(b) - j]) <= lines.apart_at_most(a, b)
        assert lines.edit_distance(a, b, 99) == distance(a, b)
        for most in range(4):
            assert (lines.edit_distance(a, b, most) <= most) == (distance(a, b) <= most)


def test_bounds_of_edit_distances():
    """Lines of some hundred characters, edited and unrelated: no bound is above the distance of a pair that it refuses."""
    rng = np.random.default_rng(9)
    one, two = [], []
    for k in range(60):
        a = "".join(rng.choice(list("abcde "), rng.integers(1, 300)))
        b = list(a if k % 4 else "".join(rng.choice(list("abcde "), rng.integers(1, 300))))
        for _ in range(int(rng.integers(0, 1 + len(b) // 3))):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 2))] = rng.choice(list("abcdé"), rng.integers(0, 2))
        one.append(a)
        two.append("".join(b))
    grams = lines.different_grams(one, two)
    for a, b, g in zip(one, two, grams):
        d = distance(a, b)
        assert g <= 6 * d
        for most in {0, d - 1, d, d + 1, max(len(a), len(b)) // 5}:
            assert (lines.edit_distance(a, b, most) <= most) == (d <= most)


def test_cross_pairs_of_lines(spark):
    """All pairs of a bucket in different components, each once, whatever the blocks: a bucket of several blocks and small ones."""
    rng = np.random.default_rng(10)
    bits = lines.sketches(["one and the same line that is long enough to have its minima too"])[0].tobytes()
    sizes = {n: int(rng.choice([100, 110, 130])) for n in range(700)}
    placed = {(1, n): n % 300 for n in range(600)} | {(k, n): n % 300 for k in range(2, 60) for n in map(int, rng.integers(0, 700, 3))}
    nodes = spark.createDataFrame([(n, s, bits) for n, s in sizes.items()], "node long, n_shingles long, bits binary")
    rows = spark.createDataFrame([(k, n, c) for (k, n), c in placed.items()], "key long, node long, component long")
    found = [tuple(r) for r in lines.cross_pairs(rows, nodes, 0.1, 0.8).collect()]
    want = set()
    for key in {k for k, _ in placed}:
        of = sorted(n for k, n in placed if k == key)
        want |= {(a, b) for a in of for b in of if a < b and a % 300 != b % 300 and 10 * min(sizes[a], sizes[b]) >= 8 * max(sizes[a], sizes[b])}
    assert len(found) == len(set(found)) and set(found) == want


def test_rows_of_cross_pairs_carry_no_list_of_keys(spark):
    """What is dealt to blocks has a fixed size for each row, however many buckets its node stands in."""
    nodes = spark.createDataFrame([(1, 50, b"x")], "node long, n_shingles long, bits binary")
    rows = spark.createDataFrame([(1, 1, 1)], "key long, node long, component long")
    plan = lines.cross_pairs(rows, nodes, 0.1, 0.8)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "collect_set" not in plan and "array<" not in plan


def test_lines_exactly_at_the_threshold(spark):
    said = {2 * n: "a" * n for n in range(5, 101, 5)} | {2 * n + 1: "a" * (n * 4 // 5) + "b" * (n // 5) for n in range(5, 101, 5)}
    nodes = spark.createDataFrame(list(said.items()), "node long, said string")
    pairs = spark.createDataFrame([(2 * n, 2 * n + 1) for n in range(5, 101, 5)], "a long, b long")
    assert lines.verified(pairs, nodes, 0.8).count() == 20


def test_short_lines_with_one_phrase_are_no_candidates(spark, monkeypatch):
    """Lines that share a phrase and are otherwise different: their pairs are looked at, and none is written."""
    r = random.Random(12)
    said = ["a phrase that all of these share " + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)) for _ in range(200)]
    kept, rows = lines.saved, {}

    def counted(df, name):
        out = kept(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(lines, "saved", counted)
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    assert lines.repeated_lines(df, keys=lines.PRODUCTION).count() == 0
    assert sum(rows.get(name, 0) for name in ("close-lines", "line-cross-pairs", "short-links")) == 0


@pytest.mark.parametrize("rows", [4096, 8])
def test_short_links(spark, monkeypatch, rows):
    """Brute force over lines in buckets that one batch holds, and in such as are cut into blocks."""
    monkeypatch.setattr(lines, "ROWS", rows)
    r = random.Random(13)
    said = {"a phrase of these " + "".join(r.choice("abcd ") for _ in range(r.randint(2, 40))).strip() for _ in range(60)}
    said |= {x[:k] + r.choice(["", "\u00e9", "zz"]) + x[k + 1 :] for x in sorted(said)[:40] for k in (5, 20)}
    said = sorted({lines.normalised(x).decode() for x in said})
    said = [x for x in said if len(x) <= lines.SHORT] + ["x" * 65]
    node = {x: lines.xxhash.xxh3_64_intdigest(x.encode()) - (1 << 63) for x in said}
    nodes = spark.createDataFrame([(n, x) for x, n in node.items()], "node long, said string")
    found = [frozenset(x) for x in lines.short_links(nodes, lines.THOROUGH, 0.8).collect()]
    want = {frozenset((node[a], node[b])) for a in said for b in said if a < b and 5 * distance(a, b) <= max(len(a), len(b))}
    assert set(found) == want and len(found) == len(want) > 50


def test_bounds_and_distances_of_many_lines():
    r = random.Random(14)
    said = ["".join(r.choice("ab\u00e9 ") for _ in range(r.randint(1, 64))) for _ in range(80)]
    said += ["".join(c for c in x if r.random() < 0.9) or "a" for x in said]
    a, b = np.arange(160), (np.arange(160) + 80) % 160
    want = [distance(said[i], said[j]) for i, j in zip(a, b)]
    short = lines.Short(said)
    assert short.distances(a, b).tolist() == want
    assert short.similar(a, b, 20).tolist() == [5 * d <= max(len(said[i]), len(said[j])) for i, j, d in zip(a, b, want)]
    assert all(lines.edits_at_most(said[i], said[j]) >= d for i, j, d in zip(a, b, want))
    for _ in range(300):
        text = "".join(r.choice("aB z09\n\n  \t_-\u00c9\u03a3\u03c3\u4e00\u0130\u00df.\r\u00bd") for _ in range(r.randint(0, 40)))
        assert lines.normalised_lines(text) == [lines.normalised(x) for x in text.split("\n")]


def test_near_copies_are_linked_beside_shorter_lines(spark, monkeypatch):
    """Each bucket of a family of near copies has a shorter line that is none of them: the copies are linked all the same, before
    all cross pairs of the bucket are made."""
    r = random.Random(15)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(60)]
    base = " ".join(words)
    copies = [" ".join([*words[:k], "changed" + "abcdefghij"[k % 10], *words[k + 1 :]]) for k in range(60)]
    keys = lambda said: set(lines.gram_keys([said], lines.PRODUCTION)[1])
    left, others = keys(base), []
    while left:
        k = r.randrange(len(base) - 24)
        other = base[k : k + 24] + "".join(r.choice("qrstuvwxyz") for _ in range(len(base) * 7 // 8 - 24))
        if left & (own := keys(other)):
            left -= own
            others.append(other)
    kept, rows = lines.saved, {}

    def counted(df, name):
        out = kept(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(lines, "saved", counted)
    df = spark.createDataFrame(list(enumerate([*copies, *others])), "doc_id long, text string")
    assert {x["doc_id"] for x in lines.repeated_lines(df, keys=lines.PRODUCTION).collect()} == set(range(1, 60))
    assert rows["line-cross-pairs"] <= 60


@pytest.mark.parametrize("cells", [1 << 17, 64])
def test_distances_of_many_lines(monkeypatch, cells):
    """Lines of all sizes side by side, as far as distances that take two bytes, and in small chunks."""
    monkeypatch.setattr(lines, "CELLS", cells)
    r = random.Random(16)
    said = ["".join(r.choice("ab\u00e9 ") for _ in range(r.randint(1, r.choice([8, 90, 400])))) for _ in range(90)]
    said += ["".join(c for c in x if r.random() < r.choice([0.6, 0.9])) + r.choice(["", "z"]) or "b" for x in said] + ["x" * 1400, "x" * 700 + "y" * 700]
    a, b = np.r_[np.arange(90), 180, np.arange(90)], np.r_[np.arange(90) + 90, 181, (np.arange(90) + 1) % 90]
    want = np.array([lines.edit_distance(said[i], said[j], 10**6) for i, j in zip(a, b)])
    coded = lines.coded(said)
    for rest in (0, 20, 60):
        most = np.maximum(coded[2][a], coded[2][b]) * rest // 100
        found = lines.distances(coded, a, b, most)
        assert ((found <= most) == (want <= most)).all() and (found[want <= most] == want[want <= most]).all()
    one, two = [said[i] for i in a], [said[j] for j in b]
    for name in ("LONG", "LONGEST"):
        assert lines.alike(one, two, 20).tolist() == [5 * d <= max(len(x), len(y)) for d, x, y in zip(want, one, two)]
        monkeypatch.setattr(lines, name, 50)


@pytest.mark.parametrize("size", [64 << 20, 200])
def test_buckets_of_lines(spark, monkeypatch, size):
    """Rows of all buckets with two lines or more, in groups that a task sorts and in such as go on row by row."""
    monkeypatch.setattr(lines, "GROUP", size)
    r = random.Random(17)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(40)]
    said = sorted({" ".join(r.choice(words) for _ in range(r.randint(12, 40))) for _ in range(80)})
    nodes = spark.createDataFrame(list(enumerate(said)), "node long, said string")
    found = lines.bucketed(nodes, lines.PRODUCTION, 0.8).collect()
    of = defaultdict(list)
    for line, key in zip(*lines.gram_keys(said, lines.PRODUCTION)):
        of[key].append((len(said[line]), int(line)))
    want = []
    for met in map(sorted, of.values()):
        cuts = [k for k in range(1, len(met)) if met[k][0] * 80 > 100 * met[k - 1][0]]
        want += [tuple(n for _, n in met[i:j]) for i, j in zip([0, *cuts], [*cuts, len(met)]) if j - i > 1]
    by_key = defaultdict(list)
    for x in found:
        by_key[x["key"]].append(x["node"])
        assert (x["centre"] == x["node"]) or len(said[x["centre"]]) <= len(said[x["node"]])
    assert Counter(tuple(sorted(x)) for x in by_key.values()) == Counter(tuple(sorted(x)) for x in want) and len(want) > 20


def test_toxicity(spark, empty):
    rng = random.Random(1)
    rows = [(i, prose(i, 40) + (" you vilex. vilexes" if i % 4 == 0 else "")) for i in range(240)]
    df = spark.createDataFrame([*rows, (998, None), (999, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, rng.randint(0, 1), int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(df, labels.filter("doc_id < 200"))
    out = {r["doc_id"]: r for r in toxicity.scored(df, model).collect()}
    assert all(out[i]["predicted"] == int(i % 4 == 0) for i in range(200, 240))
    assert out[998]["score"] == out[999]["score"] < 0.5
    assert toxicity.scored(empty, model).count() == 0
    none = toxicity.fitted(df, labels.filter("toxic = 0"))
    assert {r["predicted"] for r in toxicity.scored(df, none).collect()} == {0}


def test_composed_transducers_mark_clauses():
    model = toxicity.Model({"vile": 3.0})
    plain, addressed, negated, reported, threats, _ = range(6)
    value = lambda t: [x > 0 for x in model.features(t)]
    assert value("the vile thing")[plain] and value("you vile thing")[addressed] and value("vile, you")[addressed]
    assert value("not vile")[negated] and not value("not vile")[plain]
    assert value("they said vile")[reported] and value("kill them")[threats] and not value("kill time")[threats]
    assert value("not here. vile")[plain]
    # a negated verb of report reports nothing; a reported negation still negates
    assert value("never said it all was vile")[plain] and value("said it was not vile")[negated]


def test_composition_is_running_one_after_another():
    r = random.Random(4)
    machines = [toxicity.after(toxicity.NEGATION, toxicity.NEGATED, 3), toxicity.after(toxicity.REPORT, toxicity.REPORTED, None, unless=toxicity.NEGATED),
                toxicity.after(toxicity.TARGET, toxicity.NEAR_TARGET, 2), toxicity.writes(toxicity.threat), toxicity.writes(toxicity.insult)]
    for _ in range(150):
        parts = [r.choice(machines) for _ in range(r.randint(2, 4))]
        whole = parts[0]
        for m in parts[1:]:
            whole = whole.then(m)
        symbols = [r.choice(toxicity.SYMBOLS) & ~(toxicity.KIND) | r.randrange(toxicity.CLASSES) for _ in range(r.randint(0, 30))]
        weights, said = [0.0] * len(symbols), symbols
        for m in parts:
            step = m.run(said)
            said, weights = [s for s, _ in step], [w + v for w, (_, v) in zip(weights, step)]
        assert whole.run(symbols) == list(zip(said, weights))


def test_grammar_against_a_plain_reading():
    """The clauses' sums by the rules as they are worded, without machines."""
    r = random.Random(6)
    model = toxicity.Model({"vile": 3.0, "awful ": 5.0})
    words = ["vile", "viler", "awful", "kill", "you", "not", "never", "said", "the", "thing", ".", "!", ","]
    for _ in range(400):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 25)))
        want, n = dict.fromkeys(toxicity.FEATURES, 0.0), 0
        tokens_ = toxicity.TOKENS.findall(text)
        for clause in re.split(r"[.!]", text):
            w = re.findall(r"\w+", clause)
            negated = [any(x in ("not", "never") for x in w[max(0, i - 3) : i]) for i in range(len(w))]
            # a negation ends where the next one begins anew: the last one within three words counts either way
            for i, x in enumerate(w):
                reported = any(y == "said" and not negated[k] for k, y in enumerate(w[:i]))
                addressed = "you" in w[:i] or "you" in w[i + 1 :]
                if x.startswith("vile") or x == "awful":
                    weight = 3.0 if x.startswith("vile") else 5.0
                    level = max(0, min(15, int((weight - toxicity.LEAST_ODDS) / toxicity.STEP)))
                    kind = "negated" if negated[i] else "reported" if reported else "addressed" if addressed else "plain"
                    want[kind] += toxicity.LEAST_ODDS + toxicity.STEP * (level + 0.5)
                elif x == "kill" and not negated[i] and "you" in w[i + 1 : i + 4]:
                    want["threats"] += 1
        want["density"] = 100 * sum(want[k] for k in toxicity.FEATURES[:4]) / (len(tokens_) + 50)
        assert np.allclose(model.features(text), [np.log1p(want[k]) for k in toxicity.FEATURES])


def test_decontamination(spark, docs, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    w = item.split()
    rows = [(1, None), (2, " ".join(w[5:]) + " zz " + " ".join(w[:5])), (None, item.upper() + "!"), (3, " ".join(w[:4])), (4, "q " * 3000 + item), (5, prose(8, 200))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "a b"), (9, None)], "item_id long, text string")
    rows = decontamination.leaked(df.unionByName(df), bench.unionByName(bench)).collect()  # equal rows are one
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in rows) == [(0, 7), (2, 7), (4, 7)]
    assert decontamination.leaked(empty, bench).count() == decontamination.leaked(df, bench.limit(0)).count() == 0


def test_leaks_against_the_textbook(spark):
    """Random documents and items, null and shared ids, against tiling as it is defined, over all pairs."""
    r = random.Random(12)
    items = [(i, " ".join(r.choice("abcdefghij") for _ in range(r.randint(3, 14)))) for i in range(8)]
    docs_ = []
    for i in range(40):
        w = []
        for _ in range(r.randint(0, 4)):
            t = r.choice(items)[1].split()
            k = r.randrange(len(t))
            w += t[k : k + r.randint(4, 14)] + [r.choice("xyz") for _ in range(r.randint(0, 2))]
        docs_.append((None if i % 9 == 0 else i % 20, " ".join(w)))
    want = set()
    for i, said in docs_:
        for k, t in items:
            if len(t.split()) >= decontamination.SEED and textbook(said.split(), t.split()) >= decontamination.COVER * len(t.split()):
                want.add((i, said, k))
    df = spark.createDataFrame(docs_, "doc_id long, text string")
    found = decontamination.leaked(df, spark.createDataFrame(items, "item_id long, text string"))
    said = {(x["doc_id"], x["row"]): x["text"] for x in df.withColumn("row", F.xxhash64("text")).collect()}
    assert {(x["doc_id"], said[x["doc_id"], x["row"]], x["item_id"]) for x in found.collect()} == want and len(want) > 10


def test_leaks_of_repetitive_texts(spark):
    """Equal words, short periods and both amid other words, against the textbook; and very long ones in little time."""
    import time

    r = random.Random(3)
    said = ["a " * 40, "a b " * 20, "x y " + "a " * 25 + "z", "a b c " * 9 + "a a a a a a a", "q " + "b a " * 13, " ".join(r.choice("ab") for _ in range(60)), "a " * 5]
    items = [(0, "a " * 9), (1, "a b " * 8), (2, "a b c a b c a a a a a a"), (3, "z " + "a " * 12 + "q"), (4, " ".join(r.choice("ab") for _ in range(14)))]
    want = {(i, k) for i, d in enumerate(said) for k, t in items if textbook(d.split(), t.split()) >= decontamination.COVER * len(t.split())}
    found = decontamination.leaked(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in found.collect()} == want and len(want) >= 9
    long = spark.createDataFrame([(1, "a " * 20_000), (2, "b a " * 10_000)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a " * 1000), (2, "a b " * 500)], "item_id long, text string")
    began = time.time()
    rows = {(x["doc_id"], x["item_id"]): (x["coverage"], x["n_tiles"]) for x in decontamination.leaked(long, asked).collect()}
    assert rows == {(1, 1): (1.0, 1), (2, 2): (1.0, 1)} and time.time() - began < 30


def test_rolled_hashes_name_windows():
    x = np.random.default_rng(0).integers(0, 2**64, 300, np.uint64)
    x[200:210] = x[20:30]
    h = decontamination.rolled(x)
    assert len(h) == 296 and (h[200:206] == h[20:26]).all() and len(np.unique(h)) == 290
    wanted = np.zeros(1 << 10, np.uint8)
    for at in decontamination.bits_of(h[:50], 1 << 13):
        np.bitwise_or.at(wanted, (at >> np.uint64(3)).astype(int), (1 << (at & np.uint64(7))).astype(np.uint8))
    assert decontamination.passes(wanted, h[:50]).all() and decontamination.passes(wanted, h[50:]).mean() < 0.2


def textbook(p, t):
    """Greedy string tiling as it is defined: the longest common run of unmarked words again and again, the leftmost first."""
    free_p, free_t, out = [True] * len(p), [True] * len(t), 0
    while True:
        best = (decontamination.SEED - 1, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and free_p[i + k] and free_t[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < decontamination.SEED:
            return out
        free_p[i : i + k], free_t[j : j + k] = [False] * k, [False] * k
        out += k


def test_tiles_are_greedy():
    assert sorted(decontamination.tiles([(6, 0, 0), (8, 4, 10)])) == [(8, 4, 10)]
    assert sorted(decontamination.tiles([(12, 0, 0), (8, 8, 30)])) == [(12, 0, 0)]
    assert sorted(decontamination.tiles([(12, 0, 0), (11, 6, 30)])) == [(5, 12, 36), (12, 0, 0)]


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    extra = spark.createDataFrame([(None, "a b"), (300, "<|endoftext|> x"), (301, "ß　É\tq\x85z \x1cΑΣ")], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(extra)
    found = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens.tokenized(df, length=32).collect())
    tok, at, want = Tokenizer.from_file(tokens.public_tokenizer()), 0, []
    for i, t in sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert found == want
    assert tokens.tokenized(empty).count() == 0


def test_sequences_by_number(spark, docs):
    from quern.llm.common import fresh

    place = fresh(spark, "shards")
    shards = tokens.written(docs, tokens.public_tokenizer(), place, length=16).orderBy("part").collect()
    for s in shards:
        shard = tokens.Shard(s["uri"])
        stream = np.concatenate([np.empty(0, np.uint16), *shard.ids()])
        assert len(stream) == s["n_tokens"]
        for i in (0, 5):
            if 16 * i < len(stream):
                ids, mask = shard.sequence(i)
                assert (ids[mask] == stream[16 * i : 16 * i + 16]).all() and len(ids) == 16


def test_held_out_rule(spark):
    rows = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
