"""Attention over passages, ranked search and vector codes against plain readings."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import attention, codes, retrieval
from tests.llm.conftest import prose


# ---- vector codes

def plain_codes(rows):
    """(vec_id, label, vector) rows as the contract reads: loops over all entries, in Python's own integers."""
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    wide = len(kept[0][2]) // 16
    cut = lambda v, p: v[p * wide : (p + 1) * wide]
    books = [[cut(v, p) for _, _, v in kept[:64]] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda part, book: min(range(len(book)), key=lambda k: (far(part, book[k]), k))
    for _ in range(2):
        for p, book in enumerate(books):
            mine = [[] for _ in book]
            for _, _, v in kept:
                mine[near(cut(v, p), book)].append(cut(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(mine, book)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, by_label = [], Counter()
    for i, label, v in kept:
        picked = [near(cut(v, p), book) for p, book in enumerate(books)]
        error = sum(far(cut(v, p), books[p][k]) for p, k in enumerate(picked))
        by_label[label] += error
        out.append((i, "".join(f"{k:02x}" for k in picked), error, label))
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, error string, whole long, code string"


def vectors(n: int, seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    centres = [[r.uniform(-2, 2) for _ in range(32)] for _ in range(9)]
    rows = [(i, [float(np.float32(c + r.gauss(0, 0.2))) for c in centres[r.randrange(9)]], None if i % 11 == 5 else i % 3) for i in range(n)]
    return rows + [rows[7], rows[7], (None, rows[3][1], 1), (n, None, 1), (n + 1, [], 1), (n + 2, [None] * 32, 1), (n + 3, [math.nan] * 32, 1), (n + 4, [math.inf] + [0.0] * 31, 2)]


@pytest.mark.parametrize("n", [20, 200])
def test_codes(spark, n):
    rows = vectors(n)
    df = spark.createDataFrame([(i, v, label, "e", 1, "c") for i, v, label in rows], VECTORS).repartition(3)
    got = sorted((tuple(r) for r in codes.compressed(df).collect()), key=str)
    assert got == plain_codes([(i, label, v) for i, v, label in rows])


def test_codes_with_ties_and_edges(spark):
    same = [(i, [0.5] * 16, 0) for i in range(70)]
    df = spark.createDataFrame([(i, v, label, None, None, None) for i, v, label in same], VECTORS)
    assert {(r["code"], r["error"]) for r in codes.compressed(df).collect()} == {("00" * 16, 0)}
    odd = spark.createDataFrame([(1, [1e38] * 16, 0, None, None, None), (2, [1.0] * 17, 0, None, None, None), (3, [-1e38] * 16, None, None, None, None)], VECTORS)
    found = {r["vec_id"]: r for r in codes.compressed(odd).collect()}
    assert set(found) == {1, 3} and all(r["error"] == 0 for r in found.values())
    assert codes.compressed(spark.createDataFrame([(2, [1.0] * 17, 0, None, None, None)], VECTORS)).count() == 0
    empty = codes.compressed(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_partial_distances_equal_full_ones():
    r = np.random.default_rng(5)
    for _ in range(20):
        values, entries = r.integers(-4, 5, (300, 4)), r.integers(-4, 5, (r.integers(1, 65), 4))  # many ties
        far = ((values[:, None] - entries[None]) ** 2).sum(axis=2)
        picked, least = codes.nearest(values, entries)
        assert (picked == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()


def test_codes_stand_for_vectors(spark):
    df = spark.createDataFrame([(i, v, label, "e", 1, "c") for i, v, label in vectors(150)], VECTORS)
    rows = codes.prepared(df)
    books = codes.trained(rows)
    back = codes.decoded(codes.encoded(rows, books), books).join(rows.select("vec_id", "whole").distinct(), "vec_id")
    for r in back.collect():
        assert sum((round(a * 256) - b) ** 2 for a, b in zip(r["approximate"], r["whole"])) == r["error"]
    assert codes.decoded(spark.createDataFrame([("zz",), (None,)], "code string"), books).filter("approximate is not null").count() == 0


# ---- ranked search

def plain_search(docs, items, k=20):
    """(doc_id, text) and (item_id, text) rows, every document scored for every item."""
    terms = lambda t: re.findall(retrieval.TERM_CLASS, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    said = [(i, Counter(terms(t))) for i, t in docs]
    said = [(i, c) for i, c in said if c]
    n_docs, n_terms = len(said), sum(c.total() for _, c in said)
    df = Counter(t for _, c in said for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for i, c in said:
            m = 75 + (25 * c.total() * n_docs) // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            scores += [(-score, i is None, i or 0, i)] if score > 0 else []
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def corpus(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for _ in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    rows = [(i, " ".join(r.choices(words, weights, k=r.choice([5, 30, 200])))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, " ,;- "), (None, rows[0][1]), (None, rows[0][1]), rows[1], rows[1], (n + 3, "ÉCLAIR straße 東京 " + rows[2][1].upper()), (n + 4, rows[3][1] * 900)]


def search_rows(found):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=str)


def test_search(spark, monkeypatch):
    docs, r = corpus(300, 4), random.Random(9)
    items = [(i, " ".join(r.sample(docs[r.randrange(300)][1].split() + docs[r.randrange(300)][1].split(), 6))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "nobodysaysthis"), (53, docs[5][1].split()[0] * 1), (54, "É 東京 straße ÉCLAIR"), (55, " ".join(docs[7][1].split()[:3] * 40)), (None, docs[8][1])]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, term string, row long, score int").repartition(3)
    asked = spark.createDataFrame([(i, t, 0, "y") for i, t in items], "item_id long, text string, q int, doc_id string")
    want = plain_search(docs, items)
    assert len(want) > 200
    assert search_rows(retrieval.searched(df, asked)) == want
    assert search_rows(retrieval.searched(df, asked, k=3)) == plain_search(docs, items, 3)
    monkeypatch.setattr(retrieval, "VOCABULARY_BYTES", 0)  # all terms stay in the vectors
    monkeypatch.setattr(retrieval, "SHARE", 1.0)
    monkeypatch.setattr(retrieval, "SLICE", 64)
    assert search_rows(retrieval.searched(df, asked)) == want


def test_search_items_that_share_an_id_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, f"alpha beta{i}") for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "beta3"), (1, "beta5 alpha")], "item_id long, text string")
    found = search_rows(retrieval.searched(docs, items, k=2))
    assert [(i, rank, d) for i, rank, d, _ in found] == [(1, 1, 3), (1, 1, 5), (1, 2, 0)]
    assert retrieval.searched(docs.limit(0), items).count() == 0 == retrieval.searched(docs, items.limit(0)).count()


def test_terms_are_cut_at_their_ends(monkeypatch):
    monkeypatch.setattr(retrieval, "SLICE", 3)
    fold = retrieval.folded()
    for text in ("", "abc", "abc def", " a  b ", "x" * 9000, "é" * 50 + "--Z9"):
        assert retrieval.counted(text.encode(), fold) == Counter(x.encode() for x in re.findall(retrieval.TERM_CLASS, text.translate({c: c + 32 for c in range(65, 91)})))


# ---- attention over passages

def test_features_are_those_of_each_text_alone():
    texts = [b"", b"  \n", b"One two, two. THREE!!", prose(4, 200).encode(), "é ß | 12\n".encode() * 90, b"\na b"]
    x, counts = attention.features(texts)
    assert counts.tolist() == [1, 1, 1, 4, 6, 1]
    alone = [attention.features([t])[0] for t in texts]
    assert np.allclose(x, np.concatenate(alone), atol=1e-6) and not x[:2].any()
    one = alone[2][0]
    n, kinds = 4, len(attention.KINDS)
    assert np.isclose(one[0], 6 / n) and np.isclose(one[4], 2 / n) and np.isclose(one[5], 1 / n) and np.isclose(one[6], 1 / n)  # capitals, "!", ".", ","
    assert np.isclose(one[kinds + 3], 2 / n) and np.isclose(one[kinds + 4], 1 / n) and np.isclose(one[kinds + 5], 3 / n)  # capitalised, said twice, distinct
    assert np.isclose(one[attention.DENSE :].sum(), 1)


def test_gradients_by_differences():
    r = np.random.default_rng(2)
    model = attention.Model().drawn(1)
    model.layers = {k: v.astype(float) for k, v in model.layers.items()}
    x, counts, y = r.normal(size=(11, attention.ROW)), np.array([1, 4, 6]), np.array([1.0, 0.0, 1.0])
    _, slopes = attention.gradients(model, x, counts, y)
    for k, layer in model.layers.items():
        for at in {tuple(r.integers(0, s) for s in layer.shape) for _ in range(4)}:
            losses = []
            for step in (1e-5, -1e-5):
                layer[at] += step
                losses.append(attention.gradients(model, x, counts, y)[0])
                layer[at] -= step
            assert np.isclose((losses[0] - losses[1]) / 2e-5, slopes[k][at], atol=1e-6)


def test_pieces_are_merged(monkeypatch):
    model = attention.Model().drawn(3)
    text = " ".join(f"w{k % 37}" for k in range(64 * 9)).encode()
    whole = model.scores([text, b"", text[:100]])
    words = text.split()
    bags = [b" ".join(words[k : k + 64 * 3]) for k in range(0, len(words), 64 * 3)]
    monkeypatch.setattr(attention, "cut", lambda t, size: iter(bags) if t == text else iter([t]))
    monkeypatch.setattr(attention, "SLICE", 10)
    assert np.allclose(model.scores([text, b"", text[:100]]), whole, atol=1e-6)
    monkeypatch.undo()
    assert b"".join(attention.cut(text, 50)) == text and all(p.endswith(b" ") for p in list(attention.cut(text, 50))[:-1])


def test_quality_held_out(spark, empty):
    rows = [(i, (prose(i, 90) if i % 3 else " | ".join(prose(i, 90).split()) if i % 2 else prose(i, 12) + "\nGO GO!! " * 40), "score") for i in range(300)]
    rows += [(900, None, ""), (901, "", ""), (902, " \n ", ""), (903, prose(5, 40_000), ""), (903, prose(5, 40_000), ""), (None, prose(6, 50), ""), (904, "x" * 3_000_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(1, 0, 1), (None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = attention.fitted(df, labels.filter("doc_id < 220 or doc_id is null"))
    found = attention.scored(df, model).collect()
    out = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    assert np.mean([out[i]["predicted"] == int(i % 3 > 0) for i in range(220, 300)]) >= 0.95
    assert out[900]["score"] == out[901]["score"] == out[902]["score"]
    again = attention.fitted(df.repartition(5), labels.filter("doc_id < 220 or doc_id is null"))
    assert all((again.layers[k] == v).all() for k, v in model.layers.items())
    assert attention.scored(empty, model).count() == 0
    one_kind = attention.fitted(df, labels.filter("quality = 1"))
    assert {r["predicted"] for r in attention.scored(df, one_kind).collect()} == {1}
    assert {r["score"] for r in attention.scored(df, attention.fitted(df, labels.limit(0))).collect()} == {0.5}
