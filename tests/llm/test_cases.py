"""Each query's operator on rows with null and shared ids, repeated rows, very long texts and columns whose names clash."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import attention, chat, common, decontamination, licenses, lines, mixing, neardup, quality, retrieval, substrings, tokens, toxicity
from tests.llm.conftest import prose

LONG = prose(9, 30_000)
ROWS = [(1, prose(1, 90), "s"), (1, prose(2, 90), "s"), (None, prose(3, 90), None), (None, prose(3, 90), None), (4, None, "s"), (5, "", "t"), (6, LONG, "t"), (6, LONG, "t"), (7, prose(1, 90), "t")]
ITEMS = [(1, " ".join(prose(1, 90).split()[10:40])), (None, "x y z")]
#: Names that operators use inside.
CLASHING = ("row", "size", "score", "words", "term", "own", "d", "doc", "body", "text of", "n", "place", "shard", "kept", "spans", "bucket", "hash", "source_size", "label", "seed")


def digest(df):
    return Counter(tuple(str(v) for v in r) for r in df.collect())


def toxic_model():
    return toxicity.Model({"vilex": 3.0}, [0.1] * (len(toxicity.FEATURES) + 1))


OPERATORS = {
    "op1": (substrings.deduplicated, True),
    "op2": (lambda df: quality.judged(df.select("doc_id", "text"), to="verdict").select("doc_id", "verdict"), True),
    "op3": (licenses.scanned, True),
    "op5": (lines.repeated_lines, False),
    "op6": (neardup.near_duplicates, True),
    "op7": (lambda df: toxicity.scored(df, toxic_model()), True),
    "op8": (lambda df: decontamination.leaked(df, df.sparkSession.createDataFrame(ITEMS, "item_id long, text string")), False),
    "op9": (lambda df: tokens.tokenized(df, length=64), True),
    "op10": (lambda df: mixing.mix(df, block=16), True),
    "op11": (lambda df: attention.scored(df, attention.Model().drawn(2)), True),
    "op12": (lambda df: retrieval.searched(df, df.sparkSession.createDataFrame(ITEMS, "item_id long, text string"), k=3), False),
}
#: These say that rows equal in doc_id and text are one document.
ONE_EACH = ("op1",)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_rows_of_all_kinds(spark, name):
    apply, per_row = OPERATORS[name]
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    plain = digest(apply(df))
    extra = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)]).repartition(3)
    assert digest(apply(extra)) == plain
    if per_row:
        want = Counter(str(r[0]) for r in (dict.fromkeys(ROWS) if name in ONE_EACH else ROWS))
        rows = apply(df).collect()
        assert Counter(str(r["doc_id"]) for r in rows) == want
    assert apply(df.limit(0)).count() == 0


def test_tables_end_with_their_scope(spark):
    """What operators write goes at the end of a scope, results that are kept aside."""
    folder = common.scratch(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    with common.scope() as keep:
        mixed = keep(common.saved(mixing.mix(df, block=16), "mixed"))
        with common.scope():
            assert neardup.near_duplicates(df).count() == len(ROWS)
        assert substrings.deduplicated(df).count() > 0
    left = set(os.listdir(folder)) - before
    assert mixed.count() == len(ROWS) and len(left) == 1 and next(iter(left)).startswith("mixed")
    common.dropped(mixed)
    assert set(os.listdir(folder)) == before


def test_conversations_of_all_kinds(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", None), (None, 0, "user", "x"), (None, 0, "user", "x"), (2, None, None, "<|im_end|>"), (3, 0, "assistant", "y"), (3, 0, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.formatted(df)
    extra = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING) if c != "text"]).repartition(3)
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert digest(chat.digests(chat.formatted(extra)).select(*columns)) == digest(chat.digests(done).select(*columns))
