"""The stages on the smallest tables, and against what the operators say."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import common, decontamination, neardup, quality
from quern.llm.queries import oracle_sql, queries
from tests.llm.conftest import prose

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, DATA, "documents")
    at = {}
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        at[name] = common.saved(stage(spark, rows, DATA), name)
        if name != "token_output":
            assert at[name].columns == docs.columns
        rows = at[name]
    ids = {k: sorted(r["doc_id"] for r in v.select("doc_id").collect()) for k, v in at.items()}
    q = quality.judged(docs, to="q").filter("q.kept").select("doc_id").collect()
    assert ids["quality_rules"] == sorted(r[0] for r in q)
    kept = neardup.near_duplicates(at["quality_rules"]).filter("kept").select("doc_id").collect()
    assert ids["near_dedup"] == sorted(r[0] for r in kept)
    leaks = {r[0] for r in decontamination.leaked(at["near_dedup"], common.table(spark, DATA, "benchmark")).select("doc_id").collect()}
    assert ids["decontamination"] == [i for i in ids["near_dedup"] if i not in leaks]
    assert set(ids["mixing"]) <= set(ids["decontamination"]) and ids["token_output"] == ids["mixing"]


def test_rows_without_an_id_of_their_own_stay(spark):
    """Null and reused ids: clean and different texts pass near-dedup and mixing, near copies go."""
    one, two, three, four = (prose(i, 80) for i in range(20, 24))
    rows = [(None, one), (None, two), (5, three), (5, four), (6, one), (5, three)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, df, DATA)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(6, one), (0, two), (5, three), (5, four)])
    mixed = {r["text"] for r in corpus_pipeline.mix_sources(spark, kept, DATA).collect()}
    assert all(any(t and t in whole for t in mixed) for whole in (one, two, three, four))


def test_stages_on_odd_rows(spark, docs):
    """Nulls in every column, repeated rows, a column of maps, and columns with the names that operators use themselves."""
    names = ("d", "own", "runs", "passes", "shared id", "quality of", "said", "leaking id", "row", "rank")
    odd = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)], F.create_map(F.lit("k"), F.col("lang")).alias("m"))
    nulls = odd.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in odd.schema])
    odd = odd.unionByName(nulls).unionByName(nulls).unionByName(odd.filter("doc_id = 13").withColumn("doc_id", F.lit(None).cast("long")))
    for rows in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, DATA)
            if name != "token_output":
                assert out.columns == odd.columns
            assert (out.count() == 0) == rows.isEmpty()
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, odd, DATA).collect()}
    assert {0, 1, 2, 3, 4, 12, 13} <= kept and 5 not in kept


def test_registered():
    names = queries()
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
    assert set(oracle_sql()) <= set(names)


def plain(v):
    missing = v is None or str(v) in ("nan", "<NA>")
    return None if missing else round(float(v), 9) if hasattr(v, "__float__") and not isinstance(v, str) else v


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found, want = queries()[name](spark, DATA).toPandas(), con.sql(oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    rows = [sorted(([plain(v) for v in r] for r in df[sorted(found.columns)].astype(object).itertuples(index=False)), key=str) for df in (found, want)]
    assert rows[0] == rows[1]
