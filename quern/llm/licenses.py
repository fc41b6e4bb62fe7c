"""License scans by diagonal voting.

All rolling word k-gram hashes of a text are joined to the positions at which templates have them. A hit at word p of
the text and position t of a template votes for the diagonal p - t; where a text says a template, all its k-grams
vote for one diagonal, or, with words put in or left out, for neighbouring ones, which are merged. A merged group is
verified: enough of the template's positions are matched, and the matched words lie in a span not much longer than
the template.

The templates are fixed values in this module, a few hundred rows whatever the input: that bound is why their side of
the join is broadcast. The texts are read once; what leaves that stage is one row per document and one per hit. All
later groups are keyed by document, so that a license that a third of all documents carry makes no hot key.

Defined cases: a null text counts as an empty one; texts are scanned whole; rows with an equal doc_id are judged by
their own texts, and repeated rows get equal results; a null doc_id is kept; other columns are left
aside, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, saved, table

GAP_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
#: Diagonals at most so far apart are one group.
SLACK = 2
#: Share of a template's k-grams that a group must match, and length of its span in template lengths.
COVER, STRETCH = 0.8, 1.5


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    #: A base phrase counts where its words stand consecutively, only.
    base: bool = False


#: Base phrases, then notices and statements of public licenses.
TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("gpl-2", "licensed under the gnu general public license version 2"),
    Template("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    Template("lgpl", "under the terms of the gnu lesser general public license"),
    Template("agpl-3", "under the terms of the gnu affero general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    Template("cc-by", "creative commons attribution 4 0 international license"),
    Template("cc0", "creative commons cc0 1 0 universal public domain dedication"),
)


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP_CLASS), "")


def gram_hashes(ids: Column, k: int = K) -> Column:
    grams = F.transform(F.sequence(F.lit(0), F.size(ids) - k), lambda i: F.xxhash64(*[F.get(ids, i + j) for j in range(k)]))
    return F.when(F.size(ids) >= k, grams).otherwise(F.array().cast("array<bigint>"))


def positions(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """gram, template, label, base, t (position), n (the template's k-grams): as many rows as the templates have words."""
    rows = [(i, t.label, t.base, t.words.split(" ")) for i, t in enumerate(templates)]
    given = spark.createDataFrame(rows, "template int, label string, base boolean, w array<string>")
    ids = given.withColumn("ids", F.transform("w", lambda x: F.xxhash64(x)))
    grams = ids.withColumn("grams", gram_hashes(F.col("ids")))
    return grams.select("template", "label", "base", F.size("grams").alias("n"), F.posexplode("grams").alias("t", "gram"))


def voted(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """One pass over the texts: for each document one row without a template, and a row for each hit."""
    keyed = docs.select(
        "doc_id", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("key"), words(F.col(f"`{text}`")).alias("w")
    )
    hashed = keyed.select("doc_id", "key", F.size("w").alias("n_words"), F.transform("w", lambda x: F.xxhash64(x)).alias("ids"))
    # a null before the first k-gram joins nothing and stands for the document
    grams = F.concat(F.array(F.lit(None).cast("bigint")), gram_hashes(F.col("ids")))
    rolled = hashed.select("doc_id", "key", "n_words", F.posexplode(grams).alias("p", "gram")).withColumn("p", F.col("p") - 1)
    hits = rolled.join(F.broadcast(positions(docs.sparkSession, templates)), "gram", "left")
    return hits.filter((F.col("p") < 0) | F.col("template").isNotNull()).drop("gram")


def spans(hits: DataFrame) -> DataFrame:
    """Verified groups: doc_id, key, label, base, first, last (words, from 0), cover (share of the template matched)."""
    votes = (
        hits.select("doc_id", "key", "template", "label", "base", "n", "p", "t").distinct()
        .withColumn("diagonal", F.col("p") - F.col("t"))
    )
    each = W.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(each)
    opens = F.when(F.col("base"), apart > 0).otherwise(apart > SLACK)
    grouped = votes.withColumn("opens", F.coalesce(opens, F.lit(True)).cast("int")).withColumn("group", F.sum("opens").over(each))
    merged = grouped.groupBy("doc_id", "key", "template", "label", "base", "n", "group").agg(
        F.count_distinct("t").alias("matched"), F.min("p").alias("first"), (F.max("p") + K - 1).alias("last")
    )
    whole = F.col("matched") == F.col("n")
    near = (F.col("matched") >= COVER * F.col("n")) & (F.col("last") - F.col("first") < STRETCH * (F.col("n") + K - 1))
    sound = merged.filter(F.when(F.col("base"), whole).otherwise(near)).select(
        "doc_id", "key", "label", "base", "first", "last", (F.col("matched") / F.col("n")).alias("cover")
    )
    # of templates that begin at about the same word, say two versions of a license, the best stay
    rivals = W.partitionBy("doc_id", "key", "base").orderBy("first").rangeBetween(-SLACK, SLACK)
    return sound.withColumn("best", F.max("cover").over(rivals)).filter(F.col("base") | (F.col("cover") == F.col("best"))).drop("best")


def scanned(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (best cover, 0 without labels)."""
    rows = saved(voted(docs, templates, text), "license-hits")
    base = F.col("base")
    found = spans(rows.filter("template is not null")).groupBy("doc_id", "key").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    heads = rows.filter("p < 0").select("doc_id", "key", F.col("n_words").cast("long").alias("n_words"))
    same = heads["doc_id"].eqNullSafe(found["doc_id"]) & (heads["key"] == found["key"])
    return heads.join(found, same, "left").select(
        heads["doc_id"], "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
