"""Operator 3, license scans: diagonal voting on word k-grams (native Spark).

Every rolling hash of GRAM consecutive words of a document (of two, for the base
phrases) is joined with the hashes of the templates' grams.  A match at word p of
the document and word t of the template votes for the diagonal p - t.  Votes are
summed by document, template and diagonal; diagonals at most GAP apart (words put
in or left out) merge.  A merged span is then verified: its grams stand in the
template's order, they cover at least COVERAGE of its words and of the template's,
and all grams of the template's key phrases are
there, which tell kindred licences and versions apart.  A base phrase counts only
where all its pairs stand on one diagonal.  Words are compared too, so a hash never
decides alone.

The join's small side is the template table, of a fixed size; only votes and one
row a document are shuffled, by document.

Cases: a null or empty text has no words, no labels and score 0; repeated rows
give one result each; overlapping places all count; null ids stand for themselves;
a very long text is read word by word, and only its votes are gathered; ties do not
arise, as every span that passes counts; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, table

GRAM = 4
COVERAGE = 0.75
GAP = 4
#: Phrase, label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Wording of public licence notices, label, and key phrases of GRAM words or more.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0", ("license version 2 0",)),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0", ("license version 2 0",)),
    ("released under the mit license", "mit", ("under the mit license",)),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", ("permission is hereby granted free of charge",)),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished"
        " to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "mit",
        ("publish distribute sublicense and or sell",),
    ),
    ("licensed under the gnu general public license version 3", "gpl-3.0", ("public license version 3",)),
    ("licensed under the gnu general public license version 2", "gpl-2.0", ("public license version 2",)),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
        "gpl-3.0",
        ("gnu general public license", "version 3 of the license"),
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
        "gpl-2.0",
        ("gnu general public license", "version 2 of the license"),
    ),
    ("gnu lesser general public license", "lgpl", ("gnu lesser general public license",)),
    ("gnu affero general public license", "agpl", ("gnu affero general public license",)),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0", ("mozilla public license v 2 0",)),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ("in source and binary forms",)),
    (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright"
        " notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd",
        ("redistributions in binary form must reproduce",),
    ),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", ("and or distribute this software",)),
    ("licensed under cc by nc 4 0", "cc-by-nc", ("cc by nc 4 0",)),
    ("licensed under cc by sa 4 0", "cc-by-sa", ("cc by sa 4 0",)),
    ("licensed under cc by nd 4 0", "cc-by-nd", ("cc by nd 4 0",)),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0", ("commons attribution 4 0",)),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa", ("commons attribution sharealike 4 0",)),
    ("this is free and unencumbered software released into the public domain", "unlicense", ("free and unencumbered software",)),
    ("this work is dedicated to the public domain", "public-domain", ("dedicated to the public domain",)),
)


def lowered(text: Column) -> Column:
    """A-Z lower-cased.  lower() also maps other letters, which no ASCII phrase holds, and two of them onto ASCII; those two go first."""
    kelvin, dotted = F.lit("\u212a"), F.lit("\u0130")
    return F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), kelvin, F.lit("\u00e9")), dotted, F.lit("\u00e9")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def template_grams(base=BASE, templates=TEMPLATES) -> list[tuple]:
    """A row a gram: template, label, is_base, t (its place), words of the template, k, must (of a key phrase), musts (such grams in all), tie (equal grams before it), its words."""
    out, seen = [], {}
    for i, (phrase, label, *keys) in enumerate((*base, *templates)):
        w, k = phrase.split(), 2 if i < len(base) else GRAM
        grams = [tuple(w[t : t + k]) for t in range(len(w) - k + 1)]
        key = {tuple(own[t : t + k]) for x in (keys[0] if keys else (phrase,)) for own in [x.split()] for t in range(len(own) - k + 1)}
        for t, g in enumerate(grams):
            tie = seen[g] = seen.get(g, -1) + 1
            out.append((i, label, i < len(base), t, len(w), k, g in key, sum(x in key for x in grams), tie, *g, *[""] * (GRAM - k)))
    return out


_GRAM_DDL = "template int, label string, is_base boolean, t int, words int, k int, must boolean, musts int, tie int, " + ", ".join(f"t{j} string" for j in range(GRAM))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """doc (the id), n_words, n_base, first_word, last_word, base_labels, labels, score, and spans of the labels found."""
    of_gram = lambda *w: F.xxhash64(*w)
    grams = rows_of(docs.sparkSession, template_grams(base, templates), _GRAM_DDL)
    grams = grams.withColumn("gram", F.when(F.col("k") == 2, of_gram("t0", "t1")).otherwise(of_gram(*(f"t{j}" for j in range(GRAM)))))
    text = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("of"), words(F.col(text_col)).alias("w"))
    # The outer form: else the optimizer would put a filter on the words below, and find them twice.
    placed = text.select("doc", "of", "w", F.posexplode_outer("w").alias("p", "w0"))
    following = [F.get(F.col("w"), F.col("p") + j).alias(f"w{j}") for j in range(1, GRAM)]
    worded = placed.select("doc", "of", F.size("w").alias("n_words"), "p", "w0", *following)
    both = F.array(F.struct(F.lit(2).alias("n"), of_gram("w0", "w1").alias("h")), F.struct(F.lit(GRAM).alias("n"), of_gram(*(f"w{j}" for j in range(GRAM))).alias("h")))
    rolled = worded.select("*", F.explode(both).alias("g"))
    same = (F.col("g.n") == F.col("k")) & (F.col("g.h") == F.col("gram")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1"))
    for j in range(2, GRAM):
        same = same & ((F.col("k") == 2) | (F.col(f"w{j}") == F.col(f"t{j}")))
    met = rolled.join(F.broadcast(grams), same, "left")
    # A document's first word stands for the row itself, once, whatever it matches.
    opening = (F.coalesce(F.col("p"), F.lit(0)) == 0) & (F.col("g.n") == 2) & (F.coalesce("tie", F.lit(0)) == 0)
    hit = F.col("template").isNotNull()
    votes = met.where(hit | opening).select("doc", "of", "n_words", "template", "label", "is_base", "words", "musts", "k", F.when(hit, F.col("p")).alias("p"), "t", "must", opening.cast("long").alias("row"))
    key, of = ["doc", "of"], ["template", "label", "is_base", "words", "musts"]
    # Equal rows vote alike and count once each.
    votes = votes.repartition(*key).groupBy(*key, *of, "k", "p", "t", "must").agg(F.sum("row").alias("rows"), F.max("n_words").alias("n_words"))
    votes = votes.withColumn("diagonal", F.col("p") - F.col("t"))
    along = Window.partitionBy(*key, "template").orderBy("diagonal", "p")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.when(F.col("is_base"), 0).otherwise(GAP), F.lit(True))
    votes = votes.withColumn("group", F.sum(apart.cast("int")).over(along))
    inside = Window.partitionBy(*key, "template", "group").orderBy("p", "t")
    votes = votes.withColumn("back", F.coalesce(F.col("t") <= F.lag("t").over(inside), F.lit(False)))
    spans = votes.groupBy(*key, *of, "group").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("t"), F.col("t") + F.col("k") - 1))))).alias("covered"),
        F.size(F.collect_set(F.when(F.col("must"), F.col("t")))).alias("held"),
        F.max("back").alias("back"),
        F.min("p").alias("start"),
        F.max(F.col("p") + F.col("k")).alias("end"),
        F.sum("rows").alias("rows"),
        F.max("n_words").alias("n_words"),
    )
    share = F.col("covered") / F.greatest("words", F.col("end") - F.col("start"))
    whole = F.col("is_base") & (share == 1)
    found = whole | (~F.col("is_base") & (share >= COVERAGE) & ~F.col("back") & (F.col("held") == F.col("musts")))
    out = spans.groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(whole).alias("n_base"),
        F.min(F.when(whole, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(whole, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(found, share)), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_set(F.when(found, F.struct("start", "end", "label")))).alias("spans"),
        F.sum("rows").alias("rows"),
    )
    # One result for each of equal rows.
    return out.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))).drop("of", "rows", "again")


def query(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


_GRAMS = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in row) + ")" for row in template_grams())
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(template, label, is_base, t, words, k, must, musts, tie, t0, t1, t2, t3) AS (VALUES {_GRAMS}),
g AS (SELECT doc_id, i - 1 AS p, w[i] AS w0, w[i + 1] AS w1, w[i + 2] AS w2, w[i + 3] AS w3 FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
v AS (SELECT DISTINCT doc_id, template, label, is_base, words, k, must, musts, p, t, p - t AS diagonal FROM g JOIN t ON w0 = t0 AND w1 = t1 AND (k = 2 OR (w2 = t2 AND w3 = t3))),
l AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= CASE WHEN is_base THEN 0 ELSE {GAP} END THEN 0 ELSE 1 END AS new FROM v WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal, p)),
c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal, p) AS grp FROM l),
b AS (SELECT *, coalesce(t <= lag(t) OVER (PARTITION BY doc_id, template, grp ORDER BY p, t), false) AS back FROM c),
s AS (SELECT doc_id, template, label, is_base, musts, min(p) AS start, len(list_distinct(flatten(list(range(t, t + k)))))::DOUBLE / greatest(words, max(p + k) - min(p)) AS share,
  count(DISTINCT t) FILTER (WHERE must) AS held, bool_or(back) AS back FROM b GROUP BY doc_id, template, label, is_base, words, musts, grp),
f AS (SELECT *, is_base AND share = 1 AS whole, CASE WHEN is_base THEN share = 1 ELSE share >= {COVERAGE} AND NOT back AND held = musts END AS found FROM s),
r AS (SELECT doc_id, count(*) FILTER (WHERE whole) AS n_base, min(start) FILTER (WHERE whole) AS first_word, max(start) FILTER (WHERE whole) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE whole) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found) AS labels, max(share) FILTER (WHERE found) AS score FROM f GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN r USING (doc_id)
"""
