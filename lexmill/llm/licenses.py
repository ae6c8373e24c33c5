"""License scan by diagonal voting, in DataFrame functions only.

Every run of adjacent words of every text is hashed (two words for the short phrases, four for the notices) and joined
against the fixed template positions. A match votes for the diagonal (text position less template position) of its
template; votes are sets of template positions, so tasks pre-aggregate them and repeated rows can't count twice. A
diagonal takes in the neighbours that lie a few words beyond, which inserted or lost words part, and is accepted if the
words of all these votes cover enough of the template; accepted diagonals that lie as near are one span. Short phrases
are accepted only whole, on one diagonal: the places where their words stand consecutively. Spans are then compared with
the words of the text itself.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

# Phrases that are looked for word by word, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Sentences that the licenses ask to be kept, and their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
)
#: Words of a phrase's and of a notice's grams; how far a diagonal reaches to its neighbours; the share of a notice's words
#: that accepts it.
GRAMS = {True: 2, False: 4}
DRIFT, COVER = 4, 0.8
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The runs of digits, ASCII letters and characters beyond ASCII, with A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), PARTS), "")


def _pairs(hashes: Column, step: int) -> Column:
    """Each hash of an array with the one step places on; the last step entries stand for nothing."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def templates(phrases=PHRASES, notices=NOTICES) -> list[tuple[int, str, bool, int, list[str], int]]:
    """(template, label, whole, position, gram, words of the template)."""
    out = []
    for t, (text, label, whole) in enumerate([(*p, True) for p in phrases] + [(*n, False) for n in notices]):
        w, n = text.split(), GRAMS[whole]
        if len(w) < n:
            raise ValueError(f"a template needs {n} words: {text}")
        out += [(t, label, whole, i, w[i : i + n], len(w)) for i in range(len(w) - n + 1)]
    return out


def _spans(docs: DataFrame, phrases, notices) -> DataFrame:
    """(id, th, spans: array of (template, label, whole, first, last, cover)) by hashes alone. docs: id, th, text."""
    table = docs.sparkSession.createDataFrame(templates(phrases, notices), "template int, label string, whole boolean, tpos int, gram array<string>, size int")
    hashes = F.transform("gram", lambda x: F.xxhash64(x))
    table = table.withColumn("h", F.when(F.col("whole"), F.get(_pairs(hashes, 1), F.lit(0))).otherwise(F.get(_pairs(_pairs(hashes, 1), 2), F.lit(0))))
    w = docs.where(F.length("text") > 0).select("id", "th", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w")).where(F.size("w") > 1)
    two = w.select("id", "th", F.size("w").alias("n"), _pairs(F.col("w"), 1).alias("two"))
    grams = two.select("id", "th", "n", F.posexplode(F.concat("two", _pairs(F.col("two"), 2))).alias("at", "gh"))
    met = grams.join(F.broadcast(table.select("template", "whole", "tpos", "h")), (F.col("gh") == F.col("h")) & ((F.col("at") < F.col("n")) == F.col("whole")))
    votes = met.groupBy("id", "th", "template", (F.col("at") % F.col("n") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("seen"))
    info = table.select("template", "label", "whole", "size").distinct()
    votes = votes.join(F.broadcast(info), "template").where(~F.col("whole") | (F.size("seen") == F.col("size") - 1))
    own = Window.partitionBy("id", "th", "template").orderBy("diagonal")
    reach = own.rangeBetween(0, DRIFT)
    near = F.flatten(F.transform(F.flatten(F.collect_list("seen").over(reach)), lambda t: F.sequence(t, t + (GRAMS[False] - 1))))
    votes = votes.withColumns({"cover": F.when(F.col("whole"), F.lit(1.0)).otherwise(F.size(F.array_distinct(near)) / F.col("size")),
                               "top": F.when(F.col("whole"), F.col("diagonal")).otherwise(F.max("diagonal").over(reach))}).where(F.col("cover") >= COVER)
    gap = F.col("diagonal") - F.lag("diagonal").over(own)
    votes = votes.withColumn("cut", F.when(F.col("whole") | gap.isNull() | (gap > DRIFT), 1).otherwise(0))
    votes = votes.withColumn("span", F.sum("cut").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = votes.groupBy("id", "th", "template", "label", "whole", "size", "span").agg(F.min("diagonal").alias("first"), F.max("top").alias("top"), F.max("cover").alias("cover"))
    span = F.struct("template", "label", "whole", F.col("first").cast("long").alias("first"), (F.col("top") + F.col("size") - 1).cast("long").alias("last"), "cover")
    return spans.groupBy("id", "th").agg(F.collect_list(span).alias("spans"))


def _checked(docs: DataFrame, phrases, notices, how: str) -> DataFrame:
    """(id, th, n_words, spans): a row of docs each, with the spans that the words of the text bear out."""
    docs = docs.withColumn("th", F.xxhash64("text"))
    spans = cut(_spans(docs, phrases, notices).select(F.col("id").alias("fid"), F.col("th").alias("fth"), "spans"))
    # a span takes some 64 bytes
    spans = small(spans, weight=F.size("spans"), width=64)
    both = docs.join(spans, F.col("id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth")), how).select("id", "th", "spans", words(F.col("text")).alias("w"))
    text = F.from_json(F.lit(json.dumps([t.split() for t, _ in (*phrases, *notices)])), "array<array<string>>")

    def right(s: Column) -> Column:
        own, said = F.get(text, s["template"]), F.slice("w", F.greatest(s["first"], F.lit(0)).cast("int") + 1, (s["last"] - F.greatest(s["first"], F.lit(0)) + 1).cast("int"))
        return F.when(s["whole"], own == said).otherwise(F.size(F.array_intersect(own, said)) >= COVER * F.size(F.array_distinct(own)))

    return both.select("id", "th", F.size("w").cast("long").alias("n_words"), F.filter(F.coalesce("spans", F.array()), right).alias("spans"))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(id, th, template, label, whole, first, last, cover): the accepted spans, by the first and last word (from 0).

    th is a hash of the text, which keeps rows apart that share an id but not their text; equal rows have their spans
    once. A null text is empty. Templates may be of any length from two words (phrases) or four (notices).
    """
    found = _checked(_named(docs, id_col, text_col), phrases, notices, "inner").dropDuplicates(["id", "th"])
    return found.select("id", "th", F.inline("spans"))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score), one for each row of docs.

    n_base counts the places of the fixed phrases, first_word and last_word are their least and greatest start (null
    without any). labels adds those of notices; score is the best accepted cover, 0 without any. Null and empty texts
    have no words; null ids keep their row; equal rows give equal rows; other columns aren't read; no rows: no rows.
    """
    rows = _checked(_named(docs, id_col, text_col), phrases, notices, "left")
    rows = rows.withColumn("base", F.filter("spans", lambda s: s["whole"]))
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s["label"]))), ",")
    starts = F.transform("base", lambda s: s["first"])
    return rows.select(F.col("id").alias(id_col), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                       join("base").alias("base_labels"), join("spans").alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"))


def op3(docs: DataFrame) -> DataFrame:
    return license_report(docs)


def _oracle() -> str:
    rows = ", ".join(f"({t}, '{label}', {str(whole).lower()}, {i}, '{' '.join(gram)}', {n})" for t, label, whole, i, gram, n in templates())
    full = ", ".join(f"({t}, '{text}')" for t, (text, _) in enumerate((*PHRASES, *NOTICES)))
    lower = reduce(lambda s, c: f"replace({s}, '{c}', '{c.lower()}')", UPPER, "coalesce(text, '')")
    return rf"""
WITH tpl(template, label, whole, tpos, gram, size) AS (VALUES {rows}),
full_text(template, said) AS (VALUES {full}),
w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS pos FROM w),
next AS (SELECT doc_id, pos, a || ' ' || lead(a) OVER o AS two, a || ' ' || lead(a) OVER o || ' ' || lead(a, 2) OVER o || ' ' || lead(a, 3) OVER o AS four FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
vote AS (
  SELECT doc_id, template, label, whole, size, pos - tpos AS diagonal, list(DISTINCT tpos) AS seen
  FROM next JOIN tpl ON gram = CASE WHEN whole THEN two ELSE four END GROUP BY ALL),
good AS (SELECT * FROM vote WHERE NOT whole OR len(seen) = size - 1),
near AS (
  SELECT *, flatten(list(seen) OVER r) AS seen_near, max(diagonal) OVER r AS top_near FROM good
  WINDOW r AS (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {DRIFT} FOLLOWING)),
covered AS (
  SELECT *, CASE WHEN whole THEN diagonal ELSE top_near END AS top,
    CASE WHEN whole THEN 1.0::DOUBLE ELSE len(list_distinct(flatten(list_transform(seen_near, lambda t: range(t, t + {GRAMS[False]}))))) / size END AS cover FROM near),
step AS (
  SELECT *, CASE WHEN whole OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {DRIFT}, true) THEN 1 ELSE 0 END AS cut FROM covered WHERE cover >= {COVER}),
span AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM step),
merged AS (
  SELECT doc_id, template, label, whole, min(diagonal) AS first, max(top) + size - 1 AS last, max(cover) AS cover
  FROM span GROUP BY doc_id, template, label, whole, size, span),
borne AS (
  SELECT m.* FROM merged m JOIN full_text USING (template) JOIN w USING (doc_id)
  WHERE whole OR len(list_intersect(string_split(said, ' '), w.w[greatest(first, 0) + 1 : last + 1])) >= {COVER} * len(list_distinct(string_split(said, ' ')))),
found AS (
  SELECT doc_id, count(*) FILTER (whole) AS n_base, min(first) FILTER (whole) AS first_word, max(first) FILTER (whole) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
  FROM borne GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(f.n_base, 0) AS n_base, f.first_word, f.last_word,
  coalesce(f.base_labels, '') AS base_labels, coalesce(f.labels, '') AS labels, coalesce(f.score, 0.0) AS score
FROM w LEFT JOIN found f ON w.doc_id = f.doc_id
"""


ORACLE = _oracle()
