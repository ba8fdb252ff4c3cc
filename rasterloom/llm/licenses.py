"""License scans by diagonal voting, in DataFrame functions only.

Every run of k words of a text (and of fewer, for templates that are shorter) is hashed and joined to the same runs of
the templates; each match votes for its diagonal, the word position in the text less that in the template. A phrase is
found where one diagonal has all of its runs. A longer template is found where neighbouring diagonals with two votes or
more, merged (words put in or left out shift the diagonal), together hold `share` of its runs in a span no longer than
`stretch` times it. Spans are verified on the words themselves, for which only their documents are read again: a phrase
must stand there word for word, and `share` of a template's runs must be among the span's. A text's words are never
copied along with its runs, so the cost is in proportion to the words.

Defined cases: null and empty text have no words and no labels; labels are "" if there are none, first_word and
last_word null, score 0; rows equal in id and text are counted once and returned as often as they came; a null id is
an ordinary value; texts are taken whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, few_rows, saved

#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: More template words than this are joined without a broadcast.
BROADCAST_WORDS = 100_000

# The base phrases with their labels, then longer templates: notices and the texts of short licenses.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
        "isc",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl",
    ),
]


def template_runs(phrases: list[tuple[str, str]], templates: list[tuple[str, str]], k: int) -> list[tuple]:
    """(template, label, base, runs, words of a run, place, the run) for each run of k words, or of all if fewer."""
    out = []
    for t, (text, label) in enumerate([*phrases, *templates]):
        words = [w for w in re.split(GAP, text.lower()) if w]
        size = min(k, len(words))
        runs = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
        out += [(t, label, t < len(phrases), len(runs), size, i, run) for i, run in enumerate(runs)]
    return out


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (the text's hash), words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text, F.length(text)).alias("th"), F.array_remove(F.split(ascii_lower(text), GAP), "").alias("words"))


def _runs(size: int) -> Column:
    """array<struct<at, h>> of the column `words`: place and hash of each run of that many words."""
    run = lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(size), *[F.get("words", i + j) for j in range(size)]).alias("h"))
    return F.when(F.size("words") >= size, F.transform(F.sequence(F.lit(0), F.size("words") - size), run)).otherwise(F.array().cast("array<struct<at:int,h:bigint>>"))


def _verified(found: DataFrame, docs: DataFrame, known: DataFrame, share: float, id_col: str, text_col: str) -> DataFrame:
    """Of found(id, th, template, size, base, low, high, ...) the spans whose words hold the template's runs."""
    places = few_rows(saved(found.select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct(), "license-documents"))
    texts = _words(docs, id_col, text_col).join(places, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left_semi").dropDuplicates(["id", "th"])
    runs = known.groupBy("template").agg(F.sort_array(F.collect_list(F.struct("place", "run"))).alias("runs")).select("template", F.expr("transform(runs, x -> x.run)").alias("runs"))
    spans = found.join(runs, "template")
    # the spans of a document travel to its words, which are there once
    by_text = spans.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list(F.struct(*found.columns, "runs")).alias("spans"))
    met = by_text.join(texts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    own = "transform(sequence(s.low, s.high - s.size), i -> array_join(slice(words, i + 1, s.size), ' '))"
    alike = f"if(s.base, s.runs = {own}, size(array_intersect(s.runs, {own})) >= {share} * size(array_distinct(s.runs)))"
    return met.select(F.explode(F.expr(f"filter(spans, s -> {alike})")).alias("s")).select(*[f"s.{c}" for c in found.columns])


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, k: int = 3, share: float = 0.6, stretch: float = 1.5, gap: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    rows = template_runs(phrases, templates, k)
    sizes = sorted({r[4] for r in rows})
    known = spark.createDataFrame(rows, "template int, label string, base boolean, runs int, size int, place int, run string")
    split = F.split("run", " ")
    by_size = F.coalesce(*[F.when(F.col("size") == n, F.xxhash64(F.lit(n), *[F.get(split, F.lit(j)) for j in range(n)])) for n in sizes])
    hashed = known.withColumn("h", by_size).drop("run")
    hashed = F.broadcast(hashed) if len(rows) <= BROADCAST_WORDS else hashed

    words = _words(docs, id_col, text_col).withColumn("n_words", F.size("words"))
    # a place of its own stands for the text, so that one without a match keeps its row
    itself = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("long").alias("h")))
    runs = words.select("id", "th", "n_words", F.explode(F.concat(itself, *[_runs(n) for n in sizes])).alias("x")).select("id", "th", "n_words", "x.*")
    own = F.col("at") < 0
    met = runs.join(hashed, "h", "left").where(own | F.col("template").isNotNull())
    met = met.select("id", "th", own.alias("own"), "n_words", *[F.when(~own, F.col(c)).alias(c) for c in ("template", "label", "base", "runs", "size", "place")], F.when(~own, F.col("at") - F.col("place")).alias("diagonal"))
    votes = met.groupBy("id", "th", "own", "template", "label", "base", "runs", "size", "diagonal").agg(F.count("*").alias("votes"), F.max("n_words").alias("n_words"), F.collect_set("place").alias("places"))

    by_text = Window.partitionBy("id", "th")
    votes = votes.withColumn("copies", F.sum(F.when(F.col("own"), F.col("votes"))).over(by_text)).withColumn("votes", F.expr("votes div copies"))
    votes = votes.where(F.col("own") | F.when(F.col("base"), F.col("votes") == F.col("runs")).otherwise(F.col("votes") >= F.least(F.lit(2), "runs")))
    along = Window.partitionBy("id", "th", "template").orderBy("diagonal")
    new = F.when(F.col("base") | F.col("own") | (F.col("diagonal") - F.lag("diagonal").over(along) > gap), 1).otherwise(0)
    spans = votes.withColumn("span", F.sum(new).over(along)).groupBy("id", "th", "own", "template", "label", "base", "runs", "size", "span").agg(
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.min("diagonal").alias("start"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.min(F.col("diagonal") + F.array_min("places")).alias("low"), F.max(F.col("diagonal") + F.array_max("places") + F.col("size")).alias("high"),
    )
    cover = F.size("places") / F.col("runs")
    good = (cover >= share) & (F.col("high") - F.col("low") <= stretch * (F.col("runs") + F.col("size") - 1))
    spans = saved(spans.where(F.col("own") | F.col("base") | good).withColumn("cover", cover).drop("places", "span"), "license-spans")
    found = spans.where("NOT own").select("id", "th", "template", "label", "base", "size", "start", "low", "high", "cover")
    found = _verified(found, docs, known, share, id_col, text_col)
    texts = spans.where("own").select("id", "th", "own", "n_words", "copies")
    base = F.col("base")
    result = texts.unionByName(found.drop("low", "high", "size", "template"), allowMissingColumns=True).groupBy("id", "th").agg(
        F.max("n_words").cast("long").alias("n_words"), F.max("copies").alias("copies"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    )
    each = result.select("*", F.explode(F.expr("sequence(1L, copies)")))
    return each.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")



def oracle(phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, k: int = 3, share: float = 0.6, stretch: float = 1.5, gap: int = 3) -> str:
    """The scan of `documents` in DuckDB's SQL, by the runs' words instead of their hashes."""
    rows = template_runs(phrases, templates, k)
    values = ", ".join(f"({t}, '{label}', {base}, {runs}, {size}, {place}, '{run}')" for t, label, base, runs, size, place, run in rows)
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    by_size = " UNION ALL ".join(f"SELECT key, {n} AS size, pos, array_to_string(w[pos + 1 : pos + {n}], ' ') AS run FROM (SELECT key, w, unnest(range(0, len(w) - {n - 1})) AS pos FROM d)" for n in sorted({r[4] for r in rows}))
    return f"""
WITH tm(template, label, base, runs, size, place, run) AS (VALUES {values}),
every AS (SELECT template, list(run ORDER BY place) AS all_runs FROM tm GROUP BY 1),
t AS (SELECT doc_id AS id, coalesce(text, '') AS text, count(*) AS copies FROM documents GROUP BY 1, 2),
d AS (SELECT row_number() OVER () AS key, id, copies, list_filter(string_split_regex({lower}, '{GAP}'), lambda x: x <> '') AS w FROM t),
r AS ({by_size}),
votes AS (
  SELECT key, template, label, base, runs, size, pos - place AS diagonal, count(*) AS votes, list(place) AS places
  FROM r JOIN tm USING (size, run) GROUP BY key, template, label, base, runs, size, pos - place HAVING count(*) >= if(base, runs, least(2, runs))
), marks AS (
  SELECT *, CASE WHEN base OR diagonal - lag(diagonal) OVER along > {gap} THEN 1 ELSE 0 END AS new FROM votes
  WINDOW along AS (PARTITION BY key, template ORDER BY diagonal)
), numbered AS (SELECT *, sum(new) OVER (PARTITION BY key, template ORDER BY diagonal) AS span FROM marks),
spans AS (
  SELECT key, template, label, base, runs, size, span, min(diagonal) AS start, len(list_distinct(flatten(list(places)))) / runs::DOUBLE AS cover,
    min(diagonal + list_min(places)) AS low, max(diagonal + list_max(places) + size) AS high
  FROM numbered GROUP BY key, template, label, base, runs, size, span
), found AS (
  SELECT s.* FROM spans s JOIN d USING (key) JOIN every USING (template)
  WHERE base OR (cover >= {share} AND high - low <= {stretch} * (runs + size - 1)
    AND len(list_intersect(all_runs, list_transform(range(low, high - size + 1), lambda i: array_to_string(w[i + 1 : i + size], ' ')))) >= {share} * len(list_distinct(all_runs)))
), result AS (
  SELECT key, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
  FROM found GROUP BY 1
), each AS (
  SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score, unnest(range(0, copies)) AS copy
  FROM d LEFT JOIN result USING (key)
)
SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score FROM each
"""


ORACLE = oracle()
