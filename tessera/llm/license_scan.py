"""License scans by diagonal voting (operator 2): DataFrame functions only.

Every rolling word k-gram of every text is joined, by its hash, to the positions it has in the license
templates.  A copy of a template lies on one diagonal (text position minus template position), so hits
are counted per diagonal; neighbouring diagonals are merged with their peak, since inserted or lost words
shift the rest of a copy.  The merged span is then verified: of its hits one for each template position counts, the one
nearest to the peak, and only where the text positions rise with the template's.  It is accepted where the positions
that are left cover enough of the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 2
NEIGHBOURS = 2
COVERAGE = 0.85

# Phrases and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Notices and opening passages of common public licenses, and the method's labels.
TEMPLATES = [
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation",
        "gpl-text",
    ),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an"
        " as is basis without warranties or conditions of any kind either express or implied",
        "apache-2.0",
    ),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("released under the mit license", "mit-notice"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
        "mit-text",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "isc",
    ),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased: runs of digits, letters and characters outside ASCII.  Null texts have none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams(words: Column) -> Column:
    """The hashes of all rolling word pairs."""
    n = F.size(words)
    return F.when(n >= K, F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.xxhash64(a, b)))


def template_positions(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(gram, template, at, need, base, label): a row for each k-gram of each template, as many as the fixed texts have."""
    rows = [(i, label, i < len(BASE), text) for i, (text, label) in enumerate(BASE + templates)]
    t = spark.createDataFrame(rows, "template int, label string, base boolean, text string").withColumn("words", words_of(F.col("text")))
    return t.select(
        "template", "label", "base", (F.size("words") - (K - 1)).alias("need"), F.posexplode(grams(F.col("words"))).alias("at", "gram")
    )


def in_order(spans: Column, peak: Column) -> Column:
    """How many template positions a merged span holds in their order; spans: its diagonals with their positions."""
    hits = F.flatten(
        F.transform(
            spans,
            lambda s: F.transform(
                s["places"], lambda at: F.struct(at.alias("at"), F.abs(s["diagonal"] - peak).alias("away"), (at + s["diagonal"]).alias("pos"))
            ),
        )
    )

    def step(acc: Column, hit: Column) -> Column:
        rises = (hit["at"] > acc["at"]) & (hit["pos"] > acc["pos"])
        return F.struct((acc["n"] + rises.cast("int")).alias("n"), hit["at"].alias("at"), F.when(rises, hit["pos"]).otherwise(acc["pos"]).alias("pos"))

    return F.aggregate(F.array_sort(hits), F.struct(F.lit(0).alias("n"), F.lit(-1).alias("at"), F.lit(-1).alias("pos")), step, lambda acc: acc["n"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A base phrase counts wherever all its words stand consecutively.  A template counts where a peak diagonal
    and its neighbours hold COVERAGE of its k-grams, each once and in order.  score is the best coverage found, 1 for a base phrase.
    Null and empty texts have no words, null places, empty label strings and score 0.  Rows are told apart by
    their place, so repeated rows and null ids each give a row of their own.  Other columns are not read.
    """
    known = F.broadcast(template_positions(docs.sparkSession, templates))  # as large as the fixed texts, whatever the input
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words")
    ).select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode_outer(grams(F.col("words"))).alias("pos", "gram"))
    hits = (
        rows.join(known, "gram", "left")
        .where(F.col("template").isNotNull() | F.coalesce(F.col("pos") == 0, F.lit(True)))
        .select("row", "doc_id", "n_words", "template", "label", "base", "need", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
        .repartition("row")
    )
    who = ["row", "doc_id", "n_words", "template", "label", "base", "need"]
    # A diagonal has no more hits than its template has k-grams.
    votes = hits.groupBy(*who, "diagonal").agg(F.count("template").alias("n"), F.collect_list(F.col("pos") - F.col("diagonal")).alias("places"))
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    peaks = votes.withColumns({"most": F.max("n").over(near), "total": F.sum("n").over(near), "spans": F.collect_list(F.struct("diagonal", "places")).over(near)})
    least = F.ceil(F.col("need") * COVERAGE)
    held = F.when(~F.col("base") & (F.col("n") == F.col("most")) & (F.col("total") >= least), in_order(F.col("spans"), F.col("diagonal")))
    peaks = peaks.withColumn("held", held)
    place = F.coalesce(F.col("base") & (F.col("n") == F.col("need")), F.lit(False))
    cover = F.col("held") / F.col("need")
    own = F.coalesce(F.col("held") >= least, F.lit(False))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        peaks.groupBy("row", "doc_id", "n_words")
        .agg(
            F.sum(place.cast("long")).alias("n_base"),
            F.min(F.when(place, F.col("diagonal").cast("long"))).alias("first_word"),
            F.max(F.when(place, F.col("diagonal").cast("long"))).alias("last_word"),
            joined(F.when(place, F.col("label"))).alias("base_labels"),
            joined(F.when(place | own, F.col("label"))).alias("labels"),
            F.coalesce(F.max(F.when(place, 1.0).when(own, cover)), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )


def oracle() -> str:
    """The same votes in DuckDB SQL, joined on the words themselves instead of their hashes."""
    values = ",\n    ".join(f"({i}, '{label}', {str(i < len(BASE)).lower()}, '{text}')" for i, (text, label) in enumerate(BASE + TEMPLATES))
    return f"""
WITH t(template, label, base, txt) AS (VALUES {values}),
tw AS (SELECT *, string_split(txt, ' ') AS w FROM t),
tg AS (SELECT template, label, base, len(w) - 1 AS need, i - 1 AS place_in, w[i] || ' ' || w[i + 1] AS gram
       FROM tw, unnest(range(1, len(w))) AS u(i)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS gram FROM d, unnest(range(1, len(w))) AS u(i)),
h AS (SELECT doc_id, template, label, base, need, pos, place_in, pos - place_in AS diagonal FROM g JOIN tg USING (gram)),
v AS (SELECT doc_id, template, label, base, need, diagonal, count(*) AS n FROM h GROUP BY ALL),
p AS (SELECT *, max(n) OVER x AS most FROM v
      WINDOW x AS (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN {NEIGHBOURS} PRECEDING AND {NEIGHBOURS} FOLLOWING)),
m AS (SELECT p.doc_id, p.template, p.diagonal, h.place_in, h.pos, row_number() OVER (PARTITION BY p.doc_id, p.template, p.diagonal, h.place_in
      ORDER BY abs(h.diagonal - p.diagonal), h.pos) AS nth
      FROM p JOIN h ON h.doc_id = p.doc_id AND h.template = p.template AND h.diagonal BETWEEN p.diagonal - {NEIGHBOURS} AND p.diagonal + {NEIGHBOURS}
      WHERE NOT p.base AND p.n = p.most),
o AS (SELECT *, coalesce(pos > max(pos) OVER (PARTITION BY doc_id, template, diagonal ORDER BY place_in ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS rises
      FROM m WHERE nth = 1),
held AS (SELECT doc_id, template, diagonal, count(*) FILTER (rises) AS total FROM o GROUP BY ALL),
q AS (SELECT p.*, total, base AND n = need AS place, coalesce(total >= ceil(need * {COVERAGE}), false) AS own FROM p LEFT JOIN held USING (doc_id, template, diagonal)),
r AS (SELECT doc_id, count(*) FILTER (place) AS n_base, min(diagonal) FILTER (place) AS first_word, max(diagonal) FILTER (place) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place) AS base_labels,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place OR own) AS labels,
      max(CASE WHEN place THEN 1.0::DOUBLE WHEN own THEN total / need END) AS score FROM q GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN r USING (doc_id)"""
