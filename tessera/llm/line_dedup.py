"""Line dedup over a suffix array of line ids (operator 10): DataFrame functions only.

Texts are sequences of line ids.  Distributed prefix doubling ranks suffixes by their first 1, 2, 4, .. lines:
the rank of a suffix by 2n lines is the place of the pair (rank by n lines here, rank by n lines n lines on)
in the order of all such pairs.  Suffixes of equal rank are neighbours in the suffix array with a longest common
prefix of at least that many lines, so a rank with two or more suffixes is an LCP interval: a repeated run.
Only such suffixes go on to the next doubling, since nothing longer can repeat elsewhere; doubling ends when no
run of that length repeats.

A suffix that is not the first of its interval, by (doc_id, line), begins a later copy.  The exact length of the longest
one is found by descending the stored ranks from the highest level at which it is one: the interval's members
are compared by their rank half as many lines further on, which cuts the interval into narrower ones of longer prefix, and
so on down to single lines.  A later copy is thus known with its whole length, and what is not part of a
longer one to its left is a maximal run.  One rule decides on it as a whole: it goes if it has MIN_LINES
lines or MIN_WORDS words, whichever comes first.

Ranks come from a range-partitioned sort of the distinct pairs, which are counted before they are shuffled, so a
line that fills a third of the table is one row there; rows reach their rank by an equi-join that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, shuffle_width

MIN_LINES = 3
MIN_WORDS = 5
BLOCK = 256
KEY = ["k1", "k2"]  # a document: its id and its text's hash
WORD = r"[^ \t\x0B\f\r]+"


def keys_of(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def numbered(keys: DataFrame, *by: str) -> DataFrame:
    """keys with rank, its place in the order of the given columns."""
    n = shuffle_width(keys.sparkSession)
    placed = cut(
        keys.repartitionByRange(n, *by).sortWithinPartitions(*by)
        .withColumns({"part": F.spark_partition_id(), "i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    )
    sizes = placed.groupBy("part").count()  # a row for each partition at most
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("part", before.alias("offset")))
    return placed.join(offsets, "part").withColumn("rank", F.col("i") + F.col("offset")).drop("part", "i", "offset")


def repeated_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, DataFrame]]:
    """For n = 1, 2, 4, ..: (n, suffixes whose first n lines repeat), as (k1, k2, pos, rank, first, words), first being the
    earliest suffix of the rank's interval, words those of the first line.  Blank lines never repeat.  Rows alike in id and text are one document."""
    line = F.col("line")
    lines = (
        docs.select(*[k.alias(n) for k, n in zip(keys_of(id_col, text_col), KEY, strict=True)], F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
        .where(line.rlike(WORD))
        .select(*KEY, "pos", F.xxhash64(line).alias("a"), F.hash(line).alias("b"), F.size(F.regexp_extract_all(line, F.lit(WORD), F.lit(0))).alias("words"))
        .distinct()
    )
    step, levels, state = 1, [], cut(lines)
    place = F.struct(*KEY, "pos")
    while True:
        keys = state.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
        ranks = numbered(keys, "a", "b")
        level = cut(state.join(ranks, ["a", "b"]).select(*KEY, "pos", "rank", "first", "words"))
        if level.isEmpty():
            return levels
        levels.append((step, level))
        here = level.select(*KEY, "pos", F.col("rank").alias("a"), "words")
        after = level.select(*KEY, (F.col("pos") - step).alias("pos"), F.col("rank").alias("b"))
        state, step = cut(here.join(after, [*KEY, "pos"])), step * 2


def longest_copies(levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """(k1, k2, pos, words, lines): every suffix whose beginning is a later copy, with the length of the longest one.

    An interval is named by its first suffix and its length; its undecided suffixes and the first alone stand for
    it, since whatever is not the first of its own part of the interval has left for a narrower one."""
    place = F.struct(*KEY, "pos")
    later = lambda level: level.where(place > F.col("first"))
    found, above = None, None
    for n, level in reversed(levels):
        if found is not None:
            sources = found.select("first", "lines").distinct().select(*[F.col(f"first.{c}").alias(c) for c in (*KEY, "pos")], "lines", "first")
            entries = found.select(*KEY, "pos", "lines", "first").unionByName(sources)
            next_rank = level.select(*KEY, F.col("pos").alias("at"), F.col("rank").alias("x"))
            entries = cut(entries.withColumn("at", F.col("pos") + F.col("lines")).join(next_rank, [*KEY, "at"]).drop("at"))
            parts = entries.groupBy("first", "lines", "x").agg(F.min(place).alias("m"), F.count("*").alias("n")).where("n > 1").drop("n")
            longer = entries.join(parts, ["first", "lines", "x"]).where(place > F.col("m")).select(*KEY, "pos", "m")
            found = found.join(longer, [*KEY, "pos"], "left").select(
                *KEY, "pos", (F.col("lines") + F.when(F.col("m").isNull(), 0).otherwise(n)).alias("lines"), F.coalesce("m", "first").alias("first")
            )
        own = later(level)
        if above is not None:
            own = own.join(later(above).select(*KEY, "pos"), [*KEY, "pos"], "left_anti")
        own = own.select(*KEY, "pos", F.lit(n).alias("lines"), "first")
        found, above = cut(own if found is None else found.unionByName(own)), level
    return found.join(levels[0][1].select(*KEY, "pos", "words"), [*KEY, "pos"])


def runs_to_delete(copies: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """copies with gone: whether a maximal run that the rule takes covers the line.  Windows hold one document's lines."""
    along = Window.partitionBy(*KEY).orderBy("pos")
    ahead = [F.when(F.col("lines") > i, F.lead("words", i).over(along)) for i in range(1, min_lines - 1)]
    words = sum([F.coalesce(w, F.lit(0)) for w in ahead], F.col("words"))
    taken = (F.col("lines") >= min_lines) | (words >= min_words)
    ends = copies.withColumn("end", F.when(taken, F.col("pos") + F.col("lines")))
    return ends.withColumn("gone", F.coalesce(F.max("end").over(along.rowsBetween(Window.unboundedPreceding, 0)) > F.col("pos"), F.lit(False))).drop("end")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, report: bool = True
) -> DataFrame:
    """docs with text_col rid of later copies and, where report is set, n_lines, n_removed and longest_copy in place of
    columns of these names.

    A later copy is a run of lines, none of them blank, that also starts earlier, in the same text or another; it goes as a whole if it
    has min_lines lines or min_words words at its longest.  longest_copy is the number of lines of the text's longest one, 0 if none.
    Nulls: a null text is empty and has one blank line; a null id counts as the smallest.  Rows alike in id and
    text are one document: each keeps the same lines.  Rows alike in id alone are ordered by their text's hash.
    Blank lines are kept.  Texts of which nothing is left are empty.  Very long texts are cut into lines in their task
    and then are rows like any other.  Empty tables give empty results.  Other columns stay as they are, whatever they are called.
    """
    if min_lines < 1 or min_words < 1:
        raise ValueError("min_lines and min_words must be at least 1")
    levels = repeated_suffixes(docs, id_col, text_col)
    extra = ["n_lines", "n_removed", "longest_copy"]
    base = docs.drop(*extra) if report else docs
    k1, k2, found, lines, kept = fresh([*base.columns, *extra], "k1", "k2", "found", "lines", "kept")
    source = base.withColumns(dict(zip((k1, k2), keys_of(id_col, text_col), strict=True)))
    if levels:
        copies = runs_to_delete(longest_copies(levels), min_lines, min_words)
        blocks = copies.groupBy(*KEY, F.floor(F.col("pos") / BLOCK).cast("int").alias("block")).agg(
            F.max("lines").alias("longest"), F.collect_list(F.when(F.col("gone"), F.col("pos"))).alias("at")
        )
        marks = blocks.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(
            F.struct(F.max("longest").alias("longest"), F.map_from_entries(F.collect_list(F.struct("block", "at"))).alias("gone")).alias(found)
        )
        source = source.join(marks, [k1, k2], "left")
    else:
        source = source.withColumn(found, F.lit(None).cast("struct<longest:int,gone:map<int,array<int>>>"))
    gone = F.col(found)["gone"]
    lost = lambda i: F.coalesce(F.array_contains(gone[F.floor(i / BLOCK).cast("int")], i), F.lit(False))
    out = source.withColumn(lines, lines_of(F.col(text_col)))
    out = out.withColumn(kept, F.when(gone.isNull(), F.col(lines)).otherwise(F.filter(lines, lambda x, i: ~lost(i))))
    out = out.withColumn(text_col, F.array_join(kept, "\n"))
    if report:
        out = out.withColumns(
            {
                "n_lines": F.size(lines).cast("long"),
                "n_removed": (F.size(lines) - F.size(kept)).cast("long"),
                "longest_copy": F.coalesce(F.col(found)["longest"], F.lit(0)).cast("long"),
            }
        )
    return out.select(*[F.col(f"`{c}`") for c in base.columns], *(extra if report else []))


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_removed", "longest_copy", F.sha2("text", 256).alias("kept_sha256"))


def oracle() -> str:
    """The same by comparing runs of every length."""
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
l AS (SELECT doc_id, i, w[i] AS line FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
z AS (SELECT line, row_number() OVER (ORDER BY line) AS z, len(regexp_extract_all(line, '[^ \t\x0B\f\r]+')) AS words FROM l GROUP BY line),
n AS (SELECT doc_id, i, line, words, CASE WHEN words > 0 AND count(*) OVER (PARTITION BY line) > 1 THEN z END AS z FROM l JOIN z USING (line)),
e AS (SELECT *, sum((z IS NULL)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS piece FROM n),
g AS (SELECT doc_id, piece, min(i) AS low, list(z ORDER BY i) AS zs FROM e WHERE z IS NOT NULL GROUP BY ALL),
s AS (SELECT doc_id, low + a AS i, n, array_to_string(zs[a + 1:a + n], ',') AS run FROM g, unnest(range(len(zs))) AS u(a), unnest(range(1, len(zs) - a + 1)) AS v(n)),
r AS (SELECT doc_id, i, n, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS later FROM s),
c AS (SELECT doc_id, i, max(n) AS n FROM r WHERE later GROUP BY ALL),
x AS (SELECT c.doc_id, c.i, c.n FROM c JOIN n ON n.doc_id = c.doc_id AND n.i BETWEEN c.i AND c.i + c.n - 1
      GROUP BY ALL HAVING c.n >= {MIN_LINES} OR sum(words) >= {MIN_WORDS}),
k AS (SELECT DISTINCT doc_id, i + j AS i FROM x, unnest(range(n)) AS u(j)),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(k.i) AS n_removed, string_agg(line, chr(10) ORDER BY l.i) FILTER (k.i IS NULL) AS kept
      FROM l LEFT JOIN k ON k.doc_id = l.doc_id AND k.i = l.i GROUP BY l.doc_id),
m AS (SELECT doc_id, max(n) AS longest FROM c GROUP BY doc_id)
SELECT t.doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, coalesce(longest, 0)::BIGINT AS longest_copy, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN m USING (doc_id)"""
