"""Document fingerprints by invertible Bloom lookup sketches (operator 5): DataFrame functions only.

A text is a set of paragraph digests: each line gives its first HEAD code points and then pieces of PIECE, so that
an edit changes the pieces after it on its own line alone.  The digests are dealt by hash to blocks of LOAD at most on average, a
power of two of them.  In a block every digest is added to one cell in each of TABLES tables; a cell holds the XOR of
its digests and one number, the sum of their checks and as many times ONE.

Peeling reads a cell that holds one digest alone, takes the digest out of its other cells, and goes on round by
round.  A block is published with CELLS cells a table; where it doesn't peel alone, it is published again with
more and another hash, and so on.  A fingerprint thus tells its digests, whatever it is compared with.

Two versions are compared block by block, both dealt to as many blocks as their digests take together (half as many for a
version and its edited form, which have most in common); cell is subtracted from cell, common digests vanish, and peeling recovers the others.  Where it gets stuck, the block is
retried with the next size.  The likeness is 2 |A and B| / (|A| + |B|), from what the fingerprints hold alone.

Digests are rows while they are dealt, so work and memory grow in proportion to a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width

HEAD, PIECE = 32, 1024
TABLES = 4
LOAD = 10
CELLS = (6, 12, 15)  # cells of a table: of the first try, the second, and all others; from the fourth on a block is split, each time into twice as many
RETRIES, ROUNDS = 9, 12
STUCK = "a block does not peel at any size"  # the last is 128 parts of 60 cells, for some 20 digests on average
ONE = 1 << 40  # more than the checks of a cell can sum up to
BUCKETS_PER_PARTITION = 4


def parts_of(size: Column) -> Column:
    """Into how many parts a block is split: one for the first three sizes, then twice as many each time."""
    return F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(0), size - 2))


def each_part(size: Column, body) -> Column:
    """body(i, digests -> those of part i) of each part."""
    n = parts_of(size)
    own = lambda i: lambda found: F.filter(found, lambda d: F.pmod(F.xxhash64(d, F.lit("part")), n) == i)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: body(i, own(i)))


def bound(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def digests(text: Column) -> Column:
    """The distinct digests of a text's pieces."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?md)^[^\n]{{1,{HEAD}}}|[^\n]{{1,{PIECE}}}"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def mark(digest: Column) -> Column:
    """What a digest adds to the number of a cell: ONE for the count, and a check of 32 bits."""
    return F.xxhash64(digest, F.lit("check")).bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(ONE)


def width(size: Column) -> Column:
    """Cells of a table, by the number of the size."""
    return F.when(size == 0, CELLS[0]).when(size == 1, CELLS[1]).otherwise(CELLS[2])


def places(digest: Column, size: Column) -> Column:
    """A bit for the digest's cell in each table; every size has hashes of its own."""
    w = width(size)
    at = lambda h, t: (F.shiftrightunsigned(h, 16 * t).bitwiseAND(F.lit(0xFFFF)) % w).cast("int") + t * w
    bit = lambda h, t: F.call_function("shiftleft", F.lit(1).cast("long"), at(h, t))
    return bound(F.xxhash64(digest, size.cast("long")), lambda h: sum([bit(h, t) for t in range(1, TABLES)], bit(h, 0)))


def held(codes: Column, values: Column, i: Column, start: Column, add) -> Column:
    """start with the values added whose places are cell i."""
    hit = lambda code: F.call_function("shiftrightunsigned", code, i).bitwiseAND(F.lit(1)) == 1
    return F.aggregate(F.filter(values, lambda _, j: hit(codes[j])), start, add)


XOR, ADD, TAKE = (lambda x, y: x.bitwiseXOR(y)), (lambda x, y: x + y), (lambda x, y: x - y)


def sketch(found: Column, size: Column) -> Column:
    """struct(k, m), the cells of a set of digests: XORs and numbers."""
    w = width(size)
    cells = lambda codes, values, add: F.transform(F.sequence(F.lit(0), TABLES * w - 1), lambda i: held(codes, values, i, F.lit(0).cast("long"), add))
    made = lambda codes: F.struct(cells(codes, found, XOR).alias("k"), cells(codes, F.transform(found, mark), ADD).alias("m"))
    return bound(F.transform(found, lambda d: places(d, size)), made)


def as_string(cells: Column) -> Column:
    number = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.base64(F.unhex(F.array_join(F.zip_with(cells["k"], cells["m"], lambda k, m: F.concat(number(k), number(m))), "")))


def peeled(cells: Column, size: Column) -> Column:
    """The digests left in a difference of sketches: struct(done, a, b); a: of the first version, b: of the second."""
    none = F.array().cast("array<bigint>")
    start = F.struct(cells["k"].alias("k"), cells["m"].alias("m"), none.alias("a"), none.alias("b"), F.lit(False).alias("stop"))

    def step(acc: Column, _: Column) -> Column:
        # The count is looked at first, which leaves few checks to be worked out.
        one = lambda m: (m >= F.lit(ONE)) & (m < F.lit(2 * ONE))
        lone = lambda sign: F.array_distinct(F.filter(acc["k"], lambda k, i: one(sign * acc["m"][i]) & (sign * acc["m"][i] == mark(k))))

        def on(x: Column) -> Column:
            found, marks, codes = x["d"], x["m"], x["c"]
            rid = lambda array, values, add: F.transform(array, lambda v, i: held(codes, values, i, v, add))
            return F.when(F.size(found) == 0, F.struct(acc["k"].alias("k"), acc["m"].alias("m"), acc["a"].alias("a"), acc["b"].alias("b"), F.lit(True).alias("stop"))).otherwise(
                F.struct(
                    rid(acc["k"], found, XOR).alias("k"), rid(acc["m"], marks, TAKE).alias("m"),
                    F.concat(acc["a"], x["a"]).alias("a"), F.concat(acc["b"], x["b"]).alias("b"), F.lit(False).alias("stop"),
                )
            )

        def read(x: Column) -> Column:
            signed = F.concat(F.transform(x["a"], mark), F.transform(x["b"], lambda k: -mark(k)))
            found = F.concat(x["a"], x["b"])
            return bound(F.struct(x["a"].alias("a"), x["b"].alias("b"), found.alias("d"), signed.alias("m"), F.transform(found, lambda d: places(d, size)).alias("c")), on)

        return F.when(acc["stop"], acc).otherwise(bound(F.struct(lone(1).alias("a"), lone(-1).alias("b")), read))

    zero = lambda xs: F.forall(xs, lambda x: x == 0)
    end = lambda acc: F.struct((zero(acc["k"]) & zero(acc["m"])).alias("done"), acc["a"].alias("a"), acc["b"].alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, end)


def peels(codes: Column) -> Column:
    """Do the cells of digests with these places peel?  A digest alone in a cell goes, until none is left or none is alone."""
    start = F.struct(codes.alias("left"), F.lit(False).alias("stop"))
    none = F.struct(F.lit(0).cast("long").alias("once"), F.lit(0).cast("long").alias("more"))
    count = lambda acc, c: F.struct(acc["once"].bitwiseOR(c).alias("once"), acc["more"].bitwiseOR(acc["once"].bitwiseAND(c)).alias("more"))

    def step(acc: Column, _: Column) -> Column:
        alone = F.aggregate(acc["left"], none, count, lambda x: x["once"].bitwiseAND(F.bitwise_not(x["more"])))
        rest = bound(alone, lambda cells: F.filter(acc["left"], lambda c: c.bitwiseAND(cells) == 0))
        return F.when(acc["stop"], acc).otherwise(bound(rest, lambda r: F.struct(r.alias("left"), ((F.size(r) == 0) | (F.size(r) == F.size(acc["left"]))).alias("stop"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.size(acc["left"]) == 0)


def published(cells: Column, found: Column) -> Column:
    """A block's cells as text, of every size up to the first with which they peel; a block that is split, part after part."""

    def step(acc: Column, size: Column) -> Column:
        text = each_part(size, lambda _, own: as_string(F.when(size == 0, cells).otherwise(bound(own(found), lambda d: sketch(d, size)))))
        done = F.forall(each_part(size, lambda _, own: F.transform(own(found), lambda d: places(d, size))), peels)
        return F.when(acc["done"], acc).otherwise(F.struct(F.concat(acc["text"], F.array(F.array_join(text, ","))).alias("text"), done.alias("done")))

    start = F.struct(F.array().cast("array<string>").alias("text"), F.lit(False).alias("done"))
    text = lambda acc: F.when(acc["done"], F.array_join(acc["text"], ":")).otherwise(F.raise_error(F.lit(STUCK)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(RETRIES)), start, step, text)


def difference(cells: Column, a: Column, b: Column) -> Column:
    """struct(size, a, b): the digests of only one of two versions of a block, and the size that told them; cells: those
    of the one less those of the other."""

    def step(acc: Column, size: Column) -> Column:
        less = lambda x: F.struct(F.zip_with(x["a"]["k"], x["b"]["k"], XOR).alias("k"), F.zip_with(x["a"]["m"], x["b"]["m"], TAKE).alias("m"))
        larger = lambda own: bound(F.struct(bound(own(a), lambda d: sketch(d, size)).alias("a"), bound(own(b), lambda d: sketch(d, size)).alias("b")), less)
        split = each_part(size, lambda _, own: peeled(F.when(size == 0, cells).otherwise(larger(own)), size))
        all_of = lambda x, side: F.flatten(F.transform(x, lambda p: p[side]))
        got = lambda x: F.struct(size.alias("size"), F.forall(x, lambda p: p["done"]).alias("done"), all_of(x, "a").alias("a"), all_of(x, "b").alias("b"))
        return F.when(acc["done"], acc).otherwise(bound(split, got))

    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).alias("size"), F.lit(False).alias("done"), none.alias("a"), none.alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(RETRIES)), start, step, lambda acc: F.when(acc["done"], acc).otherwise(F.raise_error(F.lit(STUCK))))


def cells_of(rows: DataFrame, *by: str) -> DataFrame:
    """rows (digest, side, ..) by the given columns: the cells of size 0, those of side 1 taken off those of side 0, and the digests a and b of either side."""
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("p", places(F.col("digest"), F.lit(0))).withColumn("m", F.when(F.col("side") == 0, 1).otherwise(-1) * mark(F.col("digest")))
    here = lambda i, x: F.when(F.col("digest").isNotNull() & (F.col("p").bitwiseAND(F.lit(1 << i)) != 0), F.col(x))
    ks = [F.coalesce(F.bit_xor(here(i, "digest")), zero) for i in range(TABLES * CELLS[0])]
    ms = [F.coalesce(F.sum(here(i, "m")), zero) for i in range(TABLES * CELLS[0])]
    of_side = lambda s: F.collect_list(F.when(F.col("side") == s, F.col("digest")))
    return rows.groupBy(*by).agg(F.struct(F.array(*ks).alias("k"), F.array(*ms).alias("m")).alias("cells"), of_side(0).alias("a"), of_side(1).alias("b"), F.first("info", True).alias("info"))


def blocks_for(n: Column) -> Column:
    """How many blocks n digests take: a power of two."""
    return F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.greatest(n, F.lit(1)) / float(LOAD))).cast("double"))).cast("int")


def with_next(docs: DataFrame, order: str, value: str) -> DataFrame:
    """docs (order, value) with `range` and `next`, the value of the next row in ascending order; after the last comes the first.

    Rows are dealt to ranges of (order, hash of the value, a random number), so that no value of the order, null included, is
    too much for one range; a range's first row also goes to the end of the range before.  Nulls come first.
    """
    n = BUCKETS_PER_PARTITION * shuffle_width(docs.sparkSession)
    known = F.coalesce(F.col(order), F.lit(-(1 << 63)))
    rows = docs.withColumn("at", F.struct(known.alias("o"), F.xxhash64(value).alias("t"), F.xxhash64(F.monotonically_increasing_id()).alias("s")))
    ends = rows.select("at").repartitionByRange(n, "at").groupBy(F.spark_partition_id()).agg(F.min("at").alias("b")).collect()  # n rows at most
    bounds = sorted(r["b"] for r in ends)[1:]
    step = max(1, int(len(bounds) ** 0.5))
    value_of = lambda b: F.struct(F.lit(b[0]).cast("long").alias("o"), F.lit(b[1]).cast("long").alias("t"), F.lit(b[2]).cast("long").alias("s"))
    if bounds:
        # every step-th bound is looked at first, then those between two of them
        pages = F.array(*[F.array(*map(value_of, bounds[i : i + step])) for i in range(0, len(bounds), step)])
        heads_of = F.array(*[value_of(b) for b in bounds[::step]])
        page = F.size(F.filter(heads_of, lambda b: b <= F.col("at")))
        inside = F.size(F.filter(F.get(pages, F.col("page") - 1), lambda b: b <= F.col("at")))
        rows = rows.withColumn("page", page).withColumn("range", F.when(F.col("page") == 0, 0).otherwise((F.col("page") - 1) * step + inside)).drop("page")
    else:
        rows = rows.withColumn("range", F.lit(0))
    rows = rows.withColumn("copy", F.lit(0))
    low = rows.groupBy("range").agg(F.min_by(F.struct(order, value), "at").alias("head"))  # a row for each range at most
    around = Window.orderBy("range")
    before = F.coalesce(F.lag("range").over(around), F.max("range").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = low.select(F.col(f"head.{order}").alias(order), F.col(f"head.{value}").alias(value), before.alias("range"), F.lit(1).alias("copy"))
    dealt = rows.unionByName(heads, allowMissingColumns=True).repartition("range")
    along = Window.partitionBy("range").orderBy("copy", "at")
    return dealt.withColumn("next", F.lead(value).over(along)).where("copy = 0").drop("at", "copy")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    edited_only, how many digests were peeled out of the comparison with the edited text that the text itself lacks, and
    retries, the greatest number of retries that a block of the two comparisons took.

    The edited text has the last quarter of the text's code points replaced by the beginning of the next document.
    Null texts are empty: two empty texts are alike (1), an empty and another text are not (0).  Null ids come first in
    the order, equal ids follow by the hash of their text; a single row is followed by itself.  Repeated rows follow each other.
    Very long texts have more blocks, no larger ones.  Empty tables give empty results.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = with_next(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")), "doc_id", "text")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("tail", F.floor(F.col("n_chars") / 4).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars) - tail)"), F.expr("substring(next, 1, tail)")))
    rows = rows.withColumns({"own": digests(F.col("text")), "other": digests(F.col("next")), "changed": digests(F.col("edited"))})
    rows = rows.select(
        "range", F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "other", "changed",
        (F.size("own") + F.size("changed")).alias("n_edited"), (F.size("own") + F.size("other")).alias("n_next"),
    )
    rows = rows.withColumns({"blocks0": blocks_for(F.size("own")), "blocks1": blocks_for(F.size("changed")), "blocks2": blocks_for(F.ceil(F.col("n_edited") / 2)), "blocks3": blocks_for(F.col("n_next"))})

    info = F.struct("doc_id", "n_chars", "edited_sha256", "n_edited", "n_next")  # it goes with the first block alone
    info_type = "struct<doc_id:bigint,n_chars:bigint,edited_sha256:string,n_edited:int,n_next:int>"

    def dealt(kind: int, side: int, found: str) -> Column:
        block = lambda d: F.xxhash64(d, F.lit("block")).bitwiseAND(F.col(f"blocks{kind}").cast("long") - 1).cast("int")
        return F.transform(found, lambda d: F.struct(F.lit(kind).alias("kind"), F.lit(side).alias("side"), block(d).alias("block"), d.alias("digest"), F.lit(None).cast(info_type).alias("info")))

    entries = F.concat(dealt(0, 0, "own"), dealt(1, 0, "changed"), dealt(2, 0, "own"), dealt(2, 1, "changed"), dealt(3, 0, "own"), dealt(3, 1, "other"))
    # A block without digests has a row, too, so that fingerprints have all their blocks.
    bare = lambda kind, blocks: F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda i: F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("side"), i.alias("block"), F.lit(None).cast("long").alias("digest"), F.when((i == 0) & F.lit(kind == 0), info).alias("info")))
    entries = F.concat(entries, bare(0, "blocks0"), bare(1, "blocks1"))
    who = ["range", "row"]
    blocks = cells_of(rows.select(*who, F.explode(entries).alias("e")).select(*who, "e.*"), *who, "kind", "block")
    blocks = blocks.withColumns(
        {
            "text": F.when(F.col("kind") <= 1, published(F.col("cells"), F.col("a"))),
            "diff": F.when(F.col("kind") >= 2, difference(F.col("cells"), F.col("a"), F.col("b"))),
        }
    )
    of_kind = lambda k, x: F.when(F.col("kind") == k, x)
    string = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(of_kind(k, F.struct("block", "text")))), lambda x: x["text"]), ".")
    apart = lambda k: F.coalesce(F.sum(of_kind(k, F.size("diff.a") + F.size("diff.b"))), F.lit(0))
    near = lambda n, k: F.when(F.col(n) == 0, 1.0).otherwise((F.col(n) - F.col(f"apart{k}")) / F.col(n))
    whole = blocks.groupBy(*who).agg(
        F.first("info", True).alias("info"),
        string(0).alias("fingerprint"), string(1).alias("edited_fingerprint"), apart(2).alias("apart2"), apart(3).alias("apart3"),
        F.coalesce(F.sum(of_kind(2, F.size("diff.b"))), F.lit(0)).alias("edited_only"), F.coalesce(F.max("diff.size"), F.lit(0)).alias("retries"),
    )
    whole = whole.select("info.*", *[c for c in whole.columns if c != "info"])
    return whole.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("n_edited", 2).alias("near_edited"), near("n_next", 3).alias("near_next"), "edited_only", "retries")
