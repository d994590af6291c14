"""SimHash near-duplicates by bit-sliced comparison (operator 6).

1. A fingerprint per document, over its whole text.
2. Equal fingerprints collapse to one row, so exact copies cost nothing further.
3. Distinct fingerprints go to buckets: 64 bits are cut into BLOCKS blocks; two fingerprints that
   differ in at most RADIUS bits agree on at least BLOCKS - RADIUS whole blocks, so one table for
   each choice of BLOCKS - RADIUS blocks misses no pair.
4. In a bucket, fingerprints lie as 64 vertical bit planes (bit i of a plane: row i).  Planes are
   shifted by d rows and XORed, which compares every row with the row d below it at once; carry-save
   counters add up the differing bits, and a block is left as soon as all its counters are over the radius.
   Only a spanning star of every linked set leaves the bucket, never its pairs.
5. Connected components over the stars.

A bucket with more than HOT_BUCKET distinct fingerprints is cut into chunks, and every pair of chunks
becomes a group of its own: no group grows with the data and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import connected_components, cut, fresh, shuffle_width

RADIUS = 4
BLOCKS = 6
SHINGLE = 4
HOT_BUCKET = 4096


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned integer; 0 where it has no words."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digests = np.frombuffer(b"".join([xxh64_digest(joined[a:b], 42) for a, b in spans]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(digests), 4096):
        ones += np.unpackbits(digests[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed long, under a name that docs doesn't have.  Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint_of(t.as_py(), shingle) for t in b.column(text_col)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], [*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def shifted(planes: np.ndarray, d: int) -> np.ndarray:
    """Bit planes moved up by d rows (little-endian bit order)."""
    words, bits = divmod(d, 64)
    moved = np.zeros_like(planes)
    width = planes.shape[-1] - words
    if width > 0:
        moved[..., :width] = planes[..., words:] >> np.uint64(bits)
        if bits:
            moved[..., : width - 1] |= planes[..., words + 1 :] << np.uint64(64 - bits)
    return moved


def packed(flags: np.ndarray) -> np.ndarray:
    """Booleans (.., n) as little-endian bits in 64-bit words."""
    n = flags.shape[-1]
    pad = [(0, 0)] * (flags.ndim - 1) + [(0, -n % 64)]
    return np.ascontiguousarray(np.packbits(np.pad(flags, pad), axis=-1, bitorder="little")).view(np.uint64)


def within(planes: np.ndarray, d: int, asked: np.ndarray, radius: int) -> np.ndarray:
    """Bits i where rows i and i + d differ in at most radius bits, among those asked for."""
    near, width = shifted(planes, d), radius.bit_length() + 1
    counters = np.zeros((width, planes.shape[1]), np.uint64)
    over = ~asked
    for b in range(64):
        carry = planes[b] ^ near[b]
        for level in range(width):
            counters[level], carry = counters[level] ^ carry, counters[level] & carry
        over |= carry
        if b % 8 == 7:
            # over the radius: compare the counter with the constant, most significant bit first
            more, equal = np.zeros_like(over), np.full_like(over, ~np.uint64(0))
            for level in reversed(range(width)):
                if not radius >> level & 1:
                    more |= equal & counters[level]
                    equal &= ~counters[level]
                else:
                    equal &= counters[level]
            over |= more
            if not (~over).any():
                break
    return ~over


def linked(keys: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by key, the row that stands for each row's linked set inside its bucket."""
    n = len(fps)
    root = np.arange(n)
    planes = packed(np.unpackbits(fps.view(np.uint64).astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T)
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(begins, n))
    first = np.repeat(begins, size)
    for d in range(1, int(size.max())):
        if (root == root[first]).all():  # every bucket has become one linked set
            break
        ask = (keys[d:] == keys[:-d]) & (root[d:] != root[:-d])
        if not ask.any():
            continue
        bits = within(planes, d, packed(np.concatenate((ask, np.zeros(d, bool)))), radius)
        hits = np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")[:n])
        for i in hits.tolist():
            a, b = i, i + d
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(hits):
            while (root != (up := root[root])).any():
                root = up
    return root


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int = RADIUS, step: int = 16384) -> Iterator[pa.RecordBatch]:
    """Stars of linked fingerprints from rows (bucket, fp) that are sorted by bucket; a bucket is never cut."""

    def stars(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        alone = np.concatenate(([True], keys[1:] != keys[:-1])) & np.concatenate((keys[1:] != keys[:-1], [True]))
        keys, fps = keys[~alone], fps[~alone]
        root = linked(keys, fps, radius) if len(fps) else np.zeros(0, int)
        found = root != np.arange(len(fps))
        return pa.RecordBatch.from_arrays([pa.array(fps[found]), pa.array(fps[root[found]])], ["a", "b"])

    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        keys = np.concatenate((keys, b.column(0).to_numpy(zero_copy_only=False)))
        fps = np.concatenate((fps, b.column(1).to_numpy(zero_copy_only=False)))
        if len(keys) >= step and keys[0] != keys[-1]:
            last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
            yield stars(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
    if len(keys):
        yield stars(keys, fps)


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Edges (a, b) that span every set of fingerprints (fp) linked at radius or fewer bits."""
    if blocks <= radius:
        raise ValueError("blocks must exceed radius")
    width = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    start = np.cumsum([0, *width]).tolist()
    masks = [sum(((1 << width[i]) - 1) << start[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select(
        "fp", F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(signed)])).alias("bucket")
    )
    hot = (
        keyed.groupBy("bucket").count().where(F.col("count") > hot_bucket)
        .select("bucket", F.ceil(F.col("count") / hot_bucket).cast("int").alias("chunks"))
    )
    chunk = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("chunks")).cast("int")
    split = keyed.join(hot, "bucket").select("fp", "bucket", "chunks", chunk.alias("c"))
    split = split.select("fp", "bucket", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")).select(
        "fp", F.xxhash64("bucket", F.least("c", "o"), F.greatest("c", "o")).alias("bucket")
    )
    rows = keyed.join(hot, "bucket", "left_anti").select("fp", "bucket").unionByName(split)
    n = shuffle_width(distinct.sparkSession)
    return (
        rows.select("bucket", "fp").repartition(n, "bucket").sortWithinPartitions("bucket", "fp")
        .mapInArrow(lambda it: bucket_links(it, radius), "a long, b long")
    )


def with_components(classes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """classes (fp, ..) with component, a fingerprint that stands for all those linked to each other."""
    found = connected_components(links(classes.select("fp"), radius, blocks)).withColumnRenamed("node", "fp")
    return classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Nulls: a null text is an empty one; a row with a null id is returned, and ids that are null never
    name a component.  Empty texts have fingerprint zero and link like any other.  Repeated rows give
    repeated rows.  Empty tables give empty results.  Other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fp = cut(with_fingerprints(rows, "text", shingle).select("doc_id", "fp"))
    member = with_components(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), radius, blocks)
    lowest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named = member.join(lowest, "component").select("fp", "component_id")
    return fp.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """The rows of docs, with all their columns, less all but one of each component: the one with the smallest id.

    Null ids come last; of rows with equal ids in a component the first in the table stays.  Null and empty texts are alike, and one of
    them stays.  Empty tables give empty results.  Other columns stay as they are, whatever they are called.
    """
    fp, row = fresh(docs.columns, "fp", "row")
    rows = cut(with_fingerprints(docs, text_col, shingle, fp).withColumn(row, F.monotonically_increasing_id()))
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    member = with_components(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("first")), radius, blocks)
    stay = member.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return rows.join(stay, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
