"""Substring dedup by fixed-block anchors (operator 3).

A repeated window of WINDOW words holds, wherever its copy starts, a whole block of BLOCK words that begins
at a multiple of BLOCK in one of the two places (WINDOW >= 2 * BLOCK - 1).  So:

1. Index: the hashes of all non-overlapping blocks.  Probe: the hashes of all rolling BLOCK-word windows.
   A key that is a block somewhere and occurs at two places is an anchor.
2. Extension: around each anchor, every WINDOW-word window that holds it is keyed again over all its words;
   a window whose key occurs at two places is an exact repeat, and neighbouring ones join to maximal repeats.
3. The words that such windows cover are removed.

Keys travel as packed binary columns, a few bytes each: documents are gathered to units of some hundred rows, as they
lie in the table, whatever their ids, and a row holds a unit's keys for one shard of the key space.  There
are as many shards as the input's size asks for, SHARD_BYTES of text each, so a shard's keys fit in a task.  A passage shared by a
million documents is one key for each unit at most, so no shard, key or group is hot, and no pairs are made.
Keys have 30 bits beside their shard in step 1, where a chance match only costs a check in step 2, and 64
bits in all in step 2, where it would remove a window wrongly: among n windows near anchors n * n / 2 ** 65 such pairs
are to be expected, about 1 in 10 ** 8 windows of 100 TB of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_worker, shuffle_width

WINDOW = 35
BLOCK = 18
UNIT_ROWS, MOST_UNIT_ROWS = 128, 2048
SHARD_BYTES = 256 << 20

ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finishing mix of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def split(text: bytes | None) -> list[bytes]:
    """Words: runs of anything but the space and the characters from tab to carriage return."""
    return (text or b"").split()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD and INVERSE to the powers below n at least."""

    def made(n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = np.full(n, ODD), np.full(n, INVERSE)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)

    kept = for_worker("powers", lambda: [made(1 << 16)])
    if len(kept[0][0]) < n:
        kept[0] = made(1 << (n - 1).bit_length())
    return kept[0]


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:n])))
    return mixed((sums[k:] - sums[:-k]) * down[: n - k + 1] + np.uint64(k))


def gathered(texts: list[bytes | None], piece: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, one after another, and where each text begins among them.

    A word's hash is a polynomial in its bytes, taken from running sums over some half a megabyte at a time."""
    texts = [t or b"" for t in texts]
    text = np.frombuffer(b"\n".join(texts), np.uint8)
    inside = np.concatenate(([False], (text != 32) & ((text < 9) | (text > 13)), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    hashes = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + piece)))
        low, high = int(starts[at]), int(ends[to - 1])
        up, down = powers(high - low + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((text[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low])))
        a, b = starts[at:to] - low, ends[at:to] - low
        hashes[at:to] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return hashes, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all windows of k words, and which of them lie in one text."""
    keys = rolling(hashes, k)
    inside = np.ones(len(keys), bool)
    for e in begins[1:-1].tolist():
        inside[max(0, e - k + 1) : e] = False
    return keys, inside


def to_shards(keys: np.ndarray, aligned: np.ndarray | None, shards: int, bits: int) -> Iterator[tuple[int, bytes]]:
    """A unit's keys by shard.  Two low bits: the key is met twice here; it is a block here."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    twice = np.diff(np.append(first, len(keys))) > 1
    block = np.logical_or.reduceat(aligned[order], first) if aligned is not None else np.ones(len(first), bool)
    keys = keys[first]
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)  # sorted, as the keys are
    body = (keys & np.uint64((1 << bits) - 1)) << np.uint64(2) | twice.astype(np.uint64) << np.uint64(1) | block.astype(np.uint64)
    body = body.astype("<u4" if bits == 30 else "<u8")
    at = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(shard[a]), body[a:b].tobytes()


def repeated(keyed: DataFrame, bits: int) -> DataFrame:
    """(unit, keys): the keys of each unit that occur at two places and are a block at one, from (shard, unit, keys)."""
    kind = "<u4" if bits == 30 else "<u8"

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["keys"].map(len).to_numpy() // np.dtype(kind).itemsize
        all_keys = np.frombuffer(b"".join(pdf["keys"]), kind)
        unit = np.repeat(np.arange(len(pdf)), sizes)
        order = np.argsort(all_keys >> np.array(2, kind), kind="stable")
        flags, keys = all_keys[order] & np.array(3, kind), all_keys[order] >> np.array(2, kind)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
        size = np.diff(np.append(first, len(keys)))
        any_flag = np.bitwise_or.reduceat(flags, first) if len(first) else flags
        good = np.repeat((any_flag & 1 == 1) & ((size > 1) | (any_flag & 2 == 2)), size)
        hit_unit, hit_keys = unit[order][good], keys[good]
        by = np.argsort(hit_unit, kind="stable")
        hit_unit, hit_keys = hit_unit[by], hit_keys[by]
        at = np.flatnonzero(np.concatenate(([True], hit_unit[1:] != hit_unit[:-1], [True]))) if len(by) else np.zeros(1, int)
        units = pdf["unit"].to_numpy()
        return pd.DataFrame(
            {
                "unit": [units[hit_unit[a]] for a in at[:-1]],
                "shard": np.full(len(at) - 1, pdf["shard"].iloc[0] if len(pdf) else 0),
                "keys": [hit_keys[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)],
            }
        )

    return keyed.groupBy("shard").applyInPandas(shard, "unit long, shard int, keys binary")


def among(keys: np.ndarray, back: pd.DataFrame, shards: int, bits: int) -> np.ndarray:
    """Which keys are among those that came back to this unit."""
    if not len(back) or not len(keys):
        return np.zeros(len(keys), bool)
    parts = [np.frombuffer(k, "<u4" if bits == 30 else "<u8").astype(np.uint64) for k in back["keys"]]
    low = np.uint64((1 << bits) - 1)
    if bits == 62:
        return np.isin(keys & low, np.concatenate(parts))
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    named = [part | np.uint64(s << bits) for part, s in zip(parts, back["shard"].tolist(), strict=True)]
    return np.isin(keys & low | shard << np.uint64(bits), np.concatenate(named))


def spread(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Places covered by runs of length that begin where starts is true."""
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[np.minimum(at + length, n)] -= 1
    return np.cumsum(edge[:n]) > 0


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shards: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    A word goes if a window of that many words covers it whose words also start anywhere else, in the same
    text or another, repeated rows included.  Null and empty texts have no words and keep nothing; texts
    shorter than the window keep all.  Rows with null or equal ids are judged like any other.  Empty tables give
    empty results.  Other columns are not read.
    """
    block = (window + 1) // 2
    n = shuffle_width(docs.sparkSession)
    text = F.col(text_col).cast("binary")
    if not shards:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        shards = max(n, ceil(size / SHARD_BYTES))
    unit_rows = min(MOST_UNIT_ROWS, UNIT_ROWS * ceil(shards / 1024))  # a row's keys get fewer as shards get more
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.expr(f"monotonically_increasing_id() div {unit_rows}").alias("unit"))
    rows = rows.repartition(n, "unit")  # all three uses share this exchange

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = b.column("unit").to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(np.concatenate((units[1:] != units[:-1], [True]))) + 1 if len(units) else []
            at = 0
            for end in ends:
                hashes, begins = gathered(b.column("text").slice(at, end - at).to_pylist())
                keys, inside = windows(hashes, begins, block)
                place = np.arange(len(keys)) - np.repeat(begins[:-1], np.diff(begins))[: len(keys)]
                found = list(to_shards(keys[inside], (place % block == 0)[inside], shards, 30))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in found], pa.int32()), pa.array([units[at]] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary())],
                    ["shard", "unit", "keys"],
                )
                at = end

    anchors = repeated(rows.sortWithinPartitions("unit").mapInArrow(probe, "shard int, unit long, keys binary"), 30)

    def extend(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found, unit = [], left["unit"].iloc[0] if len(left) else -1
        if len(left) and len(right):
            hashes, begins = gathered(left["text"].tolist())
            keys, inside = windows(hashes, begins, block)
            near = among(keys, right, shards, 30) & inside
            whole, inside = windows(hashes, begins, window)
            held = np.concatenate((np.zeros(1, int), np.cumsum(near)))
            beside = held[window - block + 1 :][: len(whole)] > held[: len(whole)]
            found = list(to_shards(whole[beside & inside], None, shards, 62))
        return pd.DataFrame({"shard": [s for s, _ in found], "unit": [unit] * len(found), "keys": [x for _, x in found]})

    def erase(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hashes, begins = gathered(left["text"].tolist())
        lost = np.zeros(len(hashes), bool)
        if len(right):
            keys, inside = windows(hashes, begins, window)
            lost = spread(among(keys, right, shards, 62) & inside, len(hashes), window)
        kept = [
            split(t) if not lost[a:b].any() else list(compress(split(t), (~lost[a:b]).tolist()))
            for t, a, b in zip(left["text"], begins[:-1], begins[1:], strict=True)
        ]
        n_words = np.diff(begins)
        return pd.DataFrame(
            {
                "doc_id": left["doc_id"].astype("Int64"),
                "n_words": n_words,
                "n_removed": n_words - np.array([len(k) for k in kept], int),
                "kept": [b" ".join(k).decode("utf-8", "replace") for k in kept],
            }
        )

    exact = repeated(
        rows.groupBy("unit").cogroup(anchors.groupBy("unit")).applyInPandas(extend, "shard int, unit long, keys binary"), 62
    )
    return rows.groupBy("unit").cogroup(exact.groupBy("unit")).applyInPandas(erase, "doc_id long, n_words long, n_removed long, kept string")


def digest(kept: DataFrame) -> DataFrame:
    """The digest columns of repeated_words()."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def oracle() -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i)),
r AS (SELECT win FROM g GROUP BY win HAVING count(*) > 1),
h AS (SELECT doc_id, list(i) AS starts FROM g JOIN r USING (win) GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id, s + k AS p FROM h, unnest(starts) AS a(s), unnest(range({WINDOW})) AS b(k)),
e AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM e ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
