"""Ranked lexical search over K2-treaps (operator 13).

1. One pass counts N, the documents with a term, and L, all terms.
2. Documents are dealt as they lie to blocks of bounded bytes; a block's grid has a row for each of its terms and a column for each
   document, and a cell's value is the term's impact there.  The grid becomes a K2-treap: a quadtree of which only
   quadrants that hold something are kept, four bits a node, with the largest impact below each node (inner ones rounded up to
   a byte, those of cells exact).  The blocks are a table, the index; it knows nothing of the items.
3. The items' document frequencies are sums over the blocks' terms.
4. In each block an item's terms are rows, whose paths go down the tree together over ranges of documents, best first: a range's
   bound is the weighted sum of its rows' maxima, and ranges that can't reach the item's tenth best so far are left.
   A cell's bound is the score itself.  Ranges are opened some at a time, small ones down to their cells.
5. Each task hands on its best documents of each item, and a window ranks them.

Items are taken in blocks of bounded size; no document is left out and no score is rounded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush, heapreplace
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BEST = 10
BLOCK_DOCS, BLOCK_BYTES = 8192, 8 << 20
ITEMS, ITEM_BYTES = 1024, 4 << 20  # items that are searched for in one pass over the index
STEP = 4096  # inner maxima are whole numbers of steps
AT_ONCE = 64  # ranges that are opened together
LAST = 5  # a range of 2 ** LAST documents is opened down to its cells
SLICE = 1 << 20
NO_ID = (1 << 63) - 1  # stands for null ids
ALIKE = 16
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
ONES = np.array([bin(m).count("1") for m in range(16)], np.int64)
INDEX = "docs long, depth int, ids binary, terms binary, df binary, masks binary, maxima binary, impacts binary"


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, a slice at a time."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(TABLE)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def sizes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """N and L."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [sum(map(len, terms_of(t.as_py()))) for t in b.column(0)]
            yield pa.RecordBatch.from_pydict({"docs": pa.array([sum(map(bool, n))], pa.int64()), "terms": pa.array([sum(n)], pa.int64())})

    got = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return got[0] or 0, got[1] or 0


def spread(x: np.ndarray) -> np.ndarray:
    """The bits of x with a gap after each."""
    x = x.astype(np.uint64)
    for shift in (16, 8, 4, 2, 1):
        keep = sum(((1 << shift) - 1) << at for at in range(0, 64, 2 * shift))
        x = (x | x << np.uint64(shift)) & np.uint64(keep)
    return x


def squeezed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def restored(raw: bytes, dtype: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True) if n else b"", dtype)


def treap(docs: list[tuple[int | None, Counter]], n_docs: int, n_terms: int) -> dict:
    """The index row of a block: docs with their term counts."""
    docs = sorted(docs, key=lambda d: NO_ID if d[0] is None else d[0])
    number: dict[bytes, int] = {}
    rows = np.array([number.setdefault(t, len(number)) for _, c in docs for t in c], np.int64)
    tf = np.array([k for _, c in docs for k in c.values()], np.int64)
    cols = np.repeat(np.arange(len(docs)), [len(c) for _, c in docs])
    m = np.array([10 + 90 * sum(c.values()) * n_docs // n_terms for _, c in docs], np.int64)
    impact = 10**9 * tf // (1000 * tf + 8 * m[cols])
    df = np.bincount(rows, minlength=len(number))
    order = np.argsort(-df, kind="stable")  # frequent terms lie together
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    frequent, has = np.flatnonzero(place[rows] < ALIKE), np.zeros(len(docs), np.int64)
    np.bitwise_or.at(has, cols[frequent], 1 << (ALIKE - 1 - place[rows[frequent]]))
    by = np.argsort(-has, kind="stable")  # so do documents with the same frequent terms
    at = np.empty_like(by)
    at[by] = np.arange(len(by))
    docs, cols = [docs[i] for i in by.tolist()], at[cols]
    terms = list(number)
    depth = max(1, (len(terms) - 1).bit_length(), (len(docs) - 1).bit_length())
    code = spread(place[rows]) << np.uint64(1) | spread(cols)
    by = np.argsort(code)
    code, most = code[by], impact[by]
    masks, maxima, cells = [], [], most
    for _ in range(depth):
        up = code >> np.uint64(2)
        first = np.flatnonzero(np.concatenate(([True], up[1:] != up[:-1])))
        masks.append(np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), first))
        most = np.maximum.reduceat(most, first)
        maxima.append((-(-most // STEP)).astype(np.uint8))
        code = up[first]
    mask, most = np.concatenate(masks[::-1]), np.concatenate(maxima[::-1])
    return {
        "docs": len(docs),
        "depth": depth,
        "ids": np.array([NO_ID if i is None else i for i, _ in docs], "<i8").tobytes(),
        "terms": b" ".join(terms[i] for i in order.tolist()),
        "df": df[order].astype("<u4").tobytes(),
        "masks": np.uint32(len(mask)).tobytes() + squeezed(mask),
        "maxima": squeezed(most),
        "impacts": np.uint32(len(cells)).tobytes() + squeezed(cells.astype("<u4")),
    }


def index(docs: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks of docs, of which N and L are given.  Documents without terms are in no block."""
    names = [f.split()[0] for f in INDEX.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            got = treap(block, n_docs, n_terms)
            return pa.RecordBatch.from_arrays([pa.array([got[n]], k) for n, k in zip(names, kinds, strict=True)], names)

        block, size = [], 0
        for b in batches:
            for i, text in zip(b.column(0), b.column(1), strict=True):
                count, text = Counter(), text.as_py()
                for terms in terms_of(text):
                    count.update(terms)
                if count:
                    block.append((i.as_py(), count))
                    size += len(text)
                if size >= BLOCK_BYTES or len(block) >= BLOCK_DOCS:
                    yield row()
                    block, size = [], 0
        if block:
            yield row()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, INDEX)


def frequencies(blocks: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """The document frequencies of the given terms."""
    need = {t: k for k, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(need), np.int64)
        for b in batches:
            for words, df in zip(b.column(0), b.column(1), strict=True):
                df = np.frombuffer(df.as_py(), "<u4")
                for i, t in enumerate(words.as_py().split(b" ")):
                    if (k := need.get(t)) is not None:
                        total[k] += df[i]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(at, pa.int64()), "df": pa.array(total[at], pa.int64())})

    got = blocks.select("terms", "df").mapInArrow(run, "k long, df long").groupBy("k").agg(F.sum("df").alias("df")).collect()
    return {terms[r["k"]]: r["df"] for r in got}


class Best:
    """The best documents of an item so far: higher scores first, then smaller ids."""

    def __init__(self, most: int):
        self.most, self.heap = most, []

    def may_enter(self, bound: float, first_id: int) -> bool:
        return bound > 0 and (len(self.heap) < self.most or (bound, -first_id) > self.heap[0])

    def least(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.most else 0

    def offer(self, score: int, doc: int) -> None:
        if len(self.heap) < self.most:
            heappush(self.heap, (score, -doc))
        elif (score, -doc) > self.heap[0]:
            heapreplace(self.heap, (score, -doc))


class Treap:
    """A block of the index, opened for descent; nodes are numbered from the root, level by level."""

    def __init__(self, row: dict, need: dict[bytes, int]):
        self.depth = row["depth"]
        ids = np.full(1 << self.depth, NO_ID)
        ids[: row["docs"]] = np.frombuffer(row["ids"], "<i8")
        self.first = [ids]  # the smallest id of each range, by the logarithm of its width
        for _ in range(self.depth):
            self.first.append(self.first[-1].reshape(-1, 2).min(axis=1))
        inner, cells = (int(np.frombuffer(row[c][:4], np.uint32)[0]) for c in ("masks", "impacts"))
        self.mask = restored(row["masks"][4:], "u1", inner)
        self.most = np.concatenate((restored(row["maxima"], "u1", inner) * float(STEP), restored(row["impacts"][4:], "<u4", cells).astype(float)))
        self.child = 1 + np.concatenate(([0], np.cumsum(ONES[self.mask])[:-1]))
        self.row = {need[t]: i for i, t in enumerate(row["terms"].split(b" ")) if t in need}

    def below(self, rows: np.ndarray, weight: np.ndarray, slot: np.ndarray, term: np.ndarray, node: np.ndarray, level: np.ndarray, least: float):
        """The halves of ranges that may reach `least`: their places (twice a range's place, and one for its second half), their
        bounds, and their rows and nodes with the place of the half among those that are left."""
        mask = self.mask[node]
        lower = rows[term] >> (self.depth - 1 - level[slot]) & 1
        found = []
        for side in (0, 1):
            quadrant = 2 * lower + side
            there = np.flatnonzero(mask >> quadrant & 1)
            before = ONES[mask[there] & ((1 << quadrant[there]) - 1)]
            found.append((2 * slot[there] + side, term[there], self.child[node[there]] + before))
        into, term, node = (np.concatenate(x) for x in zip(*found, strict=True))
        bounds = np.bincount(into, weights=weight[term] * self.most[node], minlength=2 * len(level))
        left = np.flatnonzero(bounds >= max(least, 1))
        place = np.full(len(bounds), -1)
        place[left] = np.arange(len(left))
        into = place[into]
        keep = np.flatnonzero(into >= 0)
        return left, bounds[left], into[keep], term[keep], node[keep]

    def search(self, terms: list[int], weights: list[int], best: Best) -> None:
        have = [(self.row[t], w) for t, w in zip(terms, weights, strict=True) if t in self.row and w]
        if not have:
            return
        rows, weight = np.array([r for r, _ in have]), np.array([w for _, w in have], float)
        last = max(0, self.depth - LAST)
        # a range: bound, its smallest id, its level, its column there, its rows and their nodes
        heap = [(-float(weight.sum() * self.most[0]), int(self.first[self.depth][0]), 0, 0, np.arange(len(rows)), np.zeros(len(rows), np.int64))]
        while heap:
            opened, small = [], []
            while heap and len(opened) + len(small) < AT_ONCE:
                if not best.may_enter(-heap[0][0], heap[0][1]):
                    heap.clear()  # nor may those after it
                    break
                (small if heap[0][2] == last else opened).append(heappop(heap))
            for ranges, to in ((opened, 1), (small, self.depth - last)):
                if not ranges:
                    continue
                slot = np.repeat(np.arange(len(ranges)), [len(x[4]) for x in ranges])
                term, node = np.concatenate([x[4] for x in ranges]), np.concatenate([x[5] for x in ranges])
                level, col = np.array([x[2] for x in ranges]), np.array([x[3] for x in ranges])
                for _ in range(to):
                    half, bounds, slot, term, node = self.below(rows, weight, slot, term, node, level, best.least())
                    col, level = 2 * col[half >> 1] + (half & 1), level[half >> 1] + 1
                if ranges is small:
                    ids = self.first[0][col]
                    for k in np.lexsort((ids, -bounds))[: best.most].tolist():
                        best.offer(int(bounds[k]), int(ids[k]))
                    continue
                order = np.argsort(slot, kind="stable")
                term, node = term[order], node[order]
                ends = np.searchsorted(slot[order], np.arange(len(col) + 1)).tolist()
                for k, (bound, at, c) in enumerate(zip(bounds.tolist(), level.tolist(), col.tolist(), strict=True)):
                    heappush(heap, (-bound, int(self.first[self.depth - at][c]), at, c, term[ends[k] : ends[k + 1]], node[ends[k] : ends[k + 1]]))


def found_in(blocks: DataFrame, items: list[list[bytes]], n_docs: int, most: int) -> DataFrame:
    """(item, id, score): the best documents of each item, numbered as given, of each task."""
    terms = sorted({t for i in items for t in i})
    df, need = frequencies(blocks, terms), {t: k for k, t in enumerate(terms)}
    weight = {need[t]: floor(1000 * log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = [[need[t] for t in i if t in df] for i in items]
    need = {t: k for t, k in need.items() if t in df}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(most) for _ in asked]
        for b in batches:
            for at in range(b.num_rows):
                block = Treap(b.slice(at, 1).to_pylist()[0], need)
                for terms, own in zip(asked, best, strict=True):
                    block.search(terms, [weight[t] for t in terms], own)
        rows = [(i, None if doc == -NO_ID else -doc, score) for i, own in enumerate(best) for score, doc in own.heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["item", "id", "score"])

    return blocks.mapInArrow(run, "item long, id long, score long")


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items with their terms, once each, in blocks of bounded size."""
    block, size = [], 0
    for item, text in items.select(id_col, text_col).toLocalIterator():
        block.append((item, list(dict.fromkeys(t for part in terms_of(text) for t in part))))
        size += len(text or "")
        if len(block) >= ITEMS or size >= ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = BEST
) -> DataFrame:
    """One row per item and found document: item_id, rank, doc_id, score.

    Nulls: a null text has no terms; rows with null ids are ranked like any other, after other ids where scores are equal.
    Repeated documents and repeated items are rows of their own.  Very long texts are counted whole.  An item without terms, or
    none of them in any document, has no row; empty tables give none.  Other columns are not read.
    """
    spark, kind = docs.sparkSession, items.schema[item_col].dataType.simpleString()
    n_docs, n_terms = sizes(docs, text_col)
    blocks = cut(index(docs, n_docs, n_terms, id_col, text_col)) if n_terms else None
    out = [spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")]
    for asked in item_blocks(items, item_col, item_text_col) if blocks else ():
        found = found_in(blocks, [terms for _, terms in asked], n_docs, most)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(asked)], f"item long, item_id {kind}")
        out.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score"))  # at most ITEMS names
    return reduce(DataFrame.unionByName, out[1:] or out)


def oracle() -> str:
    """The DuckDB twin of the query."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all({lower.format("text")}, '{term}')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
    n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
    g AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM n),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({lower.format("text")}, '{term}')) AS term FROM benchmark),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, g),
    s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
          FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), g GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
