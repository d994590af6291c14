import random
import re
from collections import Counter
from math import floor, log

from pyspark.sql import functions as F

from tessera.llm import lexical_search as ls

from ..conftest import SMALL

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def expected(docs, items, most=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total, df = len(counts), sum(k for *_, k in counts), Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, k in counts:
            m = 10 + 90 * k * n // total
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) & c.keys())
            found += [(-s, i is None, i or 0, i)] if s > 0 else []
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:most], 1)]
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


def made(seed, docs=120, words=30):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)]
    text = lambda: " ".join(r.choices(vocab, weights=[1 / (i + 1) for i in range(words)], k=r.randrange(1, 25)))
    rows = [(i, text()) for i in range(docs)]
    return rows + [(1000 + i, rows[3][1]) for i in range(15)], [(i, text() + " nowhere") for i in range(12)]


def test_search_equals_brute_force_for_any_blocks(spark, monkeypatch):
    docs, items = made(1)
    wanted = expected(docs, items)
    for block, last, once in ((1, 5, 64), (7, 1, 1), (64, 2, 3), (8192, 5, 64)):
        for name, value in (("BLOCK_DOCS", block), ("LAST", last), ("AT_ONCE", once)):
            monkeypatch.setattr(ls, name, value)
        got = ls.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS))
        assert rows_of(got) == wanted


def test_items_in_several_blocks(spark, monkeypatch):
    docs, items = made(2, docs=40)
    monkeypatch.setattr(ls, "ITEMS", 5)
    assert rows_of(ls.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))) == expected(docs, items)


def test_treap_holds_every_cell_and_true_maxima():
    docs, _ = made(3, docs=50)
    counts = [(i, Counter(w.encode() for w in terms(t))) for i, t in docs]
    total = sum(sum(c.values()) for _, c in counts)
    row = ls.treap(counts, len(counts), total)
    words = row["terms"].split(b" ")
    block = ls.Treap(row, {t: k for k, t in enumerate(words)})
    cells, todo = {}, [(0, 0, 0, 0)]
    while todo:
        level, node, r, c = todo.pop()
        if level == block.depth:
            cells[words[r], c] = block.most[node]
            continue
        child = block.child[node]
        for quadrant in range(4):
            if block.mask[node] >> quadrant & 1:
                assert block.most[child] <= block.most[node]
                todo.append((level + 1, child, 2 * r + quadrant // 2, 2 * c + quadrant % 2))
                child += 1
    assert len(cells) == sum(map(len, (c for _, c in counts)))
    of = {i: c for i, c in counts}
    for (word, c), impact in cells.items():
        own = of[int(block.first[0][c])]
        assert impact == 10**9 * own[word] // (1000 * own[word] + 8 * (10 + 90 * sum(own.values()) * len(counts) // total))
    assert max(cells.values()) <= block.most[0] <= max(cells.values()) + ls.STEP


def test_ranges_that_cannot_win_are_left(monkeypatch):
    r = random.Random(4)
    counts = [(i, Counter({b"common": 1, b"rare" if i == 777 else b"x%d" % r.randrange(50): 1})) for i in range(4096)]
    row = ls.treap(counts, 4096, 8192)
    block, opened = ls.Treap(row, {b"common": 0, b"rare": 1}), []
    below = ls.Treap.below
    monkeypatch.setattr(ls.Treap, "below", lambda self, *a: opened.append(len(a[5])) or below(self, *a))
    for last, once, most in ((1, 1, 1_000), (5, 64, 3_000)):  # of 8,191 ranges
        monkeypatch.setattr(ls, "LAST", last)
        monkeypatch.setattr(ls, "AT_ONCE", once)
        opened.clear()
        best = ls.Best(1)
        block.search([0, 1], [1, 9000], best)
        assert [-d for _, d in best.heap] == [777] and sum(opened) < most


def test_long_texts_are_read_whole(spark, monkeypatch):
    monkeypatch.setattr(ls, "SLICE", 10)
    docs = [(1, "alpha beta " * 50 + "gamma"), (2, "delta, ÉÉ-é Alpha"), (3, "x" * 40 + " beta")]
    items = [(1, "gamma Alpha"), (2, "ÉÉ"), (3, "éé"), (4, "x" * 40)]
    assert rows_of(ls.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))) == expected(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "red fox"), (None, "red fox"), (4, "red fox"), (4, "red fox"), (-5, "red fox"), (6, "?!"), (7, "blue"), (8, "blue whale")]
    items = [(1, "fox"), (1, "fox"), (None, "blue"), (3, None), (4, ""), (5, "unseen")]
    d = spark.createDataFrame(docs, DOCS).withColumns({"score": F.lit(1), "rank": F.lit("x"), "item_id": F.lit(0)})
    i = spark.createDataFrame(items, ITEMS).withColumns({"doc_id": F.lit(1), "item": F.lit("x")})
    assert rows_of(ls.search(d, i)) == expected(docs, items)
    assert ls.search(d.limit(0), i).count() == ls.search(d, i.limit(0)).count() == 0


def test_query_agrees_with_its_sql(spark, agrees):
    from tessera.llm.queries import op13_lexical_search

    agrees(op13_lexical_search(spark, SMALL), ls.oracle(), SMALL)
