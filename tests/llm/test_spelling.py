import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import spelling as sp

from ..conftest import SMALL

SCHEMA = "doc_id long, text string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def counts_of(rows, every=97):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % every == 0 else low] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def expected_of(n):
    other, form, out = {w: [v for v in n if near(w, v)] for w in n}, {}, set()
    for w in n:
        best = min(other[w], key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(other[w]), n[form[w]] if w in form else None))
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(seed, words=60, letters="abcdé"):
    r = random.Random(seed)
    vocab = ["".join(r.choices(letters, k=r.randrange(5, 8))) for _ in range(words)]
    return [(i, " ".join(r.choices(vocab, weights=range(1, words + 1), k=40)).replace("a", "A") + "×") for i in range(40)]


def test_composed_pairs_are_all_near_pairs_once():
    r = random.Random(2)
    for _ in range(150):
        words = sorted({"".join(r.choices("abc"[: r.randrange(1, 4)], k=r.randrange(7))) for _ in range(r.randrange(50))})
        got = sorted(tuple(sorted(p)) for p in sp.Acceptor(words).pairs())
        assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])]


def test_acceptor_is_minimal_and_deep_words_are_no_recursion():
    words = sorted(a + b for a in ("ab", "cd", "ef") for b in ("ing", "ings", "ed"))
    assert len(sp.Acceptor(words).final) == 10  # the start, three second letters, and six states of the endings that all share
    long = "xy" * 20_000
    assert sp.near_in(sorted([long, long + "z", "a" + long]), [1, 2, 3])[0] == [1, 2, 1]


def test_words_are_counted_with_their_missing_letters(spark):
    rows = made(1)
    got = {r["word"]: r["n"] for r in sp.word_counts(spark.createDataFrame(rows, SCHEMA), every=5).collect()}
    assert got == counts_of(rows, every=5)


def test_groups_equal_brute_force_at_any_group_size(spark):
    rows = made(4) + made(5, letters="ab")
    expected = expected_of(counts_of(rows, every=5))
    assert any(form and root != form for _, form, root, *_ in expected)  # chains of forms
    for group_words in (5, 1_000):
        assert rows_of(sp.spelling_groups(spark.createDataFrame(rows, SCHEMA), group_words=group_words, every=5)) == expected


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(sp.spelling_groups(docs, group_words=200)) == expected_of(counts_of(rows))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "houses houses Houses"), (3, "house"), (3, "house"), (4, "house House house tiny tiny tiny"), (5, "straße " * 3)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"word": F.lit("x"), "n": F.lit(1), "hot": F.lit(2)})
    assert rows_of(sp.spelling_groups(df)) == expected_of(counts_of(rows))
    assert sp.spelling_groups(df.limit(0)).count() == 0
