import math
import random
from collections import Counter

from tessera.llm import license_scan as L

from ..conftest import MID


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    return [r.asDict() for r in L.license_scan(df).orderBy("doc_id").collect()]


def test_places_and_labels(spark):
    got = scan(spark, [None, "", "MIT-License and the mit  license.", "Released under the MIT License, (c) 2020", "gnu general public", "CC BY cc by", "mit"])
    assert [r["n_base"] for r in got] == [0, 0, 2, 1, 0, 2, 0]
    assert [(r["first_word"], r["last_word"]) for r in got] == [(None, None), (None, None), (0, 4), (3, 3), (None, None), (0, 2), (None, None)]
    assert [r["labels"] for r in got] == ["", "", "mit", "mit,mit-notice", "", "cc-by", ""]
    assert [r["n_words"] for r in got] == [0, 0, 6, 7, 3, 4, 1]
    assert got[4]["score"] == 0.0 and got[3]["score"] == 1.0


def test_neighbouring_diagonals_are_merged(spark):
    text, label = max(L.TEMPLATES, key=lambda t: len(t[0]))
    words = text.split()
    broken = words[:9] + ["extra"] + words[9:20] + words[21:]
    got = scan(spark, [" ".join(broken), " ".join(words[: len(words) // 2])])
    assert label in got[0]["labels"].split(",") and 0.85 <= got[0]["score"] <= 1
    assert label not in got[1]["labels"].split(",")


def verified(words, template):
    """The best verified cover of a template, by plain loops over texts' word pairs."""
    need, pairs = len(template) - 1, list(zip(words, words[1:]))
    hits = [(p, a) for p, x in enumerate(pairs) for a, y in enumerate(zip(template, template[1:])) if x == y]
    votes = Counter(p - a for p, a in hits)
    best = 0
    for d, n in votes.items():
        if n < max(votes.get(d + k, 0) for k in range(-L.NEIGHBOURS, L.NEIGHBOURS + 1)):
            continue
        first, last, held = {}, -1, 0
        for p, a in sorted(hits, key=lambda h: (h[1], abs(h[0] - h[1] - d), h[0])):
            if abs(p - a - d) <= L.NEIGHBOURS and a not in first:
                first[a] = p
        for a in sorted(first):
            if first[a] > last:
                last, held = first[a], held + 1
        best = max(best, held)
    return best / need if best >= math.ceil(need * L.COVERAGE) else 0.0


def test_spans_are_verified_against_brute_force(spark):
    rng = random.Random(8)
    template, label = max(L.TEMPLATES, key=lambda t: len(t[0]))
    template = template.split()
    texts = []
    for _ in range(60):
        words = list(template)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(3)] = rng.sample(template, rng.randrange(3))
        texts.append(" ".join(words))
    texts += [" ".join(template[i : i + 2] * 2) for i in range(5)] + [" ".join(template[10:] + template[:10])]
    for text, row in zip(texts, scan(spark, texts), strict=True):
        want = verified(text.split(), template)
        assert (label in row["labels"].split(",")) == (want > 0)
        if want:
            assert abs(row["score"] - want) < 1e-9 or row["n_base"]


def test_only_ascii_letters_are_lower_cased(spark):
    got = scan(spark, ["This wor\u212a is licensed under the GNU General Public License version 3", "This worK is licensed under the GNU General Public License version 3", "m\u0130t license"])
    assert [r["labels"] for r in got] == ["gpl", "gpl,gpl-3.0", ""] and [r["score"] for r in got] == [1.0, 1.0, 0.0]
    assert got[0]["n_words"] == 12


def test_repeated_rows_empty_tables_and_long_texts(spark):
    df = spark.createDataFrame([(1, "mit license " * 5000), (1, "mit license " * 5000), (None, "apache license")], "doc_id long, text string")
    got = L.license_scan(df).collect()
    assert sorted((r.doc_id or 0, r.n_base, r.last_word) for r in got) == [(0, 1, 0), (1, 5000, 9998), (1, 5000, 9998)]
    assert L.license_scan(df.limit(0)).count() == 0


def test_agrees_with_sql(spark, agrees):
    df = L.license_scan(spark.read.parquet(f"{MID}/documents.parquet"))
    agrees(df, L.oracle(), MID)
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
