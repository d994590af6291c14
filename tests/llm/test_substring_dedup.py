import hashlib
import random
import re
from collections import Counter

from tessera.llm import substring_dedup as S

from ..conftest import MID


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {p for s in range(len(w) - window + 1) if seen[tuple(w[s : s + window])] > 1 for p in range(s, s + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df, **how):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in S.digest(S.repeated_words(df, **how)).collect())


def test_matches_brute_force_on_shared_passages(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = [fresh(n) for n in (34, 35, 36, 50, 90)]
    rows = []
    for i in range(60):
        text = fresh(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            text += rng.choice(shared) + fresh(rng.randrange(20))
        rows.append((rng.choice([i, i * 1000]), " \n".join(text)))
    rows += [(7, None), (8, ""), (None, " ".join(shared[4])), (9, "a " * 80), (10, "a b " * 9000), (11, rows[0][1]), (11, rows[0][1]), (12, "é\xa0x " * 40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, unit int")
    for window in (35, 8):
        assert got(df, window=window) == brute(rows, window)
    assert got(df, shards=3) == brute(rows, 35)
    assert got(df.limit(0)) == []


def test_rows_without_ids_and_a_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None if i % 3 else 5, f"own{i} {passage} end{i}") for i in range(700)] + [(6, " ".join(f"v{i}" for i in range(200_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df) == brute(rows, 35)


def test_texts_are_shuffled_once(spark):
    df = S.digest(S.repeated_words(spark.read.parquet(f"{MID}/documents.parquet")))
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 2


def test_agrees_with_sql(spark, agrees):
    agrees(S.digest(S.repeated_words(spark.read.parquet(f"{MID}/documents.parquet"))), S.oracle(), MID)
