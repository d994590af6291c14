import hashlib
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.llm import line_dedup as L

from ..conftest import MID


def brute(rows, min_lines, min_words):
    """(kept text, longest_copy) by id, for ids that are unique and not null."""
    order = sorted(rows)
    lines = {i: (t or "").split("\n") for i, t in order}
    seen, longest, gone = set(), {}, set()
    for i, _ in order:
        own = lines[i]
        for p in range(len(own)):
            n = 0
            while p + n < len(own) and own[p + n].strip():
                n += 1
                run = tuple(own[p : p + n])
                if run in seen:
                    longest[i, p] = n
                seen.add(run)
    for (i, p), n in longest.items():
        run = lines[i][p : p + n]
        if longest.get((i, p - 1)) != n + 1 and (n >= min_lines or sum(len(x.split()) for x in run) >= min_words):
            gone |= {(i, p + k) for k in range(n)}
    return {i: ("\n".join(x for p, x in enumerate(own) if (i, p) not in gone), max([n for (j, _), n in longest.items() if j == i], default=0)) for i, own in lines.items()}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n", max_size=30) | st.none(), min_size=1, max_size=8), st.integers(1, 5), st.integers(1, 6))
def test_matches_brute_force(spark, texts, min_lines, min_words):
    rows = list(enumerate(texts))
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_lines=min_lines, min_words=min_words).collect()
    assert {r.doc_id: (r.text, r.longest_copy) for r in got} == brute(rows, min_lines, min_words)


def test_runs_of_every_length(spark):
    rng = random.Random(3)
    base = [f"line {i} of all" if i % 3 else f"l{i}" for i in range(60)]
    rows = [(0, "\n".join(base))]
    for i in range(1, 40):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            at, n = rng.randrange(60), rng.randrange(1, 20)
            parts += base[at : at + n] + rng.choice([[], [""], [f"own {rng.random()}"]])
        rows.append((i, "\n".join(parts)))
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.text, r.longest_copy) for r in got} == brute(rows, L.MIN_LINES, L.MIN_WORDS)


def test_edges(spark):
    rows = [(None, "x\ny", "k"), (1, "x\nz", "l"), (1, "x\nz", "m"), (2, "x\ny\n\n x", "n"), (3, None, "o"), (4, "", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    got = sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_removed, r.k1) for r in L.dedup_lines(df, min_lines=1).collect()), key=str)
    assert got == sorted([(0, "x\ny", 2, 0, "k"), (1, "z", 2, 1, "l"), (1, "z", 2, 1, "m"), (2, "\n x", 4, 2, "n"), (3, "", 1, 0, "o"), (4, "", 1, 0, "p")], key=str)
    assert all(r.n_removed == 0 for r in L.dedup_lines(df).collect())
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_names_that_clash(spark):
    names = "k1 k2 gone kept lines found pos rank first n_lines n_removed longest_copy".split()
    df = spark.createDataFrame([(i, "one line of five words\nand more", *names) for i in range(3)], ["doc_id", "text", *names])
    got = L.dedup_lines(df, report=False)
    assert got.columns == df.columns and sorted(r.text for r in got.collect()) == ["", "", "one line of five words\nand more"]
    assert all(tuple(r)[2:] == tuple(names) for r in got.collect())
    assert L.dedup_lines(df).columns == [c for c in df.columns if c not in ("n_lines", "n_removed", "longest_copy")] + ["n_lines", "n_removed", "longest_copy"]


def test_long_text_with_many_repeats(spark):
    text = "\n".join(f"line {i % 700}" for i in range(3000))
    (r,) = L.digest(L.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert (r.n_removed, r.longest_copy) == (2300, 2300)
    assert r.kept_sha256 == hashlib.sha256("\n".join(f"line {i}" for i in range(700)).encode()).hexdigest()
    (r,) = L.dedup_lines(spark.createDataFrame([(1, "same\n" * 3000)], "doc_id long, text string")).collect()
    assert (r.text, r.longest_copy) == ("same\n", 2999)


def test_agrees_with_sql(spark, agrees):
    agrees(L.digest(L.dedup_lines(spark.read.parquet(f"{MID}/documents.parquet"))), L.oracle(), MID)


def test_no_python_on_the_executors(spark):
    plan = L.dedup_lines(spark.read.parquet(f"{MID}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
