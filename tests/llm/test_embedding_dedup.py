import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup as E

from ..conftest import MID


def truth(rows, cosine=E.COSINE):
    """{id: links} and {id: smallest reachable id}, by comparing all."""
    links, root = {i: set() for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fine = [(i, np.array(v, float), x) for i, v, x in rows if v is not None and x is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    for n, (i, v, x) in enumerate(fine):
        for j, w, y in fine[n + 1 :]:
            if x == y and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= cosine:
                links[i].add(j)
                links[j].add(i)
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: len(s) for i, s in links.items()}, {i: find(i) for i in root}


def clusters(n=12, size=25, dim=64, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        centre = rng.standard_normal(dim)
        for _ in range(size):
            v = centre + rng.standard_normal(dim) * rng.choice([0.02, 0.1, 0.3])
            rows.append((len(rows), (v * rng.choice([1.0, 5.0])).tolist(), c % 3))
    return rows


@pytest.mark.parametrize("dim", [32, 64, 256])
def test_recall_of_pairs_at_the_threshold_for_every_number_of_filters(dim):
    rng = np.random.default_rng(11)
    x = E.unit(rng.standard_normal((1500, dim)))
    side = rng.standard_normal((1500, dim))
    side = E.unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    for codes in (16, 64, 256, 1024):
        f = E.Filters(dim, codes)
        for cosine, least in ((0.93, 0.99), (0.96, 0.995), (0.99, 0.999)):
            a, b = f.decode(x), f.decode(cosine * x + (1 - cosine**2) ** 0.5 * side)
            assert np.mean([np.intersect1d(p, q).size > 0 for p, q in zip(a, b, strict=True)]) >= least


def test_comparisons_grow_in_proportion_to_the_vectors(spark):
    rng = np.random.default_rng(5)
    sizes = [400, 4_000, 40_000]
    codes = [r.c for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(E.codes_for(F.col("n")).alias("c")).collect()]
    assert codes == sorted(codes) and codes[0] == E.LEAST_CODES < codes[2]
    each = []
    for n, c in zip(sizes, codes, strict=True):
        found = E.Filters(64, c).decode(E.unit(rng.standard_normal((n, 64))))
        each.append((np.bincount(found.ravel()).astype(float) ** 2).sum() / n)
    assert each[2] < 4 * each[1] and each[2] < E.BUCKET * 2 * E.list_size(codes[2])


def test_list_decoding_finds_the_nearest_filters():
    for parts in (1, 2, 3):
        f = E.Filters(12, parts=parts, codes=8, size=6)
        x = E.unit(np.random.default_rng(1).standard_normal((40, 12)))
        total = np.zeros((40, 1))
        for s in f.scores(x):
            total = (total[:, :, None] + s[:, None, :]).reshape(40, -1)
        assert (f.decode(x) == np.sort(np.argsort(-total, axis=1, kind="stable")[:, :6], axis=1)).all()


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, id int")
    return E.embedding_components(df, **how).collect()


def test_links_against_brute_force(spark):
    rows = clusters()
    rows += [(len(rows) + k, rows[3][1], rows[3][2]) for k in range(6)] + [(900, rows[3][1], 7)]
    links, comp = truth(rows)
    for hot in (2048, 8):
        got = run(spark, rows, hot_bucket=hot)
        assert all(r.n_links <= links[r.vec_id] for r in got)
        assert sum(r.n_links for r in got) >= 0.97 * sum(links.values())
        assert np.mean([r.component_id == comp[r.vec_id] for r in got]) > 0.97
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
        assert len(got) == len(rows)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, None, 1), (4, [1.0, None, 3.0], 1), (5, [0.0, 0.0, 0.0], 1), (6, [float("nan"), 1.0, 1.0], 1),
            (7, [float("inf"), 1.0, 1.0], 1), (8, v, None), (9, v, 2), (10, [1.0, 2.0], 1), (11, [2e200, 4e200, 6e200], 1), (None, v, 1), (12, [], 1)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in run(spark, rows))
    linked = [("1", 4, 1), ("2", 4, 1), ("2", 4, 1), ("11", 4, 1), ("None", 4, 1)]
    assert got == sorted(linked + [(str(i), 0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12)])
    assert run(spark, []) == []


def test_agrees_with_sql(spark, agrees):
    agrees(E.embedding_components(spark.read.parquet(f"{MID}/embeddings.parquet")), E.oracle(), MID)
