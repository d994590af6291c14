import random
import re

import numpy as np
import xxhash

from tessera.llm import simhash as H

from ..conftest import MID


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=4):
    """{fingerprint: smallest reachable fingerprint}, by comparing all."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    array = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= radius).tolist():
            a, b = find(f), find(fps[i + 1 + j])
            root[max(a, b)] = min(a, b)
    return {f: find(f) for f in fps}


def expected(ids_fps):
    comp, low = components(f for _, f in ids_fps), {}
    for i, f in ids_fps:
        if i is not None:
            low[comp[f]] = min(i, low.get(comp[f], i))
    return sorted((str(i), f"{f:016x}", str(low.get(comp[f]))) for i, f in ids_fps)


def test_fingerprints_follow_their_definition():
    for t in [None, "", " \t", "One", "a b c", "A b C d", "A b C d e é\x0bÉ f  g", "x " * 9000, "ß\xa0y z\x85q w e"]:
        assert H.fingerprint_of(t) == plain_fingerprint(t)


def test_bit_slices_equal_plain_distances():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = np.concatenate([np.bitwise_xor(b, np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, 3)).astype(np.uint64), axis=1)) for b in base]).view(np.int64)
    keys = np.repeat([0, 1, 1, 2], 60)
    root = H.linked(keys, fps, 4)
    for k in (0, 1, 2):
        rows = np.flatnonzero(keys == k)
        comp = components(fps[rows].view(np.uint64).tolist())
        for i in rows:
            for j in rows:
                assert (root[i] == root[j]) == (comp[int(fps[i].view(np.uint64))] == comp[int(fps[j].view(np.uint64))])


def test_random_flips_and_hot_buckets(spark, monkeypatch):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(25)]
    fps = {s ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}) for s in seeds for _ in range(14)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    for hot in (4096, 3):
        edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in H.links(df, hot_bucket=hot).collect()]
        root = {f: f for f in fps}

        def find(f, root=root):
            while root[f] != f:
                f = root[f]
            return f

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        assert {f: find(f) for f in fps} == components(fps)


def test_whole_table_and_edges(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(5000, None), (5001, ""), (None, "one two"), (5002, "one two"), (5002, "one two"), (None, "alone here")], docs.schema)
    rows = docs.unionByName(odd)
    got = H.simhash_components(rows.selectExpr("*", "1 AS fp", "2 AS first")).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expected([(r.doc_id, plain_fingerprint(r.text)) for r in rows.collect()])
    assert H.simhash_components(docs.limit(0)).count() == 0


def test_one_of_each_component_stays(spark):
    rows = [(4, "same text here now", "a"), (2, "same text here now", "b"), (None, "same text here now", "c"), (2, "same text here now", "d"), (9, "another one", "e"), (None, "third", "f"), (None, "third", "g"), (7, None, "h"), (6, "", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").coalesce(1)
    got = sorted((str(r.doc_id), r.text) for r in H.one_of_each(df).collect())
    assert got == sorted([("2", "same text here now"), ("9", "another one"), ("None", "third"), ("6", "")])
    assert H.one_of_each(df.limit(0)).count() == 0
