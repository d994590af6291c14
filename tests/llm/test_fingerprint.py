import base64
import hashlib
import re
import struct
import time

import xxhash

from tessera.llm import fingerprint as P

from ..conftest import SMALL


def pieces(t):
    return set(re.findall(rf"(?m)^[^\n]{{1,{P.HEAD}}}|[^\n]{{1,{P.PIECE}}}", t))


def likeness(a, b):
    a, b = pieces(a), pieces(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def told(fingerprint):
    """The digests that a fingerprint tells: how often each block's last cells hold one alone, peeled in plain Python."""
    found = []
    for block, part in ((block, part) for block in fingerprint.split(".") for part in block.split(":")[-1].split(",")):
        raw = base64.b64decode(part)
        cells = [list(struct.unpack(">qq", raw[i : i + 16])) for i in range(0, len(raw), 16)]
        size = len(cells) // P.TABLES
        salt = block.count(":")
        mark = lambda k: (hashed(k, b"check") & 0xFFFFFFFF) + P.ONE
        while lone := next((k for k, m in cells if m == mark(k)), None):
            h = hashed(lone, struct.pack("<q", salt))
            for t in range(P.TABLES):
                c = cells[t * size + (h >> 16 * t & 0xFFFF) % size]
                c[0], c[1] = c[0] ^ lone, c[1] - mark(lone)
            found.append(lone)
        assert all(c == [0, 0] for c in cells)
    return set(found)


def hashed(number, salt):
    """Spark's hash of a long and what follows it: each is hashed with the hash so far as the seed."""
    first = xxhash.xxh64_intdigest(struct.pack("<q", number), 42)
    return xxhash.xxh64_intdigest(salt, first)


def check(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, next int")
    out = [r.asDict() for r in P.fingerprints(df).collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    by = {r["doc_id"]: r for r in out}
    for at, (i, t) in enumerate(order):
        t, n = t or "", order[(at + 1) % len(order)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + n[:cut]
        assert by[i]["n_chars"] == len(t)
        assert by[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(by[i]["near_edited"] - likeness(t, edited)) < 1e-9
        assert abs(by[i]["near_next"] - likeness(t, n)) < 1e-9
        assert by[i]["edited_only"] == len(pieces(edited) - pieces(t))
    return by


def test_small_cases(spark):
    rows = [(3, "one line\ntwo lines\n" * 3), (1, None), (2, ""), (9, "x"), (20, "😀é" * 50), (21, "one line\ntwo lines\n" * 3), (None, "first\nof all")]
    by = check(spark, rows)
    assert by[3]["fingerprint"] == by[21]["fingerprint"] != by[20]["fingerprint"]
    assert by[1]["near_next"] == 1.0
    check(spark, [(5, "alone in here, quite alone")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.fingerprints(empty).count() == 0


def test_long_texts_need_retries_and_stay_exact(spark):
    a = "\n".join(f"paragraph {i}" for i in range(900))
    by = check(spark, [(1, a), (2, a.replace("7", "seven")), (3, "\n".join(f"other {i}" for i in range(700))), (4, a)])
    assert max(r["retries"] for r in by.values()) > 0
    assert all(len(r["fingerprint"].split(".")) == 128 for i, r in by.items() if i in (1, 4))


def test_an_overfull_block_is_split_until_it_peels(spark):
    from pyspark.sql import functions as F

    for a, b in ((60, 0), (100, 150), (900, 40)):
        sides = [(i * 7919 + 2, 0) for i in range(a)] + [(i * 104729 + 1, 1) for i in range(b)]
        rows = spark.createDataFrame([(0, d, s, None) for d, s in sides], "block int, digest long, side int, info string")
        got = P.cells_of(rows, "block").select(P.difference(F.col("cells"), F.col("a"), F.col("b")).alias("d")).first()["d"]
        assert got["size"] >= 3 and sorted(got["a"]) == sorted(d for d, s in sides if not s) and sorted(got["b"]) == sorted(d for d, s in sides if s)
        own = P.cells_of(rows.where("side = 0"), "block").select(P.published(F.col("cells"), F.col("a")).alias("text")).first()["text"]
        assert told(own) == {d & (2**64 - 1) for d, s in sides if not s} and ("," in own) == (own.count(":") >= 3)


def test_likeness_is_of_the_fingerprints_alone(spark):
    rows = [(1, "\n".join(f"paragraph {i}" for i in range(300))), (2, "\n".join(f"paragraph {i}" for i in range(40, 90))), (3, ""), (4, "one"), (5, "some words\nmore words")]
    by = check(spark, rows)
    for at, (i, _) in enumerate(rows):
        own, changed, other = (told(by[j][c]) for j, c in ((i, "fingerprint"), (i, "edited_fingerprint"), (rows[(at + 1) % len(rows)][0], "fingerprint")))
        for name, x in (("near_edited", changed), ("near_next", other)):
            assert by[i][name] == (2 * len(own & x) / (len(own) + len(x)) if own or x else 1.0)


def test_a_very_long_text_and_repeated_rows(spark):
    begin = time.time()
    long = "\n".join(f"line {i}" for i in range(100_000))
    got = P.fingerprints(spark.createDataFrame([(1, long), (2, long + "\nend"), (3, "x")], "doc_id long, text string")).collect()
    first = next(r for r in got if r.doc_id == 1)
    assert 0.7 < first.near_edited < 1 and first.near_next > 0.9999 and time.time() - begin < 120
    same = spark.createDataFrame([(None, "a\nb")] * 30 + [(7, "c")] * 30, "doc_id long, text string")
    got = P.fingerprints(same).collect()
    assert len(got) == 60 and sum(r.near_next == 1 for r in got) == 58 and len({r.fingerprint for r in got}) == 2


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    by = check(spark, [tuple(r) for r in docs.collect()])
    assert sum(r["near_edited"] > r["near_next"] for r in by.values()) > 0.9 * len(by)
    assert not any(x in P.fingerprints(docs)._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
