from collections import defaultdict
from itertools import combinations_with_replacement
from zlib import crc32

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import packing as P

from ..conftest import MID


def checked(spark, rows, window=P.WINDOW, **how):
    """Every id in one piece, checksums right, sequences gapless; returns (sequences, padding)."""
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rest int")
    got = P.pack(df, window=window, **how).collect()
    tok = Tokenizer.from_file(P.tokenizer_path())
    left = defaultdict(int)
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, P.END_ID], "<u4")
        left[(i, ids.tobytes())] += 1
    by_doc = defaultdict(list)
    for r in got:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
    covered = defaultdict(int)
    for (i, raw), times in left.items():
        ids = np.frombuffer(raw, "<u4")
        for r in by_doc[(i, len(ids))]:
            if crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32:
                covered[(i, raw)] += r.length
        assert covered[(i, raw)] >= times * len(ids)
    assert sum(r.length for r in got) == sum(len(raw) // 4 * n for (_, raw), n in left.items())
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    used = sum(r.length for r in got)
    return len(sequences), 1 - used / (window * max(1, len(sequences)))


def test_encoder_equals_the_tokenizer():
    texts = ["", "Don't STOP, it's 3.5% — é É ı İ", "naïve café 日本語 x y", "a\x1cb c\x1d", "MiXeD SPACE\u0085line\r\n\tend", "Σίσυφος ΣΑΣ"]
    encode = P.Encoder(P.tokenizer_path())
    for x, t in zip(encode(texts), texts, strict=True):
        assert x.tolist() == encode.tok.encode(t, add_special_tokens=False).ids


def test_added_tokens_are_taken_from_raw_text():
    texts = ["rain <|endoftext|> harbour", "rain<|endoftext|>harbour", "<|startoftext|><|endoftext|>'s 3x", "<|ENDOFTEXT|> <|endoftext|>", "<|EndOfText|>"]
    texts += ["é<|endoftext|>É 日<|startoftext|>b", "日 <|StartOfText|>", "< |endoftext| >", "\n<|startoftext|>\tA", "<|endoftext|", "plain words"]
    encode = P.Encoder(P.tokenizer_path())
    for _ in range(2):  # the second time from memory
        for x, t in zip(encode(texts), texts, strict=True):
            assert x.tolist() == encode.tok.encode(t, add_special_tokens=False).ids
    assert encode(texts[:1])[0].tolist() == [2443, 49407, 10011]


def test_least_squares_against_brute_force():
    """Small histograms: the solution against coordinate descent from many starts, the enumeration against loops."""
    rng = np.random.default_rng(7)
    for window in (8, 12, 20):
        for _ in range(6):
            histogram = rng.integers(0, 5, window + 1) * (rng.random(window + 1) < 0.7)
            combos = P.combinations_of(histogram, window)
            have = [n for n in range(1, window + 1) if histogram[n]]
            want = {tuple(sorted(c, reverse=True)) for k in (2, 3) for c in combinations_with_replacement(have, k) if sum(c) == window}
            assert {tuple(n for n in c if n) for c in combos.tolist()} == want and len(combos) == len(want)
            if not want:
                continue
            a = np.zeros((window + 1, len(combos)))
            for j, c in enumerate(combos.tolist()):
                for n in c:
                    a[n, j] += n > 0
            target = np.where(np.arange(window + 1) > 0, histogram, 0).astype(float)
            x = np.zeros(len(combos))
            for _ in range(3000):
                for j in range(len(combos)):
                    x[j] = max(0.0, x[j] + a[:, j] @ (target - a @ x) / (a[:, j] @ a[:, j]))
            got = P.solve_counts(histogram, combos, 500)
            miss = lambda y: ((a @ y - target) ** 2).sum()
            assert (got >= 0).all() and miss(got) <= miss(x) + 1e-3
            assert abs(P.rounded(got).sum() - got.sum()) <= 0.5 and (P.rounded(got) >= 0).all()


def cuts(out):
    return len(out) - len({row for row, *_ in out})


def test_the_plan_cuts_fewer_than_the_greedy_part_alone():
    rng = np.random.default_rng(3)
    for lengths in (
        rng.integers(1, 2048, 8192), rng.integers(1, 2048, 2000), np.clip(rng.exponential(600, 8192).astype(int), 1, 2047),
        np.clip(rng.lognormal(5, 0.8, 8192).astype(int), 1, 2047), np.concatenate([rng.choice([512, 1536, 1024, 700], 400), rng.integers(1, 2048, 200)]),
    ):
        out, alone = P.pack_group(lengths, 2048), P.pack_group(lengths, 2048, plan=False)
        for x in (out, alone):
            got = np.zeros(len(lengths), int)
            for row, _, n, _, _ in x:
                got[row] += n
            assert (got == lengths).all() and max(s for *_, s, _ in x) + 1 == -(-lengths.sum() // 2048)
        assert cuts(out) < 0.8 * cuts(alone)


def test_planned_sequences_are_most_of_an_even_histogram():
    histogram = np.bincount(np.random.default_rng(1).integers(1, 2048, 8192), minlength=2049)
    rows = histogram.sum()
    plan = P.planned(histogram, 2048)
    assert all(sum(parts) == 2048 for parts in plan) and sum(map(len, plan)) + histogram.sum() == rows
    assert histogram.sum() < 0.25 * rows


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 3000), (4, "short text"), (4, "short text"), (None, "no id"), (5, "x" * 4000)]
    checked(spark, rows)
    checked(spark, rows, window=64, group_rows=3)
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text").collect()]
    _, padding = checked(spark, docs)
    assert padding < 0.01
