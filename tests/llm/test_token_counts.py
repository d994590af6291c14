import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import token_counts as tc

from ..conftest import SMALL

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def counter():
    path = tc.tokenizer_path()
    return tc.TokenCounter(path, tc.proof(path))


def library(counter, texts):
    return [len(e.ids) for e in counter.tok.encode_batch(texts, add_special_tokens=False)]


def test_proven_strings_are_one_token_in_the_library(counter):
    whole = sorted(counter.whole)
    assert len(whole) > 40_000
    assert all(len(e.ids) == 1 for e in counter.tok.encode_batch(whole, add_special_tokens=False))


def test_any_mix_of_classes_counts_as_in_the_library(counter):
    r = random.Random(11)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "é", "Ab", " the", " 's", "'ll", "'", "'S", "?!", "12", "½", "٣", "漢", "\x1c", "\x85", "\xa0", "　", "😀", "𝒳", "ⅷ", "ͅ", "​", "\U00020000", "_", " zzqx", "<|", "|>"]
    texts = ["".join(r.choices(parts, k=r.randrange(14))) for _ in range(3_000)]
    assert [counter(t)[0] for t in texts] == library(counter, texts)


def test_special_strings_inside_texts_are_the_librarys(counter):
    texts = ["rain <|endoftext|> harbour", "<|endoftext|>", "x<|endoftext|>y", "<|endoftext|", "<|ENDOFTEXT|>"]
    assert [counter(t)[0] for t in texts] == library(counter, texts)
    assert counter("<|endoftext|>") == (1, 0)


def test_long_texts_are_cut_at_borders_alone(counter, monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(tc, "BLOCK", 7)
    texts = ["".join(r.choices(["a", "the", " ", "  ", "\n", " \n ", "word", "'s", "é", "."], k=120)) for _ in range(200)]
    assert [counter(t)[0] for t in texts] == library(counter, texts)
    assert len(list(counter.blocks("ab cd ef gh ij kl mn op"))) > 1


def test_memory_of_a_worker_is_bounded(counter, monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 10)
    texts = [f"qxz{i:b} vvk{i * 7:o} {'y' * i}" for i in range(60)]
    assert [counter(t)[0] for t in texts] == library(counter, texts)


def test_shortcut_counts_most_of_plain_english(counter):
    tokens, whole = counter("The house on the hill was sold to a family from the north of the country last year.")
    assert tokens == whole == 19


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "two words"), (4, "same"), (4, "same"), (6, "word " * 1025), (7, "é" * 3)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"n_tokens": F.lit("x"), "n_bytes": F.lit(0), "over_limit": F.lit(1)})
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tc.token_counts(df).collect())
    assert got == [(0, 9, 2, False), (1, 0, 0, False), (2, 0, 0, False), (4, 4, 1, False), (4, 4, 1, False), (6, 5125, 1026, True), (7, 6, got[-1][2], False)]
    assert tc.token_counts(df.limit(0)).count() == 0


def test_given_texts_count_as_in_the_library(spark, counter):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    expected = dict(zip([d for d, _ in texts], library(counter, [t for _, t in texts]), strict=True))
    assert {r["doc_id"]: r["n_tokens"] for r in tc.token_counts(docs).collect()} == expected
