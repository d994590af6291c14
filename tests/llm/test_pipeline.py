from pathlib import Path

import corpus_pipeline as C
from tessera.llm.queries import ORACLES, QUERIES

from ..conftest import SMALL


def test_queries_are_named_by_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(C.STAGES):
        before = docs
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns and docs.schema == before.schema
    before, after = seen["toxicity"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    clean = before.join(labels.where("toxic = 0"), "doc_id", "left_semi")
    assert after.join(clean, "doc_id", "left_semi").count() >= 0.97 * clean.count()
    before, after = seen["line_dedup"]
    assert after.count() == before.count() and after.where("n_chars != char_length(text)").count() == 0
    before, after = seen["simhash"]
    from tessera.llm.simhash import simhash_components

    assert after.count() == simhash_components(before).select("component_id").distinct().count()
    before, after = seen["mixing"]
    assert after.join(before, columns, "left_anti").count() == 0
    _, pieces = seen["packing"]
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(pieces.columns)


NAMES = "k1 k2 gone kept n_lines n_removed longest_copy fp row copy _copies mix_row tokens posterior toxic score domain half rest grp"


def odd_rows(spark):
    """Documents with nulls, empties, repeats, ties, a very long text and columns of names that operators use."""
    names = NAMES.split()
    long = "\n".join(f"a long text has line {i} of its own" for i in range(3000))
    texts = ["the quay is wet today", "the quay is wet today", None, "", "", long, "three words here\n\nthree words here\nand again five words here", "x"]
    rows = [(i if i % 3 else None, t, "en", f"s{i % 2}" if i else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], (1, "another text under the same id", "en", "s1", 30)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([(*r, *names) for r in rows], f"{kinds}, {', '.join(f'{n} string' for n in names)}")


def test_stages_keep_columns_of_any_name_and_odd_rows(spark):
    docs = odd_rows(spark)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        rows = out.collect()
        assert all(tuple(r)[5:] == tuple(NAMES.split()) for r in rows)
        got, ids = [(r.doc_id, r.text) for r in rows], [(r.doc_id, r.text) for r in docs.collect()]
        if name == "toxicity":
            assert sorted(map(str, got)) == sorted(map(str, ids))
        elif name == "line_dedup":
            assert len(got) == len(ids) and all(r.n_chars == len(r.text) for r in rows)
            assert sum(r.text == "the quay is wet today" for r in rows) == 1 and any(r.text.startswith("three words here") for r in rows)
        elif name == "simhash":
            assert set(got) < set(ids) and sum(not t for _, t in got) == 1 and sum(t == "the quay is wet today" for _, t in got) == 1
        else:
            assert set(got) <= set(ids)


def test_packing_odd_rows(spark):
    got = C.pack_tokens(spark, odd_rows(spark), SMALL).collect()
    assert sum(r.length for r in got if r.doc_tokens == 1) == 3 and {r.doc_id for r in got} == {None, 1, 2, 4, 5, 7}


def test_stages_on_empty_tables(spark):
    docs = odd_rows(spark).limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_run_leaves_its_result_alone(spark):
    from tessera.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    assert C.run(spark, SMALL).count() > 0
    assert [p.name.split("-")[1] for p in set(folder.iterdir()) - before] == ["packing"]
