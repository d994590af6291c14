import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import mixing as M

from ..conftest import MID


def dense(members, domains):
    """Memberships as rows of shares of all domains."""
    out = np.zeros((len(members), len(domains.names)))
    for row, codes in zip(out, members, strict=True):
        for c in codes:
            place, share = c >> M.SHARE_BITS, (c & 511) / M.SHARES
            row += share * (domains.prior if place == len(row) else np.eye(len(row))[place])
    return out


def told(classifier, temper, trust):
    return M.Classifier(classifier.words, classifier.prior, temper, trust, 1.0)


def by_text(df, max_labelled=1000):
    """docs (text, domain) as the operator's parts take them, and their domains."""
    rows = df.selectExpr("doc_id", "cast(text as binary) as text", "source as domain")
    sizes = rows.where("domain is not null").groupBy("domain").count().orderBy("domain").collect()
    return rows, M.Domains([r["domain"] for r in sizes], [r["count"] for r in sizes])


def test_totals_meet_the_targets(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.col("source").alias("domain"))
    domains = M.Domains(*zip(*[(r["domain"], r["count"]) for r in rows.groupBy("domain").count().orderBy("domain").collect()], strict=True))
    for classifier in (M.learned(rows, domains, 500), told(M.learned(rows, domains, 500), 10.0, 0.8)):
        known = M.members(rows, domains, classifier).cache()
        pdf = known.toPandas()
        p, n = dense(pdf.member, domains), pdf.tokens.to_numpy(float)
        assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
        share = np.linspace(1, 3, len(domains.names))
        target = share / share.sum() * n.sum()
        pulls, residual = M.solved(known, domains, target)
        r = M.Members(pa.array(pdf.member.tolist(), pa.list_(pa.int64()))).rates(pulls)
        assert (r >= 0).all()
        missed = np.abs(p.T @ (n * r) - target).sum() / target.sum()
        assert missed < 0.02 and abs(missed - residual) < 1e-3


def test_rates_against_a_plain_solver(spark):
    """The least squares of a small table, against coordinate descent over all documents."""
    rng = np.random.default_rng(2)
    p, n = rng.dirichlet(np.full(4, 0.4), 60), rng.integers(5, 50, 60)
    for target in (np.array([4, 3, 2, 1.0]) / 10 * n.sum(), np.array([7, 1, 1, 1.0]) / 10 * n.sum()):
        codes = [c.tolist() for c in M.encoded(p, np.tile(np.arange(4), (60, 1)))]
        known = spark.createDataFrame([(int(k), c) for k, c in zip(n, codes, strict=True)], "tokens long, member array<long>")
        domains = M.Domains(list("abcd"), [1, 1, 1, 1])
        got = M.Members(pa.array(codes, pa.list_(pa.int64()))).rates(M.solved(known, domains, target, 200, 1e-5)[0])
        whole = dense(codes, domains)
        assert np.abs(whole - p).max() <= 1 / M.SHARES
        a, x = (whole * n[:, None]).T, np.ones(60)
        for _ in range(3000):
            for i in range(60):
                x[i] = max(0.0, x[i] + a[:, i] @ (target - a @ x) / (a[:, i] @ a[:, i]))
        miss = lambda r: np.abs(a @ r - target).sum() / target.sum()
        assert (got >= 0).all() and miss(got) <= miss(x) + 0.02


def test_texts_do_not_vouch_for_their_own_tags(spark):
    """Texts of words that no other text has: their posterior is the prior, not the tag."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)), f"d{i % 2}") for i in range(200)]
    df, domains = by_text(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    classifier = M.learned(df, domains, 1000)
    assert (classifier.temper, classifier.trust, classifier.gain) == (0.0, 1.0, 0.0)
    untagged = df.withColumn("domain", F.lit(None).cast("string"))
    assert np.abs(dense(M.members(untagged, domains, classifier).toPandas().member, domains) - 0.5).max() < 0.2
    known = M.members(untagged, domains, told(classifier, 10.0, 0.9)).toPandas()
    own = dense(known.member, domains)[np.arange(200), known.doc_id % 2]
    assert abs(own.mean() - 0.5) < 0.1  # words believed against calibration: they are wrong as often as right


def test_real_shares_meet_the_targets(spark):
    """Token shares by tag, with the copies that are taken: texts that tell the domain, and texts that don't."""
    rng = np.random.default_rng(4)
    words = {d: [f"{d}{i}" for i in range(50)] for d in "abc"}
    for telling in (True, False):
        rows = []
        for i in range(3000):
            d = "aaaabbc"[i % 7]
            rows.append((i, " ".join(rng.choice(words[d] if telling else words["a"], 20)), d))
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        target = {"a": 0.3, "b": 0.3, "c": 0.4}
        got = M.mixed(df, target).toPandas()
        real = got.assign(t=got.n_tokens * got.copies).groupby("domain").t.sum() / (got.n_tokens * got.copies).sum()
        for d, x in target.items():
            assert abs(real[d] - x) < 0.01 * x, (telling, d, real[d])
        assert set(got.basis) == {"text" if telling else "tag"} and (got.gain > 0.5).all() == telling and got.residual.max() < 2e-3


def test_every_domain_has_its_own_target_however_many_there_are(spark):
    """12 domains of like texts with targets 1/78 to 12/78, of which the classifier knows 4, and 3,000 domains of 2 rows."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(list("abcdefgh"), 30)), f"s{i % 12}") for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = {f"s{i}": (i + 1) / 78 for i in range(12)}
    got = M.mixed(df, target, text_classes=4).toPandas()
    got["t"] = got.n_tokens * got.rate
    for d, x in (got.groupby("domain").t.sum() / got.t.sum()).items():
        assert abs(x - target[d]) < 0.001 * target[d]
    many = spark.range(6000).selectExpr("id as doc_id", "concat('word', id % 7, ' and more') as text", "concat('d', id div 2) as source")
    by = M.mixed(many, {f"d{i}": 1 + i % 3 for i in range(3000)}).groupBy("domain").agg(F.sum("rate").alias("rate")).collect()
    assert len(by) == 3000 and all(abs(r.rate - 1 - int(r.domain[1:]) % 3) < 0.01 for r in by)


def test_small_domains_keep_targets_of_their_own_beside_known_words(spark):
    """Texts tell four large domains from the rest; the rest's six domains, known to the classifier as one, meet their own targets."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(2600):
        d = i % 26 if i % 26 < 6 else i % 4 + 6
        kind = d if d > 5 else "rest"
        rows.append((i, " ".join(f"{kind}w{w}" for w in rng.integers(0, 40, 25)), f"s{d}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = {f"s{d}": 2.0 if d in (0, 6) else 1.0 for d in range(10)}
    got = M.mixed(df, target, text_classes=5).toPandas()
    assert set(got.basis) == {"text"}
    got["t"] = got.n_tokens * got.copies
    for d, x in (got.groupby("domain").t.sum() / got.t.sum()).items():
        assert abs(x - target[d] / 12) < 0.03 * target[d] / 12, (d, x * 12)


def test_trust_in_tags_is_measured_and_wrong_tags_are_overruled(spark):
    """A fifth of the tags is drawn at random from four domains whose texts tell them apart."""
    rng = np.random.default_rng(5)
    real = rng.integers(0, 4, 4000)
    tags = np.where(rng.random(4000) < 0.2, rng.integers(0, 4, 4000), real)
    rows = [(i, " ".join(f"{d}w{w}" for w in rng.integers(0, 50, 40)), f"s{t}") for i, (d, t) in enumerate(zip(real.tolist(), tags.tolist(), strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mixed(df, {"s0": 0.1, "s1": 0.2, "s2": 0.3, "s3": 0.4}).toPandas().sort_values("doc_id")
    assert got.tag_trust.iloc[0] in (0.7, 0.8, 0.9) and got.basis.iloc[0] == "text"
    assert (got.posterior[tags != real] < 0.5).all() and (got.posterior[tags == real] > 0.5).all()
    mass = np.array([(got.n_tokens * got.copies)[real == d].sum() for d in range(4)])
    assert np.abs(mass / mass.sum() / [0.1, 0.2, 0.3, 0.4] - 1).max() < 0.03


def test_calibration_against_loops():
    """Of the pairs within LIKELY of the best, the largest trust; and no gain from noise."""
    fits = np.full((len(M.TEMPERS), len(M.TRUSTS)), -50.0)
    fits[2, 3], fits[4, 5], fits[1, 8] = 40.0, 38.5, 37.0
    assert M.calibrated(fits, 100) == (M.TEMPERS[4], M.TRUSTS[5], 0.385)
    fits[2, 3], fits[4, 5], fits[1, 8] = 4.0, 3.5, 3.0
    assert M.calibrated(fits, 100) == (0.0, 1.0, 0.0)


def test_taken_tokens_differ_by_one_document_at_most(spark):
    """Cumulative rounding, within each domain and stratum, against running sums in a loop."""
    rng = np.random.default_rng(6)
    rows = [(f"d{i % 3}" if i % 5 else None, int(n), float(r), int(k), int(k) % 2) for i, (n, r, k) in enumerate(zip(rng.integers(1, 5000, 600), rng.random(600) * 3, rng.permutation(600), strict=True))]
    got = M.draw(spark.createDataFrame(rows, "domain string, n_tokens long, rate double, key long, stratum long")).toPandas()
    assert len(got) == 600 and ((got.copies == np.floor(got.rate)) | (got.copies == np.floor(got.rate) + 1)).all()
    for _, g in got.groupby(["domain", "stratum"], dropna=False):
        assert abs((g.n_tokens * (g.copies - g.rate)).sum()) <= g.n_tokens.max()


def test_rates_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text", "source")
    a, b = ({r.doc_id: r.rate for r in M.mixed(docs.repartition(k)).collect()} for k in (2, 7))
    assert a == b


def test_very_long_texts(spark):
    rows = [(1, "apple pear " * 200_000, "fruit"), (2, "iron zinc " * 10, "metal"), (3, "iron lead", "metal")]
    got = {r.doc_id: r for r in M.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].n_tokens == 400_000 and all(r.rate >= 0 for r in got.values())


def test_text_decides_where_the_tag_is_missing(spark):
    rows = [(i, f"{'apple pear plum ' * 30}" if i % 2 else f"{'iron zinc lead ' * 30}", "fruit" if i % 2 else "metal") for i in range(60)]
    rows += [(100, "apple plum " * 40, None), (101, "zinc iron " * 40, None), (102, None, "fruit"), (103, "", None), (None, "apple", "fruit"), (1, rows[1][1], "fruit")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, rate int")
    got = M.mixed(df, {"fruit": 0.75, "metal": 0.25}).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[102].n_tokens == 0
    assert by[100].rate > 1 > by[101].rate > 0
    assert by[100].rate == max(r.rate for r in got if r.doc_id in (100, 101, 103))
    total = sum(r.n_tokens for r in got)
    assert abs(sum(r.n_tokens * r.rate for r in got) - total) < 0.01 * total
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.n_tokens, r.rate, r.copies) for r in M.mixed(df).collect()) == [(1, 2, 1.0, 1), (2, 0, 1.0, 1)]
    assert M.mixed(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "", "s")], "doc_id long, text string, source string")
    assert M.mixed(one).count() == 1


def test_default_mix_lifts_small_sources(spark):
    got = M.mixed(spark.read.parquet(f"{MID}/documents.parquet")).toPandas()
    by = got.assign(t=got.n_tokens * got.rate).groupby("domain")[["n_tokens", "t"]].sum()
    assert abs(by.t.sum() - by.n_tokens.sum()) < 0.01 * by.n_tokens.sum()
    assert by.t.std() < by.n_tokens.std()


def test_rows_without_ids_are_taken_by_their_own_rates(spark):
    import corpus_pipeline as C

    rows = [(None if i % 3 else 7, f"apple pear {i} plum " * 10 if i % 4 else f"iron zinc {i} lead " * 10, "fruit" if i % 4 else "metal") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rate = M.mixed(df).groupBy("domain").agg(F.sum("rate").alias("rate"), F.sum("copies").alias("copies")).collect()
    out = C.mix_sources(spark, df, "")
    assert out.columns == df.columns and out.join(df, df.columns, "left_anti").where("doc_id is not null").count() == 0
    got = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert {r.domain for r in rate} == {"fruit", "metal"}
    for r in rate:
        assert abs(got[r.domain] - r.rate) < 50 and abs(r.copies - r.rate) < 50
