import random
import zlib

from pyspark.sql import functions as F

from tessera.llm import toxicity as X

from ..conftest import MID


def corpus(spark, n=300):
    rng = random.Random(5)
    stems = ["ran", "tel", "mor", "sip", "dun", "kel", "vot", "lim"]
    word = lambda: rng.choice(stems) + rng.choice(stems)
    bad = ["grumlet", "foozle", "snarkle"]
    rows, labels = [], []
    for i in range(n):
        text, toxic = [word() for _ in range(40)], i % 4 == 0
        if toxic:
            for w in rng.sample(bad, 2):
                text[rng.randrange(40)] = w
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_channel_restores_words(spark):
    docs = spark.createDataFrame([(i, "stupid idiot worthless trash loser pathetic the and of moron scum") for i in range(20)], "doc_id long, text string")
    model = X.char_model(X.word_counts(docs))
    for noisy, word in [("1d10t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("stuuupid", "stupid"), ("w0rthle$$", "worthless"), ("tr@sh", "trash"), ("m00ron", "moron")]:
        assert X.NOISY.search(X.core(noisy))
        assert X.restore(X.core(noisy), model) == word
    assert "stupid" in X.tokens("so s t u p i d it is")
    assert X.core("fine!!!") == "fine" and X.core("'quoted,'") == "quoted"


def every_path(token, before=""):
    """(word, cost) of every path through a token's lattice."""
    if not token:
        return [("", 0.0)]
    ch, rest = token[0], every_path(token[1:], token[0])
    if ch.isalpha():
        first = [(ch, 0.0)] + [("", X.REPEAT)] * (ch == before)
    else:
        letters = X.LOOKS.get(ch, "")
        first = [(c, X.SUBSTITUTE) for c in letters] + [("", X.SKIP_LOOK if letters else X.LEAVE_OUT)]
    return [(a + b, x + y) for a, x in first for b, y in rest]


def test_viterbi_against_all_paths(spark):
    words = "stupid idiot worthless trash loser pathetic the and of moron scum ill all good bill look tool".split()
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(20)], "doc_id long, text string")
    model = X.char_model(X.word_counts(docs))

    def value(word, cost):
        p = q = 0
        total = -cost
        for c in [*X.symbols(word), 0]:
            total += float(model.table[p, q, c])
            p, q = q, c
        return total

    rng = random.Random(12)
    tokens = ["1d10t", "m00ron", "1|!!", "w0rthle$$", "aabbcc", "sstttuup1d", "-a-", "§", ""]
    tokens += ["".join(rng.choice("abilosstt013!$|@-éz") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    for token in tokens:
        best = max(value(*path) for path in every_path(token))
        got = X.restore(token, model)
        assert abs(max(value(w, c) for w, c in every_path(token) if w == got) - best) < 1e-3, token


def test_every_form_of_the_channel_is_decoded(spark):
    docs = spark.createDataFrame([(i, "stupid idiot moron loser scum the and of") for i in range(20)], "doc_id long, text string")
    reader = X.Reader(X.char_model(X.word_counts(docs)))
    forms = [("idiot", "1d107 1d!07 iidioott"), ("loser", "1053r 10$3r"), ("scum", "5cum"), ("stupid", "stuupid stupiid"), ("moron", "mmoorroonn")]
    for word, noisy in forms:
        for token in noisy.split():
            assert word in reader.words(token), token
    assert "scut" in reader.words("scu+") and reader.words("plain") == {"plain"} and reader.words("--") == set()
    for text in ("you i  d\ni o\t t there", "a i d i o t", "i d i o t y", "you u a i d i o t a end"):
        assert "idiot" in X.tokens(text), text
    assert X.tokens("a i o") == ["a", "i", "o", "aio"]


def test_disguised_words_are_caught_and_clean_texts_left(spark):
    docs, labels = corpus(spark)
    more = [(1000, "rantel mor gruuumlet dunkel f00zle sipvot"), (1001, "rantel g.r.u.m.l.e.t f o o z l e limlim sn4rkle"), (1002, "rantel mordun sipvot limlim"), (1003, ""), (1004, None), (None, "telmor dunkel")]
    model = X.train(docs, labels)
    got = {r.doc_id: r for r in X.score(docs.unionByName(spark.createDataFrame(more, docs.schema)), model).collect()}
    assert got[1000].predicted == 1 and got[1001].predicted == 1
    assert [got[i].predicted for i in (1002, 1003, 1004, None)] == [0, 0, 0, 0]
    assert got[1003].score == got[1004].score and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    wrong = sum(got[i].predicted != int(i % 4 == 0) for i in range(300))
    assert wrong <= 6
    kept = X.kept(docs.withColumn("score", F.lit("clash")), model)
    assert kept.columns == ["doc_id", "text", "score"] and abs(kept.count() - 225) <= 6


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = corpus(spark)
    turned = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(str, X.toxicity(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "labels"))
    got = X.toxicity(docs.withColumn("score", F.lit(1)), labels).join(labels, "doc_id").toPandas()
    clean = got[got.toxic == 0]
    assert (clean.predicted == 0).mean() > 0.98
    assert (got[got.toxic == 1].predicted == 1).mean() > 0.6


def test_held_out_rows_of_a_larger_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = X.toxicity(docs, labels).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.88  # recall
    assert n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.88  # precision


def test_long_texts_ties_and_repeated_rows(spark):
    docs, labels = corpus(spark)
    long = "rantel morsip " * 200_000
    more = [(1000, long), (1001, long + "grumlet foozle snarkle"), (1002, "foozle grumlet"), (1002, "foozle grumlet"), (1003, "foozle grumlet"), (1002, "rantel")]
    both = docs.unionByName(spark.createDataFrame(more, docs.schema))
    repeated = labels.unionByName(labels)  # a label given twice counts once
    got = X.toxicity(both, repeated).where("doc_id >= 1000").collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1003} | {max(r.score for r in got if r.doc_id == 1002)}) == 1
    assert sorted(r.predicted for r in got if r.doc_id == 1002) == [0, 1, 1] and [r.predicted for r in got if r.doc_id == 1000] == [0]
    assert [r.score for r in X.toxicity(docs, repeated).orderBy("doc_id").collect()] == [r.score for r in X.toxicity(docs, labels).orderBy("doc_id").collect()]


def test_empty_tables(spark):
    docs, labels = corpus(spark, 8)
    assert X.toxicity(docs.limit(0), labels).count() == 0
    assert X.toxicity(docs, labels.limit(0)).where("predicted = 0").count() == 8
