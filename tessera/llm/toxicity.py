"""Toxicity scores of deobfuscated text (operator 1): a noisy channel before a learned score.

1. Language model: the letters-only words of all texts are counted by a shuffle (the word table grows with
   the input); their character trigrams go to a table of fixed size, SYMBOLS ** 3.
2. Channel: a token that holds a digit, a sign or a doubled letter becomes a lattice: a sign
   stands for the letters it resembles or for nothing, a repeated letter may be dropped.  Spelled-out
   runs ("b a d") are joined to one token first, with and without one-letter words at their ends.  Viterbi search
   finds the likeliest word under the model.
3. Score: the restored words' whole forms and prefixes, weighed by how much more often labelled toxic
   texts hold them (a lower bound of the log odds), feed a logistic regression.  It is fitted to inputs from which
   each text's own counts are left out, so that words of a single text do not count as signs.

Training takes at most max_labelled rows, chosen by hash; of near copies (equal minimum shingle hash and label)
one counts.  Rows of the held-out fold are never trained on, and only the text is scored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, latest_for_worker

FOLDS = 5
MAX_LABELLED = 40_000
MAX_FEATURES = 50_000
MIN_SUPPORT = 3
PREFIXES = (4, 5, 6)
LEAST_WEIGHT = 1.5
TEXTS = "texts"  # counts the texts themselves among the features

# The letters of the language model beside "other letter" and the word's edge.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
SYMBOLS = 64
OTHER = SYMBOLS - 1

# Signs and the letters that they stand for; the rest of the signs can only be left out.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SUBSTITUTE, LEAVE_OUT, SKIP_LOOK, REPEAT = 1.0, 0.5, 5.0, 0.5

CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
SIGNS = {sign: [(CODE[c], c) for c in letters] for sign, letters in LOOKS.items()}
SPELLED = re.compile(r"(?<!\S)(?:\S\s++){2,}\S(?!\S)")
ONE_LETTER = "aeiouyàáèéêíòóúnr"  # Fixed value: letters that are words by themselves, chat's among them
EDGE = " \t.,;:?&%#*\"'`~()[]{}<>/\\=^_-–—…«»“”¡¿"
PARTS = re.compile(r"[\W\d_]+")
NOISY = re.compile(r"[\W\d_]|([^\W\d_])\1")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def core(token: str) -> str:
    """A lower-case token without the signs around it; runs of one closing sign are not letters."""
    token = token.strip(EDGE)
    bare = token.rstrip("!$+|")
    return bare if token.endswith("!") or len(token) - len(bare) > 2 else token


def symbols(word: str) -> list[int]:
    return [CODE.get(c, OTHER) for c in word]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): letters-only words of all texts.  Tokens are counted before any of them is looked at."""
    counted = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"\s+")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [t.strip(EDGE + "!$+|@") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), b.column(1)], ["word", "n"]).filter(pa.array([w.isalpha() for w in words], pa.bool_()))

    return counted.mapInArrow(run, "word string, n long")


@dataclass
class CharModel:
    """log P(c | a, b) over SYMBOLS; 0 is the word's edge."""

    table: np.ndarray

    @cached_property
    def flat(self) -> list[float]:
        return self.table.ravel().tolist()

    @classmethod
    def of(cls, counts: np.ndarray) -> CharModel:
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        two = three.sum(axis=0)
        one = two.sum(axis=0) + 1
        p1 = one / one.sum()
        p2 = (two + 4 * p1) / (two.sum(axis=1, keepdims=True) + 4)
        return cls(np.log((three + 4 * p2[None]) / (three.sum(axis=2, keepdims=True) + 4)).astype(np.float32))


def char_model(words: DataFrame) -> CharModel:
    """The trigram table of the counted words: at most SYMBOLS ** 3 rows reach the driver, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = q = 0
                for c in [*symbols(w), 0]:
                    counts[(p * SYMBOLS + q) * SYMBOLS + c] += n
                    p, q = q, c
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["gram", "n"])

    rows = words.mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**3)
    counts[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return CharModel.of(counts)


def restore(token: str, model: CharModel) -> str:
    """The likeliest word behind a lower-case token: Viterbi search over its lattice."""
    flat = model.flat
    best = {0: (0.0, "")}  # a state is the last two symbols
    before = ""
    for ch in token:
        if ch.isalpha():
            edges, cost, drop = [(CODE.get(ch, OTHER), ch)], 0.0, REPEAT if ch == before else None
        else:
            edges = SIGNS.get(ch, ())
            cost, drop = SUBSTITUTE, SKIP_LOOK if edges else LEAVE_OUT
        before = ch
        after: dict[int, tuple[float, str]] = {}
        for state, (score, word) in best.items():
            for k, c in edges:
                s, to = score + flat[state * SYMBOLS + k] - cost, state % SYMBOLS * SYMBOLS + k
                if to not in after or s > after[to][0]:
                    after[to] = (s, word + c)
            if drop is not None:
                s = score - drop
                if state not in after or s > after[state][0]:
                    after[state] = (s, word)
        best = after
    return max(((s + flat[state * SYMBOLS], w) for state, (s, w) in best.items()), default=(0.0, ""))[1]


def joined(run: str) -> list[str]:
    """A spelled-out run as one word, also without the one-letter words that it may begin or end with."""
    word = "".join(run.split())
    begin, end = len(word) - len(word.lstrip(ONE_LETTER)), len(word.rstrip(ONE_LETTER))
    if begin == len(word):
        return [word]
    ends = [(i, j) for i in range(begin + 1) for j in {len(word), end}] + [(0, j) for j in range(end + 1, len(word))]
    return [word[i:j] for i, j in ends if (i, j) == (0, len(word)) or j - i >= 3]


def tokens(text: str | None) -> list[str]:
    """Lower-case tokens; spelled-out runs are also joined."""
    text = (text or "").lower()
    out = text.split()
    if list(map(len, out)).count(1) > 2:
        out += [w for m in SPELLED.findall(text) for w in joined(m)]
    return out


def features_of(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


class Reader:
    """Token to features, through the channel where a token is noisy; restored words are kept in bounded memory."""

    def __init__(self, model: CharModel, most: int = 100_000):
        self.restored: dict[str, str] = {}
        self.most, self.model = most, model

    def words(self, token: str) -> set[str]:
        w = core(token)
        parts = {w} if w.isalpha() else {x for x in PARTS.split(w) if x}
        # Of fewer than three letters and look-alikes comes no word of three, and no shorter one is a feature.
        if not NOISY.search(w) or sum(c.isalpha() or c in LOOKS for c in w) < 3:
            return parts
        if w not in self.restored:
            if len(self.restored) >= self.most:
                self.restored.clear()
            self.restored[w] = restore(w, self.model)
        return parts | {self.restored[w]}

    def __call__(self, token: str) -> list[str]:
        return [f for w in self.words(token) if len(w) >= 3 for f in features_of(w)]


def shingle_min(words: list[str]) -> int:
    from xxhash import xxh3_64_intdigest as h

    return min((h("\x1f".join(words[i : i + 4])) >> 1 for i in range(max(1, len(words) - 3))), default=0)


STATS = 6


class Judge:
    """Inputs of the logistic regression from a table of weighted features."""

    def __init__(self, weights: dict[str, float], model: CharModel, most: int = 400_000):
        self.weights, self.read, self.most = weights, Reader(model), most
        self.heads = {f[1:4] for f in weights}  # what a word begins with that has a weight
        self.seen: set[str] = set()
        self.hot: dict[str, float] = {}

    def weight(self, token: str) -> float:
        words = [w for w in self.read.words(token) if w[:3] in self.heads]
        return max((self.weights.get(f, 0.0) for w in words for f in features_of(w)), default=0.0)

    def __call__(self, text: str | None) -> list[float]:
        toks = tokens(text)
        if len(self.seen) > self.most:
            self.seen.clear()
            self.hot.clear()
        own, hot = set(toks), self.hot
        new = own - self.seen
        for t in new:
            if (w := self.weight(t)) > 0:
                hot[t] = w
        self.seen |= new
        each = {t: hot[t] for t in own & hot.keys()}
        hits = sum(t in each for t in toks) if each else 0
        best = max(each.values(), default=0.0)
        three = sum(sorted(each.values())[-3:])
        return [1.0, np.log1p(hits), np.log1p(len(each)), best, three, hits / (len(toks) + 20.0) * 20.0]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Newton steps of a ridge logistic regression in which both labels weigh as much."""
    w = np.zeros(x.shape[1])
    share = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (share * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def chosen(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id, text, toxic): at most about max_labelled labelled rows outside the held-out fold, one of each set of near copies."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_labelled / n * (1 << 20)))
    texts = docs.join(F.broadcast(known), "doc_id")  # the ids of at most about max_labelled rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [shingle_min((t.as_py() or "").split()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(marks, pa.int64())], ["doc_id", "toxic", "mark"])

    one = texts.select("doc_id", "toxic", "text").mapInArrow(sketch, "doc_id long, toxic int, mark long")
    one = cut(one.groupBy("mark", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic"))
    return docs.join(F.broadcast(one), "doc_id").select("doc_id", "text", "toxic")


@dataclass
class ToxicityModel:
    chars: CharModel
    weights: dict[str, float]
    logistic: np.ndarray


def feature_weights(t: np.ndarray, c: np.ndarray, n_t: int, n_c: int) -> np.ndarray:
    """A lower bound, one standard error down, of a feature's log odds in toxic against clean texts."""
    odds = np.log((t + 0.5) / (n_t + 1)) - np.log((c + 0.5) / (n_c + 1))
    return odds - np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Fit the channel's model on all texts and the score on labelled ones.  Without both labels every score is the prior."""
    chars, name = char_model(cut(word_counts(docs))), uuid.uuid4().hex
    rows = chosen(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, max_labelled)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, counts = latest_for_worker("toxicity", f"reader {name}", lambda: Reader(chars)), Counter()

        def flush() -> pa.RecordBatch:
            at = [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int64())]
            out = pa.RecordBatch.from_arrays([*at, pa.array(list(counts.values()), pa.int64())], ["feature", "kind", "n"])
            counts.clear()
            return out

        for b in batches:
            for t, kind in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                counts[(TEXTS, kind)] += 1
                counts.update((k, kind) for k in {k for w in set(tokens(t.as_py())) for k in read(w)})
                if len(counts) > 100_000:
                    yield flush()
        yield flush()

    sums = cut(
        rows.mapInArrow(features, "feature string, kind long, n long")
        .groupBy("feature").agg(*[F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)).alias(k) for i, k in enumerate("ct")])
    )
    total = sums.where(F.col("feature") == TEXTS).toPandas()
    n_c, n_t = (int(total[k].sum()) for k in "ct")
    if not n_t or not n_c:
        prior = float(np.log((n_t + 0.5) / (n_c + 0.5))) if n_t + n_c else -2.0
        return ToxicityModel(chars, {}, np.array([prior] + [0.0] * (STATS - 1)))
    top = (
        sums.where((F.col("feature") != TEXTS) & (F.col("t") >= MIN_SUPPORT) & (F.col("t") / float(n_t + 1) > 3 * F.col("c") / float(n_c + 1)))
        .orderBy(F.desc(F.col("t") - F.col("c") * (n_t / n_c)), "feature").limit(MAX_FEATURES).toPandas()
    )

    def table(t: np.ndarray, c: np.ndarray) -> dict[str, float]:
        w = feature_weights(np.maximum(t, 0), np.maximum(c, 0), n_t, n_c)
        good = (t >= MIN_SUPPORT) & (w >= LEAST_WEIGHT)
        return dict(zip(top["feature"][good].tolist(), w[good].tolist(), strict=True))

    t, c = top["t"].to_numpy(float), top["c"].to_numpy(float)
    without_own = [table(t, c - 1), table(t - 1, c)]  # for a clean and for a toxic text

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = latest_for_worker("toxicity", f"judges {name}", lambda: [Judge(w, chars) for w in without_own])
        for b in batches:
            x = [judges[y](t.as_py()) for t, y in zip(b.column(1), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    got = rows.mapInArrow(inputs, "toxic int, x array<double>").toPandas()  # STATS numbers for at most about max_labelled rows
    logistic = fit_logistic(np.array(got["x"].tolist()), got["toxic"].to_numpy(float))
    return ToxicityModel(chars, table(t, c), logistic)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted; null and empty texts have the score of a text without signs."""
    spread, name = shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, logistic = latest_for_worker("toxicity", f"judge {name}", lambda: loaded(spread.value))
        for b in batches:
            s = scores(judge, logistic, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def shared(docs: DataFrame, model: ToxicityModel) -> tuple:
    """The model as a broadcast of fixed size (the trigram table and at most MAX_FEATURES weights), and a name for it."""
    return docs.sparkSession.sparkContext.broadcast((model.chars.table, model.weights, model.logistic)), uuid.uuid4().hex


def loaded(parts: tuple) -> tuple[Judge, np.ndarray]:
    chars, weights, logistic = parts
    return Judge(weights, CharModel(chars)), logistic


def scores(judge: Judge, logistic: np.ndarray, texts: pa.Array) -> np.ndarray:
    x = np.array([judge(t.as_py()) for t in texts], float).reshape(-1, STATS)
    return 1 / (1 + np.exp(-np.clip(x @ logistic, -30, 30)))


def kept(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    spread, name = shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, logistic = latest_for_worker("toxicity", f"judge {name}", lambda: loaded(spread.value))
        for b in batches:
            yield b.filter(pa.array(scores(judge, logistic, b.column(text_col)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Train on docs and labels, then score every row of docs.

    Nulls: a null text is an empty one; a null id is not held out and is never trained on; rows of labels with
    null ids or labels are ignored, repeated ones count once.  Repeated rows of docs each get a row, equal texts an
    equal score.  Very long texts are scored whole.  Features of equal weight are taken in their own order.  Empty tables
    give empty results.  Other columns are not read.
    """
    return score(docs, train(docs, labels, max_labelled))
