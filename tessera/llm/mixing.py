"""Mixing sources to target weights by soft membership (operator 4).

1. A naive Bayes classifier learns, from a bounded labelled table of documents whose domain is known, how each domain uses
   words (hashed to BINS).  It is fitted twice, on either half of the texts, and no text is scored by its own half, so
   that a text's words don't vouch for its tag.
2. How many of a text's words and how far its tag are believed is measured on the same halves: a tag is taken to be right with
   probability trust, and else to be drawn from the prior, whatever the text.  The pair (temper, trust) that makes the held-out tags
   likeliest is taken, of pairs within LIKELY nats the one of the largest trust.  What it gains over the prior is reported.
3. A document's membership is the posterior of its domain given text and tag by that model; without a tag the text alone decides.
   Where texts gain nothing, nothing speaks against the tags, and a tagged document belongs to its tag's domain wholly.
   A membership is sparse: in 256ths, its KEEP largest domains, its tag's, and the rest spread as the prior is.
4. Documents of one membership have one rate, so their tokens are summed first.  Projected-gradient least squares finds rates
   r >= 0 such that the expected tokens of each domain, the sum over documents of rate x tokens x membership, match the
   targets.  A step needs the domain totals alone, which tasks sum and the driver adds: rates are a function of the steps so far.
   Sums are of whole numbers, so that they don't depend on how rows are dealt to tasks.
5. A document is taken floor(rate) times or once more, by cumulative rounding of the rates of its tag's documents in order of size:
   the tokens that are really taken then differ from the expected ones by at most the largest document's in each stratum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, for_worker, fresh

BINS = 1 << 14
MAX_LABELLED = 20_000
TEXT_CLASSES = 256  # the largest domains have words of their own, the others share theirs; all have memberships and targets of their own
STEPS = 60
HALVES = 2
TEMPERS = (0.0, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0)  # so many words of a text are believed, at most; calibration picks one
SMOOTH = 20_000.0  # words of the common vocabulary that each domain starts with
TRUSTS = (0.2, 0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.999)
LIKELY = 2.0
MIN_GAIN = 0.01, 5.0  # nats a labelled document, and in all: texts that gain less tell nothing
KEEP = 8
SHARES, SHARE_BITS = 256, 9  # a membership is made of numbers domain << SHARE_BITS | 256ths
STRATUM = 8192  # documents that are rounded together
UNIT = 1024  # sums are in this part of a token


class Bins:
    """Words to bins, the same in every process."""

    def __init__(self, most: int = 400_000):
        self.known, self.most = {}, most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from zlib import crc32

        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = crc32(w) % BINS
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def half(text: Column) -> Column:
    """The half of the texts that a text belongs to; equal texts belong to the same one."""
    return F.pmod(F.xxhash64(text, F.lit("half")), F.lit(HALVES)).cast("int")


def labelled(docs: DataFrame, max_labelled: int) -> DataFrame:
    """(text, domain, half) of at most about max_labelled documents, chosen by a hash of the text."""
    known = docs.where("domain is not null")
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < max(1, int(max_labelled / n * (1 << 20))))
    return known.select("text", "domain", half(F.col("text")).alias("half"))


class Domains:
    """Names, the most frequent first, and their prior.  The number after the last one stands for the prior itself."""

    def __init__(self, names: list[str], counts: list[int], classes: int = TEXT_CLASSES):
        self.args = names, counts, classes  # what travels to executors
        self.names, self.place = names, {d: i for i, d in enumerate(names)}
        self.prior = np.array(counts, float) / sum(counts)
        self.k = min(len(names), classes)
        self.other = len(names) > classes  # then the last class is all other domains
        self.of_class = self.prior[: self.k].copy()
        self.of_class[-1] = self.prior[self.k - 1 :].sum()

    def places(self, tags: list[str | None]) -> np.ndarray:
        """The number of each tag's domain, -1 without one."""
        return np.array([-1 if d is None else self.place[d] for d in tags], np.int64)

    def within(self, places: np.ndarray) -> np.ndarray:
        """The share of each domain in its class."""
        return self.prior[places] / self.of_class[np.minimum(places, self.k - 1)]

    def by_domain(self, sums: np.ndarray) -> np.ndarray:
        """Sums by number, the prior's spread over the domains."""
        return sums[:-1] + sums[-1] * self.prior

    def by_number(self, values: np.ndarray) -> np.ndarray:
        """Values by domain, and their mean under the prior."""
        return np.append(values, values @ self.prior)


class Classifier:
    """Text to posteriors over classes: word log odds of each half's complement, (HALVES, BINS, classes), and what calibration found."""

    def __init__(self, words: np.ndarray, prior: np.ndarray, temper: float = 0.0, trust: float = 1.0, gain: float = 0.0):
        self.args = self.words, self.prior, self.temper, self.trust, self.gain = words, prior, temper, trust, gain

    def evidence(self, texts: list[bytes | None], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of each text, and their summed log odds."""
        bins = for_worker("bins", Bins)
        n, log = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.prior)))
        for i, (text, h) in enumerate(zip(texts, halves, strict=True)):
            split = (text or b"").split()
            n[i] = len(split)
            if split:
                used = bins(split)
                log[i] = self.words[h][used].sum(axis=0, dtype=float) if len(used) < BINS else np.bincount(used, minlength=BINS) @ self.words[h].astype(float)
        return n, log

    def posterior(self, n: np.ndarray, log: np.ndarray, temper: float | None = None) -> np.ndarray:
        t = self.temper if temper is None else temper
        log = np.log(self.prior) + log * (t / np.maximum(n, max(t, 1.0)))[:, None]
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def calibrated(fits: np.ndarray, n: int) -> tuple[float, float, float]:
    """(temper, trust, gain) from the held-out log likelihoods of n tags, (tempers, trusts), beyond the prior's."""
    i, j = np.nonzero(fits >= fits.max() - LIKELY)
    j = j.max()
    i = fits[:, j].argmax()
    gain = float(fits[i, j])
    if gain <= max(MIN_GAIN[0] * n, MIN_GAIN[1]):
        return 0.0, 1.0, 0.0
    return TEMPERS[i], TRUSTS[j], gain / n


def learned(docs: DataFrame, domains: Domains, max_labelled: int) -> Classifier:
    """The classifier, from docs (text, domain)."""
    sample, k = labelled(docs, max_labelled), domains.k
    # names, counts, and HALVES x BINS x classes log odds: nothing that grows with the number of documents
    known = docs.sparkSession.sparkContext.broadcast(domains.args)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], np.ndarray] = {}
        bins, domains = for_worker("bins", Bins), Domains(*known.value)
        for b in batches:
            for t, d, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = counts.setdefault((h, min(domains.place[d], k - 1)), np.zeros(BINS, np.int64))
                at += np.bincount(bins((t or b"").split()), minlength=BINS)
        for (h, d), own in counts.items():
            at = np.flatnonzero(own)
            part = [pa.array(np.full(len(at), x, np.int32)) for x in (h, d)]
            yield pa.RecordBatch.from_arrays([*part, pa.array(at.astype(np.int32)), pa.array(own[at])], ["half", "domain", "bin", "n"])

    # At most HALVES x classes x BINS sums reach the driver, whatever the input.
    sums = sample.mapInArrow(run, "half int, domain int, bin int, n long").groupBy("half", "domain", "bin").agg(F.sum("n").alias("n")).toArrow()
    own = np.zeros((HALVES, k, BINS))
    own[tuple(sums[c].to_numpy() for c in ("half", "domain", "bin"))] = sums["n"].to_numpy()
    words = np.zeros((HALVES, BINS, k), np.float32)
    for h in range(HALVES):
        counts = own.sum(axis=0) - own[h]
        share = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * BINS)
        log = np.log((counts + SMOOTH * share) / (counts.sum(axis=1, keepdims=True) + SMOOTH))
        words[h] = (log - log.mean(axis=0)).T
    spread = docs.sparkSession.sparkContext.broadcast(words)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        domains, total = Domains(*known.value), np.zeros(len(TEMPERS) * len(TRUSTS) + 1, np.int64)
        classifier = Classifier(spread.value, domains.of_class)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                texts, tags, halves = (c.to_pylist() for c in whole.slice(at, 64).columns)
                n, log = classifier.evidence(texts, np.array(halves))
                place = domains.places(tags)
                of_class, within = (np.arange(len(tags)), np.minimum(place, k - 1)), domains.within(place)
                fits = []
                for t in TEMPERS:
                    odds = classifier.posterior(n, log, t)[of_class] * within / domains.prior[place]
                    fits += [int(np.rint(np.log(trust * odds + 1 - trust) * UNIT).sum()) for trust in TRUSTS]
                total += [*fits, len(tags)]
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["fit"])

    fits = sample.mapInArrow(fit, "fit array<long>").select(F.posexplode("fit").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")
    if not len(fits):
        return Classifier(words, domains.of_class)
    *found, n = fits["x"].tolist()
    return Classifier(words, domains.of_class, *calibrated(np.array(found).reshape(len(TEMPERS), len(TRUSTS)) / UNIT, max(n, 1)))


def encoded(parts: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """Memberships of rows of shares that sum to one, at the given places: 256ths, rounded by largest remainders, without zeros."""
    whole = np.floor(parts * SHARES + 1e-9)
    missing = SHARES - whole.sum(axis=1, keepdims=True)
    order = np.argsort(np.argsort(whole - parts * SHARES, axis=1, kind="stable"), axis=1, kind="stable")
    whole = (whole + (order < missing)).astype(np.int64)
    return [np.sort((p << SHARE_BITS | s)[s > 0]) for p, s in zip(places, whole, strict=True)]


def members(docs: DataFrame, domains: Domains, classifier: Classifier) -> DataFrame:
    """docs (text, domain, ..) without text, with tokens and member, the row's membership."""
    spread = docs.sparkSession.sparkContext.broadcast((domains.args, classifier.args))
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        domains, classifier = Domains(*spread.value[0]), Classifier(*spread.value[1])
        k, trust, beyond = domains.k, classifier.trust, len(domains.names)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                texts, place = b.column("text").to_pylist(), domains.places(b.column("domain").to_pylist())
                if trust == 1.0:  # texts gain nothing: the tag, or without one the prior
                    n = np.array([len((t or b"").split()) for t in texts], np.int64)
                    codes = list(np.where(place < 0, beyond, place)[:, None] << SHARE_BITS | SHARES)
                else:
                    n, log = classifier.evidence(texts, b.column("half").to_numpy(zero_copy_only=False))
                    w = np.hstack([classifier.posterior(n, log), np.zeros((len(texts), 1))])  # classes, and the tag's domain
                    tagged = np.flatnonzero(place >= 0)
                    own, cls = place[tagged], np.minimum(place[tagged], k - 1)
                    moved = w[tagged, cls] * domains.within(own)
                    w[tagged, cls] -= moved
                    w[tagged, k] = moved * (1 + trust / ((1 - trust) * domains.prior[own]))
                    w = np.maximum(w, 0)
                    w /= w.sum(axis=1, keepdims=True)
                    alone = k - domains.other
                    top = np.argsort(-w[:, :alone], axis=1, kind="stable")[:, :KEEP]
                    parts = np.hstack([np.take_along_axis(w[:, :alone], top, axis=1), w[:, k:]])
                    parts = np.hstack([parts, np.maximum(0, 1 - parts.sum(axis=1, keepdims=True))])
                    codes = encoded(parts, np.hstack([top, np.maximum(place, 0)[:, None], np.full((len(texts), 1), beyond)]))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(n), pa.array(codes, pa.list_(pa.int64()))], [*names, "tokens", "member"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.withColumn("half", half(F.col("text"))).mapInArrow(run, f"{kinds}, tokens long, member array<long>")


class Members:
    """A batch of memberships, none of them empty."""

    def __init__(self, column: pa.ListArray):
        codes = column.flatten().to_numpy(zero_copy_only=False)
        self.n = column.value_lengths().to_numpy(zero_copy_only=False)
        self.start = np.concatenate(([0], np.cumsum(self.n)[:-1])).astype(np.int64)
        self.place, self.share = codes >> SHARE_BITS, (codes & ((1 << SHARE_BITS) - 1)) / SHARES

    def mean(self, values: np.ndarray) -> np.ndarray:
        """The mean of values by number under each membership."""
        return np.add.reduceat(values[self.place] * self.share, self.start)

    def sums(self, amounts: np.ndarray, size: int) -> np.ndarray:
        """Amounts by row dealt to the numbers, in whole UNITs."""
        out = np.zeros(size, np.int64)
        np.add.at(out, self.place, np.rint(np.repeat(amounts, self.n) * self.share * UNIT).astype(np.int64))
        return out

    def rates(self, pulls: list[np.ndarray]) -> np.ndarray:
        """Each row's rate after the steps so far: from 1, each step adds its mean pull, and no rate goes below 0."""
        r = np.ones(len(self.n))
        for pull in pulls:
            r = np.maximum(0.0, r + self.mean(pull))
        return r


def solved(known: DataFrame, domains: Domains, target: np.ndarray, steps: int = STEPS, close: float = 1e-3) -> tuple[list[np.ndarray], float]:
    """The steps of projected gradient descent on |totals - target| squared over known (tokens, member), each row's step scaled by its
    tokens; and the residual, the share of the target's tokens by which expected totals miss it after the last step.

    A scaled step along membership x gap changes the domain totals by H gap, H being the tokens-weighted sum of
    membership x membership; each gap is divided by H's row sum, which keeps the iteration from growing.
    """
    size = len(target) + 1

    def sums(pulls: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        spread = known.sparkSession.sparkContext.broadcast(pulls)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = np.zeros((2, size), np.int64)
            for b in batches:
                if b.num_rows:
                    m, n = Members(b.column(1)), b.column(0).to_numpy(zero_copy_only=False).astype(float)
                    r = m.rates(spread.value)
                    moving = (r > 0) | (m.mean(spread.value[-1]) > 0) if spread.value else r > 0
                    whole += [m.sums(n * r, size), m.sums(n * moving, size)]
            at = np.flatnonzero(whole.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, *whole[:, at])], ["i", "total", "weight"])

        rows = known.select("tokens", "member").mapInArrow(run, "i long, total long, weight long")
        got = rows.groupBy("i").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight")).toPandas()
        spread.destroy()
        out = np.zeros((2, size))
        out[:, got["i"].to_numpy(np.int64)] = got[["total", "weight"]].to_numpy(float).T / UNIT
        return domains.by_domain(out[0]), domains.by_domain(out[1])

    pulls: list[np.ndarray] = []
    while True:
        total, weight = sums(pulls)
        gap = target - total
        residual = float(np.abs(gap).sum() / max(target.sum(), 1.0))
        if residual <= close or len(pulls) == steps:
            return pulls, residual
        pulls.append(domains.by_number(np.where(weight > 1e-9, gap / np.maximum(weight, 1e-9), 0.0)))


def draw(rated: DataFrame) -> DataFrame:
    """rated (domain, n_tokens, rate, key, stratum, ..) with copies: rates rounded cumulatively in order of size, from a start by hash.

    Running sums of copies and of rates differ by less than one anywhere in that order, so summed tokens differ by at most those of
    the stratum's largest row.  A row's own rounding is up with the probability of its rate's rest.
    """
    unit, stratum = 1 << 30, ["domain", "stratum"]
    part = F.floor((F.col("rate") - F.floor("rate")) * unit).cast("long")
    start = F.pmod(F.xxhash64(F.coalesce("domain", F.lit("")), "stratum", F.lit("draw")), F.lit(unit))
    upto = F.sum(part).over(Window.partitionBy(*stratum).orderBy("n_tokens", "key").rowsBetween(Window.unboundedPreceding, 0))
    return rated.withColumn("upto", upto + start).withColumn(
        "copies", (F.floor("rate") + F.floor(F.col("upto") / unit) - F.floor((F.col("upto") - part) / unit)).cast("long")
    ).drop("upto")


def mixed(
    docs: DataFrame,
    target: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "source",
    flatten: float = 0.5,
    max_labelled: int = MAX_LABELLED,
    steps: int = STEPS,
    text_classes: int = TEXT_CLASSES,
) -> DataFrame:
    """One row per row of docs: doc_id, domain, n_tokens, posterior (of the row's own domain), rate, copies, and, alike in every row,
    basis ('text' where the classifier beats the prior on held-out tags, else 'tag'), gain (nats a labelled document by which it does),
    tag_trust (the measured share of right tags), residual (the share of target tokens that expected totals miss).

    target: shares of tokens by domain, for all domains named there; by default each domain's present tokens raised to
    the power `flatten`, which lifts small domains.  Shares are scaled to the tokens that docs has; a domain without
    documents stays empty, and its share is in the residual.  Tokens are words between white space.
    With basis 'tag' the real totals by tag are the targets, but for rounding.  With basis 'text' it is the expected totals
    that are: where text and tag disagree, a document counts for the domains that both make likely.  A classifier's and a tag's errors
    can't be told apart by this; both lower tag_trust.
    Nulls: null texts are empty; a null domain is unknown, and the text alone decides.  Rows with null or repeated ids are
    rows of their own, rounded by id, text and place in the table.
    Empty texts have no tokens and the posterior of their tag and the prior.  Very long texts are read whole, one at a time.
    Beyond text_classes domains, the words of the smaller ones are counted together; their memberships, targets and totals
    stay their own.  Names and totals of all domains lie on the driver, about 1 KB a domain.  Repeated rows are rated alike.
    Empty tables give empty results.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.col(domain_col).cast("string").alias("domain"))
    sizes = [tuple(r) for r in rows.groupBy("domain").count().orderBy(F.desc("count"), "domain").collect()]
    named = [(d, n) for d, n in sizes if d is not None]
    told = lambda df, *values: df.withColumns(dict(zip(("basis", "gain", "tag_trust", "residual"), map(F.lit, values), strict=True)))
    if not named:
        tokens = F.size(F.filter(F.split(F.col("text").cast("string"), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).cast("long")
        plain = rows.select("doc_id", "domain", F.greatest(tokens, F.lit(0)).alias("n_tokens"), F.lit(1.0).alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"))
        return told(plain, "tag", 0.0, 1.0, 0.0)
    domains = Domains([d for d, _ in named], [n for _, n in named], text_classes)
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text", F.monotonically_increasing_id()))
    classifier = learned(rows, domains, max_labelled)
    known = cut(members(keyed, domains, classifier))
    groups = cut(known.groupBy("member").agg(F.sum("tokens").alias("tokens")))
    now = np.zeros(len(named))
    for d, n in known.where("domain is not null").groupBy("domain").agg(F.sum("tokens")).collect():
        now[domains.place[d]] = n
    share = {d: max(0.0, x) for d, x in target.items()} if target else {d: float(n) ** flatten for d, n in zip(domains.names, now, strict=True)}
    total = float(groups.agg(F.sum("tokens")).first()[0] or 0)
    want = np.array([share.get(d, 0.0) for d in domains.names]) * (total / (sum(share.values()) or 1.0))
    pulls, residual = solved(groups, domains, want, steps)
    absent = 1.0 - want.sum() / total if total and sum(share.values()) else 0.0
    spread = docs.sparkSession.sparkContext.broadcast((domains.args, pulls, {d: -(-n // STRATUM) for d, n in sizes}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (*args,), pulls, strata = spread.value
        domains = Domains(*args)
        for b in batches:
            if not b.num_rows:
                continue
            tags, m = b.column("domain").to_pylist(), Members(b.column("member"))
            place = np.repeat(domains.places(tags), m.n)
            prior = np.append(domains.prior, 0.0)
            each = m.share * np.where(m.place == place, 1.0, np.where(m.place == len(domains.names), prior[place], 0.0))
            tagged = np.add.reduceat(each, m.start)
            largest = np.maximum.reduceat(m.share * np.where(m.place == len(domains.names), domains.prior.max(), 1.0), m.start)
            own = np.where(domains.places(tags) < 0, largest, tagged)
            stratum = b.column("key").to_numpy() % np.array([strata[d] for d in tags])
            columns = [b.column("doc_id"), b.column("domain"), b.column("tokens"), *map(pa.array, (own, m.rates(pulls), stratum)), b.column("key")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "domain", "n_tokens", "posterior", "rate", "stratum", "key"])

    rated = known.select("doc_id", "domain", "tokens", "member", "key").mapInArrow(
        run, "doc_id long, domain string, n_tokens long, posterior double, rate double, stratum long, key long"
    )
    out = draw(rated).select("doc_id", "domain", "n_tokens", "posterior", "rate", "copies")
    return told(out, "text" if classifier.trust < 1 else "tag", classifier.gain, classifier.trust, residual + max(absent, 0.0))


def taken(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as its own copies in mixed() say, whatever its id.

    Nulls, empty and long texts, repeated rows and empty tables are as in mixed(); other columns stay as they are, whatever they are called.
    """
    row, copy = fresh(docs.columns, "row", "copy")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    copies = mixed(rows, id_col=row, **how).where("copies > 0").select(F.col("doc_id").alias(row), "copies")
    copies = copies.select(row, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias(copy))
    return rows.join(copies, row).select(*[F.col(f"`{c}`") for c in docs.columns])
