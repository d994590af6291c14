"""Spelling variant grouping by finite-state composition (operator 12).

Words that differ by one inserted, deleted or replaced code point are the pairs that the machine A o E o A accepts: A is the
minimised acceptor of the vocabulary, E the transducer that makes one edit.  Its states are (state, edits made, state), and as
A is deterministic, the two states are the same one as long as no edit was made.  So the work is cut by the initial states that
are reached without an edit, which are the vocabulary's prefixes:

1. Spark counts words by prefix.  A prefix that more than GROUP_WORDS words share is expanded: its arcs that make the edit right there
   lead to states from where both sides must read the same, which is an equi-join on prefix and remainder (at most a row
   for each letter and key); its other arcs lead to the longer prefixes, which are looked at in turn.
2. Each prefix that is small enough is one initial state of a task: the remainders of its words become a minimised acceptor, which
   is composed with E and itself.  An acceptor's states carry the number of words behind them, so pairs are pairs of places
   in the sorted list, and states that many words share are composed once.
3. Each path makes its edit at the first place where the words differ, so no pair is accepted twice.

No group grows with the data and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, MISSPELT = 5, 3, 97
GROUP_WORDS = 8192


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = MISSPELT) -> DataFrame:
    """(word, n): the distinct words of at least LEAST_LENGTH code points and LEAST_COUNT occurrences.  Of a run whose checksum
    with its document's id is a multiple of `every`, one code point is left out."""
    doc = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.translate(F.col(text_col), ascii_uppercase, ascii_lowercase)
    runs = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(RUN), 0)).alias("run")).where(F.length("run") >= LEAST_LENGTH)
    runs = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Acceptor:
    """The minimised acceptor of sorted distinct words; a state is a number, and its arcs lead to smaller numbers."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []  # letter: the state behind it, words of this state before it
        self.size: list[int] = []  # words behind a state
        known: dict[tuple, int] = {}
        open_: list[tuple[list[bool], list[tuple[str, int]]]] = [([False], [])]  # states along the last word

        def close(final: bool, arcs: list[tuple[str, int]]) -> int:
            key = (final, *arcs)
            if key not in known:
                known[key] = len(self.final)
                at, out = int(final), {}
                for letter, to in arcs:
                    out[letter] = (to, at)
                    at += self.size[to]
                self.final.append(final)
                self.arcs.append(out)
                self.size.append(at)
            return known[key]

        last = ""
        for word in [*words, None]:
            same = 0
            if word is not None:
                most = min(len(word), len(last))
                while same < most and word[same] == last[same]:
                    same += 1
            while len(open_) > same + 1:
                final, arcs = open_.pop()
                open_[-1][1].append((last[len(open_) - 1], close(final[0], arcs)))
            if word is not None:
                open_.extend(([False], []) for _ in range(len(word) - same))
                open_[-1][0][0] = True
                last = word
        self.start = close(open_[0][0][0], open_[0][1])

    def common(self, a: int, b: int, at: int, bt: int, but: str = "") -> Iterator[tuple[int, int]]:
        """Places, counted from at and bt, of the words that both states accept; none of them beginning with `but`."""
        final, arcs, todo = self.final, self.arcs, [(a, b, at, bt)]
        while todo:
            a, b, at, bt = todo.pop()
            if a == b and not but:
                yield from ((at + i, bt + i) for i in range(self.size[a]))
                continue
            if final[a] and final[b]:
                yield at, bt
            left, right = arcs[a], arcs[b]
            for letter in left if len(left) <= len(right) else right:
                if letter != but and letter in left and letter in right:
                    (p, x), (q, y) = left[letter], right[letter]
                    todo.append((p, q, at + x, bt + y))
            but = ""

    def pairs(self) -> list[tuple[int, int]]:
        """The accepted pairs of this acceptor, one edit and this acceptor again, as places in the sorted words."""
        made: list[list[tuple[int, int]]] = []
        for state, arcs in enumerate(self.arcs):  # what is behind an arc has been composed before
            found: list[tuple[int, int]] = []
            out = list(arcs.items())
            for k, (letter, (to, at)) in enumerate(out):
                found += [(at + i, at + j) for i, j in made[to]]
                for _, (other, bt) in out[k + 1 :]:  # replaced
                    found += self.common(to, other, at, bt)
                if len(out) > 1 or self.final[state]:  # left out on one side; words alike one letter further differ only there
                    found += self.common(to, state, at, 0, letter)
            made.append(found)
        return made[self.start]


def near_in(words: list[str], counts: list[int]) -> tuple[list[int], list[int]]:
    """For sorted distinct words: how many near ones each has, and the place of the most frequent of them (-1: none)."""
    n_near, best = [0] * len(words), [-1] * len(words)
    for i, j in Acceptor(words).pairs():
        for a, b in ((i, j), (j, i)):
            n_near[a] += 1
            if best[a] < 0 or (counts[b], -b) > (counts[best[a]], -best[a]):
                best[a] = b
    return n_near, best


def composed(ready: DataFrame, buckets: int) -> DataFrame:
    """ready (word, n, depth): words of initial states that are small enough, all words of a state in one bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: dict[str, list[tuple[str, int]]] = {}
        for word, n, depth in zip(pdf["word"], pdf["n"].tolist(), pdf["depth"].tolist(), strict=True):
            groups.setdefault(word[:depth], []).append((word, n))
        out = []
        for prefix, of in groups.items():
            of.sort()
            n_near, best = near_in([w[len(prefix) :] for w, _ in of], [n for _, n in of])
            out += [(of[i][0], k, -of[b][1], of[b][0]) for i, (k, b) in enumerate(zip(n_near, best, strict=True)) if k]
        return pd.DataFrame(out, columns=["word", "n_near", "less", "form"])

    bucket = F.pmod(F.xxhash64(F.substring(F.col("word"), F.lit(1), F.col("depth"))), F.lit(buckets))
    return ready.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(run, "word string, n_near long, less long, form string")


def edited_at(hot: DataFrame, depth: int) -> DataFrame:
    """Near words of an expanded state, whose first difference lies right behind a prefix of `depth` code points."""
    word, no = F.col("word"), F.lit(None).cast("string")
    rest = lambda w, at: F.substring(w, F.lit(at + 1), F.length(w))
    letter = lambda w: F.substring(w, depth + 1, 1)
    left_out = hot.where(F.length(word) > depth).select(F.concat(F.substring(word, 1, depth), rest(word, depth + 1)).alias("key"), letter(word).alias("out"), "word", "n")
    met = left_out.unionByName(hot.select(word.alias("key"), no.alias("out"), "word", "n"))
    met = met.groupBy("key").agg(F.collect_list(F.struct("word", "n", "out")).alias("all")).where(F.size("all") > 1)
    each = met.select("all", F.explode("all").alias("x"))
    differ = lambda y: F.when(F.col("x.out").isNull(), y["out"] != letter(F.col("x.word"))).when(y["out"].isNull(), F.col("x.out") != letter(y["word"])).otherwise(F.lit(True))
    near = each.select("x", F.filter("all", lambda y: (y["word"] != F.col("x.word")) & differ(y)).alias("near")).where(F.size("near") > 0)
    best = F.array_min(F.transform("near", lambda y: F.struct((-y["n"]).alias("less"), y["word"].alias("form"))))
    return near.select("x.word", F.size("near").cast("long").alias("n_near"), best.alias("best")).select("word", "n_near", "best.less", "best.form")


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """words (word, n) with n_near and, of the near words, the most frequent one as near, near_n (ties: the smallest)."""
    hot, total, depth, parts, ready = words, words.count(), 0, [], []
    if total <= group_words:
        ready.append(words.withColumn("depth", F.lit(0)))
    while total > group_words:  # here all of hot stand below prefixes of depth code points that are to be expanded
        parts.append(edited_at(hot, depth))
        longer = hot.where(F.length("word") > depth).withColumn("prefix", F.substring("word", 1, depth + 1))
        many = longer.groupBy("prefix").agg(F.count("*").alias("m")).where(F.col("m") > group_words).select("prefix", F.lit(True).alias("hot"))
        split = cut(longer.join(many, "prefix", "left").select("word", "n", F.coalesce("hot", F.lit(False)).alias("hot")))
        depth += 1
        ready.append(split.where("not hot").select("word", "n", F.lit(depth).alias("depth")))
        hot = split.where("hot").select("word", "n")
        if not hot.take(1):
            break
    small = ready[0]
    for r in ready[1:]:
        small = small.unionByName(r)
    found = composed(small, max(1, ceil(total / group_words)))
    for p in parts:
        found = found.unionByName(p)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.form").alias("near"), (-F.col("best.less")).alias("near_n")
    )


def last_forms(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, root): each word's last form, found by jumping twice as far each time."""
    while True:
        next_ = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        links = cut(links.join(next_, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if not links.where("moved").take(1):
            return links.select("word", "root")
        links = links.select("word", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_words: int = GROUP_WORDS, every: int = MISSPELT) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word's form is its most frequent near word (ties: the smallest), if that occurs twice as often at least; root is where forms end.
    Nulls: a null text has no words; a null id stands as an empty one before the checksum's colon.  Repeated rows are counted each.
    Very long words are words like any other.  Empty tables give none.  Other columns are not read.
    """
    words = cut(word_counts(docs, id_col, text_col, every))
    near = near_words(words, group_words)
    is_form = F.col("near_n") >= 2 * F.col("n")
    formed = cut(near.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    roots = last_forms(formed.where("form is not null").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
