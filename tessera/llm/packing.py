"""Packing token sequences by non-negative least squares over a length histogram (operator 7).

1. Every text is encoded; windows of full length are cut off its front, and the rest is its remainder.
2. Remainders are dealt by hash to groups of about GROUP_ROWS rows, and a group's lengths make a histogram.
3. All combinations of two or three of its lengths that fill a window exactly are enumerated, and non-negative
   least squares solves how often to use each, against the histogram.  The counts are rounded cumulatively, so that
   many small ones are used as often as they sum up to, and what they place is taken from the histogram: first for pairs, which
   leave less to combine, then for all combinations until a solution places hardly more.
4. What is left is packed greedily: first whole, then cut to fit.

Fewer documents are cut than by the greedy part alone, with no more sequences.  A group's last sequence is the only one
that may hold padding, so padding falls as 1 / GROUP_ROWS.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from math import ceil
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, for_worker

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
GROUP_ROWS = 8192
STEPS = 40


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts.  White space never lies inside a token of this vocabulary, nor does a token reach over a
    border between letters, a digit and signs: what stands between white space is encoded once and remembered, and
    so are its parts.  Both memories are of bounded size.  Texts that spell out one of the tokenizer's added tokens, which
    it takes from raw text before it cuts, are encoded whole."""

    ODD_SPACE = tuple("\x1c\x1d\x1e\x1f")  # these split for Python only
    # Fixed value: the vocabulary's own cut into parts; used below U+0250, where no Unicode version differs.
    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, most: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import regex
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        self.whole = (*self.ODD_SPACE, *(a.content for a in self.tok.get_added_tokens_decoder().values()))
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.find, self.far = regex.compile(self.PARTS).findall, re.compile("[^\x00-\u024f]").search

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def of_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of parts, which are encoded as one text and told apart by their word numbers."""
        e = self.tok.encode(" ".join(parts), add_special_tokens=False)
        ids, word = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids, np.int64)
        at = np.searchsorted(word, np.arange(len(parts) + 1)) * 4
        return [ids[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def cut(self, word: str) -> list[str]:
        if word.isalpha():
            return [word]
        if word[-1] in ".,;:?!" and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.find(word)

    def learn(self, words: set[str], far: set[str]) -> None:
        """words: below U+0250, where NFC changes nothing, and in lower case; far: as they are."""
        self.known.update(zip(far, self.plain(list(far)), strict=True))
        cut = [(w, self.cut(w)) for w in words]
        if len(self.parts) > 2 * self.most:
            self.parts.clear()
        new = list({part for _, found in cut for part in found}.difference(self.parts))
        for at in range(0, len(new), 5_000):
            self.parts.update(zip(new[at : at + 5_000], self.of_parts(new[at : at + 5_000]), strict=True))
        parts, known = self.parts, self.known
        for w, found in cut:
            known[w] = parts[w] if len(found) == 1 else b"".join([parts[x] for x in found])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        pieces, far = [], set()
        for t in texts:
            if any(c in t for c in self.whole):
                pieces.append(None)
            elif self.far(t):
                pieces.append([w if self.far(w) else w.lower() for w in t.split()])
                far.update(filter(self.far, pieces[-1]))
            else:
                pieces.append(t.lower().split())
        if len(self.known) > self.most:
            self.known.clear()
        new = set(chain.from_iterable(p for p in pieces if p)).difference(self.known)
        far &= new
        self.learn(new - far, far)
        get = self.known.__getitem__
        return [
            np.frombuffer(b"".join(map(get, p)), "<u4") if p is not None else np.frombuffer(self.plain([t])[0], "<u4") for t, p in zip(texts, pieces, strict=True)
        ]


def encoded(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, window: int) -> DataFrame:
    """A row per row of docs: doc_id, doc_tokens, the checksums of its full windows, its remainder's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = for_worker(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids = [np.append(x, np.uint32(END_ID)).astype("<u4") for x in encode([t.as_py() or "" for t in b.column(1)])]
                full = [[crc32(x[i : i + window].tobytes()) for i in range(0, len(x) - window + 1, window)] for x in ids]
                rest = [x[len(f) * window :] for x, f in zip(ids, full, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array(full, pa.list_(pa.int64())),
                        pa.array([len(x) for x in rest], pa.int32()),
                        pa.array([x.astype("<u2").tobytes() if not len(x) or x.max() < 65536 else x.tobytes() for x in rest], pa.binary()),
                    ],
                    ["doc_id", "doc_tokens", "full", "rest_tokens", "rest"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, doc_tokens long, full array<long>, rest_tokens int, rest binary"
    )


def combinations_of(histogram: np.ndarray, window: int, triples: bool = True) -> np.ndarray:
    """All pairs and triples of lengths that the histogram has and that fill the window exactly, the longest length
    first and in its order; zero stands for no length."""
    have = np.flatnonzero(histogram)
    have = have[have > 0]
    there = np.zeros(window + 1, bool)
    there[have] = True
    pairs = have[(2 * have >= window) & there[window - have]]
    out = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], axis=1)]
    if triples:
        a, b = np.meshgrid(have, have, indexing="ij")
        c = window - a - b
        ok = (a >= b) & (b >= c) & (c > 0)
        a, b, c = a[ok], b[ok], c[ok]
        ok = there[c]
        out.append(np.stack([a[ok], b[ok], c[ok]], axis=1))
    found = np.concatenate(out)
    return found[np.lexsort((found[:, 2], found[:, 1], -found[:, 0]))]


def solve_counts(histogram: np.ndarray, combos: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram| squared, by accelerated projected gradient;
    A has a column per combination with its use of each length."""
    n, columns = len(histogram), combos.T.copy()
    used = (columns > 0).astype(float)
    apply = lambda x: sum(np.bincount(c, weights=u * x, minlength=n) for c, u in zip(columns, used, strict=True))
    back = lambda r: sum(r[c] * u for c, u in zip(columns, used, strict=True))
    real = np.arange(n) > 0
    rate = 1.0 / (back(apply(np.ones(len(combos))) * real) + 1e-9)  # a bound of each row of A'A, so the scaled step never grows
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        nx = np.maximum(0, y + rate * back((histogram - apply(y)) * real))
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nx + (t - 1) / nt * (nx - x)
        x, t = nx, nt
    return x


def rounded(x: np.ndarray) -> np.ndarray:
    """Whole numbers whose running sums are those of x, rounded."""
    return np.diff(np.floor(np.cumsum(x) + 0.5), prepend=0.0).astype(int)


def planned(histogram: np.ndarray, window: int, least: float = 0.02) -> list[list[int]]:
    """The lengths of each sequence that the rounded solutions fill; the histogram is left with the rest."""
    out: list[list[int]] = []
    for triples in chain([False], repeat(True)):
        combos, before = combinations_of(histogram, window, triples), histogram.sum()
        if len(combos):
            counts = rounded(solve_counts(histogram, combos))
            for i in np.flatnonzero(counts).tolist():
                lengths = [n for n in combos[i].tolist() if n]
                need = Counter(lengths)
                times = min(int(counts[i]), *(int(histogram[n]) // m for n, m in need.items()))
                for n, m in need.items():
                    histogram[n] -= m * times
                out += [lengths] * times
        if triples and before - histogram.sum() <= least * before:
            return out


def pack_group(lengths: np.ndarray, window: int, plan: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(row, start in the remainder, length, sequence, offset) for remainders of the given lengths."""
    order = np.argsort(lengths, kind="stable")
    left: dict[int, list[int]] = {}
    for i in order.tolist():
        if lengths[i]:
            left.setdefault(int(lengths[i]), []).append(i)
    out, seq = [], 0
    for parts in planned(np.bincount(lengths, minlength=window + 1), window) if plan else []:
        at = 0
        for n in parts:
            out.append((left[n].pop(), 0, n, seq, at))
            at += n
        seq += 1
    # Greedy: the longest remainder opens a sequence, the longest ones that fit follow; a last gap is filled by cutting.
    sizes = np.zeros(window + 1, np.int64)
    for n, rows in left.items():
        sizes[n] = len(rows)
    starts: dict[int, int] = {}

    def take(n: int) -> tuple[int, int]:
        row = left[n].pop()
        sizes[n] -= 1
        return row, starts.pop(row, 0)

    while sizes.any():
        room = window
        while room and (fit := np.flatnonzero(sizes[: room + 1])).size:
            n = int(fit[-1])
            row, start = take(n)
            out.append((row, start, n, seq, window - room))
            room -= n
        if room and sizes.any():
            n = int(np.flatnonzero(sizes)[-1])
            row, start = take(n)
            out.append((row, start, room, seq, window - room))
            starts[row] = start + room
            left.setdefault(n - room, []).append(row)
            sizes[n - room] += 1
        seq += 1
    return out


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Nulls: a null text is an empty one, of the end id alone; rows with null ids are packed like any other.
    Repeated rows are packed as often as they occur.  Very long texts are encoded whole and cut at full windows.  Empty tables give
    no piece.  Other columns are not read.
    """
    rows = cut(encoded(docs, id_col, text_col, tokenizer or tokenizer_path(), window))
    groups = max(1, ceil(rows.where("rest_tokens > 0").count() / group_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["rest_tokens"].to_numpy()
        ids = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype("<u4") for x, n in zip(pdf["rest"], lengths, strict=True)]
        got = pack_group(lengths, window)
        at = np.array([g[0] for g in got], int)
        before = (pdf["doc_tokens"].to_numpy() - lengths)[at] if len(got) else np.zeros(0, int)
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"].astype("Int64").to_numpy()[at] if len(got) else [],
                "start": before + np.array([g[1] for g in got], int),
                "length": [g[2] for g in got],
                "ids_crc32": [crc32(ids[g[0]][g[1] : g[1] + g[2]].tobytes()) for g in got],
                "doc_tokens": pdf["doc_tokens"].to_numpy()[at],
                "sequence_id": [2 * (g[3] * groups + int(pdf["grp"].iloc[0])) for g in got],
                "offset": [g[4] for g in got],
            }
        )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    rest = rows.where("rest_tokens > 0").select(
        "doc_id", "doc_tokens", "rest_tokens", "rest", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("grp")
    )
    packed = rest.groupBy("grp").applyInPandas(run, schema)
    full = rows.select("doc_id", "doc_tokens", F.posexplode("full").alias("i", "crc"))
    full = full.select(
        "doc_id",
        (F.col("i").cast("long") * window).alias("start"),
        F.lit(window).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return packed.unionByName(full)
