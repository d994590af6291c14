"""Token counts by the whole-token shortcut (operator 11).

1. Once, on the driver, every string of the vocabulary is held against the library: those that come back as their own single id
   and that the tokenizer's cut leaves in one piece are proven whole tokens.  The set is at most the vocabulary.
2. The same proof covers the cut itself: over all code points of the first two planes the pattern used here is compared with the
   library's own cut.  Texts with a code point that is not proven, or that spell out an added token, are left to the library.
3. In tasks every text is cut into pre-tokens.  Those that are proven count one each; only the rest is merged by the library, each
   distinct one once for a worker's bounded memory.

No row is shuffled; a task holds a batch and the proven set.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import latest_for_worker

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
BLOCK = 1 << 20  # characters of a text that are cut at once
REMEMBERED, LONGEST = 400_000, 32  # entries of a worker's memory, characters of the longest one


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def libraries(path: str):
    """The tokenizer as it is, and one that merges a pre-token without cutting it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer, pre_tokenizers

    tok, uncut = Tokenizer.from_file(path), Tokenizer.from_file(path)
    for t in (tok, uncut):
        t.no_truncation()
        t.no_padding()
    uncut.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tok, uncut


def class_of(kind: str) -> str:
    """The first plane's code points of a general category, as ranges of a pattern."""
    runs = groupby(enumerate(c for c in range(0x10000) if unicodedata.category(chr(c))[0] == kind), lambda x: x[1] - x[0])
    return ranges([(run[0][1], run[-1][1] + 1) for run in (list(r) for _, r in runs)])


def ranges(of: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in of)


def cutter():
    """The tokenizer's own cut into pre-tokens: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"""
    letters, numbers = class_of("L"), class_of("N")
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+").findall


def unproven(tok, cut, first: int, last: int, fine: bool = True) -> list[tuple[int, int]]:
    """Ranges of code points from first to last (excluded) that the pattern and the library class differently; all of them, if not fine."""
    probe = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}\n" for c in range(first, last))
    at, ends = 0, []
    for piece in cut(probe):
        at += len(piece)
        ends.append(at)
    if ends == [b for _, (_, b) in tok.pre_tokenizer.pre_tokenize_str(probe)]:
        return []
    if last - first == 1 or not fine:
        return [(first, last)]
    mid = (first + last) // 2
    left, right = unproven(tok, cut, first, mid), unproven(tok, cut, mid, last)
    if left and right and left[-1][1] == right[0][0]:
        return [*left[:-1], (left[-1][0], right[0][1]), *right[1:]]
    return left + right


@lru_cache(maxsize=4)
def proof(path: str) -> tuple[tuple[str, ...], tuple[tuple[int, int], ...]]:
    """The strings that encode alone as one token, and the ranges of code points that are left to the library."""
    from tokenizers import decoders

    tok, uncut = libraries(path)
    cut, decoder = cutter(), decoders.ByteLevel()
    odd = [r for a in [*range(0, 0xD800, 0x400), *range(0xE000, 0x10000, 0x400)] for r in unproven(tok, cut, a, a + 0x400)]
    odd += [r for a in range(0x10000, 0x20000, 0x40) for r in unproven(tok, cut, a, a + 0x40, fine=False)]
    odd += [(0xD800, 0xE000), (0x20000, 0x110000)]
    vocab = tok.get_vocab(with_added_tokens=False)
    strings = [(decoder.decode([t]), i) for t, i in vocab.items()]
    alone = uncut.encode_batch_fast([s for s, _ in strings], add_special_tokens=False)
    return tuple(sorted(s for (s, i), e in zip(strings, alone, strict=True) if e.ids == [i] and cut(s) == [s])), tuple(odd)


class TokenCounter:
    """Counts the tokens of texts, with the proof at hand."""

    def __init__(self, path: str, proven: tuple[tuple[str, ...], tuple[tuple[int, int], ...]]):
        self.tok, self.uncut = libraries(path)
        self.whole, self.cut = frozenset(proven[0]), cutter()
        self.added = [a.content for a in self.tok.get_added_tokens_decoder().values()]
        near = min(a for a, _ in proven[1] if a > 0x7F)
        self.far, self.unproven = re.compile(f"[{ranges([(near, 0x110000)])}]").search, re.compile(f"[{ranges(list(proven[1]))}]").search
        self.low = [chr(c) for a, b in proven[1] for c in range(a, min(b, 0x80))]
        self.border = re.compile(r"\S(?= \S)").search
        self.known: dict[str, int] = {}

    def left(self, text: str) -> bool:
        """Is the text one for the library?"""
        if any(a in text for a in self.added) or any(c in text for c in self.low):
            return True
        return bool(self.far(text) and self.unproven(text))

    def blocks(self, text: str) -> Iterator[str]:
        """Parts of a very long text: a single space between two other characters always opens a pre-token."""
        at = 0
        while len(text) - at > BLOCK and (found := self.border(text, at + BLOCK)):
            yield text[at : found.end()]
            at = found.end()
        yield text[at:]

    def merged(self, pieces: list[str]) -> int:
        """The tokens of pre-tokens that are not whole tokens."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list(set(pieces).difference(known))
        fresh = dict(zip(new, (len(e.ids) for e in self.uncut.encode_batch_fast(new, add_special_tokens=False)), strict=True)) if new else {}
        known.update((p, n) for p, n in fresh.items() if len(p) <= LONGEST)
        return sum(fresh[p] if len(p) > LONGEST else known[p] for p in pieces) if fresh else sum(map(known.__getitem__, pieces))

    def __call__(self, text: str) -> tuple[int, int]:
        """Tokens, and how many of them are pre-tokens proven whole (none where the library takes the text)."""
        if self.left(text):
            return len(self.tok.encode(text, add_special_tokens=False).ids), 0
        tokens = shortcut = 0
        for block in self.blocks(text):
            pieces = self.cut(block)
            rest = [p for p in pieces if p not in self.whole]
            shortcut += len(pieces) - len(rest)
            tokens += len(pieces) - len(rest) + self.merged(rest)
        return tokens, shortcut


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit, n_whole (pre-tokens counted by the shortcut).

    Nulls: a null text is an empty one of 0 bytes and 0 tokens; a null id stays null.  Repeated rows are counted each; very long
    texts are counted whole, in blocks.  An empty table gives none.  Other columns are not read.
    """
    path = tokenizer or tokenizer_path()
    proven = docs.sparkSession.sparkContext.broadcast(proof(path))  # at most the vocabulary's strings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = latest_for_worker("token counts", path, lambda: TokenCounter(path, proven.value))
        for b in batches:
            got = [count(t.as_py() or "") for t in b.column(2)]
            tokens = [n for n, _ in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array([w for _, w in got], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_whole long")
