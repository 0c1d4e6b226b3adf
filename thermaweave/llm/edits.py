"""Token counts that follow edits.

A document's pre-tokens (the pieces a byte-level BPE never merges across) are the leaves of a segment tree of token,
character and piece sums. An edit finds its leaf by descending along character sums and re-encodes only the pre-tokens
it touches plus as much context as its effect on the splitting reaches: from the pre-token before the edit until the new
splitting meets the old one again. A leaf may hold several pre-tokens or none, so an edit that changes their number
updates the sums above its leaves too; only where a leaf would hold more than MOST_IN_LEAF are leaves dealt anew.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, doc_columns, steps, table

#: Fixed value: the splitting pattern of the tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The edit script of the query: what personal data are replaced by. Fixed values.
REDACTIONS = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<mail>"), (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<address>"), (r"\+?\d[\d ()-]{7,}\d", "<number>"))
#: Counted pre-tokens kept by a task process.
MOST_KNOWN = 1 << 20
#: Pre-tokens in a leaf; characters behind an edit that are looked at first; those that a window's end may distort.
MOST_IN_LEAF, AHEAD, MARGIN = 32, 64, 4

_HELD: dict[str, "Counter"] = {}


def counter(path: str) -> "Counter":
    if path not in _HELD:
        _HELD[path] = Counter(path)
    return _HELD[path]


class Counter:
    """Splits texts and counts the tokens of pre-tokens."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, pieces: Sequence[str]) -> list[int]:
        known = self.known
        if len(known) > MOST_KNOWN:
            known.clear()
        out = []
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = known[p] = len(self.encoding.encode_ordinary(p))
            out.append(n)
        return out

    def tree(self, text: str) -> "Tree":
        return Tree(self, text)


class Tree:
    """A text as leaves of pre-tokens, and the sums of tokens, characters and pre-tokens of all subtrees in heap order."""

    def __init__(self, counter: Counter, text: str):
        self.counter = counter
        self.reencoded = self.touched = self.rebuilt = 0
        pieces = counter.pattern.findall(text)
        self._build(pieces, counter.count(pieces))

    def _build(self, pieces: list[str], counts: list[int]) -> None:
        n = len(pieces)
        self.width = 1 << max(0, n - 1).bit_length()
        self.sums = np.zeros((3, 2 * self.width), dtype=np.int64)
        self.sums[:, self.width : self.width + n] = counts, np.fromiter(map(len, pieces), dtype=np.int64, count=n), np.ones(n, dtype=np.int64)
        level = self.width
        while level > 1:
            self.sums[:, level // 2 : level] = self.sums[:, level : 2 * level : 2] + self.sums[:, level + 1 : 2 * level : 2]
            level //= 2
        self._flat, self.leaves = (pieces, counts), None

    def _open(self) -> None:
        """Leaves as lists (pre-tokens, their counts), from the first edit on."""
        if self.leaves is None:
            pieces, counts = self._flat
            self.leaves = [([p], [c]) for p, c in zip(pieces, counts, strict=True)] + [([], []) for _ in range(self.width - len(pieces))]
            self._flat = None

    @property
    def pieces(self) -> list[str]:
        return self._flat[0] if self.leaves is None else [p for leaf in self.leaves for p in leaf[0]]

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    @property
    def total(self) -> int:
        return int(self.sums[0, 1])

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 1])

    def _leaf(self, at: int, kind: int) -> tuple[int, int]:
        """The leaf that holds character (kind 1) or pre-token (kind 2) number `at`, and how many stand before it."""
        sums, node, before = self.sums[kind], 1, 0
        while node < self.width:
            node *= 2
            if at - before >= (left := int(sums[node])):
                before += left
                node += 1
        return node - self.width, before

    def _before(self, end: int) -> int:
        """The tokens of the first `end` pre-tokens, from the sums of O(log n) subtrees."""
        if end >= self.sums[2, 1]:
            return self.total
        leaf, before = self._leaf(end, 2)
        self._open()
        total, node = sum(self.leaves[leaf][1][: end - before]), leaf + self.width
        while node > 1:
            if node & 1:
                total += int(self.sums[0, node - 1])
            node //= 2
        return total

    def tokens(self, first: int, end: int) -> int:
        """The tokens of pre-tokens first ... end - 1."""
        return self._before(end) - self._before(first)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters start ... end - 1. Only touched pre-tokens and boundary context are split and encoded again."""
        self._open()
        total, shift = self.n_chars, len(new) - (end - start)
        # Where the text before `start` was split stays so, but for the two last pieces: what comes after may lengthen
        # one, or take a blank from it.
        first, at = self._leaf(max(start - 1, 0), 1) if total else (0, 0)
        if at:
            first, at = self._leaf(at - 1, 1)
        ahead = AHEAD
        while True:
            pieces, counts, reach, last = [], [], at, first
            while reach < min(end + ahead, total):
                last, _ = self._leaf(reach, 1)
                pieces += self.leaves[last][0]
                counts += self.leaves[last][1]
                reach += int(self.sums[1, self.width + last])
            old = "".join(pieces)
            window = old[: start - at] + new + old[end - at :]
            ends = np.cumsum([len(p) for p in pieces]).tolist() if pieces else []
            meets = {e + shift: k + 1 for k, e in enumerate(ends) if at + e >= end}
            safe = len(window) if reach == total else len(window) - MARGIN
            fresh: list[str] = []
            kept = len(pieces) if reach == total else None
            for m in self.counter.pattern.finditer(window):
                fresh.append(m.group())
                stop = m.end()
                if start - at + len(new) < stop <= safe and stop in meets:
                    kept = meets[stop]  # both splittings have a boundary here: from now on they are the same
                    break
            if kept is not None:
                break
            ahead *= 4
        self.reencoded += sum(map(len, fresh))
        pieces, counts = fresh + pieces[kept:], self.counter.count(fresh) + counts[kept:]
        each = -(-len(pieces) // (last - first + 1))
        if each > MOST_IN_LEAF:
            self.rebuilt += 1
            left, right = self.leaves[:first], self.leaves[last + 1 :]
            self._build([p for leaf in left for p in leaf[0]] + pieces + [p for leaf in right for p in leaf[0]], [c for leaf in left for c in leaf[1]] + counts + [c for leaf in right for c in leaf[1]])
            return
        for k in range(first, last + 1):
            cut = slice((k - first) * each, (k - first + 1) * each)
            self.leaves[k] = (pieces[cut], counts[cut])
            self.sums[:, self.width + k] = sum(counts[cut]), sum(map(len, pieces[cut])), len(pieces[cut])
        a, z = (self.width + first) // 2, (self.width + last) // 2
        while a >= 1:
            self.sums[:, a : z + 1] = self.sums[:, 2 * a : 2 * z + 2 : 2] + self.sums[:, 2 * a + 1 : 2 * z + 2 : 2]
            self.touched += z + 1 - a
            a, z = a // 2, z // 2


def redactions(text: str, compiled) -> list[tuple[int, int, str]]:
    """Edits (start, end, new text) that don't overlap, last first; of overlapping ones the one that begins first."""
    found = sorted((m.start(), -m.end(), new) for p, new in compiled for m in p.finditer(text))
    out, at = [], 0
    for start, end, new in found:
        if start >= at:
            out.append((start, -end, new))
            at = -end
    return out[::-1]


def count_tokens(docs: DataFrame, tokenizer: str | None = None, script=REDACTIONS) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, n_pretokens, n_tokens, n_edits, n_chars_edited, n_tokens_edited, n_chars_reencoded.

    n_tokens counts the text; n_tokens_edited counts it after all edits of the script (patterns and what replaces
    their matches), n_chars_reencoded how many characters that took. Null and empty texts have no tokens and no edits.
    Long texts are counted whole; repeated rows and null ids come out as they stand; an empty table gives no rows.
    tokenizer: a path that the executors can read; by default that of the installed byte_bpe_50k.tiktoken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex

        c = counter(tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        compiled = [(regex.compile(p), new) for p, new in script]
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, texts in steps(b):
                rows = []
                for i, t in enumerate(texts):
                    text = t.decode("utf-8")
                    tree = c.tree(text)
                    before, pretokens = tree.total, int(tree.sums[2, 1])
                    edits = redactions(text, compiled)
                    for e in edits:
                        tree.edit(*e)
                    rows.append((ids[first + i], len(text), pretokens, before, len(edits), tree.n_chars, tree.total, tree.reencoded))
                names = ("doc_id", "n_chars", "n_pretokens", "n_tokens", "n_edits", "n_chars_edited", "n_tokens_edited", "n_chars_reencoded")
                yield batch({n: (x, pa.int64()) for n, x in zip(names, zip(*rows, strict=True), strict=True)})

    return docs.mapInArrow(run, "doc_id long, n_chars long, n_pretokens long, n_tokens long, n_edits long, n_chars_edited long, n_tokens_edited long, n_chars_reencoded long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(doc_columns(table(spark, sf_dir, "documents")))
