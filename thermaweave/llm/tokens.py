"""Token ids of whole texts by a public tokenizer, with the ids of known words kept per task process.

The tokenizer splits a lower-cased text into runs of letters, single digits and runs of other marks, and encodes each by
itself. Latin texts are split here for many texts at once by numpy; each different word is encoded once by the tokenizer
and found again by its hash. Texts with anything else (other scripts, control characters, apostrophes before letters,
strings like special tokens) go through the tokenizer whole, so ids are the tokenizer's in every case.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np

from .common import mix, powers

#: Codes below this are split here.
LATIN = 0x250
_ELSE = re.compile(r"[^\t\n\x0b\x0c\r -~¡-įı-ɏ]|'[A-Za-z¡-ɏ]|<\|")
#: Slots of the word table and ids kept before it is emptied.
SLOTS, MOST_IDS = 1 << 22, 1 << 23

_HELD: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The process's encoder for a tokenizer file; its words stay known from task to task."""
    if path not in _HELD:
        _HELD[path] = Encoder(path)
    return _HELD[path]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kinds = [(1, regex.compile(r"\p{L}")), (2, regex.compile(r"\p{N}")), (0, regex.compile(r"\s"))]
        self.kind = np.array([next((k for k, p in kinds if p.match(chr(c))), 3) for c in range(LATIN)], dtype=np.int8)
        lower = [ord(chr(c).lower()[0]) for c in range(LATIN)]
        self.values = mix(np.array(lower, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(7))
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(SLOTS, dtype=np.uint64)
        self.at, self.n = np.zeros(SLOTS, dtype=np.int32), np.zeros(SLOTS, dtype=np.int32)
        self.others: dict[int, tuple[int, int]] = {}
        self.pool, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def _add(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        ids = [e.ids for e in encode(words, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        flat = np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(n.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = (self.used + np.cumsum(n) - n).astype(np.int32)
        self.used += len(flat)
        return at, n

    def _latin(self, texts: list[str]) -> list[np.ndarray]:
        if self.used > MOST_IDS:
            self._empty()
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-16-le"), dtype=np.uint16)
        kind = self.kind[codes]
        same = np.zeros(len(kind), dtype=bool)
        same[1:] = (kind[1:] == kind[:-1]) & (kind[1:] != 2) & (kind[1:] != 0)
        edge = np.flatnonzero(~same)
        word = kind[edge] != 0
        start, end = edge[word], np.append(edge[1:], len(kind))[word]
        up, down = powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(self.values[codes] * up[: len(codes)], out=sums[1:])
        key = mix((sums[end] - sums[start]) * down[start]) | np.uint64(1)
        slot = (key >> np.uint64(42)).astype(np.int64)
        at, n = self.at[slot], self.n[slot]
        missed = np.flatnonzero(self.keys[slot] != key)
        if len(missed):
            keys, where, back = np.unique(key[missed], return_index=True, return_inverse=True)
            found = [self.others.get(k) for k in keys.tolist()]
            new = [i for i, f in enumerate(found) if f is None]
            if new:
                first = missed[where[new]]
                a, c = self._add([joined[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)])
                free = slot[first]
                for i, x, y, s in zip(new, a.tolist(), c.tolist(), free.tolist(), strict=True):
                    found[i] = (x, y)
                    if self.keys[s]:
                        self.others[int(keys[i])] = (x, y)
                    else:
                        self.keys[s], self.at[s], self.n[s] = keys[i], x, y
            pairs = np.array(found, dtype=np.int32)[back]
            at[missed], n[missed] = pairs[:, 0], pairs[:, 1]
        # The flat ids of all texts.
        before = np.cumsum(n, dtype=np.int64) - n
        total = int(n.sum())
        flat = self.pool[np.repeat(at - before, n) + np.arange(total)]
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        cut = np.append(before, total)[np.searchsorted(start, np.cumsum(size + 1))]
        return np.split(flat, cut[:-1])

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text."""
        latin = [i for i, t in enumerate(texts) if t and not _ELSE.search(t)]
        out = [np.zeros(0, dtype=np.uint32)] * len(texts)
        if latin:
            for i, ids in zip(latin, self._latin([texts[i] for i in latin]), strict=True):
                out[i] = ids
        known = set(latin)
        for i, t in enumerate(texts):
            if t and i not in known:
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
        return out
