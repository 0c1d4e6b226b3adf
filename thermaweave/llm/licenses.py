"""License scans: an exact set-similarity (containment) join of text blocks with license templates.

Templates are few and fixed, so they travel with the tasks. Their tokens are ordered by their document frequency over
the whole corpus, rarest first. A template's blocks are all runs of RUN times as many consecutive words as it has, at
every word, so lines and their wrapping don't matter. A block can reach a containment of `threshold` in a template of k
tokens only if it holds one of the template's k - ceil(threshold * k) + 1 rarest tokens (prefix filter), if the document
has at least ceil(threshold * k) words (length filter), and if enough of the template's tokens stand within a block's
length of the rare one (positional filter). Blocks that pass are counted exactly, by a window that slides over the
template's tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, batch, doc_columns, steps, table

#: Phrases whose words, standing consecutively, give a base label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates (label, text) for the containment join.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1"),
    ("mit", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.8
#: Fixed value: words of a block to words of its template.
RUN = 2

IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"


def _tokens(text: str) -> np.ndarray:
    return Words([text.encode()], IS_WORD).hashes


def _hit(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where hashes hold one of a few wanted values."""
    small = np.zeros(1 << 16, dtype=bool)
    small[wanted & np.uint64(0xFFFF)] = True
    at = np.flatnonzero(small[hashes & np.uint64(0xFFFF)])
    return at[np.isin(hashes[at], wanted)]


def _blocks(at: np.ndarray, token: np.ndarray, doc: np.ndarray, length: int, need: int) -> tuple[dict[int, int], dict[int, int]]:
    """By document, the most distinct tokens in a block of words and the number of disjoint blocks with `need` of them.
    at, token, doc: the word, token and document of each of a template's tokens in the texts, in order. A block that
    counts takes in all words up to the template's length from its first token, so that a notice's last words don't
    count for the next one."""
    most: dict[int, int] = {}
    runs: dict[int, int] = {}
    rows = list(zip(at.tolist(), token.tolist(), doc.tolist(), strict=True))
    held, fresh, taken = ({}, 0), ({}, 0), 0  # tokens of the block that ends here, and of its part behind the last counted one
    for j, (p, t, d) in enumerate(rows):
        moved = []
        for inside, i in (held, fresh):
            while rows[i][2] != d or rows[i][0] <= p - RUN * length:
                old = rows[i][1]
                inside[old] -= 1
                if not inside[old]:
                    del inside[old]
                i += 1
            inside[t] = inside.get(t, 0) + 1
            moved.append((inside, i))
        held, fresh = moved
        if p < taken:
            fresh = ({}, j + 1)
        most[d] = max(most.get(d, 0), len(held[0]))
        if len(fresh[0]) >= need:
            runs[d] = runs.get(d, 0) + 1
            taken = rows[fresh[1]][0] + length
            fresh = ({}, j + 1)
    return most, runs


def token_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[int, int]:
    """In how many texts of the corpus each template token stands; as many rows as the templates have tokens."""
    wanted = np.unique(np.concatenate([_tokens(t) for _, t in templates]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), dtype=np.int64)
        for b in batches:
            for _, texts in steps(b):
                w = Words(texts, IS_WORD)
                at = _hit(w.hashes, wanted)
                of = np.repeat(np.arange(len(w.counts)), w.counts)
                pairs = np.unique(np.stack([of[at], np.searchsorted(wanted, w.hashes[at])]), axis=1)
                total += np.bincount(pairs[1], minlength=len(wanted))
        yield batch({"token": (wanted.view(np.int64), pa.int64()), "n": (total, pa.int64())})

    rows = docs.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


def scan(docs: DataFrame, templates=TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    Base labels come from phrases; `labels` adds those of the templates that a block contains to `threshold`; score is
    1 with a base label, else the best containment among the blocks that pass the filters (0: none); n_blocks counts the
    matches, for each template disjoint blocks from the first on. Null and empty texts have no words and no labels. Texts of any length are scanned whole;
    repeated rows get equal results, other columns aren't read, and an empty table gives an empty result.
    """
    frequency = token_frequencies(docs, templates)
    plans = []
    for label, text in templates:
        words = _tokens(text)
        tokens = np.array(sorted(set(words.view(np.int64).tolist()), key=lambda t: (frequency.get(t, 0), t)), dtype=np.int64).view(np.uint64)
        need = math.ceil(threshold * len(tokens) - 1e-9)
        order = np.argsort(tokens)
        plans.append((label, tokens[order], order, need, len(tokens) - need + 1, len(words)))
    wanted = np.unique(np.concatenate([p[1] for p in plans]))
    places = [(_tokens(p), label) for p, label in phrases.items()]

    def found(w: Words) -> tuple[list, list, list, list]:
        base: list[list[tuple[int, str]]] = [[] for _ in w.counts]
        more: list[set[str]] = [set() for _ in w.counts]
        best, blocks = [0.0] * len(w.counts), [0] * len(w.counts)
        of = np.repeat(np.arange(len(w.counts)), w.counts)
        for phrase, label in places:
            at = np.flatnonzero(w.hashes == phrase[0])
            at = at[at + len(phrase) <= len(w.hashes)]
            for k in range(1, len(phrase)):
                at = at[w.hashes[at + k] == phrase[k]]
            at = at[of[at] == of[at + len(phrase) - 1]]
            for i in at.tolist():
                base[of[i]].append((i - int(w.at[of[i]]), label))
        hits = _hit(w.hashes, wanted)
        for label, tokens, rank, need, prefix, length in plans:
            slot = np.minimum(np.searchsorted(tokens, w.hashes[hits]), len(tokens) - 1)
            mine = tokens[slot] == w.hashes[hits]
            at, token = hits[mine], rank[slot[mine]]
            rare = at[(token < prefix) & (w.counts[of[at]] >= need)]
            a = np.searchsorted(at, np.maximum(rare - RUN * length + 1, w.at[of[rare]]))
            z = np.searchsorted(at, np.minimum(rare + RUN * length, w.at[of[rare] + 1]))
            enough = z - a >= need
            if not enough.any():
                continue
            near = np.bincount(a[enough], minlength=len(at) + 1) - np.bincount(z[enough], minlength=len(at) + 1)
            near = np.flatnonzero(np.cumsum(near)[:-1])
            most, runs = _blocks(at[near], token[near], of[at[near]], length, need)
            for d, n in most.items():
                best[d] = max(best[d], n / len(tokens))
            for d, n in runs.items():
                more[d].add(label)
                blocks[d] += n
        return base, more, best, blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for first, texts in steps(b):
                w = Words(texts, IS_WORD)
                base, more, best, blocks = found(w)
                names = [{x for _, x in p} for p in base]
                yield batch({
                    "doc_id": (ids.slice(first, len(texts)), pa.int64()), "n_words": (w.counts, pa.int64()), "n_base": ([len(p) for p in base], pa.int64()),
                    "first_word": ([min(p)[0] if p else None for p in base], pa.int64()), "last_word": ([max(p)[0] if p else None for p in base], pa.int64()),
                    "base_labels": ([",".join(sorted(x)) for x in names], pa.string()), "labels": ([",".join(sorted(x | y)) for x, y in zip(names, more, strict=True)], pa.string()),
                    "score": ([1.0 if p else s for p, s in zip(base, best, strict=True)], pa.float64()), "n_blocks": (blocks, pa.int64()),
                })

    return docs.mapInArrow(run, SCHEMA)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(doc_columns(table(spark, sf_dir, "documents")))
