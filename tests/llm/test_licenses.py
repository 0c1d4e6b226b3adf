import random
import re
import textwrap

from thermaweave.llm import licenses
from thermaweave.llm.common import doc_columns

from .helpers import AWKWARD, clashing, docs, words

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base = {x for _, x in places}
    more = set()
    for line in (text or "").translate(LOWER).split("\n"):
        block = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
        for label, t in licenses.TEMPLATES:
            if len(set(t.split()) & block) / len(set(t.split())) >= licenses.THRESHOLD - 1e-9:
                more.add(label)
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more))


def test_brute_force(spark):
    rows = AWKWARD + [
        (20, "Licensed under CC BY-NC 4.0."), (21, words(30) + "\nThis work is licensed under the GNU General Public License, version 3.\n" + words(20)), (22, "All rights\nreserved. all RIGHTS reserved"),
        (23, "released under the mit"), (24, "Released, under: license the MIT!"), (25, "ccby cc by cc-by xcc by"), (26, "general public"), (27, "by cc"), (28, words(12) + " released under the mit license " + words(5)),
        (29, "license mit the under"), (30, "cc"), (31, "by"), *((40 + k, t) for k, (_, t) in enumerate(licenses.TEMPLATES)),
    ]
    found = licenses.scan(doc_columns(clashing(docs(spark, rows)))).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in found), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert all(0 <= r.score <= 1 and (r.labels == "") == (r.score < licenses.THRESHOLD - 1e-9) for r in found)
    assert licenses.scan(doc_columns(docs(spark, []))).count() == 0


def blocks(text):
    """Labels and matches by every run of words."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    labels, n = set(), 0
    for label, t in licenses.TEMPLATES:
        first, tokens = 0, set(t.split())
        for end in range(1, len(w) + 1):
            start = max(first, end - licenses.RUN * len(t.split()))
            if len(tokens & set(w[start:end])) / len(tokens) >= licenses.THRESHOLD - 1e-9:
                labels.add(label)
                first, n = max(end, next(i for i in range(start, end) if w[i] in tokens) + len(t.split())), n + 1
    return labels, n


def test_blocks_follow_words_not_lines(spark):
    mit = "released under the mit license".split()
    wrapped = [(k, words(40, seed=k) + "\n" + "\r\n".join("# " + x for x in textwrap.wrap(t, 16)) + "\n" + words(25, seed=50 + k)) for k, (_, t) in enumerate(licenses.TEMPLATES)]
    lines = [(20, " ".join(words(60, seed=k) + " " + x for k, x in enumerate(mit))), (21, words(2000) + " released under the mit license " + words(2000, seed=1)), (22, "\n\n".join(mit)), (23, " a b c ".join(mit)), (24, "\n".join(" ".join(mit) for _ in range(7)))]
    r = random.Random(5)
    mixed = [(100 + k, "".join(r.choice([*mit, *licenses.TEMPLATES[7][1].split(), "x", "y"]) + r.choice(" \n") for _ in range(r.randrange(200)))) for k in range(60)]
    rows = wrapped + lines + mixed
    found = {x.doc_id: x for x in licenses.scan(doc_columns(docs(spark, rows))).collect()}
    for i, t in rows:
        labels, n = blocks(t)
        assert (set(filter(None, found[i].labels.split(","))) - set(filter(None, found[i].base_labels.split(","))), found[i].n_blocks) == (labels - set(filter(None, found[i].base_labels.split(","))), n), i
    assert all(label in found[k].labels.split(",") for k, (label, _) in enumerate(licenses.TEMPLATES))
    assert [found[k].labels for k in (20, 21, 22, 23)] == ["", "mit", "mit", ""] and found[24].n_blocks == 7
