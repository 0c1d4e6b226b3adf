import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from thermaweave.llm import suffixes

from .helpers import AWKWARD, clashing, docs, words

SPAN = 40


def brute(rows, span=SPAN):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        mask = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                mask[i : i + span] = b"\1" * span
        runs = sum(1 for i in range(len(t)) if mask[i] and not (i and mask[i - 1]))
        out.append((doc, len(t), sum(mask), runs, hashlib.sha256(bytes(c for c, m in zip(t, mask, strict=True) if not m)).hexdigest()))
    return sorted(out, key=repr)


def passages(rows, span=SPAN, words=50):
    """(doc_id, number of passages, their bytes, remaining text)."""
    texts = [(t or "").encode() for _, t in rows]
    half, out = span // 2, []
    seen = Counter(t[i : i + half] for t in texts for i in range(len(t) - half + 1))
    for (doc, _), t in zip(rows, texts, strict=True):
        mask = bytearray(len(t))
        for i in range(len(t) - half + 1):
            if seen[t[i : i + half]] > 1:
                mask[i : i + half] = b"\1" * half
        n, gone = 0, bytearray(len(t))
        for m in re.finditer(rb"\x01+", bytes(mask)):
            whole = sum(m.start() <= w.start() and w.end() <= m.end() for w in re.finditer(rb"[^ \t-\r]+", t))
            if m.end() - m.start() >= span or whole > words:
                n += 1
                gone[m.start() : m.end()] = b"\1" * (m.end() - m.start())
        out.append((doc, n, sum(gone), bytes(c for c, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return sorted(out, key=repr)


def run(df, span=SPAN, gram=20):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(df, span, gram).collect()), key=repr)


def rows():
    r = random.Random(3)
    passages = [words(12, seed=s) for s in range(4)]
    out = []
    for k in range(60):
        parts = [words(r.randrange(1, 40), seed=100 + k), *r.sample(passages, r.randrange(0, 3)), words(r.randrange(1, 30), seed=500 + k)]
        r.shuffle(parts)
        out.append((k, "\n".join(parts)))
    out += [(200 + k, out[5][1]) for k in range(4)]  # copies
    out += [(300, "ab" * 100), (301, "abab" * 30 + "c"), (302, passages[0] + passages[0]), (303, "z" * 39), (304, "z" * 40), (305, "ü" * 45)]
    return out


def test_brute_force(spark):
    assert run(docs(spark, rows())) == brute(rows())


def test_passages_of_many_words(spark):
    shared = ["".join(chr(97 + (i * 7 + k) % 26) + " " for i in range(60)) for k in range(2)]
    mine = [(1000 + i, f"{words(20, seed=i)}\n{shared[i % 2][: 2 * n]}\n{words(20, seed=50 + i)}") for i, n in enumerate((51, 51, 50, 50, 60, 52, 9))] + rows()
    found = sorted(((r.doc_id, r.n_passages, r.n_passage_bytes, r.text) for r in suffixes.dedup(docs(spark, mine), 200, 100).collect()), key=repr)
    assert found == passages(mine, 200)
    assert {n for i, n, *_ in found if i in (1000, 1001)} == {1}
    assert run(docs(spark, mine), 200, 100) == brute(mine, 200)


def test_split_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MOST_CLASSES", 1)
    assert run(docs(spark, rows())) == brute(rows())


def test_anchor_with_very_many_classes(spark, monkeypatch):
    sorted_anchors, split_anchors, sizes, splits = suffixes.sorted_anchors, suffixes.split_anchors, [], []

    def watched(contexts):
        sizes.append(contexts.groupBy("part_hash").agg(F.countDistinct("name").alias("n")).agg(F.max("n")).first()[0] or 0)
        return sorted_anchors(contexts)

    def split(contexts):
        splits.append(contexts.select("part_hash").distinct().count())
        return split_anchors(contexts)

    monkeypatch.setattr(suffixes, "sorted_anchors", watched)
    monkeypatch.setattr(suffixes, "split_anchors", split)
    shared = words(9, seed=1)
    mine = [(k, f"{words(6, seed=k % 700)}{shared}{words(6, seed=5000 + k % 900)}") for k in range(1200)]
    assert run(docs(spark, mine)) == brute(mine)
    assert splits and max(sizes) <= suffixes.MOST_CLASSES


def test_parts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PART", 64)
    text = np.frombuffer(words(400).encode(), dtype=np.uint8)
    starts = [o + s for o, p in suffixes.parts(text, SPAN) for s in range(len(p) - SPAN + 1)]
    assert starts == list(range(len(text) - SPAN + 1))


def test_awkward_rows_and_columns(spark):
    texts = [r for r in AWKWARD if r[0] not in (4,)]
    assert run(clashing(docs(spark, texts)), 400, 200) == brute(texts, 400)
    assert run(docs(spark, AWKWARD), 3, 2) == brute(AWKWARD, 3)
    assert run(docs(spark, [])) == []


def test_stage(spark):
    source = clashing(docs(spark, [(1, words(200) + "\nQ " + words(90, seed=9)), (2, words(200) + "\nZ " + words(90, seed=8)), (3, None), (4, words(120, seed=5)), (5, words(120, seed=5))]))
    found = {r.doc_id: r for r in suffixes.stage(spark, source, "").collect()}
    assert found[1].text == "Q " + words(90, seed=9) and len(found[1].text) < 700 and found[1].n_chars == len(found[1].text)
    assert set(found) == {1, 2, 3} and list(found[1].asDict()) == source.columns


def test_stage_keeps_columns_of_its_own_names(spark):
    from pyspark.sql import functions as F

    names = [*(f"_{side}_{c}" for side in ("mine", "span", "repeated") for c in ("doc_id", "text_h0", "Text_h1")), "_repeated_spans", "span", "start", "end"]
    rows = docs(spark, [(1, "Q " + words(150, seed=8)), (2, "R " + words(150, seed=8)), (3, "z"), (None, None)])
    more = rows.withColumns({c: F.lit(c) for c in names})
    out = suffixes.stage(spark, more, "")
    assert out.columns == more.columns and out.select(*names).distinct().collect() == [tuple(names)]
    assert sorted(map(tuple, out.select(*rows.columns).collect()), key=repr) == sorted(map(tuple, suffixes.stage(spark, rows, "").collect()), key=repr) != []
    assert suffixes.stage(spark, docs(spark, []), "").count() == 0


def test_suffix_order():
    r = random.Random(1)
    buf = bytes(r.choice(b"ab") for _ in range(3000))
    start = np.array(sorted(r.sample(range(2900), 500)))
    length = np.array([r.randrange(1, 80) for _ in start])
    group = np.sort(np.array([r.randrange(7) for _ in start]))
    s = suffixes.Suffixes(np.frombuffer(buf, dtype=np.uint8), start, length, group)
    strings = [(group[i], buf[start[i] : start[i] + length[i]]) for i in s.order]
    assert strings == sorted(strings)
    for (g, a), (h, b), c in zip(strings, strings[1:], s.common, strict=False):
        want = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) if g == h else 0
        assert c == want


def test_rows_with_equal_ids_keep_their_own_spans(spark):
    shared = words(30, seed=1)
    pairs = []
    for k, i in enumerate((None, None, None, 7, 7, 8)):
        own = words(80, seed=60 + k)
        pairs += [(i, (shared + " " + own)[:300].ljust(300, "x")), (i, words(90, seed=80 + k)[:290].ljust(300, "y"))]
    assert len({len(t.encode()) for _, t in pairs}) < len(pairs)
    pairs = [(i, t.encode().decode("ascii", "ignore")[:280]) for i, t in pairs]  # all of one length
    assert {len(t.encode()) for _, t in pairs} == {280}
    pairs += [(None, pairs[1][1]), (None, None), (7, ""), (7, pairs[7][1])]
    found = run(docs(spark, pairs))
    assert found == brute(pairs)
    assert {r[2] for r in found} > {0} and sum(r[2] == 0 for r in found) > 4
