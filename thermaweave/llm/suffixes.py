"""Suffix-array dedup: removal of byte strings that stand anywhere else, by hash-compared suffix sorting.

Two lengths of strings are looked for in one pass: `span` bytes (removed) and half of that, whose runs are reported as
passages where they hold over 50 words. What follows holds for each length by itself.

A window is `span` bytes. Every window selects an anchor, the k-gram in it whose hash is smallest (leftmost of equals),
so equal windows select equal anchors at equal offsets, and consecutive windows share theirs. Anchors that stand once
need no further look. The others are classes (polynomial hash of the anchor, and a hash of another kind, xxh3, of all
bytes of the anchor's windows): members of a class with several members are repeated throughout. Where an anchor has several classes, one member of each goes to a
task with the anchor's other classes. There the suffixes that begin at the anchor are sorted by mergesort; two suffixes
are compared by binary search for their common extension over polynomial prefix hashes, and every common extension is
verified byte by byte. A window at offset o before its anchor is repeated if another one's o bytes before the anchor
are equal and their suffixes share span - o bytes, which is a range minimum over the sorted suffixes' extensions.

An anchor with too many classes for one task is split: its windows' offsets fall into a few ranges, and what the windows
of a range share is an anchor of its own, longer and with fewer offsets, that again stands once, has classes to sort or
is split, until a single offset is left, where all that share the anchor are one class.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, Prefix, batch, doc_columns, forget, fresh, keyed, mix, steps, stored, table, text_hashes

SPAN, GRAM = 400, 160
#: Runs of strings of half the span are passages if they hold more whole words than these, or a span of bytes.
PASSAGE_WORDS = 50
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Classes of an anchor that are sorted together; an anchor with more is split into longer ones.
MOST_CLASSES = 256
#: Ranges of offsets that an anchor is split into.
RANGES = 4
#: Bytes of context that a task sorts at once (whole anchors).
SORT_BYTES = 1 << 20
#: Bytes that are verified at once.
EQUAL_BYTES = 1 << 20
#: Windows around an anchor: the anchor and their class among its classes, the anchor and class that they were part of
#: before any split, classes of the anchor, length of windows, least and most offset of windows from the anchor, bytes of
#: the context before the anchor.
CONTEXT = ("part_hash", "name", "gram_hash", "class_hash", "classes", "span", "low", "high", "before", "context")
CONTEXT_SCHEMA = ", ".join(f"{k} {'binary' if k == 'context' else 'long'}" for k in CONTEXT)
#: Long texts are looked at in parts of so many windows.
PART = 1 << 19


def anchors(prefix: Prefix, size: int, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """All runs of windows that share an anchor, in the first `size` bytes behind prefix: (anchor, first start, last start
    less first, last start of all copies, copies, anchor hash, hash of all bytes of the run's windows). Equal runs that
    follow each other, as in periodic text, are one row with several copies; their windows reach from the first start to
    the last one without a gap."""
    n = size - span + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5)) + tuple(np.zeros(0, dtype=np.uint64) for _ in range(2))
    low, many = np.uint64((1 << 24) - 1), size - gram + 1
    whole = prefix.sums[gram : size + 1] - prefix.sums[:many]
    whole *= prefix.down[:many]
    whole ^= whole >> np.uint64(32)
    whole *= np.uint64(0x94D049BB133111EB)
    best = whole & ~low
    best |= np.arange(many, dtype=np.uint64)
    width, have = span - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    first = np.append(0, np.flatnonzero(best[1:n] != best[: n - 1]) + 1)
    last = np.append(first[1:], n) - 1
    a = (best[first] & low).astype(np.int64)
    grams = mix(whole[a])
    classes = mix(prefix.part(first, last + span) ^ ((last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (a - first).astype(np.uint64)))
    head = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (classes[1:] != classes[:-1])]))
    tail = np.append(head[1:], len(a)) - 1
    return a[head], first[head], (last - first)[head], last[tail], tail - head + 1, grams[head], classes[head]


def parts(text: np.ndarray, span: int = SPAN, least: int | None = None):
    """(offset, bytes): consecutive parts whose windows of span bytes, or of any length from `least`, are all windows of
    the text."""
    for at in range(0, max(1, len(text) - (least or span) + 1), PART):
        yield at, text[at : at + PART + span - 1]


def class_names(text: bytes, first: np.ndarray, width: np.ndarray, before: np.ndarray, span: int) -> np.ndarray:
    """For each run of windows a hash of all its bytes and of its anchor's place in them."""
    rows = zip(first.tolist(), (first + width + span).tolist(), before.tolist(), strict=True)
    return np.fromiter((xxhash.xxh3_64_intdigest(text[a:z], b) for a, z, b in rows), dtype=np.uint64, count=len(first)).view(np.int64)


def find_anchors(docs: DataFrame, levels: tuple[tuple[int, int], ...]) -> DataFrame:
    """KEY, span, anchor, first, width, stop, copies, gram_hash, class_hash, as anchors() has them for each (span, gram).

    Anchors of different levels have different hashes."""
    names = ("span", "anchor", "first", "width", "stop", "copies", "gram_hash", "class_hash")
    longest, shortest = max(s for s, _ in levels), min(s for s, _ in levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, texts in steps(b):
                held: list[tuple] = []
                for i, t in enumerate(texts):
                    for offset, part in parts(np.frombuffer(t, dtype=np.uint8), longest, shortest):
                        prefix = Prefix(part)
                        for span, gram in levels:
                            a, first, width, stop, copies, g, _ = anchors(prefix, min(len(part), PART + span - 1), span, gram)
                            if len(a):
                                first += offset
                                a += offset
                                c = class_names(t, first, width, a - first, span)
                                held.append((np.full(len(a), row + i), np.full(len(a), span), a, first, width, stop + offset, copies, mix(g + np.uint64(span)).view(np.int64), c))
                if held:
                    of, *cols = (np.concatenate(x) for x in zip(*held, strict=True))
                    yield batch({k: (b.column(i).take(pa.array(of)), pa.int64()) for i, k in enumerate(KEY)} | {k: (v, pa.int64()) for k, v in zip(names, cols, strict=True)})

    return keyed(docs).mapInArrow(run, ", ".join(f"{k} long" for k in (*KEY, *names)))


def equal_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> bool:
    """Whether all strings of these lengths at a and b are equal; EQUAL_BYTES of them are compared at once."""
    ends, at = np.cumsum(length), 0
    while at < len(length):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EQUAL_BYTES, side="right")))
        c = length[at:stop]
        inside = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        if (buf[np.repeat(a[at:stop], c) + inside] != buf[np.repeat(b[at:stop], c) + inside]).any():
            return False
        at = stop
    return True


class Suffixes:
    """Suffixes of a buffer, each with a length, compared by prefix hashes."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray):
        """group: suffixes of a group stand together; only those are compared."""
        self.buf, self.start, self.length, self.group, self.prefix = buf, start, length, group, Prefix(buf)
        self.order = self._sorted()
        self.common = self._common(self.order[:-1], self.order[1:])
        self.common[group[self.order[:-1]] != group[self.order[1:]]] = 0
        if not self._verified():
            raise ValueError("two different strings have equal hashes")

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of common extensions: binary search, a hash comparison a step."""
        a, b = self.start[x], self.start[y]
        low, high = np.zeros(len(x), dtype=np.int64), np.minimum(self.length[x], self.length[y])
        while (live := low < high).any():
            mid = (low + high + 1) // 2
            same = self.prefix.part(a, a + mid) == self.prefix.part(b, b + mid)
            low, high = np.where(live & same, mid, low), np.where(live & ~same, mid - 1, high)
        return low

    def _before(self, x: np.ndarray, y: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before y; equal: the answer for equal suffixes. A suffix comes before its extensions."""
        c = self._common(x, y)
        end_x, end_y = c == self.length[x], c == self.length[y]
        top = len(self.buf) - 1
        less = self.buf[np.minimum(self.start[x] + c, top)] < self.buf[np.minimum(self.start[y] + c, top)]
        return np.where(end_x & end_y, equal, np.where(end_x, True, np.where(end_y, False, less)))

    def _sorted(self) -> np.ndarray:
        """Mergesort of all groups side by side: each suffix finds its rank in the sibling run by binary search."""
        n = len(self.start)
        order = np.arange(n)
        if not n:
            return order
        head = np.flatnonzero(np.concatenate([[True], self.group[1:] != self.group[:-1]]))
        size = np.diff(np.append(head, n))
        base, length = np.repeat(head, size), np.repeat(size, size)
        place = np.arange(n) - base
        width = 1
        while width < size.max():
            at = np.flatnonzero(length > width)
            run = place[at] // width
            sibling = (run ^ 1) * width
            most = np.clip(length[at] - sibling, 0, width)
            low, high = np.zeros(len(at), dtype=np.int64), most.copy()
            mine = order[at]
            while (live := np.flatnonzero(low < high)).size:
                mid = (low[live] + high[live]) // 2
                other = order[base[at[live]] + sibling[live] + mid]
                before = self._before(other, mine[live], (run[live] & 1) == 1)
                low[live], high[live] = np.where(before, mid + 1, low[live]), np.where(before, high[live], mid)
            moved = order.copy()
            moved[base[at] + (run >> 1) * 2 * width + place[at] % width + low] = mine
            order = moved
            width *= 2
        return order

    def _verified(self) -> bool:
        """Whether all common extensions of neighbours are equal byte by byte."""
        return equal_bytes(self.buf, self.start[self.order[:-1]], self.start[self.order[1:]], self.common)


class RangeMinimum:
    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (half := 1 << (len(self.levels) - 1)) <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The least of values[a:z], a < z."""
        k = np.frexp((z - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            v = self.levels[level]
            out[at] = np.minimum(v[a[at]], v[z[at] - (1 << level)])
        return out


def repeated_windows(contexts: list[bytes], before: np.ndarray, group: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context, the largest and smallest offset o at which the window that begins o bytes before the anchor is
    repeated in its group; -1, -1 if none is. before: bytes of the context that stand before the anchor; its windows
    begin at 0 ... len - span. Contexts of a group have one span."""
    size = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
    at = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    s = Suffixes(buf, at + before, size - before, group)
    rank = np.empty(len(size), dtype=np.int64)
    rank[s.order] = np.arange(len(size))
    windows = size - span + 1
    who = np.repeat(np.arange(len(size)), windows)
    offset = before[who] - (np.arange(len(who)) - np.repeat(np.cumsum(windows) - windows, windows))
    anchor = at[who] + before[who]
    left = s.prefix.part(anchor - offset, anchor)
    key = mix(left + offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(group[who].astype(np.uint64) + np.uint64(1)))
    order = np.lexsort((rank[who], key))
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(key[a] == key[b])
    a, b = a[same], b[same]
    ok = (group[who[a]] == group[who[b]]) & (offset[a] == offset[b])
    a, b = a[ok], b[ok]
    shared = RangeMinimum(s.common)(rank[who[a]], rank[who[b]]) if len(a) else np.zeros(0)
    hit = shared >= span[who[a]] - offset[a]
    a, b = a[hit], b[hit]
    if not equal_bytes(buf, anchor[a] - offset[a], anchor[b] - offset[b], offset[a]):
        raise ValueError("two different strings have equal hashes")
    most, least = np.full(len(size), -1), np.full(len(size), 1 << 40)
    for x in (a, b):
        np.maximum.at(most, who[x], offset[x])
        np.minimum.at(least, who[x], offset[x])
    least[most < 0] = -1
    return most, least


def repeated_spans(docs: DataFrame, levels: tuple[tuple[int, int], ...]) -> DataFrame:
    """KEY, span, start, end, stored: for each level, spans whose union is what is covered by repeated windows."""
    found = stored(find_anchors(docs, levels), "anchors")
    grams = stored(found.groupBy("gram_hash").agg(F.sum("copies").alias("members")).where("members > 1").select("gram_hash"), "grams")
    again = stored(found.join(grams.hint("merge"), "gram_hash"), "repeated-anchors")  # grams stored: Spark can split plain exchanges
    forget(found, grams)
    # One member of each class: in the text with the smallest key the first place.
    member = F.min(F.struct(*KEY, "first", "anchor", "width", "span")).alias("k")
    classes = stored(again.groupBy("gram_hash", "class_hash").agg(F.sum("copies").alias("members"), member).select("gram_hash", "class_hash", "members", "k.*"), "classes")
    places = classes.join(classes.groupBy("gram_hash").agg(F.count("*").alias("classes")).where("classes > 1"), "gram_hash")
    fields = ("gram_hash", "class_hash", "classes", "span", "anchor", "first", "width")
    by_doc = places.groupBy(*KEY).agg(F.collect_list(F.struct(*fields)).alias("places"))
    same = " AND ".join(f"a.{c} <=> b.{c}" for c in KEY)
    farthest = {span: span - gram for span, gram in levels}
    joined = keyed(docs).alias("a").join(by_doc.hint("merge").alias("b"), F.expr(same)).select("a.text", "b.places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b.column(1).offsets.to_numpy()
            flat = b.column(1).values.flatten()
            wanted = np.stack([c.to_numpy() for c in flat], axis=1)
            for row, texts in steps(b):
                rows = []
                for i, t in enumerate(texts):
                    for g, c, n, span, anchor, first, width in wanted[ends[row + i] : ends[row + i + 1]].tolist():
                        context = t[first : first + width + span]
                        if len(context) == width + span and class_names(context, np.zeros(1, np.int64), np.array([width]), np.array([anchor - first]), span)[0] == c:
                            rows.append((g, c, g, c, n, span, 0, farthest[span], anchor - first, context))
                cols = list(zip(*rows, strict=True)) or [()] * len(CONTEXT)
                yield batch({k: (v, pa.binary() if k == "context" else pa.int64()) for k, v in zip(CONTEXT, cols, strict=True)})

    contexts = stored(joined.mapInArrow(cut, CONTEXT_SCHEMA), "contexts")
    few, many = [contexts.where(F.col("classes") <= MOST_CLASSES)], contexts.where(F.col("classes") > MOST_CLASSES)
    whole, held = [], []
    while not many.isEmpty():  # offsets become fewer each time, so a few times at most
        pieces = split_anchors(many)
        held.append(pieces)
        whole.append(pieces.where("members > 1").select("gram_hash", "class_hash", F.col("before").alias("most"), "least"))
        pieces = pieces.where(F.col("context").isNotNull() & (F.col("classes") > 1)).select(*CONTEXT)
        few.append(pieces.where(F.col("classes") <= MOST_CLASSES))
        many = pieces.where(F.col("classes") > MOST_CLASSES)
    ordered = stored(sorted_anchors(reduce(DataFrame.unionByName, few)), "sorted")
    partial = reduce(DataFrame.unionByName, whole, ordered).groupBy("gram_hash", "class_hash").agg(F.max("most").alias("most"), F.min("least").alias("least"))
    # Members of a class with several members are repeated throughout, others as far as their class is.
    nothing = F.lit(None).cast("long")
    whole = classes.where("members > 1").select("gram_hash", "class_hash", nothing.alias("most"), nothing.alias("least"))
    part = partial.join(classes.where("members = 1").select("gram_hash", "class_hash"), ["gram_hash", "class_hash"], "left_semi")
    found = stored(whole.unionByName(part), "repeated-classes")
    both = again.join(found.hint("merge"), ["gram_hash", "class_hash"])
    start, end = F.coalesce(F.col("anchor") - F.col("most"), "first"), F.coalesce(F.col("anchor") - F.col("least"), "stop") + F.col("span")
    spans = stored(both.select(*KEY, "span", start.alias("start"), end.alias("end")), "spans")
    forget(again, classes, contexts, found, ordered, *held)
    return spans


def sorted_anchors(contexts: DataFrame) -> DataFrame:
    """gram_hash, class_hash, most, least as repeated_windows() finds them: whole groups, each in one task."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def result():
            group = np.cumsum([0] + [held[i][0] != held[i - 1][0] for i in range(1, len(held))])
            most, least = repeated_windows([r[6] for r in held], np.array([r[5] for r in held]), group, np.array([r[4] for r in held]))
            keep = np.flatnonzero(most >= 0)
            return batch({"gram_hash": ([held[i][2] for i in keep], pa.int64()), "class_hash": ([held[i][3] for i in keep], pa.int64()), "most": (most[keep], pa.int64()), "least": (least[keep], pa.int64())})

        for b in batches:
            for r in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if held and held[-1][:2] == r[:2]:
                    continue  # repeated rows may bring a class more than once
                if size > SORT_BYTES and held[-1][0] != r[0]:
                    yield result()
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
        if held:
            yield result()

    rows = contexts.select("part_hash", "name", "gram_hash", "class_hash", "span", "before", "context")
    return rows.repartition("part_hash").sortWithinPartitions("part_hash", "name").mapInArrow(sort, "gram_hash long, class_hash long, most long, least long")


def split_anchors(contexts: DataFrame) -> DataFrame:
    """Anchors with many classes, split into the anchors that the windows of each range of offsets share.

    Returns CONTEXT, least (offset) and members of the new classes with several members, and of those whose anchor has
    several classes; context is null but for one member of each class. Keys are counted before any context moves, and both
    tables of the last join are stored, so that Spark can split its exchanges: an anchor may have any number of classes.
    """
    names = (*CONTEXT, "least")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for _, _, g, c, _, span, least, most, before, context in zip(*(col.to_pylist() for col in b.columns), strict=True):
                nearest, step = before - (len(context) - span), -(-(most - least + 1) // RANGES)
                for low in range(least, most + 1, step):
                    high = min(low + step - 1, most)
                    z, a = max(low, nearest), min(high, before)
                    if z <= a:
                        shared, own = context[before - low : before - high + span], context[before - a : before - z + span]
                        hashes = [xxhash.xxh3_64_intdigest(x, (span << 40) + (p << 20) + q) - (1 << 63) for x, p, q in ((shared, low, high), (own, z, a))]
                        rows.append((*hashes, g, c, 0, span, low, high, a, own, z))
            yield batch({k: (v, pa.binary() if k == "context" else pa.int64()) for k, v in zip(names, list(zip(*rows, strict=True)) or [()] * len(names), strict=True)})

    once = contexts.dropDuplicates(["gram_hash", "class_hash", "part_hash"]).select(*CONTEXT)
    pieces = stored(once.mapInArrow(ranges, CONTEXT_SCHEMA + ", least long"), "ranges")
    kinds = stored(pieces.groupBy("part_hash", "name").agg(F.count("*").alias("members"), F.min(F.struct("gram_hash", "class_hash")).alias("first")), "range-classes")
    counts = stored(kinds.groupBy("part_hash").agg(F.count("*").alias("classes")), "range-anchors")
    wanted = stored(kinds.join(counts.hint("merge"), "part_hash").where("members > 1 OR classes > 1"), "range-kinds")
    is_first = F.struct("gram_hash", "class_hash") == F.col("first")
    joined = pieces.drop("classes").join(wanted.hint("merge"), ["part_hash", "name"]).withColumn("context", F.when(is_first, F.col("context")))
    out = stored(joined.where("members > 1 OR context IS NOT NULL").select(*names, "members"), "range-contexts")
    forget(pieces, kinds, counts, wanted)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def with_spans(docs: DataFrame, levels: tuple[tuple[int, int], ...]) -> DataFrame:
    """docs (all columns) and, last, an array of (span, start, end) in bytes (null: none); each level's union is what its
    repeated strings cover.

    Spans go by id and two hashes of the text, so rows that share an id, or have none, keep their own.
    """
    here, there, spans = (fresh(docs, *(f"_{side}_{c}" for c in KEY)) for side in ("mine", "span", "repeated"))
    found = repeated_spans(doc_columns(docs), levels)
    by_doc = found.groupBy(*[F.col(c).alias(t) for c, t in zip(KEY, there, strict=True)]).agg(F.collect_set(F.struct("span", "start", "end")).alias(spans[0]))
    # Hashes are columns of their own before the join, so that it hashes each text once.
    mine = docs.withColumns(dict(zip(here, [docs["doc_id"].cast("long"), *text_hashes(docs["text"])], strict=True)))
    same = " AND ".join(f"{a} <=> {b}" for a, b in zip(here, there, strict=True))
    return mine.join(by_doc.hint("merge"), F.expr(same), "left").select(*docs.columns, spans[0])


def runs_of(spans: list[dict] | None, span: int) -> list[tuple[int, int]]:
    return merged([(s["start"], s["end"]) for s in spans or () if s["span"] == span])


def is_passage(text: bytes, start: int, end: int, span: int = SPAN, most: int = PASSAGE_WORDS) -> bool:
    """Whether a run has at least `span` bytes or more than `most` whole words."""
    if end - start >= span:
        return True
    at = [(m.start(), m.end()) for m in WORD.finditer(text[start:end])]
    cut = bool(at) and at[0][0] == 0 and start > 0 and WORD.match(text[start - 1 : start]) is not None
    cut += bool(at) and at[-1][1] == end - start and end < len(text) and WORD.match(text[end : end + 1]) is not None
    return len(at) - cut > most


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(z for _, z in runs)]
    return b"".join(text[a:z] for a, z in zip(ends, [*(a for a, _ in runs), len(text)], strict=True))


def dedup(docs: DataFrame, span: int = SPAN, gram: int = GRAM, words: int = PASSAGE_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes), n_passages,
    n_passage_bytes, text.

    Every byte covered by a string of `span` bytes that also starts anywhere else, in the same or another document,
    is removed; strings are judged on the input and never cross documents. Null texts are empty; texts shorter than
    `span` lose nothing; repeated rows are each other's copies. An empty table gives no rows.

    Passages are maximal runs of bytes covered by strings of half the span that start anywhere else too, if the run has
    more than `words` whole words or a span of bytes; text is what remains without them (a character that loses a byte
    goes). They hold all that is removed, and shorter passages besides.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_passages long, n_passage_bytes long, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, texts in steps(b):
                rows = []
                for t, s in zip(texts, b.column(2).slice(row, len(texts)).to_pylist(), strict=True):
                    runs, passages = runs_of(s, span), [r for r in runs_of(s, span // 2) if is_passage(t, *r, span, words)]
                    kept, rest = _kept(t, runs), _kept(t, passages)
                    rows.append((len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, len(passages), len(t) - len(rest), rest.decode("utf-8", "ignore")))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()] + [pa.int64()] * 2 + [pa.string()]
                names = [c.split()[0] for c in schema.split(", ")]
                yield batch({"doc_id": (b.column(0).slice(row, len(texts)), pa.int64())} | {k: (list(v), kind) for k, v, kind in zip(names[1:], zip(*rows, strict=True), kinds, strict=True)})

    return with_spans(doc_columns(docs), ((span, gram), (span // 2, gram // 2))).mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """docs without their passages (see dedup()); a character of which a byte goes, goes. n_chars follows.

    Documents that lose all their text go; null and empty texts stay as they are, and so do rows without passages, with
    or without an id. Equal rows lose the same. An empty table stays empty; other columns, whatever their names, stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            for row, texts in steps(b):
                part = b.slice(row, len(texts))
                spans = part.column(b.num_columns - 1).to_pylist()
                runs = [[r for r in runs_of(s, span // 2) if is_passage(t, *r, span)] for t, s in zip(texts, spans, strict=True)]
                kept = [_kept(t, r).decode("utf-8", "ignore") if r else old for t, r, old in zip(texts, runs, part.column(at).to_pylist(), strict=True)]
                part = part.select(range(b.num_columns - 1)).set_column(at, b.schema.field(at), pa.array(kept, type=pa.string()))
                if "n_chars" in part.schema.names:
                    c = part.schema.get_field_index("n_chars")
                    count = [len(k) if r else old for k, r, old in zip(kept, runs, part.column(c).to_pylist(), strict=True)]
                    part = part.set_column(c, part.schema.field(c), pa.array(count, type=part.schema.field(c).type))
                yield part.filter(pa.array([bool(k) or not r for k, r in zip(kept, runs, strict=True)], type=pa.bool_()))

    return with_spans(docs, ((span // 2, gram // 2),)).mapInArrow(run, docs.schema)
