"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of all documents are computed in Arrow batches and stored. The trees are fitted on a bounded sample of
labelled rows (`TRAIN_ROWS`, those whose md5 of doc_id is smallest), flattened into arrays (feature, threshold, leaf
value by heap position) and traversed by numpy for all rows and trees of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, Words, batch, doc_columns, forget, spaced, steps, stored, table

#: Documented bound of the training sample.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_HESSIAN, RIDGE = 80, 4, 64, 0.15, 0.3, 1.0
CUT = 0.3
SPACED = spaced()

#: Byte classes whose shares are features; fixed values.
CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "line": (10, 13), "high": range(128, 256), "stop": b".", "comma": b",", "bang": b"!?",
    "hash": b"#*$%&", "pipe": b"|", "angle": b"<>", "bracket": b"()[]{}", "quote": b"'\"`", "slash": b"/\\_", "colon": b":;", "dash": b"-+=~^", "at": b"@",
}
_CLASS = np.zeros((256, len(CLASSES)))
for _k, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes), _k] = 1
FEATURES = [*(f"share_{k}" for k in CLASSES), "log_bytes", "log_words", "mean_word", "distinct_words", "top_word", "same_as_last", "repeated_five", "distinct_lines", "mean_line", "words_with_symbol", "capital_words"]
_SYMBOL, _CAPITAL, _SMALL = (np.isin(np.arange(256), list(x)) for x in (b"#*$%&|<>!", range(65, 91), range(97, 123)))


def _distinct(of: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct values each text has, and how often its most frequent one stands there."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, of))
    o, x = of[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (x[1:] != x[:-1])]))
    runs = np.diff(np.append(new, len(x)))
    most = np.zeros(n)
    np.maximum.at(most, o[new], runs)
    return np.bincount(o[new], minlength=n).astype(float), most


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text; nothing but the text is read. An empty text has zeros throughout."""
    w, n = Words(texts, SPACED), len(texts)
    size = np.maximum(w.sizes, 1)
    at = np.repeat(np.arange(n), w.sizes + 1)
    counts = np.zeros((n, 256))
    for a in range(0, n, 1024):  # bounds the table
        z = min(n, a + 1024)
        lo, hi = w.first[a], w.first[z]
        counts[a:z] = np.bincount((at[lo:hi] - a) * 256 + w.buf[lo:hi], minlength=(z - a) * 256).reshape(-1, 256)
    counts[:, 10] -= 1
    shares = counts @ _CLASS / size[:, None]
    of, words = np.repeat(np.arange(n), w.counts), np.maximum(w.counts, 1)
    per = lambda mask, where=of: np.bincount(where[mask], minlength=n)
    distinct, top = _distinct(of, w.hashes, n)
    same = np.zeros(len(of), dtype=bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (of[1:] == of[:-1])
    five, where = w.shingles(5)
    n_five = np.diff(where)
    distinct_five, _ = _distinct(np.repeat(np.arange(n), n_five), five, n)
    full = Words(texts, np.arange(256) != 10)
    n_lines = np.maximum(full.counts, 1)
    lines, _ = _distinct(np.repeat(np.arange(n), full.counts), full.hashes, n)
    held = lambda table: (c := np.concatenate([[0], np.cumsum(table[w.buf])]))[w.ends] - c[w.starts]
    long_enough = (w.ends - w.starts) >= 2
    capital = (held(_CAPITAL) >= 2) & (held(_SMALL) == 0) & long_enough
    cols = [np.log1p(w.sizes), np.log1p(w.counts), np.bincount(of, w.ends - w.starts, minlength=n) / words, distinct / words, top / words, per(same) / words, 1 - distinct_five / np.maximum(n_five, 1), lines / n_lines, np.log1p(w.sizes / n_lines), per(held(_SYMBOL) > 0) / words, per(capital) / words]
    out = np.column_stack([shares, *cols])
    out[w.sizes == 0] = 0
    return out


def features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in steps(b, most=STEP_BYTES):
                x = statistics(texts).astype(np.float32)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], type=pa.int32()), pa.array(x.ravel()))
                yield batch({"doc_id": (b.column(0).slice(first, len(texts)), pa.int64()), "x": (values, pa.list_(pa.float32()))})

    return docs.mapInArrow(run, "doc_id long, x array<float>")


class Trees:
    """Complete binary trees in heap order: node i has children 2 * i + 1 (x <= threshold) and 2 * i + 2."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.feature):
            inner = self.feature.shape[1]
            tree = np.arange(len(self.feature))[None, :]
            for a in range(0, len(x), 4096):
                part = x[a : a + 4096]
                row, node = np.arange(len(part))[:, None], np.zeros((len(part), tree.shape[1]), dtype=np.int64)
                while node[0, 0] < inner:
                    node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.threshold[tree, node])
                total[a : a + 4096] += self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss; without rows of both labels the score is the smoothed share of label 1."""
    inner, none = (1 << DEPTH) - 1, np.zeros((0, 1))
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return Trees(base, none, none, none)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)])
    width = BINS
    flat = binned + np.arange(x.shape[1]) * width
    feature, threshold, leaf, raw = [], [], [], np.full(len(y), base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        f, t, node = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            start, n = (1 << level) - 1, 1 << level
            at = ((node - start)[:, None] * (width * x.shape[1]) + flat).ravel()
            sums = [np.bincount(at, np.repeat(v, x.shape[1]), minlength=n * width * x.shape[1]).reshape(n, x.shape[1], width).cumsum(axis=2) for v in (g, h)]
            gl, hl = (s[:, :, :-1] for s in sums)
            gt, ht = (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hl < LEAST_HESSIAN) | (ht - hl < LEAST_HESSIAN)] = 0
            best = gain.reshape(n, -1).argmax(axis=1)
            for i in range(n):
                k, cut = divmod(int(best[i]), width - 1)
                if gain[i, k, cut] > 1e-6 and cut < len(edges[k]):
                    f[start + i], t[start + i] = k, edges[k][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
        place = node - inner
        value = -RATE * np.bincount(place, g, minlength=inner + 1) / (np.bincount(place, h, minlength=inner + 1) + RIDGE)
        raw += value[place]
        feature.append(f), threshold.append(t), leaf.append(value)
    return Trees(base, np.array(feature), np.array(threshold), np.array(leaf))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def chosen(labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, quality of labelled rows outside the held-out fold, a few per cent above `most` at most.

    Of more labelled rows, those whose hash lies below a bound.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    share = min(1.0, (1.05 * most + 500) / max(1, rows.count()))
    key = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
    return rows.where(key <= int(share * 2**32))


def train(values: DataFrame, rows: DataFrame, most: int = TRAIN_ROWS) -> Trees:
    """Fit on rows (doc_id, quality) and their values (doc_id, x); at most `most` rows come to the driver."""
    sample = values.join(rows, "doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "quality").limit(most).select("x", "quality").toArrow()
    x = sample.column("x").combine_chunks().flatten().to_numpy().reshape(len(sample), len(FEATURES)).astype(np.float64)
    return fit(x, sample.column("quality").to_numpy().astype(np.float64))


def score(values: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, x -> doc_id, score; the model is a few kB and travels with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES)).astype(np.float64)
            yield batch({"doc_id": (b.column(0), pa.int64()), "score": (trees.score(x), pa.float64())})

    return values.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Labels come only from rows outside the held-out fold (crc32 of the id as text, modulo 5, isn't 0); null labels are
    skipped. Null and empty texts are scored as texts without any words; whole texts of any length count. Repeated rows
    get equal scores; other columns are not read. Without labels every score is 0.5; an empty table gives no rows.
    """
    values = stored(features(docs), "quality-features")
    scored = score(values, train(values, chosen(labels)))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(doc_columns(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that classify() rejects (predicted 0).

    Null and empty texts are judged as texts without words; repeated rows and equal texts fare alike; other columns,
    whatever their names, are neither read nor changed. Without labels all rows stay; an empty table stays empty.
    """
    rows = stored(chosen(table(spark, sf_dir, "labels")), "chosen-labels")
    known = doc_columns(docs).join(rows.select("doc_id").distinct(), "doc_id", "left_semi")  # statistics of these alone
    trees = train(features(known), rows)
    forget(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in steps(b):
                x = statistics(texts).astype(np.float32).astype(np.float64)  # as features() stores them
                yield b.slice(first, len(texts)).filter(pa.array(trees.score(x) >= CUT))

    return docs.mapInArrow(run, docs.schema)
