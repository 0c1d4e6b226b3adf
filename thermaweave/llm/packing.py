"""Best-fit packing of documents into sequences by a linear grouping scheme.

The lengths of all pieces are counted (at most `room` rows, however many documents). On these counts the plan is made:
large lengths are cut into groups of equal cardinality and rounded up to the largest of their group; for these few
sizes a linear program over configurations (sets of sizes that fit one sequence) is solved by column generation; whole
multiples of its configurations are filled with actual lengths, in order, in place of the rounded ones; what is left
over and all small lengths are placed by best fit, longest first. The plan is a table of recipes: so many sequences with
such lengths at such offsets. Spark numbers the pieces of each length and looks up their place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, doc_columns, steps, stored, table
from .tokens import encoder

ROOM, END = 2048, 0
GROUPS, SMALL = 64, 192
#: Pieces of a length are numbered in buckets: so many at least, and as many as keep each near BUCKET_ROWS.
BUCKETS, BUCKET_ROWS = 64, 1 << 16


def pieces(docs: DataFrame, tokenizer: str | None = None, room: int = ROOM) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, lot: every document's ids and the end id, longer ones cut at `room`.

    lot: the number of the piece in its task, by which equal rows are told apart.

    tokenizer: a path that the executors can read; by default that of the installed word_bpe_49k.json.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        lot = 0
        encode = encoder(tokenizer or public_tokenizers.path("word_bpe_49k.json")).encode
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, texts in steps(b, most=1 << 20):
                rows = []
                for i, x in enumerate(encode([t.decode("utf-8") for t in texts])):
                    data = np.append(x, np.uint32(END)).astype("<u4").tobytes()
                    n = len(data) // 4
                    rows += [(ids[first + i], k, s, min(room, n - s), zlib.crc32(data[4 * s : 4 * (s + room)])) for k, s in enumerate(range(0, n, room))]
                cols = list(zip(*rows, strict=True))
                yield batch({"doc_id": (cols[0], pa.int64()), "piece": (cols[1], pa.int32()), "start": (cols[2], pa.int64()), "length": (cols[3], pa.int64()), "ids_crc32": (cols[4], pa.int64()), "lot": (np.arange(lot, lot + len(rows)), pa.int64())})
                lot += len(rows)

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, lot long")


def _best_configuration(sizes: list[int], worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The set of sizes within room that is worth most (an unbounded knapsack over capacities)."""
    value = np.zeros(room + 1)
    last = np.full(room + 1, -1)
    for k, s in enumerate(sizes):
        if worth[k] <= 1e-12:
            continue
        for _ in range(room // s):
            better = value[:-s] + worth[k] > value[s:] + 1e-12
            if not better.any():
                break
            value[s:] = np.where(better, value[:-s] + worth[k], value[s:])
            last[s:] = np.where(better, k, last[s:])
    use, c = np.zeros(len(sizes)), room
    while c > 0:
        k = last[c]
        if k < 0:
            c -= 1
            continue
        use[k] += 1
        c -= sizes[k]
    return float(use @ worth), use


def configurations(sizes: list[int], demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and amounts of a solution of: least sum of amounts with columns @ amounts = demand.

    Columns are added until none is worth more than a sequence. Columns that change no amount may lead in a circle:
    where a set of columns comes back, the demands are told apart by amounts far below a piece, which leaves no ties."""
    base, asked = np.diag([float(room // s) for s in sizes]), demand
    seen: set[bytes] = set()
    while True:
        inverse = np.linalg.inv(base)
        value, column = _best_configuration(sizes, np.ones(len(sizes)) @ inverse, room)
        if value <= 1 + 1e-7:
            break
        mark = np.sort(base.T.copy().view([("", base.dtype)] * len(sizes)).ravel()).tobytes()
        if mark in seen:
            if asked is not demand:
                break  # not even these lead on: rounding errors are all that is left to gain
            asked, seen = demand * (1 + 1e-9 * np.sqrt(np.arange(1.0, len(sizes) + 1))), set()
        seen.add(mark)
        step = inverse @ column
        ratio = np.where(step > 1e-9, np.maximum(inverse @ asked, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        base[:, out] = column
    return base, np.maximum(np.linalg.inv(base) @ demand, 0)


class _Bins:
    """Equal sequences in lots: (how many, lengths), found by the room they have left."""

    def __init__(self, room: int):
        self.room, self.lots = room, [[] for _ in range(room + 1)]
        self.mask = 0  # bit r: some lot has r left

    def add(self, n: int, lengths: tuple) -> None:
        """lengths: (length, rest of the chain, sum)."""
        if n:
            left = self.room - lengths[2]
            self.lots[left].append((n, lengths))
            self.mask |= 1 << left

    def best_fit(self, length: int, n: int) -> None:
        while n:
            fits = self.mask >> length
            if not fits:
                each = self.room // length
                chain = ((), (), 0)
                for _ in range(each):
                    chain = (length, chain, chain[2] + length)
                self.add(n // each, chain)
                chain = ((), (), 0)
                for _ in range(n % each):
                    chain = (length, chain, chain[2] + length)
                self.add(int(n % each > 0), chain)
                return
            left = length + (fits & -fits).bit_length() - 1
            have, chain = self.lots[left].pop()
            if not self.lots[left]:
                self.mask &= ~(1 << left)
            take = min(n, have)
            if have > take:
                self.lots[left].append((have - take, chain))
                self.mask |= 1 << left
            self.add(take, (length, chain, chain[2] + length))
            n -= take


def plan(histogram: dict[int, int], room: int = ROOM, groups: int = GROUPS, small: int = SMALL) -> list[tuple[int, list[int]]]:
    """Recipes (how many sequences, lengths) that use every piece of the histogram once."""
    bins = _Bins(room)
    left = {k: int(v) for k, v in histogram.items() if v > 0}
    large = [k for k in sorted(left) if small < k < room]
    total = sum(left[k] for k in large)
    if total:
        # Groups of equal cardinality: each length belongs to the group of its last piece; equal lengths aren't parted.
        seen, of = 0, {}
        for k in large:
            seen += left[k]
            of[k] = (seen - 1) * groups // total
        members = [[k for k in large if of[k] == g] for g in sorted(set(of.values()))]
        sizes = [m[-1] for m in members]
        base, amounts = configurations(sizes, np.array([float(sum(left[k] for k in m)) for m in members]), room)
        for j in range(base.shape[1]):
            n = int(amounts[j] + 1e-6)
            lots = [(n, ((), (), 0))] if n else []
            for g in np.flatnonzero(base[:, j]).tolist():
                for _ in range(int(base[g, j])):
                    nxt = []
                    for have, chain in lots:
                        while have:
                            k = next((k for k in reversed(members[g]) if left[k]), None)
                            if k is None:  # rounding has used the group up
                                nxt.append((have, chain))
                                break
                            take = min(have, left[k])
                            left[k] -= take
                            have -= take
                            nxt.append((take, (k, chain, chain[2] + k)))
                    lots = nxt
            for have, chain in lots:
                if chain[2]:
                    bins.add(have, chain)
    for k in sorted(left, reverse=True):
        bins.best_fit(k, left[k])
    out = []
    for lots in bins.lots:
        for n, chain in lots:
            lengths = []
            while chain[2]:
                lengths.append(chain[0])
                chain = chain[1]
            out.append((n, lengths[::-1]))
    return out


def places(recipes: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Intervals of piece numbers by length: piece number r >= first of a length goes to sequence base + r - first."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for n, lengths in recipes:
        offset = 0
        for k in lengths:
            first = used.get(k, 0)
            rows.append((k, first, base, offset))
            used[k] = first + n
            offset += k
        base += n
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "base", "offset"), cols.T.copy(), strict=True))


def pack(found: DataFrame, room: int = ROOM) -> DataFrame:
    """Pieces with sequence_id and offset. found must be a stored table: it is read for counts and for placing.

    A piece as long as a sequence is one by itself (a negative id). For the others the plan depends on the counts of less
    than `room` lengths and has some thousand recipes, whatever the number of pieces. Pieces of a length are numbered by
    a hash bucket's start plus their number within the bucket; buckets follow the number of pieces, so a length that a
    third of all pieces has is numbered by many tasks.
    """
    out = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    alone = found.where(F.col("length") == room).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}).select(*out)
    found = found.where(F.col("length") < room)
    buckets = max(BUCKETS, -(-found.count() // BUCKET_ROWS))
    rows = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "lot"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table_ = places(plan(histogram, room))
    # One row a bucket of a length: some thousandths of the pieces at most.
    along = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "lot")
    numbered = rows.join(starts, ["length", "_bucket"]).withColumn("_number", F.col("_start") + F.row_number().over(inside) - 1)
    key = table_["length"] * (1 << 48) + table_["first"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(k).to_numpy() for k in (3, 5))
            at = np.searchsorted(key, length * (1 << 48) + number, side="right") - 1
            yield batch({n: (b.column(k), None) for k, n in enumerate(("doc_id", "piece", "start", "length", "ids_crc32"))} | {"sequence_id": (table_["base"][at] + number - table_["first"][at], pa.int64()), "offset": (table_["offset"][at], pa.int64())})

    placed = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "_number").mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return alone.unionByName(placed)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, room: int = ROOM) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text has the end id alone. Only documents longer than `room` are cut; very long ones are encoded
    whole. Repeated rows are packed as often as they stand there; null ids are kept. An empty table gives no rows.
    """
    return pack(stored(pieces(docs, tokenizer, room), "pieces"), room)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(doc_columns(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """pack_documents() of docs, whose other columns aren't read, whatever their names."""
    return pack_documents(doc_columns(docs))
