"""What the operators of this subpackage share: stored tables, text batches and word hashes."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20

#: Spark's setting by which an execution deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Columns that tell texts apart: the id and two hashes of the text, as ids may be null or repeated.
KEY = ("doc_id", "text_h0", "text_h1")

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none, as in local tests, a temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="thermaweave-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    This cuts the lineage at a table which outlives lost executors; what was shuffled for it is deleted at once, not when
    the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables of which nothing is needed any more; what followed from them has been stored itself."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            jvm = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            jvm.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(jvm, True)


def deliver(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it on their path."""
    context = spark.sparkContext
    if getattr(context, "_thermaweave_sent", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="thermaweave-")) / "thermaweave.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._thermaweave_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(batch: pa.RecordBatch, column: str = "text", most: int | None = None):
    """Yield (first row, UTF-8 texts) of consecutive rows that hold at most `most` bytes; null is empty."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.binary())
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    first, before = 0, 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(ends, before + (most or STEP_BYTES), side="right")))
        yield first, texts.slice(first, end - first).to_pylist()
        first, before = end, int(ends[end - 1])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, STEP_BYTES + 4096)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


#: A random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
LOWER = np.arange(256)
LOWER[65:91] += 32
LOWER_VALUES = BYTE_VALUES[LOWER]


class Prefix:
    """Polynomial hashes of every prefix of a buffer, so that any part's hash takes two lookups."""

    def __init__(self, buf: np.ndarray, values: np.ndarray = BYTE_VALUES):
        up, self.down = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(values[buf] * up[: len(buf)], out=self.sums[1:])

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


class Words:
    """The words of some texts: starts, ends (in buf), hashes, and the first word of each text (`at`, one more at the end)."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, values: np.ndarray = LOWER_VALUES):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        edge = np.diff(is_word[self.buf].view(np.int8), prepend=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hashes = mix(Prefix(self.buf, values).part(self.starts, self.ends))
        self.at = np.searchsorted(self.starts, self.first)
        self.counts = np.diff(self.at)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k words, and the first run of each text (one more at the end)."""
        n = np.maximum(self.counts - k + 1, 0)
        where = np.concatenate([[0], np.cumsum(n)])
        start = np.arange(where[-1]) + np.repeat(self.at[:-1] - where[:-1], n)
        h = np.zeros(len(start), dtype=np.uint64)
        for j in range(k):
            h = h * np.uint64(_BASE) + self.hashes[start + j]
        return mix(h), where


def spaced() -> np.ndarray:
    """Bytes of words that are separated by space and \\x09-\\x0D."""
    out = np.ones(256, dtype=bool)
    out[[32, *range(9, 14)]] = False
    return out


def batch(rows: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in rows.values()], names=list(rows))


def doc_columns(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has in any spelling, so that they can stand beside its columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without_nulls(df: DataFrame, columns: dict[str, Column]) -> tuple[DataFrame, list[str]]:
    """df with the given columns under fresh names, null ones as a default and a mark, so that joins by equality find them.

    Windows and aggregations by the same names then need no exchange behind such a join. Returns df and all names.
    """
    names = fresh(df, *columns, *(f"{c}_null" for c in columns))
    n = len(columns)
    out = df.withColumns(dict(zip(names[:n], columns.values(), strict=True)))
    kinds = dict(out.dtypes)
    out = out.withColumns({mark: F.col(c).isNull() for c, mark in zip(names[:n], names[n:], strict=True)})
    return out.withColumns({c: F.coalesce(F.col(c), F.lit("") if kinds[c] == "string" else F.lit(0).cast(kinds[c])) for c in names[:n]}), names


def text_hashes(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text, with different seeds; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def keyed(docs: DataFrame) -> DataFrame:
    """KEY and text."""
    return docs.select("doc_id", *[h.alias(c) for h, c in zip(text_hashes(F.col("text")), KEY[1:], strict=True)], "text")
