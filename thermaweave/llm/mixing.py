"""Mixing sources to target weights along a curriculum whose weights change over time (DataFrame functions only).

Every source has a weight and a linear schedule: at training time t in [0, 1] it is drawn in proportion to
weight * (1 - tilt + 2 * tilt * t). Its integral, weight * ((1 - tilt) * t + tilt * t**2), is the source's cumulative
demand for tokens; inverting it gives the time at which the c-th token of a source is due, and that time is a
document's training position. Range-sorting by position gives the training order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, fresh, stored, table, text_hashes, without_nulls

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the production mix.
WEIGHTS, TOTAL_SHARE, MOST_REPEATS = (5.0, 2.0, 1.0), 1.5, 2
#: Each source in turn is drawn more and more, evenly, or less and less.
TILTS = (0.5, 0.0, -0.5)
#: Each source's documents are summed in buckets before running totals are taken: so many (a power of two) at least,
#: and as many as keep a bucket of a source with all rows near BUCKET_ROWS.
BUCKETS, BUCKET_ROWS = 1024, 1 << 15


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size) -> source, source_size, weight, target.

    Sources by code point, null last, take the weights in turn. `share` of all sizes is dealt by weight; a target
    stops at `most` times its source's size and the excess is dealt again by weight until none is above. That fixed
    point has a closed form: sort sources by most * size / weight; those below the water level are full, the others
    get level * weight. One row a source, so the windows below see a few rows.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % n + 1).cast("int")))
    ranked = ranked.withColumn("full", F.lit(float(most)) * F.col("source_size")).withColumn("turn", F.col("full") / F.col("weight"))
    rising = Window.orderBy("turn", "rank")
    before, every = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    full_before = F.coalesce(F.sum("full").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", (total - full_before) / weight_left)
    water = F.first(F.when(F.col("level") < F.col("turn"), F.col("level")), ignorenulls=True).over(every)
    # least() skips nulls: with no level below its turn, every source is full.
    return levels.withColumn("water", water).select("source", "source_size", "weight", "rank", F.least(F.col("full"), F.col("water") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_REPEATS, tilts: Sequence[float] = TILTS) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken, first_position, last_position.

    Within a source, documents come in the order of a hash of doc_id (of the text, where it is null). Whole documents are repeated: with
    target = q * source_size + rest every document is taken q times, and once more where the running size in hash
    order stays nearest to `rest` (its middle lies below it). So the words taken differ from the target by at most
    half a document. A document has no copy beyond `most`. Positions are the times (0 to 1) at which the schedule
    asks for the middle of its first and last copy; null where it isn't taken.

    Null texts and texts without words have size 0, take nothing and have no position. A null source is a source of
    its own. Repeated rows are documents of their own (equal rows share a place in the order). An empty table gives
    an empty result.

    Running totals are taken in two steps (sums by hash bucket, then within a bucket), so that a source with a third
    of all rows is spread over many tasks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text")).alias("_key"))
    return place(stored(rows, "mix-sizes"), weights, share, most, tilts)


def order_key(doc_id: Column, text: Column) -> Column:
    """60 bits of md5 of the id, or of the text of a row without one: an order that has nothing to do with the table's."""
    name = F.coalesce(doc_id.cast("long").cast("string"), text.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def place(rows: DataFrame, weights, share, most, tilts) -> DataFrame:
    """What mix_sources does once sizes and keys are known.

    rows: a stored table of doc_id, source, size, _key; other columns are kept."""
    return copies_of(running(rows.withColumn("_words", F.col("size")), weights, share, most, tilts), most)


def running(rows: DataFrame, weights, share, most, tilts) -> DataFrame:
    """rows (doc_id, source, size, _key, and _words of all that the row stands for) with source_size, target, tilt, and
    _before, the words of its source that come before it."""
    buckets = max(BUCKETS, 1 << (rows.count() // BUCKET_ROWS).bit_length())
    rows = rows.withColumn("_bucket", F.floor(F.col("_key") / F.lit((1 << 60) // buckets)).cast("int"))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("_words").alias("_sum"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, most)
    along = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "_bucket", F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_start"))
    tilt = F.element_at(F.array(*[F.lit(float(t)) for t in tilts]), (F.col("rank") % len(tilts) + 1).cast("int"))
    starts = starts.alias("a").join(targets.withColumn("tilt", tilt).alias("b"), F.expr("a.source <=> b.source")).select("a.source", "_bucket", "_start", "source_size", "target", "tilt")
    inside = Window.partitionBy("r.source", "r._bucket").orderBy("r._key", "r.doc_id", "r.size").rowsBetween(Window.unboundedPreceding, -1)
    return rows.alias("r").join(starts.alias("s"), F.expr("r.source <=> s.source AND r._bucket = s._bucket")).select("r.*", "_start", "source_size", "target", "tilt", (F.col("_start") + F.coalesce(F.sum("r._words").over(inside), F.lit(0))).alias("_before"))


def copies_of(placed: DataFrame, most: int) -> DataFrame:
    """placed (size, source_size, target, tilt, _before) with copies, taken, first_position, last_position."""
    size, source_size, target, tilt, before = (F.col(c) for c in ("size", "source_size", "target", "tilt", "_before"))
    placed = placed.withColumn("copies", copies(size, source_size, target, before, most)).withColumn("taken", size * F.col("copies"))
    positions = dict(zip(("first_position", "last_position"), due(size, source_size, target, tilt, before, F.col("copies")), strict=True))
    return placed.withColumns({c: F.when(F.col("copies") > 0, p) for c, p in positions.items()})


def copies(size: Column, source_size: Column, target: Column, before: Column, most: int) -> Column:
    """How often a document is taken; its middle decides on one time more."""
    each = F.when(source_size > 0, F.floor(target / source_size)).otherwise(F.lit(0)).cast("long")
    more = ((before + size / 2) < target - each * source_size).cast("long")
    return F.when(size > 0, F.least(each + more, F.lit(most))).otherwise(F.lit(0)).cast("int")


def due(size: Column, source_size: Column, target: Column, tilt: Column, before: Column, n: Column) -> list[Column]:
    """Positions of the first and the n-th copy: the c-th of `target` tokens is due when (1 - tilt) * t + tilt * t**2 = c / target."""

    def at(c: Column) -> Column:
        y = F.least(F.greatest(c / target, F.lit(0.0)), F.lit(1.0))
        root = F.sqrt(F.greatest((1 - tilt) * (1 - tilt) + 4 * tilt * y, F.lit(0.0)))
        return F.when(tilt == 0, y).otherwise((root - (1 - tilt)) / (2 * tilt))

    middle = before + size / 2
    return [at(middle), at(middle + (n - 1) * source_size)]


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy with its position, range-sorted by position."""
    step = (F.col("last_position") - F.col("first_position")) / F.greatest(F.col("copies") - 1, F.lit(1))
    rows = mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("position", F.col("first_position") + F.col("_copy") * step)
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    places = [F.round(c, 6).alias(c) for c in ("first_position", "last_position")]
    kept = mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", *places)
    return kept.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][(rank % 3 + 1)::INT]::DOUBLE AS weight, [0.5, 0.0, -0.5][(rank % 3 + 1)::INT]::DOUBLE AS tilt,
         2.0::DOUBLE * source_size AS "full" FROM r),
t AS (SELECT *, "full" / weight AS turn FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum("full") OVER (ORDER BY turn, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY turn, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM t),
g AS (SELECT *, least("full", (SELECT arg_min(level, (turn, rank)) FROM l WHERE level < turn) * weight) AS target FROM l),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.tilt,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, CASE WHEN size > 0 THEN least(floor(target / source_size)::BIGINT
         + (before + size / 2.0::DOUBLE < target - floor(target / source_size)::BIGINT * source_size)::INT, 2) ELSE 0 END::INT AS copies FROM p),
y AS (SELECT *, least(greatest((before + size / 2.0::DOUBLE) / target, 0.0), 1.0) AS y1,
         least(greatest((before + size / 2.0::DOUBLE + (copies - 1) * source_size) / target, 0.0), 1.0) AS y2 FROM c)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies,
  CASE WHEN copies > 0 THEN round(CASE WHEN tilt = 0 THEN y1 ELSE (sqrt(greatest((1 - tilt) * (1 - tilt) + 4 * tilt * y1, 0.0)) - (1 - tilt)) / (2 * tilt) END, 6) END AS first_position,
  CASE WHEN copies > 0 THEN round(CASE WHEN tilt = 0 THEN y2 ELSE (sqrt(greatest((1 - tilt) * (1 - tilt) + 4 * tilt * y2, 0.0)) - (1 - tilt)) / (2 * tilt) END, 6) END AS last_position
FROM y
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: one row per copy taken, in training order.

    Places are found on ids, text hashes and sizes alone; texts join them once. Rows of equal id, text and source share
    a place in the order, within which they are numbered, so that each is a document of its own. Null texts and texts
    without words aren't taken; null sources are a source, null ids are told apart by their texts; an empty table stays
    empty. Other columns, whatever their names, stay as they are.
    """
    keys = {"_mix_id": docs["doc_id"].cast("long"), **dict(zip(("_mix_h0", "_mix_h1"), text_hashes(docs["text"]), strict=True)), "_mix_source": docs["source"].cast("string")}
    mine, here = without_nulls(docs, keys)
    sizes = mine.select(*here, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text")).alias("_key"))
    alike = sizes.groupBy(*here, "doc_id", "source", "_key").agg(F.first("size").alias("size"), F.sum("size").alias("_words"))
    rows = stored(alike, "mix-sizes")
    found = ("size", "source_size", "target", "tilt", "_before")
    names = fresh(mine, *(f"_place{c}" for c in (*found, "_nth", "_copies", "_copy", "_first", "_last", "_at")))
    at, (nth, copies_, copy, first, last, position) = dict(zip(found, names, strict=False)), names[len(found) :]
    placed = running(rows, WEIGHTS, TOTAL_SHARE, MOST_REPEATS, TILTS)
    taken = stored(copies_of(placed, MOST_REPEATS).where("copies > 0").select(*here, *[F.col(c).alias(at[c]) for c in found]), "mix-places")
    forget(rows)
    # Which of equal rows is which depends on what else they hold, not on how they come.
    rest = [F.xxhash64(F.col(c)) for c, kind in docs.dtypes if c != "text" and not any(t in kind for t in ("map<", "variant"))]
    both = mine.join(taken.hint("merge"), here).withColumn(nth, F.row_number().over(Window.partitionBy(*here).orderBy(*here, *rest)) - 1)
    size, source_size, target, tilt, before = (F.col(at[c]) for c in found)
    before = before + F.col(nth) * size
    both = both.withColumn(copies_, copies(size, source_size, target, before, MOST_REPEATS)).where(F.col(copies_) > 0)
    each = both.withColumns(dict(zip((first, last), due(size, source_size, target, tilt, before, F.col(copies_)), strict=True)))
    step = (F.col(last) - F.col(first)) / F.greatest(F.col(copies_) - 1, F.lit(1))
    each = each.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copies_) - 1))).withColumn(position, F.col(first) + F.col(copy) * step)
    order = (position, *here[:2])
    return each.select(*docs.columns, *order).repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
