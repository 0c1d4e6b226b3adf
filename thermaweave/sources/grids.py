"""Reading grids, merging sources, storing and reusing stage results."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import cache, reduce
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import __version__
from ..config import CELL
from ..functions.columns import kelvin_to_celsius, missing_to_null
from ..session import Files

#: Names that sources use and the library's names for them.
COMMON_NAMES = {"sst": "v", "SST": "v", "tg": "v", "T2m": "v", "latitude": "lat", "longitude": "lon"}


def normalised(df: DataFrame, names: Mapping[str, str] = COMMON_NAMES, drop: Sequence[str] = ("zlev",), note: str | None = None) -> DataFrame:
    """Library names, day stamps, nulls for NaN; the note becomes metadata of v."""
    df = df.drop(*drop).withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    if "time" in df.columns:
        df = df.withColumn("time", F.to_date("time"))
    if "v" in df.columns:
        df = df.withColumn("v", missing_to_null(F.col("v").cast("double")))
        df = df.withMetadata("v", {"note": note}) if note else df
    return df


def load_grid(spark: SparkSession, path: str, fallback: str | None = None, schema: StructType | None = None, fmt: str = "parquet", **names: str) -> DataFrame:
    """The merged table, or else the raw files of the fallback pattern; neither: an error."""
    reader = spark.read.format(fmt)
    reader = reader.schema(schema) if schema else reader
    for place in filter(None, (path, fallback)):
        try:
            return normalised(reader.load(place), COMMON_NAMES | names)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"neither {path} nor {fallback} can be read")


def merge_sources(sources: Sequence[DataFrame], start: str, end: str, names: Mapping[str, str] = COMMON_NAMES) -> DataFrame:
    """Sources of differing names as one table of the days start ... end."""
    if not sources:
        raise FileNotFoundError("no source to merge")
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [normalised(s, names) for s in sources])
    return merged.where(F.col("time").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def nearest_level(df: DataFrame, level: str = "lev", at: float = 0.0, keys: Sequence[str] = (*CELL, "time")) -> DataFrame:
    """For each cell and time the row of the level nearest to `at` (of equals the smaller one)."""
    near = Window.partitionBy(*keys).orderBy(F.abs(F.col(level) - F.lit(at)), level)
    return df.withColumn("_n", F.row_number().over(near)).where("_n = 1").drop("_n", level)


def load_member(df: DataFrame, forcing: str, member: str, temperature: str = "TREFHT", sea: str = "TEMP", keys: Sequence[str] = (*CELL, "time")) -> DataFrame:
    """One ensemble member in Celsius with its keys; a sea field with levels is cut to the surface."""
    out = nearest_level(df, keys=keys) if "lev" in df.columns else df
    for old, new in ((temperature, "T2m"), (sea, "SST")):
        if old in out.columns:
            out = out.withColumn(new, kelvin_to_celsius(F.col(old))).drop(old)
    return out.withColumns({"forcing": F.lit(forcing), "member": F.lit(member)})


def load_ensemble(spark: SparkSession, pattern: str, forcing: str, regex: str = r"(\d{3})\.\w+$", members: Sequence[str] | None = None) -> DataFrame:
    """All members of a forcing, or those named; the member is cut from the file's name."""
    df = spark.read.parquet(pattern)
    found = load_member(df, forcing, "").withColumn("member", F.regexp_extract(F.col("_metadata.file_path"), regex, 1))
    return found.where(F.col("member").isin(*members)) if members else found


def select_variable(df: DataFrame, long_name: str, short_name: str, keys: Sequence[str] = ("time", *CELL)) -> DataFrame:
    return df.select(*keys, F.col(long_name).cast("double").alias(short_name))


def scaled(df: DataFrame, column: str, factor: float) -> DataFrame:
    return df.withColumn(column, F.col(column) * F.lit(factor))


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


@cache
def code_version() -> str:
    """A digest of this library's own source, but for the operators of training data, which no stage uses."""
    root = Path(__file__).resolve().parent.parent
    h = hashlib.sha256(__version__.encode())
    for p in sorted(root.rglob("*.py")):
        if p.relative_to(root).parts[0] != "llm":
            h.update(p.read_bytes())
    return h.hexdigest()


def fingerprint(spark: SparkSession, inputs: Sequence[DataFrame | str] = (), **settings) -> str:
    """What a stage's result depends on, as a line of JSON: code, settings and inputs.

    An input is a table or the fingerprint of another stage. Of a table it holds the plan, without Spark's running
    numbers, and names, sizes and times of change of all files that it reads; of rows that come from memory there is
    nothing to hold, so that a table with such rows is never taken for one seen before.
    """
    held = []
    for x in inputs:
        if isinstance(x, str):
            held.append(hashlib.sha256(x.encode()).hexdigest())
            continue
        plan = x._jdf.queryExecution().analyzed()
        leaves = plan.collectLeaves()
        files, h = [], hashlib.sha256(re.sub(r"#\d+L?|plan_id=\d+", "", plan.toString()).encode())
        for leaf in (leaves.apply(k) for k in range(leaves.size())):
            kind = leaf.getClass().getSimpleName()
            if kind == "LogicalRelation":
                files += list(leaf.relation().inputFiles())
            elif kind not in ("Range", "OneRowRelation"):
                h.update(uuid.uuid4().bytes)
        for path, state in sorted(Files(spark, files[0]).states(files).items()) if files else ():
            h.update(f"{path} {state}\n".encode())
        held.append(h.hexdigest())
    return json.dumps({"code": code_version(), "inputs": held, "settings": {k: repr(v) for k, v in settings.items()}}, sort_keys=True)


MANIFEST = "_manifest.json"


def materialize(spark: SparkSession, make: Callable[[], DataFrame], path: str, made_of: str | None = None) -> DataFrame:
    """The table at path if it was written to its end and from the same (made_of: a fingerprint), else what make() gives,
    written there first.

    The manifest is written last and goes with the table that it describes, so a run that breaks off leaves none. Without
    a fingerprint any finished table is taken.
    """
    files = Files(spark, path)
    same = made_of is None or files.read(MANIFEST) == made_of
    if not (same and files.exists("_SUCCESS")):
        files.delete(MANIFEST)
        make().write.mode("overwrite").parquet(path)
        if made_of is not None:
            files.write(MANIFEST, made_of)
    return spark.read.parquet(path)


DAYS = "_days.json"
#: Day in a file's name.
NAMED_DAY = r"(\d{4})-?(\d{2})-?(\d{2})"


def ingest_days(spark: SparkSession, pattern: str, path: str, named: str = NAMED_DAY, schema: StructType | None = None, fmt: str = "parquet", names: Mapping[str, str] = COMMON_NAMES, most_loads: int = 64) -> list[str]:
    """Adds the day files that match a pattern to a table partitioned by year (and load); returns those that were read.

    time comes from the file's name (its first day that `named` finds). Only files that the table's manifest lacks are
    read, as one load, whose name follows from them: a load that breaks off is written over by the next try. Years with
    a file that has changed or gone, or with as many loads as most_loads, are read again from all their files. Readers
    go by the manifest, which is written last. No file at all is an error, and so is a name without a day.
    """
    files = Files(spark, path)
    there = files.matching(pattern)
    held: dict[str, list] = json.loads(files.read(DAYS) or "{}")
    if not there and not held:
        raise FileNotFoundError(f"no file matches {pattern}")
    found = {p: re.search(named, p.rsplit("/", 1)[-1]) for p in {**there, **held}}
    if bad := sorted(p for p, m in found.items() if not m):
        raise ValueError(f"{len(bad)} names without a day, such as {bad[0]}")
    year = {p: int(m[1]) for p, m in found.items()}
    again = {year[p] for p, (*state, _) in held.items() if there.get(p) != state}
    loads: dict[int, set[str]] = {}
    for p, (*_, load) in held.items():
        loads.setdefault(year[p], set()).add(load)
    again |= {y for y, used in loads.items() if len(used) >= most_loads and any(p not in held and year[p] == y for p in there)}
    wanted = sorted(p for p in there if p not in held or year[p] in again)
    kept = {p: v for p, v in held.items() if year[p] not in again}
    if wanted:
        load = hashlib.sha256(repr([(p, there[p]) for p in wanted]).encode()).hexdigest()[:12]
        reader = spark.read.format(fmt)
        raw = (reader.schema(schema) if schema else reader).load(wanted)
        part = lambda k: F.regexp_extract("_file", named, k).cast("int")
        rows = normalised(raw.select("*", F.col("_metadata.file_name").alias("_file")), names).withColumn("time", F.make_date(part(1), part(2), part(3))).drop("_file")
        rows = rows.withColumns({"year": F.year("time"), "load": F.lit(load)}).hint("rebalance", "year")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "load").parquet(path)
        kept |= {p: [*there[p], load] for p in wanted}
    for y in again:
        for old in loads.get(y, set()) - {v[2] for p, v in kept.items() if year[p] == y}:
            files.delete(f"year={y}/load={old}")
    if wanted or again:
        files.write(DAYS, json.dumps(kept, sort_keys=True))
    return wanted


def read_days(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The table of ingest_days(), days start ... end; other years' folders are not opened."""
    held = json.loads(Files(spark, path).read(DAYS) or "{}")
    out = spark.read.parquet(path).where(F.col("load").isin(sorted({v[2] for v in held.values()})))
    for bound, test in ((start, "ge"), (end, "le")):
        if bound:
            day = F.lit(bound).cast("date")
            out = out.where((F.col("year") >= int(bound[:4])) & (F.col("time") >= day) if test == "ge" else (F.col("year") <= int(bound[:4])) & (F.col("time") <= day))
    return out.drop("load")


def set_aside(raw: DataFrame, path: str, kinds: Mapping[str, str] | None = None, needed: Sequence[str] = ("time", *CELL)) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Rows whose columns are what they should be, those that are not, with their reasons, and counts of both.

    kinds: column -> type that its text should have (time: date, cell: int, place and value: double). A text that isn't
    of its type is an error, and so is a missing one of the columns needed; a missing value is none. One pass over raw
    writes both tables (path, by the column `malformed`), the second with its texts as they came, and counts.
    """
    kinds = dict(kinds or {"time": "date", "lat_idx": "int", "lon_idx": "int", "lat": "double", "lon": "double", "v": "double"})
    given = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    reasons = [F.when(given(c).isNotNull() & given(c).try_cast(t).isNull(), f"{c} is no {t}") for c, t in kinds.items()]
    reasons += [F.when(given(c).isNull(), f"{c} is missing") for c in needed]
    rows = raw.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("malformed", F.size("reasons") > 0)
    seen = Observation()
    rows = rows.select(*[F.col(c).cast("string").alias(c) if c in kinds else F.col(c) for c in raw.columns], "reasons", "malformed")
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("malformed").alias("malformed")).write.mode("overwrite").partitionBy("malformed").parquet(path)
    stored = raw.sparkSession.read.schema(rows.schema).parquet(path)
    good = stored.where("NOT malformed").select(*[given(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in raw.columns])
    good = good.withColumns({c: missing_to_null(F.col(c)) for c, t in kinds.items() if t == "double"})
    return good, stored.where("malformed").select(*raw.columns, "reasons"), dict(seen.get)
