"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Frequent words of the four languages of the corpus.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "der", "die", "und", "den", "das", "ist", "le", "la", "les", "de", "des", "et", "est", "el", "los", "que", "y", "en")
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document fails if 100 * measure < low * base or 100 * measure > high * base (integers; None: no bound)."""

    name: str
    measure: str
    base: str
    low: int | None = None
    high: int | None = None
    is_base: bool = False


#: The production thresholds.
RULES = (
    Rule("too_short", "n_words", "one", low=1000, is_base=True),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=20, is_base=True),
    Rule("too_long", "n_words", "one", high=10_000_000),
    Rule("short_words", "word_chars", "n_words", low=200),
    Rule("long_words", "word_chars", "n_words", high=1500),
    Rule("symbols", "n_symbols", "n_words", high=30),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=40),
    Rule("few_stop_words", "n_stop_words", "n_hundreds", low=100),
    Rule("capitals", "n_capital_words", "n_words", high=60),
)


def measure(docs: DataFrame) -> DataFrame:
    """docs with the integer measures the rules refer to.

    Each step is a column of its own since lambda functions re-evaluate what they refer to. Repeated windows: where the
    hashes of a text's 5-word windows aren't all distinct, their (hash, position) pairs are sorted, those equal to a
    neighbour are repeated, and the words they cover are counted along their sorted positions: O(n log n) for a text of
    n words, O(n) for one without repeats.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    out = out.withColumns({"n_words": F.size("_words").cast("long"), "n_lines": F.size("_lines").cast("long"), "one": F.lit(1).cast("long")}).withColumn("n_hundreds", F.floor(F.col("n_words") / 100))
    out = out.withColumns({
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": F.col("n_lines") - F.size(F.array_distinct("_lines")),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        "n_capital_words": F.size(F.filter("_words", lambda w: w.rlike("[A-Z][A-Z]") & ~w.rlike("[a-z]"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_grams", F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + k) for k in range(WINDOW)])))
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    out = out.withColumn("_windows", F.when(repeats, F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter("_windows", lambda w, k: (F.get(F.col("_windows"), k - 1)["h"] == w["h"]) | (F.get(F.col("_windows"), k + 1)["h"] == w["h"]))
    out = out.withColumn("_again", F.sort_array(F.transform(again, lambda w: w["i"])))
    cover = F.transform("_again", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_again"), k + 1) - i, F.lit(WINDOW))))
    words = F.coalesce(F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return out.withColumn("n_repeat_words", words).drop("_words", "_lines", "_hashes", "_grams", "_windows", "_again")


def failed(rule: Rule) -> Column:
    value, base = F.lit(100) * F.col(rule.measure), F.col(rule.base)
    tests = [value < F.lit(rule.low) * base] * (rule.low is not None) + [value > F.lit(rule.high) * base] * (rule.high is not None)
    test = tests[0]
    for t in tests[1:]:
        test = test | t
    return test


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs (with doc_id and text) with all measures, base_failed, failed_rules (names, comma-joined) and kept.

    A null or empty text has no words and fails too_short. Long texts are measured whole. Repeated rows are judged
    alike; other columns of docs are not read and an empty table gives an empty result.
    """
    rows = measure(docs.select("doc_id", "text"))
    names = F.concat_ws(",", *[F.when(failed(r), F.lit(r.name)) for r in rules])
    base = F.lit(False)
    for r in rules:
        base = base | failed(r) if r.is_base else base
    return rows.withColumns({"base_failed": base, "failed_rules": names}).withColumn("kept", F.col("failed_rules") == "")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def _oracle(rules: Sequence[Rule] = RULES) -> str:
    def sql(r: Rule) -> str:
        tests = [f"100 * {r.measure} < {r.low} * {r.base}"] * (r.low is not None) + [f"100 * {r.measure} > {r.high} * {r.base}"] * (r.high is not None)
        return "(" + " OR ".join(tests) + ")"

    words = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (SELECT doc_id, i, words[i:i+4] AS w5 FROM d, unnest(range(1, len(words) - 3)) t(i)),
g AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w5) AS c FROM w) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM g, range(5) r(k) GROUP BY doc_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, len(lines)::BIGINT AS n_lines, 1 AS one, len(words) // 100 AS n_hundreds,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(words, lambda x: lower(x) IN ({words})))::BIGINT AS n_stop_words,
    len(list_filter(words, lambda x: regexp_matches(x, '^[^a-z]*[A-Z][A-Z][^a-z]*$')))::BIGINT AS n_capital_words,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN n USING (doc_id)),
f AS (SELECT *, {" OR ".join(sql(r) for r in rules if r.is_base)} AS base_failed,
    concat_ws(',', {", ".join(f"CASE WHEN {sql(r)} THEN '{r.name}' END" for r in rules)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules = '' AS kept, failed_rules FROM f
"""


ORACLE = _oracle()
