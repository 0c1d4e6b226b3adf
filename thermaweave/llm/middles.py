"""Fill-in-the-middle: texts cut into prefix, middle and suffix, by one match that keeps each repetition of a unit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, doc_columns, steps, table

#: A unit of one code point.
POINT = r"(?s:.)"
SENTINELS = ("<P>", "<S>", "<M>")

#: Characters that one match covers; a longer text takes several matches, as the library can't keep captures without end.
LONGEST = 1 << 20


@cache
def _patterns(unit: str, longest: int) -> tuple[regex.Pattern, regex.Pattern]:
    """(unit)* for whole texts, and up to `longest` units of a text beyond that. Units are atomic, so both cut alike."""
    if regex.fullmatch(unit, ""):
        raise ValueError(f"a unit can't be empty: {unit}")
    return regex.compile(rf"((?>{unit}))*"), regex.compile(rf"((?>{unit})){{1,{longest}}}")


def unit_ends(text: str, unit: str = POINT, longest: int = LONGEST) -> list[int] | None:
    """Where each unit ends, in code points; None if units don't cover the text."""
    whole, part = _patterns(unit, longest)
    if len(text) <= longest:
        found = whole.fullmatch(text)
        return found.ends(1) if found else None
    ends: list[int] = []
    while not ends or ends[-1] < len(text):
        found = part.match(text, ends[-1] if ends else 0)
        if not found:
            return None
        ends += found.ends(1)
    return ends


def drawn(seed: str = "1", doc_id: str = "doc_id") -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first groups of the SHA-256 of seed, colon and decimal id (null: none)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def checked(sentinels: Sequence[str]) -> tuple[str, str, str]:
    """Three different marks, of which none begins within another: then an output has each just once, wherever it was cut."""
    marks = tuple(sentinels)
    if len(marks) != 3 or len(set(marks)) != 3 or not all(marks):
        raise ValueError(f"three different sentinels are needed: {marks}")
    for a in marks:
        if any(b.startswith(a[k:]) or a[k:].startswith(b) for b in marks for k in range(1, len(a))) or any(a != b and a.startswith(b) for b in marks):
            raise ValueError(f"sentinels overlap: {marks}")
    return marks


_SCHEMA = "doc_id long, n long, form string, prefix_units long, middle_units long, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, unit: str = POINT, sentinels: Sequence[str] = SENTINELS, changed: int = 90, spm: int = 20, seed: str = "1") -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units, prefix_chars, middle_chars, output: a row for each row of docs.

    changed and spm are per cent: how many documents are cut at all, and how many of those have the suffix first (spm)
    in place of the prefix (psm). What is drawn depends on the seed and the document's id alone, so reruns agree and
    repeated rows come out alike. A null text is empty. Empty texts and texts that hold a sentinel or that units don't
    cover (n is null then) stay as they are: form plain, without cuts. Rows without an id share their draws. Other
    columns are not kept, whatever their names. No exchange; a batch takes as many whole texts as fit a bounded step.
    """
    first, second, third = checked(sentinels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            draws = [b.column(k) for k in range(2, 6)]
            for at, texts in steps(b):
                kinds, counts, cuts, outputs = [], [], [], []
                for k, raw in enumerate(texts):
                    text = raw.decode()
                    ends = unit_ends(text, unit)
                    h1, h2, h3, h4 = (h[at + k].as_py() for h in draws)
                    counts.append(None if ends is None else len(ends))
                    if not ends or h3 % 100 >= changed or first in text or second in text or third in text:
                        kinds.append("plain")
                        cuts.append((None,) * 4)
                        outputs.append(text)
                        continue
                    low, high = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
                    a, z = ends[low - 1] if low else 0, ends[high - 1] if high else 0
                    kind = "spm" if h4 % 100 < spm else "psm"
                    head, tail = (first, text[:a]), (second, text[z:])
                    kinds.append(kind)
                    cuts.append((low, high - low, a, z - a))
                    outputs.append("".join((*head, *tail, third, text[a:z]) if kind == "psm" else (*tail, *head, third, text[a:z])))
                sides = list(zip(*cuts, strict=True)) or [()] * 4
                yield batch({
                    "doc_id": (b.column(0).slice(at, len(texts)), pa.int64()), "n": (counts, pa.int64()), "form": (kinds, pa.string()),
                    **{name: (list(side), pa.int64()) for name, side in zip(("prefix_units", "middle_units", "prefix_chars", "middle_chars"), sides, strict=True)},
                    "output": (outputs, pa.string()),
                })

    return doc_columns(docs).select("doc_id", "text", *drawn(seed)).mapInArrow(rows, _SCHEMA)


def restore(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an output was made of."""
    first, second, third = checked(sentinels)
    at = {m: F.locate(m, output) for m in (first, second, third)}
    behind = lambda m: at[m] + F.lit(len(m))
    between = lambda m, end: F.substr(output, behind(m), end - behind(m))
    middle = F.substr(output, behind(third))
    psm = F.concat(between(first, at[second]), middle, between(second, at[third]))
    spm = F.concat(between(first, at[third]), middle, between(second, at[first]))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


ORACLE = r"""WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT doc_id, t, n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM drawn),
cut AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
part AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, z - a) AS middle, substring(t, z + 1) AS suffix FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (z - a)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM part"""


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of all documents, with digests of what they became and of what is rebuilt from that."""
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
