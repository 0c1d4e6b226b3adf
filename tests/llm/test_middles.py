import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from thermaweave.llm import middles

from .helpers import AWKWARD, clashing, docs, words

SF = "/root/testdata/sf0.001"
ROWS = AWKWARD + [(20 + k, words(3 + 7 * k, seed=k)) for k in range(40)] + [(70, "has a <P> inside"), (71, "<S"), (72, "P><S><"), (73, "<" * 9), (74, "M>" * 9), (75, "é\U0001f600\r\n\x00x")]


def brute(i, text):
    text = text or ""
    n, d = len(text), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:z], text[z:]
    return (n, "spm", a, z - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, z - a, f"<P>{p}<S>{s}<M>{m}")


def test_brute_force(spark):
    found = middles.fill_in_middle(clashing(docs(spark, ROWS))).withColumn("restored", middles.restore(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=repr)
    assert got == sorted(((i, *brute(i, t)) for i, t in ROWS), key=repr)
    assert sorted(r.restored for r in found) == sorted(t or "" for _, t in ROWS)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert middles.fill_in_middle(docs(spark, [])).count() == 0


def test_marks_that_arise_at_cuts_do_not_mislead(spark):
    rows = [(k, t) for k, t in enumerate(["<S<P<M>>", "S>P>M>", "<<<SSS>>>", "<S" * 5, "P>" * 5] * 40)]
    found = middles.fill_in_middle(docs(spark, rows)).withColumn("restored", middles.restore(F.col("output"), F.col("form"))).collect()
    assert all(r.restored == rows[r.doc_id][1] for r in found) and {r.form for r in found} == {"plain", "psm", "spm"}


def test_other_units(spark):
    line = r"[^\n]*\n|[^\n]+"
    rows = [(k, f"a{k}\nb\n\nlast {k}") for k in range(50)] + [(99, "one")]
    found = middles.fill_in_middle(docs(spark, rows), unit=line, changed=100).withColumn("restored", middles.restore(F.col("output"), F.col("form"))).collect()
    assert all(r.restored == dict(rows)[r.doc_id] and r.n == (4 if r.doc_id != 99 else 1) for r in found)
    assert all(r.prefix_units <= r.n and dict(rows)[r.doc_id][: r.prefix_chars].count("\n") in (r.prefix_units, r.prefix_units - 1) for r in found)
    odd = middles.fill_in_middle(docs(spark, [(1, "ab-c")]), unit="[a-z]").first()
    assert (odd.n, odd.form, odd.output) == (None, "plain", "ab-c")


def test_long_texts_take_several_matches():
    for unit in (middles.POINT, r"\w+|\W", r"[^\n]*\n|[^\n]+"):
        text = "ab c\nde\n" * 37 + "f"
        assert middles.unit_ends(text, unit, 7) == middles.unit_ends(text, unit) and middles.unit_ends(text, unit)[-1] == len(text)
    assert middles.unit_ends("", middles.POINT) == [] and middles.unit_ends("a-b" * 9, "[a-z]", 4) is None
    assert len(middles.unit_ends("é" * (middles.LONGEST + 3))) == middles.LONGEST + 3


def test_bad_parameters():
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "", "x"), ("<a<", "<b", "c"), ("ab", "abc", "d"), ("xa", "ab", "d")):
        with pytest.raises(ValueError):
            middles.checked(marks)
    with pytest.raises(ValueError):
        middles.unit_ends("a", "b*")


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    theirs = con.sql(middles.ORACLE)
    ours = middles.op11(spark, SF)
    assert ours.columns == theirs.columns
    assert sorted(map(tuple, ours.collect()), key=repr) == sorted(theirs.fetchall(), key=repr) != []
