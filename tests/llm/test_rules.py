import re
from collections import Counter

from thermaweave.llm import rules

from .helpers import AWKWARD, clashing, docs, words


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_brute_force(spark):
    rows = AWKWARD + [(10, words(80) + " " + words(30)), (11, "a b c d e " * 3), (12, "x\nx\n x\nx"), (13, words(300, kinds=3)), (14, words(50) + " ### |||")]
    found = rules.apply_rules(clashing(docs(spark, rows))).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert all(not (r.base_failed and r.kept) and r.kept == (r.failed_rules == "") for r in found)
    assert rules.apply_rules(docs(spark, [])).count() == 0


def test_plan_has_no_python(spark):
    plan = rules.apply_rules(docs(spark, AWKWARD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
