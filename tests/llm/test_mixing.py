import re

from pyspark.sql import functions as F

from thermaweave.llm import mixing

from .helpers import AWKWARD, clashing, docs, words


def water(sizes, weights, share=1.5, most=2):
    """The excess over a source's bound is dealt again by weight until none is above."""
    targets, open_, rest = {}, dict(weights), share * sum(sizes.values())
    while open_:
        total = sum(open_.values())
        full = [s for s in open_ if rest * open_[s] / total > most * sizes[s] + 1e-9]
        if not full:
            return targets | {s: rest * w / total for s, w in open_.items()}
        for s in full:
            targets[s] = most * sizes[s]
        rest -= sum(targets[s] for s in full)
        for s in full:
            del open_[s]
    return targets


def test_targets_and_taken(spark):
    rows = [(i, words(5 + i * 7 % 90, seed=i), s) for i, s in enumerate(["a"] * 60 + ["b"] * 200 + ["c"] * 30 + [None] * 20 + ["é"] * 9)]
    found = mixing.mix_sources(docs(spark, rows)).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    order = ["a", "b", "c", "é", None]
    sizes = {s: sum(size[i] for i, _, x in rows if x == s) for s in order}
    want = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    for s in order:
        own = [r for r in found if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and r.size == size[r.doc_id] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own)
    assert all(r.taken <= 2 * r.size and (r.first_position is None or 0 <= r.first_position <= r.last_position <= 1) for r in found)
    again = mixing.mix_sources(docs(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(found, key=lambda r: r.doc_id) == sorted(again, key=lambda r: r.doc_id)


def test_positions_follow_the_schedule(spark):
    mixed = mixing.mix_sources(docs(spark, [(i, words(20, seed=i), "a") for i in range(400)]), tilts=(0.8,))
    copies = mixing.training_order(mixed).collect()
    # Half the time asks for 0.2 * 0.5 + 0.8 * 0.25 = 0.3 of the words.
    early = sum(r.size for r in copies if r.position < 0.5) / sum(r.size for r in copies)
    assert len(copies) == 600 and abs(early - 0.3) < 0.01


def test_awkward_rows_and_stage(spark):
    found = mixing.mix_sources(docs(spark, AWKWARD)).collect()
    assert len(found) == len(AWKWARD) and all(r.taken == 0 and r.first_position is None for r in found if r.size == 0)
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    source = clashing(docs(spark, [(i, words(10 + i, seed=i), "ab"[i % 2]) for i in range(50)])).withColumns({c: F.lit("own") for c in ("target", "copies", "_key", "_bucket", "taken", "source_size", "tilt")})
    out = mixing.stage(spark, source, "")
    assert out.drop("doc_id", "text", "source", "n_chars", "lang").distinct().collect() == source.drop("doc_id", "text", "source", "n_chars", "lang").distinct().collect()
    taken = {r.doc_id: r.copies for r in mixing.mix_sources(source).collect()}
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert out.columns == source.columns and counts == {k: v for k, v in taken.items() if v}


def test_clashing_columns_are_not_read(spark):
    rows = docs(spark, [(1, "a b c", "s"), (2, "d e", "t")])
    assert mixing.mix_sources(clashing(rows)).select("doc_id", "taken").orderBy("doc_id").collect() == mixing.mix_sources(rows).select("doc_id", "taken").orderBy("doc_id").collect()


def test_stage_on_awkward_rows(spark):
    rows = [*AWKWARD, (None, words(30, seed=1), None), (None, words(40, seed=2), None), (9, words(20, seed=3), "a"), (9, words(20, seed=3), "a"), (10, None, "a")]
    out = [(r.doc_id, r.text) for r in mixing.stage(spark, clashing(docs(spark, rows)), "").collect()]
    assert {(i, t) for i, t in out} <= {(r[0], r[1]) for r in rows if r[1] and r[1].split()}
    assert max(out.count(x) for x in out) <= 4
    assert mixing.stage(spark, docs(spark, []), "").collect() == []


def test_stage_deals_equal_rows_one_by_one(spark):
    rows = [(None, words(200, seed=1), "a")] * 30 + [(k, words(50, seed=k), "a") for k in range(10, 30)] + [(k, words(90, seed=k), "b") for k in range(40, 90)]
    target = {r.source: r.target for r in mixing.mix_sources(docs(spark, rows)).collect()}
    out = mixing.stage(spark, docs(spark, rows), "").collect()
    for s, t in target.items():
        assert abs(sum(len(r.text.split()) for r in out if r.source == s) - t) <= 200
    found = [(r.doc_id, r.text) for r in out]
    assert all(found.count(x) <= 2 * sum(y[:2] == x for y in rows) for x in set(found))


def test_stage_keeps_columns_of_its_own_names(spark):
    names = ["_mix_id", "_mix_h0", "_mix_h1", "_mix_source", "_mix_id_null", "_mix_source_null", *(f"_place{c}" for c in ("size", "source_size", "target", "tilt", "_before", "_nth", "_copies", "_copy", "_first", "_last", "_at")), "_Mix_doc_id", "_mix_copy", "_place_copies", "_words", "_bucket", "_start"]
    rows = docs(spark, [(k, words(9, seed=k), "ab"[k % 2]) for k in range(30)] + [(None, words(9, seed=1), None)])
    more = rows.withColumns({c: F.lit(c) for c in names})
    out = mixing.stage(spark, more, "")
    assert out.columns == more.columns and out.select(*names).distinct().collect() == [tuple(names)]
    assert sorted(map(tuple, out.select(*rows.columns).collect()), key=repr) == sorted(map(tuple, mixing.stage(spark, rows, "").collect()), key=repr) != []


def test_null_ids_are_spread(spark):
    mixed = mixing.mix_sources(docs(spark, [(None, words(12, seed=k), "a") for k in range(60)]))
    keys = docs(spark, [(None, words(12, seed=k), "a") for k in range(60)]).select(mixing.order_key(F.col("doc_id"), F.col("text")).alias("k"))
    assert keys.distinct().count() == 60 and mixed.count() == 60
