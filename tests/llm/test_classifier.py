import zlib

import numpy as np

from thermaweave.llm import classifier
from thermaweave.llm.common import doc_columns

from .helpers import AWKWARD, clashing, docs, words


def corpus(n=500):
    good = [(i, words(40 + i % 30, seed=i)) for i in range(n)]
    bad = [(n + i, "### ".join(words(30, seed=n + i).split()) + " %%%") for i in range(n // 3)]
    return good + bad, {i: 1 for i, _ in good} | {i: 0 for i, _ in bad}


def test_held_out_accuracy(spark):
    rows, truth = corpus()
    labels = spark.createDataFrame([(i, q, 0) for i, q in truth.items() if i % 2] + [(3, None, 0)], "doc_id long, quality int, toxic int")
    found = classifier.classify(doc_columns(clashing(docs(spark, rows))), labels).collect()
    assert len(found) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_without_labels_and_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = classifier.classify(doc_columns(docs(spark, AWKWARD)), none).collect()
    assert len(found) == len(AWKWARD) and {r.score for r in found} == {0.5}
    assert classifier.classify(doc_columns(docs(spark, [])), none).count() == 0


def test_statistics_read_the_text_alone():
    one, two = classifier.statistics([b"", b"A B c\nc"]), classifier.statistics([b"A B c\nc"])
    assert (one[0] == 0).all() and np.allclose(one[1], two[0])


def test_trees_fit_and_flatten():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = classifier.fit(x, y)
    assert np.mean((trees.score(x) > 0.5) == y) > 0.95


def test_stage(spark, tmp_path):
    rows, truth = corpus(200)
    spark.createDataFrame([(i, q, 0) for i, q in truth.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    source = clashing(docs(spark, rows))
    found = classifier.stage(spark, source, str(tmp_path))
    kept = {r.doc_id for r in found.collect()}
    assert found.columns == source.columns and kept == {i for i, q in truth.items() if q}


def test_stage_decides_as_the_query(spark, tmp_path):
    from .helpers import AWKWARD, clashing

    rows = [*AWKWARD, *((100 + k, "Plain words stand here, and more of them follow. " * 4 if k % 2 else "#### $$$ click | click <<< " * 9) for k in range(60))]
    labels = spark.createDataFrame([(100 + k, k % 2) for k in range(60)] + [(None, 1), (101, None)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    source = clashing(docs(spark, rows))
    want = sorted(str(r.doc_id) for r in classifier.classify(source.select("doc_id", "text"), labels).collect() if r.predicted)
    out = classifier.stage(spark, source, str(tmp_path))
    assert sorted(str(r.doc_id) for r in out.collect()) == want and out.columns == source.columns and 30 <= len(want) < 68
    assert classifier.stage(spark, docs(spark, []), str(tmp_path)).collect() == []
