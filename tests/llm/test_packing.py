import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from thermaweave.llm import packing
from thermaweave.llm.tokens import Encoder

from .helpers import AWKWARD, clashing, docs, words

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pair():
    return Tokenizer.from_file(PATH), Encoder(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x250), st.sampled_from("aB 'sé!12\n_ſİΣ漢")), max_size=40), max_size=6))
def test_ids_are_the_tokenizers(pair, texts):
    tokenizer, encoder = pair
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [x.tolist() for x in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_words(pair, monkeypatch):
    monkeypatch.setattr("thermaweave.llm.tokens.MOST_IDS", 10)
    tokenizer, encoder = pair
    for k in range(4):
        t = words(50, seed=k)
        assert encoder.encode([t, t])[1].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_pack(spark, pair):
    rows = AWKWARD + [(50 + k, words(1 + k * 13 % 700, seed=k)) for k in range(150)]
    found = packing.pack_documents(clashing(docs(spark, rows)).select("doc_id", "text")).collect()
    want = []
    for i, t in rows:
        ids = np.array(pair[0].encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found], key=repr) == sorted(want, key=repr)
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) <= 1.1 * sum(r.length for r in found) / 2048 + 2
    assert packing.pack_documents(docs(spark, []).select("doc_id", "text")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 300), max_size=30))
def test_plan_uses_every_piece_once(histogram):
    used = {}
    for n, lengths in packing.plan(histogram, room=100, groups=8, small=10):
        assert n > 0 and sum(lengths) <= 100
        for k in lengths:
            used[k] = used.get(k, 0) + n
    assert used == histogram


def test_plan_is_close_to_the_bound():
    r = np.random.default_rng(0)
    for scale in (300, 900):
        lengths = np.clip(r.exponential(scale, 50_000).astype(int) + 1, 1, 2048)
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        assert sum(n for n, _ in packing.plan(histogram)) <= 1.02 * lengths.sum() / 2048 + 1


def test_a_length_of_many_pieces_is_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 100)
    same = [(None, 0, 0, 700, 7, k) for k in range(20_000)] + [(k, 0, 0, 2048, 8, k) for k in range(500)]
    held = spark.createDataFrame(same, "doc_id long, piece int, start long, length long, ids_crc32 long, lot long")
    found = packing.pack(held).collect()
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(map(sorted, by.values())) == [[(0, 700), (700, 700)]] * 10_000 + [[(0, 2048)]] * 500


def test_stage_on_awkward_rows(spark):
    assert sorted(r.doc_id or 0 for r in packing.stage(spark, clashing(docs(spark, AWKWARD)), "").collect() if r.piece == 0) == sorted(i or 0 for i, _ in AWKWARD)
    assert packing.stage(spark, clashing(docs(spark, [])), "").collect() == []


def test_configurations_end_with_no_better_column():
    """Whatever the sizes and demands (equal ones leave ties), no configuration is worth more than a sequence at the end."""
    rng = np.random.default_rng(11)
    kinds = [rng.integers(193, 2048, 64), rng.integers(193, 420, 64), np.arange(200, 1480, 20), np.array([341, 512, 682, 683, 1023, 1024]), np.array([1024])]
    for sizes in kinds:
        sizes = sorted(set(sizes.tolist()))
        for demand in (np.full(len(sizes), 12.0), rng.integers(1, 9, len(sizes)).astype(float), rng.integers(1, 10**10, len(sizes)).astype(float)):
            base, amounts = packing.configurations(sizes, demand, 2048)
            assert np.allclose(base @ amounts, demand, rtol=1e-6) and (np.array(sizes) @ base <= 2048).all()
            worth = np.ones(len(sizes)) @ np.linalg.inv(base)
            assert packing._best_configuration(sizes, worth, 2048)[0] <= 1 + 1e-6
