import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from thermaweave.llm import pieces
from thermaweave.llm.common import table

from .helpers import AWKWARD, clashing, docs, words

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40))
def test_any_text(library, text):
    assert pieces.prefix_table(MODEL).encode(text) == library.encode(text)


def test_mixes_of_pieces_and_marks(library):
    r, t = random.Random(5), pieces.prefix_table(MODEL)
    vocabulary = list(t.id_of)
    for k in range(3000):
        texts = ["".join(r.choice(vocabulary) for _ in range(r.randrange(9))), "".join(r.choice("ab  ▁\n\t\x00é漢1#<>s/") for _ in range(r.randrange(40))), "".join(r.choice("etaoins hrd") for _ in range(r.randrange(80)))]
        for text in texts:
            assert t.encode(text) == library.encode(text), text


def test_long_runs_and_emptied_tables(library, monkeypatch):
    t = pieces.PrefixTable(MODEL)
    monkeypatch.setattr(pieces, "RUNS", 3)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    for text in ("etaoinshr" * 3000, "▁" * 999, " " * 999, "12" * 500, words(500, kinds=90)):
        assert t.encode(text) == library.encode(text)
    assert len(t.known) <= 3 and len(t.agreed) <= 5


def test_tokens_go_together_just_if_the_library_keeps_them(library):
    t = pieces.prefix_table(MODEL)
    assert t.merged("▁the") == ["▁the"] and not t.agree("▁t", "he")
    assert t.run_ids("▁the") == [t.id_of["▁the"]]


def test_awkward_rows_and_round_trip(spark, library):
    rows = AWKWARD + [(20, "a▁b"), (21, "\x00\x01"), (22, " two  spaces ")]
    found = pieces.encode_pieces(clashing(docs(spark, rows)), MODEL, decoded=True)
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in found.collect()), key=repr)
    assert got == sorted(((i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in rows), key=repr)
    again = pieces.decode_pieces(found.drop("decoded"), MODEL)
    assert sorted((tuple(r) for r in again.collect()), key=repr) == sorted(((i, (t or "").replace("▁", " ")) for i, t in rows), key=repr)
    assert pieces.encode_pieces(docs(spark, []), MODEL).count() == 0
    assert pieces.decode_pieces(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MODEL).first().text == ""


def test_query(spark, library):
    want = [(r.doc_id, len(ids := library.encode(r.text or "")), sha(",".join(map(str, ids))), sha(library.decode(ids))) for r in table(spark, SF, "documents").collect()]
    found = pieces.op12(spark, SF)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(want) != []
