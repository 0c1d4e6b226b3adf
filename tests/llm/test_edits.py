import random

import public_tokenizers

from thermaweave.llm import edits
from thermaweave.llm.common import doc_columns

from .helpers import AWKWARD, clashing, docs, words

C = edits.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def whole(text):
    return len(C.encoding.encode_ordinary(text))


def test_random_edits():
    r = random.Random(5)
    for k, text in enumerate(["", " ", "  a", "it's  'll 12", "x" * 50, words(300, seed=1), "\n\n \n", "a  b   c"] * 4):
        tree = C.tree(text)
        for _ in range(15):
            n = len(tree.text)
            a = r.randint(0, n)
            tree.edit(a, min(n, a + r.choice([0, 1, 2, 5, 30])), r.choice(["", " ", "  ", "\n", "a", "'s", "'", " 12", "!!", "foo bar  ", "\n\n x", "é"]))
            assert tree.total == whole(tree.text) and "".join(tree.pieces) == tree.text
            m = len(tree.pieces)
            a, z = sorted((r.randint(0, m), r.randint(0, m)))
            assert tree.tokens(a, z) == sum(map(whole, tree.pieces[a:z]))


def test_edits_touch_little():
    tree = C.tree(words(5000))
    tree.edit(9000, 9004, "other")
    assert tree.reencoded < 60 and tree.total == whole(tree.text)


def test_edits_update_few_sums():
    r = random.Random(7)
    tree = C.tree(words(5000, seed=3))
    depth = tree.width.bit_length()
    changed = 0
    for _ in range(400):
        n = tree.n_chars
        a = r.randrange(n)
        before, pieces = tree.touched, int(tree.sums[2, 1])
        tree.edit(a, min(n, a + r.choice([0, 3, 12])), r.choice(["", "one two three", " ", "x, y; z", "12 13"]))
        assert tree.touched - before <= 8 * depth
        changed += pieces != int(tree.sums[2, 1])
    assert changed > 200
    assert tree.rebuilt == 0 and tree.total == whole(tree.text) and tree.n_chars == len(tree.text)


def test_large_insertions_and_deletions():
    tree = C.tree(words(300, seed=4))
    tree.edit(200, 210, words(900, seed=5))
    assert tree.rebuilt == 1 and tree.total == whole(tree.text)
    tree.edit(100, tree.n_chars - 50, "")
    assert tree.total == whole(tree.text) and tree.n_chars == len(tree.text)
    tree.edit(0, tree.n_chars, "")
    assert tree.total == 0 and tree.text == ""
    tree.edit(0, 0, "it's" + " " * 500 + "x" * 3000 + "'ll")
    tree.edit(3, 3, "  ")
    assert tree.total == whole(tree.text)


def test_query(spark):
    rows = AWKWARD + [(30, "write to a.b@c.example.org or +1 (389) 555-5010, 10.0.0.1"), (31, words(400))]
    found = edits.count_tokens(doc_columns(clashing(docs(spark, rows)))).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in found), key=repr) == sorted(((i, whole(t or "")) for i, t in rows), key=repr)
    edited = next(r for r in found if r.doc_id == 30)
    assert edited.n_edits == 3 and edited.n_tokens_edited == whole("write to <mail> or <number>, <address>")
    assert edits.count_tokens(doc_columns(docs(spark, []))).count() == 0
