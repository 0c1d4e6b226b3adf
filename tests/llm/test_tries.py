import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from thermaweave.llm import tries
from thermaweave.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def brute(convs):
    """Nodes by walking over all prefixes of all conversations."""
    members, ends = {}, {}
    for c in sorted(convs):
        seq = tuple(convs[c])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves.get(p, 0) if p in kids else 1
        saved[p] = saved.get(p, 0) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        if p:
            for total, own in ((kids, 1), (leaves, leaves[p]), (saved, saved[p])):
                total[p[:-1]] = total.get(p[:-1], 0) + own
    sha = lambda p: hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], sha(p)) for p, m in members.items()), key=repr)


def found(spark, rows, shards=None, arrays=tries.with_heads):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards or before)
    try:
        out = tries.prefix_trie(arrays(spark.createDataFrame(rows, SCHEMA)))
        assert out.columns == list(tries.NODE)
        return sorted(map(tuple, out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def plain(rows):
    own = {}
    for c, turn, role, text in sorted(rows, key=lambda r: r[1]):
        own.setdefault(c, []).append((role, text))
    return own


AWKWARD = [(1, None, None, None), (1, 0, "user", ""), (2, 3, None, "é" * 9), (3, 1, "user", "x" * 50000), (4, 0, "system", "s"), (None, 0, "user", "lost"), (10, 0, "a", "b"), (11, 5, "ab", ""), (12, 0, "", "ab"), (0, 0, "user", "hi"), (0, 1, "assistant", "ho"), (-7, 0, "user", "hi"), (13, 0, "user", "only")]


@pytest.mark.parametrize("shards", [1, 3, 13])
def test_brute_force(spark, shards):
    r = random.Random(shards)
    rows = AWKWARD + [(c, t, r.choice(["user", "assistant"]), r.choice("abé") * r.randrange(1, 3)) for c in range(20, 140) for t in range(r.randrange(1, 12))]
    assert found(spark, rows, shards) == brute(rebuilt(rows))


@pytest.mark.parametrize("shards", [1, 7])
def test_copies_common_beginnings_and_deep_turns(spark, shards):
    rows = [(c, t, "user", f"same {t}") for c in range(60) for t in range(4)]  # a third of the rows are copies
    rows += [(100 + c, t, "user", f"same {t}" if t < 2 else f"{c % 7}-{t}") for c in range(40) for t in range(5)]
    rows += [(200 + c, t, "user", "deep" if t < 70 + c else f"end {c % 2}") for c in range(6) for t in range(110)]
    assert found(spark, rows, shards, tries.turn_arrays) == brute(plain(rows))


def test_turnless_conversations_and_empty_tables(spark):
    rows = [(c, 0, "user", "x") for c in range(1, 40) if c % 5]
    want = brute(rebuilt(rows))
    assert found(spark, rows, 5) == want and any(not s for s in rebuilt(rows).values())
    none = [(c, 0, "user", "x") for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9]
    assert found(spark, none, 5) == brute(rebuilt(none)) and len(brute(rebuilt(none))) == 1
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []


def test_clashing_names(spark):
    rows = [(c, t, "user", f"{c % 3}{t}") for c in range(30) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.selectExpr("*", *[f"7 AS `{c}`" for c in ("family", "turns", "_head", "id", "n_bytes", "ids", "shard", "depth", "node", "parent", "kind", "common", "t")])
    assert sorted(map(tuple, tries.prefix_trie(tries.with_heads(more)).collect()), key=repr) == brute(rebuilt(rows))


def test_shard_order_and_common_turns():
    r = np.random.default_rng(1)
    lengths = r.integers(0, 90, 200)
    turns = r.integers(0, 2, lengths.sum()) * (r.random(lengths.sum()) < 0.05)
    ids = np.repeat(turns.astype(np.uint8)[:, None], tries.ID, axis=1).reshape(-1)
    s = tries.Shard(np.arange(200), ids, np.ones(lengths.sum(), dtype=np.int64), lengths)
    rows = [s.row_ids(k) for k in range(200)]
    assert rows == sorted(rows)
    for k in range(1, 200):
        a, b = rows[k - 1][:: tries.ID], rows[k][:: tries.ID]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert s.common[k] == n and (rows[k - 1] != rows[k] or s.conv[k - 1] < s.conv[k])


def test_query_against_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    theirs = con.sql(tries.ORACLE)
    ours = tries.op13(spark, SF)
    assert ours.columns == theirs.columns
    got = sorted(map(tuple, ours.collect()), key=repr)
    assert got == sorted(theirs.fetchall(), key=repr) == brute(rebuilt([tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]))
