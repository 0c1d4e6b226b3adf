"""Prefix trie of conversations: sorted matrices of turn ids in range shards, whose boundary nodes are put together."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, stored, table

#: Columns of a padded matrix; deeper turns come in further matrices, of the rows that go on.
WIDE = 32
#: Bytes of a turn's id.
ID = 16
#: What a trie has no more of than this many rows at once between a task and Spark.
ROWS = 1 << 15

NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """32 hex digits of the SHA-256 of role and text, told apart by the role's length; null is empty."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * ID)


def turn_arrays(conversations: DataFrame, by: Column | None = None) -> DataFrame:
    """family, conv_id, turns: each conversation's turns (turn, id, bytes of the text) in order of turn, null first.

    Texts are hashed before they move, in one exchange on the family (the id itself, unless `by` says otherwise). Turns
    of equal number are in order of their ids. Rows without a conv_id belong to no conversation and are left out. A
    conversation is one row of 36 bytes or so a turn.
    """
    own = F.col("conv_id").cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        (own if by is None else by).alias("family"), own.alias("conv_id"),
        F.struct(F.col("turn"), turn_id(F.col("role"), F.col("text")).alias("id"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).alias("n_bytes")).alias("t"))
    return rows.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_heads(conversations: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """conv_id, turns: conversation c with its first h turns exchanged for those of c - c % family, h = crc32(c) % heads.

    A family stays in one partition from the arrays on, so nothing else moves. Without such a first conversation the h
    turns go; a conversation may end up without turns.
    """
    first = F.col("conv_id").cast("long") - F.pmod(F.col("conv_id").cast("long"), F.lit(family))
    arrays = turn_arrays(conversations, first)
    head = F.first(F.when(F.col("conv_id") == F.col("family"), F.col("turns")), ignorenulls=True).over(Window.partitionBy("family"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    joined = F.concat(F.slice(F.coalesce(F.col("_head"), F.filter("turns", lambda _: F.lit(False))), F.lit(1), n), F.slice("turns", n + 1, F.size("turns")))
    return arrays.withColumn("_head", head).select("conv_id", joined.alias("turns"))


def _prefix_digests(ids: bytes) -> list[bytes]:
    """A digest of each prefix of a row, the empty one first."""
    h = hashlib.sha256()
    out = [h.digest()[:ID]]
    for k in range(0, len(ids), ID):
        h.update(ids[k : k + ID])
        out.append(h.digest()[:ID])
    return out


class Shard:
    """Conversations of one range, in order of their turn ids and then their own, and how long each is like the one before."""

    def __init__(self, conv: np.ndarray, ids: np.ndarray, n_bytes: np.ndarray, lengths: np.ndarray):
        """ids: ID bytes a turn, one conversation after another."""
        self.ids, at = ids, np.concatenate([[0], np.cumsum(lengths)])
        halves = ids.view(">u8").reshape(-1, ID // 8)
        order = np.lexsort(tuple(halves[:, k] for k in range(ID // 8 - 1, -1, -1)))
        fresh = np.ones(len(order), dtype=np.int64)
        fresh[1:] = (halves[order[1:]] != halves[order[:-1]]).any(axis=1)
        self.dense = np.zeros(len(order) + 1, dtype=np.int64)
        self.dense[order] = np.cumsum(fresh)  # 0 is padding
        self.at, self.length = at[:-1], lengths
        blocks = max(1, -(-int(lengths.max()) // WIDE))
        rest = np.zeros(len(conv), dtype=np.int64)  # rank of what comes behind the block
        for b in range(blocks - 1, 0, -1):
            rows = np.flatnonzero(lengths > b * WIDE)
            m = self.matrix(rows, b)
            by = np.lexsort((rest[rows], *m.T[::-1]))
            new = np.ones(len(rows), dtype=np.int64)
            new[1:] = (m[by[1:]] != m[by[:-1]]).any(axis=1) | (rest[rows[by[1:]]] != rest[rows[by[:-1]]])
            ranks = np.zeros(len(conv), dtype=np.int64)
            ranks[rows[by]] = np.cumsum(new)
            rest = ranks
        order = np.lexsort((conv, rest, *self.matrix(np.arange(len(conv)), 0).T[::-1]))
        self.conv, self.at, self.length = conv[order], self.at[order], self.length[order]
        self.sums = np.concatenate([[0], np.cumsum(n_bytes)])
        self.common = self._common(blocks)

    def matrix(self, rows: np.ndarray, block: int) -> np.ndarray:
        """Turn ids of a block of columns, padded with zeros."""
        columns = np.arange(block * WIDE, min((block + 1) * WIDE, int(self.length[rows].max(initial=0))))
        inside = columns < self.length[rows][:, None]
        return self.dense[np.where(inside, self.at[rows][:, None] + columns, len(self.dense) - 1)]

    def _common(self, blocks: int) -> np.ndarray:
        """Turns that each row has in common with the row before (the first row: -1)."""
        out = np.zeros(len(self.conv), dtype=np.int64)
        rows = np.arange(1, len(self.conv))
        for b in range(blocks):
            if not len(rows):
                break
            both = np.concatenate([rows - 1, rows])
            upper, lower = np.split(self.matrix(both, b), 2)
            changed = np.logical_or.accumulate(upper != lower, axis=1)
            least = np.minimum(self.length[rows], self.length[rows - 1]) - b * WIDE
            same = np.minimum((~changed).sum(axis=1), least)
            out[rows] += same
            rows = rows[(same == WIDE) & (least > WIDE)]
        out[0] = -1
        return out

    def bytes_to(self, rows: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        """Bytes of the first `depth` turns."""
        return self.sums[self.at[rows] + depth] - self.sums[self.at[rows]]

    def row_ids(self, row: int) -> bytes:
        return self.ids[ID * self.at[row] : ID * (self.at[row] + self.length[row])].tobytes()

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
        """For each depth: the rows that reach it, where nodes start among them, and sums by node.

        A row brings to each node that it goes through: one member, the bytes of the turns below that it shares with the
        row before, a child if one starts at it, a leaf if it ends there and the next row doesn't go on from it. What the
        first row shares with the shard before, and whether the last row is a leaf, is not known here and left out.
        """
        last = len(self.conv) - 1
        leaf = np.zeros(last + 1, dtype=np.int64)
        leaf[:-1] = self.common[1:] != self.length[:-1]
        shared = self.bytes_to(np.arange(last + 1), np.maximum(self.common, 0))
        rows = np.arange(last + 1)
        for d in range(int(self.length.max()) + 1):
            rows = rows[self.length[rows] >= d]
            common = self.common[rows]
            starts = np.flatnonzero(common < d) if d else np.zeros(1, dtype=np.int64)
            add = lambda x: np.add.reduceat(x.astype(np.int64), starts)  # noqa: B023, E731
            yield d, rows, starts, {
                "n_convs": np.diff(np.append(starts, len(rows))),
                "conv_id": np.minimum.reduceat(self.conv[rows], starts),
                "n_children": add((self.length[rows] > d) & (common <= d) & (rows > 0)),
                "n_leaves": add(leaf[rows]),
                "saved_tokens": add(np.where(common >= d, shared[rows] - self.bytes_to(rows, max(d - 1, 0)), 0)),
                "n_ends": add(self.length[rows] == d),
            }


_LONGS = ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
#: kind: node (complete), part (of a node that other shards may share), ends (ids that end at such a node), edge (of a shard).
_PARTS = "kind string, shard int, depth long, " + ", ".join(f"{c} long" for c in _LONGS) + ", ends_sha256 string, node binary, parent binary, first boolean, last boolean, piece binary, first_ids binary, last_ids binary, first_bytes array<long>"


def _kinds() -> dict[str, pa.DataType]:
    out = {"kind": pa.string(), "shard": pa.int32(), "depth": pa.int64(), **{c: pa.int64() for c in _LONGS}, "ends_sha256": pa.string()}
    return out | {"node": pa.binary(), "parent": pa.binary(), "first": pa.bool_(), "last": pa.bool_(), "piece": pa.binary(), "first_ids": pa.binary(), "last_ids": pa.binary(), "first_bytes": pa.list_(pa.int64())}


class _Out:
    """Rows for Spark, handed over in batches."""

    def __init__(self, shard: int):
        self.shard, self.rows = shard, []

    def add(self, kind: str, depth: int, **values) -> None:
        self.rows.append({"kind": kind, "shard": self.shard, "depth": depth, **values})

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return batch({c: ([r.get(c) for r in rows], t) for c, t in _kinds().items()})


def _shard_rows(s: Shard, shard: int) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard, complete or in part, in the columns of _PARTS."""
    out, end = _Out(shard), len(s.conv) - 1
    paths = {0: _prefix_digests(s.row_ids(0)), end: _prefix_digests(s.row_ids(end))}
    above = np.zeros(end + 1, dtype=np.int64)  # of each row, the smallest member of its node one level up
    sides = np.zeros(end + 1, dtype=np.int8)  # 1: that node has the first row, 2: the last, 3: both
    out.add("edge", 0, conv_id=int(s.conv[0]), first_ids=s.row_ids(0), last_ids=s.row_ids(end), first_bytes=[int(s.bytes_to(np.array([0]), k)[0]) for k in range(int(s.length[0]) + 1)])
    for d, rows, starts, sums in s.levels():
        held = {c: v.tolist() for c, v in sums.items()}
        parents, up = above[rows[starts]].tolist(), sides[rows[starts]].tolist()
        n = len(starts)
        side = np.zeros(n, dtype=np.int8)
        side[0] |= rows[0] == 0
        side[-1] |= 2 * (rows[-1] == end)
        for k, (at, mark) in enumerate(zip(starts.tolist(), side.tolist(), strict=True)):
            values = {c: held[c][k] for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")}
            ids = s.conv[rows[at : at + held["n_ends"][k]]].tolist()
            piece = ",".join(map(str, ids)).encode()
            if d and up[k]:
                values["parent"] = paths[0 if up[k] & 1 else end][d - 1]
            elif d:
                values["parent_conv_id"] = parents[k]
            if mark:
                node = paths[0 if mark & 1 else end][d]
                out.add("part", d, node=node, first=bool(mark & 1), last=bool(mark & 2), **values)
                if ids:
                    out.add("ends", d, node=node, conv_id=ids[0], piece=piece)
            else:
                out.add("node", d, ends_sha256=hashlib.sha256(piece).hexdigest() if ids else NO_ENDS, **values)
            if len(out.rows) >= ROWS:
                yield out.batch()
        above[rows] = np.repeat(sums["conv_id"], sums["n_convs"])
        sides[rows] = np.repeat(side, sums["n_convs"])
    yield out.batch()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of (conv_id, ids, n_bytes) to the rows of _PARTS."""
    conv, ids, n_bytes, lengths = [], [], [], []
    for b in batches:
        if b.num_rows:
            raw = b.column(1).cast(pa.large_binary())
            conv.append(b.column(0).to_numpy(zero_copy_only=False))
            ids.append(np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8))
            n_bytes.append(b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            lengths.append(np.fromiter((len(x) // ID for x in raw.to_pylist()), dtype=np.int64, count=len(raw)))
    if conv:
        yield from _shard_rows(Shard(*map(np.concatenate, (conv, ids, n_bytes, lengths))), TaskContext.get().partitionId())


def _common_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, common, of (shard, first_ids, ids of the last row before): -1 where there is none."""
    for b in batches:
        out = []
        for mine, theirs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if theirs is None:
                out.append(-1)
                continue
            n = min(len(mine), len(theirs)) // ID
            a, z = (np.frombuffer(x[: n * ID], dtype=f"V{ID}") for x in (mine, theirs))
            differs = np.flatnonzero(a != z)
            out.append(int(differs[0]) if len(differs) else n)
        yield batch({"shard": (b.column(0), pa.int32()), "common": (out, pa.int64())})


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, ends_sha256, of (node, piece) in order of node and of the pieces' ids; nothing but a hash is kept of a node."""
    at, h = None, None
    for b in batches:
        done = []
        for node, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if node == at:
                h.update(b"," + piece)
                continue
            if at is not None:
                done.append((at, h.hexdigest()))
            at, h = node, hashlib.sha256(piece)
        yield batch({"node": ([x for x, _ in done], pa.binary()), "ends_sha256": ([x for _, x in done], pa.string())})
    if at is not None:
        yield batch({"node": ([at], pa.binary()), "ends_sha256": ([h.hexdigest()], pa.string())})


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turns: structs of id and n_bytes), a row a node, in the columns NODE.

    Conversations go to range shards by their turn ids and then their own id, so that copies of one conversation, however
    many, or a common beginning, are dealt over shards. A shard sorts padded matrices of turn ids; column changes,
    OR-accumulated, mark where nodes start, and every depth is summed by node. Only nodes on the path of a shard's first
    or last row can go on in another shard: those are summed over shards, after what a shard's first row shares with the
    row before it, and whether its last row is a leaf, has come from the neighbour. ids that end at such a node are hashed
    in order, piece by piece. Turns are told apart by 128 bits of SHA-256. conv_ids are distinct. No conversations: no
    nodes; conversations without turns are members of the root. A shard is in memory at once, as Spark sizes shuffle
    partitions; edges of shards (a row each) meet in one task.
    """
    ids = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    rows = arrays.select("conv_id", ids.alias("ids"), F.transform("turns", lambda t: t["n_bytes"]).alias("n_bytes"))
    parts = stored(rows.repartitionByRange("ids", "conv_id").mapInArrow(_parts, _PARTS), "trie-parts")
    edges = parts.where("kind = 'edge'").select("shard", "conv_id", "first_ids", "last_ids", "first_bytes")
    along = Window.orderBy("first_ids", "conv_id")
    met = edges.select("shard", "first_ids", F.lag("last_ids").over(along).alias("_before")).mapInArrow(_common_turns, "shard int, common long")
    # Common turns fit the shorter of both rows, so equality with the last row's length means that the next goes on from it.
    edges = edges.join(met, "shard").withColumn("_next", F.lead("common").over(along))
    edges = edges.select("shard", "common", "first_bytes", (F.octet_length("last_ids") / ID).cast("long").alias("_n_last"), "_next")
    d, common = F.col("depth"), F.col("common")
    n_first = F.size("first_bytes") - 1
    one = lambda test: F.when(test, 1).otherwise(0)
    to = lambda k: F.get("first_bytes", k.cast("int"))
    mended = parts.where("kind = 'part'").select("shard", "depth", "node", "parent", "first", "last", *[c for c in _LONGS if c != "parent_conv_id"]).join(edges, "shard")
    mended = mended.withColumns({
        "n_children": F.col("n_children") + one(F.col("first") & (n_first > d) & (common <= d)),
        "saved_tokens": F.col("saved_tokens") + F.when(F.col("first") & (common >= d), to(common) - to(F.greatest(d - 1, F.lit(0)))).otherwise(0),
        "n_leaves": F.col("n_leaves") + one(F.col("last") & ~F.coalesce(F.col("_next") == F.col("_n_last"), F.lit(False))),
    })
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    whole = stored(mended.groupBy("node", "depth").agg(F.min("conv_id").alias("conv_id"), F.first("parent", ignorenulls=True).alias("parent"), *sums), "trie-boundary")
    pieces = parts.where("kind = 'ends'").select("node", "conv_id", "piece").repartition("node").sortWithinPartitions("node", "conv_id")
    ends = pieces.select("node", "piece").mapInArrow(_ends, "node binary, ends_sha256 string")
    over = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    boundary = whole.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))).join(over, "parent", "left")
    inner = parts.where("kind = 'node'")
    below = inner.where(F.col("parent").isNotNull()).drop("parent_conv_id").join(over, "parent")
    return boundary.select(*NODE).unionByName(below.select(*NODE)).unionByName(inner.where(F.col("parent").isNull()).select(*NODE))


#: crc32 bit by bit: each byte of the decimal id, then seven zeros, is added to what is shifted out.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda k: [ascii(substring(c::VARCHAR, k, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))), 4294967295)"

ORACLE = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'id': id, 'b': b}} ORDER BY p) AS turns FROM t GROUP BY c),
h AS (SELECT c, turns, c - ((c % 5) + 5) % 5 AS f, {_CRC} % 9 AS h FROM own),
s AS (SELECT h.c, list_concat(coalesce(o.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN own o ON o.c = h.f),
paths AS (SELECT c, len(turns) AS n, d, list_transform(turns[1:d], lambda x: x.id) AS path, CASE WHEN d > 0 THEN turns[d].b ELSE 0 END AS b FROM s, unnest(range(0, len(turns) + 1)) u(d)),
node AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d) AS ends FROM paths GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (path, d)),
up AS (SELECT f.path[1:k] AS path, k AS d, (n_convs - 1) * b AS saved, (n_children = 0)::INT AS leaf FROM full_node f, unnest(range(0, f.d + 1)) u(k)),
below AS (SELECT path, d, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM up GROUP BY ALL)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, n_leaves, saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_node f JOIN below USING (path, d) LEFT JOIN node p ON p.d = f.d - 1 AND p.path = f.path[1:f.d - 1]"""


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt on the beginnings of their families."""
    return prefix_trie(with_heads(table(spark, sf_dir, "conversations")))
