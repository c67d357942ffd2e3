"""A trie of conversation prefixes from padded matrices of turn ids, one range shard at a time.

A turn is known by 16 bytes of the SHA-256 of its role and text, a conversation by the ids of its turns
in order. Conversations are dealt to shards by range of (ids, conv_id), so a node's members are
neighbours. In a shard the ids become ranks in padded matrices of ``WIDTH`` columns: a lexsort orders
the rows, change masks accumulated by OR along the columns mark where nodes start, and reduceat sums up
every depth. Only the nodes on the path of a shard's first or last row can go on in another shard; their
parts are merged in one pass over the shards in order, which holds one path at a time.

* Rows of a conversation are ordered by turn (null first); equal turns by their ids, so that repeated
  rows are turns of their own. Null roles and texts are empty. Rows with a null conv_id take no part.
* A conversation without turns is a member of the root alone. Empty tables give no rows, not even a
  root. Other columns are ignored.
* A conversation travels as one row of 20 bytes a turn. Texts are read where they lie, however long.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

EVERY = 5
HEADS = 9
SHARD_TURNS = 1 << 18
WIDTH = 32
PIECE = 1 << 14

_SHARD = ("kind int, shard int, side int, depth int, conv_id long, up_side int, parent_conv_id long, n_convs long, "
          "n_children long, n_leaves long, saved_tokens long, own long, id binary, piece int, ends binary")
_MERGED = ("node long, parent long, depth int, conv_id long, n_convs long, n_children long, n_leaves long, "
           "saved_tokens long, ends binary, shard int, side int")
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_NAMES, _KINDS = zip(*((x.split()[0], _ARROW[x.split()[1]]) for x in _SHARD.split(", ")))
_MERGED_NAMES, _MERGED_KINDS = zip(*((x.split()[0], _ARROW[x.split()[1]]) for x in _MERGED.split(", ")))
_NODE, _OPEN, _ENDS = 0, 1, 2
_NOTHING = hashlib.sha256(b"").digest()


def turn_ids(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv_id, turn, id`` (32 hex digits) and ``size`` (UTF-8 bytes of the text) of every turn."""
    rows = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
                       F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("t"))
    whole = F.concat(F.octet_length("r").cast("string"), F.lit(":"), "r", "t").cast("binary")
    return rows.where("conv_id is not null").select(
        "conv_id", "turn", F.substring(F.sha2(whole, 256), 1, 32).alias("id"), F.octet_length("t").alias("size"))


def _listed(turns: DataFrame, *keys: str) -> DataFrame:
    known = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "id", "size")
    listed = turns.groupBy(*keys).agg(F.array_sort(F.collect_list(known)).alias("turns"))
    return listed.withColumn("turns", F.transform("turns", lambda x: F.struct(x["id"], x["size"])))


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's (id, size) in order."""
    return _listed(turns, "conv_id")


def rebuilt(turns: DataFrame, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """Each conversation c from the first h turns of c - c % ``every`` and its own after its first h.

    h is the unsigned crc32 of c in decimals, modulo ``heads``. Remainders carry the sign of c.
    """
    based = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).repartition("base")
    listed = _listed(based, "base", "conv_id")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, heads))).over(Window.partitionBy("base"))
    none = F.array().cast(listed.schema["turns"].dataType)
    return listed.withColumns({"h": h, "head": F.coalesce(head, none)}).select(
        "conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")),
                            F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _ranks(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths in turns; the turns of all rows as ranks from 1, ordered as their bytes are."""
    lengths = np.array([len(s) // 16 for s in seqs], np.int64)
    ids = np.frombuffer(b"".join(seqs), ">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    placed = ids[order]
    change = np.ones(len(order), bool)
    change[1:] = (placed[1:] != placed[:-1]).any(axis=1)
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(change)
    return lengths, ranks


def _padded(rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ranks: np.ndarray, first: int) -> np.ndarray:
    """Columns ``first`` and on of the given rows, 0 where a row has ended."""
    out = np.zeros((len(rows), min(WIDTH, int(lengths[rows].max(initial=0)) - first)), np.int64)
    for j in range(out.shape[1]):
        on = lengths[rows] > first + j
        out[on, j] = ranks[starts[rows[on]] + first + j]
    return out


def _order(conv: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The rows by turns, shorter first, then by id.

    A lexsort of one matrix places the rows that end in it. Rows that are equal so far and go on share
    one place, from which the next matrix orders them.
    """
    place = np.zeros(len(conv), np.int64)
    first, rows = 0, np.arange(len(conv))
    while len(rows):
        matrix, on = _padded(rows, starts, lengths, ranks, first), lengths[rows] > first + WIDTH
        order = np.lexsort((conv[rows], on, *matrix.T[::-1], place[rows]))
        rows, matrix, on = rows[order], matrix[order], on[order]
        group, count = place[rows], np.arange(len(rows))
        begins = np.r_[True, group[1:] != group[:-1]]
        at = group + count - np.maximum.accumulate(np.where(begins, count, 0))
        lead = begins | np.r_[True, (matrix[1:] != matrix[:-1]).any(axis=1)] | (on & ~np.r_[False, on[:-1]])
        place[rows] = np.where(on, at[np.maximum.accumulate(np.where(lead, count, 0))], at)
        rows, first = rows[on], first + WIDTH
    return np.argsort(place)


class _Depth:
    """The nodes of one depth in a shard, in order; ``rows`` are those of its members."""

    def __init__(self, depth, rows, starts, parent, weight, own, conv, lengths):
        self.first, self.last = rows[starts], rows[np.r_[starts[1:], len(rows)] - 1]
        self.parent, self.own = parent, own
        self.n = np.diff(np.r_[starts, len(rows)])
        self.conv = np.minimum.reduceat(conv[rows], starts)
        self.weight = np.add.reduceat(weight, starts)  # bytes from this turn on, of all members
        self.ends = np.add.reduceat((lengths[rows] == depth).astype(np.int64), starts)
        self.children, self.leaves, self.below = np.zeros((3, len(starts)), np.int64)
        self.open = (self.first == 0) | (self.last == len(conv) - 1)


def _levels(conv: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ranks: np.ndarray, sizes: np.ndarray) -> list[_Depth]:
    """The nodes of ordered rows by depth, with the sums of what is finished under each."""
    total, rows = np.r_[0, np.cumsum(sizes)], np.arange(len(conv))
    node = np.zeros(len(conv), np.int64)
    levels = [_Depth(0, rows, np.array([0]), np.array([0]), total[starts + lengths] - total[starts], np.array([0]), conv, lengths)]
    first, act = 0, np.flatnonzero(lengths > 0)
    while len(act):
        matrix = _padded(act, starts, lengths, ranks, first)
        change = np.ones(matrix.shape, bool)
        change[1:] = matrix[1:] != matrix[:-1]
        change[1:, 0] |= node[act][1:] != node[act][:-1]
        change = np.logical_or.accumulate(change, axis=1)
        for j in range(matrix.shape[1]):
            here = np.flatnonzero(matrix[:, j])
            rows, begin = act[here], np.flatnonzero(change[here, j])
            at = starts[rows] + first + j
            levels.append(_Depth(first + j + 1, rows, begin, node[rows[begin]], total[starts[rows] + lengths[rows]] - total[at],
                                 sizes[at[begin]], conv, lengths))
            node[rows] = np.repeat(np.arange(len(begin)), levels[-1].n)
        first += WIDTH
        act = act[lengths[act] > first]
    for level, up in zip(levels[:0:-1], levels[-2::-1]):
        done = ~level.open  # open nodes count when the shards are merged
        level.leaves[done & (level.children == 0)] = 1
        np.add.at(up.children, level.parent[done], 1)
        np.add.at(up.leaves, level.parent[done], level.leaves[done])
        np.add.at(up.below, level.parent, level.below + np.where(done, level.own, 0))
    return levels


def shard_nodes(conv: np.ndarray, seqs: list[bytes], sizes: np.ndarray, shard: int):
    """Rows of ``_SHARD``: finished nodes, open ones (on the paths of the first and the last row), the ends of those."""
    lengths, ranks = _ranks(seqs)
    starts = np.cumsum(lengths) - lengths
    order = _order(conv, starts, lengths, ranks)
    conv, starts, lengths = conv[order], starts[order], lengths[order]
    up = None
    for depth, level in enumerate(_levels(conv, starts, lengths, ranks, sizes.astype(np.int64))):
        for i, (a, ends) in enumerate(zip(level.first.tolist(), level.ends.tolist())):
            text = ",".join(map(str, conv[a:a + ends].tolist())).encode() if ends else b""
            p, side = int(level.parent[i]), 0 if a == 0 else 1
            sums = int(level.n[i]), int(level.children[i]), int(level.leaves[i])
            below = int(level.weight[i] - level.below[i])
            if level.open[i]:
                key = seqs[order[a]][16 * depth - 16:16 * depth] if depth else b""
                yield _OPEN, shard, side, depth, int(level.conv[i]), None, None, *sums, below, int(level.own[i]), key, -1, None
                for k, x in enumerate(range(0, len(text), PIECE)):
                    yield _ENDS, shard, side, depth, *[None] * 9, k, text[x:x + PIECE]
            else:
                above = bool(up.open[p])
                yield (_NODE, shard, None, depth, int(level.conv[i]), (0 if up.first[p] == 0 else 1) if above else None,
                       None if above else int(up.conv[p]), *sums, below - int(level.own[i]), None, None, None,
                       hashlib.sha256(text).digest() if ends else None)
        up = level


class _Path:
    """The open nodes from the root to where the merge has come."""

    def __init__(self):
        self.stack, self.made, self.equal = [], 0, False

    def part(self, side: int, depth: int, key: bytes, conv: int, *sums: int):
        """Add a part of a node; gives the node's number and the nodes that are finished by this."""
        done = []
        self.equal = depth < len(self.stack) and side == 0 and (depth == 0 or self.equal) and self.stack[depth]["key"] == key
        if self.equal:
            node = self.stack[depth]
            node["conv"] = min(node["conv"], conv)
            for name, x in zip(("n", "children", "leaves", "weight"), sums):
                node[name] += x
        else:
            done = self.close(depth)
            if self.stack:
                self.stack[-1]["children"] += 1
            node = dict(zip(("n", "children", "leaves", "weight", "own"), sums)) | {
                "number": self.made, "key": key, "conv": conv, "depth": depth, "below": 0, "hash": hashlib.sha256(),
                "parent": self.stack[-1]["number"] if self.stack else None, "ends": False}
            self.made += 1
            self.stack.append(node)
        return node["number"], done

    def ends(self, depth: int, piece: int, text: bytes) -> None:
        node = self.stack[depth]
        if piece == 0 and node["ends"]:
            node["hash"].update(b",")
        node["ends"] = True
        node["hash"].update(text)

    def close(self, depth: int) -> list[tuple]:
        done = []
        while len(self.stack) > depth:
            node = self.stack.pop()
            if not node["children"]:
                node["leaves"] = 1
            if self.stack:
                self.stack[-1]["leaves"] += node["leaves"]
                self.stack[-1]["below"] += node["below"] + node["own"]
            done.append((node["number"], node["parent"], node["depth"], node["conv"], node["n"], node["children"],
                         node["leaves"], node["weight"] - node["own"] - node["below"], node["hash"].digest()))
        return done


def _merge(batches):
    """Open parts in order of (shard, side, depth, piece) to finished nodes, and which node each part went to."""
    path = _Path()

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), _MERGED_KINDS)], _MERGED_NAMES)

    for batch in batches:
        out = []
        for x in batch.to_pylist():
            if x["kind"] == _ENDS:
                path.ends(x["depth"], x["piece"], x["ends"])
                continue
            number, done = path.part(x["side"], x["depth"], x["id"], x["conv_id"], x["n_convs"], x["n_children"],
                                     x["n_leaves"], x["saved_tokens"], x["own"])
            out += [(*d, None, None) for d in done]
            out.append((number, None, x["depth"], *[None] * 6, x["shard"], x["side"]))
        if out:
            yield rows(out)
    if done := path.close(0):
        yield rows([(*d, None, None) for d in done])


_OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, least_shards: int | None = None) -> DataFrame:
    """The trie of ``conv_id, turns`` (ids and sizes): a row for each node, named by its smallest member and depth.

    ``least_shards`` is the number of shards that work is cut into at least: as many as there are cores.
    """
    spark = conversations.sparkSession
    seq = F.unhex(F.array_join(F.transform("turns", lambda x: x["id"]), ""))
    packed = cut_lineage(conversations.select("conv_id", seq.alias("seq"), F.transform("turns", lambda x: x["size"]).alias("sizes")))
    turns = packed.agg(F.sum(F.size("sizes").cast("long"))).first()[0] or 0
    shards = max(-(-turns // shard_turns), least_shards or spark.sparkContext.defaultParallelism, 1)

    def run(batches):
        conv, seqs, sizes, shard = [], [], [], None
        for batch in batches:
            if batch.num_rows:
                conv.append(batch.column("conv_id").to_numpy())
                seqs += batch.column("seq").to_pylist()
                sizes.append(batch.column("sizes").flatten().to_numpy())
                shard = batch.column("shard")[0].as_py()
        if seqs:
            made = shard_nodes(np.concatenate(conv), seqs, np.concatenate(sizes), shard)
            while out := list(islice(made, 1 << 14)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], _NAMES)

    dealt = packed.repartitionByRange(shards, "seq", "conv_id").withColumn("shard", F.spark_partition_id())
    parts = cut_lineage(dealt.mapInArrow(run, _SHARD))
    opened = parts.where(F.col("kind") != _NODE).repartition(1).sortWithinPartitions("shard", "side", "depth", "piece")
    merged = cut_lineage(opened.mapInArrow(_merge, _MERGED))
    nodes, refs = merged.where("shard is null"), merged.where("shard is not null")
    sha = lambda c: F.lower(F.hex(F.coalesce(c, F.lit(_NOTHING)))).alias("ends_sha256")
    named = nodes.select(F.col("node").alias("number"), F.col("conv_id").alias("found"))
    spanning = nodes.drop("shard", "side").join(named, F.col("parent") == F.col("number"), "left").withColumn(
        "parent_conv_id", F.col("found")).select(*_OUT, sha(F.col("ends")))
    where = refs.select("shard", F.col("side").alias("up_side"), F.col("depth").alias("up_depth"), F.col("node").alias("number")).join(
        named, "number").select("shard", "up_side", "up_depth", "found")
    inner = parts.where(F.col("kind") == _NODE).withColumn("up_depth", F.col("depth") - 1)
    within = inner.where("up_side is null").select(*_OUT, sha(F.col("ends")))
    hung = inner.where("up_side is not null").join(where, ["shard", "up_side", "up_depth"]).withColumn(
        "parent_conv_id", F.col("found")).select(*_OUT, sha(F.col("ends")))
    return within.unionByName(hung).unionByName(spanning)


def op11_prefixes(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    trie = prefix_trie(rebuilt(turn_ids(rows, "conv_id", "turn", "role", "text")))
    return trie.select("conv_id", F.col("depth").cast("long").alias("depth"), *_OUT[2:], "ends_sha256")


SQL = f"""WITH RECURSIVE z AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
  lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':'
    || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {EVERY} AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
    lambda a, b: xor(a >> 8, z.crc[(xor(a, b) & 255) + 1]))) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM t), z),
b AS (SELECT c.conv_id, t.i, 0 AS own, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL SELECT c.conv_id, t.i, 1, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth,
  sha256(strlen(role)::VARCHAR || ':' || role || text) AS turn, strlen(text) AS size FROM b),
p AS (SELECT conv_id, 0::BIGINT AS depth, '' AS path, 0::BIGINT AS size FROM c
  UNION ALL SELECT s.conv_id, s.depth, sha256(p.path || s.turn), s.size FROM p JOIN s
    ON s.conv_id = p.conv_id AND s.depth = p.depth + 1),
l AS (SELECT c.conv_id, count(s.depth) AS len FROM c LEFT JOIN s ON s.conv_id = c.conv_id GROUP BY c.conv_id),
e AS (SELECT p.*, l.len, lag(path) OVER (PARTITION BY p.conv_id ORDER BY depth) AS up FROM p JOIN l ON l.conv_id = p.conv_id),
n AS (SELECT depth, path, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
  max(len) = depth AS leaf, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends
  FROM e GROUP BY depth, path),
a AS (SELECT depth, path, depth AS lv, path AS top, leaf, n_convs, size FROM n
  UNION ALL SELECT a.depth, a.path, n.depth - 1, n.up, a.leaf, a.n_convs, a.size FROM a JOIN n
    ON n.depth = a.lv AND n.path = a.top WHERE n.depth > 0),
g AS (SELECT lv, top, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved FROM a GROUP BY lv, top),
k AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n FROM n WHERE depth > 0 GROUP BY depth, up)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, g.n_leaves,
  g.saved AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN g ON g.lv = n.depth AND g.top = n.path LEFT JOIN n m ON m.depth = n.depth - 1 AND m.path = n.up
LEFT JOIN k ON k.depth = n.depth AND k.path = n.path"""
