"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards of about ``SHARD`` rows by a hash of their id, and each shard becomes one
ball tree (packed arrays). Queries travel in blocks. A block first searches one pilot shard; its k-th
scores so far then bound the search of every other shard, where nodes are visited in the order of
their upper bound (inner product with the centre plus norm times radius) and left out when that is
below the query's k-th score. Scores are integers, so ties are exact: they go to the smaller id.

* Vectors that are null, or hold null or non-finite components, take no part. Vectors are compared
  with those of their own length; a query without such a partner has no rows.
* Null ids take no part. Repeated ids are rows of their own; a query's own row is any row of its id.
* Scores beyond 64 bits stop at the largest number of 64 bits. Empty tables give empty results; other
  columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

K = 20
SHARD = 1 << 13
BLOCK = 1 << 11
LEAF = 256


def _small(whole: np.ndarray) -> np.ndarray:
    """The same numbers in two bytes each where they fit."""
    return whole.astype(np.int16) if _most(whole) < 1 << 15 else whole


def _most(whole: np.ndarray) -> float:
    """The largest size of a number; the least number of 64 bits has none among them."""
    return max(float(whole.max(initial=0)), -float(whole.min(initial=0)))


def build_tree(ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Rows in the order of the leaves; per node its rows, children, centre and radius."""
    order = np.argsort(ids, kind="stable")
    ids, whole = ids[order], vectors[order]
    vectors = whole.astype(np.float64)
    place = np.arange(len(ids))
    nodes: list[tuple[int, int, int, int]] = []
    centres, radii = [], []

    def grow(low: int, high: int) -> int:
        rows = place[low:high]
        centre = vectors[rows].mean(axis=0)
        far = np.sqrt(((vectors[rows] - centre) ** 2).sum(axis=1))
        number = len(nodes)
        nodes.append((low, high, -1, -1))
        centres.append(centre)
        radii.append(far.max())
        if high - low > LEAF:
            a = vectors[rows[far.argmax()]]
            b = vectors[rows[((vectors[rows] - a) ** 2).sum(axis=1).argmax()]]
            middle = (high - low) // 2
            place[low:high] = rows[np.argpartition(vectors[rows] @ (b - a), middle)]
            left, right = grow(low, low + middle), grow(low + middle, high)
            nodes[number] = (low, high, left, right)
        return number

    grow(0, len(ids))
    return {"ids": ids[place], "vectors": _small(whole[place]), "nodes": np.array(nodes, np.int64),
            "centres": np.array(centres), "radii": np.array(radii)}


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; floats where every sum is below 2**53."""
    most = _most(a) * _most(b) * a.shape[1]
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.astype(np.int64).T
    limit = (1 << 63) - 1
    return np.clip(a.astype(object) @ b.astype(object).T, -limit, limit).astype(np.int64)


def search(tree: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray,
           k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query row, vector id and score of each query's best ``k`` in the tree that reach its floor, and
    the floors after the search."""
    least = np.iinfo(np.int64).min  # under every score
    best = np.full((len(queries), k), least)
    named = np.full((len(queries), k), np.iinfo(np.int64).max)
    floor = floor.copy()
    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    whole = queries.astype(np.float64)

    def bounds(node: int, active: np.ndarray) -> np.ndarray:
        up = whole[active] @ tree["centres"][node] + norms[active] * tree["radii"][node]
        return up + 1e-6 * (1 + np.abs(up))

    def visit(node: int, active: np.ndarray) -> None:
        low, high, left, right = tree["nodes"][node]
        if left < 0:
            scores = _scores(queries[active], tree["vectors"][low:high])
            ids = tree["ids"][low:high]
            scores[ids[None, :] == query_ids[active, None]] = least
            cut = np.maximum(floor[active], least + 1)
            hits = scores >= cut[:, None]
            for i in np.flatnonzero(hits.any(axis=1)):
                q, at = active[i], np.flatnonzero(hits[i])
                s, v = np.r_[best[q], scores[i, at]], np.r_[named[q], ids[at]]
                top = np.lexsort((v, ~s))[:k]  # ~s falls as s rises, also at the ends of 64 bits
                best[q], named[q] = s[top], v[top]
                floor[q] = max(floor[q], best[q, -1])
            return
        ways = sorted(((bounds(c, active), c) for c in (left, right)), key=lambda x: -x[0].mean())
        for up, child in ways:
            if len(some := active[up >= floor[active]]):
                visit(child, some)

    visit(0, np.arange(len(queries)))
    row, rank = np.nonzero(best > least)
    return row, named[row, rank], best[row, rank], floor


def whole_numbers(vector: str, scale: int):
    """floor(scale * x) of every component; null where the vector takes no part."""
    good = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), dim)


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


def top_k(df: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K,
          scale: int = 64, shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each row of ``queries`` (rows like those of ``df``)."""
    def prepared(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(vec_id).cast("long").alias("id"), whole_numbers(vector, scale).alias("v"))
        return rows.where("id is not null and v is not null").withColumn("dim", F.size("v"))

    base, asked = cut_lineage(prepared(df)), cut_lineage(prepared(queries))
    spread = lambda rows, most, name: rows.join(  # noqa: E731  groups of about ``most`` rows of one length
        rows.groupBy("dim").agg(F.ceil(F.count("*") / most).alias("parts")), "dim").withColumn(
        name, F.pmod(F.xxhash64("id", F.lit(name)), F.col("parts")))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, shard = int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0])
        tree = build_tree(pdf["id"].to_numpy(np.int64), _matrix(pdf["v"], dim))
        return pd.DataFrame([(dim, shard, int(pdf["parts"].iloc[0]), _pack(**tree))], columns=["dim", "shard", "parts", "tree"])

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, block = int(pdf["dim"].iloc[0]), int(pdf["block"].iloc[0])
        packed = _pack(ids=pdf["id"].to_numpy(np.int64), vectors=_small(_matrix(pdf["v"], dim)))
        return pd.DataFrame([(dim, block, packed)], columns=["dim", "block", "queries"])

    trees = cut_lineage(spread(base, shard_rows, "shard").groupBy("dim", "shard").applyInPandas(
        plant, "dim int, shard long, parts long, tree binary"))
    blocks = cut_lineage(spread(asked, block_rows, "block").groupBy("dim", "block").applyInPandas(
        bundle, "dim int, block long, queries binary"))

    def look(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                asked = _unpack(row["queries"])
                n = len(asked["ids"])
                floor = np.full(n, np.iinfo(np.int64).min) if row["floor"] is None else np.frombuffer(row["floor"], np.int64)
                at, ids, scores, floor = search(_unpack(row["tree"]), asked["ids"], asked["vectors"].astype(np.int64), floor, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["dim"]], pa.int32()), pa.array([row["block"]], pa.int64()),
                     pa.array([floor.tobytes()], pa.binary()),
                     pa.array([at.astype(np.int32)], pa.list_(pa.int32())),
                     pa.array([ids], pa.list_(pa.int64())), pa.array([scores], pa.list_(pa.int64()))],
                    ["dim", "block", "floor", "at", "vec_id", "score"])

    found = "dim int, block long, floor binary, at array<int>, vec_id array<long>, score array<long>"
    counts = trees.select("dim", "parts").distinct()
    # A block's pilot is one shard of its length; every other shard starts from the pilot's k-th scores.
    led = blocks.join(counts, "dim").withColumn("shard", F.pmod("block", F.col("parts")))
    pilot = cut_lineage(led.join(trees.drop("parts"), ["dim", "shard"]).select(
        "dim", "block", "queries", "tree", F.lit(None).cast("binary").alias("floor")).mapInArrow(look, found))
    rest = led.withColumnRenamed("shard", "pilot").join(pilot.select("dim", "block", "floor"), ["dim", "block"]).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("shard <> pilot")
    others = rest.join(trees.drop("parts"), ["dim", "shard"]).select(
        "dim", "block", "queries", "tree", "floor").mapInArrow(look, found)

    def name(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = _unpack(batch.column("queries")[i].as_py())["ids"]
                at = np.array(batch.column("at")[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(at),
                     *(pa.array([batch.column(c)[i].as_py()] * len(at), pa.int64()) for c in ("dim", "block")),
                     batch.column("vec_id")[i].values, batch.column("score")[i].values],
                    ["query_id", "at", "dim", "block", "vec_id", "score"])

    all_found = pilot.drop("floor").union(others.drop("floor"))
    rows = all_found.join(blocks, ["dim", "block"]).select("dim", "block", "queries", "at", "vec_id", "score").mapInArrow(
        name, "query_id long, at long, dim long, block long, vec_id long, score long")
    best = Window.partitionBy("query_id", "dim", "block", "at").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


SQL = f"""WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {K}"""
