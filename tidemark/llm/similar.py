"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors become unit vectors in the order of their principal axes, so that the first few components hold
most of every product. Rows are dealt to tiles, the leaves of a kd-tree over the leading components, and
tiles to blocks. Two tiles whose boxes in the leading components lie further apart than the threshold
allows aren't compared. Of the others products are accumulated a few components at a time; what is left
of a product is at most that of the two suffix norms, and pairs that can't reach the threshold any more
stop there. Pairs that end within rounding of the threshold are settled in double precision on the
vectors as given.

A comparison of two blocks sends each row's number of links and a spanning forest of them, not the
links. Equal vectors are one before all that and count as often as they stand.

* Vectors that are null, zero, or hold null or non-finite components link with nothing. Vectors of
  different lengths don't link. Components may be of any size: vectors are scaled by a power of two first.
* Null ids belong to components but name none; repeated ids are rows of their own. Repeated rows link.
* Empty tables give empty results; labels and other columns are ignored.

The axes and the tree only order and deal the work; all rows are compared whatever they are fitted on.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.session import cut_lineage

THRESHOLD = 0.95
TILE = 1 << 10
BLOCK = 1 << 14
#: Tiles at most (they grow beyond), components of a box, rows that the tree is fitted on, bytes of axes sent.
TILES = 1 << 13
LEAD = 8
SAMPLE = 1 << 16
AXES_BYTES = 1 << 27
STEP = 8


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows with their largest component between 0.5 and 1, by an exact power of two."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def axes(vectors: DataFrame, dims: dict[int, int]) -> dict[int, np.ndarray]:
    """For each length, the principal axes of its unit vectors as columns, from all rows.

    Lengths whose axes would not fit ``AXES_BYTES`` are left in the order of their components.
    """
    fit, held = [], 0
    for dim in sorted(dims, key=dims.get, reverse=True):
        if held + 8 * dim * dim <= AXES_BYTES:
            fit.append(dim)
            held += 8 * dim * dim

    def moments(batches):
        sums = {}
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            for d in np.unique(dim).tolist():
                x = units(_rows(batch.column("v").filter(pa.array(dim == d)), d))
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            for i in range(d):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array(
                    [m[i]], pa.list_(pa.float64()))], ["dim", "i", "m"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": pdf["dim"][:1], "i": pdf["i"][:1], "m": [np.sum(pdf["m"].tolist(), axis=0)]})

    lines = (vectors.where(F.col("dim").isin(fit)).select("dim", "v").mapInArrow(moments, "dim int, i int, m array<double>")
             .groupBy("dim", "i").applyInPandas(add, "dim int, i int, m array<double>").collect())
    out = {}
    for d in fit:
        m = np.zeros((d, d))
        for r in lines:
            if r["dim"] == d:
                m[r["i"]] = r["m"]
        out[d] = np.linalg.eigh(m)[1][:, ::-1].copy()
    return out


def grow_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """(component, cut, left, right) per node, leaves as (-1, 0, number, 0).

    A node is cut along its widest component, at the widest gap of the middle half: boxes end between clusters.
    """
    nodes, count = [], 0

    def grow(rows: np.ndarray, share: int) -> int:
        nonlocal count
        number = len(nodes)
        nodes.append((-1, 0.0, 0, 0))
        if share > 1 and len(rows) > 1:
            part = sample[rows]
            k = int(np.ptp(part, axis=0).argmax())
            placed = np.sort(part[:, k])
            middle = placed[(len(rows) - 1) // 4:len(rows) - (len(rows) - 1) // 4]
            wide = int(np.diff(middle).argmax())
            cut = float(middle[wide] + middle[wide + 1]) / 2
            low = part[:, k] < cut
            if 0 < low.sum() < len(rows):
                shares = min(max(round(share * low.mean()), 1), share - 1)
                nodes[number] = (k, cut, grow(rows[low], shares), grow(rows[~low], share - shares))
                return number
        nodes[number] = (-1, 0.0, count, 0)
        count += 1
        return number

    grow(np.arange(len(sample)), leaves)
    return nodes


def leaf_of(nodes: list[tuple[int, float, int, int]], lead: np.ndarray) -> np.ndarray:
    at = np.zeros(len(lead), np.int64)
    k, cut, left, right = (np.array(x) for x in zip(*nodes))
    while (on := np.flatnonzero(k[at] >= 0)).size:
        here = at[on]
        at[on] = np.where(lead[on, k[here]] < cut[here], left[here], right[here])
    return left[at]


def _lead(x: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """The leading components of unit vectors."""
    out = np.zeros((len(x), LEAD))
    part = (x if basis is None else x @ basis[:, :LEAD])[:, :LEAD]
    out[:, :part.shape[1]] = part
    return out


def apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Least squared distance between boxes (broadcast over their last axis, the components)."""
    gap = np.maximum(np.maximum(low - other_high, other_low - high), 0.0)
    return (gap * gap).sum(axis=-1)


def reach(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of two tiles (unit vectors, leading components first) that may reach the threshold, and
    their products in single precision: stopped as soon as the suffix norms rule a pair out."""
    dim = a.shape[1]
    slack = 1e-5 + 2e-7 * dim
    ends = [*range(STEP, dim, STEP), dim]
    left = [np.sqrt(np.maximum(0, (x[:, ::-1] ** 2).cumsum(axis=1)[:, ::-1])) for x in (a, b)]
    part = a[:, :ends[0]] @ b[:, :ends[0]].T
    for n, end in enumerate(ends):
        if n:
            part += a[:, ends[n - 1]:end] @ b[:, ends[n - 1]:end].T
        if end == dim:
            i, j = np.nonzero(part >= threshold - slack)
            return i, j, part[i, j]
        open_ = part + np.outer(left[0][:, end], left[1][:, end]) >= threshold - slack
        if np.count_nonzero(open_) * 16 < open_.size:  # few are left: go on pair by pair
            i, j = np.nonzero(open_)
            sums = part[i, j]
            for start, stop in zip(ends[n:], ends[n + 1:]):
                sums = sums + np.einsum("ij,ij->i", a[i, start:stop], b[j, start:stop])
                rest = left[0][i, stop] * left[1][j, stop] if stop < dim else 0.0
                on = sums + rest >= threshold - slack
                i, j, sums = i[on], j[on], sums[on]
            return i, j, sums
    raise AssertionError("a vector has components")


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of scaled rows, in double precision."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


class Tile:
    """Rows of one tile: their numbers, how often they stand, the vectors as given and turned to the axes."""

    def __init__(self, data: bytes, basis: np.ndarray | None):
        with np.load(io.BytesIO(data)) as held:
            self.rows, self.n, self.x = held["rows"], held["n"], held["x"]
        turned = units(self.x)
        self.turned = (turned if basis is None else turned @ basis).astype(np.float32)

    @staticmethod
    def pack(rows: np.ndarray, n: np.ndarray, x: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, rows=rows, n=n, x=x)
        return out.getvalue()

    def links(self, other: Tile, threshold: float, chunk: int = TILE):
        """Places of rows here and there that link, a stretch of both at a time; each pair once."""
        slack = 1e-5 + 2e-7 * self.x.shape[1]
        for p in range(0, len(self.x), chunk):
            for q in range(p if other is self else 0, len(other.x), chunk):
                i, j, near = reach(self.turned[p:p + chunk], other.turned[q:q + chunk], threshold)
                i, j = p + i, q + j
                if other is self:
                    i, j, near = (x[i < j] for x in (i, j, near))
                good = near >= threshold + slack
                unsure = np.flatnonzero(~good)
                good[unsure] = cosines(scaled(self.x[i[unsure]]), scaled(other.x[j[unsure]])) >= threshold
                yield i[good], j[good]


class Forest:
    """Classes of numbered rows."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        while (self.up[rows] != rows).any():
            self.up[rows] = self.up[self.up[rows]]
            rows = self.up[rows]
        return rows

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.roots(i), self.roots(j)
            on = a != b
            i, j, a, b = i[on], j[on], a[on], b[on]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def _distinct(df: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """All rows as ``row, vec_id, v, key`` and the distinct vectors as ``key, row, n, least``; ``v`` and
    ``key`` are null where a row links with nothing."""
    good = F.coalesce(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
                      & F.exists(vector, lambda x: x != 0), F.lit(False))
    digits = F.array_join(F.transform("v", lambda x: x.cast("string")), ",")  # as many as tell floats apart
    rows = cut_lineage(df.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).alias("vec_id"), F.when(
        good, F.col(vector)).alias("v")).withColumn("key", F.sha2(digits.cast("binary"), 256)))
    first = rows.where("key is not null").groupBy("key").agg(
        F.min("row").alias("row"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    return rows, cut_lineage(first)


def _trees(base: DataFrame, dims: dict[int, int], basis: dict[int, np.ndarray], most: int) -> dict[int, list]:
    """For each length, a tree with a leaf for about ``most`` rows, cut by a bounded sample."""
    share = min(1.0, SAMPLE / max(sum(dims.values()), 1))

    def leads(batches):
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            for d in np.unique(dim).tolist():
                lead = _lead(units(_rows(batch.column("v").filter(pa.array(dim == d)), d)), basis.get(d))
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(lead), pa.int32()), pa.array(list(lead))], ["dim", "lead"])

    drawn = base.sample(share, seed=12).select("dim", "v").mapInArrow(leads, "dim int, lead array<double>").limit(2 * SAMPLE).collect()
    by: dict[int, list] = {d: [] for d in dims}
    for r in drawn:
        by[r["dim"]].append(r["lead"])
    return {d: grow_tree(np.array(x, np.float64).reshape(len(x), LEAD), -(-dims[d] // most)) for d, x in by.items()}


def _tiles(base: DataFrame, trees: dict[int, list], basis: dict[int, np.ndarray], most: int) -> DataFrame:
    """Packed tiles with the boxes of their leading components. A leaf with too many rows is several tiles."""
    def place(batches):
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            for d in np.unique(dim).tolist():
                some = batch.filter(pa.array(dim == d))
                leaf = leaf_of(trees[d], _lead(units(_rows(some.column("v"), d)), basis.get(d)))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(leaf)], [*some.schema.names, "leaf"])

    kind = base.schema["v"].dataType.simpleString()
    placed = cut_lineage(base.mapInArrow(place, f"row long, dim int, v {kind}, n long, leaf long"))
    parts = placed.groupBy("dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * most)).alias("parts"))
    dealt = placed.join(parts, ["dim", "leaf"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        d, x = int(pdf["dim"].iloc[0]), np.array(pdf["v"].tolist())
        lead = _lead(units(x), basis.get(d))
        data = Tile.pack(pdf["row"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), x)
        return pd.DataFrame([(d, int(pdf["leaf"].iloc[0]), int(pdf["part"].iloc[0]), len(x), lead.min(axis=0), lead.max(axis=0), data)],
                            columns=["dim", "leaf", "part", "rows", "low", "high", "data"])

    return cut_lineage(dealt.groupBy("dim", "leaf", "part").applyInPandas(
        pack, "dim int, leaf long, part long, rows long, low array<double>, high array<double>, data binary"))


def _links(tiles: DataFrame, basis: dict[int, np.ndarray], threshold: float, block: int) -> DataFrame:
    """``u, n``: how many rows each row links with, in parts; ``u, v``: links that join the same rows as all links do."""
    known = sorted(tiles.select("dim", "leaf", "part", "rows", "low", "high").collect())  # TILES at most, or twice as many
    number = {(r["dim"], r["leaf"], r["part"]): i for i, r in enumerate(known)}
    dim = np.array([r["dim"] for r in known], np.int64)
    low, high = (np.array([r[c] for r in known], np.float64).reshape(-1, LEAD) for c in ("low", "high"))
    blocks, held, last = [], 0, None
    for r in known:
        if r["dim"] != last or held + r["rows"] > block:
            held = 0
            blocks.append(len(blocks))
        else:
            blocks.append(blocks[-1] if blocks else 0)
        held, last = held + r["rows"], r["dim"]
    blocks = np.unique(np.array(blocks, np.int64), return_inverse=True)[1] if blocks else np.zeros(0, np.int64)
    far = 2 - 2 * threshold + 1e-6

    def partners(i: int) -> np.ndarray:
        return np.flatnonzero((dim == dim[i]) & (apart(low[i], high[i], low, high) <= far))

    def send(batches):
        for batch in batches:
            for d, leaf, part, data in zip(*(batch.column(c) for c in ("dim", "leaf", "part", "data"))):
                i = number[d.as_py(), leaf.as_py(), part.as_py()]
                for b in np.unique(blocks[partners(i)]).tolist():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], pa.int64()) for x in (min(blocks[i], b), max(blocks[i], b), i)] + [pa.array([data.as_py()], pa.binary())],
                        ["a", "b", "tile", "data"])

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        held = {i: Tile(data, basis.get(int(dim[i]))) for i, data in zip(pdf["tile"].tolist(), pdf["data"])}
        starts, at = {}, 0
        for i, t in held.items():
            starts[i], at = at, at + len(t.rows)
        rows = np.concatenate([t.rows for t in held.values()])
        n = np.concatenate([t.n for t in held.values()])
        found, forest = np.zeros(at, np.int64), Forest(at)
        for i in held:
            for j in held:
                if blocks[i] != a or blocks[j] != b or (a == b and j < i) or apart(low[i], high[i], low[j], high[j]) > far:
                    continue
                for p, q in held[i].links(held[j], threshold):
                    p, q = starts[i] + p, starts[j] + q
                    np.add.at(found, p, n[q])
                    np.add.at(found, q, n[p])
                    forest.join(p, q)
        some, up = np.flatnonzero(found), forest.roots(np.arange(at))
        moved = np.flatnonzero(up != np.arange(at))
        return pd.DataFrame({"u": np.r_[rows[some], rows[moved]],
                             "v": pd.array([*[None] * len(some), *rows[up[moved]].tolist()], "Int64"),
                             "n": pd.array([*found[some].tolist(), *[None] * len(moved)], "Int64")})

    pairs = max(1, int(blocks.max(initial=0)) + 1) ** 2
    return tiles.select("dim", "leaf", "part", "data").mapInArrow(send, "a long, b long, tile long, data binary").repartition(
        min(pairs, 1 << 13), "a", "b").groupBy("a", "b").applyInPandas(look, "u long, v long, n long")


def linked(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
           tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id`` of every row. The threshold is over 0."""
    rows, first = _distinct(df, vec_id, vector)
    base = cut_lineage(rows.join(first.select("row", "n"), "row").select("row", F.size("v").alias("dim"), "v", "n"))
    dims = {r["dim"]: r["rows"] for r in base.groupBy("dim").agg(F.count(F.lit(1)).alias("rows")).collect()}
    total = sum(dims.values())
    basis, most = axes(base, dims), max(tile, -(-total // TILES))
    tiles = _tiles(base, _trees(base, dims, basis, most), basis, most)
    # Blocks are small enough that there are some dozens of pairs of them, and hold a tile at least.
    links = cut_lineage(_links(tiles, basis, threshold, max(2 * most, min(block, total // 8))))
    counts = links.where("n is not null").groupBy("u").agg(F.sum("n").alias("links"))
    joined = components(links.where("v is not null").select("u", "v")).select(F.col("key").alias("row"), "root")
    named = first.join(joined, "row", "left").withColumn("root", F.coalesce("root", "row"))
    named = cut_lineage(named.join(counts, named["row"] == counts["u"], "left").select(
        "key", "root", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(least, "root").select("key", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.where("key is not null").select("vec_id", "key").join(found, "key").drop("key").unionByName(alone)


def op12_similar(spark, sf_dir: str) -> DataFrame:
    found = linked(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.vec_id),
c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.u = c.vec_id"""
