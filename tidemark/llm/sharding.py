"""Sharding by extendible hashing.

Rows hash to 60 bits. A shard is a hash prefix; only a shard over its byte limit splits on one more
bit. Totals per prefix come from a histogram of the hash, ``step`` bits a round, and a further round
looks only at cells that are still too large, so rows are read once and never sorted. Each cell of
the histogram is an entry of the directory and points to its shard.

* A shard whose rows all have one hash can't split: its rows are cut into overflow shards
  ``prefix.0, prefix.1, ...`` by running size. A row larger than the limit gets a shard of its own.
* Null keys hash as the empty text, null texts weigh 0 bytes, repeated rows count each time.
* An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents
from tidemark.session import cut_lineage

BITS = 60
LIMIT = 64 << 20


def key_hash(*columns: str) -> Column:
    """The first 60 bits of the md5 of the key's text."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix_of(hashed: str, depth: int) -> Column:
    return F.shiftright(F.col(hashed), BITS - depth) if depth else F.lit(0).cast("long")


def _cells(rows: DataFrame, base: int, top: int, limit: int) -> DataFrame:
    """Per cell of ``top`` bits: its shard, or a null depth if even the cell is too large."""
    totals = [F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"),
              F.min("low").alias("low"), F.max("high").alias("high")]
    hist = rows.groupBy(prefix_of("h", top).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), F.min("h").alias("low"), F.max("h").alias("high"))
    nodes = hist.select(
        "*", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftright(cell, {top} - depth)"))
    sums = nodes.groupBy("depth", "prefix").agg(*totals)
    fits = (F.col("bytes") <= limit) | (F.col("low") == F.col("high"))
    shard = F.struct("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"))
    found = nodes.select("cell", "depth", "prefix").join(sums, ["depth", "prefix"]).groupBy("cell").agg(
        F.min(F.when(fits, shard)).alias("shard"))
    return found.select("cell", "shard.*")


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of shards that can't split, cut by running size in blocks of the order they were written."""
    placed = cut_lineage(rows.withColumn("place", F.monotonically_increasing_id())).withColumn(
        "block", F.shiftright("place", 12))
    mine, blocks = Window.partitionBy("h", "block"), Window.partitionBy("h")
    large = F.col("bytes") * 2 > limit
    sums = placed.groupBy("h", "block").agg(
        F.sum(F.when(large, 0).otherwise(F.col("bytes"))).alias("block_bytes"),
        F.count_if(large).alias("block_large"))
    before = blocks.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "h", "block", F.coalesce(F.sum("block_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("block_large").over(before), F.lit(0)).alias("large_before"))
    upto = mine.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    small_end = F.sum(F.when(large, 0).otherwise(F.col("bytes"))).over(upto)
    numbered = placed.join(sums, ["h", "block"]).withColumn(
        "slot", F.when(large, F.concat(F.lit("x"), F.count_if(large).over(upto) + F.col("large_before") - 1))
        .otherwise(F.floor((F.col("bytes_before") + small_end - F.col("bytes")) / F.lit(max(limit // 2, 1))).cast("string")))
    own = numbered.groupBy("h", "slot").agg(F.sum("bytes").alias("own_bytes"), F.count("*").alias("own_rows"))
    return numbered.join(own, ["h", "slot"]).withColumns({
        "shard": F.concat_ws(".", "shard", "slot"), "shard_bytes": F.col("own_bytes"), "shard_rows": F.col("own_rows")})


def assign(df: DataFrame, key: list[str], text: str = "text", limit: int = LIMIT, step: int = 12) -> DataFrame:
    """Key columns, ``shard`` (the bits of its prefix), ``depth``, ``shard_bytes`` and ``shard_rows`` of every row."""
    rows = cut_lineage(df.select(
        *(F.col(c) for c in key), key_hash(*key).alias("h"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")))
    pending, base, done = rows, 0, []
    while True:
        top = min(base + step, BITS)
        cells = cut_lineage(_cells(pending, base, top, limit))
        dealt = pending.withColumn("cell", prefix_of("h", top)).join(cells, "cell")
        done.append(dealt.where(F.col("depth").isNotNull()))
        if top == BITS or cells.where(F.col("depth").isNull()).isEmpty():
            break
        pending, base = dealt.where(F.col("depth").isNull()).select(rows.columns), top
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    out = out.withColumn("shard", bits)
    columns = [*key, "shard", "depth", "shard_bytes", "shard_rows"]
    full = F.col("shard_bytes") > limit
    if out.where(full).isEmpty():
        return out.select(columns)
    return out.where(~full).select(columns).unionByName(_overflow(out.where(full), limit).select(columns))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir), ["doc_id"])


def sql(limit: int = LIMIT) -> str:
    """The same shards where no shard overflows: every prefix of every row is summed."""
    return f"""WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
    ('0x' || left(md5(doc_id::VARCHAR), 15))::BIGINT AS h FROM documents),
t AS (
  SELECT k AS depth, h >> ({BITS} - k) AS prefix, sum(bytes)::BIGINT AS shard_bytes,
    count(*) AS shard_rows, min(h) AS low, max(h) AS high
  FROM d, generate_series(0, {BITS}) g(k) GROUP BY 1, 2),
m AS (
  SELECT h, min(depth) AS depth FROM d JOIN t ON h >> ({BITS} - depth) = prefix
  WHERE shard_bytes <= {limit} OR low = high GROUP BY h)
SELECT doc_id, CASE WHEN m.depth = 0 THEN '' ELSE lpad(bin(prefix), m.depth::INT, '0') END AS shard,
  m.depth::INT AS depth, shard_bytes, shard_rows
FROM d JOIN m USING (h) JOIN t ON t.depth = m.depth AND t.prefix = h >> ({BITS} - m.depth)"""
