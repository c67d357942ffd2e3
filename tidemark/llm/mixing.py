"""Mixing sources to target weights by hash thresholds.

A source's target is its weighted share of the budget, stopped at ``most`` times its size, the
excess reshared by weight. A target of q whole passes and a rest r takes every document q times and
those whose hash lies under the source's threshold once more. The threshold comes from sums by
(source, hash bucket): the bucket in which the running sum passes r is refined by further bits until
one hash is left, and taken if that comes nearer to r. Nothing is sorted; documents of a larger
budget include those of a smaller one.

* Sources go by code point, null (a source like any other) last. Null texts have size 0.
* Repeated rows share a hash and are taken together. Empty tables give empty results.
* Other columns are ignored by ``take`` and kept by ``repeated``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, documents, free_name
from tidemark.llm.sharding import BITS, key_hash
from tidemark.operators.prefix import numbered
from tidemark.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
STEP = 12


def size_of(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, share: float, most: int, weights: tuple[int, ...]) -> DataFrame:
    """``source, source_size`` with ``target``: level times weight, or the stop where that is lower."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = cut_lineage(numbered(totals, [], [F.col("source").isNull(), F.col("source")], "place").select(
        "source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("stop")))
    level, stopped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("stop") < F.lit(level) * F.col("weight")
        x = rows.agg(F.sum("source_size").alias("all"), F.count_if(above).alias("n"),
                     F.sum(F.when(above, F.col("stop"))).alias("used"),
                     F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        if x["n"] == stopped or not x["free"]:
            break
        stopped, level = x["n"], (share * x["all"] - (x["used"] or 0)) / x["free"]
    goal = F.lit(level or 0.0) * F.col("weight")
    return rows.select("source", "source_size", F.when(
        F.col("stop") < goal, F.col("stop").cast("double")).otherwise(goal).alias("target"))


def thresholds(rows: DataFrame, share: float, most: int, weights: tuple[int, ...]) -> DataFrame:
    """Per source: size, target, whole passes, and the hash under which a document is taken once more."""
    def sums(some: DataFrame, top: int) -> DataFrame:
        return some.groupBy("source", F.shiftright("h", BITS - top).alias("bucket")).agg(
            F.sum("size").alias("bucket_size"), F.min("h").alias("low"), F.max("h").alias("high"))

    first = cut_lineage(sums(rows, STEP))
    goal = targets(first.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share, most, weights)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = cut_lineage(goal.withColumn("passes", passes).withColumn(
        "rest", F.col("target") - F.col("passes") * F.col("source_size")))
    upto = Window.partitionBy("source").orderBy("bucket")
    open_, hist, base, cuts = goal.select("source", "rest"), first, STEP, []
    while True:
        edge = hist.join(open_, hist["source"].eqNullSafe(open_["source"])).drop(open_["source"]).withColumn(
            "upto", F.sum("bucket_size").over(upto)).where(
            (F.col("upto") - F.col("bucket_size") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
        edge = cut_lineage(edge.withColumn("rest", F.col("rest") - (F.col("upto") - F.col("bucket_size"))))
        one = F.col("low") == F.col("high")
        cuts.append(edge.where(one).select(
            "source", F.when(F.col("bucket_size") <= 2 * F.col("rest"), F.col("high") + 1).otherwise(F.col("low")).alias("below")))
        wide = edge.where(~one)
        if wide.isEmpty():
            break
        into = wide.select(F.col("source").alias("of"), F.col("bucket").alias("inside"))
        within = rows.join(into, rows["source"].eqNullSafe(into["of"])
                           & (F.shiftright("h", BITS - base) == F.col("inside")), "left_semi")
        base += STEP
        open_, hist = wide.select("source", "rest"), cut_lineage(sums(within, base))
    below = cuts[0]
    for more in cuts[1:]:
        below = below.unionByName(more)
    below = below.withColumnRenamed("source", "of")
    return cut_lineage(goal.join(below, goal["source"].eqNullSafe(below["of"]), "left").select(
        "source", "source_size", "target", "passes", F.coalesce("below", F.lit(0)).alias("below")))


def take(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
         share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes."""
    rows = cut_lineage(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                                 size_of(text).alias("size"), key_hash(doc_id).alias("h")))
    cut = thresholds(rows, share, most, weights)
    times = F.col("passes") + (F.col("h") < F.col("below")).cast("int")
    return rows.join(cut, rows["source"].eqNullSafe(cut["source"])).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))


def repeated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as it is taken."""
    rows = cut_lineage(df.select(F.col(source).alias("source"), size_of(text).alias("size"), key_hash(doc_id).alias("h")))
    names = {x: free_name(df, f"mix_{x}") for x in ("source", "passes", "below", "copy")}
    cut = thresholds(rows, share, most, weights).select(*(F.col(x).alias(names[x]) for x in ("source", "passes", "below")))
    times = (F.col(names["passes"]) + (key_hash(doc_id) < F.col(names["below"])).cast("int")).cast("int")
    copies = F.explode(F.array_repeat(F.lit(1), times))
    return df.join(cut, df[source].eqNullSafe(cut[names["source"]])).select(
        *(df[c] for c in df.columns), copies.alias(names["copy"])).drop(names["copy"])


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return take(documents(spark, sf_dir))


SQL = f"""WITH d AS (
  SELECT doc_id, source, ('0x' || left(md5(doc_id::VARCHAR), 15))::BIGINT AS h,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (
  SELECT *, 2 * source_size AS stop,
    [3, 1, 2][(row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (
  SELECT *, sum(stop) OVER p - stop AS used, sum(weight) OVER () - (sum(weight) OVER p - weight) AS free_weight,
    1.5 * sum(source_size) OVER () AS budget FROM w
  WINDOW p AS (ORDER BY stop / weight, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (budget::DOUBLE - used::DOUBLE) / free_weight::DOUBLE AS level FROM o),
f AS (SELECT max(level) AS level FROM l),
g AS (SELECT source, source_size, least(stop::DOUBLE, level * weight) AS target FROM w, f),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM g),
r AS (
  SELECT doc_id, size, source_size, target, passes, target - passes * source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
  (size * (passes + CASE WHEN 2 * upto - size <= 2 * rest AND rest > 0 THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"""
