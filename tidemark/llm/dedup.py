"""Exact deduplication against immutable snapshots.

Texts are equal when they are identical after white space is deleted. Of equal texts the row with
the most code points stays, then the smallest doc_id (null last), then the first row.

A batch's duplicates are grouped among themselves by SHA-256, partial sums first, so a digest that a
third of all rows have is one row by then. Each snapshot holds digests that no earlier one has, and a
static binary fuse filter per bucket of about ``PER_FILTER`` digests; it never changes. A new batch's
digests are screened by the filters; only positives join the snapshots' digests, and the texts of both
keepers are compared byte by byte before the groups merge.

* Null texts are empty texts; empty texts equal each other. Null doc_ids are documents like others.
* Repeated rows (same doc_id and text) are one group, of which one row stays.
* Empty tables give empty results; other columns are ignored by ``classes``, kept by ``kept_rows``.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, documents, free_name, text_of
from tidemark.session import cut_lineage

PER_FILTER = 1 << 14
FILTER = "snapshot int, bucket long, seed long, segment long, segments long, cells binary"


def normalised(text: str = "text"):
    return F.regexp_replace(text_of(text), SPACE + "+", "")


def digest_of(text: str = "text"):
    return F.sha2(normalised(text).cast("binary"), 256)


# --- binary fuse filter of 8-bit fingerprints, three cells a key ---

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _places(hashed: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three cells of every key, in three consecutive segments."""
    first = (hashed >> np.uint64(40)).astype(np.int64) * segments >> 24
    inner = [(hashed >> np.uint64(s)).astype(np.int64) & (segment - 1) for s in (0, 13, 26)]
    return np.stack([(first + i) * segment + inner[i] for i in range(3)])


def _prints(hashed: np.ndarray) -> np.ndarray:
    return (hashed ^ (hashed >> np.uint64(32))).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Seed, segment length, segments and cells of a filter that holds ``keys`` (uint64)."""
    keys = np.unique(keys)
    n = max(len(keys), 1)
    segment = 1 << min(12, max(2, int(math.log(n) / math.log(3.33) + 2.25)))
    size = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2))) + segment
    segments = max(1, math.ceil(size / segment) - 2)
    for seed in range(1, 1000):
        hashed = _mix(keys, seed)
        places = _places(hashed, segment, segments)
        cells = (segments + 2) * segment
        count = np.bincount(places.ravel(), minlength=cells)
        owner = np.zeros(cells, np.int64)
        for row in places:  # the exclusive or of the keys in a cell names the key where one is left
            np.bitwise_xor.at(owner, row, np.arange(len(keys)))
        waves, alive = [], np.flatnonzero(count == 1)
        left = len(keys)
        while len(alive):
            peeled, at = np.unique(owner[alive], return_index=True)
            waves.append((peeled, alive[at]))
            left -= len(peeled)
            touched = places[:, peeled].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(owner, touched, np.tile(peeled, 3))
            touched = np.unique(touched)
            alive = touched[count[touched] == 1]
        if left == 0:
            table, prints = np.zeros(cells, np.uint8), _prints(hashed)
            for peeled, cell in reversed(waves):
                others = table[places[:, peeled]]
                table[cell] = prints[peeled] ^ others[0] ^ others[1] ^ others[2]  # the own cell is still 0
            return seed, segment, segments, table.tobytes()
    raise ValueError("no seed peels these keys")


def in_filter(keys: np.ndarray, seed: int, segment: int, segments: int, cells: bytes) -> np.ndarray:
    """Whether each key may be held: always true for held keys, true for 1 of 256 others."""
    hashed = _mix(keys, seed)
    table = np.frombuffer(cells, np.uint8)[_places(hashed, segment, segments)]
    return table[0] ^ table[1] ^ table[2] == _prints(hashed)


def snapshot_filters(snapshot: DataFrame, number: int) -> tuple[DataFrame, int]:
    """The filters of a snapshot's ``digest`` rows, and in how many buckets they come."""
    buckets = max(1, math.ceil(snapshot.count() / PER_FILTER))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = build_filter(pdf["key"].to_numpy().view(np.uint64))
        return pd.DataFrame([(number, pdf["bucket"].iloc[0], *made)],
                            columns=["snapshot", "bucket", "seed", "segment", "segments", "cells"])

    keyed = snapshot.select(F.xxhash64("digest").alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    return cut_lineage(keyed.groupBy("bucket").applyInPandas(build, FILTER)), buckets


def screen(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The ``digest`` rows that the filters let through. A large batch is cut into ``parts`` a bucket."""
    parts = max(1, math.ceil(digests.count() / buckets / PER_FILTER / 4))

    def look(new: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        passed = np.zeros(len(new), bool)
        for f in held.itertuples():
            passed |= in_filter(new["key"].to_numpy().view(np.uint64), f.seed, f.segment, f.segments, f.cells)
        return new.loc[passed, ["digest"]]

    keyed = digests.select("digest", F.xxhash64("digest").alias("key")).withColumns({
        "bucket": F.pmod("key", F.lit(buckets)), "part": F.pmod(F.xxhash64("key"), F.lit(parts))})
    dealt = filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
    return keyed.groupBy("bucket", "part").cogroup(dealt.groupBy("bucket", "part")).applyInPandas(look, "digest string")


# --- groups ---

def _rows(df: DataFrame, doc_id: str, text: str, batches: int) -> DataFrame:
    return cut_lineage(df.select(
        F.col(doc_id).alias("doc_id"), digest_of(text).alias("digest"),
        F.length(text_of(text)).alias("length"), F.monotonically_increasing_id().alias("row"),
        F.pmod(F.xxhash64(F.col(doc_id)), F.lit(batches)).alias("batch")))


def _groups(rows: DataFrame) -> DataFrame:
    keeper = F.struct((-F.col("length")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(keeper).alias("keeper"))


def _same_bytes(df: DataFrame, doc_id: str, text: str, pairs: DataFrame) -> DataFrame:
    """The digests of ``pairs`` under which both keepers' normalised texts are the same bytes."""
    wanted = pairs.select(F.explode(F.array("keeper.doc_id", "known.doc_id")).alias("wanted")).distinct()
    texts = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["wanted"]), "left_semi")
    texts = texts.select(normalised().alias("bytes"), digest_of().alias("digest")).join(
        pairs.select("digest"), "digest", "left_semi")
    return texts.groupBy("digest").agg((F.min("bytes") == F.max("bytes")).alias("same")).where("same").select("digest")


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 2) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    The rows arrive in ``batches`` (by a hash of doc_id); each is screened against the snapshots that
    the earlier ones left.
    """
    rows = _rows(df, doc_id, text, batches)
    known = cut_lineage(_groups(rows.where("batch = 0")))
    snapshots = [snapshot_filters(known, 0)]
    for k in range(1, batches):
        new = cut_lineage(_groups(rows.where(F.col("batch") == k)))
        positive = reduce(DataFrame.union, [screen(new, *s) for s in snapshots]).distinct()
        pairs = cut_lineage(new.join(positive, "digest", "left_semi").join(
            known.select("digest", F.col("n").alias("known_n"), F.col("keeper").alias("known")), "digest"))
        same = pairs.join(_same_bytes(df, doc_id, text, pairs), "digest", "left_semi").select(
            "digest", F.col("n").alias("more"), F.col("keeper").alias("other"))
        same = cut_lineage(same)
        fresh = new.join(same, "digest", "left_anti")
        if k + 1 < batches:
            fresh = cut_lineage(fresh)
            snapshots.append(snapshot_filters(fresh, k))
        merged = known.join(same, "digest", "left").select(
            "digest", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.least("keeper", "other").alias("keeper"))
        known = merged.unionByName(fresh)
        known = cut_lineage(known) if k + 1 < batches else known
    return rows.join(known, "digest").select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("keeper.row")).alias("kept"), F.col("digest").alias("text_sha256"))


def kept_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    found = cut_lineage(classes(df, doc_id, text))
    key, digest, length, kept_digest = (free_name(df, f"dedup_{x}") for x in ("key", "digest", "length", "kept"))
    lost = found.where(~F.col("kept")).select(F.col("doc_id").alias(key))
    shared = cut_lineage(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key)))
    match = df[doc_id].eqNullSafe(F.col(key))
    if shared.isEmpty():
        return df.join(lost, match, "left_anti")
    # A doc_id of several rows doesn't name a row: there the digest decides, and of repeated rows one stays.
    single = df.join(shared, match, "left_anti")
    single = single.join(lost, single[doc_id].eqNullSafe(F.col(key)), "left_anti")
    stays = found.where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(kept_digest))
    several = df.join(shared, match, "left_semi").withColumns({
        digest: digest_of(text), length: F.length(text_of(text))})
    several = several.join(
        stays, several[doc_id].eqNullSafe(F.col(key)) & (F.col(digest) == F.col(kept_digest)), "left_semi")
    best = several.groupBy(doc_id, digest).agg(F.max_by(F.struct(*df.columns), length).alias(key))
    return single.unionByName(best.select(*(F.col(key)[c].alias(c) for c in df.columns)))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))


SQL = f"""WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g')) AS text_sha256 FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""
