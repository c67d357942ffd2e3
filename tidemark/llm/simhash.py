"""SimHash near-duplicates by anchor-point covering.

The 64 bits of a fingerprint are cut into three segments. Fingerprints that differ in four bits or
fewer differ in one bit or none on some segment. The anchors of a segment are the words of a covering
code: the perfect Hamming code on 15 of its bits, every value on the rest, covering radius 1. Each
fingerprint is sent to every anchor within radius + 1 = 2, its nearest anchor being its home. Two
fingerprints that are close on a segment meet at either's home, where their 64 bits are compared.

Links in an anchor leave as a spanning star of its classes, so a group of n near copies sends n rows
and not n². Equal fingerprints are one before all that.

* Null and empty texts have fingerprint zero, which links like any other. Fewer than four words are
  one shingle. Null doc_ids belong to components but name none. Repeated rows are equal rows.
* Empty tables give empty results. Other columns are ignored by ``classes``, kept by ``one_of_each``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, free_name, slices
from tidemark.llm.components import components
from tidemark.session import cut_lineage

WORDS = 4
DIFFER = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))
CHUNK = 400_000


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's 4-word shingles (XXH64, seed 42)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= WORDS:
        return xxhash.xxh64_intdigest(joined, 42)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[:n - WORDS] + 1).tolist()]
    ends = [*gaps[WORDS - 1:].tolist(), len(joined)]
    ones = np.zeros(64, np.int64)
    of = xxhash.xxh64_intdigest
    for i in range(0, len(starts), 1 << 15):
        part = slice(i, i + (1 << 15))
        hashes = np.array([of(joined[a:b], 42) for a, b in zip(starts[part], ends[part])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """``doc_id``, ``print`` (the fingerprint as a signed long) and the column ``row`` as ``row``, if asked for."""
    more = [F.col(row).cast("long").alias("row")] if row else []
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *more)
    names = ["doc_id", "print"] + ["row"] * len(more)

    def run(batches):
        for batch in slices(batches, "text"):
            made = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made), *batch.columns[2:]], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, print long" + ", row long" * len(more))


def _flips() -> list[np.ndarray]:
    """By syndrome: the flips of 15 bits that lead to a code word in two steps at most."""
    out = []
    for syndrome in range(16):
        one = [1 << (syndrome - 1)] if syndrome else [0]
        two = [1 << (p - 1) | 1 << ((p ^ syndrome) - 1) for p in range(1, 16) if p < p ^ syndrome and p != syndrome]
        out.append((one, two if syndrome else []))
    return out


def _masks(free: int) -> list[np.ndarray]:
    """By syndrome: what turns a segment with ``free`` uncoded bits into each anchor in reach, home first."""
    single = [1 << (15 + i) for i in range(free)]
    double = [a | b for i, a in enumerate(single) for b in single[:i]]
    out = []
    for syndrome, (one, two) in enumerate(_flips()):
        home = one[0]
        # On a code word the nearest anchor is 0 steps away and two free bits may flip, else one.
        more = [home | f for f in single] + ([] if syndrome else double) + two
        out.append(np.array([home, *more], np.int64))
    return out


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor keys, fingerprints and whether the anchor is the fingerprint's home."""
    keys, held, homes = [], [], []
    for k, (low, bits) in enumerate(SEGMENTS):
        part = (prints.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1)
        syndrome = np.zeros(len(part), np.int64)
        for p in range(1, 16):
            syndrome ^= np.where(part >> (p - 1) & 1, p, 0)
        for s, masks in enumerate(_masks(bits - 15)):
            at = np.flatnonzero(syndrome == s)
            if len(at):
                keys.append(((part[at, None] ^ masks) | k << 22).ravel())
                held.append(np.repeat(prints[at], len(masks)))
                homes.append(np.tile(np.arange(len(masks)) == 0, len(at)))
    return np.concatenate(keys), np.concatenate(held), np.concatenate(homes)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= DIFFER


def _stars(prints: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes among one anchor's fingerprints, each as (least, other)."""
    label = np.arange(len(prints))
    for h in np.flatnonzero(homes):
        met = np.unique(label[_near(prints, prints[h])])
        if len(met) > 1:
            label[np.isin(label, met[1:])] = met[0]
    other = np.flatnonzero(label != np.arange(len(prints)))
    return prints[label[other]], prints[other]


def _links(keys: np.ndarray, prints: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among whole anchors; rows come by anchor, homes first."""
    prints = prints.view(np.uint64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
    n_homes = np.add.reduceat(homes.astype(np.int64), first)
    linked = n_homes > 16
    for j in range(int(n_homes[~linked].max(initial=0))):  # all anchors' j-th home against all their rows
        here = np.flatnonzero((n_homes > j)[run] & ~linked[run])
        with_home = first[run[here]] + j
        hit = here[_near(prints[here], prints[with_home]) & (here != with_home)]
        linked[run[hit]] = True
    ends, out = np.r_[first[1:], len(keys)], ([], [])
    for r in np.flatnonzero(linked):
        u, v = _stars(prints[first[r]:ends[r]], homes[first[r]:ends[r]])
        out[0].append(u)
        out[1].append(v)
    join = lambda x: np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)
    return join(out[0]), join(out[1])


def links(prints: DataFrame) -> DataFrame:
    """``u, v``: links whose classes are those of all links among distinct ``print`` values."""
    def send(batches):
        for batch in batches:
            if batch.num_rows:
                keys, held, homes = anchors(batch.column("print").to_numpy())
                for i in range(0, len(keys), 100_000):
                    part = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[part].astype(np.int32)), pa.array(held[part]), pa.array(homes[part])],
                        ["anchor", "print", "home"])

    def compare(batches):
        kept = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)]
        waiting, held = [], 0

        def settle(last):
            rows = [np.concatenate([k, *(w[i] for w in waiting)]) for i, k in enumerate(kept)]
            whole = len(rows[0]) if last or not len(rows[0]) else int(np.searchsorted(rows[0], rows[0][-1]))
            kept[:] = [r[whole:] for r in rows]
            waiting.clear()
            return _links(*(r[:whole] for r in rows)) if whole else None

        for batch in batches:
            waiting.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            held += batch.num_rows
            if held >= max(CHUNK, len(kept[0])):
                if found := settle(False):
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), ["u", "v"])
                held = 0
        if found := settle(True):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), ["u", "v"])

    sent = prints.mapInArrow(send, "anchor int, print long, home boolean")
    return sent.repartition("anchor").sortWithinPartitions("anchor", F.col("home").desc(), "print").mapInArrow(
        compare, "u long, v long")


def _rooted(rows: DataFrame) -> DataFrame:
    """``print, least, root``: every fingerprint of ``rows``, its least doc_id and its component's least fingerprint."""
    distinct = cut_lineage(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    joined = components(links(distinct.select("print"))).withColumnRenamed("key", "print")
    return cut_lineage(distinct.join(joined, "print", "left").withColumn("root", F.coalesce("root", "print")))


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, print, component_id`` of every row."""
    rows = cut_lineage(fingerprints(df, doc_id, text))
    rooted = _rooted(rows)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return rows.join(named.select("print", "component_id"), "print").select("doc_id", "print", "component_id")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each component with the smallest doc_id (null last); of several such rows, the first."""
    number, gone = free_name(df, "near_row"), free_name(df, "near_gone")
    numbered = cut_lineage(df.withColumn(number, F.monotonically_increasing_id()))
    rows = cut_lineage(fingerprints(numbered, doc_id, text, number))
    found = cut_lineage(rows.join(_rooted(rows).select("print", "root"), "print").select("root", "doc_id", "row"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    stays = found.groupBy("root").agg(first.alias("first")).select("root", F.col("first.row").alias("stays"))
    dropped = found.join(stays, "root").where("row <> stays").select(F.col("row").alias(gone))
    return numbered.join(dropped, numbered[number] == dropped[gone], "left_anti").drop(number)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = classes(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
