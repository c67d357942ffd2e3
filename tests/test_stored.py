"""Tables kept in buckets and landed fills by day: what a pass reads, rewrites and leaves."""

import glob
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.sources import landed, stored

N = 2000


@pytest.fixture
def rows(spark):
    return spark.range(N).select(F.col("id").alias("k"), F.concat(F.lit("a"), F.col("id") % 7).alias("s"),
                                 (F.col("id") * 0.5).alias("v"), F.array("id").alias("batch_of"), F.lit(True).alias("is_open"),
                                 F.lit(2.0).alias("size"))


@pytest.fixture
def table(spark, tmp_path, rows):
    t = stored.Stored(f"{tmp_path}/t", rows.schema, ("k", "s"), 8)
    assert stored.upsert(t, rows) == list(range(8))
    return t


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def folders(table):
    return {p.split("/rows/")[1] for p in glob.glob(f"{table.path}/rows/batch=*/bucket=*")}


def content(spark, table):
    return {(r["k"], r["s"]): r for r in stored.read(spark, table).collect()}


def test_an_empty_table_reads_as_empty(spark, tmp_path, rows):
    t = stored.Stored(f"{tmp_path}/none", rows.schema, ("k", "s"), 4)
    assert stored.read(spark, t).count() == 0 and stored.read(spark, t).columns == rows.columns
    assert stored.upsert(t, rows.limit(0)) == [] and stored.retain(t, rows) == []


def test_a_small_pass_rewrites_the_buckets_it_falls_in(spark, table, rows):
    before = folders(table)
    few = rows.where("k in (3, 1500)").withColumns({"v": F.lit(-1.0)}).unionByName(
        spark.range(1).select(F.lit(N + 5).cast("long").alias("k"), F.lit("new").alias("s"), F.lit(9.0).alias("v")),
        allowMissingColumns=True)
    touched = stored.upsert(table, few)
    assert 1 <= len(touched) <= 3
    assert {p.split("bucket=")[1] for p in folders(table) - before} == {str(b) for b in touched}
    got = content(spark, table)
    assert len(got) == N + 1 and got[3, "a3"]["v"] == got[1500, f"a{1500 % 7}"]["v"] == -1.0
    assert got[4, "a4"]["v"] == 2.0 and got[N + 5, "new"]["size"] is None


def test_columns_that_a_pass_lacks_keep_their_value(spark, table, rows):
    stored.upsert(table, rows.where("k = 8").select("k", "s", F.lit(1.25).alias("v")))
    row = content(spark, table)[8, "a1"]
    assert (row["v"], row["batch_of"], row["size"]) == (1.25, [8], 2.0)


def test_equal_rows_are_not_written(spark, table, rows):
    version = stored._number(spark, table)
    assert stored.upsert(table, rows.withColumn("size", F.lit(7.0)), ["v", "batch_of"]) == []
    assert stored._number(spark, table) == version
    one = rows.withColumn("v", F.when(F.col("k") == 11, F.lit(None)).otherwise(F.col("v")))
    assert len(stored.upsert(table, one, ["v"])) == 1
    assert content(spark, table)[11, "a4"]["v"] is None and stored.upsert(table, one, ["v"]) == []


def test_new_keys_come_beside_the_old_and_full_buckets_are_rewritten(spark, table, rows, monkeypatch):
    monkeypatch.setattr(stored, "MOST_BATCHES", 3)
    for step in range(6):
        again = rows.where(f"k < {10 + step}").withColumn("v", F.lit(-5.0)).withColumn(
            "s", F.when(F.col("k") == 0, F.lit(f"step{step}")).otherwise(F.col("s")))
        assert len(stored.insert_ignore(table, again.unionByName(again))) == 1
        assert stored.insert_ignore(table, again) == []
    got = content(spark, table)
    assert len(got) == N + 6 and stored.read(spark, table).count() == N + 6
    assert got[1, "a1"]["v"] == 0.5 and got[0, "step5"]["v"] == -5.0
    version = stored._version(spark, table, stored._number(spark, table))
    assert max(map(len, version.values())) <= 3


def test_rows_not_produced_again_go(spark, table, rows):
    assert len(stored.retain(table, rows.where("k <> 77"))) == 1
    assert len(content(spark, table)) == N - 1
    assert stored.retain(table, rows) == []
    assert len(stored.retain(table, rows.limit(0))) == 8 and content(spark, table) == {}
    stored.upsert(table, rows.where("k = 1"))
    assert list(content(spark, table)) == [(1, "a1")]


def test_vanished_rows_close_once(spark, table, rows):
    assert len(stored.close_vanished(table, rows.where("k <> 5"))) == 1
    row = content(spark, table)[5, "a5"]
    assert (row["size"], row["is_open"], row["v"]) == (0.0, False, 2.5)
    assert stored.close_vanished(table, rows.where("k <> 5")) == []


def test_null_keys_fail_the_pass(spark, table, rows):
    with pytest.raises(Exception, match="null key: s"):
        stored.upsert(table, rows.where("k = 1").withColumn("s", F.lit(None).cast("string")))
    assert len(content(spark, table)) == N


def test_what_was_replaced_goes_a_pass_later(spark, table, rows):
    for v in range(5):
        earlier = stored.read(spark, table)
        stored.upsert(table, rows.withColumn("v", F.lit(float(v))))
        assert earlier.count() == N  # a reader that planned before the pass
    assert len(folders(table)) == 16
    assert len(glob.glob(f"{table.path}/versions/number=*")) <= 3


def test_a_pass_that_was_cut_short_leaves_nothing_that_is_read(spark, table, rows, monkeypatch):
    def cut(*_):
        raise RuntimeError("cut short")

    with monkeypatch.context() as m:
        m.setattr(stored, "_commit", cut)
        with pytest.raises(RuntimeError):
            stored.upsert(table, rows.withColumn("v", F.lit(-3.0)))
    assert content(spark, table)[4, "a4"]["v"] == 2.0
    stored.upsert(table, rows.withColumn("v", F.lit(-3.0)))
    assert stored.read(spark, table).where("v = -3").count() == N == stored.read(spark, table).count()


@pytest.mark.parametrize("how", ["full_outer", "left_anti", "left_semi"])
def test_the_stored_side_is_not_shuffled(spark, table, rows, no_broadcast, how):
    plan = stored.read(spark, table).join(rows.select("k", "s"), ["k", "s"], how)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    shuffled = plan[plan.index("Exchange hashpartitioning"):]
    assert "FileScan" not in shuffled and "FileScan" in plan


def fills(spark):
    return spark.range(2000).select(
        (F.col("id") % 40).alias("w"), F.when(F.col("id") % 100 != 99, F.col("id") * 3600).alias("ts"),
        F.col("id").cast("string").alias("key"), F.lit(1).alias("landed"))


def test_a_scan_from_marks_reads_the_days_past_them(spark, tmp_path):
    every = fills(spark)
    landed.store_activity(every, f"{tmp_path}/a", "w", "ts", 8)
    have = every.where("ts < 3600 * 1750")
    marks = landed.high_water(every, have, "w", "ts")
    want = {r["key"] for r in landed.new_activity(every, have, "w", "ts").collect()}
    got = landed.activity_since(spark, f"{tmp_path}/a", marks, "w", "ts", 8)
    assert sorted(got.columns) == sorted(every.columns)
    oldest = marks.agg(F.min("mark")).first()[0] // 86400
    passed = [p for p in glob.glob(f"{tmp_path}/a/landed_bucket=*/landed_day=*")
              if not p.split("landed_day=")[1].isdigit() or int(p.split("landed_day=")[1]) < oldest]
    assert len(passed) > 100
    for folder in passed:  # a scan that looked into them would fail
        shutil.rmtree(folder)
    assert {r["key"] for r in got.collect()} == want


def test_a_key_without_a_mark_gets_all_its_rows(spark, tmp_path):
    every = fills(spark)
    landed.store_activity(every, f"{tmp_path}/a", "w", "ts", 4, 10)
    have = every.where("w <> 7 and ts < 3600 * 1750")
    asked = every.where("w in (7, 8)").unionByName(every.limit(1).withColumn("w", F.lit(None).cast("long")))
    got = landed.activity_since(spark, f"{tmp_path}/a", landed.high_water(asked, have, "w", "ts"), "w", "ts", 4, 10)
    want = landed.new_activity(every, have, "w", "ts").where("w in (7, 8)")
    assert sorted(r["key"] for r in got.collect()) == sorted(r["key"] for r in want.collect())
    assert got.where("w = 7").count() == 50
    nobody = landed.high_water(every.limit(0), have, "w", "ts")
    assert landed.activity_since(spark, f"{tmp_path}/a", nobody, "w", "ts", 4, 10).count() == 0
