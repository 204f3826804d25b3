"""Blocked running aggregates, ranks, splits and batches; one key holds most rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from roadframes.operators import running as rn
from roadframes.operators import sampling as sp
from roadframes.operators import summary as sm


@pytest.fixture(scope="module")
def rows(spark):
    """2,000 rows, two thirds of them under one key."""
    df = spark.range(2000).select(
        F.col("id"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("key"),
        F.xxhash64("id").alias("h"))
    return df.select(
        "*", (F.pmod("h", F.lit(1000))).alias("at"), (F.pmod(F.shiftright("h", 20), F.lit(21)) - 10).alias("v"),
        F.floor(F.pmod("h", F.lit(1000)) / 40).alias("block")).drop("h")


@pytest.mark.parametrize("exclusive", [False, True])
def test_running_equals_a_plain_window(rows, exclusive):
    values = {"s": ("sum", "v"), "n": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v")}
    got = rn.running(rows, ["key"], "block", ["at", "id"], values, exclusive)
    w = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    want = rows.select("*", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select(got.columns).collect()}


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_ranks_are_exact_for_any_partitioning(rows, parts):
    df = rows.repartition(parts)
    by_hash = rn.global_rank(df.select("id"), "id", seed=4).orderBy("rn").collect()
    assert [r.rn for r in by_hash] == list(range(1, 2001)) and {r.id for r in by_hash} == set(range(2000))
    again = rn.global_rank(rows.select("id"), "id", seed=4).orderBy("rn").collect()
    assert by_hash == again
    # ordered by a column with one hot value first, made unique by the id
    ordered = rn.ordered_rank(df.select("key", "id"), ["key", "id"]).orderBy("rn").collect()
    assert [(r.key, r.id) for r in ordered] == sorted((r.key, r.id) for r in rows.collect())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 2000])
def test_split_sizes_and_completeness(rows, n):
    df = rows.limit(n).select(F.col("id").alias("frame_id"))
    split = sp.split_exact(df)
    sizes = {r.split: r.rows for r in sm.split_sizes(split).collect()}
    train, val = n * 70 // 100, n * 15 // 100
    want = {"train": train, "val": val, "test": n - train - val}
    assert sizes == {k: v for k, v in want.items() if v}
    assert split.select("frame_id").distinct().count() == n


def test_splits_change_with_the_seed_and_keep_columns(rows):
    df = rows.withColumnRenamed("id", "frame_id")
    a, b = sp.split_exact(df, seed=1), sp.split_exact(df, seed=2)
    assert a.columns == [*df.columns, "split"]
    assert a.where("split = 'train'").join(b.where("split = 'train'"), "frame_id").count() < 1200


def test_split_by_source(rows):
    df = rows.select(F.col("id").alias("frame_id"), F.col("key").alias("source"))
    one = df.limit(0).union(df.limit(1).select("frame_id", F.lit("lonely")))
    whole = df.union(one.select(F.col("frame_id") + 5000, "source"))
    sizes = {(r.source, r.split): r["count"] for r in sp.split_by_source(whole).groupBy("source", "split").count().collect()}
    for source, n in [(r.source, r["count"]) for r in whole.groupBy("source").count().collect()]:
        held = -(-n * 30 // 100)
        test = -(-held // 2)
        want = {"train": n - held, "val": held - test, "test": test}
        assert {k: sizes.get((source, k), 0) for k in want} == want


@pytest.mark.parametrize("n,want", [(0, 2000), (None, 2000), (1, 1), (500, 500), (5000, 2000)])
def test_subset(rows, n, want):
    df = rows.withColumnRenamed("id", "frame_id")
    got = sp.subset(df, n, seed=9)
    assert got.columns == df.columns and got.count() == got.select("frame_id").distinct().count() == want


def test_labels_and_filters_move_no_wide_rows(rows):
    """Above the scan of the wide rows there is a filter or projection, no join and no shuffle."""
    df = rows.withColumnRenamed("id", "frame_id")
    for out in (sp.subset(df, 10), sp.split_exact(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        own = [line for line in plan.splitlines() if not line.lstrip().startswith(":")]
        before_scan = "\n".join(own).split("Subquery")[0]
        assert "Subquery" in plan and "Join" not in before_scan and "Exchange" not in before_scan


def test_groups_and_batches(rows):
    df = rows.select(F.col("id").alias("frame_id"), "v")
    groups = sp.assign_group(df, 300).groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("frame_id").alias("a")).orderBy("chunk_id").collect()
    assert [r.n for r in groups] == [300] * 6 + [200] and [r.a for r in groups] == [300 * i for i in range(7)]
    shuffled = sp.batches(df, 32, shuffle_seed=3).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in shuffled) == [16] + [32] * 62


def test_small_side_keeps_rows_beyond_its_bound(rows):
    few = rows.groupBy("key").agg(F.count("*").alias("n"))
    for bound in (1, 1000):
        joined = rows.join(rn.small_side(few, "few", bound), "key")
        assert joined.count() == 2000


def test_histogram_counts_all_rows(spark, rows):
    got = sm.histogram(rows, "v").collect()
    assert len(got) == 30 and sum(r.rows for r in got) == 2000
    assert abs(got[0].bin_start + 10) < 1e-9
    holes = spark.createDataFrame([(None,), (1.0,), (2.0,)], "v double")
    assert sum(r.rows for r in sm.histogram(holes, "v").collect()) == 2
    assert sm.histogram(holes.where("v is null"), "v").count() == 0


def test_level_counts_are_dense(spark):
    df = spark.createDataFrame([(0,), (3,), (3,)], "traffic_level int")
    assert [(r.level, r.rows) for r in sm.level_counts(df).orderBy("level").collect()] == [(0, 1), (1, 0), (2, 0), (3, 2)]
    assert sm.level_counts(df.limit(0)).count() == 0


def test_improvements_and_best(spark):
    accs = [0.0, 50.0, 40.0, 50.0, 60.0]
    runs = spark.createDataFrame([("r", i, a) for i, a in enumerate(accs)] + [("z", 0, 0.0)], "run string, epoch int, val_acc double")
    got = sm.improvements(runs, epochs_per_block=2).where("run = 'r'").orderBy("epoch").collect()
    assert [r.improved for r in got] == [False, True, False, False, True]
    assert [tuple(r) for r in sm.best_run(runs).collect()] == [("r", 4, 60.0)]


def test_capture_gaps_by_hand(spark):
    df = spark.sql("""SELECT * FROM VALUES
      ('a', TIMESTAMP_NTZ'2024-01-01 00:01:00'), ('a', TIMESTAMP_NTZ'2024-01-01 00:50:00'), ('b', TIMESTAMP_NTZ'2024-01-01 09:00:00')
      AS t(camera, captured_at)""")
    gaps = sm.capture_gaps(df).orderBy("slot").collect()
    assert [(r.camera, str(r.slot)[11:16]) for r in gaps] == [("a", "00:15"), ("a", "00:30")]


def test_losses(spark):
    df = spark.createDataFrame([([1000.0, 0.0], 0), ([0.0, 0.0], 1)], "scores array<double>, label int")
    assert abs(sm.cross_entropy(df).first().cross_entropy - 0.5 * 0.6931471805599453) < 1e-12
    assert [r[0] for r in df.select(sm.argmax_prediction(F.col("scores"))).collect()] == [0, 0]
