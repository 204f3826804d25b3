"""Queries on samples, splits, joins, counts, histograms and training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframes.operators import checks, sampling, summary
from roadframes.operators.running import global_rank as rank_all
from roadframes.operators.running import ordered_rank as rank_in_order
from roadframes.plans import standins as st
from roadframes.plans import twins as tw
from roadframes.plans.registry import query, r6
from roadframes.sources.frames import concat_sources as union_sources

HASHED = "hashed AS (SELECT *, md5('{seed}|' || {key}) AS h FROM {src})"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return st.table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame_id"), "o_orderpriority", "o_orderdate")


# --- order, subsets, splits, batches -----------------------------------------


@query(f"WITH {tw.CAPTURES} SELECT path, capture_id, row_number() OVER (ORDER BY path, capture_id) AS rn FROM captures")
def order_by_path(spark: SparkSession, sf: str) -> DataFrame:
    """Captures numbered in path order; many share a path's leading text."""
    return rank_in_order(st.captures(spark, sf).select("path", "capture_id"), ["path", "capture_id"])


@query(f"WITH {tw.CAPTURES} SELECT path, capture_id FROM captures ORDER BY path")
def sorted_captures(spark: SparkSession, sf: str) -> DataFrame:
    """The plain sorted listing."""
    return sampling.order_by_path(st.captures(spark, sf), "path").select("path", "capture_id")


@query("SELECT o_orderkey AS frame_id, row_number() OVER (ORDER BY md5('7|' || o_orderkey), o_orderkey) AS rn FROM orders")
def global_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rank_all(_orders(spark, sf).select("frame_id"), "frame_id", seed=7)


LINE_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"SELECT {LINE_KEY}, row_number() OVER (ORDER BY {LINE_KEY}) AS rn FROM lineitem")
def ordered_rank(spark: SparkSession, sf: str) -> DataFrame:
    order = LINE_KEY.split(", ")
    return rank_in_order(st.table(spark, sf, "lineitem").select(*order), order)


@query("""SELECT o_orderkey AS frame_id, o_orderdate FROM orders
QUALIFY row_number() OVER (ORDER BY md5('3|' || o_orderkey), o_orderkey) <= 1000""")
def subset(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.subset(_orders(spark, sf), 1000, seed=3).select("frame_id", "o_orderdate")


@query("SELECT o_orderkey AS frame_id FROM orders QUALIFY row_number() OVER (ORDER BY md5('5|' || o_orderkey), o_orderkey) <= 5")
def sample_k(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_k(_orders(spark, sf).select("frame_id"), 5, seed=5)


@query("SELECT vec_id AS frame_id, label FROM embeddings ORDER BY vec_id LIMIT 1")
def first_k(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.first_k(st.gray_frames(spark, sf)).select("frame_id", "label")


@query(tw.SCORED + """ SELECT frame_id, traffic_level, round(density, 6) AS density, round(congestion, 6) AS congestion,
  printf('Level: %d, Density: %.2f, Cong: %.2f', traffic_level, density, congestion) AS title
FROM metrics ORDER BY frame_id LIMIT 12""")
def sample_grid(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_grid(st.scored(spark, sf)).select(
        "frame_id", "traffic_level", r6("density", "density"), r6("congestion", "congestion"), "title")


SPLIT = """ranked AS (SELECT *, row_number() OVER (ORDER BY md5('0|' || {key}), {key}) AS rn, count(*) OVER () AS n FROM {src}),
split AS (SELECT *, CASE WHEN rn <= n * 70 // 100 THEN 'train' WHEN rn <= n * 70 // 100 + n * 15 // 100 THEN 'val' ELSE 'test' END AS split FROM ranked)"""


@query("WITH " + SPLIT.format(key="o_orderkey", src="orders") + " SELECT o_orderkey AS frame_id, split FROM split")
def split_exact(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split_exact(_orders(spark, sf)).select("frame_id", "split")


@query("WITH " + SPLIT.format(key="o_orderkey", src="orders") + " SELECT split, count(*) AS rows FROM split GROUP BY split")
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return summary.split_sizes(sampling.split_exact(_orders(spark, sf)))


@query("""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('0|' || doc_id), doc_id) AS rn,
  count(*) OVER (PARTITION BY source) AS n FROM documents),
sized AS (SELECT *, (n * 30 + 99) // 100 AS held FROM ranked)
SELECT doc_id, source, CASE WHEN rn <= n - held THEN 'train' WHEN rn <= n - (held + 1) // 2 THEN 'val' ELSE 'test' END AS split FROM sized""")
def split_by_source(spark: SparkSession, sf: str) -> DataFrame:
    docs = st.table(spark, sf, "documents").select("doc_id", "source")
    return sampling.split_by_source(docs, key="doc_id")


@query("""WITH ranked AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)
SELECT o_orderkey AS frame_id, CAST((rn - 1) // 5000 AS BIGINT) AS chunk_id FROM ranked""")
def assign_group(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.assign_group(_orders(spark, sf).select("frame_id"), 5000).drop("rn")


@query("""WITH ranked AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('11|' || o_orderkey), o_orderkey) AS rn FROM orders)
SELECT CAST((rn - 1) // 32 AS BIGINT) AS batch_id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS id_sum FROM ranked GROUP BY 1""")
def batches_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.batches(_orders(spark, sf).select("frame_id"), 32, shuffle_seed=11).groupBy("batch_id").agg(
        F.count("*").alias("n"), F.sum("frame_id").alias("id_sum"))


@query("""WITH ranked AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)
SELECT CAST((rn - 1) // 32 AS BIGINT) AS batch_id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS id_sum FROM ranked GROUP BY 1""")
def batches_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.batches(_orders(spark, sf).select("frame_id"), 32).groupBy("batch_id").agg(
        F.count("*").alias("n"), F.sum("frame_id").alias("id_sum"))


@query("""WITH ranked AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings)
SELECT CAST((rn - 1) // 32 AS BIGINT) AS batch_id, string_agg(vec_id, ',' ORDER BY vec_id) AS frame_ids,
  string_agg(label, ',' ORDER BY vec_id) AS labels FROM ranked GROUP BY 1""")
def collate(spark: SparkSession, sf: str) -> DataFrame:
    batched = summary.collate(sampling.batches(st.gray_frames(spark, sf).select("frame_id", "label")))
    return batched.withColumns({
        c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("frame_ids", "labels")})


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def select_ids(spark: SparkSession, sf: str) -> DataFrame:
    good = st.table(spark, sf, "labels").where("quality = 1")
    return sampling.select_ids(st.table(spark, sf, "documents").select("doc_id", "source"), good, "doc_id")


@query("WITH " + SPLIT.format(key="o_orderkey", src="orders") + """ SELECT 'splits' AS name,
  count(*) = count(DISTINCT o_orderkey) AND count(*) = (SELECT count(*) FROM orders) AS passed,
  '0 repeated, 0 missing, 0 unknown' AS detail FROM split""")
def verify_splits(spark: SparkSession, sf: str) -> DataFrame:
    whole = _orders(spark, sf)
    return checks.verify_splits(sampling.split_exact(whole), whole)


@query(f"""WITH {tw.TENSOR}, f AS (SELECT count(*) AS n, min(list_min(px)) AS lo, max(list_max(px)) AS hi FROM tensor)
SELECT unnest(['tensors', 'size', 'shape', 'range']) AS name, true AS passed, unnest([
  'frame_id: bigint, source: string, height: int, width: int, channels: int, layout: string, pixels: array<float>, label: int',
  printf('%d frames', n), '3x8x8 to 3x8x8, 0 misshapen', printf('[%.3f, %.3f], 0 unreadable', lo, hi)]) AS detail FROM f""")
def verify_frames(spark: SparkSession, sf: str) -> DataFrame:
    return checks.verify_frames(st.tensor_frames(spark, sf), (3, 8, 8))


@query("""SELECT unnest(['tensors', 'size']) AS name, unnest([false, true]) AS passed,
  unnest(['frame_id: bigint, image_url: array<float>', printf('%d frames', count(*))]) AS detail FROM embeddings""")
def verify_raw(spark: SparkSession, sf: str) -> DataFrame:
    """A dataset that still holds raw images fails its check."""
    raw = st.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("frame_id"), F.col("embedding").alias("image_url"))
    return checks.verify_frames(raw)


@query(f"""WITH {tw.TENSOR} SELECT count(*) AS frames, round(CAST(min(list_min(px)) AS DOUBLE), 6) AS min_value,
  round(CAST(max(list_max(px)) AS DOUBLE), 6) AS max_value, CAST(1 AS BIGINT) AS shapes FROM tensor""")
def range_and_shape(spark: SparkSession, sf: str) -> DataFrame:
    found = summary.range_and_shape(st.tensor_frames(spark, sf))
    return found.withColumns({c: r6(F.col(c).cast("double")) for c in ("min_value", "max_value")})


# --- sets --------------------------------------------------------------------


@query(f"""WITH {tw.GRAY} SELECT source, CAST(CASE source WHEN 'src_a' THEN 0 ELSE 1 END AS INTEGER) AS label,
  count(*) AS n, CAST(sum(frame_id) AS BIGINT) AS ids FROM gray GROUP BY 1, 2""")
def concat_sources(spark: SparkSession, sf: str) -> DataFrame:
    df = st.gray_frames(spark, sf)
    both = union_sources(
        {name: df.where(F.col("source") == name) for name in ("src_a", "src_b")}, {"src_a": 0, "src_b": 1})
    return both.groupBy("source", "label").agg(F.count("*").alias("n"), F.sum("frame_id").alias("ids"))


# --- histograms and counts -----------------------------------------------------


def _histogram(src: str, value: str, tag: str = "") -> str:
    """CTEs up to ``h``; ``tag`` tells several histograms in one statement apart."""
    b, w, c, h = (name + tag for name in "bwch")
    return f"""{b} AS (SELECT CAST(min({value}) AS DOUBLE) AS lo, CAST(max({value}) AS DOUBLE) AS hi FROM {src}),
{w} AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM {b}),
{c} AS (SELECT CAST(least(29, floor(({value} - lo) / (hi - lo) * 30)) AS INTEGER) AS bin, count(*) AS n FROM {src}, {w} GROUP BY 1),
{h} AS (SELECT CAST(k AS INTEGER) AS bin, round(lo + k * ((hi - lo) / 30), 6) AS bin_start,
  round(lo + (k + 1) * ((hi - lo) / 30), 6) AS bin_end, coalesce(n, 0) AS rows
  FROM {w}, range(30) AS t(k) LEFT JOIN {c} ON {c}.bin = t.k)"""


def _bins(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "bin", r6("bin_start", "bin_start"), r6("bin_end", "bin_end"), "rows")


@query("WITH " + _histogram("lineitem", "l_extendedprice") + " SELECT * FROM h")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _bins(summary.histogram(st.table(spark, sf, "lineitem"), "l_extendedprice"))


@query("WITH flat AS (SELECT 3.0::DOUBLE AS v FROM orders), " + _histogram("flat", "v") + " SELECT * FROM h")
def histogram_constant(spark: SparkSession, sf: str) -> DataFrame:
    """All values equal: the range is widened by a half on both sides."""
    return _bins(summary.histogram(st.table(spark, sf, "orders").select(F.lit(3.0).alias("v")), "v"))


EACH = ", ".join(_histogram("metrics", m, f"_{i}") for i, m in enumerate(summary.METRICS))
ALL = " UNION ALL ".join(f"SELECT '{m}' AS metric, * FROM h_{i}" for i, m in enumerate(summary.METRICS))


@query(f"{tw.SCORED}, {EACH} {ALL}")
def distributions(spark: SparkSession, sf: str) -> DataFrame:
    return _bins(summary.distributions(st.stored_scores(spark, sf)), "metric")


@query(tw.SCORED + """, b AS (SELECT min(density) AS lo, max(density) AS hi FROM metrics)
SELECT frame_id, round(lo, 6) AS lo, round(hi, 6) AS hi FROM metrics, b""")
def with_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return summary.with_bounds(st.stored_scores(spark, sf), "density").select("frame_id", r6("lo", "lo"), r6("hi", "hi"))


@query("""SELECT o_custkey // 50 AS batch_id, count(*) FILTER (o_orderstatus <> 'F') AS successful,
  count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY 1""")
def batch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    items = st.table(spark, sf, "orders").select(
        F.floor(F.col("o_custkey") / 50).alias("batch_id"), (F.col("o_orderstatus") != "F").alias("valid"))
    return summary.batch_outcomes(items)


@query(f"""WITH j AS (SELECT event_type AS job, count(*) AS attempted, count(*) FILTER ({tw.K} >= 5) AS processed,
  epoch(max(ts)) - epoch(min(ts)) AS s FROM events GROUP BY 1)
SELECT job, attempted, processed, round(processed * 100.0 / attempted, 6) AS success_rate, round(s / 3600, 6) AS hours,
  round(processed / s, 6) AS per_second FROM j""")
def job_rates(spark: SparkSession, sf: str) -> DataFrame:
    log = st.table(spark, sf, "events").select(F.col("event_type").alias("job"), F.col("ts").alias("at"), (st.k() >= 5).alias("ok"))
    return summary.job_rates(log).select(
        "job", "attempted", "processed", *[r6(c, c) for c in ("success_rate", "hours", "per_second")])


@query(f"""WITH {tw.CAPTURES}, seen AS (SELECT DISTINCT camera, {tw.SLOT.format('captured_at')} AS slot FROM captures),
span AS (SELECT camera, min(slot) AS a, max(slot) AS b FROM seen GROUP BY camera),
expected AS (SELECT camera, unnest(generate_series(a, b, INTERVAL '15 minutes')) AS slot FROM span)
SELECT camera, slot FROM expected ANTI JOIN seen USING (camera, slot)""")
def capture_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return summary.capture_gaps(st.captures(spark, sf))


# --- training runs -------------------------------------------------------------


@query(f"""WITH {tw.RUN}, b AS (SELECT epoch, batch_id, avg(loss) AS l, count(*) AS n, count(*) FILTER (prediction = label) AS c FROM run GROUP BY 1, 2)
SELECT epoch, round(avg(l), 6) AS loss, round(sum(c) * 100.0 / sum(n), 6) AS accuracy FROM b GROUP BY epoch""")
def epoch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return summary.epoch_metrics(st.run_log(spark, sf)).select("epoch", r6("loss", "loss"), r6("accuracy", "accuracy"))


@query(f"""WITH {tw.RUN} SELECT seq, epoch,
  round(sum(loss) OVER w / count(*) OVER w, 10) AS running_loss,
  round(count(CASE WHEN prediction = label THEN 1 END) OVER w * 100.0 / count(*) OVER w, 6) AS running_accuracy
FROM run WINDOW w AS (PARTITION BY epoch ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)""")
def running_metrics(spark: SparkSession, sf: str) -> DataFrame:
    run = st.run_log(spark, sf).select(
        "epoch", "batch_id", "ts", "seq", "loss", (F.col("prediction") == F.col("label")).cast("int").alias("correct"),
        F.lit(1).alias("total"))
    scanned = summary.running_metrics(run, ["ts", "seq"], "batch_id")
    return scanned.select("seq", "epoch", F.round("running_loss", 10).alias("running_loss"), r6("running_accuracy", "running_accuracy"))


RUNS = f"""{tw.RUN}, runs AS (SELECT run, epoch, count(*) FILTER (prediction = label) * 100.0 / count(*) AS val_acc FROM run GROUP BY 1, 2)"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return st.run_log(spark, sf).groupBy("run", "epoch").agg(
        (F.count_if(F.col("prediction") == F.col("label")) * 100.0 / F.count("*")).alias("val_acc"))


@query(f"""WITH {RUNS}, b AS (SELECT *, coalesce(max(val_acc) OVER (PARTITION BY run ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS best_before FROM runs)
SELECT run, epoch, round(val_acc, 6) AS val_acc, round(best_before, 6) AS best_before, val_acc > best_before AS improved FROM b""")
def improvements(spark: SparkSession, sf: str) -> DataFrame:
    return summary.improvements(_runs(spark, sf)).select(
        "run", "epoch", r6("val_acc", "val_acc"), r6("best_before", "best_before"), "improved")


@query(f"""WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_acc DESC, epoch) AS rn FROM runs WHERE val_acc > 0)
SELECT run, epoch, round(val_acc, 6) AS val_acc FROM r WHERE rn = 1""")
def best_run(spark: SparkSession, sf: str) -> DataFrame:
    return summary.best_run(_runs(spark, sf)).select("run", "epoch", r6("val_acc", "val_acc"))


def _score_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Two fixed class scores per labelled document, from its length and its id."""
    docs = st.table(spark, sf, "documents").select("doc_id", "n_chars")
    joined = docs.join(st.table(spark, sf, "labels"), "doc_id")
    return joined.select(
        "doc_id", F.array((F.col("doc_id") % 7) / 7.0, F.ln(F.col("n_chars") + 1) / 9.0).alias("scores"),
        F.col("quality").alias("label"))


SCORE_ROWS = """rows AS (SELECT doc_id, (doc_id % 7) / 7.0::DOUBLE AS s0, ln(n_chars + 1) / 9.0::DOUBLE AS s1, quality AS label
  FROM documents JOIN labels USING (doc_id))"""


@query(f"WITH {SCORE_ROWS} SELECT round(avg(ln(exp(s0) + exp(s1)) - CASE label WHEN 0 THEN s0 ELSE s1 END), 6) AS cross_entropy, count(*) AS rows FROM rows")
def cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return summary.cross_entropy(_score_rows(spark, sf)).select(r6("cross_entropy", "cross_entropy"), "rows")


@query(f"""WITH {SCORE_ROWS} SELECT CAST(CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS INTEGER) AS prediction, label, count(*) AS n FROM rows GROUP BY 1, 2""")
def argmax_prediction(spark: SparkSession, sf: str) -> DataFrame:
    return _score_rows(spark, sf).groupBy(summary.argmax_prediction(F.col("scores")).alias("prediction"), "label").agg(
        F.count("*").alias("n"))


@query(tw.SCORED + """ SELECT round(avg((density - label / 9.0) * (density - label / 9.0)), 6) AS density,
  round(avg((congestion - label / 9.0) * (congestion - label / 9.0)), 6) AS congestion,
  round(avg((flow_rate - label / 9.0) * (flow_rate - label / 9.0)), 6) AS flow_rate FROM metrics""")
def squared_error(spark: SparkSession, sf: str) -> DataFrame:
    df = st.scored(spark, sf).withColumn("target", F.col("label") / 9.0)
    names = ("density", "congestion", "flow_rate")
    return summary.squared_error(df, {n: (n, "target") for n in names}).select(*[r6(n, n) for n in names])
