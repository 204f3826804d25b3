"""Queries on frames: transforms, filters, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframes.functions import scoring
from roadframes.operators import frames as fr
from roadframes.operators import metrics as mt
from roadframes.operators import summary
from roadframes.operators.sampling import batches
from roadframes.plans import standins as st
from roadframes.plans import twins as tw
from roadframes.plans.registry import query, r6, weighed
from roadframes.schemas import IMAGENET_MEAN, IMAGENET_STD

W = "CAST(list_sum(list_transform({0}, lambda v, i: v * i)) AS BIGINT)"
WF = "round(list_sum(list_transform({0}, lambda v, i: CAST(v AS DOUBLE) * i)), 3)"


def _shown(df: DataFrame, *extra) -> DataFrame:
    return df.select("frame_id", F.size("pixels").alias("n"), weighed().alias("checksum"), *extra)


# --- transforms --------------------------------------------------------------


@query(f"""WITH {tw.RGB},
h AS (SELECT frame_id, list_transform(range(192), lambda k: px[(k % 3) * 64 + k // 3 + 1]) AS px FROM rgb)
SELECT frame_id, CAST(len(px) AS INTEGER) AS n, {W.format('px')} AS checksum, 'HWC' AS layout FROM h""")
def to_hwc(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(fr.to_hwc(st.rgb_frames(spark, sf)), "layout")


@query(f"""WITH {tw.RGB}
SELECT frame_id, CAST(len(px) AS INTEGER) AS n, {W.format('px')} AS checksum, 'CHW' AS layout FROM rgb""")
def to_chw(spark: SparkSession, sf: str) -> DataFrame:
    """Channels first again after channels last: the frames as they were."""
    return _shown(fr.to_chw(fr.to_hwc(st.rgb_frames(spark, sf))), "layout")


@query(f"""WITH {tw.GRAY}, x AS (SELECT frame_id, flatten(list_transform(px, lambda v: [v, v, v])) AS px FROM gray)
SELECT frame_id, CAST(len(px) AS INTEGER) AS n, {W.format('px')} AS checksum, CAST(3 AS INTEGER) AS channels FROM x""")
def gray_to_rgb(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(fr.gray_to_rgb(st.gray_frames(spark, sf)), "channels")


@query(f"""WITH {tw.GRAY}, x AS (SELECT frame_id, list_transform(range(20), lambda k:
  px[(2 + k // 4) * 8 + 3 + k % 4 + 1]) AS px FROM gray)
SELECT frame_id, CAST(len(px) AS INTEGER) AS n, {W.format('px')} AS checksum, CAST(5 AS INTEGER) AS height,
  CAST(4 AS INTEGER) AS width FROM x""")
def crop(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = fr.crop_in_bounds(st.gray_frames(spark, sf), 3, 2, 4, 5)
    return _shown(fr.crop(kept, 3, 2, 4, 5), "height", "width")


@query(f"""WITH {tw.RGB}, h AS (SELECT frame_id, list_transform(range(192), lambda k: px[(k % 3) * 64 + k // 3 + 1]) AS px FROM rgb),
x AS (SELECT frame_id, list_transform(range(192), lambda k: CAST((CAST(px[k + 1] AS DOUBLE) / 255
  - {tw.MEAN}[k % 3 + 1]) / {tw.STD}[k % 3 + 1] AS FLOAT)) AS px FROM h)
SELECT frame_id, CAST(len(px) AS INTEGER) AS n, {WF.format('px')} AS checksum FROM x""")
def normalise(spark: SparkSession, sf: str) -> DataFrame:
    df = fr.normalise(fr.to_hwc(st.rgb_frames(spark, sf)))
    return df.select("frame_id", F.size("pixels").alias("n"), weighed(digits=3).alias("checksum"))


@query(f"""WITH {tw.GRAY}, {tw.bilinear(8, 12)}
SELECT frame_id, CAST(count(*) AS INTEGER) AS n, round(sum(CAST(CAST(v AS FLOAT) AS DOUBLE) * (k + 1)), 1) AS checksum FROM taps GROUP BY frame_id""")
def resize(spark: SparkSession, sf: str) -> DataFrame:
    df = fr.resize(st.gray_frames(spark, sf), 12)
    return df.select("frame_id", F.size("pixels").alias("n"), weighed(digits=1).alias("checksum"))


@query(f"""WITH {tw.RGB}, h AS (SELECT frame_id, list_transform(range(192), lambda k: px[(k % 3) * 64 + k // 3 + 1]) AS px FROM rgb),
c AS (SELECT frame_id, ch, list_transform(range(64), lambda k: px[k * 3 + ch + 1]) AS px FROM h, range(3) AS t(ch)),
gray AS (SELECT frame_id * 3 + ch AS frame_id, px FROM c), {tw.bilinear(8, 4)},
n AS (SELECT frame_id // 3 AS id, frame_id % 3 AS ch, k, CAST((CAST(CAST(v AS FLOAT) AS DOUBLE) / 255
  - {tw.MEAN}[frame_id % 3 + 1]) / {tw.STD}[frame_id % 3 + 1] AS FLOAT) AS v FROM taps)
SELECT id AS frame_id, 'CHW' AS layout, CAST(count(*) AS INTEGER) AS n,
  round(sum(CAST(v AS DOUBLE) * (ch * 16 + k + 1)), 2) AS checksum FROM n GROUP BY id""")
def to_tensor(spark: SparkSession, sf: str) -> DataFrame:
    df = fr.to_tensor(st.rgb_frames(spark, sf), 4)
    return df.select("frame_id", "layout", F.size("pixels").alias("n"), weighed(digits=2).alias("checksum"))


@query(f"""WITH {tw.TENSOR}, x AS (SELECT frame_id, list_transform(px, lambda v, i: CAST(greatest(0.0, least(1.0,
  CAST(v AS DOUBLE) * {tw.STD}[(i - 1) // 64 + 1] + {tw.MEAN}[(i - 1) // 64 + 1])) AS FLOAT)) AS px FROM tensor)
SELECT frame_id, CAST(len(px) AS INTEGER) AS n, {WF.format('px')} AS checksum,
  list_min(px) >= 0 AND list_max(px) <= 1 AS in_range FROM x""")
def denormalise(spark: SparkSession, sf: str) -> DataFrame:
    df = fr.value_range(fr.denormalise(st.tensor_frames(spark, sf)))
    return df.select(
        "frame_id", F.size("pixels").alias("n"), weighed(digits=3).alias("checksum"),
        ((F.col("min_value") >= 0) & (F.col("max_value") <= 1)).alias("in_range"))


@query(f"""WITH {tw.GRAY}, b AS (SELECT frame_id, px, list_min(px) AS lo, list_max(px) AS hi FROM gray),
x AS (SELECT frame_id, list_transform(px, lambda v: CAST(coalesce(CAST(v - lo AS DOUBLE) / nullif(hi - lo, 0), 0.0) AS FLOAT)) AS px FROM b)
SELECT frame_id, {WF.format('px')} AS checksum FROM x""")
def minmax_scale(spark: SparkSession, sf: str) -> DataFrame:
    return fr.minmax_scale(st.gray_frames(spark, sf)).select("frame_id", weighed(digits=3).alias("checksum"))


@query("""SELECT vec_id AS frame_id, CAST(len(embedding) AS INTEGER) AS n, CAST(3 AS INTEGER) AS dims,
  round(list_sum(list_transform(embedding, lambda v, i: CAST(v AS DOUBLE) * i)), 3) AS checksum FROM embeddings""")
def unbatch(spark: SparkSession, sf: str) -> DataFrame:
    """Values of shape [1, 1, 8, 8, 1] are unwrapped; [8, 8, 1] stay as they are."""
    df = st.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("embedding").alias("pixels"))
    deep = F.when(F.col("frame_id") % 2 == 0, F.array(*map(F.lit, (1, 1, 8, 8, 1)))).otherwise(
        F.array(*map(F.lit, (8, 8, 1))))
    return fr.unbatch(df.withColumn("shape", deep)).select(
        "frame_id", F.size("pixels").alias("n"), F.size("shape").alias("dims"), weighed(digits=3).alias("checksum"))


def _bytes_twin(values: str) -> str:
    return f"""WITH {tw.TENSOR}, b AS (SELECT frame_id, list_max(px) <= 1 AS unit, px FROM tensor),
t AS (SELECT frame_id, list_transform(px, lambda v: CAST(trunc(CASE WHEN unit THEN CAST(v AS DOUBLE) * 255 ELSE CAST(v AS DOUBLE) END) AS BIGINT)) AS px FROM b),
x AS (SELECT frame_id, list_transform(px, lambda v: {values}) AS px FROM t)
SELECT frame_id, {W.format('px')} AS checksum, CAST(list_min(px) AS INTEGER) AS low, CAST(list_max(px) AS INTEGER) AS high FROM x"""


def _bytes(df: DataFrame) -> DataFrame:
    return df.select(
        "frame_id", weighed().alias("checksum"), F.array_min("pixels").alias("low"), F.array_max("pixels").alias("high"))


@query(_bytes_twin("greatest(0, least(255, v))"))
def to_uint8(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised tensors hold negative values: they are clamped to 0."""
    return _bytes(fr.to_uint8(st.tensor_frames(spark, sf)))


@query(_bytes_twin("((v % 256) + 256) % 256"))
def to_uint8_wrap(spark: SparkSession, sf: str) -> DataFrame:
    return _bytes(fr.to_uint8(st.tensor_frames(spark, sf), overflow="wrap"))


@query(f"""WITH {tw.RGB}, {tw.LUMA} SELECT frame_id, CAST(len(px) AS INTEGER) AS n, {W.format('px')} AS checksum FROM luma""")
def gray(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(fr.gray(fr.to_uint8(fr.to_hwc(st.rgb_frames(spark, sf)))))


@query("SELECT CAST(0 AS INTEGER) AS label, count(*) AS n FROM embeddings GROUP BY 1")
def constant_label(spark: SparkSession, sf: str) -> DataFrame:
    return fr.constant_label(st.gray_frames(spark, sf)).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {tw.GRAY} SELECT source, CAST(CASE source WHEN 'src_a' THEN 0 ELSE 1 END AS INTEGER) AS label, count(*) AS n FROM gray GROUP BY 1, 2")
def label_by_source(spark: SparkSession, sf: str) -> DataFrame:
    df = fr.label_by_source(st.gray_frames(spark, sf), {"src_a": 0, "src_b": 1})
    return df.groupBy("source", "label").agg(F.count("*").alias("n"))


@query(tw.SCORED + """ SELECT frame_id, round(CAST(CAST(density AS FLOAT) AS DOUBLE), 6) AS density,
  round(CAST(CAST(congestion AS FLOAT) AS DOUBLE), 6) AS congestion, round(CAST(CAST(flow_rate AS FLOAT) AS DOUBLE), 6) AS flow_rate,
  CAST(traffic_level AS BIGINT) AS traffic_level, CAST(64 AS INTEGER) AS image_values FROM metrics""")
def model_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels and scores of each frame from one pass, in training types."""
    sample = fr.model_sample(mt.analyze(st.gray_frames(spark, sf), 100, keep_pixels=True))
    return sample.select(
        "frame_id", *[r6(F.col(c).cast("double"), c) for c in ("density", "congestion", "flow_rate")],
        "traffic_level", F.size("image").alias("image_values"))


@query(tw.SCORED + """ SELECT CASE traffic_level WHEN 0 THEN 'No traffic' WHEN 1 THEN 'Light traffic' WHEN 2 THEN 'Moderate traffic'
  WHEN 3 THEN 'Heavy traffic' ELSE 'Severe congestion' END AS name, count(*) AS n FROM metrics GROUP BY 1""")
def level_names(spark: SparkSession, sf: str) -> DataFrame:
    return st.scored(spark, sf).groupBy(scoring.level_name(F.col("traffic_level")).alias("name")).agg(F.count("*").alias("n"))


@query(f"WITH {tw.GRAY} SELECT frame_id, CAST(list_min(px) AS DOUBLE) AS min_value, CAST(list_max(px) AS DOUBLE) AS max_value FROM gray")
def value_range(spark: SparkSession, sf: str) -> DataFrame:
    return fr.value_range(st.gray_frames(spark, sf)).select(
        "frame_id", F.col("min_value").cast("double").alias("min_value"), F.col("max_value").cast("double").alias("max_value"))


@query("SELECT '3x8x8' AS shape, true AS consistent, count(*) AS n FROM embeddings GROUP BY 1, 2")
def frame_shape(spark: SparkSession, sf: str) -> DataFrame:
    df = fr.frame_shape(st.rgb_frames(spark, sf))
    return df.groupBy(F.concat_ws("x", F.col("shape").cast("array<string>")).alias("shape"), "consistent").agg(
        F.count("*").alias("n"))


# --- filters -----------------------------------------------------------------


def _uneven(df: DataFrame) -> DataFrame:
    """Frames whose stored width varies with the label, to give the bounds check work."""
    return df.withColumn("width", F.lit(4) + F.col("label") % 5)


@query(f"""WITH {tw.GRAY} SELECT CASE WHEN 6 <= 4 + label % 5 THEN 'kept' ELSE 'rejected' END AS outcome, count(*) AS n,
  min(frame_id) AS first_id FROM gray GROUP BY 1""")
def crop_in_bounds(spark: SparkSession, sf: str) -> DataFrame:
    kept, rejects = fr.crop_in_bounds(_uneven(st.gray_frames(spark, sf)), 2, 1, 4, 7)
    both = kept.withColumn("outcome", F.lit("kept")).unionByName(rejects.withColumn("outcome", F.lit("rejected")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"), F.min("frame_id").alias("first_id"))


def _damaged(df: DataFrame) -> DataFrame:
    """Break frames by label: no pixels, a missing value, a shape that does not fit."""
    px = F.col("pixels")
    return df.withColumn("pixels", (
        F.when(F.col("label") == 3, F.lit(None))
        .when(F.col("label") == 4, F.transform(px, lambda v: F.when(v > 120, v)))
        .when(F.col("label") == 7, F.slice(px, 1, 63))
        .otherwise(px)))


DAMAGED = f"""{tw.GRAY}, damaged AS (SELECT *, CASE WHEN label = 3 THEN 'no pixels' WHEN label = 7 THEN 'impossible shape'
  WHEN label = 4 AND list_min(px) <= 120 THEN 'value is not a number' END AS reason FROM gray)"""


@query(f"WITH {DAMAGED} SELECT coalesce(reason, 'kept') AS outcome, count(*) AS n FROM damaged GROUP BY 1")
def split_rejects(spark: SparkSession, sf: str) -> DataFrame:
    kept, rejects = fr.split_rejects(_damaged(st.gray_frames(spark, sf)))
    both = kept.select(F.lit("kept").alias("outcome")).unionByName(rejects.select(F.col("reason").alias("outcome")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {DAMAGED}, usable AS (SELECT frame_id, source, label, px FROM damaged WHERE reason IS NULL),
{tw.metrics('usable', 50)}
SELECT d.frame_id, d.reason IS NULL AS valid, CASE WHEN d.reason IS NULL THEN '' ELSE 'Failed to process image' END AS reason,
  round(coalesce(density, 0.0), 6) AS density, round(coalesce(congestion, 0.0), 6) AS congestion,
  round(coalesce(flow_rate, 0.0), 6) AS flow_rate, CAST(coalesce(traffic_level, 0) AS INTEGER) AS traffic_level
FROM damaged d LEFT JOIN metrics m USING (frame_id)""")
def analyze_damaged(spark: SparkSession, sf: str) -> DataFrame:
    """Frames that cannot be read stay, with zeros and a reason."""
    return mt.analyze(_damaged(st.gray_frames(spark, sf))).select(
        "frame_id", "valid", F.coalesce("reason", F.lit("")).alias("reason"), r6("density", "density"),
        r6("congestion", "congestion"), r6("flow_rate", "flow_rate"), "traffic_level")


@query(tw.SCORED + """ SELECT frame_id, label < 8 AS valid, CASE WHEN label < 8 THEN round(density, 6) ELSE 0.0 END AS density,
  CAST(CASE WHEN label < 8 THEN traffic_level ELSE 0 END AS INTEGER) AS traffic_level FROM metrics""")
def fill_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Scores that are missing become defaults; here those of two labels are missing."""
    df = st.scored(spark, sf)
    there = F.col("label") < 8
    holes = df.withColumns({c: F.when(there, F.col(c)) for c in ("density", "congestion", "flow_rate", "traffic_level", "valid")})
    return fr.fill_defaults(holes).select("frame_id", "valid", r6("density", "density"), "traffic_level")


@query(f"WITH {tw.CAPTURES} SELECT capture_id, path FROM captures WHERE path LIKE '/captures/click%' AND path LIKE '%.jpg'")
def name_filter(spark: SparkSession, sf: str) -> DataFrame:
    return fr.name_filter(st.captures(spark, sf), "/captures/click", ".jpg", name="path").select("capture_id", "path")


# --- scores ------------------------------------------------------------------


@query(f"""WITH RECURSIVE {tw.GRAY}, {tw.edges('gray', 50)}
SELECT frame_id, CAST(64 AS BIGINT) AS px, coalesce(edge_px, 0) AS edge_px FROM gray LEFT JOIN edge_px USING (frame_id)""")
def edge_count(spark: SparkSession, sf: str) -> DataFrame:
    return mt.edge_count(st.gray_frames(spark, sf), 50)


@query(f"""WITH RECURSIVE {tw.RGB}, {tw.LUMA}, {tw.metrics('luma', 100)}
SELECT frame_id, px_sum, px_sumsq, edge_px, round(edge_density, 6) AS edge_density, round(density, 6) AS density FROM metrics""")
def edge_density(spark: SparkSession, sf: str) -> DataFrame:
    """Three-channel frames, channels first."""
    counts = mt.frame_counts(st.rgb_frames(spark, sf), 100)
    return mt.density(mt.edge_density(counts)).select(
        "frame_id", "px_sum", "px_sumsq", "edge_px", r6("edge_density", "edge_density"), r6("density", "density"))


@query(tw.SCORED + " SELECT frame_id, round(congestion, 6) AS congestion FROM metrics")
def congestion(spark: SparkSession, sf: str) -> DataFrame:
    return mt.congestion(mt.frame_counts(st.gray_frames(spark, sf), 100)).select("frame_id", r6("congestion", "congestion"))


@query(tw.SCORED + " SELECT frame_id, round(0.8 * density + 1.3 * congestion, 6) AS traffic_score FROM metrics")
def traffic_score(spark: SparkSession, sf: str) -> DataFrame:
    params = mt.default_params(spark, density_weight=0.8, congestion_weight=1.3)
    scored = mt.traffic_score(mt.base_metrics(st.gray_frames(spark, sf), 100), params)
    return scored.select("frame_id", r6("traffic_score", "traffic_score"))


@query(f"SELECT o_orderkey, {tw.level('o_totalprice / 400000', ['0.9', '0.3', '0.5', '0.2'])} AS traffic_level FROM orders")
def traffic_level(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds out of order: the highest exceeded one counts, not the first gap."""
    thresholds = F.array(*map(F.lit, (0.9, 0.3, 0.5, 0.2)))
    return st.table(spark, sf, "orders").select(
        "o_orderkey", scoring.traffic_level(F.col("o_totalprice") / 400000, thresholds).alias("traffic_level"))


SCORES = """ SELECT frame_id, source, true AS valid, round(edge_density, 6) AS edge_density, round(density, 6) AS density,
  round(congestion, 6) AS congestion, round(traffic_score, 6) AS traffic_score, traffic_level FROM metrics"""


def _scores(df: DataFrame) -> DataFrame:
    return df.select(
        "frame_id", "source", "valid", *[r6(c, c) for c in ("edge_density", "density", "congestion", "traffic_score")],
        "traffic_level")


@query(f"WITH RECURSIVE {tw.GRAY}, {tw.metrics('gray', 50)}" + SCORES)
def analyze(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(mt.analyze(st.gray_frames(spark, sf)))


@query(f"WITH RECURSIVE {tw.RGB}, {tw.LUMA}, {tw.metrics('luma', 100)}" + SCORES)
def analyze_rgb(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(mt.analyze(st.rgb_frames(spark, sf), 100))


@query(f"""WITH RECURSIVE {tw.TENSOR}, d AS (SELECT frame_id, source, label, list_transform(px, lambda v, i:
  CAST(CAST(greatest(0.0, least(1.0, CAST(v AS DOUBLE) * {tw.STD}[(i - 1) // 64 + 1] + {tw.MEAN}[(i - 1) // 64 + 1])) AS FLOAT) AS DOUBLE)) AS px FROM tensor),
rgb AS (SELECT frame_id, source, label, list_transform(px, lambda v: CAST(trunc(v * 255) AS INTEGER)) AS px FROM d),
{tw.LUMA}, {tw.metrics('luma', 100)}""" + SCORES)
def analyze_tensors(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised tensors: denormalised and scored in one pass."""
    return _scores(mt.analyze(st.tensor_frames(spark, sf), 100, normal=(IMAGENET_MEAN, IMAGENET_STD)))


@query(f"""WITH {tw.GRAY} SELECT CAST(0.75 AS DOUBLE) AS density_weight, CAST(1 AS DOUBLE) AS congestion_weight,
  CAST(50 AS INTEGER) AS edge_threshold, round(avg(list_max(px)) / 100, 6) AS top_threshold,
  CAST(3 AS INTEGER) AS levels FROM gray""")
def update_params(spark: SparkSession, sf: str) -> DataFrame:
    """Some parameters replaced, one of them by a value found in the data; the rest kept."""
    params = mt.update_params(mt.default_params(spark), density_weight=0.75)
    found = st.gray_frames(spark, sf).agg(
        F.lit(None).cast("double").alias("density_weight"), F.lit(None).cast("double").alias("congestion_weight"),
        F.lit(None).cast("int").alias("edge_threshold"),
        F.array(F.lit(0.3), F.lit(0.6), F.avg(F.array_max("pixels").cast("double")) / 100).alias("thresholds"))
    return mt.merge_params(params, found).select(
        "density_weight", "congestion_weight", "edge_threshold",
        r6(F.array_max("thresholds"), "top_threshold"), F.size("thresholds").alias("levels"))


@query(tw.SCORED + f""", again AS (SELECT *, 0.5 * density + 2.0 * congestion AS s FROM metrics)
SELECT frame_id, round(s, 6) AS traffic_score, {tw.level('s', ['0.4', '0.9', '1.4', '1.9'])} AS traffic_level FROM again""")
def rescore(spark: SparkSession, sf: str) -> DataFrame:
    params = mt.default_params(spark, density_weight=0.5, congestion_weight=2.0, thresholds=[0.4, 0.9, 1.4, 1.9])
    return mt.rescore(st.scored(spark, sf), params).select("frame_id", r6("traffic_score", "traffic_score"), "traffic_level")


@query(tw.SCORED + " SELECT frame_id, CAST(64 AS INTEGER) AS values, round(density, 6) AS density, traffic_level FROM metrics")
def attach_params(spark: SparkSession, sf: str) -> DataFrame:
    joined = mt.attach_params(st.gray_frames(spark, sf), st.scored(spark, sf))
    return joined.select("frame_id", F.size("pixels").alias("values"), r6("density", "density"), "traffic_level")


@query(tw.SCORED + """ SELECT frame_id, CAST(1 AS DOUBLE) AS density_weight, CAST(50 AS INTEGER) AS edge_threshold,
  CAST(4 AS INTEGER) AS levels, traffic_level FROM metrics""")
def with_params(spark: SparkSession, sf: str) -> DataFrame:
    return mt.with_params(st.scored(spark, sf), mt.default_params(spark)).select(
        "frame_id", "density_weight", "edge_threshold", F.size("thresholds").alias("levels"), "traffic_level")


@query(tw.SCORED + """ SELECT CAST(l AS INTEGER) AS level, count(m.frame_id) AS rows
FROM (SELECT unnest(range(0, (SELECT max(traffic_level) + 1 FROM metrics))) AS l) LEFT JOIN metrics m ON m.traffic_level = l GROUP BY 1""")
def level_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summary.level_counts(st.scored(spark, sf))


# --- functions applied to batches ---------------------------------------------


@query(f"WITH {tw.GRAY} SELECT frame_id, CAST(list_max(px) - list_min(px) AS BIGINT) AS contrast FROM gray WHERE list_max(px) - list_min(px) > 60")
def map_frames(spark: SparkSession, sf: str) -> DataFrame:
    """A row map with drops: contrast of each frame, flat frames left out."""

    def contrast(batch):
        import numpy as np
        import pyarrow as pa

        px = batch.column("pixels")
        stack = px.flatten().to_numpy().reshape(batch.num_rows, -1)
        spread = (stack.max(axis=1) - stack.min(axis=1)).astype(np.int64)
        out = pa.RecordBatch.from_arrays([batch.column("frame_id"), pa.array(spread)], ["frame_id", "contrast"])
        return out.filter(pa.array(spread > 60))

    return fr.map_frames(st.gray_frames(spark, sf).select("frame_id", "pixels"), contrast, "frame_id bigint, contrast bigint")


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings)
SELECT CAST((rn - 1) // 32 AS BIGINT) AS batch_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS label_sum FROM r GROUP BY 1""")
def by_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A pandas function per batch of 32."""

    def total(pdf):
        import pandas as pd

        return pd.DataFrame({"batch_id": [pdf.batch_id.iloc[0]], "n": [len(pdf)], "label_sum": [int(pdf.label.sum())]})

    batched = batches(st.gray_frames(spark, sf).select("frame_id", "label"))
    return fr.by_batch(batched, total, "batch_id bigint, n bigint, label_sum bigint")
