"""Queries that write what they derive from the tables, and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframes.functions.names import capture_name
from roadframes.functions.names import parse_capture_name as parsed_name
from roadframes.operators import checks
from roadframes.operators import feedback as fb
from roadframes.operators import frames as fr
from roadframes.operators import metrics as mt
from roadframes.plans import feedback_queries as fq
from roadframes.plans import jobs
from roadframes.plans import standins as st
from roadframes.plans import twins as tw
from roadframes.plans.registry import query, r6, weighed
from roadframes.session import scratch_path
from roadframes.sources import chunks
from roadframes.sources import feedback as fs
from roadframes.sources import frames as store
from roadframes.sources import skipping
from roadframes.sources import images as im
from roadframes.sources.files import write_files

W = "CAST(list_sum(list_transform({0}, lambda v, i: v * i)) AS BIGINT)"


def image_folder(spark: SparkSession, sf: str) -> str:
    """Every gray frame as a PNG file; frames with label 9 as a file that is no image."""
    folder = scratch_path(spark, "images")
    df = st.gray_frames(spark, sf)
    name = F.format_string("cam_%07d.png", "frame_id")
    im.write_image_files(df.where("label <> 9").withColumn("name", name), folder)
    junk = df.where("label = 9").select(
        F.format_string("bad_%07d.png", "frame_id").alias("name"), F.lit("not an image").cast("binary").alias("content"))
    write_files(junk, folder)
    return folder


def _id_in_name(path):
    return F.regexp_extract(path, r"_(\d+)[.]png$", 1).cast("bigint")


@query(f"""WITH {tw.GRAY}, x AS (SELECT frame_id, flatten(list_transform(px, lambda v: [v, v, v])) AS px FROM gray WHERE label <> 9)
SELECT frame_id, CAST(8 AS INTEGER) AS height, CAST(8 AS INTEGER) AS width, CAST(1 AS INTEGER) AS stored_channels,
  {W.format('px')} AS checksum FROM x""")
def scan_images(spark: SparkSession, sf: str) -> DataFrame:
    """Image files decoded, made R, G, B; files that are no images are left out."""
    images = im.scan_images(spark, image_folder(spark, sf), drop_invalid=True)
    rgb = fr.to_rgb(images.withColumn("stored_channels", F.col("image.nChannels")))
    return rgb.select(
        _id_in_name("origin").alias("frame_id"), "height", "width", "stored_channels", weighed().alias("checksum"))


@query(f"""WITH {tw.RGB}, h AS (SELECT frame_id, list_transform(range(192), lambda k: px[(k % 3) * 64 + k // 3 + 1]) AS px FROM rgb)
SELECT frame_id, CAST(3 AS INTEGER) AS channels, 'HWC' AS layout, {W.format('px')} AS checksum FROM h""")
def to_rgb(spark: SparkSession, sf: str) -> DataFrame:
    """Colour images through files: red first again, though images are stored blue first."""
    folder = scratch_path(spark, "colour")
    df = fr.to_hwc(st.rgb_frames(spark, sf)).withColumn("name", F.format_string("cam_%07d.png", "frame_id"))
    im.write_image_files(df, folder)
    return fr.to_rgb(im.scan_images(spark, folder)).select(
        _id_in_name("origin").alias("frame_id"), "channels", "layout", weighed().alias("checksum"))


@query("""SELECT vec_id AS frame_id, 'cannot decode image' AS reason FROM embeddings WHERE label = 9""")
def image_rejects(spark: SparkSession, sf: str) -> DataFrame:
    _, rejects = im.image_rejects(im.scan_images(spark, image_folder(spark, sf)))
    return rejects.select(_id_in_name("origin").alias("frame_id"), "reason")


@query(f"""WITH RECURSIVE {tw.GRAY}, good AS (SELECT frame_id, source, label, px FROM gray WHERE label <> 9), {tw.metrics('good', 100)}
SELECT frame_id, round(density, 6) AS density, round(congestion, 6) AS congestion, traffic_level FROM metrics""")
def score_image_folder(spark: SparkSession, sf: str) -> DataFrame:
    """From files to scores: scan, make R, G, B, score."""
    images, _ = im.image_rejects(im.scan_images(spark, image_folder(spark, sf)))
    frames = fr.to_rgb(images).withColumn("frame_id", _id_in_name("origin"))
    return mt.analyze(frames, 100).select("frame_id", r6("density", "density"), r6("congestion", "congestion"), "traffic_level")


@query(f"""WITH {tw.GRAY_ALL}, gray AS (SELECT * FROM gray_all WHERE label <> 9), {tw.bilinear(8, 4)},
n AS (SELECT unnest({tw.MEAN}) AS mean, unnest({tw.STD}) AS std),
v AS (SELECT CAST((v / 255 - mean) / std AS FLOAT) AS v FROM taps, n),
f AS (SELECT count(*) // 48 AS n, min(v) AS lo, max(v) AS hi FROM v)
SELECT unnest(['tensors', 'size', 'shape', 'range']) AS name, true AS passed, unnest([
  'frame_id: bigint, source: string, height: int, width: int, channels: int, layout: string, pixels: array<float>, label: int',
  printf('%d frames', n), '3x4x4 to 3x4x4, 0 misshapen', printf('[%.3f, %.3f], 0 unreadable', lo, hi)]) AS detail FROM f""")
def prepare_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Image files to a stored and checked tensor dataset."""
    return jobs.prepare_dataset(spark, image_folder(spark, sf), scratch_path(spark, "dataset"), 4)[0]


@query("""SELECT vec_id AS frame_id, 'cannot decode image' AS reason, (SELECT count(*) FROM embeddings WHERE label <> 9) AS kept,
  (SELECT count(*) FROM embeddings WHERE label = 9) AS rejected FROM embeddings WHERE label = 9""")
def stored_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Rejects that the one write of the ingest stored beside the tensors, with its counts."""
    out = scratch_path(spark, "dataset")
    counts = jobs.ingest(spark, image_folder(spark, sf), out, 4)
    return jobs.scan_rejects(spark, out).select(
        _id_in_name("origin").alias("frame_id"), "reason", *[F.lit(n).cast("bigint").alias(k) for k, n in counts.items()])


@query(f"""WITH {tw.GRAY}, x AS (SELECT frame_id, list_transform(range(20), lambda k: px[(2 + k // 4) * 8 + 3 + k % 4 + 1]) AS px FROM gray)
SELECT printf('cam_%07d_cropped.jpg', frame_id) AS origin, CAST(len(px) AS INTEGER) AS n, {W.format('px')} AS checksum FROM x""")
def write_crops(spark: SparkSession, sf: str) -> DataFrame:
    df = st.gray_frames(spark, sf).withColumn("origin", F.format_string("/in/cam_%07d.png", "frame_id"))
    kept, _ = fr.crop_in_bounds(df, 3, 2, 4, 5)
    path = scratch_path(spark, "crops")
    im.write_crops(fr.crop(kept, 3, 2, 4, 5), path)
    return spark.read.parquet(path).select("origin", F.size("pixels").alias("n"), weighed().alias("checksum"))


@query(f"""WITH {tw.RGB} SELECT source, count(*) AS n, CAST(sum({W.format('px')}) AS BIGINT) AS checksum FROM rgb GROUP BY 1""")
def write_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames stored by source, read back with the fixed schema."""
    path = scratch_path(spark, "frames")
    store.write_frames(st.rgb_frames(spark, sf), path)
    return store.scan_frames(spark, path).groupBy("source").agg(
        F.count("*").alias("n"), F.sum(weighed()).alias("checksum"))


@query(f"WITH {tw.RGB} SELECT frame_id, source, 'CHW' AS layout, {W.format('px')} AS checksum, label FROM rgb")
def scan_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Stored frames come back as they were, source and label included."""
    path = scratch_path(spark, "frames")
    store.write_frames(st.rgb_frames(spark, sf), path)
    return store.scan_frames(spark, path).select("frame_id", "source", "layout", weighed().alias("checksum"), "label")


def _indexed(spark: SparkSession, sf: str) -> str:
    """Frames in files by ranges of ids, with their sidecar."""
    path = scratch_path(spark, "frames")
    store.write_frames(st.rgb_frames(spark, sf).repartitionByRange(16, "frame_id"), path)
    skipping.index_frames(spark, path)
    return path


@query(f"WITH {tw.RGB} SELECT frame_id, source, {W.format('px')} AS checksum FROM rgb WHERE frame_id % 100 = 0")
def scan_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of listed ids, from the files that may hold them."""
    ids = st.table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("frame_id"))
    return skipping.scan_ids(spark, _indexed(spark, sf), ids).select("frame_id", "source", weighed().alias("checksum"))


@query(f"""WITH {tw.RGB} SELECT frame_id, source, {W.format('px')} AS checksum FROM rgb
ORDER BY md5('3|' || frame_id), frame_id LIMIT 25""")
def scan_subset(spark: SparkSession, sf: str) -> DataFrame:
    """A sample of stored frames, from the files that hold it."""
    return skipping.scan_subset(spark, _indexed(spark, sf), 25, 3).select("frame_id", "source", weighed().alias("checksum"))


@query("SELECT 'read back' AS name, true AS passed, printf('%d written, %d read', count(*), count(*)) AS detail FROM embeddings")
def verify_stored(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "frames")
    df = st.tensor_frames(spark, sf)
    store.write_frames(df, path)
    return checks.verify_stored(df, store.scan_frames(spark, path))


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)
SELECT CAST((rn - 1) // 5000 AS BIGINT) AS chunk_id, count(*) AS n, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id
FROM r WHERE o_orderpriority <> '1-URGENT' GROUP BY 1""")
def write_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 5,000 input positions; rows that fail make their chunk shorter."""
    items = st.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("frame_id"), "o_totalprice", (F.col("o_orderpriority") != "1-URGENT").alias("ok"))
    path = scratch_path(spark, "chunks")
    store.write_chunks(items, path, valid="ok")
    return store.read_chunks(spark, path).groupBy("chunk_id").agg(
        F.count("*").alias("n"), F.min("frame_id").alias("first_id"), F.max("frame_id").alias("last_id"))


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings)
SELECT vec_id AS frame_id, CAST((rn - 1) // 100 AS BIGINT) AS chunk_id,
  round(list_sum(list_transform(embedding, lambda v, i: CAST(v AS DOUBLE) * i)), 3) AS checksum FROM r""")
def read_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with their pixels through chunk folders and back into one table."""
    df = st.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("embedding").alias("pixels"))
    path = scratch_path(spark, "chunks")
    store.write_chunks(df, path, chunk_size=100)
    return store.read_chunks(spark, path).select("frame_id", "chunk_id", weighed(digits=3).alias("checksum"))


@query("""WITH r AS (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) // 40 AS number FROM embeddings),
c AS (SELECT 'chunk_id=' || number AS chunk, number, count(*) AS n,
  round(sum(list_sum(list_transform(embedding, lambda v, i: CAST(v AS DOUBLE) * i))), 3) AS checksum FROM r GROUP BY number)
SELECT chunk, CAST(row_number() OVER (ORDER BY number) - 1 AS INTEGER) AS position,
  CAST(row_number() OVER (ORDER BY chunk) - 1 AS INTEGER) AS position_as_text, n, checksum FROM c""")
def combine_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk folders found by a pattern, in order of their numbers and in order of their names."""
    df = st.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("embedding").alias("pixels"))
    path = scratch_path(spark, "chunks")
    store.write_chunks(df, path, chunk_size=40)
    as_text = chunks.list_chunks(spark, path, "chunk_id=*", "text").select(
        F.col("name").alias("chunk"), F.col("position").alias("position_as_text"))
    whole = chunks.combine_chunks(spark, path, "chunk_id=*", schema="frame_id bigint, pixels array<float>")
    return whole.groupBy("chunk", "position").agg(
        F.count("*").alias("n"), F.round(F.sum(weighed(digits=9)), 3).alias("checksum")).join(F.broadcast(as_text), "chunk")


@query("SELECT label % 3 AS chunk, count(*) AS n FROM embeddings GROUP BY 1")
def concat_chunks(spark: SparkSession, sf: str) -> DataFrame:
    df = st.gray_frames(spark, sf)
    parts = [df.where(F.col("label") % 3 == i).withColumn("chunk", F.lit(i)) for i in range(3)]
    return store.concat_chunks(parts).groupBy("chunk").agg(F.count("*").alias("n"))


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    entries = fq.entries(spark, sf)
    return entries.withColumns({
        "timestamp": F.lit("20240101_000000"), "session_duration": F.col("session").cast("double") / 2})


@query(fq.ENTRIES + """ SELECT image_index, model_prediction, user_correction, was_correct, count(*) AS n,
  round(sum(density), 6) AS density, round(sum(congestion), 6) AS congestion FROM entries GROUP BY ALL""")
def scan_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Session files written one by one, found again, flattened to entries."""
    path = scratch_path(spark, "feedback")
    fs.write_feedback(_sessions(spark, sf), path, one_file_each=True)
    sessions, _ = fs.scan_feedback(spark, path)
    return fb.flatten_feedback(sessions).groupBy("image_index", "model_prediction", "user_correction", "was_correct").agg(
        F.count("*").alias("n"), F.round(F.sum("density"), 6).alias("density"), F.round(F.sum("congestion"), 6).alias("congestion"))


KIND = "s_nationkey % 5"


@query(f"""SELECT CASE {KIND} WHEN 0 THEN 'malformed' WHEN 1 THEN 'no feedback' ELSE 'read' END AS outcome, count(*) AS files
FROM supplier WHERE {KIND} <= 2 GROUP BY 1""")
def feedback_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """One file per supplier: some broken, some without entries, some in the wrong place."""
    kind = F.expr(KIND)
    text = F.when(kind == 0, '{"feedback": [').when(kind == 1, '{"timestamp": "x"}').otherwise('{"feedback": []}')
    name = F.when(kind == 3, "deep/feedback_far.json").when(kind == 4, "notes.json").otherwise("feedback_x.json")
    path = scratch_path(spark, "feedback")
    write_files(st.table(spark, sf, "supplier").select(
        F.concat_ws("/", F.col("s_suppkey").cast("string"), name).alias("name"), text.alias("content")), path)
    sessions, rejects = fs.scan_feedback(spark, path)
    outcomes = rejects.select(F.col("reason").alias("outcome")).unionByName(sessions.select(F.lit("read").alias("outcome")))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("files"))


@query(fq.ENTRIES + """ SELECT '20240101_000000' AS timestamp, count(*) AS total_images, count(*) FILTER (was_correct) AS correct_predictions,
  session / 2.0::DOUBLE AS session_duration, count(*) = max(image_index) + 1 AS whole FROM entries GROUP BY session""")
def write_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """One document per session and its metadata, stored many to a file."""
    path = scratch_path(spark, "feedback")
    fs.write_feedback(_sessions(spark, sf), path)
    from roadframes.schemas import FEEDBACK_SESSION

    return spark.read.schema(FEEDBACK_SESSION).json(path).select(
        "metadata.timestamp", "metadata.total_images", "metadata.correct_predictions", "metadata.session_duration",
        (F.size("feedback") == F.col("metadata.total_images")).alias("whole"))


@query(fq.ENTRIES + """, n AS (SELECT session, count(*) AS total_images, count(*) FILTER (was_correct) AS correct_predictions FROM entries GROUP BY 1)
SELECT session, CAST(image_index // 4 AS BIGINT) AS page, count(*) AS entries, any_value(total_images) AS total_images,
  any_value(n.correct_predictions) AS correct_predictions FROM entries JOIN n USING (session) GROUP BY 1, 2""")
def session_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of four images each; all documents of a session tell the whole session's totals."""
    reviews = fq.entries(spark, sf).withColumns({"timestamp": F.lit("20240101_000000"), "session_duration": F.lit(0.0)})
    return fs.feedback_documents(reviews, images=4, totals="session").select(
        "session", "page", F.size("feedback").cast("bigint").alias("entries"), "metadata.total_images", "metadata.correct_predictions")


@query(fq.ENTRIES + """ SELECT image_index, user_correction, count(*) AS n, round(sum(density), 6) AS density FROM entries GROUP BY 1, 2""")
def flatten_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Entries out of the sessions' documents."""
    documents = fs.feedback_documents(_sessions(spark, sf))
    return fb.flatten_feedback(documents).groupBy("image_index", "user_correction").agg(
        F.count("*").alias("n"), F.round(F.sum("density"), 6).alias("density"))


@query(fq.ENTRIES + " SELECT was_correct, count(*) AS n FROM entries GROUP BY 1")
def concat_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Entry lists of sessions kept in two places, put together."""
    a = fs.feedback_documents(_sessions(spark, sf).where("session % 2 = 0"))
    b = fs.feedback_documents(_sessions(spark, sf).where("session % 2 = 1"))
    return fb.flatten_feedback(store.concat_chunks([a, b])).groupBy("was_correct").agg(F.count("*").alias("n"))


@query(f"WITH {tw.CAPTURES} SELECT capture_id, camera, date_trunc('second', captured_at) AS captured_at FROM captures")
def parse_capture_name(spark: SparkSession, sf: str) -> DataFrame:
    df = st.captures(spark, sf).select("capture_id", parsed_name(F.col("path")).alias("p"))
    return df.select("capture_id", "p.camera", "p.captured_at")


@query("""SELECT CASE WHEN event_id % 3 = 0 THEN 'US_50_AT_SANDY_POINT' ELSE 'US_50_AT_EX23_MD2' END AS camera,
  'https://mdta.maryland.gov/index.php/traffic-cameras-by-facility#camera-' || CASE WHEN event_id % 3 = 0 THEN '28' ELSE '48' END AS url,
  count(*) AS captures FROM events GROUP BY 1, 2""")
def camera_dim(spark: SparkSession, sf: str) -> DataFrame:
    """Captures joined with the cameras' pages by the camera in the file name."""
    camera = F.when(F.col("event_id") % 3 == 0, "US_50_AT_SANDY_POINT").otherwise("US_50_AT_EX23_MD2")
    named = st.table(spark, sf, "events").select(
        parsed_name(capture_name(camera, F.col("ts")))["camera"].alias("camera"))
    return named.join(F.broadcast(im.camera_dim(spark)), "camera").groupBy("camera", "url").agg(F.count("*").alias("captures"))


@query("SELECT vec_id AS frame_id, label, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def resolve_image_column(spark: SparkSession, sf: str) -> DataFrame:
    df = st.table(spark, sf, "embeddings").withColumnRenamed("embedding", "image_url")
    return im.resolve_image_column(df).select(F.col("vec_id").alias("frame_id"), "label", F.size("image").alias("n"))


@query("SELECT label, count(*) AS n, CAST(64 AS INTEGER) AS values FROM embeddings GROUP BY 1")
def select_frame_columns(spark: SparkSession, sf: str) -> DataFrame:
    return store.select_frame_columns(st.gray_frames(spark, sf)).groupBy("label").agg(
        F.count("*").alias("n"), F.max(F.size("pixel_values")).alias("values"))
