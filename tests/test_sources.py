import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadframes.functions.names import cropped_name, parse_capture_name
from roadframes.operators import feedback as fb
from roadframes.operators import frames as fr
from roadframes.sources import chunks as ck
from roadframes.sources import feedback as fs
from roadframes.sources import files
from roadframes.sources import frames as st
from roadframes.sources import images as im
from roadframes.schemas import FRAMES

RNG = np.random.default_rng(0)


@pytest.fixture
def folder(spark, frames, tmp_path):
    """Gray, colour and alpha images, a PNG named .jpg, junk, and a file of another kind."""
    shapes = [(4, 5, 1), (4, 5, 3), (4, 5, 4), (3, 2, 3)]
    data = [RNG.integers(0, 256, h * w * c) for h, w, c in shapes]
    names = ["a.png", "b.png", "c.png", "d.jpg"]
    df = frames(*[(d, *s, "HWC") for d, s in zip(data, shapes)])
    df = df.withColumn("name", F.get(F.array(*map(F.lit, names)), F.col("frame_id").cast("int")))
    path = tmp_path / "images"
    im.write_image_files(df, str(path))
    (path / "junk.png").write_bytes(b"no image")
    (path / "notes.txt").write_text("x")
    (path / "deep").mkdir()
    (path / "deep" / "e.png").write_bytes((path / "a.png").read_bytes())
    return path, dict(zip(names, zip(shapes, data)))


def test_images_come_back_as_they_were(spark, folder):
    path, want = folder
    images, rejects = im.image_rejects(im.scan_images(spark, str(path)))
    assert [r.origin.rsplit("/", 1)[1] for r in rejects.collect()] == ["junk.png"]
    rows = {r.origin.rsplit("/", 1)[1]: r for r in fr.to_rgb(images).collect()}
    assert set(rows) == set(want)
    for name, ((h, w, c), data) in want.items():
        px = data.reshape(h, w, c)
        rgb = np.repeat(px, 3, axis=2) if c == 1 else px[..., :3]
        row = rows[name]
        assert (row.height, row.width, row.channels) == (h, w, 3)
        assert list(row.pixels) == rgb.ravel().tolist()


def test_folder_options(spark, folder):
    path, want = folder
    assert im.scan_images(spark, str(path), drop_invalid=True).count() == 4
    assert im.scan_images(spark, str(path), recursive=True, drop_invalid=True).count() == 5
    assert im.scan_images(spark, str(path), glob="*.jpg").count() == 1


def test_writing_files_again_replaces_them(spark, frames, tmp_path):
    df = frames(([1, 2], 1, 2, 1, "HWC")).withColumn("name", F.lit("x/y.png"))
    im.write_image_files(df, str(tmp_path))
    im.write_image_files(df, str(tmp_path))
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["y.png"]


def test_image_column(spark):
    df = spark.createDataFrame([(1, 2)], "image int, image_url int")
    assert im.resolve_image_column(df).first().image == 2
    with pytest.raises(ValueError):
        im.resolve_image_column(df.select(F.col("image").alias("x")))


def test_names(spark):
    names = [
        "US_50_AT_EX23_MD2_20240102_030405.jpg", "/a/b/20240102_030405_US_50_AT_SANDY_POINT.png",
        "20240102_030405_CAM_1_cropped.jpg", "CAM_20249902_030405.jpg", "other.jpg", "20240102_030405_CAM.gif"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [(r.p.camera, str(r.p.captured_at)) for r in df.select(parse_capture_name(F.col("n")).alias("p")).collect()]
    t = "2024-01-02 03:04:05"
    assert got == [("US_50_AT_EX23_MD2", t), ("US_50_AT_SANDY_POINT", t), ("CAM_1", t), ("CAM", "None"), (None, "None"), (None, "None")]
    assert df.select(cropped_name(F.col("n"))).first()[0] == "US_50_AT_EX23_MD2_20240102_030405_cropped.jpg"


def test_frames_and_chunks(spark, frames, tmp_path):
    df = frames(*[([i, i + 1], 1, 2, 1, "HWC") for i in range(25)])
    st.write_frames(df, str(tmp_path / "f"))
    back = st.scan_frames(spark, str(tmp_path / "f"))
    assert sorted(back.select(df.columns).collect()) == sorted(df.collect())
    with pytest.raises(Exception, match="already exists"):
        st.write_frames(df, str(tmp_path / "f"))
    st.write_chunks(df.withColumn("ok", F.col("frame_id") != 3), str(tmp_path / "c"), 10, valid="ok")
    got = st.read_chunks(spark, str(tmp_path / "c")).groupBy("chunk_id").count().orderBy("chunk_id").collect()
    assert [tuple(r) for r in got] == [(0, 9), (1, 10), (2, 5)]
    assert len(list((tmp_path / "c" / "chunk_id=1").glob("*.parquet"))) == 1


def entry(i, ok):
    return {"image_index": i, "model_prediction": 2.0, "user_correction": 2.0 if ok else 4.0, "was_correct": ok, "density": 0.5, "congestion": 0.25}


def test_feedback_files(spark, tmp_path):
    files = {
        "s1/feedback_a.json": json.dumps({"timestamp": "t", "feedback": [entry(0, True), entry(1, False)], "session_duration": 3.5}, indent=4),
        "s1/feedback_b.json": json.dumps({"feedback": []}),
        "s2/feedback_bad.json": '{"feedback": [',
        "s2/feedback_none.json": '{"timestamp": "t"}',
        "s2/other.json": json.dumps({"feedback": [entry(0, True)]}),
        "s2/deep/feedback_c.json": json.dumps({"feedback": [entry(0, True)]}),
        "feedback_top.json": json.dumps({"feedback": [entry(0, True)]})}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    sessions, rejects = fs.scan_feedback(spark, str(tmp_path))
    assert sorted(r.file_path.rsplit("/", 1)[1] for r in sessions.collect()) == ["feedback_a.json", "feedback_b.json"]
    assert {(r.file_path.rsplit("/", 1)[1], r.reason) for r in rejects.collect()} == {("feedback_bad.json", "malformed"), ("feedback_none.json", "no feedback")}
    assert [tuple(r)[:4] for r in fb.flatten_feedback(sessions).orderBy("image_index").collect()] == [(0, 2.0, 2.0, True), (1, 2.0, 4.0, False)]


def test_no_feedback_files(spark, tmp_path):
    sessions, rejects = fs.scan_feedback(spark, str(tmp_path))
    assert sessions.count() == rejects.count() == 0
    row = fb.learn_params(fb.flatten_feedback(sessions)).first()
    assert list(row.thresholds) == [0.1, 0.3, 0.5, 0.7]


def test_feedback_round_trip_and_pages(spark, tmp_path):
    rows = [("s", "20240101_000000", 9.0, i, 2.0, 2.0, True, 0.5, 0.5) for i in range(30)]
    df = spark.createDataFrame(rows, "session string, timestamp string, session_duration double, image_index bigint, model_prediction double, user_correction double, was_correct boolean, density double, congestion double")
    fs.write_feedback(df, str(tmp_path / "a"), one_file_each=True)
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["s_0", "s_1", "s_2"]
    sessions, rejects = fs.scan_feedback(spark, str(tmp_path / "a"))
    assert rejects.count() == 0
    assert sorted(r.metadata.total_images for r in sessions.collect()) == [6, 12, 12]
    assert sorted(r.image_index for r in fb.flatten_feedback(sessions).collect()) == list(range(30))
    assert [e.image_index for e in sessions.orderBy(F.desc("metadata.total_images"), "feedback").first().feedback] == list(range(12))


def test_session_totals_in_every_page(spark, tmp_path):
    rows = [(s, "20240101_000000", 9.0, i, 2.0, 2.0, i % 3 == 0, 0.5, 0.5) for s, n in (("s", 30), ("t", 5), (None, 13)) for i in range(n)]
    df = spark.createDataFrame(rows, "session string, timestamp string, session_duration double, image_index bigint, model_prediction double, user_correction double, was_correct boolean, density double, congestion double")
    want = [("s", 0, 30, 10), ("s", 1, 30, 10), ("s", 2, 30, 10), ("t", 0, 5, 2), (None, 0, 13, 5), (None, 1, 13, 5)]
    got = fs.feedback_documents(df).select("session", "page", "metadata.session_images", "metadata.session_correct").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    fs.write_feedback(df.where("session = 's'"), str(tmp_path / "a"), one_file_each=True)
    sessions, _ = fs.scan_feedback(spark, str(tmp_path / "a"))
    assert [tuple(r) for r in sessions.select("metadata.session_images", "metadata.session_correct").collect()] == [(30, 10)] * 3


def test_totals_of_the_session_in_every_document(spark, tmp_path):
    rows = [("s", "20240101_000000", 9.0, i, 2.0, 2.0, i % 3 == 0, 0.5, 0.5) for i in range(30)]
    df = spark.createDataFrame(rows, "session string, timestamp string, session_duration double, image_index bigint, model_prediction double, user_correction double, was_correct boolean, density double, congestion double")
    fs.write_feedback(df, str(tmp_path / "a"), one_file_each=True, totals="session")
    sessions, _ = fs.scan_feedback(spark, str(tmp_path / "a"))
    assert [tuple(r) for r in sessions.select("metadata.total_images", "metadata.correct_predictions").collect()] == [(30, 10)] * 3
    with pytest.raises(ValueError):
        fs.feedback_documents(df, totals="day")


def test_chunks_by_pattern(spark, tmp_path):
    for name, ids in (("t_chunk_2", [1, 2]), ("t_chunk_10", [3]), ("t_chunk_1 b+c%20", [4]), ("other_7", [5])):
        spark.createDataFrame([(i, "x") for i in ids], "frame_id bigint, source string").coalesce(1).write.parquet(str(tmp_path / name))
    spark.createDataFrame([(9, 1)], "frame_id bigint, label int").coalesce(1).write.parquet(str(tmp_path / "t_chunk_11"))
    (tmp_path / "t_chunk_99").mkdir()  # no files yet
    rows = ck.combine_chunks(spark, str(tmp_path), "t_chunk_*")
    assert rows.columns == [*FRAMES.names, "chunk", "position"]
    got = [(r.chunk, r.position, r.frame_id, r.source) for r in rows.orderBy("position", "frame_id").collect()]
    assert got == [("t_chunk_2", 0, 1, "x"), ("t_chunk_2", 0, 2, "x"), ("t_chunk_10", 1, 3, "x"), ("t_chunk_11", 2, 9, None), ("t_chunk_1 b+c%20", 3, 4, "x")]
    text = ck.combine_chunks(spark, str(tmp_path), "t_chunk_*", order="text")
    assert [r.chunk for r in text.select("chunk", "position").distinct().orderBy("position").collect()] == ["t_chunk_1 b+c%20", "t_chunk_10", "t_chunk_11", "t_chunk_2"]
    assert ck.list_chunks(spark, str(tmp_path), "t_chunk_*").count() == 5
    with pytest.raises(ck.NoChunks):
        ck.combine_chunks(spark, str(tmp_path), "none_*")
    with pytest.raises(ValueError):
        ck.list_chunks(spark, str(tmp_path), order="size")


def test_images_are_encoded_by_the_task_that_writes_them(spark, frames, tmp_path, monkeypatch):
    """No Python process beside the writer holds a batch of encoded files; frames of a wrong shape are left out."""
    df = frames(([0, 50, 100, 150], 2, 2, 1, "HWC"), ([1, 2, 3], 1, 1, 3, "HWC"), ([1, 2], 2, 2, 1, "HWC"), (None, 1, 1, 1, "HWC"))
    df = df.withColumn("name", F.format_string("f_%d.png", "frame_id"))
    plans, write = [], files._write

    def seen(rows, folder, contents):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(rows, folder, contents)

    monkeypatch.setattr(files, "_write", seen)
    im.write_image_files(df, str(tmp_path / "out"))
    assert len(plans) == 1 and "ArrowEvalPython" not in plans[0]
    rows = {r.origin.rsplit("/", 1)[1]: list(r.pixels) for r in fr.to_rgb(im.scan_images(spark, str(tmp_path / "out"))).collect()}
    assert rows == {"f_0.png": [0.0] * 3 + [50.0] * 3 + [100.0] * 3 + [150.0] * 3, "f_1.png": [1.0, 2.0, 3.0]}
