import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadframes.operators import frames as fr
from roadframes.operators import ingest
from roadframes.plans import jobs
from roadframes.schemas import FRAMES
from roadframes.sources.routed import write_routed

IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


@pytest.fixture
def images(spark):
    rng = np.random.default_rng(1)
    shapes = [(6, 5, 3), (6, 5, 1), (4, 4, 3), (6, 5, 4), (6, 5, 3), (3, 9, 3)]
    rows = [((f"i{k}", h, w, c, 16, rng.bytes(h * w * c)),) for k, (h, w, c) in enumerate(shapes)]
    rows += [(("bad", -1, -1, -1, -1, b""),), (("short", 6, 5, 3, 16, b"abc"),), (("odd", 6, 5, 2, 16, bytes(60)),),
             (("null", 6, 5, 3, 16, None),), (("empty", 0, 0, 3, 16, b""),), (None,)]
    return spark.createDataFrame(rows, IMAGE).coalesce(1)


def test_one_pass_equals_the_steps(images):
    good = images.where("image.origin like 'i%'")
    for region in (None, (1, 1, 3, 3)):
        frames = fr.to_rgb(good)
        if region:
            frames = fr.crop(frames, *region)
        want = fr.to_tensor(frames, 7).where("pixels is not null").select("origin", "height", "width", "channels", "layout", "pixels")
        got = ingest.image_tensors(good, 7, region).where("reason is null").drop("reason")
        rows = {r["origin"]: r for r in want.collect()}
        assert {r["origin"] for r in got.collect()} == set(rows)
        for r in got.collect():
            assert r[:5] == rows[r["origin"]][:5] and r["pixels"] == pytest.approx(rows[r["origin"]]["pixels"], abs=1e-6)


def test_reasons(images):
    got = {r["origin"]: r["reason"] for r in ingest.image_tensors(images, 4, (0, 2, 5, 4)).collect()}
    assert {k for k, v in got.items() if v is None} == {"i0", "i1", "i3", "i4"}
    assert {k for k, v in got.items() if v == "region exceeds image"} == {"i2", "i5", "empty"}
    assert {k for k, v in got.items() if v == "cannot decode image"} == {"bad", None}
    assert {k for k, v in got.items() if v == "conversion failed"} == {"short", "odd", "null"}
    assert ingest.image_tensors(images.limit(0), 4).count() == 0


def test_output_batches_are_bounded(images, monkeypatch):
    monkeypatch.setattr(ingest, "BATCH_BYTES", 12 * 8 * 8 * 2)  # two tensors
    whole = ingest.image_tensors(images.where("image.origin like 'i%'"), 8)
    assert whole.where("reason is null").count() == 6
    batch = pa.RecordBatch.from_pydict({"k": list(range(7))})
    assert [b.column(0).to_pylist() for b in ingest.pieces(iter([batch, batch.slice(0, 0)]), 3)] == [[0, 1, 2], [3, 4, 5], [6]]
    monkeypatch.undo()
    again = ingest.image_tensors(images.where("image.origin like 'i%'"), 8)
    assert sorted(map(str, whole.collect())) == sorted(map(str, again.collect()))


def test_routes_are_published_together(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("source"))
    where = {"kept": str(tmp_path / "a/kept"), "rejected": str(tmp_path / "b/rejected")}
    outcome = F.when(F.col("id") < 70, "kept").otherwise("rejected")
    assert write_routed(df, outcome, where) == {"kept": 70, "rejected": 30}
    assert [spark.read.parquet(p).count() for p in where.values()] == [70, 30]
    assert {p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")} == {"kept"}
    with pytest.raises(FileExistsError):
        write_routed(df, outcome, where)
    # a row without a folder fails the job and leaves nothing
    lost = {k: str(tmp_path / "c" / k) for k in where}
    with pytest.raises(Exception, match="no folder for outcome other"):
        write_routed(df, F.when(F.col("id") < 99, "kept").otherwise("other"), lost)
    assert not [p for p in (tmp_path / "c").glob("*") if not p.name.startswith(".")]
    only = {k: str(tmp_path / "d" / k) for k in where}
    assert write_routed(df, F.lit("kept"), only) == {"kept": 100, "rejected": 0}
    assert spark.read.schema("id long").parquet(only["rejected"]).count() == 0


def test_ingest_counts_and_stored_rejects(spark, tmp_path):
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "junk.png").write_bytes(b"x")
    out = str(tmp_path / "frames")
    assert jobs.ingest(spark, str(tmp_path / "images"), out, 4) == {"kept": 0, "rejected": 1}
    assert [r["reason"] for r in jobs.scan_rejects(spark, out).collect()] == ["cannot decode image"]
    assert spark.read.schema(FRAMES).parquet(out).count() == 0
