"""The pipeline stage by stage, each beside what its operator says of its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from roadframes.llm import minhash_dedup, mixing, quality_crf, secrets
from roadframes.llm.catalog import CUT, TARGETS
from roadframes.session import materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_copies", "secrets", "mixing", "packing"]
    raw = docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = materialise(stage(spark, docs, SF), name)
        if name != "packing":
            assert seen[name].schema == raw.schema
            docs = seen[name]
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    model = quality_crf.fit_quality(raw, labels, F.lit(True))
    assert ids(seen["quality"]) == ids(quality_crf.score_quality(raw, model).where(F.col("score") >= CUT))
    bad = raw.join(labels.where("quality = 1"), "doc_id", "leftsemi")
    assert bad.join(seen["quality"], "doc_id", "left_anti").count() <= 2  # good ones stay
    kept = minhash_dedup.minhash_dedup(seen["quality"], percent=80).where("kept")
    assert ids(seen["near_copies"]) == ids(kept)
    chain = secrets.fit_secrets(seen["near_copies"])
    masked = secrets.redact_secrets(seen["near_copies"], chain)
    assert sorted(map(tuple, masked.collect())) == sorted(map(tuple, seen["secrets"].collect()))
    assert all(r["n_chars"] == len(r["text"]) for r in seen["secrets"].collect())
    often = {r["doc_id"]: r["copies"] for r in mixing.mix(seen["secrets"], labels, TARGETS).collect()}
    want = sorted(i for i, n in often.items() for _ in range(n))
    assert ids(seen["mixing"]) == want
    pieces = seen["packing"].collect()
    assert sorted(r["doc_id"] for r in pieces if r["piece"] == 0) == want


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_no_documents(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        docs = none
