"""Samples for fits hold when one id, or the null id, stands on a third of the rows."""

import pytest
from pyspark.sql import functions as F

from roadframes.llm import crf, mixing, quality_crf, quality_rules, secrets, toxicity
from roadframes.llm.common import hash_sample, one_text, texts


@pytest.fixture(scope="module", params=[9, None])
def hot(spark, request):
    """6,000 rows with texts of their own, 2,000 of them of one id, and 1,000 more that are the same row."""
    own = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(request.param)).otherwise(F.col("id")).cast("long").alias("doc_id"),
        F.format_string("text %d of some words\nand another line", "id").alias("text"))
    same = spark.range(1000).select(F.lit(request.param).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    return own.union(same)


def test_rows_are_bounded_and_of_their_own(hot):
    got = hash_sample(hot, ["doc_id", "text"], 600)
    assert got.count() == got.distinct().count() == pytest.approx(600, rel=0.2)
    assert hash_sample(hot, ["doc_id", "text"], 600).exceptAll(got).count() == 0
    by_id = hash_sample(hot, "doc_id", 600)
    assert by_id.count() == by_id.select("doc_id").distinct().count() == pytest.approx(600, rel=0.2)
    assert hash_sample(hot, ["doc_id", "text"], 10**6).count() == 6001  # all, once
    assert hash_sample(hot.limit(0), "doc_id", 10).count() == 0


def test_one_text_for_each_id(hot):
    got = one_text(hot.withColumn("label", F.lit(1)), "hot")
    ids = hot.select("doc_id").distinct()
    assert got.columns == ["doc_id", "text", "label"] and got.count() == ids.count()
    assert got.select("doc_id", "text").exceptAll(hot).count() == 0
    least = hot.orderBy(F.xxhash64("text")).where("doc_id is null or doc_id = 9").first()
    assert got.where("doc_id is null or doc_id = 9").first()["text"] == least["text"]


def test_fits_see_bounded_rows(hot):
    labels = hot.select("doc_id", (F.length("text") % 2).alias("toxic"), (F.length("text") % 2).alias("quality"))
    rows = toxicity.labelled(hot, labels, F.lit(True), 10_000)
    assert rows.count() == rows.select("doc_id").distinct().count()
    label, features, sizes = quality_crf.training_lines(hot, labels, F.lit(True), 10_000, 1000)
    assert len(label) == len(features) == len(sizes) == rows.count()
    profile = quality_rules.rule_profile(hot, sample_rows=500).collect()
    assert all(400 < r["seen"] < 600 for r in profile)
    model = mixing.fit_domains(hot.withColumn("lang", F.lit("en")), labels, sample_docs=300, steps=1)
    assert model.domains == ["en"]


def test_strata_of_a_hot_marked_id(hot, spark):
    marked = spark.range(900).select(
        F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("password = abcdef"), F.col("id")).alias("text"))
    rows = secrets.strata(hot.union(marked).union(marked), 300, 60)
    assert 30 <= rows.where("marked").count() <= 90
    assert rows.where("marked").count() == rows.where("marked").distinct().count()
    assert 200 <= rows.where("not marked").count() <= 500
    assert texts(hot).count() == 7000
    assert isinstance(secrets.fit_secrets(hot.union(marked), 300, marked_docs=60), crf.Chain)
