"""Queries that fit and judge MLlib models on frame features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframes.operators.frames import label_by_source
from roadframes.operators.sampling import split_by_source, split_exact
from roadframes.plans import epochs as ep
from roadframes.plans import modelling as md
from roadframes.plans import standins as st
from roadframes.plans import twins as tw
from roadframes.plans.registry import query, r6
from roadframes.session import materialise, scratch_path

CHANNEL = "list_sum(px[{a}:{b}]) / 64.0::DOUBLE AS {c}_mean, list_stddev_pop(px[{a}:{b}]) AS {c}_std"
CHANNELS = ", ".join(CHANNEL.format(a=1 + 64 * i, b=64 + 64 * i, c=c) for i, c in enumerate("rgb"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of all frames, labelled and split by source, stored once."""
    features = md.frame_features(st.rgb_frames(spark, sf), 100)
    return materialise(
        split_by_source(label_by_source(features, {"src_a": 0, "src_b": 1})), "features")


@query(f"""WITH RECURSIVE {tw.RGB}, {tw.LUMA}, {tw.metrics('luma', 100)}, ch AS (SELECT frame_id, {CHANNELS} FROM rgb)
SELECT frame_id, {', '.join(f'round({c}_mean, 6) AS {c}_mean, round({c}_std, 6) AS {c}_std' for c in 'rgb')},
  round(edge_density, 6) AS edge_density FROM ch JOIN metrics USING (frame_id)""")
def frame_features(spark: SparkSession, sf: str) -> DataFrame:
    return md.frame_features(st.rgb_frames(spark, sf), 100).select("frame_id", *[r6(c, c) for c in md.FEATURES])


@query()
def source_classifier(spark: SparkSession, sf: str) -> DataFrame:
    features = _features(spark, sf)
    model = md.fit_source_classifier(features.where("split = 'train'"))
    return md.evaluate(md.predict(model, features))


@query()
def level_classifier(spark: SparkSession, sf: str) -> DataFrame:
    metrics = materialise(split_exact(st.scored(spark, sf)), "metrics")
    model = md.fit_level_classifier(metrics.where("split = 'train'"))
    return md.evaluate(md.predict(model, metrics), label="traffic_level")


@query()
def parameter_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Squared error of the three regressions on each split."""
    out = features = _features(spark, sf)
    for model in md.fit_parameter_heads(features.where("split = 'train'"), md.FEATURES[:6]).values():
        out = md.predict(model, out)
    return out.groupBy("split").agg(*[
        F.avg(F.pow(F.col(f"{p}_predicted") - F.col(p), 2)).alias(p) for p in md.PARAMETERS])


@query("""WITH p AS (SELECT doc_id, 1 / (1 + exp(-(ln(n_chars + 1) - 6))) AS p1, quality FROM documents JOIN labels USING (doc_id))
SELECT 'all' AS split, count(*) AS rows, round(avg(-ln(CASE quality WHEN 1 THEN p1 ELSE 1 - p1 END)), 6) AS loss,
  round(count(*) FILTER ((p1 > 0.5) = (quality = 1)) * 100.0 / count(*), 6) AS accuracy FROM p""")
def evaluate(spark: SparkSession, sf: str) -> DataFrame:
    """Loss and accuracy of fixed class probabilities."""
    docs = st.table(spark, sf, "documents").select("doc_id", "n_chars").join(st.table(spark, sf, "labels"), "doc_id")
    p1 = F.lit(1.0) / (F.exp(-(F.log(F.col("n_chars") + 1) - 6)) + 1)
    scored = docs.select(
        F.lit("all").alias("split"), F.array(1 - p1, p1).alias("probability"),
        (p1 > 0.5).cast("double").alias("prediction"), F.col("quality").alias("label"))
    return md.evaluate(scored).withColumns({"loss": r6("loss"), "accuracy": r6("accuracy")})


#: Epochs, mini-batches of an epoch and learning rate of the run that the queries train.
EPOCHS, STEPS, RATE = 3, 4, 0.05


def _training() -> str:
    """CTEs of the whole run, a step at a time, up to ``epochs`` and the ``test`` figures of each epoch."""
    listed = ", ".join(md.FEATURES)
    last = len(md.FEATURES) + 1
    out = f"""{tw.RGB}, {tw.LUMA}, {tw.metrics('luma', 100)}, ch AS (SELECT frame_id, {CHANNELS} FROM rgb),
ranked AS (SELECT frame_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0|' || frame_id), frame_id) AS rn,
  count(*) OVER (PARTITION BY source) AS n FROM metrics),
cuts AS (SELECT *, CAST(ceil(n * 30 / 100.0) AS BIGINT) AS held FROM ranked),
feats AS MATERIALIZED (SELECT frame_id, CASE cuts.source WHEN 'src_a' THEN 0 ELSE 1 END AS y,
  CASE WHEN rn <= n - held THEN 'train' WHEN rn <= n - CAST(ceil(held / 2.0) AS BIGINT) THEN 'val' ELSE 'test' END AS split, {listed}
  FROM ch JOIN metrics USING (frame_id) JOIN cuts USING (frame_id)),
raw_x AS (SELECT frame_id, split, y, unnest(range(1, {last})) AS j, unnest([{listed}]) AS value FROM feats),
scales AS (SELECT j, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS scale
  FROM raw_x WHERE split = 'train' GROUP BY j),
xs AS MATERIALIZED (SELECT frame_id, split, y, j, (value - mean) / scale AS value FROM raw_x JOIN scales USING (j)
  UNION ALL SELECT frame_id, split, y, {last}, 1 FROM feats),
w0 AS MATERIALIZED (SELECT c, j, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v FROM range(2) AS a(c), range(1, {last + 1}) AS b(j))"""
    figures = []

    def judged(name: str, weights: str, rows: str) -> str:
        """Probabilities and log-sums of some rows."""
        return f"""
{name} AS MATERIALIZED (SELECT frame_id, split, y, c, l, ln(sum(exp(l - top)) OVER f) + top AS z FROM (
  SELECT *, max(l) OVER (PARTITION BY frame_id) AS top FROM (
    SELECT frame_id, split, y, c, sum(w * value) AS l FROM xs JOIN {weights} USING (j) WHERE {rows} GROUP BY frame_id, split, y, c))
  WINDOW f AS (PARTITION BY frame_id)),
{name}_said AS (SELECT split, count(*) AS n, avg(z - own) AS loss, count(*) FILTER (said = y) AS hits FROM (
  SELECT frame_id, split, y, any_value(z) AS z, max(l) FILTER (c = y) AS own, arg_min(c, (-l, c)) AS said FROM {name} GROUP BY frame_id, split, y) GROUP BY split)"""

    for step in range(1, EPOCHS * STEPS + 1):
        epoch, batch = divmod(step - 1, STEPS)
        drawn = f"split = 'train' AND CAST('0x' || substr(md5('0|{epoch}|' || frame_id), 1, 4) AS BIGINT) * {STEPS} // 65536 = {batch}"
        out += "," + judged(f"s{step}", f"w{step - 1}", drawn) + f""",
w{step} AS MATERIALIZED (SELECT c, j, w - {RATE} * (m2 / (1 - 0.9 ** {step})) / (sqrt(v2 / (1 - 0.999 ** {step})) + 1e-8) AS w, m2 AS m, v2 AS v FROM (
  SELECT c, j, w, 0.9 * m + 0.1 * g AS m2, 0.999 * v + 0.001 * g * g AS v2 FROM w{step - 1} JOIN (
    SELECT c, j, sum((exp(l - z) - CASE WHEN c = xs.y THEN 1 ELSE 0 END) * value) / (SELECT n FROM s{step}_said) AS g
    FROM s{step} JOIN xs USING (frame_id) GROUP BY c, j) USING (c, j)))"""
        if batch == STEPS - 1:
            parts = " UNION ALL ".join(f"SELECT loss, hits, n FROM s{k}_said" for k in range(step - STEPS + 1, step + 1))
            out += "," + judged(f"e{epoch}", f"w{step}", "split <> 'train'")
            figures.append(f"""SELECT {epoch} AS epoch, (SELECT avg(loss) FROM ({parts})) AS train_loss, (SELECT sum(hits) * 100.0 / sum(n) FROM ({parts})) AS train_acc,
  v.loss AS val_loss, v.hits * 100.0 / v.n AS val_acc, t.n AS test_n, t.loss AS test_loss, t.hits * 100.0 / t.n AS test_acc
  FROM e{epoch}_said v, e{epoch}_said t WHERE v.split = 'val' AND t.split = 'test'""")
    return out + ", epochs AS (" + " UNION ALL ".join(figures) + ")"


@query(f"""WITH RECURSIVE {_training()}, best AS (SELECT arg_min(epoch, (-val_acc, epoch)) AS epoch FROM epochs WHERE val_acc > 0)
SELECT 'test' AS split, CAST(test_n AS BIGINT) AS rows, round(test_loss, 6) AS loss, round(test_acc, 6) AS accuracy FROM epochs JOIN best USING (epoch)""")
def best_model(spark: SparkSession, sf: str) -> DataFrame:
    """A run of several epochs, the best one loaded again and applied to the test rows."""
    features, folder = _features(spark, sf), scratch_path(spark, "run")
    ep.train_epochs(features, folder, EPOCHS, STEPS, RATE)
    best = ep.load_epoch(spark, folder)
    return md.evaluate(best.predict(features.where("split = 'test'"))).withColumns({"loss": r6("loss"), "accuracy": r6("accuracy")})


@query(f"""WITH RECURSIVE {_training()}
SELECT 'source' AS run, CAST(epoch AS INTEGER) AS epoch, round(train_loss, 6) AS train_loss, round(train_acc, 6) AS train_acc,
  round(val_loss, 6) AS val_loss, round(val_acc, 6) AS val_acc FROM epochs""")
def training_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A run of several epochs, each going on from the one before, and their figures."""
    runs = ep.train_epochs(_features(spark, sf), scratch_path(spark, "run"), EPOCHS, STEPS, RATE)
    return runs.withColumns({c: r6(c) for c in ("train_loss", "train_acc", "val_loss", "val_acc")})


@query()
def batch_inference(spark: SparkSession, sf: str) -> DataFrame:
    features = _features(spark, sf)
    model = md.fit_source_classifier(features.where("split = 'train'"))
    return md.predict(model, features).select("frame_id", "source", "split", "prediction")
