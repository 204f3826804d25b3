"""SQL text shared by the twins: the stand-ins and the scoring chain as CTEs."""

from __future__ import annotations

PX = "list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INTEGER))"
SOURCE = "CASE WHEN label < 5 THEN 'src_a' ELSE 'src_b' END"

GRAY = f"gray AS (SELECT vec_id AS frame_id, {SOURCE} AS source, label, {PX} AS px FROM embeddings)"
RGB = (
    f"raw AS (SELECT vec_id AS frame_id, {SOURCE} AS source, label, {PX} AS p FROM embeddings), "
    "rgb AS (SELECT frame_id, source, label, list_concat(list_concat(p, "
    "list_transform(p, lambda v: 255 - v)), list_reverse(p)) AS px FROM raw)")
TENSOR = (
    f"tensor AS (SELECT vec_id AS frame_id, {SOURCE} AS source, label, list_concat(list_concat(embedding, "
    "list_transform(embedding, lambda v: -v)), list_reverse(embedding)) AS px FROM embeddings)")

GRAY_ALL = GRAY.replace("gray AS", "gray_all AS")
MEAN = "[0.485, 0.456, 0.406]"
STD = "[0.229, 0.224, 0.225]"

# gray values of the three-channel frames
LUMA = (
    "luma AS (SELECT frame_id, source, label, list_transform(range(64), lambda k: "
    "(299 * px[k + 1] + 587 * px[k + 65] + 114 * px[k + 129] + 500) // 1000) AS px FROM rgb)")


def edges(src: str, threshold: int, size: int = 8) -> str:
    """CTEs up to ``edge(frame_id, r, c)``; needs WITH RECURSIVE."""
    top = size - 1

    def tap(dr: int, dc: int) -> str:
        return f"px[greatest(0, least({top}, r + {dr})) * {size} + greatest(0, least({top}, c + {dc})) + 1]"

    gx = " + ".join(f"{w} * ({tap(d, 1)} - {tap(d, -1)})" for d, w in ((-1, 1), (0, 2), (1, 1)))
    gy = " + ".join(f"{w} * ({tap(1, d)} - {tap(-1, d)})" for d, w in ((-1, 1), (0, 2), (1, 1)))
    dr = "CASE a.dir WHEN 'h' THEN 0 ELSE 1 END"
    dc = "CASE a.dir WHEN 'h' THEN 1 WHEN 'v' THEN 0 WHEN 'd' THEN 1 ELSE -1 END"
    return f"""
grad AS (SELECT frame_id, r, c, {gx} AS gx, {gy} AS gy FROM (
  SELECT frame_id, px, k // {size} AS r, k % {size} AS c FROM {src}, range({size * size}) AS t(k))),
mag AS (SELECT frame_id, r, c, abs(gx) + abs(gy) AS m,
  CASE WHEN abs(gy) * 100000 < abs(gx) * 41421 THEN 'h' WHEN abs(gy) * 100000 > abs(gx) * 241421 THEN 'v'
       WHEN gx * gy >= 0 THEN 'd' ELSE 'u' END AS dir FROM grad),
kept AS (SELECT a.frame_id, a.r, a.c, a.m FROM mag a
  LEFT JOIN mag p ON p.frame_id = a.frame_id AND p.r = a.r - {dr} AND p.c = a.c - {dc}
  LEFT JOIN mag q ON q.frame_id = a.frame_id AND q.r = a.r + {dr} AND q.c = a.c + {dc}
  WHERE a.m > {threshold} AND a.m > coalesce(p.m, 0)
    AND (CASE WHEN a.dir IN ('h', 'v') THEN a.m >= coalesce(q.m, 0) ELSE a.m > coalesce(q.m, 0) END)),
edge AS (SELECT frame_id, r, c FROM kept WHERE m > {2 * threshold}
  UNION SELECT k.frame_id, k.r, k.c FROM edge e JOIN kept k
    ON k.frame_id = e.frame_id AND abs(k.r - e.r) <= 1 AND abs(k.c - e.c) <= 1),
edge_px AS (SELECT frame_id, count(*) AS edge_px FROM edge GROUP BY frame_id)"""


def bilinear(size: int, out: int) -> str:
    """Twin of the resize of a gray frame: four weighted taps per output pixel."""
    def at(k: str) -> str:
        return f"greatest(0.0, least({size - 1}.0, ({k} + 0.5) * {size} / {out} - 0.5))"

    return f"""
pos AS (SELECT k, CAST(floor(fy) AS INTEGER) AS y, CAST(floor(fx) AS INTEGER) AS x, fy - floor(fy) AS py, fx - floor(fx) AS px2
  FROM (SELECT k, CAST({at(f'(k // {out})')} AS DOUBLE) AS fy, CAST({at(f'(k % {out})')} AS DOUBLE) AS fx FROM range({out * out}) AS t(k))),
taps AS (SELECT frame_id, k,
  (px[y * {size} + x + 1] * (1 - py) + px[least(y + 1, {size - 1}) * {size} + x + 1] * py) * (1 - px2)
  + (px[y * {size} + least(x + 1, {size - 1}) + 1] * (1 - py) + px[least(y + 1, {size - 1}) * {size} + least(x + 1, {size - 1}) + 1] * py) * px2 AS v
  FROM gray, pos)"""


def level(score: str, thresholds: list[str]) -> str:
    hits = ", ".join(f"CASE WHEN {score} > {t} THEN {i + 1} ELSE 0 END" for i, t in enumerate(thresholds))
    return f"CAST(greatest({hits}) AS INTEGER)"


DEFAULT_LEVEL = level("traffic_score", ["0.1", "0.3", "0.5", "0.7"])


def metrics(src: str, threshold: int) -> str:
    """CTEs up to ``metrics``: counts and scores of each frame of ``src(frame_id, source, label, px)``."""
    return edges(src, threshold) + f""",
counts AS (SELECT g.frame_id, g.source, g.label, len(px) AS px, coalesce(edge_px, 0) AS edge_px,
  CAST(list_sum(px) AS BIGINT) AS px_sum, CAST(list_sum(list_transform(px, lambda v: v * v)) AS BIGINT) AS px_sumsq
  FROM {src} g LEFT JOIN edge_px USING (frame_id)),
base AS (SELECT *, CAST(edge_px AS DOUBLE) / px AS edge_density,
  sqrt(greatest(0, CAST(px_sumsq AS DOUBLE) / px - (CAST(px_sum AS DOUBLE) / px) * (CAST(px_sum AS DOUBLE) / px))) AS dev FROM counts),
parts AS (SELECT *, least(1.0, edge_density * 2) AS density, least(1.0, dev / 50) AS congestion,
  edge_density AS flow_rate FROM base),
summed AS (SELECT *, density + congestion AS traffic_score FROM parts),
metrics AS (SELECT *, {DEFAULT_LEVEL} AS traffic_level FROM summed)"""


SCORED = f"WITH RECURSIVE {GRAY}, {metrics('gray', 100)}"
REVIEWS = SCORED + """,
reviews AS (SELECT frame_id, frame_id AS image_index, CAST(traffic_level AS DOUBLE) AS model_prediction,
  CAST(label % 5 AS DOUBLE) AS user_correction, traffic_level = label % 5 AS was_correct, density, congestion FROM metrics)"""

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
LOG = (
    f"log AS (SELECT user_id AS session, ts, event_id AS seq, {K} % 5 AS level, "
    f"CASE WHEN {K} < 60 THEN 'agree' WHEN {K} < 85 THEN 'disagree' WHEN {K} < 97 THEN 'back' ELSE 'quit' END AS action "
    "FROM events)")
# The prompt's state before a key: the last key that leads to one state whatever came before, turned over by
# each "0" since, for "0" leads from the question to the correction and back.
KEY_LIST = "['y', 'N', '1', 'n', '0', 'b', '2', 'x', '3', 'Y', '4', 'n']"
PRIOR = "OVER (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
PRESSED = f"""
keys AS (SELECT user_id AS session, ts, event_id AS seq,
  lower(CASE WHEN {K} = 99 THEN 'q' ELSE {KEY_LIST}[{K} % 12 + 1] END) AS key FROM events),
resets AS (SELECT *, CASE WHEN key IN ('b', '1', '2', '3', '4') THEN 0 WHEN key = 'n' THEN 1 END AS reset,
  sum(CASE WHEN key = '0' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS turns FROM keys),
asked AS (SELECT *, (coalesce(last_value(reset IGNORE NULLS) {PRIOR}, 0) + coalesce(lag(turns) OVER (PARTITION BY session ORDER BY ts, seq), 0)
  - coalesce(last_value(CASE WHEN reset IS NOT NULL THEN turns END IGNORE NULLS) {PRIOR}, 0)) % 2 AS correcting,
  count(*) FILTER (key = 'q') {PRIOR} AS ended FROM resets),
said AS (SELECT session, ts, seq, CASE WHEN key = 'q' THEN 'quit' WHEN correcting = 1 AND key IN ('0', '1', '2', '3', '4') THEN 'disagree'
  WHEN correcting = 0 AND key IN ('y', '1') THEN 'agree' WHEN correcting = 0 AND key = 'b' THEN 'back' END AS action,
  CASE WHEN correcting = 1 AND key IN ('0', '1', '2', '3', '4') THEN CAST(key AS INTEGER) END AS level FROM asked WHERE ended = 0),
log AS (SELECT * FROM said WHERE action IS NOT NULL)"""
RUN = (
    "run AS (SELECT event_type AS run, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch, "
    "CAST(hour(ts) * 4 + minute(ts) // 15 AS BIGINT) AS batch_id, ts, event_id AS seq, ln(1 + value) AS loss, "
    f"{K} % 2 AS label, CASE WHEN {K} % 3 = 0 THEN 1 ELSE 0 END AS prediction FROM events)")
CAPTURES = (
    "captures AS (SELECT event_id AS capture_id, event_type AS camera, ts AS captured_at, '/captures/' || "
    "CASE WHEN event_id % 2 = 0 THEN event_type || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '.jpg' "
    "ELSE strftime(ts, '%Y%m%d_%H%M%S') || '_' || event_type || '_cropped.png' END AS path FROM events)")
SLOT = "time_bucket(INTERVAL '15 minutes', {0})"


def folded(log: str = "log") -> str:
    """CTEs up to ``folded``: the standing answers, with plain windows over each session."""
    w = "PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING"
    return f"""
steps AS (SELECT *, CASE WHEN action IN ('agree', 'disagree') THEN 1 WHEN action = 'back' THEN -1 ELSE 0 END AS step FROM {log}),
walk AS (SELECT *, sum(step) OVER ({w}) AS s FROM steps),
placed AS (SELECT *, s - least(0, min(s) OVER ({w})) AS pos FROM walk),
marked AS (SELECT *, count(CASE WHEN action = 'quit' OR pos >= 12 THEN 1 END) OVER (
  PARTITION BY session ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM placed),
live AS (SELECT * FROM marked WHERE ended = 0),
last AS (SELECT session, arg_max(pos, (ts, seq)) AS last_pos FROM live GROUP BY session),
answers AS (SELECT *, row_number() OVER (PARTITION BY session, pos ORDER BY ts DESC, seq DESC) AS rn FROM live WHERE step = 1),
folded AS (SELECT session, CAST(pos - 1 AS BIGINT) AS image_index, action = 'agree' AS was_correct,
  CASE WHEN action = 'disagree' THEN level END AS corrected_level, ts AS answered_at
  FROM answers JOIN last USING (session) WHERE rn = 1 AND pos <= last_pos)"""
