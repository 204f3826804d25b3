"""DuckDB twins of the corpus queries that SQL can express."""

REACH = """
reach(id, root) AS (SELECT id, id FROM nodes UNION SELECT b, root FROM reach JOIN ends ON reach.id = ends.a),
parts AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""

NEAR_COPIES = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM words WHERE len(ws) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), nodes AS (SELECT doc_id AS id FROM documents),""" + REACH + """
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN parts ON id = doc_id LEFT JOIN sizes USING (doc_id)"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ends AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
nodes AS (SELECT vec_id AS id FROM v),""" + REACH + """
SELECT vec_id, (SELECT count(*) FROM ends WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN parts ON id = vec_id"""



def _clusters(clusters: int = 40, rounds: int = 5) -> str:
    """Plain rounds of k-means over whole numbers: the nearest centroid by distance, then number."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (SELECT r, min(d * {clusters} + c) % {clusters} AS c, min(d * {clusters} + c) // {clusters} AS d FROM (
  SELECT r, c, sum((x - y) * (x - y)) AS d FROM xs JOIN c{k} USING (i) GROUP BY r, c) GROUP BY r)""")
        if k < rounds:
            steps.append(f"""
c{k + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{k} LEFT JOIN (
  SELECT c, i, sum(x) AS s, count(*) AS n FROM a{k} JOIN xs USING (r) GROUP BY c, i) USING (c, i))""")
    return f"""
WITH vecs AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
xs AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(v) AS x FROM vecs),
c0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS i, unnest(v) AS y FROM (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM vecs) WHERE c < {clusters}),{",".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN vecs USING (r) JOIN (
  SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c) USING (c)"""


#: Each backslash and each control string in a text adds one sign to the formatted text.
CHATS = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
turns AS (SELECT *, len(regexp_extract_all(text, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|role\|>|<\|text\|>|<\|end\|>')) AS escapes,
  CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 23 + length(role) END AS marks FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + escapes + marks) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

TWINS: dict[str, str] = {"op6_minhash_dedup": NEAR_COPIES, "op8_embedding_dedup": NEAR_VECTORS,
                         "op11_chat_format": CHATS,
                         "op12_ns_clusters": _clusters()}
