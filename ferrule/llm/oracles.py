"""SQL that answers the contracts which SQL can express, for an independent engine on the same tables.

Each text follows the definition, not the method: near duplicates by comparing all texts that share a shingle,
repeated windows by listing them all, windows of a conversation by running sums, top scores by scoring everything.
"""

OP2 = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, list_filter(string_split_regex(lower(COALESCE(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
    SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM t WHERE len(w) > 0) x),
bags AS (SELECT doc_id, hash(s) AS s, COUNT(*) AS c FROM shingles GROUP BY ALL),
sizes AS (SELECT doc_id, SUM(c) AS n FROM bags GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, SUM(least(a.c, b.c)) AS m FROM bags a JOIN bags b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE m >= 0.8 * (x.n + y.n - m)
    UNION SELECT x.doc_id, y.doc_id FROM t x JOIN t y ON len(x.w) = 0 AND len(y.w) = 0 AND x.doc_id <> y.doc_id),
reach AS (
    SELECT doc_id AS node, doc_id AS root FROM documents
    UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node)
SELECT node AS doc_id, MIN(root) AS class_id FROM reach GROUP BY node
"""

OP4 = """
WITH h AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS x FROM documents),
d AS (SELECT doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n FROM h),
starts AS MATERIALIZED (SELECT doc_id, i, hash(substr(x, CAST(2 * i + 1 AS BIGINT), 400)) AS w FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200) s),
again AS (SELECT doc_id, i FROM starts WHERE w IN (SELECT w FROM starts GROUP BY w HAVING COUNT(*) > 1)),
marks AS (SELECT doc_id, i, CASE WHEN i <= LAG(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM again),
runs AS (
    SELECT doc_id, MIN(i) AS s, MAX(i) + 200 AS e FROM (SELECT doc_id, i, SUM(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marks) m GROUP BY doc_id, k),
kept AS (
    SELECT doc_id, s, e, LAG(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS f, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY s DESC) AS r FROM runs),
cut AS (
    SELECT doc_id, SUM(e - s) AS gone, COUNT(*) AS spans,
           string_agg(substr(x, CAST(2 * f + 1 AS BIGINT), CAST(2 * (s - f) AS BIGINT)) || CASE WHEN r = 1 THEN substr(x, CAST(2 * e + 1 AS BIGINT)) ELSE '' END, '' ORDER BY s) AS left_over
    FROM kept JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(COALESCE(gone, 0) AS BIGINT) AS n_removed, CAST(COALESCE(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(COALESCE(left_over, x))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

OP7 = r"""
WITH turns AS (
    SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
coded AS (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
           CAST(len(regexp_extract_all(text, '\w+|[^\w\s]')) AS BIGINT) + 4 AS tokens,
           CAST(length(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '[', '%5B'), '|', '%7C'))
              + length(replace(replace(replace(replace(text, '%', '%25'), '<', '%3C'), '[', '%5B'), '|', '%7C')) + 12 AS BIGINT) AS chars
    FROM turns),
marked AS (SELECT *, pos = 1 AND role = 'system' AS is_system, CASE WHEN pos = 1 AND role = 'system' THEN 0 ELSE tokens END AS counted FROM coded),
placed AS (
    SELECT *, SUM(counted) OVER o - counted AS begins,
           FIRST(CASE WHEN is_system THEN tokens END) OVER o AS sys_tokens, FIRST(CASE WHEN is_system THEN chars END) OVER o AS sys_chars
    FROM marked WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
rooms AS (SELECT *, greatest(1, floor((768 - COALESCE(sys_tokens, 0)) / 2)) AS room FROM placed),
stretches AS (
    SELECT *, counted > room AS alone, greatest(room, 768 - COALESCE(sys_tokens, 0) - COALESCE(MAX(CASE WHEN counted <= room THEN counted END) OVER (PARTITION BY conv_id), 0)) AS stretch
    FROM rooms),
blocks AS (SELECT *, floor(begins / stretch) AS block FROM stretches),
cuts AS (
    SELECT *, CASE WHEN LAG(block) OVER o IS NOT NULL AND (LAG(block) OVER o <> block OR LAG(alone) OVER o OR alone) AND NOT LAG(is_system, 1, FALSE) OVER o THEN 1 ELSE 0 END AS cut,
           COALESCE(SUM(CASE WHEN is_system THEN 0 ELSE chars END) OVER (PARTITION BY conv_id ORDER BY begins RANGE BETWEEN 256 PRECEDING AND 1 PRECEDING), 0) AS past
    FROM blocks WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
numbered AS (SELECT *, SUM(cut) OVER (PARTITION BY conv_id ORDER BY pos) AS window_no FROM cuts),
windows AS (
    SELECT conv_id, window_no, SUM(chars) + arg_min(past, pos) + CASE WHEN bool_or(is_system) THEN 0 ELSE COALESCE(MAX(sys_chars), 0) END AS chars
    FROM numbered GROUP BY conv_id, window_no),
sums AS (SELECT conv_id, CAST(SUM(chars) AS BIGINT) AS formatted_chars, COUNT(*) AS n_windows FROM windows GROUP BY conv_id),
said AS (
    SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
           COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '') AS target
    FROM coded GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(target) AS BIGINT) AS loss_chars, sha256(target) AS loss_sha256, formatted_chars, n_windows
FROM said JOIN sums USING (conv_id)
"""

# Pages of the test tables mark their article; their references are those replaced here, the ampersand last.
OP8 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(COALESCE(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(x, '</?(?:p|h[1-6]|div|ul|ol|li)>'), lambda t: regexp_replace(t, '<[^>]*>', ' ', 'g')) AS x
      FROM (SELECT page_id, url, regexp_replace(x, '</?b>', '', 'g') AS x FROM a) y),
c AS (SELECT page_id, url, list_transform(x, lambda t: trim(regexp_replace(
          regexp_replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '\u00a9'), '&middot;', '\u00b7'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS x FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars
FROM (SELECT page_id, url, array_to_string(list_filter(x, lambda t: t <> ''), chr(10)) AS text FROM c) d
"""

OP10 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank, vec_id, score FROM (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score,
           CAST(ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) AS INTEGER) AS rank
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) s
WHERE rank <= 5
"""
