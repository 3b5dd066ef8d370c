"""DuckDB SQL for the queries of this subpackage that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP2 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
k AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS best FROM k)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND best IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND best IS DISTINCT FROM page_id THEN best END AS refers_to
FROM g
"""

OP3 = rf"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS unit
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0]::DOUBLE[] AS ws,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn
  FROM s GROUP BY source),
w AS (SELECT source, source_size, ws[turn + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM per),
lv AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
top AS (SELECT arg_min(level, source_size / weight) AS level FROM lv WHERE level * weight <= cap),
t AS (SELECT w.source, source_size, CASE WHEN top.level * weight <= cap THEN top.level * weight ELSE cap END AS target FROM w, top),
l AS (
  SELECT s.*, source_size, target,
         (sum(size) OVER (PARTITION BY s.source ORDER BY unit, doc_id NULLS LAST, size) - size)::BIGINT AS a, floor(target)::BIGINT AS n,
         row_number() OVER (ORDER BY doc_id, size) AS row
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
-- the schedule: golden-ratio points through the cumulative targets, slots ranked per source; surplus slots go, missing ones follow
parts AS (SELECT source, floor(target)::BIGINT AS n, sum(target) OVER (ORDER BY source NULLS LAST) / sum(target) OVER () AS hi FROM t),
cut AS (SELECT source, n, hi, coalesce(lag(hi) OVER (ORDER BY source NULLS LAST), 0) AS lo, row_number() OVER (ORDER BY source DESC NULLS FIRST) = 1 AS is_last FROM parts),
total AS (SELECT round(sum(target) / 256)::BIGINT AS slots FROM t),
points AS (SELECT i AS slot, ((i + 1) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS u FROM total, unnest(range(slots)) AS x(i)),
ranked AS (SELECT slot, source, n, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
           FROM points JOIN cut ON u >= lo AND (u < hi OR is_last)),
given AS (SELECT cut.source, cut.n, count(slot) AS k FROM cut LEFT JOIN ranked ON ranked.source IS NOT DISTINCT FROM cut.source GROUP BY ALL),
slots AS (SELECT slot, source, rank FROM ranked WHERE rank * 256 < n
          UNION ALL SELECT slots + r, source, r FROM given, total, unnest(range(k, ((n + 255) // 256)::BIGINT)) AS x(r)),
pieces AS (SELECT doc_id, size, source, a + shift AS a, least(a + shift + size, n) AS z, row FROM l, unnest([0, source_size]) AS y(shift) WHERE size > 0),
blocks AS (SELECT row, source, unnest(range(a // 256, (z - 1) // 256 + 1)) AS rank FROM pieces WHERE z > a),
used AS (SELECT row, min(slot) AS first_slot, count(DISTINCT slot) AS n_slots FROM blocks b JOIN slots s ON s.source IS NOT DISTINCT FROM b.source AND s.rank = b.rank GROUP BY row)
SELECT doc_id, size, source, source_size, target,
       (greatest(0, least(a + size, n) - a) + greatest(0, least(a + size + source_size, n) - (a + source_size)))::BIGINT AS taken,
       first_slot, coalesce(n_slots, 0)::BIGINT AS n_slots
FROM l LEFT JOIN used ON used.row = l.row
"""

OP9 = r"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, text, ls[j] AS line, j FROM (SELECT doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS j FROM l)),
w AS (
  SELECT doc_id, text, line, j, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i
  FROM e WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
p AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM w),
-- pairs of places that start the same two lines; a run of them along a diagonal is a run of lines that also starts earlier
q AS (SELECT a.doc_id, a.i, b.doc_id AS other, a.i - b.i AS apart FROM p a JOIN p b ON a.line = b.line AND a.next = b.next
      WHERE b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.i < a.i)),
r AS (SELECT doc_id, min(i) AS i, max(i) + 2 AS upto FROM
      (SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, apart ORDER BY i) AS run FROM q) GROUP BY doc_id, other, apart, run),
g AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS nth FROM w WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50),
s AS (SELECT doc_id, i, max(upto) AS upto FROM (SELECT * FROM r UNION ALL SELECT doc_id, i, i + 1 FROM g WHERE nth > 1) GROUP BY doc_id, i),
-- of these the runs that lie in no other
m AS (SELECT * FROM s QUALIFY upto > coalesce(max(upto) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, upto)) AS i FROM m),
marked AS (SELECT e.doc_id, e.j, e.line, w.i, gone.i IS NOT NULL AS del
           FROM e LEFT JOIN w ON e.doc_id = w.doc_id AND e.j = w.j LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i),
runs AS (SELECT doc_id, count(*) AS n_runs, max(upto - i) AS longest_run FROM m GROUP BY doc_id)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (del))::BIGINT AS n_deleted, coalesce(any_value(n_runs), 0)::BIGINT AS n_runs,
       coalesce(any_value(longest_run), 0)::BIGINT AS longest_run, sha256(coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (NOT del), '')) AS kept_sha256
FROM marked k LEFT JOIN runs ON runs.doc_id = k.doc_id GROUP BY k.doc_id
"""

ORACLES = {"op2_arc_to_warc": OP2, "op3_source_mixing": OP3, "op9_line_runs": OP9}
