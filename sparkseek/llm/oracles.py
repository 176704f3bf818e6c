"""The same results in DuckDB's SQL, where SQL can express them."""

OP6 = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
classed AS (
  SELECT doc_id, size, coalesce('s' || source, '') AS s,
         CASE WHEN size < 16 THEN size
              ELSE length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 5, 0)) - 16 END AS class,
         CAST(floor(CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE)
              / 4294967296.0 * 1024) AS INTEGER) AS part
  FROM sized),
weighed AS (
  SELECT s, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY s = '', s) - 1) % 3 + 1] AS weight
  FROM classed GROUP BY s),
ordered AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS room_of,
         row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, s = '', s) AS position
  FROM weighed),
steps AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(room_of) OVER w, 0.0) AS room,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS heft
  FROM ordered WINDOW w AS (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rate AS (
  SELECT min(position) AS position, min_by(room, position) AS room, min_by(heft, position) AS heft
  FROM steps WHERE NOT room_of * heft <= weight * room),
targets AS (
  SELECT s, source_size,
         CASE WHEN r.position IS NULL OR steps.position < r.position THEN room_of
              ELSE weight * r.room / r.heft END AS target,
         CAST(CAST('0x' || substr(md5('mix' || substr(s, 2)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS shift
  FROM steps CROSS JOIN rate r),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY class, part, size, doc_id) AS place FROM classed),
crossed AS (
  SELECT doc_id, size, s, source_size, target, shift, place,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS expected
  FROM placed JOIN targets USING (s)),
taken AS (
  SELECT *, CAST(floor(expected * place + shift) - floor(expected * (place - 1) + shift) AS BIGINT) AS copies
  FROM crossed)
SELECT doc_id, size, CASE WHEN s <> '' THEN substr(s, 2) END AS source, source_size, target, copies,
       copies * size AS taken
FROM taken
"""

# Every control string of a text costs one backslash; the rest of a turn is 37 characters, its role and its text.
OP8 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(37 + length(role) + length(text)
                + len(regexp_extract_all(role || ' ' || text, '</?s>|\[/?(?:ROLE|INST)\]'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP13 = r"""
WITH read AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
terms AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM read),
kept AS (
  SELECT lang, term, count(*) AS total FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (
  SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY lang, source, term),
places AS (SELECT DISTINCT lang, source FROM read),
sizes AS (
  SELECT lang, source, coalesce(sum(n), 0) AS n FROM places LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
dense AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (s.n + 2 * l.v) AS p,
         1 + 1000000000::HUGEINT * (k.total + 2) // (l.n + 2 * l.v) AS q
  FROM sizes s JOIN langs l ON s.lang = l.lang JOIN kept k ON k.lang = s.lang
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
worth AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(w.value, 0) AS value
  FROM places a JOIN places b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN worth w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM dense WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLES = {"op13_source_divergence": OP13, "op6_source_mix": OP6, "op8_chat_format": OP8.replace("\\\\", "\\")}
