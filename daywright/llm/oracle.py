"""SQL counterparts of the queries that SQL can express on whole tables."""

from daywright.llm.line_dedup import MAX_RATIO, MIN_PAGES
from daywright.llm.spelling import FORM_RATIO, MIN_COUNT, MIN_LENGTH, SLIP

_OP7 = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM documents
), worded AS (
  SELECT *, trim(line, ' ') AS key, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS w FROM lines
), pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (
  SELECT k.source, k.key FROM (SELECT source, key, count(DISTINCT doc_id) AS n FROM worded WHERE w GROUP BY source, key) k
  JOIN pages p ON k.source IS NOT DISTINCT FROM p.source
  WHERE n >= {MIN_PAGES} AND n > {MAX_RATIO} * pages
), marked AS (
  SELECT l.*, b.key IS NOT NULL AS gone FROM worded l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.key = b.key AND l.w
)
SELECT doc_id, source, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS text,
       count(*) FILTER (WHERE gone) AS dropped_lines
FROM marked GROUP BY doc_id, source
"""

_OP8 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), placed AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, before IS NULL OR before <> role AS opens,
         length(text) + len(regexp_extract_all(text, '\\|<\||</?s>|\[/?INST\]')) AS chars,
         length(role) + len(regexp_extract_all(role, '\\|<\||</?s>|\[/?INST\]')) AS role_chars
  FROM placed
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(chars) + sum(CASE WHEN opens THEN 23 + role_chars ELSE 8 END))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_OP12 = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER staying AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER staying = 1 AS kept, sha256(norm) AS text_sha256
FROM normal WINDOW staying AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OP13 = f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM documents
), sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), whole
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""

# CRC-32 byte by byte: the table is made from the polynomial, bits reversed.
_OP11 = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents
), texts AS (
  SELECT run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(s)), lambda k:
      CAST(16 * (instr('0123456789ABCDEF', hex(encode(s))[2 * k + 1]) - 1) + instr('0123456789ABCDEF', hex(encode(s))[2 * k + 2]) - 1 AS BIGINT))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM texts, crc
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % {SLIP} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}
), less AS (
  SELECT word, k, left(word, k) || substr(word, k + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS k FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, w.word FROM less a JOIN words w ON w.word = a.rest
  UNION SELECT w.word, a.word FROM less a JOIN words w ON w.word = a.rest
), best AS (
  SELECT r.word, r.other, o.n, count(*) OVER (PARTITION BY r.word) AS n_near,
         row_number() OVER (PARTITION BY r.word ORDER BY o.n DESC, r.other) AS place
  FROM near r JOIN words o ON o.word = r.other
), formed AS (
  SELECT w.word, CASE WHEN b.n >= {FORM_RATIO} * w.n THEN b.other END AS form, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.n >= {FORM_RATIO} * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1
), walk AS (
  SELECT word, word AS at FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN walk w ON w.word = f.word JOIN formed e ON e.word = w.at AND e.form IS NULL
"""

ORACLE: dict[str, str] = {"op7_line_dedup": _OP7, "op8_chat_format": _OP8, "op11_spelling_variants": _OP11, "op12_exact_dedup": _OP12, "op13_ranked_search": _OP13}
