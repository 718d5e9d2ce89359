"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from corpusloom.llm.decontaminate import MASKS, SPAN

SQL: dict[str, str] = {}

SQL["op1_warc_revisits"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS d FROM p),
b AS (
  SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((('0x' || substr(d, CAST(i // 8 * 10 + 1 AS BIGINT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest
  FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY payload_digest) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY payload_digest) THEN NULL ELSE max(page_id) OVER (PARTITION BY payload_digest) END AS refers_to
FROM b
"""

SQL["op3_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes,
         length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|sep>|ans>|<SYS>>|</SYS>>|<ROLE>>|</ROLE>>|</TURN>>|INST\]|/INST\])', '\1\\\2\3', 'g')) AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(chars + CASE WHEN opens THEN CASE role WHEN 'user' THEN 7 WHEN 'assistant' THEN 5 WHEN 'system' THEN 7 ELSE 17 + length(role) END ELSE 5 END
         + CASE WHEN closes THEN CASE role WHEN 'user' THEN 8 WHEN 'assistant' THEN 4 WHEN 'system' THEN 8 ELSE 9 END ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_LEVELS = "\n".join(f"UNION ALL SELECT {d}, bits >> {60 - d}, sum(n_bytes) FROM r WHERE n_bytes <= 4194304 GROUP BY ALL" for d in range(1, 25))
SQL["op4_extendible_shards"] = f"""
WITH r AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS bits FROM documents),
s AS (SELECT 0 AS depth, CAST(0 AS BIGINT) AS bucket, sum(n_bytes) AS bytes FROM r WHERE n_bytes <= 4194304
{_LEVELS}),
leaf AS (
  SELECT r.doc_id, r.n_bytes, s.depth, s.bucket, s.bytes, row_number() OVER (PARTITION BY r.doc_id ORDER BY s.depth) AS k
  FROM r JOIN s ON s.bucket = r.bits >> (60 - s.depth) AND s.bytes <= 4194304)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(bucket), depth) END AS shard,
       CAST(depth AS INTEGER) AS depth, CAST(bytes AS BIGINT) AS shard_bytes
FROM leaf WHERE k = 1
"""

_WORD = r"[^\x20\x09-\x0D]+"
SQL["op7_host_quality"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM t WHERE n > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols / greatest(n_words, 1)::DOUBLE / 0.2::DOUBLE AS symbols, n_dup_lines / greatest(n_lines, 1)::DOUBLE / 0.6::DOUBLE AS dup_lines,
    CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE greatest(5.0::DOUBLE / (word_chars / n_words::DOUBLE), (word_chars / n_words::DOUBLE) / 7.0::DOUBLE) / 4.0::DOUBLE END AS word_length,
    n_repeat_words / greatest(n_words, 1)::DOUBLE / 0.4::DOUBLE AS repeats
  FROM m),
u AS (UNPIVOT (SELECT doc_id, source, symbols, dup_lines, word_length, repeats FROM f) ON symbols, dup_lines, word_length, repeats INTO NAME rule VALUE measure),
h AS (SELECT source, rule, count(*)::DOUBLE AS n, sum(CASE WHEN measure > 0.5 THEN 1 ELSE 0 END)::DOUBLE AS fails FROM u GROUP BY ALL),
p AS (SELECT rule, count(*) AS hosts, sum(n) AS total, sum(n * n) AS squares, sum(fails) / sum(n) AS m, sum(fails * fails / n) AS spread FROM h GROUP BY rule),
q AS (SELECT rule, m, CASE WHEN total - squares / total > 0 THEN (spread - total * m * m - (hosts - 1) * m * (1 - m)) / (total - squares / total) ELSE 0 END AS v FROM p),
s AS (SELECT rule, m, CASE WHEN v > 0 THEN least(1000000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1000000.0 END::DOUBLE AS k FROM q),
r AS (SELECT source, rule, CASE WHEN fails + m * k > 0 THEN least(2.0, greatest(0.5, m / ((fails + m * k) / (n + k)))) ELSE 1.0 END::DOUBLE AS allowed FROM h JOIN s USING (rule)),
v AS (SELECT doc_id, bool_or(measure > allowed) AS host_failed FROM u JOIN r ON r.rule = u.rule AND r.source IS NOT DISTINCT FROM u.source GROUP BY doc_id)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed, v.host_failed, NOT (f.base_failed OR v.host_failed) AS kept
FROM f JOIN v USING (doc_id)
"""

SQL["op2_minhash_neardup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id <= coalesce(m, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id
"""


def _seeds(table: str, key: str) -> str:
    """Masked words at every place of every row of ``table``, a branch per mask."""
    branches = []
    for number, mask in enumerate(MASKS):
        seed = " || chr(31) || ".join(f"w[i + {place}]" for place in mask)
        branches.append(f"SELECT id, i, {number} AS mask, {seed} AS seed FROM (SELECT {key} AS id, w, unnest(range(1, len(w) - {SPAN - 2})) AS i FROM {table} WHERE len(w) >= {SPAN})")
    return " UNION ALL ".join(branches)


SQL["op6_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
x AS ({_seeds('d', 'doc_id')}), y AS ({_seeds('b', 'item_id')}),
ys AS (SELECT item_id AS id, len(w) AS n, array_to_string(w, chr(31)) AS seed FROM b WHERE len(w) BETWEEN 1 AND {SPAN - 1}),
xs AS (SELECT id, n, i, array_to_string(w[i:i + n - 1], chr(31)) AS seed FROM (SELECT doc_id AS id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM ys))),
h AS (SELECT DISTINCT x.id AS doc_id, y.id AS item_id, x.i - y.i AS shift FROM x JOIN y ON x.mask = y.mask AND x.seed = y.seed
      UNION SELECT xs.id, ys.id, min(xs.i) - 1 FROM xs JOIN ys ON xs.n = ys.n AND xs.seed = ys.seed GROUP BY xs.id, ys.id),
p AS (
  SELECT doc_id, item_id, shift, d.w AS dw, b.w AS bw, unnest(range(greatest(shift, 0), least(len(d.w), shift + len(b.w)))) AS k
  FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
g AS (
  SELECT doc_id, item_id, shift, k, len(bw) AS n, sum(CASE WHEN dw[k + 1] = bw[k - shift + 1] THEN 2 ELSE -3 END) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k) AS s FROM p),
m AS (SELECT *, min(s) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM g),
o AS (SELECT doc_id, item_id, max(n) AS n, max(s - least(0, coalesce(low, 0))) AS score FROM m GROUP BY doc_id, item_id),
f AS (SELECT doc_id, count(*) AS n_items, min(item_id) AS first_item, max(score) AS best_score FROM o WHERE score >= least(26, n) GROUP BY doc_id)
SELECT d.doc_id, f.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, first_item, CAST(coalesce(best_score, 0) AS INTEGER) AS best_score
FROM d LEFT JOIN f USING (doc_id)
"""
