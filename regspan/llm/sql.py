"""SQL of the queries that DuckDB can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE concat(strlen(CAST({value} AS VARCHAR)), ':', {value}) END"


def _leaf(n_chars: str) -> str:
    return f"sha256(concat({', '.join(map(_field, ['doc_id', 'source', 'lang', n_chars, 'text']))}))"


#: CRC-32 of the decimal digits of doc_id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, bit: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))))"""

MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, coalesce('1' || lang, '0') AS k, {_leaf('n_chars')} AS leaf,
         CASE WHEN coalesce({_CRC} % 7 = 0, false) THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS told
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM d),
node AS (
  SELECT k, 0 AS level, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT k, level + 1, pos // 2, CAST(max(n) + 1 AS BIGINT) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY k, level, pos // 2),
sub AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, CAST(max(n) + 1 AS BIGINT) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2),
up AS (
  SELECT rid, p.k, 0 AS level, p.pos, p.n, told AS h, '' AS proof FROM (SELECT *, row_number() OVER () AS rid FROM placed) p
  UNION ALL
  SELECT rid, u.k, u.level + 1, u.pos // 2, (u.n + 1) // 2,
         sha256(CASE WHEN s.h IS NULL THEN u.h WHEN u.pos % 2 = 0 THEN u.h || s.h ELSE s.h || u.h END), u.proof || coalesce(s.h, '')
  FROM up u LEFT JOIN node s ON s.k = u.k AND s.level = u.level AND s.pos = xor(u.pos, 1) WHERE u.n > 1),
upper AS (
  SELECT rid, 0 AS level, sub.pos, sub.n, up.h, up.proof FROM up JOIN sub ON up.k = sub.k WHERE up.n = 1
  UNION ALL
  SELECT rid, u.level + 1, u.pos // 2, (u.n + 1) // 2,
         sha256(CASE WHEN s.h IS NULL THEN u.h WHEN u.pos % 2 = 0 THEN u.h || s.h ELSE s.h || u.h END), u.proof || coalesce(s.h, '')
  FROM upper u LEFT JOIN top s ON s.level = u.level AND s.pos = xor(u.pos, 1) WHERE u.n > 1)
SELECT p.doc_id, p.leaf, sub.subroot, r.root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified
FROM (SELECT *, row_number() OVER () AS rid FROM placed) p JOIN sub ON sub.k = p.k JOIN (SELECT rid, proof, h FROM upper WHERE n = 1) f ON f.rid = p.rid
CROSS JOIN (SELECT h AS root FROM top WHERE n = 1) r
"""

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEMP = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS t FROM documents),
whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS length FROM d WHERE len(t) > 0),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY rid, term),
asked AS (SELECT qid, item_id, term, count(*) AS times
          FROM (SELECT qid, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS qid, item_id, {_TERMS} AS t FROM benchmark)) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
           FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term), whole),
scored AS (
  SELECT qid, item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(t) * docs) // length)))) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN d USING (rid), whole GROUP BY qid, item_id, rid, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
