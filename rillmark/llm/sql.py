"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from rillmark.llm import licenses

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

OP2 = """
WITH records AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
placed AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original,
         count(*) OVER (PARTITION BY payload_digest) > 1 AND payload_bytes >= 1000 AS repeated
  FROM records)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN repeated AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN repeated AND page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM placed
"""

OP3 = f"""
WITH docs AS (
  SELECT doc_id, source, {_WORDS}::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || CASE WHEN doc_id IS NULL THEN coalesce(md5(text), '')
          ELSE '' END), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS draw
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM docs GROUP BY source),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source) AS k,
         sum(source_size) OVER ()::HUGEINT AS total FROM sources),
summed AS (
  SELECT *, coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS below,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS open
  FROM ordered),
first_open AS (
  SELECT min(k) AS k FROM summed WHERE NOT (4 * source_size * open < weight * (3 * total - 4 * below))),
level AS (
  SELECT s.k, (3 * total - 4 * below)::DOUBLE / open::DOUBLE / 2 AS level FROM summed s JOIN first_open USING (k)),
goals AS (
  SELECT source, source_size, CASE WHEN s.k < level.k THEN source_size::DOUBLE * 2 ELSE weight::DOUBLE * level END AS target
  FROM summed s, level),
rated AS (
  SELECT doc_id, size, source_size, target, draw, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM docs JOIN goals ON docs.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size, source_size, target,
       size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM rated
"""

def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _license_words(text: str) -> str:
    spaced = (f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || "
              f"{_text(licenses.PUNCTUATION[5:])}, 'abcdefghijklmnopqrstuvwxyz{' ' * len(licenses.PUNCTUATION)}')")
    return f"regexp_extract_all({spaced}, '[^ ]+')"


OP4 = f"""
WITH templates(license, template) AS (VALUES {', '.join(f'({_text(k)}, {_text(v)})' for k, v in licenses.TEMPLATES.items())}),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_license_words("coalesce(text, '')")} AS w
         FROM documents),
own AS (
  SELECT DISTINCT license, w[i:i + 4] AS shingle
  FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i
        FROM (SELECT license, {_license_words("template")} AS w FROM templates))),
sizes AS (SELECT license, count(*) AS shingles FROM own GROUP BY license),
found AS (
  SELECT r, doc_id, license, count(DISTINCT shingle) AS matched, min(i) - 1 AS first_word
  FROM (SELECT r, doc_id, w[i:i + 4] AS shingle, i FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs))
  JOIN own USING (shingle) GROUP BY r, doc_id, license)
SELECT doc_id, license, matched::BIGINT AS matched, shingles::BIGINT AS shingles, matched::DOUBLE / shingles AS containment,
       first_word::BIGINT AS first_word
FROM found JOIN sizes USING (license) WHERE matched::DOUBLE / shingles >= 0.8
"""

OP6 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY r),
lines AS (
  SELECT r, line, count(*) AS copies
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
counted AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
         len(regexp_extract_all(line, '[|»›•·>]|[\x20\x09-\x0D]/[\x20\x09-\x0D]')) AS separators, len(regexp_extract_all(line, '\p{Lu}{2,}')) AS capitals,
         length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars
  FROM lines),
judged AS (
  SELECT r, sum(copies - 1) AS dup, sum(CASE WHEN
           3 * symbols > n OR (n >= 3 AND (3 * separators > n OR 2 * capitals > n))
           OR (n >= 10 AND NOT regexp_matches(line, '[.!?…:;。！？،؟]'))
           OR (n <= 12 AND 4 * (length(lower(line)) - length(regexp_replace(lower(line), 'cookie|javascript|privacy policy|terms of use|terms of service|all rights reserved|click here|read more|sign in|log in|subscribe|newsletter|skip to content|share this|lorem ipsum', '', 'g'))) >= length(lower(line)))
         THEN 0 ELSE chars END) AS clean
  FROM counted GROUP BY r),
facts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(clean, 0)::BIGINT AS clean_chars
  FROM docs JOIN words USING (r) LEFT JOIN judged USING (r) LEFT JOIN covered USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND clean_chars >= 0.7::DOUBLE * word_chars AS kept
FROM facts
"""

def _leaf_part(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"


OP13 = f"""
WITH RECURSIVE documents_ AS (
  SELECT doc_id, source, lang, n_chars, text,
         list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: i::UBIGINT)),
             lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END)) AS crc
  FROM documents),
hashed AS (
  SELECT *, sha256({" || ".join(map(_leaf_part, ("doc_id","source","lang","n_chars","text")))}) AS leaf,
         CASE WHEN xor(crc, 4294967295::UBIGINT) % 7 = 0 THEN
         sha256({" || ".join(map(_leaf_part, ("doc_id","source","lang")))} || {_leaf_part("(n_chars + 1)")} || {_leaf_part("text")}) END AS tampered
  FROM documents_),
leaves AS (
  SELECT doc_id, lang, leaf, coalesce(tampered, leaf) AS claimed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM hashed),
nodes(lang, level, pos, n, digest) AS (
  SELECT lang, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (
  SELECT lang, level AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops(level, pos, n, digest) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (
  SELECT row_number() OVER () AS r, l.doc_id, l.leaf, l.claimed, l.lang, l.pos, s.subroot, s.height, s.pos AS top_pos,
         (SELECT digest FROM tops WHERE n = 1) AS root, (SELECT max(level) FROM tops) AS top_height
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang),
folds(r, level, digest, proof) AS (
  SELECT r, 0, claimed, '' FROM steps
  UNION ALL
  SELECT f.r, f.level + 1,
         CASE WHEN (CASE WHEN f.level < s.height THEN s.pos >> f.level ELSE s.top_pos >> (f.level - s.height) END) % 2 = 1
              THEN sha256(coalesce(x.digest, y.digest, '') || f.digest) ELSE sha256(f.digest || coalesce(x.digest, y.digest, '')) END,
         f.proof || coalesce(x.digest, y.digest, '')
  FROM folds f JOIN steps s ON f.r = s.r
  LEFT JOIN nodes x ON f.level < s.height AND x.lang IS NOT DISTINCT FROM s.lang AND x.level = f.level AND x.pos = xor(s.pos >> f.level, 1)
  LEFT JOIN tops y ON f.level >= s.height AND y.level = f.level - s.height AND y.pos = xor(s.top_pos >> (f.level - s.height), 1)
  WHERE f.level < s.height + s.top_height)
SELECT s.doc_id, s.leaf, s.subroot, s.root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root, f.digest = s.root AS verified
FROM steps s JOIN folds f ON s.r = f.r AND f.level = s.height + s.top_height
"""

ORACLES = {"op2_warc": OP2, "op3_mixing": OP3, "op4_licenses": OP4, "op6_quality": OP6, "op13_merkle": OP13}
