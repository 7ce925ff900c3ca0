"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from bandloom.llm.license_scan import FIRST_STEP, PHRASES, TEMPLATES, THRESHOLD, step_of

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _folded(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


def _values(rows: tuple[tuple[str, str], ...], names: str) -> str:
    return f"(VALUES {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(rows))}) AS v({names})"


OP5 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {_folded('text')} AS t FROM documents),
words AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{_WORD}') AS w FROM docs),
phrases AS (SELECT string_split(phrase, ' ') AS p, label FROM {_values(PHRASES, 'n, phrase, label')}),
starts AS (SELECT rid, w, unnest(range(len(w))) AS i FROM words),
hits AS (
  SELECT rid, i, label FROM starts JOIN phrases
  ON w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p),
base AS (
  SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels
  FROM hits GROUP BY rid),
templates AS (
  SELECT list_distinct(string_split(body, ' ')) AS s, label, step FROM {_values(TEMPLATES, 'n, body, label')}
  JOIN (VALUES {', '.join(f"({i}, {step_of(t)})" for i, (t, _) in enumerate(TEMPLATES))}) AS u(n, step) USING (n)),
spans AS (
  SELECT rid, w AS lw, step FROM words, (SELECT DISTINCT step FROM templates)
  UNION ALL
  SELECT rid, regexp_extract_all(unnest(string_split(t, chr(10))), '{_WORD}') AS lw, {FIRST_STEP} AS step FROM docs),
starts_of AS (
  SELECT rid, lw, step, unnest(list_concat([0], range(step, greatest(len(lw) - step, 0), step))) AS a FROM spans),
blocks AS (SELECT rid, step, list_distinct(lw[a + 1 : a + 2 * step]) AS b FROM starts_of),
joined AS (
  SELECT rid, label, len(list_intersect(s, b)) / len(s) AS share FROM blocks JOIN templates
  ON blocks.step = templates.step AND len(list_intersect(s, b)) / len(s) >= {THRESHOLD}),
found AS (SELECT rid, list(DISTINCT label) AS labels, max(share) AS score FROM joined GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
  first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score
FROM words LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)
"""

#: The generated pages mark their articles, hold no other element than those of the article inside, and use these references.
_REFERENCES = (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"))
_text = "regexp_replace(coalesce(regexp_extract(html, '<article>(.*)</article>', 1, 's'), ''), '<[^>]*>', ' ', 'g')"
for _name, _char in _REFERENCES:
    _text = f"replace({_text}, '{_name}', '{_char}')"
OP7 = f"""
WITH t AS (SELECT page_id, url, trim(regexp_replace({_text}, '\\s+', ' ', 'g')) AS text FROM pages)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""

OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP4 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_folded('text')}, '{_WORD}') AS w FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({_folded('text')}, '{_WORD}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, w[a + 1 : a + 10] AS p FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 9))) AS a FROM items WHERE len(w) > 0)),
keys AS (SELECT len(p) AS n, array_to_string(p, ' ') AS k, list(DISTINCT item) AS owners FROM windows GROUP BY ALL),
sizes AS (SELECT DISTINCT n FROM keys),
places AS (SELECT rid, n, a, array_to_string(w[a + 1 : a + n], ' ') AS k
  FROM (SELECT rid, w, n, unnest(range(len(w) - n + 1)) AS a FROM docs JOIN sizes ON len(w) >= n)),
hits AS (SELECT rid, places.n, a, owners FROM places JOIN keys ON places.n = keys.n AND places.k = keys.k),
words AS (SELECT rid, count(DISTINCT i) AS n_hit FROM (SELECT rid, unnest(range(a, a + n)) AS i FROM hits) GROUP BY rid),
owned AS (SELECT rid, list_sort(list(DISTINCT item)) AS names FROM (SELECT rid, unnest(owners) AS item FROM hits) WHERE item IS NOT NULL GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(names), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN owned USING (rid)
"""

_ENDS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP10 = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT rid, doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM docs),
keyed AS (SELECT *, translate(trim(line, {_ENDS}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10),
marked AS (SELECT keyed.*, common.k IS NOT NULL AS gone FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""

#: CRC-32 by its table of 256 entries, made from the polynomial; {bytes} of a text as numbers.
_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i)))"""


def _crc(text: str) -> str:
    data = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), (2 * k + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(list_reduce({data}, lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295::BIGINT), 4294967295)"


OP12 = f"""
WITH {_CRC_TABLE},
words AS (
  SELECT row_number() OVER () AS rid, false AS target, doc_id, regexp_extract_all({_folded('text')}, '{_WORD}') AS w FROM documents
  UNION ALL
  SELECT NULL, true, NULL, regexp_extract_all({_folded('text')}, '{_WORD}') FROM benchmark),
features AS (
  SELECT rid, target, unnest(w) AS f FROM words
  UNION ALL
  SELECT rid, target, unnest(list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2])) FROM words),
coded AS (SELECT f, {_crc('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features), crc_table),
counted AS (SELECT rid, target, bucket FROM features JOIN coded USING (f)),
totals AS (SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM counted GROUP BY bucket),
whole AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM totals),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM totals, whole),
sums AS (SELECT rid, count(*) AS n, sum(gain) AS g FROM counted JOIN gains USING (bucket) WHERE NOT target GROUP BY rid),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(g::DOUBLE / n), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM words LEFT JOIN sums USING (rid) WHERE NOT target),
final AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
drawn AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS r,
    count(*) FILTER (n_words >= 20) OVER () AS n_all FROM final)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * n_all // 100 THEN r END::BIGINT AS rank FROM drawn
"""

#: Factors of up to 2^16 words: periods up to 65 536 words.
_LEVELS = 17


def _level(k: int) -> str:
    if k == 0:
        return "l0 AS MATERIALIZED (SELECT rid, i, hash(word) AS h FROM places QUALIFY count(*) OVER (PARTITION BY rid, h) > 1)"
    return f"""l{k} AS MATERIALIZED (
  SELECT a.rid, a.i, hash(a.h, b.h) AS h FROM l{k - 1} a JOIN l{k - 1} b ON a.rid = b.rid AND b.i = a.i + {1 << (k - 1)}
  QUALIFY count(*) OVER (PARTITION BY a.rid, hash(a.h, b.h)) > 1)"""


OP13 = f"""
WITH {_CRC_TABLE},
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0,
    coalesce({_crc('doc_id::VARCHAR')}, 1) AS h FROM documents, crc_table),
planted AS (SELECT *, len(w0) AS n, h // 10 AS g, CASE WHEN len(w0) > 0 THEN (h // 10) % len(w0) END AS a FROM docs),
stepped AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM planted),
words AS (
  SELECT rid, doc_id, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: w0[(CASE WHEN i >= a THEN a + (i - a) % p ELSE i END) + 1]) ELSE w0 END AS w FROM stepped),
places AS MATERIALIZED (SELECT rid, unnest(range(len(w))) AS i, unnest(w) AS word FROM words),
{", ".join(_level(k) for k in range(_LEVELS))},
steps AS (
  {" UNION ALL ".join(f"SELECT rid, i, {1 << k} AS size, lead(i) OVER (PARTITION BY rid, h ORDER BY i) - i AS d FROM l{k}" for k in range(_LEVELS))}),
near AS (SELECT *, i - row_number() OVER (PARTITION BY rid, size, d ORDER BY i) AS island FROM steps WHERE d > size // 2 AND d <= size),
runs AS MATERIALIZED (
  SELECT rid, min(i) AS start, count(*) - 1 + any_value(size) + d AS length, d AS period FROM near GROUP BY rid, size, d, island
  HAVING count(*) - 1 + any_value(size) + d >= greatest(24, 3 * d)),
listed AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY rid),
best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length::DOUBLE / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS t FROM places ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM words LEFT JOIN listed USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""

ORACLE_SQL: dict[str, str] = {"op4_decontamination": OP4, "op5_license_scans": OP5, "op7_html_extraction": OP7, "op9_exact_topk": OP9, "op10_line_dedup": OP10, "op12_target_resampling": OP12, "op13_periodic_runs": OP13}
