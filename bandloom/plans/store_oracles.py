"""DuckDB SQL of the queries of plans.stores."""

from __future__ import annotations

from bandloom.plans.oracles import _CTE, _DCT, _GRAD, _IMAGES, _table, _with
from bandloom.plans.oracles import ORACLE_SQL as SQL
from bandloom.plans.stores import DIM, FLOOR

#: Pixels of the mixed images, padded to whole blocks by their last row and column, then their quantised coefficients:
#: q (image_id, patch, brow, bcol, c, pos, v) and sz (image_id, h, w, nph, npw).
_MIXED = f"""WITH {_CTE['basis']}, {_CTE['zz']}, {_IMAGES}, qt AS ({_table(95)}),
sz AS (SELECT *, (h + 7) // 8 AS nph, (w + 7) // 8 AS npw FROM (SELECT image_id, (image_id % 10)::INTEGER AS label, 40 - image_id % 10 % 4 * 7 AS h, 32 - image_id % 3 * 9 AS w FROM im)),
p3 AS (SELECT vec_id // 60 AS image_id, vec_id // 20 % 3 AS c, vec_id % 20 // 4 * 8 + i // 8 AS y, vec_id % 20 % 4 * 8 + i % 8 AS x, (embedding[i + 1]::DOUBLE + 1) / 2 * 255 AS v FROM embeddings, range(64) t(i)),
rgb AS (SELECT image_id, y, x, max(CASE WHEN c = 0 THEN v END) AS r, max(CASE WHEN c = 1 THEN v END) AS g, max(CASE WHEN c = 2 THEN v END) AS b FROM p3 JOIN im USING (image_id) GROUP BY ALL),
grown AS (SELECT sz.image_id, npw, ty, tx, r, g, b FROM sz, range(40) ry(ty), range(32) rx(tx), rgb WHERE ty < nph * 8 AND tx < npw * 8 AND rgb.image_id = sz.image_id AND rgb.y = least(ty, h - 1) AND rgb.x = least(tx, w - 1)),
blk AS (SELECT image_id, ty // 8 AS brow, tx // 8 AS bcol, ty // 8 * npw + tx // 8 AS patch, ty % 8 AS y, tx % 8 AS x, r, g, b FROM grown),
yc AS (SELECT image_id, brow, bcol, patch, y, x, 0 AS c, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b - 128 AS p FROM blk
  UNION ALL SELECT image_id, brow, bcol, patch, y, x, 1, -0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b FROM blk
  UNION ALL SELECT image_id, brow, bcol, patch, y, x, 2, 0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b FROM blk),
hs AS (SELECT image_id, brow, bcol, patch, c, k AS u, x, sum(value * p) AS s FROM yc JOIN basis ON basis.i = y GROUP BY ALL),
d AS (SELECT image_id, brow, bcol, patch, c, u, k AS w, sum(value * s) AS v FROM hs JOIN basis ON basis.i = x GROUP BY ALL),
q AS (SELECT image_id, brow, bcol, patch, d.c, u, w, pos, CASE WHEN pos < 1 THEN 0 WHEN pos < 6 THEN 1 WHEN pos < 21 THEN 2 ELSE 3 END AS band_id, round_even(v / q, 0) * q AS v
  FROM d JOIN zz ON u = zz.r AND w = zz.c JOIN qt ON channel = d.c AND "natural" = u * 8 + w)"""
_PIXELS = f"""{_MIXED},
ih AS (SELECT image_id, brow, bcol, c, w, i AS y, sum(value * v) AS s FROM q JOIN basis ON k = u WHERE pos < 21 GROUP BY ALL),
sp AS (SELECT image_id, brow, bcol, c, y, i AS x, sum(value * s) AS v FROM ih JOIN basis ON k = w GROUP BY ALL),
co AS (SELECT image_id, brow * 8 + y AS y, bcol * 8 + x AS x, max(CASE WHEN c = 0 THEN v END) + 128 AS l, max(CASE WHEN c = 1 THEN v END) AS cb, max(CASE WHEN c = 2 THEN v END) AS cr FROM sp GROUP BY ALL),
px AS (SELECT image_id, y, x, n, greatest(0.0, least(1.0, CASE n WHEN 0 THEN l + 1.402::DOUBLE * cr WHEN 1 THEN l - 0.344136::DOUBLE * cb - 0.714136::DOUBLE * cr ELSE l + 1.772::DOUBLE * cb END / 255)) AS v FROM co, range(3) t(n))"""
ORACLE_SQL: dict[str, str] = {}
ORACLE_SQL["packed_crops"] = f"""{_PIXELS},
want AS (SELECT *, image_id * 7 % 8 AS t, image_id * 5 % 6 AS l, least(11, h - image_id * 7 % 8) AS ch, least(8, w - image_id * 5 % 6) AS cw FROM sz)
SELECT image_id, (n * ch * cw + (y - t) * cw + x - l)::INTEGER AS i, round(v, 4) + 0.0 AS value
FROM px JOIN want USING (image_id) WHERE y >= t AND y < t + ch AND x >= l AND x < l + cw"""
# A value is two bytes; three channels, and 1 + 5 + 43 values of a block in bands 0, 1 and 3.
ORACLE_SQL["packed_crop_bytes"] = f"""WITH {_IMAGES},
sz AS (SELECT *, (h + 7) // 8 AS nph, (w + 7) // 8 AS npw, image_id * 7 % 8 AS t FROM (SELECT image_id, 40 - image_id % 10 % 4 * 7 AS h, 32 - image_id % 3 * 9 AS w FROM im)),
cells AS (SELECT image_id, ty * ((npw + 1) // 2) + tx AS tile_id, least(2, nph - 2 * ty) * least(2, npw - 2 * tx) AS n FROM sz, range(3) a(ty), range(2) b(tx)
  WHERE 2 * ty < least(nph, (t + 16) // 8) AND 2 * ty + 2 > t // 8 AND 2 * tx < least(npw, 2) AND 2 * tx < npw AND 2 * ty < nph)
SELECT (image_id // 2)::INTEGER AS shard_id, sum(n * 3 * (6 + 43) * 2)::BIGINT AS bytes_opened FROM cells GROUP BY ALL"""
ORACLE_SQL["packed_ranges"] = f"""{_MIXED}
SELECT image_id, band_id::INTEGER AS band_id, count(DISTINCT (patch, c))::BIGINT AS cells, round(sum(abs(v)), 3) AS total, (2 * count(*))::BIGINT AS bytes_opened
FROM q JOIN sz USING (image_id) WHERE image_id >= 3 AND band_id IN (0, 2) AND brow // 2 * ((npw + 1) // 2) + bcol // 2 <= 2 GROUP BY ALL"""
ORACLE_SQL["packed_manifest"] = f"""WITH {_IMAGES},
sz AS (SELECT image_id, (40 - image_id % 10 % 4 * 7 + 7) // 8 AS nph, (32 - image_id % 3 * 9 + 7) // 8 AS npw FROM im),
rows AS (SELECT image_id, nph, npw, '' AS batch FROM sz UNION ALL SELECT image_id + ((SELECT max(image_id) FROM sz) // 2 + 1) * 2, nph, npw, 'stream 0' FROM sz WHERE image_id < 4)
SELECT (image_id // 2)::INTEGER AS shard_id, count(*)::BIGINT AS images, sum(((nph + 1) // 2) * ((npw + 1) // 2) * 4)::BIGINT AS chunks, sum(nph * npw * 3 * 64 * 2)::BIGINT AS bytes,
  min(image_id)::BIGINT AS first_image, max(image_id)::BIGINT AS last_image, batch FROM rows GROUP BY ALL"""

_SAMPLES = """docs AS (SELECT doc_id AS id, 'd/k' || doc_id * 7919 % 100003 AS key, coalesce(text, '') AS t, (length(text) % 10)::INTEGER AS label, doc_id // 64 AS shard,
  row_number() OVER (PARTITION BY doc_id // 64 ORDER BY doc_id) - 1 AS position FROM documents WHERE doc_id IS NOT NULL)"""
# A sample is two headers of 512 bytes, the image and the label, both padded to 512.
ORACLE_SQL["tar_index"] = f"""WITH {_SAMPLES}, n AS (SELECT *, octet_length(encode(t)) AS size FROM docs),
spot AS (SELECT *, coalesce(sum(1536 + (size + 511) // 512 * 512) OVER (PARTITION BY shard ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM n)
SELECT shard::INTEGER AS shard, position::INTEGER AS position, key, (start + 512)::BIGINT AS image_offset, size::BIGINT AS image_length,
  (start + 1024 + (size + 511) // 512 * 512)::BIGINT AS label_offset, 1::BIGINT AS label_length FROM spot"""
ORACLE_SQL["tar_by_key"] = f"""WITH {_SAMPLES}
SELECT kind, shard::INTEGER AS shard, position::INTEGER AS position, key, sha256(t) AS sha, label FROM docs, (VALUES ('key'), ('tail')) k(kind)
WHERE (kind = 'key' AND label = 3) OR (kind = 'tail' AND position >= 50)"""
ORACLE_SQL["tar_stream"] = f"WITH {_SAMPLES} SELECT key, sha256(t) AS sha, label, count(*)::BIGINT AS times FROM docs GROUP BY ALL"
ORACLE_SQL["streamed_pixels"] = _PIXELS.replace("(embedding[i + 1]::DOUBLE + 1) / 2 * 255 AS v", f"(floor((embedding[i + 1]::DOUBLE + 1) / 2 * 255) / 255 * {DIM}::DOUBLE + {FLOOR}::DOUBLE) * 255 AS v").replace(" WHERE pos < 21", "") + """
SELECT image_id, label, image_id || '-' || h || '-' || w AS source_key, (n * h * w + y * w + x)::INTEGER AS i, round(v, 4) + 0.0 AS value FROM px JOIN sz USING (image_id) WHERE y < h AND x < w"""

ORACLE_SQL["tar_shuffled"] = ORACLE_SQL["tar_stream"]
ORACLE_SQL["buffer_shuffled"] = "SELECT vec_id, label, round(embedding[1]::DOUBLE, 9) + 0.0 AS head FROM embeddings"
ORACLE_SQL["scan_manifest"] = f"""WITH {_SAMPLES}, d AS (SELECT *, octet_length(encode(t)) AS size FROM docs),
held AS (
  SELECT 0 AS step, * FROM d WHERE shard % 10 < 9
  UNION ALL SELECT step, d.* FROM d, (VALUES (1), (2), (3)) v(step) WHERE shard <> 2 AND (shard <> 1 OR label < 8) AND (step < 3 OR label < 6)),
n AS (SELECT 0 AS step, count(DISTINCT shard) AS scanned FROM d WHERE shard % 10 < 9
  UNION ALL SELECT 1, count(DISTINCT shard) FROM d WHERE shard % 10 = 9 OR shard = 1
  UNION ALL SELECT 2, 0 UNION ALL SELECT 3, count(DISTINCT shard) FROM d WHERE shard <> 2)
SELECT step::INTEGER AS step, scanned::BIGINT AS scanned, shard::INTEGER AS shard, count(*)::BIGINT AS docs, sum(size)::BIGINT AS bytes FROM held JOIN n USING (step) GROUP BY ALL"""
ORACLE_SQL["pilot_schedules"] = """WITH e AS (SELECT user_id % 6 AS run, event_id % 10 AS epoch, count(*) AS n, sum(event_id) AS s FROM events GROUP BY ALL),
pilot AS (SELECT run, 'k' AS kind, epoch, 1 + s % 16 AS v FROM e UNION ALL SELECT run, 'q', epoch, 1 + (s + n) % 20 FROM e),
sums AS (SELECT *, sum(v) OVER w AS s, row_number() OVER w AS n FROM pilot WINDOW w AS (PARTITION BY run, kind ORDER BY epoch)),
spans AS (SELECT a.run, a.kind, a.n AS i, b.n AS j, (b.s - a.s + a.v)::DOUBLE / (b.n - a.n + 1) AS m FROM sums a JOIN sums b ON a.run = b.run AND a.kind = b.kind AND a.n <= b.n),
least_ AS (SELECT t.run, t.kind, t.epoch, i, min(m) AS m FROM sums t JOIN spans p ON t.run = p.run AND t.kind = p.kind AND i <= t.n AND t.n <= j GROUP BY ALL),
iso AS (SELECT run, kind, epoch, max(m) AS fitted FROM least_ GROUP BY ALL),
ends AS (SELECT run, kind, count(*) AS n, arg_min(fitted, epoch) AS f, arg_max(fitted, epoch) AS l FROM iso GROUP BY ALL),
g AS (SELECT ends.run, ends.kind, t.epoch, greatest(1.0, least(CASE WHEN ends.kind = 'k' THEN 16.0 ELSE 20.0 END, coalesce(fitted, l + (l - f) / greatest(n - 1, 1) * (t.epoch - n + 1)))) AS v
  FROM range(40) t(epoch) CROSS JOIN ends LEFT JOIN iso ON iso.epoch = t.epoch AND iso.run = ends.run AND iso.kind = ends.kind)
SELECT run::INTEGER AS run, kind, epoch::INTEGER AS epoch, round_even(round(max(v) OVER (PARTITION BY run, kind ORDER BY epoch), 9), 0)::INTEGER AS value FROM g"""
ORACLE_SQL["sensitivity_residual"] = _with(_GRAD, "gz AS (SELECT image_id, patch, label, zz.r AS u, zz.c AS w, g FROM grad JOIN zz USING (pos) WHERE band_id >= 4)",
    "gh AS (SELECT image_id, patch, label, w, i AS y, sum(value * g) AS s FROM gz JOIN basis ON k = u GROUP BY ALL)", "gp AS (SELECT image_id, patch, label, y, i AS x, sum(value * s) AS g FROM gh JOIN basis ON k = w GROUP BY ALL)",
    "st AS (SELECT label AS epoch, image_id, patch, sum(abs(g)) AS v FROM gp GROUP BY ALL)", "me AS (SELECT epoch, patch, avg(v) AS v FROM st GROUP BY ALL)") + "SELECT epoch, patch::INTEGER AS idx, round(v / (sum(v) OVER (PARTITION BY epoch) + 1e-8), 9) AS value FROM me"
ORACLE_SQL["replica_metrics"] = f"""WITH eq AS ({SQL['equalised_batches']}),
s AS (SELECT place AS step, count(*)::DOUBLE AS rows, sum(label)::DOUBLE AS labels FROM embeddings JOIN eq ON shard_id = vec_id // 48 AND batch_no = vec_id % 48 // 10 GROUP BY ALL)
SELECT rank::INTEGER AS rank, step, metric, CASE metric WHEN 'rows' THEN rows ELSE labels END AS total FROM s, range(3) r(rank), (VALUES ('rows'), ('labels')) m(metric)"""
ORACLE_SQL["quantised_store"] = f"""WITH {_CTE['basis']}, {_CTE['zz']}, {_IMAGES},
sz AS (SELECT *, (h + 7) // 8 AS nph, (w + 7) // 8 AS npw FROM (SELECT image_id, 40 - image_id % 10 % 4 * 7 AS h, 32 - image_id % 3 * 9 AS w FROM im)),
bu AS (SELECT nph, npw, row_number() OVER (ORDER BY nph, npw) - 1 AS bucket_id, least(3, greatest(1, floor(60000 / (3.0 * nph * 8 * npw * 8 * 4 * 2))))::BIGINT AS chunk FROM (SELECT DISTINCT nph, npw FROM sz)),
pl AS (SELECT image_id, bucket_id, (at_ // chunk)::INTEGER AS chunk_id, (at_ % chunk)::INTEGER AS chunk_pos FROM (SELECT image_id, nph, npw, row_number() OVER (PARTITION BY nph, npw ORDER BY image_id) - 1 AS at_ FROM sz) JOIN bu USING (nph, npw)),
p3 AS (SELECT vec_id // 60 AS image_id, vec_id // 20 % 3 AS c, vec_id % 20 // 4 * 8 + i // 8 AS y, vec_id % 20 % 4 * 8 + i % 8 AS x, (embedding[i + 1]::DOUBLE + 1) / 2 AS v FROM embeddings, range(64) t(i)),
cells AS (SELECT image_id, c, y // 8 * npw + x // 8 AS patch, y % 8 AS y, x % 8 AS x, CASE WHEN y < h AND x < w THEN v ELSE 0 END AS p FROM p3 JOIN sz USING (image_id) WHERE y < nph * 8 AND x < npw * 8),
hs AS (SELECT image_id, patch, c, k AS u, x, sum(value * p) AS s FROM cells JOIN basis ON basis.i = y GROUP BY ALL),
d AS (SELECT image_id, bucket_id, patch, hs.c, least(pos // 4, 15) AS band_id, v FROM (SELECT image_id, patch, c, u, k AS w, sum(value * s) AS v FROM hs JOIN basis ON basis.i = x GROUP BY ALL) hs JOIN zz ON u = zz.r AND w = zz.c JOIN pl USING (image_id)),
sc AS (SELECT bucket_id, c, band_id, greatest(max(abs(v)) / 127, 1e-12) AS scale FROM d GROUP BY ALL),
e AS (SELECT image_id, d.c, count(DISTINCT patch) AS blocks, sum(pow(greatest(-128, least(127, round_even(v::FLOAT::DOUBLE / scale, 0))) * scale, 2)) AS energy FROM d JOIN sc ON d.bucket_id = sc.bucket_id AND d.c = sc.c AND d.band_id = sc.band_id GROUP BY ALL)
SELECT image_id, c::INTEGER AS channel, blocks::BIGINT AS blocks, round(energy, 3) AS energy, bucket_id::INTEGER AS bucket_id, chunk_id, chunk_pos FROM e JOIN pl USING (image_id)"""
ORACLE_SQL["random_patches"] = _with(_DCT, "d AS (SELECT p AS patch, row_number() OVER (ORDER BY md5(concat_ws(':', 11, p))) - 1 AS drawn FROM range(20) t(p))",
    "f AS (SELECT z.*, drawn < 4 + image_id % 3 * 5 AS chosen, 4 * (1 + image_id % 3 * 4) AS width FROM z JOIN d USING (patch))") + "SELECT image_id, patch::INTEGER AS patch, chosen, round(sum(CASE WHEN chosen OR pos < width THEN v * v ELSE 0 END), 6) + 0.0 AS energy FROM f GROUP BY ALL"

# --- queries of plans.measured ---

_RUNS = """e AS (SELECT user_id % 9 AS run, count(*) AS n, sum(event_id) AS s FROM events GROUP BY ALL),
runs AS (SELECT run, 5 + n % 30 AS total, n % 4 AS warmup, 0.3::DOUBLE + s % 10 / 100.0::DOUBLE AS start, 0.7::DOUBLE + s % 7 / 25.0::DOUBLE AS fin, 1 + n % 3 / 2.0::DOUBLE AS gamma, 4 + s % 50 AS patches, 0.1::DOUBLE + n % 5 / 10.0::DOUBLE AS base FROM e)"""


def _budgets(beyond: int) -> str:
    return f"""WITH {_RUNS}, at AS (SELECT *, unnest(range(total + {beyond})) AS epoch FROM runs),
b AS (SELECT *, greatest(patches, least(patches * 16, round_even(patches * 16 * (start + (fin - start) * pow(least(epoch, total - 1) / greatest(total - 1, 1)::DOUBLE, gamma)), 0))) AS budget,
  CASE WHEN epoch < warmup THEN base * (epoch + 1) / greatest(warmup, 1)::DOUBLE ELSE base * 0.5 * (1 + cos(pi() * least(1.0, (epoch - warmup) / greatest(total - warmup, 1)::DOUBLE))) END AS lr FROM at)
""".replace("at AS (", "ats AS (").replace("FROM at)", "FROM ats)")


ORACLE_SQL["run_budgets"] = _budgets(5) + "SELECT run::INTEGER AS run, epoch::INTEGER AS epoch, budget::BIGINT AS budget, round(budget / (patches * 16), 9) AS io_ratio, round(lr, 9) + 0.0 AS lr FROM b"
ORACLE_SQL["run_budget_summary"] = _budgets(0) + "SELECT run::INTEGER AS run, arg_min(budget, epoch)::BIGINT AS first, arg_max(budget, epoch)::BIGINT AS last, round(avg(budget / (patches * 16)), 9) AS avg_io FROM b GROUP BY run"
ORACLE_SQL["nested_mask_energy"] = _with(_DCT, "m AS (SELECT image_id, least(pos // 12, 4) AS band, sum(v * v) AS e FROM z GROUP BY ALL)") + "SELECT image_id, level::INTEGER AS level, round(sum(e), 6) AS energy FROM m, range(5) l(level) WHERE band <= level GROUP BY ALL"
ORACLE_SQL["uniform_fidelity"] = _with(_DCT, "u AS (SELECT *, least(16, greatest(1, ceil(round(label / 9.0::DOUBLE * 16, 12))))::INTEGER AS k FROM z)") + "SELECT label, k, count(DISTINCT (image_id, patch))::BIGINT AS blocks, round(sum(CASE WHEN pos >= k * 4 THEN v * v ELSE 0 END), 6) + 0.0 AS sq_error FROM u GROUP BY ALL"
ORACLE_SQL["matched_fidelity"] = """WITH e AS (SELECT (event_id % 24)::INTEGER AS part, round(avg(abs(value) / (1 + abs(value))), 6) AS target FROM events WHERE value IS NOT NULL GROUP BY ALL),
low AS (SELECT target, k, k / 16.0::DOUBLE AS ratio, row_number() OVER (PARTITION BY target ORDER BY round(abs(k / 16.0::DOUBLE - target), 12), k) AS p FROM (SELECT DISTINCT target FROM e), range(1, 17) a(k)),
pair AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(abs(ratio - target), 12), k, q) AS p FROM (SELECT target, k, q, k / 16.0::DOUBLE + (1 - k / 16.0::DOUBLE) * (q / 20.0::DOUBLE) AS ratio FROM (SELECT DISTINCT target FROM e), range(1, 17) a(k), range(1, 21) b(q)))
SELECT part, target, low.k::INTEGER AS low_k, round(low.ratio, 9) AS low_ratio, pair.k::INTEGER AS k, pair.q::INTEGER AS q, round(pair.ratio, 9) AS ratio FROM e JOIN low USING (target) JOIN pair USING (target) WHERE low.p = 1 AND pair.p = 1"""
ORACLE_SQL["refoldered"] = f"WITH {_SAMPLES} SELECT id, 'n0' || label AS class_name, (dense_rank() OVER (ORDER BY 'n0' || label) - 1)::INTEGER AS label, sha256(t) AS sha FROM docs"
ORACLE_SQL["artefact_sizes"] = f"""WITH {_SAMPLES}, f AS (SELECT label AS folder, count(*) AS files, sum(octet_length(encode(t))) AS bytes FROM docs GROUP BY ALL),
w AS (SELECT count(*) AS n, avg(bytes) AS m, stddev_pop(bytes) AS s FROM f)
SELECT folder, files::BIGINT AS files, bytes::BIGINT AS bytes, n::BIGINT AS n, round(m, 3) AS mean_bytes, round(s, 3) AS std_bytes, round(m * 100000, 1) AS forecast_bytes FROM f, w"""
ORACLE_SQL["record_shards"] = """SELECT (vec_id // 100)::INTEGER AS file, (row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) - 1)::BIGINT AS position, label::INTEGER AS label,
  round(list_sum(list_transform(embedding, lambda x: floor((x::DOUBLE + 1) / 2 * 255) / 255.0::DOUBLE)), 6) + 0.0 AS total FROM embeddings"""
ORACLE_SQL["braced_archives"] = "SELECT (doc_id // 20)::INTEGER AS shard, count(*)::BIGINT AS samples, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes FROM documents WHERE doc_id // 20 IN (0, 1, 2, 3, 6, 7) GROUP BY ALL"
_HISTORY = """h AS (SELECT (user_id % 9)::VARCHAR AS run, event_id % 6 AS epoch, round(avg(abs(value)), 6) AS acc, 0.25 + count(*) % 64 / 128.0::DOUBLE AS io FROM events WHERE value IS NOT NULL GROUP BY ALL),
s AS (SELECT run, max(acc) AS best, arg_max(acc, epoch) AS final, avg(io) AS io FROM h GROUP BY run)"""
ORACLE_SQL["summary_lines"] = f"""WITH {_HISTORY} SELECT 0 AS place, '| run | best | final | I/O | saved |' AS line UNION ALL SELECT 1, '|---|---|---|---|---|'
UNION ALL SELECT (row_number() OVER (ORDER BY run) + 1)::INTEGER, format('| {{}} | {{:.2f}} | {{:.2f}} | {{:.3f}} | {{:.1f}} % |', run, best, final, io, (1 - io) * 100) FROM s"""
ORACLE_SQL["wanted_runs"] = f"WITH {_HISTORY} SELECT place::INTEGER AS place, run, round(best, 6) AS best, round(io, 9) AS avg_io FROM s JOIN (VALUES ('7', 0), ('none', 1), ('2', 2), ('5', 3)) w(run, place) USING (run)"
ORACLE_SQL["trial_rows"] = _with(_DCT, "t AS (SELECT label, band_id, round(sum(v * v), 6) AS energy, count(*) AS n FROM z GROUP BY ALL)") + "SELECT kind, label, band_id::INTEGER AS band_id, energy, n::BIGINT AS n FROM t, (VALUES ('json'), ('csv')) k(kind)"
ORACLE_SQL["bucket_guard"] = """WITH g AS (SELECT doc_id, (64 + n_chars % 193 + 31) // 32 AS nph, (64 + (doc_id * 37) % 193 + 31) // 32 AS npw FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT nph, npw, row_number() OVER (ORDER BY nph, npw) - 1 AS bucket_id FROM (SELECT DISTINCT nph, npw FROM g)),
p AS (SELECT bucket_id, row_number() OVER (PARTITION BY bucket_id ORDER BY doc_id) - 1 AS pos FROM g JOIN b USING (nph, npw))
SELECT (bucket_id * 100000 + pos // 4)::INTEGER AS batch_no, bucket_id::INTEGER AS bucket_id, count(*)::BIGINT AS images FROM p GROUP BY ALL"""

# --- indexes, stores on demand, loaders and modes ---

_GRIDS = "gr AS (SELECT image_id, (40 - image_id % 10 % 4 * 7 + 7) // 8 AS nph, (32 - image_id % 3 * 9 + 7) // 8 AS npw FROM im)"
ORACLE_SQL["packed_global_index"] = f"WITH {_IMAGES} SELECT image_id, (image_id // 2)::INTEGER AS shard_id, (row_number() OVER (PARTITION BY image_id // 2 ORDER BY image_id) - 1)::INTEGER AS row FROM im"
ORACLE_SQL["ensured_store"] = f"""WITH {_IMAGES}, {_GRIDS}
SELECT step::INTEGER AS step, (image_id // 2)::INTEGER AS shard_id, count(*)::BIGINT AS images, sum(((nph + t - 1) // t) * ((npw + t - 1) // t) * 4)::BIGINT AS chunks, sum(nph * npw * 3 * 64 * 2)::BIGINT AS bytes
FROM gr, (VALUES (0, 2), (1, 2), (2, 2), (3, 4)) s(step, t) WHERE step > 0 OR image_id < (SELECT max(image_id) FROM im) // 4 * 2 GROUP BY ALL"""
ORACLE_SQL["loader_batches"] = f"""{_PIXELS},
want AS (SELECT *, image_id * 7 % 8 AS t, image_id * 5 % 6 AS l, least(11, h - image_id * 7 % 8) AS ch, least(8, w - image_id * 5 % 6) AS cw FROM sz),
o AS (SELECT shard_id, row_number() OVER (ORDER BY md5(concat_ws(':', 4, 1, shard_id, 0)), shard_id) - 1 AS spot, count(*) OVER () AS n FROM (SELECT image_id // 2 AS shard_id FROM sz GROUP BY ALL HAVING count(*) = 2)),
eq AS (SELECT shard_id, spot % 2 AS rank, spot // 2 AS place FROM o WHERE spot < n // 2 * 2)
SELECT rank::INTEGER AS rank, place::INTEGER AS place, string_agg(DISTINCT image_id::VARCHAR, ',' ORDER BY image_id::VARCHAR) AS ids, sum(DISTINCT label * 1000 + image_id % 2)::INTEGER // 1000 AS labels, count(*)::INTEGER AS n, round(avg(v), 5) + 0.0 AS mean
FROM px JOIN want USING (image_id) JOIN eq ON shard_id = image_id // 2 WHERE y >= t AND y < t + ch AND x >= l AND x < l + cw GROUP BY ALL"""
ORACLE_SQL["bucketed_modes"] = _with(_DCT, "s AS (SELECT image_id, patch, image_id % 3 AS b, avg(abs(v)) AS signal FROM z WHERE patch % 4 < 2 + image_id % 3 GROUP BY ALL)",
    "w AS (SELECT *, (1 + (b * 20 + patch) * 7 % 11) / 11.0::DOUBLE AS pw, count(*) OVER (PARTITION BY image_id) AS n FROM s)",
    "c AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(pw * signal, 12) DESC, patch, band) AS spot, greatest(n, least(n * 16, round_even(0.35::DOUBLE * n * 16, 0))) - n AS extra FROM w, range(1, 16) t(band))",
    "g AS (SELECT image_id, patch, 1 + count(*) FILTER (spot <= extra) AS k FROM c GROUP BY ALL)",
    "f AS (SELECT image_id, patch, CASE WHEN row_number() OVER (PARTITION BY image_id ORDER BY round(pw * signal, 12) DESC, patch) <= round_even(0.4::DOUBLE * n, 0) THEN 12 ELSE 3 END AS k FROM w)") + """
SELECT 'full' AS mode, image_id, patch::INTEGER AS patch, 16::INTEGER AS k FROM s UNION ALL SELECT 'budget', image_id, patch::INTEGER, k::INTEGER FROM g UNION ALL SELECT 'fidelity', image_id, patch::INTEGER, k::INTEGER FROM f"""

ORACLE_SQL["source_mismatches"] = """WITH b AS (SELECT d.doc_id, quality, length(coalesce(text, '')) AS h, CASE WHEN len(string_split(coalesce(text, ''), ' ')) > 40 THEN length(source) ELSE length(lang) END AS w FROM documents d JOIN labels USING (doc_id)),
m AS (SELECT d.doc_id AS x, b.doc_id AS y, quality, n_chars, length(source) AS sw, h, w FROM (SELECT * FROM documents WHERE doc_id IS NOT NULL) d FULL JOIN b ON d.doc_id = b.doc_id)
SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL)::BIGINT AS matched, count(*) FILTER (y IS NULL)::BIGINT AS only_a, count(*) FILTER (x IS NULL)::BIGINT AS only_b,
  count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND quality <> 1)::BIGINT AS labels_differ, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND (n_chars <> h OR sw <> w))::BIGINT AS shapes_differ FROM m"""
