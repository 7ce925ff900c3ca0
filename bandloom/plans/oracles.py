"""DuckDB SQL that gives the same rows as the named queries."""

from __future__ import annotations

from bandloom.functions.dims import CHROMINANCE, LUMINANCE
from bandloom.plans.catalog import RAMPS, TARGETS

# Common table expressions; each oracle names the ones that it needs.
_CTE = {
    "basis": "basis AS (SELECT k, i, cos(pi() * k * (2 * i + 1) / 16.0) * sqrt(2.0 / 8) * (CASE k WHEN 0 THEN sqrt(0.5) ELSE 1.0 END) AS value FROM range(8) a(k), range(8) b(i))",
    "zz": "zz AS (SELECT row_number() OVER (ORDER BY a.r + b.c, CASE WHEN (a.r + b.c) % 2 = 0 THEN -a.r ELSE a.r END) - 1 AS pos, a.r, b.c FROM range(8) a(r), range(8) b(c))",
    "px": "px AS (SELECT vec_id // 20 AS image_id, vec_id % 20 AS patch, label, i, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS p FROM embeddings, range(64) t(i))",
    "half": "half AS (SELECT image_id, patch, any_value(label) AS label, k AS u, x, sum(value * p) AS s FROM px JOIN basis ON basis.i = y GROUP BY image_id, patch, k, x)",
    "coef": "coef AS (SELECT image_id, patch, any_value(label) AS label, u, k AS w, sum(value * s) AS v FROM half JOIN basis ON basis.i = x GROUP BY image_id, patch, u, k)",
    "z": "z AS (SELECT image_id, patch, label, u, w, pos, least(pos // 4, 15) AS band_id, v FROM coef JOIN zz ON u = r AND w = c)",
    "sig": "sig AS (SELECT image_id, patch, avg(abs(v)) AS signal FROM z GROUP BY ALL)",
    "bw": "bw AS (SELECT b AS band_id, 1.0 / (1.0 + b)::DOUBLE AS weight FROM range(16) t(b))",
    "pw": "pw AS (SELECT p AS patch, (1.0 + p % 5)::DOUBLE / 60.0::DOUBLE AS weight FROM range(20) t(p))",
    "sh": "sh AS (SELECT doc_id AS image_id, 64 + n_chars % 193 AS height, 64 + (doc_id * 37) % 193 AS width FROM documents)",
    "crop": "crop AS (SELECT *, (image_id * 13) % height AS t, (image_id * 29) % width AS l, 8 + (image_id * 7) % 120 AS ch, 8 + (image_id * 11) % 120 AS cw, (height + 7) // 8 AS nph, (width + 7) // 8 AS npw FROM sh)",
    "rect": "rect AS (SELECT *, greatest(0, t // 8) AS row0, least(nph, (t + ch + 7) // 8) AS row1, greatest(0, l // 8) AS col0, least(npw, (l + cw + 7) // 8) AS col1 FROM crop)",
    "scale99": "scale99 AS (SELECT band_id, greatest(quantile_cont(abs(v), 0.99) / 127, 1e-12) AS scale FROM z GROUP BY ALL)",
    "qz": "qz AS (SELECT z.*, round_even(v / scale, 0) AS raw, greatest(-128, least(127, round_even(v / scale, 0)))::INTEGER AS q, greatest(-128, least(127, round_even(v / scale, 0))) * scale AS rv FROM z JOIN scale99 USING (band_id))",
    "ih": "ih AS (SELECT image_id, patch, w, i AS y, sum(value * v) AS a, sum(value * rv) AS b FROM qz JOIN basis ON k = u GROUP BY ALL)",
    "pairs": "pairs AS (SELECT image_id, patch, y, i AS x, sum(value * ih.a) AS a, sum(value * ih.b) AS b FROM ih JOIN basis ON k = w GROUP BY ALL)",
    "dc": "dc AS (SELECT image_id, patch, greatest(-32768, least(32767, round_even(v * 20000.0, 0)))::INTEGER AS dc FROM z WHERE pos = 0)",
    "cent": "cent AS (SELECT label AS klass, pos, avg(v) AS cv FROM z GROUP BY ALL)",
    "logit": "logit AS (SELECT image_id, patch, label, klass, sum(v * cv) AS s FROM z JOIN cent USING (pos) GROUP BY ALL)",
    "soft": "soft AS (SELECT *, exp(s - max(s) OVER w) AS e FROM logit WINDOW w AS (PARTITION BY image_id, patch))",
    "prob": "prob AS (SELECT *, e / sum(e) OVER (PARTITION BY image_id, patch) - (klass = label)::INTEGER AS d FROM soft)",
    "grad": "grad AS (SELECT image_id, patch, label, pos, least(pos // 4, 15) AS band_id, sum(d * cv) AS g FROM prob JOIN cent USING (klass) GROUP BY ALL)",
}
_DCT = ("basis", "zz", "px", "half", "coef", "z")
_GRAD = (*_DCT, "cent", "logit", "soft", "prob", "grad")


def _with(names: tuple[str, ...], *more: str) -> str:
    return "WITH " + ",\n".join([*(_CTE[n] for n in names), *more]) + "\n"


def _sens(key: str) -> tuple[str, ...]:
    return (
        f"steps AS (SELECT label, image_id, {key} AS idx, avg(abs(g)) AS value FROM grad GROUP BY ALL)",
        "means AS (SELECT label AS epoch, idx, avg(value) AS value FROM steps GROUP BY ALL)",
        "sens AS (SELECT epoch, idx, value / (sum(value) OVER (PARTITION BY epoch) + 1e-8) AS value FROM means)",
    )


def _greedy(worth: str, k_low: int, budget: str, source: str = "sig", weights: str = "JOIN pw USING (patch)") -> str:
    """slots, ranked: the place of each slot of a patch and a band above the floor, and the image's extra slots."""
    return f"""slots AS (
  SELECT image_id, patch, bw.band_id, round({worth}, 12) AS worth, count(DISTINCT patch) OVER (PARTITION BY image_id) AS n
  FROM (SELECT s.* {', pw.weight AS pweight' if weights else ', 1.0 AS pweight'} FROM {source} s {weights}) s, bw WHERE bw.band_id >= {k_low}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY worth DESC, patch, band_id) AS place,
    greatest(n * {k_low}, least(n * 16, {budget})) - n * {k_low} AS extra FROM slots)"""


def _greedy_k(k_low: int) -> str:
    return f"SELECT image_id, patch::INTEGER AS patch, least(16, {k_low} + count(*) FILTER (place <= extra))::INTEGER AS k FROM ranked GROUP BY ALL"


_MATCH = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS target" for t in TARGETS)
_RAMP = " UNION ALL ".join(f"SELECT '{n}' AS preset, {s}::DOUBLE AS s, {e}::DOUBLE AS e, {g}::DOUBLE AS g, {p * 16} AS slots, {p} AS least" for n, s, e, g, p in RAMPS)
_BUDGET = f"""ramps AS ({_RAMP}),
budgets AS (SELECT preset, epoch, greatest(least, least(slots, round_even(slots * (s + (e - s) * pow(least(epoch, 99) / 99.0::DOUBLE, g)), 0)))::BIGINT AS budget, slots FROM ramps, range(100) t(epoch))"""
_LOWPASS = """ihl AS (SELECT image_id, patch, w, i AS y, sum(value * CASE WHEN pos < {n} THEN v ELSE 0 END) AS s FROM z JOIN basis ON k = u GROUP BY ALL),
lp AS (SELECT image_id, patch, y * 8 + i AS i, sum(value * s) AS v FROM ihl JOIN basis ON k = w GROUP BY ALL)"""
_CHANNELS = """ch AS (SELECT vec_id // 3 AS image_id, i, max(CASE WHEN vec_id % 3 = 0 THEN v END) AS r, max(CASE WHEN vec_id % 3 = 1 THEN v END) AS g, max(CASE WHEN vec_id % 3 = 2 THEN v END) AS b
FROM (SELECT vec_id, i, (embedding[i + 1]::DOUBLE + 1) / 2 * 255 AS v FROM embeddings, range(64) t(i)) GROUP BY ALL HAVING r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL),
yc AS (SELECT image_id, i, r, g, b, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS y, -0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b + 128 AS cb, 0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b + 128 AS cr FROM ch)"""
_PILOT = "pilot AS (SELECT event_id % 10 AS epoch, 1 + sum(user_id) % 16 AS k FROM events GROUP BY ALL)"
_ISO = """sums AS (SELECT epoch, k, sum(k) OVER (ORDER BY epoch) AS s, row_number() OVER (ORDER BY epoch) AS n FROM pilot),
spans AS (SELECT a.n AS i, b.n AS j, (b.s - a.s + a.k)::DOUBLE / (b.n - a.n + 1) AS m FROM sums a JOIN sums b ON a.n <= b.n),
least_ AS (SELECT t.epoch, i, min(m) AS m FROM sums t JOIN spans ON i <= t.n AND t.n <= j GROUP BY ALL),
iso AS (SELECT epoch, max(m) AS fitted FROM least_ GROUP BY ALL)"""


def _resize(name: str, n_out: int, antialias: bool) -> str:
    scale = 8.0 / n_out
    centre = f"((o + 0.5) * {scale}::DOUBLE - 0.5)"
    if not antialias or scale <= 1:
        centre, support = f"greatest(0, least(7, {centre}))", 1.0
    else:
        support = scale
    return f"{name} AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, i, greatest(0, 1 - abs(i - {centre}) / {support}::DOUBLE) AS w FROM range({n_out}) a(o), range(8) b(i)))"


def _table(q: int) -> str:
    scale = 5000 / q if q < 50 else 200 - 2 * q
    lists = [f"SELECT {c} AS channel, unnest(range(64)) AS place, unnest({list(t)}) AS base" for c, t in enumerate((LUMINANCE, CHROMINANCE, CHROMINANCE))]
    return f"SELECT channel, place::INTEGER AS \"natural\", greatest(1, least(255, floor((base * {scale}::DOUBLE + 50) / 100)))::INTEGER AS q FROM ({' UNION ALL '.join(lists)})"


ORACLE_SQL: dict[str, str] = {
    "dct_basis": _with(("basis",)) + "SELECT k::INTEGER AS k, i::INTEGER AS i, round(value, 9) + 0.0 AS value FROM basis",
    "zigzag_8x8": _with(("zz",)) + "SELECT pos::INTEGER AS pos, r::INTEGER AS row, c::INTEGER AS col, (r * 8 + c)::INTEGER AS \"natural\" FROM zz",
    "band_map": "SELECT pos::INTEGER AS pos, least(pos // 4, 15)::INTEGER AS band16, least(pos // 12, 4)::INTEGER AS band5, CASE WHEN pos < 1 THEN 0 WHEN pos < 6 THEN 1 WHEN pos < 21 THEN 2 ELSE 3 END::INTEGER AS crop_band FROM range(64) t(pos)",
    "qtable_q95": _table(95),
    "qtable_q30": _table(30),
    "tile_specs": _with(("sh",), "g AS (SELECT DISTINCT (height + 7) // 8 AS nph, (width + 7) // 8 AS npw FROM sh)", "t AS (SELECT nph, npw, tr * ((npw + 3) // 4) + tc AS tile_id, tr * 4 AS r0, tc * 4 AS c0, least(4, nph - tr * 4) AS th, least(4, npw - tc * 4) AS tw FROM g, range(9) a(tr), range(9) b(tc) WHERE tr * 4 < nph AND tc * 4 < npw)")
    + "SELECT nph::INTEGER AS nph, npw::INTEGER AS npw, tile_id::INTEGER AS tile_id, r0::INTEGER AS r0, c0::INTEGER AS c0, th::INTEGER AS th, tw::INTEGER AS tw, (r0 * npw + c0)::INTEGER AS first_block, (SELECT sum((r0 + y) * npw + c0 + x) FROM range(4) a(y), range(4) b(x) WHERE y < th AND x < tw)::INTEGER AS block_sum FROM t",
    "block_dct": _with(_DCT) + "SELECT image_id, patch::INTEGER AS patch, pos::INTEGER AS pos, round(v, 6) + 0.0 AS value FROM z",
    "block_idct_roundtrip": _with(("px",)) + "SELECT image_id, patch::INTEGER AS patch, i::INTEGER AS i, round(p, 6) + 0.0 AS value FROM px",
    "parseval_check": _with(("px",)) + "SELECT image_id, round(sum(p * p), 6) AS pixel_energy, round(sum(p * p), 6) AS coefficient_energy FROM px GROUP BY ALL",
    "lowpass_k4": _with(_DCT, _LOWPASS.format(n=16)) + "SELECT image_id, patch::INTEGER AS patch, i::INTEGER AS i, round(v, 6) + 0.0 AS value FROM lp",
    "nested_fidelity_error": _with(_DCT) + "SELECT k::INTEGER AS k, round(sum(CASE WHEN band_id >= k THEN v * v ELSE 0 END) / count(*), 9) + 0.0 AS mse FROM z, range(1, 17) t(k) GROUP BY ALL",
    "bilinear_resize": _with(("px",), _resize("a4", 4, True), _resize("b12", 12, False), _resize("b5", 5, False),
        "sm AS (SELECT image_id, patch, ay.o * 4 + ax.o AS i, sum(p * ay.w * ax.w) AS v FROM px JOIN a4 ay ON ay.i = y JOIN a4 ax ON ax.i = x GROUP BY ALL)",
        "pl AS (SELECT image_id, patch, by_.o * 5 + bx.o AS i, sum(p * by_.w * bx.w) AS v FROM px JOIN b12 by_ ON by_.i = y JOIN b5 bx ON bx.i = x GROUP BY ALL)")
    + "SELECT image_id, patch::INTEGER AS patch, i::INTEGER AS i, round(pl.v, 6) + 0.0 AS plain, round(coalesce(sm.v, 0.0), 6) + 0.0 AS smooth FROM pl LEFT JOIN sm USING (image_id, patch, i)",
    "ycbcr": _with((), _CHANNELS) + "SELECT image_id, i::INTEGER AS i, round(y, 6) + 0.0 AS y, round(cb, 6) + 0.0 AS cb, round(cr, 6) + 0.0 AS cr FROM yc",
    "ycbcr_roundtrip": _with((), _CHANNELS)
    + "SELECT image_id, i::INTEGER AS i, round(greatest(0, least(1, (y + 1.402::DOUBLE * (cr - 128)) / 255)), 4) + 0.0 AS r, round(greatest(0, least(1, (y - 0.344136::DOUBLE * (cb - 128) - 0.714136::DOUBLE * (cr - 128)) / 255)), 4) + 0.0 AS g, round(greatest(0, least(1, (y + 1.772::DOUBLE * (cb - 128)) / 255)), 4) + 0.0 AS b FROM yc",
    "replicate_pad": _with(("sh",)) + "SELECT image_id, count(*)::BIGINT AS rows, sum(least(y, height - 1))::BIGINT AS index_sum, count(*) FILTER (y >= height)::BIGINT AS padded FROM sh, range(300) t(y) WHERE y < (height + 7) // 8 * 8 GROUP BY ALL",
    "normalised_pixels": _with(("px",)) + "SELECT image_id, patch::INTEGER AS patch, i::INTEGER AS i, round(((p + 1) / 2 - 0.5) / 0.25, 6) + 0.0 AS normal, round((p + 1) / 2, 6) + 0.0 AS back FROM px",
    "patch_signal": _with((*_DCT, "sig")) + "SELECT image_id, patch::INTEGER AS patch, round(signal, 9) AS signal FROM sig",
    "band_energy": _with(_DCT) + "SELECT band_id::INTEGER AS band_id, round(sum(v * v), 6) AS energy, count(*)::BIGINT AS n FROM z GROUP BY ALL",
    "scale_calibration_max": _with(_DCT) + "SELECT band_id::INTEGER AS band_id, round(greatest(max(abs(v)) / 127, 1e-12) * 1.05, 9) AS scale FROM z GROUP BY ALL",
    "scale_calibration_p9999": _with(_DCT) + "SELECT band_id::INTEGER AS band_id, round(greatest(quantile_cont(abs(v), 0.9999) / 127, 1e-12) * 1.05, 9) AS scale FROM z GROUP BY ALL",
    "quantize_int8": _with((*_DCT, "scale99", "qz")) + "SELECT image_id, patch::INTEGER AS patch, pos::INTEGER AS pos, q FROM qz",
    "clip_zero_fraction": _with((*_DCT, "scale99", "qz")) + "SELECT band_id::INTEGER AS band_id, round(avg((raw > 127 OR raw < -128)::INTEGER), 6) + 0.0 AS clip_fraction, round(avg((q = 0)::INTEGER), 6) + 0.0 AS zero_fraction FROM qz GROUP BY ALL",
    "quality_metrics": _with((*_DCT, "scale99", "qz", "ih", "pairs"), "m AS (SELECT image_id, avg((a - b) * (a - b)) AS mse, avg(abs(a - b)) AS mae, max(abs(a - b)) AS mx FROM pairs GROUP BY ALL)")
    + "SELECT image_id, round(mse, 9) AS mse, round(mae, 9) AS mae, round(mx, 6) AS max_abs, round(least(120, -10 * log10(mse)), 4) AS psnr FROM m",
    "fidelity_summary": _with((*_DCT, "scale99", "qz", "ih", "pairs"), "m AS (SELECT image_id, least(120, -10 * log10(avg((a - b) * (a - b)))) AS psnr, avg(abs(a - b)) AS mae FROM pairs GROUP BY ALL)")
    + "SELECT count(*)::BIGINT AS images, round(avg(psnr), 4) AS psnr_mean, round(stddev_pop(psnr), 4) AS psnr_std, round(avg(mae), 9) AS mae_mean, count(*) FILTER (psnr >= 40)::BIGINT AS above_40 FROM m",
    "ssim_global": _with((*_DCT, "scale99", "qz", "ih", "pairs"), "m AS (SELECT image_id, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM pairs GROUP BY ALL)")
    + "SELECT image_id, round((2 * ma * mb + 0.0001) * (2 * c + 0.0009) / ((ma * ma + mb * mb + 0.0001) * (va + vb + 0.0009)), 9) AS ssim FROM m",
    "dpcm_dc": _with((*_DCT, "dc")) + "SELECT image_id, patch::INTEGER AS patch, dc, (((dc - coalesce(lag(dc) OVER (PARTITION BY image_id ORDER BY patch), 0) + 32768) % 65536 + 65536) % 65536 - 32768)::INTEGER AS delta FROM dc",
    "undpcm_dc": _with((*_DCT, "dc")) + "SELECT image_id, patch::INTEGER AS patch, dc AS restored FROM dc",
    "entropy_by_band": _with((*_DCT, "scale99", "qz"), "n1 AS (SELECT band_id, q, count(*) AS n FROM qz GROUP BY ALL UNION ALL SELECT NULL, q, count(*) FROM qz GROUP BY q)", "n2 AS (SELECT *, n / sum(n) OVER (PARTITION BY band_id) AS s FROM n1)", "n3 AS (SELECT band_id, sum(n) AS symbols, sum(-s * log2(s)) AS bits, sum(CASE WHEN q = 0 THEN n ELSE 0 END) AS zeros FROM n2 GROUP BY ALL)")
    + "SELECT band_id::INTEGER AS band_id, symbols::BIGINT AS symbols, round(bits, 6) AS bits, round(bits * symbols / 8, 3) AS bytes, round(zeros / symbols, 6) AS zero_share FROM n3",
    "sensitivity_band": _with(_GRAD, *_sens("band_id")) + "SELECT epoch, idx::INTEGER AS idx, round(value, 9) AS value FROM sens",
    "sensitivity_patch": _with(_GRAD, *_sens("patch")) + "SELECT epoch, idx::INTEGER AS idx, round(value, 9) AS value FROM sens",
    "band_cutoff": _with(_GRAD, *_sens("band_id"), "c AS (SELECT epoch, round(sum(value) OVER (PARTITION BY epoch ORDER BY idx), 12) < 0.8 AS below FROM sens)") + "SELECT epoch, least(16, 1 + count(*) FILTER (below))::INTEGER AS k FROM c GROUP BY ALL",
    "patch_quota": _with(_GRAD, *_sens("patch"), "c AS (SELECT epoch, round(sum(value) OVER (PARTITION BY epoch ORDER BY round(value, 12) DESC, idx), 12) < 0.7 AS below FROM sens)") + "SELECT epoch, least(20, 1 + count(*) FILTER (below))::INTEGER AS q FROM c GROUP BY ALL",
    "alloc_binary_static": _with((*_DCT, "sig", "pw"), "o AS (SELECT image_id, patch, row_number() OVER (PARTITION BY image_id ORDER BY round(weight, 12) DESC, patch) AS place, count(*) OVER (PARTITION BY image_id) AS n FROM sig JOIN pw USING (patch))")
    + "SELECT image_id, patch::INTEGER AS patch, (CASE WHEN place <= greatest(0, least(n, round_even((greatest(n, least(n * 16, round_even(0.4::DOUBLE * n * 16, 0))) - n) / 15.0, 0))) THEN 16 ELSE 1 END)::INTEGER AS k FROM o",
    "alloc_binary_gradient": _with((*_DCT, "sig", "pw"), "o AS (SELECT image_id, patch, row_number() OVER (PARTITION BY image_id ORDER BY round(weight * signal, 12) DESC, patch) AS place FROM sig JOIN pw USING (patch))") + "SELECT image_id, patch::INTEGER AS patch, (CASE WHEN place <= 7 THEN 12 ELSE 2 END)::INTEGER AS k FROM o",
    "alloc_greedy": _with((*_DCT, "sig", "bw"), _greedy("signal * signal * bw.weight * bw.weight", 1, "round_even(0.5 * n * 16, 0)", weights="")) + _greedy_k(1),
    "alloc_greedy_ties": _with((*_DCT, "sig", "bw"), _greedy("signal * signal", 1, "round_even(0.5 * n * 16, 0)", weights="")) + _greedy_k(1),
    "alloc_greedy_sens": _with((*_DCT, "sig", "bw", "pw"), _greedy("pweight * signal * bw.weight * bw.weight", 1, "round_even(0.45::DOUBLE * n * 16, 0)")) + _greedy_k(1),
    "alloc_threshold_strict": _with((*_DCT, "sig", "bw", "pw"), _greedy("signal * pweight * bw.weight", 1, "150"), "last_ AS (SELECT image_id, max(worth) AS lw FROM ranked WHERE place = least(extra, n * 15) GROUP BY ALL)")
    + "SELECT image_id, patch::INTEGER AS patch, least(16, 1 + count(*) FILTER (worth > lw))::INTEGER AS k FROM ranked LEFT JOIN last_ USING (image_id) GROUP BY ALL",
    "alloc_crop_greedy": _with((*_DCT, "sig", "bw"), "seen AS (SELECT * FROM sig WHERE patch // 4 >= (image_id * 5 % 30) // 8 AND patch // 4 < least(5, (image_id * 5 % 30 + 24) // 8) AND patch % 4 >= (image_id * 3 % 20) // 8 AND patch % 4 < least(4, (image_id * 3 % 20 + 22) // 8))",
        _greedy("signal * signal * bw.weight * bw.weight", 1, "round_even(0.5 * n * 16, 0)", source="seen", weights="")) + _greedy_k(1),
    "uniform_prefix": f"SELECT n::INTEGER AS n, ratio::DOUBLE AS ratio, greatest(1, least(16, ceil(ratio::DOUBLE * 16)))::INTEGER AS k FROM (SELECT unnest(range({len(TARGETS) + 1})) AS n, unnest([{', '.join(map(str, (0.0, *TARGETS)))}]) AS ratio)",
    "match_static_lowpass": _with((), f"t AS ({_MATCH})", "c AS (SELECT target, k, k / 16.0::DOUBLE AS ratio FROM t, range(1, 17) r(k))") + "SELECT target, k::INTEGER AS k, ratio FROM c QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(abs(ratio - target), 12), k) = 1",
    "match_static_kq": _with((), f"t AS ({_MATCH})", "c AS (SELECT target, k, q, k / 16.0::DOUBLE + (1 - k / 16.0::DOUBLE) * (q / 20.0::DOUBLE) AS ratio FROM t, range(1, 17) r(k), range(1, 21) s(q))") + "SELECT target, k::INTEGER AS k, q::INTEGER AS q, round(ratio, 9) AS ratio FROM c QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(abs(ratio - target), 12), k, q) = 1",
    "serve_greedy_psnr": _with((*_DCT, "sig", "bw"), _greedy("signal * signal * bw.weight * bw.weight", 1, "round_even(0.5 * n * 16, 0)", weights=""), f"alloc AS ({_greedy_k(1)})",
        "err AS (SELECT image_id, sum(CASE WHEN pos >= k * 4 THEN v * v ELSE 0 END) / count(*) AS mse FROM z JOIN alloc USING (image_id, patch) GROUP BY ALL)", "io AS (SELECT image_id, sum(k) AS slots, count(*) AS n FROM alloc GROUP BY ALL)")
    + "SELECT image_id, round(mse, 9) AS mse, round(least(120, -10 * log10(mse)), 4) AS psnr, slots::BIGINT AS slots, (slots * 16)::BIGINT AS bytes_read, (n * 256)::BIGINT AS full_bytes, round(slots / (n * 16), 6) AS io_ratio FROM err JOIN io USING (image_id)",
    "io_accounting_epoch": _with((*_DCT, "sig", "bw"), _greedy("signal * signal * bw.weight * bw.weight", 1, "round_even(0.5 * n * 16, 0)", weights=""), f"alloc AS ({_greedy_k(1)})", "rd AS (SELECT image_id % 4 AS replica, k * 16 AS b FROM alloc)")
    + "SELECT replica, count(*)::BIGINT AS reads, sum(b)::BIGINT AS bytes_read, (count(*) * 256)::BIGINT AS full_bytes, round(avg(b), 6) AS avg_bytes, round(quantile_cont(b, 0.95), 6) AS p95_bytes, round(sum(b) / (count(*) * 256), 6) AS io_ratio FROM rd GROUP BY ALL",
    "kq_residual_serve": _with(_DCT, "lost AS (SELECT image_id, patch, sum(CASE WHEN pos >= 16 THEN v * v ELSE 0 END) AS e FROM z GROUP BY ALL)", "top AS (SELECT patch FROM (SELECT patch, avg(e) AS e FROM lost GROUP BY ALL) ORDER BY round(e, 12) DESC, patch LIMIT 5)")
    + "SELECT image_id, round(sum(e) FILTER (patch NOT IN (SELECT patch FROM top)), 6) AS sq_error, 0.4375::DOUBLE AS ratio FROM lost GROUP BY ALL",
    "kq_static_serve": _with((*_DCT, "pw"), "top AS (SELECT patch FROM pw ORDER BY round(weight, 12) DESC, patch LIMIT 8)") + "SELECT patch::INTEGER AS patch, round(CASE WHEN patch IN (SELECT patch FROM top) THEN 0 ELSE sum(CASE WHEN pos >= 24 THEN v * v ELSE 0 END) END, 6) + 0.0 AS sq_error FROM z GROUP BY patch",
    "budget_schedule": _with((), _BUDGET) + "SELECT preset, epoch::INTEGER AS epoch, budget, round(budget / slots, 9) AS io_ratio FROM budgets",
    "budget_ramp_means": _with((), _BUDGET) + "SELECT preset, round(avg(round(budget / slots, 9)), 4) AS avg_io FROM budgets GROUP BY ALL",
    "isotonic_schedule": _with((), _PILOT, _ISO) + "SELECT epoch::INTEGER AS epoch, round(fitted, 9) AS fitted FROM iso",
    "pilot_schedule": _with((), _PILOT, _ISO, "ends AS (SELECT count(*) AS n, arg_min(fitted, epoch) AS f, arg_max(fitted, epoch) AS l FROM iso)",
        "g AS (SELECT t.epoch, greatest(1.0, least(16.0, coalesce(fitted, l + (l - f) / greatest(n - 1, 1) * (t.epoch - n + 1)))) AS v FROM range(40) t(epoch) CROSS JOIN ends LEFT JOIN iso ON iso.epoch = t.epoch)")
    + "SELECT epoch::INTEGER AS epoch, round_even(max(v) OVER (ORDER BY epoch), 0)::INTEGER AS k FROM g",
    "sens_schedule_fit": _with((), "h0 AS (SELECT event_id % 5 AS epoch, user_id % 8 AS idx, avg(abs(value)) + count(*) % 7 AS value FROM events GROUP BY ALL)", "h AS (SELECT epoch, idx, value / (sum(value) OVER (PARTITION BY epoch) + 1e-8) AS value FROM h0)",
        "l AS (SELECT idx, coalesce(regr_slope(value, epoch), 0) AS slope, coalesce(regr_intercept(value, epoch), avg(value)) AS base FROM h GROUP BY ALL)", "g AS (SELECT e.epoch, l.idx, greatest(coalesce(h.value, base + slope * e.epoch), 1e-8) AS v FROM range(12) e(epoch) CROSS JOIN l LEFT JOIN h ON h.epoch = e.epoch AND h.idx = l.idx)")
    + "SELECT epoch::INTEGER AS epoch, idx::INTEGER AS idx, round(v / sum(v) OVER (PARTITION BY epoch), 9) AS value FROM g",
    "lr_schedule": "SELECT epoch::INTEGER AS epoch, round(CASE WHEN epoch < 5 THEN 0.4 * (epoch + 1) / 5 ELSE 0.4 * 0.5 * (1 + cos(pi() * (epoch - 5) / 85)) END, 9) + 0.0 AS lr FROM range(90) t(epoch)",
    "crop_block_rect": _with(("sh", "crop", "rect")) + "SELECT image_id, nph::INTEGER AS nph, npw::INTEGER AS npw, row0::INTEGER AS row0, row1::INTEGER AS row1, col0::INTEGER AS col0, col1::INTEGER AS col1 FROM rect",
    "tiles_overlapping_crop": _with(("sh", "crop", "rect")) + "SELECT image_id, (tr * ((npw + 3) // 4) + tc)::INTEGER AS tile_id FROM rect, range(10) a(tr), range(10) b(tc) WHERE tr * 4 < row1 AND (tr + 1) * 4 > row0 AND tc * 4 < col1 AND (tc + 1) * 4 > col0",
    "crop_io_ratio": _with(("sh", "crop", "rect")) + "SELECT image_id, (((row1 + 3) // 4 - row0 // 4) * ((col1 + 3) // 4 - col0 // 4))::BIGINT AS tiles, ((row1 - row0) * (col1 - col0))::INTEGER AS blocks, round((row1 - row0) * (col1 - col0) / (nph * npw), 6) AS ratio FROM rect",
    "consecutive_band_groups": "SELECT doc_id, min(b)::INTEGER AS first, max(b)::INTEGER AS last, count(*)::BIGINT AS n FROM (SELECT doc_id, b, b - row_number() OVER (PARTITION BY doc_id ORDER BY b) AS run FROM documents, range(10) t(b) WHERE (doc_id // (1 << b::INTEGER)) % 2 = 1) GROUP BY doc_id, run",
    "center_crops": _with(("sh",)) + """SELECT 'square' AS kind, image_id, ((height - least(height, width)) // 2)::INTEGER AS top, ((width - least(height, width)) // 2)::INTEGER AS left, least(height, width)::INTEGER AS crop_h, least(height, width)::INTEGER AS crop_w FROM sh
UNION ALL SELECT 'output', image_id, ((height - least(height, 96)) // 2)::INTEGER, ((width - least(width, 96)) // 2)::INTEGER, least(height, 96)::INTEGER, least(width, 96)::INTEGER FROM sh
UNION ALL SELECT 'most', image_id, ((height - least(height, 120)) // 2 // 8 * 8)::INTEGER, ((width - least(width, 120)) // 2 // 8 * 8)::INTEGER, least(height, 120)::INTEGER, least(width, 120)::INTEGER FROM sh""",
    "exact_buckets": _with(("sh",), "g AS (SELECT image_id, (height + 15) // 16 AS nph, (width + 15) // 16 AS npw FROM sh)", "b AS (SELECT *, dense_rank() OVER (ORDER BY nph, npw) - 1 AS bucket_id FROM g)")
    + "SELECT image_id, nph::INTEGER AS nph, npw::INTEGER AS npw, bucket_id::INTEGER AS bucket_id, (row_number() OVER (PARTITION BY bucket_id ORDER BY image_id) - 1)::INTEGER AS bucket_pos FROM b",
    "coarse_buckets": _with(("sh",), "g AS (SELECT image_id, (height + 7) // 8 AS nph, (width + 7) // 8 AS npw FROM sh)", "l AS (SELECT *, round(log2(nph * npw), 12) AS area, round(log2(nph / npw), 12) AS aspect FROM g)",
        "e AS (SELECT list_transform(quantile_cont(area, [0.25, 0.5, 0.75]), lambda x: round(x, 12)) AS ae, list_transform(quantile_cont(aspect, [0.25, 0.5, 0.75]), lambda x: round(x, 12)) AS re FROM l)",
        "b AS (SELECT l.*, len(list_filter(ae, lambda x: x <= area)) * 4 + len(list_filter(re, lambda x: x <= aspect)) AS raw FROM l, e)", "k AS (SELECT raw, row_number() OVER (ORDER BY raw) - 1 AS bucket_id, max(nph) AS h, max(npw) AS w FROM b GROUP BY raw)")
    + "SELECT image_id, bucket_id::INTEGER AS bucket_id, h::INTEGER AS bucket_nph, w::INTEGER AS bucket_npw FROM b JOIN k USING (raw)",
    "storage_forecast": _with(("sh",), "g AS (SELECT (height + 31) // 32 AS nph, (width + 31) // 32 AS npw FROM sh)", "b AS (SELECT nph, npw, count(*) AS images FROM g GROUP BY ALL)")
    + "SELECT (row_number() OVER (ORDER BY nph, npw) - 1)::INTEGER AS bucket_id, nph::INTEGER AS nph, npw::INTEGER AS npw, images::BIGINT AS images, (nph * npw)::INTEGER AS patches, (images * nph * npw)::BIGINT AS blocks, (images * nph * npw * 3072)::BIGINT AS raw_bytes FROM b",
    "adaptive_chunk": _with(("sh",)) + "SELECT image_id, least(64, greatest(1, floor(12000000 / (24.0 * height * width))))::INTEGER AS chunk FROM sh",
    "shard_batches": "SELECT vec_id AS image_id, (vec_id // 48)::INTEGER AS shard_id, (vec_id % 48 // 10)::INTEGER AS batch_no FROM embeddings",
    "rank_stride": "SELECT (vec_id % 8)::INTEGER AS rank, count(*)::BIGINT AS n, sum(vec_id)::BIGINT AS id_sum FROM embeddings GROUP BY ALL",
    "run_summary": "SELECT user_id % 7 AS run, round(max(abs(value)), 6) AS best, round(arg_max(abs(value), {'ts': ts, 'e': event_id}), 6) AS final, round(avg(abs(value) % 1.0), 6) AS avg_io, round((1 - avg(abs(value) % 1.0)) * 100, 4) AS avg_saved FROM events WHERE value IS NOT NULL GROUP BY ALL",
    "epoch_metrics": "SELECT event_id % 6 AS epoch, round(sum(abs(value) * (1 + user_id % 5)) / sum(1 + user_id % 5), 6) AS loss, round(sum(user_id % 3) / sum(1 + user_id % 5), 6) AS acc, sum(1 + user_id % 5)::BIGINT AS n FROM events WHERE value IS NOT NULL GROUP BY ALL",
    "missing_keys": "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "reference_by_key": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "subsampling_histogram": "SELECT CASE WHEN doc_id % 4 = 0 THEN 'grayscale' WHEN doc_id % 4 <> 2 THEN 'other' WHEN doc_id % 3 = 1 AND n_chars % 2 = 1 THEN '4:2:0' WHEN doc_id % 3 = 1 AND n_chars % 2 = 0 THEN '4:2:2' WHEN doc_id % 3 = 0 AND n_chars % 2 = 0 THEN '4:4:4' ELSE 'other' END AS subsampling, count(*)::BIGINT AS n FROM documents GROUP BY ALL",
    "zstd_roundtrip": "SELECT doc_id, strlen(coalesce(text, ''))::INTEGER AS n, true AS same FROM documents",
    "band_store_prefix": _with(_DCT) + "SELECT band_id::INTEGER AS band_id, count(*)::BIGINT AS n, round(sum(v * v), 3) AS energy FROM z WHERE band_id < 5 GROUP BY ALL",
    "residual_store_patch": _with(_DCT) + "SELECT patch::INTEGER AS patch, count(DISTINCT image_id)::BIGINT AS n, round(sum(CASE WHEN pos >= 16 THEN v * v ELSE 0 END), 6) AS energy FROM z WHERE patch IN (0, 7) GROUP BY ALL",
}
_GRADIENT = "o AS (SELECT image_id, patch, row_number() OVER (PARTITION BY image_id ORDER BY round(weight * signal, 12) DESC, patch) AS place FROM sig JOIN pw USING (patch)), alloc AS (SELECT image_id, patch, CASE WHEN place <= 7 THEN 16 ELSE 1 END AS k FROM o)"
_TILES = "t AS (SELECT image_id % 2 AS bucket_id, image_id // 2 // 6 AS chunk_id, patch // 4 // 2 * 2 + patch % 4 // 2 AS tile_id, max(k) AS most FROM alloc GROUP BY ALL)"
ORACLE_SQL["record_accounting"] = _with((*_DCT, "sig", "pw"), _GRADIENT, _TILES) + "SELECT bucket_id::INTEGER AS bucket_id, chunk_id::INTEGER AS chunk_id, sum(most)::BIGINT AS reads, (count(*) * 16)::BIGINT AS full_reads FROM t GROUP BY bucket_id, chunk_id"
ORACLE_SQL["bucket_store_serve"] = (
    _with((*_DCT, "sig", "pw"), _GRADIENT, _TILES, "sc AS (SELECT band_id, greatest(max(abs(v)) / 127, 1e-12) AS scale FROM z GROUP BY ALL)",
        "e AS (SELECT image_id % 2 AS bucket_id, count(DISTINCT image_id * 100 + patch) AS blocks, sum(CASE WHEN band_id < k THEN pow(greatest(-128, least(127, round_even(v::FLOAT::DOUBLE / scale, 0))) * scale, 2) ELSE 0 END) AS energy FROM z JOIN alloc USING (image_id, patch) JOIN sc USING (band_id) GROUP BY ALL)", "rd AS (SELECT bucket_id, sum(most) AS reads FROM t GROUP BY ALL)")
    + "SELECT bucket_id::INTEGER AS bucket_id, blocks::BIGINT AS blocks, round(energy, 3) AS energy, reads::BIGINT AS reads FROM e JOIN rd USING (bucket_id)"
)
ORACLE_SQL["lowpass_baseline"] = _with(_DCT, f"t AS ({_MATCH})", "c AS (SELECT target, k FROM t, range(1, 17) r(k) QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(abs(k / 16.0::DOUBLE - target), 12), k) = 1)", "m AS (SELECT target, k, sum(CASE WHEN band_id >= k THEN v * v ELSE 0 END) / count(*) AS mse FROM c, z GROUP BY ALL)") + "SELECT target, k::INTEGER AS k, round(mse, 9) + 0.0 AS mse, round(CASE WHEN round(mse, 15) <= 0 THEN 120.0 ELSE least(120, -10 * log10(mse)) END, 4) AS psnr FROM m"
ORACLE_SQL["policy_comparison"] = (
    _with((*_DCT, "sig", "bw", "pw"), _greedy("signal * signal * bw.weight * bw.weight", 1, "round_even(0.4::DOUBLE * n * 16, 0)", weights=""), f"g AS ({_greedy_k(1)})",
        "o AS (SELECT image_id, patch, row_number() OVER (PARTITION BY image_id ORDER BY round(weight * signal, 12) DESC, patch) AS a, row_number() OVER (PARTITION BY image_id ORDER BY round(weight, 12) DESC, patch) AS b FROM sig JOIN pw USING (patch))",
        "alloc AS (SELECT 'greedy' AS policy, image_id, patch, k FROM g UNION ALL SELECT 'gradient', image_id, patch, CASE WHEN a <= 7 THEN 16 ELSE 1 END FROM o UNION ALL SELECT 'static', image_id, patch, CASE WHEN b <= 7 THEN 16 ELSE 1 END FROM o)",
        "s AS (SELECT policy, sum(k) AS slots FROM alloc GROUP BY ALL)", "e AS (SELECT policy, sum(CASE WHEN band_id >= k THEN v * v ELSE 0 END) / count(*) AS mse FROM z JOIN alloc USING (image_id, patch) GROUP BY ALL)")
    + "SELECT policy, round(mse, 9) AS mse, slots::BIGINT AS slots FROM e JOIN s USING (policy)"
)
_SHARD = _with(_DCT, "sc AS (SELECT band_id, greatest(max(abs(v)) / 127, 1e-12) AS scale FROM z GROUP BY ALL)", "q AS (SELECT image_id // 10 AS shard_id, image_id, patch, band_id, greatest(-128, least(127, round_even(v::FLOAT::DOUBLE / scale, 0))) * scale AS v FROM z JOIN sc USING (band_id))")
ORACLE_SQL["shard_store_read"] = _SHARD + "SELECT shard_id::INTEGER AS shard_id, band_id::INTEGER AS band_id, count(DISTINCT image_id * 100 + patch)::BIGINT AS blocks, round(sum(v * v), 3) AS energy FROM q WHERE band_id < 8 GROUP BY ALL"
ORACLE_SQL["bucket_batches"] = (
    ORACLE_SQL["coarse_buckets"].replace("SELECT image_id, bucket_id::INTEGER AS bucket_id, h::INTEGER AS bucket_nph, w::INTEGER AS bucket_npw FROM b JOIN k USING (raw)", "")
    + "SELECT image_id, bucket_id::INTEGER AS bucket_id, ((row_number() OVER w - 1) // 8)::INTEGER AS batch_no FROM b JOIN k USING (raw) WINDOW w AS (PARTITION BY bucket_id ORDER BY image_id) QUALIFY row_number() OVER w - 1 < count(*) OVER (PARTITION BY bucket_id) // 8 * 8"
)


def _u(*parts: object) -> str:
    """uniform() of these parts."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(map(str, parts))})), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE)"


ORACLE_SQL["alloc_random"] = _with((*_DCT, "sig"), f"o AS (SELECT image_id, patch, row_number() OVER (PARTITION BY image_id ORDER BY {_u(7, 'image_id', 'patch')} DESC, patch) AS place, count(*) OVER (PARTITION BY image_id) AS n FROM sig)") + "SELECT image_id, patch::INTEGER AS patch, (CASE WHEN place <= greatest(0, least(n, round_even((greatest(n, least(n * 16, round_even(0.4::DOUBLE * n * 16, 0))) - n) / 15.0, 0))) THEN 16 ELSE 1 END)::INTEGER AS k FROM o"
ORACLE_SQL["random_crops"] = (
    _with(("sh",),
        f"u AS (SELECT image_id, height, width, t, {', '.join(f'{_u(11, "image_id", "t", i)} AS u{i}' for i in range(4))} FROM sh, range(1, 11) r(t))",
        "a AS (SELECT *, height * width * (0.08::DOUBLE + 0.92::DOUBLE * u0) AS area, exp(ln(0.75::DOUBLE) + (ln(4.0::DOUBLE / 3) - ln(0.75::DOUBLE)) * u1) AS aspect FROM u)",
        "d AS (SELECT *, round_even(sqrt(area * aspect), 0)::INTEGER AS cw, round_even(sqrt(area / aspect), 0)::INTEGER AS ch FROM a)",
        "f AS (SELECT image_id, arg_min({'top': floor(u2 * (height - ch + 1))::INTEGER, 'left': floor(u3 * (width - cw + 1))::INTEGER, 'h': ch, 'w': cw}, t) AS c FROM d WHERE ch > 0 AND ch <= height AND cw > 0 AND cw <= width GROUP BY image_id)")
    + "SELECT image_id, height::INTEGER AS height, width::INTEGER AS width, coalesce(c.top, (height - least(height, width)) // 2)::INTEGER AS top, coalesce(c.left, (width - least(height, width)) // 2)::INTEGER AS left, coalesce(c.h, least(height, width))::INTEGER AS crop_h, coalesce(c.w, least(height, width))::INTEGER AS crop_w FROM sh LEFT JOIN f USING (image_id)"
)
_VEC = "v AS (SELECT vec_id AS image_id, label, i, i // 8 AS y, i % 8 AS x, (embedding[i + 1]::DOUBLE + 1) / 2 AS p FROM embeddings, range(64) t(i))"
ORACLE_SQL["augmented"] = _with((), _VEC,
    f"d AS (SELECT DISTINCT image_id, {_u(1, 0, 'image_id')} < 0.5 AS flip, 1 + 0.2::DOUBLE * (2 * {_u(1, 0, 'image_id', 0)} - 1) AS b, 1 + 0.2::DOUBLE * (2 * {_u(1, 0, 'image_id', 1)} - 1) AS c, floor({_u(1, 0, 'image_id', 2)} * 5)::BIGINT - 2 AS dy, floor({_u(1, 0, 'image_id', 3)} * 5)::BIGINT - 2 AS dx FROM v)",
    "f AS (SELECT image_id, y, CASE WHEN flip THEN 7 - x ELSE x END AS x, p, b, c, dy, dx FROM v JOIN d USING (image_id))",
    "m AS (SELECT image_id, avg(p) AS mean FROM f GROUP BY ALL)",
    "j AS (SELECT image_id, y, x, greatest(0.0, least(1.0, (p * b - mean * b) * c + mean * b)) AS p, dy, dx FROM f JOIN m USING (image_id))"
) + "SELECT o.image_id, o.i::INTEGER AS i, round(coalesce(j.p, 0.0), 6) + 0.0 AS value FROM (SELECT image_id, i, y, x, dy, dx FROM v JOIN d USING (image_id)) o LEFT JOIN j ON j.image_id = o.image_id AND j.y = o.y + o.dy AND j.x = o.x + o.dx"
_PARTNER = (
    "own AS (SELECT vec_id AS image_id, label, embedding, vec_id // 64 AS batch, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) AS turn FROM embeddings)",
    "oth AS (SELECT label AS ol, embedding AS oe, vec_id // 64 AS batch, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY md5(concat_ws(':', 3, vec_id)), vec_id) AS turn FROM embeddings)",
    "two AS (SELECT image_id, label, ol, embedding, oe, i FROM own JOIN oth USING (batch, turn), range(64) t(i))",
)
ORACLE_SQL["mixup"] = _with((), *_PARTNER) + "SELECT image_id, i::INTEGER AS i, round(0.7::DOUBLE * embedding[i + 1]::DOUBLE + 0.3::DOUBLE * oe[i + 1]::DOUBLE, 6) + 0.0 AS value, round(CASE WHEN i < 10 THEN 0.7::DOUBLE * (label = i)::INTEGER * 0.9 + 0.3::DOUBLE * (ol = i)::INTEGER * 0.9 + 0.01 ELSE 0 END, 9) + 0.0 AS target FROM two"
ORACLE_SQL["cutmix"] = _with((), *_PARTNER, f"c AS (SELECT vec_id AS image_id, floor({_u(3, 'vec_id', 0)} * 5) AS t, floor({_u(3, 'vec_id', 1)} * 5) AS l FROM embeddings)") + "SELECT image_id, i::INTEGER AS i, round(CASE WHEN i // 8 >= t AND i // 8 < t + 4 AND i % 8 >= l AND i % 8 < l + 4 THEN oe[i + 1]::DOUBLE ELSE embedding[i + 1]::DOUBLE END, 6) + 0.0 AS value, round(CASE WHEN i < 10 THEN 0.75 * (label = i)::INTEGER + 0.25 * (ol = i)::INTEGER ELSE 0 END, 9) + 0.0 AS target FROM two JOIN c USING (image_id)"
ORACLE_SQL["random_coefficients"] = _with(_DCT, "kept AS (SELECT i AS pos FROM range(64) t(i) ORDER BY md5(concat_ws(':', 5, i)), i LIMIT 20)") + "SELECT pos::INTEGER AS pos, round(sum(CASE WHEN pos IN (SELECT pos FROM kept) THEN v * v ELSE 0 END), 6) + 0.0 AS energy, count(*)::BIGINT AS n FROM z GROUP BY pos"

ORACLE_SQL["crop_resize"] = _with((), _VEC,
    "c AS (SELECT image_id, image_id % 3 AS t, image_id % 2 AS l, least(3 + image_id % 3, 8 - image_id % 3) AS ch, least(2 + image_id % 5, 8 - image_id % 2) AS cw FROM v WHERE i = 0)",
    *(f"w{n} AS (SELECT n, o, i, w / sum(w) OVER (PARTITION BY n, o) AS w FROM (SELECT n, o, i, greatest(0, 1 - abs(i - CASE WHEN n > {n} THEN (o + 0.5) * n / {n}.0::DOUBLE - 0.5 ELSE greatest(0, least(n - 1, (o + 0.5) * n / {n}.0::DOUBLE - 0.5)) END) / greatest(1, n / {n}.0::DOUBLE)) AS w FROM range(1, 9) a(n), range({n}) b(o), range(8) c(i) WHERE i < n))" for n in (6, 3)),
) + "SELECT image_id, (wy.o * 3 + wx.o)::INTEGER AS i, round(sum(p * wy.w * wx.w), 6) + 0.0 AS value FROM v JOIN c USING (image_id) JOIN w6 wy ON wy.n = ch AND wy.i = y - t JOIN w3 wx ON wx.n = cw AND wx.i = x - l GROUP BY ALL"
_SIDE = "CASE WHEN {a} = {s} THEN {g} ELSE greatest(1, floor({a} * {g} / {s}::DOUBLE + 0.5)) END::INTEGER"
ORACLE_SQL["view_sizes"] = _with(("sh",), "s AS (SELECT *, least(height, width) AS lo, greatest(height, width) AS hi, least(160, greatest(height, width)) AS g FROM sh)") + f"SELECT image_id, {_SIDE.format(a='height', s='lo', g='128')} AS shorter_h, {_SIDE.format(a='width', s='lo', g='128')} AS shorter_w, {_SIDE.format(a='height', s='hi', g='g')} AS most_h, {_SIDE.format(a='width', s='hi', g='g')} AS most_w FROM s"
ORACLE_SQL["grid_crops"] = f"SELECT image_id, patch::INTEGER AS patch, ((patch // 4 - t) * 2 + patch % 4 - l)::INTEGER AS cell FROM (SELECT vec_id // 20 AS image_id, vec_id % 20 AS patch, floor({_u(9, 2, 'vec_id // 20', 7)} * 3)::BIGINT AS t, floor({_u(9, 2, 'vec_id // 20', 8)} * 3)::BIGINT AS l FROM embeddings) WHERE patch // 4 - t BETWEEN 0 AND 2 AND patch % 4 - l BETWEEN 0 AND 1"
ORACLE_SQL["saturated"] = _with((), _CHANNELS, f"s AS (SELECT image_id, i, r / 255 AS r, g / 255 AS g, b / 255 AS b, 0.299::DOUBLE * r / 255 + 0.587::DOUBLE * g / 255 + 0.114::DOUBLE * b / 255 AS y, 1 + 0.5 * (2 * {_u(4, 1, 'image_id', 4)} - 1) AS k FROM ch)") + " UNION ALL ".join(f"SELECT image_id, (i + {64 * n})::INTEGER AS i, round(greatest(0.0, least(1.0, y + ({c} - y) * k)), 6) + 0.0 AS value FROM s" for n, c in enumerate("rgb"))
ORACLE_SQL["affine_shifts"] = _with((), _VEC,
    f"d AS (SELECT image_id, (2 * {_u(6, 3, 'image_id', 5)} - 1) * 1.5 AS dy, (2 * {_u(6, 3, 'image_id', 6)} - 1) * 1.5 AS dx FROM v WHERE i = 0)",
    "t AS (SELECT image_id, i, floor(y + dy) + a AS sy, floor(x + dx) + b AS sx, (CASE WHEN a = 1 THEN y + dy - floor(y + dy) ELSE 1 - (y + dy - floor(y + dy)) END) * (CASE WHEN b = 1 THEN x + dx - floor(x + dx) ELSE 1 - (x + dx - floor(x + dx)) END) AS w FROM v JOIN d USING (image_id), range(2) p(a), range(2) q(b))",
) + "SELECT t.image_id, t.i::INTEGER AS i, round(sum(w * coalesce(v.p, 0.0)), 6) + 0.0 AS value FROM t LEFT JOIN v ON v.image_id = t.image_id AND v.y = t.sy AND v.x = t.sx GROUP BY ALL"
ORACLE_SQL["nested_masks"] = _with(("zz",)) + "SELECT level::INTEGER AS level, r::INTEGER AS u, count(*)::BIGINT AS n FROM zz, range(5) t(level) WHERE least(pos // 12, 4) <= level GROUP BY ALL"
ORACLE_SQL["row_major_cutoff"] = _with(_DCT) + "SELECT patch::INTEGER AS patch, round(sum(CASE WHEN u * 8 + w < (patch % 16 + 1) * 4 THEN v * v ELSE 0 END), 6) + 0.0 AS energy FROM z GROUP BY patch"
ORACLE_SQL["residual_serve"] = _with(_DCT, _LOWPASS.format(n=16)) + "SELECT lp.image_id, lp.patch::INTEGER AS patch, lp.i::INTEGER AS i, round(CASE WHEN lp.patch IN (0, 7) THEN p ELSE lp.v END, 6) + 0.0 AS value FROM lp JOIN px USING (image_id, patch, i)"
ORACLE_SQL["bucket_pilot_stats"] = _with(_GRAD, "b AS (SELECT NULL::INTEGER AS bucket_id, 'band' AS kind, band_id AS idx, avg(abs(g)) AS value FROM grad GROUP BY band_id UNION ALL SELECT (image_id % 3)::INTEGER, 'patch', patch, avg(abs(g)) FROM grad GROUP BY ALL)") + "SELECT bucket_id, kind, idx::INTEGER AS idx, round(value / (sum(value) OVER (PARTITION BY bucket_id, kind) + 1e-8), 9) AS value FROM b"
ORACLE_SQL["bucket_histogram"] = (
    ORACLE_SQL["coarse_buckets"].replace("SELECT image_id, bucket_id::INTEGER AS bucket_id, h::INTEGER AS bucket_nph, w::INTEGER AS bucket_npw FROM b JOIN k USING (raw)", "")
    + "SELECT bucket_id::INTEGER AS bucket_id, count(*)::BIGINT AS images, round(count(*) / sum(count(*)) OVER (), 9) AS share, (count(*) OVER ())::INTEGER AS buckets, 16::INTEGER AS requested FROM b JOIN k USING (raw) GROUP BY bucket_id"
)
ORACLE_SQL["equalised_batches"] = "WITH b AS (SELECT DISTINCT vec_id // 48 AS shard_id, vec_id % 48 // 10 AS batch_no FROM embeddings), o AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', 8, 2, shard_id, batch_no)), shard_id, batch_no) - 1 AS at_, count(*) OVER () AS n FROM b) SELECT shard_id::INTEGER AS shard_id, batch_no::INTEGER AS batch_no, (at_ % 3)::INTEGER AS rank, (at_ // 3)::INTEGER AS place FROM o WHERE at_ < n // 3 * 3"
ORACLE_SQL["sample_limits"] = _with(("sh",)) + "SELECT image_id, height::INTEGER AS height, width::INTEGER AS width FROM sh ORDER BY md5(concat_ws(':', 13, image_id)), image_id LIMIT 40"
ORACLE_SQL["ssim_by_channel"] = _with((*_DCT, "scale99", "qz", "ih", "pairs"), "m AS (SELECT image_id, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM pairs GROUP BY ALL)") + "SELECT image_id // 3 AS image_id, count(*)::BIGINT AS channels, round(avg((2 * ma * mb + 0.0001) * (2 * c + 0.0009) / ((ma * ma + mb * mb + 0.0001) * (va + vb + 0.0009))), 9) AS ssim FROM m GROUP BY ALL"
ORACLE_SQL["store_mismatches"] = _with(("sh",)) + "SELECT count(*) FILTER (image_id % 11 <> 5)::BIGINT AS matched, count(*) FILTER (image_id % 11 = 5)::BIGINT AS only_a, 0::BIGINT AS only_b, count(*) FILTER (image_id % 11 <> 5 AND image_id % 7 = 0)::BIGINT AS labels_differ, count(*) FILTER (image_id % 11 <> 5 AND image_id % 5 = 0)::BIGINT AS shapes_differ FROM sh"
ORACLE_SQL["fidelity_at"] = "WITH s AS (SELECT e, greatest(16, least(256, round_even(256 * (0.4::DOUBLE + 0.5::DOUBLE * pow(e / 29.0::DOUBLE, 1.5)), 0)))::BIGINT AS budget FROM range(30) t(e)) SELECT a.e::INTEGER AS epoch, budget, 30::BIGINT AS epochs, (SELECT budget FROM s WHERE e = 0) AS first, (SELECT budget FROM s WHERE e = 29) AS last, (SELECT min(budget) FROM s) AS least, (SELECT max(budget) FROM s) AS most, (SELECT round(avg(budget), 9) FROM s) AS mean FROM range(0, 60, 7) a(e) JOIN s ON s.e = least(a.e, 29)"
ORACLE_SQL["tar_scan"] = "WITH d AS (SELECT doc_id // 40 AS shard, row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id) - 1 AS position, doc_id, text FROM documents WHERE doc_id IS NOT NULL) SELECT shard::INTEGER AS shard, position::INTEGER AS position, 'd/k' || doc_id AS key, sha256(coalesce(text, '')) AS sha, (doc_id % 10)::INTEGER AS label FROM d WHERE position >= 10"
ORACLE_SQL["jpeg_blocks"] = _with(_DCT) + "SELECT image_id, patch::INTEGER AS patch, pos::INTEGER AS pos, greatest(-1000, least(1000, round_even(v * 50.0, 0)))::INTEGER AS q FROM z"
ORACLE_SQL["jpeg_report"] = _with(_DCT, "k AS (SELECT image_id, image_id % 4 AS kind, avg((round_even(v * 50.0, 0) = 0)::INTEGER) * count(*) / 1280.0 + (1280 - count(*)) / 1280.0 AS zeros FROM z GROUP BY ALL)") + "SELECT CASE WHEN kind = 3 THEN NULL ELSE 'grayscale' END AS subsampling, CASE kind WHEN 2 THEN 'only baseline files with a single full scan can be read' WHEN 3 THEN 'no JPEG' END AS reason, count(*)::BIGINT AS files, sum(CASE WHEN kind < 2 THEN 20 END)::BIGINT AS blocks, round(avg(CASE WHEN kind < 2 THEN zeros END), 6) AS zero_share FROM k GROUP BY 1, 2"
ORACLE_SQL["run_histories"] = "WITH e AS (SELECT (user_id % 9)::INTEGER AS run, event_id % 6 AS x, round(avg(abs(value)), 9) AS acc FROM events WHERE value IS NOT NULL GROUP BY ALL) SELECT run, (row_number() OVER (PARTITION BY run ORDER BY x) - 1)::INTEGER AS epoch, acc, CASE WHEN run % 3 = 2 THEN 1.0 ELSE round(0.5 + x / 100.0::DOUBLE, 9) END::DOUBLE AS io_ratio FROM e"
_IMAGES = "im AS (SELECT vec_id // 60 AS image_id FROM embeddings GROUP BY 1 HAVING count(DISTINCT vec_id // 20) = 3)"
ORACLE_SQL["streamed_store"] = f"WITH {_IMAGES} SELECT image_id, (image_id % 10)::INTEGER AS label, 40::INTEGER AS height, 32::INTEGER AS width, 5::INTEGER AS nph, 4::INTEGER AS npw, 6::INTEGER AS num_tiles, 24::BIGINT AS chunks, 80::BIGINT AS cells FROM im"
ORACLE_SQL["crop_read_ops"] = f"WITH {_IMAGES}, t AS (SELECT image_id, image_id % 9 AS t FROM im) SELECT image_id, (2 * ((least(5, (t + 27) // 8) + 1) // 2 - t // 8 // 2) * 2)::BIGINT AS read_ops FROM t"
ORACLE_SQL["trial_report"] = _with(_DCT, "e AS (SELECT band_id, round(sum(v * v), 6) AS energy FROM z GROUP BY ALL)") + "SELECT kind, band_id::INTEGER AS band_id, energy FROM e, (VALUES ('json'), ('csv')) t(kind)"
ORACLE_SQL["record_files"] = "WITH v AS (SELECT vec_id, label, list_sum(list_transform(embedding, lambda x: floor((x::DOUBLE + 1) / 2 * 255) / 255.0::DOUBLE)) AS total FROM embeddings ORDER BY vec_id LIMIT 400) SELECT kind, (row_number() OVER (PARTITION BY kind ORDER BY vec_id) - 1)::BIGINT AS position, label::INTEGER AS label, round(total, 6) + 0.0 AS total FROM v, (VALUES ('records'), ('idx')) t(kind)"
ORACLE_SQL["bucket_canvas"] = _with((), _VEC, "s AS (SELECT image_id, 4 + image_id % 4 AS h, 5 + image_id % 3 AS w, image_id % 2 AS b FROM v WHERE i = 0)", "c AS (SELECT b, max(h) AS ch, max(w) AS cw FROM s GROUP BY b)") + "SELECT s.image_id, (a.y * cw + a.x)::INTEGER AS i, round(v.p, 6) + 0.0 AS value FROM s JOIN c USING (b), (SELECT y, x FROM range(8) p(y), range(8) q(x)) a JOIN v ON v.image_id = s.image_id AND v.y = least(a.y, h - 1) AND v.x = least(a.x, w - 1) WHERE a.y < ch AND a.x < cw"
_BUCKET_SCALE = "sb AS (SELECT image_id % 2 AS bucket_id, band_id, greatest(quantile_cont(abs(v), 0.99) / 127, 1e-12) AS scale FROM z GROUP BY ALL)"
ORACLE_SQL["bucket_scales"] = _with(_DCT, _BUCKET_SCALE) + "SELECT bucket_id::INTEGER AS bucket_id, band_id::INTEGER AS band_id, round(scale, 9) AS scale FROM sb"
ORACLE_SQL["bucket_scaled_serve"] = _with(_DCT, _BUCKET_SCALE) + "SELECT image_id, count(DISTINCT patch)::BIGINT AS blocks, round(sum(pow(greatest(-128, least(127, round_even(v::FLOAT::DOUBLE / scale, 0))) * scale, 2)), 3) AS energy FROM z JOIN sb ON sb.bucket_id = image_id % 2 AND sb.band_id = z.band_id WHERE z.band_id < 6 GROUP BY image_id"
ORACLE_SQL["crop_pixels"] = f"""WITH {_CTE['basis']}, {_CTE['zz']}, {_IMAGES}, qt AS ({_table(95)}),
p3 AS (SELECT vec_id // 60 AS image_id, vec_id // 20 % 3 AS c, vec_id % 20 AS patch, i, (embedding[i + 1]::DOUBLE + 1) / 2 * 255 AS v FROM embeddings, range(64) t(i)),
rgb AS (SELECT image_id, patch, i, max(CASE WHEN c = 0 THEN v END) AS r, max(CASE WHEN c = 1 THEN v END) AS g, max(CASE WHEN c = 2 THEN v END) AS b FROM p3 JOIN im USING (image_id) GROUP BY ALL),
yc AS (SELECT image_id, patch, i // 8 AS y, i % 8 AS x, 0 AS c, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b - 128 AS p FROM rgb
  UNION ALL SELECT image_id, patch, i // 8, i % 8, 1, -0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b FROM rgb
  UNION ALL SELECT image_id, patch, i // 8, i % 8, 2, 0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b FROM rgb),
h AS (SELECT image_id, patch, c, k AS u, x, sum(value * p) AS s FROM yc JOIN basis ON basis.i = y GROUP BY ALL),
d AS (SELECT image_id, patch, c, u, k AS w, sum(value * s) AS v FROM h JOIN basis ON basis.i = x GROUP BY ALL),
q AS (SELECT image_id, patch, d.c, u, w, round_even(v / q, 0) * q AS v FROM d JOIN zz ON u = zz.r AND w = zz.c JOIN qt ON channel = d.c AND "natural" = u * 8 + w WHERE pos < 21),
ih AS (SELECT image_id, patch, c, w, i AS y, sum(value * v) AS s FROM q JOIN basis ON k = u GROUP BY ALL),
sp AS (SELECT image_id, patch, c, y, i AS x, sum(value * s) AS v FROM ih JOIN basis ON k = w GROUP BY ALL),
co AS (SELECT image_id, patch // 4 * 8 + y - 5 AS y, patch % 4 * 8 + x - 3 AS x, max(CASE WHEN c = 0 THEN v END) + 128 AS l, max(CASE WHEN c = 1 THEN v END) AS cb, max(CASE WHEN c = 2 THEN v END) AS cr FROM sp GROUP BY ALL)
SELECT image_id, (n * 360 + y * 18 + x)::INTEGER AS i, round(greatest(0.0, least(1.0, CASE n WHEN 0 THEN l + 1.402::DOUBLE * cr WHEN 1 THEN l - 0.344136::DOUBLE * cb - 0.714136::DOUBLE * cr ELSE l + 1.772::DOUBLE * cb END / 255)), 4) + 0.0 AS value
FROM co, range(3) t(n) WHERE y BETWEEN 0 AND 19 AND x BETWEEN 0 AND 17"""


def _search(steps: int) -> str:
    """The search for a precision as a chain of trials, for data that int8 serves well enough at a multiplier of 1 but not of 256."""

    def trial(k: int, m: str) -> str:
        return f"""t{k} AS MATERIALIZED (SELECT {k} AS trial, *, psnr >= 45 AND ssim >= 0.99 AS passed FROM (
  SELECT any_value(m) AS multiplier, least(120, -10 * log10(avg((v - b) * (v - b)))) AS psnr,
    (2 * avg(v) * avg(b) + 0.0001) * (2 * covar_pop(v, b) + 0.0009) / ((avg(v) * avg(v) + avg(b) * avg(b) + 0.0001) * (var_pop(v) + var_pop(b) + 0.0009)) AS ssim,
    avg((raw > 127 OR raw < -128)::INTEGER) AS clip_fraction, avg((q = 0)::INTEGER) AS zero_fraction
  FROM (SELECT *, q * sc AS b FROM (SELECT *, greatest(-128, least(127, raw)) AS q FROM (SELECT v, m, s * m AS sc, round_even(v / (s * m), 0) AS raw FROM zs, (SELECT {m} AS m))))))"""

    chain = ["sm AS (SELECT band_id, greatest(max(abs(v)) / 127, 1e-12) AS s FROM z GROUP BY ALL)", "zs AS MATERIALIZED (SELECT v, s FROM z JOIN sm USING (band_id))", trial(0, "256.0::DOUBLE"), trial(1, "1.0::DOUBLE"), "s2 AS MATERIALIZED (SELECT 1.0::DOUBLE AS lo, 256.0::DOUBLE AS hi)"]
    for k in range(2, steps + 2):
        chain += [trial(k, f"(SELECT sqrt(lo * hi) FROM s{k})"), f"s{k + 1} AS MATERIALIZED (SELECT CASE WHEN passed THEN multiplier ELSE lo END AS lo, CASE WHEN passed THEN hi ELSE multiplier END AS hi FROM s{k}, t{k})"]
    chain.append("a AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(steps + 2)) + ")")
    chain.append(f"b AS (SELECT * FROM a UNION ALL SELECT {steps + 2}, * EXCLUDE (trial) FROM (SELECT * FROM a WHERE passed ORDER BY trial DESC LIMIT 1))")
    return _with(_DCT, *chain) + "SELECT trial::INTEGER AS trial, 'int8' AS dtype, round(multiplier, 9) AS multiplier, round(psnr, 4) AS psnr, round(ssim, 9) AS ssim, round(clip_fraction, 9) + 0.0 AS clip_fraction, round(zero_fraction, 9) + 0.0 AS zero_fraction, passed FROM b"


ORACLE_SQL["precision_search"] = _search(18)
