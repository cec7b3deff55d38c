"""Queries on statistics, normalisation and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as N
from ..operators.mask import BANDS, is_artefact
from ..sources.files import scratch
from ..sources.views import oracle, scene, scene_px

SEED = 42


def clean(spark, sf_dir):
    """The scene with artefacts as NULL."""
    return scene(spark, sf_dir).withColumns({b: F.when(~is_artefact(b), F.col(b)) for b in BANDS})


def rounded(df, n: int = 6):
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def n01_sample_windows(spark, sf_dir):
    return N.sample_windows(scene_px(spark, sf_dir), per_tile=3, tries=20, size=32, extent=256, seed=SEED)


def n02_from_sketches(spark, sf_dir):
    """n02's rows from stored sketches: of three tiles, then of one that came later."""
    px, path = clean(spark, sf_dir), scratch(spark, "sketches")
    for tiles in ("tile_id < 3", "tile_id = 3"):
        N.tile_sketches(px.where(tiles), BANDS).write.mode("append").parquet(path)
    return rounded(N.stats_from_sketches(spark.read.parquet(path), px, BANDS))


def n02_band_stats(spark, sf_dir):
    return rounded(N.band_stats(clean(spark, sf_dir), BANDS))


def n03_robust_norm(spark, sf_dir):
    px = clean(spark, sf_dir)
    return rounded(N.normalise(px, N.read_stats(N.band_stats(px, BANDS)), BANDS, "median", "iqr").select("px_row", "px_col", "b2", "b7"))


def n04_zscore_stats(spark, sf_dir):
    return rounded(N.zscore_stats(clean(spark, sf_dir), BANDS))


def n04_zscore_first_band(spark, sf_dir):
    return rounded(N.zscore_stats(clean(spark, sf_dir), BANDS, per_band=False))


def n04_zscore_sampled(spark, sf_dir):
    """From 40 tried windows of 32 x 32 a tile, ten kept, and 2000 values a band at most."""
    px = clean(spark, sf_dir)
    return rounded(N.zscore_sampled(px, BANDS, N.sample_windows(px, per_tile=10, tries=40, size=32, extent=256, seed=SEED), 32, 2000, SEED))


def s08_stats_table(spark, sf_dir):
    path = scratch(spark, "stats")
    stats = N.band_stats(clean(spark, sf_dir), BANDS)
    N.write_stats(stats, path)
    return rounded(N.read_stats(spark.read.schema(stats.schema).option("header", True).csv(path)))


def n05_apply_norm(spark, sf_dir):
    px = clean(spark, sf_dir)
    return rounded(N.normalise(px, N.zscore_stats(px, BANDS), BANDS, "mean", "std", only=["b4"]).select("px_row", "px_col", "b3", "b4"))


def _qc(spark, sf_dir):
    px = clean(spark, sf_dir)
    return N.assess(px, N.band_stats(px, BANDS), BANDS)


def n06_assess(spark, sf_dir):
    return rounded(_qc(spark, sf_dir))


def n07_verdict(spark, sf_dir):
    return N.verdict(_qc(spark, sf_dir))


def n08_compare_norm(spark, sf_dir):
    px = clean(spark, sf_dir)
    return rounded(N.compare_norm(px, N.band_stats(scene(spark, sf_dir), BANDS), N.band_stats(px, BANDS), BANDS))


def n09_box_stats(spark, sf_dir):
    return rounded(N.box_stats(scene(spark, sf_dir), BANDS))


def n10_sample_n(spark, sf_dir):
    v = N.unpivot(clean(spark, sf_dir), BANDS, ["px_row", "px_col"])
    return N.sample_n(v, 200, SEED, ["band"], ["px_row", "px_col"])


def n11_standardize(spark, sf_dir):
    return rounded(N.standardize(clean(spark, sf_dir), BANDS).select("px_row", "px_col", "b2", "b9"))


def n12_clip_robust(spark, sf_dir):
    return rounded(N.clip_robust(clean(spark, sf_dir), BANDS).select("px_row", "px_col", "b1", "b6"))


def n13_null_report(spark, sf_dir):
    return rounded(N.null_report(clean(spark, sf_dir), BANDS))


def n15_window_stats(spark, sf_dir):
    return rounded(N.window_stats(scene(spark, sf_dir).where("px_row < 64 AND px_col < 64"), "b2"))


def n16_raster_stats(spark, sf_dir):
    return rounded(N.window_stats(scene(spark, sf_dir), "b2"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k[0] in "ns" and k[1:3].isdigit()}

_ART = "({0} = 0 OR {0} >= 60000)"
_CLEAN = "clean AS (SELECT px_row, px_col, " + ", ".join(f"CASE WHEN NOT {_ART.format(b)} THEN {b} END AS {b}" for b in BANDS) + " FROM scene)"


def _long(table):
    return " UNION ALL ".join(f"SELECT '{b}' AS band, px_row, px_col, {b} AS v FROM {table} WHERE {b} IS NOT NULL" for b in BANDS)


_STATS = """SELECT band, median(v) AS median, CASE WHEN quantile_cont(v, 0.98) - quantile_cont(v, 0.02) > 0 THEN quantile_cont(v, 0.98) - quantile_cont(v, 0.02) ELSE 1 END AS iqr,
 count(*) AS n_samples, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_pop(v) AS std FROM {} GROUP BY band"""
_HEAD = f"WITH {_CLEAN}, v AS ({_long('clean')}), v0 AS ({_long('scene')}), st AS ({_STATS.format('v')}), st0 AS ({_STATS.format('v0')})\n"
_of = lambda body: oracle(_HEAD + body, "scene")
_one = lambda b, c: f"(SELECT {c} FROM st WHERE band = '{b}')"
_QC = """SELECT band, count(*) AS n_samples, avg(v) AS raw_mean, stddev_pop(v) AS raw_std, min(v) AS raw_min, max(v) AS raw_max, avg(z) AS norm_mean, stddev_pop(z) AS norm_std,
 min(z) AS norm_min, max(z) AS norm_max, quantile_cont(z, 0.05) AS norm_q05, quantile_cont(z, 0.95) AS norm_q95, count(*) FILTER (WHERE z > 5) AS outliers_pos, count(*) FILTER (WHERE z < -5) AS outliers_neg
 FROM (SELECT v.band, v, (v - median) / iqr AS z FROM v JOIN st ON v.band = st.band) GROUP BY band HAVING count(*) > 10"""
_QC_COLS = "raw_mean raw_std raw_min raw_max norm_mean norm_std norm_min norm_max norm_q05 norm_q95".split()
_BOX = """SELECT round(min(q1), 6) AS q1, round(min(q2), 6) AS median, round(min(q3), 6) AS q3, band, round(min(v) FILTER (WHERE ok), 6) AS low, round(max(v) FILTER (WHERE ok), 6) AS high, count(*) FILTER (WHERE NOT ok) AS n_fliers
 FROM (SELECT *, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM (SELECT v0.band, v, q1, q2, q3 FROM v0 JOIN (SELECT band, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM v0 GROUP BY band) q ON q.band = v0.band)) GROUP BY band"""
_WIN = "round(min(b2), 6) AS min, round(max(b2), 6) AS max, round(avg(b2), 6) AS mean, round(stddev_pop(b2), 6) AS std, count(*) AS n, count(*) FILTER (WHERE b2 = 0) AS n_zero, round(100.0 * count(*) FILTER (WHERE b2 <> 0) / count(*), 6) AS pct_nonzero, count(DISTINCT b2) AS n_unique, array_to_string(list_sort(list(DISTINCT b2::BIGINT))[1:20], ',') AS least_values"
_DRAW = "(('0x' || substr(md5('42{0}:' || tile_id || ':' || win), 1, 7))::BIGINT % 225)"
_WINDOWS = f"SELECT tile_id, row0, col0 FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY win) AS rk FROM (SELECT w.tile_id, win, row0, col0 FROM (SELECT tile_id, win, {_DRAW.format('r')} AS row0, {_DRAW.format('c')} AS col0 FROM (SELECT DISTINCT tile_id FROM scene), range(40) r(win)) w JOIN (SELECT s.tile_id, px_row, px_col FROM scene s WHERE NOT {_ART.format('b1')}) p ON p.tile_id = w.tile_id AND px_row BETWEEN row0 AND row0 + 31 AND px_col BETWEEN col0 AND col0 + 31 GROUP BY ALL HAVING count(*) >= 0.02 * 1024)) WHERE rk <= 10"
ORACLES = {
    "n01_sample_windows": oracle(f"SELECT tile_id, win, row0, col0, n_valid FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY win) AS rn FROM (SELECT w.tile_id, win, row0, col0, count(*) AS n_valid FROM (SELECT tile_id, win, {_DRAW.format('r')} AS row0, {_DRAW.format('c')} AS col0 FROM (SELECT DISTINCT tile_id FROM scene_px), range(20) r(win)) w JOIN (SELECT DISTINCT tile_id, px_row, px_col FROM scene_px) p ON p.tile_id = w.tile_id AND px_row BETWEEN row0 AND row0 + 31 AND px_col BETWEEN col0 AND col0 + 31 GROUP BY ALL HAVING count(*) >= 0.02 * 1024)) WHERE rn <= 3", "scene_px"),
    "n02_band_stats": _of("SELECT band, n_samples, " + ", ".join(f"round({c}, 6) AS {c}" for c in "median iqr min max mean std".split()) + " FROM st"),
    "n03_robust_norm": _of("SELECT px_row, px_col, " + ", ".join(f"round(({b} - {_one(b, 'median')}) / greatest({_one(b, 'iqr')}, 1e-6), 6) AS {b}" for b in ("b2", "b7")) + " FROM clean"),
    "n04_zscore_stats": _of("SELECT band, round(mean, 6) AS mean, round(CASE WHEN std < 1e-6 THEN 1 ELSE std END, 6) AS std FROM st"),
    "n04_zscore_first_band": _of("SELECT b.band, round(mean, 6) AS mean, round(CASE WHEN std < 1e-6 THEN 1 ELSE std END, 6) AS std FROM (SELECT band FROM st) b, (SELECT * FROM st WHERE band = 'b1') s"),
    "n04_zscore_sampled": _of(f"SELECT band, round(avg(v), 6) AS mean, round(CASE WHEN stddev_pop(v) < 1e-6 THEN 1 ELSE stddev_pop(v) END, 6) AS std FROM (SELECT v.*, row_number() OVER (PARTITION BY band ORDER BY md5('42:' || px_row || ':' || px_col), px_row, px_col) AS rn FROM v JOIN (SELECT DISTINCT s.px_row, s.px_col FROM scene s JOIN ({_WINDOWS}) w ON w.tile_id = s.tile_id AND s.px_row BETWEEN row0 AND row0 + 31 AND s.px_col BETWEEN col0 AND col0 + 31) USING (px_row, px_col)) WHERE rn <= 2000 GROUP BY band"),
    "s08_stats_table": _of("SELECT band, round(median, 6) AS median, round(greatest(iqr, 1e-6), 6) AS iqr FROM st"),
    "n05_apply_norm": _of(f"SELECT px_row, px_col, round(b3, 6) AS b3, round((b4 - {_one('b4', 'mean')}) / {_one('b4', 'std')}, 6) AS b4 FROM clean"),
    "n06_assess": _of("SELECT band, n_samples, outliers_pos, outliers_neg, " + ", ".join(f"round({c}, 6) AS {c}" for c in _QC_COLS) + f" FROM ({_QC})"),
    "n07_verdict": _of(f"SELECT band, off_centre, bad_spread, many_outliers, narrow, NOT (off_centre OR bad_spread OR many_outliers) AS healthy FROM (SELECT band, abs(norm_mean) > 0.5 AS off_centre, NOT norm_std BETWEEN 0.7 AND 1.5 AS bad_spread, outliers_pos + outliers_neg > 10 AS many_outliers, norm_q95 - norm_q05 < 3 AS narrow FROM ({_QC}))"),
    "n08_compare_norm": _of("SELECT band, round(avg(z1), 6) AS mean_1, round(stddev_pop(z1), 6) AS std_1, round(avg(z2), 6) AS mean_2, round(stddev_pop(z2), 6) AS std_2, count(*) FILTER (WHERE abs(z1) > 5) AS outliers_1, count(*) FILTER (WHERE abs(z2) > 5) AS outliers_2, round(100.0 * (count(*) FILTER (WHERE abs(z1) > 5) - count(*) FILTER (WHERE abs(z2) > 5)) / greatest(count(*) FILTER (WHERE abs(z1) > 5), 1), 6) AS reduction_pct FROM (SELECT v.band, (v - st0.median) / st0.iqr AS z1, (v - st.median) / st.iqr AS z2 FROM v JOIN st ON st.band = v.band JOIN st0 ON st0.band = v.band) GROUP BY ROLLUP (band)"),
    "n09_box_stats": _of(_BOX),
    "n10_sample_n": _of("SELECT band, px_row, px_col, v FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('42:' || px_row || ':' || px_col), px_row, px_col) AS rn FROM v) WHERE rn <= 200"),
    "n11_standardize": _of("SELECT px_row, px_col, " + ", ".join(f"round(coalesce(({b} - {_one(b, 'mean')}) / ({_one(b, 'std')} + 1e-8), 0), 6) AS {b}" for b in ("b2", "b9")) + " FROM clean"),
    "n12_clip_robust": _of("SELECT px_row, px_col, " + ", ".join(f"round(CASE WHEN {b} IS NOT NULL THEN least(greatest({b}, lo), hi) END, 6) AS {b}" for b in ("b1", "b6")) + " FROM clean, (SELECT quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi FROM v JOIN clean USING (px_row, px_col) WHERE " + " AND ".join(f"{b} IS NOT NULL" for b in BANDS) + ")"),
    "n13_null_report": _of(" UNION ALL ".join(f"SELECT '{b}' AS band, count(*) FILTER (WHERE {b} IS NULL) AS n_null, round(100.0 * count(*) FILTER (WHERE {b} IS NULL) / count(*), 6) AS pct_null FROM clean" for b in BANDS)),
    "n15_window_stats": oracle(f"SELECT {_WIN} FROM scene WHERE px_row < 64 AND px_col < 64", "scene"),
    "n16_raster_stats": oracle(f"SELECT {_WIN} FROM scene", "scene"),
}
ORACLES["n02_from_sketches"] = ORACLES["n02_band_stats"]
