"""Queries on sliding prediction, uncertainty, scores and folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import predict as P
from ..operators.stats import seeded
from ..sources.views import mc_pred, oracle, scene
from .stats import clean, rounded

_BANDS = ("b1", "b2", "b3")


def model(px):
    """The test model: softmax of three linear scores that also depend on the place in the window."""
    x = (F.col("px_row") - F.col("row0")) * 0.01
    return P.softmax([F.col("b1") / 1000 + x, F.col("b2") / 1500 - x, F.col("b3") / 1200])


def _blended(spark, sf_dir):
    windows = P.window_explode(clean(spark, sf_dir).select("px_row", "px_col", *_BANDS), 256, 256, 32, 16)
    return P.blend(P.predict(P.prep_windows(windows, _BANDS), model), 3)


def p02_window_explode(spark, sf_dir):
    return P.window_explode(scene(spark, sf_dir).select("px_row", "px_col"), 250, 250, 32, 20)


def p03_prep_windows(spark, sf_dir):
    windows = P.prep_windows(P.window_explode(clean(spark, sf_dir).select("px_row", "px_col", *_BANDS), 256, 256, 32, 16), _BANDS)
    return windows.groupBy("row0", "col0").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.round(F.sum("b2"), 3).alias("sum_b2"))


def p05_blend(spark, sf_dir):
    return rounded(_blended(spark, sf_dir).select("px_row", "px_col", "weight", *[F.col("p")[k].alias(f"p{k + 1}") for k in range(3)]))


def block_model(windows, row0, col0):
    """The same model over whole windows."""
    x = np.arange(windows.shape[1])[None, :, None] * 0.01
    z = np.stack([windows[..., 0] / 1000 + x, windows[..., 1] / 1500 - x, windows[..., 2] / 1200], axis=-1)
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def p05_predict_blocks(spark, sf_dir):
    """p05's rows by blocks with borders."""
    px = P.predict_blocks(clean(spark, sf_dir), list(_BANDS), 256, 256, 32, 16, block_model, 3, 128)
    return rounded(px.select("px_row", "px_col", "weight", *[F.col("p")[k].alias(f"p{k + 1}") for k in range(3)]))


def p06_class_map(spark, sf_dir):
    return _blended(spark, sf_dir).select("px_row", "px_col", P.class_map("p", F.col("weight") > 0).alias("cls"))


def p07_prob_rasters(spark, sf_dir):
    return rounded(P.prob_rasters(_blended(spark, sf_dir)))


def u01_mc_summary(spark, sf_dir):
    return rounded(P.mc_summary(mc_pred(spark, sf_dir)))


def _entropy(spark, sf_dir):
    return P.entropy(P.mc_summary(mc_pred(spark, sf_dir)))


def u02_entropy(spark, sf_dir):
    return rounded(_entropy(spark, sf_dir))


def u03_mc_diagnostics(spark, sf_dir):
    return rounded(P.mc_diagnostics(mc_pred(spark, sf_dir)))


def u04_uncertainty_report(spark, sf_dir):
    px = _entropy(spark, sf_dir).selectExpr("*", "px_row div 8 AS chip_row", "px_col div 8 AS chip_col")
    return rounded(P.uncertainty_report(px, ["chip_row", "chip_col"]))


def u04_histogram(spark, sf_dir):
    return P.histogram(_entropy(spark, sf_dir))


def scored(spark, sf_dir):
    """Labelled pixels with mean class probabilities: label from band 4, 0 being background; chips of 8 x 8."""
    mean = P.mc_summary(mc_pred(spark, sf_dir)).groupBy("px_row", "px_col").agg(F.sort_array(F.collect_list(F.struct("k", "mean"))).alias("_p"))
    px = mean.join(scene(spark, sf_dir).select("px_row", "px_col", "b4"), ["px_row", "px_col"])
    px = px.select("px_row", "px_col", (F.col("b4").cast("bigint") % 4).cast("int").alias("label"), F.col("_p.mean").alias("p"))
    return px.withColumn("pred", P.class_map("p")).selectExpr("*", "px_row div 8 AS chip_row", "px_col div 8 AS chip_col")


_CHIP = ["chip_row", "chip_col"]


def c01_stratified(spark, sf_dir):
    px = scene(spark, sf_dir).select("px_row", "px_col", (F.col("b4").cast("bigint") % 4).alias("label"))
    return P.stratified(px, 1000, seeded(42, "px_row", "px_col"))


def c02_block_id(spark, sf_dir):
    return scene(spark, sf_dir).select("px_row", "px_col", P.block_id(50, 256).alias("block"))


def c03_group_kfold(spark, sf_dir):
    return P.group_kfold(c02_block_id(spark, sf_dir), "block", 5)


def c04_kfold(spark, sf_dir):
    chips = scene(spark, sf_dir).selectExpr("px_row div 32 AS chip_row", "px_col div 32 AS chip_col").distinct()
    return P.kfold(chips, 3, seeded(42, *_CHIP))


def c04_split(spark, sf_dir):
    chips = scene(spark, sf_dir).selectExpr("px_row div 8 AS chip_row", "px_col div 8 AS chip_col").distinct()
    return P.split(chips, seeded(42, *_CHIP))


def c05_balanced_weights(spark, sf_dir):
    return rounded(P.balanced_weights(scored(spark, sf_dir)))


def c09_classification_report(spark, sf_dir):
    return rounded(P.classification_report(scored(spark, sf_dir).where("label > 0")))


def c11_seg_class_weights(spark, sf_dir):
    return rounded(P.seg_class_weights(scored(spark, sf_dir)))


def c12_masked_f1(spark, sf_dir):
    return rounded(P.masked_f1(scored(spark, sf_dir)))


def c13_masked_accuracy(spark, sf_dir):
    return rounded(P.masked_accuracy(scored(spark, sf_dir)))


def c14_masked_ce(spark, sf_dir):
    px = scored(spark, sf_dir)
    return rounded(P.masked_ce(px, P.seg_class_weights(px)))


def c15_tversky(spark, sf_dir):
    return rounded(P.tversky(scored(spark, sf_dir), _CHIP))


def c15_focal_tversky(spark, sf_dir):
    return rounded(P.focal_tversky(P.tversky(scored(spark, sf_dir), _CHIP)))


def c16_dice(spark, sf_dir):
    return rounded(P.dice(scored(spark, sf_dir), _CHIP))


def c16_dice_ce(spark, sf_dir):
    px = scored(spark, sf_dir)
    return rounded(P.dice_ce(px, P.seg_class_weights(px), _CHIP))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k[0] in "puc" and k[1:3].isdigit()}

_ART = "({0} = 0 OR {0} >= 60000)"
_CLEAN = "clean AS (SELECT px_row, px_col, " + ", ".join(f"CASE WHEN NOT {_ART.format(b)} THEN {b} END AS {b}" for b in _BANDS) + " FROM scene)"
_WINS = "wins AS (SELECT *, b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL AS valid FROM clean, (SELECT i * 16 AS row0 FROM range(15) r(i)), (SELECT i * 16 AS col0 FROM range(15) c(i)) WHERE px_row BETWEEN row0 AND row0 + 31 AND px_col BETWEEN col0 AND col0 + 31)"
_PREP = "prep AS (SELECT px_row, px_col, row0, col0, valid, coalesce(b1, 0) AS b1, coalesce(b2, 0) AS b2, coalesce(b3, 0) AS b3 FROM (SELECT *, bool_or(valid) OVER (PARTITION BY row0, col0) AS live FROM wins) WHERE live)"
_SCORE = "score AS (SELECT *, exp(b1 / 1000 + (px_row - row0) * 0.01::DOUBLE) AS e1, exp(b2 / 1500 - (px_row - row0) * 0.01::DOUBLE) AS e2, exp(b3 / 1200) AS e3 FROM prep)"
_BLEND = "bl AS (SELECT px_row, px_col, sum(valid::INT)::DOUBLE AS weight, " + ", ".join(f"coalesce(sum(e{k} / (e1 + e2 + e3) * valid::INT) / nullif(sum(valid::INT), 0), 0) AS p{k}" for k in (1, 2, 3)) + " FROM score GROUP BY 1, 2)"
_win = lambda body: oracle(f"WITH {_CLEAN}, {_WINS}, {_PREP}, {_SCORE}, {_BLEND}\n{body}", "scene")
_MC = "mc AS (SELECT px_row, px_col, k, avg(p) AS mean, stddev_pop(p) AS std, var_pop(p) AS var, abs(max(p) FILTER (WHERE pass = 0) - max(p) FILTER (WHERE pass = 1)) AS diff FROM mc_pred GROUP BY 1, 2, 3)"
_ENT = "en AS (SELECT px_row, px_col, -sum(q * ln(q)) AS entropy FROM (SELECT px_row, px_col, greatest(1e-10, least(1 - 1e-10, mean)) / sum(greatest(1e-10, least(1 - 1e-10, mean))) OVER (PARTITION BY px_row, px_col) AS q FROM mc) GROUP BY 1, 2)"
_PX = "px AS (SELECT px_row, px_col, px_row // 8 AS chip_row, px_col // 8 AS chip_col, b4::BIGINT % 4 AS label, p1, p2, p3, CASE WHEN p1 >= p2 AND p1 >= p3 THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END AS pred FROM (SELECT px_row, px_col, " + ", ".join(f"max(mean) FILTER (WHERE k = {k}) AS p{k}" for k in (1, 2, 3)) + " FROM mc GROUP BY 1, 2) JOIN scene USING (px_row, px_col))"
_RAW = "raw AS (SELECT k AS label, (SELECT count(*) FROM px WHERE label > 0) / (3 * greatest((SELECT count(*) FROM px WHERE label = k), 1)) * CASE WHEN k = 2 THEN 1.8 ELSE 1 END AS w FROM range(1, 4) t(k)), wt AS (SELECT label, w / (SELECT avg(w) FROM raw) AS weight FROM raw)"
_SOFT = "soft AS (" + " UNION ALL ".join(f"SELECT chip_row, chip_col, {k} AS k, sum(CASE WHEN label = {k} THEN p{k} ELSE 0 END) AS tp, sum(p{k}) AS p, count(*) FILTER (WHERE label = {k}) AS t FROM px GROUP BY 1, 2" for k in (1, 2, 3)) + ")"
_mc = lambda body: oracle(f"WITH {_MC}, {_ENT}, {_PX}, {_RAW}, {_SOFT}\n{body}", "mc_pred")
_TI = "(tp + 1e-7) / (tp + 0.7 * (p - tp) + 0.3 * (t - tp) + 1e-7)"
_CE = "(SELECT sum(-ln(greatest(1e-7, least(1 - 1e-7, CASE label WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END))) * weight) / (sum(weight) + 1e-7) FROM px JOIN wt USING (label) WHERE label > 0)"
_DICE = "(SELECT avg((2 * tp + 1e-7) / (t + p + 1e-7)) FROM soft)"
_F1 = "SELECT k AS label, 2 * pr * re / (pr + re + 1e-7) AS f1, 100.0 * f / greatest(sum(f) OVER (), 1) AS pred_pct, 100.0 * t / greatest(sum(t) OVER (), 1) AS true_pct FROM (SELECT k, f, t, tp / (f + 1e-7) AS pr, tp / (t + 1e-7) AS re FROM (SELECT k, count(*) FILTER (WHERE label = k AND pred = k) AS tp, count(*) FILTER (WHERE pred = k) AS f, count(*) FILTER (WHERE label = k) AS t FROM px, range(1, 4) q(k) WHERE label > 0 GROUP BY k))"
_REP = "SELECT k, tp, f, t, coalesce(tp / nullif(f, 0), 0) AS pr, coalesce(tp / nullif(t, 0), 0) AS re, coalesce(2.0 * tp / nullif(f + t, 0), 0) AS f1 FROM (SELECT k, count(*) FILTER (WHERE label = k AND pred = k) AS tp, count(*) FILTER (WHERE pred = k) AS f, count(*) FILTER (WHERE label = k) AS t FROM px, range(1, 4) q(k) WHERE label > 0 GROUP BY k HAVING count(*) FILTER (WHERE pred = k OR label = k) > 0)"
_rep = lambda name, *e: f"SELECT {name} AS name, " + ", ".join(f"round({x}, 6) AS {n}" for x, n in zip(e, ("precision", "recall", "f1"))) + f", {e[3]}::BIGINT AS support FROM ({_REP})"
ORACLES = {
    "p02_window_explode": oracle("SELECT px_row, px_col, r.s AS row0, c.s AS col0 FROM scene, (SELECT i * 20 AS s FROM range(11) t(i) UNION SELECT 218) r, (SELECT i * 20 AS s FROM range(11) t(i) UNION SELECT 218) c WHERE px_row BETWEEN r.s AND r.s + 31 AND px_col BETWEEN c.s AND c.s + 31", "scene"),
    "p03_prep_windows": _win("SELECT row0, col0, count(*) AS n, count(*) FILTER (WHERE valid) AS n_valid, round(sum(b2), 3) AS sum_b2 FROM prep GROUP BY 1, 2"),
    "p05_blend": _win("SELECT px_row, px_col, weight, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3 FROM bl"),
    "p06_class_map": _win("SELECT px_row, px_col, CASE WHEN weight = 0 THEN 0 WHEN p1 >= p2 AND p1 >= p3 THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END AS cls FROM bl"),
    "p07_prob_rasters": _win(" UNION ALL ".join(f"SELECT px_row, px_col, {k} AS k, round(p{k}, 6) AS v FROM bl" for k in (1, 2, 3))),
    "u01_mc_summary": _mc("SELECT px_row, px_col, k, round(mean, 6) AS mean, round(std, 6) AS std FROM mc"),
    "u02_entropy": _mc("SELECT px_row, px_col, round(entropy, 6) AS entropy FROM en"),
    "u03_mc_diagnostics": _mc("SELECT round(avg(var), 6) AS mean_variance, round(max(diff), 6) AS max_difference, max(diff) < 1e-8 AS suspicious FROM mc"),
    "u04_uncertainty_report": _mc("SELECT chip_row, chip_col, count(*) AS n, round(100.0 * count(entropy) / count(*), 6) AS pct_valid, round(avg(entropy), 6) AS mean, round(min(entropy), 6) AS min, round(max(entropy), 6) AS max, count(entropy) = count(*) AS all_valid FROM (SELECT *, px_row // 8 AS chip_row, px_col // 8 AS chip_col FROM en) GROUP BY GROUPING SETS ((chip_row, chip_col), ())"),
    "u04_histogram": _mc("SELECT least(floor(entropy / ln(3) * 30), 29)::INT AS bin, count(*) AS n FROM en WHERE entropy BETWEEN 0 AND ln(3) GROUP BY 1"),
    "c01_stratified": oracle("SELECT label, px_row, px_col FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || px_row || ':' || px_col)) AS rn, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total FROM (SELECT px_row, px_col, b4::BIGINT % 4 AS label FROM scene)) WHERE rn <= least(n, greatest(1, round(1000 * n / total)))", "scene"),
    "c02_block_id": oracle("SELECT px_row, px_col, (px_row // 50) * 6 + px_col // 50 AS block FROM scene", "scene"),
    "c03_group_kfold": oracle("WITH RECURSIVE o AS (SELECT block, n, row_number() OVER (ORDER BY n DESC, block) AS rn FROM (SELECT (px_row // 50) * 6 + px_col // 50 AS block, count(*) AS n FROM scene GROUP BY 1)), r(rn, fold, load) AS (SELECT 0::BIGINT, -1::BIGINT, [0, 0, 0, 0, 0]::BIGINT[] UNION ALL SELECT o.rn, list_position(load, list_min(load))::BIGINT - 1, list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + o.n ELSE x END) FROM r JOIN o ON o.rn = r.rn + 1) SELECT block, n, fold FROM r JOIN o USING (rn)", "scene"),
    "c04_split": oracle("SELECT chip_row, chip_col, row_number() OVER (ORDER BY md5('42:' || chip_row || ':' || chip_col)) <= count(*) OVER () - ceil(0.2 * count(*) OVER ()) AS is_train FROM (SELECT DISTINCT px_row // 8 AS chip_row, px_col // 8 AS chip_col FROM scene)", "scene"),
    "c04_kfold": oracle("SELECT chip_row, chip_col, ntile(3) OVER (ORDER BY md5('42:' || chip_row || ':' || chip_col)) - 1 AS fold FROM (SELECT DISTINCT px_row // 32 AS chip_row, px_col // 32 AS chip_col FROM scene)", "scene"),
    "c05_balanced_weights": _mc("SELECT label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM px GROUP BY label"),
    "c09_classification_report": _mc(" UNION ALL ".join([_rep("k::VARCHAR", "pr", "re", "f1", "t"), _rep("'accuracy'", *["sum(tp) / sum(t)"] * 3, "sum(t)"), _rep("'macro avg'", "avg(pr)", "avg(re)", "avg(f1)", "sum(t)"), _rep("'weighted avg'", *[f"sum({x} * t) / sum(t)" for x in ("pr", "re", "f1")], "sum(t)")])),
    "c11_seg_class_weights": _mc("SELECT label, round(weight, 6) AS weight FROM wt"),
    "c12_masked_f1": _mc(f"SELECT label, round(f1, 6) AS f1, round(pred_pct, 6) AS pred_pct, round(true_pct, 6) AS true_pct FROM ({_F1} UNION ALL SELECT 0, avg(f1), sum(pred_pct), sum(true_pct) FROM ({_F1}))"),
    "c13_masked_accuracy": _mc("SELECT round(avg((label = pred)::INT), 6) AS accuracy FROM px WHERE label > 0"),
    "c14_masked_ce": _mc(f"SELECT round({_CE}, 6) AS ce"),
    "c15_tversky": _mc(f"SELECT chip_row, chip_col, k, round({_TI}, 6) AS ti FROM soft"),
    "c15_focal_tversky": _mc(f"SELECT round(avg(pow(greatest(0, 1 - {_TI}), 1.33)), 6) AS loss FROM soft"),
    "c16_dice": _mc(f"SELECT round({_DICE}, 6) AS dice"),
    "c16_dice_ce": _mc(f"SELECT round(0.5 * {_CE} + 0.5 * (1 - {_DICE}), 6) AS loss"),
}
ORACLES["p05_predict_blocks"] = ORACLES["p05_blend"]
