"""Sliding prediction, uncertainty and scores: window explosion, blending and aggregates over class probabilities.

Class probabilities are arrays; class k is the element k - 1 and 0 is the background. NULL is nodata.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import numbered_in_order

PIXEL = ("px_row", "px_col")


def starts(n: int, size: int, step: int) -> list[int]:
    """First positions of windows over n pixels; a last one ends at the edge."""
    if n <= size:
        return [0]
    return sorted({*range(0, n - size + 1, step), n - size})


def window_explode(px: DataFrame, height: int, width: int, size: int, step: int) -> DataFrame:
    """One row for each window that covers a pixel (row0, col0): at most (size / step + 1)^2, by arithmetic, without a join."""

    def over(c: str, n: int) -> Column:
        at, last = F.col(c), max(0, n - size)
        low = F.greatest(F.lit(0), F.floor((at - size + step) / step))
        high = F.least(F.floor(at / step), F.lit(last // step))
        regular = F.when(low <= high, F.transform(F.sequence(low, high), lambda i: i * step)).otherwise(F.array().cast("array<bigint>"))
        regular = F.filter(regular, lambda s: at < s + size)
        edge = F.when((at >= last) & (at < last + size) & F.lit(last % step != 0), F.array(F.lit(last).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
        return F.explode(F.concat(regular, edge).cast("array<int>"))

    return px.withColumn("row0", over("px_row", height)).withColumn("col0", over("px_col", width))


def prep_windows(px: DataFrame, bands) -> DataFrame:
    """Valid (every band has a value) and nodata as 0, for pixels of windows; windows without a valid pixel go."""
    px = px.withColumn("valid", F.array_position(F.array(*[F.col(b).isNull() for b in bands]), F.lit(True)) == 0)
    live = px.where("valid").select("row0", "col0").distinct()
    return px.join(live, ["row0", "col0"], "left_semi").withColumns({b: F.coalesce(b, F.lit(0.0)) for b in bands})


def softmax(scores: list[Column]) -> Column:
    """Probabilities of scores, as an array."""
    top = F.greatest(*scores)
    raised = [F.exp(s - top) for s in scores]
    return F.array(*[r / sum(raised[1:], raised[0]) for r in raised])


def predict(windows: DataFrame, model: Callable[[DataFrame], Column]) -> DataFrame:
    """Add p, the class probabilities that ``model`` makes as an expression of the window pixels' columns."""
    return windows.withColumn("p", model(windows))


def predict_windows(windows: DataFrame, model, schema: str) -> DataFrame:
    """A model on whole windows: pandas frame of one window -> pandas frame. A group is one window, of fixed size."""
    return windows.groupBy("row0", "col0").applyInPandas(model, schema)


def predict_blocks(px: DataFrame, bands: list[str], height: int, width: int, size: int, step: int, model: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], n_classes: int, block: int = 256) -> DataFrame:
    """P2 to P5 by blocks: each pixel's mean class probabilities over its windows, as blend() gives them, by one shuffle.

    A task takes one block of block x block pixels and the ``size - 1`` pixels around it, cuts all windows that cover
    its pixels, runs the model on those with a valid pixel and keeps the means of its own pixels. A pixel is sent to
    its block and those whose border it lies in: (1 + 2 (size - 1) / block)^2 copies, 1.5 with windows of 32, where
    one row for each window makes (size / step)^2. Windows over a border are predicted by each of its blocks.
    ``model`` takes windows [n, size, size, bands] and their first rows and columns, and gives [n, size, size, classes].
    Pixels in no window with a valid pixel are left out; those without all bands have weight 0.
    """
    rows, cols, reach = np.array(starts(height, size, step)), np.array(starts(width, size, step)), size - 1

    def near(at: str, n: int) -> Column:
        last = -(-n // block) - 1
        low, high = F.floor((F.col(at) - reach) / block), F.floor((F.col(at) + reach) / block)
        return F.explode(F.sequence(F.greatest(F.lit(0), low), F.least(F.lit(last), high)))

    def run(pdf):
        r0, c0 = (int(pdf[k].iloc[0]) * block - reach for k in ("_br", "_bc"))
        r, c = pdf["px_row"].to_numpy() - r0, pdf["px_col"].to_numpy() - c0
        side = block + 2 * reach + size  # windows at the raster's edge may end past it
        values, given = np.zeros((side, side, len(bands))), np.zeros((side, side), bool)
        given[r, c], values[r, c] = True, pdf[bands].to_numpy(np.float64)
        valid = given & ~np.isnan(values).any(axis=2)
        values = np.nan_to_num(values)
        top, left = (x[(x + size > o + reach) & (x < o + reach + block)] for x, o in ((rows, r0), (cols, c0)))
        at = np.array([(y, x) for y in top for x in left if valid[y - r0 : y - r0 + size, x - c0 : x - c0 + size].any()], np.int64).reshape(-1, 2)
        total, weight, seen = np.zeros((side, side, n_classes)), np.zeros((side, side)), np.zeros((side, side), bool)
        for some in np.array_split(at, -(-len(at) // 64)) if len(at) else []:
            cuts = [(slice(y - r0, y - r0 + size), slice(x - c0, x - c0 + size)) for y, x in some]
            for cut, p in zip(cuts, model(np.stack([values[cut] for cut in cuts]), some[:, 0], some[:, 1])):
                total[cut] += p * valid[cut][..., None]
                weight[cut] += valid[cut]
                seen[cut] = True
        own = (r >= reach) & (r < reach + block) & (c >= reach) & (c < reach + block) & seen[r, c]
        r, c = r[own], c[own]
        mean = np.divide(total[r, c], weight[r, c, None], out=np.zeros((len(r), n_classes)), where=weight[r, c, None] > 0)
        out = type(pdf)({"px_row": r + r0, "px_col": c + c0, "weight": weight[r, c]})
        out["p"] = np.fromiter(mean, object, len(mean))
        return out

    sent = px.select(*PIXEL, *[F.col(b).cast("double").alias(b) for b in bands]).withColumn("_br", near("px_row", height)).withColumn("_bc", near("px_col", width))
    return sent.groupBy("_br", "_bc").applyInPandas(run, "px_row long, px_col long, weight double, p array<double>")


def blend(pred: DataFrame, n_classes: int, keys=PIXEL) -> DataFrame:
    """P5: the mean over windows of each pixel's probabilities, where valid; 0 without any. Partial sums precede the shuffle."""
    w = F.col("valid").cast("double")
    total = pred.groupBy(*keys).agg(*[F.sum(F.col("p")[k] * w).alias(f"_p{k}") for k in range(n_classes)], F.sum(w).alias("weight"))
    return total.select(*keys, "weight", F.array(*[F.coalesce(F.try_divide(f"_p{k}", "weight"), F.lit(0.0)) for k in range(n_classes)]).alias("p"))


def class_map(p="p", valid: Column | None = None) -> Column:
    """The most probable class, the lower of equal ones; 0 where invalid."""
    p = F.col(p) if isinstance(p, str) else p
    top = F.array_position(p, F.array_max(p))
    return F.coalesce(top if valid is None else F.when(valid, top), F.lit(0)).cast("int")


def prob_rasters(px: DataFrame, keys=PIXEL) -> DataFrame:
    """One row for each pixel and class."""
    return px.select(*keys, F.posexplode("p").alias("_k", "v")).select(*keys, (F.col("_k") + 1).alias("k"), "v")


# --- uncertainty over Monte-Carlo passes: long rows (keys, pass, k, p) ----------------------------------------


def mc_summary(preds: DataFrame, keys=PIXEL) -> DataFrame:
    """Mean and standard deviation over the passes."""
    return preds.groupBy(*keys, "k").agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"))


def entropy(summary: DataFrame, keys=PIXEL, eps: float = 1e-10) -> DataFrame:
    """Entropy of the mean probabilities, clamped and made to sum to 1; NULL where a class has none."""
    held = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("mean")))
    # with s the sum of the held p: -sum(p/s * ln(p/s)) = ln(s) - sum(p * ln(p)) / s
    total = summary.withColumn("_p", held).groupBy(*keys).agg(F.sum("_p").alias("_s"), F.sum(F.col("_p") * F.ln("_p")).alias("_e"), F.bool_or(F.col("mean").isNull()).alias("_bad"))
    return total.select(*keys, F.when(~F.col("_bad"), F.ln("_s") - F.col("_e") / F.col("_s")).alias("entropy"))


def mc_diagnostics(preds: DataFrame, keys=PIXEL, least: float = 1e-8) -> DataFrame:
    """Mean variance over the passes, the largest difference of the first two, and whether they hardly differ."""
    first = lambda n: F.max(F.when(F.col("pass") == n, F.col("p")))
    cell = preds.groupBy(*keys, "k").agg(F.var_pop("p").alias("_v"), F.abs(first(0) - first(1)).alias("_d"))
    out = cell.agg(F.avg("_v").alias("mean_variance"), F.max("_d").alias("max_difference"))
    return out.withColumn("suspicious", F.col("max_difference") < least)


def uncertainty_report(px: DataFrame, chip: list[str]) -> DataFrame:
    """U4: for each chip and (chip NULL) in all: pixels, percentage valid, and mean, min and max entropy."""
    out = px.rollup(F.struct(*chip).alias("chip")).agg(F.count("*").alias("n"), F.count("entropy").alias("_v"), F.avg("entropy").alias("mean"), F.min("entropy").alias("min"), F.max("entropy").alias("max"))
    return out.select(*[F.col("chip")[c].alias(c) for c in chip], "n", (100.0 * F.col("_v") / F.col("n")).alias("pct_valid"), "mean", "min", "max", (F.col("_v") == F.col("n")).alias("all_valid"))


def histogram(px: DataFrame, v: str = "entropy", bins: int = 30, low: float = 0.0, high: float = math.log(3)) -> DataFrame:
    """U4: number of values in each of equal bins; the upper limit belongs to the last."""
    at = F.least(F.floor((F.col(v) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return px.where(F.col(v).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


# --- scores: rows (label, pred, p) ----------------------------------------------------------------------------


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support of each class, then accuracy and the macro and weighted means.

    One pass over the rows counts the confusion table; everything after it is as small as the classes.
    """
    cells = df.groupBy(label, pred).agg(F.count("*").alias("n"))
    both = cells.select(F.inline(F.array(F.struct(F.col(label).alias("c"), F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).cast("long").alias("f")), F.struct(F.col(pred).alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("t"), F.col("n").alias("f")))))
    per = both.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("t").alias("support"), F.sum("f").alias("found"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = per.withColumns({"precision": zero(F.col("tp").cast("double"), F.col("found")), "recall": zero(F.col("tp").cast("double"), F.col("support"))})
    per = per.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    scores = ["precision", "recall", "f1"]
    rows = per.select(F.col("c").cast("string").alias("name"), *scores, "support")
    right = F.sum("tp") / F.sum("support")
    accuracy = per.agg(F.lit("accuracy").alias("name"), *[right.alias(s) for s in scores], F.sum("support").alias("support"))
    macro = per.agg(F.lit("macro avg").alias("name"), *[F.avg(s).alias(s) for s in scores], F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("name"), *[(F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(s) for s in scores], F.sum("support").alias("support"))
    return rows.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def seg_class_weights(df: DataFrame, label: str = "label", classes=(1, 2, 3), factor: dict[int, float] | None = None) -> DataFrame:
    """C11: pixels / (3 * pixels of the class), times a factor for some classes, divided by their mean."""
    factor = {2: 1.8} if factor is None else factor
    counts = df.agg(*[F.count_if(F.col(label) == c).alias(f"n{c}") for c in classes])
    total = sum((F.col(f"n{c}") for c in classes[1:]), F.col(f"n{classes[0]}"))
    raw = [total / (len(classes) * F.greatest(F.col(f"n{c}"), F.lit(1))) * factor.get(c, 1.0) for c in classes]
    mean = sum(raw[1:], raw[0]) / len(classes)
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("label"), F.try_divide(w, mean).alias("weight")) for c, w in zip(classes, raw)])))


def masked_f1(df: DataFrame, label: str = "label", pred: str = "pred", classes=(1, 2, 3), eps: float = 1e-7) -> DataFrame:
    """F1, percentage found and percentage true of each class over labelled pixels, and (label 0) the mean F1."""
    y, z = F.col(label), F.col(pred)
    n = df.where(y > 0).agg(*[F.count_if(c).alias(f"{k}{i}") for i in classes for k, c in (("tp", (y == i) & (z == i)), ("found", z == i), ("true", y == i))])

    def row(i):
        tp, found, true = (F.col(f"{k}{i}").cast("double") for k in ("tp", "found", "true"))
        precision, recall = tp / (found + eps), tp / (true + eps)
        share = lambda k: 100.0 * F.col(f"{k}{i}") / F.greatest(sum((F.col(f"{k}{j}") for j in classes[1:]), F.col(f"{k}{classes[0]}")), F.lit(1))
        return F.struct(F.lit(i).alias("label"), (2 * precision * recall / (precision + recall + eps)).alias("f1"), share("found").alias("pred_pct"), share("true").alias("true_pct"))

    per = n.select(F.inline(F.array(*map(row, classes))))
    return per.unionByName(per.agg(F.lit(0).alias("label"), F.avg("f1").alias("f1"), F.sum("pred_pct").alias("pred_pct"), F.sum("true_pct").alias("true_pct")))


def masked_accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Share of labelled pixels whose class was found; NULL without any."""
    return df.where(F.col(label) > 0).agg(F.avg((F.col(label) == F.col(pred)).cast("int")).alias("accuracy"))


def masked_ce(df: DataFrame, weights: DataFrame, label: str = "label", eps: float = 1e-7) -> DataFrame:
    """C14: weighted mean of -ln(p of the true class) over labelled pixels; the weights are one small row a class."""
    px = df.where(F.col(label) > 0).join(F.broadcast(weights), label)
    p = F.element_at("p", F.col(label).cast("int"))
    loss = -F.ln(F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p)))
    return px.agg((F.sum(loss * F.col("weight")) / (F.sum("weight") + eps)).alias("ce"))


def _soft_counts(df: DataFrame, chip: list[str], label: str, n_classes: int) -> DataFrame:
    """Soft true positives, sum of p and number of pixels of each chip and class; all pixels count in the sum of p."""
    flat = [c for k in range(n_classes) for c in (F.sum(F.when(F.col(label) == k + 1, F.col("p")[k]).otherwise(0.0)).alias(f"tp{k}"), F.sum(F.col("p")[k]).alias(f"p{k}"), F.count_if(F.col(label) == k + 1).alias(f"t{k}"))]
    wide = df.groupBy(*chip).agg(*flat)
    return wide.select(*chip, F.inline(F.array(*[F.struct(F.lit(k + 1).alias("k"), F.col(f"tp{k}").alias("tp"), F.col(f"p{k}").alias("p"), F.col(f"t{k}").cast("double").alias("t")) for k in range(n_classes)])))


def tversky(df: DataFrame, chip: list[str], label: str = "label", n_classes: int = 3, alpha: float = 0.7, beta: float = 0.3, eps: float = 1e-7) -> DataFrame:
    """The Tversky index of each chip and class: alpha weighs false positives, beta false negatives."""
    s = _soft_counts(df, chip, label, n_classes)
    tp, fp, fn = F.col("tp"), F.col("p") - F.col("tp"), F.col("t") - F.col("tp")
    return s.select(*chip, "k", ((tp + eps) / (tp + alpha * fp + beta * fn + eps)).alias("ti"))


def focal_tversky(ti: DataFrame, gamma: float = 1.33) -> DataFrame:
    """Mean of (1 - index)^gamma."""
    return ti.agg(F.avg(F.pow(F.greatest(F.lit(0.0), 1 - F.col("ti")), F.lit(gamma))).alias("loss"))


def dice(df: DataFrame, chip: list[str], label: str = "label", n_classes: int = 3, eps: float = 1e-7) -> DataFrame:
    """The mean Dice coefficient over chips and classes."""
    s = _soft_counts(df, chip, label, n_classes)
    return s.agg(F.avg((2 * F.col("tp") + eps) / (F.col("t") + F.col("p") + eps)).alias("dice"))


def dice_ce(df: DataFrame, weights: DataFrame, chip: list[str], label: str = "label") -> DataFrame:
    """Half the cross-entropy and half of 1 - Dice."""
    both = masked_ce(df, weights, label).crossJoin(dice(df, chip, label))
    return both.select((0.5 * F.col("ce") + 0.5 * (1 - F.col("dice"))).alias("loss"))


# --- samples, folds and weights -------------------------------------------------------------------------------


def block_id(size: int, width: int, row="px_row", at="px_col") -> Column:
    """Number of the size x size block that holds a pixel, in reading order."""
    return (F.floor(F.col(row) / size) * math.ceil(width / size) + F.floor(F.col(at) / size)).cast("bigint")


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows / (classes * rows of the class)."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all"), F.count("*").alias("_k")))).select(label, (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))


def stratified(df: DataFrame, n: int, order: Column, label: str = "label") -> DataFrame:
    """About n rows, each class in proportion, by a repeatable order. The rank's bound by n lets tasks drop rows before the shuffle."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    quota = counts.crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all")))).select(label, F.least(F.col("_n"), F.greatest(F.lit(1), F.round(n * F.col("_n") / F.col("_all")))).cast("long").alias("_quota"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(label).orderBy(order))).where(F.col("_rank") <= n)
    return ranked.join(F.broadcast(quota), label).where("_rank <= _quota").drop("_rank", "_quota")


def kfold(chips: DataFrame, k: int, order: Column) -> DataFrame:
    """C4: a fold for each chip by a repeatable shuffle; folds differ by one chip at most, the first ones having one more."""
    ranked = numbered_in_order(chips, [order], "_rank", 0)
    q, more = divmod(ranked.count(), k)
    high = (q + 1) * more
    fold = F.when(F.col("_rank") < high, F.expr(f"_rank DIV {q + 1}")).otherwise(F.expr(f"{more} + (_rank - {high}) DIV {max(q, 1)}"))
    return ranked.withColumn("fold", fold.cast("int")).drop("_rank")


def split(chips: DataFrame, order: Column, test: float = 0.2) -> DataFrame:
    """C4: add is_train: false for the last ``test`` of the chips (rounded up) by a repeatable shuffle."""
    ranked = numbered_in_order(chips, [order], "_rank")
    n = ranked.count()
    return ranked.withColumn("is_train", F.col("_rank") <= n - math.ceil(test * n)).drop("_rank")


def group_kfold(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, n, fold): groups from the largest to the fold with the least rows so far (the lowest of equal ones).

    The choice depends on all groups before, so one task streams over the sorted group sizes (one row for a block
    of pixels) and keeps k sums.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).repartition(1).sortWithinPartitions(F.desc("n"), F.asc(group))

    def deal(it):
        loads = [(0, i) for i in range(k)]
        for batch in it:
            folds = []
            for n in batch.column("n").to_pylist():
                load, fold = loads[0]
                heapq.heapreplace(loads, (load + n, fold))
                folds.append(fold)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(folds, pa.int32())], names=[group, "n", "fold"])

    return sizes.mapInArrow(deal, sizes.withColumn("fold", F.lit(0)).schema)
