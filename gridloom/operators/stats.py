"""Band statistics, normalisation and sampling over wide pixel tables.

Statistics are one row a band: small whatever the input, so they are joined back by broadcast. NULL is nodata
and counts nowhere; a band without values has NULL statistics and is normalised by (0, 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unpivot(px: DataFrame, bands, keys=()) -> DataFrame:
    """(keys, band, v) of every band value that isn't NULL."""
    return px.unpivot([F.col(k) for k in keys], [F.col(b) for b in bands], "band", "v").where("v IS NOT NULL")


#: Half the width, in ranks, of the bracket around an exact percentile, and the rows from which brackets are used.
_NEAR = 0.001
_MANY = 4000


def percentiles(v: DataFrame, keys: list[str], value: str, at: list[float], exact: bool = True, seen: DataFrame | None = None) -> DataFrame:
    """(keys, _p): percentiles of a column without NULLs, by linear interpolation between ranks, for each group.

    Exact ones take two passes: sketches bracket each percentile; then one aggregation counts the values below each
    bracket as one and those within it, some 0.2 % of the rows, by value. No group's values are held in one task's memory.
    ``seen`` (see brackets()) spares the first pass; a percentile that its bracket misses is then NULL.
    """
    if not exact:
        return v.groupBy(*keys).agg(F.percentile_approx(value, at, 100_000).alias("_p"))
    probes = [min(1.0, max(0.0, p + d)) for p in at for d in (-_NEAR, _NEAR)]
    if seen is None:
        seen = v.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"), F.percentile_approx(value, probes, 10_000).alias("_b"))
    few = F.col("_n") < _MANY
    limits = [F.struct(F.when(few, F.col("_min")).otherwise(F.col("_b")[2 * i]).alias("lo"), F.when(few, F.col("_max")).otherwise(F.col("_b")[2 * i + 1]).alias("hi"), F.lit(p).alias("at"), F.lit(i).alias("i")) for i, p in enumerate(at)]
    seen = seen.select(*keys, "_n", F.array(*limits).alias("_lim"))
    rows = v.select(*keys, F.col(value).alias("_v"))
    rows = rows.join(seen, keys) if keys else rows.crossJoin(F.broadcast(seen))
    # a value below a bracket counts as NULL there, which sorts first; those above it are left out
    upper = F.filter("_lim", lambda x: F.col("_v") <= x["hi"])
    kept = rows.select(*keys, "_n", F.inline(F.transform(upper, lambda x: F.struct(x["at"].alias("at"), x["i"].alias("i"), F.when(F.col("_v") >= x["lo"], F.col("_v")).alias("_v")))))
    counts = kept.groupBy(*keys, "i", "at", "_n", "_v").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*keys, "i").orderBy(F.asc_nulls_first("_v")))
    place = F.col("at") * (F.col("_n") - 1)
    holds = lambda rank: F.max(F.when((F.col("_upto") - F.col("_m") <= rank) & (rank < F.col("_upto")), F.col("_v")))
    found = counts.withColumn("_upto", upto).groupBy(*keys, "i", place.alias("_at")).agg(holds(F.floor(place)).alias("_lo"), holds(F.ceil(place)).alias("_hi"))
    mid = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((F.ceil("_at") - F.col("_at")) * F.col("_lo") + (F.col("_at") - F.floor("_at")) * F.col("_hi"))
    out = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", mid.cast("double").alias("p")))).alias("_p"))
    return out.select(*keys, F.col("_p.p").alias("_p"))


#: Size of a tile's quantile sketch; its rank error; and how many times that a bracket is wide on either side.
SKETCH = 2000
SKETCH_ERROR = 2.446 / SKETCH**0.9433
_WIDE = 3


def tile_sketches(px: DataFrame, bands, by: str = "tile_id") -> DataFrame:
    """(tile, band, n, min, max, mean, var, sketch): what a tile adds to the statistics of all. Rows of tiles can be kept and merged."""
    v = unpivot(px, bands, [by])
    return v.groupBy(by, "band").agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.kll_sketch_agg_double("v", SKETCH).alias("sketch"))


def brackets(sketches: DataFrame, at: list[float]) -> DataFrame:
    """(band, _n, _min, _max, _b) for percentiles(), from the tiles' sketches."""
    merged = sketches.groupBy("band").agg(F.sum("n").alias("_n"), F.min("min").alias("_min"), F.max("max").alias("_max"), F.kll_merge_agg_double("sketch").alias("_s"))
    probes = [p + d * _WIDE * SKETCH_ERROR for p in at for d in (-1, 1)]
    bounds = [F.col("_min") if p <= 0 else F.col("_max") if p >= 1 else F.kll_sketch_get_quantile_double("_s", F.lit(p)) for p in probes]
    return merged.select("band", "_n", "_min", "_max", F.array(*bounds).alias("_b"))


def stats_from_sketches(sketches: DataFrame, px: DataFrame | None = None, bands=None) -> DataFrame:
    """band_stats() from stored tile sketches: percentiles within the sketches' rank error, or, with ``px``, exact.

    Exact ones read ``px`` once, for the values within the sketches' brackets; if a bracket misses (its chance is
    small), they are worked out anew.
    """
    at = [0.02, 0.5, 0.98]
    total = sketches.groupBy("band").agg(F.sum("n").alias("_all"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    parts = sketches.join(F.broadcast(total), "band")
    spread = F.sqrt(F.sum(F.col("n") * (F.col("var") + F.pow(F.col("mean") - F.col("_mean"), 2))) / F.first("_all"))
    agg = parts.groupBy("band").agg(F.first("_all").alias("n_samples"), F.min("min").alias("min"), F.max("max").alias("max"), F.first("_mean").alias("mean"), spread.alias("std"), F.kll_merge_agg_double("sketch").alias("_s"))
    if px is None:
        agg = agg.withColumn("_p", F.array(*[F.kll_sketch_get_quantile_double("_s", F.lit(p)) for p in at]))
    else:
        v = unpivot(px, bands)
        found = percentiles(v, ["band"], "v", at, seen=brackets(sketches, at))
        rows = found.collect()  # one row a band
        if any(p is None for r in rows for p in r["_p"]):
            found = percentiles(v, ["band"], "v", at)
        else:
            found = px.sparkSession.createDataFrame(rows, found.schema)
        agg = agg.join(found, "band")
    iqr = F.col("_p")[2] - F.col("_p")[0]
    return agg.select("band", F.col("_p")[1].alias("median"), F.when(iqr > 0, iqr).otherwise(1.0).alias("iqr"), "n_samples", "min", "max", "mean", "std")


def band_stats(px: DataFrame, bands, exact: bool = True) -> DataFrame:
    """N, median, iqr (98th less 2nd percentile; 1 if not positive), min, max, mean and std of each band."""
    v = unpivot(px, bands)
    agg = v.groupBy("band").agg(F.count("v").alias("n_samples"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    agg = agg.join(percentiles(v, ["band"], "v", [0.02, 0.5, 0.98], exact), "band")
    iqr = F.col("_p")[2] - F.col("_p")[0]
    return agg.select("band", F.col("_p")[1].alias("median"), F.when(iqr > 0, iqr).otherwise(1.0).alias("iqr"), "n_samples", "min", "max", "mean", "std")


def read_stats(stats: DataFrame, least: float = 1e-6) -> DataFrame:
    """Band, median and iqr as a reader takes them, the iqr at least ``least``."""
    return stats.select("band", "median", F.greatest("iqr", F.lit(least)).alias("iqr"))


def zscore_stats(px: DataFrame, bands, per_band: bool = True, least: float = 1e-6) -> DataFrame:
    """Mean and std of each band, or of the first for all; a std under ``least`` is 1, a band without values (0, 1)."""
    used = list(bands) if per_band else list(bands)[:1]
    row = px.agg(*[c for b in used for c in (F.avg(b).alias(f"m_{b}"), F.stddev_pop(b).alias(f"s_{b}"))])
    of = lambda b: b if per_band else used[0]
    std = lambda b: F.coalesce(F.when(F.col(f"s_{of(b)}") >= least, F.col(f"s_{of(b)}")), F.lit(1.0))
    return row.select(F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.coalesce(F.col(f"m_{of(b)}"), F.lit(0.0)).alias("mean"), std(b).alias("std")) for b in bands])))


def zscore_sampled(px: DataFrame, bands, windows: DataFrame, size: int, most: int, seed: int, by: str = "tile_id", least: float = 1e-6) -> DataFrame:
    """zscore_stats of the pixels in sampled windows (by, row0, col0), at most ``most`` values a band; unique pixels by place."""
    cut = px.join(_window_blocks(windows, size, by), [F.col(f"_w{by}") == F.col(by), F.floor(F.col("px_row") / size) == F.col("_br"), F.floor(F.col("px_col") / size) == F.col("_bc"), F.expr(f"px_row BETWEEN row0 AND row0 + {size - 1} AND px_col BETWEEN col0 AND col0 + {size - 1}")], "left_semi")
    v = sample_n(unpivot(cut, bands, ["px_row", "px_col"]), most, seed, ["band"], ["px_row", "px_col"])
    found = v.groupBy("band").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    every = px.sparkSession.createDataFrame([(b,) for b in bands], "band string")
    return every.join(found, "band", "left").select("band", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce(F.when(F.col("std") >= least, F.col("std")), F.lit(1.0)).alias("std"))


def _window_blocks(windows: DataFrame, size: int, by: str) -> DataFrame:
    """The windows by the blocks of their size that they touch, four at most."""
    span = lambda c: F.explode(F.sequence(F.floor(F.col(c) / size), F.floor((F.col(c) + size - 1) / size)))
    return windows.select(F.col(by).alias(f"_w{by}"), "row0", "col0").withColumn("_br", span("row0")).withColumn("_bc", span("col0"))


def write_stats(stats: DataFrame, path: str) -> None:
    """A statistics table as CSV with a header."""
    stats.write.option("header", True).csv(path)


def normalise(px: DataFrame, stats: DataFrame, bands, centre: str, scale: str, only=None) -> DataFrame:
    """(v - centre) / scale of each band (or those of ``only``); bands that the statistics lack keep their values.

    The statistics become one row of a map, so the pixels are neither unpivoted nor shuffled.
    """
    named = stats.select(F.struct("band", F.struct(F.col(centre).alias("m"), F.col(scale).alias("s"))).alias("_e"))
    row = named.agg(F.map_from_entries(F.collect_list("_e")).alias("_stats"))
    wide = px.crossJoin(F.broadcast(row))
    of = lambda b, part, default: F.coalesce(F.try_element_at("_stats", F.lit(b))[part], F.lit(default))
    chosen = [b for b in bands if only is None or b in only]
    return wide.withColumns({b: F.try_divide(F.col(b) - of(b, "m", 0.0), of(b, "s", 1.0)) for b in chosen}).drop("_stats")


def standardize(px: DataFrame, bands) -> DataFrame:
    """(v - mean) / (std + 1e-8) by the table's own statistics, NULL becoming 0."""
    stats = unpivot(px, bands).groupBy("band").agg(F.avg("v").alias("mean"), (F.stddev_pop("v") + 1e-8).alias("std"))
    return fill_null(normalise(px, stats, bands, "mean", "std"), bands)


def clip_robust(px: DataFrame, bands, low: float = 0.001, high: float = 0.999, exact: bool = True) -> DataFrame:
    """All bands clipped to percentiles of the values of all bands of wholly valid pixels."""
    valid = px.where(" AND ".join(f"{b} IS NOT NULL" for b in bands))
    limits = percentiles(unpivot(valid, bands), [], "v", [low, high], exact)
    wide = px.crossJoin(F.broadcast(limits))
    clipped = lambda b: F.when(F.col(b).isNotNull(), F.least(F.greatest(F.col(b), F.col("_p")[0]), F.col("_p")[1]))
    return wide.withColumns({b: clipped(b) for b in bands}).drop("_p")


def fill_null(px: DataFrame, bands, value: float = 0.0) -> DataFrame:
    """A value for NULL."""
    return px.withColumns({b: F.coalesce(b, F.lit(value)) for b in bands})


def null_report(px: DataFrame, bands) -> DataFrame:
    """Number and percentage of NULLs of each band."""
    row = px.agg(F.count("*").alias("_n"), *[F.count_if(F.col(b).isNull()).alias(b) for b in bands])
    return row.select("_n", F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("n_null")) for b in bands]))).select("band", "n_null", F.coalesce(F.try_divide(100.0 * F.col("n_null"), F.col("_n")), F.lit(0.0)).alias("pct_null"))


def assess(px: DataFrame, stats: DataFrame, bands, least: int = 10, exact: bool = True) -> DataFrame:
    """Raw and robustly normalised statistics of each band; bands with few values or no spread are left out."""
    v = unpivot(px, bands).join(F.broadcast(stats.where("iqr > 0").select("band", "median", "iqr")), "band")
    v = v.withColumn("z", (F.col("v") - F.col("median")) / F.col("iqr"))
    out = [F.count("v").alias("n_samples")]
    for c, name in (("v", "raw"), ("z", "norm")):
        out += [F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
    out += [F.count_if(F.col("z") > 5).alias("outliers_pos"), F.count_if(F.col("z") < -5).alias("outliers_neg")]
    found = v.groupBy("band").agg(*out).where(F.col("n_samples") > least).join(percentiles(v, ["band"], "z", [0.05, 0.95], exact), "band")
    return found.withColumns({"norm_q05": F.col("_p")[0], "norm_q95": F.col("_p")[1]}).drop("_p")


def verdict(qc: DataFrame) -> DataFrame:
    """What is wrong with each band's normalisation; healthy if centre, spread and outliers are fine."""
    out = qc.select("band", (F.abs("norm_mean") > 0.5).alias("off_centre"), (~F.col("norm_std").between(0.7, 1.5)).alias("bad_spread"), (F.col("outliers_pos") + F.col("outliers_neg") > 10).alias("many_outliers"), (F.col("norm_q95") - F.col("norm_q05") < 3).alias("narrow"))
    return out.withColumn("healthy", ~(F.col("off_centre") | F.col("bad_spread") | F.col("many_outliers")))


def compare_norm(px: DataFrame, first: DataFrame, second: DataFrame, bands, limit: float = 5.0) -> DataFrame:
    """Both normalisations' mean, std and outliers for each band and (band NULL) for all, and the percentage of outliers removed."""
    one = first.select("band", F.col("median").alias("m1"), F.col("iqr").alias("s1"))
    two = second.select("band", F.col("median").alias("m2"), F.col("iqr").alias("s2"))
    v = unpivot(px, bands).join(F.broadcast(one.join(two, "band")), "band")
    v = v.withColumns({"z1": (F.col("v") - F.col("m1")) / F.col("s1"), "z2": (F.col("v") - F.col("m2")) / F.col("s2")})
    out = v.rollup("band").agg(*[f(z).alias(n + z[1]) for z in ("z1", "z2") for f, n in ((F.avg, "mean_"), (F.stddev_pop, "std_"))], *[F.count_if(F.abs(z) > limit).alias(f"outliers_{z[1]}") for z in ("z1", "z2")])
    return out.withColumn("reduction_pct", 100.0 * (F.col("outliers_1") - F.col("outliers_2")) / F.greatest("outliers_1", F.lit(1)))


def box_stats(px: DataFrame, bands, exact: bool = True) -> DataFrame:
    """Quartiles, the furthest values within 1.5 quartile ranges of them, and the number of values beyond."""
    v = unpivot(px, bands)
    q = percentiles(v, ["band"], "v", [0.25, 0.5, 0.75], exact).withColumnRenamed("_p", "q")
    step = 1.5 * (F.col("q")[2] - F.col("q")[0])
    v = v.join(F.broadcast(q), "band").withColumn("_in", F.col("v").between(F.col("q")[0] - step, F.col("q")[2] + step))
    out = v.groupBy("band").agg(F.any_value("q").alias("q"), F.min(F.when(F.col("_in"), F.col("v"))).alias("low"), F.max(F.when(F.col("_in"), F.col("v"))).alias("high"), F.count_if(~F.col("_in")).alias("n_fliers"))
    return out.select("band", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "low", "high", "n_fliers")


def seeded(seed: int, *keys) -> Column:
    """A repeatable pseudo-random order of rows by their keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def sample_n(rows: DataFrame, n: int, seed: int, by: list[str], keys: list[str]) -> DataFrame:
    """N rows of each group without replacement, by seeded order of their keys.

    The bound on the rank lets each task drop all but its first n rows of a group before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(seeded(seed, *keys), *keys))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def sample_windows(px: DataFrame, per_tile: int, tries: int, size: int, extent: int, seed: int, least: float = 0.02, by: str = "tile_id", valid: str = "b1") -> DataFrame:
    """Of each tile's pseudo-random windows (``tries`` of them) the first ``per_tile`` with enough valid pixels.

    Window corners come from a hash and are clamped to the grid. Pixels meet windows through blocks of the
    windows' size, four at most for each window.
    """
    tiles = px.select(by).distinct()
    draw = lambda name: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}{name}"), F.col(by).cast("string"), F.col("win").cast("string"))), 1, 7), 16, 10).cast("bigint") % (extent - size + 1)
    wins = tiles.withColumn("win", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumns({"row0": draw("r"), "col0": draw("c")})
    span = lambda c: F.explode(F.sequence(F.floor(F.col(c) / size), F.floor((F.col(c) + size - 1) / size)))
    blocks = wins.withColumn("_br", span("row0")).withColumn("_bc", span("col0"))
    at = px.where(F.col(valid).isNotNull()).select(by, "px_row", "px_col").distinct().withColumns({"_br": F.floor(F.col("px_row") / size), "_bc": F.floor(F.col("px_col") / size)})
    hit = at.join(blocks, [by, "_br", "_bc"]).where(f"px_row BETWEEN row0 AND row0 + {size - 1} AND px_col BETWEEN col0 AND col0 + {size - 1}")
    good = hit.groupBy(by, "win", "row0", "col0").agg(F.count("*").alias("n_valid")).where(F.col("n_valid") >= least * size * size)
    return good.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy("win"))).where(F.col("_rank") <= per_tile).drop("_rank")


def window_stats(px: DataFrame, v: str, most: int = 20) -> DataFrame:
    """Min, max, mean, std, zeros, share of other values, and the least ``most`` distinct values."""
    one = px.agg(F.count("*").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count_if(F.col(v) == 0).alias("n_zero"), F.coalesce(F.try_divide(100.0 * F.count_if(F.col(v) != 0), F.count("*")), F.lit(0.0)).alias("pct_nonzero"), F.count_distinct(F.col(v)).alias("n_unique"))
    few = px.select(v).where(F.col(v).isNotNull()).distinct().orderBy(v).limit(most).agg(F.array_join(F.sort_array(F.collect_list(F.col(v).cast("bigint"))), ",").alias("least_values"))
    return one.crossJoin(few)
