"""Training chips, labels, channel maps and regression matrices.

Chips are windows of size x size pixels in reading order; the long form (one row a pixel) is keyed by
chip_row and chip_col, so every chip decision is one aggregation. NULL is nodata; label 0 is the background.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Grid, chip_bounds
from .mask import index
from .order import numbered_in_order
from .stats import normalise, seeded

#: Codes of the label classes.
CLASSES = {"low": 1, "medium": 2, "high": 3}
CHIP = ("chip_row", "chip_col")


def map_labels(polys: DataFrame, cls: str = "cls") -> DataFrame:
    """L1: add code; polygons of another class or none are dropped."""
    code = reduce(lambda c, kv: c.when(F.lower(F.trim(F.col(cls))) == kv[0], kv[1]), list(CLASSES.items())[1:], F.when(F.lower(F.trim(F.col(cls))) == "low", 1))
    return polys.withColumn("code", code).where("code IS NOT NULL")


def clean_labels(label="label", top: int = 3) -> Column:
    """0 for NULL and for labels outside 0 to top."""
    return F.when(F.col(label).between(0, top), F.col(label)).otherwise(0)


def chip_grid(px: DataFrame, size: int, height: int, width: int) -> DataFrame:
    """L2: each pixel's chip; pixels of partial chips at the edges are dropped."""
    full = (F.col("px_row") < height // size * size) & (F.col("px_col") < width // size * size)
    return px.where(full).withColumns({"chip_row": F.floor(F.col("px_row") / size).cast("bigint"), "chip_col": F.floor(F.col("px_col") / size).cast("bigint")})


def stack_rasters(rasters: list[DataFrame], keys=("px_row", "px_col")) -> DataFrame:
    """Pixels that all rasters have, side by side: equi-joins on one key, so each input is shuffled once at most."""
    return reduce(lambda a, b: a.join(b, list(keys)), rasters)


def propagate_null(px: DataFrame, bands, label: str = "label") -> DataFrame:
    """A pixel without a value in some band loses the others and its label."""
    whole = reduce(lambda a, b: a & b, [F.col(b).isNotNull() for b in bands])
    return px.withColumn("_whole", whole).withColumns({b: F.when(F.col("_whole"), F.col(b)) for b in bands} | {label: F.when(F.col("_whole"), F.col(label)).otherwise(0)}).drop("_whole")


def chip_counts(px: DataFrame, bands, land: str = "land", label: str = "label") -> DataFrame:
    """Counts of each chip: pixels, labelled (before and, by class, after invalid pixels are blanked), land and valid ones."""
    whole = reduce(lambda a, b: a & b, [F.col(b).isNotNull() for b in bands])
    out = [F.count("*").alias("n_pixels"), F.count_if(F.col(label) > 0).alias("n_labelled"), F.count_if(F.col(land)).alias("n_land"), F.count_if(whole).alias("n_valid_pixels")]
    return px.groupBy(*CHIP).agg(*out, *[F.count_if(whole & (F.col(label) == c)).alias(f"n_label_{n}") for n, c in CLASSES.items()])


def chip_cells(px: DataFrame, size: int) -> DataFrame:
    """Each pixel's chip, partial chips at the edges included, for the ledger."""
    return px.withColumns({"chip_row": F.floor(F.col("px_row") / size).cast("bigint"), "chip_col": F.floor(F.col("px_col") / size).cast("bigint")})


def chip_reason(size: int, ratio: float = 0.15, land: int = 50) -> Column:
    """Created, or the first rule that a chip fails; edge for a chip with fewer pixels than size x size."""
    share = F.col("n_labelled") / (size * size)
    return F.when(F.col("n_pixels") < size * size, "edge").when(F.col("n_labelled") == 0, "no_label").when(share < ratio, "ratio").when(F.col("n_land") < land, "land").when(F.col("n_valid_pixels") == 0, "invalid").otherwise("created")


def chip_metadata(counts: DataFrame, size: int, grid: Grid, ratio: float = 0.15, land: int = 50) -> DataFrame:
    """The kept chips with sequential names in reading order, their place, box and centre in the grid, and their counts.

    Names need one order over all chips: range partitions of them are sorted, and numbered from their counts' prefix sums.
    """
    kept = numbered_in_order(counts.where(chip_reason(size, ratio, land) == "created"), [F.asc(c) for c in CHIP], "_number", 0)
    kept = chip_bounds(kept, grid, size)
    return kept.select(F.format_string("tile_%06d", "_number").alias("tile_id"), "xmin", "ymin", "xmax", "ymax", "center_x", "center_y", (F.col("chip_col") * size).alias("pixel_col"), (F.col("chip_row") * size).alias("pixel_row"), "n_valid_pixels", (F.col("n_labelled") / (size * size)).alias("label_ratio"), *[f"n_label_{n}" for n in CLASSES])


def class_pixel_counts(px: DataFrame, label: str = "label") -> DataFrame:
    """Pixels of each class and (label NULL) of all."""
    return px.where(F.col(label) > 0).rollup(label).agg(F.count("*").alias("n"))


def channel_map(catalog: DataFrame, keep=()) -> DataFrame:
    """One row for each band of each predictor, numbered from 0 by (ord, band); the catalog has ord, name, n_bands and ``keep`` (file, group, normalised)."""
    one = catalog.select("ord", "name", *keep, F.explode(F.sequence(F.lit(1), F.col("n_bands").cast("int"))).alias("band"))
    one = numbered_in_order(one, [F.asc("ord"), F.asc("band")], "_number", 0)
    return one.select(F.col("_number").cast("int").alias("channel_idx"), F.col("name").alias("predictor"), "band", *keep)


def resolve_channels(channels: DataFrame, wanted: DataFrame) -> DataFrame:
    """The channels of each wanted name (case and outer blanks don't count); an empty list where there is none."""
    found = channels.groupBy(F.lower(F.trim("predictor")).alias("_k")).agg(F.sort_array(F.collect_list("channel_idx")).alias("_c"))
    joined = wanted.withColumn("_k", F.lower(F.trim("name"))).join(found, "_k", "left")
    return joined.select("name", F.coalesce("_c", F.array().cast("array<int>")).alias("channels"))


def require_channels(resolved: DataFrame, single: bool = False, told: int = 20) -> DataFrame:
    """The resolved names, or ValueError with the first ``told`` that have no channel (or, if ``single``, not just one)."""
    n = F.size("channels")
    bad = [r["name"] for r in resolved.where((n != 1) if single else (n == 0)).select("name").orderBy("name").limit(told).collect()]
    if bad:
        raise ValueError(f"predictors without {'just one' if single else 'a'} channel: {', '.join(map(str, bad))}")
    return resolved


def drop_channels(bands="bands", drop=()) -> Column:
    """An array of bands without those at the given places."""
    bands = F.col(bands) if isinstance(bands, str) else bands
    return F.filter(bands, lambda x, i: ~i.isin(*drop)) if drop else bands


def categorical(v, top: int) -> Column:
    """Rounded half to even; 0 for NULL and outside 0 to top."""
    r = F.rint(F.coalesce(F.col(v), F.lit(0.0)))
    return F.when(r.between(0, top), r).otherwise(0.0).cast("int")


def audit(px: DataFrame, bands, limit: float = 1.0) -> DataFrame:
    """For each channel values, NULLs, min, max, percentage beyond the limit, and whether that is under 1 %."""
    row = px.agg(*[c for b in bands for c in (F.count(b).alias(f"n_{b}"), F.count_if(F.col(b).isNull()).alias(f"z_{b}"), F.min(b).alias(f"l_{b}"), F.max(b).alias(f"h_{b}"), F.count_if(F.abs(b) > limit).alias(f"o_{b}"))])
    per = row.select(F.inline(F.array(*[F.struct(F.lit(b).alias("channel"), F.col(f"n_{b}").alias("n"), F.col(f"z_{b}").alias("n_null"), F.col(f"l_{b}").alias("min"), F.col(f"h_{b}").alias("max"), F.coalesce(F.try_divide(100.0 * F.col(f"o_{b}"), F.col(f"n_{b}")), F.lit(0.0)).alias("pct_out")) for b in bands])))
    return per.withColumn("passed", F.col("pct_out") < 1)


def audit_chips(chips: DataFrame, names: list[str], keys: list[str], share: float = 0.25, seed: int = 42, limit: float = 1.0) -> DataFrame:
    """The audit of ``share`` of the chips, by a seeded order of their keys, and n_wrong, chips with another number of channels.

    ``bands`` of a chip is an array of channels, each an array of values; a channel past the names isn't audited.
    """
    picked = chips.where(F.conv(F.substring(seeded(seed, *keys), 1, 8), 16, 10).cast("bigint") < int(share * 2**32))
    wrong = picked.agg(F.count_if(F.size("bands") != len(names)).alias("n_wrong"), F.count("*").alias("n_chips"))
    v = picked.select(F.posexplode("bands").alias("c", "vs")).select("c", F.explode("vs").alias("v"))
    per = v.groupBy("c").agg(F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("n_null"), F.min("v").alias("min"), F.max("v").alias("max"), F.count_if(F.abs("v") > limit).alias("_out"))
    per = per.where(F.col("c") < len(names)).withColumn("pct_out", F.coalesce(F.try_divide(100.0 * F.col("_out"), F.col("n")), F.lit(0.0)))
    name = F.get(F.array(*map(F.lit, names)), F.col("c"))
    return per.crossJoin(F.broadcast(wrong)).select(name.alias("channel"), "n", "n_null", "min", "max", "pct_out", (F.col("pct_out") < 1).alias("passed"), "n_chips", "n_wrong")


def regression_matrix(labels: DataFrame, rasters: list[DataFrame], variables: list[str], nodata: dict[str, float] | None = None) -> DataFrame:
    """Labelled pixels with all predictors. Labels are filtered first, so the joins carry labelled pixels only."""
    px = stack_rasters([labels.where("label > 0"), *rasters])
    good = reduce(lambda a, b: a & b, [F.col(v).isNotNull() & ~F.isnan(v) for v in variables])
    for v, n in (nodata or {}).items():
        good = good & (F.col(v) != n)
    return px.where(good).select("px_row", "px_col", "label", *variables)


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows of each class."""
    return df.groupBy(label).agg(F.count("*").alias("n"))


def valid_mask(bands="bands") -> Column:
    """C17: whether a pixel has a value in all channels of its array; NULL where there is no array."""
    return F.forall(bands, lambda x: x.isNotNull())


def build_channels(px: DataFrame, zscore: DataFrame, terrain: list[str], robust: DataFrame | None = None, bands: list[str] = (), raw: list[str] = (), indices: dict | None = None, label: str = "label") -> DataFrame:
    """Add ``bands``: z-scored terrain, robustly normalised bands, raw channels and indices, in this order.

    Indices are of the raw bands. A pixel that lacks a channel loses the others and its label. The satellite
    policy gives ``robust``, ``bands`` and ``indices``; the embedding policy gives ``raw`` and no ``robust``.
    """
    made = px.withColumns({n: index(a, b) for n, (a, b) in (indices or {}).items()})
    made = normalise(made, zscore, terrain, "mean", "std")
    if robust is not None:
        made = normalise(made, robust, list(bands), "median", "iqr")
    names = [*terrain, *bands, *raw, *(indices or {})]
    return propagate_null(made, names, label).withColumn("bands", F.array(*names))


def build_chips(px: DataFrame, kept: DataFrame, label: str = "label") -> DataFrame:
    """One row for each kept chip: its labels and channel arrays in reading order. One shuffle, by chip."""
    pixel = F.struct("px_row", "px_col", F.col(label).alias("label"), "bands")
    chips = px.join(kept.select(*CHIP), list(CHIP), "left_semi").groupBy(*CHIP).agg(F.sort_array(F.collect_list(pixel)).alias("_px"))
    return chips.select(*CHIP, F.col("_px.label").alias("labels"), F.col("_px.bands").alias("bands"))


def transpose(grid) -> Column:
    """An array of equally long arrays with both levels exchanged, so channels first becomes channels last and back."""
    a = F.col(grid) if isinstance(grid, str) else grid
    first = F.coalesce(F.size(F.get(a, F.lit(0))), F.lit(0))
    return F.when(first > 0, F.transform(F.sequence(F.lit(0), first - 1), lambda i: F.transform(a, lambda row: F.get(row, i)))).when(a.isNotNull(), F.filter(a, lambda x: F.lit(False)))


def pick_chip(chips: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """One chip, the first by a seeded order of the keys; each task keeps one row."""
    return chips.orderBy(seeded(seed, *keys), *keys).limit(1)


def feature_names(catalog: DataFrame) -> DataFrame:
    """R2: (ord, name, band, feature): the stem for a raster of one band, else stem_bNN."""
    one = catalog.select("ord", "name", "n_bands", F.explode(F.sequence(F.lit(1), F.col("n_bands").cast("int"))).alias("band"))
    return one.select("ord", "name", "band", F.when(F.col("n_bands") == 1, F.col("name")).otherwise(F.format_string("%s_b%02d", "name", "band")).alias("feature"))


def cap(df: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """N rows at most, the first by a seeded order of the keys."""
    return df.orderBy(seeded(seed, *keys), *keys).limit(n)
