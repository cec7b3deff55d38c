"""Grids, windows, resampling and polygons: arithmetic on pixel keys, and equi-joins on pixels or blocks.

A north-up grid has square or oblong cells (a wide, e high, e < 0) and its upper left corner at (c, f).
Polygons are rows of (poly_id, ord, rings, ...): rings hold (x, y) structs, the last point joining the first.
Results for null or empty input: a null coordinate gives a null cell; a polygon without rings covers nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


@dataclass(frozen=True)
class Grid:
    """A grid definition; the same six numbers as an affine transform without rotation."""

    c: float = 500000.0
    f: float = 7000000.0
    a: float = 10.0
    e: float = -10.0
    width: int = 256
    height: int = 256
    crs: str = "EPSG:25833"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def xy(g: Grid, row="px_row", at="px_col") -> dict[str, Column]:
    """G1: the centre of a pixel in world coordinates."""
    return {"x": g.c + (col(at) + 0.5) * g.a, "y": g.f + (col(row) + 0.5) * g.e}


def rowcol(g: Grid, x="x", y="y") -> dict[str, Column]:
    """G1: the pixel that holds a point."""
    return {"px_row": F.floor((col(y) - g.f) / g.e).cast("bigint"), "px_col": F.floor((col(x) - g.c) / g.a).cast("bigint")}


def bounds(px: DataFrame, g: Grid, by: str = "tile_id") -> DataFrame:
    """The world box of each tile."""
    edges = px.groupBy(by).agg(F.min("px_row").alias("r0"), F.max("px_row").alias("r1"), F.min("px_col").alias("c0"), F.max("px_col").alias("c1"))
    return edges.select(by, (g.c + F.col("c0") * g.a).alias("xmin"), (g.f + (F.col("r1") + 1) * g.e).alias("ymin"), (g.c + (F.col("c1") + 1) * g.a).alias("xmax"), (g.f + F.col("r0") * g.e).alias("ymax"))


def extent(boxes: DataFrame) -> DataFrame:
    """The box around all boxes."""
    return boxes.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def chip_bounds(chips: DataFrame, g: Grid, size: int) -> DataFrame:
    """The box and centre of each chip, from chip_row and chip_col."""
    x0, y1 = g.c + F.col("chip_col") * size * g.a, g.f + F.col("chip_row") * size * g.e
    x1, y0 = x0 + size * g.a, y1 + size * g.e
    return chips.withColumns({"xmin": x0, "ymin": y0, "xmax": x1, "ymax": y1, "center_x": (x0 + x1) / 2, "center_y": (y0 + y1) / 2})


#: What each strictness of grid_check compares.
_CHECKS = {
    "transform": ["crs", "a", "e", "c", "f"],
    "shape": ["crs", "a", "e", "c", "f", "width", "height"],
}


def grid_check(rasters: DataFrame, g: Grid, mode: str = "shape") -> Column:
    """Whether a raster of the catalog lies on the grid, by transform, shape, tolerance or signature (6 decimals)."""
    same = F.col("crs") == g.crs
    if mode in _CHECKS:
        for name in _CHECKS[mode][1:]:
            same = same & (F.col(name) == getattr(g, name))
    elif mode == "tolerance":
        right, low = g.c + g.a * g.width, g.f + g.e * g.height
        for found, want, slack in [("a", g.a, 1e-9), ("e", g.e, 1e-9), ("c", g.c, 1e-6), ("f", g.f, 1e-6)]:
            same = same & (F.abs(F.col(found) - want) <= slack)
        same = same & (F.abs(F.col("c") + F.col("a") * F.col("width") - right) <= 1e-6) & (F.abs(F.col("f") + F.col("e") * F.col("height") - low) <= 1e-6)
    elif mode == "signature":
        for name in ("a", "e", "c", "f"):
            same = same & (F.round(F.col(name), 6) == F.round(F.lit(getattr(g, name)), 6))
        same = same & (F.col("width") == g.width) & (F.col("height") == g.height)
    else:
        raise ValueError(f"unknown mode {mode}")
    return F.coalesce(same, F.lit(False))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each box of ``a`` against the one box of ``b``: whether they overlap, containment, and the common box."""
    box = b.select(*[F.col(n).alias(f"_{n}") for n in ("xmin", "ymin", "xmax", "ymax")]).limit(1)
    both = a.crossJoin(F.broadcast(box))
    low = {n: F.greatest(n, f"_{n}") for n in ("xmin", "ymin")}
    high = {n: F.least(n, f"_{n}") for n in ("xmax", "ymax")}
    hit = (low["xmin"] < high["xmax"]) & (low["ymin"] < high["ymax"])
    inside = (F.col("xmin") >= F.col("_xmin")) & (F.col("ymin") >= F.col("_ymin")) & (F.col("xmax") <= F.col("_xmax")) & (F.col("ymax") <= F.col("_ymax"))
    common = {f"common_{n}": F.when(hit, c) for n, c in (low | high).items()}
    return both.withColumns({"overlaps": hit, "contained": inside} | common).drop("_xmin", "_ymin", "_xmax", "_ymax")


def north_up(px: DataFrame, height: int) -> DataFrame:
    """Turn a south-up raster over; its grid then has f + e * (h - 1) and -e."""
    return px.withColumn("px_row", height - 1 - F.col("px_row"))


def snap_extent(boxes: DataFrame, res: float) -> DataFrame:
    """Boxes widened to multiples of the resolution."""
    down, up = [(n, F.floor(F.col(n) / res) * res) for n in ("xmin", "ymin")], [(n, F.ceil(F.col(n) / res) * res) for n in ("xmax", "ymax")]
    return boxes.withColumns({n: c.cast("double") for n, c in down + up})


def clip_rect(px: DataFrame, row0: int, col0: int, height: int, width: int) -> DataFrame:
    """The pixels of a window, numbered from its corner; the range filters reach the scan."""
    inside = F.col("px_row").between(row0, row0 + height - 1) & F.col("px_col").between(col0, col0 + width - 1)
    return px.where(inside).withColumns({"px_row": F.col("px_row") - row0, "px_col": F.col("px_col") - col0})


def to_blocks(px: DataFrame, size: int, values: list[str]) -> DataFrame:
    """One row for each block of size x size pixels (ragged at the edges), its pixels in reading order."""
    at = {"block_row": F.floor(F.col("px_row") / size).cast("bigint"), "block_col": F.floor(F.col("px_col") / size).cast("bigint")}
    return px.withColumns(at).groupBy("block_row", "block_col").agg(F.sort_array(F.collect_list(F.struct("px_row", "px_col", *values))).alias("pixels"))


def to_pixels(blocks: DataFrame) -> DataFrame:
    """The pixels of blocks."""
    return blocks.select(F.inline("pixels"))


# --- resampling ------------------------------------------------------------------------------------------


def cells(px: DataFrame, g: Grid, to: Grid) -> DataFrame:
    """Source coordinates of each pixel of ``to`` (its rows are given): src_y and src_x, whole numbers at cell centres."""
    at = xy(to)
    return px.withColumns({"src_y": (at["y"] - g.f) / g.e - 0.5, "src_x": (at["x"] - g.c) / g.a - 0.5})


def align_nearest(target: DataFrame, src: DataFrame, to: Grid, g: Grid, values: list[str], fill: float | None = None) -> DataFrame:
    """The source's value at each target pixel's centre; ``fill`` where it has none. One equi-join on the pixel."""
    src = src.select(F.col("px_row").alias("_r"), F.col("px_col").alias("_c"), *values)
    at = cells(target.select("px_row", "px_col"), g, to).select("px_row", "px_col", F.floor(F.col("src_y") + 0.5).cast("bigint").alias("_r"), F.floor(F.col("src_x") + 0.5).cast("bigint").alias("_c"))
    out = at.join(src, ["_r", "_c"], "left").drop("_r", "_c")
    return out if fill is None else out.fillna(fill, values)


def _weight(method: str, d: Column) -> Column:
    """The kernel's weight at distance d >= 0."""
    if method == "bilinear":
        return F.greatest(F.lit(0.0), 1 - d)
    if method == "cubic":  # convolution with a = -0.5
        near, far = 1.5 * d * d * d - 2.5 * d * d + 1, -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2
        return F.when(d < 1, near).when(d < 2, far).otherwise(0.0)
    if method == "cubicspline":
        near, far = (4 - 6 * d * d + 3 * d * d * d) / 6, (2 - d) * (2 - d) * (2 - d) / 6
        return F.when(d < 1, near).when(d < 2, far).otherwise(0.0)
    if method == "lanczos":
        sinc = lambda t: F.when(t == 0, 1.0).otherwise(F.sin(t) / t)
        t = d * F.pi()
        return F.when(d < 3, sinc(t) * sinc(t / 3)).otherwise(0.0)
    raise ValueError(f"unknown method {method}")


#: Cells that each kernel reaches on either side.
REACH = {"bilinear": 1, "cubic": 2, "cubicspline": 2, "lanczos": 3}
#: The part of a kernel (whose weights sum to about 1) that must meet cells with values.
LEAST_WEIGHT = 0.1


def resample(target: DataFrame, src: DataFrame, to: Grid, g: Grid, value: str, method: str = "nearest") -> DataFrame:
    """Nearest, a kernel over the cells around each target pixel, or average/mode of the source pixels in it.

    Weights of missing cells are left out and the rest scaled up; where the rest sum to less than ``LEAST_WEIGHT``
    the value is NULL, as negative lobes could then blow it up. Each target
    pixel becomes at most (2 * reach)^2 rows that meet the source in one equi-join; average and mode go from
    the source's pixels instead, so no row is multiplied. Ties of mode go to the least value.
    """
    if method == "nearest":
        return align_nearest(target, src, to, g, [value])
    if method in ("average", "mode"):
        at = rowcol(to, **xy(g))
        inside = src.where(F.col(value).isNotNull()).select(at["px_row"].alias("px_row"), at["px_col"].alias("px_col"), value)
        if method == "average":
            found = inside.groupBy("px_row", "px_col").agg(F.avg(value).alias(value))
        else:
            counts = inside.groupBy("px_row", "px_col", value).agg(F.count("*").alias("_n"))
            found = counts.groupBy("px_row", "px_col").agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))
        return target.select("px_row", "px_col").join(found, ["px_row", "px_col"], "left")
    n = REACH[method]
    taps = lambda at: F.transform(F.sequence(F.lit(1 - n), F.lit(n)), lambda i: F.floor(F.col(at)) + i)
    at = cells(target.select("px_row", "px_col"), g, to).withColumn("_r", F.explode(taps("src_y"))).withColumn("_c", F.explode(taps("src_x")))
    at = at.withColumn("_w", _weight(method, F.abs(F.col("src_y") - F.col("_r"))) * _weight(method, F.abs(F.col("src_x") - F.col("_c")))).where("abs(_w) > 1e-9")
    src = src.where(F.col(value).isNotNull()).select(F.col("px_row").alias("_r"), F.col("px_col").alias("_c"), value)
    total = at.join(src, ["_r", "_c"], "left").groupBy("px_row", "px_col").agg(F.sum(F.col("_w") * F.col(value)).alias("_v"), F.sum(F.when(F.col(value).isNotNull(), F.col("_w"))).alias("_s"))
    return total.select("px_row", "px_col", F.when(F.col("_s") >= LEAST_WEIGHT, F.try_divide("_v", "_s")).alias(value))


# --- polygons --------------------------------------------------------------------------------------------


def edges(rings) -> Column:
    """The sides of all rings, as (p, q) structs."""
    side = lambda ring: F.transform(ring, lambda p, i: F.struct(p.alias("p"), F.get(ring, (i + 1) % F.size(ring)).alias("q")))
    return F.flatten(F.transform(col(rings), side))


def crossing(s, y) -> tuple[Column, Column]:
    """Whether a side crosses the row at y, and at which x."""
    p, q = s["p"], s["q"]
    return (p["y"] > y) != (q["y"] > y), p["x"] + F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"])


def inside(sides, x, y) -> Column:
    """Even-odd test of a point against the sides of a polygon."""
    x, y = col(x), col(y)

    def crosses(s):
        meets, at = crossing(s, y)
        return F.coalesce(meets & (x < at), F.lit(False))

    return F.size(F.filter(col(sides), crosses)) % 2 == 1


def side_distance(s, x, y) -> Column:
    """Distance from a point to a side."""
    p, dx, dy = s["p"], s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]
    t = F.try_divide((x - p["x"]) * dx + (y - p["y"]) * dy, dx * dx + dy * dy)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(t, F.lit(0.0))))
    ex, ey = x - p["x"] - t * dx, y - p["y"] - t * dy
    return F.sqrt(ex * ex + ey * ey)


def distance(sides, x, y) -> Column:
    """Distance from a point to the nearest side."""
    return F.array_min(F.transform(col(sides), lambda s: side_distance(s, col(x), col(y))))


def boxed(polys: DataFrame, rings: str = "rings") -> DataFrame:
    """Add sides and the polygon's box."""
    points = F.flatten(F.col(rings))
    of = lambda part: F.transform(points, lambda p: p[part])
    box = {"_x0": F.array_min(of("x")), "_x1": F.array_max(of("x")), "_y0": F.array_min(of("y")), "_y1": F.array_max(of("y"))}
    return polys.withColumns(box | {"_sides": edges(rings)}).where("_x0 IS NOT NULL")


def by_block(polys: DataFrame, size: int, margin: float = 0.0) -> DataFrame:
    """One row for each block of size x size pixels that a polygon's box (with a margin) touches; polygons in pixel units.

    A block keeps the sides that cross its rows (with the margin): others meet neither its pixels' rays nor the margin.
    """
    span = lambda low, high: F.explode(F.sequence(F.floor((F.col(low) - margin) / size), F.floor((F.col(high) + margin) / size)))
    top, bottom = F.col("_br") * size - margin, (F.col("_br") + 1) * size + margin
    near = F.filter("_sides", lambda s: (F.least(s["p"]["y"], s["q"]["y"]) <= bottom) & (F.greatest(s["p"]["y"], s["q"]["y"]) >= top))
    return polys.withColumn("_br", span("_y0", "_y1")).withColumn("_sides", near).withColumn("_bc", span("_x0", "_x1"))


def crosses_rect(side, x0, y0, x1, y1) -> Column:
    """Whether a side meets a closed rectangle: their boxes overlap, and its line doesn't leave all corners on one hand."""
    p, q = side["p"], side["q"]
    over = lambda c, low, high: (F.least(p[c], q[c]) <= high) & (F.greatest(p[c], q[c]) >= low)
    hand = [(q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"]) for x in (x0, x1) for y in (y0, y1)]
    return over("x", x0, x1) & over("y", y0, y1) & (F.least(*hand) <= 0) & (F.greatest(*hand) >= 0)


def classed_blocks(polys: DataFrame, size: int) -> DataFrame:
    """The closed blocks of size x size pixels that a polygon meets: _br, _bc, and _sides of its rows, NULL where the block is wholly inside."""
    boxes = boxed(polys)
    rows, cols = (F.sequence(F.ceil(F.col(low) / size) - 1, F.floor(F.col(high) / size)) for low, high in (("_y0", "_y1"), ("_x0", "_x1")))
    top, bottom = F.col("_br") * size, (F.col("_br") + 1) * size
    near = F.filter("_sides", lambda s: (F.least(s["p"]["y"], s["q"]["y"]) <= bottom) & (F.greatest(s["p"]["y"], s["q"]["y"]) >= top))
    blocks = boxes.withColumn("_br", F.explode(rows)).withColumn("_sides", near).withColumn("_bc", F.explode(cols))
    left, right = F.col("_bc") * size, (F.col("_bc") + 1) * size
    edge = F.exists("_sides", lambda s: crosses_rect(s, left, top, right, bottom))
    blocks = blocks.withColumn("_edge", edge).where(F.col("_edge") | inside("_sides", left, top))
    return blocks.withColumn("_sides", F.when(F.col("_edge"), F.col("_sides"))).drop("_edge", "_x0", "_x1", "_y0", "_y1")


def join_polygons(px: DataFrame, polys: DataFrame, carry: list[str], size: int = 32, within: float = 0.0) -> DataFrame:
    """Pixels with each polygon that holds their centre (or lies within a distance), in pixel units.

    An equi-join on blocks; the exact test follows, so no pixel meets a polygon outside its block.
    """
    at = {"_br": F.floor((F.col("px_row") + 0.5) / size), "_bc": F.floor((F.col("px_col") + 0.5) / size)}
    shapes = by_block(boxed(polys), size, within).select("_br", "_bc", "_sides", *carry)
    x, y = F.col("px_col") + 0.5, F.col("px_row") + 0.5
    hit = inside("_sides", x, y)
    if within > 0:
        hit = hit | (distance("_sides", x, y) <= within)
    return px.withColumns(at).join(shapes, ["_br", "_bc"]).where(hit).drop("_br", "_bc", "_sides")


def rasterize(px: DataFrame, polys: DataFrame, label: str, background: int = 0, size: int = 32) -> DataFrame:
    """The label of the last polygon (by ord) at each pixel's centre, else the background."""
    px = px.select("px_row", "px_col")
    hits = join_polygons(px, polys, ["ord", label], size)
    top = hits.groupBy("px_row", "px_col").agg(F.max_by(label, "ord").alias("label"))
    return px.join(top, ["px_row", "px_col"], "left").withColumn("label", F.coalesce("label", F.lit(background)))


def tile_hits(polys: DataFrame, size: int, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """The chips that any polygon meets, touching included; those of a raster of rows x cols chips, where these are given.

    Blocks of the polygon's box, then an exact test: a side crosses the chip, or the chip lies inside.
    """
    hit = classed_blocks(polys, size).select(F.col("_br").cast("bigint").alias("chip_row"), F.col("_bc").cast("bigint").alias("chip_col")).distinct()
    for c, n in (("chip_row", rows), ("chip_col", cols)):
        if n is not None:
            hit = hit.where(F.col(c).between(0, n - 1))
    return hit


#: Pixels this near the edge of a buffer are tested one by one, as the ends of its runs are rounded.
SLACK = 1e-3


def inner_runs(shapes: DataFrame, size: int) -> DataFrame:
    """Runs of pixels of a row, px_row and _c0 to _c1, whose centres are inside a polygon (with _sides and its box)."""
    top, y = F.col("_br") * size, F.col("px_row") + 0.5
    near = F.filter("_sides", lambda s: (F.least(s["p"]["y"], s["q"]["y"]) <= top + size) & (F.greatest(s["p"]["y"], s["q"]["y"]) >= top))
    rows = shapes.withColumn("_br", F.explode(F.sequence(F.floor(F.col("_y0") / size), F.floor(F.col("_y1") / size)))).withColumn("_sides", near)
    rows = rows.withColumn("px_row", F.explode(F.sequence(F.greatest(top, F.floor("_y0")), F.least(top + size - 1, F.floor("_y1")))))
    at = F.transform("_sides", lambda s: F.when(*crossing(s, y)))
    # A crossing counts for the columns before the first whose centre isn't left of it, so runs lie between each odd one from the right and the next.
    ends = F.transform(F.sort_array(F.array_compact(at), False), lambda x: F.floor(x) + (F.floor(x) + 0.5 < x).cast("int"))
    # Outer, as Spark else works the array out once more to filter by its size.
    rows = rows.withColumn("_ends", ends).select("px_row", "_x0", "_ends", F.posexplode_outer("_ends").alias("_i", "_end")).where("_i % 2 = 0")
    runs = rows.select("px_row", F.coalesce(F.get("_ends", F.col("_i") + 1), F.floor("_x0")).alias("_c0"), (F.col("_end") - 1).alias("_c1"))
    return runs.where("_c0 <= _c1")


def margin_runs(shapes: DataFrame, within: float) -> DataFrame:
    """Runs of pixels of a row, px_row and _c0 to _c1, whose centres are within a distance of a side.

    A row meets the buffer of a side in one run. The pixels in a buffer smaller by ``SLACK`` are taken; those that only a
    larger one holds are tested each. The columns come in steps, since each is used several times by the next.
    """
    far, c = within + SLACK, F.col
    s = c("_s")
    sides = shapes.select(F.explode_outer("_sides").alias("_s")).withColumns({"_x": s["p"]["x"], "_y": s["p"]["y"], "_dx": s["q"]["x"] - s["p"]["x"], "_dy": s["q"]["y"] - s["p"]["y"]})
    sides = sides.where("_dx + _dy IS NOT NULL").withColumn("_lean", F.coalesce(F.try_divide(c("_dx") * F.signum("_dy"), F.sqrt(c("_dx") * c("_dx") + c("_dy") * c("_dy"))), F.lit(0.0)))
    low, high = F.least(F.lit(0.0), "_dy") + c("_y"), F.greatest(F.lit(0.0), "_dy") + c("_y")
    rows = sides.withColumn("px_row", F.explode(F.sequence(F.floor(low - far), F.floor(high + far)))).withColumn("_off", c("px_row") + 0.5 - c("_y"))

    # Of all discs on the side, the one that reaches farthest left (-1) or right (1) in the row: its place, its height over the row, its end there.
    ends = {f"{n}{i}": (r, hand) for n, r in (("m", far), ("c", within - SLACK)) for i, hand in ((0, -1), (1, 1))}
    place = {n: F.coalesce(F.try_divide(c("_off") + hand * r * c("_lean"), c("_dy")), F.when(hand * c("_dx") > 0, 1.0).otherwise(0.0)) for n, (r, hand) in ends.items()}
    rows = rows.withColumns({f"_t{n}": F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)) for n, t in place.items()})
    rows = rows.withColumns({f"_h{n}": c("_off") - c(f"_t{n}") * c("_dy") for n in ends})
    reach = {n: F.when(F.abs(f"_h{n}") <= r, c("_x") + c(f"_t{n}") * c("_dx") + hand * F.sqrt(F.greatest(F.lit(0.0), r * r - c(f"_h{n}") * c(f"_h{n}")))) for n, (r, hand) in ends.items()}
    rows = rows.withColumns({f"_{n}": (F.ceil if ends[n][1] < 0 else F.floor)(x - 0.5) for n, x in reach.items()})

    sure = F.coalesce(c("_c0") <= c("_c1"), F.lit(False))
    rows = rows.withColumns({"_c0": F.when(sure, F.greatest("_c0", "_m0")).otherwise(c("_m1") + 1), "_c1": F.when(sure, F.least("_c1", "_m1")).otherwise(c("_m1"))})
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    edge = F.concat(F.array(F.lit(None).cast("bigint")), span(c("_m0"), c("_c0") - 1), span(c("_c1") + 1, c("_m1")))
    rows = rows.select("px_row", "_s", "_c0", "_c1", F.explode_outer(edge).alias("_e")).where(c("_e").isNull() | (side_distance(s, c("_e") + 0.5, c("px_row") + 0.5) <= within))
    return rows.select("px_row", F.coalesce("_e", "_c0").alias("_c0"), F.coalesce("_e", "_c1").alias("_c1")).where("_c0 <= _c1")


def burn(polys: DataFrame, within: float = 0.0, size: int = 32) -> DataFrame:
    """The pixels inside a polygon or within a distance of it: one row for each px_row and _word of 64 columns, with their bits.

    Polygons become runs of pixels, equal ones once, and runs the bits of words, which meet in one aggregation: work grows
    with the rows that sides and polygons take up, not with pixels times polygons.
    """
    shapes = boxed(polys.select("rings").distinct())
    runs = inner_runs(shapes, size)
    if within > 0:
        runs = runs.union(margin_runs(shapes, within))
    words = runs.withColumn("_word", F.explode(F.sequence(F.shiftright("_c0", 6), F.shiftright("_c1", 6))))
    bits = F.expr("shiftleft(-1L, cast(greatest(_c0 - _word * 64, 0) AS int)) & shiftrightunsigned(-1L, cast(greatest(_word * 64 + 63 - _c1, 0) AS int))")
    return words.groupBy("px_row", "_word").agg(F.bit_or(bits).alias("_bits"))


def erase_buffer(px: DataFrame, polys: DataFrame, within: float, value: str, size: int = 32) -> DataFrame:
    """NULL at the pixels inside a polygon or within a distance of it. Pixels meet the burned mask in one equi-join."""
    at = F.col("px_col").cast("bigint")
    marked = px.withColumn("_word", F.shiftright(at, 6)).join(burn(polys, within, size), ["px_row", "_word"], "left")
    hit = F.coalesce(F.getbit("_bits", at.bitwiseAND(F.lit(63)).cast("int")), F.lit(0)) == 1
    return marked.withColumn(value, F.when(~hit, F.col(value))).select(*px.columns)


def clip_by_key(px: DataFrame, polys: DataFrame, key: str, size: int = 32) -> DataFrame:
    """Each raster's pixels inside the one polygon of its key; keys with no or several polygons give nothing.

    An equi-join on key and block: pixels of blocks wholly inside pass, those of edge blocks are tested against the
    sides that cross their block's rows, others meet nothing.
    """
    one = polys.groupBy(key).agg(F.count("*").alias("_n"), F.any_value("rings").alias("rings")).where("_n = 1")
    shapes = classed_blocks(one, size).select(key, "_br", "_bc", "_sides")
    at = {"_br": F.floor((F.col("px_row") + 0.5) / size), "_bc": F.floor((F.col("px_col") + 0.5) / size)}
    hit = F.col("_sides").isNull() | inside("_sides", F.col("px_col") + 0.5, F.col("px_row") + 0.5)
    return px.withColumns(at).join(shapes, [key, "_br", "_bc"]).where(hit).drop("_br", "_bc", "_sides")
