"""Reprojection within the UTM family and to longitude and latitude, as column arithmetic.

Transverse Mercator by Krüger's series in the third flattening n, to the fourth power (well under a millimetre
within a few degrees of a zone). A CRS is "EPSG:258zz" or "EPSG:326zz" (zone zz, north), "EPSG:4258" or
"EPSG:4326" (degrees); the datums are taken as one. NULL coordinates give NULL. Each step is its own
projection, which keeps the expressions small.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Grid, xy

#: The GRS80 ellipsoid and the UTM scale and false easting.
AXIS, FLATTENING, SCALE, EASTING = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0
_N = FLATTENING / (2 - FLATTENING)
_ECC = 2 * math.sqrt(_N) / (1 + _N)
_RADIUS = SCALE * AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def _series(*rows: tuple[float, ...]) -> list[float]:
    """Sums of c * n^k; each row begins with the power of its number."""
    return [sum(c * _N ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(rows, 1)]


#: Krüger's coefficients, projecting, unprojecting and from conformal to geographic latitude.
ALPHA = _series((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
BETA = _series((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
DELTA = _series((2, -2 / 3, -2, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))

Step = Callable[[Callable[[str], Column]], dict[str, Column]]


def zone(crs: str) -> int | None:
    """The UTM zone of a CRS; None for degrees."""
    code = re.fullmatch(r"EPSG:(?:(?:258|326)(\d\d)|4258|4326)", crs)
    if not code or code[1] and not 1 <= int(code[1]) <= 60:
        raise ValueError(f"unknown CRS {crs}")
    return int(code[1]) if code[1] else None


def _meridian(z: int) -> float:
    return math.radians(6 * z - 183)


def _wave(u: Column, v: Column, terms: list[float], along: bool) -> Column:
    """The series' sum for the northing (along) or the easting."""
    out = F.lit(0.0)
    for j, c in enumerate(terms, 1):
        out = out + (F.sin(2 * j * u) * F.cosh(2 * j * v) if along else F.cos(2 * j * u) * F.sinh(2 * j * v)) * c
    return out


def steps(src: str, dst: str) -> list[Step]:
    """From (x, y) of one CRS to (x, y) of another; between them t, the tangent of the conformal latitude, and the longitude."""
    a, b = zone(src), zone(dst)
    if a is None:
        sine = lambda g: F.sin(F.radians(g("y")))
        first: list[Step] = [lambda g: {"t": F.sinh(F.atanh(sine(g)) - _ECC * F.atanh(_ECC * sine(g))), "lam": F.radians(g("x"))}]
    else:
        first = [
            lambda g: {"u": g("y") / _RADIUS, "v": (g("x") - EASTING) / _RADIUS},
            lambda g: {"u": g("u") - _wave(g("u"), g("v"), BETA, True), "v": g("v") - _wave(g("u"), g("v"), BETA, False)},
            lambda g: {"t": F.sin(g("u")) / F.sqrt(F.pow(F.sinh(g("v")), 2) + F.pow(F.cos(g("u")), 2)), "lam": F.atan2(F.sinh(g("v")), F.cos(g("u"))) + _meridian(a)},
        ]
    if b is None:
        return [
            *first,
            lambda g: {"u": F.atan(g("t")), "lam": g("lam")},
            lambda g: {"x": F.degrees(g("lam")), "y": F.degrees(g("u") + sum((F.sin(2 * j * g("u")) * c for j, c in enumerate(DELTA, 1)), F.lit(0.0)))},
        ]
    return [
        *first,
        lambda g: {"t": g("t"), "lam": g("lam") - _meridian(b)},
        lambda g: {"u": F.atan2(g("t"), F.cos(g("lam"))), "v": F.asinh(F.sin(g("lam")) / F.sqrt(F.pow(g("t"), 2) + F.pow(F.cos(g("lam")), 2)))},
        lambda g: {"x": EASTING + _RADIUS * (g("v") + _wave(g("u"), g("v"), ALPHA, False)), "y": _RADIUS * (g("u") + _wave(g("u"), g("v"), ALPHA, True))},
    ]


def to_crs_points(points: DataFrame, src: str, dst: str, x: str = "x", y: str = "y") -> DataFrame:
    """Points with their coordinates (the last columns) in another CRS.

    They come out of a generator, which filters on them can't be pushed through: pushed down, such a filter would
    hold all steps in one expression.
    """
    if src == dst:
        return points
    out = points.withColumns({"_p_x": F.col(x), "_p_y": F.col(y)})
    for step in steps(src, dst):
        out = out.withColumns({f"_p_{k}": c for k, c in step(lambda k: F.col(f"_p_{k}")).items()})
    made = F.struct(F.col("_p_x").alias(x), F.col("_p_y").alias(y))
    return out.select(*[c for c in points.columns if c not in (x, y)], F.inline(F.array(made)))


def to_crs(polys: DataFrame, src: str, dst: str, rings: str = "rings") -> DataFrame:
    """Polygons with every ring vertex in another CRS; unchanged where both are the same."""
    if src == dst:
        return polys

    def along(step):
        return lambda p: F.struct(*[c.alias(k) for k, c in step(lambda k: p[k]).items()])

    def moved(ring):
        for step in steps(src, dst):
            ring = F.transform(ring, along(step))
        return ring

    return polys.withColumn(rings, F.transform(rings, moved))


def projected_grid(spark, g: Grid, crs: str, res: float, pieces: int = 20) -> Grid:
    """The grid that covers another's outline, ``pieces`` points a side, in whole cells of ``res``. One row comes back."""
    at = F.col("id") / pieces
    right, down = g.c + g.width * g.a, g.f + g.height * g.e
    sides = [(g.c + at * (right - g.c), F.lit(g.f)), (g.c + at * (right - g.c), F.lit(down)), (F.lit(g.c), g.f + at * (down - g.f)), (F.lit(right), g.f + at * (down - g.f))]
    points = spark.range(pieces + 1).select(F.inline(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in sides])))
    box = to_crs_points(points, g.crs, crs).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    west, north = math.floor(box["x0"] / res) * res, math.ceil(box["y1"] / res) * res
    return Grid(c=west, f=north, a=res, e=-res, width=math.ceil((box["x1"] - west) / res), height=math.ceil((north - box["y0"]) / res), crs=crs)


def reproject(px: DataFrame, g: Grid, crs: str, res: float, values: list[str], block: int | None = None) -> tuple[DataFrame, Grid]:
    """Nearest values on a grid of ``res`` in another CRS, and that grid; cells outside the source have no row.

    Cells are numbered in tasks, carried back by column arithmetic and joined on the source's pixel: one equi-join.
    With ``block``, the series is worked out for nine points of each block of cells instead of every cell; see
    block_pixels(). The rows are the same.
    """
    spark = px.sparkSession
    to = projected_grid(spark, g, crs, res)
    at = source_pixels(cells_of(spark, to), to, g) if block is None else block_pixels(spark, to, g, block)
    at = at.select("px_row", "px_col", F.floor("_r").cast("bigint").alias("_r"), F.floor("_c").cast("bigint").alias("_c")).where(F.col("_r").between(0, g.height - 1) & F.col("_c").between(0, g.width - 1))
    src = px.select(F.col("px_row").alias("_r"), F.col("px_col").alias("_c"), *values)
    return at.join(src, ["_r", "_c"]).drop("_r", "_c"), to


def source_pixels(cells: DataFrame, to: Grid, g: Grid) -> DataFrame:
    """px_row, px_col and _r, _c: where in the source grid's rows and columns each cell's centre lies."""
    at = to_crs_points(cells.select("px_row", "px_col").withColumns(xy(to)), to.crs, g.crs)
    return at.select("px_row", "px_col", ((F.col("y") - g.f) / g.e).alias("_r"), ((F.col("x") - g.c) / g.a).alias("_c"))


#: How far the interpolated place may be off, as a multiple of what it is off at the points between the control points.
SAFE = 2.0


def block_pixels(spark, to: Grid, g: Grid, block: int) -> DataFrame:
    """source_pixels() of every cell of ``to``, interpolated between the corners of blocks of cells where that can't change a pixel.

    The series gives a block's four corners and, to check, the points between them. The greatest distance found
    there, doubled, bounds the error in the block, as the map is all but quadratic over it. Cells that lie within
    the bound of a source pixel's edge get the series itself. Blocks are made in tasks and exploded there.
    """
    down, across = -(-to.height // block), -(-to.width // block)
    top, left = F.expr(f"id div {across}") * block, F.col("id") % across * block
    steps_ = (0.0, 0.5, 1.0)
    centres = [(top + i * block, left + j * block) for i in steps_ for j in steps_]
    nine = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((p["x"], p["y"]) for p in (xy(to, r, c) for r, c in centres))])
    blocks = spark.range(down * across).select(top.alias("_top"), left.alias("_left"), F.array(nine).alias("p"))
    blocks = to_crs(blocks, to.crs, g.crs, "p").select("_top", "_left", *[F.transform(F.col("p")[0], f).alias(n) for n, f in (("r", lambda q: (q["y"] - g.f) / g.e), ("c", lambda q: (q["x"] - g.c) / g.a))])

    def between(v, i, j):
        """Bilinear, of the corners 0, 2, 6 and 8."""
        return (v[0] * (1 - j) + v[2] * j) * (1 - i) + (v[6] * (1 - j) + v[8] * j) * i

    off = [F.abs(v[3 * i + j] - between(v, i / 2, j / 2)) for v in (F.col("r"), F.col("c")) for i in range(3) for j in range(3) if i == 1 or j == 1]
    blocks = blocks.withColumn("_off", SAFE * F.greatest(*off) + 1e-9)
    cells = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(block * block - 1))).alias("_k")).withColumns({"_i": F.expr(f"_k div {block}"), "_j": F.col("_k") % block})
    i, j = F.col("_i") / block, F.col("_j") / block
    cells = cells.select((F.col("_top") + F.col("_i")).alias("px_row"), (F.col("_left") + F.col("_j")).alias("px_col"), "_off", between(F.col("r"), i, j).alias("_r"), between(F.col("c"), i, j).alias("_c"))
    cells = cells.where((F.col("px_row") < to.height) & (F.col("px_col") < to.width))
    near = F.greatest(*[F.col("_off") - F.abs(F.col(v) - F.round(v)) for v in ("_r", "_c")]) >= 0
    return cells.where(~near).select("px_row", "px_col", "_r", "_c").union(source_pixels(cells.where(near), to, g))


def cells_of(spark, g: Grid) -> DataFrame:
    """px_row and px_col of every cell of a grid."""
    return spark.range(g.width * g.height).select(F.expr(f"id div {g.width}").alias("px_row"), (F.col("id") % g.width).alias("px_col"))
