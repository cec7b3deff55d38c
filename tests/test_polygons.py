import math
import random

from pyspark.sql import functions as F

from gridloom.operators import grid as G

SIDE = 8


def star(r, cx, cy, size, n):
    """A ring around a point, mostly concave."""
    return [(cx + size * r.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), cy + size * r.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def holds(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


def enters(a, b, x0, y0, x1, y1):
    """Whether a segment has a point in a closed box: its parameters cut to each slab."""
    t0, t1 = 0.0, 1.0
    for p, d, low, high in ((a[0], b[0] - a[0], x0, x1), (a[1], b[1] - a[1], y0, y1)):
        if d == 0:
            if not low <= p <= high:
                return False
            continue
        u, v = sorted(((low - p) / d, (high - p) / d))
        t0, t1 = max(t0, u), min(t1, v)
    return t0 <= t1


def meets(rings, x0, y0, x1, y1):
    return any(enters(a, b, x0, y0, x1, y1) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])) or holds(rings, x0, y0)


def shapes():
    r = random.Random(6)
    out = []
    for i in range(40):
        size = r.choice([0.7, 3, 12, 30])
        rings = [star(r, r.uniform(0, 64), r.uniform(0, 64), size, r.randint(3, 12))]
        if i % 3 == 0:  # a hole
            rings.append([(sum(p[0] for p in rings[0]) / len(rings[0]) + dx, sum(p[1] for p in rings[0]) / len(rings[0]) + dy) for dx, dy in ((0, 0), (size / 5, 0), (0, size / 5))])
        out.append((i, rings))
    out.append((40, [[(8.0, 8.0), (24.0, 8.0), (24.0, 24.0), (8.0, 24.0)]]))  # on the chips' edges: touching counts
    out.append((41, [[(33.0, 33.0), (39.0, 39.0), (33.5, 39.0)]]))  # within one chip, box over it all
    out.append((42, [[(5.0, 5.0)]]))  # a point
    out.append((43, []))
    return out


def as_rows(spark, some):
    return spark.createDataFrame([(i, i, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for i, rings in some], f"poly_id long, ord long, rings {G.RINGS}")


def test_chips_by_exact_test(spark):
    for some in ([s] for s in shapes()[36:]):
        got = {(r.chip_row, r.chip_col) for r in G.tile_hits(as_rows(spark, some), SIDE, 8, 8).collect()}
        assert got == {(i, j) for i in range(8) for j in range(8) if meets(some[0][1], j * SIDE, i * SIDE, (j + 1) * SIDE, (i + 1) * SIDE)}, some
    some = shapes()
    got = {(r.poly_id, r._br, r._bc) for r in G.classed_blocks(as_rows(spark, some), SIDE).collect()}
    want = {(k, i, j) for k, rings in some for i in range(-9, 18) for j in range(-9, 18) if rings and meets(rings, j * SIDE, i * SIDE, (j + 1) * SIDE, (i + 1) * SIDE)}
    assert got == want
    boxes = G.by_block(G.boxed(as_rows(spark, some)), SIDE).count()
    assert len(got) < boxes  # the box alone hits more


def test_clip_meets_no_sides_inside(spark):
    some = [s for s in shapes() if s[1]]
    polys = as_rows(spark, some).withColumn("basin", F.col("poly_id") % 30)
    px = spark.range(64 * 64).selectExpr("id div 64 AS px_row", "id % 64 AS px_col").join(spark.range(30).selectExpr("id AS basin"))
    got = {(r.basin, r.px_row, r.px_col) for r in G.clip_by_key(px, polys, "basin", SIDE).collect()}
    lone = [i for i in range(30) if sum(k % 30 == i for k, _ in some) == 1]
    want = {(i, y, x) for i in lone for y in range(64) for x in range(64) if holds(next(rings for k, rings in some if k % 30 == i), x + 0.5, y + 0.5)}
    assert got == want and want
    inner = G.classed_blocks(as_rows(spark, some), SIDE).where("_sides IS NULL").count()
    assert inner > 0


def gap(rings, x, y):
    """Distance from a point to the nearest side."""
    def to(a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy
        t = min(1, max(0, ((x - a[0]) * dx + (y - a[1]) * dy) / n)) if n else 0
        return math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)

    return min((to(a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])), default=math.inf)


def test_erase_by_burned_runs(spark):
    """Erased are the pixels inside or within the distance, those just at it included; of snapped, flat and empty shapes too."""
    flat = [(50, [[(3.0, 50.0), (20.0, 50.0)]]), (51, [[(40.0, 3.0), (40.0, 9.0)]]), (52, [[(50.0, 50.0), (60.0, 50.0 + 1e-12), (60.0, 56.0), (50.0, 56.0 - 1e-9)]]), (53, [[(70.5, 20.5), (75.5, 20.5), (75.5, 25.5)]]), (54, [[]])]
    px = spark.range(90 * 90).selectExpr("id div 90 - 10 AS px_row", "id % 90 - 10 AS px_col", "id * 1.0D AS b1")
    some = shapes()[:6] + shapes()[40:] + flat
    for within in (0.0, 0.5, 2.5, 6.0):
        rows = G.erase_buffer(px, as_rows(spark, some), within, "b1").collect()
        got = {(r.px_row, r.px_col) for r in rows if r.b1 is None}
        want = {(i, j) for i in range(-10, 80) for j in range(-10, 80) if any(holds(g, j + 0.5, i + 0.5) or 0 < within >= gap(g, j + 0.5, i + 0.5) for _, g in some)}
        assert len(rows) == 8100 and got == want, within


def test_erase_meets_no_polygon_by_pixel(spark, tmp_path):
    """Pixels are read once and meet one mask, whose rows don't grow with the polygons over them."""
    spark.range(64 * 64).selectExpr("id div 64 AS px_row", "id % 64 AS px_col", "id * 1.0D AS b1").write.parquet(str(tmp_path / "px"))
    px = spark.read.parquet(str(tmp_path / "px"))
    piled = [(i, [[(10.0, 10.0), (40.0 + i / 100, 10.0), (10.0, 40.0)]]) for i in range(300)]
    plan = G.erase_buffer(px, as_rows(spark, piled), 2.0, "b1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Relation [") == 1
    assert G.burn(as_rows(spark, piled), 2.0).count() == G.burn(as_rows(spark, piled[-1:]), 2.0).count()
