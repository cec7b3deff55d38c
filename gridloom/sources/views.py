"""Raster views of the given tables, as DataFrames and, for the oracle, as DuckDB SQL.

scene_px: four overlapping 10-band tiles; scene: their last-wins mosaic; land_mask: a full grid with water
as nodata; label_polys: boxes and right triangles; topo_px: named terrain values with junk; mc_pred: class
probabilities of 20 passes; aef_q: quantised 64-band embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = 256

SCENE_PX = """SELECT l_suppkey % 4 AS tile_id, l_orderkey % 256 AS px_row, l_partkey % 256 AS px_col,
 l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax,
 l_quantity*40 + 300 AS b1,
 CASE WHEN l_linenumber = 7 AND l_suppkey % 5 = 0 THEN CAST(0 AS DOUBLE)
      WHEN l_partkey % 97 = 0 THEN CAST(65535 AS DOUBLE) ELSE l_quantity*60 + 200 END AS b2,
 l_quantity*50 + l_discount*1000 AS b3, l_quantity*45 + 250 AS b4, l_quantity*48 + 350 AS b5,
 l_extendedprice/30 AS b6, l_extendedprice/25 AS b7, l_extendedprice/24 AS b8,
 400 + l_tax*20000 + l_discount*10000 AS b9, 300 + l_tax*15000 AS b10
FROM {lineitem}"""

ORDER = "tile_id DESC, l_orderkey DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC"

SCENE = """SELECT tile_id, px_row, px_col, b1,b2,b3,b4,b5,b6,b7,b8,b9,b10 FROM (
 SELECT *, row_number() OVER (PARTITION BY px_row, px_col ORDER BY """ + ORDER + """) AS rn
 FROM {scene_px}) t WHERE rn = 1"""

LAND_MASK = """SELECT r.i AS px_row, c.i AS px_col,
 CASE WHEN (r.i*31 + c.i*17) % 7 = 0 THEN CAST(-9999 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS mask
FROM range(256) AS r(i) CROSS JOIN range(256) AS c(i)"""

LABEL_POLYS = """SELECT s_suppkey AS poly_id, (s_suppkey*37) % 224 + CAST(0.25 AS DOUBLE) AS x0,
 (s_suppkey*53) % 224 + CAST(0.25 AS DOUBLE) AS y0, 16 + s_suppkey % 17 AS w,
 CASE WHEN s_suppkey % 2 = 0 THEN 'box' ELSE 'triangle' END AS shape,
 CASE s_nationkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END AS cls
FROM {supplier}"""

TOPO_PX = """SELECT CASE p_partkey % 6 WHEN 0 THEN 'tri' WHEN 1 THEN 'spi' WHEN 2 THEN 'slope' WHEN 3 THEN 'dtm'
   WHEN 4 THEN 'curv_plan' ELSE 'aspect' END AS raster_id,
 p_partkey AS px_id,
 CASE WHEN p_partkey % 11 = 0 THEN CAST(1e15 AS DOUBLE) WHEN p_partkey % 13 = 0 THEN CAST(-1 AS DOUBLE)
   WHEN p_partkey % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE (p_retailprice - 900)/10 - 5 END AS v
FROM {part}"""

MC_PRED = """SELECT px_row, px_col, pass, k, exp(z) / sum(exp(z)) OVER (PARTITION BY px_row, px_col, pass) AS p FROM (
 SELECT s.px_row, s.px_col, q.i AS pass, k.i AS k,
  CAST((s.px_row*7 + s.px_col*13 + q.i*17 + k.i*29 + (s.px_row*q.i*k.i) % 11) % 100 AS DOUBLE)/25 AS z
 FROM (SELECT px_row, px_col FROM {scene}) s
 CROSS JOIN range(20) AS q(i) CROSS JOIN range(1,4) AS k(i)) t"""

AEF_Q = """SELECT vec_id, {div} AS px_row, vec_id % 16 AS px_col, b,
 CASE WHEN b = 0 AND vec_id % 17 = 0 THEN -128
      ELSE CAST(greatest(-127, least(127, floor(CAST(e AS DOUBLE)*250 + 0.5))) AS INT) END AS q FROM ({src}) t"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scene_px(spark, sf_dir):
    return spark.sql(SCENE_PX, lineitem=table(spark, sf_dir, "lineitem"))


def scene(spark, sf_dir):
    """The mosaic by an explicit full order; operators.mosaic has the general form."""
    return spark.sql(SCENE, scene_px=scene_px(spark, sf_dir))


def land_mask(spark, sf_dir=None):
    return spark.sql(LAND_MASK)


def label_polys(spark, sf_dir):
    return spark.sql(LABEL_POLYS, supplier=table(spark, sf_dir, "supplier"))


def topo_px(spark, sf_dir):
    return spark.sql(TOPO_PX, part=table(spark, sf_dir, "part"))


def mc_pred(spark, sf_dir):
    return spark.sql(MC_PRED, scene=scene(spark, sf_dir))


def aef_q(spark, sf_dir):
    src = "SELECT vec_id, posexplode(embedding) AS (b, e) FROM {embeddings}"
    return spark.sql(AEF_Q.replace("{div}", "vec_id div 16").replace("{src}", src), embeddings=table(spark, sf_dir, "embeddings"))


def aef_arrays(spark, sf_dir):
    """aef_q before its bands become rows: vec_id and the array q."""
    q = F.transform("embedding", lambda e, i: F.when((i == 0) & (F.col("vec_id") % 17 == 0), -128).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(e.cast("double") * 250 + 0.5))).cast("int")))
    return table(spark, sf_dir, "embeddings").select("vec_id", q.alias("q"))


#: The same views for the oracle, in the order in which they build on each other.
_SQL = {
    "scene_px": SCENE_PX.replace("{lineitem}", "lineitem"),
    "scene": SCENE.replace("{scene_px}", "scene_px"),
    "land_mask": LAND_MASK,
    "label_polys": LABEL_POLYS.replace("{supplier}", "supplier"),
    "topo_px": TOPO_PX.replace("{part}", "part"),
    "mc_pred": MC_PRED.replace("{scene}", "scene"),
    "aef_q": AEF_Q.replace("{div}", "vec_id // 16").replace("{src}", "SELECT vec_id, unnest(range(len(embedding))) AS b, unnest(embedding) AS e FROM embeddings"),
}


def oracle(body: str, *views: str) -> str:
    """Oracle SQL over the named views (and those that they need)."""
    need = {"scene": ["scene_px", "scene"], "mc_pred": ["scene_px", "scene", "mc_pred"]}
    names = list(dict.fromkeys(x for v in views for x in need.get(v, [v])))
    head = ",\n".join(f"{n} AS ({_SQL[n]})" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},{body[14:]}"
    return f"WITH {head}{',' + body[4:] if body.upper().startswith('WITH') else chr(10) + body}" if head else body
