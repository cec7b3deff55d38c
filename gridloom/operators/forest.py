"""Tree ensembles over feature columns, cross-validation by fold and importances. Fitting is Spark's own.

Labels are 0, 1, ... with features free of NULL; feature columns are assembled into one vector.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch

SCHEMA = "feature int, importance double"


def fit_rf(df: DataFrame, features: list[str], label: str = "label", weight: str | None = None, trees: int = 100, depth: int = 20, seed: int = 42) -> PipelineModel:
    """A random forest. Node ids are cached with the rows, so a deep tree isn't walked from its root for each level."""
    forest = RandomForestClassifier(labelCol=label, featuresCol="_features", predictionCol="pred", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True)
    if weight:
        forest = forest.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), forest]).fit(df)


def fit_gbt(df: DataFrame, features: list[str], label: str = "label", rounds: int = 300, depth: int = 10, rate: float = 0.05, share: float = 0.8, seed: int = 42, held: str | None = None, tol: float = 0.01, at_once: int = 3) -> PipelineModel:
    """Boosted trees, one model a class against the rest, ``at_once`` of them fitted side by side.

    With ``held``, a boolean column, rows where it is true are not fitted on: a class's rounds end where one more
    betters the loss on them by less than ``tol`` of it.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    rows = assembler.transform(df)
    classes = int(rows.agg(F.max(label)).first()[0]) + 1
    one = GBTClassifier(labelCol="_is", featuresCol="_features", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=share, featureSubsetStrategy=str(share), seed=seed, cacheNodeIds=True)
    if held:
        one = one.setValidationIndicatorCol(held).setParams(validationTol=tol)

    def fit(c: int):
        return one.fit(rows.withColumn("_is", (F.col(label) == c).cast("double")))

    with ThreadPoolExecutor(at_once) as pool:
        models = list(pool.map(inheritable_thread_target(df.sparkSession)(fit), range(classes)))
    return PipelineModel([assembler, OneVsRestModel(models).setFeaturesCol("_features").setPredictionCol("pred")])


def node_table(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """A fitted forest as a table of nodes: tree, node, feature, threshold, left, right, votes.

    A row goes left where its feature is at most the threshold; votes, NULL for inner nodes, are a leaf's share of
    each class. A row's class is that with the highest sum of votes over the trees, the lowest of equal ones. The
    nodes are read from the stored model, by tasks, so a forest of any size can be exported.
    """
    path = scratch(spark, "forest")
    model.stages[-1].write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    inner, total = F.col("leftChild") >= 0, F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    of = lambda c: F.when(inner, c)
    votes = F.when(~inner, F.transform("impurityStats", lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0))))
    return nodes.select("tree", F.col("id").alias("node"), of(F.col("split.featureIndex")).alias("feature"), of(F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"), of(F.col("leftChild")).alias("left"), of(F.col("rightChild")).alias("right"), votes.alias("votes"))


def walk(df: DataFrame, key: str, features: list[str], nodes: DataFrame, trees: int, depth: int, every: int = 4) -> DataFrame:
    """(key, votes, pred) by walking each row down each tree of a node table: one equi-join a level, stored after some levels."""
    spark = df.sparkSession
    at = df.select(key, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(0).alias("node"))
    inner = nodes.where("feature IS NOT NULL").select("tree", "node", "feature", "threshold", "left", "right")
    for level in range(1, depth + 1):
        step = F.when(F.get("_x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = at.join(inner, ["tree", "node"], "left").select(key, "_x", "tree", F.coalesce(F.when(F.col("feature").isNotNull(), step), "node").alias("node"))
        if level % every == 0:
            at.write.parquet(path := scratch(spark, "walk"))
            at = spark.read.schema(at.schema).parquet(path)
    votes = at.join(nodes.select("tree", "node", "votes"), ["tree", "node"]).select(key, F.posexplode("votes").alias("_k", "_v"))
    total = votes.groupBy(key, "_k").agg(F.sum("_v").alias("_v")).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_v"))), lambda x: x["_v"]).alias("votes"))
    return total.withColumn("pred", (F.array_position("votes", F.array_max("votes")) - 1).cast("int"))


def _importances(model: PipelineModel) -> list[tuple[int, float]]:
    last = model.stages[-1]
    parts = [m.featureImportances.toArray() for m in last.models] if hasattr(last, "models") else [last.featureImportances.toArray()]
    return [(i, float(v)) for i, v in enumerate(sum(parts) / len(parts))]


def predicted(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with pred as a whole number, without the model's vectors."""
    out = model.transform(df)
    return out.select(*df.columns, F.col("pred").cast("int").alias("pred"))


def cross_validate(df: DataFrame, features: list[str], fold: str, k: int, fit: Callable[[DataFrame], PipelineModel], at_once: int = 3) -> tuple[DataFrame, DataFrame]:
    """Each row's prediction by the model of the other folds, and (fold, feature, importance).

    The driver starts k fits, ``at_once`` of them side by side; ``df`` should be stored data. A fold whose other
    folds are empty gives no rows.
    """
    spark = df.sparkSession

    def one(i: int):
        train = df.where(F.col(fold) != i)
        return None if train.isEmpty() else fit(train)

    with ThreadPoolExecutor(at_once) as pool:
        models = list(pool.map(inheritable_thread_target(spark)(one), range(k)))
    preds = [predicted(m, df.where(F.col(fold) == i)) for i, m in enumerate(models) if m]
    found = [(i, *x) for i, m in enumerate(models) if m for x in _importances(m)]
    empty = df.limit(0).withColumn("pred", F.lit(None).cast("int"))
    return reduce(DataFrame.unionByName, preds, empty), spark.createDataFrame(found, f"fold int, {SCHEMA}")


def importances(model: PipelineModel, spark) -> DataFrame:
    """(feature, importance) of one model."""
    return spark.createDataFrame(_importances(model), SCHEMA)


def ranking(found: DataFrame, features: list[str], top: int | None = None) -> DataFrame:
    """Features by mean importance over the folds, the highest first; the first ``top`` only, where it is given."""
    name = F.element_at(F.array(*map(F.lit, features)), F.col("feature") + 1)
    mean = found.groupBy(name.alias("name")).agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "name")
    return mean if top is None else mean.limit(top)
