"""The model families: least squares from one aggregate, random forests by MLlib."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.operators.scaling import Scaler
from tillcast.plans.wide_forest import TreeTable

# A direction with less than this share of the variance counts as linearly dependent;
# rounding leaves dependent ones near 1e-17.
DEPENDENT_SHARE = 1e-13
# Every part makes a histogram for each growing node, so parts cost nodes times parts: more of
# them than keep a cluster's cores busy come with this many rows each.
WIDE_PART, BUSY_PARTS = 1 << 18, 24
SEED = 42
INTERCEPT = "(intercept)"


@dataclass(frozen=True)
class ForestSettings:
    """Size of a forest. Depth is Spark's to limit: 30 at most."""

    trees: int
    depth: int
    bins: int
    # Histogram memory per task; more of it means fewer passes over the data.
    memory_mb: int = 1024
    # Rows are dealt to parts by key before the fit, one part for this many rows. Bootstrap
    # draws go by part and place, so the rows, this number and the seed fix the forest on
    # any cluster.
    rows_per_part: int = 4096
    # Groups of trees that grow side by side, each a forest of its own seed. A mart in one
    # part keeps one core busy; the groups share the others.
    groups: int = 1
    # Marts of more rows than this, if it is set, have wide parts, and only they have groups.
    # Their customer forests are tables of nodes: see wide_forest.
    wide_from: int | None = None
    # Features a split looks at, in MLlib's words.
    subset: str = "all"
    bootstrap: bool = True

    def parts(self, rows: int) -> int:
        """One for a mart of a few hundred rows, whose histograms would otherwise be made and
        shuffled many times over; parts of large marts grow, as do the cores that share them.
        Without bootstrap nothing is drawn by part, so the parts are the fewest that keep cores
        busy."""
        per_part = WIDE_PART if self.wide(rows) else self.rows_per_part
        parts = max(1, min(-(-rows // per_part), 1024 + rows // (100 * per_part)))
        return parts if self.bootstrap else min(parts, max(BUSY_PARTS, -(-rows // WIDE_PART)))

    def shares(self, rows: int) -> list[int]:
        """The trees of each group."""
        grouped = self.wide_from is None or self.wide(rows)
        groups = max(1, min(self.groups, self.trees)) if grouped else 1
        return [self.trees // groups + (i < self.trees % groups) for i in range(groups)]

    def wide(self, rows: int) -> bool:
        """Whether the mart has wide parts."""
        return self.wide_from is not None and rows > self.wide_from

    def told(self, rows: int) -> dict[str, str]:
        """The settings as they were used, to be stored with a model."""
        return {k: str(v) for k, v in {**asdict(self), "rows": rows, "parts": self.parts(rows)}.items()}


# Monthly and regional marts hold a few hundred rows at any fact size, so trees grow as
# deep as Spark allows, with a bin for each value.
REGRESSION_FOREST = ForestSettings(trees=200, depth=30, bins=1024, memory_mb=64, groups=4)
# The customer mart grows with the customers, and its trees with it: beyond a few tens of
# thousands of rows it has few wide parts, and groups of trees side by side keep the cores busy.
CUSTOMER_FOREST = ForestSettings(
    trees=100, depth=20, bins=32, groups=8, wide_from=1 << 16, subset="sqrt"
)


@dataclass(frozen=True)
class LinearModel:
    """Weights of standardised features, and the prediction where all of them are 0."""

    intercept: float
    weights: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``: one expression over the columns."""
        terms = [F.col(c) * F.lit(w) for c, w in self.weights.items()]
        return df.withColumn("prediction", sum(terms, F.lit(self.intercept)))

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(INTERCEPT, self.intercept), *self.weights.items()]
        return spark.createDataFrame(rows, WEIGHTS_SCHEMA).coalesce(1)

    @classmethod
    def from_df(cls, df: DataFrame) -> LinearModel:
        held = {r["column"]: r["weight"] for r in df.collect()}
        return cls(held.pop(INTERCEPT), held)


WEIGHTS_SCHEMA = "column string, weight double"


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population covariances of all pairs of columns, by one aggregate.

    Covariances are merged from each task's own means, so nothing cancels however far a
    column lies from zero.
    """
    x = F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    left = df.select(x).select("x", F.posexplode("x").alias("i", "a"))
    pairs = left.select("i", "a", F.posexplode("x").alias("j", "b")).filter("i <= j")
    found = pairs.groupBy("i", "j").agg(
        F.covar_pop("a", "b").alias("together"), F.avg("a").alias("mean")
    )
    mean, covariance = np.zeros(len(columns)), np.zeros((len(columns), len(columns)))
    for r in found.collect():
        covariance[r["i"], r["j"]] = covariance[r["j"], r["i"]] = r["together"]
        mean[r["i"]] = r["mean"]
    return mean, covariance


def fit_least_squares(
    train: DataFrame, features: Sequence[str], label: str
) -> tuple[Scaler, LinearModel]:
    """Ordinary least squares with intercept on standardised features.

    Year, month and month index are linearly dependent, and a short history can bring
    more such directions. Directions with no variance are left out of the solution of the
    normal equations, which makes it the minimum-norm one whatever the dependence is.
    """
    mean, covariance = moments(train, [*features, label])
    spread = np.sqrt(np.diag(covariance)[:-1])
    spread[spread == 0] = 1.0
    gram = covariance[:-1, :-1] / np.outer(spread, spread)
    size, direction = np.linalg.eigh(gram)
    used = size > DEPENDENT_SHARE * max(size.sum(), np.finfo(float).tiny)
    toward = direction[:, used]
    weights = toward @ ((toward.T @ (covariance[:-1, -1] / spread)) / size[used])
    scaler = Scaler({c: (float(m), float(s)) for c, m, s in zip(features, mean, spread, strict=False)})
    return scaler, LinearModel(float(mean[-1]), dict(zip(features, weights.tolist(), strict=True)))


def fit_forest_regression(
    train: DataFrame,
    columns: Sequence[str],
    label: str,
    settings: ForestSettings,
    keys: Sequence[str],
    rows: int,
) -> PipelineModel:
    """Every split looks at all features, every tree at a bootstrap sample.

    ``keys`` tell the ``rows`` rows apart and fix their order.
    """
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    assembled = _dealt(assembler.transform(train), label, settings.parts(rows), keys)
    shares = settings.shares(rows)
    groups = len(shares)
    outputs = [f"prediction_{i}" for i in range(groups)] if groups > 1 else ["prediction"]

    def grow(i: int) -> RandomForestRegressionModel:
        forest = RandomForestRegressor(
            labelCol=label,
            predictionCol=outputs[i],
            numTrees=shares[i],
            maxDepth=settings.depth,
            maxBins=settings.bins,
            featureSubsetStrategy=settings.subset,
            maxMemoryInMB=settings.memory_mb,
            bootstrap=settings.bootstrap,
            seed=SEED + i,
        )
        return forest.fit(assembled)

    forests = _side_by_side(train.sparkSession, grow, groups)
    if groups == 1:
        return PipelineModel([assembler, *forests])
    # The mean over all trees.
    total = " + ".join(f"{n} * {name}" for n, name in zip(shares, outputs, strict=True))
    mean = SQLTransformer(
        statement=f"SELECT * EXCEPT ({', '.join(outputs)}), ({total}) / {settings.trees} AS prediction "
        "FROM __THIS__"
    )
    return PipelineModel([assembler, *forests, mean])


def fit_forest_classification(
    train: DataFrame,
    columns: Sequence[str],
    label: str,
    settings: ForestSettings,
    keys: Sequence[str],
    rows: int,
) -> PipelineModel:
    """As above, for a label of 0 and 1. Two sibling leaves of the same class become one.

    A forest of one group gives ``probability``; of more, a column for each of them, whose mean
    over all trees :func:`positive_probability` takes.
    """
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    assembled = _dealt(assembler.transform(train), label, settings.parts(rows), keys)
    shares = settings.shares(rows)

    def grow(i: int) -> RandomForestClassificationModel:
        forest = RandomForestClassifier(
            labelCol=label,
            numTrees=shares[i],
            maxDepth=settings.depth,
            maxBins=settings.bins,
            featureSubsetStrategy=settings.subset,
            maxMemoryInMB=settings.memory_mb,
            bootstrap=settings.bootstrap,
            cacheNodeIds=True,
            seed=SEED + i,
        )
        if len(shares) > 1:
            forest.setProbabilityCol(f"probability_{i}").setRawPredictionCol("").setPredictionCol("")
        return forest.fit(assembled)

    return PipelineModel([assembler, *_side_by_side(train.sparkSession, grow, len(shares))])


def _side_by_side(spark: SparkSession, grow: Callable[[int], Model], groups: int) -> list[Model]:
    """``grow`` of each group, in threads of their own."""
    if groups == 1:
        return [grow(0)]
    with ThreadPoolExecutor(groups) as pool:
        return list(pool.map(inheritable_thread_target(spark)(grow), range(groups)))


def _dealt(df: DataFrame, label: str, parts: int, keys: Sequence[str]) -> DataFrame:
    """Rows in parts and an order that follow from their keys and values alone."""
    dealt = df.repartition(parts, *keys)
    return dealt.sortWithinPartitions(*keys, label, F.hash("features")).select("features", label)


def rounded_prediction() -> Column:
    return F.round("prediction", 2)


def positive_probability(predictor: PipelineModel | TreeTable) -> Column:
    """Probability of class 1: the mean over all trees of the predictor's forests."""
    if isinstance(predictor, TreeTable):
        return F.col("probability")
    forests = [m for m in predictor.stages if isinstance(m, RandomForestClassificationModel)]
    class_1 = [vector_to_array(m.getProbabilityCol())[1] for m in forests]
    if len(forests) == 1:
        return class_1[0]
    trees = [m.getNumTrees for m in forests]
    return sum(n * p for n, p in zip(trees, class_1, strict=True)) / sum(trees)


def above_half(probability: Column) -> Column:
    """Strictly above: a probability of exactly one half predicts 0."""
    return (probability > 0.5).cast("int")
