"""Tree ensembles as node tables (P1): no row-wise ML predictor at scoring time.

A fitted ensemble is the table (tree, node, feature, cut, left, right, value). A row goes left
where its feature is at most the cut, and a leaf leads to itself. To score, a small ensemble's
columns become array literals that a higher-order function walks; a larger one is loaded as a
``pyspark.ml`` forest, whose compiled walk takes a small part of the time. Both add the same
leaf values in the same order. Everything is model-sized and stays inside the JVM.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import keep_until_end, shared_dir

NODE_SCHEMA = ("tree int, node int, feature int, cut double, left int, right int, value double")
SMALL = 100  # nodes of an ensemble that is walked as literals

# the tables of a stored pyspark.ml forest
FOREST_NODES = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, "
                "rawCount bigint, gain double, leftChild int, rightChild int, split struct<featureIndex int, "
                "leftCategoriesOrThreshold array<double>, numCategories int>>")
FOREST_TREES = "_1 int, _2 string, _3 double"


@dataclass
class Ensemble:
    """Sum of the trees' leaf values times ``scale``, plus ``base``.

    ``nodes``: (tree, node, feature, cut, left, right, value) with node numbers 0 .. n - 1 inside a
    tree, node 0 the root and a leaf pointing to itself.
    """
    nodes: list[tuple]
    base: float = 0.0
    scale: float = 1.0

    def __post_init__(self):
        self.nodes = sorted(self.nodes)
        first: dict[int, int] = {}
        for i, n in enumerate(self.nodes):
            first.setdefault(n[0], i)
            if n[1] != i - first[n[0]]:
                raise ValueError(f"tree {n[0]}: node numbers are not 0, 1, 2 ...")
        self.first = first
        self._loaded: dict[str, object] = {}      # application -> forest

    @property
    def large(self) -> bool:
        return len(self.nodes) > SMALL

    def depth(self) -> int:
        """Steps after which every walk has reached a leaf."""
        deep: dict[int, int] = {}
        for i in reversed(range(len(self.nodes))):  # children stand after their parent
            tree, node, _, _, left, right, _ = self.nodes[i]
            at = self.first[tree]
            if left == node and right == node:
                deep[i] = 0
            elif left <= node or right <= node:
                raise ValueError(f"tree {tree}: node {node} has a child before it")
            else:
                deep[i] = 1 + max(deep[at + left], deep[at + right])
        return max((deep[i] for i in self.first.values()), default=0)

    def column(self, x: Column) -> Column:
        """The prediction for the feature array ``x`` (no nulls)."""
        if not self.nodes:
            return F.lit(float(self.base))
        at = [self.first[n[0]] for n in self.nodes]
        feature = _literal([n[2] for n in self.nodes], "int")
        cut = _literal([float(n[3]) for n in self.nodes], "double")
        left = _literal([a + n[4] for a, n in zip(at, self.nodes)], "int")
        right = _literal([a + n[5] for a, n in zip(at, self.nodes)], "int")
        value = _literal([float(n[6]) for n in self.nodes], "double")
        roots = _literal(list(self.first.values()), "int")
        steps = F.sequence(F.lit(1), F.lit(max(1, self.depth())))

        def leaf(row: Column, root: Column) -> Column:
            return F.aggregate(steps, root, lambda i, _: F.when(
                F.get(row, F.get(feature, i)) <= F.get(cut, i), F.get(left, i)).otherwise(F.get(right, i)))

        # the row's array is bound once and not built again at every node
        total = F.transform(F.array(x), lambda row: F.aggregate(
            roots, F.lit(0.0), lambda s, root: s + F.get(value, leaf(row, root))))
        return F.lit(float(self.base)) + F.get(total, 0) * F.lit(float(self.scale))

    def predicted(self, df: DataFrame, x: Column, out: str) -> DataFrame:
        """``df`` plus ``out``: the prediction for the feature array ``x`` (no nulls)."""
        if not self.large:
            return df.withColumn(out, self.column(x))
        from pyspark.ml.functions import array_to_vector
        forest, of = self.forest(df.sparkSession)
        walked = forest.setFeaturesCol("__x").setPredictionCol("__mean").transform(
            df.withColumn("__x", array_to_vector(x)))
        # the forest's mean is over a power of two, so its sum is exact
        total = F.col("__mean") * F.lit(float(of))
        return walked.withColumn(out, F.lit(float(self.base)) + total * F.lit(float(self.scale))).drop("__x", "__mean")

    def forest(self, spark: SparkSession):
        """The trees as a ``pyspark.ml`` forest, and the number of its trees: empty ones fill up a power of two."""
        from pyspark.ml.regression import RandomForestRegressionModel
        app = spark.sparkContext.applicationId
        if app not in self._loaded:
            number = {t: i for i, t in enumerate(self.first)}
            of = 1 << max(0, len(number) - 1).bit_length()
            stats, none = [1.0, 0.0, 0.0], (-1, [], -1)
            rows = []
            for t, n, feature, cut, left, right, value in self.nodes:
                leaf = left == n and right == n
                rows.append((number[t], (n, float(value), 0.0, stats, 1, -1.0 if leaf else 1.0, *(
                    (-1, -1, none) if leaf else (left, right, (feature, [float(cut)], -1))))))
            rows += [(i, (0, 0.0, 0.0, stats, 1, -1.0, -1, -1, none)) for i in range(len(number), of)]
            path = keep_until_end(spark, f"{shared_dir(spark)}/forests/{uuid.uuid4().hex}")

            def meta(kind: str, **more) -> str:
                return json.dumps({"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": 0,
                                   "sparkVersion": spark.version, "uid": f"{kind}_{uuid.uuid4().hex[:12]}",
                                   "paramMap": {"numTrees": of} if more else {},
                                   "defaultParamMap": {"impurity": "variance"}, **more})
            spark.createDataFrame(rows, FOREST_NODES, verifySchema=False).coalesce(1).write.parquet(f"{path}/data")
            spark.createDataFrame([(i, meta("DecisionTreeRegressionModel"), 1.0) for i in range(of)], FOREST_TREES) \
                .coalesce(1).write.parquet(f"{path}/treesMetadata")
            width = 1 + max(n[2] for n in self.nodes)
            spark.createDataFrame([(meta("RandomForestRegressionModel", numFeatures=width, numTrees=of),)], "value string") \
                .coalesce(1).write.text(f"{path}/metadata")
            self._loaded[app] = RandomForestRegressionModel.load(path), of
        return self._loaded[app]

    def predict_one(self, x: list[float]) -> float:
        """The same walk for a single row (for tests and reports)."""
        total = 0.0
        for tree, at in self.first.items():
            i = 0
            while True:
                _, node, feature, cut, left, right, value = self.nodes[at + i]
                if left == node and right == node:
                    total += value
                    break
                i = left if x[feature] <= cut else right
        return self.base + total * self.scale

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODE_SCHEMA)


def load_forests(models: Iterable, spark: SparkSession) -> int:
    """Load the large ensembles among ``models`` next to each other; returns their number."""
    large = [m for m in models if isinstance(m, Ensemble) and m.large]
    if large:
        with ThreadPoolExecutor(len(large)) as pool:
            list(pool.map(lambda m: m.forest(spark), large))
    return len(large)


def _literal(values: list, kind: str) -> Column:
    """An array literal from one text, which the optimizer folds."""
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast(f"array<{kind}>")


def linear(x: list[Column], weights: list[float], intercept: float) -> Column:
    """intercept + x . weights."""
    out = F.lit(float(intercept))
    for c, w in zip(x, weights):
        out = out + c * F.lit(float(w))
    return out
