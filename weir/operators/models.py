"""Models on feature columns: a random forest and simpler baselines of MLlib, and an isolation forest."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.operators.corpus import MIN_SOURCE_ROWS
from weir.operators.places import materialise

# Sizes of the published models.
FOREST_TREES, FOREST_DEPTH = 30, 25
ISOLATION_TREES, ISOLATION_SAMPLES, CONTAMINATION = 200, 4096, 0.05


def classifier(kind: str = "forest", names: list[str] | None = None, label: str = "label", seed: int = 42, trees: int = FOREST_TREES, depth: int = FOREST_DEPTH) -> Pipeline:
    """An untrained pipeline: forest, tree or logistic, on rows weighted by `weight`."""
    common = {"featuresCol": "_x", "labelCol": "_y", "weightCol": "weight"}
    model = {
        "forest": lambda: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **common),
        "tree": lambda: DecisionTreeClassifier(maxDepth=10, seed=seed, **common),
        "logistic": lambda: LogisticRegression(maxIter=100, **common),
    }[kind]()
    steps = [StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=names, outputCol="_raw" if kind == "logistic" else "_x")]
    if kind == "logistic":
        steps.append(StandardScaler(inputCol="_raw", outputCol="_x", withMean=True))
    return Pipeline(stages=[*steps, model])


#: Hidden layers of the network, and the width of the narrow layer of the reconstruction.
HIDDEN, NARROW = (64, 32), 8


def network(names: list[str], classes: int, label: str = "label", seed: int = 42, hidden: tuple[int, ...] = HIDDEN, steps: int = 200) -> Pipeline:
    """An untrained multilayer perceptron on standardised features; MLlib's has sigmoid layers and no row weights."""
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=names, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
        MultilayerPerceptronClassifier(layers=[len(names), *hidden, classes], featuresCol="_x", labelCol="_y", seed=seed, maxIter=steps),
    ])


class Reconstruction:
    """Anomaly scores by the error of a narrow linear reconstruction (principal components) of standardised features.

    The linear counterpart of an autoencoder with one narrow layer: learnt from
    benign rows, it rebuilds what looks like them; the mean squared error of the
    rest is large.
    """

    def __init__(self, names: list[str], narrow: int = NARROW):
        self.names, self.narrow = names, min(narrow, len(names))

    def fit(self, df: DataFrame) -> Reconstruction:
        steps = [VectorAssembler(inputCols=self.names, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), PCA(k=self.narrow, inputCol="_x", outputCol="_z")]
        model = Pipeline(stages=steps).fit(df.fillna(0.0, self.names))
        self.mean, std = model.stages[1].mean.toArray(), model.stages[1].std.toArray()
        self.std = np.where(std > 0, std, 1.0)
        self.axes = model.stages[2].pc.toArray()
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.std
        return ((z - z @ self.axes @ self.axes.T) ** 2).mean(axis=1)

    def transform(self, df: DataFrame, keep: tuple[str, ...], out: str = "error") -> DataFrame:
        """The columns in `keep` and the error of each row."""
        return scored_rows(df, self.names, keep, self.score, out)


def scored_rows(df: DataFrame, names: list[str], keep: tuple[str, ...], score, out: str) -> DataFrame:
    """`keep` and score(matrix of the columns `names`, nulls 0) of each row, in Arrow batches."""
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    model = df.sparkSession.sparkContext.broadcast(score)

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(f"_{i}").to_numpy(zero_copy_only=False) for i in range(len(names))]) if b.num_rows else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(model.value(x))], names=[*keep, out])

    d = df.select(*keep, *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(f"_{i}") for i, c in enumerate(names)])
    return d.mapInArrow(run, ", ".join([*fields, f"`{out}` double"]))


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """`weight` by which all classes weigh alike."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    total, classes = n.agg(F.sum("_n"), F.count("*")).first()
    return df.join(F.broadcast(n), label).withColumn("weight", F.lit(float(total or 0)) / (F.lit(classes) * F.col("_n"))).drop("_n")


class IsolationForest:
    """Isolation trees (Liu et al. 2008) built in tasks from one bounded sample.

    `fit` draws `samples` * 4 rows at most by a seeded hash of their id; tree t
    takes `samples` of them. Scores are those of the paper less the offset, the
    quantile `contamination` of the sample's: negative for anomalies.
    """

    def __init__(self, names: list[str], trees: int = ISOLATION_TREES, samples: int = ISOLATION_SAMPLES, contamination: float = CONTAMINATION, seed: int = 42):
        self.names, self.trees, self.samples, self.contamination, self.seed = names, trees, samples, contamination, seed

    def fit(self, df: DataFrame, id_col: str) -> IsolationForest:
        spark = df.sparkSession
        rows = df.orderBy(F.xxhash64(F.lit(self.seed), id_col), id_col).limit(4 * self.samples).select(*[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in self.names])
        x = rows.toPandas().to_numpy(np.float64)
        if not len(x):
            raise ValueError("no rows to learn from")
        size = min(self.samples, len(x))
        shared = spark.sparkContext.broadcast(x)
        seed, depth = self.seed, max(1, int(np.ceil(np.log2(max(size, 2)))))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for t in pdf["id"]:
                rng = np.random.default_rng([seed, int(t)])
                data = shared.value[rng.choice(len(shared.value), size, replace=False)]
                out.append((int(t), *grow(data, depth, rng)))
            return pd.DataFrame(out, columns=["tree", "feature", "cut", "low", "high", "path"])

        schema = "tree int, feature array<int>, cut array<double>, low array<int>, high array<int>, path array<double>"
        built = spark.range(self.trees, numPartitions=min(self.trees, 16)).mapInPandas(lambda it: (build(p) for p in it), schema).orderBy("tree").collect()
        self.nodes = [tuple(np.array(r[c]) for c in ("feature", "cut", "low", "high", "path")) for r in built]
        self.norm = average_path(size)
        self.offset = 0.0
        self.offset = float(np.quantile(self.score(x), self.contamination))
        return self

    def save(self, spark, path: str) -> None:
        """The trees as a table, a row a tree, with what scoring needs beside them."""
        rows = [(t, *[a.tolist() for a in n], float(self.norm), float(self.offset)) for t, n in enumerate(self.nodes)]
        spark.createDataFrame(rows, "tree int, feature array<int>, cut array<double>, low array<int>, high array<int>, path array<double>, norm double, offset double").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str, names: list[str]) -> IsolationForest:
        """A saved forest on the features `names`."""
        rows = spark.read.parquet(path).orderBy("tree").collect()  # as many as trees
        out = cls(names, trees=len(rows))
        out.nodes = [tuple(np.array(r[c]) for c in ("feature", "cut", "low", "high", "path")) for r in rows]
        out.norm, out.offset = rows[0].norm, rows[0].offset
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, low, high, path in self.nodes:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                k = np.flatnonzero(inner)
                n = at[k]
                at[k] = np.where(x[k, feature[n]] < cut[n], low[n], high[n])
            total += path[at]
        return -(2.0 ** (-total / (len(self.nodes) * self.norm))) - self.offset

    def transform(self, df: DataFrame, keep: tuple[str, ...], out: str = "if_score") -> DataFrame:
        """The columns in `keep` and the decision value of each row."""
        return scored_rows(df, self.names, keep, self.score, out)


def average_path(n: int) -> float:
    """The mean path length of an unsuccessful search among n."""
    return 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else float(n == 2)


def grow(x: np.ndarray, depth: int, rng) -> tuple[list, list, list, list, list]:
    """One tree as parallel arrays: feature (-1: leaf), cut, children, path length of leaves."""
    feature, cut, low, high, path = [], [], [], [], []
    queue = [(np.arange(len(x)), 0, -1, False)]
    while queue:
        rows, level, parent, right = queue.pop()
        i = len(feature)
        if parent >= 0:
            (high if right else low)[parent] = i
        part = x[rows]
        span = part.max(axis=0) - part.min(axis=0)
        able = np.flatnonzero(span > 0)
        if level >= depth or len(rows) < 2 or not len(able):
            for a, v in zip((feature, cut, low, high, path), (-1, 0.0, -1, -1, level + average_path(len(rows))), strict=True):
                a.append(v)
            continue
        f = int(rng.choice(able))
        c = float(part[:, f].min() + rng.random() * span[f]) or np.nextafter(0.0, 1.0)
        for a, v in zip((feature, cut, low, high, path), (f, c, -1, -1, 0.0), strict=True):
            a.append(v)
        left = part[:, f] < c
        queue += [(rows[left], level + 1, i, False), (rows[~left], level + 1, i, True)] if left.any() and not left.all() else []
        if left.all() or not left.any():
            feature[i], path[i] = -1, level + average_path(len(rows))
    return feature, cut, low, high, path


#: Fixed value: features of less importance are candidates for removal.
MIN_IMPORTANCE = 0.001


def importances(model, names: list[str], spark) -> DataFrame:
    """name, importance and prune of each feature of a trained tree or forest pipeline."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = spark.createDataFrame(list(zip(names, values, strict=True)), "name string, importance double")
    return rows.withColumn("prune", F.col("importance") < MIN_IMPORTANCE)


#: Folds that are trained at a time, and how many there may be: each is a training of its own.
PARALLEL, MOST_FOLDS = 4, 256


def leave_one_source_out(df: DataFrame, names: list[str], *, source: str = "_source", label: str = "label", kind: str = "forest", trees: int = FOREST_TREES, depth: int = FOREST_DEPTH, seed: int = 42, least: int | None = None) -> DataFrame:
    """source, rows, macro_f1, f1 (class to F1 and support): each source predicted by a model of all others.

    Rows are read once and kept as blocks of one table; a fold trains on all of
    it but its source, with classes weighed alike among what is left, several
    folds at a time. Sources of fewer than `least` rows are not held out; more
    than `MOST_FOLDS` are an error. Classes are those of the held-out rows; a
    class that the fold's model never saw has F1 0.
    """
    spark = df.sparkSession
    least = MIN_SOURCE_ROWS if least is None else least
    rows = materialise(df.where(F.col(source).isNotNull() & F.col(label).isNotNull()).select(source, label, *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in names]))
    sources = [r[0] for r in rows.groupBy(source).count().where(F.col("count") >= least).orderBy(source).limit(MOST_FOLDS + 1).collect()]
    if len(sources) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} sources to hold out")

    def fold(held: str) -> tuple:
        train, test = balanced(rows.where(F.col(source) != held), label), rows.where(F.col(source) == held)
        model = classifier(kind, names, label, seed, trees, depth).fit(train)
        known = F.array(*[F.lit(x) for x in model.stages[0].labelsArray[0]])
        # rows of a class that was not learnt cannot be indexed; they are predicted all the same
        said = test
        for stage in model.stages[1:]:
            said = stage.transform(said)
        n = said.select(F.col(label).alias("y"), F.get(known, F.col("prediction").cast("int")).alias("p")).groupBy("y", "p").count().collect()
        classes = sorted({r.y for r in n})
        hit = {c: sum(r["count"] for r in n if r.y == c == r.p) for c in classes}
        support = {c: sum(r["count"] for r in n if r.y == c) for c in classes}
        told = {c: sum(r["count"] for r in n if r.p == c) for c in classes}
        f1 = {c: 2.0 * hit[c] / (support[c] + told[c]) for c in classes}
        return held, sum(support.values()), sum(f1.values()) / len(f1), {c: (f1[c], support[c]) for c in classes}

    with ThreadPool(min(PARALLEL, max(len(sources), 1))) as pool:
        found = pool.map(inheritable_thread_target(spark)(fold), sources)
    return spark.createDataFrame(found, f"`{source}` string, rows bigint, macro_f1 double, f1 map<string, struct<f1: double, support: bigint>>")
