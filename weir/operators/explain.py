"""Shapley values of a trained forest: path-dependent, exact, in Arrow batches.

A leaf lies behind conditions on D different features. Of each the forest knows
the share z of training rows that pass (the product over its splits on the path),
a row whether it passes (o, 0 or 1). With the features in S known, the leaf is
reached with the product of o over S and of z over the others. The Shapley
weights |S|! (D - |S| - 1)! / D! are the integrals of t^|S| (1 - t)^(D - |S| - 1)
over [0, 1], so feature i's part in a leaf of value v is

    v (o_i - z_i) * integral of the product over j <> i of (t o_j + (1 - t) z_j) dt,

a polynomial of degree D - 1, which Gauss-Legendre quadrature with D / 2 points
gives exactly. All factors are positive: the product is a sum of logarithms, linear
in o, and is divided by one factor for each feature, of which o leaves two values.
So both steps are products of small matrices, nothing is enumerated.

A row's o depends only on the places of its values among the forest's thresholds.
Rows of equal places are one cell and have equal parts, which are found once a cell.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.operators.places import checkpoints, hot_join, materialise

#: Entries of one block of cells x leaves x features, and cells of one block and about one task.
ENTRIES, BLOCK, TASK = 1 << 19, 256, 512
#: Fixed value: features of a class in the report.
TOP = 10


def nodes_of(model) -> dict[int, dict[int, tuple]]:
    """For each tree its nodes by number: (feature, threshold, left, right, class counts); -1 marks a leaf.

    The model is written below the checkpoint folder and its nodes are read as a table.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    if "nodeData" in rows.columns:
        rows = rows.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        rows = rows.select(F.lit(0).alias("tree"), "*")
    fields = rows.select("tree", "id", "impurityStats", "leftChild", "rightChild", "split.featureIndex", "split.leftCategoriesOrThreshold", "split.numCategories").collect()
    out: dict = {}
    for r in fields:
        if r.leftChild >= 0 and r.numCategories != -1:
            raise ValueError("splits on categories are not explained")
        cut = r.leftCategoriesOrThreshold[0] if r.leftChild >= 0 else 0.0
        out.setdefault(r.tree, {})[r.id] = (r.featureIndex, cut, r.leftChild, r.rightChild, np.array(r.impurityStats))
    return out


class Paths:
    """All leaves of a forest: their conditions (low < x <= high on a feature), shares and values, padded to one width."""

    def __init__(self, trees: dict[int, dict[int, tuple]], features: int):
        found = []
        for nodes in trees.values():
            stack = [(0, {})]
            while stack:
                i, known = stack.pop()
                feature, cut, left, right, stats = nodes[i]
                if left < 0:
                    found.append((known, stats / stats.sum() / len(trees)))
                    continue
                for child, is_left in ((left, True), (right, False)):
                    low, high, share = known.get(feature, (-np.inf, np.inf, 1.0))
                    low, high = (low, min(high, cut)) if is_left else (max(low, cut), high)
                    stack.append((child, known | {feature: (low, high, share * nodes[child][4].sum() / stats.sum())}))
        found.sort(key=lambda f: len(f[0]))
        self.features, self.classes = features, len(found[0][1])
        self.cuts = [np.unique([x for k, _ in found if c in k for x in k[c][:2] if np.isfinite(x)]) for c in range(features)]
        self.groups = []
        sizes = np.array([len(k) for k, _ in found])
        for d in np.unique(sizes):
            some = [f for f, s in zip(found, sizes, strict=True) if s == d]
            values = np.array([v for _, v in some])
            # low < x <= high, as places among the cuts: -1 and their number stand for no bound
            table = [[(c, -1 if np.isinf(k[c][0]) else np.searchsorted(self.cuts[c], k[c][0]), np.searchsorted(self.cuts[c], k[c][1]), k[c][2]) for c in sorted(k)] for k, _ in some]
            table = np.array(table, np.float64).reshape(len(some), d, 4)
            self.groups.append((*[table[:, :, i].astype(np.int32) for i in range(3)], table[:, :, 3], values))
        self.base = sum((np.prod(g[3], axis=1)[:, None] * g[4]).sum(axis=0) for g in self.groups)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Rows x features: how many cuts of the feature are less than the value; of NaN all, as it goes right."""
        return np.column_stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(self.cuts)]).astype("<i4")

    def values(self, places: np.ndarray) -> np.ndarray:
        """Cells x classes x features."""
        rows = len(places)
        at = np.ascontiguousarray(places.T)
        out = np.zeros((self.features, self.classes, rows))
        for feature, low, high, share, value in self.groups:
            leaves, d = feature.shape
            if not d:
                continue
            t, w = np.polynomial.legendre.leggauss((d + 1) // 2)
            t, w = (t + 1) / 2, w / 2
            step = max(1, ENTRIES // (max(rows, 1) * d))
            for a in range(0, leaves, step):
                f, z, v = feature[a : a + step], share[a : a + step], value[a : a + step]
                x = at[f]
                o = (x > low[a : a + step, :, None]) & (x <= high[a : a + step, :, None])
                passed, failed = t + (1 - t) * z[:, :, None], (1 - t) * z[:, :, None]
                # leaves x points x cells: the product over all features
                product = np.log(passed / failed).transpose(0, 2, 1) @ o.astype(np.float64)
                product += np.log(failed).sum(axis=1)[:, :, None]
                np.exp(product, out=product)
                # (o - z) / factor is (1 - z) / passed, or -1 / (1 - t)
                part = np.where(o, (w * (1 - z[:, :, None]) / passed) @ product, ((-w / (1 - t)) @ product)[:, None])
                flat = f.ravel()
                order = np.argsort(flat, kind="stable")
                cut = np.flatnonzero(np.diff(flat[order], prepend=-1))
                part = part.reshape(-1, rows)
                for p, q in zip(cut, np.append(cut[1:], len(order)), strict=True):
                    columns = order[p:q]
                    out[flat[columns[0]]] += v[columns // d].T @ part[columns]
        return out.transpose(2, 1, 0)


def shap_cells(df: DataFrame, model, names: list[str], keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows (`keep`, cell) and cells (cell, n, base, shap): what `shap_values` says, once for all n rows of a cell."""
    paths = Paths(nodes_of(model), len(names))
    shared = df.sparkSession.sparkContext.broadcast(paths)
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]

    def place(batches):
        p = shared.value
        for b in batches:
            x = np.column_stack([b.column(f"_{i}").to_numpy(zero_copy_only=False) for i in range(len(names))])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array([r.tobytes() for r in p.places(x)], pa.binary())], names=[*keep, "cell"])

    def explain(batches):
        p = shared.value
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                got = p.values(np.frombuffer(b"".join(part.column("cell").to_pylist()), "<i4").reshape(part.num_rows, -1))
                flat = pa.array(got.ravel())
                inner = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, len(names), dtype=np.int32)), flat)
                outer = pa.ListArray.from_arrays(pa.array(np.arange(0, len(got) * p.classes + 1, p.classes, dtype=np.int32)), inner)
                yield pa.RecordBatch.from_arrays([part.column("cell"), part.column("n"), pa.array([p.base.tolist()] * len(got), pa.list_(pa.float64())), outer], names=["cell", "n", "base", "shap"])

    d = df.select(*keep, *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(f"_{i}") for i, c in enumerate(names)])
    rows = materialise(d.mapInArrow(place, ", ".join([*fields, "cell binary"])))
    cells = materialise(rows.groupBy("cell").agg(F.count("*").alias("n")))
    # little data and much work: tasks by the number of cells
    dealt = cells.repartition(cells.count() // TASK + 1, "cell")
    return rows, dealt.mapInArrow(explain, "cell binary, n bigint, base array<double>, shap array<array<double>>")


def to_rows(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """What was found for cells (cell, n, ...), for each of their rows."""
    found = materialise(cells)
    total = found.agg(F.sum("n")).first()[0] or 0
    return hot_join(rows, found, "cell", "n", total).drop("cell")


def shap_values(df: DataFrame, model, names: list[str], keep: tuple[str, ...]) -> DataFrame:
    """`keep`, `base` and `shap` of each row: the forest's mean answer by class, and for each class the features' parts.

    `model` is a trained MLlib forest or tree on the features `names`, in that
    order; base and parts add up to the probabilities it gives. Null features
    count as 0. The forest is broadcast: its size is set by trees and depth.
    """
    return to_rows(*shap_cells(df, model, names, keep))


def global_report(values: DataFrame, names: list[str], classes: list[str], top: int = TOP, n: str | None = None) -> DataFrame:
    """class, rank, name, mean_abs: the features of greatest mean absolute part for each class; each row counts `n` times."""
    one = values.select((F.col(n) if n else F.lit(1)).alias("n"), F.posexplode("shap").alias("c", "parts")).select("n", "c", F.posexplode("parts").alias("f", "v"))
    mean = one.groupBy("c", "f").agg((F.sum(F.abs("v") * F.col("n")) / F.sum("n")).alias("mean_abs"))  # a row for each class and feature
    label = lambda some, i: F.get(F.array(*[F.lit(s) for s in some]), i)
    named = mean.select(label(classes, F.col("c")).alias("class"), label(names, F.col("f")).alias("name"), "mean_abs")
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("class").orderBy(F.desc(F.round("mean_abs", 9)), "name"))
    return named.withColumn("rank", place).where(F.col("rank") <= top)


def strongest(values: DataFrame, names: list[str], classes: list[str], keep: tuple[str, ...], top: int = 5) -> DataFrame:
    """`keep`, predicted_class, confidence, features: the class of greatest probability and its `top` strongest parts (name, part), strongest first."""
    p = F.transform(F.sequence(F.lit(0), F.size("base") - 1), lambda i: F.get("base", i) + F.aggregate(F.get("shap", i), F.lit(0.0), lambda a, v: a + v))
    d = values.select(*keep, "shap", p.alias("_p")).withColumn("_c", F.array_position("_p", F.array_max("_p")).cast("int") - 1)
    name = F.array(*[F.lit(n) for n in names])
    parts = F.transform(F.get("shap", F.col("_c")), lambda v, i: F.struct((-F.abs(v)).alias("o"), F.get(name, i).alias("name"), v.alias("part")))
    best = F.transform(F.slice(F.array_sort(parts), 1, top), lambda s: F.struct(s["name"].alias("name"), s["part"].alias("part")))
    return d.select(*keep, F.get(F.array(*[F.lit(c) for c in classes]), F.col("_c")).alias("predicted_class"), F.array_max("_p").alias("confidence"), best.alias("features"))
