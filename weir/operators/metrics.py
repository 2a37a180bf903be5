"""Evaluation by plain aggregation: confusion, precision and recall, AUC, thresholds, gates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.operators.places import hot_join, materialise, numbered, running
from weir.operators.quantiles import quantiles

#: Floors and ceilings of the model gate, and of the end-to-end gate.
MIN_F1, MIN_CLASSES, MIN_RECALL, MAX_FALSE_POSITIVES = 0.80, 3, 0.50, 0.06
MIN_DETECTION, MAX_BENIGN = 0.80, 0.20


def confusion(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    return df.groupBy(F.col(truth).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def class_report(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """label, precision, recall, f1, support of each class."""
    c = confusion(df, truth, predicted)
    true = c.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    said = c.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    r = true.join(said, "label", "full").fillna(0)
    p, q = ratio(F.col("hit"), F.col("said")), ratio(F.col("hit"), F.col("support"))
    return r.select("label", p.alias("precision"), q.alias("recall"), ratio(2 * p * q, p + q).alias("f1"), "support")


def summary(report: DataFrame) -> DataFrame:
    """Macro and weighted F1 of a class report."""
    return report.agg(F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), F.sum("support").alias("support"))


def auc(df: DataFrame, positive: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve by rank sums, ties counted half.

    Rows are counted by distinct score; negatives below a score come from running sums over ranges.
    """
    n = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive) == 1).alias("pos"), F.count_if(F.col(positive) == 0).alias("neg"))
    placed = running(n, "s", upto="neg").withColumn("won", F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    return placed.agg(ratio(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def auc_by_class(df: DataFrame, classes: tuple[str, ...], *, truth: str = "y", scores: str = "scores") -> DataFrame:
    """label, auc, positives, negatives of each class against all others; `scores` is an array in the order of `classes`.

    One pass counts rows by class and score, one table of running sums serves
    all classes; a class without positives or without negatives has auc 0.
    """
    each = df.select(F.col(truth).alias("y"), F.posexplode(F.transform(F.col(scores), lambda x: x.cast("double"))).alias("k", "s"))
    names = F.array(*[F.lit(c) for c in classes])
    n = each.select(F.get(names, F.col("k")).alias("label"), "y", "s").groupBy("label", "s").agg(F.count_if(F.col("y") == F.col("label")).alias("pos"), F.count_if(F.col("y") != F.col("label")).alias("neg"))
    placed = running(n, "label", "s", upto="neg")
    first = n.groupBy("label").agg(F.sum("neg").alias("all"))
    before = first.select("label", (F.sum("all").over(W.orderBy("label")) - F.col("all")).alias("before"))  # a row a class
    won = placed.join(F.broadcast(before), "label").withColumn("won", F.col("pos") * (F.col("upto") - F.col("before") - F.col("neg") / 2))
    return won.groupBy("label").agg(ratio(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def binary_rates(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    hit = lambda y, p: F.count_if((F.col(truth) == y) & (F.col(predicted) == p))
    c = df.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    return c.withColumns({"recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "fp_rate": ratio(F.col("fp"), F.col("fp") + F.col("tn"))})


def threshold_sweep(df: DataFrame, *, truth: str = "y", score: str = "score", points: int = 300) -> DataFrame:
    """Recall and false positive rate of `score < t` at linear thresholds between least and largest score.

    A row counts at the first threshold above it; sums over the few points do the rest.
    """
    low, high = df.agg(F.min(score), F.max(score)).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "point int, threshold double, recall double, fp_rate double")
    step = (high - low) / (points - 1) or 1.0
    at = F.greatest(F.lit(0), F.least(F.lit(points), F.floor((F.col(score) - low) / step) + 1))
    hist = df.groupBy(at.cast("int").alias("point")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    every = spark.range(points + 1).select(F.col("id").cast("int").alias("point")).join(F.broadcast(hist), "point", "left").fillna(0)
    upto = W.orderBy("point")
    total = W.partitionBy()
    rates = every.select("point", (F.lit(low) + F.col("point") * step).alias("threshold"), ratio(F.sum("pos").over(upto), F.sum("pos").over(total)).alias("recall"), ratio(F.sum("neg").over(upto), F.sum("neg").over(total)).alias("fp_rate"))
    return rates.where(F.col("point") < points)


def choose_threshold(sweep: DataFrame, min_recall: float = MIN_RECALL, max_fp: float = MAX_FALSE_POSITIVES) -> DataFrame:
    """The point of largest recall among those that meet both bounds; the smaller threshold on ties."""
    return sweep.where((F.col("recall") >= min_recall) & (F.col("fp_rate") <= max_fp)).orderBy(F.desc("recall"), "threshold").limit(1)


def metrics_gate(report: DataFrame, recall: float, fp_rate: float) -> DataFrame:
    good = F.count_if((F.col("f1") >= MIN_F1) & (F.col("label") != "benign"))
    return report.agg(good.alias("good_classes"), ((good >= MIN_CLASSES) & F.lit(recall >= MIN_RECALL) & F.lit(fp_rate <= MAX_FALSE_POSITIVES)).alias("passed"))


def detection_gate(events: DataFrame, expected: str = "label") -> DataFrame:
    rows = events.groupBy(expected).agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "block").alias("blocked")).withColumn("rate", F.col("blocked") / F.col("total"))
    return rows.withColumn("passed", F.when(F.col(expected) == "benign", F.col("rate") <= MAX_BENIGN).otherwise(F.col("rate") >= MIN_DETECTION))


def sole_dependency(df: DataFrame, feature: str, others: list[str]) -> DataFrame:
    """Percent of rows in which the feature is positive and all others of its group are 0."""
    alone = F.col(feature) > 0
    for c in others:
        alone = alone & (F.col(c) == 0)
    return df.agg(F.count("*").alias("rows"), F.count_if(alone).alias("alone")).withColumn("percent", ratio(100.0 * F.col("alone"), F.col("rows")))


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; 0 where that is 0."""
    s = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({c: (F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] or 1.0) for c in columns if s[f"m_{c}"] is not None})


def ranks(df: DataFrame, column: str) -> DataFrame:
    """column and `_rank`: the mean rank of each distinct value, by running counts over ranges."""
    counted = df.groupBy(column).agg(F.count("*").alias("_m"))
    return running(counted, column, _upto="_m").select(column, (F.col("_upto") - (F.col("_m") - 1) / 2).alias("_rank"), "_m")


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson's and Spearman's correlation of two columns; equal values share their mean rank."""
    d = materialise(df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL"))
    total = d.count()
    for c in ("a", "b"):
        d = hot_join(d, ranks(d, c).withColumnRenamed("_rank", f"r{c}"), c, "_m", total)
    return d.agg(F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("spearman"))


def quantile_sweep(df: DataFrame, *, truth: str = "y", score: str = "score", points: int = 300) -> DataFrame:
    """Recall and false positive rate of `score > t` at evenly spaced quantiles of the scores.

    The quantiles are selected, a further pass counts rows by the last threshold below them.
    """
    cuts = quantiles(df, score, [i / (points - 1) for i in range(points)]).first()[0]
    spark = df.sparkSession
    if cuts[0] is None:
        return spark.createDataFrame([], "point int, threshold double, recall double, fp_rate double")
    above = F.aggregate(F.array(*[F.lit(float(c)) for c in cuts]), F.lit(0), lambda n, c: n + (F.col(score) > c).cast("int"))
    hist = df.groupBy(above.alias("above")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    rows = spark.createDataFrame([(i, float(c)) for i, c in enumerate(cuts)], "point int, threshold double")
    total = hist.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    won = rows.join(F.broadcast(hist), F.col("above") > F.col("point"), "left").groupBy("point", "threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("neg"))
    return won.join(F.broadcast(total), F.lit(True)).select("point", "threshold", ratio(F.col("pos"), F.col("all_pos")).alias("recall"), ratio(F.col("neg"), F.col("all_neg")).alias("fp_rate"))


def parity(first: DataFrame, second: DataFrame, key: str, column: str, tolerance: float = 1e-5) -> DataFrame:
    """One row: rows of the first, those compared, the largest difference of a number column, and whether all agree within the tolerance."""
    b = second.select(key, F.col(column).alias("_b"))
    gap = F.abs(F.col(column) - F.col("_b"))
    out = first.select(key, column).join(b, key, "left").agg(F.count("*").alias("rows"), F.count("_b").alias("compared"), F.coalesce(F.max(gap), F.lit(0.0)).alias("largest"))
    return out.withColumn("passed", (F.col("rows") == F.col("compared")) & (F.col("largest") <= tolerance))


def parity_inputs(spark, rows: int = 100, width: int = 69, seed: int = 42) -> DataFrame:
    """id and `vector`: seeded uniform numbers in [0, 1), each from its row and place alone."""
    draw = lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return spark.range(rows).select("id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), draw).alias("vector"))


def benign_share(predicted: DataFrame, by: str = "file", label: str = "predicted_class") -> DataFrame:
    """by, n, pct_benign and the number of each predicted class: a sanity check on traffic that should be benign."""
    counts = predicted.groupBy(by, label).agg(F.count("*").alias("n"))
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(label), F.col("n")))))
    return counts.groupBy(by).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col(label) == "benign", F.col("n")).otherwise(0)) / F.sum("n")).alias("pct_benign"), pairs.alias("classes"))


def feistel(places: np.ndarray, n: int, key: int) -> np.ndarray:
    """A seeded permutation of 0 .. n - 1 at the given places, each from its place alone.

    Four Feistel rounds permute the least square of a power of two that holds n;
    what falls outside walks on until it is inside.
    """
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            f = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 0x100000001B3 + r * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
            f = (f ^ (f >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(29))) & mask)
        return (left << np.uint64(half)) | right

    out = once(places.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def permutation_importance(df: DataFrame, names: list[str], predict, *, truth: str = "y", id_col: str = "id", repeats: int = 10, seed: int = 42) -> DataFrame:
    """name, mean and std of the loss of macro F1 when a feature's values are dealt to other rows.

    `predict(df)` adds the column p, by each row's features alone. Rows are
    numbered and predicted once. Repeat k gives the row at a place the values of
    the row at another one, by a seeded permutation of places that no order has to
    find; all features and repeats are one job: each row meets its donor once a
    repeat, and goes to `predict` once for each feature whose value that changes.
    All others keep their prediction.
    """
    spark = df.sparkSession
    width = len(names)
    placed = materialise(numbered(df, F.xxhash64(F.lit(seed), F.col(id_col)), id_col, name="_at", first=0).select("_at", F.col(truth).alias("_y"), F.array(*[F.col(c).cast("double") for c in names]).alias("_own")))
    n = placed.count()

    def deal(batches):
        for b in batches:
            at = b.column(0).to_numpy()
            for k in range(repeats):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(at), k, np.int32)), pa.array(feistel(at, n, seed * 1_000_003 + k))], names=["_at", "_k", "_from"])

    dealt = placed.select("_at").mapInArrow(deal, "_at bigint, _k int, _from bigint")
    cells = lambda x: [F.col(x)[i].alias(c) for i, c in enumerate(names)]
    known = materialise(predict(placed.select("_at", F.col("_y").alias(truth), "_own", *cells("_own"))).select("_at", F.col(truth).alias("_y"), F.col("p").alias("_was"), "_own"))
    met = dealt.join(known, "_at").join(known.select(F.col("_at").alias("_from"), F.col("_own").alias("_z")), "_from")
    differs = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: ~F.get("_own", i).eqNullSafe(F.get("_z", i)))
    one = met.select("_k", "_y", "_was", "_own", "_z", F.explode(differs).alias("_f"))
    moved = one.select("_k", "_f", F.col("_y").alias(truth), "_was", *[F.when(F.col("_f") == i, F.col("_z")[i]).otherwise(F.col("_own")[i]).alias(c) for i, c in enumerate(names)])
    changed = materialise(predict(moved).groupBy("_k", "_f", F.col(truth).alias("y"), "_was", "p").agg(F.count("*").alias("n")))
    # of each feature and repeat: all rows as they are, less those that changed, and these as they are now
    as_is = known.groupBy(F.col("_y").alias("y"), F.col("_was").alias("p")).agg(F.count("*").alias("n"))
    each = changed.select("_k", "_f").distinct().unionByName(spark.createDataFrame([(-1, -1)], "_k int, _f int"))
    every = each.crossJoin(F.broadcast(as_is)).unionByName(changed.select("_k", "_f", "y", "p", "n")).unionByName(changed.select("_k", "_f", "y", F.col("_was").alias("p"), (-F.col("n")).alias("n")))
    n_each = every.groupBy("_k", "_f", "y", "p").agg(F.sum("n").alias("n")).where("n > 0")
    # from here a row for each class, feature and repeat
    key = ["_k", "_f"]
    true = n_each.groupBy(*key, F.col("y").cast("string").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    said = n_each.groupBy(*key, F.col("p").cast("string").alias("label")).agg(F.sum("n").alias("said"))
    f1 = ratio(2 * F.col("hit"), F.col("said") + F.col("support"))
    scores = true.join(said, [*key, "label"], "full").fillna(0).groupBy(*key).agg(F.avg(f1).alias("f1")).collect()
    got = {(r._f, r._k): r.f1 for r in scores}
    base, rows = got.get((-1, -1), 0.0), []
    for i, name in enumerate(names):
        lost = [base - got.get((i, k), base) for k in range(repeats)]
        mean = sum(lost) / len(lost)
        rows.append((name, mean, (sum((x - mean) ** 2 for x in lost) / len(lost)) ** 0.5))
    return spark.createDataFrame(rows, "name string, mean double, std double")


def override_sweep(df: DataFrame, overrides: DataFrame, predict, *, names: list[str]) -> DataFrame:
    """Each row under each override (variant, and values of some of `names`, null: as it is), rescored by predict(df)."""
    new = overrides.select("variant", *[F.col(n).alias(f"_{n}") for n in names])
    wide = df.crossJoin(F.broadcast(new))  # a stated handful of variants
    return predict(wide.withColumns({n: F.coalesce(F.col(f"_{n}"), F.col(n)) for n in names}).drop(*[f"_{n}" for n in names]))


def comparison(results: dict[str, dict], spark) -> DataFrame:
    """model, kind, quality, p95_ms, size of the models' result records, for a report."""
    rows = []
    for model, r in sorted(results.items()):
        quality = f"macro F1 {r['macro_f1']:.4f}" if "macro_f1" in r else f"recall {r['recall']:.4f}, false positives {r['fp_rate']:.4f}"
        n = r.get("size_bytes", 0)
        rows.append((model, "supervised" if "macro_f1" in r else "unsupervised", quality, r.get("p95_ms"), f"{n / 1024:.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.2f} MB"))
    return spark.createDataFrame(rows, "model string, kind string, quality string, p95_ms double, size string")
