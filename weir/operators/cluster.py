"""Density clusters of anomalies by covers of cells, and the clusters' medoids."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.operators.places import checkpoints, hot_join, materialise

#: Radius and core size of the anomaly clusters.
EPS, MIN_SAMPLES = 2.5, 3
#: Candidates of a cluster in the first round of a medoid search and in any, and how many in all are broadcast.
FIRST, MOST, BROADCAST_PROBES = 16, 512, 100_000


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


#: Edges that one task joins by itself.
LOCAL = 1 << 20


def _united(batches):
    """The least id of each component of all edges of a task, by pointers that are followed to their ends."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    ids, at = np.unique(np.concatenate([np.concatenate(x) for x in zip(*held, strict=True)]), return_inverse=True)
    a, b = np.split(at, 2)
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            break
        # the greater root hangs on the least it meets
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "label"])


def connected(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """id, label: the least id of each connected component of edges (a, b), by rounds of least neighbours and jumps.

    Up to `local` edges are joined by one task. Labels of hubs and of large
    components reach their rows by a broadcast of the hot keys.
    """
    edges = materialise(edges.select(F.least("a", "b").cast("bigint").alias("a"), F.greatest("a", "b").cast("bigint").alias("b")).where("a < b").distinct())
    if edges.count() <= local:
        return edges.coalesce(1).mapInArrow(_united, "id bigint, label bigint")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    total = both.count()
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label"), F.count("*").alias("degree")).checkpoint()
    while True:
        heard = hot_join(both, labels.withColumnRenamed("id", "b"), "b", "degree", total).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("heard"))
        hooked = labels.join(heard, "id").select("id", "degree", F.col("label").alias("old"), F.least("label", "heard").alias("label")).checkpoint()
        jump = hooked.groupBy("old").agg(F.min("label").alias("best"), F.count("*").alias("n"))
        new = hot_join(hooked, jump, "old", "n", total).select("id", "degree", F.least("label", "best").alias("label"), (F.least("label", "best") < F.col("old")).alias("moved")).checkpoint()
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return labels.drop("degree")


#: Up to so many dimensions cells are those of a grid; beyond, balls, of so many at most, found by so many far points of each a pass.
GRID, BALLS, FAR = 3, 4096, 16
#: Points of one side of a comparison of two cells, and pairs of points up to which cells meet by a join.
SIDE, FEW = 20_000, 1024
#: Half the radius, with room for rounding.
HALF = 0.5 * (1 - 1e-12)


def _grid(d: DataFrame, eps: float, dim: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points with `cell`, the cells (cell, centre, radius), and pairs of cells a < b that may hold near points: a grid of cells of diameter eps."""
    side = eps * (1 - 1e-12) / dim**0.5
    points = d.withColumn("cell", F.transform("v", lambda x: F.floor(x / side)))
    cells = points.select("cell").distinct().select("cell", F.transform("cell", lambda c: (c + 0.5) * side).alias("centre"), F.lit(eps * HALF).alias("radius"))
    reach = int(dim**0.5) + 1
    steps = [o for o in product(range(-reach, reach + 1), repeat=dim) if o > (0,) * dim and sum(max(abs(x) - 1, 0) ** 2 for x in o) * side**2 <= eps**2]
    step = F.explode(F.array(*[F.array(*[F.lit(x).cast("bigint") for x in o]) for o in steps])).alias("o")
    moved = cells.select(F.col("cell").alias("a"), step).select("a", F.zip_with("a", "o", lambda x, y: x + y).alias("b"))
    return points, cells, moved.join(cells.select(F.col("cell").alias("b")), "b").select("a", "b")


def _balls(d: DataFrame, eps: float, dim: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As `_grid`: a cover by balls of radius eps / 2 around far points, as far as `most` of them go.

    The first ball is around the mean. A pass gives each point its nearest
    centre, and each ball that is too wide some of its far points, which become
    centres, if they are that far from each other too.
    """
    spark = d.sparkSession
    mean = d.select(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(dim)]).first()
    centres = np.array([list(mean)], np.float64)

    def assigned(centres: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast(centres)

        def run(batches):
            c = shared.value
            for b in batches:
                x = b.column("v").flatten().to_numpy().reshape(-1, dim)
                near, far = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
                for k in range(0, len(c), 256):
                    dist = np.sqrt(((x[:, None, :] - c[None, k : k + 256, :]) ** 2).sum(axis=2)) if len(x) * dim < 1 << 16 else _distances(x, c[k : k + 256])
                    at = dist.argmin(axis=1)
                    less = dist[np.arange(len(x)), at]
                    near, far = np.where(less < far, at + k, near), np.minimum(less, far)
                # the expansion above loses digits; the distance that counts is computed plainly
                far = np.sqrt(((x - c[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("n"), pa.array(near), pa.array(far)], names=["id", "v", "n", "_c", "_far"])

        return d.select("id", "v", "n").mapInArrow(run, "id bigint, v array<double>, n bigint, _c bigint, _far double")

    while True:
        points = assigned(centres)
        found = points.groupBy("_c", F.pmod(F.xxhash64("id"), F.lit(FAR)).alias("slot")).agg(F.max("_far").alias("far"), F.max_by("v", F.struct("_far", "id")).alias("v"), F.count("*").alias("n")).collect()
        radius, size = np.zeros(len(centres)), np.zeros(len(centres))
        for r in found:
            radius[r._c], size[r._c] = max(radius[r._c], r.far), size[r._c] + r.n
        wide = sorted((r for r in found if r.far > eps * HALF), key=lambda r: (-size[r._c], r._c, -r.far))
        new = []
        for r in wide:
            if len(centres) + len(new) >= most:
                break
            v = np.array(r.v)
            if all(((v - w) ** 2).sum() > (eps / 2) ** 2 for w in new):
                new.append(v)
        if not new:
            break
        centres = np.concatenate((centres, np.array(new)))
    points = points.withColumn("cell", F.array("_c")).drop("_c", "_far")
    held = size > 0
    cells = spark.createDataFrame([([int(k)], centres[k].tolist(), float(radius[k])) for k in np.flatnonzero(held)], "cell array<bigint>, centre array<double>, radius double")
    pairs = []
    for k in np.flatnonzero(held):
        gap = np.sqrt(((centres - centres[k]) ** 2).sum(axis=1))
        pairs += [([int(k)], [int(j)]) for j in np.flatnonzero(held & (gap <= (radius + radius[k] + eps) * (1 + 1e-12)) & (np.arange(len(centres)) > k))]
    return points, cells, spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T), 0))


def _near(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of x and y are at most eps apart, by plain differences."""
    out = np.zeros((len(x), len(y)), bool)
    step = max(1, (1 << 22) // max(1, len(y) * x.shape[1]))
    for k in range(0, len(x), step):
        out[k : k + step] = np.sqrt(((x[k : k + step, None, :] - y[None, :, :]) ** 2).sum(axis=2)) <= eps
    return out


def _met(points: DataFrame, info: DataFrame, pairs: DataFrame, eps: float, side: int) -> DataFrame:
    """x, y, wx, wy: nodes that lie near each other, and how many points of y lie near x and of x near y.

    A dense cell is one node, its least id, and meets another cell of its kind
    once: the first near pair ends the comparison. Only points within eps of the
    other cell's ball are compared. Cells of few points meet by joins; of others
    each pair is compared in one task, cut into blocks if they have very many.
    """
    about = lambda n: info.select(F.col("cell").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("centre", "radius", "dense", "rep", "members")])
    own = info.where("not dense").select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    every = materialise(pairs.unionByName(own).join(about("a"), "a").join(about("b"), "b"))
    few = F.col("members_a") * F.col("members_b") <= FEW
    known = every.where(~few)
    flat = lambda n: points.select(F.col("cell").alias(n), F.col("id").alias(f"id_{n}"), F.col("v").alias(f"v_{n}"), F.col("n").alias(f"n_{n}"))
    small = every.where(few).select("a", "b", "dense_a", "dense_b", "rep_a", "rep_b").join(flat("a"), "a").join(flat("b"), "b").where((F.col("a") != F.col("b")) | (F.col("id_a") < F.col("id_b")))
    node = lambda n: F.when(F.col(f"dense_{n}"), F.col(f"rep_{n}")).otherwise(F.col(f"id_{n}"))
    weight = lambda n, of: F.sum(F.when(F.col(f"dense_{n}"), 0).otherwise(F.col(f"n_{of}")))
    hits = small.where(distance(F.col("v_a"), F.col("v_b")) <= eps)
    by_join = hits.groupBy(node("a").alias("x"), node("b").alias("y")).agg(weight("a", "b").alias("wx"), weight("b", "a").alias("wy"))

    def half(me: str, other: str, k: int) -> DataFrame:
        blocks = lambda n: F.ceil(F.col(f"members_{n}") / side).cast("int")
        d = points.withColumnRenamed("cell", me).join(known, me).where(distance(F.col("v"), F.col(f"centre_{other}")) <= (F.col(f"radius_{other}") + eps) * (1 + 1e-12))
        mine = F.pmod(F.xxhash64("id"), blocks(me)).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), blocks(other) - 1))
        d = d.withColumn("_mine", mine).withColumn("_theirs", theirs)
        i, j = ("_mine", "_theirs") if k == 0 else ("_theirs", "_mine")
        return d.select("a", "b", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(k).alias("side"), "id", "v", "n", "dense_a", "dense_b", "rep_a", "rep_b")

    def compare(t: pa.Table) -> pa.Table:
        first = t.slice(0, 1).to_pylist()[0]
        is_left = t["side"].to_numpy() == 0
        v = t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        ids, n = t["id"].to_numpy(), t["n"].to_numpy()
        x, y, ix, iy, nx, ny = v[is_left], v[~is_left], ids[is_left], ids[~is_left], n[is_left], n[~is_left]
        out: list = []
        if len(x) and len(y):
            if first["dense_a"] and first["dense_b"]:
                # those nearest to the other side first
                x, y = x[np.argsort(((x - y.mean(axis=0)) ** 2).sum(axis=1))], y[np.argsort(((y - x.mean(axis=0)) ** 2).sum(axis=1))]
                if any(_near(x[p : p + 512], y[q : q + 512], eps).any() for p in range(0, len(x), 512) for q in range(0, len(y), 512)):
                    out = [(first["rep_a"], first["rep_b"], 0, 0)]
            else:
                for p in range(0, len(x), 512):
                    hit = _near(x[p : p + 512], y, eps)
                    if first["dense_a"]:
                        w = nx[p : p + 512] @ hit
                        out += [(first["rep_a"], int(iy[q]), 0, int(w[q])) for q in np.flatnonzero(w)]
                    elif first["dense_b"]:
                        w = hit @ ny
                        out += [(int(ix[p + q]), first["rep_b"], int(w[q]), 0) for q in np.flatnonzero(w)]
                    else:
                        rows, cols = np.nonzero(hit)
                        rows += p
                        if first["a"] == first["b"]:
                            rows, cols = rows[ix[rows] < iy[cols]], cols[ix[rows] < iy[cols]]
                        out += list(zip(ix[rows].tolist(), iy[cols].tolist(), ny[cols].tolist(), nx[rows].tolist(), strict=True))
        return pa.Table.from_pylist([dict(zip(("x", "y", "wx", "wy"), r, strict=True)) for r in out], schema=pa.schema([(c, pa.int64()) for c in ("x", "y", "wx", "wy")]))

    both = half("a", "b", 0).unionByName(half("b", "a", 1))
    return by_join.unionByName(both.groupBy("a", "b", "i", "j").applyInArrow(compare, "x bigint, y bigint, wx bigint, wy bigint"))


def dbscan(points: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES, *, grid: int = GRID, balls: int = BALLS, side: int = SIDE) -> DataFrame:
    """id, cluster: the least core id of the cluster, null for noise. A border point joins the least of its clusters.

    A point is core with `min_samples` points within `eps`, itself included.
    Space is covered by cells of diameter eps or less: a grid in few dimensions,
    else balls. A cell of `min_samples` points or more is dense: all its points
    are core and of one cluster, without a comparison. What is left are points of
    sparse cells, fewer than `min_samples` in each, and the borders of cells.
    Where `balls` do not cover all, the points of balls that are too wide are
    compared with each other, so many balls' worth at a time.

    Ids are whole numbers of their own. Points without a vector, with null or
    non-finite entries, or of another length than the longest, are noise.
    """
    checkpoints(points.sparkSession)
    every = points.select("id", F.col("v").cast("array<double>").alias("v"))
    dim = every.agg(F.max(F.size("v"))).first()[0] or 0
    fine = F.col("v").isNotNull() & (F.size("v") == dim) & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = every.where(fine).withColumn("v", F.transform("v", lambda x: x + 0.0))
    # equal points are one, however many
    distinct = materialise(usable.groupBy("v").agg(F.min(F.col("id").cast("bigint")).alias("id"), F.count("*").alias("n")))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    if not total:
        return every.select("id", F.lit(None).cast(every.schema["id"].dataType).alias("cluster"))
    cells_of = _grid(distinct, eps, dim) if dim <= grid else _balls(distinct, eps, dim, balls)
    assigned, cells, pairs = materialise(cells_of[0]), cells_of[1], cells_of[2]
    weights = assigned.groupBy("cell").agg(F.sum("n").alias("weight"), F.min("id").alias("rep"), F.count("*").alias("members"))
    info = materialise(cells.join(weights, "cell").withColumn("dense", (F.col("radius") <= eps * HALF) & (F.col("weight") >= min_samples)))
    near = materialise(_met(assigned, info, pairs, eps, side))
    both = near.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("wx").alias("w")).unionByName(near.select(F.col("y").alias("a"), F.col("x").alias("b"), F.col("wy").alias("w")))
    dense = info.where("dense").select("cell", "rep")
    loose = assigned.join(dense.select("cell"), "cell", "left_anti").select("id", "n")
    counted = loose.join(both.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("w")), "id", "left")
    core = materialise(counted.where(F.col("n") + F.coalesce("w", F.lit(0)) >= min_samples).select("id").unionByName(dense.select(F.col("rep").alias("id"))))
    linked = both.select("a", "b").join(core.withColumnRenamed("id", "a"), "a").join(core.withColumnRenamed("id", "b"), "b")
    grown = materialise(core.join(connected(linked), "id", "left").select("id", F.coalesce("label", "id").alias("cluster")))
    border = both.join(grown.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("near"))
    in_dense = assigned.join(dense.join(grown.withColumnRenamed("id", "rep"), "rep").select("cell", "cluster"), "cell").select("v", "n", "cluster")
    alone = loose.join(grown, "id", "left").join(border, "id", "left").select("id", F.coalesce("cluster", "near").alias("cluster"))
    in_loose = assigned.join(alone, "id").select("v", "n", "cluster")
    known = hot_join(usable, in_dense.unionByName(in_loose).select("v", "n", "cluster"), "v", "n", total).select("id", "cluster")
    return known.unionByName(every.where(~F.coalesce(fine, F.lit(False))).select("id", F.lit(None).cast("bigint").alias("cluster")))


def medoids(members: DataFrame) -> DataFrame:
    """cluster, id of the member with the least total distance to others; of equals the least id. Exact.

    Members are (cluster, id, v) with ids of their own; those without a vector
    or cluster are left out.
    """
    checkpoints(members.sparkSession)
    d = members.where("cluster is not null and v is not null").select("cluster", "id", "v")
    line = F.size("v") == 1
    if d.where(~line | F.col("v")[0].isNull() | F.isnan(F.col("v")[0].cast("double"))).isEmpty():
        return _medians(d.select("cluster", "id", F.col("v")[0].alias("x")))
    return _search(d)


def _medians(d: DataFrame) -> DataFrame:
    """Medoids on a line: the members at the middle places, whose totals are equal, by counts of ranges."""
    values = d.groupBy("cluster", "x").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    values = values.repartitionByRange("cluster", "x").withColumn("_part", F.spark_partition_id()).checkpoint()
    parts = values.groupBy("cluster", "_part").agg(F.sum("n").alias("m"))
    whole = W.partitionBy("cluster")
    parts = parts.select("cluster", "_part", "m", F.sum("m").over(whole).alias("all"), (F.sum("m").over(whole.orderBy("_part")) - F.col("m")).alias("before"))
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    middle = values.join(parts.where((F.col("before") <= high) & (F.col("before") + F.col("m") > low)), ["cluster", "_part"])
    upto = F.col("before") + F.sum("n").over(W.partitionBy("cluster", "_part").orderBy("x"))
    return middle.withColumn("upto", upto).where((F.col("upto") - F.col("n") <= high) & (F.col("upto") > low)).groupBy("cluster").agg(F.min("id").alias("medoid"))


def _search(d: DataFrame) -> DataFrame:
    """Medoids in any space: exact totals of a few candidates a round, until bounds leave none.

    By the triangle inequality a member at distance r from one of total t has a
    total of |t - size r| or more.
    """
    d = d.checkpoint()
    sizes = d.groupBy("cluster").agg(F.count("*").alias("n"))
    open_ = d.join(sizes, "cluster").withColumns({"low": F.lit(0.0), "best": F.lit(None).cast("double")}).checkpoint()
    known, batch = None, FIRST
    while known is None or not open_.isEmpty():
        slot = F.pmod(F.xxhash64("id"), F.lit(batch))
        chosen = F.min_by(F.struct("id", "v"), F.struct("low", "id")).alias("c")
        probe = open_.groupBy("cluster", slot.alias("slot")).agg(chosen).select("cluster", F.col("c.id").alias("cid"), F.col("c.v").alias("cv")).checkpoint()
        met = d.join(F.broadcast(probe) if probe.count() <= BROADCAST_PROBES else probe, "cluster")
        totals = met.groupBy("cluster", "cid", "cv").agg(F.sum(distance(F.col("v"), F.col("cv"))).alias("total")).checkpoint()
        known = totals.drop("cv") if known is None else known.unionByName(totals.drop("cv"))
        told = totals.groupBy("cluster").agg(F.collect_list(F.struct("cid", "cv", "total")).alias("told"), F.min("total").alias("least"))
        bound = F.aggregate("told", F.col("low"), lambda s, t: F.greatest(s, F.abs(t["total"] - F.col("n") * distance(F.col("v"), t["cv"]))))
        left = open_.join(told, "cluster").where(~F.exists("told", lambda t: t["cid"] == F.col("id")))
        left = left.withColumns({"low": bound, "best": F.least("best", "least")})
        open_ = left.where(F.col("low") <= F.col("best") * (1 + 1e-9) + 1e-8).drop("told", "least").checkpoint()
        batch = min(MOST, 2 * batch)
    return known.groupBy("cluster").agg(F.min_by("cid", F.struct(F.round("total", 9), F.col("cid"))).alias("medoid"))


def report(events: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster: size, mean score, counts of sources and classes; `members` has who they are.

    `events` has id, if_score, source_id, predicted_class. Noise is cluster null.
    """
    d = events.join(clusters, "id")
    base = d.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("if_score").alias("mean_score"))
    counts = lambda c: d.groupBy("cluster", c).count().groupBy("cluster").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "count")))).alias(f"{c}s"))
    out = base
    for c in ("source_id", "predicted_class"):
        m = counts(c).withColumnRenamed("cluster", "_c")
        out = out.join(m, out["cluster"].eqNullSafe(m["_c"]), "left").drop("_c")
    return out


def members(events: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, id: one row a member, so a cluster of any size is no one's array."""
    return clusters.join(events.select("id"), "id").where("cluster is not null").select("cluster", "id")
