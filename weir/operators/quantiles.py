"""Exact quantiles of any number of points by selection, without ordering the rows.

Numbers are taken as 64-bit integers of the same order (the bits of a double, the
lower half turned round). A range of these is cut into bins of equal width; one
pass of Spark counts the rows of each bin and finds their least and greatest. The
bins that hold a wanted place become the next ranges, narrowed to what they
really hold, all points of all groups in one pass. Each pass takes bits off the
ranges, however skewed or tied the values are, so at most some eight passes
follow; a bin of one value, or few rows in all, end it sooner.

The driver holds ranges and counts for the wanted points, never rows: groups that
would be too many for it are ordered by ranges instead.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.operators.places import materialise, running

#: Bins of one pass over all ranges, values that are gathered to end the selection, and wanted points of all groups that the driver holds.
BINS, FEW, POINTS = 1 << 16, 1 << 16, 1 << 16
_TOP = np.uint64(1 << 63)


def ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; both zeros are one, NaN is the greatest."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    u = x.view(np.uint64)
    return np.where(u & _TOP, ~u, u | _TOP)


def number(u: int) -> float:
    """The double of an ordered integer."""
    bits = u & ~int(_TOP) if u >> 63 else ~u & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


class Ranges:
    """Disjoint ranges of (group, ordered integer), each cut into bins of equal width."""

    def __init__(self, ranges: list[tuple[int, int, int]], bins: int):
        self.of = {}
        each = max(2, bins // max(len(ranges), 1))
        for g, low, high in ranges:
            width = max(1, -(-(high - low + 1) // each))
            count = (high - low) // width + 1
            self.of.setdefault(g, []).append((low, high, width, count))
        base = 0
        self.places = {}
        for g, found in self.of.items():
            lows = np.array([f[0] for f in found], np.uint64)
            self.places[g] = (lows, np.array([f[1] for f in found], np.uint64), np.array([f[2] for f in found], np.uint64), base + np.cumsum([0, *[f[3] for f in found]])[:-1])
            base += sum(f[3] for f in found)

    def bins(self, group: int, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ordered integers of a group, those in a range: their positions and the numbers of their bins."""
        if group not in self.places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lows, highs, widths, bases = self.places[group]
        at = np.searchsorted(lows, u, side="right") - 1
        inside = np.flatnonzero((at >= 0) & (u <= highs[np.maximum(at, 0)]))
        at = at[inside]
        return inside, bases[at] + ((u[inside] - lows[at]) // widths[at]).astype(np.int64)


def _histogram(rows: DataFrame, ranges: Ranges) -> list[tuple[int, int, int, int, int]]:
    """group, bin, rows, least and greatest (ordered integers) of all bins that hold rows, in order."""
    shared = rows.sparkSession.sparkContext.broadcast(ranges)

    def run(batches):
        held: dict = {}
        for b in batches:
            groups, u = b.column(0).to_numpy(), ordered(b.column(1).to_numpy())
            for g in np.unique(groups).tolist():
                mine = u[groups == g]
                inside, at = shared.value.bins(g, mine)
                if not len(at):
                    continue
                order = np.lexsort((mine[inside], at))
                at, v = at[order], mine[inside][order]
                first = np.flatnonzero(np.diff(at, prepend=-1))
                last = np.append(first[1:], len(at)) - 1
                for k, n, a, z in zip(at[first].tolist(), (last - first + 1).tolist(), v[first].tolist(), v[last].tolist(), strict=True):
                    old = held.get((g, k))
                    held[g, k] = (n, a, z) if old is None else (old[0] + n, min(old[1], a), max(old[2], z))
        keys = list(held)
        signed = lambda x: x - (1 << 63)
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([held[k][0] for k in keys], pa.int64()),
            pa.array([signed(held[k][1]) for k in keys], pa.int64()), pa.array([signed(held[k][2]) for k in keys], pa.int64()),
        ], names=["g", "bin", "n", "least", "greatest"])

    bins = rows.mapInArrow(run, "g int, bin bigint, n bigint, least bigint, greatest bigint")
    found = bins.groupBy("g", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest")).collect()
    return sorted((r.g, r.bin, r.n, r.least + (1 << 63), r.greatest + (1 << 63)) for r in found)


def _few(rows: DataFrame, ranges: Ranges) -> list[tuple[int, int, int, int, int]]:
    """As `_histogram`, with a bin for each value: the last step, when few rows are left."""
    shared = rows.sparkSession.sparkContext.broadcast(ranges)

    def run(batches):
        for b in batches:
            groups, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            u, keep = ordered(v), []
            for g in np.unique(groups).tolist():
                mine = np.flatnonzero(groups == g)
                keep.append(mine[shared.value.bins(g, u[mine])[0]])
            at = pa.array(np.sort(np.concatenate(keep)) if keep else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["g", "v"])

    found = rows.mapInArrow(run, "g int, v double").groupBy("g", "v").agg(F.count("*").alias("n")).collect()
    u = ordered(np.array([r.v for r in found], np.float64)).tolist()
    return sorted((r.g, x, r.n, x, x) for r, x in zip(found, u, strict=True))


def select(rows: DataFrame, wanted: dict[int, list[int]], counts: dict[int, int], *, bins: int = BINS, few: int = FEW) -> dict[tuple[int, int], float]:
    """The value at each wanted place (from 0) of each group; `rows` has the group's number and a double."""
    left = {g: sorted(set(p)) for g, p in wanted.items() if p}
    # a range, how many rows lie below it, its places
    open_ = [((g, 0, (1 << 64) - 1), 0, places) for g, places in sorted(left.items())]
    out, inside = {}, sum(counts[g] for g in left)
    while open_:
        ranges = Ranges([r for r, _, _ in open_], bins)
        found = (_few if inside <= few else _histogram)(rows, ranges)
        by_group: dict = {}
        for f in found:
            by_group.setdefault(f[0], []).append(f)
        later, inside = [], 0
        leasts = {g: [f[3] for f in some] for g, some in by_group.items()}
        for (g, low, high), below, places in open_:
            mine = by_group[g][bisect_left(leasts[g], low) : bisect_right(leasts[g], high)]
            ends = (below + np.cumsum([f[2] for f in mine])).tolist()
            of: dict = {}
            for p in places:
                of.setdefault(bisect_right(ends, p), []).append(p)
            for i, some in of.items():
                _, _, n, least, greatest = mine[i]
                if least == greatest:
                    out |= {(g, p): number(least) for p in some}
                else:
                    later.append(((g, least, greatest), ends[i] - n, some))
                    inside += n
        open_ = later
    return out


def _points(points: list[float], n: int) -> list[tuple[int, int, float]]:
    """The places on both sides of each point of n rows, and how far it lies between them."""
    out = []
    for p in points:
        at = p * (n - 1)
        low = int(at)
        out.append((low, min(low + 1, n - 1), at - low))
    return out


def quantiles(df: DataFrame, value: str, points: list[float], by: str | None = None, *, most: int = POINTS, bins: int = BINS, few: int = FEW) -> DataFrame:
    """by, q: the quantiles of a number at all `points` (0 to 1) in each group, with linear interpolation; exact.

    Nulls are left out; a group without values has no row, without `by` there is
    one row, of nulls where there is no value. The null group is a group.
    """
    spark = df.sparkSession
    name = by or "_one"
    d = df.select((F.col(by) if by else F.lit(0)).alias(name), F.col(value).cast("double").alias("_v")).where("_v is not null")
    sizes = d.groupBy(name).agg(F.count("*").alias("_n"))
    schema = f"`{name}` {d.schema[name].dataType.simpleString()}, q array<double>"
    groups = sizes.limit(max(1, most // max(len(points), 1)) + 1).collect()
    if len(groups) * len(points) > most:
        return _by_order(d, sizes, name, points)
    if not groups:
        return spark.createDataFrame([] if by else [([None] * len(points),)], schema if by else "q array<double>")
    key = spark.createDataFrame([(g[0], i) for i, g in enumerate(groups)], f"_k {d.schema[name].dataType.simpleString()}, _g int")
    rows = d.join(F.broadcast(key), d[name].eqNullSafe(key["_k"])).select("_g", "_v") if by else d.select(F.lit(0).alias("_g"), "_v")
    counts = {i: g["_n"] for i, g in enumerate(groups)}
    between = {i: _points(points, n) for i, n in counts.items()}
    got = select(rows, {i: [p for x in b for p in x[:2]] for i, b in between.items()}, counts, bins=bins, few=few)
    out = [(groups[i][0], [got[i, a] + (got[i, z] - got[i, a]) * f if f and got[i, a] != got[i, z] else got[i, a] for a, z, f in b]) for i, b in between.items()]
    found = spark.createDataFrame(out, schema)
    return found if by else found.select("q")


def _by_order(d: DataFrame, sizes: DataFrame, name: str, points: list[float]) -> DataFrame:
    """As `quantiles`, for very many groups: values are counted, placed over ranges and met at the wanted places."""
    counted = d.groupBy(name, "_v").agg(F.count("*").alias("_m"))
    placed = running(counted, name, "_v", _upto="_m")
    whole = sizes.withColumn("_k", F.struct(name))
    # the running sum before a group: that of its first value, less its count
    first = placed.groupBy(name).agg(F.min(F.col("_upto") - F.col("_m")).alias("_before"))
    each = materialise(whole.join(first, whole[name].eqNullSafe(first[name])).select("_k", "_n", "_before"))
    at = F.col("_p") * (F.col("_n") - 1)
    wanted = each.select("_k", "_n", "_before", F.posexplode(F.array(*[F.lit(float(p)) for p in points])).alias("_i", "_p"))
    low = F.floor(at)
    wanted = wanted.select("_k", "_before", "_i", (at - low).alias("_f"), F.explode(F.array(F.struct(F.lit(0).alias("s"), low.alias("a")), F.struct(F.lit(1).alias("s"), F.least(low + 1, F.col("_n") - 1).alias("a")))).alias("_w"))
    # the wanted places are ordered among the values, by the place where a value ends
    ends = placed.select((F.col("_upto") - 1).alias("_at"), F.lit(1).alias("_kind"), "_v")
    asks = wanted.select((F.col("_before") + F.col("_w.a")).alias("_at"), F.lit(0).alias("_kind"), "_k", "_i", "_f", F.col("_w.s").alias("_s"))
    both = materialise(ends.unionByName(asks, allowMissingColumns=True).repartitionByRange("_at").withColumn("_part", F.spark_partition_id()))
    after = W.partitionBy("_part").orderBy("_at", "_kind").rowsBetween(0, W.unboundedFollowing)
    heads = both.where("_kind = 1").groupBy("_part").agg(F.min(F.struct("_at", "_v")).alias("_h"))
    later = F.first("_h", ignorenulls=True).over(W.orderBy("_part").rowsBetween(1, W.unboundedFollowing))
    parts = both.select("_part").distinct().join(heads, "_part", "left").select("_part", later.alias("_h"))  # a row for each range
    found = both.withColumn("_x", F.first("_v", ignorenulls=True).over(after)).where("_kind = 0").join(F.broadcast(parts), "_part", "left")
    value = F.coalesce("_x", F.col("_h._v"))
    low_high = found.groupBy("_k", "_i").agg(F.max("_f").alias("f"), F.min(F.when(F.col("_s") == 0, value)).alias("a"), F.min(F.when(F.col("_s") == 1, value)).alias("z"))
    q = F.when((F.col("f") == 0) | (F.col("a") == F.col("z")), F.col("a")).otherwise(F.col("a") + (F.col("z") - F.col("a")) * F.col("f"))
    return low_high.groupBy("_k").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", q.alias("q")))), lambda x: x["q"]).alias("q")).select(f"_k.{name}", "q")
