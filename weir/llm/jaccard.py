"""N-gram Jaccard join (operator 4): pivots, Voronoi regions, triangle windows.

The Jaccard distance of shingle sets is a metric. Documents become hashed
shingle sets; equal sets are one node. The join then runs in these steps, all
exact:

1. Nodes that can link share a shingle among their rarest ones (any common
   order of the shingles gives that guarantee; here a fixed-size table of
   counts, summed over all documents, puts rare ones first). Those entries are
   dealt by shingle as packed arrays. In each group, and in each run of set
   sizes that are compatible, the node of the smallest signature is the pivot,
   and the run is laid into the pivot's region.
   A fixed histogram of each set's shingles bounds symmetric differences from
   below; members that it keeps from all others of a small region go.
2. A region of at most `local` members is joined within one task: all distances
   to its pivot are computed; members within the radius are the pivot's cell and
   linked to it. By the triangle inequality a member of the cell can only link
   to one outside if their distances to the pivot differ by the radius at most:
   such boundary members are replicated into the region of the rest, which is
   joined again with its own pivot, and so on until nothing is left.
3. A larger region has several pivots. Its members, in slices of bounded size,
   get their distances to all of them; cells that share a member are connected,
   and the largest connected group needs no comparison within. Only the rest is
   left: it is divided into the Voronoi regions of the pivots, and by triangle
   windows each of these gets the members that may link to one of its own. Both
   sides come in pieces of bounded size.
4. Links give components by label propagation.

Within a cell no pair is compared or emitted: all are in one component through
the pivot. So a few pivots settle thousands of near copies, and no region is
ever collected as a whole unless it is small.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.llm.common import chunks, dealt, hot_join, joined, materialise, mix, table, text_bytes, word_hashes, words_sql
from weir.llm.substring import _ROLL, rolling

SHINGLE, PERCENT = 5, 80
#: Counters of the rarity table (4 bytes each, sent to every task).
CELLS = 1 << 20
SLICES = 16
#: A region of at most so many members is joined within one task.
LOCAL = 256
#: A shingle whose counter exceeds this, and so many times the mean, is a region of its own and not dealt.
HOT, HOT_MEANS = 1 << 16, 16
#: Pivots of a larger region.
CENTRES = 32
PART_BYTES = 32 << 20
#: Up to so many nodes whose sets are wanted (16 bytes each) are sent to every executor.
BROADCAST_NODES = 1_000_000

_SIGN = np.uint64(0x8EBC6AF09C88C6E3)


def shingle_sets(texts: pa.Array, width: int):
    """The sorted distinct 64-bit shingles of each text, in order.

    A-Z are lower-cased. A text of fewer words than `width` has its whole
    sequence as its one shingle, a text without words none.
    """
    for _, data, offsets in chunks(texts):
        starts, _, hashes = word_hashes(np.frombuffer(data.lower(), np.uint8))
        bound = np.searchsorted(starts, offsets)
        roll = rolling(hashes, width, _ROLL)
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            if b - a >= width:
                yield np.unique(roll[a : b - width + 1])
            elif b > a:
                yield mix(rolling(hashes[a:b], b - a, _ROLL) + np.uint64(b - a))
            else:
                yield hashes[:0]


def signature(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of the set."""
    return int(mix(shingles ^ _SIGN).sum().view(np.int64)) if len(shingles) else 0


def cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def nodes(docs: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds: id, signature, n of every document; slice, counts of every task's rarity table."""

    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            sign, n = [], []
            for s in shingle_sets(batch.column(1), width):
                sign.append(signature(s) if len(s) else None)
                n.append(len(s))
                if len(s):
                    np.add.at(counts, cell(s), 1)
            size = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sign, pa.int64()), pa.array(n, pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], schema=schema)
        for k, part in enumerate(np.split(np.minimum(counts, 2**31 - 1).astype(np.int32), SLICES)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema=schema)

    schema = pa.schema([("id", pa.int64()), ("sign", pa.int64()), ("n", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])
    return docs.select("id", "text").mapInArrow(run, "id bigint, sign bigint, n bigint, slice int, counts binary")


def rarity(counted: DataFrame) -> np.ndarray:
    """The summed table of counts, a fixed 4 MB.

    Every task has a table of its own, so they are added in two levels: about the
    square root of their number come to one task of the first, and as many again
    to one of the second.
    """

    def add(batches):
        total: dict = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(blob, np.int32).astype(np.int64)
                total[k] = total[k] + x if k in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    tables = counted.where("slice is not null").select("slice", "counts")
    fan = math.isqrt(tables.count() // SLICES)
    if fan > 1:
        tables = tables.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(fan))).repartition(SLICES * fan, "slice", "part").select("slice", "counts").mapInArrow(add, "slice int, counts binary")
    rows = tables.repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect()
    out = np.zeros((SLICES, CELLS // SLICES), np.int32)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["counts"], np.int32)
    return out.ravel()


def regions(docs: DataFrame, counts, width: int, percent: int, parts: int, hot: int) -> DataFrame:
    """pivot, sign: the members of each pivot's region; step 1.

    The members of a hot shingle's region are rows from the start, named by the
    shingle, and so never meet in one group.
    """

    def flush(s, sign, size):
        s, sign, size = np.concatenate(s), np.concatenate(sign), np.concatenate(size)
        apart = counts.value[cell(s)] > hot
        if apart.any():
            n = int(apart.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 3, pa.array(s[apart].view(np.int64)), pa.array(sign[apart])], names=names)
            s, sign, size = s[~apart], sign[~apart], size[~apart]
        if not len(s):
            return
        b = dealt(((s >> np.uint64(12)) % np.uint64(parts)).astype(np.int32), s, sign, size, names=names[:4])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.int64())], names=names)

    names = ["part", "shingles", "signs", "sizes", "pivot", "sign"]

    def entries(batches):
        table = counts.value
        for batch in batches:
            s, sign, size = [], [], []
            seen = set()
            for x in shingle_sets(batch.column(0), width):
                n = len(x)
                if n:
                    g = signature(x)
                    if g in seen:
                        continue
                    seen.add(g)
                    keep = n - (percent * n + 99) // 100 + 1
                    if keep < n:
                        x = x[np.lexsort((x, table[cell(x)]))[:keep]]
                    s.append(x)
                    sign.append(np.full(len(x), g, np.int64))
                    size.append(np.full(len(x), n, np.uint32))
            if s:
                yield from flush(s, sign, size)

    def group(t: pa.Table) -> pa.Table:
        s, sign, size = joined(t["shingles"], np.uint64), joined(t["signs"], np.int64), joined(t["sizes"], np.uint32)
        order = np.lexsort((sign, size, s))
        s, sign, size = s[order], sign[order], size[order].astype(np.int64)
        new = np.append(True, (s[1:] != s[:-1]) | (sign[1:] != sign[:-1]) | (size[1:] != size[:-1]))
        s, sign, size = s[new], sign[new], size[new]
        # a run ends with the shingle, or where the next set is too large for this one
        cut = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (100 * size[:-1] < percent * size[1:])))
        length = np.diff(np.append(cut, len(s)))
        pivot = np.repeat(np.minimum.reduceat(sign, cut), length)
        some = np.repeat(length, length) > 1
        pairs = np.unique(np.stack([pivot[some], sign[some]], axis=1), axis=0)
        return pa.table({"pivot": pairs[:, 0].copy(), "sign": pairs[:, 1].copy()})

    out = docs.select("text").mapInArrow(entries, "part int, shingles binary, signs binary, sizes binary, pivot bigint, sign bigint")
    if not (counts.value > hot).any():
        return out.drop("pivot", "sign").groupBy("part").applyInArrow(group, "pivot bigint, sign bigint").distinct()
    out = materialise(out)
    met = out.where("part is not null").drop("pivot", "sign").groupBy("part").applyInArrow(group, "pivot bigint, sign bigint")
    return met.unionByName(out.where("part is null").select("pivot", "sign")).distinct()


def possible(histograms: np.ndarray, percent: int) -> np.ndarray:
    """Which members may link to another: the L1 distance of histograms never exceeds that of the sets.

    100 (a + b - D) >= percent (a + b + D) is the link condition with D the
    symmetric difference and a, b the sizes.
    """
    size = histograms.sum(axis=1)
    out = np.zeros(len(histograms), bool)
    for i in range(len(histograms) - 1):
        d = np.abs(histograms[i + 1 :] - histograms[i]).sum(axis=1)
        hit = d * (100 + percent) <= (100 - percent) * (size[i + 1 :] + size[i])
        if hit.any():
            out[i] = True
            out[i + 1 :] |= hit
    return out


def pruned(members: DataFrame, histograms: DataFrame, percent: int, local: int) -> DataFrame:
    """`members` without those of small regions that can link to no other member."""
    sizes = members.groupBy("pivot").agg(F.count("*").alias("members"))
    tagged = materialise(members.join(sizes, "pivot"))

    def run(t: pa.Table) -> pa.Table:
        keep = possible(np.stack([np.frombuffer(b, np.uint32).astype(np.int64) for b in t["histogram"].to_pylist()]), percent)
        return t.select(["pivot", "sign"]).filter(pa.array(keep))

    small = tagged.where(F.col("members") <= local).select("pivot", "sign").join(histograms, "sign").select("pivot", "sign", "histogram")
    return small.groupBy("pivot").applyInArrow(run, "pivot bigint, sign bigint").unionByName(tagged.where(F.col("members") > local).select("pivot", "sign"))


def cell_links(signs: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Step 2 within one task: links of a region's members to the pivots of their cells."""
    links, alive = [], sorted(range(len(signs)), key=lambda i: signs[i])
    radius = 1 - percent / 100
    while len(alive) > 1:
        p, rest = alive[0], np.array(alive[1:])
        common = np.array([overlap(sets[p], sets[i]) for i in rest])
        union = len(sets[p]) + np.array([len(sets[i]) for i in rest]) - common
        near = 100 * common >= percent * union
        links += [(signs[p], signs[i]) for i in rest[near]]
        if near.all():
            break
        d = 1 - common / union
        boundary = near & (d >= d[~near].min() - radius - 1e-9)
        alive = rest[~near | boundary].tolist()
    return links


def cells_of(t: pa.Table) -> pa.Table:
    """Of one region's tallies (head, other, n): the heads of the main group, that of most members, and its name."""
    top: dict = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    heads, others = t["head"].to_pylist(), t["other"].to_pylist()
    for x, y in zip(heads, others, strict=True):
        top[find(x)] = find(y)
    weight: dict = {}
    for x, n in zip(heads, t["n"].to_pylist(), strict=True):
        weight[find(x)] = weight.get(find(x), 0) + n
    main = max(weight, key=lambda x: (weight[x], -x))
    kept = sorted({x for x in heads if find(x) == main})
    return pa.table({"region": pa.array([t["region"][0].as_py()] * len(kept), pa.int64()), "head": pa.array(kept, pa.int64()), "inner": pa.array([kept[0]] * len(kept), pa.int64())})


def blocks_of(t: pa.Table, local: int) -> pa.Table:
    """Of one region's homes (home, low, high, n): the block of each; small ones share one, large ones have parts."""
    rows, out, block, held = sorted(t.to_pylist(), key=lambda r: r["home"]), [], 0, 0
    for r in rows:
        if held and held + r["n"] > local:
            block, held = block + 1, 0
        held += r["n"]
        out.append(r | {"block": block, "subs": -(-r["n"] // local)})
    return pa.Table.from_pylist(out, schema=pa.schema([("region", pa.int64()), ("home", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int64()), ("block", pa.int32()), ("subs", pa.int64())]))


def block_links(left: pa.Table, right: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links of a block's members to others; none between two that are connected already."""
    names: dict = {}

    def read(t):
        sets = [np.frombuffer(b, np.uint64) for b in t["shingles"].to_pylist()]
        group = [names.setdefault((c is None, s if c is None else c), len(names)) for s, c in zip(t["sign"].to_pylist(), t["cell"].to_pylist(), strict=True)]
        return np.array(t["sign"].to_pylist(), np.int64), np.array(group), sets, histograms(sets)

    if not left.num_rows or not right.num_rows:
        return []
    sign, group, sets, held = read(left)
    other, joined_to, theirs, those = read(right)
    rest = np.array(right["rest"].to_pylist(), bool)
    size = those.sum(axis=1)
    links = []
    for i in range(len(sign)):
        n = len(sets[i])
        fit = (joined_to != group[i]) & (~rest | (other > sign[i])) & (100 * np.minimum(size, n) >= percent * np.maximum(size, n))
        at = np.flatnonzero(fit)
        at = at[np.abs(those[at] - held[i]).sum(axis=1) * (100 + percent) <= (100 - percent) * (size[at] + n)]
        for j in at.tolist():
            if joined_to[j] == group[i]:
                continue
            common = overlap(sets[i], theirs[j])
            if 100 * common >= percent * (n + len(theirs[j]) - common):
                links.append((int(sign[i]), int(other[j])))
                old = joined_to[j]
                joined_to[joined_to == old] = group[i]
                group[group == old] = group[i]
    return links


def histograms(sets: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256) for s in sets])


def join_regions(members: DataFrame, sets: DataFrame, percent: int, local: int = LOCAL, centres: int = CENTRES) -> DataFrame:
    """a, b: links that connect all linked nodes. `members` has pivot and sign, `sets` sign and shingles.

    A large region takes a fixed number of Spark steps, whatever its size: its
    members in slices, then the blocks of its rest against slices of the others.
    """
    radius, margin = 1 - percent / 100, 1e-9
    region = members.select(F.col("pivot").alias("region"), "sign")
    sizes = region.groupBy("region").agg(F.count("*").alias("members"))
    tagged = materialise(region.join(sizes, "region").where("members > 1"))
    link = "a bigint, b bigint"
    pairs = lambda found: pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    def finish(t: pa.Table) -> pa.Table:
        return pairs(cell_links(t["sign"].to_pylist(), [np.frombuffer(b, np.uint64) for b in t["shingles"].to_pylist()], percent))

    small = tagged.where(F.col("members") <= local).select("region", "sign").join(sets, "sign")
    links = small.groupBy("region").applyInArrow(finish, link).distinct()
    large = tagged.where(F.col("members") > local)
    if large.isEmpty():
        return links

    # distances of all members to the region's pivots
    slices = F.ceil(F.col("members") / local).cast("int")
    own = large.withColumn("slice", F.pmod(F.xxhash64("sign"), slices).cast("int")).join(sets, "sign").select("region", "members", "slice", "sign", "shingles")
    chosen = large.withColumn("k", F.row_number().over(W.partitionBy("region").orderBy("sign"))).where(F.col("k") <= centres)
    pivots = chosen.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).join(sets, "sign").select("region", "slice", "k", "sign", "shingles")

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.rename_columns(["region", "slice", "k", "sign", "shingles"]).sort_by("k")
        centre, names = [np.frombuffer(b, np.uint64) for b in right["shingles"].to_pylist()], right["sign"].to_pylist()
        near, d = [], []
        for b in left["shingles"].to_pylist():
            x = np.frombuffer(b, np.uint64)
            common = np.array([overlap(x, c) for c in centre])
            union = len(x) + np.array([len(c) for c in centre]) - common
            near.append([names[k] for k in np.flatnonzero(100 * common >= percent * union)])
            d.append((1 - common / union).tolist())
        return pa.Table.from_arrays([*(left[c] for c in ("region", "members", "sign")), pa.array(near, pa.list_(pa.int64())), pa.array(d, pa.list_(pa.float64()))], names=["region", "members", "sign", "near", "d"])

    # other names on the right: both sides stem from the same rows
    pivots = pivots.toDF(*[f"{c}_2" for c in pivots.columns])
    measured = own.groupBy("region", "slice").cogroup(pivots.groupBy("region_2", "slice_2")).applyInArrow(measure, "region bigint, members bigint, sign bigint, near array<bigint>, d array<double>")
    measured = materialise(measured.withColumn("head", F.get("near", F.lit(0))))
    inside = measured.where("head is not null")
    tallies = inside.select("region", "head", F.explode("near").alias("other")).groupBy("region", "head", "other").agg(F.count("*").alias("n"))
    tallies = materialise(tallies.withColumn("n", F.when(F.col("head") == F.col("other"), F.col("n")).otherwise(0)))
    links = links.unionByName(inside.select(F.col("head").alias("a"), F.col("sign").alias("b"))).unionByName(tallies.select(F.col("head").alias("a"), F.col("other").alias("b")))

    # members of the main cells are connected; all others are the rest
    main = tallies.groupBy("region").applyInArrow(cells_of, "region bigint, head bigint, inner bigint")
    home = (F.array_position("d", F.array_min("d")) - 1).cast("int")
    placed = measured.join(main, ["region", "head"], "left").select("region", "members", "sign", "d", F.col("inner").isNull().alias("rest"), F.coalesce("inner", "head").alias("cell"), home.alias("home"))
    placed = materialise(placed)
    rest = placed.where("rest")
    least = F.array_min("d")
    homes = rest.groupBy("region", "home").agg(F.min(least).alias("low"), F.max(least).alias("high"), F.count("*").alias("n"))
    blocks = homes.groupBy("region").applyInArrow(lambda t: blocks_of(t, local), "region bigint, home int, low double, high double, n bigint, block int, subs bigint")
    blocks = materialise(blocks)
    if blocks.isEmpty():
        return links
    wide = F.ceil(F.col("members") / (8 * local)).cast("int")
    sub = F.pmod(F.xxhash64("sign"), F.col("subs"))
    left = (
        rest.join(blocks.select("region", "home", "block", "subs"), ["region", "home"]).select("region", "block", sub.alias("sub"), F.explode(F.sequence(F.lit(0), wide - 1)).alias("slice"), "sign", "cell")
        .join(sets, "sign")
    )
    # the windows: who can link to a member of the rest whose home is s.home
    at = lambda s: F.get("d", s["home"])
    window = lambda s: (at(s) >= s["low"] - radius - margin) & (at(s) <= s["high"] + radius + margin) & (at(s) <= least + 2 * radius + margin)
    every = blocks.groupBy("region").agg(F.collect_list(F.struct("home", "low", "high", "block", "subs")).alias("homes"))
    met = F.array_distinct(F.transform(F.filter("homes", window), lambda s: F.struct(s["block"].alias("block"), s["subs"].alias("subs"))))
    right = placed.join(every, "region").select("region", "sign", "cell", "rest", F.pmod(F.xxhash64(F.lit(7), "sign"), wide).cast("int").alias("slice"), F.explode(met).alias("b"))
    right = right.select("region", "b.block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("b.subs") - 1)).alias("sub"), "slice", "sign", "cell", "rest").join(sets, "sign")
    keys, names = ("region", "block", "sub", "slice"), ["sign", "region", "block", "sub", "slice", "cell", "rest", "shingles"]
    right = right.select(names).toDF(*[f"{c}_2" for c in names])
    met = left.groupBy(*keys).cogroup(right.groupBy(*[f"{c}_2" for c in keys]))
    return links.unionByName(met.applyInArrow(lambda x, y: pairs(block_links(x, y.rename_columns(names), percent)), link))


def components(edges: DataFrame, first: DataFrame) -> DataFrame:
    """sign, label: the least `label` of `first` (sign, label) over each connected component.

    Every round takes the least label among the neighbours and then jumps along
    the chain of least neighbours; it ends when no label changes. A hub's label
    reaches its neighbours, and the label of a large component its members, by a
    broadcast of the hot keys.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialise(both)
    total = both.count()
    degrees = both.groupBy(F.col("a").alias("sign")).agg(F.count("*").alias("degree"))
    labels = materialise(first.join(degrees, "sign").select("sign", "label", "degree"))
    while True:
        heard = hot_join(both, labels.select(F.col("sign").alias("b"), "label", "degree"), "b", "degree", total).groupBy(F.col("a").alias("sign")).agg(F.min("label").alias("heard"))
        hooked = materialise(labels.join(heard, "sign", "left").select("sign", "degree", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("label")))
        # an old label's own best label is a shortcut for all that carry it
        jump = hooked.groupBy("old").agg(F.min("label").alias("best"), F.count("*").alias("n"))
        new = hot_join(hooked, jump, "old", "n", total).select("sign", "degree", F.least("label", "best").alias("label"), (F.least("label", "best") < F.col("old")).alias("moved"))
        new = materialise(new)
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return labels.drop("degree")


def jaccard_components(docs: DataFrame, *, width: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", local: int = LOCAL, centres: int = CENTRES, part_bytes: int = PART_BYTES, hot: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Documents link when 100 * intersection >= percent * union of their shingle
    sets; component_id is the least id reachable by links. Null and empty texts
    have no shingles and link with nothing. Rows with a null id keep their
    shingle count, and as their component that of their links (null, if none).
    Rows that share an id are documents each. Extra columns are left alone. A
    text of any length is one set of 8 bytes a shingle, never cut. An empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = materialise(nodes(d, width))
    every = counted.where("slice is null").select("id", "sign", "n")
    table_of_counts = rarity(counted)
    hot = max(HOT, int(HOT_MEANS * table_of_counts.mean())) if hot is None else hot
    counts = spark.sparkContext.broadcast(table_of_counts)
    parts = max(16, text_bytes(d) // part_bytes)
    members = materialise(regions(d, counts, width, percent, parts, hot))
    least = every.where("sign is not null").groupBy("sign").agg(F.min("id").alias("label"), F.count("*").alias("copies"))

    def of_nodes(some: DataFrame, kind: str, make) -> DataFrame:
        """sign and make(set) of the nodes in `some`, from one text of each."""
        wanted = materialise(some.select("sign").distinct().join(least, "sign").select("sign", F.col("label").alias("id")).where("id is not null"))
        if wanted.count() <= BROADCAST_NODES:
            wanted = F.broadcast(wanted)  # else the texts are shuffled by id

        def run(batches):
            for batch in batches:
                sets = list(shingle_sets(batch.column(1), width))
                signs = batch.column(0).to_pylist()
                rows = list({signs[i]: i for i, s in enumerate(sets) if len(s) and signature(s) == signs[i]}.values())
                yield pa.RecordBatch.from_arrays([pa.array([signs[i] for i in rows], pa.int64()), pa.array([make(sets[i]).tobytes() for i in rows], pa.binary())], names=["sign", kind])

        return materialise(d.join(wanted, "id").select("sign", "text").mapInArrow(run, f"sign bigint, {kind} binary").dropDuplicates(["sign"]))

    histograms = of_nodes(members, "histogram", lambda s: np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256).astype(np.uint32))
    members = materialise(pruned(members, histograms, percent, local))
    sets = of_nodes(members, "shingles", lambda s: s)
    links = materialise(join_regions(members, sets, percent, local, centres))
    labels = components(links, least.select("sign", "label"))
    best = materialise(least.join(labels.withColumnRenamed("label", "linked"), "sign", "left").select("sign", F.coalesce("linked", "label").alias("component_id"), "copies"))
    known = hot_join(every.where("sign is not null"), best, "sign", "copies", counted.count())
    out = known.unionByName(every.where("sign is null").withColumn("component_id", F.lit(None).cast("bigint")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_transform({words_sql()}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
u AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
x AS MATERIALIZED (SELECT node, n, unnest(s) AS t FROM u),
p AS (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT node, node AS reach FROM u UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
k AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN u ON s.s = u.s LEFT JOIN k ON u.node = k.node
"""
