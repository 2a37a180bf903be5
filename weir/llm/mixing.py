"""Mixing sources to target weights (operator 5): min-cost flow over membership patterns.

Documents that belong to the same set of sources are interchangeable for the
budget, so only the words of each membership pattern are summed (one shuffle of
partial sums). On those few rows a min-cost flow routes capacity to the
sources' quotas: the k-th copy of a pattern costs k - 1, a convex cost, so no
document is repeated while another has room. Each pattern then takes whole
copies of all its documents and one more copy of a seeded part.

With more than `MAX_PATTERNS` patterns, each of one source (web domains, say),
nothing is gathered: such a pattern is the only one of its source and takes the
source's whole target, which is the flow; weights, targets and cuts are then
DataFrame arithmetic, and the water level a few sums over the sources.

The seeded part is found without ordering a pattern as a whole: documents fall
into 4096 buckets by the first hex digits of a seeded md5, bucket sums give the
one bucket that the cut falls into, and only its documents are ordered. A
source with a third of all rows is so never one task's.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.llm.common import WORD_RE, hot_join, materialise, seeded, words_sql

SEED = 5
MAX_REPEATS = 2
#: Patterns and sources that the driver's flow network may hold; more go through Spark, those of several sources not.
MAX_PATTERNS = 50_000
WEIGHTS = (3, 1, 2)


def water_fill(sizes: dict, weights: dict, total: float, max_repeats: int = MAX_REPEATS) -> dict:
    """Targets that share `total` by weight, none above `max_repeats` times its source's size.

    All sources rise with one level; those that reach their limit stop and the
    rest share what is left.
    """
    order = sorted(sizes, key=lambda s: max_repeats * sizes[s] / weights[s])
    left, weight, out = float(total), sum(weights.values()), {}
    for i, s in enumerate(order):
        level = left / weight
        if level * weights[s] <= max_repeats * sizes[s]:
            return out | {x: level * weights[x] for x in order[i:]}
        out[s] = float(max_repeats * sizes[s])
        left, weight = left - max_repeats * sizes[s], weight - weights[s]
    return out


class Network:
    """A flow network of whole-numbered capacities; `push` adds as much flow as there is room for."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        """Adds an arc; its number, that of its reverse is one more."""
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def _levels(self, start: int, end: int) -> list[int] | None:
        level = [-1] * len(self.arcs)
        level[start], queue = 0, deque([start])
        while queue:
            a = queue.popleft()
            for e in self.arcs[a]:
                if self.room[e] > 0 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level if level[end] >= 0 else None

    def push(self, start: int, end: int) -> None:
        """Blocking flows over the arcs of shortest paths, until no path is left (Dinic)."""
        while (level := self._levels(start, end)) is not None:
            following = [0] * len(self.arcs)
            path, a = [], start
            while True:
                if a == end:
                    room = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= room
                        self.room[e ^ 1] += room
                    # back to where the path is full
                    full = next(i for i, e in enumerate(path) if self.room[e] == 0)
                    a = self.to[path[full] ^ 1]
                    del path[full:]
                    continue
                while following[a] < len(self.arcs[a]):
                    e = self.arcs[a][following[a]]
                    if self.room[e] > 0 and level[self.to[e]] == level[a] + 1:
                        break
                    following[a] += 1
                if following[a] < len(self.arcs[a]):
                    path.append(e)
                    a = self.to[e]
                elif path:
                    # nothing goes on from here
                    a = self.to[path.pop() ^ 1]
                    following[a] += 1
                else:
                    break


def min_cost_flow(capacities: dict[tuple, int], quotas: dict, max_repeats: int = MAX_REPEATS) -> dict[tuple[tuple, object], int]:
    """Words that each pattern sends to each source, as many as quotas and capacities let, at the least cost.

    Arcs: start to a pattern with its words once for each copy, the k-th at cost
    k - 1, from it to each of its sources, and on to the end with the source's
    quota. All other arcs cost nothing, so the flow is solved cost by cost: as
    much as goes through first copies, then as much more as second copies let
    through. More flow never takes words back from a pattern, only from the
    source that they went to, so each step keeps the least cost.
    """
    patterns, sources = list(capacities), list(quotas)
    at = {s: 2 + len(patterns) + j for j, s in enumerate(sources)}
    net = Network(2 + len(patterns) + len(sources))
    first = [net.arc(0, 2 + i, 0) for i in range(len(patterns))]
    sent = {}
    for i, p in enumerate(patterns):
        for s in dict.fromkeys(p):
            if s in at:
                sent[p, s] = net.arc(2 + i, at[s], max_repeats * capacities[p])
    for s in sources:
        net.arc(at[s], 1, int(quotas[s]))
    for _ in range(max_repeats):
        for e, p in zip(first, patterns, strict=True):
            net.room[e] += capacities[p]
        net.push(0, 1)
    return {k: net.room[e ^ 1] for k, e in sent.items() if net.room[e ^ 1] > 0}


def source_plan(summed: DataFrame, weights, budget: float, max_repeats: int) -> DataFrame:
    """sources, source_size, target, copies, rest of patterns (sources, words) of one source each, however many."""
    name = F.get("sources", F.lit(0))
    one = summed.withColumn("_null", name.isNull())
    placed = materialise(one.repartitionByRange("_null", name).sortWithinPartitions("_null", name).withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, upto = {}, 0
    for p, n in placed.where("size(sources) > 0").groupBy(part.alias("p")).count().orderBy("p").collect():  # one row a partition
        before[p], upto = upto, upto + n
    # patterns without any source (an empty array) have no rank; they are the first of the last partition, if any
    empty = placed.where("size(sources) = 0").select(F.min("_at")).first()[0]
    rank = inside + (F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[part] if before else F.lit(0))
    rank = rank - F.when(F.lit(empty is not None) & (F.col("_at") > F.lit(empty)) & (part == F.lit((empty or 0) >> 33)), 1).otherwise(0)
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(rank, F.lit(len(weights))).cast("int")).cast("double")
    known = placed.select("sources", F.col("words").alias("source_size"), weight.alias("w"), (F.col("words") * max_repeats).cast("double").alias("most")).where("size(sources) > 0")
    known = materialise(known)
    total = budget * (placed.agg(F.sum("words")).first()[0] or 0)
    level, stopped = None, -1
    while True:
        # sources whose share at this level exceeds what they can give stop; the rest share the remainder
        over = F.lit(False) if level is None else F.lit(level) * F.col("w") > F.col("most")
        n, capped, open_weight = known.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        if n == stopped or not open_weight:
            break
        level, stopped = (total - capped) / open_weight, n
    target = F.least(F.lit(level or 0.0) * F.col("w"), F.col("most"))
    quota = F.floor(target)
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(max_repeats), F.floor(quota / F.greatest("source_size", F.lit(1))))).otherwise(0).cast("bigint")
    plan = known.select("sources", "source_size", target.alias("target"), copies.alias("copies"), (quota - copies * F.col("source_size")).cast("bigint").alias("rest"))
    none = placed.where("size(sources) = 0").select("sources", F.lit(0).cast("bigint").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("bigint").alias("copies"), F.lit(0).cast("bigint").alias("rest"))
    return materialise(plan.unionByName(none))


def mix(docs: DataFrame, sources: DataFrame | None = None, *, id_col: str = "doc_id", size_col: str = "size", member_col: str = "sources", weights=WEIGHTS, budget: float = 1.5, max_repeats: int = MAX_REPEATS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """The mix: doc_id, sources, size, source_size, target, taken, and the columns named in `carry`.

    `member_col` is an array of the sources a document belongs to (nulls in it
    are a source of their own, the last). source_size and target belong to the
    first source of the document. Weights go round the sources in code point
    order. `taken` is a multiple of the size, at most `max_repeats` times it;
    each source's sum is within one document of its routed words. Documents
    without words, or with an empty or null array, take nothing. An empty table
    gives an empty table; repeated rows count each. Texts are not read here, and
    of any length where `mix_documents` counts their words. With `carry` the rows are read
    again for each step instead of being written with all their columns.
    """
    spark = docs.sparkSession
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.col(member_col).alias("sources"), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("size"),
        seeded(F.col(id_col), seed).alias("_key"), *[F.col(c).alias(f"_keep_{c}") for c in carry],
    )
    d = d.withColumn("_bucket", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))
    d = d if carry else materialise(d)
    sums = materialise(d.groupBy("sources", "_bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n")))
    patterns = sums.groupBy("sources").agg(F.sum("words").alias("words"), F.sum("n").alias("n"))
    summed = patterns.limit(MAX_PATTERNS + 1).collect()
    small = len(summed) <= MAX_PATTERNS
    if small:
        capacities = {tuple(r.sources or ()): r.words for r in summed}
        # null is the last source; a set keeps each once
        names = sorted({s for p in capacities for s in p}, key=lambda s: (s is None, s or ""))
        own = {s: sum(w for p, w in capacities.items() if s in p) for s in names}
        targets = water_fill(own, {s: weights[i % len(weights)] for i, s in enumerate(names)}, budget * sum(capacities.values()), max_repeats)
        flow = min_cost_flow(capacities, {s: int(t) for s, t in targets.items()}, max_repeats)
        sent: dict = {}
        for (p, _), v in flow.items():
            sent[p] = sent.get(p, 0) + v
        plan = []
        for r in summed:
            p = tuple(r.sources or ())
            routed = sent.get(p, 0)
            copies = min(max_repeats, routed // r.words) if r.words else 0
            plan.append((r.sources, own[p[0]] if p else 0, float(targets[p[0]]) if p else 0.0, int(copies), int(routed - copies * r.words)))
        member = d.schema["sources"].dataType.simpleString()
        plan_df = spark.createDataFrame(plan, f"sources {member}, source_size bigint, target double, copies bigint, rest bigint")
    else:
        single = patterns.withColumn("sources", F.coalesce("sources", F.array().cast(d.schema["sources"].dataType)))
        if not single.where("size(sources) > 1").isEmpty():
            raise ValueError(f"more than {MAX_PATTERNS} membership patterns, some of them of several sources")
        plan_df = source_plan(single.groupBy("sources").agg(F.sum("words").alias("words")), weights, budget, max_repeats)

    key = lambda x: F.coalesce(F.to_json(x), F.lit("[]"))
    upto = F.sum("words").over(W.partitionBy("sources").orderBy("_bucket"))
    cuts = (
        sums.withColumn("upto", upto).withColumn("_p", key("sources")).drop("sources").join(plan_df.select(key("sources").alias("_p"), "rest"), "_p")
        .where("rest > 0 and upto >= rest and upto - words < rest").select("_p", F.col("_bucket").alias("cut"), (F.col("upto") - F.col("words")).alias("before"))
    )
    every = patterns.groupBy(key("sources").alias("_p")).agg(F.sum("n").alias("_n"))
    plan_df = plan_df.withColumn("_p", key("sources")).drop("sources").dropDuplicates(["_p"]).join(cuts, "_p", "left").fillna({"cut": -1, "before": 0})
    plan_df = materialise(plan_df.join(every, "_p"))
    with_key = d.withColumn("_p", key("sources"))
    if small:
        known = with_key.join(F.broadcast(plan_df.drop("_n")), "_p")
    else:
        known = hot_join(with_key, plan_df, "_p", "_n", docs.count())
    outside = known.where("_bucket <> cut").withColumn("more", (F.col("_bucket") < F.col("cut")).cast("bigint"))
    order = W.partitionBy("_p").orderBy("_key", "size").rowsBetween(W.unboundedPreceding, 0)
    inside = known.where("_bucket = cut").withColumn("_upto", F.col("before") + F.sum("size").over(order))
    inside = inside.withColumn("more", (2 * F.col("_upto") - F.col("size") <= 2 * F.col("rest")).cast("bigint")).drop("_upto")
    out = outside.unionByName(inside)
    return out.select("doc_id", "sources", "size", "source_size", "target", ((F.col("copies") + F.col("more")) * F.col("size")).alias("taken"), *[F.col(f"_keep_{c}").alias(c) for c in carry])


def mix_documents(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """`mix` for documents with one source column; the size is the number of words (null text: 0).

    Columns named in `carry` come back as carried_<name>.
    """
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_RE)).cast("bigint")
    carry = {c: f"_carry_{c}" for c in options.pop("carry", ())}
    d = docs.select(F.col(id_col).alias("doc_id"), F.array(F.col(source_col).cast("string")).alias("sources"), words.alias("size"), *[F.col(c).alias(k) for c, k in carry.items()])
    out = mix(d, carry=tuple(carry.values()), **options)
    return out.select(*out.columns[:6], *[F.col(k).alias(f"carried_{c}") for c, k in carry.items()])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len({words_sql()}) AS BIGINT) AS size, md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        CASE (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS i, 2 * source_size / w AS ratio FROM s),
c AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight, sum(source_size) OVER () AS total FROM r),
l AS (SELECT *, (CAST(3 * total AS DOUBLE) / 2 - CAST(capped AS DOUBLE)) / CAST(weight AS DOUBLE) AS level FROM c),
f AS (SELECT min(i) AS i FROM l WHERE level * w <= 2 * source_size),
t AS (SELECT source, source_size, CASE WHEN f.i IS NULL OR l.i < f.i THEN CAST(2 * source_size AS DOUBLE) ELSE (SELECT x.level FROM l x, f y WHERE x.i = y.i) * w END AS target FROM l, f),
q AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2, CAST(floor(target) AS BIGINT) // source_size) END AS copies FROM t),
o AS (SELECT d.*, q.source_size, q.target, q.copies, CAST(floor(q.target) AS BIGINT) - q.copies * q.source_size AS rest,
        sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST((copies + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM o
"""
