"""Corpus operations on canonical requests: dedup, near duplicates, split, lock, leakage, counts."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.operators.places import materialise, numbered
from weir.operators.quantiles import quantiles

#: Shares of the split, tolerances of its check.
TEST, VALIDATION, TRAIN = 0.15, 0.15, 0.70
CLASS_TOLERANCE, SOURCE_TOLERANCE = 0.02, 0.05
SEED = 42


def fingerprint(*columns: str) -> Column:
    """sha256 of the columns joined by |, nulls empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def keep_first(df: DataFrame, key: Column, *order) -> DataFrame:
    """The first row of each key; ordered inside partial aggregates, so that a hot key is no task's burden."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(key.alias("_key")).agg(first.alias("_row")).select("_row.*")


def duplicates_by_source(df: DataFrame, key: Column, source: str, *order) -> DataFrame:
    """Rows that exact dedup drops, by source."""
    kept = keep_first(df, key, *order).groupBy(source).agg(F.count("*").alias("kept"))
    return df.groupBy(source).agg(F.count("*").alias("total")).join(kept, source, "left").select(source, (F.col("total") - F.coalesce("kept", F.lit(0))).alias("duplicates"))


def template_shape(text: Column) -> Column:
    """Runs of six capitals become CANARY, runs of digits N."""
    return F.regexp_replace(F.regexp_replace(text, "[A-Z]{6}", "CANARY"), "[0-9]+", "N")


def generic_template(text: Column) -> Column:
    """Percent-decoded once, lower case, runs of digits N."""
    decoded = F.coalesce(F.try_url_decode(F.replace(F.regexp_replace(text, "%(?![0-9a-fA-F]{2})", "%25"), F.lit("+"), F.lit("%2B"))), text)
    return F.regexp_replace(F.lower(decoded), "[0-9]+", "N")


#: Lengths up to which texts, less what all have in common, meet by their deletions: 67 of each text at most, with two edits.
DELETIONS = 11


def common_ends(d: DataFrame, label: str, text: str) -> DataFrame:
    """label, front, back: how many characters all texts of a label have in common at both ends, together no more than the shortest has.

    What all of them share is what the least and the greatest share.
    """
    shared = lambda a, b: F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, i: F.when(s["on"] & (F.length(a) >= i) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), F.struct((s["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(s["n"].alias("n"), F.lit(False).alias("on"))),
        lambda s: s["n"],
    )
    back = F.reverse(text)
    ends = d.groupBy(label).agg(F.min(text).alias("a"), F.max(text).alias("z"), F.min(back).alias("ra"), F.max(back).alias("rz"), F.min(F.length(text)).alias("least"))
    front = ends.select(label, F.least(shared(F.col("a"), F.col("z")), "least").alias("front"), "ra", "rz", "least")
    return front.select(label, "front", F.least(shared(F.col("ra"), F.col("rz")), F.col("least") - F.col("front")).alias("back"))


def deletions(text: Column, most: int) -> Column:
    """All texts that are left when up to `most` characters are taken out."""
    out = F.array(text)
    for _ in range(most):
        shorter = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1, F.length(t))))).otherwise(F.array(t))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, shorter))))
    return out


def near_queries(df: DataFrame, *, id_col: str, label: str, text: str, most: int = 2, longest: int = 100, spare: int = 6, short: int = DELETIONS) -> DataFrame:
    """Pairs (label, a, b, distance) of short texts of one label within `most` edits, between distinct texts; exact.

    What all texts of a label begin and end with is left out, which changes no
    distance. Of what is left, texts of up to `short` characters meet by their
    deletions: within `most` edits two texts become the same by taking out up to
    `most` characters of each, and texts that do are at most twice as far apart,
    so candidates are not many more than pairs. Longer texts meet by pieces (see
    `_by_pieces`); those a little shorter take part in both, so no pair is lost, but
    the pieces of two short texts, of a character or two each, bring nobody together.
    Distances of short texts are measured where they meet, others for distinct
    candidates; equal texts are one row.
    """
    d = df.where(F.length(text).between(1, longest)).groupBy(F.col(label).alias("label"), F.col(text).alias("text")).agg(F.min(id_col).alias("id"))
    d = materialise(d)
    ends = common_ends(d, "label", "text").withColumnRenamed("label", "_l")
    rest = F.substr("text", F.col("front") + 1, F.length("text") - F.col("front") - F.col("back"))
    d = materialise(d.join(ends, F.col("label").eqNullSafe(F.col("_l"))).select("label", "id", rest.alias("text")).withColumn("n", F.length("text")))
    left = d.where(F.col("n") <= short).select("label", "id", "text", F.explode(F.transform(deletions(F.col("text"), most), lambda t: F.xxhash64("label", t))).alias("h"))
    # both sides have the same columns, so that what is dealt out by hash is written once
    side = lambda i, t: left.select(F.col("h").alias(f"_h{i}"), F.col("label").alias(f"_l{i}"), F.col("id").alias(i), F.col("text").alias(t))
    met = side("a", "x").join(side("b", "y"), (F.col("_ha") == F.col("_hb")) & F.col("_la").eqNullSafe(F.col("_lb")) & (F.col("a") < F.col("b")))
    # texts come along: what is measured on the spot need not be fetched, and only pairs are made distinct
    measured = lambda pairs: pairs.withColumn("distance", F.levenshtein("x", "y", most)).where("distance >= 0")
    close = measured(met.select(F.col("_la").alias("label"), "a", "b", "x", "y")).select("label", "a", "b", "distance").distinct()
    near = _by_pieces(d.where(F.col("n") > short - most), most, spare, short).distinct()
    both = near.join(d.select(F.col("id").alias("a"), F.col("label").alias("_la"), F.col("text").alias("x")), "a").join(d.select(F.col("id").alias("b"), F.col("label").alias("_lb"), F.col("text").alias("y")), "b")
    both = both.where(F.col("_la").eqNullSafe(F.col("label")) & F.col("_lb").eqNullSafe(F.col("label")))
    return close.unionByName(measured(both).select("label", "a", "b", "distance"))


def _by_pieces(d: DataFrame, most: int, spare: int, short: int) -> DataFrame:
    """label, a, b: candidates among texts (label, id, text, n) by equal pieces, the longer one of more than `short` characters.

    A text is cut into most + spare pieces. Within `most` edits at least `spare`
    of them lie unchanged in the other text, so of any most + 1 pieces at least
    one does: each text is indexed by its rarest ones, and a piece that
    thousands share brings nobody together. Where a piece may lie follows from
    the lengths: left of it and right of it texts differ by as many characters as
    edits allow. Texts stay where they are; pieces meet as hashes.
    """
    parts = most + spare
    start = lambda i, m: F.floor(i * m / parts).cast("int")
    size = lambda i, m: start(i + 1, m) - start(i, m)
    key = lambda n, i, piece: F.xxhash64("label", n, i, piece)
    n = F.col("n")
    longer = d.where(n > short)
    # only lengths that a longer text may meet are indexed
    lengths = longer.select("n").distinct().select(F.explode(F.sequence(n - most, n)).alias("n")).distinct()
    d = d.join(F.broadcast(lengths), "n", "left_semi")
    own = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(key(n, i, F.substr("text", start(i, n) + 1, size(i, n))).alias("h"), i.alias("part")))
    pieces = d.select("label", "id", "n", F.explode(own).alias("p")).select("label", "id", "n", "p.*")
    often = pieces.groupBy("h").agg(F.count("*").alias("often"))
    rarest = F.slice(F.sort_array(F.collect_list(F.struct("often", "part", "h"))), 1, most + 1)
    index = pieces.join(often, "h").groupBy("label", "id", "n").agg(rarest.alias("r")).select("label", "id", "n", F.explode("r.h").alias("h"))
    # how much shorter the other text is, how far its piece lies from its place, which piece
    ways = [(less, shift, k) for less in range(most + 1) for shift in range(-((most - less) // 2), (most + less) // 2 + 1) for k in range(parts)]
    way = F.array(*[F.struct(F.lit(x).alias("less"), F.lit(y).alias("shift"), F.lit(z).alias("part")) for x, y, z in ways])

    def probe(w: Column) -> Column:
        m = n - w["less"]
        begin = start(w["part"], m) + w["shift"]
        fits = (m >= 0) & (begin >= 0) & (begin + size(w["part"], m) <= n)
        return F.when(fits, F.struct(key(m, w["part"], F.substr("text", begin + 1, size(w["part"], m))).alias("h"), m.alias("n")))

    probes = longer.select(F.col("id").alias("other"), n.alias("long"), F.explode(F.transform(way, probe)).alias("p")).where("p is not null").select("other", "long", "p.h", F.col("p.n").alias("m"))
    met = index.join(probes, "h").where("n = m and (n < long or id < other)")
    return met.select("label", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))


def stratified_split(df: DataFrame, *, id_col: str, label: str = "label", source: str = "_source", seed: int = SEED, test: float = TEST, validation: float = VALIDATION) -> DataFrame:
    """The rows with `split`: in each stratum (label, source) the share `test`, then `validation`, of a seeded order.

    The order is that of a seeded md5. A stratum is cut by the running count of
    its 4096 hash buckets; only the buckets that a cut falls into are ordered.
    """
    d = df.withColumns({"_h": F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), "_s": F.concat_ws("||", F.coalesce(F.col(label).cast("string"), F.lit("")), F.coalesce(F.col(source).cast("string"), F.lit("")))})
    d = d.withColumn("_b", F.substring("_h", 1, 3))
    sums = d.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    w = W.partitionBy("_s")
    sums = sums.select("_s", "_b", (F.sum("_n").over(w.orderBy("_b")) - F.col("_n")).alias("_before"), "_n", F.sum("_n").over(w).alias("_all"))
    first, second = F.ceil(F.col("_all") * test), F.ceil(F.col("_all") * (test + validation))
    sums = sums.withColumns({"_first": first, "_second": second})
    cut = lambda x: (F.col("_before") < F.col(x)) & (F.col("_before") + F.col("_n") > F.col(x))
    known = d.join(sums.withColumn("_cut", cut("_first") | cut("_second")), ["_s", "_b"])
    place = F.when(F.col("_cut"), F.row_number().over(W.partitionBy("_s", "_b").orderBy("_h", id_col)) + F.col("_before")).otherwise(F.col("_before") + 1)
    out = known.withColumn("_at", place)
    split = F.when(F.col("_at") <= F.col("_first"), "test").when(F.col("_at") <= F.col("_second"), "val").otherwise("train")
    return out.withColumn("split", split).drop("_h", "_s", "_b", "_before", "_n", "_all", "_first", "_second", "_cut", "_at")


def distribution(df: DataFrame, *keys: str) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def split_drift(split: DataFrame, key: str, tolerance: float = CLASS_TOLERANCE) -> DataFrame:
    """Per split and key: its share, the overall share, and whether they agree within the tolerance."""
    total = split.groupBy(key).agg(F.count("*").alias("n")).withColumn("overall", F.col("n") / F.sum("n").over(W.partitionBy())).drop("n")
    part = split.groupBy("split", key).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("split"))).drop("n")
    return part.join(total, key).withColumn("within", F.abs(F.col("share") - F.col("overall")) <= tolerance)


def split_overlap(split: DataFrame, key: str) -> DataFrame:
    """Keys that lie in more than one split, by pair of splits."""
    s = split.select("split", key).distinct()
    return s.alias("a").join(s.alias("b"), key).where("a.split < b.split").groupBy(F.col("a.split").alias("first"), F.col("b.split").alias("second")).agg(F.count("*").alias("shared"))


def lock_hash(hashes: DataFrame, column: str) -> DataFrame:
    """One row: sha256 of the sorted hashes joined by newlines, and how many there are.

    By definition this is one digest of the whole sorted text, which nothing can
    compute in parts: ranges are sorted in Spark and packed into blocks of about
    1 MB, and the driver feeds them to one running digest, a range at a time.
    """

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            for h in batch.column(0).to_pylist():
                held.append(h)
                size += len(h) + 1
                if size >= 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(["\n".join(held)]), pa.array([len(held)], pa.int64())], names=["t", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(["\n".join(held)]), pa.array([len(held)], pa.int64())], names=["t", "n"])

    digest, rows = hashlib.sha256(), 0
    ordered = hashes.select(F.col(column).alias("h")).where("h is not null").repartitionByRange("h").sortWithinPartitions("h")
    for block in ordered.mapInArrow(pack, "t string, n bigint").toLocalIterator():
        digest.update((b"\n" if rows else b"") + block.t.encode())
        rows += block.n
    return hashes.sparkSession.createDataFrame([(digest.hexdigest(), rows)], "lock string, rows bigint")


def coverage(df: DataFrame, source: str, label: str, classes: list[str]) -> DataFrame:
    """Counts by source and class, their total and imbalance."""
    p = df.groupBy(source).pivot(label, classes).count().fillna(0)
    cols = [F.col(c) for c in classes]
    return p.withColumns({"total": sum(cols[1:], cols[0]), "ratio": F.greatest(*cols) / F.greatest(F.least(*cols), F.lit(1))})


def describe_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, count, mean, std, min, p25, p50, p75, max of a number in each group, quartiles by selection."""
    base = df.groupBy(key).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(df, value, [0.25, 0.5, 0.75], by=key).withColumnRenamed(key, "_key")
    known = base.join(q, base[key].eqNullSafe(q["_key"]), "left")
    return known.select(key, "count", "mean", "std", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))], "max")


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: nulls and their percentage."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])).alias("p")
    return one.select("_n", pairs).select("p.column", "p.nulls", F.when(F.col("_n") > 0, 100 * F.col("p.nulls") / F.col("_n")).alias("percent"))


def duplicate_rate(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")).withColumn("percent", F.when(F.col("rows") > 0, 100 * F.col("duplicates") / F.col("rows")))


def every_nth(df: DataFrame, n: int, *order) -> DataFrame:
    """`n` rows at the places floor(i * rows / n) of the order."""
    placed = numbered(df, *order, name="_at", first=0)
    total = placed.count()
    if total <= n:
        return placed.drop("_at")
    # i = ceil(at * n / total) is the one whose place can be `at`
    i = F.ceil(F.col("_at") * n / total)
    return placed.where((F.floor(i * total / n) == F.col("_at")) & (i < n)).drop("_at")


def backfill_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union by name; number columns that one side lacks are 0."""
    out = first.unionByName(second, allowMissingColumns=True)
    lacking = [c for c, t in out.dtypes if (c not in first.columns or c not in second.columns) and t in ("int", "bigint", "double", "float")]
    return out.fillna(0, lacking)


def sample_per_class(df: DataFrame, label: str, n: int, id_col: str, seed: int = SEED) -> DataFrame:
    """At most `n` rows of each class, the first of a seeded md5 order; Spark limits each task's rows before the shuffle."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    place = F.row_number().over(W.partitionBy(label).orderBy(key, id_col))
    return df.withColumn("_at", place).where(F.col("_at") <= n).drop("_at")


#: Fixed value: sources with fewer rows are not held out.
MIN_SOURCE_ROWS = 30


def held_out_sources(df: DataFrame, source: str, label: str, benign: str = "benign") -> DataFrame:
    """One fold per source of enough rows: rows held out, rows to train on, and the held-out share of benign ones."""
    n = df.groupBy(source).agg(F.count("*").alias("held_out"), F.count_if(F.col(label) == benign).alias("_b"))
    folds = n.select(source, "held_out", (F.sum("held_out").over(W.partitionBy()) - F.col("held_out")).alias("train"), (F.col("_b") / F.col("held_out")).alias("benign_share"))
    return folds.where(F.col("held_out") >= MIN_SOURCE_ROWS)
