"""Running sums and places in a global order, without one task holding the order.

Rows are dealt to ranges once and written to the checkpoint folder with their
range's number. Ranges are sampled anew at every execution, so totals and rows
must come from the same one; only a materialised table gives that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder from spark.checkpoint.dir; where that is unset, below the warehouse of a local session.

    A cluster without the setting is an error: each executor would write to a disk of its own.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(where or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def followed(df: DataFrame, keys: tuple[str, ...], order: str, name: str) -> DataFrame:
    """The rows with `name`: the value of `order` in the next row of equal keys, null in the last.

    Keys have no nulls and (keys, order) is unique. Rows are ordered over ranges,
    so a key of very many rows is dealt to many tasks.
    """
    ranged = materialise(df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))
    after = F.lead(F.struct(*keys, order)).over(W.partitionBy("_part").orderBy(*keys, order))
    heads = ranged.groupBy("_part").agg(F.min(F.struct(*keys, order)).alias("_head"))
    # a row for each range: few
    heads = heads.select((F.lag("_part").over(W.orderBy("_part"))).alias("_part"), "_head").where("_part is not null")
    known = ranged.withColumn("_after", after).join(F.broadcast(heads), "_part", "left").withColumn("_after", F.coalesce("_after", "_head"))
    same = [F.col(f"_after.{k}") == F.col(k) for k in keys]
    return known.withColumn(name, F.when(reduce(lambda a, b: a & b, same), F.col(f"_after.{order}"))).drop("_part", "_after", "_head")


def running(df: DataFrame, *order, **sums: Column | str) -> DataFrame:
    """The rows with, for each name in `sums`, the sum of its column over all rows up to this one in the order.

    Rows that are equal in the order get sums in an order of their own; end it
    with a key where that matters. Nulls count as 0.
    """
    names = [f"_sum_{k}" for k in sums]
    values = {n: F.coalesce(v if isinstance(v, Column) else F.col(v), F.lit(0)) for n, v in zip(names, sums.values(), strict=True)}
    ranged = materialise(df.withColumns(values).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(*[F.sum(n).alias(f"_all{n}") for n in names])
    # a row for each range: few
    before = parts.select("_part", *[(F.sum(f"_all{n}").over(W.orderBy("_part")) - F.col(f"_all{n}")).alias(f"_before{n}") for n in names])
    upto = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    known = ranged.join(F.broadcast(before), "_part")
    return known.withColumns({k: F.sum(n).over(upto) + F.col(f"_before{n}") for k, n in zip(sums, names, strict=True)}).drop("_part", *names, *[f"_before{n}" for n in names])


def numbered(df: DataFrame, *order, name: str = "request_id", first: int = 1) -> DataFrame:
    """The rows with their place in the order, from `first`."""
    return running(df, *order, **{name: F.lit(1)}).withColumn(name, F.col(name) + F.lit(first - 1).cast("bigint"))


#: Rows from which a key of `hot_join` counts as hot, and how many keys may be.
HOT_ROWS, HOT_KEYS = 1024, 100_000


def hot_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """left join right on `key` (null-free and unique in `right`), where `right` has in `n` how many rows of `left` meet each key; `n` is dropped.

    Keys of very many rows come from a broadcast table, at most HOT_KEYS of them,
    as their rows add up to `total` at most; all others meet by a shuffle.
    """
    hot = F.col(n) > max(HOT_ROWS, total // HOT_KEYS)
    often, rest = F.broadcast(right.where(hot).drop(n)), right.where(~hot).drop(n)
    return left.join(often, key).unionByName(left.join(often.select(key), key, "left_anti").join(rest, key, how))
