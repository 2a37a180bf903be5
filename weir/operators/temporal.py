"""Window features per client (W1 to W3): what lies in the W seconds before each row.

Ranges run over microseconds, the row itself and later ones excluded, so rows of
one client and time share their features: a tick. No frame slides. A row at s is
in the window of a tick at t where s < t <= s + W, so it adds 1 at s and takes it
back at s + W; a window's count is the running sum of these events before t. A
path is counted once, at its last place in the window: an occurrence at s that is
followed by one at s' counts for s < t <= min(s', s + W), from s to the less of
both. All sums of a client are 0 at its end, so one running sum over all clients,
in ranges of (client, time), serves them all: a few events a row, however many
rows a window holds, and a client with a third of all rows is many ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.operators.places import HOT_ROWS, followed, hot_join, materialise, running

#: The windows of the temporal features, in seconds.
COUNTS = (1, 5, 60)
RATES = 60
SECOND = 1_000_000


def temporal_features(rows: DataFrame, *, ip: str = "client_ip", ts: str = "ts", path: str = "path", status: str = "status_code", counts=COUNTS, rates: int = RATES) -> DataFrame:
    """The rows with req_count_Ws for each W, error_rate_4xx_Ws and endpoint_diversity_Ws.

    An empty window has counts, rate and diversity 0. Rows with a null client or
    time have null features; a null path is no path, and a row without a status is
    in no rate. Rows of one client and time have the same features.
    """
    marked = rows.withColumns({"_c": F.col(ip).cast("string"), "_us": F.unix_micros(F.col(ts).cast("timestamp"))})
    known = marked.where("_us is not null and _c is not null")
    bad = F.coalesce((F.floor(F.col(status) / 100) == 4).cast("int"), F.lit(0))
    ticks = materialise(known.groupBy("_c", "_us").agg(F.count("*").alias("n"), F.sum(bad).alias("bad"), F.count(status).alias("coded")))
    paths = followed(known.where(F.col(path).isNotNull()).select("_c", F.col(path).alias("_p"), "_us").distinct(), ("_c", "_p"), "_us", "_next")
    sums = [*[f"n_{w}" for w in counts], "all", "bad", "paths"]

    def event(at, values: dict, kind: int = 1):
        """What is added to the running sums behind a time; a question (kind 0) adds nothing and comes before what happens at its time."""
        return F.struct(at.alias("_us"), F.lit(kind).alias("_kind"), *[values.get(s, F.lit(0)).cast("bigint").alias(s) for s in sums], (F.col("n") if kind == 0 else F.lit(0)).cast("bigint").alias("n"))

    enters = {f"n_{w}": F.col("n") for w in counts} | {"all": F.col("coded"), "bad": F.col("bad")}
    leaves = [event(F.col("_us") + w * SECOND, ({f"n_{w}": -F.col("n")} if w in counts else {}) | ({"all": -F.col("coded"), "bad": -F.col("bad")} if w == rates else {})) for w in sorted({*counts, rates})]
    moves = ticks.select("_c", F.explode(F.array(event(F.col("_us"), {}, 0), event(F.col("_us"), enters), *leaves)).alias("e"))
    end = F.col("_us") + rates * SECOND
    shown = paths.select("_c", F.explode(F.array(event(F.col("_us"), {"paths": F.lit(1)}), event(F.least(end, F.coalesce("_next", end)), {"paths": F.lit(-1)}))).alias("e"))
    placed = running(moves.unionByName(shown).select("_c", "e.*"), "_c", "_us", "_kind", **{f"_{s}": s for s in sums}).where("_kind = 0")
    new = {f"req_count_{w}s": F.col(f"_n_{w}") for w in counts}
    new[f"error_rate_4xx_{rates}s"] = F.when(F.col("_all") > 0, F.col("_bad") / F.col("_all")).otherwise(F.lit(0.0))
    new[f"endpoint_diversity_{rates}s"] = F.col("_paths")
    found = placed.select(F.struct("_c", "_us").alias("_key"), "n", *[c.alias(n) for n, c in new.items()])
    total, most = ticks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    keyed = known.withColumn("_key", F.struct("_c", "_us"))
    # ticks of very many rows are broadcast, if there are any
    out = hot_join(keyed, found, "_key", "n", total) if most > HOT_ROWS else keyed.join(found.drop("n"), "_key")
    rest = marked.where("_us is null or _c is null").drop("_c", "_us")
    return out.drop("_key", "_c", "_us").unionByName(rest, allowMissingColumns=True)
