"""Report queries over detection events: each is one aggregation, most with a bounded result.

Ties are broken by explicit keys, so that reruns agree. Percentages, scores and
ranks follow the report semantics of the survey (A1 to A9, A20 to A22, A26).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.functions.text import subnet
from weir.operators.places import running

INCIDENTS = ("block", "pass_anomaly")
DEFAULT_LIMIT = 10
#: Order of the severities in reports.
SEVERITIES = {"high": 0, "medium": 1, "low": 2}


def round_half_up(x: Column, digits: int = 2) -> Column:
    """Rounds as floor(x * 10^digits + 0.5) does."""
    scale = 10**digits
    return F.floor(x * scale + 0.5).cast("double") / scale


def incidents(events: DataFrame) -> DataFrame:
    return events.where(F.col("verdict").isin(*INCIDENTS))


def attacks(events: DataFrame) -> DataFrame:
    return events.where(F.col("predicted_class") != "benign")


def severity(verdict: Column) -> Column:
    return F.when(verdict == "block", "high").when(verdict == "pass_anomaly", "medium").otherwise("low")


def checked_limit(limit) -> int:
    """The limit, or the default where it is no positive whole number."""
    return limit if isinstance(limit, int) and not isinstance(limit, bool) and limit > 0 else DEFAULT_LIMIT


def events_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A table, or no rows of that schema where it does not exist yet."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def in_range(events: DataFrame, start_ms: int | None = None, end_ms: int | None = None, endpoint: str | None = None, method: str | None = None) -> DataFrame:
    """Events of an inclusive range of milliseconds, and of an endpoint and method if given."""
    if start_ms is not None and end_ms is not None and start_ms > end_ms:
        raise ValueError("the range ends before it starts")
    for given, condition in ((start_ms, F.col("timestamp") >= start_ms), (end_ms, F.col("timestamp") <= end_ms), (endpoint, F.col("path") == endpoint), (method, F.col("method") == (method or "").upper())):
        if given is not None:
            events = events.where(condition)
    return events


def day_range(first: str, last: str) -> tuple[int, int]:
    """Inclusive milliseconds of two UTC dates; a date alone ends with its last millisecond."""
    from datetime import UTC, datetime

    at = [datetime.fromisoformat(x).replace(tzinfo=UTC) if "T" not in x else datetime.fromisoformat(x) for x in (first, last)]
    a, b = (int(t.timestamp() * 1000) for t in at)
    b += 86_400_000 - 1 if "T" not in last else 0
    if a > b:
        raise ValueError("the range ends before it starts")
    return a, b


def attacks_list(events: DataFrame) -> DataFrame:
    return attacks(events).groupBy("predicted_class").agg(F.count("*").alias("total_count"), F.max("timestamp").alias("last_detected")).orderBy(F.desc("total_count"), "predicted_class")


def attacks_summary(events: DataFrame, **where) -> DataFrame:
    rows = attacks(in_range(events, **where)).groupBy("path", "method", severity(F.col("verdict")).alias("severity"), "predicted_class").agg(F.count("*").alias("count"))
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return rows.orderBy("path", "method", rank, F.desc("count"), "predicted_class")


def attack_examples(events: DataFrame, predicted_class: str, n: int = 3) -> DataFrame:
    """The latest events of a class."""
    return events.where(F.col("predicted_class") == predicted_class).orderBy(F.desc("event_id")).limit(n).select("event_id", "path", "query_string")


def inspection(events: DataFrame, classes: DataFrame, importances: DataFrame, *, features: int = 5, examples: int = 3) -> DataFrame:
    """attack_type, f1, precision, recall, auc, top_features, payload_examples: a row for each attack type that was evaluated or detected.

    `classes` has label, f1, precision, recall and auc of the evaluated model,
    `importances` name and importance of its features; examples are the latest
    events of a type, a bounded few of each.
    """
    best = importances.orderBy(F.desc("importance"), "name").limit(features)
    top = best.agg(F.sort_array(F.collect_list(F.struct(-F.col("importance"), "name", "importance"))).alias("f")).select(F.transform("f", lambda x, i: F.struct((i + 1).alias("rank"), x["name"].alias("feature"), x["importance"].alias("importance"))).alias("top_features"))
    place = F.row_number().over(W.partitionBy("predicted_class").orderBy(F.desc("event_id")))
    latest = events.where("predicted_class <> 'benign'").withColumn("_n", place).where(F.col("_n") <= examples)
    shown = latest.groupBy(F.col("predicted_class").alias("attack_type")).agg(F.sort_array(F.collect_list(F.struct((-F.col("event_id")).alias("o"), "event_id", "path", "query_string"))).alias("e"))
    shown = shown.select("attack_type", F.transform("e", lambda x: F.struct(x["event_id"].alias("event_id"), x["path"].alias("path"), x["query_string"].alias("query_string"))).alias("payload_examples"))
    evaluated = classes.where("label <> 'benign'").select(F.col("label").alias("attack_type"), "f1", "precision", "recall", "auc")
    return evaluated.join(shown, "attack_type", "full").join(F.broadcast(top), F.lit(True)).select("attack_type", "f1", "precision", "recall", "auc", "top_features", "payload_examples")


def endpoints_top(events: DataFrame, limit=DEFAULT_LIMIT) -> DataFrame:
    rows = incidents(events).groupBy("path", "method").agg(F.count("*").alias("incident_count"), F.avg("confidence").alias("mean"))
    risk = round_half_up(F.col("incident_count") * F.col("mean")).alias("risk_score")
    return rows.orderBy(F.desc("incident_count"), "path", "method").limit(checked_limit(limit)).select("path", "method", "incident_count", risk)


def endpoints_report(events: DataFrame) -> DataFrame:
    """One row per route: counts, risk, classes by count, commonest class and source.

    Classes and sources are counted once each by (route, key), so a route's rows
    are summed before they meet; no second query per route.
    """
    rows = incidents(events)
    route = ["path", "method"]
    total = rows.groupBy(*route).agg(F.count("*").alias("incident_count"), F.count_if(F.col("verdict") == "block").alias("block_count"), F.count_if(F.col("verdict") == "pass_anomaly").alias("pass_anomaly_count"), F.avg("confidence").alias("mean"))
    most = lambda x: F.struct((-F.col("count")).alias("less"), F.col(x).alias("name"))
    classes = rows.groupBy(*route, "predicted_class").count().groupBy(*route).agg(F.sort_array(F.collect_list(most("predicted_class"))).alias("c"))
    sources = rows.where("client_ip <> ''").groupBy(*route, "client_ip").count().groupBy(*route).agg(F.min(most("client_ip")).alias("s"))
    joined = total.join(classes, route, "left").join(sources, route, "left")
    return joined.select(
        *route, "incident_count", "block_count", "pass_anomaly_count", round_half_up(F.col("incident_count") * F.col("mean")).alias("risk_score"), F.col("c")[0]["name"].alias("top_attack_class"),
        F.array_join(F.transform("c", lambda x: F.concat(x["name"], F.lit(":"), (-x["less"]).cast("string"))), ",").alias("attack_types"), F.coalesce("s.name", F.lit("")).alias("top_source_ip"),
    ).orderBy(F.desc("incident_count"), *route)


def profile(events: DataFrame, path: str, method: str | None = None) -> DataFrame:
    """The incidents of a route that its profile counts."""
    return incidents(in_range(events, endpoint=path, method=method))


def profile_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total_incidents"), F.count_if(F.col("verdict") == "block").alias("block_count"), F.count_if(F.col("verdict") == "pass_anomaly").alias("pass_anomaly_count"))


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("count")).orderBy(F.desc("count"), key)


def hourly(rows: DataFrame) -> DataFrame:
    """Counts by hour of day, UTC (the session's time zone must be UTC)."""
    return rows.groupBy(F.hour(F.timestamp_millis("timestamp")).alias("hour")).agg(F.count("*").alias("count")).orderBy("hour")


def top_sources(rows: DataFrame, n: int = 10) -> DataFrame:
    return counts_by(rows.where("client_ip <> ''"), "client_ip").limit(n)


def source_ranges(rows: DataFrame, n: int = 10) -> DataFrame:
    """Networks of the n commonest sources only."""
    return top_sources(rows, n).groupBy(subnet(F.col("client_ip")).alias("client_ip")).agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "client_ip")


def user_agent_rates(events: DataFrame) -> DataFrame:
    """Block rate and classes by normalised route and kind of user agent."""
    route = F.regexp_replace("path", r"/\d+", "/:id").alias("route")
    agent = F.when(F.col("user_agent").startswith("Mozilla"), "browser").otherwise("other").alias("agent")
    rows = events.select(route, agent, "verdict", "predicted_class")
    per = rows.groupBy("route", "agent", "predicted_class").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("predicted_class", "n"))), lambda x: F.concat(x["predicted_class"], F.lit(":"), x["n"].cast("string"))), ",")
    return per.groupBy("route", "agent").agg(F.sum("n").alias("total"), F.sum("blocked").alias("blocked"), text.alias("classes")).withColumn("block_rate", F.col("blocked") / F.col("total"))


def blocked_by_class(events: DataFrame, gate: float = 0.8) -> DataFrame:
    rows = events.groupBy("predicted_class").agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    return rows.withColumn("rate", F.col("blocked") / F.col("total")).withColumn("passed", F.col("rate") >= gate)


def long_agents(events: DataFrame, length: int = 40) -> DataFrame:
    return events.groupBy("predicted_class").agg((100 * F.avg((F.length("user_agent") > length).cast("double"))).alias("percent"))


def index_percentiles(values: DataFrame, column: str, points=(0.5, 0.95, 0.99)) -> DataFrame:
    """The values at index floor(n * p) of the sorted column, without sorting it in one task.

    Equal values are counted first; the running count runs over distinct values
    by ranges, whose totals are a few rows.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    placed = running(counted, column, upto="n")
    placed = placed.join(F.broadcast(placed.agg(F.max("upto").alias("total"))), F.lit(True))
    at = lambda p: F.least(F.floor(F.col("total") * p), F.col("total") - 1)
    return placed.agg(*[F.min(F.when(F.col("upto") > at(p), F.col(column))).alias(f"p{round(100 * p)}") for p in points])


def canary_agreement(comparisons: DataFrame) -> DataFrame:
    n = F.count("*")
    return comparisons.agg(n.alias("total"), F.count_if("verdict_match").alias("matches"), F.when(n > 0, F.count_if("verdict_match") / n).alias("rate"))


def tumbling_attacks(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Extension: attacks by class and tumbling window; works on streams as well."""
    return attacks(events).groupBy(F.window(F.timestamp_millis("timestamp"), width).alias("w"), "predicted_class").agg(F.count("*").alias("count")).select(F.unix_millis("w.start").alias("start"), "predicted_class", "count")


def telemetry_health(events: DataFrame) -> DataFrame:
    """One row: events, distinct sources, and whether there are any events."""
    return events.agg(F.count("*").alias("events"), F.countDistinct("source_id").alias("sources"), (F.count("*") > 0).alias("healthy"))


#: Fixed value: the share of equal verdicts that a candidate model must reach.
MIN_AGREEMENT = 0.995


def replay_gate(fixture: DataFrame, rows: DataFrame) -> DataFrame:
    """One row on a replayed fixture: `fixture` has request_id and expected, `rows` request_id, was and now (blocked before, now).

    A regression is an attack that was blocked and no longer is. Fixture
    requests without a row are not covered and count for neither side.
    """
    d = fixture.join(rows, "request_id", "left")
    lost = F.count_if((F.col("expected") != "benign") & F.col("was") & ~F.col("now"))
    covered, agreed = F.count("was"), F.count_if(F.col("was") == F.col("now"))
    rate = F.when(covered > 0, agreed / covered)
    return d.agg(F.count("*").alias("total"), covered.alias("covered"), lost.alias("regressions"), agreed.alias("agreed"), rate.alias("rate"), ((lost == 0) & (F.coalesce(rate, F.lit(0.0)) >= MIN_AGREEMENT)).alias("passed"))
