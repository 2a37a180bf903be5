"""Leakage of evaluation payloads into a corpus: texts by hash, containment by split and class, fixtures by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.operators.containment import contained
from weir.operators.corpus import fingerprint, generic_template, template_shape

FIELDS = ("path", "query", "body")


def template_of(label: Column, text: Column) -> Column:
    """The rule by which texts of a class are compared: generated command injections by shape, others decoded."""
    return F.when(label == "cmdi", template_shape(text)).otherwise(generic_template(text))


def with_texts(split: DataFrame, corpus: DataFrame, key: str = "_row_hash") -> DataFrame:
    """Rows of a split with path, query and body from the corpus by their hash; `missing` where it has none."""
    texts = corpus.groupBy(key).agg(F.min(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in FIELDS])).alias("_t"))
    return split.join(texts, key, "left").select(*split.columns, *[F.coalesce(F.col(f"_t.{c}"), F.lit("")).alias(c) for c in FIELDS], F.col("_t").isNull().alias("missing"))


def containment(rows: DataFrame, payloads: DataFrame, *, label: str = "label", fields: tuple[str, ...] = ("path", "query", "body"), template=None) -> DataFrame:
    """Per label: payloads (label, payload), and how many occur in some field of a row of the label."""
    rule = template or (lambda c: c)
    p = payloads.select("label", "payload", rule(F.col("payload")).alias("needle")).where("length(needle) > 0").distinct()
    texts = rows.select(F.col(label).alias("label"), *[rule(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields])
    hits = contained(texts, p, fields=fields).join(p, ["label", "needle"]).groupBy("label").agg(F.count("*").alias("matches"))
    return p.groupBy("label").agg(F.count("*").alias("total")).join(hits, "label", "left").select("label", "total", F.coalesce("matches", F.lit(0)).alias("matches"))


def payload_leakage(rows: DataFrame, payloads: DataFrame, *, by: str = "split", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """by, label, total, exact_matches, template_matches, missing: payloads found in the rows of each split and class.

    `rows` has `by`, label, the fields and `missing`; `payloads` label and
    payload. Payloads that are listed twice count twice.
    """
    p = payloads.select("label", "payload").withColumns({"_template": template_of(F.col("label"), F.col("payload"))})
    templated = rows.withColumns({f: template_of(F.col("label"), F.coalesce(F.col(f), F.lit(""))) for f in fields})
    exact = contained(rows, p.select("label", F.col("payload").alias("needle")), fields=fields, keys=(by,))
    templ = contained(templated, p.select("label", F.col("_template").alias("needle")), fields=fields, keys=(by,))
    hits = lambda found, column, name: found.join(p.withColumnRenamed(column, "needle"), ["label", "needle"]).groupBy(by, "label").agg(F.count("*").alias(name))
    base = rows.groupBy(by, "label").agg(F.count_if("missing").alias("missing"))
    total = p.groupBy("label").agg(F.count("*").alias("total"))
    out = base.join(total, "label").join(hits(exact, "payload", "exact_matches"), [by, "label"], "left").join(hits(templ, "_template", "template_matches"), [by, "label"], "left")
    return out.select(by, "label", "total", F.coalesce("exact_matches", F.lit(0)).alias("exact_matches"), F.coalesce("template_matches", F.lit(0)).alias("template_matches"), "missing")


def fixture_leakage(fixture: DataFrame, rows: DataFrame, *, by: str = "split", key: str = "_row_hash") -> DataFrame:
    """by, label, total, exact_matches, template_matches: fixture requests whose hash, or hash of templates, a split has."""
    templates = lambda d: fingerprint_of([template_of(F.col("label"), F.coalesce(F.col(c), F.lit(""))) for c in FIELDS], F.col("label"))
    f = fixture.select("label", fingerprint(*FIELDS, "label").alias("_exact"), templates(fixture).alias("_template"))
    exact = rows.select(by, F.col(key).alias("_exact")).distinct()
    templ = rows.where(~F.col("missing")).select(by, templates(rows).alias("_template")).distinct()
    count = lambda have, column, name: f.join(have, column).groupBy(by, "label").agg(F.count("*").alias(name))
    total = f.groupBy("label").agg(F.count("*").alias("total"))
    base = rows.select(by, "label").distinct().join(total, "label")
    out = base.join(count(exact, "_exact", "exact_matches"), [by, "label"], "left").join(count(templ, "_template", "template_matches"), [by, "label"], "left")
    return out.select(by, "label", "total", F.coalesce("exact_matches", F.lit(0)).alias("exact_matches"), F.coalesce("template_matches", F.lit(0)).alias("template_matches"))


def fingerprint_of(texts: list[Column], label: Column) -> Column:
    return F.sha2(F.concat_ws("|", *texts, F.coalesce(label, F.lit(""))), 256)


def anchor(rows: DataFrame, payloads: DataFrame, *, by: str = "split", label: str = "cmdi", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """scope, exact_matches, template_matches of one class: each split, their sum, and their union.

    The sum exceeds the union where a payload lies in several splits.
    """
    some, p = rows.where(F.col("label") == label), payloads.where(F.col("label") == label).select("label", "payload").distinct()
    templated = some.withColumns({f: template_of(F.col("label"), F.coalesce(F.col(f), F.lit(""))) for f in fields})
    exact = contained(some, p.select("label", F.col("payload").alias("needle")), fields=fields, keys=(by,)).select(by, F.col("needle").alias("payload"))
    templ = contained(templated, p.select("label", template_of(F.col("label"), F.col("payload")).alias("needle")), fields=fields, keys=(by,))
    templ = templ.join(p.select("payload", template_of(F.col("label"), F.col("payload")).alias("needle")), "needle").select(by, "payload")
    both = exact.withColumn("kind", F.lit("exact")).unionByName(templ.withColumn("kind", F.lit("template")))
    of = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}_matches")
    each = both.groupBy(F.col(by).alias("scope")).agg(of("exact"), of("template"))
    total = both.agg(of("exact"), of("template")).select(F.lit("sum").alias("scope"), "*")
    union = both.select("payload", "kind").distinct().agg(of("exact"), of("template")).select(F.lit("union").alias("scope"), "*")
    return each.unionByName(total).unionByName(union)
