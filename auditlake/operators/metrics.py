"""Aggregates: counts, shares, conformance indices, rankings, nested counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake import dims
from auditlake.functions.js import first_match, js_or, percent, share
from auditlake.operators.normalize import severity

SEVERITIES = ["critical", "serious", "moderate", "minor"]


def with_severity(findings: DataFrame) -> DataFrame:
    """Canonical severity from severity, else impact."""
    given = js_or(F.col("severity"), F.col("impact"), "") if "severity" in findings.columns else js_or(F.col("impact"), "")
    return findings.withColumn("severity", severity(given))


def count_by_source_engine(findings: DataFrame) -> DataFrame:
    """Totals by source and engine with the four severities; other severities count in the total only."""
    each = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return findings.groupBy("source", "engine").agg(F.count("*").alias("total"), *each)


def count_by(findings: DataFrame, field: str, empty: str = "sin_dato") -> DataFrame:
    return findings.groupBy(js_or(F.col(field), empty).alias("value")).agg(F.count("*").alias("n"))


def count_by_fields(findings: DataFrame, fields: list[str], empty: str = "sin_dato") -> DataFrame:
    """field, value and n of several fields, in one pass."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), js_or(F.col(f), empty).alias("value")) for f in fields))
    return findings.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def page_count(*columns: str) -> Column:
    """Distinct pages; the empty one counts."""
    return F.count_distinct(js_or(*(F.col(c) for c in columns), ""))


def page_count_raw(column: str) -> Column:
    """Distinct values of the column, a missing one being a value."""
    return F.count_distinct(F.coalesce(F.col(column), F.lit("\x00undefined")))


def severity_share(findings: DataFrame) -> DataFrame:
    """Count and percentage of each severity."""
    counted = with_severity(findings).groupBy("severity").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # as many rows as severities
    return counted.select("severity", "n", percent(F.col("n"), total).alias("pct"))


def band(index: Column) -> Column:
    """Level of a rounded index."""
    return first_match([(index >= low, name) for low, name in dims.BANDS], F.lit(dims.NO_BAND))


def _index(rows: DataFrame, field: str, weights: dict[str, int], pages: Column) -> DataFrame:
    weight = first_match([(F.col(field) == k, F.lit(w)) for k, w in weights.items()], F.lit(dims.OTHER_WEIGHT))
    sums = rows.agg(F.count("*").alias("findings"), pages.alias("pages"), F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias("penalty10"))
    d = "decimal(30,12)"
    per_page = (F.col("penalty10").cast("decimal(20,0)") / (F.greatest("pages", F.lit(1)) * 10).cast("decimal(20,0)")).cast(d)
    index = F.round(F.greatest(F.lit(0).cast(d), F.lit(100).cast(d) - per_page), 1).cast("decimal(10,1)")
    return sums.withColumn("index", index).select("findings", "pages", "penalty10", F.col("index").cast("double").alias("conformance"), band(F.col("index")).alias("level"))


def conformance_index(findings: DataFrame) -> DataFrame:
    """max(0, 100 - weighted findings / pages), to one decimal, and its level."""
    return _index(with_severity(findings), "severity", dims.WEIGHTS, page_count("pageUrl"))


def conformance_metadata(groups: DataFrame) -> DataFrame:
    """The same over grouped findings, by raw impact, with a weight of its own for reviews."""
    return _index(groups, "impact", dims.METADATA_WEIGHTS, page_count_raw("pageUrl"))


def top(findings: DataFrame, field: str, k: int = 10) -> DataFrame:
    """The k commonest values; of equally common ones the first seen."""
    counted = findings.groupBy(js_or(F.col(field), "(sin dato)").alias("value")).agg(F.count("*").alias("n"), F.min("_ord").alias("_first"))
    return counted.orderBy(F.desc("n"), "_first").limit(k).select("value", "n")


def severity_rank(column: Column) -> Column:
    """0 to 3, else 99."""
    return first_match([(column == s, F.lit(k)) for k, s in enumerate(SEVERITIES)], F.lit(99))


def by_severity(findings: DataFrame) -> DataFrame:
    """Stable sort by severity."""
    return findings.orderBy(severity_rank(F.col("severity")), "_ord")


def nested_counts(pages: DataFrame) -> DataFrame:
    """Violations by impact over pages (url, origen, violations), in all and by origin, with distinct urls.

    Any origin but ``interactiva`` counts as sitemap. Impacts are compared as they are.
    """
    origin = F.when(F.col("origen") == "interactiva", "interactiva").otherwise("sitemap")
    rows = pages.select("url", origin.alias("origen"), F.explode_outer("violations").alias("v"))
    there = F.col("v").isNotNull()
    each = [F.count_if(there & (F.col("v.impact") == s)).alias(s) for s in SEVERITIES]
    sets = rows.groupingSets([[], [F.col("origen")]], F.col("origen")).agg(F.count_distinct("url").alias("urls"), F.count_if(there).alias("total"), *each)
    return sets.withColumn("origen", F.coalesce("origen", F.lit("global")))


def _equal(array: str, value: str) -> Column:
    return F.filter(array, lambda x: x == value)


def report_counters(pages: DataFrame) -> DataFrame:
    """One row: violations by origin and impact (unknown impacts dropped, absent ones unclassified), reviews and Pa11y issues."""
    impacts = F.transform("violations", lambda v: F.lower(F.coalesce(v["impact"], F.lit("unclassified"))))
    rows = pages.select(js_or(F.col("origen"), "combinado").alias("o"), F.coalesce(impacts, F.array().cast("array<string>")).alias("i"), "needs_review", "pa11y")
    n = lambda a: F.coalesce(F.sum(a), F.lit(0)).cast("long")
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    return rows.agg(
        *(n(F.when(F.col("o") == o, F.size("i"))).alias(o) for o in ("sitemap", "interactiva", "combinado")),
        *(n(F.size(_equal("i", s))).alias(s) for s in [*SEVERITIES, "unclassified"]),
        n(size("needs_review")).alias("needs_review"),
        n(size("pa11y")).alias("pa11y"),
    )


def page_summary(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Issues of each page of an inventory (url), pages without any included, and the engine of the first."""
    own = findings.groupBy("pageUrl").agg(F.count("*").alias("n"), F.min_by("engine", "_ord").alias("engine"))
    joined = pages.join(own, F.col("url") == F.col("pageUrl"), "left")
    return joined.select("url", F.coalesce("n", F.lit(0)).alias("total"), F.coalesce("engine", F.lit("unknown")).alias("motor"))


def cardinalities(**tables: DataFrame) -> DataFrame:
    """Rows of each table, in one row."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.join(one)  # one row each
    return out


def widths(rows: DataFrame) -> DataFrame:
    """Column widths of a sheet: the longest text of each column, header included, plus two."""
    each = [F.greatest(F.max(F.length(F.coalesce(F.col(c).cast("string"), F.lit("")))), F.lit(len(c))) + 2 for c in rows.columns]
    return rows.agg(*(e.alias(c) for e, c in zip(each, rows.columns, strict=True)))


def coverage(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage as a double; 0 where there is nothing to cover."""
    return F.coalesce(share(part, whole, digits), F.lit(0)).cast("double")


def histogram(findings: DataFrame, field: str = "impact", empty: str = "sin clasificar") -> DataFrame:
    """value, n and total: how often each value occurs, an absent one under ``empty``."""
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # as many rows as values
    return count_by(findings, field, empty).withColumn("total", total)


def exact_counts(findings: DataFrame, field: str = "impact") -> DataFrame:
    """One row: how many rows have exactly each of the four severities, and all rows."""
    return findings.agg(F.count("*").alias("total"), *(F.count_if(F.col(field) == s).alias(s) for s in SEVERITIES))


def issues_total(pages: DataFrame) -> DataFrame:
    """One row: pages and issues of the rows of ``multi_engine``."""
    return pages.agg(F.count("*").alias("pages"), F.coalesce(F.sum("total_issues"), F.lit(0)).cast("long").alias("issues"))


def valid_pages(pages: DataFrame) -> DataFrame:
    """Nested pages that have an address and a list of violations."""
    return pages.where((js_or(F.col("url"), "") != "") & F.col("violations").isNotNull())
