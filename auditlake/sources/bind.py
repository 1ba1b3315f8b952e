"""Audit-shaped views of the generic star-schema and page tables, so that every operator runs on them at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.js import first_match

RULES = [
    "color-contrast", "image-alt", "target-size", "meta-refresh", "wcag2aa.principle1.guideline1_4.1_4_3.g18,b1,b2", "",
    "1.4.10 Reflujo", "some-error-rule", "best-practice-region", "axe-link_name", "html-has-lang", "unknown-thing",
]
IMPACTS = {"error": "critical", "purchase": "serious", "signup": "moderate", "click": "minor"}
TEXTS = ["Empty heading", "Buttons MUST have discernible text ", "Contrast ratio of 3.1, decorative", "Revisión manual del foco", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw findings over ``events``: rule, text and selector from the number in props, page from user and week."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").cast("string")
    page = F.concat(F.lit("https://site"), (F.col("user_id") % 7).cast("string"), F.lit(".example/es/p"), F.col("user_id").cast("string"), F.lit("/w"), week)
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("_ord"),
        at(["sitemap", "interactiva", "manual"], F.col("event_id") % 3).alias("source"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(at(["axe-core", "pa11y"], F.col("event_id") % 2)).alias("engine"),
        at(RULES, k % 12).alias("id"),
        first_match([(F.col("event_type") == t, i) for t, i in IMPACTS.items()], F.lit("notice")).alias("impact"),
        at(TEXTS, k % 5).alias("description"),
        page.alias("pageUrl"),
        F.concat(F.lit("#k"), k.cast("string")).alias("selector"),
        F.concat(F.lit("<i>"), k.cast("string"), F.lit("</i>")).alias("context"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical findings of ``raw``."""
    from auditlake.operators.normalize import canonical

    return canonical(raw(spark, sf_dir))


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with nested violations, one for each user: url, origen, violations, needs_review, pa11y."""
    r = raw(spark, sf_dir).withColumn("user", F.regexp_extract("pageUrl", "/p([0-9]+)/", 1).cast("int"))
    v = lambda when: F.collect_list(F.when(when, F.struct("id", F.nullif(F.col("impact"), F.lit("notice")).alias("impact"))))
    # a user's events are few; the table grows in users
    return r.groupBy("user").agg(
        F.concat(F.lit("https://site.example/u"), F.col("user").cast("string")).alias("url"),
        first_match([(F.col("user") % 3 == 0, "interactiva"), (F.col("user") % 3 == 1, "sitemap")], F.lit(None).cast("string")).alias("origen"),
        v(F.col("source") == "sitemap").alias("violations"),
        v(F.col("source") == "manual").alias("needs_review"),
        v((F.col("source") == "interactiva") & (F.coalesce("engine", F.lit("")) == "pa11y")).alias("pa11y"),
    ).drop("user")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table as a URL inventory."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("_ord"), "url", title.alias("title"))


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table as one site whose pages link to each other: a page's address is one of its own links."""
    found = F.regexp_extract_all("html", F.lit('<a[^>]+href="([^"]+)"'), F.lit(1))
    own = F.get(found, (F.col("page_id") % F.greatest(F.size(found), F.lit(1))).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://site.example"), F.coalesce(own, F.lit("/"))).alias("url"), "html")
