"""Linking findings to screenshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.js import js_or, slug_capture
from auditlake.operators.lookup import enrich
from auditlake.operators.normalize import impact_color

#: Slugs at least this long are found by their last characters.
GRAM = 12
#: For shorter ones, screenshot paths of up to this many bytes are compared by a broadcast; more are cut into blocks of this size.
BLOCK_BYTES = 8 << 20


def link_captures(findings: DataFrame, captures: DataFrame) -> DataFrame:
    """Adds ``capturePath``: the first of captures (path, pos) that contains the page's slug; an empty page matches the first.

    A path that contains a slug has its last ``GRAM`` characters as a piece, so
    distinct slugs join the paths' pieces and are then compared whole. Slugs too
    short for that meet all paths, block by block of bounded size. The result joins
    back by the slug.
    """
    slugs = findings.select(slug_capture(F.coalesce("pageUrl", F.lit(""))).alias("slug")).distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.length("path") - GRAM + 1, F.lit(1)))
    pieces = captures.where(F.length("path") >= GRAM).select("path", "pos", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("path", i, GRAM)))).alias("gram"))
    own = slugs.where(F.length("slug") >= GRAM).withColumn("gram", F.expr(f"right(slug, {GRAM})"))
    best = (F.min_by("path", "pos").alias("path"), F.min("pos").alias("pos"))
    hits = own.join(pieces, "gram").where(F.col("path").contains(F.col("slug"))).groupBy("slug").agg(*best)
    short = slugs.where(F.length("slug") < GRAM)
    size = captures.agg(F.sum(F.octet_length("path") + 64)).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        block = F.broadcast(captures.where(F.pmod(F.xxhash64("path"), F.lit(n)) == k))
        hits = hits.unionByName(short.join(block, F.col("path").contains(F.col("slug"))).groupBy("slug").agg(*best))
    first = hits.groupBy("slug").agg(F.min_by("path", "pos").alias("capturePath"))
    keyed = findings.withColumn("slug", slug_capture(F.coalesce("pageUrl", F.lit(""))))
    return keyed.join(first, "slug", "left").drop("slug")


def sheet_captures(findings: DataFrame, captures: DataFrame) -> DataFrame:
    """``capturePath`` as workbooks show it: the one given, else the first in the folder that contains the page's slug, else a dash."""
    given = F.col("capturePath") if "capturePath" in findings.columns else F.lit(None).cast("string")
    named = findings.withColumn("_given", js_or(given)).drop("capturePath")
    found = link_captures(named, captures)
    return found.withColumn("capturePath", js_or(F.col("_given"), F.col("capturePath"), "—")).drop("_given")


def capture_meta(findings: DataFrame) -> DataFrame:
    """What is stored beside each screenshot of findings (id, wcag, selector, impact, capturePath, pageUrl, source); rows without a page have none."""
    c = F.col
    named = findings.where(js_or(c("pageUrl")).isNotNull()).withColumn("criterio", js_or(c("wcag"), c("id"), "sin-id"))
    return enrich(named, c("criterio")).select(
        "criterio",
        c("w_criterio").alias("criterio_wcag"),
        c("w_principio").alias("principio"),
        c("w_nivel").alias("nivel"),
        c("w_resumen").alias("resumen"),
        c("w_url").alias("url_wcag"),
        js_or(c("selector"), "body").alias("selector"),
        js_or(c("impact"), "serious").alias("impacto"),
        impact_color(c("impact")).alias("color"),
        "capturePath",
        c("pageUrl").alias("url"),
        js_or(c("source"), "sitemap").alias("origen"),
    )


def capture_counters(folded: DataFrame) -> DataFrame:
    """One row: captured, skipped and errors of a fold's rows (captured, error)."""
    failed = F.coalesce(F.col("error"), F.lit(False))
    return folded.agg(
        F.count_if(F.col("captured") & ~failed).alias("captured"), F.count_if(~F.col("captured")).alias("skipped"), F.count_if(F.col("captured") & failed).alias("errors")
    )
