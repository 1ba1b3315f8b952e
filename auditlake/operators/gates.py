"""Checks and verdicts over whole tables; each is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.js import first_match, js_or, js_trim
from auditlake.operators.metrics import coverage

REQUIRED = ["id", "engine", "source", "pageUrl", "wcag", "nivel", "impact", "resultadoActual", "resultadoEsperado"]


def quality_gate(counts: DataFrame, *, critical_max: int = 0, serious_max: int = 5) -> DataFrame:
    """Verdict over the global row of ``nested_counts``."""
    fine = (F.col("critical") <= critical_max) & (F.col("serious") <= serious_max)
    return counts.where("origen = 'global'").select("total", "critical", "serious", fine.alias("passed"), F.when(fine, 0).otherwise(1).alias("exit_code"))


def defects(rows: DataFrame, raw: str | None = None, required: list[str] = REQUIRED) -> DataFrame:
    """Adds ``missing`` and ``empties``: required fields that are absent, and that are there but blank.

    With ``raw``, a column of JSON objects, absence is that of the key; without
    it a null column is absent.
    """
    if raw:
        there = F.coalesce(F.json_object_keys(F.col(raw)), F.array().cast("array<string>"))
        missing = F.array_except(F.array(*map(F.lit, required)), there)
        values = {f: F.get_json_object(F.col(raw), f"$.{f}") for f in required}
    else:
        missing = F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in required)))
        values = {f: F.col(f).cast("string") for f in required}
    blank = F.array_compact(F.array(*(F.when(js_trim(v) == "", F.lit(f)) for f, v in values.items())))
    return rows.withColumns({"missing": missing, "empties": blank})


def metadata_status(rows: DataFrame, duplicates: DataFrame, *, strict: bool = False) -> DataFrame:
    """Defect counts, number of duplicated ids, status and exit code. ``rows`` comes from ``defects``."""
    one = rows.agg(F.count_if(F.size("missing") > 0).alias("missing"), F.count_if(F.size("empties") > 0).alias("empty"))
    return _metadata_verdict(one.join(duplicates.agg(F.count("*").alias("duplicates"))), strict)  # one row each


def metadata_verdict(rows: DataFrame, *, strict: bool = False) -> DataFrame:
    """``metadata_status`` in one pass, the ids being those of ``rows`` themselves."""
    each = rows.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.size("missing") > 0).alias("m"), F.count_if(F.size("empties") > 0).alias("e"))
    sums = (F.coalesce(F.sum("m"), F.lit(0)).alias("missing"), F.coalesce(F.sum("e"), F.lit(0)).alias("empty"), F.count_if(F.col("n") > 1).alias("duplicates"))
    return _metadata_verdict(each.agg(*sums), strict)


def _metadata_verdict(both: DataFrame, strict: bool) -> DataFrame:
    bad = (F.col("missing") > 0) | (F.col("empty") > 0)
    some = F.col("duplicates") > 0
    code = first_match([(bad | (some & F.lit(strict)), F.lit(2)), (some, F.lit(1))], F.lit(0))
    return both.withColumns({"status": first_match([(bad, "ERROR"), (some, "WARNING")], F.lit("OK")), "exit_code": code})


def sources_and_engines(findings: DataFrame) -> DataFrame:
    """One row: counts by source and which sources and engines there are."""
    has = lambda c: F.count_if(c) > 0
    source, engine = F.col("source"), F.col("engine")
    return findings.agg(
        F.count("*").alias("merged"),
        F.count_if(source == "sitemap").alias("sitemap"),
        F.count_if(source == "interactiva").alias("interactiva"),
        (~has((source == "sitemap") & (engine != "axe-core")) & has(source == "sitemap")).alias("sitemap_only_axe"),
        has((source == "interactiva") & (engine == "pa11y")).alias("interactive_has_pa11y"),
        (has(source == "sitemap") & has(source == "interactiva")).alias("both_sources"),
        (has(engine == "axe-core") & has(engine == "pa11y")).alias("both_engines"),
    )


def pipeline_verdict(facts: DataFrame, *, missing_specs: int = 0, excel: bool = True, summary: bool = True) -> DataFrame:
    """Exit code and status from one row with urls, captures, raw_sitemap, raw_interactiva and ``sources_and_engines``."""
    c = F.col
    cover = coverage(c("merged"), c("raw_sitemap") + c("raw_interactiva"))
    hard = F.lit(missing_specs > 0) | (c("urls") == 0) | (c("merged") == 0) | ((c("raw_sitemap") == 0) & (c("raw_interactiva") == 0))
    hard = hard | ~c("sitemap_only_axe") | ~c("both_sources") | ~c("both_engines")
    soft = F.lit(not excel or not summary) | (c("captures") == 0) | (cover < 70)
    code: Column = first_match([(hard, F.lit(2)), (soft, F.lit(1))], F.lit(0))
    out = facts.withColumn("coverage", cover).withColumn("exit_code", code)
    return out.withColumn("status", first_match([(c("exit_code") == 0, "OK"), (c("exit_code") == 1, "WARNING")], F.lit("ERROR")))


def missing_specs(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required files that are not there."""
    return required.join(present, "file", "left_anti")


def engine_fallback(axe: DataFrame, pa11y: DataFrame) -> DataFrame:
    """Pa11y rows, and axe rows of pages without any."""
    return pa11y.unionByName(axe.join(pa11y.select("pageUrl").distinct(), "pageUrl", "left_anti"))


def needs_review(findings: DataFrame) -> DataFrame:
    """Findings that a person must look at: by impact, or by their description."""
    text = F.coalesce(F.col("description").rlike("(?iu)manual|revisión"), F.lit(False))
    return findings.where(F.col("impact").isin("needs-review", "manual", "incomplete") | text)


def review_rows(items: DataFrame) -> DataFrame:
    """The review sheet of items with any of id, ruleId, impact, description, help, helpUrl, nodes, selector, pageUrl, page, url, tags."""
    for name, kind in {"nodes": "array<struct<target:array<string>>>", "tags": "array<string>"}.items():
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast(kind))
    for name in ("id", "ruleId", "impact", "description", "help", "helpUrl", "selector", "pageUrl", "page", "url"):
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast("string"))
    c = F.col
    target = F.array_join(F.get(c("nodes"), F.lit(0))["target"], ", ")
    return items.select(
        js_or(c("id"), c("ruleId"), "manual-check").alias("id"),
        js_or(c("impact"), "needs-review").alias("impact"),
        js_or(c("description"), c("help"), "Requiere revisión manual según WCAG 2.2.").alias("description"),
        js_or(c("helpUrl"), "https://www.w3.org/WAI/WCAG22/quickref/?showtechniques=es").alias("helpUrl"),
        F.lit("needs_review").alias("origen"),
        js_or(target, c("selector"), "(sin selector definido)").alias("selector"),
        js_or(c("pageUrl"), c("page"), c("url"), "(sin URL)").alias("page"),
        js_or(c("id"), c("ruleId"), "").alias("criterio"),
        js_or(F.get(F.filter("tags", lambda t: t.contains("wcag2")), F.lit(0)), "AA").alias("nivel"),
    )


def review_candidates(sitemap: DataFrame, interactive: DataFrame) -> DataFrame:
    """The review rows of both audits, one after the other; equal rows stay."""
    return review_rows(needs_review(sitemap)).unionByName(review_rows(needs_review(interactive)))
