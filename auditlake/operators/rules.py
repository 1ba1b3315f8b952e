"""Rule sets of audit payloads: extraction, set algebra, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.js import js_or, pad_end
from auditlake.operators.lookup import resolve
from auditlake.operators.metrics import coverage


def extract_rules(payload: DataFrame) -> DataFrame:
    """Distinct rules of rows with any of id, ruleId, code, violations[id, ruleId], results[code, type]."""
    has, parts = set(payload.columns), []
    parts += [payload.select(F.col(c).alias("rule")) for c in ("id", "ruleId", "code") if c in has]
    if "violations" in has:
        parts.append(payload.select(F.explode("violations").alias("v")).select(js_or(F.col("v.id"), F.col("v.ruleId")).alias("rule")))
    if "results" in has:
        r = payload.select(F.explode("results").alias("r"))
        parts += [r.select(F.col(f"r.{c}").alias("rule")) for c in ("code", "type")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("rule != ''").distinct()


def union_rules(axe: DataFrame, pa11y: DataFrame) -> DataFrame:
    return axe.union(pa11y).distinct()


def both_engines(axe: DataFrame, pa11y: DataFrame) -> DataFrame:
    return axe.intersect(pa11y)


def mapped(rules: DataFrame) -> DataFrame:
    """Rules with a criterion."""
    found = resolve(rules)
    return found.where(~F.col("criterio").rlike("(?i)no identificado"))


def unmapped(rules: DataFrame) -> DataFrame:
    return rules.join(mapped(rules).select("rule"), "rule", "left_anti")


def coverage_report(rules: DataFrame) -> DataFrame:
    """One row: rules, mapped, unmapped, percentage to two decimals."""
    hit = (~F.col("criterio").rlike("(?i)no identificado")).cast("long")
    sums = resolve(rules).agg(F.count("*").alias("rules"), F.coalesce(F.sum(hit), F.lit(0)).alias("mapped"))
    return sums.select("rules", "mapped", (F.col("rules") - F.col("mapped")).alias("unmapped"), coverage(F.col("mapped"), F.col("rules"), 2).alias("pct"))


def details(rules: DataFrame) -> DataFrame:
    """Criterion, level and principle of each rule, with dashes for what is missing, and the report's line."""
    d = resolve(rules).select("rule", *(js_or(F.col(c), "—").alias(c) for c in ("criterio", "nivel", "principio")))
    line = F.concat(pad_end(F.col("rule"), 50), F.lit(" → "), pad_end(F.col("criterio"), 30), F.lit(" Nivel: "), F.col("nivel"), F.lit("  ("), F.col("principio"), F.lit(")"))
    return d.withColumn("line", line)
