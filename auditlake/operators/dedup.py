"""Order-dependent deduplication and grouping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.js import contains_any, js_or

MERGE_KEY = ["pageUrl", "selector", "wcag", "resultadoActual", "source"]
REPEATED = ["header", "footer", "cookie", "gdpr", "nav", "main-menu", "site-header", "site-footer"]


def first_wins(rows: DataFrame, keys: list[str | Column], order: str = "_ord") -> DataFrame:
    """The first row of each key. One shuffle; Spark cuts each group to its first row before it."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merge_dedup(findings: DataFrame) -> DataFrame:
    """First wins by page, selector, criterion, result and source; neither id nor engine count."""
    return first_wins(findings, MERGE_KEY)


def audit_key() -> Column:
    """engine-id-page-selector joined by hyphens, as one string (so values with hyphens can collide)."""
    return F.concat_ws("-", *(F.coalesce(F.col(c), F.lit("undefined")) for c in ("engine", "id", "pageUrl", "selector")))


def audit_dedup(rows: DataFrame) -> DataFrame:
    return first_wins(rows, [audit_key()])


def grouped(findings: DataFrame) -> DataFrame:
    """One row for each id and page: the first row's fields, and all instances in order.

    An instance list is as long as one rule's findings on one page.
    """
    key = F.concat(js_or(F.col("id"), "sin_id"), F.lit("::"), F.coalesce(F.col("pageUrl"), F.lit("undefined")))
    instance = F.struct("_ord", "selector", js_or(F.col("context"), "").alias("context"), "engine")
    first = F.struct(*(F.col(c) for c in findings.columns))
    agg = findings.groupBy(key.alias("group_key")).agg(F.min_by(first, "_ord").alias("f"), F.sort_array(F.collect_list(instance)).alias("i"))
    return agg.select("group_key", "f.*", F.transform("i", lambda x: F.struct(x["selector"].alias("selector"), x["context"].alias("context"), x["engine"].alias("engine"))).alias("instances"))


def duplicate_ids(findings: DataFrame) -> DataFrame:
    """Ids seen at least twice, on whatever pages."""
    return findings.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def numbered(pages: DataFrame, order: str = "_ord", partition: list[str] | None = None) -> DataFrame:
    """Adds ``index`` 1..n within ``partition`` (the whole table only if none is given: small tables)."""
    return pages.withColumn("index", F.row_number().over(Window.partitionBy(*(partition or [F.lit(0)])).orderBy(order)))


def capture_fold(findings: DataFrame) -> DataFrame:
    """_ord and captured: false where the selector is a repeated element, contains an accepted selector or is contained in one.

    The fold is global and depends on order, so what it sees is cut down first:
    of equal selectors only the first can be accepted. The distinct selectors
    that are left are folded in order in one task.
    """
    named = findings.select("_ord", js_or(F.col("selector"), "body").alias("selector"))
    firsts = named.where(~contains_any(F.col("selector"), REPEATED)).groupBy("selector").agg(F.min("_ord").alias("_ord"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        accepted: list[str] = []
        for pdf in batches:
            flags = []
            for s in pdf["selector"]:
                fresh = not any(a in s or s in a for a in accepted)
                if fresh:
                    accepted.append(s)
                flags.append(fresh)
            yield pd.DataFrame({"_ord": pdf["_ord"], "captured": flags})

    kind = dict(named.dtypes)["_ord"]
    taken = firsts.repartition(1).sortWithinPartitions("_ord").mapInPandas(fold, f"_ord {kind}, captured boolean")
    return named.join(taken, "_ord", "left").select("_ord", "selector", F.coalesce("captured", F.lit(False)).alias("captured"))
