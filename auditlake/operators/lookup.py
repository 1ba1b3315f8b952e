"""Rule lookup: from a rule id to its WCAG criterion, in four tiers.

Both dimensions are constants of this package (233 and 44 rows). Exact tiers are
broadcast joins with them, tiers by substring are expressions over the 44
numbers and the keywords, and the first tier that gives a criterion decides; so
a lookup adds columns to a row and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import dims
from auditlake.functions.js import first_match, js_trim

FIELDS = ["principio", "nivel", "criterio", "esperado", "resumen", "url"]


def normalized_rule(rule: Column, *, strict: bool = False) -> Column:
    """Lower case, one leading tool prefix and ``best-practice-`` removed, hyphens for underscores, trimmed.

    ``strict=True`` is the corrected variant: underscores of Pa11y codes stay, so that
    their equivalences can match.
    """
    plain = F.regexp_replace(F.lower(rule), r"^wcag\d{2}-|^axe-|^rule-", "")
    plain = F.regexp_replace(plain, "^best-practice-", "")
    return js_trim(plain if strict else F.translate(plain, "_", "-"))


def _keyed(rows: DataFrame, rule: str, normalized: str, *, strict: bool) -> DataFrame:
    """Adds ``_tier`` and ``_criterion`` for the ids in ``rule`` and their normal forms."""
    spark = rows.sparkSession
    numbers = [c for c, *_ in dims.criteria_rows()]
    there = set(numbers)
    known = spark.createDataFrame([(r, c) for r, c in dims.equivalence_rows() if c in there], "_k1_rule string, _k1 string")
    own = spark.createDataFrame([(c, c) for c in numbers], "_k2_rule string, _k2 string")
    found = rows.join(F.broadcast(known), F.col(normalized) == F.col("_k1_rule"), "left").join(F.broadcast(own), F.col(rule) == F.col("_k2_rule"), "left")
    none = F.lit(None).cast("string")
    order = sorted(numbers, key=len, reverse=True) if strict else numbers
    # as an array: 44 nested cases are more code than the JVM compiles; every number has a dot, most ids have none
    within = F.get(F.filter(F.array(*map(F.lit, order)), lambda c: F.col(normalized).contains(c)), F.lit(0))
    word = first_match([(F.col(normalized).contains(w), c) for w, c in dims.KEYWORDS], none)
    open_ = F.col("_k1").isNull() & F.col("_k2").isNull()
    found = found.withColumn("_k3", F.when(open_ & F.col(normalized).contains("."), within)).withColumn("_k4", F.when(open_ & F.col("_k3").isNull(), word))
    k = {t: F.col(f"_k{t}") for t in (1, 2, 3, 4)}
    tier = first_match([(k[t].isNotNull(), F.lit(t)) for t in (1, 2, 3, 4)], F.lit(0))
    return found.withColumns({"_tier": tier, "_criterion": F.coalesce(*k.values())}).drop("_k1_rule", "_k1", "_k2_rule", "_k2", "_k3", "_k4")


def _with_fields(rows: DataFrame, rule: str, names: dict[str, str]) -> DataFrame:
    """Adds the fields of ``_criterion`` under ``names``, or the default record's."""
    crit = dims.criteria(rows.sparkSession).select(F.col("criterion").alias("_key"), *(F.col(f).alias(f"_d_{f}") for f in FIELDS))
    summary = F.concat(F.lit("Regla sin correspondencia directa ("), F.col(rule), F.lit(")."))
    default = {k: F.lit(v) for k, v in dims.DEFAULT.items()} | {"resumen": summary}
    joined = rows.join(F.broadcast(crit), F.col("_criterion") == F.col("_key"), "left")
    fields = {names[f]: F.when(F.col(rule).isNotNull(), F.coalesce(F.col(f"_d_{f}"), default[f])) for f in FIELDS}
    return joined.withColumns(fields).drop("_key", *(f"_d_{f}" for f in FIELDS))


def resolve(rules: DataFrame, column: str = "rule", *, strict: bool = False) -> DataFrame:
    """Distinct non-empty ids of ``rules`` with normalized, engine, tier, criterion and the criterion's fields.

    Tier 1: equivalence whose criterion exists; 2: the id is a criterion; 3: the
    normalized id contains a criterion's number, the first in map order (or, if
    ``strict``, the longest); 4: keyword; 0: the default record.
    """
    ids = rules.select(F.col(column).cast("string").alias("rule")).where("rule != ''").distinct()
    ids = ids.withColumn("normalized", normalized_rule(F.col("rule"), strict=strict))
    out = _with_fields(_keyed(ids, "rule", "normalized", strict=strict), "rule", {f: f for f in FIELDS})
    engine = F.when(F.col("rule").contains("wcag2"), "pa11y").otherwise("axe-core")
    return out.select("rule", "normalized", engine.alias("lookup_engine"), F.col("_tier").alias("tier"), F.col("_criterion").alias("criterion"), *FIELDS)


def enrich(rows: DataFrame, key: Column, prefix: str = "w_", *, strict: bool = False) -> DataFrame:
    """Adds tier, criterion and the criterion's fields under ``prefix``; all null where the key is null or empty."""
    keyed = rows.withColumn("_rule", F.nullif(key, F.lit(""))).withColumn("_normalized", normalized_rule(F.col("_rule"), strict=strict))
    found = _with_fields(_keyed(keyed, "_rule", "_normalized", strict=strict), "_rule", {f: prefix + f for f in FIELDS})
    there = F.col("_rule").isNotNull()
    return found.withColumns({prefix + "tier": F.when(there, F.col("_tier")), prefix + "criterion": F.when(there, F.col("_criterion"))}).drop("_rule", "_normalized", "_tier", "_criterion")


def label(criterio: Column, nivel: Column) -> Column:
    """``criterio (nivel)``."""
    return F.concat(criterio, F.lit(" ("), nivel, F.lit(")"))
