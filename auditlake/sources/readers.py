"""Readers of finding files, inventories and captures.

Rows carry ``_ord``, a struct of source rank, file and index in the file, since
the order of files and of their elements decides which of equal findings stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.js import contains_any, js_or, js_trim
from auditlake.operators.normalize import RAW
from auditlake.sources.arrays import array_elements, parses
from auditlake.sources.sinks import exists

SOURCES = {"sitemap": r"(?i)sitemap", "interactiva": r"(?i)interactiva", "manual": r"(?i)needs_review|manual"}
EXCLUDED = ["merged", "summary", "export", "results-merged"]


def json_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of all JSON files below a folder; none if it is missing."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, text string")
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    return read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def wanted(path: Column) -> Column:
    """Not a merged, summary or export file nor a URL list."""
    return ~contains_any(path, EXCLUDED) & ~path.endswith("urls.json")


def repair(text: Column) -> Column:
    """JSON text with glued objects, glued arrays, trailing commas or open arrays mended; valid text stays."""
    fixed = F.translate(text, "\n", "")
    fixed = F.regexp_replace(fixed, r"\}\s*\{", "},{")
    fixed = F.regexp_replace(fixed, r"\]\s*\[", ",")
    fixed = js_trim(F.regexp_replace(fixed, r",\s*\]", "]"))
    fixed = F.when(fixed.startswith("["), fixed).otherwise(F.concat(F.lit("["), fixed))
    fixed = F.when(fixed.endswith("]"), fixed).otherwise(F.concat(fixed, F.lit("]")))
    return F.when(parses(text), text).otherwise(fixed)


def elements(files: DataFrame, *, mend: bool = False) -> DataFrame:
    """path, idx and item (JSON text) of the elements of array files; others and broken ones give none. Nested arrays are flattened once if ``mend``."""
    text = repair(F.col("text")) if mend else F.col("text")
    # the path of files that are not arrays is skipped, as is text that does not parse
    whole = F.when(parses(text) & F.schema_of_variant(F.try_parse_json(text)).startswith("ARRAY"), F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"))
    rows = files.select("path", F.posexplode(whole).alias("idx", "v"))
    if mend:
        nested = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
        rows = rows.select("path", "idx", F.posexplode(nested).alias("sub", "v"))
        return rows.select("path", (F.col("idx").cast("long") * (1 << 32) + F.col("sub")).alias("idx"), F.to_json("v").alias("item"))
    return rows.select("path", F.col("idx").cast("long").alias("idx"), F.to_json("v").alias("item"))


def raw_findings(spark: SparkSession, folder: str) -> DataFrame:
    """All raw findings below a folder; a file may belong to several sources, and is read and parsed once.

    A row whose id or impact is no text ends its file, rows before it stay.
    """
    told = [F.when(F.col("path").rlike(pattern), F.struct(F.lit(rank).alias("rank"), F.lit(source).alias("source"))) for rank, (source, pattern) in enumerate(SOURCES.items())]
    value = lambda f: F.get_json_object("item", f"$.{f}")
    kind = lambda f: F.schema_of_variant(F.try_variant_get(F.try_parse_json("item"), f"$.{f}", "variant"))
    odd = lambda f: value(f).isNotNull() & kind(f).rlike("^(BIGINT|DOUBLE|DECIMAL|BOOLEAN|ARRAY|OBJECT)")
    if not exists(spark, folder):
        items = spark.createDataFrame([], "path string, idx long, item string")
    else:
        items = array_elements(spark, folder, wanted(F.col("path")), recursiveFileLookup=True, pathGlobFilter="*.json")
    # the first bad row of a file
    ends = items.where(odd("id") | odd("impact")).groupBy("path").agg(F.min("idx").alias("end"))
    kept = items.join(F.broadcast(ends), "path", "left").where("end is null or idx < end")
    rows = kept.withColumn("s", F.explode(F.array_compact(F.array(*told))))
    order = F.struct(F.col("s.rank").alias("src"), F.col("path").alias("file"), "idx").alias("_ord")
    return rows.select(order, F.col("s.source").alias("source"), "path", F.col("item").alias("_raw"), *(text_value("item", f).alias(f) for f in RAW))


def text_value(item: str, field: str) -> Column:
    """A field's text; JSON's false and 0 count as absent, as an empty text does."""
    value = F.get_json_object(item, f"$.{field}")
    plain = F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col(item)), f"$.{field}", "variant"))
    falsy = (plain.isin("BOOLEAN") & (value == "false")) | (plain.rlike("^(BIGINT|DOUBLE|DECIMAL)") & (value.try_cast("double") == 0))
    return F.when(~F.coalesce(falsy, F.lit(False)), value)


def read_object(spark: SparkSession, path: str) -> DataFrame:
    """text of the JSON object in a file; no row if the file is missing or holds anything else."""
    if not exists(spark, path):
        return spark.createDataFrame([], "text string")
    found = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    return found.where(parses(F.col("text")) & F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT"))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """url and title of an inventory of objects or plain strings, with their order."""
    rows = array_elements(spark, path)
    plain = F.try_variant_get(F.try_parse_json("item"), "$", "string")
    is_text = F.col("item").startswith('"')
    url = F.when(is_text, plain).otherwise(F.get_json_object("item", "$.url"))
    return rows.select(url.alias("url"), F.when(~is_text, F.get_json_object("item", "$.title")).alias("title"), F.col("idx").alias("_ord")).where(js_or(F.col("url")).isNotNull())


def listing(spark: SparkSession, folder: str, glob: str = "*", *, recursive: bool = True) -> DataFrame:
    """path, name and modified of files; contents are not read."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, name string, modified timestamp")
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    return read.load(folder).select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("modificationTime").alias("modified"))


def captures(spark: SparkSession, *folders: str) -> DataFrame:
    """PNG files of the folders, one folder after another, by path; pos is their order."""
    out = None
    for k, folder in enumerate(folders):
        own = listing(spark, folder, "*.png").select("path", F.struct(F.lit(k).alias("folder"), "path").alias("pos"))
        out = own if out is None else out.unionByName(own)
    return out


def count_png(spark: SparkSession, folder: str) -> int:
    """PNG files directly in a folder; 0 if it is missing."""
    return listing(spark, folder, "*.png", recursive=False).count()


def latest(files: DataFrame, by: str = "modified") -> str | None:
    """The path of the file modified last, or of the last by name."""
    return files.agg(F.max_by("path", by).alias("p")).first()["p"]


def first_that_exists(spark: SparkSession, *paths: str) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)
