"""Findings as a stream of files: the batch operators over ``readStream``.

An addition of this engine: raw findings that appear in a folder pass once within
a watermark, counts by window grow, and batches are merged into a table of
canonical findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.dedup import MERGE_KEY, first_wins
from auditlake.operators.normalize import canonical
from auditlake.sources.sinks import exists


def read_events(spark: SparkSession, folder: str, schema: str, *, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def deduplicated(raw: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """Raw findings with ``ts``; of those with equal source, page, selector, id and impact within ``delay`` one passes."""
    keys = ["source", "pageUrl", "selector", "id", "impact"]
    return raw.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, *, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Findings by window, source and engine."""
    return rows.withWatermark("ts", delay).groupBy(F.window("ts", window), "source", "engine").agg(F.count("*").alias("n"))


def merge_into(path: str, *, order: str = "ts"):
    """For ``foreachBatch``: merges a batch's canonical findings into the table at ``path``.

    Of equal findings the first by ``order`` stays, within the batch and, since
    earlier batches are there already, over all. A batch is a folder of its own,
    named by its number and written anew if the batch is run again; findings that
    other batches hold are left out, so that a replay changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        raw = batch.withColumn("_ord", F.struct(F.col(order), F.xxhash64(*(F.col(c) for c in sorted(batch.columns)))))
        rows = first_wins(canonical(raw), MERGE_KEY).drop("_ord")
        if exists(spark, path):
            stored = spark.read.parquet(path)
            if "batch" in stored.columns:
                known = stored.where(F.col("batch") != number).select(*MERGE_KEY)
                same = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in MERGE_KEY]
                rows = rows.alias("n").join(known.alias("k"), same, "left_anti")
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return run
