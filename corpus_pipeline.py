"""A training-corpus pipeline: toxicity, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), reads what its predecessor kept, and
returns the rows that it keeps with the columns of ``docs``; the last returns
the pieces and their places in the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.common import fresh_path, table
from auditlake.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score of 0.3 or more) go."""
    from auditlake.llm.toxicity import accepted, fit

    ship(spark)
    return accepted(docs, fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id stays.

    Shingles of five words; all pairs of Jaccard similarity 0.8 or more are linked.
    """
    from auditlake.llm.jaccard import one_of_each

    ship(spark)
    return one_of_each(docs, shingle=5, threshold=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    from auditlake.llm.decontam import uncontaminated

    ship(spark)
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left into sequences of 2048 tokens."""
    import public_tokenizers

    from auditlake.llm.packing import pack

    ship(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), words=200_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: No stage but the third can be said in SQL (learned model, XXH64, BPE); see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
