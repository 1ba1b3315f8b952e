"""Helpers shared by the operators of this subpackage.

Every table that an operator reads more than once is written to the folder
named by ``spark.checkpoint.dir`` and read again, so that a lost executor costs
a re-read and never a recomputation chain.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at once in Python, so that long texts do not pile up.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the stored tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only on a local master, where
    one machine does everything, may it be unset; a temporary folder is then made
    and set. Elsewhere an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="auditlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", found):  # as Spark would take it
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        found = default.rstrip("/") + "/" + found.lstrip("/") if not default.startswith("file:") else f"file://{os.path.abspath(found)}"
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again; this cuts its lineage."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts_utf8(column: pa.Array) -> list[bytes | None]:
    """The strings of an Arrow column as UTF-8, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def crc_of_id(column: str) -> Column:
    """crc32 of an integer id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


# Files that Spark's own writers cannot make (archives, succinct indexes).


def _local(uri: str) -> str | None:
    """The path of a URI on the local file system; a path without a scheme is one."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def _store(uri: str):
    """pyarrow's file system and path of a URI; Hadoop's names of object stores are known too."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def write_file(uri: str, data: bytes) -> None:
    """Writes a whole file under a name of this attempt, then renames it.

    A task that runs twice leaves two complete files or one, never half a file.
    """
    part = f"{uri}.{uuid.uuid4().hex}"
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(part), "wb") as out:
            out.write(data)
        os.replace(_local(part), path)
        return
    store, path = _store(uri)
    _, part = _store(part)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(part) as out:
        out.write(data)
    try:
        store.move(part, path)
    except OSError:  # some stores do not move onto a file that another attempt has left
        store.delete_file(path)
        store.move(part, path)


def read_file(uri: str) -> bytes:
    """The bytes of a whole file in the shared folder."""
    if (path := _local(uri)) is not None:
        with open(path, "rb") as source:
            return source.read()
    store, path = _store(uri)
    with store.open_input_stream(path) as source:
        return source.read()
