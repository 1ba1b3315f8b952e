"""JSON array files of any size: one file that all tasks write, and that all tasks read.

A file is read as pieces that end with a closing brace, which Spark splits among
tasks as it splits lines. What a block of pieces means depends on whether it
begins within a string, and how deep; so blocks are summed up for both cases,
the driver chains the sums (a few numbers for each block), and in a second pass
every block cuts its own elements. Only elements that lie across blocks are put
together from their parts.
"""

from __future__ import annotations

import bisect
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.session import settled, ship

#: Bytes that a task copies at once into a file that all tasks write.
CHUNK = 64 << 20
_BLANK = " \t\n\r"
_SUMS = "path string, block long, size long, bytes long, odd boolean, deep array<long>, depths array<array<long>>, counts array<array<long>>"
_PARTS = "path string, idx long, last boolean, block long, whole boolean, text string"
_STEP = np.zeros(256, np.int64)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_MARKS = np.zeros(256, bool)
_MARKS[list(b"[]{},")] = True


def parses(text: Column) -> Column:
    """Whether the whole text is one JSON value. The parser overlooks what follows a value, but not within brackets."""
    within = [F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull() for a, b in (("[", "]"), ('{"v":', "}"))]
    return F.coalesce(F.try_parse_json(text).isNotNull() & within[0] & within[1], F.lit(False))


# Reading


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, bytes]]:
    """(path, block, size), whether the block begins, and bytes, for each run of a block's pieces. Every brace goes with what follows it."""
    now = None
    for b in batches:
        texts = b.column(3).cast(pa.large_binary() if pa.types.is_large_string(b.column(3).type) else pa.binary()).to_pylist()
        at = 0
        while at < len(texts):
            key = _key(b, at)
            # a block's pieces follow each other
            end = bisect.bisect_right(range(at, len(texts)), False, key=lambda k: _key(b, k) != key) + at
            begins = key != now
            yield key, begins, (b"" if begins and key[1] == 0 else b"}") + b"}".join(texts[at:end])
            now, at = key, end


def _key(batch: pa.RecordBatch, row: int) -> tuple[str, int, int]:
    return tuple(batch.column(c)[row].as_py() for c in range(3))


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of brackets and commas, their bytes, whether an odd number of quotes is before each, and the number of quotes."""
    a = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(a == 34)
    after = quotes[(quotes > 0) & (a[quotes - 1] == 92)]
    if len(after):  # a quote is escaped by an odd run of backslashes
        plain = np.flatnonzero(a != 92)
        before = np.searchsorted(plain, after) - 1
        run = after - 1 - np.where(before >= 0, plain[before], -1)
        quotes = np.setdiff1d(quotes, after[run % 2 == 1], assume_unique=True)
    at = np.flatnonzero(_MARKS[a])
    return at, a[at], np.searchsorted(quotes, at) % 2 == 1, len(quotes)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's sums if it begins outside a string, and if within one: its depth in the end, and its commas by depth."""
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("odd", pa.bool_()), ("deep", pa.list_(pa.int64())), ("depths", pa.list_(pa.list_(pa.int64()))), ("counts", pa.list_(pa.list_(pa.int64())))])

    def done(key, length, odd, deep, commas):
        row = [*key, length, odd, deep, [list(c) for c in commas], [list(c.values()) for c in commas]]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    now = None
    for key, begins, data in _blocks(batches):
        if begins:
            if now is not None:
                yield done(now, length, odd, deep, commas)
            now, length, odd, deep, commas = key, 0, False, [0, 0], [{}, {}]
        length += len(data)
        _, kinds, within, quotes = _marks(data)
        for h in (0, 1):
            live = kinds[within == (bool(h) != odd)]
            depth = deep[h] + np.cumsum(_STEP[live])
            for d, n in zip(*(x.tolist() for x in np.unique(depth[live == 44], return_counts=True)), strict=True):
                commas[h][d] = commas[h].get(d, 0) + n
            deep[h] = int(depth[-1]) if len(depth) else deep[h]
        odd ^= quotes % 2 == 1
    if now is not None:
        yield done(now, length, odd, deep, commas)


def _cutter(starts: dict):
    """Cuts blocks at the commas of depth one; ``starts`` has each block's state, its first element's number and its file's last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        now = None
        for key, begins, data in _blocks(batches):
            if key[:2] not in starts:
                continue
            if begins:
                if now is not None:
                    out.append((now[0], idx, idx == last, now[1], False, b"".join(rest)))
                now = key
                within_string, depth, idx, last = starts[key[:2]]
                whole, rest = key[1] == 0, []
            at, kinds, within, quotes = _marks(data)
            live = within == within_string
            at, kinds = at[live], kinds[live]
            depths = depth + np.cumsum(_STEP[kinds])
            begin = 0
            for cut in at[(kinds == 44) & (depths == 1)].tolist():
                rest.append(data[begin:cut])
                out.append((key[0], idx, False, key[1], whole, b"".join(rest)))
                idx, begin, whole, rest = idx + 1, cut + 1, True, []
            rest.append(data[begin:])
            depth = int(depths[-1]) if len(depths) else depth
            within_string ^= quotes % 2 == 1
            held += len(data)
            if held > CHUNK >> 3:
                yield _rows(out)
                out, held = [], 0
        if now is not None:
            out.append((now[0], idx, idx == last, now[1], False, b"".join(rest)))
        yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.large_string()]
    columns = [[r[c] for r in out] for c in range(5)] + [[r[5].decode("utf-8", "replace") for r in out]]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], ["path", "idx", "last", "block", "whole", "text"])


def _starts(sums: list) -> dict:
    """What each block begins with. A file of three bytes more than its text has a mark before it that JSON does not allow; it is left out."""
    files: dict[str, list] = {}
    for r in sums:
        files.setdefault(r["path"], []).append(r)
    out = {}
    for path, rows in files.items():
        if rows[0]["size"] - sum(r["bytes"] for r in rows) == 3:
            continue
        within, depth, idx, own = False, 0, 0, {}
        for r in sorted(rows, key=lambda r: r["block"]):
            own[path, r["block"]] = within, depth, idx
            idx += dict(zip(r["depths"][within], r["counts"][within], strict=True)).get(1 - depth, 0)
            depth += r["deep"][within]
            within ^= r["odd"]
        out |= {k: (*v, idx) for k, v in own.items()}
    return out


def array_elements(spark: SparkSession, where: str, keep: Column | None = None, **options) -> DataFrame:
    """path, idx and item (JSON text) of the elements of array files; other files and broken ones give none.

    ``keep`` picks files by ``path``. No task reads more than a split of a file.
    """
    ship(spark)
    read = spark.read.options(lineSep="}", **options).text(where)
    meta = {"path": "file_path", "block": "file_block_start", "size": "file_size"}
    pieces = read.select(*(F.col(f"_metadata.{v}").alias(k) for k, v in meta.items()), F.col("value"))
    pieces = pieces.where(keep) if keep is not None else pieces
    starts = _starts(pieces.mapInArrow(_sum, _SUMS).collect())  # a few numbers a block
    return _checked(settled(_framed(pieces.mapInArrow(_cutter(starts), _PARTS)), "elements"))


def _framed(parts: DataFrame) -> DataFrame:
    """path, idx, text and valid of every element, put together and without the array's brackets."""
    joined = parts.where(~F.col("whole")).groupBy("path", "idx").agg(F.bool_or("last").alias("last"), F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"))
    across = joined.select("path", "idx", "last", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    rows = parts.where("whole").select("path", "idx", "last", "text").unionByName(across)
    left = F.ltrim("text", F.lit(_BLANK))
    rows = rows.withColumn("text", F.when(F.col("idx") != 0, F.col("text")).when(left.startswith("["), F.substr(left, F.lit(2))))
    right = F.rtrim("text", F.lit(_BLANK))
    rows = rows.withColumn("text", F.when(~F.col("last"), F.col("text")).when(right.endswith("]"), F.substr(right, F.lit(1), F.length(right) - 1)))
    rows = rows.where(~(F.col("last") & (F.col("idx") == 0) & (F.btrim("text", F.lit(_BLANK)) == "")) | F.col("text").isNull())
    # one parse: if a mark that no text has comes second in the array, the text is one value and the array ends after it
    mark = uuid.uuid4().hex
    rows = rows.select("path", "idx", F.try_parse_json(F.concat(F.lit("["), "text", F.lit(f',"{mark}"]'))).alias("v"))
    valid = F.coalesce(F.try_variant_get("v", "$[1]", "string") == mark, F.lit(False))
    return rows.select("path", "idx", F.to_json(F.try_variant_get("v", "$[0]", "variant")).alias("item"), valid.alias("valid"))


def _checked(rows: DataFrame) -> DataFrame:
    broken = rows.where(~F.col("valid")).select("path").distinct()
    return rows.join(F.broadcast(broken), "path", "left_anti").select("path", "idx", "item")


# Writing


def local_path(uri: str) -> str | None:
    """The path of a URI on a file system that is mounted, else nothing."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def _copy(job: tuple[str, int, int, str, int]) -> None:
    """Copies ``length`` bytes of a part to their place. A task that runs twice writes the same bytes twice."""
    source, begin, length, target, at = job
    with open(source, "rb") as r, open(target, "r+b") as w:
        r.seek(begin)
        w.seek(at)
        while length:
            data = r.read(min(length, 1 << 20))
            if not data:
                raise OSError(f"{source} ends early")
            w.write(data)
            length -= len(data)


def join_parts(spark: SparkSession, parts: list[tuple[str, int]], target: str) -> None:
    """Makes one array file of text files (path and length) whose lines begin with commas.

    On a mounted file system all tasks copy, chunk by chunk; elsewhere the bytes
    stream through the driver, as other stores let only one writer into a file.
    """
    parts = [p for p in parts if p[1]]
    path = local_path(target)
    if path is None:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(target)
        store = where.getFileSystem(spark._jsc.hadoopConfiguration())
        out = store.create(where)
        out.write(ord("["))
        for k, (source, _) in enumerate(parts):
            part = store.open(jvm.org.apache.hadoop.fs.Path(source))
            if k == 0:
                part.read()
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
        out.write(ord("]"))
        out.write(ord("\n"))
        out.close()
        return
    jobs, at = [], 0
    for source, length in parts:
        for begin in range(0, length, CHUNK):
            jobs.append((local_path(source), begin, min(CHUNK, length - begin), path, at + begin))
        at += length
    with open(path, "wb") as out:
        out.truncate(at)
    if jobs:
        ship(spark)
        spark.sparkContext.parallelize(jobs, len(jobs)).foreach(_copy)
    with open(path, "r+b") as out:
        out.write(b"[")
        out.seek(max(at, 1))
        out.write(b"]\n")
        out.flush()
        os.fsync(out.fileno())
