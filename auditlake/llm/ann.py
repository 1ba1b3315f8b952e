"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are scaled to unit length, moved by the mean, turned by a random
rotation and stored as the signs of their coordinates, with three scalars: the
residual's length, its inner product with the code, and the vector's inner
product with the mean. Of each query a table of partial sums for every byte of a
code is made, so that an inner product is read off the packed bits by one lookup
a byte; with the scalars it gives an estimate of the cosine and a bound of its
error, which shrinks with the square root of the dimension. Only vectors whose
upper bound reaches the best scores known so far are reranked on the original
vectors.

Queries are stored in blocks of checked size; one job takes each partition of
the codes through all blocks. Of equal vectors only as many rows can be among
the nearest as are asked for, those with the smallest ids; the rest never enter
the index. Vectors of different dimensions have no cosine: each dimension is
searched by itself.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import fresh_path, materialize, read_file, slices, write_file


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of rows that can take part.

    Left out: null ids, null or empty vectors, vectors with a null or non-finite
    component, and zero vectors.
    """
    own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("embedding", lambda x: x != 0)
    return own.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def mean_direction(vectors: DataFrame) -> np.ndarray:
    """The mean of all vectors scaled to unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                part = (x / np.linalg.norm(x, axis=1, keepdims=True)).sum(axis=0)
                total, n = part if total is None else total + part, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total), pa.array([n] * len(total), pa.int64())], ["k", "s", "n"])

    rows = vectors.select("embedding").mapInArrow(run, "k int, s double, n long").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("m")).orderBy("k").collect()
    return np.array([r["m"] for r in rows])  # as many numbers as a vector has


def encode(vectors: DataFrame, mean: np.ndarray, turn: np.ndarray) -> DataFrame:
    """The index: vec_id, embedding, code (packed bits), length, agree, toward."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 4096):
                x = _matrix(part.column(1))
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                rest = unit - mean
                length = np.linalg.norm(rest, axis=1)
                turned = rest.astype(np.float32) @ turn
                agree = np.abs(turned).sum(axis=1) / (math.sqrt(x.shape[1]) * np.maximum(length, 1e-12))
                codes = np.packbits(turned >= 0, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(agree.astype(float)), pa.array(unit @ mean)],
                    ["vec_id", "embedding", "code", "length", "agree", "toward"],
                )

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>, code binary, length double, agree double, toward double")


def byte_sums(turned: np.ndarray) -> np.ndarray:
    """For each query (row), byte of a code and value of that byte: the sum of the coordinates, each with the sign that its bit says."""
    n, d = turned.shape
    padded = np.zeros((n, -(-d // 8) * 8), np.float32)
    padded[:, :d] = turned
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1
    return padded.reshape(n, -1, 8) @ signs.T


class _Block:
    """The best rows found so far for a block of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, mean: np.ndarray, turn: np.ndarray, k: int, sigmas: float) -> None:
        self.ids, self.queries, self.k, self.sigmas, self.d = ids, queries, k, sigmas, queries.shape[1]
        self.norms = np.sqrt((queries * queries).sum(axis=1))
        unit = queries / self.norms[:, None]
        rest = unit - mean
        self.length = np.linalg.norm(rest, axis=1)
        self.sums = byte_sums(rest.astype(np.float32) @ turn)
        self.shift = unit @ mean - mean @ mean
        self.best = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, vec_ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, length: np.ndarray, agree: np.ndarray, toward: np.ndarray) -> None:
        """Takes the rows in whose upper bounds reach what a query has."""
        k, d = self.k, self.d
        inner = np.zeros((len(self.ids), len(vec_ids)), np.float32)  # rows: queries, columns: vectors
        for byte in range(codes.shape[1]):
            inner += self.sums[:, byte].take(codes[:, byte], axis=1)
        safe = np.maximum(agree, 1e-6)
        estimate = inner * (length / safe / math.sqrt(d)).astype(np.float32) + toward.astype(np.float32) + self.shift[:, None].astype(np.float32)
        spread = self.sigmas * length * np.sqrt(np.maximum(1 - safe * safe, 0)) / safe / math.sqrt(max(d - 1, 1))
        error = (self.length[:, None] * spread + 1e-5).astype(np.float32)
        least = self.best[:, -1]
        if len(vec_ids) >= k:
            least = np.maximum(least, np.partition(estimate - error, len(vec_ids) - k, axis=1)[:, len(vec_ids) - k])
        q, v = np.nonzero(estimate + error >= least[:, None])
        if not len(q):
            return
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        exact = np.empty(len(q))
        for at in range(0, len(q), 65536):
            r, c = v[at : at + 65536], q[at : at + 65536]
            exact[at : at + 65536] = np.einsum("ij,ij->i", vectors[r], self.queries[c]) / (lengths[r] * self.norms[c])
        touched = np.unique(q)
        all_q = np.concatenate([np.repeat(touched, k), q])
        all_s = np.concatenate([self.best[touched].ravel(), exact])
        all_v = np.concatenate([self.found[touched].ravel(), vec_ids[v]])
        order = np.lexsort((all_v, -all_s, all_q))
        take = order[np.searchsorted(all_q[order], touched)[:, None] + np.arange(k)[None, :]]
        self.best[touched], self.found[touched] = all_s[take], all_v[take]

    def rows(self) -> pa.RecordBatch:
        q, j = np.nonzero(np.isfinite(self.best))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.found[q, j]), pa.array(self.best[q, j])], ["query_id", "vec_id", "score"])


def _search(paths: list[str], mean: np.ndarray, turn: np.ndarray, k: int, sigmas: float, held_rows: int = 65536):
    """The k best rows of every ``held_rows`` codes for each query of all blocks."""

    def blocks() -> Iterator[_Block]:
        for path in paths:
            with np.load(io.BytesIO(read_file(path))) as data:
                yield _Block(data["ids"], data["queries"], mean, turn, k, sigmas)

    def through(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p for b in held for p in slices(b, 1024)]
        parts = [(p.column(0).to_numpy(), _matrix(p.column(1)), np.frombuffer(b"".join(p.column(2).to_pylist()), np.uint8).reshape(p.num_rows, -1), *(p.column(c).to_numpy() for c in (3, 4, 5))) for p in parts]
        for block in blocks():
            for part in parts:
                block.meet(*part)
            yield block.rows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= held_rows:
                yield from through(held)
                held, n = [], 0
        if n:
            yield from through(held)

    return run


def _top(df: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_NEAREST = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, *, every: int = 50, k: int = 5, sigmas: float = 3.0, block_bytes: int = 1 << 20, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows of every row whose vec_id is divisible by ``every``.

    Ties go to the smaller vec_id. Rows that ``usable`` leaves out are neither
    queries nor candidates; a table without usable rows gives none. Ids are taken
    as unique; a repeated row counts as a candidate each time. Other columns are
    not read.
    """
    rows = materialize(usable(vectors), "vectors")
    dims = [r[0] for r in rows.select(F.size("embedding")).distinct().collect()]  # lengths of arrays, no more than there are widths
    out = None
    for d in sorted(dims):
        part = _nearest(rows if len(dims) == 1 else rows.where(F.size("embedding") == d), every, k, sigmas, block_bytes, seed)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return vectors.sparkSession.createDataFrame([], _NEAREST) if out is None else out


def _nearest(rows: DataFrame, every: int, k: int, sigmas: float, block_bytes: int, seed: int) -> DataFrame | None:
    """Of vectors of one dimension; None without queries."""
    asked = rows.where(F.col("vec_id") % every == 0)
    # equal queries are searched once
    once = materialize(asked.groupBy("embedding").agg(F.min("vec_id").alias("query_id")), "queries")
    n = once.count()
    if not n:
        return None
    mean = mean_direction(rows)
    turn = rotation(len(mean), seed)
    equal = Window.partitionBy("embedding").orderBy("vec_id")
    kept = rows.withColumn("_n", F.row_number().over(equal)).where(F.col("_n") <= k + 1).drop("_n")
    index = materialize(encode(kept, mean, turn), "codes")
    blocks, home, paths = max(1, math.ceil(n * 8 * len(mean) / block_bytes)), fresh_path(rows.sparkSession, "query_blocks"), []
    for b in range(blocks):
        own = once.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").collect()  # about block_bytes
        if own:
            data = io.BytesIO()
            np.savez(data, ids=np.array([r["query_id"] for r in own]), queries=np.array([r["embedding"] for r in own]))
            paths.append(f"{home}/{b:06d}.npz")
            write_file(paths[-1], data.getvalue())
    found = index.mapInArrow(_search(paths, mean, turn, k + 1, sigmas), "query_id long, vec_id long, score double")
    found = materialize(_top(found, k + 1).drop("rank"), "nearest")
    members = asked.join(once, "embedding").select(F.col("vec_id").alias("member"), "query_id")
    each = found.join(members, "query_id").where("vec_id != member").select(F.col("member").alias("query_id"), "vec_id", "score")
    return _top(each, k).select("query_id", "rank", "vec_id", "score")
