"""SimHash near-duplicates by a generalised pigeonhole search.

A fingerprint has 64 bits. They are grouped into partitions so that correlated
bits stand together, and partition i gets a threshold t_i with
sum(t_i) = limit - partitions + 1: two fingerprints at distance ``limit`` or
less then agree to within t_i in at least one partition. A threshold of -1
leaves a partition out. Dynamic programming picks the thresholds, and a loop
the number of partitions, by the candidate counts expected from the bits'
statistics over all fingerprints. Probes are the partition's value and its
variants within t_i; candidates are verified on all 64 bits.

Only links that connect something new leave a bucket (a spanning forest), so a
bucket of m fingerprints yields at most m - 1 rows. Buckets above ``block``
fingerprints are cut into blocks that are compared two by two in different
tasks. Components are found by alternating large-star and small-star steps on
tables in the shared folder.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import materialize, slices, texts_utf8

BITS = 64


def fingerprint_of(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the hashes of all word shingles, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    joined = b" ".join
    hashes = np.fromiter((digest(joined(s), seed) for s in zip(*(words[k:] for k in range(size)), strict=False)), np.uint64, len(words) - size + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit integer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint_of(t, shingle, seed) for t in texts_utf8(part.column(1))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


# Statistics and plan


def _unpacked(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j both set: 64 x 64 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            fps = b.column(0).to_numpy()
            for at in range(0, len(fps), 16384):
                x = _unpacked(fps[at : at + 16384]).astype(np.float32)
                both += x.T @ x
                n += len(x)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array([*(i * BITS + j), -1], pa.int32()), pa.array([*both[i, j].astype(np.int64), n], pa.int64())], ["ij", "n"])

    out, total = np.zeros((BITS, BITS)), 0
    for r in distinct.select("fp").mapInArrow(run, "ij int, n long").groupBy("ij").agg(F.sum("n").alias("n")).collect():
        if r["ij"] < 0:
            total = r["n"]
        else:
            out[r["ij"] // BITS, r["ij"] % BITS] = out[r["ij"] % BITS, r["ij"] // BITS] = r["n"]
    return total, out


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal size; each takes the free bits that correlate most with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        own = [max(free, key=lambda b: (r[b, list(free)].sum(), -b))]
        free.discard(own[0])
        while len(own) < size:
            own.append(max(free, key=lambda b: (r[b, own].mean(), -b)))
            free.discard(own[-1])
        out.append(sorted(own))
    return out


def expected_pairs(n: int, differ: np.ndarray, most: int) -> list[float]:
    """Pairs within distance 0, 1, ... ``most`` on bits that differ with the given chances.

    Bits are taken as independent. Those of a group are not, as they are grouped by
    correlation, so real counts are higher; the plan only compares them.
    """
    ways = np.zeros(most + 1)
    ways[0] = 1
    for d in differ:
        ways[1:] = ways[1:] * (1 - d) + ways[:-1] * d
        ways[0] *= 1 - d
    return [n * n / 2 * x for x in np.cumsum(ways)]


def allocate(costs: list[list[float]], limit: int) -> tuple[float, list[int]]:
    """Thresholds from -1 with sum limit - partitions + 1 and the least total cost; costs[i][t + 1] is for threshold t."""
    target = limit - len(costs) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        best = {
            total: min((c + own[t + 1], [*ts, t]) for before, (c, ts) in best.items() for t in range(-1, len(own) - 1) if before + t == total)
            for total in {before + t for before in best for t in range(-1, len(own) - 1)}
        }
    return best[target]


def plan(n: int, both: np.ndarray, limit: int = 3, sizes: tuple[int, ...] = (2, 3, 4, 5)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed."""
    p = np.diag(both) / max(n, 1)
    differ, best = 2 * p * (1 - p), None
    for m in sizes:
        groups = group_bits(n, both, m)
        most = max(0, limit - m + 1 + (m - 1))
        costs = []
        for g in groups:
            pairs = expected_pairs(n, differ[g], most)
            # a probe is shuffled and sorted, a candidate is one xor: 40 to 1
            costs.append([0.0, *(40.0 * n * sum(math.comb(len(g), e) for e in range(t + 1)) + pairs[t] for t in range(most + 1))])
        cost, ts = allocate(costs, limit)
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0])
    return best[1]


# Probing and links


def _masks(bits: list[int], threshold: int) -> np.ndarray:
    flips = [sum(1 << b for b in c) for e in range(threshold + 1) for c in itertools.combinations(bits, e)]
    return np.array(flips, np.uint64)


def _probes(parts: list[tuple[list[int], int]]):
    """Rows (part, key, fp): the fingerprint's own bits in the partition, and their variants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(np.uint64(sum(1 << b for b in bits)), _masks(bits, t)) for bits, t in parts]
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for k, (mask, flips) in enumerate(known):
                step = max(1, 65536 // len(flips))
                for at in range(0, len(fps), step):
                    part = fps[at : at + step]
                    keys = ((part & mask)[:, None] ^ flips[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], ["part", "key", "fp"]
                    )

    return run


def forest(fps: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(fingerprint, smallest of its group) for the groups that links of ``limit`` bits or fewer make; singles give none."""
    if len(fps) <= 24:
        plain, root = fps.view(np.uint64).tolist(), list(range(len(fps)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, a in enumerate(plain):
            for j in range(i):
                if (a ^ plain[j]).bit_count() <= limit:
                    root[max(find(i), find(j))] = min(find(i), find(j))
        low: dict[int, int] = {}
        for i in range(len(fps)):
            low[find(i)] = min(low.get(find(i), int(fps[i])), int(fps[i]))
        yield from ((int(fps[i]), low[find(i)]) for i in range(len(fps)) if int(fps[i]) != low[find(i)])
        return
    rest = np.unique(fps.view(np.uint64))
    while len(rest) > 1:
        group, front, rest = [rest[:1]], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for f in front:
                near |= np.bitwise_count(rest ^ f) <= limit
                if near.all():
                    break
            front, rest = rest[near], rest[~near]
            group.append(front)
        own = np.concatenate(group).view(np.int64)
        low = own.min()
        yield from ((int(f), int(low)) for f in own if f != low)


def _links(limit: int):
    """Runs of equal (part, key, pair) in sorted rows become the edges of their forests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                if tail is None:
                    return
                rows, last = tail, True
            else:
                if not batch.num_rows:
                    continue
                new = [batch.column(k).to_numpy() for k in range(4)]
                rows, last = [np.concatenate(x) for x in zip(tail, new, strict=True)] if tail else new, False
            part, key, pair, fps = rows
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
            ends = [*cuts.tolist(), *([len(fps)] if last else [])]
            edges, start = set(), 0
            for end in ends:
                if end - start > 1:
                    edges.update(forest(np.unique(fps[start:end]), limit))
                start = end
            tail = None if last else [x[start:] for x in rows]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], ["u", "v"])

    return run


def links(distinct: DataFrame, parts: list[tuple[list[int], int]], *, limit: int = 3, block: int = 2048) -> DataFrame:
    """Edges (u, v) with u > v or u != v between fingerprints, enough to connect all that are linked."""
    probes = distinct.select("fp").mapInArrow(_probes(parts), "part int, key long, fp long")
    large = probes.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = materialize(large.select("part", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large")
    joined = probes.join(large, ["part", "key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # a fingerprint of block b goes to every pair of blocks that holds b
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    dealt = joined.select("part", "key", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("pair"), "fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "part", "key", "pair").sortWithinPartitions("part", "key", "pair").mapInArrow(_links(limit), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of a table of edges (u, v) of 64-bit integers, roots being the smallest nodes.

    Large-star and small-star steps alternate until nothing changes; each step
    is a table in the shared folder.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def lowest(df: DataFrame) -> DataFrame:
        return materialize(df.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")

    edges = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "large_star")
        low = lowest(large)
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u != v").distinct(), "small_star")
        before, after = state(edges), before
        if before == after:
            break
    return edges.select("u", F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, *, shingle: int = 3, seed: int = 42, limit: int = 3, block: int = 2048) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every document.

    Null and empty texts have the fingerprint zero and are linked like any
    other; very long texts are read whole. Rows with a null doc_id keep their
    component's id, or null if no row of it has one. Repeated rows stay. An empty
    table gives no rows; columns besides doc_id and text are not read.
    """
    fps = materialize(fingerprints(docs, shingle=shingle, seed=seed), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    n, both = bit_counts(distinct)
    if not n:
        return fps.withColumn("component_id", F.col("doc_id"))
    roots = components(links(distinct, plan(n, both, limit), limit=limit, block=block))
    linked = distinct.join(roots, F.col("fp") == F.col("u"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    linked = materialize(linked, "linked")
    lows = materialize(linked.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    of_fp = materialize(linked.join(lows, "root").select("fp", "component_id"), "of_fp")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def survivors(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` but for all documents of a component besides the one with the smallest doc_id.

    It decides by ids: repeated rows of an id that stays all stay, and so do rows
    without an id. ``jaccard.one_of_each`` decides by rows.
    """
    found = near_duplicates(docs, **options)
    gone = materialize(found.where("doc_id != component_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def hex_of(column: str) -> Column:
    """16 lower-case hex digits of a signed 64-bit integer."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
