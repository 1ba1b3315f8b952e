"""SimHash near-duplicates of whole texts, completed and verified by Jaccard similarity.

Rows with the same set of word shingles are one node. Candidates are what the
SimHash search finds (64-bit fingerprints of the sets, generalised pigeonhole),
and, because near copies often differ in more bits than it allows, what a
prefix filter adds: two sets of similarity ``t`` share a shingle among the first
n - ceil(t n) + 1 of each in any common order, so all pairs meet in a bucket of
such a shingle. The order puts shingles last that many documents hold, which
only keeps buckets small. Pairs in a bucket must fit in length, and two
fingerprints of 64 bits must differ in no more bits than five standard deviations
above what ``t`` gives (a pair at ``t`` fails this once in millions); sets of
fewer than ``FEW`` shingles, whose bits are uneven, need not.

Candidates only make canopies: a bucket gives the forest of its pairs, never all
of them, and connected nodes are one canopy. Within a canopy every pair is
checked exactly, by counting shared shingles over an inverted list; canopies
above ``block_shingles`` are cut into blocks that meet two by two. Links that
connect something new leave, and their components are the classes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm import simhash
from auditlake.llm.common import materialize, slices, texts_utf8
from auditlake.llm.simhash import components

_K = np.uint64(0x9E3779B97F4A7C15)
#: Rows of a list that may be broadcast; longer ones are joined by shuffles.
SMALL = 200_000
TEXT_HASH = "__text_hash"
#: Smaller sets are not judged by their fingerprints.
FEW = 64


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= 100_000:
            self.clear()
        self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted 64-bit hashes of a text's distinct word shingles; a shorter text is one shingle."""

    def __init__(self, shingle: int) -> None:
        self.shingle, self.words = shingle, _Words()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        size = min(self.shingle, len(words))
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = len(w) - size + 1
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = _mixed(h * _K + w[k : k + n])
        return np.unique(h)


def _sid(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes())).view(np.int64)) if len(grams) else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def most_bits(threshold: float, bits: int = 128, sigmas: float = 5.0) -> int:
    """Bits that fingerprints of two equally large sets of this similarity may differ in, by angle and ``sigmas``."""
    p = math.acos(2 * threshold / (1 + threshold)) / math.pi
    return math.ceil(bits * p + sigmas * math.sqrt(bits * p * (1 - p)))


def _broadcast(rows: DataFrame) -> DataFrame:
    """A stored list, to be broadcast if it is short enough."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


# Reading


_READ = "sid long, n int, a long, b long, gram long, often long"


def _reads(shingle: int, doc_kind: str):
    """A row for each document: its set's hash, size and two fingerprints; and rows of shingles that are frequent here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size = Shingler(shingle), [], 0
        names = ["doc_id", TEXT_HASH, "sid", "n", "a", "b", "gram", "often"]

        def often() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= 4
            none = pa.nulls(int(keep.sum()))
            columns = [none.cast(kind), *(none.cast(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(values[keep].view(np.int64)), pa.array(n[keep])], names)

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for part in slices(batch):
                found = []
                for text in texts_utf8(part.column(2)):
                    grams = shingler(text)
                    held.append(grams)
                    size += len(grams)
                    found.append((_sid(grams), len(grams), _signed(simhash.majority(grams)), _signed(simhash.majority(_mixed(grams + _K)))))
                none = pa.nulls(part.num_rows, pa.int64())
                columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns, none, none], names)
                if size >= 2_000_000:
                    yield often()
                    held, size = [], 0
        if size:
            yield often()

    return run, f"doc_id {doc_kind}, `{TEXT_HASH}` long, {_READ}"


def _common(read: DataFrame, most: int = 200_000) -> np.ndarray:
    """Shingles that many documents hold, rarest first."""
    found = read.where("gram is not null").groupBy("gram").agg(F.sum("often").alias("n"))
    rows = found.orderBy(F.desc("n"), "gram").limit(most).collect()  # at most ``most`` numbers, for the order only
    return np.array([r["gram"] for r in reversed(rows)], np.int64).view(np.uint64)


def prefix_of(grams: np.ndarray, values: np.ndarray, ranks: np.ndarray, threshold: float) -> np.ndarray:
    """The shingles of a set that a partner of this similarity must share one of; ``values`` (sorted, with ranks) come last."""
    if len(values):
        at = np.minimum(np.searchsorted(values, grams), len(values) - 1)
        grams = grams[np.lexsort((grams, np.where(values[at] == grams, ranks[at], 0)))]
    return grams[: len(grams) - math.ceil(threshold * len(grams) - 1e-9) + 1]


def _prefixes(shingle: int, threshold: float, common: np.ndarray):
    """Rows (key, sid) of every text's prefix; texts that a task has seen lately give none."""
    order = np.argsort(common)
    values, ranks = common[order], order + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(shingle), set()
        for batch in batches:
            for part in slices(batch, 64):
                keys, sids = [], []
                for text, same in zip(texts_utf8(part.column(1)), part.column(0).to_pylist(), strict=True):
                    if same in seen:
                        continue
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(same)
                    grams = shingler(text)
                    if len(grams):
                        own = prefix_of(grams, values, ranks, threshold)
                        keys.append(own.view(np.int64))
                        sids.append(np.full(len(own), _sid(grams)))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(sids))], ["key", "sid"])

    return run


# Runs of sorted rows


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list]:
    """Columns of a whole number of groups at a time; rows are sorted by their first ``keys`` columns."""
    tail: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if batch is None:
            if tail:
                yield pa.Table.from_batches(tail)
            return
        cols = [batch.column(k).to_numpy() for k in range(keys)]
        last = np.logical_and.reduce([c == c[-1] for c in cols])
        first = batch.num_rows - int(last[::-1].argmin()) if not last.all() else 0
        if tail:
            before = tail[-1]
            same = all(before.column(k)[-1].as_py() == cols[k][0] for k in range(keys))
            if first == 0 and same:
                tail.append(batch)
                continue
            if first == 0:
                yield pa.Table.from_batches(tail)
                tail = [batch]
                continue
        if first:
            yield pa.Table.from_batches([*tail, batch.slice(0, first)])
        tail = [batch.slice(first)]


class _Forest:
    """Joins nodes; tells whether a link joins something new. Forgets when it is full, which only lets links through twice."""

    def __init__(self, most: int = 300_000) -> None:
        self.root, self.most = {}, most

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        if len(self.root) >= self.most:
            self.root.clear()
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.root[max(x, y)] = min(x, y)
        return True


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _fits(rows: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float, most: int) -> np.ndarray:
    _, n, a, b = rows
    low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    near = np.bitwise_count(a[i] ^ a[j]).astype(np.int64) + np.bitwise_count(b[i] ^ b[j]) <= most
    return (low >= threshold * high - 1e-9) & (near | (low < FEW))


def _bucket_links(threshold: float, most: int):
    """The forest of each bucket's pairs that fit in length and fingerprints; rows are key, pair, sid, n, a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for table in _runs(batches, 2):
            key, pair, sid, n, a, b = (table.column(k).to_numpy() for k in range(6))
            rows = [sid, n.astype(np.int64), a.view(np.uint64), b.view(np.uint64)]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
            starts = np.flatnonzero(new)
            sizes = np.diff(starts, append=len(key))
            found = []
            # small buckets together, by the distance of rows; larger ones row by row
            own = np.repeat(sizes, sizes)
            place = np.arange(len(key)) - np.repeat(starts, sizes)
            for d in range(1, 16):
                i = np.flatnonzero((own <= 16) & (place >= d))
                if not len(i):
                    break
                i = i[_fits(rows, i, i - d, threshold, most)]
                pairs = np.unique(np.stack([sid[i], sid[i - d]]), axis=1).T.tolist()
                found += [(u, v) for u, v in pairs if u != v and forest.join(u, v)]
            for start, size in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
                for at in range(start, start + size - 1):
                    others = np.arange(at + 1, start + size)
                    others = others[_fits(rows, np.full(len(others), at), others, threshold, most)]
                    u = int(sid[at])
                    found += [(u, v) for v in sid[others].tolist() if u != v and forest.join(u, v)]
            if found:
                yield _edges(found)

    return run


def set_links(sids: list[int], sets: list[np.ndarray], threshold: float, join: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Links of all pairs of sets that are similar enough, but for those that ``join`` has connected already."""
    lengths = np.array([len(s) for s in sets])
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    owner = np.repeat(np.arange(len(sets)), lengths)[order]
    values = grams[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    sizes = np.diff(starts, append=len(values))
    run_of = np.empty(len(grams), np.int64)
    run_of[order] = np.repeat(np.arange(len(starts)), sizes)
    out, end = [], 0
    for i, n in enumerate(lengths.tolist()):
        runs = run_of[end : end + n]
        end += n
        s, many = starts[runs], sizes[runs]
        total = int(many.sum())
        shared = np.bincount(owner[np.repeat(s - (np.cumsum(many) - many), many) + np.arange(total)], minlength=len(sets))
        near = np.flatnonzero(shared >= threshold * (n + lengths - shared) - 1e-9)
        for j in near[near > i].tolist():
            if sids[i] != sids[j] and join(sids[i], sids[j]):
                out.append((sids[i], sids[j]))
    return out


def _canopy_links(threshold: float):
    """Exact links within each run of (root, pair); rows are root, pair, sid, grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for table in _runs(batches, 2):
            root, pair, sid = (table.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((root[1:] != root[:-1]) | (pair[1:] != pair[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(root)], strict=True):
                own = {s: g for s, g in zip(sid[a:b].tolist(), table.column(3).slice(a, b - a), strict=True)}
                sets = [np.frombuffer(g.as_buffer(), np.uint64) for g in own.values()]
                if len(sets) > 1 and (found := set_links(list(own), sets, threshold, forest.join)):
                    yield _edges(found)

    return run


def _blocks_of(own, blocks):
    """To every pair of blocks that holds block ``own``."""
    return F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j)))


def similar_sets(docs: DataFrame, read: DataFrame, nodes: DataFrame, *, shingle: int, threshold: float, limit: int, block: int = 2048, block_shingles: int = 1_000_000) -> DataFrame:
    """(u, root) of every linked node but the roots; ``nodes`` has sid, n, a, b, doc_id and the text's hash, ``docs`` doc_id, that hash and text."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    filled = nodes.where("n > 0")
    # SimHash: nodes of one fingerprint, and fingerprints that differ in few bits
    prints = materialize(filled.groupBy("a").agg(F.min("sid").alias("hub")), "prints")
    fps = prints.select(F.col("a").alias("fp"))
    total, both = simhash.bit_counts(fps)
    if not total:
        return spark.createDataFrame([], "u long, root long")
    near = simhash.links(fps, simhash.plan(total, both, limit), limit=limit, block=block)
    u, v = (prints.select(F.col("a").alias(x), F.col("hub").alias(f"hub_{x}")) for x in "uv")
    near = near.join(u, "u").join(v, "v").select(F.col("hub_u").alias("u"), F.col("hub_v").alias("v"))
    same = filled.select("a", "sid").join(prints, "a").where("sid != hub").select(F.col("sid").alias("u"), F.col("hub").alias("v"))
    # prefix filter: only keys that two nodes have
    rows = materialize(docs.select(TEXT_HASH, "text").mapInArrow(_prefixes(shingle, threshold, _common(read)), "key long, sid long"), "prefixes")
    live = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("sid").alias("low"), F.max("sid").alias("high")).where("low != high")
    live = materialize(live.select("key", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "live")
    met = rows.join(_broadcast(live), "key").join(_broadcast(filled.select("sid", "n", "a", "b")), "sid")
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    dealt = met.select("key", _blocks_of(own, F.col("blocks")).alias("pair"), "sid", "n", "a", "b")
    met = dealt.repartition(parts, "key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_bucket_links(threshold, most_bits(threshold)), "u long, v long")
    canopies = components(materialize(near.union(same).union(met), "candidates"))
    # exact links in canopies
    members = canopies.select(F.col("u").alias("sid"), "root").union(canopies.select("root", "root").distinct())
    members = materialize(members.join(filled, "sid").select("sid", "root", "n", "doc_id", TEXT_HASH), "members")
    sizes = members.groupBy("root").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    placed = members.join(sizes, "root").select("doc_id", TEXT_HASH, "root", "blocks", "sid")
    placed = materialize(placed, "placed")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(shingle), set()
        for batch in batches:
            for part in slices(batch, 64):
                sids = part.column(3).to_pylist()
                new = [s not in seen and not seen.add(s) for s in sids]  # of repeated rows a task gives one
                if len(seen) > 200_000:
                    seen.clear()
                part = part.filter(pa.array(new))
                grams = pa.array([shingler(t).tobytes() for t in texts_utf8(part.column(0))], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in (1, 2, 3)), grams], ["root", "blocks", "sid", "grams"])

    told = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col(f"d.{TEXT_HASH}") == F.col(f"p.{TEXT_HASH}"))
    texts = docs.alias("d").join(_broadcast(placed).alias("p"), told).select("d.text", "p.root", "p.blocks", "p.sid")
    held = texts.mapInArrow(sets, "root long, blocks int, sid long, grams binary")
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    dealt = held.select("root", _blocks_of(own, F.col("blocks")).alias("pair"), "sid", "grams")
    links = dealt.repartition(parts, "root", "pair").sortWithinPartitions("root", "pair").mapInArrow(_canopy_links(threshold), "u long, v long")
    return components(links)


def _rank():
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", TEXT_HASH)


def nodes_of(plain: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of doc_id, text hash and text: what was read, the distinct rows with their sets' hashes, and one row of each set."""
    run, schema = _reads(shingle, plain.schema["doc_id"].dataType.simpleString())
    read = materialize(plain.mapInArrow(run, schema), "read")
    keys = read.where("gram is null").groupBy("doc_id", TEXT_HASH).agg(*(F.first(c).alias(c) for c in ("sid", "n", "a", "b")), F.count("*").alias("rows"))
    keys = materialize(keys, "keys")
    best = keys.groupBy("sid").agg(F.min(_rank()).alias("best"), *(F.first(c).alias(c) for c in ("n", "a", "b")))
    nodes = best.select("sid", "n", "a", "b", F.col("best.doc_id").alias("doc_id"), F.col(f"best.{TEXT_HASH}").alias(TEXT_HASH))
    return read, keys, materialize(nodes, "nodes")


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.{TEXT_HASH}") == F.col(f"{b}.{TEXT_HASH}"))


def one_of_each(docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8, limit: int = 3) -> DataFrame:
    """Of the rows of each component that pairs of ``threshold`` or more make, the one with the smallest doc_id.

    Whole rows come back, with all columns (one named like ``TEXT_HASH`` is not
    allowed). Rows are told apart, not doc_ids: repeated rows give one, and a null
    doc_id comes after all others. Null and empty texts have the same, empty set;
    texts shorter than a shingle are one shingle; very long texts are read whole.
    An empty table gives no rows.
    """
    told = docs.withColumn(TEXT_HASH, F.xxhash64("text"))
    plain = told.select("doc_id", TEXT_HASH, "text")
    read, keys, nodes = nodes_of(plain, shingle)
    rank = _rank()
    roots = similar_sets(plain, read, nodes, shingle=shingle, threshold=threshold, limit=limit)
    rooted = nodes.join(roots, F.col("sid") == F.col("u"), "left").select("sid", rank.alias("best"), F.coalesce("root", "sid").alias("root"))
    rooted = materialize(rooted, "rooted")
    first = rooted.groupBy("root").agg(F.min("best").alias("first"))
    first = materialize(rooted.join(first, "root").select("sid", "first"), "first_of")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col(TEXT_HASH) == F.col(f"first.{TEXT_HASH}"))
    judged = keys.join(first, "sid").select("doc_id", TEXT_HASH, stays.alias("stays"), "rows").where("not stays or rows > 1")
    judged = materialize(judged, "judged")
    columns = [F.col(f"a.`{c}`") for c in docs.columns]
    kept = told.alias("a").join(_broadcast(judged).alias("b"), _same("a", "b"), "left_anti").select(*columns)
    repeated = materialize(judged.where("stays").select("doc_id", TEXT_HASH), "repeated")
    if repeated.isEmpty():
        return kept
    again = told.alias("a").join(_broadcast(repeated).alias("b"), _same("a", "b"), "left_semi").dropDuplicates(["doc_id", TEXT_HASH])
    return kept.unionByName(again.select(*(F.col(f"`{c}`") for c in docs.columns)))
