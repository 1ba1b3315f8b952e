"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items are cut into windows of ``window`` words, windows into word
shingles. The shingles of a window are ordered by their document frequency,
rarest first; a document can only hold at least ``threshold`` of a window's
shingles if it holds one of the first ``n - ceil(threshold * n) + 1``, so only
those are looked up (prefix filter). A match fixes where the window would have
to start, so windows that would begin before the document's first word or end
after its last one are dropped (positional and length bound), and the rest is
verified word by word over a stretch of the window's size.

The benchmark side is stored in blocks of at most ``block_bytes``, each a file
in the shared folder. Documents are read twice, once for the frequencies and
once for the matches, and never shuffled: a worker takes a batch of documents
through all blocks, and keeps a block's index if there is but one.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import fresh_path, materialize, read_file, slices, texts_utf8, write_file

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all non-ASCII characters."""
    return text.translate(_WORD).split() if text else []


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    """All stretches of ``window`` words; of fewer words, but not none, the one there is."""
    if not words:
        return []
    size = min(window, len(words))
    return list(zip(*(words[k:] for k in range(size)), strict=False))


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for item, text in zip(batch.column(0).to_pylist(), texts_utf8(batch.column(1)), strict=True):
                for w in set(windows_of(words_of(text), window)):
                    ids.append(item)
                    keys.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.binary())], ["item_id", "window"])

    return run


def _shingles(words, size: int) -> zip:
    return zip(*(words[k:] for k in range(size)), strict=False)


_KEPT: dict[str, object] = {}


def _load(path: str, make):
    """What ``make`` makes of a file; a worker keeps the last."""
    if path not in _KEPT:
        found = make(pickle.loads(read_file(path)))
        _KEPT.clear()
        _KEPT[path] = found
    return _KEPT[path]


def _vocabulary(block: list[tuple[bytes, list[str]]], shingle: int) -> dict[int, set[tuple]]:
    out: dict[int, set[tuple]] = defaultdict(set)
    for joined, _ in block:
        words = joined.split(b" ")
        out[min(shingle, len(words))].update(_shingles(words, min(shingle, len(words))))
    return dict(out)


def _rarity(paths: list[str], shingle: int):
    """Documents that hold each shingle of a block, summed by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[dict[tuple, int]] = [defaultdict(int) for _ in paths]
        for batch in batches:
            for k, path in enumerate(paths):
                vocabulary, own = _load(path, lambda block: _vocabulary(block, shingle)), seen[k]
                for part in slices(batch):
                    for text in texts_utf8(part.column(0)):
                        words = words_of(text)
                        for size, known in vocabulary.items():
                            for s in known.intersection(_shingles(words, size)):
                                own[s] += 1
        for k, own in enumerate(seen):
            columns = [pa.array([k] * len(own), pa.int32()), pa.array([b" ".join(s) for s in own], pa.binary()), pa.array(list(own.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "shingle", "n"])

    return run


class PrefixIndex:
    """Windows of one block, found by the rarest shingles of each."""

    def __init__(self, windows: list[tuple[bytes, list[str]]], shingle: int, threshold: float, frequency: dict[bytes, int]) -> None:
        self.shingle, self.threshold = shingle, threshold
        #: By shingle size: shingle to [(offset in window, window, items)].
        self.by_size: dict[int, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for joined, items in windows:
            words = joined.split(b" ")
            size = min(shingle, len(words))
            parts = list(_shingles(words, size))
            order = sorted(range(len(parts)), key=lambda k: (frequency.get(b" ".join(parts[k]), 0), parts[k], k))
            for k in order[: len(parts) - math.ceil(threshold * len(parts)) + 1]:
                self.by_size[size][parts[k]].append((k, words, items))
        self.by_size = {size: dict(found) for size, found in self.by_size.items()}
        self.keys = {size: frozenset(found) for size, found in self.by_size.items()}

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(start, length, items) of every window that occurs."""
        n = len(words)
        for size, index in self.by_size.items():
            if self.keys[size].isdisjoint(_shingles(words, size)):
                continue
            for at, s in enumerate(_shingles(words, size)):
                for offset, window, items in index.get(s, ()):
                    start, length = at - offset, len(window)
                    if start < 0 or start + length > n:
                        continue
                    if words[start : start + length] == window or (self.threshold < 1 and self._contains(words[start : start + length], window, size)):
                        yield start, length, items

    def _contains(self, here: list[bytes], window: list[bytes], size: int) -> bool:
        want = list(_shingles(window, size))
        there = set(_shingles(here, size))
        return sum(s in there for s in want) >= self.threshold * len(want)


def _scan(paths: list[str], at: int):
    """Fills the three state columns from ``at`` on: words, hit spans and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_utf8(batch.column("text"))
            counts = [0] * len(texts)
            items: list[set[str]] = [set() for _ in texts]
            hits: list[list[int]] = [[] for _ in texts]
            for path in paths or [None]:
                index = _load(path, lambda made: PrefixIndex(*made)) if path else None
                for k, text in enumerate(texts):
                    words = words_of(text)
                    counts[k] = len(words)
                    for start, length, ids in index.find(words) if index else ():
                        hits[k] += (start, start + length)
                        items[k].update(ids)
            state = [pa.array(counts, pa.int64()), pa.array([np.array(h, np.int32).tobytes() for h in hits], pa.binary()), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(at)), *state], names=batch.schema.names)

    return run


def _count_hits(spans: bytes) -> int:
    edges = np.frombuffer(spans, np.int32).reshape(-1, 2)
    n, end = 0, -1
    for a, b in sorted(map(tuple, edges.tolist())):
        n += max(0, b - max(a, end))
        end = max(end, b)
    return n


def blocks_of(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[list[tuple[bytes, list[str]]]]:
    """Distinct windows with their items, in blocks whose size is checked before they are collected."""
    rows = (
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_window_rows(window), "item_id string, window binary")
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    # a window of items without ids is a window, of no item that could be named
    size = rows.agg(F.sum(F.length("window") + F.size("items") * 24 + 64)).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k)
        yield [(bytes(r["window"]), list(r["items"])) for r in part.collect()]


def state_names(columns: list[str]) -> list[str]:
    """Names of the three columns that ``find_contamination`` adds to a table with these columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in ("n_words", "hit_spans", "items"):
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 10, shingle: int = 3, threshold: float = 1.0, block_bytes: int = 32 << 20
) -> DataFrame:
    """Adds ``n_words``, ``hit_spans`` (packed word offsets) and ``items`` to the rows of ``docs``.

    ``docs`` needs a column ``text``; all its columns pass through, and the added
    names get underscores in front where ``docs`` has them already (see
    ``state_names``). A null or empty text has no words and no hits; very long
    texts are read whole; repeated documents are judged each. Items without words
    give nothing; those with null ids give hits, but no item; repeated items count
    once. An empty benchmark gives no hits, an empty table of documents no rows.
    """
    added = state_names(docs.columns)
    names = docs.columns
    out = docs.select(
        *(F.col(f"`{c}`") for c in names),
        F.lit(None).cast("long").alias(added[0]),
        F.lit(b"").alias(added[1]),
        F.array().cast("array<string>").alias(added[2]),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema.fields])
    home, paths = fresh_path(docs.sparkSession, "windows"), []
    for block in blocks_of(benchmark, window, block_bytes):
        if block:
            paths.append(f"{home}/{len(paths):06d}.block")
            write_file(paths[-1], pickle.dumps(block))
    if paths:
        counted = docs.select("text").mapInArrow(_rarity(paths, shingle), "block int, shingle binary, n long").groupBy("block", "shingle").agg(F.sum("n").alias("n"))
        counted = materialize(counted, "rarity")
        for k, path in enumerate(paths):
            frequency = {bytes(r["shingle"]): r["n"] for r in counted.where(F.col("block") == k).collect()}  # as many as a block has
            write_file(path + ".index", pickle.dumps((pickle.loads(read_file(path)), shingle, threshold, frequency)))
    return out.mapInArrow(_scan([p + ".index" for p in paths], len(names)), schema)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, whole, that hold no window of the benchmark."""
    spans = state_names(docs.columns)[1]
    return find_contamination(docs, benchmark, **options).where(F.length(F.col(spans)) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated.

    See ``find_contamination`` for nulls, empty tables and options.
    """
    found = find_contamination(docs.select("doc_id", "text"), benchmark, **options).drop("text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = pa.array([_count_hits(s) for s in b.column("hit_spans").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), hits, b.column("items")], ["doc_id", "n_words", "n_hit", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(finish, f"doc_id {kind}, n_words long, n_hit long, items array<string>").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
