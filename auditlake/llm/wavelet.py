"""Token ids in wavelet-matrix files, one for each shard.

A shard is a range of documents in ascending doc_id order. Its token ids form a
wavelet matrix of Huffman shape: a token's code has as many bits as its count
among the shard's deserves. Plane k holds bit k of the codes of all positions
whose codes are longer than k; after it the sequence is split stably into zeros
and ones. Codes are dealt so that those which end at a plane come last in the
split, where they leave. The planes are about as large as the sequence's
entropy. They are cut into blocks that are compressed on their own, with the
number of ones before each block; a block that is read gets a directory of the
ones before each of its words. So one file answers access(i), rank(id, i) and
select(id, k) by decompressing only the blocks it touches, and gives back the
whole sequence by undoing the splits.

File: magic, header length, JSON header (counts, zeros of each plane, block
places), compressed doc ids, lengths, symbols and their counts, compressed blocks.
"""

from __future__ import annotations

import heapq
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import fresh_path, materialize, read_file, slices, write_file
from auditlake.llm.tokens import TEXTS, encoder

MAGIC = b"WVM2"
#: Stands for a null doc_id in a file.
NO_ID = -(1 << 63)
#: Bytes of a plane's block before compression, and tokens of a shard at most (a longer document has its own).
BLOCK, SHARD_TOKENS = 1 << 15, 1 << 22


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of symbols with these counts, one bit at least."""
    if len(counts) < 2:
        return np.ones(len(counts), np.int64)
    heap = [(n, k) for k, n in enumerate(counts.tolist())]
    heapq.heapify(heap)
    parents: list[int] = [0] * (2 * len(counts) - 1)
    for node in range(len(counts), 2 * len(counts) - 1):
        (n, x), (m, y) = heapq.heappop(heap), heapq.heappop(heap)
        parents[x] = parents[y] = node
        heapq.heappush(heap, (n + m, node))
    depths = [0] * len(parents)
    for node in range(len(parents) - 2, -1, -1):
        depths[node] = depths[parents[node]] + 1
    return np.array(depths[: len(counts)])


class Codes:
    """Codes of given lengths: at every level the codes that end stand last in the order of the split."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths, self.levels = lengths, int(lengths.max()) if len(lengths) else 0
        self.bits = np.zeros((self.levels, len(lengths)), np.uint8)
        #: Symbols whose codes end after each level, in the order in which they stand.
        self.ending: list[np.ndarray] = []
        if len(lengths) == 1:  # the one code is a single zero
            self.ending = [np.zeros(1, np.int64)]
            return
        inner: list[tuple[int, ...]] = [()]  # paths of the nodes that go on
        by_length = np.argsort(lengths, kind="stable")
        at = 0
        for level in range(self.levels):
            nodes = [(*p, bit) for bit in (0, 1) for p in inner]
            n = int((lengths == level + 1).sum())
            own = by_length[at : at + n]
            at += n
            for symbol, path in zip(own.tolist(), nodes[len(nodes) - n :], strict=True):
                self.bits[: level + 1, symbol] = path
            self.ending.append(own)
            inner = nodes[: len(nodes) - n]


def build(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of one shard: its ids in order, and how many belong to each document."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    symbols = np.flatnonzero(counts)
    codes, counts = Codes(code_lengths(counts[symbols])), counts[symbols]
    place = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 0, np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
    place[symbols] = np.arange(len(symbols))
    seq = place[ids]
    sizes, zeros, blocks, ones, body, at = [], [], [], [], [], 0
    for bits, ending in zip(codes.bits, codes.ending, strict=True):
        one = bits.take(seq).view(bool)
        packed = np.packbits(one, bitorder="little").tobytes()
        places, before, seen = [], [], 0
        for start in range(0, len(packed), BLOCK):
            part = packed[start : start + BLOCK]
            body.append(squeeze(part))
            places.append(at)
            before.append(seen)
            at += len(body[-1])
            seen += int.from_bytes(part, "little").bit_count()
        places.append(at)
        blocks.append(places)
        ones.append(before)
        sizes.append(len(seq))
        zeros.append(len(seq) - seen)
        going = len(seq) - int(counts[ending].sum())
        # by places, which numpy finds and gathers several times faster than it selects by a mask
        seq = np.concatenate([seq.take(np.flatnonzero(~one)), seq.take(np.flatnonzero(one))])[:going]
    lists = [np.asarray(doc_ids, "<i8"), np.asarray(lengths, "<i8"), symbols.astype("<i8"), counts.astype("<i8")]
    docs = squeeze(b"".join(x.tobytes() for x in lists))
    head = {"n": len(ids), "docs": len(doc_ids), "symbols": len(symbols), "docs_bytes": len(docs), "sizes": sizes, "zeros": zeros, "blocks": blocks, "ones": ones, "crc": zlib.crc32(b"".join(body))}
    text = json.dumps(head, separators=(",", ":")).encode()
    return b"".join([MAGIC, struct.pack("<I", len(text)), text, docs, *body])


class WaveletMatrix:
    """Reads one shard's file."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        size = struct.unpack("<I", data[4:8])[0]
        self.head = json.loads(data[8 : 8 + size])
        self.n, self.sizes, self.zeros = self.head["n"], self.head["sizes"], self.head["zeros"]
        docs, self.body = data[8 + size :][: self.head["docs_bytes"]], memoryview(data)[8 + size + self.head["docs_bytes"] :]
        if len(self.body) != (self.head["blocks"][-1][-1] if self.head["blocks"] else 0):
            raise ValueError("the file is cut short")
        self.unpack = zstandard.ZstdDecompressor().decompress
        lists = np.frombuffer(self.unpack(docs), "<i8")
        self.doc_ids, self.lengths, self.symbols, self.counts = np.split(lists, np.cumsum([self.head["docs"]] * 2 + [self.head["symbols"]]))
        self.codes = Codes(code_lengths(self.counts))
        self.levels = self.codes.levels
        #: Where in a split the ending symbols begin, and where each of them ends.
        self.going = [n - int(self.counts[e].sum()) for n, e in zip(self.sizes, self.codes.ending, strict=True)]
        self.ends = [g + np.cumsum(self.counts[e]) for g, e in zip(self.going, self.codes.ending, strict=True)]
        self._kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _block(self, level: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's 64-bit words and the ones before each."""
        if (level, k) not in self._kept:
            if len(self._kept) > 256:
                self._kept.clear()
            a, b = self.head["blocks"][level][k : k + 2]
            data = self.unpack(self.body[a:b])
            words = np.frombuffer(data + bytes(-len(data) % 8), "<u8")
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self._kept[level, k] = words, before
        return self._kept[level, k]

    def _bit(self, level: int, i: int) -> int:
        k, j = divmod(i, 8 * BLOCK)
        return int(self._block(level, k)[0][j >> 6]) >> (j & 63) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones of the plane before position i."""
        if i >= self.sizes[level]:
            return self.sizes[level] - self.zeros[level]
        k, j = divmod(i, 8 * BLOCK)
        words, before = self._block(level, k)
        return self.head["ones"][level][k] + int(before[j >> 6]) + (int(words[j >> 6]) & ((1 << (j & 63)) - 1)).bit_count()

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            if i >= self.going[level]:
                return int(self.symbols[self.codes.ending[level][np.searchsorted(self.ends[level], i, "right")]])
        raise ValueError("the file is damaged")

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` occurs before position i."""
        a, b, _ = self._range(token, i)
        return b - a

    def _code(self, token: int) -> list[int]:
        """The code's bits; of a token that does not occur none."""
        k = int(np.searchsorted(self.symbols, token))
        if k == len(self.symbols) or self.symbols[k] != token:
            return []
        return self.codes.bits[: int(self.codes.lengths[k]), k].tolist()

    def _range(self, token: int, i: int) -> tuple[int, int, list[int]]:
        code = self._code(token)
        a, b = 0, max(0, min(i, self.n)) if code else 0
        for level, bit in enumerate(code):
            x, y = self._ones(level, a), self._ones(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if bit else (a - x, b - y)
        return a, b, code

    def select(self, token: int, k: int) -> int:
        """The position of occurrence k (from 0) of ``token``."""
        a, b, code = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(len(code) - 1, -1, -1):
            at = self._nth(level, at - self.zeros[level] if code[level] else at, code[level])
        return at

    def _nth(self, level: int, k: int, one: int) -> int:
        """The position of the k-th (from 0) one or zero of a plane, by the directories of blocks and words."""
        before = np.asarray(self.head["ones"][level])
        if not one:
            before = np.arange(len(before)) * (8 * BLOCK) - before
        block = int(np.searchsorted(before, k, "right")) - 1
        k -= int(before[block])
        words, inside = self._block(level, block)
        if not one:
            inside = np.arange(len(inside)) * 64 - inside
        at = int(np.searchsorted(inside, k, "right")) - 1
        k -= int(inside[at])
        word = int(words[at]) if one else ~int(words[at]) & ((1 << 64) - 1)
        for _ in range(k):
            word &= word - 1
        return block * 8 * BLOCK + at * 64 + (word & -word).bit_length() - 1

    def count(self, token: int) -> int:
        """How often ``token`` occurs."""
        return self.rank(token, self.n)

    def all_ids(self) -> np.ndarray:
        """The whole sequence, by undoing the splits from the last plane to the first."""
        if zlib.crc32(self.body) != self.head["crc"]:
            raise ValueError("the file is damaged")
        kind = np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32
        seq = np.empty(0, kind)
        for level in range(self.levels - 1, -1, -1):
            ending = self.codes.ending[level]
            seq = np.concatenate([seq, np.repeat(ending.astype(kind), self.counts[ending])])
            places = self.head["blocks"][level]
            packed = b"".join(self.unpack(self.body[a:b]) for a, b in zip(places, places[1:], strict=False))
            one = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.sizes[level], bitorder="little").view(bool)
            before, z = np.empty_like(seq), self.zeros[level]
            before[np.flatnonzero(~one)] = seq[:z]
            before[np.flatnonzero(one)] = seq[z:]
            seq = before
        return self.symbols.astype(np.uint32)[seq]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 2, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """Writes the shards and returns their manifest: part, shard, path, docs, tokens.

    Documents are split by ranges of doc_id, so files follow each other in
    ascending order of (part, shard). Null texts are empty; null ids come first;
    rows that repeat an id follow each other, in one part; a very long text is a
    shard of its own; an empty table gives no files; other columns are not read.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        ids_of, end = encoder(tokenizer).ids_of_all, np.array([end_id], "<u4").tobytes()
        own: list[bytes] = []
        docs_in: list[int] = []
        rows: list[tuple] = []

        def flush() -> None:
            if docs_in:
                lengths = np.array([len(x) // 4 for x in own])
                path = f"{folder}/shard-{part:06d}-{len(rows):05d}-{attempt}.wvm"
                write_file(path, build(np.frombuffer(b"".join(own), "<u4"), np.array(docs_in, np.int64), lengths))
                rows.append((part, len(rows), path, len(docs_in), int(lengths.sum())))
                own.clear()
                docs_in.clear()

        held = 0
        for batch in batches:
            for piece in slices(batch, TEXTS):
                for doc, ids in zip(piece.column(0).to_pylist(), ids_of(piece.column(1).to_pylist()), strict=True):
                    ids += end
                    if held and held + len(ids) // 4 > shard_tokens:
                        flush()
                        held = 0
                    own.append(ids)
                    docs_in.append(NO_ID if doc is None else doc)
                    held += len(ids) // 4
        flush()
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "shard", "path", "docs", "tokens"])

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(run, "part int, shard int, path string, docs long, tokens long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    # a row for each file: their sums over parts are small, those within a part come from a window of that part
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))
    before = parts.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("part_start"))
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("tokens")
    placed = manifest.withColumn("within", within).join(before, "part").select("path", (F.col("within") + F.col("part_start")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = WaveletMatrix(read_file(path))
                ids, ends = shard.all_ids(), np.cumsum(shard.lengths)
                crcs = [zlib.crc32(ids[b - n : b].astype("<u4")) for b, n in zip(ends.tolist(), shard.lengths.tolist(), strict=True)]
                starts = start + ends - shard.lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, mask=shard.doc_ids == NO_ID), pa.array(starts), pa.array(shard.lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes all documents as shards in the shared folder and reads them back."""
    return read_shards(write_shards(docs, fresh_path(docs.sparkSession, "shards"), tokenizer, **options))
