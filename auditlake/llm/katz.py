"""Language-model scores by Katz backoff over bigrams.

Documents are encoded once into chunks of about ``chunk_tokens`` tokens, each
with its own list of distinct words; a chunk is a file in the shared folder. A
chunk sends each of its distinct n-grams once, with its count, as sorted and
compressed arrays to the bucket of the n-gram's hash: a range of one order's
hashes, about ``bucket_tokens`` of them however large the corpus is. A bucket's
task sums the counts, writes them as that range of the model's table, and
answers the chunks in the order of their keys; so no n-gram, however frequent,
is more than one number from each chunk, and nothing is gathered on the driver
but count-of-counts.

Counts r of 1 to ``top`` are discounted by Good-Turing as Katz gives it. Of
each n-gram one chunk is the owner and adds its discounted mass and lower-order
probability to its history's sums, from which follows the backoff weight that
makes every history's distribution sum to one; weights are a table as well.
Scoring is recursive per token: the discounted bigram if it was seen in
training, else the history's weight times the unigram, whose freed mass is the
unknown word's.

The model's folder holds Parquet tables by order (1 and 2 are counts, 3 the
histories' weights), each in files by bucket, sorted by hash, and ``sums``. An exchange has a row for each chunk and bucket that
share keys, so far larger corpora want larger chunks and buckets.

Words and bigrams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import crc_of_id, fresh_path, materialize, read_file, slices, texts_utf8, write_file

#: Local ids of the end of a text and of the history before its first word.
END, START = 0, 1
ADDED = 0.1
#: Stands for a null doc_id in a chunk.
NO_ID = -(1 << 63)
TOP = 5


def _squeeze(a: np.ndarray) -> bytes:
    """The array's bytes, all first bytes before all second ones and so on, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _expand(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _bundle(parts: list[bytes]) -> bytes:
    return struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts)) + b"".join(parts)


def _unbundle(data: bytes) -> list[bytes]:
    n = struct.unpack_from("<I", data)[0]
    sizes, at, out = struct.unpack_from(f"<{n}I", data, 4), 4 + 4 * n, []
    for s in sizes:
        out.append(data[at : at + s])
        at += s
    return out


class _Ids(dict):
    """Words to ids in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 2
        return n


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Chunk:
    """Encoded documents: ids, lengths with the end token, training flags, word hashes, local token ids."""

    def __init__(self, blob: bytes) -> None:
        docs, lengths, train, hashes, tokens = _unbundle(blob)
        self.docs, self.lengths, self.train = _expand(docs, "<i8"), _expand(lengths, "<i8"), _expand(train, "u1")
        self.hashes, self.tokens = _expand(hashes, "<u8"), _expand(tokens, "<u4")
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.trains = np.repeat(self.train == 1, self.lengths)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the distinct words by hash, their sorted hashes, their training counts."""
        order = np.argsort(self.hashes)
        counts = np.bincount(self.tokens[self.trains], minlength=len(self.hashes))
        return order, self.hashes[order], counts[order]

    def bigrams(self) -> tuple[np.ndarray, ...]:
        """Histories and words of the distinct bigrams in order of their hashes, those hashes, training counts, and each token's bigram."""
        history = np.empty(len(self.tokens), np.uint64)
        history[1:] = self.tokens[:-1]
        history[self.starts] = START
        pairs, own = np.unique(history << np.uint64(32) | self.tokens, return_inverse=True)
        before, word = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        keys = _mix(self.hashes[before], self.hashes[word])
        order = np.argsort(keys)
        counts = np.bincount(own[self.trains], minlength=len(pairs))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return before[order], word[order], keys[order], counts[order], place[own]


def encode(docs: DataFrame, folder: str, chunk_tokens: int, held_out: tuple[int, int]) -> DataFrame:
    """Writes chunks as files of ``folder``; returns the table of chunks: chunk, path, tokens."""
    mod, out = held_out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, tokens, lengths, doc_ids, trains, held = _Ids(), [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            digest = xxhash.xxh64_intdigest
            hashes = np.fromiter((digest(b"end", 1), digest(b"start", 2), *map(digest, ids)), np.uint64, len(ids) + 2)
            arrays = [(doc_ids, "<i8"), (lengths, "<i8"), (trains, "u1"), (hashes, "<u8"), (np.concatenate(tokens), "<u4")]
            path = f"{folder}/{part:07d}-{made:06d}.chunk"
            write_file(path, _bundle([_squeeze(np.asarray(a, k)) for a, k in arrays]))
            return pa.RecordBatch.from_arrays([pa.array([part << 24 | made]), pa.array([path]), pa.array([held], pa.int64())], ["chunk", "path", "tokens"])

        for batch in batches:
            for rows in slices(batch):
                for doc, text, train in zip(rows.column(0).to_pylist(), texts_utf8(rows.column(1)), rows.column(2).to_pylist(), strict=True):
                    words = text.lower().split() if text else []
                    tokens.append(np.fromiter((*map(ids.__getitem__, words), END), np.uint32, len(words) + 1))
                    lengths.append(len(words) + 1)
                    doc_ids.append(NO_ID if doc is None else doc)
                    trains.append(train)
                    held += len(words) + 1
                    if held >= chunk_tokens:
                        yield flush()
                        made += 1
                        ids, tokens, lengths, doc_ids, trains, held = _Ids(), [], [], [], [], 0
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (F.pmod(crc_of_id("doc_id"), F.lit(mod)) != out).alias("train"))
    return rows.mapInArrow(run, "chunk long, path string, tokens long")


# Sums over the corpus. A row of an exchange is what one chunk has in one bucket,
# a range of an order's hashes; order 3 are histories and their weights.

_DEALT, _DEALT_KINDS = "order int, bucket int, chunk long, path string, keys binary, vals binary", [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
_ANSWER, _ANSWER_KINDS = "order int, bucket int, chunk long, path string, vals binary, stats array<long>", [*_DEALT_KINDS[:4], pa.binary(), pa.list_(pa.int64())]
_DEALT_NAMES, _ANSWER_NAMES = ["order", "bucket", "chunk", "path", "keys", "vals"], ["order", "bucket", "chunk", "path", "vals", "stats"]
#: Answers are counts times two, plus the owner's one (orders 1 and 2), and weights.
_KINDS = {1: "<u8", 2: "<u8", 3: "<f8"}


def _rows(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _deal(order: int, chunk: int, path: str, keys: np.ndarray, values: list[np.ndarray], bits: int) -> Iterator[tuple]:
    """Rows of sorted keys by bucket, which is the keys' first bits."""
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = [0, *edges.tolist(), len(keys)]
    for bucket, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if a < b:
            yield order, bucket, chunk, path, _gaps(keys[a:b]), _bundle([_squeeze(v[a:b]) for v in values])


def _gaps(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_expand(data, "<u8"), dtype=np.uint64)


class _Met:
    """What all chunks have in a bucket, by key: chunks in order, so that a key's first owner is the smallest."""

    def __init__(self, table: pa.Table, kinds: list[str]) -> None:
        rows = sorted(zip(*(table.column(k).to_pylist() for k in ("chunk", "path", "keys", "vals")), strict=True))
        self.order, self.bucket = table.column("order")[0].as_py(), table.column("bucket")[0].as_py()
        self.owners = [r[:2] for r in rows]
        parts = [_keys(r[2]) for r in rows]
        self.ends = np.cumsum([len(x) for x in parts])
        keys = np.concatenate(parts)
        del parts
        self.sorted = np.argsort(keys, kind="stable")
        keys = keys[self.sorted]
        self.new = np.concatenate([[True], keys[1:] != keys[:-1]])
        self.starts = np.flatnonzero(self.new)
        self.keys = keys[self.starts]
        self.values = [np.concatenate(v)[self.sorted] for v in zip(*([_expand(v, t) for v, t in zip(_unbundle(r[3]), kinds, strict=True)] for r in rows), strict=True)]

    def sums(self) -> list[np.ndarray]:
        return [np.add.reduceat(v.astype(v.dtype if v.dtype.kind == "f" else np.uint64), self.starts) for v in self.values]

    def rows(self, answers: np.ndarray, stats: list[int] | None) -> pa.Table:
        """Each chunk's answers in the order of its keys, and a row of sums, whose chunk is a negative number of its own."""
        back = np.empty_like(answers)
        back[self.sorted] = answers
        out = [(self.order, self.bucket, *o, _squeeze(x), None) for o, x in zip(self.owners, np.split(back, self.ends[:-1]), strict=True)]
        if stats:
            out.append((self.order, self.bucket, -(self.bucket << 2 | self.order), None, None, stats))
        return pa.Table.from_batches([_rows(out, _ANSWER_NAMES, _ANSWER_KINDS)])

    def each(self, values: np.ndarray) -> np.ndarray:
        """Values of distinct keys for every row."""
        return np.repeat(values, np.diff(self.starts, append=len(self.sorted)))


def _table_path(home: str, order: int, bucket: int) -> str:
    return f"{home}/order={order}/bucket-{bucket:08d}.parquet"


def _store(home: str, order: int, bucket: int, keys: np.ndarray, values: np.ndarray) -> None:
    """Writes a bucket of the model's table of an order: hash (sorted as unsigned) and value."""
    data = pa.table({"hash": pa.array(keys.view(np.int64)), "value": pa.array(values.astype(np.int64) if order < 3 else values)})
    out = pa.BufferOutputStream()
    pq.write_table(data, out, use_dictionary=False, compression="zstd", column_encoding={"hash": "DELTA_BINARY_PACKED"})
    write_file(_table_path(home, order, bucket), out.getvalue().to_pybytes())


def _load(home: str, order: int, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    try:
        file = read_file(_table_path(home, order, bucket))
    except FileNotFoundError:  # no chunk had a key of this bucket
        return np.empty(0, np.uint64), np.empty(0)
    data = pq.read_table(pa.BufferReader(file))
    return data.column("hash").to_numpy().view(np.uint64), data.column("value").to_numpy()


def _sum_counts(home: str):
    """Corpus counts: a bucket of the model's table, answers of twice the count, plus one for the owner, and count-of-counts."""

    def run(table: pa.Table) -> pa.Table:
        met = _Met(table, ["<u4"])
        (total,) = met.sums()
        _store(home, met.order, met.bucket, met.keys[total > 0], total[total > 0])
        stats = [int((total > 0).sum()), int(total.sum()), *(int((total == r).sum()) for r in range(1, TOP + 2))]
        return met.rows(met.each(total) * np.uint64(2) + met.new.astype(np.uint64), stats)

    return run


def _sum_weights(home: str, unknown: float):
    """Freed mass over what the unseen words' unigrams leave, at least the unknown word's; negative where no mass was freed and one count is added."""

    def run(table: pa.Table) -> pa.Table:
        met = _Met(table, ["<f8", "<f8"])
        freed, lower = met.sums()
        left = np.maximum(1 - lower, unknown)
        weights = np.where(freed > 1e-9, freed / left, -1 / left)
        _store(home, met.order, met.bucket, met.keys[lower > 0], weights[lower > 0])
        return met.rows(met.each(weights), None)

    return run


# The model


def discounts(stats: list[int]) -> np.ndarray:
    """Katz's discount ratios by count, for counts up to TOP; 1 above.

    Where the count-of-counts are too ragged for a ratio within (0, 1], the
    ratio of absolute discounting by n1 / (n1 + 2 n2) stands in.
    """
    n = [0, *stats[2:]]
    out = np.ones(TOP + 1)
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    common = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for r in range(1, TOP + 1):
        ratio = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = ratio if 0 < ratio <= 1 else 1 - absolute / r
    return out


class Katz:
    """Probabilities from counts."""

    def __init__(self, unigrams: list[int], bigrams: list[int]) -> None:
        self.unigrams, self.bigrams = unigrams, bigrams
        self.types, self.tokens = unigrams[0], unigrams[1]
        self.one, self.two = discounts(unigrams), discounts(bigrams)
        freed = sum((1 - self.one[r]) * r * unigrams[1 + r] for r in range(1, TOP + 1))
        self.total = self.tokens + (0 if freed > 1e-9 else 1)
        self.unknown = (freed if freed > 1e-9 else 1) / self.total

    def save(self, spark: SparkSession, home: str, bits: int) -> None:
        """Count-of-counts and the number of bits of a bucket, beside the tables."""
        spark.createDataFrame([(bits, self.unigrams, self.bigrams)], "bits int, unigrams array<long>, bigrams array<long>").write.parquet(f"{home}/sums")

    @staticmethod
    def load(spark: SparkSession, home: str) -> tuple[Katz, int]:
        row = spark.read.parquet(f"{home.rstrip('/')}/sums").first()
        return Katz(list(row["unigrams"]), list(row["bigrams"])), row["bits"]

    @staticmethod
    def _kept(counts: np.ndarray, ratios: np.ndarray) -> np.ndarray:
        return counts * np.where(counts <= TOP, ratios[np.minimum(counts, TOP)], 1.0)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """Of words with these counts; of count 0: of the unknown word."""
        return np.where(counts > 0, self._kept(counts, self.one) / self.total, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADDED) / (self.tokens + ADDED * (self.types + 1))

    def bigram(self, pairs: np.ndarray, histories: np.ndarray, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of bigrams from the counts of pairs, histories and words, and the histories' weights from ``_sum_weights``."""
        lower, below = self.unigram(words), histories + (weights < 0)
        seen = self._kept(pairs, self.two) / np.maximum(below, 1)
        return np.where(pairs > 0, seen, np.where(histories > 0, np.abs(weights) / np.maximum(below, 1), 1.0) * lower)


def _answers(table: pa.Table) -> tuple[str, dict[int, np.ndarray]]:
    """A chunk's path, and its answers by order, in the order of its sorted keys."""
    rows = sorted(zip(*(table.column(k).to_pylist() for k in ("order", "bucket", "vals")), strict=True), key=lambda r: r[:2])
    parts: dict[int, list[np.ndarray]] = {}
    for order, _, vals in rows:
        parts.setdefault(order, []).append(_expand(vals, _KINDS[order]))
    return table.column("path")[0].as_py(), {k: np.concatenate(v) for k, v in parts.items()}


_GATHERED, _GATHERED_KINDS = "chunk long, path string, order int, stats array<long>", [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64())]


def _gather(table: pa.Table) -> pa.Table:
    """Leaves a chunk's counts in a file beside it; a row of sums passes."""
    chunk = table.column("chunk")[0].as_py()
    if chunk >= 0:
        path, answers = _answers(table)
        write_file(path + ".counts", _bundle([_squeeze(answers[k]) for k in (1, 2)]))
        row = (chunk, path, None, None)
    else:
        row = (chunk, None, table.column("order")[0].as_py(), table.column("stats")[0].as_py())
    return pa.Table.from_batches([_rows([row], ["chunk", "path", "order", "stats"], _GATHERED_KINDS)])


def _stats(gathered: DataFrame, order: int) -> list[int]:
    rows = gathered.where(F.col("order") == order).select(F.posexplode("stats").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect()
    return [r["n"] for r in rows] or [0] * (TOP + 3)


class _Counted:
    """A chunk with its words' and bigrams' counts in the corpus."""

    def __init__(self, path: str) -> None:
        self.chunk = Chunk(read_file(path))
        one, two = (_expand(x, "<u8") for x in _unbundle(read_file(path + ".counts")))
        self.order = np.argsort(self.chunk.hashes)
        self.words = _by_word(self.order, (one >> np.uint64(1)).astype(np.int64))
        self.before, self.word, _, _, self.place = self.chunk.bigrams()
        self.seen, self.owned = (two >> np.uint64(1)).astype(np.int64), (two & np.uint64(1)).astype(bool)


def _by_word(order: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts by local word id; that of START is the number of training texts."""
    out = np.empty(len(order), np.int64)
    out[order] = counts
    out[START] = out[END]
    return out


_SCORED_NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(model: Katz):
    """Scores of a chunk's documents from its counts and the answers of order 3."""

    def run(table: pa.Table) -> pa.Table:
        path, answers = _answers(table)
        c = _Counted(path)
        chunk, counts = c.chunk, c.words
        beta = np.empty(len(counts))
        beta[c.order] = answers[3]
        p = np.log10(model.bigram(c.seen, counts[c.before], counts[c.word], beta[c.before]))[c.place]
        known, base = counts > 0, np.log10(model.base(counts))
        sums = [np.add.reduceat(x, chunk.starts) for x in (known[chunk.tokens].astype(np.int64), base[chunk.tokens], p)]
        docs = pa.array(chunk.docs, mask=chunk.docs == NO_ID)
        n = pa.array(np.full(len(chunk.docs), model.tokens, np.int64))
        return pa.table([docs, pa.array(chunk.train == 0), pa.array(chunk.lengths), pa.array(sums[0]), n, pa.array(sums[1]), pa.array(sums[2])], names=_SCORED_NAMES)

    return run


def _asked(chunks: DataFrame, pick, bits: int) -> DataFrame:
    """What ``pick`` deals of each chunk's path: rows (order, keys, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for order, keys, values in pick(path):
                    yield _rows(list(_deal(order, number, path, keys, values, bits)), _DEALT_NAMES, _DEALT_KINDS)

    # few small rows that stand for a chunk's work each: dealt evenly
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.select("chunk", "path").repartition(parts).mapInArrow(run, _DEALT)


def _by_bucket(dealt: DataFrame):
    return dealt.groupBy("order", "bucket")


def _chunks(docs: DataFrame, chunk_tokens: int, held_out: tuple[int, int]) -> DataFrame:
    encoded = encode(docs, fresh_path(docs.sparkSession, "chunks"), chunk_tokens, held_out)
    return materialize(encoded.repartition("chunk"), "chunk_list")  # small rows, few files


def score(docs: DataFrame, *, chunk_tokens: int = 800_000, held_out: tuple[int, int] = (10, 0), bucket_tokens: int = 1_500_000, model_path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    The model learns from documents whose crc32(doc_id) mod held_out[0] is not
    held_out[1]. Null and empty texts are an end token; a text longer than
    ``chunk_tokens`` is a chunk of its own; a null doc_id trains as empty text's
    crc32 says and comes back null; repeated rows count each time; an empty table
    gives no rows; other columns are not read. ``model_path`` is where the model's
    tables go (else a new folder of the shared one); ``score_with`` scores other
    documents by them.
    """
    spark = docs.sparkSession
    home = (model_path or fresh_path(spark, "katz")).rstrip("/")
    chunks = _chunks(docs, chunk_tokens, held_out)
    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    bits = max(6, (tokens // bucket_tokens).bit_length())

    def grams(path: str) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        chunk = Chunk(read_file(path))
        _, hashes, counts = chunk.words()
        yield 1, hashes, [counts.astype("<u4")]
        _, _, hashes, counts, _ = chunk.bigrams()
        yield 2, hashes, [counts.astype("<u4")]

    answers = _by_bucket(_asked(chunks, grams, bits)).applyInArrow(_sum_counts(home), _ANSWER)
    gathered = materialize(answers.groupBy("chunk").applyInArrow(_gather, _GATHERED).repartition("chunk"), "gathered")
    model = Katz(_stats(gathered, 1), _stats(gathered, 2))
    model.save(spark, home, bits)

    def weights(path: str) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        c = _Counted(path)
        own = c.owned & (c.seen > 0)
        before, seen = c.before[own], c.seen[own]
        freed = np.bincount(before, weights=seen - model._kept(seen, model.two), minlength=len(c.words))
        lower = np.bincount(before, weights=model.unigram(c.words[c.word[own]]), minlength=len(c.words))
        yield 3, c.chunk.hashes[c.order], [freed[c.order], lower[c.order]]

    answers = _by_bucket(_asked(gathered.where("chunk >= 0"), weights, bits)).applyInArrow(_sum_weights(home, model.unknown), _ANSWER)
    return answers.groupBy("chunk").applyInArrow(_finish(model), _SCORED)


def score_with(docs: DataFrame, model_path: str, *, chunk_tokens: int = 800_000, held_out: tuple[int, int] = (10, 0)) -> DataFrame:
    """The columns of ``score`` for any documents, by the tables that ``score`` left at ``model_path``.

    ``held_out`` only fills the column of that name. Nulls, empty tables, repeated
    rows and very long texts are as in ``score``.
    """
    home = model_path.rstrip("/")
    model, bits = Katz.load(docs.sparkSession, home)
    chunks = _chunks(docs, chunk_tokens, held_out)

    def grams(path: str) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        chunk = Chunk(read_file(path))
        words = np.sort(chunk.hashes)
        yield 1, words, []
        yield 2, chunk.bigrams()[2], []
        yield 3, words, []

    def look_up(asked: pa.Table) -> pa.Table:
        order, bucket = asked.column("order")[0].as_py(), asked.column("bucket")[0].as_py()
        keys, values = _load(home, order, bucket)
        out = []
        for number, path, data in zip(*(asked.column(k).to_pylist() for k in ("chunk", "path", "keys")), strict=True):
            own = _keys(data)
            at = np.searchsorted(keys, own)
            there = at < len(keys)
            there[there] = keys[at[there]] == own[there]
            found = np.zeros(len(own), _KINDS[order])
            found[there] = values[at[there]] * (2 if order < 3 else 1)
            out.append((order, bucket, number, path, _squeeze(found), None))
        return pa.Table.from_batches([_rows(out, _ANSWER_NAMES, _ANSWER_KINDS)])

    def finish(table: pa.Table) -> pa.Table:
        _gather(table)
        return _finish(model)(table)

    return _by_bucket(_asked(chunks, grams, bits)).applyInArrow(look_up, _ANSWER).groupBy("chunk").applyInArrow(finish, _SCORED)
