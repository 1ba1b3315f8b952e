"""Best-fit packing planned on the histogram of lengths.

Documents are tokenized once into pieces of at most ``capacity`` tokens. Only
the number of pieces of each length (at most ``capacity`` numbers) reaches the
driver, where best-fit decreasing runs over counts: a step places as many
pieces of one length as a group of equally filled sequences can take. The plan
is a list of slot ranges for each length. Pieces are then ranked within their
length and take the slot of their rank. A length that many pieces share is
ranked in salted buckets, whose offsets come from a prefix sum of their sizes.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import materialize, slices
from auditlake.llm.tokens import TEXTS, WORDS, encoder

#: Pieces of one length that one bucket of the ranking holds on average, at most.
BUCKET_ROWS = 20_000


def tokenized_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, words: int = WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; a null text is empty and has the end id alone.

    ``words`` bounds the words that a worker remembers (about 200 bytes each).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(tokenizer, words).ids_of_all, np.array([end_id], "<u4").tobytes()
        size = 4 * capacity
        for batch in batches:
            for part in slices(batch, TEXTS):
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), ids_of(part.column(1).to_pylist()), strict=True):
                    ids += end
                    rows += [(doc, k, k * capacity, min(size, len(ids) - k * size) // 4, zlib.crc32(ids[k * size : (k + 1) * size])) for k in range(-(-len(ids) // size))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns (length, rank, count, sequence, offset): the pieces of this length
    ranked ``rank`` to ``rank + count - 1`` go to the sequences from ``sequence``
    on, one each, all at ``offset``.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []  # the keys of free that have sequences, ascending
    slots, made = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not free[room]:
                bisect.insort(rooms, room)
            free[room].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = free[room].pop()
                if not free[room]:
                    rooms.pop(at)
                own = False
            else:
                room, first, n, own = capacity, made, left, True
            each = min(room // length, left)
            k = min(n, left // each)
            for j in range(each):
                slots.append((length, rank, k, first, capacity - room + j * length))
                rank += k
            left -= each * k
            put(room - each * length, first, k)
            if own:
                made += k
            else:
                put(room, first + k, n - k)
    return slots


def assign_slots(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to a table with length, doc_id and piece."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    total = sum(counts.values())
    buckets = max(1024, -(-total // BUCKET_ROWS))
    plan = sorted(plan_slots(counts, capacity))
    shift = 44
    keys = np.array([(length << shift) + rank for length, rank, *_ in plan], np.int64)
    ranks, firsts, offsets = (np.array([s[k] for s in plan], np.int64) for k in (1, 3, 4))

    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = salted.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select(
        "length",
        "_bucket",
        (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"),
    )
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_in", F.row_number().over(within) - 1).join(before, ["length", "_bucket"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            at = np.searchsorted(keys, (length << shift) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in names), pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])], names=[*names, "sequence_id", "offset"]
            )

    names = pieces.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*names, (F.col("_before") + F.col("_in")).cast("long").alias("_rank")).mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, words: int = WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null or empty text is a piece of one token; very long texts are cut into
    pieces of ``capacity``; null ids come back null; repeated rows and equal lengths
    take different slots; an empty table gives no rows; columns besides doc_id and
    text are not read.
    """
    pieces = materialize(tokenized_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, words=words), "pieces")
    return assign_slots(pieces, capacity=capacity)
