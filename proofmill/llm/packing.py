"""Harmonic packing of token sequences.

A capacity C has the classes C, C/2, C/3, ...: a piece of class k is at most C // k long, and k such pieces fill a
sequence. A document is cut into whole sequences. What remains becomes a piece of the tightest class it fits if a bin
of k such pieces wastes at most ``SLACK`` tokens or it has at most ``least`` tokens; else it gives a piece of exactly
the next class, and its remainder goes on in the same way. Each worker fills the bins of each class on its own, k documents a bin,
so nothing is shuffled. At the end of a partition the unfinished bins (fewer than C tokens in each class) are joined
and cut at C; the last cut's remainder is split at powers of two, which need no padding.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm.store import documents

CAPACITY = 2048
LEAST = 64
SLACK = 32
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def cut(n: int, capacity: int = CAPACITY, least: int = LEAST) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document with n tokens, in order."""
    pieces = [(1, capacity)] * (n // capacity)
    rest = n % capacity
    while rest > least and capacity - (k := capacity // rest) * rest > SLACK:
        pieces.append((k + 1, capacity // (k + 1)))
        rest -= capacity // (k + 1)
    if rest:
        pieces.append((capacity // rest, rest))
    return pieces


class Packer:
    """Bins of one worker. Pieces are (doc_id, start, length, doc_tokens, ids)."""

    def __init__(self, first_sequence: int, capacity: int, least: int):
        self.next, self.capacity, self.least = first_sequence, capacity, least
        self.open: dict[int, list] = defaultdict(list)

    def close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, length, total, ids in pieces:
            yield doc_id, start, length, total, self.next, offset, ids
            offset += length
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        for k, length in cut(total, self.capacity, self.least):
            self.open[k].append((doc_id, start, length, total, ids[4 * start : 4 * (start + length)]))
            start += length
            if len(self.open[k]) == k:
                yield from self.close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        tokens = sum(p[2] for p in left)
        room = self.capacity if tokens >= self.capacity else 1 << max(tokens.bit_length() - 1, 0)
        now: list = []
        while left:
            doc_id, start, length, total, ids = left.pop(0)
            n = min(length, room)
            now.append((doc_id, start, n, total, ids[: 4 * n]))
            if n < length:
                left.insert(0, (doc_id, start + n, length - n, total, ids[4 * n :]))
            room, tokens = room - n, tokens - n
            if not room:
                yield from self.close(now)
                now, room = [], self.capacity if tokens >= self.capacity else 1 << max(tokens.bit_length() - 1, 0)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, least: int = LEAST) -> DataFrame:
    """Packs ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens: a row for each piece, with its ids.

    ids: little-endian unsigned 32-bit integers. A null or empty text is the end id alone. Repeated rows are packed as
    often as they come; a null doc_id stays null; other columns are ignored. An empty table gives no rows. Sequence
    ids are the partition's number times 2^33 and a count, so they are unique but not dense.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from proofmill.llm.tokens import encoder

        encode = encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 33, capacity, least)
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raws = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                for doc_id, short in zip(part.column(0).to_pylist(), encode.encode(raws), strict=True):
                    ids = np.frombuffer(short, encode.dtype).astype("<u4").tobytes() + end
                    for row in packer.add(doc_id, ids):
                        rows.append(row)
                        size += row[2]
                    if size > 500_000:
                        yield _table(rows)
                        rows, size = [], 0
        rows.extend(packer.finish())
        if rows:
            yield _table(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in their place."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))
