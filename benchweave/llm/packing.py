"""Packing token sequences: first-fit decreasing with a tournament tree, independently in randomised groups.

Each text's ids and an end id are cut into full sequences and one remainder. Remainders are dealt evenly over groups of
about ``GROUP`` pieces (round robin after a hash sort, so no key decides), and every group packs its own: longest piece
first, each into the first open sequence with room, which a tournament tree of remaining capacities finds in
logarithmic time. A group's order is fixed by length and a content hash, so a repeated task packs alike.

Null text is empty and yields its end id only. Texts of any length are cut whole. Repeated rows are packed separately.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchweave.llm.bpe import WordBpe
from benchweave.llm.staging import pieces_for, stage
from benchweave.llm.words import text_slices

GROUP = 16_384


class Tournament:
    """Bins of equal capacity in order of opening; the winner tree holds the largest remaining room below each node."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> tuple[int, int]:
        """Take ``size`` from the first bin with that much room: its number and the room it had before."""
        node, room = 1, self.room
        while node < self.leaves:
            node *= 2
            node += room[node] < size
        had = room[node]
        room[node] = had - size
        place = node - self.leaves
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return place, had


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """``(bin, offset)`` for lengths given in decreasing order."""
    tree = Tournament(max(1, len(lengths)), capacity)
    out = []
    for n in lengths:
        place, had = tree.first_fit(n)
        out.append((place, capacity - had))
    return out


_WORKERS: dict[str, WordBpe] = {}


def _encoder(path: str) -> WordBpe:
    """One encoder per Python worker, kept between tasks."""
    if path not in _WORKERS:
        _WORKERS[path] = WordBpe(path)
    return _WORKERS[path]


def _cut(path: str, end_id: int, capacity: int):
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("id")
            for a, b in text_slices(texts):
                row, start, length, crc, total = [], [], [], [], []
                for i, ids in enumerate(_encoder(path).encode(texts.slice(a, b - a).to_pylist())):
                    ids += tail
                    n = len(ids) // 4
                    for at in range(0, n, capacity):
                        piece = ids[4 * at : 4 * (at + capacity)]
                        row.append(a + i), start.append(at), length.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(n)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("id", "ascending")])
        placed = first_fit_decreasing(table.column("length").to_pylist(), capacity)
        # Each group owns a range of sequence ids of its own.
        base = (TaskContext.get().partitionId() + 1) << 32
        out = table.append_column("sequence_id", pa.array([base + p for p, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))
        yield from out.combine_chunks().to_batches()

    return run


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    kind = dict(docs.dtypes)[key]
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = stage(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(_cut(path, end_id, capacity), schema), "pieces")
    parts = pieces.where(F.col("length") < capacity)
    groups = pieces_for(parts.count(), group)
    packed = parts.repartition(groups).mapInArrow(_pack(capacity), f"{schema}, sequence_id long, offset long")
    # A full piece is a sequence of its own; its number stays below those of the groups or is negative.
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.union(full).withColumnRenamed("id", key)
