"""Packing of tokenised documents into sequences: best-two-fit.

A sequence is filled greedily with the largest piece that still fits; then its smallest piece is replaced by two unpacked
pieces that fill the wider gap more tightly. Only the lengths of pieces matter for that, and a length is at most the
capacity: the plan is made from one count per length, whatever the number of documents. Pieces are then ranked within
their length, all over the cluster, and take the plan's places by rank.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrow import map_arrow
from .ordering import positions, stored
from .tokens import encoder
from .words import slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sequences as (pieces per length, number of such sequences), from the number of pieces of each length.

    The same choice is repeated at once while all lengths that it looked at last, so the work depends on the lengths.
    """
    left = list(counts)
    made = []
    longest = capacity
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return made
        taken: dict[int, int] = {}
        gap, size = capacity, longest
        while gap:
            size = min(size, gap)
            while size and left[size] <= taken.get(size, 0):
                size -= 1
            if not size:
                break
            n = min(left[size] - taken.get(size, 0), gap // size)
            taken[size] = taken.get(size, 0) + n
            gap -= n * size
        peak = dict(taken)
        if gap and sum(taken.values()) > 1:
            smallest = min(taken)
            pair = _pair(left, taken, smallest, gap + smallest)
            if pair:
                taken[smallest] -= 1
                for size in pair:
                    taken[size] = taken.get(size, 0) + 1
        need = {size: n for size, n in taken.items() if n}
        times = min((left[size] - max(n, peak.get(size, 0))) // n for size, n in need.items()) + 1
        for size, n in need.items():
            left[size] -= n * times
        made.append((need, times))


def _pair(left: list[int], taken: dict[int, int], smallest: int, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum over ``smallest`` and at most ``room``."""
    def free(size: int) -> int:
        return left[size] - taken.get(size, 0)

    best, pair = smallest, None
    low, high = 1, room - 1
    while low <= high:
        if free(high) <= 0:
            high -= 1
        elif free(low) <= 0:
            low += 1
        elif low + high > room:
            high -= 1
        else:
            if low + high > best and (low < high or free(low) > 1):
                best, pair = low + high, (low, high)
            low += 1
    return pair


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids, ``end_id`` after each document.

    Only a longer document is cut; its first piece takes what is over a multiple of the capacity. A null text has only
    the end. Repeated rows give pieces of their own. Columns other than doc_id and text are not read.
    """
    end = struct.pack("<I", end_id)

    def run(batches):
        encode = encoder(tokenizer).encode
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text")), strict=True):
                    ids += end
                    n = len(ids) // 4
                    stops = [*range(n % capacity or capacity, n + 1, capacity)]
                    for k, stop in enumerate(stops):
                        start = stops[k - 1] if k else 0
                        own = ids[4 * start:4 * stop]
                        rows.append((doc, k, start, stop - start, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int64) if with_ids else None))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
                names = [f.split()[0] for f in PIECES.split(", ")] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)  # noqa: B905

    return map_arrow(docs.select("doc_id", "text"), run, PIECES + ", ids array<long>" * with_ids)


def place(found: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns as given by ``pieces``); sequences are numbered from 0."""
    rows = positions(found, [F.col(c) for c in ("length", "doc_id", "piece", "start", "ids_crc32")], "__position", "pieces")
    counts = [0] * (capacity + 1)
    for length, n in rows.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    # Runs of ranks within a length: the run's first key, its first sequence and its offset.
    first = np.concatenate(([0], np.cumsum(counts)))
    used = [0] * (capacity + 1)
    runs, sequence = [], 0
    for need, times in plan(counts, capacity):
        offset = 0
        for length in sorted(need, reverse=True):
            for _ in range(need[length]):
                runs.append((first[length] + used[length], sequence, offset))
                used[length] += times
                offset += length
        sequence += times
    table = np.array(sorted(runs) or [(0, 0, 0)], np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(table)
    names = [c for c in rows.columns if c != "__position"]
    kinds = [f for f in rows.schema.fields if f.name != "__position"]

    def run(batches):
        begin, sequences, offsets = shared.value.T
        for batch in batches:
            place = batch.column("__position").to_numpy()
            at = np.searchsorted(begin, place, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequences[at] + place - begin[at]), pa.array(offsets[at])],
                names=[*names, "sequence_id", "offset"],
            )

    schema = StructType([*kinds, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return map_arrow(rows, run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document with its sequence and its offset there.

    Tokens are computed once and stored. An empty table gives no rows. Equal documents are interchangeable.
    """
    return place(stored(pieces(docs, tokenizer, capacity, end_id, with_ids), "tokens"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of each sequence, from placed pieces with ids: at most ``capacity`` ids a row."""
    joined = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
