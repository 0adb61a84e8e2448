"""Best-fit packing of token sequences in rounds of residual merging.

Each task packs its pieces best-fit (the fullest sequence that still has
room), emits sequences that are nearly full and hands on the rest as items of
their own. Every round merges the leftovers of several tasks, until few
enough are left for one last block. A task holds a block of at most
``BLOCK_ITEMS`` items whatever the table's size, and every round is written,
so a lost executor repeats only its own tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from copse.llm.batches import Kernel, annotate, tidy
from copse.llm.tokens import encoder, tokenizer_path
from copse.session import ship, written

CAPACITY = 2048
#: A sequence with at most so many places free is emitted.
SLACK = 4
BLOCK_ITEMS = 100_000
#: Tasks whose leftovers meet in one task of the next round.
FAN_IN = 8


def pieces(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id",
           capacity: int = CAPACITY, end: int = 0, by_word: bool = True) -> DataFrame:
    """The tokenised documents as (key, piece, start, length, ids_crc32).

    A document is its ids and ``end``; null text is empty, so its one piece is
    the end id. Only documents of more than ``capacity`` ids are cut.
    """
    path = path or tokenizer_path()

    def kernel() -> Kernel:
        own = encoder(path, by_word)

        def run(texts):
            ids, lengths = own.encode(texts, end)
            data = ids.astype("<u4").tobytes()
            ends = np.cumsum(lengths)
            out = []
            for stop, size in zip(ends.tolist(), lengths.tolist()):
                begin = stop - size
                out.append([(start, min(capacity, size - start),
                             zlib.crc32(data[4 * (begin + start):4 * (begin + min(size, start + capacity))]))
                            for start in range(0, size, capacity)])
            return {"cut": [[{"start": a, "length": b, "ids_crc32": c} for a, b, c in one] for one in out]}
        return run

    cut = annotate(docs, text, kernel, "cut array<struct<start: long, length: long, ids_crc32: long>>", [key])
    return cut.select(key, F.posexplode("cut").alias("piece", "c")).select(key, "piece", "c.*")


class Bins:
    """Open sequences by room left; finds the fullest one that takes an item."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0                               # bit r: a sequence with room r is open
        self.items: list[list[int]] = []             # item numbers of each sequence
        self.room: list[int] = []

    def put(self, item: int, size: int) -> None:
        fitting = self.rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms ^= 1 << room
            self.items[bin_].append(item)
        else:
            bin_, room = len(self.items), self.capacity
            self.items.append([item])
            self.room.append(room)
        left = room - size
        self.room[bin_] = left
        self.by_room[left].append(bin_)
        self.rooms |= 1 << left


#: An item: its size, its pieces by row number, and their lengths.
_ITEM = "size int, rows array<long>, lengths array<int>"


def _packed(frame: pd.DataFrame, capacity: int, slack: int, last: bool, base: int) -> pd.DataFrame:
    """One block of items as sequences; ``sequence_id`` is null for those handed on."""
    sizes = frame["size"].tolist()
    bins = Bins(capacity)
    for item in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        bins.put(item, sizes[item])
    rows, lengths = frame["rows"].tolist(), frame["lengths"].tolist()
    left = np.asarray(bins.room)
    done = np.ones(len(left), bool) if last else left <= slack
    return pd.DataFrame({
        "size": capacity - left,
        "rows": [np.concatenate([rows[i] for i in one]) for one in bins.items],
        "lengths": [np.concatenate([lengths[i] for i in one]) for one in bins.items],
        "sequence_id": pd.Series(base + np.cumsum(done) - 1, dtype="Int64").mask(~done)})


def _round(items: DataFrame, number: int, capacity: int, slack: int, last: bool, block: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = (number << 48) | (TaskContext.get().partitionId() << 28)
        held, size = [], 0
        for frame in batches:
            held.append(frame)
            size += len(frame)
            if size >= block:
                out = _packed(pd.concat(held), capacity, slack, last, base)
                base += int(out["sequence_id"].notna().sum())
                yield out
                held, size = [], 0
        if size:
            yield _packed(pd.concat(held), capacity, slack, last, base)
    return items.mapInPandas(tidy(run), _ITEM + ", sequence_id long")


def packed(rows: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, slack: int = SLACK,
           fan_in: int = FAN_IN, block: int = BLOCK_ITEMS) -> DataFrame:
    """``rows`` (key, piece, length, ...) with ``sequence_id`` and gapless ``offset``.

    Pieces of full length are sequences by themselves. Keys may be null or
    repeat: rows are numbered first. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    whole = rows.where(F.col("length") >= capacity).select("_row", (-1 - F.col("_row")).alias("sequence_id"),
                                                           F.lit(0).cast("long").alias("offset"))
    items = rows.where(F.col("length") < capacity).select(
        F.col("length").cast("int").alias("size"),
        F.array("_row").alias("rows"), F.array(F.col("length").cast("int")).alias("lengths"))
    count = items.count()
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // 2_000)))
    done, number, before = [], 0, tasks
    while True:
        tasks = max(1, tasks, -(-count // block))
        last = tasks == 1 or number >= 2 and tasks >= before
        # Which items meet is settled by their first member, so a repeated task packs the same ones.
        dealt = items.repartition(tasks, F.xxhash64(F.col("rows")[0], F.lit(number))).sortWithinPartitions(
            F.desc("size"), F.col("rows")[0])
        packed_ = written(_round(dealt, number, capacity, slack, last, block), "packed")
        done.append(packed_.where(F.col("sequence_id").isNotNull()))
        if last:
            break
        items = packed_.where(F.col("sequence_id").isNull()).select("size", "rows", "lengths")
        before, count = tasks, items.count()
        tasks, number = max(1, -(-tasks // fan_in), -(-count // block)), number + 1
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    spread = placed.select("sequence_id", "rows", "lengths").mapInPandas(
        tidy(_offsets), "_row long, sequence_id long, offset long")
    return rows.join(spread.unionByName(whole), "_row").drop("_row")


def _offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per piece, at the sum of the lengths before it in its sequence."""
    for frame in batches:
        if len(frame):
            yield pd.DataFrame({
                "_row": np.concatenate(frame["rows"].tolist()),
                "sequence_id": np.repeat(frame["sequence_id"].to_numpy(np.int64), frame["rows"].str.len()),
                "offset": np.concatenate([np.cumsum(n) - n for n in frame["lengths"]]).astype(np.int64)})
