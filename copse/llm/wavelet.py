"""Token-id files as wavelet matrices, one per shard.

A shard file holds the ids of a run of documents as bit planes, the highest
bit first: plane ``k`` has bit ``k`` of every id in the order that the planes
above it left, with the zeros moved ahead of the ones for the next plane. A
rank directory (ones before every block of 512 bits) makes access, counting
and the search for the n-th occurrence cost one step per plane, all from the
one compressed file. Documents are marked by the places of their ends.

Layout, little-endian: magic ``CWM2``; uint32 planes, documents, ids; then
all documents' int64 keys, uint8 marks of null keys and uint32 numbers of
ids, ends counted; per plane uint32 zeros; then the planes, each padded to
whole 512-bit blocks. The file is compressed with zstd. Rank
directories are rebuilt when a file is opened, in one pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from copse.llm.batches import bounded, texts_of
from copse.llm.tokens import encoder, tokenizer_path
from copse.session import ship

MAGIC = b"CWM2"
BLOCK = 512
#: Ids after which a file is closed; a longer document makes a longer file.
FILE_IDS = 1 << 20


def build(ids: np.ndarray, keys: np.ndarray, null_keys: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of documents' ids in a row."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    kind = np.uint16 if planes <= 16 else np.uint32
    seq = ids.astype(kind)
    width = -(-len(seq) // BLOCK) * (BLOCK // 8)
    zeros, data = [], []
    for plane in range(planes - 1, -1, -1):
        ones = (seq & kind(1 << plane)) != 0
        bits = np.zeros(width, np.uint8)
        bits[:-(-len(seq) // 8)] = np.packbits(ones, bitorder="little")
        inside = np.bitwise_count(bits.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([np.zeros(1, "<u4"), np.cumsum(inside, dtype="<u4")])
        zeros.append(len(seq) - int(ranks[-1]))
        data += [ranks.tobytes(), bits.tobytes()]
        if plane:
            seq = np.concatenate([seq[np.flatnonzero(~ones)], seq[np.flatnonzero(ones)]])
    head = MAGIC + np.array([planes, len(lengths), len(ids)], "<u4").tobytes()
    body = (np.asarray(keys, "<i8").tobytes() + np.asarray(null_keys, "u1").tobytes()
            + np.asarray(lengths, "<u4").tobytes() + np.asarray(zeros, "<u4").tobytes())
    return head + body + b"".join(data)


@dataclass
class WaveletMatrix:
    """An opened file."""

    keys: np.ndarray
    null_keys: np.ndarray
    lengths: np.ndarray
    zeros: np.ndarray
    planes: list[np.ndarray]         # bits as bytes, little bit order
    ranks: list[np.ndarray]          # ones before each block
    size: int

    @classmethod
    def open(cls, file: bytes) -> WaveletMatrix:
        raw = file
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet file")
        n_planes, n_docs, size = np.frombuffer(raw, "<u4", 3, 4).tolist()
        at = 16
        keys = np.frombuffer(raw, "<i8", n_docs, at)
        nulls = np.frombuffer(raw, "u1", n_docs, at + 8 * n_docs).astype(bool)
        lengths = np.frombuffer(raw, "<u4", n_docs, at + 9 * n_docs)
        zeros = np.frombuffer(raw, "<u4", n_planes, at + 13 * n_docs).astype(np.int64)
        at += 13 * n_docs + 4 * n_planes
        blocks = -(-size // BLOCK)
        width, step = blocks * (BLOCK // 8), 4 * (blocks + 1) + blocks * (BLOCK // 8)
        ranks = [np.frombuffer(raw, "<u4", blocks + 1, at + k * step) for k in range(n_planes)]
        planes = [np.frombuffer(raw, np.uint8, width, at + k * step + 4 * (blocks + 1)) for k in range(n_planes)]
        return cls(keys, nulls, lengths, zeros, planes, ranks, size)

    def _bit(self, plane: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[plane][at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def _ones(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place (0 to size)."""
        block = at >> 9
        before = self.ranks[plane][block].astype(np.int64)
        bits = self.planes[plane].reshape(-1, BLOCK // 8)
        inside = np.zeros(len(at), np.int64)
        part = at & (BLOCK - 1)
        some = np.flatnonzero(part)
        if len(some):
            rows = bits[block[some]]
            counts = np.bitwise_count(rows).astype(np.int64)
            ends = np.cumsum(counts, axis=1)
            byte = part[some] >> 3
            whole = np.where(byte > 0, ends[np.arange(len(some)), np.maximum(byte, 1) - 1], 0)
            rest = rows[np.arange(len(some)), np.minimum(byte, BLOCK // 8 - 1)] & ((1 << (part[some] & 7)) - 1).astype(np.uint8)
            inside[some] = whole + np.bitwise_count(rest)
        return before + inside

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at the places ``at``."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        for plane in range(len(self.planes)):
            bit = self._bit(plane, at)
            ones = self._ones(plane, at)
            out = (out << np.uint32(1)) | bit
            at = np.where(bit == 1, self.zeros[plane] + ones, at - ones)
        return out

    def rank(self, token: int, at: int) -> int:
        """Occurrences of an id before a place."""
        low, high = self._range(token, 0, at)
        return high - low

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of an id in a run of places."""
        low, high = self._range(token, start, self.size if stop is None else stop)
        return high - low

    def counts(self, token: int, ends: np.ndarray) -> np.ndarray:
        """Occurrences of an id before each of many places, all walked down the planes at once."""
        ends = np.asarray(ends, np.int64)
        if token >> len(self.planes):
            return np.zeros(len(ends), np.int64)
        at = np.append(ends, 0)
        for plane in range(len(self.planes)):
            ones = self._ones(plane, at)
            at = self.zeros[plane] + ones if token >> (len(self.planes) - 1 - plane) & 1 else at - ones
        return at[:-1] - at[-1]

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        for plane in range(len(self.planes)):
            ones = self._ones(plane, np.array([low, high], np.int64))
            if token >> (len(self.planes) - 1 - plane) & 1:
                low, high = (self.zeros[plane] + ones).tolist()
            else:
                low, high = low - int(ones[0]), high - int(ones[1])
        return low, high

    def select(self, token: int, n: int) -> int:
        """Place of the n-th occurrence (from 0) of an id; -1 if there are fewer."""
        low, high = self._range(token, 0, self.size)
        if n < 0 or n >= high - low:
            return -1
        at = low + n
        for plane in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - plane) & 1
            at = self._select_bit(plane, one, at - int(self.zeros[plane]) if one else at)
        return at

    def _select_bit(self, plane: int, one: int, n: int) -> int:
        ranks = self.ranks[plane].astype(np.int64)
        ranks = ranks if one else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(ranks, n, side="right")) - 1
        bits = np.unpackbits(self.planes[plane][block * (BLOCK // 8):(block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[n - ranks[block]])

    def ids(self) -> np.ndarray:
        """All ids in order, for sequential reading: the planes undone from the last to the first.

        Single places are read by :meth:`access`, which needs no other.
        """
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        values = np.unpackbits(self.planes[-1], count=self.size, bitorder="little").astype(kind)
        for plane in range(len(self.planes) - 2, -1, -1):
            bit = np.unpackbits(self.planes[plane], count=self.size, bitorder="little").view(bool)
            back = np.empty(self.size, kind)
            zeros = int(self.zeros[plane])
            back[np.flatnonzero(~bit)] = values[:zeros]
            back[np.flatnonzero(bit)] = values[zeros:] | kind(1 << (len(self.planes) - 1 - plane))
            values = back
        return values.astype(np.uint32)


def write(docs: DataFrame, folder: str, path: str | None = None, text: str = "text", key: str = "doc_id",
          end: int = 2, shards: int | None = None, file_ids: int = FILE_IDS, by_word: bool = True) -> None:
    """Write the documents' ids into ``folder`` in ascending key order.

    Shards are ranges of keys; each is a Parquet part whose rows, in order,
    hold one wavelet file each, so Spark's own commit keeps whole shards only.
    Null keys come first, equal keys in the order of their texts; null text is
    empty and has the end id alone.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard, number = TaskContext.get().partitionId(), 0
        own = encoder(path, by_word)
        held: list[tuple] = []
        size = 0

        def closed() -> pa.RecordBatch:
            ids, keys, nulls, lengths = (np.concatenate(x) for x in zip(*held))
            file = build(ids, keys, nulls, lengths)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()),
                 pa.array([file], pa.binary())], names=["shard", "file", "n_ids", "data"])

        for whole in batches:
            for batch in bounded(whole, text):
                column = batch.column(key)
                ids, lengths = own.encode(texts_of(batch, text), end)
                nulls = column.is_null().to_numpy(zero_copy_only=False)
                held.append((ids, column.fill_null(0).to_numpy(zero_copy_only=False), nulls, lengths))
                size += len(ids)
                if size >= file_ids:
                    yield closed()
                    held, size, number = [], 0, number + 1
        if held:
            yield closed()

    rows = docs.select(F.col(key).cast("long").alias(key), text)
    rows = rows.repartitionByRange(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, text)
    rows.mapInArrow(run, "shard int, file int, n_ids long, data binary").write.option(
        "compression", "none").parquet(folder)


def read(spark, folder: str, key: str = "doc_id", end: int = 2) -> DataFrame:
    """Documents of the files in ``folder``: (key, start, n_tokens, ids_crc32, first_id, n_end).

    ``start`` counts the ids of all documents before, over all shards. The
    checksum is of ids read in sequence; the first id of a document is looked up
    by its place and occurrences of ``end`` in it are counted, both on the planes.
    An empty table's folder gives no rows.
    """
    ship(spark)
    files = spark.read.parquet(folder)
    # One row per file: small beside the ids, and known without opening a file.
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("shard", "file", "n_ids").withColumn("base", before).drop("n_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = WaveletMatrix.open(batch.column("data")[k].as_py())
                data = one.ids().astype("<u4").tobytes()
                ends = np.cumsum(one.lengths, dtype=np.int64)
                sums = [zlib.crc32(data[4 * (b - n):4 * b]) for b, n in zip(ends.tolist(), one.lengths.tolist())]
                n = len(ends)
                counts = one.counts(end, np.append(ends - one.lengths, ends))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column("shard")[k].as_py()), pa.int32()),
                     pa.array(np.full(n, batch.column("file")[k].as_py()), pa.int32()),
                     pa.array(one.keys, mask=one.null_keys), pa.array(ends - one.lengths, pa.int64()),
                     pa.array(one.lengths, pa.int64()), pa.array(sums, pa.int64()),
                     pa.array(one.access(ends - one.lengths), pa.int64()), pa.array(counts[n:] - counts[:n], pa.int64())],
                    names=["shard", "file", key, "inside", "n_tokens", "ids_crc32", "first_id", "n_end"])

    rows = files.select("shard", "file", "data").mapInArrow(
        run, f"shard int, file int, `{key}` long, inside long, n_tokens long, ids_crc32 long, first_id long, n_end long")
    return rows.join(starts, ["shard", "file"]).select(
        key, (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "first_id", "n_end")


def occurrences(spark, folder: str, token: int) -> DataFrame:
    """How often an id occurs in each file, counted on the planes without decoding."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [WaveletMatrix.open(d).count(token) for d in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("file"), pa.array(counts, pa.int64())],
                                             names=["shard", "file", "n"])
    return spark.read.parquet(folder).select("shard", "file", "data").mapInArrow(run, "shard int, file int, n long")
