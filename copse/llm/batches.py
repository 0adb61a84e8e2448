"""Run a kernel over the texts of a table in Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from copse.session import ship

#: UTF-8 bytes of text that a kernel sees at once; a longer text comes alone.
BATCH_BYTES = 4 << 20

def named(*names: str) -> list[Column]:
    """Columns by name, whatever signs the names hold."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


Kernel = Callable[[list[bytes | None]], dict[str, object]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``limit`` bytes of ``column``, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The texts as UTF-8."""
    return batch.column(column).cast(pa.binary()).to_pylist()


_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What this worker keeps under ``key`` from task to task, until it runs another kernel."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def begun(kernel: Callable[[], Kernel]) -> Kernel:
    """A kernel for a task; what other kernels have kept in this worker goes."""
    who = f"{kernel.__module__}.{kernel.__qualname__}"
    if kept("kernel", lambda: who) != who:
        _KEPT.clear()
        kept("kernel", lambda: who)
    return kernel()


def hand_back() -> None:
    """Memory that this worker holds but does not use goes back to the system, where its library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, and :func:`hand_back` after it.

    Workers go from task to task: without it what one step took at most would
    stay with each of them under the steps that follow.
    """
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            hand_back()
    return whole


def annotate(df: DataFrame, text: str, kernel: Callable[[], Kernel], fields: str,
             keep: list[str], into: str | None = None) -> DataFrame:
    """Columns ``keep`` of each row with the kernel's columns for its text.

    ``kernel`` makes the kernel once per task; the kernel turns a list of
    UTF-8 texts (None for null) into one sequence per field of ``fields``, a
    DDL list. With ``into`` they come as one struct of that name. A kept
    column of the same name as a result gives way to the result.
    """
    spark = df.sparkSession
    ship(spark)
    made = StructType.fromDDL(fields)
    names = [into] if into else made.fieldNames()
    keep = [c for c in keep if c not in names]
    source = df.select(*named(*keep)) if text in keep else df.select(*named(*keep, text))
    schema = StructType(source.schema.fields[:len(keep)])
    at = source.columns.index(text)
    plain = source.toDF(*[f"_{k}" for k in range(len(source.columns))])   # names with dots would not resolve
    schema = schema.add(into, made) if into else StructType(schema.fields + made.fields)
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = begun(kernel)
        for whole in batches:
            for batch in bounded(whole, f"_{at}"):
                out = apply(texts_of(batch, f"_{at}"))
                columns = [pa.array(out[f.name], type=f.type) for f in arrow]
                kept = [batch.column(k) for k in range(len(keep))]
                if into:
                    columns = [pa.StructArray.from_arrays(columns, fields=list(arrow))]
                yield pa.RecordBatch.from_arrays(kept + columns, names=keep + names)

    return plain.mapInArrow(tidy(run), schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Index(dict):
    """Numbers words as they come; ``fresh`` collects the new ones.

    A task keeps what it worked out per word under these numbers. ``codes``
    starts over once ``limit`` words are held, so memory stays bounded; the
    caller sees that by ``fresh`` beginning at number 0.
    """

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit
        self.fresh: list = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def codes(self, words: list) -> tuple[np.ndarray, list, bool]:
        """Numbers of the words, the new words in order, and whether all began anew."""
        anew = len(self) >= self.limit or not self
        if anew:
            self.clear()
        self.fresh = []
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return numbers, self.fresh, anew


class Flat:
    """Lists of ids in one growing array, by the number of their word."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.ids = np.zeros(1 << 16, np.uint32)      # ids of all words in a row
        self.starts = np.zeros(1 << 14, np.int64)    # where each word's begin
        self.sizes = np.zeros(1 << 14, np.int64)
        self.used = self.count = 0

    def add(self, lists: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        total, words = self.used + int(sizes.sum()), self.count + len(lists)
        self.ids, self.starts, self.sizes = _room(self.ids, total), _room(self.starts, words), _room(self.sizes, words)
        self.ids[self.used:total] = np.fromiter(chain.from_iterable(lists), np.uint32, total - self.used)
        self.sizes[self.count:words] = sizes
        self.starts[self.count:words] = self.used + np.cumsum(sizes) - sizes
        self.used, self.count = total, words

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has."""
        sizes = self.sizes[codes]
        first = np.repeat(self.starts[codes] - (np.cumsum(sizes) - sizes), sizes)
        return self.ids[first + np.arange(len(first))], sizes


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    grown = np.zeros(max(size, 2 * len(array)), array.dtype)
    grown[:len(array)] = array
    return grown
