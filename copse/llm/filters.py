"""How filters overlap: a stream that keeps, per text, the least id and takes back what it said before.

Files arrive in micro-batches. A document's own failures are a mask of bits;
whether a smaller id has the same text is known only up to now, so the stream
keeps, under the digest of each text, the least id seen and the documents that
have it (many texts a bucket, so that a bucket's rows are handled together). A smaller id takes back the mask counted for them, as failing no copy
filter, and counts them again as copies. What leaves the stream are changes of
counters per part and mask; everything a report says follows from their sums.

Copies within an Arrow batch are put together before they meet the state: all
but those of the least id are copies for sure, and are handed on as one row per
part. So a text that a third of all rows hold reaches its state as a few rows.

Defined results: a null text counts as empty, a null part as the empty string;
rows without an id are no copies and make none; rows that repeat the least id
are no copies of each other; of several labels of an id a 1 counts; an empty
table has no parts and gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState

from copse.llm.batches import annotate, named
from copse.session import checkpoint_dir, removed, ship, written

FILTERS = "ABCDE"
#: The bit of the filter that looks at other documents.
COPY = 1 << FILTERS.index("E")
#: Bytes of files that a micro-batch takes, and buckets of the state; raise both with the table.
BATCH_BYTES, BUCKETS = 128 << 20, 1024

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))
_SIGN = re.compile(rb"[#$%&*|]")


def own_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()                                 # bytes split at ASCII white space
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUED))
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * upper > 3 * points) << 2 | bool(_SIGN.search(text)) << 3)


def _kernel() -> Callable:
    def run(texts: list[bytes | None]) -> dict[str, object]:
        return {"mask": [own_mask(t or b"") for t in texts],
                "digest": [hashlib.sha256(t or b"").digest() for t in texts]}
    return run


def masked(df: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """``(doc_id, part, mask, digest)`` of the rows of a table or stream."""
    rows = df.select(named(doc_id)[0].alias("doc_id"), F.coalesce(*named(part), F.lit("")).alias("part"),
                     named(text)[0].alias("text"))
    return annotate(rows, "text", _kernel, "mask int, digest binary", ["doc_id", "part"])


def judged(labels: DataFrame) -> DataFrame:
    """``(doc_id, good, toxic)`` once per id."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))


ENTRY = ["part", "mask", "good", "toxic"]
_HELD = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()),
                   ("good", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())])


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one text, id and entry as one with their number; those above the least id without id, as copies."""
    for rows in batches:
        least = rows.groupby("digest")["doc_id"].transform("min")
        rows["copy"] = rows["doc_id"].notna() & (rows["doc_id"] > least)
        rows["doc_id"] = rows["doc_id"].astype("Int64").where(~rows["copy"])
        yield rows.groupby(["digest", "doc_id", "copy", *ENTRY], dropna=False, as_index=False).size().rename(
            columns={"size": "n"})


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, schema=_HELD, preserve_index=False)
    with pa.ipc.new_stream(sink, _HELD) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _counted(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of counters that the rows of one bucket bring; the state is who has the least id of each of its texts."""
    rows = pd.concat(batches)
    held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else _HELD.empty_table().to_pandas()
    placed = rows[rows["doc_id"].notna()].astype({"doc_id": "int64"})
    both = pd.concat([held, placed[held.columns]])
    least = both.groupby("digest")["doc_id"].transform("min").to_numpy()
    behind = both["doc_id"].to_numpy() > least
    before = np.arange(len(both)) < len(held)

    def changed(some: pd.DataFrame, copies: int, sign: int) -> pd.DataFrame:
        return some.assign(mask=some["mask"] | copies, n=sign * some["n"])[[*ENTRY, "n"]]

    first = both[~behind]
    if len(first) != len(held) or behind.any():
        state.update((_packed(first.groupby([c for c in first.columns if c != "n"], as_index=False, sort=False)["n"].sum()),))
    rest = rows[rows["doc_id"].isna()]
    yield pd.concat([
        changed(rest[~rest["copy"]], 0, 1), changed(rest[rest["copy"]], COPY, 1),     # without an id; copies for sure
        changed(both[~before & ~behind], 0, 1), changed(both[~before & behind], COPY, 1),
        changed(both[before & behind], 0, -1), changed(both[before & behind], COPY, 1),   # no longer the least
    ]).groupby(ENTRY, as_index=False)["n"].sum()


def changes(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, **columns: str) -> DataFrame:
    """The stream ``(part, mask, good, toxic, n)`` of changes of counters for a stream of documents."""
    ship(docs.sparkSession)
    rows = masked(docs, **columns).join(labels, "doc_id", "left").select(
        "digest", "doc_id", "part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    joined = rows.mapInPandas(_combined, "digest binary, doc_id long, copy boolean, part string, mask int, "
                                         "good int, toxic int, n long")
    dealt = joined.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(
        _counted, "part string, mask int, good int, toxic int, n long", "held binary", "append", "NoTimeout")


def _folder_or_pattern(spark: SparkSession, path: str) -> str:
    """A stream reads folders or patterns; a single file is given as a pattern that only it meets."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{path[:-1]}[{path[-1]}]" if system.getFileStatus(place).isFile() else path


def counters(spark: SparkSession, path: str, labels: DataFrame, folder: str,
             batch_bytes: int = BATCH_BYTES, buckets: int = BUCKETS, **columns: str) -> DataFrame:
    """Read all Parquet files below ``path`` that ``folder`` has not met yet; ``(part, mask, good, toxic, n)``.

    ``folder`` holds the stream's progress, its state and the changes of each
    micro-batch, so a second call takes up new files only, and a batch run
    again after a failure replaces what it wrote. The state is as large as ids
    and digests of all texts, in ``buckets`` that a micro-batch reads and writes
    whole where it has a text of theirs: one per 128 KB of ``batch_bytes`` keeps
    that well below the texts themselves. Their number stays the same for a
    folder. Sessions whose executors cannot hold the state set Spark's RocksDB store.
    """
    once = written(judged(labels), "labels")
    docs = spark.readStream.schema(spark.read.parquet(path).schema).option(
        "maxBytesPerTrigger", batch_bytes).parquet(_folder_or_pattern(spark, path))

    def kept(changed: DataFrame, batch: int) -> None:
        changed.groupBy(*ENTRY).agg(F.sum("n").alias("n")).where("n <> 0").coalesce(1).write.mode(
            "overwrite").parquet(f"{folder}/changes/batch={batch}")

    stream = changes(docs, once, buckets, **columns)
    schema = stream.schema
    query = stream.writeStream.foreachBatch(kept).option(
        "checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/changes/batch=-1")
    total = spark.read.schema(schema).parquet(f"{folder}/changes").groupBy(*ENTRY).agg(F.sum("n").alias("n"))
    total = written(total.where("n <> 0"), "counters")
    removed(once)
    return total


def _steps() -> list[tuple[int, int, int]]:
    """``(filter bit, bits of those before it, number of orders)`` of all 80 cases."""
    bits = [1 << k for k in range(len(FILTERS))]
    return [(bit, sum(before), math.factorial(k) * math.factorial(len(bits) - 1 - k))
            for bit in bits for k in range(len(bits))
            for before in combinations([b for b in bits if b != bit], k)]


def report(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from counters ``(part, mask, good, toxic, n)``."""
    spark = counts.sparkSession
    cases = spark.createDataFrame(
        [(bit, before, orders, mask, mask & (before | bit) == 0, bool(mask & bit) and not mask & before,
          bool(mask & bit) and bool(mask & before), mask == bit)
         for bit, before, orders in _steps() for mask in range(1 << len(FILTERS))],
        "bit int, before int, orders long, mask int, kept boolean, removed boolean, redundant boolean, alone boolean")
    places = spark.createDataFrame(
        [("".join(order), k + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(x) for x in order[:k]))
         for order in permutations(FILTERS) for k, f in enumerate(order)],
        "filter_order string, step int, bit int, before int")

    def total(name: str, test: str) -> F.Column:
        return F.sum(F.when(F.expr(test), F.col("n")).otherwise(0)).alias(name)

    found = counts.join(F.broadcast(cases), "mask").groupBy("part", "bit", "before", "orders").agg(
        total("kept", "kept"), total("removed", "removed"), total("redundant", "redundant"),
        total("unique_fails", "alone"), total("good_lost", "removed AND good = 1"), total("toxic_lost", "removed AND toxic = 1"))
    value = found.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return found.join(value, ["part", "bit"]).join(F.broadcast(places), ["bit", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(spark: SparkSession, path: str, labels: DataFrame, batch_bytes: int = BATCH_BYTES,
            buckets: int = BUCKETS) -> DataFrame:
    """The report over all files of a table, streamed once through a fresh state."""
    from uuid import uuid4
    return report(counters(spark, path, labels, f"{checkpoint_dir(spark)}/audit-{uuid4().hex}", batch_bytes, buckets))
