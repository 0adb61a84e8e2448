"""Mutations stored by position in numbered blocks, with what is needed to read few of them.

Three tables: ``rows`` in (position, id) order, each with its number and block;
``blocks``, one row a block (first and last position, first id, rows before
it); ``nodes``, for each node the blocks that hold rows of it. A page of a
window becomes a range of row numbers by looking up its two borders, each in
one block, so it costs the blocks it lies in, however deep its offset.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from copse.operators.mutations import numbered, search_bounds

BLOCK_ROWS = 65_536
#: Blocks that share a folder.
FOLDER_BLOCKS = 256
#: Blocks of a node that a read may name in its plan; more are joined.
LISTED_BLOCKS = 512


class Store(NamedTuple):
    rows: DataFrame
    blocks: DataFrame
    nodes: DataFrame


def write_store(mutations: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> None:
    """Write mutations that have ``id``, ``position`` and ``node_id``, whatever other columns they carry."""
    block = F.expr(f"row div {int(block_rows)}")
    rows = numbered(mutations).withColumn("block", block).withColumn("folder", F.expr(f"block div {FOLDER_BLOCKS}"))
    (rows.repartitionByRange("row").sortWithinPartitions("row").write.mode("overwrite").option(
        "parquet.block.row.count.limit", int(block_rows)).partitionBy("folder").parquet(f"{path}/rows"))
    rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")   # columns, for a table without rows
    stored = open_rows(mutations.sparkSession, path)
    first = F.min(F.struct("position", "id"))
    stored.groupBy("block").agg(first.alias("_f"), F.max("position").alias("last_position"), F.count("*").alias("n")).select(
        "block", F.col("_f.position").alias("first_position"), F.col("_f.id").alias("first_id"), "last_position", "n",
        (F.col("block") * int(block_rows)).alias("before")).repartitionByRange("block").sortWithinPartitions(
        "block").write.mode("overwrite").parquet(f"{path}/blocks")
    stored.groupBy("node_id", "block").agg(F.count("*").alias("n")).repartitionByRange(
        "node_id", "block").sortWithinPartitions("node_id", "block").write.mode("overwrite").parquet(f"{path}/nodes")


def open_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/shape").schema).parquet(f"{path}/rows")


def open_store(spark: SparkSession, path: str) -> Store:
    return Store(open_rows(spark, path), *(spark.read.parquet(f"{path}/{name}") for name in ("blocks", "nodes")))


def of_blocks(store: Store, first: int, last: int) -> DataFrame:
    """Rows of the blocks ``first .. last``; folders and row groups of others are not read."""
    block, folder = F.col("block"), F.col("folder")
    return store.rows.where((folder >= first // FOLDER_BLOCKS) & (folder <= last // FOLDER_BLOCKS)
                            & (block >= first) & (block <= last)).drop("folder")


def _before(store: Store, candidates: Column, ahead: Column) -> int:
    """Number of rows ``ahead`` of a border, which lies in the last block that ``candidates`` name."""
    at = store.blocks.where(candidates).agg(F.max_by(F.struct("block", "before"), "block").alias("b")).first()["b"]
    if at is None:
        return 0
    return at["before"] + of_blocks(store, at["block"], at["block"]).where(ahead).count()


def rows_before(store: Store, position: float) -> int:
    """Number of mutations at positions below the given one."""
    at = F.lit(float(position))
    return _before(store, F.col("first_position") < at, F.col("position") < at)


def rows_through(store: Store, position: float, mutation_id: int) -> int:
    """Number of mutations up to and including the key ``(position, id)``."""
    key = F.struct(F.lit(float(position)).alias("position"), F.lit(int(mutation_id)).cast("long").alias("id"))
    first = F.struct(F.col("first_position").alias("position"), F.col("first_id").cast("long").alias("id"))
    return _before(store, first <= key, F.struct("position", F.col("id").cast("long").alias("id")) <= key)


def _numbered_from(store: Store, first: int, last: int, block_rows: int) -> DataFrame:
    """Rows ``first .. last - 1`` by number."""
    if first >= last:
        return store.rows.drop("folder").limit(0)
    row = F.col("row")
    return of_blocks(store, first // block_rows, (last - 1) // block_rows).where((row >= first) & (row < last))


def _block_rows(store: Store) -> int:
    """Rows of a full block; all blocks but the last one are full."""
    found = store.blocks.where("block <= 1").agg(F.max("before").alias("b"), F.max("n").alias("n")).first()
    return (found["b"] or found["n"]) or 1


def window_page(store: Store, start: float, end: float, offset: int = 0, limit: int = 1000,
                after: tuple[float, int] | None = None) -> DataFrame:
    """A page of the mutations with ``start <= position < end``, in order.

    ``after`` is the key ``(position, id)`` a former page ended with; a page
    that follows it needs no offset.
    """
    begin = rows_before(store, start)
    if after is not None:
        begin = max(begin, rows_through(store, *after))
    first = begin + max(0, int(offset))
    last = min(first + max(1, int(limit)), rows_before(store, end))
    return _numbered_from(store, first, last, _block_rows(store)).orderBy("row")


def window_summary(store: Store, start: float, end: float, offset: int = 0, limit: int = 1000) -> DataFrame:
    """One row ``(total_count, has_more)``, from the borders alone."""
    total = max(0, rows_before(store, end) - rows_before(store, start))
    more = max(0, offset) + max(1, limit) < total
    return store.rows.sparkSession.createDataFrame([(total, more)], "total_count long, has_more boolean")


def near_page(store: Store, position: float, range_bp: float, length: float, offset: int = 0,
              limit: int = 1000) -> DataFrame:
    """Mutations around a position with their ``distance``, nearest first; ties by position and id.

    Of either side only as many rows as the page can reach are read, and on the
    left the rest of the last position among them, whose ids come first.
    """
    start, end = search_bounds(position, range_bp, length)
    reach, size = max(0, int(offset)) + max(1, int(limit)), _block_rows(store)
    low, middle, high = (rows_before(store, p) for p in (start, position, end))
    first, last = max(low, min(middle, high) - reach), min(high, middle + reach)
    if low < first < last:
        edge = _numbered_from(store, first, first + 1, size).select("position").first()[0]
        first = rows_before(store, edge)
    distance = F.abs(F.col("position") - F.lit(float(position)))
    rows = _numbered_from(store, first, last, size).withColumn("distance", distance)
    return rows.orderBy("distance", "position", "id").offset(max(0, int(offset))).limit(max(1, int(limit)))


def on_node(store: Store, node_id: int, left: float | None = None, right: float | None = None) -> DataFrame:
    """Mutations above one node, inside ``[left, right)`` where given; only blocks that hold some are read."""
    held = store.nodes.where(F.col("node_id") == int(node_id)).select("block")
    if left is not None or right is not None:
        near = store.blocks
        near = near if left is None else near.where(F.col("last_position") >= F.lit(float(left)))
        near = near if right is None else near.where(F.col("first_position") < F.lit(float(right)))
        held = held.join(near.select("block"), "block", "left_semi")
    found = [r["block"] for r in held.limit(LISTED_BLOCKS + 1).collect()]
    if len(found) <= LISTED_BLOCKS:
        rows = store.rows.where(F.col("folder").isin(sorted({b // FOLDER_BLOCKS for b in found})) & F.col("block").isin(found))
    else:
        rows = store.rows.join(held, "block", "left_semi")
    rows = rows.where(F.col("node_id") == int(node_id)).drop("folder")
    if left is not None:
        rows = rows.where(F.col("position") >= F.lit(float(left)))
    return rows if right is None else rows.where(F.col("position") < F.lit(float(right)))
