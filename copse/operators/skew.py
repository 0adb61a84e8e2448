"""Joins whose busiest key may hold a large share of one side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_ROWS = 1_000_000
HOT_KEYS = 50_000
SALTS = 64
#: Rows of a table up to which it is sent to every task, so that what it meets stays where it is.
FEW_ROWS = 500_000


def is_few(table: DataFrame, most: int | None = None) -> bool:
    """Whether ``table`` has at most ``most`` rows; counting ends there."""
    most = FEW_ROWS if most is None else most
    return table.limit(most + 1).count() <= most


def few(table: DataFrame, most: int | None = None) -> DataFrame:
    """``table``, marked for broadcasting if it has at most ``most`` narrow rows (counted: pass what is cheap to read)."""
    return F.broadcast(table) if is_few(table, most) else table


def whole_trees(rows: DataFrame) -> DataFrame:
    """``rows`` with each tree in one task, by tree and node.

    They are dealt by a term that no join below has dealt them by: Spark leaves out
    a shuffle that a join on ``tree_index`` seems to have done, and then adaptive
    plans part a large tree among the tasks of that join.
    """
    return rows.repartition(F.xxhash64("tree_index")).sortWithinPartitions("tree_index", "node_id")


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], counts: DataFrame, count: str,
                spread: str, how: str = "inner", few_table: bool = True) -> DataFrame:
    """Join ``rows`` to ``table`` although a key may match a third of the rows.

    ``counts`` has one row per key with the number of ``rows`` it matches, a
    number callers know already. Keys above ``HOT_ROWS`` are joined apart: their
    rows are spread over ``SALTS`` sub-keys by the hash of ``spread``, and their
    table rows are repeated for each. There are at most ``len(rows) / HOT_ROWS``
    such keys; their list is broadcast up to ``HOT_KEYS`` entries, counted
    first, and joined beyond that. A table of at most ``FEW_ROWS`` rows, and of
    fewer than make a key hot, is broadcast instead if ``few_table`` allows for
    counting it.
    """
    if few_table and is_few(table, min(FEW_ROWS, HOT_ROWS)):
        return rows.join(F.broadcast(table), on, how)
    hot = counts.where(F.col(count) > HOT_ROWS).select(*on)
    found = hot.limit(HOT_KEYS + 1).count()
    if found == 0:
        return rows.join(table, on, how)
    keys = F.broadcast(hot) if found <= HOT_KEYS else hot
    calm = rows.join(keys, on, "left_anti").join(table, on, how)
    salt = F.pmod(F.xxhash64(F.col(spread)), F.lit(SALTS)).cast("int")
    busy = rows.join(keys, on, "left_semi").withColumn("_salt", salt)
    copies = table.join(keys, on, "left_semi").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return calm.unionByName(busy.join(copies, [*on, "_salt"], how).drop("_salt"))
