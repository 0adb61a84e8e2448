"""Newick collections derived from orders: one tree per order over its items.

The leaves are the line numbers, the n-th one hanging n steps down a ladder, so
results can be told from the rows without reading tree text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from copse.operators import intervals as I
from copse.session import written

CHROM_ROWS = 4096


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))


_WRITTEN: dict[tuple[str, str], DataFrame] = {}


def order_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of all orders, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        _WRITTEN[key] = written(_order_trees(spark, sf_dir), "order-trees")
    return _WRITTEN[key]


def _order_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(orderkey, newick, n_leaves, top)`` per order; at most seven leaves each."""
    leaf = F.struct(F.col("l_linenumber").alias("n"), F.col("q"))
    per_order = _leaves(spark, sf_dir).groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(leaf)).alias("leaves"), F.max("q").alias("top"))
    text = F.transform("leaves", lambda v: F.concat(
        F.lit("S"), v["n"].cast("string"), F.lit(":"), v["q"].cast("string")))
    k = F.size(text)
    last = F.element_at(text, -1)
    rest = F.reverse(F.slice(text, 1, k - 1))
    ladder = F.aggregate(
        rest, last, lambda acc, v: F.concat(F.lit("("), v, F.lit(","), acc, F.lit(")1:1.0")))
    newick = F.when(k == 1, F.concat(F.lit("("), last, F.lit(");"))).otherwise(
        F.concat(F.substring(ladder, F.lit(1), F.length(ladder) - 5), F.lit(";")))
    return per_order.select(F.col("l_orderkey").alias("orderkey"), newick.alias("newick"),
                            k.cast("long").alias("n_leaves"), "top")


def _position(key) -> F.Column:
    return key * 100 + key * 37 % 90


def raw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees as the columns of a CSV file, with metadata-only rows at the end."""
    key = F.col("orderkey")
    blank = F.lit(None).cast("string")
    trees = order_trees(spark, sf_dir).select(
        _position(key).cast("string").alias("genomic_positions"), "newick",
        F.when(key % 4 != 0, (F.col("top") + 10).cast("string")).alias("max_branch_length"),
        F.when(key % 3 == 0, F.concat(F.lit("run"), (key % 7).cast("string"))).alias("tree info"),
        blank.alias("samples"), F.lit("trees").alias("_file"), F.lit(0).cast("long").alias("_block"),
        key.cast("long").alias("_line"))
    names = _leaves(spark, sf_dir).select("l_linenumber").distinct().select(
        blank.alias("genomic_positions"), blank.alias("newick"),
        blank.alias("max_branch_length"), blank.alias("tree info"),
        F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("samples"),
        F.lit("zz").alias("_file"), F.lit(0).cast("long").alias("_block"),
        (-F.col("l_linenumber")).cast("long").alias("_line"))
    return trees.unionByName(names)


def window_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(position_id, newick)``; orders without items leave gaps."""
    key = F.col("orderkey")
    size = F.lit(CHROM_ROWS)
    return order_trees(spark, sf_dir).select(
        F.concat(F.lit("chr"), (F.floor(key / size) + 1).cast("string"), F.lit("_"),
                 (key % size + 1).cast("string")).alias("position_id"), "newick")


def tree_intervals(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Intervals of the numbered tree rows."""
    return I.intervals_from_starts(rows.select("tree_index", "position"))
