"""Differences between trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from copse.operators.blocks import cover, holding
from copse.operators.ordered import fold_changes
from copse.operators.skew import is_few
from copse.session import written

#: Changes times stretches that a task sums up.
TASK_ROWS = 1_000_000


def request_pairs(tn_or_edges: DataFrame, requested: list[int], n_trees: int) -> DataFrame:
    """Consecutive valid trees of a request: ``(pair, prev_tree, next_tree)``."""
    valid = [int(t) for t in requested if 0 <= int(t) < n_trees]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(valid, valid[1:]))]
    return tn_or_edges.sparkSession.createDataFrame(
        rows, "pair int, prev_tree long, next_tree long")


def pairs_of(requested: DataFrame) -> DataFrame:
    """Neighbours in a request ``(pos, tree_index)``: ``(pair, prev_tree, next_tree)``, ``pos`` counting from 0 without gaps."""
    after = requested.select((F.col("pos") - 1).alias("pos"), F.col("tree_index").alias("next_tree"))
    return requested.join(after, "pos").select(
        F.col("pos").alias("pair"), F.col("tree_index").alias("prev_tree"), "next_tree")


def pair_differences(spans: DataFrame, pairs: DataFrame, n_trees: int) -> DataFrame:
    """The rows of :func:`edge_differences` for any pairs of trees, from edge spans.

    What an edge loses or gains between two trees is the sum of its starts and
    ends on the way from one to the other. Those meet the stretches of the pairs
    in blocks of trees; edges that both trees hold are never looked at. Stretches
    of few pairs are sent to the changes, which are dealt by edge to as many tasks
    as their sums take.
    """
    changes = written(fold_changes(spans, ["parent", "child"], "first_tree", "last_tree", {"delta": F.lit(1)}), "changes")
    low, high = F.least("prev_tree", "next_tree"), F.greatest("prev_tree", "next_tree")
    ways = pairs.select("pair", "prev_tree", "next_tree", F.inline(cover(low + 1, high + 1)))
    end = F.lit(n_trees + 1)
    if is_few(ways):
        changes, ways = _dealt(changes, ways, end), F.broadcast(ways)
    points = changes.select("parent", "child", "delta", F.inline(holding(F.col("tree_index"), end)))
    key = ["pair", "prev_tree", "next_tree", "parent", "child"]
    net = points.join(ways, ["level", "block"]).groupBy(*key).agg(F.sum("delta").alias("net")).where("net <> 0")
    gained = (F.col("net") > 0) == (F.col("next_tree") > F.col("prev_tree"))
    return net.select("pair", "prev_tree", "next_tree", F.when(gained, "inserted").otherwise("removed").alias("change"),
                      "parent", "child")


def _dealt(changes: DataFrame, ways: DataFrame, end: Column) -> DataFrame:
    """``changes`` by edge, in parts that meet about ``TASK_ROWS`` stretches each.

    Left as they are where a single edge may meet more than that.
    """
    each = changes.groupBy("tree_index").agg(F.count("*").alias("n"))
    met = each.select("n", F.inline(holding(F.col("tree_index"), end))).join(
        F.broadcast(ways), ["level", "block"]).agg(F.sum("n")).first()[0] or 0
    busiest = changes.groupBy("parent", "child").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if busiest * ways.select("pair").distinct().count() > TASK_ROWS:
        return changes
    return changes.repartition(max(1, -(-met // TASK_ROWS)), "parent", "child")


def edge_differences(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges of only one tree of a pair:
    ``(pair, prev_tree, next_tree, change, parent, child)``.

    Each edge row is tagged with the pairs it belongs to and the sides are
    counted per edge, so both set differences cost one shuffle.
    """
    roles = pairs.select("pair", "prev_tree", "next_tree", F.explode(F.array(
        F.struct(F.col("prev_tree").alias("tree_index"), F.lit(True).alias("is_prev")),
        F.struct(F.col("next_tree").alias("tree_index"), F.lit(False).alias("is_prev"))
    )).alias("_r")).select("pair", "prev_tree", "next_tree", "_r.*")
    both = edges.select("tree_index", "parent", "child").join(roles, "tree_index")
    sides = both.groupBy("pair", "prev_tree", "next_tree", "parent", "child").agg(
        F.bool_or("is_prev").alias("before"), F.bool_or(~F.col("is_prev")).alias("after"))
    return sides.where(F.col("before") != F.col("after")).select(
        "pair", "prev_tree", "next_tree",
        F.when(F.col("after"), "inserted").otherwise("removed").alias("change"),
        "parent", "child")


def neighbour_differences(spans: DataFrame, n_trees: int) -> DataFrame:
    """Edges that change at each inner breakpoint: ``(tree_index, change, parent, child)``.

    ``tree_index`` is the tree right of the breakpoint. Reads edge spans only:
    an edge starts or ends there, and one that is merely split cancels out.
    """
    ends = fold_changes(spans, ["parent", "child"], "first_tree", "last_tree",
                        {"delta": F.lit(1)})
    return ends.where((F.col("tree_index") > 0) & (F.col("tree_index") < n_trees)).select(
        "tree_index", F.when(F.col("delta") > 0, "inserted").otherwise("removed").alias("change"),
        "parent", "child")


def with_coordinates(differences: DataFrame, placed: DataFrame) -> DataFrame:
    """Coordinates of both ends, in the tree the edge belongs to."""
    home = F.when(F.col("change") == "inserted", F.col("next_tree")).otherwise(F.col("prev_tree"))
    out = differences.withColumn("tree_index", home)
    for end in ("parent", "child"):
        out = out.join(placed.select("tree_index", F.col("node_id").alias(end),
                                     F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y")),
                       ["tree_index", end])
    return out


def change_counts(differences: DataFrame) -> DataFrame:
    """Inserted and removed edges per breakpoint."""
    return differences.groupBy("tree_index").agg(
        F.count_if(F.col("change") == "inserted").alias("n_inserted"),
        F.count_if(F.col("change") == "removed").alias("n_removed"))

