"""Giant trees by their inner nodes.

Most nodes of a tree are tips, and a tip's place follows from its family: the
siblings before it and what hangs below them. One range-partitioned pass puts
the families in order and counts, in front of every child, the tips and the
inner nodes among its earlier siblings. What is left to solve is the skeleton,
a row per inner node with the tips around it, whole trees of which stream through a
kernel. Tips then read where the gap between two inner siblings begins, by one join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from copse.operators.skew import whole_trees
from copse.session import cut, written

#: A family and the gap in it that a child stands in: behind so many inner siblings.
GAP = ["tree_index", "top", "family", "gap"]
SKELETON = ("tree_index long, node_id long, family long, under_top boolean, is_top boolean, orphan boolean, "
            "before long, gap long, tips long, kids long, first_inner boolean, last_inner boolean")
SOLVED = ("tree_index long, top boolean, family long, gap long, tip_start long, entered long, depth long, "
          "node_tips long, node_below long, node_x double, all_tips long, all_nodes long")


class Families(NamedTuple):
    """Children in family order with what stands before them, and the inner nodes."""

    rows: DataFrame
    skeleton: DataFrame
    columns: list[str]


def families(large: DataFrame, visit: Column) -> Families:
    """Rows of ``large`` with ``is_inner``, their gap (``GAP``) and ``before``, the tips among their earlier siblings.

    Other columns travel as one struct ``row``, so that any names will do.
    """
    columns = large.columns
    if "n_children" in large.columns:
        inner = F.coalesce(F.col("n_children") > 0, F.lit(False))
    else:
        held = large.where("parent_id IS NOT NULL").select(
            "tree_index", F.col("parent_id").alias("node_id"), F.lit(True).alias("_held")).distinct()
        large, inner = large.join(held, ["tree_index", "node_id"], "left"), F.col("_held").isNotNull()
    rest = [c for c in columns if c not in ("tree_index", "node_id", "parent_id")]
    rows = large.select(
        "tree_index", "node_id", F.col("parent_id").isNull().alias("top"), F.coalesce("parent_id", F.lit(0)).cast("long").alias("family"),
        inner.alias("is_inner"), visit.cast("long").alias("_visit"), *([F.struct(*rest).alias("row")] if rest else []))
    order = ["tree_index", F.col("top").desc(), "family", "_visit", "node_id"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_visit")
    schema = StructType([*placed.schema, StructField("_tips", LongType()), StructField("_inner", LongType())])
    counted = written(placed.mapInArrow(_count_siblings, schema).withColumn("_part", F.spark_partition_id()), "families")

    # A family that goes on in the next partition takes its counts along.
    key, at = ["tree_index", "top", "family"], F.col("_tips") + F.col("_inner")
    parts = written(counted.groupBy(*key, "_part").agg(
        F.count_if(~F.col("is_inner")).alias("t"), F.count_if("is_inner").alias("i"),
        F.min_by("is_inner", at).alias("f"), F.max_by("is_inner", at).alias("l")), "family-parts")
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)   # a row a partition
    carried = parts.select("_part", *key, F.sum("t").over(earlier).alias("_t"), F.sum("i").over(earlier).alias("_i")).where(
        "_t IS NOT NULL")                                            # at most one family a partition
    zero = F.lit(0).cast("long")
    rows = counted.join(F.broadcast(carried), [*key, "_part"], "left").withColumns({
        "before": F.col("_tips") + F.coalesce("_t", zero), "gap": F.col("_inner") + F.coalesce("_i", zero)}).drop(
        "_tips", "_inner", "_t", "_i", "_part")

    held = parts.groupBy(*key).agg(
        F.sum("t").alias("tips"), F.sum("i").alias("kids"), F.min_by("f", "_part").alias("first_inner"),
        F.max_by("l", "_part").alias("last_inner")).select(
        "tree_index", F.col("top").alias("is_top"), F.col("family").alias("node_id"), "tips", "kids", "first_inner", "last_inner")
    inner = rows.where("is_inner").select(
        "tree_index", F.lit(False).alias("is_top"), "node_id", "family", F.col("top").alias("under_top"), "before", "gap",
        F.lit(True).alias("_known"))
    no = F.lit(False)
    skeleton = written(inner.join(held, ["tree_index", "is_top", "node_id"], "full").select(
        "tree_index", "node_id", F.coalesce("family", zero).alias("family"), F.coalesce("under_top", no).alias("under_top"),
        "is_top", (~F.col("is_top") & F.col("_known").isNull()).alias("orphan"),
        *[F.coalesce(c, zero).alias(c) for c in ("before", "gap", "tips", "kids")],
        F.coalesce("first_inner", no).alias("first_inner"), F.coalesce("last_inner", no).alias("last_inner")), "skeleton")
    return Families(rows, skeleton, columns)


def _count_siblings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tips and inner nodes before each row in its family; the family a batch ends in is carried on."""
    held, tips, inner = None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree_index", "top", "family")]
        is_inner = batch.column("is_inner").to_numpy(zero_copy_only=False).astype(np.int64)
        head = np.ones(n, bool)
        head[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        head[0] = held != tuple(k[0] for k in key)
        both = []
        for flags, so_far in ((1 - is_inner, tips), (is_inner, inner)):
            running = np.cumsum(flags) - flags
            base = running[np.maximum.accumulate(np.where(head, np.arange(n), 0))]
            since = np.maximum.accumulate(head)              # False in what goes on from the batch before
            both.append(running - base + np.where(since, 0, so_far))
        held = tuple(k[-1] for k in key)
        tips, inner = int(both[0][-1] + 1 - is_inner[-1]), int(both[1][-1] + is_inner[-1])
        columns = [*batch.columns, pa.array(both[0]), pa.array(both[1])]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_tips", "_inner"])


def solved(skeleton: DataFrame) -> DataFrame:
    """Where each gap of each family begins, with the numbers of the inner node behind it (``SOLVED``)."""
    from copse.operators.layout import complete_trees

    def kernel(batches):
        return complete_trees(batches, _solve)

    return written(whole_trees(skeleton).mapInPandas(kernel, SOLVED), "solved")


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    """Numbers of some whole skeletons."""
    rows = rows.sort_values(["tree_index", "is_top", "node_id"], ignore_index=True)
    if rows["orphan"].any():
        raise ValueError("a parent is not in its tree")
    n = len(rows)
    number = {c: rows[c].to_numpy() for c in rows.columns}
    links = rows[["tree_index", "under_top", "family"]].merge(
        pd.DataFrame({"tree_index": number["tree_index"], "under_top": number["is_top"], "family": number["node_id"],
                      "_at": np.arange(n)}), how="left", on=["tree_index", "under_top", "family"])["_at"]
    is_top = number["is_top"].astype(bool)
    if links[~is_top].isna().any():
        raise ValueError("a parent is not in its tree" if is_top.any() else "parent links form a cycle")
    parent = np.where(is_top, -1, links.fillna(-1).to_numpy().astype(np.int64))
    up = np.append(np.where(parent < 0, n, parent), n)
    depth = (up != n).astype(np.int64)
    for _ in range(int(n).bit_length() + 1):
        depth += depth[up]
        up = up[up]
    if (up != n).any():
        raise ValueError("parent links form a cycle")
    depth = depth[:-1]
    by_level = np.argsort(depth, kind="stable")
    levels = np.split(by_level, np.searchsorted(depth[by_level], np.arange(1, depth.max() + 1)))

    alone = (number["tips"] + number["kids"] == 0) & ~is_top     # said to have children, but has none here
    tips = number["tips"] + alone
    below = number["tips"].astype(np.int64).copy()
    for level in levels[:0:-1]:
        np.add.at(tips, parent[level], tips[level])
        np.add.at(below, parent[level], below[level] + 1)

    order = np.lexsort((number["gap"], parent))
    head = np.append(True, np.diff(parent[order]) != 0)
    base = np.maximum.accumulate(np.where(head, np.arange(n), 0))

    def earlier(values: np.ndarray) -> np.ndarray:
        running = np.cumsum(values[order]) - values[order]
        out = np.empty(n, np.int64)
        out[order] = running - running[base]
        return out

    tip_start, entered = earlier(tips), earlier(below + 1)       # where the gap before this node begins
    start, enter = np.zeros(n, np.int64), np.full(n, -1)
    for level in levels[1:]:
        tip_start[level] += start[parent[level]]
        entered[level] += enter[parent[level]] + 1
        start[level] = tip_start[level] + number["before"][level]
        enter[level] = entered[level] + number["before"][level]

    low = np.where(number["first_inner"], np.inf, start)
    high = np.where(number["last_inner"], -np.inf, start + tips - 1)
    x = np.empty(n)
    for at in range(len(levels) - 1, -1, -1):
        level = levels[at]
        x[level] = (low[level] + high[level]) / 2.0
        if at:
            np.minimum.at(low, parent[level], x[level])
            np.maximum.at(high, parent[level], x[level])

    tree = np.unique(number["tree_index"], return_inverse=True)[1]
    tops = np.flatnonzero(is_top)
    top = np.empty(tree.max() + 1, np.int64)
    top[tree[tops]] = tops
    inner = np.flatnonzero(~is_top)
    last = np.arange(n)                                          # the gap behind the last inner child, of every node
    out = [pd.DataFrame({
        "tree_index": number["tree_index"][inner], "top": number["under_top"][inner].astype(bool), "family": number["family"][inner],
        "gap": number["gap"][inner], "tip_start": tip_start[inner], "entered": entered[inner], "depth": depth[inner] - 1,
        "node_tips": tips[inner], "node_below": below[inner], "node_x": x[inner],
        "all_tips": tips[top[tree[inner]]], "all_nodes": below[top[tree[inner]]]}),
        pd.DataFrame({
            "tree_index": number["tree_index"], "top": is_top, "family": number["node_id"], "gap": number["kids"],
            "tip_start": start + tips - number["tips"], "entered": enter + 1 + below - number["tips"], "depth": depth[last],
            "node_tips": 0, "node_below": 0, "node_x": 0.0, "all_tips": tips[top[tree]], "all_nodes": below[top[tree]]})]
    return pd.concat(out, ignore_index=True)[[c.split()[0] for c in SOLVED.split(", ")]]


def larger_than(found: Families, kernel_nodes: int) -> DataFrame:
    """Trees whose skeleton is too large for one task."""
    return cut(found.skeleton.groupBy("tree_index").agg(F.count("*").alias("n")).where(
        F.col("n") > kernel_nodes + 1).select("tree_index"))


def without(found: Families, trees: DataFrame) -> Families:
    """The same without some trees."""
    return found._replace(rows=found.rows.join(trees, "tree_index", "left_anti"),
                          skeleton=found.skeleton.join(trees, "tree_index", "left_anti"))


def only(found: Families, trees: DataFrame) -> Families:
    """The same of some trees."""
    return found._replace(rows=found.rows.join(trees, "tree_index", "left_semi"),
                          skeleton=found.skeleton.join(trees, "tree_index", "left_semi"))


def _own(found: Families) -> list[Column]:
    """The columns that the rows came with."""
    made = {"tree_index": F.col("tree_index"), "node_id": F.col("node_id"),
            "parent_id": F.when(~F.col("top"), F.col("family"))}
    return [made[c].alias(c) if c in made else F.col("row")[c].alias(c) for c in found.columns]


def with_x(found: Families) -> DataFrame:
    """Rows of giant trees with ``x``, 0..1 over the tips of each tree."""
    place = F.when(F.col("is_inner"), F.col("node_x")).otherwise((F.col("tip_start") + F.col("before")).cast("double"))
    return found.rows.join(solved(found.skeleton), GAP).select(
        *_own(found), (place / F.greatest(F.lit(1), F.col("all_tips") - 1)).cast("float").alias("x"))


def with_numbers(found: Families, solve: Callable[[DataFrame], DataFrame] = solved) -> DataFrame:
    """Rows of giant trees with their nested numbers."""
    inner, enter = F.col("is_inner"), F.col("entered") + F.col("before")
    return found.rows.join(solve(found.skeleton), GAP).select(
        *_own(found), enter.alias("enter"), (enter + 1 + F.when(inner, F.col("node_below")).otherwise(0)).alias("leave"),
        "depth", F.when(inner, F.col("node_tips")).otherwise(1).cast("long").alias("n_tips"),
        F.col("all_nodes").alias("tree_size"))
