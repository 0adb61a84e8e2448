"""Horizontal layout and drawing geometry of trees.

Tips are numbered in depth-first order and an inner node sits half-way between
its outermost children. Trees up to ``kernel_nodes`` nodes stay whole in one
partition and stream through a vectorised kernel. Larger ones never enter one task:
their inner nodes do, if there are no more of those, and tips are placed in their
families (:mod:`copse.operators.skeleton`). With more inner nodes, tips are numbered
by list ranking over an Euler tour and inner nodes are solved by tree contraction,
a logarithmic number of joins on unique keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import FloatType, StructField, StructType

from copse.functions import coordinates as C
from copse.operators.ordered import SINGLE_TASK_ROWS, global_rank
from copse.operators.skeleton import families, larger_than, with_x, without
from copse.operators.skew import few, spread_join, whole_trees
from copse.session import cut, removed, written

KERNEL_NODES = 500_000


def visit_by_id() -> Column:
    """Visiting order among siblings: last id first, roots in id order."""
    return F.when(F.col("parent_id").isNull(), F.col("node_id")).otherwise(-F.col("node_id"))


def giant_trees(counts: DataFrame, kernel_nodes: int = KERNEL_NODES) -> DataFrame:
    """Trees too large for one task, from rows ``(tree_index, n_nodes)``."""
    return cut(counts.where(F.col("n_nodes") > kernel_nodes).select("tree_index"))


def layout_x(tn: DataFrame, visit: Column | None = None, giants: DataFrame | None = None,
             kernel_nodes: int = KERNEL_NODES,
             single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Tree nodes with ``x``, 0..1 over the tips of each tree.

    ``visit`` orders siblings (and roots), smallest first. ``giants`` (see
    :func:`giant_trees`) spares counting; without it the nodes are written
    once, counted and read again.
    """
    shape = tn.withColumn("visit", (visit_by_id() if visit is None else visit).cast("long"))
    if giants is None:
        shape = cut(shape)
        giants = giant_trees(shape.groupBy("tree_index").agg(F.count("*").alias("n_nodes")),
                             kernel_nodes)
    if giants.isEmpty():
        return _kernel_x(shape)
    giants = few(giants)                         # a row for so many nodes: all others stay where they are
    small = _kernel_x(shape.join(giants, "tree_index", "left_anti"))
    large = shape.join(giants, "tree_index", "left_semi")
    found = families(large.drop("visit") if visit is None else large, visit_by_id() if visit is None else F.col("visit"))
    branching = larger_than(found, kernel_nodes)
    if branching.isEmpty():
        return small.unionByName(with_x(found).select(*tn.columns, "x"))
    rest = with_x(without(found, branching)).select(*tn.columns, "x")
    large = cut(large.join(branching, "tree_index", "left_semi"))
    placed = large.drop("visit").join(
        _joined_x(large.select("tree_index", "node_id", "parent_id", "visit"),
                  single_task_rows), ["tree_index", "node_id"])
    return small.unionByName(rest).unionByName(placed)


def _kernel_x(shape: DataFrame) -> DataFrame:
    """Whole trees per partition, streamed in tree order through the kernel."""
    columns = shape.drop("visit").schema
    return whole_trees(shape).mapInPandas(_complete_trees, StructType([*columns, StructField("x", FloatType())]))


def _complete_trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return complete_trees(batches, _trees_x)


def complete_trees(batches: Iterator[pd.DataFrame], apply: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``apply`` to whole trees; the last tree of a batch is held back until its remaining rows have arrived."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        last = batch["tree_index"].iat[-1]
        at = int(np.searchsorted(batch["tree_index"].to_numpy(), last))
        if at:
            yield apply(pd.concat([*held, batch.iloc[:at]]))
            held = []
        elif held and held[-1]["tree_index"].iat[-1] != last:
            yield apply(pd.concat(held))
            held = []
        held.append(batch.iloc[at:])
    if held:
        yield apply(pd.concat(held))


def _levels(parent: np.ndarray) -> np.ndarray:
    """Distance to the root by pointer doubling."""
    up = np.append(parent, -1)
    up[up < 0] = len(parent)
    depth = (up != len(parent)).astype(np.int64)
    while (up != len(parent)).any():
        depth += depth[up]
        up = up[up]
    return depth[:-1]


def _trees_x(rows: pd.DataFrame) -> pd.DataFrame:
    """x of some whole trees, sorted by tree and node, one level of all at a time."""
    trees, tree = np.unique(rows["tree_index"].to_numpy(), return_inverse=True)
    ids, rank = np.unique(rows["node_id"].to_numpy(), return_inverse=True)
    known = rows["parent_id"].notna().to_numpy()
    above = np.searchsorted(ids, rows["parent_id"].to_numpy()[known].astype(np.int64))
    parent = np.full(len(rows), -1)
    parent[known] = np.searchsorted(tree * len(ids) + rank, tree[known] * len(ids) + above)
    depth = _levels(parent)
    by_level = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[by_level], np.arange(1, depth.max() + 1))
    levels = np.split(by_level, cuts)

    tips = np.ones(len(rows), dtype=np.int64)
    tips[parent[known]] = 0
    is_tip = tips == 1
    for level in levels[:0:-1]:
        np.add.at(tips, parent[level], tips[level])

    # Tips of earlier siblings: a running sum that restarts with each family.
    family = np.where(known, parent, -1 - tree)
    order = np.lexsort((rows["visit"].to_numpy(), family))
    running = np.cumsum(tips[order]) - tips[order]
    head = np.append(True, np.diff(family[order]) != 0)
    base = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    start = np.empty(len(rows), dtype=np.int64)
    start[order] = running - running[base]
    for level in levels[1:]:
        start[level] += start[parent[level]]

    low = np.where(is_tip, start, np.inf)
    high = np.where(is_tip, start, -np.inf)
    x = start.astype(np.float64)
    for depth_of, level in reversed(list(enumerate(levels))):
        inner = level[~is_tip[level]]
        x[inner] = (low[inner] + high[inner]) / 2.0
        if depth_of:
            np.minimum.at(low, parent[level], x[level])
            np.maximum.at(high, parent[level], x[level])
    width = np.maximum(1, np.bincount(tree[is_tip], minlength=len(trees)) - 1)
    return rows.drop(columns="visit").assign(x=(x / width[tree]).astype(np.float32))


def tip_ranks(shape: DataFrame, single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Depth-first number of every tip, ``(tree_index, node_id, rank)``.

    The tour visits each node going down and going up. Every visit knows only
    its successor; doubling the links log2(2n) times sums the tips still to come.
    """
    siblings = global_rank(shape, "tree_index", F.col("parent_id").asc_nulls_first(), "visit",
                           out="place", single_task_rows=single_task_rows)
    right = siblings.select((F.col("place") - 1).alias("place"), F.col("tree_index").alias("_t"),
                            F.col("parent_id").alias("_p"), F.col("node_id").alias("sibling"))
    same = (F.col("tree_index") == F.col("_t")) & F.col("parent_id").eqNullSafe(F.col("_p"))
    linked = siblings.join(right, "place", "left").select(
        "tree_index", "node_id", "parent_id", F.when(same, F.col("sibling")).alias("sibling"))
    first = shape.where(F.col("parent_id").isNotNull()).groupBy(
        "tree_index", F.col("parent_id").alias("node_id")
    ).agg(F.min(F.struct("visit", "node_id")).alias("_f")).select(
        "tree_index", "node_id", F.col("_f.node_id").alias("first_child"))
    nodes = linked.join(first, ["tree_index", "node_id"], "left")
    down, up = F.col("node_id") * 2, F.col("node_id") * 2 + 1
    tour = cut(nodes.select("tree_index", F.explode(F.array(
        F.struct(down.alias("at"),
                 F.coalesce(F.col("first_child") * 2, up).alias("next"),
                 F.col("first_child").isNull().cast("long").alias("todo")),
        F.struct(up.alias("at"),
                 F.coalesce(F.col("sibling") * 2, F.col("parent_id") * 2 + 1).alias("next"),
                 F.lit(0).cast("long").alias("todo")))).alias("e")).select("tree_index", "e.*"))
    while not tour.where(F.col("next").isNotNull()).isEmpty():
        ahead = tour.select("tree_index", F.col("at").alias("next"),
                            F.col("next").alias("_next"), F.col("todo").alias("_todo"))
        tour = cut(tour.join(ahead, ["tree_index", "next"], "left").select(
            "tree_index", "at", F.col("_next").alias("next"),
            (F.col("todo") + F.coalesce("_todo", F.lit(0))).alias("todo")))
    leaves = nodes.where(F.col("first_child").isNull()).select(
        "tree_index", "node_id", (F.col("node_id") * 2).alias("at"))
    totals = leaves.groupBy("tree_index").agg(F.count("*").alias("n_tips"))
    return (leaves.join(tour, ["tree_index", "at"]).join(totals, "tree_index")
            .select("tree_index", "node_id", (F.col("n_tips") - F.col("todo")).alias("rank"),
                    "n_tips"))


def _joined_x(shape: DataFrame, single_task_rows: int) -> DataFrame:
    """x of giant trees: ``x = wa * x(a) + wb * x(b) + c`` for each inner node.

    A round replaces every reference to a node that itself waits for at most
    one other node, which solves leaves and halves chains at the same time.
    """
    tips = cut(tip_ranks(shape, single_task_rows))
    totals = tips.groupBy("tree_index").agg(F.max("n_tips").alias("n_tips"))
    ends = shape.where(F.col("parent_id").isNotNull()).groupBy(
        "tree_index", F.col("parent_id").alias("node_id")).agg(
        F.min(F.struct("visit", "node_id")).alias("lo"),
        F.max(F.struct("visit", "node_id")).alias("hi"))
    a, b = F.col("lo.node_id"), F.col("hi.node_id")
    inner = ends.select(
        "tree_index", "node_id", a.alias("a"), F.when(a != b, b).alias("b"),
        F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.5)).alias("wa"),
        F.lit(0.5).alias("wb"), F.lit(0.0).alias("c"))
    state = written(inner.unionByName(tips.select(
        "tree_index", "node_id", F.lit(None).cast("long").alias("a"),
        F.lit(None).cast("long").alias("b"), F.lit(0.0).alias("wa"), F.lit(0.0).alias("wb"),
        F.col("rank").cast("double").alias("c"))), "contraction")
    before = state
    while not state.where(F.col("a").isNotNull()).isEmpty():
        ready = state.where(F.col("b").isNull())
        for side in ("a", "b"):
            other = ready.select(
                "tree_index", F.col("node_id").alias(side), F.lit(True).alias(f"_hit_{side}"),
                F.col("a").alias(f"_to_{side}"), F.col("wa").alias(f"_w_{side}"),
                F.col("c").alias(f"_c_{side}"))
            state = state.join(other, ["tree_index", side], "left")
        moved = {}
        for side in ("a", "b"):
            hit = F.col(f"_hit_{side}").isNotNull()
            weight = F.col(f"w{side}")
            moved[side] = F.when(hit, F.col(f"_to_{side}")).otherwise(F.col(side))
            moved[f"w{side}"] = F.when(hit, weight * F.col(f"_w_{side}")).otherwise(weight)
            moved[f"c{side}"] = F.when(hit, weight * F.col(f"_c_{side}")).otherwise(F.lit(0.0))
        step = state.select("tree_index", "node_id", moved["a"].alias("a"), moved["b"].alias("b"),
                            moved["wa"].alias("wa"), moved["wb"].alias("wb"),
                            (F.col("c") + moved["ca"] + moved["cb"]).alias("c"))
        # A lone reference is always kept in the first place.
        lone = F.col("a").isNull() & F.col("b").isNotNull()
        after = written(step.select(
            "tree_index", "node_id", F.when(lone, F.col("b")).otherwise(F.col("a")).alias("a"),
            F.when(~lone, F.col("b")).alias("b"),
            F.when(lone, F.col("wb")).otherwise(F.col("wa")).alias("wa"), "wb", "c"), "contraction")
        removed(before)
        before = state = after
    return state.join(totals, "tree_index").select(
        "tree_index", "node_id",
        (F.col("c") / F.greatest(F.lit(1), F.col("n_tips") - 1)).cast("float").alias("x"))


def layout(tn: DataFrame, time_range: DataFrame, scale: str | None = None,
           **options) -> DataFrame:
    """Tree nodes with ``x`` and ``y``; ``time_range`` is one row (t_min, t_max)."""
    y = C.time_to_y(F.col("time"), *C.bounds(time_range), scale)
    return layout_x(tn, **options).withColumn("y", y)


def with_parent(placed: DataFrame, columns=("x", "y"), how: str = "left") -> DataFrame:
    """Add ``parent_<column>`` of each node's parent in the same tree.

    Parents know how many children will look them up, so very large families
    are spread over several tasks.
    """
    ups = placed.where(F.col("n_children") > 0)
    table = ups.select("tree_index", F.col("node_id").alias("parent_id"),
                       *[F.col(c).alias(f"parent_{c}") for c in columns])
    counts = ups.select("tree_index", F.col("node_id").alias("parent_id"), "n_children")
    return spread_join(placed, table, ["tree_index", "parent_id"], counts, "n_children",
                       "node_id", how)


def elbows(placed: DataFrame, scale_x: float = 1.0, translate_x: float = 0.0) -> DataFrame:
    """Three-point path of each edge: parent, child x at parent height, child."""
    at = lambda c: F.col(c).cast("double") * F.lit(scale_x) + F.lit(translate_x)
    point = lambda px, py: F.struct(px.alias("x"), F.col(py).cast("double").alias("y"))
    return with_parent(placed, how="inner").select(
        "tree_index", F.col("parent_id").alias("parent"), F.col("node_id").alias("child"),
        F.array(point(at("parent_x"), "parent_y"), point(at("x"), "parent_y"),
                point(at("x"), "y")).alias("path"))
