"""Resolution-driven thinning of placed trees and mutations.

A grid cell keeps its lowest node (or mutation). ``min`` is combined before
the shuffle, so a cell, or a whole tree, holding a third of the rows is no
heavier than its number of partial results.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from copse.functions import coordinates as C
from copse.operators.layout import with_parent
from copse.operators.lineage import KEY, ancestor_closure
from copse.operators.skew import few
from copse.operators.trees import is_unary
from copse.session import cut


class Box(NamedTuple):
    """Focus area of one tree, in 0..1 coordinates."""

    tree_index: int
    min_x: float
    max_x: float
    min_y: float
    max_y: float

    def contains(self, tree: Column, x: Column, y: Column) -> Column:
        lo_x, hi_x = sorted(min(1.0, max(0.0, v)) for v in (self.min_x, self.max_x))
        lo_y, hi_y = sorted(min(1.0, max(0.0, v)) for v in (self.min_y, self.max_y))
        return ((tree == self.tree_index) & (x >= F.lit(lo_x)) & (x <= F.lit(hi_x))
                & (y >= F.lit(lo_y)) & (y <= F.lit(hi_y)))


def grid(placed: DataFrame, cell: float | None, multiplier, box: Box | None,
          outside_cell: float | None) -> DataFrame:
    """Per tree: outside and inside resolution, and whether all tips sit at x = 1."""
    stats = placed.groupBy("tree_index").agg(
        F.count("*").alias("_n"), F.min(F.when(F.col("is_tip"), F.col("x"))).alias("_tip"))
    n = F.col("_n")
    plain = C.cell_size(n, cell, None if box else multiplier)
    outside = inside = plain
    if box:
        focused = F.col("tree_index") == box.tree_index
        focus_out = C.cell_size(n, outside_cell)
        outside = F.when(focused, focus_out).otherwise(plain)
        inside = F.when(focused, C.inside_cell_size(n, focus_out, multiplier)).otherwise(plain)
    return stats.select("tree_index", C.resolution(outside).alias("_res_out"),
                        C.resolution(inside).alias("_res_in"),
                        F.coalesce(F.col("_tip") > 0.999999, F.lit(False)).alias("_flat"))


def keeps_all_inside(box: Box | None, multiplier) -> bool:
    return box is not None and abs(
        C.usable_multiplier(multiplier) - C.KEEP_ALL_INSIDE_MULTIPLIER) <= 1e-12


def edge_cells(placed: DataFrame, cell: float | None = None, multiplier=None,
               box: Box | None = None, outside_cell: float | None = None) -> DataFrame:
    """Non-root nodes with the grid key of the midpoint of the edge above them:
    ``(tree_index, node_id, inside, cx, cy, direction)``.

    Direction counts only in trees whose tips all sit at x = 1, else it is -1.
    """
    cells = few(cut(grid(placed, cell, multiplier, box, outside_cell)))
    edges = with_parent(placed, how="inner").join(cells, "tree_index")
    mx, my = C.midpoint(F.col("x"), F.col("parent_x")), C.midpoint(F.col("y"), F.col("parent_y"))
    inside = box.contains(F.col("tree_index"), mx, my) if box else F.lit(False)
    keyed = edges.withColumn("inside", inside)
    res = F.when(F.col("inside"), F.col("_res_in")).otherwise(F.col("_res_out"))
    bins = C.direction_bin(F.col("x"), F.col("y"), F.col("parent_x"), F.col("parent_y"))
    return keyed.select(*KEY, "inside", C.grid_cell(mx, res).alias("cx"),
                        C.grid_cell(my, res).alias("cy"),
                        F.when(F.col("_flat"), bins).otherwise(F.lit(-1)).alias("direction"))


def cell_winners(cells: DataFrame, keep_inside: bool = False) -> DataFrame:
    """Lowest node of each cell; with ``keep_inside`` all nodes of the box."""
    open_ = cells.where(~F.col("inside")) if keep_inside else cells
    best = open_.groupBy("tree_index", "inside", "cx", "cy", "direction").agg(
        F.min("node_id").alias("node_id")).select(*KEY)
    return best.unionByName(cells.where("inside").select(*KEY)) if keep_inside else best


def unary_and_child(placed: DataFrame) -> DataFrame:
    """Unary nodes and their only children; both survive the collapse."""
    unary = placed.where(is_unary()).select(*KEY)
    child = placed.join(few(unary.select("tree_index", F.col("node_id").alias("parent_id"))),
                        ["tree_index", "parent_id"], "left_semi").select(*KEY)
    return unary.unionByName(child).distinct()


def kept_nodes(placed: DataFrame, keep_tips: bool = False, **grid) -> DataFrame:
    """Rows surviving the grid, with a ``preserve`` flag.

    Roots always stay, and the set is closed under ancestors. ``placed`` is read
    many times: pass a written layout.
    """
    keep_inside = keeps_all_inside(grid.get("box"), grid.get("multiplier"))
    winners = cell_winners(edge_cells(placed, **grid), keep_inside)
    always = F.col("parent_id").isNull()
    if keep_tips:
        always = always | F.col("is_tip")
    forced = cut(unary_and_child(placed).withColumn("preserve", F.lit(True)))
    seeds = placed.where(always).select(*KEY).unionByName(winners).unionByName(
        forced.select(*KEY))
    kept = cut(ancestor_closure(placed, seeds))
    return placed.join(few(kept), KEY, "left_semi").join(few(forced), KEY, "left").withColumn(
        "preserve", F.coalesce("preserve", F.lit(False)))


def collapse(kept: DataFrame) -> DataFrame:
    """Drop nodes left with one child (not roots, not preserved) and re-parent.

    Parents that vanish are skipped by pointer doubling along the chains.
    """
    left = kept.where(F.col("parent_id").isNotNull()).groupBy(
        "tree_index", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("_kids"))
    gone = ((F.coalesce("_kids", F.lit(0)) == 1) & F.col("parent_id").isNotNull()
            & ~F.col("preserve"))
    state = cut(kept.join(left, KEY, "left").withColumn("_gone", gone).drop("_kids"))
    target = state.where("_gone").select("tree_index", F.col("node_id").alias("parent_id"),
                                         F.col("parent_id").alias("_up"))
    pending = not target.isEmpty()
    while pending:
        onward = target.select("tree_index", F.col("parent_id").alias("_up"),
                               F.col("_up").alias("_up2"))
        stepped = cut(target.join(onward, ["tree_index", "_up"], "left"))
        pending = not stepped.where(F.col("_up2").isNotNull()).isEmpty()
        target = stepped.select("tree_index", "parent_id",
                                F.coalesce("_up2", "_up").alias("_up"))
    alive = state.where(~F.col("_gone")).join(
        target, ["tree_index", "parent_id"], "left").withColumn(
        "parent_id", F.coalesce("_up", "parent_id")).drop("_gone", "_up")
    return alive.drop("preserve")


def thin_nodes(placed: DataFrame, cell: float | None = None, multiplier=None,
               box: Box | None = None, outside_cell: float | None = None,
               keep_tips: bool = False) -> DataFrame:
    """Grid, closure and collapse in one call."""
    return collapse(kept_nodes(placed, keep_tips, cell=cell, multiplier=multiplier, box=box,
                               outside_cell=outside_cell))


def on_kept_nodes(mutations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mutations whose node is still there."""
    return mutations.join(nodes.select(*KEY), KEY, "left_semi")


def thin_mutations(mutations: DataFrame, resolution: int | DataFrame, inside_resolution: int | None = None,
                   box: Box | None = None, keep_inside: bool = False) -> DataFrame:
    """One mutation per tree and cell, the lowest id; the box has its own grid.

    ``resolution`` is one number, or the :func:`grid` of the trees' layout, so
    that nodes and mutations of a tree share their cells.
    """
    x, y = F.col("x"), F.col("y")
    inside = box.contains(F.col("tree_index"), x, y) if box else F.lit(False)
    if isinstance(resolution, DataFrame):
        cells = few(cut(resolution.select("tree_index", "_res_out", "_res_in")))
        keyed = mutations.join(cells, "tree_index")
    else:
        keyed = mutations.withColumns({"_res_out": F.lit(resolution),
                                       "_res_in": F.lit(inside_resolution or resolution)})
    res = F.when(F.col("_in"), F.col("_res_in")).otherwise(F.col("_res_out")).cast("long")
    keyed = keyed.withColumn("_in", inside)
    winners = keyed.where(~F.col("_in")) if keep_inside else keyed
    best = winners.groupBy("tree_index", "_in", C.grid_cell(x, res).alias("_cx"),
                           C.grid_cell(y, res).alias("_cy")).agg(
        F.min("mutation_id").alias("mutation_id")).select("tree_index", "mutation_id")
    out = mutations.join(best, ["tree_index", "mutation_id"], "left_semi")
    if not keep_inside:
        return out
    return out.unionByName(keyed.where("_in").drop("_in", "_res_out", "_res_in"))
