"""The requests a viewer makes, each as a DataFrame plan over a collection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from copse.functions import coordinates as C
from copse.operators import (compare as CMP, intervals as I, layout as LAY, lineage as LIN,
                             metadata as MET, mutations as MUT, thinning as THN, trees as T)
from copse.plans.collection import Collection
from copse.session import written
from copse.sources import mutation_store as STORE, sinks, summary


class Layout(NamedTuple):
    """Node and mutation tables of a layout request."""

    nodes: DataFrame
    mutations: DataFrame


def describe(c: Collection) -> DataFrame:
    """Summary row of an opened collection."""
    return summary.summary(c.nodes, c.edges, c.sites, c.mutations, c.individuals, c.populations,
                           c.intervals, c.length)


def placed_nodes(c: Collection, trees=None, scale: str | None = None,
                 isolated: bool = True) -> DataFrame:
    """Tree nodes with coordinates, written once.

    The compact node runs, of the requested stretches only, are written first:
    tree sizes come from them, and the exploded trees pass through once, into
    the layout.
    """
    within = c.stretches(trees)
    runs = written(c.runs(isolated, within), "node-runs")
    giants = LAY.giant_trees(T.run_counts(runs, c.loc, within))
    return written(LAY.layout(T.tree_nodes(runs, trees), c.time_range(), scale, giants=giants),
                   "layout")


def located_mutations(c: Collection, bounds: bool = False, within: list[I.Reach] | None = None) -> DataFrame:
    """Mutations with site, inherited state and tree.

    Sites outside ``within`` are dropped at their scan, before any join.
    """
    at = F.col("position")
    sites = c.sites if within is None else c.sites.where(
        T.any_of((at >= F.lit(s.left)) & (at < F.lit(s.right)) for s in within))
    rows = MUT.with_inherited_state(MUT.with_sites(c.mutations, sites), c.mutations)
    return MUT.with_tree(rows, c.loc, bounds)


def requested_trees(c: Collection, requested: list[int], isolated: bool = True,
                    on_missing: str = "skip") -> DataFrame:
    """Node rows of the requested trees in request order, repeats included, from the stretches that hold them."""
    T.check_trees(requested, c.loc.n_trees, on_missing)
    return T.pick_trees(c.tree_nodes(sorted(set(requested)), isolated), requested)


def layout_request(c: Collection, trees=None, scale: str | None = None, thin: bool = True,
                   multiplier=None, box: THN.Box | None = None, cell: float | None = None,
                   outside_cell: float | None = None) -> Layout:
    """Layout of the requested trees, thinned to the grid, with their mutations.

    Nodes and mutations share the cell sizes of their tree: ``cell`` if given,
    else by the size of the tree and ``multiplier``; ``box`` focuses one tree,
    whose outside keeps ``outside_cell``.
    """
    placed = placed_nodes(c, trees, scale, isolated=False)
    muts = located_mutations(c, within=c.stretches(trees)).withColumnRenamed("id", "mutation_id")
    if isinstance(trees, (list, tuple, range)):
        muts = muts.where(F.col("tree_index").isin([int(t) for t in trees]))
    elif trees is not None:
        muts = muts.join(trees.select("tree_index"), "tree_index", "left_semi")
    if not thin:
        return Layout(placed, MUT.place(muts, placed, c.time_range(), scale))
    grid = {"cell": cell, "multiplier": multiplier, "box": box, "outside_cell": outside_cell}
    nodes = written(THN.thin_nodes(placed, **grid), "thin-nodes")
    shown = written(MUT.place(muts, placed, c.time_range(), scale, only=nodes), "shown-mutations")
    kept = THN.thin_mutations(shown, THN.grid(placed, **grid), box=box,
                              keep_inside=THN.keeps_all_inside(box, multiplier))
    return Layout(nodes, kept)


def layout_tables(layout: Layout) -> Layout:
    """The same with the fixed boundary schemas."""
    return Layout(sinks.layout_nodes(layout.nodes), sinks.layout_mutations(layout.mutations))


def mutation_window(c: Collection, start: float, end: float, offset: int = 0,
                    limit: int = 1000) -> DataFrame:
    """Page of the mutations in a window with tree and interval.

    Trees are looked up for the page only.
    """
    I.check_range(start, end, c.length)
    page = MUT.window_page(MUT.with_sites(c.mutations, c.sites), start, end, offset, limit)
    return sinks.mutation_result(MUT.with_tree(page, c.loc))


def mutations_near(c: Collection, position: float, range_bp: float = 5000, offset: int = 0,
                   limit: int = 1000) -> DataFrame:
    """Nearest mutations to a position."""
    page = MUT.near_page(MUT.with_sites(c.mutations, c.sites), position, range_bp, c.length,
                         offset, limit)
    return sinks.mutation_result(MUT.with_tree(page, c.loc))


def stored_mutations(c: Collection, path: str, block_rows: int = STORE.BLOCK_ROWS) -> STORE.Store:
    """Write the mutations of a collection by position and open them, for pages that read few blocks."""
    STORE.write_store(MUT.with_sites(c.mutations, c.sites), path, block_rows)
    return STORE.open_store(c.spark, path)


def stored_window(c: Collection, store: STORE.Store, start: float, end: float, offset: int = 0, limit: int = 1000,
                  after: tuple[float, int] | None = None) -> DataFrame:
    """The page of :func:`mutation_window` from stored blocks; ``after`` continues behind the last key of a page."""
    I.check_range(start, end, c.length)
    return sinks.mutation_result(MUT.with_tree(STORE.window_page(store, start, end, offset, limit, after), c.loc))


def stored_near(c: Collection, store: STORE.Store, position: float, range_bp: float = 5000, offset: int = 0,
                limit: int = 1000) -> DataFrame:
    """The page of :func:`mutations_near` from stored blocks."""
    page = STORE.near_page(store, position, range_bp, c.length, offset, limit)
    return sinks.mutation_result(MUT.with_tree(page, c.loc))


def samples(c: Collection) -> DataFrame:
    """Samples with decoded metadata."""
    return MET.samples_with_metadata(c.nodes, c.individuals, c.populations)


def highlight(c: Collection, key: str, value, trees=None, scale: str | None = None) -> DataFrame:
    """Positions of the samples with one metadata value, in the trees they are in."""
    hits = MET.search_samples(samples(c), key, value)
    return MET.positions_of(hits, placed_nodes(c, trees, scale)).select(
        "tree_index", "node_id", "x", "y")


def highlight_values(c: Collection, key: str, values: DataFrame, trees=None,
                     scale: str | None = None) -> DataFrame:
    """Positions by value for several values; a value without hits stays as one row."""
    hits = MET.multi_value_hits(MET.sample_values(samples(c), key), values)
    placed = placed_nodes(c, trees, scale).select("tree_index", "node_id", "x", "y")
    found = hits.join(placed, "node_id")
    asked = values.select(F.col("value").cast("string").alias("value")).distinct()
    return asked.join(found, "value", "left").select("value", "tree_index", "node_id", "x", "y")


def count_values(c: Collection, key: str, values: DataFrame) -> DataFrame:
    """Samples per requested value, a value nobody has counting 0, and the ``total`` over all values.

    A sample has one value of a key, so the total counts it once.
    """
    hits = MET.multi_value_hits(MET.sample_values(samples(c), key), values)
    counts = hits.groupBy("value").agg(F.count("node_id").alias("n_samples"))
    total = hits.agg(F.count("node_id")).first()[0]
    return counts.withColumn("total", F.lit(total).cast("long"))


def value_lineages(c: Collection, key: str, values: DataFrame, trees=None) -> DataFrame:
    """Root-to-sample path rows of the samples with requested values: ``(tree_index, seed, step, node_id, value)``."""
    tn = c.written_nodes(trees, isolated=False)
    hits = MET.multi_value_hits(MET.sample_values(samples(c), key), values).where(F.col("node_id").isNotNull())
    return LIN.lineage_steps(tn, hits.join(tn.select("tree_index", "node_id"), "node_id"))


def search_names(c: Collection, names: DataFrame, trees=None) -> DataFrame:
    """Named samples per tree they are members of."""
    found = MET.find_names(MET.name_index(samples(c)), names)
    return found.join(c.tree_nodes(trees, isolated=False).select("tree_index", "node_id"),
                      "node_id")


def name_lineages(c: Collection, names: DataFrame, trees=None) -> DataFrame:
    """Root-to-sample path rows of the named samples."""
    tn = c.written_nodes(trees, isolated=False)
    found = MET.find_names(MET.name_index(samples(c)), names)
    seeds = found.join(tn.select("tree_index", "node_id").hint("merge"), "node_id")   # its files look small enough to broadcast
    return LIN.lineage_steps(tn, seeds)


def compare_trees(c: Collection, requested: list[int] | DataFrame, scale: str | None = None) -> DataFrame:
    """Edge changes between pairs of trees with coordinates.

    Pairs are neighbours in a list, or rows ``(pair, prev_tree, next_tree)``.
    """
    pairs = requested if isinstance(requested, DataFrame) else CMP.request_pairs(c.nodes, requested, c.loc.n_trees)
    changes = CMP.pair_differences(c.spans, pairs, c.loc.n_trees)
    trees = pairs.select(F.explode(F.array("prev_tree", "next_tree")).alias("tree_index")).distinct()
    return CMP.with_coordinates(changes, placed_nodes(c, trees, scale, isolated=False))
