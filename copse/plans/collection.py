"""A tree collection: its tables plus the spans every request starts from."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from copse.operators import intervals as I, trees as T
from copse.session import written


class Collection(NamedTuple):
    """Plain record of DataFrames; nothing here runs or caches by itself."""

    nodes: DataFrame
    edges: DataFrame
    sites: DataFrame
    mutations: DataFrame
    individuals: DataFrame
    populations: DataFrame
    loc: I.Locator
    length: float

    @property
    def spark(self):
        return self.nodes.sparkSession

    @property
    def intervals(self) -> DataFrame:
        return self.loc.intervals

    @property
    def spans(self) -> DataFrame:
        return T.edge_spans(self.edges, self.loc)

    def reach(self, trees) -> I.Reach | None:
        """The stretch of genome that a request for ``trees`` touches; None for all of it."""
        return None if trees is None else I.reach(trees, self.loc)

    def stretches(self, trees) -> list[I.Reach] | None:
        """The few stretches of genome that hold ``trees``; None for all of it."""
        return None if trees is None else I.stretches(trees, self.loc)

    def runs(self, isolated: bool = True, within: T.Stretches = None) -> DataFrame:
        """Node runs; with ``isolated`` samples count as members of every tree.

        ``within`` keeps all of it, from the scan of edges on, to some stretches.
        """
        spans = T.edge_spans(self.edges, self.loc, within)
        return T.node_spans(spans, self.nodes, self.loc.n_trees, isolated, within)

    def tree_edges(self, trees=None) -> DataFrame:
        return T.tree_edges(T.edge_spans(self.edges, self.loc, self.stretches(trees)), trees)

    def tree_nodes(self, trees=None, isolated: bool = True) -> DataFrame:
        return T.tree_nodes(self.runs(isolated, self.stretches(trees)), trees)

    def written_nodes(self, trees=None, isolated: bool = True) -> DataFrame:
        """Tree nodes written once, for plans that read them several times."""
        return written(self.tree_nodes(trees, isolated), "tree-nodes")

    def time_range(self) -> DataFrame:
        """One row ``(t_min, t_max)`` over all nodes."""
        return self.nodes.agg(F.min("time").alias("t_min"), F.max("time").alias("t_max"))

    def samples(self) -> DataFrame:
        return self.nodes.where(F.col("flags").bitwiseAND(1) == 1)


def open_collection(nodes, edges, sites, mutations, individuals, populations,
                    length: float | None = None, intervals: DataFrame | None = None) -> Collection:
    """Build the interval table and its lookup index; both are small per tree."""
    if intervals is None:
        intervals = I.intervals_from_breakpoints(I.breakpoints(edges))
    loc = I.locator(intervals)
    return Collection(nodes, edges, sites, mutations, individuals, populations, loc,
                      float(length) if length is not None else loc.end)
