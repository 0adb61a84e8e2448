"""Mutation lookups, placement in trees, and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from copse.functions import coordinates as C
from copse.operators.intervals import Locator, check_range, trees_at, with_bounds
from copse.operators.ordered import global_rank
from copse.operators.skew import few
from copse.session import written

LIST_CHUNK = 65_536


def label(ancestral: Column, derived: Column) -> Column:
    """``A->G``."""
    return F.concat(ancestral, F.lit("->"), derived)


def with_sites(mutations: DataFrame, sites: DataFrame) -> DataFrame:
    """Add ``position`` and ``ancestral_state`` of the mutation's own site."""
    return mutations.join(sites.select(F.col("id").alias("site_id"), "position",
                                       "ancestral_state"), "site_id")


def with_inherited_state(mutations: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """State before the mutation: its parent's derived state, else the ancestral one.

    ``parents`` is the table to find parents in, if ``mutations`` is a part of
    it. Most mutations have no parent; they stay out of the join, where they
    would all meet on the NULL key.
    """
    ups = (mutations if parents is None else parents).select(F.col("id").alias("parent_id"),
                           F.col("derived_state").alias("inherited_state"))
    first = mutations.where(F.col("parent_id").isNull()).withColumn(
        "inherited_state", F.col("ancestral_state"))
    later = mutations.where(F.col("parent_id").isNotNull()).join(
        ups, "parent_id", "left").withColumn(
        "inherited_state", F.coalesce("inherited_state", "ancestral_state"))
    return first.unionByName(later)


def with_tree(mutations: DataFrame, loc: Locator, bounds: bool = True) -> DataFrame:
    """Tree (and its interval) of each mutation by position."""
    located = trees_at(mutations, "position", loc)
    return with_bounds(located, loc) if bounds else located


def in_window(mutations: DataFrame, start: float, end: float,
              length: float | None = None) -> DataFrame:
    """Mutations with ``start <= position < end``."""
    if length is not None:
        check_range(start, end, length)
    return mutations.where((F.col("position") >= F.lit(float(start)))
                           & (F.col("position") < F.lit(float(end))))


def page(rows: DataFrame, order: list, offset: int = 0, limit: int = 1000) -> DataFrame:
    """One page in the given order."""
    return rows.orderBy(*order).offset(max(0, int(offset))).limit(max(1, int(limit)))


def page_summary(rows: DataFrame, offset: int = 0, limit: int = 1000) -> DataFrame:
    """One row ``(total_count, has_more)``."""
    return rows.agg(F.count("*").alias("total_count")).select(
        "total_count", (F.lit(max(0, offset) + max(1, limit)) < F.col("total_count"))
        .alias("has_more"))


def window_page(mutations: DataFrame, start: float, end: float, offset: int = 0,
                limit: int = 1000) -> DataFrame:
    """Page of a window in position order."""
    return page(in_window(mutations, start, end), ["position", "id"], offset, limit)


def search_bounds(position: float, range_bp: float, length: float) -> tuple[float, float]:
    """``position`` plus or minus half the range, inside the genome."""
    half = float(range_bp) // 2
    return max(0.0, float(position) - half), min(float(length), float(position) + half)


def near(mutations: DataFrame, position: float, range_bp: float, length: float) -> DataFrame:
    """Mutations around a position with their ``distance``."""
    start, end = search_bounds(position, range_bp, length)
    return in_window(mutations, start, end).withColumn(
        "distance", F.abs(F.col("position") - F.lit(float(position))))


def near_page(mutations: DataFrame, position: float, range_bp: float, length: float,
              offset: int = 0, limit: int = 1000) -> DataFrame:
    """Nearest first; ties by position and id. A top-k, so no full sort is shuffled."""
    return page(near(mutations, position, range_bp, length), ["distance", "position", "id"],
                offset, limit)


def on_node(mutations: DataFrame, node_id: int, bounds: DataFrame | None = None) -> DataFrame:
    """Mutations above one node, inside one interval if its row is given."""
    rows = mutations.where(F.col("node_id") == node_id)
    if bounds is None:
        return rows
    left, right = bounds.select("left").scalar(), bounds.select("right").scalar()
    return rows.where((F.col("position") >= left) & (F.col("position") < right))


def place(mutations: DataFrame, placed: DataFrame, time_range: DataFrame,
          scale: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """Mutations at the x of their node and the y of their time.

    ``mutations`` carry ``tree_index``; ``placed`` is a layout. With an unknown
    time, y is the mean of the node's y and its parent's (0 at a root). ``only``
    leaves the mutations of these nodes ``(tree_index, node_id)``.
    """
    t_min, t_max = C.bounds(time_range)
    times = placed.where(F.col("n_children") > 0).select(
        "tree_index", F.col("node_id").alias("_parent"), F.col("time").alias("_ptime"))
    nodes = placed.select("tree_index", "node_id", "x", F.col("time").alias("_ntime"),
                          F.col("parent_id").alias("_parent"))
    if only is not None:
        key = ["tree_index", "node_id"]
        nodes = few(written(nodes.join(few(only.select(*key)), key, "left_semi"), "shown-nodes"))
    at = mutations.join(nodes, ["tree_index", "node_id"]).join(
        few(times), ["tree_index", "_parent"], "left")
    node_y = C.time_to_y(F.col("_ntime"), t_min, t_max, scale)
    parent_y = F.coalesce(C.time_to_y(F.col("_ptime"), t_min, t_max, scale),
                          F.lit(0.0).cast("float"))
    unknown = F.col("time").isNull() | F.isnan("time")
    y = F.when(unknown, ((node_y + parent_y) / F.lit(2.0)).cast("float")).otherwise(
        C.time_to_y(F.col("time"), t_min, t_max, scale))
    return at.withColumn("y", y).withColumn("tree_parent_id", F.col("_parent")).drop(
        "_ntime", "_ptime", "_parent")


def numbered(mutations: DataFrame, **options) -> DataFrame:
    """Add ``row``: place of the mutation in (position, id) order, counted from 0."""
    return global_rank(mutations, "position", "id", out="row", **options)


def changed_by_node(mutations: DataFrame, chunk: int = LIST_CHUNK) -> DataFrame:
    """Mutations that change the site's state, listed per node.

    ``(node_id, chunk, mutations)`` with ``(position, label)`` entries such as
    ``A123G``. Needs ``row``: a list covers ``chunk`` consecutive rows, so a
    node carrying a third of all mutations becomes many bounded lists.
    """
    pos = F.col("position").cast("long")
    text = F.concat("ancestral_state", pos.cast("string"), F.col("derived_state"))
    kept = mutations.where(F.col("ancestral_state") != F.col("derived_state"))
    entry = F.struct(F.col("row"), pos.alias("position"), text.alias("label"))
    grouped = kept.groupBy("node_id", F.floor(F.col("row") / F.lit(chunk)).cast("long")
                           .alias("chunk")).agg(F.array_sort(F.collect_list(entry)).alias("_m"))
    return grouped.select("node_id", "chunk", F.transform(
        "_m", lambda m: F.struct(m["position"].alias("position"), m["label"].alias("label"))
    ).alias("mutations"))


def last_by_position(mutations: DataFrame) -> DataFrame:
    """Changing mutation per whole position; the last id wins."""
    pos = F.col("position").cast("long").alias("position")
    kept = mutations.where(F.col("ancestral_state") != F.col("derived_state"))
    last = kept.groupBy(pos).agg(F.max("id").alias("id"))
    return kept.select("id", "node_id", label(F.col("ancestral_state"), F.col("derived_state"))
                       .alias("mutation")).join(last, "id").select(
        "position", "mutation", F.col("node_id").alias("node"))
