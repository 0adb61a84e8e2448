"""Tree construction from edge spans.

An edge is active for a run of consecutive trees, so a tree collection is kept
as *spans* (one row per edge or node and run) for as long as possible. Spans
are exploded to one row per tree only where a result asks for it.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from copse.operators.intervals import Locator, Reach, locate
from copse.operators.ordered import fold_changes, segments
from copse.operators.skew import few

EXPLODE_CHUNK = 65_536
#: Trees that a request may name inside the plan; more of them are joined.
LISTED_TREES = 64
REQUEST_CHUNK = 256
#: Sums of times along the genome: exact, whatever their order.
EXACT = "decimal(38,12)"
LIST_CHUNK = 65_536
#: What a plan reads: one stretch, several disjoint ones in order, or (None) all.
Stretches = Reach | list[Reach] | None


def any_of(tests: Iterable[Column]) -> Column:
    """One of the tests holds; none of no tests does."""
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def edge_spans(edges: DataFrame, loc: Locator, within: Stretches = None) -> DataFrame:
    """Edges as runs of trees ``(child, parent, first_tree, last_tree)``.

    Edge ends are breakpoints, so both lookups are projections of the scan.
    With ``within`` (one stretch or several disjoint ones) only edges that reach
    into a stretch are read, and there is a run for each, that ends at its borders.
    """
    parts = _parts(within)
    if parts is not None:
        edges = edges.where(any_of((F.col("left") < F.lit(s.right)) & (F.col("right") > F.lit(s.left)) for s in parts))
    placed = locate(locate(edges, "left", loc, "first_tree"), "right", loc, "last_tree")
    spans = placed.select("child", "parent", "first_tree", "last_tree")
    if parts is None:
        return spans
    clipped = [F.struct(F.greatest("first_tree", F.lit(s.first).cast("long")).alias("first_tree"),
                        F.least("last_tree", F.lit(s.last).cast("long")).alias("last_tree")) for s in parts]
    if len(parts) > 1:
        spans = spans.select("child", "parent", F.explode(F.array(*clipped)).alias("_run"))
    else:
        spans = spans.select("child", "parent", clipped[0].alias("_run") if clipped else F.struct("first_tree", "last_tree").alias("_run"))
    return spans.select("child", "parent", "_run.*").where(F.col("first_tree") < F.col("last_tree"))


def _parts(within: Stretches) -> list[Reach] | None:
    """Stretches as a list; None for the whole genome."""
    return [within] if isinstance(within, Reach) else within


def with_times(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``child_time`` and ``parent_time``, once per edge rather than per tree."""
    out = spans
    for end in ("child", "parent"):
        out = out.join(nodes.select(F.col("id").alias(end), F.col("time").alias(f"{end}_time")),
                       end)
    return out


def explode_spans(spans: DataFrame, trees: list[int] | DataFrame | None = None) -> DataFrame:
    """One row per span and tree of ``[first_tree, last_tree)``.

    ``trees`` restricts the result before the explode: a short list (of up to
    ``LISTED_TREES``) is intersected with each run, a long one or a DataFrame
    (column ``tree_index``) meets the runs in chunks of trees, and only what
    was asked for is exploded. Without it runs are cut into chunks, so that no
    array grows with the genome.
    """
    keep = [c for c in spans.columns if c not in ("first_tree", "last_tree")]
    first, last = F.col("first_tree"), F.col("last_tree")
    if isinstance(trees, (list, tuple, range)):
        asked = sorted({int(t) for t in trees})
        if len(asked) <= LISTED_TREES:
            wanted = F.array(*[F.lit(t).cast("long") for t in asked]).cast("array<bigint>")
            hits = F.filter(wanted, lambda t: (t >= first) & (t < last))
            return spans.select(F.explode(hits).alias("tree_index"), *keep)
        trees = spans.sparkSession.createDataFrame([(t,) for t in asked], "tree_index long")
    if trees is not None:
        return _asked_trees(spans, trees, keep)
    size = F.lit(EXPLODE_CHUNK)
    chunked = spans.where(first < last).select(
        *keep, first, last,
        F.explode(F.sequence(F.floor(first / size), F.floor((last - 1) / size))).alias("_c"))
    return chunked.select(
        F.explode(F.sequence(F.greatest(first, F.col("_c") * size),
                             F.least(last, (F.col("_c") + 1) * size) - 1)).alias("tree_index"),
        *keep)


def _asked_trees(spans: DataFrame, trees: DataFrame, keep: list[str]) -> DataFrame:
    """Runs against a table of trees: both by chunks of ``REQUEST_CHUNK`` trees.

    A chunk of the request is an array of at most that many trees; a run meets
    the chunks it spans, which callers have clipped to the request's reach.
    """
    first, last, size = F.col("first_tree"), F.col("last_tree"), F.lit(REQUEST_CHUNK)
    asked = trees.groupBy(F.floor(F.col("tree_index") / size).cast("long").alias("_c")).agg(
        F.collect_set("tree_index").alias("_asked"))
    chunked = spans.where(first < last).select(
        *keep, first, last, F.explode(F.sequence(F.floor(first / size), F.floor((last - 1) / size))).alias("_c"))
    return chunked.join(asked, "_c").select(
        F.explode(F.filter("_asked", lambda t: (t >= first) & (t < last))).alias("tree_index"), *keep)


def tree_edges(spans: DataFrame, trees=None) -> DataFrame:
    """``(tree_index, child, parent)`` and whatever else the spans carry."""
    return explode_spans(spans, trees)


def node_spans(spans: DataFrame, nodes: DataFrame, n_trees: int,
               isolated: bool = True, within: Stretches = None) -> DataFrame:
    """State of every node as runs of trees: ``(node_id, first_tree, last_tree,
    n_parents, n_children, parent_id, time, flags)``.

    A sweep over edge ends: each adds to or takes from the counts of its two
    nodes, and to the child's parent id, which therefore is the running total.
    Ends are combined before the shuffle, so a parent of a third of all edges
    arrives as one row per breakpoint. ``isolated`` keeps sample nodes also
    where they touch no edge. ``within`` is what ``spans`` were clipped to, if they
    were; there are no runs in the gaps between its stretches.

    A node has one parent at a time; where edges give it two, the query fails.
    """
    zero = F.lit(0).cast("long")
    parts = _parts(within)
    border = sorted({0, n_trees} if parts is None else {b for s in parts for b in (s.first, s.last)})
    first, last = F.col("first_tree"), F.col("last_tree")

    def change(node, tree, up, down, parent):
        return F.struct(node.alias("node_id"), tree.alias("tree_index"), up.alias("up"),
                        down.alias("down"), parent.alias("above"))

    one = F.lit(1).cast("long")
    child, parent = F.col("child"), F.col("parent")
    ends = spans.select(F.explode(F.array(
        change(child, first, one, zero, parent), change(child, last, -one, zero, -parent),
        change(parent, first, zero, one, zero), change(parent, last, zero, -one, zero)
    )).alias("_e")).select("_e.*", F.lit(False).alias("border"))
    if isolated:
        borders = nodes.where(F.col("flags").bitwiseAND(1) == 1).select(
            F.col("id").alias("node_id"),
            F.explode(F.array(*[F.lit(b) for b in border]).cast("array<long>")).alias("tree_index"),
            zero.alias("up"), zero.alias("down"), zero.alias("above"), F.lit(True).alias("border"))
        ends = ends.unionByName(borders)
    deltas = ends.groupBy("node_id", "tree_index").agg(
        F.sum("up").alias("up"), F.sum("down").alias("down"), F.sum("above").alias("above"),
        F.bool_or("border").alias("border")).where(
        (F.col("up") != 0) | (F.col("down") != 0) | (F.col("above") != 0) | F.col("border"))
    runs = segments(deltas, ["node_id"], "tree_index", ["up", "down", "above"], n_trees + 1)
    state = runs.where(F.col("next_tree_index").isNotNull()).select(
        "node_id", F.col("tree_index").alias("first_tree"),
        F.col("next_tree_index").alias("last_tree"),
        F.col("cum_up").alias("n_parents"), F.col("cum_down").alias("n_children"),
        F.when(F.col("cum_up") > 1, F.raise_error(F.concat(
            F.lit("two parents at once: node "), F.col("node_id").cast("string"), F.lit(" in tree "),
            F.col("tree_index").cast("string"))).cast("long"))
        .when(F.col("cum_up") > 0, F.col("cum_above")).alias("parent_id"))
    member = (F.col("n_parents") + F.col("n_children")) > 0
    if not isolated:
        state = state.where(member)
    elif parts is not None and len(parts) > 1:           # gaps end where a stretch begins
        first = F.col("first_tree")
        state = state.where(any_of((first >= s.first) & (first < s.last) for s in parts))
    # A few nodes may have very many runs each: by node they would meet in a few tasks.
    state = state.join(few(nodes.select(F.col("id").alias("node_id"), "time", "flags")), "node_id")
    if isolated:
        state = state.where(member | (F.col("flags").bitwiseAND(1) == 1))
    return state


def membership_ranges(node_runs: DataFrame, n_trees: int) -> DataFrame:
    """Maximal runs ``[first_tree, last_tree)`` in which a node is present."""
    changes = fold_changes(node_runs, ["node_id"], "first_tree", "last_tree",
                           {"delta": F.lit(1)})
    runs = segments(changes, ["node_id"], "tree_index", ["delta"], n_trees + 1)
    return runs.where(F.col("delta") > 0).select(
        "node_id", F.col("tree_index").alias("first_tree"),
        F.col("next_tree_index").alias("last_tree"))


def tree_nodes(node_runs: DataFrame, trees=None) -> DataFrame:
    """Long form of the trees:
    ``(tree_index, node_id, parent_id, time, flags, n_children, is_tip)``."""
    return explode_spans(node_runs.drop("n_parents"), trees).select(
        "tree_index", "node_id", "parent_id", "time", "flags", "n_children",
        (F.col("n_children") == 0).alias("is_tip"))


def child_lists(edges: DataFrame, chunk: int = LIST_CHUNK) -> DataFrame:
    """Children of each parent in id order.

    ``(tree_index, parent, chunk, children)``: a chunk covers ``chunk``
    consecutive ids, so lists are bounded and (parent, chunk) is the group.
    """
    return edges.groupBy(
        "tree_index", "parent", F.floor(F.col("child") / F.lit(chunk)).cast("long").alias("chunk")
    ).agg(F.sort_array(F.collect_list("child")).alias("children"))


def roots(tn: DataFrame) -> DataFrame:
    """Rows without a parent."""
    return tn.where(F.col("parent_id").isNull())


def root_counts(tn: DataFrame) -> DataFrame:
    """Number of roots per tree."""
    return roots(tn).groupBy("tree_index").agg(F.count("*").alias("n_roots"))


def is_unary() -> Column:
    """One child and a parent."""
    return (F.col("n_children") == 1) & F.col("parent_id").isNotNull()


def tree_statistics(node_runs: DataFrame, loc: Locator) -> DataFrame:
    """Oldest root, total branch length and number of roots of every tree.

    Read from node runs alone: summed over edges, parent minus child times is
    each node's time once per child less once for its own parent. Sums are
    taken per first and last tree of a run and accumulated along the genome.
    Sums are decimals, so a tree does not inherit the rounding of others. Roots
    are reduced to their oldest per run before runs become trees.
    """
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    ends = fold_changes(node_runs, [], "first_tree", "last_tree", {
        "length": (F.col("time") * (F.col("n_children") - F.col("n_parents"))).cast(EXACT),
        "edges": F.col("n_parents"), "roots": (F.col("n_parents") == 0).cast("long")})
    every = loc.intervals.select("tree_index", none.cast(EXACT).alias("length"), zero.alias("edges"),
                                 zero.alias("roots"))
    dense = ends.unionByName(every).groupBy("tree_index").agg(
        F.sum("length").alias("length"), F.sum("edges").alias("edges"),
        F.sum("roots").alias("roots"))
    totals = segments(dense, [], "tree_index", ["length", "edges", "roots"], loc.n_trees + 1)
    length = F.when(F.col("cum_edges") > 0, F.col("cum_length").cast("double")).otherwise(none)
    tops = explode_spans(node_runs.where(F.col("n_parents") == 0)
                         .groupBy("first_tree", "last_tree").agg(F.max("time").alias("time")))
    oldest = tops.groupBy("tree_index").agg(F.max("time").alias("root_time"))
    return (loc.intervals
            .join(totals.select("tree_index", length.alias("total_branch_length"),
                                F.col("cum_roots").alias("n_roots")), "tree_index")
            .join(oldest, "tree_index", "left")
            .select("tree_index", "left", "right", F.coalesce("root_time", none).alias("root_time"),
                    "total_branch_length", "n_roots"))


def check_trees(requested: list[int], n_trees: int | None, on_missing: str = "skip") -> None:
    """Refuse indexes out of range, if asked to."""
    if on_missing == "error" and n_trees is not None:
        bad = [t for t in requested if not 0 <= t < n_trees]
        if bad:
            raise IndexError(f"trees out of range: {bad}")


def pick_trees(tn: DataFrame, requested: list[int], n_trees: int | None = None,
               on_missing: str = "skip") -> DataFrame:
    """Rows of the requested trees in request order; repeats are kept.

    ``request_pos`` is the place in the request. Out-of-range indexes are
    skipped, or refused with ``on_missing='error'`` and a known ``n_trees``.
    """
    check_trees(requested, n_trees, on_missing)
    spark = tn.sparkSession
    request = spark.createDataFrame([(i, int(t)) for i, t in enumerate(requested)],
                                    "request_pos int, tree_index long")
    return request.join(tn, "tree_index")


def run_counts(node_runs: DataFrame, loc: Locator, within: Stretches = None) -> DataFrame:
    """``(tree_index, n_nodes, n_roots)`` from node runs, without exploding them."""
    parts = _parts(within)
    index = F.col("tree_index")
    here = F.lit(True) if parts is None else any_of((index >= s.first) & (index < s.last) for s in parts)
    root = (F.col("n_parents") == 0).cast("long")
    ends = fold_changes(node_runs, [], "first_tree", "last_tree",
                        {"nodes": F.lit(1).cast("long"), "roots": root})
    zero = F.lit(0).cast("long")
    every = loc.intervals.where(here).select(
        "tree_index", zero.alias("nodes"), zero.alias("roots"))
    dense = ends.unionByName(every).groupBy("tree_index").agg(
        F.sum("nodes").alias("nodes"), F.sum("roots").alias("roots"))
    totals = segments(dense, [], "tree_index", ["nodes", "roots"], loc.n_trees + 1)
    return totals.where(here & (index < loc.n_trees)).select(
        "tree_index", F.col("cum_nodes").alias("n_nodes"), F.col("cum_roots").alias("n_roots"))


def per_tree_counts(tn: DataFrame, mutations: DataFrame | None = None) -> DataFrame:
    """Node (and mutation) counts per tree."""
    counts = tn.groupBy("tree_index").agg(F.count("*").alias("n_nodes"))
    if mutations is None:
        return counts
    muts = mutations.groupBy("tree_index").agg(F.count("*").alias("n_mutations"))
    return counts.join(muts, "tree_index", "left").select(
        "tree_index", "n_nodes", F.coalesce("n_mutations", F.lit(0)).alias("n_mutations"))
