"""Ancestors by pointer doubling, descendants by nested numbers.

What lies below a node, how much, and what several nodes share above them is
read from numbers (:mod:`copse.operators.nesting`), whatever the depth.
``jumps`` yields, for k = 0, 1, 2, ..., the ancestor 2^k steps up. A set of
nodes follows all of them once, so log2(depth) joins reach every ancestor.
Only inner nodes are doubled: whatever the seeds, the first step is their own
parent, and from there on every node met has children. Functions that take
``tn`` read it more than once; pass a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from copse.operators.nesting import below, nested
from copse.operators.skew import few, is_few, spread_join
from copse.session import cut, written

KEY = ["tree_index", "node_id"]


def inner_links(tn: DataFrame) -> DataFrame:
    """Inner nodes and their parents ``(tree_index, node_id, up)``."""
    return tn.where((F.col("n_children") > 0) & F.col("parent_id").isNotNull()).select(
        *KEY, F.col("parent_id").alias("up"))


def jumps(links: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """``(2^k, rows (tree_index, node_id, up))`` while any node has such an ancestor.

    Stops on parent cycles too: past 2^40 steps no real tree has ancestors.
    """
    step, links = 1, cut(links)
    while not links.isEmpty():
        if step > 2 ** 40:
            raise ValueError("parent links form a cycle")
        yield step, links
        above = links.select("tree_index", F.col("node_id").alias("up"), F.col("up").alias("_up"))
        links = cut(links.join(above, ["tree_index", "up"]).select(
            *KEY, F.col("_up").alias("up")))
        step *= 2


def _with_up(tn: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds that are in their tree, with their parent."""
    return tn.select(*KEY, F.col("parent_id").alias("up")).join(
        seeds.select(*KEY).distinct(), KEY, "left_semi")


def ancestor_closure(tn: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds ``(tree_index, node_id)`` and all their ancestors, without repeats.

    Repeats go after every step, so the set never outgrows the trees, however
    deep they are.
    """
    seeds = few(written(seeds.select(*KEY).distinct(), "seeds"))
    start = cut(tn.select(*KEY, F.col("parent_id").alias("up")).join(seeds, KEY, "left_semi"))
    reached = start.where(F.col("up").isNotNull()).select(
        "tree_index", F.col("up").alias("node_id")).distinct()
    for _, links in jumps(inner_links(tn)):
        both = F.array_compact(F.array("node_id", "up"))
        reached = cut(reached.join(links, KEY, "left")
                      .select("tree_index", F.explode(both).alias("node_id")).distinct())
    return start.select(*KEY).unionByName(reached).distinct()


def _chains(families: DataFrame, scope: DataFrame) -> DataFrame:
    """``(tree_index, first, node_id, distance)``: each ``first`` and its ancestors."""
    chains = families.select("tree_index", "first", F.col("first").alias("node_id"),
                             F.lit(0).cast("long").alias("distance"))
    for step, links in jumps(inner_links(scope)):
        here = F.struct("node_id", "distance")
        there = F.struct(F.col("up").alias("node_id"),
                         (F.col("distance") + F.lit(step)).alias("distance"))
        hops = F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))
        chains = chains.join(links, KEY, "left").select(
            "tree_index", "first", F.explode(hops).alias("_h")
        ).select("tree_index", "first", "_h.node_id", "_h.distance")
    return chains


def _seeded(tn: DataFrame, seeds: DataFrame | Column | None):
    """Seeds with their parent, parents with their number of seeds, trees to follow.

    Seeds are all nodes, those that meet a condition, or a table of them.
    """
    if seeds is None:
        start, scope = tn.select(*KEY, F.col("parent_id").alias("up")), tn
    elif isinstance(seeds, Column):
        start, scope = tn.where(seeds).select(*KEY, F.col("parent_id").alias("up")), tn
    else:
        start = written(_with_up(tn, seeds), "seeds")
        scope = tn.join(few(cut(start.select("tree_index").distinct())), "tree_index", "left_semi")
    families = cut(start.where(F.col("up").isNotNull()).groupBy(
        "tree_index", F.col("up").alias("first")).agg(F.count("*").alias("n")))
    return start, families, scope


def _spread_over(start: DataFrame, families: DataFrame, chains: DataFrame, few_table: bool | None = None) -> DataFrame:
    """Each seed beside the chain of its parent, in a single join."""
    few_table = is_few(families) if few_table is None else few_table
    rows = start.where(F.col("up").isNotNull()).select(
        "tree_index", F.col("node_id").alias("seed"), F.col("up").alias("first"))
    return spread_join(rows, chains, ["tree_index", "first"], families, "n", "seed", few_table=few_table)


def ancestor_pairs(tn: DataFrame, seeds: DataFrame | Column | None = None,
                   include_self: bool = True) -> DataFrame:
    """``(tree_index, seed, node_id, distance)``: each seed with all its ancestors.

    Without seeds every node is one; a condition on the rows of ``tn`` names them
    without a join. Chains are built once per distinct parent
    of a seed and only in trees that have seeds.
    """
    start, families, scope = _seeded(tn, seeds)
    pairs = _spread_over(start, families, _chains(families, scope)).select(
        "tree_index", "seed", "node_id", (F.col("distance") + 1).alias("distance"))
    if not include_self:
        return pairs
    return start.select("tree_index", F.col("node_id").alias("seed"), "node_id",
                        F.lit(0).cast("long").alias("distance")).unionByName(pairs)


def ancestors(placed: DataFrame, seeds: DataFrame) -> DataFrame:
    """Path rows from seed to root with the attributes of ``placed``."""
    extra = [c for c in ("time", "x", "y") if c in placed.columns]
    return ancestor_pairs(placed, seeds).join(placed.select(*KEY, *extra), KEY)


def _numbered(tn: DataFrame, of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered rows of the trees that hold a given node, and the rows of those nodes.

    ``of`` holds ``node_id`` and, unless every tree is meant, ``tree_index``.
    Rows that are numbered already are taken as they are.
    """
    on = [c for c in KEY if c in of.columns]
    wanted = of.select(*on).distinct()
    if "enter" not in tn.columns:
        held = wanted if "tree_index" in on else tn.join(wanted, on, "left_semi")
        held = few(cut(held.select("tree_index").distinct()))
        tn = written(nested(tn.join(held, "tree_index", "left_semi")), "nested-nodes")
    return tn, tn.join(wanted, on, "left_semi")


def descendants(tn: DataFrame, of: DataFrame, tips_only: bool = False) -> DataFrame:
    """``(tree_index, query_node, node_id, distance, is_tip)`` below each given node.

    ``of`` holds ``node_id`` and, unless every tree is meant, ``tree_index``.
    """
    rows, tops = _numbered(tn, of)
    found = below(rows.where("is_tip") if tips_only else rows, tops)
    return found.select("tree_index", "query_node", "node_id", "distance", "is_tip")


def descendant_counts(tn: DataFrame) -> DataFrame:
    """Number of descendants and of tips below every inner node of every tree, by subtraction."""
    return nested(tn).where("NOT is_tip").select(
        *KEY, (F.col("leave") - F.col("enter") - 1).alias("n_descendants"), "n_tips")


def search_nodes(placed: DataFrame, min_time=None, max_time=None, min_y=None, max_y=None,
                 is_tip: bool | None = None, has_children: bool | None = None,
                 node_ids: DataFrame | None = None) -> DataFrame:
    """Nodes that meet all given criteria."""
    out = placed
    for column, low, high in (("time", min_time, max_time), ("y", min_y, max_y)):
        if low is not None:
            out = out.where(F.col(column) >= F.lit(low))
        if high is not None:
            out = out.where(F.col(column) <= F.lit(high))
    if is_tip is not None:
        out = out.where(F.col("is_tip") == F.lit(is_tip))
    if has_children is not None:
        out = out.where(F.col("is_tip") != F.lit(has_children))
    return out if node_ids is None else out.join(node_ids.select("node_id"), "node_id",
                                                 "left_semi")


def subtree_nodes(placed: DataFrame, of: DataFrame) -> DataFrame:
    """Rows of the given nodes and everything below, with ``query_node``."""
    rows, tops = _numbered(placed, of)
    return below(rows, tops, include_self=True).select(*placed.columns, "query_node")


def subtree_edges(tn: DataFrame, of: DataFrame) -> DataFrame:
    """Edges below the given nodes."""
    rows, tops = _numbered(tn, of)
    return below(rows, tops).select(
        "tree_index", "query_node", F.col("parent_id").alias("parent"), F.col("node_id").alias("child"))


def common_ancestor(tn: DataFrame, seeds: DataFrame, oldest: bool = False) -> DataFrame:
    """One row per tree: the common ancestor of all its seeds.

    ``(tree_index, mrca, mrca_time)``; NULLs where the seeds do not share a
    root. The youngest one by default, the oldest with ``oldest=True``. Trees
    need two seeds or more.
    """
    seeds = written(seeds.select(*KEY).distinct(), "seeds")
    rows, ends = _numbered(tn, seeds)
    wanted = seeds.groupBy("tree_index").agg(
        F.count("*").alias("n")).where(F.col("n") >= 2)
    # What lies above all seeds lies above the first and the last of them.
    reach = ends.groupBy("tree_index").agg(F.min("enter").alias("_lo"), F.max("enter").alias("_hi"),
                                           F.count("*").alias("_n"))
    shared = rows.join(reach, "tree_index").where("enter <= _lo AND leave > _hi")
    pick = (F.max if oldest else F.min)(F.struct("time", "node_id"))
    best = shared.groupBy("tree_index").agg(pick.alias("_b"), F.first("_n").alias("_n"))
    found = F.col("n") == F.col("_n")                  # a seed that is not in the tree is below nothing
    return wanted.join(best, "tree_index", "left").select(
        "tree_index", F.when(found, F.col("_b.node_id")).alias("mrca"), F.when(found, F.col("_b.time")).alias("mrca_time"))


def lineage_steps(tn: DataFrame, seeds: DataFrame) -> DataFrame:
    """Root-to-seed paths as rows ``(tree_index, seed, step, node_id)``.

    Step 0 is the root. Seeds that are roots have no path. Other columns of
    ``seeds`` (a colour, a name) are carried along.
    """
    start, families, scope = _seeded(tn, seeds)
    chains = _chains(families, scope)
    depth = chains.groupBy("tree_index", "first").agg(F.max("distance").alias("depth"))
    stepped = chains.join(depth, ["tree_index", "first"]).select(
        "tree_index", "first", "node_id", "depth", (F.col("depth") - F.col("distance")).alias("step"))
    # The seed itself comes last, one step below its parent.
    here = F.struct("step", "node_id")
    own = F.struct((F.col("step") + 1).alias("step"), F.col("seed").alias("node_id"))
    rows = _spread_over(start, families, stepped).select("tree_index", "seed", F.explode(
        F.when(F.col("step") == F.col("depth"), F.array(here, own)).otherwise(F.array(here))
    ).alias("_s")).select("tree_index", "seed", "_s.step", "_s.node_id")
    extra = [c for c in seeds.columns if c not in KEY]
    if not extra:
        return rows
    return rows.join(seeds.select("tree_index", F.col("node_id").alias("seed"), *extra),
                     ["tree_index", "seed"])


def lineage_paths(tn: DataFrame, seeds: DataFrame | Column) -> DataFrame:
    """The same as one array per seed; an array is as long as its tree is deep.

    ``seeds`` is a table or a condition on the rows of ``tn``.
    Paths are put together per parent, so siblings share the work.
    """
    start, families, scope = _seeded(tn, seeds)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "node_id")))
    chains = _chains(families, scope)
    short = is_few(families) and is_few(chains)          # all paths together, not their number
    paths = chains.groupBy("tree_index", "first").agg(
        F.transform(ordered, lambda s: s["node_id"]).alias("_path"))
    out = _spread_over(start, families, paths, short).select(
        "tree_index", "seed", F.concat("_path", F.array("seed")).alias("path_node_ids"))
    extra = [] if isinstance(seeds, Column) else [c for c in seeds.columns if c not in KEY]
    if not extra:
        return out
    return out.join(seeds.select("tree_index", F.col("node_id").alias("seed"), *extra),
                    ["tree_index", "seed"])


def acyclic_paths(tn: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seed-to-root path rows of possibly malformed trees, however deep.

    A path stops before the first node it has met already, so it holds every
    node above its seed once, at its least distance. Rounds double the steps
    and keep one row per seed and node, until no simple path of the largest
    tree can be longer; without cycles they end when nothing is left above.
    """
    links = cut(tn.where(F.col("parent_id").isNotNull()).select(*KEY, F.col("parent_id").alias("up")))
    longest = tn.groupBy("tree_index").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    rows = seeds.select("tree_index", F.col("node_id").alias("seed"), "node_id",
                        F.lit(0).cast("long").alias("distance")).distinct()
    step = 1
    while step < 2 * longest and not links.isEmpty():
        ahead = rows.join(links, KEY).select("tree_index", "seed", F.col("up").alias("node_id"),
                                             (F.col("distance") + step).alias("distance"))
        rows = cut(rows.unionByName(ahead).groupBy("tree_index", "seed", "node_id").agg(
            F.min("distance").alias("distance")))
        above = links.select("tree_index", F.col("node_id").alias("up"), F.col("up").alias("_up"))
        links = cut(links.join(above, ["tree_index", "up"]).select(*KEY, F.col("_up").alias("up")))
        step *= 2
    return rows
