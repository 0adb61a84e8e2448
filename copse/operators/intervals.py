"""Genome intervals: one half-open interval per tree, lookups and viewports."""

from __future__ import annotations

from math import ceil, isqrt
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from copse.functions import coordinates as C
from copse.operators.ordered import SINGLE_TASK_ROWS, global_rank

MAX_SPLITS = 4096
#: Stretches of genome that one request reads, at most.
STRETCHES = 8


def breakpoints(edges: DataFrame) -> DataFrame:
    """Distinct ends of the edges."""
    return edges.select(F.explode(F.array("left", "right")).alias("position")).distinct()


def intervals_from_breakpoints(points: DataFrame,
                               single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """N+1 points -> N rows ``(tree_index, left, right)``."""
    ranked = global_rank(points.select(F.col("position").cast("double").alias("position")),
                         "position", out="i", single_task_rows=single_task_rows)
    nothing = F.lit(None).cast("double")
    roles = ranked.select(F.explode(F.array(
        F.struct(F.col("i").alias("tree_index"), F.col("position").alias("l"), nothing.alias("r")),
        F.struct((F.col("i") - 1).alias("tree_index"), nothing.alias("l"),
                 F.col("position").alias("r")))).alias("e"))
    return (roles.groupBy(F.col("e.tree_index").alias("tree_index"))
            .agg(F.max("e.l").alias("left"), F.max("e.r").alias("right"))
            .where(F.col("left").isNotNull() & F.col("right").isNotNull()))


def intervals_from_starts(starts: DataFrame, final_window: float = 50_000) -> DataFrame:
    """Start positions by tree -> intervals; the last one is ``final_window`` long."""
    after = starts.select((F.col("tree_index") - 1).alias("tree_index"),
                          F.col("position").cast("double").alias("_next"))
    return starts.join(after, "tree_index", "left").select(
        "tree_index", F.col("position").cast("double").alias("left"),
        F.coalesce("_next", F.col("position").cast("double") + F.lit(float(final_window)))
        .alias("right"))


class Locator(NamedTuple):
    """Breakpoint index: every ``step``-th start on the driver, all rows in Spark."""

    intervals: DataFrame
    splits: list[float]
    step: int
    n_trees: int
    begin: float
    end: float


def locator(intervals: DataFrame, max_splits: int = MAX_SPLITS) -> Locator:
    """Prepare lookups. At most ``max_splits`` starts reach the driver."""
    n, begin, end = intervals.agg(F.count("*"), F.min("left"), F.max("right")).first()
    if not n:
        raise ValueError("no intervals")
    step = max(1, ceil(n / max_splits))
    picked = intervals.where(F.pmod("tree_index", F.lit(step)) == 0)
    splits = [row[0] for row in picked.select("left").orderBy("left").collect()]
    return Locator(intervals, splits, step, n, begin, end)


def locate(df: DataFrame, position: str, loc: Locator, out: str = "tree_index") -> DataFrame:
    """Raw lookup: index of the last start <= position.

    -1 before the first start, ``n_trees`` from the end on, NULL for NULL / NaN.
    Up to ``MAX_SPLITS`` trees this is a projection (binary search, no
    shuffle). Beyond that it finds the block of ``step`` consecutive trees,
    then the part of the block, then the tree: two equi-joins bring in lists
    of about the square root of ``step`` starts each.
    """
    inf = float("inf")
    value = F.col(position).cast("double")
    bucketizer = Bucketizer(splits=[-inf, *loc.splits, loc.end, inf], inputCol="_pos",
                            outputCol="_bucket", handleInvalid="keep")
    usable = value.isNotNull() & ~F.isnan(value)
    staged = bucketizer.transform(
        df.withColumn("_pos", F.when(usable, value).otherwise(F.lit(0.0))))
    block = F.col("_bucket").cast("long") - 1
    at_end = block == len(loc.splits)
    if loc.step == 1:
        found = F.when(at_end, F.lit(loc.n_trees)).otherwise(block)
        return staged.withColumn(out, F.when(usable, found).cast("long")).drop("_pos", "_bucket")
    part = isqrt(loc.step - 1) + 1                   # trees of a part
    parts = -(-loc.step // part)                     # parts of a block
    index = F.col("tree_index")
    of_block = F.floor(index / F.lit(loc.step)).cast("long")
    of_part = of_block * parts + F.floor(F.pmod(index, F.lit(loc.step)) / F.lit(part)).cast("long")
    starts = F.sort_array(F.collect_list("left")).alias("_starts")
    heads = loc.intervals.where(F.pmod(F.pmod(index, F.lit(loc.step)), F.lit(part)) == 0)
    coarse = heads.groupBy(of_block.alias("_block")).agg(starts)
    fine = loc.intervals.groupBy(of_part.alias("_part")).agg(starts)
    before = F.size(F.filter("_starts", lambda s: s <= F.col("_pos"))) - 1
    in_part = (staged.withColumn("_block", block).join(coarse, "_block", "left")
               .withColumn("_part", F.col("_block") * parts + before).drop("_starts"))
    tree = F.col("_block") * F.lit(loc.step) + (F.col("_part") - F.col("_block") * parts) * part + before
    found = F.when(F.col("_block") < 0, F.lit(-1)).when(
        F.col("_block") == len(loc.splits), F.lit(loc.n_trees)).otherwise(tree)
    return (in_part.join(fine, "_part", "left").withColumn(out, F.when(usable, found).cast("long"))
            .drop("_pos", "_bucket", "_block", "_part", "_starts"))


class Reach(NamedTuple):
    """The stretch of genome that a request touches: trees ``[first, last)`` at ``[left, right)``."""

    first: int
    last: int
    left: float
    right: float


def reach(trees: list[int] | range | DataFrame, loc: Locator) -> Reach:
    """The stretch from the first to the last requested tree that exists.

    Known before a plan is built, so that it can filter the scans.
    """
    if isinstance(trees, DataFrame):
        ends = trees.where(F.col("tree_index").between(0, loc.n_trees - 1)).agg(
            F.min("tree_index"), F.max("tree_index")).first()
        known = [] if ends[0] is None else [ends[0], ends[1]]
    else:
        known = [int(t) for t in trees if 0 <= t < loc.n_trees]
    if not known:
        return Reach(0, 0, 0.0, 0.0)
    first, last = min(known), max(known) + 1
    if loc.step == 1:
        return Reach(first, last, loc.splits[first], loc.splits[last] if last < loc.n_trees else loc.end)
    ends = loc.intervals.where(F.col("tree_index").isin(first, last - 1)).agg(F.min("left"), F.max("right")).first()
    return Reach(first, last, *ends)


def stretches(trees: list[int] | range | DataFrame, loc: Locator, most: int = STRETCHES) -> list[Reach]:
    """At most ``most`` disjoint stretches that hold the requested trees, in order; none if no tree exists.

    The widest gaps between neighbours of the request are left out (in
    positions; in trees where the index is coarse), so trees at both ends of a genome are two short reads and not all of
    it. A DataFrame is first reduced to the least and greatest tree of each of
    ``MAX_SPLITS`` equal parts of the trees: what reaches the driver is bounded.
    """
    if isinstance(trees, DataFrame):
        part = F.floor(F.col("tree_index") / F.lit(max(1, ceil(loc.n_trees / MAX_SPLITS))))
        asked = trees.where(F.col("tree_index").between(0, loc.n_trees - 1)).groupBy(part).agg(
            F.min("tree_index"), F.max("tree_index")).collect()
        runs = sorted((row[1], row[2]) for row in asked)
    else:
        runs = [(t, t) for t in sorted({int(t) for t in trees if 0 <= t < loc.n_trees})]
    apart = [k for k in range(1, len(runs)) if runs[k][0] > runs[k - 1][1] + 1]
    if not runs:
        return []
    if len(apart) >= most:
        start = _starts(loc, {t for k in apart for t in (runs[k - 1][1] + 1, runs[k][0])}) if loc.step == 1 else None
        width = {k: (start[runs[k][0]] - start[runs[k - 1][1] + 1]) if start else runs[k][0] - runs[k - 1][1] for k in apart}
        apart = sorted(sorted(apart, key=lambda k: (-width[k], k))[:most - 1])
    bounds = [(runs[a][0], runs[b - 1][1] + 1) for a, b in zip([0, *apart], [*apart, len(runs)])]
    start = _starts(loc, {t for pair in bounds for t in pair})
    return [Reach(first, last, start[first], start[last]) for first, last in bounds]


def _starts(loc: Locator, trees: set[int]) -> dict[int, float]:
    """Where trees start, the one behind the last at the end; looked up in the table where the index is coarse."""
    known = {loc.n_trees: loc.end}
    if loc.step == 1:
        return known | {t: loc.splits[t] for t in trees if t < loc.n_trees}
    asked = loc.intervals.where(F.col("tree_index").isin([t for t in trees if t < loc.n_trees]))
    return known | {row[0]: row[1] for row in asked.select("tree_index", "left").collect()}


def with_bounds(df: DataFrame, loc: Locator) -> DataFrame:
    """Add ``interval_left`` / ``interval_right`` of ``tree_index``."""
    bounds = loc.intervals.select("tree_index", F.col("left").alias("interval_left"),
                                  F.col("right").alias("interval_right"))
    return df.join(bounds, "tree_index", "left")


def trees_at(df: DataFrame, position: str, loc: Locator, out: str = "tree_index",
             strict: bool = False) -> DataFrame:
    """Tree at each position, half-open; NULL (or an error if strict) off the genome."""
    raw = locate(df, position, loc, out)
    inside = (F.col(out) >= 0) & (F.col(out) < loc.n_trees)
    missing = F.lit(None).cast("long")
    if strict:
        missing = F.raise_error(F.concat(
            F.lit("position outside the genome: "), F.col(position).cast("string"))).cast("long")
    return raw.withColumn(out, F.when(inside, F.col(out)).otherwise(missing))


def trees_at_clamped(df: DataFrame, position: str, loc: Locator,
                     out: str = "tree_index") -> DataFrame:
    """Tree at each position with both ends clamped to the first / last tree."""
    raw = locate(df, position, loc, out)
    return raw.withColumn(out, F.least(F.greatest(F.col(out), F.lit(0)),
                                       F.lit(loc.n_trees - 1)).cast("long"))


def check_range(start: float, end: float, length: float) -> None:
    """Refuse anything but ``0 <= start < end <= length``."""
    start, end = float(start), float(end)
    if not (0 <= start < end <= length):
        raise ValueError(f"range must satisfy 0 <= start < end <= {length}: [{start}, {end})")


def trees_in_range(intervals: DataFrame, start: float, end: float,
                   length: float | None = None) -> DataFrame:
    """Intervals overlapping ``[start, end)``.

    A range that ends inside the gap before the first tree selects nothing.
    """
    if length is not None:
        check_range(start, end, length)
    return intervals.where((F.col("right") > F.lit(float(start)))
                           & (F.col("left") < F.lit(float(end))))


def interval_of_tree(intervals: DataFrame, tree_index: int) -> DataFrame:
    """Bounds of one tree."""
    return intervals.where(F.col("tree_index") == tree_index)


def indexed_breakpoints(intervals: DataFrame) -> DataFrame:
    """Intervals -> N+1 rows ``(i, position)``."""
    last = intervals.agg(F.max("tree_index")).scalar()
    closing = intervals.where(F.col("tree_index") == last).select(
        (F.col("tree_index") + 1).alias("i"), F.col("right").alias("position"))
    return intervals.select(F.col("tree_index").alias("i"),
                            F.col("left").alias("position")).unionByName(closing)


def viewport_bounds(points: DataFrame, start: float, end: float) -> DataFrame:
    """One row ``(lo, hi, count)`` by the closed rule over ``(i, position)`` rows.

    ``lo`` is the last point strictly before ``start``, except that a start at
    or before the first point gives the first and one at or after the last
    point gives the last. ``hi`` is one past the first point beyond ``end``.
    """
    start, end = F.lit(float(start)), F.lit(float(end))
    p = F.col("position")
    stats = points.agg(
        F.min("i").alias("first"), F.max("i").alias("last"), F.max("position").alias("top"),
        F.max(F.when(p < start, F.col("i"))).alias("before"),
        F.min(F.when(p > end, F.col("i"))).alias("after"), F.count("*").alias("n"))
    lo = F.when(start >= F.col("top"), F.col("last")).otherwise(F.coalesce("before", "first"))
    hi = F.coalesce(F.col("after"), F.col("n")) + 1
    return stats.select(lo.alias("lo"), hi.alias("hi")).select(
        "lo", "hi", F.greatest(F.lit(0), F.col("hi") - F.col("lo")).alias("count"))


def decimate(points: DataFrame, lo: Column, hi: Column, max_points: int = 2000) -> DataFrame:
    """Points ``lo <= i < hi``, every ``ceil(count / max_points)``-th of them.

    ``lo`` and ``hi`` are scalar columns (``frame.scalar()`` or literals). The
    number of points is counted, so a ``hi`` past the end does not widen the
    step.
    """
    if max_points < 1:
        raise ValueError("max_points must be at least 1")
    seen = points.where((F.col("i") >= lo) & (F.col("i") < hi))
    stats = seen.agg(F.struct(F.count("*").alias("n"), F.min("i").alias("base"))).scalar()
    step = F.greatest(F.lit(1), F.ceil(stats["n"] / F.lit(max_points)))
    return seen.where(F.pmod(F.col("i") - stats["base"], step) == 0)


def visible_breakpoints(intervals: DataFrame, start: float, end: float,
                        max_points: int = 2000) -> DataFrame:
    """Breakpoints of the trees overlapping ``[start, end)``, decimated."""
    hit = trees_in_range(intervals, start, end).agg(
        F.min("tree_index").alias("lo"), (F.max("tree_index") + 2).alias("hi"))
    view = hit.select(F.struct("lo", "hi")).scalar()
    return decimate(indexed_breakpoints(intervals), view["lo"], view["hi"], max_points)


def tree_bins(intervals: DataFrame, start: float, end: float) -> DataFrame:
    """Clip to the viewport; span and midpoint of the whole interval."""
    return intervals.select(
        "tree_index", "left", "right",
        F.greatest("left", F.lit(float(start))).alias("visible_start"),
        F.least("right", F.lit(float(end))).alias("visible_end"),
        (F.col("right") - F.col("left")).alias("span"),
        ((F.col("left") + F.col("right")) / F.lit(2.0)).alias("midpoint"))


def slot_count(n: Column, scale: float) -> Column:
    """``min(n, max(10, ceil(n / scale)))``, at least one."""
    wanted = F.greatest(F.lit(10), F.ceil(n / F.lit(float(scale))))
    return F.greatest(F.lit(1), F.least(n, wanted)).cast("long")


def assign_slots(bins: DataFrame, start: float, end: float, scale: float) -> DataFrame:
    """Slot by midpoint, clamped to the first and last slot."""
    slots = bins.agg(slot_count(F.count("*"), scale).alias("slots")).scalar()
    width = F.lit(float(end) - float(start)) / slots
    raw = F.floor((F.col("midpoint") - F.lit(float(start))) / width)
    return bins.withColumn("slot_width", width).withColumn(
        "slot", F.least(slots - 1, F.greatest(F.lit(0), raw)).cast("long"))


def _slot_centre(start: float) -> Column:
    width = F.col("slot_width")
    return F.lit(float(start)) + F.col("slot") * width + width / F.lit(2.0)


def _preference(strategy: str, start: float, seed: int) -> Column:
    """Sort key, smaller wins; the tree index settles ties."""
    if strategy == "first":
        return F.col("left")
    if strategy == "center_weighted":
        return F.abs(F.col("midpoint") - _slot_centre(start))
    if strategy == "span_weighted_random":
        # Weighted reservoir: exponential keys from two linear congruential steps, reproducible
        # for a seed in any engine.
        first = F.pmod(F.pmod(F.col("tree_index"), F.lit(2 ** 31)) * F.lit(2_654_435_761)
                       + F.lit((seed * 40_503) % 2 ** 32), F.lit(2 ** 32))
        second = F.pmod(first * F.lit(1_103_515_245) + F.lit(12_345), F.lit(2 ** 32))
        unit = (second.cast("double") + F.lit(1.0)) / F.lit(float(2 ** 32 + 1))
        return F.when(F.col("span") > 0, -F.log(unit) / F.col("span")).otherwise(
            F.lit(float("inf")))
    return -F.col("span")


def representatives(slotted: DataFrame, start: float, scale: float,
                    strategy: str = "largest_span", seed: int = 0) -> DataFrame:
    """One tree per slot with its group size and detail level.

    Only the slot winners travel: ``min`` of (preference, tree) is combined
    before the shuffle, so a slot holding most trees costs one task nothing.
    """
    keyed = slotted.withColumn("_key", _preference(strategy, start, seed))
    best = keyed.groupBy("slot").agg(
        F.min(F.struct("_key", "tree_index")).alias("_best"),
        F.count("*").alias("group_size"))
    return best.select("slot", F.col("_best.tree_index").alias("tree_index"), "group_size",
                       C.detail_level(F.col("group_size"), scale).alias("detail"))


def show_all(bins: DataFrame, start: float, end: float, bp_per_unit: float) -> DataFrame:
    """Every tree in its own slot of equal width, 90 % of it filled."""
    stats = bins.agg(F.struct(F.count("*").alias("n"), F.min("tree_index").alias("base"))).scalar()
    n = stats["n"]
    width = F.lit(float(end) - float(start)) / n
    tree_width = F.lit((float(end) - float(start)) / float(bp_per_unit)) / n * F.lit(0.9)
    slot = F.col("tree_index") - stats["base"]
    centre = F.lit(float(start)) + (slot + F.lit(0.5)) * width
    return bins.select(
        "*", slot.alias("slot"), F.lit(1).cast("long").alias("group_size"),
        F.lit(2).alias("detail"), F.lit(True).alias("visible"),
        (centre / F.lit(float(bp_per_unit)) - tree_width / F.lit(2.0)).alias("translate_x"),
        tree_width.alias("scale_x"))


def local_bins(intervals: DataFrame, lo: int, hi: int, start: float, end: float,
               bp_per_unit: float, zoomed_bp_per_unit: float,
               strategy: str = "largest_span", seed: int = 0) -> DataFrame:
    """All trees between breakpoints ``lo`` and ``hi - 1``, slotted and marked.

    Hidden trees stay with ``visible = false``.
    """
    if bp_per_unit <= 0 or zoomed_bp_per_unit <= 0:
        raise ValueError("bp per unit must be positive")
    scale = zoomed_bp_per_unit / bp_per_unit
    chosen = intervals.where((F.col("tree_index") >= lo) & (F.col("tree_index") < hi - 1))
    bins = tree_bins(chosen, start, end)
    if scale < 1:
        return show_all(bins, start, end, bp_per_unit)
    slotted = assign_slots(bins, start, end, scale)
    best = representatives(slotted, start, scale, strategy, seed).select(
        "slot", F.col("tree_index").alias("_chosen"), "group_size", "detail")
    visible = F.col("tree_index") == F.col("_chosen")
    tree_width = F.col("slot_width") / F.lit(float(bp_per_unit)) / F.lit(1.05)
    shift = _slot_centre(start) / F.lit(float(bp_per_unit)) - tree_width / F.lit(2.0)
    return slotted.join(best, "slot").select(
        "tree_index", "left", "right", "visible_start", "visible_end", "span", "midpoint",
        "slot", "group_size", F.when(visible, F.col("detail")).alias("detail"),
        visible.alias("visible"), F.when(visible, shift).alias("translate_x"),
        F.when(visible, tree_width).alias("scale_x"))
