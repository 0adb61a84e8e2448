import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from copse.functions import coordinates as C
from copse.operators import intervals as I


def points(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "position double")


@pytest.fixture(scope="module")
def genome(spark):
    rnd = random.Random(5)
    cuts = sorted(rnd.sample(range(10, 5000), 120))
    return cuts, I.intervals_from_breakpoints(points(spark, cuts)).cache()


def test_breakpoints_become_intervals(spark, genome):
    cuts, iv = genome
    got = [tuple(r) for r in iv.orderBy("tree_index").collect()]
    assert got == [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    many = I.intervals_from_breakpoints(points(spark, cuts), single_task_rows=5)
    assert sorted(tuple(r) for r in many.collect()) == got


@pytest.mark.parametrize("max_splits", [4096, 9])
def test_lookup_matches_bisection(spark, genome, max_splits):
    cuts, iv = genome
    loc = I.locator(iv, max_splits)
    where = [0.0, 9.999, *map(float, cuts), *[c - 0.5 for c in cuts], 9999.0]
    got = {r.position: r.tree_index for r in
           I.locate(points(spark, where), "position", loc).collect()}
    assert got == {p: bisect.bisect_right(cuts, p) - 1 for p in where}


def test_unknown_positions_stay_unknown(spark, genome):
    loc = I.locator(genome[1])
    df = spark.createDataFrame([(None,), (float("nan"),)], "position double")
    assert [r.tree_index for r in I.locate(df, "position", loc).collect()] == [None, None]


def test_half_open_lookup_and_errors(spark, two_trees):
    loc = two_trees.loc
    got = {r.position: r.tree_index for r in
           I.trees_at(points(spark, [9.999, 10, -1, 20]), "position", loc).collect()}
    assert got == {9.999: 0, 10.0: 1, -1.0: None, 20.0: None}
    with pytest.raises(Exception, match="outside the genome"):
        I.trees_at(points(spark, [20]), "position", loc, strict=True).collect()
    clamped = {r.position: r.tree_index for r in
               I.trees_at_clamped(points(spark, [-5, 10, 99]), "position", loc).collect()}
    assert clamped == {-5.0: 0, 10.0: 1, 99.0: 1}


def test_ranges(two_trees):
    hit = lambda a, b: sorted(r.tree_index for r in
                              I.trees_in_range(two_trees.intervals, a, b, 20.0).collect())
    assert hit(2, 10) == [0] and hit(2, 10.1) == [0, 1]
    for bad in ((-1, 1), (0, 0), (10, 9), (0, 21)):
        with pytest.raises(ValueError):
            hit(*bad)


@pytest.mark.parametrize("start,end", [(0, 100), (10, 50), (300, 900), (4999, 5000), (700, 99_999)])
def test_closed_viewport_bounds(genome, start, end):
    cuts, iv = genome
    if start <= cuts[0]:
        lo = 0
    elif start >= cuts[-1]:
        lo = len(cuts) - 1
    else:
        lo = bisect.bisect_left(cuts, start) - 1
    hi = bisect.bisect_right(cuts, end) + 1
    row = I.viewport_bounds(I.indexed_breakpoints(iv), start, end).first()
    assert tuple(row) == (lo, hi, hi - lo)


def test_decimation_keeps_every_nth(genome):
    cuts, iv = genome
    got = sorted(r.position for r in I.decimate(I.indexed_breakpoints(iv), F.lit(5), F.lit(500), 30).collect())
    seen = cuts[5:500]
    assert got == seen[::math.ceil(len(seen) / 30)]


def test_show_all(two_trees):
    bins = I.local_bins(two_trees.intervals, 0, 3, 0.0, 20.0, 1.0, 0.5).orderBy("slot").collect()
    assert [(b.left, b.right, b.slot, b.detail) for b in bins] == [(0, 10, 0, 2), (10, 20, 1, 2)]
    assert bins[0].scale_x == pytest.approx(9.0) and bins[0].translate_x == pytest.approx(0.5)


@pytest.mark.parametrize("strategy", ["largest_span", "center_weighted", "first"])
def test_representatives_match_a_sequential_walk(genome, strategy):
    cuts, iv = genome
    start, end, scale = 100.0, 4900.0, 4.0
    trees = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    slots = min(len(trees), max(10, math.ceil(len(trees) / scale)))
    width, best = (end - start) / slots, {}
    for i, a, b in trees:
        slot = min(slots - 1, max(0, math.floor(((a + b) / 2 - start) / width)))
        centre = start + slot * width + width / 2
        key = {"largest_span": -(b - a), "first": a,
               "center_weighted": abs((a + b) / 2 - centre)}[strategy]
        best.setdefault(slot, []).append((key, i))
    want = {s: (min(v)[1], len(v)) for s, v in best.items()}
    slotted = I.assign_slots(I.tree_bins(iv, start, end), start, end, scale)
    got = I.representatives(slotted, start, scale, strategy).collect()
    assert {r.slot: (r.tree_index, r.group_size) for r in got} == want


def test_random_choice_is_stable_and_from_the_slot(genome):
    iv = genome[1]
    slotted = I.assign_slots(I.tree_bins(iv, 0.0, 5000.0), 0.0, 5000.0, 8.0)
    members = {(r.slot, r.tree_index) for r in slotted.collect()}
    pick = lambda seed: {(r.slot, r.tree_index) for r in I.representatives(
        slotted, 0.0, 8.0, "span_weighted_random", seed).collect()}
    assert pick(3) == pick(3) and pick(3) <= members and pick(3) != pick(4)


@pytest.mark.parametrize("group,scale,level", [(1, 1.0, 3), (1, 2.0, 3), (10, 1.0, 2), (100, 4.0, 1),
                                               (9, 100.0, 2), (5000, 9.0, 1)])
def test_detail_level(spark, group, scale, level):
    row = spark.range(1).select(C.detail_level(F.lit(group), scale).alias("d")).first()
    assert row.d == level


def test_time_scales(spark):
    t = F.col("t")
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (-3.0,), (12.0,)], "t double")
    lo, hi = F.lit(0.0), F.lit(10.0)
    y = [r.y for r in df.select(C.time_to_y(t, lo, hi).alias("y")).collect()]
    assert y == pytest.approx([1, 0.5, 0, 1, 0])
    y = [r.y for r in df.select(C.time_to_y(t, lo, hi, " LOG ").alias("y")).collect()]
    assert y[1] == pytest.approx(1 - math.log1p(5) / math.log1p(10))
    flat = df.select(C.time_to_y(t, lo, F.lit(0.0), "log").alias("y"),
                     C.y_to_time(t, F.lit(4.0), F.lit(4.0)).alias("b")).collect()
    assert {(r.y, r.b) for r in flat} == {(1.0, 4.0)}
