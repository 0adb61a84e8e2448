"""What the plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from workload import queries as registered
from copse.operators import intervals as I, trees as T
from copse.operators.intervals import STRETCHES
from copse.plans import requests as R
from workload.collection import orders_collection

SF = "/root/testdata/sf0.001"
NATIVE = ("tre24_tree_statistics", "tre01_active_edges", "tre05_membership_isolated", "snk05_membership_ranges",
          "cmp01_neighbour_differences", "met03_values", "mut03_with_interval", "det05_tree_records",
          "int04_tree_at_position", "int18_local_bins", "cmp07_topology_runs", "snk04_metadata_index")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_a_text():
    assert set(registered.QUERIES) == set(registered.ORACLE)


def test_a_request_reads_its_stretch_of_the_genome(spark):
    """The range of the requested trees filters the scan, and only they are exploded."""
    c = orders_collection(spark, SF)
    whole = spark.createDataFrame([(40,), (44,)], "tree_index long")
    for trees in ([40], whole):
        text = plan(c.tree_nodes(trees))
        assert "GreaterThan(right" in text and "LessThan(left" in text
        within = c.reach(trees)
        assert 0 < c.edges.where((F.col("left") < within.right) & (F.col("right") > within.left)).count() < c.edges.count()
        got = c.tree_nodes(trees)
        assert got.count() == c.tree_nodes().where(F.col("tree_index").isin(
            [r[0] for r in whole.collect()] if trees is whole else trees)).count()
    assert c.tree_nodes([]).count() == 0 == c.tree_nodes([-1, 10 ** 6]).count()
    long_list = list(range(0, 10_000, 2))
    assert c.tree_nodes(long_list).count() == c.tree_nodes().where("tree_index % 2 = 0").count()


def test_trees_far_apart_are_several_stretches(spark):
    """Trees at both ends are two short reads, and rows are those of the whole collection."""
    c = orders_collection(spark, SF)
    n = c.loc.n_trees
    ends = c.stretches([n - 1, 0, 0, n + 7])
    assert [(s.first, s.last) for s in ends] == [(0, 1), (n - 1, n)]
    assert c.stretches([3, 5, 4]) == [c.reach([3, 5])] and c.stretches([-1, n]) == []
    text = plan(c.tree_edges([0, n - 1]))
    assert "PushedFilters: [Or(And(LessThan(left," in text
    read = c.edges.where(T.any_of((F.col("left") < s.right) & (F.col("right") > s.left) for s in ends))
    assert read.count() < c.edges.count()
    far = [1, 2, 9, *range(20, 70, 4), n - 1]
    table = spark.createDataFrame([(t,) for t in far], "tree_index long")
    for trees in (far, table):
        cover = c.stretches(trees)
        assert len(cover) == STRETCHES and all(a.last < b.first for a, b in zip(cover, cover[1:]))
        assert all(sum(s.first <= t < s.last for s in cover) == 1 for t in far)
        for isolated in (True, False):
            got = c.tree_nodes(trees, isolated)
            want = c.tree_nodes(isolated=isolated).where(F.col("tree_index").isin(far))
            assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    counts = T.run_counts(c.runs(True, c.stretches(far)), c.loc, c.stretches(far))
    whole = {r[0]: (r[1], r[2]) for r in T.run_counts(c.runs(), c.loc).collect()}
    got = {r[0]: (r[1], r[2]) for r in counts.collect()}
    assert set(far) <= set(got) and all(whole[t] == v for t, v in got.items())
    sites = R.located_mutations(c, within=c.stretches([0, n - 1])).where(F.col("tree_index").isin(0, n - 1))
    assert sites.count() == R.located_mutations(c).where(F.col("tree_index").isin(0, n - 1)).count() > 0


def test_stretches_of_a_coarse_index(spark):
    """With fewer starts on the driver than trees, ends of stretches come from the table."""
    points = spark.createDataFrame([(float(k * k),) for k in range(101)], "position double")
    loc = I.locator(I.intervals_from_breakpoints(points), max_splits=10)
    assert I.stretches([0, 50, 51, 99], loc, 3) == [(0, 1, 0.0, 1.0), (50, 52, 2500.0, 2704.0), (99, 100, 9801.0, 10000.0)]
    assert I.stretches(spark.range(0, 100, 99).toDF("tree_index"), loc) == [(0, 1, 0.0, 1.0), (99, 100, 9801.0, 10000.0)]


def test_requested_trees_keep_order_and_repeats(spark):
    c = orders_collection(spark, SF)
    n = c.loc.n_trees
    got = R.requested_trees(c, [n - 1, 0, 0])
    sizes = {r[0]: r[1] for r in got.groupBy("request_pos").count().collect()}
    assert sizes[1] == sizes[2] == c.tree_nodes([0]).count() and sizes[0] == c.tree_nodes([n - 1]).count()
    with pytest.raises(IndexError):
        R.requested_trees(c, [0, n], on_missing="error")


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for forbidden in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups",
                      "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert forbidden not in text, forbidden


def test_edge_spans_do_not_shuffle(spark):
    c = orders_collection(spark, SF)
    assert "Exchange" not in plan(c.spans) and "Exchange" not in plan(c.tree_edges())


def test_filters_and_columns_reach_the_scan(spark):
    c = orders_collection(spark, SF)
    text = plan(T.tree_edges(c.spans).select("child").where("child = 107"))
    assert "EqualTo(child,107)" in text and "metadata_json" not in text
    scan = plan(c.samples().select("id"))
    assert "ReadSchema: struct<id:bigint,flags:bigint>" in scan


def test_sweeps_combine_before_they_shuffle(spark):
    c = orders_collection(spark, SF)
    text = plan(c.runs())
    assert "partial_sum(up" in text
    assert text.count("Exchange hashpartitioning") <= 3


def test_a_page_is_a_top_k(spark):
    text = plan(entry.queries()["mut02_near_position"](spark, SF))
    assert "TakeOrderedAndProject" in text


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.where(F.col("root_time") == 30).count() == 81
