import pytest
from pyspark.sql import functions as F

from copse.operators import layout as LAY, lineage as LIN, mutations as MUT, skew, trees as T
from copse.plans import requests as R
from copse.plans.collection import open_collection
from tests import trees_by_hand as hand


def test_membership_and_roots(two_trees):
    c = two_trees
    nodes = {(r.tree_index, r.node_id): r.parent_id for r in c.tree_nodes().collect()}
    assert nodes == {(0, 0): 3, (0, 2): 3, (0, 3): None, (0, 6): 5, (0, 5): None,
                     (1, 0): 4, (1, 2): 4, (1, 4): None, (1, 6): 5, (1, 5): None}
    runs = sorted(tuple(r) for r in T.membership_ranges(c.runs(), 2).collect())
    assert runs == [(0, 0, 2), (2, 0, 2), (3, 0, 1), (4, 1, 2), (5, 0, 2), (6, 0, 2)]
    stats = [tuple(r) for r in T.tree_statistics(c.runs(), c.loc)
             .orderBy("tree_index").collect()]
    assert stats == [(0, 0, 10, 3.0, 5.0, 2), (1, 10, 20, 3.0, 7.0, 2)]


def test_mutations_inherit_and_place(two_trees):
    c = two_trees
    rows = {r.id: r for r in R.located_mutations(c, bounds=True).collect()}
    assert [rows[i].inherited_state for i in (0, 1)] == ["A", "G"]
    assert {r.tree_index for r in rows.values()} == {0}
    muts = R.located_mutations(c).withColumnRenamed("id", "mutation_id")
    at = {r.mutation_id: r for r in MUT.place(muts, R.placed_nodes(c), c.time_range()).collect()}
    node_y, parent_y = 1.0, 1 - 1 / 50
    assert at[0].y == pytest.approx((node_y + parent_y) / 2)
    assert at[1].y == pytest.approx(1 - 0.5 / 50)
    page = R.mutation_window(c, 0, 10).collect()
    assert [(r.position, r.mutation, r.tree_index, r.interval_right) for r in page] == [
        (4, "A->G", 0, 10.0), (4, "A->T", 0, 10.0)]
    near = R.mutations_near(c, 6.0, 5).collect()
    assert [r.distance for r in near] == [2, 2]


def test_star_trees_have_one_run_per_root(spark):
    trees, samples = 48, 100
    nodes = spark.range(samples).selectExpr("id", "1L flags", "0.0D time").unionByName(
        spark.range(trees).selectExpr(f"id + {samples} id", "0L flags", "id + 1.0D time")
    ).selectExpr("*", "cast(null as long) population", "cast(null as long) individual", "'{}' metadata_json")
    edges = spark.range(trees * samples).selectExpr(
        "id", f"cast(id div {samples} as double) left", f"id div {samples} + 1.0D right",
        f"id div {samples} + {samples} parent", f"id % {samples} child")
    c = open_collection(nodes, edges, None, None, None, None)
    runs = {r.node_id: (r.first_tree, r.last_tree)
            for r in T.membership_ranges(c.runs(), trees).collect()}
    assert all(runs[samples + i] == (i, i + 1) for i in range(trees))
    assert all(runs[s] == (0, trees) for s in range(samples))
    lists = T.child_lists(c.tree_edges(), chunk=40).collect()
    assert len(lists) == trees * 3 and max(len(r.children) for r in lists) == 40
    counts = T.run_counts(c.runs(), c.loc).collect()
    assert {(r.n_nodes, r.n_roots) for r in counts} == {(samples + 1, 1)}


def test_explode_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(T, "EXPLODE_CHUNK", 4)
    spans = spark.createDataFrame([(1, 2, 13), (2, 4, 8), (3, 5, 5)], "k long, first_tree long, last_tree long")
    got = sorted((r.k, r.tree_index) for r in T.explode_spans(spans).collect())
    assert got == [(1, t) for t in range(2, 13)] + [(2, t) for t in range(4, 8)]
    asked = sorted((r.k, r.tree_index) for r in T.explode_spans(spans, [7, 3, 12, 99]).collect())
    assert asked == [(1, 3), (1, 7), (1, 12), (2, 7)]


def test_picking_keeps_order_and_repeats(two_trees):
    tn = two_trees.tree_nodes()
    rows = T.pick_trees(tn, [1, 7, 0, 1]).select("request_pos", "tree_index").distinct().collect()
    assert sorted(tuple(r) for r in rows) == [(0, 1), (2, 0), (3, 1)]
    with pytest.raises(IndexError):
        T.pick_trees(tn, [0, 2], 2, on_missing="error")


SHAPES = {**{i: dict(seed=i, n_tips=3 + 5 * i) for i in range(6)},
          6: dict(seed=6, n_tips=40, chain=True), 7: dict(seed=7, n_tips=1)}


@pytest.fixture(scope="module")
def forest():
    return {i: hand.random_tree(**kw) for i, kw in SHAPES.items()}


@pytest.mark.parametrize("kernel_nodes,single", [(10_000, 10_000), (20, 10_000), (0, 8)])
def test_layout_is_the_walk_whatever_the_path(spark, forest, kernel_nodes, single):
    tn = hand.frame(spark, forest)
    got = {(r.tree_index, r.node_id): r.x for r in LAY.layout_x(
        tn, kernel_nodes=kernel_nodes, single_task_rows=single).collect()}
    want = {(i, n): x for i, tree in forest.items() for n, x in hand.layout(tree).items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_kernel_carries_trees_across_batches(spark, forest):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.tree_index, r.node_id): r.x for r in LAY.layout_x(hand.frame(spark, forest)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(i, n): x for i, tree in forest.items() for n, x in hand.layout(tree).items()}
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_ancestors_and_closure(spark, forest):
    tn = hand.frame(spark, forest).cache()
    got = {(r.tree_index, r.seed, r.node_id, r.distance) for r in LIN.ancestor_pairs(tn).collect()}
    assert got == {(i, n, a, d) for i, tree in forest.items() for n in tree
                   for d, a in enumerate(hand.ancestors(tree, n))}
    seeds = [(i, n) for i, tree in forest.items() for n in sorted(tree)[::5]] + [(0, -1)]
    df = spark.createDataFrame(seeds, "tree_index long, node_id long")
    closed = {(r.tree_index, r.node_id) for r in LIN.ancestor_closure(tn, df).collect()}
    assert closed == {(i, a) for i, n in seeds if n >= 0 for a in hand.ancestors(forest[i], n)}
    some = {(r.tree_index, r.seed, r.distance) for r in LIN.ancestor_pairs(tn, df).collect()}
    assert some == {(i, n, d) for i, n in seeds if n >= 0
                    for d in range(len(hand.ancestors(forest[i], n)))}


def test_descendants_and_common_ancestor(spark, forest):
    tn = hand.frame(spark, forest).cache()
    tree = forest[4]
    top = max(tree, key=lambda n: tree[n][1])
    of = spark.createDataFrame([(4, top)], "tree_index long, node_id long")
    below = {n for n in tree if top in hand.ancestors(tree, n)[1:]}
    assert {r.node_id for r in LIN.descendants(tn, of).collect()} == below
    tips = {r.node_id for r in LIN.descendants(tn, of, tips_only=True).collect()}
    assert tips == {n for n in below if n not in hand.children(tree)}
    assert {r.node_id for r in LIN.subtree_nodes(tn, of).collect()} == below | {top}
    assert LIN.subtree_edges(tn, of).count() == len(below)
    seeds = sorted(tips)[:3]
    df = spark.createDataFrame([(4, n) for n in seeds], "tree_index long, node_id long")
    shared = set.intersection(*[set(hand.ancestors(tree, n)) for n in seeds])
    young = min(shared, key=lambda n: tree[n][1])
    assert LIN.common_ancestor(tn, df).first().mrca == young
    assert LIN.common_ancestor(tn, df, oldest=True).first().mrca == max(shared, key=lambda n: tree[n][1])


@pytest.fixture(scope="module")
def four_nodes(spark):
    return spark.createDataFrame(
        [(0, 0, None, 4.0, 0.5, 0.0, 2, False), (0, 1, 0, 2.0, 0.2, 0.5, 1, False),
         (0, 2, 0, 0.0, 0.8, 1.0, 0, True), (0, 3, 1, 0.0, 0.1, 1.0, 0, True)],
        "tree_index long, node_id long, parent_id long, time double, x double, y double, "
        "n_children long, is_tip boolean")


def test_four_node_tree(spark, four_nodes):
    seed = spark.createDataFrame([(0, 3)], "tree_index long, node_id long")
    path = LIN.ancestors(four_nodes, seed).orderBy("distance").collect()
    assert [(r.node_id, r.time) for r in path] == [(3, 0.0), (1, 2.0), (0, 4.0)]
    ids = lambda **kw: sorted(r.node_id for r in LIN.search_nodes(four_nodes, **kw).collect())
    assert ids(min_y=0.9) == [2, 3] and ids(max_y=0.6) == [0, 1]
    assert ids(is_tip=True, max_time=1.0) == [2, 3] and ids(has_children=True) == [0, 1]
    wanted = spark.createDataFrame([(1,), (2,), (9,)], "node_id long")
    assert ids(node_ids=wanted) == [1, 2]
    one = spark.createDataFrame([(0, 1)], "tree_index long, node_id long")
    assert sorted(r.node_id for r in LIN.subtree_nodes(four_nodes, one).collect()) == [1, 3]
    both = spark.createDataFrame([(0, 2), (0, 3)], "tree_index long, node_id long")
    assert LIN.common_ancestor(four_nodes, both).first().mrca == 0
    coloured = both.withColumn("color", F.lit("red"))
    paths = {r.seed: r.path_node_ids for r in LIN.lineage_paths(four_nodes, coloured).collect()}
    assert paths == {2: [0, 2], 3: [0, 1, 3]}


def test_a_cycle_ends_the_path(spark):
    loop = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 1)],
                                 "tree_index long, node_id long, parent_id long")
    seed = spark.createDataFrame([(0, 1)], "tree_index long, node_id long")
    got = LIN.acyclic_paths(loop, seed).orderBy("distance").collect()
    assert [r.node_id for r in got] == [1, 2, 3]


def test_comparison(two_trees):
    out = R.compare_trees(two_trees, [0, 1, 9]).collect()
    assert sorted((r.change, r.parent, r.child) for r in out) == [
        ("inserted", 4, 0), ("inserted", 4, 2), ("removed", 3, 0), ("removed", 3, 2)]
    assert all(r.parent_y == pytest.approx(1 - (2 if r.change == "inserted" else 1) / 50) for r in out)


def test_hot_keys_are_spread(spark, forest, monkeypatch):
    tn = hand.frame(spark, forest).cache()
    plain = {tuple(r) for r in LIN.ancestor_pairs(tn).collect()}
    ups = {(r.tree_index, r.node_id, r.parent_time) for r in LAY.with_parent(tn, ["time"]).collect()}
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    spread = LIN.ancestor_pairs(tn)
    assert "_salt" in spread._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in spread.collect()} == plain
    again = LAY.with_parent(tn, ["time"]).collect()
    assert {(r.tree_index, r.node_id, r.parent_time) for r in again} == ups and len(again) == len(ups)


def ladder(spark, tips):
    """One ladder: tips 0..n-1 hang from inner nodes n..2n-2, the root first."""
    rows = [(0, k, tips + min(k, tips - 2)) for k in range(tips)]
    rows += [(0, tips + k + 1, tips + k) for k in range(tips - 2)] + [(0, tips, None)]
    return spark.createDataFrame(
        [(t, c, p, 0.0 if c < tips else 1.0, int(c < tips), 0 if c < tips else 2, c < tips) for t, c, p in rows],
        "tree_index long, node_id long, parent_id long, time double, flags long, n_children long, is_tip boolean")


def test_both_layouts_agree_exactly_on_a_deep_tree(spark):
    tn = ladder(spark, 400)
    joined = {r.node_id: r.x for r in LAY.layout_x(tn, kernel_nodes=10).collect()}
    assert joined == {r.node_id: r.x for r in LAY.layout_x(tn, kernel_nodes=10_000).collect()}


def test_long_paths_have_no_limit(spark):
    n = 12_000
    chain = spark.createDataFrame([(0, k, k + 1) for k in range(n - 1)] + [(0, n - 1, None), (1, 5, 6), (1, 6, 7), (1, 7, 6)],
                                  "tree_index long, node_id long, parent_id long")
    seeds = spark.createDataFrame([(0, 0), (0, n - 3), (1, 5)], "tree_index long, node_id long")
    paths = {}
    for r in LIN.acyclic_paths(chain, seeds).collect():
        paths.setdefault((r.tree_index, r.seed), {})[r.distance] = r.node_id
    assert paths[0, 0] == {k: k for k in range(n)}
    assert paths[0, n - 3] == {k: n - 3 + k for k in range(3)}
    assert paths[1, 5] == {0: 5, 1: 6, 2: 7}


def test_two_parents_at_once_are_refused(spark, two_trees):
    more = spark.createDataFrame([(9, 0.0, 10.0, 4, 0)], two_trees.edges.schema)
    crowded = two_trees._replace(edges=two_trees.edges.unionByName(more))
    with pytest.raises(Exception, match="two parents at once: node 0 in tree 0"):
        crowded.tree_nodes().collect()
