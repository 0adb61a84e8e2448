"""Nested numbers, blocks of ranges, and what is asked of them, against plain walks."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from copse.operators import blocks, lineage as LIN, nesting
from trees_by_hand import ancestors, children, random_tree

SCHEMA = "tree_index long, node_id long, parent_id long, time double, n_children long, is_tip boolean"


def table(spark, trees):
    rows = []
    for t, tree in trees.items():
        kids = children(tree)
        rows += [(t, n, up, float(time), len(kids.get(n, [])), n not in kids) for n, (up, time) in tree.items()]
    return spark.createDataFrame(rows, SCHEMA)


def ladder(depth):
    """Chain node j holds a tip and the next one: {node: (parent, time)}."""
    tree = {}
    for j in range(depth):
        tree[1000 + j] = (1000 + j - 1 if j else None, float(depth - j + 1))
        tree[100_000 + j] = (1000 + j, 0.0)
    return tree


@pytest.fixture(scope="module")
def trees():
    found = {t: random_tree(t, 3 + t % 17, chain=t % 4 == 0) for t in range(30)}
    return found | {30: ladder(1200), 31: {5: (None, 1.0)}, 32: {k: (0 if k else None, 0.0) for k in range(700)}}


def plain_numbers(tree):
    kids, out, clock = children(tree), {}, [0]

    def number(root):
        todo = [(root, 0, False)]
        while todo:
            node, depth, done = todo.pop()
            if done:
                below = [out[k] for k in kids.get(node, [])]
                out[node] = (out[node], clock[0], depth, sum(b[3] for b in below) or 1, len(tree))
                continue
            out[node] = clock[0]
            clock[0] += 1
            todo += [(node, depth, True)] + [(k, depth + 1, False) for k in sorted(kids.get(node, []), reverse=True)]

    for root in sorted(n for n, (up, _) in tree.items() if up is None):
        number(root)
    return out


def test_numbers_equal_a_plain_walk(spark, trees):
    tn = table(spark, trees).repartition(3)
    want = {(t, n): v for t, tree in trees.items() for n, v in plain_numbers(tree).items()}
    for limit in (500_000, 12):                                   # in whole trees, and by joins
        got = {(r["tree_index"], r["node_id"]): tuple(r[c] for c in nesting.NUMBERS) for r in
               nesting.nested(tn, kernel_nodes=limit, single_task_rows=50).collect()}
        assert got == want
    assert nesting.nested(tn.limit(0)).count() == 0


def test_bad_links_fail(spark):
    for rows, said in (([(0, 1, 2), (0, 2, 1), (0, 3, None)], "cycle"), ([(0, 1, 9), (0, 2, None)], "not in its tree")):
        tn = spark.createDataFrame(rows, "tree_index long, node_id long, parent_id long")
        with pytest.raises(Exception, match=said):
            nesting.nested(tn).count()
    tn = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 3, None)], "tree_index long, node_id long, parent_id long")
    with pytest.raises(ValueError, match="cycle"):
        nesting.nested(tn, kernel_nodes=1).count()


@given(st.lists(st.tuples(st.integers(0, 5000), st.integers(0, 5000)), min_size=1, max_size=20), st.sampled_from([1, 2, 3, 6]))
@settings(max_examples=15, deadline=None)
def test_ranges_are_covered_once(spark, ranges, levels):
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(ranges)], "k int, a long, b long")
    got = {}
    for r in rows.select("k", F.inline(blocks.cover(F.col("a"), F.col("b"), levels))).collect():
        got.setdefault(r["k"], []).extend(range(r["block"] << 4 * r["level"], (r["block"] + 1) << 4 * r["level"]))
    for k, (a, b) in enumerate(ranges):
        assert sorted(got.get(k, [])) == list(range(a, b))


def test_a_point_has_the_blocks_that_fit(spark):
    rows = spark.createDataFrame([(3, 5), (300, 4096), (300, 4095)], "at long, end long")
    got = [r["h"] for r in rows.select(blocks.holding(F.col("at"), F.col("end")).alias("h")).collect()]
    assert [[tuple(x) for x in h] for h in got] == [[(0, 3)], [(0, 300), (1, 18), (2, 1), (3, 0)], [(0, 300), (1, 18), (2, 1)]]


def test_lineage_of_deep_and_wide_trees(spark, trees):
    tn = table(spark, trees).cache()
    pick = random.Random(4)
    of = [(t, n) for t, tree in trees.items() for n in pick.sample(sorted(tree), min(4, len(tree)))]
    asked = spark.createDataFrame(of + of[:3] + [(0, -7)], "tree_index long, node_id long")
    up = {t: {n: ancestors(tree, n) for n in tree} for t, tree in trees.items()}
    want = {(t, q, n, path.index(q)) for t, q in of for n, path in up[t].items() if q in path and q != n}
    got = [tuple(r)[:4] for r in LIN.descendants(tn, asked).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    tips = {(r[0], r[1], r[2]) for r in LIN.descendants(tn, asked, tips_only=True).collect()}
    inner = {t: set(children(tree)) for t, tree in trees.items()}
    assert tips == {(t, q, n) for t, q, n, _ in want if n not in inner[t]}
    subtree = {(r["tree_index"], r["query_node"], r["node_id"]) for r in LIN.subtree_nodes(tn, asked).collect()}
    assert subtree == {w[:3] for w in want} | {(t, q, q) for t, q in of}
    edges = {tuple(r) for r in LIN.subtree_edges(tn, asked).collect()}
    assert edges == {(t, q, trees[t][n][0], n) for t, q, n, _ in want}
    counts = {(r[0], r[1]): (r[2], r[3]) for r in LIN.descendant_counts(tn).collect()}
    for t, tree in trees.items():
        kids, below = children(tree), {}
        for m in tree:
            for n in up[t][m][1:]:
                all_, tips = below.get(n, (0, 0))
                below[n] = (all_ + 1, tips + (m not in kids))
        for n in kids:
            assert counts.pop((t, n)) == below[n]
    assert not counts


def test_common_ancestors(spark, trees):
    tn = table(spark, trees).cache()
    pick = random.Random(9)
    pairs = [(t, *(pick.choice(sorted(tree)) for _ in "ab")) for t, tree in trees.items() for _ in range(6)]
    asked = spark.createDataFrame(pairs + pairs[:2] + [(0, -1, -2)], "tree_index long, a long, b long")
    got = {tuple(r)[:3]: r["mrca"] for r in nesting.pair_ancestors(tn, asked).collect()}
    assert set(got) == set(pairs)
    for t, a, b in pairs:
        over = set(ancestors(trees[t], b))
        assert got[t, a, b] == next((n for n in ancestors(trees[t], a) if n in over), None)
    groups = {t: pick.sample(sorted(tree), min(len(tree), 3)) for t, tree in trees.items()}
    seeds = spark.createDataFrame([(t, n) for t, own in groups.items() for n in own], "tree_index long, node_id long")
    for oldest in (False, True):
        found = {r["tree_index"]: r["mrca"] for r in LIN.common_ancestor(tn, seeds, oldest).collect()}
        for t, own in groups.items():
            if len(own) > 1:
                shared = set.intersection(*(set(ancestors(trees[t], n)) for n in own))
                end = (max if oldest else min)(shared, key=lambda n: (trees[t][n][1], n), default=None)
                assert found.pop(t) == end
        assert not found
    lost = seeds.unionByName(spark.createDataFrame([(1, -5)], seeds.schema))
    assert {r["tree_index"]: r["mrca"] for r in LIN.common_ancestor(tn, lost).collect()}[1] is None


def test_jobs_do_not_grow_with_depth(spark):
    def jobs(depth):
        tn = table(spark, {0: ladder(depth)})
        spark.sparkContext.setJobGroup(f"depth {depth}", "")
        of = spark.createDataFrame([(0, 1000)], "tree_index long, node_id long")
        tips = tn.where("is_tip").select("tree_index", "node_id")
        assert LIN.descendants(tn, of).count() == 2 * depth - 1
        assert LIN.descendant_counts(tn).agg(F.max("n_tips")).first()[0] == depth
        assert LIN.common_ancestor(tn, tips).first()["mrca"] == 1000
        spark.sparkContext.setJobGroup("others", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"depth {depth}"))

    assert abs(jobs(20) - jobs(3000)) <= 4                        # adaptive plans differ by a broadcast or two


def test_stored_numbers_are_taken(spark, trees):
    """With a numbered table no walk is planned, and no seed meets its ancestors row by row."""
    numbered = nesting.nested(table(spark, trees)).cache()
    numbered.count()
    of = spark.createDataFrame([(30, 1100)], "tree_index long, node_id long")
    for df in (LIN.descendants(numbered, of), LIN.common_ancestor(numbered, of), nesting.pair_ancestors(
            numbered, of.select("tree_index", F.col("node_id").alias("a"), F.col("node_id").alias("b")))):
        text = df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert "CartesianProduct" not in text and "NestedLoop" not in text and "MapInPandas" not in text
    assert LIN.descendants(numbered, of).count() == 2199
