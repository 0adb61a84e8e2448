"""Differences of any two trees, and trees of some nodes, against plain sets."""

import random

from copse.operators import compare as CMP, metadata as MET

N_TREES = 60


def _spans(seed):
    """Edges as runs over 60 trees, some of them cut in two without a gap."""
    pick, rows = random.Random(seed), []
    for child in range(40):
        at = pick.randint(0, 20)
        while at < N_TREES:
            end = min(N_TREES, at + pick.randint(1, 25))
            rows.append((child, 100 + pick.randint(0, 2), at, end))
            at = end + pick.choice([0, 0, 3])
    return rows


def test_pair_differences_equal_set_differences(spark):
    rows = _spans(3)
    spans = spark.createDataFrame(rows, "child long, parent long, first_tree long, last_tree long")
    held = [{(p, c) for c, p, a, b in rows if a <= t < b} for t in range(N_TREES)]
    pick = random.Random(8)
    asked = [(k, pick.randrange(N_TREES), pick.randrange(N_TREES)) for k in range(40)] + [(90, 5, 5), (91, 0, 59), (92, 59, 0), (93, 0, 59)]
    pairs = spark.createDataFrame(asked, "pair long, prev_tree long, next_tree long")
    got = {tuple(r) for r in CMP.pair_differences(spans, pairs, N_TREES).collect()}
    want = {(k, a, b, change, p, c) for k, a, b in asked for change, edges in (
        ("removed", held[a] - held[b]), ("inserted", held[b] - held[a])) for p, c in edges}
    assert got == want
    exploded = spark.createDataFrame([(t, p, c) for t, own in enumerate(held) for p, c in own], "tree_index long, parent long, child long")
    assert {tuple(r) for r in CMP.edge_differences(exploded, pairs.where("pair <> 90")).collect()} == want
    assert CMP.pair_differences(spans.limit(0), pairs, N_TREES).count() == 0
    chain = spark.createDataFrame([(0, 7), (1, 3), (2, 3)], "pos long, tree_index long")
    assert {tuple(r) for r in CMP.pairs_of(chain).collect()} == {(0, 7, 3), (1, 3, 3)}


def test_trees_of_nodes(spark):
    rows = [(c, a, b) for c, _, a, b in _spans(5)]
    ranges = spark.createDataFrame(rows, "node_id long, first_tree long, last_tree long")
    hits = spark.createDataFrame([(3,), (3,), (17,), (777,)], "node_id long")
    trees = spark.createDataFrame([(t,) for t in [*range(0, N_TREES, 2), 4, 900]], "tree_index long")
    want = [t for t in [*range(0, N_TREES, 2), 4, 900] if any(n in (3, 17) and a <= t < b for n, a, b in rows)]
    df = MET.trees_of_nodes(ranges, hits, trees)
    assert sorted(r[0] for r in df.collect()) == sorted(want)
    assert MET.trees_of_nodes(ranges, hits.where("node_id = 777"), trees).count() == 0
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_long_runs_become_few_blocks(spark):
    """A run over ten million trees costs some dozens of rows."""
    ranges = spark.createDataFrame([(1, 3, 10_000_003)], "node_id long, first_tree long, last_tree long")
    trees = spark.createDataFrame([(2,), (3,), (9_999_999,), (10_000_002,), (10_000_003,)], "tree_index long")
    hits = ranges.select("node_id")
    assert sorted(r[0] for r in MET.trees_of_nodes(ranges, hits, trees).collect()) == [3, 9_999_999, 10_000_002]
    from pyspark.sql import functions as F

    from copse.operators.blocks import cover
    assert ranges.select(F.inline(cover(F.col("first_tree"), F.col("last_tree")))).count() < 150


def test_tasks_of_pair_differences_grow_in_number_not_in_size(spark, monkeypatch):
    spans = spark.createDataFrame(_spans(5), "child long, parent long, first_tree long, last_tree long")
    pairs = spark.createDataFrame([(t, t, N_TREES - 1 - t) for t in range(N_TREES)], "pair long, prev_tree long, next_tree long")
    whole = {tuple(r) for r in CMP.pair_differences(spans, pairs, N_TREES).collect()}
    monkeypatch.setattr(CMP, "TASK_ROWS", 600)
    parted = CMP.pair_differences(spans, pairs, N_TREES)
    assert parted.rdd.getNumPartitions() > 4 and {tuple(r) for r in parted.collect()} == whole
    monkeypatch.setattr(CMP, "TASK_ROWS", 10)                           # an edge alone has more: left as it was
    assert {tuple(r) for r in CMP.pair_differences(spans, pairs, N_TREES).collect()} == whole
