"""Large tables stay where they are when what they meet has few rows; results do not depend on that."""

import pytest
from pyspark.sql import functions as F

from copse.operators import layout as LAY, lineage as LIN, mutations as MUT, skew, thinning as THN
from copse.session import written

KEY = ["tree_index", "node_id"]


@pytest.fixture
def no_guess(spark):
    """Spark broadcasts what it is told to only, as for large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def placed(spark):
    rows = []
    for t in range(3):
        rows += [(t, 999, None, 2.0, 4)] + [(t, 900 + k, 999, 1.0, 60) for k in range(4)]
        rows += [(t, k, 900 + k % 4, 0.0, 0) for k in range(240)]
    tn = spark.createDataFrame(rows, "tree_index long, node_id long, parent_id long, time double, n_children long")
    tn = tn.withColumn("is_tip", F.col("n_children") == 0)
    return written(LAY.layout(tn, tn.agg(F.min("time").alias("t_min"), F.max("time").alias("t_max"))), "placed")


def joins(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df) -> set:
    return {tuple(r) for r in df.collect()}


def test_giant_trees_are_parted_from_the_others_without_a_shuffle(spark, placed, no_guess):
    plan = joins(LAY.layout_x(placed.drop("x", "y"), kernel_nodes=100, giants=LAY.giant_trees(
        placed.where("tree_index < 2").groupBy("tree_index").agg(F.count("*").alias("n_nodes")), 100)))
    assert [line for line in plan.splitlines() if "LeftAnti" in line and "BroadcastHashJoin" in line]
    assert "SortMergeJoin" not in "".join(line for line in plan.splitlines() if "LeftAnti" in line)


def test_thinning_shuffles_no_placed_nodes(spark, placed, no_guess, monkeypatch):
    kept, cells = THN.kept_nodes(placed, cell=0.05), THN.edge_cells(placed, cell=0.05)
    assert "SortMergeJoin" not in joins(kept) and "SortMergeJoin" not in joins(cells)
    monkeypatch.setattr(skew, "FEW_ROWS", 0)
    again = THN.kept_nodes(placed, cell=0.05)
    assert "SortMergeJoin" in joins(again) and rows(again) == rows(kept.select(*again.columns))
    assert rows(THN.edge_cells(placed, cell=0.05).select(*cells.columns)) == rows(cells)


def test_mutations_of_shown_nodes_meet_those_only(spark, placed, no_guess):
    muts = spark.createDataFrame([(t, 1000 * t + n, n, None if n % 2 else 0.5) for t in range(3) for n in range(0, 240, 3)],
                                 "tree_index long, mutation_id long, node_id long, time double")
    span = placed.agg(F.min("time").alias("t_min"), F.max("time").alias("t_max"))
    shown = placed.where("node_id % 5 = 0 AND tree_index <> 1").select(*KEY)
    got = MUT.place(muts, placed, span, only=shown)
    assert "SortMergeJoin" not in joins(got)
    want = THN.on_kept_nodes(MUT.place(muts, placed, span), shown)
    assert rows(got) == rows(want.select(*got.columns)) and got.count() == 32


def test_seeds_by_a_condition_are_those_of_the_table(spark, placed, no_guess, monkeypatch):
    table, tip = placed.where("is_tip").select(*KEY), F.col("is_tip")
    assert rows(LIN.ancestor_pairs(placed, tip)) == rows(LIN.ancestor_pairs(placed, table))
    paths = LIN.lineage_paths(placed, tip)
    assert "BroadcastHashJoin" in joins(paths)
    text = F.col("path_node_ids").cast("string")
    want = rows(paths.select(*[c for c in paths.columns if c != "path_node_ids"], text))
    monkeypatch.setattr(skew, "FEW_ROWS", 0)
    assert rows(LIN.lineage_paths(placed, table).select("tree_index", "seed", text)) == want


def test_runs_of_few_nodes_are_not_brought_together_by_node(two_trees, no_guess):
    for isolated in (True, False):
        plan = joins(two_trees.runs(isolated))
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
