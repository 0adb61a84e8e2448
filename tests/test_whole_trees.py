"""Trees stay whole although adaptive plans part the large partitions of a join."""

import pytest
from pyspark.sql import functions as F

from copse.operators import layout as LAY, lineage as LIN, nesting, skew
from copse.session import written

PARTED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
          "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
          "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1", "spark.sql.files.maxPartitionBytes": "8k"}


@pytest.fixture
def parted(spark, monkeypatch):
    """Joins are shuffled, and partitions of a few KB are parted."""
    for key, value in PARTED.items():
        spark.conf.set(key, value)
    monkeypatch.setattr(skew, "FEW_ROWS", 0)
    yield
    for key in PARTED:
        spark.conf.unset(key)


@pytest.fixture(scope="module")
def tn(spark):
    """A tree of 3000 nodes, below a root and 20 others, and small ones."""
    nodes = F.col("id")
    large = spark.range(3000).select(F.lit(0).cast("long").alias("tree_index"), nodes.alias("node_id"), F.when(
        nodes > 20, nodes % 20 + 1).when(nodes > 0, 0).cast("long").alias("parent_id"))
    small = spark.range(24).select((nodes % 8 + 1).alias("tree_index"), F.floor(nodes / 8).alias("node_id"),
                                   F.when(nodes >= 8, 0).cast("long").alias("parent_id"))
    rows = large.unionByName(small).withColumns({"n_children": F.expr(
        "CASE WHEN tree_index > 0 THEN IF(node_id = 0, 2, 0) WHEN node_id = 0 THEN 20 WHEN node_id <= 20 THEN 149 ELSE 0 END").cast("long"),
        "time": -F.col("node_id").cast("double")})
    return written(rows.withColumn("is_tip", F.col("n_children") == 0).repartition(12), "tn")


def test_common_ancestor(tn, parted):
    seeds = tn.where("node_id > 0").select("tree_index", "node_id")
    got = {r["tree_index"]: r["mrca"] for r in LIN.common_ancestor(tn, seeds).collect()}
    assert got == {t: 0 for t in range(9)}


def test_numbers_and_layout_of_some_trees(spark, tn, parted):
    trees = spark.createDataFrame([(t,) for t in range(0, 9, 2)], "tree_index long")
    some, giants = tn.join(trees, "tree_index", "left_semi"), trees.limit(0)
    numbers = nesting.nested(some, giants).groupBy("tree_index").agg(F.max("leave"), F.max("depth"), F.count_distinct("enter"))
    assert {tuple(r) for r in numbers.collect()} == {(0, 3000, 2, 3000)} | {(t, 3, 1, 3) for t in (2, 4, 6, 8)}
    placed = LAY.layout_x(some, giants=giants).where("is_tip").groupBy("tree_index").agg(F.count_distinct("x"), F.min("x"), F.max("x"))
    assert {tuple(r) for r in placed.collect()} == {(0, 2979, 0.0, 1.0)} | {(t, 2, 0.0, 1.0) for t in (2, 4, 6, 8)}
