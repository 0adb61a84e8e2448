"""Giant trees with few inner nodes take one pass, not the rounds of joins, and have the numbers of small ones."""

import random

import pytest
from pyspark.sql import functions as F

from copse.operators import layout as LAY, nesting as NEST

SCHEMA = "tree_index long, node_id long, parent_id long, depth long"


@pytest.fixture(scope="module")
def wide(spark):
    """Families of tips and inner nodes mixed, large beside the partitions; isolated roots; a tree of roots only."""
    pick, rows = random.Random(7), []
    for t in range(3):
        inner = [2 ** 52 + 7 * k for k in range(30)]
        rows += [(t, n, None if k < 2 else inner[pick.randrange(k)], 1) for k, n in enumerate(inner)]
        for k in range(900):
            home = pick.choice([None, inner[0], inner[0], inner[3], pick.choice(inner)])
            rows.append((t, 2 ** 52 + 7 * k + 1 + pick.randrange(6), home, 2))
    rows += [(3, k, None, 1) for k in range(50)] + [(4, 1, None, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def refuse(*_):
    raise AssertionError("rounds of joins")


def test_wide_giants_are_laid_out_by_their_inner_nodes(spark, wide, monkeypatch):
    want = {(r.tree_index, r.node_id): r.x for r in LAY.layout_x(wide).collect()}
    monkeypatch.setattr(LAY, "_joined_x", refuse)
    out = LAY.layout_x(wide, kernel_nodes=40)
    assert out.columns == [*wide.columns, "x"]
    assert {(r.tree_index, r.node_id): r.x for r in out.collect()} == want


def test_wide_giants_are_numbered_by_their_inner_nodes(spark, wide, monkeypatch):
    wide = wide.drop("depth")
    want = {tuple(r) for r in NEST.nested(wide).collect()}
    monkeypatch.setattr(NEST, "_by_joins", refuse)
    got = NEST.nested(wide, kernel_nodes=40)
    assert {tuple(r) for r in got.select(*NEST.nested(wide).columns).collect()} == want


def test_bad_links_of_giants_fail(spark):
    rows = [(0, k, 0) for k in range(1, 30)] + [(0, 0, None)]
    for more, said in (([(0, 50, 99)], "not in its tree"), ([(0, 60, 61), (0, 61, 60)], "cycle")):
        tn = spark.createDataFrame(rows + more, "tree_index long, node_id long, parent_id long")
        with pytest.raises(Exception, match=said):
            NEST.nested(tn, kernel_nodes=10).count()
