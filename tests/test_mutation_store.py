"""Pages from stored blocks against plain sorting, and what a page reads."""

import random

import pytest
from pyspark.sql import functions as F

from copse.operators import mutations as MUT
from copse.sources import mutation_store as STORE

LENGTH = 1000.0


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    pick = random.Random(11)
    rows = [(k, float(pick.choice([pick.randint(0, 999), 500, 501])), pick.choice([7, pick.randint(0, 40)]), "G") for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, position double, node_id long, derived_state string")
    path = f"{tmp_path_factory.mktemp('store')}/m"
    STORE.write_store(df, path, block_rows=100)
    return rows, df, STORE.open_store(spark, path), path


def ids(df):
    return [r["id"] for r in df.collect()]


def test_borders(made):
    rows, _, store, _ = made
    assert store.blocks.count() == 30 and store.blocks.agg(F.sum("n")).first()[0] == 3000
    for at in (-5.0, 0.0, 17.0, 499.5, 500.0, 501.0, 502.0, 999.0, 2000.0):
        assert STORE.rows_before(store, at) == sum(r[1] < at for r in rows)
        assert STORE.rows_through(store, at, 1500) == sum((r[1], r[0]) <= (at, 1500) for r in rows)


def test_pages_of_a_window(made):
    rows, _, store, _ = made
    inside = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0])) if 300 <= r[1] < 700]
    for offset, limit in ((0, 10), (95, 210), (1500, 50), (len(inside) - 5, 50), (len(inside), 5), (0, 10 ** 6)):
        assert ids(STORE.window_page(store, 300, 700, offset, limit)) == inside[offset:offset + limit]
        assert tuple(STORE.window_summary(store, 300, 700, offset, limit).first()) == (len(inside), offset + limit < len(inside))
    key, seen = None, []
    while True:                                             # page after page by key
        page = STORE.window_page(store, 300, 700, limit=700, after=key).collect()
        if not page:
            break
        seen += [r["id"] for r in page]
        key = (page[-1]["position"], page[-1]["id"])
    assert seen == inside
    assert ids(STORE.window_page(store, 2000, 3000)) == [] == ids(STORE.window_page(store, 5, 5))


@pytest.mark.parametrize("at, span", [(500.0, 100), (500.5, 7), (0.0, 40), (999.0, 90), (250.0, 5000)])
def test_nearest_first(made, at, span):
    rows, df, store, _ = made
    for offset, limit in ((0, 5), (3, 40), (700, 300), (5000, 10)):
        want = ids(MUT.near_page(df, at, span, LENGTH, offset, limit))
        assert ids(STORE.near_page(store, at, span, LENGTH, offset, limit)) == want


def test_one_node(made, monkeypatch):
    rows, _, store, _ = made
    for listed in (512, 1):
        monkeypatch.setattr(STORE, "LISTED_BLOCKS", listed)
        for node, bounds in ((7, (None, None)), (3, (None, None)), (3, (100, 400)), (7, (500, 501)), (99, (None, None))):
            want = sorted(r[0] for r in rows if r[2] == node and (bounds[0] is None or bounds[0] <= r[1] < bounds[1]))
            assert sorted(ids(STORE.on_node(store, node, *bounds))) == want


def test_a_page_reads_its_blocks(made, spark):
    """Folder and block bounds reach the scan, and the rows scanned are those of the blocks met."""
    _, _, store, path = made
    page = STORE.window_page(store, 0, 1000, 2345, 20)
    text = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block,23)" in text and "LessThanOrEqual(block,23)" in text
    assert "folder" in text.split("PartitionFilters")[1][:120]
    node = STORE.on_node(store, 3, 100, 110)
    assert "EqualTo(node_id,3)" in node._jdf.queryExecution().executedPlan().toString()


def test_empty_and_single_block(spark, tmp_path):
    none = spark.createDataFrame([], "id long, position double, node_id long")
    STORE.write_store(none, f"{tmp_path}/none")
    empty = STORE.open_store(spark, f"{tmp_path}/none")
    assert ids(STORE.window_page(empty, 0, 10)) == [] == ids(STORE.on_node(empty, 2))
    one = spark.createDataFrame([(1, 5.0, 2), (2, 5.0, None)], none.schema)
    STORE.write_store(one, f"{tmp_path}/one")
    store = STORE.open_store(spark, f"{tmp_path}/one")
    assert ids(STORE.window_page(store, 0, 10)) == [1, 2] and ids(STORE.window_page(store, 0, 10, after=(5.0, 1))) == [2]
    assert ids(STORE.on_node(store, 2)) == [1]
