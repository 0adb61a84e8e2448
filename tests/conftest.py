import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from copse.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def two_trees(spark):
    """Two recombining trees with several roots over [0, 20)."""
    from copse.plans.collection import open_collection
    nodes = spark.createDataFrame(
        [(0, 1, 0.0), (1, 0, 50.0), (2, 1, 0.0), (3, 0, 1.0), (4, 0, 2.0), (5, 0, 3.0), (6, 1, 0.0)],
        "id long, flags long, time double").selectExpr(
        "*", "cast(null as long) population", "cast(null as long) individual",
        "'{}' metadata_json")
    edges = spark.createDataFrame(
        [(0, 0.0, 10.0, 3, 0), (1, 0.0, 10.0, 3, 2), (2, 10.0, 20.0, 4, 0), (3, 10.0, 20.0, 4, 2),
         (4, 0.0, 20.0, 5, 6)], "id long, left double, right double, parent long, child long")
    sites = spark.createDataFrame([(0, 4.0, "A")], "id long, position double, ancestral_state string")
    muts = spark.createDataFrame(
        [(0, 0, 0, None, None, "G"), (1, 0, 0, 0, 0.5, "T")],
        "id long, site_id long, node_id long, parent_id long, time double, derived_state string")
    empty = spark.createDataFrame([], "id long, flags long, location array<double>, "
                                      "parents array<long>, metadata_json string")
    pops = spark.createDataFrame([], "id long, metadata_json string")
    return open_collection(nodes, edges, sites, muts, empty, pops, 20.0)
