import pytest
from pyspark.sql import functions as F

from copse.operators import details as DET, metadata as MET


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame(
        [(0, 1, 0.0, 0, 0, '{"name":"alpha","color":"red","group":"B"}'),
         (1, 1, 0.0, 0, None, '{"name":"beta","color":"blue"}'), (2, 0, 2.0, None, None, "{}")],
        "id long, flags long, time double, population long, individual long, metadata_json string")
    individuals = spark.createDataFrame([(0, 0, [1.5, 2.5], [], '{"group":"A","nested":{"a":[1, 2]}}')],
                                        "id long, flags long, location array<double>, "
                                        "parents array<long>, metadata_json string")
    populations = spark.createDataFrame([(0, '{"region":"north"}')], "id long, metadata_json string")
    return nodes, individuals, populations


def test_first_source_with_the_key_wins(small):
    s = MET.samples_with_metadata(*small)
    hit = lambda key, value, **kw: [r.node_id for r in MET.search_samples(s, key, value, **kw).collect()]
    assert hit("group", "A") == [0] and hit("group", "B") == []
    assert hit("group", "B", sources=("node", "individual")) == [0]
    assert sorted(hit("region", "north")) == [0, 1]
    assert hit("sample", "beta") == [1]
    assert hit("nested", '{"a":[1,2]}') == [0]
    with pytest.raises(ValueError):
        MET.value_of("x", ["elsewhere"])
    index = MET.name_index(s)
    assert [r.node_id for r in MET.names_containing(index, "ALP").collect()] == [0]
    rows = MET.metadata_rows(s)
    assert {(r.node_id, r.value) for r in MET.values_from_rows(rows, "group").collect()} == {(0, "A")}


def test_keys(small):
    keys = MET.metadata_keys(*small)
    assert {(r.source, r.key) for r in keys.collect()} == {
        ("individual", "group"), ("individual", "nested"), ("node", "name"), ("node", "color"),
        ("node", "group"), ("population", "region")}
    menu = [r.key for r in MET.key_menu(keys).orderBy("rank").collect()]
    assert menu == ["sample", "color", "group", "name", "nested", "region"]
    one = MET.metadata_keys(*small, sample_rows=1)
    assert {r.key for r in one.where("source = 'node'").collect()} == {"name", "color", "group"}


@pytest.fixture(scope="module")
def groups(spark):
    meta = ['{"group":"A"}', '{"group":"A"}', '{"group":2}', "{}", '{"group":""}', '{"group":null}']
    nodes = spark.createDataFrame([(i, 1, 0.0, None, None, m) for i, m in enumerate(meta)],
                                  "id long, flags long, time double, population long, "
                                  "individual long, metadata_json string")
    none = spark.createDataFrame([], "id long, metadata_json string")
    return MET.sample_values(MET.samples_with_metadata(nodes, none, none), "group")


def test_missing_is_not_empty(spark, groups):
    lists = {r.value: r.node_ids for r in MET.posting_lists(groups).collect()}
    assert lists == {"A": [0, 1], "2": [2], "": [4]}
    wanted = spark.createDataFrame([("A",), ("2",), ("",), ("missing",), ("A",)], "value string")
    hits = MET.multi_value_hits(groups, wanted)
    counts = {r.value: r.n for r in hits.groupBy("value").agg(F.count("node_id").alias("n")).collect()}
    assert counts == {"A": 2, "2": 1, "": 1, "missing": 0}
    codes = {r.node_id: (r.value, r.code) for r in MET.encode(groups).collect()}
    assert codes == {0: ("A", 0), 1: ("A", 0), 2: ("2", 1), 3: ("", 2), 4: ("", 2), 5: ("", 2)}


def test_lists_are_cut_into_chunks(spark):
    values = spark.range(1000).selectExpr("id node_id", "'hot' value")
    lists = MET.posting_lists(values, chunk=64).collect()
    assert len(lists) == 16 and sum(r.n for r in lists) == 1000
    assert max(len(r.node_ids) for r in lists) == 64


def test_later_node_wins_a_name(spark):
    index = spark.createDataFrame([("x", "X", 1), ("x", "x", 5), ("y", "Y", 2)],
                                  "normalized_name string, display_name string, node_id long")
    asked = spark.createDataFrame([("X", "red"), ("q", "blue")], "name string, color string")
    assert [tuple(r) for r in MET.find_names(index, asked).collect()] == [("X", "red", 5)]


def test_labels_and_value_filter(spark, groups):
    tips = spark.range(4).selectExpr("id node_id")
    on = spark.createDataFrame([("A",)], "value string")
    got = {r.node_id: r.label for r in MET.tip_labels(tips, groups, on, "grey").collect()}
    assert got == {0: "A", 1: "A", 2: "grey", 3: "grey"}
    everything = {r.label for r in MET.tip_labels(tips, groups).collect()}
    assert everything == {"A", "2", "other"}
    assert [r.value for r in MET.values_matching(groups, " a ").collect()] == ["A"]
    assert MET.values_matching(groups, "  ").count() == 3


def test_records(small):
    nodes, individuals, populations = small
    r = DET.individual_records(individuals, nodes).first()
    assert (r.id, r.nodes, r.location, r.parents) == (0, [0], [1.5, 2.5], [])
    d = DET.one(DET.node_details(nodes, individuals, populations), 0).first()
    assert d.individual_meta["group"] == "A" and d.population_meta["region"] == "north"
    assert DET.one(DET.node_details(nodes, individuals, populations), 2).first().population is None


def test_names_and_individuals_are_not_broadcast(spark):
    """Small by the size of their files, and as many as the samples."""
    ids = spark.range(20)
    meta = F.lit('{"name":"a"}').alias("metadata_json")
    nodes = ids.select("id", F.lit(1).cast("long").alias("flags"), F.col("id").alias("individual"),
                       F.lit(0).cast("long").alias("population"), meta)
    individuals, populations = ids.select("id", meta), spark.range(0).select("id", meta)
    samples = MET.samples_with_metadata(nodes, individuals, populations.limit(0))
    names = MET.find_names(samples.select(F.col("name").alias("display_name"), F.lower("name").alias("normalized_name"), "node_id"),
                           ids.select(F.lit("A").alias("name")))
    plan = names._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in joins if "individual" in line or "normalized_name" in line]
    assert {r.node_id for r in names.collect()} == {19}
