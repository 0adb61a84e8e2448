import pytest
from pyspark.sql import functions as F

from copse.plans import requests as R
from copse.schemas import LAYOUT_MUTATIONS, LAYOUT_NODES, MUTATION_RESULT
from copse.sources import bed, sinks, summary, tables
from copse.streaming import landing
from workload.collection import orders_collection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def orders(spark):
    return orders_collection(spark, SF)


def test_tables_round_trip(spark, two_trees, tmp_path):
    for name in tables.REQUIRED:
        df = getattr(two_trees, name)
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    loaded = tables.load_tables(spark, str(tmp_path))
    assert loaded["edges"].count() == 5 and loaded["mutations"].columns[-1] == "metadata_json"
    report = tables.integrity_report(loaded["nodes"], loaded["edges"], loaded["sites"],
                                     loaded["mutations"], two_trees.intervals)
    assert {r.n_bad for r in report.collect()} == {0}
    broken = tables.integrity_report(loaded["nodes"].where("id <> 4"), loaded["edges"],
                                     loaded["sites"], loaded["mutations"], two_trees.intervals)
    assert {r.check: r.n_bad for r in broken.collect()}["edge parent in nodes"] == 2


def test_csv_lists_order_and_refusals(spark, tmp_path):
    (tmp_path / "individuals.csv").write_text(
        'metadata_json,id,location,parents\n"{""a"":""x,y""}",1,"[0.1,-2.5]","[3,4]"\n,2,,[]\n')
    rows = tables.load_table(spark, str(tmp_path), "individuals", "csv").orderBy("id").collect()
    assert (rows[0].location, rows[0].parents, rows[0].metadata_json, rows[0].flags) == (
        [0.1, -2.5], [3, 4], '{"a":"x,y"}', None)
    assert (rows[1].location, rows[1].parents, rows[1].metadata_json) == (None, [], None)
    for bad in ("id,location\n1,nowhere\n", "id,location\none,\n"):
        (tmp_path / "individuals.csv").write_text(bad)
        with pytest.raises(Exception, match="(?i)malformed|id is not bigint"):
            tables.load_table(spark, str(tmp_path), "individuals", "csv").collect()
    (tmp_path / "edges.csv").write_text("id,left,right,parent\n1,0,1,2\n")
    with pytest.raises(ValueError, match="child"):
        tables.load_table(spark, str(tmp_path), "edges", "csv")


def test_saved_tables_come_back(spark, two_trees, tmp_path):
    log = spark.createDataFrame([(1, "now", '{"software":"a, b"}')], "id long, timestamp string, record string")
    kept = {name: getattr(two_trees, name) for name in tables.REQUIRED} | {"provenances": log}
    for fmt in tables.FORMATS:
        tables.save_tables(kept, str(tmp_path), fmt)
        loaded = tables.load_tables(spark, str(tmp_path), fmt, [*tables.REQUIRED, "provenances"])
        for name, table in kept.items():
            held = [c for c in loaded[name].columns if c in table.columns]
            assert sorted(map(str, loaded[name].select(held).collect())) == sorted(map(str, table.select(held).collect()))
    with pytest.raises(ValueError):
        tables.save_tables(kept, str(tmp_path), "xml")


def test_csv_tables_and_sentinels(spark, tmp_path):
    (tmp_path / "nodes.csv").write_text(
        'id,flags,time,population,individual,metadata_json\n0,1,0.5,-1,3,"{""a"":1}"\n1,0,NaN,0,-1,\n')
    rows = tables.load_table(spark, str(tmp_path), "nodes", "csv").orderBy("id").collect()
    assert (rows[0].population, rows[0].individual, rows[0].metadata_json) == (None, 3, '{"a":1}')
    assert (rows[1].time, rows[1].population, rows[1].individual) == (None, 0, None)
    with pytest.raises(ValueError):
        tables.load_table(spark, str(tmp_path), "nodes", "xml")


def test_persisted_genealogies_are_pruned(spark, orders, tmp_path):
    path = str(tmp_path / "trees")
    placed = R.placed_nodes(orders)
    sinks.write_genealogies(sinks.genealogy_rows(placed, orders.intervals, 64), path, 10)
    some = sinks.read_genealogies(spark, path, [3, 42], 10)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tree_folder" in plan or "tree_folder#" in plan
    assert "In(tree_index" in plan
    nodes = some.select("tree_index", F.explode("node_ids").alias("node_id"))
    want = placed.where("tree_index in (3, 42)").select("tree_index", "node_id")
    assert nodes.exceptAll(want).isEmpty() and want.exceptAll(nodes).isEmpty()
    whole = sinks.read_genealogies(spark, path)
    assert whole.select("tree_index").distinct().count() == orders.loc.n_trees


def test_other_sinks(spark, orders, tmp_path):
    muts = R.located_mutations(orders, bounds=True)
    sinks.write_by_position(muts, str(tmp_path / "m"))
    window = spark.read.parquet(str(tmp_path / "m")).where("position >= 1500 and position < 1600")
    assert "PushedFilters: [IsNotNull(position), GreaterThanOrEqual(position,1500.0)" in \
        window._jdf.queryExecution().executedPlan().toString()
    assert window.count() == muts.where("position >= 1500 and position < 1600").count()
    sinks.write_by_node(muts, str(tmp_path / "n"))
    sinks.write_dimension(sinks.dimension_rows(orders.nodes), str(tmp_path / "nodes"))
    assert spark.read.parquet(str(tmp_path / "nodes")).where("population = -1").count() == 32
    rows = orders.intervals.selectExpr("concat('chr', tree_index % 2) chrom", "left genomic_positions")
    sinks.write_per_chromosome(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/chrom=chr1")).count() == 40


def test_boundary_schemas(spark, two_trees):
    out = R.layout_tables(R.layout_request(two_trees, thin=False))
    assert out.nodes.schema == LAYOUT_NODES or [
        (f.name, f.dataType) for f in out.nodes.schema] == [(f.name, f.dataType) for f in LAYOUT_NODES]
    assert [(f.name, f.dataType) for f in out.mutations.schema] == [
        (f.name, f.dataType) for f in LAYOUT_MUTATIONS]
    assert out.nodes.count() == 10 and out.mutations.count() == 2
    one = R.layout_request(two_trees, [1])
    assert {r.tree_index for r in one.nodes.collect()} == {1} and one.mutations.isEmpty()
    assert sinks.empty(spark, MUTATION_RESULT).isEmpty()


def test_bed(two_trees):
    from copse.operators import trees as T
    stats = T.tree_statistics(two_trees.runs(), two_trees.loc)
    got = [r.value for r in bed.lines(bed.tree_bed(stats, "total_branch_length")).collect()]
    assert sorted(got) == ["chr1\t0\t10\ttree_0\t714\t.\t0\t10\t182,182,182",
                           "chr1\t10\t20\ttree_1\t1000\t.\t10\t20\t255,255,255"]
    short = [r.value for r in bed.lines(bed.tree_bed(stats), 3).collect()]
    assert sorted(short) == ["chr1\t0\t10", "chr1\t10\t20"]
    sites = bed.lines(bed.site_bed(two_trees.sites, two_trees.mutations)).collect()
    assert [r.value for r in sites] == ["chr1\t4\t5\tpos4:A/G\t0\t.\t4\t5\t0,0,0"]


def test_summary_and_provenance(spark, two_trees):
    row = R.describe(two_trees).first()
    assert (row.n_trees, row.n_samples, row.n_edges, row.max_time) == (2, 3, 5, 50.0)
    prov = spark.createDataFrame(
        [(0, "t0", '{"software":{"name":"sim","version":"1.2"}}'), (1, "t1", "plain text"),
         (2, "t2", '{"software":"tool"}')], "id long, timestamp string, record string")
    got = {r.id: (r.record_is_json, r.software, r.software_version)
           for r in summary.provenance_records(prov).collect()}
    assert got == {0: (True, "sim", "1.2"), 1: (False, None, None), 2: (True, "tool", None)}
    last = summary.provenance_summary(prov).first()
    assert (last.n_records, last.latest_id, last.software) == (3, 2, "tool")
    safe = spark.createDataFrame([('{"a": [1, 2]}',), ('say "hi"',), ("",)], "m string").select(
        summary.json_safe(F.col("m")).alias("s")).collect()
    assert [r.s for r in safe] == ['{"a":[1,2]}', '"say \\"hi\\""', None]


def test_files_that_arrive_are_appended_once(spark, two_trees, tmp_path):
    inbox, table = str(tmp_path / "inbox"), str(tmp_path / "table")
    edges = two_trees.edges.select("id", "left", "right", "parent", "child").coalesce(1)
    edges.where("id < 3").write.mode("append").parquet(inbox)
    for batch in range(3):
        landing.append_table(landing.landing_stream(spark, inbox, "edges"), table, "edges",
                             str(tmp_path / "offsets")).awaitTermination()
        assert spark.read.parquet(table).count() == (3 if batch == 0 else 5)
        if batch == 0:
            edges.where("id >= 3").write.mode("append").parquet(inbox)


def test_requests_over_orders(spark, orders):
    names = spark.createDataFrame([("customer#000000007", "red"), ("nobody", "blue")],
                                  "name string, color string")
    hits = R.search_names(orders, names, [10, 40, 80])
    assert {r.tree_index for r in hits.collect()} <= {10, 40, 80}
    steps = R.name_lineages(orders, names, [10, 40, 80]).collect()
    assert {r.color for r in steps} == {"red"}
    lit = R.highlight(orders, "segment", "building", [40]).collect()
    assert lit and {r.tree_index for r in lit} == {40}


def test_a_table_without_a_needed_column_is_refused(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "parent long, child long").write.parquet(f"{tmp_path}/edges.parquet")
    with pytest.raises(ValueError, match="'edges' lacks left, right"):
        tables.load_table(spark, str(tmp_path), "edges")
