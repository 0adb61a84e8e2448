"""Every operator as a query over whole derived collections, with its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from copse.functions import coordinates as C, json as J, text as X
from copse.operators import (compare as CMP, details as DET, intervals as I, layout as LAY,
                             lineage as LIN, metadata as MET, mutations as MUT, nesting as NEST, thinning as THN,
                             topology as TOP, trees as T)
from copse.plans import requests as R
from copse.plans.collection import Collection
from copse.session import checkpoint_dir, cut
from copse.sources import bed, genealogies as GEN, mutation_store as STORE, newick as N, sinks, summary, tables
from copse.streaming import landing
from workload import newick as ON, oracle as O
from workload.collection import LENGTH, orders_collection
from workload import ladders as LD, lines as LN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

START, END = 1500.0, 2500.0          # genome window of the range requests
BP, ZOOM = 20_000.0, 400_000.0       # bp per unit, and after zooming out
BOX = THN.Box(40, 0.2, 0.7, 0.3, 1.0)


def query(name: str, sql: str | None = None):
    """Register a query over the order collection."""
    def add(build: Callable[[Collection], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(orders_collection(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return build
    return add


def raw_query(name: str, sql: str | None = None):
    """Register a query over the session and folder."""
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql
        return build
    return add


def num(c, digits: int = 6) -> Column:
    """Rounded double for comparison."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def txt(c) -> Column:
    """Array as comma-joined text."""
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


# ---- sources, sinks, summaries -------------------------------------------

@query("src06_pick_trees", O.trees("""
    , req AS (SELECT (max(tree_index) OVER () - tree_index)::INT AS request_pos, tree_index FROM iv
              UNION ALL SELECT (SELECT count(*) FROM iv)::INT, 0)
    SELECT request_pos, tree_index, node_id, coalesce(parent_id, -1) AS parent_id FROM req JOIN tna USING (tree_index)
    """))
def _(c):
    n = c.loc.n_trees
    picked = T.pick_trees(c.tree_nodes(), [*range(n - 1, -1, -1), 0, n + 5], n)
    return picked.select("request_pos", "tree_index", "node_id",
                         C.sentinels(F.col("parent_id")).alias("parent_id"))


@query("src06_requested_trees", O.trees("""
    , req AS (SELECT 0 AS request_pos, max(tree_index) AS tree_index FROM iv UNION ALL SELECT 1, 0 UNION ALL SELECT 2, 0
              UNION ALL SELECT 4, max(tree_index) // 2 FROM iv)
    SELECT request_pos, tree_index, node_id, coalesce(parent_id, -1) AS parent_id FROM req JOIN tna USING (tree_index)
    """))
def _(c):
    n = c.loc.n_trees
    return R.requested_trees(c, [n - 1, 0, 0, n + 5, (n - 1) // 2]).select(
        "request_pos", "tree_index", "node_id", C.sentinels(F.col("parent_id")).alias("parent_id"))


@query("sum01_summary", O.trees("""
    SELECT 4000.0::DOUBLE AS sequence_length, min(time) AS min_time, max(time) AS max_time,
      count(*) FILTER (flags = 1) AS n_samples, count(*) AS n_nodes,
      (SELECT count(*) FROM iv) AS n_trees, (SELECT count(*) FROM edges) AS n_edges,
      (SELECT count(*) FROM sites) AS n_sites, (SELECT count(*) FROM mutations) AS n_mutations,
      (SELECT count(*) FROM individuals) AS n_individuals,
      (SELECT count(*) FROM populations) AS n_populations FROM nodes""", O.MUTS, O.META))
def _(c):
    return R.describe(c)


def _provenances(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind, ident = F.col("event_type"), F.col("event_id")
    nested = F.concat(F.lit('{"software":{"name":"'), kind, F.lit('","version":"'),
                      (ident % 10).cast("string"), F.lit('"}}'))
    plain = F.concat(F.lit('{"software":"'), kind, F.lit('"}'))
    record = (F.when(ident % 4 == 0, nested).when(ident % 4 == 1, plain)
              .when(ident % 4 == 2, F.col("props")).otherwise(F.concat(F.lit("ran "), kind)))
    return e.select(ident.alias("id"), F.col("user_id").cast("string").alias("timestamp"),
                    record.alias("record"))


PROV = """
prov AS (SELECT event_id AS id, user_id::VARCHAR AS ts, event_id % 4 <> 3 AS record_is_json,
  CASE WHEN event_id % 4 IN (0, 1) THEN event_type END AS software,
  CASE WHEN event_id % 4 = 0 THEN (event_id % 10)::VARCHAR END AS software_version FROM events)
"""


@raw_query("sum03_provenance_records", O.sql(
    "SELECT id, ts, record_is_json, software, software_version FROM prov", PROV))
def _(spark, sf_dir):
    return summary.provenance_records(_provenances(spark, sf_dir)).select(
        "id", F.col("timestamp").alias("ts"), "record_is_json", "software", "software_version")


@raw_query("sum03_provenance_summary", O.sql("""
    SELECT count(*) AS n_records, count(*) FILTER (record_is_json) AS n_json, max(id) AS latest_id,
           arg_max(ts, id) AS latest_timestamp, arg_max(coalesce(software, '-'), id) AS software,
           arg_max(coalesce(software_version, '-'), id) AS software_version FROM prov""", PROV))
def _(spark, sf_dir):
    return summary.provenance_summary(_provenances(spark, sf_dir)).select(
        "n_records", "n_json", "latest_id", "latest_timestamp",
        F.coalesce("software", F.lit("-")).alias("software"),
        F.coalesce("software_version", F.lit("-")).alias("software_version"))


@raw_query("sum04_json_safe", """
    SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN '"' || event_type || '"'
           ELSE replace(props, ' ', '') END AS value FROM events""")
def _(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("props"))
    return e.select(F.col("event_id").alias("id"), summary.json_safe(text).alias("value"))


def _integrity(nodes: str, edges: str, sites: str, mutations: str) -> str:
    return f"""
    , steps AS (SELECT child, place, sum(n) AS n FROM (
        SELECT child, lft AS place, 1 AS n FROM {edges} WHERE lft < rgt
        UNION ALL SELECT child, rgt, -1 FROM {edges} WHERE lft < rgt) GROUP BY ALL),
    points AS (SELECT lft AS p FROM iv UNION SELECT rgt FROM iv)
    SELECT 'edge child in nodes' AS "check", count(*) AS n_bad FROM {edges} WHERE child NOT IN (SELECT id FROM {nodes})
    UNION ALL SELECT 'edge parent in nodes', count(*) FROM {edges} WHERE parent NOT IN (SELECT id FROM {nodes})
    UNION ALL SELECT 'edge not empty', count(*) FROM {edges} WHERE lft >= rgt
    UNION ALL SELECT 'edge ends are breakpoints', count(*) FROM (SELECT lft AS p FROM {edges} UNION ALL SELECT rgt FROM {edges})
      WHERE p NOT IN (SELECT p FROM points)
    UNION ALL SELECT 'one parent at a time', count(*) FILTER (n > 1) FROM (
      SELECT sum(n) OVER (PARTITION BY child ORDER BY place) AS n FROM steps)
    UNION ALL SELECT 'parent older than child', count(*) FROM {edges} e JOIN {nodes} a ON a.id = e.child
      JOIN {nodes} z ON z.id = e.parent WHERE z.time <= a.time
    UNION ALL SELECT 'mutation node in nodes', count(*) FROM {mutations} WHERE node_id NOT IN (SELECT id FROM {nodes})
    UNION ALL SELECT 'mutation site in sites', count(*) FROM {mutations} WHERE site_id NOT IN (SELECT id FROM {sites})
    UNION ALL SELECT 'mutation parent in mutations', count(*) FROM {mutations}
      WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM {mutations})"""


@query("sum05_integrity", O.trees(_integrity("nodes", "edges", "sites", "mutations"), O.MUTS))
def _(c):
    return tables.integrity_report(c.nodes, c.edges, c.sites, c.mutations, c.intervals)


@query("sum05_integrity_faults", O.trees(_integrity("bn", "be", "bs", "bm"), O.MUTS, """
    bn AS (SELECT id, CASE WHEN id % 17 = 5 THEN 1000.0 ELSE time END AS time FROM nodes WHERE id % 7 <> 3),
    be AS (SELECT child, parent, lft, CASE WHEN child % 19 = 4 THEN lft WHEN child % 13 = 2 THEN rgt + 0.5 ELSE rgt END AS rgt
           FROM edges UNION ALL SELECT child, 99, lft, rgt FROM edges WHERE child % 11 = 1),
    bs AS (SELECT * FROM sites WHERE id % 5 <> 2),
    bm AS (SELECT * FROM mutations WHERE id % 3 <> 1)"""))
def _(c):
    end = F.when(F.col("child") % 19 == 4, F.col("left")).when(F.col("child") % 13 == 2, F.col("right") + 0.5)
    edges = c.edges.withColumn("right", end.otherwise(F.col("right"))).unionByName(
        c.edges.where("child % 11 = 1").withColumn("parent", F.lit(99).cast("long")))
    nodes = c.nodes.where("id % 7 <> 3").withColumn(
        "time", F.when(F.col("id") % 17 == 5, 1000.0).otherwise(F.col("time")))
    return tables.integrity_report(nodes, edges, c.sites.where("id % 5 <> 2"), c.mutations.where("id % 3 <> 1"), c.intervals)


@query("snk01_genealogy_rows", O.placed("""
    SELECT tree_index, node_id // 512 AS chunk, lft AS interval_left, rgt AS interval_right,
      string_agg(node_id::VARCHAR, ',' ORDER BY node_id) AS node_ids,
      string_agg(coalesce(parent_id, -1)::VARCHAR, ',' ORDER BY node_id) AS parent_ids,
      string_agg(n_children::VARCHAR, ',' ORDER BY node_id) AS child_counts,
      round(sum(x::DOUBLE), 4) AS sum_x, round(sum(time), 6) AS sum_time
    FROM placed JOIN iv USING (tree_index) GROUP BY ALL"""))
def _(c):
    rows = sinks.genealogy_rows(R.placed_nodes(c), c.intervals, chunk=512)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))
    return rows.select("tree_index", "chunk", "interval_left", "interval_right",
                       txt("node_ids").alias("node_ids"), txt("parent_ids").alias("parent_ids"),
                       txt("child_counts").alias("child_counts"),
                       num(total("layout_x"), 4).alias("sum_x"),
                       num(total("node_times")).alias("sum_time"))


_TREES: dict[int, str] = {}


def _stored_trees(c) -> DataFrame:
    """All trees and mutations as compressed rows in shards, written once per application."""
    if id(c) not in _TREES:
        path = f"{checkpoint_dir(c.spark)}/genealogies-{uuid4().hex}"
        parts = GEN.genealogy_parts(R.placed_nodes(c), c.intervals, R.located_mutations(c), part_size=1024)
        GEN.write_shards(parts, path, shard_bytes=1 << 20)
        _TREES[id(c)] = path
    return GEN.read_shards(c.spark, _TREES[id(c)])


@query("snk01_stored_nodes", O.placed("""
    SELECT tree_index, node_id, coalesce(parent_id, -1) AS parent_id, time, flags, n_children, round(x::DOUBLE, 6) AS x FROM placed"""))
def _(c):
    return GEN.nodes_of(_stored_trees(c)).select(
        "tree_index", "node_id", C.sentinels(F.col("parent_id")).alias("parent_id"), "time", "flags", "n_children", num("x").alias("x"))


@query("snk01_stored_children", O.placed(
    "SELECT tree_index, parent_id AS parent, node_id AS child FROM placed WHERE parent_id IS NOT NULL"))
def _(c):
    return GEN.children_of(_stored_trees(c), part_size=1024)


@query("snk01_stored_mutations", O.trees(
    "SELECT tree_index, id, node_id, position, ancestral_state, derived_state FROM muts WHERE tree_index IS NOT NULL", O.MUTS))
def _(c):
    return GEN.mutations_of(_stored_trees(c)).select(
        "tree_index", "id", "node_id", "position", "ancestral_state", "derived_state")


@query("snk02_node_dimension", O.trees("""
    SELECT id, flags, time, coalesce(population, -1) AS population, coalesce(individual, -1) AS individual,
           metadata_json, strlen(metadata_json) AS n_bytes FROM nodes"""))
def _(c):
    return sinks.dimension_rows(c.nodes).select(
        "id", "flags", "time", "population", "individual", "metadata_json",
        F.octet_length("metadata_raw").cast("long").alias("n_bytes"))


@query("snk03_mutation_order", O.trees("""
    SELECT row_number() OVER (ORDER BY position, id) - 1 AS "row", id, position, node_id FROM muts""", O.MUTS))
def _(c):
    return MUT.numbered(MUT.with_sites(c.mutations, c.sites)).select(
        "row", "id", "position", "node_id")


@query("snk04_metadata_index", O.trees("""
    SELECT source, key, coalesce(value, '-') AS value, node_id // 256 AS chunk,
      string_agg(node_id::VARCHAR, ',' ORDER BY node_id) AS node_ids,
      string_agg(name, ',' ORDER BY node_id) AS names FROM mrows GROUP BY ALL""", O.META))
def _(c):
    index = MET.metadata_index(MET.metadata_rows(R.samples(c)), chunk=256)
    return index.select("source", "key", F.coalesce("value", F.lit("-")).alias("value"), "chunk",
                        txt("sample_node_ids").alias("node_ids"),
                        F.array_join("sample_names", ",").alias("names"))


@query("snk05_membership_ranges", O.trees("""
    , t AS (SELECT node_id, tree_index, tree_index - row_number() OVER (PARTITION BY node_id ORDER BY tree_index) AS g
            FROM touch)
    SELECT node_id, min(tree_index) AS first_tree, max(tree_index) + 1 AS last_tree FROM t GROUP BY node_id, g"""))
def _(c):
    runs = c.runs(isolated=False)
    return T.membership_ranges(runs, c.loc.n_trees)


@query("snk06_layout_tables", O.placed("""
    SELECT node_id::BIGINT AS node_id, coalesce(parent_id, -1)::BIGINT AS parent_id, is_tip, tree_index::BIGINT AS tree_idx,
           round(x::DOUBLE, 6) AS x, round(y::DOUBLE, 6) AS y FROM placed""", isolated=False))
def _(c):
    table = sinks.layout_nodes(R.placed_nodes(c, isolated=False))
    return table.select("node_id", "parent_id", "is_tip", "tree_idx", num("x").alias("x"),
                        num("y").alias("y"))


@query("snk07_mutation_result", O.trees("""
    SELECT position::BIGINT AS position, ancestral_state || '->' || derived_state AS mutation,
      node_id::BIGINT AS node_id, site_id::BIGINT AS site_id, ancestral_state, derived_state, 0::BIGINT AS distance,
      coalesce(tree_index, -1) AS tree_index, interval_left, interval_right FROM muts""", O.MUTS))
def _(c):
    return sinks.mutation_result(R.located_mutations(c, bounds=True))


STATS = """
st AS MATERIALIZED (SELECT iv.tree_index, lft, rgt,
  (SELECT max(time) FROM tna t WHERE t.tree_index = iv.tree_index AND parent_id IS NULL) AS root_time,
  (SELECT coalesce(sum(parent_time - child_time), 0) FROM te WHERE te.tree_index = iv.tree_index) AS total_branch_length,
  (SELECT count(*) FROM tna t WHERE t.tree_index = iv.tree_index AND parent_id IS NULL) AS n_roots FROM iv)
"""


@query("snk08_tree_bed", O.trees("""
    SELECT concat_ws(chr(9), 'chr1', round_even(lft, 0)::BIGINT, round_even(rgt, 0)::BIGINT, 'tree_' || tree_index,
      round_even(1000.0 * (total_branch_length / t), 0)::BIGINT, '.', round_even(lft, 0)::BIGINT, round_even(rgt, 0)::BIGINT,
      g || ',' || g || ',' || g) AS value
    FROM (SELECT *, max(total_branch_length) OVER () AS t,
          round_even(255.0 * (total_branch_length / max(total_branch_length) OVER ()), 0)::BIGINT AS g FROM st)""", STATS))
def _(c):
    stats = T.tree_statistics(c.runs(), c.loc)
    return bed.lines(bed.tree_bed(stats, "total_branch_length"))


@query("snk09_site_bed", O.trees("""
    SELECT concat_ws(chr(9), 'chr1', p, p + 1, 'pos' || p || ':' || a || coalesce('/' || d, ''), 0, '.', p, p + 1, '0,0,0') AS value
    FROM (SELECT s.position::BIGINT AS p, s.ancestral_state AS a,
          (SELECT arg_min(m.derived_state, m.id) FROM muts m WHERE m.site_id = s.id
           AND m.derived_state <> s.ancestral_state) AS d FROM sites s)""", O.MUTS))
def _(c):
    return bed.lines(bed.site_bed(c.sites, c.mutations))


# ---- intervals ------------------------------------------------------------

@query("int01_intervals", O.trees('SELECT tree_index, lft AS interval_left, rgt AS interval_right FROM iv'))
def _(c):
    again = I.intervals_from_breakpoints(I.breakpoints(c.edges))
    return again.select("tree_index", F.col("left").alias("interval_left"),
                        F.col("right").alias("interval_right"))


def _tree_rows(spark, sf_dir) -> DataFrame:
    return N.tree_rows(ON.raw_table(spark, sf_dir))


def _newick_intervals(spark, sf_dir) -> DataFrame:
    return ON.tree_intervals(spark, sf_dir, _tree_rows(spark, sf_dir))


@raw_query("int02_newick_intervals", O.newick(
    "SELECT tree_index, lft AS interval_left, rgt AS interval_right FROM niv"))
def _(spark, sf_dir):
    return _newick_intervals(spark, sf_dir).select(
        "tree_index", F.col("left").alias("interval_left"), F.col("right").alias("interval_right"))


def _prices(spark, sf_dir) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select("l_orderkey", "l_linenumber", "l_extendedprice",
                        (F.col("l_extendedprice") * 30).alias("p"))


LOOK = """
look AS (SELECT l_orderkey, l_linenumber, l_extendedprice, i.i AS raw
         FROM (SELECT *, l_extendedprice * 30 AS p FROM lineitem) l ASOF LEFT JOIN nbp i ON l.p >= i.p)
"""


@raw_query("int04_tree_at_position", O.newick("""
    SELECT l_orderkey, l_linenumber, l_extendedprice,
      coalesce(CASE WHEN raw < (SELECT count(*) FROM niv) THEN raw END, -1) AS tree_index FROM look""", LOOK))
def _(spark, sf_dir):
    loc = I.locator(_newick_intervals(spark, sf_dir))
    return I.trees_at(_prices(spark, sf_dir), "p", loc).drop("p").withColumn(
        "tree_index", C.sentinels(F.col("tree_index")))


@raw_query("int05_tree_at_clamped", O.newick("""
    SELECT l_orderkey, l_linenumber, l_extendedprice,
      least(coalesce(raw, 0), (SELECT count(*) FROM niv) - 1) AS tree_index FROM look""", LOOK))
def _(spark, sf_dir):
    loc = I.locator(_newick_intervals(spark, sf_dir))
    return I.trees_at_clamped(_prices(spark, sf_dir), "p", loc).drop("p")


@query("int06_trees_in_range", O.trees(
    "SELECT tree_index FROM iv WHERE rgt > 1500 AND lft < 2500"))
def _(c):
    return I.trees_in_range(c.intervals, START, END, c.length).select("tree_index")


@query("int07_tree_nodes_in_range", O.trees("""
    SELECT tree_index, node_id, coalesce(parent_id, -1) AS parent_id FROM tna JOIN iv USING (tree_index)
    WHERE rgt > 1500 AND lft < 2500"""))
def _(c):
    hit = I.trees_in_range(c.intervals, START, END, c.length)
    return c.tree_nodes(hit).select("tree_index", "node_id",
                                    C.sentinels(F.col("parent_id")).alias("parent_id"))


@query("int08_interval_of_node_trees", O.trees("""
    SELECT tree_index, node_id, lft AS interval_left, rgt AS interval_right FROM touch JOIN iv USING (tree_index)"""))
def _(c):
    return I.with_bounds(c.tree_nodes(isolated=False).select("tree_index", "node_id"), c.loc)


NSTART, NEND = 10_000.0, 1_200_000.0
VIEW = """
vb AS (SELECT CASE WHEN 10000 >= max(p) THEN max(i) ELSE coalesce(max(i) FILTER (p < 10000), min(i)) END AS lo,
              coalesce(min(i) FILTER (p > 1200000), count(*)) + 1 AS hi FROM nbp)
"""


@raw_query("int09_viewport_bounds", O.newick(
    'SELECT lo, hi, greatest(0, hi - lo) AS "count" FROM vb', VIEW))
def _(spark, sf_dir):
    points = I.indexed_breakpoints(_newick_intervals(spark, sf_dir))
    return I.viewport_bounds(points, NSTART, NEND)


@raw_query("int10_visible_breakpoints", O.newick("""
    , seen AS (SELECT i, p, i - min(i) OVER () AS o, count(*) OVER () AS n FROM nbp, vb WHERE i >= lo AND i < hi)
    SELECT i, p AS position FROM seen WHERE o % greatest(1, ceil(n / 2000.0)::BIGINT) = 0""", VIEW))
def _(spark, sf_dir):
    points = I.indexed_breakpoints(_newick_intervals(spark, sf_dir))
    view = I.viewport_bounds(points, NSTART, NEND).first()
    return I.decimate(points, F.lit(view["lo"]), F.lit(view["hi"]))


@query("int10_breakpoints_in_range", O.trees("""
    , v AS (SELECT min(tree_index) AS lo, max(tree_index) + 2 AS hi FROM iv WHERE rgt > 1500 AND lft < 2500),
    seen AS (SELECT i, p, i - min(i) OVER () AS o, count(*) OVER () AS n FROM bp, v WHERE i >= lo AND i < hi)
    SELECT i, p AS position FROM seen WHERE o % greatest(1, ceil(n / 10.0)::BIGINT) = 0"""))
def _(c):
    return I.visible_breakpoints(c.intervals, START, END, 10)


BINS = """
bins AS (SELECT tree_index, lft, rgt, greatest(lft, 10000.0) AS visible_start, least(rgt, 1200000.0) AS visible_end,
                rgt - lft AS span, (lft + rgt) / 2 AS midpoint FROM niv),
sl AS (SELECT *, greatest(1, least(count(*) OVER (), greatest(10, ceil(count(*) OVER () / 20.0)))) AS slots FROM bins),
slot AS MATERIALIZED (SELECT *, 1190000.0 / slots AS slot_width,
   least(slots - 1, greatest(0, floor((midpoint - 10000.0) / (1190000.0 / slots))))::BIGINT AS slot FROM sl)
"""


@raw_query("int11_tree_bins", O.newick(
    "SELECT tree_index, visible_start, visible_end, span, midpoint FROM bins", BINS))
def _(spark, sf_dir):
    return I.tree_bins(_newick_intervals(spark, sf_dir), NSTART, NEND).drop("left", "right")


def _slotted(spark, sf_dir) -> DataFrame:
    bins = I.tree_bins(_newick_intervals(spark, sf_dir), NSTART, NEND)
    return I.assign_slots(bins, NSTART, NEND, ZOOM / BP)


@raw_query("int13_slots", O.newick(
    "SELECT tree_index, slot, round(slot_width, 6) AS slot_width FROM slot", BINS))
def _(spark, sf_dir):
    return _slotted(spark, sf_dir).select("tree_index", "slot", num("slot_width").alias("slot_width"))


DETAIL = "greatest(1, least(3, 3 - floor(log10(count(*)) + log10(20.0) / 2)))::INT AS detail"


def _best(order: str) -> str:
    return O.newick(f"""SELECT slot, arg_min(tree_index, ({order}, tree_index)) AS tree_index,
        count(*) AS group_size, {DETAIL} FROM slot GROUP BY slot""", BINS)


for _strategy, _order in {
        "int14_largest_span": "-span", "int17_first": "lft",
        "int15_center_weighted":
            "abs(midpoint - (10000.0 + slot * slot_width + slot_width / 2))"}.items():
    def _build(spark, sf_dir, kind=_strategy.split("_", 1)[1]):
        return I.representatives(_slotted(spark, sf_dir), NSTART, ZOOM / BP, kind)
    raw_query(_strategy, _best(_order))(_build)


@raw_query("int16_span_weighted_random", _best("""CASE WHEN span > 0 THEN -ln(
      ((((tree_index % 2147483648) * 2654435761 + 283521) % 4294967296 * 1103515245 + 12345) % 4294967296 + 1.0)
      / 4294967297.0::DOUBLE) / span ELSE 'inf'::DOUBLE END"""))
def _(spark, sf_dir):
    return I.representatives(_slotted(spark, sf_dir), NSTART, ZOOM / BP, "span_weighted_random", 7)


@raw_query("int18_local_bins", O.newick(f"""
    , best AS (SELECT slot, arg_min(tree_index, (-span, tree_index)) AS chosen, count(*) AS group_size, {DETAIL}
               FROM slot GROUP BY slot)
    SELECT tree_index, slot, group_size, CASE WHEN tree_index = chosen THEN detail ELSE 0 END AS detail,
      tree_index = chosen AS visible,
      round(CASE WHEN tree_index = chosen THEN (10000.0 + slot * slot_width + slot_width / 2) / 20000
        - slot_width / 20000 / 1.05 / 2 ELSE -1 END, 6) AS translate_x,
      round(CASE WHEN tree_index = chosen THEN slot_width / 20000 / 1.05 ELSE -1 END, 6) AS scale_x
    FROM slot JOIN best USING (slot)""", BINS))
def _(spark, sf_dir):
    bins = I.local_bins(_newick_intervals(spark, sf_dir), 0, 2 ** 40, NSTART, NEND, BP, ZOOM)
    shown = lambda name: F.coalesce(num(name), F.lit(-1.0)).alias(name)
    return bins.select("tree_index", "slot", "group_size",
                       F.coalesce("detail", F.lit(0)).alias("detail"), "visible",
                       shown("translate_x"), shown("scale_x"))


@raw_query("int20_show_all", O.newick("""
    SELECT tree_index, tree_index - min(tree_index) OVER () AS slot, 1::BIGINT AS group_size, 2 AS detail,
      round((10000.0 + (tree_index - min(tree_index) OVER () + 0.5) * (1190000.0 / count(*) OVER ())) / 20000
        - (1190000.0 / 20000 / count(*) OVER () * 0.9) / 2, 6) AS translate_x,
      round(1190000.0 / 20000 / count(*) OVER () * 0.9, 6) AS scale_x FROM bins""", BINS))
def _(spark, sf_dir):
    bins = I.local_bins(_newick_intervals(spark, sf_dir), 0, 2 ** 40, NSTART, NEND, BP, BP / 2)
    return bins.select("tree_index", "slot", "group_size", "detail",
                       num("translate_x").alias("translate_x"), num("scale_x").alias("scale_x"))


# ---- trees ----------------------------------------------------------------

@query("tre01_active_edges", O.trees("SELECT tree_index, child, parent FROM te"))
def _(c):
    return c.tree_edges().select("tree_index", "child", "parent")


@query("tre02_parents", O.trees(
    "SELECT tree_index, node_id, coalesce(parent_id, -1) AS parent_id FROM tnb"))
def _(c):
    return c.tree_nodes(isolated=False).select(
        "tree_index", "node_id", C.sentinels(F.col("parent_id")).alias("parent_id"))


@query("tre03_child_lists", O.trees("""
    SELECT tree_index, parent, child // 300 AS chunk, string_agg(child::VARCHAR, ',' ORDER BY child) AS children
    FROM te GROUP BY ALL"""))
def _(c):
    return T.child_lists(c.tree_edges(), chunk=300).select(
        "tree_index", "parent", "chunk", txt("children").alias("children"))


@query("tre04_membership", O.trees("SELECT tree_index, node_id FROM touch"))
def _(c):
    runs = c.runs(isolated=False)
    return T.explode_spans(runs.select("node_id", "first_tree", "last_tree"))


@query("tre05_membership_isolated", O.trees("SELECT tree_index, node_id FROM mem"))
def _(c):
    return T.explode_spans(c.runs().select("node_id", "first_tree", "last_tree"))


@query("tre06_root_counts", O.trees("""
    SELECT tree_index, count(*) AS n_roots FROM tna WHERE parent_id IS NULL GROUP BY ALL"""))
def _(c):
    return T.root_counts(c.tree_nodes())


@query("tre07_tips_and_children", O.trees(
    "SELECT tree_index, node_id, n_children, is_tip FROM tna"))
def _(c):
    return c.tree_nodes().select("tree_index", "node_id", "n_children", "is_tip")


@query("tre08_unary_nodes", O.trees("""
    SELECT tree_index, node_id FROM tna WHERE n_children = 1 AND parent_id IS NOT NULL"""))
def _(c):
    return c.tree_nodes().where(T.is_unary()).select("tree_index", "node_id")


@query("tre09_layout_x", O.placed(
    "SELECT tree_index, node_id, round(x::DOUBLE, 6) AS x FROM placed"))
def _(c):
    return R.placed_nodes(c).select("tree_index", "node_id", num("x").alias("x"))


def _range(c) -> tuple[Column, Column]:
    return C.bounds(c.time_range())


@query("tre10_time_to_y", O.trees("""
    SELECT tree_index, node_id, round((1 - time / 30)::REAL::DOUBLE, 6) AS y_linear,
           round((1 - ln(1 + time) / ln(31))::REAL::DOUBLE, 5) AS y_log FROM tna"""))
def _(c):
    lo, hi = _range(c)
    t = F.col("time")
    return c.tree_nodes().select("tree_index", "node_id",
                                 num(C.time_to_y(t, lo, hi)).alias("y_linear"),
                                 num(C.time_to_y(t, lo, hi, "log"), 5).alias("y_log"))


@query("tre11_rescale_y", O.trees("""
    SELECT tree_index, node_id, round((1 - ln(1 + (30 - (1 - time / 30)::REAL::DOUBLE * 30)) / ln(31))::REAL::DOUBLE, 5) AS y
    FROM tna"""))
def _(c):
    lo, hi = _range(c)
    linear = C.time_to_y(F.col("time"), lo, hi)
    return c.tree_nodes().select("tree_index", "node_id",
                                 num(C.rescale_y(linear, lo, hi, "log"), 5).alias("y"))


@query("tre12_y_to_time", O.trees("""
    SELECT tree_index, node_id, round(time, 3) AS from_linear, round(time, 3) AS from_log FROM tna"""))
def _(c):
    lo, hi = _range(c)
    t = F.col("time")
    back = lambda s: num(C.y_to_time(C.time_to_y(t, lo, hi, s), lo, hi, s), 3)
    return c.tree_nodes().select("tree_index", "node_id", back("linear").alias("from_linear"),
                                 back("log").alias("from_log"))


MUT_ON_TREE = """
pm AS MATERIALIZED (SELECT m.tree_index, m.id AS mutation_id, m.node_id, p.parent_id AS tree_parent_id, m.inherited_state, p.x,
  CASE WHEN m.time IS NOT NULL THEN (1 - least(greatest(m.time, 0), 30) / 30)::REAL
       ELSE ((p.y + coalesce(q.y, 0)) / 2.0)::REAL END AS y
  FROM muts m JOIN placed p ON p.tree_index = m.tree_index AND p.node_id = m.node_id
  LEFT JOIN placed q ON q.tree_index = p.tree_index AND q.node_id = p.parent_id)
"""


@query("tre16_mutations_on_trees", O.placed("""
    SELECT tree_index, mutation_id, node_id, coalesce(tree_parent_id, -1) AS parent_id, inherited_state,
           round(x::DOUBLE, 6) AS x, round(y::DOUBLE, 6) AS y FROM pm""", O.MUTS, MUT_ON_TREE))
def _(c):
    muts = R.located_mutations(c).withColumnRenamed("id", "mutation_id")
    at = MUT.place(muts, R.placed_nodes(c), c.time_range())
    return at.select("tree_index", "mutation_id", "node_id",
                     C.sentinels(F.col("tree_parent_id")).alias("parent_id"), "inherited_state",
                     num("x").alias("x"), num("y").alias("y"))


@query("tre17_inherited_state", O.trees(
    "SELECT id, site_id, ancestral_state, derived_state, inherited_state FROM muts", O.MUTS))
def _(c):
    rows = MUT.with_inherited_state(MUT.with_sites(c.mutations, c.sites))
    return rows.select("id", "site_id", "ancestral_state", "derived_state", "inherited_state")


@query("tre24_tree_statistics", O.trees("""
    SELECT tree_index, lft AS interval_left, rgt AS interval_right, root_time,
           round(total_branch_length, 6) AS total_branch_length, n_roots FROM st""", STATS))
def _(c):
    s = T.tree_statistics(c.runs(), c.loc)
    return s.select("tree_index", F.col("left").alias("interval_left"),
                    F.col("right").alias("interval_right"), "root_time",
                    num("total_branch_length").alias("total_branch_length"), "n_roots")


@query("tre25_edge_list", O.trees(
    "SELECT tree_index, parent_id AS parent, node_id AS child FROM tna WHERE parent_id IS NOT NULL"))
def _(c):
    return c.tree_nodes().where(F.col("parent_id").isNotNull()).select(
        "tree_index", F.col("parent_id").alias("parent"), F.col("node_id").alias("child"))


@query("tre26_elbows", O.placed("""
    SELECT a.tree_index, b.node_id AS parent, a.node_id AS child, round(b.x::DOUBLE * 2 + 1, 6) AS x0,
      round(b.y::DOUBLE, 6) AS y0, round(a.x::DOUBLE * 2 + 1, 6) AS x1, round(b.y::DOUBLE, 6) AS y1, round(a.y::DOUBLE, 6) AS y2
    FROM placed a JOIN placed b ON b.tree_index = a.tree_index AND b.node_id = a.parent_id""", isolated=False))
def _(c):
    paths = LAY.elbows(R.placed_nodes(c, isolated=False), scale_x=2.0, translate_x=1.0)
    p = F.col("path")
    return paths.select("tree_index", "parent", "child", num(p[0]["x"]).alias("x0"),
                        num(p[0]["y"]).alias("y0"), num(p[1]["x"]).alias("x1"),
                        num(p[1]["y"]).alias("y1"), num(p[2]["y"]).alias("y2"))


@query("tre28_counts_per_tree", O.trees("""
    SELECT tree_index, count(*) AS n_nodes, coalesce(any_value(m.n), 0) AS n_mutations FROM tna
    LEFT JOIN (SELECT tree_index, count(*) AS n FROM muts GROUP BY ALL) m USING (tree_index) GROUP BY ALL""", O.MUTS))
def _(c):
    return T.per_tree_counts(c.tree_nodes(), R.located_mutations(c))


# ---- thinning -------------------------------------------------------------

CELL = """
cs AS (SELECT tree_index, count(*)::DOUBLE AS n FROM placed GROUP BY ALL),
cell AS MATERIALIZED (SELECT tree_index, n, floor(1.0 / size)::BIGINT AS res, size FROM (
  SELECT *, least(greatest(1.0 / least(greatest(floor(sqrt(greatest(1.0, n / least(greatest(10 * sqrt(n / 100), 10), 1000)))), 5), 1000),
    0.0004), 0.002) AS size FROM cs))
"""
GRID = """
mid AS MATERIALIZED (SELECT a.tree_index, a.node_id, ((a.x + b.x)::REAL)::DOUBLE / 2 AS mx, ((a.y + b.y)::REAL)::DOUBLE / 2 AS my
  FROM placed a JOIN placed b ON b.tree_index = a.tree_index AND b.node_id = a.parent_id)
"""
PLAIN_KEY = """
keyed AS MATERIALIZED (SELECT m.*, false AS inside, least(trunc(mx * res)::BIGINT, res - 1) AS cx, least(trunc(my * res)::BIGINT, res - 1) AS cy
  FROM mid m JOIN cell USING (tree_index))
"""
BOX_KEY = """
sized AS (SELECT tree_index, res AS ro, CASE WHEN tree_index = 40 THEN floor(1.0 / greatest(0.0004, least(0.002, size * 0.5)))::BIGINT
            ELSE res END AS ri FROM cell),
keyed AS MATERIALIZED (SELECT tree_index, node_id, inside, least(trunc(mx * res)::BIGINT, res - 1) AS cx, least(trunc(my * res)::BIGINT, res - 1) AS cy
  FROM (SELECT *, CASE WHEN inside THEN ri ELSE ro END AS res FROM (
    SELECT *, tree_index = 40 AND mx >= 0.2 AND mx <= 0.7 AND my >= 0.3 AND my <= 1.0 AS inside FROM mid JOIN sized USING (tree_index))))
"""
WINNERS = "winners AS (SELECT tree_index, min(node_id) AS node_id FROM keyed GROUP BY tree_index, inside, cx, cy)"
WINNERS_KEEP = """
winners AS (SELECT tree_index, min(node_id) AS node_id FROM keyed WHERE NOT inside GROUP BY tree_index, cx, cy
  UNION ALL SELECT tree_index, node_id FROM keyed WHERE inside)
"""
KEPT = """
una AS (SELECT tree_index, node_id FROM placed WHERE n_children = 1 AND parent_id IS NOT NULL),
forced AS MATERIALIZED (SELECT * FROM una UNION SELECT p.tree_index, p.node_id FROM placed p JOIN una u
  ON u.tree_index = p.tree_index AND u.node_id = p.parent_id),
seeds AS (SELECT tree_index, node_id FROM placed WHERE parent_id IS NULL UNION SELECT * FROM winners UNION SELECT * FROM forced),
kept AS MATERIALIZED (SELECT DISTINCT a.tree_index, a.node_id FROM anc a JOIN seeds s ON s.tree_index = a.tree_index AND s.node_id = a.seed),
kp AS MATERIALIZED (SELECT p.* FROM placed p JOIN kept USING (tree_index, node_id)),
kk AS (SELECT tree_index, parent_id AS node_id, count(*) AS kc FROM kp WHERE parent_id IS NOT NULL GROUP BY ALL),
gone AS MATERIALIZED (SELECT kp.tree_index, kp.node_id FROM kp JOIN kk USING (tree_index, node_id)
  WHERE kc = 1 AND parent_id IS NOT NULL AND (tree_index, node_id) NOT IN (SELECT (tree_index, node_id) FROM forced)),
live AS MATERIALIZED (SELECT kp.* FROM kp ANTI JOIN gone USING (tree_index, node_id)),
up AS (SELECT a.tree_index, a.seed, arg_min(a.node_id, a.distance) AS new_parent FROM anc a
  JOIN live l ON l.tree_index = a.tree_index AND l.node_id = a.node_id WHERE a.distance > 0 GROUP BY ALL),
thin AS MATERIALIZED (SELECT live.*, new_parent FROM live LEFT JOIN up ON up.tree_index = live.tree_index AND up.seed = live.node_id)
"""
THIN_OUT = """SELECT tree_index, node_id, coalesce(new_parent, -1) AS parent_id, is_tip,
    round(x::DOUBLE, 6) AS x, round(y::DOUBLE, 6) AS y FROM thin"""


def _thin_out(df: DataFrame) -> DataFrame:
    return df.select("tree_index", "node_id", C.sentinels(F.col("parent_id")).alias("parent_id"),
                     "is_tip", num("x").alias("x"), num("y").alias("y"))


@query("thn01_cell_sizes", O.placed("SELECT tree_index, res AS resolution FROM cell", CELL,
                                    isolated=False))
def _(c):
    counts = T.per_tree_counts(c.tree_nodes(isolated=False))
    return counts.select("tree_index", C.resolution(C.cell_size(F.col("n_nodes"))).alias("resolution"))


@query("thn02_edge_winners", O.placed("SELECT tree_index, node_id FROM winners", CELL, GRID,
                                      PLAIN_KEY, WINNERS, isolated=False))
def _(c):
    return THN.cell_winners(THN.edge_cells(R.placed_nodes(c, isolated=False)))


@query("thn03_direction_bins", O.placed("""
    , flat AS (SELECT * REPLACE (CASE WHEN is_tip THEN 1.0::REAL ELSE x END AS x) FROM placed),
    e AS (SELECT a.tree_index, a.node_id, ((a.x + b.x)::REAL)::DOUBLE / 2 AS mx, ((a.y + b.y)::REAL)::DOUBLE / 2 AS my,
          b.x - a.x AS dx, b.y - a.y AS dy FROM flat a JOIN flat b ON b.tree_index = a.tree_index AND b.node_id = a.parent_id)
    SELECT tree_index, node_id, least(trunc(mx * res)::BIGINT, res - 1) AS cx, least(trunc(my * res)::BIGINT, res - 1) AS cy,
      ((dx >= 0)::INT + 2 * (dy >= 0)::INT + 4 * (abs(dy) > abs(dx))::INT)::INT AS direction FROM e JOIN cell USING (tree_index)""",
    CELL, isolated=False))
def _(c):
    flat = R.placed_nodes(c, isolated=False).withColumn(
        "x", F.when(F.col("is_tip"), F.lit(1.0).cast("float")).otherwise(F.col("x")))
    return THN.edge_cells(flat).drop("inside")


@query("thn04_kept_closure", O.placed("SELECT tree_index, node_id FROM kept", CELL, GRID, PLAIN_KEY,
                                      WINNERS, KEPT, isolated=False))
def _(c):
    return THN.kept_nodes(R.placed_nodes(c, isolated=False)).select("tree_index", "node_id")


@query("thn05_unary_anchors", O.placed("SELECT tree_index, node_id FROM forced", CELL, GRID,
                                       PLAIN_KEY, WINNERS, KEPT, isolated=False))
def _(c):
    return THN.unary_and_child(c.tree_nodes(isolated=False))


@query("thn06_thinned_nodes", O.placed(THIN_OUT, CELL, GRID, PLAIN_KEY, WINNERS, KEPT,
                                       isolated=False))
def _(c):
    return _thin_out(THN.thin_nodes(R.placed_nodes(c, isolated=False)))


@query("thn07_thinned_mutations", O.placed("""
    , onk AS (SELECT pm.* FROM pm JOIN thin USING (tree_index, node_id))
    SELECT tree_index, min(mutation_id) AS mutation_id FROM onk
    GROUP BY tree_index, least(trunc(x::DOUBLE * 500)::BIGINT, 499), least(trunc(y::DOUBLE * 500)::BIGINT, 499)""",
    CELL, GRID, PLAIN_KEY, WINNERS, KEPT, O.MUTS, MUT_ON_TREE, isolated=False))
def _(c):
    return R.layout_request(c).mutations.select("tree_index", "mutation_id")


@query("thn09_adaptive_nodes", O.placed(THIN_OUT, CELL, GRID, BOX_KEY, WINNERS, KEPT,
                                        isolated=False))
def _(c):
    return _thin_out(THN.thin_nodes(R.placed_nodes(c, isolated=False), multiplier=0.5, box=BOX))


@query("thn10_adaptive_mutations", O.placed("""
    , z AS (SELECT *, tree_index = 40 AND x >= 0.2::REAL AND x <= 0.7::REAL AND y >= 0.3::REAL AND y <= 1.0::REAL AS inside FROM pm),
    r AS (SELECT *, CASE WHEN inside THEN 2000 ELSE 500 END AS res FROM z)
    SELECT tree_index, min(mutation_id) AS mutation_id FROM r
    GROUP BY tree_index, inside, least(trunc(x::DOUBLE * res)::BIGINT, res - 1), least(trunc(y::DOUBLE * res)::BIGINT, res - 1)""",
    O.MUTS, MUT_ON_TREE, isolated=False))
def _(c):
    muts = R.located_mutations(c).withColumnRenamed("id", "mutation_id")
    at = MUT.place(muts, R.placed_nodes(c, isolated=False), c.time_range())
    return THN.thin_mutations(at, 500, 2000, BOX).select("tree_index", "mutation_id")


@query("thn11_no_thinning_inside", O.placed(THIN_OUT, CELL, GRID, BOX_KEY, WINNERS_KEEP, KEPT,
                                            isolated=False))
def _(c):
    return _thin_out(THN.thin_nodes(R.placed_nodes(c, isolated=False), multiplier=0.35, box=BOX))


@query("snk06_layout_mutations", O.placed("""
    SELECT round(x::DOUBLE, 6) AS mut_x, round(y::DOUBLE, 6) AS mut_y, tree_index AS mut_tree_idx, node_id AS mut_node_id,
      mutation_id AS mut_id, inherited_state AS mut_inherited_state FROM pm""", O.MUTS, MUT_ON_TREE, isolated=False))
def _(c):
    table = R.layout_tables(R.layout_request(c, thin=False)).mutations
    return table.select(num("mut_x").alias("mut_x"), num("mut_y").alias("mut_y"), "mut_tree_idx", "mut_node_id",
                        "mut_id", "mut_inherited_state")


@query("tre15_one_tree", O.placed(THIN_OUT + " WHERE tree_index = 40", CELL, GRID, PLAIN_KEY, WINNERS, KEPT,
                                  isolated=False))
def _(c):
    return _thin_out(R.layout_request(c, [40, 9_999]).nodes)


@query("tre15_window", O.placed(THIN_OUT + " JOIN iv USING (tree_index) WHERE rgt > 1500 AND lft < 1900",
                                CELL, GRID, PLAIN_KEY, WINNERS, KEPT, isolated=False))
def _(c):
    trees = c.intervals.where("right > 1500 and left < 1900").select("tree_index")
    return _thin_out(R.layout_request(c, trees).nodes)


@query("tre15_window_mutations", O.placed("""
    , onk AS (SELECT pm.* FROM pm JOIN thin USING (tree_index, node_id) JOIN iv USING (tree_index) WHERE rgt > 1500 AND lft < 1900)
    SELECT tree_index, min(mutation_id) AS mutation_id FROM onk JOIN cell USING (tree_index)
    GROUP BY tree_index, least(trunc(x::DOUBLE * res)::BIGINT, res - 1), least(trunc(y::DOUBLE * res)::BIGINT, res - 1)""",
    CELL, GRID, PLAIN_KEY, WINNERS, KEPT, O.MUTS, MUT_ON_TREE, isolated=False))
def _(c):
    trees = c.intervals.where("right > 1500 and left < 1900").select("tree_index")
    return R.layout_request(c, trees).mutations.select("tree_index", "mutation_id")


@query("tre15_focused_nodes", O.placed(THIN_OUT, CELL, GRID, BOX_KEY, WINNERS, KEPT, isolated=False))
def _(c):
    return _thin_out(R.layout_request(c, multiplier=0.5, box=BOX).nodes)


@query("tre15_focused_mutations", O.placed("""
    , z AS (SELECT pm.*, tree_index = 40 AND pm.x >= 0.2 AND pm.x <= 0.7 AND pm.y >= 0.3 AND pm.y <= 1.0 AS inside
            FROM pm JOIN thin USING (tree_index, node_id))
    SELECT tree_index, mutation_id FROM z WHERE inside
    UNION ALL SELECT tree_index, min(mutation_id) FROM z JOIN cell USING (tree_index) WHERE NOT inside
    GROUP BY tree_index, least(trunc(x::DOUBLE * res)::BIGINT, res - 1), least(trunc(y::DOUBLE * res)::BIGINT, res - 1)""",
    CELL, GRID, BOX_KEY, WINNERS_KEEP, KEPT, O.MUTS, MUT_ON_TREE, isolated=False))
def _(c):
    return R.layout_request(c, multiplier=0.35, box=BOX).mutations.select("tree_index", "mutation_id")


@query("thn12_inside_cell_size", O.placed("""
    SELECT tree_index, round(greatest(0.0004, least(0.002, size * greatest(0.35, 0.0004 / size))), 9) AS fine,
      round(greatest(0.0004, least(0.002, size * greatest(0.95, 0.0004 / size))), 9) AS held FROM cell""", CELL,
    isolated=False))
def _(c):
    counts = T.per_tree_counts(c.tree_nodes(isolated=False))
    n = F.col("n_nodes")
    outside = C.cell_size(n)
    return counts.select("tree_index", num(C.inside_cell_size(n, outside, 0.35), 9).alias("fine"),
                         num(C.inside_cell_size(n, outside, 2.0), 9).alias("held"))


# ---- lineage --------------------------------------------------------------

def lineage_sql(body: str, *more: str, isolated: bool = True) -> str:
    return O.sql(body, O.TREES, O.TN_ALL if isolated else O.TN_TOUCHED, O.ANC, *more)


@query("lin01_ancestors", lineage_sql(
    "SELECT tree_index, seed, node_id, distance::BIGINT AS distance FROM anc", isolated=False))
def _(c):
    return LIN.ancestor_pairs(c.written_nodes(isolated=False))


@query("lin02_descendant_counts", lineage_sql("""
    SELECT a.tree_index, a.node_id, count(*) AS n_descendants, count(*) FILTER (s.is_tip) AS n_tips
    FROM anc a JOIN tn s ON s.tree_index = a.tree_index AND s.node_id = a.seed WHERE distance > 0 GROUP BY ALL"""))
def _(c):
    return LIN.descendant_counts(c.written_nodes())


@query("lin03_descendant_tips", lineage_sql("""
    SELECT a.tree_index, a.node_id AS query_node, a.seed AS node_id FROM anc a
    JOIN tn s ON s.tree_index = a.tree_index AND s.node_id = a.seed
    WHERE distance > 0 AND s.is_tip AND a.node_id BETWEEN 0 AND 4"""))
def _(c):
    regions = c.nodes.where(F.col("id") < 5).select(F.col("id").alias("node_id"))
    return LIN.descendants(c.written_nodes(), regions, tips_only=True).select(
        "tree_index", "query_node", "node_id")


@query("lin04_search_nodes", O.placed("""
    SELECT tree_index, node_id, time FROM placed WHERE time >= 10 AND time <= 20.5
      AND y::DOUBLE <= 0.65 AND NOT is_tip"""))
def _(c):
    hits = LIN.search_nodes(R.placed_nodes(c), min_time=10.0, max_time=20.5, max_y=0.65,
                            has_children=True)
    return hits.select("tree_index", "node_id", "time")


@query("lin05_subtree_nodes", lineage_sql("""
    SELECT a.tree_index, a.node_id AS query_node, a.seed AS node_id, s.is_tip, s.time FROM anc a
    JOIN tn s ON s.tree_index = a.tree_index AND s.node_id = a.seed WHERE a.node_id BETWEEN 0 AND 4"""))
def _(c):
    regions = c.nodes.where(F.col("id") < 5).select(F.col("id").alias("node_id"))
    return LIN.subtree_nodes(c.written_nodes(), regions).select(
        "tree_index", "query_node", "node_id", "is_tip", "time")


@query("lin05_subtree_edges", lineage_sql("""
    SELECT a.tree_index, a.node_id AS query_node, s.parent_id AS parent, a.seed AS child FROM anc a
    JOIN tn s ON s.tree_index = a.tree_index AND s.node_id = a.seed WHERE distance > 0 AND a.node_id BETWEEN 0 AND 4"""))
def _(c):
    regions = c.nodes.where(F.col("id") < 5).select(F.col("id").alias("node_id"))
    return LIN.subtree_edges(c.written_nodes(), regions)


def _population_seeds(c, tn: DataFrame, population: int) -> DataFrame:
    chosen = c.samples().where(F.col("population") == population).select(F.col("id").alias("node_id"))
    return tn.join(chosen, "node_id", "left_semi").select("tree_index", "node_id")


def _mrca(pick: str) -> str:
    return lineage_sql(f"""
    , sd AS (SELECT tree_index, node_id FROM tn JOIN nodes n ON n.id = node_id WHERE n.population = 3),
    ns AS (SELECT tree_index, count(*) AS n FROM sd GROUP BY ALL HAVING count(*) >= 2),
    cm2 AS (SELECT a.tree_index, a.node_id, count(*) AS hits FROM anc a JOIN sd ON sd.tree_index = a.tree_index
            AND sd.node_id = a.seed GROUP BY ALL),
    cd AS (SELECT c.tree_index, c.node_id, t.time FROM cm2 c JOIN ns USING (tree_index)
           JOIN tn t ON t.tree_index = c.tree_index AND t.node_id = c.node_id WHERE hits = n)
    SELECT ns.tree_index, coalesce({pick}(cd.node_id, cd.time), -1) AS mrca FROM ns LEFT JOIN cd USING (tree_index)
    GROUP BY ALL""", isolated=False)


@query("lin06_common_ancestor", _mrca("arg_min"))
def _(c):
    tn = c.written_nodes(isolated=False)
    return LIN.common_ancestor(tn, _population_seeds(c, tn, 3)).select(
        "tree_index", C.sentinels(F.col("mrca")).alias("mrca"))


@query("lin06_oldest_common_ancestor", _mrca("arg_max"))
def _(c):
    tn = c.written_nodes(isolated=False)
    return LIN.common_ancestor(tn, _population_seeds(c, tn, 3), oldest=True).select(
        "tree_index", C.sentinels(F.col("mrca")).alias("mrca"))


@query("lin07_lineage_paths", lineage_sql("""
    SELECT a.tree_index, a.seed, string_agg(a.node_id::VARCHAR, ',' ORDER BY distance DESC) AS path
    FROM anc a JOIN nodes n ON n.id = a.seed AND n.flags = 1 GROUP BY ALL HAVING count(*) > 1"""))
def _(c):
    tn = c.written_nodes()
    return LIN.lineage_paths(tn, F.col("flags") == 1).select("tree_index", "seed",
                                               txt("path_node_ids").alias("path"))


@raw_query("lin08_newick_paths", O.newick("""
    , walk(tree_index, seed, node_id, distance) AS (SELECT tree_index, node_id, node_id, 0 FROM nn WHERE is_tip
      UNION ALL SELECT w.tree_index, w.seed, p.parent_id, w.distance + 1 FROM walk w JOIN nn p
        ON p.tree_index = w.tree_index AND p.node_id = w.node_id WHERE p.parent_id IS NOT NULL)
    SELECT tree_index, CASE WHEN seed < 7 THEN 6 - seed ELSE seed END::BIGINT AS seed,
      CASE WHEN node_id < 7 THEN 6 - node_id ELSE node_id END::BIGINT AS node_id, distance::BIGINT AS distance FROM walk"""))
def _(spark, sf_dir):
    tn = _newick_tree(spark, sf_dir)
    return LIN.acyclic_paths(tn, tn.where("is_tip").select("tree_index", "node_id"))


@query("lin10_descendants_everywhere", lineage_sql("""
    SELECT tree_index, seed AS node_id, distance::BIGINT AS distance FROM anc WHERE node_id = 10 AND distance > 0"""))
def _(c):
    of = c.nodes.where(F.col("id") == 10).select(F.col("id").alias("node_id"))
    return LIN.descendants(c.written_nodes(), of).select("tree_index", "node_id", "distance")


KEYS = """
tk AS MATERIALIZED (SELECT k AS orderkey, CASE WHEN max(nl) = 1 THEN max('S' || n)
   ELSE string_agg(CASE WHEN j < nl THEN '(' ELSE '' END || 'S' || n, ',' ORDER BY n) || repeat(')', max(nl)::INT - 1) END AS shape0
   FROM lvr GROUP BY k),
-- children of a ladder step: a leaf and a group; '(' sorts before letters
lad(orderkey, j, enc) AS (
  SELECT k, nl, 'S' || n FROM lvr WHERE j = nl
  UNION ALL
  SELECT l.k, l.j, CASE WHEN lad.enc < 'S' || l.n THEN '(' || lad.enc || ',S' || l.n || ')' ELSE '(S' || l.n || ',' || lad.enc || ')' END
  FROM lad JOIN lvr l ON l.k = lad.orderkey AND l.j = lad.j - 1),
canon AS MATERIALIZED (SELECT orderkey, enc AS topology FROM lad WHERE j = 1)
"""

# ---- comparison and topology ---------------------------------------------

CHANGES = """
ed AS (SELECT DISTINCT tree_index, parent, child FROM te),
chg AS MATERIALIZED (
  SELECT a.tree_index, 'inserted' AS change, a.parent, a.child FROM ed a
  WHERE a.tree_index > 0 AND NOT EXISTS (SELECT 1 FROM ed b WHERE b.tree_index = a.tree_index - 1 AND b.parent = a.parent AND b.child = a.child)
  UNION ALL
  SELECT a.tree_index + 1, 'removed', a.parent, a.child FROM ed a
  WHERE a.tree_index < (SELECT max(tree_index) FROM iv)
    AND NOT EXISTS (SELECT 1 FROM ed b WHERE b.tree_index = a.tree_index + 1 AND b.parent = a.parent AND b.child = a.child))
"""


@query("cmp01_neighbour_differences", O.trees("SELECT tree_index, change, parent, child FROM chg", CHANGES))
def _(c):
    return CMP.neighbour_differences(c.spans, c.loc.n_trees)


@query("cmp01_change_counts", O.trees("""
    SELECT tree_index, count(*) FILTER (change = 'inserted') AS n_inserted,
           count(*) FILTER (change = 'removed') AS n_removed FROM chg GROUP BY ALL""", CHANGES))
def _(c):
    return CMP.change_counts(CMP.neighbour_differences(c.spans, c.loc.n_trees))


def _all_neighbours(c) -> DataFrame:
    return CMP.pairs_of(c.intervals.select(F.col("tree_index").alias("pos"), "tree_index"))


@query("cmp01_distant_differences", O.trees("""
    , n AS (SELECT max(tree_index) AS n FROM iv), pr AS (SELECT tree_index AS prev_tree, n - tree_index AS next_tree FROM iv, n),
    dd AS (SELECT DISTINCT tree_index, parent, child FROM te)
    SELECT prev_tree, next_tree, 'removed' AS change, parent, child FROM pr JOIN dd a ON a.tree_index = prev_tree
    WHERE NOT EXISTS (SELECT 1 FROM dd b WHERE b.tree_index = next_tree AND b.parent = a.parent AND b.child = a.child)
    UNION ALL SELECT prev_tree, next_tree, 'inserted', parent, child FROM pr JOIN dd a ON a.tree_index = next_tree
    WHERE NOT EXISTS (SELECT 1 FROM dd b WHERE b.tree_index = prev_tree AND b.parent = a.parent AND b.child = a.child)"""))
def _(c):
    """Each tree with the one as far from the other end, forwards and backwards."""
    t = F.col("tree_index")
    pairs = c.intervals.select(t.alias("pair"), t.alias("prev_tree"), (F.lit(c.loc.n_trees - 1) - t).alias("next_tree"))
    return CMP.pair_differences(c.spans, pairs, c.loc.n_trees).drop("pair")


@query("cmp01_requested_differences", O.trees("""
    SELECT tree_index - 1 AS prev_tree, tree_index AS next_tree, change, parent, child FROM chg""", CHANGES))
def _(c):
    return CMP.pair_differences(c.spans, _all_neighbours(c), c.loc.n_trees).drop("pair")


@query("cmp02_difference_coordinates", O.placed("""
    SELECT g.tree_index - 1 AS prev_tree, g.tree_index AS next_tree, change, parent, child,
      round(p.x::DOUBLE, 6) AS parent_x, round(p.y::DOUBLE, 6) AS parent_y,
      round(k.x::DOUBLE, 6) AS child_x, round(k.y::DOUBLE, 6) AS child_y
    FROM (SELECT *, CASE WHEN change = 'inserted' THEN tree_index ELSE tree_index - 1 END AS home FROM chg) g
    JOIN placed p ON p.tree_index = home AND p.node_id = parent
    JOIN placed k ON k.tree_index = home AND k.node_id = child""", CHANGES, isolated=False))
def _(c):
    out = R.compare_trees(c, _all_neighbours(c))
    return out.select("prev_tree", "next_tree", "change", "parent", "child",
                      *[num(f"{e}_{a}").alias(f"{e}_{a}") for e in ("parent", "child") for a in "xy"])


def _newick_tree(spark, sf_dir) -> DataFrame:
    raw = ON.raw_table(spark, sf_dir)
    rows = N.tree_rows(raw)
    order = N.sample_order(rows, N.file_metadata(raw))
    return cut(N.with_sample_ids(N.newick_nodes(rows), order))


NAMES = "ord AS (SELECT n AS k, 'S' || n AS name, (7 - n)::BIGINT AS sample_id FROM (SELECT DISTINCT n FROM lv))"


@raw_query("cmp03_newick_differences", O.newick("""
    , ed AS (SELECT tree_index, parent_id::BIGINT AS parent, CASE WHEN is_tip THEN 6 - node_id ELSE node_id END::BIGINT AS child
             FROM nn WHERE parent_id IS NOT NULL),
    a AS (SELECT tree_index, 'inserted' AS change, parent, child FROM ed e WHERE tree_index > 0 AND NOT EXISTS
      (SELECT 1 FROM ed b WHERE b.tree_index = e.tree_index - 1 AND b.parent = e.parent AND b.child = e.child)
     UNION ALL SELECT tree_index + 1, 'removed', parent, child FROM ed e WHERE tree_index < (SELECT max(tree_index) FROM ed)
      AND NOT EXISTS (SELECT 1 FROM ed b WHERE b.tree_index = e.tree_index + 1 AND b.parent = e.parent AND b.child = e.child))
    SELECT tree_index AS next_tree, change, parent, child FROM a"""))
def _(spark, sf_dir):
    tn = _newick_tree(spark, sf_dir).where(F.col("parent_id").isNotNull()).select(
        "tree_index", F.col("parent_id").alias("parent"), F.col("node_id").alias("child"))
    n = tn.select("tree_index").distinct()
    pairs = n.select(F.col("tree_index").cast("int").alias("pair"),
                     (F.col("tree_index") - 1).alias("prev_tree"),
                     F.col("tree_index").alias("next_tree")).where("next_tree > 0")
    return CMP.edge_differences(tn, pairs).select("next_tree", "change", "parent", "child")


def _keyed_windows(spark, sf_dir) -> DataFrame:
    return TOP.shape_keys(N.windows(ON.window_table(spark, sf_dir)))




@raw_query("cmp04_topology_keys", O.newick("""
    SELECT tree_index, topology FROM rows0 JOIN canon USING (orderkey)""", KEYS))
def _(spark, sf_dir):
    rows = _tree_rows(spark, sf_dir).select("tree_index", "newick")
    return TOP.topology_keys(rows).select("tree_index", "topology")


SHAPES = """
shp AS MATERIALIZED (SELECT w.*, CASE WHEN w.n_leaves = 1 THEN '(' || shape0 || ');' ELSE shape0 || ';' END AS topology
   FROM win w JOIN tk USING (orderkey))
"""


@raw_query("cmp05_shape_keys", O.newick(
    "SELECT chrom, idx, topology FROM shp", O.WINDOWS, KEYS, SHAPES))
def _(spark, sf_dir):
    return _keyed_windows(spark, sf_dir).select("chrom", "idx", "topology")


@raw_query("cmp06_ranked_topologies", O.newick("""
    , v AS (SELECT tree_index, topology, coalesce(max_branch_length, 0) AS len FROM rows0 JOIN canon USING (orderkey)),
    z AS (SELECT *, dense_rank() OVER (ORDER BY topology) - 1 AS topology_rank, min(len) OVER (PARTITION BY topology) AS lo,
          max(len) OVER (PARTITION BY topology) AS hi FROM v)
    SELECT tree_index, topology_rank, round(CASE WHEN hi > lo THEN (len - lo) / (hi - lo) ELSE 0.5 END, 6) AS length_share
    FROM z""", KEYS))
def _(spark, sf_dir):
    rows = _tree_rows(spark, sf_dir).select("tree_index", "newick", "max_branch_length")
    return TOP.ranked_topologies(TOP.topology_keys(rows)).select(
        "tree_index", "topology_rank", num("length_share").alias("length_share"))


@raw_query("cmp07_topology_runs", O.newick("""
    , f AS (SELECT *, coalesce(lag(topology) OVER (PARTITION BY chrom ORDER BY idx) <> topology, true)::INT AS new FROM shp),
    g AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY idx) - 1 AS run_id FROM f)
    SELECT chrom, run_id::BIGINT AS run_id, min(idx) AS start_idx, count(*) AS n_rows, any_value(topology) AS topology,
           md5(any_value(topology)) AS digest FROM g GROUP BY chrom, run_id""", O.WINDOWS, KEYS, SHAPES))
def _(spark, sf_dir):
    return TOP.topology_runs(_keyed_windows(spark, sf_dir))


@raw_query("cmp08_topology_summary", O.newick("""
    SELECT count(*) AS n_rows, count(DISTINCT topology) AS n_topologies,
      count(*) FILTER (tree_info IS DISTINCT FROM 'run' || (n_leaves % 7)) AS n_changed
    FROM rows0 JOIN canon USING (orderkey)""", KEYS))
def _(spark, sf_dir):
    rows = _tree_rows(spark, sf_dir).select("tree_index", "newick", "tree_info")
    leaves = F.size(X.leaf_names(F.col("newick")))
    new = F.concat(F.lit("run"), (leaves % 7).cast("string"))
    return TOP.topology_summary(TOP.topology_keys(rows), ~F.col("tree_info").eqNullSafe(new))


# ---- metadata -------------------------------------------------------------

@query("met01_decoded_metadata", O.trees("""
    SELECT node_id, name, CASE WHEN k % 3 = 0 THEN seg END AS segment, k % 3 = 0 AS has_tier FROM smp""", O.META))
def _(c):
    s = c.samples().select(F.col("id").alias("node_id"), J.decode(F.col("metadata_json")).alias("m"))
    return s.select("node_id", F.col("m")["name"].alias("name"), F.col("m")["segment"].alias("segment"),
                    F.map_contains_key("m", "tier").alias("has_tier"))


@query("met02_keys_by_source", O.trees("SELECT DISTINCT source, key FROM mrows", O.META))
def _(c):
    return MET.metadata_keys(c.nodes, c.individuals, c.populations)


@query("met02_key_menu", O.trees("""
    SELECT 0::BIGINT AS rank, 'sample' AS key UNION ALL
    SELECT row_number() OVER (ORDER BY key), key FROM (SELECT DISTINCT key FROM mrows)""", O.META))
def _(c):
    return MET.key_menu(MET.metadata_keys(c.nodes, c.individuals, c.populations))


@query("met03_values", O.trees(
    "SELECT node_id, name, coalesce(value, '-') AS value FROM vals", O.META))
def _(c):
    return MET.sample_values(R.samples(c), "segment").select(
        "node_id", "name", F.coalesce("value", F.lit("-")).alias("value"))


@query("met04_sample_key", O.trees("SELECT node_id, name AS value FROM smp", O.META))
def _(c):
    return MET.sample_values(R.samples(c), "sample").select("node_id", "value")


@query("met05_search", O.trees("SELECT node_id, name FROM vals WHERE value = 'building'", O.META))
def _(c):
    return MET.search_samples(R.samples(c), "segment", "building").select("node_id", "name")


@query("met06_encoded", O.trees("""
    , t AS (SELECT node_id, coalesce(value, '') AS value FROM vals),
    f AS (SELECT value, row_number() OVER (ORDER BY min(node_id)) - 1 AS code FROM t GROUP BY value)
    SELECT node_id, value, code FROM t JOIN f USING (value)""", O.META))
def _(c):
    return MET.encode(MET.sample_values(R.samples(c), "segment"))


@query("met07_posting_lists", O.trees("""
    SELECT value, node_id // 256 AS chunk, count(*) AS n, string_agg(node_id::VARCHAR, ',' ORDER BY node_id) AS node_ids
    FROM vals WHERE value IS NOT NULL GROUP BY ALL""", O.META))
def _(c):
    lists = MET.posting_lists(MET.sample_values(R.samples(c), "segment"), chunk=256)
    return lists.select("value", "chunk", "n", txt("node_ids").alias("node_ids"))


@query("met08_values_from_index", O.trees(
    "SELECT node_id, value FROM vals WHERE value IS NOT NULL", O.META))
def _(c):
    return MET.values_from_rows(MET.metadata_rows(R.samples(c)), "segment")


@query("met09_names_containing", O.trees("SELECT node_id, name FROM smp WHERE contains(lower(name), 'r#0000000')", O.META))
def _(c):
    return MET.names_containing(MET.name_index(R.samples(c)), "R#0000000")


def _asked_names(c) -> DataFrame:
    return R.samples(c).select(F.upper("name").alias("name"))


@query("met10_name_lookup", O.trees("SELECT node_id, upper(name) AS name FROM smp", O.META))
def _(c):
    return MET.find_names(MET.name_index(R.samples(c)), _asked_names(c)).select("node_id", "name")


@query("met11_names_in_trees", O.trees("""
    SELECT tree_index, node_id, upper(name) AS name FROM touch JOIN smp USING (node_id)""", O.META))
def _(c):
    return R.search_names(c, _asked_names(c)).select("tree_index", "node_id", "name")


@raw_query("met12_newick_names", O.newick(
    "SELECT tree_index, name, (7 - n)::BIGINT AS node_id FROM lvr l JOIN rows0 r ON r.orderkey = l.k, "
    "LATERAL (SELECT 'S' || l.n AS name) WHERE l.n IN (2, 5)"))
def _(spark, sf_dir):
    names = spark.createDataFrame([("S2",), ("S5",), ("s3",)], "name string")
    return N.tip_positions(_newick_tree(spark, sf_dir), names).select("tree_index", "name", "node_id")


@query("met13_highlight_positions", O.placed("""
    SELECT tree_index, node_id, round(x::DOUBLE, 6) AS x, round(y::DOUBLE, 6) AS y
    FROM placed JOIN vals USING (node_id) WHERE value = 'building'""", O.META, isolated=False))
def _(c):
    hits = MET.search_samples(R.samples(c), "segment", "building")
    out = MET.positions_of(hits, R.placed_nodes(c, isolated=False))
    return out.select("tree_index", "node_id", num("x").alias("x"), num("y").alias("y"))


@query("met14_multi_value_positions", O.placed("""
    , q(value) AS (VALUES ('building'), ('MACHINERY'), ('nobody'))
    SELECT q.value, coalesce(p.tree_index, -1) AS tree_index, coalesce(p.node_id, -1) AS node_id, coalesce(round(p.x::DOUBLE, 6), -1) AS x
    FROM q LEFT JOIN (SELECT * FROM placed JOIN vals USING (node_id)) p ON p.value = q.value""", O.META))
def _(c):
    wanted = c.spark.createDataFrame([("building",), ("MACHINERY",), ("nobody",), ("building",)],
                                     "value string")
    out = R.highlight_values(c, "segment", wanted)
    return out.select("value", C.sentinels(F.col("tree_index")).alias("tree_index"),
                      C.sentinels(F.col("node_id")).alias("node_id"),
                      F.coalesce(num("x"), F.lit(-1.0)).alias("x"))


@query("met14_value_counts", O.trees("""
    , q(value) AS (VALUES ('building'), ('MACHINERY'), ('nobody')),
    n AS (SELECT q.value, count(node_id) AS n_samples FROM q LEFT JOIN vals USING (value) GROUP BY q.value)
    SELECT value, n_samples, (SELECT sum(n_samples) FROM n)::BIGINT AS total FROM n""", O.META))
def _(c):
    wanted = c.spark.createDataFrame([("building",), ("MACHINERY",), ("nobody",), ("building",)], "value string")
    return R.count_values(c, "segment", wanted)


PATH_STEPS = """
    , deep AS (SELECT tree_index, seed, max(distance) AS depth FROM anc GROUP BY ALL),
    step AS (SELECT tree_index, seed, depth - distance AS step, node_id FROM anc JOIN deep USING (tree_index, seed) WHERE depth > 0)
"""


@query("met14_value_lineages", lineage_sql(PATH_STEPS + """
    SELECT tree_index, seed, step::BIGINT AS step, step.node_id, value FROM step JOIN vals ON vals.node_id = seed
    WHERE value IN ('building', 'MACHINERY') AND tree_index IN (3, 40, 41)""", O.META, isolated=False))
def _(c):
    wanted = c.spark.createDataFrame([("building",), ("MACHINERY",), ("nobody",)], "value string")
    out = R.value_lineages(c, "segment", wanted, [3, 40, 41])
    return out.select("tree_index", "seed", F.col("step").cast("long").alias("step"), "node_id", "value")


@query("met11_name_lineages", lineage_sql(PATH_STEPS + """
    SELECT tree_index, seed, step::BIGINT AS step, step.node_id, upper(name) AS name FROM step JOIN smp ON smp.node_id = seed
    WHERE tree_index BETWEEN 20 AND 30""", O.META, isolated=False))
def _(c):
    trees = c.intervals.where("tree_index between 20 and 30").select("tree_index")
    out = R.name_lineages(c, _asked_names(c), trees)
    return out.select("tree_index", "seed", F.col("step").cast("long").alias("step"), "node_id", "name")


@query("met15_trees_with_samples", O.trees("""
    SELECT DISTINCT tree_index FROM touch JOIN vals USING (node_id) WHERE value = 'building'""", O.META))
def _(c):
    runs = c.runs(isolated=False)
    hits = MET.search_samples(R.samples(c), "segment", "building")
    return MET.trees_of_nodes(T.membership_ranges(runs, c.loc.n_trees), hits, c.intervals)


@query("met16_values_matching", O.trees(
    "SELECT DISTINCT value FROM vals WHERE contains(lower(value), 'in')", O.META))
def _(c):
    return MET.values_matching(MET.sample_values(R.samples(c), "segment"), " IN ")


@query("met21_tip_labels", O.trees("""
    SELECT tree_index, node_id, CASE WHEN value IN ('building', 'MACHINERY') THEN value ELSE 'other' END AS label
    FROM tnb LEFT JOIN vals USING (node_id) WHERE is_tip""", O.META))
def _(c):
    tips = c.tree_nodes(isolated=False).where("is_tip").select("tree_index", "node_id")
    on = c.spark.createDataFrame([("building",), ("MACHINERY",)], "value string")
    return MET.tip_labels(tips, MET.sample_values(R.samples(c), "segment"), on).select(
        "tree_index", "node_id", "label")


@raw_query("met23_presets", """
    SELECT n_name AS project, 'region' || n_regionkey AS filename, s_name AS label, s_suppkey AS id
    FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3' AND n_regionkey = 3""")
def _(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    presets = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("project"),
        F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("filename"),
        F.col("s_name").alias("label"), F.col("s_suppkey").alias("id"))
    return MET.presets_for(presets, "NATION_3", "region3")


# ---- details and mutations ------------------------------------------------

@query("det01_node_records", O.trees("""
    SELECT id, flags, time, coalesce(population, -1) AS population, coalesce(individual, -1) AS individual,
           coalesce(s.name, '-') AS name FROM nodes LEFT JOIN smp s ON s.node_id = id""", O.META))
def _(c):
    r = DET.node_records(c.nodes)
    return r.select("id", "flags", "time", C.sentinels(F.col("population")).alias("population"),
                    C.sentinels(F.col("individual")).alias("individual"),
                    F.coalesce(F.col("metadata")["name"], F.lit("-")).alias("name"))


@query("det02_individual_records", O.trees("""
    SELECT i.id, i.flags, coalesce(array_to_string(i.location, ','), '-') AS location, (i.id + 100)::VARCHAR AS nodes,
      json_extract_string(i.metadata_json, '$.segment') AS segment FROM individuals i""", O.META))
def _(c):
    r = DET.individual_records(c.individuals, c.nodes)
    return r.select("id", "flags", F.coalesce(txt("location"), F.lit("-")).alias("location"),
                    txt("nodes").alias("nodes"), F.col("metadata")["segment"].alias("segment"))


@query("det03_population_records", O.trees("""
    SELECT id, json_extract_string(metadata_json, '$.nation') AS nation,
           json_extract_string(metadata_json, '$.region') AS region FROM populations""", O.META))
def _(c):
    m = F.col("metadata")
    return DET.population_records(c.populations).select("id", m["nation"].alias("nation"),
                                                        m["region"].alias("region"))


@query("det04_site_records", O.trees(
    "SELECT id, position, ancestral_state FROM sites", O.MUTS))
def _(c):
    return DET.site_records(c.sites).drop("metadata")


@query("det05_tree_records", O.trees("""
    SELECT tree_index, lft AS interval_left, rgt AS interval_right, count(*) FILTER (parent_id IS NULL) AS n_roots,
           count(*) AS n_nodes FROM tna JOIN iv USING (tree_index) GROUP BY ALL"""))
def _(c):
    r = DET.tree_records(c.runs(), c.loc)
    return r.select("tree_index", F.col("left").alias("interval_left"),
                    F.col("right").alias("interval_right"), "n_roots", "n_nodes")


@query("det05_tree_mutations", O.trees("""
    , r AS (SELECT *, row_number() OVER (ORDER BY position, id) - 1 AS rn FROM muts)
    SELECT tree_index, rn // 500 AS chunk, count(*) AS n,
      string_agg(id || ':' || node_id || inherited_state || derived_state, ',' ORDER BY id) AS mutations
    FROM r WHERE tree_index IS NOT NULL GROUP BY ALL""", O.MUTS))
def _(c):
    rows = MUT.numbered(R.located_mutations(c)).where(F.col("tree_index").isNotNull())
    lists = DET.tree_mutation_lists(rows, chunk=500)
    entry = F.transform("mutations", lambda m: F.concat(
        m["id"].cast("string"), F.lit(":"), m["node_id"].cast("string"), m["inherited_state"],
        m["derived_state"]))
    return lists.select("tree_index", "chunk", F.size("mutations").cast("long").alias("n"),
                        F.array_join(entry, ",").alias("mutations"))


@query("det06_node_details", O.trees("""
    SELECT id, time, coalesce(nation, '-') AS nation, CASE WHEN individual IS NULL OR k % 6 = 0 THEN '-' ELSE lower(seg) END AS segment
    FROM nodes LEFT JOIN smp ON node_id = id""", O.META))
def _(c):
    d = DET.node_details(c.nodes, c.individuals, c.populations)
    return d.select("id", "time", F.coalesce(F.col("population_meta")["nation"], F.lit("-")).alias("nation"),
                    F.coalesce(F.col("individual_meta")["segment"], F.lit("-")).alias("segment"))


@query("mut01_window", O.trees("""
    SELECT position::BIGINT AS position, ancestral_state || '->' || derived_state AS mutation, node_id::INT AS node_id,
      site_id::INT AS site_id, tree_index, interval_left, interval_right FROM muts
    WHERE position >= 1500 AND position < 2500 ORDER BY muts.position, id LIMIT 1000 OFFSET 500""", O.MUTS))
def _(c):
    return R.mutation_window(c, START, END, 500, 1000).select(
        "position", "mutation", "node_id", "site_id", "tree_index", "interval_left", "interval_right")


@query("mut01_window_totals", O.trees("""
    SELECT count(*) AS total_count, 1500 < count(*) AS has_more FROM muts WHERE position >= 1500 AND position < 2500""", O.MUTS))
def _(c):
    rows = MUT.in_window(MUT.with_sites(c.mutations, c.sites), START, END, c.length)
    return MUT.page_summary(rows, 500, 1000)


@query("mut02_near_position", O.trees("""
    SELECT position::BIGINT AS position, ancestral_state || '->' || derived_state AS mutation, node_id::INT AS node_id,
      abs(position - 2000.5)::BIGINT AS distance, tree_index FROM (
      SELECT * FROM muts WHERE position >= 1750.5 AND position < 2250.5
      ORDER BY abs(position - 2000.5), position, id LIMIT 300 OFFSET 20)""".replace(
    "abs(position - 2000.5)::BIGINT", "trunc(abs(position - 2000.5))::BIGINT"), O.MUTS))
def _(c):
    return R.mutations_near(c, 2000.5, 500, 20, 300).select(
        "position", "mutation", "node_id", "distance", "tree_index")


_STORES: dict[int, STORE.Store] = {}


def _store(c) -> STORE.Store:
    """The stored mutations of a collection, written once per application."""
    if id(c) not in _STORES:
        _STORES[id(c)] = R.stored_mutations(c, f"{checkpoint_dir(c.spark)}/mutations-{uuid4().hex}", block_rows=4096)
    return _STORES[id(c)]


@query("mut01_stored_window", O.trees("""
    SELECT position::BIGINT AS position, ancestral_state || '->' || derived_state AS mutation, node_id::INT AS node_id,
      site_id::INT AS site_id, tree_index, interval_left, interval_right FROM muts
    WHERE position >= 1500 AND position < 2500 ORDER BY muts.position, id LIMIT 1000 OFFSET 1200""", O.MUTS))
def _(c):
    return R.stored_window(c, _store(c), START, END, 1200, 1000).select(
        "position", "mutation", "node_id", "site_id", "tree_index", "interval_left", "interval_right")


@query("mut01_stored_continuation", O.trees("""
    , k AS (SELECT id FROM muts WHERE position >= 1000 AND position < 2500 ORDER BY muts.position, id LIMIT 1 OFFSET 700),
    p AS (SELECT position, id FROM muts WHERE id = (SELECT id FROM k))
    SELECT position::BIGINT AS position, ancestral_state || '->' || derived_state AS mutation, node_id::INT AS node_id, tree_index
    FROM muts WHERE position < 2500 AND (position, id) > (SELECT (position, id) FROM p) ORDER BY muts.position, id LIMIT 1000""",
    O.MUTS))
def _(c):
    key = STORE.window_page(_store(c), 1000.0, END, 700, 1).select("position", "id").first()
    return R.stored_window(c, _store(c), 1000.0, END, limit=1000, after=tuple(key)).select(
        "position", "mutation", "node_id", "tree_index")


@query("mut01_stored_totals", O.trees("""
    SELECT count(*) AS total_count, 1500 < count(*) AS has_more FROM muts WHERE position >= 1500 AND position < 2500""", O.MUTS))
def _(c):
    return STORE.window_summary(_store(c), START, END, 500, 1000)


@query("mut02_stored_near", O.trees("""
    SELECT position::BIGINT AS position, ancestral_state || '->' || derived_state AS mutation, node_id::INT AS node_id,
      trunc(abs(position - 2000.5))::BIGINT AS distance, tree_index FROM (
      SELECT * FROM muts WHERE position >= 1750.5 AND position < 2250.5
      ORDER BY abs(position - 2000.5), position, id LIMIT 300 OFFSET 20)""", O.MUTS))
def _(c):
    return R.stored_near(c, _store(c), 2000.5, 500, 20, 300).select(
        "position", "mutation", "node_id", "distance", "tree_index")


@query("mut04_stored_on_node", O.trees("""
    SELECT id, position FROM muts WHERE node_id = 107 AND position >= 1500 AND position < 2500""", O.MUTS))
def _(c):
    return STORE.on_node(_store(c), 107, START, END).select("id", "position")


@query("mut03_with_interval", O.trees(
    "SELECT id, tree_index, interval_left, interval_right FROM muts", O.MUTS))
def _(c):
    return R.located_mutations(c, bounds=True).select("id", "tree_index", "interval_left",
                                                      "interval_right")


@query("mut04_mutation_records", O.trees("""
    SELECT id, node_id, site_id, position, ancestral_state, derived_state, coalesce(time, -1) AS time,
           coalesce(parent_id, -1) AS parent_mutation FROM muts""", O.MUTS))
def _(c):
    r = DET.mutation_records(MUT.with_sites(c.mutations, c.sites))
    return r.select("id", "node_id", "site_id", "position", "ancestral_state", "derived_state",
                    F.coalesce("time", F.lit(-1.0)).alias("time"),
                    C.sentinels(F.col("parent_mutation")).alias("parent_mutation"))


@query("mut04_on_node_in_range", O.trees("""
    SELECT id, position FROM muts WHERE node_id = 107
      AND position >= (SELECT min(lft) FROM iv WHERE rgt > 1500 AND lft < 2500)
      AND position < (SELECT max(rgt) FROM iv WHERE rgt > 1500 AND lft < 2500)""", O.MUTS))
def _(c):
    bounds = I.trees_in_range(c.intervals, START, END).agg(F.min("left").alias("left"),
                                                           F.max("right").alias("right"))
    return MUT.on_node(MUT.with_sites(c.mutations, c.sites), 107, bounds).select("id", "position")


@query("mut05_edges_of_nodes", O.trees("""
    SELECT parent AS node_id, 'as_parent' AS role, id, lft AS edge_left, rgt AS edge_right FROM edges
    UNION ALL SELECT child, 'as_child', id, lft, rgt FROM edges"""))
def _(c):
    return DET.edges_of_nodes(c.edges).select(
        "node_id", "role", "id", F.col("left").alias("edge_left"), F.col("right").alias("edge_right"))


@query("mut06_changed_by_node", O.trees("""
    , r AS (SELECT *, row_number() OVER (ORDER BY position, id) - 1 AS rn FROM muts)
    SELECT node_id, rn // 4096 AS chunk, string_agg(ancestral_state || position::BIGINT || derived_state, ',' ORDER BY rn) AS labels
    FROM r WHERE ancestral_state <> derived_state GROUP BY ALL""", O.MUTS))
def _(c):
    lists = MUT.changed_by_node(MUT.numbered(MUT.with_sites(c.mutations, c.sites)), chunk=4096)
    return lists.select("node_id", "chunk", F.array_join(
        F.transform("mutations", lambda m: m["label"]), ",").alias("labels"))


@query("mut07_last_by_position", O.trees("""
    SELECT position::BIGINT AS position, arg_max(ancestral_state || '->' || derived_state, id) AS mutation,
           arg_max(node_id, id) AS node FROM muts WHERE ancestral_state <> derived_state GROUP BY ALL""", O.MUTS))
def _(c):
    return MUT.last_by_position(MUT.with_sites(c.mutations, c.sites))


@query("mut08_labels", O.trees("""
    SELECT ancestral_state || '->' || derived_state AS mutation, count(*) AS n FROM muts GROUP BY ALL""", O.MUTS))
def _(c):
    rows = MUT.with_sites(c.mutations, c.sites)
    return rows.groupBy(MUT.label(F.col("ancestral_state"), F.col("derived_state"))
                        .alias("mutation")).agg(F.count("*").alias("n"))


# ---- Newick ---------------------------------------------------------------

@raw_query("src02_tree_rows", O.newick(
    "SELECT tree_index, position, newick, coalesce(tree_info, '-') AS tree_info FROM rows0"))
def _(spark, sf_dir):
    return _tree_rows(spark, sf_dir).select("tree_index", "position", "newick",
                                            F.coalesce("tree_info", F.lit("-")).alias("tree_info"))


@raw_query("src03_paired_lines", O.newick("""
    SELECT tree_index, newick, position AS interval_left, coalesce(lead(position) OVER (ORDER BY position), position + 10000)
      AS interval_right FROM rows0"""))
def _(spark, sf_dir):
    rows = _tree_rows(spark, sf_dir).repartitionByRange("position").sortWithinPartitions("position")
    folder = f"{checkpoint_dir(spark)}/paired-{uuid4().hex}"
    rows.select(F.col("newick").alias("value")).write.text(f"{folder}/trees")
    rows.select(F.col("position").cast("long").cast("string").alias("value")).write.text(
        f"{folder}/positions")
    return N.read_paired(spark, f"{folder}/trees", f"{folder}/positions").select(
        "tree_index", "newick", F.col("left").alias("interval_left"),
        F.col("right").alias("interval_right"))


EDGE_ROWS = O.trees("SELECT id, lft AS edge_left, rgt AS edge_right, parent, child FROM edges")


def _edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select("id", F.col("left").alias("edge_left"), F.col("right").alias("edge_right"),
                        "parent", "child")


@query("src01_loaded_edges", EDGE_ROWS)
def _(c):
    folder = f"{checkpoint_dir(c.spark)}/tables-{uuid4().hex}"
    c.edges.write.parquet(f"{folder}/edges.parquet")
    return _edge_rows(tables.load_table(c.spark, folder, "edges"))


ALL_TABLES = O.trees("""
    SELECT 'nodes' AS source, id, time AS a, flags::DOUBLE AS b, coalesce(population, -1) AS c, coalesce(individual, -1) AS d,
      metadata_json AS content FROM nodes
    UNION ALL SELECT 'edges', id, lft, rgt, parent, child, '' FROM edges
    UNION ALL SELECT 'sites', id, position, 0, 0, 0, ancestral_state FROM sites
    UNION ALL SELECT 'mutations', id, coalesce(time, -1), site_id::DOUBLE, node_id, coalesce(parent_id, -1), derived_state FROM mutations
    UNION ALL SELECT 'individuals', id, coalesce(location[1], -1), coalesce(location[2], -1), flags, coalesce(len(location), -1),
      metadata_json FROM individuals
    UNION ALL SELECT 'populations', id, 0, 0, 0, 0, metadata_json FROM populations""", O.MUTS, O.META)


def _all_tables(c: Collection, fmt: str) -> DataFrame:
    """Every row of all six tables after writing and loading them."""
    folder = f"{checkpoint_dir(c.spark)}/tables-{uuid4().hex}"
    tables.save_tables({name: getattr(c, name) for name in tables.REQUIRED}, folder, fmt)
    t = tables.load_tables(c.spark, folder, fmt)

    def rows(name, a="0D", b="0D", c="0L", d="0L", content="''"):
        return t[name].selectExpr(f"'{name}' AS source", "id", f"CAST({a} AS double) AS a", f"CAST({b} AS double) AS b",
                                  f"{c} AS c", f"{d} AS d", f"{content} AS content")
    return (rows("nodes", "time", "flags", "coalesce(population, -1L)", "coalesce(individual, -1L)", "metadata_json")
            .unionByName(rows("edges", "left", "right", "parent", "child"))
            .unionByName(rows("sites", "position", content="ancestral_state"))
            .unionByName(rows("mutations", "coalesce(time, -1D)", "site_id", "node_id", "coalesce(parent_id, -1L)", "derived_state"))
            .unionByName(rows("individuals", "coalesce(get(location, 0), -1D)", "coalesce(get(location, 1), -1D)", "flags",
                              "coalesce(CAST(array_size(location) AS long), -1L)", "metadata_json"))
            .unionByName(rows("populations", content="metadata_json")))


@query("src01_loaded_tables", ALL_TABLES)
def _(c):
    return _all_tables(c, "parquet")


@query("src01_loaded_csv_tables", ALL_TABLES)
def _(c):
    return _all_tables(c, "csv")


@query("src07_landed_edges", EDGE_ROWS)
def _(c):
    folder = f"{checkpoint_dir(c.spark)}/landing-{uuid4().hex}"
    c.edges.write.parquet(f"{folder}/inbox")
    stream = landing.landing_stream(c.spark, f"{folder}/inbox", "edges")
    landing.append_table(stream, f"{folder}/table", "edges", f"{folder}/offsets").awaitTermination()
    return _edge_rows(c.spark.read.parquet(f"{folder}/table"))


@raw_query("src04_windows", O.newick("""
    SELECT chrom, idx, start_bp, end_bp, newick FROM win""", O.WINDOWS))
def _(spark, sf_dir):
    return N.windows(ON.window_table(spark, sf_dir)).select(
        "chrom", "idx", F.col("start").alias("start_bp"), F.col("end").alias("end_bp"), "newick")


@raw_query("src05_newick_nodes", O.newick("""
    SELECT tree_index, postorder::BIGINT AS postorder, is_tip, coalesce(name, '-') AS name, branch_length, root_distance,
      CASE WHEN is_tip THEN 6 - node_id ELSE node_id END::BIGINT AS node_id, coalesce(parent_id, -1)::BIGINT AS parent_id FROM nn"""))
def _(spark, sf_dir):
    return _newick_tree(spark, sf_dir).select(
        "tree_index", "postorder", "is_tip", F.coalesce("name", F.lit("-")).alias("name"),
        "branch_length", "root_distance", "node_id",
        C.sentinels(F.col("parent_id")).alias("parent_id"))


HEIGHTS = """
hh AS (SELECT max(max_branch_length) AS height FROM rows0),
th AS (SELECT tree_index, max(root_distance) AS h FROM nn GROUP BY ALL),
ny AS MATERIALIZED (SELECT nn.tree_index, postorder, is_tip, least(1.0, greatest(0.0,
   1.0 - (coalesce(CASE WHEN r.max_branch_length > 0 THEN r.max_branch_length END, h) - root_distance) / height)) AS y
   FROM nn JOIN th USING (tree_index) JOIN rows0 r USING (tree_index), hh)
"""


def _newick_placed(spark, sf_dir, shift: bool) -> DataFrame:
    rows = _tree_rows(spark, sf_dir)
    parsed = cut(N.newick_nodes(rows))
    return N.newick_y(parsed, rows, N.global_height(rows).scalar(), shift)


@raw_query("tre19_newick_y", O.newick(
    "SELECT tree_index, postorder::BIGINT AS postorder, round(y, 6) AS y FROM ny", HEIGHTS))
def _(spark, sf_dir):
    return _newick_placed(spark, sf_dir, False).select("tree_index", "postorder", num("y").alias("y"))


@raw_query("tre20_shifted_y", O.newick("""
    SELECT tree_index, postorder::BIGINT AS postorder,
      round(least(1.0, greatest(0.0, y + 1.0 - max(y) FILTER (is_tip) OVER (PARTITION BY tree_index))), 6) AS y FROM ny""", HEIGHTS))
def _(spark, sf_dir):
    return _newick_placed(spark, sf_dir, True).select("tree_index", "postorder", num("y").alias("y"))


@raw_query("tre21_newick_x", O.newick("""
    , rung(tree_index, postorder, x, lvl, nl) AS (
      SELECT tree_index, (nl + 0)::BIGINT, CASE WHEN nl = 1 THEN 0.0 ELSE (nl - 2 + nl - 1) / 2.0 END, 0, nl FROM nn WHERE is_tip AND j = 1
      UNION ALL SELECT tree_index, postorder + 1, (x + (nl - 3 - lvl)) / 2.0, lvl + 1, nl FROM rung WHERE lvl < nl - 2)
    SELECT tree_index, postorder::BIGINT AS postorder, round((x / greatest(1, nl - 1))::REAL::DOUBLE, 6) AS x FROM rung
    UNION ALL SELECT tree_index, postorder::BIGINT, round(((j - 1)::DOUBLE / greatest(1, nl - 1))::REAL::DOUBLE, 6) FROM nn WHERE is_tip"""))
def _(spark, sf_dir):
    tree = N.with_postorder_ids(N.newick_nodes(_tree_rows(spark, sf_dir)))
    return N.newick_x(tree).select("tree_index", F.col("node_id").alias("postorder"), num("x").alias("x"))


@raw_query("tre22_without_outgroup", O.newick("""
    , big AS (SELECT k FROM lvr WHERE n = 7),
    back(orderkey, j, enc) AS (
      SELECT k, 1, 'S' || n FROM lvr WHERE j = 1 AND nl > 1 AND k IN (SELECT k FROM big)
      UNION ALL
      SELECT l.k, l.j, CASE WHEN back.enc < 'S' || l.n THEN '(' || back.enc || ',S' || l.n || ')'
                            ELSE '(S' || l.n || ',' || back.enc || ')' END
      FROM back JOIN lvr l ON l.k = back.orderkey AND l.j = back.j + 1 WHERE l.j < l.nl),
    done AS (SELECT orderkey, arg_max(enc, j) AS enc FROM back GROUP BY ALL)
    SELECT tree_index, CASE WHEN orderkey NOT IN (SELECT k FROM big) THEN canon.topology
      ELSE coalesce(done.enc, '') END AS topology
    FROM rows0 JOIN canon USING (orderkey) LEFT JOIN done USING (orderkey)""", KEYS))
def _(spark, sf_dir):
    rows = _tree_rows(spark, sf_dir).select("tree_index", "newick")
    return TOP.topology_keys(rows, outgroup="s7").select("tree_index", "topology")


@raw_query("tre23_node_heights", O.newick("""
    SELECT tree_index, postorder::BIGINT AS postorder, h AS height, h - root_distance AS node_height FROM nn JOIN th USING (tree_index)""", HEIGHTS))
def _(spark, sf_dir):
    parsed = cut(N.newick_nodes(_tree_rows(spark, sf_dir)))
    return N.with_node_height(parsed).select(
        "tree_index", "postorder", "height", "node_height")


@raw_query("nwk01_labels", O.newick(
    "SELECT tree_index, names AS labels, names AS leaves FROM rows0"))
def _(spark, sf_dir):
    return _tree_rows(spark, sf_dir).select(
        "tree_index", F.array_join(X.labels(F.col("newick")), ",").alias("labels"),
        F.array_join(X.leaf_names(F.col("newick")), ",").alias("leaves"))


@raw_query("nwk02_longest_edge", O.newick("""
    SELECT tree_index, greatest(top, CASE WHEN n_leaves > 2 THEN 1.0 ELSE 0.0 END) AS longest FROM rows0"""))
def _(spark, sf_dir):
    return _tree_rows(spark, sf_dir).select("tree_index",
                                            X.longest_edge(F.col("newick")).alias("longest"))


@raw_query("nwk03_global_height", O.newick("SELECT height FROM hh", HEIGHTS))
def _(spark, sf_dir):
    return N.global_height(_tree_rows(spark, sf_dir))


@raw_query("nwk04_file_metadata", O.newick(
    "SELECT 'samples' AS key, 'S' || n AS value FROM (SELECT DISTINCT n FROM lv)"))
def _(spark, sf_dir):
    return N.file_metadata(ON.raw_table(spark, sf_dir)).select("key", "value")


@raw_query("nwk05_tree_info", O.newick(
    "SELECT tree_index, tree_info FROM rows0 WHERE tree_info IS NOT NULL"))
def _(spark, sf_dir):
    return N.tree_info(_tree_rows(spark, sf_dir))


@raw_query("nwk06_sample_order", O.newick("""
    SELECT 'S' || n AS name, row_number() OVER (ORDER BY n) - 1 AS sample_id FROM (SELECT DISTINCT n FROM lv)"""))
def _(spark, sf_dir):
    return N.sample_order(_tree_rows(spark, sf_dir))


@raw_query("nwk06_listed_order", O.newick("""
    SELECT 'S' || n AS name, row_number() OVER (ORDER BY n DESC) - 1 AS sample_id FROM (SELECT DISTINCT n FROM lv)"""))
def _(spark, sf_dir):
    raw = ON.raw_table(spark, sf_dir)
    return N.sample_order(N.tree_rows(raw), N.file_metadata(raw))


GAPS = """
gp AS MATERIALIZED (SELECT *, coalesce(lag(idx) OVER (PARTITION BY chrom ORDER BY idx) <> idx - 1, false) AS after_gap FROM win)
"""


@raw_query("nwk08_gaps", O.newick("SELECT chrom, idx, after_gap FROM gp", O.WINDOWS, GAPS))
def _(spark, sf_dir):
    return TOP.with_gaps(N.windows(ON.window_table(spark, sf_dir))).select("chrom", "idx", "after_gap")


@raw_query("snk11_chromosome_rows", O.newick("""
    , seen AS (SELECT chrom, s.n, arg_min(s.idx, (s.idx, s.j)) AS fi, arg_min(s.j, (s.idx, s.j)) AS fp
               FROM (SELECT w.chrom, w.idx, l.n, l.j FROM win w JOIN lvr l ON l.k = w.orderkey) s GROUP BY ALL),
    nm AS (SELECT chrom, 'S' || n AS name, row_number() OVER (PARTITION BY chrom ORDER BY fi, fp) AS r FROM seen),
    kept AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY idx) AS r FROM gp WHERE NOT after_gap)
    SELECT k.chrom, start_bp AS genomic_positions, greatest(top, CASE WHEN n_leaves > 2 THEN 1.0 ELSE 0.0 END) AS max_branch_length,
           coalesce(nm.name, '') AS samples FROM kept k LEFT JOIN nm ON nm.chrom = k.chrom AND nm.r = k.r""", O.WINDOWS, GAPS))
def _(spark, sf_dir):
    rows = N.windows(ON.window_table(spark, sf_dir))
    kept = TOP.with_gaps(rows, fold_gaps=True)
    out = TOP.samples_down_rows(kept, TOP.first_seen_samples(rows))
    return out.select("chrom", F.col("start").alias("genomic_positions"),
                      X.longest_edge(F.col("newick"), X.LENGTH_PLAIN).alias("max_branch_length"), "samples")


# ---- very many trees --------------------------------------------------------

def lines_query(name: str, sql: str):
    """Register a query over the collection of order lines."""
    def add(build: Callable[[Collection], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(LN.lines_collection(spark, sf_dir))
        ORACLE[name] = O.sql(sql, LN.SQL)
        return build
    return add


@lines_query("many_tre01_active_edges", "SELECT tree_index, child, parent FROM ed")
def _(c):
    return c.tree_edges().select("tree_index", "child", "parent")


@lines_query("many_tre05_membership", "SELECT tree_index, node_id, coalesce(parent_id, -1) AS parent_id FROM tn")
def _(c):
    return c.tree_nodes(isolated=False).select("tree_index", "node_id", C.sentinels(F.col("parent_id")).alias("parent_id"))


@lines_query("many_tre15_request", """
    SELECT tree_index, node_id, coalesce(parent_id, -1) AS parent_id FROM tn JOIN iv USING (tree_index)
    WHERE lft < (SELECT (min(lft) + max(rgt)) / 2 FROM iv)""")
def _(c):
    asked = c.intervals.where(F.col("left") < (c.loc.begin + c.loc.end) / 2).select("tree_index")   # half of the genome
    return c.tree_nodes(asked, isolated=False).select("tree_index", "node_id", C.sentinels(F.col("parent_id")).alias("parent_id"))


@lines_query("many_tre15_both_ends", """
    SELECT tree_index, node_id, coalesce(parent_id, -1) AS parent_id FROM tn JOIN iv USING (tree_index)
    WHERE lft < (SELECT min(lft) + (max(rgt) - min(lft)) / 10 FROM iv) OR rgt > (SELECT max(rgt) - (max(rgt) - min(lft)) / 10 FROM iv)""")
def _(c):
    tenth = (c.loc.end - c.loc.begin) / 10                                     # two stretches, a tenth of the genome each
    asked = c.intervals.where((F.col("left") < c.loc.begin + tenth) | (F.col("right") > c.loc.end - tenth)).select("tree_index")
    return c.tree_nodes(asked, isolated=False).select("tree_index", "node_id", C.sentinels(F.col("parent_id")).alias("parent_id"))


@lines_query("many_tre24_statistics", """
    SELECT tree_index, 100.0 AS root_time, sum(z.time - a.time)::DOUBLE AS total_branch_length, 1::BIGINT AS n_roots
    FROM ed JOIN tm a ON a.id = child JOIN tm z ON z.id = parent GROUP BY tree_index""")
def _(c):
    stats = T.tree_statistics(c.runs(isolated=False), c.loc)
    return stats.select("tree_index", "root_time", num("total_branch_length").alias("total_branch_length"), "n_roots")


@lines_query("many_snk05_membership_ranges", """
    SELECT node_id, min(tree_index) AS first_tree, max(tree_index) + 1 AS last_tree FROM (
      SELECT node_id, tree_index, tree_index - row_number() OVER (PARTITION BY node_id ORDER BY tree_index) AS island FROM tn)
    GROUP BY node_id, island""")
def _(c):
    return T.membership_ranges(c.runs(isolated=False), c.loc.n_trees)


@lines_query("many_mut03_with_interval", """
    SELECT k * 10 + n AS id, tree_index, lft AS interval_left, rgt AS interval_right FROM ll JOIN iv USING (k)""")
def _(c):
    return R.located_mutations(c, bounds=True).select("id", "tree_index", "interval_left", "interval_right")


@lines_query("many_lin01_ancestors_of_tips", """
    SELECT tree_index, a.child AS seed, b.node_id FROM ed a JOIN tn b USING (tree_index)
    WHERE a.child < 99 AND (b.node_id = 99 OR b.node_id BETWEEN 101 AND a.parent)""")
def _(c):
    tn = c.written_nodes(isolated=False)
    return LIN.ancestor_pairs(tn, F.col("is_tip"), include_self=False).select("tree_index", "seed", "node_id")


# ---- very deep trees -------------------------------------------------------

def ladder_query(name: str, sql: str):
    """Register a query over the ladders of orders: their steps and their nodes."""
    def add(build: Callable[[DataFrame, DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(*LD.ladders(spark, sf_dir))
        ORACLE[name] = O.sql(sql, LD.SQL)
        return build
    return add


@ladder_query("deep_lin02_descendant_counts", """
    SELECT tree_index, 2 * k AS node_id, 2 * (m - j) + 1 AS n_descendants, m - j + 1 AS n_tips FROM lo""")
def _(steps, tn):
    return LIN.descendant_counts(tn)


@ladder_query("deep_lin03_descendant_tips", """
    SELECT tree_index, q AS query_node, 2 * k + 1 AS node_id, j - qj + 1 AS distance FROM lo JOIN mid USING (tree_index)
    WHERE j >= qj""")
def _(steps, tn):
    return LIN.descendants(tn, LD.middles(steps), tips_only=True).drop("is_tip")


@ladder_query("deep_lin05_subtree_edges", """
    SELECT tree_index, q AS query_node, 2 * k AS parent, 2 * k + 1 AS child FROM lo JOIN mid USING (tree_index) WHERE j >= qj
    UNION ALL SELECT tree_index, q, 2 * b.k, 2 * a.k FROM lo a JOIN lo b USING (tree_index) JOIN mid USING (tree_index)
    WHERE b.j = a.j - 1 AND b.j >= qj""")
def _(steps, tn):
    return LIN.subtree_edges(tn, LD.middles(steps))


@ladder_query("deep_lin06_common_ancestor", """
    SELECT tree_index, 2 * min(k) AS mrca FROM lo WHERE s = 'F' GROUP BY tree_index HAVING count(*) > 1""")
def _(steps, tn):
    seeds = steps.where("status = 'F'").select("tree_index", (F.col("k") * 2 + 1).alias("node_id"))
    return LIN.common_ancestor(tn, seeds).select("tree_index", "mrca")


@ladder_query("deep_lin06_pair_ancestors", """
    SELECT * FROM (SELECT tree_index, 2 * lag(k) OVER w + 1 AS a, 2 * k + 1 AS b, 2 * lag(k) OVER w AS mrca FROM lo
    WINDOW w AS (PARTITION BY tree_index, c ORDER BY k)) WHERE a IS NOT NULL""")
def _(steps, tn):
    by_customer = Window.partitionBy("tree_index", "cust").orderBy("k")        # orders of one customer
    pairs = steps.select("tree_index", (F.lag("k").over(by_customer) * 2 + 1).alias("a"), (F.col("k") * 2 + 1).alias("b"))
    return NEST.pair_ancestors(tn, pairs.where("a IS NOT NULL"))


@ladder_query("deep_nested_numbers_by_joins", """
    SELECT tree_index, 2 * k AS node_id, 2 * (j - 1) AS enter, 2 * m AS leave, j - 1 AS depth, m - j + 1 AS n_tips FROM lo
    UNION ALL SELECT tree_index, 2 * k + 1, 2 * j - 1, 2 * j, j, 1 FROM lo""")
def _(steps, tn):
    rows = NEST.nested(tn, kernel_nodes=1000)              # as trees of many millions of nodes are numbered
    return rows.select("tree_index", "node_id", "enter", "leave", "depth", "n_tips")
