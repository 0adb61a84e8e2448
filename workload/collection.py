"""A tree collection derived from order data.

Customers are samples that hang below nations, nations below regions, regions
below one root; which nation a customer hangs below changes with the months of
its orders, so every month opens a new tree. Ship dates of line items are
mutations. All tables grow with the input; the registered queries run on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from copse.plans.collection import Collection, open_collection
from copse.session import written

LENGTH = 4000.0
MIDDLE = 2500.0
SAMPLE_BASE = 100
ROOT, UNARY = 99, 50


def _day(c) -> F.Column:
    return F.datediff(c, F.lit("1992-01-01").cast("date")).cast("double")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge per customer and month of orders, up to its next such month."""
    months = _read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cust"),
        F.trunc("o_orderdate", "month").alias("m")).distinct()
    shifted = months.select("cust", _day("m").alias("left"),
                            (F.year("m") * 12 + F.month("m")).alias("k"))
    # At most one row per month and customer: a bounded group.
    after = F.lead("left").over(Window.partitionBy("cust").orderBy("left"))
    return shifted.select(
        "left", F.coalesce(after, F.lit(LENGTH)).alias("right"),
        (F.lit(10) + F.pmod(F.col("cust") + F.lit(7) * F.col("k"), F.lit(25)))
        .cast("long").alias("parent"),
        (F.lit(SAMPLE_BASE) + F.col("cust")).cast("long").alias("child"))


def _fixed_edges(spark: SparkSession, sf_dir: str, begin) -> DataFrame:
    nation = _read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"))
    region = _read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r"))
    below = F.when(F.col("n") == 0, F.lit(UNARY)).otherwise(F.col("n") + 10).cast("long")
    first = nation.select(begin.alias("left"), F.lit(MIDDLE).alias("right"),
                          F.col("r").alias("parent"), below.alias("child"))
    second = nation.select(F.lit(MIDDLE).alias("left"), F.lit(LENGTH).alias("right"),
                           F.pmod(F.col("r") + 1, F.lit(5)).cast("long").alias("parent"),
                           below.alias("child"))
    unary = nation.where(F.col("n") == 0).select(
        begin.alias("left"), F.lit(LENGTH).alias("right"),
        F.lit(UNARY).cast("long").alias("parent"), F.lit(10).cast("long").alias("child"))
    top = region.select(
        begin.alias("left"),
        F.when(F.col("r") == 4, F.lit(MIDDLE)).otherwise(F.lit(LENGTH)).alias("right"),
        F.lit(ROOT).cast("long").alias("parent"), F.col("r").alias("child"))
    return first.unionByName(second).unionByName(unary).unionByName(top)


def orders_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = customer_edges(spark, sf_dir)
    begin = _read(spark, sf_dir, "orders").agg(_day(F.trunc(F.min("o_orderdate"), "month"))).scalar()
    edges = cust.unionByName(_fixed_edges(spark, sf_dir, begin))
    return edges.select((F.col("child") * 10_000 + F.col("left").cast("long")).alias("id"),
                        "left", "right", "parent", "child")


def orders_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("long")
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    key = F.col("c_custkey")
    extra = F.when(key % 3 == 0, F.concat(F.lit(',"segment":'), quote(F.col("c_mktsegment")),
                                          F.lit(',"tier":null'))).otherwise(F.lit(""))
    samples = _read(spark, sf_dir, "customer").select(
        (key + SAMPLE_BASE).cast("long").alias("id"), F.lit(1).cast("long").alias("flags"),
        F.lit(0.0).alias("time"), F.col("c_nationkey").cast("long").alias("population"),
        F.when(key % 4 != 0, key.cast("long")).alias("individual"),
        F.concat(F.lit('{"name":'), quote(F.col("c_name")), extra, F.lit("}")).alias("metadata_json"))

    def inner(df, node_id, time):
        return df.select(node_id.cast("long").alias("id"), F.lit(0).cast("long").alias("flags"),
                         time.cast("double").alias("time"), none.alias("population"),
                         none.alias("individual"), F.lit("{}").alias("metadata_json"))

    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    return (samples
            .unionByName(inner(nation, n + 10, F.lit(10.0) + n / F.lit(8.0)))
            .unionByName(inner(nation.where(n == 0), F.lit(UNARY), F.lit(15.0)))
            .unionByName(inner(region, r, F.lit(20.0) + r / F.lit(4.0)))
            .unionByName(inner(region.where(r == 0), F.lit(ROOT), F.lit(30.0))))


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship days per customer with the set of their (at most three) states."""
    items = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    flag = (F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1)
            .otherwise(2))
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        _day("l_shipdate").cast("long").alias("pos"), F.col("o_custkey").alias("cust")
    ).agg(F.collect_set(F.struct(flag.cast("long").alias("code"),
                                 F.col("l_returnflag").alias("state"))).alias("states"))


def orders_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _read(spark, sf_dir, "lineitem").select(
        _day("l_shipdate").cast("long").alias("pos")).distinct()
    state = F.element_at(F.array(*[F.lit(s) for s in "ACGT"]),
                         (F.col("pos") % 4 + 1).cast("int"))
    return days.select((F.col("pos") - 1000).alias("id"), F.col("pos").cast("double").alias("position"),
                       state.alias("ancestral_state"), F.lit("{}").alias("metadata_json"))


def orders_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _shipments(spark, sf_dir).select("pos", "cust", "states", F.explode("states").alias("s"))
    base = F.lit(100_000_000_000)
    code = F.col("s.code")
    earlier = F.array_max(F.transform(F.filter("states", lambda v: v["code"] < code),
                                      lambda v: v["code"]))
    time = F.when((F.col("cust") + F.col("pos")) % 5 != 0, (F.col("pos") % 31).cast("double"))
    return one.select(
        ((F.col("pos") * 4 + code) * base + F.col("cust")).alias("id"),
        (F.col("pos") - 1000).alias("site_id"),
        (F.col("cust") + SAMPLE_BASE).cast("long").alias("node_id"),
        ((F.col("pos") * 4 + earlier) * base + F.col("cust")).alias("parent_id"),
        time.alias("time"), F.col("s.state").alias("derived_state"),
        F.lit("{}").alias("metadata_json"))


def orders_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").where(key % 4 != 0).select(
        key.cast("long").alias("id"), F.lit(0).cast("long").alias("flags"),
        F.when(key % 2 == 0, F.array(F.col("c_nationkey").cast("double"), F.col("c_acctbal")))
        .alias("location"),
        F.array().cast("array<bigint>").alias("parents"),
        F.when(key % 6 == 0, F.lit('{"group":{"a":1}}')).otherwise(
            F.concat(F.lit('{"segment":"'), F.lower("c_mktsegment"), F.lit('"}')))
        .alias("metadata_json"))


def orders_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.concat(F.lit('{"nation":"'), F.col("n_name"), F.lit('","region":"'), F.col("r_name"),
                 F.lit('"}')).alias("metadata_json"))


_OPEN: dict[tuple[str, str], Collection] = {}


def orders_collection(spark: SparkSession, sf_dir: str) -> Collection:
    """The collection for one data folder, derived and written once per application.

    Queries then read Parquet tables, as they would read a collection of their own.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        tables = {name: written(build(spark, sf_dir), name) for name, build in (
            ("nodes", orders_nodes), ("edges", orders_edges), ("sites", orders_sites),
            ("mutations", orders_mutations), ("individuals", orders_individuals),
            ("populations", orders_populations))}
        _OPEN[key] = open_collection(**tables, length=LENGTH)
    return _OPEN[key]
