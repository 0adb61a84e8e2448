"""Readers for the table layout and its integrity check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, StructField

from copse.operators.trees import with_times
from copse.schemas import TABLES

REQUIRED = ("nodes", "edges", "sites", "mutations", "individuals", "populations")
FORMATS = ("parquet", "csv")
CSV = {"header": True, "escape": '"'}


#: Columns that a table may lack; they load as NULL.
OPTIONAL = {
    "nodes": {"flags", "population", "individual", "metadata_json"}, "edges": {"id"}, "sites": {"metadata_json"},
    "mutations": {"parent_id", "time", "metadata_json"}, "individuals": {"flags", "location", "parents", "metadata_json"},
    "populations": {"metadata_json"}, "provenances": {"timestamp"},
}


def _check_columns(name: str, have: set[str]) -> None:
    """Refuse a table without a column that answers depend on."""
    missing = [f.name for f in TABLES[name] if f.name not in have and f.name not in OPTIONAL[name]]
    if missing:
        raise ValueError(f"table {name!r} lacks {', '.join(missing)}")


def _nulls(df: DataFrame) -> DataFrame:
    """Sentinels of foreign tables -> NULL."""
    out = df
    for name in ("population", "individual", "parent_id"):
        if name in df.columns:
            out = out.withColumn(name, F.when(F.col(name) != -1, F.col(name)))
    if "time" in df.columns:
        out = out.withColumn("time", F.when(~F.isnan("time"), F.col("time")))
    return out


def _parsed(field: StructField) -> Column:
    """A CSV text as the type of its column: lists are JSON arrays, an empty field is NULL, anything else is refused."""
    text = F.col(f"`{field.name}`")
    if isinstance(field.dataType, ArrayType):
        return F.from_json(text, field.dataType, {"mode": "FAILFAST"})
    value = text.try_cast(field.dataType)
    problem = F.concat(F.lit(f"{field.name} is not {field.dataType.simpleString()}: "), text)
    return F.when(text.isNotNull() & value.isNull(), F.raise_error(problem).cast(field.dataType)).otherwise(value)


def load_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One table by name; columns are matched to the fixed schema.

    Columns of a CSV file are matched by its header, in any order. Optional
    columns that are not there load as NULL.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; expected parquet or csv")
    path = f"{folder}/{name}.{fmt}"
    raw = spark.read.options(**CSV).csv(path) if fmt == "csv" else spark.read.parquet(path)
    have = set(raw.columns)
    _check_columns(name, have)
    cell = _parsed if fmt == "csv" else (lambda field: F.col(field.name).cast(field.dataType))
    return _nulls(raw.select(*[(cell(f) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
                               for f in TABLES[name]]))


def load_tables(spark: SparkSession, folder: str, fmt: str = "parquet",
                names: Iterable[str] = REQUIRED) -> dict[str, DataFrame]:
    """All tables of a folder; ``names`` may add ``provenances``."""
    return {name: load_table(spark, folder, name, fmt) for name in names}


def save_tables(found: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Write tables as :func:`load_tables` reads them; lists become JSON arrays in CSV."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; expected parquet or csv")
    for name, table in found.items():
        rows = table.select(*[f.name for f in TABLES[name] if f.name in table.columns])
        if fmt == "parquet":
            rows.write.parquet(f"{folder}/{name}.parquet")
            continue
        lists = [f.name for f in rows.schema if isinstance(f.dataType, ArrayType)]
        rows.withColumns({c: F.to_json(c) for c in lists}).write.options(**CSV).csv(f"{folder}/{name}.csv")


def integrity_report(nodes: DataFrame, edges: DataFrame, sites: DataFrame, mutations: DataFrame,
                     intervals: DataFrame) -> DataFrame:
    """``(check, n_bad)`` over whole tables; all zeros for a sound collection."""
    ids = nodes.select(F.col("id"))

    def orphans(df, column, target):
        keyed = df.where(F.col(column).isNotNull()).select(F.col(column).alias("id"))
        return keyed.join(target.select("id"), "id", "left_anti").agg(F.count("*").alias("n_bad"))

    points = intervals.select(F.explode(F.array("left", "right")).alias("p")).distinct()
    ends = edges.select(F.explode(F.array("left", "right")).alias("p"))
    # Parents at once: what starts and ends at each breakpoint of a child, added up.
    steps = edges.where(F.col("left") < F.col("right")).select("child", F.explode(F.array(
        F.struct(F.col("left").alias("at"), F.lit(1).alias("n")),
        F.struct(F.col("right").alias("at"), F.lit(-1).alias("n")))).alias("s")).groupBy(
        "child", F.col("s.at").alias("at")).agg(F.sum("s.n").alias("n"))
    crowded = steps.select(F.sum("n").over(Window.partitionBy("child").orderBy("at")).alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("n_bad"))
    off = ends.join(points, "p", "left_anti").agg(F.count("*").alias("n_bad"))
    ages = with_times(edges, nodes).agg(
        F.count_if(F.col("parent_time") <= F.col("child_time")).alias("n_bad"))
    checks = {
        "edge child in nodes": orphans(edges, "child", ids),
        "edge parent in nodes": orphans(edges, "parent", ids),
        "edge not empty": edges.agg(F.count_if(F.col("left") >= F.col("right")).alias("n_bad")),
        "edge ends are breakpoints": off,
        "one parent at a time": crowded,
        "parent older than child": ages,
        "mutation node in nodes": orphans(mutations, "node_id", ids),
        "mutation site in sites": orphans(mutations, "site_id", sites),
        "mutation parent in mutations": orphans(mutations, "parent_id", mutations),
    }
    out = None
    for name, frame in checks.items():
        row = frame.select(F.lit(name).alias("check"), "n_bad")
        out = row if out is None else out.unionByName(row)
    return out
