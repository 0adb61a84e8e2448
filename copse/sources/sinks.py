"""Persisted tables: layout by position or tree so that reads are pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from copse.functions.coordinates import sentinels
from copse.schemas import LAYOUT_MUTATIONS, LAYOUT_NODES, MUTATION_RESULT

TREES_PER_FOLDER = 10_000
NODE_CHUNK = 65_536


def genealogy_rows(placed: DataFrame, intervals: DataFrame, chunk: int = NODE_CHUNK) -> DataFrame:
    """Trees as array rows ``(tree_index, chunk, interval, node arrays)``.

    A chunk covers ``chunk`` consecutive node ids of one tree, sorted by id, so
    even the largest tree is a series of bounded rows.
    """
    entry = F.struct("node_id", sentinels(F.col("parent_id")).alias("parent_id"), "time",
                     "flags", "n_children", "x")
    grouped = placed.groupBy(
        "tree_index", F.floor(F.col("node_id") / F.lit(chunk)).cast("long").alias("chunk")
    ).agg(F.array_sort(F.collect_list(entry)).alias("_n"))
    pick = lambda name: F.transform("_n", lambda n: n[name])
    return grouped.join(intervals, "tree_index").select(
        "tree_index", "chunk", F.col("left").alias("interval_left"),
        F.col("right").alias("interval_right"), pick("node_id").alias("node_ids"),
        pick("parent_id").alias("parent_ids"), pick("time").alias("node_times"),
        pick("flags").alias("node_flags"), pick("n_children").alias("child_counts"),
        pick("x").alias("layout_x"))


def write_genealogies(rows: DataFrame, path: str, trees_per_folder: int = TREES_PER_FOLDER) -> None:
    """Parquet in folders of consecutive trees, sorted by tree inside."""
    folder = F.floor(F.col("tree_index") / F.lit(trees_per_folder)).cast("long")
    (rows.withColumn("tree_folder", folder)
     .repartitionByRange("tree_index", "chunk").sortWithinPartitions("tree_index", "chunk")
     .write.mode("overwrite").partitionBy("tree_folder").parquet(path))


def read_genealogies(spark, path: str, trees: list[int] | None = None,
                     trees_per_folder: int = TREES_PER_FOLDER) -> DataFrame:
    """Persisted trees; a tree list prunes folders, then row groups."""
    rows = spark.read.parquet(path)
    if trees is None:
        return rows
    folders = sorted({int(t) // trees_per_folder for t in trees})
    return rows.where(F.col("tree_folder").isin(folders) & F.col("tree_index").isin(
        [int(t) for t in trees]))


def write_by_position(rows: DataFrame, path: str) -> None:
    """Sorted by (position, id) across files: min/max statistics prune windows."""
    (rows.repartitionByRange("position", "id").sortWithinPartitions("position", "id")
     .write.mode("overwrite").parquet(path))


def write_by_node(rows: DataFrame, path: str) -> None:
    """The same rows ordered by node, for lookups of one node."""
    (rows.repartitionByRange("node_id", "position", "id")
     .sortWithinPartitions("node_id", "position", "id").write.mode("overwrite").parquet(path))


def write_dimension(rows: DataFrame, path: str, key: str = "id") -> None:
    """Nodes, sites, individuals, populations: sorted by id across files."""
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def dimension_rows(df: DataFrame) -> DataFrame:
    """Id columns with sentinels, metadata as text and as raw bytes."""
    out = df
    for name in ("population", "individual"):
        if name in df.columns:
            out = out.withColumn(name, sentinels(F.col(name)))
    return out.withColumn("metadata_raw", F.col("metadata_json").cast("binary"))


def write_metadata_index(index: DataFrame, path: str) -> None:
    """Inverted index ordered by (key, value): one value is a contiguous read."""
    (index.repartitionByRange("key", "value", "source", "chunk")
     .sortWithinPartitions("key", "value", "source", "chunk")
     .write.mode("overwrite").parquet(path))


def _shape(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def layout_nodes(placed: DataFrame) -> DataFrame:
    """Node result table."""
    return _shape(placed.select("node_id", sentinels(F.col("parent_id")).alias("parent_id"),
                                "is_tip", F.col("tree_index").alias("tree_idx"), "x", "y"),
                  LAYOUT_NODES)


def layout_mutations(placed: DataFrame) -> DataFrame:
    """Mutation result table of a layout."""
    return _shape(placed.select(
        F.col("x").alias("mut_x"), F.col("y").alias("mut_y"),
        F.col("tree_index").alias("mut_tree_idx"), F.col("node_id").alias("mut_node_id"),
        F.col("mutation_id").alias("mut_id"), F.col("site_id").alias("mut_site_id"),
        F.col("position").alias("mut_position"),
        F.coalesce("time", F.lit(float("nan"))).alias("mut_time"),
        F.col("ancestral_state").alias("mut_ancestral_state"),
        F.col("derived_state").alias("mut_derived_state"),
        F.col("inherited_state").alias("mut_inherited_state")), LAYOUT_MUTATIONS)


def mutation_result(rows: DataFrame) -> DataFrame:
    """Mutation query result table; positions and distances are whole numbers."""
    from copse.operators.mutations import label
    distance = F.col("distance") if "distance" in rows.columns else F.lit(0)
    return _shape(rows.select(
        F.col("position").cast("long").alias("position"),
        label(F.col("ancestral_state"), F.col("derived_state")).alias("mutation"),
        "node_id", "site_id", "ancestral_state", "derived_state",
        distance.cast("long").alias("distance"),
        sentinels(F.col("tree_index")).alias("tree_index"), "interval_left", "interval_right"),
        MUTATION_RESULT)


def empty(spark, schema) -> DataFrame:
    """No rows, fixed schema."""
    return spark.createDataFrame([], schema)


def write_per_chromosome(rows: DataFrame, path: str) -> None:
    """One CSV folder per chromosome, rows in window order."""
    (rows.repartitionByRange("chrom", "genomic_positions")
     .sortWithinPartitions("chrom", "genomic_positions")
     .write.mode("overwrite").option("header", True).partitionBy("chrom").csv(path))
