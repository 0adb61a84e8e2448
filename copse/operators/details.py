"""Records of single entities and of all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from copse.functions import json as J
from copse.operators.intervals import Locator
from copse.operators.trees import run_counts

LIST_CHUNK = 65_536


def one(df: DataFrame, entity_id: int, key: str = "id") -> DataFrame:
    """The row of one entity; the filter reaches the scan."""
    return df.where(F.col(key) == entity_id)


def node_records(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "flags", "time", "population", "individual",
                        J.decode(F.col("metadata_json")).alias("metadata"))


def site_records(sites: DataFrame) -> DataFrame:
    return sites.select("id", "position", "ancestral_state",
                        J.decode(F.col("metadata_json")).alias("metadata"))


def population_records(populations: DataFrame) -> DataFrame:
    return populations.select("id", J.decode(F.col("metadata_json")).alias("metadata"))


def individual_records(individuals: DataFrame, nodes: DataFrame, full: bool = True,
                       chunk: int = LIST_CHUNK) -> DataFrame:
    """Individuals with their nodes in id order; ``full`` adds flags, location, parents.

    ``chunk`` numbers the bounded node lists of one individual (0 without
    nodes). An empty location is NULL.
    """
    owned = nodes.where(F.col("individual").isNotNull()).groupBy(
        F.col("individual").alias("id"), F.floor(F.col("id") / F.lit(chunk)).cast("long")
        .alias("chunk")).agg(F.sort_array(F.collect_list("id")).alias("nodes"))
    none = F.array().cast("array<bigint>")
    extra = [F.col("flags"), F.when(F.size("location") > 0, F.col("location")).alias("location"),
             F.coalesce("parents", none).alias("parents")] if full else []
    return individuals.join(owned, "id", "left").select(
        "id", F.coalesce("chunk", F.lit(0)).alias("chunk"), *extra,
        F.coalesce("nodes", none).alias("nodes"), J.decode(F.col("metadata_json")).alias("metadata"))


def tree_records(node_runs: DataFrame, loc: Locator) -> DataFrame:
    """Interval, number of roots and of nodes of every tree."""
    return loc.intervals.join(run_counts(node_runs, loc), "tree_index").select(
        "tree_index", "left", "right", "n_roots", "n_nodes")


def tree_mutation_lists(mutations: DataFrame, chunk: int = LIST_CHUNK) -> DataFrame:
    """Mutations per tree as bounded lists ``(tree_index, chunk, mutations)``.

    Needs ``row`` (see ``mutations.numbered``); a list covers ``chunk`` rows.
    """
    entry = F.struct("id", "node_id", "site_id", "position", "derived_state", "inherited_state")
    return mutations.groupBy(
        "tree_index", F.floor(F.col("row") / F.lit(chunk)).cast("long").alias("chunk")
    ).agg(F.array_sort(F.collect_list(entry)).alias("mutations"))


def node_details(nodes: DataFrame, individuals: DataFrame, populations: DataFrame) -> DataFrame:
    """Nodes with the records of their individual and population."""
    ind = individuals.select(F.col("id").alias("individual"), F.col("flags").alias("ind_flags"),
                             F.when(F.size("location") > 0, F.col("location")).alias("location"),
                             J.decode(F.col("metadata_json")).alias("individual_meta"))
    pop = populations.select(F.col("id").alias("population"),
                             J.decode(F.col("metadata_json")).alias("population_meta"))
    return node_records(nodes).join(ind, "individual", "left").join(pop, "population", "left")


def mutation_records(mutations: DataFrame) -> DataFrame:
    """Mutations as shown beside a node: unknown time and absent parent are NULL."""
    return mutations.select(
        "id", "node_id", "site_id", "position", "ancestral_state", "derived_state",
        F.when(~F.isnan("time"), F.col("time")).alias("time"),
        F.col("parent_id").alias("parent_mutation"),
        J.decode(F.col("metadata_json")).alias("metadata"))


def edges_of_nodes(edges: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Every edge from both of its ends: ``(node_id, role, id, left, right, parent, child)``.

    With the row of one interval only edges overlapping it.
    """
    if bounds is not None:
        left, right = bounds.select("left").scalar(), bounds.select("right").scalar()
        edges = edges.where((F.col("right") > left) & (F.col("left") < right))
    ends = F.array(F.struct(F.col("parent").alias("node_id"), F.lit("as_parent").alias("role")),
                   F.struct(F.col("child").alias("node_id"), F.lit("as_child").alias("role")))
    return edges.select("id", "left", "right", "parent", "child", F.explode(ends).alias("_e")
                        ).select("_e.*", "id", "left", "right", "parent", "child")
