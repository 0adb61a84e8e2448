"""One-row and few-row descriptions of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from copse.functions import json as J


def summary(nodes, edges, sites, mutations, individuals, populations, intervals,
            length: float) -> DataFrame:
    """Length, time range, samples and table sizes in one row.

    Each table is aggregated on its own and enters as a scalar.
    """
    count = lambda df: df.agg(F.count("*")).scalar()
    base = nodes.agg(
        F.lit(float(length)).alias("sequence_length"), F.min("time").alias("min_time"),
        F.max("time").alias("max_time"),
        F.count_if(F.col("flags").bitwiseAND(1) == 1).alias("n_samples"),
        F.count("*").alias("n_nodes"))
    return base.select(
        "*", count(intervals).alias("n_trees"), count(edges).alias("n_edges"),
        count(sites).alias("n_sites"), count(mutations).alias("n_mutations"),
        count(individuals).alias("n_individuals"), count(populations).alias("n_populations"))


def provenance_records(provenances: DataFrame) -> DataFrame:
    """Records with a flag whether they are JSON, and their software."""
    parsed = J.as_variant(F.col("record"))
    software = F.get_json_object("record", "$.software")
    named = F.get_json_object("record", "$.software.name")
    is_object = F.coalesce(F.startswith(F.trim(software), F.lit("{")), F.lit(False))
    return provenances.select(
        "id", "timestamp", "record", parsed.isNotNull().alias("record_is_json"),
        F.when(is_object, named).otherwise(software).alias("software"),
        F.when(is_object, F.get_json_object("record", "$.software.version"))
        .alias("software_version"))


def provenance_summary(provenances: DataFrame) -> DataFrame:
    """Number of records and the latest one's software."""
    rows = provenance_records(provenances)
    last = F.max_by(F.struct("id", "timestamp", "software", "software_version"), "id")
    return rows.agg(F.count("*").alias("n_records"),
                    F.count_if("record_is_json").alias("n_json"), last.alias("_l")).select(
        "n_records", "n_json", F.col("_l.id").alias("latest_id"),
        F.col("_l.timestamp").alias("latest_timestamp"),
        F.col("_l.software").alias("software"), F.col("_l.software_version").alias("software_version"))


def json_safe(c) -> F.Column:
    """Metadata of any kind as JSON text: JSON stays, other text is quoted, blank is NULL."""
    text = c.cast("string")
    parsed = J.as_variant(text)
    quoted = F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)
    return F.when(F.length(text) > 0, F.coalesce(F.to_json(parsed), quoted))
