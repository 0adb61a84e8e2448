"""Topology keys, ranks and runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from copse.functions import text as X
from copse.operators.ordered import global_rank
from copse.sources.newick import OUTGROUP, _postorder, drop_outgroup, parse_newick


def _canonical(text: str, outgroup: str | None) -> str:
    nodes = parse_newick(text)
    root = drop_outgroup(nodes, outgroup) if outgroup else 0
    key: dict[int, str] = {}
    for at in _postorder(nodes, root):
        below = sorted(key.pop(child) for child in nodes[at][3])
        key[at] = nodes[at][1] if not below else (
            below[0] if len(below) == 1 else "(" + ",".join(below) + ")")
    return key[root]


def topology_keys(rows: DataFrame, outgroup: str | None = OUTGROUP) -> DataFrame:
    """``rows`` with ``topology``: child order, lengths and unary nodes do not count."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(topology=[_canonical(t, outgroup) for t in batch["newick"]])

    return rows.mapInPandas(add, StructType([*rows.schema, StructField("topology", StringType())]))


def shape_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with the cheap textual key, no parsing."""
    return rows.withColumn("topology", X.shape_key(F.col("newick")))


def ranked_topologies(keyed: DataFrame) -> DataFrame:
    """Add the rank of the key among the sorted keys and the branch length scaled
    between the smallest and largest of its topology (0.5 if they are equal).

    Ranges are aggregated per key with partial results, not windowed, and
    ranking sees distinct keys only; no group of equal topologies is gathered.
    """
    number = F.col("max_branch_length").try_cast("double")
    length = F.when(number.isNull() | F.isnan(number), F.lit(0.0)).otherwise(number)
    sized = keyed.withColumn("_len", length)
    ranges = global_rank(sized.groupBy("topology").agg(
        F.min("_len").alias("_lo"), F.max("_len").alias("_hi")), "topology", out="topology_rank")
    share = F.when(F.col("_hi") > F.col("_lo"),
                   (F.col("_len") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
                   ).otherwise(F.lit(0.5))
    return sized.join(ranges, "topology").withColumn("length_share", share).drop(
        "_len", "_lo", "_hi")


def topology_runs(keyed: DataFrame, chrom: str = "chrom", order: str = "idx") -> DataFrame:
    """Runs of equal topology: ``(chrom, run_id, start_idx, n_rows, topology, digest)``.

    Rows get a global number; a row starts a run if its predecessor (joined by
    number) differs. Run numbers come from ranking the starts, so a chromosome
    holding a third of the rows is never one window.
    """
    numbered = global_rank(keyed.select(F.col(chrom).alias("chrom"), F.col(order).alias("idx"),
                                        "topology"), "chrom", "idx", out="place")
    before = numbered.select((F.col("place") + 1).alias("place"), F.col("chrom").alias("_c"),
                             F.col("topology").alias("_t"))
    flagged = numbered.join(before, "place", "left")
    new = F.coalesce((F.col("_c") != F.col("chrom")) | (F.col("_t") != F.col("topology")),
                     F.lit(True))
    starts = global_rank(flagged.where(new).select("place", "chrom", "idx", "topology"),
                         "place", out="run")
    nxt = starts.select((F.col("run") - 1).alias("run"), F.col("place").alias("_next"))
    total = numbered.agg(F.count("*")).scalar()
    base = starts.groupBy("chrom").agg(F.min("run").alias("_base"))
    return starts.join(nxt, "run", "left").join(base, "chrom").select(
        "chrom", (F.col("run") - F.col("_base")).alias("run_id"),
        F.col("idx").alias("start_idx"),
        (F.coalesce("_next", total) - F.col("place")).alias("n_rows"), "topology",
        F.md5("topology").alias("digest"))


def topology_summary(keyed: DataFrame, changed: Column) -> DataFrame:
    """Rows, distinct topologies, changed rows."""
    return keyed.agg(F.count("*").alias("n_rows"), F.countDistinct("topology").alias("n_topologies"),
                     F.count_if(changed).alias("n_changed"))


def with_gaps(rows: DataFrame, fold_gaps: bool = False) -> DataFrame:
    """Mark windows that do not follow their predecessor; with ``fold_gaps`` drop them.

    A folded window extends nothing but the text of the row before, whose start
    is kept; ``(chrom, idx)`` is unique.
    """
    previous = rows.select("chrom", (F.col("idx") + 1).alias("idx"), F.lit(True).alias("_hit"))
    first = rows.groupBy("chrom").agg(F.min("idx").alias("_first"))
    marked = rows.join(previous, ["chrom", "idx"], "left").join(first, "chrom").withColumn(
        "after_gap", F.col("_hit").isNull() & (F.col("idx") != F.col("_first"))
    ).drop("_hit", "_first")
    return marked.where(~F.col("after_gap")) if fold_gaps else marked


def samples_down_rows(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Write sample i of a chromosome beside its row i.

    ``samples`` is ``(chrom, name, first_idx, first_place)``, the place where
    the name is first seen.
    """
    def numbered(df, *order):
        placed = global_rank(df, "chrom", *order, out="_g")
        base = placed.groupBy("chrom").agg(F.min("_g").alias("_b"))
        return placed.join(base, "chrom").withColumn("row", F.col("_g") - F.col("_b")).drop("_g", "_b")

    names = numbered(samples, "first_idx", "first_place").select(
        "chrom", "row", F.col("name").alias("samples"))
    return numbered(rows, "idx").join(names, ["chrom", "row"], "left").withColumn(
        "samples", F.coalesce("samples", F.lit("")))


def first_seen_samples(rows: DataFrame) -> DataFrame:
    """``(chrom, name, first_idx, first_place)`` in text order over the windows."""
    seen = rows.select("chrom", "idx", F.posexplode(X.leaf_names(F.col("newick")))
                       .alias("place", "name"))
    return seen.groupBy("chrom", "name").agg(F.min(F.struct("idx", "place")).alias("_f")).select(
        "chrom", "name", F.col("_f.idx").alias("first_idx"), F.col("_f.place").alias("first_place"))

