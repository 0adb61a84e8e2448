"""BED lines for genome browsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _rounded(c: Column, precision: int) -> Column:
    """Half to even, then cut to a whole number."""
    return F.bround(c, precision).cast("long")


def tree_bed(stats: DataFrame, stat: str = "root_time", chrom: str = "chr1",
             precision: int = 0) -> DataFrame:
    """Nine BED columns per tree; the statistic becomes score and grey value.

    Trees whose rounded interval is empty are left out.
    """
    rows = stats.select("tree_index", _rounded(F.col("left"), precision).alias("start"),
                        _rounded(F.col("right"), precision).alias("end"),
                        F.col(stat).cast("double").alias("value")).where(
        F.col("end") > F.col("start"))
    top = rows.agg(F.max("value").alias("top")).select(
        F.when(F.col("top") > 0, F.col("top")).otherwise(F.lit(1.0))).scalar()
    share = F.col("value") / top
    hold = lambda c, high: F.least(F.lit(high), F.greatest(F.lit(0), F.bround(c).cast("long")))
    grey = hold(F.lit(255.0) * share, 255).cast("string")
    return rows.select(
        F.lit(chrom).alias("chrom"), "start", "end",
        F.concat(F.lit("tree_"), F.col("tree_index").cast("string")).alias("name"),
        hold(F.lit(1000.0) * share, 1000).alias("score"), F.lit(".").alias("strand"),
        F.col("start").alias("thick_start"), F.col("end").alias("thick_end"),
        F.concat_ws(",", grey, grey, grey).alias("rgb"))


def site_bed(sites: DataFrame, mutations: DataFrame, chrom: str = "chr1",
             precision: int = 0) -> DataFrame:
    """Nine BED columns per site, named by position and its first two alleles.

    The ancestral state is the first allele; derived states follow by id of
    their first mutation. Only the first two alleles per site travel.
    """
    derived = mutations.join(sites.select(F.col("id").alias("site_id"), "ancestral_state"),
                             "site_id").where(F.col("derived_state") != F.col("ancestral_state"))
    second = derived.groupBy("site_id").agg(
        F.min(F.struct("id", "derived_state")).alias("_d")).select(
        F.col("site_id").alias("id"), F.col("_d.derived_state").alias("_second"))
    start = _rounded(F.col("position"), precision)
    named = F.concat(F.lit("pos"), start.cast("string"), F.lit(":"),
                     F.concat_ws("/", "ancestral_state", "_second"))
    return sites.join(second, "id", "left").select(
        F.lit(chrom).alias("chrom"), start.alias("start"), (start + 1).alias("end"),
        named.alias("name"), F.lit(0).cast("long").alias("score"), F.lit(".").alias("strand"),
        start.alias("thick_start"), (start + 1).alias("thick_end"), F.lit("0,0,0").alias("rgb"))


def lines(bed: DataFrame, columns: int = 9) -> DataFrame:
    """Tab-separated lines of the first ``columns`` columns."""
    return bed.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in bed.columns[:columns]])
                      .alias("value"))


def write_bed(bed: DataFrame, path: str, columns: int = 9) -> None:
    """Text files in genome order."""
    ordered = bed.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start")
    lines(ordered, columns).write.mode("overwrite").text(path)
