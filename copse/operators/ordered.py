"""Ordered work without a single-task window.

A window needs its whole group in one task, so the windows here only ever see
groups of a bounded size: at most ``BLOCK`` distinct positions, or the list of
blocks, or the list of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from copse.session import cut

BLOCK = 65_536
SINGLE_TASK_ROWS = 20_000


def global_rank(df: DataFrame, *order, out: str = "rank",
                single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Number all rows 0..n-1 in the given total order.

    Up to ``single_task_rows`` rows (counted first) one task sorts them. Beyond
    that the rows are range-partitioned and sorted where they are, and each
    partition is shifted by the row counts of the ones before it.
    """
    base = cut(df)
    if base.count() <= single_task_rows:
        number = F.row_number().over(Window.orderBy(*order)) - 1
        return base.withColumn(out, number.cast("long"))
    part = F.spark_partition_id()
    inside = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    # The cut pins partition ids and in-partition numbers before both uses.
    placed = cut(
        base.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("*", part.alias("_part"), inside.alias("_inside"))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (placed.join(starts, "_part")
            .withColumn(out, (F.col("_start") + F.col("_inside")).cast("long"))
            .drop("_part", "_inside", "_start"))


def segments(deltas: DataFrame, keys: list[str], pos: str, values: list[str],
             n_positions: int | None = None, block: int = BLOCK) -> DataFrame:
    """Turn change points into runs: running totals and the next change point.

    ``(keys, pos)`` is unique. Adds ``cum_<value>`` (total from the first
    position up to and including this one) and ``next_<pos>`` (NULL on the last).
    With at most ``block`` positions in all, the group of a key is bounded and
    one window does. Otherwise positions are taken in blocks, so a key with
    millions of change points is shared out; totals and first positions of the
    later blocks are carried over.
    """
    nxt = f"next_{pos}"
    if n_positions is not None and n_positions <= block:
        run = Window.partitionBy(*keys).orderBy(pos)
        return deltas.select("*", *[F.sum(v).over(run).alias(f"cum_{v}") for v in values],
                             F.lead(pos).over(run).alias(nxt))
    rows = deltas.withColumn("_block", F.floor(F.col(pos) / F.lit(block)).cast("long"))
    blocks = rows.groupBy(*keys, "_block").agg(
        F.min(pos).alias("_head"), *[F.sum(v).alias(f"_sum_{v}") for v in values])
    over_blocks = Window.partitionBy(*keys).orderBy("_block")
    earlier = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(
        *keys, "_block", F.lead("_head").over(over_blocks).alias("_next_head"),
        *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_base_{v}")
          for v in values])
    inner = Window.partitionBy(*keys, "_block").orderBy(pos)
    out = rows.join(carry, [*keys, "_block"]).select(
        *[c for c in deltas.columns],
        *[(F.col(f"_base_{v}") + F.sum(v).over(inner)).alias(f"cum_{v}") for v in values],
        F.coalesce(F.lead(pos).over(inner), F.col("_next_head")).alias(nxt))
    return out


def fold_changes(df: DataFrame, keys: list[str], first: str, last: str,
                 measures: dict[str, Column], pos: str = "tree_index") -> DataFrame:
    """Change points of half-open ranges: +measure at ``first``, -measure at ``last``.

    Partial sums are combined before the shuffle; points whose changes cancel
    (a range split in two without a gap) disappear.
    """
    ends = df.select(
        *keys, *[m.alias(name) for name, m in measures.items()],
        F.explode(F.array(F.struct(F.col(first).alias("p"), F.lit(1).alias("s")),
                          F.struct(F.col(last).alias("p"), F.lit(-1).alias("s")))).alias("_e"))
    summed = ends.groupBy(*keys, F.col("_e.p").alias(pos)).agg(
        *[F.sum(F.col(name) * F.col("_e.s")).alias(name) for name in measures])
    changed = None
    for name in measures:
        test = F.col(name) != 0
        changed = test if changed is None else changed | test
    return summed.where(changed)
