"""Shards of near equal size from sampled splitters.

Records lie in the order of their key. A size-weighted sample of keys gives
splitters at its quantiles, which cut the key space into ranges of about equal
bytes; ranges that turn out overfull are sampled again and subdivided, and one
key that fills a range by itself is divided by the hash of its rows. Sums per
range then place every range, and running sums inside ranges every record, so
the last cut is exact to a record. Built from DataFrame functions only.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from copse.llm.batches import free_name, named
from copse.session import written

#: Ranges for each shard, at least; and records that a range is meant to hold.
RANGES_PER_SHARD = 8
RANGE_ROWS = 100_000
MAX_RANGES = 1 << 14
#: Draws for each range.
DRAWS = 64
#: A range of more bytes than this many times the mean is subdivided.
OVERFULL = 2.0
ROUNDS = 4
OVERHEAD = 16


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32): UTF-8 bytes plus an overhead; null text has none, and checksum 0."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(key).cast("long").alias(key), (F.octet_length(data) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(data).alias("text_crc32"))


def _range_of(key: str, splitters: list[int]) -> Column:
    """Number of splitters at or below the key, by halving steps over a literal array. Null keys are first."""
    if not splitters:
        return F.lit(0)
    steps, step = [], 1 << (len(splitters).bit_length() - 1)
    while step:
        steps.append(F.lit(step))
        step >>= 1
    held = F.array(*[F.lit(s) for s in splitters])
    below = F.aggregate(F.array(*steps), F.lit(0), lambda at, s: at + F.when(
        (at + s <= len(splitters)) & (F.try_element_at(held, (at + s).cast("int")) <= F.col(key)), s).otherwise(0))
    return F.coalesce(below, F.lit(0))


def _draw(rows: DataFrame, key: str, draws: int, total: int, seed: int) -> DataFrame:
    """Keys drawn in proportion to size: about ``draws`` of them, with how often each was drawn."""
    share = F.col("size") * F.lit(draws / max(total, 1))
    spread = F.pmod(F.xxhash64(F.lit(seed), key, "size", "text_crc32"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.select(key, F.floor(share + spread).alias("n")).where((F.col("n") > 0) & F.col(key).isNotNull())


def _quantiles(drawn: DataFrame, key: str, cuts: int) -> list[int]:
    """At most ``cuts`` splitters at the quantiles of the draws."""
    if cuts < 1:
        return []
    at = F.array(*[F.lit((k + 1) / (cuts + 1)) for k in range(cuts)])
    # A record of many draws enters once per draw; draws are bounded by a parameter.
    each = drawn.select(key, F.explode(F.sequence(F.lit(1), F.least("n", F.lit(1 << 16)).cast("int"))))
    found = each.agg(F.percentile_approx(key, at, 100_000).alias("q")).first()["q"]
    return sorted(set(found or []))


def splitters(rows: DataFrame, ranges: int, total: int, key: str = "doc_id", draws: int = DRAWS) -> list[int]:
    """Splitters for about ``ranges`` ranges; what is overfull after the last round is left to :func:`parts_of`."""
    found = _quantiles(_draw(rows, key, draws * ranges, total, 0), key, ranges - 1)
    for round_ in range(1, ROUNDS + 1):
        full = _overfull(rows, _range_of(key, found), key, total / ranges)
        split = {r["range"]: r for r in full.where("low <> high").collect()}    # at most ranges / OVERFULL
        if not split or round_ == ROUNDS or len(found) > 2 * MAX_RANGES:
            break
        inside = rows.withColumn("range", _range_of(key, found)).where(F.col("range").isin(list(split)))
        bytes_ = sum(r["bytes"] for r in split.values())
        cuts = min(MAX_RANGES, 2 * ceil(bytes_ / (total / ranges)))
        more = _quantiles(_draw(inside, key, draws * cuts, bytes_, round_), key, cuts)
        # One heavy record among light ones may take all draws: its own key is a splitter too.
        more += [r["high"] for r in split.values()] + [r["low"] + 1 for r in split.values()]
        found = sorted(set(found) | set(more))
    return found


def _overfull(rows: DataFrame, number: Column, key: str, mean: float) -> DataFrame:
    """Overfull ranges: at most ``ranges / OVERFULL`` rows, as they hold that many means together."""
    return rows.groupBy(number.alias("range")).agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).where(
        F.col("bytes") > OVERFULL * mean)


def parts_of(rows: DataFrame, number: Column, key: str, mean: float) -> DataFrame:
    """(range, parts): how many parts the rows of a range that is still overfull go to, by their hash."""
    return _overfull(rows, number, key, mean).where("n > 1").select(
        "range", F.ceil(F.col("bytes") / F.lit(mean)).alias("parts"))


def sharded(rows: DataFrame, shards: int, key: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """``rows`` (key, size, text_crc32, ...) with ``shard`` and ``slot``: shard sizes differ by one record at most.

    Shard ``k`` takes the records whose middle, in the order of keys, lies in
    the k-th of equal parts of all bytes. Null keys come first; equal keys go
    by checksum and size, unless their range is overfull: then the hash of a row
    decides its part. Repeated rows are rows of their own. An empty table gives
    an empty result. Other columns are kept, whatever their names; ``shard`` and
    ``slot`` replace columns of that name.
    """
    rows = written(rows.drop("shard", "slot"), "sized")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = ranges or min(MAX_RANGES, max(RANGES_PER_SHARD * shards, n // RANGE_ROWS))
    number = _range_of(key, splitters(rows, ranges, total, key) if n else [])
    range_, part, at, before, above, first = (
        free_name(rows, name) for name in ("_range", "_part", "_at", "_before", "_above", "_first"))
    # Bounded by ranges / OVERFULL rows, so the join never shuffles the records.
    parts = parts_of(rows, number, key, max(total, 1) / ranges).select(F.col("range").alias(range_), F.col("parts").alias(part))
    spread = F.pmod(F.xxhash64("size", "text_crc32", F.monotonically_increasing_id()), F.col(part))
    place = rows.withColumn(range_, number).join(F.broadcast(parts), range_, "left").withColumn(
        part, F.coalesce(spread, F.lit(0)).cast("long"))
    place = written(place, "placed")                 # row ids hold for one reading only
    sums = place.groupBy(range_, part).agg(F.sum("size").alias(at), F.count("*").alias(above))
    # One row per range and part, a number that parameters bound.
    order = Window.orderBy(range_, part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(range_, part, F.coalesce(F.sum(at).over(order), F.lit(0)).alias(before),
                         F.coalesce(F.sum(above).over(order), F.lit(0)).alias(above))
    inside = Window.partitionBy(range_, part).orderBy(F.asc_nulls_first(key), "text_crc32", "size")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = place.withColumns({first: upto, at: F.row_number().over(inside)}).join(F.broadcast(starts), [range_, part])
    middle = 2 * (F.col(before) + F.col(first)) - F.col("size")
    shard = F.floor(F.try_divide(middle.cast("decimal(38,0)") * shards, F.lit(2 * max(total, 1)).cast("decimal(20,0)")))
    numbered = written(placed.select(*named(*rows.columns), shard.cast("int").alias("shard"),
                                     (F.col(above) + F.col(at)).alias(at)), "numbered")
    firsts = numbered.groupBy("shard").agg(F.min(at).alias(first))            # one row per shard
    return numbered.join(F.broadcast(firsts), "shard").select(
        *named(*rows.columns), "shard", (F.col(at) - F.col(first)).cast("long").alias("slot"))
