"""Ranges and points matched by equality: every range is a few aligned blocks.

A block of level ``k`` holds ``16^k`` consecutive numbers and begins at a
multiple of that. A half-open range is cut into the largest blocks that lie in
it, at most 30 a level, and a point lies in one block of every level. A point is
in a range exactly if they share a block, and they share one at most, so a join
on (level, block) finds each pair once, at a cost of rows and results only.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SHIFT = 4
#: Levels in use; beyond the last one a range is cut into as many of its blocks as it takes.
LEVELS = 6


def _blocks(level: int, first: Column, last: Column) -> Column:
    """Blocks ``first .. last - 1`` of a level; none where that is empty."""
    numbers = F.when(first < last, F.sequence(first, last - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(numbers, lambda b: F.struct(F.lit(level).alias("level"), b.alias("block")))


def cover(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """Array of ``(level, block)`` that make up ``[first, last)``."""
    first, last = first.cast("long"), last.cast("long")
    parts = []
    for level in range(levels):
        inside = [(F.shiftright(first + ((1 << at) - 1), at), F.shiftright(last, at))
                  for at in (SHIFT * level, SHIFT * (level + 1))]
        (low, high), (up_low, up_high) = inside
        if level == levels - 1:
            parts.append(_blocks(level, low, high))
            continue
        split = up_low < up_high                      # larger blocks take the middle
        parts.append(_blocks(level, low, F.when(split, F.shiftleft(up_low, SHIFT)).otherwise(high)))
        parts.append(_blocks(level, F.when(split, F.shiftleft(up_high, SHIFT)).otherwise(high), high))
    return F.concat(*parts)


def holding(at: Column, end: Column | None = None, levels: int = LEVELS) -> Column:
    """Array of ``(level, block)`` that hold a point; with ``end`` only levels whose blocks fit below it."""
    at = at.cast("long")
    every = F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright(at, SHIFT * level).alias("block"))
                      for level in range(levels)])
    if end is None:
        return every
    fits = F.lit(1)
    for level in range(1, levels):
        fits = fits + (end.cast("long") >= F.lit(1 << (SHIFT * level))).cast("int")
    return F.slice(every, F.lit(1), fits)
