"""Time <-> y, grid cells and viewport arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LINEAR, LOG = "linear", "log"

# Grid cell sizes of the thinning operators.
DEFAULT_CELL = 0.002
MIN_CELL = 0.0004
MAX_CELL = 0.002
INSIDE_MAX_MULTIPLIER = 0.95
KEEP_ALL_INSIDE_MULTIPLIER = 0.35


def scale_name(scale: str | None) -> str:
    """``linear`` or ``log``; anything else means linear."""
    name = scale.strip().lower() if isinstance(scale, str) else LINEAR
    return name if name in (LINEAR, LOG) else LINEAR


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def _clip(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low) if not isinstance(low, Column) else low),
                   F.lit(high) if not isinstance(high, Column) else high)


def bounds(time_range) -> tuple[Column, Column]:
    """``(t_min, t_max)`` of a one-row frame, both from the same scalar subquery."""
    row = time_range.select(F.struct("t_min", "t_max")).scalar()
    return row["t_min"], row["t_max"]


def time_to_y(time: Column, t_min: Column, t_max: Column, scale: str | None = None) -> Column:
    """1 at the youngest time, 0 at the oldest; 1 everywhere without a time range."""
    span = t_max.cast("double") - t_min.cast("double")
    offset = _clip(time.cast("double") - t_min, 0.0, span)
    share = F.log1p(offset) / F.log1p(span) if scale_name(scale) == LOG else offset / span
    y = F.when(_finite(span) & (span > 0), F.lit(1.0) - share).otherwise(F.lit(1.0))
    return F.when(time.isNull(), F.lit(None)).otherwise(y).cast("float")


def rescale_y(y: Column, t_min: Column, t_max: Column, scale: str | None = None) -> Column:
    """Carry an existing linear y over to the requested scale."""
    span = t_max.cast("double") - t_min.cast("double")
    time = t_max.cast("double") - _clip(y.cast("double"), 0.0, 1.0) * span
    return time_to_y(time, t_min, t_max, scale)


def y_to_time(y: Column, t_min: Column, t_max: Column, scale: str | None = None) -> Column:
    """Inverse of :func:`time_to_y`; the youngest time without a time range."""
    span = t_max.cast("double") - t_min.cast("double")
    share = F.lit(1.0) - _clip(y.cast("double"), 0.0, 1.0)
    offset = F.expm1(share * F.log1p(span)) if scale_name(scale) == LOG else share * span
    return F.when(_finite(span) & (span > 0), t_min + offset).otherwise(t_min.cast("double"))


def cell_size_for_nodes(n: Column) -> Column:
    """Cell edge from the node count: finer relative detail for small trees."""
    n = n.cast("double")
    per_cell = _clip(F.lit(10.0) * F.sqrt(n / F.lit(100.0)), 10.0, 1000.0)
    cells = F.greatest(F.lit(1.0), n / per_cell)
    resolution = _clip(F.floor(F.sqrt(cells)), 5, 1000)
    return F.when(n <= 0, F.lit(DEFAULT_CELL)).otherwise(F.lit(1.0) / resolution)


def usable_multiplier(value) -> float:
    """A positive finite multiplier, else 1."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        return 1.0
    return number if 0 < number < float("inf") else 1.0


def cell_size(n: Column, size: float | Column | None = None, multiplier=None) -> Column:
    """Effective cell edge: given or derived, scaled, and held within the limits."""
    base = cell_size_for_nodes(n) if size is None else (
        size if isinstance(size, Column) else F.lit(float(size)))
    return _clip(base * F.lit(usable_multiplier(multiplier)), MIN_CELL, MAX_CELL)


def inside_cell_size(n: Column, outside: Column, multiplier=None) -> Column:
    """Cell edge inside the focus box; never coarser than outside it."""
    wanted = F.lit(min(usable_multiplier(multiplier), INSIDE_MAX_MULTIPLIER))
    factor = F.greatest(wanted, F.lit(MIN_CELL) / outside)
    inside = _clip(outside * factor, MIN_CELL, MAX_CELL)
    return F.when(inside >= outside,
                  F.greatest(F.lit(MIN_CELL), outside * F.lit(INSIDE_MAX_MULTIPLIER))
                  ).otherwise(inside)


def resolution(cell: Column) -> Column:
    """Cells per unit length."""
    return F.floor(F.lit(1.0) / cell).cast("long")


def grid_cell(c: Column, res: Column) -> Column:
    """Cell number of a coordinate in 0..1, the upper end joining the last cell."""
    return F.least((c.cast("double") * res).cast("long"), res - 1)


def midpoint(a: Column, b: Column) -> Column:
    """Mean of two single-precision coordinates, summed in single precision."""
    return (a.cast("float") + b.cast("float")).cast("double") / F.lit(2.0)


def direction_bin(x: Column, y: Column, px: Column, py: Column) -> Column:
    """0..7: sign of dx, sign of dy, and whether the edge is steeper than wide."""
    dx, dy = px - x, py - y
    return ((dx >= 0).cast("int") + F.lit(2) * (dy >= 0).cast("int")
            + F.lit(4) * (F.abs(dy) > F.abs(dx)).cast("int"))


def detail_level(group_size: Column, scale: float) -> Column:
    """1..3; fewer details for crowded slots and far zooms."""
    level = F.lit(3) - F.floor(F.log10(F.greatest(F.lit(1.0), group_size.cast("double")))
                               + F.lit(_log10(max(1.0, scale)) / 2.0))
    level = _clip(level, 1, 3).cast("int")
    return F.when((group_size == 1) & F.lit(scale <= 1), F.lit(3)).otherwise(level)


def _log10(value: float) -> float:
    from math import log10
    return log10(value)


def sentinels(c: Column) -> Column:
    """NULL id -> -1 at the boundary."""
    return F.coalesce(c, F.lit(-1))
