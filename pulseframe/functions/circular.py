"""Angles in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(angle: Column) -> Column:
    """[0, 360)."""
    return F.pmod(angle, F.lit(360.0))


def separation(a: Column, b: Column) -> Column:
    """The smaller arc between two angles, [0, 180]."""
    d = wrap(a - b)
    return F.least(d, 360.0 - d)


def harmonic(angle: Column, k: int) -> tuple[Column, Column]:
    return F.sin(F.radians(angle * k)), F.cos(F.radians(angle * k))


def cardinal_offset(angle: Column, step: float = 90.0) -> Column:
    """Distance to the nearest multiple of step."""
    r = F.pmod(angle, F.lit(step))
    return F.least(r, step - r)


def direction(sin_sum: Column, cos_sum: Column) -> Column:
    return wrap(F.degrees(F.atan2(sin_sum, cos_sum)))


def unwrap_step(delta: Column) -> Column:
    """What an unwrapped angle in radians adds for a raw step."""
    return F.when(delta > F.pi(), -2 * F.pi()).when(delta < -F.pi(), 2 * F.pi()).otherwise(F.lit(0.0))
