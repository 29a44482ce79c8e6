"""Pixel values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_channel(channels: Column) -> Column:
    """Channel 0 of red-green-blue; Spark's image source stores blue first, and gray alone."""
    return F.when(F.size(channels) >= 3, F.get(channels, F.lit(2))).otherwise(F.get(channels, F.lit(0)))


def wrap(value: Column, bits: int) -> Column:
    """Narrowing to an unsigned integer, modulo 2 ** bits."""
    return F.pmod(value, F.lit(1 << bits))


def window(value: Column, low: Column, high: Column) -> Column:
    """Intensities between low and high on 0..255, rounded half to even."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return F.rint(share * 255).cast("long")
