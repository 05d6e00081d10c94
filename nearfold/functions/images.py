"""Image size rules as column expressions (integer division on the side that follows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("long")


def limit_size(w: Column, h: Column, most: int) -> tuple[Column, Column]:
    """Scaled down so that the longer side is at most ``most``."""
    fits, wide = F.greatest(w, h) <= most, w >= h
    return F.when(fits, w).when(wide, F.lit(most)).otherwise(_div(w * most, h)), F.when(fits, h).when(wide, _div(h * most, w)).otherwise(F.lit(most))


def limit_below(w: Column, h: Column, least: int) -> tuple[Column, Column]:
    """Scaled up so that the shorter side is at least ``least``."""
    fits, narrow = F.least(w, h) >= least, w <= h
    return F.when(fits, w).when(narrow, F.lit(least)).otherwise(_div(w * least, h)), F.when(fits, h).when(narrow, _div(h * least, w)).otherwise(F.lit(least))
