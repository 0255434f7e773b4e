"""What an object's row says of its space: axes, voxel size and centre, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spatial_axes(order: str) -> str:
    """The spatial axes of an order of axes, which may begin with channels: ``ZYX`` or ``YX``."""
    return "".join(a for a in order.upper() if a in "ZYX")


def voxel_size(axes: str) -> Column:
    """Array of an object's voxel size along ``axes``; null if one is missing."""
    parts = [F.col(f"pixel_size_{a}").cast("double") for a in axes.upper()]
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return F.when(known, F.array(*parts))


def object_center(axes: str) -> Column:
    """Array of an object's centre along ``axes`` in micrometres; null if one is missing."""
    parts = [F.col(f"object_center_{a.lower()}_um").cast("double") for a in axes]
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return F.when(known, F.array(*parts))
