"""World coordinates, grid cells and closed-form map projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import UnreadableRasters

RADIUS = 6378137.0  # of EPSG:3857's sphere, in metres
#: A cell outside of any grid, for coordinates that are not finite.
NOWHERE = -2147483648


def _floor(x: Column) -> Column:
    finite = ~F.isnan(x) & (F.abs(x) < 2147483000.0)
    return F.when(finite, F.floor(x).cast("int")).when(x.isNotNull(), F.lit(NOWHERE))


def world_to_cell(transform: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    """(row, col) by the inverse of the affine transform (a, b, c, d, e, f)."""
    a, b, c, d, e, f = map(float, transform)
    det = a * e - b * d
    if det == 0:
        raise UnreadableRasters("degenerate_transform", "the transform of the raster has no inverse")
    dx, dy = x - F.lit(c), y - F.lit(f)
    col = (F.lit(e) * dx - F.lit(b) * dy) / F.lit(det)
    row = (F.lit(a) * dy - F.lit(d) * dx) / F.lit(det)
    return _floor(row), _floor(col)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857."""
    return F.radians(lon) * RADIUS, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 to EPSG:4326."""
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - F.lit(math.pi / 2))
