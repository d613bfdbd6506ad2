"""Great-circle distance and grid cells as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
DEGREE_M = EARTH_M * math.pi / 180


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Metres between two points."""
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def distance_to(lat, lon, point: tuple[float, float]) -> Column:
    return haversine_m(lat, lon, point[0], point[1])


def cell(lat, lon, step: float) -> Column:
    """Struct of the floor cell indexes."""
    return F.struct(F.floor(_c(lat) / step).alias("y"), F.floor(_c(lon) / step).alias("x"))


def cell_rounded(lat, lon, per_degree: float = 2000) -> Column:
    """Text key of the nearest grid point, halves to even."""
    return F.concat_ws("_", F.rint(_c(lat) * per_degree).cast("long"), F.rint(_c(lon) * per_degree).cast("long"))


def _lon_step(row: Column, step: float) -> Column:
    """Width of the cells of a row in degrees: at least ``step`` degrees of latitude everywhere in the row."""
    edge = F.greatest(F.abs(row * step), F.abs((row + 1) * step))
    return step / F.greatest(F.cos(F.radians(F.least(edge, F.lit(89.0)))), F.lit(0.01))


def grid_step(radius_m: float) -> float:
    """Rows as high as the radius, with a margin for rounding."""
    return radius_m * 1.0001 / DEGREE_M


def own_cell(lat, lon, radius_m: float) -> Column:
    step = grid_step(radius_m)
    row = F.floor(_c(lat) / step)
    return F.struct(row.alias("y"), F.floor(_c(lon) / _lon_step(row, step)).alias("x"))


def cells_around(lat, lon, radius_m: float) -> Column:
    """Array of all cells that may hold points within the radius; cells narrow with the cosine of latitude."""
    step = grid_step(radius_m)
    row = F.floor(_c(lat) / step)

    def of_row(r: Column) -> Column:
        w = _lon_step(r, step)
        # Beyond the 180th meridian the cells go on at the other end.
        turns = F.filter(F.array(*[F.lit(t) for t in (0.0, -360.0, 360.0)]), lambda t: (t == 0) | F.abs(_c(lon) + t).between(0, 180 + w))
        xs = F.flatten(F.transform(turns, lambda t: F.sequence(F.floor((_c(lon) + t - w) / w), F.floor((_c(lon) + t + w) / w))))
        return F.transform(F.array_distinct(xs), lambda x: F.struct(r.alias("y"), x.alias("x")))

    return F.flatten(F.transform(F.sequence(row - 1, row + 1), of_row))
