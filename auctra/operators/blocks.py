"""Pairs within a radius, looked at in blocks and never written as rows.

Left rows lie in cells as wide as the radius, right rows go to all cells around them, and a (cell, part) is one cogroup of number columns. A cell with much to do has
several parts: its left rows are dealt over them. Inside, numpy compares tiles of left rows with the right ones and keeps only what a left (or right) row needs, so what is written grows
with the rows; the comparisons still grow with the pairs of neighbouring cells, at some nanoseconds each. Distances near a radius are taken by the exact formula.
A cogroup holds the numbers of one neighbourhood and a tile of ``TILE`` pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from auctra.functions.geo import EARTH_M, cells_around, own_cell
from auctra.tables import materialise

#: Pairs compared at once; pairs of one part.
TILE, PART = 1 << 17, 1 << 30
#: Share of a squared distance by which the fast formula may be off.
SLACK = 1e-6


def code(c: str | Column) -> Column:
    """A text as a number that can be compared, 0 for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(c))


def number(c: str | Column) -> Column:
    """A double; null is NaN to a kernel, NaN is beyond all numbers."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.isnan(c), F.lit(math.inf)).otherwise(c)


def metres(lat1, lon1, lat2, lon2) -> np.ndarray:
    a, b, c, d = (np.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def _sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], 1)


class Tile:
    """Left rows lo to hi against all right rows."""

    def __init__(self, left: dict, right: dict, lo: int, hi: int, squares: np.ndarray, off: float):
        self.lo, self.hi, self.squares, self.off, self._left, self._right = lo, hi, squares, off, left, right

    def __getitem__(self, name: str) -> np.ndarray:
        """A left column, to be compared with right ones."""
        return self._left[name][self.lo : self.hi, None]

    def metres(self, flat: np.ndarray) -> np.ndarray:
        """Distances of pairs, numbered row by row."""
        i, j = np.divmod(flat, self.squares.shape[1])
        return metres(self._left["lat"][self.lo + i], self._left["lon"][self.lo + i], self._right["r_lat"][j], self._right["r_lon"][j])

    def within(self, radius_m: float) -> np.ndarray:
        chord = (2 * math.sin(min(radius_m / EARTH_M, math.pi) / 2)) ** 2
        hit = self.squares <= chord * (1 + SLACK) + self.off
        unsure = np.flatnonzero(hit & (self.squares >= chord * (1 - SLACK) - self.off))
        if len(unsure):
            hit.ravel()[unsure] = self.metres(unsure) <= radius_m
        return hit

    def roughly(self, flat: np.ndarray) -> np.ndarray:
        """Distances by the fast formula."""
        return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(np.maximum(0.0, self.squares.ravel()[flat])) / 2))

    def up_to(self, squares: np.ndarray) -> np.ndarray:
        """Pairs whose distance may be up to that of the given squares (a column or a row of them)."""
        return self.squares <= squares * (1 + SLACK) + self.off


def tiles(left: dict, right: dict) -> Iterator[Tile]:
    n, m = len(left["lat"]), len(right["r_lat"])
    step = max(1, TILE // max(1, m))
    centre = _sphere(left["lat"][:1], left["lon"][:1])
    a, b = _sphere(left["lat"], left["lon"]) - centre, _sphere(right["r_lat"], right["r_lon"]) - centre
    aa, bb, twice = (a * a).sum(1), (b * b).sum(1), np.ascontiguousarray(-2 * b.T)
    off = 1e-15 * float(np.nanmax(aa) + np.nanmax(bb)) + 1e-18
    for lo in range(0, n, step):
        squares = a[lo : lo + step] @ twice
        squares += aa[lo : lo + step, None]
        squares += bb
        yield Tile(left, right, lo, min(n, lo + step), squares, off)


def group_starts(flat: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Where each row's pairs begin among pairs numbered row by row, and the end."""
    return np.searchsorted(flat, np.arange(shape[0] + 1) * shape[1])


def medians(hit: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, median) of the values hit by each row; values are in ascending order."""
    flat = np.flatnonzero(hit)
    start = group_starts(flat, hit.shape)
    n, out = np.diff(start), np.full(len(hit), np.nan)
    some = n > 0
    at = lambda k: values[flat[(start[:-1] + k)[some]] % hit.shape[1]]
    low, high = at((n - 1) // 2), at(n // 2)
    out[some] = np.where(low == high, low, 0.5 * low + 0.5 * high)
    return n, out


def near_area(tile: Tile, area: np.ndarray, pct: float) -> np.ndarray:
    """``spatial._near_area`` of the left ``area`` and right ones."""
    own = tile["area"]
    fits = (area >= own * (1 - pct / 100)) & (area <= own * (1 + pct / 100))
    fits |= np.isnan(own)
    if np.isnan(area).any():
        fits |= np.isnan(area) & (own <= 0)
    return fits


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def compared(left: DataFrame, right: DataFrame, key: str, radius_m: float, kernel: Callable[[dict, dict], dict], schema: str, on: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """What ``kernel`` gives for each (cell, part), as columns of ``schema``; in numbers NaN is null.

    left: key, lat, lon and numbers; right: r_lat, r_lon and numbers. ``on``: whole numbers that both sides have and that must be equal. Right rows come in ascending
    ``order``, null last. A left row lies in one part, with every right row that may be in reach. Rows without coordinates are left out.
    """
    cell = ["y", "x", *on]
    near = left.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("g", own_cell("lat", "lon", radius_m)).select("g.*", "*").drop("g")
    # Spread first, as a small file is one task and the cells around a row are many.
    there = right.where("r_lat IS NOT NULL AND r_lon IS NOT NULL").repartition(_tasks(right))
    around = there.withColumn("g", F.explode(cells_around("r_lat", "r_lon", radius_m))).select("g.*", "*").drop("g")
    asked = near.groupBy(*cell).agg(F.count("*").alias("n_left"))
    held = around.groupBy(*cell).agg(F.count("*").alias("n_right"))
    parts = materialise(asked.join(held, cell).select(*cell, F.ceil(F.col("n_left") * F.col("n_right") / PART).cast("int").alias("parts")), "cells")
    near = near.join(parts, cell).withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).drop("parts")
    around = around.join(parts, cell).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    group = [*cell, "part"]
    near, around = (df.select(*group, *[c for c in df.columns if c not in group]) for df in (near, around))
    arrow, skip = _schema(schema), len(group)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return arrow.empty_table()
        x, y = ({c: t.column(c).to_numpy() for c in t.column_names[skip:]} for t in (a, b))
        if order is not None:
            by = np.argsort(y[order], kind="stable")
            y = {c: v[by] for c, v in y.items()}
        found = kernel(x, y)
        return pa.Table.from_arrays([pa.array(found[f.name], type=f.type, from_pandas=True) for f in arrow], schema=arrow)

    return cogrouped(near, around, group).applyInArrow(run, schema)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cogrouped(left: DataFrame, right: DataFrame, group: list[str]):
    """Groups spread over all tasks: they are few bytes, but much work."""
    n = _tasks(left)
    return left.repartition(n, *group).groupby(*group).cogroup(right.repartition(n, *group).groupby(*group))


def typed(df: DataFrame, *names: str) -> str:
    """Columns with their types, for a schema."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def stacked(parts: list[dict]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def filled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values with 0 for null, whether there is one)."""
    known = ~np.isnan(x)
    return np.where(known, x, 0.0), known
