"""Spatial joins on a grid: equi-joins on cells, exact distance afterwards; sums and medians around a row in blocks (``blocks``), without its pairs."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

from auctra.functions.geo import EARTH_M, cells_around, haversine_m, own_cell
from auctra.operators import blocks as B
from auctra.operators.components import connected_components
from auctra.tables import discard, materialise


def radius_join(left: DataFrame, right: DataFrame, radius_m: float, left_at=("lat", "lon"), right_at=("r_lat", "r_lon"), on: list[str] | None = None, inner_m: float | None = None) -> DataFrame:
    """Pairs within ``radius_m`` (and beyond ``inner_m``), with ``distance_m``.

    Column names of the two sides must differ, but for the further equality keys ``on``. The left
    side is the smaller one: its rows go to all cells around them. Both sides of the join are plain
    exchanges on the cell, so adaptive execution can split a dense cell. Rows without coordinates have no partner.
    """
    near = left.where(F.col(left_at[0]).isNotNull() & F.col(left_at[1]).isNotNull()).withColumn("grid", F.explode(cells_around(*left_at, radius_m)))
    there = right.where(F.col(right_at[0]).isNotNull() & F.col(right_at[1]).isNotNull()).withColumn("grid", own_cell(*right_at, radius_m))
    # Merged, as sizes are estimated without the cells: a side that looks small must not be gathered at the driver.
    pairs = near.hint("merge").join(there, ["grid", *(on or [])]).withColumn("distance_m", haversine_m(*left_at, *right_at)).drop("grid")
    pairs = pairs.where(F.col("distance_m") <= radius_m)
    return pairs if inner_m is None else pairs.where(F.col("distance_m") > inner_m)


#: Levels of the pyramid over latitude and longitude: a cell of level v has 2^-v of the range on either axis.
LEVELS = (0, 4, 8, 10, 12, 14, 16, 18, 20)


def _turned(lon: str) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(F.col(lon) + 180, F.lit(360.0)) - 180


def _finest(lat: str, lon: str) -> list[Column]:
    """Row and column of the finest cell."""
    cell = lambda c, low, span: F.least(F.floor((c - low) / span * (1 << LEVELS[-1])), F.lit((1 << LEVELS[-1]) - 1)).cast("int")
    return [cell(F.col(lat), -90, 180).alias("y"), cell(_turned(lon), -180, 360).alias("x")]


def _node(level: int) -> list[Column]:
    """Row and column of a row's cell at a level, from those at the finest one."""
    return [F.shiftright(c, LEVELS[-1] - level).alias(c) for c in ("y", "x")]


def _code(level) -> Column:
    return ((level if isinstance(level, Column) else F.lit(level)).cast("long") * F.lit(1 << 40) + F.col("y").cast("long") * F.lit(1 << 20) + F.col("x")).alias("code")


def pyramid(right: DataFrame, at: tuple[str, str], cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, cells): a node (code, parent, n, its rows' box, leaf) is split while it has more than ``cell_rows`` rows; cells give the leaf of each finest cell."""
    finest = LEVELS[-1]
    placed = right.select(*_finest(*at), F.col(at[0]).alias("lat"), _turned(at[1]).alias("lon"))
    box = [F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi"), F.min("lon").alias("lon_lo"), F.max("lon").alias("lon_hi")]
    grid = materialise(placed.groupBy("y", "x").agg(F.count("*").alias("n"), *box), "pyramid-grid")
    leaf = F.lit(finest)
    cells = grid.select("y", "x")
    for level in reversed(LEVELS[:-1]):
        sums = grid.groupBy(*_node(level)).agg(F.sum("n").alias(f"n{level}")).withColumnsRenamed({"y": "py", "x": "px"})
        up = [F.shiftright(c, finest - level) for c in ("y", "x")]
        cells = cells.join(sums, (up[0] == F.col("py")) & (up[1] == F.col("px"))).drop("py", "px")
        leaf = F.when(F.col(f"n{level}") <= cell_rows, level).otherwise(leaf)
    cells = materialise(cells.select("y", "x", leaf.alias("leaf_level")), "pyramid-cells")
    levelled, nodes = grid.join(cells, ["y", "x"]), None
    again = [F.sum("n").alias("n"), F.min("lat_lo").alias("lat_lo"), F.max("lat_hi").alias("lat_hi"), F.min("lon_lo").alias("lon_lo"), F.max("lon_hi").alias("lon_hi")]
    for k, level in enumerate(LEVELS):
        part = levelled.where(F.col("leaf_level") >= level).groupBy(*_node(level)).agg(*again, F.max(F.col("leaf_level") == level).alias("leaf"))
        step = level - LEVELS[k - 1] if k else 0
        parent = F.lit(None).cast("long") if not k else LEVELS[k - 1] * F.lit(1 << 40) + F.shiftright("y", step).cast("long") * F.lit(1 << 20) + F.shiftright("x", step)
        part = part.select(_code(level), parent.alias("parent"), "n", "lat_lo", "lat_hi", "lon_lo", "lon_hi", "leaf")
        nodes = part if nodes is None else nodes.unionByName(part)
    nodes = materialise(nodes, "pyramid-nodes")
    discard(grid)
    return nodes, cells


def box_bounds(lat: Column, lon: Column, lat_lo: Column, lat_hi: Column, lon_lo: Column, lon_hi: Column) -> tuple[Column, Column]:
    """Metres that no point of a box is nearer than, and none is farther than.

    Nearer: the gap in latitude; the arc to the closest of the box's meridians. Farther: along the own parallel, then along a meridian.
    """
    gap_lat = F.greatest(lat_lo - lat, lat - lat_hi, F.lit(0.0))
    turns = [F.greatest(lon_lo - (lon + t), lon + t - lon_hi, F.lit(0.0)) for t in (0.0, -360.0, 360.0)]
    gap_lon = F.least(*turns)
    phi = F.radians(lat)
    arc = F.when(gap_lon < 90, F.asin(F.least(F.lit(1.0), F.sin(F.radians(gap_lon)) * F.cos(phi)))).otherwise(F.lit(math.pi / 2) - F.abs(phi))
    nearer = EARTH_M * F.greatest(F.radians(gap_lat), arc)
    far_lat = F.greatest(F.abs(lat - lat_lo), F.abs(lat - lat_hi))
    far_lon = F.least(F.lit(180.0), F.greatest(F.abs(lon - lon_lo), F.abs(lon - lon_hi)))
    farther = EARTH_M * F.least(F.lit(math.pi), F.radians(far_lat) + F.cos(phi) * F.radians(far_lon))
    return F.greatest(F.lit(0.0), nearer * (1 - 1e-9) - 0.01), farther * (1 + 1e-9) + 0.01  # distances are rounded


def nearest_leaves(left: DataFrame, nodes: DataFrame, left_id: str, k: int, at: tuple[str, str], spread: str | None = None) -> DataFrame:
    """(left_id, its coordinates, code, n) of the leaves that may hold one of a row's k nearest, or of those of any point within ``spread`` metres of it.

    All rows descend together, a level at a time. At each level the nodes that surely hold k rows within a radius limit it, and
    nodes beyond it go.
    """
    columns = ["code", "n", "lat_lo", "lat_hi", "lon_lo", "lon_hi", "leaf"]
    root = nodes.where("parent IS NULL").first()
    if root is None:
        return left.limit(0).select(left_id, *at, F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("n"))
    now = left.where(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull()).select(left_id, *at, F.col(at[0]).alias("q_lat"), _turned(at[1]).alias("q_lon"), (F.col(spread) if spread else F.lit(0.0)).alias("q_m"), *[F.lit(root[c]).alias(c) for c in columns])
    asked = [left_id, *at, "q_lat", "q_lon", "q_m"]
    children = nodes.select(F.col("parent").alias("code"), *[F.col(c).alias(f"c_{c}") for c in columns])
    everyone = W.partitionBy(left_id)
    written = None
    for _ in LEVELS[1:]:
        kids = now.where("NOT leaf").select(*asked, "code").join(children, "code").select(*asked, *[F.col(f"c_{c}").alias(c) for c in columns])
        both = now.where("leaf").unionByName(kids)
        nearer, farther = box_bounds(*[F.col(c) for c in ("q_lat", "q_lon", "lat_lo", "lat_hi", "lon_lo", "lon_hi")])
        both = both.withColumns({"nearer": nearer, "farther": farther}).withColumn("held", F.sum("n").over(everyone.orderBy("farther", "code").rowsBetween(W.unboundedPreceding, 0)))
        both = both.withColumn("limit", F.min(F.when(F.col("held") >= k, F.col("farther"))).over(everyone))
        now = materialise(both.where("limit IS NULL OR nearer <= limit + 2 * q_m").drop("nearer", "farther", "held", "limit"), "nearest-nodes")
        if written is not None:
            discard(written)
        written = now
        if not now.where("NOT leaf").limit(1).count():
            break
    return now.select(left_id, *at, "code", "n")


def _crowds(left: DataFrame, nodes: DataFrame, at: tuple[str, str]) -> DataFrame:
    """(y, x of finest cells, ``crowd``): left rows go with those of the largest cell around them that the pyramid does not split."""
    spots = left.select(*_finest(*at)).distinct()
    up = lambda c, level: F.shiftright(c, LEVELS[-1] - level)
    place = lambda level: F.lit(level).cast("long") * F.lit(1 << 40) + up("y", level).cast("long") * F.lit(1 << 20) + up("x", level)
    above = spots.select("y", "x", F.explode(F.array(*[F.struct(place(level).alias("code"), F.lit(k).alias("depth")) for k, level in enumerate(LEVELS)])).alias("a")).select("y", "x", "a.*")
    split = above.join(nodes.where("NOT leaf").select("code"), "code").groupBy("y", "x").agg((F.max("depth") + 1).alias("depth"))
    own = F.array(*[place(level) for level in LEVELS])
    return spots.join(split, ["y", "x"], "left").select("y", "x", F.get(own, F.coalesce("depth", F.lit(0))).alias("crowd"))


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int = 1, left_at=("lat", "lon"), right_at=("r_lat", "r_lon"), cell_rows: int = 64, crowd_rows: int = 4096) -> DataFrame:
    """The k nearest right rows of every left row, ``rank`` from 1; ties by ``right_id``.

    A pyramid of cells is descended by bounds (``nearest_leaves``) once for all left rows of a cell that it does not split, ``crowd_rows`` at most, which then
    meet a few leaves of at most ``cell_rows`` spots, wherever they lie. Of right rows at one spot the first k count. Rows without coordinates get none, and are no neighbours.
    """
    first = F.row_number().over(W.partitionBy(*right_at).orderBy(right_id))
    located = right.where(F.col(right_at[0]).isNotNull() & F.col(right_at[1]).isNotNull()).withColumn("first", first).where(F.col("first") <= k).drop("first")
    located = materialise(located, "nearest-places")
    asked = left.where(F.col(left_id).isNotNull() & F.col(left_at[0]).isNotNull() & F.col(left_at[1]).isNotNull())
    nodes, cells = pyramid(located, right_at, cell_rows)
    own = asked.select("*", *_finest(*left_at)).join(_crowds(asked, nodes, left_at), ["y", "x"]).drop("y", "x")
    size = F.ceil(F.count("*") / crowd_rows).cast("int").alias("parts")
    middle = lambda c: ((F.min(c) + F.max(c)) / 2)
    mids = own.groupBy("crowd").agg(size, middle(left_at[0]).alias("c_lat"), middle(_turned(left_at[1])).alias("c_lon"))
    reach = own.join(mids, "crowd").groupBy("crowd", "parts", "c_lat", "c_lon").agg((F.max(haversine_m(*left_at, "c_lat", "c_lon")) * (1 + 1e-9) + 0.01).alias("c_m"))
    reach = materialise(reach, "nearest-crowds")
    visits = nearest_leaves(reach, nodes, "crowd", k, ("c_lat", "c_lon"), "c_m").select("crowd", "code")
    up = lambda c: F.expr(f"shiftright({c}, {LEVELS[-1]} - leaf_level)").alias(c)
    rows = located.select("*", *_finest(*right_at)).join(cells, ["y", "x"])
    rows = rows.withColumns({"y": up("y"), "x": up("x")}).withColumn("code", _code(F.col("leaf_level"))).drop("y", "x", "leaf_level")
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    met = visits.join(reach.select("crowd", parts), "crowd").join(rows, "code").select("crowd", "part", *located.columns)
    own = own.join(reach.select("crowd", "parts"), "crowd").select("crowd", F.pmod(F.xxhash64(left_id, *left_at), F.col("parts")).cast("int").alias("part"), *asked.columns)
    ours, theirs = asked.columns, located.columns
    assert not set(ours) & set(theirs), "column names of the two sides must differ"
    schema = StructType([*asked.schema, *located.schema, StructField("distance_m", DoubleType()), StructField("rank", IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return arrow.empty_table()
        a, b = a.select(ours), b.select(theirs)
        b = b.take(pc.sort_indices(b, [(right_id, "ascending")], null_placement="at_start"))
        column = lambda t, c: t.column(c).cast("double").to_numpy()
        x, y = ({n: column(t, c) for n, c in zip(ns, at)} for t, ns, at in ((a, ("lat", "lon"), left_at), (b, ("r_lat", "r_lon"), right_at)))
        most, found = min(k, b.num_rows), []
        for t in B.tiles(x, y):
            flat = np.flatnonzero(t.up_to(np.partition(t.squares, most - 1, axis=1)[:, most - 1 : most]))
            i, j, d = flat // b.num_rows, flat % b.num_rows, t.metres(flat)
            by = np.lexsort((j, d, i))
            i = i[by]
            rank = np.arange(len(by)) - np.searchsorted(i, i) + 1
            keep = rank <= k
            found.append({"i": t.lo + i[keep], "j": j[by][keep], "d": d[by][keep], "rank": rank[keep]})
        f = B.stacked(found)
        both = [*a.take(f["i"]).columns, *b.take(f["j"]).columns, pa.array(f["d"]), pa.array(f["rank"], pa.int32())]
        return pa.Table.from_arrays([c.cast(to.type) for c, to in zip(both, arrow)], schema=arrow)

    return B.cogrouped(own, met, ["crowd", "part"]).applyInArrow(run, schema)


def _at(df: DataFrame, at: tuple[str, str], names: tuple[str, str], *more) -> DataFrame:
    """Coordinates under the names of ``blocks.compared``, and further columns."""
    return df.select(*more, *[F.col(c).cast("double").alias(n) for c, n in zip(at, names)])


def _left(df: DataFrame, key: str, *more, at=("lat", "lon")) -> DataFrame:
    return _at(df, at, ("lat", "lon"), key, *more)


def _right(df: DataFrame, *more, at=("r_lat", "r_lon")) -> DataFrame:
    return _at(df, at, ("r_lat", "r_lon"), *more)


def flag_near(lots: DataFrame, places: DataFrame, flag_m: float = 100, report_m: float = 300) -> DataFrame:
    """Adds ``near`` (a place within flag_m), ``near_m`` and ``near_name`` of the closest within report_m. Places: p_id, p_name, p_lat, p_lon."""
    # One place a spot, so that few are equally near; a spot without coordinates is near nothing.
    spots = places.groupBy("p_lat", "p_lon").agg(F.min(F.struct("p_id", "p_name")).alias("p")).select("p.*", "p_lat", "p_lon")

    def kernel(x: dict, y: dict) -> dict:
        found = []
        for t in B.tiles(x, y):
            least = np.where(t.within(report_m), t.squares, np.inf).min(1)
            flat = np.flatnonzero(t.up_to(np.where(np.isfinite(least), least, -1.0)[:, None]))
            i, m = flat // t.squares.shape[1], t.metres(flat)
            best = np.full(len(least), np.inf)
            np.minimum.at(best, i, m)
            keep = (m == best[i]) & (m <= report_m)
            found.append({"lot_id": x["lot_id"][t.lo + i[keep]], "distance_m": m[keep], **{c: y[c][flat[keep] % t.squares.shape[1]] for c in ("p_id", "p_name")}})
        return B.stacked(found)

    schema = f"{B.typed(lots, 'lot_id')}, distance_m double, {B.typed(spots, 'p_id', 'p_name')}"
    nearest_ones = B.compared(_left(lots, "lot_id"), _right(spots, "p_id", "p_name", at=("p_lat", "p_lon")), "lot_id", report_m, kernel, schema)
    best = nearest_ones.groupBy("lot_id").agg(F.min(F.struct("distance_m", "p_id", "p_name")).alias("b"))
    out = lots.join(best, "lot_id", "left")
    return out.withColumn("near", F.coalesce(F.col("b.distance_m") <= flag_m, F.lit(False))).withColumn("near_m", F.col("b.distance_m")).withColumn("near_name", F.col("b.p_name")).drop("b")


def radius_sum(left: DataFrame, right: DataFrame, key: str, value: str, radii: list[float], left_at=("lat", "lon"), right_at=("r_lat", "r_lon")) -> DataFrame:
    """Per left row the sum of ``value`` within each radius (0 if none), as ``sum_<radius>``; one comparison at the largest."""
    names = [f"sum_{r:g}" for r in radii]
    total = right.agg(F.sum(value)).schema[0].dataType.simpleString()

    def kernel(x: dict, y: dict) -> dict:
        found = []
        for t in B.tiles(x, y):
            flat = [np.flatnonzero(t.within(r)) for r in radii]
            rows, m = t.hi - t.lo, t.squares.shape[1]
            found.append({key: x[key][t.lo : t.hi], **{n: np.bincount(f // m, y["value"][f % m], rows) for n, f in zip(names, flat)}})
        return B.stacked(found)

    summed = _right(right, F.col(value).cast("double").alias("value"), at=right_at).where("value IS NOT NULL")
    sums = B.compared(_left(left, key, at=left_at), summed, key, max(radii), kernel, f"{B.typed(left, key)}, " + ", ".join(f"`{n}` double" for n in names))
    sums = sums.dropDuplicates([key]).select(key, *[F.col(f"`{n}`").cast(total).alias(n) for n in names])
    return left.join(sums, key, "left").fillna(0, names)


def radius_median(left: DataFrame, right: DataFrame, key: str, value: str, radii: list[float], min_n: int = 2, same: tuple[str, str] | None = None, left_at=("lat", "lon"), right_at=("r_lat", "r_lon")) -> DataFrame:
    """Per left row ``median_<r>`` and ``n_<r>`` of ``value`` within each radius; null below ``min_n``.

    ``same``: a left and a right column that must be equal; then ``median_same_<r>`` is added, which falls back to the median of all.
    """
    names = [f"{kind}_{r:g}" for r in radii for kind in ("n", "median", *(["median_same"] if same else []))]

    def kernel(x: dict, y: dict) -> dict:
        found = []
        for t in B.tiles(x, y):
            part = {key: x[key][t.lo : t.hi]}
            for r in radii:
                hit = t.within(r)
                n, mid = B.medians(hit, y["value"])
                mid = np.where(n >= min_n, mid, np.nan)
                part |= {f"n_{r:g}": n, f"median_{r:g}": mid}
                if same:
                    k, own = B.medians(hit & (t["same"] == y["same"]) & (t["same"] != 0), y["value"])
                    part[f"median_same_{r:g}"] = np.where(k >= min_n, own, mid)
            found.append(part)
        return B.stacked(found)

    code = lambda k: [B.code(same[k]).alias("same")] if same else []
    valued = _right(right, B.number(value).alias("value"), *code(1), at=right_at).where("value IS NOT NULL")
    schema = f"{B.typed(left, key)}, " + ", ".join(f"`{n}` {'long' if n.startswith('n_') else 'double'}" for n in names)
    found = B.compared(_left(left, key, *code(0), at=left_at), valued, key, max(radii), kernel, schema, order="value")
    return left.join(found.dropDuplicates([key]), key, "left").fillna(0, [f"n_{r:g}" for r in radii])


def _mirror(df: DataFrame, prefix: str = "r_") -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def count_within(left: DataFrame, right: DataFrame, key: str, radius_m: float, name: str, left_at=("lat", "lon"), right_at=("r_lat", "r_lon")) -> DataFrame:
    """(key, name): the right rows within the radius, of left rows that have any."""

    def kernel(x: dict, y: dict) -> dict:
        return B.stacked([{key: x[key][t.lo : t.hi], name: t.within(radius_m).sum(1)} for t in B.tiles(x, y)])

    return B.compared(_left(left, key, at=left_at), _right(right, at=right_at), key, radius_m, kernel, f"{B.typed(left, key)}, {name} long").where(F.col(name) > 0)


def radius_count(df: DataFrame, key: str, radius_m: float, exclude_self: bool = True) -> DataFrame:
    """Neighbours of each row in its own table, as ``neighbours``."""
    n = count_within(df, df, key, radius_m, "neighbours", right_at=("lat", "lon")).groupBy(key).agg((F.sum("neighbours") - int(exclude_self)).alias("neighbours"))
    return df.join(n, key, "left").fillna(0, ["neighbours"])


def clusters(df: DataFrame, key: str, radius_m: float) -> DataFrame:
    """(node, component): components of rows (key: long, lat, lon) within ``radius_m`` of each other; rows without a partner of another key are not listed.

    Rows of one cell, less than the radius across, are joined up by that and stand for its smallest key. Of two cells it only counts whether any of their
    rows are in reach, which a comparison tells by the first tile that has some. So links grow with the cells, not with the pairs.
    """
    small = own_cell("lat", "lon", radius_m * 0.7)
    rows = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("node"), F.col("lat").cast("double"), F.col("lon").cast("double"), small.alias("c"))
    least = rows.groupBy("c").agg(F.min("node").alias("rep"))
    rows = materialise(rows.join(least, "c").drop("c"), "cluster-rows")
    spots = materialise(rows.select("rep", "lat", "lon").distinct(), "cluster-spots")

    def kernel(x: dict, y: dict) -> dict:
        def cells(z: dict, names: list[str]) -> list[tuple[int, dict]]:
            by = np.argsort(z[names[0]], kind="stable")
            reps, start = np.unique(z[names[0]][by], return_index=True)
            return [(int(r), {c: z[c][k] for c in names[1:]}) for r, k in zip(reps, np.split(by, start[1:]))]

        found = []
        right = cells(y, ["r_rep", "r_lat", "r_lon"])
        for a, p in cells(x, ["rep", "lat", "lon"]):
            for b, q in right:
                gap = max(p["lat"].min() - q["r_lat"].max(), q["r_lat"].min() - p["lat"].max())
                if a < b and gap * math.pi / 180 * EARTH_M <= radius_m * 1.001 and any(t.within(radius_m).any() for t in B.tiles(p, q)):
                    found.append((a, b))
        found = np.array(found, np.int64).reshape(-1, 2)
        return {"u": found[:, 0], "v": found[:, 1]}

    near = B.compared(spots, spots.withColumnsRenamed({"rep": "r_rep", "lat": "r_lat", "lon": "r_lon"}), "rep", radius_m, kernel, "u long, v long")
    # A key at several places joins up their cells.
    first = rows.groupBy("node").agg(F.min("rep").alias("u"), F.max("rep").alias("last")).where("u != last").select("node", "u")
    twice = rows.join(first, "node").select("u", F.col("rep").alias("v"))
    joined = materialise(connected_components(near.unionByName(twice)), "cluster-joined")
    alone = rows.groupBy("rep").agg(F.max("node").alias("last")).where("last > rep").select(F.col("rep").alias("node"), F.col("rep").alias("component"))
    known = joined.unionByName(alone.join(joined, "node", "left_anti")).withColumnRenamed("node", "rep")
    return rows.join(known, "rep").groupBy("node").agg(F.min("component").alias("component"))


def lookalikes(lots: DataFrame, listings: DataFrame, radius_m: float = 700, area_pct: float = 50, object_type: str | None = None) -> DataFrame:
    """Listings (url, l_area, l_type, l_lat, l_lon, ..) near lots (lot_id, area, lat, lon); each URL at its nearest lot. A null area passes."""
    listings = listings if object_type is None else listings.where(F.col("l_type") == object_type)

    def kernel(x: dict, y: dict) -> dict:
        found, own = [], y["area"]
        low, high, passes = own * (1 - area_pct / 100), own * (1 + area_pct / 100), np.isnan(own)
        for t in B.tiles(x, y):
            area, m = t["l_area"], len(own)
            fits = (area >= low) & (area <= high)
            fits |= passes
            fits |= np.isnan(area)
            fits &= t.within(radius_m)
            close = np.where(fits, t.squares, np.inf)
            least = close.min(1)
            flat = np.flatnonzero(close <= np.where(np.isfinite(least), least * (1 + B.SLACK) + t.off, -1.0)[:, None])
            d, i, j = t.metres(flat), flat // m, flat % m
            first = np.lexsort((j, d, i))  # lots come in order
            first = first[np.unique(i[first], return_index=True)[1]]
            found.append({"url": x["url"][t.lo + i[first]], "lot_id": y["lot_id"][j[first]], "distance_m": d[first]})
        return B.stacked(found)

    asked = _left(listings, "url", B.number("l_area").alias("l_area"), at=("l_lat", "l_lon"))
    near = B.compared(asked, _right(lots, "lot_id", B.number("area").alias("area"), at=("lat", "lon")), "url", radius_m, kernel, f"{B.typed(listings, 'url')}, {B.typed(lots, 'lot_id')}, distance_m double", order="lot_id")
    best = near.groupBy("url").agg(F.min(F.struct("distance_m", "lot_id")).alias("b")).select("url", "b.*")
    return best.join(listings, "url").join(lots, "lot_id").dropDuplicates(["url"])


def _near_area(area: str, other: str, pct: float) -> Column:
    return F.coalesce(F.col(other).between(F.col(area) * (1 - pct / 100), F.col(area) * (1 + pct / 100)), F.col(area).isNull() | (F.col(area) <= 0))


def territorial_median(lots: DataFrame, listings: DataFrame, radius_m: float = 700, area_pct: float = 50, hard: tuple = ("floor",), soft: tuple = ("entrance",), min_n: int = 2) -> DataFrame:
    """Median price of listings (l_floor, l_area, l_entrance, l_price, l_lat, l_lon) around lots.

    A null attribute of the lot filters nothing. A soft attribute filters only if ``min_n`` listings remain; below ``min_n`` there is no median.
    """
    left = _left(lots, "lot_id", B.number("area").alias("area"), *[B.code(c).alias(c) for c in (*hard, *soft)])
    right = _right(listings.where("l_price IS NOT NULL"), B.number("l_area").alias("l_area"), B.number("l_price").alias("l_price"), *[B.code(f"l_{c}").alias(f"l_{c}") for c in (*hard, *soft)], at=("l_lat", "l_lon"))
    schema = f"{B.typed(lots, 'lot_id')}, n long, m long, mid double, tight double"

    def kernel_of(tested: tuple):
        def kernel(x: dict, y: dict) -> dict:
            found = []
            for t in B.tiles(x, y):
                hit = t.within(radius_m) & B.near_area(t, y["l_area"], area_pct)
                same = lambda c: (t[c] == 0) | (t[c] == y[f"l_{c}"])  # noqa: B023, E731
                for c in tested:
                    hit &= same(c)
                n, mid = B.medians(hit, y["l_price"])
                for c in soft:
                    hit &= same(c)
                m, tight = B.medians(hit, y["l_price"])
                found.append({"lot_id": x["lot_id"][t.lo : t.hi], "n": n, "m": m, "mid": mid, "tight": tight})
            return B.stacked(found)

        return kernel

    # Lots that have all hard attributes meet listings that share them; the others, if there are any, meet all.
    whole = reduce(lambda a, b: a & b, [F.col(c) != 0 for c in hard], F.lit(True))
    found = B.compared(left.where(whole), right.withColumnsRenamed({f"l_{c}": c for c in hard}), "lot_id", radius_m, kernel_of(()), schema, on=tuple(hard), order="l_price")
    rest = left.where(~whole)
    if hard and rest.limit(1).count():
        found = found.unionByName(B.compared(rest, right, "lot_id", radius_m, kernel_of(tuple(hard)), schema, order="l_price"))
    n, m = F.col("n"), F.col("m")
    agg = found.dropDuplicates(["lot_id"]).select("lot_id", F.when(m >= min_n, F.col("tight")).when(n >= min_n, F.col("mid")).alias("territorial"), F.when(m >= min_n, m).otherwise(n).alias("territorial_n"))
    return lots.join(agg, "lot_id", "left").fillna(0, ["territorial_n"])


def _loo(listings: DataFrame, radius_m: float, kernel, schema: str, *more: str, same_floor: bool = True) -> DataFrame:
    """``blocks.compared`` of listings (url, floor, area, price, ..) with themselves, by ascending ``r_price``, null last."""
    own = [B.number("area").alias("area"), *[B.code(c).alias(c) for c in more], *([B.code("floor").alias("floor")] if same_floor else [])]
    left = _left(listings, "url", *own, B.number("price").alias("price"))
    right = _right(listings, B.number("area").alias("r_area"), B.number("price").alias("r_price"), *[B.code(c).alias(f"r_{c}") for c in more], *([B.code("floor").alias("floor")] if same_floor else []), at=("lat", "lon"))
    if same_floor:
        left, right = left.where("floor != 0"), right.where("floor != 0")
    return B.compared(left, right, "url", radius_m, kernel, f"{B.typed(listings, 'url')}, {schema}", on=("floor",) if same_floor else (), order="r_price")


def loo_errors(listings: DataFrame, radius_m: float = 700, inner_m: float = 100, area_pct: float = 50, min_n: int = 2) -> DataFrame:
    """Leave-one-out median of each listing's surroundings, beyond its own building, and the relative error."""

    def kernel(x: dict, y: dict) -> dict:
        found, known = [], np.count_nonzero(~np.isnan(y["r_price"]))
        for t in B.tiles(x, y):
            hit = t.within(radius_m) & ~t.within(inner_m) & B.near_area(t, y["r_area"], area_pct)
            n, mid = B.medians(hit[:, :known], y["r_price"])
            found.append({"url": x["url"][t.lo : t.hi], "n": n, "estimate": mid})
        return B.stacked(found)

    est = _loo(listings, radius_m, kernel, "n long, estimate double").where(F.col("n") >= min_n).dropDuplicates(["url"])
    out = listings.join(est, "url", "left").fillna(0, ["n"])
    return out.withColumn("error_pct", (F.col("estimate") - F.col("price")) / F.col("price") * 100)


def loo_sweep(listings: DataFrame, radii: list[float], inner_m: float = 100, area_pct: float = 50, min_n: int = 2) -> DataFrame:
    """Coverage and error of ``loo_errors`` for several radii; one comparison at the largest."""

    def kernel(x: dict, y: dict) -> dict:
        found, known = [], np.count_nonzero(~np.isnan(y["r_price"]))
        for t in B.tiles(x, y):
            ring = ~t.within(inner_m) & B.near_area(t, y["r_area"], area_pct)
            for r in radii:
                hit = t.within(r) & ring
                found.append({"url": x["url"][t.lo : t.hi], "radius": np.full(t.hi - t.lo, float(r)), "n": hit.sum(1), "estimate": B.medians(hit[:, :known], y["r_price"])[1], "price": x["price"][t.lo : t.hi]})
        return B.stacked(found)

    est = _loo(listings, max(radii), kernel, "radius double, n long, estimate double, price double").where(F.col("n") >= min_n).dropDuplicates(["url", "radius"])
    err = (F.col("estimate") - F.col("price")) / F.col("price") * 100
    return est.groupBy("radius").agg(F.count("*").alias("covered"), F.avg(F.abs(err)).alias("mape"), F.median(err).alias("median_error"))


def loo_filters(listings: DataFrame, radius_m: float = 700, inner_m: float = 100, area_pct: float = 50, min_n: int = 2) -> DataFrame:
    """The 16 combinations of floor, area, type and 1/distance weighting, in one comparison.

    A weighted median is the smallest price at which the running weight reaches half of the total.
    """
    names = ["by_floor", "by_area", "by_type", "weighted"]

    def kernel(x: dict, y: dict) -> dict:
        found, price = [], y["r_price"]
        m, known = len(price), np.count_nonzero(~np.isnan(price))
        for t in B.tiles(x, y):
            ring = t.within(radius_m) & ~t.within(inner_m)
            filters = [(t["floor"] == y["r_floor"]) & (t["floor"] != 0), B.near_area(t, y["r_area"], area_pct), (t["type"] == y["r_type"]) & (t["type"] != 0)]
            for i in range(8):
                hit = reduce(lambda a, b: a & b, [f for b, f in enumerate(filters) if i >> b & 1], ring)
                n = hit.sum(1)
                _, plain = B.medians(hit[:, :known], price)
                # Missing prices come first in the running weight, so theirs are taken off the half to be reached.
                flat = np.flatnonzero(hit)
                run = np.concatenate([[0.0], np.cumsum(1 / np.maximum(t.roughly(flat), 1.0))])
                start, last = B.group_starts(flat, hit.shape), np.searchsorted(flat, np.arange(len(hit)) * m + known)
                begin, end, priced = run[start[:-1]], run[start[1:]], run[last]
                goal = (end - begin) / 2 * (1 - 1e-10) - (end - priced)
                at = np.maximum(np.searchsorted(run, begin + goal), start[:-1] + 1) - 1
                heavy = np.full(len(hit), np.nan)
                some = last > start[:-1]
                heavy[some] = price[flat[np.minimum(at, last - 1)[some]] % m]
                for weighted, estimate in ((False, plain), (True, heavy)):
                    part = {c: np.full(len(hit), bool(i >> b & 1)) for b, c in enumerate(names[:3])} | {"weighted": np.full(len(hit), weighted)}
                    keep = n >= min_n
                    found.append({c: v[keep] for c, v in (part | {"url": x["url"][t.lo : t.hi], "estimate": estimate, "price": x["price"][t.lo : t.hi]}).items()})
        return B.stacked(found)

    schema = ", ".join(f"{c} boolean" for c in names) + ", estimate double, price double"
    est = _loo(listings, radius_m, kernel, schema, "floor", "type", same_floor=False)
    return est.groupBy(*names).agg(F.count("*").alias("covered"), F.avg(F.abs((F.col("estimate") - F.col("price")) / F.col("price") * 100)).alias("mape"))
