"""Exact nearest neighbours in a metric space, by pivots and rings.

A bounded sample of the base gives pivots. Every base row lies in the cell of its nearest pivot and of a ring of
distances around it; a cell keeps the least and largest distance of its rows to all pivots. By the triangle inequality these
bound the distance of a query to all rows of a cell. A query first meets its closest cells until they hold k rows, and then only
cells whose bound is not beyond its k-th distance so far. Cells, at most ``PIVOTS * RINGS``, are the only table that goes to every task.

Vectors of few components (``FLAT`` at most) need no pivots: medians of a sample cut space into boxes of some ``BOX_ROWS`` rows, a query meets its own box
and then those that its k-th distance reaches into.

Where bounds say little (in the sample those of single rows leave more than ``OPENED`` of it) all pairs are compared: blocks of queries meet blocks
of base rows, a matrix product gives squared distances with a bound of their rounding, and what may be among the k nearest is computed exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from auctra.tables import discard, materialise

#: Rows among which pivots are chosen; most pivots and most rings around each; rows for which a cell is made.
SAMPLE, PIVOTS, RINGS, CELL_ROWS = 2048, 128, 64, 64
#: Share by which bounds give way, as distances are rounded.
SLACK = 1e-9
#: Rows of the sample whose bounds are looked at, and the share of rows left by them beyond which all pairs are compared.
PROBES, OPENED = 256, 0.25
#: Least and most rows of a block (fewer, if it would have more than ``BLOCK_NUMBERS`` numbers), blocks of queries and of base rows below that; queries and base rows of one product.
BLOCK_ROWS, BLOCK_NUMBERS, QUERY_BLOCKS, BASE_BLOCKS, TILE_QUERIES, TILE_ROWS = (2048, 65_536), 1 << 22, 16, 3, 256, 2048
#: Most components of vectors that are dealt into boxes; most boxes, rows and queries of one, rows of the sample that cuts them.
FLAT, BOXES, BOX_ROWS, BOX_QUERIES, BOX_SAMPLE = 6, 4096, 2048, 16_384, 65_536


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((a - y) ** 2).sum(1)) for y in b], 1) if len(b) else np.zeros((len(a), 0))


def choose_pivots(rows: np.ndarray, n: int) -> np.ndarray:
    """Rows far from each other: each next one is farthest from those before; equal rows are taken once.

    Of twice as many the n with most rows around them stay, so that outliers do not use up the pivots.
    """
    chosen, gap = [0], np.full(len(rows), np.inf)
    while True:
        gap = np.minimum(gap, np.sqrt(((rows - rows[chosen[-1]]) ** 2).sum(1)))
        k = int(np.argmax(gap))
        if len(chosen) >= 2 * n or gap[k] <= 0:
            break
        chosen.append(k)
    around = np.bincount(distances(rows, rows[chosen]).argmin(1), minlength=len(chosen))
    return rows[[chosen[i] for i in np.argsort(-around, kind="stable")[:n]]]


class Cells:
    """Counts of the cells and the bounds of their distances to every pivot."""

    def __init__(self, cells: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.cells, self.n, self.lo, self.hi = cells, n, lo, hi

    def bounds(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible distance of queries to the rows of each cell; ``d``: distances to the pivots."""
        least, most = np.zeros((len(d), len(self.cells))), np.full((len(d), len(self.cells)), np.inf)
        for j in range(d.shape[1]):
            x = d[:, j, None]
            np.maximum(least, np.maximum(x - self.hi[:, j], self.lo[:, j] - x), out=least)
            np.minimum(most, x + self.hi[:, j], out=most)
        return least * (1 - SLACK), most * (1 + SLACK)

    def openings(self, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, cell, bound, home) of the cells that may hold one of the k nearest, the query itself left out."""
        least, most = self.bounds(d)
        rows = np.arange(len(d))
        by = np.argsort(most, 1, kind="stable")
        enough = np.cumsum(self.n[by], 1) > k
        limit = np.where(enough.any(1), most[rows, by[rows, enough.argmax(1)]], np.inf)
        by = np.lexsort((most, least), axis=1) if len(d) else by
        before = np.cumsum(self.n[by], 1) - self.n[by]
        home = np.zeros(least.shape, bool)
        np.put_along_axis(home, by, before <= k, 1)
        q, c = np.nonzero((least <= limit[:, None]) | home)
        return q, self.cells[c], least[q, c], home[q, c]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def _with_cells(base: DataFrame, pivots: np.ndarray, width: float, rings: int) -> DataFrame:
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = distances(_matrix(pdf["v"]), pivots)
                p = d.argmin(1)
                ring = np.minimum(d[np.arange(len(d)), p] // width, rings - 1).astype(np.int64)
                yield pdf.assign(cell=p * rings + ring)

    return base.mapInPandas(place, "b long, v array<double>, cell long")


def _summary(placed: DataFrame, pivots: np.ndarray) -> Cells:
    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for pdf in batches:
            if len(pdf):
                d, cells = distances(_matrix(pdf["v"]), pivots), pdf["cell"].to_numpy()
                for c in np.unique(cells).tolist():
                    own = d[cells == c]
                    n, lo, hi = held.get(c, (0, np.inf, -np.inf))
                    held[c] = [n + len(own), np.minimum(lo, own.min(0)), np.maximum(hi, own.max(0))]
        yield pd.DataFrame([(c, j, n, lo[j], hi[j]) for c, (n, lo, hi) in held.items() for j in range(len(pivots))], columns=["cell", "pivot", "n", "lo", "hi"]).astype({"cell": "int64", "pivot": "int64", "n": "int64", "lo": "float64", "hi": "float64"})

    parts = placed.mapInPandas(summarise, "cell long, pivot long, n long, lo double, hi double")
    rows = parts.groupBy("cell").agg(
        F.sum(F.when(F.col("pivot") == 0, F.col("n"))).alias("n"),
        *[f(F.when(F.col("pivot") == j, F.col(c))).alias(f"{c}{j}") for j in range(len(pivots)) for c, f in (("lo", F.min), ("hi", F.max))],
    ).orderBy("cell").toPandas()  # fmt: skip  PIVOTS * RINGS rows at most
    column = lambda c: rows[[f"{c}{j}" for j in range(len(pivots))]].to_numpy(float)
    return Cells(rows["cell"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), column("lo"), column("hi"))


def _meet(visits: DataFrame, placed: DataFrame, sizes: DataFrame, k: int, block: int) -> DataFrame:
    """The k best rows of every visited cell for each query (q, v): large cells are cut into parts, their queries into chunks."""
    queries = visits.groupBy("cell").agg(F.count("*").alias("n_q"))
    dealt = sizes.join(queries, "cell").select("cell", F.ceil(F.col("n") / block).alias("parts"), F.ceil(F.col("n_q") / block).alias("chunks"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = visits.join(F.broadcast(dealt), "cell").select("cell", "q", "v", spread("parts").alias("part"), F.pmod(F.xxhash64("q"), F.col("chunks")).alias("chunk"))
    rows = placed.join(F.broadcast(dealt), "cell").select("cell", "b", "v", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), spread("chunks").alias("chunk"))

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("b")
            y, ids = _matrix(right["v"]), right["b"].to_numpy()
            for q, v in zip(left["q"], left["v"]):
                d = np.sqrt(((y - np.asarray(v, float)) ** 2).sum(1))
                d[ids == q] = np.inf
                out += [(q, ids[j], d[j]) for j in np.argsort(d, kind="stable")[:k] if np.isfinite(d[j])]
        return pd.DataFrame(out, columns=["q", "b", "distance"])

    keys = ["cell", "part", "chunk"]
    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(near, "q long, b long, distance double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("q").orderBy("distance", "b"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def openings(query: DataFrame, cells: Cells, pivots: np.ndarray, k: int) -> DataFrame:
    """(q, cell, bound, home) of all queries (q, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                q, cell, bound, home = cells.openings(distances(_matrix(part["v"]), pivots), k)
                yield pd.DataFrame({"q": part["q"].to_numpy()[q], "cell": cell, "bound": bound, "home": home})

    return query.mapInPandas(run, "q long, cell long, bound double, home boolean")


def unbounded(rows: np.ndarray, pivots: np.ndarray) -> float:
    """Share of the sample's rows that bounds by pivots do not set farther from one of its rows than the nearest other row."""
    d, left = distances(rows, pivots), 0
    for i in range(min(PROBES, len(rows))):
        near = np.sqrt(((rows - rows[i]) ** 2).sum(1))
        near[i] = np.inf
        left += int((np.abs(d - d[i]).max(1) <= near.min()).sum())
    return left / (len(rows) * min(PROBES, len(rows)))


def _vectors(table: pa.Table) -> np.ndarray:
    return np.vstack(table.column("v").to_numpy())


def _within(ids: np.ndarray, q: np.ndarray, b_ids: np.ndarray, b: np.ndarray, q2: np.ndarray, b2: np.ndarray, k: int, slip: float, most_kept: float) -> tuple[np.ndarray, np.ndarray] | None:
    """(query row, base row) of all that can be among the k nearest; None if more than ``most_kept`` are held.

    ``q`` has -2 times the queries and a one, ``b`` the rows and the least that |b|^2 can be, so that a product is the least that the squared distance less |q|^2
    can be without rounding. Rows go by the k-th of the upper ends.
    """
    limit, tiny = np.full(len(ids), np.inf), 1e-30 if q.dtype == np.float32 else 0.0
    i, j, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for lo in range(0, len(b), TILE_ROWS):
        s = q @ b[lo : lo + TILE_ROWS].T
        most = limit
        if not lo:  # the k nearest of the first rows: beyond them and the query's own rows nothing counts
            same = np.sort(b_ids[:TILE_ROWS])
            n = k + int((np.searchsorted(same, ids, "right") - np.searchsorted(same, ids)).max())
            if n <= s.shape[1]:
                most = np.partition(s, n - 1, 1)[:, n - 1] + 2 * slip * (q2 + b2[:TILE_ROWS].max()) + tiny
        near_i, near_j = np.divmod(np.flatnonzero(~(s > np.nextafter(most.astype(s.dtype), s.dtype.type(np.inf))[:, None])), s.shape[1])  # products beyond numbers (NaN) stay
        near = s[near_i, near_j].astype(float)
        near_j += lo
        other = ids[near_i] != b_ids[near_j]
        i, j, least = np.concatenate([i, near_i[other]]), np.concatenate([j, near_j[other]]), np.concatenate([least, near[other]])
        end = least + 2 * slip * (q2[i] + b2[j]) + tiny
        order = np.lexsort((end, i))
        i, j, least, end = i[order], j[order], least[order], end[order]
        kth = np.searchsorted(i, np.arange(len(ids))) + k - 1
        full = kth < np.searchsorted(i, np.arange(len(ids)), "right")
        limit[full] = end[kth[full]]
        keep = ~(least > limit[i])
        i, j, least = i[keep], j[keep], least[keep]
        if len(i) > most_kept:
            return None
    return i, j


def block_nearest(q_ids: np.ndarray, q: np.ndarray, b_ids: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, base row, distance) of the k nearest of a block's rows for each query, ties to the smaller id.

    Products are of single numbers around the block's mean, where these tell rows apart, else of double ones; distances are of double ones.
    """
    kinds = []
    for kind, centre in ((np.float32, b.mean(0)), (np.float64, np.zeros(b.shape[1]))):
        x, y = q - centre, b - centre
        x2, y2 = (x * x).sum(1), (y * y).sum(1)
        if kind == np.float64 or max(x2.max(), y2.max()) < 1e36:
            slip = 16 * (q.shape[1] + 8) * float(np.finfo(kind).eps)
            kinds.append((np.column_stack([-2 * x, np.ones(len(x))]).astype(kind), np.column_stack([y, y2 * (1 - slip)]).astype(kind), x2, y2, slip))
    found = []
    for at in range(0, len(q), TILE_QUERIES):
        own = slice(at, at + TILE_QUERIES)
        while True:
            left, right, x2, y2, slip = kinds[0]
            pairs = _within(q_ids[own], left[own], b_ids, right, x2[own], y2, k, slip, np.inf if len(kinds) == 1 else 16 * (k + 8) * TILE_QUERIES)
            if pairs is not None:
                break
            kinds.pop(0)
        i, j = pairs
        d = np.concatenate([np.zeros(0), *[np.sqrt(((b[j[x : x + 4096]] - q[own][i[x : x + 4096]]) ** 2).sum(1)) for x in range(0, len(i), 4096)]])
        order = np.lexsort((b_ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        first = (np.arange(len(i)) - np.searchsorted(i, i) < k) & np.isfinite(d)
        found.append((i[first] + at, j[first], d[first]))
    return tuple(np.concatenate(x) for x in zip(*found))


def all_pairs(q: DataFrame, b: DataFrame, dim: int, k: int) -> DataFrame:
    """The k nearest base rows (b, v) of every block for each query (q, v)."""
    low, high = BLOCK_ROWS
    blocks = lambda n, parts: max(1, math.ceil(n / min(max(-(-n // parts), low), high, max(1, BLOCK_NUMBERS // max(1, dim)))))
    # Of equal vectors only the k + 1 smallest ids can be among the k nearest.
    b = materialise(b.withColumn("same", F.dense_rank().over(W.partitionBy("v").orderBy("b"))).where(F.col("same") <= k + 1).drop("same"), "knn-base")
    n_q, n_b = blocks(q.count(), QUERY_BLOCKS), blocks(b.count(), BASE_BLOCKS)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c, F.monotonically_increasing_id()), F.lit(n)).cast("int")
    asked = q.withColumn("x", deal("q", n_q)).withColumn("y", spread(n_b)).repartition(2 * n_q * n_b, "x", "y")
    rows = b.withColumn("y", deal("b", n_b)).withColumn("x", spread(n_q)).repartition(2 * n_q * n_b, "x", "y")

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        i, j, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q_ids, b_ids = left.column("q").to_numpy(), right.column("b").to_numpy()
        if len(q_ids) and len(b_ids):
            i, j, d = block_nearest(q_ids, _vectors(left), b_ids, _vectors(right), k)
        return pa.table({"q": pa.array(q_ids[i], pa.int64()), "b": pa.array(b_ids[j], pa.int64()), "distance": pa.array(d, pa.float64())})

    return asked.groupBy("x", "y").cogroup(rows.groupBy("x", "y")).applyInArrow(near, "q long, b long, distance double")


class Boxes:
    """Halves of a sample by the widest component, down to ``n`` boxes."""

    def __init__(self, rows: np.ndarray, n: int):
        self.cuts: list[tuple[int, float, int, int]] = []
        self.count = 0
        self.root = self._cut(rows, n)

    def _cut(self, rows: np.ndarray, n: int) -> int:
        """Number of a cut, or of a box as -1 less it."""
        spans = rows.max(0) / 2 - rows.min(0) / 2 if len(rows) else np.zeros(1)
        axis = int(spans.argmax())
        if n > 1 and spans[axis] > 0:
            # The median, or the least value beyond the smallest one, so that both halves hold rows.
            at = max(float(np.median(rows[:, axis])), float(rows[rows[:, axis] > rows[:, axis].min(), axis].min()))
            low = rows[:, axis] < at
            if low.any() and not low.all():
                k = len(self.cuts)
                self.cuts.append((axis, at, 0, 0))
                self.cuts[k] = (axis, at, self._cut(rows[low], n // 2), self._cut(rows[~low], n - n // 2))
                return k
        self.count += 1
        return -self.count

    def of(self, rows: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(rows), np.int64), [(self.root, np.arange(len(rows)))]
        while left:
            node, own = left.pop()
            if node < 0:
                out[own] = -1 - node
            elif len(own):
                axis, at, low, high = self.cuts[node]
                below = rows[own, axis] < at
                left += [(low, own[below]), (high, own[~below])]
        return out


def _k_nearest(q_ids: np.ndarray, q: np.ndarray, b_ids: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, base row, distance) of the k nearest by exact distances, ties to the smaller id; for vectors of few components."""
    by = np.argsort(b_ids, kind="stable")
    columns, found, step = [np.ascontiguousarray(b[by, c]) for c in range(b.shape[1])], [], max(1, (1 << 17) // max(1, len(b)))
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        s = np.zeros((len(part), len(b)))
        for c, y in enumerate(columns):
            gap = y - part[:, c, None]
            gap *= gap
            s += gap
        s[q_ids[lo : lo + step, None] == b_ids[by]] = np.inf
        kth = np.partition(s, k - 1, 1)[:, k - 1 : k] if k < len(b) else np.full((len(part), 1), np.inf)
        i, j = np.divmod(np.flatnonzero(s <= kth * (1 + SLACK)), len(b))
        d = np.sqrt(s[i, j])
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        first = (np.arange(len(i)) - np.searchsorted(i, i) < k) & np.isfinite(d)
        found.append((i[first] + lo, by[j[first]], d[first]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _met(asked: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """(q, b, distance): the k nearest rows (b, v) of a box for each of its queries (q, v); a box with many queries has several parts."""
    parts = F.broadcast(materialise(asked.groupBy("box").agg(F.ceil(F.count("*") / BOX_QUERIES).cast("int").alias("parts")), "knn-parts"))  # a row a box
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = asked.join(parts, "box").select("box", F.pmod(F.xxhash64("q", "v"), F.col("parts")).cast("int").alias("part"), "q", "v").repartition(n, "box", "part")
    right = placed.join(parts, "box").select("box", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "b", "v").repartition(n, "box", "part")

    def near(x: pa.Table, y: pa.Table) -> pa.Table:
        i, j, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q_ids, b_ids = x.column("q").to_numpy(), y.column("b").to_numpy()
        if len(q_ids) and len(b_ids):
            i, j, d = _k_nearest(q_ids, _vectors(x), b_ids, _vectors(y), k)
        return pa.table({"q": pa.array(q_ids[i], pa.int64()), "b": pa.array(b_ids[j], pa.int64()), "distance": pa.array(d, pa.float64())})

    keys = ["box", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(near, "q long, b long, distance double")


def by_boxes(q: DataFrame, b: DataFrame, dim: int, k: int) -> DataFrame:
    """The k nearest base rows (b, v) for each query (q, v), of boxes that may hold one; ``q`` is a written table."""
    # Of equal vectors only the k + 1 smallest ids can be among the k nearest.
    b = materialise(b.withColumn("same", F.row_number().over(W.partitionBy("v").orderBy("b"))).where(F.col("same") <= k + 1).drop("same"), "knn-base")
    n = b.count()
    boxes = Boxes(_matrix(b.orderBy(F.xxhash64("b"), "b").limit(BOX_SAMPLE).toPandas()["v"]), min(BOXES, math.ceil(n / BOX_ROWS)))

    def place(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(box=boxes.of(_matrix(pdf["v"])))

    placed = materialise(b.mapInPandas(place, "b long, v array<double>, box long"), "knn-placed")
    discard(b)
    own = materialise(q.mapInPandas(place, "q long, v array<double>, box long"), "knn-own")
    corners = placed.groupBy("box").agg(F.count("*").alias("n"), *[f(F.col("v")[c]).alias(f"{x}{c}") for x, f in (("lo", F.min), ("hi", F.max)) for c in range(dim)]).orderBy("box").toPandas()  # BOXES rows at most
    ids, sizes = corners["box"].to_numpy(np.int64), corners["n"].to_numpy(np.int64)
    lo, hi = (corners[[f"{x}{c}" for c in range(dim)]].to_numpy(float) for x in ("lo", "hi"))

    first = materialise(_met(own, placed, k), "knn-first")
    # Null: the own box holds fewer than k.
    limits = first.groupBy("q").agg(F.when(F.count("*") >= k, F.max("distance")).alias("reach"))

    def openings(batches):
        for pdf in batches:
            v, home, reach = (_matrix(pdf["v"]) if len(pdf) else np.zeros((0, dim))), pdf["box"].to_numpy(), pdf["reach"].to_numpy(float)
            for at in range(0, len(pdf), 256):
                x, limit = v[at : at + 256], reach[at : at + 256].copy()
                least, most = np.zeros((len(x), len(ids))), np.zeros((len(x), len(ids)))
                short = np.isnan(limit)
                for c in range(dim):
                    y = x[:, c, None]
                    least += np.maximum(np.maximum(lo[:, c] - y, y - hi[:, c]), 0.0) ** 2
                    if short.any():
                        most += np.maximum(np.abs(y - lo[:, c]), np.abs(hi[:, c] - y)) ** 2
                if short.any():  # within the farthest corners of the nearest boxes that hold enough
                    by = np.argsort(most[short], 1, kind="stable")
                    enough = np.cumsum(sizes[by], 1) > k
                    far = np.sqrt(np.take_along_axis(most[short], by, 1))
                    limit[short] = np.where(enough.any(1), far[np.arange(len(by)), enough.argmax(1)], np.inf)
                i, j = np.nonzero(np.sqrt(least) * (1 - SLACK) <= limit[:, None] * (1 + SLACK))
                other = ids[j] != home[at : at + 256][i]
                i, j = i[other] + at, j[other]
                yield pd.DataFrame({"q": pdf["q"].to_numpy()[i], "v": pdf["v"].to_numpy()[i], "box": ids[j]})

    asked = own.join(limits, "q", "left").select("q", "v", "box", "reach")
    rest = materialise(asked.mapInPandas(openings, "q long, v array<double>, box long"), "knn-rest")
    found = materialise(first.unionByName(_met(rest, placed, k)), "knn-found")
    for table in (placed, own, first, rest):
        discard(table)
    return found


def knn(query: DataFrame, base: DataFrame, query_id: str, base_id: str, vector: str, k: int = 5, block: int = 4096, opened: list | None = None) -> DataFrame:
    """The k nearest rows of ``base`` (Euclidean over array<double>) for every query: query_id, rank, neighbour_id, distance.

    Ties go to the smaller id; a row is not its own neighbour. Vectors that are null or hold null or non-finite components take no part.
    ``opened``: gets the tables of visited cells (for tests).
    """
    spark = base.sparkSession
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col(vector).isNotNull()
    q = materialise(query.where(whole).select(F.col(query_id).alias("q"), F.col(vector).alias("v")), "knn-queries")
    b = base.where(whole).select(F.col(base_id).alias("b"), F.col(vector).alias("v"))
    sample = b.orderBy(F.xxhash64("b"), "b").limit(SAMPLE).toPandas()
    none = spark.createDataFrame([], "query_id long, rank int, neighbour_id long, distance double")
    if not len(sample):
        return none
    rows = _matrix(sample["v"])
    if opened is None and 0 < rows.shape[1] <= FLAT and not b.where(F.size("v") != rows.shape[1]).limit(1).count():
        out = materialise(_best(by_boxes(q, b, rows.shape[1], k), k).select(F.col("q").alias("query_id"), "rank", F.col("b").alias("neighbour_id"), "distance"), "knn")
        discard(q)
        return out
    n = b.count()
    pivots = choose_pivots(rows, min(PIVOTS, max(1, math.ceil((n / CELL_ROWS) ** 0.75))))
    if opened is None and unbounded(rows, pivots) > OPENED:
        out = materialise(_best(all_pairs(q, b, rows.shape[1], k), k).select(F.col("q").alias("query_id"), "rank", F.col("b").alias("neighbour_id"), "distance"), "knn")
        discard(q)
        return out
    rings = min(RINGS, max(1, math.ceil(n / CELL_ROWS / len(pivots))))
    width = max(float(distances(rows, pivots).min(1).max()) / rings, 1e-300)
    placed = materialise(_with_cells(b, pivots, width, rings), "knn-cells")
    cells = _summary(placed, pivots)
    sizes = spark.createDataFrame(pd.DataFrame({"cell": cells.cells, "n": cells.n}))
    visits = materialise(openings(q, cells, pivots, k), "knn-visits")

    first = materialise(_best(_meet(visits.where("home").join(q, "q"), placed, sizes, k, block), k), "knn-first")
    limit = first.groupBy("q").agg(F.when(F.count("*") == k, F.max("distance") * (1 + SLACK)).alias("limit"))
    rest = materialise(visits.where("NOT home").join(limit, "q", "left").where("limit IS NULL OR bound <= limit").select("q", "cell"), "knn-rest")
    if opened is not None:
        opened += [visits.where("home").select("q", "cell").join(sizes, "cell"), rest.join(sizes, "cell")]
    second = _meet(rest.join(q, "q"), placed, sizes, k, block)
    out = materialise(_best(first.drop("rank").unionByName(second), k).select(F.col("q").alias("query_id"), "rank", F.col("b").alias("neighbour_id"), "distance"), "knn")
    for table in (q, placed, visits, first, rest) if opened is None else ():
        discard(table)
    return out


def neighbour_mean(found: DataFrame, base: DataFrame, base_id: str, value: str) -> DataFrame:
    """(query_id, n, mean) of ``value`` over the neighbours that have it."""
    known = base.select(F.col(base_id).alias("neighbour_id"), F.col(value).alias("x"))
    return found.join(known, "neighbour_id").groupBy("query_id").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
