"""Operator 8, n-gram Jaccard join by a count-vector R-tree.

A document's shingles (word n-grams, as 64-bit hashes) are dealt into groups, more for larger sets; the counts per group
are its point. The overlap of two documents is at most the sum over groups of the smaller count,
and the overlap between documents of two tree nodes is at most that sum over their upper corners; the
distance of two points is at least the gap between the corners of their nodes.

One tree over all points would not prune: the points of unrelated documents of one length lie closer
than the similarity bound allows to tell. The root is therefore split losslessly, by the content of
fine groups (``fine_keys``): any two linked documents have one key in common. What happens below:

1. Documents that share a key are compared with the first document of that key (points, then whole
   sets). That joins up groups of near copies by work in proportion to their keys.
2. Keys whose documents are not all joined up yet connect them to *families*, the subtrees of the root.
   Within a family the points are sorted and tiled (by total, then group counts) into leaf pages, pages
   into inner nodes, each with its lower and upper corners. Nodes are paired by their bounds, then the pages of surviving
   nodes, then points; only points travel to that. Pages and points of documents that are joined up already are
   not paired. Surviving pairs of documents are verified on whole shingle sets: at first, for each document, its likeliest ones of
   every page that its page meets, which joins up large groups of near copies; then all pairs of what is still apart.

Exact copies are merged before any of this. A set is named by 64 bits of its digest, as a shingle is by 64 bits of its words; should two sets
meet in them, both are compared and no link is lost.

Defined results: words are maximal runs without ASCII white space, A-Z lower-cased. A null or empty
text has no shingle and is linked with nothing. Rows that share a doc_id (not null) share a component.
Rows with a null doc_id take part and count for links, but a component's id is the smallest non-null
doc_id in it (null if there is none). Texts of any length are taken whole; a page holds one very long text at least. Repeated rows
count once for links and each has its row in the result. An empty table gives an empty result. Extra columns are
ignored by the join and passed through by ``keep_one``, whatever their names (but those that start with two underscores).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctra.llm.common import batches_of, give_back, materialise
from auctra.operators.components import connected_components
from auctra.tables import discard

#: Groups of a corner, and of the point of a small set; larger sets have a power of two with 4 to 8 shingles in a group.
GROUPS, FILL = 64, 8
#: A leaf page holds up to so many documents and, but for one long document, shingles; a node so many pages.
PAGE_DOCS, PAGE_SHINGLES, NODE_PAGES = 512, 1 << 19, 16
#: Slices in which keys are brought together, one after the other.
KEY_SLICES = 4
#: Documents of one component from which they get pages of their own.
OWN_PAGES = 256

#: Odd 64-bit multipliers for mixing (the finaliser of splitmix64 and the golden ratio).
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)

#: First sizes of the size classes: half powers of two.
BOUNDS = np.unique(np.ceil(2 ** (np.arange(0, 81) / 2)).astype(np.int64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _step(k: int) -> np.uint64:
    return np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    size = min(n, len(words))
    s = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        s = _mix((s + h[i : i + len(s)]) * _GOLD + _step(i + 1))
    if size < n:
        s = _mix(s + _step(1000 + size))
    return np.unique(s)


def _differing(larger: int, pct: int) -> int:
    """Most shingles that two linked sets can differ in, if the larger has ``larger``."""
    return (100 - pct) * 2 * larger // (100 + pct)


def _needed(total, pct: int):
    """Least overlap of two linked sets with ``total`` shingles together."""
    return -(-pct * total // (100 + pct))


def fine_keys(s: np.ndarray, pct: int) -> np.ndarray:
    """Keys by content of fine groups, for every size class in which the set can be the smaller or larger of a pair.

    Linked sets differ in at most d shingles, hence in at most d fine groups. All groups of all sets
    have one order (more shingles first, then by hash), and a set keeps its first d + 1: in that order
    the first group that two linked sets have in common comes after at most d others in either set, so both keep it. Groups of
    few shingles, which common passages share by chance, are mostly beyond that. Two linked sets
    without a common group have d groups at most each, and such sets get one more key.
    """
    out, size = [], len(s)
    c = int(np.searchsorted(BOUNDS, size, side="right")) - 1
    while size and int(BOUNDS[c]) * pct <= 100 * size:
        d = _differing(int(BOUNDS[c + 1]) - 1, pct)
        if d:
            k = d + d // 4 + 8
            seed = _mix(np.array([c + 1], np.uint64) * _GOLD)[0]
            g = (_mix(s ^ seed) % np.uint64(k)).astype(np.int64)
            order = np.argsort(g, kind="stable")
            starts = np.flatnonzero(np.diff(g[order], prepend=-1))
            content = np.add.reduceat(_mix(s + _GOLD)[order], starts)
            keys = _mix(content + g[order][starts].astype(np.uint64) * _M1 + seed)
            counts = np.diff(starts, append=size)
            out.append(keys[np.lexsort((keys, -counts))[: d + 1]])
            if len(starts) <= d:
                out.append(_mix(np.array([seed]) + _M2))
        c += 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def point_of(s: np.ndarray) -> np.ndarray:
    """Counts per group; a group of a smaller point is the sum of neighbouring groups of a larger one."""
    bits = max(GROUPS.bit_length() - 1, (len(s) // FILL).bit_length())
    return np.bincount((_mix(s ^ _GOLD) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Points (rows) with fewer groups."""
    return points.reshape(len(points), groups, -1).sum(2, dtype=np.int32)


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima of all rows of ``a`` with all rows of ``b``."""
    return np.array([np.minimum(x, b).sum(1) for x in a]).reshape(len(a), len(b))


_FEATURES = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("point", T.BinaryType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
    ]
)


def _features_udf(n: int, pct: int):
    @F.pandas_udf(_FEATURES)
    def features(texts: pd.Series) -> pd.DataFrame:
        give_back()
        rows = []
        for x in texts:
            s = shingle_set(x, n)
            rows.append((len(s), hashlib.md5(s.tobytes()).digest(), point_of(s).tobytes(), fine_keys(s, pct).view(np.int64)))
        return pd.DataFrame(rows, columns=_FEATURES.names)

    return features


def _similar(s: np.ndarray, t: np.ndarray, pct: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= pct * (len(s) + len(t) - both)


def _similar_udf(n: int, pct: int):
    @F.pandas_udf(T.BooleanType())
    def similar(texts: pd.Series, hubs: pd.Series) -> pd.Series:
        give_back()
        out, last, t = [], None, None
        for x, hub in zip(texts, hubs):
            if hub is not last and hub != last:
                last, t = hub, shingle_set(hub, n)
            out.append(_similar(shingle_set(x, n), t, pct))
        return pd.Series(out, dtype=bool)

    return similar


@F.pandas_udf(T.LongType())
def points_overlap(points: pd.Series, others: pd.Series) -> pd.Series:
    """Sum of the coordinate minima of two points, at the number of groups of the smaller."""
    out = []
    for x, y in zip(points, others):
        x, y = np.frombuffer(x, np.uint16)[None, :], np.frombuffer(y, np.uint16)[None, :]
        n = min(x.shape[1], y.shape[1])
        out.append(int(overlaps(folded(x, n), folded(y, n))[0, 0]))
    return pd.Series(out, dtype="int64")


def _by_groups(members) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Number of groups to ids, components and points of a page's members."""
    found: dict[int, list] = {}
    for m in members:
        found.setdefault(len(m["point"]) // 2, []).append(m)
    array = lambda ms, c: np.array([m[c] for m in ms], np.int64)
    return {g: (array(ms, "nid"), array(ms, "component"), np.array([np.frombuffer(m["point"], np.uint16) for m in ms]).reshape(len(ms), g)) for g, ms in found.items()}


def page_pairs(a, b, pct: int, best: bool = False) -> list[tuple[int, int]]:
    """Pairs of two pages' members (or of one page's, if b is None), of different components, whose points allow a link.

    ``best``: for each member only its likeliest pairs, one for each number of groups.
    """
    pages_a = _by_groups(a)
    pages_b = pages_a if b is None else _by_groups(b)
    found = []
    for ga, (ids_a, comps_a, points_a) in pages_a.items():
        for gb, (ids_b, comps_b, points_b) in pages_b.items():
            if max(ga, gb) > 2 * min(ga, gb) and pct >= 50 or b is None and ga > gb:
                continue  # linked sets are less than one power of two apart
            n = min(ga, gb)
            pa, pb = folded(points_a, n), folded(points_b, n)
            over, total = overlaps(pa, pb), pa.sum(1)[:, None] + pb.sum(1)[None, :]
            possible = over >= _needed(total, pct)
            possible &= comps_a[:, None] != comps_b[None, :]
            if b is None and ga == gb:
                possible &= np.arange(len(ids_a))[:, None] < np.arange(len(ids_b))[None, :]
            if best:
                share, likeliest = np.where(possible, over / total, -1), np.zeros(possible.shape, bool)
                likeliest[np.arange(len(ids_a)), share.argmax(1)] = True
                likeliest[share.argmax(0), np.arange(len(ids_b))] = True
                possible &= likeliest
            found += [(int(ids_a[i]), int(ids_b[j])) for i, j in zip(*np.nonzero(possible))]
    return found


def _pairs(pct: int, best: bool):
    """Over rows of members and, for a pair of pages, others."""

    def run(batches):
        for pdf in batches:
            others = pdf["others"] if "others" in pdf else [None] * len(pdf)
            pairs = [x for m, o in zip(pdf["members"], others) for x in page_pairs(m, o, pct, best)]
            yield pd.DataFrame(pairs, columns=["u", "v"], dtype="int64")

    return run


_PAGES = (
    "family long, node long, page long, docs long, least long, most long, first long, last long, lower array<int>, upper array<int>, "
    "members array<struct<nid: long, component: long, point: binary>>"
)
_PAGE_COLUMNS = ["family", "node", "page", "docs", "least", "most", "first", "last", "lower", "upper", "members"]


def _tile(page_docs: int, node_pages: int):
    """Cuts rows in order into pages and nodes (each named by its first member), which never reach over a change of (family, bin)."""

    def close(rows, node):
        points = np.concatenate([folded(np.frombuffer(r.point, np.uint16)[None, :], GROUPS) for r in rows])
        sizes, components = [r.size for r in rows], [r.component for r in rows]
        members = [{"nid": r.nid, "component": r.component, "point": r.point} for r in rows]
        return (rows[0].family, node, rows[0].nid, len(rows), min(sizes), max(sizes), min(components), max(components), points.min(0), points.max(0), members)

    def run(batches):
        rows, place, shingles, node, pages = [], None, 0, None, 0
        for pdf in batches:
            done = []
            for r in pdf.itertuples(index=False):
                here = (r.family, r.bin)
                if rows and (here != place or len(rows) >= page_docs or shingles + r.size > PAGE_SHINGLES):
                    done.append(close(rows, node))
                    rows, shingles, pages = [], 0, pages + 1
                if here != place or (not rows and pages >= node_pages):
                    place, node, pages = here, r.nid, 0
                rows.append(r)
                shingles += r.size
            yield pd.DataFrame(done, columns=_PAGE_COLUMNS)
        if rows:
            yield pd.DataFrame([close(rows, node)], columns=_PAGE_COLUMNS)

    return run


def _sum_of(a: Column, b: Column, of) -> Column:
    return F.aggregate(F.zip_with(a, b, of), F.lit(0), lambda x, y: x + y)


def _may_link(pct: int) -> Column:
    """Whether two nodes, pages or points (columns of the second end in _b) may hold a link between two components."""
    c = F.col
    over = F.least(_sum_of(c("upper"), c("upper_b"), lambda x, y: F.least(x, y)), c("most"), c("most_b"))
    gap = _sum_of(c("lower"), c("upper_b"), lambda x, y: F.greatest(x - y, F.lit(0))) + _sum_of(c("lower_b"), c("upper"), lambda x, y: F.greatest(x - y, F.lit(0)))
    apart = (c("first") != c("last")) | (c("first_b") != c("last_b")) | (c("first") != c("first_b"))
    return apart & ((100 + pct) * over >= pct * (c("least") + c("least_b"))) & ((100 + pct) * gap <= (100 - pct) * (c("most") + c("most_b")))


_HEAD = ["least", "most", "first", "last", "lower", "upper"]


def tree_pairs(pages: DataFrame, pct: int) -> DataFrame:
    """Pairs of leaf pages (page, page_b) that the tree opens: pairs of nodes first, then of their pages."""
    heads = materialise(pages.drop("members"), "rtree-heads")
    corners = [F.array(*[f(F.col(x)[i]) for i in range(GROUPS)]).alias(x) for x, f in (("lower", F.min), ("upper", F.max))]
    nodes = heads.groupBy("family", "node").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min("first").alias("first"), F.max("last").alias("last"), *corners)
    nodes = materialise(nodes, "rtree-inner")
    second = lambda df, *more: df.select("family", *[F.col(x).alias(f"{x}_b") for x in [*more, *_HEAD]])
    opened = nodes.join(second(nodes, "node"), "family").where((F.col("node") <= F.col("node_b")) & _may_link(pct))
    opened = materialise(opened.select("family", "node", "node_b"), "rtree-opened")
    pairs = opened.join(heads.select("family", "node", "page", *_HEAD), ["family", "node"]).join(second(heads, "node", "page"), ["family", "node_b"])
    pairs = pairs.where(((F.col("node") < F.col("node_b")) | (F.col("page") < F.col("page_b"))) & _may_link(pct))
    return materialise(pairs.select("page", "page_b"), "rtree-pairs")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _tile_of(points: pd.Series) -> pd.Series:
    """The first eighth of a corner's counts, in halves of their mean."""
    out = []
    for x in points:
        counts = folded(np.frombuffer(x, np.uint16)[None, :], GROUPS)[0]
        out.append((counts[: GROUPS // 8] * 2 * GROUPS // max(1, counts.sum())).astype(np.int32))
    return pd.Series(out, dtype=object)


def leaf_pages(members: DataFrame, page_docs: int = PAGE_DOCS, node_pages: int = NODE_PAGES) -> DataFrame:
    """Leaf pages of members (family, bin, nid, component, size, point): a distributed sort-tile by total and group counts."""
    members = materialise(members.withColumns({"band": F.floor(8 * F.log2("size")).cast("int"), "tile": _tile_of("point")}), "rtree-tiles")
    order = ["family", "bin", "band", "tile", "nid"]
    members = members.repartitionByRange(*order).sortWithinPartitions(*order)
    with batches_of(members.sparkSession, "2m"):
        return materialise(members.drop("band", "tile").mapInPandas(_tile(page_docs, node_pages), _PAGES), "rtree-pages")


def page_joins(pages: DataFrame, pct: int, best: bool = False) -> DataFrame:
    """Pairs (u, v) of documents within and between leaf pages that may be linked; ``best``: for each document only its likeliest ones of every page that its page meets."""
    within = pages.where("docs > 1 AND first != last").select("members")
    content = pages.select("page", "members")
    joined = tree_pairs(pages, pct).join(content, "page").select(F.col("page_b").alias("page"), F.col("members").alias("others")).join(content, "page")
    with batches_of(pages.sparkSession, "2m"):
        inner = materialise(within.mapInPandas(_pairs(pct, best), "u long, v long"), "rtree-within")
        return inner.unionByName(materialise(joined.select("members", "others").mapInPandas(_pairs(pct, best), "u long, v long"), "rtree-across"))


def _verified(pairs: DataFrame, full: DataFrame, n: int, pct: int) -> DataFrame:
    """The pairs (u, v) that are linked, by whole texts."""
    texts = lambda i, t: full.select(F.col("nid").alias(i), F.col("text").alias(t))
    near = pairs.join(texts("u", "u_text"), "u").join(texts("v", "v_text"), "v")
    with batches_of(full.sparkSession, "2m"):
        return materialise(near.where(_similar_udf(n, pct)(F.col("u_text"), F.col("v_text"))).select("u", "v"), "rtree-links")


def _keys_of_row() -> list[Column]:
    text_key = F.xxhash64("text")
    return [F.coalesce(F.col("doc_id").cast("long"), text_key).alias("doc_key"), text_key.alias("text_key")]


def _component(nodes: DataFrame, components: DataFrame, of: str, name: str) -> DataFrame:
    """Adds the component of column ``of`` (itself, if nothing is joined to it) as column ``name``."""
    return nodes.join(components.select(F.col("node").alias(of), F.col("component").alias("__c")), of, "left").withColumn(name, F.coalesce("__c", of)).drop("__c")


def near_components(docs: DataFrame, n: int = 5, pct: int = 80, page_docs: int = PAGE_DOCS, node_pages: int = NODE_PAGES) -> DataFrame:
    """One row per row of ``docs``: doc_id, doc_key, text_key, n_shingles, component (null without shingles), component_id."""
    texts = docs.select("doc_id", *_keys_of_row(), "text")
    with batches_of(docs.sparkSession, "2m"):
        featured = materialise(texts.select("doc_id", "doc_key", "text_key", _features_udf(n, pct)(F.col("text")).alias("f")).select("doc_id", "doc_key", "text_key", "f.*"), "rtree-keys")
    nid = F.when(F.col("n_shingles") > 0, F.xxhash64("digest")).alias("nid")
    rows = materialise(featured.select("doc_id", "doc_key", "text_key", "n_shingles", "digest", "point", nid), "rtree-rows")

    # Keys with two sets or more: every set but the smallest meets that one, the hub. A slice of the keys at a time, as they are many bytes to shuffle.
    shared = None
    for at in range(KEY_SLICES):
        keys = featured.select(nid, F.explode(F.filter("keys", lambda k: F.pmod(k, F.lit(KEY_SLICES)) == at)).alias("key"))  # noqa: B023
        hubs = materialise(keys.groupBy("key").agg(F.min("nid").alias("hub"), F.count("*").alias("c")).where("c > 1").select("key", "hub"), "rtree-hubs")
        part = materialise(keys.join(hubs, "key").where("nid != hub").select("key", "nid", "hub"), "rtree-shared")
        discard(hubs)
        shared = part if shared is None else shared.unionByName(part)
    discard(featured)
    stars = materialise(shared.select("nid", "hub").distinct(), "rtree-stars")

    # Exact copies: one text for each distinct set that shares a key.
    nodes = rows.where("n_shingles > 0").groupBy("digest").agg(
        F.min("nid").alias("nid"), F.min("doc_id").alias("least"), F.min(F.struct("doc_key", "text_key")).alias("r"), F.first("n_shingles").alias("size"), F.first("point").alias("point")
    )
    nodes = materialise(nodes.select("digest", "nid", "least", "r.*", "size", "point"), "rtree-nodes")
    met = materialise(stars.select("nid").union(stars.select("hub")).distinct(), "rtree-met")
    wanted = materialise(nodes.join(met, "nid").select("doc_key", "text_key", "digest", "nid", "size", "point"), "rtree-wanted")
    full = materialise(texts.join(wanted, ["doc_key", "text_key"]).dropDuplicates(["doc_key", "text_key", "digest"]).select("nid", "size", "point", "text"), "rtree-texts")

    # Every set against the hubs of its keys.
    points = lambda i, p, size: full.select(F.col("nid").alias(i), F.col("point").alias(p), F.col("size").alias(size))
    near = stars.select(F.col("nid").alias("u"), F.col("hub").alias("v")).join(points("u", "u_point", "u_size"), "u").join(points("v", "v_point", "v_size"), "v")
    near = near.where(100 * F.least("u_size", "v_size") >= pct * F.greatest("u_size", "v_size"))
    with batches_of(docs.sparkSession, "2m"):
        near = materialise(near.where((100 + pct) * points_overlap("u_point", "v_point") >= pct * (F.col("u_size") + F.col("v_size"))).select("u", "v"), "rtree-near")
    links = _verified(near, full, n, pct)
    twice = rows.where("doc_id IS NOT NULL AND nid IS NOT NULL").groupBy("doc_id").agg(F.min("nid").alias("v"), F.max("nid").alias("last")).where("v != last").select("doc_id", "v")
    links = links.unionByName(rows.join(materialise(twice, "rtree-twice"), "doc_id").select(F.col("nid").alias("u"), "v"))
    joined = materialise(connected_components(links), "rtree-joined")

    # Keys whose sets are not all joined up: families of components, and the tree below each.
    crossed = _component(_component(stars, joined, "nid", "u"), joined, "hub", "v").where("u != v")
    crossed = materialise(crossed, "rtree-crossed")
    families = materialise(connected_components(crossed.select("u", "v")), "rtree-families")
    open_keys = materialise(shared.join(crossed.select("nid", "hub"), ["nid", "hub"], "left_semi").select("key").distinct(), "rtree-open")
    met = shared.join(open_keys, "key", "left_semi").select("nid", "hub").distinct()
    members = _component(met.select("nid").union(met.select("hub")).distinct(), joined, "nid", "component")
    members = materialise(members.join(families.select(F.col("node").alias("component"), F.col("component").alias("family")), "component"), "rtree-members")
    # First each set meets its likeliest ones, then those whose components are still apart meet all.
    found = None
    for best in (True, False):
        large = materialise(members.groupBy("component").agg(F.count("*").alias("c")).where(F.col("c") >= OWN_PAGES).select("component", F.col("component").alias("bin")), "rtree-large")
        placed = members.join(large, "component", "left").select("family", F.coalesce("bin", F.lit(-1)).alias("bin"), "nid", "component").join(full.drop("text"), "nid")
        linked = _verified(page_joins(leaf_pages(placed, page_docs, node_pages), pct, best), full, n, pct)
        linked = _component(_component(linked, joined, "u", "a"), joined, "v", "b").select(F.col("a").alias("u"), F.col("b").alias("v"))
        linked = materialise(connected_components(linked), "rtree-found")
        if best:
            members = materialise(_component(members, linked, "component", "component"), "rtree-merged")
            found = linked
        else:
            found = materialise(connected_components(found.unionByName(linked).select(F.col("node").alias("u"), F.col("component").alias("v"))), "rtree-found")

    nodes = materialise(_component(_component(nodes.select("nid", "least"), joined, "nid", "c"), found, "c", "component"), "rtree-ends")
    ids = materialise(nodes.groupBy("component").agg(F.min("least").alias("component_id")), "rtree-least")
    ids = materialise(nodes.select("nid", "component").distinct().join(ids, "component"), "rtree-ids")
    out = rows.select("doc_id", "doc_key", "text_key", "n_shingles", "nid").join(ids, "nid", "left")
    return out.select("doc_id", "doc_key", "text_key", "n_shingles", "component", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, pct: int = 80) -> DataFrame:
    """The documents without near duplicates: of each component one row stays.

    That is the row with the smallest doc_id, or in a component without any the one whose text has the smallest hash; its
    repetitions go too. Documents without shingles stay.
    """
    rows = materialise(near_components(docs, n, pct).where("component IS NOT NULL"), "rtree-rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_key", "text_key"))
    kept = materialise(rows.groupBy("component").agg(best.alias("r"), F.count("*").alias("c")).where("c > 1").select("component", F.col("r.doc_key").alias("kept_key"), F.col("r.text_key").alias("kept_text")), "rtree-kept")
    groups = materialise(rows.join(kept, "component").select("doc_key", "text_key", "kept_key", "kept_text"), "rtree-groups")
    same = (F.col("doc_key") == F.col("kept_key")) & (F.col("text_key") == F.col("kept_text"))
    drop = materialise(groups.where(~same).select(F.col("doc_key").alias("__doc"), F.col("text_key").alias("__text")).distinct(), "rtree-drop")
    twice = groups.where(same).groupBy(F.col("doc_key").alias("__doc"), F.col("text_key").alias("__text")).count().where("count > 1").select("__doc", "__text")
    twice = materialise(twice, "rtree-again")
    doc, text = _keys_of_row()
    keyed = docs.withColumns({"__doc": doc, "__text": text}).join(drop, ["__doc", "__text"], "left_anti")
    again = keyed.join(twice, ["__doc", "__text"], "left_semi").dropDuplicates(["__doc", "__text"])
    return keyed.join(twice, ["__doc", "__text"], "left_anti").unionByName(again).select(docs.columns)


#: DuckDB form of the query with four-word shingles and 85 percent (unique doc_ids).
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM o JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.v FROM r JOIN l ON l.u = r.b)
SELECT r.a AS doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
