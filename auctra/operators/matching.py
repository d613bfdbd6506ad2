"""Matching of new directory organisations to sold lots, and the merges that follow.

Tables: ``lots`` (lot_id, sale_date, lat, lon, address_canon, ..), ``snapshots`` (snapshot_label, snapshot_date,
org_id, org_name, address_norm, address_canon, rubric, subrubric, lat, lon), ``matches`` (lot_id, company, usage, confidence,
after_days, time_window, ..). An unmatched lot has a null confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from auctra.functions import columns as C
from auctra.functions import vocab as V
from auctra.functions.geo import cells_around, haversine_m, own_cell
from auctra.operators.similarity import candidate_pairs, containing, reaching
from auctra.operators.spatial import radius_join
from auctra.operators.stats import ordered_preview, previous_snapshot, top_per_group
from auctra.tables import materialise

GOOD = ["high", "medium"]


def new_orgs(snapshots: DataFrame, key: str = "address_name", canonical_key: bool = False) -> DataFrame:
    """Organisations of each snapshot that the snapshot before did not have; the first snapshot has none."""
    keys = [F.col("org_id")] if key == "id" else [F.col("address_canon" if canonical_key else "address_norm"), F.lower("org_name")]
    before = snapshots.select(F.col("snapshot_label").alias("b_label"), *[k.alias(f"b_{i}") for i, k in enumerate(keys)]).distinct()
    labels = previous_snapshot(snapshots).where("previous_label IS NOT NULL")
    same = F.col("previous_label") == F.col("b_label")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"b_{i}"))
    return snapshots.join(F.broadcast(labels), "snapshot_label").join(before, same, "left_anti")  # one row a snapshot


def eligible_lots(lots: DataFrame, matches: DataFrame | None = None, skip_windows: list[str] = ("180-365d",)) -> DataFrame:
    """Lots with date, address and coordinates whose match is not in a window that is as good."""
    out = lots.where("sale_date IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").where(C.blank_to_null("address_canon").isNotNull())
    if matches is not None:
        out = out.join(matches.where(F.col("time_window").isin(list(skip_windows))).select("lot_id"), "lot_id", "left_anti")
    return out


_NAME = ["org_name", "rubric", "subrubric"]


def once_per_name(orgs: DataFrame, shown: str | Column = "org_name", **columns: Column) -> DataFrame:
    """Plausible rows of ``orgs`` with ``usage`` and further columns made of org_name, rubric and subrubric; the rules for names run once for each name."""
    orgs = materialise(orgs, "orgs")
    names = orgs.select(*_NAME).distinct().withColumn("usage", C.usage_text("rubric", "subrubric"))
    names = materialise(names.where(~C.is_implausible(shown, "usage")).select(F.struct(*_NAME).alias("name_key"), "usage", *[c.alias(n) for n, c in columns.items()]), "names")
    return orgs.withColumn("name_key", F.struct(*_NAME)).join(names, "name_key").drop("name_key")


def match_candidates(lots: DataFrame, orgs: DataFrame, min_days: int = 0, max_days: int = 365, max_m: float = 250, address: str = "address_canon", keep: list[str] = (), org_keep: list[str] = ()) -> DataFrame:
    """Plausible new organisations at a lot's address in a window of days after the sale; ``keep``, ``org_keep``: further columns of the lots and the organisations."""
    return pair_candidates(lots, plausible(orgs, address, org_keep), min_days, max_days, max_m, address, keep)


def pair_candidates(lots: DataFrame, o: DataFrame, min_days: int = 0, max_days: int = 365, max_m: float = 250, address: str = "address_canon", keep: list[str] = ()) -> DataFrame:
    """``match_candidates`` of ``plausible`` organisations."""
    # Joined by address and month of the snapshot, so that only pairs of the window meet.
    month = lambda d: F.trunc(d, "month")
    months = F.sequence(month(F.date_add("sale_date", min_days)), month(F.date_add("sale_date", max_days)), F.expr("INTERVAL 1 MONTH"))
    near = lots.select("lot_id", "sale_date", "lat", "lon", F.col(address), *keep, F.explode(months).alias("month"))
    pairs = near.join(o.withColumn("month", month(F.col("snapshot_date"))), [address, "month"]).drop("month")
    pairs = pairs.withColumn("after_days", C.after_days("sale_date", "snapshot_date")).where(F.col("after_days").between(min_days, max_days))
    pairs = pairs.withColumn("distance_m", haversine_m("lat", "lon", "o_lat", "o_lon")).where(F.col("distance_m") <= max_m)
    return pairs.withColumn("band", C.distance_band("distance_m"))


def plausible(orgs: DataFrame, address: str = "address_canon", keep: list[str] = ()) -> DataFrame:
    """Organisations that can be candidates, as these have them."""
    o = orgs.select(F.col(address), F.col("address_norm" if "address_norm" in orgs.columns else address).alias("o_address"), "snapshot_label", "snapshot_date", "org_id", *_NAME, F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), *keep)
    return once_per_name(o, company=C.company_name("org_name")).drop("rubric", "subrubric")


def best_matches(candidates: DataFrame, previews: int = 5) -> DataFrame:
    """One row per (lot, snapshot): count, best candidate, confidence, previews in order of distance."""
    ranked = candidates.withColumn("r", F.row_number().over(W.partitionBy("lot_id", "snapshot_label").orderBy("distance_m", "company", "org_id")))
    first = lambda c: F.max(F.when(F.col("r") == 1, F.col(c)))
    out = ranked.groupBy("lot_id", "snapshot_label").agg(
        F.count("*").alias("n"), first("band").alias("band"), first("company").alias("company"), first("usage").alias("usage"), first("after_days").alias("after_days"), first("distance_m").alias("distance_m"),
        *[first(c).alias(c) for c in ("org_id", "org_name", "o_address") if c in candidates.columns],
    )
    # Previews over all candidates: each value's smallest rank first, then the first few values.
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("company", "usage")])).alias("x")
    values = ranked.select(F.col("lot_id").alias("p_lot"), F.col("snapshot_label").alias("p_label"), "r", values).groupBy("p_lot", "p_label", "x.kind", "x.value").agg(F.min("r").alias("r"))
    values = top_per_group(values, ["p_lot", "p_label", "kind"], ["r"], previews)
    joined = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("r", "value")))), lambda x: x["value"]), " | ")
    values = values.groupBy("p_lot", "p_label").agg(joined("company").alias("company_preview"), joined("usage").alias("usage_preview"))
    out = out.join(values, F.col("lot_id").eqNullSafe(F.col("p_lot")) & F.col("snapshot_label").eqNullSafe(F.col("p_label"))).drop("p_lot", "p_label")
    return out.withColumn("confidence", C.confidence("n", "band"))


def shared_best(best: DataFrame, lots: DataFrame, policy: str = "flag", key: str = "name", address: str = "address_canon") -> DataFrame:
    """Lots at one address with the same best candidate of a snapshot: ``multilot`` flag, or confidence low.

    Candidates are told apart by their own address and plain name (``key`` name), or by their id (``key`` id), so branches of a brand stay apart.
    """
    own = F.concat_ws("|", F.trim(F.coalesce("o_address", F.lit(""))), F.lower(F.trim(F.coalesce("org_name", F.lit(""))))) if key == "name" else F.col("org_id").cast("string")
    keyed = best if "lot_address" in best.columns else best.join(lots.select("lot_id", F.col(address).alias("lot_address")), "lot_id")
    keyed = keyed.withColumn("best_key", own)
    same = ["lot_address", "snapshot_label", "best_key"]
    several = keyed.groupBy(*same).agg(F.count("*").alias("n_lots")).where("n_lots > 1")
    keyed = keyed.join(several, same, "left").withColumn("multilot", F.col("n_lots").isNotNull()).drop("n_lots", "best_key").withColumnRenamed("lot_address", address)
    return keyed if policy == "flag" else keyed.withColumn("confidence", F.when(F.col("multilot"), "low").otherwise(F.col("confidence")))


def recent_matches(lots: DataFrame, snapshots: DataFrame, max_days: int = 180, address: str = "address_norm") -> DataFrame:
    """Best candidates among the organisations that the newest snapshot has by a new id, at the lot's plain address.

    An organisation can take one premise only: where it is the best candidate of several lots at an address, they are of low confidence.
    """
    labels = [r[0] for r in snapshots.select("snapshot_label").distinct().orderBy(F.desc("snapshot_label")).limit(2).collect()]
    new = new_orgs(snapshots.where(F.col("snapshot_label").isin(labels)), key="id")
    from auctra.operators.reach import best_in_reach

    best = best_in_reach(lots.where(C.blank_to_null(address).isNotNull()), new, 0, max_days, address=address)
    return shared_best(best, lots, "downgrade", "id", address)


def best_per_lot(best: DataFrame) -> DataFrame:
    """Over snapshots: fewest days, then confidence, then the earlier snapshot."""
    return top_per_group(best, ["lot_id"], ["after_days", C.confidence_rank("confidence"), "snapshot_label"]).drop("rank")


def best_match_of_lots(candidates: DataFrame, previews: int = 5) -> DataFrame:
    """``best_per_lot`` of ``best_matches``; the snapshot is chosen from counts first, so only its candidates are ranked."""
    heads = candidates.groupBy("lot_id", "snapshot_label").agg(F.count("*").alias("n"), F.min("after_days").alias("after_days"), F.min("distance_m").alias("distance_m"))
    heads = heads.withColumn("confidence", C.confidence("n", C.distance_band("distance_m")))
    chosen = materialise(best_per_lot(heads).select("lot_id", "snapshot_label"), "chosen")
    return best_matches(candidates.join(chosen, ["lot_id", "snapshot_label"], "left_semi"), previews)


def first_seen(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("org_id").agg(F.min("snapshot_date").alias("first_seen"))


def unseen_before(candidates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Candidates whose organisation was in no snapshot before the sale."""
    return candidates.join(first_seen(snapshots), "org_id").where("first_seen >= sale_date")


def preexisting(candidates: DataFrame, snapshots: DataFrame, radius_m: float = 100, min_sim: float = 0.8) -> DataFrame:
    """(lot_id, org_id) of candidates that a similar name preceded nearby; for a left anti join.

    Names meet on a rare pair of letters within a cell of the grid (``candidate_pairs``), never by place alone; of equal names at a point only
    the first date counts.
    """
    c = candidates.select("lot_id", "org_id", "sale_date", C.name_tokens("org_name").alias("name"), "o_lat", "o_lon").where("name != '' AND o_lat IS NOT NULL AND o_lon IS NOT NULL").distinct()
    c = c.select(F.struct("lot_id", "org_id", "sale_date", "o_lat", "o_lon").alias("id"), "name", F.explode(cells_around("o_lat", "o_lon", radius_m)).alias("grid"))
    s = snapshots.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy(C.name_tokens("org_name").alias("r_name"), "lat", "lon").agg(F.min("snapshot_date").alias("first")).where("r_name != ''")
    s = s.select(F.struct("first", "lat", "lon").alias("r_id"), "r_name", own_cell("lat", "lon", radius_m).alias("grid"))
    pairs = candidate_pairs(c, s, min_sim, ["grid"]).where("r_id.first < id.sale_date").where(haversine_m("id.o_lat", "id.o_lon", "r_id.lat", "r_id.lon") <= radius_m)
    return reaching(pairs, min_sim).select("id.lot_id", "id.org_id").distinct()


def presale_hits(matches: DataFrame, lots: DataFrame, snapshots: DataFrame, max_m: float = 250) -> DataFrame:
    """Snapshots strictly before the sale that show a matched company at the lot's address."""
    m = matches.where("company IS NOT NULL").select("lot_id", F.explode(C.split_pipe("company")).alias("name")).withColumn("name", C.company_key("name")).where("name != ''")
    m = m.join(lots.select("lot_id", "sale_date", "address_canon", "lat", "lon"), "lot_id")
    s = snapshots.select("address_canon", "snapshot_label", "snapshot_date", C.company_key("org_name").alias("s_name"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")).where("s_name != ''")
    pairs = m.join(s, "address_canon").where("snapshot_date < sale_date").where(F.col("name").contains(F.col("s_name")) | F.col("s_name").contains(F.col("name")))
    return pairs.where(haversine_m("lat", "lon", "s_lat", "s_lon") <= max_m).select("lot_id", "name", "snapshot_label").distinct()


def reclassify(matches: DataFrame, hits: DataFrame) -> DataFrame:
    """Matches that were there before the sale are existing tenants."""
    hit = hits.select("lot_id").distinct().withColumn("hit", F.lit(True))
    out = matches.join(hit, "lot_id", "left")
    was = F.coalesce(F.col("hit"), F.lit(False)) & F.col("confidence").isNotNull()
    return out.withColumn("confidence", F.when(was, "existing_tenant").otherwise(F.col("confidence"))).withColumn("time_window", F.when(was, "existing_tenant_buyout").otherwise(F.col("time_window"))).drop("hit")


def presale_distribution(hits: DataFrame) -> DataFrame:
    n = hits.groupBy("lot_id").agg(F.count_distinct("snapshot_label").alias("snapshots"))
    return n.groupBy("snapshots").agg(F.count("*").alias("lots"))


def tenant_buyout(lots: DataFrame, snapshots: DataFrame, radius_m: float = 50, before: int = 3, after: int = 1) -> DataFrame:
    """Businesses near a lot that are in ``before`` snapshots up to the sale date and ``after`` later ones.

    A business is its name in lower case; name and usage are those of the nearest entry. Snapshots are brought
    together by place before the distance join.
    """
    s = snapshots.select("snapshot_label", "snapshot_date", F.trim("org_name").alias("name"), C.usage_text("rubric", "subrubric").alias("usage"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    s = s.where(~C.is_implausible("name", "usage")).withColumn("key", F.lower("name")).where("key != ''")
    places = s.groupBy("key", "s_lat", "s_lon").agg(F.collect_set(F.struct("snapshot_date", "snapshot_label")).alias("seen"), F.min(F.struct("name", "usage")).alias("shown"))
    pairs = radius_join(lots.select("lot_id", "sale_date", "lat", "lon"), places, radius_m, right_at=("s_lat", "s_lon"))
    out = pairs.groupBy("lot_id", "sale_date", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("seen"), F.min(F.struct("distance_m", "shown")).alias("near"))
    labels = lambda cond: F.transform(F.filter("seen", cond), lambda x: x["snapshot_label"])
    out = out.withColumn("before_labels", labels(lambda x: x["snapshot_date"] <= F.col("sale_date"))).withColumn("after_labels", labels(lambda x: x["snapshot_date"] > F.col("sale_date")))
    out = out.where((F.size("before_labels") >= before) & (F.size("after_labels") >= after))
    return out.select(
        "lot_id", F.col("near.shown.name").alias("name"), F.col("near.shown.usage").alias("usage"), F.col("near.distance_m").alias("distance_m"), F.size("before_labels").alias("n_before"), F.size("after_labels").alias("n_after"),
        F.col("seen")[0]["snapshot_date"].alias("first_seen"), F.element_at("seen", -1)["snapshot_date"].alias("last_seen"), "before_labels", "after_labels",
    )


def buyout_summary(buyout: DataFrame, lots: DataFrame) -> DataFrame:
    """Per trade form: lots, and those with a buyout pattern."""
    hit = buyout.select("lot_id").distinct().withColumn("hit", F.lit(True))
    return lots.join(hit, "lot_id", "left").groupBy("trade_form").agg(F.count("*").alias("lots"), F.count("hit").alias("hits"), (F.count("hit") / F.count("*") * 100).alias("share"))


def business_history(lots: DataFrame, snapshots: DataFrame, max_m: float = 250) -> DataFrame:
    """Per (lot, business) first and last snapshot, whether it is in the newest one, and its entries then and now.

    A business is its canonical name in lower case; what is no tenant is left out. Snapshots are brought together by place before
    they meet the lots. Of several entries in one snapshot the first in text order is the entry, the last the current one.
    """
    newest = snapshots.agg(F.max("snapshot_label").alias("newest"))
    s = snapshots.where(~C.is_implausible("org_name", C.usage_text("rubric", "subrubric")))
    s = s.select("address_canon", "snapshot_label", C.company_name("org_name", V.HISTORY_ALIASES).alias("name"), "rubric", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    s = s.select("address_canon", "snapshot_label", F.lower("name").alias("key"), C.display_entry("name", "rubric").alias("entry"), "s_lat", "s_lon")
    seen = F.struct("snapshot_label", "entry")
    places = s.groupBy("address_canon", "key", "s_lat", "s_lon").agg(F.min(seen).alias("first"), F.max(seen).alias("last"))
    pairs = lots.select("lot_id", "address_canon", "lat", "lon").join(places, "address_canon").where(haversine_m("lat", "lon", "s_lat", "s_lon") <= max_m)
    rows = pairs.groupBy("lot_id", "key").agg(F.min("first").alias("first"), F.max("last").alias("last")).join(F.broadcast(newest), F.lit(True), "left")  # one row
    current = F.col("last.snapshot_label") == F.col("newest")
    return rows.select("lot_id", "key", F.col("first.entry").alias("entry"), F.when(current, F.col("last.entry")).alias("now_entry"), F.col("first.snapshot_label").alias("first_seen"), F.col("last.snapshot_label").alias("last_seen"), current.alias("current"))


def history_lists(history: DataFrame) -> DataFrame:
    """Per lot: all, current and gone businesses, each in text order."""
    pick = lambda c: F.array_join(F.array_sort(F.collect_list(c)), " | ")
    gone = F.when(~F.col("current"), F.col("entry"))
    return history.groupBy("lot_id").agg(pick("entry").alias("all"), pick("now_entry").alias("now"), pick(gone).alias("gone"), F.count("*").alias("n_all"), F.count_if("current").alias("n_now"))


def entry_category(entry) -> Column:
    """What stands in the last brackets at the end of an entry, else the entry."""
    c = F.col(entry) if isinstance(entry, str) else entry
    return F.when(c.endswith(")") & c.contains("("), F.trim(F.regexp_extract(c, r"\(([^(]*)\)$", 1))).otherwise(c)


def category_survival(history: DataFrame, min_total: int = 50, n: int = 5) -> DataFrame:
    """Share of businesses of a category that are still there; the best and worst n. A row counts ``n_lots`` times, if it has that."""
    shown = F.coalesce("now_entry", "entry")
    times = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n_lots"))), F.lit(0)) if "n_lots" in history.columns else F.count_if(cond)
    stats = history.groupBy(entry_category(shown).alias("category")).agg(times(F.col("current")).alias("now"), times(~F.col("current")).alias("gone"))
    stats = stats.where(F.col("now") + F.col("gone") >= min_total).withColumn("survival", F.col("now") / (F.col("now") + F.col("gone")) * 100)
    return stats.orderBy(F.desc("survival"), "category").limit(n).withColumn("end", F.lit("best")).unionByName(stats.orderBy("survival", "category").limit(n).withColumn("end", F.lit("worst")))


def likely_usage(candidates: DataFrame, n: int = 3) -> DataFrame:
    """Company and usage of the best candidate if confidence is high, else the first n joined."""
    return likely_usage_of(best_matches(candidates, n))


def likely_usage_of(best: DataFrame) -> DataFrame:
    """``likely_usage`` of best matches whose previews have as many names as are to be joined."""
    single = F.col("confidence") == "high"
    return best.select("lot_id", "snapshot_label", F.when(single, F.col("company")).otherwise(F.col("company_preview")).alias("company"), F.when(single, F.col("usage")).otherwise(F.col("usage_preview")).alias("usage"), "confidence", "n", "after_days")


# Retail chains


def _area_class(c) -> Column:
    """Eighths of doublings of an area, from 0 (1 m² and less) to 160 (a million and more)."""
    return F.least(F.greatest(F.floor(8 * F.log2(F.greatest(c, F.lit(1.0)))), F.lit(0)), F.lit(160)).cast("int")


def match_chains(lots: DataFrame, chains: DataFrame) -> DataFrame:
    """Lots (area, floor_label, separate, near_school) and chains whose area range, floors, entrance and school rule fit.

    Joined by classes of the area; a chain is in every class that its range touches. A lot without an area fits none.
    """
    lo, hi = F.coalesce("area_min_m2", F.lit(0.0)), F.coalesce("area_max_m2", F.lit(float("inf")))
    c = chains.where(lo <= hi).withColumn("f", C.chain_floor_flags("floor")).withColumn("area_class", F.explode(F.sequence(_area_class(lo), _area_class(hi))))
    c = c.select(F.col("name").alias("chain"), "category", "area_min_m2", "area_max_m2", "separate_entrance", "f", "area_class")
    area = F.coalesce(F.col("area") >= F.col("area_min_m2"), F.lit(True)) & F.coalesce(F.col("area") <= F.col("area_max_m2"), F.lit(True))
    floor = F.col("f.any") | ((F.col("floor_label") == "1 этаж") & F.col("f.first")) | ((F.col("floor_label") == "Подвал") & F.col("f.basement")) | ((F.col("floor_label") == "Цоколь") & F.col("f.cellar"))
    entrance = ~F.col("separate_entrance") | F.col("separate")
    school = ~((F.col("category") == V.ALCOHOL_CATEGORY) & F.col("near_school"))
    placed = lots.where("area IS NOT NULL").withColumn("area_class", _area_class(F.col("area")))
    return placed.join(c, "area_class").where(area & floor & entrance & school).drop("f", "area_class")


def chain_summary(matched: DataFrame, n: int = 8) -> DataFrame:
    """Per lot: matches, sorted categories, first n chains, most frequent category."""
    per = matched.groupBy("lot_id", "category").agg(F.count("*").alias("c"), F.slice(F.array_sort(F.collect_set("chain")), 1, n).alias("chains"))
    return per.groupBy("lot_id").agg(
        F.sum("c").alias("chains_n"), F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"),
        F.array_join(F.slice(F.array_sort(F.flatten(F.collect_list("chains"))), 1, n), "; ").alias("top_chains"), F.max_by("category", F.struct("c", "category")).alias("top_category"),
    )


def area_limits(chains: DataFrame, lo: float = 0.25, hi: float = 4.0, q: float = 0.75) -> DataFrame:
    """Per category hard limits of the area; open where nothing is known."""
    out = chains.groupBy("category").agg(F.min("area_min_m2").alias("a"), F.percentile("area_max_m2", q).alias("b"))
    return out.where("a IS NOT NULL OR b IS NOT NULL").select("category", F.coalesce(F.col("a") * lo, F.lit(0.0)).alias("area_lo"), F.coalesce(F.col("b") * hi, F.lit(float("inf"))).alias("area_hi"))


def first_floor_chains(chains: DataFrame) -> DataFrame:
    """Names of chains that ask for the first floor and take no basement."""
    f = F.lower(F.trim("floor"))
    wants = f.rlike(V.FIRST_FLOOR_WORDS)
    return chains.where(wants & ~f.contains("подвал") & ~f.contains("цоколь")).select(F.lower(F.trim("name")).alias("chain")).where("chain != ''").distinct()


def pure_basement(floor: str) -> Column:
    low = F.lower(F.coalesce(F.col(floor), F.lit("")))
    return low.contains("подвал") & ~low.rlike("[1-9]")


#: Chain names that go to every task as one list; more are looked up by their rarest letters.
LISTED_CHAINS = 5_000


def invalid_reason(candidates: DataFrame, limits: DataFrame, chains: DataFrame) -> DataFrame:
    """Adds ``reason`` (implausible, area, floor or null) to candidates (company, usage, area, floor)."""
    rows = candidates.withColumn("category", C.retail_category("usage")).join(limits, "category", "left")
    name = F.replace(F.replace(F.lower("company"), F.lit("&"), F.lit(" и ")), F.lit("  "), F.lit(" "))
    names = chains.where("chain != ''").select("chain").distinct()
    listed = [r[0] for r in names.limit(LISTED_CHAINS + 1).collect()]
    if len(listed) <= LISTED_CHAINS:
        listed = F.array(*map(F.lit, listed)).cast("array<string>")
        rows = rows.withColumn("__chain", F.exists(listed, lambda x: F.contains(name, x)))
    else:
        rows = materialise(rows.withColumn("__name", name), "named")
        own = rows.select(F.col("__name").alias("name")).distinct().select(F.col("name").alias("id"), "name")
        hit = containing(names.select(F.col("chain").alias("id"), F.col("chain").alias("name")), own).select(F.col("r_name").alias("__name")).distinct().withColumn("__chain", F.lit(True))
        rows = rows.join(hit, "__name", "left").drop("__name")
    floor = pure_basement("floor") & F.col("__chain")
    area = F.coalesce((F.col("area") < F.col("area_lo")) | (F.col("area") > F.col("area_hi")), F.lit(False))
    return rows.withColumn("reason", F.when(C.is_implausible("company", "usage", "revalidate"), "implausible").when(area, "area").when(floor, "floor")).drop("__chain", "area_lo", "area_hi")


def revalidate(matches: DataFrame, lots: DataFrame, limits: DataFrame, chains: DataFrame, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """Drops implausible candidates of the previews, selects anew, clears matches with none left; also the count of reasons."""
    zipped = F.arrays_zip(C.split_pipe("company_preview").alias("company"), C.split_pipe("usage_preview").alias("usage"))
    rows = matches.where("confidence IS NOT NULL").select("lot_id", F.posexplode(zipped).alias("pos", "x")).select("lot_id", "pos", "x.company", "x.usage").where("company IS NOT NULL")
    rows = invalid_reason(rows.join(lots.select("lot_id", "area", "floor"), "lot_id"), limits, chains)
    report = rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    kept = rows.where("reason IS NULL").groupBy("lot_id").agg(
        F.min_by("company", "pos").alias("new_company"), F.min_by("usage", "pos").alias("new_usage"), ordered_preview(F.col("company"), F.col("pos"), n).alias("new_companies"), ordered_preview(F.col("usage"), F.col("pos"), n).alias("new_usages")
    )
    out = matches.join(kept, "lot_id", "left")
    was, ok = F.col("confidence").isNotNull(), F.col("new_company").isNotNull()
    put = lambda c, new: F.when(was & ok, F.col(new)).when(~was, F.col(c))
    out = out.select(*[c for c in matches.columns if c not in ("company", "usage", "company_preview", "usage_preview", "confidence")], put("company", "new_company").alias("company"), put("usage", "new_usage").alias("usage"),
                     put("company_preview", "new_companies").alias("company_preview"), put("usage_preview", "new_usages").alias("usage_preview"), F.when(was & ok, F.col("confidence")).alias("confidence"))
    return out.select(matches.columns), report


def clear_matches(matches: DataFrame, rule: Column, columns: list[str] = ("company", "usage", "confidence", "time_window", "after_days")) -> DataFrame:
    """Clears the match columns where a rule holds (school zone, no separate entrance, small area)."""
    hit = F.coalesce(rule, F.lit(False))
    return matches.select(*[F.when(~hit, F.col(c)).alias(c) if c in columns else F.col(c) for c in matches.columns])


# Merges: every one is idempotent


_FIELDS = ["company", "usage", "confidence", "after_days", "time_window"]


def _take(matches: DataFrame, new: DataFrame, use: Column, extra: list[Column] = ()) -> DataFrame:
    return matches.join(new, "lot_id", "left").select("lot_id", *[F.when(use, F.col("n_" + c)).otherwise(F.col(c)).alias(c) for c in _FIELDS], *[c for c in matches.columns if c not in ("lot_id", *_FIELDS)], *extra)


def _new(df: DataFrame) -> DataFrame:
    return df.select("lot_id", *[F.col(c).alias("n_" + c) for c in _FIELDS])


def _cleared(matches: DataFrame, stale: Column) -> DataFrame:
    return clear_matches(matches, stale, _FIELDS)


def merge_recent(matches: DataFrame, recent: DataFrame, window: str) -> DataFrame:
    """Clears its own window, then fills unmatched lots by high and medium matches; ``source`` is recent or baseline."""
    base = _cleared(matches, F.col("time_window") == window)
    new = _new(recent.where(F.col("confidence").isin(GOOD)).withColumn("time_window", F.lit(window)))
    use = F.col("confidence").isNull() & F.col("n_confidence").isNotNull()
    return _take(base, new, use, [F.when(use, "recent").when(F.col("confidence").isNotNull(), "baseline").alias("source")])


def merge_gap(matches: DataFrame, gap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clears stale ``gap_snapshot_`` matches, fills unmatched lots, replaces ``first_after_snapshot_`` matches that are farther or no better; also the count of actions."""
    base = _cleared(matches, F.col("time_window").startswith("gap_snapshot_"))
    new = _new(gap.where(F.col("confidence").isin(GOOD)).withColumn("time_window", F.concat(F.lit("gap_snapshot_"), F.col("snapshot_label"))))
    closer = (F.col("n_after_days") < F.col("after_days")) | ((F.col("n_after_days") == F.col("after_days")) & (C.confidence_rank("n_confidence") <= C.confidence_rank("confidence")))
    first = F.col("time_window").startswith("first_after_snapshot_")
    action = F.when(F.col("n_confidence").isNull(), "none").when(F.col("confidence").isNull(), "added").when(first & closer, "upgraded").otherwise("kept")
    out = _take(base, new, action.isin("added", "upgraded"), [action.alias("action")])
    return out.drop("action"), out.groupBy("action").agg(F.count("*").alias("n"))


def recover_matches(candidates: DataFrame, matches: DataFrame, lots: DataFrame, limits: DataFrame, chains: DataFrame, min_days: int = 181, far_days: int = 365, names: int = 3, previews: int = 5) -> DataFrame:
    """Matches beyond the usual window for lots without any.

    The best snapshot of a lot and its confidence come from all candidates; the confidence is adjusted by the nearest one's distance band, and high turns
    medium beyond ``far_days``. Candidates that are implausible or do not fit the area are left out of the names; floors do not count here. A lone
    name of high confidence stands alone, else the first ``names`` different ones are given.
    """
    free = candidates.join(matches.where("confidence IS NOT NULL").select("lot_id"), "lot_id", "left_anti").where(F.col("after_days") >= min_days)
    best = materialise(best_per_lot(best_matches(free, previews)).withColumn("confidence", C.geo_confidence("confidence", "band")).where("confidence IS NOT NULL"), "recovered")
    rows = free.join(best.select("lot_id", "snapshot_label"), ["lot_id", "snapshot_label"], "left_semi")
    rows = invalid_reason(rows.join(lots.select("lot_id", "area", "floor"), "lot_id"), limits, chains).where("coalesce(reason, 'floor') = 'floor'")
    order = F.struct("distance_m", "company", "org_id")
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("company", "usage")])).alias("x")
    values = rows.select("lot_id", order.alias("o"), values).groupBy("lot_id", "x.kind", "x.value").agg(F.min("o").alias("o"), F.count("*").alias("times"))
    total = values.where("kind = 'company'").groupBy("lot_id").agg(F.sum("times").alias("n_valid"))
    shown = lambda kind, n: F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("rank") <= previews), F.struct("rank", "value")))), lambda x: x["value"]), 1, n), " | ")
    values = top_per_group(values, ["lot_id", "kind"], ["o"], max(names, previews))
    kept = values.groupBy("lot_id").agg(*[shown(k, n).alias(a) for k, n, a in (("company", names, "n_company"), ("usage", names, "n_usage"), ("company", previews, "n_companies"), ("usage", previews, "n_usages"))]).join(total, "lot_id")
    return shown_names(best.drop("company", "usage", "company_preview", "usage_preview").join(kept, "lot_id"), far_days)


def shown_names(best: DataFrame, far_days: int = 365) -> DataFrame:
    """Confidence, names and window of recovered matches with n_company, n_usage (the names to give), n_companies, n_usages (previews) and n_valid (candidates left)."""
    low = (F.col("confidence") == "high") & (F.col("after_days") > far_days)
    out = best.withColumn("confidence", F.when(low, "medium").otherwise(F.col("confidence")))
    alone = lambda c: F.when((F.col("confidence") == "high") & (F.col("n_valid") == 1), F.split_part(F.col(c), F.lit(" | "), F.lit(1))).otherwise(F.col(c))
    out = out.withColumns({"company": alone("n_company"), "usage": alone("n_usage"), "company_preview": F.col("n_companies"), "usage_preview": F.col("n_usages")}).drop("n_company", "n_usage", "n_companies", "n_usages")
    return out.withColumn("time_window", F.concat(F.lit("first_after_snapshot_"), F.col("snapshot_label")))


def merge_tenants(matches: DataFrame, buyout: DataFrame, history: DataFrame, lots: DataFrame, limits: DataFrame, chains: DataFrame, n: int = 10) -> DataFrame:
    """Unmatched lots whose surroundings show a tenant before and after the sale become existing tenants.

    Only lots with a business history at their own address (``history``: lot_id) count: a neighbour alone is no evidence. Of each business the nearest
    row counts; names and usages are those of the first ``n``, and replace the previews where ``matches`` has them.
    """
    rows = buyout.withColumnRenamed("name", "company").join(history.select("lot_id").distinct(), "lot_id", "left_semi").join(lots.select("lot_id", "area", "floor"), "lot_id")
    rows = invalid_reason(rows, limits, chains).where("reason IS NULL")
    rows = top_per_group(rows.withColumn("key", F.lower(F.trim("company"))), ["lot_id", "key"], ["distance_m", "company"], 1).drop("rank")
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.trim(c).alias("value")) for c in ("company", "usage")])).alias("x")
    values = rows.select("lot_id", F.struct("distance_m", "company").alias("o"), values).where("x.value != ''").groupBy("lot_id", "x.kind", "x.value").agg(F.min("o").alias("o"))
    values = top_per_group(values, ["lot_id", "kind"], ["o"], n)
    shown = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "value")))), lambda x: x["value"]), " | ")
    return put_tenants(matches, values.groupBy("lot_id").agg(shown("company").alias("n_company"), shown("usage").alias("n_usage")))


def put_tenants(matches: DataFrame, tenants: DataFrame) -> DataFrame:
    """Unmatched lots with ``tenants`` (lot_id, n_company, n_usage) become existing tenants."""
    tenants = tenants.select("lot_id", "n_company", "n_usage", F.lit("existing_tenant").alias("n_confidence"), F.lit(None).cast("int").alias("n_after_days"), F.lit("existing_tenant_buyout").alias("n_time_window"))
    use = F.col("confidence").isNull() & F.col("n_confidence").isNotNull()
    previews = {p: F.when(use, F.col(c)).otherwise(F.col(p)) for p, c in (("company_preview", "n_company"), ("usage_preview", "n_usage")) if p in matches.columns}
    joined = matches.join(tenants, "lot_id", "left").withColumns(previews) if previews else matches.join(tenants, "lot_id", "left")
    return joined.select(*[F.when(use, F.col("n_" + c)).otherwise(F.col(c)).alias(c) if c in _FIELDS else F.col(c) for c in matches.columns])


def baseline_matches(candidates: DataFrame, snapshots: DataFrame, lo: int = 180, hi: int = 365) -> DataFrame:
    """Best snapshot of each lot in the window, from candidates that were not there before by id or by similar name nearby."""
    rows = candidates.where(F.col("after_days").between(lo, hi))
    rows = unseen_before(rows, snapshots).join(preexisting(rows, snapshots), ["lot_id", "org_id"], "left_anti")
    best = best_matches(rows).withColumn("confidence", C.geo_confidence("confidence", "band")).where("confidence IS NOT NULL")
    return best_per_lot(best).withColumn("time_window", F.lit(f"{lo}-{hi}d"))


def top_candidates(best: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """High and medium lots, and their ranked candidates only."""
    good = best.where(F.col("confidence").isin(GOOD) & (F.col("n") >= 1))
    rows = candidates.join(good.select("lot_id", "snapshot_label"), ["lot_id", "snapshot_label"], "left_semi")
    return good, rows.withColumn("rank", F.row_number().over(W.partitionBy("lot_id", "snapshot_label").orderBy("distance_m", "company", "org_id")))


def uncovered_addresses(lots: DataFrame, snapshots: DataFrame) -> DataFrame:
    return lots.join(snapshots.select("address_canon").distinct(), "address_canon", "left_anti")


def backfill_coordinates(lots: DataFrame, sources: DataFrame) -> DataFrame:
    """Missing coordinates by lot id, cadastral number, building key, then the relaxed key if it has one location."""
    src = sources.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("key", C.building_key("address")).withColumn("relaxed", C.building_key("address", relaxed=True))
    out = lots.withColumn("key", C.building_key("address")).withColumn("relaxed", C.building_key("address", relaxed=True))
    steps = [("lot_id", False), ("cadastral_no", False), ("key", False), ("relaxed", True)]
    for i, (k, single) in enumerate(steps):
        at = src.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(F.struct("lat", "lon")).alias(f"at{i}"), F.count_distinct("lat", "lon").alias("n"))
        out = out.join((at.where("n = 1") if single else at).drop("n"), k, "left")
    own = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    at = F.coalesce(own, *[F.col(f"at{i}") for i in range(4)])
    how = F.when(own.isNotNull(), "own")
    for i, (k, _) in enumerate(steps):
        how = how.when(F.col(f"at{i}").isNotNull(), k)
    return out.withColumn("at", at).withColumn("how", how.otherwise("none")).select(*[c for c in lots.columns if c not in ("lat", "lon")], F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"), "how")


def valid_geocodes(candidates: DataFrame, bbox: tuple[float, float, float, float] = (55.1, 56.1, 36.7, 38.1)) -> DataFrame:
    """Geocode results inside the city whose building agrees with the query; a block or structure that one side lacks is no conflict."""
    a, b = C.building_key("address"), C.building_key("found_address")
    part = lambda k, i: C.blank_to_null(F.split_part(F.get(F.split(k, r"\|"), F.lit(i)), F.lit(":"), F.lit(2)))
    head = F.substring_index(a, "|", 2) == F.substring_index(b, "|", 2)
    agree = lambda i: F.coalesce(part(a, i) == part(b, i), F.lit(True))
    return candidates.where(F.col("lat").between(*bbox[:2]) & F.col("lon").between(*bbox[2:]) & F.coalesce(head, F.lit(False)) & agree(2) & agree(3))
