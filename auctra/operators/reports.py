"""Named reports over lots, matches, histories and protocols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from auctra.functions import columns as C
from auctra.functions import vocab as V
from auctra.operators.stats import share, top_n


def one_per_place(matches: DataFrame) -> DataFrame:
    """One row per (company, address_canon): the earliest opening, then the smaller lot id."""
    first = F.row_number().over(W.partitionBy("company", "address_canon").orderBy("after_days", "lot_id"))
    return matches.where(F.col("company").isNotNull()).withColumn("r", first).where("r = 1").drop("r")


def tenant_kpis(matches: DataFrame, max_days: int = 365) -> DataFrame:
    """Unique tenants and the share of pick-up points among them; over all matched lots how soon new businesses open, and the shares of first floors and basements.

    Columns company, usage, address_canon, confidence, after_days, floor_label.
    """
    matched = matches.where(F.col("confidence").isin(V.MATCHED))
    unique = one_per_place(matched.where("company != ''")).agg(F.count("*").alias("tenants"), share(C.chart_category("usage") == V.PICKUP_CATEGORY).alias("marketplace_pct"))
    days = F.when((F.col("confidence") != "existing_tenant") & (F.col("after_days") > 0) & (F.col("after_days") <= max_days), F.col("after_days"))
    part = lambda d: F.count_if(days < d) / F.count(days) * 100
    floor = lambda label: share(F.col("floor_label").eqNullSafe(label))
    every = matched.agg(F.median(days).alias("median_days"), part(90).alias("under_90_pct"), part(180).alias("under_180_pct"), floor("1 этаж").alias("first_floor_pct"), floor("Подвал").alias("basement_pct"))
    return unique.join(every, F.lit(True))  # one row each


def form_discount(lots: DataFrame) -> DataFrame:
    """Median of the final over the start price by trade form."""
    ratio = F.when(F.col("start_price") > 0, F.col("final_price") / F.col("start_price"))
    return lots.groupBy("trade_form").agg(F.count(ratio).alias("n"), F.median(ratio).alias("median_ratio"))


def history_sizes(history: DataFrame, matches: DataFrame) -> DataFrame:
    """Median number of businesses ever seen at matched and at unmatched lots, of lots that have any; ``history`` may be those numbers (lot_id, n)."""
    n = history if "n" in history.columns else history.groupBy("lot_id").agg(F.count("*").alias("n"))
    return matches.join(n, "lot_id").groupBy(F.coalesce(F.col("confidence").isin(V.MATCHED), F.lit(False)).alias("matched")).agg(F.count("*").alias("lots"), F.median("n").alias("median_n"))


def tenant_shares(matches: DataFrame) -> DataFrame:
    """Existing tenants against new businesses: lots, mean bidders, median final price."""
    kind = F.when(F.col("confidence") == "existing_tenant", "existing_tenant").when(F.col("confidence").isin(V.MATCHED), "new_business").otherwise("not_found")
    return matches.groupBy(kind.alias("match_class")).agg(F.count("*").alias("lots"), F.avg("bidders").alias("mean_bidders"), F.median("final_price").alias("median_final"))


def matches_by_year(matches: DataFrame) -> DataFrame:
    hit = F.col("confidence").isin(V.MATCHED)
    return matches.groupBy(F.year("sale_date").alias("year")).agg(F.count("*").alias("lots"), F.count_if(hit).alias("matched"), share(hit).alias("matched_pct"))


def history_overlap(matches: DataFrame, history: DataFrame) -> DataFrame:
    """Matched companies that the history of their lot shows at all, now, or gone."""
    m = matches.where("company IS NOT NULL").select("lot_id", C.company_key("company").alias("key"))
    h = history.select("lot_id", C.company_key("key").alias("h_key"), "current")
    same = F.col("key").contains(F.col("h_key")) | F.col("h_key").contains(F.col("key"))
    hit = m.join(h, "lot_id").where(same & (F.col("h_key") != "")).groupBy("lot_id").agg(F.max("current").alias("now"), F.max(~F.col("current")).alias("gone"))
    return m.join(hit, "lot_id", "left").agg(F.count("*").alias("lots"), F.count("now").alias("in_all"), F.count_if("now").alias("in_now"), F.count_if("gone").alias("in_gone"))


def geocode_coverage(lots: DataFrame) -> DataFrame:
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return lots.groupBy(F.year("sale_date").alias("year")).agg(F.count("*").alias("lots"), F.count_if(located).alias("located"), share(located).alias("located_pct"))


def unique_locations(sources: DataFrame, key: str) -> DataFrame:
    """Keys with exactly one location."""
    return sources.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("lat", "lon").alias("n"), F.min(F.struct("lat", "lon")).alias("at")).where("n = 1").select(key, "at.lat", "at.lon")


def protocol_tallies(protocols: DataFrame) -> DataFrame:
    """Parsed protocols: with bidders, with a winner's price, and the distribution of bidders."""
    p = F.col("participants_count")
    return protocols.agg(F.count("*").alias("n"), F.count_if(p > 0).alias("with_bidders"), F.count("winner_price_num").alias("with_price"), F.avg(p).alias("mean"), F.median(p).alias("median"), F.min(p).alias("min"), F.max(p).alias("max"))


def per_year(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy(F.year(date).alias("year")).agg(F.count("*").alias("n"))


def reconcile_prices(lots: DataFrame, protocols: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Lots with a price: confirmed by the protocol, without one, or differing from it."""
    rows = lots.join(protocols.select("lot_id", "winner_price_num"), "lot_id", "left")
    priced, proto = F.col("final_price").isNotNull(), F.col("winner_price_num").isNotNull()
    near = F.abs(F.col("final_price") - F.col("winner_price_num")) <= tolerance
    return rows.agg(F.count("*").alias("lots"), F.count_if(priced).alias("priced"), F.count_if(priced & proto & near).alias("confirmed"), F.count_if(priced & ~proto).alias("unconfirmed"), F.count_if(priced & proto & ~near).alias("differing"))


def deposit_distribution(lots: DataFrame, by: list) -> DataFrame:
    """Count, mean and range of the deposit in percent of the start price."""
    pct = F.when(F.col("start_price") > 0, F.col("deposit") / F.col("start_price") * 100)
    return lots.groupBy(*by).agg(F.count(pct).alias("n"), F.avg(pct).alias("mean_pct"), F.min(pct).alias("min_pct"), F.max(pct).alias("max_pct"))


def entrance_discount(listings: DataFrame, floor: str = "1") -> DataFrame:
    """Price per m² by entrance, and the discount to the dearest kind on one floor."""
    stats = listings.groupBy("entrance").agg(F.count("*").alias("n"), F.avg("price").alias("mean"), F.median("price").alias("median"), F.median(F.when(F.col("floor") == floor, F.col("price"))).alias("floor_median"))
    return stats.withColumn("discount_pct", (F.col("floor_median") / F.max("floor_median").over(W.partitionBy()) - 1) * 100)


def neighbour_categories(buyout: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent categories among long-standing neighbours. A row counts ``n_lots`` times, if it has that."""
    times = F.sum("n_lots") if "n_lots" in buyout.columns else F.count("*")
    return top_n(buyout.groupBy(C.chart_category("usage").alias("category")).agg(times.alias("n")), [F.desc("n"), "category"], n)


def form_by_class(matches: DataFrame) -> DataFrame:
    """Trade form by match class: medians of area, excess and bidders, share sold below the start price."""
    kind = F.when(F.col("confidence") == "existing_tenant", "existing_tenant").when(F.col("confidence").isin(V.MATCHED), "new_business").otherwise("not_found")
    below = F.col("final_price") < F.col("start_price")
    return matches.groupBy("trade_form", kind.alias("match_class")).agg(F.count("*").alias("n"), F.median("area").alias("median_area"), F.median("excess").alias("median_excess"), F.median("bidders").alias("median_bidders"), share(below).alias("below_pct"))


def evasion_by_percent(lots: DataFrame, most: float = 30, min_n: int = 5) -> DataFrame:
    """Evasion by the deposit in whole percent of the start price (column ``evasion``); the bound is on the percent with one decimal."""
    pct = F.bround(F.col("deposit") / F.col("start_price") * 100, 1)
    out = lots.where(pct <= most).groupBy(F.bround(pct, 0).cast("int").alias("deposit_pct")).agg(F.count("*").alias("n"), F.count_if("evasion").alias("evaded_n"), share(F.col("evasion")).alias("evasion_pct"))
    return out.where(F.col("n") >= min_n)


def form_years(matches: DataFrame) -> DataFrame:
    """Share of lots with a tenant by year and trade form."""
    return matches.groupBy(F.year("sale_date").alias("year"), "trade_form").agg(F.count("*").alias("n"), share(F.coalesce(F.col("confidence").isin(V.MATCHED), F.lit(False))).alias("tenant_pct"))


def quartiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile(value, q).alias(name) for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])


def price_by_floor(lots: DataFrame, dear: float = 100_000) -> DataFrame:
    """Per floor group (columns floor, price_m2, area, excess): share of all, means, mean excess and share of the sold, quartiles, share of dear lots."""
    sold = F.col("excess") >= 0
    out = lots.groupBy(C.floor_group("floor").alias("floor_group")).agg(
        F.count("*").alias("n"), F.avg("price_m2").alias("mean_price"), F.avg("area").alias("mean_area"), F.avg(F.when(sold, F.col("excess"))).alias("mean_excess"), share(sold).alias("sold_pct"),
        *[F.percentile("price_m2", q).alias(name) for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))], share(F.col("price_m2") >= dear).alias("dear_pct"),
    )
    return out.withColumn("share_pct", F.col("n") / F.sum("n").over(W.partitionBy()) * 100)  # eight rows


def price_clusters(lots: DataFrame, dear: float = 100_000) -> DataFrame:
    """The two clusters by price per m²: cheap and dear, with their share, means and share of the sold."""
    out = lots.where("price_m2 IS NOT NULL").groupBy(F.when(F.col("price_m2") >= dear, "dear").otherwise("cheap").alias("cluster")).agg(
        F.count("*").alias("n"), F.avg("price_m2").alias("mean_price"), F.avg("area").alias("mean_area"), share(F.col("excess") >= 0).alias("sold_pct"), F.avg(F.when(F.col("excess") >= 0, F.col("excess"))).alias("mean_excess")
    )
    return out.withColumn("share_pct", F.col("n") / F.sum("n").over(W.partitionBy()) * 100)  # two rows


def strong_signal(buyout: DataFrame, before: int = 5, after: int = 2) -> DataFrame:
    """Businesses, and their lots, that were seen often before and again after a sale."""
    sure = (F.col("n_before") >= before) & (F.col("n_after") >= after)
    return buyout.where(sure).agg(F.count("*").alias("businesses"), F.count_distinct("lot_id").alias("lots"))


def coordinate_coverage(houses: DataFrame, coords: DataFrame, key: str = "fias") -> DataFrame:
    """Houses, and those with coordinates."""
    known = coords.where("lat IS NOT NULL AND lng IS NOT NULL").select(key).distinct().withColumn("known", F.lit(True))
    return houses.select(key).distinct().join(known, key, "left").agg(F.count("*").alias("houses"), F.count("known").alias("located"), (F.count("known") / F.count("*") * 100).alias("located_pct"))
