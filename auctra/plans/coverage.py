"""Further registered queries: matching and its merges, lots, reports and column rules, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from auctra.functions import columns as C
from auctra.functions import vocab as V
from auctra.operators import lots as L
from auctra.operators import matching as M
from auctra.operators import reach as Q
from auctra.operators import reports as R
from auctra.operators import stats as A
from auctra.plans.given import LISTINGS, LOTS, POINTS, SNAPSHOTS, listings, lots, points, snapshots, sql_metres, table
from auctra.plans.queries import _BEST, _BUYOUT, _CAND, _HISTORY, _MATCHED, _best, _matched, _rounded, query, r

def _buyouts(spark, d):
    return Q.class_buyouts(lots(spark, d).select("lot_id", "sale_date", "lat", "lon"), snapshots(spark, d))


def _history(spark, d):
    return Q.class_history(lots(spark, d).select("lot_id", "address_canon", "lat", "lon"), snapshots(spark, d))


# Matching: what was there before, what is likely, what is best

_HITS = f"""{LOTS}, {SNAPSHOTS}, m AS (SELECT lot_id, sale_date, address_canon, lat, lon, unnest(['org ' || (lot_id % 97 + 1), 'ozon']) AS name FROM lots WHERE lot_id % 5 < 3),
s AS (SELECT *, lower(trim(split_part(org_name, ',', 1))) AS s_name FROM snaps),
hits AS (SELECT DISTINCT m.lot_id, m.name, s.snapshot_label FROM m JOIN s USING (address_canon) WHERE s.snapshot_date < m.sale_date AND (contains(m.name, s.s_name) OR contains(s.s_name, m.name)) AND {sql_metres('m.lat', 'm.lon', 's.lat', 's.lon')} <= 250)"""


def _claims(spark, d):
    """Matches of three fifths of the lots, each with two companies."""
    k = F.col("lot_id")
    x = lots(spark, d).where(k % 5 < 3)
    company = F.concat(F.lit("Org "), (k % 97 + 1).cast("string"), F.lit(" (центр) | OZON, пункт"))
    return x.select("lot_id", company.alias("company"), F.when(k % 5 == 0, "high").when(k % 5 == 1, "medium").alias("confidence"), F.when(k % 5 < 2, "180-365d").alias("time_window"))


@query(f"WITH {_HITS} SELECT lot_id, name, snapshot_label FROM hits")
def presale_hits(spark, d):
    return Q.presale_hits(*Q.presale_seen(_claims(spark, d), lots(spark, d), snapshots(spark, d)))


@query(f"WITH {_HITS} SELECT lot_id, CASE WHEN lot_id % 5 < 2 AND lot_id IN (SELECT lot_id FROM hits) THEN 'existing_tenant' WHEN lot_id % 5 = 0 THEN 'high' WHEN lot_id % 5 = 1 THEN 'medium' END AS confidence, CASE WHEN lot_id % 5 < 2 THEN CASE WHEN lot_id IN (SELECT lot_id FROM hits) THEN 'existing_tenant_buyout' ELSE '180-365d' END END AS time_window FROM lots WHERE lot_id % 5 < 3")
def presale_reclassified(spark, d):
    claims = _claims(spark, d)
    return M.reclassify(claims, Q.presale_lots(*Q.presale_seen(claims, lots(spark, d), snapshots(spark, d)))).select("lot_id", "confidence", "time_window")


@query(f"WITH {_HITS}, n AS (SELECT lot_id, count(DISTINCT snapshot_label) AS snapshots FROM hits GROUP BY 1) SELECT snapshots, count(*) AS lots FROM n GROUP BY 1")
def presale_distribution(spark, d):
    return Q.presale_distribution(*Q.presale_seen(_claims(spark, d), lots(spark, d), snapshots(spark, d)))


@query(f"WITH {_BUYOUT} SELECT trade_form, count(*) AS lots, count(*) FILTER (lot_id IN (SELECT lot_id FROM buy)) AS hits, round(count(*) FILTER (lot_id IN (SELECT lot_id FROM buy)) * 100.0::DOUBLE / count(*), 4) AS share FROM lots GROUP BY 1")
def buyout_summary(spark, d):
    own, found = _buyouts(spark, d)
    return _rounded(M.buyout_summary(own.join(found.select("class", "era").distinct(), ["class", "era"], "left_semi"), lots(spark, d)))


@query(f"WITH {_BUYOUT}, c AS (SELECT CASE WHEN usage LIKE 'Грузо%' THEN 'Маркетплейсы (ПВЗ)' ELSE usage END AS category FROM buy) SELECT category, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, category LIMIT 10")
def neighbour_categories(spark, d):
    return R.neighbour_categories(Q.buyout_counts(*_buyouts(spark, d)))


_SURVIVAL = f"""{_HISTORY}, c AS (SELECT coalesce(CASE WHEN current THEN now_entry END, entry) AS e, current FROM hist), g AS (SELECT CASE WHEN e LIKE '%)' THEN split_part(e, '(', -1)[:-2] ELSE e END AS category, count(*) FILTER (current) AS now, count(*) FILTER (NOT current) AS gone FROM c GROUP BY 1),
s AS (SELECT category, now, gone, now * 100.0::DOUBLE / (now + gone) AS v FROM g WHERE now + gone >= 50)"""


@query(f"WITH {_SURVIVAL} SELECT category, now, gone, round(v, 4) AS survival, 'best' AS \"end\" FROM (SELECT * FROM s ORDER BY v DESC, category LIMIT 5) UNION ALL SELECT category, now, gone, round(v, 4), 'worst' FROM (SELECT * FROM s ORDER BY v, category LIMIT 5)")
def category_survival(spark, d):
    own, found = _history(spark, d)
    return _rounded(M.category_survival(found.join(Q.class_sizes(own, ["class"]), "class")))


@query(f"WITH {_HISTORY}, n AS (SELECT lot_id, count(*) AS n FROM hist GROUP BY 1) SELECT lot_id % 5 < 3 AS matched, count(*) AS lots, round(median(n), 4) AS median_n FROM n GROUP BY 1")
def history_sizes(spark, d):
    return _rounded(R.history_sizes(Q.history_counts(*_history(spark, d)), _matched(spark, d)))


@query(f"""WITH {_HISTORY}, m AS (SELECT lot_id, 'org ' || (lot_id % 97 + 1) AS k FROM lots WHERE lot_id % 5 < 3),
x AS (SELECT m.lot_id, bool_or(current) AS now, bool_or(NOT current) AS gone FROM m JOIN hist h USING (lot_id) WHERE contains(m.k, h.key) OR contains(h.key, m.k) GROUP BY 1)
SELECT (SELECT count(*) FROM m) AS lots, count(*) AS in_all, count(*) FILTER (now) AS in_now, count(*) FILTER (gone) AS in_gone FROM x""")
def history_overlap(spark, d):
    claims = _claims(spark, d).withColumn("company", F.get(C.split_pipe("company"), F.lit(0)))
    return Q.history_overlap(claims, *_history(spark, d))


@query(f"WITH {_BEST.replace('i <= 5', 'i <= 3')} SELECT lot_id, snapshot_label, CASE WHEN confidence = 'high' THEN company ELSE company_preview END AS company, CASE WHEN confidence = 'high' THEN usage ELSE usage_preview END AS usage, confidence, n, after_days::INTEGER AS after_days FROM conf")
def likely_usage(spark, d):
    return M.likely_usage_of(_best(spark, d, 3))


@query(f"WITH {_BEST} SELECT rk.lot_id, rk.snapshot_label, rk.org_id, rk.r::INTEGER AS rank FROM rk JOIN conf c ON c.lot_id = rk.lot_id AND c.snapshot_label = rk.snapshot_label WHERE c.confidence IN ('high', 'medium')")
def top_candidates(spark, d):
    return Q.top_in_reach(M.eligible_lots(lots(spark, d)), M.new_orgs(snapshots(spark, d))).select("lot_id", "snapshot_label", "org_id", "rank")


@query(f"WITH {_CAND}, f AS (SELECT org_id, min(snapshot_date) AS first_seen FROM snaps GROUP BY 1) SELECT lot_id, snapshot_label, org_id FROM cand JOIN f USING (org_id) WHERE first_seen >= sale_date")
def candidates_unseen_before(spark, d):
    return Q.unseen_in_reach(M.eligible_lots(lots(spark, d)), M.new_orgs(snapshots(spark, d)), snapshots(spark, d)).select("lot_id", "snapshot_label", "org_id")


@query()
def baseline_matches(spark, d):
    """Best snapshot 180 to 365 days after the sale; names are compared by similarity, which SQL lacks."""
    return Q.baseline_matches(M.eligible_lots(lots(spark, d)), M.new_orgs(snapshots(spark, d)), snapshots(spark, d)).select("lot_id", "snapshot_label", "company", "confidence", "n")


_LIMITS = [("Аптеки", 20.0, 120.0)]
_FIRST = [("org 1", )]
_BAD = "(usage = 'Аптеки' AND (area < 20 OR area > 120)) OR (floor = 'подвал' AND contains(lower(company), 'org 1'))"


def _rules(spark):
    return spark.createDataFrame(_LIMITS, "category string, area_lo double, area_hi double"), spark.createDataFrame(_FIRST, "chain string")


def _floors(spark, d):
    return lots(spark, d).withColumn("floor", F.when(F.col("lot_id") % 3 == 0, "подвал").otherwise("1"))


@query(f"WITH {_CAND}, x AS (SELECT c.*, l.area, CASE WHEN c.lot_id % 3 = 0 THEN 'подвал' ELSE '1' END AS floor FROM cand c JOIN lots l USING (lot_id)) SELECT lot_id, snapshot_label, org_id, CASE WHEN usage = 'Аптеки' AND (area < 20 OR area > 120) THEN 'area' WHEN floor = 'подвал' AND contains(lower(company), 'org 1') THEN 'floor' END AS reason FROM x")
def candidate_reasons(spark, d):
    return Q.candidate_reasons(M.eligible_lots(_floors(spark, d)), M.new_orgs(snapshots(spark, d)), *_rules(spark)).select("lot_id", "snapshot_label", "org_id", "reason")


_FAR = _BEST.replace("BETWEEN 0 AND 365", "BETWEEN 181 AND 900").replace("cand AS (SELECT * FROM cand0 WHERE distance_m <= 250)", f"cand AS (SELECT * FROM (SELECT c.*, l.area, CASE WHEN c.lot_id % 3 = 0 THEN 'подвал' ELSE '1' END AS floor FROM cand0 c JOIN lots l USING (lot_id) WHERE distance_m <= 250 AND c.lot_id % 5 > 2))")
_NO_ROOM = "usage = 'Аптеки' AND (area < 20 OR area > 120)"


@query(f"""WITH {_FAR}, near AS (SELECT lot_id, snapshot_label, n, after_days, CASE WHEN band IN ('0-30m', '30-100m') THEN confidence WHEN band = '100-250m' THEN 'low' END AS c0 FROM one),
valid AS (SELECT c.*, r FROM cand c JOIN near USING (lot_id, snapshot_label) JOIN (SELECT lot_id, snapshot_label, company, org_id, r FROM rk) USING (lot_id, snapshot_label, company, org_id) WHERE NOT coalesce({_NO_ROOM}, false)),
v AS (SELECT lot_id, company AS x, min(r) AS r, count(*) AS k FROM valid GROUP BY 1, 2), vn AS (SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY r) AS i FROM v),
vs AS (SELECT lot_id, string_agg(x, ' | ' ORDER BY r) FILTER (i <= 3) AS company, string_agg(x, ' | ' ORDER BY r) FILTER (i <= 5) AS company_preview FROM vn GROUP BY 1)
SELECT lot_id, snapshot_label, company, company_preview, n, CASE WHEN c0 = 'high' AND after_days > 365 THEN 'medium' ELSE c0 END AS confidence, 'first_after_snapshot_' || snapshot_label AS time_window FROM near JOIN vs USING (lot_id) WHERE c0 IS NOT NULL""")
def recovered_matches(spark, d):
    taken = _matched(spark, d).where("lot_id % 5 < 3 AND confidence IS NOT NULL").select("lot_id")
    free = M.eligible_lots(_floors(spark, d)).join(taken, "lot_id", "left_anti")
    out = Q.recover(free, M.new_orgs(snapshots(spark, d)), *_rules(spark))
    return out.select("lot_id", "snapshot_label", "company", "company_preview", "n", "confidence", "time_window")


_REVIEW = f"""{_BEST}, p AS (SELECT o.lot_id, unnest(string_split(company_preview, ' | ')) AS company, unnest(string_split(usage_preview, ' | ')) AS usage, generate_subscripts(string_split(company_preview, ' | '), 1) AS pos, len(string_split(company_preview, ' | ')) AS len FROM one o),
z AS (SELECT o.lot_id, i AS pos, string_split(company_preview, ' | ')[i] AS company, string_split(usage_preview, ' | ')[i] AS usage FROM one o, range(1, 6) t(i) WHERE i <= len(string_split(company_preview, ' | '))),
w AS (SELECT z.*, area, CASE WHEN z.lot_id % 3 = 0 THEN 'подвал' ELSE '1' END AS floor FROM z JOIN lots USING (lot_id)),
k AS (SELECT * FROM w WHERE NOT coalesce({_BAD}, false)), kc AS (SELECT lot_id, company, min(pos) AS pos FROM k GROUP BY 1, 2), kr AS (SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY pos) AS i FROM kc),
kp AS (SELECT lot_id, string_agg(company, ' | ' ORDER BY pos) AS companies FROM kr WHERE i <= 3 GROUP BY 1), kb AS (SELECT lot_id, arg_min(company, pos) AS company FROM k GROUP BY 1)"""


@query(f"WITH {_REVIEW} SELECT o.lot_id, kb.company, kp.companies AS company_preview, CASE WHEN kb.company IS NOT NULL THEN o.confidence END AS confidence FROM one o LEFT JOIN kb ON kb.lot_id = o.lot_id LEFT JOIN kp ON kp.lot_id = o.lot_id")
def revalidated_matches(spark, d):
    best = M.best_per_lot(_best(spark, d)).select("lot_id", "company", "usage", "company_preview", "usage_preview", "confidence")
    return M.revalidate(best, _floors(spark, d), *_rules(spark))[0].select("lot_id", "company", "company_preview", "confidence")


@query(f"WITH {_REVIEW} SELECT CASE WHEN usage = 'Аптеки' AND (area < 20 OR area > 120) THEN 'area' ELSE 'floor' END AS reason, count(*) AS n FROM w WHERE coalesce({_BAD}, false) GROUP BY 1")
def revalidation_reasons(spark, d):
    best = M.best_per_lot(_best(spark, d)).select("lot_id", "company", "usage", "company_preview", "usage_preview", "confidence")
    return M.revalidate(best, _floors(spark, d), *_rules(spark))[1]


@query(f"""WITH {_BUYOUT}, {_HISTORY.removeprefix(LOTS + ', ' + SNAPSHOTS + ', ')}, own AS (SELECT DISTINCT lot_id FROM hist WHERE lot_id % 11 != 0),
t AS (SELECT b.lot_id, b.name, b.usage, b.distance_m FROM (SELECT b.*, l.area, CASE WHEN b.lot_id % 3 = 0 THEN 'подвал' ELSE '1' END AS floor, b.name AS company FROM buy b JOIN lots l USING (lot_id) JOIN own USING (lot_id)) b WHERE NOT coalesce({_BAD}, false)),
tn AS (SELECT lot_id, name, row_number() OVER (PARTITION BY lot_id ORDER BY distance_m, name) AS i FROM t), tu0 AS (SELECT lot_id, usage, min((distance_m, name)) AS o FROM t GROUP BY 1, 2), tu AS (SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY o) AS i FROM tu0),
g AS (SELECT lot_id, string_agg(name, ' | ' ORDER BY i) AS company FROM tn WHERE i <= 10 GROUP BY 1), gu AS (SELECT lot_id, string_agg(usage, ' | ' ORDER BY i) AS usage FROM tu WHERE i <= 10 GROUP BY 1)
SELECT l.lot_id, CASE WHEN lot_id % 5 < 2 THEN 'old' ELSE g.company END AS company, CASE WHEN lot_id % 5 < 2 THEN 'use' ELSE gu.usage END AS usage, CASE WHEN lot_id % 5 < 2 THEN 'seen' ELSE coalesce(g.company, 'stale') END AS company_preview,
CASE WHEN lot_id % 5 = 0 THEN 'high' WHEN lot_id % 5 = 1 THEN 'medium' WHEN g.company IS NOT NULL THEN 'existing_tenant' END AS confidence,
CASE WHEN lot_id % 5 < 2 THEN '180-365d' WHEN g.company IS NOT NULL THEN 'existing_tenant_buyout' END AS time_window FROM lots l LEFT JOIN g USING (lot_id) LEFT JOIN gu USING (lot_id)""")
def merged_tenants(spark, d):
    k = F.col("lot_id")
    some = lambda x: F.when(k % 5 < 2, x)
    old = lots(spark, d).select("lot_id", some(F.lit("old")).alias("company"), some(F.lit("use")).alias("usage"), some(F.when(k % 5 == 0, "high").otherwise("medium")).alias("confidence"), some((k % 300).cast("int")).alias("after_days"), some(F.lit("180-365d")).alias("time_window"), F.when(k % 5 < 2, "seen").otherwise("stale").alias("company_preview"))
    history = Q.class_history(lots(spark, d).where("lot_id % 11 != 0").select("lot_id", "address_canon", "lat", "lon"), snapshots(spark, d))[0]  # every eleventh lot has none at its address
    out = Q.merge_tenants(old, _floors(spark, d), history, snapshots(spark, d), *_rules(spark))
    return out.select("lot_id", "company", "usage", "company_preview", "confidence", "time_window")


@query(f"""WITH {LOTS}, o AS (SELECT lot_id, CASE WHEN lot_id % 4 < 3 AND lot_id % 4 != 2 THEN CASE lot_id % 4 WHEN 0 THEN 'high' ELSE 'medium' END END AS c, CASE WHEN lot_id % 4 = 1 THEN '0-180d_recent_x' WHEN lot_id % 4 = 0 THEN '180-365d' END AS w FROM lots),
b AS (SELECT lot_id, CASE WHEN w = '0-180d_recent_x' THEN NULL ELSE c END AS c, CASE WHEN w = '0-180d_recent_x' THEN NULL ELSE w END AS w FROM o), n AS (SELECT lot_id, CASE lot_id % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS c FROM lots WHERE lot_id % 3 < 2)
SELECT b.lot_id, coalesce(b.c, n.c) AS confidence, CASE WHEN b.c IS NULL AND n.c IS NOT NULL THEN 'new ' || b.lot_id WHEN b.c IS NOT NULL THEN 'old ' || b.lot_id END AS company, CASE WHEN b.c IS NULL AND n.c IS NOT NULL THEN '0-180d_recent_x' ELSE b.w END AS time_window, CASE WHEN b.c IS NOT NULL THEN 'baseline' WHEN n.c IS NOT NULL THEN 'recent' END AS source FROM b LEFT JOIN n USING (lot_id)""")
def merged_recent(spark, d):
    k, ids = F.col("lot_id"), lots(spark, d).select("lot_id")
    name = lambda p: F.concat(F.lit(p + " "), k.cast("string"))
    old = ids.select("lot_id", F.when(k % 4 < 2, name("old")).alias("company"), F.lit(None).cast("string").alias("usage"), F.when(k % 4 == 0, "high").when(k % 4 == 1, "medium").alias("confidence"), F.lit(1).alias("after_days"), F.when(k % 4 == 1, "0-180d_recent_x").when(k % 4 == 0, "180-365d").alias("time_window"))
    recent = ids.select("lot_id", name("new").alias("company"), F.lit(None).cast("string").alias("usage"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low").alias("confidence"), F.lit(2).alias("after_days"))
    return M.merge_recent(old, recent, "0-180d_recent_x").select("lot_id", "confidence", "company", "time_window", "source")


@query(f"WITH {_MATCHED} SELECT lot_id, CASE WHEN NOT (area < 40 AND confidence IS NOT NULL) THEN company END AS company, CASE WHEN NOT (area < 40 AND confidence IS NOT NULL) THEN confidence END AS confidence, area FROM mk")
def cleared_matches(spark, d):
    x = _matched(spark, d)
    return M.clear_matches(x, (F.col("area") < 40) & F.col("confidence").isNotNull(), ["company", "confidence"]).select("lot_id", "company", "confidence", "area")


@query("SELECT DISTINCT lower(p_brand) AS chain FROM part WHERE p_size % 5 IN (0, 1)")
def first_floor_chains(spark, d):
    floors = F.array(*[F.lit(x) for x in ("1 этаж", "Первый этаж", "1 этаж, подвал", "2 этаж", "цоколь")])[(F.col("p_size") % 5).cast("int")]
    return M.first_floor_chains(table(spark, d, "part").select(F.concat(F.lit(" "), F.col("p_brand")).alias("name"), floors.alias("floor")))


# Joins onto lots


@query(f"WITH {LOTS}, p AS (SELECT l_orderkey AS lot_id, count(*) AS participants FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1) SELECT lot_id, p.participants FROM lots LEFT JOIN p USING (lot_id)")
def lot_participants(spark, d):
    """Bidder counts of protocols onto lots; lots without a protocol stay."""
    p = table(spark, d, "lineitem").where("l_linenumber <= 4").groupBy(F.col("l_orderkey").alias("lot_id")).agg(F.count("*").alias("participants"))
    return L.add_by_key(lots(spark, d).select("lot_id"), p, "lot_id")


@query(f"WITH {LISTINGS}, e AS (SELECT url, arg_max(event_type, ts) AS entrance FROM (SELECT user_id AS url, event_type, ts FROM events WHERE event_type != 'purchase') GROUP BY 1) SELECT url, e.entrance AS entrance FROM listings LEFT JOIN e USING (url)")
def listing_entrances(spark, d):
    """Newest scraped entrance onto listings, by URL."""
    seen = table(spark, d, "events").where("event_type != 'purchase'").groupBy(F.col("user_id").alias("url")).agg(F.max_by("event_type", "ts").alias("entrance"))
    return L.add_by_key(listings(spark, d).select("url"), seen, "url")


@query(f"WITH {POINTS}, s AS (SELECT c_custkey AS lot_id, c_custkey % 7 AS chains_n, 'cat ' || (c_custkey % 7) AS categories FROM customer WHERE c_custkey % 7 > 2) SELECT lot_id, coalesce(chains_n, 0) AS chains_n, coalesce(categories, '') AS categories FROM points LEFT JOIN s USING (lot_id)")
def lot_chain_columns(spark, d):
    """Chain summary onto lots; lots without a chain get 0 and an empty text."""
    k = F.col("c_custkey")
    s = table(spark, d, "customer").where(k % 7 > 2).select(k.alias("lot_id"), (k % 7).alias("chains_n"), F.concat(F.lit("cat "), (k % 7).cast("string")).alias("categories"))
    return L.add_by_key(points(spark, d).select("lot_id"), s, "lot_id", {"chains_n": 0, "categories": ""})


# Lots


@query(f"WITH {LOTS} SELECT lot_id, coalesce(bidders >= 2 AND final_price IS NULL, false) AS evasion, bidders IS NULL AS no_bids, coalesce(bidders = 1 AND final_price IS NULL, false) AS one_bidder_no_price FROM lots")
def evasion_flags(spark, d):
    return L.evasion_flags(lots(spark, d)).select("lot_id", "evasion", "no_bids", "one_bidder_no_price")


@query(f"WITH {LOTS}, f AS (SELECT lot_id, area, start_price / area AS p, (lot_id % 15)::INTEGER AS walk, (lot_id % 12)::DOUBLE AS km FROM lots) SELECT lot_id, round(ln(1 + area), 6) AS log_area, round(ln(1 + p), 6) AS log_price_m2, round(area / (walk + 1), 6) AS area_per_metro, round(p * km, 4) AS price_density, area < 50 AS is_small_area, km < 5 AS is_center, CASE WHEN walk <= 5 THEN '0-5' WHEN walk <= 10 THEN '5-10' ELSE '10+' END AS metro_zone FROM f")
def lot_features(spark, d):
    k = F.col("lot_id")
    x = lots(spark, d).select("lot_id", "area", (F.col("start_price") / F.col("area")).alias("price_m2"), (k % 15).cast("int").alias("walk_min"), (k % 12).cast("double").alias("km_centre"))
    out = L.lot_features(x)
    return out.select("lot_id", *[r(c, n).alias(c) for c, n in (("log_area", 6), ("log_price_m2", 6), ("area_per_metro", 6), ("price_density", 4))], "is_small_area", "is_center", "metro_zone")


@query(f"WITH {LOTS} SELECT lot_id FROM lots WHERE (bidders IS NULL OR bidders BETWEEN 2 AND 5) AND trade_form IN ('1-URGENT', '5-LOW') AND area BETWEEN 20 AND 120")
def filtered_lots(spark, d):
    return L.filter_lots(lots(spark, d), bidders=(2, 5), trade_form=["1-URGENT", "5-LOW"], area=(20, 120)).select("lot_id")


@query(f"WITH {LOTS} SELECT lot_id, sale_date FROM lots WHERE year(sale_date) IN (1996, 1998) AND sale_date < DATE '1998-06-01'")
def completed_lots(spark, d):
    return L.completed_lots(lots(spark, d), [1996, 1998], "1998-06-01 00:00:00", "sale_date").select("lot_id", "sale_date")


@query(f"WITH {LISTINGS}, x AS (SELECT url, l_area AS area, l_price / l_area AS price_m2, CASE url % 6 WHEN 0 THEN 'Здание' WHEN 1 THEN 'Офисное помещение' WHEN 2 THEN NULL ELSE 'Торговое помещение' END AS type, url % 11 = 0 AS lost FROM listings) SELECT url, area, round(price_m2, 4) AS price_m2 FROM x WHERE NOT lost AND price_m2 BETWEEN 500 AND 30000 AND area >= 15 AND type IS DISTINCT FROM 'Здание'")
def clean_listings(spark, d):
    k = F.col("url")
    x = listings(spark, d, "").withColumn("type", F.when(k % 6 == 0, "Здание").when(k % 6 == 1, "Офисное помещение").when(k % 6 == 2, F.lit(None)).otherwise("Торговое помещение")).withColumn("lat", F.when(k % 11 != 0, F.col("lat")))
    return L.clean_listings(x, lo=500, hi=30_000).select("url", "area", r("price_m2").alias("price_m2"))


@query(f"WITH {POINTS} SELECT lot_id, round((800 + lot_id % 900) * area * 12 * 6, 4) AS price_at_payback, coalesce(CASE WHEN lot_id % 8 > 0 THEN lot_id % 8 END < 3, true) AS low_liquidity FROM points")
def payback_prices(spark, d):
    k = F.col("lot_id")
    x = points(spark, d).withColumn("rent_m2", (800 + k % 900).cast("double")).withColumn("analogues", F.when(k % 8 > 0, k % 8))
    return L.liquidity_flag(L.price_at_payback(x)).select("lot_id", r("price_at_payback").alias("price_at_payback"), "low_liquidity")


_PAST = f"past AS (SELECT p_partkey AS past_id, (p_size * 5)::DOUBLE AS l_area, p_size::DOUBLE AS bidders, p_retailprice AS excess_pct, (p_partkey % 4)::VARCHAR AS l_floor, {LISTINGS.split('(p_partkey % 3)::VARCHAR AS l_entrance, ')[1].rsplit(' FROM', 1)[0]} FROM part)"


@query(f"WITH {POINTS}, {_PAST}, x AS (SELECT *, {sql_metres('lat', 'lon', 'l_lat', 'l_lon')} AS m FROM points, past) SELECT lot_id, count(*) AS similar, round(avg(bidders), 4) AS mean_bidders, round(median(excess_pct), 4) AS median_excess FROM x WHERE m <= 2000 AND l_area BETWEEN area * 0.7 AND area * 1.3 GROUP BY 1")
def competition(spark, d):
    """Bidders and excess of look-alike past lots in reach."""
    past = listings(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("url"), F.col("p_size").cast("double").alias("bidders"), F.col("p_retailprice").alias("excess_pct")), "url")
    return _rounded(L.competition(points(spark, d), past.select(F.col("url").alias("past_id"), "l_area", "l_lat", "l_lon", "bidders", "excess_pct"), 2000, 0.3))


@query(f"WITH {POINTS}, {LISTINGS}, x AS (SELECT *, {sql_metres('lat', 'lon', 'l_lat', 'l_lon')} AS m FROM points, listings), g AS (SELECT lot_id, sum(l_area) AS residents FROM x WHERE m <= 500 GROUP BY 1) SELECT lot_id, coalesce(residents, 0)::DOUBLE AS residents, coalesce(residents, 0) >= 400 AS has_audience FROM points LEFT JOIN g USING (lot_id)")
def audiences(spark, d):
    """Whether enough residents live within 500 m."""
    return L.audience(points(spark, d), listings(spark, d), "l_area", 400, right_at=("l_lat", "l_lon")).select("lot_id", "residents", "has_audience")


@query(f"""WITH {POINTS}, s AS (SELECT lot_id, area, CASE lot_id % 4 WHEN 0 THEN '1 этаж' WHEN 1 THEN 'Подвал' WHEN 2 THEN 'Цоколь' END AS fl, CASE lot_id % 5 WHEN 0 THEN 'street' WHEN 1 THEN 'hallway' WHEN 2 THEN 'common' WHEN 3 THEN 'shared' ELSE '' END AS e FROM points),
x AS (SELECT lot_id, [area <= 60, area BETWEEN 40 AND 140 AND e = 'street', area >= 80, area >= 120 AND fl IS DISTINCT FROM 'Подвал', area >= 200, coalesce(fl IN ('Подвал', 'Цоколь'), false), area <= 120 AND e IN ('hallway', 'common', 'shared'), area BETWEEN 60 AND 200, area >= 90, area > 250, true, true, true, true, true] AS ok FROM s),
u AS (SELECT lot_id, list_filter(list_zip(ok, [{', '.join("'" + u + "'" for u in [*V.USES, *V.GENERAL_USES, V.FILLER_USE])}]), lambda z: z[1]) AS z FROM x) SELECT lot_id, array_to_string(list_transform(z, lambda y: y[2])[1:5], '; ') AS suggestions FROM u""")
def use_suggestions(spark, d):
    k = F.col("lot_id")
    entrance = F.array(*[F.lit(x) for x in ("Отдельный вход", "Вход через подъезд", "Вход через места общего пользования", "Вход через иную собственность", "иное")])[(k % 5).cast("int")]
    x = points(spark, d).withColumn("floor_label", F.when(k % 4 == 0, "1 этаж").when(k % 4 == 1, "Подвал").when(k % 4 == 2, "Цоколь")).withColumn("entrance", entrance)
    return L.use_suggestions(x).select("lot_id", F.array_join("suggestions", "; ").alias("suggestions"))


# Sets, counts, coverage


@query("SELECT count(*) AS in_both FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)")
def ids_in_both(spark, d):
    a = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))
    return A.in_both(a, table(spark, d, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("id")), "id").agg(F.count("*").alias("in_both"))


@query("SELECT id FROM (SELECT s_suppkey AS id FROM supplier UNION SELECT p_partkey FROM part WHERE p_size > 40 UNION SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)")
def known_ids(spark, d):
    """Ids of several sources, each once."""
    ids = [table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), table(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("id")), table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("id"))]
    return A.union_all(*ids).distinct()


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10) ORDER BY 1 LIMIT 100")
def next_unresolved(spark, d):
    """The first hundred keys that have no answer yet."""
    every = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return A.first_remaining(every, table(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("id")), "id", 100)


@query(f"WITH {LOTS} SELECT year(sale_date)::INTEGER AS year, count(*) AS lots, count(*) FILTER (lot_id % 6 != 0) AS located, round(count(*) FILTER (lot_id % 6 != 0) * 100.0::DOUBLE / count(*), 4) AS located_pct FROM lots GROUP BY 1")
def geocode_coverage(spark, d):
    return _rounded(R.geocode_coverage(lots(spark, d).withColumn("lat", F.when(F.col("lot_id") % 6 != 0, F.col("lat")))))


@query("WITH p AS (SELECT l_orderkey, count(*) FILTER (l_quantity > 20)::INTEGER AS c, max(CASE WHEN l_discount > 0.08 THEN l_extendedprice END) AS w FROM lineitem GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (c > 0) AS with_bidders, count(w) AS with_price, round(avg(c), 4) AS mean, round(median(c), 4) AS median, min(c) AS min, max(c) AS max FROM p")
def protocol_tallies(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 20).cast("int").alias("participants_count"), F.max(F.when(F.col("l_discount") > 0.08, F.col("l_extendedprice"))).alias("winner_price_num"))
    return _rounded(R.protocol_tallies(p))


@query("SELECT year(l_shipdate)::INTEGER AS year, count(*) AS n FROM lineitem GROUP BY 1")
def lines_per_year(spark, d):
    return R.per_year(table(spark, d, "lineitem"), "l_shipdate")


@query(f"WITH {LOTS} SELECT round_even(round_even(deposit / start_price * 100, 1), 0)::INTEGER AS deposit_pct, count(*) AS n, count(*) FILTER (bidders >= 2 AND final_price IS NULL) AS evaded_n, round(count(*) FILTER (bidders >= 2 AND final_price IS NULL) * 100.0::DOUBLE / count(*), 4) AS evasion_pct FROM lots WHERE round_even(deposit / start_price * 100, 1) <= 30 GROUP BY 1 HAVING count(*) >= 5")
def evasion_by_percent(spark, d):
    return _rounded(R.evasion_by_percent(L.evasion_flags(lots(spark, d))))


@query(f"WITH {_MATCHED} SELECT year(sale_date)::INTEGER AS year, trade_form, count(*) AS n, round(count(*) FILTER (match_class != 'not_found') * 100.0::DOUBLE / count(*), 4) AS tenant_pct FROM mk GROUP BY 1, 2")
def form_years(spark, d):
    return _rounded(R.form_years(_matched(spark, d)))


@query(f"WITH {LOTS}, q AS (SELECT quantile_cont(start_price, 0.99) AS cap FROM lots), x AS (SELECT log10(start_price) AS v FROM lots, q WHERE start_price > 0 AND start_price <= cap), b AS (SELECT min(v) AS lo, max(v) AS hi FROM x) SELECT least(floor((v - lo) / ((hi - lo) / 50)), 49)::INTEGER AS bin, count(*) AS n FROM x, b GROUP BY 1")
def log_price_histogram(spark, d):
    return A.log_histogram(lots(spark, d), "start_price", 50, 0.99)


@query(f"WITH {LISTINGS}, x AS (SELECT l_entrance AS entrance, l_price AS price FROM listings) SELECT entrance, count(*) AS n, round(quantile_cont(price, 0.25), 4) AS p25, round(median(price), 4) AS p50, round(quantile_cont(price, 0.75), 4) AS p75 FROM x GROUP BY 1")
def entrance_quartiles(spark, d):
    return _rounded(R.quartiles(listings(spark, d, ""), ["entrance"], "price"))


@query(f"WITH {LOTS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, '{t}' AS type, (SELECT {c}::VARCHAR FROM lots WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode" for c, t in (("bidders", "bigint"), ("district", "string"), ("trade_form", "string"))))
def column_modes(spark, d):
    return A.modes(lots(spark, d), ["bidders", "district", "trade_form"])


_ARRIVALS = """a AS (SELECT event_id, user_id, ts, value, CASE WHEN event_id % 17 = 0 THEN 3 ELSE date_diff('day', (SELECT min(ts) FROM events), ts) // 10 END AS batch FROM events),
top AS (SELECT batch, max(ts) AS top FROM a GROUP BY 1), mark AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS top FROM top)"""


def _arrivals(spark, d):
    """Events in four batches of ten days each; every seventeenth comes with the last one."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    first = e.agg(F.min("ts")).first()[0]
    day = F.datediff("ts", F.lit(first))
    return e.withColumn("batch", F.when(F.col("event_id") % 17 == 0, 3).otherwise(F.floor(day / 10)).cast("int"))


def _replayed(spark, d):
    from auctra.streaming import feeds
    from auctra.tables import new_folder

    rows = _arrivals(spark, d)
    folder = new_folder(spark, "replay")
    feeds.write_arrivals(rows, "batch", f"{folder}/feed")
    return feeds.replayed(spark, f"{folder}/feed", rows.drop("batch").schema), folder


@query(f"""WITH {_ARRIVALS}, k AS (SELECT a.*, date_trunc('day', ts) AS start FROM a JOIN mark USING (batch) WHERE mark.top IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark.top - INTERVAL 2 DAY)
SELECT start, count(*) AS n, round(avg(value), 4) AS mean FROM k GROUP BY 1""")
def daily_feed_stream(spark, d):
    """Daily counts of a replayed stream; rows that come after the watermark has passed their day are dropped."""
    from auctra.streaming import feeds

    stream, folder = _replayed(spark, d)
    out, _ = feeds.run_once(feeds.windowed_counts(stream), "update", f"{folder}/out", f"{folder}/checkpoint")
    return feeds.latest(out, ["start"]).withColumn("mean", r("mean"))


@query(f"""WITH {_ARRIVALS}, k AS (SELECT a.* FROM a JOIN mark USING (batch) WHERE mark.top IS NULL OR ts > mark.top - INTERVAL 40 DAY) SELECT user_id, min(batch)::INTEGER AS first_batch FROM k GROUP BY 1""")
def dedup_feed(spark, d):
    """The first batch in which a replayed stream shows each object."""
    from auctra.streaming import feeds

    stream, folder = _replayed(spark, d)
    out, _ = feeds.run_once(feeds.dedup_stream(stream, key="user_id", delay="40 days"), "append", f"{folder}/out", f"{folder}/checkpoint")
    return out.select("user_id", F.col("batch_id").alias("first_batch"))
