"""Registered queries of the column rules: texts are played from the given tables, the oracles hold the expected values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auctra.functions import columns as C
from auctra.functions import vocab as V
from auctra.functions.geo import cell_rounded
from auctra.operators import lots as L
from auctra.operators import matching as M
from auctra.plans.given import LISTINGS, POINTS, listings, points, table
from auctra.plans.queries import query, r


def _pick(k: Column, values: list) -> Column:
    """The value at k modulo the number of values."""
    return F.array(*[F.lit(x) for x in values])[(k % len(values)).cast("int")]


def _sql(k: str, values: list) -> str:
    quote = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"[{', '.join(map(quote, values))}][{k} % {len(values)} + 1]"


def _expected(k: str, **columns: list) -> str:
    return ", ".join(f"{_sql(k, v)} AS {c}" for c, v in columns.items())


# Numbers and dates


@query("SELECT o_orderkey, o_totalprice::DECIMAL(15, 2)::DOUBLE AS number, o_totalprice::DECIMAL(15, 2)::DOUBLE AS money, (o_orderkey % 100 + 0.5)::DOUBLE AS percent FROM orders")
def number_texts(spark, d):
    """Numbers, amounts and percents written with commas, blanks and units, read back."""
    comma = F.replace(F.format_string("%.2f", F.col("o_totalprice")), F.lit("."), F.lit(","))
    grouped = F.replace(F.replace(F.format_number("o_totalprice", 2), F.lit(","), F.lit(" ")), F.lit("."), F.lit(","))
    percent = F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit(",5 %"))
    return table(spark, d, "orders").select("o_orderkey", C.to_double(F.concat(F.lit(" "), comma)).alias("number"), C.to_money(F.concat(grouped, F.lit(" руб."))).alias("money"), C.to_percent(percent).alias("percent"))


@query("SELECT o_orderkey, o_orderdate::DATE AS day, o_orderdate::DATE AS iso_day, last_day(o_orderdate::DATE) AS snapshot, year(o_orderdate)::INTEGER AS ts_year, 10 AS ts_hour, CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate)::INTEGER ELSE 2021 END AS trade_year, (last_day(o_orderdate::DATE) - o_orderdate::DATE)::INTEGER AS after_days FROM orders")
def date_texts(spark, d):
    """Dates in several spellings, read back."""
    day = F.col("o_orderdate").cast("date")
    iso = F.date_format(day, "yyyy-MM-dd")
    label = C.snapshot_date(F.date_format(day, "yyyy-MM"))
    ts = C.parse_iso_ts(F.concat(iso, F.lit("T10:00:00.1234567Z")))
    return table(spark, d, "orders").select(
        "o_orderkey", C.parse_date(F.concat(F.date_format(day, "dd.MM.yyyy"), F.lit(" 12:30"))).alias("day"), C.parse_date(iso).alias("iso_day"), label.alias("snapshot"), F.year(ts).alias("ts_year"), F.hour(ts).alias("ts_hour"),
        C.trade_year(iso, F.lit("торги 2021 года")).alias("trade_year"), C.after_days(day, label).alias("after_days"),
    )


# Floors, entrances, purposes

_RAW_FLOORS = ["подвал", "-1", "1", "1, 2", "подвал, 0", "1, 1", "2 этаж и выше", "антресоль", "7", "0", "", None]
_RAW_LEVELS = ["цокольный", "-1", "1", "2", "9", "подвал, 1", "мезонин", "4", None]


@query(f"""SELECT p_partkey, {_expected("p_partkey", split=["Подвал", "Подвал", "1 этаж", "Многоуровневый", "Подвал", "1 этаж", "Многоуровневый", "Антресоль", "5+ этаж", "0 этаж", "Не указано", "Не указано"],
    any_comma=["Подвал", "Подвал", "1 этаж", "Многоуровневый", "Многоуровневый", "Многоуровневый", "Многоуровневый", "Антресоль", "5+ этаж", "0 этаж", "Не указано", "Не указано"])} FROM part""")
def floor_texts(spark, d):
    raw = _pick(F.col("p_partkey"), _RAW_FLOORS)
    return table(spark, d, "part").select("p_partkey", C.floor_label(raw).alias("split"), C.floor_label(raw, "any_comma").alias("any_comma"))


@query(f"""SELECT p_partkey, {_expected("p_partkey", listing=["цоколь", "цоколь", "1", "2", "3+", "подвал, 1", "мезонин", "3+", None], lot=["цоколь", "цоколь", "1", "2", "3+", "цоколь", "1", "3+", None],
    fine=["цоколь", "1 этаж", "1 этаж", "2 этаж", "6+ этажи", "подвал", "unknown", "4-5 этажи", "unknown"], coarse=["Цоколь", "3+ этаж", "1 этаж", "2 этаж", "3+ этаж", "Подвал", "3+ этаж", "3+ этаж", "Не указан"])} FROM part""")
def floor_groups(spark, d):
    raw = _pick(F.col("p_partkey"), _RAW_LEVELS)
    return table(spark, d, "part").select("p_partkey", C.listing_floor(raw).alias("listing"), C.lot_floor_to_listing(raw).alias("lot"), C.floor_group(raw).alias("fine"), C.floor_group(raw, "coarse").alias("coarse"))


@query("WITH x AS (SELECT ['Подвал', 'Цоколь', '1 этаж', '5+ этаж', 'иное'] AS f), y AS (SELECT p_partkey % 5 AS k FROM part) SELECT f[k + 1] AS floor_label, count(*) AS n, [0, 1, 3, 7, 15][k + 1]::INTEGER AS place FROM x, y GROUP BY k, f ORDER BY place")
def floors_in_order(spark, d):
    """Floor labels with their counts, in the order of floors."""
    label = _pick(F.col("p_partkey"), ["Подвал", "Цоколь", "1 этаж", "5+ этаж", "иное"])
    counts = table(spark, d, "part").groupBy(label.alias("floor_label")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", C.floor_sort_key("floor_label")).orderBy("place")


@query(f"""SELECT s_suppkey, {_expected("s_suppkey", entrance=["отдельный с улицы", "через холл", None, "общий со двора"], lot=[None, None, "отдельный с улицы", None], shown=["separateFromStreet", "Через холл", "Отдельный", "commonFromYard"],
    separate=[True, False, False, False], common=[False, True, False, False])}, {_expected("s_suppkey", object_type=["Помещение свободного назначения", "Торговое помещение", None], object_class=["flex", "other", "office"])} FROM supplier""")
def entrance_texts(spark, d):
    k = F.col("s_suppkey")
    raw, purpose = _pick(k, ["separateFromStreet", "Через холл", "nsi:1032:103201", "commonFromYard"]), _pick(k, ["Свободное", "бытовые услуги", "офисный зал"])
    separate, common = C.entrance_flags(C.entrance_label(raw))
    return table(spark, d, "supplier").select("s_suppkey", C.entrance_label(raw).alias("entrance"), C.lot_entrance(raw).alias("lot"), C.entrance_display(raw).alias("shown"), separate.alias("separate"), common.alias("common"), C.lot_object_type(purpose).alias("object_type"), C.object_class(purpose).alias("object_class"))


# Names


@query(f"""SELECT s_suppkey, {_expected("s_suppkey", company=["Ozon", "Новый магазин", "Пекарня", "Банкомат"], key=["ozon", "новый магазин", "пекарня", "банкомат"], tokens=["ozon выдачи", "новый", "пекарня елка", "банкомат банк"],
    device=[False, False, False, True], entry=["Ozon", "Новый магазин (Супермаркеты)", "Пекарня (Кафе)", "Банкомат (Банки)"], usage=["Доставка", "Супермаркеты -> Продукты", "Кафе, Пекарни -> Хлеб", "Банки"],
    chart=["Доставка", "Супермаркеты", "Кафе", "Банки"], retail=[None, "Супермаркет/Гипермаркет", "Общепит", "Банки"], alcohol=[False, False, False, False])} FROM supplier""")
def name_rules(spark, d):
    k = F.col("s_suppkey")
    name = _pick(k, ["OZON, пункт выдачи", "Новый магазин, филиал", "Пекарня (ёлка)", "Банкомат, Банк"])
    rubric, sub = _pick(k, ["Доставка", "Супермаркеты", "Кафе, Пекарни", "Банки"]), _pick(k, [None, "Продукты", "Хлеб", " "])
    company, usage = C.company_name(F.regexp_replace(name, r" \(.*", "")), C.usage_text(rubric, sub)
    return table(spark, d, "supplier").select(
        "s_suppkey", company.alias("company"), C.company_key(name).alias("key"), C.name_tokens(name).alias("tokens"), C.is_implausible(name, usage).alias("device"), C.display_entry(company, rubric).alias("entry"), usage.alias("usage"),
        C.chart_category(usage).alias("chart"), C.retail_category(usage).alias("retail"), C.is_alcohol(name, ["винлаб"]).alias("alcohol"),
    )


@query(f"""SELECT s_suppkey, {_expected("s_suppkey", any_alcohol=[True, True, False], first_alcohol=[False, True, False], address_like=[False, True, False], device=[True, False, False], picked=["b", "a", None])} FROM supplier""")
def name_lists(spark, d):
    k = F.col("s_suppkey")
    companies = _pick(k, ["Пекарня | Винлаб (центр)", "Красное&Белое, 2 | Кафе", "Кафе | Пекарня"])
    words = ["винлаб", "красное&белое"]
    name, usage = _pick(k, ["Пункт", "Ясный переулок, 7", "Кафе"]), _pick(k, ["Постаматы", "Кафе", "Кафе"])
    rows = table(spark, d, "supplier")
    return rows.select("s_suppkey", C.is_alcohol(companies, words).alias("any_alcohol"), C.is_alcohol(companies, words, first_only=True).alias("first_alcohol"), (C.is_implausible(name, usage) & ~C.is_implausible(F.lit("x"), usage)).alias("address_like"),
                       C.is_implausible(name, usage, "revalidate").alias("device"), C.first_non_empty(_pick(k, [" ", "a", None]), _pick(k, ["b", "c", ""])).alias("picked"))


# Addresses


@query(f"""SELECT s_suppkey, 'ул. ясная|д:' || s_suppkey || '|к:2|стр:' AS key, 'ул. ясная|д:' || s_suppkey AS relaxed, 'Москва, район Северный, улица Ясная, дом ' || s_suppkey AS query, {_expected("s_suppkey", district=["ЮАО", "Неизвестно"])}, 'улица лесная ' || s_suppkey || ' корп 3' AS normal, 'лесная ' || s_suppkey || ' корп 3' AS canonical, 'Москва, ЮАО, ул. ' || s_suppkey AS address FROM supplier""")
def address_rules(spark, d):
    k = F.col("s_suppkey").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    building = text("город Москва, улица Ясная, дом ", k, ", корпус 2")
    where = _pick(F.col("s_suppkey"), ["Южный административный округ, ул. Ясная", "ул. Ясная"])
    normal = C.normalize_address(text("Российская Федерация, город Москва, ул. Лесная, д. ", k, ", корпус 3, этаж 1"))
    return table(spark, d, "supplier").select(
        "s_suppkey", C.building_key(building).alias("key"), C.building_key(building, relaxed=True).alias("relaxed"), C.geocode_query(text("город Москва, район Северный, улица Ясная, дом ", k, ", этаж 1")).alias("query"), C.district_code(where).alias("district"),
        normal.alias("normal"), C.canonical_address(normal).alias("canonical"), C.full_address(F.lit("Москва"), F.lit("ЮАО"), text("ул. ", k)).alias("address"),
    )


@query("WITH c AS (SELECT c_custkey AS k, 55.5 + (c_custkey % 7) * 0.1 AS lat FROM customer) SELECT k FROM c WHERE lat BETWEEN 55.1 AND 56.1 AND k % 3 != 1 AND k % 4 != 3")
def valid_geocodes(spark, d):
    """Geocodes of the asked house inside the city: another house, or another block where both name one, is a conflict."""
    k = F.col("c_custkey")
    text = lambda house, block: F.concat(F.lit("город Москва, улица Ясная, дом "), house.cast("string"), block)
    found = text(F.when(k % 3 == 1, k + 1).otherwise(k), _pick(k, ["", ", корпус 2", "", ", корпус 5"]))
    x = table(spark, d, "customer").select(k.alias("k"), text(k, _pick(k, [", корпус 2", "", "", ", корпус 2"])).alias("address"), found.alias("found_address"), (F.lit(55.5) + (k % 7) * 0.1).alias("lat"), F.lit(37.5).alias("lon"))
    return M.valid_geocodes(x).select("k")


@query("WITH c AS (SELECT c_custkey AS k FROM customer) SELECT k AS lot_id, CASE WHEN k % 4 = 0 THEN 'own' WHEN k % 4 = 1 THEN 'cadastral_no' WHEN k % 4 = 2 THEN 'key' ELSE 'none' END AS how, CASE WHEN k % 4 = 0 THEN 1.0 WHEN k % 4 = 1 THEN 2.0 WHEN k % 4 = 2 THEN 3.0 END::DOUBLE AS lat FROM c")
def backfilled_coordinates(spark, d):
    k = F.col("c_custkey")
    address = F.concat(F.lit("улица Ясная, дом "), k.cast("string"))
    c = table(spark, d, "customer")
    x = c.select(k.alias("lot_id"), F.concat(F.lit("c"), k.cast("string")).alias("cadastral_no"), address.alias("address"), F.when(k % 4 == 0, 1.0).alias("lat"), F.when(k % 4 == 0, 1.0).alias("lon"))
    by_number = c.where(k % 4 == 1).select((-k).alias("lot_id"), F.concat(F.lit("c"), k.cast("string")).alias("cadastral_no"), F.lit("нет").alias("address"), F.lit(2.0).alias("lat"), F.lit(2.0).alias("lon"))
    by_house = c.where(k % 4 == 2).select((-k).alias("lot_id"), F.lit(None).cast("string").alias("cadastral_no"), address.alias("address"), F.lit(3.0).alias("lat"), F.lit(3.0).alias("lon"))
    return M.backfill_coordinates(x, by_number.unionByName(by_house)).select("lot_id", "how", "lat")


# Prices and confidence


@query(f"""SELECT o_orderkey, {_expected("o_orderkey", form=["auction", "public_offer", "no_price", "other"], source=["protocol", "page", "missing"])}, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice / 2 END AS price, o_orderkey % 3 = 0 AS confirmed,
CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 0.0 END::DOUBLE AS valid, CASE WHEN o_orderkey % 2 = 0 THEN 10.0 ELSE 5.0 END::DOUBLE AS step_pct, (o_orderkey % 50 * 5)::DOUBLE AS stepped FROM orders""")
def price_rules(spark, d):
    k, total = F.col("o_orderkey"), F.col("o_totalprice")
    form = _pick(k, [V.AUCTION, V.PUBLIC_OFFER, V.NO_PRICE, "иное"])
    final = C.final_price(F.when(k % 3 == 0, total), F.when(k % 3 != 2, total / 2))
    return table(spark, d, "orders").select(
        "o_orderkey", C.trade_form_class(form).alias("form"), final["source"].alias("source"), final["price"].alias("price"), final["confirmed"].alias("confirmed"), C.valid_final_price(F.lit(0.0), form).alias("valid"),
        r(C.bid_step_pct(F.when(k % 2 == 0, total / 10), total), 6).alias("step_pct"), C.round_to_step((k % 50 * 5).cast("double") + 1.5, F.lit(5.0)).alias("stepped"),
    )


@query(f"""SELECT c_custkey, {_expected("c_custkey", label=["Высокое", "2 варианта", "Вероятный", "Действующий арендатор", "Нет"], source=["Недавние (до 180 дн.)", "Данные появления бизнеса за 2024-05", "Данные появления бизнеса за 2023-12", "Действующий арендатор (был до и после продажи)", "Без совпадения"],
    geo=["high", "low", None, "high", "low"], match_class=["new_business", "new_business", "new_business", "existing_tenant", "not_found"])} FROM customer""")
def confidence_rules(spark, d):
    k = F.col("c_custkey")
    conf, preview = _pick(k, ["high", "medium", "medium", "existing_tenant", None]), _pick(k, ["a", "a | b", "a", "a", ""])
    window = _pick(k, ["0-180d_recent_x", "gap_snapshot_2024-05", "first_after_snapshot_2023-12", "existing_tenant_buyout", None])
    rows = table(spark, d, "customer").withColumn("conf", conf)
    geo = C.geo_confidence(_pick(k, ["high", "high", "high", "high", "medium"]), _pick(k, ["0-30m", "100-250m", "250m+", "30-100m", "100-250m"]))
    return rows.select("c_custkey", C.confidence_label("conf", preview).alias("label"), C.match_source("conf", window).alias("source"), geo.alias("geo"), L.match_class("conf").alias("match_class"))


@query(f"WITH {LISTINGS} SELECT url, round(l_price / l_area, 4) AS price_m2, CASE WHEN url % 2 = 0 THEN l_area ELSE 12.5::DOUBLE END AS area, round_even(l_lat * 2000, 0)::BIGINT || '_' || round_even(l_lon * 2000, 0)::BIGINT AS place FROM listings")
def listing_fields(spark, d):
    text = F.concat(F.lit("Этаж=1|Общая площадь="), F.when(F.col("url") % 2 == 0, F.col("l_area").cast("string")).otherwise(""), F.lit("|Этаж=2"))
    return listings(spark, d).select("url", r(C.price_per_m2("l_price", "l_area")).alias("price_m2"), C.listing_area(text, F.lit("Помещение (12,5 м²)")).alias("area"), cell_rounded("l_lat", "l_lon", 2000).alias("place"))


# Nested records and pages


@query("SELECT s_suppkey, 'Ясная' || s_suppkey || ' (5 мин); Лесная' AS metro, s_suppkey::VARCHAR AS floor, s_suppkey || ' м²' AS area, CASE WHEN s_suppkey % 2 = 0 THEN '9' ELSE '7' END AS attachment, (s_suppkey * 1000)::DOUBLE AS start_price, (s_suppkey * 1500)::DOUBLE AS winner_price, 1 AS admitted, 'отдельный с улицы' AS entrance, CASE WHEN s_suppkey % 2 = 0 THEN 'pdf' ELSE 'unknown' END AS kind FROM supplier")
def page_records(spark, d):
    """Stations, named values, page fields, attachments and protocol texts, written from supplier keys and read back."""
    k = F.col("s_suppkey")
    n = k.cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    station = lambda name, time: F.struct(name.alias("subwayStationName"), time.cast("int").alias("walkingTime"))
    stations = F.array(station(text("Ясная", n), F.lit(5)), station(F.lit("Лесная"), F.lit(None)), station(F.lit(None).cast("string"), F.lit(3)))
    params = F.array(F.struct(F.lit("Площадь").alias("name"), F.lit("1").alias("value")), F.struct(F.lit("Этаж").alias("name"), text(n, " этаж").alias("value")))
    html = text("<dl><dt>Площадь</dt><dd><b>", n, "</b> м²</dd><dt>Этаж</dt><dd>1</dd></dl>")
    links = F.when(k % 2 == 0, F.lit('<a data-id="7">Приложение</a><a data-id="9">Протокол об итогах</a>')).otherwise('<a data-id="7">Протокол</a>')
    protocol = C.protocol_fields(text("Начальная цена: ", (k * 1000).cast("string"), ",00 руб. Цена, предложенная победителем ", (k * 1500).cast("string"), " руб."))
    rows = F.array(F.array(n, F.lit("Допустить")), F.array(n, F.lit("не допустить")))
    head = F.when(k % 2 == 0, F.lit("%PDF-1.7")).otherwise("text").cast("binary")
    return table(spark, d, "supplier").select(
        "s_suppkey", C.metro_text(stations).alias("metro"), C.clean_floor(C.named_value(params, "Этаж")).alias("floor"), C.page_fields(html)["Площадь"].alias("area"), C.protocol_attachment(links, ["протокол"]).alias("attachment"),
        protocol["start_price"].alias("start_price"), protocol["winner_price"].alias("winner_price"), C.admitted_count(rows, F.lit("")).alias("admitted"), C.page_entrance(F.lit('{"inputType": "separateFromStreet"}')).alias("entrance"), C.sniff_doc_type(head).alias("kind"),
    )


@query(f"WITH {POINTS} SELECT lot_id::VARCHAR AS lot_id, lat, lon FROM points WHERE lot_id % 3 != 0")
def source_coordinates(spark, d):
    k = F.col("lot_id")
    arr = F.array("lat", "lon")
    x = points(spark, d).select(k.alias("id"), F.when(k % 2 == 0, arr).alias("coords"), F.to_json(arr).alias("coordsText"), (k % 3 == 0).alias("ignoreCoords"))
    return L.source_coordinates(x)


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Школа ' || s_suppkey ELSE 'School' END AS name, 'school' AS type, 55.5::DOUBLE AS lat, 37.5::DOUBLE AS lon FROM supplier")
def schools(spark, d):
    """Elements of a map answer: a node or a centre, the name by language."""
    k = F.col("s_suppkey")
    n = k.cast("string")
    tags = F.concat(F.lit('"tags":{"amenity":"school","name:en":"School"'), F.when(k % 2 == 0, F.concat(F.lit(',"name:ru":"Школа '), n, F.lit('"'))).otherwise(""), F.lit("}"))
    at = F.when(k % 3 == 0, F.lit('"lat":55.5,"lon":37.5')).otherwise('"center":{"lat":55.5,"lon":37.5}')
    element = F.concat(F.lit('{"id":'), n, F.lit(',"type":"node",'), at, F.lit(","), tags, F.lit("}"))
    return L.schools_from_elements(table(spark, d, "supplier").select(F.concat(F.lit('{"elements":['), element, F.lit(","), element, F.lit("]}")).alias("value")))


@query("SELECT coalesce(nullif(trim(a), ''), b) AS address, c AS area FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE ' ' END AS a, CASE WHEN s_suppkey % 3 = 0 THEN 'n' || s_nationkey END AS b, s_suppkey::VARCHAR AS c FROM supplier) WHERE coalesce(nullif(trim(a), ''), b) IS NOT NULL")
def canonical_rows(spark, d):
    """Alternative headers to canonical columns; rows without an address go."""
    k = F.col("s_suppkey")
    x = table(spark, d, "supplier").select(F.when(k % 2 == 0, F.col("s_name")).otherwise(" ").alias("Адрес"), F.when(k % 3 == 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("адрес объекта"), k.cast("string").alias("Площадь"))
    return L.canonical_rows(x, {"address": ["Адрес", "адрес объекта", "нет"], "area": ["Площадь"]})
