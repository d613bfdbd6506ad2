"""Column expressions: lenient parsing, text clean-up, vocabularies. All built-in, no UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from auctra.functions import vocab as V

_WORD = "0-9a-zа-яё_"
NBSP = " "


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(_col(c)), F.lit(""))


def first_non_empty(*cols) -> Column:
    """First of alternative columns that is not blank."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def mapped(c, table: dict, default: Column | None = None) -> Column:
    """Value of a literal table."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, _col(c))
    return found if default is None else F.coalesce(found, default)


def first_hit(c: Column, rules: list[tuple[str, str]], default: Column | None = None) -> Column:
    """Label of the first part that the text contains."""
    out = None
    for part, label in rules:
        out = F.when(c.contains(part), label) if out is None else out.when(c.contains(part), label)
    return out if default is None else out.otherwise(default)


def contains_any(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


# Numbers and dates


def to_double(c) -> Column:
    """Trimmed, decimal comma; null if it is no number."""
    return F.replace(F.trim(_col(c).cast("string")), F.lit(","), F.lit(".")).try_cast("double")


def to_money(c) -> Column:
    """Signed amount without spaces, no-break spaces and currency words."""
    text = F.regexp_replace(F.lower(_col(c).cast("string")), r"[\s  ]|руб(?:лей|ля|ль)?\.?|₽|р\.", "")
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def to_percent(c) -> Column:
    return to_double(F.replace(F.replace(_col(c).cast("string"), F.lit("%"), F.lit("")), F.lit(NBSP), F.lit("")))


def parse_date(c) -> Column:
    """dd.MM.yyyy or ISO in the first ten characters; null otherwise."""
    head = F.substring(F.trim(_col(c).cast("string")), 1, 10)
    return F.coalesce(F.try_to_date(head, "dd.MM.yyyy"), F.try_to_date(head, "yyyy-MM-dd"))


def parse_iso_ts(c) -> Column:
    """ISO timestamp, with or without Z and a fraction of any length (cut to microseconds)."""
    text = F.regexp_replace(F.trim(_col(c).cast("string")), r"(\.\d{6})\d+", "$1")
    return F.try_to_timestamp(text)


def snapshot_date(label) -> Column:
    """Last day of the month of a yyyy-MM label."""
    return F.last_day(F.try_to_date(F.concat(_col(label), F.lit("-01")), "yyyy-MM-dd"))


def after_days(sale, snapshot) -> Column:
    return F.datediff(_col(snapshot), _col(sale))


def in_window(days, lo: int, hi: int) -> Column:
    return _col(days).between(lo, hi)


def clip(c, lo: float, hi: float) -> Column:
    return F.greatest(F.least(_col(c), F.lit(hi)), F.lit(lo))


def bucket(c, edges: list[float], labels: list[str]) -> Column:
    """Label of the half-open bin (edges[i-1], edges[i]]; one label more than edges."""
    x, out = _col(c), None
    for edge, label in zip(edges, labels):
        out = F.when(x <= edge, label) if out is None else out.when(x <= edge, label)
    return out.when(x.isNotNull(), labels[-1])


# Lists in text


def split_pipe(c) -> Column:
    return F.filter(F.transform(F.split(_col(c), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def join_pipe(c) -> Column:
    return F.array_join(_col(c), " | ")


def param(c, key: str) -> Column:
    """Value of ``key=value`` in a pipe-separated text, first occurrence."""
    return blank_to_null(F.regexp_extract(_col(c), rf"(?:^|\|)\s*\Q{key}\E=([^|]+)", 1))


# Addresses


def normalize_address(c, rules=None) -> Column:
    """Lower case, room tail cut, whole-word rules, building parts in one spelling."""
    rules = V.ADDRESS_RULES if rules is None else rules
    text = F.translate(F.lower(F.trim(F.coalesce(_col(c).cast("string"), F.lit("")))), "ё№\"'`\\", "е    /")
    text = F.regexp_replace(text, r"(?U),?\s*(?:" + "|".join(V.ROOM_WORDS) + r")\b.*$", "")
    for pattern, to in rules:
        text = F.regexp_replace(text, rf"(?U)\b{pattern}\b", to)
    text = F.regexp_replace(text, r"[^0-9a-zа-яё/]+", " ")
    for pattern, to in ((r"\bстроение\s+([0-9]+)\b", "стр $1"), (r"\bкорпус\s+([0-9a-zа-я]+)\b", "корп $1"), (r"\bдом\s+([0-9a-zа-я/]+)\b", "$1"), (r"\bвладение\s+([0-9a-zа-я/]+)\b", "вл $1")):
        text = F.regexp_replace(text, "(?U)" + pattern, to)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def canonical_address(c) -> Column:
    """Match form: block and structure spelled out, street types dropped."""
    text = F.regexp_replace(_col(c), r"(?U)\bк(\d+)\b", "корп $1")
    text = F.regexp_replace(text, r"(?U)\bст(\d+[а-яё]?)\b", "стр $1")
    text = F.regexp_replace(text, r"(?U)\b(?:" + "|".join(V.STREET_TYPES) + r")\b", "")
    return F.trim(F.regexp_replace(text, " {2,}", " "))


def district_code(address) -> Column:
    """Short code of the district that the first address part names."""
    first = F.trim(F.split(_col(address), ",")[0])
    named = F.when(first.contains("административный округ") | first.contains("Зеленоградский"), mapped(first, V.DISTRICTS, first))
    return F.coalesce(named, F.lit(V.UNKNOWN_DISTRICT))


def full_address(region, district, address) -> Column:
    """Region, district and address, each once."""
    region, district, address = blank_to_null(region), blank_to_null(district), blank_to_null(address)
    inside = lambda x: F.when(~F.coalesce(address, F.lit("")).contains(x), x)
    return F.concat_ws(", ", inside(region), inside(district), address)


def building_key(c, relaxed: bool = False) -> Column:
    """street|house[|block|structure] of an address; null without a street or house."""
    text = F.lower(F.regexp_replace(_col(c), r"[\s ]+", " "))
    kind = f"(?:{'|'.join(x.replace('.', chr(92) + '.') for x in V.STREET_KINDS)})"
    street = F.coalesce(blank_to_null(F.regexp_extract(text, rf"(?:^|,)\s*({kind}\s+[а-яё0-9\- ]+?)\s*(?:,|$)", 1)), blank_to_null(F.regexp_extract(text, rf"(?:^|,)\s*([а-яё0-9\- ]+?\s+{kind})\s*(?:,|$)", 1)))
    for full, short in V.STREET_SHORT.items():
        street = F.replace(street, F.lit(full), F.lit(short))
    part = lambda words: F.regexp_extract(text, rf"(?U)(?:^|[\s,])(?:{words})\s*([0-9]+(?:/[0-9]+)?[а-яa-z]?)", 1)
    house = F.coalesce(blank_to_null(part(r"дом|д\.")), blank_to_null(F.regexp_extract(F.trim(text), r"[,\s]([0-9]+(?:/[0-9]+)?[а-яa-z]?)$", 1)))
    key = F.concat(street, F.lit("|д:"), house)
    return key if relaxed else F.concat(key, F.lit("|к:"), part(r"корпус|к\."), F.lit("|стр:"), part(r"строение|стр\."))


def geocode_query(c, city: str = "Москва") -> Column:
    """Query text of an address: no administrative or room parts, city first; null if too short."""
    parts = F.transform(F.split(F.regexp_replace(_col(c), NBSP, " "), ","), lambda x: F.trim(x))
    drop = r"(?iu)административный округ|муниципальный округ|российская федерация|внутригородская|^г\.?\s|^город|этаж|помещени|подвал|комнат|антресоль|^пом\.|^москва$|^$"
    text = F.array_join(F.filter(parts, lambda x: ~x.rlike(drop)), ", ")
    return F.when(F.length(text) >= 5, F.concat(F.lit(f"{city}, "), text))


def geocode_variants(c, city: str = "Москва") -> Column:
    """Distinct query texts, from exact to coarse."""
    text = geocode_query(c, city)
    no_block = F.regexp_replace(text, r"(?iu),?\s*(?:корпус|к\.|строение|стр\.)\s*[0-9а-яa-z/]+", "")
    plain = F.regexp_replace(no_block, r"(?iu)(?:дом|д\.)\s*", "")
    return F.array_distinct(F.array_compact(F.array(text, no_block, plain)))


# Names and usage


def company_name(c, aliases: dict | None = None) -> Column:
    """Text before the first comma, by its alias if it has one."""
    name = F.trim(F.split(_col(c), ",")[0])
    return mapped(F.lower(name), V.COMPANY_ALIASES if aliases is None else aliases, name)


def company_key(c) -> Column:
    return F.lower(F.trim(F.split(_col(c), r"[(,]")[0]))


def name_tokens(c, noise: list[str] | None = None) -> Column:
    words = F.split(F.regexp_replace(F.translate(F.lower(F.coalesce(_col(c), F.lit(""))), "ё", "е"), "[^0-9a-zа-я]+", " "), " ")
    drop = V.NAME_NOISE if noise is None else noise
    return F.array_join(F.filter(words, lambda x: (F.length(x) > 1) & ~x.isin(drop)), " ")


def usage_text(rubric, subrubric) -> Column:
    return F.concat_ws(" -> ", blank_to_null(rubric), blank_to_null(subrubric))


def display_entry(name, rubric, brands: list[str] | None = None) -> Column:
    """``name (first rubric)``; known brands bare."""
    first = blank_to_null(F.split(_col(rubric), ",")[0])
    known = sorted(set(V.HISTORY_ALIASES.values())) if brands is None else brands
    return F.when(_col(name).isin(known) | first.isNull(), _col(name)).otherwise(F.concat(_col(name), F.lit(" ("), first, F.lit(")")))


def chart_category(usage) -> Column:
    """First rubric of a usage text; the rubric of parcel services counts as pick-up points."""
    first = F.trim(F.split(F.split(_col(usage), "->")[0], ",")[0])
    return F.when(first == V.PICKUP_RUBRIC, V.PICKUP_CATEGORY).otherwise(first)


def is_implausible(name, usage, ruleset: str = "match") -> Column:
    """No tenant: a device, a public service, or a name that is an address."""
    u, n = F.coalesce(_col(usage), F.lit("")), F.lower(F.coalesce(_col(name), F.lit("")))
    rubrics = V.IMPLAUSIBLE_RUBRICS[ruleset]
    by_usage = contains_any(u, rubrics) if ruleset == "match" else contains_any(F.lower(u), [x.lower() for x in rubrics])
    out = by_usage | contains_any(n, V.IMPLAUSIBLE_NAMES[ruleset])
    if ruleset == "match":
        out = out | n.rlike(r"(?U)\b(?:" + "|".join(V.ADDRESS_NAME_TYPES) + r")\b.{0,30}\d")
    return out


def retail_category(usage) -> Column:
    return first_hit(F.lower(_col(usage)), [(k.lower(), v) for k, v in V.RETAIL_CATEGORIES])


def is_alcohol(companies, words: list[str], first_only: bool = False) -> Column:
    """Any candidate of a pipe list (or the first) that contains, or is part of, an alcohol retailer's name."""
    names = F.transform(split_pipe(companies), company_key)
    names = F.slice(names, 1, 1) if first_only else names
    return F.coalesce(F.exists(names, lambda x: reduce(lambda a, b: a | b, [x.contains(w) | F.contains(F.lit(w), x) for w in words])), F.lit(False))


# Floors and entrances


def _one_floor(x: Column) -> Column:
    low = F.lower(F.trim(x))
    n = F.regexp_extract(low, r"\d+", 0).try_cast("int")
    out = F.when(low == "", F.lit(None).cast("string")).when(low.rlike(r"^-\d+$"), "Подвал")
    for part, label in V.FLOOR_WORDS:
        out = out.when(low.contains(part), label)
    return out.when(n >= 5, "5+ этаж").when(n.isNotNull(), F.concat(n.cast("string"), F.lit(" этаж"))).otherwise(F.trim(x))


def floor_label(c, multi: str = "split") -> Column:
    """One of 15 labels. ``split``: lists count as several levels unless all parts agree, and a level 0 beside a basement is
    no level of its own. ``any_comma``: every list counts as several levels."""
    text = F.trim(F.replace(_col(c).cast("string"), F.lit(NBSP), F.lit(" ")))
    several = F.lit("Многоуровневый")
    out = F.when(text.isNull() | (text == ""), "Не указано").when(F.lower(text).contains(" и выше"), several)
    if multi == "any_comma":
        return out.when(text.contains(","), several).otherwise(_one_floor(text))
    parts = F.array_distinct(F.array_compact(F.transform(F.split(text, ","), _one_floor)))
    below = F.array_contains(parts, "Подвал") | F.array_contains(parts, "Цоколь")
    parts = F.when(below, F.array_remove(parts, "0 этаж")).otherwise(parts)
    return out.when(F.size(parts) == 1, parts[0]).otherwise(several)


def floor_sort_key(label) -> Column:
    return mapped(label, {x: i for i, x in enumerate(V.FLOORS)}, F.lit(len(V.FLOORS)))


def listing_floor(c) -> Column:
    """Basement, 1, 2 or 3+; other texts stay."""
    low = F.lower(F.trim(_col(c)))
    n = low.try_cast("int")
    return F.when(low.isin("цокольный", "цоколь", "подвальный", "подвал") | (n <= 0), "цоколь").when(n <= 2, n.cast("string")).when(n > 2, "3+").otherwise(low)


def lot_floor_to_listing(c) -> Column:
    """Floor of a lot in listing words; of a list the first part counts."""
    low = F.lower(F.trim(_col(c)))
    first = F.trim(F.split(low, ",")[0])
    n = first.try_cast("int")
    whole = mapped(low, V.LOT_FLOORS)
    return F.coalesce(whole, mapped(first, V.LOT_FLOORS), F.when(n <= 0, "цоколь").when(n <= 2, n.cast("string")).when(n > 2, "3+"))


def floor_group(c, scheme: str = "fine") -> Column:
    """Coarse groups for statistics; ``fine`` (4-5, 6+) or ``coarse`` (3+ floors)."""
    low = F.lower(F.trim(_col(c)))
    if scheme == "coarse":
        return F.when(low.isNull(), "Не указан").when(low.contains("подвал"), "Подвал").when(low.contains("цокол"), "Цоколь").when(low == "1", "1 этаж").when(low == "2", "2 этаж").otherwise("3+ этаж")
    n = F.regexp_extract(low, r"\d+", 0).try_cast("int")
    out = F.when(low.contains("подвал"), "подвал").when(low.contains("цоколь"), "цоколь").when(n.between(1, 3), F.concat(n.cast("string"), F.lit(" этаж")))
    return out.when(n <= 5, "4-5 этажи").when(n > 5, "6+ этажи").otherwise("unknown")


def clean_floor(c) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"(?iu)\s*этаж\s*", " "))


def entrance_label(c, table: dict | None = None) -> Column:
    text = F.trim(_col(c))
    return F.coalesce(mapped(text, V.ENTRANCES if table is None else table), mapped(F.lower(text), V.ENTRANCES if table is None else table))


def lot_entrance(c) -> Column:
    return mapped(F.lower(F.trim(_col(c))), V.LOT_ENTRANCES)


def entrance_display(c) -> Column:
    return F.when(_col(c).startswith("nsi:"), mapped(c, V.ENTRANCE_CODES, F.lit("Не указано"))).otherwise(_col(c))


def entrance_flags(c) -> tuple[Column, Column]:
    """Separate entrance of any kind, shared entrance of any kind."""
    label = _col(c)
    return F.coalesce(label.isin(V.SEPARATE_ENTRANCES), F.lit(False)), F.coalesce(label.isin(V.SHARED_ENTRANCES), F.lit(False))


def lot_object_type(purpose) -> Column:
    return mapped(F.lower(F.trim(_col(purpose))), V.LOT_PURPOSES)


def object_class(c) -> Column:
    low = F.lower(F.trim(_col(c)))
    return F.when(low.isNotNull(), first_hit(low, V.OBJECT_CLASSES, F.lit("other")))


def chain_floor_flags(c) -> Column:
    """Struct any, first, basement, cellar of a chain's floor text; no usable part means any."""
    parts = F.filter(F.transform(F.split(F.lower(F.coalesce(_col(c), F.lit(""))), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    low = lambda x: x.contains("подвал") | x.rlike(r"-\d+")
    base = F.exists(parts, low)
    cell = F.exists(parts, lambda x: ~low(x) & x.contains("цок"))
    first = F.exists(parts, lambda x: ~low(x) & ~x.contains("цок") & (x.rlike(r"(?U)\b1\b") | x.contains("перв")))
    free = ~(base | cell | first)
    return F.struct(free.alias("any"), (first | free).alias("first"), (base | free).alias("basement"), (cell | free).alias("cellar"))


# Listings


def listing_area(params, title) -> Column:
    """Total area: parameter, else the number before m² in brackets in the title."""
    inside = F.regexp_extract(_col(title), r"\((\d+[.,]?\d*)\s*м", 1)
    return F.coalesce(to_double(param(params, "Общая площадь")), to_double(inside))


def price_per_m2(price, area) -> Column:
    return F.when(_col(area) > 0, _col(price) / _col(area))


# Distance bands and confidence


def distance_band(m) -> Column:
    d = _col(m)
    return F.when(d <= 30, "0-30m").when(d <= 100, "30-100m").when(d <= 250, "100-250m").when(d.isNotNull(), "250m+")


def confidence(n, best_band) -> Column:
    n, b = _col(n), _col(best_band)
    return F.when((n == 1) & (b == "0-30m"), "high").when((n <= 3) & b.isin("0-30m", "30-100m"), "medium").when(n > 0, "low")


def geo_confidence(conf, band) -> Column:
    """After the distance check: near bands keep it, 100-250 m is low, farther is none."""
    return F.when(_col(band).isin("0-30m", "30-100m"), _col(conf)).when(_col(band) == "100-250m", "low")


def confidence_rank(c) -> Column:
    return mapped(c, V.CONFIDENCE_RANK, F.lit(9))


def confidence_label(conf, preview) -> Column:
    n = F.coalesce(F.size(split_pipe(preview)), F.lit(0))
    c = F.lower(F.trim(_col(conf)))
    variants = F.when(n <= 1, "Вероятный").when(n.between(2, 4), F.concat(n.cast("string"), F.lit(" варианта"))).otherwise(F.concat(n.cast("string"), F.lit(" вариантов")))
    return F.when(c == "high", "Высокое").when(c == "medium", variants).when(c == "existing_tenant", "Действующий арендатор").otherwise("Нет")


def match_source(conf, window) -> Column:
    w = F.coalesce(_col(window), F.lit(""))
    label = lambda p: F.concat(F.lit("Данные появления бизнеса за "), F.substring(w, len(p) + 1, 100))
    out = F.when(blank_to_null(conf).isNull(), "Без совпадения").when(w.startswith("0-180d_recent_"), "Недавние (до 180 дн.)")
    for prefix in ("gap_snapshot_", "first_after_snapshot_"):
        out = out.when(w.startswith(prefix), label(prefix))
    return out.when(w == "existing_tenant_buyout", "Действующий арендатор (был до и после продажи)").otherwise("Базовые (180-365 дней после покупки)")


# Auction prices


def trade_form_class(c) -> Column:
    low = F.lower(_col(c))
    return F.when(low.contains("публичн"), "public_offer").when(low.contains("без объявления"), "no_price").when(low.contains("аукцион"), "auction").otherwise("other")


def valid_final_price(price, form) -> Column:
    """Not positive in an ascending auction: no price."""
    return F.when(~F.coalesce((_col(form) == V.AUCTION) & (_col(price) <= 0), F.lit(False)), _col(price))


def final_price(protocol, page) -> Column:
    """Struct price, source, confirmed: protocol before page before missing."""
    return F.struct(
        F.coalesce(_col(protocol), _col(page)).alias("price"),
        F.when(_col(protocol).isNotNull(), "protocol").when(_col(page).isNotNull(), "page").otherwise("missing").alias("source"),
        _col(protocol).isNotNull().alias("confirmed"),
    )


def price_excess(start, final, form=None, policy: str = "strict") -> Column:
    """Percent over the start price, one decimal. ``strict`` has none for offers without ascending bids, nor below the start of
    an ascending auction; ``fill`` is for all forms."""
    value = F.when(_col(start) > 0, F.bround((_col(final) - _col(start)) / _col(start) * 100, 1))
    if policy == "fill":
        return value
    out = ~F.coalesce(_col(form).isin(V.PUBLIC_OFFER, V.NO_PRICE) | ((_col(form) == V.AUCTION) & (_col(final) < _col(start))), F.lit(False))
    return F.when(out, value)


def deposit_type(deposit, start) -> Column:
    """Fixed 500 000 first, then percent bins in order; a deposit without a start price is its own bin."""
    d = _col(deposit)
    pct = F.when(_col(start) > 0, F.bround(d / _col(start) * 100, 1))
    return (
        F.when(d.isNull(), "none").when(F.abs(d - 500000) < 1, "fixed 500k").when(pct.isNull(), "unknown percent")
        .when(pct < 5, "1-5%").when(pct < 10, "5-10%").when(F.abs(pct - 10) < 0.5, "10%").when(pct < 20, "10-20%").otherwise("20%+")
    )


def bid_step_pct(step, start, default: float = 5.0) -> Column:
    return F.coalesce(F.when((_col(start) > 0) & (_col(step) > 0), _col(step) / _col(start) * 100), F.lit(default))


def round_to_step(value, step) -> Column:
    """Nearest multiple, halves to even."""
    return F.when(_col(step) > 0, F.rint(_col(value) / _col(step)) * _col(step)).otherwise(_col(value))


def trade_year(*cols) -> Column:
    """First column with a year in it."""
    return F.coalesce(*[F.regexp_extract(_col(c).cast("string"), r"(20\d\d)", 1).try_cast("int") for c in cols])


# Nested records


def metro_text(stations) -> Column:
    named = F.filter(_col(stations), lambda s: s["subwayStationName"].isNotNull())
    time = lambda s: F.coalesce(F.concat(F.lit(" ("), s["walkingTime"].cast("string"), F.lit(" мин)")), F.lit(""))
    return F.array_join(F.transform(named, lambda s: F.concat(s["subwayStationName"], time(s))), "; ")


def named_value(arr, name: str) -> Column:
    return F.get(F.filter(_col(arr), lambda x: x["name"] == name), F.lit(0))["value"]


def page_fields(html) -> Column:
    """Map of label to value of a page's definition rows; the first of equal labels counts."""
    label = F.regexp_extract_all(_col(html), F.lit(r"(?s)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>.*?</dd>"), F.lit(1))
    value = F.regexp_extract_all(_col(html), F.lit(r"(?s)<dt[^>]*>.*?</dt>\s*<dd[^>]*>(.*?)</dd>"), F.lit(1))
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))
    pairs = F.zip_with(label, value, lambda a, b: F.struct(plain(a).alias("key"), plain(b).alias("value")))
    keys = F.transform(pairs, lambda x: x["key"])
    return F.map_from_entries(F.filter(pairs, lambda x, i: F.array_position(keys, x["key"]) == i + 1))


def protocol_attachment(html, preferred: list[str]) -> Column:
    """Id of the attachment whose title comes first in the preferred order."""
    ids = F.regexp_extract_all(_col(html), F.lit(r'(?s)data-id="([^"]+)"[^>]*>[^<]*<'), F.lit(1))
    titles = F.regexp_extract_all(_col(html), F.lit(r'(?s)data-id="[^"]+"[^>]*>([^<]*)<'), F.lit(1))
    both = F.arrays_zip(ids.alias("id"), titles.alias("title"))
    titled = lambda t: F.filter(both, lambda x: F.lower(x["title"]).contains(t.lower()))
    return F.coalesce(*[F.get(titled(t), F.lit(0))["id"] for t in preferred])


def protocol_fields(text) -> Column:
    """Start price, winner price, runner-up price and duration from a protocol's text. Names of winners are not kept."""
    t = _col(text)
    amount = lambda p: to_money(blank_to_null(F.regexp_extract(t, rf"(?isu)(?:{p})[^0-9]{{0,80}}([0-9][0-9\s ]*(?:[.,][0-9]{{1,2}})?)", 1)))
    return F.struct(
        amount("начальн[а-я]+ цен[а-я]+").alias("start_price"), amount("цена,? предложенная победителем|цен[а-я]+ победител[а-я]+").alias("winner_price"),
        amount("предпоследн[а-я]+ предложени[а-я]+|второ[а-я]+ мест[а-я]+").alias("second_price"),
        blank_to_null(F.regexp_extract(t, r"(?isu)продолжительность[^0-9]{0,40}([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)", 1)).alias("duration"),
    )


def admitted_count(rows, text) -> Column:
    """Rows of a table that admit a bidder; all rows if none says so; else the hits in the text."""
    joined = F.filter(F.transform(_col(rows), lambda r: F.lower(F.array_join(r, " "))), lambda x: F.trim(x) != "")
    yes = F.filter(joined, lambda x: x.contains("допустить") & ~x.contains("не допустить") & ~x.contains("отказать"))
    hits = F.size(F.regexp_extract_all(F.lower(_col(text)), F.lit("(?u)(?<!не )допустить"), F.lit(0)))
    return F.when(F.size(yes) > 0, F.size(yes)).when(F.size(joined) > 0, F.size(joined)).when(hits > 0, hits)


def page_entrance(html) -> Column:
    token = F.coalesce(blank_to_null(F.regexp_extract(_col(html), r'"(?:inputType|entranceType)"\s*:\s*"([A-Za-z]+)"', 1)), blank_to_null(F.regexp_extract(_col(html), r"(?isu)тип входа[^а-яё]{1,60}?([а-яё ]+?)\s*<", 1)))
    return entrance_label(token)


def sniff_doc_type(content) -> Column:
    head = F.substring(_col(content), 1, 5)
    hexed = F.hex(head)
    return F.when(hexed == "255044462D", "pdf").when(hexed.startswith("504B0304"), "zip").when(hexed.startswith("D0CF11E0"), "ole").otherwise("unknown")
