"""Edge cases of the scalar functions, on invented rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from auctra.functions import columns as C
from auctra.functions import vocab as V


def values(spark, column, rows, schema="x string"):
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("y")).collect()]


def test_numbers(spark):
    assert values(spark, C.to_double("x"), [" 94,3 ", "", None, "abc", "0"]) == [94.3, None, None, None, 0.0]
    assert values(spark, C.to_money("x"), ["117613372,50", "1 234 567,00 руб.", "1 000,5", "-25", "", None]) == [117613372.5, 1234567.0, 1000.5, -25.0, None, None]
    assert values(spark, C.to_percent("x"), ["95.0%", "-25,0 %", "", None]) == [95.0, -25.0, None, None]


def test_dates(spark):
    d = dt.date(2024, 3, 5)
    assert values(spark, C.parse_date("x"), ["05.03.2024 10:00:00", "05.03.2024", "2024-03-05", "31.02.2024", "", None]) == [d, d, d, None, None, None]
    assert values(spark, C.snapshot_date("x"), ["2024-02", "2023-02", "bad", None]) == [dt.date(2024, 2, 29), dt.date(2023, 2, 28), None, None]
    got = values(spark, C.parse_iso_ts("x"), ["2025-03-05T10:00:00.1234567Z", "2025-03-05T10:00:00", "nonsense"])
    assert [x and x.replace(microsecond=0).hour for x in got] == [10, 10, None]


def test_addresses(spark):
    raw = ["Российская Федерация, город Москва, ул. Лесная, д. 5, корпус 3, этаж 1", "Центральный административный округ, Лесная улица, дом 12/3, строение 1", "Лёсная №\\ \"тест\"", None, ""]
    assert values(spark, C.normalize_address("x"), raw) == ["улица лесная 5 корп 3", "лесная улица 12/3 стр 1", "лесная / тест", "", ""]
    assert values(spark, C.canonical_address("x"), ["улица лесная 5 к3", "лесная 5 ст1а", None]) == ["лесная 5 корп 3", "лесная 5 стр 1а", None]
    assert values(spark, C.district_code("x"), ["Южный административный округ, ул. Ясная", "ул. Ясная", None]) == ["ЮАО", V.UNKNOWN_DISTRICT, V.UNKNOWN_DISTRICT]
    assert values(spark, C.building_key("x"), ["город Москва, улица Ясная, дом 5, корпус 2", "без улицы", None]) == ["ул. ясная|д:5|к:2|стр:", None, None]
    assert values(spark, C.building_key("x", relaxed=True), ["город Москва, улица Ясная, дом 5, корпус 2"]) == ["ул. ясная|д:5"]
    assert values(spark, C.geocode_query("x"), ["город Москва, район Северный, улица Ясная, дом 5, этаж 1", "г. Москва", None]) == ["Москва, район Северный, улица Ясная, дом 5", None, None]


@pytest.mark.parametrize(
    ("raw", "split", "comma"),
    [
        ("подвал", "Подвал", "Подвал"), ("-1", "Подвал", "Подвал"), ("1", "1 этаж", "1 этаж"), ("1, 2", "Многоуровневый", "Многоуровневый"), ("подвал, 0", "Подвал", "Многоуровневый"),
        ("1, 1", "1 этаж", "Многоуровневый"), ("2 этаж и выше", "Многоуровневый", "Многоуровневый"), ("антресоль", "Антресоль", "Антресоль"), ("7", "5+ этаж", "5+ этаж"), ("0", "0 этаж", "0 этаж"),
        ("", "Не указано", "Не указано"), (None, "Не указано", "Не указано"),
    ],
)
def test_floors(spark, raw, split, comma):
    assert values(spark, C.floor_label("x"), [raw]) == [split]
    assert values(spark, C.floor_label("x", "any_comma"), [raw]) == [comma]


def test_listing_floors(spark):
    assert values(spark, C.listing_floor("x"), ["цокольный", "-1", "1", "2", "9", None]) == ["цоколь", "цоколь", "1", "2", "3+", None]
    assert values(spark, C.lot_floor_to_listing("x"), ["подвал, 1", "2 этаж и выше", "мезонин", "4", "?"]) == ["цоколь", "3+", "1", "3+", None]
    assert values(spark, C.floor_group("x"), ["подвал", "3", "5 этаж", "9", None]) == ["подвал", "3 этаж", "4-5 этажи", "6+ этажи", "unknown"]


def test_names(spark):
    assert values(spark, C.company_name("x"), ["OZON, пункт выдачи", "Новый магазин, филиал", None]) == ["Ozon", "Новый магазин", None]
    assert values(spark, C.name_tokens("x"), ["ООО Ёлка-клуб и К", None]) == ["елка", ""]
    assert values(spark, C.is_implausible("x", F.lit("")), ["Банкомат, Банк", "Ясный переулок, 7", "Пекарня"]) == [True, True, False]
    assert values(spark, C.retail_category("x"), ["Кафе -> Кофейни", "Аптеки", "Прочее"]) == ["Общепит", "Аптеки", None]
    assert values(spark, C.confidence_label(F.lit("medium"), "x"), ["a | b", "a", ""]) == ["2 варианта", "Вероятный", "Вероятный"]


def test_params(spark):
    text = "Этаж=1|Общая площадь=94,5|Этаж=2"
    assert values(spark, C.param("x", "Этаж"), [text, "Этажность=3", None]) == ["1", None, None]
    assert values(spark, C.listing_area("x", F.lit("Помещение (12,5 м²)")), [text, "a=b", None]) == [94.5, 12.5, 12.5]


def test_prices(spark):
    rows = [(100.0, 150.0, V.AUCTION), (100.0, 90.0, V.AUCTION), (100.0, 90.0, V.PUBLIC_OFFER), (0.0, 90.0, "x"), (100.0, 90.0, "x"), (100.0, None, "x")]
    schema = "a double, b double, f string"
    assert values(spark, C.price_excess("a", "b", "f"), rows, schema) == [50.0, None, None, None, -10.0, None]
    assert values(spark, C.price_excess("a", "b", "f", "fill"), rows, schema) == [50.0, -10.0, -10.0, None, -10.0, None]
    deposits = [(500000.0, 1e6), (97.0, 1000.0), (103.0, 1000.0), (200.0, 1000.0), (20.0, 1000.0), (None, 1.0), (5.0, None)]
    assert values(spark, C.deposit_type("a", "b"), deposits, "a double, b double") == ["fixed 500k", "5-10%", "10%", "20%+", "1-5%", "none", "unknown percent"]
    assert values(spark, C.round_to_step("a", "b"), [(7.5, 5.0), (12.5, 5.0), (7.0, 0.0)], "a double, b double") == [10.0, 10.0, 7.0]
    assert values(spark, C.valid_final_price("a", "f"), [(0.0, V.AUCTION), (0.0, "x"), (5.0, None)], "a double, f string") == [None, 0.0, 5.0]


def test_entrances(spark):
    assert values(spark, C.entrance_label("x"), ["separateFromStreet", "Через холл", "unknown", None]) == ["отдельный с улицы", "через холл", None, None]
    assert values(spark, C.entrance_display("x"), ["nsi:1032:103201", "nsi:0", "своё"]) == ["Отдельный", "Не указано", "своё"]
    flags = values(spark, C.chain_floor_flags("x"), ["первый этаж; подвал", "-1", "", "1"])
    assert [tuple(f) for f in flags] == [(False, True, True, False), (False, False, True, False), (True, True, True, True), (False, True, False, False)]


def test_pages(spark):
    html = "<dl><dt>Площадь</dt><dd><b>94,3</b> м²</dd><dt>Этаж</dt><dd>1</dd><dt>Этаж</dt><dd>2</dd></dl>"
    assert values(spark, C.page_fields("x"), [html]) == [{"Площадь": "94,3 м²", "Этаж": "1"}]
    page = '<a data-id="7">Приложение</a><a data-id="9">Протокол об итогах</a>'
    assert values(spark, C.protocol_attachment("x", ["протокол"]), [page]) == ["9"]
    text = "Начальная цена: 1 000 000,00 руб. Цена, предложенная победителем 1 200 000 руб."
    got = values(spark, C.protocol_fields("x"), [text])[0]
    assert (got["start_price"], got["winner_price"], got["second_price"]) == (1000000.0, 1200000.0, None)
    rows = [([["1", "Допустить"], ["2", "не допустить"], [""]], ""), ([["a"], ["b"]], ""), ([], "решено допустить, допустить")]
    assert values(spark, C.admitted_count("r", "t"), rows, "r array<array<string>>, t string") == [1, 2, 2]
