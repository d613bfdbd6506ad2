"""Operators against brute force, and merges run twice."""

from __future__ import annotations

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from auctra.operators import components
from auctra.operators import lots as L
from auctra.operators import matching as M
from auctra.operators import spatial as S
from auctra.operators import stats as A
from auctra.operators.components import connected_components
from auctra.operators.similarity import similarity


def metres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371000 * math.asin(math.sqrt(min(1, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def test_radius_join_is_exact_at_any_latitude(spark):
    rng = random.Random(3)
    for centre in (0.0, 55.7, -75.0):
        pts = [(i, centre + rng.uniform(-0.02, 0.02), 37 + rng.uniform(-0.05, 0.05)) for i in range(120)]
        left = spark.createDataFrame([*pts, (999, None, 1.0)], "a long, lat double, lon double")
        right = spark.createDataFrame([(i, y, x) for i, y, x in pts], "b long, r_lat double, r_lon double")
        got = {(r.a, r.b) for r in S.radius_join(left, right, 700).collect()}
        assert got == {(i, j) for i, y, x in pts for j, v, u in pts if metres(y, x, v, u) <= 700}
        best = {r.a: r.b for r in S.nearest(left.where("a < 20"), right.where("b >= 20"), "a", "b", cell_rows=4).collect()}
        assert best == {i: min((metres(y, x, v, u), j) for j, v, u in pts if j >= 20)[1] for i, y, x in pts if i < 20}


def test_flag_near_borders(spark):
    step = 1 / 111194.93
    lots = spark.createDataFrame([(1, 55.0, 37.0), (2, 10.0, 10.0)], "lot_id long, lat double, lon double")
    places = spark.createDataFrame([(i, f"s{i}", 55.0 + m * step, 37.0) for i, m in enumerate((99.0, 301.0))], "p_id long, p_name string, p_lat double, p_lon double")
    got = {r.lot_id: (r.near, r.near_name) for r in S.flag_near(lots, places).collect()}
    assert got == {1: (True, "s0"), 2: (False, None)}


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 6), (10, 9), (9, 8), (8, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 7, 10: 7}
    assert connected_components(spark.createDataFrame([], "u long, v long").where("u = v")).count() == 0


def test_similarity():
    assert similarity("", "a") == 0 and similarity(None, None) == 0 and similarity("abc", "xabcx") == 1
    assert similarity("abcd", "abxd") == SequenceMatcher(None, "abcd", "abxd").ratio()


def test_dedup_listings(spark):
    rows = [("a", 55.0, 37.0, "1", 14.4, "2024-01-01"), ("b", 55.0, 37.0, "1", 14.0, "2024-02-01"), ("c", 55.0, 37.0, "1", 14.6, "2024-01-01"), ("d", None, 37.0, "1", 14.0, None), ("e", 55.0, 37.0, "1", 17.4, None)]
    got = {r.url for r in A.dedup_listings(spark.createDataFrame(rows, "url string, lat double, lon double, floor string, area double, date string")).collect()}
    assert got == {"b", "c", "d"} or got == {"b", "c", "d", "e"}
    assert "a" not in got and "d" in got


def _matches(spark, rows):
    return spark.createDataFrame(rows, "lot_id long, company string, usage string, confidence string, after_days int, time_window string")


def test_merge_gap_twice(spark):
    old = _matches(spark, [(1, None, None, None, None, None), (2, "x", "u", "high", 10, "gap_snapshot_old"), (3, "y", "u", "medium", 50, "first_after_snapshot_2024"), (4, "z", "u", "high", 5, "180-365d")])
    gap = spark.createDataFrame([(1, "n1", "u", "high", 20, "2024-05"), (3, "n3", "u", "medium", 50, "2024-05"), (4, "n4", "u", "high", 1, "2024-05"), (2, "n2", "u", "low", 1, "2024-05")], "lot_id long, company string, usage string, confidence string, after_days int, snapshot_label string")
    once, report = M.merge_gap(old, gap)
    got = {r.lot_id: r.company for r in once.collect()}
    assert got == {1: "n1", 2: None, 3: "n3", 4: "z"}
    assert {r.action: r.n for r in report.collect()} == {"added": 1, "none": 1, "upgraded": 1, "kept": 1}
    again = M.merge_gap(once, gap)[0]
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_merge_recent(spark):
    old = _matches(spark, [(1, None, None, None, None, None), (2, "x", "u", "high", 10, "180-365d")])
    new = _matches(spark, [(1, "a", "u", "medium", 9, None), (2, "b", "u", "high", 9, None)])
    assert {r.lot_id: (r.company, r.source) for r in M.merge_recent(old, new, "w").collect()} == {1: ("a", "recent"), 2: ("x", "baseline")}


def test_revalidate(spark):
    m = spark.createDataFrame([(1, "Пекарня | Постамат", "Кафе | Постаматы", "Пекарня | Постамат", "Кафе | Постаматы", "medium"), (2, "Бокс", "Постаматы", "Бокс", "Постаматы", "high")],
                              "lot_id long, company string, usage string, company_preview string, usage_preview string, confidence string")
    lots = spark.createDataFrame([(1, 50.0, "1"), (2, 50.0, "1")], "lot_id long, area double, floor string")
    limits = spark.createDataFrame([("Общепит", 10.0, 100.0)], "category string, area_lo double, area_hi double")
    out, report = M.revalidate(m, lots, limits, spark.createDataFrame([], "chain string"))
    assert {r.lot_id: (r.company, r.confidence) for r in out.collect()} == {1: ("Пекарня", "medium"), 2: (None, None)}
    assert {r.reason: r.n for r in report.collect()} == {"implausible": 2}


def test_previews_reach_beyond_a_long_run_of_one_name(spark):
    rows = [(lot, "2024-01", i, "Сеть", "Кафе", "near", float(i), 10) for lot in (1, None) for i in range(150)]
    rows += [(lot, "2024-01", 200 + i, f"Иная {i // 2}", f"Вид {i % 4}", "near", 200.0 + i, 10) for lot in (1, None) for i in range(12)] + [(2, "2024-01", 1, None, "Кафе", "near", 1.0, 10), (2, "2024-01", 2, "Сеть", "Кафе", "near", 2.0, 10)]
    df = spark.createDataFrame(rows, "lot_id long, snapshot_label string, org_id long, company string, usage string, band string, distance_m double, after_days int")
    got = {r.lot_id: (r.n, r.company, r.company_preview, r.usage_preview) for r in M.best_matches(df).collect()}
    long = (162, "Сеть", "Сеть | Иная 0 | Иная 1 | Иная 2 | Иная 3", "Кафе | Вид 0 | Вид 1 | Вид 2 | Вид 3")
    assert got == {1: long, None: long, 2: (2, None, "Сеть", "Кафе")}
    assert {r.usage_preview for r in M.best_matches(df.where("lot_id = 1"), 3).collect()} == {"Кафе | Вид 0 | Вид 1"}


def test_preexisting(spark):
    c = spark.createDataFrame([(1, 7, "2024-01-10", "Пекарня Хлебница", 55.0, 37.0), (1, 8, "2024-01-10", "Аптека", 55.0, 37.0)], "lot_id long, org_id long, sale_date string, org_name string, o_lat double, o_lon double")
    s = spark.createDataFrame([("2023-12-31", "Пекарня Хлебнца", 55.0, 37.0), ("2024-01-31", "Аптека", 55.0, 37.0)], "snapshot_date string, org_name string, lat double, lon double")
    assert [tuple(r) for r in M.preexisting(c, s).collect()] == [(1, 7)]


def test_backfill(spark):
    lots = spark.createDataFrame([(1, "c1", "улица Ясная, дом 5", None, None), (2, None, "улица Ясная, дом 5", None, None), (3, None, None, 1.0, 2.0), (4, None, "нет", None, None)], "lot_id long, cadastral_no string, address string, lat double, lon double")
    src = spark.createDataFrame([(9, "c1", "улица Иная, дом 1", 5.0, 6.0), (8, None, "улица Ясная, дом 5", 7.0, 8.0)], "lot_id long, cadastral_no string, address string, lat double, lon double")
    got = {r.lot_id: (r.lat, r.how) for r in M.backfill_coordinates(lots, src).collect()}
    assert got == {1: (5.0, "cadastral_no"), 2: (7.0, "key"), 3: (1.0, "own"), 4: (None, "none")}


def test_tenders(spark):
    from auctra.sources.files import TENDERS

    row = {"id": 5, "startPrice": 100.0, "pagePrice": 120.0, "objectArea": 10.0, "address": "ул. Ясная", "regionName": "Москва", "tradeForm": "x", "subwayStations": [("Ясная", 5), (None, 1)], "additionalParams": [("Этаж", "1 этаж")],
           "functionalityPurposes": ["a", "b"], "entranceTypeCodes": ["nsi:1032:103201"], "requestEndDate": "2025-03-05T10:00:00.1234567Z"}
    t = spark.createDataFrame([row], TENDERS)
    p = spark.createDataFrame([("5", 150.0, 3)], "lot_id string, winner_price_num double, participants_count int")
    lot = L.tenders_to_lots(t, p).collect()[0]
    assert (lot.final_price, lot.price_source, lot.excess_pct, lot.metro, lot.floor, lot.address) == (150.0, "protocol", 50.0, "Ясная (5 мин)", "1", "Москва, ул. Ясная")


def test_weighted_median(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 5.0), ("b", 4.0, 1.0)], "k string, v double, w double")
    assert {r.k: r.weighted_median for r in A.weighted_median(df, ["k"], "v", "w").collect()} == {"a": 3.0, "b": 4.0}


def test_suggestions(spark):
    df = spark.createDataFrame([(60.0, "1 этаж", "Отдельный вход"), (None, None, None)], "area double, floor_label string, entrance string")
    assert all(len(r.suggestions) == 5 for r in L.use_suggestions(df).collect())
    assert df.select(F.count("*")).first()[0] == 2
