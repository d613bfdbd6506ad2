"""Features of the price models against brute force; fit, write, read and score."""

from __future__ import annotations

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from auctra.operators import hedonic as H
from tests.test_nearest import metres


def tables(spark):
    rng = random.Random(9)
    at = lambda: (55.75 + rng.uniform(-0.015, 0.015), 37.6 + rng.uniform(-0.025, 0.025))
    kind = lambda: rng.choice([*H.TYPES, None])
    own = [(i, *at(), rng.uniform(20, 200), rng.choice([*H.FLOORS, None]), kind(), rng.choice(["отдельный с улицы", "через холл", None]), rng.choice([5, None]), rng.uniform(1e5, 4e5)) for i in range(160)]
    other = [(rng.uniform(500, 3000), kind(), *at()) for _ in range(120)]
    houses = [(rng.randint(1, 90), *at()) for _ in range(80)]
    stations = [(f"s{i}", rng.uniform(1e5, 1e6), float(i % 3), *at()) for i in range(9)]
    frames = (
        spark.createDataFrame(own, "id long, lat double, lon double, area double, floor string, type string, entrance string, floors_total int, price_m2 double"), spark.createDataFrame(other, "price_m2 double, type string, lat double, lon double"),
        spark.createDataFrame(houses, "flats int, lat double, lon double"), spark.createDataFrame(stations, "station string, passengers double, vestibule double, lat double, lon double"),
    )
    return (own, other, houses, stations), frames


@pytest.mark.parametrize("falls_back", [True, False])
def test_surroundings_equal_brute_force(spark, falls_back):
    (own, other, houses, stations), frames = tables(spark)
    got = {r.id: r for r in H.surroundings(frames[0], *frames, same_falls_back=falls_back).collect()}
    assert len(got) == len(own)
    for i, y, x, _, _, kind, entrance, _, _ in own:
        d = lambda p: metres(y, x, *p[-2:])  # noqa: E731, B023
        mid = lambda v: median(v) if len(v) >= 2 else None
        near = lambda r, same=False: [p[0] for p in other if d(p) <= r and (not same or (kind is not None and p[1] == kind))]  # noqa: E731, B023
        same = mid(near(700, True))
        station = min(stations, key=d)
        want = {
            "metro_km": d(station) / 1000, "metro_passengers": station[1], "metro_vestibule": station[2], "flats_400": sum(h[0] for h in houses if d(h) <= 400), "flats_800": sum(h[0] for h in houses if d(h) <= 800),
            "other_median_700": mid(near(700)), "other_median_1500": mid(near(1500)), "other_median_700_same": same if same is not None or not falls_back else mid(near(700)), "other_count_700": len(near(700)),
            "own_count_700": sum(metres(y, x, p[1], p[2]) <= 700 for p in own) - 1, "centre_m": metres(y, x, *H.CENTRE), "entrance_separate": float(entrance == "отдельный с улицы"), "entrance_shared": float(entrance == "через холл"),
        }
        assert {c: got[i][c] for c in want} == {c: None if v is None else pytest.approx(v) for c, v in want.items()}


def test_written_model_scores_the_same(spark, tmp_path):
    _, frames = tables(spark)
    rows = H.surroundings(frames[0], *frames)
    model = H.fit_prices(rows, iterations=5)
    H.write_model(model, str(tmp_path / "sale"))
    again = H.read_model(str(tmp_path / "sale"))
    show = lambda m: {r.id: r.prediction for r in H.price_places(m, rows).collect()}
    assert show(model) == show(again) and len(set(show(again).values())) > 5
    lots = spark.createDataFrame([(1, 55.75, 37.6, 80.0, "подвал", None, None, 5), (2, 55.75, 37.6, None, None, None, None, None)], "lot_id long, lat double, lon double, area double, floor string, entrance string, purpose string, floors_total int")
    placed = H.surroundings(H.lots_as_places(lots), *frames, listed=False)
    assert {r.id: r.floor for r in placed.collect()} == {1: "цоколь", 2: None}
    assert all(1e5 < r.prediction < 4e5 for r in H.price_places(again, placed).collect())
    vector = again.stages[0].transform(placed.where("id = 1")).select(*[F.col(f"f_{c}") for c in H.feature_names()]).first()
    assert len(vector) == 24 and [vector[f"f_floor_{i}"] for i in range(4)] == [0, 0, 0, 1] and vector["f_area"] == 80
