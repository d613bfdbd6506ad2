"""Price and rent models: surroundings of a place as features, one saved pipeline, listings and lots through the same steps.

Every place has an id, lat, lon, area, floor and type in listing words, entrance label and floors_total. ``surroundings`` adds what is around it;
``price_pipeline`` turns that into a vector (nulls are 0, floors and types are dummies), boosted trees on the logarithm and a price again. The fitted
pipeline is written, read and applied as a whole.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctra.functions import columns as C
from auctra.functions.geo import distance_to
from auctra.operators.spatial import count_within, nearest, radius_join, radius_median, radius_sum

#: Numeric features, in order, then floors and types.
NUMERIC = [
    "area", "metro_km", "flats_400", "flats_800", "other_median_700", "other_median_700_same", "other_median_1500", "other_count_700", "own_count_700", "centre_m", "lat", "lon",
    "floors_total", "entrance_separate", "entrance_shared", "metro_passengers", "metro_vestibule",
]
# Dummies of the models.
FLOORS = ["1", "2", "3+", "цоколь"]
TYPES = ["Офисное помещение", "Помещение свободного назначения", "Торговое помещение"]
CENTRE = (55.7520, 37.6175)


def lots_as_places(lots: DataFrame) -> DataFrame:
    """Lots (lot_id, lat, lon, area, floor, entrance, purpose, floors_total) in the words of listings, ``id`` the lot's."""
    return lots.select(
        F.col("lot_id").alias("id"), "lat", "lon", "area", C.lot_floor_to_listing("floor").alias("floor"), C.lot_entrance("entrance").alias("entrance"), C.lot_object_type("purpose").alias("type"), "floors_total"
    )


def surroundings(places: DataFrame, own: DataFrame, other: DataFrame, houses: DataFrame, stations: DataFrame, same_falls_back: bool = True, centre: tuple[float, float] = CENTRE, listed: bool = True) -> DataFrame:
    """Places with the ``NUMERIC`` features.

    own, other: listings of the place's market and of the other one (price_m2, type, lat, lon). Houses: flats, lat, lon. Stations: station, passengers,
    vestibule, lat, lon. ``listed``: the places are among ``own``, and do not count themselves. ``same_falls_back``: without two listings of the own type
    nearby, the median of all types stands in.
    """
    shown = lambda df, prefix: df.select([F.col(c).alias(prefix + c) for c in df.columns])
    at = places.select("id", "lat", "lon", "type")
    flats = radius_sum(at.select("id", "lat", "lon"), shown(houses.select("flats", "lat", "lon"), "h_"), "id", "h_flats", [400, 800], right_at=("h_lat", "h_lon"))
    medians = radius_median(at, shown(other.select("price_m2", "type", "lat", "lon"), "o_"), "id", "o_price_m2", [700, 1500], same=("type", "o_type"), right_at=("o_lat", "o_lon"))
    same = F.col("median_same_700")
    if not same_falls_back:
        pairs = radius_join(at, shown(other.select("price_m2", "type", "lat", "lon"), "o_"), 700, right_at=("o_lat", "o_lon")).where("o_type = type")
        own_type = pairs.groupBy("id").agg(F.when(F.count("o_price_m2") >= 2, F.median("o_price_m2")).alias("own_type_median"))
        medians, same = medians.join(own_type, "id", "left"), F.col("own_type_median")
    near = count_within(at, own, "id", 700, "near", right_at=("lat", "lon")).groupBy("id").agg((F.sum("near") - int(listed)).alias("own_count_700"))
    metro = nearest(at.select("id", "lat", "lon"), stations.select("station", "passengers", "vestibule", F.col("lat").alias("m_lat"), F.col("lon").alias("m_lon")), "id", "station", right_at=("m_lat", "m_lon"))
    metro = metro.select("id", (F.col("distance_m") / 1000).alias("metro_km"), F.col("passengers").alias("metro_passengers"), F.col("vestibule").alias("metro_vestibule"))
    separate, shared = C.entrance_flags("entrance")
    out = places.join(flats.select("id", F.col("sum_400").alias("flats_400"), F.col("sum_800").alias("flats_800")), "id", "left")
    out = out.join(medians.select("id", F.col("median_700").alias("other_median_700"), same.alias("other_median_700_same"), F.col("median_1500").alias("other_median_1500"), F.col("n_700").alias("other_count_700")), "id", "left")
    out = out.join(near, "id", "left").join(metro, "id", "left").fillna(0, ["own_count_700"])
    return out.withColumns({"centre_m": distance_to("lat", "lon", centre), "entrance_separate": separate.cast("double"), "entrance_shared": shared.cast("double")})


def feature_names(floors: list[str] = FLOORS, types: list[str] = TYPES) -> list[str]:
    return NUMERIC + [f"floor_{i}" for i in range(len(floors))] + [f"type_{i}" for i in range(len(types))]


def price_pipeline(floors: list[str] = FLOORS, types: list[str] = TYPES, iterations: int = 60) -> Pipeline:
    """Stages that can be written and read: dummies and zeros, vector, boosted trees on ``label``, ``prediction`` in price."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    made = [f"coalesce(double({c}), 0.0D) AS f_{c}" for c in NUMERIC] + [f"double(coalesce({kind} = {quoted(x)}, false)) AS f_{kind}_{i}" for kind, values in (("floor", floors), ("type", types)) for i, x in enumerate(values)]
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__"),
        VectorAssembler(inputCols=[f"f_{c}" for c in feature_names(floors, types)], outputCol="features"),
        GBTRegressor(featuresCol="features", labelCol="label", predictionCol="raw", maxDepth=5, stepSize=0.05, subsamplingRate=0.8, maxIter=iterations, seed=42),
        SQLTransformer(statement="SELECT *, exp(raw) AS prediction FROM __THIS__"),
    ])


def fit_prices(rows: DataFrame, floors: list[str] = FLOORS, types: list[str] = TYPES, iterations: int = 60) -> PipelineModel:
    """Fits on rows of ``surroundings`` with a positive price_m2 and an area."""
    return price_pipeline(floors, types, iterations).fit(rows.where("price_m2 > 0 AND area IS NOT NULL").withColumn("label", F.log("price_m2")))


def write_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def read_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def price_places(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows of ``surroundings`` with ``prediction``, a price per m²."""
    return model.transform(rows).select(*rows.columns, "prediction")
