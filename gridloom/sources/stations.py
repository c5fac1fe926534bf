"""Station register: GeoJSON features to one row per station, and units matched to stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEATURE = (
    "geometry struct<type:string, coordinates:string>, "
    "properties struct<station_code:string, name:string, state:string, "
    "duid_data:array<struct<fuel_tech:string, capacity_registered:double, status:string>>>"
)
# Register labels and the market region of each state.
SOLAR_FUELS = ("solar_utility",)
WIND_FUELS = ("wind",)
STATE_TO_REGION = {
    "NSW": "NSW1",
    "ACT": "NSW1",
    "QLD": "QLD1",
    "SA": "SA1",
    "TAS": "TAS1",
    "VIC": "VIC1",
}


def parse_features(features: DataFrame, column: str = "feature") -> DataFrame:
    """One row per station from GeoJSON feature text.

    A MultiPoint takes its first vertex; technologies are a set, capacity is summed over units,
    and a station operates when any unit does.
    """
    f = F.from_json(column, FEATURE).alias("f")
    parsed = features.select(f)
    # Coordinates are [lon, lat] or [[lon, lat], ...]: the first two numbers serve both.
    numbers = F.regexp_extract_all(F.col("f.geometry.coordinates"), F.lit(r"(-?\d+(?:\.\d+)?)"), 1)
    units = F.col("f.properties.duid_data")
    return parsed.select(
        F.col("f.properties.station_code").alias("station"),
        F.col("f.properties.name").alias("name"),
        F.col("f.properties.state").alias("state"),
        F.try_element_at(numbers, F.lit(1)).cast("double").alias("longitude"),
        F.try_element_at(numbers, F.lit(2)).cast("double").alias("latitude"),
        F.array_sort(F.array_distinct(F.transform(units, lambda u: u["fuel_tech"]))).alias("fuels"),
        F.aggregate(
            units, F.lit(0.0), lambda acc, u: acc + F.coalesce(u["capacity_registered"], F.lit(0.0))
        ).alias("capacity_mw"),
        F.exists(units, lambda u: u["status"] == "operating").alias("operating"),
    )


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Stations from a GeoJSON FeatureCollection; geometry stays text so both shapes parse."""
    schema = f"features array<struct<{_field_types()}>>"
    docs = spark.read.schema(schema).json(path, multiLine=True)
    one = docs.select(F.explode("features").alias("f"))
    return parse_features(one.select(F.to_json("f").alias("feature")))


def _field_types() -> str:
    return FEATURE.replace("geometry struct", "geometry:struct").replace("properties struct", "properties:struct")


def market_region(state: Column) -> Column:
    pairs = [F.lit(x) for kv in STATE_TO_REGION.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), state)


def station_tech(fuels: Column) -> Column:
    """Solar wins over wind where a station has both; neither gives NULL."""
    return F.when(F.arrays_overlap(fuels, F.array(*[F.lit(x) for x in SOLAR_FUELS])), "solar").when(
        F.arrays_overlap(fuels, F.array(*[F.lit(x) for x in WIND_FUELS])), "wind"
    )


def match_units(units: DataFrame, stations: DataFrame) -> DataFrame:
    """Station of each unit code: exact code first, else the longest station code it starts with.

    Instead of comparing every unit with every station, each unit is expanded to its own prefixes, up to
    the longest station code there is, and equi-joined on the code; the exact code is the longest prefix.
    Work is linear in units and nothing is broadcast.
    """
    longest = stations.agg(F.coalesce(F.max(F.length("station")), F.lit(0)).alias("n")).scalar()
    bounded = units.where(F.length("unit") > 0).withColumn("_most", F.least(F.length("unit"), longest)).where("_most > 0")
    prefixes = bounded.select("unit", F.explode(F.sequence(F.lit(1), F.col("_most"))).alias("n")).select(
        "unit", "n", F.substring("unit", F.lit(1), F.col("n")).alias("station")
    )
    best = prefixes.join(stations, "station").groupBy("unit").agg(F.max_by("station", "n").alias("station"))
    return best.select("unit", "station", (F.col("unit") == F.col("station")).alias("exact"))


def resolve_units(units: DataFrame, stations: DataFrame, allocation: DataFrame | None = None) -> DataFrame:
    """Units matched to operating solar or wind stations with positive capacity.

    An ``allocation`` (unit, station) that names a known station decides; other units go by code.
    """
    usable = stations.withColumn("tech", station_tech(F.col("fuels"))).where(
        F.col("operating") & (F.col("capacity_mw") > 0) & F.col("tech").isNotNull()
    )
    matched = match_units(units, stations.select("station")).select("unit", "station", F.lit(0).alias("_rank"))
    if allocation is not None:
        given = allocation.join(units.select("unit"), "unit", "left_semi").join(stations.select("station"), "station", "left_semi")
        matched = matched.unionByName(given.select("unit", "station", F.lit(1).alias("_rank")))
        matched = matched.groupBy("unit").agg(F.max_by("station", "_rank").alias("station"))
    return matched.drop("_rank").join(
        usable.select("station", "tech", "capacity_mw", "latitude", "longitude", "state"), "station"
    )


def first_by(frame: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """First ``n`` rows per key (bounded groups only)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
