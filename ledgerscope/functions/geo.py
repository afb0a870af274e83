"""Places, distances and speeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def fold_place(c: Column) -> Column:
    """Lower case, white space runs as one space, null as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points; null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def speed(km: Column, minutes: Column) -> Column:
    """Kilometres an hour; null if no time has passed."""
    return F.when(minutes > 0, km / (minutes / 60))


def locate(merchants: DataFrame, places: DataFrame) -> DataFrame:
    """(merchant_id, lat, lon): of the subdistrict, else of the district, else null."""
    named = places.select("kind", fold_place(F.col("place")).alias("name"), "lat", "lon")
    of = lambda kind: named.where(F.col("kind") == kind).select("name", F.struct("lat", "lon").alias(kind))
    joined = merchants.join(of("subdistrict").withColumnRenamed("name", "s"), fold_place(F.col("merchant_subdistrict")) == F.col("s"), "left")
    joined = joined.join(of("district").withColumnRenamed("name", "d"), fold_place(F.col("merchant_district")) == F.col("d"), "left")
    at = F.coalesce("subdistrict", "district")
    return joined.select("merchant_id", at["lat"].alias("lat"), at["lon"].alias("lon"))
