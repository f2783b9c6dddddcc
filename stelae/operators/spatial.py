"""Distances, radius search and spatial joins by grid cells; map tiles."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p = F.radians(lat2 - lat1) / 2
    q = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(p), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(q), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def within_radius(df: DataFrame, lat: float, lon: float, metres: float, lat_col: str = "lat", lon_col: str = "lon", uncertainty: str | None = None) -> DataFrame:
    """Rows whose circle of uncertainty comes within ``metres``; ``distance_m`` is from the circle's edge, 0 inside it.

    A box of latitudes is filtered first; it reaches the scan where uncertainty is bounded by a column's statistics.
    """
    far = haversine_km(F.lit(lat), F.lit(lon), F.col(lat_col), F.col(lon_col)) * 1000
    slack = F.coalesce(F.col(uncertainty), F.lit(0.0)) if uncertainty else F.lit(0.0)
    box = F.abs(F.col(lat_col) - lat) <= (metres + slack) / 110_000
    return df.where(box).withColumn("distance_m", F.greatest(far - slack, F.lit(0.0))).where(F.col("distance_m") <= metres)


def place_pairs(left: DataFrame, right: DataFrame, km: float, lat: str = "lat", lon: str = "lon", prefix: str = "r_") -> DataFrame:
    """(lat, lon, r_lat, r_lon, distance_km): pairs of different places within ``km``, anywhere on the sphere: points in space fall in cubes as
    wide as the chord of ``km``, the right side goes to its cube and the 26 around it, an equi-join on cubes, then the exact distance.
    Poles and the date line need no care, as cubes know neither. The join is by sorting: the size of the right side is known to Spark as
    it was before it went to 27 cubes, so it would be sent whole to all."""
    wide = max(2 * EARTH_KM * math.sin(min(km / (2 * EARTH_KM), math.pi / 2)) * 1.000001, 1e-6)

    def cubes(y: str, x: str) -> list[Column]:
        p, q = F.radians(F.col(y)), F.radians(F.col(x))
        return [F.floor(EARTH_KM * v / wide) for v in (F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p))]

    here = lambda y, x: F.struct(*[c.alias(f"c{k}") for k, c in enumerate(cubes(y, x))])
    around = F.array(*[F.struct(*[F.lit(v).alias(f"d{k}") for k, v in enumerate(d)]) for d in product((-1, 0, 1), repeat=3)])
    places = lambda df: df.select(lat, lon).where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).distinct()
    a = places(left).withColumn("_cube", here(lat, lon))
    b = places(right).select(F.col(lat).alias(prefix + lat), F.col(lon).alias(prefix + lon))
    b = b.withColumn("_at", here(prefix + lat, prefix + lon)).withColumn("_by", F.explode(around))
    b = b.withColumn("_cube", F.struct(*[(F.col(f"_at.c{k}") + F.col(f"_by.d{k}")).alias(f"c{k}") for k in range(3)])).drop("_at", "_by")
    far = haversine_km(F.col(lat), F.col(lon), F.col(prefix + lat), F.col(prefix + lon))
    return a.join(b.hint("merge"), "_cube").withColumn("distance_km", far).where(F.col("distance_km") <= km).drop("_cube")


def spatial_join(left: DataFrame, right: DataFrame, km: float, lat: str = "lat", lon: str = "lon", prefix: str = "r_") -> DataFrame:
    """Pairs of rows within ``km``, with ``distance_km``: rows of the pairs of places (:func:`place_pairs`), so a distance is worked out once
    however many rows stand at its ends. ``right`` columns get ``prefix``."""
    met = left.join(place_pairs(left, right, km, lat, lon, prefix).hint("merge"), [lat, lon])
    other = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    out = met.join(other.hint("merge"), [prefix + lat, prefix + lon])
    return out.select(*left.columns, *other.columns, "distance_km")


def nearest_within(left: DataFrame, right: DataFrame, right_id: str, km: float, k: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``left`` with ``right_id`` and ``distance_km`` of the ``k`` nearest rows of ``right`` within ``km``, of equal distances the lesser ids. They
    are found for each place of ``left`` once, and of a place of ``right`` no more than its ``k`` least ids can be among them."""
    from .search import first_per

    few = first_per(right.select(F.col(right_id).alias("_id"), F.col(lat).alias("r_" + lat), F.col(lon).alias("r_" + lon)), ["r_" + lat, "r_" + lon], [F.col("_id")], k)
    met = place_pairs(left, right, km, lat, lon).join(few.hint("merge"), ["r_" + lat, "r_" + lon]).select(lat, lon, F.col("_id").alias(right_id), "distance_km")
    return left.join(first_per(met, [lat, lon], [F.col("distance_km"), F.col(right_id)], k).hint("merge"), [lat, lon])


def place_and_time_score(distance_km: Column, years: Column) -> Column:
    """Kilometres plus a fiftieth of the years between; a missing year gives no score."""
    return distance_km + F.abs(years) / 50.0


def tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """(x, y) of the web map tile of a point."""
    n = 2**zoom
    r = F.radians(lat)
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n)
    return x, y


def agreement(lat1: Column, lon1: Column, lat2: Column, lon2: Column, km: float = 15.0) -> Column:
    far = haversine_km(lat1, lon1, lat2, lon2)
    return F.when(far <= km, "VERIFIED").otherwise("MANUAL_REVIEW_NEEDED")
