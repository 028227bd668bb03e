"""Facet filters as document sets, and facet counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import haversine_km
from ..plans.index import LexicalIndex

EARTH_DEGREE_KM = 6371.0 * math.pi / 180


def is_range(value) -> bool:
    return isinstance(value, dict) and bool({"min", "max"} & set(value))


def is_geo(value) -> bool:
    return isinstance(value, dict) and "radius_km" in value


def values_of(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value) if isinstance(value, (list, tuple)) else []


def facet_types(index: LexicalIndex, names: list[str]) -> dict[str, str]:
    """Kind of each of the named facet fields that the index has."""
    if not names:
        return {}
    wanted = F.col("field").isin(*names)
    kinds = index.facet_values.where(wanted).select("field", "type").union(index.facet_geo.where(wanted).select("field", F.lit("geo")))
    return {r[0]: r[1] for r in kinds.distinct().collect()}


def near(lat: float, lon: float, radius_km: float) -> Column:
    """Within the radius; a box that contains it comes first, which the scan can use."""
    reach = radius_km / EARTH_DEGREE_KM
    box = F.col("lat").between(lat - reach - 1e-9, lat + reach + 1e-9)
    cos = math.cos(math.radians(lat))
    top = math.sin(math.radians(min(reach, 90)))
    if abs(lat) + reach < 90 and top < cos and abs(lon) + math.degrees(math.asin(top / cos)) <= 180:
        side = math.degrees(math.asin(top / cos))
        box = box & F.col("lon").between(lon - side - 1e-9, lon + side + 1e-9)
    return box & (haversine_km(F.lit(float(lat)), F.lit(float(lon)), F.col("lat"), F.col("lon")) <= radius_km)


def docs_of(index: LexicalIndex, name: str, kind: str, value) -> DataFrame:
    """(doc_id) that a filter on one field lets through; a filter of the wrong shape lets none."""
    if kind == "geo":
        rows = index.facet_geo.where(F.col("field") == name)
        return rows.where(near(value["lat"], value["lon"], value["radius_km"]) if is_geo(value) else F.lit(False)).select("doc_id").distinct()
    if kind == "range":
        rows = index.facet_range.where(F.col("field") == name)
        if not is_range(value):
            return rows.where(F.lit(False)).select("doc_id")
        for key, op in (("min", "__ge__"), ("max", "__le__")):
            if value.get(key) is not None:
                rows = rows.where(getattr(F.col("value"), op)(float(value[key])))
        return rows.select("doc_id").distinct()
    wanted = values_of(value)
    return index.facet_values.where((F.col("field") == name) & (F.col("value").isin(*wanted) if wanted else F.lit(False))).select("doc_id").distinct()


def facet_counts(index: LexicalIndex, name: str, base: DataFrame | None, selected: list[str]) -> DataFrame:
    """(value, count, selected) in order of value; values without a document in ``base`` count 0.

    ``base`` None stands for all documents.
    """
    rows = index.facet_values.where(F.col("field") == name)
    if base is None:
        counted = rows.groupBy("value").agg(F.count_distinct("doc_id").alias("count"))
    else:
        hit = base.select("doc_id").distinct().withColumn("hit", F.lit(1))
        counted = rows.join(hit, "doc_id", "left").groupBy("value").agg(F.count("hit").alias("count"))
    chosen = F.col("value").isin(*selected) if selected else F.lit(False)
    return counted.select("value", "count", chosen.alias("selected")).orderBy("value")
