"""Layers that are put together from several sources: counties, neighbourhoods and stations of a lines file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.geo import mercator_x, mercator_y, ring_terms
from loomgrid.operators.relational import concat_sources


def county_shapes(counties: DataFrame, codes: DataFrame, whole_states: Sequence[str] = ("DC",)) -> DataFrame:
    """The counties of ``codes`` (``state, code``; three digits) and all those of ``whole_states``.

    ``counties`` has ``STATE`` and a five-digit ``FIPS``, whose last three digits are the code. A county is kept once
    however often it is listed; rows without a state or code go.
    """
    wanted = F.broadcast(codes.select(F.col("state").alias("__state"), F.col("code").alias("__code")).distinct())
    listed = ~F.col("STATE").isin(*whole_states) if whole_states else F.lit(True)
    some = counties.filter(listed).join(wanted, (F.col("STATE") == F.col("__state")) & (F.substring("FIPS", 3, 3) == F.col("__code")), "left_semi")
    return some.unionByName(counties.filter(F.col("STATE").isin(*whole_states))) if whole_states else some


def point_layer(layer: DataFrame, name: str) -> DataFrame:
    """``NAME, x, y`` in web-mercator of a layer with ``lon, lat``."""
    return layer.select(F.col(name).alias("NAME"), mercator_x(F.col("lon")).alias("x"), mercator_y(F.col("lat")).alias("y"))


def polygon_layer(layer: DataFrame, name: str, rings: str = "rings") -> DataFrame:
    """``NAME, x, y``: centroids in web-mercator of polygons whose ``rings`` are arrays of lon, lat pairs.

    Rings are projected first. Shells and holes count by their signed areas, so they must run in opposite
    directions; a polygon without area gets no place.
    """
    spot = lambda c: F.struct(mercator_x(F.get(c, F.lit(0))).alias("x"), mercator_y(F.get(c, F.lit(1))).alias("y"))
    terms = F.transform(rings, lambda ring: F.struct(*[t.alias(n) for t, n in zip(ring_terms(F.transform(ring, spot)), ("a", "cx", "cy"))]))
    total = lambda n: F.aggregate(terms, F.lit(0.0), lambda s, t: s + t[n])
    area = F.nullif(3 * total("a"), F.lit(0.0))
    return layer.select(F.col(name).alias("NAME"), (total("cx") / area).alias("x"), (total("cy") / area).alias("y"))


def neighbourhoods(layers: Sequence[DataFrame]) -> DataFrame:
    """``place_id, label, x, y`` of point and polygon layers together; ids follow the place, not the order of reading."""
    both = concat_sources(list(layers)).filter("x is not null and y is not null")
    return both.select(F.xxhash64("NAME", "x", "y").alias("place_id"), F.col("NAME").alias("label"), "x", "y").distinct()


def line_stations(stations: DataFrame) -> DataFrame:
    """``station_id, name, x, y`` of the stations that ``read_lines`` found, in web-mercator."""
    lon, lat = F.col("kx") / 1e6, F.col("ky") / 1e6
    return stations.filter("is_station").select(F.xxhash64("kx", "ky").alias("station_id"), "name", mercator_x(lon).alias("x"), mercator_y(lat).alias("y"))
