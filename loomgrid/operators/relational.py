"""Keyed joins, unions, de-duplication and top-k with explicit order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.geo import micro
from loomgrid.functions.scalars import has_token, prefix


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``; a partial aggregation, so a hot key sends one row a task."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*[F.col(f"__row.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def left_attach(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Left join to the first right row of each key, with only ``columns`` of it.

    Without any of ``columns`` on the right, or without the key, the left side is returned as it is.
    """
    wanted = [c for c in columns if c in right.columns]
    if key not in left.columns or key not in right.columns or not wanted:
        return left
    return left.join(first_by_key(right, [key], order).select(key, *wanted), key, "left")


def concat_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedupe_points(points: DataFrame, order: Sequence[Column], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One row for each coordinate at six decimals, the first in ``order``."""
    keyed = points.withColumns({"__kx": micro(F.col(lon)), "__ky": micro(F.col(lat))})
    return first_by_key(keyed, ["__kx", "__ky"], order).drop("__kx", "__ky")


def token_filter(df: DataFrame, tokens: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.filter(has_token(tokens, *[F.col(c) for c in columns]))


def tract_flows(od: DataFrame, length: int = 11) -> DataFrame:
    """``w_tract, h_tract, jobs``: flows summed by the prefixes of both ends."""
    cut = od.select(prefix(F.col("w_geocode"), length).alias("w_tract"), prefix(F.col("h_geocode"), length).alias("h_tract"), "S000")
    return cut.groupBy("w_tract", "h_tract").agg(F.sum("S000").alias("jobs"))


def tract_centroids(blocks: DataFrame, length: int = 11) -> DataFrame:
    """``tract, x, y``: mean of the distinct block centroids of each tract."""
    spots = blocks.select(prefix(F.col("geoid"), length).alias("tract"), "x", "y").distinct()
    return spots.groupBy("tract").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def top_flows(flows: DataFrame, centroids: DataFrame, k: int = 5000) -> DataFrame:
    """The ``k`` largest flows, placed at the work tract and scaled by the largest that could be placed."""
    top = flows.orderBy(F.col("jobs").desc(), "w_tract", "h_tract").limit(k)
    placed = top.join(centroids, top["w_tract"] == centroids["tract"]).drop("tract")
    most = placed.agg(F.max("jobs").alias("most"))
    return placed.join(F.broadcast(most)).select("w_tract", "h_tract", "x", "y", "jobs", (F.col("jobs") / F.nullif(F.col("most"), F.lit(0))).alias("demand_score"))


def station_flows(flows: DataFrame, tract_station: DataFrame, catchment: float) -> DataFrame:
    """``work_station, home_station, jobs`` over flows whose both tracts have a station in ``catchment``.

    ``tract_station`` has ``tract, station_id, dist``.
    """
    near = tract_station.filter(F.col("dist") <= catchment).select("tract", "station_id")
    work = near.withColumnsRenamed({"tract": "w_tract", "station_id": "work_station"})
    home = near.withColumnsRenamed({"tract": "h_tract", "station_id": "home_station"})
    return flows.join(work, "w_tract").join(home, "h_tract").groupBy("work_station", "home_station").agg(F.sum("jobs").alias("jobs"))


def flow_matrix(pairs: DataFrame, stations: Sequence[int]) -> DataFrame:
    """Dense matrix: one row a work station, one column a home station, zeros where no one travels."""
    grid = pairs.groupBy("work_station").pivot("home_station", list(stations)).agg(F.sum("jobs"))
    rows = pairs.sparkSession.createDataFrame([(s,) for s in stations], "work_station long")
    return rows.join(grid, "work_station", "left").fillna(0)


def validation(df: DataFrame, required: Sequence[str], x: str = "x", y: str = "y", srid: int | None = None) -> DataFrame:
    """``issue, n``: problems of a layer, from one pass over it."""
    found = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(x).isNull() | F.col(y).isNull()).alias("empty"), F.count_if(F.isnan(x) | F.isnan(y)).alias("bad"))
    missing = len([c for c in required if c not in df.columns])
    issues = F.array(
        F.struct(F.lit("no rows").alias("issue"), (F.col("n") == 0).cast("long").alias("n")),
        F.struct(F.lit("null geometry").alias("issue"), F.col("empty").alias("n")),
        F.struct(F.lit("invalid geometry").alias("issue"), F.col("bad").alias("n")),
        F.struct(F.lit("missing columns").alias("issue"), F.lit(missing).cast("long").alias("n")),
        F.struct(F.lit("missing srid").alias("issue"), F.lit(int(srid is None)).cast("long").alias("n")),
    )
    return found.select(F.inline(issues)).filter("n > 0")
