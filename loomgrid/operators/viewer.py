"""Lookups that a map of the lines asks for, and small selections of the searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators.routes import segments


def shared_segments(routes: DataFrame) -> DataFrame:
    """``src, dst, u, v``: pairs of routes that use the same edge, by an equi-join on the edge."""
    own = segments(routes).select("route_id", "src", "dst").distinct()
    other = own.withColumnRenamed("route_id", "v")
    return own.withColumnRenamed("route_id", "u").join(other, ["src", "dst"]).filter("u < v").select("src", "dst", "u", "v")


def group_links(routes: DataFrame, groups: DataFrame) -> DataFrame:
    """``a, b``: groups that share a station."""
    member = routes.join(groups, "route_id").select("node_id", "group").distinct()
    other = member.select("node_id", F.col("group").alias("b"))
    return member.withColumnRenamed("group", "a").join(other, "node_id").filter("a < b").select("a", "b").distinct()


def vertex_lines(routes: DataFrame) -> DataFrame:
    """``node_id, lines``: the lines at each vertex, sorted."""
    return routes.groupBy("node_id").agg(F.array_sort(F.collect_set("route_id")).alias("lines"))


def line_profile(routes: DataFrame, nodes: DataFrame, stations: DataFrame) -> DataFrame:
    """``route_id, n_stations, length, first_stop, last_stop``; ends are the first and last vertices with a name.

    ``stations`` has ``node_id, is_station, name``.
    """
    at = Window.partitionBy("route_id").orderBy("pos")
    rows = routes.join(nodes.select("node_id", "x", "y"), "node_id").join(stations, "node_id", "left")
    rows = rows.withColumn("step", F.hypot(F.col("x") - F.lag("x").over(at), F.col("y") - F.lag("y").over(at)))
    named = F.when(F.col("name") != "", F.col("pos"))
    return rows.groupBy("route_id").agg(
        F.count_if("is_station").alias("n_stations"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), F.min_by("name", named).alias("first_stop"), F.max_by("name", named).alias("last_stop")
    )


def nearest_visible(clicks: DataFrame, nodes: DataFrame, routes: DataFrame, visible: DataFrame) -> DataFrame:
    """``click_id, node_id``: the node of a visible line nearest by the sum of coordinate differences.

    Clicks are few and are broadcast; ties go to the smallest node.
    """
    shown = nodes.join(routes.join(visible, "route_id", "left_semi"), "node_id", "left_semi")
    pairs = shown.join(F.broadcast(clicks.select("click_id", F.col("x").alias("cx"), F.col("y").alias("cy"))))
    gap = F.abs(F.col("x") - F.col("cx")) + F.abs(F.col("y") - F.col("cy"))
    return pairs.groupBy("click_id").agg(F.min_by("node_id", F.struct(gap, F.col("node_id"))).alias("node_id"))


def by_coordinate(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """Values keyed by ``kx, ky`` (micro-degrees) keyed by node instead; unmatched ones go. ``nodes`` has ``lon, lat``."""
    from loomgrid.functions.geo import micro

    keyed = nodes.select("node_id", micro(F.col("lon")).alias("kx"), micro(F.col("lat")).alias("ky"))
    return values.join(keyed, ["kx", "ky"]).drop("kx", "ky")


def strided(rows: DataFrame, index: Column, most: int, total: int) -> DataFrame:
    """Every k-th row by ``index`` (from 0), then the first ``most``."""
    step = max(1, total // most)
    return rows.filter((index % step == 0) & (index < step * most))


def combined_score(scores: DataFrame, demand: DataFrame, weight: float) -> DataFrame:
    """``node_id, score``: density score plus weighted demand; a node without demand adds nothing."""
    return scores.join(demand, "node_id", "left").select("node_id", (F.col("score") + weight * F.coalesce("demand", F.lit(0.0))).alias("score"))


def trained_score(*_args, **_kwargs) -> None:
    """A learned scorer needs a deep-learning library, which this engine does not use; callers fall back."""
    return None


def drawn_parts(df: DataFrame, kind: str = "geometry_type", coordinates: str = "coordinates") -> DataFrame:
    """``df`` with ``x, y`` of a point that stands for each geometry; rows without one go.

    ``coordinates`` is JSON text. Points are themselves, the others the mean of their vertices.
    """
    deep = {"Point": "array<double>", "MultiPoint": "array<array<double>>", "LineString": "array<array<double>>", "MultiLineString": "array<array<array<double>>>", "Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}
    points = F.lit(None).cast("array<array<double>>")
    for name, schema in deep.items():
        got = F.from_json(F.col(coordinates), schema)
        for _ in range(schema.count("array") - 2):
            got = F.flatten(got)
        points = F.when(F.col(kind) == name, F.array(got) if name == "Point" else got).otherwise(points)
    mean = lambda axis: F.aggregate(points, F.lit(0.0), lambda s, p: s + F.get(p, F.lit(axis))) / F.size(points)
    return df.withColumns({"x": mean(0), "y": mean(1)}).filter("x is not null and y is not null")
