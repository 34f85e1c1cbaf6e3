"""GeoJSON layers and line files as typed tables, and back.

Collections are read with ``multiLine`` JSON and exploded, so the features of one file are spread over
the cluster only after it has been parsed; layers of many files are read in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions.geo import micro

POINT = "struct<type:string,coordinates:array<double>>"
LINE_PROPERTIES = """type string, line_id bigint, kde_values array<double>, segment_lengths array<double>, `group` bigint, name_list array<string>, is_station array<boolean>,
 route_kind string, service_status string, occupancy_pct double, delay_min double, accessibility_score double, is_accessible boolean, row_type string,
 construction_cost_musd double, ridership_estimate double"""
# The metadata that travels with a line.
METADATA = ("route_kind", "service_status", "occupancy_pct", "delay_min", "accessibility_score", "is_accessible", "row_type", "construction_cost_musd", "ridership_estimate")


def read_features(spark: SparkSession, path: str, properties: str, coordinates: str = "array<double>") -> DataFrame:
    """``feature_idx, geometry_type, coordinates`` and the declared properties of each feature.

    Property types are declared, never inferred: layers mix integers and floats in a column and have
    columns that are null everywhere.
    """
    fields = f"struct<{', '.join(_ddl(p) for p in _split(properties))}>" if properties.strip() else "struct<__none:string>"
    schema = f"type string, features array<struct<type:string,geometry:struct<type:string,coordinates:{coordinates}>,properties:{fields}>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("feature_idx", "f"))
    out = rows.select("feature_idx", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), "f.properties.*")
    return out.drop("__none")


def _split(ddl: str) -> list[str]:
    """Top-level fields of a schema string."""
    parts, depth, last = [], 0, ""
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(last)
            last = ""
        else:
            last += c
    return [p.strip() for p in [*parts, last] if p.strip()]


def _ddl(field: str) -> str:
    name, kind = field.split(None, 1)
    return f"{name}:{kind}"


def read_points(spark: SparkSession, path: str, properties: str = "") -> DataFrame:
    """Point features with ``lon, lat``; features without a point are dropped."""
    found = read_features(spark, path, properties).filter("geometry_type = 'Point' and size(coordinates) >= 2")
    return found.withColumns({"lon": F.get("coordinates", F.lit(0)), "lat": F.get("coordinates", F.lit(1))}).drop("coordinates", "geometry_type")


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines and their coordinates' stations from a lines file.

    The first table has one row a vertex, ``route_id, pos, kx, ky`` (micro-degrees, the node key), the second one
    row a coordinate, ``kx, ky, is_station, name``: the last line to speak of it decides, and for names the last
    that is not empty. Only features of type ``line`` count.
    """
    lines = read_features(spark, path, LINE_PROPERTIES, "array<array<double>>").filter("type = 'line'")
    at = lines.select(
        "feature_idx", "line_id", "group", "is_station", "name_list", F.posexplode("coordinates").alias("pos", "c")
    ).select(
        "feature_idx", F.coalesce("line_id", "feature_idx").alias("route_id"), "group", "pos", micro(F.get("c", F.lit(0))).alias("kx"), micro(F.get("c", F.lit(1))).alias("ky"),
        F.get("is_station", F.col("pos")).alias("flag"), F.nullif(F.get("name_list", F.col("pos")), F.lit("")).alias("label"),
    )
    order = F.struct("feature_idx", "pos")
    stations = at.groupBy("kx", "ky").agg(
        F.max_by("flag", F.when(F.col("flag").isNotNull(), order)).alias("is_station"), F.max_by("label", F.when(F.col("label").isNotNull(), order)).alias("name")
    )
    return at.select("route_id", "group", "pos", "kx", "ky"), stations


def point_features(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``feature``: each row as a GeoJSON point feature in text."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    body = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties") if rest else F.create_map().alias("properties")
    )
    return df.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("feature"))


def graph_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, feature``: nodes as points and edges, of which both ends have a place, as lines."""
    place = nodes.select("node_id", "lon", "lat")
    a = place.select(F.col("node_id").alias("src"), F.array("lon", "lat").alias("ca"))
    b = place.select(F.col("node_id").alias("dst"), F.array("lon", "lat").alias("cb"))

    def feature(kind: str, shape: str, coordinates: Column, properties: Column) -> Column:
        return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(shape).alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")))

    points = place.select(F.lit("node").alias("kind"), feature("node", "Point", F.array("lon", "lat"), F.struct(F.lit("node").alias("type"), F.col("node_id").alias("id"))).alias("feature"))
    lines = edges.join(a, "src").join(b, "dst").select(
        F.lit("edge").alias("kind"), feature("edge", "LineString", F.array("ca", "cb"), F.struct(F.lit("edge").alias("type"), F.col("src").alias("source"), F.col("dst").alias("target"))).alias("feature")
    )
    return points.unionByName(lines)


def line_rows(routes: DataFrame, nodes: DataFrame, edges: DataFrame, groups: DataFrame, stations: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """One row a line with its vertex arrays, as lines files hold them.

    ``nodes`` has ``node_id, lon, lat, x, y, score``; ``stations`` has ``node_id, is_station, name``. Lines with a node without a place, a
    step that is no edge or fewer than two nodes are dropped; the others keep their number.
    """
    placed = routes.join(nodes.select("node_id", "lon", "lat", "x", "y", "score"), "node_id", "left").join(stations.select("node_id", "is_station", "name"), "node_id", "left")
    w = Window.partitionBy("route_id").orderBy("pos")
    step = placed.withColumns({"next": F.lead("node_id").over(w), "nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    known = edges.select(F.col("src").alias("__a"), F.col("dst").alias("__b"), F.lit(True).alias("known"))
    step = step.join(known, (F.least("node_id", "next") == F.col("__a")) & (F.greatest("node_id", "next") == F.col("__b")), "left")
    step = step.withColumn("broken", F.col("lon").isNull() | (F.col("next").isNotNull() & F.col("known").isNull()))
    vertex = F.struct("pos", "lon", "lat", "score", F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")).alias("length"), "is_station", "name")
    lines = step.groupBy("route_id").agg(F.array_sort(F.collect_list(vertex)).alias("v"), F.max("broken").alias("broken")).filter((~F.col("broken")) & (F.size("v") > 1))
    pick = lambda of: F.transform("v", of)
    lines = lines.join(groups, "route_id", "left").select(
        F.col("route_id").alias("line_id"), "group", pick(lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"), pick(lambda p: p["score"]).alias("kde_values"),
        F.filter(pick(lambda p: p["length"]), lambda x: x.isNotNull()).alias("segment_lengths"), pick(lambda p: F.coalesce(p["is_station"], F.lit(True))).alias("is_station"), pick(lambda p: F.coalesce(p["name"], F.lit(""))).alias("name_list"),
    )
    if metadata is not None:
        lines = lines.join(metadata.select("line_id", *[c for c in METADATA if c in metadata.columns]), "line_id", "left")
    return lines


def line_features(lines: DataFrame) -> DataFrame:
    """``feature``: rows of ``line_rows`` as GeoJSON text."""
    rest = [c for c in lines.columns if c != "coordinates"]
    body = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.col("coordinates")).alias("geometry"), F.struct(F.lit("line").alias("type"), *rest).alias("properties"))
    return lines.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("feature"))


def update_lines(lines: DataFrame, values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lines with ``columns`` replaced by those of ``values`` with the same ``line_id``; lines without keep theirs."""
    fresh = values.select("line_id", *[F.col(c).alias(f"__{c}") for c in columns])
    joined = lines.join(fresh, "line_id", "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) if c in lines.columns else F.col(f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def has_values(lines: DataFrame, column: str) -> bool:
    """Whether any line has a value already; stops at the first."""
    return column in lines.columns and not lines.filter(F.col(column).isNotNull()).limit(1).isEmpty()


def write_collection(features: DataFrame, path: str, column: str = "feature") -> None:
    """One GeoJSON collection in one file, for viewers; large layers are better left as ``to_json`` text parts.

    Features are streamed to the driver partition by partition, and from there to any store that Spark can write to.
    """
    context = features.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(b'{"type": "FeatureCollection", "features": [')
        for i, row in enumerate(features.select(column).toLocalIterator()):
            out.write((("," if i else "") + "\n" + row[0]).encode("utf-8"))
        out.write(b"\n]}\n")
    finally:
        out.close()
