"""File formats, stages, the command line and the stream."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from loomgrid.__main__ import main
from loomgrid.plans.report import fixed_width
from loomgrid.plans.stages import STAGES, Config, run_stages
from loomgrid.operators import generators
from loomgrid.sources import assembly, geojson, tables
from loomgrid.sources.shapefile import read_shapefile
from loomgrid.streaming.boardings import hourly_boardings


def test_points(spark, tmp_path):
    path = tmp_path / "stops.geojson"
    features = [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-77.0, 38.9]}, "properties": {"NAME": "a", "STOPMEAS": 3, "GONE": None}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-77.1, 38.8]}, "properties": {"NAME": "b", "STOPMEAS": 2.5}},
        {"type": "Feature", "geometry": None, "properties": {"NAME": "c"}},
    ]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = geojson.read_points(spark, str(path), "NAME string, STOPMEAS double, GONE string").orderBy("feature_idx").collect()
    assert [(r["NAME"], r["STOPMEAS"], r["lon"]) for r in rows] == [("a", 3.0, -77.0), ("b", 2.5, -77.1)]
    geojson.write_collection(geojson.point_features(spark.createDataFrame([(1.0, 2.0, "x")], "lon double, lat double, name string")), str(tmp_path / "out.geojson"))
    assert json.loads((tmp_path / "out.geojson").read_text())["features"][0]["geometry"]["coordinates"] == [1.0, 2.0]


def test_lines_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(i, i / 10, 1.0, i * 100.0, 0.0, i * 1.0) for i in range(6)], "node_id long, lon double, lat double, x double, y double, score double")
    routes = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 0), (1, 1, 5), (2, 0, 3), (2, 1, 2), (3, 0, 4), (3, 1, 99), (4, 0, 1)], "route_id long, pos int, node_id long")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    groups = spark.createDataFrame([(i, i) for i in range(5)], "route_id long, group long")
    stations = spark.createDataFrame([(0, True, "A"), (1, False, ""), (2, True, "C")], "node_id long, is_station boolean, name string")
    lines = geojson.line_rows(routes, nodes, edges, groups, stations)
    got = {r["line_id"]: r for r in lines.collect()}
    assert sorted(got) == [0, 2]
    assert got[0]["segment_lengths"] == [100.0, 100.0] and got[0]["is_station"] == [True, False, True] and got[0]["name_list"] == ["A", "", "C"]
    with_cost = geojson.update_lines(lines, spark.createDataFrame([(2, 7.5)], "line_id long, construction_cost_musd double"), ["construction_cost_musd"])
    assert {r["line_id"]: r["construction_cost_musd"] for r in with_cost.collect()} == {0: None, 2: 7.5}
    assert geojson.has_values(with_cost, "construction_cost_musd") and not geojson.has_values(lines, "construction_cost_musd")
    path = str(tmp_path / "lines.geojson")
    geojson.write_collection(geojson.line_features(with_cost), path)
    vertices, stops = geojson.read_lines(spark, path)
    assert sorted((r["route_id"], r["pos"], r["kx"]) for r in vertices.collect()) == [(0, 0, 0), (0, 1, 100000), (0, 2, 200000), (2, 0, 300000), (2, 1, 200000)]
    assert {r["kx"]: (r["is_station"], r["name"]) for r in stops.collect()} == {0: (True, "A"), 100000: (False, None), 200000: (True, "C"), 300000: (True, None)}
    graph = geojson.graph_features(nodes.limit(3), edges)
    assert sorted(r["kind"] for r in graph.collect()) == ["edge", "edge", "node", "node", "node"]


def test_tables(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "od.csv.gz", "wt") as f:
        f.write("w_geocode,h_geocode,S000\n11001000100,240310000000001,3\n")
    row = tables.read_flows(spark, str(tmp_path / "od.csv.gz"), 2).collect()[0]
    assert (row["w_geocode"], row["h_geocode"], row["S000"]) == ("000011001000100", "240310000000001", 3)
    both = tables.read_many(spark, [lambda: tables.read_flows(spark, str(tmp_path / "od.csv.gz")), lambda: tables.read_flows(spark, "/nowhere/x.csv")], tables.FLOWS)
    assert both.count() == 1
    assert tables.read_many(spark, [lambda: spark.read.csv("/nowhere")], tables.FLOWS).columns == ["w_geocode", "h_geocode", "S000"]
    survey = tables.survey_table(spark, [["B19013_001E", "state", "county", "tract"], ["100", "11", "001", "000100"], [None, "11", "001", "000200"]])
    assert [(r["median_income"], r["GEOID"]) for r in survey.orderBy("GEOID").collect()] == [(100.0, "11001000100"), (None, "11001000200")]
    tables.write_csv(survey, str(tmp_path / "acs"), compress=True)
    assert tables.read_csv(spark, str(tmp_path / "acs"), "median_income double, state string, county string, tract string, GEOID string, geography_level string").count() == 2


def test_services(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"sources": [{"name": "shops", "url": "file:///none", "state": "DC", "required_columns": ["NAME"], "other": 1}]}))
    (source,) = tables.read_manifest(str(tmp_path / "m.json"))
    answer = {"features": [{"attributes": {"NAME": "a", "k": "1"}, "properties": {"k": "2"}, "geometry": {"x": 1.0, "y": 2.0}}, {"attributes": {"lon": "5", "lat": "6"}}, {"attributes": {}, "geometry": {"rings": [[[0, 0], [2, 0], [2, 2], [0, 2]]]}}]}
    (tmp_path / "shops.json").write_text(json.dumps(answer))
    rows = tables.load_source(spark, source, str(tmp_path)).orderBy("source_index").collect()
    assert [(r["x"], r["y"], r["geometry_kind"]) for r in rows] == [(1.0, 2.0, "point"), (5.0, 6.0, "point"), (1.0, 1.0, "polygon")]
    assert rows[0]["attributes"] == {"NAME": "a", "k": "2"} and rows[0]["source_state"] == "DC"
    entry = tables.catalog(spark, [source], str(tmp_path)).collect()[0]
    assert entry["rows"] == 3 and entry["issues"] == ["missing columns: 1"]
    with pytest.raises(ValueError):
        tables.catalog(spark, [source], str(tmp_path), strict=True)
    (tmp_path / "bad.json").write_text("3")
    with pytest.raises(ValueError):
        tables.read_manifest(str(tmp_path / "bad.json"))
    boxes = spark.createDataFrame([("0", 0.0, 0.0, 1.0, 1.0), ("1", 0.0, 0.0, 0.05, 0.05)], "box_id string, w double, s double, e double, n double")
    assert sorted(r["box_id"] for r in tables.quarter_boxes(boxes, boxes, 1).collect()) == ["00", "01", "02", "03"]
    assert tables.quarter_boxes(boxes, boxes, 3).count() == 0


def write_shapefile(base, shapes, names):
    records = b""
    for i, body in enumerate(shapes):
        records += struct.pack(">2i", i + 1, len(body) // 2) + body
    base.with_suffix(".shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + records)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14
    rows = b"".join(b" " + n.encode().ljust(10) for n in names)
    base.with_suffix(".dbf").write_bytes(struct.pack("<4BIHH20x", 3, 124, 1, 1, len(names), 65, 11) + field + b"\r" + rows)


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
    polygon = struct.pack("<i4d2ii", 5, 0, 0, 2, 2, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    write_shapefile(tmp_path / "a", [struct.pack("<i2d", 1, 3.0, 4.0), polygon], ["first", "second"])
    rows = read_shapefile(spark, str(tmp_path / "a.shp")).orderBy("NAME").collect()
    assert (rows[0]["NAME"], rows[0]["kind"], rows[0]["x"], rows[0]["y"]) == ("first", "point", 3.0, 4.0)
    assert rows[1]["kind"] == "polygon" and len(rows[1]["rings"][0]) == 5
    assert read_shapefile(spark, str(tmp_path / "none.shp")) is None
    with pytest.raises(FileNotFoundError):
        read_shapefile(spark, str(tmp_path / "none.shp"), required=True)


def test_stages(spark, tmp_path):
    limits = generators.Limits(routes=2, low=1_000.0, high=80_000.0, min_angle=60.0)
    config = Config((tmp_path / "out").as_uri(), "/root/testdata/sf0.001", limits=limits, contract=False, rounds=1)
    names = ["region", "transit_points", "graph_points", "network", "gnn_scoring", "lodes", "naive", "row_snap", "cost", "ridership", "evaluate", "evaluate_extended"]
    assert set(run_stages(spark, config, names, workers=2)) == set(names)
    assert set(run_stages(spark, config, names)) == {"cost", "ridership"}
    read = lambda t: spark.read.parquet(f"{config.out}/{t}")
    row = read("evaluation_extended").collect()[0]
    assert row["variant"] == "naive" and 0 <= row["pop_gini"] < 1 and row["cov_5000"] <= row["cov_20000"]
    assert read("cost_naive").count() == read("routes_naive").select("route_id").distinct().count()
    with pytest.raises(ValueError):
        run_stages(spark, config, ["nonsense"])
    assert len(STAGES) == 15


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1, 2.0), ("2024-01-01 00:50:00", 1, 3.0), ("2024-01-01 01:10:00", 2, 1.0)]
    events = spark.createDataFrame(rows, "t string, station_id long, boardings double").select(F.to_timestamp("t").alias("ts"), "station_id", "boardings")
    batch = sorted((str(r["window_start"]), r["station_id"], r["boardings"], r["riders"]) for r in hourly_boardings(events).collect())
    assert batch == [("2024-01-01 00:00:00", 1, 5.0, 2), ("2024-01-01 01:00:00", 2, 1.0, 1)]
    events.write.parquet(str(tmp_path / "in"))
    stream = hourly_boardings(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    job = stream.writeStream.format("memory").queryName("hourly_out").outputMode("complete").trigger(availableNow=True).start()
    job.awaitTermination(60)
    assert sorted((str(r["window_start"]), r["station_id"], r["boardings"], r["riders"]) for r in spark.table("hourly_out").collect()) == batch


def test_assembled_layers(spark, tmp_path):
    counties = spark.createDataFrame([("MD", "24031", 1), ("MD", "24033", 2), ("VA", "51031", 3), ("VA", "51013", 4), ("DC", "11001", 5), (None, "24031", 6)], "STATE string, FIPS string, n int")
    codes = spark.createDataFrame([("MD", "031"), ("VA", "013"), ("VA", "013"), ("DC", "777")], "state string, code string")
    assert sorted(r["n"] for r in assembly.county_shapes(counties, codes).collect()) == [1, 4, 5]
    points = spark.createDataFrame([("a", -77.0, 38.9), ("b", None, 38.0)], "TITLE string, lon double, lat double")
    shell, hole = [[0.0, 0.0], [0.04, 0.0], [0.04, 0.04], [0.0, 0.04]], [[0.03, 0.03], [0.03, 0.01], [0.01, 0.01], [0.01, 0.03]]
    shapes = spark.createDataFrame([("square", [shell]), ("ring", [shell, hole]), ("flat", [[[0.0, 0.0], [1.0, 0.0]]])], "NAME string, rings array<array<array<double>>>")
    got = {r["label"]: (r["x"], r["y"]) for r in assembly.neighbourhoods([assembly.point_layer(points, "TITLE"), assembly.polygon_layer(shapes, "NAME")]).collect()}
    middle = 0.02 * 3.141592653589793 / 180 * 6378137
    assert set(got) == {"a", "square", "ring"} and got["square"] == pytest.approx((middle, middle), rel=1e-6) and got["ring"] == pytest.approx((middle, middle), rel=1e-6)
    stops = spark.createDataFrame([(1_000_000, 0, True, "x"), (2_000_000, 0, False, None), (3_000_000, 0, None, None)], "kx long, ky long, is_station boolean, name string")
    row = assembly.line_stations(stops).collect()
    assert [r["name"] for r in row] == ["x"] and row[0]["x"] == pytest.approx(6378137 * 3.141592653589793 / 180)


def test_service_shapes(spark):
    kind = "geometry struct<x:double,y:double,points:array<array<double>>,paths:array<array<array<double>>>,rings:array<array<array<double>>>>"
    ring, hole = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0]]
    rows = [((1.0, 2.0, None, None, None),), ((None, None, [[1.0, 2.0], [3.0, 4.0]], None, None),), ((None, None, None, [ring, hole], None),), ((None, None, None, None, [ring, hole]),), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(tables.service_shape(F.col("geometry"))).collect()]
    assert got == [[[[1.0, 2.0]]], [[[1.0, 2.0], [3.0, 4.0]]], [ring], [ring, hole], None]


def test_fixed_width(spark):
    df = spark.createDataFrame([("aco", 12.345, None), ("naive", 1.0, 3)], "variant string, pct double, n int").orderBy("variant")
    assert fixed_width(df, (("variant", "network", "8s"), ("pct", "cov %", "8.1f"), ("n", "n", "4d"))).split("\n") == [
        "network      cov %     n", "--------  --------  ----", "aco           12.3   n/a", "naive          1.0     3",
    ]


def test_genetic_command(spark, tmp_path, capsys):
    size = 6
    nodes = [(size * i + j, 1000.0 * i, 1000.0 * j, 1.0 + (i * j) % 3) for i in range(size) for j in range(size)]
    edges = [(size * i + j, size * (i + di) + j + dj, 1000.0) for i in range(size) for j in range(size) for di, dj in ((1, 0), (0, 1)) if i + di < size and j + dj < size]
    spark.createDataFrame(nodes, "node_id long, x double, y double, score double").write.parquet(str(tmp_path / "n"))
    spark.createDataFrame(edges, "src long, dst long, weight double").write.parquet(str(tmp_path / "e"))
    asked = ["genetic", "--nodes", str(tmp_path / "n"), "--edges", str(tmp_path / "e"), "--out", str(tmp_path / "o"), "--population", "4", "--generations", "2", "--routes", "2", "--min-km", "3", "--max-km", "9"]
    assert main(asked) == 0
    assert capsys.readouterr().out.count("generation") == 2
    made = spark.read.parquet(str(tmp_path / "o"))
    assert made.select("route_id").distinct().count() == 2
