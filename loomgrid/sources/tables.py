"""Delimited tables, job flows, survey matrices, feature services and manifests."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.scalars import zfill

FLOWS = "w_geocode string, h_geocode string, S000 long"
# Survey variables and the names under which they are kept.
SURVEY = {"B19013_001E": "median_income", "B17001_002E": "poverty_rate", "B18101_001E": "disability_rate", "B08202_002E": "no_vehicle_rate"}


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """CSV with a header and a declared schema; gzip is read as it is. Codes stay text."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_flows(spark: SparkSession, path: str | Sequence[str], partitions: int | None = None) -> DataFrame:
    """Job flows with 15-digit codes. A gzip file is one task, so its rows are spread before they are used."""
    rows = spark.read.option("header", True).csv(path).select(zfill(F.col("w_geocode"), 15).alias("w_geocode"), zfill(F.col("h_geocode"), 15).alias("h_geocode"), F.col("S000").try_cast("long").alias("S000"))
    return rows.repartition(partitions) if partitions else rows


def read_many(spark: SparkSession, readers: Sequence[Callable[[], DataFrame]], schema: str) -> DataFrame:
    """All readers' rows; readers that fail are left out, and if all do, the table is empty."""
    found = []
    for read in readers:
        try:
            frame = read()
            frame.schema  # noqa: B018  resolves the plan
            found.append(frame)
        except Exception as e:  # noqa: BLE001  a source that is down must not stop the others
            print(f"skipped a source: {e}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else spark.createDataFrame([], schema)


def fetch(url: str, path: str, force: bool = False, timeout: float = 60.0) -> str | None:
    """Download ``url`` to ``path`` on the driver unless it is there; None if that fails."""
    target = Path(path)
    if target.exists() and not force:
        return path
    try:
        with urllib.request.urlopen(url, timeout=timeout) as response:  # noqa: S310
            data = response.read()
    except OSError:
        return None
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(data)
    return path


def survey_table(spark: SparkSession, matrix: Sequence[Sequence[str]]) -> DataFrame:
    """A REST matrix, first row names, as numbers by canonical name, with ``GEOID`` and ``geography_level``."""
    header, rows = list(matrix[0]), [tuple(r) for r in matrix[1:]]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in header))
    df = df.withColumns({new: F.col(old).try_cast("double") for old, new in SURVEY.items() if old in header}).drop(*SURVEY)
    return df.withColumns({"GEOID": F.concat("state", "county", "tract"), "geography_level": F.lit("tract")})


def write_csv(df: DataFrame, path: str, compress: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if compress else "none").csv(path)


@dataclass(frozen=True)
class Source:
    """One feature service of a manifest."""

    name: str
    url: str
    state: str = ""
    category: str = ""
    cache_subdir: str = ""
    geometry_hint: str = ""
    required_columns: tuple[str, ...] = ()
    extra_properties: dict[str, str] = field(default_factory=dict)


def read_manifest(path: str) -> list[Source]:
    """Sources from a JSON list or from an object's ``sources``; anything else is a ValueError."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    rows = data.get("sources") if isinstance(data, dict) else data
    if not isinstance(rows, list):
        raise ValueError("a manifest is a list or has a list 'sources'")
    known = Source.__dataclass_fields__
    return [Source(**{k: tuple(v) if k == "required_columns" else v for k, v in r.items() if k in known}) for r in rows]


def service_point(geometry: Column, attributes: Column) -> tuple[Column, Column]:
    """``x, y`` of a service geometry: a point, the first of its points, the middle of its first path or ring.

    ``geometry`` is a struct of ``x, y, points, paths, rings``. Without one, ``lon``/``lat`` attributes are tried.
    """
    first = lambda c: F.get(geometry[c], F.lit(0))

    def middle(ring: Column, axis: int) -> Column:
        return F.aggregate(ring, F.lit(0.0), lambda s, p: s + F.get(p, F.lit(axis))) / F.size(ring)

    def hint(*names: str) -> Column:
        return F.coalesce(*[F.try_element_at(attributes, F.lit(n)).try_cast("double") for n in names])

    x = F.coalesce(geometry["x"], F.get(first("points"), F.lit(0)), middle(first("paths"), 0), middle(first("rings"), 0), hint("lon", "longitude", "x"))
    y = F.coalesce(geometry["y"], F.get(first("points"), F.lit(1)), middle(first("paths"), 1), middle(first("rings"), 1), hint("lat", "latitude", "y"))
    return x, y


def service_shape(geometry: Column) -> Column:
    """``array<array<array<double>>>``: a point as one path of one, points as a path, the first of several paths, or all rings, the shell first."""
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    point = F.when(geometry["x"].isNotNull() & geometry["y"].isNotNull(), F.array(F.array(F.array(geometry["x"], geometry["y"]))))
    return F.coalesce(point, one(geometry["points"]), one(F.get(geometry["paths"], F.lit(0))), geometry["rings"])


SERVICE = "features array<struct<attributes:map<string,string>,properties:map<string,string>,geometry:struct<x:double,y:double,points:array<array<double>>,paths:array<array<array<double>>>,rings:array<array<array<double>>>>>>"


def service_rows(spark: SparkSession, path: str, source: Source) -> DataFrame:
    """Rows of a cached feature-service answer: position, merged attributes and where they came from."""
    rows = spark.read.schema(SERVICE).option("multiLine", True).json(path).select(F.posexplode("features").alias("source_index", "f"))
    empty = F.create_map().cast("map<string,string>")
    merged = F.map_concat(F.map_filter(F.coalesce("f.attributes", empty), lambda k, _: ~F.map_contains_key(F.coalesce("f.properties", empty), k)), F.coalesce("f.properties", empty))
    x, y = service_point(F.col("f.geometry"), merged)
    kind = F.when(F.col("f.geometry.rings").isNotNull(), "polygon").when(F.col("f.geometry.paths").isNotNull(), "line").otherwise("point")
    return rows.select(
        "source_index", x.alias("x"), y.alias("y"), service_shape(F.col("f.geometry")).alias("shape"), merged.alias("attributes"), kind.alias("geometry_kind"),
        *[F.lit(v).alias(k) for k, v in {"source_name": source.name, "source_url": source.url, "source_state": source.state, "source_category": source.category}.items()],
        F.lit(datetime.now(UTC).isoformat()).alias("retrieved_at"), *[F.lit(v).alias(k) for k, v in source.extra_properties.items()],
    )


def load_source(spark: SparkSession, source: Source, cache: str, timeout: float = 60.0) -> DataFrame:
    """A source from its cached file, which is fetched once with a sidecar that describes it."""
    path = Path(cache) / source.cache_subdir / f"{source.name}.json"
    if not path.exists():
        if fetch(source.url, str(path), timeout=timeout) is None:
            raise FileNotFoundError(source.url)
        path.with_suffix(".meta.json").write_text(json.dumps(asdict(source) | {"retrieved_at": datetime.now(UTC).isoformat()}))
    return service_rows(spark, path.as_uri(), source)


def catalog(spark: SparkSession, sources: Sequence[Source], cache: str, strict: bool = False) -> DataFrame:
    """``name, rows, issues``: every source loaded and checked. ``strict`` raises on the first issue."""
    from loomgrid.operators.relational import validation

    out = []
    for source in sources:
        try:
            df = load_source(spark, source, cache)
            issues = [f"{r['issue']}: {r['n']}" for r in validation(df, source.required_columns, srid=4326).collect()]
            rows = df.count()
        except FileNotFoundError as e:
            issues, rows = [f"unreachable: {e}"], 0
        if issues and strict:
            raise ValueError(f"{source.name}: {issues}")
        out.append((source.name, rows, issues))
    return spark.createDataFrame(out, "name string, rows long, issues array<string>")


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """Cached street and rail edges, ``edge_id, x1, y1, x2, y2, row_type, tags``."""
    from loomgrid.functions.scalars import track_type

    edges = spark.read.schema("x1 double, y1 double, x2 double, y2 double, row_type string, tags map<string,string>").option("multiLine", True).json(path)
    return edges.withColumns({"edge_id": F.monotonically_increasing_id(), "row_type": F.coalesce("row_type", track_type(F.coalesce("tags", F.create_map().cast("map<string,string>"))))})


def quarter_boxes(boxes: DataFrame, failed: DataFrame, depth: int, smallest: float = 0.01) -> DataFrame:
    """Boxes to ask for next: the quarters of those that failed, down to depth 3 and the smallest area.

    Both tables have ``box_id, w, s, e, n``.
    """
    mx, my = (F.col("w") + F.col("e")) / 2, (F.col("s") + F.col("n")) / 2
    parts = [("0", "w", "s", mx, my), ("1", mx, "s", "e", my), ("2", "w", my, mx, "n"), ("3", mx, my, "e", "n")]
    col = lambda v: F.col(v) if isinstance(v, str) else v
    quarters = F.array(*[F.struct(F.concat("box_id", F.lit(k)).alias("box_id"), col(w).alias("w"), col(s).alias("s"), col(e).alias("e"), col(n).alias("n")) for k, w, s, e, n in parts])
    again = boxes.join(failed.select("box_id"), "box_id", "left_semi").filter((F.col("e") - F.col("w")) * (F.col("n") - F.col("s")) >= smallest)
    return again.filter(F.lit(depth < 3)).select(F.inline(quarters))

