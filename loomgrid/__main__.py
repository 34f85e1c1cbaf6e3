"""Command line: ``python -m loomgrid stages|genetic|poi|demand|acs|catalog|validate|reproject ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgrid")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("stages", help="run pipeline stages")
    s.add_argument("--stages", nargs="*")
    s.add_argument("--out", required=True)
    s.add_argument("--sf-dir", required=True)
    s.add_argument("--force", action="store_true")
    s.add_argument("--workers", type=int, default=4)
    s.add_argument("--restaurants", action="store_true", help="triangulated graph without contraction")
    s = sub.add_parser("genetic", help="genetic search on a network's nodes and edges; prints each generation")
    for name in ("--nodes", "--edges", "--out"):
        s.add_argument(name, required=True)
    for name, value in (("--population", 100), ("--generations", 30), ("--routes", 20), ("--seed", 0)):
        s.add_argument(name, type=int, default=value)
    for name, value in (("--min-km", 45.0), ("--max-km", 80.0)):
        s.add_argument(name, type=float, default=value)
    s.add_argument("--core", type=float, nargs=4, metavar=("X0", "Y0", "X1", "Y1"), help="the urban core; by default the box of all nodes")
    s = sub.add_parser("poi", help="points of interest of a manifest")
    for name in ("--manifest", "--cache", "--out"):
        s.add_argument(name, required=True)
    s.add_argument("--tokens", nargs="*", default=[])
    s = sub.add_parser("demand", help="demand scores of blocks")
    for name in ("--blocks", "--poi", "--stops", "--out"):
        s.add_argument(name, required=True)
    s.add_argument("--acs-columns", nargs="*", default=[])
    s = sub.add_parser("acs", help="survey matrix to CSV")
    for name in ("--matrix", "--out"):
        s.add_argument(name, required=True)
    s = sub.add_parser("catalog", help="load and check the sources of a manifest")
    for name in ("--manifest", "--cache", "--out"):
        s.add_argument(name, required=True)
    s.add_argument("--strict", action="store_true")
    s = sub.add_parser("validate", help="check a route set against its limits; exit code 1 on a violation")
    for name in ("--routes", "--edges", "--nodes"):
        s.add_argument(name, required=True)
    s = sub.add_parser("reproject", help="longitude and latitude of a table to web-mercator")
    for name in ("--points", "--out"):
        s.add_argument(name, required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("loomgrid").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "stages":
        from loomgrid.plans.report import EVALUATION, EVALUATION_EXTENDED, fixed_width
        from loomgrid.plans.stages import STAGES, Config, Context, run_stages

        config = Config(a.out, a.sf_dir, triangulate=a.restaurants, contract=not a.restaurants)
        print("ran:", *run_stages(spark, config, a.stages or STAGES, a.force, a.workers))
        context = Context(spark, config)
        for name, columns in (("evaluation", EVALUATION), ("evaluation_extended", EVALUATION_EXTENDED)):
            if context.exists(name):
                print(f"\n{fixed_width(context.table(name).orderBy('variant'), columns)}")
    elif a.command == "genetic":
        from loomgrid.operators.generators import Limits, genetic

        nodes, edges = spark.read.parquet(a.nodes), spark.read.parquet(a.edges)
        box = tuple(a.core) if a.core else tuple(nodes.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).head())
        limits = Limits(routes=a.routes, low=1000 * a.min_km, high=1000 * a.max_km)
        say = lambda g, worth, diversity: print(f"generation {g}: fitness {worth:.4f}, diversity {diversity:.3f}")
        genetic(nodes, edges, a.population, a.generations, limits, box, a.seed, caller=say).write.mode("overwrite").parquet(a.out)
    elif a.command == "poi":
        from loomgrid.operators.relational import concat_sources, dedupe_points, token_filter
        from loomgrid.sources.tables import load_source, read_manifest

        found = []
        for source in read_manifest(a.manifest):
            try:
                found.append(load_source(spark, source, a.cache))
            except FileNotFoundError as e:
                print(f"skipped {source.name}: {e}")
        if found:
            rows = concat_sources(found).withColumn("label", F.lower(F.concat_ws(" ", F.map_values("attributes"))))
            rows = dedupe_points(token_filter(rows, a.tokens, ["label"]), [F.col("source_name"), F.col("source_index")], "x", "y")
            rows.write.mode("overwrite").partitionBy("source_state").parquet(a.out)
    elif a.command == "demand":
        from loomgrid.operators.demand import block_demand

        block_demand(spark.read.parquet(a.blocks), spark.read.parquet(a.poi), spark.read.parquet(a.stops), a.acs_columns).write.mode("overwrite").parquet(a.out)
    elif a.command == "acs":
        from loomgrid.sources.tables import survey_table, write_csv

        with open(a.matrix, encoding="utf-8") as f:
            write_csv(survey_table(spark, json.load(f)), a.out)
    elif a.command == "catalog":
        from loomgrid.sources.tables import catalog, read_manifest

        catalog(spark, read_manifest(a.manifest), a.cache, a.strict).write.mode("overwrite").json(a.out)
    elif a.command == "validate":
        from loomgrid.operators.routes import constraints

        zones = spark.createDataFrame([], "zx double, zy double, r double")
        checked = constraints(spark.read.parquet(a.routes), spark.read.parquet(a.edges), spark.read.parquet(a.nodes), zones)
        bad = checked.filter("bad_length + sharp_turns + revisits + no_go + worn_edges > 0")
        bad.show(100, truncate=False)
        return int(not bad.isEmpty())
    elif a.command == "reproject":
        from loomgrid.functions.geo import mercator_x, mercator_y

        spark.read.parquet(a.points).withColumns({"x": mercator_x(F.col("lon")), "y": mercator_y(F.col("lat"))}).write.mode("overwrite").parquet(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
