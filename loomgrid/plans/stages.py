"""The batch pipeline: stages with dependencies, run as Spark jobs in threads.

A stage is ``f(context) -> dict of DataFrames``; its tables are Parquet below the output folder, and a
stage whose tables are there is skipped unless forced. Independent stages run at the same time, each
in a scheduler pool of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.geo import geodesic_m
from loomgrid.operators import demand, generators, graph, models, relational, routes, spatial, stats


@dataclass(frozen=True)
class Config:
    """Parameters of the stages; defaults are those of the standard network."""

    out: str
    sf_dir: str
    triangulate: bool = False
    contract: bool = True
    resolution: float = 0.07
    first_radius: float = 20_000.0
    limits: generators.Limits = field(default_factory=lambda: generators.Limits(routes=4, low=15_000.0, high=60_000.0, min_angle=100.0))
    rounds: int = 100
    ants: int = 20
    generations: int = 30
    population: int = 100
    bandwidth: float = 2000.0
    spacing: float = 1000.0
    similarity: dict[str, float] = field(default_factory=lambda: {"naive": 0.5, "iterative": 0.5, "aco": 0.3, "genetic": 0.3})
    radii: tuple[float, ...] = (5_000.0, 10_000.0, 20_000.0)
    #: Discs ``(x, y, radius)`` that the ants keep out of.
    no_go: tuple[tuple[float, float, float], ...] = ((50_000.0, 50_000.0, 15_000.0), (20_000.0, 80_000.0, 9_000.0))
    #: Points thrown for the mean way from inside the area, and the lattice of a catchment.
    thrown: int = 4_000
    catchment_grid: int = 20
    seed: int = 0


class Context:
    """Reads and writes the tables of stages."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config

    def path(self, name: str) -> str:
        return f"{self.config.out.rstrip('/')}/{name}"

    def exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def save(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.path(name))


@dataclass(frozen=True)
class Stage:
    run: Callable[[Context], dict[str, DataFrame]]
    makes: tuple[str, ...]
    needs: tuple[str, ...] = ()


def _fixtures(c: Context):
    from loomgrid.plans import fixtures

    return fixtures, c.spark, c.config.sf_dir


def region(c: Context) -> dict[str, DataFrame]:
    from loomgrid.functions.scalars import density

    X, spark, d = _fixtures(c)
    b = X.blocks(spark, d)
    b = b.withColumn("density", density(F.col("pop"), F.col("aland"), F.col("awater"))).withColumn("potential", F.log1p("density"))
    return {"blocks": b, "extent": b.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))}


def transit_points(c: Context) -> dict[str, DataFrame]:
    X, spark, d = _fixtures(c)
    stops = X.stations(spark, d).withColumn("key", F.concat(F.lit("s"), F.col("station_id").cast("string")))
    return {"stops": spatial.points_in_polygons(stops, X.ring_edges(spark, d), "key").dropDuplicates(["x", "y"]).drop("key")}


def graph_points(c: Context) -> dict[str, DataFrame]:
    X, spark, d = _fixtures(c)
    rows = c.table("blocks").select(F.col("block_id").alias("sid"), "x", "y", F.col("potential").alias("likelihood"))
    seeds = rows.join(spatial.quadtree_seeds(rows, 4).select("sid").distinct(), "sid", "left_semi").select("x", "y")
    both = relational.concat_sources([seeds, X.places(spark, d).select("x", "y")]).dropDuplicates(["x", "y"])
    both = relational.concat_sources([both, c.table("stops").select("x", "y")]).dropDuplicates(["x", "y"])
    return {"points": both.select(F.xxhash64("x", "y").alias("node_id"), "x", "y")}


def network(c: Context) -> dict[str, DataFrame]:
    points = c.table("points")
    edges = graph.delaunay_edges(points, "node_id") if c.config.triangulate else graph.gabriel_edges(points, "node_id", c.config.first_radius).select("src", "dst")
    if c.config.contract:
        points, edges = graph.contract(points, edges, graph.louvain(edges, c.config.resolution, c.config.seed))
    nodes = graph.connected_nodes(points, edges)
    a = nodes.select(F.col("node_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    edges = edges.join(a, "src").join(b, "dst").select("src", "dst", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")).alias("weight"))
    scored = demand.radial_score(nodes, c.table("stops"), c.config.bandwidth)
    return {"nodes": nodes.join(scored, "node_id"), "edges": edges}


def gnn_scoring(c: Context) -> dict[str, DataFrame]:
    nodes, edges = c.table("nodes"), c.table("edges")
    features = nodes.join(graph.clustering(edges).withColumnRenamed("node", "node_id"), "node_id", "left").fillna(0)
    features = features.join(graph.betweenness(edges).withColumnRenamed("node", "node_id"), "node_id", "left").fillna(0)
    dense = demand.log_density_at(nodes, c.table("stops"), "node_id", c.config.bandwidth)
    features = features.join(dense, "node_id").withColumn("degree", F.col("degree").cast("double"))
    columns = ["x", "y", "log_density", "degree", "clustering", "betweenness"]
    return {"node_scores": graph.graph_score(features, edges, columns, nodes.select("node_id", F.col("score").alias("density")))}


def lodes(c: Context) -> dict[str, DataFrame]:
    X, spark, d = _fixtures(c)
    centres = relational.tract_centroids(c.table("blocks"), 14)
    return {"od_points": relational.top_flows(relational.tract_flows(X.od(spark, d), 14), centres)}


def _search(c: Context) -> tuple[DataFrame, DataFrame]:
    return c.table("nodes").drop("score").join(c.table("node_scores"), "node_id"), c.table("edges")


def _lines(c: Context, variant: str, made: DataFrame) -> dict[str, DataFrame]:
    """The common tail: groups, stations and names of a route set."""
    X, spark, d = _fixtures(c)
    made = made.select("route_id", "pos", "node_id")
    edges, nodes = c.table("edges"), c.table("nodes")
    groups = routes.similarity_groups(made, edges, c.config.similarity[variant])
    marks = routes.mark_stations(made, groups, edges, c.config.spacing)
    stops = nodes.join(marks.filter("is_station"), "node_id").select(F.col("node_id").alias("station_id"), "x", "y")
    names = routes.name_stations(stops, X.places(spark, d)).withColumnRenamed("station_id", "node_id")
    return {f"routes_{variant}": made.join(groups, "route_id"), f"stations_{variant}": marks.join(names, "node_id", "left").join(nodes.select("node_id", "x", "y"), "node_id")}


def naive(c: Context) -> dict[str, DataFrame]:
    return _lines(c, "naive", generators.random_walks(*_search(c), 1, c.config.limits, c.config.seed))


def iterative(c: Context) -> dict[str, DataFrame]:
    return _lines(c, "iterative", generators.iterative_walks(*_search(c), c.config.rounds, limits=c.config.limits, seed=c.config.seed))


def aco(c: Context) -> dict[str, DataFrame]:
    zones = c.spark.createDataFrame(list(c.config.no_go), "zx double, zy double, r double")
    return _lines(c, "aco", generators.ant_colony(*_search(c), c.config.ants, c.config.generations, c.config.limits, c.config.seed, zones))


def genetic(c: Context) -> dict[str, DataFrame]:
    box = tuple(c.table("extent").select("x0", "y0", "x1", "y1").head())
    return _lines(c, "genetic", generators.genetic(*_search(c), c.config.population, c.config.generations, c.config.limits, box, c.config.seed))


VARIANTS = ("naive", "iterative", "aco", "genetic")


def _present(c: Context) -> Iterable[str]:
    return [v for v in VARIANTS if c.exists(f"routes_{v}")]


def row_snap(c: Context) -> dict[str, DataFrame]:
    X, spark, d = _fixtures(c)
    return {"track_network": X.network(spark, d)}


def cost(c: Context) -> dict[str, DataFrame]:
    out = {}
    for v in _present(c):
        made = c.table(f"routes_{v}")
        at = c.table("nodes")
        steps = routes.segments(made).join(at.select(F.col("node_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), "a")
        steps = steps.join(at.select(F.col("node_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")), "b").withColumn("step", F.struct("route_id", "pos"))
        mids = steps.select("step", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
        # Lengths are geodesic, once for each pair of ends.
        ends = steps.select("ax", "ay", "bx", "by").distinct().withColumn("length_m", geodesic_m("ax", "ay", "bx", "by"))
        typed = steps.join(ends, ["ax", "ay", "bx", "by"]).join(spatial.nearest_track(mids, c.table("track_network"), "step"), "step")
        stops = made.join(c.table(f"stations_{v}").filter("is_station"), "node_id").groupBy("route_id").agg(F.count(F.lit(1)).alias("n_stations"))
        out[f"cost_{v}"] = models.line_metadata(models.line_costs(typed, stops))
    return out


def ridership(c: Context) -> dict[str, DataFrame]:
    out = {}
    points = c.table("od_points").select("x", "y", "demand_score")
    for v in _present(c):
        stops = c.table(f"stations_{v}").filter("is_station").select(F.col("node_id").alias("station_id"), "x", "y")
        daily = models.station_boardings(stops, points)
        out[f"riders_{v}"] = models.line_boardings(daily, c.table(f"routes_{v}"))
    return out


def evaluate(c: Context) -> dict[str, DataFrame]:
    """Coverage of blocks and neighbourhoods, mean ways to a station and density in reach, a row a variant."""
    X, spark, d = _fixtures(c)
    blocks, places, out = c.table("blocks"), X.places(spark, d), None
    area, samples = X.ring_edges(spark, d), c.table("blocks").filter("pop > 0")
    for v in _present(c):
        stops = c.table(f"stations_{v}").filter("is_station").select(F.col("node_id").alias("station_id"), "x", "y")
        row = spatial.catchment_coverage(blocks, stops, "block_id", c.config.radii[0])
        far = spatial.nearest_join(blocks, stops, "block_id", "station_id").agg(F.avg("dist").alias("mean_m"))
        close = spatial.nearest_join(places, stops, "place_id", "station_id").agg((100.0 * F.count_if(F.col("dist") <= c.config.radii[0]) / F.count(F.lit(1))).alias("neigh_pct"))
        inside = spatial.mean_distance_inside(spatial.darts(spark, area, c.config.thrown, c.config.seed), area, stops).select(F.col("mean_m").alias("inside_mean_m"))
        mass = demand.catchment_mass(stops, samples, c.config.bandwidth, c.config.radii[0], c.config.catchment_grid).agg(F.sum("mass").alias("mass"))
        row = row.join(F.broadcast(far)).join(F.broadcast(close)).join(F.broadcast(inside)).join(F.broadcast(mass))
        row = row.select(F.lit(v).alias("variant"), "pct_covered", "mean_overlap_pct", "mean_m", "neigh_pct", "inside_mean_m", "mass")
        out = row if out is None else out.unionByName(row)
    return {"evaluation": out} if out is not None else {}


def evaluate_extended(c: Context) -> dict[str, DataFrame]:
    """Equity, coverage at radii, track, people a kilometre and transfers, a row a variant; nearest stations are found once for all."""
    blocks, out = c.table("blocks"), None
    for v in _present(c):
        stops = c.table(f"stations_{v}").filter("is_station").select(F.col("node_id").alias("station_id"), "x", "y")
        made = c.table(f"routes_{v}")
        near = spatial.nearest_join(blocks, stops, "block_id", "station_id").join(blocks.select("block_id", "pop", "potential"), "block_id")
        wide = stats.coverage_at(near, c.config.radii).groupBy().pivot("radius", list(c.config.radii)).agg(F.first("pct"))
        wide = wide.toDF(*[f"cov_{int(r)}" for r in c.config.radii])
        row = stats.gini(stats.station_population(blocks, stops, c.config.radii[0]), "served", "pop_gini").join(wide)
        row = row.join(stats.high_need(near, F.col("potential"), c.config.radii[0]).withColumnRenamed("pct", "high_need_cov"))
        track = routes.segments(made).select("src", "dst").distinct().join(c.table("edges"), ["src", "dst"]).agg(F.coalesce(F.sum("weight") / 1000, F.lit(0.0)).alias("track_km"))
        row = row.join(track).join(stats.service_efficiency(near, track, c.config.radii[0]))
        row = row.join(routes.transfer_burden(made.drop("group"), made.select("route_id", "group").distinct()))
        row = row.withColumn("variant", F.lit(v)).withColumn("pct_2_and_more", F.col("pct_2plus") + F.col("pct_unreachable"))
        out = row if out is None else out.unionByName(row)
    return {"evaluation_extended": out} if out is not None else {}


STAGES: dict[str, Stage] = {
    "region": Stage(region, ("blocks", "extent")),
    "transit_points": Stage(transit_points, ("stops",)),
    "graph_points": Stage(graph_points, ("points",), ("region", "transit_points")),
    "network": Stage(network, ("nodes", "edges"), ("graph_points",)),
    "gnn_scoring": Stage(gnn_scoring, ("node_scores",), ("network",)),
    "lodes": Stage(lodes, ("od_points",), ("region",)),
    "naive": Stage(naive, ("routes_naive", "stations_naive"), ("gnn_scoring",)),
    "iterative": Stage(iterative, ("routes_iterative", "stations_iterative"), ("gnn_scoring",)),
    "aco": Stage(aco, ("routes_aco", "stations_aco"), ("gnn_scoring",)),
    "genetic": Stage(genetic, ("routes_genetic", "stations_genetic"), ("gnn_scoring",)),
    "row_snap": Stage(row_snap, ("track_network",)),
    "cost": Stage(cost, (), ("row_snap", *VARIANTS)),
    "ridership": Stage(ridership, (), ("lodes", *VARIANTS)),
    "evaluate": Stage(evaluate, ("evaluation",), VARIANTS),
    "evaluate_extended": Stage(evaluate_extended, ("evaluation_extended",), VARIANTS),
}


def run_stages(spark: SparkSession, config: Config, names: Iterable[str], force: bool = False, workers: int = 4) -> list[str]:
    """Run the named stages in order of need; the names that did work. The first failure stops all.

    Needs that are not named are taken as done.
    """
    names = list(dict.fromkeys(names))
    unknown = set(names) - STAGES.keys()
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    context, left, ran = Context(spark, config), dict.fromkeys(names), []

    def work(name: str) -> bool:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        stage = STAGES[name]
        if stage.makes and not force and all(context.exists(m) for m in stage.makes):
            return False
        for table, df in stage.run(context).items():
            context.save(table, df)
        return True

    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        running = {}
        while left or running:
            for name in [n for n in left if not any(need in left or need in running.values() for need in STAGES[n].needs)]:
                running[pool.submit(work, name)] = name
                del left[name]
            done, _ = wait(running, return_when=FIRST_COMPLETED)
            for future in done:
                name = running.pop(future)
                if future.result():
                    ran.append(name)
    return ran
