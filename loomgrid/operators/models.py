"""Cost, ridership, fitness and search-state models over route tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.scalars import decay, priority
from loomgrid.operators.routes import edge_reuse, segments
from loomgrid.operators.spatial import radius_join


@dataclass(frozen=True)
class CostParams:
    """Millions for a km of track and for a station by track type, and the contingency."""

    track: dict[str, float] = field(default_factory=lambda: {"subway_tunnel": 750.0, "subway_surface": 80.0, "rail_existing": 25.0, "elevated": 200.0, "street": 100.0, "unknown": 120.0})
    station: dict[str, float] = field(default_factory=lambda: {"subway_tunnel": 200.0, "subway_surface": 30.0, "rail_existing": 15.0, "elevated": 60.0, "street": 20.0, "unknown": 35.0})
    contingency: float = 1.40


# Periods of the day, as first hour, hour after the last, and share of boardings.
DAY = {"early_am": (5, 7, 0.04), "am_peak": (7, 9, 0.26), "midday": (9, 16, 0.30), "pm_peak": (16, 19, 0.27), "evening": (19, 23, 0.11), "late_night": (23, 25, 0.02)}


def _price(table: dict[str, float], kind: Column) -> Column:
    price = F.lit(table["unknown"])
    for name, value in table.items():
        price = F.when(kind == name, value).otherwise(price)
    return price


def line_costs(steps: DataFrame, stops: DataFrame, params: CostParams = CostParams()) -> DataFrame:
    """Costs of each line, in millions.

    ``steps`` has ``route_id, length_m, row_type`` a segment and ``stops`` has ``route_id, n_stations``. Stations cost
    what the line's most frequent track type says.
    """
    per = steps.groupBy("route_id", "row_type").agg(F.sum("length_m").alias("m"), F.sum(F.col("length_m") / 1000 * _price(params.track, F.col("row_type"))).alias("cost"), F.count(F.lit(1)).alias("n"))
    per = per.groupBy("route_id").agg(
        (F.sum("m") / 1000).alias("length_km"), (F.sum("cost") * params.contingency).alias("track_cost"), F.max_by("row_type", F.struct(F.col("n"), -priority(F.col("row_type")))).alias("dominant_row_type")
    )
    both = stops.join(per, "route_id", "left").fillna({"length_km": 0.0, "track_cost": 0.0, "dominant_row_type": "unknown"})
    both = both.withColumn("station_cost", F.col("n_stations") * _price(params.station, F.col("dominant_row_type")) * params.contingency)
    total = F.col("track_cost") + F.col("station_cost")
    rate = F.coalesce(total / F.nullif(F.col("length_km"), F.lit(0.0)), F.lit(0.0))
    return both.select("route_id", "dominant_row_type", "length_km", "n_stations", "track_cost", "station_cost", total.alias("total_cost"), rate.alias("cost_per_km"))


def network_cost(costs: DataFrame, routes: DataFrame) -> DataFrame:
    """One row ``gross, shared, net``: half of the share of edges used more than once, by all steps, is saved."""
    steps = segments(routes)
    used = steps.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"))
    share = used.agg((F.count_if(F.col("c") > 1) / F.nullif(F.sum("c"), F.lit(0))).alias("shared"))
    gross = costs.agg(F.sum("total_cost").alias("gross")).join(F.broadcast(share))
    return gross.select("gross", F.coalesce("shared", F.lit(0.0)).alias("shared"), (F.col("gross") * (1 - 0.5 * F.coalesce("shared", F.lit(0.0)))).alias("net"))


def line_metadata(costs: DataFrame) -> DataFrame:
    """The properties with which new lines are written."""
    return costs.select(
        F.col("route_id").alias("line_id"), F.lit("generated").alias("route_kind"), F.lit("planned").alias("service_status"),
        F.lit(None).cast("double").alias("occupancy_pct"), F.lit(None).cast("double").alias("delay_min"), F.lit(100.0).alias("accessibility_score"),
        F.lit(True).alias("is_accessible"), F.col("dominant_row_type").alias("row_type"), F.bround("total_cost", 1).alias("construction_cost_musd"),
        F.lit(None).cast("double").alias("ridership_estimate"),
    )


def station_boardings(stations: DataFrame, points: DataFrame | None, radius: float = 800.0, beta: float = 0.0008, total: float = 350_000.0) -> DataFrame:
    """``station_id, daily``: ``total`` boardings shared by decayed demand in ``radius``; evenly if there is none.

    Missing scores count 1; without a demand table the stations themselves are the demand.
    """
    if points is None:
        points = stations.select("x", "y", F.lit(1.0).alias("demand_score"))
    worth = F.coalesce(F.col("demand_score").try_cast("double"), F.lit(1.0)) if "demand_score" in points.columns else F.lit(1.0)
    pairs = radius_join(stations.select("station_id", "x", "y"), points.select(worth.alias("v"), "x", "y"), radius)
    pull = pairs.groupBy("station_id").agg(F.sum(F.col("v") * decay(F.sqrt("dist2"), beta)).alias("pull"))
    every = stations.select("station_id").join(pull, "station_id", "left").fillna({"pull": 0.0})
    sums = every.agg(F.sum("pull").alias("all"), F.count(F.lit(1)).alias("n"))
    daily = F.when(F.col("all") > 0, F.col("pull") * total / F.nullif(F.col("all"), F.lit(0.0))).otherwise(F.lit(total) / F.col("n"))
    return every.join(F.broadcast(sums)).select("station_id", daily.alias("daily"))


def hour_shares() -> Column:
    """``array<struct<hour,share>>`` of the hours up to 23; the share of hour 24 is lost, as it always was."""
    rows = [(h, share / (b - a)) for a, b, share in DAY.values() for h in range(a, b) if h <= 23]
    return F.array(*[F.struct(F.lit(h).alias("hour"), F.lit(s).alias("share")) for h, s in rows])


def hourly_profile(daily: DataFrame) -> DataFrame:
    """``station_id, hour, boardings``."""
    rows = daily.select("station_id", "daily", F.inline(hour_shares()))
    return rows.select("station_id", "hour", (F.col("daily") * F.col("share")).alias("boardings"))


def hourly_totals(hourly: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """``hour, boardings`` for the hours 5 to 24; ``stations`` restricts them, and an empty table means all."""
    if stations is not None and not stations.isEmpty():
        hourly = hourly.join(stations.select("station_id"), "station_id", "left_semi")
    hours = hourly.sparkSession.range(5, 25).select(F.col("id").cast("int").alias("hour"))
    sums = hourly.groupBy("hour").agg(F.sum("boardings").alias("boardings"))
    return hours.join(sums, "hour", "left").fillna({"boardings": 0.0})


def line_boardings(daily: DataFrame, routes: DataFrame) -> DataFrame:
    """``route_id, ridership``: a station's boardings are shared by its occurrences on routes."""
    at = routes.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    share = daily.join(at, daily["station_id"] == at["node_id"]).select("node_id", (F.col("daily") / F.col("n")).alias("part"))
    return routes.join(share, "node_id").groupBy("route_id").agg(F.sum("part").alias("ridership"))


def walk_scores(routes: DataFrame, scores: DataFrame, *keys: str) -> DataFrame:
    """Sums of ``score`` (and ``demand``, if there) over the nodes of routes, repeats included."""
    keys = keys or ("route_id",)
    sums = [F.sum(c).alias(c) for c in ("score", "demand") if c in scores.columns]
    return routes.join(scores, "node_id").groupBy(*keys).agg(*sums)


def visit_spread(routes: DataFrame, *keys: str) -> DataFrame:
    """``keys, visit_std``: population deviation of how often nodes are visited."""
    counts = routes.groupBy(*keys, "node_id").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(*keys).agg(F.stddev_pop("c").alias("visit_std"))


def pair_similarity(routes: DataFrame, key: str = "ind_id") -> DataFrame:
    """``u, v, jaccard`` of the node sets of all pairs of individuals; 0 if they share nothing.

    Shared nodes come from an equi-join on the node; pairs of individuals, of which a search keeps a
    hundred or so, are listed for the zeros.
    """
    nodes = routes.select(key, "node_id").distinct()
    sizes = nodes.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    a, b = nodes.select(F.col(key).alias("u"), "node_id"), nodes.select(F.col(key).alias("v"), "node_id")
    shared = a.join(b, "node_id").filter("u < v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("both"))
    pairs = sizes.select(F.col(key).alias("u"), F.col("n").alias("nu")).join(sizes.select(F.col(key).alias("v"), F.col("n").alias("nv")), F.col("u") < F.col("v"))
    out = pairs.join(shared, ["u", "v"], "left").fillna({"both": 0})
    return out.select("u", "v", (F.col("both") / (F.col("nu") + F.col("nv") - F.col("both"))).alias("jaccard"))


def diversity(routes: DataFrame, key: str = "ind_id") -> DataFrame:
    """One row ``diversity``: mean Jaccard distance of all pairs, 0 for a single individual."""
    return pair_similarity(routes, key).agg(F.coalesce(1 - F.avg("jaccard"), F.lit(0.0)).alias("diversity"))


def ant_fitness(routes: DataFrame, scores: DataFrame, key: str = "ind_id") -> DataFrame:
    """``key, fitness``: density + 0.4 demand + 5 distinct nodes - 30 repeated edges."""
    sums = walk_scores(routes, scores, key).join(routes.groupBy(key).agg(F.count_distinct("node_id").alias("v")), key)
    both = sums.join(edge_reuse(routes, key), key, "left").fillna({"duplicates": 0})
    return both.select(key, (F.col("score") + 0.4 * F.col("demand") + 5 * F.col("v") - 30 * F.col("duplicates")).alias("fitness"))


def pattern_bonus(routes: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float], *keys: str) -> DataFrame:
    """``keys, bonus``: 1 if a route of three nodes or more begins and ends outside the box and enters it between."""
    keys = keys or ("route_id",)
    x0, y0, x1, y1 = box
    urban = (F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).alias("urban")
    placed = routes.join(nodes.select("node_id", urban), "node_id").groupBy(*keys)
    ends = placed.agg(F.count(F.lit(1)).alias("n"), F.min_by("urban", "pos").alias("first"), F.max_by("urban", "pos").alias("last"), F.max("urban").alias("any"))
    return ends.select(*keys, ((F.col("n") >= 3) & ~F.col("first") & ~F.col("last") & F.col("any")).cast("int").alias("bonus"))


def genetic_fitness(routes: DataFrame, scores: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float], key: str = "ind_id") -> DataFrame:
    """``key, fitness`` of route sets: density, half of demand, coverage and patterns, less repeats, uneven visits and likeness."""
    sums = walk_scores(routes, scores, key).join(routes.groupBy(key).agg(F.count_distinct("node_id").alias("v")), key)
    bonus = pattern_bonus(routes, nodes, box, key, "route_id").groupBy(key).agg(F.sum("bonus").alias("b"))
    alike = pair_similarity(routes, key).filter("jaccard > 0.75")
    alike = alike.select(F.col("u").alias(key), "jaccard").unionByName(alike.select(F.col("v").alias(key), "jaccard")).groupBy(key).agg((100 * F.sum("jaccard")).alias("d"))
    both = sums.join(bonus, key, "left").join(edge_reuse(routes, key), key, "left").join(visit_spread(routes, key), key, "left").join(alike, key, "left").fillna(0)
    value = F.col("score") + 0.5 * F.col("demand") + 10 * F.col("v") + 1000 * F.col("b") - 50 * F.col("duplicates") - 20 * F.col("visit_std") - F.col("d")
    return both.select(key, value.alias("fitness"))


def transition_odds(edges: DataFrame, scores: DataFrame, pheromone: DataFrame, alpha: float = 1.0, beta: float = 2.0) -> DataFrame:
    """``u, v, p``: chance of each step from ``u``; even if all weights are 0."""
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), "src", "dst", "weight"))
    rated = both.join(pheromone, ["src", "dst"], "left").fillna({"tau": 1.0}).join(scores.select(F.col("node_id").alias("v"), "score"), "v", "left").fillna({"score": 1.0})
    weight = F.pow("tau", F.lit(alpha)) * F.pow((F.col("score") + 1e-6) / (F.col("weight") + 1e-6), F.lit(beta))
    rated = rated.select("u", "v", weight.alias("w"))
    sums = rated.groupBy("u").agg(F.sum("w").alias("all"), F.count(F.lit(1)).alias("n"))
    return rated.join(sums, "u").select("u", "v", F.when(F.col("all") > 0, F.col("w") / F.nullif(F.col("all"), F.lit(0.0))).otherwise(1 / F.col("n")).alias("p"))


def pheromone_step(pheromone: DataFrame, best: DataFrame, fitness: float, rho: float = 0.1, low: float = 0.05, high: float = 8.0) -> DataFrame:
    """Evaporate every edge, then deposit ``1 / (1 + |fitness|)`` for each traversal of the best route set.

    Deposits are positive, so clipping once after their sum is clipping after each.
    """
    counts = segments(best).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"))
    faded = F.greatest(F.lit(low), F.coalesce("tau", F.lit(1.0)) * (1 - rho))
    grown = pheromone.join(counts, ["src", "dst"], "full").withColumn("faded", faded)
    laid = F.least(F.lit(high), F.col("faded") + F.col("c") / (1 + abs(fitness)))
    return grown.select("src", "dst", F.when(F.col("c").isNull(), F.col("faded")).otherwise(laid).alias("tau"))


def continuations(heads: DataFrame, edges: DataFrame, nodes: DataFrame, zones: DataFrame, min_angle: float = 130.0) -> DataFrame:
    """One step of a search: ``head_id, node_id, angle, deviation`` of every allowed next node.

    ``heads`` has ``head_id, prev, node, visited`` (array), ``sign``. A next node is a neighbour that is not visited nor
    in a disc of ``zones``; after the first step it keeps the angle and, if ``sign`` is not 0, turns that way.
    """
    from loomgrid.functions.geo import angle_at, deviation_at
    from loomgrid.operators.graph import adjacency

    place = lambda c, p: nodes.select(F.col("node_id").alias(c), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    near = heads.join(adjacency(edges), "node").filter(~F.array_contains("visited", F.col("other")))
    near = near.join(place("node", "n"), "node").join(place("other", "o"), "other").join(place("prev", "p"), "prev", "left")
    discs = F.broadcast(zones.agg(F.collect_list(F.struct("zx", "zy", "r")).alias("discs")))
    clear = ~F.exists("discs", lambda z: (z["zx"] - F.col("ox")) ** 2 + (z["zy"] - F.col("oy")) ** 2 < z["r"] ** 2)
    back = [F.col("px") - F.col("nx"), F.col("py") - F.col("ny")]
    ahead = [F.col("ox") - F.col("nx"), F.col("oy") - F.col("ny")]
    first = F.col("prev").isNull()
    near = near.join(discs).filter(clear).withColumns({"angle": F.when(first, 0.0).otherwise(angle_at(*back, *ahead)), "deviation": F.when(first, 0.0).otherwise(deviation_at(*back, *ahead))})
    fits = first | ((F.col("angle") > min_angle) & ((F.col("sign") == 0) | (F.col("deviation") * F.col("sign") > 0)))
    return near.filter(fits).select("head_id", F.col("other").alias("node_id"), "angle", "deviation")


def operations_summary(lines: DataFrame) -> DataFrame:
    """One row of counts and averages over line properties; nulls are skipped."""
    return lines.agg(
        F.count("occupancy_pct").alias("with_occupancy"), F.count("delay_min").alias("with_delay"), F.count_if(F.col("service_status") == "planned").alias("planned"),
        F.avg("occupancy_pct").alias("avg_occupancy"), F.max("delay_min").alias("max_delay"), F.count_if("is_accessible").alias("accessible"),
    )
