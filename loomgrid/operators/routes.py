"""Routes as exploded tables ``route_id, pos, node_id`` with ``pos`` from 0."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.geo import angle_at, deviation_at
from loomgrid.functions.scalars import label_part
from loomgrid.operators.components import connected_components
from loomgrid.operators.spatial import nearest_join
from loomgrid.scratch import settle


def along(*keys: str):
    return Window.partitionBy(*(keys or ("route_id",))).orderBy("pos")


def segments(routes: DataFrame, *keys: str) -> DataFrame:
    """Consecutive pairs: ``route_id, pos, a, b`` and the canonical ``src, dst``."""
    keys = keys or ("route_id",)
    pairs = routes.select(*keys, "pos", F.col("node_id").alias("a"), F.lead("node_id").over(along(*keys)).alias("b")).filter("b is not null")
    return pairs.withColumns({"src": F.least("a", "b"), "dst": F.greatest("a", "b")})


def by_route(rows: DataFrame, key: str, columns: list[str], walk: Callable[[int, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``walk(key, rows in order of pos)`` for every route, in Python workers.

    Routes are short and many, so each partition is one sorted stream of them and not a group a call.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for batch in batches:
            out = []
            for k, *row in zip(batch[key].tolist(), *[batch[c].tolist() for c in columns]):
                if k != now and held:
                    out += walk(now, held)
                    held = []
                now = k
                held.append(tuple(row))
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(walk(now, held), columns=names)

    return rows.select(key, "pos", *columns).repartition(key).sortWithinPartitions(key, "pos").mapInPandas(run, schema)


def turns(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``route_id, pos, angle, deviation`` at each inner node; 180 and 0 are straight on."""
    placed = routes.join(nodes.select("node_id", "x", "y"), "node_id")
    w = along()
    for name in ("x", "y"):
        placed = placed.withColumns({f"{name}0": F.lag(name).over(w), f"{name}2": F.lead(name).over(w)})
    inner = placed.filter("x0 is not null and x2 is not null")
    back = [F.col("x0") - F.col("x"), F.col("y0") - F.col("y")]
    ahead = [F.col("x2") - F.col("x"), F.col("y2") - F.col("y")]
    return inner.select("route_id", "pos", angle_at(*back, *ahead).alias("angle"), deviation_at(*back, *ahead).alias("deviation"))


def validity(routes: DataFrame, edges: DataFrame, nodes: DataFrame, low: float, high: float) -> DataFrame:
    """``route_id, n_nodes, length, valid``: two nodes or more, none twice, all placed, all steps edges, length in bounds."""
    shape = routes.join(nodes.select("node_id", F.lit(1).alias("placed")), "node_id", "left").groupBy("route_id")
    shape = shape.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("node_id").alias("n_distinct"), F.count("placed").alias("n_placed"))
    steps = segments(routes).join(edges.select("src", "dst", "weight"), ["src", "dst"], "left").groupBy("route_id")
    steps = steps.agg(F.sum("weight").alias("length"), F.count_if(F.col("weight").isNull()).alias("broken"))
    both = shape.join(steps, "route_id", "left").fillna({"length": 0.0, "broken": 0})
    good = (F.col("n_nodes") >= 2) & (F.col("n_nodes") == F.col("n_distinct")) & (F.col("n_nodes") == F.col("n_placed")) & (F.col("broken") == 0) & F.col("length").between(low, high)
    return both.select("route_id", "n_nodes", "length", good.alias("valid"))


def edge_reuse(routes: DataFrame, *keys: str) -> DataFrame:
    """``keys, duplicates``: traversals of an edge beyond its first, over all routes of a key."""
    keys = keys or ("route_set",)
    used = segments(routes, *dict.fromkeys([*keys, "route_id"])).groupBy(*keys, "src", "dst").agg(F.count(F.lit(1)).alias("c"))
    return used.groupBy(*keys).agg(F.sum(F.col("c") - 1).alias("duplicates"))


def constraints(routes: DataFrame, edges: DataFrame, nodes: DataFrame, zones: DataFrame, low: float = 45_000.0, high: float = 100_000.0, sharpest: float = 130.0, most_uses: int = 3) -> DataFrame:
    """``route_id`` and the number of violations of each kind: length, turns, revisits, no-go nodes, worn edges.

    ``zones`` are discs ``zx, zy, r``; a node strictly inside one, or without a place, is a violation.
    """
    size = validity(routes, edges, nodes, low, high).select("route_id", (~F.col("length").between(low, high)).cast("int").alias("bad_length"), "n_nodes")
    sharp = turns(routes, nodes).groupBy("route_id").agg(F.count_if(F.col("angle") <= sharpest).alias("sharp_turns"))
    seen = routes.groupBy("route_id").agg((F.count(F.lit(1)) - F.count_distinct("node_id")).alias("revisits"))
    discs = F.broadcast(zones.agg(F.collect_list(F.struct("zx", "zy", "r")).alias("discs")))
    placed = routes.join(nodes.select("node_id", "x", "y"), "node_id", "left").join(discs)
    barred = F.col("x").isNull() | F.exists("discs", lambda z: (z["zx"] - F.col("x")) ** 2 + (z["zy"] - F.col("y")) ** 2 < z["r"] ** 2)
    banned = placed.groupBy("route_id").agg(F.count_if(barred).alias("no_go"))
    uses = segments(routes).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > most_uses)
    worn = segments(routes).join(uses, ["src", "dst"]).groupBy("route_id").agg(F.count_distinct("src", "dst").alias("worn_edges"))
    out = size
    for more in (sharp, seen, banned, worn):
        out = out.join(more, "route_id", "left")
    return out.fillna(0).select("route_id", "bad_length", "sharp_turns", "revisits", "no_go", "worn_edges")


def similarity_groups(routes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """``route_id, group``: routes linked where shared edge length is ``threshold`` of either route's own.

    An edge without a known length counts 1. Labels run from 0 by the group's smallest route.
    """
    own = segments(routes).select("route_id", "src", "dst").distinct().join(edges.select("src", "dst", "weight"), ["src", "dst"], "left").fillna({"weight": 1.0})
    lengths = own.groupBy("route_id").agg(F.sum("weight").alias("length"))
    a, b = own.withColumnRenamed("route_id", "u"), own.select(F.col("route_id").alias("v"), "src", "dst")
    shared = a.join(b, ["src", "dst"]).filter("u < v").groupBy("u", "v").agg(F.sum("weight").alias("shared"))
    shared = shared.join(lengths.select(F.col("route_id").alias("u"), F.col("length").alias("lu")), "u").join(lengths.select(F.col("route_id").alias("v"), F.col("length").alias("lv")), "v")
    part = lambda l: F.coalesce(F.col("shared") / F.nullif(F.col(l), F.lit(0.0)), F.lit(0.0))  # noqa: E731, E741
    roots = connected_components(shared.filter((part("lu") >= threshold) | (part("lv") >= threshold)))
    placed = routes.select("route_id").distinct().join(roots.withColumnRenamed("node", "route_id"), "route_id", "left")
    placed = placed.select("route_id", F.coalesce("root", "route_id").alias("root"))
    labels = placed.select("root").distinct().withColumn("group", F.row_number().over(Window.orderBy("root")) - 1)
    return placed.join(labels, "root").select("route_id", "group")


def fixed_stations(routes: DataFrame, groups: DataFrame) -> DataFrame:
    """``node_id, terminal, transfer`` of nodes that are stations anyway: ends of routes and nodes of several groups."""
    ends = Window.partitionBy("route_id")
    marked = routes.withColumn("last", F.max("pos").over(ends)).join(groups, "route_id")
    found = marked.groupBy("node_id").agg(F.max((F.col("pos") == 0) | (F.col("pos") == F.col("last"))).alias("terminal"), (F.count_distinct("group") > 1).alias("transfer"))
    return found.filter("terminal or transfer")


def mark_stations(routes: DataFrame, groups: DataFrame, edges: DataFrame, spacing: float = 1000.0) -> DataFrame:
    """``node_id, is_station``: fixed stations, and others at least ``spacing`` after the one before.

    Each route is walked forwards, then backwards, in a task of its own; the last verdict on a node,
    by route and pass, stands.
    """
    steps = segments(routes).join(edges.select("src", "dst", "weight"), ["src", "dst"], "left").select("route_id", "pos", F.coalesce("weight", F.lit(0.0)).alias("ahead"))
    fixed = fixed_stations(routes, groups).select("node_id", F.lit(True).alias("fixed"))
    rows = routes.join(steps, ["route_id", "pos"], "left").join(fixed, "node_id", "left").fillna({"ahead": 0.0, "fixed": False})

    def walk(route: int, found: list[tuple]) -> list[tuple]:
        out = []
        for step, order in enumerate((range(len(found)), range(len(found) - 1, -1, -1))):
            since = 0.0
            for at, i in enumerate(order):
                if at:
                    since += found[i - 1][1] if step == 0 else found[i][1]
                station = bool(found[i][2]) or since >= spacing or at == 0
                if station:
                    since = 0.0
                out.append((route, step, at, found[i][0], station))
        return out

    verdicts = by_route(rows, "route_id", ["node_id", "ahead", "fixed"], walk, "route_id long, step long, at long, node_id long, flag boolean")
    return verdicts.groupBy("node_id").agg(F.max_by("flag", F.struct("route_id", "step", "at")).alias("is_station"))


def name_stations(stations: DataFrame, places: DataFrame) -> DataFrame:
    """``station_id, name`` from the nearest place; repeats are numbered from 2 by station.

    ``places`` has ``place_id, label, x, y``.
    """
    near = nearest_join(stations, places, "station_id", "place_id").join(places.select("place_id", "label"), "place_id", "left")
    base = near.select("station_id", F.coalesce(label_part(F.col("label")), F.lit("Unnamed station")).alias("base"))
    turn = F.row_number().over(Window.partitionBy("base").orderBy("station_id"))
    return base.withColumn("n", turn).select("station_id", F.when(F.col("n") > 1, F.concat("base", F.lit(" "), F.col("n").cast("string"))).otherwise(F.col("base")).alias("name"))


def transfer_burden(routes: DataFrame, groups: DataFrame, max_pairs: int = 10_000, seed: int = 42) -> DataFrame:
    """One row ``mean_transfers, pct_0, pct_1, pct_2plus, pct_unreachable`` over pairs of stations.

    Transfers are steps between groups that share a station. Beyond ``max_pairs`` pairs, those with the
    smallest hashes are taken. Fewer than two stations give no row.
    """
    member = settle(routes.join(groups, "route_id").select(F.col("node_id").alias("s"), F.col("group").cast("long").alias("g")).distinct(), "transfer-members")
    near = member.select("s", F.col("g").alias("a")).join(member.select("s", F.col("g").alias("b")), "s").filter("a <> b").select("a", "b").distinct()
    reach = member.select(F.col("g").alias("a"), F.col("g").alias("b"), F.lit(0).alias("hops")).distinct()
    front, hops, near = settle(reach, "transfer-reach"), 0, settle(near, "transfer-groups")
    reach = front
    while True:
        hops += 1
        step = front.select("a", F.col("b").alias("via")).join(near.select(F.col("a").alias("via"), "b"), "via").select("a", "b").distinct()
        front = settle(step.join(reach.select("a", "b"), ["a", "b"], "left_anti").withColumn("hops", F.lit(hops)), "transfer-reach")
        if front.isEmpty():
            break
        reach = reach.unionByName(front)
    stations = member.select("s").distinct()
    n = stations.count()
    if n < 2:
        return reach.select(*[F.lit(0.0).alias(c) for c in ("mean_transfers", "pct_0", "pct_1", "pct_2plus", "pct_unreachable")]).limit(0)
    if n * (n - 1) // 2 <= max_pairs:
        pairs = stations.select(F.col("s").alias("p")).join(stations.select(F.col("s").alias("q")), F.col("p") < F.col("q"))
    else:
        # Twice as many draws as needed, by hash of the draw; distinct pairs with the smallest hashes.
        indexed = stations.withColumn("i", F.row_number().over(Window.orderBy("s")) - 1)
        pick = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n)).alias(f"i{salt}")
        drawn = stations.sparkSession.range(2 * max_pairs).select("id", pick(1), pick(2)).filter("i1 <> i2")
        drawn = drawn.join(F.broadcast(indexed.select(F.col("i").alias("i1"), F.col("s").alias("s1"))), "i1").join(F.broadcast(indexed.select(F.col("i").alias("i2"), F.col("s").alias("s2"))), "i2")
        pairs = drawn.select(F.least("s1", "s2").alias("p"), F.greatest("s1", "s2").alias("q")).distinct().orderBy(F.xxhash64("p", "q", F.lit(seed)), "p", "q").limit(max_pairs)
    ways = pairs.join(member.select(F.col("s").alias("p"), F.col("g").alias("a")), "p").join(member.select(F.col("s").alias("q"), F.col("g").alias("b")), "q").join(reach, ["a", "b"], "left")
    best = ways.groupBy("p", "q").agg(F.min("hops").alias("t"))
    pct = lambda c: (100.0 * F.count_if(c) / F.count(F.lit(1)))
    return best.agg(
        F.avg("t").alias("mean_transfers"), pct(F.col("t") == 0).alias("pct_0"), pct(F.col("t") == 1).alias("pct_1"),
        pct(F.col("t") >= 2).alias("pct_2plus"), pct(F.col("t").isNull()).alias("pct_unreachable"),
    )


def line_graph(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst, dist, line_id`` in both directions along each route."""
    at = nodes.select("node_id", "x", "y")
    steps = segments(routes).select("route_id", "a", "b").distinct()
    ends = steps.join(at.select(F.col("node_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), "a").join(at.select(F.col("node_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")), "b")
    size = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    one = ends.select(F.col("a").alias("src"), F.col("b").alias("dst"), size.alias("dist"), F.col("route_id").alias("line_id"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist", "line_id")).distinct()


def best_paths(graph: DataFrame, origins: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``origin, node, transfers, dist``: the lexicographically least transfers, then distance.

    States are ``(origin, node, line)``; rounds relax the states that improved until none does. A line is left only from the
    best state of a node over all lines: any other state offers no line less, and staying on the line is an offer of its
    own. If some still improve after ``max_rounds``, that is an error.
    """
    graph = settle(graph.select("src", "dst", "dist", "line_id"), "path-graph")
    start = origins.select(F.col("node_id").alias("origin")).join(graph.select(F.col("src").alias("origin"), "line_id").distinct(), "origin")
    state = settle(start.select("origin", F.col("origin").alias("node"), "line_id", F.lit(0).alias("transfers"), F.lit(0.0).alias("dist")), "path-state")
    fresh, tops = state, None
    cost = F.struct("transfers", "dist")
    for _ in range(max_rounds):
        lead = fresh.groupBy("origin", "node").agg(F.min(cost).alias("top"))
        if tops is not None:
            lead = lead.join(tops.withColumnRenamed("top", "had"), ["origin", "node"], "left").filter(F.col("had").isNull() | (F.col("top") < F.col("had"))).drop("had")
        lead = settle(lead, "path-lead")
        tops = lead if tops is None else settle(tops.unionByName(lead).groupBy("origin", "node").agg(F.min("top").alias("top")), "path-tops")
        ways = graph.withColumnRenamed("src", "node")
        stay = fresh.withColumnRenamed("dist", "far").join(ways, ["node", "line_id"])
        stay = stay.select("origin", F.col("dst").alias("node"), "line_id", "transfers", (F.col("far") + F.col("dist")).alias("dist"))
        turn = lead.join(ways, "node").select("origin", F.col("dst").alias("node"), "line_id", (F.col("top.transfers") + 1).alias("transfers"), (F.col("top.dist") + F.col("dist")).alias("dist"))
        offers = stay.unionByName(turn).groupBy("origin", "node", "line_id").agg(F.min(cost).alias("new"))
        old = state.select("origin", "node", "line_id", cost.alias("old"))
        better = offers.join(old, ["origin", "node", "line_id"], "left").filter(F.col("old").isNull() | (F.col("new") < F.col("old")))
        fresh = settle(better.select("origin", "node", "line_id", "new.transfers", "new.dist"), "path-fresh")
        if fresh.isEmpty():
            break
        state = settle(state.join(fresh, ["origin", "node", "line_id"], "left_anti").unionByName(fresh), "path-state")
    else:
        raise RuntimeError("paths did not settle")
    best = state.groupBy("origin", "node").agg(F.min(F.struct("transfers", "dist")).alias("b"))
    return best.select("origin", "node", "b.transfers", "b.dist")


def travel_minutes(km, stations, transfers, walk_m=None):
    """Minutes at 80 km/h with 0.4 for each inner stop, 6 for a transfer and 1 for 100 m on foot, rounded up."""
    walk = F.lit(0.0) if walk_m is None else walk_m / 100
    return F.ceil(km / 80 * 60 + F.greatest(stations - 2, F.lit(0)) * 0.4 + 6 * transfers + walk).cast("long")


def line_sequence(path: DataFrame, graph: DataFrame) -> DataFrame:
    """``path_id, pos, line_id``: the line taken on each step of a path.

    A line is kept while it goes on; else the one that goes on longest is taken, ties to the smallest.
    Each path is one task's row.
    """
    steps = segments(path, "path_id").select("path_id", "pos", F.col("a").alias("src"), F.col("b").alias("dst"))
    lines = steps.join(graph.select("src", "dst", "line_id").distinct(), ["src", "dst"]).groupBy("path_id", "pos").agg(F.array_sort(F.collect_set("line_id")).alias("lines"))

    def pick(path: int, found: list[tuple]) -> list[tuple]:
        options, out, line = [set(lines) for _, lines in found], [], None
        for i, here in enumerate(options):
            if line not in here:
                left = {}
                for c in here:
                    left[c] = next((k for k in range(i, len(options)) if c not in options[k]), len(options))
                line = min(here, key=lambda c: (-left[c], c))
            out.append((path, found[i][0], line))
        return out

    return by_route(lines.withColumn("at", F.col("pos")), "path_id", ["at", "lines"], pick, "path_id long, pos int, line_id long")
