"""Edge cases of the transit operators on tables of a few rows."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.functions import geo
from loomgrid.functions import scalars as S
from loomgrid.operators import demand, generators, graph, models, packed, relational, routes, spatial, stats
from loomgrid.operators.components import connected_components


def one(df):
    return df.collect()[0]


def points(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} long, x double, y double")


@pytest.mark.parametrize(("values", "want"), [([], 0), ([0, 0], 0), ([1, 1, 1], 0), ([0, 0, 3], 2 / 3), ([-5, 0, 0, 3], 2 / 3), ([1, 2, 2, 5], 0.3)])
def test_gini(spark, values, want):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert one(stats.gini(df, "v"))["gini"] == pytest.approx(want)


def test_scalars(spark):
    df = spark.createDataFrame([("24031.0",), (" 7 ",), (None,), ("abc",), ("",), ("1234567",)], "g string")
    assert [r[0] for r in df.select(S.normal_geoid(F.col("g"), 6)).collect()] == ["024031", "000007", None, "abc", None, "1234567"]
    df = spark.createDataFrame([("9.01",), ("x",), (None,), ("0.125",)], "t string")
    assert [r[0] for r in df.select(S.tract_geoid(F.lit("11"), F.lit("001"), F.col("t"))).collect()] == ["11001000901", None, None, "11001000012"]
    df = spark.createDataFrame([("5", "0", "0"), ("x", "10", "0"), ("4", "2000", None)], "p string, l string, w string")
    assert [r[0] for r in df.select(S.density(F.col("p"), F.col("l"), F.col("w"))).collect()] == [0.0, 0.0, 2.0]
    assert S.geoid_column(spark.range(1).toDF("TRACT")) == "TRACT" and S.geoid_column(spark.range(1)) is None
    tags = spark.createDataFrame([({"railway": "subway", "tunnel": "yes"},), ({"railway": "rail"},), ({},), ({"highway": "x", "bridge": "viaduct"},)], "tags map<string,string>")
    assert [r[0] for r in tags.select(S.track_type(F.col("tags"))).collect()] == ["subway_tunnel", "rail_existing", "unknown", "elevated"]
    assert [r[0] for r in spark.createDataFrame([(None,), (80.0,), (61.0,), (1.0,)], "v double").select(S.severity(F.col("v"), 80, 60)).collect()] == ["ok", "alert", "warn", "ok"]


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 4.0)], "id int, v double")
    assert {r["v"] for r in stats.min_max(df, ["v"]).collect()} == {0.0}
    assert {r["v"] for r in stats.min_max(df, ["v"], constant=1.0).collect()} == {1.0}
    assert {r["v"] for r in stats.min_max(df, ["v"], epsilon=1e-12).collect()} == {0.0}
    assert {r["v"] for r in stats.standardise(df, ["v"]).collect()} == {0.0}


def test_dense_rank(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 3.0, None, 2.0] + [float(k) for k in range(10, 60)])], "id int, v double")
    got = {r["id"]: r["rnk"] for r in stats.dense_rank_of(df, "v", "rnk").collect()}
    distinct = sorted({r["v"] for r in df.collect() if r["v"] is not None}, reverse=True)
    want = {r["id"]: distinct.index(r["v"]) + 1 if r["v"] is not None else len(distinct) + 1 for r in df.collect()}
    assert got == want


def test_joins_against_brute_force(spark):
    rng = random.Random(1)
    a = [(i, rng.uniform(-900, 900), rng.uniform(-900, 900)) for i in range(80)] + [(80, None, 1.0)]
    b = [(i, rng.uniform(-900, 900), rng.uniform(-900, 900)) for i in range(50)] + [(60, b0, b1) for b0, b1 in [(a[0][1], a[0][2])]]
    left, right = points(spark, a, "l"), points(spark, b, "r")
    near = {(p[0], q[0]) for p in a for q in b if p[1] is not None and math.dist(p[1:], q[1:]) <= 150}
    assert {(x["l"], x["r"]) for x in spatial.radius_join(left, right, 150.0).collect()} == near
    best = {p[0]: min((math.dist(p[1:], q[1:]), q[0]) for q in b) for p in a if p[1] is not None}
    for small in (0, 1000):
        got = {x["l"]: (x["dist"], x["r"]) for x in spatial.nearest_join(left, right, "l", "r", small).collect() if x["dist"] is not None}
        assert got.keys() == best.keys() and all(got[k][1] == best[k][1] and got[k][0] == pytest.approx(best[k][0]) for k in best)
    none = spatial.nearest_join(left, right.limit(0), "l", "r").collect()
    assert len(none) == len(a) and all(x["dist"] is None for x in none)
    exact = spatial.radius_join(points(spark, [(1, 0.0, 0.0)], "l"), points(spark, [(1, 3.0, 4.0)], "r"), 5.0)
    assert exact.count() == 1


def test_radius_join_broadcasts_no_copies(spark):
    for how in ("inner", "left"):
        pairs = spatial.radius_join(points(spark, [(1, 0.0, 0.0)], "l"), points(spark, [(1, 3.0, 4.0)], "r"), 5.0, how)
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_track_types_by_cells(spark):
    """Cells decide alike with brute force, and a crowd of tracks is not joined pair by pair."""
    rng, kinds = random.Random(5), ["subway_tunnel", "elevated", "street", "unknown", None]
    tracks = [(x := rng.uniform(0, 6000), y := rng.uniform(0, 6000), x, y, rng.choice(kinds[(x < 4000) * (y < 5000):])) for _ in range(150)]
    spots = [(i, rng.uniform(-900, 7000), rng.uniform(-900, 7000)) for i in range(400)] + [(400, None, 1.0)]
    network = spark.createDataFrame(tracks, "x1 double, y1 double, x2 double, y2 double, row_type string")
    got = {r["id"]: r["row_type"] for r in spatial.nearest_track(points(spark, spots), network, "id", 500.0).collect()}
    want = {i: min([kinds.index(k) for a, b, _, _, k in tracks if x is not None and k and (a - x) ** 2 + (b - y) ** 2 <= 250_000], default=2) for i, x, y in spots}
    assert got == {i: kinds[k] for i, k in want.items()}
    crowd = network.sparkSession.range(3000).select(*[F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit("rail_existing").alias("row_type"))
    many = spark.range(30_000).select("id", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    assert spatial.nearest_track(many, crowd, "id", 500.0).filter("row_type = 'rail_existing'").count() == 30_000
    plan = spatial.nearest_track(many, crowd, "id", 500.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "tcx" in plan


def test_line_cost_deals_out_its_lines_once(spark, sf_dir):
    from loomgrid.plans import graph_queries

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = graph_queries.line_cost(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    dealt = [line for line in plan.split("\n") if "REPARTITION_BY_COL" in line]
    assert len([line for line in dealt if "ReusedExchange" not in line]) == 1 and len(dealt) > 1


def test_polygon_with_hole(spark):
    ring = lambda p, r: [(p, *map(float, a), *map(float, b)) for a, b in zip(r, r[1:] + r[:1])]
    edges = spark.createDataFrame(ring(1, [(0, 0), (10, 0), (10, 10), (0, 10)]) + ring(1, [(4, 4), (6, 4), (6, 6), (4, 6)]) + ring(2, [(5, 0), (20, 0), (20, 5)]), "poly_id int, x1 double, y1 double, x2 double, y2 double")
    spots = points(spark, [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 9.0, 0.5), (4, 30.0, 1.0)])
    assert {(r["id"], r["poly_id"]) for r in spatial.points_in_polygons(spots, edges, "id", "left").collect()} == {(1, 1), (2, None), (3, 1), (3, 2), (4, None)}
    assert {r["id"] for r in spatial.points_in_polygons(spots, edges, "id").collect()} == {1, 3}


def test_geometry(spark):
    assert geo.vincenty(*(np.array([v]) for v in (0.0, 0.0, math.radians(1) * geo.RADIUS, 0.0)))[0] == pytest.approx(111319.491, abs=1e-3)
    north = geo.RADIUS * math.log(math.tan(math.pi / 4 + math.radians(1) / 2))
    assert geo.vincenty(*(np.array([v]) for v in (0.0, 0.0, 0.0, north)))[0] == pytest.approx(110574.389, abs=1e-3)
    assert geo.vincenty(*(np.array([5.0]) for _ in range(4)))[0] == pytest.approx(0.0, abs=1e-9)
    row = spark.createDataFrame([(1.0, 0.0, -1.0, 0.0)], "ax double, ay double, bx double, by double")
    args = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    straight = one(row.select(geo.angle_at(*args).alias("a"), geo.deviation_at(*args).alias("d")))
    assert straight["a"] == 180 and straight["d"] == pytest.approx(0)
    back = one(row.select(geo.angle_at(args[0], args[1], args[0], args[1]).alias("a"), geo.deviation_at(args[0], args[1], args[0], args[1]).alias("d")))
    assert back["a"] == 0 and back["d"] == -180
    assert one(row.select(geo.angle_at(args[0], args[1], F.lit(0.0), F.lit(0.0)).alias("a")))["a"] == 0


def test_keyed(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 2), (2, None, 1)], "k int, v string, o int")
    assert {(r["k"], r["v"]) for r in relational.first_by_key(df, ["k"], [F.col("o")]).collect()} == {(1, "b"), (2, None)}
    left = spark.createDataFrame([(1,), (3,)], "k int")
    assert {(r["k"], r["v"]) for r in relational.left_attach(left, df, "k", ["v", "none"], [F.col("o")]).collect()} == {(1, "b"), (3, None)}
    assert relational.left_attach(left, df, "k", ["none"], [F.col("o")]).columns == ["k"]
    pairs = spark.createDataFrame([(1, 2, 5)], "work_station long, home_station long, jobs long")
    assert [tuple(r) for r in relational.flow_matrix(pairs, [1, 2]).orderBy("work_station").collect()] == [(1, 0, 5), (2, 0, 0)]


def test_boardings(spark):
    stops = points(spark, [(1, 0.0, 0.0), (2, 5000.0, 0.0)], "station_id")
    far = spark.createDataFrame([(90000.0, 0.0, 3.0)], "x double, y double, demand_score double")
    assert {r["daily"] for r in models.station_boardings(stops, far, total=100.0).collect()} == {50.0}
    assert {r["daily"] for r in models.station_boardings(stops, None, total=100.0).collect()} == {50.0}
    near = spark.createDataFrame([(0.0, 0.0, 3.0), (5000.0, 0.0, 1.0)], "x double, y double, demand_score double")
    daily = models.station_boardings(stops, near, total=100.0)
    assert {r["station_id"]: r["daily"] for r in daily.collect()} == pytest.approx({1: 75.0, 2: 25.0})
    hourly = models.hourly_profile(daily)
    assert one(hourly.agg(F.sum("boardings").alias("s"), F.count_distinct("hour").alias("n"))).asDict() == pytest.approx({"s": 99.0, "n": 19})
    totals = {r["hour"]: r["boardings"] for r in models.hourly_totals(hourly, stops.limit(0)).collect()}
    assert len(totals) == 20 and totals[24] == 0 and totals[7] == pytest.approx(13.0)


def line_table(spark, walks):
    return spark.createDataFrame([(r, p, n) for r, walk in enumerate(walks) for p, n in enumerate(walk)], "route_id long, pos int, node_id long")


def edge_table(spark, pairs):
    return spark.createDataFrame([(min(a, b), max(a, b), float(w)) for a, b, w in pairs], "src long, dst long, weight double")


def test_line_groups_one_way_similarity(spark):
    walks = [[1, 2], [1, 2, 3, 4, 5, 6, 7, 8], [20, 21], [30]]
    edges = edge_table(spark, [(i, i + 1, 10) for i in range(1, 8)] + [(20, 21, 5)])
    got = {r["route_id"]: r["group"] for r in routes.similarity_groups(line_table(spark, walks), edges, 0.5).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2}


def test_transfers_unreachable(spark):
    lines = line_table(spark, [[1, 2], [2, 3], [8, 9]])
    groups = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "route_id long, group long")
    row = one(routes.transfer_burden(lines, groups))
    assert row["pct_unreachable"] == pytest.approx(60.0) and row["mean_transfers"] == pytest.approx(0.25)
    assert routes.transfer_burden(line_table(spark, [[1]]), groups).count() == 0


def brute_marks(walks, group, weight, spacing):
    """The marking rule walk by walk, in plain Python."""
    of = {}
    for r, walk in enumerate(walks):
        for n in walk:
            of.setdefault(n, set()).add(group[r])
    fixed = {n for walk in walks for i, n in enumerate(walk) if i in (0, len(walk) - 1) or len(of[n]) > 1}
    status = {}
    for walk in walks:
        for order in (walk, walk[::-1]):
            since = 0.0
            for i, n in enumerate(order):
                since += weight[frozenset(order[i - 1 : i + 1])] if i else 0.0
                status[n] = n in fixed or since >= spacing
                since = 0.0 if status[n] else since
    return status


def test_station_marks(spark):
    rng = random.Random(3)
    walks = [rng.sample(range(30), 9) for _ in range(6)]
    weight = {frozenset(p): rng.uniform(100, 900) for w in walks for p in zip(w, w[1:])}
    edges = edge_table(spark, [(*sorted(e), w) for e, w in weight.items()])
    group = {r: r % 3 for r in range(6)}
    groups = spark.createDataFrame(list(group.items()), "route_id long, group long")
    got = {r["node_id"]: r["is_station"] for r in routes.mark_stations(line_table(spark, walks), groups, edges, 1000.0).collect()}
    assert got == brute_marks(walks, group, weight, 1000.0)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    root = {}

    def find(n):
        root.setdefault(n, n)
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {n: find(n) for n in root}


def test_paths_prefer_fewer_transfers(spark):
    nodes = points(spark, [(i, float(i * 10), 0.0) for i in range(5)] + [(9, 20.0, 500.0)], "node_id")
    lines = line_table(spark, [[0, 1, 2], [2, 3, 4], [0, 9, 4]])
    got = {r["node"]: (r["transfers"], r["dist"]) for r in routes.best_paths(routes.line_graph(lines, nodes), spark.createDataFrame([(0,)], "node_id long")).collect()}
    assert got[4][0] == 0 and got[3] == (1, 30.0) and got[2] == (0, 20.0)


def test_paths_against_plain_search(spark):
    import heapq

    rng, steps = random.Random(3), []
    place = {i: (rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(12)}
    for line in range(14):
        steps += [(line, p, n) for p, n in enumerate(rng.sample(range(12), rng.randint(2, 5)))]
    g = routes.line_graph(spark.createDataFrame(steps, "route_id long, pos int, node_id long"), points(spark, [(i, *at) for i, at in place.items()], "node_id"))
    ways = [tuple(r) for r in g.select("src", "dst", "dist", "line_id").collect()]
    origin = min(w[0] for w in ways)
    best, heap = {}, [(0, 0.0, origin, line) for line in {w[3] for w in ways if w[0] == origin}]
    while heap:
        t, far, node, line = heapq.heappop(heap)
        if (node, line) not in best:
            best[node, line] = (t, far)
            for a, b, size, other in ways:
                if a == node:
                    heapq.heappush(heap, (t + (other != line), far + size, b, other))
    want = {n: min(v for (m, _), v in best.items() if m == n) for n, _ in best}
    got = {r["node"]: (r["transfers"], r["dist"]) for r in routes.best_paths(g, spark.createDataFrame([(origin,)], "node_id long")).collect()}
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n]) for n in want)


def test_graph_features(spark):
    edges = edge_table(spark, [(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 1)])
    got = {r["node"]: (r["degree"], round(r["clustering"], 6)) for r in graph.clustering(edges).collect()}
    assert got == {1: (2, 1.0), 2: (2, 1.0), 3: (3, round(1 / 3, 6)), 4: (1, 0.0)}
    between = {r["node"]: r["betweenness"] for r in graph.betweenness(edges).collect()}
    assert between == pytest.approx({1: 0.0, 2: 0.0, 3: 2 / 3, 4: 0.0})
    two = edge_table(spark, [(a, b, 1) for k in (0, 10) for a in range(k, k + 5) for b in range(a + 1, k + 5)] + [(0, 10, 1)])
    label = {r["node_id"]: r["community"] for r in graph.louvain(two, 1.0).collect()}
    assert len({label[n] for n in range(5)}) == 1 and len({label[n] for n in range(10, 15)}) == 1 and label[0] != label[10]
    left = {(r["src"], r["dst"]) for r in graph.reduce_degree(edge_table(spark, [(0, i, i) for i in range(1, 8)])).collect()}
    assert left == {(0, 1), (0, 2), (0, 3), (0, 4)}


def test_gabriel_starts_near(spark):
    """A first radius of everything does not make all pairs."""
    rng, sizes = random.Random(8), []
    spots = [(i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(300)]
    settle, graph.settle = graph.settle, lambda df, name: (table := settle(df, name), sizes.append(table.count()))[0]
    try:
        got = {(r["src"], r["dst"]) for r in graph.gabriel_edges(points(spark, spots), "id", 1500.0).collect()}
    finally:
        graph.settle = settle
    at = np.array([s[1:] for s in spots])
    apart = ((at[:, None] - at[None]) ** 2).sum(axis=2)
    want = {(p, q) for p in range(300) for q in range(p + 1, 300) if (np.delete(apart[p] + apart[q], [p, q]) >= apart[p, q]).all()}
    assert got == want
    assert max(sizes) < 300 * 299 / 2 / 4


def test_gabriel_is_complete(spark):
    rng = random.Random(4)
    spots = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(40)] + [(40 + i, 5000 + rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(10)]
    d2 = lambda p, q: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2
    want = {(p[0], q[0]) for p in spots for q in spots if p[0] < q[0] and not any(d2(p, r) + d2(q, r) < d2(p, q) for r in spots if r[0] not in (p[0], q[0]))}
    assert {(r["src"], r["dst"]) for r in graph.gabriel_edges(points(spark, spots, "id"), "id", 20.0).collect()} == want


def grid_world(spark, n=12, step=5000.0):
    nodes = spark.createDataFrame([(i * n + j, i * step, j * step, float((i * 7 + j * 3) % 11)) for i in range(n) for j in range(n)], "node_id long, x double, y double, score double")
    pairs = [(i * n + j, i * n + j + 1, step) for i in range(n) for j in range(n - 1)] + [(i * n + j, (i + 1) * n + j, step) for i in range(n - 1) for j in range(n)]
    return nodes, edge_table(spark, pairs)


LIMITS = generators.Limits(routes=4, low=15_000.0, high=40_000.0, min_angle=80.0, turn_high=300.0, turn_reset=10.0)


def check_routes(made, nodes, edges, per_set):
    """Invariants of generated routes: edges exist, no revisits, bounds up to one step, edge use."""
    step = {frozenset((r["src"], r["dst"])): r["weight"] for r in edges.collect()}
    sets = {}
    for r in made.orderBy("rep", "route_id", "pos").collect():
        sets.setdefault(r["rep"], {}).setdefault(r["route_id"], []).append(r["node_id"])
    for walks in sets.values():
        assert len(walks) == per_set
        use = {}
        for walk in walks.values():
            pairs = [frozenset(p) for p in zip(walk, walk[1:])]
            assert len(set(walk)) == len(walk) and all(p in step for p in pairs)
            assert LIMITS.low <= sum(step[p] for p in pairs) <= LIMITS.high + 5000
            for p in pairs:
                use[p] = use.get(p, 0) + 1
        assert max(use.values()) <= 4
    return sets


def test_generators(spark):
    nodes, edges = grid_world(spark)
    walks = generators.random_walks(nodes, edges, 3, LIMITS, seed=5)
    sets = check_routes(walks, nodes, edges, 4)
    again = generators.random_walks(nodes.repartition(7), edges.repartition(3), 3, LIMITS, seed=5)
    assert sets == check_routes(again, nodes, edges, 4)
    log = []
    check_routes(generators.ant_colony(nodes, edges, 3, 3, LIMITS, seed=1, progress=lambda *a: log.append(a)), nodes, edges, 4)
    assert [b for _, b, _ in log] == sorted(b for _, b, _ in log) and all(0 <= d <= 1 for *_, d in log)
    log.clear()
    check_routes(generators.genetic(nodes, edges, 4, 3, LIMITS, (0, 0, 1, 1), seed=1, caller=lambda *a: log.append(a)), nodes, edges, 4)
    assert [b for _, b, _ in log] == sorted(b for _, b, _ in log)
    before = generators.iterative_walks(nodes, edges, 0, 5, LIMITS, seed=2)
    after = generators.iterative_walks(nodes, edges, 3, 5, LIMITS, seed=2)
    check_routes(after, nodes, edges, 4)
    assert before.count() and after.count()
    with pytest.raises(RuntimeError):
        generators.ant_set(generators._terrain(nodes, edges, None), generators.Limits(routes=2, low=1e9, high=2e9), np.random.default_rng(0), {})
    with pytest.raises(ValueError):
        generators.crossed([[1]], [[1], [2]], None, LIMITS, 1)


def test_searches_make_no_objects_of_the_graph_on_the_driver(spark, monkeypatch):
    nodes, edges = grid_world(spark)
    expected = generators.walk_set(generators._terrain(nodes, edges, None), LIMITS, np.random.default_rng([5, 0]))

    def refused(*_):
        raise AssertionError("the driver holds the graph as objects")

    # Workers import the module anew, so only the driver is refused.
    monkeypatch.setattr(generators, "Terrain", refused)
    assert generators._walks(generators.random_walks(nodes, edges, 1, LIMITS, seed=5)) == {0: expected}
    check_routes(generators.ant_colony(nodes, edges, 3, 3, LIMITS, seed=1), nodes, edges, 4)
    check_routes(generators.genetic(nodes, edges, 4, 2, LIMITS, (0, 0, 1, 1), seed=1), nodes, edges, 4)
    check_routes(generators.iterative_walks(nodes, edges, 1, 5, LIMITS, seed=2), nodes, edges, 4)


def test_a_worker_builds_the_terrain_once():
    made = []
    for key in ("a", "a", "b", "b", "a"):
        generators._once("test", key, lambda key=key: made.append(key) or key)
    assert made == ["a", "b", "a"] and generators._BUILT.pop("test") == ("a", "a")


def test_population_samples_do_not_depend_on_partitions(spark):
    b = spark.createDataFrame([(i, 0.0, 0.0, float(i * 100), 5000.0, 0.0) for i in range(6)], "block_id long, x double, y double, pop double, aland double, awater double")
    one_way = sorted(map(tuple, demand.population_samples(b, 0.01).collect()))
    assert one_way == sorted(map(tuple, demand.population_samples(b.repartition(5), 0.01).collect()))
    assert [r["i"] for r in demand.population_samples(b.filter("pop = 0"), 0.01).collect()] == [1]


def test_quadtree_stops_at_single_rows(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 1.0, 1.0, 4.0), (3, 0.2, 0.9, 1.0)], "sid long, x double, y double, likelihood double")
    got = {(r["level"], r["sid"]) for r in spatial.quadtree_seeds(rows, 8).collect()}
    assert (0, 2) in got


def test_line_sequence(spark):
    rng = random.Random(6)
    lines = {k: set(zip(w, w[1:])) | {(b, a) for a, b in zip(w, w[1:])} for k, w in enumerate([list(range(12)), list(range(5, 20)), list(range(3, 9)), list(range(30, 40))])}
    paths = [list(range(a, a + rng.randint(2, 12))) for a in (0, 2, 4, 6, 30)]
    paths = [p for p in paths if all(any(s in own for own in lines.values()) for s in zip(p, p[1:]))]
    want = {}
    for k, path in enumerate(paths):
        steps, line = list(zip(path, path[1:])), None
        for i, step in enumerate(steps):
            if line is None or step not in lines[line]:
                run = {c: next((j for j in range(i, len(steps)) if steps[j] not in own), len(steps)) for c, own in lines.items() if step in own}
                line = min(run, key=lambda c: (-run[c], c))
            want[k, i] = line
    graph = spark.createDataFrame([(a, b, 1.0, k) for k, own in lines.items() for a, b in own], "src long, dst long, dist double, line_id long")
    table = line_table(spark, paths).withColumnRenamed("route_id", "path_id")
    assert want and {(r["path_id"], r["pos"]): r["line_id"] for r in routes.line_sequence(table, graph).collect()} == want


def test_log_density_without_cutoff(spark):
    """All samples count, also from so far that the density itself underflows."""
    rng = random.Random(8)
    samples = [(rng.uniform(0, 1e4), rng.uniform(0, 1e4)) for _ in range(230)]
    queries = [(i, rng.uniform(0, 1e4), rng.uniform(0, 1e4)) for i in range(20)] + [(20, 1e6, -1e6), (21, 2e6, 0.0)]
    frame = spark.createDataFrame(samples, "x double, y double").repartition(3)
    got = {r["k"]: r["log_density"] for r in demand.log_density_at(spark.createDataFrame(queries, "k long, x double, y double"), frame, "k", 500.0, block=50).collect()}
    for k, x, y in queries:
        exponents = [-((x - a) ** 2 + (y - b) ** 2) / (2 * 500.0**2) for a, b in samples]
        top = max(exponents)
        want = top + math.log(sum(math.exp(e - top) for e in exponents)) - math.log(len(samples) * 2 * math.pi * 500.0**2)
        assert got[k] == pytest.approx(want, rel=1e-12)


def test_mean_distance_inside(spark):
    square = [(0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (0.0, 1000.0)]
    moved = [(x + 500.0, y) for x, y in square]
    rows = [(p, *a, *b) for p, ring in ((1, square), (2, moved)) for a, b in zip(ring, ring[1:] + ring[:1])]
    edges = spark.createDataFrame(rows, "poly_id int, x1 double, y1 double, x2 double, y2 double")
    thrown = spatial.darts(spark, edges, 4000, 1)
    sites = spark.createDataFrame([(1, 0.0, 0.0)], "station_id long, x double, y double")
    row = spatial.mean_distance_inside(thrown, edges, sites).head()
    assert row["n"] == thrown.count() and row["mean_m"] == pytest.approx(968, rel=0.03)
    assert spatial.mean_distance_inside(thrown, edges, sites.limit(0)).head()["mean_m"] is None


def test_mutation_changes_one_route_at_most():
    near = [(i, j) for i in range(5) for j in range(5)]
    nodes = [(5 * i + j, 1000.0 * i, 1000.0 * j, 1.0) for i, j in near]
    links = [(5 * i + j, 5 * (i + di) + j + dj, 1000.0) for i, j in near for di, dj in ((1, 0), (0, 1), (1, 1)) if i + di < 5 and j + dj < 5]
    terrain = generators.Terrain(nodes, links, [])
    limits = generators.Limits(routes=3, low=1.0, high=1e9)
    sets, changed = [[0, 1, 2, 3, 4], [0, 5, 10, 15, 20], [20, 21, 22]], 0
    for seed in range(300):
        out = generators.mutate(sets, terrain, limits, np.random.default_rng(seed))
        apart = [k for k in range(3) if out[k] != sets[k]]
        assert len(apart) <= 1 and all(generators.is_valid(w, terrain, limits) for w in out)
        changed += len(apart)
    assert 5 < changed < 100


def test_density_counts_every_sample_without_pairs(spark):
    rng = np.random.default_rng(3)
    samples, queries, h = rng.uniform(-8000, 20000, (700, 2)), rng.uniform(-15000, 30000, (90, 2)), 1500.0
    s = spark.createDataFrame([tuple(map(float, v)) for v in samples] + [(None, 1.0), (float("nan"), 2.0)], "x double, y double")
    q = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(queries)] + [(990, None, 1.0), (991, float("nan"), 0.0)], "id int, x double, y double")
    scale = 702 * 2 * np.pi * h * h
    got = {r["id"]: r["density"] for r in demand.density_at(q, s, "id", h).collect()}
    assert got.pop(990) == got.pop(991) == 0.0
    for i, at in enumerate(queries):
        assert abs(got[i] * scale - np.exp(-((samples - at) ** 2).sum(axis=1) / (2 * h * h)).sum()) < 1e-11
    assert demand.density_at(q, s.limit(0), "id", h).filter("density <> 0").isEmpty()


def _random_graph(n, m, seed):
    rng = random.Random(seed)
    return sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def test_clustering_by_buckets(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGES_A_TASK", 60)
    edges = _random_graph(40, 260, 1)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    got = {r["node"]: (r["degree"], r["clustering"]) for r in graph.clustering(spark.createDataFrame(edges, "src long, dst long").repartition(3)).collect()}
    assert set(got) == set(near)
    for u, ends in near.items():
        closed = sum(w in near[v] for v in ends for w in ends)
        assert got[u] == (len(ends), pytest.approx(closed / max(1, len(ends) * (len(ends) - 1))))


def test_betweenness_brings_only_pivots_to_the_driver(spark, monkeypatch):
    edges = _random_graph(30, 60, 4)
    df = spark.createDataFrame(edges, "src long, dst long")
    brought, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: brought.append(collect(self)) or brought[-1])
    out = graph.betweenness(df, pivots=5)
    assert max(map(len, brought), default=0) <= 5
    monkeypatch.undo()
    assert out.count() == len({v for e in edges for v in e})
    star = spark.createDataFrame([(0, i) for i in range(1, 6)] + [(8, 9)], "src long, dst long")
    assert {r["node"]: round(r["betweenness"], 9) for r in graph.betweenness(star).collect()} == {0: round(20 / 42, 9), **dict.fromkeys([1, 2, 3, 4, 5, 8, 9], 0.0)}


def _bytes_an_edge(run, n):
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1] / n
    tracemalloc.stop()
    return out, peak


def test_louvain_takes_few_bytes_an_edge():
    groups, each = 20, 120
    pairs = [(g * each + i, g * each + j) for g in range(groups) for i in range(each) for j in range(i)] + [(g * each, g * each + each) for g in range(groups - 1)]
    ends = np.array(pairs, dtype="int32")
    member, peak = _bytes_an_edge(lambda: graph._communities(*packed.neighbours(groups * each, [(ends[:, 0], ends[:, 1])]), 1.0, 0), len(pairs))
    assert [len(set(member[g * each : (g + 1) * each])) for g in range(groups)] == [1] * groups and len(set(member)) == groups
    assert peak < 100


def test_degree_reduction_takes_few_bytes_an_edge():
    n, rng = 600, np.random.default_rng(5)
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    key, weight = np.array([a * n + b for a, b in pairs]), rng.integers(0, 50, len(pairs)).astype("float64")
    (kept, _), peak = _bytes_an_edge(lambda: graph._reduced(key, weight, n, 4), len(pairs))
    assert peak < 100
    alive, at = dict(zip(pairs, weight.tolist())), {}
    for e in alive:
        for node in e:
            at.setdefault(node, set()).add(e)
    for node in sorted(at):
        for e in sorted(at[node], key=lambda e: (-alive[e], e))[: max(0, len(at[node]) - 4)]:
            for end in e:
                at[end].discard(e)
            del alive[e]
    assert [(k // n, k % n) for k in kept.tolist()] == sorted(alive)
