"""Queries of the viewer's lookups, of line files and of small selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.operators import viewer as V
from loomgrid.plans import fixtures as X
from loomgrid.plans.fixtures import with_tables
from loomgrid.plans.graph_queries import _groups
from loomgrid.plans.registry import Register

query = Register()
QUERIES, ORACLES = query.queries, query.oracles


@query(with_tables("routes steps", "select distinct a.src, a.dst, a.route_id as u, b.route_id as v from steps a join steps b on a.src=b.src and a.dst=b.dst and a.route_id<b.route_id"))
def shared_segments(spark, d):
    return V.shared_segments(X.routes(spark, d))


@query(with_tables("routes", "select distinct p.route_id%6 as a, q.route_id%6 as b from routes p join routes q using (node_id) where p.route_id%6<q.route_id%6"))
def group_links(spark, d):
    return V.group_links(X.routes(spark, d), _groups(spark, d))


@query(with_tables("routes", "select node_id, count(distinct route_id) as n_lines, min(route_id) as first_line from routes group by 1"))
def vertex_lines(spark, d):
    return V.vertex_lines(X.routes(spark, d)).select("node_id", F.size("lines").cast("long").alias("n_lines"), F.get("lines", F.lit(0)).alias("first_line"))


@query(with_tables("routes stations nodes", """select route_id, count(*) filter (node_id%2=0) as n_stations, round(coalesce(sum(step),0),6) as length, min_by(name,pos) as first_stop, max_by(name,pos) as last_stop from (select route_id, pos, r.node_id, s.name, sqrt((n.x-lag(n.x) over w)*(n.x-lag(n.x) over w)+(n.y-lag(n.y) over w)*(n.y-lag(n.y) over w)) as step
 from routes r join nodes n using (node_id) join stations s on s.station_id=r.node_id window w as (partition by route_id order by pos)) group by 1"""))
def line_profile(spark, d):
    s = X.stations(spark, d).select(F.col("station_id").alias("node_id"), (F.col("station_id") % 2 == 0).alias("is_station"), "name")
    return V.line_profile(X.routes(spark, d), X.nodes(spark, d), s).withColumn("length", F.round("length", 6))


@query(with_tables("routes nodes places", "select place_id as click_id, node_id from (select place_id, n.node_id, row_number() over (partition by place_id order by abs(n.x-p.x)+abs(n.y-p.y), n.node_id) as rn from places p cross join nodes n where n.node_id in (select node_id from routes join orders on o_orderkey=route_id where o_orderstatus='O')) where rn=1"))
def nearest_visible(spark, d):
    clicks = X.places(spark, d).withColumnRenamed("place_id", "click_id")
    r = X.routes(spark, d)
    return V.nearest_visible(clicks, X.nodes(spark, d), r, X.load(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("route_id")))


@query(with_tables("stations", "select station_id as node_id, 'n'||station_id as name from stations"))
def coordinate_join(spark, d):
    s = X.stations(spark, d).select(F.col("station_id").alias("node_id"), (F.col("x") / 1e6).alias("lon"), (F.col("y") / 1e6).alias("lat"))
    keyed = s.select(F.round(F.col("lon") * 1e6).cast("long").alias("kx"), F.round(F.col("lat") * 1e6).cast("long").alias("ky"), F.concat(F.lit("n"), F.col("node_id").cast("string")).alias("name"))
    return V.by_coordinate(keyed, s).select("node_id", "name")


@query(with_tables("poi", "select poi_id from poi where poi_id%(greatest(1,(select count(*) from poi)//50))=0 and poi_id<greatest(1,(select count(*) from poi)//50)*50"))
def strided_sample(spark, d):
    p = X.poi(spark, d)
    return V.strided(p, F.col("poi_id"), 50, p.count()).select("poi_id")


@query(with_tables("nodes", "select node_id from nodes order by score desc, node_id limit 30"))
def start_pool(spark, d):
    return X.nodes(spark, d).orderBy(F.col("score").desc(), "node_id").limit(30).select("node_id")


@query(with_tables("nodes", "select node_id, round(score+0.5e0*case when score>0 then 10 else 0 end,6) as score from nodes"))
def node_scores_with_demand(spark, d):
    n = X.nodes(spark, d)
    return V.combined_score(n, n.filter("score > 0").select("node_id", F.lit(10.0).alias("demand")), 0.5).withColumn("score", F.round("score", 6))


@query("""select n_nationkey as k, case when n_nationkey in (select s_nationkey from supplier) then 'both' else 'left' end as side from nation where n_nationkey not in (select c_nationkey from customer where c_acctbal<-900)""")
def set_operations(spark, d):
    """Set difference, intersection and union of ids."""
    n = X.load(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    s = X.load(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    rest = n.exceptAll(X.load(spark, d, "customer").filter("c_acctbal < -900").select(F.col("c_nationkey").alias("k")).distinct())
    both = rest.intersect(s).withColumn("side", F.lit("both"))
    return both.union(rest.subtract(s).withColumn("side", F.lit("left")))


@query(with_tables("routes nodes steps edges", "select route_id as line_id, count(*) as n_vertices, round(any_value(len),6) as length from routes join (select route_id, sum(weight) as len from steps join edges using (src,dst) group by 1) using (route_id) group by 1"))
def lines_roundtrip(spark, d):
    """Lines as files hold them: vertex arrays, taken apart again."""
    from loomgrid.sources.geojson import line_rows

    n = X.nodes(spark, d).withColumns({"lon": F.col("x") / 1e6, "lat": F.col("y") / 1e6})
    marks = n.select("node_id", F.lit(True).alias("is_station"), F.lit("").alias("name"))
    lines = line_rows(X.routes(spark, d), n, X.edges(spark, d), _groups(spark, d), marks)
    total = F.aggregate("segment_lengths", F.lit(0.0), lambda s, v: s + v)
    return lines.select("line_id", F.size("coordinates").cast("long").alias("n_vertices"), F.round(total, 6).alias("length"))


@query(with_tables("stations", "select station_id as k, round(x,6) as x, round(y,6) as y from stations"))
def geometry_points(spark, d):
    s = X.stations(spark, d)
    near = lambda dx, dy: F.array(F.col("x") + dx, F.col("y") + dy)
    square = F.array(near(-1, -1), near(1, -1), near(1, 1), near(-1, 1))
    kind = F.col("station_id") % 3
    rows = s.select(
        F.col("station_id").alias("k"), F.when(kind == 0, "Point").when(kind == 1, "LineString").otherwise("Polygon").alias("geometry_type"),
        F.when(kind == 0, F.to_json(near(0, 0))).when(kind == 1, F.to_json(square)).otherwise(F.to_json(F.array(square))).alias("coordinates"),
    )
    return V.drawn_parts(rows).select("k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(with_tables("routes steps", "select a.route_id, a.pos, a.node_id as a, b.node_id as b from routes a join routes b on a.route_id=b.route_id and b.pos=a.pos+1 where not exists (select 1 from steps s where s.src=least(a.node_id,b.node_id) and s.dst=greatest(a.node_id,b.node_id) and s.route_id<>a.route_id)"))
def unshared_segments(spark, d):
    """Steps that no other route takes: an anti-join on the edge."""
    from loomgrid.operators.routes import segments

    steps = segments(X.routes(spark, d))
    uses = steps.select("src", "dst", "route_id").distinct().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return steps.join(uses, ["src", "dst"], "left_anti").select("route_id", "pos", "a", "b")
