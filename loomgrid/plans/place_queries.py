"""Queries of the spatial, demand and kernel-density operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions import geo
from loomgrid.functions import scalars as S
from loomgrid.operators import demand as D
from loomgrid.operators import spatial as P
from loomgrid.plans import fixtures as X
from loomgrid.plans.fixtures import with_tables
from loomgrid.plans.registry import Register

query = Register()
QUERIES, ORACLES = query.queries, query.oracles

INSIDE = "sum(case when ((r.y1>p.y)<>(r.y2>p.y)) and p.x<(r.x2-r.x1)*(p.y-r.y1)/nullif(r.y2-r.y1,0)+r.x1 then 1 else 0 end)%2=1"


@query(with_tables("blocks ring_edges", f"select distinct block_id from (select block_id, poly_id from blocks p cross join ring_edges r group by block_id, poly_id having {INSIDE})"))
def points_in_polygons(spark, d):
    return P.points_in_polygons(X.blocks(spark, d), X.ring_edges(spark, d), "block_id").select("block_id")


@query(with_tables("blocks ring_edges", f"select block_id, h.poly_id from blocks left join (select block_id, poly_id from blocks p cross join ring_edges r group by block_id, poly_id having {INSIDE}) h using (block_id)"))
def spatial_left_join(spark, d):
    return P.points_in_polygons(X.blocks(spark, d), X.ring_edges(spark, d), "block_id", "left").select("block_id", "poly_id")


@query(with_tables("blocks stations", """select block_id, station_id, round(sqrt(d2),6) as dist from (select block_id, station_id, (b.x-s.x)*(b.x-s.x)+(b.y-s.y)*(b.y-s.y) as d2, row_number() over (partition by block_id order by (b.x-s.x)*(b.x-s.x)+(b.y-s.y)*(b.y-s.y), station_id) as rn from blocks b cross join stations s) where rn=1"""))
def nearest_station(spark, d):
    return P.nearest_join(X.blocks(spark, d), X.stations(spark, d), "block_id", "station_id").withColumn("dist", F.round("dist", 6))


@query(with_tables("stations poi", """select station_id, poi_id, round(sqrt(d2),6) as dist from (select station_id, poi_id, (b.x-s.x)*(b.x-s.x)+(b.y-s.y)*(b.y-s.y) as d2, row_number() over (partition by station_id order by (b.x-s.x)*(b.x-s.x)+(b.y-s.y)*(b.y-s.y), poi_id) as rn from stations b cross join poi s) where rn=1"""))
def nearest_poi_grid(spark, d):
    return P.nearest_join(X.stations(spark, d), X.poi(spark, d), "station_id", "poi_id", small=0).withColumn("dist", F.round("dist", 6))


@query(with_tables("blocks poi", "select b.block_id, count(p.poi_id) as n from blocks b left join poi p on (b.x-p.x)*(b.x-p.x)+(b.y-p.y)*(b.y-p.y)<=4000000 group by 1"))
def poi_within_radius(spark, d):
    pairs = P.radius_join(X.blocks(spark, d).select("block_id", "x", "y"), X.poi(spark, d).select("poi_id", "x", "y"), 2000.0, "left")
    return pairs.groupBy("block_id").agg(F.count("poi_id").alias("n"))


@query(with_tables("blocks stations", "select b.block_id, s.station_id from blocks b join stations s on (b.x-s.x)*(b.x-s.x)+(b.y-s.y)*(b.y-s.y)<=25000000"))
def radius_pairs(spark, d):
    return P.radius_join(X.blocks(spark, d).select("block_id", "x", "y"), X.stations(spark, d).select("station_id", "x", "y"), 5000.0).select("block_id", "station_id")


_COVER = "hits as (select block_id, count(*) as c from blocks b join stations s on (b.x-s.x)*(b.x-s.x)+(b.y-s.y)*(b.y-s.y)<=25000000 group by 1)"


@query(with_tables("blocks stations", "select round(100.0e0*(select count(*) from hits)/(select count(*) from blocks),6) as pct_covered", _COVER))
def catchment_coverage(spark, d):
    return P.catchment_coverage(X.blocks(spark, d), X.stations(spark, d), "block_id", 5000.0).select(F.round("pct_covered", 6).alias("pct_covered"))


@query(with_tables("blocks stations", "select round(100.0e0*(select count(*) from hits)/(select count(*) from blocks),6) as pct_covered, round(100.0e0*(select avg(c) from hits)/(select count(*) from stations),6) as mean_overlap_pct", _COVER))
def coverage_overlap(spark, d):
    out = P.catchment_coverage(X.blocks(spark, d), X.stations(spark, d), "block_id", 5000.0)
    return out.select(F.round("pct_covered", 6).alias("pct_covered"), F.round("mean_overlap_pct", 6).alias("mean_overlap_pct"))


@query(with_tables("poi network", "select edge_id, row_type from network"))
def row_type_tags(spark, d):
    return X.network(spark, d).select("edge_id", "row_type")


_RANK = "case row_type when 'subway_tunnel' then 0 when 'subway_surface' then 1 when 'rail_existing' then 2 when 'elevated' then 3 when 'street' then 4 else 5 end"


@query(with_tables("routes nodes steps poi network", f"""select route_id, pos, coalesce(min_by(row_type, case when row_type is not null then {_RANK} end),'street') as row_type
 from (select route_id, pos, (p.x+q.x)/2 as mx, (p.y+q.y)/2 as my from steps join nodes p on p.node_id=a join nodes q on q.node_id=b) m left join network n on ((n.x1+n.x2)/2-mx)*((n.x1+n.x2)/2-mx)+((n.y1+n.y2)/2-my)*((n.y1+n.y2)/2-my)<=4000000 group by route_id, pos"""))
def row_type_nearest(spark, d):
    return _typed_steps(spark, d).select("route_id", "pos", "row_type")


def _typed_steps(spark, d):
    from loomgrid.plans.table_queries import _step_lengths

    steps = _step_lengths(spark, d)
    mids = steps.select("route_id", "pos", "length_m", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    return P.nearest_track(mids, X.network(spark, d), "route_id", 2000.0, ("pos", "length_m"))


@query(with_tables("stations poi network", """select station_id, round(case when edge_id is null then x else sx end,6) as sx, round(case when edge_id is null then y else sy end,6) as sy, edge_id from (select *, row_number() over (partition by station_id order by gap nulls last, edge_id) as rn from (
 select station_id, x, y, edge_id, x1+t*(x2-x1) as sx, y1+t*(y2-y1) as sy, sqrt((x-(x1+t*(x2-x1)))*(x-(x1+t*(x2-x1)))+(y-(y1+t*(y2-y1)))*(y-(y1+t*(y2-y1)))) as gap from (
 select s.*, n.edge_id, n.x1, n.y1, n.x2, n.y2, case when (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)=0 then 0 else greatest(0.0e0,least(1.0e0,((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) end as t
 from stations s left join network n on ((n.x1+n.x2)/2-s.x)*((n.x1+n.x2)/2-s.x)+((n.y1+n.y2)/2-s.y)*((n.y1+n.y2)/2-s.y)<=9000000))) where rn=1"""))
def segment_projection(spark, d):
    out = P.snap_points(X.stations(spark, d), X.network(spark, d), "station_id", 3000.0)
    return out.select("station_id", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"), "edge_id")


def _quad_sql() -> str:
    parts = ["b0 as (select '0' as box, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from blocks)"]
    for k in range(3):
        parts.append(f"r{k} as (select b.*, p.block_id, p.x, p.y, row_number() over (partition by box order by balance desc, block_id) as rn from b{k} b join blocks p on p.x between x0 and x1 and p.y between y0 and y1)")
        parts.append(f"p{k} as (select * from r{k} where rn=2)")
        parts.append(f"b{k + 1} as (select box||'0' as box, x0, x as x1, y0, y as y1 from p{k} union all select box||'1', x, x1, y0, y from p{k} union all select box||'2', x0, x, y, y1 from p{k} union all select box||'3', x, x1, y, y1 from p{k})")
    return with_tables("blocks", "select cast(level as int) as level, box as box_id, block_id as sid from (select 0 as level, * from p0 union all select 1, * from p1 union all select 2, * from p2)", ",\n".join(parts))


@query(_quad_sql())
def quadtree_seeds(spark, d):
    rows = X.blocks(spark, d).select(F.col("block_id").alias("sid"), "x", "y", F.col("balance").alias("likelihood"))
    return P.quadtree_seeds(rows, 3)


_COUNT = "(select count(*) from poi p where (b.x-p.x)*(b.x-p.x)+(b.y-p.y)*(b.y-p.y)<=4000000)"
_NEAR = "(select min(sqrt((b.x-s.x)*(b.x-s.x)+(b.y-s.y)*(b.y-s.y))) from stations s)"


def _mm(c: str) -> str:
    return f"case when max({c}) over ()=min({c}) over () then 0 else ({c}-min({c}) over ())/((max({c}) over ())-(min({c}) over ())) end"


@query(with_tables("blocks stations poi", f"""select block_id, round(1.0e0*p+0.4e0*c+0.25e0*(1-t)+0.35e0*(1-i),6) as demand_score from (select block_id, {_mm('den')} as p, {_mm('cnt')} as c, {_mm('near')} as t, {_mm('balance')} as i
 from (select block_id, balance, case when aland+awater=0 then 0 else pop/(aland+awater)*1000 end as den, {_COUNT} as cnt, {_NEAR} as near from blocks b))"""))
def block_demand(spark, d):
    b = X.blocks(spark, d).withColumnRenamed("balance", "median_income")
    out = D.block_demand(b, X.poi(spark, d), X.stations(spark, d), ["median_income"], 2000.0)
    return out.select("block_id", F.round("demand_score", 6).alias("demand_score"))


@query(with_tables("blocks stations poi", f"""select tract as area_id, round(1.0e0*p+0.4e0*c+0.25e0*(1-t)+0.35e0*((1-i)+(1-i))/2,6) as demand_score from (select tract, {_mm('pop')} as p, {_mm('cnt')} as c, {_mm('near')} as t, {_mm('inc')} as i
 from (select tract, pop, inc, {_COUNT} as cnt, {_NEAR} as near from (select tract, avg(x) as x, avg(y) as y, sum(pop) as pop, avg(balance) as inc from blocks group by tract) b))"""))
def area_demand(spark, d):
    areas = X.blocks(spark, d).groupBy(F.col("tract").alias("area_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.sum("pop").alias("pop"), F.avg("balance").alias("median_income"))
    out = D.area_demand(areas, X.poi(spark, d), X.stations(spark, d), ["median_income"], 2000.0)
    return out.select("area_id", F.round("demand_score", 6).alias("demand_score"))


@query(with_tables("nodes poi", """select node_id, round(coalesce(sum(demand_score*exp(-((n.x-p.x)*(n.x-p.x)+(n.y-p.y)*(n.y-p.y))/2250000.0e0)),0),6) as demand from nodes n left join poi p on (n.x-p.x)*(n.x-p.x)+(n.y-p.y)*(n.y-p.y)<=9000000 group by node_id"""))
def node_demand(spark, d):
    return D.node_demand(X.nodes(spark, d), X.poi(spark, d), 3000.0).select("node_id", F.round("demand", 6).alias("demand"))


def _kde(px: str, py: str, h: float) -> str:
    return f"sum(exp(-((s.x-{px})*(s.x-{px})+(s.y-{py})*(s.y-{py}))/(2*{h}e0*{h}e0)))/(count(*)*2*pi()*{h}e0*{h}e0)"


@query(with_tables("poi", f"""select cast(i as int) as i, cast(j as int) as j, round(1e9*{_kde('i*10000.0e0', 'j*10000.0e0', 2000.0)},5) as density from range(11) a(i) cross join range(11) b(j) cross join poi s group by i, j"""))
def kde_grid(spark, d):
    axis = spark.range(11)
    grid = axis.select(F.col("id").cast("int").alias("i")).join(F.broadcast(axis.select(F.col("id").cast("int").alias("j"))))
    grid = grid.select(F.struct("i", "j").alias("at"), (F.col("i") * 10000.0).alias("x"), (F.col("j") * 10000.0).alias("y"))
    return D.density_at(grid, X.poi(spark, d), "at", 2000.0).select("at.i", "at.j", F.round(F.col("density") * 1e9, 5).alias("density"))


@query(with_tables("nodes poi", f"""select node_id, round(1e10*avg(den),3) as score from (select node_id, o, {_kde('px', 'py', 2000.0)} as den from (
 select node_id, o, x+case when o=0 then 0 else 1000.0e0*cos((o-1)*2*pi()/16) end as px, y+case when o=0 then 0 else 1000.0e0*sin((o-1)*2*pi()/16) end as py from nodes cross join range(17) r(o)) q cross join poi s group by node_id, o) group by node_id"""))
def kde_node_score(spark, d):
    return D.radial_score(X.nodes(spark, d), X.poi(spark, d), 2000.0).select("node_id", F.round("score", 3).alias("score"))


@query(with_tables("stations poi", f"""select station_id, round(sum(den)*pow(2*5000.0e0/9,2),6) as mass from (select station_id, dx, dy, {_kde('x0+dx', 'y0+dy', 2000.0)} as den from (
 select station_id, t.x as x0, t.y as y0, -5000+i*1250.0e0 as dx, -5000+j*1250.0e0 as dy from stations t cross join range(9) a(i) cross join range(9) b(j) where sqrt((-5000+i*1250.0e0)*(-5000+i*1250.0e0)+(-5000+j*1250.0e0)*(-5000+j*1250.0e0))<=5000) q cross join poi s group by station_id, dx, dy) group by station_id"""))
def catchment_mass(spark, d):
    return D.catchment_mass(X.stations(spark, d), X.poi(spark, d), 2000.0, 5000.0, 9).select("station_id", F.round("mass", 6).alias("mass"))


@query(with_tables("blocks", "select block_id, greatest(1, cast(floor(pop*0.002) as bigint)) as n from blocks where pop>0"))
def population_samples(spark, d):
    return D.population_samples(X.blocks(spark, d), 0.002).groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("stations ring_edges",f"""select count(*) as n, round(avg(dist),6) as mean_m from (select p.id, min(sqrt((p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y))) as dist
 from (select distinct id, x, y from (select id, p.x, p.y, poly_id from darts p cross join ring_edges r group by id, p.x, p.y, poly_id having {INSIDE})) p cross join stations s group by p.id)""",
 "darts as (select id, ((id*40503)%65536+0.5e0)/65536.0e0*100000.0e0 as x, ((id*30011+12345)%65521+0.5e0)/65521.0e0*100000.0e0 as y from range(4000) t(id))"))
def avg_dist_polygon(spark, d):
    """Mean way from 4,000 spread points, those inside the polygons, to the nearest station."""
    edges = X.ring_edges(spark, d)
    spread = lambda a, b, m: (F.pmod(F.col("id") * a + b, F.lit(m)) + 0.5) / float(m) * 100000.0
    darts = spark.range(4000).select("id", spread(40503, 0, 65536).alias("x"), spread(30011, 12345, 65521).alias("y"))
    inside = P.points_in_polygons(darts, edges, "id")
    return P.nearest_join(inside, X.stations(spark, d), "id", "station_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dist"), 6).alias("mean_m"))


@query(with_tables("", "select poly_id, round(a,3) as area, round(cx,3) as cx, round(cy,3) as cy from (values (1, 1400000000.0e0, 25000.0e0, 22500.0e0), (2, 1500000000.0e0, (1800000000.0e0*72500-300000000.0e0*70000)/1500000000.0e0, (1800000000.0e0*25000-300000000.0e0*22500)/1500000000.0e0)) t(poly_id, a, cx, cy)", "unused as (select 1)"))
def polygon_measures(spark, d):
    shapes: dict[int, list] = {}
    for p, ring in X.RINGS:
        if p in (1, 2):
            shapes.setdefault(p, []).append([(float(x), float(y)) for x, y in ring])
    rows = spark.createDataFrame(list(shapes.items()), "poly_id int, rings array<array<struct<x:double,y:double>>>")
    cx, cy = geo.polygon_centroid(F.col("rings"))
    return rows.select("poly_id", F.round(geo.polygon_area(F.col("rings")), 3).alias("area"), F.round(cx, 3).alias("cx"), F.round(cy, 3).alias("cy"))


@query(with_tables("stations places", """select station_id, case when row_number() over (partition by base order by station_id)>1 then base||' '||row_number() over (partition by base order by station_id) else base end as name
 from (select station_id, trim(split_part(label,'-',2)) as base from (select s.station_id, p.label, row_number() over (partition by station_id order by (s.x-p.x)*(s.x-p.x)+(s.y-p.y)*(s.y-p.y), place_id) as rn from stations s cross join places p) where rn=1)"""))
def station_names(spark, d):
    from loomgrid.operators.routes import name_stations

    return name_stations(X.stations(spark, d), X.places(spark, d))


@query(with_tables("stations poi", """select station_id, round(case when t>0 then pull*350000.0e0/t else 350000.0e0/n end,6) as daily from (select *, sum(pull) over () as t, count(*) over () as n from (select s.station_id, coalesce(sum(demand_score*exp(-0.0008e0*sqrt((s.x-p.x)*(s.x-p.x)+(s.y-p.y)*(s.y-p.y)))),0) as pull from stations s left join poi p on (s.x-p.x)*(s.x-p.x)+(s.y-p.y)*(s.y-p.y)<=4000000 group by 1))"""))
def station_boardings(spark, d):
    return _daily(spark, d).select("station_id", F.round("daily", 6).alias("daily"))


def _daily(spark, d):
    from loomgrid.operators.models import station_boardings as boardings

    return boardings(X.stations(spark, d), X.poi(spark, d), 2000.0)


@query(with_tables("places", "select place_id, feasible from (select place_id, not ((x-50000)*(x-50000)+(y-50000)*(y-50000)<15000.0e0*15000 or (x-20000)*(x-20000)+(y-80000)*(y-80000)<9000.0e0*9000) as feasible from places)"))
def no_go_zones(spark, d):
    zones = spark.createDataFrame([(50000.0, 50000.0, 15000.0), (20000.0, 80000.0, 9000.0)], "zx double, zy double, r double")
    discs = F.broadcast(zones.agg(F.collect_list(F.struct("zx", "zy", "r")).alias("discs")))
    inside = F.exists("discs", lambda z: (z["zx"] - F.col("x")) ** 2 + (z["zy"] - F.col("y")) ** 2 < z["r"] ** 2)
    return X.places(spark, d).join(discs).select("place_id", (~inside).alias("feasible"))


@query(with_tables("places", "select place_id, x between 20000 and 60000 and y between 30000 and 80000 as urban, trim(split_part(label,'-',2)) as part from places"))
def urban_core(spark, d):
    p = X.places(spark, d)
    return p.select("place_id", (F.col("x").between(20000, 60000) & F.col("y").between(30000, 80000)).alias("urban"), S.label_part(F.col("label")).alias("part"))
