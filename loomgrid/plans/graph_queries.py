"""Queries of the graph, route, cost, fitness and search operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.operators import generators as I
from loomgrid.operators import graph as G
from loomgrid.operators import models as M
from loomgrid.operators import routes as R
from loomgrid.plans import fixtures as X
from loomgrid.plans.fixtures import with_tables
from loomgrid.plans.place_queries import _daily, _typed_steps
from loomgrid.plans.registry import Register

query = Register()
QUERIES, ORACLES = query.queries, query.oracles

ROUTES = "routes nodes steps edges"


@query(with_tables("routes", "select route_id, pos, a, b from steps", X.SQL["steps"]))
def route_segments(spark, d):
    return R.segments(X.routes(spark, d)).select("route_id", "pos", "a", "b")


@query(with_tables(ROUTES + " adj", """select d.node, d.degree, round(case when degree<2 then 0 else 2.0e0*coalesce(t,0)/(degree*(degree-1)) end,9) as clustering from (select node, count(*) as degree from adj group by node) d
 left join (select a.node, count(*) as t from adj a join adj b on a.node=b.node and a.other<b.other join edges e on e.src=a.other and e.dst=b.other group by 1) using (node)"""))
def degree_clustering(spark, d):
    return G.clustering(X.edges(spark, d)).withColumn("clustering", F.round("clustering", 9))


_MEAN = """h{k} as (select n.node_id, greatest(n.a+coalesce(avg(m.a),n.a),0) as a, greatest(n.b+coalesce(avg(m.b),n.b),0) as b from h{j} n left join adj on adj.node=n.node_id left join h{j} m on m.node_id=adj.other group by n.node_id, n.a, n.b)"""


@query(with_tables(ROUTES + " adj", """select node_id, round((norm-(min(norm) over ()))/((max(norm) over ())-(min(norm) over ())+1e-12)+(score-(min(score) over ()))/((max(score) over ())-(min(score) over ())+1e-12),6) as score from (select node_id, sqrt(h2.a*h2.a+h2.b*h2.b) as norm, nodes.score from h2 join nodes using (node_id))""",
 "h0 as (select node_id, (x-avg(x) over ())/stddev_pop(x) over () as a, (y-avg(y) over ())/stddev_pop(y) over () as b from nodes)," + _MEAN.format(k=1, j=0) + "," + _MEAN.format(k=2, j=1)))
def mean_aggregate_2hop(spark, d):
    n = X.nodes(spark, d)
    out = G.graph_score(n.select("node_id", "x", "y"), X.edges(spark, d), ["x", "y"], n.select("node_id", F.col("score").alias("density")))
    return out.select("node_id", F.round("score", 6).alias("score"))


@query(with_tables(ROUTES, "select distinct least(a.node_id%7,b.node_id%7) as src, greatest(a.node_id%7,b.node_id%7) as dst from edges join nodes a on a.node_id=src join nodes b on b.node_id=dst where a.node_id%7<>b.node_id%7"))
def contract_communities(spark, d):
    n = X.nodes(spark, d)
    return G.contract(n, X.edges(spark, d), n.select("node_id", (F.col("node_id") % 7).alias("community")))[1]


@query(with_tables("nodes", "select node_id%7 as node_id, round(avg(x),6) as x, round(avg(y),6) as y from nodes group by 1"))
def community_centres(spark, d):
    n = X.nodes(spark, d)
    out = G.contract(n, X.edges(spark, d), n.select("node_id", (F.col("node_id") % 7).alias("community")))[0]
    return out.select("node_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(with_tables(ROUTES, "select node_id from nodes where node_id not in (select src from edges union select dst from edges)"))
def isolated_nodes(spark, d):
    n = X.nodes(spark, d)
    return n.join(G.connected_nodes(n, X.edges(spark, d)), "node_id", "left_anti").select("node_id")


@query(with_tables("places", "select p.place_id as src, q.place_id as dst from places p join places q on p.place_id<q.place_id where not exists (select 1 from places r where r.place_id<>p.place_id and r.place_id<>q.place_id and (p.x-r.x)*(p.x-r.x)+(p.y-r.y)*(p.y-r.y)+(q.x-r.x)*(q.x-r.x)+(q.y-r.y)*(q.y-r.y) < (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y))"))
def gabriel_edges(spark, d):
    return G.gabriel_edges(X.places(spark, d), "place_id", 20000.0).select("src", "dst")


@query(with_tables("places", """select p.place_id as src, q.place_id as dst from places p join places q on p.place_id<q.place_id where exists (
 select 1 from places r where r.place_id not in (p.place_id,q.place_id) and (q.x-p.x)*(r.y-p.y)-(q.y-p.y)*(r.x-p.x)<>0 and not exists (select 1 from places s where s.place_id not in (p.place_id,q.place_id,r.place_id) and
 sign((q.x-p.x)*(r.y-p.y)-(q.y-p.y)*(r.x-p.x))*(((p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y))*((q.x-s.x)*(r.y-s.y)-(r.x-s.x)*(q.y-s.y))-((q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y))*((p.x-s.x)*(r.y-s.y)-(r.x-s.x)*(p.y-s.y))+((r.x-s.x)*(r.x-s.x)+(r.y-s.y)*(r.y-s.y))*((p.x-s.x)*(q.y-s.y)-(q.x-s.x)*(p.y-s.y)))>0))"""))
def delaunay_edges(spark, d):
    return G.delaunay_edges(X.places(spark, d), "place_id")


@query(with_tables("routes nodes steps edges","""select route_id, cast(dense_rank() over (order by root)-1 as integer) as "group" from (select r.route_id, coalesce(l.root, r.route_id) as root from (select distinct route_id from routes) r left join label l on l.node=r.route_id)""",
more="""own as (select distinct route_id, src, dst, coalesce(weight, 1.0e0) as weight from steps left join edges using (src, dst)),
 len as (select route_id, sum(weight) as total from own group by route_id),
 shared as (select u.route_id as u, v.route_id as v, sum(u.weight) as part from own u join own v on u.src=v.src and u.dst=v.dst and u.route_id<v.route_id group by 1,2),
 links as (select u, v from shared join len a on a.route_id=u join len b on b.route_id=v where (a.total<>0 and part/a.total>=0.5) or (b.total<>0 and part/b.total>=0.5)),
 both_ways as (select u, v from links union select v, u from links),
 label(node, root) using key (node) as (select distinct u, u from both_ways union select w.v, min(f.root) from label f join both_ways w on w.u=f.node join recurring.label o on o.node=w.v where f.root<o.root group by w.v)""",recursive=True))
def line_groups(spark, d):
    return R.similarity_groups(X.routes(spark, d), X.edges(spark, d), 0.5)


_GROUPS = "grp as (select distinct route_id, route_id%6 as g from routes)"


def _groups(spark, d):
    return X.routes(spark, d).select("route_id", (F.col("route_id") % 6).alias("group")).distinct()


@query(with_tables("routes", "select node_id, max(pos=0 or pos=last) as terminal, count(distinct g)>1 as transfer from (select *, max(pos) over (partition by route_id) as last from routes) join grp using (route_id) group by node_id having max(pos=0 or pos=last) or count(distinct g)>1", _GROUPS))
def terminals_transfers(spark, d):
    return R.fixed_stations(X.routes(spark, d), _groups(spark, d))


@query(with_tables("routes nodes steps edges","""select node_id, arg_max(flag, route_id * 1000 + step * 500 + turn) as is_station from (
  select route_id, 0 as step, pos as turn, node_id, flag from ahead_walk union all select route_id, 1, last - pos, node_id, flag from back_walk) group by node_id""",
more=_GROUPS+""",
 ends as (select *, max(pos) over (partition by route_id) as last from routes),
 fixed as (select node_id from ends join grp using (route_id) group by node_id having max(pos=0 or pos=last) or count(distinct g)>1),
 stops as (select e.route_id, e.pos, e.node_id, e.last, coalesce(w.weight, 0) as ahead, e.node_id in (select node_id from fixed) as fixed
   from ends e left join steps t on t.route_id=e.route_id and t.pos=e.pos left join edges w on w.src=t.src and w.dst=t.dst),
 ahead_walk(route_id, pos, node_id, flag, since, last) as (select route_id, pos, node_id, true, cast(0 as double), last from stops where pos=0 union all
  select s.route_id, s.pos, s.node_id, s.fixed or w.since+p.ahead>=20000, case when s.fixed or w.since+p.ahead>=20000 then 0 else w.since+p.ahead end, s.last
  from ahead_walk w join stops p on p.route_id=w.route_id and p.pos=w.pos join stops s on s.route_id=w.route_id and s.pos=w.pos+1),
 back_walk(route_id, pos, node_id, flag, since, last) as (select route_id, pos, node_id, true, cast(0 as double), last from stops where pos=last union all
  select s.route_id, s.pos, s.node_id, s.fixed or w.since+s.ahead>=20000, case when s.fixed or w.since+s.ahead>=20000 then 0 else w.since+s.ahead end, s.last
  from back_walk w join stops s on s.route_id=w.route_id and s.pos=w.pos-1)""",recursive=True))
def station_marks(spark, d):
    return R.mark_stations(X.routes(spark, d), _groups(spark, d), X.edges(spark, d), 20000.0)


_TURN = "case when degrees(atan2({c},{e}))>0 then 180-degrees(atan2({c},{e})) else -180-degrees(atan2({c},{e})) end"


@query(with_tables("routes nodes", f"""select route_id, pos, round(case when n1*n2=0 then 0 else degrees(acos(greatest(-1.0e0,least(1.0e0,dt/(n1*n2))))) end,6) as angle, round({_TURN.format(c='cr', e='dt')},6) as deviation
 from (select *, (x0-x)*(x2-x)+(y0-y)*(y2-y) as dt, (x0-x)*(y2-y)-(y0-y)*(x2-x) as cr, sqrt((x0-x)*(x0-x)+(y0-y)*(y0-y)) as n1, sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) as n2 from
 (select route_id, pos, x, y, lag(x) over w as x0, lag(y) over w as y0, lead(x) over w as x2, lead(y) over w as y2 from routes join nodes using (node_id) window w as (partition by route_id order by pos)) where x0 is not null and x2 is not null)"""))
def turn_angles(spark, d):
    out = R.turns(X.routes(spark, d), X.nodes(spark, d))
    return out.select("route_id", "pos", F.round("angle", 6).alias("angle"), F.round("deviation", 6).alias("deviation"))


@query(with_tables(ROUTES, """select r.route_id, n as n_nodes, round(coalesce(l,0),6) as length, n>=2 and n=u and coalesce(l,0) between 50000 and 200000 as valid from (select route_id, count(*) as n, count(distinct node_id) as u from routes group by 1) r
 left join (select route_id, sum(weight) as l from steps join edges using (src,dst) group by 1) s using (route_id)"""))
def route_validity(spark, d):
    out = R.validity(X.routes(spark, d), X.edges(spark, d), X.nodes(spark, d), 50000.0, 200000.0)
    return out.withColumn("length", F.round("length", 6))


_ANGLE = "degrees(acos(greatest(-1.0e0,least(1.0e0,((x0-x)*(x2-x)+(y0-y)*(y2-y))/(sqrt((x0-x)*(x0-x)+(y0-y)*(y0-y))*sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)))))))"


@query(with_tables(ROUTES, f"""select r.route_id, cast(coalesce(l,0) not between 50000 and 200000 as int) as bad_length, coalesce(t.n,0) as sharp_turns, cast(0 as bigint) as revisits, coalesce(z.n,0) as no_go, coalesce(w.n,0) as worn_edges
 from (select distinct route_id from routes) r left join (select route_id, sum(weight) as l from steps join edges using (src,dst) group by 1) s using (route_id)
 left join (select route_id, count(*) as n from (select route_id, x, y, lag(x) over w as x0, lag(y) over w as y0, lead(x) over w as x2, lead(y) over w as y2 from routes join nodes using (node_id) window w as (partition by route_id order by pos)) where x0 is not null and x2 is not null and {_ANGLE}<=130 group by 1) t using (route_id)
 left join (select route_id, count(*) as n from routes join nodes using (node_id) where (x-50000)*(x-50000)+(y-50000)*(y-50000)<15000.0e0*15000 group by 1) z using (route_id)
 left join (select route_id, count(distinct (src,dst)) as n from steps join (select src, dst from steps group by 1,2 having count(*)>1) using (src,dst) group by 1) w using (route_id)"""))
def route_constraints(spark, d):
    zones = spark.createDataFrame([(50000.0, 50000.0, 15000.0)], "zx double, zy double, r double")
    return R.constraints(X.routes(spark, d), X.edges(spark, d), X.nodes(spark, d), zones, 50000.0, 200000.0, most_uses=1)


_IND = "istep as (select route_id%8 as ind_id, src, dst from steps)"
_DUP = "dup as (select ind_id, sum(c-1) as dups from (select ind_id, src, dst, count(*) as c from istep group by 1,2,3) group by 1)"


@query(with_tables("routes steps", "select ind_id, cast(dups as bigint) as duplicates from dup", f"{_IND},{_DUP}"))
def edge_reuse(spark, d):
    return R.edge_reuse(X.individuals(spark, d), "ind_id")


@query(with_tables("routes individuals", "select ind_id, round(stddev_pop(c),9) as visit_std from (select ind_id, node_id, count(*) as c from individuals group by 1,2) group by 1"))
def visit_std(spark, d):
    return M.visit_spread(X.individuals(spark, d), "ind_id").withColumn("visit_std", F.round("visit_std", 9))


_SETS = """sets as (select distinct ind_id, node_id from individuals), pairs as (select a.ind_id as u, b.ind_id as v from (select distinct ind_id from sets) a join (select distinct ind_id from sets) b on a.ind_id<b.ind_id),
 jac as (select u, v, (select count(*) from sets a join sets b using (node_id) where a.ind_id=u and b.ind_id=v)*1.0e0/(select count(distinct node_id) from sets where ind_id in (u,v)) as j from pairs)"""


@query(with_tables("routes individuals", "select round(1-avg(j),9) as diversity from jac", _SETS))
def jaccard_diversity(spark, d):
    return M.diversity(X.individuals(spark, d)).withColumn("diversity", F.round("diversity", 9))


def _scores(spark, d):
    return X.nodes(spark, d).select("node_id", "score", (F.col("node_id") % 10 * 1.0).alias("demand"))


@query(with_tables("routes nodes", "select route_id, round(sum(score),6) as score, sum(node_id%10)*1.0e0 as demand from routes join nodes using (node_id) group by 1"))
def walk_scores(spark, d):
    return M.walk_scores(X.routes(spark, d), _scores(spark, d)).withColumn("score", F.round("score", 6))


_SUMS = "sums as (select ind_id, sum(score) as s, sum(node_id%10)*1.0e0 as m, count(distinct node_id) as v from individuals join nodes using (node_id) group by 1)"


@query(with_tables("routes nodes steps individuals", "select ind_id, round(s+0.4e0*m+5*v-30*coalesce(dups,0),2) as fitness from sums left join dup using (ind_id)", f"{_IND},{_DUP},{_SUMS}"))
def aco_fitness(spark, d):
    return M.ant_fitness(X.individuals(spark, d), _scores(spark, d)).withColumn("fitness", F.round("fitness", 2))


_BOX = (20000.0, 20000.0, 80000.0, 80000.0)
_BONUS = """bon as (select ind_id, sum(case when n>=3 and not f and not l and u then 1 else 0 end) as b from (select ind_id, route_id, count(*) as n, min_by(urban,pos) as f, max_by(urban,pos) as l, bool_or(urban) as u from (select *, x between 20000 and 80000 and y between 20000 and 80000 as urban from individuals join nodes using (node_id)) group by 1,2) group by 1)"""


@query(with_tables("routes nodes steps individuals", """select ind_id, round(s+0.5e0*m+10*v+1000*b-50*coalesce(dups,0)-20*sd-coalesce(pen,0),2) as fitness from sums left join dup using (ind_id) left join bon using (ind_id) left join (select ind_id, stddev_pop(c) as sd from (select ind_id, node_id, count(*) as c from individuals group by 1,2) group by 1) using (ind_id)
 left join (select ind_id, 100*sum(j) as pen from (select u as ind_id, j from jac where j>0.75 union all select v, j from jac where j>0.75) group by 1) using (ind_id)""", f"{_IND},{_DUP},{_SUMS},{_BONUS},{_SETS}"))
def ga_fitness(spark, d):
    out = M.genetic_fitness(X.individuals(spark, d), _scores(spark, d), X.nodes(spark, d), _BOX)
    return out.withColumn("fitness", F.round("fitness", 2))


@query(with_tables(ROUTES, """select u, v, round(w/sum(w) over (partition by u),9) as p from (select u, v, case when src%3=0 then 2.0e0 else 1.0e0 end*pow((abs(score)+1e-6)/(weight+1e-6),2) as w from (select src as u, dst as v, src, weight from edges union all select dst, src, src, weight from edges) join nodes on node_id=v)"""))
def transition_probs(spark, d):
    e = X.edges(spark, d)
    tau = e.select("src", "dst", F.when(F.col("src") % 3 == 0, 2.0).otherwise(1.0).alias("tau"))
    s = X.nodes(spark, d).select("node_id", F.abs("score").alias("score"))
    return M.transition_odds(e, s, tau).withColumn("p", F.round("p", 9))


@query(with_tables(ROUTES, """select src, dst, round(case when c is null then greatest(0.05e0,tau*0.9e0) else least(8.0e0,greatest(0.05e0,tau*0.9e0)+c/(1+9.0e0)) end,9) as tau from (select src, dst, case when src%2=0 then 0.01e0 else 7.0e0 end as tau from edges) left join (select src, dst, count(*) as c from steps group by 1,2) using (src,dst)"""))
def pheromone_update(spark, d):
    tau = X.edges(spark, d).select("src", "dst", F.when(F.col("src") % 2 == 0, 0.01).otherwise(7.0).alias("tau"))
    return M.pheromone_step(tau, X.routes(spark, d), 9.0).withColumn("tau", F.round("tau", 9))


@query(with_tables("routes nodes steps", """select head_id, node_id, round(angle,6) as angle from (select h.route_id as head_id, c.other as node_id, case when n1*n2=0 then 0 else degrees(acos(greatest(-1.0e0,least(1.0e0,dt/(n1*n2))))) end as angle from heads h join adj c on c.node=h.node, lateral (select
 (p.x-n.x)*(o.x-n.x)+(p.y-n.y)*(o.y-n.y) as dt, sqrt((p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y)) as n1, sqrt((o.x-n.x)*(o.x-n.x)+(o.y-n.y)*(o.y-n.y)) as n2 from nodes n, nodes o, nodes p where n.node_id=h.node and o.node_id=c.other and p.node_id=h.prev and not (o.x-50000)*(o.x-50000)+(o.y-50000)*(o.y-50000)<15000.0e0*15000) where c.other<>h.prev) where angle>60""",
 "heads as (select route_id, a as prev, b as node from steps where pos=0), adj as (select distinct src as node, dst as other from steps union select dst, src from steps)"))
def feasible_next(spark, d):
    zones = spark.createDataFrame([(50000.0, 50000.0, 15000.0)], "zx double, zy double, r double")
    heads = R.segments(X.routes(spark, d)).filter("pos = 0").select(F.col("route_id").alias("head_id"), F.col("a").alias("prev"), F.col("b").alias("node"), F.array("a", "b").alias("visited"), F.lit(0).alias("sign"))
    out = M.continuations(heads, X.edges(spark, d), X.nodes(spark, d), zones, 60.0)
    return out.select("head_id", "node_id", F.round("angle", 6).alias("angle"))


_RANK = "case row_type when 'subway_tunnel' then 0 when 'subway_surface' then 1 when 'rail_existing' then 2 when 'elevated' then 3 when 'street' then 4 else 5 end"
_TYPED = f"""typed as (select route_id, pos, any_value(length_m) as length_m, coalesce(min_by(row_type, case when row_type is not null then {_RANK} end),'street') as row_type
 from (select route_id, pos, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) as length_m, (p.x+q.x)/2 as mx, (p.y+q.y)/2 as my from steps join nodes p on p.node_id=a join nodes q on q.node_id=b) m left join network n on ((n.x1+n.x2)/2-mx)*((n.x1+n.x2)/2-mx)+((n.y1+n.y2)/2-my)*((n.y1+n.y2)/2-my)<=4000000 group by route_id, pos),
 dom as (select route_id, row_type from (select route_id, row_type, row_number() over (partition by route_id order by count(*) desc, {_RANK}) as rn from typed group by route_id, row_type) where rn=1),
 cost as (select r.route_id, coalesce(m.row_type,'unknown') as kind, n, coalesce(km,0) as km, coalesce(track,0)*1.4e0 as track, n*case coalesce(m.row_type,'unknown') when 'subway_tunnel' then 200.0e0 when 'subway_surface' then 30 when 'rail_existing' then 15 when 'elevated' then 60 when 'street' then 20 else 35 end*1.4e0 as stops
 from (select route_id, count(*) as n from routes group by 1) r left join (select route_id, sum(length_m)/1000 as km, sum(length_m/1000*case row_type when 'subway_tunnel' then 750.0e0 when 'subway_surface' then 80 when 'rail_existing' then 25 when 'elevated' then 200 when 'street' then 100 else 120 end) as track from typed group by 1) t using (route_id) left join dom m using (route_id))"""
_COST = "routes nodes steps poi network"


def _costs(spark, d):
    # Positions count from 0; by them the stops read the rows that the steps have dealt out, and not a copy of their own.
    stops = X.routes(spark, d).groupBy("route_id").agg((F.max("pos") + 1).cast("long").alias("n_stations"))
    return M.line_costs(_typed_steps(spark, d), stops)


@query(with_tables(_COST, "select route_id, kind as dominant_row_type, n as n_stations, round(km,6) as length_km, round(track,4) as track_cost, round(stops,4) as station_cost, round(track+stops,4) as total_cost from cost", _TYPED))
def line_cost(spark, d):
    return _costs(spark, d).select("route_id", "dominant_row_type", "n_stations", F.round("length_km", 6).alias("length_km"), *[F.round(c, 4).alias(c) for c in ("track_cost", "station_cost", "total_cost")])


@query(with_tables(_COST, "select round(sum(track+stops),4) as gross, round((select sum(case when c>1 then 1 else 0 end)*1.0e0/sum(c) from (select count(*) as c from steps group by src,dst)),9) as shared, round(sum(track+stops)*(1-0.5e0*(select sum(case when c>1 then 1 else 0 end)*1.0e0/sum(c) from (select count(*) as c from steps group by src,dst))),4) as net from cost", _TYPED))
def network_cost(spark, d):
    return M.network_cost(_costs(spark, d), X.routes(spark, d)).select(F.round("gross", 4).alias("gross"), F.round("shared", 9).alias("shared"), F.round("net", 4).alias("net"))


@query(with_tables(_COST, "select route_id as line_id, 'generated' as route_kind, 'planned' as service_status, 100.0e0 as accessibility_score, true as is_accessible, kind as row_type, round_even(track+stops,1) as construction_cost_musd from cost", _TYPED))
def line_metadata(spark, d):
    return M.line_metadata(_costs(spark, d)).drop("occupancy_pct", "delay_min", "ridership_estimate")


@query(with_tables(_COST, "select route_id, row_type from dom", _TYPED))
def dominant_row(spark, d):
    from loomgrid.functions.scalars import priority
    from loomgrid.operators.stats import dominant

    return dominant(_typed_steps(spark, d), "route_id", "row_type", priority(F.col("row_type")))


_DAILY = """daily as (select station_id, case when t>0 then pull*350000.0e0/t else 350000.0e0/n end as daily from (select *, sum(pull) over () as t, count(*) over () as n from (select s.station_id, coalesce(sum(demand_score*exp(-0.0008e0*sqrt((s.x-p.x)*(s.x-p.x)+(s.y-p.y)*(s.y-p.y)))),0) as pull from stations s left join poi p on (s.x-p.x)*(s.x-p.x)+(s.y-p.y)*(s.y-p.y)<=4000000 group by 1)))"""


@query(with_tables("stations poi routes", "select route_id, round(sum(daily/n),6) as ridership from routes join daily on station_id=node_id join (select node_id, count(*) as n from routes group by 1) using (node_id) group by 1", _DAILY))
def line_boardings(spark, d):
    return M.line_boardings(_daily(spark, d), X.routes(spark, d)).withColumn("ridership", F.round("ridership", 6))


@query(with_tables("stations poi", """select station_id, cast(h.hour as int) as hour, round(daily*share,6) as boardings from daily cross join (select range as hour, case when range<7 then 0.04e0/2 when range<9 then 0.26e0/2 when range<16 then 0.30e0/7 when range<19 then 0.27e0/3 when range<23 then 0.11e0/4 else 0.02e0/2 end as share from range(5,24)) h""", _DAILY))
def hourly_profile(spark, d):
    return M.hourly_profile(_daily(spark, d)).withColumn("boardings", F.round("boardings", 6))


_REACH = """mem as (select distinct node_id as s, g from routes join grp using (route_id)), gadj as (select distinct a.g as a, b.g as b from mem a join mem b using (s) where a.g<>b.g),
 hop(a,b,h) as (select distinct g, g, 0 from mem union select hop.a, gadj.b, h+1 from hop join gadj on gadj.a=hop.b where h<6),
 dist as (select a, b, min(h) as h from hop group by 1,2), best as (select p.s as p, q.s as q, min(h) as t from mem p join mem q on p.s<q.s left join dist on dist.a=p.g and dist.b=q.g group by 1,2)"""


@query(with_tables("routes", "select round(avg(t),9) as mean_transfers, round(100.0e0*count(*) filter (t=0)/count(*),9) as pct_0, round(100.0e0*count(*) filter (t=1)/count(*),9) as pct_1, round(100.0e0*count(*) filter (t>=2)/count(*),9) as pct_2plus, round(100.0e0*count(*) filter (t is null)/count(*),9) as pct_unreachable from best", f"{_GROUPS},{_REACH}", recursive=True))
def transfer_burden(spark, d):
    out = R.transfer_burden(X.routes(spark, d), _groups(spark, d))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(with_tables("routes nodes steps", "select distinct a as src, b as dst, round(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)),6) as dist, route_id as line_id from (select a, b, route_id from steps union select b, a, route_id from steps) join nodes p on p.node_id=a join nodes q on q.node_id=b"))
def line_graph(spark, d):
    return R.line_graph(X.routes(spark, d), X.nodes(spark, d)).withColumn("dist", F.round("dist", 6))


@query("""select l_orderkey as k, l_linenumber as line, cast(ceil(l_extendedprice/1000/80*60+greatest(l_quantity-2,0)*0.4e0+6*l_linenumber+l_tax*1000/100) as bigint) as minutes from (select distinct l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_tax from lineitem)""")
def travel_time(spark, d):
    rows = X.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax").distinct()
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), R.travel_minutes(F.col("l_extendedprice") / 1000, F.col("l_quantity"), F.col("l_linenumber"), F.col("l_tax") * 1000).alias("minutes"))


@query(with_tables("routes nodes steps","""select (select min(s) from ways) as origin, node, cast(best.t as integer) as transfers, round(best.d,6) as dist from (select node, min({'t': t, 'd': d}) as best from state group by node)""",
more="""ways as (select distinct s, d, line_id, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) as dist from (select a as s, b as d, route_id as line_id from steps union select b, a, route_id from steps) join nodes p on p.node_id=s join nodes q on q.node_id=d),
 state(node, line_id, t, d) using key (node, line_id) as (
  select distinct s, line_id, cast(0 as bigint), cast(0 as double) from ways where s=(select min(s) from ways)
  union
  select n.node, n.line_id, n.best.t, n.best.d from (select w.d as node, w.line_id, min({'t': cast(f.t+case when f.line_id<>w.line_id then 1 else 0 end as bigint), 'd': f.d+w.dist}) as best from state f join ways w on w.s=f.node group by w.d, w.line_id) n
   left join recurring.state o on o.node=n.node and o.line_id=n.line_id where o.node is null or n.best.t<o.t or (n.best.t=o.t and n.best.d<o.d))""",recursive=True))
def shortest_transfers(spark, d):
    """Best paths from the smallest node over all lines."""
    graph = R.line_graph(X.routes(spark, d), X.nodes(spark, d))
    origin = graph.agg(F.min("src").alias("node_id"))
    return R.best_paths(graph, origin).withColumn("dist", F.round("dist", 6))


@query(with_tables("routes steps","""select seg.path_id, cast(h.pos as integer) as pos, seg.line_id from seg join (select distinct route_id as path_id, pos from steps) h on h.path_id=seg.path_id and h.pos between seg.p and seg.e""",
more="""ways as (select distinct a as s, b as d, route_id as line_id from steps union select distinct b, a, route_id from steps),
 here as (select distinct t.route_id as path_id, t.pos, w.line_id from steps t join ways w on t.a=w.s and t.b=w.d),
 runs as (select path_id, line_id, min(pos) as s, max(pos) as e from (select *, pos-row_number() over (partition by path_id, line_id order by pos) as island from here) group by path_id, line_id, island),
 best as (select h.path_id, h.pos, r.line_id, r.e from here h join runs r on r.path_id=h.path_id and r.line_id=h.line_id and h.pos between r.s and r.e qualify row_number() over (partition by h.path_id, h.pos order by r.e desc, r.line_id)=1),
 seg(path_id, p, e, line_id) as (select path_id, pos, e, line_id from best where pos=0 union all select b.path_id, b.pos, b.e, b.line_id from seg join best b on b.path_id=seg.path_id and b.pos=seg.e+1)""",recursive=True))
def line_sequence(spark, d):
    graph = R.line_graph(X.routes(spark, d), X.nodes(spark, d))
    paths = X.routes(spark, d).withColumnRenamed("route_id", "path_id")
    return R.line_sequence(paths, graph)


@query()
def louvain_communities(spark, d):
    return G.louvain(X.edges(spark, d), 0.5)


@query(with_tables("routes nodes steps edges adj","""select n.node, round(coalesce(sum(a.paths*b.paths/w.paths),0)/greatest(1,((select count(*) from found)-1)*((select count(*) from found)-2)),9) as betweenness
 from found n left join (reach a join reach b on b.s=a.v and b.v<>a.s join reach w on w.s=a.s and w.v=b.v and w.d=a.d+b.d) on a.v=n.node and a.s<>n.node and b.v<>n.node group by n.node""",
more="""found as (select distinct node from adj),
 reach(s, v, d, paths) using key (s, v) as (select node, node, 0, cast(1 as double) from found union
  select f.s, a.other, f.d+1, sum(f.paths) from reach f join adj a on a.node=f.v left join recurring.reach o on o.s=f.s and o.v=a.other where o.v is null group by 1, 2, 3)""",recursive=True))
def betweenness_pivots(spark, d):
    """Up to 200 nodes, all are pivots, and the SQL is exact; beyond that it is not comparable."""
    return G.betweenness(X.edges(spark, d)).withColumn("betweenness", F.round("betweenness", 9))


@query()
def degree_reduction(spark, d):
    return G.reduce_degree(X.edges(spark, d))


_ARC = """sqrt((cu2*sin(lam))**2+(cu1*su2-su1*cu2*cos(lam))**2) as sin_s, su1*su2+cu1*cu2*cos(lam) as cos_s, atan2(sin_s, cos_s) as sigma, coalesce(cu1*cu2*sin(lam)/nullif(sin_s, 0), 0) as sin_a,
 1-sin_a**2 as cos2a, coalesce(cos_s-2*su1*su2/nullif(cos2a, 0), 0) as cos_m"""
_SPHEROID = "1/298.257223563e0 as f, 6378137.0e0 as a, a*(1-f) as b"


@query(with_tables("routes nodes steps edges", f"""select src, dst, round(b*big_a*(sigma-big_b*sin_s*(cos_m+big_b/4*(cos_s*(2*cos_m**2-1)-big_b/6*cos_m*(4*sin_s**2-3)*(4*cos_m**2-3)))),3) as metres
 from (select *, {_ARC}, {_SPHEROID}, cos2a*(a**2-b**2)/b**2 as usq, 1+usq/16384*(4096+usq*(-768+usq*(320-175*usq))) as big_a, usq/1024*(256+usq*(-128+usq*(74-47*usq))) as big_b from turn where k=20)""",
 f"""spots as (select node_id, radians(x/100000-77.5e0) as lon, radians(y/100000+38.5e0) as lat, atan((1-1/298.257223563e0)*tan(lat)) as u from nodes),
 turn(src, dst, su1, cu1, su2, cu2, l, lam, k) as (select src, dst, sin(p.u), cos(p.u), sin(q.u), cos(q.u), q.lon-p.lon, q.lon-p.lon, 0 from edges join spots p on p.node_id=src join spots q on q.node_id=dst
  union all select src, dst, su1, cu1, su2, cu2, l, next, k+1 from (select *, {_ARC}, {_SPHEROID}, f/16*cos2a*(4+f*(4-3*cos2a)) as c, l+(1-c)*f*sin_a*(sigma+c*sin_s*(cos_m+c*cos_s*(-1+2*cos_m**2))) as next from turn where k<20))""", recursive=True))
def geodesic_lengths(spark, d):
    from loomgrid.functions.geo import geodesic_m, mercator_x, mercator_y

    at = X.nodes(spark, d).select("node_id", mercator_x(F.col("x") / 100000 - 77.5).alias("x"), mercator_y(F.col("y") / 100000 + 38.5).alias("y"))
    ends = X.edges(spark, d).join(at.select(F.col("node_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay")), "src").join(at.select(F.col("node_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by")), "dst")
    return ends.select("src", "dst", F.round(geodesic_m("ax", "ay", "bx", "by"), 3).alias("metres"))


def _search_graph(spark, d):
    """A proximity graph of the stations, on which routes can be searched."""
    n = X.nodes(spark, d).withColumn("score", F.abs("score"))
    e = G.gabriel_edges(n, "node_id", 20000.0).withColumnRenamed("length", "weight")
    return n, e


LIMITS = I.Limits(routes=4, low=15_000.0, high=60_000.0, min_angle=100.0)


@query()
def random_walks(spark, d):
    n, e = _search_graph(spark, d)
    return I.random_walks(n, e, replicates=2, limits=LIMITS, seed=7)


@query()
def iterative_walks(spark, d):
    n, e = _search_graph(spark, d)
    return I.iterative_walks(n, e, rounds=3, limits=LIMITS, seed=7)


@query()
def ant_colony(spark, d):
    n, e = _search_graph(spark, d)
    return I.ant_colony(n, e, ants=3, generations=2, limits=LIMITS, seed=7)


@query()
def genetic(spark, d):
    n, e = _search_graph(spark, d)
    return I.genetic(n, e, size=6, generations=2, limits=LIMITS, box=_BOX, seed=7)


@query(with_tables("routes", "select 1 as route_id, pos, node_id from routes where (route_id=1 and pos<2) or (route_id=2 and pos>=2)"))
def crossover_one_point(spark, d):
    return I.splice(X.routes(spark, d), 1, 2, 2)
