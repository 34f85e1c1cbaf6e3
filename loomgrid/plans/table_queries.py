"""Queries of the scalar, keyed, aggregate and window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions import geo
from loomgrid.functions import scalars as S
from loomgrid.operators import models as M
from loomgrid.operators import relational as R
from loomgrid.operators import stats
from loomgrid.operators.spatial import nearest_join
from loomgrid.plans import fixtures as X
from loomgrid.plans.fixtures import with_tables
from loomgrid.plans.registry import Register

query = Register()
QUERIES, ORACLES = query.queries, query.oracles


@query(with_tables("blocks", """select block_id, round(case when aland+awater=0 then 0 else pop/(aland+awater)*1000 end,6) as density,
 round(ln(1+case when aland+awater=0 then 0 else pop/(aland+awater)*1000 end),6) as potential from blocks"""))
def block_potential(spark, d):
    b = X.blocks(spark, d).withColumn("density", S.density(F.col("pop"), F.col("aland"), F.col("awater")))
    return b.select("block_id", F.round("density", 6).alias("density"), F.round(F.log1p("density"), 6).alias("potential"))


@query("""select c_custkey as k, case when try_cast(t as double) is null or isnan(try_cast(t as double)) or isinf(try_cast(t as double)) then 0.0 else try_cast(t as double) end as number
 from (select c_custkey, case c_custkey%6 when 0 then '' when 1 then 'NaN' when 2 then 'x1' when 3 then cast(c_acctbal as varchar) when 4 then 'Infinity' end as t from customer)""")
def safe_numbers(spark, d):
    k = F.col("c_custkey")
    text = F.when(k % 6 == 0, "").when(k % 6 == 1, "NaN").when(k % 6 == 2, "x1").when(k % 6 == 3, F.col("c_acctbal").cast("string")).when(k % 6 == 4, "Infinity")
    return X.load(spark, d, "customer").select(k.alias("k"), S.safe_number(text).alias("number"))


@query("""select k, case when trim(g)='' then null when regexp_matches(regexp_replace(trim(g),'\\.0$',''),'^[0-9]+$') then
  case when length(regexp_replace(trim(g),'\\.0$',''))<6 then lpad(regexp_replace(trim(g),'\\.0$',''),6,'0') else regexp_replace(trim(g),'\\.0$','') end else nullif(regexp_replace(trim(g),'\\.0$',''),'') end as geoid,
 case when try_cast(t as double) is not null then '24'||'031'||case when length(cast(cast(round_even(try_cast(t as double)*100,0) as bigint) as varchar))<6 then lpad(cast(cast(round_even(try_cast(t as double)*100,0) as bigint) as varchar),6,'0') else cast(cast(round_even(try_cast(t as double)*100,0) as bigint) as varchar) end end as tract,
 case when length(f)>=11 then substr(f,1,11) end as prefix
 from (select cast(c_custkey as bigint) as k, case c_custkey%4 when 0 then ' '||c_custkey||' ' when 1 then c_custkey||'.0' when 2 then 'abc'||c_custkey end as g,
  case when c_custkey%3=0 then 'x' else cast(c_custkey%9000 as varchar)||'.5' end as t, repeat('7', cast(c_custkey%16 as int)) as f from customer)""")
def geoid_normalise(spark, d):
    k = F.col("c_custkey").cast("long")
    t = k.cast("string")
    g = F.when(k % 4 == 0, F.concat(F.lit(" "), t, F.lit(" "))).when(k % 4 == 1, F.concat(t, F.lit(".0"))).when(k % 4 == 2, F.concat(F.lit("abc"), t))
    tract = F.when(k % 3 == 0, "x").otherwise(F.concat((k % 9000).cast("string"), F.lit(".5")))
    return X.load(spark, d, "customer").select(
        k.alias("k"), S.normal_geoid(g, 6).alias("geoid"), S.tract_geoid(F.lit("24"), F.lit("031"), tract).alias("tract"), S.prefix(F.repeat(F.lit("7"), (k % 16).cast("int"))).alias("prefix")
    )


@query("""select n_name as name, case lower(trim(c)) when 'dc' then '11' when 'md' then '24' when 'va' then '51' else case when regexp_matches(lower(trim(c)),'^[0-9]{2}$') then lower(trim(c)) end end as code
 from (select n_name, case n_nationkey%5 when 0 then 'DC' when 1 then ' md ' when 2 then 'Va' when 3 then cast(n_nationkey as varchar) else 'zz' end as c from nation)""")
def state_codes(spark, d):
    k = F.col("n_nationkey")
    c = F.when(k % 5 == 0, "DC").when(k % 5 == 1, " md ").when(k % 5 == 2, "Va").when(k % 5 == 3, k.cast("string")).otherwise("zz")
    return X.load(spark, d, "nation").select(F.col("n_name").alias("name"), S.state_code(c).alias("code"))


@query("""select n_name as name, right(cast(24000+n_nationkey as varchar),3) as code from nation where n_regionkey in (1,3) and n_name in (select n_name from nation where n_nationkey%2=0)""")
def county_codes(spark, d):
    n = X.load(spark, d, "nation")
    wanted = n.filter("n_nationkey % 2 = 0").select("n_name")
    code = F.substring((F.col("n_nationkey") + 24000).cast("string"), -3, 3)
    return n.filter(F.col("n_regionkey").isin(1, 3)).join(wanted, "n_name", "left_semi").select(F.col("n_name").alias("name"), code.alias("code"))


@query("""select page_id as id, lower(trim(coalesce(nullif(trim(county),''), nullif(trim(thecity),''), nullif(trim(regexp_extract(raw,'county\\s*[:=]\\s*[''"]?([^''",}\\]]+)',1,'i')),''), nullif(trim(regexp_extract(raw,'city\\s*[:=]\\s*[''"]?([^''",}\\]]+)',1,'i')),''),''))) as label
 from (select *, concat_ws(' | ', county, thecity, props, cast(page_id as varchar)) as raw from (select page_id, case when page_id%4=0 then ' Arlington ' when page_id%4=1 then '' end as county,
  case when page_id%5=0 then 'Reston' end as thecity, case page_id%3 when 0 then '{County: "Prince '||page_id||'"}' when 1 then 'city = ''Bowie'', x' else 'none' end as props from pages))""")
def locality_label(spark, d):
    k = F.col("page_id")
    props = F.when(k % 3 == 0, F.concat(F.lit('{County: "Prince '), k.cast("string"), F.lit('"}'))).when(k % 3 == 1, "city = 'Bowie', x").otherwise("none")
    rows = X.load(spark, d, "pages").select(F.when(k % 4 == 0, " Arlington ").when(k % 4 == 1, "").alias("county"), F.when(k % 5 == 0, "Reston").alias("thecity"), props.alias("props"), "page_id")
    return rows.select(F.col("page_id").alias("id"), S.locality_label(rows, ("county",)).alias("label"))


@query("""select n_nationkey as k, n_name as county from nation where contains(lower(n_name),'an') or contains(lower(n_name),'il')""")
def token_filter(spark, d):
    n = X.load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("county"))
    return R.token_filter(n, ["AN", "il"], ["county"])


@query(with_tables("blocks stations", """select 'block' as kind, block_id as id, x, y, 'planned' as status from blocks union all select 'station', station_id, x, y, null from stations"""))
def concat_sources(spark, d):
    b = X.blocks(spark, d).select(F.lit("block").alias("kind"), F.col("block_id").alias("id"), "x", "y")
    s = X.stations(spark, d).select(F.lit("station").alias("kind"), F.col("station_id").alias("id"), "x", "y")
    return R.concat_sources([S.with_defaults(b, {"status": "planned"}), s])


@query("""select min(k) as k, lon, lat from (select l_partkey as k, cast(l_suppkey%50 as double)/1e6 + cast(l_linenumber as double)/1e8 as lon0, cast(l_suppkey%50 as double)/1e6 as lon, cast(l_linenumber as double) as lat from lineitem) group by lon, lat""")
def dedupe_points(spark, d):
    rows = X.load(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_suppkey") % 50 / 1e6).alias("lon"), F.col("l_linenumber").cast("double").alias("lat"))
    return R.dedupe_points(rows, [F.col("k")]).select("k", "lon", "lat")


@query(with_tables("stations places", """select distinct x, y from (select x, y from stations union all select x, y from places union all select x, y from stations)"""))
def distinct_points(spark, d):
    s = X.stations(spark, d).select("x", "y")
    return R.concat_sources([s, X.places(spark, d).select("x", "y"), s]).dropDuplicates(["x", "y"])


@query(with_tables("stations", f"""select station_id, round(x,3) as x, round(y,3) as y, round(lon,9) as lon, round(lat,9) as lat from (select station_id, lon, lat, lon*pi()/180*{geo.RADIUS} as x, {geo.RADIUS}*ln(tan(pi()/4+lat*pi()/180/2)) as y
 from (select station_id, -77.5+x/100000 as lon, 38.5+y/100000 as lat from stations))"""))
def mercator_roundtrip(spark, d):
    s = X.stations(spark, d).select("station_id", (F.col("x") / 100000 - 77.5).alias("lon"), (F.col("y") / 100000 + 38.5).alias("lat"))
    s = s.select("station_id", geo.mercator_x(F.col("lon")).alias("x"), geo.mercator_y(F.col("lat")).alias("y"))
    return s.select("station_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(geo.lon_of(F.col("x")), 9).alias("lon"), F.round(geo.lat_of(F.col("y")), 9).alias("lat"))


@query("""select event_id as line_id, case when value%100 is null then 'ok' when event_id%7=0 then 'ok' when value%100>=80 then 'alert' when value%100>=60 then 'warn' else 'ok' end as crowding,
 case when event_id%11=0 then 'ok' when value%20>=10 then 'alert' when value%20>=5 then 'warn' else 'ok' end as delay from events""")
def severity_chips(spark, d):
    m = X.meta(spark, d)
    return m.select("line_id", S.severity(F.col("occupancy_pct"), 80, 60).alias("crowding"), S.severity(F.col("delay_min"), 10, 5).alias("delay"))


@query(with_tables("meta", """select count(occupancy_pct) as with_occupancy, count(delay_min) as with_delay, count(*) filter (service_status='planned') as planned, round(avg(occupancy_pct),6) as avg_occupancy, max(delay_min) as max_delay, count(*) filter (is_accessible) as accessible from meta"""))
def ops_summary(spark, d):
    return M.operations_summary(X.meta(spark, d)).withColumn("avg_occupancy", F.round("avg_occupancy", 6))


@query("""select event_id as line_id, 'generated' as route_kind, coalesce(case when event_id%3=0 then 'planned' end,'planned') as service_status, case when event_id%7<>0 then value end as occupancy_pct from events""")
def line_defaults(spark, d):
    e = X.load(spark, d, "events").select(F.col("event_id").alias("line_id"), F.when(F.col("event_id") % 3 == 0, "planned").alias("service_status"), F.when(F.col("event_id") % 7 != 0, F.col("value").cast("string")).otherwise("NaN").alias("o"))
    e = S.with_defaults(e, {"route_kind": "generated"})
    return e.select("line_id", "route_kind", F.coalesce("service_status", F.lit("planned")).alias("service_status"), S.finite_or_null(F.col("o")).alias("occupancy_pct"))


@query(with_tables("od", """select substr(w_geocode,1,11) as w_tract, substr(h_geocode,1,11) as h_tract, cast(sum(S000) as bigint) as jobs from od group by 1,2"""))
def od_tract_agg(spark, d):
    return R.tract_flows(X.od(spark, d))


TRACTS = """flows as (select substr(w_geocode,1,14) as w_tract, substr(h_geocode,1,14) as h_tract, cast(sum(S000) as bigint) as jobs from od group by 1,2),
 centroids as (select tract, avg(x) as x, avg(y) as y from (select distinct substr(geoid,1,14) as tract, x, y from blocks) group by tract)"""


@query(with_tables("blocks od", """select w_tract, h_tract, round(x,6) as x, round(y,6) as y, jobs, round(jobs/max(jobs) over (),9) as demand_score from (select * from flows order by jobs desc, w_tract, h_tract limit 200) join centroids on tract=w_tract""", TRACTS))
def od_topk_normalised(spark, d):
    top = R.top_flows(R.tract_flows(X.od(spark, d), 14), R.tract_centroids(X.blocks(spark, d), 14), 200)
    return top.select("w_tract", "h_tract", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "jobs", F.round("demand_score", 9).alias("demand_score"))


@query(with_tables("blocks stations od", """select w.station_id as work_station, h.station_id as home_station, cast(sum(jobs) as bigint) as jobs from flows join site w on w.tract=w_tract join site h on h.tract=h_tract where w.d<=20000 and h.d<=20000 group by 1,2""",
 TRACTS + """, site as (select tract, station_id, d from (select tract, station_id, sqrt((c.x-s.x)*(c.x-s.x)+(c.y-s.y)*(c.y-s.y)) as d, row_number() over (partition by tract order by (c.x-s.x)*(c.x-s.x)+(c.y-s.y)*(c.y-s.y), station_id) as rn from centroids c cross join stations s) where rn=1)"""))
def od_station_matrix(spark, d):
    sites = nearest_join(R.tract_centroids(X.blocks(spark, d), 14), X.stations(spark, d), "tract", "station_id")
    return R.station_flows(R.tract_flows(X.od(spark, d), 14), sites, 20000.0)


@query(with_tables("blocks", """select b.block_id, a.median_income, a.poverty_rate from blocks b left join (select tract, median_income, poverty_rate from (select tract, balance+20000 as median_income, pop as poverty_rate, row_number() over (partition by tract order by block_id) as rn from blocks) where rn=1) a using (tract)"""))
def acs_left_join(spark, d):
    b = X.blocks(spark, d)
    acs = b.select("tract", (F.col("balance") + 20000).alias("median_income"), F.col("pop").alias("poverty_rate"), F.col("block_id").alias("at"))
    return R.left_attach(b.select("block_id", "tract"), acs, "tract", ["median_income", "poverty_rate"], [F.col("at")]).drop("tract")


@query(with_tables("blocks", """select block_id, round((1-(balance-(min(balance) over ()))/((max(balance) over ())-(min(balance) over ()))+(pop-(min(pop) over ()))/((max(pop) over ())-(min(pop) over ())))/2,9) as signal from blocks"""))
def acs_signal(spark, d):
    from loomgrid.operators.demand import acs_signal as signal

    b = X.blocks(spark, d).select("block_id", F.col("balance").alias("median_income"), F.col("pop").alias("poverty_rate"))
    return signal(b, ["median_income", "poverty_rate", "absent"], into="signal").select("block_id", F.round("signal", 9).alias("signal"))


@query("""select poi, rnk from (select cast(p_partkey as bigint) as poi, cast(dense_rank() over (order by p_retailprice desc) as int) as rnk from part)""")
def demand_rank(spark, d):
    return stats.dense_rank_of(X.poi(spark, d), "demand_score", "rnk").select(F.col("poi_id").alias("poi"), "rnk")


@query(with_tables("blocks", """select block_id, round((balance-avg(balance) over ())/stddev_pop(balance) over (),9) as balance, round((pop-avg(pop) over ())/stddev_pop(pop) over (),9) as pop from blocks"""))
def feature_standardise(spark, d):
    out = stats.standardise(X.blocks(spark, d).select("block_id", "balance", "pop"), ["balance", "pop"])
    return out.select("block_id", F.round("balance", 9).alias("balance"), F.round("pop", 9).alias("pop"))


@query(with_tables("blocks", """select block_id, round((balance-min(balance) over ())/((max(balance) over ())-(min(balance) over ())),9) as balance, 0.0e0 as flat0, 1.0e0 as flat1 from blocks"""))
def min_max_scale(spark, d):
    b = stats.min_max(X.blocks(spark, d).select("block_id", "balance", F.lit(3.0).alias("flat0"), F.lit(3.0).alias("flat1")), ["balance", "flat0"])
    return stats.min_max(b, ["flat1"], constant=1.0).select("block_id", F.round("balance", 9).alias("balance"), "flat0", "flat1")


@query(with_tables("blocks stations near", """select r.radius, round(100.0e0*sum(case when dist<=r.radius then pop else 0 end)/sum(pop),6) as pct from near cross join (values (5000.0e0),(10000.0e0),(20000.0e0)) r(radius) group by r.radius"""))
def coverage_radii(spark, d):
    near = _near(spark, d)
    return stats.coverage_at(near, [5000.0, 10000.0, 20000.0]).select("radius", F.round("pct", 6).alias("pct"))


def _near(spark, d):
    b = X.blocks(spark, d)
    return nearest_join(b, X.stations(spark, d), "block_id", "station_id").join(b.select("block_id", "pop", "balance"), "block_id")


@query(with_tables("blocks stations near", """select round(100.0e0*sum(case when dist<=10000 then 1 else 0 end)/count(*),6) as pct from near where balance >= (select quantile_cont(balance,0.75) from near)"""))
def high_need(spark, d):
    return stats.high_need(_near(spark, d), F.col("balance"), 10000.0).select(F.round("pct", 6).alias("pct"))


@query(with_tables("blocks stations routes nodes steps near", """select round((select sum(case when dist<=10000 then pop else 0 end) from near)/1000/(select sum(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)))/1000 from steps join nodes p on p.node_id=a join nodes q on q.node_id=b),6) as pop_per_km"""))
def service_efficiency(spark, d):
    return stats.service_efficiency(_near(spark, d), _track_km(spark, d), 10000.0).select(F.round("pop_per_km", 6).alias("pop_per_km"))


def _step_lengths(spark, d):
    from loomgrid.operators.routes import segments

    at = X.nodes(spark, d)
    a = at.select(F.col("node_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = at.select(F.col("node_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return segments(X.routes(spark, d)).join(a, "a").join(b, "b").withColumn("length_m", geo.planar_m(*[F.col(c) for c in ("ax", "ay", "bx", "by")]))


def _track_km(spark, d):
    return _step_lengths(spark, d).agg((F.sum("length_m") / 1000).alias("track_km"))


@query(with_tables("routes nodes steps", """select route_id, round(sum(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)))/1000,6) as km from steps join nodes p on p.node_id=a join nodes q on q.node_id=b group by route_id"""))
def track_km(spark, d):
    points = X.routes(spark, d).join(X.nodes(spark, d), "node_id").groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    line = F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return points.filter(F.size("p") > 1).select("route_id", F.round(geo.line_length(line) / 1000, 6).alias("km"))


@query(with_tables("blocks stations", """select round(2*sum(rn*served)/(count(*)*sum(served))-(count(*)+1.0e0)/count(*),6) as gini from (select served, row_number() over (order by served) as rn from (
 select s.station_id, coalesce(sum(pop/n),0) as served from stations s left join (select block_id, station_id, pop, count(*) over (partition by block_id) as n from blocks b join stations t on (b.x-t.x)*(b.x-t.x)+(b.y-t.y)*(b.y-t.y)<=25000000) p on p.station_id=s.station_id group by s.station_id))"""))
def gini_population(spark, d):
    served = stats.station_population(X.blocks(spark, d), X.stations(spark, d), 5000.0)
    return stats.gini(served, "served").select(F.round("gini", 6).alias("gini"))


@query("""select h.hour, round(coalesce(s.b,0),6) as boardings from (select cast(range as int) as hour from range(5,25)) h left join (select cast(hour(ts) as int) as hour, sum(value) as b from events group by 1) s on s.hour=h.hour""")
def hourly_totals(spark, d):
    e = X.load(spark, d, "events").select(F.col("user_id").alias("station_id"), F.hour("ts").alias("hour"), F.col("value").alias("boardings"))
    return M.hourly_totals(e, e.select("station_id").distinct()).select("hour", F.round("boardings", 6).alias("boardings"))


@query(with_tables("poi", """select issue, n from (select 'missing columns' as issue, cast(1 as bigint) as n union all select 'null geometry', count(*) from poi where poi_id%10=0 union all select 'missing srid', cast(1 as bigint))"""))
def data_validation(spark, d):
    p = X.poi(spark, d).withColumn("x", F.when(F.col("poi_id") % 10 != 0, F.col("x")))
    return R.validation(p, ["poi_id", "county"])
