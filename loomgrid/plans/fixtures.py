"""Deterministic transit tables derived from the star schema, for Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPOTS = {"block": (7919, 104729), "station": (6151, 15485863), "poi": (3571, 27644437), "place": (4001, 5003)}

# Five polygons as rings of corners; the second has a hole, the fifth two parts.
RINGS = [
    (1, [(5000, 5000), (45000, 5000), (45000, 40000), (5000, 40000)]),
    (2, [(50000, 5000), (95000, 5000), (95000, 45000), (50000, 45000)]),
    (2, [(60000, 15000), (80000, 15000), (80000, 30000), (60000, 30000)]),
    (3, [(10000, 50000), (30000, 45000), (45000, 60000), (40000, 90000), (15000, 95000), (5000, 70000)]),
    (4, [(55000, 55000), (90000, 60000), (70000, 95000)]),
    (5, [(20000, 96000), (40000, 96000), (40000, 99000), (20000, 99000)]),
    (5, [(60000, 96000), (90000, 96000), (90000, 99000), (60000, 99000)]),
]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spot(key: str, kind: str) -> list:
    a, b = SPOTS[kind]
    k = F.col(key).cast("long")
    return [((k * a) % 10007 * 10.0).cast("double").alias("x"), ((k * b) % 10009 * 10.0).cast("double").alias("y")]


def blocks(spark, d):
    k = F.col("c_custkey").cast("long")
    bare = k % 50 == 0
    return load(spark, d, "customer").select(
        k.alias("block_id"), *spot("c_custkey", "block"), F.greatest(F.floor("c_acctbal"), F.lit(0)).cast("double").alias("pop"),
        F.when(bare, 0).otherwise(10000 + (k % 97) * 500).cast("double").alias("aland"), F.when(bare, 0).when(k % 5 == 0, 2000).otherwise(0).cast("double").alias("awater"),
        F.lpad(k.cast("string"), 15, "0").alias("geoid"), F.lpad(F.floor(k / 10).cast("long").cast("string"), 11, "0").alias("tract"), F.col("c_acctbal").alias("balance"),
    )


def stations(spark, d):
    named = load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select(F.col("s_suppkey").cast("long").alias("station_id"), *spot("s_suppkey", "station"), F.concat(F.lit("AREA-"), "n_name").alias("name"))


def poi(spark, d):
    return load(spark, d, "part").select(F.col("p_partkey").cast("long").alias("poi_id"), *spot("p_partkey", "poi"), F.col("p_retailprice").alias("demand_score"))


def places(spark, d):
    label = F.concat(F.lit("Cluster "), F.col("n_regionkey").cast("string"), F.lit("-"), F.col("n_name"))
    return load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("place_id"), *spot("n_nationkey", "place"), label.alias("label"))


def ring_edges(spark, d):
    rows = [(p, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for p, ring in RINGS for a, b in zip(ring, ring[1:] + ring[:1])]
    return spark.createDataFrame(rows, "poly_id int, x1 double, y1 double, x2 double, y2 double")


def od(spark, d):
    both = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    code = lambda c: F.lpad(F.col(c).cast("long").cast("string"), 15, "0")
    return both.select(code("l_suppkey").alias("w_geocode"), code("o_custkey").alias("h_geocode"), F.col("l_quantity").cast("long").alias("S000"))


def routes(spark, d):
    from pyspark.sql import Window

    # Dealt out by order once: the groups, the window and later sums by route need no further shuffle.
    once = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").repartition("l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("at"))
    order = Window.partitionBy("l_orderkey").orderBy("at", "l_suppkey")
    return once.select(F.col("l_orderkey").cast("long").alias("route_id"), (F.row_number().over(order) - 1).alias("pos"), F.col("l_suppkey").cast("long").alias("node_id"))


def nodes(spark, d):
    return load(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("node_id"), *spot("s_suppkey", "station"), F.col("s_acctbal").alias("score"))


def edges(spark, d):
    from loomgrid.functions.geo import planar_m
    from loomgrid.operators.routes import segments

    pairs = segments(routes(spark, d)).select("src", "dst").distinct()
    at = nodes(spark, d)
    a = at.select(F.col("node_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = at.select(F.col("node_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", planar_m(*[F.col(c) for c in ("ax", "ay", "bx", "by")]).alias("weight"))


def individuals(spark, d):
    return routes(spark, d).withColumn("ind_id", F.col("route_id") % 8)


TAGS = {0: {"railway": "subway", "tunnel": "yes"}, 1: {"railway": "subway", "bridge": "viaduct"}, 2: {"railway": "tram"}, 3: {"railway": "rail"}, 4: {"railway": "rail", "bridge": "yes"}, 5: {"highway": "primary"}, 6: {}}


def network(spark, d):
    """Track edges between consecutive points of interest, with tags."""
    from loomgrid.functions.scalars import track_type

    p = poi(spark, d)
    ends = p.select((F.col("poi_id") - 1).alias("edge_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    base = p.select(F.col("poi_id").alias("edge_id"), F.col("x").alias("x1"), F.col("y").alias("y1")).join(ends, "edge_id")
    kind = F.col("edge_id") % 7
    tags = F.create_map().cast("map<string,string>")
    for k, t in TAGS.items():
        if t:
            tags = F.when(kind == k, F.create_map(*[F.lit(v) for pair in t.items() for v in pair])).otherwise(tags)
    return base.withColumn("tags", tags).withColumn("row_type", track_type(F.col("tags")))


def meta(spark, d):
    """Line properties with nulls, from the event stream."""
    e = load(spark, d, "events")
    gone = F.col("event_id") % 7 == 0
    return e.select(
        F.col("event_id").alias("line_id"), F.when(~gone, F.col("value") % 100).alias("occupancy_pct"), F.when(F.col("event_id") % 11 != 0, F.col("value") % 20).alias("delay_min"),
        F.when(F.col("event_id") % 3 == 0, "planned").otherwise("open").alias("service_status"), (F.col("event_id") % 2 == 0).alias("is_accessible"),
    )


def _spot(key: str, kind: str) -> str:
    a, b = SPOTS[kind]
    return f"cast(cast({key} as bigint)*{a} % 10007 as double)*10.0e0 as x, cast(cast({key} as bigint)*{b} % 10009 as double)*10.0e0 as y"


_EDGES = ", ".join(f"({p},{a[0]}.0e0,{a[1]}.0e0,{b[0]}.0e0,{b[1]}.0e0)" for p, ring in RINGS for a, b in zip(ring, ring[1:] + ring[:1]))

#: Common table expressions for DuckDB, by name; each may use those before it.
SQL = {
    "blocks": f"""blocks as (select cast(c_custkey as bigint) as block_id, {_spot('c_custkey', 'block')}, cast(greatest(floor(c_acctbal),0) as double) as pop,
      cast(case when c_custkey%50=0 then 0 else 10000+(c_custkey%97)*500 end as double) as aland, cast(case when c_custkey%50=0 then 0 when c_custkey%5=0 then 2000 else 0 end as double) as awater,
      lpad(cast(c_custkey as varchar),15,'0') as geoid, lpad(cast(c_custkey//10 as varchar),11,'0') as tract, c_acctbal as balance from customer)""",
    "stations": f"stations as (select cast(s_suppkey as bigint) as station_id, {_spot('s_suppkey', 'station')}, 'AREA-'||n_name as name from supplier join nation on s_nationkey=n_nationkey)",
    "poi": f"poi as (select cast(p_partkey as bigint) as poi_id, {_spot('p_partkey', 'poi')}, p_retailprice as demand_score from part)",
    "places": f"places as (select cast(n_nationkey as bigint) as place_id, {_spot('n_nationkey', 'place')}, 'Cluster '||n_regionkey||'-'||n_name as label from nation)",
    "ring_edges": f"ring_edges(poly_id,x1,y1,x2,y2) as (values {_EDGES})",
    "od": "od as (select lpad(cast(l_suppkey as varchar),15,'0') as w_geocode, lpad(cast(o_custkey as varchar),15,'0') as h_geocode, cast(l_quantity as bigint) as S000 from lineitem join orders on l_orderkey=o_orderkey)",
    "routes": """routes as (select cast(l_orderkey as bigint) as route_id, cast(row_number() over (partition by l_orderkey order by first_line, l_suppkey)-1 as int) as pos, cast(l_suppkey as bigint) as node_id
      from (select l_orderkey, l_suppkey, min(l_linenumber) as first_line from lineitem group by 1,2))""",
    "nodes": f"nodes as (select cast(s_suppkey as bigint) as node_id, {_spot('s_suppkey', 'station')}, s_acctbal as score from supplier)",
    "steps": "steps as (select *, least(a,b) as src, greatest(a,b) as dst from (select route_id, pos, node_id as a, lead(node_id) over (partition by route_id order by pos) as b from routes) where b is not null)",
    "edges": "edges as (select src, dst, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) as weight from (select distinct src, dst from steps) e join nodes p on p.node_id=src join nodes q on q.node_id=dst)",
    "adj": "adj as (select src as node, dst as other from edges union all select dst, src from edges)",
    "individuals": "individuals as (select *, route_id%8 as ind_id from routes)",
    "network": """network as (select a.poi_id as edge_id, a.x as x1, a.y as y1, b.x as x2, b.y as y2,
      case a.poi_id%7 when 0 then 'subway_tunnel' when 1 then 'elevated' when 2 then 'subway_surface' when 3 then 'rail_existing' when 4 then 'elevated' when 5 then 'street' else 'unknown' end as row_type
      from poi a join poi b on b.poi_id=a.poi_id+1)""",
    "near": """near as (select block_id, any_value(pop) as pop, any_value(balance) as balance, min(sqrt((b.x-s.x)*(b.x-s.x)+(b.y-s.y)*(b.y-s.y))) as dist from blocks b cross join stations s group by block_id)""",
    "meta": """meta as (select event_id as line_id, case when event_id%7<>0 then value%100 end as occupancy_pct, case when event_id%11<>0 then value%20 end as delay_min,
      case when event_id%3=0 then 'planned' else 'open' end as service_status, event_id%2=0 as is_accessible from events)""",
}


def with_tables(names: str, query: str, more: str = "", recursive: bool = False) -> str:
    """A query over the named fixtures, in the order of ``SQL``; ``more`` are further expressions."""
    wanted = names.split()
    parts = [SQL[n] for n in SQL if n in wanted] + ([more] if more else [])
    return ("with recursive " if recursive else "with ") + ",\n".join(parts) + "\n" + query
