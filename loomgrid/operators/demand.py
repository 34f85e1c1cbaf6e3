"""Demand scores of blocks, areas and nodes, and kernel densities."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, factorial, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.scalars import density
from loomgrid.operators.spatial import cell, nearest_join, radius_join
from loomgrid.operators.stats import dense_rank_of, min_max, with_stats
from loomgrid.scratch import settle


@dataclass(frozen=True)
class Weights:
    """Weights of the demand components."""

    population: float = 1.0
    poi: float = 0.4
    transit: float = 0.25
    equity: float = 0.35


def acs_signal(df: DataFrame, columns: Sequence[str], inverted: Sequence[str] = ("median_income",), into: str = "acs") -> DataFrame:
    """Mean of the min-max scaled columns that ``df`` has, ``inverted`` ones turned round; 0 without any."""
    have = [c for c in columns if c in df.columns]
    if not have:
        return df.withColumn(into, F.lit(0.0))
    scaled = with_stats(df, have)
    total = F.lit(0.0)
    for c in have:
        span = F.col(f"{c}__max") - F.col(f"{c}__min")
        part = F.when(span == 0, 0.0).otherwise((F.col(c) - F.col(f"{c}__min")) / F.nullif(span, F.lit(0.0)))
        total = total + (1 - part if c in inverted else part)
    return scaled.withColumn(into, total / len(have)).select(*df.columns, into)


def first_signal(df: DataFrame, candidates: Sequence[str], into: str) -> DataFrame:
    """The first candidate column, scaled to 0..1; 0 without any."""
    name = next((c for c in candidates if c in df.columns), None)
    return df.withColumn(into, F.lit(0.0)) if name is None else min_max(df.withColumn(into, F.col(name).cast("double")), [into])


def equity_signal(df: DataFrame, into: str = "equity") -> DataFrame:
    """Scaled poverty, else one less scaled income, else 0."""
    if "poverty_rate" in df.columns:
        return first_signal(df, ["poverty_rate"], into)
    if "median_income" in df.columns:
        return first_signal(df, ["median_income"], into).withColumn(into, 1 - F.col(into))
    return df.withColumn(into, F.lit(0.0))


def neighbours(rows: DataFrame, poi: DataFrame, transit: DataFrame, key: str, radius: float) -> DataFrame:
    """``key, poi_count, transit_m``: points of interest in ``radius`` and the way to the nearest stop."""
    counts = radius_join(rows.select(key, "x", "y"), poi.select(F.lit(1).alias("one"), "x", "y"), radius).groupBy(key).agg(F.count("one").cast("double").alias("poi_count"))
    near = nearest_join(rows.select(key, "x", "y"), transit, key, "station_id").select(key, F.col("dist").alias("transit_m"))
    return near.join(counts, key, "left").fillna({"poi_count": 0.0})


def block_demand(blocks: DataFrame, poi: DataFrame, transit: DataFrame, acs_columns: Sequence[str] = (), radius: float = 1000.0, weights: Weights = Weights()) -> DataFrame:
    """Component columns, ``demand_score`` and ``demand_rank`` of each block.

    ``blocks`` has ``block_id, x, y, pop, aland, awater`` and any of ``acs_columns``.
    """
    rows = blocks.withColumn("density", density(F.col("pop"), F.col("aland"), F.col("awater")))
    rows = acs_signal(rows, acs_columns)
    rows = settle(rows.join(neighbours(rows, poi, transit, "block_id", radius), "block_id"), "block-neighbours")
    rows = min_max(rows.select("block_id", "density", "poi_count", "transit_m", "acs"), ["density", "poi_count", "transit_m"])
    near = F.coalesce(1 - F.col("transit_m"), F.lit(0.0))
    score = weights.population * F.col("density") + weights.poi * F.col("poi_count") + weights.transit * near + weights.equity * F.col("acs")
    rows = rows.select("block_id", F.col("density").alias("population_signal"), F.col("poi_count").alias("poi_signal"), near.alias("transit_signal"), F.col("acs").alias("acs_signal"), score.alias("demand_score"))
    return dense_rank_of(rows, "demand_score", "demand_rank")


def area_demand(areas: DataFrame, poi: DataFrame, transit: DataFrame, acs_columns: Sequence[str] = (), radius: float = 1000.0, weights: Weights = Weights()) -> DataFrame:
    """Like ``block_demand`` for areas with a population column; equity and survey signals share a weight."""
    names = ("population", "pop", "POP20", "total_population", "B01003_001E")
    areas = settle(areas, "areas")
    rows = equity_signal(first_signal(areas, names, "population_signal"))
    rows = acs_signal(rows, acs_columns)
    rows = settle(rows.join(neighbours(rows, poi, transit, "area_id", radius), "area_id"), "area-neighbours")
    rows = min_max(rows.select("area_id", "population_signal", "equity", "acs", "poi_count", "transit_m"), ["poi_count", "transit_m"])
    near = F.coalesce(1 - F.col("transit_m"), F.lit(0.0))
    need = (F.col("equity") + F.col("acs")) / 2
    score = weights.population * F.col("population_signal") + weights.poi * F.col("poi_count") + weights.transit * near + weights.equity * need
    rows = rows.select("area_id", "population_signal", F.col("poi_count").alias("poi_signal"), near.alias("transit_signal"), need.alias("need_signal"), score.alias("demand_score"))
    return dense_rank_of(rows, "demand_score", "demand_rank")


def node_demand(nodes: DataFrame, points: DataFrame, radius: float, value: str = "demand_score") -> DataFrame:
    """``node_id, demand``: Gaussian-weighted demand of the points in ``radius``; a missing value column counts 1."""
    worth = F.col(value) if value in points.columns else F.lit(1.0)
    pairs = radius_join(nodes.select("node_id", "x", "y"), points.select(worth.cast("double").alias("v"), "x", "y"), radius)
    sums = pairs.groupBy("node_id").agg(F.sum(F.col("v") * F.exp(-F.col("dist2") / max((radius / 2) ** 2, 1.0))).alias("demand"))
    return nodes.select("node_id").join(sums, "node_id", "left").fillna({"demand": 0.0})


#: Cells of half a bandwidth and so many powers a side leave out less than 1e-11 of a sample.
_TERMS = 14


def _powers(u: np.ndarray) -> np.ndarray:
    """``u**m / m!`` for each power, one row a value."""
    steps = np.concatenate([np.ones((len(u), 1)), u[:, None] / np.arange(1, _TERMS)], axis=1)
    return np.cumprod(steps, axis=1)


def _shift(apart: float) -> np.ndarray:
    """Matrix from the powers of one cell to the kernel's series in a cell ``apart``, in units of the kernel's width."""
    n = 2 * _TERMS - 1
    h = [1.0, 2 * apart]
    for k in range(1, n - 1):
        h.append(2 * apart * h[k] - 2 * k * h[k - 1])
    # The n-th derivative of exp(-t*t) is (-1)**n times the n-th Hermite polynomial times it.
    slope = np.array([(-1) ** k * h[k] for k in range(n)]) * np.exp(-apart * apart)
    j, m = np.mgrid[0:_TERMS, 0:_TERMS]
    return (-1.0) ** m * slope[j + m] / np.array([factorial(k) for k in range(_TERMS)])[:, None]


def _finite(*names: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).between(-1e300, 1e300) for c in names])


def density_at(queries: DataFrame, samples: DataFrame, key: str, bandwidth: float, cutoff: float = 9.0) -> DataFrame:
    """``key, density``: Gaussian kernel density of ``samples`` at each query point.

    A fast Gauss transform: the samples of a cell become the sums of their powers, and those of all cells in reach one
    series for each cell of queries, first along x and then along y. So samples and queries meet only through
    the cells, and a query costs the same however many samples are around it. Samples beyond ``cutoff`` bandwidths add
    less than 3e-18 of a sample each; not all of them are left out. ``key`` must be unique. Points without finite coordinates
    have density 0 and as samples only count.
    """
    size, unit = bandwidth / 2.0, bandwidth * 2.0**0.5
    reach, full = ceil(2 * cutoff) + 1, _TERMS * _TERMS
    at = lambda c: cell(F.col(c), size)

    def powers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 4_000):
                rows = batch.iloc[begin : begin + 4_000]
                xy = rows[["x", "y"]].to_numpy(dtype="float64")
                spots, which = np.unique(rows[["cx", "cy"]].to_numpy(dtype="int64"), axis=0, return_inverse=True)
                order = np.argsort(which.ravel(), kind="stable")
                u = (xy - (spots[which.ravel()] + 0.5) * size) / unit
                both = (_powers(u[:, 0])[:, :, None] * _powers(u[:, 1])[:, None, :]).reshape(len(u), full)
                first = np.searchsorted(which.ravel()[order], np.arange(len(spots)))
                sums = np.add.reduceat(both[order], first, axis=0)
                yield pd.DataFrame({"cx": spots[:, 0], "cy": spots[:, 1], "c": [v.tobytes() for v in sums]})

    def spread(held: dict[int, np.ndarray], into: Iterable[int], axis: int) -> Iterator[tuple[int, np.ndarray]]:
        for t in into:
            found = None
            for c in range(t - reach, t + reach + 1):
                if c in held:
                    part = shifts[t - c + reach] @ held[c] if axis == 0 else held[c] @ shifts[t - c + reach].T
                    found = part if found is None else found + part
            if found is not None:
                yield t, found

    shifts = [_shift(d * size / unit) for d in range(-reach, reach + 1)]
    unpacked = lambda blob: np.frombuffer(blob, dtype="float64").reshape(_TERMS, _TERMS)

    def gathered(rows: pd.DataFrame, by: str) -> dict[int, np.ndarray]:
        held: dict[int, np.ndarray] = {}
        for c, blob in zip(rows[by].tolist(), rows["c"]):
            held[c] = held[c] + unpacked(blob) if c in held else unpacked(blob)
        return held

    def along_x(rows: pd.DataFrame) -> pd.DataFrame:
        held = gathered(rows, "cx")
        near = sorted({t for c in held for t in range(c - reach, c + reach + 1)})
        out = [(t, int(rows["cy"].iloc[0]), m.tobytes()) for t, m in spread(held, near, 0)]
        return pd.DataFrame(out, columns=["cx", "cy", "c"])

    def along_y(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or wanted.empty:
            return pd.DataFrame([], columns=["cx", "cy", "c"])
        held = gathered(rows, "cy")
        out = [(int(rows["cx"].iloc[0]), t, m.ravel().tolist()) for t, m in spread(held, wanted["cy"].tolist(), 1)]
        return pd.DataFrame(out, columns=["cx", "cy", "c"])

    placed = samples.select("x", "y").filter(_finite("x", "y")).select("x", "y", at("x").alias("cx"), at("y").alias("cy"))
    # In order of the cells a batch holds few of them, and a crowded cell may be cut.
    placed = placed.repartitionByRange("cx", "cy", "x", "y").sortWithinPartitions("cx", "cy")
    blobs = "cx long, cy long, c binary"
    rows = settle(placed.mapInPandas(powers, blobs).groupBy("cy").applyInPandas(along_x, blobs), "density-rows")
    spots = queries.select(key, "x", "y").withColumns({"cx": F.when(_finite("x", "y"), at("x")), "cy": F.when(_finite("x", "y"), at("y"))})
    wanted = spots.select("cx", "cy").filter("cx is not null").distinct()
    series = rows.groupBy("cx").cogroup(wanted.groupBy("cx")).applyInPandas(along_y, "cx long, cy long, c array<double>")
    turned = F.transform(F.sequence(F.lit(_TERMS - 1), F.lit(0), F.lit(-1)), lambda i: F.reverse(F.slice("c", i * _TERMS + 1, _TERMS)))
    series = settle(series.select("cx", "cy", turned.alias("c")), "density-series")
    v = lambda c: (F.col(c) - (F.col(f"c{c}") + 0.5) * size) / unit
    row = lambda r: F.aggregate(r, F.lit(0.0), lambda s, e: s * F.col("vy") + e)
    total = F.aggregate("c", F.lit(0.0), lambda s, r: s * F.col("vx") + row(r))
    n = F.broadcast(samples.agg(F.count(F.lit(1)).alias("n")))
    found = spots.withColumns({"vx": v("x"), "vy": v("y")}).join(series, ["cx", "cy"], "left").select(key, F.greatest(total, F.lit(0.0)).alias("k")).join(n)
    return found.select(key, F.coalesce(F.col("k") / (F.nullif(F.col("n"), F.lit(0)) * 2 * pi * bandwidth**2), F.lit(0.0)).alias("density"))


def log_density_at(queries: DataFrame, samples: DataFrame, key: str, bandwidth: float, block: int = 2_000) -> DataFrame:
    """``key, log_density``: log of the Gaussian kernel density of all ``samples`` at each query point, without a cutoff.

    Every sample counts, so that far points differ too. Samples are gathered in blocks, and a block gives each query the
    largest exponent and the sum of the others relative to it, which add up to the whole sum without underflow. Meant for
    few queries, such as the nodes of a contracted graph; without samples the result is null. ``key`` must be unique.
    """
    packed = samples.filter("x is not null and y is not null").select(F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)).alias("i"), "x", "y")
    packed = packed.groupBy(F.spark_partition_id().alias("p"), F.floor(F.col("i") / block).alias("b")).agg(F.collect_list(F.struct("x", "y")).alias("spots"))
    packed = settle(packed.select("spots"), "density-blocks")
    exponents = F.transform("spots", lambda s: -((s["x"] - F.col("x")) ** 2 + (s["y"] - F.col("y")) ** 2) / (2.0 * bandwidth**2))
    pairs = queries.select(key, "x", "y").join(packed).select(key, exponents.alias("e")).withColumn("most", F.array_max("e"))
    parts = pairs.select(key, "most", F.size("e").alias("n"), F.aggregate("e", F.lit(0.0), lambda s, e: s + F.exp(e - F.col("most"))).alias("sum"))
    tops = parts.groupBy(key).agg(F.max("most").alias("top"), F.sum("n").alias("n"), F.collect_list(F.struct("most", "sum")).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["sum"] * F.exp(p["most"] - F.col("top")))
    found = tops.select(key, (F.col("top") + F.ln(total) - F.ln(F.col("n") * 2 * pi * bandwidth**2)).alias("log_density"))
    return queries.select(key).join(found, key, "left")


def circle_offsets(radius: float, points: int = 16) -> Column:
    """The centre and ``points`` points of a circle, as ``array<struct<dx,dy>>``."""
    turn = lambda i: i * (2 * pi / points)
    rim = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct((radius * F.cos(turn(i))).alias("dx"), (radius * F.sin(turn(i))).alias("dy")))
    return F.concat(F.array(F.struct(F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))), rim)


def radial_score(nodes: DataFrame, samples: DataFrame, bandwidth: float, radius: float = 1000.0) -> DataFrame:
    """``node_id, score``: mean density over a node and a circle around it, times 1e10."""
    spots = nodes.select("node_id", "x", "y", F.posexplode(circle_offsets(radius)).alias("i", "o"))
    spots = spots.select(F.struct("node_id", "i").alias("spot"), (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    rated = density_at(spots, samples, "spot", bandwidth)
    return rated.groupBy(F.col("spot.node_id").alias("node_id")).agg((F.avg("density") * 1e10).alias("score"))


def disc_offsets(radius: float, grid: int) -> Column:
    """Points of a ``grid`` by ``grid`` lattice over the square that lie in the disc."""
    line = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: -radius + i * (2.0 * radius / (grid - 1)))
    cells = F.flatten(F.transform(line, lambda y: F.transform(line, lambda x: F.struct(x.alias("dx"), y.alias("dy")))))
    return F.filter(cells, lambda c: F.hypot(c["dx"], c["dy"]) <= radius)


def catchment_mass(stations: DataFrame, samples: DataFrame, bandwidth: float, radius: float, grid: int, stride_to: int | None = None) -> DataFrame:
    """``station_id, mass``: density integrated over each catchment; overlaps count again.

    With ``stride_to`` every k-th lattice point is kept and then only the first ``stride_to``, without
    rescaling, as the existing figures were made; the default uses the whole lattice.
    """
    offsets = disc_offsets(radius, grid)
    if stride_to:
        n = sum(1 for i in range(grid) for j in range(grid) if ((-radius + 2 * radius * i / (grid - 1)) ** 2 + (-radius + 2 * radius * j / (grid - 1)) ** 2) ** 0.5 <= radius)
        step = max(1, n // stride_to)
        offsets = F.slice(F.filter(offsets, lambda c, i: i % step == 0), 1, stride_to)
    spots = stations.select("station_id", "x", "y", F.posexplode(offsets).alias("i", "o"))
    spots = spots.select(F.struct("station_id", "i").alias("spot"), (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    rated = density_at(spots, samples, "spot", bandwidth)
    return rated.groupBy(F.col("spot.station_id").alias("station_id")).agg((F.sum("density") * (2.0 * radius / grid) ** 2).alias("mass"))


def population_samples(blocks: DataFrame, per_person: float, seed: int = 0) -> DataFrame:
    """``block_id, i, x, y``: ``max(1, int(pop * per_person))`` points around each populated block.

    Offsets are normal with a third of the radius of a disc of the block's area (at least 1), drawn
    from hashes of the block and the point, so that any partitioning gives the same points. Without
    population there is one point at the origin.
    """
    people = blocks.filter("pop > 0")
    spread = F.greatest(F.sqrt((F.col("aland") + F.col("awater")) / pi) / 3, F.lit(1.0))
    drawn = people.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("pop") * per_person).cast("int")))))
    uniform = lambda salt: (F.pmod(F.xxhash64("block_id", "i", F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    size = F.sqrt(-2 * F.ln(uniform(1))) * spread
    points = drawn.select("block_id", "i", (F.col("x") + size * F.cos(2 * pi * uniform(2))).alias("x"), (F.col("y") + size * F.sin(2 * pi * uniform(2))).alias("y"))
    origin = blocks.agg(F.count_if(F.col("pop") > 0).alias("n")).filter("n = 0").select(F.lit(None).cast("long").alias("block_id"), F.lit(1).alias("i"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return points.unionByName(origin)
