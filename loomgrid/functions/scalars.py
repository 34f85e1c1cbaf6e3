"""Scalar columns: safe numbers, identifiers, labels and tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which sources call the tract column, in order of preference.
GEOID_COLUMNS = (
    "GEOID", "geoid", "GEOID20", "GEOID10", "GEOIDFQ", "tract_geoid",
    "tract", "TRACT", "TRACTCE", "TRACTCE20", "DC_CEN_TRA", "DC_CEN_T_1",
)
# State names and their codes.
STATE_CODES = {"dc": "11", "md": "24", "va": "51"}
# Patterns of locality labels.
COUNTY_PATTERN = r"""(?i)county\s*[:=]\s*['"]?([^'",}\]]+)"""
CITY_PATTERN = r"""(?i)city\s*[:=]\s*['"]?([^'",}\]]+)"""
# Tag values by track type.
METRO = ("subway", "light_rail", "tram")
HEAVY = ("rail", "narrow_gauge", "miniature")
TUNNEL = ("yes", "true", "1", "building_passage")
BRIDGE = ("yes", "true", "viaduct")
PRIORITY = ("subway_tunnel", "subway_surface", "rail_existing", "elevated", "street", "unknown")


def safe_number(value: Column) -> Column:
    """A finite double; anything else is 0."""
    number = value.try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), 0.0).otherwise(F.coalesce(number, F.lit(0.0)))


def density(population: Column, land: Column, water: Column) -> Column:
    """Population for each thousand units of area; 0 without area."""
    return F.coalesce(F.try_divide(safe_number(population), safe_number(land) + safe_number(water)) * 1000, F.lit(0.0))


def zfill(value: Column, width: int) -> Column:
    """Zeros on the left up to ``width``; longer values stay."""
    return F.when(F.length(value) < width, F.lpad(value, width, "0")).otherwise(value)


def normal_geoid(value: Column, width: int | None = None) -> Column:
    """Trimmed, without a trailing ``.0``, null if empty; all-digit values are filled to ``width``."""
    text = F.trim(value.cast("string"))
    plain = F.when(text != "", F.regexp_replace(text, r"\.0$", ""))
    return plain if width is None else F.when(F.rlike(plain, F.lit("^[0-9]+$")), zfill(plain, width)).otherwise(plain)


def tract_geoid(state: Column, county: Column, tract: Column) -> Column:
    """State, county and six digits of a tract number with two decimals; null if it is no number."""
    number = F.bround(tract.try_cast("double") * 100).cast("long").cast("string")
    return F.concat(state, county, zfill(number, 6))


def geoid_column(df: DataFrame, candidates: Sequence[str] = GEOID_COLUMNS) -> str | None:
    """The first candidate that is a column of ``df``."""
    return next((c for c in candidates if c in df.columns), None)


def join_key(df: DataFrame, column: str) -> Column:
    """Join key by the kind of column: full codes are normalised, tract numbers also filled to six."""
    if column in GEOID_COLUMNS[:5]:
        return normal_geoid(F.col(column))
    if column in ("TRACT", "TRACTCE", "TRACTCE20", "DC_CEN_TRA", "DC_CEN_T_1"):
        return normal_geoid(F.col(column), 6)
    return F.col(column).cast("string")


def prefix(value: Column, length: int = 11) -> Column:
    """The first ``length`` characters; shorter values give null."""
    return F.when(F.length(value) >= length, F.substring(value, 1, length))


def state_code(name: Column) -> Column:
    """Two digits for a state's short name or its own digits; else null."""
    short = F.lower(F.trim(name))
    found = F.when(F.rlike(short, F.lit("^[0-9]{2}$")), short)
    for state, code in STATE_CODES.items():
        found = found.when(short == state, code)
    return found


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns that are missing, with a constant each."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def locality_label(df: DataFrame, keys: Sequence[str]) -> Column:
    """The first filled key column, else a ``county:`` or ``city:`` value in any text, else empty; lower case."""
    tidy = lambda c: F.nullif(F.trim(c), F.lit(""))
    named = [tidy(F.col(k)) for k in keys if k in df.columns]
    named += [tidy(F.col(c)) for c in df.columns if c not in keys and ("county" in c or c.endswith("city"))]
    everything = F.concat_ws(" | ", *[F.col(c).cast("string") for c in df.columns])
    found = [tidy(F.regexp_extract(everything, p, 1)) for p in (COUNTY_PATTERN, CITY_PATTERN)]
    return F.lower(F.trim(F.coalesce(*named, *found, F.lit(""))))


def has_token(tokens: Sequence[str], *columns: Column) -> Column:
    """True if a token is part of a column, ignoring case; without tokens always true."""
    if not tokens:
        return F.lit(True)
    words = F.array(*[F.lit(t.lower()) for t in tokens])
    either = F.lit(False)
    for c in columns:
        either = either | _any_in(words, F.lower(F.coalesce(c, F.lit(""))))
    return either


def _any_in(words: Column, text: Column) -> Column:
    return F.exists(words, lambda t: F.contains(text, t))


def track_type(tags: Column) -> Column:
    """Right-of-way type of a network edge from its ``map<string,string>`` of tags."""
    tag = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    rail, bridge, tunnel = tag("railway"), tag("bridge").isin(*BRIDGE), tag("tunnel").isin(*TUNNEL)
    return (
        F.when(rail.isin(*METRO), F.when(tunnel, "subway_tunnel").when(bridge, "elevated").otherwise("subway_surface"))
        .when(rail.isin(*HEAVY), F.when(bridge, "elevated").otherwise("rail_existing"))
        .when(tag("highway") != "", F.when(bridge, "elevated").otherwise("street"))
        .otherwise("unknown")
    )


def priority(kind: Column) -> Column:
    """Rank of a track type, the best first."""
    rank = F.lit(len(PRIORITY) - 1)
    for i, name in enumerate(PRIORITY):
        rank = F.when(kind == name, i).otherwise(rank)
    return rank


def label_part(label: Column) -> Column:
    """The second part of a label with a hyphen, else the label; trimmed."""
    parts = F.split(label, "-")
    return F.trim(F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))))


def severity(value: Column, alert: float, warn: float) -> Column:
    """``alert``, ``warn`` or ``ok``; null is ``ok``."""
    return F.when(value >= alert, "alert").when(value >= warn, "warn").otherwise("ok")


def finite_or_null(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def decay(distance: Column, beta: float = 0.0008) -> Column:
    return F.exp(-beta * distance)
