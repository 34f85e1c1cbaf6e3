"""URL filter: listed rules first, then logistic regression on hashed character n-grams.

The model is trained from a small labelled URL table and judges the URLs that no rule fits.
Features are character n-grams of host and path, hashed to ``SLOTS`` slots; training is full-batch
gradient descent, one aggregation a step over the exploded features of the labelled table, with
the weights (``SLOTS`` numbers) kept by the driver. DataFrame operations only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.scratch import settle

SLOTS = 4096
GRAMS = (3, 4)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without ``://`` and for null."""
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.substr(url, cut + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> Rule:
    """``host/path`` as host and path, the path with its slash."""
    host, slash, path = rule.partition("/")
    return host, slash + path


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none fits. ``rules`` are (verdict, rule)."""
    name = verdict = None
    for said, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        of, under = split_rule(rule)
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(under))
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def gram_slots(host: Column, path: Column) -> Column:
    """Distinct slots of the character n-grams of ``^host|path$``."""
    line = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))

    def slots(chars: Column) -> Column:
        def of_length(n: int) -> Column:
            starts = F.slice(chars, 1, F.greatest(F.size(chars) - (n - 1), F.lit(0)))
            gram = lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, n)])
            return F.transform(starts, lambda c, i: F.pmod(F.xxhash64(gram(c, i)), F.lit(SLOTS)).cast("int"))

        return F.array_distinct(F.concat(*[of_length(n) for n in GRAMS]))

    # The characters are bound once; as a plain column they would be split anew for every gram.
    return F.get(F.transform(F.array(F.split(line, "")), slots), F.lit(0))


def _lookup(weights: list[float]) -> Column:
    """The weights as one constant array, folded once when the plan is made."""
    return F.split(F.lit(",".join(repr(w) for w in weights)), ",").cast("array<double>")


def margin(slots: Column, weights: list[float], bias: float) -> Column:
    """Log-odds of ``block``: bias plus the mean weight of the URL's slots."""
    table = _lookup(weights)
    return F.aggregate(slots, F.lit(0.0), lambda total, s: total + F.get(table, s)) / F.sqrt(F.greatest(F.size(slots), F.lit(1))) + bias


def train(labelled: DataFrame, steps: int = 30, rate: float = 4.0, decay: float = 1e-4) -> tuple[list[float], float]:
    """Weights and bias from ``host, path, block`` (boolean), a small table.

    An empty table gives zeros and a bias of -20 (allow); one with a single verdict, that verdict.
    """
    rows = labelled.select(F.col("block").cast("double").alias("y"), gram_slots(F.col("host"), F.col("path")).alias("slots"))
    rows = settle(rows, "url-features", files=8).withColumn("scale", 1 / F.sqrt(F.greatest(F.size("slots"), F.lit(1))))
    n, blocked = rows.agg(F.count(F.lit(1)), F.sum("y")).head()
    weights = [0.0] * SLOTS
    if not n or blocked in (0, n):
        return weights, 20.0 if n and blocked else -20.0
    bias = math.log(blocked / (n - blocked))
    speed, bias_speed = [0.0] * SLOTS, 0.0
    for _ in range(steps):
        ahead = [w + 0.9 * v for w, v in zip(weights, speed)]
        miss = 1 / (1 + F.exp(-margin(F.col("slots"), ahead, bias + 0.9 * bias_speed))) - F.col("y")
        gaps = rows.select((miss * F.col("scale")).alias("gap"), miss.alias("miss"), F.explode(F.concat(F.array(F.lit(-1)), "slots")).alias("slot"))
        sums = gaps.groupBy("slot").agg(F.sum(F.when(F.col("slot") < 0, F.col("miss")).otherwise(F.col("gap"))).alias("g")).collect()
        slope = {r["slot"]: r["g"] / n for r in sums}
        bias_speed = 0.9 * bias_speed - 0.2 * slope.pop(-1)
        bias += bias_speed
        speed = [0.9 * v - rate * (slope.get(i, 0.0) + decay * w) for i, (v, w) in enumerate(zip(speed, weights))]
        weights = [w + v for w, v in zip(weights, speed)]
    return weights, bias


def labelled_by_rules(pages: DataFrame, rules: Sequence[tuple[str, str]], most: int, url_col: str = "url") -> DataFrame:
    """A labelled URL table of at most ``most`` distinct URLs on which the rules decide.

    URLs are picked by a hash, so the table is the same on every run.
    """
    host, path = url_parts(F.col(url_col))
    parts = pages.select(host.alias("host"), path.alias("path"))
    _, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    known = parts.withColumn("block", verdict == "block").filter(F.col("block").isNotNull()).distinct()
    return known.orderBy(F.xxhash64("host", "path"), "host", "path").limit(most)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    labelled: DataFrame | None = None,
    threshold: float = 0.5,
    max_labelled: int = 4_096,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``id, host, path, rule, verdict, score`` for every row.

    The longest fitting rule decides; else the model blocks at a probability of ``threshold``.
    ``labelled`` has ``host, path, block``; without it the model learns from at most ``max_labelled`` URLs
    of ``pages`` that rules decide. Null and malformed URLs have an empty host and path, which the
    model judges too; URLs of any length are read whole. Repeated rows are judged alike; an empty table gives no rows; other columns
    are ignored.
    """
    if labelled is None:
        labelled = labelled_by_rules(pages, rules, max_labelled, url_col)
    weights, bias = train(labelled)
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    score = 1 / (1 + F.exp(-margin(gram_slots(F.col("host"), F.col("path")), weights, bias)))
    judged = parts.select("id", "host", "path", rule.alias("rule"), said.alias("said"), score.alias("score"))
    guess = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return judged.select("id", "host", "path", "rule", F.coalesce("said", guess).alias("verdict"), "score")
