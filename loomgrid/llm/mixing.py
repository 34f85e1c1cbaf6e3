"""Mixing sources to target weights with hash-threshold histograms.

Words are summed by source and hash bucket, a prefix sum finds the bucket in which the source's
budget ends, and only the rows of that bucket are summed again on the next hash bits, until the
threshold is exact. The final pass is a filter on ``hash < threshold``; rows are never sorted.
Thresholds are nested: a larger budget takes every row that a smaller one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.scratch import settle

HASH_BITS = 60
LEVEL_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words in a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(ident: Column, text: Column, seed: int) -> Column:
    """A seeded hash of the id in 60 bits; of the text, for a row without an id, so that reruns agree."""
    name = F.coalesce(ident.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized_rows(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Narrow rows ``id, source, size, h``."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        draw(F.col(id_col), F.col(text_col), seed).alias("h"),
    )


def source_targets(rows: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """``source, source_size, target`` for each source of ``rows``.

    Sources take ``weights`` in turn, by code point, null last, and share the words of all sources
    in that proportion. No target exceeds ``cap`` times its source; what lies above goes to the
    other sources by weight. With sources in the order of ``cap * size / weight``, those that are
    capped come first, so running sums find them without iterating.
    """
    table = F.array(*[F.lit(int(w)) for w in weights])
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sizes = sizes.withColumn("weight", F.get(table, (F.row_number().over(by_name) - 1) % len(weights)))

    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    prior = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    most = cap * F.col("source_size")
    staged = sizes.select(
        "source",
        "source_size",
        "weight",
        most.alias("most"),
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum(most).over(prior), F.lit(0)).alias("filled"),
        F.sum("weight").over(rest).alias("open_weight"),
    )
    capped = F.col("most") * F.col("open_weight") <= F.col("weight") * (F.col("total") - F.col("filled"))
    staged = staged.withColumn("capped", capped)
    closed = F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    level = (F.col("total") - closed).cast("double") / F.nullif(open_weight, F.lit(0))
    return staged.select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("weight") * level).alias("target"),
    )


def hash_thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, threshold``: rows with ``h < threshold`` sum to about the source's ``budget``.

    ``rows`` has ``source, size, h`` and ``budgets`` has ``source, budget``. The row at which the
    budget ends is taken if that brings the sum nearer to it. Sources with no budget get 0.
    """
    state = settle(
        budgets.select("source", F.col("budget").cast("double").alias("left"), F.lit(0).cast("long").alias("prefix")).filter("left > 0"),
        "mix-budgets",
        files=1,
    )
    done = 0
    while done < HASH_BITS:
        shift = HASH_BITS - done - LEVEL_BITS
        inside = F.lit(True) if done == 0 else F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")
        held = rows.join(state, rows["source"].eqNullSafe(state["source"])).filter(inside)
        sums = held.groupBy(state["source"], "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(running))
        # The budget ends in the first bucket that reaches it.
        ends = sums.filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("words") < F.col("left")))
        left = F.col("left") - (F.col("upto") - F.col("words"))
        state = settle(ends.select("source", left.alias("left"), F.col("bucket").alias("prefix"), "words"), "mix-boundary", files=1)
        done += LEVEL_BITS
    nearer = (2 * F.col("left") >= F.col("words")).cast("long")
    return state.select("source", (F.col("prefix") + nearer).alias("threshold"))


def mixture_plan(rows: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """One row a source, ``of, source_size, target, whole, threshold``, from rows of ``sized_rows``.

    A row of the source is taken ``whole`` times, and once more if its hash is below ``threshold``.
    """
    targets = settle(source_targets(rows, weights, cap), "mix-targets", files=1)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    targets = targets.withColumn("whole", whole)
    budget = F.when(F.col("whole") < cap, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)
    limits = hash_thresholds(rows, targets.select("source", budget.alias("budget")))
    plan = targets.join(limits.withColumnRenamed("source", "limited"), F.col("source").eqNullSafe(F.col("limited")), "left").select(
        F.col("source").alias("of"), "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold")
    )
    return settle(plan, "mix-plan", files=1)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int],
    cap: int = 3,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often the mixture takes each row.

    Returns ``id, h, size, source_size, target, times``; the mixture takes ``times * size`` words of
    the row. Every row is taken ``floor(target / source_size)`` times, and those below the source's
    hash threshold once more, never over ``cap`` times. Null texts have no words; a null source is
    a source of its own; rows with equal ids are taken together; texts of any length are counted
    whole; a source without words has target 0. An empty table gives no rows, and other columns are ignored.
    """
    rows = settle(sized_rows(docs, seed, id_col, text_col, source_col), "mix-rows")
    plan = mixture_plan(rows, weights, cap)
    times = F.col("whole") + (F.col("h") < F.col("threshold")).cast("int")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "id", "h", "size", "source_size", "target", times.alias("times")
    )


def mixed_rows(
    docs: DataFrame,
    weights: Sequence[int],
    cap: int = 3,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixture itself: each row of ``docs``, with all its columns, as often as it is taken.

    The row's own hash and its source's plan decide, so documents are filtered where they are read.
    """
    rows = settle(sized_rows(docs, seed, id_col, text_col, source_col), "mix-rows")
    plan = mixture_plan(rows, weights, cap).select(*[F.col(c).alias(f"__{c}") for c in ("of", "whole", "threshold")])
    times = F.col("__whole") + (draw(docs[id_col], docs[text_col], seed) < F.col("__threshold")).cast("int")
    taken = docs.join(plan, docs[source_col].eqNullSafe(plan["__of"])).withColumn("__times", times).filter("__times > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[docs[c] for c in docs.columns])
