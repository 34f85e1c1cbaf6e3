"""Proportional stratified interleaving: every shard holds the mixture of the whole table.

Rows are ranked in a seeded shuffle within their source, sorted by fractional rank
``(rank - 1/2) / n_source`` over all sources, and the order is cut into equal pieces. Ranks never
come from one window over a source: rows are dealt to hash buckets, a window ranks within a bucket
and prefix sums over the small table of bucket counts give the rest. The second sort works alike
on buckets of the fractional rank, which are even by construction. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.scratch import settle


def stratified_shards(
    docs: DataFrame,
    shards: int,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    overhead: int = 8,
    bucket_rows: int = 50_000,
) -> DataFrame:
    """Deal rows into ``shards`` shards whose row counts differ by one at most.

    Returns ``id, source, size, text_crc32, shard, slot``; ``slot`` runs from 0 without gaps in each
    shard. ``size`` is the text's UTF-8 bytes plus ``overhead``; a null text has no bytes and the
    checksum of an empty one. A null source is a source of its own. A row without an
    id is drawn by its text. Ties of the shuffle, which only repeated ids and texts have, are broken by the text's
    checksum and size, and for like rows by position. Texts of any length are read whole. An empty table gives no rows, and
    fewer rows than shards leave shards empty; other columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(text)))
    rows = settle(
        docs.select(
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("row"),
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null")).alias("stratum"),
            (F.octet_length(text).cast("long") + overhead).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(F.concat(F.lit(f"{seed}:"), name)).alias("draw"),
        ),
        "shard-rows",
    )
    total = rows.count()
    # Even a small table gets buckets enough to spread a hot source; a large one, full buckets.
    buckets = max(1, -(-total // bucket_rows), min(1024, -(-total // 500)))

    lead = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    dealt = rows.withColumn("bucket", F.shiftright(lead * buckets, 32).cast("int"))
    counts = dealt.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("stratum")
    before = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "stratum",
        "bucket",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"),
        F.sum("n").over(whole).alias("members"),
    )
    in_bucket = Window.partitionBy("stratum", "bucket").orderBy("draw", "id", "text_crc32", "size", "row")
    ranked = dealt.join(counts, ["stratum", "bucket"]).withColumn("rank", F.col("ahead") + F.row_number().over(in_bucket))
    share = (2 * F.col("rank") - 1) / (2 * F.col("members"))
    ranked = settle(
        ranked.select("id", "source", "stratum", "size", "text_crc32", share.alias("share"), F.floor(share * buckets).cast("int").alias("piece")),
        "shard-ranks",
    )

    pieces = ranked.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    in_piece = Window.partitionBy("piece").orderBy("share", "stratum")
    place = F.col("ahead") + F.row_number().over(in_piece) - 1
    placed = ranked.join(pieces, "piece").withColumn("place", place.cast("long"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", F.expr(f"cast((place * {shards}) div {max(1, total)}L as int)"))
        .withColumn("slot", F.col("place") - first)
        .select("id", "source", "size", "text_crc32", "shard", "slot")
    )
