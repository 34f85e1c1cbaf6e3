"""Exact de-duplication by a tree merge of sorted digest runs (DataFrame operations only).

Every row gets a digest record. Records are dealt to ``2 ** (rounds * round_bits)`` leaf runs by a
hash of the row, so copies of one text spread over all runs. Each leaf run keeps one record for a
text; in each of the ``rounds`` rounds, ``2 ** round_bits`` sibling runs are merged, again keeping
one record with the best identifier and the number of copies below it. The answer at the root goes
back down the same tree, one narrow join a level, so a group with a third of all rows never meets
in one task: at most one record for each leaf run does.

A merge verifies equality by the SHA-256 digest, the length in bytes and an independent 64-bit
hash together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.scratch import settle

KEY = ("digest", "n_bytes", "probe")


def digest_records(docs: DataFrame, leaf_runs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow record a row: id, row number, leaf run, digest, length and second hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("probe"),
    )
    return rows.withColumn("run", F.pmod(F.xxhash64("id", "row"), F.lit(leaf_runs)).cast("int"))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    rounds: int = 2,
    round_bits: int = 5,
) -> DataFrame:
    """Groups of identical texts, one row for each input row, dropped ones included.

    Returns ``id, keep_id, group_size, kept, digest`` (digest in lowercase hex). ``keep`` names the
    row that stays: the ``smallest`` or the ``largest`` id of the group. A null text equals an
    empty one. Null ids lose to any other id; if a group has only null ids, ``keep_id`` is null.
    Repeated rows (same id and text) count each, and exactly one of them is kept. Ids of any ordered
    type will do; texts of any length are read whole. An empty table gives an empty result; other columns
    are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    records = settle(digest_records(docs, 2 ** (rounds * round_bits), id_col, text_col), "digests")

    # Null ids come after all others, whichever end is kept.
    known = F.col("id").isNotNull()
    pick = F.max if keep == "largest" else F.min
    rank: Column = F.struct((known if keep == "largest" else ~known).alias("rank"), F.col("id"), F.col("row"))
    run = (
        records.groupBy("run", *KEY)
        .agg(pick(rank).alias("best"), F.count(F.lit(1)).alias("copies"))
        .sortWithinPartitions("run", "digest")
    )
    levels = [settle(run, "runs0")]
    for level in range(1, rounds + 1):
        parent = F.shiftright("run", round_bits).alias("run")
        merged = (
            levels[-1]
            .groupBy(parent, *KEY)
            .agg(pick("best").alias("best"), F.sum("copies").alias("copies"))
            .sortWithinPartitions("run", "digest")
        )
        levels.append(settle(merged, f"runs{level}"))

    answer = levels[-1]
    for below in reversed(levels[:-1]):
        up = answer.withColumnRenamed("run", "parent")
        answer = (
            below.select("run", F.shiftright("run", round_bits).alias("parent"), *KEY)
            .join(up, ["parent", *KEY])
            .select("run", *KEY, "best", "copies")
        )
    return records.join(answer, ["run", *KEY]).select(
        "id",
        F.col("best.id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        ((F.col("row") == F.col("best.row")) & F.col("id").eqNullSafe(F.col("best.id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("digest"),
    )
