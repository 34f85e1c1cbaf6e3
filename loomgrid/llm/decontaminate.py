"""Benchmark decontamination: SimHash of item-sized windows, then exact shingle similarity.

A benchmark item leaks into a document if some window of the document with as many words as the
item has a weighted Jaccard similarity of shingles (weights are multiplicities) of ``similarity`` or
more to it. DataFrame operations only, in three steps:

1. Windows. A window that similar shares at least ``2 s / (1 + s)`` of the item's shingles, and a best
   one starts at a shared shingle (or ends with the document). A document without any of an
   item's ``marks``, so many of its rarest shingles that a leak cannot miss all, has no leak; the
   others keep their shingle hashes in a scratch table, so that texts are read once and never
   shuffled. There, only starts at which enough hits follow within an item's size are kept.
2. SimHash. The windows' fingerprints are looked up among all items of the same size by a multi-index of six
   blocks with thresholds of two or three bits at the default radius: fingerprints within ``radius`` are within the
   threshold of some block (generalised pigeonhole). An item is filed under all values near its own, a window
   asks for its own value of each block. The candidates come from there alone.
3. Verification of every candidate by its exact similarity.

Words are lower-cased runs of letters and digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.scratch import settle

BITS = 64
#: Blocks of a fingerprint. With more of them, more pairs agree by chance; with fewer, an item has more values near its own.
BLOCKS = 6
#: Up to so many marks are a constant of the scan; more are joined with the documents' shingles.
MAX_MARKS = 20_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(text: Column, width: int) -> Column:
    """Hashes of the text's shingles of ``width`` words, in order, repeats included."""

    def of(words: Column) -> Column:
        firsts = F.slice(words, 1, F.greatest(F.size(words) - (width - 1), F.lit(0)))
        return F.transform(firsts, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, width)]))

    return let(word_hashes(text), of)


def simhash(hashes: Column) -> Column:
    """Fingerprint of an array of hashes: a bit is set if it is in over half of them."""

    def of(h: Column) -> Column:
        def add(bits: Column, b: Column) -> Column:
            ones = F.aggregate(h, F.lit(0), lambda n, x: n + F.call_function("shiftrightunsigned", x, b).bitwiseAND(F.lit(1).cast("long")).cast("int"))
            bit = F.when(2 * ones > F.size(h), F.lit(1)).otherwise(F.lit(0)).cast("long")
            return bits.bitwiseOR(F.call_function("shiftleft", bit, b))

        return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), add)

    return let(hashes, of)


def tagged(hashes: Column) -> Column:
    """A set that stands for the bag: each hash with the number of its occurrence."""
    return let(F.array_sort(hashes), lambda s: F.transform(s, lambda h, i: F.xxhash64(h, (i + 1 - F.array_position(s, h)).cast("long"))))


def cuts(radius: int) -> list[tuple[int, int, int]]:
    """``(first bit, width, threshold)`` of each block.

    The thresholds sum to ``radius - BLOCKS + 1``: fingerprints that differ by more than its threshold in every
    block differ by more than ``radius``. Wider blocks get the larger ones; below 0 a block is not looked at.
    """
    edges = [BITS * k // BLOCKS for k in range(BLOCKS + 1)]
    spread = radius - BLOCKS + 1
    order = sorted(range(BLOCKS), key=lambda k: (edges[k] - edges[k + 1], k))
    least, extra = divmod(spread, BLOCKS)
    return [(edges[k], edges[k + 1] - edges[k], least + (order.index(k) < extra)) for k in range(BLOCKS)]


def blocks(fp: Column, radius: int, near: bool) -> Column:
    """``(block, value)`` for each block of the fingerprint; with ``near``, all values within the block's threshold."""
    def filed(k: int, first: int, width: int, t: int) -> Column:
        value = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        masks = [m for m in range(1 << width) if m.bit_count() <= t] if near else [0]
        listed = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")
        return F.transform(listed, lambda m: F.struct(F.lit(k).alias("block"), value.bitwiseXOR(m).alias("value")))

    return F.concat(*[filed(k, *c) for k, c in enumerate(cuts(radius)) if c[2] >= 0])


def item_table(items: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """``item, item_id, k, n_words, bag``: shingles of each item; shorter items are one shingle."""
    words = F.size(word_hashes(F.col(text_col)))
    rows = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"), words.alias("n_words")).filter("n_words > 0")
    of = F.when(F.col("n_words") >= width, shingles(F.col("text"), width))
    for k in range(1, width):
        of = of.when(F.col("n_words") == k, shingles(F.col("text"), k))
    return rows.select(
        F.monotonically_increasing_id().alias("item"), "item_id", F.least("n_words", F.lit(width)).alias("k"), "n_words", of.alias("bag")
    )


def item_marks(known: DataFrame, similarity: float) -> DataFrame:
    """``k, h``: the rarest shingles of each item, more than a leak can miss.

    A leak misses at most ``n - similarity * n`` of an item's ``n`` shingles.
    """
    bags = known.select("item", "k", "n", F.explode("bag").alias("h")).groupBy("item", "k", "n", "h").agg(F.count(F.lit(1)).alias("times"))
    common = bags.groupBy("k", "h").agg(F.count(F.lit(1)).alias("items"))
    rare = Window.partitionBy("item").orderBy("items", "h").rowsBetween(Window.unboundedPreceding, -1)
    ranked = bags.join(common, ["k", "h"]).withColumn("before", F.coalesce(F.sum("times").over(rare), F.lit(0)))
    return ranked.filter(F.col("before") <= F.col("n") - F.ceil(similarity * F.col("n"))).select("k", "h").distinct()


def has_mark(text: Column, marks: DataFrame, sizes: list[int]) -> Column | None:
    """Whether a text has one of the marks, or None if they are too many for a constant of the scan."""
    if marks.count() > MAX_MARKS:
        return None
    found = F.lit(False)
    for k in sizes:
        hashes = [r["h"] for r in marks.filter(F.col("k") == k).collect()]
        found = found | F.arrays_overlap(shingles(text, k), F.split(F.lit(",".join(map(str, sorted(hashes)))), ",").cast("array<bigint>"))
    return found


def suspects(base: DataFrame, marks: DataFrame, sizes: list[int]) -> DataFrame:
    """``id, probe, s<k>...``: documents with a mark of an item, and their shingles of each width."""
    of = {k: shingles(F.col("text"), k) for k in sizes}
    found = has_mark(F.col("text"), marks, sizes)
    if found is None:
        keys = None
        for k in sizes:
            hit = base.select("id", "probe", F.explode(of[k]).alias("h")).join(marks.filter(F.col("k") == k).select("h"), "h", "left_semi").select("id", "probe")
            keys = hit if keys is None else keys.unionByName(hit)
        keys = settle(keys.distinct(), "suspects").select(F.col("id").alias("of"), F.col("probe").alias("mark"))
        marked = base.join(keys, F.col("id").eqNullSafe(F.col("of")) & (F.col("probe") == F.col("mark")), "left_semi")
    else:
        marked = base.filter(found)
    return marked.select("id", "probe", *[of[k].alias(f"s{k}") for k in sizes])


def leaks(
    docs: DataFrame,
    items: DataFrame,
    width: int = 5,
    similarity: float = 0.8,
    radius: int = 21,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``id, probe, item_id, similarity``: every document and item that leaks into it, best window.

    ``probe`` is a hash of the text; ``(id, probe)`` names a row of ``docs``. A document shorter than the
    item is a single window. Items with fewer than ``width`` words are one shingle, found only whole.
    Null and empty texts match nothing, on either side; null ids are kept as they are; repeated
    rows give one result. Texts of any length are read whole. Empty tables give no rows; other columns are ignored.

    At the limit of similarity, fingerprints of 64 bits differ by about 10 bits with a deviation of 3,
    so the default ``radius`` misses about one in ten thousand such windows, and fewer above it.
    """
    if not 0.5 <= similarity <= 1:
        raise ValueError("similarity must lie between 0.5 and 1")
    known = settle(item_table(items, width, item_col, item_text_col), "items", files=8)
    known = known.withColumn("n", F.size("bag"))
    sizes = [r["k"] for r in known.select("k").distinct().collect()]
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("probe"), text.alias("text")).filter("text is not null")
    most = similarity - 1e-9
    if not sizes:
        return known.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("probe"), "item_id", F.lit(0.0).alias("similarity")).limit(0)
    marks = settle(item_marks(known, most), "item-marks", files=1)
    doubtful = settle(suspects(base, marks, sizes).dropDuplicates(["id", "probe"]), "suspects")
    postings = settle(known.select("k", "n", "item", F.explode(F.array_distinct("bag")).alias("h")), "item-shingles", files=8)
    hits = None
    for k in sizes:
        places = doubtful.select("id", "probe", F.posexplode(f"s{k}").alias("pos", "h"))
        found = places.join(postings.filter(F.col("k") == k).drop("k"), "h")
        hits = found if hits is None else hits.unionByName(found)
    near = hits.groupBy("id", "probe", "item").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("pos")).alias("at"))
    near = near.filter(F.size("at") >= most * F.col("n")).drop("n").withColumnsRenamed({"id": "of", "probe": "mark"})

    pairs = near.join(doubtful, F.col("id").eqNullSafe(F.col("of")) & (F.col("probe") == F.col("mark"))).join(known.select("item", "k", "n", "n_words"), "item")
    doc = F.lit(None)
    for k in sizes:
        doc = F.when(F.col("k") == k, F.col(f"s{k}")).otherwise(doc)
    pairs = pairs.select("id", "probe", "item", "at", "k", "n", "n_words", doc.alias("doc"))
    total = F.size("doc")
    need = F.ceil(2 * most / (1 + most) * F.col("n")).cast("int")
    last = F.greatest(total - F.col("n"), F.lit(0))

    def start(p: Column, j: Column) -> Column:
        enough = (p >= last) | (F.coalesce(F.get(F.col("at"), j + need - 1), last + F.col("n")) < p + F.col("n"))
        return F.when(enough, F.least(p, last))

    starts = F.array_distinct(F.filter(F.transform(F.col("at"), start), lambda s: s.isNotNull()))
    windows = pairs.select("id", "probe", "k", "n_words", "n", "doc", F.explode(starts).alias("start"))
    windows = windows.select("id", "probe", "k", "n_words", "start", F.slice("doc", F.col("start") + 1, F.col("n")).alias("window"))
    windows = windows.dropDuplicates(["id", "probe", "k", "n_words", "start"])
    windows = settle(windows.withColumn("fp", simhash(F.col("window"))), "windows")

    marks = known.select("item", "item_id", "k", "n_words", "bag", simhash(F.col("bag")).alias("item_fp"))
    marks = settle(marks, "item-fingerprints", files=8)
    asked = windows.select("id", "probe", "k", "n_words", "start", "fp", F.explode(blocks(F.col("fp"), radius, near=False)).alias("b")).select("*", "b.*").drop("b")
    index = marks.select("item", "k", "n_words", "item_fp", F.explode(blocks(F.col("item_fp"), radius, near=True)).alias("b")).select("*", "b.*").drop("b")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    candidates = asked.join(index, ["k", "n_words", "block", "value"]).filter(close).select("id", "probe", "k", "n_words", "start", "item").distinct()

    back = windows.withColumnRenamed("id", "of").select("of", "probe", "k", "n_words", "start", "window")
    same = F.col("id").eqNullSafe(F.col("of"))
    for c in ("probe", "k", "n_words", "start"):
        same = same & (candidates[c] == back[c])
    judged = candidates.join(back, same).select("id", candidates["probe"], "item", "window").join(marks.select("item", "item_id", "bag"), "item")
    shared = F.size(F.array_intersect(tagged(F.col("window")), tagged(F.col("bag"))))
    judged = judged.select("id", "probe", "item_id", shared.alias("shared"), (F.size("window") + F.size("bag")).alias("both"))
    rated = judged.select("id", "probe", "item_id", (F.col("shared") / (F.col("both") - F.col("shared"))).alias("similarity"))
    return rated.filter(F.col("similarity") >= most).groupBy("id", "probe", "item_id").agg(F.max("similarity").alias("similarity"))


def drop_leaks(
    docs: DataFrame,
    items: DataFrame,
    width: int = 5,
    similarity: float = 0.8,
    radius: int = 21,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all their columns.

    Null and empty texts stay, repeated rows share their fate, rows without an id are judged like others, and
    an empty table of either kind drops nothing. Only documents with a mark of an item are joined with the leaks; the others are passed on.
    """
    found = leaks(docs, items, width, similarity, radius, id_col, text_col, item_col, item_text_col)
    found = settle(found.select(F.col("id").alias("__id"), F.col("probe").alias("__probe")).distinct(), "leaks")
    known = item_table(items, width, item_col, item_text_col).withColumn("n", F.size("bag"))
    sizes = [r["k"] for r in known.select("k").distinct().collect()]
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = has_mark(text, settle(item_marks(known, similarity - 1e-9), "item-marks", files=1), sizes) if sizes else F.lit(False)
    same = docs[id_col].eqNullSafe(found["__id"]) & (F.xxhash64(docs[text_col]) == found["__probe"])
    if marked is None:
        return docs.join(found, same, "left_anti")
    return docs.filter(~marked).unionByName(docs.filter(marked).join(found, same, "left_anti"))
