"""SimHash near-duplicates with a generalised pigeonhole search.

Fingerprints of 64 bits are linked at ``radius`` or fewer differing bits. Bits are grouped into
partitions by their correlation over all fingerprints. Partition ``i`` gets a threshold ``T_i >= -1``
with ``sum(T_i) = radius - partitions + 1``: two fingerprints within ``radius`` then differ by at
most ``T_i`` bits in some partition (-1: not probed). A dynamic programme picks the thresholds that
minimise the estimated candidates and probes. Every fingerprint is indexed by its partition values,
probes those within ``T_i`` and verifies the candidates, so no link is lost.

Equal fingerprints are one node. Buckets in which probes meet many members are compared in blocks
of bounded size, and a block returns a spanning forest of its links, not the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.batches import text_batches
from loomgrid.operators.components import connected_components, forest
from loomgrid.scratch import discard, settle, settle_measured

BITS = 64
SEED = 42
FOLD_BITS = 12
LANE = 255
#: Shingles of the leaders that a round compares with a component.
HEAD_SHINGLES = 250_000
#: Documents of a component that are compared with a round's leaders in one piece.
LOT = 128
#: Leaders of a group in the rounds that go before its pairs.
ROUNDS = (2, 32)
#: Rows whose shingles a worker holds at once.
SLICE = 256
#: Common shingles are looked for in one of so many texts; at most so many are told apart. They only order prefixes.
COMMON_PART = 16
MOST_COMMON = 500_000


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of every word shingle in order, repeats included.

    A-Z is lower-cased; words are runs of anything but ASCII white space. Fewer words than ``width``
    are one shingle; no words have none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return [digest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the word shingles of one text, as a signed 64-bit integer.

    A bit is set if it is set in over half of the shingles' hashes; no words give 0.
    """
    return majority(np.array(shingle_hashes(text, width), dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), LANE * 256):
        block = hashes[at : at + LANE * 256]
        bits = np.zeros((-(-len(block) // LANE) * LANE, BITS), dtype=np.uint8)
        bits[: len(block)] = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # At most LANE ones meet in a byte before they are widened.
        counts += np.add.reduce(bits.reshape(-1, LANE, BITS), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id, fp`` for every row, from its whole text."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.int64())], schema=schema)

    wanted = text_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return wanted.mapInArrow(mark, "id long, fp long")


def bit_correlation(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """Absolute correlation of the bits over all fingerprints, and their number; the driver gets 64 x 64 sums."""
    schema = pa.schema([("sums", pa.list_(pa.float64()))])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            values = batch.column(0).to_numpy().astype("<i8")
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            bits = np.column_stack([bits, np.ones(len(bits))])
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], schema=schema)

    rows = nodes.select("fp").mapInArrow(moments, "sums array<double>").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    sums = np.zeros((BITS + 1) ** 2)
    for r in rows:
        sums[r["pos"]] = r["s"]
    sums = sums.reshape(BITS + 1, BITS + 1)
    n = max(1.0, sums[BITS, BITS])
    number = int(sums[BITS, BITS])
    mean = sums[:BITS, BITS] / n
    cov = sums[:BITS, :BITS] / n - np.outer(mean, mean)
    spread = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    return np.abs(cov / np.outer(spread, spread)), number


def group_bits(correlation: np.ndarray, partitions: int) -> list[list[int]]:
    """Bits in ``partitions`` groups of even size, correlated bits together."""
    free, groups = set(range(BITS)), []
    for k in range(partitions):
        size = BITS // partitions + (k < BITS % partitions)
        order = sorted(free)
        first = max(order, key=lambda b: (correlation[b, order].sum(), -b))
        group = [first]
        free.remove(first)
        while len(group) < size:
            rest = sorted(free)
            nearest = max(rest, key=lambda b: (correlation[b, group].sum(), -b))
            group.append(nearest)
            free.remove(nearest)
        groups.append(group)
    return groups


def allocate(costs: list[list[float]], radius: int) -> list[int]:
    """Thresholds of least total cost with ``sum = radius - len(costs) + 1``; ``costs[i][t + 1]`` is for t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, picks) in best.items():
            for k, more in enumerate(row):
                if spent + k <= radius + 1 and (spent + k not in step or cost + more < step[spent + k][0]):
                    step[spent + k] = (cost + more, [*picks, k - 1])
        best = step
    return best[radius + 1][1]


def ball(width: int, t: int) -> int:
    return sum(comb(width, j) for j in range(t + 1)) if t >= 0 else 0


#: A probe is shuffled, a candidate only compared; their costs differ about so much.
PROBE_COST = 20.0


def costs_from_histogram(counts: np.ndarray, width: int, radius: int) -> list[float]:
    """Estimated probes plus ordered candidate pairs for thresholds -1 to ``radius``.

    ``counts`` are members by the partition's first ``FOLD_BITS`` bits. A Walsh-Hadamard transform
    gives the pairs at each distance in these bits; the other bits are taken as even.
    """
    spectrum, h = counts.astype(float), 1
    while h < len(spectrum):
        pair = spectrum.reshape(-1, 2, h)
        spectrum = np.stack([pair[:, 0] + pair[:, 1], pair[:, 0] - pair[:, 1]], axis=1).ravel()
        h *= 2
    pairs = spectrum**2
    h = 1
    while h < len(pairs):
        two = pairs.reshape(-1, 2, h)
        pairs = np.stack([two[:, 0] + two[:, 1], two[:, 0] - two[:, 1]], axis=1).ravel()
        h *= 2
    pairs = pairs / len(counts)
    folded = int(np.log2(len(counts)))
    distance = np.bitwise_count(np.arange(len(counts), dtype=np.uint64))
    at = np.array([pairs[distance == d].sum() for d in range(folded + 1)])
    rest = width - folded
    out = [0.0]
    for t in range(radius + 1):
        near = sum(at[d] * ball(rest, t - d) for d in range(min(t, folded) + 1)) / 2.0**rest
        out.append(near + PROBE_COST * counts.sum() * ball(width, t))
    return out


def partition_value(fp: Column, bits: list[int]) -> Column:
    """The partition's bits of a fingerprint, the first as the highest."""
    value = F.lit(0).cast("long")
    for place, bit in enumerate(bits):
        value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, bit).bitwiseAND(F.lit(1).cast("long")), len(bits) - 1 - place))
    return value


def masks(width: int, t: int) -> list[int]:
    """All bit patterns of ``width`` bits with at most ``t`` ones."""
    found = layer = [0]
    for _ in range(t):
        layer = sorted({m | 1 << b for m in layer for b in range(width) if not m >> b & 1})
        found = found + layer
    return found


def search_plan(nodes: DataFrame, radius: int) -> tuple[list[list[int]], list[int], int]:
    """Bit groups and thresholds, from statistics of all fingerprints, and the number of these."""
    correlation, n = bit_correlation(nodes)
    if n < 2:
        return group_bits(np.eye(BITS), 4), allocate([[0.0] * (radius + 2)] * 4, radius), n

    def even_cost(m: int) -> float:
        w = BITS // m
        row = [0.0] + [n * ball(w, t) * (PROBE_COST + n / 2.0**w) for t in range(radius + 1)]
        return sum(row[t + 1] for t in allocate([row] * m, radius))

    # Partitions of at least FOLD_BITS bits.
    m = min(range(2, min(radius + 1, BITS // FOLD_BITS) + 1), key=even_cost)
    groups = group_bits(correlation, m)
    folds = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftright(partition_value(F.col("fp"), g), len(g) - FOLD_BITS).cast("int").alias("v")) for i, g in enumerate(groups)])
    seen = nodes.select(F.explode(folds).alias("f")).groupBy("f.i", "f.v").agg(F.count(F.lit(1)).alias("n")).collect()
    tables = np.zeros((m, 2**FOLD_BITS))
    for r in seen:
        tables[r["i"], r["v"]] = r["n"]
    return groups, allocate([costs_from_histogram(tables[i], len(g), radius) for i, g in enumerate(groups)], radius), n


def _forest(radius: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def compare(block: pd.DataFrame) -> pd.DataFrame:
        """Links between probes and members of one block, as a star on each component's smallest."""
        members = np.unique(block.loc[~block["probe"], "fp"].to_numpy())
        probes = np.unique(block.loc[block["probe"], "fp"].to_numpy())
        if not len(members) or not len(probes):
            return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
        near = np.empty((len(probes), len(members)), dtype=bool)
        for at in range(0, len(probes), 256):
            near[at : at + 256] = np.bitwise_count((probes[at : at + 256, None] ^ members[None, :]).view(np.uint64)) <= radius
        top = np.iinfo(np.int64).max
        by_probe, by_member = probes.copy(), members.copy()
        while True:
            pull = np.array([min(top, by_member[row].min(initial=top)) for row in near])
            now_probe = np.minimum(by_probe, pull)
            push = np.array([min(top, now_probe[column].min(initial=top)) for column in near.T])
            now_member = np.minimum(by_member, push)
            if (now_probe == by_probe).all() and (now_member == by_member).all():
                break
            by_probe, by_member = now_probe, now_member
        linked = pd.DataFrame({"u": np.concatenate([by_probe, by_member]), "v": np.concatenate([probes, members])})
        return linked[linked["u"] != linked["v"]].drop_duplicates()

    return compare


def chained(index: DataFrame, radius: int) -> DataFrame:
    """``u, v``: forests of the links between neighbours in the order of each bucket that are within ``radius``.

    The order is by the fingerprint, rotated differently for each partition. This joins most of a
    group of near copies without looking at its pairs. Rows are dealt by ranges of the order, so a bucket
    may lie in several tasks; neighbours across a border are left to the search that follows.
    """
    turned = F.col("fp")
    for part in range(1, 5):
        turn = 13 * part
        turned = F.when(F.col("part") == part, F.shiftleft(F.col("fp"), turn).bitwiseOR(F.shiftrightunsigned(F.col("fp"), BITS - turn))).otherwise(turned)
    order = ["part", "value", "turned"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, value, fp = (batch.column(k).to_numpy() for k in range(3))
            near = (part[1:] == part[:-1]) & (value[1:] == value[:-1]) & (np.bitwise_count((fp[1:] ^ fp[:-1]).view(np.uint64)) <= radius)
            node, root = forest(fp[1:][near], fp[:-1][near])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["u", "v"])

    places = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.withColumn("turned", turned).repartitionByRange(places, *order).sortWithinPartitions(*order)
    return dealt.select("part", "value", "fp").mapInArrow(link, "u long, v long")


def fingerprint_links(nodes: DataFrame, radius: int, block: int = 1024, crowd: int | None = None) -> DataFrame:
    """Edges ``u, v`` whose components are those of all pairs of fingerprints within ``radius``.

    ``nodes`` has distinct ``fp``. Neighbours in the buckets are linked first; after that only links between
    different components of these are looked for. A bucket with more than ``crowd`` members (by default
    a few times the mean) is cut into blocks of about ``block`` by ``block``, which are compared whole;
    the others are joined.
    """
    groups, thresholds, n = search_plan(nodes, radius)
    used = [(i, g, t) for i, (g, t) in enumerate(zip(groups, thresholds)) if t >= 0]
    fp, key = F.col("fp"), ["part", "value"]
    where = F.array(*[F.struct(F.lit(i).alias("part"), partition_value(fp, g).alias("value")) for i, g, _ in used])
    first = settle(chained(nodes.select("fp", F.explode(where).alias("at")).select("fp", "at.part", "at.value"), radius), "chained")
    known = connected_components(first).select(F.col("node").alias("fp"), F.col("root").alias("comp"))
    nodes = settle(nodes.select("fp").join(known, "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp")), "chained-nodes")

    def reach(i: int, bits: list[int], t: int) -> Column:
        near = F.split(F.lit(",".join(map(str, masks(len(bits), t)))), ",").cast("array<bigint>")
        return F.transform(near, lambda m: F.struct(F.lit(i).alias("part"), partition_value(fp, bits).bitwiseXOR(m).alias("value")))

    index = nodes.select("fp", "comp", F.explode(where).alias("at")).select("fp", "comp", "at.part", "at.value")
    probes = nodes.select("fp", "comp", F.explode(F.concat(*[reach(*u) for u in used])).alias("at")).select("fp", "comp", "at.part", "at.value")
    most = F.lit(0)
    for i, g, _ in used:
        most = F.when(F.col("part") == i, crowd if crowd is not None else 8 + 4 * n // 2 ** len(g)).otherwise(most)
    hot = index.groupBy(key).agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > most)
    asks = probes.join(hot, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("asks"))
    hot = hot.join(asks, key).select(*key, F.ceil(F.col("members") / block).cast("int").alias("m_blocks"), F.ceil(F.col("asks") / block).cast("int").alias("a_blocks"))
    hot = settle(hot, "hot-buckets", files=4)

    a, b = probes.join(hot, key, "left_anti"), index.join(hot, key, "left_anti").withColumnsRenamed({"fp": "other", "comp": "other_comp"})
    close = (F.col("fp") < F.col("other")) & (F.col("comp") != F.col("other_comp")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)
    links = a.join(b, key).filter(close).select(F.col("fp").alias("u"), F.col("other").alias("v"))

    lot = lambda blocks: F.pmod(F.xxhash64("fp"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    members = index.join(hot, key).select(*key, lot("m_blocks").alias("m"), every("a_blocks").alias("a"), "fp", F.lit(False).alias("probe"))
    askers = probes.join(hot, key).select(*key, every("m_blocks").alias("m"), lot("a_blocks").alias("a"), "fp", F.lit(True).alias("probe"))
    crowded = members.unionByName(askers).groupBy("part", "value", "m", "a").applyInPandas(_forest(radius), "u long, v long")
    return known.select(F.col("fp").alias("u"), F.col("comp").alias("v")).unionByName(links).unionByName(crowded).distinct()


def fingerprint_roots(marks: DataFrame, radius: int) -> DataFrame:
    """``fp, least, root``: each fingerprint of ``marks`` (``id, fp``), its smallest id and its component."""
    nodes = settle(marks.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-nodes")
    roots = connected_components(fingerprint_links(nodes, radius))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return settle(placed, "fingerprint-roots")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4
) -> DataFrame:
    """``id, fp, component_id`` for every row: near-duplicates share the smallest id reachable.

    Links are pairs of fingerprints that differ by ``radius`` bits at most; components are closed
    under links. Texts of any length are read whole. Null and empty texts have fingerprint 0 and are
    linked like any other. Rows without an id belong to components but never name them; a component of
    such rows only has a null id. Repeated rows share a component. An empty table gives no rows; other
    columns are ignored.
    """
    marks = settle(fingerprints(docs, id_col, text_col, width), "fingerprints")
    placed = fingerprint_roots(marks, radius)
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks.join(placed.join(names, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def word_marks(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word in order; A-Z is lower-cased, words are runs of anything but ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], dtype="<u8")


def word_shingles(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes that stand for the shingles of the words in order, repeats included; fewer words are one."""
    if not len(words):
        return words
    width, turn = min(width, len(words)), np.uint64(0x9E3779B97F4A7C15)
    mixed = np.full(len(words) - width + 1, width, dtype="<u8")
    for k in range(width):
        mixed = (mixed ^ words[k : len(words) - width + 1 + k]) * turn
        mixed ^= mixed >> np.uint64(29)
    return mixed


def parities(bag: np.ndarray) -> np.ndarray:
    """Parity of the hashes of ``bag`` in each of ``2**k`` slots, at least one a hash, packed into 64-bit words.

    The parities of two bags differ in no more slots than the bags differ in hashes. Halves XORed are
    the parities in half as many slots.
    """
    slots = max(BITS, 1 << max(0, len(bag) - 1).bit_length())
    odd = np.bincount((bag & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """The most frequent shingles of a sample of the distinct texts, from the rarest to the commonest."""
    some = texts.withColumn("t", F.xxhash64("text")).filter(F.pmod("t", F.lit(COMMON_PART)) == 0).dropDuplicates(["t"]).select("text")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                bags = [np.unique(word_shingles(word_marks(t.as_py()), width)) for t in batch.column(0).slice(at, SLICE)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bags).view("<i8"), pa.int64())], names=["h"])

    counts = text_batches(some).mapInArrow(spread, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    top = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").toArrow()
    return top.column("h").to_numpy().astype("<i8").view("<u8")[::-1]


def shingle_marks(texts: DataFrame, width: int, level: float, probe_width: int, common: np.ndarray) -> DataFrame:
    """``id, probe, fp, bag, n, prefix, parity`` from ``id, probe, text``, in one pass over the texts.

    ``fp`` is the SimHash of shingles of ``probe_width`` words; ``bag`` is a 128-bit hash of the ``n`` distinct
    shingles of ``width``. These are ordered by hash, those of ``common`` after all others, and ``prefix`` has
    so many first ones that a text as similar as ``level`` cannot miss all. The order only decides how many
    pairs are looked at, not which similar ones are found.
    """
    order = np.argsort(common)
    keys, ranks = common[order], (order + 1).astype(np.int32)
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["id", "probe", "fp", "bag", "n", "prefix", "parity"]

    def cut(text: str | None) -> tuple[int, bytes, int, np.ndarray, np.ndarray]:
        words = word_marks(text)
        bag = np.unique(word_shingles(words, width))
        n, first = len(bag), bag
        if len(keys) and n:
            at = np.minimum(np.searchsorted(keys, bag), len(keys) - 1)
            first = bag[np.argsort(np.where(keys[at] == bag, ranks[at], 0), kind="stable")]
        fp = majority(word_shingles(words, probe_width))
        return fp, xxhash.xxh3_128_digest(bag.tobytes()), n, first[: n - ceil(level * n) + bool(n)].view("<i8"), parities(bag)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [cut(t.as_py()) for t in batch.column(2)]
            columns = [pa.array([c[k] for c in got], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return text_batches(texts).select("id", "probe", "text").mapInArrow(
        mark, "id long, probe long, fp long, bag binary, n int, prefix array<long>, parity array<long>"
    )


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """``id, probe, grp, no, shingles`` from ``id, probe, grp, no, text``: the distinct shingles of each text."""
    schema = pa.schema([("id", pa.int64()), ("probe", pa.int64()), ("grp", pa.int64()), ("no", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                sets = [np.unique(word_shingles(word_marks(t.as_py()), width)).view("<i8") for t in batch.column(4)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    return text_batches(texts).select("id", "probe", "grp", "no", "text").mapInArrow(collect, "id long, probe long, grp long, no long, shingles array<long>")


def postings(bags: DataFrame) -> DataFrame:
    """``h, no, grp, place`` of every prefix; ``place`` packs the number of shingles and the position."""
    places = bags.select("no", "grp", "n", F.posexplode("prefix").alias("pos", "h"))
    return places.select("h", "no", "grp", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("place"))


def sharing_pairs(posted: DataFrame, bags: DataFrame, level: float, within: bool) -> DataFrame:
    """``a_no, a_grp, b_no, b_grp``: bags that may be as similar as ``level``, from ``h, no, grp, place``.

    Two bags as alike as that, with ``n`` and ``m`` shingles, share at least ``least = s / (1 + s) * (n + m)``,
    hence one among the first ``n - least + 1`` of one and ``m - least + 1`` of the other in any common
    order. Pairs that share one are kept if their parities differ in ``n + m - 2 * least`` slots at most.
    Both bounds are exact, so no pair is missed. Pairs of the same group only (``within``), or of different ones.
    """
    parts = {"no": F.col("no"), "grp": F.col("grp"), "n": F.shiftright("place", 32), "pos": F.col("place").bitwiseAND(F.lit((1 << 32) - 1).cast("long"))}
    a = posted.select("h", *[v.alias(f"a_{c}") for c, v in parts.items()])
    b = posted.select("h", *[v.alias(f"b_{c}") for c, v in parts.items()])
    least = F.ceil(F.lit(level / (1 + level)) * (F.col("a_n") + F.col("b_n")))
    tie = F.col("a_no") < F.col("b_no") if within else F.col("a_grp") < F.col("b_grp")
    above = (F.col("a_n") < F.col("b_n")) | (F.col("a_n") == F.col("b_n")) & tie
    same = F.col("a_grp") == F.col("b_grp")
    may = (same if within else ~same) & above & (F.col("a_n") >= level * F.col("b_n"))
    may = may & (F.col("a_pos") <= F.col("a_n") - least) & (F.col("b_pos") <= F.col("b_n") - least)
    pairs = a.join(b, "h").filter(may).select("a_no", "a_grp", "b_no", "b_grp", (F.col("a_n") + F.col("b_n") - 2 * least).alias("most")).distinct()
    pairs = settle(pairs, "near-pairs")

    half = (F.size("q") / 2).cast("int")
    folded = F.zip_with(F.slice("q", F.lit(1), half), F.slice("q", half + 1, half), lambda x, y: x.bitwiseXOR(y))
    apart = F.aggregate(F.zip_with("p", "q", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    pairs = pairs.join(bags.select(F.col("no").alias("a_no"), F.col("parity").alias("p")), "a_no")
    pairs = pairs.join(bags.select(F.col("no").alias("b_no"), F.col("parity").alias("q")), "b_no")
    # The larger text has as many slots or, since sizes differ by a quarter at most, twice or four times as many.
    for _ in range(max(1, ceil(-np.log2(level)))):
        pairs = pairs.withColumn("q", F.when(F.size("q") > F.size("p"), folded).otherwise(F.col("q")))
    return pairs.filter(apart <= F.col("most")).select("a_no", "a_grp", "b_no", "b_grp")


def similar(a: Column, b: Column, level: float) -> Column:
    """Whether two sets are as similar as ``level``; two empty ones are. None exceeds the ratio of the sizes, which is looked at first."""
    fits = (F.size(a) >= level * F.size(b)) & (F.size(b) >= level * F.size(a))
    return F.when(fits, F.size(F.array_intersect(a, b)) * (1 + level) >= level * (F.size(a) + F.size(b))).otherwise(False)


def lead_round(left: DataFrame, some: int, level: float) -> DataFrame:
    """``left`` (``row, grp, no, shingles``) with ``leader``: the first of the group's leaders that each is similar to.

    Leaders are among the ``some`` smallest rows of a group, as many as fit ``HEAD_SHINGLES``, but one at
    least: each of these that is not similar to one before. A large group is compared in lots, each with
    a copy of the leaders.
    """

    def lead(held: Column, c: Column) -> Column:
        return F.when(F.exists(held, lambda h: similar(h["shingles"], c["shingles"], level)), held).otherwise(F.concat(held, F.array(c)))

    by_row = Window.partitionBy("grp").orderBy("row")
    least = left.select("grp", "row", F.size("shingles").alias("n")).withColumn("place", F.row_number().over(by_row)).filter(F.col("place") <= some)
    least = least.withColumn("upto", F.sum("n").over(by_row)).filter((F.col("place") == 1) | (F.col("upto") <= HEAD_SHINGLES))
    heads = left.join(least.select("grp", "row"), ["grp", "row"]).groupBy("grp")
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("row", "shingles"))).alias("heads"))
    lots = left.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias("lots"))
    empty = F.array().cast("array<struct<row:struct<id:bigint,probe:bigint>,shingles:array<bigint>>>")
    heads = heads.select("grp", F.aggregate("heads", empty, lead).alias("heads")).join(lots, "grp")
    heads = heads.select("grp", "heads", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    dealt = left.join(lots, "grp").select("row", "grp", "no", "shingles", F.pmod(F.xxhash64("row"), F.col("lots")).cast("int").alias("lot"))
    # The work is in comparing, not in bytes, so these partitions must not be merged for being small.
    dealt = dealt.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grp", "lot")
    first = F.get(F.filter("heads", lambda h: similar(F.col("shingles"), h["shingles"], level)), F.lit(0))["row"]
    return dealt.join(heads, ["grp", "lot"]).select("row", "grp", "no", "shingles", first.alias("leader"))


def pair_leaders(left: DataFrame, bags: DataFrame, level: float) -> DataFrame:
    """``row, leader`` of the rows of ``left`` that go, by the similar pairs within each group.

    A row leads if no smaller row that it is similar to leads; the others go. Decided in rounds over the
    pairs that are still open: a row without a smaller open neighbour leads, and its neighbours go.
    """
    posted = postings(left.select("grp", "no").join(bags.select("no", "n", "prefix"), "no"))
    pairs = sharing_pairs(posted, bags, level, within=True)
    side = lambda k: left.select(F.col("grp").alias("a_grp"), F.col("no").alias(f"{k}_no"), F.col("row").alias(f"{k}_row"), F.col("shingles").alias(f"{k}_set"))
    alike = pairs.drop("b_grp").join(side("a"), ["a_grp", "a_no"]).join(side("b"), ["a_grp", "b_no"]).filter(similar(F.col("a_set"), F.col("b_set"), level))
    open_, seen = settle_measured(alike.select(F.least("a_row", "b_row").alias("u"), F.greatest("a_row", "b_row").alias("v")), "near-edges", n=F.count(F.lit(1)))
    gone = open_.select(F.col("v").alias("row"), F.col("u").alias("leader")).limit(0)
    while seen["n"]:
        first = open_.select("u").distinct().join(open_.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
        lost = open_.join(first, "u").groupBy("v").agg(F.min("u").alias("leader"))
        judged = open_.join(lost, "v", "left").join(lost.select(F.col("v").alias("u"), F.lit(True).alias("out")), "u", "left")
        stays_open = F.col("leader").isNull() & F.col("out").isNull()
        judged, seen = settle_measured(judged.select("u", "v", "leader", stays_open.alias("open")), "near-edges", n=F.count_if("open"))
        gone = gone.unionByName(judged.filter("leader is not null").select(F.col("v").alias("row"), "leader"))
        open_ = judged.filter("open").select("u", "v")
    return gone.distinct()


def duplicate_rows(
    docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, probe_width: int, radius: int
) -> tuple[DataFrame, DataFrame, bool]:
    """``row`` of all distinct rows with an id, ``row, leader`` of those that go, and whether whole rows repeat.

    ``row`` is the id with a hash of the text, so texts that share an id are judged apart. Copies of a
    bag of shingles follow its smallest row, and only these are compared:

    1. SimHash components at a wide ``radius``, with shingles of ``probe_width`` words, which an edit changes less,
       group most near copies; groups that may hold two texts as similar are merged by ``sharing_pairs``.
    2. Two rounds of leaders empty the groups in which many are similar to a few, without looking at their pairs.
    3. What is left is decided by the similar pairs themselves (``pair_leaders``).

    In effect rows are taken by id, and each goes that is similar to one that stays before it.
    """
    level = similarity - 1e-9
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("probe"), text.alias("text")).filter("id is not null")
    marks, seen = settle_measured(shingle_marks(texts, width, level, probe_width, common_shingles(texts, width)), "near-marks", n=F.count(F.lit(1)))
    roots = fingerprint_roots(marks.select("id", "fp"), radius).select("fp", F.col("root").alias("grp"))
    found = marks.select("id", "probe", "fp", "bag", "n").join(roots, "fp").select(F.struct("id", "probe").alias("row"), "bag", "grp").distinct()
    found, distinct = settle_measured(found, "near-found", n=F.count(F.lit(1)))
    # A bag stands in the least of its groups; others that it is in are linked with that one.
    least = found.groupBy("bag").agg(F.min("grp").alias("grp"), F.min("row").alias("row"))
    ties = found.select("bag", F.col("grp").alias("v")).distinct().join(least, "bag").filter("v <> grp").select(F.col("grp").alias("u"), "v")
    bags = marks.groupBy("bag").agg(*[F.first(c).alias(c) for c in ("n", "prefix", "parity")]).join(least, "bag")
    bags = settle(bags.withColumn("no", F.monotonically_increasing_id()), "near-bags")

    live = bags.select("grp", F.explode("prefix").alias("h")).groupBy("h").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("lo <> hi").select("h")
    posted = settle(postings(bags).join(live, "h"), "near-postings")
    links = sharing_pairs(posted, bags, level, within=False).select(F.col("a_grp").alias("u"), F.col("b_grp").alias("v"))
    merged = connected_components(links.unionByName(ties).distinct()).withColumnRenamed("node", "grp")
    discard(marks, posted)
    reps = settle(bags.select("bag", "no", "row", "grp").join(merged, "grp", "left").select("bag", "no", "row", F.coalesce("root", "grp").alias("grp")), "near-reps")

    many = reps.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("grp")
    wanted = reps.join(many, "grp").select("row.id", "row.probe", "grp", "no")
    # Texts are shuffled at any size, so that a run on a sample shows what a large one costs.
    sets = shingle_sets(texts.hint("merge").join(wanted, ["id", "probe"]), width)
    whole = settle(sets.dropDuplicates(["id", "probe"]) if seen["n"] > distinct["n"] else sets, "near-sets")
    left = whole.select(F.struct("id", "probe").alias("row"), "grp", "no", "shingles")
    verdicts = []
    for some in ROUNDS:
        judged = lead_round(left, some, level)
        judged = settle(judged.select("row", "grp", "no", "leader", F.when(F.col("leader").isNull() | (F.col("leader") == F.col("row")), F.col("shingles")).alias("shingles")), "near-round")
        verdicts.append(judged.filter("leader <> row").select("row", "leader"))
        if len(verdicts) == 1:
            discard(whole)
        left = judged.filter("leader is null").select("row", "grp", "no", "shingles")
    verdicts.append(pair_leaders(left, bags, level))
    ruled = verdicts[0]
    for more in verdicts[1:]:
        ruled = ruled.unionByName(more)

    best = reps.select("bag", F.col("row").alias("rep")).join(ruled.withColumnRenamed("row", "rep"), "rep", "left")
    told = found.select("row", "bag").distinct().join(best, "bag").filter((F.col("row") != F.col("rep")) | F.col("leader").isNotNull())
    gone = settle(told.select("row", F.coalesce("leader", "rep").alias("leader")), "near-gone")
    discard(bags)
    return found.select("row").distinct(), gone, seen["n"] > distinct["n"]


def verified_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, probe_width: int = 3, radius: int = 8
) -> DataFrame:
    """``id, leader``: each document that may go, and a document that stays and is as similar.

    Documents are taken by id, and each goes whose Jaccard similarity of distinct shingles to one that
    stays before it is ``similarity`` or more. So everything returned is verified on whole texts of any length,
    no two that stay are as similar, and no similar pair is missed (``duplicate_rows``).

    Rows without an id are never returned. An id of several texts is a duplicate if one of them is
    and none stays. Two texts without words are equal. An empty table gives no rows; other columns are
    ignored.
    """
    found, gone, _ = duplicate_rows(docs, id_col, text_col, width, similarity, probe_width, radius)
    stays = found.join(gone.select("row"), "row", "left_anti").select("row.id").distinct()
    return gone.select("row.id", F.col("leader.id").alias("leader")).join(stays, "id", "left_anti").groupBy("id").agg(F.min("leader").alias("leader"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, probe_width: int = 3, radius: int = 8
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of the others, each is similar to one of these.

    As ``verified_duplicates``, but texts that share an id are judged apart, so that only similar texts go, whatever
    their ids. Of rows that repeat id and text, one stays. All rows without an id stay. Texts of any length are compared
    whole; an empty table gives no rows.
    """
    _, gone, repeats = duplicate_rows(docs, id_col, text_col, width, similarity, probe_width, radius)
    gone = gone.select(F.col("row.id").alias("__id"), F.col("row.probe").alias("__probe"))
    text = docs[text_col].cast("string")
    kept = docs.hint("merge").join(gone, (docs[id_col].cast("long") == gone["__id"]) & (F.xxhash64(text) == gone["__probe"]), "left_anti")
    if not repeats:
        return kept
    named, mark = kept.filter(F.col(id_col).isNotNull()).withColumn("__probe", F.xxhash64(F.col(text_col).cast("string"))), [id_col, "__probe"]
    return named.dropDuplicates(mark).drop("__probe").unionByName(kept.filter(F.col(id_col).isNull()))
