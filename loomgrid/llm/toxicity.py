"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a draw from all texts is unlabelled, a share ``prior`` of it
toxic. Confirmed negatives are not used. Linear classifiers on word and word-prefix features are trained
in numpy with the class-prior-corrected risk ``R_p+ + max(0, R_u- - R_p-)`` under logistic loss (Kiryo et
al., 2017), each without another part of the sample. Their mean margin, through a logistic function, is
the score. The prior is estimated from positives and unlabelled texts (best bin estimation: the least
ratio of their shares among the texts that a classifier ranks highest), and so are slope and intercept of
the logistic function (the unlabelled texts' mean score is the prior, at the least non-negative risk), all on
margins that come from the classifiers that have not seen the text.

The fit uses at most ``max_positive`` and ``max_unlabelled`` texts, picked by a hash of the id. Scoring
reads every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomgrid.llm.batches import text_batches
from loomgrid.scratch import settle

WORD = re.compile(r"\w+")
SLOTS = 1 << 20
PREFIXES = (3, 4, 5, 6)
MEMO = 100_000
#: Rows whose features a worker holds at once.
SLICE = 256
MIN_DOCS = 3
MIN_RATIO = 2.0
MIN_POSTERIOR = 0.3
MIN_STRENGTH = 4.0


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-cased word: the word and its prefixes."""
    names = [f"={word}"] + [f"^{word[:n]}" for n in PREFIXES if len(word) >= n]
    return tuple(zlib.crc32(n.encode("utf-8", "surrogatepass")) % SLOTS for n in names)


class Featurizer:
    """Distinct features of texts, remembering the words it has seen; ``only`` restricts them."""

    def __init__(self, only: dict[int, float] | None = None):
        self.only = only
        self.memo: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> set[int]:
        words = set(WORD.findall((text or "").lower()))
        if len(self.memo) > MEMO:
            self.memo = {}
        memo, found = self.memo, set()
        for word in words:
            got = memo.get(word)
            if got is None:
                got = word_features(word)
                if self.only is not None:
                    got = tuple(f for f in got if f in self.only)
                memo[word] = got
            if got:
                found.update(got)
        return found


@dataclass
class Model:
    """Feature weights and a bias; ``weights`` holds at most ``max_features`` entries."""

    bias: float = -20.0
    weights: dict[int, float] = field(default_factory=dict)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def train_linear(
    owner: np.ndarray, slots: np.ndarray, positive: np.ndarray, n_features: int, prior: float | None, steps: int = 150, rate: float = 0.15, decay: float = 1e-3
) -> tuple[np.ndarray, float]:
    """Weights and bias of one linear classifier (full batch, Adam); row ``owner[k]`` has feature ``slots[k]``.

    Under the non-negative PU risk for ``prior``; without one, of positives against unlabelled texts, both
    sides weighing the same.
    """
    n = len(positive)
    p, u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(prior / (1 - prior)) if prior else 0.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        margin = np.bincount(owner, weights=theta[slots], minlength=n) + theta[-1]
        chance = sigmoid(margin)
        if prior is None:
            slope = np.where(positive, (chance - 1) / p, chance / u)
        else:
            as_negative = np.logaddexp(0, margin)
            risk_u = as_negative[~positive].sum() / u
            risk_p = prior * as_negative[positive].sum() / p
            slope = np.where(positive, -prior * chance / p, chance / u)
            if risk_u - risk_p < 0:
                slope = -slope
            else:
                slope = slope + np.where(positive, prior * (chance - 1) / p, 0.0)
        gradient = np.append(np.bincount(slots, weights=slope[owner], minlength=n_features), slope.sum())
        gradient[:-1] += decay * theta[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def train_ensemble(owner: np.ndarray, slots: np.ndarray, part: np.ndarray, positive: np.ndarray, n_features: int, prior: float | None) -> tuple[np.ndarray, float, np.ndarray]:
    """Mean of classifiers that each leave out a ``part`` of all rows, and each row's margin from the one that left it out."""
    classifiers = int(part.max()) + 1
    theta, bias, outside = np.zeros(n_features), 0.0, np.zeros(len(part))
    for k in range(classifiers):
        use = (part != k) | (classifiers == 1)
        held = use[owner]
        w, b = train_linear((np.cumsum(use) - 1)[owner[held]], slots[held], positive[use], n_features, prior)
        theta += w / classifiers
        bias += b / classifiers
        outside[part == k] = b + np.bincount(owner, weights=w[slots], minlength=len(part))[part == k]
    return theta, bias, outside


def class_prior(margin: np.ndarray, positive: np.ndarray, chance: float = 0.1) -> float:
    """Share of positives among the unlabelled, by best bin estimation (Garg et al., 2021).

    Whatever the margin, at least ``prior`` times the positives' share above it are positives among the
    unlabelled share above it; the bin is the one whose ratio has the least upper bound of confidence.
    """
    p, u = np.sort(margin[positive]), np.sort(margin[~positive])
    cuts = np.unique(p)
    share_p = 1 - np.searchsorted(p, cuts, "left") / len(p)
    share_u = 1 - np.searchsorted(u, cuts, "left") / len(u)
    spread = np.sqrt(np.log(4 / chance) / 2 / len(u)) + np.sqrt(np.log(4 / chance) / 2 / len(p))
    best = int(np.argmin(share_u / share_p + spread / share_p))
    return float(min(0.95, max(0.001, share_u[best] / share_p[best])))


#: Slopes that the calibration chooses from.
SLOPES = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)


def calibrate(margin: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and intercept of a logistic function of the margins.

    For a slope, the intercept makes the unlabelled texts' mean chance the prior, where the unbiased PU risk
    under logistic loss is least; of the slopes, the one with the least non-negative risk is taken.
    """
    best: list[tuple[float, float, float]] = []
    for slope in SLOPES:
        p, u, low, high = slope * margin[positive], slope * margin[~positive], -200.0, 200.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if sigmoid(u + middle).mean() > prior else (middle, high)
        p, u = p + low, u + low
        risk = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        best.append((prior * np.logaddexp(0, -p).mean() + max(0.0, float(risk)), slope, low))
    return min(best)[1:]


def held_out(id_column: Column) -> Column:
    """Rows whose crc32(id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_positive: int = 8_000,
    max_unlabelled: int = 24_000,
    max_features: int = 4_096,
    classifiers: int = 3,
) -> Model:
    """Train on positives and unlabelled texts whose ids are not held out.

    Without confirmed positives every score is near 0. Texts that share an id count each, as positives
    if the id is labelled toxic.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    toxic = known.filter(F.col("id").isNotNull() & (F.col("label") == 1) & ~held_out(F.col("id"))).select("id").distinct()
    draw = F.xxhash64(F.col("id"), F.lit(7))
    chosen = toxic.orderBy(draw, "id").limit(max_positive).select("id", F.lit(True).alias("positive"))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).filter(F.col("id").isNotNull() & ~held_out(F.col("id")))
    others = ids.orderBy(draw, "id").limit(max_unlabelled).select("id", F.lit(False).alias("positive"))
    sample = settle(chosen.unionByName(others).distinct(), "toxicity-sample", files=1)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # The sample has at most max_positive + max_unlabelled rows.
    picked = texts.join(F.broadcast(sample), "id").select("id", "positive", F.xxhash64("text").alias("probe"), "text")
    schema = pa.schema([("id", pa.int64()), ("positive", pa.bool_()), ("probe", pa.int64()), ("features", pa.list_(pa.int32()))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Featurizer()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                rows = [np.array(sorted(of(t.as_py())), dtype=np.int32) for t in batch.column(3)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(pa.int32()))], schema=schema)

    picked = settle(picked.mapInArrow(features, "id long, positive boolean, probe long, features array<int>"), "toxicity-features")
    n_pos, n_unl = picked.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).head()
    if not n_pos or not n_unl:
        return Model()
    counts = picked.select("positive", F.explode("features").alias("f")).groupBy("f").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    # Features of at least MIN_DOCS positives that are MIN_RATIO times as frequent there as among the unlabelled,
    # by MIN_STRENGTH deviations or more; a few for each positive.
    rate_p, rate_u, spread = F.col("p") / n_pos, F.col("u") / n_unl, (F.col("u") + 1) / (n_unl + 1)
    strength = (rate_p - spread) / F.sqrt(spread * (1 - spread) / n_pos + 1e-9)
    likely = (F.col("p") >= MIN_DOCS) & (rate_p >= MIN_RATIO * rate_u) & (strength >= MIN_STRENGTH)
    most = min(max_features, max(300, 3 * n_pos))
    found = counts.filter(likely).orderBy(strength.desc(), "f").limit(most).collect()
    if not found:
        return Model()
    top = spark_table(picked, {r["f"]: i for i, r in enumerate(found)})
    kept = picked.withColumn("f", F.explode_outer("features")).join(F.broadcast(top), "f", "left")
    sparse = kept.groupBy("id", "positive", "probe").agg(F.array_sort(F.collect_set("slot")).alias("slots")).orderBy("id", "positive", "probe").toArrow()
    positive = sparse.column("positive").to_numpy().astype(bool)
    lists = pa.concat_arrays(sparse.column("slots").chunks)
    owner, slots = np.repeat(np.arange(len(positive)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    # A positive text may be drawn as an unlabelled one too; both are left out together.
    part = np.unique(sparse.column("id").to_numpy(), return_inverse=True)[1] % classifiers
    *_, outside = train_ensemble(owner, slots, part, positive, len(found), None)
    prior = class_prior(outside, positive)

    # Of these, the classifiers proper use those whose estimated posterior, prior * P(feature | positive) /
    # P(feature), is MIN_POSTERIOR or more.
    good = np.array([prior * r["p"] / n_pos >= MIN_POSTERIOR * r["u"] / n_unl for r in found])
    if not good.any():
        return Model()
    held = good[slots]
    theta, bias, outside = train_ensemble(owner[held], (np.cumsum(good) - 1)[slots[held]], part, positive, int(good.sum()), prior)
    slope, more = calibrate(outside, positive, prior)
    return Model(slope * bias + more, {found[i]["f"]: slope * float(w) for i, w in zip(np.flatnonzero(good), theta) if w})


def spark_table(like: DataFrame, order: dict[int, int]) -> DataFrame:
    """``f, slot``: at most ``max_features`` rows."""
    return like.sparkSession.createDataFrame(list(order.items()), "f int, slot int")


def score(text: Column, model: Model) -> Column:
    """The score of a whole text, from 0 to 1; only the text is sent to Python, and a number comes back."""
    weights, bias = model.weights, model.bias

    @F.arrow_udf(DoubleType())
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = Featurizer(weights)
        for batch in batches:
            margins = np.array([bias + sum(sorted(weights[f] for f in of(t.as_py()))) for t in batch])
            yield pa.array(sigmoid(margins), pa.float64())

    return rate(text)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """``id, held_out, score, predicted`` for every row.

    Null texts score like empty ones, and texts of any length are read whole. Labels without an id or value are ignored; an id labelled
    twice is toxic if one label says so. Rows without an id are scored, never held out and not
    trained on. Empty tables give no rows or, for labels, scores near 0; other columns are ignored.
    """
    model = fit(text_batches(docs), labels, id_col, text_col, label_col, **options)
    rated = docs.select(F.col(id_col).cast("long").alias("id"), score(F.col(text_col), model).alias("score"))
    return rated.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns.

    Null and empty texts, repeated rows, rows without an id and empty tables as for ``toxicity``.
    """
    model = fit(text_batches(docs), labels, id_col, text_col, label_col, **options)
    return docs.filter(score(F.col(text_col), model) < threshold)
