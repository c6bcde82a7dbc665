"""Quality classifier by positive-unlabelled learning (operator 3).

Texts become a few dozen bounded statistics in one pass. Trusted positives are rows labelled 1; unlabelled are rows drawn
from all web text, whatever their label. A piecewise-linear model minimises the non-negative unbiased risk
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))
with the logistic loss (Kiryo et al. 2017): where the second term falls below zero its gradient is reversed. Its sigmoid
is the score. The class prior is estimated from the positives and the unlabelled alone: negatives are never trusted.
The fit uses bounded samples of rows, whose statistics alone are computed for it; one pass then scores every whole text and
shuffles nothing.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbispan.llm.common import map_arrow, stored, texts_of

#: Bounds of the fit: rows drawn of each kind.
MAX_POSITIVES = 20_000
MAX_UNLABELLED = 40_000
THRESHOLD = 0.3

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (9, 10, 11, 12, 13, 32), "stop": (44, 46, 63), "shout": (33,), "pipe": (124,), "symbol": (35, 36, 37, 38, 42, 60, 61, 62, 64, 91, 92, 93, 94, 95, 123, 125, 126), "high": range(128, 256)}
_CLASS_OF = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _codes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_codes)] = _i
FEATURES = ["log_bytes", "log_words", *_CLASSES, "other", "word_length", "word_spread", "variety", "repeat", "top_share", "upper_words", "log_lines", "line_words", "line_variety", "line_stops", "bigram_variety"]


def text_features(text: str | None) -> list[float]:
    """Statistics of one whole text, all finite; a null or empty text has zeros."""
    if not text or text.isspace():
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    shares = np.bincount(_CLASS_OF, weights=np.bincount(raw, minlength=256), minlength=len(_CLASSES) + 1) / len(raw)
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = set(zip(words, words[1:]))
    log_n = np.log(n + 1.0)
    return [
        np.log1p(len(raw)), log_n, *shares, lengths.mean(), lengths.std(),
        np.log(len(counts) + 1.0) / log_n, sum(map(eq, words, words[1:])) / n, counts.most_common(1)[0][1] / n, sum(map(str.isupper, words)) / n,
        np.log1p(len(lines)), np.log1p(n / len(lines)), len(set(lines)) / len(lines), sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines), (len(pairs) + 1) / n,
    ]


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, x array<double>."""

    def run(batches):
        for b in batches:
            rows = [text_features(t) for _, texts in texts_of(b.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"id {kind}, x array<double>")


@dataclass
class QualityModel:
    """Hinges at quantiles of each statistic, and a weight for each hinge."""

    knots: np.ndarray  # features x knots
    scale: np.ndarray
    mean: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray, step: int = 512) -> np.ndarray:
        parts = [_sigmoid(_standard(_hinges(x[lo : lo + step], self.knots), self.mean, self.scale) @ self.weights + self.bias) for lo in range(0, len(x), step)]
        return np.concatenate(parts) if parts else np.empty(0)


def _hinges(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Each statistic, and how far it is beyond each knot."""
    beyond = np.maximum(0, x[:, :, None] - knots[None])
    return np.concatenate([x, beyond.reshape(len(x), -1)], axis=1)


def _standard(h: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((h - mean) / scale, -8, 8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(hp: np.ndarray, hu: np.ndarray, pull, bias: float, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Full-batch Adam on a linear model; pull gives the gradients by the outputs for positives and unlabelled."""
    w = np.zeros(hp.shape[1])
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        dp, du = pull(_sigmoid(hp @ w + bias), _sigmoid(hu @ w + bias))
        g = np.append(hp.T @ dp + hu.T @ du + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def _prepared(positive: np.ndarray, unlabelled: np.ndarray, knots: int):
    grid = np.quantile(unlabelled, np.linspace(0, 1, knots + 2)[1:-1], axis=0).T
    hp, hu = _hinges(positive, grid), _hinges(unlabelled, grid)
    mean, scale = hu.mean(axis=0), hu.std(axis=0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    return grid, mean, scale, _standard(hp, mean, scale), _standard(hu, mean, scale)


#: Fewest positives and unlabelled rows from which a prior is estimated.
LEAST_FOR_PRIOR = 20


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, knots: int = 7, steps: int = 200) -> float:
    """Share of positives among the unlabelled, from scores that tell the two samples apart.

    Above any score lie at least prior times as many of the unlabelled as of the positives, so the smallest ratio of the two
    tails bounds the prior from above, and meets it where no negative scores as high. Scores of one half of the rows come
    from a model of the other half; tails are widened by a standard error, and those under a fifth of the positives are
    left out as too noisy.
    """
    if min(len(positive), len(unlabelled)) < LEAST_FOR_PRIOR:
        return 0.5
    found = []
    for half in (0, 1):
        grid, mean, scale, hp, hu = _prepared(positive[half::2], unlabelled[half::2], knots)
        w, bias = _descend(hp, hu, lambda sp, su: ((sp - 1) / len(sp), su / len(su)), 0.0, steps, 0.05, 2e-3)
        score = lambda x: _standard(_hinges(x, grid), mean, scale) @ w + bias
        p, u = np.sort(score(positive[1 - half :: 2])), np.sort(score(unlabelled[1 - half :: 2]))
        cuts = np.quantile(p, np.linspace(0.0, 0.8, 81))
        above = lambda x: 1 - np.searchsorted(x, cuts, "left") / len(x)
        tp, tu = above(p), above(u)
        upper = (tu + np.sqrt(tu * (1 - tu) / len(u))) / np.maximum(1e-9, tp - np.sqrt(tp * (1 - tp) / len(p)))
        found.append(upper.min())
    return float(np.clip(np.mean(found), 0.02, 0.98))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 500, rate: float = 0.05, decay: float = 2e-3, knots: int = 7) -> QualityModel:
    """Full-batch Adam on the non-negative risk; deterministic."""
    grid, mean, scale, hp, hu = _prepared(positive, unlabelled, knots)

    def pull(sp: np.ndarray, su: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # gradients of log(1 + exp(-z)) and log(1 + exp(z)) by z
        gp_pos, gp_neg, gu_neg = (sp - 1) / len(sp), sp / len(sp), su / len(su)
        risk = np.mean(-np.log(1 - su + 1e-12)) - prior * np.mean(-np.log(1 - sp + 1e-12))
        if risk >= 0:
            return prior * (gp_pos - gp_neg), gu_neg
        return prior * gp_neg, -gu_neg  # only undo the overfitted part

    w, bias = _descend(hp, hu, pull, float(np.log(prior / (1 - prior))), steps, rate, decay)
    return QualityModel(grid, scale, mean, w, bias, prior)


def held_out(ident: str | Column) -> Column:
    """True where crc32 of the id as text leaves no remainder by 5: those labels are never learnt from."""
    return F.crc32(F.col(ident).cast("string").cast("binary")) % 5 == 0 if isinstance(ident, str) else F.crc32(ident.cast("string").cast("binary")) % 5 == 0


def _draw(rows: DataFrame, bound: int, seed: int) -> np.ndarray:
    """Statistics of at most about `bound` rows (id, text), each drawn for itself, so that copies of one row are no lump.
    A table that is laid out in the same way gives the same rows."""
    n = rows.count()
    drawn = rows.where(F.rand(seed) < bound / n) if n > bound else rows
    got = sorted(stored(with_features(drawn, "id", "text"), "fit-rows").select("x").toPandas()["x"], key=tuple)
    return np.array([list(r) for r in got], dtype=np.float64).reshape(-1, len(FEATURES))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> QualityModel:
    """Positives are the rows of docs with a label of 1 that may be learnt from; unlabelled are all rows that are not held out.

    Other labels are not used. Null labels are no labels. Without a positive, or without unlabelled rows, every text
    scores as a prior of 0.5; the estimate is kept inside 0.02 to 0.98.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    good = labels.where(~held_out(id_col) & (F.col(label_col) == 1)).select(F.col(id_col).alias("id")).distinct()
    n_good = good.count()
    if n_good > max_positives:  # ids are drawn before rows, so that a bounded list goes to the texts and no text travels
        good = good.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)) < int((1 << 40) * max_positives / n_good))
    positive = _draw(rows.join(F.broadcast(good), "id", "left_semi"), max_positives, 1)
    unlabelled = _draw(rows.where(~held_out("id")), max_unlabelled, 2)
    if not len(positive) or not len(unlabelled):
        k = len(FEATURES)
        return QualityModel(np.zeros((k, 1)), np.ones(2 * k), np.zeros(2 * k), np.zeros(2 * k), 0.0, 0.5)
    # fixed shuffle: the rows are sorted by their statistics, and the estimate takes every other one
    mixed = lambda x: x[np.random.default_rng(5).permutation(len(x))]
    return fit_nnpu(positive, unlabelled, estimate_prior(mixed(positive), mixed(unlabelled)))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **bounds) -> DataFrame:
    """id, held_out, score, predicted for every row of docs.

    Null and empty texts score as texts without statistics; rows with a null id are scored and are neither held out nor
    learnt from; repeated rows score alike; an empty table gives none; very long texts are read whole; labels, and
    columns other than the text, are never inputs of a score.
    """
    model = fit_quality(docs, labels, id_col, text_col, label_col, **bounds)

    def run(batches):
        for b in batches:
            x = np.array([text_features(t) for _, texts in texts_of(b.column(1)) for t in texts]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["id", "score"])

    scored = map_arrow(docs.select(id_col, text_col), run, f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    return scored.select("id", F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """docs without the rows scored below the threshold; every column stays and no text is shuffled.

    Null, empty and very long texts, ties, repeated rows and null ids are scored as by quality_scores, so equal texts share
    their fate; an empty table gives an empty one.
    """
    model = fit_quality(docs, labels, id_col, text_col, **bounds)

    def run(batches):
        for b in batches:
            x = np.array([text_features(t) for _, texts in texts_of(b.column(text_col)) for t in texts]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= THRESHOLD))

    return map_arrow(docs, run, docs.schema)
