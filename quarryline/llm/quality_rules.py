"""Quality classifier: a sparse ensemble of rules.

Statistics of a text are Spark column expressions. Small trees, boosted on the
statistics of a bounded labelled sample, give candidate rules: each path from
the root is a conjunction of comparisons. A logistic regression with an L1
penalty keeps few of them, and the rules kept compile into one column
expression, so scoring is a scan without Python.

Fitted on at most ``TRAIN_ROWS`` pairs of an id and a label (by a hash of the id),
in order of both, so a fit does not depend on the partitioning. A label row that
repeats counts once, an id with both labels twice; of documents with one id that
with the smallest hash is read. A null text is empty and is scored as such.
Without labelled rows, with one label only, or with too few rows to split, the
score is the smoothed share of label 1. Repeated documents repeat in the scores; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import bucket_of, documents, table

TRAIN_ROWS = 12_000
N_TREES, DEPTH, N_BINS = 24, 3, 32
PENALTY = 2e-3
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a text, none of them null."""
    n = F.greatest(F.char_length(text), F.lit(1))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    n_words = F.greatest(F.size(words), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    return {
        "log_chars": F.log1p(F.char_length(text).cast("double")),
        "word_chars": n / n_words,
        "upper": share(r"\p{Lu}"),
        "digits": share("[0-9]"),
        "symbols": share(r"[#$%&*@^~+=<>\\{}\[\]_]"),
        "exclaims": share("!"),
        "bars": share(r"\|"),
        "stops": share("[.,;:?]"),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "line_words": n_words / F.greatest(F.size(lines), F.lit(1)),
    }


STATISTICS = ("log_chars", "word_chars", "upper", "digits", "symbols", "exclaims", "bars", "stops", "distinct_words", "distinct_lines", "line_words")


class Condition(NamedTuple):
    statistic: str
    above: bool  # > threshold, else <=
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, STATISTICS.index(self.statistic)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c > self.threshold if self.above else c <= self.threshold


class Rule(NamedTuple):
    conditions: tuple[Condition, ...]
    weight: float

    def column(self) -> Column:
        return F.when(reduce(lambda a, b: a & b, (c.column() for c in self.conditions)), F.lit(self.weight)).otherwise(F.lit(0.0))


class Model(NamedTuple):
    intercept: float
    rules: tuple[Rule, ...]

    def column(self) -> Column:
        """The score, over columns named as the statistics."""
        logit = reduce(lambda a, b: a + b, (r.column() for r in self.rules), F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-logit))

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.intercept)
        for r in self.rules:
            logit += r.weight * np.logical_and.reduce([c.holds(x) for c in r.conditions])
        return 1 / (1 + np.exp(-logit))


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, hessian: np.ndarray, rows: np.ndarray, path: tuple[Condition, ...], depth: int, found: list, step: np.ndarray) -> None:
    """Splits rows at the best cut; adds each path to found and each leaf's step to step."""
    total, weight = residual[rows].sum(), hessian[rows].sum()
    best, where = 1e-6, None
    if depth and len(rows) >= 20:
        for k in range(x.shape[1]):
            if not len(cuts[k]):
                continue
            g = np.bincount(bins[rows, k], residual[rows], len(cuts[k]) + 1).cumsum()[:-1]
            h = np.bincount(bins[rows, k], hessian[rows], len(cuts[k]) + 1).cumsum()[:-1]
            gain = g**2 / (h + 1) + (total - g) ** 2 / (weight - h + 1) - total**2 / (weight + 1)
            if gain[i := int(gain.argmax())] > best:
                best, where = gain[i], (k, i)
    if where is None:
        step[rows] = total / (weight + 1)
        return
    k, i = where
    for above in (False, True):
        part = rows[(bins[rows, k] > i) == above]
        if len(part):
            longer = (*path, Condition(STATISTICS[k], above, float(cuts[k][i])))
            found.append(longer)
            _grow(x, bins, cuts, residual, hessian, part, longer, depth - 1, found, step)


def candidate_rules(x: np.ndarray, y: np.ndarray) -> list[tuple[Condition, ...]]:
    """The distinct paths of boosted trees."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, N_BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    cuts = [c[c < x[:, k].max()] for k, c in enumerate(cuts)]
    bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    logit, found = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), []
    for _ in range(N_TREES):
        p = 1 / (1 + np.exp(-logit))
        step = np.zeros(len(y))
        _grow(x, bins, cuts, y - p, p * (1 - p), np.arange(len(y)), (), DEPTH, found, step)
        logit += 0.3 * np.clip(step, -4, 4)
    return list(dict.fromkeys(found))


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise the mean log loss plus penalty times the sum of absolute weights (accelerated proximal gradient)."""
    n, k = a.shape
    a = np.concatenate([a, np.ones((n, 1), a.dtype)], axis=1)
    v = np.ones(k + 1)
    for _ in range(20):  # the largest eigenvalue, for the step
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / max(float(v @ (a.T @ (a @ v))), 1e-9)
    w, z, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    for _ in range(steps):
        new = z - rate * (a.T @ (1 / (1 + np.exp(-(a @ z))) - y)) / n
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - rate * penalty, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z = new + (last - 1) / t * (new - w)
        w = new
    return float(w[k]), w[:k]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> Model:
    rules = candidate_rules(x, y) if len(y) and y.min() < y.max() else []
    if not rules:  # too few rows to split, or one label
        p = (float(y.sum()) + 1) / (len(y) + 2)
        return Model(float(np.log(p / (1 - p))), ())
    a = np.stack([np.logical_and.reduce([c.holds(x) for c in r]) for r in rules], axis=1).astype(np.float32)
    intercept, weights = lasso_logistic(a, y, penalty)
    return Model(intercept, tuple(Rule(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-4))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_ROWS) -> Model:
    """A model of the labels (1 or 0) that are not null."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("label is not null and doc_id is not null").distinct()
    share = most / max(most, marked.count())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    # At most ``most`` pairs of two numbers: the limit is proof, the share spares it work.
    sample = marked.where(place < share * 1_000_000).orderBy(place, "doc_id", "label").limit(most)
    rows = documents(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")
    numbers = rows.select("doc_id", "label", F.xxhash64("text").alias("_key"), *(c.alias(k) for k, c in statistics(F.col("text")).items()))
    one = numbers.groupBy("doc_id", "label").agg(F.min(F.struct("_key", *STATISTICS)).alias("one"))
    got = one.select("doc_id", "label", *(f"one.{k}" for k in STATISTICS)).toPandas().sort_values(["doc_id", "label"])  # at most ``most`` rows
    return fit(got[list(STATISTICS)].to_numpy(np.float64), got["label"].to_numpy(np.float64))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row."""
    numbers = documents(df, id_col, text_col).select("doc_id", *(c.alias(k) for k, c in statistics(F.col("text")).items()))
    return numbers.select("doc_id", model.column().alias("score"))


def held_out() -> Column:
    return bucket_of("doc_id", 5) == 0


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each whole document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = score(docs, model).select("doc_id", held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
