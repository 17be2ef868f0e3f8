"""Toxicity: cumulative-link ordinal regression over sparse text features.

Grades 0, 1, 2 come from the labels: 0 not toxic, 1 toxic, 2 toxic and of low quality. The model has
one weight per word, shared by all thresholds: P(grade <= k) = sigmoid(threshold_k - weights . words),
with thresholds in ascending order. The words of a document count once each, and no weight is negative, so
a text never gets milder by more words. It is fitted on a bounded
sample of labelled rows and applied to every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, ship

#: Labelled rows that the model is fitted on at most: those with the smallest hashes of doc_id.
MAX_LABELLED = 4096
#: A word is a feature if it stands in so many of these rows and its rate in toxic rows is higher by so many deviations.
MIN_ROWS, MIN_DEVIATIONS, MAX_FEATURES = 5, 4.0, 4096
GRADES = 3
#: Least share of toxic rows among those with a feature.
MIN_PURITY = 0.8
L2, STEPS, RATE = 3e-5, 600, 0.1
#: Beside the words themselves, their beginnings of these lengths are features.
STEMS = (4, 6, 8)
#: A document is called toxic if P(grade >= 1) is at least this.
TOXIC_FROM = 0.2

WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """The distinct words of a text in small letters, and the beginnings of longer ones (with a *)."""
    found = set(WORD.findall((text or "").lower()))
    return found.union(*({w[:n] + "*" for w in found if len(w) > n} for n in STEMS))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, grade and text of at most ``most`` labelled rows. Null labels are no labels; of repeated
    labels the severest counts. Its size is bounded by ``most``."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1))
    graded = labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    few = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """weights by word, and ascending thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]) -> None:
        self.weights, self.thresholds = weights, thresholds

    def chances(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        score = sum(self.weights[w] for w in sorted(words(text) & self.weights.keys()))
        return _sigmoid(score - np.array(self.thresholds))


def loss_and_gradient(grades: np.ndarray, row: np.ndarray, column: np.ndarray, weights: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with its penalty, and its gradient in the weights and the two cuts.

    Row ``row[i]`` has feature ``column[i]``. The cuts are the first threshold and the logarithm of the
    step to the next; the chance of grade k is the difference of the sigmoids at its two thresholds.
    """
    n = len(grades)
    score = np.bincount(row, weights[column], n) if len(column) else np.zeros(n)
    thresholds = np.array([cuts[0], cuts[0] + np.exp(cuts[1])])
    below = _sigmoid(thresholds[None, :] - score[:, None])  # P(grade <= k)
    edges = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
    slopes = edges * (1 - edges)
    high, low = edges[np.arange(n), grades + 1], edges[np.arange(n), grades]
    chance = np.maximum(high - low, 1e-12)
    up, down = slopes[np.arange(n), grades + 1] / chance, slopes[np.arange(n), grades] / chance
    by_score = (up - down) / n  # slope of the loss in the score
    by_cut = np.array([-(up[grades == k].sum() - down[grades == k + 1].sum()) / n for k in range(GRADES - 1)])
    by_weight = np.bincount(column, by_score[row], len(weights)) if len(column) else np.zeros(len(weights))
    loss = -np.log(chance).mean() + L2 / 2 * (weights**2).sum()
    return float(loss), np.concatenate([by_weight + L2 * weights, [by_cut.sum(), by_cut[1] * np.exp(cuts[1])]])


def fit(rows: list[tuple[int, list[str]]], features: list[str]) -> Ordinal:
    """The model of rows of a grade and the features in it. Without rows of two grades every document gets grade 0."""
    grades = np.array([g for g, _ in rows], dtype=int)
    if len(set((grades > 0).tolist())) < 2:
        return Ordinal({}, [40.0] * (GRADES - 1))
    n, chosen = len(rows), {w: i for i, w in enumerate(features)}
    row = np.repeat(np.arange(n), [len(ws) for _, ws in rows])
    column = np.array([chosen[w] for _, ws in rows for w in ws], dtype=int)
    weights, cuts = np.zeros(len(chosen)), np.array([1.0, 0.0])  # first threshold, log of the step to the next
    state = [np.zeros(len(chosen) + 2), np.zeros(len(chosen) + 2)]
    for step in range(1, STEPS + 1):
        _, gradient = loss_and_gradient(grades, row, column, weights, cuts)
        state = [0.9 * state[0] + 0.1 * gradient, 0.999 * state[1] + 0.001 * gradient**2]
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        weights, cuts = np.maximum(weights - move[:-2], 0.0), cuts - move[-2:]
    return Ordinal({w: float(weights[i]) for w, i in chosen.items()}, [float(cuts[0]), float(cuts[0] + np.exp(cuts[1]))])


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Ordinal:
    """Fits on the labelled sample. Features are counted and chosen in Spark; the driver gets them
    (MAX_FEATURES at most) and, for each of at most ``most`` rows, those that it has."""

    def exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc_id, grade, text in zip(b["doc_id"], b["grade"], b["text"], strict=True):
                yield pd.DataFrame({"doc_id": doc_id, "grade": grade, "word": [None, *sorted(words(text))]})

    tables = Tables(ship(docs.sparkSession), "toxicity")
    sample = labelled_sample(docs, labels, most).select(F.col("doc_id").cast("string"), F.col("grade").cast("int"), "text")
    found = tables.keep(sample.mapInPandas(exploded, "doc_id string, grade int, word string"), "words")
    documents, present = found.where("word is null").select("doc_id", "grade"), found.where("word is not null")
    total = documents.agg(F.count("*").alias("n"), F.count_if(F.col("grade") > 0).alias("toxic")).first()
    n, t = total["n"], max(total["toxic"], 1)
    counted = present.groupBy("word").agg(F.count("*").alias("rows"), F.count_if(F.col("grade") > 0).alias("toxic")).where(F.col("rows") >= MIN_ROWS)
    share = F.col("rows") / F.lit(float(max(n, 1)))
    spread = F.sqrt(share * (1 - share) * F.lit(1 / t + 1 / max(n - t, 1)))
    deviations = (F.col("toxic") / F.lit(float(t)) - (F.col("rows") - F.col("toxic")) / F.lit(float(max(n - t, 1)))) / F.greatest(spread, F.lit(1e-9))
    scored = counted.where(F.col("toxic") >= MIN_PURITY * F.col("rows")).select("word", deviations.alias("z")).where(F.col("z") >= MIN_DEVIATIONS)
    features = [r["word"] for r in scored.orderBy(F.desc("z"), "word").limit(MAX_FEATURES).collect()]
    chosen = docs.sparkSession.createDataFrame([(w,) for w in features], "word string")
    held = present.join(F.broadcast(chosen), "word").groupBy("doc_id").agg(F.sort_array(F.collect_list("word")).alias("words"))
    rows = documents.join(held, "doc_id", "left").select("doc_id", "grade", "words").collect()
    tables.drop("words")
    return fit([(r["grade"], r["words"] or []) for r in sorted(rows, key=lambda r: r["doc_id"])], features)


def severity(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, expected_severity (0 to 2), grade (the likeliest) and toxic, one row per row of ``docs``.

    Null and empty texts have no words and get the base rate's severity. Equal texts get equal results.
    Without labels every severity is 0 and no document is toxic. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))

    @F.pandas_udf("expected_severity double, grade int, toxic boolean")
    def judged(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            chances = model.value.chances(text)
            each = -np.diff(np.concatenate([[1.0], chances, [0.0]]))
            rows.append((round(float(chances.sum()), 6), int(each.argmax()), bool(chances[0] >= TOXIC_FROM)))
        return pd.DataFrame(rows, columns=["expected_severity", "grade", "toxic"])

    return docs.select("doc_id", judged("text").alias("found")).select("doc_id", "found.*")
