"""Multi-label classifiers with MLlib: training, choice by validation score,
scoring.

Gradient training of graph networks is not rebuilt; a model is one weighted
logistic regression per class over pooled / embedded features, fitted by MLlib
(distributed), with positive-class weights neg / pos. All fits read one stored
table (features and one label column per class). Candidates are scored on a
validation split with thresholds tuned there, and the best one by F1 or F-beta
is kept. Predictions have the long ``pred`` layout, so that every metric
operator applies unchanged.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cwescope.operators import metrics as M
from cwescope.session import materialize

#: Fits that run at the same time, as jobs of one session.
PARALLEL_FITS = 4
SCORES = ("f1", "fbeta")


@dataclass(frozen=True)
class Candidate:
    """Parameters of a fit."""
    reg: float = 0.01
    elastic: float = 0.0
    max_iter: int = 30


@dataclass(frozen=True)
class Model:
    """One classifier per class; a class with one label value in training has
    the constant probability of that value."""
    candidate: Candidate
    per_class: dict[int, LogisticRegressionModel | float]

    def probabilities(self, wide: DataFrame) -> DataFrame:
        """pred(sample_id, cls, y, p) of the rows of a wide table."""
        out = wide
        for c, m in self.per_class.items():
            if isinstance(m, float):
                out = out.withColumn(f"p_{c}", F.lit(m))
                continue
            scored = m.transform(out)
            out = scored.withColumn(f"p_{c}", vector_to_array("probability")[1]).drop(
                "rawPrediction", "probability", "prediction")
        rows = F.array(*[F.struct(F.lit(c).cast("bigint").alias("cls"), F.col(f"y_{c}").alias("y"),
                                  F.col(f"p_{c}").alias("p")) for c in self.per_class])
        return out.select("sample_id", F.explode(rows).alias("t")).select("sample_id", "t.*")


@dataclass(frozen=True)
class Selection:
    """The kept model, its thresholds (cls, threshold, best_f1) and ``scores``:
    one row per candidate."""
    model: Model
    thresholds: DataFrame
    scores: DataFrame

    def predict(self, features: DataFrame, labels: DataFrame, ids: DataFrame, key: str = "sample_id") -> DataFrame:
        """pred(sample_id, cls, y, p, yhat) with the tuned thresholds."""
        wide = wide_table(features, labels, list(self.model.per_class), ids, key)
        return apply_thresholds(self.model.probabilities(wide), self.thresholds)


def wide_table(features: DataFrame, labels: DataFrame, classes: list[int], ids: DataFrame,
               key: str = "sample_id") -> DataFrame:
    """sample_id, features (vector), y_c per class of the given ids; a class
    that ``labels`` does not name for a sample is 0."""
    ys = labels.where(F.col("cls").isin(classes)).groupBy(F.col(key).alias("sample_id")).agg(
        *[F.max(F.when(F.col("cls") == c, F.col("y").cast("int"))).alias(f"y_{c}") for c in classes])
    x = features.select(F.col(key).alias("sample_id"), array_to_vector("vec").alias("features"))
    wanted = ids.select(F.col(key).alias("sample_id"))
    return (x.join(wanted, "sample_id", "left_semi").join(ys, "sample_id", "left")
            .select("sample_id", "features", *[F.coalesce(f"y_{c}", F.lit(0)).alias(f"y_{c}") for c in classes]))


def apply_thresholds(pred: DataFrame, thresholds: DataFrame) -> DataFrame:
    t = F.coalesce("threshold", F.lit(M.DEFAULT_THRESHOLD))
    return pred.join(F.broadcast(thresholds.select("cls", "threshold")), "cls", "left").select(
        "sample_id", "cls", "y", "p", (F.col("p") >= t).cast("int").alias("yhat"))


def fit(train: DataFrame, classes: list[int], candidates: list[Candidate]) -> list[Model]:
    """A model per candidate. ``train`` is a stored wide table; one aggregate
    counts the positives of all classes."""
    counts = train.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"y_{c}").alias(f"pos_{c}") for c in classes]).first()
    n = float(counts["n"])

    def one(candidate: Candidate, c: int) -> LogisticRegressionModel | float:
        pos = float(counts[f"pos_{c}"] or 0)
        if pos in (0.0, n):
            return pos / n if n else 0.0
        w = F.when(F.col(f"y_{c}") == 1, F.lit((n - pos) / pos)).otherwise(F.lit(1.0))
        rows = train.select("features", F.col(f"y_{c}").cast("double").alias("label"), w.alias("w"))
        return LogisticRegression(weightCol="w", maxIter=candidate.max_iter, regParam=candidate.reg,
                                  elasticNetParam=candidate.elastic).fit(rows)

    jobs = [(k, c) for k in candidates for c in classes]
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        fits = dict(zip(jobs, pool.map(lambda job: one(*job), jobs)))
    return [Model(k, {c: fits[k, c] for c in classes}) for k in candidates]


def select_model(features: DataFrame, labels: DataFrame, classes: list[int], train_ids: DataFrame, val_ids: DataFrame,
                 candidates: list[Candidate], key: str = "sample_id", by: str = "f1",
                 beta: float = M.F_BETA) -> Selection:
    """Fits every candidate on the training ids, tunes thresholds on the
    validation ids, and keeps the candidate with the best macro F1 or F-beta
    there; the earlier one of equal candidates."""
    if by not in SCORES:
        raise ValueError(f"candidates are compared by {' or '.join(SCORES)}")
    if not candidates:
        raise ValueError("no candidates")
    train = materialize(wide_table(features, labels, classes, train_ids, key))
    val = materialize(wide_table(features, labels, classes, val_ids, key))
    found = []
    for model in fit(train, classes, candidates):
        pred = materialize(model.probabilities(val))
        thresholds = materialize(M.tune_thresholds(pred))
        s = M.prf_averaged(apply_thresholds(pred, thresholds), beta).where("average = 'macro'").first()
        f1, fbeta = (float(s[c] or 0.0) if s else 0.0 for c in SCORES)
        found.append((model, thresholds, {"f1": f1, "fbeta": fbeta}))
    best = max(range(len(found)), key=lambda i: (found[i][2][by], -i))
    rows = [(i, k.reg, k.elastic, k.max_iter, s["f1"], s["fbeta"], i == best)
            for i, (k, (_, _, s)) in enumerate(zip(candidates, found))]
    scores = features.sparkSession.createDataFrame(
        rows, "candidate int, reg double, elastic double, max_iter int, val_f1 double, val_fbeta double, chosen boolean")
    return Selection(found[best][0], found[best][1], scores)


def train_multilabel(features: DataFrame, labels: DataFrame, classes: list[int], train_ids: DataFrame,
                     test_ids: DataFrame, key: str = "sample_id", max_iter: int = 30, reg: float = 0.01) -> DataFrame:
    """One candidate without a choice: pred(sample_id, cls, y, p, yhat) of the
    test ids, labels at 0.5."""
    train = materialize(wide_table(features, labels, classes, train_ids, key))
    model = fit(train, classes, [Candidate(reg, 0.0, max_iter)])[0]
    pred = model.probabilities(wide_table(features, labels, classes, test_ids, key))
    return pred.withColumn("yhat", (F.col("p") >= M.DEFAULT_THRESHOLD).cast("int"))
