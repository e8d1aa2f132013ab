"""Tree-model baselines (B1-B4) and model persistence.

Forests are :mod:`.forest`, boosting is :mod:`.boosting`; both aggregate tree
statistics per partition; the only driver-side loop is over the handful of named model
configurations in :func:`benchmark_models`, each of which is a full
distributed fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored
from . import metrics as M
from .boosting import GradientBoosting
from .forest import RandomForest

# fixed values: the reference's default model set (trees, depth, rate, seed)
DEFAULT_MODELS = {
    "RandomForest-Default": {"type": "random_forest", "params": {"n_estimators": 100, "max_depth": None, "random_state": 42}},
    "RandomForest-Tuned": {"type": "random_forest", "params": {"n_estimators": 200, "max_depth": 10, "random_state": 42}},
    "GradientBoosting-Default": {"type": "gradient_boosting",
                                 "params": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3, "random_state": 42}},
    "GradientBoosting-Tuned": {"type": "gradient_boosting",
                               "params": {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 5, "random_state": 42}},
}

MAX_DEPTH = 30  # "no limit" maps to it


def features_column(df: DataFrame, cols: Sequence[str] | str, out: str = "features") -> DataFrame:
    """Vector column from numeric columns or from one ARRAY<DOUBLE> column."""
    if isinstance(cols, str):
        return df.withColumn(out, array_to_vector(F.col(cols)))
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def random_forest(n_estimators: int = 100, max_depth: int | None = None, random_state: int = 42,
                  label: str = "label", features: str = "features") -> RandomForest:
    """B1: random forest classifier.  Trees grow to depth ``MAX_DEPTH`` at most,
    which stands for "no limit"; a larger depth is an error."""
    if max_depth is not None and max_depth > MAX_DEPTH:
        raise ValueError(f"max_depth {max_depth} is beyond {MAX_DEPTH}")
    return RandomForest(n_estimators, MAX_DEPTH if max_depth is None else max_depth, random_state, label, features)


def gradient_boosting(n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3,
                      random_state: int = 42, label: str = "label", features: str = "features") -> GradientBoosting:
    """B2: gradient-boosted trees over any number of classes, with probabilities.  Every row
    and feature is used in every round, so there is nothing for ``random_state`` to draw."""
    return GradientBoosting(n_estimators, learning_rate, max_depth, label, features)


def build(spec: dict, label: str = "label"):
    p = dict(spec.get("params", {}))
    if spec["type"] == "random_forest":
        return random_forest(p.get("n_estimators", 100), p.get("max_depth"), p.get("random_state", 42), label)
    if spec["type"] == "gradient_boosting":
        return gradient_boosting(p.get("n_estimators", 100), p.get("learning_rate", 0.1), p.get("max_depth", 3),
                                 p.get("random_state", 42), label)
    raise ValueError(f"Unsupported model type: {spec['type']}")


def fit(train: DataFrame, estimator, label: str = "label") -> PipelineModel:
    """Fit a one-stage pipeline (label cast to double)."""
    return Pipeline(stages=[estimator]).fit(train.withColumn(label, F.col(label).cast("double")))


def predictions(model: PipelineModel, test: DataFrame, key: str = "sample_id", label: str = "label") -> DataFrame:
    p = model.transform(test.withColumn(label, F.col(label).cast("double")))
    return p.select(key, F.col(label).cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))


def benchmark_models(train: DataFrame, test: DataFrame, models: dict | None = None, n_classes: int = 2,
                     key: str = "sample_id", label: str = "label") -> DataFrame:
    """Fit each named model and score it (accuracy, precision, recall, f1
    with E5's binary / weighted rule); models with invalid settings are skipped."""
    out = None
    for name, spec in (models or DEFAULT_MODELS).items():
        try:
            m = fit(train, build(spec, label), label)
            pr = stored(predictions(m, test, key, label), "predictions")  # scored once, read by the four measures
            acc = M.accuracy(pr)
            prf = M.precision_recall_f1(pr)
            row = acc.select(F.lit(name).alias("model"), "accuracy", prf.select("precision").scalar().alias("precision"),
                             prf.select("recall").scalar().alias("recall"), prf.select("f1").scalar().alias("f1"))
        except (ValueError, IllegalArgumentException):  # a model that cannot be set up; faults of the cluster are raised
            continue
        out = row if out is None else out.unionByName(row)
    return out


def feature_importance(model: PipelineModel, names: Sequence[str], top_n: int | None = None):
    """(feature, importance) pairs sorted by importance, top ``top_n``.
    The importance vector has one entry per feature column (small)."""
    est = model.stages[-1]
    imp = est.featureImportances.toArray()
    order = sorted(range(len(imp)), key=lambda i: -imp[i])
    if top_n:
        order = order[:top_n]
    return [(names[i], float(imp[i])) for i in order]


def save_model(model: PipelineModel, path: str) -> str:
    """Persist a fitted pipeline (Spark ML format)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """Load a persisted pipeline."""
    return PipelineModel.load(path)
