"""The tree queries fit the default models, over all labels."""
import pytest
from pyspark.ml.classification import OneVsRest

from sensorlab.operators import models as MD
from sensorlab.plans import q_misc

SF_SMALL = "/root/testdata/sf0.001"


class Asked(Exception):
    pass


@pytest.mark.parametrize("query,name", [
    (q_misc.q_b1, "RandomForest-Default"), (q_misc.q_b2, "GradientBoosting-Default"),
    (q_misc.q_b4, "RandomForest-Default"), (q_misc.q_s17, "RandomForest-Default")])
def test_default_model(spark, monkeypatch, query, name):
    def fit(train, estimator, label="label"):
        raise Asked(estimator, train.select(label).distinct().count())
    monkeypatch.setattr(MD, "fit", fit)
    with pytest.raises(Asked) as e:
        query(spark, SF_SMALL)
    estimator, labels = e.value.args
    p = MD.DEFAULT_MODELS[name]["params"]
    assert labels == 10
    if isinstance(estimator, OneVsRest):
        gbt = estimator.getClassifier()
        assert (gbt.getMaxIter(), gbt.getStepSize(), gbt.getMaxDepth()) == (p["n_estimators"], p["learning_rate"], p["max_depth"])
    else:
        assert (estimator.getNumTrees(), estimator.getMaxDepth()) == (p["n_estimators"], p["max_depth"] or MD.MAX_DEPTH)


def test_benchmark_runs_the_default_set(spark, monkeypatch):
    def benchmark(train, test, models=None, n_classes=2):
        raise Asked(models or MD.DEFAULT_MODELS, n_classes)
    monkeypatch.setattr(MD, "benchmark_models", benchmark)
    with pytest.raises(Asked) as e:
        q_misc.q_b3(spark, SF_SMALL)
    assert e.value.args == (MD.DEFAULT_MODELS, 10)
