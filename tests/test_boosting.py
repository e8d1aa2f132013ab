"""Boosting against a plain booster, over one and several partitions."""

import numpy as np
import pytest

from sensorlab.operators import boosting as B
from sensorlab.operators import models as MD


def plain(x, y, classes, rounds, rate, depth):
    """Node by node, cut by cut; scores of the training rows."""
    one = classes == 2
    prior = np.array([(y == k).mean() for k in range(classes)])
    scores = np.tile(np.log(prior[1:] / prior[:1]) if one else np.log(prior), (len(y), 1))
    for _ in range(rounds):
        if one:
            p = 1 / (1 + np.exp(-scores[:, 0]))
            grads = [y - p]
        else:
            e = np.exp(scores)
            p = e / e.sum(axis=1, keepdims=True)
            grads = [(y == k) - p[:, k] for k in range(classes)]
        step = np.zeros_like(scores)
        for k, g in enumerate(grads):
            h = p * (1 - p) if one else np.abs(g) * (1 - np.abs(g))

            def grow(rows, level, k=k, g=g, h=h):
                best = (1e-12 * len(rows), None)
                if level < depth:
                    for f in range(x.shape[1]):
                        for c in sorted(set(x[rows, f]))[:-1]:
                            a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                            gain = len(a) * len(b) / len(rows) * (g[a].mean() - g[b].mean()) ** 2
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, (a, b))
                if best[1] is None:
                    step[rows, k] = g[rows].sum() / h[rows].sum() * (1 if one else (classes - 1) / classes)
                else:
                    for part in best[1]:
                        grow(part, level + 1)
            grow(np.arange(len(y)), 0)
        scores = scores + rate * step
    return scores


def data(classes, n=90, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.integers(0, 25, (n, 4)).astype(float) + 6 * np.eye(4)[y % 4]
    x[:, 3] = x[:, 0] > 9
    return x, y


@pytest.mark.parametrize("classes,parts", [(3, 1), (3, 4), (2, 1), (2, 3)])
def test_equals_a_plain_booster(spark, monkeypatch, classes, parts):
    monkeypatch.setattr(B, "ROUNDS_PER_BASE", 2)
    x, y = data(classes)
    monkeypatch.setattr(B, "PARTITION_BYTES", -(-len(y) * (8 + 8 * (1 if classes == 2 else classes)) // parts))
    df = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y, strict=True))],
                               "sample_id int, label int, features array<double>")
    model = B.GradientBoosting(5, 0.3, 3, bins=512).fit(df)  # every value is a cut
    want = plain(x, y, classes, 5, 0.3, 3)
    assert np.allclose(model.fitted.scores(x), want, atol=1e-9)
    p = B.probabilities(want)
    got = model.transform(df).orderBy("sample_id").collect()
    assert np.allclose([r.probability.toArray() for r in got], p, atol=1e-9)
    assert [int(r.prediction) for r in got] == list(p.argmax(axis=1))
    assert abs(model.featureImportances.toArray().sum() - 1) < 1e-9


def test_saved_model_predicts_alike(spark, tmp_path):
    x, y = data(3)
    df = MD.features_column(spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y, strict=True))],
                                                  "sample_id int, label int, series array<double>"), "series")
    model = MD.fit(df, MD.gradient_boosting(3, 0.3, 2))
    again = MD.load_model(MD.save_model(model, str(tmp_path / "m")))
    assert MD.predictions(model, df).collect() == MD.predictions(again, df).collect()


def test_odd_rows(spark):
    """Missing labels and features teach nothing; NaN goes right; a class may be absent."""
    rows = [(i, i % 2 * 2, [float(i % 2), float("nan") if i % 3 else 1.0]) for i in range(30)]
    rows += [(90, None, [1.0, 1.0]), (91, 0, None), (92, 0, [1.0])]
    df = spark.createDataFrame(rows, "sample_id int, label int, features array<double>")
    got = {r.sample_id: int(r.prediction) for r in B.GradientBoosting(4, 0.5, 2).fit(df).transform(df).collect()}
    assert all(got[i] == i % 2 * 2 for i in range(30)) and len(got) == 33
    with pytest.raises(ValueError):
        B.GradientBoosting().fit(df.where("sample_id > 89"  " AND label IS NULL"))
    with pytest.raises(ValueError):
        B.GradientBoosting(n_estimators=0)
