"""The distributed forest: whole trees, the same whether grown in one task or split over many."""

import pickle

import numpy as np
import pytest

from sensorlab.operators import forest as RF
from sensorlab.operators import models as MD


def table(spark, n=400, seed=0, noise=False):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.integers(0, 12, (n, 4)).astype(float) if noise else rng.normal(size=(n, 4)) + 4 * np.eye(4)[y]
    return spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y, strict=True))],
                                 "sample_id long, label int, features array<double>"), x, y


def plain_tree(x, y, w, depth, classes):
    """Node by node, cut by cut; class counts of the leaf of every row."""
    out = np.zeros((len(y), classes))

    def gini(r):
        c = np.bincount(y[r], w[r], classes)
        return c.sum() - (c ** 2).sum() / c.sum()

    def split(rows, level):
        used, best = rows[w[rows] > 0], (1e-9, None)
        if level < depth:
            for f in range(x.shape[1]):
                for c in np.unique(x[used, f])[:-1]:
                    go = x[used, f] <= c
                    gain = gini(used) - gini(used[go]) - gini(used[~go])
                    if gain > best[0] + 1e-9:
                        best = gain, (f, c)
        if best[1] is None:
            out[rows] = np.bincount(y[used], w[used], classes)
        else:
            go = x[rows, best[1][0]] <= best[1][1]
            split(rows[go], level + 1)
            split(rows[~go], level + 1)
    split(np.arange(len(y)), 0)
    return out


def test_a_tree_equals_a_plain_one():
    rng = np.random.default_rng(1)
    x, y, w = rng.integers(0, 9, (150, 4)).astype(np.uint8), rng.integers(0, 3, 150), rng.poisson(1.0, 150).astype(float)
    r = np.flatnonzero(w)
    for depth in (0, 1, 3, 30):
        f, c, ch, leaves, gain = RF.grow(x[r], y[r], w[r], depth, 4, 9, 3, rng)
        assert np.array_equal(leaves[ch[RF.walk(x, f, c, ch)]], plain_tree(x, y, w, depth, 3))
        assert (f >= 0).sum() + 1 == len(leaves) and (gain.sum() > 0) == (depth > 0)


def test_subtrees_in_other_tasks_give_the_same_forest(spark, monkeypatch):
    df, x, y = table(spark, noise=True)

    def votes(limit):
        monkeypatch.setattr(RF, "SUBTREE_ROWS", limit)
        model = RF.RandomForest(2, 30, 7, tried=4).fit(df)
        rows = model.transform(df).orderBy("sample_id").collect()
        return model, np.array([r.rawPrediction.toArray() for r in rows]), model.featureImportances.toArray()
    one, a, i = votes(1 << 17)
    many, b, j = votes(90)
    assert sum(len(t.feature) for t in one.fitted.tops) == 2 and sum(len(t.feature) for t in many.fitted.tops) > 10
    assert np.array_equal(a, b) and np.allclose(i, j) and np.allclose(a.sum(axis=1), 2)


def test_the_driver_holds_no_subtree(spark, monkeypatch):
    """A fitted model does not grow with the rows: here 20 trees over 3,000 noisy rows, some 20,000 nodes."""
    df, _, _ = table(spark, 3000, noise=True)
    model = MD.fit(df, MD.random_forest(20)).stages[-1]
    nodes = spark.read.parquet(model.fitted.path).selectExpr("sum(length(cut)) AS n").first().n
    assert nodes > 20_000 and len(pickle.dumps(model.fitted)) < 20_000


def test_learns_and_is_saved(spark, tmp_path, monkeypatch):
    df, x, y = table(spark)
    model = MD.fit(df, MD.random_forest(10, 6))
    rows = MD.predictions(model, df).collect()
    assert len(rows) == 400 and np.mean([r.y_true == r.y_pred for r in rows]) > 0.95
    again = MD.load_model(MD.save_model(model, str(tmp_path / "m")))
    assert sorted(MD.predictions(again, df).collect()) == sorted(rows)
    assert again.stages[-1].featureImportances == model.stages[-1].featureImportances
    assert again.stages[-1].featureImportances.toArray()[3] < 0.2
    monkeypatch.setattr(RF, "SCORED_ROWS", 150)  # several copies of every subtree
    assert sorted(MD.predictions(again, df).collect()) == sorted(rows)


def test_odd_rows(spark):
    """Rows to learn from are whole; rows to score may miss values."""
    good = [(i, i % 2 * 2, [float(i % 2), 1.0]) for i in range(30)]
    schema = "sample_id int, label int, features array<double>"
    model = RF.RandomForest(5, 4).fit(spark.createDataFrame(good, schema))
    odd = [(90, None, [1.0, 1.0]), (91, 0, None), (92, 0, [1.0]), (93, 0, [0.0, float("nan")])]
    got = {r.sample_id: int(r.prediction) for r in model.transform(spark.createDataFrame(good + odd, schema)).collect()}
    assert all(got[i] == i % 2 * 2 for i in range(30)) and len(got) == 34
    assert all(x in got for x in (90, 91, 92, 93)) and got[93] == 0
    for row in [*odd, (94, -1, [1.0, 1.0])]:
        with pytest.raises(Exception, match="MUST"):
            RF.RandomForest(2, 4).fit(spark.createDataFrame([*good, row], schema))
    with pytest.raises(ValueError):
        RF.RandomForest().fit(spark.createDataFrame([], schema))
    with pytest.raises(ValueError):
        MD.random_forest(max_depth=31)
