import numpy as np
from pyspark.sql import functions as F

from sensorlab.llm import toxicity

from .conftest import ODD_TEXTS


def brute_segments(x, base=0):
    """Take the best segment, then the same to its left and right."""
    best = None
    for a in range(len(x)):
        for b in range(a + 1, len(x) + 1):
            s = sum(x[a:b])
            if s > 0 and (best is None or s > best[2] + 1e-12 or abs(s - best[2]) <= 1e-12 and b - a < best[1] - best[0]):
                best = (a, b, s)
    if best is None:
        return []
    a, b, s = best
    return brute_segments(x[:a], base) + [(base + a, base + b, s)] + brute_segments(x[b:], base + b)


def test_maximal_segments():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 5, 12, 30):
        for _ in range(60):
            x = np.round(rng.normal(-0.3, 1.5, n), 3) + rng.normal(0, 1e-7, n)
            got = toxicity.maximal_segments(x)
            want = brute_segments(x.tolist())
            assert [g[:2] for g in got] == [w[:2] for w in want]
            assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_linear_time_on_a_staircase():
    """Many segments that stay apart, then one that takes them all in."""
    x = np.concatenate([np.tile([1.0, -1.0 - 1e-6], 100_000), [1e6]])
    assert len(toxicity.maximal_segments(x)) >= 1


def test_tail_rate():
    s = np.array([-1.0] * 9 + [1.0])
    assert abs(np.mean(np.exp(toxicity._tail(s) * s)) - 1) < 1e-6


def corpus(make):
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(300):
        w = [f"w{k}" for k in rng.integers(0, 60, 80)]
        if i % 4 == 0:
            for at in rng.integers(0, 80, 6):
                w[at] = ["vilest", "vilely", "vileness", "scorn"][int(rng.integers(4))]
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(i % 4 == 0)))
    docs += [(1000 + i, t, "x") for i, t in enumerate(ODD_TEXTS)] + [(None, docs[0][1], "x"), (0, docs[0][1], "x"), (2000, "w1 " * 60 + "vileful w2 vileish w3 scornful", "x")]
    labels += [(None, 1), (5, None), (7, 0)]
    return make(docs, "doc_id long, text string, score string"), make(labels, "doc_id long, toxic int")


def test_passages_and_scores(make):
    docs, labels = corpus(make)
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    out = toxicity.score(docs, model).collect()
    assert len(out) == docs.count()
    for r in out:
        assert 0 <= r.score <= 1
        raw = (r.text or "").encode()
        bad = "vile" in (r.text or "") or "scorn" in (r.text or "")
        assert (r.score >= 0.5) == bad, (r.doc_id, r.score)
        for p in r.passages:
            assert p.e_value < toxicity.SIGNIFICANT and b"vil" in raw[p.begin:p.end] or b"scorn" in raw[p.begin:p.end]
    assert len({r.score for r in out if not r.text}) == 1


def test_nothing_to_learn(make):
    docs, labels = corpus(make)
    assert toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.5}
    model = toxicity.fit(docs, labels, F.lit(True))
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_held_out_accuracy(spark):
    from sensorlab.llm.queries import QUERIES
    d = "/root/testdata/sf0.1"
    rows = QUERIES["op3_toxicity"](spark, d).join(spark.read.parquet(d + "/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) > 0.97 * len(held)


def test_no_word_is_left_out_by_rank(spark):
    n = 200_050
    counts = spark.range(n).select("id", F.col("id").alias("k0"), F.col("id").alias("k1"), F.col("id").alias("k2"),
                                   F.lit(3).cast("long").alias("t"), F.lit(1).cast("long").alias("c")).drop("id")
    assert [len(known) for known, _ in toxicity._log_odds(counts).tables] == [n] * 3


def test_words_of_two_texts_are_kept(make):
    """Words that occur in two training texts each are in the model, and nothing else is dropped."""
    toxic = [f"xq{i:02d}a bad{i:02d}b" for i in range(40)]
    docs = [(i, f"the day was fine {toxic[i % 40]}") for i in range(80)] + [(100 + i, f"the day was fine good{i % 40:02d}c") for i in range(80)]
    labels = [(i, int(i < 100)) for i in [*range(80), *range(100, 180)]]
    model = toxicity.fit(make(docs, "doc_id long, text string"), make(labels, "doc_id long, toxic int"), F.lit(True))
    assert len(model.tables[-1][0]) == 4 + 40 * 3
