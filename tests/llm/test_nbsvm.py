import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from sensorlab.llm import nbsvm

from .conftest import ODD_TEXTS


def chunk(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_features_do_not_cross_texts():
    texts = ["A cat, a cat!", "", "a Cat", "!!! ???", "123 go go go", "é"]
    row, bucket = nbsvm.features(*chunk(texts))
    for i, t in enumerate(texts):
        assert bucket[row == i].tolist() == nbsvm.features(*chunk([t]))[1].tolist()
    sets = [set(bucket[row == i].tolist()) for i in range(len(texts))]
    assert sets[2] < sets[0] | sets[2] and sets[0] & sets[2] and not sets[1]


def test_dual_descent_reaches_the_hinge_optimum():
    """Primal and dual objectives meet, so both are optimal."""
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(30, 5, replace=False)) for _ in range(80)]
    values = [rng.normal(size=5) for _ in rows]
    y = rng.integers(0, 2, 80)
    cost = np.where(y == 1, 0.5, 1.5)
    w = nbsvm.dual_descent(rows, values, y, cost, 30, epochs=3000)
    sign = np.where(y == 1, 1, -1)
    margin = np.array([w[r] @ v + w[30] for r, v in zip(rows, values, strict=True)])
    primal = w @ w / 2 + (cost * np.maximum(0, 1 - sign * margin)).sum()
    for _ in range(200):  # no step away from it is better
        u = w + rng.normal(size=31) * 0.01
        m = np.array([u[r] @ v + u[30] for r, v in zip(rows, values, strict=True)])
        assert u @ u / 2 + (cost * np.maximum(0, 1 - sign * m)).sum() > primal - 1e-6


def test_platt_recovers_a_logistic_curve():
    rng = np.random.default_rng(1)
    m = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * m - 0.7)))).astype(int)
    a, b = nbsvm.platt(m, y, np.ones(4000))
    assert abs(a - 1.5) < 0.15 and abs(b + 0.7) < 0.15


def test_odd_texts_and_missing_labels(make):
    docs = make([(i, t, "x") for i, t in enumerate([*ODD_TEXTS, *ODD_TEXTS])] + [(None, "null id", "x"), (3, "again", "x")],
                "doc_id long, text string, score string")
    labels = make([(i, i % 2) for i in range(10)] + [(3, 1), (None, 1), (4, None), (99, 0)], "doc_id long, quality int")
    model = nbsvm.fit(docs, labels, F.lit(True))
    out = nbsvm.classify(docs, model).collect()
    assert len(out) == 2 * len(ODD_TEXTS) + 2 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not r.text}) == 1
    assert nbsvm.fit(docs, labels.where("quality = 1"), F.lit(True)) is None
    assert {r.score for r in nbsvm.classify(docs, None).collect()} == {0.5}
    assert nbsvm.classify(docs.where("false"), model).count() == 0


def test_held_out_accuracy(spark):
    from sensorlab.llm.queries import QUERIES
    d = "/root/testdata/sf0.01"
    rows = QUERIES["op9_quality"](spark, d).join(spark.read.parquet(d + "/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.predicted == r.quality for r in held) > 0.95 * len(held)


PRIME, BASES, WORD = (1 << 31) - 1, (1_103_515_245, 747_796_405), (1 << 64) - 1


def mix(h):
    for _ in range(2):
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & WORD
    return h ^ h >> 32


def token_hash(raw):
    one, two = (sum((c + 1) * pow(b, i, PRIME) for i, c in enumerate(raw)) % PRIME for b in BASES)
    return mix(one << 32 | two)


def plain_features(text):
    """Buckets of words, pairs of words, and triples of shapes, one token after the other."""
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\t\n\x0b\x0c\r ]+", text.encode())
    low = [token_hash(bytes(c + 32 if 65 <= c < 91 else c for c in t)) for t in tokens]
    shape = []
    for i, t in enumerate(tokens):
        caps = sum(65 <= c < 91 for c in t)
        kind = 4 if any(48 <= c < 58 for c in t) else 3 if caps == len(t) > 1 else 2 if caps else 1
        word = t[:1].isalnum() or t[0] >= 128
        shape.append(7 if i and low[i] == low[i - 1] else kind if word else low[i])
    keys = list(low)
    keys += [mix((a * 3 + b + 11) & WORD) for a, b in zip(low, low[1:], strict=False)]
    keys += [mix(((a * 31 + b) * 37 + c + 13) & WORD) for a, b, c in zip(shape, shape[1:], shape[2:], strict=False)]
    return sorted({k >> 46 for k in keys})


def test_features_ratios_margins_and_scores_in_plain_python():
    rng = random.Random(3)
    words = "The cat SAT on 3 mats , wow !! wow x1 éa $$ ## Ok".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 9, 40]))) for _ in range(60)] + [t or "" for t in ODD_TEXTS]
    row, bucket = nbsvm.features(*chunk(texts))
    plain = [plain_features(t) for t in texts]
    assert [bucket[row == i].tolist() for i in range(len(texts))] == plain
    y = [i % 2 for i in range(len(texts))]
    model = nbsvm.solve([np.array(p, np.int64) for p in plain], np.array(y), np.ones(len(y)))
    # count ratios
    count = [dict.fromkeys(range(0), 0) for _ in range(2)]
    for p, c in zip(plain, y, strict=True):
        for b in p:
            count[c][b] = count[c].get(b, 0) + 1
    total = [nbsvm.BUCKETS + sum(c.values()) for c in count]

    def ratio(b):
        return math.log((1 + count[1].get(b, 0)) / total[1]) - math.log((1 + count[0].get(b, 0)) / total[0])
    # the same hinge-loss weights, then mixed with their mean size, margins and scores document by document
    values = [np.array([ratio(b) for b in p]) for p in plain]
    values = [v / max(math.sqrt(sum(x * x for x in v)), 1e-9) for v in values]
    share = [y.count(0), y.count(1)]
    cost = np.array([nbsvm.COST * len(y) / (2 * share[c]) for c in y])
    w = nbsvm.dual_descent([np.array(p, np.int64) for p in plain], values, np.array(y), cost, nbsvm.BUCKETS)
    used = [abs(x) for x in w[:-1] if x]
    mean = sum(used) / len(used)
    got = model.scores(row, bucket, len(texts))
    for i, p in enumerate(plain):
        size = math.sqrt(sum(ratio(b) ** 2 for b in p))
        margin = sum(((1 - nbsvm.BETA) * mean + nbsvm.BETA * w[b]) * ratio(b) for b in p) / max(size, 1e-9) + nbsvm.BETA * w[-1]
        want = 1 / (1 + math.exp(-(model.slope * margin + model.shift)))
        assert abs(got[i] - want) < 1e-4, i
