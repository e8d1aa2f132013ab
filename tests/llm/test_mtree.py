import math
import random

import numpy as np
import pytest

from sensorlab.llm import mtree

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k=20, every=20, scale=64):
    ok = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows
          if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, x) in enumerate(ok):
        if i is None or i % every:
            continue
        rest = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), j is None, j or 0) for b, (j, y) in enumerate(ok) if b != a)
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(rest[:k])]
    return sorted(out, key=str)


def run(make, rows, parts=3, **sizes):
    got = mtree.top_k(make([(*r, "old") for r in rows], SCHEMA, parts), **sizes)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def clusters(n, width, seed, tight=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, width))
    x = centres[rng.integers(0, 8, n)] + tight * rng.standard_normal((n, width))
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("sizes", [{}, {"cells": 5, "tree": 60, "block": 3}, {"cells": 3, "tree": 20, "block": 1000}])
def test_results_match_brute_force(make, sizes):
    rows = clusters(600, 12, 1)
    assert run(make, rows, **sizes) == brute(rows)


def test_copies_ties_nulls(make):
    rng = random.Random(4)
    rows = [(i, [0.5, 0.25, -1.0]) for i in range(200)]                      # one vector held by most rows
    rows += [(i, [rng.choice([0.0, 0.5]), 0.5, rng.choice([1.0, -1.0])]) for i in range(200, 300)]
    rows += [(40, [0.5, 0.25, -1.0])] * 3 + [(40, [9.0, 9.0, 9.0]), (None, [0.5, 0.25, -1.0]), (None, None)]
    rows += [(60, None), (80, [None, 1.0, 1.0]), (100, [float("nan"), 0.0, 0.0]), (120, [float("inf"), 0.0, 0.0])]
    rows += [(140, [1.0]), (160, []), (180, [0.0, 0.0, 0.0, 3.0])]           # other lengths
    assert run(make, rows, tree=30) == brute(rows)


def test_wide_numbers_stay_exact(make):
    rng = np.random.default_rng(2)
    for scale in (1e3, 1e6):
        rows = [(i, [float(c) for c in scale * rng.standard_normal(6)]) for i in range(150)]
        assert run(make, rows, tree=40) == brute(rows)


def test_few_rows_and_none(make):
    assert run(make, []) == []
    assert run(make, [(0, None), (20, [float("nan")])]) == []
    assert run(make, [(0, [1.0, 2.0])]) == []
    assert run(make, [(1, [1.0, 2.0]), (3, [1.0, 1.0])]) == []
    rows = [(0, [1.0, 2.0]), (7, [2.0, 0.0])]
    assert run(make, rows) == brute(rows) and len(brute(rows)) == 1


def test_bounds_avoid_distances():
    """On clustered vectors most distances are ruled out by the stored ones."""
    x = np.array([[math.floor(64 * c) for c in v] for _, v in clusters(4000, 8, 3)], np.int64)
    norm2 = int((x * x).sum(axis=1).max())
    geo = mtree.Geometry(8, norm2, x[:1])
    _, dist = geo.nearest(x)
    tree = mtree.build_subtree(x, dist, x[0], geo)
    y, q = x[tree["order"]], x[:50]
    count = []
    parent = mtree._distances(q, np.zeros(50), geo.pivots, geo.pivot_extra)[:, 0]
    scores, known = mtree.search_subtree(tree, y, q, parent, np.full(50, -np.inf), 20, geo, count)
    assert sum(count) < 0.4 * scores.size
    best = -np.sort(-np.where(known, scores, -np.inf), axis=1)[:, :20]
    assert (best == -np.sort(-(q @ y.T), axis=1)[:, :20]).all()
