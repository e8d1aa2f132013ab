import math

import numpy as np
import pytest

from sensorlab.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, n string"


def run(make, rows, **kw):
    got = whiten.whiten(make([(*r, "old") for r in rows], SCHEMA), **kw)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return got.collect()


def held(rows, scale=256):
    ok = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows
          if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(x) for _, x in ok)
    return [(i, tuple(x + [0] * (width - len(x)))) for i, x in ok]


def check(rows, got, components=4):
    ok = held(rows)
    fit = np.array(sorted({x for _, x in ok}), object)
    n, sums = len(fit), fit.sum(axis=0)
    c = (n * fit - sums).astype(np.float64) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    assert len(got) == len(ok) * min(components, len(sums))
    sign = {}
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for i, x in ok:
        dev = int(sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)))
        plain = (np.array([float(n * a - s) / n for a, s in zip(x, sums, strict=True)]) @ vectors) / np.sqrt(np.maximum(values, 1e-300))
        for k in range(len(values)):
            near = [r for r in by[i, k + 1] if r.deviation == (dev if dev < 1 << 63 else None)]
            assert near, (i, k)
            r = near[0]
            assert r.n == n
            if values[k] <= 1e-12 * values.sum():
                assert r.whitened is None
                continue
            assert abs(r.explained - values[k] / np.trace(c.T @ c / n)) <= 1e-12
            assert r.identity_error < 1e-9
            s = sign.setdefault(k, 1 if r.whitened * plain[k] >= 0 else -1) if abs(plain[k]) > 1e-3 else sign.get(k, 0)
            assert not s or any(abs(s * q.whitened - plain[k]) < 1e-6 for q in near)


def vectors(n, width, seed, spread=None):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width)) * (np.ones(width) if spread is None else spread) + 0.3
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("width", [3, 10, 48])
def test_components_match_a_full_solver(make, width):
    rows = vectors(400, width, width)
    check(rows, run(make, rows))


def test_steep_spectrum_and_copies(make):
    rows = vectors(300, 50, 5, 2.0 ** -np.arange(50))
    rows += [(1000 + i, rows[0][1]) for i in range(500)]  # the fit list holds it once
    rows += [(i, v) for i, v in rows[:3]]
    check(rows, run(make, rows))


def test_filter_damps_the_unwanted_end(make, spark):
    """With few guard columns many filters are needed, and the result is the same."""
    rows = vectors(500, 40, 9, np.linspace(1, 2, 40))
    df = make([(tuple(x),) for x in sorted({x for _, x in held(rows)})], "x array<long>")
    pages = whiten.Pages(df, 40)
    few = whiten.leading_pairs(pages, 4, guard=2, degree=6)
    many = whiten.leading_pairs(pages, 4, guard=20, degree=12)
    assert np.allclose(few[0], many[0], rtol=1e-12) and max(few[2], many[2]) < 1e-12
    assert np.allclose(np.abs((few[1] * many[1]).sum(axis=0)), 1, atol=1e-10)


def test_odd_rows(make):
    rows = vectors(60, 5, 1)
    rows += [(None, [1.0] * 5), (7, None), (8, [None, 1.0, 1.0, 1.0, 1.0]), (9, [float("nan")] * 5), (10, [float("-inf")] * 5),
             (11, []), (12, [1.0, -0.0])]
    got = run(make, rows)
    assert sum(r.vec_id is None for r in got) == 4
    ids = [i for i, _ in held(rows)]
    assert sorted(str(r.vec_id) for r in got if r.component == 1) == sorted(map(str, ids))
    check([(i if i is not None else -1, v) for i, v in rows], [r if r.vec_id is not None else type(r)(**(r.asDict() | {"vec_id": -1})) for r in got])


def test_constant_single_and_none(make):
    assert run(make, []) == [] and run(make, [(1, None)]) == [] and run(make, [(1, [])]) == []
    one = run(make, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one if r.vec_id == 1] == [
        (1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    line = [(i, [float(i), 1.0, 2.0 * i]) for i in range(9)]
    check(line, run(make, line))


@pytest.mark.parametrize("scale", [1e3, 1e6])  # the second: beyond a long
def test_large_sums_stay_exact(make, scale):
    rows = [(i, [scale * (i % 7), -scale * i, 5.0]) for i in range(200)]
    check(rows, run(make, rows))
