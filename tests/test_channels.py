"""Samples with several channels: one array of channel values per step."""

import pytest

from sensorlab.operators import augment as A

N, C = 40, 3


@pytest.fixture
def nested(spark):
    rows = [(i, 0, [[float((i + 1) * (t % 7) + 10 * c) for c in range(C)] for t in range(N)]) for i in range(6)]
    return spark.createDataFrame(rows, "sample_id int, round int, series array<array<double>>")


def flat(spark, nested, c):
    rows = [(r.sample_id, 0, [v[c] for v in r.series]) for r in nested.collect()]
    return spark.createDataFrame(rows, "sample_id int, round int, series array<double>")


def series(df):
    return {r.sample_id: r.series for r in df.collect()}


@pytest.mark.parametrize("op", [lambda d: A.permutation(d, 3), lambda d: A.permutation(d, 3, mode="random"),
                                lambda d: A.window_slice(d, 3)])
def test_time_operators_move_all_channels_alike(spark, nested, op):
    got = series(op(nested))
    for c in range(C):
        want = series(op(flat(spark, nested, c)))
        for i, s in got.items():
            assert [v[c] for v in s] == pytest.approx(want[i])


def test_scaling_and_rotation_by_channel(nested):
    before = series(nested)
    factors = set()
    for i, s in series(A.scaling(nested, 1)).items():
        for c in range(C):
            k = {round(v[c] / o[c], 9) for v, o in zip(s, before[i], strict=True) if o[c]}
            assert len(k) == 1
            factors |= k
    assert len(factors) == 6 * C
    orders = set()
    for i, s in series(A.rotation(nested, 2)).items():
        source = []
        for c in range(C):
            column = [abs(v[c]) for v in s]
            source.append([column == [abs(o[d]) for o in before[i]] for d in range(C)].index(True))
        assert sorted(source) == list(range(C))
        orders.add(tuple(source))
    assert len(orders) == 1


def test_jitter_differs_by_entry(nested):
    before = series(nested)
    noise = {round(x - y, 12) for i, s in series(A.jitter(nested, 1)).items()
             for v, o in zip(s, before[i], strict=True) for x, y in zip(v, o, strict=True)}
    assert len(noise) > 0.99 * 6 * N * C


@pytest.fixture
def twins(spark):
    """Two classes of samples with four equal channels, and the same samples with one.  Four
    whole-numbered channels double every distance exactly, so ties are settled alike."""
    rows = [(i, i % 2, 1, [float((i + 2) * ((t * (3 + i % 3)) % 7)) for t in range(N)]) for i in range(8)]
    schema = "sample_id int, label int, round int, series "
    return (spark.createDataFrame([(*r[:3], [[x] * 4 for x in r[3]]) for r in rows], schema + "array<array<double>>"),
            spark.createDataFrame(rows, schema + "array<double>"))


@pytest.mark.parametrize("op", [
    lambda d: A.window_warp(d, 2), lambda d: A.spawner(d, 1, sigma=0.0), lambda d: A.wdba(d, 1, 4), lambda d: A.random_guided_warp(d, 1),
    lambda d: A.random_guided_warp(d, 1, shape=True), lambda d: A.discriminative_guided_warp(d, 1, 4),
    lambda d: A.discriminative_guided_warp(d, 1, 4, shape=True, variable_slice=False)])
def test_one_path_for_all_channels(twins, op):
    """Equal channels stay equal, and are what one channel alone becomes."""
    got, want = (series(op(d)) for d in twins)
    assert got.keys() == want.keys() and any(want[i] != s for i, s in series(twins[1]).items())
    for i, s in got.items():
        assert len(s) == N
        for c in range(4):
            assert [v[c] for v in s] == pytest.approx(want[i])


def test_splines_differ_by_channel(twins):
    for op in (A.magnitude_warp, A.time_warp):
        for i, s in series(op(twins[0], 3)).items():
            columns = {tuple(round(v[c], 9) for v in s) for c in range(4)}
            assert len(columns) == 4, (op, i)


def test_paths_weigh_all_channels(spark):
    """A path follows the channel that moves; the other one is carried along."""
    step = [0.0] * 15 + [9.0] * 25
    late = [0.0] * 17 + [9.0] * 23
    rows = [(0, 0, 1, [[x, 100.0 * (t > 20)] for t, x in enumerate(step)]), (1, 0, 1, [[x, 100.0 * (t > 18)] for t, x in enumerate(late)])]
    got = series(A.random_guided_warp(spark.createDataFrame(rows, "sample_id int, label int, round int, series array<array<double>>"), 0))
    plain = series(A.random_guided_warp(spark.createDataFrame([(*r[:3], [v[0] for v in r[3]]) for r in rows],
                                                              "sample_id int, label int, round int, series array<double>"), 0))
    assert [v[0] for v in got[0]] != plain[0]
