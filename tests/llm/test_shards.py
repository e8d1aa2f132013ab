from collections import Counter
from math import comb

from pyspark.sql import functions as F

from sensorlab.llm import shards


def test_hypergeometric_draws(spark):
    """Quantiles over an even grid give the exact distribution."""
    grid = 20_000
    for t, k, n in ((10, 4, 5), (50, 1, 20), (30, 30, 7), (40, 39, 39), (1000, 25, 500), (9, 8, 1)):
        u = (F.col("id") + 0.5) / grid
        x = shards.hypergeometric(u, F.lit(t), F.lit(k), F.lit(n))
        got = {r.x: r["count"] / grid for r in spark.range(grid).select(x.alias("x")).groupBy("x").count().collect()}
        for i in range(max(0, n + k - t), min(n, k) + 1):
            p = comb(k, i) * comb(t - k, n - i) / comb(t, n)
            assert abs(got.get(i, 0) - p) <= 1 / grid
        assert all(max(0, n + k - t) <= i <= min(n, k) for i in got)


def test_large_draws_lie_around_the_mean(spark):
    u = (F.col("id") + 0.5) / 16
    x = shards.hypergeometric(u, F.lit(4_000_000_000), F.lit(100_000_000), F.lit(2_000_000_000))
    off = [r.x - 50_000_000 for r in spark.range(16).select(x.alias("x")).collect()]
    assert max(map(abs, off)) < 5 * 4938 and min(off) < 0 < max(off)  # one standard deviation is 4937


def test_matrix_margins_and_spread(make):
    blocks = [5, 0, 17, 3, 8, 1, 1, 30, 2, 2, 2]
    want = [14, 14, 14, 14, 13, 2]
    df = make(list(enumerate(blocks)), "pos long, n long")
    seen = Counter()
    for seed in range(4):
        rows = shards.communication_matrix(df, want, seed).collect()
        assert {r.pos: sum(r.counts) for r in rows} == dict(enumerate(blocks))
        assert [sum(c) for c in zip(*[r.counts for r in rows], strict=True)] == want
        assert all(c >= 0 for r in rows for c in r.counts)
        seen[str(sorted((r.pos, r.counts) for r in rows))] += 1
    assert len(seen) == 4


def table(make, n):
    return make([(i % 97 if i % 5 else None, f"t{i % 11}" if i % 7 else None, "old") for i in range(n)],
                "doc_id long, text string, slot string", 6)


def test_shards_are_exact(make, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK_ROWS", 40)
    monkeypatch.setattr(shards, "PART_ROWS", 13)
    df = table(make, 500)
    out = shards.shuffle_into_shards(df, 7, ["doc_id", "text"], seed=3).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in df.collect())
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(7))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_every_place_is_as_likely(make):
    """A row's shard and slot are spread evenly over seeds."""
    df = make([(i,) for i in range(12)], "doc_id long", 3).cache()
    shard = Counter()
    for seed in range(12):
        for r in shards.shuffle_into_shards(df, 3, ["doc_id"], seed).collect():
            shard[r.doc_id, r.shard] += 1
    assert max(shard.values()) < 12 and len(shard) > 30  # 36 cells, 4 expected in each


def test_few_rows_and_none(make, tmp_path, spark):
    assert shards.shuffle_into_shards(table(make, 0), 40, ["doc_id"]).count() == 0
    out = shards.shuffle_into_shards(table(make, 3), 40, ["doc_id"])
    assert sorted((r.shard, r.slot) for r in out.collect()) == [(0, 0), (1, 0), (2, 0)]
    shards.write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3


def test_a_shuffle_in_every_respect(make, monkeypatch):
    """Rows of every input block, and of every stretch of ids, spread over shards and slots as chance has it:
    chi-square of (block, shard) and (id range, slot range), rank correlation and neighbours within the shards."""
    monkeypatch.setattr(shards, "BLOCK_ROWS", 700)
    monkeypatch.setattr(shards, "PART_ROWS", 150)
    n, k = 6000, 5
    df = make([(i,) for i in range(n)], "doc_id long", 4)
    first = None
    for seed in range(4):
        out = [(r.doc_id, r.shard, r.slot) for r in shards.shuffle_into_shards(df, k, ["doc_id"], seed).collect()]
        first = first or sorted(out)
        assert seed == 0 or sorted(out) != first  # another seed, another shuffle
        assert {(s, j) for _, s, j in out} == {(s, j) for s in range(k) for j in range(n // k)}
        for cells in (Counter((d * 10 // n, s) for d, s, _ in out), Counter((d * 10 // n, j * 5 * k // n) for d, _, j in out)):
            expected = n / (10 * 5)
            chi = sum((cells[a, b] - expected) ** 2 / expected for a in range(10) for b in range(5))
            assert 9 < chi < 80, chi  # 36 degrees of freedom: mean 36, standard deviation 8.5
        for s in range(k):
            order = [d for d, x, j in sorted(out, key=lambda r: r[2]) if x == s]
            m = len(order)
            rank = {d: i for i, d in enumerate(sorted(order))}
            rho = 1 - 6 * sum((rank[d] - i) ** 2 for i, d in enumerate(order)) / (m * (m * m - 1))
            assert abs(rho) < 4.5 / m ** 0.5
            rises = sum(a < b for a, b in zip(order, order[1:], strict=False))
            assert abs(rises - (m - 1) / 2) < 4.5 * (m / 12) ** 0.5
