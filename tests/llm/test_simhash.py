import random

import numpy as np
import xxhash

from sensorlab.llm import simhash

from .conftest import ODD_TEXTS


def brute_fp(text, width=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, max_bits):
    """Smallest node reachable from every node, by search."""
    left, out = set(nodes), {}
    while left:
        todo, seen = [min(left)], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [y for y in left if y not in seen and bin(x ^ y).count("1") <= max_bits]
        left -= seen
        out |= dict.fromkeys(seen, seen)
    return out


def test_majority_bits():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    first = np.array([0, 0, 1, 3, 300, 1300, 1300, 3000])
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[i:j]) > j - i)
            for i, j in zip(first, first[1:], strict=False)]
    assert simhash.majority_bits(h, first).tolist() == want


def fingerprints(seed):
    """Far values, chains of one and two bits, and a dense ball around one value (large buckets)."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        out.add(x)
        for _ in range(rng.choice([0, 1, 6])):
            for _ in range(rng.choice([1, 2, 3])):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    c = rng.getrandbits(64)
    for _ in range(150):
        y = c
        for b in rng.sample(range(64), rng.choice([1, 2, 3])):
            y ^= 1 << b
        out.add(y)
    return sorted(out)


def test_links_have_all_components(make):
    for max_bits, segments in ((2, 5), (2, 7), (1, 4), (2, 3)):
        fps = fingerprints(segments)
        df = make([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
        edges = simhash.links(df, max_bits, segments)
        got = {(r.a, r.b) for r in edges.collect()}
        assert all(bin((a ^ b) & ((1 << 64) - 1)).count("1") <= max_bits for a, b in got)
        roots = {r.node: r.root for r in simhash.components(edges).collect()}
        signed = {x: x - (1 << 64) if x >> 63 else x for x in fps}
        for x, comp in brute_components(fps, max_bits).items():
            assert roots.get(signed[x], signed[x]) == min(signed[y] for y in comp)


def sample_docs():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(30):
        w = [rng.choice(vocab) for _ in range(rng.choice([2, 30, 200]))]
        docs.append((len(docs) + 10, " ".join(w)))
        for _ in range(rng.choice([0, 1, 4])):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            docs.append((len(docs) + 10, "\n".join(v)))
        if i % 3 == 0:
            docs.append((len(docs) + 10, " ".join(w).upper()))
    return docs + [(5000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, docs[0][1]), (3, ""), (3, "")]


def test_components_of_documents(make):
    docs = sample_docs()
    got = simhash.near_duplicates(make([(i, t, 1) for i, t in docs], "doc_id long, text string, fp int"))
    fps = {t: brute_fp(t) for _, t in docs}
    comps = brute_components(set(fps.values()), 2)
    ids = {}
    for i, t in docs:
        for f in comps[fps[t]]:
            if i is not None:
                ids.setdefault(f, set()).add(i)
    want = sorted((-1 if i is None else i, fps[t], min(ids[fps[t]])) for i, t in docs)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fp & ((1 << 64) - 1), r.component_id) for r in got.collect()) == want


def test_keep_one(make):
    docs = sample_docs()
    kept = simhash.keep_one(make([(i, t, "c") for i, t in docs], "doc_id long, text string, fp string")).collect()
    fps = {t: brute_fp(t) for _, t in docs}
    comps = brute_components(set(fps.values()), 2)
    groups = {frozenset(c) for c in comps.values()}
    assert len(kept) == len(groups)
    best = {g: min(i for i, t in docs if i is not None and fps[t] in g) for g in groups}
    assert sorted(r.doc_id for r in kept) == sorted(best.values())


def test_empty_table(make):
    df = make([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_one(df).count() == 0


def test_segments_grow_with_the_fingerprints(spark, monkeypatch):
    """More fingerprints, more segments, longer keys; the components stay the same."""
    bits = [simhash.Ring(2, s) for _, s in simhash.SEGMENTS]
    assert [sum(len(p) for p in r.parts[:r.exact]) for r in bits] == sorted(sum(len(p) for p in r.parts[:r.exact]) for r in bits)
    rng = random.Random(5)
    fps = {rng.getrandbits(63) for _ in range(200)}
    fps |= {f ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for f in list(fps)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = {frozenset(p) for p in ((a, b) for a in fps for b in fps) if p[0] < p[1] and bin(p[0] ^ p[1]).count("1") <= 2}
    for levels in (((1 << 62, 5),), ((1 << 62, 9),), ((100, 5), (1 << 62, 17))):
        monkeypatch.setattr(simhash, "SEGMENTS", levels)
        assert {frozenset((r.a, r.b)) for r in simhash.links(df).collect()} == want
