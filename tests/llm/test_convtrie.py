import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sensorlab.llm import convtrie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            d = hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).digest()[:16]
            by[c].append((t is not None, t or 0, d, r or "", x or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}
    whole = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + v[h:])
    members, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, s in whole.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            kids[s[:-1]].add(s)
    leaves, saved = defaultdict(int), defaultdict(int)
    for s, m in members.items():
        for d in range(len(s) + 1):
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1].encode()) if s else 0
            leaves[s[:d]] += not kids[s]
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else -1, len(m), len(kids[s]), leaves[s], saved[s],
                   hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()) for s, m in members.items())


def run(make, rows, **sizes):
    df = make([(*r, "old") for r in rows], SCHEMA)
    got = convtrie.prefix_trie(df, **sizes).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in got)


def odd_rows(seed, convs=120, long=40):
    """Few different turns, so that prefixes are shared at every depth; copies, nested prefixes, a long conversation."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, convs), 1005, 1010]:
        n = long if c in (7, 22) else rng.choice([0, 1, 2, 3, 9, 10, 12, 15])
        for t in range(n):
            text = rng.choice(["a", "b", None, "é" * 3]) if c not in (7, 22, 31) else "same"
            rows.append((c, t if rng.random() < .9 else None, rng.choice(["u", None]) if t % 4 == 0 else "u", text))
    rows += [(3, 1, "u", "a")] * 3 + [(None, 0, "u", "lost"), (500, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"segment": 4, "block": 7, "fan_in": 2}, {"segment": 1, "block": 2, "fan_in": 3}])
def test_nodes_match_brute_force(make, sizes):
    rows = odd_rows(len(sizes))
    assert run(make, rows, **sizes) == brute(rows)


def test_copies_of_one_conversation(make):
    rows = [(c, t, "u", f"x{t}") for c in range(60) for t in range(12)]
    assert run(make, rows, block=5, fan_in=2) == brute(rows)


def test_nested_prefixes_cross_blocks(make):
    rows = [(c, t, "u", "x") for c in range(5, 45) for t in range(c)]
    assert run(make, rows, segment=3, block=4, fan_in=2) == brute(rows)


def test_role_and_text_are_kept_apart(make):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "", "abc"), (4, 0, None, "abc")]
    rows = [(c, t, r, x) for c, _, r, x in rows for t in range(9)]
    assert run(make, rows) == brute(rows)


def test_turnless_and_none(make):
    rows = [(c, 0, "u", "x") for c in (1, 2, 3, 4)]  # bases are absent, own turns are cut
    assert run(make, rows) == brute(rows)
    assert run(make, []) == [] and run(make, [(None, 1, "u", "x")]) == []


def test_long_text(make):
    rows = [(c, t, "u", "word " * 30_000 + str(t)) for c in (5, 6) for t in range(10)]
    assert run(make, rows) == brute(rows)


def test_digest_of_many_members(make):
    df = make([(b"k" * 32, c) for c in range(5000)] + [(b"j" * 32, 7)], "prefix binary, conv_id long", 6)
    got = {bytes(r.prefix): r.ends_sha256 for r in convtrie.member_digests(df, id_text=100).collect()}
    assert got == {b"k" * 32: hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest(), b"j" * 32: hashlib.sha256(b"7").hexdigest()}


def test_borders_leave_little(make):
    """A block whose conversations share only their first turn is contracted to its two ends."""
    items = [{"lcp": 1, "edge_prefix": b"p", "edge_below": 1, "depth": 5, "prefix": bytes([i % 256, i // 256]), "below": 9, "conv_id": i,
              "n": 1, "children": 0, "leaves": 0, "bag": 0} for i in range(1000)]
    done, keep = convtrie.merge_block(items, False)
    assert len(keep) == 2 and len(done) == 999
