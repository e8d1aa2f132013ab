"""Byte-level BPE: pre-tokenisation by automaton scans, cached pair merging, decoding.

A text's code points are mapped to classes (letter, number, white space, other,
with the lookahead the pattern needs folded into the class).  Each class acts on
the states of a small automaton as a transition function; these functions form
a finite monoid whose product is one table lookup.  The prefix products of a
chunk are taken lane by lane for all lanes at once and then across lanes, which
gives the state before every code point and so the token borders, without a
regular expression and without a loop over characters.

The slices between borders are looked up in a cache of encoded pieces; pieces
not seen yet are merged together, many at a time, with the lowest rank first.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbytes import append_columns, chunks, string_buffers

# Classes of code points: fixed by the pattern
#   's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
LETTER, NUMBER, OTHER, APOS1, APOS2, SPACE_JOIN, SPACE_LAST, SPACE = range(8)
# White_Space of Unicode, as the pattern's \s means it.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters and numbers that Unicode 16 added; Python 3.13 knows Unicode 15.1, the pattern's engine 16.
LETTERS_16 = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
              (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
              (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
              (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
              (0x1E5F0, 0x1E5F0)]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
              (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

# States: what the next code point may continue.
_NONE, _LETTERS, _NUMBERS, _OTHERS, _SPACES, _JOIN, _APOS_1, _APOS_2 = range(8)
_LANE = 256
#: Pieces longer than this are merged one by one with a heap.
_LONG_PIECE = 48
#: Encoded pieces kept by a task; the cache starts anew beyond that.
CACHE_PIECES = 200_000


def _step(state: int, cls: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at this code point."""
    if cls == LETTER and state in (_APOS_1, _APOS_2):
        return (_NONE if state == _APOS_1 else _APOS_1), False
    run = {LETTER: _LETTERS, NUMBER: _NUMBERS, OTHER: _OTHERS, APOS1: _OTHERS, APOS2: _OTHERS}.get(cls)
    if run is not None and state in (run, _JOIN):
        return run, False
    if cls in (APOS1, APOS2):  # a contraction, as no run goes on here
        return (_APOS_1 if cls == APOS1 else _APOS_2), True
    if cls == SPACE:  # more white space or the end of the text follows
        return _SPACES, state != _SPACES
    return {SPACE_JOIN: _JOIN, SPACE_LAST: _NONE}.get(cls, run), True


class _Monoid:
    """Transition functions of all class sequences, numbered; ``mul[f, g]`` is
    f followed by g.  Generators 0-7 are the classes, 8-15 the same classes as
    first of a text (they forget the state)."""

    def __init__(self):
        base = [tuple(_step(s, c)[0] for s in range(8)) for c in range(8)]
        gens = base + [(f[_NONE],) * 8 for f in base]
        funcs = list(dict.fromkeys([tuple(range(8)), *gens]))
        at = {f: i for i, f in enumerate(funcs)}
        i = 0
        while i < len(funcs):  # closure under appending one class
            for g in gens:
                h = tuple(g[s] for s in funcs[i])
                if h not in at:
                    at[h] = len(funcs)
                    funcs.append(h)
            i += 1
        self.apply = np.array(funcs, np.uint8)
        self.generator = np.array([at[g] for g in gens], np.uint16)
        self.mul = np.array([[at[tuple(g[s] for s in f)] for g in funcs] for f in funcs], np.uint16)
        self.identity = 0


@lru_cache(1)
def _scan_tables():
    m = _Monoid()
    starts = np.array([[_step(s, c)[1] for c in range(8)] for s in range(8)])
    return m, starts


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point, without lookahead (apostrophe: APOS1)."""
    t = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(cp))[0]
        if k in "LN":
            t[cp] = LETTER if k == "L" else NUMBER
    for cls, spans in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16)):
        for a, b in spans:
            t[a:b + 1] = cls
    t[WHITE] = SPACE
    t[0x27] = APOS1
    return t


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions of the code points of UTF-8 data, and the code points."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data[lead].astype(np.int32)
    wide = np.flatnonzero(cp >= 0xC0)
    if len(wide):
        b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32) & 0x3F
        at, first = lead[wide], cp[wide]
        two, three, four = first < 0xE0, (first >= 0xE0) & (first < 0xF0), first >= 0xF0
        val = np.where(two, (first & 0x1F) << 6 | b[at + 1], 0)
        val = np.where(three, (first & 0x0F) << 12 | b[at + 1] << 6 | b[at + 2], val)
        val = np.where(four, (first & 0x07) << 18 | b[at + 1] << 12 | b[at + 2] << 6 | b[at + 3], val)
        cp[wide] = np.minimum(val, sys.maxunicode)
    return lead, cp


def token_borders(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte positions where tokens start in the texts data[off[i]:off[i+1]]."""
    if not len(data):
        return np.zeros(0, np.int64)
    monoid, starts = _scan_tables()
    lead, cp = _code_points(data)
    n = len(cp)
    cls = _classes()[cp]
    head = np.zeros(n, bool)
    head[np.searchsorted(lead, off[:-1][off[:-1] < off[1:]])] = True
    tail = np.ones(n, bool)
    tail[:-1] = head[1:]  # last of its text
    # lookahead: white space before a non-space, apostrophes before the letters of a contraction
    nxt = np.concatenate([cls[1:], [SPACE]])
    last_space = (cls == SPACE) & (nxt != SPACE) & ~tail
    cls[last_space] = np.where(cp[last_space] == 32, SPACE_JOIN, SPACE_LAST)
    apos = np.flatnonzero(cls == APOS1)
    if len(apos):
        ext = np.concatenate([cp, [0, 0]])
        stop = np.concatenate([tail, [True, True]])
        c1, c2 = np.where(stop[apos], 0, ext[apos + 1]), np.where(stop[apos] | stop[apos + 1], 0, ext[apos + 2])
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        cls[apos] = np.where(one, APOS1, np.where(two, APOS2, OTHER))
    # prefix products: along lanes of _LANE code points for all lanes at once, then across lanes
    lanes = -(-n // _LANE)
    x = np.full(lanes * _LANE, monoid.identity, np.uint16)
    x[:n] = monoid.generator[cls + 8 * head]
    x = np.ascontiguousarray(x.reshape(lanes, _LANE).T)
    size = len(monoid.apply)
    mul = monoid.mul.ravel()
    for k in range(1, _LANE):
        x[k] = mul[x[k - 1].astype(np.int32) * size + x[k]]
    state_in = np.empty(lanes, np.uint8)
    s = _NONE
    whole = monoid.apply[x[-1]]
    for i in range(lanes):
        state_in[i] = s
        s = whole[i, s]
    before = np.empty((_LANE, lanes), np.uint8)
    before[0] = state_in
    before[1:] = monoid.apply[x[:-1], state_in]
    before = np.ascontiguousarray(before.T).ravel()[:n]
    return lead[starts[before, cls] | head]


class Vocabulary:
    """Merge ranks (token bytes to id) and their lookup tables."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for t, i in self.ranks.items():
            tokens[i] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for t, i in self.ranks.items():
            for k in range(1, len(t)):
                a, b = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        # open hash table of pairs, filled in order of probe distance
        self.mask = (1 << (4 * len(pairs)).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.vals = np.zeros(self.mask + 1, np.int32)
        key, val = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            first = np.zeros(len(key), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.vals[slot[put]] = key[put], val[put]
            key, val, slot = key[~put], val[~put], (slot[~put] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(33)).astype(np.int64) & self.mask

    NO_PAIR = np.iinfo(np.int32).max

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, NO_PAIR where there is none."""
        key = a << 32 | b
        out = np.full(len(key), self.NO_PAIR, np.int32)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            got = self.keys[slot]
            same = got == key[todo]
            out[todo[same]] = self.vals[slot[same]]
            more = ~same & (got >= 0)
            todo, slot = todo[more], (slot[more] + 1) & self.mask
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Encode pieces: ids of each as little-endian unsigned 32-bit integers.
        All pieces merge their leftmost pair of lowest rank in the same step."""
        out: list[bytes] = [b""] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > _LONG_PIECE:
                out[i] = np.array(self._merge_long(p), "<u4").tobytes()
            else:
                rest.append(i)
        if not rest:
            return out
        sizes = np.array([len(pieces[i]) for i in rest], np.int64)
        ids = self.bytes[np.frombuffer(b"".join([pieces[i] for i in rest]), np.uint8)]
        owner = np.repeat(np.arange(len(rest)), sizes)
        done_ids, done_owner = [], []
        rank = np.full(len(ids), self.NO_PAIR, np.int32)  # of the pair that begins here
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.pair_ranks(ids[inner], ids[inner + 1])
        while len(ids):
            head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            low = np.minimum.reduceat(rank, head)
            count = np.diff(np.concatenate([head, [len(ids)]]))
            over = np.repeat(low == self.NO_PAIR, count)  # pieces with nothing left to merge
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                ids, owner, rank = ids[~over], owner[~over], rank[~over]
                keep = low != self.NO_PAIR
                low, count = low[keep], count[keep]
                if not len(ids):
                    break
                head = np.concatenate([[0], np.cumsum(count)[:-1]])
            spot = np.where(rank == np.repeat(low, count), np.arange(len(ids)), len(ids))
            at = np.minimum.reduceat(spot, head)
            ids[at] = rank[at]
            gone = np.zeros(len(ids), bool)
            gone[at + 1] = True
            ids, owner, rank = ids[~gone], owner[~gone], rank[~gone]
            at = at - np.arange(len(at))  # positions after the removals
            for spot in (at, at[at > 0] - 1):
                nxt = np.minimum(spot + 1, len(ids) - 1)
                joined = (spot + 1 < len(ids)) & (owner[spot] == owner[nxt])
                rank[spot] = np.where(joined, self.pair_ranks(ids[spot], ids[nxt]), self.NO_PAIR)
        all_ids, all_owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(all_owner, kind="stable")
        raw = all_ids[order].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(all_owner, minlength=len(rest)))
        at = 0
        for i, e in zip(rest, ends.tolist(), strict=True):
            out[i] = raw[at:e]
            at = e
        return out

    def _pair(self, a: int, b: int) -> int:
        return int(self.pair_ranks(np.array([a], np.int64), np.array([b], np.int64))[0])

    def _merge_long(self, piece: bytes) -> list[int]:
        """One long piece: a heap of (rank, position) over a linked list."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)]
        first = self.pair_ranks(ids[:-1], ids[1:])
        ids = ids.tolist()
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != self.NO_PAIR]
        heapify(heap)
        alive = [True] * n
        while heap:
            r, i, a, b = heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = r, False
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n:
                    q = self._pair(ids[x], ids[y])
                    if q != self.NO_PAIR:
                        heappush(heap, (q, x, ids[x], ids[y]))
        return [ids[i] for i in range(n) if alive[i]]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.offsets[ids] - (ends - size), size)
        return self.data[shift + np.arange(total)]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes chunks of texts; keeps the pieces it has merged."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.cache: dict[bytes, bytes] = {}

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Ids of every piece (little-endian bytes), and where the pieces start."""
        begin = token_borders(data, off)
        raw = data.tobytes()
        at = begin.tolist()
        pieces = [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)]
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        new = list(set(pieces).difference(self.cache))
        self.cache.update(zip(new, self.vocab.merge_many(new), strict=True))
        return list(map(self.cache.__getitem__, pieces)), begin


def encode(docs: DataFrame, ranks_path: str, text_col: str = "text", check: bool = False) -> DataFrame:
    """Append ``n_tokens`` (bigint), ``ids`` (binary: little-endian unsigned
    32-bit token ids) and ``offsets`` (binary: little-endian unsigned 32-bit
    byte positions in the text where each token begins).

    The text is split by the byte-level pattern and every piece merged by the
    ranks in ``ranks_path`` (a file that every node has), without special
    tokens.  A null text counts as empty: no ids.  Existing columns of these
    names are replaced; others, and repeated rows, are kept.  With ``check``
    the ids are decoded in the same task, and ``intact`` says whether they give
    the text back.
    """
    def make():
        enc = Encoder(vocabulary(ranks_path))
        size = enc.vocab.lengths

        def fn(batch: pa.RecordBatch):
            data, off = string_buffers(batch.column(0))
            ids, offs, count, intact = [], [], [], []
            for lo, hi, part, o in chunks(data, off):
                coded, begin = enc.encode(part, o)
                at = np.searchsorted(begin, o)
                for d in range(hi - lo):
                    b = b"".join(coded[at[d]:at[d + 1]])
                    one = np.frombuffer(b, "<u4")
                    ends = np.cumsum(size[one])
                    ids.append(b)
                    offs.append((ends - size[one]).astype("<u4").tobytes())
                    count.append(len(one))
                    if check:
                        intact.append(bool(np.array_equal(enc.vocab.decode(one), part[o[d]:o[d + 1]])))
            out = [pa.array(count, pa.int64()), pa.array(ids, pa.binary()), pa.array(offs, pa.binary())]
            return [*out, pa.array(intact, pa.bool_())] if check else out
        return fn
    fields = [("n_tokens", "bigint"), ("ids", "binary"), ("offsets", "binary")] + [("intact", "boolean")] * check
    return append_columns(docs, fields, make, [text_col])


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """Append ``decoded`` (binary): the bytes of the ids in ``ids_col``.  Null
    or empty ids decode to no bytes."""
    def make():
        vocab = vocabulary(ranks_path)

        def fn(batch: pa.RecordBatch):
            data, off = string_buffers(batch.column(0))
            out = []
            for lo, hi, part, o in chunks(data, off):
                ids = np.frombuffer(part.tobytes(), "<u4")
                size = np.concatenate([[0], np.cumsum(vocab.lengths[ids])])[o // 4]
                raw = vocab.decode(ids).tobytes()
                out += [raw[a:b] for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
            return [pa.array(out, pa.binary())]
        return fn
    return append_columns(tokens, [("decoded", "binary")], make, [ids_col])

