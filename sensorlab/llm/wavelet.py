"""Token shards as wavelet matrices: succinct bit planes with rank and select.

A shard holds the tokens of a run of documents, most significant bit first: each
plane stores one bit of every token, and the tokens are stably parted by it (0
before 1) for the next plane.  With running bit counts per 512 bits a token, the
count of a token up to a position, and the position of its k-th occurrence are
each found with one step per plane, without unpacking the shard.

The planes hold ranks in the shard's own alphabet (its distinct token ids).

File (little endian): magic ``WVMX``, planes (u32), tokens (u64), documents
(u64), alphabet size (u64); the alphabet (u32); per document: has id (u8), then
ids (i64), then token counts (u64); per plane: zeros (u64); then per plane the
bits as 64-bit words, and the ones before each block of 512 bits (u64).
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import filesystem, folder, stored, write_file
from .textbytes import LOWER, chunks, limit_batches, runs, slice_hashes, string_buffers

_MAGIC = b"WVMX"
_BLOCK = 512
#: A shard file is closed once it holds so many tokens.
SHARD_TOKENS = 1 << 21
#: Encoded words that make one generation of a task's cache.
CACHE_WORDS = 200_000
#: Bytes encoded together.
ENCODE_BYTES = 2 << 20
# Lower-case letters of ASCII and Latin-1 in UTF-8: what composing and lower-casing leave alone.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
# The byte-level alphabet (fixed): printable bytes stand for themselves, the others for 256 and up in turn.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_STRETCH = np.ones(256, bool)
_STRETCH[[9, 10, 11, 12, 13, 32]] = False
_LETTER, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = True
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True


class WaveletMatrix:
    """A sequence of unsigned integers below 2 ** planes."""

    def __init__(self, n: int, words: list[np.ndarray], zeros: list[int], ones: list[np.ndarray]):
        self.n, self.words, self.zeros, self.ones = n, words, zeros, ones

    @classmethod
    def build(cls, tokens: np.ndarray, planes: int) -> WaveletMatrix:
        words, zeros, ones = [], [], []
        kind = np.uint16 if planes <= 16 else np.uint32
        cur = np.asarray(tokens).astype(kind)
        blocks = len(cur) // _BLOCK + 1
        for k in range(planes - 1, -1, -1):
            bit = (cur & kind(1 << k)) != 0
            packed = np.zeros(blocks * _BLOCK // 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[:len(raw)] = raw
            w = packed.view(np.uint64)
            count = np.bitwise_count(w).reshape(blocks, -1).sum(axis=1, dtype=np.uint64)
            words.append(w)
            ones.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(count, dtype=np.uint64)[:-1]]))
            cur = np.concatenate([cur.compress(~bit), cur.compress(bit)])
            zeros.append(int(len(bit) - bit.sum()))
        return cls(len(tokens), words, zeros, ones)

    def _ones_before(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Rank: ones of a plane in front of each position."""
        block = at // _BLOCK
        w = self.words[plane].reshape(-1, _BLOCK // 64)[block]
        left = np.clip((at % _BLOCK)[:, None] - 64 * np.arange(_BLOCK // 64), 0, 64).astype(np.uint64)
        mask = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << (left & np.uint64(63))) - np.uint64(1))
        inside = np.bitwise_count(w & mask).sum(axis=1, dtype=np.int64)
        return self.ones[plane][block].astype(np.int64) + inside

    def _bit(self, plane: int, at: np.ndarray) -> np.ndarray:
        return (self.words[plane][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def access(self, at) -> np.ndarray:
        """Tokens at the given positions."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.uint32)
        for p in range(len(self.words)):
            bit, one = self._bit(p, at), self._ones_before(p, at)
            out = out << np.uint32(1) | bit
            at = np.where(bit, self.zeros[p] + one, at - one)
        return out

    def _range(self, token: int, at: np.ndarray) -> tuple[int, np.ndarray]:
        """Where the token's run begins in the last order, and each position carried there."""
        ends = np.concatenate([[0], at]).astype(np.int64)
        planes = len(self.words)
        for p in range(planes):
            one = self._ones_before(p, ends)
            ends = self.zeros[p] + one if token >> (planes - 1 - p) & 1 else ends - one
        return int(ends[0]), ends[1:]

    def rank(self, token: int, at) -> np.ndarray:
        """Occurrences of the token before each position."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        if token >> len(self.words):
            return np.zeros(len(at), np.int64)
        begin, ends = self._range(token, at)
        return ends - begin

    def count(self, token: int) -> int:
        return int(self.rank(token, self.n)[0])

    def select(self, token: int, k) -> np.ndarray:
        """Positions of the k-th occurrences (from 0) of the token."""
        at = self._range(token, np.zeros(0, np.int64))[0] + np.atleast_1d(np.asarray(k, np.int64))
        planes = len(self.words)
        for p in range(planes - 1, -1, -1):
            if token >> (planes - 1 - p) & 1:
                at = self._select_bit(p, at - self.zeros[p], True)
            else:
                at = self._select_bit(p, at, False)
        return at

    def _select_bit(self, plane: int, k: np.ndarray, one: bool) -> np.ndarray:
        """Positions of the k-th ones or zeros of a plane, by halving over ranks."""
        lo, hi = np.zeros(len(k), np.int64), np.full(len(k), self.n, np.int64)
        while np.any(lo < hi):
            mid = (lo + hi) // 2
            before = self._ones_before(plane, mid + 1)
            if not one:
                before = mid + 1 - before
            far = before > k
            hi, lo = np.where(far & (lo < hi), mid, hi), np.where(~far & (lo < hi), mid + 1, lo)
        return lo

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of the token, ascending."""
        return self.select(token, np.arange(self.count(token)))

    def decode(self) -> np.ndarray:
        """The whole sequence: undo the partings plane by plane."""
        kind = np.uint16 if len(self.words) <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for k, (w, z) in enumerate(zip(reversed(self.words), reversed(self.zeros), strict=True)):
            bit = np.unpackbits(w.view(np.uint8), count=self.n, bitorder="little").astype(bool)
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~bit)] = cur[:z]
            out[np.flatnonzero(bit)] = cur[z:] | kind(1 << k)
            cur = out
        return cur.astype(np.uint32)


class TokenShard:
    """Tokens of a run of documents: a wavelet matrix over the shard's alphabet."""

    def __init__(self, matrix: WaveletMatrix, alphabet: np.ndarray, ids: list[int | None], counts: np.ndarray):
        self.matrix, self.alphabet, self.ids, self.counts = matrix, alphabet, ids, counts

    @classmethod
    def build(cls, tokens: np.ndarray, ids: list[int | None], counts: np.ndarray) -> TokenShard:
        tokens = np.asarray(tokens, np.uint32)
        seen = np.bincount(tokens)
        alphabet = np.flatnonzero(seen)
        seen[alphabet] = np.arange(len(alphabet))
        planes = max(1, (len(alphabet) - 1).bit_length() if len(alphabet) else 0)
        return cls(WaveletMatrix.build(seen[tokens], planes), alphabet.astype(np.uint32), ids, np.asarray(counts, np.uint64))

    def _rank_of(self, token: int) -> int | None:
        i = int(np.searchsorted(self.alphabet, token))
        return i if i < len(self.alphabet) and self.alphabet[i] == token else None

    def tokens(self) -> np.ndarray:
        return self.alphabet[self.matrix.decode()]

    def access(self, at) -> np.ndarray:
        return self.alphabet[self.matrix.access(at)]

    def rank(self, token: int, at) -> np.ndarray:
        r = self._rank_of(token)
        return np.zeros(len(np.atleast_1d(at)), np.int64) if r is None else self.matrix.rank(r, at)

    def count(self, token: int) -> int:
        return int(self.rank(token, self.matrix.n)[0])

    def occurrences(self, token: int) -> np.ndarray:
        r = self._rank_of(token)
        return np.zeros(0, np.int64) if r is None else self.matrix.occurrences(r)

    def to_bytes(self) -> bytes:
        m = self.matrix
        parts = [_MAGIC, struct.pack("<IQQQ", len(m.words), m.n, len(self.ids), len(self.alphabet)),
                 self.alphabet.astype("<u4").tobytes(), bytes(i is not None for i in self.ids),
                 np.array([i or 0 for i in self.ids], "<i8").tobytes(), self.counts.astype("<u8").tobytes(),
                 np.array(m.zeros, "<u8").tobytes()]
        for w, o in zip(m.words, m.ones, strict=True):
            parts += [w.tobytes(), o.tobytes()]
        return b"".join(parts)

    @classmethod
    def load(cls, data: bytes) -> TokenShard:
        if data[:4] != _MAGIC:
            raise ValueError("not a token shard")
        planes, n, docs, letters = struct.unpack_from("<IQQQ", data, 4)
        at = 4 + struct.calcsize("<IQQQ")

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, dtype, count, at)
            at += x.nbytes
            return x
        alphabet, has = take("<u4", letters), take("u1", docs).tolist()
        ids = [i if h else None for i, h in zip(take("<i8", docs).tolist(), has, strict=True)]
        counts, zeros = take("<u8", docs), take("<u8", planes).tolist()
        blocks = n // _BLOCK + 1
        words, ones = [], []
        for _ in range(planes):
            words.append(take("<u8", blocks * _BLOCK // 64))
            ones.append(take("<u8", blocks))
        return cls(WaveletMatrix(n, words, zeros, ones), alphabet, ids, counts)


class WordEncoder:
    """Encodes texts with a ``tokenizers`` file, no special tokens added.

    With ``added_tokens`` the strings of the file's special tokens stand for
    their ids wherever a text has them, as the library reads them by default;
    without it they are ordinary text.  They are found in the text as it stands,
    before any lower-casing, the leftmost and longest first, and white space
    takes their place for the rest of the work.

    Only for a byte-level tokenizer that composes and lower-cases the text,
    drops white space and works on runs of letters, digits and other
    characters, each by itself (as word_bpe_49k does).  Then a text is the
    sequence of its stretches between white space, the case of A-Z is without
    effect, and a stretch may be cut where a symbol follows a letter a-z.
    Stretches are grouped by a 64-bit hash within a chunk, compared byte by byte,
    looked up by their bytes, and encoded by the library once: a run of letters that is
    lower case and composed as it stands goes to the library's model in the
    byte-level alphabet, all others through the whole tokenizer.  The cache has
    two generations, so that frequent stretches outlive rare ones.
    """

    def __init__(self, tokenizer_file: str, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True  # stretches are lower-cased: what looks like one now is none
        self.added: dict[bytes, int] = {}
        for i, t in self.tokenizer.get_added_tokens_decoder().items() if added_tokens else ():
            if t.normalized or t.single_word or t.lstrip or t.rstrip or not t.special:
                raise ValueError(f"added token {t.content!r} is not matched by its bytes alone")
            self.added[t.content.encode()] = i
        self.any_added = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        self.zero = self._ids("0")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encode_new(self, words: list[bytes]) -> None:
        """Stretches that need the whole tokenizer go to it together if they lack
        the digit 0, with a 0 after each: its token then marks where they end."""
        tokenize, young, rest = self.tokenizer.model.tokenize, self.young, []
        for w in words:
            if w.isalpha() and w.islower():  # a-z, which the byte-level alphabet shows as they are
                young[w] = array("I", [t.id for t in tokenize(w.decode())]).tobytes()
            elif _PLAIN.fullmatch(w):
                young[w] = array("I", [t.id for t in tokenize(w.decode("latin-1").translate(_BYTE_LETTERS))]).tobytes()
            elif b"0" in w:
                young[w] = array("I", self._ids(w.decode())).tobytes()
            else:
                rest.append(w)
        for at in range(0, len(rest), 2000):
            part = rest[at:at + 2000]
            ids = np.array(self._ids(b" 0 ".join([*part, b""]).decode()), "<u4")
            ends = np.flatnonzero(ids == self.zero[0])
            raw = ids.tobytes()
            begin = 0
            for w, e in zip(part, (4 * ends).tolist(), strict=True):
                self.young[w] = raw[begin:e]
                begin = e + 4

    def _find_added(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins, ends and ids of the added tokens; none crosses a text's border."""
        raw, rows, found = data.tobytes(), set(), []
        for t in self.added:
            at = raw.find(t)
            while at >= 0:
                rows.add(int(np.searchsorted(off, at, side="right")) - 1)
                at = raw.find(t, at + 1)
        for r in sorted(rows):
            found += [(*m.span(), self.added[m[0]]) for m in self.any_added.finditer(raw, int(off[r]), int(off[r + 1]))]
        begin, end, ids = np.array(found, np.int64).reshape(-1, 3).T
        return begin, end, ids.astype(np.uint32)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, and where each text's ids begin and end."""
        begin, end, added = self._find_added(data, off)
        low = LOWER[data]
        for x, y in zip(begin.tolist(), end.tolist(), strict=True):
            low[x:y] = 32
        cut = np.flatnonzero(_LETTER[low[:-1]] & _SYMBOL[low[1:]]) + 1
        before = np.searchsorted(begin, off)  # added tokens in front of each text
        low, off, begin = np.insert(low, cut, 32), off + np.searchsorted(cut, off), begin + np.searchsorted(cut, begin)
        s, e, row = runs(_STRETCH[low], off)
        ids, ends = self._stretches(low, s, e)
        at = ends[np.searchsorted(row, np.arange(len(off)))] + before
        return np.insert(ids, ends[np.searchsorted(s, begin)], added), at

    def _stretches(self, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches, and the number of ids up to each (from 0)."""
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        raw = low.tobytes()
        hashes = slice_hashes(low, s, e)
        order = hashes.argsort()
        begins = np.diff(hashes[order], prepend=~hashes[order[:1]]) != 0
        first, code = order[begins], np.empty(len(s), np.int64)
        code[order] = np.cumsum(begins) - 1
        other = np.flatnonzero(~_same_bytes(raw, s, e, s[first][code], e[first][code]))
        if len(other):  # equal hashes, other bytes: these get numbers of their own
            named: dict[bytes, tuple[int, int]] = {}
            for i, x, y in zip(other.tolist(), s[other].tolist(), e[other].tolist(), strict=True):
                code[i] = named.setdefault(raw[x:y], (len(first) + len(named), i))[0]
            first = np.concatenate([first, [i for _, i in named.values()]])
        words = [raw[x:y] for x, y in zip(s[first].tolist(), e[first].tolist(), strict=True)]
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for w in words:
            if w not in young:
                known = old.get(w)
                if known is None:
                    new.append(w)
                else:
                    young[w] = known
        self._encode_new(list(dict.fromkeys(new)))
        coded = [young[w] for w in words]
        size = np.array([len(c) for c in coded], np.int64) // 4
        flat, begin = np.frombuffer(b"".join(coded), "<u4"), np.cumsum(size) - size
        size, begin = size[code], begin[code]
        ends = np.cumsum(size)
        ids = flat[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])


_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG = 64


def _same_bytes(raw: bytes, s: np.ndarray, e: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> np.ndarray:
    """Whether the slices raw[s:e] and raw[s2:e2] are equal, pair by pair: eight bytes at a
    time for all pairs, those longer than ``_LONG`` one by one."""
    size = e - s
    same = size == e2 - s2
    held = raw + bytes(8)
    eight = np.ndarray(len(raw) + 1, "<u8", held, strides=(1,))  # the eight bytes from every place on
    live = np.flatnonzero(same & (s != s2))
    for i in live[size[live] > _LONG].tolist():
        same[i] = raw[s[i]:e[i]] == raw[s2[i]:e2[i]]
    live = live[size[live] <= _LONG]
    k = 0
    while len(live):
        left = size[live] - k
        equal = (eight[s[live] + k] ^ eight[s2[live] + k]) & _LOW_BYTES[np.minimum(left, 8)] == 0
        same[live[~equal]] = False
        live, k = live[equal & (left > 8)], k + 8
    return same


@lru_cache(1)
def word_encoder(tokenizer_file: str, added_tokens: bool = False) -> WordEncoder:
    """The encoder of a Python worker, with its cache, for all its tasks."""
    return WordEncoder(tokenizer_file, added_tokens)


def write_shards(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", path: str | None = None, added_tokens: bool = False) -> DataFrame:
    """Tokenise ``docs`` in ascending id order (null ids first, equal ids by the
    text's hash) and write the ids, each document closed by ``end_id``, as
    wavelet shard files below ``path`` (default: a folder in the shared
    directory).  ``added_tokens``: whether the strings of the file's special
    tokens stand for their ids (the library's default) or are ordinary text.

    Returns the stored manifest: part, seq (order of the files), path, n_docs,
    n_tokens.  A task writes its range of ids as files of about
    ``SHARD_TOKENS`` tokens; file names are new for every attempt and only
    those of finished tasks get into the manifest.  A null or empty text has
    only the end id; repeated rows are kept; other columns are ignored; an
    empty table writes no file.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    root = path or folder(spark, "shards")
    end = np.array([end_id], np.uint32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_file, added_tokens)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        coded: list[np.ndarray] = []
        ids: list[int | None] = []
        seq = held = 0

        def close():
            nonlocal seq, held
            at = f"{root}/part-{part:06d}-{attempt}-{seq:06d}.wvm"
            counts = np.array([len(c) + 1 for c in coded], np.uint64)
            tokens = np.concatenate([x for c in coded for x in (c, end)])
            write_file(at, TokenShard.build(tokens, ids[:], counts).to_bytes())
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()),
                                              "path": [at], "n_docs": pa.array([len(ids)], pa.int64()),
                                              "n_tokens": pa.array([held], pa.int64())})
            coded.clear(), ids.clear()
            seq, held = seq + 1, 0
            return row
        for b in batches:
            data, off = string_buffers(b.column(1))
            docs_in = b.column(0).to_pylist()
            for lo, hi, texts, o in chunks(data, off, ENCODE_BYTES):
                tokens, at = encoder.encode(texts, o)
                for d in range(hi - lo):
                    coded.append(tokens[at[d]:at[d + 1]])
                    ids.append(docs_in[lo + d])
                    held += len(coded[-1]) + 1
                    if held >= SHARD_TOKENS:
                        yield close()
        if ids:
            yield close()
    src = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    src = (src.withColumn("th", F.xxhash64("text")).repartitionByRange("id", "th").sortWithinPartitions("id", "th")
           .select("id", "text"))
    return stored(src.mapInArrow(run, "part bigint, seq bigint, path string, n_docs bigint, n_tokens bigint"), "manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read shard files back: doc_id, start (tokens of all documents before it),
    n_tokens (with the end id), ids (binary, little-endian unsigned 32-bit)."""
    per_part = manifest.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = per_part.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    files = (manifest.withColumn("inner", F.coalesce(inner, F.lit(0))).join(parts, "part")
             .select("path", (F.col("base") + F.col("inner")).alias("start")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, at = filesystem(path)
                with store.open_input_stream(at) as f:
                    shard = TokenShard.load(f.read())
                raw, ids, counts = shard.tokens().astype("<u4").tobytes(), shard.ids, shard.counts
                ends = np.cumsum(counts).astype(np.int64)
                begin = ends - counts.astype(np.int64)
                for lo in range(0, len(ids), 2000):
                    cut = slice(lo, lo + 2000)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(ids[cut], pa.int64()), "start": pa.array(begin[cut] + start, pa.int64()),
                        "n_tokens": pa.array(counts[cut].astype(np.int64)),
                        "ids": pa.array([raw[4 * x:4 * y] for x, y in zip(begin[cut].tolist(), ends[cut].tolist(), strict=True)],
                                        pa.binary())})
    n = min(max(1, manifest.count()), 20_000)
    return files.repartition(n).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def occurrences(manifest: DataFrame, token: int) -> DataFrame:
    """Where a token occurs: one row (path, doc_id, position in the document)
    per occurrence, found in the compressed shards by select."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = filesystem(path)
                with store.open_input_stream(at) as f:
                    shard = TokenShard.load(f.read())
                where, ids, counts = shard.occurrences(token), shard.ids, shard.counts
                ends = np.cumsum(counts).astype(np.int64)
                doc = np.searchsorted(ends, where, side="right")
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([path] * len(where), pa.string()),
                    "doc_id": pa.array([ids[d] for d in doc.tolist()], pa.int64()),
                    "position": pa.array(where - (ends - counts.astype(np.int64))[doc], pa.int64())})
    n = min(max(1, manifest.count()), 20_000)
    return manifest.select("path").repartition(n).mapInArrow(run, "path string, doc_id bigint, position bigint")
