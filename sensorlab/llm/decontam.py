"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items are put into one suffix automaton over
word numbers (one per bounded block of items, each built by a Spark task and
loaded by the tasks of its own pass).  Every document streams
its words through it; the automaton keeps the length of the longest item
substring that ends at the current word, so a window of ``window`` consecutive
item words ends exactly where that length reaches ``window``, and an item with
fewer words where its own end state is reached in full.  Spans are removed, and
a document goes as a whole when too much of it was hit.

Words outside the items' vocabulary reset the automaton, so only runs of
vocabulary words as long as the shortest window are walked; the runs are found
by byte-class masks and word hashes, and the walk compares the real bytes.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .scratch import filesystem, folder, stored, write_file
from .textbytes import LOWER, append_columns, chunks, limit_batches, runs, slice_hashes, string_buffers

#: Fixed by the task: bytes that part words (all ASCII but letters and digits).
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_IS_WORD = np.ones(256, bool)
_IS_WORD[:128] = [bool(_WORD.fullmatch(bytes([i]))) for i in range(128)]

#: Words of test items in one automaton; more items make more passes, not larger tables.
BLOCK_WORDS = 100_000


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items that
    each window of ``window`` words (or each shorter item) comes from."""

    def __init__(self, items: Sequence[tuple[str, Sequence[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        coded = []
        for item, words in items:
            seq = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            coded.append((item, seq))
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self._windows(coded)
        hashes = _hashes_of(list(self.vocab))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[hashes >> np.uint64(44)] = True
        self.shortest = min((min(len(s), window) for _, s in coded if s), default=window)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:  # the substring is known: at most its state must be split off
            return self._state_of(last, c)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            link[cur] = self._state_of(p, c)
        return cur

    def _state_of(self, p: int, c: int) -> int:
        """The state whose longest word is that of ``p`` followed by ``c``."""
        nxt, link, length = self.next, self.link, self.length
        q = nxt[p][c]
        if length[q] == length[p] + 1:
            return q
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def _windows(self, coded) -> None:
        link, length, w = self.link, self.length, self.window
        owner: dict[int, set[str]] = {}
        short: dict[int, dict[int, set[str]]] = {}
        for item, seq in coded:
            s = 0
            for i, c in enumerate(seq):
                s = self.next[s][c]
                if i + 1 >= w:
                    while length[link[s]] >= w:
                        s = link[s]
                    owner.setdefault(s, set()).add(item)
            if 0 < len(seq) < w:
                while length[link[s]] >= len(seq):
                    s = link[s]
                short.setdefault(s, {}).setdefault(len(seq), set()).add(item)
        self.owner = {s: tuple(sorted(v)) for s, v in owner.items()}
        self.short = {s: tuple((n, tuple(sorted(i))) for n, i in v.items()) for s, v in short.items()}
        # top[s]: the state of the last ``window`` words; over[s]: short items that end in every match of s
        order = sorted(range(1, len(link)), key=length.__getitem__)
        self.top = list(range(len(link)))
        self.over: list[tuple] = [()] * len(link)
        for s in order:
            p = link[s]
            if length[p] >= w:
                self.top[s] = self.top[p]
            self.over[s] = self.over[p] + self.short.get(p, ())

    def walk(self, words: Sequence[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(words matched, position after the last, items) of every window or
        short item that ends within ``words``."""
        nxt, link, length, vocab, w = self.next, self.link, self.length, self.vocab, self.window
        s = n = 0
        for pos, word in enumerate(words, 1):
            c = vocab.get(word, -1)
            if c < 0:
                s = n = 0
                continue
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s = nxt[s][c]
                n += 1
                if n >= w:
                    yield w, pos, self.owner[self.top[s]]
                for k, items in self.over[s]:
                    yield k, pos, items
                for k, items in self.short.get(s, ()):
                    if k <= n:
                        yield k, pos, items


def _hashes_of(words: Sequence[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    starts = ends - np.array([len(w) for w in words], dtype=np.int64)
    return slice_hashes(np.frombuffer(b"".join(words), np.uint8), starts, ends)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text; null has none."""
    return _WORD.findall((text or "").encode().lower())


def build_automata(bench: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text",
                   block_words: int = BLOCK_WORDS) -> list[str]:
    """Files in the shared folder with an automaton per block of items, about ``block_words``
    words each, built and written by Spark tasks.  A longer item is cut into pieces that overlap
    by ``window`` - 1 words and so lose no window; a block's pieces are drawn by hash."""
    spark = bench.sparkSession
    limit_batches(spark)
    root = folder(spark, "automata")
    items = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(text_col, F.lit("")).alias("text"))

    def cut(batches):
        for b in batches:
            out = [(item, k, b" ".join(ws[i:i + block_words + window - 1]), len(ws[i:i + block_words + window - 1]))
                   for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for ws in [words_of(text)] if ws
                   for k, i in enumerate(range(0, max(1, len(ws) - window + 1), block_words))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int64(), pa.binary(), pa.int64()), strict=True)],
                names=["item", "piece", "words", "n"])
    pieces = stored(items.mapInArrow(cut, "item string, piece bigint, words binary, n bigint"), "items")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))

    def build(table: pa.Table) -> pa.Table:
        block = sorted(zip(table["item"].to_pylist(), (w.split(b" ") for w in table["words"].to_pylist()), strict=True))
        at = f"{root}/{table['block'][0].as_py():06d}-{uuid.uuid4().hex[:12]}"
        write_file(at, pickle.dumps(SuffixAutomaton(block, window), pickle.HIGHEST_PROTOCOL))
        return pa.table({"block": table["block"][:1], "path": pa.array([at])})
    made = (pieces.withColumn("block", F.pmod(F.xxhash64("item", "piece", "words"), F.lit(blocks)))
            .groupBy("block").applyInArrow(build, "block bigint, path string"))
    return [r.path for r in stored(made, "automata-list").orderBy("block").collect()]


@lru_cache(1)
def _automaton(path: str) -> SuffixAutomaton:
    """An automaton from its file, kept by a Python worker for its tasks of one pass."""
    store, at = filesystem(path)
    with store.open_input_stream(at) as f:
        return pickle.loads(f.read())


def _scan(auto: SuffixAutomaton, data: np.ndarray, off: np.ndarray, hit: list[np.ndarray], found: list[set]):
    """Walk the texts of one chunk; ``hit`` gets a mask over the words of each text."""
    low = LOWER[data]
    s, e, row = runs(_IS_WORD[low], off)
    count = np.bincount(row, minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    known = auto.bits[slice_hashes(low, s, e) >> np.uint64(44)]
    a, b, r = runs(known, first)
    mask = np.zeros(len(s), bool)
    long = (b - a) >= auto.shortest
    for i, j, d in zip(a[long].tolist(), b[long].tolist(), r[long].tolist(), strict=True):
        words = [low[x:y].tobytes() for x, y in zip(s[i:j].tolist(), e[i:j].tolist(), strict=True)]
        for n, end, items in auto.walk(words):
            mask[i + end - n:i + end] = True
            found[d].update(items)
    for d in range(len(count)):
        hit[d] = mask[first[d]:first[d + 1]]
    return s, e, first


def _mapper(path: str | None, window: int, merge: bool):
    def make():
        auto = _automaton(path) if path else SuffixAutomaton([], window)

        def fn(batch: pa.RecordBatch):
            data, off = string_buffers(batch.column(0))
            n = batch.num_rows
            n_words, n_hit, spans, items = [0] * n, [0] * n, [None] * n, [None] * n
            before = batch.column(1).to_pylist() if merge else [()] * n
            known = batch.column(2).to_pylist() if merge else [()] * n
            for lo, hi, part, o in chunks(data, off):
                hit, found = [None] * (hi - lo), [set(known[lo + d] or ()) for d in range(hi - lo)]
                s, e, first = _scan(auto, part, o, hit, found)
                for d in range(hi - lo):
                    m = hit[d]
                    for x in before[lo + d]:
                        m[x["first"]:x["last"] + 1] = True
                    out = []
                    if m.any():
                        i, j, _ = runs(m, np.array([0, len(m)]))
                        for x, y in zip(i.tolist(), j.tolist(), strict=True):
                            out.append({"first": x, "last": y - 1, "begin": int(s[first[d] + x] - o[d]),
                                        "end": int(e[first[d] + y - 1] - o[d])})
                    n_words[lo + d], n_hit[lo + d] = len(m), int(m.sum())
                    spans[lo + d], items[lo + d] = out, sorted(found[d])
            kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "begin", "end")]))
            return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, kind),
                    pa.array(items, pa.list_(pa.string()))]
        return fn
    return make


_FIELDS = [("n_words", "bigint"), ("n_hit", "bigint"),
           ("spans", "array<struct<first:bigint,last:bigint,begin:bigint,end:bigint>>"), ("items", "array<string>")]


def find_spans(docs: DataFrame, bench: DataFrame, window: int = 10, text_col: str = "text",
               block_words: int = BLOCK_WORDS) -> DataFrame:
    """Mark in every document the words inside any occurrence of an item window.

    Appends ``n_words``, ``n_hit`` (words hit), ``spans`` (maximal runs of hit
    words: first and last word, begin and end as byte offsets in the text) and
    ``items`` (ids as text of the items with an occurring window, sorted).
    Columns of these names are replaced.  A null or empty text has no words
    and no hits; items without words match nothing; repeated rows and items
    are each worked out alike; an empty ``bench`` hits nothing.  An item with
    null id counts as the empty id.
    """
    out, merge = docs, False
    for path in build_automata(bench, window, block_words=block_words) or [None]:
        if merge:  # a pass ends before the next begins: one automaton in memory, one Python stage in a plan
            out = stored(out, "pass")
        out = append_columns(out, _FIELDS, _mapper(path, window, merge), [text_col] + (["spans", "items"] if merge else []))
        merge = True
    return out


def remove_spans(docs: DataFrame, bench: DataFrame, window: int = 10, max_coverage: float = 0.5,
                 text_col: str = "text") -> DataFrame:
    """Cut the hit spans out of every document and drop documents of which more
    than ``max_coverage`` of the words were hit.  The texts of documents
    without a hit are unchanged; null texts stay null.  Columns are those of
    ``docs``."""
    rest = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__row") if rest else F.lit(1).alias("__row"),
                         F.col(f"`{text_col}`").alias("__text"))
    found = find_spans(packed, bench, window, "__text")
    found = found.where(F.col("n_hit") <= F.lit(max_coverage) * F.col("n_words"))

    # In Spark's own expressions: a second Python stage would keep a second worker per core, which later stages fill too.
    # Spans begin and end at words, so every piece between them is whole characters.
    def between(raw):
        def piece(i):
            begin = F.coalesce(F.get("spans", i - 1)["end"], F.lit(0)).cast("int")
            end = F.coalesce(F.get("spans", i)["begin"], F.length(raw)).cast("int")
            return F.substring(raw, begin + 1, end - begin).cast("string")
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size("spans")), piece), "")
    text = F.col("__text")
    cut = F.when(F.size("spans") > 0, let(text.cast("binary"), between)).otherwise(text)
    return found.select(*[cut.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
