"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint is cut into ``segments`` parts that form a ring.  If two
fingerprints differ in at most ``max_bits`` bits, some start on the ring has
every chain of consecutive parts within its proportional budget: the first l
parts differ in at most l * max_bits / segments bits (Qin and Xiao, Pigeonring,
2018).  The leading parts whose budget is below one bit must be equal, which
gives the bucket key; longer chains are checked on the candidate pair before
the full Hamming distance.

The number of segments grows with that of the fingerprints, so that buckets
stay small on average.  Those of a few fingerprints give their pairs.  Crowded
ones (a dense family of near copies) take an exact way without pairs: two fingerprints differ in at most two bits if and only if some
64-bit value lies within one bit of both, so each member is sent to the values
around it, and the members that meet at a value (65 at most, as fingerprints
are distinct) are linked in a star.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hotkeys import join_per_key
from .scratch import stored
from .textbytes import append_columns, string_buffers

#: Buckets up to this size give pairs; larger ones are linked through nearby values.
PAIR_BUCKET = 16
#: Segments by the number of distinct fingerprints, so that bucket keys (about half the ring) outgrow it.
SEGMENTS = ((1 << 22, 5), (1 << 26, 9), (1 << 62, 17))
#: Seed of the shingle hash, fixed by the task.
SEED = 42
_HASHES = 1 << 16

# _SPREAD[b]: eight byte lanes, lane j holding bit j of b
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(raw: bytes, width: int) -> list[int]:
    """XXH64 of every word shingle of a text (fewer words: of all of them)."""
    words = raw.lower().split()  # bytes: lower-cases A-Z, parts at 0x20 and 0x09-0x0D
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b - 1], SEED) for a, b in zip(starts, starts[width:], strict=False)]


def majority_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row (hashes first[i]:first[i+1]) the bits set in over half of them; no hashes: zero.
    Counts up to 255 hashes at once in byte lanes, then adds those up."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    begin = np.concatenate([np.arange(first[i], first[i + 1], 255) for i in full])
    lanes = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    parts = np.add.reduceat(lanes, begin, axis=0).view(np.uint8).reshape(-1, 64)
    heads = np.searchsorted(begin, first[full])
    counts = np.add.reduceat(parts, heads, axis=0, dtype=np.int64)
    bits = 2 * counts > n[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Append ``fp`` (bigint): the SimHash of the text's word shingles.  A null
    or empty text, or one without words, has fingerprint 0.  An existing
    column ``fp`` is replaced."""
    def make():
        def fn(batch: pa.RecordBatch):
            data, off = string_buffers(batch.column(0))
            raw = data.tobytes()
            fps = np.zeros(batch.num_rows, np.uint64)
            held: list[int] = []
            rows, first = [], [0]

            def flush():
                if rows:
                    fps[rows] = majority_bits(np.array(held, np.uint64), np.array(first))
                    held.clear(), rows.clear()
                    first[:] = [0]
            for i in range(batch.num_rows):
                held += shingle_hashes(raw[off[i]:off[i + 1]], shingle)
                rows.append(i)
                first.append(len(held))
                if len(held) >= _HASHES:
                    flush()
            flush()
            return [pa.array(fps.view(np.int64))]
        return fn
    return append_columns(docs, [("fp", "bigint")], make, [text_col])


def _mask(bits: range) -> int:
    """Bits as a signed 64-bit mask."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


class Ring:
    """Segment borders, budgets and masks for a distance and a number of segments."""

    def __init__(self, max_bits: int, segments: int):
        if not 1 <= max_bits <= 2:
            raise ValueError("max_bits must be 1 or 2")
        if not max_bits < segments <= 64:
            raise ValueError("segments must exceed max_bits")
        edge = [64 * i // segments for i in range(segments + 1)]
        self.max_bits, self.segments = max_bits, segments
        self.parts = [range(edge[i], edge[i + 1]) for i in range(segments)]
        self.exact = (segments - 1) // max_bits  # longest chain whose budget is below one bit

    def key(self, fp, start: int):
        """Bucket key of the equal chain that begins at ``start``."""
        key = F.lit(start).cast("long")
        for k in range(self.exact):
            p = self.parts[(start + k) % self.segments]
            key = F.shiftleft(key, len(p)).bitwiseOR(F.shiftrightunsigned(fp, p[0]).bitwiseAND(F.lit((1 << len(p)) - 1)))
        return key

    def viable(self, x, start):
        """Whether the differing bits ``x`` keep every chain from ``start`` within budget."""
        cases = F.lit(False)
        for s in range(self.segments):
            ok, bits = F.lit(True), 0
            for k in range(1, self.segments):
                p = self.parts[(s + k - 1) % self.segments]
                bits |= _mask(p) & ((1 << 64) - 1)
                m = bits - (1 << 64) if bits >> 63 else bits
                if k > self.exact:
                    ok = ok & (F.bit_count(x.bitwiseAND(F.lit(m))) <= k * self.max_bits // self.segments)
            cases = F.when(start == s, ok).otherwise(cases)
        return cases


def links(fps: DataFrame, max_bits: int = 2, segments: int | None = None) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints ``fp`` at ``max_bits``
    or fewer differing bits: all of them from small buckets, and for large
    buckets a set with the same connected components.  Without ``segments``
    their number grows with that of the fingerprints: 26, 28 or 30 bits per key."""
    if segments is None:
        n = fps.count()
        segments = next(s for most, s in SEGMENTS if n <= most)
    ring = Ring(max_bits, segments)
    fp = F.col("fp")
    keys = stored(fps.select("fp", F.posexplode(F.array(*[ring.key(fp, s) for s in range(segments)])).alias("start", "key")),
                  "keys")
    sizes = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    rows = join_per_key(keys, sizes, "key", "n", keys.count())
    small = rows.where(F.col("n") <= PAIR_BUCKET).groupBy("key", "start").agg(F.collect_list("fp").alias("fps"))
    pairs = (small.select("start", "fps", F.explode("fps").alias("a"))
             .select("start", "a", F.explode(F.filter("fps", lambda x: x > F.col("a"))).alias("b"))
             .withColumn("x", F.col("a").bitwiseXOR(F.col("b")))
             .where(ring.viable(F.col("x"), F.col("start")))
             .where(F.bit_count("x") <= max_bits).select("a", "b").distinct())
    near = [F.struct(F.lit(-1).alias("bit"), fp.alias("v"))] if max_bits == 2 else []
    for b in range(64):
        m = F.lit(_mask(range(b, b + 1)))
        # two bits: meet at the value between; one bit: meet with the bit left out
        near.append(F.struct(F.lit(-1).alias("bit"), fp.bitwiseXOR(m).alias("v")) if max_bits == 2
                    else F.struct(F.lit(b).alias("bit"), fp.bitwiseAND(F.bitwise_not(m)).alias("v")))
    meet = (rows.where(F.col("n") > PAIR_BUCKET).select("fp").distinct()
            .select("fp", F.explode(F.array(*near)).alias("near"))
            .groupBy("near").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1))
    stars = (meet.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
             .where("a < b").distinct())
    return pairs.unionByName(stars)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, root) per node that
    is not the smallest of its component, ``root`` being that smallest node.
    Alternates large-star and small-star rounds until nothing changes."""
    def rehang(e: DataFrame, both_ways: bool) -> DataFrame:
        """Hang the neighbours of every node on its smallest neighbour (or itself)."""
        if both_ways:
            e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        e = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        j = join_per_key(e, low, "u", "n", e.count())
        m = F.least("m", "u")
        if both_ways:  # large star: larger neighbours only
            out = j.where("v > u").select(m.alias("a"), F.col("v").alias("b"))
        else:  # small star: the node itself and its smaller neighbours
            out = j.select(F.explode(F.array("u", "v")).alias("b"), m.alias("a"))
        return out.where("a < b").select("a", "b").distinct()

    e, state = stored(edges, "links"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = now
        e = stored(rehang(stored(rehang(e, True), "large"), False), "small")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2, segments: int | None = None) -> DataFrame:
    """One row per document: ``id_col``, ``th`` (hash of the text), ``fp``,
    ``root`` (smallest fingerprint of the component) and ``component_id``
    (smallest id in the component).

    Documents link when their fingerprints differ in at most ``max_bits``
    bits.  Null, empty and wordless texts share fingerprint 0 and link like
    any other.  A null id is never the smallest unless the component has no
    other (then ``component_id`` is null); repeated rows give repeated rows;
    other columns are ignored; an empty table gives an empty result.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    src = src.withColumn("th", F.xxhash64("text"))
    rows = stored(fingerprint(src, "text", shingle).select("id", "th", "fp"), "fingerprints")
    total = rows.count()
    reps = stored(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = components(links(reps, max_bits, segments))
    nodes = (reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
             .withColumn("root", F.coalesce("root", "fp")))
    nodes = stored(nodes, "nodes")
    heads = nodes.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("k"))
    named = join_per_key(nodes, heads, "root", "k", reps.count()).select("fp", "root", "component_id", "n")
    out = join_per_key(rows, named, "fp", "n", total)
    return out.select(F.col("id").alias(id_col), "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             max_bits: int = 2, segments: int | None = None) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one with the
    smallest id (a null id last, then the smaller text hash; of rows equal in
    both, any one)."""
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits, segments)
    first = found.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
                                                     F.col("th"))).alias("s"))

    def row_key(i, t):
        return [F.coalesce(i.cast("string"), F.lit("")).alias("__k1"), i.isNull().alias("__k2"), t.alias("__k3")]
    keys = ["__k1", "__k2", "__k3"]
    chosen = first.select(*row_key(F.col("s.id"), F.col("s.th")), F.lit(True).alias("__chosen"))
    # keys of which some row goes
    sizes = found.select(*row_key(F.col(id_col), F.col("th"))).groupBy(*keys).agg(F.count("*").alias("__n"))
    losing = stored(sizes.join(chosen, keys, "left").where("__chosen IS NULL OR __n > 1").drop("__n"), "losing")
    keyed = docs.select("*", *row_key(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # one way at every size: rows move to the partitions of their keys, where only keys are held in memory
    asked = keyed.join(losing.withColumn("__loses", F.lit(True)).hint("shuffle_hash"), keys, "left")
    one = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    rest = asked.where("__loses IS NULL").select(*columns)
    last = asked.where("__chosen").withColumn("__one", one).where("__one = 1").select(*columns)
    return rest.unionByName(last)
