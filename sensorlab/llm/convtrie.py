"""Prefix trie of conversations by union-find over sorted-neighbour LCP edges.

Distinct conversations are sorted by their turns, so that every prefix covers
an interval of neighbours; the edge between two neighbours carries the length
of their longest common prefix (LCP).  Taking the edges in descending depth,
a union-find joins the intervals on both sides: every merge is a branching
node (or one where a conversation ends) of the trie, and what hangs below it
is complete.  This is done in blocks of neighbours.  A node that may go on
beyond its block stays open; the block is contracted to the few partial nodes
on its left and right border, and these are merged, block by block, in further
rounds until one block is left.  The nodes of a path between two merges differ
only in depth; they are written out at the end.

Turns are compared by the first 128 bits of a SHA-256, prefixes are named by
chained SHA-256.  Sequences are handled in segments of ``SEGMENT`` turns, so
one conversation may hold any share of all turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import chunked as C
from .hotkeys import join_per_key
from .scratch import stored
from .textbytes import limit_batches

#: Turns of a segment: what one row holds of a conversation.
SEGMENT = 4096
#: Neighbours of a block.
BLOCK = 1 << 16
#: Contracted blocks that the next round merges in one task.
FAN_IN = 64
#: Characters of member ids in one row.
ID_TEXT = 1 << 16
#: Bytes of a turn's digest.
_DIGEST = 16
ROOT = hashlib.sha256(b"").digest()
_RIGHT = 1 << 62  # depth of an edge to a neighbour that is not known yet


def turn_digest(role, text):
    """128 bits of the SHA-256 of a turn; the role's length keeps role and text apart."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * _DIGEST))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank from 1, digest, bytes, len): the turns of every conversation in the
    order of turn (null first, equal turns by digest), len being their number.
    Rows without conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows, _ = C.index_series(turns, ["conv_id"], ["turn", "digest"])
    return stored(rows.select("conv_id", (F.col(C.POS) + 1).alias("rank"), "digest", "bytes", F.col(C.LEN).alias("len")), "turns")


def rebuild(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of their family's base.

    Of conversation c the first h turns (h = crc32 of its decimal id modulo ``heads``) are
    replaced by the first h turns of conversation c - c % ``family``.  Returns (conv_id, pos
    from 1, digest, bytes) and (conv_id, len) of every conversation, turnless ones included."""
    convs = turns.where("rank = 1").select("conv_id", "len")
    convs = convs.select("conv_id", "len", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"),
                         (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    convs = stored(convs.join(sizes, "base", "left").withColumn("head", F.least("h", F.coalesce("base_len", F.lit(0)))), "families")
    # at most heads - 1 turns of a base and family conversations of each
    first = turns.where(F.col("rank") < heads).select(F.col("conv_id").alias("base"), "rank", "digest", "bytes")
    borrowed = (convs.select("conv_id", "base", "head").join(first, "base").where("rank <= head")
                .select("conv_id", F.col("rank").alias("pos"), "digest", "bytes"))
    total = turns.count()
    own = join_per_key(turns.select("conv_id", "rank", "digest", "bytes"), convs.select("conv_id", "h", "head", "len"),
                       "conv_id", "len", total).where("rank > h")
    own = own.select("conv_id", (F.col("rank") - F.col("h") + F.col("head")).alias("pos"), "digest", "bytes")
    lens = convs.select("conv_id", (F.col("head") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).cast("long").alias("len"))
    return borrowed.unionByName(own), lens


def prefixes(rebuilt: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, prefix, below, bytes): name of the prefix that ends with the turn, and
    the bytes of its texts; and the segments (conv_id, k, seq) with the turns' digests in a row."""
    limit_batches(rebuilt.sparkSession)
    k = F.floor((F.col("pos") - 1) / segment)
    rows = (rebuilt.groupBy("conv_id", k.alias("k"))
            .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("t")))

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Names of the prefixes within the segment."""
        for b in batches:
            out = {"conv_id": [], "k": [], "seq": [], "names": [], "sums": []}
            for r in b.to_pylist():
                name, total, names, sums = b"", 0, [], []
                for e in r["t"]:
                    name, total = hashlib.sha256(name + e["digest"]).digest(), total + e["bytes"]
                    names.append(name)
                    sums.append(total)
                for c, v in zip(out, (r["conv_id"], r["k"], b"".join(e["digest"] for e in r["t"]), names, sums), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("conv_id", pa.int64()), ("k", pa.int64()), ("seq", pa.binary()), ("names", pa.list_(pa.binary())),
                ("sums", pa.list_(pa.int64()))]))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("k").cast("long").alias("k"), "t")
    segs = stored(rows.mapInArrow(chain, "conv_id bigint, k bigint, seq binary, names array<binary>, sums array<bigint>"), "segments")
    # what the segments before one add: a chained name and a sum over the whole segments
    ends = F.array_sort(F.collect_list(F.struct("k", F.element_at("names", -1).alias("name"), F.element_at("sums", -1).alias("sum"))))
    start = F.struct(F.lit(ROOT).alias("name"), F.lit(0).cast("long").alias("sum"))
    link = F.udf(_link, "array<struct<k: bigint, name: binary, sum: bigint>>")
    whole = (segs.groupBy("conv_id").agg(ends.alias("e")).where(F.size("e") > 1)
             .select("conv_id", F.explode(link("e")).alias("x")).select("conv_id", "x.k", F.struct("x.name", "x.sum").alias("before")))
    # nothing precedes a first segment
    first = segs.where("k = 0").withColumn("before", start)
    later = segs.where("k > 0").join(whole, ["conv_id", "k"])
    at = first.unionByName(later).select("conv_id", "k", "before", F.posexplode(F.arrays_zip("names", "sums")).alias("i", "z"))
    marks = at.select("conv_id", (F.col("k") * segment + F.col("i") + 1).alias("pos"),
                      F.unhex(F.sha2(F.concat(F.col("before.name"), F.col("z.names")), 256)).alias("prefix"),
                      (F.col("before.sum") + F.col("z.sums")).alias("below"))
    return stored(marks, "prefixes"), segs.select("conv_id", "k", "seq")


def _link(ends):
    """Chained name and sum before every segment but the first."""
    name, total, out = ROOT, 0, []
    for e in ends:
        if e["k"] > 0:
            out.append((e["k"], name, total))
        name, total = hashlib.sha256(bytes(name) + bytes(e["name"])).digest(), total + e["sum"]
    return out


def sorted_neighbours(seqs: DataFrame, segs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``seqs`` (conv_id, len, ...) in the order of their turns: ``at`` (order) and ``lcp``
    with the row before (-1 for the first).

    The first segment is a sort key of its own; the later ones enter the key by their rank
    among all distinct segments, 8 bytes each."""
    limit_batches(seqs.sparkSession)
    later = segs.where("k > 0")
    ranked, _ = C.index_series(later.select("seq").distinct().withColumn("all", F.lit(0)), ["all"], ["seq"])
    ranks = stored(ranked.select("seq", F.col(C.POS).alias("r")), "ranks")
    tails = (later.join(ranks, "seq").groupBy("conv_id")
             .agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("t"))
             .select("conv_id", F.transform("t", lambda e: e.r).alias("tail")))
    keyed = (seqs.join(segs.where("k = 0").select("conv_id", F.col("seq").alias("head")), "conv_id", "left")
             .join(tails, "conv_id", "left")
             .withColumn("head", F.coalesce("head", F.lit(b"")))
             .withColumn("tail", F.coalesce("tail", F.array().cast("array<bigint>"))))
    run = stored(keyed.repartitionByRange("head", "tail").sortWithinPartitions("head", "tail")
                 .withColumn("at", F.monotonically_increasing_id())
                 .withColumn("part", F.shiftright("at", 33).cast("int")), "sorted")
    # the last row of every run goes to the run after it
    edge = run.groupBy("part").agg(F.min("at").alias("at"), F.max_by(F.struct("head", "tail", "len"), F.col("at")).alias("last"))
    edge = edge.select("at", F.lag("last").over(Window.orderBy("part")).alias("last"))  # one row per run

    def step(col):
        """Of the row before, within the run; no window is needed where the order is the row number."""
        return F.lag(col).over(Window.partitionBy("part", "cell").orderBy("at"))
    # runs are cut into cells with one row of overlap, so that no run is sorted in one task again
    cell = F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / 8192)
    last_of = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) % 8192 == 8191
    both = run.withColumn("cells", F.when(last_of, F.array(cell, cell + 1)).otherwise(F.array(cell)))
    both = both.select("*", F.explode("cells").alias("cell")).drop("cells").repartition("part", "cell")
    pairs = both.select("*", step(F.struct("head", "tail", "len")).alias("prev"), cell.alias("home")).where("cell = home")
    pairs = pairs.join(edge, "at", "left").withColumn("prev", F.coalesce("prev", "last")).drop("last", "home", "cell")
    # in the first segment: common bytes; beyond it: the first rank that differs names the pair of segments to compare
    same = F.col("prev.head") == F.col("head")
    differ = F.filter(F.sequence(F.lit(0), F.greatest(F.size("tail"), F.size("prev.tail"))),
                      lambda i: ~F.get("tail", i).eqNullSafe(F.get("prev.tail", i)))
    pairs = pairs.withColumn("i", F.when(same, F.coalesce(F.get(differ, F.lit(0)), F.size("tail"))))
    pairs = (pairs.withColumn("ra", F.when(same, F.get("tail", F.col("i")))).withColumn("rb", F.when(same, F.get("prev.tail", F.col("i"))))
             .select(*seqs.columns, "at", "part", "i", "ra", "rb", F.col("prev.len").alias("prev_len"),
                     F.when(~same, F.col("head")).alias("a"), F.when(~same, F.col("prev.head")).alias("b")))
    near = pairs.where("ra IS NULL OR rb IS NULL").withColumn("whole", F.lit(0).cast("long"))
    deep = (pairs.where("ra IS NOT NULL AND rb IS NOT NULL").drop("a", "b")
            .join(ranks.select(F.col("r").alias("ra"), F.col("seq").alias("a")), "ra")
            .join(ranks.select(F.col("r").alias("rb"), F.col("seq").alias("b")), "rb")
            .withColumn("whole", (F.col("i") + 1).cast("long") * segment))
    pairs = near.unionByName(deep.select(*near.columns))
    common = F.lit(0).cast("long") + _common("a", "b")
    # equal first segments and no pair left: the shorter sequence is a prefix of the longer
    lcp = (F.when(F.col("prev_len").isNull(), -1).when(F.col("a").isNotNull(), F.col("whole") + common)
           .otherwise(F.least("len", "prev_len")))
    return stored(pairs.select(*seqs.columns, "at", "part", lcp.cast("long").alias("lcp")), "neighbours")


def _common(a: str, b: str):
    """Number of equal leading digests of two rows of digests."""
    @F.pandas_udf("bigint")
    def count(x, y):
        import pandas as pd

        def one(p, q):
            n = min(len(p), len(q)) // _DIGEST * _DIGEST
            off = np.flatnonzero(np.frombuffer(p, np.uint8, n) != np.frombuffer(q, np.uint8, n))
            return (int(off[0]) if len(off) else n) // _DIGEST
        return pd.Series([0 if p is None or q is None else one(p, q) for p, q in zip(x, y, strict=True)])
    return count(a, b)


#: A component: an interval of neighbours under one node, as far as known.  ``lcp`` leads to the component before
#: it; ``edge_*`` name and weigh the prefix of that length; ``bag`` is what hangs below the node, without its own turn.
_FIELDS = [("lcp", "bigint"), ("edge_prefix", "binary"), ("edge_below", "bigint"), ("depth", "bigint"), ("prefix", "binary"),
           ("below", "bigint"), ("conv_id", "bigint"), ("n", "bigint"), ("children", "bigint"), ("leaves", "bigint"), ("bag", "bigint")]
_NODE = [("prefix", "binary"), ("depth", "bigint"), ("top", "bigint"), ("parent", "binary"), ("below", "bigint"), ("conv_id", "bigint"),
         ("n", "bigint"), ("children", "bigint"), ("leaves", "bigint"), ("bag", "bigint")]


def merge_block(items: list[dict], last: bool) -> tuple[list[dict], list[dict]]:
    """Union-find over one block of neighbouring components in descending depth of their
    edges: (nodes that are complete, components left).  ``last``: nothing follows the block."""
    count = len(items)
    comp = [dict(x) for x in items]
    up = list(range(count))          # union-find; the leftmost member is the root
    right = list(range(1, count + 1))  # of a root: the root of the component after it
    done: list[dict] = []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def edge_after(i: int) -> int:
        j = right[i]
        return comp[j]["lcp"] if j < count else (-1 if last else _RIGHT)

    def lift(i: int, depth: int, prefix: bytes, below: int) -> bool:
        """Complete the node of a component and hang it below the node at ``depth``, if nothing
        beyond its borders can belong to it."""
        x = comp[i]
        if x["depth"] == depth:
            return True
        if max(x["lcp"], edge_after(i)) > depth:
            return False
        leaves = x["leaves"] if x["children"] else 1
        done.append({f: x[f] for f in ("prefix", "depth", "below", "conv_id", "n", "children", "bag")}
                    | {"top": depth, "parent": prefix, "leaves": leaves})
        x.update(bag=x["bag"] + (x["n"] - 1) * (x["below"] - below), depth=depth, prefix=prefix, below=below, children=1, leaves=leaves)
        return True
    for e in sorted(range(1, count), key=lambda i: -comp[i]["lcp"]):
        depth, prefix, below = comp[e]["lcp"], comp[e]["edge_prefix"], comp[e]["edge_below"]
        a, b = find(e - 1), e
        if lift(a, depth, prefix, below) & lift(b, depth, prefix, below):
            x, y = comp[a], comp[b]
            x.update(conv_id=min(x["conv_id"], y["conv_id"]), **{f: x[f] + y[f] for f in ("n", "children", "leaves", "bag")})
            up[b], right[a] = a, right[b]
    left = [find(i) for i in range(count)]
    keep = [comp[i] for i in dict.fromkeys(left)]
    if last and len(keep) == 1 and keep[0]["lcp"] < 0:
        lift(left[0], 0, ROOT, 0)
        x = comp[left[0]]
        done.append({f: x[f] for f in ("prefix", "depth", "below", "conv_id", "n", "children", "bag")}
                    | {"top": -1, "parent": None, "leaves": x["leaves"] if x["children"] else 1})
        keep = []
    return done, keep


def merge_forest(rows: DataFrame, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """Complete nodes of the trie over neighbours ``rows`` (part, at, and the fields of a component).

    Each round merges blocks of up to ``block`` neighbours and passes on what is left of them;
    runs of ``fan_in`` tasks meet in the next round.  The rounds end with one run in one block.
    What cannot be contracted are nested prefixes that all go on (a block's border path); their
    number is at most the square root of twice the number of turns, so the last block is small."""
    spark = rows.sparkSession
    limit_batches(spark)
    fields, node = [f for f, _ in _FIELDS], [f for f, _ in _NODE]
    schema = ("kind int, part int, at bigint, top bigint, parent binary, " + ", ".join(f"{f} {t}" for f, t in _FIELDS))
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(f, types[t]) for f, t in (x.split() for x in schema.split(", "))])
    rows = rows.select("part", "at", *fields)
    nodes = []
    while True:
        runs = rows.select(F.min("part"), F.max("part"), F.count("*")).first()
        if not runs[2]:
            break
        single = runs[0] == runs[1]
        final = single and runs[2] <= block

        def work(batches, final=final, size=block):
            held: list[dict] = []
            part, turn = None, 0

            def flush(end: bool):
                nonlocal held, turn
                done, keep = merge_block(held, end)
                out = [x | {"kind": 1} for x in done]
                for x in keep:
                    out.append(x | {"kind": 0, "part": part, "at": turn})
                    turn += 1
                held = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
            for b in batches:
                for r in b.to_pylist():
                    if held and (r["part"] != part or len(held) >= size):
                        yield from flush(False)
                    if r["part"] != part:
                        part, turn = r["part"], 0
                    held.append(r)
            if held:
                yield from flush(final)
        ordered = rows.repartition(1 if single else runs[1] // fan_in + 1, "part").sortWithinPartitions("part", "at")
        out = stored(ordered.mapInArrow(work, schema), "merged")
        nodes.append(out.where("kind = 1").select(*node))
        if final:
            break
        left = out.where("kind = 0")
        if single and left.count() == runs[2]:
            block *= 2  # nothing but border paths in these blocks
        rows = left.select(F.floor(F.col("part") / fan_in).cast("int").alias("part"),
                           (F.col("part").cast("long") * (1 << 33) + F.col("at")).alias("at"), *fields)
    if not nodes:
        return spark.createDataFrame([], ", ".join(f"{f} {t}" for f, t in _NODE))
    whole = nodes[0]
    for x in nodes[1:]:
        whole = whole.unionByName(x)
    return stored(whole, "trie")


def member_digests(ends: DataFrame, id_text: int = ID_TEXT) -> DataFrame:
    """(prefix, ends_sha256) of (prefix, conv_id): SHA-256 of the ascending ids, comma-joined.

    Ids are sorted over all tasks and joined to texts of up to ``id_text`` characters there; the
    digest then takes a node's texts one after the other, holding one at a time."""
    limit_batches(ends.sparkSession)
    run = (ends.repartitionByRange("prefix", "conv_id").sortWithinPartitions("prefix", "conv_id"))

    def join(batches):
        name, ids, size = None, [], 0

        def row():
            return pa.RecordBatch.from_pydict({"prefix": pa.array([name], pa.binary()), "low": pa.array([int(ids[0])], pa.int64()),
                                               "ids": pa.array([",".join(ids)])})
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (p != name or size > id_text):
                    yield row()
                    ids, size = [], 0
                name = p
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield row()

    def digest(batches):
        name, state, out = None, None, []
        for b in batches:
            for p, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if p != name:
                    if name is not None:
                        out.append((name, state.hexdigest()))
                    name, state = p, hashlib.sha256(t.encode())
                else:
                    state.update(b"," + t.encode())
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])],
                                                 names=["prefix", "ends_sha256"])
                out = []
        if name is not None:
            out.append((name, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])],
                                             names=["prefix", "ends_sha256"])
    texts = run.select("prefix", "conv_id").mapInArrow(join, "prefix binary, low bigint, ids string")
    return (texts.repartition("prefix").sortWithinPartitions("prefix", "low")
            .mapInArrow(digest, "prefix binary, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see :func:`rebuild`): conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null role or text is empty; null turns come first; equal turn numbers are ordered by their
    content's digest; repeated rows are turns of their own; rows without conv_id are left out;
    other columns are ignored; a table without conversations gives an empty result."""
    turns = ordered_turns(conversations)
    rebuilt, lens = rebuild(turns)
    marks, segs = prefixes(rebuilt, segment)
    # the prefix a conversation ends with names its whole sequence
    ends = lens.join(marks.select("conv_id", F.col("pos").alias("len"), "prefix", "below"), ["conv_id", "len"], "left")
    ends = stored(ends.select("conv_id", "len", F.coalesce("prefix", F.lit(ROOT)).alias("prefix"),
                              F.coalesce("below", F.lit(0)).alias("below")), "ends")
    seqs = ends.groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), F.first("len").alias("len"), F.first("below").alias("below"),
                                      F.count("*").alias("n"))
    order = sorted_neighbours(seqs, segs, segment)
    edge = marks.select("conv_id", F.col("pos").alias("lcp"), F.col("prefix").alias("edge_prefix"), F.col("below").alias("edge_below"))
    zero = F.lit(0).cast("long")
    rows = order.join(edge, ["conv_id", "lcp"], "left").select(
        "part", "at", "lcp", F.coalesce("edge_prefix", F.lit(ROOT)).alias("edge_prefix"), F.coalesce("edge_below", zero).alias("edge_below"),
        F.col("len").alias("depth"), "prefix", "below", "conv_id", "n", zero.alias("children"), zero.alias("leaves"), zero.alias("bag"))
    trie = merge_forest(rows, block, fan_in)
    # every depth between two merges, in steps that keep the arrays short
    lows = F.sequence(F.floor((F.col("top") + 1) / segment), F.floor(F.col("depth") / segment))
    path = trie.where("depth > 0").select("*", F.explode(lows).alias("s"))
    low, high = F.greatest(F.col("top") + 1, F.col("s") * segment), F.least(F.col("depth"), (F.col("s") + 1) * segment - 1)
    path = path.select("*", F.explode(F.sequence(low, high)).alias("pos"))
    near = marks.select("conv_id", (F.col("pos") + 1).alias("pos"), F.col("below").alias("before"))
    path = path.join(near, ["conv_id", "pos"], "left").withColumn("before", F.coalesce("before", zero))
    nodes = path.unionByName(trie.where("depth = 0").withColumn("s", zero).withColumn("pos", zero).withColumn("before", zero)
                             .select(path.columns))
    saved = F.col("bag") + (F.col("n") - 1) * (F.col("below") - F.col("before"))
    nodes = nodes.select(
        "conv_id", F.col("pos").alias("depth"), F.col("n").alias("n_convs"),
        F.when(F.col("pos") < F.col("depth"), 1).otherwise(F.col("children")).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.when(F.col("pos") > 0, saved).otherwise(F.col("bag")).alias("saved_tokens"),
        F.when(F.col("pos") == F.col("top") + 1, F.col("parent")).alias("parent"),
        F.when(F.col("pos") == F.col("depth"), F.col("prefix")).alias("name"))
    nodes = stored(nodes, "nodes")
    # a node below another's end takes that one's smallest member
    above = trie.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("up"), F.col("children").alias("k"))
    hung = join_per_key(nodes.where("parent IS NOT NULL"), above, "parent", "k", nodes.count())
    rest = nodes.where("parent IS NULL").withColumn("up", F.when(F.col("depth") > 0, F.col("conv_id"))).withColumn("k", zero)
    whole = hung.select(rest.columns).unionByName(rest)
    digests = member_digests(ends.select("prefix", "conv_id")).withColumnRenamed("prefix", "name")
    return (whole.join(digests, "name", "left")
            .select("conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
