"""Uniform shuffle into shards of exact sizes, from Spark functions alone.

Rows come in blocks.  A communication matrix says how many rows of each block
go to each shard; it is drawn from the distribution that a uniform shuffle of
all rows would give it (multivariate hypergeometric, with block sizes and shard
sizes as margins) by halving the blocks again and again: the shard sizes of a
group of blocks are split between its two halves with one hypergeometric draw
per shard.  Each block is permuted and cut at its row of the matrix, the pieces
are exchanged, and every shard is permuted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from .scratch import stored

#: Rows of one input partition in a block, at most; a block is permuted by one task.
BLOCK_ROWS = 1 << 18
#: Rows aimed at in a part of a shard that one task permutes.
PART_ROWS = 1 << 18


def _uniform(seed: int, *cols) -> Column:
    """A number in (0, 1) that the columns and the seed fix."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12)
    return (h.cast("double") + 0.5) / F.lit(float(1 << 52))


def hypergeometric(u: Column, total: Column, good: Column, draws: Column) -> Column:
    """Number of good items in ``draws`` out of ``total`` items of which
    ``good`` are good, as a uniform ``u`` picks it: the outcomes share out
    (0, 1) by their probability, the mode first, then those below it downwards,
    then those above.  The weights are followed from the mode by their ratios,
    over 12 standard deviations and 40 more values on either side, beyond which
    they are under 1e-30 of the whole."""
    t, k, n = total.cast("double"), good.cast("double"), draws.cast("double")
    lo, hi = F.greatest(F.lit(0.0), n + k - t), F.least(n, k)
    mode = F.least(hi, F.greatest(lo, F.floor((n + 1) * (k + 1) / (t + 2)).cast("double")))
    spread = F.sqrt(n * (k / t) * (1 - k / t) * (t - n) / F.greatest(t - 1, F.lit(1.0)))
    reach = F.ceil(12 * spread).cast("double") + 40
    a, b = F.greatest(lo, mode - reach).cast("long"), F.least(hi, mode + reach).cast("long")

    def after(w, x):  # weight of x + 1 from that of x
        return w * (k - x) * (n - x) / ((x + 1) * (t - k - n + x + 1))

    def before(w, x):  # weight of x - 1 from that of x
        return w * x * (t - k - n + x) / ((k - x + 1) * (n - x + 1))

    def side(first, last, step, move):
        """Weights from the mode (left out) to one end: struct of the last weight and their sum."""
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))

        def grow(acc, x):
            w = move(acc.w, x.cast("double"))
            return F.struct(w.alias("w"), (acc.s + w).alias("s"))
        return F.when(first == last, F.lit(0.0)).otherwise(
            F.aggregate(F.sequence(first, last - step, F.lit(step).cast("long")), start, grow, lambda acc: acc.s))
    m = mode.cast("long")

    def pick(left):
        """Walk down from the mode, then up, until the share ``u`` of all weight is used."""
        def chosen(goal):
            def walk(first, last, step, move, used):
                start = F.struct(F.lit(1.0).alias("w"), used.cast("double").alias("s"), F.lit(None).cast("long").alias("x"))

                def go(acc, x):
                    w = move(acc.w, x.cast("double"))
                    s = acc.s + w
                    return F.struct(w.alias("w"), s.alias("s"),
                                    F.coalesce(acc.x, F.when(s >= goal, x + step)).alias("x"))
                return F.when(first == last, last).otherwise(F.aggregate(
                    F.sequence(first, last - step, F.lit(step).cast("long")), start, go, lambda acc: F.coalesce(acc.x, last)))
            return (F.when(goal <= 1.0, m).when(goal <= 1.0 + left, walk(m, a, -1, before, F.lit(1.0)))
                    .otherwise(walk(m, b, 1, after, 1.0 + left)))
        return let(u * (1.0 + left + side(m, b, 1, after)), chosen)
    return F.when(a == b, a).otherwise(let(side(m, a, -1, before), pick))


def _split(seed: int, node, sizes, n_left, total) -> Column:
    """Draw how many of ``n_left`` rows go to each shard, out of ``total`` rows that fill ``sizes``."""
    start = F.struct(total.cast("long").alias("t"), n_left.cast("long").alias("n"), F.array().cast("array<long>").alias("x"))

    def draw(acc, cap):
        def put(x):
            return F.struct((acc.t - cap).alias("t"), (acc.n - x).alias("n"), F.concat(acc.x, F.array(x)).alias("x"))
        x = F.when((acc.n == 0) | (cap == 0), F.lit(0).cast("long")).when(acc.t == acc.n, cap).otherwise(
            hypergeometric(_uniform(seed, node, F.size(acc.x)), acc.t, cap, acc.n))
        return let(x, put)
    return F.aggregate(sizes, start, draw, lambda acc: acc.x)


def communication_matrix(blocks: DataFrame, shard_sizes: list[int], seed: int = 0) -> DataFrame:
    """One row per block with ``counts``: its rows for each shard.

    ``blocks`` has ``pos`` (0, 1, ...) and ``n`` (rows).  Every level of the
    halving is one step over groups of blocks, so the depth is the logarithm
    of the number of blocks; prefix sums of ``n`` are looked up by join.
    """
    spark = blocks.sparkSession
    # rows in front of each block, by groups of positions so that no window spans all blocks
    group = F.floor(F.col("pos") / 4096)
    per = blocks.groupBy(group.alias("g")).agg(F.sum("n").alias("gn"))
    base = per.select("g", (F.sum("gn").over(Window.orderBy("g")) - F.col("gn")).alias("base"))
    inner = F.sum("n").over(Window.partitionBy("g").orderBy("pos")) - F.col("n")
    starts = (blocks.withColumn("g", group).withColumn("inner", inner).join(base, "g")
              .select("pos", (F.col("base") + F.col("inner")).alias("at"), "n"))
    starts = stored(starts, "block-starts")
    n_blocks, total = starts.agg(F.count("*"), F.sum("n")).first()
    if not n_blocks:
        return spark.createDataFrame([], "pos long, counts array<long>")
    ends = starts.select("pos", "at").union(spark.createDataFrame([(n_blocks, total)], "pos long, at long"))
    size = 1
    while size < n_blocks:
        size *= 2
    nodes = spark.createDataFrame([(0, total, list(shard_sizes))], "first long, rows long, counts array<long>")
    level = 0
    while size > 1:
        half = size // 2
        mid = F.least(F.col("first") + half, F.lit(n_blocks))
        cut = nodes.withColumn("mid", mid)
        cut = (cut.join(ends.select(F.col("pos").alias("first"), F.col("at").alias("a")), "first")
               .join(ends.select(F.col("pos").alias("mid"), F.col("at").alias("m")), "mid")
               .withColumn("left_rows", F.col("m") - F.col("a")))
        cut = cut.withColumn("left", F.when(F.col("left_rows") == F.col("rows"), F.col("counts")).otherwise(
            _split(seed, F.struct(F.lit(level), F.col("first")), F.col("counts"), F.col("left_rows"), F.col("rows"))))
        left = F.struct(F.col("first"), F.col("left_rows").alias("rows"), F.col("left").alias("counts"))
        right = F.struct(F.col("mid").alias("first"), (F.col("rows") - F.col("left_rows")).alias("rows"),
                         F.zip_with("counts", "left", lambda c, x: c - x).alias("counts"))
        nodes = (cut.select(F.explode(F.array(left, right)).alias("c")).select("c.*").where(F.col("first") < n_blocks))
        nodes = stored(nodes, "halving")
        size, level = half, level + 1
    return nodes.select(F.col("first").alias("pos"), "counts")


def shuffle_into_shards(rows: DataFrame, n_shards: int, key_cols: list[str], seed: int = 0) -> DataFrame:
    """``rows`` with ``shard`` (0 to n_shards - 1) and ``slot`` (its place in the shard, gapless from 0).

    The assignment is a uniform shuffle that ``seed`` fixes; shard sizes differ
    by one at most (the first ones are the larger).  ``key_cols`` order rows
    before the seed permutes them, so that the outcome does not hang on the
    order of input rows within a block; rows equal in all of them, nulls
    included, may change places.  Columns named shard or slot are replaced.
    Any table will do, an empty one too.
    """
    keep = [c for c in rows.columns if c not in ("shard", "slot")]
    mid = F.monotonically_increasing_id()
    block = F.shiftrightunsigned(mid, 33) * (1 << 20) + F.floor(mid.bitwiseAND(F.lit((1 << 33) - 1)) / BLOCK_ROWS)
    data = stored(rows.select(*[F.col(f"`{c}`") for c in keep], block.alias("__block")), "shard-rows")
    sizes = data.groupBy("__block").agg(F.count("*").alias("n"))
    # number the blocks: by partition first, then within groups of them
    sizes = stored(sizes.withColumn("__g", F.floor(F.col("__block") / (1 << 30))), "blocks")
    per = sizes.groupBy("__g").agg(F.count("*").alias("k"))
    per = per.select("__g", (F.sum("k").over(Window.orderBy("__g")) - F.col("k")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("__g").orderBy("__block")) - 1
    blocks = stored(sizes.withColumn("rank", rank).join(per, "__g")
                    .select("__block", "n", (F.col("base") + F.col("rank")).cast("long").alias("pos")), "numbered")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    want = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix(blocks.select("pos", "n"), want, seed)
    cuts = blocks.join(matrix, "pos").select(
        "__block", F.transform("counts", lambda c, i: F.aggregate(F.slice("counts", 1, i + 1), F.lit(0).cast("long"),
                                                                  lambda a, x: a + x)).alias("__ends"))
    key = [F.col(f"`{c}`") for c in key_cols]
    first = F.row_number().over(Window.partitionBy("__block").orderBy(F.xxhash64(F.lit(seed), F.lit(1), *key), *key)) - 1
    placed = data.withColumn("__at", first).join(cuts, "__block")
    shard = F.size(F.filter("__ends", lambda e: e <= F.col("__at")))
    # the second permutation: order by a hash, cut into even ranges of it so that no task has a whole shard
    parts = max(1, -(-total // n_shards) // PART_ROWS)
    turn = _uniform(seed + 1, F.col("__block"), F.col("__at"))
    placed = placed.select(*[F.col(f"`{c}`") for c in keep], shard.alias("shard"), turn.alias("__turn"),
                           F.floor(turn * parts).cast("int").alias("__part"), "__block", "__at")
    placed = stored(placed, "placed")
    held = placed.groupBy("shard", "__part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("__part")) - F.col("n")
    held = held.select("shard", "__part", before.alias("__before"))
    slot = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__turn", "__block", "__at")) - 1
    out = placed.withColumn("__slot", slot).join(held, ["shard", "__part"])
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("shard"),
                      (F.col("__before") + F.col("__slot")).cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str) -> None:
    """Write rows that carry ``shard`` and ``slot`` as Parquet, one folder per
    shard, in slot order within each file."""
    span = F.floor(F.col("slot") / PART_ROWS)
    rows.repartition("shard", span).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
