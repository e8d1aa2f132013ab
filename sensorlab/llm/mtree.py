"""Exact top-k inner products by best-first search in M-trees.

Inner products are turned into distances: with one more coordinate
sqrt(M^2 - |x|^2), M the largest norm, all objects have norm M, and
d(q, x)^2 = |q|^2 + M^2 - 2 q.x falls as the inner product rises.

The index is an M-tree of three kinds of pages (Ciaccia, Patella and Zezula,
1997).  The root page holds up to ``CELLS`` routing objects with covering
radii; every object belongs to the nearest one.  A cell is cut into subtrees of
about ``TREE`` objects, each a binary row of the stored index: a directory of
routing objects with their distance to the cell's (the parent distance) and the
radii of their leaf pages, and leaf pages of up to ``LEAF`` objects with their
parent distances.  A search visits the subtree of the query's own cell first,
then only the cells that may still hold a better object; within a subtree the
pages in order of their lower bounds.  Stored distances rule out pages and
objects by the triangle inequality before their distance is computed.

Equal vectors are one object with the smallest ids of its rows; equal queries
are searched once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hotkeys import join_per_key
from .scratch import stored
from .textbytes import limit_batches
from .vectors import integer_rows, matrix, padded

#: Routing objects of the root page at most (a broadcast of so many vectors).
CELLS = 1024
#: Objects of a subtree, about; cells beyond it have several.
TREE = 4096
#: Objects of a leaf page.
LEAF = 64
#: Queries searched together.
BLOCK = 512
#: Share of the distance scale that bounds are widened by against rounding.
SLACK = 1e-6


def _work_type(norm2: int):
    """Number type in which inner products of this largest squared norm are exact."""
    if norm2 < 1 << 24:
        return np.float32
    if norm2 < 1 << 53:
        return np.float64
    if norm2 < 1 << 63:
        return np.int64
    raise OverflowError("inner products of these vectors do not fit a long")


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64))


def _distances(a: np.ndarray, a_extra: np.ndarray, b: np.ndarray, b_extra: np.ndarray) -> np.ndarray:
    """Distances of rows (vector, extra coordinate) of ``a`` and ``b``."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    sq = (_squares(a) + a_extra ** 2)[:, None] + (_squares(b) + b_extra ** 2)[None] - 2 * (a @ b.T + np.outer(a_extra, b_extra))
    return np.sqrt(np.maximum(sq, 0))


def _extra(x: np.ndarray, norm2: int) -> np.ndarray:
    return np.sqrt(np.maximum(float(norm2) - _squares(x), 0))


class Geometry:
    """Vector width, largest squared norm and the root page's routing objects."""

    def __init__(self, width: int, norm2: int, pivots: np.ndarray):
        self.width, self.norm2, self.pivots = width, norm2, pivots
        self.pivot_extra = _extra(pivots, norm2)
        self.radius = np.zeros(len(pivots))  # covering radii, known after the assignment
        self.trees = np.ones(len(pivots), np.int64)
        self.eps = SLACK * (2 * sqrt(norm2) + 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(x, _extra(x, self.norm2), self.pivots, self.pivot_extra)
        cell = d.argmin(axis=1)
        return cell, d[np.arange(len(x)), cell]

    def to_pivots(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries (extra coordinate 0) to the routing objects."""
        return _distances(q, np.zeros(len(q)), self.pivots, self.pivot_extra)

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance beyond which no object reaches ``score`` (-inf: any does)."""
        sq = _squares(q) + float(self.norm2) - 2 * score
        return np.where(np.isneginf(score), np.inf, np.sqrt(np.maximum(sq, 0))) + self.eps


def build_subtree(x: np.ndarray, to_parent: np.ndarray, pivot: np.ndarray, geo: Geometry) -> dict:
    """Pages of one subtree: routing objects are every LEAF-th object; leaves
    hold the objects nearest to them in order of that distance, cut at LEAF."""
    extra = _extra(x, geo.norm2)
    seeds = np.arange(0, len(x), LEAF)
    d = _distances(x, extra, x[seeds], extra[seeds])
    home = d.argmin(axis=1)
    dist = d[np.arange(len(x)), home]
    order = np.lexsort((dist, home))
    starts = []
    for a, b in zip(*(lambda s: (s, [*s[1:], len(x)]))(np.flatnonzero(np.diff(home[order], prepend=-1)).tolist()), strict=True):
        starts += range(a, b, LEAF)
    starts = np.array(starts, np.int64)
    ends = np.append(starts[1:], len(x))
    route = seeds[home[order[starts]]]
    return {"order": order, "starts": starts, "ends": ends, "entry_dist": dist[order], "route": x[route],
            "route_extra": extra[route], "route_parent": to_parent[route],
            "low": dist[order][starts], "high": dist[order][ends - 1]}


def search_subtree(tree: dict, x: np.ndarray, q: np.ndarray, parent: np.ndarray, floor: np.ndarray, k: int,
                   geo: Geometry, count: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores of ``q`` with the objects ``x`` of a subtree (in page order), and
    which are known: all that can be among a query's ``k`` best and reach its
    ``floor``.  ``parent``: distances of the queries to the subtree's routing
    object.  ``count``, if given, collects the number of distances computed."""
    kind = _work_type(geo.norm2)
    qw, xw = q.astype(kind), x.astype(kind)
    scores = np.full((len(q), len(x)), -np.inf) if kind is not np.int64 else np.full((len(q), len(x)), -(1 << 62), np.int64)
    known = np.zeros((len(q), len(x)), bool)
    best = floor.copy()
    reach = geo.reach(q, best)
    pages = len(tree["starts"])
    # pages by the stored parent distance first, without a distance to their routing object
    bound = np.abs(parent[:, None] - tree["route_parent"][None]) - tree["high"][None]
    open_ = bound <= reach[:, None]
    some = np.flatnonzero(open_.any(axis=0))
    to_route = np.full((len(q), pages), np.inf)
    if len(some):
        to_route[:, some] = _distances(q, np.zeros(len(q)), tree["route"][some], tree["route_extra"][some])
        near = np.maximum(np.maximum(to_route - tree["high"][None], tree["low"][None] - to_route), 0)
        bound = np.where(open_, np.maximum(bound, near), np.inf)
    else:
        bound[:] = np.inf
    turn = np.argsort(bound, axis=1, kind="stable")
    done, step = 0, 1
    while done < pages:
        wave = turn[:, done:done + step]
        rows = np.arange(len(q))[:, None]
        go = np.zeros((len(q), pages), bool)
        go[rows, wave] = bound[rows, wave] <= reach[:, None]
        for p in np.flatnonzero(go.any(axis=0)):
            who = np.flatnonzero(go[:, p])
            a, b = int(tree["starts"][p]), int(tree["ends"][p])
            # entries by their stored distance to the routing object
            may = np.abs(to_route[who, p][:, None] - tree["entry_dist"][None, a:b]) <= reach[who][:, None]
            cols = a + np.flatnonzero(may.any(axis=0))
            if len(cols):
                scores[np.ix_(who, cols)] = qw[who] @ xw[cols].T
                known[np.ix_(who, cols)] = True
                if count is not None:
                    count.append(len(who) * len(cols))
        done, step = done + step, step * 4
        if done < pages and scores.shape[1] >= k:
            kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            full = known.sum(axis=1) >= k
            best = np.where(full, np.maximum(best, kth.astype(np.float64)), best)
            reach = geo.reach(q, best)
    return scores, known


def _geometry(objects: DataFrame, width: int, cells: int, tree: int) -> Geometry:
    n, norm2 = objects.agg(F.count("*"), F.max("norm2")).first()
    want = min(cells, -(-n // tree))
    chosen = objects.select("x").orderBy(F.xxhash64("x"), "x").limit(want).collect()
    return Geometry(width, int(norm2), np.array([r.x for r in chosen], np.int64).reshape(len(chosen), width))


def _square_norm(x):
    """|x|^2, exactly."""
    return F.aggregate(x, F.lit(0).cast("decimal(38,0)"),
                       lambda a, c: (a + c.cast("decimal(19,0)") * c.cast("decimal(19,0)")).cast("decimal(38,0)"))


class Index:
    """M-tree of the distinct vectors ``x`` (arrays of ``width`` longs, with ``ids``
    and ``norm2``) in the shared folder."""

    def __init__(self, objects: DataFrame, width: int, cells: int = CELLS, tree: int = TREE):
        self.geo = geo = _geometry(objects, width, cells, tree)
        limit_batches(objects.sparkSession)

        def assign(batches):
            for b in batches:
                cell, dist = geo.nearest(matrix(b.column(b.schema.get_field_index("x")), width))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(dist)],
                                                 names=[*b.schema.names, "cell", "dist"])
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in objects.schema)
        placed = stored(objects.mapInArrow(assign, f"{schema}, cell int, dist double"), "placed")
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r")).collect()
        for r in sizes:  # one row per cell of the root page
            geo.radius[r.cell], geo.trees[r.cell] = r.r, -(-r.n // tree)
        salts = F.get(F.array(*[F.lit(int(t)) for t in geo.trees]), F.col("cell")).cast("long")
        keyed = placed.withColumn("salt", F.pmod(F.xxhash64(F.lit(5), "x"), salts).cast("int"))

        def pack(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            x = matrix(table["x"].combine_chunks(), width)
            turn = np.lexsort(x.T[::-1])  # the same pages whatever order the rows came in
            x, dist = x[turn], table["dist"].to_numpy()[turn]
            cell = table["cell"][0].as_py()
            t = build_subtree(x, dist, geo.pivots[cell], geo)
            order = t.pop("order")
            ids = table["ids"].take(pa.array(turn[order]))
            row = {"cell": [cell], "salt": [table["salt"][0].as_py()], "x": [x[order].tobytes()], "n": [len(x)],
                   "ids": [ids.combine_chunks().to_pylist() if hasattr(ids, "combine_chunks") else ids.to_pylist()]}
            row |= {name: [np.ascontiguousarray(v).tobytes()] for name, v in t.items()}
            return pa.table(row, schema=out_schema)
        ids_type = objects.schema["ids"].dataType
        from pyspark.sql.pandas.types import to_arrow_type
        parts = ["starts", "ends", "entry_dist", "route", "route_extra", "route_parent", "low", "high"]
        out_schema = pa.schema([("cell", pa.int32()), ("salt", pa.int32()), ("x", pa.binary()), ("n", pa.int64()),
                                ("ids", pa.list_(to_arrow_type(ids_type))), *[(p, pa.binary()) for p in parts]])
        ddl = (f"cell int, salt int, x binary, n bigint, ids array<{ids_type.simpleString()}>, "
               + ", ".join(f"{p} binary" for p in parts))
        self.parts = parts
        self.trees = stored(keyed.groupBy("cell", "salt").applyInArrow(pack, ddl), "subtrees")

    def search(self, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
        """For every (qid, x) of ``queries`` its ``k`` best entries (qid, score, entry):
        entries are the elements of the objects' ``ids``, ordered by score (falling), then entry."""
        geo, width, parts = self.geo, self.geo.width, self.parts
        spark = queries.sparkSession
        limit_batches(spark)

        def home(batches):
            for b in batches:
                x = matrix(b.column(1), width)
                cell, _ = geo.nearest(x)
                # where the query's distance is least
                cell = geo.to_pivots(x).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32())], names=["qid", "x", "cell"])
        start = queries.select("qid", "x").mapInArrow(home, "qid bigint, x array<bigint>, cell int")
        salts = F.get(F.array(*[F.lit(int(t)) for t in geo.trees]), F.col("cell")).cast("long")
        start = stored(start.withColumn("salt", F.pmod(F.xxhash64(F.lit(5), "x"), salts).cast("int"))
                       .withColumn("floor", F.lit(float("-inf"))), "queries")

        entry = self.trees.schema["ids"].dataType.elementType.elementType.simpleString()

        def look(batches):
            for b in batches:
                for r in b.to_pylist():
                    x = np.frombuffer(r["x"], np.int64).reshape(-1, width)
                    tree = {p: np.frombuffer(r[p], np.int64 if p in ("starts", "ends", "route") else np.float64) for p in parts}
                    tree["route"] = tree["route"].reshape(-1, width)
                    q = np.array([e["x"] for e in r["block"]], np.int64).reshape(-1, width)
                    floor = np.array([e["floor"] for e in r["block"]], np.float64)
                    parent = _distances(q, np.zeros(len(q)), geo.pivots[[r["cell"]]], geo.pivot_extra[[r["cell"]]])[:, 0]
                    scores, known = search_subtree(tree, x, q, parent, floor, k, geo)
                    found = []
                    for e, s, seen in zip(r["block"], scores, known, strict=True):
                        at = np.flatnonzero(seen & (s >= e["floor"]))
                        if len(at) > k:  # objects that tie with the k-th stay
                            at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                        got = sorted(((-int(s[i]), j["id"] is None, j["id"] if j["id"] is not None else 0, j)
                                      for i in at for j in r["ids"][i]), key=lambda t: t[:3])[:k]
                        found += [{"qid": e["qid"], "score": -g[0], "entry": g[3]} for g in got]
                    if found:
                        yield pa.RecordBatch.from_pylist(found, schema=found_schema)
        from pyspark.sql.pandas.types import to_arrow_type
        found_schema = pa.schema([("qid", pa.int64()), ("score", pa.int64()),
                                  ("entry", to_arrow_type(self.trees.schema["ids"].dataType.elementType.elementType))])

        def blocks(q: DataFrame) -> DataFrame:
            """Queries for one subtree in rows of about ``block``."""
            sizes = q.groupBy("cell", "salt").count().withColumnRenamed("count", "m")
            parts_of = join_per_key(q.withColumn("at", F.struct("cell", "salt")),
                                    sizes.select(F.struct("cell", "salt").alias("at"), "m"), "at", "m", q.count())
            part = F.pmod(F.xxhash64(F.lit(6), "qid"), F.ceil(F.col("m") / block)).cast("int")
            return (parts_of.withColumn("part", part).groupBy("cell", "salt", "part")
                    .agg(F.collect_list(F.struct("qid", "x", "floor")).alias("block")).drop("part"))

        def best(found: DataFrame) -> DataFrame:
            order = [F.col("score").desc(), F.col("entry.id").asc_nulls_last()]
            rank = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
            return found.withColumn("place", rank).where(F.col("place") <= k)

        def visit(q: DataFrame) -> DataFrame:
            return blocks(q).join(self.trees, ["cell", "salt"]).mapInArrow(look, f"qid bigint, score bigint, entry {entry}")

        first = stored(best(visit(start)).drop("place"), "first-wave")
        floors = first.groupBy("qid").agg(F.count("*").alias("c"), F.min("score").alias("s")).where(F.col("c") >= k)
        rest = start.drop("floor").join(floors.select("qid", F.col("s").cast("double").alias("floor")), "qid", "left")
        rest = rest.withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))).select("qid", "x", "cell", "salt", "floor")

        def onward(batches):
            """Of every query the subtrees whose cell may hold an object that reaches its floor, but the first."""
            for b in batches:
                x = matrix(b.column(1), width)
                own, salt = b.column(2).to_numpy(), b.column(3).to_numpy()
                floor = b.column(4).to_numpy()
                may = geo.to_pivots(x) - geo.radius[None] <= geo.reach(x, floor)[:, None]
                for c in np.flatnonzero(may.any(axis=0)):
                    for s in range(int(geo.trees[c])):
                        who = np.flatnonzero(may[:, c] & ~((own == c) & (salt == s)))
                        if len(who):
                            take = pa.array(who)
                            yield pa.RecordBatch.from_arrays(
                                [b.column(0).take(take), b.column(1).take(take), pa.array(np.full(len(who), c), pa.int32()),
                                 pa.array(np.full(len(who), s), pa.int32()), b.column(4).take(take)],
                                names=["qid", "x", "cell", "salt", "floor"])
        second = stored(rest.mapInArrow(onward, "qid bigint, x array<bigint>, cell int, salt int, floor double"), "onward")
        return best(first.unionByName(visit(second))).select("qid", "score", "entry", "place")


def top_k(df: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id",
          vec_col: str = "embedding", cells: int = CELLS, tree: int = TREE, block: int = BLOCK) -> DataFrame:
    """The ``k`` highest integer inner products of every query row with all other
    rows: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    Queries are the rows whose id is divisible by ``every``.  Ties go to the
    smaller id (null last).  Rows with a null vector, or one holding null or
    non-finite components, take no part; shorter vectors are filled up with
    zeros.  Of repeated rows each is a query and a candidate of the others.
    Null ids are candidates, never queries.  Other columns are ignored; without
    queries or candidates the result is empty.  Inner products beyond 64 bits
    are an error.
    """
    spark = df.sparkSession
    limit_batches(spark)
    rows = integer_rows(df, scale, id_col, vec_col)
    kind = df.schema[id_col].dataType.simpleString()
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if width is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score bigint")
    width = max(width, 1)
    # copies: rows with one id and one vector
    rows = stored(padded(rows, width).groupBy("id", "x").agg(F.count("*").alias("copies")), "vectors")
    place = F.row_number().over(Window.partitionBy("x").orderBy(F.col("id").asc_nulls_last()))
    objects = (rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("x")
               .agg(F.sort_array(F.collect_list(F.struct("place", F.struct("id", "copies").alias("e")))).alias("ids"))
               .select("x", F.transform("ids", lambda e: e.e).alias("ids"), _square_norm(F.col("x")).alias("norm2")))
    objects = stored(objects, "objects")
    asked = rows.where(F.col("id") % every == 0)
    asking = stored(asked.groupBy("x").agg(F.count("*").alias("m")).withColumn("qid", F.monotonically_increasing_id()), "asked")
    index = Index(objects, width, cells, tree)
    found = index.search(asking.select("qid", "x"), k + 1, block)

    # one list per distinct query: rows of an entry as often as it has copies
    flat = found.select("qid", F.explode(F.sequence(F.lit(1), F.least(F.col("entry.copies"), F.lit(k + 1)).cast("int"))).alias("copy"),
                        "place", "score", F.col("entry.id").alias("id"))
    lists = (flat.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", "copy", "score", "id"))).alias("hits"))
             .select("qid", F.transform(F.slice("hits", 1, k + 1), lambda h: F.struct(h.score.alias("score"), h.id.alias("id"))).alias("hits")))
    per_x = asking.join(lists, "qid").select("x", "m", "hits", _square_norm(F.col("x")).cast("bigint").alias("own"))
    out = join_per_key(asked, per_x, "x", "m", asked.count())
    self_at = F.array_position("hits", F.struct(F.col("own").alias("score"), F.col("id").alias("id")))
    others = F.slice(F.filter("hits", lambda h, i: i + 1 != self_at), 1, k)
    return (out.select(F.col("id").alias("query_id"), others.alias("hits"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("query_id", F.posexplode("hits").alias("i", "h"))
            .select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("h.id").alias("vec_id"), F.col("h.score").alias("score")))
