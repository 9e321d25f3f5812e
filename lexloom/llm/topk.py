"""Exact top-k inner-product search by ball trees, one tree a shard.

Components become floor(1024 * x), so scores are integers. Equal vectors are one point with the k + 1
smallest of their ids (one may be the query's own). Points are dealt into shards of about SHARD_ROWS and
stay there; queries travel in blocks, PART_BLOCKS of them at once, to every shard, where a ball tree is built
once for them. A query's search goes down the balls whose upper bound q.c + |q| r reaches its current kth
score, its leaves come in order of that bound, and the kth score is shared: a search of every sqrt(shards)th
shard gives it to all the others. Nothing is dropped: a ball is skipped only if no point in it can reach the
kth score. The work is queries times shards, by the task's own definition.

Null vec_id, and vectors that are null, empty, or hold a null or a non-finite component take no part, as
query or candidate. Only vectors of one length meet. Rows that repeat an id and its vector count once; a
query's own id is never its candidate. Ties go to the smaller id. Scores over 2**53 are computed in
64-bit integers. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm.common import partitions, stored

K, SHARD_ROWS, BLOCK_QUERIES, PART_BLOCKS, LEAF, SCALE = 10, 4096, 512, 64, 64, 1024
NONE = np.iinfo(np.int64).min


def usable(column: str):
    """Condition: a vector without null or non-finite component."""
    return F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, vector): floor(scale * x) as packed 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at = np.asarray(lists.offsets)
            with np.errstate(invalid="ignore"):
                flat = np.floor(scale * np.asarray(lists.values, np.float64)).astype("<i8")
            packed = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(packed, pa.binary())], names=["vec_id", "dim", "vector"])

    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").filter(F.col("vec_id").isNotNull() & usable("embedding"))
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, dim long, vector binary")


class Tree:
    """Ball tree over the rows of an integer matrix; balls are stored parents first."""

    def __init__(self, points: np.ndarray):
        x = points.astype(np.float64)
        self.order = np.arange(len(x))
        center, radius, first, last, child, self.leaves = [], [], [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            a, b, parent = todo.pop()
            me, rows = len(center), x[self.order[a:b]]
            c = rows.mean(0)
            far = ((rows - c) ** 2).sum(1)
            center.append(c)
            radius.append(np.sqrt(far.max()))
            first.append(a)
            last.append(b)
            child.append([])
            if parent >= 0:
                child[parent].append(me)
            if b - a > LEAF and far.max() > 0:
                one = rows[np.argmax(far)]
                two = rows[np.argmax(((rows - one) ** 2).sum(1))]
                side = np.argsort(rows @ (two - one), kind="stable")
                self.order[a:b] = self.order[a:b][side]
                middle = (a + b) // 2
                todo += [(middle, b, me), (a, middle, me)]
        self.center, self.radius = np.array(center), np.array(radius)
        self.first, self.last, self.child = np.array(first), np.array(last), child

    def leaf_order(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) pairs of bounds that reach `least`, sorted by query, then by falling bound: rows query, leaf; bounds."""
        norm = np.sqrt((q * q).sum(1))
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        todo = [(0, np.arange(len(q)))]
        while todo:
            ball, rows = todo.pop()
            dot = q[rows] @ self.center[ball]
            bound = dot + norm[rows] * self.radius[ball]
            bound += 1e-9 * (np.abs(dot) + np.abs(bound)) + 1e-6  # rounding never hides a point
            rows, bound = rows[bound >= least[rows]], bound[bound >= least[rows]]
            if not len(rows):
                continue
            if self.child[ball]:
                todo += [(c, rows) for c in self.child[ball]]
            else:
                found.append((rows, ball, bound))
        if not found:
            return np.zeros((2, 0), np.int64), np.zeros(0)
        query, bound = np.concatenate([r for r, _, _ in found]), np.concatenate([b for _, _, b in found])
        leaf = np.concatenate([np.full(len(r), ball) for r, ball, _ in found])
        order = np.lexsort((-bound, query))
        return np.stack((query[order], leaf[order])), bound[order]


class Best:
    """The current best (score, id) of a block of queries, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.least, self.k = ids, least.copy(), k
        self.score = np.full((len(ids), k), NONE)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where(self.ids[rows][:, None] == ids[None, :], NONE, scores)
        some = (scores >= self.least[rows][:, None]) & (scores > NONE)
        hit = some.any(1)
        if not hit.any():
            return
        rows, scores = rows[hit], np.where(some[hit], scores[hit], NONE)
        s = np.concatenate((self.score[rows], scores), 1)
        i = np.concatenate((self.found[rows], np.where(scores > NONE, ids[None, :], np.iinfo(np.int64).max)), 1)
        top = np.lexsort((i, -s.astype(np.float64) if np.abs(s[s > NONE]).max(initial=0) < 2**53 else ~s), axis=-1)[:, : self.k]
        self.score[rows], self.found[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        self.least[rows] = np.maximum(self.least[rows], self.score[rows, -1])


def search(tree: Tree, points: np.ndarray, id_at: np.ndarray, ids: np.ndarray, queries: np.ndarray, best: Best) -> None:
    """Branch and bound of a block of queries on one shard; point i has the ids ids[id_at[i]:id_at[i + 1]]."""
    exact = max(float(np.abs(points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * points.shape[1], 1) < 2**53
    q, x = (queries.astype(np.float64), points.astype(np.float64)) if exact else (queries, points)
    (query, leaf), bound = tree.leaf_order(queries.astype(np.float64), np.where(best.least == NONE, -np.inf, best.least.astype(np.float64)))
    start = np.searchsorted(query, np.arange(len(queries) + 1))
    turn = 0
    alive = np.flatnonzero(np.diff(start) > 0)
    while len(alive):
        at = start[alive] + turn
        alive = alive[(bound[at] >= best.least[alive].astype(np.float64)) | (best.least[alive] == NONE)]
        at = start[alive] + turn
        for ball in np.unique(leaf[at]):
            rows = alive[leaf[at] == ball]
            place = tree.order[tree.first[ball] : tree.last[ball]]
            n = id_at[place + 1] - id_at[place]
            own = ids[np.repeat(id_at[place] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            scores = q[rows] @ x[place].T
            best.add(rows, np.repeat(np.rint(scores).astype(np.int64) if exact else scores, n, axis=1), own)
        turn += 1
        alive = alive[start[alive] + turn < start[alive + 1]]


def _trees(points: DataFrame) -> DataFrame:
    """(shard, dim, packed points, ids, places of ids) of every shard."""

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("ids").to_pylist()
        id_at = np.cumsum([0, *map(len, ids)]).astype("<i8")
        row = (table.column("shard")[0].as_py(), table.column("dim")[0].as_py(), b"".join(table.column("vector").to_pylist()), id_at.tobytes(), np.concatenate([np.array(x, "<i8") for x in ids]).tobytes())
        return pa.table({n: [v] for n, v in zip(("shard", "dim", "points", "id_at", "ids"), row, strict=True)})

    return points.groupBy("dim", "shard").applyInArrow(build, "shard long, dim long, points binary, id_at binary, ids binary")


def _blocks(queries: DataFrame) -> DataFrame:
    def pack(table: pa.Table) -> pa.Table:
        return pa.table({"block": [table.column("block")[0].as_py()], "dim": [table.column("dim")[0].as_py()], "q_ids": [np.array(table.column("vec_id").to_pylist(), "<i8").tobytes()], "q": [b"".join(table.column("vector").to_pylist())], "least": [np.array(table.column("least").to_pylist(), "<i8").tobytes()]})

    return queries.groupBy("dim", "block").applyInArrow(pack, "block long, dim long, q_ids binary, q binary, least binary")


def _search(blocks: DataFrame, trees: DataFrame, parts: int, shards: int, step: int, k: int) -> DataFrame:
    """At most k candidates of each query from each of the shards 0, step, 2 * step, ..."""
    names = ["query_id", "vec_id", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros((3, 0), np.int64)]
        for r in right.to_pylist():  # one row, or none where a shard has no vector of this length
            points = np.frombuffer(r["points"], "<i8").reshape(-1, r["dim"])
            tree = Tree(points)
            for q_ids, q, least in zip(*(left.column(n) for n in ("q_ids", "q", "least")), strict=True):
                best = Best(np.frombuffer(q_ids.as_py(), "<i8"), np.frombuffer(least.as_py(), "<i8"), k)
                search(tree, points, np.frombuffer(r["id_at"], "<i8"), np.frombuffer(r["ids"], "<i8"), np.frombuffer(q.as_py(), "<i8").reshape(-1, r["dim"]), best)
                row, col = np.nonzero(best.score > NONE)
                out.append(np.stack((best.ids[row], best.found[row, col], best.score[row, col])))
        return pa.table([pa.array(x) for x in np.concatenate(out, 1)], names=names)

    some = F.explode(F.expr(f"sequence(0L, {shards - 1}L, {step}L)"))
    travel = blocks.withColumn("part", F.expr(f"block div {PART_BLOCKS}")).withColumn("shard", some).groupBy("dim", "shard", "part")
    stay = trees.filter(F.col("shard") % step == 0).withColumn("part", F.explode(F.expr(f"sequence(0L, {parts - 1}L)"))).groupBy("dim", "shard", "part")
    return travel.cogroup(stay).applyInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row of `is_query` (a condition on vec_id)."""
    spark = vectors.sparkSession
    rows = stored(integers(vectors, scale).distinct(), "vectors")
    # the smallest ids of a frequent vector, first by salt
    short = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(4 * partitions(spark))))
    for by in (["dim", "vector", "salt"], ["dim", "vector"]):
        short = short.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    points = short.groupBy("dim", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most k + 1 ids
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    trees = stored(_trees(points.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)))), "trees")
    queries = rows.filter(is_query)
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    parts, step = -(-blocks // PART_BLOCKS), max(1, round(shards**0.5))
    first = stored(_search(_blocks(queries.withColumn("least", F.lit(int(NONE)))), trees, parts, shards, step, k), "first")
    kept = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k)
    kth = kept.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least")).withColumnRenamed("query_id", "vec_id")
    bounded = queries.join(kth, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(int(NONE))))
    found = _search(stored(_blocks(bounded), "query-blocks"), trees, parts, shards, 1, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
