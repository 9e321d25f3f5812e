"""Context selection: token budgets, nearest chunks, assembled contexts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import text as T
from lexloom.sources.scratch import written

# Prompt budgets in tokens, by model family.
BUDGETS = {"gpt": 120_000, "claude": 150_000, "gemini": 990_000}
K = 150
#: Queries in a matrix, chunks in a shard, pivots, queries for which chunks are dealt once.
BLOCK, SHARD, PIVOTS, TRAVEL = 512, 8192, 64, 32_768
#: Vector lengths that have pivots, the most frequent ones; others have the origin.
LENGTHS, LONGEST = 8, 16_384


def budget_gate(lines: DataFrame, word: str, text: str, budget: int) -> DataFrame:
    """word, n_lines, tokens, fits: whether all lines joined by line ends stay under the budget."""
    g = lines.groupBy(word).agg(F.count("*").alias("n_lines"), F.sum(F.length(text)).alias("chars"))
    tokens = F.greatest(F.lit(1), F.floor((F.col("chars") + F.col("n_lines") - 1) / 4)).cast("long")
    return g.select(word, "n_lines", tokens.alias("tokens"), (tokens < budget).alias("fits"))


def nearest(queries: DataFrame, chunks: DataFrame, k: int = K, on: list[str] | None = None) -> DataFrame:
    """query_id, chunk_id, distance, rank: the k nearest chunks by squared L2, ties to the smaller chunk.

    queries: query_id, q; chunks: chunk_id, v; `on`: columns both share and that must be equal. Vectors that are
    null or hold a null or non-finite component take no part, vectors of different lengths don't meet.

    Chunks lie in the cells of their nearest of at most PIVOTS pivots, large cells in shards of about SHARD rows. Of a
    cell its size and the largest distance to its pivot are known, so a query knows without looking at any chunk a
    distance within which k of them must lie, and travels only to shards of cells that can hold one as near. Chunks
    stay, once for each TRAVEL queries; a shard meets its queries as matrices, BLOCK queries at once, and keeps the k best.
    """
    on = on or []
    good = lambda c: f"{c} is not null and size({c}) > 0 and forall({c}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    queries, chunks = queries.filter(good("q")), chunks.filter(good("v"))
    travels = max(1, -(-queries.count() // TRAVEL))
    pivots = {dim: np.array(some, np.float64) for dim, some in _pivots(chunks)}
    held = _measured(chunks, "v", pivots, False)
    cells = held.groupBy(*on, "dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).withColumn("shards", F.expr(f"(n + {SHARD} - 1) div {SHARD}"))
    cells = written(cells, "cells")
    by_group = cells.groupBy(*on, "dim").agg(F.sort_array(F.collect_list(F.struct("cell", "n", "radius", "shards"))).alias("cells"))  # at most PIVOTS of a group and length
    q = _measured(queries, "q", pivots, True).join(by_group, [*on, "dim"])
    reach = lambda x: F.element_at("away", x["cell"] + 1)
    bounds = F.array_sort(F.transform("cells", lambda x: F.struct((reach(x) + x["radius"]).alias("most"), x["n"].alias("n"))))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("within"))
    within = F.reduce(bounds, none, lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.coalesce(a["within"], F.when(a["n"] + x["n"] >= k, x["most"])).alias("within")), lambda a: a["within"])
    q = q.withColumn("within", F.coalesce(within, F.lit(float("inf"))) * (1 + 1e-9) + 1e-5)  # ranks go by rounded distances
    visited = F.filter("cells", lambda x: reach(x) - x["radius"] <= F.col("within"))
    q = q.withColumn("visit", F.explode(visited)).select(*on, "query_id", "q", "dim", "visit.cell", F.explode(F.expr("sequence(0L, visit.shards - 1L)")).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(travels)).alias("travel"))
    c = held.join(cells.select(*on, "dim", "cell", "shards"), [*on, "dim", "cell"]).select(*on, "chunk_id", "v", "dim", "cell", F.expr("pmod(xxhash64(chunk_id), shards)").alias("shard"), F.explode(F.expr(f"sequence(0L, {travels - 1}L)")).alias("travel"))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[len(on)].as_py()
        x, y = (np.asarray(t.column(n).combine_chunks().flatten(), np.float64).reshape(t.num_rows, dim) for t, n in ((left, "q"), (right, "v")))
        rows, columns, found = [], [], []
        for first in range(0, len(x) if len(y) else 0, BLOCK):
            part = x[first : first + BLOCK]
            distance = np.zeros((len(part), len(y)))
            for j in range(dim):  # in the order of the components, as a sum over an array goes
                step = part[:, j, None] - y[None, :, j]
                distance += step * step
            most = np.partition(distance, k - 1, axis=1)[:, k - 1 : k] if distance.shape[1] > k else np.full((len(part), 1), np.inf)
            row, col = np.nonzero(distance <= most + 1e-5)  # ranks go by rounded distances
            rows.append(row + first)
            columns.append(col)
            found.append(distance[row, col])
        row, col, found = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, columns, found))
        row, col = pa.array(row, pa.int64()), pa.array(col, pa.int64())
        same = [pa.array([value.as_py()] * len(row), value.type) for value in key[: len(on)]]
        return pa.table([*same, left.column("query_id").take(row), right.column("chunk_id").take(col), pa.array(found, pa.float64())], names=[*on, "query_id", "chunk_id", "distance"])

    kinds = dict(queries.dtypes) | dict(chunks.dtypes)
    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in on), f"query_id {kinds['query_id']}", f"chunk_id {kinds['chunk_id']}", "distance double"])
    by = [*on, "dim", "travel", "cell", "shard"]
    d = q.groupBy(*by).cogroup(c.groupBy(*by)).applyInArrow(meet, schema).withColumn("distance", F.round("distance", 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return d.withColumn("rank", rank).filter(F.col("rank") <= k)


def _pivots(chunks: DataFrame) -> list[tuple[int, list]]:
    """(length, at most PIVOTS vectors) of the LENGTHS most frequent vector lengths up to LONGEST, chosen by a hash."""
    sized = chunks.select("chunk_id", F.size("v").alias("dim"), "v").filter(F.col("dim") <= LONGEST)
    lengths = [r["dim"] for r in sized.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()]
    order = Window.partitionBy("dim").orderBy(F.xxhash64("chunk_id"), "chunk_id")
    some = sized.filter(F.col("dim").isin(lengths)).withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= PIVOTS)
    found: dict[int, list] = {}
    for r in some.select("dim", "v").collect():
        found.setdefault(r["dim"], []).append(r["v"])
    return sorted(found.items())


def _measured(rows: DataFrame, vector: str, pivots: dict[int, np.ndarray], every: bool) -> DataFrame:
    """Adds dim and, with `every`, away: the distances to all pivots; else cell and far: the nearest pivot and the distance to it."""
    at, more = rows.columns.index(vector), "dim int, away array<double>" if every else "dim int, cell int, far double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False)
            away: list = [None] * batch.num_rows
            for dim in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == dim)
                x = np.asarray(batch.column(at).take(pa.array(some)).flatten(), np.float64).reshape(len(some), dim)
                p = pivots.get(dim, np.zeros((1, dim)))
                apart = np.stack([np.sqrt(((x - one) ** 2).sum(1)) for one in p], 1)
                for i, d in zip(some.tolist(), apart, strict=True):
                    away[i] = d
            columns = [*batch.columns, pa.array(sizes, pa.int32())]
            if every:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(away, pa.list_(pa.float64()))], names=[*batch.schema.names, "dim", "away"])
            else:
                cell = [int(d.argmin()) for d in away]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cell, pa.int32()), pa.array([float(d[i]) for d, i in zip(away, cell, strict=True)], pa.float64())], names=[*batch.schema.names, "dim", "cell", "far"])

    return rows.mapInArrow(run, ", ".join([*(f"`{n}` {kind}" for n, kind in rows.dtypes), more]))


def assemble(parts: DataFrame, word: str, order: str, text: str, retrieved: bool) -> DataFrame:
    """word, context: the lines in order joined by line ends, or the retrieved chunks with rules between them.

    Only for words that passed the budget gate, or for the k retrieved chunks: the text stays bounded.
    """
    sign = "\n---\n" if retrieved else "\n"
    return parts.groupBy(word).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), sign).alias("context"))


def missing_embeddings(chunks: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Chunks whose vectors are not stored yet."""
    return chunks.join(cached.select(key), key, "left_anti")


#: What the row of a keyword without context says.
MISSING = {"sense_no": 1, "sense": T.NOT_PROCESSED, "sense_count": 0, "frequency": "kontekstifail puudub", "examples": "ei saadaval", "register": T.UNSPECIFIED, "register_reason": "ei saadaval", "training_reason": "ei saadaval", "label": "ei kohaldu", "label_reason": "ei saadaval"}


def with_missing_rows(keywords: DataFrame, contexts: DataFrame, word: str = "word") -> DataFrame:
    """A row for every keyword; one without context has the placeholder answers, the others have nulls there."""
    j = keywords.join(contexts, word, "left")
    missing = F.col("context").isNull()
    return j.select(*keywords.columns, F.coalesce("context", F.lit("")).alias("context"), *[F.when(missing, F.lit(v)).alias(n) for n, v in MISSING.items()])
