"""Near-duplicate vectors of one label by Euclidean p-stable hashing and exact cosines.

Normalised vectors are projected on random normal directions and cut into cells of WIDTH; PROJECTIONS
cells make a bucket key and TABLES keys are drawn. Two vectors of cosine 0.98 are 0.2 apart, fall into one
cell with a chance of 0.92, so into one bucket of a table with 0.26, and miss all tables with a chance of
0.74 ** 27 = 2.5e-4; closer pairs miss far less. Unrelated ones share a table's bucket with a chance of 1e-5.

Equal vectors of a label are one node with a count. Keys are dealt without vectors; only members of buckets
of two nodes or more get theirs. Within a bucket, blocks of BLOCK_ROWS nodes meet and their cosines are
computed as a matrix product; a link is counted in the first table where both share a bucket, and a block
gives one row for each of its nodes (links counted, smallest local node), never the pairs. So a large
bucket costs arithmetic, not rows.

Labels are of any type and compared as text. Vectors that are null, empty, zero or hold a null or non-finite
component, and rows without label, have no links. A null vec_id has no links and a null component. Repeated
rows are linked copies; kept marks rows whose id is their component's. Vectors of different lengths never
link. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import components, mix, partitions, runs, stored
from lexloom.llm.topk import usable

THRESHOLD, TABLES, PROJECTIONS, WIDTH, BLOCK_ROWS, SEED = 0.98, 27, 16, 2.0, 512, 3


def keys(x: np.ndarray) -> np.ndarray:
    """A bucket key for each row and table; rows have length one."""
    rng = np.random.default_rng((SEED, x.shape[1]))
    a, b = rng.normal(size=(x.shape[1], TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS)
    cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(x), TABLES, PROJECTIONS)
    out = np.zeros((len(x), TABLES), np.uint64)
    for j in range(PROJECTIONS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
    return out


def _hashed(nodes: DataFrame) -> DataFrame:
    """Adds the keys, as packed 64-bit integers, and the unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, dims = batch.column(3).to_pylist(), batch.column(4).to_numpy()
            unit, key = [b""] * len(packed), [b""] * len(packed)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(packed[i] for i in rows), np.float64).reshape(-1, dim)
                x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                k = keys(x)
                for n, i in enumerate(rows):
                    unit[i], key[i] = x[n].tobytes(), k[n].tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(unit, pa.binary()), pa.array(key, pa.binary())], names=["node", "label", "copies", "dim", "unit", "keys"])

    return nodes.select("node", "label", "copies", "vector", "dim").mapInArrow(run, "node long, label string, copies long, dim int, unit binary, keys binary")


BUCKET = ["label", "dim", "table", "key"]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group of two blocks (or one) of a bucket: links of the nodes that this table counts, and their local roots."""
    for c, groups in runs(batches, BUCKET + ["g", "h"]):
        nodes, copies, blocks = (np.array(c[n]) for n in ("node", "copies", "block"))
        out: list[np.ndarray] = []
        for first, end in groups:
            table, g, h = c["table"][first], c["g"][first], c["h"][first]
            node, block = nodes[first:end], blocks[first:end]
            x = np.frombuffer(b"".join(c["unit"][first:end]), np.float64).reshape(end - first, -1)
            key = np.frombuffer(b"".join(c["keys"][first:end]), np.uint64).reshape(end - first, -1)
            left = np.flatnonzero(block == g)
            right = np.flatnonzero(block == h) if g != h else left
            i, j = np.nonzero(x[left] @ x[right].T >= THRESHOLD)
            i, j = left[i], right[j]
            i, j = (i, j) if g != h else (i[i < j], j[i < j])
            new = ~(key[i, :table] == key[j, :table]).any(1)
            i, j = i[new], j[new]
            if not len(i):
                continue
            own = copies[first:end]
            links = np.bincount(i, own[j], end - first) + np.bincount(j, own[i], end - first)
            root, old = node.copy(), None
            while old is None or (root != old).any():
                old = root.copy()
                low = np.minimum(root[i], root[j])
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
            some = links > 0
            out.append(np.stack((node[some], links[some].astype(np.int64), root[some])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, 1)], names=["node", "links", "root"])


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), v.alias("v"))
    good = usable("v") & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = rows.withColumn("node", F.when(good, F.xxhash64("label", F.transform("v", lambda x: x + F.lit(0.0)))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at, flat = np.asarray(lists.offsets), np.asarray(lists.values, np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array(np.diff(at).astype(np.int32))], names=["node", "label", "vector", "dim"])

    rows = stored(rows.select("vec_id", "label", "v", "node"), "vectors")
    counts = rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    # one row of each node: the first by id; a repeated row of it falls to dropDuplicates
    one = rows.filter("node is not null").join(counts, "node").filter("vec_id = first").dropDuplicates(["node"])
    packed = one.select("node", "label", "v").mapInArrow(pack, "node long, label string, vector binary, dim int").join(counts.select("node", "copies"), "node")
    nodes = stored(_hashed(packed), "hashed")
    each = F.transform(F.sequence(F.lit(0), F.lit(TABLES - 1)), lambda t: F.substring("keys", t * 8 + 1, F.lit(8)))
    deal = nodes.select("node", "label", "dim", F.posexplode(each).alias("table", "key"))
    size = deal.groupBy(*BUCKET).agg(F.count("*").alias("n")).filter("n > 1")
    member = stored(deal.join(size, BUCKET), "members").withColumn("blocks", F.expr(f"(n + {BLOCK_ROWS} - 1) div {BLOCK_ROWS}")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    meet = member.select(*BUCKET, "node", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    meet = meet.withColumns({"g": F.least("block", "other"), "h": F.greatest("block", "other")}).join(nodes.select("node", "copies", "unit", "keys"), "node")
    group = BUCKET + ["g", "h"]
    meet = meet.select(*group, "node", "block", "copies", "unit", "keys").repartition(partitions(vectors.sparkSession), *group).sortWithinPartitions(*group)
    found = stored(meet.mapInArrow(_compare, "node long, links long, root long"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(found.filter("node <> root"), "node", "root")
    whole = counts.join(links, "node", "left").join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = whole.groupBy("root").agg(F.min("first").alias("component_id"))
    known = whole.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(known, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
