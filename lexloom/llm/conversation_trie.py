"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours.

Every conversation is a string of turn keys (128 bits of SHA-256 of role and text) with the code points of each text;
texts themselves are never shuffled. Equal strings are one row with their number, smallest conv_id and end. Strings are
sorted over range partitions. In a partition the edges between sorted neighbours, weighed with the length of their common
prefix, are taken in descending depth: each merges two components of a union-find, and a merge makes a branching node at
that depth (or adds a child to one that is there). A component that becomes a child gives its nodes, those of the
unbranched way up included. What may reach beyond the partition stays open: along its left and right edge at most two
components a depth, with everything complete contracted into them. The open components of all partitions, a few a
partition, are merged the same way, and nodes whose parent lies in another partition get it by a join.

Strings hold at most BLOCK_TURNS turns. A longer conversation goes on in the next level, in the group of those with the
same turns before (two 64-bit hashes of all of them), and each level hands the totals of its groups to the level above. So no
row holds a conversation of unbounded length; levels are as many as the longest conversation has blocks.

Null roles and texts are empty. Turns of a conversation are in the order of turn, null first, ties by their keys. Rows
without a conv_id belong to no conversation. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import freed, partitions, stored

BLOCK_TURNS = 1024
TURNS_A_TASK = 400_000
IDS_A_PIECE = 4096
SHARED, OF = 6, 100

_OUT = (
    "kind string, p1 long, p2 long, pid int, ord int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "e1 long, e2 long, ref string, edge int, lens array<long>, first array<string>, last array<string>"
)
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_TYPES = dict(zip(_NAMES, [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 9, pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())], strict=True))
_SCHEMA = pa.schema([(n, _TYPES[n]) for n in _NAMES])


def turn_key(role: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)


def shared_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("long")


def keyed(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, key, len): the turns of each conversation, numbered from 0."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_key(role, text).alias("key"), F.length(text).cast("long").alias("len"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return turns.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("k"), "key", "len")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, key, len) of the rebuilt conversations, and (conv_id, total) of each, turnless ones included.

    The first turns, as many as a checksum of the id says, come from the conversation that is the next lower multiple of OF.
    """
    c = F.col("conv_id")
    convs = turns.groupBy("conv_id").agg((F.max("k") + 1).alias("own")).withColumns({"h": shared_turns(c), "source": c - c % OF})
    sources = convs.filter(c % OF == 0).select(c.alias("source"), F.col("own").alias("there"))
    convs = stored(convs.join(sources, "source", "left").select("conv_id", "source", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("take"), "own"), "conversations")
    first = turns.filter((c % OF == 0) & (F.col("k") < SHARED)).select(c.alias("source"), "k", "key", "len")
    given = convs.filter("take > 0").select("conv_id", "source", "take").join(first, "source").filter("k < take").select("conv_id", F.col("k").alias("pos"), "key", "len")
    after = turns.filter(F.col("k") >= shared_turns(c)).join(convs.select("conv_id", "h", "take"), "conv_id")
    rows = given.unionAll(after.select("conv_id", (F.col("take") + F.col("k") - F.col("h")).alias("pos"), "key", "len"))
    return rows, convs.select("conv_id", (F.col("take") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total"))


def blocks(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Blocks of at most BLOCK_TURNS turns: (conv_id, block, last, p1, p2, f1, f2, keys, lens).

    p: hash of the turns before, f: of these included. The last block of a conversation is shorter than the others, maybe empty.
    """
    turn = F.struct((F.col("pos") % BLOCK_TURNS).alias("off"), "key", "len")
    each = rows.select("conv_id", F.expr(f"pos div {BLOCK_TURNS}").alias("block"), turn.alias("turn"), F.lit(False).alias("last"))
    ends = totals.select("conv_id", F.expr(f"total div {BLOCK_TURNS}").alias("block"), F.lit(None).cast(each.schema["turn"].dataType).alias("turn"), F.lit(True).alias("last"))
    made = each.unionAll(ends).groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.max("last").alias("last"))
    made = made.select("conv_id", "block", "last", F.col("turns.key").alias("keys"), F.col("turns.len").alias("lens"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    for i in (1, 2):
        made = made.withColumn(f"h{i}", F.xxhash64("block", "keys", F.lit(i))).withColumn(f"p{i}", F.coalesce(F.bit_xor(f"h{i}").over(before), F.lit(0).cast("long")))
    made = made.withColumns({f"f{i}": F.col(f"p{i}").bitwiseXOR(F.col(f"h{i}")) for i in (1, 2)})
    return made.drop("h1", "h2")


class _Node:
    """A component's top node: depth, totals of what is below it, and the rows that wait for its conv_id."""

    __slots__ = ("below", "depth", "end", "kids", "leaves", "lens", "least", "left", "n", "right", "waiting")

    def __init__(self, depth: int, lens: list[int]):
        self.depth, self.lens, self.n, self.least, self.leaves, self.below, self.kids = depth, lens, 0, None, 0, 0, 0
        self.end, self.waiting, self.left, self.right = (None, None), [], -1, -1


class _Rows:
    """Result columns; a row's parent may be set later."""

    def __init__(self) -> None:
        self.columns: dict[str, list] = {n: [] for n in _NAMES}

    def add(self, **row) -> int:
        for name, column in self.columns.items():
            column.append(row.get(name))
        return len(self.columns["kind"]) - 1

    def batches(self) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(self.columns["kind"]), 20_000):
            yield pa.record_batch([pa.array(self.columns[n][k : k + 20_000], _TYPES[n]) for n in _NAMES], schema=_SCHEMA)


def _attach(child: _Node, parent: _Node, out: _Rows) -> None:
    """The nodes from the child's top up to just below the parent become rows; the last one waits for the parent."""
    leaves, saved, row = child.leaves if child.kids else 1, child.below, None
    for w in child.waiting:
        out.columns["parent_conv_id"][w] = child.least
    for depth in range(child.depth, parent.depth, -1):
        saved += (child.n - 1) * child.lens[depth - 1]
        top = depth == child.depth
        row = out.add(kind="node", conv_id=child.least, depth=depth, parent_conv_id=child.least, n_convs=child.n, n_children=child.kids if top else 1, n_leaves=leaves, saved_tokens=saved, e1=child.end[0] if top else None, e2=child.end[1] if top else None)
    parent.n += child.n
    parent.least = child.least if parent.least is None else min(parent.least, child.least)
    parent.leaves, parent.below, parent.kids = parent.leaves + leaves, parent.below + saved, parent.kids + 1
    parent.waiting.append(row)


def _merged(a: _Node, b: _Node, depth: int, out: _Rows) -> _Node:
    """The component of two neighbours whose common prefix has this depth: a branching node there."""
    if a.depth == b.depth == depth:
        a.n, a.least, a.leaves, a.below, a.kids = a.n + b.n, min(a.least, b.least), a.leaves + b.leaves, a.below + b.below, a.kids + b.kids
        a.end, node = a.end if a.end[0] is not None else b.end, a
        a.waiting += b.waiting
    else:
        node = a if a.depth == depth else b if b.depth == depth else _Node(depth, a.lens)
        for child in (a, b):
            if child is not node:
                _attach(child, node, out)
    node.left, node.right = max(a.left, b.left), max(a.right, b.right)
    return node


def _forest(nodes: list[_Node], edges: list[int], out: _Rows) -> tuple[list[_Node], list[int]]:
    """Merge neighbours in descending depth. Left over: components that may reach beyond either end, and the edges between them."""
    root, up, kept = list(range(len(nodes))), list(range(len(nodes))), []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for k in sorted(range(len(edges)), key=lambda k: -edges[k]):
        i, j, depth = find(k), find(k + 1), edges[k]
        a, b = nodes[root[i]], nodes[root[j]]
        if depth <= a.left or depth <= b.right:  # the node at this depth isn't whole here, nor is any above it
            b.left = max(b.left, depth) if depth <= a.left else b.left
            a.right = max(a.right, depth) if depth <= b.right else a.right
            kept.append(k)
        else:
            nodes[root[i]] = _merged(a, b, depth, out)
            up[j] = i
    kept.sort()
    return [nodes[root[find(k)]] for k in ([0] + [k + 1 for k in kept])], [edges[k] for k in kept]


def _contracted(nodes: list[_Node], edges: list[int], out: _Rows) -> tuple[list[_Node], list[int]]:
    """Neighbours that hang on one node of the same depth are gathered into a part of that node."""
    some, between, inner = nodes[:1], [], False
    for k in range(1, len(nodes)):
        depth = edges[k - 1]
        here = k < len(edges) and edges[k] == depth
        if here and inner and some[-1].depth == depth:
            some[-1] = _merged(some[-1], nodes[k], depth, out)
            continue
        node = nodes[k]
        if here and node.depth > depth:
            node = _Node(depth, nodes[k].lens)
            _attach(nodes[k], node, out)
        some.append(node)
        between.append(depth)
        inner = here
    return some, between


def _rooted(node: _Node, group: tuple[int, int], out: _Rows) -> None:
    """The last component of a group hangs on the group's root, whose totals go to the level above."""
    root = node
    if node.depth:
        root = _Node(0, [])
        _attach(node, root, out)
    for w in root.waiting:
        out.columns["parent_conv_id"][w] = root.least
    out.add(kind="root", p1=group[0], p2=group[1], conv_id=root.least, depth=0, n_convs=root.n, n_children=root.kids, n_leaves=root.leaves if root.kids else 1, saved_tokens=root.below, e1=root.end[0], e2=root.end[1])


def common_prefix(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a partition of sorted strings."""
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not tables:
        return
    rows, pid, out = pa.concat_tables(tables).to_pydict(), TaskContext.get().partitionId(), _Rows()
    marks = list(zip(rows["p1"], rows["p2"], strict=True))
    cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        nodes, keys = [], rows["keys"][x:y]
        for i in range(x, y):
            node = _Node(len(rows["keys"][i]), rows["lens"][i])
            node.n, node.least, node.end = rows["n"][i], rows["conv_id"][i], (rows["e1"][i], rows["e2"][i])
            node.kids, node.leaves, node.below = rows["kids"][i], rows["leaves"][i], rows["saved"][i]
            nodes.append(node)
        if x == 0:
            nodes[0].left = BLOCK_TURNS
        if y == len(marks):
            nodes[-1].right = BLOCK_TURNS
        nodes, edges = _forest(nodes, [common_prefix(a, b) for a, b in zip(keys[:-1], keys[1:], strict=True)], out)
        if 0 < x and y < len(marks):
            _rooted(nodes[0], marks[x], out)
            continue
        nodes, edges = _contracted(nodes, edges, out)
        for k, node in enumerate(nodes):
            ref = f"{pid}.{x}.{k}"
            for w in node.waiting:
                out.columns["parent_conv_id"][w], out.columns["ref"][w] = None, ref
            out.add(
                kind="open", p1=marks[x][0], p2=marks[x][1], pid=pid, ord=k, conv_id=node.least, depth=node.depth, n_convs=node.n, n_children=node.kids, n_leaves=node.leaves, saved_tokens=node.below, e1=node.end[0], e2=node.end[1],
                ref=ref, edge=edges[k] if k < len(edges) else None, lens=node.lens[: node.depth], first=keys[0] if k == 0 else None, last=keys[-1] if k == len(edges) else None,
            )
    yield from out.batches()


def _of_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open components of all partitions of a group, in order: the same merges, across the partitions' borders."""
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not tables:
        return
    rows, out, waits = pa.concat_tables(tables).to_pydict(), _Rows(), []
    marks = list(zip(rows["p1"], rows["p2"], strict=True))
    cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        nodes, edges = [], []
        for i in range(x, y):
            node = _Node(rows["depth"][i], rows["lens"][i])
            node.n, node.least, node.end = rows["n_convs"][i], rows["conv_id"][i], (rows["e1"][i], rows["e2"][i])
            node.kids, node.leaves, node.below = rows["n_children"][i], rows["n_leaves"][i], rows["saved_tokens"][i]
            node.waiting = [out.add(kind="ref", ref=rows["ref"][i])]
            nodes.append(node)
            if i + 1 < y:
                edges.append(rows["edge"][i] if rows["edge"][i] is not None else common_prefix(rows["last"][i], rows["first"][i + 1]))
        _rooted(_forest(nodes, edges, out)[0][0], marks[x], out)
    yield from out.batches()


def level(strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes below the roots of all groups, and the groups' roots, of distinct strings (p1, p2, keys, lens, n, conv_id, e1, e2, kids, leaves, saved)."""
    strings = stored(strings, "strings")
    turns = strings.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
    order = ("p1", "p2", "keys")
    dealt = strings.repartitionByRange(max(partitions(strings.sparkSession), turns // TURNS_A_TASK), *order).sortWithinPartitions(*order)
    local = stored(dealt.mapInArrow(freed(_of_partition), _OUT), "forests")
    rest = local.filter("kind = 'open'").repartition("p1", "p2").sortWithinPartitions("p1", "p2", "pid", "ord").mapInArrow(freed(_of_rest), _OUT)
    rest = stored(rest, "merged")
    parents = rest.filter("kind = 'ref'").select("ref", F.col("parent_conv_id").alias("found"))
    nodes = local.filter("kind = 'node'").join(parents, "ref", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "found"))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "e1", "e2")
    roots = local.filter("kind = 'root'").unionAll(rest.filter("kind = 'root'"))
    return nodes.select(*columns).unionAll(rest.filter("kind = 'node'").select(*columns)), roots.select("p1", "p2", *columns)


def ends(ending: DataFrame) -> DataFrame:
    """(e1, e2, ends_sha256) of (e1, e2, conv_id): SHA-256 of the ids, ascending, comma-joined.

    Ids are joined within ranges of IDS_A_PIECE of them first; a group's pieces then go through one running hash.
    """
    pieces = ending.groupBy("e1", "e2", F.floor(F.col("conv_id") / IDS_A_PIECE).alias("range")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, done = None, None, []
        for batch in batches:
            for e1, e2, ids in zip(*(batch.column(c).to_pylist() for c in ("e1", "e2", "ids")), strict=True):
                if now == (e1, e2):
                    sums.update(b",")
                else:
                    done += [(*now, sums.hexdigest())] if now else []
                    now, sums = (e1, e2), hashlib.sha256()
                sums.update(ids.encode())
            if done:
                yield pa.record_batch([list(x) for x in zip(*done, strict=True)], names=["e1", "e2", "ends_sha256"])
                done = []
        if now:
            yield pa.record_batch([[now[0]], [now[1]], [sums.hexdigest()]], names=["e1", "e2", "ends_sha256"])

    return pieces.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "range").mapInArrow(run, "e1 long, e2 long, ends_sha256 string")


def trie(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of conversations given as (conv_id, pos, key, len) and (conv_id, total)."""
    cut = stored(blocks(rows, totals), "blocks")
    nodes, roots = None, None
    for b in range(cut.agg(F.max("block")).first()[0] or 0, -1, -1):
        end = lambda i: F.when(F.max("last"), F.first(f"f{i}")).alias(f"e{i}")
        strings = cut.filter(F.col("block") == b).groupBy("p1", "p2", "keys").agg(F.first("lens").alias("lens"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), end(1), end(2), F.first("f1").alias("f1"), F.first("f2").alias("f2"))
        none = F.lit(0).cast("long")
        if roots is None:
            strings = strings.withColumns({"kids": none, "leaves": none, "saved": none})
        else:
            below = roots.select(F.col("p1").alias("f1"), F.col("p2").alias("f2"), F.col("n_children").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.col("e1").alias("d1"), F.col("e2").alias("d2"), F.lit(True).alias("more"))
            full = F.size("keys") == BLOCK_TURNS
            strings = strings.join(below.withColumn("full", F.lit(True)), (strings.f1 == below.f1) & (strings.f2 == below.f2) & full, "left").select(
                "p1", "p2", "keys", "lens", "n", "conv_id", F.coalesce("e1", "d1").alias("e1"), F.coalesce("e2", "d2").alias("e2"), *(F.coalesce(c, none).alias(c) for c in ("kids", "leaves", "saved"))
            )
        found, roots = level(strings.select("p1", "p2", "keys", "lens", "n", "conv_id", "e1", "e2", "kids", "leaves", "saved"))
        found = found.withColumn("depth", F.col("depth") + b * BLOCK_TURNS)
        nodes = found if nodes is None else nodes.unionAll(found)
    nodes = nodes.unionAll(roots.select(nodes.columns))
    sums = ends(cut.filter("last").select(F.col("f1").alias("e1"), F.col("f2").alias("e2"), "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(sums, ["e1", "e2"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations, one row a node; see the module for the rules."""
    return trie(*rebuilt(stored(keyed(conversations), "turns")))
