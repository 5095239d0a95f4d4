"""Merkle manifest of a dataset, with a proof for every row, by scheduled traversal of blocks.

A leaf digests one row; leaves of a source stand in order of id, and every FANOUT nodes have their digest as parent until one is
left, the subroot. Subroots, by source, are the leaves of the tree above, whose top is the root.

1. Rows are digested where they lie; what moves is digests. A range partitioning by (source, id) and the counts of its
   partitions give each leaf its place, so a source with any share of the rows covers many partitions.
2. Leaves are dealt in aligned blocks of FANOUT ** LEVELS. A treehash folds each block to its root; block roots are the leaves of
   the next round, so rounds grow with the logarithm of the rows, to the base of the block's size.
3. From the top down each block is walked leaf by leaf. Authentication paths advance by treehash stacks: beside the current run
   of each level one stack builds the next run and takes one leaf a step, so it is ready when the current run ends. A block
   needs (FANOUT + the stack) nodes a level. The path above the block is the same for its leaves and is appended.

Digests are lowercase hex SHA-256 of concatenated inputs, digests among them as hex text. Nulls are digested as "-", other
values behind their length, so null and empty differ. A null source is a source of its own, first in order. Rows without id come
first in their source, rows alike in id in order of their leaf; equal rows have equal leaves and may stand for one another,
each with the proof of its own place. Rows without id are never taken for tampered. An empty table has an empty manifest. Other
columns may have any names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FANOUT = 16
#: Levels of a block.
LEVELS = 3
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class Treehash:
    """The nodes of one level over leaves that come one by one; each level below holds one run at most."""

    def __init__(self, level: int):
        self.stack: list[list[bytes]] = [[] for _ in range(level)]
        self.nodes: list[bytes] = []

    def add(self, node: bytes, at: int = 0) -> None:
        while at < len(self.stack):
            self.stack[at].append(node)
            if len(self.stack[at]) < FANOUT:
                return
            node, self.stack[at] = digest(*self.stack[at]), []
            at += 1
        self.nodes.append(node)

    def close(self) -> list[bytes]:
        """The nodes, once the runs that aren't full have been folded."""
        for at, run in enumerate(self.stack):
            if run:
                self.stack[at] = []
                self.add(digest(*run), at + 1)
        return self.nodes


def height(n: int) -> int:
    """The levels above n leaves."""
    top = 0
    while FANOUT**top < n:
        top += 1
    return top


def fold(leaves: list[bytes], top: int) -> bytes:
    tree = Treehash(top)
    for leaf in leaves:
        tree.add(leaf)
    return tree.close()[0]


def traverse(leaves: list[bytes], top: int):
    """For each leaf its path below the block's root: for each level the nodes of its run before and after its ancestor."""
    spans = [FANOUT ** (h + 1) for h in range(top)]
    now: list[list[bytes]] = []
    for h, span in enumerate(spans):
        first = Treehash(h)
        for leaf in leaves[:span]:
            first.add(leaf)
        now.append(first.close())
    coming = [Treehash(h) for h in range(top)]
    for i in range(len(leaves)):
        path = []
        for h, run in enumerate(now):
            at = i // FANOUT**h % FANOUT
            path.append((b"".join(run[:at]), b"".join(run[at + 1 :])))
        yield path
        for h, span in enumerate(spans):
            if i + span < len(leaves):
                coming[h].add(leaves[i + span])
            if (i + 1) % span == 0:
                now[h], coming[h] = coming[h].close(), Treehash(h)


def climb(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for before, after in path:
        node = digest(before, node, after)
    return node


def _value(column: F.Column) -> F.Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[F.Column]) -> F.Column:
    return F.sha2(F.concat(*map(_value, columns)), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows plus idx, the place in the group by order, and n, the group's size. Pass a checkpointed frame."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = cut(rows.repartitionByRange(n, group, *order).withColumn("pid", F.spark_partition_id()))
    counts = dealt.groupBy("pid", group).agg(F.count(F.lit(1)).alias("own"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("pid", group, F.coalesce(F.sum("own").over(before), F.lit(0)).alias("start"), F.sum("own").over(whole).alias("n"))
    place = F.row_number().over(Window.partitionBy("pid", group).orderBy(*order)) - 1
    return dealt.withColumn("place", place).join(starts, ["pid", group]).withColumn("idx", F.col("start") + F.col("place")).drop("pid", "place", "start")


def _root(key: tuple, block: pa.Table) -> pa.Table:
    block = block.sort_by("idx")
    n, size = block.column("n")[0].as_py(), FANOUT**LEVELS
    top = fold([x.encode() for x in block.column("node").to_pylist()], height(n) if n <= size else LEVELS)
    return pa.table({"g": pa.array([key[0].as_py()], pa.string()), "idx": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // size)], pa.int64()), "node": pa.array([top.decode()], pa.string())})


def rounds(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes (g, b, idx, n, node) of each round, and (g, node) of the tops, of leaves alike."""
    levels, tops = [leaves], []
    while True:
        roots = cut(levels[-1].select("g", "b", "idx", "n", "node").groupBy("g", "b").applyInArrow(_root, "g string, idx long, n long, node string"))
        tops.append(roots.filter("n = 1").select("g", "node"))
        above = roots.filter("n > 1").withColumn("b", _block())
        if above.isEmpty():
            return levels, reduce(DataFrame.unionByName, tops)
        levels.append(above)


def _block() -> F.Column:
    return F.expr(f"idx div {FANOUT**LEVELS}")


def _paths_of(block: pa.Table, upper: pa.Table) -> tuple[pa.Table, list, list]:
    block = block.sort_by("idx")
    n = block.column("n")[0].as_py()
    nodes = [x.encode() for x in block.column("node").to_pylist()]
    above = [(p["before"].encode(), p["after"].encode()) for p in upper.column("path")[0].as_py()]
    return block, traverse(nodes, height(n) if n <= FANOUT**LEVELS else LEVELS), above


def _walk(block: pa.Table, upper: pa.Table) -> pa.Table:
    block, found, above = _paths_of(block, upper)
    text = [[{"before": x.decode(), "after": y.decode()} for x, y in [*path, *above]] for path in found]
    return pa.table({"g": block.column("g"), "idx": block.column("idx"), "node": block.column("node"), "path": pa.array(text, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))})


def _prove(root: str):
    def of(block: pa.Table, upper: pa.Table) -> pa.Table:
        block, found, above = _paths_of(block, upper)
        shared = b"".join(x + y for x, y in above)
        proofs, folded, known = [], [], {}
        nodes, others = block.column("node").to_pylist(), block.column("other").to_pylist()
        for leaf, other, path in zip(nodes, others, found, strict=True):
            proofs.append(digest(*(x + y for x, y in path), shared).decode())
            top = climb((other or leaf).encode(), path)
            if top not in known:
                known = {top: climb(top, above).decode()}
            folded.append(known[top])
        n = len(nodes)
        return pa.table({"doc_id": block.column("doc_id"), "leaf": block.column("node"), "subroot": pa.array([upper.column("subroot")[0].as_py()] * n, pa.string()), "root": pa.array([root] * n, pa.string()), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == root for x in folded], pa.bool_())})

    return of


def _below(level: DataFrame, tops: DataFrame, above: DataFrame | None) -> DataFrame:
    """The path above each block (g, b, path, subroot) of a level: its top's where the block is the group's only one,
    else the one that the level above gave to the block's root."""
    single = level.filter(f"n <= {FANOUT**LEVELS} AND idx = 0").select("g").join(tops, "g").select("g", F.lit(0).cast("long").alias("b"), "path", "subroot")
    if above is not None:
        single = single.unionByName(above.join(tops.select("g", "subroot"), "g").select("g", F.col("idx").alias("b"), "path", "subroot"))
    return single.toDF(*single.columns)  # columns of its own, as the level meets it by name


def _descend(levels: list[DataFrame], tops: DataFrame, last: int) -> DataFrame | None:
    """(g, idx, node, path) of the nodes of level `last`, walking down from the topmost; None above that."""
    above = None
    for k in range(len(levels) - 1, last - 1, -1):
        upper = _below(levels[k], tops, above)
        above = cut(levels[k].groupBy("g", "b").cogroup(upper.groupBy("g", "b")).applyInArrow(_walk, f"g string, idx long, node string, path {PATH}"))
    return above


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", tampered: F.Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; where `tampered` is true, the proof is tried
    with the leaf of a row whose text has a-z for A-Z."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = F.when(F.lit(False) if tampered is None else tampered, leaf_digest([lower if c == text_col else F.col(c) for c in columns]))
    group = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))  # "-" is less than "="
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), group.alias("g"), leaf_digest([F.col(c) for c in columns]).alias("node"), other.alias("other"), F.monotonically_increasing_id().alias("row")))
    leaves = cut(ranked(rows, "g", ["doc_id", "node", "row"]).drop("row").withColumn("b", _block()))
    levels, subroots = rounds(leaves)
    sources = ranked(cut(subroots.select(F.lit("").alias("all"), F.col("g").alias("source"), "node")), "all", ["source"])
    sources = cut(sources.select(F.col("all").alias("g"), "source", "idx", "n", "node").withColumn("b", _block()))
    over, root = rounds(sources.drop("source"))
    root = root.first()
    kind = docs.schema[id_col].dataType.simpleString()
    proved = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if root is None:
        return docs.sparkSession.createDataFrame([], proved)
    top = docs.sparkSession.range(1).select(F.lit("").alias("g"), F.lit(None).cast("string").alias("subroot"), F.expr(f"cast(array() AS {PATH})").alias("path"))
    placed = _descend(over, top, 0).select("idx", "node", "path").join(sources.select("source", "idx"), "idx")
    tops = cut(placed.select(F.col("source").alias("g"), "path", F.col("node").alias("subroot")))
    upper = _below(levels[0], tops, _descend(levels, tops, 1))
    return leaves.groupBy("g", "b").cogroup(upper.groupBy("g", "b")).applyInArrow(_prove(root.node), proved)
