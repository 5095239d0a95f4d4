"""Greedy choice of edges under a cap on degrees, in rounds that give what going through all edges in order would.

An edge is taken if both its ends have room when its turn comes. Its turn can come early: an edge that precedes every open edge
at both of its ends depends on nothing else, and an edge with a full end is out whatever happens before it. Each round, blocks of
nodes decide all that follows from their own edges; an edge between two blocks is taken once both say that nothing precedes
it. Every other round the blocks begin half a block further, so that what is open about a border lies inside of one. The first
open edge of all is decided in every round, so rounds end; where a group fits a block, there is one, and a flight in lines
takes about two for each block (four rounds for 1,200 frames in blocks of 600, eight in blocks of 300).

A task goes through all blocks that it was dealt in one stream of rows, sorted by block and order, so many small groups cost no more
than a few large ones. What one block alone has to decide isn't shuffled again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.checkpoints import cut

#: Nodes of a block, by place in the group.
BLOCK = 4096
NO, YES, OPEN, READY = range(4)


def _walk(cap: int, pu: list[int], pv: list[int], degree: list[int], here: np.ndarray) -> np.ndarray:
    """The states of edges in order; pu and pv are rows of degree, which goes up with what is taken; here: whether the row's node is in
    the block (others are the last row)."""
    waits, state = bytearray(len(here)), []
    for a, b in zip(pu, pv, strict=True):
        if degree[a] >= cap or degree[b] >= cap:
            state.append(NO)
        elif waits[a] or waits[b]:
            state.append(OPEN)
            waits[a] = waits[b] = 1
            waits[-1] = 0
        elif here[a] and here[b]:
            state.append(YES)
            degree[a] += 1
            degree[b] += 1
        else:
            state.append(READY)
            waits[a] = waits[b] = 1
            waits[-1] = 0
    return np.array(state, np.int32)


def _decide(cap: int, schema: pa.Schema):
    """Of rows sorted by g, block, edge (nodes first) and key: edges with their states, nodes with their degrees."""
    at = {name: i for i, name in enumerate(schema.names)}

    def groups(t: pa.Table) -> np.ndarray:
        """The first row of each block."""
        g = t.column(at["g"]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        block = t.column(at["block"]).to_numpy()
        return np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (block[1:] != block[:-1])])

    def out(t: pa.Table, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, t.num_rows]))
        is_edge = t.column(at["edge"]).to_numpy(zero_copy_only=False).astype(bool)
        pu, pv, degree, state = (t.column(at[c]).fill_null(0).to_numpy().copy() for c in ("pu", "pv", "degree", "state"))
        nodes, edges = np.flatnonzero(~is_edge), np.flatnonzero(is_edge)
        nodes = nodes[np.lexsort((pu[nodes], group[nodes]))]
        low, size = int(min(pu.min(), pv.min())), int(max(pu.max(), pv.max())) + 1
        name = lambda rows, p: group[rows] * (size - low) + p[rows] - low
        known = name(nodes, pu)

        def rows_of(p: np.ndarray) -> list[int]:
            spot = np.minimum(np.searchsorted(known, name(edges, p)), max(len(nodes) - 1, 0))
            return np.where(known[spot] == name(edges, p), spot, len(nodes)).tolist() if len(nodes) else [0] * len(edges)

        degrees = [*degree[nodes].tolist(), -1]  # a node of another block has room and waits for nothing, as far as this one knows
        state[edges] = _walk(cap, rows_of(pu), rows_of(pv), degrees, np.r_[np.ones(len(nodes), bool), False])
        degree[nodes] = degrees[:-1]
        fresh = {"state": pa.array(state, mask=~is_edge), "degree": pa.array(degree, mask=is_edge)}
        for name_, column in fresh.items():
            t = t.set_column(at[name_], schema.field(name_), column)
        yield from t.cast(schema).to_batches()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            edge = groups(t)
            if len(edge) > 1:
                yield from out(t.slice(0, edge[-1]), edge[:-1])
                held = t.slice(edge[-1]).to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield from out(t, groups(t))

    return emit


def capped(edges: DataFrame, nodes: DataFrame, cap: int, block: int | None = None) -> DataFrame:
    """The edges (g, u, v, key, pu, pv, and whatever else they have) that are taken in order of key, unique in its group; pu and pv are
    the places of the ends. Places are returned no more.

    nodes (g, u, pu, degree) has every end, with the degree that it has before.
    """
    block = block or BLOCK
    more = [c for c in edges.columns if c not in ("g", "u", "v", "key", "pu", "pv")]
    own, kept = ["g", "u", "v", "key", "pu", "pv", *more], ["g", "u", "v", *more]
    long = lambda c: F.col(c).cast("long").alias(c)
    left = edges.select("g", "u", "v", long("key"), long("pu"), long("pv"), *more)
    state = nodes.select("g", "u", long("pu"), long("degree"))
    blank = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields}
    taken, shift = [], 0
    while True:
        at = lambda p, shift=shift: F.expr(f"({p} + {shift}) div {block}")
        sides, shift = F.array_distinct(F.array(at("pu"), at("pv"))), block // 2 - shift
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        points = state.select(at("pu").alias("block"), F.lit(False).alias("edge"), F.lit(1).alias("sides"), none("int", "state"), "degree", *(c if c in ("g", "u", "pu") else blank[c] for c in own))
        dealt = left.withColumn("at", sides).select(F.explode("at").alias("block"), F.lit(True).alias("edge"), F.size("at").alias("sides"), none("int", "state"), none("long", "degree"), *own)
        rows = points.unionByName(dealt).repartition("g", "block").sortWithinPartitions("g", "block", "edge", "key")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        told = cut(rows.mapInArrow(_decide(cap, to_arrow_schema(rows.schema)), kinds))
        alone, two = told.filter("edge AND sides = 1"), told.filter("edge AND sides = 2")
        taken.append(alone.filter(F.col("state") == YES).select(*kept))
        waiting = F.col("edge") & (F.col("sides") == 1) & (F.col("state") == OPEN)
        count = told.agg(F.count_if(waiting).alias("open"), F.count_if(F.col("edge") & (F.col("sides") == 2)).alias("two")).first()
        left, state = alone.filter(F.col("state") == OPEN).select(*own), told.filter("NOT edge").select("g", "u", "pu", "degree")
        if count.two:
            says = lambda s: F.count_if(F.col("state") == s)
            one = F.when(says(NO) > 0, NO).when(says(READY) == 2, YES).otherwise(OPEN)
            verdicts = cut(two.groupBy(*own).agg(one.alias("state")))
            across = verdicts.filter(F.col("state") == YES)
            taken.append(across.select(*kept))
            left = left.unionByName(verdicts.filter(F.col("state") == OPEN).select(*own))
            gone = across.select(F.col("g").alias("h"), F.explode(F.array("u", "v")).alias("n")).groupBy("h", "n").agg(F.count(F.lit(1)).alias("more"))
            state = state.join(gone, F.col("g").eqNullSafe(F.col("h")) & (F.col("u") == F.col("n")), "left")
            state = state.select("g", "u", "pu", (F.col("degree") + F.coalesce("more", F.lit(0))).alias("degree"))
        elif not count.open:
            break
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out
