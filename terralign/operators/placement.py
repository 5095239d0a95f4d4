"""Placement of frames along the graph of matches, for many surveys at once.

Levels say how many matches a frame is from its survey's reference. A frame's parent is one level nearer, by the match that comes
first; parents make a spanning forest. The matrices along it are composed by pointer jumping: every frame holds the product
down from an ancestor, and takes over its ancestor's product and ancestor, so each round doubles the way. Matrix products are
associative, and rounds grow with the logarithm of the depth. Frames that no match leads to are placed by their position.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import affine
from ..sources.checkpoints import Scratch, cut

RADIUS = 6_371_000.0


#: Rows that are broadcast at most, as they were counted; more are shuffled.
FEW = 1 << 19


def _hinted(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df.hint("shuffle_hash")


def _same(left: list[str], right: list[str]) -> Column:
    """Equality that isn't taken for a key of the join, so the one number that is can be looked up as such."""
    return reduce(Column.__and__, ((F.col(x) >= F.col(y)) & (F.col(x) <= F.col(y)) for x, y in zip(left, right, strict=True)))


def _regular(m: Column) -> Column:
    return F.abs(affine.determinant(m)) > 1e-12


def reached(edges: DataFrame, start: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(g, node, level, parent, number): how many edges (g, a, b, number) each node is from the start nodes (g, node) of its group,
    and its first edge (least number, then parent) from a node one level nearer, by joins repeated until no node is new.

    With `known` (g, node), others aren't passed through and have no row. Edges are searched for known nodes only where a first
    search came upon others: if all that it reached are known, no other edge mattered.
    """
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = edges.select("g", F.inline(F.array(way("a", "b"), way("b", "a"))), "number")
    alike = lambda df: df.select(F.col("g").cast(both.schema["g"].dataType).alias("g"), F.col("node").cast(both.schema["a"].dataType).alias("node"))
    seen = _rounds(both, alike(start))
    if known is None:
        return seen
    rows, known = seen.count(), alike(known)
    if known.join(_hinted(seen.select("g", "node"), rows), ["g", "node"], "left_semi").distinct().count() == rows:
        return seen
    seen = _rounds(both.join(known.withColumnRenamed("node", "a"), ["g", "a"], "left_semi"), alike(start))
    return cut(seen.join(known, ["g", "node"], "left_semi"))


def _rounds(both: DataFrame, start: DataFrame) -> DataFrame:
    """What `reached` finds over edges (g, a, b, number) that are there both ways, from distinct or repeated start nodes.

    As edges go both ways, what a level leads to is in it, in the one before it, or new. They are laid out once by a hash of the
    node that they start from, and a round only moves the level that it starts from: it reads the edges where they lie. The hash is
    the join's only key, which a scan looks up several times as fast as columns; these are compared where it agrees.
    """
    n = max(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    both = both.withColumn("h", F.xxhash64("g", "a")).repartition(n, "h").persist(StorageLevel.MEMORY_AND_DISK_DESER)
    scratch = Scratch(both.sparkSession)
    blank = {"level": F.lit(0), "parent": F.lit(None).cast(both.schema["a"].dataType), "number": F.lit(None).cast(both.schema["number"].dataType)}
    edge = scratch.keep(start.distinct().withColumns(blank))
    seen, before, rows, level = [edge], edge.limit(0), 0, 0
    while new := edge.count():
        rows, level = rows + new, level + 1
        near = before.unionByName(edge).select(F.xxhash64("g", "node").alias("k"), F.col("g").alias("own"), F.col("node").alias("at"), "level")
        near = _hinted(near, rows)
        met = both.join(near, F.col("h") == F.col("k")).filter((F.col("level") == level - 1) & _same(["g", "a"], ["own", "at"]))
        met = met.select(F.xxhash64("g", "b").alias("h"), "g", F.col("b").alias("node"), "a", "number")
        if rows > FEW:
            met = met.repartition(n, "h")
        met = met.join(near, (F.col("h") == F.col("k")) & _same(["g", "node"], ["own", "at"]), "left_anti")
        best = met.groupBy("h", "g", "node").agg(F.min(F.struct("number", "a")).alias("best"))
        rows, before, edge = new, edge, scratch.keep(best.select("g", "node", F.lit(level).alias("level"), F.col("best.a").alias("parent"), "best.number"))
        seen.append(edge)
        if len(seen) == 32:  # a long way's many small tables are read as one
            seen = [scratch.keep(reduce(DataFrame.unionByName, seen).coalesce(n))]
    seen = cut(reduce(DataFrame.unionByName, seen).coalesce(n))
    both.unpersist()
    scratch.close()
    return seen


def levels(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(g, node, level): how many edges (g, a, b) each node is from the start nodes (g, node) of its group."""
    return reached(edges.withColumn("number", F.lit(0)), start).select("g", "node", "level")


def forest(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(g, node, parent, m) of each node but the starts, by the edges that `reached` found.

    edges have g, a, b, number and m, which takes a's coordinates to b's; m leads from a node's own to its parent's coordinates.
    Singular matrices are left aside; that is looked at in the edges found only.
    """
    code = lambda a, b: [F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), F.xxhash64("g", "number", F.least(a, b), F.greatest(a, b)).alias("k")]
    way = found.filter("parent IS NOT NULL").select(F.col("g").alias("own"), F.col("number").alias("same"), "node", "parent", *code("node", "parent"))
    way = _hinted(way.withColumnsRenamed({"low": "least", "high": "most", "k": "key"}), found.count())
    met = edges.select("g", "number", "a", "m", *code("a", "b")).join(way, (F.col("k") == F.col("key")) & _same(["g", "number", "low", "high"], ["own", "same", "least", "most"]))
    up = F.when(F.col("a") == F.col("node"), F.col("m")).otherwise(affine.inverse(F.col("m")))
    one = F.min(F.when(_regular(F.col("m")), F.struct("parent", up.alias("up")))).alias("one")
    return met.groupBy("g", "node").agg(one).select("g", "node", "one.parent", F.col("one.up").alias("m"))


def composed(tree: DataFrame, start: DataFrame) -> DataFrame:
    """(g, node, m): the product of the matrices from each node up to its start."""
    one = affine.matrix(*affine.IDENTITY)
    state = cut(tree.unionByName(start.select("g", "node", F.col("node").alias("parent"), one.alias("m"))))
    while True:
        up = state.select("g", F.col("node").alias("parent"), F.col("parent").alias("next"), F.col("m").alias("above"))
        moved = F.col("next") != F.col("parent")
        state = cut(state.join(up, ["g", "parent"]).select("g", "node", F.col("next").alias("parent"), F.when(moved, affine.multiply(F.col("above"), F.col("m"))).otherwise(F.col("m")).alias("m"), moved.alias("moved")))
        if state.filter("moved").isEmpty():
            return state.select("g", "node", "m")
        # a start is its own parent, so its matrix is the identity and nodes that point at it are done
        state = state.drop("moved")


def by_position(lat: Column, lon: Column, lat0: Column, lon0: Column, pixels_per_metre: float) -> Column:
    """The shift from the reference's position, y growing to the south."""
    dx = RADIUS * F.radians(lon - lon0) * F.cos(F.radians((lat + lat0) / 2))
    dy = -RADIUS * F.radians(lat - lat0)
    return affine.shift(dx * pixels_per_metre, dy * pixels_per_metre)


def place(frames: DataFrame, pairs: DataFrame, by: str, order: list[str], pixels_per_metre: float = 10.0) -> DataFrame:
    """(by, frame_id, placed, matrix): 'visual' or 'gps', and the matrix to the coordinates of the survey's first frame.

    frames have by, frame_id, lat, lon and what order names; pairs have by, source_id, target_id, number (their order) and matrix,
    which takes the source's coordinates to the target's, and are read twice: first without matrices, then for
    the chosen. Pairs with an unknown frame or a singular matrix don't count. A frame with neither a way to the reference nor a
    position is left out. Where the reference has no position, 0, 0 stands for it.
    """
    # read again several times, so as a table of columns; what the result reads of it stays as long as a checkpoint
    frames = Scratch(frames.sparkSession).keep(frames.select(F.col(by).alias("g"), F.col("frame_id").alias("node"), "lat", "lon", F.struct(*order).alias("__order")))
    first = cut(frames.groupBy("g").agg(F.min_by(F.struct("node", "lat", "lon"), "__order").alias("f")).select("g", "f.*"))
    known = frames.select("g", "node")
    edges = pairs.select(F.col(by).alias("g"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), "number", F.col("matrix").alias("m"))
    good = edges.filter(_regular(F.col("m")) & (F.col("a") != F.col("b")))
    start = first.select("g", "node")
    tree = forest(edges, reached(good.drop("m"), start, known))
    seen = cut(composed(tree, start))
    rest = frames.join(_hinted(seen.select("g", "node"), seen.count()), ["g", "node"], "left_anti").filter("lat IS NOT NULL AND lon IS NOT NULL")
    origin = first.select("g", F.coalesce("lat", F.lit(0.0)).alias("lat0"), F.coalesce("lon", F.lit(0.0)).alias("lon0"))
    shifted = by_position(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"), pixels_per_metre)
    fallen = rest.join(_hinted(origin, first.count()), "g").select("g", "node", F.lit("gps").alias("placed"), shifted.alias("m"))
    every = seen.select("g", "node", F.lit("visual").alias("placed"), "m").unionByName(fallen)
    return every.select(F.col("g").alias(by), F.col("node").alias("frame_id"), "placed", F.col("m").alias("matrix"))
