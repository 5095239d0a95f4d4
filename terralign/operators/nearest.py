"""The two nearest descriptors of another frame, exactly, over blocks of descriptors.

A frame of more than BLOCK features is parted by its nearest pivots (a Voronoi partition over PIVOTS features that a hash picks),
and parts that are still too large by a hash. Frame pairs meet as pairs of blocks, of which the triangle inequality drops
those that can't hold a second nearest: a block is out if the distance of the pivots, less both radii, is above what some
nearer blocks with two features between them can't exceed. What is left is compared by one matrix product (L2) or by popcounts
(Hamming) per pair of blocks, and two rows for each feature and block leave the task, so what is shuffled follows features
and blocks, never the product of the two frames' features.

Descriptors spread evenly over many dimensions have radii near their distances; then no block can be dropped, by this or any
other exact bound, and all blocks of the two frames meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import cut

#: Features of a block, and pivots at most; as many are used as the largest frame needs parts.
BLOCK, PIVOTS = 1024, 256
METRICS = ("l2", "hamming")
#: Candidates for each query that are computed again to the last digit.
AGAIN = 8


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances of the rows of a and b; for L2 from a matrix product, so to some 1e-7 only."""
    if metric == "hamming":
        out = np.zeros((len(a), len(b)), np.int64)
        for w in range(a.shape[1]):
            out += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
        return out
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def two_best(a: np.ndarray, b: np.ndarray, rank: np.ndarray, metric: str, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the two nearest of each row of a, by distance (rounded to digits) and rank."""
    d = distances(a, b, metric)
    n, m = d.shape
    k = min(m, 2 if metric == "hamming" else AGAIN)
    if metric == "hamming":  # exact whole numbers: the rank breaks ties
        key = d * m + rank
        some = np.argpartition(key, k - 1, 1)[:, :k]
        found = [(np.repeat(np.arange(n), k), some.ravel(), np.take_along_axis(d, some, 1).ravel().astype(float))]
    else:
        some = np.argpartition(d, k - 1, 1)[:, :k]
        near = np.sort(np.take_along_axis(d, some, 1), 1)
        close = (near[:, min(1, k - 1)] + 2 * 10.0 ** -(digits or 7) >= near[:, -1]) & (m > k)
        sure = np.flatnonzero(~close)
        exact = np.sqrt(((a[sure, None] - b[some[sure]]) ** 2).sum(2))
        found = [(np.repeat(sure, k), some[sure].ravel(), exact.ravel())]
        for i in np.flatnonzero(close):  # more are as near as the second
            found.append((np.full(m, i), np.arange(m), np.sqrt(((a[i] - b) ** 2).sum(1))))
    row, col, far = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((rank[col], far if digits is None else np.round(far, digits), row))
    row, col, far = row[order], col[order], far[order]
    first = np.searchsorted(row, row, "left")
    top = np.arange(len(row)) - first < 2
    return row[top], col[top], far[top]


def _matrix(column: pa.Array, metric: str) -> np.ndarray:
    width = len(column[0]) if len(column) else 1
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.uint64 if metric == "hamming" else float).reshape(-1, width)


def _assign(pivots: np.ndarray, metric: str):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = distances(_matrix(b.column(2), metric), pivots, metric).astype(float)
                d[np.arange(len(pivots)) >= b.column(3).to_numpy()[:, None]] = np.inf  # a frame has as many parts as it needs
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["frame", "kp", "desc", "cell", "far"])

    return emit


def blocks(features: DataFrame, metric: str) -> tuple[DataFrame, DataFrame]:
    """(frame, cell, sub, n, radius, rows) of features (frame, kp, desc), and (ca, cb, gap), the distances of the pivots."""
    features = cut(features.select("frame", "kp", "desc").filter("desc IS NOT NULL"))
    sizes = features.groupBy("frame").agg(F.least(F.ceil(F.count(F.lit(1)) / BLOCK), F.lit(PIVOTS)).cast("int").alias("parts"))
    most = sizes.agg(F.max("parts")).first()[0] or 1
    sample = features.orderBy(F.xxhash64("frame", "kp")).limit(most).select("desc").toArrow()
    pivots = _matrix(sample.column("desc").combine_chunks(), metric)
    spark = features.sparkSession
    between = distances(pivots, pivots, metric).astype(float)
    gaps = spark.createDataFrame([(i, j, float(between[i, j])) for i in range(len(pivots)) for j in range(len(pivots))], "ca int, cb int, gap double")
    kinds = ", ".join(f"{c} {features.schema[c].dataType.simpleString()}" for c in ("frame", "kp", "desc"))
    placed = cut(features.join(sizes, "frame").select("frame", "kp", "desc", "parts").mapInArrow(_assign(pivots, metric), f"{kinds}, cell int, far double"))
    subs = placed.groupBy("frame", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("subs"))
    dealt = placed.join(subs, ["frame", "cell"]).withColumn("sub", F.pmod(F.xxhash64("kp"), F.col("subs")).cast("int"))
    return cut(dealt.groupBy("frame", "cell", "sub").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.collect_list("kp").alias("kps"), F.collect_list("desc").alias("descs"))), gaps


def candidates(pairs: DataFrame, parts: DataFrame, gaps: DataFrame) -> DataFrame:
    """The pairs of blocks that can hold a first or second nearest: source_id, target_id, cell and sub of both."""
    meta = lambda k, side: parts.select(F.col("frame").alias(side), F.col("cell").alias(f"c{k}"), F.col("sub").alias(f"s{k}"), F.col("n").alias(f"n{k}"), F.col("radius").alias(f"r{k}"))
    met = pairs.select("source_id", "target_id").join(meta("a", "source_id"), "source_id").join(meta("b", "target_id"), "target_id").join(F.broadcast(gaps), ["ca", "cb"])
    most = F.col("gap") + F.col("ra") + F.col("rb")
    own = ["source_id", "target_id", "ca", "sa"]
    upto = Window.partitionBy(*own).orderBy("most").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.withColumn("most", most).withColumn("held", F.sum("nb").over(upto))
    bound = F.min(F.when(F.col("held") >= 2, F.col("most"))).over(Window.partitionBy(*own))
    least = F.col("gap") - F.col("ra") - F.col("rb")
    return met.withColumn("bound", bound).filter(F.col("bound").isNull() | (least <= F.col("bound") * (1 + 1e-9) + 1e-6)).select(*own, "cb", "sb")


def _compare(metric: str, digits: int | None):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at = lambda c, i=i, b=b: b.column(b.schema.get_field_index(c)).slice(i, 1)
                queries, trains = at("kps_a").flatten(), at("kps_b").flatten()
                rank = np.empty(len(trains), np.int64)
                rank[pc.sort_indices(trains).to_numpy()] = np.arange(len(trains))
                row, col, far = two_best(_matrix(at("descs_a").flatten(), metric), _matrix(at("descs_b").flatten(), metric), rank, metric, digits)
                same = lambda c, n=len(row): pa.concat_arrays([at(c)]).take(pa.array(np.zeros(n, np.int64)))
                yield pa.RecordBatch.from_arrays([same("source_id"), same("target_id"), queries.take(pa.array(row)), trains.take(pa.array(col)), pa.array(far)], ["source_id", "target_id", "query", "train", "d"])

    return emit


def two_nearest(pairs: DataFrame, features: DataFrame, metric: str = "l2", round_to: int | None = None) -> DataFrame:
    """(source_id, target_id, query, best, d1, d2): for each source feature its two nearest in the target frame.

    features has frame, kp and desc (numbers for l2, longs of bits for hamming). Distances are rounded to round_to digits before
    they are compared; ties go to the lesser kp. A target frame of one feature gives no d2. Features without a descriptor
    take no part.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    asked = cut(pairs.select("source_id", "target_id").distinct())
    used = asked.select(F.explode(F.array("source_id", "target_id")).alias("frame")).distinct()
    parts, gaps = blocks(features.join(used, "frame", "left_semi"), metric)
    met = candidates(asked, parts, gaps)
    load = lambda k, side: parts.select(F.col("frame").alias(side), F.col("cell").alias(f"c{k}"), F.col("sub").alias(f"s{k}"), F.col("kps").alias(f"kps_{k}"), F.col("descs").alias(f"descs_{k}"))
    both = met.join(load("a", "source_id"), ["source_id", "ca", "sa"]).join(load("b", "target_id"), ["target_id", "cb", "sb"])
    types = {c: features.schema[f].dataType.simpleString() for c, f in (("source_id", "frame"), ("target_id", "frame"), ("query", "kp"), ("train", "kp"))}
    found = both.select("source_id", "target_id", "kps_a", "descs_a", "kps_b", "descs_b").mapInArrow(_compare(metric, round_to), ", ".join(f"{c} {t}" for c, t in types.items()) + ", d double")
    d = F.col("d").cast("long") if metric == "hamming" else F.round("d", round_to) if round_to else F.col("d")
    near = Window.partitionBy("source_id", "target_id", "query").orderBy("d", "train")
    top = found.withColumn("d", d).withColumn("rank", F.row_number().over(near)).filter("rank <= 2")
    of = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return top.groupBy("source_id", "target_id", "query").agg(of(1, "train").alias("best"), of(1, "d").alias("d1"), of(2, "d").alias("d2"))
