"""Poses of all frames of many surveys at once: a robust least-squares solution of their pair transforms.

Each pair asks four points of its source to land where its target puts them, weighted by its inlier ratio; large residuals count
less, by Cauchy's loss with a scale of ten pixels. Each frame is drawn to its position, heading and scale 1. What is solved
for is (x, y, rotation, scale) of every frame, by Gauss-Newton steps whose damping grows, survey by survey, when a step
doesn't help.

Nothing holds a survey. Edges join the poses of their two frames and give derivatives in Arrow batches; sums over a frame's edges
are the diagonal blocks of the normal equations, and the edges' cross blocks stay rows. A step comes from conjugate gradients
in the form with one reduction: a product with the matrix is a join of cross blocks with the vector and a sum by frame, and the
scalars of each survey are sums by survey. The preconditioner is block-Jacobi over clusters of CLUSTER frames that lie
together: a task solves one cluster's equations as if there were no other, so a survey that fits a cluster takes one round.
The solution starts where clusters come to rest by their own edges alone, wherever a survey's cost is less there.

What rounds read again is kept: poses, derivatives and vectors are checkpointed, cross blocks are laid out once per step by
the keys that they are joined on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import affine
from ..sources.checkpoints import Scratch, cut
from . import ordered

#: Frames of a cluster at most; a cluster's matrix is dense, 8 MB.
CLUSTER = 256
#: Rounds of one step's conjugate gradients, steps, and the relative size at which a residual counts as nothing.
ROUNDS, STEPS, TOLERANCE = 500, 50, 1e-7
#: Steps of a cluster by itself.
SETTLING = 500
LOSS = 10.0
PRIOR = (1.0, 1.0, 50.0, 100.0)
_UPPER = [(r, c) for r in range(4) for c in range(r, 4)]
_CORNERS = np.array([[0.25, 0.25], [0.75, 0.25], [0.25, 0.75], [0.75, 0.75]])


def _array(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel()))


DERIVED = "g string, c long, me string, oc long, other string, cost double, grad array<double>, own array<double>, block array<double>"


def _terms(p: np.ndarray, q: np.ndarray, m: np.ndarray, size: np.ndarray, weight: np.ndarray) -> tuple:
    """Of edges between poses p and q: costs, gradients of both ends, diagonal blocks of both, and cross blocks."""
    a = _CORNERS[None] * size[:, None, :2]
    there = np.einsum("pij,pkj->pki", m, np.concatenate([a, np.ones((*a.shape[:2], 1))], 2))
    a, there = a - size[:, None, :2] / 2, there[..., :2] / there[..., 2:] - size[:, None, 2:] / 2

    def put(pose: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, s, scale = np.cos(pose[:, 2, None]), np.sin(pose[:, 2, None]), pose[:, 3, None]
        ux, uy = c * at[..., 0] - s * at[..., 1], s * at[..., 0] + c * at[..., 1]
        one, none = np.ones_like(ux), np.zeros_like(ux)
        slope = np.stack([np.stack([one, none, -scale * uy, ux], 2), np.stack([none, one, scale * ux, uy], 2)], 2)
        return np.stack([pose[:, 0, None] + scale * ux, pose[:, 1, None] + scale * uy], 2), slope

    (here, left), (far, right) = put(p, a), put(q, there)
    off = ((here - far) * weight[:, None, None]).reshape(-1, 8)
    left, right = ((sign * weight[:, None, None, None] * x).reshape(-1, 8, 4) for sign, x in ((1.0, left), (-1.0, right)))
    robust = 1 / (1 + (off / LOSS) ** 2)
    cost = (LOSS**2 * np.log1p((off / LOSS) ** 2)).sum(1)
    both = np.concatenate([left, right], 2)
    heavy = (both * robust[:, :, None]).transpose(0, 2, 1)
    grad, block = (heavy @ off[:, :, None])[..., 0], heavy @ both
    return cost, grad[:, :4], grad[:, 4:], block[:, :4, :4], block[:, 4:, 4:], block[:, :4, 4:]


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows for each edge, one as its source and one as its target sees it: its part of the frame's gradient and diagonal
    block, its cross block, and the edge's cost in the source's row."""
    for b in batches:
        col = dict(zip(b.schema.names, b.columns, strict=True))
        p, q, m, size = (_array(col[c], k) for c, k in (("ps", 4), ("pt", 4), ("m", 9), ("size", 4)))
        cost, *grads, own_s, own_t, cross = _terms(p, q, m.reshape(-1, 3, 3), size, col["weight"].to_numpy())
        upper = np.concatenate([np.stack([o[:, r, c] for r, c in _UPPER], 1) for o in (own_s, own_t)])
        two = lambda x, y: pa.concat_arrays([col[x], col[y]])
        blocks = np.concatenate([cross.reshape(-1, 16), cross.transpose(0, 2, 1).reshape(-1, 16)])
        yield pa.RecordBatch.from_arrays(
            [two("g", "g"), two("cs", "ct"), two("s", "t"), two("ct", "cs"), two("t", "s"), pa.array(np.r_[cost, np.zeros(len(cost))]), _lists(np.concatenate(grads)), _lists(upper), _lists(blocks)],
            ["g", "c", "me", "oc", "other", "cost", "grad", "own", "block"],
        )


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of rows of values by their place."""
    width = int(np.prod(values.shape[1:]))
    flat = (at[:, None] * width + np.arange(width)).ravel()
    return np.bincount(flat, values.ravel(), n * width).reshape(n, *values.shape[1:])


class Bunch:
    """Clusters that come to rest each by its own edges, side by side: edges of all are differentiated at once, and equations are
    solved by connected parts, those of about one size in one call. Steps, damping and rest are a cluster's own."""

    def __init__(self, start: np.ndarray, of_frame: np.ndarray, of_edge: np.ndarray, i: np.ndarray, j: np.ndarray, given: tuple, prior: float):
        self.start, self.of_frame, self.of_edge, self.i, self.j, self.given, self.scales = start, of_frame, of_edge, i, j, given, prior * np.array(PRIOR)
        n, part = len(start), np.arange(len(start))
        while True:  # a part goes by its least frame
            least = part.copy()
            np.minimum.at(least, i, part[j])
            np.minimum.at(least, j, part[i])
            least = least[least]
            if (least == part).all():
                break
            part = least
        linked = np.zeros(n, bool)
        linked[i] = linked[j] = True
        heads, back, size = np.unique(part[linked], return_inverse=True, return_counts=True)
        order = np.argsort(size, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.size, self.part = size[order], np.full(n, -1)  # frames without edges lie where their priors have them
        self.part[linked] = rank[back]
        self.frames = np.argsort(self.part, kind="stable")[n - int(linked.sum()) :]
        self.first = np.r_[0, np.cumsum(self.size)]
        self.local = np.zeros(n, np.int64)
        self.local[self.frames] = np.arange(len(self.frames)) - np.repeat(self.first[:-1], self.size)
        self.edges = np.argsort(self.part[i], kind="stable")
        self.first_edge = np.searchsorted(self.part[i][self.edges], np.arange(len(size) + 1))
        self.cluster = of_frame[self.frames[self.first[:-1]]]

    def at(self, p: np.ndarray, edges: np.ndarray, frames: np.ndarray, clusters: int) -> tuple[np.ndarray, ...]:
        """Of some clusters' edges and frames: costs by cluster, gradients and diagonal blocks by frame, cross blocks by edge."""
        i, j, n = self.i[edges], self.j[edges], len(self.start)
        cost, grad_s, grad_t, own_s, own_t, cross = _terms(p[i], p[j], *(x[edges] for x in self.given))
        off = p[frames] - self.start[frames]
        off[:, 2] = np.arctan2(np.sin(off[:, 2]), np.cos(off[:, 2]))
        far = off * self.scales
        robust = 1 / (1 + (far / LOSS) ** 2)
        grad, own = _sums(i, grad_s, n) + _sums(j, grad_t, n), _sums(i, own_s, n) + _sums(j, own_t, n)
        grad[frames] += self.scales * robust * far
        own[frames[:, None], np.arange(4), np.arange(4)] += self.scales**2 * robust
        alone = np.flatnonzero(i == j)
        np.add.at(own, i[alone], cross[alone] + cross[alone].transpose(0, 2, 1))
        cost = np.bincount(self.of_edge[edges], cost, clusters) + np.bincount(self.of_frame[frames], (LOSS**2 * np.log1p((far / LOSS) ** 2)).sum(1), clusters)
        return cost, grad, own, cross

    def step(self, grad: np.ndarray, own: np.ndarray, cross: np.ndarray, damping: np.ndarray, going: np.ndarray) -> np.ndarray:
        out, four = np.zeros_like(grad), np.arange(4)
        parts = np.flatnonzero(going[self.cluster])
        wide = -(-self.size[parts] // 4) * 4
        for n in np.unique(wide):
            alike = parts[wide == n]
            held = max((1 << 20) // int(16 * n * n), 1)
            for lo in range(0, len(alike), held):
                some = alike[lo : lo + held]
                frames, edges = (x[_ranges(first[some], first[some + 1])] for x, first in ((self.frames, self.first), (self.edges, self.first_edge)))
                edges = edges[self.i[edges] != self.j[edges]]
                row = np.empty(len(self.size), np.int64)
                row[some] = np.arange(len(some))
                a, g = np.zeros((len(some), n, 4, n, 4)), np.zeros((len(some), n, 4))
                a.reshape(len(some), 16 * n * n)[:, :: 4 * n + 1] = 1  # places beyond a part's frames
                k, at = row[self.part[frames]], self.local[frames]
                mine = own[frames].copy()
                mine[:, four, four] += damping[self.of_frame[frames], None] * (mine[:, four, four] + 1e-9)
                a[k[:, None, None], at[:, None, None], four[:, None], at[:, None, None], four] = mine
                g[k, at] = grad[frames]
                i, j, k = self.local[self.i[edges]], self.local[self.j[edges]], row[self.part[self.i[edges]]]
                for r, c, block in ((i, j, cross[edges]), (j, i, cross[edges].transpose(0, 2, 1))):
                    flat = (((k * n + r) * 4)[:, None, None] + four[:, None]) * (4 * n) + (c * 4)[:, None, None] + four
                    np.add.at(a.reshape(-1), flat.ravel(), block.ravel())
                x = np.linalg.solve(a.reshape(len(some), 4 * n, 4 * n), g.reshape(len(some), 4 * n, 1)).reshape(len(some), n, 4)
                out[frames] = x[row[self.part[frames]], at]
        return out

    def rest(self, clusters: int) -> tuple[np.ndarray, np.ndarray]:
        """Poses, and which clusters came to rest."""
        p, damping, rested = self.start.copy(), np.full(clusters, 1e-3), np.ones(clusters, bool)
        rested[self.of_edge] = False
        going = ~rested
        of = lambda which: (np.flatnonzero(which[self.of_edge]), np.flatnonzero(which[self.of_frame]))
        edges, frames = of(going)
        now, grad, own, cross = self.at(p, edges, frames, clusters)
        every = np.zeros((len(self.i), 4, 4))
        every[edges] = cross
        for _ in range(SETTLING):
            if not going.any():
                break
            edges, frames = of(going)
            tried = p - self.step(grad, own, every, damping, going)
            after, *derived = self.at(tried, edges, frames, clusters)
            better = going & (after <= now)
            worse = going & ~better
            damping[worse] *= 10
            gain = now - after
            now[better], damping[better] = after[better], np.maximum(damping[better] / 10, 1e-9)
            won, moved = of(better)
            p[moved], grad[moved], own[moved] = tried[moved], derived[0][moved], derived[1][moved]
            every[won] = derived[2][np.searchsorted(edges, won)]
            ended = (worse & (damping >= 1e8)) | (better & (gain <= 1e-14 * now))
            rested |= ended
            going &= ~ended
        return p, rested


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    size = end - start
    return np.repeat(end - np.cumsum(size), size) + np.arange(int(size.sum()))


def _settle(prior: float):
    """Poses of clusters by their own edges alone, from rows of frames (kind 0) and edges (kind 1), sorted by cluster and kind."""

    def of(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        name, kind = rows.column("g").to_pylist(), rows.column("kind").to_numpy()
        c = rows.column("c").to_numpy()
        new = np.r_[False, np.array([x != y for x, y in zip(name[1:], name, strict=False)], bool) | (c[1:] != c[:-1])]
        cluster = np.cumsum(new)
        frames, edges = rows.filter(pa.array(kind == 0)), rows.filter(pa.array(kind == 1))
        of_frame, of_edge = cluster[kind == 0], cluster[kind == 1]
        place = {key: k for k, key in enumerate(zip(of_frame.tolist(), frames.column("f").to_pylist(), strict=True))}
        i, j = (np.array([place[key] for key in zip(of_edge.tolist(), edges.column(e).to_pylist(), strict=True)], np.int64) for e in ("s", "t"))
        start, m, size = (_array(t.column(e).combine_chunks(), k) for t, e, k in ((frames, "start", 4), (edges, "m", 9), (edges, "size", 4)))
        given = m.reshape(-1, 3, 3), size, edges.column("weight").to_numpy()
        p, rested = Bunch(start, of_frame, of_edge, i, j, given, prior).rest(int(cluster[-1]) + 1)
        return pa.RecordBatch.from_arrays([*(frames.column(e).combine_chunks() for e in ("g", "f", "start", "c")), _lists(p), pa.array(rested[of_frame])], ["g", "f", "start", "c", "p", "rested"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            held = rows if held is None else pa.concat_tables([held, rows])
            g, c = held.column("g"), held.column("c").to_numpy()
            end = held.num_rows - 1
            other = (c != c[end]) | ~pc.equal(g, g[end]).to_numpy()
            cut_at = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0  # the last cluster may go on
            if cut_at:
                yield of(held.slice(0, cut_at))
                held = held.slice(cut_at)
        if held is not None:
            yield of(held)

    return each


def _precondition(rows: pa.Table, edges: pa.Table) -> pa.Table:
    """rows of a cluster plus z, which solves the cluster's own equations for r."""
    names, n = rows.column("f").to_pylist(), rows.num_rows
    place, a = {f: i for i, f in enumerate(names)}, np.zeros((n, 4, n, 4))
    own = _array(rows.column("own").combine_chunks(), 10)
    for k, (r, c) in enumerate(_UPPER):
        a[np.arange(n), r, np.arange(n), c] = a[np.arange(n), c, np.arange(n), r] = own[:, k]
    if edges.num_rows:
        i, j = (np.array([place[f] for f in edges.column(c).to_pylist()]) for c in ("me", "other"))
        np.add.at(a, (i[:, None, None], np.arange(4)[:, None], j[:, None, None], np.arange(4)), _array(edges.column("block").combine_chunks(), 16).reshape(-1, 4, 4))
    z = np.linalg.solve(a.reshape(4 * n, 4 * n), _array(rows.column("r").combine_chunks(), 4).ravel()).reshape(n, 4)
    rows = rows.append_column("z", pa.chunked_array([_lists(z)]))
    vector = pa.list_(pa.float64())
    return rows.cast(pa.schema([(f.name, vector if pa.types.is_list(f.type) else f.type) for f in rows.schema]))


def _each(make, *arrays: Column) -> Column:
    """An array of four from make(k-th entries)."""
    return F.array(*(make(*(F.get(a, k) for a in arrays)) for k in range(4)))


def _dot(a: Column, b: Column) -> Column:
    return sum((F.get(a, k) * F.get(b, k) for k in range(1, 4)), F.get(a, 0) * F.get(b, 0))


def _symmetric(upper: Column, v: Column) -> Column:
    """The product of a symmetric 4 x 4 block, given by its upper half, with v."""
    at = {(r, c): k for k, (r, c) in enumerate(_UPPER)}
    return F.array(*(sum((F.get(upper, at[min(r, c), max(r, c)]) * F.get(v, c) for c in range(1, 4)), F.get(upper, at[0, r]) * F.get(v, 0)) for r in range(4)))


def _zero() -> Column:
    return F.array(*(F.lit(0.0) for _ in range(4)))


def _spread(code: Column) -> Column:
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        code = code.bitwiseOR(F.shiftleft(code, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return code


def clusters(frames: DataFrame) -> DataFrame:
    """frames (g, f, start) plus c: runs of CLUSTER frames of a survey along a curve that keeps neighbours together."""
    x, y = F.get("start", 0), F.get("start", 1)
    box = frames.groupBy("g").agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y), F.lit(1e-9)).alias("wide"))
    cell = lambda v, low: F.floor((v - F.col(low)) / F.col("wide") * 65535).cast("long")
    coded = frames.join(box, "g").withColumn("z", _spread(cell(x, "x0")).bitwiseOR(F.shiftleft(_spread(cell(y, "y0")), 1))).drop("x0", "y0", "wide")
    return ordered.ranked(coded, ["g"], ["z", "f"]).withColumn("c", F.floor((F.col("pos") - 1) / CLUSTER).cast("long")).drop("z", "pos")


def linearise(frames: DataFrame, edges: DataFrame, prior: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows of edges as `_derive` gives them, and frames (g, f, c, start, p) plus own, grad and cost, with the priors' part."""
    side = lambda k: frames.select("g", F.col("f").alias(k), F.col("c").alias(f"c{k}"), F.col("p").alias(f"p{k}"))
    rows = edges.join(side("s"), ["g", "s"]).join(side("t"), ["g", "t"]).select("g", "s", "t", "cs", "ct", "ps", "pt", "m", "size", "weight")
    rows = scratch.keep(rows.mapInArrow(_derive, DERIVED))
    sums = rows.groupBy("g", F.col("me").alias("f")).agg(
        F.array(*(F.sum(F.get("own", k)) for k in range(10))).alias("o"), F.array(*(F.sum(F.get("grad", k)) for k in range(4))).alias("d"), F.sum("cost").alias("e")
    )
    scales = [prior * s for s in PRIOR]
    off = [F.get("p", k) - F.get("start", k) for k in range(4)]
    off[2] = F.atan2(F.sin(off[2]), F.cos(off[2]))
    far = [o * s for o, s in zip(off, scales, strict=True)]
    robust = [1 / (1 + (x / LOSS) * (x / LOSS)) for x in far]
    known = lambda c, k: F.coalesce(F.get(c, k), F.lit(0.0))
    own = F.array(*(known("o", i) + (robust[r] * scales[r] ** 2 if r == c else 0.0) for i, (r, c) in enumerate(_UPPER)))
    grad = F.array(*(known("d", k) + scales[k] * robust[k] * far[k] for k in range(4)))
    cost = F.coalesce("e", F.lit(0.0)) + sum((LOSS**2 * F.log1p((x / LOSS) * (x / LOSS)) for x in far), F.lit(0.0))
    whole = frames.select("g", "f", "c", "start", "p").join(sums, ["g", "f"], "left")
    return rows, scratch.keep(whole.select("g", "f", "c", "start", "p", own.alias("own"), grad.alias("grad"), cost.alias("cost")))


def conjugate_gradients(frames: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, f, x) that solves own x + the sum of block x over edges = grad, for every survey; frames have g, f, c, own and grad."""
    n = max(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    inside = edges.filter("c = oc").select("g", "c", "me", "other", "block").repartition(n, "g", "c").persist(StorageLevel.MEMORY_AND_DISK)
    cross = edges.select("g", F.col("me").alias("to"), F.col("other").alias("f"), "block").repartition(n, "g", "f").persist(StorageLevel.MEMORY_AND_DISK)
    names = ["x", "r", "p", "s"]
    kinds = "g string, c long, f string, own array<double>, " + ", ".join(f"{v} array<double>" for v in [*names, "z"])
    state = frames.select("g", "c", "f", "own", _zero().alias("x"), F.col("grad").alias("r"), _zero().alias("p"), _zero().alias("s"))
    scalars = whole = None
    for _ in range(ROUNDS):
        z = state.groupBy("g", "c").cogroup(inside.groupBy("g", "c")).applyInArrow(_precondition, kinds)
        product = F.array(*(sum((F.get("block", 4 * r + k) * F.get("z", k) for k in range(1, 4)), F.get("block", 4 * r) * F.get("z", 0)) for r in range(4)))
        met = cross.join(z.select("g", "f", "z"), ["g", "f"]).select("g", F.col("to").alias("f"), product.alias("v"))
        met = met.groupBy("g", "f").agg(F.array(*(F.sum(F.get("v", k)) for k in range(4))).alias("v"))
        w = _each(lambda own, far: own + F.coalesce(far, F.lit(0.0)), _symmetric(F.col("own"), F.col("z")), F.col("v"))
        whole = scratch.keep(z.join(met, ["g", "f"], "left").select("g", "c", "f", "own", *names, "z", w.alias("w")), whole)
        dots = {"gamma": ("r", "z"), "delta": ("w", "z"), "rr": ("r", "r"), "rw": ("r", "w"), "rs": ("r", "s"), "ww": ("w", "w"), "ws": ("w", "s"), "ss": ("s", "s")}
        now = whole.groupBy("g").agg(*(F.sum(_dot(F.col(a), F.col(b))).alias(k) for k, (a, b) in dots.items()))
        if scalars is None:
            now = now.withColumns({"first": F.col("rr"), "beta": F.lit(0.0), "alpha": F.try_divide("gamma", "delta")})
        else:
            old = scalars.select(F.col("g").alias("h"), "first", F.col("gamma").alias("before"), F.col("alpha").alias("last"), F.col("going").alias("went"))
            now = now.join(old, F.col("g") == F.col("h")).filter("went").withColumn("beta", F.try_divide("gamma", "before"))
            now = now.withColumn("alpha", F.try_divide(F.col("gamma"), F.col("delta") - F.try_divide(F.col("beta") * F.col("gamma"), F.col("last"))))
        # the square of the residual behind this round's move along s = w + beta s
        a, b = F.col("alpha"), F.col("beta")
        left = F.col("rr") - a * 2 * (F.col("rw") + b * F.col("rs")) + a * a * (F.col("ww") + b * 2 * F.col("ws") + b * b * F.col("ss"))
        moves = F.coalesce((a > 0) & ~F.isnan(a), F.lit(False))
        scalars = scratch.keep(now.select("g", "first", "gamma", "beta", "alpha", moves.alias("moves"), (moves & (left > TOLERANCE**2 * F.col("first"))).alias("going")), scalars)
        on = whole.join(scalars.filter("moves").select("g", "alpha", "beta"), "g", "left")
        along = lambda base, old: _each(lambda a, b: a + F.col("beta") * b, F.col(base), F.col(old))
        turned = on.filter("alpha IS NOT NULL").withColumns({"p": along("z", "p"), "s": along("w", "s")})
        moved = {"x": _each(lambda a, b: a + F.col("alpha") * b, F.col("x"), F.col("p")), "r": _each(lambda a, b: a - F.col("alpha") * b, F.col("r"), F.col("s"))}
        state = turned.withColumns(moved).select("g", "c", "f", "own", *names).unionByName(on.filter("alpha IS NULL").select("g", "c", "f", "own", *names))
        if scalars.filter("going").isEmpty():
            break
    found = scratch.keep(state.select("g", "f", "x"))
    inside.unpersist()
    cross.unpersist()
    scratch.drop(whole, scalars)
    return found


def solve(frames: DataFrame, edges: DataFrame, prior: float, scratch: Scratch) -> DataFrame:
    """(g, f, p) of frames (g, f, start) from edges (g, s, t, m, size, weight), of the surveys that have edges.

    Every survey takes the same steps as if it were alone; those whose cost no longer falls are put aside. Tables are deleted once
    nothing reads them again, so a round's disk doesn't add to the ones before.
    """
    if edges.isEmpty():
        return frames.limit(0).select("g", "f", F.col("start").alias("p"))
    frames = scratch.keep(clusters(frames.join(edges.select("g").distinct(), "g", "left_semi")).withColumn("p", F.col("start")))
    at = lambda k: frames.select("g", F.col("f").alias(k), F.col("c").alias(f"c{k}"))
    inside = edges.join(at("s"), ["g", "s"]).join(at("t"), ["g", "t"]).filter("cs = ct").select("g", F.col("cs").alias("c"), "s", "t", "m", "size", "weight")
    kinds = "g string, f string, start array<double>, c long, p array<double>, rested boolean"
    n = max(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    of_frames = frames.select("g", "c", F.lit(0).alias("kind"), "f", "start")
    dealt = of_frames.unionByName(inside.withColumn("kind", F.lit(1)), allowMissingColumns=True).repartition(n, "g", "c").sortWithinPartitions("g", "c", "kind", "f")
    settled = scratch.keep(dealt.mapInArrow(_settle(prior), kinds))
    # a cluster that came to rest and is a whole survey is solved
    open_ = scratch.keep(settled.groupBy("g").agg(F.max("c").alias("last"), F.every("rested").alias("rested")).filter("last > 0 OR NOT rested").select("g"))
    ended = [settled.join(open_, "g", "left_anti").select("g", "f", "p")]
    if open_.isEmpty():
        return ended[0]
    left = lambda x: scratch.keep(x.join(open_, "g", "left_semi"))
    frames, moved, edges = left(frames), left(settled.drop("rested")), left(edges)
    begun, (rows, whole) = linearise(frames, edges, prior, scratch), linearise(moved, edges, prior, scratch)
    scratch.drop(frames, moved)
    total = lambda w, name: w.groupBy("g").agg(F.sum("cost").alias(name))
    worse = scratch.keep(total(begun[1], "old").join(total(whole, "new"), "g").filter("NOT new <= old").select("g"))
    if not worse.isEmpty():
        settled_parts = rows, whole
        rows, whole = (scratch.keep(new.join(worse, "g", "left_anti").unionByName(old.join(worse, "g", "left_semi"))) for old, new in zip(begun, (rows, whole), strict=True))
        scratch.drop(*begun, *settled_parts)
    else:
        scratch.drop(*begun)
    surveys = scratch.keep(whole.groupBy("g").agg(F.sum("cost").alias("cost")).withColumn("damping", F.lit(1e-3)))
    for _ in range(STEPS):
        diagonal = {i for i, (r, c) in enumerate(_UPPER) if r == c}
        damped = F.array(*((F.get("own", i) + F.col("damping") * (F.get("own", i) + 1e-9)) if i in diagonal else F.get("own", i) for i in range(10)))
        step = conjugate_gradients(whole.join(surveys.select("g", "damping"), "g").select("g", "f", "c", damped.alias("own"), "grad"), rows, scratch)
        moved = whole.select("g", "f", "c", "start", "p").join(step, ["g", "f"]).withColumn("p", _each(lambda a, b: a - b, F.col("p"), F.col("x"))).drop("x")
        moved = scratch.keep(moved)
        new_rows, new_whole = linearise(moved, edges, prior, scratch)
        scratch.drop(step, moved)
        after = new_whole.groupBy(F.col("g").alias("h")).agg(F.sum("cost").alias("after"))
        better = F.coalesce(F.col("after") <= F.col("cost"), F.lit(False))
        still = F.abs(F.col("cost") - F.col("after")) <= 1e-9 * F.greatest(F.col("after"), F.lit(1e-12))
        done = F.coalesce(still, F.lit(False)) | (~better & (F.col("damping") * 10 >= 1e8))
        told = surveys.join(after, F.col("g") == F.col("h")).select("g", F.when(better, F.col("after")).otherwise(F.col("cost")).alias("cost"), F.when(better, F.greatest(F.col("damping") / 10, F.lit(1e-9))).otherwise(F.col("damping") * 10).alias("damping"), better.alias("better"), done.alias("done"))
        told = scratch.keep(told)
        counts = told.agg(F.count_if("better").alias("better"), F.count_if("done").alias("done"), F.count(F.lit(1)).alias("n")).first()
        parts = rows, whole, new_rows, new_whole
        if counts.better == counts.n:
            rows, whole = new_rows, new_whole
            scratch.drop(*parts[:2])
        else:
            won = told.filter("better").select("g")
            rows, whole = (scratch.keep(old.join(won, "g", "left_anti").unionByName(new.join(won, "g", "left_semi"))) for old, new in ((rows, new_rows), (whole, new_whole)))
            scratch.drop(*parts)
        surveys = told.select("g", "cost", "damping")
        if counts.done:
            over = told.filter("done").select("g")
            ended.append(scratch.keep(whole.join(over, "g", "left_semi").select("g", "f", "p")))
            if counts.done == counts.n:
                break
            surveys = scratch.keep(told.filter("NOT done").select("g", "cost", "damping"))
            parts = rows, whole, edges
            rows, whole, edges = (scratch.keep(x.join(over, "g", "left_anti")) for x in parts)
            scratch.drop(*parts)
    else:
        ended.append(whole.select("g", "f", "p"))
    return reduce(DataFrame.unionByName, ended)


def solve_poses(frames: DataFrame, transforms: DataFrame, gsd: float, prior: float = 0.05, survey: str | None = None) -> DataFrame:
    """One row per frame: [survey,] frame_id, world_x, world_y, scale, rotation, matrix, confidence, connected.

    frames have frame_id, easting, northing, yaw, width and height, transforms source_id, target_id, matrix, inlier_ratio and
    status, and both the survey's column if there is one. Only successful transforms between two known frames count. A
    survey without any keeps the positions. A null position counts as the survey's corner, a null heading as 0.
    """
    group = F.lit("") if survey is None else F.coalesce(F.concat(F.lit("="), F.col(survey).cast("string")), F.lit("-"))
    own = [] if survey is None else [F.col(survey).alias("survey")]
    base = frames.select(group.alias("g"), *own, F.col("frame_id").cast("string").alias("f"), "frame_id", "easting", "northing", "yaw", "width", "height")
    corner = base.groupBy("g").agg(F.min("easting").alias("e0"), F.max("northing").alias("n0"))
    east, north = F.coalesce("easting", "e0"), F.coalesce("northing", "n0")
    start = F.array((east - F.col("e0")) / gsd, (F.col("n0") - north) / gsd, F.radians(F.coalesce(F.col("yaw").cast("double"), F.lit(0.0))), F.lit(1.0))
    base = cut(base.join(corner, "g").withColumn("start", _each(lambda v: F.coalesce(v.cast("double"), F.lit(0.0)), start)).drop("e0", "n0"))
    size = lambda k: base.select("g", F.col("f").alias(k), F.col("width").alias(f"w{k}"), F.col("height").alias(f"h{k}"))
    pairs = transforms.filter("status = 'success'").select(group.alias("g"), F.col("source_id").cast("string").alias("s"), F.col("target_id").cast("string").alias("t"), F.col("matrix").alias("m"), F.col("inlier_ratio").cast("double").alias("weight"))
    edges = pairs.join(size("s"), ["g", "s"]).join(size("t"), ["g", "t"])
    scratch = Scratch(frames.sparkSession)
    edges = scratch.keep(edges.select("g", "s", "t", "m", F.array(*(F.col(c).cast("double") for c in ("ws", "hs", "wt", "ht"))).alias("size"), "weight"))
    linked = cut(edges.select("g", F.explode(F.array("s", "t")).alias("f")).distinct().withColumn("linked", F.lit(True)))
    solved = cut(solve(base.select("g", "f", "start"), edges, prior, scratch))
    scratch.close()
    out = base.join(solved, ["g", "f"], "left").join(linked, ["g", "f"], "left")
    p = [F.coalesce(F.get("p", k), F.get("start", k)) for k in range(4)]
    matrix = affine.similarity(p[0], p[1], p[2], p[3], F.col("width") / 2, F.col("height") / 2)
    confidence = F.when(F.col("p").isNotNull(), 1.0).otherwise(0.5)
    keep = [] if survey is None else [F.col("survey").alias(survey)]
    return out.select(*keep, "frame_id", p[0].alias("world_x"), p[1].alias("world_y"), p[3].alias("scale"), p[2].alias("rotation"), matrix.alias("matrix"), confidence.alias("confidence"), F.coalesce("linked", F.lit(False)).alias("connected"))
