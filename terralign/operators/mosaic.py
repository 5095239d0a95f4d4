"""Pixels of a survey: features of frames, matches of pairs, and tiles of the mosaic."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels
from ..sources.checkpoints import cut
from . import compose


def _array(row) -> np.ndarray:
    image = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
    return np.repeat(image, 3, 2) if row.channels == 1 else image[..., :3]


def extract(images: DataFrame, kind: str, limit: int, max_side: int) -> DataFrame:
    """(frame_id, n, points, desc, floats): key points and descriptors of each frame; frames without any are left out."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                points, desc = pixels.features(_array(row), kind, limit, max_side)
                if len(points):
                    yield pd.DataFrame([(row.frame_id, len(points), points.astype("<f4").tobytes(), desc.tobytes(), desc.dtype == np.float32)], columns=["frame_id", "n", "points", "desc", "floats"])

    return images.select("frame_id", "width", "height", "channels", "data").mapInPandas(emit, "frame_id string, n int, points binary, desc binary, floats boolean")


def match(features: DataFrame, pairs: DataFrame, ratio: float = 0.75, least_features: int = 8, least_matches: int = 6) -> DataFrame:
    """(source_id, target_id, sx, sy, tx, ty) of each pair's matches; pairs with too few features or matches have none.

    Frames meet by two equi-joins and each pair's descriptors are compared by one matrix product.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                a, c = (np.frombuffer(x, np.float32 if r.floats else np.uint8).reshape(n, -1) for x, n in ((r.desc_s, r.n_s), (r.desc_t, r.n_t)))
                p, q = (np.frombuffer(x, "<f4").reshape(n, 2) for x, n in ((r.points_s, r.n_s), (r.points_t, r.n_t)))
                i, j = pixels.ratio_matches(a, c, ratio)
                if len(i) >= least_matches:
                    yield pd.DataFrame({"source_id": r.source_id, "target_id": r.target_id, "sx": p[i, 0], "sy": p[i, 1], "tx": q[j, 0], "ty": q[j, 1]})

    rich = features.filter(F.col("n") >= least_features)
    side = lambda s: rich.select(F.col("frame_id").alias({"s": "source_id", "t": "target_id"}[s]), F.col("n").alias(f"n_{s}"), F.col("points").alias(f"points_{s}"), F.col("desc").alias(f"desc_{s}"), *(["floats"] if s == "s" else []))
    both = pairs.select("source_id", "target_id").join(side("s"), "source_id").join(side("t"), "target_id")
    return both.mapInPandas(emit, "source_id string, target_id string, sx double, sy double, tx double, ty double")


def luminance(images: DataFrame) -> DataFrame:
    """(frame_id, mean): the mean luminance of each frame."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"frame_id": b["frame_id"], "mean": [float(pixels.gray(_array(r)).mean()) for r in b.itertuples()]})

    return images.select("frame_id", "width", "height", "channels", "data").mapInPandas(emit, "frame_id string, mean double")


#: Frames of a tile that are summed together; a tile with more of them is summed in several buckets, whose sums are added up.
BUCKET = 64
#: Weights are whole numbers of 1 / UNIT, and so are all sums, which therefore don't depend on the order or the buckets of frames.
UNIT = 1 << 16


def _weighted(r, radius: int, h: int, w: int) -> np.ndarray:
    """What a frame adds to a tile: (height, width, 4) whole numbers, colours by weight and the weight."""
    m = np.array([[1, 0, -r.x0], [0, 1, -r.y0], [0, 0, 1.0]]) @ np.array(r.matrix).reshape(3, 3)
    image = _array(r)
    if abs(r.gain - 1) >= 0.01:
        image = np.clip(image * r.gain, 0, 255).astype(np.uint8)
    part, mask = pixels.warp(image, m, h, w)
    weight = np.rint(pixels.feather_weights(mask, radius) * mask * UNIT)[..., None]
    return np.rint(np.concatenate([part * weight, weight], 2)).astype(np.int64)


def _finished(sums: np.ndarray) -> tuple[bytes, bool]:
    """The pixels of a tile (red first, with alpha) from its sums, and whether it is empty."""
    total = sums[..., 3:]
    solid = total > 1e-4 * UNIT
    rgb = np.where(solid, np.clip(sums[..., :3] // np.maximum(total, 1), 0, 255), 0).astype(np.uint8)[..., ::-1]
    return np.concatenate([rgb, np.where(solid, 255, 0).astype(np.uint8)], 2).tobytes(), not solid.any()


SUMMED = ["row", "col", "x0", "y0", "width", "height", "rgba", "is_empty", "skipped", "bucket", "sums"]


def _sum_buckets(radius: int):
    """Of crops sorted by (row, col, bucket): each bucket's sums, packed, or the finished tile where it is the only bucket."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sums, skipped = None, np.zeros(0), 0

        def out() -> pd.DataFrame:
            row, col, bucket, buckets, x0, y0, h, w = now
            rgba, empty = _finished(sums) if buckets == 1 else (None, None)
            packed = None if buckets == 1 else zlib.compress(sums.tobytes(), 1)
            return pd.DataFrame([(row, col, x0, y0, w, h, rgba, empty, skipped, bucket, packed)], columns=SUMMED)

        for b in batches:
            for r in b.itertuples():
                key = (int(r.row), int(r.col), int(r.bucket), int(r.buckets), int(r.x0), int(r.y0), int(r.y1 - r.y0), int(r.x1 - r.x0))
                if key != now:
                    if now is not None:
                        yield out()
                    now, sums, skipped = key, np.zeros((*key[6:], 4), np.int64), 0
                if r.frame_id is not None and r.data is not None:
                    sums += _weighted(r, radius, *key[6:])
                else:
                    skipped += r.frame_id is not None
        if now is not None:
            yield out()

    return emit


def _add_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of packed sums sorted by (row, col): the finished tiles. One tile's sums are held at a time, however many buckets it has."""
    now, sums, skipped = None, np.zeros(0), 0

    def out() -> pd.DataFrame:
        return pd.DataFrame([(*now, *_finished(sums), skipped)], columns=SUMMED[:9])

    for b in batches:
        for r in b.itertuples():
            key = (int(r.row), int(r.col), int(r.x0), int(r.y0), int(r.width), int(r.height))
            if key != now:
                if now is not None:
                    yield out()
                now, sums, skipped = key, np.zeros((key[5], key[4], 4), np.int64), 0
            sums += np.frombuffer(zlib.decompress(r.sums), np.int64).reshape(sums.shape)
            skipped += int(r.skipped)
    if now is not None:
        yield out()


def reach(m: np.ndarray, tile: tuple[float, float, float, float], width: int, height: int, margin: int = 2) -> tuple[int, int, int, int]:
    """The part (left, top, right, bottom) of a frame that a tile (x0, y0, x1, y1) shows; the whole frame where the tile crosses the
    transform's horizon."""
    x0, y0, x1, y1 = tile
    at = np.linalg.inv(m) @ np.array([[x0, x1, x1, x0], [y0, y0, y1, y1], [1.0, 1.0, 1.0, 1.0]])
    if not (np.all(at[2] > 1e-12) or np.all(at[2] < -1e-12)):
        return 0, 0, width, height
    x, y = at[0] / at[2], at[1] / at[2]
    left, top = max(0, int(np.floor(x.min())) - margin), max(0, int(np.floor(y.min())) - margin)
    return left, top, max(left, min(width, int(np.ceil(x.max())) + margin)), max(top, min(height, int(np.ceil(y.max())) + margin))


CROP = "row long, col long, x0 long, y0 long, x1 long, y1 long, buckets int, bucket int, frame_id string, matrix array<double>, gain double, width int, height int, channels int, data binary"


def _crops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each frame and the tiles over it, the pixels that each tile shows, with the transform moved to them."""
    names = [c.split()[0] for c in CROP.split(", ")]
    for b in batches:
        for r in b.itertuples():
            image, m = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels), np.array(r.matrix).reshape(3, 3)
            for t in r.tiles:
                left, top, right, bottom = reach(m, (t["x0"], t["y0"], t["x1"], t["y1"]), r.width, r.height)
                if right > left and bottom > top:
                    moved = m @ np.array([[1, 0, left], [0, 1, top], [0, 0, 1.0]])
                    part = np.ascontiguousarray(image[top:bottom, left:right])
                    place = [t[c] for c in ("row", "col", "x0", "y0", "x1", "y1", "buckets", "bucket")]
                    yield pd.DataFrame([(*place, r.frame_id, moved.ravel().tolist(), r.gain, right - left, bottom - top, r.channels, part.tobytes())], columns=names)


TILE = "row long, col long, x0 long, y0 long, width long, height long, rgba binary, is_empty boolean, skipped int"


def compose_tiles(images: DataFrame, poses: DataFrame, size: int = 2048, radius: int = 25, gains: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The tiles of the mosaic (red first, with alpha), and the one row of its canvas.

    A frame goes to the tiles that its box touches and nowhere else, and of its pixels only those that the tile shows. The frames
    of a tile are summed BUCKET at a time, one after the other, in as many tasks as it has buckets, and the sums are added up; a
    task holds the sums of one tile. Feather weights are those of the mask cut to the tile.
    """
    known = poses.join(images.select("frame_id", "width", "height"), "frame_id").select("frame_id", "matrix", "width", "height")
    boxes = compose.frame_boxes(known)
    canvas = compose.canvas_of(boxes)
    grid = compose.tile_grid(canvas, size)
    over = compose.tile_frames(compose.shifted(boxes, canvas), size)
    corner = F.broadcast(canvas.select("min_x", "min_y"))
    m = lambda i: F.get("matrix", F.lit(i))
    moved = known.join(corner, F.lit(True)).select("frame_id", F.array(*(m(i) - (F.col("min_x") * m(6 + i) if i < 3 else F.col("min_y") * m(3 + i) if i < 6 else F.lit(0.0)) for i in range(9))).alias("matrix"))
    full = images.join(moved, "frame_id")
    full = full.join(gains.select("frame_id", "gain"), "frame_id", "left").withColumn("gain", F.coalesce("gain", F.lit(1.0))) if gains is not None else full.withColumn("gain", F.lit(1.0))
    hot = over.groupBy("row", "col").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("buckets")).filter("buckets > 1")
    dealt = grid.join(hot, ["row", "col"], "left").withColumn("buckets", F.coalesce("buckets", F.lit(1)))
    bucket = F.pmod(F.xxhash64("frame_id"), F.col("buckets")).cast("int").alias("bucket")
    place = ["row", "col", "x0", "y0", "x1", "y1", "buckets"]
    wanted = over.join(dealt, ["row", "col"]).groupBy("frame_id").agg(F.collect_list(F.struct(*place, bucket)).alias("tiles"))
    crops = full.join(wanted, "frame_id").select("frame_id", "matrix", "gain", "width", "height", "channels", "data", "tiles").mapInPandas(_crops, CROP)
    # A crop of no frame; numbers that were null would be floats in pandas.
    blank = [(F.lit(0) if kind in ("int", "double") else F.lit(None)).cast(kind).alias(name) for name, kind in (c.split() for c in CROP.split(", ")[8:])]
    every = crops.unionByName(dealt.select(*place, F.lit(0).alias("bucket"), *blank))  # so that tiles without frames are there, too
    key = ["row", "col", "bucket"]
    summed = every.repartition(*key).sortWithinPartitions(*key, "frame_id").mapInPandas(_sum_buckets(radius), f"{TILE}, bucket int, sums binary")
    names = SUMMED[:9]
    if hot.isEmpty():
        return summed.select(*names), canvas
    summed = cut(summed)
    added = summed.filter("sums IS NOT NULL").repartition("row", "col").sortWithinPartitions("row", "col").mapInPandas(_add_buckets, TILE)
    return summed.filter("sums IS NULL").select(*names).unionByName(added.select(*names)), canvas
