"""Layout of the canvas, overlap of tiles and frames, and blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import affine


def frame_boxes(frames: DataFrame) -> DataFrame:
    """(frame_id, x0, y0, x1, y1): the box of each frame's four projected corners; frames have matrix, width and height."""
    corners = F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((F.lit(0), F.lit(0)), (F.col("width"), F.lit(0)), (F.col("width"), F.col("height")), (F.lit(0), F.col("height")))))
    spread = frames.select("frame_id", "matrix", F.explode(corners).alias("c"))
    px, py = affine.project(F.col("matrix"), F.col("c.x"), F.col("c.y"))
    return spread.select("frame_id", px.alias("px"), py.alias("py")).groupBy("frame_id").agg(F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1"))


def canvas_of(boxes: DataFrame) -> DataFrame:
    """One row: the canvas around all boxes, its size in whole pixels."""
    one = boxes.agg(F.min("x0").alias("min_x"), F.min("y0").alias("min_y"), F.max("x1").alias("max_x"), F.max("y1").alias("max_y"))
    return one.withColumns({"width_px": F.ceil(F.col("max_x") - F.col("min_x")).cast("long"), "height_px": F.ceil(F.col("max_y") - F.col("min_y")).cast("long")})


def shifted(boxes: DataFrame, canvas: DataFrame) -> DataFrame:
    """Boxes with the canvas' corner as origin; the canvas is one row."""
    both = boxes.join(F.broadcast(canvas), F.lit(True))
    return both.select("frame_id", *((F.col(c) - F.col(f"min_{c[0]}")).alias(c) for c in ("x0", "y0", "x1", "y1")), "width_px", "height_px")


def tile_grid(canvas: DataFrame, size: int) -> DataFrame:
    """(row, col, x0, y0, x1, y1) of a canvas' tiles, those at the edges cut."""
    if size <= 0:
        raise ValueError("tile size must be positive")
    steps = lambda c: F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col(c) / size).cast("long") - 1, F.lit(0)))
    grid = canvas.filter("width_px > 0 AND height_px > 0").withColumn("row", F.explode(steps("height_px"))).withColumn("col", F.explode(steps("width_px")))
    return grid.select("row", "col", (F.col("col") * size).alias("x0"), (F.col("row") * size).alias("y0"), F.least((F.col("col") + 1) * size, F.col("width_px")).alias("x1"), F.least((F.col("row") + 1) * size, F.col("height_px")).alias("y1"))


def tile_frames(boxes: DataFrame, size: int) -> DataFrame:
    """(row, col, frame_id): frames whose shifted box touches the tile, edges included. Each box lists its tiles, so the
    rows made follow the overlap, not tiles times frames."""

    def span(lo: str, hi: str, extent: str) -> Column:
        last = F.greatest(F.ceil(F.col(extent) / size).cast("long") - 1, F.lit(0))
        first = F.greatest(F.lit(0).cast("long"), F.ceil(F.col(lo) / size).cast("long") - 1)
        return F.sequence(first, F.least(last, F.floor(F.col(hi) / size).cast("long")))

    inside = boxes.filter((F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x0") <= F.col("width_px")) & (F.col("y0") <= F.col("height_px")))
    return inside.withColumn("row", F.explode(span("y0", "y1", "height_px"))).withColumn("col", F.explode(span("x0", "x1", "width_px"))).select("row", "col", "frame_id")


def covered_tiles(grid: DataFrame, overlap: DataFrame) -> DataFrame:
    """The grid with the number of frames of each tile, and is_empty."""
    n = overlap.groupBy("row", "col").agg(F.count(F.lit(1)).alias("frames"))
    return grid.join(n, ["row", "col"], "left").withColumn("frames", F.coalesce("frames", F.lit(0))).withColumn("is_empty", F.col("frames") == 0)


def blend(pixels: DataFrame, keys: list[str], bands: list[str], weight: str = "weight", nodata: int = 0) -> DataFrame:
    """The weighted mean of each pixel, cut to whole numbers from 0 to 255, and alpha; next to no weight gives nodata."""
    sums = pixels.groupBy(*keys).agg(F.sum(weight).alias("__w"), *(F.sum(F.col(b) * F.col(weight)).alias(b) for b in bands))
    solid = F.col("__w") > 1e-4
    value = lambda b: F.when(solid, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(b) / F.col("__w"))))).otherwise(nodata).cast("int")
    return sums.select(*keys, *(value(b).alias(b) for b in bands), F.when(solid, 255).otherwise(0).alias("alpha"))


def halve(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """The next overview: means of two by two pixels, and their x and y."""
    return pixels.groupBy(F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(*(F.floor(F.avg(b)).cast("int").alias(b) for b in bands))
