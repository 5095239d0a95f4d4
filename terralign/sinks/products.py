"""The mosaic as TIFF and web-map tiles, coded on executors from the tiles of a canvas."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import ordered
from . import files, raster, writers


def coded_blocks(tiles: DataFrame, tile: int, block: int) -> DataFrame:
    """(y, x, data): the coded blocks of all tiles, in block numbers of the canvas; tile is a multiple of block."""
    if tile % block:
        raise ValueError("the tile size must be a multiple of the block size")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                image = np.frombuffer(r.rgba, np.uint8).reshape(r.height, r.width, 4)
                rows = [((r.y0 + y) // block, (r.x0 + x) // block, raster.encode_block(image[y : y + block, x : x + block], block)) for y in range(0, r.height, block) for x in range(0, r.width, block)]
                yield pd.DataFrame(rows, columns=["y", "x", "data"])

    return tiles.mapInPandas(emit, "y long, x long, data binary")


def write_raster(levels: list[tuple[DataFrame, int, int]], path: str, tile: int, block: int, epsg: int, left: float, top: float, pixel: float, big: bool | None = None) -> int:
    """Writes levels (tiles, width, height), the first the image, as one TIFF of tiles, and gives its size.

    Executors code the blocks and write them where a running sum over their sizes says. The driver writes the directories, for
    which it holds a size for each block (some 4 bytes for 512 by 512 pixels), and no pixels.
    """
    spark, key = levels[0][0].sparkSession, ["level", "y", "x"]
    coded = [coded_blocks(tiles, tile, block).withColumn("level", F.lit(i)) for i, (tiles, _, _) in enumerate(levels)]
    blocks = ordered.dealt(reduce(DataFrame.unionByName, coded).withColumn("size", F.length("data").cast("long")), [], key)
    sizes = blocks.select(*key, "size").toArrow().sort_by([(c, "ascending") for c in key])
    of, size = sizes.column("level").to_numpy(), sizes.column("size").to_numpy()
    facts = [{"width": w, "height": h, "bands": 4, "block": block, "counts": size[of == i].tolist()} for i, (_, w, h) in enumerate(levels)]
    for x in facts:
        if len(x["counts"]) != math.ceil(x["width"] / block) * math.ceil(x["height"] / block):
            raise ValueError("the tiles don't cover the canvas once")
    head = raster.header(facts, epsg, left, top, pixel, big=big)
    placed = ordered.running(blocks, [], key, F.col("size"), "end").withColumn("at", F.col("end") - F.col("size") + len(head))
    writers.write_blocks(placed, head, path, len(head) + int(size.sum()))
    return files.size(spark, path)


def halved(tiles: DataFrame, tile: int) -> DataFrame:
    """The tiles of the next overview: each from the four tiles below it, joined by their place."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        row, col = int(first.row) // 2, int(first.col) // 2
        h = int((pdf.y0 + pdf.height).max()) - row * 2 * tile
        w = int((pdf.x0 + pdf.width).max()) - col * 2 * tile
        whole = np.zeros((h, w, 4), np.uint8)
        for r in pdf.itertuples():
            y, x = int(r.y0) - row * 2 * tile, int(r.x0) - col * 2 * tile
            whole[y : y + r.height, x : x + r.width] = np.frombuffer(r.rgba, np.uint8).reshape(r.height, r.width, 4)
        small = raster.overview(whole)
        return pd.DataFrame([(row, col, col * tile, row * tile, small.shape[1], small.shape[0], small.tobytes())], columns=["row", "col", "x0", "y0", "width", "height", "rgba"])

    return tiles.groupBy(F.floor(F.col("row") / 2), F.floor(F.col("col") / 2)).applyInPandas(merge, "row long, col long, x0 long, y0 long, width long, height long, rgba binary").filter("width > 0 AND height > 0")


def picture(tiles: DataFrame, width: int, height: int) -> np.ndarray:
    """Tiles as one image (height, width, 4) on the driver: for previews, whose size the caller bounds."""
    out = np.zeros((height, width, 4), np.uint8)
    for r in tiles.select("x0", "y0", "width", "height", "rgba").toLocalIterator():
        h, w = min(r.height, height - r.y0), min(r.width, width - r.x0)
        if h > 0 and w > 0:
            out[r.y0 : r.y0 + h, r.x0 : r.x0 + w] = np.frombuffer(r.rgba, np.uint8).reshape(r.height, r.width, 4)[:h, :w]
    return out


def to_utm(lat: np.ndarray, lon: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    """geo.to_utm for arrays."""
    south = epsg >= 32700
    phi, lam = np.radians(lat), np.radians(lon - ((epsg - (32700 if south else 32600)) * 6 - 183))
    t = np.sinh(np.arctanh(np.sin(phi)) - geo._ECC * np.arctanh(geo._ECC * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    east = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(geo._ALPHA, 1))
    north = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(geo._ALPHA, 1))
    return geo.UTM_E0 + geo.UTM_K0 * geo._A * east, (geo.UTM_N0 if south else 0.0) + geo.UTM_K0 * geo._A * north


def _to_pixels(lat: np.ndarray, lon: np.ndarray, at: dict) -> tuple[np.ndarray, np.ndarray]:
    x, y = (lon, lat) if at["epsg"] == 4326 else to_utm(lat, lon, at["epsg"])
    return (x - at["left"]) / at["pixel"], (at["top"] - y) / at["pixel"]


def web_tiles(tiles: DataFrame, at: dict, zooms: range, size: int = 256, smooth: bool = True, keep_empty: bool = False) -> DataFrame:
    """(z, x, y, png): web-map tiles of a canvas. at: left, top, pixel, width, height, epsg, tile and bounds (W, S, E, N).

    Each web tile finds the canvas tiles under it by their numbers, so each task holds one web tile and what lies under it.
    """
    if not zooms or zooms[0] < 0 or size <= 0:
        raise ValueError("the zoom range is empty or negative")
    spark, (west, south, east, north) = tiles.sparkSession, at["bounds"]
    zoom = spark.range(zooms[0], zooms[-1] + 1).select(F.col("id").cast("int").alias("z"))
    x0, y0 = geo.clamped_tile(F.lit(north), F.lit(west), F.col("z"))
    x1, y1 = geo.clamped_tile(F.lit(south), F.lit(east), F.col("z"))
    grid = zoom.select("z", F.sequence(y0, y1).alias("ys"), F.explode(F.sequence(x0, x1)).alias("x")).select("z", "x", F.explode("ys").alias("y"))

    def under(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Which canvas tiles lie under each web tile, from points along its edges."""
        for b in batches:
            rows = []
            for r in b.itertuples():
                n = 2.0**r.z
                k = np.linspace(0, 1, 5)
                lon = (r.x + k) / n * 360 - 180
                lat = np.degrees(np.arctan(np.sinh(math.pi * (1 - 2 * (r.y + k) / n))))
                px, py = _to_pixels(*np.meshgrid(lat, lon, indexing="ij"), at)
                c0, c1 = max(0, math.floor((px.min() - 2) / at["tile"])), min((at["width"] - 1) // at["tile"], math.floor((px.max() + 2) / at["tile"]))
                r0, r1 = max(0, math.floor((py.min() - 2) / at["tile"])), min((at["height"] - 1) // at["tile"], math.floor((py.max() + 2) / at["tile"]))
                rows += [(r.z, r.x, r.y, row, col) for row in range(r0, r1 + 1) for col in range(c0, c1 + 1)] or [(r.z, r.x, r.y, -1, -1)]
            yield pd.DataFrame(rows, columns=["z", "x", "y", "row", "col"])

    def render(pdf: pd.DataFrame) -> pd.DataFrame:
        z, x, y = (int(pdf[c].iloc[0]) for c in ("z", "x", "y"))
        n = 2.0**z
        k = (np.arange(size) + 0.5) / size
        lon = (x + k) / n * 360 - 180
        lat = np.degrees(np.arctan(np.sinh(math.pi * (1 - 2 * (y + k) / n))))
        px, py = _to_pixels(*np.meshgrid(lat, lon, indexing="ij"), at)
        px, py = px - 0.5, py - 0.5
        here = pdf[pdf["rgba"].notna()]
        out = np.zeros((size, size, 4), np.uint8)
        if len(here):
            left, top = int(here["x0"].min()), int(here["y0"].min())
            whole = np.zeros((int((here["y0"] + here["height"]).max()) - top + 1, int((here["x0"] + here["width"]).max()) - left + 1, 4), np.uint8)
            for r in here.itertuples():
                a, b = int(r.y0) - top, int(r.x0) - left
                whole[a : a + int(r.height), b : b + int(r.width)] = np.frombuffer(r.rgba, np.uint8).reshape(int(r.height), int(r.width), 4)
            px, py = px - left, py - top
            inside = (px > -0.5) & (py > -0.5) & (px < whole.shape[1] - 1.5) & (py < whole.shape[0] - 1.5)
            if smooth:
                px, py = np.clip(px, 0, whole.shape[1] - 2), np.clip(py, 0, whole.shape[0] - 2)
                xa, ya = np.floor(px).astype(int), np.floor(py).astype(int)
                fx, fy = (px - xa)[..., None], (py - ya)[..., None]
                value = whole[ya, xa] * (1 - fx) * (1 - fy) + whole[ya, xa + 1] * fx * (1 - fy) + whole[ya + 1, xa] * (1 - fx) * fy + whole[ya + 1, xa + 1] * fx * fy
                out = np.rint(value).astype(np.uint8)
            else:
                out = whole[np.clip(np.rint(py).astype(int), 0, whole.shape[0] - 1), np.clip(np.rint(px).astype(int), 0, whole.shape[1] - 1)].copy()
            out[~inside] = 0
        if not keep_empty and not out[..., 3].any():
            return pd.DataFrame([], columns=["z", "x", "y", "png"])
        return pd.DataFrame([(z, x, y, raster.png(out))], columns=["z", "x", "y", "png"])

    need = grid.mapInPandas(under, "z int, x long, y long, row long, col long")
    return need.join(tiles.select("row", "col", "x0", "y0", "width", "height", "rgba"), ["row", "col"], "left").groupBy("z", "x", "y").applyInPandas(render, "z int, x long, y long, png binary")


def tile_json(name: str, bounds: tuple[float, float, float, float], zooms: range) -> dict:
    w, s, e, n = bounds
    return {"tilejson": "2.2.0", "name": name, "scheme": "xyz", "tiles": ["{z}/{x}/{y}.png"], "minzoom": zooms[0], "maxzoom": zooms[-1], "bounds": [w, s, e, n], "center": [(w + e) / 2, (s + n) / 2, zooms[-1]]}
