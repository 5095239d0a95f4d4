"""Tiles whose frames are summed in buckets, against all frames at once."""

import numpy as np
import pytest

from terralign.functions import pixels
from terralign.operators import compose, mosaic


def survey(spark, n=14, size=(40, 30)):
    """Frames that crowd on one corner, and one far away, so that tiles between are empty."""
    rng = np.random.default_rng(5)
    w, h = size
    rows, poses = [], []
    for i in range(n):
        image = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        turn = rng.normal(0, 0.05)
        x, y = (150.0, 100.0) if i == n - 1 else rng.uniform(0, 25, 2)
        m = [np.cos(turn), -np.sin(turn), x, np.sin(turn), np.cos(turn), y, 0.0, 0.0, 1.0]
        rows.append((f"f{i:02d}", w, h, 3, bytearray(image.tobytes())))
        poses.append((f"f{i:02d}", [float(v) for v in m]))
    rows.append(("f99", w, h, 3, None))
    poses.append(("f99", [1.0, 0.0, 3.0, 0.0, 1.0, 3.0, 0.0, 0.0, 1.0]))
    images = spark.createDataFrame(rows, "frame_id string, width int, height int, channels int, data binary").repartition(3)
    return rows, poses, images, spark.createDataFrame(poses, "frame_id string, matrix array<double>")


def brute(rows, poses, box, tile, radius):
    """A tile of the canvas by float64 sums over all frames."""
    x0, y0, w, h = tile
    color, total = np.zeros((h, w, 3)), np.zeros((h, w))
    for (_, fw, fh, _, data), (_, m) in zip(rows, poses, strict=True):
        if data is not None:
            moved = np.array([[1, 0, -box.min_x - x0], [0, 1, -box.min_y - y0], [0, 0, 1.0]]) @ np.array(m).reshape(3, 3)
            part, mask = pixels.warp(np.frombuffer(bytes(data), np.uint8).reshape(fh, fw, 3), moved, h, w)
            weight = pixels.feather_weights(mask, radius) * mask
            color, total = color + part * weight[..., None].astype(float), total + weight
    return np.where(total[..., None] > 1e-4, color / np.maximum(total, 1e-4)[..., None], 0)[..., ::-1], total > 1e-4


@pytest.mark.parametrize("bucket", [64, 3, 1])
def test_buckets_give_the_same_bytes(spark, monkeypatch, bucket):
    rows, poses, images, placed = survey(spark)
    images = images.filter("data IS NOT NULL")
    whole = {(r.row, r.col): r for r in mosaic.compose_tiles(images, placed, 32, 6)[0].collect()}
    monkeypatch.setattr(mosaic, "BUCKET", bucket)
    tiles, canvas = mosaic.compose_tiles(images, placed, 32, 6)
    box, got = compose.canvas_of(compose.frame_boxes(placed.join(images.select("frame_id", "width", "height"), "frame_id"))).first(), tiles.collect()
    assert len(got) == len(whole) == -(-box.width_px // 32) * -(-box.height_px // 32) and any(r.is_empty for r in got)
    for r in got:
        assert bytes(r.rgba) == bytes(whole[r.row, r.col].rgba) and (r.width, r.height, r.is_empty, r.skipped) == tuple(whole[r.row, r.col][c] for c in ("width", "height", "is_empty", "skipped"))
        image = np.frombuffer(r.rgba, np.uint8).reshape(r.height, r.width, 4)
        want, solid = brute(rows, poses, box, (r.x0, r.y0, r.width, r.height), 6)
        assert np.array_equal(image[..., 3] == 255, solid) and r.is_empty == (not solid.any())
        assert np.abs(image[..., :3].astype(float) - np.floor(want + 1e-9)).max(initial=0) <= 1


def test_a_hot_tile_is_summed_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(mosaic, "BUCKET", 3)
    _, _, images, placed = survey(spark, 40)
    summed = []
    monkeypatch.setattr(mosaic, "cut", lambda df: summed.append(df.checkpoint()) or summed[-1])
    tiles, _ = mosaic.compose_tiles(images.filter("data IS NOT NULL"), placed, 64, 6)
    assert tiles.count() == tiles.select("row", "col").distinct().count()
    parts = summed[0].filter("row = 0 AND col = 0").collect()
    assert len(parts) >= 8 and all(p.sums is not None and p.rgba is None for p in parts)
