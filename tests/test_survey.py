import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralign import pipeline
from terralign.cli import compare, verify
from terralign.config import build_config
from terralign.service import Projects
from terralign.sinks import raster
from terralign.sources import images
from terralign.streaming import settle

from .survey import exif, flight, png_with


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("flight")
    flight(where)
    return where


def test_frames_are_read(spark, folder):
    rows = images.read_frames(spark, str(folder)).orderBy("path").collect()
    assert len(rows) == 6 and all(r.reason is None for r in rows)
    first = rows[0]
    assert first.frame_id == "frame_001" and first.lat == pytest.approx(34.0522, abs=1e-6) and first.lon == pytest.approx(-118.2437, abs=1e-6)
    assert (first.altitude, first.focal_length, first.focal_length_35mm, first.camera_model, first.width, first.height, first.pitch) == (60.0, 4.5, 24.0, "Camera-2000", 320, 240, -90.0)
    planned = pipeline.plan_frames(images.read_frames(spark, str(folder))).collect()
    assert all(r.epsg == 32611 and 0.01 <= r.gsd <= 0.5 and r.yaw is not None for r in planned)
    assert planned[0].gsd == pytest.approx(60 * 36 / (24 * 320))


def test_bad_files_have_reasons(spark, tmp_path):
    (tmp_path / "bad.jpg").write_bytes(b"NOT_AN_IMAGE")
    (tmp_path / "plain.png").write_bytes(png_with(np.zeros((4, 4, 3), np.uint8)))
    (tmp_path / "ahead.png").write_bytes(png_with(np.zeros((4, 4, 3), np.uint8), exif(1.0, 2.0), 'GimbalPitchDegree="-10.0"'))
    (tmp_path / "notes.txt").write_text("x")
    frames = images.read_frames(spark, str(tmp_path))
    assert {r.frame_id: r.rejection_reason for r in images.folder_report(frames).collect()} == {"bad": "unreadable_file", "plain": "no_gps_metadata", "ahead": None}
    assert frames.filter("frame_id = 'ahead'").first().reason == "Non-nadir gimbal pitch (-10.0° > -45.0°)"
    assert images.read_frames(spark, str(tmp_path / "nowhere")).count() == 0
    found = verify(spark, str(tmp_path))
    assert (found["total_found"], found["accepted"], found["more"]) == (3, 0, 0) and len(found["rejections"]) == 3
    with pytest.raises(ValueError):
        pipeline.run(spark, str(tmp_path), str(tmp_path / "out"))


def test_run_writes_all_products(spark, folder, tmp_path):
    out, events = tmp_path / "out", []
    config = build_config("laptop", "fast", {"matcher": "orb", "transform_model": "affine", "tile_size": 256})
    summary = pipeline.run(spark, str(folder), str(out), config, events.append)
    assert (summary.frames_accepted, summary.frames_rejected) == (6, 0) and summary.mean_reprojection_error < 3 and summary.total_inliers_found > 100
    content = (out / "orthomosaic.tif").read_bytes()
    head = raster.read_header(content)
    assert head["epsg"] == 32611 and head["bands"] == 4 and head["width"] > 200 and head["height"] > 200
    assert raster.read_header((out / "orthomosaic_cog.tif").read_bytes())["overviews"] >= 2
    image = raster.read_pixels(content)
    assert (image[..., 3] == 255).mean() > 0.8 and 60 < image[..., :3][image[..., 3] == 255].mean() < 190
    manifest = json.loads((out / "manifest.json").read_text())
    assert manifest["tiles"]["tile_count"] == len(list((out / "tiles").rglob("*.png"))) > 0
    assert [e["event"] for e in events][0] == "first_tile" and events[-1]["bytes"] == len(content)
    for name in ("poses.json", "pair_transforms.json", "canvas.json", "metrics.json", "report.md", "metrics.csv", "mosaic.jpg", "raster_manifest.json", "phase2_manifest.json"):
        assert (out / name).exists()
    assert (out / "mosaic.jpg").read_bytes()[:2] == b"\xff\xd8" and json.loads((out / "phase2_manifest.json").read_text())["contract"]["canvas"] == "canvas.json"
    poses = {p["frame_id"]: p for p in json.loads((out / "poses.json").read_text())["poses"]}
    assert poses["frame_002"]["x"] - poses["frame_001"]["x"] == pytest.approx(128, abs=6) and poses["frame_004"]["y"] - poses["frame_001"]["y"] == pytest.approx(96, abs=6)


def test_models_are_compared(spark, folder):
    rows = compare(spark, str(folder), "orb")
    assert rows and {r["winner"] for r in rows} <= {"affine", "homography", "neither"}


def test_contract_canvas_is_rendered(spark):
    class Canvas:
        width, height = 64, 48

    def render(x, y, w, h):
        return np.full((4, h, w), 255, np.uint8)

    tiles = pipeline.render_canvas(spark, Canvas, render, 32)
    assert tiles.count() == 4
    events = list(pipeline.events_of(tiles, "x.tif", 9))
    assert [e["event"] for e in events] == ["first_tile", "tile_written", "tile_written", "tile_written", "final_output"]
    with pytest.raises(Exception, match="the renderer returned"):
        pipeline.render_canvas(spark, Canvas, lambda x, y, w, h: np.zeros((3, h, w), np.uint8), 32).collect()


def test_tiles_are_rendered_from_sql(spark):
    from terralign.operators import render

    spark.udtf.register("render_tile", render.tile_function(lambda x, y, w, h: np.full((4, h, w), x % 7, np.uint8)))
    grid = "VALUES (0L, 0L, 0L, 0L, 4L, 3L), (0L, 1L, 4L, 0L, 6L, 3L) AS g(row, col, x0, y0, x1, y1)"
    got = spark.sql(f"SELECT t.* FROM {grid}, LATERAL render_tile(g.row, g.col, g.x0, g.y0, g.x1, g.y1) t ORDER BY col").collect()
    assert [(r.col, r.width, r.height, bytes(r.rgba), r.is_empty) for r in got] == [(0, 4, 3, bytes(48), True), (1, 2, 3, b"\x04" * 24, False)]
    with pytest.raises(Exception, match="x0 must be a whole number, not string"):
        spark.sql("SELECT * FROM render_tile(0L, 0L, 'a', 0L, 1L, 1L)")


def test_watch_fires_once_per_pause(spark, tmp_path):
    (tmp_path / "in").mkdir()
    flight(tmp_path / "in", 1, 2)
    import time

    end, runs = time.monotonic() + 12, []
    jobs = settle.watch(spark, str(tmp_path / "in"), runs.append, str(tmp_path / "state"), settle_seconds=2, poll_seconds=0.5, until=lambda: time.monotonic() > end)
    assert jobs == 1 and runs == [2]


def test_projects(spark, tmp_path):
    projects = Projects(spark, str(tmp_path / "projects"))
    assert projects.list() == []
    one = projects.create("first")
    flight(tmp_path, 1, 2)
    for p in sorted(tmp_path.glob("*.png")):
        projects.upload(one["id"], f"../up/{p.name}", p.read_bytes())
    assert projects.ingest(one["id"])["accepted"] == 2 and projects.get(one["id"])["status"] == "ready_for_processing"
    assert len(projects.gps(one["id"])) == 2 and [p["id"] for p in projects.list()] == [one["id"]]
    assert projects.state(one["id"]) is None and projects.product(one["id"]) is None
    assert projects.delete(one["id"]) and projects.get(one["id"]) is None
    with pytest.raises(ValueError):
        projects.get("../elsewhere")


def test_streamed_tiles_are_labelled(spark, tmp_path):
    from pyspark.sql import Row

    spark.createDataFrame([Row(run="a", tile=i) for i in range(3)] + [Row(run="b", tile=9)]).write.parquet(str(tmp_path / "tiles"))
    stream = spark.readStream.schema("run string, tile long").parquet(str(tmp_path / "tiles"))
    query = settle.first_events(stream).writeStream.format("memory").queryName("labels").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("labels").groupBy("run", "event").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {(r["run"], r.event): r.n for r in rows} == {("a", "first_tile"): 1, ("a", "tile_written"): 2, ("b", "first_tile"): 1}


def test_events_come_in_order_over_batches_and_a_restart(spark, tmp_path):
    def tile(run, k):
        return (run, k, "tile", k // 3, k % 3, 8, 8, None, None)

    parts = [[tile("a", 2), tile("b", 1), tile("a", 0)], [tile("a", 3), tile("b", 0), tile("a", 0)], [("a", 5, "end", None, None, None, None, "a.tif", 77), tile("b", 2)], [tile("a", 4), tile("a", 1)], [tile("a", 9), tile("a", 1), ("b", 3, "end", None, None, None, None, "b.tif", 9)]]
    for half in (parts[:3], parts[3:]):  # the second query goes on from the first one's state
        for rows in half:
            spark.createDataFrame(rows, settle.TILES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(settle.TILES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        settle.protocol(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("run", "seq").collect()
    assert [(r.run, r.seq, r.event) for r in got] == [(run, k, "first_tile" if k == 0 else "final_output" if k == n else "tile_written") for run, n in (("a", 5), ("b", 3)) for k in range(n + 1)]
    assert all((r.path, r.bytes) == ("a.tif", 77) and r.row is None for r in got if r.run == "a" and r.seq == 5) and all((r.row, r.col, r.width) == (r.seq // 3, r.seq % 3, 8) for r in got if r.event != "final_output")


def test_turned_frames_are_read_upright(spark, tmp_path):
    image = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    (tmp_path / "a.png").write_bytes(png_with(image))
    (tmp_path / "b.PNG").write_bytes(png_with(image))
    (tmp_path / "c.txt").write_text("no image")
    frames = spark.createDataFrame([("a", 6), ("b", 1)], "frame_id string, orientation int")
    got = {r.frame_id: r for r in images.upright(images.read_pixels(spark, str(tmp_path)), frames).collect()}
    one, two = (np.frombuffer(got[f].data, np.uint8).reshape(got[f].height, got[f].width, 3) for f in "ab")
    assert one.shape == (6, 4, 3) and np.array_equal(one, np.rot90(two, -1))
