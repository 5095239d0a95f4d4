import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terralign import config, monitor, report, session
from terralign.config import build_config
from terralign.functions import affine, geo, pixels
from terralign.functions import frames as fr
from terralign.monitor import EventLog
from terralign.operators import matching, placement
from terralign.sinks import raster
from terralign.sources import checkpoints, contracts, images

from . import reference_solver


def value(spark, *columns):
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
    return row[0] if len(columns) == 1 else tuple(row)


def lits(*numbers):
    return [F.lit(float(n)) for n in numbers]


def test_distances(spark):
    assert value(spark, geo.haversine_m(*lits(51.5, -0.1, 51.5, -0.1))) == pytest.approx(0, abs=0.01)
    there, back = value(spark, geo.haversine_m(*lits(51.5074, -0.1278, 48.8566, 2.3522)), geo.haversine_m(*lits(48.8566, 2.3522, 51.5074, -0.1278)))
    assert 330e3 < there < 350e3 and there == pytest.approx(back)


def test_utm(spark):
    assert value(spark, geo.utm_epsg(*lits(19, 73)), geo.utm_epsg(*lits(-33, 151)), geo.utm_epsg(*lits(0, 180))) == (32643, 32756, 32660)
    # the tower in Toronto, a published position
    east, north = value(spark, *geo.to_utm(*lits(43.642567, -79.387139), F.lit(32617)))
    assert east == pytest.approx(630_084, abs=1) and north == pytest.approx(4_833_439, abs=1)
    for lat, lon in ((43.642567, -79.387139), (-33.9, 151.2), (0.001, 3.0)):
        epsg = geo.utm_epsg(*lits(lat, lon))
        found = value(spark, *geo.from_utm(*geo.to_utm(*lits(lat, lon), epsg), epsg))
        assert found == (pytest.approx(lat, abs=1e-8), pytest.approx(lon, abs=1e-8))


def test_tiles(spark):
    assert value(spark, *geo.slippy_tile(*lits(34.0522, -118.2437), F.lit(12))) == (702, 1635)
    b = geo.tile_bounds(F.lit(702), F.lit(1635), F.lit(12))
    w, s, e, n = value(spark, b["west"], b["south"], b["east"], b["north"])
    assert w < -118.2437 < e and s < 34.0522 < n
    assert value(spark, *geo.clamped_tile(*lits(89.9, 200), F.lit(3))) == (7, 0)
    assert value(spark, *geo.zoom_range(F.lit(0.14))) == (18, 19)


def test_frames(spark):
    assert value(spark, fr.ground_resolution(*lits(60), F.lit(24.0), F.lit(4.5), F.lit(640))) == pytest.approx(0.140625)
    none = F.lit(None).cast("double")
    assert value(spark, fr.ground_resolution(F.lit(1.0), none, none, F.lit(10))) == pytest.approx(5 * 6.17 / (4.5 * 100))
    assert value(spark, fr.transfer_seconds(F.lit(10_000_000), F.lit(1.0)), fr.transfer_seconds(F.lit(5), F.lit(0.0))) == (80.0, 0.0)
    assert value(spark, *(fr.format_seconds(F.lit(x)) for x in (5.04, 754.9, 3900.0))) == ("5.0s", "12m 34s", "1h 05m")
    assert [report.spoken(x) for x in (5.04, 754.9, 3900.0)] == ["5.0s", "12m 34s", "1h 05m"]
    assert value(spark, *(fr.number(F.lit(x)) for x in (" 1.5e1 ", "1d", "", "abc", "-.5"))) == (15.0, None, None, None, -0.5)
    assert value(spark, fr.stem(F.lit("/a/b.c/x.y.jpg")), fr.stem(F.lit(".hidden")), fr.first_filled(F.lit(""), F.lit("2"))) == ("x.y", ".hidden", "2")
    assert value(spark, fr.exposure_gain(F.lit(50.0)), fr.exposure_gain(F.lit(200.0)), fr.exposure_gain(F.lit(5.0))) == (1.25, 0.8, 1.0)


def test_sanity_of_transforms(spark):
    turn = math.radians(85)
    cases = [(affine.IDENTITY, True), ((3.5, 0, 0, 0, 3.5, 0, 0, 0, 1), False), ((math.cos(turn), -math.sin(turn), 0, math.sin(turn), math.cos(turn), 0, 0, 0, 1), False), ((1, 0, 2000, 0, 1, 0, 0, 0, 1), False), ((0.01, 0, 0, 0, 1, 0, 0, 0, 1), False)]
    assert [value(spark, affine.is_sane(affine.matrix(*m), F.lit(500), F.lit(400))) for m, _ in cases] == [ok for _, ok in cases]
    m = affine.multiply(affine.shift(F.lit(3.0), F.lit(4.0)), affine.matrix(*affine.IDENTITY))
    assert value(spark, *affine.project(m, *lits(1, 2))) == (4.0, 6.0)


@pytest.mark.parametrize("model", list(matching.SAMPLE))
def test_robust_fit(model):
    rng = np.random.default_rng(99)
    src = rng.uniform(50, 400, (40, 2))
    dst = src + [10, 5]
    dst[:15] += rng.uniform(100, 300, (15, 2))
    m, inside = matching.robust_fit(model, src, dst, 4.0)
    assert inside[15:].all() and not inside[:15].any()
    assert np.allclose(m, [[1, 0, 10], [0, 1, 5], [0, 0, 1]], atol=1e-6)


@pytest.mark.parametrize("kind", list(pixels.DETECTORS))
def test_features_find_a_shift(kind):
    ground = np.kron(np.random.default_rng(42).integers(0, 255, (90, 110, 3)), np.ones((6, 6, 1))).astype(np.uint8)
    (p, a), (q, b) = (pixels.features(x, kind) for x in (ground[:400, :500], ground[15:415, 25:525]))
    i, j = pixels.ratio_matches(a, b, 0.8)
    m, inside = matching.robust_fit("affine", p[i], q[j], 3.0)
    assert len(p) > 20 and inside.sum() >= 12 and np.allclose(m[:2, 2], [-25, -15], atol=2)
    assert len(pixels.features(np.zeros((200, 300, 3), np.uint8), kind)[0]) == 0


def test_pixels():
    mask = np.zeros((100, 100), bool)
    mask[20:80, 20:80] = True
    w = pixels.feather_weights(mask, 10)
    assert w[0, 0] == 0 and w[50, 50] == 1 and 0 < w[21, 50] < 1 and not pixels.feather_weights(mask & False, 10).any()
    image = np.arange(24, dtype=np.uint8).reshape(4, 6)
    assert all(pixels.orient(image, o).shape == ((6, 4) if o >= 5 else (4, 6)) for o in range(1, 9))
    assert np.array_equal(pixels.orient(pixels.orient(image, 6), 8), image)
    assert np.allclose(pixels.resize_area(np.full((30, 50), 7.0), 11, 17), 7)
    moved, mask = pixels.warp(np.full((10, 10, 3), 200, np.uint8), np.array([[1, 0, 5], [0, 1, 0], [0, 0, 1.0]]), 10, 20)
    assert mask.sum() == 100 and (moved[:, 5:15] == 200).all() and not moved[:, :5].any()


def test_rasters():
    with pytest.raises(ValueError):
        raster.geotiff(np.zeros((8, 8, 2), np.uint8), 32643, 0, 0, 1)
    with pytest.raises(ValueError):
        raster.geotiff(np.zeros((3, 3, 3), np.uint8), 32643, 0, 0, 1, overviews=True)
    head = raster.read_header(raster.geotiff(np.ones((512, 512, 3), np.uint8), 32643, 500000, 2100000, 1.0, overviews=True))
    assert head["bounds"] == (500000, 2099488, 500512, 2100000) and head["overviews"] == 4 and head["epsg"] == 32643 and head["nodata"] == "0"


def test_contracts(spark, tmp_path):
    (tmp_path / "poses.json").write_text('{"poses": [{"frame_id": "a", "x": 1, "y": 2}, {"frame_id": "b", "x": 1, "y": 2, "dropped": true}]}')
    rows = contracts.read_poses(spark, str(tmp_path / "poses.json")).collect()
    assert [(r.frame_id, r.scale, r.rotation, r.confidence) for r in rows] == [("a", 1.0, 0.0, 0.0)]
    (tmp_path / "bare.json").write_text('[{"frame_id": "a", "x": 1, "y": 2}]')
    assert contracts.read_poses(spark, str(tmp_path / "bare.json")).count() == 1
    (tmp_path / "none.json").write_text('{"poses": []}')
    with pytest.raises(ValueError):
        contracts.read_poses(spark, str(tmp_path / "none.json"))
    (tmp_path / "canvas.json").write_text('{"crs": "EPSG:32643", "left": 0, "top": 0}')
    with pytest.raises(Exception, match="missing required field"):
        contracts.read_canvas(spark, str(tmp_path / "canvas.json")).collect()
    (tmp_path / "meta.csv").write_text("﻿SourceFile,GPSLatitude,GPSLongitude,GPSAltitude,Model\na.JPG,19.1,73.1,100,A\nb.JPG,,,,\n")
    found = contracts.audit_csv(spark, str(tmp_path / "meta.csv"), "d", "u")
    assert (found["total_files"], found["gps_files"], found["files_without_gps"], found["status"], found["camera_models"]) == (2, 1, 1, "accepted_with_limitations", ["A"])


def test_settings():
    c = build_config("jetson-class", "fast", {"matcher": None, "tile_size": 512})
    assert (c.matcher, c.tile_size, c.max_cpus, c.ransac_thresh_px, c.min_inliers) == ("orb", 512, 6, 5.0, 15)
    with pytest.warns(UserWarning):
        build_config(overrides={"nothing": 1})


def test_event_bridge():
    bridge = EventLog("r", "d", interval=0.05)
    with pytest.raises(RuntimeError):
        bridge.handle({"event": "first_tile"})
    bridge.start()
    for e in ("first_tile", "tile_written", "final_output"):
        bridge.handle({"event": e})
    s = bridge.finalize(1000, 200, 150)
    assert s.bandwidth_reduction_factor == 1000 / 150 and s.time_to_first_tile_seconds is not None and s.metadata["tile_events"] == "3"
    assert "Reduction" in report.markdown(s)
    with pytest.raises(RuntimeError):
        bridge.start()


def test_levels_have_no_limit(spark):
    checkpoints.use_checkpoints(spark)
    path = spark.range(80).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = path.unionByName(spark.createDataFrame([(500, 501), (3, 1)], "a long, b long")).withColumn("g", F.lit("x"))
    got = placement.levels(edges, spark.range(1).select(F.lit("x").alias("g"), F.col("id").alias("node")))
    assert {(r.node, r.level) for r in got.collect()} == {(0, 0), (1, 1), (2, 2)} | {(i, i - 1) for i in range(3, 81)}


def test_settings_from_files(tmp_path):
    (tmp_path / "my_machine.yaml").write_text("# bounds\nmax_cpus: 3\nmatcher: 'orb'  # fast\nmultiband_blending: True\ntile_min_zoom: ~\n")
    c = build_config("my-machine", "quality", profiles_dir=str(tmp_path))
    assert (c.max_cpus, c.matcher, c.multiband_blending, c.tile_min_zoom, c.feature_limit) == (3, "sift", True, None, 3000)
    assert config.read_settings(str(tmp_path / "none.yaml")) == {}


def test_summary_names():
    found = json.loads(monitor.RunSummary("r").to_json())
    assert list(found)[:2] == ["run_id", "profile"] and {"total_matches_evaluated", "total_inliers_found"} <= set(found)
    with pytest.raises(TypeError):
        monitor.RunSummary("r", nothing=1)


def test_event_log_as_rows(spark, tmp_path):
    log = EventLog("r", "d", interval=0.05)
    log.start()
    log.handle({"event": "first_tile", "row": 0})
    log.handle({"event": "tile_written", "row": 1})
    assert [r.event for r in log.frame(spark).orderBy("seq").collect()] == ["first_tile", "tile_written"]
    with pytest.raises(RuntimeError):
        log.write(spark, str(tmp_path))
    log.finalize(10, 5)
    log.write(spark, str(tmp_path))
    assert {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"metrics.json", "metrics.csv", "report.json", "report.md"}


def test_a_cell_of_white_space_is_picked(spark):
    rows = spark.createDataFrame([("  ", "5"), ("", "5"), (None, "5"), ("4", "5"), ("", "")], "a string, b string")
    got = [r.n for r in rows.select(fr.number(fr.first_filled(F.col("a"), F.col("b"))).alias("n")).collect()]
    assert got == [None, 5.0, 5.0, 4.0, None]


def test_a_large_survey_is_solved():
    rng = np.random.default_rng(2)
    side, n = 30, 900
    at = np.stack([np.arange(n) % side * 100.0, np.arange(n) // side * 80.0], 1)
    off = at + rng.normal(0, 3, at.shape)
    frames = pd.DataFrame({"frame_id": [str(k) for k in range(n)], "easting": off[:, 0] * 0.1, "northing": -off[:, 1] * 0.1, "yaw": 0.0, "width": 320, "height": 240})
    pairs = []
    for k in range(n):
        for m in (k + 1, k + side):
            if m < n and (m != k + 1 or m % side):
                pairs.append((str(k), str(m), [1, 0, at[k, 0] - at[m, 0], 0, 1, at[k, 1] - at[m, 1], 0, 0, 1.0], 0.9))
    p, _ = reference_solver.solve(frames, pd.DataFrame(pairs, columns=["source_id", "target_id", "matrix", "inlier_ratio"]), 0.1)
    got = p[:, :2] - p[:, :2].mean(0)
    assert np.abs(got - (at - at.mean(0))).max() < 1.0 and np.abs(p[:, 3] - 1).max() < 0.01


def test_records_have_their_defaults(spark):
    report = spark.createDataFrame([(None, "/a/one.JPG", 1.0, 2.0, None, None, None, 4, 3), ("x", "/a/two.png", 1.0, 2.0, 7.0, None, None, 4, 3)], "frame_id string, path string, lat double, lon double, altitude double, yaw double, focal_length double, width int, height int")
    assert [(r.frame_id, r.altitude) for r in images.frame_records(report).orderBy("path").collect()] == [("one", 100.0), ("x", 7.0)]
    t = spark.createDataFrame([("a", "b", "affine", None, 9, 0, 0.12345, 1.23456, "low_inliers"), ("a", "c", "affine", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0], 9, 8, 0.5, 0.0005, "success"), ("b", "c", "affine", None, 9, 0, 0.0, 999.0, "failed")], "source_id string, target_id string, model_type string, matrix array<double>, num_matches int, num_inliers int, inlier_ratio double, reprojection_error double, status string")
    one, two, three = matching.pair_records(t).orderBy("source_id", "target_id").collect()
    assert (one.matrix, one.inlier_ratio, one.reprojection_error, one.status) == ([[1, 0, 0], [0, 1, 0], [0, 0, 1]], 0.1234, 1.235, "rejected")
    assert two.matrix == [[1, 2, 3], [4, 5, 6], [7, 8, 9]] and (two.status, three.status) == ("accepted", "fallback")
    assert {r.frame_id: r.confidence for r in matching.frame_confidence(spark.createDataFrame([("a",), ("b",), ("z",)], "frame_id string"), t).collect()} == {"a": 1.0, "b": 0.5, "z": 0.5}


def test_small_parts(spark):
    assert list(value(spark, affine.canvas_transform(*lits(5, 9, 0.5)))) == [0.5, 0, 5, 0, -0.5, 9]
    flat, tilted = affine.matrix(*affine.IDENTITY), affine.matrix(1, 0, 0, 0, 1, 0, 0.001, 0, 1)
    assert value(spark, affine.is_perspective(flat), affine.is_perspective(tilted)) == (False, True)
    assert session.bounds(build_config("pi-lite")) == {"cores": "2", "memory": "2048m"} and session.bounds(build_config("laptop")) == {"cores": "*", "memory": "8g"}
    features = spark.createDataFrame([(0, k, float(k % 3)) for k in range(9)], "frame int, kp int, response double")
    assert [(r.kp, r["rank"]) for r in matching.strongest(features, 4, "response").orderBy("rank").collect()] == [(2, 1), (5, 2), (8, 3), (1, 4)]


def test_positions_and_boxes_are_checked(spark):
    rows = spark.createDataFrame([(19.0, 73.0), (20.0, 74.0)], "lat double, lon double")
    box = rows.agg(geo.positions_box(F.col("lat"), F.col("lon")).alias("b")).first().b
    assert (box.west, box.north) == pytest.approx((72.9999, 20.0001))
    for bad, what in (([(91.0, 0.0)], "latitude out of range"), ([(0.0, -181.0)], "longitude out of range"), ([], "at least one geotagged frame")):
        with pytest.raises(Exception, match=what):
            spark.createDataFrame(bad, "lat double, lon double").agg(geo.positions_box(F.col("lat"), F.col("lon"))).collect()
    with pytest.raises(Exception, match="positive width and height"):
        rows.limit(1).agg(geo.projected_box(F.col("lon"), F.col("lat"))).collect()
    with pytest.raises(ValueError):
        geo.projected_box(F.col("lon"), F.col("lat"), -1.0)


def test_rasters_without_place_are_refused():
    from terralign.sinks import manifests

    for facts in ({"crs": "", "pixel_size_x": 1.0, "pixel_size_y": 1.0}, {"crs": "EPSG:4326", "pixel_size_x": 0.0, "pixel_size_y": 1.0}):
        with pytest.raises(ValueError):
            manifests.raster_manifest(**facts)


def test_cropped_frames_warp_alike():
    from terralign.operators import mosaic

    rng = np.random.default_rng(5)
    image = rng.integers(0, 255, (60, 80, 3), dtype=np.uint8)
    for m in (np.array([[1.1, -0.2, 7], [0.3, 0.9, -5], [0, 0, 1.0]]), np.array([[1, 0.1, 3], [0, 1.2, 2], [0.001, 0.0005, 1.0]])):
        for x0, y0 in ((0, 0), (32, 0), (32, 32)):
            to = np.array([[1, 0, -x0], [0, 1, -y0], [0, 0, 1.0]])
            left, top, right, bottom = mosaic.reach(m, (x0, y0, x0 + 32, y0 + 32), 80, 60)
            whole, mask = pixels.warp(image, to @ m, 32, 32)
            moved = to @ m @ np.array([[1, 0, left], [0, 1, top], [0, 0, 1.0]])
            part, mask_part = pixels.warp(np.ascontiguousarray(image[top:bottom, left:right]), moved, 32, 32)
            assert np.array_equal(mask, mask_part) and np.allclose(whole * mask[..., None], part * mask[..., None], atol=1e-3)
