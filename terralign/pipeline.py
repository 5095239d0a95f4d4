"""A survey from a folder of images to a georeferenced mosaic with its tiles and reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .config import RunConfig, build_config
from .functions import frames as fr
from .functions import geo
from .monitor import Monitor, RunSummary
from .operators import compose, matching, mosaic, plan
from .operators import poses as poses_of
from .operators import render as rendering
from .sinks import files, manifests, products, raster, writers
from .sources import images
from .sources.checkpoints import use_checkpoints


#: The longest side of mosaic.jpg, which is put together on the driver from an overview.
PREVIEW = 4096


def plan_frames(accepted: DataFrame) -> DataFrame:
    """Accepted frames with UTM position, ground resolution and heading, in order of path."""
    one = plan.project_utm(accepted.withColumn("flight_id", F.lit(0)), ["flight_id"])
    gsd = fr.ground_resolution(F.col("altitude"), F.col("focal_length_35mm"), F.col("focal_length"), F.col("width"))
    w, h = fr.oriented_size(F.col("width"), F.col("height"), F.col("orientation"))
    one = one.withColumn("gsd", gsd).withColumns({"width": w, "height": h})
    return plan.fill_headings(one, ["flight_id"], ["path"])


def run(spark: SparkSession, folder: str, out: str, config: RunConfig | None = None, on_event: Callable[[dict], None] | None = None) -> RunSummary:
    """Runs all stages and writes their products to `out`; ValueError if no frame is accepted.

    Frames and poses of a survey are few and their tables small; pixels are read on executors, per frame for features and per
    tile for blending. What later stages read again is checkpointed to the shared folder.
    """
    config, monitor, summary = config or build_config(), Monitor(), RunSummary(uuid.uuid4().hex[:12])
    use_checkpoints(spark)
    summary.profile, summary.preset, summary.dataset_name = config.profile_name, config.preset_name, folder.rstrip("/").rpartition("/")[2]
    monitor.start()
    try:
        monitor.set_stage("ingest")
        frames = images.read_frames(spark, folder).withColumn("reason", fr.rejection_reason(F.col("lat"), F.col("lon"), F.col("pitch"), config.pitch_nadir_threshold)).checkpoint()
        counts = frames.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNull()).alias("ok"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("file_bytes"))), F.lit(0)).alias("bytes")).first()
        summary.total_frames_found, summary.frames_accepted, summary.frames_rejected, summary.input_bytes = counts.n, counts.ok, counts.n - counts.ok, counts.bytes
        if not counts.ok:
            raise ValueError("no frame was accepted")

        monitor.set_stage("plan")
        planned = plan_frames(frames.filter("reason IS NULL")).checkpoint()
        positions = planned.agg(geo.positions_box(F.col("lat"), F.col("lon")).alias("box")).first().box  # refuses positions off the globe
        pairs = plan.neighbor_graph(planned, config.k_neighbors, config.max_neighbor_distance_m, "easting", "northing").select("source_id", "target_id", "distance_m")

        monitor.set_stage("match")
        decoded = images.upright(images.read_pixels(spark, folder), planned)
        features = mosaic.extract(decoded, config.matcher, config.feature_limit, config.matching_image_max_dim).checkpoint()
        points = mosaic.match(features, pairs, config.ratio_test_threshold)
        transforms = matching.pair_transforms(points, config.transform_model, config.ransac_thresh_px, config.min_inliers).checkpoint()
        found = matching.match_statistics(transforms).first()
        summary.total_matches_evaluated, summary.total_inliers_found, summary.mean_inlier_ratio, summary.mean_reprojection_error = found.pairs, found.inliers, found.mean_inlier_ratio, found.mean_error

        monitor.set_stage("align")
        ground = plan.target_resolution(planned, config.output_resolution_factor).first()[0]
        poses = poses_of.solve_poses(planned, transforms, ground, config.gps_prior_weight).checkpoint()

        monitor.set_stage("compose")
        gains = mosaic.luminance(decoded).select("frame_id", fr.exposure_gain(F.col("mean")).alias("gain")) if config.exposure_compensation else None
        tiles, canvas = mosaic.compose_tiles(decoded, poses, config.tile_size, config.feather_radius_px, gains)
        tiles = tiles.checkpoint()
        monitor.record_first_tile()
        box = canvas.first()
        corner = planned.agg(F.min("easting").alias("e"), F.max("northing").alias("n"), F.first("epsg").alias("epsg")).first()
        left, top = corner.e + box.min_x * ground, corner.n - box.min_y * ground
        right, bottom = left + box.width_px * ground, top - box.height_px * ground
        ends = spark.createDataFrame([(left, bottom), (right, top)], "e double, n double")
        lat, lon = geo.from_utm(F.col("e"), F.col("n"), F.lit(corner.epsg))
        around = ends.select(lat.alias("lat"), lon.alias("lon")).agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
        at = {"left": left, "top": top, "pixel": ground, "width": box.width_px, "height": box.height_px, "epsg": corner.epsg, "tile": config.tile_size, "bounds": tuple(around)}
        block = min(512, config.tile_size)
        levels, where = [(tiles, box.width_px, box.height_px)], (corner.epsg, left, top, ground)
        summary.output_geotiff_bytes = products.write_raster(levels, f"{out}/orthomosaic.tif", config.tile_size, block, *where)
        for event in events_of(tiles, f"{out}/orthomosaic.tif", summary.output_geotiff_bytes):
            if on_event:
                on_event(event)

        monitor.set_stage("export")
        manifest = {"run_id": summary.run_id, "dataset": summary.dataset_name, "crs": f"EPSG:{corner.epsg}", "bounds": [left, bottom, right, top], "bounds_wgs84": list(around), "width": box.width_px, "height": box.height_px, "gsd": ground, "geotiff": "orthomosaic.tif", "positions_wgs84": [positions.west, positions.south, positions.east, positions.north]}
        if config.generate_cog:
            small, factor = tiles, 2
            while factor <= 16 and min(box.width_px, box.height_px) >= 2 * factor:
                small = products.halved(small, config.tile_size).checkpoint()
                levels.append((small, box.width_px // factor, box.height_px // factor))
                factor *= 2
            summary.output_cog_bytes = products.write_raster(levels, f"{out}/orthomosaic_cog.tif", config.tile_size, block, *where)
            manifest["cog"] = "orthomosaic_cog.tif"
        preview, w, h = tiles, box.width_px, box.height_px
        while max(w, h) > PREVIEW:
            preview, w, h = products.halved(preview, config.tile_size).checkpoint(), max(1, w // 2), max(1, h // 2)
        files.write_jpeg(spark, f"{out}/mosaic.jpg", raster.png(products.picture(preview, w, h)))
        if config.generate_tiles:
            least, most = spark.range(1).select(*geo.zoom_range(F.lit(ground))).first()
            zooms = range(config.tile_min_zoom or least, (config.tile_max_zoom or most) + 1)
            pictures = products.web_tiles(tiles, at, zooms).select(F.concat_ws("/", "z", "x", F.concat("y", F.lit(".png"))).alias("path"), F.col("png").alias("data"))
            n, size = writers.write_files(pictures, f"{out}/tiles")
            files.write_json(spark, f"{out}/tiles/metadata.json", products.tile_json(summary.dataset_name, tuple(around), zooms))
            manifest["tiles"] = {"scheme": "xyz", "zoom_min": zooms[0], "zoom_max": zooms[-1], "tile_count": n, "tile_bytes": size}

        monitor.set_stage("report")
        files.write_json(spark, f"{out}/poses.json", {"poses": [{"frame_id": p.frame_id, "x": p.world_x, "y": p.world_y, "scale": p.scale, "rotation": p.rotation, "confidence": p.confidence, "dropped": False} for p in poses.orderBy("frame_id").toLocalIterator()]})
        files.write_json(spark, f"{out}/pair_transforms.json", {"pairs": [t.asDict() for t in matching.pair_records(transforms).orderBy("source_id", "target_id").toLocalIterator()]})
        files.write_json(spark, f"{out}/canvas.json", {"crs": manifest["crs"], "left": left, "top": top, "pixel_size": ground, "width": box.width_px, "height": box.height_px, "gsd": ground, "source_dataset": summary.dataset_name})
        files.write_json(spark, f"{out}/manifest.json", manifest)
        facts = manifests.raster_manifest(
            dataset=summary.dataset_name, source=folder, crs=manifest["crs"], bounds=manifest["bounds"], width=box.width_px, height=box.height_px, pixel_size_x=ground, pixel_size_y=ground, count=4, dtype="uint8",
            geotiff_path=f"{out}/orthomosaic.tif", cog_path=f"{out}/orthomosaic_cog.tif" if "cog" in manifest else None, geotiff_bytes=summary.output_geotiff_bytes, cog_bytes=summary.output_cog_bytes or None,
        )
        files.write_json(spark, f"{out}/raster_manifest.json", facts)
        files.write_json(spark, f"{out}/phase2_manifest.json", manifests.product_manifest(summary.run_id, facts, around, manifest.get("tiles")))
    except BaseException:
        monitor.stop()
        raise
    summary.total_latency_seconds = monitor.stop()
    monitor.fill(summary)
    size = summary.output_cog_bytes or summary.output_geotiff_bytes
    summary.bandwidth_reduction_factor = summary.input_bytes / size if size else 0.0
    for name in ("metrics.json", "report.json"):
        files.write_text(spark, f"{out}/{name}", summary.to_json())
    files.write_samples(spark, f"{out}/metrics.csv", monitor.samples)
    if report.chart(monitor.samples, f"/tmp/chart-{summary.run_id}.png"):
        files.write_bytes(spark, f"{out}/resources.png", Path(f"/tmp/chart-{summary.run_id}.png").read_bytes())
    files.write_text(spark, f"{out}/report.md", report.markdown(summary))
    return summary


def events_of(tiles: DataFrame, path: str, n_bytes: int):
    """first_tile, tile_written for each other tile by row and column, and final_output."""
    for i, t in enumerate(tiles.select("row", "col", "x0", "y0", "width", "height").orderBy("row", "col").toLocalIterator()):
        yield {"event": "tile_written" if i else "first_tile", "row": t.y0, "col": t.x0, "width": t.width, "height": t.height}
    yield {"event": "final_output", "path": path, "bytes": n_bytes}


def render_canvas(spark: SparkSession, canvas, render: Callable, tile: int = 2048) -> DataFrame:
    """Tiles of a contract canvas from a callable (x, y, width, height) -> (4, height, width) uint8, called on executors."""
    one = spark.createDataFrame([(canvas.width, canvas.height)], "width_px long, height_px long")
    return rendering.rendered(compose.tile_grid(one, tile), render)
