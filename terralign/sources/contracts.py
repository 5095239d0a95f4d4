"""Contract files and metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames as fr
from ..sinks import files

POSE = "frame_id string, x double, y double, scale double, rotation double, confidence double, dropped boolean"
CANVAS = "crs string, left double, top double, pixel_size double, width int, height int, gsd double, source_dataset string"


def _required(frame: DataFrame, names: list[str]) -> DataFrame:
    """Fails when a row lacks one of the names."""
    checked = {n: F.when(F.col(n).isNull(), F.raise_error(F.lit(f"missing required field: {n}"))).otherwise(F.col(n)) for n in names}
    return frame.withColumns(checked)


def read_poses(spark: SparkSession, path: str, dropped: bool = False) -> DataFrame:
    """Poses of a contract, {"poses": [...]} or a bare list; ValueError without any. Dropped ones are left out unless asked for."""
    wrapped = spark.read.schema(f"poses array<struct<{POSE.replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean')}>>, {POSE}").option("multiLine", True).json(path)
    rows = wrapped.withColumn("one", F.explode(F.coalesce("poses", F.array(F.struct("frame_id", "x", "y", "scale", "rotation", "confidence", "dropped"))))).select("one.*")
    if rows.isEmpty():
        raise ValueError("the contract has no poses")
    rows = _required(rows, ["frame_id", "x", "y"])
    rows = rows.withColumns({"scale": F.coalesce("scale", F.lit(1.0)), "rotation": F.coalesce("rotation", F.lit(0.0)), "confidence": F.coalesce("confidence", F.lit(0.0)), "dropped": F.coalesce("dropped", F.lit(False))})
    return rows if dropped else rows.filter("NOT dropped")


def read_canvas(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a canvas contract; fails when a field is missing."""
    return _required(spark.read.schema(CANVAS).option("multiLine", True).json(path), [c.split(" ")[0] for c in CANVAS.split(", ")])


def write_json(frame: DataFrame, path: str, wrap: str | None = None) -> None:
    """Rows as one JSON text: the row itself, or a list under a name."""
    row = F.struct(*frame.columns)
    text = frame.select(F.to_json(row).alias("value")) if wrap is None else frame.agg(F.to_json(F.struct(F.collect_list(row).alias(wrap))).alias("value"))
    text.coalesce(1).write.mode("overwrite").text(path)


def audit(rows: DataFrame) -> DataFrame:
    """One row of counts, ranges and camera models of an ExifTool table (all columns text, any of them missing)."""

    def cell(*names: str) -> F.Column:
        there = [F.col(f"`{n}`") for n in names if n in rows.columns]
        return fr.number(fr.first_filled(*there)) if there else F.lit(None).cast("double")

    lat, lon = cell("GPSLatitude", "EXIF:GPSLatitude"), cell("GPSLongitude", "EXIF:GPSLongitude")
    altitude, pitch = cell("GPSAltitude", "EXIF:GPSAltitude", "RelativeAltitude"), cell("GimbalPitchDegree")
    model = F.nullif(F.trim(F.col("Model")), F.lit("")) if "Model" in rows.columns else F.lit(None).cast("string")
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(lat.isNotNull() & lon.isNotNull()).alias("gps"), F.min(lat).alias("s"), F.max(lat).alias("n"), F.min(lon).alias("w"), F.max(lon).alias("e"),
        F.count(altitude).alias("alt"), F.count(pitch).alias("pitch"), F.sort_array(F.collect_set(model)).alias("models"),
    )


def audit_csv(spark: SparkSession, path: str, dataset: str, source_url: str, terms_url: str | None = None) -> dict:
    """What a metadata table of ExifTool says about a dataset; ValueError if it has no rows."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    if rows.isEmpty():
        raise ValueError("the metadata has no rows")

    one = audit(rows).first()
    return {
        "dataset": dataset, "source_url": source_url, "terms_url": terms_url, "total_files": one.total, "readable_files": one.total, "gps_files": one.gps, "files_without_gps": one.total - one.gps,
        "latitude_range": [one.s, one.n] if one.gps else None, "longitude_range": [one.w, one.e] if one.gps else None, "altitude_files": one.alt, "gimbal_pitch_files": one.pitch, "camera_models": list(one.models),
        "gps_complete": one.gps == one.total, "status": "accepted_with_limitations" if one.gps else "rejected",
        "limitations": ["Positions are counted in the table; flight pattern and imagery need a look.", "EXIF positions are not of survey grade."],
    }


def write_audit(spark: SparkSession, path: str, found: dict) -> None:
    """The audit of a dataset as JSON."""
    files.write_json(spark, path, found)
