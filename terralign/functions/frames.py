"""Scalar facts of frames, pixels and transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Image extensions, sensor widths, default focal length and the reasons for rejection.
EXTENSIONS = r"(?i)\.(jpe?g|tiff?|png)$"
SENSOR_MM, SENSOR_35_MM, FOCAL_MM = 6.17, 36.0, 4.5
NO_GPS = "Missing or corrupt EXIF GPS coordinates (Latitude/Longitude)"
UNREADABLE, NO_GPS_METADATA = "unreadable_file", "no_gps_metadata"


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(.)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_image(path: Column) -> Column:
    return path.rlike(EXTENSIONS)


def ground_resolution(altitude: Column, focal_35: Column, focal: Column, width: Column) -> Column:
    """Metres per pixel from the camera's geometry, held between 5 mm and 50 cm."""
    has_35, has_focal = F.coalesce(focal_35 > 0, F.lit(False)), F.coalesce(focal > 0, F.lit(False))
    sensor = F.when(has_35, SENSOR_35_MM).otherwise(SENSOR_MM)
    used = F.when(has_35, focal_35).when(has_focal, focal).otherwise(FOCAL_MM)
    gsd = F.greatest(altitude, F.lit(5.0)) * sensor / (used * F.greatest(width, F.lit(100)))
    return F.greatest(F.lit(0.005), F.least(F.lit(0.5), gsd))


def chosen_altitude(relative: Column, gps: Column) -> Column:
    return F.when(relative > 0, relative).otherwise(gps)


def rejection_reason(lat: Column, lon: Column, pitch: Column, threshold: float = -45.0) -> Column:
    """Null for accepted frames; a missing position wins over a camera that looks ahead."""
    ahead = F.format_string(f"Non-nadir gimbal pitch (%.1f° > {threshold:.1f}°)", pitch.cast("double"))
    return F.when(lat.isNull() | lon.isNull(), NO_GPS).when(pitch > threshold, ahead)


def first_rejections(frames: DataFrame, order: str, most: int = 10) -> DataFrame:
    """The first rejected frames (their reason isn't null) in order, and in `more` how many others there are."""
    rejected = frames.filter("reason IS NOT NULL")
    more = rejected.agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("more"))
    return rejected.orderBy(order).limit(most).join(F.broadcast(more), F.lit(True))


def folder_reason(readable: Column, has_gps: Column) -> Column:
    return F.when(~readable, UNREADABLE).when(~has_gps, NO_GPS_METADATA)


def oriented_size(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    turned = orientation.isin(5, 6, 7, 8)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def budget_scale(width: Column, height: Column, pixels: int) -> Column:
    """The factor that brings an image down to a number of pixels; never above 1."""
    return F.least(F.lit(1.0), F.sqrt(F.lit(float(pixels)) / (width * height)))


def scaled_size(width: Column, height: Column, scale: Column) -> tuple[Column, Column]:
    one = F.lit(1)
    return F.greatest(one, F.bround(width * scale).cast("int")), F.greatest(one, F.bround(height * scale).cast("int"))


def max_side_scale(width: Column, height: Column, side: int) -> Column:
    return F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(width, height))


def exposure_gain(mean: Column, target: float = 128.0) -> Column:
    """How much to brighten a frame of a mean luminance; very dark and very bright ones stay."""
    return F.when((mean < 10) | (mean > 245), 1.0).otherwise(F.greatest(F.lit(0.8), F.least(F.lit(1.25), F.lit(target) / mean)))


def apply_gain(value: Column, gain: Column) -> Column:
    changed = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), value * gain)))
    return F.when(F.abs(gain - 1) < 0.01, value).otherwise(changed).cast("int")


def feather(distance: Column, radius: float = 25.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), distance / max(radius, 1.0)))


def transfer_seconds(n_bytes: Column, mbps: Column) -> Column:
    return F.when(mbps <= 0, 0.0).otherwise(n_bytes * 8.0 / (mbps * 1e6))


def format_seconds(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    minutes = F.format_string("%dm %02ds", F.floor(whole / 60), whole % 60)
    hours = F.format_string("%dh %02dm", F.floor(whole / 3600), F.floor((whole % 3600) / 60))
    return F.when(seconds < 60, F.format_string("%.1fs", F.bround(seconds.cast("double"), 1))).when(seconds < 3600, minutes).otherwise(hours)


def number(text: Column) -> Column:
    """A number as CSV cells spell it, null for anything else."""
    cell = F.trim(text)
    return F.when(cell.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), cell.try_cast("double"))


def first_filled(*cells: Column) -> Column:
    """The first cell that isn't empty; one of white space counts as filled."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cells))
