"""Image folders as frames: a scan of files, EXIF and XMP, and decoded pixels."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames as fr
from ..functions import geo, pixels
from ..sinks import files
from . import headers
from .stores import is_folder, reachable

# Tag numbers of TIFF and EXIF directories, and the bytes of their value types.
WIDTH, HEIGHT, MODEL, ORIENTATION, DATETIME, EXIF_IFD, GPS_IFD = 256, 257, 272, 274, 306, 34665, 34853
ORIGINAL, FOCAL, FOCAL_35, PIXEL_X, PIXEL_Y = 36867, 37386, 41989, 40962, 40963
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
#: What image files are called, in either case.
SUFFIXES = (".jpg", ".jpeg", ".tif", ".tiff", ".png")
NAMES = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e[1:]) for e in SUFFIXES) + "}"
META = (
    "lat_dms array<double>, lat_ref string, lon_dms array<double>, lon_ref string, gps_altitude double, gps_track double, focal_length double, focal_length_35mm double, camera_model string, timestamp string, "
    "orientation int, width int, height int, readable boolean"
)
META_STRUCT = f"struct<{META.replace(' ', ':').replace(',:', ',')}>"


def _unpack(kinds: str, content, at: int) -> tuple:
    """struct.unpack_from, of bytes or of a file's ranges."""
    return struct.unpack(kinds, content[at : at + struct.calcsize(kinds)])


def _directory(tiff: bytes, order: str, at: int, big: bool = False) -> dict[int, list]:
    """The entries of one image file directory; entries that don't fit the file are left out. `big` ones have 64-bit offsets."""
    found: dict[int, list] = {}
    word, room, first, length = ("Q", 8, 8, "Q") if big else ("I", 4, 2, "H")
    if at + first > len(tiff):
        return found
    for i in range(_unpack(order + length, tiff, at)[0]):
        entry = at + first + (4 + 2 * room) * i
        if entry + 4 + 2 * room > len(tiff):
            break
        tag, kind, count = _unpack(order + "HH" + word, tiff, entry)
        size = TYPE_SIZE.get(kind, 0) * count
        place = entry + 4 + room if size <= room else _unpack(order + word, tiff, entry + 4 + room)[0]
        if not size or place + size > len(tiff):
            continue
        raw = tiff[place : place + size]
        if kind == 2:
            found[tag] = [raw.split(b"\0")[0].decode("ascii", "ignore")]
        elif kind in (5, 10):
            numbers = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * count, raw)
            found[tag] = [n / d if d else None for n, d in zip(numbers[::2], numbers[1::2], strict=True)]
        elif kind in (1, 6, 7):
            found[tag] = list(raw)
        else:
            found[tag] = list(struct.unpack(order + {3: "H", 4: "I", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}[kind] * count, raw))
    return found


def parse_tiff(tiff: bytes) -> dict[int, list] | None:
    """All entries of the first directory with those of its EXIF and GPS directories (GPS tags negative); None if it is none."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8 or _unpack(order + "H", tiff, 2)[0] != 42:
        return None
    tags = _directory(tiff, order, _unpack(order + "I", tiff, 4)[0])
    for pointer, sign in ((EXIF_IFD, 1), (GPS_IFD, -1)):
        if tags.get(pointer):
            tags |= {sign * t: v for t, v in _directory(tiff, order, tags[pointer][0]).items()}
    return tags


def parse_image(content: bytes) -> dict:
    """The facts of an image file, from its headers alone."""
    tags, size = {}, (None, None)
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF:
            mark, length = content[at + 1], _unpack(">H", content, at + 2)[0]
            if mark == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0" and not tags:
                tags = parse_tiff(content[at + 10 : at + 2 + length]) or {}
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and at + 9 <= len(content):
                size = _unpack(">HH", content, at + 5)[::-1]
            if mark == 0xDA:
                break
            at += 2 + length
    elif content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        size, at = _unpack(">II", content, 16), 8
        while at + 8 <= len(content):
            length, name = _unpack(">I", content, at)[0], content[at + 4 : at + 8]
            if name == b"eXIf":
                tags = parse_tiff(content[at + 8 : at + 8 + length]) or {}
            at += 12 + length
    elif (found := parse_tiff(content)) is not None:
        tags, size = found, (found.get(WIDTH, [None])[0], found.get(HEIGHT, [None])[0])
    first = lambda t: (tags.get(t) or [None])[0]
    dms = lambda t: v if (v := tags.get(t)) and len(v) == 3 and None not in v else None
    text = lambda t: v if isinstance(v := first(t), str) and v else None
    return {
        "lat_dms": dms(-2), "lat_ref": text(-1) or "N", "lon_dms": dms(-4), "lon_ref": text(-3) or "E", "gps_altitude": first(-6), "gps_track": first(-15), "focal_length": first(FOCAL),
        "focal_length_35mm": None if first(FOCAL_35) is None else float(first(FOCAL_35)), "camera_model": text(MODEL), "timestamp": text(ORIGINAL) or text(DATETIME), "orientation": first(ORIENTATION) or 1,
        "width": size[0], "height": size[1], "readable": size[0] is not None,
    }


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"path": b["path"], "meta": [parse_image(bytes(c)) for c in b["content"]], "xmp": [bytes(c[:65536]).decode("latin-1") for c in b["content"]], "length": b["length"]})


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of the image files right in a folder; a missing folder gives no rows."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", NAMES).load(folder)
        return found.filter(fr.is_image(F.col("path"))).select("path", "length", "content")
    except AnalysisException:
        return spark.createDataFrame([], "path string, length long, content binary")


def scan_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(path, meta, xmp, length) of the image files right in a folder: by ranges of the files where executors reach the store
    and `folder` is one, by Spark's own reader of whole files, which knows no empty ones, elsewhere."""
    uri = files.full_uri(spark, folder)
    if reachable(uri) and not set("*?[{") & set(folder) and is_folder(uri):
        return headers.read_headers(spark, uri).select("path", "meta", "xmp", "length")
    return scan_files(spark, folder).mapInPandas(_parse, f"path string, meta {META_STRUCT}, xmp string, length long")


def xmp_number(xmp: F.Column, name: str) -> F.Column:
    """A number that an XMP packet gives as an attribute."""
    return F.regexp_extract(xmp, name + r'="([+-]?\d+(?:\.\d+)?)"', 1).try_cast("double")


def read_frames(spark: SparkSession, folder: str, coerce_refs: bool = False) -> DataFrame:
    """One row per image file with all facts and `reason` (null for accepted frames), in order of path when sorted by it."""
    raw = scan_headers(spark, folder)
    m = lambda c: F.col(f"meta.{c}")
    ref = lambda c, ok, default: F.when(F.upper(F.trim(m(c))).isin(*ok), m(c)).otherwise(default) if coerce_refs else m(c)
    relative, yaw = xmp_number(F.col("xmp"), "RelativeAltitude"), xmp_number(F.col("xmp"), "FlightYawDegree")
    frames = raw.select(
        fr.stem(F.col("path")).alias("frame_id"), "path", F.col("length").alias("file_bytes"),
        geo.dms_to_degrees(m("lat_dms"), ref("lat_ref", ("N", "S"), "N")).alias("lat"), geo.dms_to_degrees(m("lon_dms"), ref("lon_ref", ("E", "W"), "E")).alias("lon"),
        fr.chosen_altitude(F.coalesce(relative, F.lit(0.0)), F.coalesce(m("gps_altitude"), F.lit(0.0))).alias("altitude"),
        geo.normalised_yaw(F.coalesce(yaw, m("gps_track"))).alias("yaw"), xmp_number(F.col("xmp"), "GimbalPitchDegree").alias("pitch"), m("focal_length").alias("focal_length"), m("focal_length_35mm").alias("focal_length_35mm"),
        m("width").alias("width"), m("height").alias("height"), m("orientation").alias("orientation"), m("timestamp").alias("timestamp"), m("camera_model").alias("camera_model"), m("readable").alias("readable"),
    )
    return frames.withColumn("reason", fr.rejection_reason(F.col("lat"), F.col("lon"), F.col("pitch")))


def folder_report(frames: DataFrame) -> DataFrame:
    """Every file with the simpler check: unreadable first, then without a position; sizes as the orientation shows them."""
    w, h = fr.oriented_size(F.col("width"), F.col("height"), F.col("orientation"))
    has = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return frames.select("frame_id", "path", "file_bytes", w.alias("width"), h.alias("height"), "lat", "lon", "altitude", "yaw", "focal_length", "orientation", has.alias("has_gps"), "readable", fr.folder_reason(F.col("readable"), has).alias("rejection_reason"))


def frame_records(report: DataFrame, altitude: float = 100.0) -> DataFrame:
    """folder_report's rows as frames: an id from the file's stem where there is none, and an altitude where there is none."""
    return report.select(F.coalesce("frame_id", fr.stem(F.col("path"))).alias("frame_id"), "path", "lat", "lon", F.coalesce("altitude", F.lit(altitude)).alias("altitude"), "yaw", "focal_length", "width", "height")


def read_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(frame_id, width, height, channels, data): pixels row by row, blue first; files that can't be decoded are left out."""
    i = F.col("image")
    images = spark.read.format("image").option("dropInvalid", "true").option("pathGlobFilter", NAMES).load(folder)
    return images.select(fr.stem(i["origin"]).alias("frame_id"), i["width"].alias("width"), i["height"].alias("height"), i["nChannels"].alias("channels"), i["data"].alias("data"))


def upright(images: DataFrame, frames: DataFrame) -> DataFrame:
    """read_pixels' rows of the frames (frame_id, orientation), turned as their orientation says; only those that need it leave the JVM."""

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                image = pixels.orient(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels), r.orientation)
                yield pd.DataFrame([(r.frame_id, image.shape[1], image.shape[0], r.channels, image.tobytes())], columns=["frame_id", "width", "height", "channels", "data"])

    known = images.join(frames.select("frame_id", F.coalesce("orientation", F.lit(1)).alias("orientation")), "frame_id")
    as_is = ~F.col("orientation").between(2, 8)
    turned = known.filter(~as_is).mapInPandas(turn, "frame_id string, width int, height int, channels int, data binary")
    return known.filter(as_is).drop("orientation").unionByName(turned)
