"""A flight of synthetic images with EXIF positions, as PNG files."""

from __future__ import annotations

import math
import struct
import zlib
from pathlib import Path

import numpy as np

from terralign.sinks import raster


def exif(lat: float, lon: float, altitude: float = 60.0) -> bytes:
    """A TIFF block with camera, focal lengths and position."""

    def rationals(*pairs):
        return (5, len(pairs), b"".join(struct.pack("<II", *p) for p in pairs))

    def dms(v):
        v = abs(v)
        d, m = int(v), int(v % 1 * 60)
        return rationals((d, 1), (m, 1), (round((v * 3600 - d * 3600 - m * 60) * 10000), 10000))

    text = lambda t: (2, len(t) + 1, t.encode() + b"\0")
    gps = {1: text("N" if lat >= 0 else "S"), 2: dms(lat), 3: text("E" if lon >= 0 else "W"), 4: dms(lon), 6: rationals((round(altitude * 10), 10))}
    camera = {37386: rationals((45, 10)), 41989: (3, 1, struct.pack("<H", 24))}
    first = {271: text("Maker"), 272: text("Camera-2000"), 306: text("2026:10:09 10:00:00")}

    def block(tags, at, extra=()):
        n = len(tags) + len(extra)
        head, tail, place = struct.pack("<H", n), b"", at + 2 + 12 * n + 4
        for tag, (kind, count, raw) in sorted({**tags, **{t: (4, 1, struct.pack("<I", v)) for t, v in extra}}.items()):
            if len(raw) <= 4:
                head += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
            else:
                head += struct.pack("<HHII", tag, kind, count, place + len(tail))
                tail += raw + b"\0" * (len(raw) % 2)
        return head + b"\0\0\0\0" + tail

    size = len(block(first, 8, ((34665, 0), (34853, 0))))
    camera_block = block(camera, 8 + size)
    return b"II*\0" + struct.pack("<I", 8) + block(first, 8, ((34665, 8 + size), (34853, 8 + size + len(camera_block)))) + camera_block + block(gps, 8 + size + len(camera_block))


def png_with(pixels: np.ndarray, tiff: bytes | None = None, xmp: str = "") -> bytes:
    data = raster.png(pixels)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    extra = (chunk(b"eXIf", tiff) if tiff else b"") + (chunk(b"tEXt", b"xmp\0" + xmp.encode()) if xmp else b"")
    return data[:33] + extra + data[33:]


def flight(folder: Path, rows: int = 2, cols: int = 3, size: tuple[int, int] = (320, 240), lat0: float = 34.0522, lon0: float = -118.2437) -> list[Path]:
    rng = np.random.default_rng(42)
    w, h = size
    ground = np.kron(rng.integers(30, 220, (170, 200, 3)), np.ones((6, 6, 1))).astype(np.int16)
    out = []
    for r in range(rows):
        for c in range(cols):
            x, y = 250 + c * int(w * 0.4), 250 + r * int(h * 0.4)
            patch = ground[y - h // 2 : y + h // 2, x - w // 2 : x + w // 2] + rng.normal(0, 3, (h, w, 3))
            metre = 0.28125  # ground metres per pixel at 60 m with this camera
            lat = lat0 - (y - 250) * metre / 111132.0
            lon = lon0 + (x - 250) * metre / (111132.0 * math.cos(math.radians(lat0)))
            path = folder / f"frame_{len(out) + 1:03d}.png"
            path.write_bytes(png_with(np.clip(patch, 0, 255).astype(np.uint8), exif(lat, lon), 'FlightYawDegree="+0.0" GimbalPitchDegree="-90.0"'))
            out.append(path)
    return out
