"""Rasters: georeferenced TIFF with tiles and overviews, PNG, and reading them back. Blocks are coded on executors."""

from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np

# TIFF tags that are written, and the GeoTIFF keys of a projected system.
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "samples": 277, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "offsets": 324, "counts": 325, "extra": 338, "scale": 33550, "tie": 33922, "keys": 34735, "nodata": 42113, "subfile": 254}


def encode_block(pixels: np.ndarray, size: int) -> bytes:
    """A block of (height, width, bands) uint8, filled up to size, with horizontal differences, deflated."""
    block = np.zeros((size, size, pixels.shape[2]), np.uint8)
    block[: pixels.shape[0], : pixels.shape[1]] = pixels
    block[:, 1:] -= block[:, :-1].copy()
    return zlib.compress(block.tobytes(), 6)


def decode_block(data: bytes, size: int, bands: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, size, bands), axis=1, dtype=np.uint8)


def overview(pixels: np.ndarray) -> np.ndarray:
    """Half the size, each pixel the mean of four."""
    h, w = pixels.shape[0] // 2 * 2, pixels.shape[1] // 2 * 2
    return pixels[:h, :w].reshape(h // 2, 2, w // 2, 2, -1).mean((1, 3)).astype(np.uint8)


# The numbers of TIFF's value types.
KINDS = {"s": 2, "H": 3, "I": 4, "d": 12, "Q": 16}


def _packed(rows: list[tuple[int, str, list]], at: int, following: int, big: bool) -> bytes:
    """A directory of (tag, type, values) that stands at a place, and what of its values doesn't fit the entries."""
    word, room = ("Q", 8) if big else ("I", 4)
    head, tail = struct.pack("<Q" if big else "<H", len(rows)), b""
    place = at + len(head) + (4 + 2 * room) * len(rows) + room
    for tag, kind, values in sorted(rows):
        raw = values[0] if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)
        head += struct.pack("<HH" + word, tag, KINDS[kind], len(raw) if kind == "s" else len(values))
        if len(raw) <= room:
            head += raw.ljust(room, b"\0")
        else:
            head += struct.pack("<" + word, place + len(tail))
            tail += raw + b"\0" * (len(raw) % 2)
    return head + struct.pack("<" + word, following) + tail


def header(levels: list[dict], epsg: int, left: float, top: float, pixel: float, nodata: int = 0, big: bool | None = None) -> bytes:
    """All directories of a TIFF, behind which the coded blocks of its levels follow, level by level, in order of row and column.

    A level is (width, height, bands, block, counts), the first the image, the others overviews of it; counts are the sizes of
    its blocks. Offsets have 64 bits (BigTIFF) where the file is over 4 GB, or where `big` says so.
    """
    if not levels or pixel <= 0 or not epsg:
        raise ValueError("a raster needs a level, a pixel size and a coordinate system")
    geographic = epsg == 4326
    keys = [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg]
    data = sum(int(sum(x["counts"])) for x in levels)

    def entries(level: dict, first: bool, offsets: list[int], big: bool) -> list[tuple[int, str, list]]:
        bands, factor = level["bands"], levels[0]["width"] / level["width"]
        rows = [(TAGS["subfile"], "I", [0 if first else 1]), (TAGS["width"], "I", [level["width"]]), (TAGS["height"], "I", [level["height"]]), (TAGS["bits"], "H", [8] * bands), (TAGS["compression"], "H", [8]), (TAGS["photometric"], "H", [2 if bands > 2 else 1])]
        rows += [(TAGS["samples"], "H", [bands]), (TAGS["planar"], "H", [1]), (TAGS["predictor"], "H", [2]), (TAGS["tile_width"], "H", [level["block"]]), (TAGS["tile_height"], "H", [level["block"]]), (TAGS["offsets"], "Q" if big else "I", offsets), (TAGS["counts"], "I", level["counts"])]
        if bands in (2, 4):
            rows.append((TAGS["extra"], "H", [2]))
        return [*rows, (TAGS["scale"], "d", [pixel * factor, pixel * factor, 0.0]), (TAGS["tie"], "d", [0.0, 0.0, 0.0, left, top, 0.0]), (TAGS["keys"], "H", keys), (TAGS["nodata"], "s", [f"{nodata}\0".encode()])]

    for wide in (False, True) if big is None else (big,):
        ends = list(itertools.accumulate((len(_packed(entries(x, not i, [0] * len(x["counts"]), wide), 0, 0, wide)) for i, x in enumerate(levels)), initial=16 if wide else 8))
        if wide or ends[-1] + data < 1 << 32:
            break
    if not wide and ends[-1] + data >= 1 << 32:
        raise ValueError("a raster over 4 GB needs offsets of 64 bits")
    out, at = b"II+\0" + struct.pack("<HHQ", 8, 0, 16) if wide else b"II*\0" + struct.pack("<I", 8), ends[-1]
    for i, x in enumerate(levels):
        offsets = list(itertools.accumulate(x["counts"], initial=at))
        at = offsets.pop()
        out += _packed(entries(x, not i, offsets, wide), ends[i], ends[i + 1] if i + 1 < len(levels) else 0, wide)
    return out


def assemble(levels: list[dict], epsg: int, left: float, top: float, pixel: float, nodata: int = 0, big: bool | None = None) -> bytes:
    """A TIFF of coded levels (width, height, bands, block, blocks) that are held in memory, as one array's are."""
    counted = [x | {"counts": [len(b) for b in x["blocks"]]} for x in levels]
    return header(counted, epsg, left, top, pixel, nodata, big) + b"".join(b for x in levels for b in x["blocks"])


def level_of(pixels: np.ndarray, block: int) -> dict:
    """Codes a whole array as a level."""
    h, w, bands = pixels.shape
    blocks = [encode_block(pixels[y : y + block, x : x + block], block) for y in range(0, h, block) for x in range(0, w, block)]
    return {"width": w, "height": h, "bands": bands, "block": block, "blocks": blocks}


def geotiff(pixels: np.ndarray, epsg: int, left: float, top: float, pixel: float, block: int = 512, nodata: int = 0, overviews: bool = False) -> bytes:
    """An array of (height, width, 1, 3 or 4 bands) uint8 as a TIFF; with overviews by factors 2 to 16 that leave a pixel."""
    if pixels.ndim != 3 or pixels.shape[2] not in (1, 3, 4) or pixels.dtype != np.uint8 or block <= 0 or 0 in pixels.shape:
        raise ValueError("expected a (height, width, bands) array of uint8 with 1, 3 or 4 bands")
    levels, small = [level_of(pixels, block)], pixels
    if overviews:
        factors = [f for f in (2, 4, 8, 16) if min(pixels.shape[:2]) >= 2 * f]
        if not factors:
            raise ValueError("the raster is too small for overviews")
        for _ in factors:
            small = overview(small)
            levels.append(level_of(small, 256))
    return assemble(levels, epsg, left, top, pixel, nodata)


def read_header(content: bytes) -> dict:
    """Width, height, bands, system, bounds, pixel size, nodata and the number of overviews of a TIFF."""
    from ..sources.images import _directory

    big = content[2:4] == b"+\0"
    word, room, first = ("<Q", 20, 8) if big else ("<I", 12, 2)
    at, levels = struct.unpack_from(word, content, 8 if big else 4)[0], []
    while at:
        levels.append(_directory(content, "<", at, big))
        at = struct.unpack_from(word, content, at + first + room * struct.unpack_from("<Q" if big else "<H", content, at)[0])[0]
    t = levels[0]
    keys = t[TAGS["keys"]]
    systems = [keys[i + 3] for i in range(4, len(keys), 4) if keys[i] in (2048, 3072)]
    pixel, left, top, w, h = t[TAGS["scale"]][0], t[TAGS["tie"]][3], t[TAGS["tie"]][4], t[TAGS["width"]][0], t[TAGS["height"]][0]
    return {"width": w, "height": h, "bands": t[TAGS["samples"]][0], "epsg": systems[0] if systems else None, "bounds": (left, top - h * pixel, left + w * pixel, top), "pixel_size": pixel, "nodata": t[TAGS["nodata"]][0], "overviews": len(levels) - 1, "block": t[TAGS["tile_width"]][0], "tags": levels}


def read_pixels(content: bytes, level: int = 0) -> np.ndarray:
    t = read_header(content)["tags"][level]
    w, h, block, bands = (t[TAGS[k]][0] for k in ("width", "height", "tile_width", "samples"))
    out, i = np.zeros((h, w, bands), np.uint8), 0
    for y in range(0, h, block):
        for x in range(0, w, block):
            at, n = t[TAGS["offsets"]][i], t[TAGS["counts"]][i]
            out[y : y + block, x : x + block] = decode_block(content[at : at + n], block, bands)[: h - y, : w - x]
            i += 1
    return out


def png(pixels: np.ndarray) -> bytes:
    """An array of (height, width, 3 or 4) uint8 as PNG."""
    h, w, bands = pixels.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], 1).tobytes()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[bands], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")
