"""What the products of a run are, as JSON: the raster alone, and the raster with its tiles and contract files."""

from __future__ import annotations

# The names in the raster's manifest, and what is in the folder by contract.
RASTER = ("dataset", "source", "crs", "bounds", "width", "height", "pixel_size_x", "pixel_size_y", "count", "dtype", "nodata", "geotiff_path", "cog_path", "geotiff_bytes", "cog_bytes")
CONTRACT = {"poses": "poses.json", "pair_transforms": "pair_transforms.json", "canvas": "canvas.json"}


def raster_manifest(**facts) -> dict:
    """The facts of a raster by the names of RASTER, null where unknown; ValueError without a CRS or a positive pixel size."""
    if unknown := set(facts) - set(RASTER):
        raise ValueError(f"not in a manifest: {sorted(unknown)}")
    found = {name: facts.get(name) for name in RASTER}
    if not found["crs"]:
        raise ValueError("the raster has no CRS")
    if min(found["pixel_size_x"] or 0, found["pixel_size_y"] or 0) <= 0:
        raise ValueError("the raster's pixels must have a positive size")
    return found


def product_manifest(run_id: str, raster: dict, bounds_wgs84, tiles: dict | None) -> dict:
    """A run's raster, tiles and contract files."""
    same = {name: raster[name] for name in ("dataset", "source", "crs", "bounds", "width", "height", "geotiff_path", "cog_path", "geotiff_bytes", "cog_bytes")}
    pixel = [raster["pixel_size_x"], raster["pixel_size_y"]]
    return {"run_id": run_id, **same, "bounds_wgs84": list(bounds_wgs84), "pixel_size": pixel, "gsd": pixel[0], "tiles": tiles, "contract": dict(CONTRACT)}
