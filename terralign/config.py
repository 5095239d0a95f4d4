"""Run settings: defaults, then profile, preset and overrides. Profiles also name a machine's bounds for the session."""

from __future__ import annotations

import json
import re
import warnings
from pathlib import Path
from types import SimpleNamespace

# The hardware profiles and the quality presets.
PROFILES = {
    "pi-lite": {"max_cpus": 2, "max_ram_mb": 2048, "matching_image_max_dim": 800, "feature_limit": 1000, "tile_size": 1024, "max_cached_frames": 2, "matcher": "orb", "transform_model": "similarity", "multiband_blending": False},
    "pi-class": {"max_cpus": 4, "max_ram_mb": 4096, "matching_image_max_dim": 1000, "feature_limit": 1500, "tile_size": 2048, "max_cached_frames": 4, "matcher": "akaze", "transform_model": "affine", "multiband_blending": False},
    "jetson-class": {"max_cpus": 6, "max_ram_mb": 8192, "matching_image_max_dim": 1200, "feature_limit": 2500, "tile_size": 2048, "max_cached_frames": 8, "matcher": "sift", "transform_model": "homography", "multiband_blending": True},
    "laptop": {"max_cpus": None, "max_ram_mb": None, "matching_image_max_dim": 1200, "feature_limit": 3000, "tile_size": 2048, "max_cached_frames": 16, "matcher": "sift", "transform_model": "affine", "multiband_blending": False},
}
PRESETS = {
    "fast": {"matcher": "orb", "feature_limit": 1000, "matching_image_max_dim": 800, "k_neighbors": 4, "max_neighbor_distance_m": 60.0, "transform_model": "similarity", "ransac_thresh_px": 5.0, "blend_mode": "feather", "feather_radius_px": 15, "exposure_compensation": False},
    "balanced": {"matcher": "akaze", "feature_limit": 1500, "matching_image_max_dim": 1000, "k_neighbors": 6, "max_neighbor_distance_m": 80.0, "transform_model": "affine", "ransac_thresh_px": 4.0, "blend_mode": "feather", "feather_radius_px": 25, "exposure_compensation": True},
    "quality": {"matcher": "sift", "feature_limit": 3000, "matching_image_max_dim": 1400, "k_neighbors": 8, "max_neighbor_distance_m": 100.0, "transform_model": "homography", "ransac_thresh_px": 3.0, "blend_mode": "multiband", "feather_radius_px": 35, "exposure_compensation": True, "multiband_blending": True},
}


# All settings and their defaults.
DEFAULTS = {
    "profile_name": "pi-class", "preset_name": "balanced", "pitch_nadir_threshold": -45.0, "matcher": "akaze", "feature_limit": 1500, "matching_image_max_dim": 1000, "ratio_test_threshold": 0.75,
    "k_neighbors": 6, "max_neighbor_distance_m": 80.0, "transform_model": "affine", "ransac_thresh_px": 4.0, "min_inliers": 15, "gps_prior_weight": 0.05, "tile_size": 2048, "blend_mode": "feather",
    "feather_radius_px": 25, "exposure_compensation": True, "output_resolution_factor": 1.0, "multiband_blending": False, "generate_cog": True, "generate_tiles": True, "tile_min_zoom": None,
    "tile_max_zoom": None, "max_cpus": 4, "max_ram_mb": 4096, "max_cached_frames": 4,
}


class RunConfig(SimpleNamespace):
    """The settings of a run, by the names of DEFAULTS."""

    def __init__(self, **chosen):
        super().__init__(**DEFAULTS | chosen)


def read_settings(path: str) -> dict:
    """The `name: value` lines of a flat YAML file; {} if there is no file. Comments, quotes, numbers, booleans and null are known."""
    file = Path(path)
    found: dict = {}
    for line in file.read_text(encoding="utf-8").splitlines() if file.is_file() else ():
        name, colon, value = line.partition(":")
        value = re.sub(r"(^|\s)#.*$", "", value).strip()
        if not colon or not name.strip() or name.lstrip().startswith("#") or name != name.lstrip():
            continue
        if value[:1] in ("'", '"') and value[-1:] == value[:1]:
            found[name.strip()] = value[1:-1]
        else:
            try:
                found[name.strip()] = json.loads({"": "null", "~": "null"}.get(value, value.lower() if value.lower() in ("true", "false", "null") else value))
            except ValueError:
                found[name.strip()] = value
    return found


def named_settings(folder: str | None, name: str, known: dict[str, dict]) -> dict:
    """The settings under a name: those of a file in the folder (name.yaml, a hyphen or an underscore alike), else the known ones."""
    for spelling in (name, name.replace("-", "_")) if folder else ():
        if found := read_settings(f"{folder}/{spelling}.yaml"):
            return found
    return known.get(name, {})


def build_config(profile: str = "pi-class", preset: str = "balanced", overrides: dict | None = None, profiles_dir: str | None = None, presets_dir: str | None = None) -> RunConfig:
    """Later layers win; overrides of None count as absent; unknown names are reported and left out."""
    merged: dict = {"profile_name": profile, "preset_name": preset}
    chosen = {k: v for k, v in (overrides or {}).items() if v is not None}
    for layer in (named_settings(profiles_dir, profile, PROFILES), named_settings(presets_dir, preset, PRESETS), chosen):
        for key, value in layer.items():
            if key in DEFAULTS:
                merged[key] = value
            else:
                warnings.warn(f"unknown setting: {key}", stacklevel=2)
    return RunConfig(**merged)
