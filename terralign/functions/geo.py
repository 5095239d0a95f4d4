"""Geodesy as Column expressions: distances, UTM by Krüger series, web-map tiles. All stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radius for distances, metres per degree of the fallback, and the WGS84 ellipsoid.
EARTH_M = 6_371_000.0
M_PER_DEG_LON, M_PER_DEG_LAT = 111_320.0, 110_540.0
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563
MERCATOR_HALF, MERCATOR_MAX_LAT = 20_037_508.34, 85.05112878
UTM_K0, UTM_E0, UTM_N0 = 0.9996, 500_000.0, 10_000_000.0

_N = WGS84_F / (2 - WGS84_F)
_A = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krüger's coefficients to the third order in the third flattening.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_ECC = 2 * math.sqrt(_N) / (1 + _N)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def local_plane(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin, on the tangent plane at the mean latitude."""
    return EARTH_M * F.radians(lon - lon0) * F.cos(F.radians((lat + lat0) / 2)), EARTH_M * F.radians(lat - lat0)


def degree_metres(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Rough metres from degrees, for rows without a projected position."""
    return lon * M_PER_DEG_LON * F.cos(F.radians(lat)), lat * M_PER_DEG_LAT


def utm_zone(lon: Column) -> Column:
    return F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6).cast("int") + 1))


def utm_epsg(lat: Column, lon: Column) -> Column:
    return utm_zone(lon) + F.when(lat >= 0, 32600).otherwise(32700)


def to_utm(lat: Column, lon: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing in the given UTM system."""
    south = epsg >= 32700
    zone = epsg - F.when(south, 32700).otherwise(32600)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - _ECC * F.atanh(_ECC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1)), F.lit(0.0))
    north = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1)), F.lit(0.0))
    return UTM_E0 + UTM_K0 * _A * east, F.when(south, UTM_N0).otherwise(0.0) + UTM_K0 * _A * north


def from_utm(easting: Column, northing: Column, epsg: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a UTM position."""
    south = epsg >= 32700
    zone = epsg - F.when(south, 32700).otherwise(32600)
    xi0 = (northing - F.when(south, UTM_N0).otherwise(0.0)) / (UTM_K0 * _A)
    eta0 = (easting - UTM_E0) / (UTM_K0 * _A)
    xi = xi0 - sum((b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0) for j, b in enumerate(_BETA, 1)), F.lit(0.0))
    eta = eta0 - sum((b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0) for j, b in enumerate(_BETA, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1)), F.lit(0.0))
    return F.degrees(lat), zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))


def _mercator_y(lat: Column) -> Column:
    """From 1 at the north edge of the square map to -1 at its south edge."""
    return F.asinh(F.tan(F.radians(lat))) / math.pi


def slippy_tile(lat: Column, lon: Column, zoom: Column) -> tuple[Column, Column]:
    """Tile column and row, cut towards zero, not clamped."""
    n = F.pow(F.lit(2.0), zoom)
    return ((lon + 180.0) / 360.0 * n).cast("long"), ((1.0 - _mercator_y(lat)) / 2.0 * n).cast("long")


def clamped_tile(lat: Column, lon: Column, zoom: Column) -> tuple[Column, Column]:
    """Tile column and row with the latitude and both numbers held inside the map."""
    x, y = slippy_tile(F.least(F.lit(MERCATOR_MAX_LAT), F.greatest(F.lit(-MERCATOR_MAX_LAT), lat)), lon, zoom)
    last = (F.pow(F.lit(2.0), zoom) - 1).cast("long")
    return F.greatest(F.lit(0), F.least(last, x)), F.greatest(F.lit(0), F.least(last, y))


def tile_bounds(x: Column, y: Column, zoom: Column) -> dict[str, Column]:
    """West, south, east and north of a tile in degrees."""
    n = F.pow(F.lit(2.0), zoom)
    north = lambda row: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * row / n))))
    return {"west": x / n * 360.0 - 180.0, "south": north(y + 1), "east": (x + 1) / n * 360.0 - 180.0, "north": north(y)}


def to_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    half = F.lit(MERCATOR_HALF)
    return lon * half / 180.0, F.log(F.tan((90 + lat) * math.pi / 360.0)) / (math.pi / 180.0) * half / 180.0


def natural_zoom(metres_per_pixel: Column) -> Column:
    zoom = F.bround(F.log2(F.lit(156543.03392) / F.greatest(metres_per_pixel, F.lit(0.05))))
    return F.greatest(F.lit(14), F.least(F.lit(19), zoom.cast("int")))


def zoom_range(metres_per_pixel: Column) -> tuple[Column, Column]:
    """Least and greatest zoom of a raster's tiles."""
    natural = natural_zoom(metres_per_pixel)
    least = F.greatest(F.lit(14), natural - 1)
    return least, F.greatest(least, F.least(F.lit(19), natural))


def dms_to_degrees(dms: Column, ref: Column) -> Column:
    """Degrees of [degrees, minutes, seconds]; S and W count as negative; null unless there are three numbers."""
    value = F.get(dms, 0) + F.get(dms, 1) / 60.0 + F.get(dms, 2) / 3600.0
    return F.when(F.upper(F.trim(ref)).isin("S", "W"), -value).otherwise(value)


def normalised_yaw(yaw: Column) -> Column:
    return F.pmod(yaw.cast("double"), F.lit(360.0))


def checked_position(lat: Column, lon: Column) -> Column:
    """The position as a struct (lat, lon); an error for a latitude beyond 90 or a longitude beyond 180 degrees."""
    wrong = lambda c, what: F.raise_error(F.concat(F.lit(f"{what} out of range: "), c.cast("string")))
    far = lambda c, limit: ~c.between(-limit, limit)
    return F.when(far(lat, 90.0), wrong(lat, "latitude")).when(far(lon, 180.0), wrong(lon, "longitude")).otherwise(F.struct(lat.alias("lat"), lon.alias("lon")))


def _box(west: Column, south: Column, east: Column, north: Column, what: str) -> Column:
    """A box as a struct; an error where there was nothing to bound, or where it has no area."""
    box = F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"))
    empty = F.raise_error(F.lit(f"at least one {what} is required"))
    return F.when(west.isNull(), empty).when((west >= east) | (south >= north), F.raise_error(F.lit("bounds must have positive width and height"))).otherwise(box)


def positions_box(lat: Column, lon: Column, around: float = 0.0001) -> Column:
    """The box of all positions (an aggregate), with a margin in degrees."""
    at = checked_position(lat, lon)
    x, y = at["lon"], at["lat"]
    return _box(F.min(x) - around, F.min(y) - around, F.max(x) + around, F.max(y) + around, "geotagged frame")


def projected_box(x: Column, y: Column, padding_m: float = 0.0) -> Column:
    """The box of all projected points (an aggregate), with a margin in metres; ValueError for a negative one."""
    if padding_m < 0:
        raise ValueError("the padding must not be negative")
    return _box(F.min(x) - padding_m, F.min(y) - padding_m, F.max(x) + padding_m, F.max(y) + padding_m, "projected point")
