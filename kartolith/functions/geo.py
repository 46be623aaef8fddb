"""Spherical lengths, Web-Mercator tiles and cells, Z-order codes and UTM areas.

Points are lon/lat columns, lines are ``array<struct<x,y>>`` in degrees.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EARTH = 6_378_137.0
MAX_LAT = 85.0511287798066


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH) -> Column:
    """Metres between two points; null if a coordinate is null."""
    dphi, dlam = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlam / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a)))


def line_length(line: Column) -> Column:
    """Metres along a line; 0 for null and for fewer than two vertices."""
    n = F.size(line)
    pairs = F.arrays_zip(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))
    length = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + haversine(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]))
    return F.when(n >= 2, length).otherwise(0.0)


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180.0) / 360.0 * float(1 << zoom)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    phi = F.radians(lat)
    return F.floor((1.0 - F.ln(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * float(1 << zoom)).cast("long")


def in_grid(x: Column, y: Column, zoom: int) -> Column:
    last = (1 << zoom) - 1
    return x.between(0, last) & y.between(0, last)


def zorder(col: Column, row: Column, bits: int) -> Column:
    """Interleaved bits, the column's being the lower of each pair."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(col, i).bitwiseAND(F.lit(1)).cast("long"), 2 * i))
        out = out.bitwiseOR(F.shiftleft(F.shiftright(row, i).bitwiseAND(F.lit(1)).cast("long"), 2 * i + 1))
    return out


def cell_centre(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """Longitude and latitude of the middle of a cell of the grid at ``zoom``."""
    n = float(1 << zoom)
    return (x + 0.5) / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * (y + 0.5) / n))))


def utm_xy(lon: np.ndarray, lat: np.ndarray, zone: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transverse Mercator of one zone, or of a zone a point (Krueger series, WGS 84)."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = EARTH / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = np.radians(lat), np.radians(lon) - np.radians(zone * 6.0 - 183.0)
    k = 2 * math.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(np.sin(phi)) - k * np.arctanh(k * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    x = eta + sum(c * np.cos(2 * (j + 1) * xi) * np.sinh(2 * (j + 1) * eta) for j, c in enumerate(alpha))
    y = xi + sum(c * np.sin(2 * (j + 1) * xi) * np.cosh(2 * (j + 1) * eta) for j, c in enumerate(alpha))
    return 500_000 + 0.9996 * a * x, 0.9996 * a * y


def ring_area(xs: np.ndarray, ys: np.ndarray) -> float:
    return abs(float(np.dot(xs, np.roll(ys, -1)) - np.dot(ys, np.roll(xs, -1)))) / 2


@F.arrow_udf(DoubleType())
def utm_area(rings: pa.Array) -> pa.Array:
    """Square metres of a ring of ``struct<x,y>`` in the zone of its centroid; 0 for null, fewer than 3 vertices or a null vertex."""
    n = np.diff(rings.offsets.to_numpy().astype(np.int64)) if len(rings) else np.zeros(0, np.int64)
    n = np.where(np.asarray(rings.is_null()), 0, n)
    flat = rings.flatten()
    x, y = (np.asarray(flat.field(k).to_numpy(zero_copy_only=False), float) for k in (0, 1))
    row = np.repeat(np.arange(len(n)), n)
    bad = np.bincount(row, ~(np.isfinite(x) & np.isfinite(y)), len(n)) > 0
    x, y = np.nan_to_num(x), np.nan_to_num(y)
    mean = np.bincount(row, x, len(n)) / np.maximum(n, 1)
    zone = np.clip((mean + 180) // 6 + 1, 1, 60)
    east, north = utm_xy(x, y, zone[row])
    after = np.arange(len(row)) + 1
    last = np.cumsum(n)[n > 0] - 1
    after[last] = last - n[n > 0] + 1
    east, north = east - np.repeat(_firsts(east, n), n), north - np.repeat(_firsts(north, n), n)  # near the origin: no digits lost
    area = np.abs(np.bincount(row, east * north[after] - north * east[after], len(n))) / 2
    return pa.array(np.where((n < 3) | bad, 0.0, area))


def _firsts(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first value of every run of n[i] values, 0 for an empty one."""
    out = np.zeros(len(n))
    out[n > 0] = v[(np.cumsum(n) - n)[n > 0]]
    return out


def quad_address(x0: Column, y0: Column, x1: Column, y1: Column, levels: int = 24) -> Column:
    """Digits 0-3 of the quad-tree cells in the unit square that hold the whole envelope, coarse to fine."""
    n = float(1 << levels)
    cell = lambda v: F.least(F.greatest(F.floor(v * n), F.lit(0)), F.lit((1 << levels) - 1)).cast("long")
    a, b = zorder(cell(x0), cell(y0), levels), zorder(cell(x1), cell(y1), levels)
    digits = lambda z: F.concat(*[F.shiftright(z, 2 * i).bitwiseAND(F.lit(3)).cast("string") for i in reversed(range(levels))])
    same = F.coalesce(F.array_min(F.array_compact(F.array(*[F.when(F.shiftright(a, 2 * (levels - i)) != F.shiftright(b, 2 * (levels - i)), F.lit(i - 1)) for i in range(1, levels + 1)]))), F.lit(levels))
    return F.substring(digits(a), F.lit(1), same)
