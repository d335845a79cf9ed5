"""Plane geometry: boxes, distances, segments and projections as columns; polygons (WKB) as Arrow UDFs."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def square(x: Column, y: Column, side: Column) -> Column:
    """struct(minx, miny, maxx, maxy) around a centre."""
    h = side / 2
    return F.struct((x - h).alias("minx"), (y - h).alias("miny"), (x + h).alias("maxx"), (y + h).alias("maxy"))


def in_box(x: Column, y: Column, box: Column, pad: float = 0.0) -> Column:
    return x.between(box["minx"] - pad, box["maxx"] + pad) & y.between(box["miny"] - pad, box["maxy"] + pad)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def distance_to_box(x: Column, y: Column, box: Column) -> Column:
    """0 inside and on the edge."""
    return F.hypot(F.greatest(box["minx"] - x, F.lit(0.0), x - box["maxx"]), F.greatest(box["miny"] - y, F.lit(0.0), y - box["maxy"]))


def box_area(b: Column) -> Column:
    return (b["maxx"] - b["minx"]) * (b["maxy"] - b["miny"])


def box_overlap(a: Column, b: Column) -> Column:
    """Shared area; 0 for boxes that only touch."""
    w = F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"])
    h = F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_iou(a: Column, b: Column) -> Column:
    shared = box_overlap(a, b)
    whole = box_area(a) + box_area(b) - shared
    return F.when(whole > 0, shared / whole).otherwise(F.lit(0.0))


def along_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on the segment the nearest point lies, from 0 at a to 1 at b; 0 for a segment of no length."""
    dx, dy = bx - ax, by - ay
    norm = dx * dx + dy * dy
    return F.when(norm == 0, 0.0).otherwise(F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / norm, F.lit(0.0)), F.lit(1.0)))


def distance_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = along_segment(px, py, ax, ay, bx, by)
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def web_mercator(lon: Column, lat: Column) -> Column:
    """struct(x, y) in metres."""
    r = 6378137.0
    return F.struct((F.radians(lon) * r).alias("x"), (F.ln(F.tan(F.radians(lat) / 2 + F.pi() / 4)) * r).alias("y"))


def map_tile(lon: Column, lat: Column, zoom: int) -> Column:
    """struct(x, y) of the map tile that holds a place."""
    n = float(1 << zoom)
    return F.struct(F.floor((lon + 180) / 360 * n).alias("x"), F.floor((1 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2 * n).alias("y"))


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371008.8 * F.asin(F.sqrt(a))


def rings(wkb: bytes | None) -> list[np.ndarray]:
    """The rings of a WKB polygon or multipolygon, shells and holes alike; none for null, damaged or other geometries."""
    try:
        return _rings(wkb, 0)[0] if wkb else []
    except (struct.error, ValueError, IndexError):
        return []


def _rings(b: bytes, at: int) -> tuple[list[np.ndarray], int]:
    order = "<" if b[at] == 1 else ">"
    kind = struct.unpack_from(order + "I", b, at + 1)[0]
    at += 5
    if kind & 0x20000000:
        at += 4
    dims = 2 + ((kind & 0xFFFF) // 1000 in (1, 2)) + 2 * ((kind & 0xFFFF) // 1000 == 3)
    base = (kind & 0xFFFF) % 1000
    out: list[np.ndarray] = []
    n = struct.unpack_from(order + "I", b, at)[0]
    at += 4
    if base == 3:
        for _ in range(n):
            m = struct.unpack_from(order + "I", b, at)[0]
            at += 4
            out.append(np.frombuffer(b, order + "f8", m * dims, at).reshape(m, dims)[:, :2])
            at += 8 * m * dims
    elif base == 6:
        for _ in range(n):
            part, at = _rings(b, at)
            out += part
    else:
        raise ValueError("not a polygon")
    return out, at


def contains(parts: list[np.ndarray], x: float, y: float) -> bool:
    """Even-odd rule over all rings, so holes count; points on an edge are inside."""
    inside = False
    for r in parts:
        ax, ay, bx, by = r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1]
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if bool(np.any((cross == 0) & (np.minimum(ax, bx) <= x) & (x <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by)))):
            return True
        spans = (ay > y) != (by > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            inside ^= bool(np.count_nonzero(spans & (x < (bx - ax) * (y - ay) / (by - ay) + ax)) % 2)
    return inside


def shape(wkb: Column) -> Column:
    """struct(area, perimeter, minx, miny, maxx, maxy, parts) of polygons; null where there is none. Holes count against the area."""
    fields = ("area", "perimeter", "minx", "miny", "maxx", "maxy", "parts")

    @F.pandas_udf("area double, perimeter double, minx double, miny double, maxx double, maxy double, parts int")
    def measure(col: pd.Series) -> pd.DataFrame:
        rows = []
        for b in col:
            parts = rings(None if b is None else bytes(b))
            if not parts:
                rows.append((None,) * 7)
                continue
            signed = [float(np.sum(r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1])) / 2 for r in parts]
            shells = sum(1 for i, r in enumerate(parts) if not any(contains([o], *r[0]) and abs(signed[j]) > abs(signed[i]) for j, o in enumerate(parts) if j != i))
            area = sum(abs(s) * (1 if not any(j != i and abs(signed[j]) > abs(s) and contains([o], *r[0]) for j, o in enumerate(parts)) else -1) for i, (s, r) in enumerate(zip(signed, parts)))
            allp = np.concatenate(parts)
            rows.append((area, sum(float(np.hypot(*np.diff(r, axis=0).T).sum()) for r in parts), *map(float, allp.min(0)), *map(float, allp.max(0)), shells))
        return pd.DataFrame(rows, columns=fields)

    return measure(wkb)


def national_grid(lon: Column, lat: Column) -> Column:
    """struct(easting, northing) of a place on the Airy ellipsoid in the national transverse Mercator projection, metres.

    Without a change of datum: for GPS coordinates that is some 100 m off; give coordinates in the national datum.
    """
    # The ellipsoid's axes, the scale and the true origin of the projection.
    a, b, f0, e0, n0 = 6377563.396, 6356256.909, 0.9996012717, 400000.0, -100000.0
    phi0, lam0 = 49 * 3.141592653589793 / 180, -2 * 3.141592653589793 / 180
    e2, n = 1 - (b / a) ** 2, (a - b) / (a + b)
    p, lam = F.radians(lat), F.radians(lon) - lam0
    s, c, t = F.sin(p), F.cos(p), F.tan(p)
    nu = a * f0 / F.sqrt(1 - e2 * s * s)
    rho = a * f0 * (1 - e2) / F.pow(1 - e2 * s * s, 1.5)
    eta = nu / rho - 1
    d, q = p - phi0, p + phi0
    arc = b * f0 * (
        (1 + n + 5 / 4 * n**2 + 5 / 4 * n**3) * d - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(d) * F.cos(q)
        + (15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * d) * F.cos(2 * q) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * q)
    )
    north = arc + n0 + nu / 2 * s * c * F.pow(lam, 2) + nu / 24 * s * F.pow(c, 3) * (5 - t * t + 9 * eta) * F.pow(lam, 4) + nu / 720 * s * F.pow(c, 5) * (61 - 58 * t * t + F.pow(t, 4)) * F.pow(lam, 6)
    east = e0 + nu * c * lam + nu / 6 * F.pow(c, 3) * (nu / rho - t * t) * F.pow(lam, 3) + nu / 120 * F.pow(c, 5) * (5 - 18 * t * t + F.pow(t, 4) + 14 * eta - 58 * t * t * eta) * F.pow(lam, 5)
    return F.struct(east.alias("easting"), north.alias("northing"))
