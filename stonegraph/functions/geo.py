"""Coordinates, distances, national grids and hexagonal cells as Spark expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_KM = 6371.0
COORDINATE = r"(-?\d+(?:\.\d+)?)\s*[,;]\s*(-?\d+(?:\.\d+)?)\s*(.*)$"

# Boxes (south, north, west, east).
COUNTRY_BOXES = {"Ireland": (51.3, 55.5, -10.8, -5.9), "Northern Ireland": (53.9, 55.4, -8.3, -5.3), "Scotland": (54.5, 61.0, -8.7, -0.7), "Wales": (51.3, 53.5, -5.4, -2.6), "England": (49.8, 55.9, -6.5, 1.9), "Isle of Man": (54.0, 54.5, -4.9, -4.2)}
IN_SITU = "church|chapel|graveyard|cemetery|abbey|cathedral|eaglais|capel|llan"

# Ellipsoids (a, b) and projections.
AIRY_MODIFIED = (6377340.189, 6356034.447)
GRS80 = (6378137.0, 6356752.314140)
IRISH_GRID = {"axes": AIRY_MODIFIED, "scale": 1.000035, "lat0": 53.5, "lon0": -8.0, "east0": 200000.0, "north0": 250000.0}
ITM = {"axes": GRS80, "scale": 0.99982, "lat0": 53.5, "lon0": -8.0, "east0": 600000.0, "north0": 750000.0}
IRELAND_1965_SHIFT = {"t": (482.530, -130.596, 564.557), "r": (-1.042, -0.214, -0.631), "ppm": 8.150}


def parse_coordinate(raw: Column) -> Column:
    """struct(lat, lon, hedge) of the first pair of numbers; (null, null, the text) without one on the earth."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    lat, lon = (F.nullif(F.regexp_extract(t, COORDINATE, k), F.lit("")).cast("double") for k in (1, 2))
    ok = F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    hedge = F.regexp_replace(F.regexp_extract(t, COORDINATE, 3), r"^[ ()]+|[ ()]+$", "")
    return F.struct(F.when(ok, lat).alias("lat"), F.when(ok, lon).alias("lon"), F.when(ok, hedge).otherwise(t).alias("hedge"))


def coordinate_status(raw: Column, cert: Column, parsed: Column, supplied: Column | None = None) -> Column:
    """missing, textual_only, qualified (a doubt is marked or follows), asserted, or supplied (filled in from elsewhere)."""
    if supplied is not None:
        return F.when(supplied, "supplied").otherwise(coordinate_status(raw, cert, parsed))
    blank = F.coalesce(F.trim(raw), F.lit("")) == ""
    return F.when(parsed["lat"].isNull() & blank, "missing").when(parsed["lat"].isNull(), "textual_only").when((F.coalesce(cert, F.lit("")) != "") | (parsed["hedge"] != ""), "qualified").otherwise("asserted")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def in_country(lat: Column, lon: Column, country: Column) -> Column:
    """Whether a point is in its country's box; true for countries without one."""
    test = F.lit(True)
    for name, (s, n, w, e) in COUNTRY_BOXES.items():
        test = F.when(country == name, lat.between(s, n) & lon.between(w, e)).otherwise(test)
    return test


def looks_in_situ(name: Column) -> Column:
    return F.lower(name).rlike(IN_SITU)


def wkt_point(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def grid_reference(ref: Column) -> Column:
    """struct(east, north): the centre of the square of an Irish Grid reference; null if it isn't one."""
    t = F.upper(F.regexp_replace(ref, r"\s+", ""))
    at = F.position(F.substring(t, 1, 1), F.lit("ABCDEFGHJKLMNOPQRSTUVWXYZ")) - 1
    half = F.floor((F.length(t) - 1) / 2)
    step = F.pow(F.lit(10.0), 5 - half)
    ok = t.rlike(r"^[A-HJ-Z](\d\d){0,5}$")
    east, north = F.substr(t, F.lit(2), half), F.substr(t, half + 2, half)

    def metres(square: Column, digits: Column) -> Column:
        return square * 100000.0 + F.coalesce(F.nullif(digits, F.lit("")).cast("double"), F.lit(0.0)) * step + F.floor(step / 2)

    return F.when(ok, F.struct(metres(at % 5, east).alias("east"), metres(4 - F.floor(at / 5), north).alias("north")))


def transverse_mercator_inverse(east: np.ndarray, north: np.ndarray, grid: dict, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude in degrees. The footpoint latitude is refined ``rounds`` times, which is exact to well under a millimetre on these grids; the series after it is the usual one in powers of the easting."""
    a, b = grid["axes"]
    scale, lat0 = grid["scale"], math.radians(grid["lat0"])
    e2, n = 1 - b * b / (a * a), (a - b) / (a + b)
    arc = [1 + n + 1.25 * n**2 + 1.25 * n**3, 3 * n + 3 * n**2 + 2.625 * n**3, 1.875 * (n**2 + n**3), 35 / 24 * n**3]
    y = north - grid["north0"]
    lat = y / (a * scale) + lat0
    for _ in range(rounds):
        d, s = lat - lat0, lat + lat0
        meridian = b * scale * (arc[0] * d - arc[1] * np.sin(d) * np.cos(s) + arc[2] * np.sin(2 * d) * np.cos(2 * s) - arc[3] * np.sin(3 * d) * np.cos(3 * s))
        lat = lat + (y - meridian) / (a * scale)
    s2, t2 = np.sin(lat) ** 2, np.tan(lat) ** 2
    nu = a * scale / np.sqrt(1 - e2 * s2)
    ratio = (1 - e2 * s2) / (1 - e2)  # of the two radii of curvature
    eta, x = ratio - 1, (east - grid["east0"]) / nu
    up = np.tan(lat) * ratio * (x**2 / 2 - x**4 / 24 * (5 + 3 * t2 + eta - 9 * t2 * eta) + x**6 / 720 * (61 + 90 * t2 + 45 * t2**2))
    along = (x - x**3 / 6 * (ratio + 2 * t2) + x**5 / 120 * (5 + 28 * t2 + 24 * t2**2) - x**7 / 5040 * (61 + 662 * t2 + 1320 * t2**2 + 720 * t2**3)) / np.cos(lat)
    return np.degrees(lat - up), np.degrees(along) + grid["lon0"]


def datum_shift(lat: np.ndarray, lon: np.ndarray, source: tuple, target: tuple, shift: dict, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude on the target ellipsoid, by the seven-parameter shift."""
    (a1, b1), (a2, b2) = source, target
    e1, e2 = 1 - b1 * b1 / (a1 * a1), 1 - b2 * b2 / (a2 * a2)
    lat, lon = np.radians(lat), np.radians(lon)
    nu = a1 / np.sqrt(1 - e1 * np.sin(lat) ** 2)
    old = np.stack([nu * np.cos(lat) * np.cos(lon), nu * np.cos(lat) * np.sin(lon), (1 - e1) * nu * np.sin(lat)])
    (rx, ry, rz), k = (math.radians(r / 3600) for r in shift["r"]), 1 + shift["ppm"] / 1e6
    x, y, z = np.array([[k, -rz, ry], [rz, k, -rx], [-ry, rx, k]]) @ old + np.array(shift["t"])[:, None]
    p = np.hypot(x, y)
    at = np.arctan2(z, p * (1 - e2))
    for _ in range(rounds):
        at = np.arctan2(z + e2 * a2 / np.sqrt(1 - e2 * np.sin(at) ** 2) * np.sin(at), p)
    return np.degrees(at), np.degrees(np.arctan2(y, x))


POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])


@F.pandas_udf(POINT)
def itm_to_wgs84(east: pd.Series, north: pd.Series) -> pd.DataFrame:
    lat, lon = transverse_mercator_inverse(east.to_numpy(float), north.to_numpy(float), ITM)
    return pd.DataFrame({"lat": lat, "lon": lon})


@F.pandas_udf(POINT)
def _irish_grid(east: pd.Series, north: pd.Series) -> pd.DataFrame:
    lat, lon = datum_shift(*transverse_mercator_inverse(east.to_numpy(float), north.to_numpy(float), IRISH_GRID), AIRY_MODIFIED, GRS80, IRELAND_1965_SHIFT)
    return pd.DataFrame({"lat": lat, "lon": lon})


def irish_grid_to_wgs84(ref: Column) -> Column:
    """struct(lat, lon) of a reference's square; of nulls if it isn't one."""
    square = grid_reference(ref)
    return _irish_grid(square["east"], square["north"])


def hex_cell(lon: Column, lat: Column, stretch: Column, size: float) -> Column:
    """struct(q, r): the axial cell of a point; ``stretch`` is 1 / cos(mean latitude)."""
    x, y = lon, lat * stretch
    q, r = x * (2.0 / 3) / size, x * (-1.0 / 3) / size + y * (math.sqrt(3) / 3) / size
    s = -q - r
    rq, rr, rs = (F.floor(v + 0.5) for v in (q, r, s))
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    first = (dq > ds) & (dq > dr)
    return F.struct(F.when(first, -rs - rr).otherwise(rq).alias("q"), F.when(~first & ~(ds > dr), -rq - rs).otherwise(rr).alias("r"))


def hex_polygon(q: Column, r: Column, stretch: Column, size: float) -> Column:
    cx, cy = q * (1.5 * size), (r + q / 2) * (size * math.sqrt(3))
    corners = [math.radians(60 * k) for k in range(6)]
    return F.array(*(F.struct(((cy + size * math.sin(a)) / stretch).alias("lat"), (cx + size * math.cos(a)).alias("lon")) for a in corners))


STEPS = 5


def hex_band(n: Column, most: Column, scale: str = "log") -> Column:
    """The colour step, 0 to 4, of a count among counts up to ``most``."""
    t = F.ln(n) / F.ln(most) if scale == "log" else (n - 1) / most
    return F.when(most <= 1, 0).otherwise(F.least(F.floor(t * STEPS), F.lit(STEPS - 1))).cast("int")


def arc(lat1: Column, lon1: Column, lat2: Column, lon2: Column, bend: float = 0.15, points: int = 25) -> Column:
    """Points of a quadratic curve between two places, bent to one side."""
    mlat, mlon = (lat1 + lat2) / 2 + bend * (lon2 - lon1), (lon1 + lon2) / 2 - bend * (lat2 - lat1)

    def at(t: Column) -> Column:
        u = 1 - t
        return F.struct((u * u * lat1 + 2 * u * t * mlat + t * t * lat2).alias("lat"), (u * u * lon1 + 2 * u * t * mlon + t * t * lon2).alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: at(k / float(points - 1)))
