"""Projections of the ellipsoid: UTM (Krüger's series), LAEA Europe, the cylindrical equal-area one, and Equi7 Europe (azimuthal
equidistant, by the series of geodesics).

Each formula exists once, over a small table of functions, so that it serves Columns in a plan, arrays in a task and floats on
the driver.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.grid import ECC2, SEMI_MAJOR


class CRSError(ValueError):
    """The coordinate system is not one of those with a closed form here."""


PLAIN = SimpleNamespace(
    sin=math.sin, cos=math.cos, atan=math.atan, atanh=math.atanh, asin=math.asin, sinh=math.sinh, cosh=math.cosh, sqrt=math.sqrt,
    log=math.log, radians=math.radians, degrees=math.degrees, lit=float, atan2=math.atan2,
)
COLUMNS = SimpleNamespace(
    sin=F.sin, cos=F.cos, atan=F.atan, atanh=F.atanh, asin=F.asin, sinh=F.sinh, cosh=F.cosh, sqrt=F.sqrt, log=F.log, radians=F.radians,
    degrees=F.degrees, lit=F.lit, atan2=F.atan2,
)
ARRAYS = SimpleNamespace(
    sin=np.sin, cos=np.cos, atan=np.arctan, atanh=np.arctanh, asin=np.arcsin, sinh=np.sinh, cosh=np.cosh, sqrt=np.sqrt, log=np.log,
    radians=np.radians, degrees=np.degrees, lit=float, atan2=np.arctan2,
)

_F = 1 / 298.257223563
_N = _F / (2 - _F)
_A = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
    7 * _N**2 / 3 - 8 * _N**3 / 5,
    56 * _N**3 / 15,
)
_SCALE, _EAST, _SOUTH = 0.9996, 500_000.0, 10_000_000.0
_CONFORMAL = 2 * math.sqrt(_N) / (1 + _N)


def utm_zone(lon: float, lat: float) -> int:
    """The EPSG code of the zone that holds a point."""
    return (32600 if lat >= 0 else 32700) + min(max(int((lon + 180) // 6) + 1, 1), 60)


def transverse(lon, lat, middle, m=COLUMNS):
    """(x, y) in metres of the ellipsoid's transverse Mercator projection around a meridian, unscaled; middle is a number or a Column."""
    s, away = m.sin(m.radians(lat)), m.radians(lon - (m.lit(float(middle)) if isinstance(middle, int | float) else middle))
    t = m.sinh(m.atanh(s) - m.lit(_CONFORMAL) * m.atanh(m.lit(_CONFORMAL) * s))
    xi, eta = m.atan(t / m.cos(away)), m.atanh(m.sin(away) / m.sqrt(m.lit(1.0) + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + m.lit(a) * m.cos(m.lit(2.0 * j) * xi) * m.sinh(m.lit(2.0 * j) * eta)
        north = north + m.lit(a) * m.sin(m.lit(2.0 * j) * xi) * m.cosh(m.lit(2.0 * j) * eta)
    return m.lit(_A) * east, m.lit(_A) * north


def untransverse(x, y, middle, m=COLUMNS):
    """The position in degrees of a point of `transverse`, by the inverse series."""
    xi, eta = y / m.lit(_A), x / m.lit(_A)
    up, along = xi, eta
    for j, b in enumerate(_BETA, 1):
        up = up - m.lit(b) * m.sin(m.lit(2.0 * j) * xi) * m.cosh(m.lit(2.0 * j) * eta)
        along = along - m.lit(b) * m.cos(m.lit(2.0 * j) * xi) * m.sinh(m.lit(2.0 * j) * eta)
    chi = m.asin(m.sin(up) / m.cosh(along))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + m.lit(d) * m.sin(m.lit(2.0 * j) * chi)
    lon = m.degrees(m.atan2(m.sinh(along), m.cos(up)))
    return lon + (m.lit(float(middle)) if isinstance(middle, int | float) else middle), m.degrees(lat)


def to_utm(lon, lat, epsg: int, m=COLUMNS):
    """(easting, northing) in metres of a position in degrees."""
    east, north = transverse(lon, lat, (epsg % 100) * 6 - 183, m)
    return m.lit(_EAST) + m.lit(_SCALE) * east, m.lit(_SOUTH if epsg // 100 == 327 else 0.0) + m.lit(_SCALE) * north


def _q(lat, m):
    e, s = math.sqrt(ECC2), m.sin(m.radians(lat))
    return m.lit(1 - ECC2) * (s / (m.lit(1.0) - m.lit(ECC2) * s * s) - m.log((m.lit(1.0) - m.lit(e) * s) / (m.lit(1.0) + m.lit(e) * s)) / m.lit(2 * e))


def to_equal_area(lon, lat, m=COLUMNS):
    """(x, y) of EPSG:6933."""
    k = math.cos(math.radians(30)) / math.sqrt(1 - ECC2 * math.sin(math.radians(30)) ** 2)
    return m.lit(SEMI_MAJOR * k) * m.radians(lon), m.lit(SEMI_MAJOR / (2 * k)) * _q(lat, m)


def to_laea_europe(lon, lat, m=COLUMNS):
    """(x, y) of EPSG:3035."""
    q_pole = _q(90.0, PLAIN)
    centre = math.asin(_q(52.0, PLAIN) / q_pole)
    radius = SEMI_MAJOR * math.sqrt(q_pole / 2)
    scale = SEMI_MAJOR * math.cos(math.radians(52)) / math.sqrt(1 - ECC2 * math.sin(math.radians(52)) ** 2) / (radius * math.cos(centre))
    beta, away = m.asin(_q(lat, m) / m.lit(q_pole)), m.radians(lon - m.lit(10.0))
    near = m.lit(1.0) + m.lit(math.sin(centre)) * m.sin(beta) + m.lit(math.cos(centre)) * m.cos(beta) * m.cos(away)
    b = m.lit(radius) * m.sqrt(m.lit(2.0) / near)
    x = m.lit(4_321_000.0) + b * m.lit(scale) * m.cos(beta) * m.sin(away)
    y = m.lit(3_210_000.0) + b / m.lit(scale) * (m.lit(math.cos(centre)) * m.sin(beta) - m.lit(math.sin(centre)) * m.cos(beta) * m.cos(away))
    return x, y


def from_equal_area(x, y, m=COLUMNS):
    """The position in degrees of a point of EPSG:6933."""
    k = math.cos(math.radians(30)) / math.sqrt(1 - ECC2 * math.sin(math.radians(30)) ** 2)
    return m.degrees(x / m.lit(SEMI_MAJOR * k)), _authalic(m.asin(y * m.lit(2 * k / SEMI_MAJOR / _q(90.0, PLAIN))), m)


def _authalic(beta, m):
    """The latitude in degrees of an authalic one, by its series."""
    e2, e4, e6 = ECC2, ECC2**2, ECC2**3
    series = (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040, 23 * e4 / 360 + 251 * e6 / 3780, 761 * e6 / 45360)
    lat = beta
    for j, c in enumerate(series, 1):
        lat = lat + m.lit(c) * m.sin(m.lit(2.0 * j) * beta)
    return m.degrees(lat)


def from_laea_europe(x, y, m=COLUMNS):
    """The position in degrees of a point of EPSG:3035."""
    q_pole = _q(90.0, PLAIN)
    centre = math.asin(_q(52.0, PLAIN) / q_pole)
    radius = SEMI_MAJOR * math.sqrt(q_pole / 2)
    scale = SEMI_MAJOR * math.cos(math.radians(52)) / math.sqrt(1 - ECC2 * math.sin(math.radians(52)) ** 2) / (radius * math.cos(centre))
    u, v = (x - m.lit(4_321_000.0)) / m.lit(scale), (y - m.lit(3_210_000.0)) * m.lit(scale)
    rho = m.sqrt(u * u + v * v + m.lit(1e-12))
    far = m.lit(2.0) * m.asin(rho / m.lit(2 * radius))
    beta = m.asin(m.cos(far) * m.lit(math.sin(centre)) + v * m.sin(far) * m.lit(math.cos(centre)) / rho)
    lon = m.atan2(u * m.sin(far), rho * m.lit(math.cos(centre)) * m.cos(far) - v * m.lit(math.sin(centre)) * m.sin(far))
    return m.lit(10.0) + m.degrees(lon), _authalic(beta, m)


# The origin of Equi7 Europe in degrees and in metres.
_EQUI7_LON, _EQUI7_LAT, _EQUI7_X, _EQUI7_Y = 24.0, 53.0, 5_837_287.81977, 2_121_415.69617


def from_equi7_europe(x, y, m=ARRAYS):
    """The position in degrees of a point of EPSG:27704: the end of the geodesic that leaves the origin towards it, as long as it is far.

    For numbers and arrays: each step uses the one before many times over, which makes a vast expression of Columns.
    """
    east, north = x - m.lit(_EQUI7_X), y - m.lit(_EQUI7_Y - 1e-6)  # a micrometre aside, so that the origin has an azimuth
    far = m.sqrt(east * east + north * north)
    s1, c1 = east / far, north / far  # of the azimuth
    up = math.atan((1 - _F) * math.tan(math.radians(_EQUI7_LAT)))  # the origin's reduced latitude
    s0 = s1 * m.lit(math.cos(up))
    c0 = m.sqrt(m.lit(1.0) - s0 * s0)
    start, lon1 = m.atan2(m.lit(math.sin(up)), c1 * m.lit(math.cos(up))), m.atan2(s0 * m.lit(math.sin(up)), c1 * m.lit(math.cos(up)))
    root = m.sqrt(m.lit(1.0) + m.lit(ECC2 / (1 - ECC2)) * c0 * c0)
    e = (root - m.lit(1.0)) / (root + m.lit(1.0))
    e2 = e * e
    e3, e4 = e2 * e, e2 * e2
    scale = (m.lit(1.0) + e2 / 4 + e4 / 64) / (m.lit(1.0) - e)
    length = start  # from the equator, in units of scale
    for j, c in enumerate((-e / 2 + e3 * 3 / 16, -e2 / 16 + e4 / 32, -e3 / 48, -e4 * 5 / 512), 1):
        length = length + c * m.sin(m.lit(2.0 * j) * start)
    tau = length + far / (m.lit(SEMI_MAJOR * (1 - _F)) * scale)
    end = tau
    for j, c in enumerate((e / 2 - e3 * 9 / 32, e2 * 5 / 16 - e4 * 37 / 96, e3 * 29 / 96, e4 * 539 / 1536), 1):
        end = end + c * m.sin(m.lit(2.0 * j) * tau)
    lat = m.atan2(c0 * m.sin(end), m.lit(1 - _F) * m.sqrt(c0 * c0 * m.cos(end) * m.cos(end) + s0 * s0))
    lon2 = m.atan2(s0 * m.sin(end), m.cos(end))
    n = _N
    drift = m.lit(1.0) - m.lit(0.5 - n / 2) * e - m.lit(0.25 + n / 8 - 3 * n * n / 8) * e2 - m.lit(1 / 16 + 3 * n / 16) * e3 - m.lit(3 / 64) * e4
    wave = end - start
    series = (
        m.lit(0.25 - n / 4) * e + m.lit(0.125 - n * n / 8) * e2 + m.lit(3 / 64 + 3 * n / 64) * e3 + m.lit(5 / 128) * e4,
        m.lit(1 / 16 - 3 * n / 32 + n * n / 32) * e2 + m.lit(3 / 64 - n / 32) * e3 + m.lit(3 / 128) * e4,
        m.lit(5 / 192 - 3 * n / 64) * e3 + m.lit(3 / 128) * e4,
        m.lit(7 / 512) * e4,
    )
    for j, c in enumerate(series, 1):
        wave = wave + c * (m.sin(m.lit(2.0 * j) * end) - m.sin(m.lit(2.0 * j) * start))
    turn = lon2 - lon1 - m.lit(_F) * s0 * drift * wave
    turn = m.atan2(m.sin(turn), m.cos(turn))
    return m.lit(_EQUI7_LON) + m.degrees(turn), m.degrees(lat)


def positions(x, y, epsg: int, m=ARRAYS):
    """(longitudes, latitudes) in degrees of points of any of the supported systems, without iteration."""
    if epsg == 4326:
        return x, y
    if epsg == 6933:
        return from_equal_area(x, y, m)
    if epsg == 3035:
        return from_laea_europe(x, y, m)
    if epsg == 27704:
        return from_equi7_europe(x, y, m)
    if epsg // 100 in (326, 327) and 1 <= epsg % 100 <= 60:
        return untransverse((x - m.lit(_EAST)) / m.lit(_SCALE), (y - m.lit(_SOUTH if epsg // 100 == 327 else 0.0)) / m.lit(_SCALE), (epsg % 100) * 6 - 183, m)
    raise CRSError(f"EPSG:{epsg} is not known here; use 4326, 3035, 6933, 27704 or a UTM zone")


SUPPORTED = (4326, 3035, 6933, 27704, *range(32601, 32661), *range(32701, 32761))


def project(lon, lat, epsg: int, m=COLUMNS):
    """(x, y) of a position in degrees in any of the supported systems."""
    if epsg == 4326:
        return lon, lat
    if epsg == 6933:
        return to_equal_area(lon, lat, m)
    if epsg == 3035:
        return to_laea_europe(lon, lat, m)
    if epsg // 100 in (326, 327) and 1 <= epsg % 100 <= 60:
        return to_utm(lon, lat, epsg, m)
    if epsg == 27704 and m is PLAIN:
        return _to_equi7_europe(lon, lat)
    raise CRSError(f"EPSG:{epsg} has no closed form here; use 4326, 3035, 6933 or a UTM zone")


def _to_equi7_europe(lon: float, lat: float) -> tuple[float, float]:
    """(x, y) of EPSG:27704, on the driver: Newton's method on the way back."""
    x, y, h = _EQUI7_X + (lon - _EQUI7_LON) * 66_000, _EQUI7_Y + (lat - _EQUI7_LAT) * 111_000, 1.0
    for _ in range(50):
        (a, b), (ax, bx), (ay, by) = (from_equi7_europe(x + i * h, y + j * h, PLAIN) for i, j in ((0, 0), (1, 0), (0, 1)))
        du, dv = lon - a, lat - b
        det = (ax - a) * (by - b) - (ay - a) * (bx - b)
        dx, dy = ((by - b) * du - (ay - a) * dv) / det, ((ax - a) * dv - (bx - b) * du) / det
        x, y = x + dx * h, y + dy * h
        if abs(dx) + abs(dy) < 1e-6:
            break
    return x, y


def unproject(x: float, y: float, epsg: int) -> tuple[float, float]:
    """The position in degrees of a point, on the driver."""
    return positions(float(x), float(y), epsg, PLAIN)
