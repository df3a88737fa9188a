"""Map projections and geodesics on the ellipsoid, in NumPy, with Arrow-batched UDFs around them.

Transverse Mercator uses the Krueger series to the sixth order, Lambert conformal conic the closed form on the
ellipsoid, geodesics Vincenty's iterations, areas the excess on the auxiliary sphere and an integral.  GRS80 and WGS84 are one ellipsoid here (they differ by 0.1 mm).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .zones import US_FOOT, parsed

A, FLAT = 6_378_137.0, 1 / 298.257222101
E2 = FLAT * (2 - FLAT)
E = np.sqrt(E2)


@dataclass(frozen=True)
class Zone:
    """A state-plane or UTM zone; distances in metres, angles in degrees."""

    epsg: int
    name: str
    state: str
    kind: str  # 'tm', 'lcc' or 'om' (oblique)
    lat0: float
    lon0: float
    k0: float
    false_east: float
    false_north: float
    lat1: float = 0.0
    lat2: float = 0.0
    azimuth: float = 0.0  # of the oblique kind's central line, and of its grid
    unit: float = US_FOOT
    bounds: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0)  # west, south, east, north


ZONES = tuple(Zone(**row) for row in parsed())
BY_EPSG = {z.epsg: z for z in ZONES}


def utm(epsg: int) -> Zone:
    number, south = epsg % 100, epsg // 100 == 327
    return Zone(epsg, f"WGS 84 / UTM zone {number}{'S' if south else 'N'}", "", "tm", 0.0, number * 6 - 183.0, 0.9996, 500_000.0, 10_000_000.0 if south else 0.0, unit=1.0)


def zone(epsg: int) -> Zone:
    return BY_EPSG.get(epsg) or utm(epsg)


_N = FLAT / (2 - FLAT)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


def _series(powers: list[list[tuple[int, float]]]) -> np.ndarray:
    return np.array([sum(c * _N**p for p, c in terms) for terms in powers])


_ALPHA = _series([
    [(1, 1 / 2), (2, -2 / 3), (3, 5 / 16), (4, 41 / 180), (5, -127 / 288), (6, 7891 / 37800)],
    [(2, 13 / 48), (3, -3 / 5), (4, 557 / 1440), (5, 281 / 630), (6, -1983433 / 1935360)],
    [(3, 61 / 240), (4, -103 / 140), (5, 15061 / 26880), (6, 167603 / 181440)],
    [(4, 49561 / 161280), (5, -179 / 168), (6, 6601661 / 7257600)],
    [(5, 34729 / 80640), (6, -3418889 / 1995840)],
    [(6, 212378941 / 319334400)],
])
_BETA = _series([
    [(1, 1 / 2), (2, -2 / 3), (3, 37 / 96), (4, -1 / 360), (5, -81 / 512), (6, 96199 / 604800)],
    [(2, 1 / 48), (3, 1 / 15), (4, -437 / 1440), (5, 46 / 105), (6, -1118711 / 3870720)],
    [(3, 17 / 480), (4, -37 / 840), (5, -209 / 4480), (6, 5569 / 90720)],
    [(4, 4397 / 161280), (5, -11 / 504), (6, -830251 / 7257600)],
    [(5, 4583 / 161280), (6, -108847 / 3991680)],
    [(6, 20648693 / 638668800)],
])


def _conformal(lat: np.ndarray) -> np.ndarray:
    """Tangent of the conformal latitude."""
    t = np.tan(lat)
    s = np.sinh(E * np.arctanh(E * t / np.sqrt(1 + t * t)))
    return t * np.sqrt(1 + s * s) - s * np.sqrt(1 + t * t)


def _geographic(tau: np.ndarray) -> np.ndarray:
    """Latitude of a tangent of the conformal latitude, by Newton's steps."""
    t = np.array(tau, dtype=float)
    for _ in range(6):
        s = np.sinh(E * np.arctanh(E * t / np.sqrt(1 + t * t)))
        ti = t * np.sqrt(1 + s * s) - s * np.sqrt(1 + t * t)
        t = t + (tau - ti) / np.sqrt(1 + ti * ti) * (1 + (1 - E2) * t * t) / ((1 - E2) * np.sqrt(1 + t * t))
    return np.arctan(t)


def _meridian(lat0: float) -> float:
    xi = np.arctan(_conformal(np.radians(lat0)))
    return float(_RADIUS * (xi + sum(a * np.sin(2 * j * xi) for j, a in enumerate(_ALPHA, 1))))


def _cone(z: Zone) -> tuple[float, float, float]:
    def m(f):
        return np.cos(f) / np.sqrt(1 - E2 * np.sin(f) ** 2)

    def t(f):
        return np.tan(np.pi / 4 - f / 2) / ((1 - E * np.sin(f)) / (1 + E * np.sin(f))) ** (E / 2)

    f1, f2, f0 = np.radians([z.lat1, z.lat2, z.lat0])
    n = (np.log(m(f1)) - np.log(m(f2))) / (np.log(t(f1)) - np.log(t(f2)))
    big = m(f1) / (n * t(f1) ** n)
    return float(n), float(big), float(A * big * t(f0) ** n)


def _tangent(f):
    """What conformal cones and the oblique projection use in place of the latitude."""
    return np.tan(np.pi / 4 - f / 2) / ((1 - E * np.sin(f)) / (1 + E * np.sin(f))) ** (E / 2)


def _oblique(z: Zone) -> tuple[float, ...]:
    """Constants of the oblique Mercator projection of one central line, its coordinates counted from where that line meets the aposphere's equator."""
    f, a = np.radians(z.lat0), np.radians(z.azimuth)
    root = np.sqrt(1 - E2 * np.sin(f) ** 2)
    b = np.sqrt(1 + E2 * np.cos(f) ** 4 / (1 - E2))
    size = A * b * z.k0 * np.sqrt(1 - E2) / root**2
    d = max(1.0, b * np.sqrt(1 - E2) / (np.cos(f) * root))
    big = d + np.sqrt(d * d - 1) * np.sign(f)
    h = big * _tangent(f) ** b
    gamma = np.arcsin(np.sin(a) / d)
    lon0 = np.radians(z.lon0) - np.arcsin((big - 1 / big) / 2 * np.tan(gamma)) / b
    return float(b), float(size), float(h), float(gamma), float(lon0), float(a)


def forward(z: Zone, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing in the zone's unit."""
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    if z.kind == "lcc":
        n, big, rho0 = _cone(z)
        f = np.radians(lat)
        t = np.tan(np.pi / 4 - f / 2) / ((1 - E * np.sin(f)) / (1 + E * np.sin(f))) ** (E / 2)
        rho, theta = A * big * t**n, n * np.radians(lon - z.lon0)
        x, y = rho * np.sin(theta), rho0 - rho * np.cos(theta)
        return (x + z.false_east) / z.unit, (y + z.false_north) / z.unit
    if z.kind == "om":
        b, size, h, gamma, lon0, a = _oblique(z)
        q, dl = h / _tangent(np.radians(lat)) ** b, b * (np.radians(lon) - lon0)
        s, t = (q - 1 / q) / 2, (q + 1 / q) / 2
        v = -size / b * np.arctanh((s * np.sin(gamma) - np.sin(dl) * np.cos(gamma)) / t)
        u = size / b * np.arctan2(s * np.cos(gamma) + np.sin(dl) * np.sin(gamma), np.cos(dl))
        return (v * np.cos(a) + u * np.sin(a) + z.false_east) / z.unit, (u * np.cos(a) - v * np.sin(a) + z.false_north) / z.unit
    dl, tau = np.radians(lon - z.lon0), _conformal(np.radians(lat))
    xi, eta = np.arctan2(tau, np.cos(dl)), np.arcsinh(np.sin(dl) / np.hypot(tau, np.cos(dl)))
    x, y = eta.copy(), xi.copy()
    for j, a in enumerate(_ALPHA, 1):
        y += a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        x += a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    return (z.k0 * _RADIUS * x + z.false_east) / z.unit, (z.k0 * (_RADIUS * y - _meridian(z.lat0)) + z.false_north) / z.unit


def inverse(z: Zone, east: np.ndarray, north: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of a grid position in the zone's unit."""
    x, y = np.asarray(east, float) * z.unit - z.false_east, np.asarray(north, float) * z.unit - z.false_north
    if z.kind == "lcc":
        n, big, rho0 = _cone(z)
        rho, theta = np.sign(n) * np.hypot(x, rho0 - y), np.arctan2(x, rho0 - y)
        t = (rho / (A * big)) ** (1 / n)
        return np.degrees(theta / n) + z.lon0, np.degrees(_geographic(np.sinh(-np.log(t))))
    if z.kind == "om":
        b, size, h, gamma, lon0, a = _oblique(z)
        v, u = (x * np.cos(a) - y * np.sin(a)) * b / size, (y * np.cos(a) + x * np.sin(a)) * b / size
        s, t = np.sinh(-v), np.cosh(v)
        t = (h / np.exp(np.arctanh((np.sin(u) * np.cos(gamma) + s * np.sin(gamma)) / t))) ** (1 / b)
        lon = lon0 - np.arctan2(s * np.cos(gamma) - np.sin(u) * np.sin(gamma), np.cos(u)) / b
        return np.degrees(lon), np.degrees(_geographic(np.sinh(-np.log(t))))
    xi0, eta0 = (y / z.k0 + _meridian(z.lat0)) / _RADIUS, x / (z.k0 * _RADIUS)
    xi, eta = np.array(xi0, float), np.array(eta0, float)
    for j, b in enumerate(_BETA, 1):
        xi -= b * np.sin(2 * j * xi0) * np.cosh(2 * j * eta0)
        eta -= b * np.cos(2 * j * xi0) * np.sinh(2 * j * eta0)
    tau = np.sin(xi) / np.hypot(np.sinh(eta), np.cos(xi))
    return z.lon0 + np.degrees(np.arctan2(np.sinh(eta), np.cos(xi))), np.degrees(_geographic(tau))


def _vincenty_series(cos2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = cos2 * (A**2 - (A * (1 - FLAT)) ** 2) / (A * (1 - FLAT)) ** 2
    return 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))), u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))


def direct(lon: np.ndarray, lat: np.ndarray, azimuth: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End of a geodesic."""
    a, f = np.radians(np.asarray(azimuth, float)), np.radians(np.asarray(lat, float))
    b, s = A * (1 - FLAT), np.asarray(distance, float)
    u1 = np.arctan((1 - FLAT) * np.tan(f))
    s1 = np.arctan2(np.tan(u1), np.cos(a))
    sin_a = np.cos(u1) * np.sin(a)
    big_a, big_b = _vincenty_series(1 - sin_a**2)
    sigma = s / (b * big_a)
    for _ in range(30):
        m = np.cos(2 * s1 + sigma)
        d = big_b * np.sin(sigma) * (m + big_b / 4 * (np.cos(sigma) * (2 * m**2 - 1) - big_b / 6 * m * (4 * np.sin(sigma) ** 2 - 3) * (4 * m**2 - 3)))
        sigma = s / (b * big_a) + d
    m = np.cos(2 * s1 + sigma)
    t = np.sin(u1) * np.sin(sigma) - np.cos(u1) * np.cos(sigma) * np.cos(a)
    f2 = np.arctan2(np.sin(u1) * np.cos(sigma) + np.cos(u1) * np.sin(sigma) * np.cos(a), (1 - FLAT) * np.hypot(sin_a, t))
    lam = np.arctan2(np.sin(sigma) * np.sin(a), np.cos(u1) * np.cos(sigma) - np.sin(u1) * np.sin(sigma) * np.cos(a))
    c = FLAT / 16 * (1 - sin_a**2) * (4 + FLAT * (4 - 3 * (1 - sin_a**2)))
    big_l = lam - (1 - c) * FLAT * sin_a * (sigma + c * np.sin(sigma) * (m + c * np.cos(sigma) * (2 * m**2 - 1)))
    return np.asarray(lon, float) + np.degrees(big_l), np.degrees(f2)


SECOND_E2 = E2 / (1 - E2)
#: Square of the authalic radius: 4 pi of it are the ellipsoid's surface.
AUTHALIC2 = A**2 / 2 * (1 + (1 - E2) / E * np.arctanh(E))
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(20)


def _excess_series(terms: int = 10) -> np.ndarray:
    """Coefficients from x^1 on of x + sqrt(1 + x) asinh(sqrt x) / sqrt x, the weight of a latitude's area."""
    out = [4 / 3]
    ratio = 1 / 3
    for n in range(2, terms + 1):
        ratio *= -(2 * n - 2) / (2 * n + 1)
        out.append(ratio)
    return np.array(out)


def _slope(x: float, y: np.ndarray) -> np.ndarray:
    """Difference quotient of that series between x and y, also where they are alike."""
    out, both, power = np.zeros_like(y), np.ones_like(y), np.ones_like(y)
    for c in _excess_series():
        out += c * both
        power = power * y
        both = x * both + power  # x^n + x^(n-1) y + ... + y^n
    return out


def area_below(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed area between each geodesic and the equator (square metres), and the difference of longitudes (radians).

    On the auxiliary sphere the area is the spherical excess; what the ellipsoid adds is an integral along the geodesic,
    taken by quadrature, like that between its longitude and the sphere's.  Ends may be poles; they must not be nearly
    opposite each other.
    """
    d = np.radians((np.asarray(lon2, float) - lon1 + 180.0) % 360.0 - 180.0)
    b1, b2 = (np.arctan2((1 - FLAT) * np.sin(f), np.cos(f)) for f in (np.radians(np.asarray(lat1, float)), np.radians(np.asarray(lat2, float))))
    w = d.copy()
    for _ in range(12):
        across, along = np.cos(b2) * np.sin(w), np.cos(b1) * np.sin(b2) - np.sin(b1) * np.cos(b2) * np.cos(w)
        length = np.arctan2(np.hypot(across, along), np.sin(b1) * np.sin(b2) + np.cos(b1) * np.cos(b2) * np.cos(w))
        azimuth = np.arctan2(across, along)
        sin0 = np.sin(azimuth) * np.cos(b1)
        start = np.arctan2(np.sin(b1), np.cos(azimuth) * np.cos(b1))
        s = np.sin(start[:, None] + length[:, None] * (1 + _NODES) / 2)
        k2 = (SECOND_E2 * (1 - sin0**2))[:, None]
        integral = ((2 - FLAT) / (1 + (1 - FLAT) * np.sqrt(1 + k2 * s * s)) * _WEIGHTS).sum(1) * length / 2
        w = d + FLAT * sin0 * integral
    t1, t2 = np.tan(b1 / 2), np.tan(b2 / 2)
    excess = 2 * np.arctan2(np.sin(w / 2) * (t1 + t2), np.cos(w / 2) * (1 + t1 * t2))
    more = -(_slope(SECOND_E2, k2 * s * s) * s / 2 * _WEIGHTS).sum(1) * length / 2
    return AUTHALIC2 * excess + E2 * A**2 * np.sqrt(1 - sin0**2) * sin0 * more, d


def geodesic_areas_m2(lon: np.ndarray, lat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Areas of rings (``sizes`` vertices each, after each other) whose edges are geodesics, wherever they lie.

    A ring may cross the antimeridian or go round a pole; of the two parts of the ellipsoid the smaller one counts.
    """
    first = np.cumsum(sizes) - sizes
    after = np.arange(1, len(lon) + 1)
    after[first + sizes - 1] = first
    area, turn = area_below(lon, lat, lon[after], lat[after])
    below, round_ = np.add.reduceat(area, first), np.add.reduceat(turn, first)
    whole = 2 * np.pi * AUTHALIC2
    out = np.where(np.abs(round_) > np.pi, whole - np.abs(below), np.abs(below))
    return np.minimum(out, 2 * whole - out)


def geodesic_area_m2(lon: np.ndarray, lat: np.ndarray) -> float:
    """Area of one ring."""
    return float(geodesic_areas_m2(np.asarray(lon, float), np.asarray(lat, float), np.array([len(lon)]))[0])


def _doubles(*names: str) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


RING = ArrayType(_doubles("x", "y"))


def _ring(values) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in values], float).reshape(-1, 2)


def _out(x: np.ndarray, y: np.ndarray, digits: int | None = None) -> list[dict]:
    if digits is not None:
        x, y = np.round(x, digits), np.round(y, digits)
    return [{"x": float(a), "y": float(b)} for a, b in zip(x, y)]


@F.pandas_udf(RING)
def local_ring_to_lonlat(ring: pd.Series, lon: pd.Series, lat: pd.Series) -> pd.Series:
    """Feet east and north of an anchor, walked as geodesics; closed, 7 decimals."""
    def one(r, lo, la):
        if r is None or pd.isna(lo) or pd.isna(la):
            return None
        p = _ring(r)
        x, y = direct(np.full(len(p), lo), np.full(len(p), la), np.degrees(np.arctan2(p[:, 0], p[:, 1])), np.hypot(p[:, 0], p[:, 1]) * 0.3048)
        out = _out(x, y, 7)
        return out if out and out[0] == out[-1] else out + out[:1]

    return pd.Series([one(*v) for v in zip(ring, lon, lat)])


@F.pandas_udf(RING)
def ring_from_ground_corner(ring: pd.Series, corner: pd.Series, northing: pd.Series, easting: pd.Series, epsg: pd.Series, factor: pd.Series) -> pd.Series:
    """Local feet placed so that vertex ``corner`` has the printed ground position; ground over factor is grid; closed, 8 decimals."""
    def one(r, c, n, e, code, k):
        if r is None or any(pd.isna(v) for v in (c, n, e, code)):
            return None
        p = _ring(r)
        d = (p - p[int(c)] + (e, n)) / (1.0 if pd.isna(k) else k)
        out = _out(*inverse(zone(int(code)), d[:, 0], d[:, 1]), 8)
        return out if out[0] == out[-1] else out + out[:1]

    return pd.Series([one(*v) for v in zip(ring, corner, northing, easting, epsg, factor)])


@F.pandas_udf(RING)
def shift_ring(ring: pd.Series, east: pd.Series, north: pd.Series) -> pd.Series:
    """Every vertex moved along the geodesic of one azimuth and distance (metres); a zero move changes nothing."""
    def one(r, e, n):
        if r is None or (not e and not n):
            return r
        p = _ring(r)
        d, a = np.hypot(e, n), np.degrees(np.arctan2(e, n))
        return _out(*direct(p[:, 0], p[:, 1], np.full(len(p), a), np.full(len(p), d)))

    return pd.Series([one(*v) for v in zip(ring, east, north)])


@F.pandas_udf(_doubles("lon", "lat"))
def grid_to_lonlat(epsg: pd.Series, easting: pd.Series, northing: pd.Series) -> pd.DataFrame:
    lon, lat = np.full(len(epsg), np.nan), np.full(len(epsg), np.nan)
    for code in epsg.dropna().unique():
        at = (epsg == code).to_numpy()
        lon[at], lat[at] = inverse(zone(int(code)), easting[at].to_numpy(float), northing[at].to_numpy(float))
    return pd.DataFrame({"lon": lon, "lat": lat})


@F.pandas_udf(_doubles("x", "y"))
def lonlat_to_grid(epsg: pd.Series, lon: pd.Series, lat: pd.Series) -> pd.DataFrame:
    x, y = np.full(len(epsg), np.nan), np.full(len(epsg), np.nan)
    for code in epsg.dropna().unique():
        at = (epsg == code).to_numpy()
        x[at], y[at] = forward(zone(int(code)), lon[at].to_numpy(float), lat[at].to_numpy(float))
    return pd.DataFrame({"x": x, "y": y})


@F.pandas_udf(_doubles("area_sqft", "perimeter_ft"))
def projected_measures(ring: pd.Series, epsg: pd.Series) -> pd.DataFrame:
    """Area and perimeter of a lon/lat ring on a zone's plane."""
    rows = []
    for r, code in zip(ring, epsg):
        if r is None or pd.isna(code):
            rows.append((None, None))
            continue
        p, z = _ring(r), zone(int(code))
        x, y = (v * z.unit for v in forward(z, p[:, 0], p[:, 1]))
        area = abs(float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y))) / 2
        rows.append((area / 0.09290304, float(np.hypot(np.diff(np.r_[x, x[:1]]), np.diff(np.r_[y, y[:1]])).sum()) / 0.3048))
    return pd.DataFrame(rows, columns=["area_sqft", "perimeter_ft"])


@F.pandas_udf(DoubleType())
def area_km2(ring: pd.Series) -> pd.Series:
    """Geodesic area of a lon/lat ring of any size and place; null under three vertices."""
    rings = [np.zeros((0, 2)) if r is None else _ring(r) for r in ring]
    sizes = np.array([len(r) for r in rings], int)
    out, fit = np.full(len(rings), np.nan), sizes >= 3
    if fit.any():
        p = np.concatenate([r for r, ok in zip(rings, fit) if ok])
        out[fit] = geodesic_areas_m2(p[:, 0], p[:, 1], sizes[fit]) / 1e6
    return pd.Series(out).astype(object).where(fit, None)


def density(count: Column, area: Column) -> Column:
    """Features a square kilometre; negative counts and areas that aren't positive are errors."""
    return F.when((count >= 0) & (area > 0), count / area).otherwise(F.raise_error(F.lit("count below 0 or area not above 0")).cast("double"))


def zones_frame(spark):
    """The zones as a small table."""
    return spark.createDataFrame([(z.epsg, z.name, z.state, *map(float, z.bounds)) for z in ZONES], "epsg int, name string, state string, west double, south double, east double, north double")
