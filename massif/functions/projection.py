"""Coordinate systems on WGS 84 by number: longitude and latitude, UTM zones, spherical Mercator."""

import re

import numpy as np

from massif.config import InputError

_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_E = 2 * _N**0.5 / (1 + _N)
#: Kruger's series to the sixth order in the third flattening (fixed values): forward, backward and conformal latitude.
_SERIES = {
    "alpha": ((1, (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800)), (2, (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360)), (3, (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440)), (4, (49561 / 161280, -179 / 168, 6601661 / 7257600)), (5, (34729 / 80640, -3418889 / 1995840)), (6, (212378941 / 319334400,))),
    "beta": ((1, (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800)), (2, (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720)), (3, (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720)), (4, (4397 / 161280, -11 / 504, -830251 / 7257600)), (5, (4583 / 161280, -108847 / 3991680)), (6, (20648693 / 638668800,))),
}
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_COEFFICIENT = {name: [sum(c * _N ** (j + i) for i, c in enumerate(row)) for j, row in rows] for name, rows in _SERIES.items()}


def code(name: str) -> int:
    """The EPSG number of a system's name."""
    text = str(name).strip()
    if re.search(r"(?i)CRS:?84$", text):
        return 4326
    found = re.fullmatch(r"(?i)(?:urn:ogc:def:crs:)?EPSG:(?:[\d.]*:)?(\d+)", text)
    number = int(found[1]) if found else 0
    if number not in (4326, 3857) and not (number // 100 in (326, 327) and 1 <= number % 100 <= 60):
        raise InputError(f"unknown coordinate system {name!r}; known are EPSG:4326, 3857, 32601 to 32660 and 32701 to 32760")
    return number


def metric(number: int) -> bool:
    return number != 4326


def forward(number: int, lon, lat) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in a system of longitudes and latitudes in degrees."""
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    if number == 4326:
        return lon, lat
    if number == 3857:
        return _A * np.radians(lon), _A * np.arctanh(np.sin(np.radians(lat)))
    phi, lam = np.radians(lat), np.radians(lon - (number % 100 * 6 - 183))
    t = np.sinh(np.arctanh(np.sin(phi)) - _E * np.arctanh(_E * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(t, np.cos(lam)))
    east, north = eta.copy(), xi.copy()
    for j, a in enumerate(_COEFFICIENT["alpha"], 1):
        east += a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        north += a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return 500000 + 0.9996 * _RADIUS * east, (10000000.0 if number // 100 == 327 else 0.0) + 0.9996 * _RADIUS * north


def inverse(number: int, x, y) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes in degrees of coordinates in a system."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if number == 4326:
        return x, y
    if number == 3857:
        return np.degrees(x / _A), np.degrees(np.arcsin(np.tanh(y / _A)))
    xi, eta = (y - (10000000.0 if number // 100 == 327 else 0.0)) / (0.9996 * _RADIUS), (x - 500000) / (0.9996 * _RADIUS)
    p, q = xi.copy(), eta.copy()
    for j, b in enumerate(_COEFFICIENT["beta"], 1):
        p -= b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        q -= b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    tau = np.sin(p) / np.hypot(np.sinh(q), np.cos(p))  # of the conformal latitude
    t = tau.copy()
    for _ in range(6):  # Newton's method for the geographic one
        s = np.sinh(_E * np.arctanh(_E * t / np.hypot(1, t)))
        own = t * np.hypot(1, s) - s * np.hypot(1, t)
        t += (tau - own) / np.hypot(1, own) * (1 + (1 - _E**2) * t * t) / ((1 - _E**2) * np.hypot(1, t))
    return np.degrees(np.arctan2(np.sinh(q), np.cos(p))) + (number % 100 * 6 - 183), np.degrees(np.arctan(t))


def between(source: int, target: int, x, y) -> tuple[np.ndarray, np.ndarray]:
    return (np.asarray(x, float), np.asarray(y, float)) if source == target else forward(target, *inverse(source, x, y))


def reproject(region, source: int, target: int):
    """A region's polygons in another system."""
    return [[np.stack(between(source, target, *np.asarray(r, float).T), axis=1) for r in p] for p in region]
