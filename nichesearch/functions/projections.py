"""Map projections of the ellipsoid as column expressions, forward and inverse, in whole-stage code.

Transverse Mercator by Krüger's series to the fourth power of the third flattening (below a
millimetre within 30 degrees of the central meridian), Lambert's conformal conic with two
parallels, Albers' equal-area conic. Systems are told apart by EPSG codes; the frames WGS 84, ETRS89, NAD83 and RGF93
count as one, as they agree to a metre or two; others have no shift here.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry

#: Semi-major axis in metres and inverse flattening.
WGS84, GRS80 = (6378137.0, 298.257223563), (6378137.0, 298.257222101)


@dataclass(frozen=True)
class TransverseMercator:
    ellipsoid: tuple[float, float]
    lon0: float
    lat0: float = 0.0
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0

    def _parts(self) -> tuple[float, float, list[float], list[float], list[float]]:
        a, f = self.ellipsoid[0], 1 / self.ellipsoid[1]
        n = f / (2 - f)
        radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
        return n, radius, alpha, beta, delta

    def _conformal(self, lat: Column, n: float) -> Column:
        """The tangent of the conformal latitude."""
        e = 2 * math.sqrt(n) / (1 + n)
        s = F.sin(lat)
        return F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))

    def _origin(self) -> float:
        """The northing of the latitude of origin."""
        n, radius, alpha, _, _ = self._parts()
        e, s = 2 * math.sqrt(n) / (1 + n), math.sin(math.radians(self.lat0))
        xi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
        return radius * (xi + sum(c * math.sin(2 * (j + 1) * xi) for j, c in enumerate(alpha)))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, radius, alpha, _, _ = self._parts()
        t, dl = self._conformal(F.radians(lat), n), F.radians(lon - F.lit(self.lon0))
        xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
        x = eta + sum(F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(alpha, 1))
        y = xi + sum(F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(alpha, 1))
        k = self.scale
        return F.lit(k * radius) * x + F.lit(self.east), F.lit(k * radius) * y + F.lit(self.north - k * self._origin())

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        _, radius, _, beta, delta = self._parts()
        k = self.scale
        xi, eta = (y - F.lit(self.north - k * self._origin())) / F.lit(k * radius), (x - F.lit(self.east)) / F.lit(k * radius)
        xi2 = xi - sum(F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(beta, 1))
        eta2 = eta - sum(F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(beta, 1))
        chi = F.asin(F.sin(xi2) / F.cosh(eta2))
        lat = chi + sum(F.lit(c) * F.sin(2 * j * chi) for j, c in enumerate(delta, 1))
        return F.lit(self.lon0) + F.degrees(F.atan2(F.sinh(eta2), F.cos(xi2))), F.degrees(lat)


def _e(ellipsoid: tuple[float, float]) -> float:
    f = 1 / ellipsoid[1]
    return math.sqrt(f * (2 - f))


@dataclass(frozen=True)
class LambertConformal:
    ellipsoid: tuple[float, float]
    lon0: float
    lat0: float
    lat1: float
    lat2: float
    east: float
    north: float

    def _parts(self) -> tuple[float, float, float, float]:
        e = _e(self.ellipsoid)
        rad = math.radians
        m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
        t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
        one, two = rad(self.lat1), rad(self.lat2)
        n = math.sin(one) if one == two else (math.log(m(one)) - math.log(m(two))) / (math.log(t(one)) - math.log(t(two)))
        f = m(one) / (n * t(one) ** n)
        return e, n, self.ellipsoid[0] * f, self.ellipsoid[0] * f * t(rad(self.lat0)) ** n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        e, n, af, r0 = self._parts()
        p = F.radians(lat)
        s = F.lit(e) * F.sin(p)
        t = F.tan(F.lit(math.pi / 4) - p / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
        r, theta = F.lit(af) * F.pow(t, F.lit(n)), F.lit(n) * F.radians(lon - F.lit(self.lon0))
        return F.lit(self.east) + r * F.sin(theta), F.lit(self.north + r0) - r * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        e, n, af, r0 = self._parts()
        dx, dy = x - F.lit(self.east), F.lit(r0 + self.north) - y
        sign = 1.0 if n > 0 else -1.0
        t = F.pow(F.sqrt(dx * dx + dy * dy) / F.lit(abs(af)), F.lit(1 / n))
        theta = F.atan2(F.lit(sign) * dx, F.lit(sign) * dy)
        chi = F.lit(math.pi / 2) - 2 * F.atan(t)
        lat = chi + sum(F.lit(c) * F.sin(2 * j * chi) for j, c in enumerate(_conformal_series(e), 1))
        return F.lit(self.lon0) + F.degrees(theta / F.lit(n)), F.degrees(lat)


def _conformal_series(e: float) -> list[float]:
    """From conformal to geodetic latitude."""
    return [
        e**2 / 2 + 5 * e**4 / 24 + e**6 / 12 + 13 * e**8 / 360,
        7 * e**4 / 48 + 29 * e**6 / 240 + 811 * e**8 / 11520,
        7 * e**6 / 120 + 81 * e**8 / 1120,
        4279 * e**8 / 161280,
    ]


def _authalic_series(e: float) -> list[float]:
    """From authalic to geodetic latitude."""
    return [e**2 / 3 + 31 * e**4 / 180 + 517 * e**6 / 5040, 23 * e**4 / 360 + 251 * e**6 / 3780, 761 * e**6 / 45360]


@dataclass(frozen=True)
class Albers:
    ellipsoid: tuple[float, float]
    lon0: float
    lat0: float
    lat1: float
    lat2: float
    east: float = 0.0
    north: float = 0.0

    def _parts(self) -> tuple[float, float, float, float]:
        e, a = _e(self.ellipsoid), self.ellipsoid[0]
        m2 = lambda p: math.cos(p) ** 2 / (1 - (e * math.sin(p)) ** 2)
        q = lambda p: (1 - e * e) * (math.sin(p) / (1 - (e * math.sin(p)) ** 2) + math.atanh(e * math.sin(p)) / e)
        one, two = math.radians(self.lat1), math.radians(self.lat2)
        n = math.sin(one) if one == two else (m2(one) - m2(two)) / (q(two) - q(one))
        c = m2(one) + n * q(one)
        return e, n, c, a * math.sqrt(c - n * q(math.radians(self.lat0))) / n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        e, n, c, r0 = self._parts()
        s = F.sin(F.radians(lat))
        q = F.lit(1 - e * e) * (s / (1 - F.lit(e * e) * s * s) + F.atanh(F.lit(e) * s) / F.lit(e))
        r, theta = F.lit(self.ellipsoid[0] / n) * F.sqrt(F.lit(c) - F.lit(n) * q), F.lit(n) * F.radians(lon - F.lit(self.lon0))
        return F.lit(self.east) + r * F.sin(theta), F.lit(self.north + r0) - r * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        e, n, c, r0 = self._parts()
        dx, dy = x - F.lit(self.east), F.lit(r0 + self.north) - y
        sign = 1.0 if n > 0 else -1.0
        q = (F.lit(c) - (dx * dx + dy * dy) * F.lit((n / self.ellipsoid[0]) ** 2)) / F.lit(n)
        most = 1 + (1 - e * e) / e * math.atanh(e)
        beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / F.lit(most))))
        lat = beta + sum(F.lit(v) * F.sin(2 * j * beta) for j, v in enumerate(_authalic_series(e), 1))
        s, cos = F.sin(lat), F.greatest(F.cos(lat), F.lit(1e-12))
        w = 1 - F.lit(e * e) * s * s
        lat = lat + w * w / (2 * cos) * (q / F.lit(1 - e * e) - s / w - F.atanh(F.lit(e) * s) / F.lit(e))  # a step of Newton's after the series
        return F.lit(self.lon0) + F.degrees(F.atan2(F.lit(sign) * dx, F.lit(sign) * dy) / F.lit(n)), F.degrees(lat)


@dataclass(frozen=True)
class WebMercator:
    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return geometry.to_mercator(lon, lat)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return geometry.from_mercator(x, y)


@dataclass(frozen=True)
class Degrees:
    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon, lat

    inverse = forward


#: Systems that no rule gives, by EPSG code.
_SYSTEMS: dict[int, Callable] = {
    4326: Degrees, 4258: Degrees, 4269: Degrees, 3857: WebMercator,
    2154: lambda: LambertConformal(GRS80, 3.0, 46.5, 49.0, 44.0, 700_000.0, 6_600_000.0),
    3034: lambda: LambertConformal(GRS80, 10.0, 52.0, 35.0, 65.0, 4_000_000.0, 2_800_000.0),
    3978: lambda: LambertConformal(GRS80, -95.0, 49.0, 49.0, 77.0, 0.0, 0.0),
    5070: lambda: Albers(GRS80, -96.0, 23.0, 29.5, 45.5),
    3005: lambda: Albers(GRS80, -126.0, 45.0, 50.0, 58.5, 1_000_000.0, 0.0),
    3577: lambda: Albers(GRS80, 132.0, 0.0, -18.0, -36.0),
}


def system(crs: str):
    """The projection of an ``EPSG:`` code, or None: UTM's zones by their rule (WGS 84, ETRS89, NAD83), others by the table."""
    name, _, digits = crs.strip().upper().partition(":")
    if name != "EPSG" or not digits.isdigit():
        return None
    code = int(digits)
    if code in _SYSTEMS:
        return _SYSTEMS[code]()
    for first, zones, ellipsoid, north in ((32600, range(1, 61), WGS84, 0.0), (32700, range(1, 61), WGS84, 10_000_000.0), (25800, range(28, 39), GRS80, 0.0), (26900, range(1, 24), GRS80, 0.0)):
        if code - first in zones:
            return TransverseMercator(ellipsoid, 6.0 * (code - first) - 183, north=north)
    return None


def move(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column] | None:
    """Coordinates (always x, y) from one system to another; None where either is unknown."""
    a, b = system(source), system(target)
    return b.forward(*a.inverse(x, y)) if a and b else None
