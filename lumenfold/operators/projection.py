"""Map projections on spheres and ellipsoids, both ways, as columns or as numpy arrays.

All go over the conformal or the rectifying latitude: these follow from the geodetic one in closed form or by a series in
the third flattening, up to its sixth power, and lead back by such a series. So a projection is one expression without
iteration, which Spark compiles, and the same text serves the tasks of a warp.

Angles are degrees outside and radians inside; longitudes come back within [-180, 180).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Place = Column | np.ndarray | float

# Series in the third flattening n. Row j holds the factors of n^j, n^(j+1), … for the sine of 2 j times the angle.
_FROM_CONFORMAL = [[2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675], [7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945], [56 / 15, -136 / 35, -1262 / 105, 73814 / 2835], [4279 / 630, -332 / 35, -399572 / 14175], [4174 / 315, -144838 / 6237], [601676 / 22275]]
_TO_GRID = [[1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800], [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360], [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440], [49561 / 161280, -179 / 168, 6601661 / 7257600], [34729 / 80640, -3418889 / 1995840], [212378941 / 319334400]]
_FROM_GRID = [[-1 / 2, 2 / 3, -37 / 96, 1 / 360, 81 / 512, -96199 / 604800], [-1 / 48, -1 / 15, 437 / 1440, -46 / 105, 1118711 / 3870720], [-17 / 480, 37 / 840, 209 / 4480, -5569 / 90720], [-4397 / 161280, 11 / 504, 830251 / 7257600], [-4583 / 161280, 108847 / 3991680], [-20648693 / 638668800]]
_TO_RECTIFYING = [[-3 / 2, 0, 9 / 16, 0, -3 / 32, 0], [15 / 16, 0, -15 / 32, 0, 135 / 2048], [-35 / 48, 0, 105 / 256, 0], [315 / 512, 0, -189 / 512], [-693 / 1280, 0], [1001 / 2048]]
_FROM_RECTIFYING = [[3 / 2, 0, -27 / 32, 0, 269 / 512, 0], [21 / 16, 0, -55 / 32, 0, 6759 / 4096], [151 / 96, 0, -417 / 128, 0], [1097 / 512, 0, -15543 / 2560], [8011 / 2560, 0], [293393 / 61440]]

# Large half axis and inverse flattening of common bodies.
BODIES = {"wgs84": (6378137.0, 298.257223563), "grs80": (6378137.0, 298.257222101), "clrk66": (6378206.4, 294.9786982138982), "intl": (6378388.0, 297.0), "mars": (3396190.0, 169.894447223612), "moon": (1737400.0, 0.0)}
KINDS = ("longlat", "eqc", "merc", "stere", "tmerc")


def _series(table: Sequence[Sequence[float]], n: float) -> list[float]:
    return [sum(f * n ** (j + i) for i, f in enumerate(row)) for j, row in enumerate(table, 1)]


def _with_sines(angle: Place, factors: Sequence[float], m) -> Place:
    out = angle
    for j, f in enumerate(factors, 1):
        if f:
            out = out + f * m.sin(2 * j * angle)
    return out


def _math(x: Place):
    return F if isinstance(x, Column) else np  # both name their functions alike


def _atan2(y: Place, x: Place) -> Place:
    return F.atan2(y, x) if isinstance(y, Column) or isinstance(x, Column) else np.arctan2(y, x)


@dataclass(frozen=True)
class Projection:
    """``kind`` is one of KINDS; ``lat_ts`` is the latitude of true scale of eqc and merc, and of stere at a pole."""

    kind: str = "longlat"
    a: float = 6378137.0
    flattening: float = 0.0
    lat0: float = 0.0
    lon0: float = 0.0
    lat_ts: float | None = None
    k0: float = 1.0
    x0: float = 0.0
    y0: float = 0.0

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"no projection {self.kind!r}; there are {', '.join(KINDS)}")
        if not self.a > 0 or not 0 <= self.flattening < 0.1:
            raise ValueError("the half axis is positive, and the flattening from 0 to below 0.1")
        if not abs(self.lat0) <= 90:
            raise ValueError("the latitude of origin is from -90 to 90")

    @property
    def n(self) -> float:
        return self.flattening / (2 - self.flattening)

    @property
    def e(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    @property
    def radius(self) -> float:
        """Of the sphere whose meridians are as long."""
        return self.a / (1 + self.n) * (1 + self.n**2 / 4 + self.n**4 / 64 + self.n**6 / 256)

    def _isometric(self, lat: Place, m) -> Place:
        return m.asinh(m.tan(lat)) - self.e * m.atanh(self.e * m.sin(lat))

    def _conformal(self, lat: float) -> float:
        return math.copysign(math.pi / 2, lat) if abs(lat) > math.pi / 2 - 1e-12 else math.atan(math.sinh(float(self._isometric(lat, np))))

    def _scale(self, lat: float) -> float:
        """The radius of a parallel over the half axis."""
        return math.cos(lat) / math.sqrt(1 - (self.e * math.sin(lat)) ** 2)

    def _stereographic(self) -> tuple[float, float]:
        """(conformal latitude of the centre, radius of the sphere that is projected, doubled)"""
        lat0 = math.radians(self.lat0)
        centre = self._conformal(lat0)
        pole = math.sqrt((1 + self.e) ** (1 + self.e) * (1 - self.e) ** (1 - self.e))
        if abs(self.lat0) < 90 - 1e-9:
            return centre, 2 * self.a * self.k0 * self._scale(lat0) / math.cos(centre)
        if self.lat_ts is None or abs(self.lat_ts) > 90 - 1e-9:
            return centre, 2 * self.a * self.k0 / pole
        true = math.radians(abs(self.lat_ts))
        return centre, self.a * self.k0 * self._scale(true) / math.tan(math.pi / 4 - self._conformal(true) / 2)

    def _origin(self) -> float:
        """The rectifying latitude of the origin."""
        lat0 = math.radians(self.lat0)
        return float(_with_sines(lat0, _series(_TO_RECTIFYING, self.n), np))

    def _turned(self, lon: Place, m) -> Place:
        d = lon - self.lon0
        return (d - 360 * m.floor((d + 180) / 360)) * (math.pi / 180)

    def forward(self, lon: Place, lat: Place) -> tuple[Place, Place]:
        """(x, y) of degrees. NULL stays NULL, and NaN or an infinity gives no place."""
        m = _math(lon)
        if self.kind == "longlat":
            return lon, lat
        d, phi = self._turned(lon, m), lat * (math.pi / 180)
        if self.kind == "eqc":
            along = self.a * self._scale(math.radians(self.lat_ts or 0.0))
            return along * d + self.x0, self.radius * (_with_sines(phi, _series(_TO_RECTIFYING, self.n), m) - self._origin()) + self.y0
        q = self._isometric(phi, m)
        if self.kind == "merc":
            k = self.a * (self.k0 if self.lat_ts is None else self._scale(math.radians(self.lat_ts)))
            return k * d + self.x0, k * q + self.y0
        tangent = m.sinh(q)  # of the conformal latitude
        if self.kind == "stere":
            centre, double = self._stereographic()
            chi = m.atan(tangent)
            s, c, s0, c0 = m.sin(chi), m.cos(chi), math.sin(centre), math.cos(centre)
            share = double / (1 + s0 * s + c0 * c * m.cos(d))
            return share * c * m.sin(d) + self.x0, share * (c0 * s - s0 * c * m.cos(d)) + self.y0
        xi, eta = _atan2(tangent, m.cos(d)), m.asinh(m.sin(d) / m.sqrt(tangent * tangent + m.cos(d) * m.cos(d)))
        x, y = _both(xi, eta, _series(_TO_GRID, self.n), m)
        k = self.k0 * self.radius
        return k * x + self.x0, k * (y - self._origin()) + self.y0

    def inverse(self, x: Place, y: Place) -> tuple[Place, Place]:
        """(lon, lat) in degrees."""
        m = _math(x)
        if self.kind == "longlat":
            return x, y
        u, v = x - self.x0, y - self.y0
        if self.kind == "eqc":
            d = u / (self.a * self._scale(math.radians(self.lat_ts or 0.0)))
            phi = _with_sines(v / self.radius + self._origin(), _series(_FROM_RECTIFYING, self.n), m)
            return self._degrees(d, phi, m)
        if self.kind == "merc":
            k = self.a * (self.k0 if self.lat_ts is None else self._scale(math.radians(self.lat_ts)))
            d, chi = u / k, m.atan(m.sinh(v / k))
        elif self.kind == "stere":
            centre, double = self._stereographic()
            u, v = u / double, v / double
            square = u * u + v * v
            right, up, out = 2 * u / (1 + square), 2 * v / (1 + square), (1 - square) / (1 + square)  # on the unit sphere
            s0, c0 = math.sin(centre), math.cos(centre)
            s, ahead = out * s0 + up * c0, out * c0 - up * s0
            d, chi = _atan2(right, ahead), _atan2(s, m.sqrt(ahead * ahead + right * right))
        else:
            k = self.k0 * self.radius
            eta, xi = _both(v / k + self._origin(), u / k, _series(_FROM_GRID, self.n), m)
            d = _atan2(m.sinh(eta), m.cos(xi))
            chi = _atan2(m.sin(xi), m.sqrt(m.sinh(eta) * m.sinh(eta) + m.cos(xi) * m.cos(xi)))
        return self._degrees(d, _with_sines(chi, _series(_FROM_CONFORMAL, self.n), m), m)

    def _degrees(self, d: Place, phi: Place, m) -> tuple[Place, Place]:
        lon = d * (180 / math.pi) + self.lon0
        return lon - 360 * m.floor((lon + 180) / 360), phi * (180 / math.pi)

    def proj_string(self) -> str:
        body = f"+R={self.a:.12g}" if self.flattening == 0 else f"+a={self.a:.12g} +b={self.a * (1 - self.flattening):.17g}"
        fields = {"lat_0": self.lat0, "lon_0": self.lon0, "lat_ts": self.lat_ts, "k_0": self.k0, "x_0": self.x0, "y_0": self.y0}
        told = {"longlat": ("lon_0",), "eqc": ("lat_ts", "lat_0", "lon_0", "x_0", "y_0"), "merc": ("lat_ts", "lon_0", "k_0", "x_0", "y_0")}.get(self.kind, tuple(fields))
        return " ".join([f"+proj={self.kind}", *(f"+{k}={fields[k]:.12g}" for k in told if fields[k] is not None), body, "+no_defs"])


def _both(xi: Place, eta: Place, factors: Sequence[float], m) -> tuple[Place, Place]:
    """The series of the transverse kind: (along eta, along xi)."""
    x, y = eta, xi
    for j, f in enumerate(factors, 1):
        if f:
            x = x + f * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
            y = y + f * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
    return x, y


def utm(zone: int, south: bool = False, body: str = "wgs84") -> Projection:
    if not 1 <= zone <= 60:
        raise ValueError("zones are 1 to 60")
    a, inverse = BODIES[body]
    return Projection("tmerc", a, 1 / inverse, lon0=6.0 * zone - 183, k0=0.9996, x0=500_000.0, y0=10_000_000.0 if south else 0.0)


def from_proj_string(text: str) -> Projection:
    """A projection of a text such as ``+proj=stere +lat_0=-90 +R=3396190``; what isn't known here raises ValueError."""
    fields = {k: v for k, _, v in (p.lstrip("+").partition("=") for p in text.split())}
    number = lambda *names, default=0.0: next((float(fields[n]) for n in names if n in fields), default)
    if number("pm") or fields.get("units", "m") != "m":
        raise ValueError("only metres from the prime meridian are read")
    body = fields.get("ellps", fields.get("datum", "wgs84")).lower()
    if not {"R", "a"} & set(fields) and body not in BODIES:
        raise ValueError(f"the body {body!r} is not known")
    a, inverse = BODIES.get(body, (0.0, 0.0))
    flattening = 1 / inverse if inverse else 0.0
    if "R" in fields:
        a, flattening = number("R"), 0.0
    elif "a" in fields:
        a = number("a")
        flattening = 1 - number("b") / a if "b" in fields else 1 / number("rf") if "rf" in fields else number("f")
    if fields.get("proj") == "utm":
        zone = utm(int(number("zone")), "south" in fields)
        return Projection("tmerc", a, flattening, lon0=zone.lon0, k0=zone.k0, x0=zone.x0, y0=zone.y0)
    kind = {"latlong": "longlat", "latlon": "longlat", "lonlat": "longlat"}.get(fields.get("proj", ""), fields.get("proj", ""))
    return Projection(kind, a, flattening, number("lat_0"), number("lon_0"), number("lat_ts") if "lat_ts" in fields else None, number("k_0", "k", default=1.0), number("x_0"), number("y_0"))


def from_map_info(fields: Sequence[str]) -> Projection:
    """Of an ENVI header's ``map info``: UTM with its zone and hemisphere, or Geographic Lat/Lon."""
    kind = fields[0].strip().lower()
    datum = next((b for f in fields for k, b in (("wgs-84", "wgs84"), ("wgs84", "wgs84"), ("north america 1983", "grs80"), ("north america 1927", "clrk66")) if k in f.lower()), "wgs84")
    if kind == "utm":
        return utm(int(fields[7]), fields[8].strip().lower() == "south", datum)
    if kind.startswith("geographic"):
        a, inverse = BODIES[datum]
        return Projection("longlat", a, 1 / inverse)
    raise ValueError(f"the map info of {fields[0]!r} tells no projection")


def pixel_to_latlon(x: Place, y: Place, gt: Sequence[float], projection: Projection) -> tuple[Place, Place]:
    """(lat, lon) of a place in a raster."""
    lon, lat = projection.inverse(gt[0] + x * gt[1] + y * gt[2], gt[3] + x * gt[4] + y * gt[5])
    return lat, lon
