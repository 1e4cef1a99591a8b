"""Angles, distances and coordinate systems as column expressions."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_A_DEGREE = 111_320.0
# WGS84.
SEMI_MAJOR, FLATTENING = 6_378_137.0, 1 / 298.257223563
ECC2 = FLATTENING * (2 - FLATTENING)
UTM_SCALE, UTM_EASTING = 0.9996, 500_000.0


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def wrap_angle(angle: Column | str) -> Column:
    """Into [-pi, pi), by floor modulus: written out, since ``pmod`` rounds to the other end next to the seam."""
    turned = _c(angle) + math.pi
    return turned - 2 * math.pi * F.floor(turned / (2 * math.pi)) - math.pi


def round_half_away(x: Column | str, places: int) -> Column:
    """``x`` scaled, rounded half away from zero and scaled back in doubles, as SQL engines round them.

    Spark's own ``round`` goes by the decimal digits, which differ next to a half, and
    loses the sign of a negative number that rounds to zero.
    """
    scaled = F.abs(_c(x) * 10.0**places)
    whole = F.rint(scaled)
    return F.signum(_c(x)) * F.when(scaled - whole == 0.5, whole + 1).otherwise(whole) / 10.0**places


def heading(dx: Column | str, dy: Column | str) -> Column:
    """atan2(dy, dx) by the C library, as SQL engines have it; the JVM's differs in the last bit.

    Where a track turns back on its line, that bit decides between a turn of pi and of -pi.
    """

    def apply(dx: pa.Array, dy: pa.Array) -> pa.Array:
        return pa.array(map(math.atan2, dy.to_pylist(), dx.to_pylist()), pa.float64())

    return F.arrow_udf(apply, "double")(dx, dy)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres on a sphere; the root is clamped to 1."""
    a, b, c, d = map(_c, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(c - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def flat_m(lat1, lon1, lat2, lon2, at_lat=None) -> Column:
    """Equirectangular metres with the cosine of ``at_lat`` (the first point's by default)."""
    a, b, c, d = map(_c, (lat1, lon1, lat2, lon2))
    return F.hypot((c - a) * METRES_A_DEGREE, (d - b) * METRES_A_DEGREE * F.cos(F.radians(a if at_lat is None else _c(at_lat))))


def valid_latlon(lat, lon) -> Column:
    """Within WGS84 bounds and not null island."""
    a, b = _c(lat), _c(lon)
    return (F.abs(a) <= 90) & (F.abs(b) <= 180) & ~((F.abs(a) < 1e-6) & (F.abs(b) < 1e-6))


def compass_deg(dx, dy) -> Column:
    """0 is north, 90 east."""
    return F.pmod(F.degrees(F.atan2(_c(dx), _c(dy))), F.lit(360.0))


def heading_gap_deg(a, b) -> Column:
    return F.abs(F.pmod(_c(a) - _c(b) + 180, F.lit(360.0)) - 180)


def enu_to_latlon(east, north, lat0, lon0) -> tuple[Column, Column]:
    """Local metres about an origin, with latitude-dependent lengths of a degree."""
    phi = F.radians(_c(lat0))
    per_lat = 111132.954 - 559.822 * F.cos(2 * phi) + 1.175 * F.cos(4 * phi)
    per_lon = math.pi / 180 * SEMI_MAJOR * F.cos(phi) / F.sqrt(1 - ECC2 * F.pow(F.sin(phi), 2))
    return _c(lat0) + _c(north) / per_lat, _c(lon0) + _c(east) / per_lon


def latlon_to_ecef(lat, lon, height=0.0) -> tuple[Column, Column, Column]:
    phi, lam, h = F.radians(_c(lat)), F.radians(_c(lon)), _c(height)
    n = SEMI_MAJOR / F.sqrt(1 - ECC2 * F.pow(F.sin(phi), 2))
    return (n + h) * F.cos(phi) * F.cos(lam), (n + h) * F.cos(phi) * F.sin(lam), (n * (1 - ECC2) + h) * F.sin(phi)


def ecef_to_latlon(x, y, z) -> tuple[Column, Column]:
    """Bowring's closed form; better than a millimetre near the ground."""
    x, y, z = map(_c, (x, y, z))
    minor = SEMI_MAJOR * (1 - FLATTENING)
    p = F.hypot(x, y)
    theta = F.atan2(z * SEMI_MAJOR, p * minor)
    ecc2b = (SEMI_MAJOR**2 - minor**2) / minor**2
    phi = F.atan2(z + ecc2b * minor * F.pow(F.sin(theta), 3), p - ECC2 * SEMI_MAJOR * F.pow(F.cos(theta), 3))
    return F.degrees(phi), F.degrees(F.atan2(y, x))


_N = FLATTENING / (2 - FLATTENING)
#: Rectifying radius and series coefficients by n (Krüger 1912, to the fourth order).
_A = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def _atanh(x: Column) -> Column:
    return 0.5 * F.log((1 + x) / (1 - x))


def utm_forward(lat, lon, zone: int) -> tuple[Column, Column]:
    """Easting and northing of the northern hemisphere's zone."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon) - (zone * 6 - 183))
    e = math.sqrt(ECC2)
    t = F.sinh(_atanh(F.sin(phi)) - e * _atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), _atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return UTM_EASTING + UTM_SCALE * _A * east, UTM_SCALE * _A * north


def utm_inverse(east, north, zone: int) -> tuple[Column, Column]:
    """Latitude and longitude of the northern hemisphere's zone."""
    xi, eta = _c(north) / (UTM_SCALE * _A), (_c(east) - UTM_EASTING) / (UTM_SCALE * _A)
    a, b = xi, eta
    for j, beta in enumerate(_BETA, 1):
        a = a - beta * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - beta * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    phi = chi
    for j, delta in enumerate(_DELTA, 1):
        phi = phi + delta * F.sin(2 * j * chi)
    return F.degrees(phi), zone * 6 - 183 + F.degrees(F.atan2(F.sinh(b), F.cos(a)))


def sub_discs(discs: DataFrame, radius: str, tile: float) -> DataFrame:
    """Centres (lat, lon) of discs of radius ``tile`` that cover each disc, itself where it is hardly larger.

    Centres stand on a grid of 1.4 tiles around the disc's own; those farther from it
    than the disc and a tile together are left out.
    """
    step = 1.4 * tile
    n = F.when(F.col(radius) > 1.3 * tile, F.ceil(F.col(radius) / step)).otherwise(0).cast("int")
    grid = discs.withColumn("_i", F.explode(F.sequence(-n, n))).withColumn("_j", F.explode(F.sequence(-n, n)))
    grid = grid.where(F.hypot(F.col("_i") * step, F.col("_j") * step) <= F.col(radius) + tile)
    east = METRES_A_DEGREE * F.greatest(F.lit(0.2), F.cos(F.radians("lat")))
    lat, lon = F.col("lat") + F.col("_i") * step / METRES_A_DEGREE, F.col("lon") + F.col("_j") * step / east
    return grid.withColumns({"lat": lat, "lon": lon}).drop("_i", "_j")


def mercator(lat, lon) -> tuple[Column, Column]:
    """x and y in metres of Web Mercator."""
    return SEMI_MAJOR * F.radians(_c(lon)), SEMI_MAJOR * F.log(F.tan(math.pi / 4 + F.radians(_c(lat)) / 2))


def mercator_crop(box: tuple, image: tuple, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """First and last column and row, the last exclusive, of a box (south, west, north, east) in a Mercator image of another."""
    (x0, y0), (x1, y1) = mercator(box[0], box[1]), mercator(box[2], box[3])
    (left, bottom), (right, top) = mercator(image[0], image[1]), mercator(image[2], image[3])
    at = lambda part, size: F.rint(part * size).cast("long")

    def span(a: Column, b: Column, size: int) -> tuple[Column, Column]:
        first = F.greatest(F.lit(0).cast("long"), F.least(F.least(a, b), F.lit(size - 1).cast("long")))
        return first, F.greatest(first + 1, F.least(F.greatest(a, b), F.lit(size).cast("long")))

    columns = span(at((x0 - left) / (right - left), width), at((x1 - left) / (right - left), width), width)
    rows = span(at((top - y1) / (top - bottom), height), at((top - y0) / (top - bottom), height), height)
    return *columns, *rows
