"""Acceptance rules and run parameters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def inside_box(lat: Column, lon: Column, south: Column, west: Column, north: Column, east: Column, margin: float = 0.0) -> Column:
    return lat.between(south - margin, north + margin) & lon.between(west - margin, east + margin)


def boxes_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether boxes (x0, y0, x1, y1) share a point."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def usable_crs(crs: Column) -> Column:
    """The name of a coordinate system, null where it is blank or the word None."""
    trimmed = F.trim(crs)
    return F.when((trimmed != "") & (F.lower(trimmed) != "none"), trimmed)


def second_pass_accepted(first: Column, second: Column, slack: float = 0.02) -> Column:
    """A finer search counts if its median similarity falls at most ``slack`` behind."""
    return second >= first - slack


def refinement_accepted(base: Column, refined: Column, moved: Column, ratio: float = 1.1, most: float = 100.0) -> Column:
    """A refined place counts if the track fits it almost as well and the pinned start stays near."""
    return (refined <= ratio * base) & (moved <= most)


def scale_arbitrated(base: Column, other: Column, factor: Column) -> Column:
    """The other scale wins with a median under nine tenths, if its factor is sane and worth a try."""
    return factor.between(0.33, 3.0) & (F.abs(factor - 1) > 0.15) & (other < 0.9 * base)


def frame_stride(seconds: Column, rate: Column | float, frames: int = 4800) -> Column:
    return F.greatest(F.lit(3), F.ceil(seconds * rate / frames)).cast("long")


def resample_size(size: int, step: int, n: Column, windows: int = 12) -> Column:
    """Points to resample to so that about ``windows`` windows fit, no more than there are."""
    return F.greatest(F.lit(size).cast("long"), F.least(F.lit(size + (windows - 1) * step).cast("long"), n))


def pose_index(frame: Column, n_frames: Column, n_poses: Column) -> Column:
    """The pose row of a frame, rounded half to even; null where either axis has no extent."""
    scaled = F.rint(frame * F.try_divide(n_poses - 1, n_frames - 1)).cast("long")
    return F.when(n_frames == n_poses, frame).when((n_frames >= 2) & (n_poses >= 2), scaled)


def remap_pair(i: Column, j: Column, n_frames: Column, n_poses: Column) -> Column:
    """struct(i, j) of a frame pair among the poses; null where they fall together or outside."""
    a, b = pose_index(i, n_frames, n_poses), pose_index(j, n_frames, n_poses)
    return F.when((a >= 0) & (a < b) & (b < n_poses), F.struct(a.alias("i"), b.alias("j")))


def region_rows(height: Column, region: Column, share: float = 0.18) -> tuple[Column, Column]:
    """First and last image row, exclusive, of the top or bottom strip; the whole image otherwise."""
    strip = F.greatest(F.lit(1), F.floor(height * share)).cast("long")
    return F.when(region == "bottom", height - strip).otherwise(F.lit(0)), F.when(region == "top", strip).otherwise(height)


def box_of_polygon(points: Column) -> Column:
    """struct(x0, y0, x1, y1) around an array of points; null for none."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1")))


def crop_box(box: Column, width: Column, height: Column, margin: float) -> Column:
    """The box widened by ``margin`` of its sides on each of them, in whole pixels inside the image."""
    dx, dy = (box["x1"] - box["x0"]) * margin, (box["y1"] - box["y0"]) * margin
    return F.struct(
        F.greatest(F.lit(0), F.floor(box["x0"] - dx)).cast("long").alias("x0"),
        F.greatest(F.lit(0), F.floor(box["y0"] - dy)).cast("long").alias("y0"),
        F.least(width, F.ceil(box["x1"] + dx)).cast("long").alias("x1"),
        F.least(height, F.ceil(box["y1"] + dy)).cast("long").alias("y1"),
    )


def local_name(tag: Column) -> Column:
    """The part of an XML name behind its namespace."""
    return F.substring_index(tag, "}", -1)


def fingerprint(*columns: Column | str, length: int = 10) -> Column:
    """The first characters of the sha1 of a row's JSON."""
    return F.substring(F.sha1(F.to_json(F.struct(*columns)).cast("binary")), 1, length)


# Words that cannot open a city's name in a title, and countries that may follow one.
TITLE_NOISE = [
    "Best", "Dashcam", "Drive", "Driving", "Driver", "Street", "Streets", "Road", "Roads", "Walk", "Walking", "Trip", "Travel",
    "Tour", "Night", "Rain", "Snow", "Traffic", "Highway", "Motorway", "Autobahn", "Freeway", "City", "Downtown", "Center",
    "Centre", "POV", "POV.", "HD", "HDR", "UHD", "ASMR",
]
COUNTRIES = [
    "Germany", "France", "Italy", "Spain", "Portugal", "Netherlands", "Belgium", "Austria", "Switzerland", "Poland", "Czechia",
    "Czech", "England", "Scotland", "Ireland", "Wales", "UK", "USA", "Canada", "Japan", "China", "India", "Korea", "Australia",
    "New Zealand",
]
#: Ways in which a title names a city: after a preposition, before a kind of clip (with or
#: without a time of day between), in parentheses.  Tried in this order.
_NAME = r"\p{Lu}[\p{L}'’.-]*(?:[\s-]+\p{Lu}[\p{L}'’.-]*){0,3}"
_PLACE = rf"({_NAME})(?:,\s*({_NAME}))?"
_CLIP = r"\s+(?:dashcam|drive|driving|walk|walking|tour|trip)\b"
_MOOD = r"(?:\s+(?:night|day|morning|evening|downtown|center|centre|city)){0,2}"
TITLE_FORMS = [
    rf"\b(?:in|through|around|near|from|to|across|exploring|visiting)\s+{_PLACE}",
    rf"\b{_PLACE}{_CLIP}",
    rf"\b{_PLACE}{_MOOD}{_CLIP}",
    rf"\({_PLACE}\)",
]


def city_of_title(title: Column) -> Column:
    """The city, with its country if that is known, of the first form whose name is not all noise; else null."""
    flat = F.regexp_replace(title, r"\s+", " ")

    def name(form: str, group: int) -> Column:
        found = F.regexp_replace(F.regexp_extract(flat, form, group), r"^[ \-–—:,.|/\[\]()]+|[ \-–—:,.|/\[\]()]+$", "")
        return F.when((found != "") & ~F.split(found, " ")[0].isin(TITLE_NOISE), found)

    def guess(form: str) -> Column:
        city, country = name(form, 1), name(form, 2)
        return F.when(country.isin(COUNTRIES) & (country != city), F.concat_ws(", ", city, country)).otherwise(city)

    return F.coalesce(*map(guess, TITLE_FORMS))


def districts(codes: dict[str, str]) -> Column:
    """A map literal from plate codes to districts."""
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
