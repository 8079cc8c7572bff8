"""Geographic functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, DEGREE_M = 6_371_000, 111_320
#: Boxes (south, north, west, east) of the continental states, Alaska and Hawaii; a narrower continental one.
CONTINENTAL, ALASKA, HAWAII = (24, 50, -125, -66), (51, 72, -180, -130), (18, 23, -161, -154)
NARROW = (24.396, 49.384, -125.001, -66.934)


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2))))


def place(lat: Column, lng: Column) -> Column:
    """A text of a point's exact coordinates, to group and join by."""
    plain = lambda c: F.when(c == 0, 0.0).otherwise(c)  # noqa: E731 (-0.0 is 0.0)
    return F.concat_ws(",", plain(lat), plain(lng))


def lat_degrees(metres: float) -> float:
    return metres / DEGREE_M


def lng_degrees(metres: float, lat: float) -> float:
    """Degrees of longitude for a distance at a latitude; near a pole those of latitude."""
    cos = math.cos(math.radians(lat))
    return metres / DEGREE_M if cos < 1e-6 else metres / (DEGREE_M * cos)


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float] = CONTINENTAL) -> Column:
    return F.coalesce(lat.between(box[0], box[1]) & lng.between(box[2], box[3]), F.lit(False))


def in_us(lat: Column, lng: Column) -> Column:
    return in_box(lat, lng) | in_box(lat, lng, ALASKA) | in_box(lat, lng, HAWAII)


def _finite(c: Column) -> Column:
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def coordinates(lat: list[Column], lng: list[Column]) -> Column:
    """The first finite latitude and longitude of the columns that may hold them, or null if either is missing."""
    a, b = F.coalesce(*map(_finite, lat)), F.coalesce(*map(_finite, lng))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("lat"), b.alias("lng")))


def parse_coordinates(text: Column) -> Column:
    """``lat,lng`` as a struct; null unless there are two numbers."""
    parts = F.split(text, ",")
    number = lambda k: F.regexp_extract(F.get(parts, F.lit(k)), r"^\s*([+-]?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when((F.size(parts) == 2) & number(0).isNotNull() & number(1).isNotNull(), F.struct(number(0).alias("lat"), number(1).alias("lng")))


def map_url_coordinates(url: Column) -> Column:
    """Coordinates in a map URL: those of the place (``!3d..!4d..``) before those of the view (``@lat,lng``)."""
    place = F.struct(F.regexp_extract(url, r"!3d(-?\d+(?:\.\d+)?)!4d(-?\d+(?:\.\d+)?)", 1).try_cast("double").alias("lat"), F.regexp_extract(url, r"!3d(-?\d+(?:\.\d+)?)!4d(-?\d+(?:\.\d+)?)", 2).try_cast("double").alias("lng"))
    view = F.struct(F.regexp_extract(url, r"@(-?\d+(?:\.\d+)?),(-?\d+(?:\.\d+)?)", 1).try_cast("double").alias("lat"), F.regexp_extract(url, r"@(-?\d+(?:\.\d+)?),(-?\d+(?:\.\d+)?)", 2).try_cast("double").alias("lng"))
    return F.when(place["lat"].isNotNull() & place["lng"].isNotNull(), place).when(view["lat"].isNotNull() & view["lng"].isNotNull(), view)


def _band(lat: Column, metres: float) -> Column:
    """The band of latitudes, each a little more than ``metres`` high, from the equator on."""
    return F.floor(F.degrees(F.lit(metres / EARTH_M * (1 + 1e-9))) ** -1 * lat)


def _cells_of(band: Column, metres: float) -> Column:
    """How many cells a band has around the earth: each is as wide as ``metres`` can be in it or in a band beside it.

    That is where the parallel is shortest, at the band's neighbour nearer to the pole; around a pole there are two cells.
    """
    height = metres / EARTH_M * (1 + 1e-9)
    shortest = F.cos(F.least(F.lit(math.pi / 2), (F.abs(band + 0.5) + 1.5) * height))
    half = F.lit(math.sin(metres / (2 * EARTH_M)) * (1 + 1e-9)) / F.greatest(shortest, F.lit(1e-15))
    return F.floor(F.lit(math.pi) / F.asin(F.least(F.lit(1.0), half)))


def _cell_at(band: Column, lng: Column, metres: float) -> tuple[Column, Column]:
    """A longitude's cell in a band, and how many that has; 180 and -180 degrees are one place."""
    n = _cells_of(band, metres)
    return F.pmod(F.floor((lng + 180) / 360 * n), n), n


def cell(lat: Column, lng: Column, metres: float) -> Column:
    """The point's cell, struct(i, j), in a grid whose near points lie in neighbouring cells everywhere on earth."""
    band = _band(lat, metres)
    return F.struct(band.alias("i"), _cell_at(band, lng, metres)[0].alias("j"))


def cells_around(lat: Column, lng: Column, metres: float) -> Column:
    """The cells in which all points within ``metres`` lie: the longitude's cell and both neighbours, in the own band and those beside it.

    Bands differ in their cells, so that a row near a pole widens no other's. Cells go round the earth, so that points on
    both sides of 180 degrees meet.
    """

    def three(step: int) -> Column:
        band = _band(lat, metres) + step
        j, n = _cell_at(band, lng, metres)
        return F.transform(F.array_distinct(F.array(j, F.pmod(j + 1, n), F.pmod(j - 1, n))), lambda x: F.struct(band.alias("i"), x.alias("j")))

    return F.concat(three(-1), three(0), three(1))
