"""Numbers, clock times, distances, rates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from taktline.constants import EARTH_RADIUS_KM
from taktline.functions.text import strip


def num(c: Column) -> Column:
    """Strict integer; NULL for anything else."""
    return strip(c.cast("string")).try_cast("int")


def gtfs_seconds(c: Column) -> Column:
    """``H:M:S`` as seconds since service midnight; hours may pass 24."""
    parts = F.split(strip(c), ":")
    piece = [F.get(parts, F.lit(i)).try_cast("int").cast("bigint") for i in range(3)]
    return F.when(F.size(parts) == 3, piece[0] * 3600 + piece[1] * 60 + piece[2]).cast("bigint")


def fmt_time(c: Column) -> Column:
    """Seconds as ``HH:MM``; '' when unknown."""
    hours = F.floor(c / 3600).cast("bigint")
    minutes = F.floor((c - hours * 3600) / 60).cast("bigint")
    return F.when(c.isNull(), "").otherwise(F.format_string("%02d:%02d", hours, minutes))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; NULL when a coordinate is missing."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = (p2 - p1) / 2
    half_lon = (F.radians(lon2) - F.radians(lon1)) / 2
    x = F.pow(F.sin(half_lat), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_lon), 2)
    arc = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(x))) * EARTH_RADIUS_KM
    # least() skips NULL, so the missing point has to be tested.
    return F.when(x.isNotNull(), arc)


def is_bus_route(route_type: Column) -> Column:
    """Route types 3, 11 and the 700-799 bus range."""
    code = num(route_type)
    return F.coalesce(code.isin(3, 11) | code.between(700, 799), F.lit(False))


def safe_rate(n: Column, d: Column, digits: int = 4) -> Column:
    """``n / d`` rounded; NULL when there is nothing to divide by."""
    return F.round(F.try_divide(n.cast("double"), d.cast("double")), digits)


def pct_change(new: Column, old: Column, digits: int = 3) -> Column:
    """Change in per cent; NULL when the old value is 0 or unknown."""
    return F.round(F.try_divide((new - old).cast("double"), old.cast("double")) * 100, digits)
