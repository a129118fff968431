"""Distances, units and time zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null where a coordinate is."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.when(a.isNotNull(), 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


def celsius_to_fahrenheit(c: Column) -> Column:
    return c * 9 / 5 + 32


def mps_to_mph(v: Column) -> Column:
    return v * 2.2369362921


def zone_offset_hours(ts: Column, zone: str) -> Column:
    """Hours by which the zone's wall clock is ahead of UTC at an instant."""
    local = F.from_utc_timestamp(ts, zone)
    return (F.unix_seconds(local.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))) / 3600


def local_to_utc(ts: Column, zone: str = "America/New_York") -> Column:
    return F.to_utc_timestamp(ts, zone)
