"""Geography and weather functions as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_KM = 6371


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres of two points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def saturation(t: Column) -> Column:
    """Saturation vapour pressure in hPa at a temperature in degrees Celsius (Magnus form)."""
    return 6.1094 * F.exp(17.625 * t / (t + 243.04))


def air_density(t: Column, rh: Column, p: Column) -> Column:
    """Density of moist air in kg/m3 from degrees Celsius, per cent and hPa."""
    vapour = saturation(t) * rh / 100
    return (p - vapour) * 100 / (287.058 * (t + 273.15)) + vapour * 100 / (461.495 * (t + 273.15))


def vapour_deficit(t: Column, rh: Column) -> Column:
    """Vapour pressure deficit in kPa."""
    return saturation(t) * (1 - rh / 100) / 10


def humidity(t: Column, dew: Column) -> Column:
    """Relative humidity in per cent from temperature and dew point."""
    return F.least(F.lit(100.0), 100 * saturation(dew) / saturation(t))


def wet_bulb(t: Column, rh: Column) -> Column:
    """Wet-bulb temperature by Stull's fit."""
    return (
        t * F.atan(0.151977 * F.sqrt(rh + 8.313659)) + F.atan(t + rh) - F.atan(rh - 1.676331) + 0.00391838 * F.pow(rh, 1.5) * F.atan(0.023101 * rh) - 4.686035
    )


def rotate_wind(speed: Column, direction: Column, bearing: Column) -> tuple[Column, Column]:
    """Components of a wind along and across a bearing, in the speed's unit."""
    angle = F.radians(direction - bearing)
    return speed * F.cos(angle), speed * F.sin(angle)


def wind_uv(speed: Column, direction: Column) -> tuple[Column, Column]:
    """Eastward and northward components of a wind that comes from a direction."""
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def fahrenheit(t: Column) -> Column:
    return (t - 32) * 5 / 9


def timezone_shift(a: Column, b: Column) -> Column:
    """Hours between two clocks, the short way round."""
    d = F.abs(a - b)
    return F.least(d, 24 - d)
