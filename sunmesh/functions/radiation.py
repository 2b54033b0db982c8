"""Empirical hourly radiation from a daily total, as one native column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fourier terms of the solar declination (radians), as (order, cosine, sine).
DECLINATION_MEAN = 0.006918
DECLINATION_TERMS = [(1, -0.399912, 0.070257), (2, -0.006758, 0.000907), (3, -0.002697, 0.001480)]
# Equation of time (minutes); the second and third term are both cosines in the published form.
TIME_TERMS = (9.87, -7.53, -1.5)
# Intercept and slope of the two sunset-angle coefficients.
COEFFICIENT_A = (0.4090, 0.5016)
COEFFICIENT_B = (0.6609, 0.4767)


def solar_time(local_hour: Column, lon: Column, meridian: Column, day_of_year: Column) -> Column:
    """Solar time in hours from local clock time, longitude and reference meridian (degrees)."""
    angle = F.radians((day_of_year - 81) * 360.0 / 365.0)
    sine, cosine_1, cosine_2 = TIME_TERMS
    minutes = F.lit(sine) * F.sin(angle * 2.0) + F.lit(cosine_1) * F.cos(angle) + F.lit(cosine_2) * F.cos(angle)
    return local_hour + minutes / 60.0 + (meridian - lon) * (4.0 / 60.0)


def declination(day_of_year: Column) -> Column:
    """Solar declination in radians from its truncated Fourier series."""
    phase = (day_of_year - 1) * (2.0 * math.pi / 365.0)
    total = F.lit(DECLINATION_MEAN)
    for order, cosine, sine in DECLINATION_TERMS:
        total = total + F.cos(phase * order) * cosine + F.sin(phase * order) * sine
    return total


def hourly_radiation(
    lat: Column,
    lon: Column,
    local_hour: Column,
    meridian: Column,
    day_of_year: Column,
    daily_total: Column,
    correction: float = 0.15,
    clip: bool = False,
) -> Column:
    """Share of ``daily_total`` that falls on ``local_hour``, corrected by ``1 + correction``.

    Night hours give negative values and days without sunset a null, as the
    formula has no real sunset angle there; ``clip`` maps negatives to zero.
    """
    cosine_sunset = -F.tan(F.radians(lat)) * F.tan(declination(day_of_year))
    sunset = F.when(F.abs(cosine_sunset) <= 1.0, F.acos(cosine_sunset))
    hour_angle = F.radians((solar_time(local_hour, lon, meridian, day_of_year) - 12.0) * 15.0)
    lift = F.sin(sunset - math.pi / 3.0)
    a = lift * COEFFICIENT_A[1] + COEFFICIENT_A[0]
    b = lift * COEFFICIENT_B[1] + COEFFICIENT_B[0]
    day_arc = F.sin(sunset) - sunset * F.cos(sunset)
    normaliser = a + b * 0.5 * (sunset - F.sin(sunset) * F.cos(sunset)) / day_arc
    ratio = (F.cos(hour_angle) - F.cos(sunset)) / day_arc * (math.pi / 24.0)
    value = (a + b * F.cos(hour_angle)) * ratio / normaliser * daily_total * (1.0 + correction)
    return F.greatest(value, F.lit(0.0)) if clip else value
