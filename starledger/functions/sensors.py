"""Sensor arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors, and the published coefficients of dew point (Magnus) and heat
# index (the nine-term regression of the weather service).
MPS_TO = {"mph": 2.2369362920544, "knots": 1.9438444924406, "kph": 3.6}
INHG_IN_HPA, MMHG_IN_HPA, FEET_IN_METER, MILE_IN_KM = 33.86389, 1.333224, 3.280839895, 1.609344
MAGNUS_A, MAGNUS_B = 17.27, 237.7
HEAT = (-42.379, 2.04901523, 10.14333127, -0.22475541, -0.00683783, -0.05481717, 0.00122874, 0.00085282, -0.00000199)

CONVERSIONS = {
    "c_to_f": lambda c: c * 9.0 / 5.0 + 32,
    "f_to_c": lambda c: (c - 32) * 5.0 / 9.0,
    "c_to_k": lambda c: c + 273.15,
    "k_to_c": lambda c: c - 273.15,
    "f_to_k": lambda c: (c - 32) * 5.0 / 9.0 + 273.15,
    "k_to_f": lambda c: (c - 273.15) * 9.0 / 5.0 + 32,
    "hpa_to_psi": lambda c: c * 0.0145037738,
    "hpa_to_inhg": lambda c: c / INHG_IN_HPA,
    "inhg_to_hpa": lambda c: c * INHG_IN_HPA,
    "hpa_to_mmhg": lambda c: c / MMHG_IN_HPA,
    "mmhg_to_hpa": lambda c: c * MMHG_IN_HPA,
    "mps_to_mph": lambda c: c * MPS_TO["mph"],
    "mps_to_knots": lambda c: c * MPS_TO["knots"],
    "mps_to_kph": lambda c: c * MPS_TO["kph"],
    "kph_to_mph": lambda c: c / MILE_IN_KM,
    "mph_to_kph": lambda c: c * MILE_IN_KM,
    "m_to_ft": lambda c: c * FEET_IN_METER,
    "mm_to_in": lambda c: c / 25.4,
    "inhg_to_psi": lambda c: c * INHG_IN_HPA * 0.0145037738,
    "inhg_to_mmhg": lambda c: c * 25.4,
    "km_to_mi": lambda c: c / MILE_IN_KM,
    "kph_to_knots": lambda c: c / 1.852,
    "mph_to_knots": lambda c: c * MILE_IN_KM / 1.852,
    "mph_to_mps": lambda c: c * MILE_IN_KM / 3.6,
}


def _gamma(temp_c: Column, humidity: Column) -> Column:
    return MAGNUS_A * temp_c / (MAGNUS_B + temp_c) + F.ln(humidity / 100)


def dew_point(temp_c: Column, humidity: Column) -> Column:
    """Celsius; null without humidity."""
    g = _gamma(temp_c, humidity)
    return F.when(humidity > 0, MAGNUS_B * g / (MAGNUS_A - g))


def frost_point(temp_c: Column, dew_c: Column) -> Column:
    """Celsius."""
    t, d = temp_c + 273.15, dew_c + 273.15
    return d + 2671.02 / (2954.61 / t + 2.193665 * F.ln(t) - 13.3448) - t - 273.15


def heat_index(temp_f: Column, humidity: Column) -> Column:
    """Fahrenheit."""
    a = HEAT
    t, r = temp_f, humidity
    return a[0] + a[1] * t + a[2] * r + a[3] * t * r + a[4] * t * t + a[5] * r * r + a[6] * t * t * r + a[7] * t * r * r + a[8] * t * t * r * r


def magnitude(value: Column, zero: float = 0.0) -> Column:
    """-2.5 log10 of a brightness; 0 where there is none."""
    return F.when(value > 0, F.lit(zero) - 2.5 * F.log10(value)).otherwise(0.0)


def weighted_sqm(adu: Column, exposure: Column, gain: Column, exposure_max: float, gain_max: float) -> Column:
    """F16."""
    return ((exposure_max - exposure) / 10 + 1) * (adu * ((gain_max - gain) / 10 + 1))


def next_exposure(exposure: Column, adu: Column, target: float, scale: float, low: float, high: float) -> Column:
    """a share of the way to the exposure that would meet the target, within bounds."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.when(adu > 0, exposure - (exposure - exposure * (target / adu)) * scale).otherwise(exposure)))


def to_decibel(value: Column, reference: Column | float) -> Column:
    """F23."""
    return F.when(value > 0, 20 * F.log10(value / reference))


def gain_ladder(low: float, high: float, steps: int) -> Column:
    """gains in equal steps, thousandths kept."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.round(i * ((high - low) / steps) + low, 3))


def eight_bits(adu: Column, depth: int) -> Column:
    """whole numbers shifted right to eight bits; fractions are cut first."""
    return F.floor(adu.cast("int") / F.pow(F.lit(2.0), F.lit(depth) - 8)).cast("int")


def tier(delta: Column, low: float, medium: float, high: float) -> Column:
    """how hard a heater or fan works; it rests above the widest distance."""
    return F.when(delta <= high, "high").when(delta <= medium, "medium").when(delta <= low, "low").otherwise("off")
