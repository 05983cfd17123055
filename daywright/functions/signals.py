"""Signal and multiplier formulas as column expressions.

The numbers inside the formulas are fixed values of the two models. A missing input gives a
missing result unless noted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daywright.functions.numeric import bound, finite_or, where_present
from daywright.settings import BaselineModel, ExtendedModel


def valuation_zone(z: Column, m: ExtendedModel = ExtendedModel()) -> Column:
    """Zone -2..2 of a z-score; a missing score falls in the last zone."""
    zone = F.lit(2)
    for bound, code in (
        (m.zone_danger, 1),
        (m.zone_caution, 0),
        (m.zone_value, -1),
        (m.zone_deep_value, -2),
    ):
        zone = F.when(z < bound, F.lit(code)).otherwise(zone)
    return zone


def extreme_boost(z: Column, m: ExtendedModel = ExtendedModel()) -> Column:
    """Extra buying in the cheap tail, less in the expensive tail, 0 in between."""
    below, above = z - m.zone_deep_value, z - m.zone_danger
    cheap = F.when(below < 0, 0.5 + 0.8 * below * below).when(z < m.zone_value, -0.5 * z)
    dear = F.when(above >= 0, -0.3 - 0.5 * above * above).when(
        z >= m.zone_caution, -0.3 * (z - m.zone_caution)
    )
    return where_present(F.coalesce(cheap, dear, F.lit(0.0)), z)


def trend_modifier(gradient: Column, z: Column, m: ExtendedModel = ExtendedModel()) -> Column:
    """Scale for the price signal; the trend must be stronger to count when z is high."""
    need = F.when(z < m.zone_value, 0.1).when(z > m.zone_caution, 0.4).otherwise(0.2)
    rising = 1.0 + 0.5 * F.least(gradient, F.lit(1.0))
    falling = 0.3 + 0.2 * (1.0 + gradient)
    raw = F.when(gradient > need, rising).when(gradient < -need, falling).otherwise(1.0)
    return where_present(bound(raw, 0.3, 1.5), gradient, z)


def acceleration_modifier(acceleration: Column, gradient: Column) -> Column:
    gain = F.when(acceleration * gradient > 0, 0.3).otherwise(-0.2)
    return where_present(bound(1.0 + gain * F.abs(acceleration), 0.5, 1.5), acceleration, gradient)


def signal_confidence(z: Column, gradient: Column, price_vs_ma: Column) -> Column:
    """0.7 x agreement of valuation and price signals + 0.3 x trend alignment."""
    value, price = -z / 4, -price_vs_ma
    # The population deviation of two numbers is half their distance.
    agreement = 1.0 - bound(F.abs(value - price) / 2, 0.0, 1.0)
    aligned = ((value < 0) & (gradient > 0)) | (~(value < 0) & (gradient < 0))
    mixed = 0.7 * agreement + 0.3 * F.when(aligned, 1.0).otherwise(0.5)
    return where_present(bound(mixed, 0.0, 1.0), z, gradient, price_vs_ma)


def reversion_pressure(z: Column) -> Column:
    beyond = F.greatest(F.abs(z) - 2, F.lit(0.0))
    return where_present(bound(F.tanh(z / 2) + 0.3 * F.signum(z) * beyond, -1.0, 1.0), z)


def baseline_multiplier(price_vs_ma: Column, m: BaselineModel = BaselineModel()) -> Column:
    """Buy more below the moving average; a missing distance gives 1."""
    exponent = bound(-m.strength * price_vs_ma, -m.exponent_limit, m.exponent_limit)
    return F.coalesce(where_present(F.exp(exponent), price_vs_ma), F.lit(1.0))


def extended_exponent(
    price_vs_ma: Column,
    zscore: Column,
    gradient: Column,
    acceleration: Column | None = None,
    volatility: Column | None = None,
    confidence: Column | None = None,
    sentiment: Column | None = None,
    m: ExtendedModel = ExtendedModel(),
) -> Column:
    """Logarithm of the extended multiplier; an optional signal left out is neutral."""
    accel = F.lit(0.0) if acceleration is None else acceleration
    vol, conf, sent = (F.lit(0.5) if c is None else c for c in (volatility, confidence, sentiment))
    mix = (
        0.64 * (extreme_boost(zscore, m) - zscore)
        - 0.16 * price_vs_ma * trend_modifier(gradient, zscore, m)
        + 0.20 * (0.2 * (sent - 0.5))
    )
    momentum = bound(0.85 + 0.30 * (acceleration_modifier(accel, gradient) - 0.5) / 0.5, 0.85, 1.15)
    conviction = F.when(conf > 0.7, 1.0 + 0.15 * (conf - 0.7) / 0.3).otherwise(1.0)
    calm = F.when(vol > 0.8, 1.0 - m.volatility_dampening * (vol - 0.8) / 0.2).otherwise(1.0)
    return bound(m.strength * mix * momentum * conviction * calm, m.exponent_low, m.exponent_high)


def extended_multiplier(*signals: Column | None, m: ExtendedModel = ExtendedModel()) -> Column:
    """exp of the extended exponent; a missing signal gives 1."""
    given = [c for c in signals if c is not None]
    return F.coalesce(where_present(F.exp(extended_exponent(*signals, m=m)), *given), F.lit(1.0))
