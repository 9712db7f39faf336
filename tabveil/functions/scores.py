"""Arithmetic on scores and risks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the two-sided 95 % normal quantile.
Z_95 = 1.959964

# --- fixed values: risk bands (upper bound, label) and traffic light -------
RISK_BANDS = [(0.05, "✅ INSIGNIFICANTE"), (0.20, "⚠️ MODERADO"), (0.50, "🚨 ALTO")]
TOP_RISK_BAND = "🔥 CRÍTICO"
LIGHTS = [(0.15, "● Vulnerabilidade"), (0.05, "● Moderado")]
LOWEST_LIGHT = "● Seguro"


def zero_if_missing(column: Column) -> Column:
    """0.0 in place of null or NaN."""
    value = column.cast("double")
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def safe_round(column: Column, digits: int = 4) -> Column:
    """Rounded value, 0.0 where it is missing."""
    return F.round(zero_if_missing(column), digits)


def wilson(successes: Column, attacks: Column, z: float = Z_95) -> tuple[Column, Column, Column]:
    """Wilson (1927) score centre and interval of ``successes`` in ``attacks``."""
    s, n, z2 = successes.cast("double"), attacks.cast("double"), z * z
    centre = (s + z2 / 2) / (n + z2)
    half = z / (n + z2) * F.sqrt(s * (n - s) / n + z2 / 4)
    return centre, F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def risk_band(risk: Column) -> Column:
    """Verbal band of a risk; each upper bound belongs to its band."""
    banded = None
    for bound, label in RISK_BANDS:
        banded = F.when(risk <= bound, label) if banded is None else banded.when(risk <= bound, label)
    return banded.when(risk.isNotNull(), TOP_RISK_BAND)


def traffic_light(risk: Column) -> Column:
    """Three-colour status of a risk."""
    lit = None
    for bound, label in LIGHTS:
        lit = F.when(risk > bound, label) if lit is None else lit.when(risk > bound, label)
    return lit.when(risk.isNotNull(), LOWEST_LIGHT)


def privacy_score(*risks: Column) -> Column:
    """1 - the worst risk; missing risks are ignored, none at all counts as 0."""
    worst = risks[0] if len(risks) == 1 else F.greatest(*risks)
    return 1 - F.coalesce(worst, F.lit(0.0))


def excess_risk(attack: Column, control: Column) -> Column:
    """Risk beyond that of a hold-out attack, scaled to what was left to gain."""
    return F.when(control < 1, (attack - control) / (1 - control)).otherwise(0.0)


def retention(score: Column, reference: Column) -> Column:
    """Score as a percentage of a reference score."""
    return F.when(reference != 0, score / reference * 100)
