"""Closed forms of the decay models, as expressions over time and parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hepatocytes of a liver (per gram, grams, in millions), and basal production in the same unit.
LIVER_CELLS = 927 * 107 * 10**6 / 1_000_000
BASAL_PRODUCTION = 10**8 / 1_000_000


def exponential(t: Column, L0: Column, C: Column, d: Column) -> Column:
    """EX: first-order decay with a constant source."""
    return C / d + (L0 - C / d) * F.exp(-d * t)


def biexponential(t: Column, C: Column, L0: Column, a: Column, d1: Column, d2: Column) -> Column:
    """BI: two decays over a constant level."""
    return C + L0 * a * F.exp(-d1 * t) + L0 * (1 - a) * F.exp(-d2 * t)


def square_impulse(t: Column, C: Column, L0: Column, k: Column, tau: Column, d: Column) -> Column:
    """SQ: as EX, with an additional source k until time tau."""
    return C / d + (L0 - C / d) * F.exp(-d * t) + (k / d) * impulse_response(t, tau, d)


def impulse_response(t: Column, tau: Column, d: Column) -> Column:
    """Rise towards 1 at rate d until tau, decay from there on."""
    after = F.when(t >= tau, F.exp(-d * (t - tau)) - 1).otherwise(F.lit(0.0))
    return 1 - F.exp(-d * t) + after


def cell_loss_response(t: Column, kappa: Column, d: Column) -> Column:
    """Marker released by cells that are lost at rate kappa and cleared at rate d, per unit of excess cells."""
    return d / (d - kappa) * (F.exp(-kappa * t) - F.exp(-d * t))


def cell_loss(t: Column, H0: Column, L0: Column, a: Column, d: Column, bLFT: Column, bHEP: Column) -> Column:
    """FH: cell loss and clearance, in terms of the baseline marker and the baseline cell mass."""
    excess = H0 / bHEP - 1
    return bLFT + bLFT * excess * cell_loss_response(t, a / bHEP, d) + (L0 - bLFT) * F.exp(-d * t)


def cell_mass(t: Column, H0: Column, a: Column, bHEP: Column) -> Column:
    """Cell mass over time that goes with FH."""
    return bHEP + (H0 - bHEP) * F.exp(-(a / bHEP) * t)
