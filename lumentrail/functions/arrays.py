"""Expressions over array columns: light curves, masks, quantiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumentrail.functions.sky import is_valid


def masked_sum(curve: Column, mask: Column) -> Column:
    """Sum of a curve where the mask holds."""
    return F.aggregate(F.zip_with(curve, mask, lambda v, m: F.when(m, v).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)


def likelihood_curve(psi: Column, phi: Column, mask_value: float = 0.0) -> Column:
    """psi / sqrt(phi) per observation; ``mask_value`` where either isn't finite or phi is 0."""
    return F.zip_with(psi, phi, lambda p, q: F.when(is_valid(p) & is_valid(q) & (q > 0), p / F.sqrt(q)).otherwise(F.lit(mask_value)))


def flux_curve(psi: Column, phi: Column) -> Column:
    return F.zip_with(psi, phi, lambda p, q: F.when(is_valid(p) & is_valid(q) & (q != 0), p / q))


def quantile(ordered: Column, q: float) -> Column:
    """Linearly interpolated quantile of an ascending array without nulls; null if it is empty."""
    at = (F.size(ordered) - 1) * F.lit(q)
    lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.get(ordered, lo), F.get(ordered, hi)
    return F.when(F.size(ordered) > 0, a + (b - a) * (at - lo))


def lower_median(ordered: Column) -> Column:
    """The middle value, the lower of two."""
    return F.when(F.size(ordered) > 0, F.get(ordered, ((F.size(ordered) - 1) / 2).cast("int")))


def count_true(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda m: m))
