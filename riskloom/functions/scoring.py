"""Scalar expressions on transactions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F



def log_amount(amount: str = "amount") -> Column:
    return F.log1p(F.greatest(F.col(amount), F.lit(0.0)))


def ratio(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rule_score() -> Column:
    return F.when(F.col("type").isin("TRANSFER", "CASH_OUT"), log_amount()).otherwise(F.lit(-1e9))


def decision(p: Column, review: float, block: float) -> Column:
    p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return F.when(p >= block, "block").when(p >= review, "review").otherwise("approve")


def priority(p: Column, amount: Column, alpha: Column, scale: Column) -> Column:
    """Probability weighted by amount: alpha 0 leaves the probability as it is, amounts below 0 count as 0.

    Probabilities and alphas outside [0, 1], amounts that aren't finite and scales that aren't positive are errors of the
    query that meets them.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    weighted = F.when(alpha == 0, p).otherwise(p * F.pow(F.greatest(amount, F.lit(0.0)) / scale, alpha))
    wrong = lambda cond, said: F.when(cond, F.raise_error(F.lit(said)))
    faults = [(finite(alpha) & alpha.between(0, 1), "alpha must lie in [0, 1]"), (finite(scale) & (scale > 0), "the scale must be positive and finite"), (finite(p) & p.between(0, 1), "probabilities must lie in [0, 1]"), (finite(amount), "amounts must be finite")]
    out = weighted
    for good, said in reversed(faults):
        out = wrong(~good, said).otherwise(out)
    return out


def adjust_for_prior(p: Column, source: float, target: float) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-8)), F.lit(1 - 1e-8))
    odds = q / (1 - q) * (target / (1 - target)) / (source / (1 - source))
    return odds / (1 + odds)


def recipient_intensity() -> Column:
    """Activity of a recipient before the payment; negative inputs count as 0."""
    part = lambda c: F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0)))
    return part("recipient_fanin_24h") + 0.5 * part("recipient_tx_7d") + 0.25 * part("recipient_amount_24h") + part("recipient_unique_senders_7d")


def precision_from_rates(prevalence: Column, recall: Column, fpr: Column) -> Column:
    return ratio(prevalence * recall, prevalence * recall + (1 - prevalence) * fpr)


def two_proportion_sample_size(p1: float, p2: float, alpha: float = 0.05, power: float = 0.8) -> int:
    if not (0 < p1 < 1 and 0 < p2 < 1) or p1 == p2:
        raise ValueError("two different proportions between 0 and 1 are needed")
    z, mid = NormalDist().inv_cdf, (p1 + p2) / 2
    same, apart = math.sqrt(2 * mid * (1 - mid)), math.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return math.ceil(((z(1 - alpha / 2) * same + z(power) * apart) / (p1 - p2)) ** 2)
