"""Odds and probability expressions; all take and return columns. A missing input gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held(x: Column, low: float, high: float) -> Column:
    """``x`` within its bounds; null stays null, which greatest and least alone would take for a bound."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def american_to_decimal(odds: Column) -> Column:
    """Decimal price of American odds; odds of 0 have none."""
    return F.when(odds > 0, 1 + odds / 100).when(odds < 0, 1 + 100 / F.abs(odds))


def decimal_to_american(price: Column) -> Column:
    """Rounded American odds of a decimal price above 1."""
    return F.when(price >= 2, F.round((price - 1) * 100)).when(price > 1, F.round(-100 / (price - 1)))


def american_to_implied(odds: Column, at_zero: float | None = 0.5) -> Column:
    """Break-even probability; ``at_zero`` is what odds of 0 give (None: null)."""
    zero = F.lit(at_zero).cast("double")
    return F.when(odds > 0, 100 / (odds + 100)).when(odds < 0, F.abs(odds) / (F.abs(odds) + 100)).when(odds == 0, zero)


def profit_per_unit(odds: Column) -> Column:
    return F.when(odds > 0, odds / 100).when(odds < 0, 100 / F.abs(odds))


def no_vig(one: Column, other: Column, clip: float | None = None) -> Column:
    """Share of the first of two implied probabilities, both above 0; optionally kept off 0 and 1 by ``clip``."""
    share = F.when((one > 0) & (other > 0), one / (one + other))
    return share if clip is None else held(share, clip, 1 - clip)


def expected_value(probability: Column, price: Column, stake: float = 1.0) -> Column:
    return probability * (price - 1) * stake - (1 - probability) * stake


def kelly(probability: Column, price: Column, fraction: float = 1.0) -> Column:
    """Fraction of the bankroll to stake, never negative; null where the price pays nothing."""
    edge = ((price - 1) * probability - (1 - probability)) / (price - 1) * fraction
    return F.when(price > 1, F.greatest(F.lit(0.0), edge))


def american_profit(odds: Column, won: Column, pushed: Column | None = None) -> Column:
    """Profit on one unit: the price when won, −1 when lost, 0 on a push; null without odds."""
    base = F.when(won, profit_per_unit(odds)).otherwise(F.lit(-1.0))
    base = base if pushed is None else F.when(pushed, 0.0).otherwise(base)
    return F.when(odds.isNotNull() & (odds != 0), base)


def elo_probability(own: Column, other: Column, home_edge: float = 0.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -(own + home_edge - other) / 400))


def logit(p: Column, clip: float = 1e-6) -> Column:
    kept = held(p, clip, 1 - clip)
    return F.when(p.isNotNull(), F.log(kept / (1 - kept)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution by the rational approximation 7.1.26 of the error function (error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, 1 - half).otherwise(half)


def spread_cover(edge: Column, sigma: float) -> Column:
    return normal_cdf(edge / sigma)


def shrink_to(p: Column, anchor: Column, weight: Column) -> Column:
    return p + (anchor - p) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))


def capped(p: Column, low: Column, high: Column) -> Column:
    return F.when(p.isNotNull(), F.least(F.greatest(p, low), high))


def brier(p: Column, outcome: Column) -> Column:
    return (p - outcome) * (p - outcome)


def log_loss(p: Column, outcome: Column, clip: float = 1e-15) -> Column:
    kept = held(p, clip, 1 - clip)
    return -(outcome * F.log(kept) + (1 - outcome) * F.log(1 - kept))
