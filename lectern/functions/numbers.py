"""Numeric functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HYDROPHOBIC, CHARGED = "AILMFWYV", "DEKRH"


def sequence_features(s: Column) -> Column:
    """Struct of length and the fractions of hydrophobic and charged residues."""
    n = F.greatest(F.length(s), F.lit(1))
    share = lambda letters: F.length(F.regexp_replace(F.upper(s), f"[^{letters}]", "")) / n
    return F.struct(F.length(s).alias("length"), share(HYDROPHOBIC).alias("hydrophobic_fraction"), share(CHARGED).alias("charged_fraction"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def price(c: Column) -> Column:
    """Number, or infinity where there is none."""
    return F.coalesce(c.try_cast("double"), F.lit(float("inf")))


def model_price(prompt: Column, completion: Column) -> Column:
    return price(prompt) + price(completion)


def count_of(c: Column) -> Column:
    """Integer, or 0 where there is none."""
    return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def token_estimate(text: Column) -> Column:
    """A token for each four characters, one at least."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4))


def usage_cost(cost: Column, total_cost: Column, prompt_tokens: Column, completion_tokens: Column, prompt_price: Column, completion_price: Column) -> Column:
    """Stated cost if there is one, else tokens times prices."""
    estimate = F.coalesce(prompt_tokens.try_cast("double"), F.lit(0.0)) * F.coalesce(prompt_price.try_cast("double"), F.lit(0.0)) + F.coalesce(completion_tokens.try_cast("double"), F.lit(0.0)) * F.coalesce(completion_price.try_cast("double"), F.lit(0.0))
    return F.coalesce(cost.try_cast("double"), total_cost.try_cast("double"), estimate)


def track_tokens(track: Column, requested: Column, limits: dict[str, int], default: int = 1024) -> Column:
    """Requested tokens, at most the track's limit."""
    limit = F.lit(default)
    for name, most in limits.items():
        limit = F.when(track == name, most).otherwise(limit)
    return F.least(requested, limit)
