"""Attributable risk from probabilities with and without the forcing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def far(fact: Column, counter: Column, convention: str = "standard") -> Column:
    """1 - counter / fact; convention "spec" is 1 - fact / counter. A counterfactual of 0 gives 1."""
    if convention == "spec":
        return F.when(counter <= 0, F.lit(1.0)).otherwise(F.lit(1.0) - fact / counter)
    if convention != "standard":
        raise ValueError(f"unknown convention: {convention}")
    return F.when(counter <= 0, F.lit(1.0)).when(fact <= 0, F.lit(float("-inf"))).otherwise(F.lit(1.0) - counter / fact)


def probability_ratio(fact: Column, counter: Column) -> Column:
    return F.when(counter <= 0, F.lit(float("inf"))).otherwise(fact / counter)


def return_period(p: Column) -> Column:
    return F.when(p <= 0, F.lit(float("inf"))).otherwise(F.lit(1.0) / p)
