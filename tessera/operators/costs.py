"""Token costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def turn_cost(prompt: Column, hit: Column, output: Column, rate: Column, hit_rate: Column, write_rate: Column, output_rate: Column) -> Column:
    """Cost of a turn, rates per million tokens, to six places.

    With cache data, hits cost the hit rate and the rest the write rate (the plain rate where that is unset or zero); without, the
    whole prompt costs the plain rate. Unset numbers count as 0.
    """
    n = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    miss = F.greatest(F.lit(0.0), n(prompt) - n(hit))
    entry = F.when(n(hit) > 0, n(hit) * n(hit_rate) + miss * F.coalesce(F.nullif(write_rate, F.lit(0.0)), rate)).otherwise(n(prompt) * n(rate))
    return F.round((entry + n(output) * n(output_rate)) / 1e6, 6)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")
