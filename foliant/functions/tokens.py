"""Rough token counts and their price."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import utf16_length

# List prices in USD per million tokens (input, output) by tier.
PRICES = {"large": (15.0, 75.0), "medium": (3.0, 15.0), "small": (1.0, 5.0)}
PROMPT_OVERHEAD = 900


def estimate_tokens(text: Column) -> Column:
    """About four characters per token; empty text has none."""
    return F.when(F.length(text) > 0, F.ceil(utf16_length(text) / 4)).otherwise(F.lit(0)).cast("bigint")


Prices = dict[str, tuple[float, float]]


def input_cost(tokens: Column, model: str, prices: Prices = PRICES) -> Column:
    """Price of the tokens by the caller's table (the tiers above by default); an unknown id costs nothing."""
    return tokens / 1_000_000 * prices[model][0] if model in prices else F.lit(0.0)


def output_cost(tokens: Column, model: str, prices: Prices = PRICES) -> Column:
    return tokens / 1_000_000 * prices[model][1] if model in prices else F.lit(0.0)
