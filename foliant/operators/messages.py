"""Conversations, tool activity, token totals, and run progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.tokens import PRICES, PROMPT_OVERHEAD, estimate_tokens, input_cost, output_cost
from foliant.operators.scan import running_max

# The phases of a run and their share of the work.
PHASES = (
    ("Reading documents", 3), ("Summarizing", 3), ("Scanning for repeated logos", 2), ("Checking for changes", 1),
    ("Rendering documents", 5), ("Numbering documents", 1),
)


def deliverable_and_chat(messages: DataFrame, override: str = "") -> DataFrame:
    """Mark each message: the first assistant message is the deliverable.

    With an override document every message is chat. The first turn comes from
    a partial aggregate and is joined back, so a long conversation is not
    collected.
    """
    if override:
        return messages.withColumn("part", F.lit("chat"))
    first = messages.filter(F.col("role") == "assistant").groupBy("conv_id").agg(F.min("turn").alias("_t"))
    part = F.when(F.col("turn") == F.col("_t"), "deliverable").otherwise("chat")
    return messages.join(first, "conv_id", "left").withColumn("part", part).drop("_t")


def token_totals(texts: DataFrame, by: list[str], tier: str = "medium", prompt: bool = False) -> DataFrame:
    """Estimated tokens per group and what they cost as input and output."""
    tokens = F.sum(estimate_tokens(F.col("text")))
    if prompt:
        tokens = tokens + PROMPT_OVERHEAD
    rows = texts.groupBy(*by).agg(tokens.alias("tokens")) if by else texts.agg(F.coalesce(tokens, F.lit(0)).alias("tokens"))
    return rows.withColumn("input_usd", input_cost(F.col("tokens"), tier)).withColumn(
        "output_usd", output_cost(F.col("tokens"), tier))


def price_table(spark) -> DataFrame:
    return spark.createDataFrame(
        [(k, a, b) for k, (a, b) in PRICES.items()], "tier string, in_per_m double, out_per_m double")


def overall_percent(phase: Column, done: Column, total: Column) -> Column:
    """Phase progress as a percentage of the whole run; halves round up."""
    weight = sum(w for _, w in PHASES)
    share = F.when(total > 0, done / total).otherwise(0.0)
    out = F.floor(share * 100 + 0.5)
    before = 0
    for name, w in PHASES:
        whole = F.floor((before + w * F.least(F.lit(1.0), share)) / weight * 100 + 0.5)
        out = F.when(phase == name, whole).otherwise(out)
        before += w
    return out.cast("bigint")


def never_retreating(progress: DataFrame) -> DataFrame:
    """Add ``pct`` and ``shown``, the highest percentage so far per collection."""
    pct = overall_percent(F.col("phase"), F.col("done"), F.col("total"))
    rows = progress.withColumn("pct", pct)
    out = running_max(rows, ["collection", "ts", "event_id"], F.struct("collection", "pct"), "_top")
    return out.withColumn("shown", F.col("_top.pct")).drop("_top")


def paired_activities(events: DataFrame) -> DataFrame:
    """Tool activity rows: a start closed by its end; open ones stay open.

    ``events`` has ``id, type ('start'|'end'), ts, name, ok, summary``. An end
    without a start is dropped, as there is nothing to close.
    """
    start = F.col("type") == "start"
    rows = events.groupBy("id").agg(
        F.min(F.when(start, F.col("ts"))).alias("started_at"),
        F.min_by("name", F.when(start, F.col("ts"))).alias("name"),
        F.max(F.when(~start, F.col("ts"))).alias("ended_at"),
        F.max_by("ok", F.when(~start, F.col("ts"))).alias("ok"),
        F.max_by("summary", F.when(~start, F.col("ts"))).alias("summary"),
    )
    return rows.filter(F.col("started_at").isNotNull())
