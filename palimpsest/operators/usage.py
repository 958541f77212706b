"""Usage and costs of model calls, from logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: BRL for a million tokens, new, cached and written, by how a model's name begins; BRL for one USD.
PRICES = {"gpt-5.4-mini": (4.125, 0.4125, 24.75), "gpt-5.4-nano": (1.1, 0.11, 6.875)}
#: The same by the whole name, up to and beyond LONG_INPUT tokens.
WHOLE_PRICES = {"gpt-5.4": ((13.75, 1.375, 82.5), (13.75, 1.375, 82.5))}
LONG_INPUT = 272_000
BRL_A_USD = 5.5
MOST_EVENTS = 80


def cost_brl(model: Column, tokens_in: Column, cached: Column, tokens_out: Column) -> Column:
    """Cost of a call; null for a model without prices. More cached tokens than there are cost no less than nothing."""
    def cost(prices: tuple[float, float, float]) -> Column:
        new, old, written = map(F.lit, prices)
        return (F.greatest(F.lit(0), tokens_in - cached) * new + cached * old + tokens_out * written) / F.lit(1e6)

    name, out = F.lower(F.trim(model)), F.lit(None).cast("double")
    for whole, (short, long) in WHOLE_PRICES.items():
        out = F.when(name == whole, F.when(tokens_in > LONG_INPUT, cost(long)).otherwise(cost(short))).otherwise(out)
    for start, prices in PRICES.items():
        out = F.when(F.startswith(name, F.lit(start)), cost(prices)).otherwise(out)
    return out


def totals(log: DataFrame, session: str) -> DataFrame:
    """For each session: calls, ok, failed, tokens and costs; calls of unknown models cost nothing known."""
    return log.withColumn("_brl", cost_brl(F.col("model"), F.col("tokens_in"), F.col("cached"), F.col("tokens_out"))).groupBy(session).agg(
        F.count("*").alias("calls"), F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("_brl").alias("brl"), (F.sum("_brl") / BRL_A_USD).alias("usd"),
    )


def recent(events: DataFrame, session: str, at: str, key: str, most: int = MOST_EVENTS) -> DataFrame:
    """The newest events of each session, with rank."""
    order = Window.partitionBy(session).orderBy(F.desc(at), F.desc(key))
    return events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def references(log: DataFrame, session: str, refs: str, at: str = "event_id") -> DataFrame:
    """(session, reference, place): trimmed references that are not blank, once each, in the order of their first call."""
    told = log.select(session, F.col(at).alias("_at"), F.posexplode(refs).alias("_nth", "_r")).withColumn("reference", F.trim("_r")).where("reference != ''")
    first = told.groupBy(session, "reference").agg(F.min(F.struct("_at", "_nth")).alias("_first"))
    order = Window.partitionBy(session).orderBy("_first", "reference")
    return first.select(session, "reference", F.row_number().over(order).alias("place"))
