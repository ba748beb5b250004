"""Reconciliation facts, and the check that every surface agrees on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from slipstream import config
from slipstream.functions.numbers import ROWS, count_rows, euro, fixed, percent, total

METRICS = [
    "turnover", "ggr", "margin", "slips", "customers", "window", "legs", "net_revenue",
]


def headline_totals(slips: DataFrame) -> DataFrame:
    """One row of headline numbers. Each slip is rounded to what an export of it
    carries before it is summed, so every surface adds up the same numbers."""
    return _headline(
        slips, F.sum(F.round("stake_eur", 2)), F.sum(F.round("ggr_eur", 2)), F.sum(F.round("net_revenue_eur", 4)),
        F.count("*"), lambda kind: F.count_if(F.col("bet_type") == kind), F.count_distinct("uid"), F.max("betslip_ts"),
    )


def headline_of_cube(flow: DataFrame, customers: DataFrame) -> DataFrame:
    """``headline_totals`` from folded slips and a row per customer."""
    known = customers.agg(F.count("uid").alias("n")).scalar()
    of_kind = lambda kind: F.coalesce(F.sum(F.when(F.col("bet_type") == kind, F.col(ROWS))), F.lit(0))
    return _headline(
        flow, F.sum("stake_shown"), F.sum("ggr_shown"), F.sum("net_shown"), count_rows(flow), of_kind,
        F.coalesce(F.first(known), F.lit(0)), F.max("last_ts"),
    )


def _headline(
    slips: DataFrame, stake: Column, ggr: Column, net: Column, count: Column, of_kind: Callable[[str], Column],
    customers: Column, last: Column,
) -> DataFrame:
    return slips.agg(
        F.coalesce(stake, F.lit(0)).alias("turnover_eur"),
        F.coalesce(ggr, F.lit(0)).alias("ggr_eur"),
        F.coalesce(F.round(net, 2), F.lit(0)).alias("net_revenue_eur"),
        F.round(percent(ggr, stake).cast("decimal(28,9)"), 2).alias("margin_pct"),
        count.alias("slips"),
        of_kind("SIMPLE").alias("slips_simple"),
        of_kind("COMBINED").alias("slips_combined"),
        customers.alias("customers"),
        F.min("betslip_ts").alias("betslip_min"),
        last.alias("betslip_max"),
    )


def raw_row_totals(legs: DataFrame) -> DataFrame:
    """One row: sums over legs, where a combined slip's money is repeated."""
    inferred = F.coalesce(F.sum("currency_inferred"), F.lit(0)) if ROWS in legs.columns else F.count_if("currency_inferred")
    return legs.agg(
        count_rows(legs).alias("legs"),
        F.round(total("stake_eur"), 2).alias("raw_turnover_eur"),
        F.round(total("ggr_eur"), 2).alias("raw_ggr_eur"),
        inferred.alias("currency_rows_inferred"),
    )


def phase_counts(slips: DataFrame) -> DataFrame:
    return slips.groupBy("phase").agg(
        F.count("stake_eur").alias("slips"), F.round(total("stake_eur"), 2).alias("stake_eur")
    )


def recon_table(stats: DataFrame, slips: DataFrame, legs: DataFrame) -> DataFrame:
    """Four lines from raw files to headline: rows, turnover, GGR."""
    return recon_lines(stats, headline_totals(slips), raw_row_totals(legs))


def recon_lines(stats: DataFrame, head: DataFrame, raw: DataFrame) -> DataFrame:
    files = stats.select(
        F.concat(F.lit("file "), F.col("source")).alias("name"),
        "rows",
        F.col("stake").alias("turnover"),
        "ggr",
        F.lit("raw rows, mixed currencies").alias("note"),
    )
    union = raw.select(
        F.lit("union, deduped").alias("name"),
        F.col("legs").alias("rows"),
        F.col("raw_turnover_eur").alias("turnover"),
        F.col("raw_ggr_eur").alias("ggr"),
        F.lit("EUR, leg rows").alias("note"),
    )
    slip_level = head.select(
        F.lit("slip-level (headline)").alias("name"),
        F.col("slips").alias("rows"),
        F.col("turnover_eur").alias("turnover"),
        F.col("ggr_eur").alias("ggr"),
        F.concat(F.lit("margin "), fixed(F.col("margin_pct"), 2), F.lit("%")).alias("note"),
    )
    return files.unionByName(union).unionByName(slip_level)


def headline_cards(slips: DataFrame) -> DataFrame:
    """Six label and value pairs, formatted for display."""
    return cards_of(headline_totals(slips))


def cards_of(headline: DataFrame) -> DataFrame:
    cards = {
        "Turnover": euro(F.col("turnover_eur")),
        "GGR": euro(F.col("ggr_eur")),
        "Blended margin": F.concat(fixed(F.col("margin_pct"), 2), F.lit("%")),
        "Betslips": F.format_number("slips", 0),
        "Customers": F.format_number("customers", 0),
        "Window": _window(F.col("betslip_min"), F.col("betslip_max")),
    }
    return _long(headline, cards, "label")


def _window(low: Column, high: Column) -> Column:
    return F.concat_ws(" to ", F.date_format(low, "yyyy-MM-dd"), F.date_format(high, "yyyy-MM-dd"))


def _long(row: DataFrame, values: dict[str, Column], key: str, value: str = "value") -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias(key), v.alias(value)) for k, v in values.items()])
    return row.select(F.inline(pairs))


def consistency_check(
    slips: DataFrame, legs: DataFrame, cards: DataFrame, slip_facts: DataFrame, leg_facts: DataFrame,
    strict: bool = False,
) -> DataFrame:
    return compare_surfaces(headline_totals(slips), raw_row_totals(legs), cards, slip_facts, leg_facts, strict)


def compare_surfaces(
    headline: DataFrame, raw: DataFrame, cards: DataFrame, slip_facts: DataFrame, leg_facts: DataFrame,
    strict: bool = False,
) -> DataFrame:
    """The same headline from the facts, the findings and the exported columns.

    One row per metric with ``ok``. ``strict`` stops the job on a mismatch. A
    surface that does not show a metric has null there and is not compared.
    """
    recon = _long(
        headline,
        {
            "turnover": euro(F.col("turnover_eur")),
            "ggr": euro(F.col("ggr_eur")),
            "margin": F.concat(fixed(F.col("margin_pct"), 2), F.lit("%")),
            "slips": F.format_number("slips", 0),
            "customers": F.format_number("customers", 0),
            "window": _window(F.col("betslip_min"), F.col("betslip_max")),
            "net_revenue": euro(F.col("net_revenue_eur")),
        },
        "metric",
        "recon",
    ).unionByName(
        _long(raw, {"legs": F.format_number("legs", 0)}, "metric", "recon")
    )
    shown = {
        "Turnover": "turnover", "GGR": "ggr", "Blended margin": "margin",
        "Betslips": "slips", "Customers": "customers", "Window": "window",
    }
    metric = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in shown.items()])
    findings = cards.select(metric.alias("metric"), F.col("value").alias("findings"))
    stake, ggr = F.sum("stake"), F.sum("ggr")
    facts = _long(
        slip_facts.agg(
            stake.alias("stake"), ggr.alias("ggr"), F.sum("nr").alias("nr"),
            percent(ggr, stake).alias("margin"), F.count("*").alias("slips"),
            F.count_distinct("uid").alias("customers"), F.min("ts").alias("low"), F.max("ts").alias("high"),
        ),
        {
            "turnover": euro(F.col("stake")),
            "ggr": euro(F.col("ggr")),
            "margin": F.concat(fixed(F.col("margin"), 2), F.lit("%")),
            "slips": F.format_number("slips", 0),
            "customers": F.format_number("customers", 0),
            "window": _window(F.timestamp_seconds("low"), F.timestamp_seconds("high")),
            "net_revenue": euro(F.round("nr", 2)),
        },
        "metric",
        "facts",
    ).unionByName(
        _long(leg_facts.agg(F.count("*").alias("n")), {"legs": F.format_number("n", 0)}, "metric", "facts")
    )
    # Eight rows on each side.
    table = recon.join(findings, "metric", "full_outer").join(facts, "metric", "full_outer")
    agrees = lambda c: F.col(c).isNull() | F.col(c).eqNullSafe(F.col("recon"))
    checked = table.select(
        "metric", "recon", "findings", "facts", (agrees("findings") & agrees("facts")).alias("ok")
    )
    if not strict:
        return checked
    stop = F.raise_error(F.concat(F.lit("surfaces disagree on "), F.col("metric"))).cast("boolean")
    return checked.withColumn("ok", F.when(F.col("ok"), F.lit(True)).otherwise(stop))
