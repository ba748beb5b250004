"""Filters over slips and legs, and totals of what they keep."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from slipstream.functions.numbers import percent, ratio_or_zero, total
from slipstream.operators.skew import lookup
from slipstream.schema import BY_DAY


@dataclass(frozen=True)
class Filters:
    """AND across fields, OR inside a field; an empty field does not filter.

    ``date_to`` is inclusive. ``match_ids`` are raw ids; ``fixtures`` are merged ones,
    (name, day), and need legs that carry their fixture.
    """

    date_from: str | None = None
    date_to: str | None = None
    phases: list[str] = field(default_factory=list)
    channels: list[str] = field(default_factory=list)
    bet_types: list[str] = field(default_factory=list)
    units: list[str] = field(default_factory=list)
    currencies: list[str] = field(default_factory=list)
    uids: list[str] = field(default_factory=list)
    competitions: list[str] = field(default_factory=list)
    match_ids: list[int] = field(default_factory=list)
    market_groups: list[str] = field(default_factory=list)
    markets: list[str] = field(default_factory=list)
    teams: list[str] = field(default_factory=list)
    players: list[str] = field(default_factory=list)
    fixtures: list[tuple[str, str]] = field(default_factory=list)

    def _slip_tests(self, df: DataFrame, unit: str, currency: str) -> list[Column]:
        tests = [
            F.col(c).isin(list(wanted))
            for c, wanted in (
                ("phase", self.phases), ("channel", self.channels), ("bet_type", self.bet_types),
                (unit, self.units), (currency, self.currencies), ("uid", self.uids),
            )
            if wanted
        ]
        if self.date_from:
            tests.append(F.col("betslip_ts") >= F.lit(self.date_from).cast("timestamp"))
        if self.date_to:
            end = F.lit(self.date_to).cast("timestamp") + F.expr("interval 1 day")
            tests.append(F.col("betslip_ts") < end)
        if BY_DAY in df.columns:  # written tables are partitioned by it; the same bounds prune
            if self.date_from:
                tests.append(F.col(BY_DAY) >= F.lit(self.date_from).cast("timestamp").cast("date"))
            if self.date_to:
                tests.append(F.col(BY_DAY) <= F.lit(self.date_to).cast("timestamp").cast("date"))
        return tests

    def leg_tests(self) -> list[Column]:
        tests = [
            F.col(c).isin(list(wanted))
            for c, wanted in (
                ("competition", self.competitions), ("match_id", self.match_ids),
                ("market_group", self.market_groups), ("market_clean", self.markets),
                ("entity_team", self.teams), ("entity_player", self.players),
            )
            if wanted
        ]
        if self.fixtures:
            games = [
                F.col("fixture").eqNullSafe(F.lit(name)) & F.col("fixture_day").eqNullSafe(F.lit(day).cast("date"))
                for name, day in self.fixtures
            ]
            tests.append(reduce(lambda a, b: a | b, games))
        return tests


def _where_all(df: DataFrame, tests: list[Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def filter_slips(slips: DataFrame, f: Filters) -> DataFrame:
    """The slip-level fields. Plain predicates, so they reach the scan."""
    return _where_all(slips, f._slip_tests(slips, "unit", "currency"))


def filter_by_legs(slips: DataFrame, legs: DataFrame, f: Filters) -> DataFrame:
    """All fields. A slip stays if one single leg passes every leg-level field.

    Matching slip ids are made distinct before the join, so a slip with very
    many matching legs is one row there.
    """
    kept = filter_slips(slips, f)
    if not f.leg_tests():
        return kept
    hits = _leg_hits(legs, f).select("slip_id").distinct()
    return kept.join(hits, "slip_id", "left_semi")


def _leg_hits(legs: DataFrame, f: Filters) -> DataFrame:
    """Legs that pass everything; a leg carries its slip's fields."""
    return _where_all(legs, f._slip_tests(legs, "slip_unit", "slip_currency") + f.leg_tests())


def filter_legs(legs: DataFrame, f: Filters) -> DataFrame:
    """All legs of the slips that ``filter_by_legs`` keeps, including those legs
    that do not pass the leg-level fields themselves."""
    kept = _where_all(legs, f._slip_tests(legs, "slip_unit", "slip_currency"))
    if not f.leg_tests():
        return kept
    hits = _leg_hits(legs, f).groupBy("slip_id").agg(F.max("n_legs").alias("__hit_legs"))
    found = lookup(kept, hits, ["slip_id"], "__hit_legs", F.col("row_id"), null_safe=False)
    return found.where(F.col("__hit_legs").isNotNull()).drop("__hit_legs")


def totals(slips: DataFrame) -> DataFrame:
    """One row; all zero over no slips."""
    stake, ggr, count = total("stake_eur"), total("ggr_eur"), F.count("*")
    return slips.agg(
        count.alias("slips"),
        stake.alias("stake"),
        ggr.alias("ggr"),
        total("net_revenue_eur").alias("net_revenue"),
        F.count_distinct("uid").alias("customers"),
        ratio_or_zero(stake, count).alias("avg_stake"),
        percent(ggr, stake).alias("margin_pct"),
    )


def share_of_total(kept: DataFrame, slips: DataFrame) -> DataFrame:
    """One row: filtered stake and GGR as a percentage of all."""
    whole = slips.agg(F.struct(total("stake_eur").alias("stake"), total("ggr_eur").alias("ggr"))).scalar()
    return kept.agg(
        total("stake_eur").alias("stake"), total("ggr_eur").alias("ggr")
    ).select(
        percent(F.col("stake"), whole["stake"]).alias("stake_pct"),
        percent(F.col("ggr"), whole["ggr"]).alias("ggr_pct"),
    )


def group_by_slip_field(slips: DataFrame, name: str) -> DataFrame:
    """Per value of a slip column: slips, stake, GGR, customers, share, margin."""
    by = slips.groupBy(name).agg(
        F.count("*").alias("slips"),
        total("stake_eur").alias("stake"),
        total("ggr_eur").alias("ggr"),
        F.count_distinct("uid").alias("customers"),
    )
    everything = slips.agg(total("stake_eur")).scalar()
    return by.withColumns(
        {
            "share": percent(F.col("stake"), everything),
            "margin": percent(F.col("ggr"), F.col("stake")),
        }
    )


def competition_breakdown(slips: DataFrame, top: int = 6) -> DataFrame:
    """Slips by the competition of their first leg, largest stake first."""
    return (
        group_by_slip_field(slips.where(F.col("first_competition").isNotNull()), "first_competition")
        .withColumnRenamed("first_competition", "competition")
        .drop("share")
        .orderBy(F.desc("stake"), "competition")
        .limit(top)
    )
