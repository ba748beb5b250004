"""Matches, merged fixtures and what was bet on them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from slipstream import config
from slipstream.functions import timing
from slipstream.functions.numbers import count_rows, ratio_or_zero, rounded, total, total_where
from slipstream.operators.series import drop_empty
from slipstream.operators.skew import lookup


def matches_dim(legs: DataFrame) -> DataFrame:
    """Per match id: first name, first competition, earliest kickoff, legs.

    Legs are folded to (id, name, competition) first, a hash aggregate that
    shrinks before the shuffle; the pick of the first then sees few rows. A null
    id is a group too.
    """
    folded = legs.groupBy("match_id", "match", "competition").agg(
        F.min("row_id").alias("row"), F.min("event_ts").alias("kickoff"), count_rows(legs).alias("legs")
    )

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row")))

    return folded.groupBy("match_id").agg(
        first("match").alias("name"),
        first("competition").alias("competition"),
        F.min("kickoff").alias("kickoff"),
        F.sum("legs").alias("legs"),
    )


def matches_with_day(legs: DataFrame) -> DataFrame:
    """The match dimension with the day that its kickoff counts for."""
    return matches_dim(legs).withColumn("day", timing.fixture_day(F.col("kickoff")))


def fixture_groups(legs: DataFrame) -> DataFrame:
    """Match ids of one game merged by name and shifted kickoff day. The books
    list a game under separate ids before and during play."""
    return groups_of(matches_with_day(legs))


def groups_of(matches: DataFrame) -> DataFrame:
    """``fixture_groups`` from a match dimension with days."""
    return (
        matches.groupBy("name", "day")
        .agg(
            F.min_by("competition", F.coalesce("match_id", F.lit(2**63 - 1))).alias("competition"),
            F.min("kickoff").alias("kickoff"),
            F.count("*").alias("match_ids"),
        )
    )


def with_fixture(legs: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Legs with ``fixture`` and ``fixture_day`` of their match id. Written legs
    carry them already, and are returned as they are. ``matches``, where given, is a
    written match dimension with days of these legs."""
    if "fixture" in legs.columns:
        return legs
    named = (matches_with_day(legs) if matches is None else matches).select(
        "match_id", F.col("name").alias("fixture"), F.col("day").alias("fixture_day"), F.col("legs").alias("of_match")
    )
    return lookup(legs, named, ["match_id"], "of_match", F.col("row_id"), written=matches is not None).drop("of_match")


SLIP_ONCE = ["slip_id", "uid", "betslip_ts", "phase", "slip_stake_eur", "slip_ggr_eur"]


def fixture_slips(fixture_legs: DataFrame, name: str, day: date | str) -> DataFrame:
    """Slips with a leg on the fixture, each once, with its whole money."""
    here = (F.col("fixture") == name) & (F.col("fixture_day") == F.lit(day).cast("date"))
    return fixture_legs.where(here).select(*SLIP_ONCE).distinct()


def fixture_table(fixture_legs: DataFrame, groups: DataFrame) -> DataFrame:
    """Per fixture: full slip money, once per fixture a slip touches, so the
    stakes of all fixtures may add up to more than the headline.

    A SIMPLE leg is its slip, so a customer's SIMPLE legs on a fixture are summed at once; a COMBINED
    slip is a row per fixture, whatever the number of its legs. Both are one aggregate over the legs.
    """
    in_play = config.PHASES[-1]
    combined = F.coalesce(F.col("bet_type") == "COMBINED", F.lit(False))
    several = F.col("several").isNotNull()
    once_or_all = lambda c: F.when(several, F.max(c).cast("decimal(28,6)")).otherwise(total(c)).alias(c)
    once = (
        fixture_legs.withColumn("several", F.when(combined, F.col("slip_id")))
        .groupBy("fixture", "fixture_day", "uid", "phase", "several")
        .agg(
            F.when(several, F.lit(1).cast("long")).otherwise(F.count("*")).alias("slips"),
            once_or_all("slip_stake_eur"),
            once_or_all("slip_ggr_eur"),
        )
    )
    played = once.groupBy("fixture", "fixture_day").agg(
        F.sum("slips").alias("slips"),
        total("slip_stake_eur").alias("stake"),
        total("slip_ggr_eur").alias("ggr"),
        F.count_distinct("uid").alias("customers"),
        total_where("slip_stake_eur", F.col("phase") == in_play).alias("inplay_stake"),
    )
    # One row per fixture on both sides.
    on = F.col("fixture").eqNullSafe(F.col("name")) & F.col("fixture_day").eqNullSafe(F.col("day"))
    return played.join(groups, on).select(
        "name", "day", "competition", "kickoff", "slips", "stake", "ggr", "customers",
        ratio_or_zero(F.col("inplay_stake"), F.col("stake")).alias("inplay_share"),
    )


def fixture_search(table: DataFrame, text: str, top: int = 15) -> DataFrame:
    """Fixtures whose name holds the text, in any case, by stake."""
    return (
        table.where(F.lower("name").contains(text.lower()))
        .orderBy(F.desc("stake"), "name", "day")
        .limit(top)
    )


def fixture_flow(slips: DataFrame, kickoff: Column) -> DataFrame:
    """Stake by half-hour from kickoff and by phase, quiet bins as 0. Phases
    without any stake are left out."""
    low, high, width = config.FLOW_FROM_MIN, config.FLOW_TO_MIN, config.FLOW_BIN_MIN
    minutes = (F.unix_seconds("betslip_ts") - F.unix_seconds(kickoff)) / F.lit(60.0)
    binned = (
        slips.withColumn("minutes", minutes)
        .where((F.col("minutes") >= low) & (F.col("minutes") < high))
        .withColumn("bin", (F.floor((F.col("minutes") - low) / width) * width + low).cast("long"))
        .groupBy("phase", "bin")
        .agg(total("slip_stake_eur").alias("stake"))
    )
    bins = F.sequence(*[F.lit(x).cast("long") for x in (low, high - width, width)])
    phases = F.array(*[F.lit(p) for p in config.PHASES])
    one_row = slips.sparkSession.range(1)
    spine = one_row.select(F.explode(bins).alias("bin")).select(
        "bin", F.explode(phases).alias("phase")
    )
    filled = spine.join(binned, ["phase", "bin"], "left").select(
        "phase", "bin", rounded(F.coalesce("stake", F.lit(0)), 2).alias("stake")
    )
    return drop_empty(filled, "phase", "stake")


def fixture_detail(slips: DataFrame) -> DataFrame:
    """One row: the totals of one fixture's slips."""
    return slips.agg(
        total("slip_stake_eur").alias("stake"),
        total("slip_ggr_eur").alias("ggr"),
        F.count("*").alias("slips"),
        F.count_distinct("uid").alias("customers"),
    )
