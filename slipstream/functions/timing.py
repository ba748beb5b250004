"""Lead time, phase and time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipstream import config
from slipstream.schema import BY_DAY


def lead_minutes(betslip_ts: Column, first_event_ts: Column) -> Column:
    return (F.unix_seconds(first_event_ts) - F.unix_seconds(betslip_ts)) / F.lit(60.0)


def phase(lead: Column) -> Column:
    """No usable lead time is early pre-match; after kickoff is always in-play."""
    early, day_of, lineups, in_play = config.PHASES
    return (
        F.when(lead < 0, in_play)
        .when(lead <= config.LINEUP_PROXY_MIN, lineups)
        .when(lead <= config.DAY_OF_MIN, day_of)
        .otherwise(early)
    )


def bucket_start(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / F.lit(seconds)) * F.lit(seconds))


def fixture_day(kickoff: Column) -> Column:
    """Kickoff date with the day turning at 06:00, so night games stay together."""
    return F.to_date(kickoff - F.expr(f"interval {config.FIXTURE_DAY_SHIFT_HOURS} hours"))


def betslip_day(df: DataFrame) -> Column:
    """The day of the betslip: the partition column where there is one, so that days prune."""
    return F.col(BY_DAY) if BY_DAY in df.columns else F.to_date("betslip_ts")
