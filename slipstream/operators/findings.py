"""Tables behind the written findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipstream import config
from slipstream.functions.numbers import count_rows, percent, ratio, rounded, total, total_where
from slipstream.functions import timing
from slipstream.operators.rank import gini, ordered_counts


def _scaled(groups: DataFrame, name: str, stake_total: Column) -> DataFrame:
    """stake, ggr, share and margin of each group."""
    return groups.withColumns(
        {
            "share": percent(F.col("stake"), stake_total),
            "margin": percent(F.col("ggr"), F.col("stake")),
        }
    ).select(name, "stake", "ggr", *[c for c in ("slips",) if c in groups.columns], "share", "margin")


def phase_stats(slips: DataFrame) -> DataFrame:
    """Stake, GGR, slips, share and margin per phase, with its fixed place."""
    by = slips.groupBy("phase").agg(
        total("stake_eur").alias("stake"), total("ggr_eur").alias("ggr"), count_rows(slips).alias("slips")
    )
    all_stake = by.agg(F.sum("stake")).scalar()
    place = F.array_position(F.array(*[F.lit(p) for p in config.PHASES]), F.col("phase"))
    return _scaled(by, "phase", all_stake).withColumn("ordinal", place.cast("long"))


def market_group_stats(legs: DataFrame) -> DataFrame:
    by = legs.groupBy("market_group").agg(
        total("stake_attr").alias("stake"), total("ggr_attr").alias("ggr")
    )
    return _scaled(by, "market_group", by.agg(F.sum("stake")).scalar())


def _slip_field_stats(slips: DataFrame, field: str) -> DataFrame:
    by = slips.groupBy(field).agg(total("stake_eur").alias("stake"), total("ggr_eur").alias("ggr"))
    return _scaled(by, field, by.agg(F.sum("stake")).scalar())


def channel_stats(slips: DataFrame) -> DataFrame:
    return _slip_field_stats(slips, "channel")


def bet_type_stats(slips: DataFrame) -> DataFrame:
    return _slip_field_stats(slips, "bet_type")


def channel_combined_mix(slips: DataFrame) -> DataFrame:
    """One row: COMBINED share of retail and of online stake."""

    def share(channel: str) -> Column:
        here = F.col("channel") == channel
        combined = total_where("stake_eur", here & (F.col("bet_type") == "COMBINED"))
        return percent(combined, F.greatest(total_where("stake_eur", here), F.lit(1)))

    return slips.agg(share("retail").alias("retail_share"), share("online").alias("online_share"))


def daily_flow(slips: DataFrame) -> DataFrame:
    """Stake and GGR of every day from first to last, days without bets as 0,
    with the peak-stake day and the worst-GGR day marked (the first, if tied)."""
    days = (
        slips.where(F.col("betslip_ts").isNotNull())
        .groupBy(timing.betslip_day(slips).alias("day"))
        .agg(total("stake_eur").alias("stake"), total("ggr_eur").alias("ggr"))
    )
    span = days.agg(F.min("day").alias("low"), F.max("day").alias("high"))
    spine = span.select(F.explode(F.expr("sequence(low, high, interval 1 day)")).alias("day"))
    zero = F.lit(0).cast("decimal(28,6)")
    filled = spine.join(days, "day", "left").select(
        "day", F.coalesce("stake", zero).alias("stake"), F.coalesce("ggr", zero).alias("ggr")
    )
    peak = filled.agg(F.min_by("day", F.struct(-F.col("stake"), "day"))).scalar()
    worst = filled.agg(F.min_by("day", F.struct("ggr", "day"))).scalar()
    return filled.withColumns({"is_peak": F.col("day") == peak, "is_worst": F.col("day") == worst})


def worst_day_fixtures(slips: DataFrame, legs: DataFrame, top: int = 3) -> DataFrame:
    """The fixtures that lost most on the worst day."""
    worst = daily_flow(slips).where("is_worst").select("day").scalar()
    return (
        legs.where((timing.betslip_day(legs) == worst) & F.col("match").isNotNull())
        .groupBy("match")
        .agg(total("ggr_attr").alias("ggr"))
        .orderBy("ggr", "match")
        .limit(top)
    )


def star_share(legs: DataFrame) -> DataFrame:
    """One row: attributed stake share and GGR of star-substitute legs."""
    star = F.col("star_substitute")
    stake = total_where("stake_attr", star)
    return legs.agg(
        stake.alias("star_stake"),
        percent(stake, total("stake_attr")).alias("star_share"),
        total_where("ggr_attr", star).alias("star_ggr"),
    )


def core_product_share(legs: DataFrame) -> DataFrame:
    core = total_where("stake_attr", F.col("market_group").isin(config.CORE_GROUPS))
    return legs.agg(percent(core, total("stake_attr")).alias("core_share"))


def market_prefix_pocket(legs: DataFrame, prefix: str = config.TWO_PLUS_GOALS) -> DataFrame:
    return legs.where(F.col("market_clean").startswith(prefix)).agg(
        total("stake_attr").alias("stake"), total("ggr_attr").alias("ggr")
    )


def customer_stakes(slips: DataFrame) -> DataFrame:
    return (
        slips.where(F.col("uid").isNotNull()).groupBy("uid").agg(total("stake_eur").alias("stake"))
    )


def top10_customer_share(slips: DataFrame) -> DataFrame:
    stakes = customer_stakes(slips)
    everyone = stakes.agg(F.sum("stake")).scalar()
    top = stakes.orderBy(F.desc("stake"), "uid").limit(10).agg(F.sum("stake").alias("top10_stake"))
    return top.select("top10_stake", percent(F.col("top10_stake"), everyone).alias("top10_share"))


def customer_gini(slips: DataFrame) -> DataFrame:
    """Gini over the stakes of all customers."""
    return gini(ordered_counts(customer_stakes(slips), "stake"), "stake")


def costliest_exposure(found: DataFrame) -> DataFrame:
    """The exposure flag with the lowest GGR."""
    flags = found.where(F.col("type") == "exposure")
    return flags.orderBy("ggr", "sel_key").limit(1)


def late_bets(slips: DataFrame) -> DataFrame:
    return slips.where(F.col("lead_minutes") < config.LATE_LEAD_MIN).agg(
        count_rows(slips).alias("slips"), total("stake_eur").alias("stake")
    )


def fixture_merge_counts(legs: DataFrame) -> DataFrame:
    """One row: match ids against fixtures (name and shifted kickoff day)."""
    complete = legs.where(
        F.col("match_id").isNotNull() & F.col("match").isNotNull() & F.col("event_ts").isNotNull()
    )
    fixture = F.struct("match", timing.fixture_day(F.col("event_ts")).alias("day"))
    return complete.agg(
        F.count_distinct("match_id").alias("match_ids"), F.count_distinct(fixture).alias("fixtures")
    )


def net_rate() -> Column:
    return rounded(ratio(F.col("net_revenue_eur"), F.col("ggr_eur")), 4)


def billing_tiers(slips: DataFrame, top: int = 2) -> DataFrame:
    """The most common net-revenue rates."""
    rated = slips if "rate" in slips.columns else slips.where(F.col("ggr_eur") != 0).withColumn("rate", net_rate())
    return (
        rated.groupBy("rate")
        .agg(count_rows(rated).alias("slips"))
        .where(F.col("rate").isNotNull())
        .orderBy(F.desc("slips"), "rate")
        .limit(top)
    )


def slip_kind() -> Column:
    """What a slip holds: one leg, one game, or several games."""
    return (
        F.when(F.col("n_matches") >= 2, "cross-game")
        .when(F.col("n_legs") == 1, "single-leg")
        .when(F.col("n_matches") == 1, "same-game")
    )


def combined_composition(slips: DataFrame) -> DataFrame:
    """COMBINED slips by what they hold: one leg, one game, or several games."""
    kind = F.col("kind") if "kind" in slips.columns else slip_kind()
    everything = slips.agg(total("stake_eur")).scalar()
    return (
        slips.where(F.col("bet_type") == "COMBINED")
        .groupBy(kind.alias("kind"))
        .agg(count_rows(slips).alias("slips"), total("stake_eur").alias("stake"), total("ggr_eur").alias("ggr"))
        .where(F.col("kind").isNotNull())
        .select(
            "kind",
            "slips",
            percent(F.col("stake"), everything).alias("stake_share"),
            percent(F.col("ggr"), F.col("stake")).alias("margin"),
        )
    )


def repeated_selection_share(legs: DataFrame) -> DataFrame:
    """One row: of the same-game COMBINED slips, how many repeat one selection."""
    same_game = legs.where(
        (F.col("bet_type") == "COMBINED") & (F.col("n_legs") >= 2) & (F.col("n_matches") == 1)
    )
    selection = F.struct("match_id", "market_raw", "option_raw", "price")
    per_slip = same_game.groupBy("slip_id").agg((F.count_distinct(selection) == 1).alias("one_selection"))
    return repeated_slips(per_slip)


def repeated_slips(per_slip: DataFrame) -> DataFrame:
    """One row, from a row per same-game slip that says whether it repeats ``one_selection``."""
    repeated = F.count_if("one_selection")
    return per_slip.agg(
        F.count("*").alias("same_game_slips"),
        repeated.alias("repeated_slips"),
        percent(repeated, F.count("*")).alias("repeated_share"),
    )
