"""Customer behaviour: stats, percentile components, score, watchlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from slipstream import config
from slipstream.functions import accounts
from slipstream.functions.numbers import (
    FRACTION, euro, ratio, ratio_or_zero, rounded, total, total_where, trimmed_number,
)
from slipstream.operators.rank import percentile_ranks
from slipstream.session import cut_lineage

COMPONENTS = {
    "clv": "clv",
    "win": "customer_margin",
    "lineup": "lineup_share",
    "stake": "avg_stake",
    "focus": "hhi",
}
PLACES = 9


def customer_stats(slips: DataFrame) -> DataFrame:
    """One row per customer: volume, margin, win rate and phase shares."""
    _, _, lineups, in_play = config.PHASES
    sums = (
        slips.where(F.col("uid").isNotNull())
        .groupBy("uid")
        .agg(
            F.count("*").alias("slips"),
            total("stake_eur").alias("stake"),
            total("ggr_eur").alias("ggr"),
            F.count_distinct("unit").alias("n_units"),
            F.count_if(F.col("ggr_eur") < 0).alias("won"),
            total_where("stake_eur", F.col("phase") == lineups).alias("lineup_stake"),
            total_where("stake_eur", F.col("phase") == in_play).alias("inplay_stake"),
        )
    )
    stake, slip_count = F.col("stake"), F.col("slips")
    return sums.select(
        "uid",
        "slips",
        "stake",
        "ggr",
        ratio(stake, slip_count).alias("avg_stake"),
        accounts.channel(F.col("uid")).alias("channel"),
        "n_units",
        F.when(stake > 0, -ratio(F.col("ggr"), stake)).otherwise(0.0).alias("customer_margin"),
        ratio(F.col("won"), slip_count).alias("win_rate"),
        ratio(F.col("lineup_stake"), stake).alias("lineup_share"),
        ratio(F.col("inplay_stake"), stake).alias("inplay_share"),
    )


def win_rate(slips: DataFrame) -> DataFrame:
    return customer_stats(slips).select("uid", "win_rate")


def phase_shares(slips: DataFrame) -> DataFrame:
    return customer_stats(slips).select("uid", "lineup_share", "inplay_share")


def customer_clv(clv_legs: DataFrame) -> DataFrame:
    """Stake-weighted mean proxy CLV, and the legs behind it."""
    weight = F.greatest(F.col("stake_attr").cast("double"), F.lit(config.CLV_MIN_WEIGHT))
    exact = lambda c: F.sum(c.cast("decimal(28,12)"))
    sums = (
        clv_legs.where(F.col("uid").isNotNull())
        .groupBy("uid")
        .agg(
            exact(F.col("proxy_clv") * weight).alias("weighted"),
            exact(weight).alias("weight"),
            F.count("*").alias("clv_legs"),
        )
    )
    return sums.select("uid", ratio(F.col("weighted"), F.col("weight")).alias("clv"), "clv_legs")


def eligible_customers(stats: DataFrame) -> DataFrame:
    return stats.where(
        (F.col("slips") >= config.UID_MIN_SLIPS) & (F.col("stake") >= config.UID_MIN_STAKE_EUR)
    )


def _group_shares(legs: DataFrame) -> DataFrame:
    """(customer, market group) stake shares: a handful of rows per customer."""
    by = (
        legs.where(F.col("uid").isNotNull())
        .groupBy("uid", "market_group")
        .agg(total("stake_attr").alias("group_stake"))
    )
    of_uid = Window.partitionBy("uid")
    return by.withColumn("share", ratio(F.col("group_stake"), F.sum("group_stake").over(of_uid)))


def market_focus(legs: DataFrame) -> DataFrame:
    """Per customer: HHI over market groups, and the largest group."""
    shares = _group_shares(legs)
    return shares.groupBy("uid").agg(
        F.coalesce(F.sum((F.col("share") * F.col("share")).cast(FRACTION)), F.lit(0)).cast("double").alias("hhi"),
        # Largest share first; among equals the group that sorts first.
        F.min_by("market_group", F.struct(-F.col("share"), "market_group")).alias("top_group"),
        F.max("share").alias("top_group_share"),
    )


def top_market_group(legs: DataFrame) -> DataFrame:
    return market_focus(legs).select("uid", "top_group", "top_group_share")


def scored_customers(slips: DataFrame, legs: DataFrame, clv_legs: DataFrame) -> DataFrame:
    """Eligible customers with five percentile components and a 0-100 score.

    Ranking reads the frame more than once, so its lineage is cut here.
    """
    frame = (
        eligible_customers(customer_stats(slips))
        .join(customer_clv(clv_legs), "uid", "left")
        .join(market_focus(legs), "uid", "left")
        .withColumns(
            {
                "clv_legs": F.coalesce("clv_legs", F.lit(0)).cast("long"),
                "hhi": F.coalesce("hhi", F.lit(0.0)),
            }
        )
    )
    # Noise in the last bits must neither make nor break a tie.
    noisy = {c: F.round(F.col(c), PLACES) for c in COMPONENTS.values()}
    frame = cut_lineage(frame.withColumns(noisy))
    ranks = percentile_ranks(frame, "uid", list(COMPONENTS.values()))
    scored = frame.join(ranks, "uid", "left").withColumns(
        {
            f"c_{name}": F.coalesce(F.col(f"{column}_pctl"), F.lit(0.5))
            for name, column in COMPONENTS.items()
        }
    )
    # Ranked among all first; only then is thin CLV evidence set to neutral.
    thin = F.col("clv_legs") < config.UID_MIN_CLV_LEGS
    scored = scored.withColumn("c_clv", F.when(thin, 0.5).otherwise(F.col("c_clv")))
    score = sum(
        (F.lit(config.WEIGHTS[n]) * F.col(f"c_{n}") for n in COMPONENTS), start=F.lit(0.0)
    )
    return scored.withColumn("score", rounded(score * 100, 1))


def watchlist(scored: DataFrame) -> DataFrame:
    """The top scores, rounded for display. Ties go by customer id."""
    top = scored.orderBy(F.desc("score"), "uid").limit(config.WATCHLIST_SIZE)
    pct = lambda c, places: rounded(F.col(c) * 100, places)
    return top.select(
        "uid",
        "score",
        "slips",
        rounded(F.col("stake"), 2).alias("stake"),
        rounded(F.col("ggr"), 2).alias("ggr"),
        pct("customer_margin", 1).alias("customer_margin_pct"),
        pct("win_rate", 1).alias("win_rate_pct"),
        rounded(F.col("avg_stake"), 2).alias("avg_stake"),
        F.when(F.col("clv_legs") >= config.UID_MIN_CLV_LEGS, pct("clv", 2)).alias("clv_pct"),
        "clv_legs",
        pct("lineup_share", 1).alias("lineup_share_pct"),
        pct("inplay_share", 1).alias("inplay_share_pct"),
        F.coalesce("top_group", F.lit("·")).alias("top_group"),
        F.coalesce(pct("top_group_share", 1), F.lit(0.0)).alias("top_group_share_pct"),
        "channel",
        F.struct(*[rounded(F.col(f"c_{n}"), 3).alias(n) for n in COMPONENTS]).alias("components"),
    )


def watch_reasons(listed: DataFrame) -> DataFrame:
    """Why a customer is listed, in words."""

    def strong(name: str) -> Column:
        return F.col("components")[name] >= config.REASON_FLOOR

    pct = lambda c, places=1: F.concat(trimmed_number(F.col(c), places), F.lit("%"))
    parts = F.array(
        F.when(
            strong("clv") & F.col("clv_pct").isNotNull(),
            F.concat(F.lit("consistently beat this flow's own late prices (proxy CLV "), pct("clv_pct"), F.lit(")")),
        ),
        F.when(
            strong("win"),
            F.concat(
                F.lit("took "), _money_back(F.col("ggr")), F.lit(" off the book ("),
                pct("customer_margin_pct"), F.lit(" of staked)"),
            ),
        ),
        F.when(
            strong("lineup"),
            F.concat(F.lit("concentrates "), pct("lineup_share_pct"), F.lit(" of stake in the post-lineups window")),
        ),
        F.when(
            strong("stake"),
            F.concat(F.lit("stakes big for this book (avg "), euro(F.col("avg_stake"), 2), F.lit(")")),
        ),
        F.when(
            strong("focus"),
            F.concat(
                F.lit("specialist: "), pct("top_group_share_pct", 0), F.lit(" of stake in "), F.col("top_group")
            ),
        ),
    )
    given = F.filter(parts, lambda p: p.isNotNull())
    fallback = F.array(F.lit("high combined percentile across all five components"))
    text = F.array_join(F.when(F.size(given) > 0, given).otherwise(fallback), "; ")
    return listed.select("uid", F.concat(text, F.lit(".")).alias("reason"))


def _money_back(ggr: Column) -> Column:
    """The book's loss as a plain euro amount; the minus follows the mark."""
    return F.concat(F.lit("€"), F.format_number(F.round((-ggr).cast("decimal(28,9)"), 0), 0))


def watchlist_digest(listed: DataFrame) -> DataFrame:
    """One row: GGR of the first ten, and how many of the first twenty beat the
    late price by more than two percent. The list is bounded, so is the order."""
    order = Window.orderBy(F.desc("score"), "uid")
    placed = listed.withColumn("place", F.row_number().over(order))
    return placed.agg(
        F.coalesce(F.sum(F.when(F.col("place") <= 10, F.col("ggr").cast("decimal(18,2)"))), F.lit(0)).alias("top10_ggr"),
        F.count_if((F.col("place") <= 20) & (F.coalesce("clv_pct", F.lit(0.0)) > 2)).alias("positive_clv"),
    )


def risk_assumptions(scored: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: the thresholds, and how many customers and selections pass."""
    selections = stats.agg(F.count_if("eligible")).scalar()
    return scored.agg(
        F.lit(config.SEL_MIN_LEGS).cast("long").alias("sel_min_legs"),
        F.lit(config.UID_MIN_SLIPS).cast("long").alias("uid_min_slips"),
        F.lit(config.UID_MIN_STAKE_EUR).cast("long").alias("uid_min_stake_eur"),
        F.lit(config.UID_MIN_CLV_LEGS).cast("long").alias("uid_min_clv_legs"),
        *[F.lit(w).alias(f"weight_{n}") for n, w in config.WEIGHTS.items()],
        F.count("*").alias("eligible_customers"),
    ).withColumn("eligible_selections", selections)
