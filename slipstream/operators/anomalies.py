"""Five transparent rules, one output shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from slipstream import config
from slipstream.functions.numbers import fixed, grouped_int, ratio_or_zero, rounded, total
from slipstream.functions.timing import betslip_day
from slipstream.operators.prices import eligible_selections
from slipstream.operators.skew import lookup


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _record(df: DataFrame, kind: str, key: Column, title: Column, detail: Column, metric: Column) -> DataFrame:
    return df.select(
        F.lit(kind).alias("type"),
        key.cast("string").alias("sel_key"),
        title.alias("title"),
        detail.alias("detail"),
        rounded(F.col("stake"), 2).alias("stake"),
        rounded(F.col("ggr"), 2).alias("ggr"),
        F.col("n_uids").cast("long").alias("n_uids"),
        metric.alias("metric"),
    )


def _selection_title() -> Column:
    none = F.lit("None")
    return _text(
        F.coalesce("option_raw", none), " (", F.col("market_clean"), ") · ", F.coalesce("match", none)
    )


def _whole_percent(c: Column) -> Column:
    return fixed(c * 100, 0)


def price_drift(stats: DataFrame) -> DataFrame:
    """Selections whose price moved by a quarter or more before kickoff."""
    change = F.col("last_price") / F.col("first_price") - 1
    moved = (
        eligible_selections(stats)
        .withColumn("change", F.round(change, 9))
        .where((F.abs("change") >= config.DRIFT_MIN_CHANGE) & (F.col("stake") >= config.DRIFT_MIN_STAKE))
        .orderBy(F.desc(F.abs("change")), "sel_key")
        .limit(config.DRIFT_TOP)
    )
    direction = F.when(F.col("change") < 0, "steamed in").otherwise("drifted out")
    sign = F.when(F.col("change") >= 0, "+").otherwise("")
    detail = _text(
        "struck price ", direction, ": ", fixed(F.col("first_price"), 2), " -> ",
        fixed(F.col("last_price"), 2), " (", sign, _whole_percent(F.col("change")), "%) across ",
        F.col("n_legs").cast("string"), " bets pre-kickoff",
    )
    return _record(
        moved, "price_drift", F.col("sel_key"), _selection_title(), detail, rounded(F.col("change") * 100, 1)
    )


def repeated_support(stats: DataFrame) -> DataFrame:
    """Selections many customers backed, with a large part of the fixture's stake."""
    eligible = eligible_selections(stats)
    of_match = eligible.groupBy("match").agg(
        F.sum("stake").alias("match_stake"), F.count("*").alias("selections")
    )
    # The cheap tests first: few selections are left to look up.
    backed = eligible.where(
        (F.col("n_uids") >= config.SUPPORT_MIN_UIDS)
        & (F.col("stake") >= config.SUPPORT_MIN_STAKE)
        & F.col("match").isNotNull()
    )
    shared = (
        lookup(backed, of_match, ["match"], "selections", F.col("sel_key"), null_safe=False)
        .withColumn("fixture_share", ratio_or_zero(F.col("stake"), F.col("match_stake")))
        .where(F.col("fixture_share") >= config.SUPPORT_MIN_SHARE)
        .orderBy(F.desc("stake"), "sel_key")
        .limit(config.SUPPORT_TOP)
    )
    detail = _text(
        F.col("n_uids").cast("string"), " distinct customers backed the same selection, ",
        _whole_percent(F.col("fixture_share")), "% of the fixture's analyzable pre-KO stake",
    )
    return _record(
        shared, "repeated_support", F.col("sel_key"), _selection_title(), detail,
        rounded(F.col("fixture_share") * 100, 1),
    )


def exposure(stats: DataFrame) -> DataFrame:
    """The largest potential payouts."""
    top = (
        eligible_selections(stats).orderBy(F.desc("exposure"), "sel_key").limit(config.EXPOSURE_TOP)
    )
    detail = _text(
        "potential payout ", grouped_int(F.col("exposure")), " EUR on ", grouped_int(F.col("stake")),
        " EUR staked pre-KO (", F.col("n_legs").cast("string"), " bets, prices up to ",
        fixed(F.col("max_price"), 2), ")",
    )
    return _record(
        top, "exposure", F.col("sel_key"), _selection_title(), detail, rounded(F.col("exposure"), 0)
    )


def negative_pocket(legs: DataFrame) -> DataFrame:
    """Market and competition cells that lose money at size."""
    cells = (
        legs.where(F.col("market_clean").isNotNull() & F.col("competition").isNotNull())
        .groupBy("market_clean", "competition")
        .agg(
            total("stake_attr").alias("stake"),
            total("ggr_attr").alias("ggr"),
            F.count_distinct("uid").alias("n_uids"),
        )
    )
    pockets = (
        cells.withColumn("margin", ratio_or_zero(F.col("ggr"), F.col("stake")))
        .where((F.col("stake") >= config.POCKET_MIN_STAKE) & (F.col("margin") <= config.POCKET_MAX_MARGIN))
        .orderBy("ggr", "market_clean", "competition")
        .limit(config.POCKET_TOP)
    )
    detail = _text(
        "structural leak: ", _whole_percent(F.col("margin")), "% margin on ", grouped_int(F.col("stake")),
        " EUR stake across ", F.col("n_uids").cast("string"), " customers",
    )
    title = _text(F.col("market_clean"), " · ", F.col("competition"))
    return _record(
        pockets, "negative_pocket", F.lit(None), title, detail, rounded(F.col("margin") * 100, 1)
    )


def _median_of_seven(values: Column) -> Column:
    middle = config.SPIKE_HISTORY_DAYS // 2
    return F.get(F.sort_array(values), F.lit(middle))


def daily_z(slips: DataFrame) -> DataFrame:
    """Per day with bets: stake, GGR, customers, and a robust z-score against the
    seven days with bets before it. One row per day, so the order is bounded."""
    days = (
        slips.where(F.col("betslip_ts").isNotNull())
        .groupBy(F.to_date("betslip_ts").alias("day"))
        .agg(
            total("stake_eur").cast("double").alias("stake"),
            total("ggr_eur").alias("ggr"),
            F.count_distinct("uid").alias("n_uids"),
        )
    )
    history = Window.orderBy("day").rowsBetween(-config.SPIKE_HISTORY_DAYS, -1)
    prior = days.withColumn("prior", F.collect_list("stake").over(history))
    full = F.size("prior") == config.SPIKE_HISTORY_DAYS
    based = prior.withColumn("base", F.when(full, _median_of_seven(F.col("prior"))))
    spread = F.transform("prior", lambda x: F.abs(x - F.col("base")))
    mad = F.when(full, _median_of_seven(spread))
    z = F.try_divide(F.col("stake") - F.col("base"), config.MAD_TO_SIGMA * mad)
    return based.withColumn("z", z).drop("prior")


def spike_days(slips: DataFrame) -> DataFrame:
    return (
        daily_z(slips)
        .where((F.col("z") >= config.SPIKE_MIN_Z) & (F.col("stake") >= config.SPIKE_MIN_STAKE))
        .orderBy(F.desc("z"), "day")
        .limit(config.SPIKE_TOP)
    )


def spike_driver(spikes: DataFrame, legs: DataFrame) -> DataFrame:
    """The fixture with most attributed stake on each flagged day."""
    # At most SPIKE_TOP days are broadcast.
    days = spikes.select("day")
    staked = (
        legs.where(F.col("match").isNotNull())
        .withColumn("day", betslip_day(legs))
        .join(F.broadcast(days), "day", "left_semi")
        .groupBy("day", "match")
        .agg(total("stake_attr").alias("driver_stake"))
    )
    best = Window.partitionBy("day").orderBy(F.desc("driver_stake"), "match")
    return (
        staked.withColumn("place", F.row_number().over(best))
        .where("place = 1")
        .select("day", F.col("match").alias("driver"), "driver_stake")
    )


def turnover_spike(slips: DataFrame, legs: DataFrame) -> DataFrame:
    """Days whose turnover jumps above their own trailing baseline."""
    spikes = spike_days(slips)
    # Both sides hold at most SPIKE_TOP rows.
    named = spikes.join(F.broadcast(spike_driver(spikes, legs)), "day", "left")
    multiple = ratio_or_zero(F.col("stake"), F.col("base"))
    detail = _text(
        grouped_int(F.col("stake")), " EUR staked, ", fixed(multiple, 1), "x the trailing 7-day baseline (",
        grouped_int(F.col("base")), " EUR); led by ", F.coalesce("driver", F.lit("n/a")), " (",
        grouped_int(F.coalesce("driver_stake", F.lit(0))), " EUR)",
    )
    title = _text(F.date_format("day", "yyyy-MM-dd"), ": turnover spike")
    return _record(named, "turnover_spike", F.lit(None), title, detail, rounded(multiple, 1))


def anomalies(slips: DataFrame, legs: DataFrame, stats: DataFrame) -> DataFrame:
    """All five rules."""
    found = [
        price_drift(stats),
        repeated_support(stats),
        exposure(stats),
        negative_pocket(legs),
        turnover_spike(slips, legs),
    ]
    return reduce(DataFrame.unionByName, found)


def anomaly_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("type").agg(F.count("*").alias("flags"))
