"""Readable markets, entities, EUR money, channel and country on every leg."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slipstream.functions import accounts, markets
from slipstream.functions.numbers import money


def normalize(legs: DataFrame) -> DataFrame:
    """Add the derived columns. Narrow projections: no shuffle, no Python.

    Costly intermediate values are columns of their own step. Catalyst keeps such
    steps apart, so each is worked out once per row rather than once per use.
    """
    c = F.col
    label = markets.market_base(c("market_raw"))
    steps = legs.withColumns(
        {
            "__base": label,
            "__sides": markets.sides(c("match")),
            "__peru": accounts.is_peru_unit(c("unit")),
        }
    )
    steps = steps.withColumn("__low", F.lower("__base"))
    steps = steps.withColumns(
        {
            "market_clean": markets.market_clean(c("market_raw"), c("__base"), c("__low")),
            "market_group": markets.market_group(c("market_raw"), c("__low")),
            "star_substitute": markets.star_flag(c("market_raw")),
            "team_home": markets.side(c("__sides"), 0),
            "team_away": markets.side(c("__sides"), 1),
            "line": markets.extract_line(c("option_raw")),
            "selection": c("option_raw"),
            "currency": accounts.currency(c("currency_raw"), c("__peru")),
            "currency_inferred": c("currency_raw").isNull(),
            "channel": accounts.channel(c("uid")),
            "unit_country": accounts.unit_country(c("unit"), c("__peru")),
        }
    )
    steps = steps.withColumns(
        {"__clean_low": F.lower("market_clean"), "__rate": accounts.eur_rate(c("currency"))}
    )
    return steps.withColumns(
        {
            "entity_team": markets.entity_team(
                c("market_raw"), c("market_group"), c("option_raw"), c("team_home"), c("team_away")
            ),
            "entity_player": markets.entity_player(
                c("market_group"), c("__clean_low"), c("option_raw")
            ),
            "stake_eur": money(c("stake") * c("__rate")),
            "ggr_eur": money(c("ggr") * c("__rate")),
            "net_revenue_eur": money(c("net_revenue") * c("__rate")),
        }
    ).drop("__base", "__sides", "__peru", "__low", "__clean_low", "__rate")
