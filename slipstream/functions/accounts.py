"""Currency, channel and country of a leg."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from slipstream import config


def is_peru_unit(unit: Column) -> Column:
    return F.coalesce(unit.rlike("(?iu)per[uú]"), F.lit(False))


def currency(code: Column, peru: Column) -> Column:
    return F.coalesce(code, F.when(peru, "PEN").otherwise("EUR"))


def eur_rate(code: Column) -> Column:
    """Rate to EUR. A currency with no rate stops the job; it is never null."""
    rates = F.create_map(*[F.lit(x) for pair in config.FX_TO_EUR.items() for x in pair])
    missing = F.raise_error(F.concat(F.lit("no FX rate for currency: "), code))
    return F.coalesce(F.try_element_at(rates, code), missing.cast("double"))


def channel(uid: Column) -> Column:
    return (
        F.when(uid.startswith("TPV"), "tpv").when(uid.startswith("MAH-"), "retail").otherwise("online")
    )


def unit_country(unit: Column, peru: Column) -> Column:
    return (
        F.when(unit.contains("PORTUGAL"), "Portugal").when(peru, "Peru").otherwise("Spain")
    )
