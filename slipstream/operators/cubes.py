"""All additive documents of a batch from one aggregate of each table.

Slips and legs are each scanned once, into grouping sets: a row carries its counts and sums, and
``part`` names the set. Functions of ``facts`` and ``findings`` take such rows in place of slips or legs,
because sums of sums are the same sums. Money is grouped by day at least, so a cell fits its type. Sets with many groups (customers, slips, fingerprints) are
folded within the tasks first, like any aggregate, and are read by those documents alone that need them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from slipstream import config
from slipstream.functions import timing
from slipstream.functions.numbers import ROWS, total
from slipstream.operators.findings import net_rate, slip_kind
from slipstream.operators.reconcile import fingerprints
from slipstream.schema import BY_DAY
from slipstream.session import scratch_table
from slipstream.sources.tables import write_table

SLIP_SETS = {
    "flow": ["phase", "channel", "bet_type", "kind", "late", BY_DAY],
    "customers": ["uid"],
    "rates": ["rate"],
}
LEG_SETS = {
    "markets": ["market_group", "star_substitute", "market_clean", BY_DAY],
    "days": [BY_DAY, "match"],
    "fixtures": ["match_id", "match_name", "fixture_day"],
    "copies": ["print_1", "print_2"],
    "same_game": ["slip_id"],
}


@dataclass(frozen=True)
class Cube:
    """The written grouping sets of one table."""

    rows: DataFrame
    sets: dict[str, list[str]]

    def part(self, name: str) -> DataFrame:
        others = {c for s in self.sets.values() for c in s} - set(self.sets[name])
        return self.rows.where(F.col("part") == name).drop("part", *others)


def _grouped(rows: DataFrame, sets: dict[str, list[str]], sums: dict[str, Column]) -> DataFrame:
    columns = list(dict.fromkeys(c for s in sets.values() for c in s))
    # a set is told by a column that no other set has
    only = {name: next(c for c in s if sum(c in o for o in sets.values()) == 1) for name, s in sets.items()}
    part = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(name)) for name, c in only.items()])
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets.values()], *[F.col(c) for c in columns])
    return grouped.agg(part.alias("part"), F.count("*").alias(ROWS), *[c.alias(name) for name, c in sums.items()])


def _written(cube: DataFrame, sets: dict[str, list[str]]) -> Cube:
    path = scratch_table(cube.sparkSession, "cube")
    write_table(cube, path, ["part"])
    return Cube(cube.sparkSession.read.schema(cube.schema).parquet(path), sets)


def slip_cube(slips: DataFrame) -> Cube:
    """Slips by everything that documents group them by, by customer, and by net-revenue rate."""
    late = F.coalesce(F.col("lead_minutes") < config.LATE_LEAD_MIN, F.lit(False))
    rows = slips.select(
        "phase", "channel", "bet_type", slip_kind().alias("kind"), late.alias("late"),
        timing.betslip_day(slips).alias(BY_DAY), "uid", F.when(F.col("ggr_eur") != 0, net_rate()).alias("rate"),
        "stake_eur", "ggr_eur", "net_revenue_eur", "betslip_ts", "lead_minutes",
    )
    sums = {
        "stake_eur": total("stake_eur"), "ggr_eur": total("ggr_eur"), "stakes_known": F.count("stake_eur"),
        "stake_shown": F.sum(F.round("stake_eur", 2)), "ggr_shown": F.sum(F.round("ggr_eur", 2)),
        "net_shown": F.sum(F.round("net_revenue_eur", 4)), "betslip_ts": F.min("betslip_ts"),
        "last_ts": F.max("betslip_ts"), "lead_minutes": F.min("lead_minutes"),
    }
    return _written(_grouped(rows, SLIP_SETS, sums), SLIP_SETS)


def leg_cube(legs: DataFrame) -> Cube:
    """Legs by market, by day and match, by fixture, by fingerprint, and per same-game slip.

    ``copies`` keeps fingerprints that several legs share. A same-game slip repeats one selection where
    the least and the greatest of its selections' two hashes are equal.
    """
    prefix = F.when(F.col("market_clean").startswith(config.TWO_PLUS_GOALS), F.lit(config.TWO_PLUS_GOALS))
    complete = F.col("match_id").isNotNull() & F.col("match").isNotNull() & F.col("event_ts").isNotNull()
    same_game = (F.col("bet_type") == "COMBINED") & (F.col("n_legs") >= 2) & (F.col("n_matches") == 1)
    selection = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("match_id", "market_raw", "option_raw", "price")]
    rows = legs.select(
        "market_group", "star_substitute", prefix.alias("market_clean"),
        timing.betslip_day(legs).alias(BY_DAY), "match",
        F.when(complete, F.col("match_id")).alias("match_id"), F.when(complete, F.col("match")).alias("match_name"),
        F.when(complete, timing.fixture_day(F.col("event_ts"))).alias("fixture_day"),
        *[c.alias(f"print_{i}") for i, c in enumerate(fingerprints(), 1)],
        F.when(same_game, F.col("slip_id")).alias("slip_id"),
        F.xxhash64(*selection).alias("sel_1"), F.xxhash64(F.lit(1), *selection).alias("sel_2"),
        "stake_attr", "ggr_attr", "stake_eur", "ggr_eur", "currency_inferred", "event_ts",
    )
    sums = {
        **{c: total(c) for c in ("stake_attr", "ggr_attr", "stake_eur", "ggr_eur")},
        "currency_inferred": F.count_if("currency_inferred"), "event_ts": F.min("event_ts"),
        "one_selection": (F.min("sel_1") == F.max("sel_1")) & (F.min("sel_2") == F.max("sel_2")),
    }
    cube = _grouped(rows, LEG_SETS, sums)
    needed = (F.col("part") != "copies") | (F.col(ROWS) > 1)
    return _written(cube.where(needed), LEG_SETS)
