"""The tables every analysis reads, each written once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from slipstream.operators.fixtures import matches_with_day, with_fixture
from slipstream.operators.normalize import normalize
from slipstream.operators.reconcile import pair_pulls, reconciled_union, row_identity
from slipstream.operators.rollup import (
    SLIP_ON_LEG, build_slips, combined_slips, data_window, look_up_slips, share_out, simple_slips,
)
from slipstream.schema import BY_DAY
from slipstream.sources import binding, tables
from slipstream.session import scratch_table


@dataclass(frozen=True)
class Tables:
    """Where one run's tables lie, and how to read them.

    ``legs_from`` names the written table of raw legs. Of all other tables one is written when it is first
    read; it reads those it is made from, and no more. Tables dealt to days serve filters on days, customers
    and fixtures; what reads all rows reads ``slip_rows``, ``window_legs``, ``leg_rows``, ``plain_legs`` or
    ``money_legs``, for which no whole rows are shuffled.
    """

    spark: SparkSession
    path: str
    legs_from: str = "raw"
    written: set[str] = field(default_factory=set)

    def read(self, name: str) -> DataFrame:
        if name == "slips":
            return data_window(self.all_slips)
        if name in MAKERS and name not in self.written:
            MAKERS[name](self, f"{self.path}/{name}")
            self.written.add(name)
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def raw(self) -> DataFrame:
        """All legs as they came, with ``row_id``."""
        legs = self.read(self.legs_from)
        return legs if "row_id" in legs.columns else row_identity(legs.drop("ok"))

    @property
    def all_slips(self) -> DataFrame:
        """All slips, before the data window, which is a choice of day folders."""
        return self.read("all_slips")

    @property
    def normalized(self) -> DataFrame:
        """All legs, normalised, before the data window: a projection of the raw ones, so it is not written."""
        return normalize(self.raw)

    @property
    def slips(self) -> DataFrame:
        return self.read("slips")

    @property
    def legs(self) -> DataFrame:
        return self.read("legs")

    @property
    def slip_rows(self) -> DataFrame:
        """The rows of ``slips``, derived where they are read: SIMPLE legs are projected, COMBINED slips are a
        written table, so nothing is shuffled or written for it."""
        return data_window(build_slips(self.normalized, self.read("combined_slips")))

    @property
    def window_legs(self) -> DataFrame:
        """The rows of ``legs`` without their slip and fixture: a projection."""
        return normalize(data_window(self.raw))

    def leg_rows(self, fixtures: bool = False) -> DataFrame:
        """The rows of ``legs``, derived where they are read. Only with ``fixtures`` have they theirs; it is
        looked up first, so that a filter on it spares the other legs the look-up of their slip."""
        legs = data_window(self.raw)
        return share_out(normalize(self._with_slips(with_fixture(legs, self.matches) if fixtures else legs)))

    @property
    def legs_to_deal(self) -> DataFrame:
        """The legs as they came, with what only others know: their slip and their fixture. All that follows
        from these is left to ``derive_legs``, after they are dealt to days."""
        return with_fixture(self._with_slips(data_window(self.raw)), self.matches)

    def derive_legs(self, dealt: DataFrame) -> DataFrame:
        """The rows of ``legs`` from dealt ``legs_to_deal``: a projection."""
        columns = [*self.normalized.columns, *SLIP_ON_LEG, "fixture", "fixture_day", BY_DAY]
        return share_out(normalize(dealt)).select(*columns)

    def write_slips_legs(self, path: str) -> None:
        """The rows of ``slips`` and ``legs``, written under ``path``. Only COMBINED slips and legs are dealt to
        days; SIMPLE slips are projected from the written legs."""
        combined = data_window(self.read("combined_slips"))
        tables.write_slips_legs(combined, self.legs_to_deal, path, self.derive_legs, simple_slips)

    @property
    def plain_legs(self) -> DataFrame:
        """``leg_rows`` without fixtures, written in the partitions that they have, for queries that read them
        more than once."""
        return self.read("plain_legs")

    @property
    def money_legs(self) -> DataFrame:
        """``plain_legs`` with the columns only that prices, customer scores and anomalies read."""
        return self.read("money_legs")

    def _with_slips(self, legs: DataFrame) -> DataFrame:
        return look_up_slips(legs, data_window(self.read("combined_slips")), written=True)

    @property
    def matches(self) -> DataFrame:
        """The match dimension of the legs, with the day each match counts for."""
        return self.read("matches")


def _write_combined(made: Tables, path: str) -> None:
    tables.write_plain(combined_slips(made.normalized), path)


def _write_slips(made: Tables, path: str) -> None:
    tables.write_by_day(build_slips(made.normalized, made.read("combined_slips")), path)


def _write_matches(made: Tables, path: str) -> None:
    # A leg has its slip's betslip time, so both can be cut beforehand.
    tables.write_table(matches_with_day(data_window(made.raw)), path)


def _write_legs(made: Tables, path: str) -> None:
    tables.write_by_day(made.legs_to_deal, path, made.derive_legs)


def _write_plain_legs(made: Tables, path: str) -> None:
    tables.write_plain(made.leg_rows(), path)


MONEY_COLUMNS = [
    "row_id", "uid", "match", "competition", "market_clean", "market_group", "option_raw", "price", "event_ts",
    "betslip_ts", "stake_attr", "ggr_attr",
]


def _write_money_legs(made: Tables, path: str) -> None:
    tables.write_plain(made.leg_rows().select(*MONEY_COLUMNS), path)


MAKERS: dict[str, Callable[[Tables, str], None]] = {
    "combined_slips": _write_combined,
    "all_slips": _write_slips,
    "matches": _write_matches,
    "legs": _write_legs,
    "plain_legs": _write_plain_legs,
    "money_legs": _write_money_legs,
}


def build_tables(spark: SparkSession, legs: DataFrame, path: str) -> Tables:
    """Write the legs, which carry ``row_id``; roll-up, window and the rest are written when first read."""
    tables.write_table(legs, f"{path}/raw")
    return Tables(spark, path)


def from_pulls(spark: SparkSession, a: DataFrame, b: DataFrame, path: str) -> Tables:
    """The whole batch: two typed pulls in, tables out."""
    return build_tables(spark, reconciled_union(pair_pulls(a, b)), path)


def bound_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Tables over the bound legs of ``sf_dir``, for one run. Bound legs are written here, all else when first read."""
    path = scratch_table(spark, "tables")
    tables.write_plain(binding.bound_legs(spark, sf_dir), f"{path}/bound")
    return Tables(spark, path, "bound")


def bound_pulls(made: Tables) -> tuple[DataFrame, DataFrame]:
    """The bound legs split into the two overlapping pulls."""
    legs = made.read("bound")
    return binding.pull_a(legs), binding.pull_b(legs)
