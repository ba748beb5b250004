"""Dictionary-encoded star schema: sorted dimensions and integer-coded facts.

Legs and slips are first folded to the distinct combinations of what is coded. All dictionaries are
ordered in one pass over these, all codes are fetched in one join over (dictionary, value) pairs of the
combinations, and a fact row then looks up its combination once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from slipstream import config
from slipstream.functions.numbers import ROWS, count_rows, rounded
from slipstream.operators.fixtures import matches_dim
from slipstream.operators.rank import running_totals
from slipstream.operators.skew import lookup
from slipstream.session import cut_lineage

SLIP_DICTIONARIES = {"uid": "uid", "unit": "unit", "currency": "currency"}
LEG_DICTIONARIES = {"option": "option_raw", "player": "entity_player", "team": "entity_team"}
LEG_KEYS = ["match_id", "market_clean", *LEG_DICTIONARIES.values()]
LAST = "~"  # sorts after all digits


def fold_slips(slips: DataFrame) -> DataFrame:
    """The combinations of dictionary values that slips have."""
    keys = list(SLIP_DICTIONARIES.values())
    return slips.groupBy(*keys).agg(F.count("*").alias(ROWS), F.min("first_row").alias("combination"))


def fold_legs(legs: DataFrame) -> DataFrame:
    """The combinations of what legs are coded by, with what the match and market dimensions need."""
    keys = [*LEG_KEYS, "match", "competition", "market_group", "star_substitute"]
    return legs.groupBy(*keys).agg(
        F.count("*").alias(ROWS), F.min("row_id").alias("row_id"), F.min("event_ts").alias("event_ts")
    )


def _pairs(dims: dict[str, Column]) -> Column:
    """(dictionary, value) pairs of a row; nulls are the value ""."""
    return F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(c, F.lit("")).alias("value")) for d, c in dims.items()])


def _columns(dims: dict[str, str]) -> dict[str, Column]:
    return {d: F.col(c) for d, c in dims.items()}


def _match_value() -> Column:
    """A match id as text of equal length, so that text order is id order; a missing id is last."""
    shifted = (F.col("match_id").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string")
    return F.coalesce(F.lpad(shifted, 20, "0"), F.lit(LAST))


def _dictionaries(sources: list[tuple[DataFrame, dict[str, Column], Column]]) -> DataFrame:
    """All values of the sources' dictionaries, numbered in one ordered pass."""
    long = [df.select(F.inline(_pairs(dims)), n.alias("rows")) for df, dims, n in sources]
    sizes = reduce(DataFrame.unionByName, long).groupBy("dim", "value").agg(F.sum("rows").alias("n"))
    return cut_lineage(_with_place(sizes, "value", "code", ["dim"]))


def _with_place(rows: DataFrame, value: str, name: str, within: Sequence[str] = ()) -> DataFrame:
    """Add the 0-based place of each row in the order of its distinct value."""
    return running_totals(rows, value, within, {name: F.lit(1).cast("long")})


def markets_dim(legs: DataFrame) -> DataFrame:
    """Per clean market name: group and star flag of its first leg."""
    folded = (
        legs.where(F.col("market_clean").isNotNull())
        .groupBy("market_clean", "market_group", "star_substitute")
        .agg(F.min("row_id").alias("row"), count_rows(legs).alias("legs"))
    )
    return folded.groupBy("market_clean").agg(
        F.min_by("market_group", "row").alias("market_group"),
        F.min_by("star_substitute", "row").alias("star"),
        F.sum("legs").alias("legs"),
    )


def brand_name(slips: DataFrame) -> DataFrame:
    """One row: the most common first word among unit names of several words."""
    words = F.split(F.trim("unit"), r"\s+")
    firsts = (
        slips.select("unit")
        .distinct()
        .where(F.size(words) > 1)
        .select("unit", F.get(words, F.lit(0)).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("units"), F.min("unit").alias("first_unit"))
    )
    best = firsts.agg(F.min_by("word", F.struct(-F.col("units"), "first_unit")).alias("word"))
    return best.select(F.coalesce(F.initcap("word"), F.lit("Client")).alias("brand"))


def _ordinal(name: str, labels: list[str]) -> Column:
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(name))
    return (place - 1).cast("long")


def _epoch(name: str) -> Column:
    return F.coalesce(F.unix_seconds(name), F.lit(-1)).cast("long")


class StarExport:
    """The star export of one run. What several tables of it need is written once, when first asked for.

    ``alone`` are the same legs without what they have of their slip, where these are cheaper to read.
    """

    def __init__(self, slips: DataFrame, legs: DataFrame, alone: DataFrame | None = None):
        self.slips, self.legs, self.alone = slips, legs, legs if alone is None else alone

    @cached_property
    def _slip_folds(self) -> DataFrame:
        return cut_lineage(fold_slips(self.slips))

    @cached_property
    def _leg_folds(self) -> DataFrame:
        return cut_lineage(fold_legs(self.alone))

    @cached_property
    def _matches(self) -> DataFrame:
        return cut_lineage(matches_dim(self._leg_folds))

    @cached_property
    def _markets(self) -> DataFrame:
        return cut_lineage(markets_dim(self._leg_folds))

    @cached_property
    def slip_dictionaries(self) -> DataFrame:
        """``dim``, ``value``, ``code``, ``n`` of what slips are coded by."""
        return _dictionaries([(self._slip_folds, _columns(SLIP_DICTIONARIES), F.col(ROWS))])

    @cached_property
    def leg_dictionaries(self) -> DataFrame:
        """The same of what legs are coded by, of competitions, matches and markets."""
        return _dictionaries(
            [
                (self._leg_folds, _columns(LEG_DICTIONARIES), F.col(ROWS)),
                (self._matches, {"competition": F.col("competition")}, F.lit(1).cast("long")),
                (self._matches, {"match": _match_value()}, F.col("legs")),
                (self._markets, {"market": F.col("market_clean")}, F.col("legs")),
            ]
        )

    @property
    def dims(self) -> DataFrame:
        """The dictionaries. ``code`` is 0-based in value order, ``n`` the rows coded; nulls code as "".

        None is assumed to be small: customers or options may run to many millions.
        """
        of_legs = self.leg_dictionaries.where(~F.col("dim").isin("match", "market"))
        return self.slip_dictionaries.unionByName(of_legs)

    def _named(self, table: DataFrame, dim: str, value: Column) -> DataFrame:
        codes = self.leg_dictionaries.where(F.col("dim") == dim).select(F.col("value").alias("value_"), "code")
        return table.join(codes, value == F.col("value_")).select(*table.columns, "code")

    @cached_property
    def matches(self) -> DataFrame:
        """The match dimension with its 0-based ``code``: ids in order, a missing id last."""
        return cut_lineage(self._named(self._matches, "match", _match_value()))

    @cached_property
    def markets(self) -> DataFrame:
        """The market dimension with its 0-based ``code`` in the order of the names."""
        return cut_lineage(self._named(self._markets, "market", F.col("market_clean")))

    def _coded(
        self, folds: DataFrame, codes: DataFrame, row: str, dims: dict[str, Column], keys: list[str]
    ) -> DataFrame:
        """Combinations of ``keys`` with a ``<dim>_code`` each, written; ``row`` names a combination."""
        long = folds.select(row, F.inline(_pairs(dims)))
        found = lookup(long, codes, ["dim", "value"], "n", F.col(row), null_safe=False, written=True)
        back = found.groupBy(row).agg(*[F.max(F.when(F.col("dim") == d, F.col("code"))).alias(f"{d}_code") for d in dims])
        joined = folds.select(row, *keys, ROWS).join(back, row)
        return cut_lineage(joined.groupBy(*keys).agg(*[F.max(f"{d}_code").alias(f"{d}_code") for d in dims], F.sum(ROWS).alias(ROWS)))

    @cached_property
    def _slip_codes(self) -> DataFrame:
        return self._coded(
            self._slip_folds, self.slip_dictionaries, "combination", _columns(SLIP_DICTIONARIES), list(SLIP_DICTIONARIES.values())
        )

    @cached_property
    def _leg_codes(self) -> DataFrame:
        dims = {"match": _match_value(), "market": F.col("market_clean"), **_columns(LEG_DICTIONARIES)}
        return self._coded(self._leg_folds, self.leg_dictionaries, "row_id", dims, LEG_KEYS)

    @cached_property
    def _index(self) -> DataFrame:
        """First row of a slip to its 0-based place in their order; two numbers a slip are ordered, no more."""
        return cut_lineage(_with_place(self.slips.select("first_row", "n_legs"), "first_row", "slip"))

    @property
    def slip_facts(self) -> DataFrame:
        """Slips as numbers: codes, epoch seconds, rounded money, sentinels."""
        keys = list(SLIP_DICTIONARIES.values())
        coded = lookup(self.slips, self._slip_codes, keys, ROWS, F.col("first_row"), written=True)
        coded = coded.join(self._index.select("first_row", "slip"), "first_row")
        usable = F.col("price").isNotNull() & (F.col("price") <= config.EXPORT_MAX_PRICE)
        return coded.select(
            "slip",
            _epoch("betslip_ts").alias("ts"),
            F.col("uid_code").alias("uid"),
            _ordinal("bet_type", config.BET_TYPES).alias("bet_type"),
            F.round("stake_eur", 2).alias("stake"),
            F.round("ggr_eur", 2).alias("ggr"),
            F.round("net_revenue_eur", 4).alias("nr"),
            "n_legs",
            F.when(usable, rounded(F.when(usable, F.col("price")), 2)).otherwise(-1.0).alias("price"),
            _ordinal("phase", config.PHASES).alias("phase"),
            F.coalesce(rounded(F.col("lead_minutes"), 0).cast("long"), F.lit(-99999)).alias("lead_min"),
            F.col("unit_code").alias("unit"),
            _ordinal("channel", config.CHANNELS).alias("channel"),
            F.col("currency_code").alias("currency"),
        )

    @property
    def leg_facts(self) -> DataFrame:
        """Legs as numbers, pointing at slips, matches, markets and dictionaries."""
        spread = F.col("row_id")
        legs = self.legs.select(
            "row_id", *LEG_KEYS, "price", "line", "betslip_ts", "event_ts",
            F.substring("slip_id", 2, 20).cast("long").alias("first_row"),  # a slip is named after it
        )
        coded = lookup(legs, self._leg_codes, LEG_KEYS, ROWS, spread, written=True)
        coded = coded.drop(*LEG_KEYS, ROWS)
        coded = lookup(coded, self._index, ["first_row"], "n_legs", spread, null_safe=False, written=True)
        return coded.select(
            "row_id",
            "slip",
            F.coalesce("match_code", F.lit(-1)).cast("long").alias("match"),
            F.col("market_code").cast("long").alias("market"),
            F.col("option_code").alias("option"),
            F.col("player_code").alias("player"),
            F.col("team_code").alias("team"),
            F.coalesce(rounded(F.col("price"), 3), F.lit(-1.0)).alias("price"),
            F.coalesce("line", F.lit(-1.0)).alias("line"),
            _epoch("betslip_ts").alias("ts"),
            _epoch("event_ts").alias("event_ts"),
        )


def decoded_legs(legs: DataFrame, matches: DataFrame, markets: DataFrame) -> DataFrame:
    """Exported legs with the names that their match and market codes stand for."""
    match = matches.select(F.col("code").alias("match"), "match_id", "name", "competition")
    market = markets.select(F.col("code").alias("market"), "market_clean", "market_group")
    return legs.join(match, "match").join(market, "market", "left")
