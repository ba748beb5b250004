from datetime import timedelta

import pytest
from leg_rows import KICKOFF, NOON
from pyspark.sql import functions as F

from slipstream.operators import concentration, facts, filters, findings, fixtures, series, star_export
from slipstream.operators.filters import Filters
from slipstream.plans.tables import from_pulls
from slipstream.session import scratch_table


@pytest.fixture
def mixed(rolled):
    combined = {"bet_type": "COMBINED", "uid": "c", "stake": 30.0, "ggr": 5.0}
    return rolled(
        [
            {"uid": "a", "market_raw": "Team corners", "option_raw": "Alpha 2 or more"},
            {**combined, "market_raw": "Team corners", "competition": "Other Cup", "match_id": 7, "match": "G - H"},
            {**combined, "market_raw": "Match corners", "option_raw": "Over 5"},
            {**combined, "market_raw": "Match corners", "option_raw": "Over 5"},
            {"uid": "b", "betslip_ts": NOON + timedelta(days=3), "event_ts": KICKOFF + timedelta(days=3)},
        ]
    )


def test_one_leg_must_pass_all_leg_filters(mixed):
    slips, legs = mixed
    both = Filters(market_groups=["Match stats"], competitions=["Other Cup"])
    assert filters.filter_by_legs(slips, legs, both).count() == 0
    one = Filters(market_groups=["Match stats"], competitions=["Test Cup"])
    assert [r["uid"] for r in filters.filter_by_legs(slips, legs, one).collect()] == ["c"]
    assert filters.filter_legs(legs, one).count() == 3  # the whole slip stays


def test_end_date_is_inclusive(mixed):
    slips, _ = mixed
    assert filters.filter_slips(slips, Filters(date_from="2026-06-15", date_to="2026-06-15")).count() == 2


def test_totals_of_nothing_are_zero(mixed):
    slips, _ = mixed
    t = filters.totals(slips.where("uid = 'nobody'")).first()
    assert (t["slips"], float(t["stake"]), t["avg_stake"], t["margin_pct"]) == (0, 0.0, 0.0, 0.0)


def test_drill_total_equals_row_count(mixed):
    _, legs = mixed
    for dim in ("market_group", "selection"):
        row = concentration.concentrate_leg(legs, dim).orderBy("key").first()
        assert concentration.drill_total(legs, dim, row["key"]).first()["total"] == row["n"]
        assert concentration.drill_rows(legs, dim, row["key"]).count() == row["n"]


def test_line_labels_have_no_trailing_zero(mixed):
    _, legs = mixed
    keys = {r["key"] for r in concentration.concentrate_leg(legs, "line").collect()}
    assert keys == {"Team corners @ 2", "Match corners @ 5"}


def test_series_fill_gaps_and_sum_to_the_headline(mixed):
    slips, _ = mixed
    rows = series.time_series(slips, "turnover").orderBy("bucket").collect()
    assert [r["value"] for r in rows] == [40.0, 0.0, 0.0, 10.0]
    split = series.time_series(slips, "turnover", "channel")
    assert {r["name"] for r in split.collect()} == {"online"}
    assert split.agg(F.sum("value")).first()[0] == 50.0


def test_fixture_money_counts_once_per_touched_fixture(mixed):
    _, legs = mixed
    table = fixtures.fixture_table(fixtures.with_fixture(legs), fixtures.fixture_groups(legs))
    got = {(r["name"], str(r["day"])): float(r["stake"]) for r in table.collect()}
    # two match ids and days of one pairing; the combined slip touches two fixtures
    assert got == {("Alpha - Beta", "2026-06-15"): 50.0, ("G - H", "2026-06-15"): 30.0}


def test_surfaces_agree_and_strict_stops(mixed):
    slips, legs = mixed
    star = star_export.StarExport(slips, legs)
    slip_facts, leg_facts = star.slip_facts, star.leg_facts
    cards = facts.headline_cards(slips)
    good = facts.consistency_check(slips, legs, cards, slip_facts, leg_facts, strict=True)
    assert good.count() == 8 and good.where("not ok").count() == 0
    short = slip_facts.where("slip > 0")
    with pytest.raises(Exception, match="surfaces disagree"):
        facts.consistency_check(slips, legs, cards, short, leg_facts, strict=True).collect()


def test_phase_stakes_sum_to_the_headline(mixed):
    slips, _ = mixed
    assert float(findings.phase_stats(slips).agg(F.sum("stake")).first()[0]) == 50.0


def test_pulls_to_tables(spark, raw_legs):
    a = raw_legs([{"uid": "1", "ggr": 1.0}, {"uid": "2"}])
    b = raw_legs([{"uid": "1", "ggr": -9.0, "source": "B"}, {"uid": "3", "source": "B"}])
    made = from_pulls(spark, a, b, scratch_table(spark, "run"))
    got = {r["uid"]: float(r["ggr_eur"]) for r in made.slips.collect()}
    assert got == {"1": -9.0, "2": 10.0, "3": 10.0}
    assert made.legs.count() == 3


def test_missing_names_are_a_key_of_their_own(rolled):
    slips, _ = rolled([{"uid": None, "stake": 5.0}, {"uid": "a", "stake": 7.0}, {"uid": "b", "unit": None, "stake": 9.0}])
    for dim in ("uid", "unit"):
        rows = {r["key"]: float(r["stake"]) for r in concentration.concentrate_slip(slips, dim).collect()}
        assert "" in rows and sum(rows.values()) == 21.0


def test_a_merged_fixture_filters_all_its_match_ids(rolled):
    slips, legs = rolled([{"match_id": 1}, {"match_id": 2, "uid": "x"}, {"match_id": 3, "match": "C - D"}])
    both = Filters(fixtures=[("Alpha - Beta", "2026-06-15")])
    kept = filters.filter_by_legs(slips, fixtures.with_fixture(legs), both)
    assert kept.count() == 2
