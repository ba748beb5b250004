from datetime import timedelta

import pytest
from leg_rows import KICKOFF, NOON, column
from pyspark.sql import functions as F

from slipstream import config
from slipstream.operators import rollup


def combined(**over):
    return {"bet_type": "COMBINED", "stake": 25.0, "ggr": 25.0, **over}


def test_combined_legs_are_one_slip(rolled):
    slips, legs = rolled([combined(option_raw=f"Leg {i}", price=p) for i, p in enumerate((1.5, 1.2, 1.35))])
    (slip,) = slips.collect()
    assert (float(slip["stake_eur"]), float(slip["ggr_eur"]), slip["n_legs"]) == (25.0, 25.0, 3)
    assert slip["price"] == pytest.approx(1.5 * 1.2 * 1.35)
    assert {r["slip_id"] for r in legs.collect()} == {slip["slip_id"]}


def test_settlement_keeps_slips_apart(rolled):
    slips, _ = rolled([combined(stake=0.03, ggr=g) for g in (0.03, -3.73)])
    assert slips.count() == 2


def test_simple_rows_never_merge(rolled):
    slips, _ = rolled([{}, {}])
    assert slips.agg(F.count("*"), F.sum("stake_eur")).first() == (2, 20)


def test_null_keys_group_together(rolled):
    slips, legs = rolled([combined(uid=None, net_revenue=None)] * 3)
    assert slips.count() == 1
    assert column(legs, "n_legs") == [3, 3, 3]


def test_first_attributes_come_from_the_first_row(rolled):
    slips, _ = rolled(
        [
            combined(unit=None, competition=None, match_id=None, price=None),
            combined(unit="UNIT SOUTH", competition="Cup", match_id=7, price=None),
        ]
    )
    (s,) = slips.collect()
    assert (s["unit"], s["unit_country"], s["n_matches"], s["competitions"], s["price"]) == (
        "UNIT SOUTH", "Spain", 1, 1, 1.0,
    )


def test_shares_add_up_to_slips(rolled):
    rows = [combined(uid=str(i // 3), stake=9.0 + i // 3) for i in range(12)] + [{"uid": "s"}]
    slips, legs = rolled(rows)
    assert float(legs.agg(F.sum("stake_attr")).first()[0]) == pytest.approx(
        float(slips.agg(F.sum("stake_eur")).first()[0]), abs=1e-5
    )


def test_one_slip_with_a_third_of_all_legs(rolled, monkeypatch):
    monkeypatch.setattr(config, "HOT_KEYS", 2)
    rows = [combined(uid="hot")] * 40 + [combined(uid=str(i // 2)) for i in range(80)]
    slips, legs = rolled(rows)
    assert slips.count() == 41 and legs.count() == 120
    assert legs.where("uid = 'hot' and n_legs = 40 and stake_attr = 0.625").count() == 40
    assert legs.where("n_legs is null").count() == 0


@pytest.mark.parametrize(
    "lead,phase",
    [
        (3000, "early pre-match"), (1440, "day-of pre-match"), (61, "day-of pre-match"),
        (60, "post-lineups (proxy)"), (1, "post-lineups (proxy)"), (-1, "in-play"), (-200, "in-play"),
        (None, "early pre-match"),
    ],
)
def test_phase_bounds(rolled, lead, phase):
    event = None if lead is None else NOON + timedelta(minutes=lead)
    slips, legs = rolled([{"event_ts": event}])
    assert slips.first()["phase"] == legs.first()["phase"] == phase


def test_window_reports_what_it_drops(rolled):
    early = KICKOFF - timedelta(days=30)
    slips, legs = rolled([{"betslip_ts": early}, {}, {"betslip_ts": None}])
    assert rollup.data_window(slips).count() == rollup.data_window(legs).count() == 1
    assert rollup.window_report(slips).first() == (1, 1, 10, 1)


@pytest.mark.parametrize("price", [20.0, 1e30, float("inf"), float("nan")])
def test_a_very_long_slip_does_not_overflow(rolled, price):
    from slipstream.operators import star_export
    from slipstream.plans.catalog import plain

    slips, _ = rolled([combined(price=price, option_raw=f"Leg {i}") for i in range(300)])
    (slip,) = plain(slips).collect()
    assert slip["n_legs"] == 300 and not slip["price"] < 1e30
    (fact,) = star_export.StarExport(slips, rolled([combined()])[1]).slip_facts.collect()
    assert fact["price"] == -1.0
