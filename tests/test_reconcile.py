import re

from slipstream.operators import reconcile as rc


def pulls(raw_legs, a, b):
    return rc.pair_pulls(
        raw_legs([{**r, "source": "A"} for r in a]), raw_legs([{**r, "source": "B"} for r in b])
    )


def test_bets_of_either_file_are_kept(raw_legs):
    pairs = pulls(raw_legs, [{"uid": "1"}, {"uid": "2"}], [{"uid": "3"}])
    assert rc.reconciled_union(pairs).count() == 3
    assert rc.overlap_rows(pairs).count() == 0


def test_a_bet_in_both_files_counts_once(raw_legs):
    pairs = pulls(raw_legs, [{"uid": "1"}], [{"uid": "1"}])
    assert rc.reconciled_union(pairs).count() == 1
    assert rc.overlap_rows(pairs).count() == 1


def test_repeats_inside_a_file_survive(raw_legs):
    pairs = pulls(raw_legs, [{"uid": "1"}, {"uid": "1"}], [{"uid": "1"}])
    assert rc.reconciled_union(pairs).count() == 2
    assert rc.overlap_rows(pairs).count() == 1


def test_later_pull_settles(raw_legs):
    a = [{"uid": "1", "ggr": 10.0, "net_revenue": 0.8}]
    b = [{"uid": "1", "ggr": -35.0, "net_revenue": -2.8}]
    pairs = pulls(raw_legs, a, b)
    (bet,) = rc.reconciled_union(pairs).collect()
    assert (bet["ggr"], bet["net_revenue"], bet["source"]) == (-35.0, -2.8, "A")
    (c,) = rc.settlement_conflicts(pairs).collect()
    assert (c["conflicts"], c["ggr_before"], c["ggr_after"]) == (1, 10, -35)


def test_a_later_null_settlement_wins_too(raw_legs):
    pairs = pulls(raw_legs, [{"uid": "1"}], [{"uid": "1", "ggr": None}])
    assert rc.later_wins(pairs).first()["ggr"] is None
    assert rc.settlement_conflicts(pairs).first()["conflicts"] == 1


def test_nulls_in_the_identity_match(raw_legs):
    hole = {"option_raw": None, "match_id": None, "price": None}
    pairs = pulls(raw_legs, [hole], [hole])
    assert rc.reconciled_union(pairs).count() == 1


def test_occurrence_runs_across_stretches_of_a_hot_bet(raw_legs):
    # one bet fills most of the file; numbering is done in stretches of 7 rows
    rows = [{"uid": "hot" if i % 10 else f"u{i}"} for i in range(60)]
    got = rc.occurrence_key(raw_legs(rows), chunk_rows=7).where("uid = 'hot'").orderBy("source_row")
    assert [r["occurrence"] for r in got.collect()] == list(range(54))


def test_exact_duplicates_count_every_copy(rolled):
    _, legs = rolled([{}, {}, {"uid": "99"}])
    (d,) = rc.exact_duplicates(legs).collect()
    assert (d["dup_rows"], d["dup_rows_simple"], d["dup_rows_combined"], d["dup_stake_eur"]) == (2, 2, 0, 20)


def test_zero_and_null_prices_of_one_bet_are_numbered_across_stretches(raw_legs):
    rows = [{"price": (0.0, -0.0, None)[i % 3]} for i in range(12)]
    got = rc.occurrence_key(raw_legs(rows), chunk_rows=3).orderBy("source_row").collect()
    assert [r["occurrence"] for r in got if r["price"] is None] == list(range(4))
    assert sorted(r["occurrence"] for r in got if r["price"] is not None) == list(range(8))


def test_a_false_match_of_hashes_changes_no_number(raw_legs, monkeypatch):
    legs = raw_legs([{"uid": str(i % 4)} for i in range(20)])
    want = rc.occurrence_key(legs, chunk_rows=6).collect()
    monkeypatch.setattr(rc.F, "xxhash64", lambda *c: rc.F.lit(7).cast("long"))
    assert sorted(map(str, rc.occurrence_key(legs, chunk_rows=6).collect())) == sorted(map(str, want))


def test_a_bet_is_shuffled_once_and_counted_only_if_it_may_span_stretches(spark, raw_legs):
    plan = rc.occurrence_key(raw_legs([{"uid": str(i)} for i in range(9)]))._jdf.queryExecution()
    text = spark._jvm.PythonSQLUtils.explainString(plan, "formatted")
    moved = re.findall(r"Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)
    assert moved and not [x for x in moved if "__bet#" in x and "uid#" in x]
    assert "LeftSemi" in plan.optimizedPlan().toString()
