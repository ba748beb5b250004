"""One DuckDB statement per registered query, written apart from the operators."""

from __future__ import annotations

from oracle.base import BOUND, NORM, NORMALIZED, PRICE, PRICED, PULL, PULLS, RISK, ROLL, chain


def d(expr: str, name: str, places: int = 6) -> str:
    """A number as the queries show it: half-up on a decimal, then double."""
    return f"cast(round(cast({expr} as decimal(28,9)), {places}) as double) as {name}"


def ds(*names: str) -> str:
    return ", ".join(d(n, n) for n in names)


def ts(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') as {name}"


def day(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d') as {name}"


def n(expr: str, name: str) -> str:
    return f"cast({expr} as bigint) as {name}"


def pct(top: str, bottom: str) -> str:
    return f"coalesce(cast({top} as double) / nullif(cast({bottom} as double), 0), 0) * 100"


def whole(expr: str) -> str:
    """1234567.8 -> '1,234,568'."""
    return f"format('{{:,}}', cast(round(cast({expr} as decimal(28,9)), 0) as bigint))"


def fixed(expr: str, places: int) -> str:
    return f"cast(cast(round(cast({expr} as decimal(28,9)), {places}) as decimal(28,{places})) as varchar)"


def euro(expr: str) -> str:
    return f"case when {expr} < 0 then '-' else '' end || '€' || {whole(f'abs({expr})')}"


def labels(*columns: str) -> str:
    shown = ", ".join(columns)
    return f"{NORM} select {shown}, count(*) as legs from nl group by {shown}"


def even_share(amount: str) -> str:
    """amount / n_legs in whole millionths, half away from zero."""
    micro = f"cast(abs({amount}) * 1000000 as bigint)"
    return f"sign({amount}) * ((2 * {micro} + s.n_legs) // (2 * s.n_legs)) / 1000000e0"


TEXT_LEG = "competition, match_id, match, market_raw, bet_type, option_raw, uid, unit, currency_raw"

HEAD = """,
head as (
  select sum(round(stake_eur, 2)) as turnover, sum(round(ggr_eur, 2)) as ggr,
    round(sum(round(net_revenue_eur, 4)), 2) as nr, count(*) as slips,
    count(*) filter (where bet_type = 'SIMPLE') as simple, count(*) filter (where bet_type = 'COMBINED') as combined,
    count(distinct uid) as customers, min(betslip_ts) as low, max(betslip_ts) as high
  from slips),
head2 as (
  select *, round(cast(cast(ggr as double) / cast(turnover as double) * 100 as decimal(28,9)), 2) as margin,
    strftime(low, '%Y-%m-%d') || ' to ' || strftime(high, '%Y-%m-%d') as span from head)
"""

PHASE_ORDER = "['early pre-match', 'day-of pre-match', 'post-lineups (proxy)', 'in-play']"

MATCHES = """,
matches as (
  select match_id, arg_min(match, row_id) as name, arg_min(competition, row_id) as competition,
    min(event_ts) as kickoff, count(*) as legs from legs group by match_id),
mdays as (select *, cast(kickoff - interval '6' hour as date) as day from matches),
fx as (
  select name, day, arg_min(competition, coalesce(match_id, 9223372036854775807)) as competition,
    min(kickoff) as kickoff, count(*) as match_ids from mdays group by name, day),
fl as (
  select l.*, m.name as fixture, m.day as fixture_day from legs l join mdays m on l.match_id is not distinct from m.match_id),
once as (
  select distinct fixture, fixture_day, slip_id, uid, betslip_ts, phase, slip_stake_eur, slip_ggr_eur from fl),
fxt as (
  select f.name, f.day, f.competition, f.kickoff, count(*) as slips, sum(slip_stake_eur) as stake, sum(slip_ggr_eur) as ggr,
    count(distinct uid) as customers,
    coalesce(sum(slip_stake_eur) filter (where phase = 'in-play'), 0) as inplay
  from once o join fx f on o.fixture is not distinct from f.name and o.fixture_day is not distinct from f.day
  group by f.name, f.day, f.competition, f.kickoff),
fs as (select * exclude (fixture, fixture_day) from once where fixture = 'Team1 - Side4' and fixture_day = date '2026-06-12')
"""
FIX = ROLL + MATCHES

DICTS = """,
dict_values as (
  select 'uid' as dim, coalesce(uid, '') as value from slips
  union all select 'unit', coalesce(unit, '') from slips
  union all select 'currency', coalesce(currency, '') from slips
  union all select 'option', coalesce(option_raw, '') from legs
  union all select 'player', coalesce(entity_player, '') from legs
  union all select 'team', coalesce(entity_team, '') from legs
  union all select 'competition', coalesce(competition, '') from matches),
dicts as (
  select dim, value, row_number() over (partition by dim order by value) - 1 as code, count(*) as n
  from dict_values group by dim, value),
slip_pos as (select slip_id, row_number() over (order by first_row) - 1 as slip from slips)
"""
STAR = FIX + DICTS

SLIP_FACTS = """
select p.slip, cast(epoch(s.betslip_ts) as bigint) as ts, u.code as uid,
  cast(case s.bet_type when 'SIMPLE' then 0 else 1 end as bigint) as bet_type,
  cast(round(s.stake_eur, 2) as double) as stake, cast(round(s.ggr_eur, 2) as double) as ggr,
  cast(round(s.net_revenue_eur, 4) as double) as nr, s.n_legs,
  case when s.price <= 10000 then cast(round(cast(s.price as decimal(28,9)), 2) as double) else -1e0 end as price,
  cast(list_position(['early pre-match', 'day-of pre-match', 'post-lineups (proxy)', 'in-play'], s.phase) - 1 as bigint) as phase,
  coalesce(cast(round(s.lead_minutes) as bigint), -99999) as lead_min, un.code as unit,
  cast(list_position(['online', 'retail', 'tpv'], s.channel) - 1 as bigint) as channel, c.code as currency
from slips s join slip_pos p on s.slip_id = p.slip_id
  join dicts u on u.dim = 'uid' and u.value = coalesce(s.uid, '')
  join dicts un on un.dim = 'unit' and un.value = coalesce(s.unit, '')
  join dicts c on c.dim = 'currency' and c.value = coalesce(s.currency, '')
"""

LEG_FACTS = """
select l.row_id, p.slip, m.code as match, mk.code as market, o.code as option, pl.code as player, t.code as team,
  coalesce(cast(round(cast(l.price as decimal(28,9)), 3) as double), -1e0) as price, coalesce(l.line, -1e0) as line,
  cast(epoch(l.betslip_ts) as bigint) as ts, coalesce(cast(epoch(l.event_ts) as bigint), -1) as event_ts
from legs l join slip_pos p on l.slip_id = p.slip_id
  join (select match_id, row_number() over (order by match_id nulls last) - 1 as code from matches) m
    on m.match_id is not distinct from l.match_id
  join (select market_clean, row_number() over (order by market_clean) - 1 as code
        from (select distinct market_clean from legs)) mk on mk.market_clean = l.market_clean
  join dicts o on o.dim = 'option' and o.value = coalesce(l.option_raw, '')
  join dicts pl on pl.dim = 'player' and pl.value = coalesce(l.entity_player, '')
  join dicts t on t.dim = 'team' and t.value = coalesce(l.entity_team, '')
"""

SOURCES = {
    "load_export": f"""{BOUND} select 'A' as source, competition, bet_type, currency_raw, count(*) as legs,
        count(event_ts) as with_kickoff, count(distinct match_id) as match_ids,
        {d('sum(cast(stake as decimal(18,6)))', 'stake')}, {d('sum(cast(ggr as decimal(18,6)))', 'ggr')},
        {ts('min(betslip_ts)', 'first_bet')}, {n('max(src_row)', 'last_row')}
      from bound group by competition, bet_type, currency_raw""",
    "load_export_text": f"""{BOUND}, spelled as (select *, option_raw || case when src_row % 3 = 0 then '|"second" line, x'
          when src_row % 7 = 0 then ' ""' else '' end as opt from bound)
      select 'A' as source, competition, bet_type, currency_raw, count(*) as legs,
        count(event_ts) as with_kickoff, count(distinct match_id) as match_ids,
        {d('sum(cast(stake as decimal(18,6)))', 'stake')}, {d('sum(cast(ggr as decimal(18,6)))', 'ggr')},
        {ts('min(betslip_ts)', 'first_bet')}, {n('max(src_row)', 'last_row')},
        {n('sum(length(opt))', 'option_chars')}, max(opt) as last_option,
        count(*) filter (where src_row % 3 = 0 and option_raw is not null) as broken_options
      from spelled group by competition, bet_type, currency_raw""",
    "typed_legs": f"""{BOUND} select {TEXT_LEG}, {ts('event_ts', 'event_ts')}, {ts('betslip_ts', 'betslip_ts')},
        {ds('price', 'stake', 'ggr', 'net_revenue')}, 'A' as source, {n('src_row', 'source_row')} from bound""",
    "write_slips_legs": f"""{ROLL} select 'slips' as name, {day('betslip_ts', 'betslip_date')}, count(*) as rows,
        {d('sum(stake_eur)', 'stake')} from slips group by 1, 2
      union all select 'legs', {day('betslip_ts', 'betslip_date')}, count(*), {d('sum(stake_attr)', 'stake')}
      from legs group by 1, 2""",
    "write_facts": f"""{ROLL}{HEAD}
      select 'Turnover' as label, {euro('turnover')} as value from head2
      union all select 'GGR', {euro('ggr')} from head2
      union all select 'Blended margin', {fixed('margin', 2)} || '%' from head2
      union all select 'Betslips', {whole('slips')} from head2
      union all select 'Customers', {whole('customers')} from head2
      union all select 'Window', span from head2
      union all select phase, cast(count(*) as varchar) from slips group by phase""",
    "star_export_dims": f"{STAR} select dim, value, code, n from dicts",
    "star_export_facts": STAR + SLIP_FACTS,
    "star_export_leg_facts": STAR + LEG_FACTS,
    "star_export_decoded": f"""{FIX} select {n('l.row_id', 'row_id')}, l.match_id, m.name, l.market_clean,
        (select arg_min(k.market_group, k.row_id) from legs k where k.market_clean = l.market_clean) as market_group
      from legs l join matches m on l.match_id is not distinct from m.match_id""",
    "matches_dim": f"{FIX} select match_id, name, competition, {ts('kickoff', 'kickoff')}, legs from matches",
    "markets_dim": f"""{ROLL} select market_clean, arg_min(market_group, row_id) as market_group,
        arg_min(star_substitute, row_id) as star, count(*) as legs from legs group by market_clean""",
    "brand_name": f"""{ROLL} select coalesce((select upper(substr(word, 1, 1)) || lower(substr(word, 2)) from (
          select split_part(unit, ' ', 1) as word, count(*) as units, min(unit) as first_unit
          from (select distinct unit from slips) where contains(unit, ' ') group by 1)
        order by units desc, first_unit limit 1), 'Client') as brand""",
}

RECONCILE = {
    "occurrence_key": f"{PULL} select source, {n('src_row', 'source_row')}, occurrence from occ",
    "file_stats": f"""{PULL} select source, count(*) as rows, {d('sum(cast(stake as decimal(18,6)))', 'stake')},
        {d('sum(cast(ggr as decimal(18,6)))', 'ggr')}, {ts('min(betslip_ts)', 'betslip_min')},
        {ts('max(betslip_ts)', 'betslip_max')} from both_pulls group by source""",
    "overlap_rows": f"{PULL} select {n('src_row', 'source_row')}, uid from shared",
    "settlement_conflicts": f"""{PULL} select count(*) as conflicts, {d('sum(cast(ggr as decimal(18,6)))', 'ggr_before')},
        {d('sum(cast(new_ggr as decimal(18,6)))', 'ggr_after')} from shared
      where ggr is distinct from new_ggr or net_revenue is distinct from new_net""",
    "later_wins": f"""{PULL} select {n('src_row', 'source_row')}, uid, {ds('stake', 'ggr', 'net_revenue')} from settled""",
    "reconciled_union": f"""{PULL} select source, {n('src_row', 'source_row')}, uid, {ts('betslip_ts', 'betslip_ts')},
        match_id, option_raw, {ds('stake', 'ggr', 'net_revenue')} from merged""",
    "row_identity": f"""{PULL} select source, {n('src_row', 'source_row')},
        cast(case source when 'A' then 0 else 72057594037927936 end + src_row as bigint) as row_id from merged""",
    "exact_duplicates": f"""{ROLL}, copies as (
        select bet_type, stake_eur, count(*) as k from legs
        group by sport, competition, match_id, match, event_ts, market_raw, bet_type, player_raw, option_raw, betslip_ts,
          uid, unit, price, stake, ggr, net_revenue, currency_raw, stake_eur having count(*) > 1)
      select {n('coalesce(sum(k), 0)', 'dup_rows')}, {n("coalesce(sum(k) filter (where bet_type = 'SIMPLE'), 0)", 'dup_rows_simple')},
        {n("coalesce(sum(k) filter (where bet_type = 'COMBINED'), 0)", 'dup_rows_combined')},
        {d('coalesce(sum(stake_eur * k), 0)', 'dup_stake_eur')} from copies""",
}

NORMALISE = {
    "market_clean": labels("market_raw", "market_clean"),
    "market_group": labels("market_raw", "market_group"),
    "star_flag": labels("market_raw", "star_substitute"),
    "match_sides": f"{NORM} select match, home as team_home, away as team_away, count(*) as legs from nl group by 1, 2, 3",
    "entity_team": labels("market_raw", "match", "option_raw", "entity_team"),
    "entity_player": labels("market_raw", "option_raw", "entity_player"),
    "extract_line": labels("option_raw", "line"),
    "currency_infer": labels("currency_raw", "unit", "currency", "currency_inferred"),
    "to_eur": f"{NORM} select {n('row_id', 'row_id')}, currency, {ds('stake_eur', 'ggr_eur', 'net_revenue_eur')} from nl",
    "channel": labels("uid", "channel"),
    "unit_country": labels("unit", "unit_country"),
}

ROLLUP = {
    "slip_id": f"{ROLL} select {n('row_id', 'row_id')}, slip_id from keyed",
    "slips": f"""{ROLL} select slip_id, uid, {ts('betslip_ts', 'betslip_ts')}, bet_type, unit, unit_country, channel,
        currency, currency_inferred, source, {ds('stake', 'ggr', 'net_revenue', 'stake_eur', 'ggr_eur', 'net_revenue_eur')},
        n_legs, n_matches, {ts('first_event_ts', 'first_event_ts')}, {ts('last_event_ts', 'last_event_ts')}, competitions,
        {d('price', 'price')}, {n('first_row', 'first_row')}, first_competition from slips_all""",
    "leg_attribution": f"""{ROLL} select {n('k.row_id', 'row_id')}, s.n_legs,
        {d(even_share('s.stake_eur'), 'stake_attr')}, {d(even_share('s.ggr_eur'), 'ggr_attr')}
      from keyed k join slips_all s on k.slip_id = s.slip_id""",
    "lead_minutes": f"{ROLL} select slip_id, {d('lead_minutes', 'lead_minutes')} from slips_all",
    "phase": f"{ROLL} select slip_id, phase from slips_all",
    "data_window": f"""{ROLL} select count(*) filter (where betslip_ts >= timestamp '2026-06-01') as kept_slips,
        count(*) filter (where betslip_ts < timestamp '2026-06-01') as excluded_slips,
        {d("coalesce(round(sum(stake_eur) filter (where betslip_ts < timestamp '2026-06-01'), 2), 0)", 'excluded_stake')},
        count(*) filter (where betslip_ts is null) as untimed_slips from slips_all""",
}

FACTS = {
    "headline_totals": f"""{ROLL}{HEAD} select {d('turnover', 'turnover_eur')}, {d('ggr', 'ggr_eur')},
        {d('nr', 'net_revenue_eur')}, {d('margin', 'margin_pct')}, slips, simple as slips_simple,
        combined as slips_combined, customers, {ts('low', 'betslip_min')}, {ts('high', 'betslip_max')} from head2""",
    "raw_row_totals": f"""{ROLL} select count(*) as legs, {d('round(sum(stake_eur), 2)', 'raw_turnover_eur')},
        {d('round(sum(ggr_eur), 2)', 'raw_ggr_eur')}, count(*) filter (where currency_inferred) as currency_rows_inferred
      from legs""",
    "phase_counts": f"""{ROLL} select phase, count(*) as slips, {d('round(sum(stake_eur), 2)', 'stake_eur')}
      from slips group by phase""",
    "recon_table": f"""{chain(PULLS, NORMALIZED)}{ROLL.split("from named)")[1]}{HEAD}
      select 'file ' || source as name, count(*) as rows, {d('sum(cast(stake as decimal(18,6)))', 'turnover')},
        {d('sum(cast(ggr as decimal(18,6)))', 'ggr')}, 'raw rows, mixed currencies' as note from both_pulls group by source
      union all select 'union, deduped', count(*), {d('round(sum(stake_eur), 2)', 'turnover')},
        {d('round(sum(ggr_eur), 2)', 'ggr')}, 'EUR, leg rows' from legs
      union all select 'slip-level (headline)', slips, {d('turnover', 'turnover')}, {d('ggr', 'ggr')},
        'margin ' || {fixed('margin', 2)} || '%' from head2""",
    "headline_cards": f"""{ROLL}{HEAD}
      select 'Turnover' as label, {euro('turnover')} as value from head2
      union all select 'GGR', {euro('ggr')} from head2
      union all select 'Blended margin', {fixed('margin', 2)} || '%' from head2
      union all select 'Betslips', {whole('slips')} from head2
      union all select 'Customers', {whole('customers')} from head2
      union all select 'Window', span from head2""",
    "consistency_check": f"""{ROLL}{HEAD}, lines as (
        select 'turnover' as metric, {euro('turnover')} as v, true as told from head2
        union all select 'ggr', {euro('ggr')}, true from head2
        union all select 'margin', {fixed('margin', 2)} || '%', true from head2
        union all select 'slips', {whole('slips')}, true from head2
        union all select 'customers', {whole('customers')}, true from head2
        union all select 'window', span, true from head2
        union all select 'net_revenue', {euro('nr')}, false from head2
        union all select 'legs', format('{{:,}}', count(*)), false from legs)
      select metric, v as recon, case when told then v end as findings, v as facts, true as ok from lines""",
}

RISKS = {
    "price_legs": f"{PRICE} select {n('row_id', 'row_id')}, sel_key, pre_ko from priced",
    "selection_stats": f"""{PRICE} select sel_key, match, market_clean, option_raw, competition, n_legs, n_prices,
        {ds('first_price', 'last_price', 'min_price', 'max_price', 'stake', 'ggr')}, {ts('first_ts', 'first_ts')},
        {ts('last_ts', 'last_ts')}, {ts('kickoff', 'kickoff')}, {d('exposure', 'exposure')}, n_uids, eligible from sel""",
    "selection_exposure": f"{PRICE} select sel_key, {d('exposure', 'exposure')} from sel",
    "eligible_selections": f"{PRICE} select sel_key, n_legs, n_prices from sel where eligible",
    "proxy_clv": f"""{PRICE} select {n('p.row_id', 'row_id')}, p.uid, {d('s.last_price', 'ref_price')},
        {d('p.price / s.last_price - 1', 'proxy_clv')} from pre_ko_legs p join sel s on p.sel_key = s.sel_key where s.eligible""",
    "customer_stats": f"""{RISK} select uid, slips, {ds('stake', 'ggr', 'avg_stake')}, channel, n_units,
        {d('customer_margin', 'customer_margin')} from cust""",
    "win_rate": f"{RISK} select uid, {d('win_rate', 'win_rate')} from cust",
    "phase_shares": f"{RISK} select uid, {ds('lineup_share', 'inplay_share')} from cust",
    "customer_clv": f"{RISK} select uid, {d('clv', 'clv')}, clv_legs from clv",
    "eligible_customers": f"{RISK} select uid, slips, {d('stake', 'stake')} from elig",
    "percentile_components": f"{RISK} select uid, {ds('c_clv', 'c_win', 'c_lineup', 'c_stake', 'c_focus')} from comp",
    "market_focus_hhi": f"{RISK} select uid, {d('hhi', 'hhi')} from focus",
    "top_market_group": f"""{RISK} select f.uid, t.top_group, {d('f.top_group_share', 'top_group_share')}
      from focus f join top_group t on f.uid = t.uid""",
    "sharpness_score": f"{RISK} select uid, score from scored",
    "watchlist": f"""{RISK} select uid, score, slips, {d('stake', 'stake', 2)}, {d('ggr', 'ggr', 2)},
        {d('k_win * 100', 'customer_margin_pct', 1)}, {d('win_rate * 100', 'win_rate_pct', 1)}, {d('k_stake', 'avg_stake', 2)},
        case when clv_legs >= 8 then cast(round(cast(clv * 100 as decimal(28,9)), 2) as double) end as clv_pct, clv_legs,
        {d('k_lineup * 100', 'lineup_share_pct', 1)}, {d('inplay_share * 100', 'inplay_share_pct', 1)},
        coalesce(top_group, '·') as top_group, {d('coalesce(top_group_share, 0) * 100', 'top_group_share_pct', 1)}, channel,
        {d('c_clv', 'component_clv', 3)}, {d('c_win', 'component_win', 3)}, {d('c_lineup', 'component_lineup', 3)},
        {d('c_stake', 'component_stake', 3)}, {d('c_focus', 'component_focus', 3)} from wl""",
    "watch_reasons": f"""{RISK}, shown as (
        select uid, {d('stake', 'stake', 2)}, {d('ggr', 'ggr', 2)}, {d('k_win * 100', 'margin', 1)}, {d('k_stake', 'avg_stake', 2)},
          case when clv_legs >= 8 then cast(round(cast(clv * 100 as decimal(28,9)), 2) as double) end as clv_pct,
          {d('k_lineup * 100', 'lineup', 1)}, top_group, {d('coalesce(top_group_share, 0) * 100', 'top_share', 1)},
          round(c_clv, 3) as c1, round(c_win, 3) as c2, round(c_lineup, 3) as c3, round(c_stake, 3) as c4, round(c_focus, 3) as c5
        from wl),
      parts as (
        select uid, concat_ws('; ',
          case when c1 >= 0.85 and clv_pct is not null then 'consistently beat this flow''s own late prices (proxy CLV '
            || regexp_replace({fixed('clv_pct', 1)}, '\\.0$', '') || '%)' end,
          case when c2 >= 0.85 then 'took €' || {whole('-ggr')} || ' off the book ('
            || regexp_replace({fixed('margin', 1)}, '\\.0$', '') || '% of staked)' end,
          case when c3 >= 0.85 then 'concentrates ' || regexp_replace({fixed('lineup', 1)}, '\\.0$', '')
            || '% of stake in the post-lineups window' end,
          case when c4 >= 0.85 then 'stakes big for this book (avg €' || format('{{:,}}', cast(floor(avg_stake) as bigint))
            || right({fixed('avg_stake', 2)}, 3) || ')' end,
          case when c5 >= 0.85 then 'specialist: ' || {fixed('top_share', 0)} || '% of stake in ' || top_group end
        ) as p from shown)
      select uid, case when p <> '' then p
        else 'high combined percentile across all five components' end || '.' as reason from parts""",
    "risk_assumptions": f"""{RISK} select 5::bigint as sel_min_legs, 15::bigint as uid_min_slips, 150::bigint as uid_min_stake_eur,
        8::bigint as uid_min_clv_legs, 0.3::double as weight_clv, 0.25::double as weight_win, 0.15::double as weight_lineup,
        0.15::double as weight_stake, 0.15::double as weight_focus, (select count(*) from scored) as eligible_customers,
        (select count(*) from sel where eligible) as eligible_selections""",
}

TITLE = "coalesce(option_raw, 'None') || ' (' || market_clean || ') · ' || coalesce(match, 'None')"

RULES = """,
drift as (
  select *, round(last_price / first_price - 1, 9) as change from sel where eligible),
drift_top as (
  select * from drift where abs(change) >= 0.25 and stake >= 250 order by abs(change) desc, sel_key limit 20),
share_of_match as (
  select *, cast(stake as double) / cast(sum(stake) over (partition by match) as double) as fixture_share from sel where eligible),
support as (
  select * from share_of_match where n_uids >= 25 and fixture_share >= 0.18 and stake >= 500 order by stake desc, sel_key limit 20),
expo as (select * from sel where eligible order by exposure desc, sel_key limit 15),
cells as (
  select market_clean, competition, sum(stake_attr) as stake, sum(ggr_attr) as ggr, count(distinct uid) as n_uids
  from legs group by market_clean, competition),
pockets as (
  select *, cast(ggr as double) / cast(stake as double) as margin from cells
  where stake >= 2000 and cast(ggr as double) / cast(stake as double) <= -0.15 order by ggr, market_clean, competition limit 15),
days as (
  select cast(betslip_ts as date) as day, cast(sum(stake_eur) as double) as stake, sum(ggr_eur) as ggr,
    count(distinct uid) as n_uids from slips group by 1),
numbered as (select *, row_number() over (order by day) as rn from days),
based as (
  select a.day, any_value(a.stake) as stake, any_value(a.ggr) as ggr, any_value(a.n_uids) as n_uids, a.rn,
    median(b.stake) as base
  from numbered a join numbered b on b.rn between a.rn - 7 and a.rn - 1 where a.rn > 7 group by a.day, a.rn),
zs as (
  select a.day, any_value(a.stake) as stake, any_value(a.ggr) as ggr, any_value(a.n_uids) as n_uids, any_value(a.base) as base,
    (any_value(a.stake) - any_value(a.base)) / nullif(1.4826e0 * median(abs(b.stake - a.base)), 0) as z
  from based a join numbered b on b.rn between a.rn - 7 and a.rn - 1 group by a.day),
spikes as (select * from zs where z >= 3 and stake >= 10000 order by z desc, day limit 10),
drivers as (
  select day, match as driver, driver_stake from (
    select cast(betslip_ts as date) as day, match, sum(stake_attr) as driver_stake,
      row_number() over (partition by cast(betslip_ts as date) order by sum(stake_attr) desc, match) as place
    from legs where cast(betslip_ts as date) in (select day from spikes) group by 1, 2) where place = 1)
"""
RULES_SQL = PRICE + RULES


def record(kind: str, key: str, title: str, detail: str, metric: str, places: int, source: str) -> str:
    return f"""{RULES_SQL} select '{kind}' as type, {key} as sel_key, {title} as title, {detail} as detail,
        {d('stake', 'stake', 2)}, {d('ggr', 'ggr', 2)}, n_uids, {d(metric, 'metric', places)} from {source}"""


EXPOSURE_DETAIL = (
    f"'potential payout ' || {whole('exposure')} || ' EUR on ' || {whole('stake')} || ' EUR staked pre-KO (' || n_legs"
    f" || ' bets, prices up to ' || {fixed('max_price', 2)} || ')'"
)
ANOMALIES = {
    "price_drift": record(
        "price_drift", "sel_key", TITLE,
        f"'struck price ' || case when change < 0 then 'steamed in' else 'drifted out' end || ': ' || {fixed('first_price', 2)}"
        f" || ' -> ' || {fixed('last_price', 2)} || ' (' || case when change >= 0 then '+' else '' end || {fixed('change * 100', 0)}"
        " || '%) across ' || n_legs || ' bets pre-kickoff'",
        "change * 100", 1, "drift_top",
    ),
    "repeated_support": record(
        "repeated_support", "sel_key", TITLE,
        f"n_uids || ' distinct customers backed the same selection, ' || {fixed('fixture_share * 100', 0)}"
        " || '% of the fixture''s analyzable pre-KO stake'",
        "fixture_share * 100", 1, "support",
    ),
    "exposure": record("exposure", "sel_key", TITLE, EXPOSURE_DETAIL, "exposure", 0, "expo"),
    "negative_pocket": record(
        "negative_pocket", "cast(null as varchar)", "market_clean || ' · ' || competition",
        f"'structural leak: ' || {fixed('margin * 100', 0)} || '% margin on ' || {whole('stake')} || ' EUR stake across '"
        " || n_uids || ' customers'",
        "margin * 100", 1, "pockets",
    ),
    "turnover_spike": record(
        "turnover_spike", "cast(null as varchar)", "strftime(day, '%Y-%m-%d') || ': turnover spike'",
        f"{whole('stake')} || ' EUR staked, ' || {fixed('stake / base', 1)} || 'x the trailing 7-day baseline (' || {whole('base')}"
        f" || ' EUR); led by ' || driver || ' (' || {whole('driver_stake')} || ' EUR)'",
        "stake / base", 1, "(select s.*, r.driver, r.driver_stake from spikes s left join drivers r on s.day = r.day)",
    ),
    "spike_driver": f"{RULES_SQL} select {day('day', 'day')}, driver, {d('driver_stake', 'driver_stake')} from drivers",
    "anomalies": f"""{RULES_SQL}, found as (
        select 'price_drift' as type from drift_top union all select 'repeated_support' from support
        union all select 'exposure' from expo union all select 'negative_pocket' from pockets
        union all select 'turnover_spike' from spikes)
      select type, count(*) as flags from found group by type""",
}


def scaled(field: str, table: str, stake: str, ggr: str, slips: bool = False) -> str:
    count = "count(*) as slips," if slips else ""
    return f"""select {field}, {d('stake', 'stake')}, {d('ggr', 'ggr')}, {'slips,' if slips else ''}
        {d(pct('stake', 'sum(stake) over ()'), 'share')}, {d(pct('ggr', 'stake'), 'margin')}
      from (select {field}, {count} sum({stake}) as stake, sum({ggr}) as ggr from {table} group by {field})"""


SPINE = """,
span as (select min(cast(betslip_ts as date)) as low, max(cast(betslip_ts as date)) as high from slips),
spine as (select cast(unnest(generate_series(low, high, interval '1' day)) as date) as day from span),
flow as (
  select s.day, coalesce(sum(p.stake_eur), 0) as stake, coalesce(sum(p.ggr_eur), 0) as ggr
  from spine s left join slips p on cast(p.betslip_ts as date) = s.day group by s.day),
worst as (select day from flow order by ggr, day limit 1),
peak as (select day from flow order by stake desc, day limit 1)
"""
STAKES = ", stakes as (select uid, sum(stake_eur) as stake from slips group by uid)"


def gini_of(table: str) -> str:
    return f"""(select count(*) as n, coalesce(sum((2 * i - n - 1) * v) / (max(n) * sum(v)), 0) as gini from (
        select cast(stake as double) as v, row_number() over (order by stake) as i, count(*) over () as n from {table}))"""


FINDINGS = {
    "phase_stats": ROLL
    + scaled("phase", "slips", "stake_eur", "ggr_eur", slips=True).replace(
        "from (select", f", cast(list_position({PHASE_ORDER}, phase) as bigint) as ordinal from (select", 1
    ),
    "market_group_stats": ROLL + scaled("market_group", "legs", "stake_attr", "ggr_attr"),
    "channel_stats": ROLL + scaled("channel", "slips", "stake_eur", "ggr_eur"),
    "bet_type_stats": ROLL + scaled("bet_type", "slips", "stake_eur", "ggr_eur"),
    "channel_combined_mix": f"""{ROLL}, mix as (select
        coalesce(sum(stake_eur) filter (where channel = 'retail' and bet_type = 'COMBINED'), 0) as rc,
        coalesce(sum(stake_eur) filter (where channel = 'retail'), 0) as r,
        coalesce(sum(stake_eur) filter (where channel = 'online' and bet_type = 'COMBINED'), 0) as oc,
        coalesce(sum(stake_eur) filter (where channel = 'online'), 0) as o from slips)
      select {d(pct('rc', 'greatest(r, 1)'), 'retail_share')}, {d(pct('oc', 'greatest(o, 1)'), 'online_share')} from mix""",
    "daily_flow": f"""{ROLL}{SPINE} select {day('day', 'day')}, {ds('stake', 'ggr')},
        day = (select day from peak) as is_peak, day = (select day from worst) as is_worst from flow""",
    "worst_day_fixtures": f"""{ROLL}{SPINE} select match, {d('ggr', 'ggr')} from (
        select match, sum(ggr_attr) as ggr from legs where cast(betslip_ts as date) = (select day from worst)
        group by match order by ggr, match limit 3)""",
    "star_share": f"""{ROLL}, s as (select sum(stake_attr) filter (where star_substitute) as a, sum(stake_attr) as b,
        sum(ggr_attr) filter (where star_substitute) as g from legs)
      select {d('a', 'star_stake')}, {d(pct('a', 'b'), 'star_share')}, {d('g', 'star_ggr')} from s""",
    "core_product_share": f"""{ROLL}, s as (select sum(stake_attr) filter (where market_group in
        ('Player props', 'Goalscorer props', 'BetBuilder')) as a, sum(stake_attr) as b from legs)
      select {d(pct('a', 'b'), 'core_share')} from s""",
    "market_prefix_pocket": f"""{ROLL} select {d('coalesce(sum(stake_attr), 0)', 'stake')}, {d('coalesce(sum(ggr_attr), 0)', 'ggr')}
      from legs where starts_with(market_clean, 'To score 2 or more goals')""",
    "top10_customer_share": f"""{ROLL}{STAKES}, t as (
        select sum(stake) as s from (select stake from stakes order by stake desc, uid limit 10))
      select {d('s', 'top10_stake')}, {d(pct('s', '(select sum(stake) from stakes)'), 'top10_share')} from t""",
    "customer_gini": f"{ROLL}{STAKES} select n, {d('gini', 'gini')} from {gini_of('stakes')}",
    "watchlist_digest": f"""{RISK} select
        {d('coalesce(sum(cast(round(ggr, 2) as decimal(18,2))) filter (where place <= 10), 0)', 'top10_ggr')},
        count(*) filter (where place <= 20 and clv_legs >= 8 and round(cast(clv * 100 as decimal(28,9)), 2) > 2) as positive_clv
      from wl""",
    "costliest_exposure": record("exposure", "sel_key", TITLE, EXPOSURE_DETAIL, "exposure", 0, "expo")
    + " order by round(ggr, 2), sel_key limit 1",
    "late_bets": f"""{ROLL} select count(*) as slips, {d('coalesce(sum(stake_eur), 0)', 'stake')} from slips
      where lead_minutes < -130""",
    "fixture_merge_counts": f"""{ROLL}, c as (select match_id, match, cast(event_ts - interval '6' hour as date) as day from legs
        where match_id is not null and match is not null and event_ts is not null)
      select (select count(distinct match_id) from c) as match_ids,
        (select count(*) from (select distinct match, day from c)) as fixtures""",
    "billing_tiers": f"""{ROLL} select rate, count(*) as slips from (
        select {d('cast(net_revenue_eur as double) / cast(ggr_eur as double)', 'rate', 4)} from slips where ggr_eur <> 0)
      where rate is not null group by rate order by slips desc, rate limit 2""",
    "combined_composition": f"""{ROLL}, k as (select case when n_matches >= 2 then 'cross-game' when n_legs = 1 then 'single-leg'
          when n_matches = 1 then 'same-game' end as kind, stake_eur, ggr_eur from slips where bet_type = 'COMBINED')
      select kind, count(*) as slips, {d(pct('sum(stake_eur)', '(select sum(stake_eur) from slips)'), 'stake_share')},
        {d(pct('sum(ggr_eur)', 'sum(stake_eur)'), 'margin')} from k where kind is not null group by kind""",
    "repeated_selection_share": f"""{ROLL}, per as (select slip_id,
          count(distinct struct_pack(a := match_id, b := market_raw, c := option_raw, d := price)) as k
        from legs where bet_type = 'COMBINED' and n_legs >= 2 and n_matches = 1 group by slip_id)
      select count(*) as same_game_slips, count(*) filter (where k = 1) as repeated_slips,
        {d(pct('count(*) filter (where k = 1)', 'count(*)'), 'repeated_share')} from per""",
}

FILTERED = """,
kept as (select * from slips where betslip_ts >= timestamp '2026-06-05' and betslip_ts < timestamp '2026-06-13'
  and phase in ('day-of pre-match', 'in-play') and channel in ('online', 'retail') and currency in ('EUR', 'PEN')),
hit as (select distinct slip_id from legs where market_group = 'Goalscorer props' and competition = '2026 FIFA World Cup')
"""


def spine_of(labels_: list[str], unit: str) -> str:
    names = ", ".join(f"'{x}'" for x in labels_)
    return f""",
grid as (
  select b.bucket, n.name from
    (select unnest(generate_series(date_trunc('{unit}', min(betslip_ts)), date_trunc('{unit}', max(betslip_ts)),
      interval '1' {unit})) as bucket from slips) b,
    (select unnest([{names}]) as name) n)"""


def series_of(split: str, labels_: list[str], unit: str, value: str) -> str:
    return f"""{ROLL}{spine_of(labels_, unit)},
vals as (select date_trunc('{unit}', betslip_ts) as bucket, {split} as name, {value} as value from slips group by 1, 2),
filled as (select g.bucket, g.name, coalesce(v.value, 0) as value from grid g
  left join vals v on g.bucket = v.bucket and g.name = v.name),
shown as (select bucket, name, {d('value', 'value', 2)} from filled)
"""


KEEP = "select {ts}, name, value from shown where name in (select name from shown where value <> 0)"
PHASES = ["early pre-match", "day-of pre-match", "post-lineups (proxy)", "in-play"]
CHANNELS = ["online", "retail", "tpv"]

CONC = "{d1}, {d2}, n, customers"


def conc(table: str, key: str, stake: str, ggr: str) -> str:
    return f"""(select {key} as key, sum({stake}) as stake, sum({ggr}) as ggr, count(*) as n, count(distinct uid) as customers
      from {table} where {key} is not null group by 1)"""


SEL_KEY = "coalesce(match, '?') || ' · ' || market_clean || ' · ' || coalesce(option_raw, '')"
LINE_KEY = "case when line >= 0 then market_clean || ' @ ' || regexp_replace(cast(line as varchar), '\\.0$', '') end"
UID_CONC = conc("slips", "uid", "stake_eur", "ggr_eur")
SEL_CONC = conc("legs", SEL_KEY, "stake_attr", "ggr_attr")
PLAYER_CONC = conc("legs", "nullif(entity_player, '')", "stake_attr", "ggr_attr")


def conc_rows(inner: str) -> str:
    return f"{ROLL} select key, {ds('stake', 'ggr')}, n, customers from {inner}"


def top_share(inner: str) -> str:
    return f"""{ROLL}, rows as {inner} select row_number() over (order by stake desc, key) as place, key,
        {d('stake', 'stake')}, {d(pct('stake', '(select sum(stake) from rows)'), 'share')},
        {d(pct('sum(stake) over (order by stake desc, key rows unbounded preceding)', '(select sum(stake) from rows)'), 'running_share')}
      from rows order by stake desc, key limit 25"""


def totals_where(condition: str) -> str:
    return f"""{FIX} select count(*) as slips, {d('coalesce(sum(stake_eur), 0)', 'stake')}, {d('coalesce(sum(ggr_eur), 0)', 'ggr')},
        {d('coalesce(sum(net_revenue_eur), 0)', 'net_revenue')}, count(distinct uid) as customers,
        {d('coalesce(cast(sum(stake_eur) as double) / count(*), 0)', 'avg_stake')}, {d(pct('sum(ggr_eur)', 'sum(stake_eur)'), 'margin_pct')}
      from slips where {condition}"""


def with_leg(condition: str) -> str:
    return totals_where(f"slip_id in (select slip_id from fl where {condition})")


EXPLORE = {
    "filter_by_fixture": with_leg("fixture = 'Team1 - Side4' and fixture_day = date '2026-06-12'"),
    "filter_by_team": with_leg("entity_team = 'Team3'"),
    "filter_by_player": with_leg("entity_player = 'Player 7'"),
    "filter_by_match": with_leg("match_id in (60302, 61002)"),
    "filter_by_market": with_leg("market_clean = 'Anytime goalscorer [Star Sub]'"),
    "filter_by_customer": totals_where("uid in ('36', '139')"),
    "filter_by_unit": totals_where("unit = 'UNIT PORTUGAL'"),
    "filter_by_bet_type": totals_where("bet_type = 'COMBINED'"),
    "filter_slips": f"{ROLL}{FILTERED} select slip_id, uid, {d('stake_eur', 'stake_eur')} from kept",
    "filter_by_legs": f"""{ROLL}{FILTERED} select slip_id, {d('stake_eur', 'stake_eur')} from slips
      where slip_id in (select slip_id from hit)""",
    "filter_legs": f"""{ROLL}{FILTERED} select {n('row_id', 'row_id')}, slip_id from legs
      where slip_id in (select slip_id from hit)""",
    "totals": f"""{ROLL}{FILTERED} select count(*) as slips, {d('sum(stake_eur)', 'stake')}, {d('sum(ggr_eur)', 'ggr')},
        {d('sum(net_revenue_eur)', 'net_revenue')}, count(distinct uid) as customers,
        {d('cast(sum(stake_eur) as double) / count(*)', 'avg_stake')}, {d(pct('sum(ggr_eur)', 'sum(stake_eur)'), 'margin_pct')}
      from kept""",
    "share_of_total": f"""{ROLL}{FILTERED} select
        {d(pct('(select sum(stake_eur) from kept)', '(select sum(stake_eur) from slips)'), 'stake_pct')},
        {d(pct('(select sum(ggr_eur) from kept)', '(select sum(ggr_eur) from slips)'), 'ggr_pct')}""",
    "group_by_slip_field": f"""{ROLL} select unit, count(*) as slips, {d('sum(stake_eur)', 'stake')}, {d('sum(ggr_eur)', 'ggr')},
        count(distinct uid) as customers, {d(pct('sum(stake_eur)', '(select sum(stake_eur) from slips)'), 'share')},
        {d(pct('sum(ggr_eur)', 'sum(stake_eur)'), 'margin')} from slips group by unit""",
    "competition_breakdown": f"""{ROLL} select first_competition as competition, count(*) as slips, {d('sum(stake_eur)', 'stake')},
        {d('sum(ggr_eur)', 'ggr')}, count(distinct uid) as customers, {d(pct('sum(ggr_eur)', 'sum(stake_eur)'), 'margin')}
      from slips where first_competition is not null group by 1 order by sum(stake_eur) desc, 1 limit 6""",
    "time_series": series_of("phase", PHASES, "day", "cast(sum(stake_eur) as double)") + KEEP.format(ts=ts("bucket", "bucket")),
    "time_series_hourly": series_of("channel", CHANNELS, "hour", "count(distinct uid)") + KEEP.format(ts=ts("bucket", "bucket")),
    "time_series_avg": series_of("bet_type", ["SIMPLE", "COMBINED"], "day", "cast(sum(stake_eur) as double) / count(*)")
    + KEEP.format(ts=ts("bucket", "bucket")),
    "time_series_ggr": series_of("'total'", ["total"], "day", "cast(sum(ggr_eur) as double)")
    + KEEP.format(ts=ts("bucket", "bucket")),
    "time_series_slips": series_of("bet_type", ["SIMPLE", "COMBINED"], "hour", "count(*)") + KEEP.format(ts=ts("bucket", "bucket")),
    "series_totals": series_of("channel", CHANNELS, "day", "count(distinct uid)")
    + f"select {ts('bucket', 'bucket')}, {d('sum(value)', 'sum_over_groups')} from filled group by filled.bucket",
    "fixture_groups": f"{FIX} select name, {day('day', 'day')}, competition, {ts('kickoff', 'kickoff')}, match_ids from fx",
    "fixture_slips": f"""{FIX} select slip_id, uid, {ts('betslip_ts', 'betslip_ts')}, phase,
        {ds('slip_stake_eur', 'slip_ggr_eur')} from fs""",
    "fixture_table": f"""{FIX} select name, {day('day', 'day')}, competition, {ts('kickoff', 'kickoff')}, slips,
        {ds('stake', 'ggr')}, customers, {d('cast(inplay as double) / cast(stake as double)', 'inplay_share')} from fxt""",
    "fixture_search": f"""{FIX} select name, {day('day', 'day')}, competition, {ts('kickoff', 'kickoff')}, slips,
        {ds('stake', 'ggr')}, customers, {d('cast(inplay as double) / cast(stake as double)', 'inplay_share')}
      from (select * from fxt where contains(lower(name), 'side4') order by stake desc, name, day limit 15)""",
    "fixture_flow": f"""{FIX}, ko as (select kickoff from fx where name = 'Team1 - Side4' and day = date '2026-06-12'),
      rel as (select phase, slip_stake_eur, (epoch(betslip_ts) - epoch((select kickoff from ko))) / 60e0 as m from fs),
      binned as (select phase, cast(floor((m + 4320) / 30) * 30 - 4320 as bigint) as bin, sum(slip_stake_eur) as stake
        from rel where m >= -4320 and m < 150 group by 1, 2),
      grid as (select b.bin, p.phase from (select unnest(range(-4320, 150, 30)) as bin) b,
        (select unnest({PHASE_ORDER}) as phase) p),
      shown as (select g.phase, g.bin, cast(round(coalesce(b.stake, 0), 2) as double) as stake from grid g
        left join binned b on g.bin = b.bin and g.phase = b.phase)
      select phase, bin, stake from shown where phase in (select phase from shown where stake <> 0)""",
    "fixture_detail": f"""{FIX} select {d('sum(slip_stake_eur)', 'stake')}, {d('sum(slip_ggr_eur)', 'ggr')}, count(*) as slips,
        count(distinct uid) as customers from fs""",
    "concentrate_slip": conc_rows(UID_CONC),
    "concentrate_leg": conc_rows(SEL_CONC),
    "concentrate_slip_unit": conc_rows(conc("slips", "unit", "stake_eur", "ggr_eur")),
    "concentrate_slip_channel": conc_rows(conc("slips", "channel", "stake_eur", "ggr_eur")),
    "concentrate_slip_bet_type": conc_rows(conc("slips", "bet_type", "stake_eur", "ggr_eur")),
    "concentrate_leg_competition": conc_rows(conc("legs", "competition", "stake_attr", "ggr_attr")),
    "concentrate_leg_market_group": conc_rows(conc("legs", "market_group", "stake_attr", "ggr_attr")),
    "concentrate_leg_market": conc_rows(conc("legs", "market_clean", "stake_attr", "ggr_attr")),
    "concentrate_leg_player": conc_rows(PLAYER_CONC),
    "concentrate_line": conc_rows(conc("legs", LINE_KEY, "stake_attr", "ggr_attr")),
    "concentrate_team": conc_rows(conc("legs", "nullif(entity_team, '')", "stake_attr", "ggr_attr")),
    "top_n_share": top_share(PLAYER_CONC),
    "top_n_share_selection": top_share(SEL_CONC),
    "top10_share": f"""{ROLL}, rows as {UID_CONC} select
        {d(pct('(select sum(stake) from (select stake from rows order by stake desc, key limit 10))', '(select sum(stake) from rows)'), 'top10_share')}""",
    "lorenz": f"""{ROLL}, v as (select row_number() over (order by stake) as i, count(*) over () as n, stake,
          sum(stake) over (order by stake rows unbounded preceding) as cum, sum(stake) over () as tot
        from {UID_CONC} where stake > 0)
      select 0::bigint as point, 0::double as x, 0::double as y
      union all select i, {d('cast(i as double) / n', 'x')}, {d('cast(cum as double) / cast(tot as double)', 'y')} from v
      where (i - 1) % greatest(1, n // 200) = 0 or i = n""",
    "gini": f"""{ROLL}, rows as (select stake from {SEL_CONC} where stake > 0) select n, {d('gini', 'gini')},
        case when gini < 0.35 then 'money is spread evenly' when gini < 0.6 then 'moderately concentrated'
          else 'a few Selections dominate' end as reading from {gini_of('rows')}""",
    "drill_rows": f"""{ROLL} select {n('row_id', 'row_id')}, {ts('betslip_ts', 'betslip_ts')}, uid, slip_unit as unit, match,
        market_clean as market, coalesce(option_raw, '') as option, {d('price', 'price')}, {d('slip_stake_eur', 'slip_stake')},
        {d('slip_ggr_eur', 'slip_ggr')}, phase, bet_type
      from legs where market_group = 'Team stats' order by legs.slip_stake_eur desc, legs.row_id limit 400""",
    "drill_total": f"{ROLL} select count(*) as total from legs where market_group = 'Team stats'",
    "price_trace": f"""{ROLL}, s as (select * from legs where match = 'Team1 - Side4' and market_clean = 'Nth goal scorer'
          and option_raw = 'Player 0'),
      k as (select arg_max(event_ts, row_id) as kickoff from s),
      r as (select price from s where price > 1.01 and (betslip_ts < (select kickoff from k) or (select kickoff from k) is null)
        order by betslip_ts desc, row_id desc limit 1)
      select {n('row_id', 'row_id')}, {ts('betslip_ts', 'betslip_ts')}, {d('price', 'price')},
        {ts('(select kickoff from k)', 'kickoff')}, {d('(select price from r)', 'ref_price')} from s where price > 1.01""",
}

ORACLES: dict[str, str] = {
    **SOURCES, **RECONCILE, **NORMALISE, **ROLLUP, **FACTS, **RISKS, **ANOMALIES, **FINDINGS, **EXPLORE,
}
