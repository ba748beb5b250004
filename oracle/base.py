"""Shared CTEs of the oracle SQL: bound legs, normalised legs, slips.

Plain SQL for DuckDB, written apart from the DataFrame code. ``LEGS`` and
``SLIPS`` are cut to the data window; ``nl`` and ``slips_all`` are not.
"""

from slipstream.sources.binding import BINDING

NORMALIZED = """,
pre as (
  select *, src_row as row_id,
    trim(regexp_replace(market_raw, '\\s*\\(Star Substitute\\)\\s*', '', 'gi')) as base,
    regexp_matches(market_raw, '\\(star substitute\\)', 'i') as tagged,
    case when strpos(match, ' - ') > 0 then trim(substr(match, 1, strpos(match, ' - ') - 1)) else '' end as home,
    case when strpos(match, ' - ') > 0 then trim(substr(match, strpos(match, ' - ') + 3)) else '' end as away,
    coalesce(currency_raw, case when contains(replace(upper(unit), 'Ú', 'U'), 'PERU') then 'PEN' else 'EUR' end) as currency,
    currency_raw is null as currency_inferred
  from bound),
named as (
  select *,
    case market_raw
      when '{COMPETITOR1}' then 'Team BetBuilder (home)' when '{COMPETITOR2}' then 'Team BetBuilder (away)'
      when 'Match' then 'Match BetBuilder' when '1-X-2 / 2 goals Up' then '1X2 (2-goal cushion)'
      when '{goalnr}{ordinal} goal scorer' then 'Nth goal scorer'
      when '{CARDNR}st player to be booked' then 'Nth player booked'
      when 'Goles durante el partido' then 'Match goals'
      else (case when contains(lower(base), '{player1} vs {player2}') then 'Player duel: ' || trim(split_part(base, '-', 1))
                 when contains(lower(base), '{player}') then trim(replace(base, '{PLAYER}', '(player)'))
                 else base end) || (case when tagged then ' [Star Sub]' else '' end)
    end as market_clean,
    case
      when market_raw in ('{COMPETITOR1}', '{COMPETITOR2}', 'Match') then 'BetBuilder'
      when market_raw = '1-X-2 / 2 goals Up' then 'Enhanced 1X2'
      when market_raw = '{goalnr}{ordinal} goal scorer' then 'Goalscorer props'
      when market_raw = '{CARDNR}st player to be booked' then 'Player props'
      when market_raw = 'Goles durante el partido' then 'Match stats'
      when regexp_matches(base, '\\{player1\\} vs \\{player2\\}|\\{player\\}', 'i') then 'Player props'
      when regexp_matches(base, 'goalscorer|goal scorer|to score|hat trick|score a header|score from outside|score or assist|score and assist|first to score|anytime not to score', 'i') then 'Goalscorer props'
      when regexp_matches(base, '\\{player\\}|player |most passes|most fouls|most tackles|to be carded|to be booked|sent off|to miss a penalty|first foul|first to be fouled', 'i') then 'Player props'
      when regexp_matches(base, '^team|^1st half: team|^2nd half: team| team', 'i') then 'Team stats'
      when regexp_matches(base, '^match|^1st half|^2nd half|^corners', 'i') then 'Match stats'
      else 'Other'
    end as market_group,
    coalesce(contains(lower(market_raw), 'star substitute'), false) as star_substitute,
    case currency when 'EUR' then 1e0 when 'PEN' then 1e0/3.90e0 when 'USD' then 1e0/1.138e0 end as rate,
    case when starts_with(uid, 'TPV') then 'tpv' when starts_with(uid, 'MAH-') then 'retail' else 'online' end as channel,
    case when contains(unit, 'PORTUGAL') then 'Portugal'
         when contains(replace(upper(unit), 'Ú', 'U'), 'PERU') then 'Peru' else 'Spain' end as unit_country
  from pre),
nl as (
  select *,
    case when market_group = 'Team stats' then
           (case when home <> '' and starts_with(option_raw, home) then home
                 when away <> '' and starts_with(option_raw, away) then away end)
         when market_raw = '{COMPETITOR1}' then home when market_raw = '{COMPETITOR2}' then away end as entity_team,
    case when (market_group = 'Goalscorer props'
               or regexp_matches(market_clean, 'most passes|most fouls|most tackles|player to|to be carded|to be booked|sent off|nth player booked', 'i'))
          and not regexp_matches(option_raw, '^\\d|^Over|^Under') then option_raw end as entity_player,
    cast(coalesce(nullif(regexp_extract(option_raw, '(\\d+(?:\\.\\d+)?)\\s*or more|over\\s*(\\d+(?:\\.\\d+)?)|under\\s*(\\d+(?:\\.\\d+)?)', 1, 'i'), ''),
                  nullif(regexp_extract(option_raw, '(\\d+(?:\\.\\d+)?)\\s*or more|over\\s*(\\d+(?:\\.\\d+)?)|under\\s*(\\d+(?:\\.\\d+)?)', 2, 'i'), ''),
                  nullif(regexp_extract(option_raw, '(\\d+(?:\\.\\d+)?)\\s*or more|over\\s*(\\d+(?:\\.\\d+)?)|under\\s*(\\d+(?:\\.\\d+)?)', 3, 'i'), '')) as double) as line,
    cast(stake * rate as decimal(18,6)) as stake_eur, cast(ggr * rate as decimal(18,6)) as ggr_eur,
    cast(net_revenue * rate as decimal(18,6)) as net_revenue_eur
  from named)
"""

ROLLED = """,
keyed as (
  select *, case when bet_type = 'COMBINED'
      then 'C' || cast(min(row_id) over (partition by bet_type, uid, betslip_ts, stake, ggr, net_revenue) as varchar)
      else 'S' || cast(row_id as varchar) end as slip_id
  from nl),
slips0 as (
  select slip_id, arg_min(uid, row_id) as uid, arg_min(betslip_ts, row_id) as betslip_ts,
    arg_min(bet_type, row_id) as bet_type, arg_min(unit, row_id) as unit, arg_min(unit_country, row_id) as unit_country,
    arg_min(channel, row_id) as channel, arg_min(currency, row_id) as currency,
    arg_min(currency_inferred, row_id) as currency_inferred, arg_min(source, row_id) as source,
    arg_min(stake, row_id) as stake, arg_min(ggr, row_id) as ggr, arg_min(net_revenue, row_id) as net_revenue,
    arg_min(stake_eur, row_id) as stake_eur, arg_min(ggr_eur, row_id) as ggr_eur,
    arg_min(net_revenue_eur, row_id) as net_revenue_eur, count(*) as n_legs,
    count(distinct match_id) as n_matches, count(distinct competition) as competitions,
    min(event_ts) as first_event_ts, max(event_ts) as last_event_ts,
    coalesce(product(price), 1e0) as price, min(row_id) as first_row,
    arg_min(competition, row_id) as first_competition
  from (select *, 'A' as source from keyed) group by slip_id),
slips1 as (
  select *, (epoch(first_event_ts) - epoch(betslip_ts)) / 60e0 as lead_minutes from slips0),
slips_all as (
  select *, case when lead_minutes is null then 'early pre-match' when lead_minutes < 0 then 'in-play'
      when lead_minutes <= 60 then 'post-lineups (proxy)' when lead_minutes <= 1440 then 'day-of pre-match'
      else 'early pre-match' end as phase
  from slips1),
slips as (select * from slips_all where betslip_ts >= timestamp '2026-06-01'),
legs as (
  select k.*, s.n_legs, s.n_matches, s.phase, s.unit as slip_unit, s.currency as slip_currency,
    s.stake_eur as slip_stake_eur, s.ggr_eur as slip_ggr_eur,
    cast(sign(s.stake_eur) * ((2 * cast(abs(s.stake_eur) * 1000000 as bigint) + s.n_legs) // (2 * s.n_legs)) / 1000000e0 as decimal(18,6)) as stake_attr,
    cast(sign(s.ggr_eur) * ((2 * cast(abs(s.ggr_eur) * 1000000 as bigint) + s.n_legs) // (2 * s.n_legs)) / 1000000e0 as decimal(18,6)) as ggr_attr
  from keyed k join slips s on k.slip_id = s.slip_id)
"""

PULLS = """,
a0 as (select sport, competition, match_id, match, event_ts, market_raw, bet_type, player_raw, option_raw, betslip_ts,
    uid, unit, price, stake, case when ok % 2 = 0 then stake else ggr end as ggr, net_revenue, currency_raw, src_row,
    'A' as source from bound where betslip_ts < timestamp '2026-06-21'),
b0 as (select sport, competition, match_id, match, event_ts, market_raw, bet_type, player_raw, option_raw, betslip_ts,
    uid, unit, price, stake, ggr, net_revenue, currency_raw, src_row, 'B' as source
    from bound where betslip_ts >= timestamp '2026-06-20'),
both_pulls as (select * from a0 union all select * from b0),
occ as (select *, row_number() over (partition by source, uid, betslip_ts, match_id, market_raw, player_raw, option_raw,
    bet_type, price, stake order by src_row) - 1 as occurrence from both_pulls),
oa as (select * from occ where source = 'A'),
ob as (select * from occ where source = 'B'),
shared as (select oa.*, ob.ggr as new_ggr, ob.net_revenue as new_net from oa join ob
  on oa.uid is not distinct from ob.uid and oa.betslip_ts is not distinct from ob.betslip_ts
  and oa.match_id is not distinct from ob.match_id and oa.market_raw is not distinct from ob.market_raw
  and oa.player_raw is not distinct from ob.player_raw and oa.option_raw is not distinct from ob.option_raw
  and oa.bet_type is not distinct from ob.bet_type and oa.price is not distinct from ob.price
  and oa.stake is not distinct from ob.stake and oa.occurrence = ob.occurrence),
settled as (select sport, competition, match_id, match, event_ts, market_raw, bet_type, player_raw, option_raw,
    betslip_ts, uid, unit, price, stake, new_ggr as ggr, new_net as net_revenue, currency_raw, src_row, source from shared
  union all
  select sport, competition, match_id, match, event_ts, market_raw, bet_type, player_raw, option_raw,
    betslip_ts, uid, unit, price, stake, ggr, net_revenue, currency_raw, src_row, source from oa
  where src_row not in (select src_row from shared)),
merged as (select * from settled union all
  select sport, competition, match_id, match, event_ts, market_raw, bet_type, player_raw, option_raw,
    betslip_ts, uid, unit, price, stake, ggr, net_revenue, currency_raw, src_row, source from ob
  where not exists (select 1 from shared s where ob.uid is not distinct from s.uid
    and ob.betslip_ts is not distinct from s.betslip_ts and ob.match_id is not distinct from s.match_id
    and ob.market_raw is not distinct from s.market_raw and ob.player_raw is not distinct from s.player_raw
    and ob.option_raw is not distinct from s.option_raw and ob.bet_type is not distinct from s.bet_type
    and ob.price is not distinct from s.price and ob.stake is not distinct from s.stake
    and ob.occurrence = s.occurrence))
"""

# Price analytics on top of ROLLED.
PRICED = """,
priced as (
  select *, coalesce(match, '?') || ' · ' || market_clean || ' · ' || coalesce(option_raw, '?') as sel_key,
    betslip_ts < event_ts as pre_ko
  from legs where price > 1.01e0 and event_ts is not null and betslip_ts is not null),
pre_ko_legs as (select * from priced where pre_ko and sel_key is not null),
ranked_prices as (
  select *, row_number() over (partition by sel_key order by betslip_ts, row_id) as nth,
    row_number() over (partition by sel_key order by betslip_ts desc, row_id desc) as nth_back
  from pre_ko_legs),
sel as (
  select sel_key, min(match) as match, min(market_clean) as market_clean, min(option_raw) as option_raw,
    max(case when nth = 1 then competition end) as competition,
    count(*) as n_legs, count(distinct uid) as n_uids, count(distinct price) as n_prices,
    max(case when nth = 1 then price end) as first_price, max(case when nth_back = 1 then price end) as last_price,
    min(price) as min_price, max(price) as max_price, sum(stake_attr) as stake, sum(ggr_attr) as ggr,
    min(betslip_ts) as first_ts, max(betslip_ts) as last_ts, max(case when nth = 1 then event_ts end) as kickoff,
    sum(stake_attr * (cast(price as decimal(18,6)) - 1)) as exposure,
    count(*) >= 5 and count(distinct price) >= 2 as eligible
  from ranked_prices group by sel_key)
"""

CUSTOMERS = """,
clv_legs as (
  select p.*, p.price / s.last_price - 1 as proxy_clv from pre_ko_legs p join sel s on p.sel_key = s.sel_key where s.eligible),
clv as (
  select uid, cast(sum(cast(proxy_clv * greatest(cast(stake_attr as double), 0.01e0) as decimal(28,12))) as double)
      / cast(sum(cast(greatest(cast(stake_attr as double), 0.01e0) as decimal(28,12))) as double) as clv,
    count(*) as clv_legs
  from clv_legs group by uid),
cust0 as (
  select uid, count(*) as slips, sum(stake_eur) as stake, sum(ggr_eur) as ggr, count(distinct unit) as n_units,
    min(channel) as channel, count(*) filter (where ggr_eur < 0) as won,
    coalesce(sum(stake_eur) filter (where phase = 'post-lineups (proxy)'), 0) as lineup_stake,
    coalesce(sum(stake_eur) filter (where phase = 'in-play'), 0) as inplay_stake
  from slips group by uid),
cust as (
  select *, cast(stake as double) / slips as avg_stake,
    case when stake > 0 then -(cast(ggr as double) / cast(stake as double)) else 0 end as customer_margin,
    cast(won as double) / slips as win_rate,
    case when stake <> 0 then cast(lineup_stake as double) / cast(stake as double) end as lineup_share,
    case when stake <> 0 then cast(inplay_stake as double) / cast(stake as double) end as inplay_share
  from cust0),
group_share as (
  select uid, market_group, cast(gs as double) / cast(sum(gs) over (partition by uid) as double) as share
  from (select uid, market_group, sum(stake_attr) as gs from legs group by uid, market_group)),
focus as (
  select uid, cast(sum(cast(share * share as decimal(18,12))) as double) as hhi, max(share) as top_group_share
  from group_share group by uid),
top_group as (
  select uid, market_group as top_group from (
    select *, row_number() over (partition by uid order by share desc, market_group) as place from group_share)
  where place = 1),
elig0 as (
  select c.*, coalesce(v.clv_legs, 0) as clv_legs, round(v.clv, 9) as clv, coalesce(f.hhi, 0) as hhi0,
    f.top_group_share, t.top_group
  from cust c left join clv v on c.uid = v.uid left join focus f on c.uid = f.uid left join top_group t on c.uid = t.uid
  where c.slips >= 15 and c.stake >= 150),
elig as (
  select *, round(hhi0, 9) as hhi, round(customer_margin, 9) as k_win, round(lineup_share, 9) as k_lineup,
    round(avg_stake, 9) as k_stake
  from elig0),
pct as (
  select *,
    case when clv is not null then (rank() over (partition by clv is null order by clv) + (count(*) over (partition by clv) - 1) / 2e0)
      / count(clv) over () end as p_clv,
    (rank() over (order by k_win) + (count(*) over (partition by k_win) - 1) / 2e0) / count(*) over () as p_win,
    case when k_lineup is not null then (rank() over (partition by k_lineup is null order by k_lineup)
      + (count(*) over (partition by k_lineup) - 1) / 2e0) / count(k_lineup) over () end as p_lineup,
    (rank() over (order by k_stake) + (count(*) over (partition by k_stake) - 1) / 2e0) / count(*) over () as p_stake,
    (rank() over (order by hhi) + (count(*) over (partition by hhi) - 1) / 2e0) / count(*) over () as p_focus
  from elig),
comp as (
  select *, case when clv_legs < 8 then 0.5e0 else coalesce(p_clv, 0.5e0) end as c_clv, p_win as c_win,
    coalesce(p_lineup, 0.5e0) as c_lineup, p_stake as c_stake, p_focus as c_focus
  from pct),
scored as (
  select *, cast(round(cast(100 * (0.30e0*c_clv + 0.25e0*c_win + 0.15e0*c_lineup + 0.15e0*c_stake + 0.15e0*c_focus)
      as decimal(28,9)), 1) as double) as score
  from comp),
wl as (
  select *, row_number() over (order by score desc, uid) as place from scored
  qualify place <= 60)
"""


def chain(*parts: str) -> str:
    """The binding, then the given CTE blocks."""
    return BINDING.rstrip() + "".join(p.rstrip() for p in parts) + "\n"


BOUND = chain()
NORM = chain(NORMALIZED)
ROLL = chain(NORMALIZED, ROLLED)
PULL = chain(PULLS)
PRICE = chain(NORMALIZED, ROLLED, PRICED)
RISK = chain(NORMALIZED, ROLLED, PRICED, CUSTOMERS)
