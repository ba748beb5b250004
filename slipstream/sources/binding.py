"""Legs made from the lineitem, orders and customer tables.

Deterministic, and in integer arithmetic for money, so the same text gives the
same rows in Spark and in DuckDB. It stands in for real exports in tests,
benchmarks and registered queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slipstream.schema import LEG_SCHEMA

SEAM_START = "2026-06-20"
SEAM_END = "2026-06-21"

BINDING = """
with base as (
  select l.*, o.o_custkey, o.o_orderkey ok, o.o_totalprice tp, o.o_orderstatus os, c.c_nationkey nk,
    l.l_orderkey * 1000 + row_number() over (partition by l.l_orderkey order by l.l_linenumber, l.l_partkey,
      l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus,
      l.l_shipdate) src_row,
    case when o.o_orderkey % 3 = 0 then 'COMBINED' else 'SIMPLE' end bet_type,
    case when o.o_orderkey % 17 = 0 then 0 else l.l_partkey % 13 end mk,
    timestamp '2026-05-29 10:00:00' + cast((o.o_orderkey * 7919) % 36000 as int) * interval '1' minute bts0
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey),
b2 as (
  select *, case when bet_type = 'COMBINED' then bts0
      else bts0 + cast(l_linenumber as int) * interval '1' minute end bts,
    cast(l_suppkey % 6 as int) slot, cast((l_suppkey % 5) % 3 as int) dayoff
  from base),
b3 as (
  select *, date_trunc('day', bts) + dayoff * interval '1' day + (13*60 + slot*150) * interval '1' minute kick
  from b2),
b4 as (
  select *, case when bts >= kick then 1 else 0 end inplay,
    'Team' || cast(slot as string) || ' - Side' || cast(cast(date_part('day', kick) as int) % 8 as string) mname,
    cast(date_part('day', kick) as int)*100 + cast(date_part('month', kick) as int)*10000 + slot*2 mid0,
    cast((case when l_partkey % 9 < 4 then 0 else l_partkey % 9 end) as string) who
  from b3),
b5 as (
  select 'Football' sport, case when slot < 5 then '2026 FIFA World Cup' else 'Test Cup' end competition,
    cast(mid0 + inplay as bigint) match_id, mname as match, case when ok % 211 = 0 then null else kick end event_ts,
    case mk when 0 then 'Anytime goalscorer (Star Substitute)' when 1 then '{COMPETITOR1}'
      when 2 then '{COMPETITOR2}' when 3 then 'Match' when 4 then '1-X-2 / 2 goals Up'
      when 5 then 'To score 2 or more goals' when 6 then 'Shots on target {PLAYER} (Star Substitute)'
      when 7 then 'Player most passes (voiding in case of tie)' when 8 then 'Team corners'
      when 9 then 'Match corners' when 10 then 'Most Saves - {PLAYER1} vs {PLAYER2} (both starters)'
      when 11 then '{goalnr}{ordinal} goal scorer' else 'Penalty awarded' end market_raw,
    bet_type, cast(null as string) player_raw,
    case when ok % 97 = 0 then null
      when mk in (0,5,7,11) then 'Player ' || who
      when mk = 8 then (case when l_partkey % 2 = 0 then 'Team' || cast(slot as string) else 'Nobody' end) || ' 5 or more'
      when mk in (6,9) then 'Over ' || cast(1 + l_partkey % 3 as string) || '.5'
      else 'Option ' || who end option_raw,
    bts betslip_ts,
    case when o_custkey % 10 in (0,1) then 'MAH-01-' || cast(o_custkey as string)
      when o_custkey % 10 = 2 then 'TPV-' || cast(o_custkey as string) else cast(o_custkey as string) end uid,
    case when nk % 5 = 0 then 'UNIT PERÚ RETAIL' when nk % 5 = 1 then 'UNIT PORTUGAL' else 'UNIT NORTH' end unit,
    (case when l_discount = 0.0 and mk = 4 then 101
      else 140 + mk*25 + cast(round(l_discount*100) as bigint)*12 end) / cast(100 as double) price,
    (case when bet_type = 'COMBINED' then cast(floor(tp/80) as bigint)
      when mk = 0 then cast(l_quantity as bigint)*500 else cast(l_quantity as bigint)*100 end)
      * (case when date_part('day', bts) = 20 then 6 else 1 end) stake_c,
    case when bet_type = 'COMBINED' then (case when os = 'F' then -150 else 100 end)
      when l_returnflag = 'R' then -(40 + mk*25) else 100 end gm,
    case when ok % 25 = 0 then 'PEN' when ok % 25 = 1 then 'USD' when ok % 25 = 2 then null else 'EUR' end currency_raw,
    ok, src_row
  from b4),
b6 as (select *, ((stake_c*gm) - ((stake_c*gm) % 100)) / cast(100 as double) ggr_c0 from b5),
bound as (
  select sport, competition, match_id, match, event_ts, market_raw, bet_type, player_raw, option_raw, betslip_ts,
    uid, unit, price, stake_c/cast(100 as double) stake, ggr_c0/cast(100 as double) ggr,
    ggr_c0*(case when unit = 'UNIT PORTUGAL' then 6 else 8 end)/cast(10000 as double) net_revenue,
    currency_raw, ok, src_row
  from b6)
"""


# Orders meet their customers before they meet the lines, so that lines are shuffled once, by order: the
# numbering of an order's lines then finds them together.
LINES_FIRST = (
    "from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey"
)
ORDERS_FIRST = (
    "from lineitem l join ( orders o join customer c on o.o_custkey = c.c_custkey) on l.l_orderkey = o.o_orderkey"
)


def bound_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs of the whole tables, plus ``ok`` (the order they came from)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    text = BINDING.replace(LINES_FIRST, ORDERS_FIRST)
    for name in ("lineitem", "orders", "customer"):
        view = f"slipstream_{name}"
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(view)
        text = text.replace(f" {name} ", f" {view} ")
    legs = spark.sql(text + "select * from bound")
    typed = [F.col(f.name).cast(f.dataType) for f in LEG_SCHEMA if f.name in legs.columns]
    return legs.select(
        *typed, F.lit("A").alias("source"), F.col("src_row").cast("long").alias("source_row"), "ok"
    )


def pull_a(legs: DataFrame) -> DataFrame:
    """The earlier pull: up to the seam's end, with half its settlements stale."""
    stale = F.when(F.col("ok") % 2 == 0, F.col("stake")).otherwise(F.col("ggr"))
    return (
        legs.where(F.col("betslip_ts") < F.lit(SEAM_END).cast("timestamp"))
        .withColumn("ggr", stale)
        .drop("ok")
        .withColumn("source", F.lit("A"))
    )


def pull_b(legs: DataFrame) -> DataFrame:
    """The later pull: from the seam's start on."""
    return (
        legs.where(F.col("betslip_ts") >= F.lit(SEAM_START).cast("timestamp"))
        .drop("ok")
        .withColumn("source", F.lit("B"))
    )
