"""Values of legs built by hand."""

from datetime import datetime

KICKOFF = datetime(2026, 6, 15, 18)
NOON = datetime(2026, 6, 15, 12)
DEFAULTS = dict(
    sport="Football", competition="Test Cup", match_id=100, match="Alpha - Beta", event_ts=KICKOFF,
    market_raw="Anytime goalscorer (Star Substitute)", bet_type="SIMPLE",
    player_raw="Goleador durante el partido (Suplente Estrella)", option_raw="Test Player",
    betslip_ts=NOON, uid="12345", unit="UNIT NORTH", price=3.5, stake=10.0, ggr=10.0, net_revenue=0.8,
    currency_raw="EUR", source="A",
)


def column(df, name: str, order: str = "row_id") -> list:
    return [r[name] for r in df.orderBy(order).select(name, order).collect()]
