"""Analysis decisions, in one place."""

from __future__ import annotations

# --- fixed values: results depend on these being exactly as stated -----------
FX_TO_EUR = {"EUR": 1.0, "PEN": 1.0 / 3.90, "USD": 1.0 / 1.138}

LINEUP_PROXY_MIN = 60
DAY_OF_MIN = 1440
DATA_START = "2026-06-01"

PHASES = ["early pre-match", "day-of pre-match", "post-lineups (proxy)", "in-play"]
CHANNELS = ["online", "retail", "tpv"]
BET_TYPES = ["SIMPLE", "COMBINED"]

SEL_MIN_LEGS = 5
SEL_MIN_PRICES = 2
UID_MIN_SLIPS = 15
UID_MIN_STAKE_EUR = 150
UID_MIN_CLV_LEGS = 8
CLV_MIN_WEIGHT = 0.01
PRICE_FLOOR = 1.01
WEIGHTS = {"clv": 0.30, "win": 0.25, "lineup": 0.15, "stake": 0.15, "focus": 0.15}
WATCHLIST_SIZE = 60
REASON_FLOOR = 0.85

DRIFT_MIN_CHANGE, DRIFT_MIN_STAKE, DRIFT_TOP = 0.25, 250, 20
SUPPORT_MIN_UIDS, SUPPORT_MIN_SHARE, SUPPORT_MIN_STAKE, SUPPORT_TOP = 25, 0.18, 500, 20
EXPOSURE_TOP = 15
POCKET_MIN_STAKE, POCKET_MAX_MARGIN, POCKET_TOP = 2000, -0.15, 15
SPIKE_HISTORY_DAYS, SPIKE_MIN_Z, SPIKE_MIN_STAKE, SPIKE_TOP = 7, 3, 10_000, 10
MAD_TO_SIGMA = 1.4826

LATE_LEAD_MIN = -130
FIXTURE_DAY_SHIFT_HOURS = 6
FLOW_FROM_MIN, FLOW_TO_MIN, FLOW_BIN_MIN = -4320, 150, 30
DRILL_CAP = 400
LORENZ_SAMPLES = 200
CORE_GROUPS = ["Player props", "Goalscorer props", "BetBuilder"]
TWO_PLUS_GOALS = "To score 2 or more goals"
EXPORT_MAX_PRICE = 10_000
# -----------------------------------------------------------------------------

# Pulls in the order they were made; the later one wins settlement conflicts.
PULLS = ("A", "B")

# Keys with more than 1/HOT_KEYS of all rows are broadcast in a lookup (see operators/skew.py).
HOT_KEYS = 1000

# Rows of one file that a single occurrence-numbering task may have to sort.
OCCURRENCE_CHUNK_ROWS = 1_000_000
