"""Default parameters. The values are fixed: results depend on them."""

from __future__ import annotations

# Bar lengths in seconds.
TIMEFRAMES = {"1m": 60, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400, "7d": 604800}

# Token universe: provider slug and symbol.
TOKENS = {
    "BTC": ("bitcoin", "BINANCE_SPOT_BTC_USDT"),
    "ETH": ("ethereum", "BINANCE_SPOT_ETH_USDT"),
    "MATIC": ("matic-network", "BINANCE_SPOT_MATIC_USDT"),
    "AAVE": ("aave", "BINANCE_SPOT_AAVE_USDT"),
    "SHIB": ("shiba-inu", "BINANCE_SPOT_SHIB_USDT"),
}

# Indicator windows per horizon and timeframe: (rsi, atr, adx).
WINDOWS = {
    "1h": {"15m": (14, 40, 10), "1h": (None, 40, 10), "4h": (None, 14, 10), "1d": (None, 40, 10)},
    "4h": {"15m": (14, 40, 20), "1h": (None, 40, 20), "4h": (None, 14, 20), "1d": (None, 40, 20)},
    "8h": {"15m": (14, 40, 30), "1h": (None, 40, 30), "4h": (None, 14, 40), "1d": (None, 40, 30)},
}

# Look-forward bars of each label horizon on a 15-minute base.
LABEL_HORIZONS = {"1h": 4, "4h": 16, "8h": 32}
LABEL_ATR_WINDOW = 14
# Barrier name -> (sign, ATR multiple).
BARRIERS = {
    "barrier_strong_bull": (1, 2.5),
    "barrier_bull": (1, 1.25),
    "barrier_bull_invalid": (-1, 0.75),
    "barrier_strong_bear": (-1, 2.5),
    "barrier_bear": (-1, 1.25),
    "barrier_bear_invalid": (1, 0.75),
}

SPLIT_TRAIN_AND_VAL = 0.8
SPLIT_VAL = 0.1
DECAY_HALF_LIFE_MONTHS = 6.0
DECAY_FLOOR = 0.1
DAYS_PER_MONTH = 30.4375

WALK_FORWARD_MONTHS = {"train": 12, "val": 3, "step": 3}

SLIPPAGE_PCT = 0.05
TAKER_FEE_PCT = 0.04
PROMOTION_THRESHOLD_PCT = 10.0
BACKTEST_STOP = 0.005
BACKTEST_TARGET = 0.01
BARS_PER_YEAR_15M = 365.0 * 24.0 * 4.0

ATR_STOP_MULTIPLE = 2.5
FALLBACK_STOP_PCT = 2.0
FIXED_TARGET_PCT = 3.0
SIZING = {
    "mode": "percent_risk",
    "risk_percent": 1.0,
    "fixed_percent": 5.0,
    "fixed_usd": 1000.0,
    "max_usd": 20000.0,
    "leverage": 5.0,
}

MINIMUM_MOVE_PCT = 0.5
MIN_CONSENSUS_PROBABILITY = 0.55
# Directive labels in tie-break order, with their expected move in percent.
LABELS = ["OPEN_LONG", "OPEN_SHORT", "EXIT_LONG", "EXIT_SHORT", "HOLD"]
EXPECTED_MOVE_PCT = {"OPEN_LONG": 1.0, "OPEN_SHORT": 1.0, "EXIT_LONG": 0.0, "EXIT_SHORT": 0.0, "HOLD": 0.0}

DRIFT_MODERATE = 0.3
DRIFT_SEVERE = 0.6
FRESHNESS_SECONDS = 1800
LOOKBACK_DAYS = 730
EVENT_TOLERANCE_SECONDS = 12 * 3600

# Ordered feature whitelist of the wide table.
FEATURES = [
    "rsi_15m",
    "atr_normalized_15m",
    "atr_normalized_1h",
    "atr_normalized_4h",
    "atr_normalized_1d",
    "adx_15m",
    "adx_pos_15m",
    "adx_neg_15m",
    "adx_1h",
    "adx_pos_1h",
    "adx_neg_1h",
    "adx_4h",
    "adx_pos_4h",
    "adx_neg_4h",
    "adx_1d",
    "adx_pos_1d",
    "adx_neg_1d",
    "day_of_week_cos",
    "day_of_week_sin",
    "hour_of_day_cos",
    "hour_of_day_sin",
    "minute_of_hour_cos",
    "minute_of_hour_sin",
    "sess_ny_flag",
    "sess_london_flag",
    "sess_asia_flag",
    "kz_ny_flag",
    "kz_london_flag",
    "friday_flag",
    "bars_to_session_close",
    "bars_to_kz_end",
    "bars_since_session_open",
    "bars_since_midnight_utc",
    "bars_since_kz_start",
]
EVENT_FLAG = "economic_event"
