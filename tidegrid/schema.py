"""Timeframes, conditions, feature names and the table layouts of each stage."""

from __future__ import annotations

# Names, orders and constants that results depend on.
TIMEFRAMES = ("15m", "1h", "4h", "1d")
SECONDS = {"15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}
INTERVAL = {"15m": "15 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day"}
EXPECTED_ROWS = {"15m": 140256, "1h": 35064, "4h": 8766, "1d": 1461}
OHLC = ("open", "high", "low", "close")
BAR = (*OHLC, "volume")
MASTER_ORDER = ("1h", "15m", "4h", "1d")
FEATURES = ("open_return", "high_return", "low_return", "close_return", "volume_zscore", "hl_range", "body_ratio")
CONDITIONS = {
    "1TF": ("1h",),
    "2TF": ("15m", "1h"),
    "3TF": ("15m", "1h", "4h"),
    "4TF": ("15m", "1h", "4h", "1d"),
    "BL-15m": ("15m",),
    "BL-4h": ("4h",),
    "BL-1d": ("1d",),
}
SEEDS = (42, 123, 456, 789, 1024)
EPS = 1e-8
ROLLING, WINDOW, STRIDE = 20, 48, 1

MASTER_COLUMNS = [f"{c}_{tf}" for tf in MASTER_ORDER for c in BAR]
FEATURE_COLUMNS = [f"{f}_{tf}" for tf in TIMEFRAMES for f in FEATURES]
ARTIFACT = ["timestamp", "open_1h", "high_1h", "low_1h", "close_1h", "volume_1h", "close_return_1h", "cluster_label", "is_noise", "condition", "seed"]


def ordered_timeframes(active) -> list[str]:
    """Active timeframes from fine to coarse; an empty or unknown set is an error."""
    active = set(active)
    if not active or active - set(TIMEFRAMES):
        raise ValueError(f"timeframes must be some of {TIMEFRAMES}, got {sorted(active)}")
    return [tf for tf in TIMEFRAMES if tf in active]
