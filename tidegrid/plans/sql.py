"""DuckDB SQL for the time-series queries, put together from common table expressions."""

from __future__ import annotations

from tidegrid.schema import BAR, FEATURES, MASTER_ORDER, ROLLING, TIMEFRAMES, WINDOW

STEP = {"15m": "15 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day"}


def bars(tf: str, symbol: str = "event_type") -> str:
    return f"""SELECT {symbol} AS symbol, time_bucket(INTERVAL '{STEP[tf]}', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
      min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(value) AS volume FROM events GROUP BY ALL"""


def base() -> str:
    """All series, the 15m series by hours, the grid and the master table."""
    ctes = [f"b_{tf} AS ({bars(tf)})" for tf in TIMEFRAMES]
    ctes.append("""r_15m AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
      arg_max(close, ts) AS close, sum(volume) AS volume FROM b_15m GROUP BY symbol, time_bucket(INTERVAL '1 hour', ts))""")
    ctes.append("""grid AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL '1 hour')) AS ts FROM (SELECT symbol, min(ts) AS a, max(ts) AS b FROM b_1h GROUP BY symbol))""")
    ctes.append(f"master AS ({master()})")
    return "WITH " + ",\n".join(ctes)


def master() -> str:
    cols = []
    for tf in MASTER_ORDER:
        for c in BAR:
            if tf in ("1h", "15m"):
                a = "h" if tf == "1h" else "q"
                cols.append(f"CASE WHEN {a}.ts IS NULL THEN 0.0 ELSE {a}.volume END AS volume_{tf}" if c == "volume" else f"last_value({a}.{c} IGNORE NULLS) OVER w AS {c}_{tf}")
            else:
                cols.append(f"{'f' if tf == '4h' else 'd'}.{c} AS {c}_{tf}")
    return f"""SELECT g.symbol, g.ts, {", ".join(cols)} FROM grid g
      LEFT JOIN b_1h h ON h.symbol = g.symbol AND h.ts = g.ts LEFT JOIN r_15m q ON q.symbol = g.symbol AND q.ts = g.ts
      ASOF LEFT JOIN b_4h f ON f.symbol = g.symbol AND f.ts <= g.ts ASOF LEFT JOIN b_1d d ON d.symbol = g.symbol AND d.ts <= g.ts
      WINDOW w AS (PARTITION BY g.symbol ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def feature_sql(tf: str) -> str:
    o, h, l, c, v = (f"{x}_{tf}" for x in BAR)
    lag = f"lag({c}) OVER s"
    frame = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {ROLLING - 1} PRECEDING AND CURRENT ROW)"
    got = [f"({o} - {lag}) / nullif({lag}, 0)", f"({h} - {o}) / nullif({o}, 0)", f"({l} - {o}) / nullif({o}, 0)", f"({c} - {o}) / nullif({o}, 0)",
           f"CASE WHEN count({v}) {frame} < {ROLLING} THEN NULL WHEN max({v}) {frame} = min({v}) {frame} THEN 0.0 ELSE ({v} - avg({v}) {frame}) / (stddev_samp({v}) {frame} + 1e-8) END",
           f"({h} - {l}) / nullif({o}, 0)", f"abs({c} - {o}) / ({h} - {l} + 1e-8)"]
    return ", ".join(f"{x} AS {name}_{tf}" for x, name in zip(got, FEATURES, strict=True))


def feature_ctes() -> str:
    every = ", ".join(feature_sql(tf) for tf in TIMEFRAMES)
    present = " AND ".join(f"{f}_{tf} IS NOT NULL" for tf in TIMEFRAMES for f in FEATURES)
    return base() + f""",
feats AS (SELECT symbol, ts, {every} FROM master WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
matrix AS (SELECT * FROM feats WHERE {present})"""


def rounded(cols, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


def window_ctes(tf: str = "1h") -> str:
    cols = [f"{f}_{tf}" for f in FEATURES]
    frame = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)"
    stats = ", ".join(f"list({c}) {frame} AS l_{f}, {c} AS v_{f}" for c, f in zip(cols, FEATURES, strict=True))
    return feature_ctes() + f""",
wins AS (SELECT * FROM (SELECT symbol, min(ts) {frame} AS earliest, ts AS anchor, count(*) {frame} AS n, {stats} FROM matrix) WHERE n = {WINDOW})"""
