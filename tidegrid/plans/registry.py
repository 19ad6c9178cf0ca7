"""All queries of the time-series engine, each with its oracle SQL where SQL can express it.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.operators import checks, features, gates, geometry, leakage, split, statistics, temporal, windows
from tidegrid.plans import sql
from tidegrid.schema import BAR, FEATURE_COLUMNS, FEATURES, MASTER_COLUMNS, TIMEFRAMES
from tidegrid.sources import tables

TRAIN_END, TEST_START = "2024-01-22 23:00:00", "2024-01-23 00:00:00"
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def tidy(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    """``df`` with doubles rounded."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in df.columns])


def _series(spark, d):
    return tables.series(spark, d)


def _master(spark, d, **how):
    return temporal.master(_series(spark, d), **how)


def _features(spark, d, **how):
    return features.features(_master(spark, d), **how)


def _matrix(spark, d):
    return features.complete(_features(spark, d))


def _split(spark, d):
    return split.split(_matrix(spark, d), TRAIN_END, TEST_START)


def _raw_windows(spark, d, tf="1h", **how):
    return windows.extract(_matrix(spark, d), tf, **how)


def _windows(spark, d, tf="1h"):
    return windows.categorise(_raw_windows(spark, d, tf), TRAIN_END, TEST_START)


def _vectors(spark, d):
    return geometry.vectors(spark.read.parquet(f"{d}/embeddings.parquet"))


BARS_1H = sql.bars("1h")

# --- sources and control data


@query("a3_trim", f"SELECT symbol, ts, {sql.rounded(BAR)} FROM ({BARS_1H}) WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-09 23:59:59'")
def a3(spark, d):
    return tidy(checks.trim(_series(spark, d)["1h"], "2024-01-05", "2024-01-09"), BAR)


@query("a4_dedupe", """WITH x AS (SELECT event_type AS symbol, time_bucket(INTERVAL '15 minutes', ts) AS ts, event_id, value FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id) AS k FROM x) SELECT symbol, ts, event_id, value FROM r WHERE k = 1""")
def a4(spark, d):
    rows = tables.ticks(spark, d).withColumn("ts", temporal.bucket_start("ts", "15m"))
    return checks.keep_first(rows.withColumn("seq", F.col("event_id")), "seq").select("symbol", "ts", "event_id", "value")


@query("a5_cast", "SELECT event_id, epoch_us(ts) // 1000 AS ms, make_timestamp((epoch_us(ts) // 1000) * 1000) AS ts, value::DOUBLE AS value FROM events")
def a5(spark, d):
    rows = tables.ticks(spark, d).select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "value")
    return rows.select("event_id", "ms", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), F.col("value").cast("double").alias("value"))


@query("a7_checksum")
def a7(spark, d):
    return tables.checksums(spark, f"{d}/events.parquet").select("length", "sha256")


@query("a8_row_count_tolerance", f"""SELECT timeframe, sum(n)::BIGINT AS n, expected, (n BETWEEN expected * 0.95 AND expected * 1.05) AS within FROM (
""" + " UNION ALL ".join(f"SELECT '{tf}' AS timeframe, count(*) AS n, {n} AS expected FROM (SELECT DISTINCT time_bucket(INTERVAL '{sql.STEP[tf]}', ts) FROM events)" for tf, n in (("15m", 2880), ("1h", 720), ("4h", 180), ("1d", 30))) + ") GROUP BY timeframe, expected, n")
def a8(spark, d):
    out = None
    for tf, n in (("15m", 2880), ("1h", 720), ("4h", 180), ("1d", 30)):
        one = temporal.bars(tables.ticks(spark, d), tf, keys=())
        one = checks.row_count_tolerance(one, tf, {tf: n})
        out = one if out is None else out.unionByName(one)
    return out


@query("a9_manifest", """WITH m AS (""" + " UNION ALL ".join(f"SELECT '{tf}' AS tf, count(*) AS n, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS a, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS b FROM ({sql.bars(tf)})" for tf in TIMEFRAMES) + """)
SELECT '{"symbol":"EVENTS","exchange":"local","timeframes":{' || string_agg('"' || tf || '":{"rows":' || n || ',"start":"' || a || '","end":"' || b || '"}', ',' ORDER BY tf) || '}}' AS manifest FROM m""")
def a9(spark, d):
    return checks.manifest(_series(spark, d), "EVENTS", "local")


# --- validation


def _check_sql(ctes: str, series: dict[str, tuple[str, str]]) -> str:
    """SQL of a report; ``series`` has for each timeframe a table and the column of its storage order."""
    parts, step = [], {"15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}
    odd = " + ".join(f"count(*) FILTER ({c} IS NULL OR NOT isfinite({c}))" for c in BAR)
    for tf, (table, seq) in series.items():
        parts.append(f"""SELECT symbol, '{tf}' AS timeframe, count(*) AS n, count(DISTINCT ts) AS nd, count(*) FILTER (back) AS nb, {odd} AS ni, bool_and(typeof(ts) = 'TIMESTAMP') AS tz,
          count(*) FILTER ((high < open OR high < close OR low > open OR low > close OR high < low) AND NOT (isnan(open) OR isnan(high) OR isnan(low) OR isnan(close))) AS bad,
          count(*) FILTER (NOT coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND NOT (isnan(open) OR isnan(high) OR isnan(low) OR isnan(close)), false)) AS np,
          count(*) FILTER (NOT coalesce(volume >= 0 AND NOT isnan(volume), false)) AS nv, coalesce(sum(greatest(round_even(u, 0) - 1, 0)), 0.0) AS miss, coalesce(max(u), 0.0) AS gap
          FROM (SELECT *, (epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY symbol ORDER BY ts)) / {step[tf]}.0 AS u, lag(ts) OVER (PARTITION BY symbol ORDER BY {seq}) > ts AS back FROM {table}) GROUP BY symbol""")
    rows = {
        "columns_present": ("true", "0.0"), "monotonicity": ("nb = 0", "nb"), "no_duplicate_timestamps": ("nd = n", "(n - nd)"), "ohlc_integrity": ("bad = 0", "bad"),
        "positive_prices": ("np = 0", "np"), "non_negative_volume": ("nv = 0", "nv"), "no_nan_or_inf": ("ni = 0", "ni"), "timezone_utc": ("tz", "0.0"),
        "gap_ratio": ("CASE WHEN n <= 1 THEN 0.0 ELSE miss / (n + miss) END <= 0.05", "CASE WHEN n <= 1 THEN 0.0 ELSE miss / (n + miss) END"), "no_excessive_single_gap": ("gap <= 2.0", "gap"),
    }
    every = " UNION ALL ".join(f"SELECT symbol, timeframe, '{k}' AS \"check\", {p} AS passed, '{'warning' if k == 'no_excessive_single_gap' else 'error'}' AS severity, round(({x})::DOUBLE, 6) AS metric FROM m" for k, (p, x) in rows.items())
    return ctes + ",\nm AS (" + " UNION ALL ".join(parts) + ")\n" + every


@query("b_report", _check_sql(sql.base(), {tf: (f"b_{tf}", "ts") for tf in TIMEFRAMES}))
def b_report(spark, d):
    return tidy(checks.report_all(_series(spark, d)), ["metric"])


# Faults put into the hourly bars, by a bar's number k in its series: (column, where, value).
FAULTS = (
    ("high", "k % 41 = 5", "low - 1"), ("close", "k % 43 = 6", "-close"), ("volume", "k % 47 = 7", "-1D"), ("open", "k % 53 = 8", "double('NaN')"),
    ("high", "k % 59 = 9", "double('Infinity')"), ("ts", "k % 61 = 10", "ts - interval 1 hour"), ("low", "k % 71 = 12", "cast(null as double)"),
)
SEQ = "CASE WHEN k % 67 = 11 THEN k + 2.5 ELSE k END"


def _faulty(dialect: str) -> dict[str, str]:
    """Each column of a bar with its faults."""
    put = {"-1D": "-1.0", "double('NaN')": "'NaN'::DOUBLE", "double('Infinity')": "'Infinity'::DOUBLE", "ts - interval 1 hour": "ts - INTERVAL '1 hour'"} if dialect == "duckdb" else {}
    out = {}
    for c in ("ts", *BAR):
        when = " ".join(f"WHEN {w} THEN {put.get(v, v)}" for col, w, v in FAULTS if col == c)
        out[c] = f"CASE {when} ELSE {c} END" if when else c
    return out


FAULTY_SQL = sql.base() + ", k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM b_1h), faulty AS (SELECT symbol, " + ", ".join(f"{x} AS {c}" for c, x in _faulty("duckdb").items()) + f", {SEQ} AS seq FROM k)"


def _faulty_bars(spark, d) -> DataFrame:
    rows = _series(spark, d)["1h"].withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))
    return rows.selectExpr("symbol", *[f"{x} AS {c}" for c, x in _faulty("spark").items()], f"{SEQ} AS seq")


@query("b_report_faults", _check_sql(FAULTY_SQL, {"1h": ("faulty", "seq")}))
def b_report_faults(spark, d):
    return tidy(checks.report(_faulty_bars(spark, d), "1h", seq="seq"), ["metric"])


@query("b9_coverage", "SELECT symbol, (min(ts) <= TIMESTAMP '2024-01-01' AND max(ts) >= TIMESTAMP '2024-01-30 23:00:00') AS passed FROM (" + BARS_1H + ") GROUP BY symbol")
def b9(spark, d):
    found = checks.report(_series(spark, d)["1h"], "1h", "2024-01-01", "2024-01-30")
    return found.filter(F.col("check") == "date_range_coverage").select("symbol", "passed")


# --- alignment


@query("c1_resample", sql.base() + f" SELECT symbol, ts, {sql.rounded(BAR)} FROM r_15m")
def c1(spark, d):
    return tidy(temporal.resample(_series(spark, d)["15m"], "1h"), BAR)


@query("c2_floor_hour", "SELECT event_id, time_bucket(INTERVAL '1 hour', ts) AS hour FROM events")
def c2(spark, d):
    return tables.ticks(spark, d).select("event_id", temporal.bucket_start("ts", "1h").alias("hour"))


@query("c3_asof", sql.base() + ", x AS (SELECT g.symbol, g.ts, f.open, f.close FROM grid g ASOF LEFT JOIN b_4h f ON f.symbol = g.symbol AND f.ts <= g.ts) SELECT symbol, ts, round(open, 6) AS open, round(close, 6) AS close FROM x")
def c3(spark, d):
    s = _series(spark, d)
    return tidy(temporal.asof(temporal.hour_grid(s["1h"]), s["4h"], ["open", "close"]), ["open", "close"])


@query("c3_asof_max_age", sql.base() + ", x AS (SELECT g.symbol, g.ts, CASE WHEN f.ts >= g.ts - INTERVAL '2 hours' THEN f.close END AS close FROM grid g ASOF LEFT JOIN b_4h f ON f.symbol = g.symbol AND f.ts <= g.ts) SELECT symbol, ts, round(close, 6) AS close FROM x")
def c3_age(spark, d):
    s = _series(spark, d)
    return tidy(temporal.asof(temporal.hour_grid(s["1h"]), s["4h"], ["close"], max_age="2 hours"), ["close"])


@query("c4_fill_gaps", sql.base() + ", x AS (SELECT g.symbol, g.ts, " + ", ".join(f"last_value(h.{c} IGNORE NULLS) OVER w AS {c}" for c in BAR[:4]) + ", CASE WHEN h.ts IS NULL THEN 0.0 ELSE h.volume END AS volume FROM grid g LEFT JOIN b_1h h ON h.symbol = g.symbol AND h.ts = g.ts WINDOW w AS (PARTITION BY g.symbol ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) " + f"SELECT symbol, ts, {sql.rounded(BAR)} FROM x")
def c4(spark, d):
    s = _series(spark, d)
    return tidy(temporal.fill_gaps(temporal.hour_grid(s["1h"]), s["1h"]), BAR)


@query("c5_grid", sql.base() + " SELECT symbol, ts FROM grid")
def c5(spark, d):
    return temporal.hour_grid(_series(spark, d)["1h"])


MASTER_SQL = sql.base() + f" SELECT symbol, ts, {sql.rounded(MASTER_COLUMNS)} FROM master"


@query("c6_master", MASTER_SQL)
def c6(spark, d):
    return tidy(_master(spark, d), MASTER_COLUMNS)


@query("c6_master_close_time", sql.base() + """, x AS (SELECT g.symbol, g.ts, f.close AS close_4h, d.close AS close_1d FROM grid g
ASOF LEFT JOIN (SELECT *, ts + INTERVAL '3 hours' AS seen FROM b_4h) f ON f.symbol = g.symbol AND f.seen <= g.ts
ASOF LEFT JOIN (SELECT *, ts + INTERVAL '23 hours' AS seen FROM b_1d) d ON d.symbol = g.symbol AND d.seen <= g.ts) SELECT symbol, ts, round(close_4h, 6) AS close_4h, round(close_1d, 6) AS close_1d FROM x""")
def c6_close(spark, d):
    return tidy(_master(spark, d, availability="close").select("symbol", "ts", "close_4h", "close_1d"), ["close_4h", "close_1d"])


@query("c8_lookahead", sql.base() + """, x AS (SELECT m.symbol, m.ts, f.ts AS assigned_open_time, (m.open_4h IS NOT DISTINCT FROM f.open) AS passed,
 row_number() OVER (PARTITION BY m.symbol, year(m.ts) ORDER BY m.ts) = least(6, count(*) OVER (PARTITION BY m.symbol, year(m.ts))) AS sampled
 FROM master m ASOF LEFT JOIN b_4h f ON f.symbol = m.symbol AND f.ts <= m.ts) SELECT * FROM x""")
def c8(spark, d):
    return leakage.lookahead(_master(spark, d), _series(spark, d)["4h"], "4h")


@query("c8_unfinished_bars", sql.base() + """ SELECT m.symbol, count(*) AS n, count(*) FILTER (b.ts IS NOT NULL AND b.ts + INTERVAL '4 hours' > m.ts + INTERVAL '1 hour' AND m.close_4h = b.close) AS n_unfinished
FROM master m LEFT JOIN b_4h b ON b.symbol = m.symbol AND b.ts = time_bucket(INTERVAL '4 hours', m.ts) GROUP BY m.symbol""")
def c8_unfinished(spark, d):
    return leakage.unfinished_bars(_master(spark, d), _series(spark, d)["4h"], "4h")


@query("c9_grid_complete", sql.base() + ", steps AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev FROM master) SELECT symbol, count(*) AS n, count(*) FILTER (prev IS NOT NULL AND ts <> prev + INTERVAL '1 hour') AS n_breaks, count(*) FILTER (prev IS NOT NULL AND ts <> prev + INTERVAL '1 hour') = 0 AS complete FROM steps GROUP BY symbol")
def c9(spark, d):
    return checks.grid_complete(_master(spark, d))


# --- features


@query("d_features", sql.feature_ctes() + f" SELECT symbol, ts, {sql.rounded(FEATURE_COLUMNS)} FROM feats")
def d_all(spark, d):
    return tidy(_features(spark, d), FEATURE_COLUMNS)


@query("d_features_halo", sql.feature_ctes() + f" SELECT symbol, ts, {sql.rounded(FEATURE_COLUMNS)} FROM feats")
def d_halo(spark, d):
    return tidy(_features(spark, d, bucket=168), FEATURE_COLUMNS)


@query("d10_complete", sql.feature_ctes() + f" SELECT symbol, ts, {sql.rounded(FEATURE_COLUMNS)} FROM matrix")
def d10(spark, d):
    return tidy(_matrix(spark, d), FEATURE_COLUMNS)


@query("d11_integrity", sql.feature_ctes() + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER (isinf({c})) AS n_infinite FROM feats" for c in FEATURE_COLUMNS))
def d11(spark, d):
    return features.integrity(_features(spark, d), FEATURE_COLUMNS)


@query("d11_zero_denominators", sql.base() + " " + " UNION ALL ".join(f"SELECT '{tf}' AS timeframe, count(*) FILTER (open_{tf} = 0) AS n FROM master" for tf in TIMEFRAMES))
def d11_zero(spark, d):
    return features.zero_denominators(_master(spark, d))


# --- split

SPLIT = sql.feature_ctes() + f""",
parts AS (SELECT *, CASE WHEN ts <= TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN ts >= TIMESTAMP '{TEST_START}' THEN 'test' END AS split FROM matrix)"""


@query("e1_split", SPLIT + " SELECT symbol, ts, split FROM parts")
def e1(spark, d):
    return _split(spark, d).select("symbol", "ts", "split")


@query("e2_boundary", SPLIT + f" SELECT symbol, max(ts) FILTER (split = 'train') AS train_last, min(ts) FILTER (split = 'test') AS test_first, max(ts) FILTER (split = 'train') = TIMESTAMP '{TRAIN_END}' AND min(ts) FILTER (split = 'test') = TIMESTAMP '{TEST_START}' AS passed FROM parts GROUP BY symbol")
def e2(spark, d):
    return split.check_boundary(_split(spark, d), TRAIN_END, TEST_START, ("symbol",))


@query("e3_overlap", SPLIT + " SELECT symbol, ts FROM parts WHERE split = 'train' INTERSECT SELECT symbol, ts FROM parts WHERE split = 'test'")
def e3(spark, d):
    return split.overlap(_split(spark, d), ("symbol",))


@query("e4_sizes", SPLIT + " SELECT symbol, split, count(*) AS n, abs(count(*) - CASE split WHEN 'train' THEN 509 ELSE 192 END) <= 50 AS passed FROM parts GROUP BY symbol, split")
def e4(spark, d):
    return split.sizes(_split(spark, d), {"train": 509, "test": 192}, 50, ("symbol",))


@query("e5_leaks", SPLIT + f", l AS (SELECT symbol, count(*) FILTER (split = 'train' AND ts >= TIMESTAMP '{TEST_START}') AS n_train_late, count(*) FILTER (split = 'test' AND ts <= TIMESTAMP '{TRAIN_END}') AS n_test_early, round(arg_min(volume_zscore_1h, ts) FILTER (split = 'test'), 6) AS first_test_value FROM parts GROUP BY symbol) SELECT *, n_train_late = 0 AND n_test_early = 0 AND first_test_value IS NOT NULL AS passed FROM l")
def e5(spark, d):
    return tidy(split.leaks(_split(spark, d), TRAIN_END, TEST_START, keys=("symbol",)), ["first_test_value"])


# --- windows

WINS = sql.window_ctes() + f""",
cats AS (SELECT *, CASE WHEN anchor <= TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN anchor >= TIMESTAMP '{TEST_START}' THEN 'test' END AS split FROM wins)"""
ENDS = ", ".join(f"round(l_{f}[1], 6) + 0.0 AS {f}_first, round(l_{f}[-1], 6) + 0.0 AS {f}_last" for f in FEATURES)


def _ends(df, digits=6):
    return [(F.round(F.element_at(f"x.{f}", k).cast("double"), digits) + F.lit(0.0)).alias(f"{f}_{n}") for f in FEATURES for k, n in ((1, "first"), (-1, "last"))]


@query("f1_windows", WINS + f" SELECT symbol, earliest, anchor, {ENDS} FROM wins")
def f1(spark, d):
    w = _raw_windows(spark, d)
    return w.select("symbol", "earliest", "anchor", *_ends(w))


@query("f1_windows_halo", WINS + f" SELECT symbol, earliest, anchor, {ENDS} FROM wins")
def f1_halo(spark, d):
    rows = features.complete(_features(spark, d), FEATURE_COLUMNS)
    w = windows.extract(rows, "1h", bucket=168)
    return w.select("symbol", "earliest", "anchor", *_ends(w))


@query("f1_stride", WINS + ", k AS (SELECT symbol, anchor, row_number() OVER (PARTITION BY symbol ORDER BY anchor) - 1 AS k FROM wins) SELECT symbol, anchor FROM k WHERE k % 6 = 0")
def f1_stride(spark, d):
    return _raw_windows(spark, d, stride=6).select("symbol", "anchor")


@query("f2_anchors", WINS + " SELECT symbol, epoch_us(anchor) * 1000 AS anchor_ns, epoch_us(earliest) * 1000 AS earliest_ns FROM wins")
def f2(spark, d):
    ns = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) * 1000).alias(f"{c}_ns")
    return _raw_windows(spark, d).select("symbol", ns("anchor"), ns("earliest"))


def _z(f: str, k: int) -> str:
    m = f"list_avg(l_{f})"
    s = f"sqrt(list_avg(list_transform(l_{f}, lambda v: (v - {m}) * (v - {m}))))"
    return f"round((l_{f}[{k}] - {m}) / ({s} + 1e-8), 4) + 0.0"


@query("f3_zscore", WINS + " SELECT symbol, anchor, " + ", ".join(f"{_z(f, k)} AS {f}_{n}" for f in FEATURES for k, n in ((1, "first"), (-1, "last"))) + " FROM wins")
def f3(spark, d):
    w = _raw_windows(spark, d)
    z = w.select("symbol", "anchor", F.struct(*[windows.zscore(F.col(f"x.{f}")).alias(f) for f in FEATURES]).alias("x"))
    return z.select("symbol", "anchor", *_ends(z, 4))


@query("f4_categories", WINS + " SELECT symbol, split, count(*) AS n FROM cats GROUP BY symbol, split")
def f4(spark, d):
    return _windows(spark, d).groupBy("symbol", "split").agg(F.count("*").alias("n"))


@query("f5_generate")
def f5(spark, d):
    w = windows.generate(_matrix(spark, d), "1h", TRAIN_END, TEST_START)
    return w.select("symbol", "anchor", "split", *_ends(w, 3))


@query("f6_shape", WINS + " SELECT count(*) AS n, count(*) FILTER (" + " OR ".join(f"len(l_{f}) <> 48 OR len(list_filter(l_{f}, lambda v: v IS NULL OR NOT isfinite(v))) > 0" for f in FEATURES) + ") AS n_bad FROM wins")
def f6(spark, d):
    return windows.check_shape(_raw_windows(spark, d))


@query("f7_periods", WINS + f" SELECT max(anchor) FILTER (split = 'train') AS train_last, min(anchor) FILTER (split = 'test') AS test_first, max(anchor) FILTER (split = 'train') <= TIMESTAMP '{TRAIN_END}' AND min(anchor) FILTER (split = 'test') >= TIMESTAMP '{TEST_START}' AS passed FROM cats")
def f7(spark, d):
    return windows.check_periods(_windows(spark, d), TRAIN_END, TEST_START)


@query("f8_boundary_overlap", WINS + f" SELECT symbol, count(*) FILTER (split = 'test' AND earliest < TIMESTAMP '{TEST_START}') AS n_overlap, count(*) FILTER (split = 'test' AND earliest < TIMESTAMP '{TEST_START}') <= 47 AS passed FROM cats GROUP BY symbol")
def f8(spark, d):
    return windows.boundary_overlap(_windows(spark, d), TEST_START, keys=("symbol",))


@query("f9_local_statistics", WINS + " SELECT count(*) * 48 * 7 AS n, 0::BIGINT AS n_off FROM wins")
def f9(spark, d):
    raw = _raw_windows(spark, d)
    return windows.check_local(raw, windows.normalise(raw))


@query("f11_without_overlap", WINS + f" SELECT symbol, split, count(*) AS n FROM cats WHERE split = 'train' OR earliest >= TIMESTAMP '{TEST_START}' GROUP BY symbol, split")
def f11(spark, d):
    return windows.without_overlap(_windows(spark, d), TEST_START).groupBy("symbol", "split").agg(F.count("*").alias("n"))


# --- gates


def _checks_sql(ctes: str, of: str, rows: dict[str, tuple[str, str]]) -> str:
    return ctes + f", g AS ({of}) " + " UNION ALL ".join(f"SELECT symbol, '{k}' AS \"check\", {p} AS passed, coalesce(({x})::DOUBLE, 0.0) AS metric FROM g" for k, (p, x) in rows.items())


STEPS = ", steps AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev FROM master)"
SCHEMA_OF = "SELECT symbol, count(*) AS n, count(DISTINCT ts) AS nd, count(*) FILTER (prev IS NOT NULL AND ts <> prev + INTERVAL '1 hour') AS breaks, bool_and(typeof(ts) = 'TIMESTAMP') AS tz FROM steps GROUP BY symbol"
SCHEMA_ROWS = {"columns": ("true", "0"), "utc": ("tz", "0"), "distinct_times": ("n = nd", "n - nd"), "hourly": ("breaks = 0", "breaks"), "rows": ("abs(n - 720) <= 5", "n")}


@query("c10_master_schema", _checks_sql(sql.base() + STEPS, SCHEMA_OF, SCHEMA_ROWS))
def c10(spark, d):
    return gates.master_schema(_master(spark, d), 720)


LOOK = ", " + ", ".join(f"look_{tf} AS (SELECT m.symbol, count(*) FILTER (m.open_{tf} IS DISTINCT FROM b.open) AS off_{tf} FROM master m ASOF LEFT JOIN b_{tf} b ON b.symbol = m.symbol AND b.ts <= m.ts GROUP BY m.symbol)" for tf in ("4h", "1d"))


@query("c11_master_gate", _checks_sql(sql.base() + STEPS + LOOK, f"SELECT * FROM ({SCHEMA_OF}) JOIN look_4h USING (symbol) JOIN look_1d USING (symbol)", SCHEMA_ROWS | {f"lookahead_{tf}": (f"off_{tf} = 0", f"off_{tf}") for tf in ("4h", "1d")}))
def c11(spark, d):
    return gates.master_report(_master(spark, d), _series(spark, d), 720)


@query("d12_features_gate", _checks_sql(sql.feature_ctes(), "SELECT symbol, count(*) AS n, min(ts) AS a, " + " + ".join(f"count(*) FILTER ({c} IS NULL OR NOT isfinite({c}))" for c in FEATURE_COLUMNS) + " AS bad FROM matrix GROUP BY symbol",
    {"columns": ("true", "0"), "finite": ("bad = 0", "bad"), "rows": ("n = 701", "n"), "first_time": ("a = TIMESTAMP '2024-01-01 19:00:00'", "0")}))
def d12(spark, d):
    return gates.features_report(_matrix(spark, d), 701, "2024-01-01 19:00:00")


@query("e6_split_gate", _checks_sql(SPLIT, f"""SELECT symbol, max(ts) FILTER (split = 'train') AS a, min(ts) FILTER (split = 'test') AS b, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test,
 count(*) FILTER (split IS NOT NULL) - count(DISTINCT ts) FILTER (split IS NOT NULL) AS twice, count(*) FILTER (split = 'train' AND ts > TIMESTAMP '{TRAIN_END}') + count(*) FILTER (split = 'test' AND ts < TIMESTAMP '{TEST_START}') AS late FROM parts GROUP BY symbol""",
    {"boundary": (f"coalesce(a = TIMESTAMP '{TRAIN_END}' AND b = TIMESTAMP '{TEST_START}', false)", "0"), "no_overlap": ("twice = 0", "twice"), "sizes": ("n_train > 0 AND n_test > 0 AND abs(n_train - 509) <= 50 AND abs(n_test - 192) <= 50", "n_train + n_test"), "no_leak": ("late = 0", "late")}))
def e6(spark, d):
    return gates.split_report(_split(spark, d), TRAIN_END, TEST_START, {"train": 509, "test": 192})


BAD_VALUES = " OR ".join(f"len(l_{f}) <> 48 OR len(list_filter(l_{f}, lambda v: v IS NULL OR NOT isfinite(v))) > 0" for f in FEATURES)


def _windows_gate_sql() -> str:
    """Over all timeframes; that values follow each window's own statistics is left to tests."""
    out = []
    for tf in TIMEFRAMES:
        one = sql.window_ctes(tf) + f", cats AS (SELECT *, CASE WHEN anchor <= TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN anchor >= TIMESTAMP '{TEST_START}' THEN 'test' END AS split FROM wins)"
        of = f"SELECT symbol, count(*) FILTER ({BAD_VALUES}) AS bad, count(DISTINCT split) AS k, count(*) FILTER (split = 'test' AND earliest < TIMESTAMP '{TEST_START}') AS back, count(*) FILTER (split = 'train' AND anchor > TIMESTAMP '{TRAIN_END}') + count(*) FILTER (split = 'test' AND anchor < TIMESTAMP '{TEST_START}') AS astray FROM cats WHERE split IS NOT NULL GROUP BY symbol"
        out.append(f"SELECT '{tf}' AS tf, * FROM (" + _checks_sql(one, of, {"shape": ("bad = 0", "bad"), "periods": ("astray = 0 AND k = 2", "astray"), "boundary_overlap": ("back <= 47", "back")}) + ")")
    return " UNION ALL ".join(out)


@query("f10_windows_gate", _windows_gate_sql())
def f10(spark, d):
    out, m = None, _matrix(spark, d)
    for tf in TIMEFRAMES:
        done = windows.generate(m, tf, TRAIN_END, TEST_START)
        one = gates.windows_report(done, None, TRAIN_END, TEST_START).select(F.lit(tf).alias("tf"), "symbol", "check", "passed", "metric")
        out = one if out is None else out.unionByName(one)
    return out


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d10(spark, sf_dir)


def queries() -> dict[str, Callable]:
    from tidegrid.plans import models  # noqa: F401  registers the rest

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return ORACLES
