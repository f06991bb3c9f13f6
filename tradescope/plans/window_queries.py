"""Queries of window functions, forecasting and market analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradescope.operators import forecasts as C
from tradescope.operators import ordered as O
from tradescope.operators import peaks as P
from tradescope.operators import joins
from tradescope.operators import windows as W
from tradescope.registry import query


def r(c, digits=6):
    return F.round(c, digits)


def rows():
    return F.count(F.lit(1))


def months(t):
    """Amount per company and month."""
    return t("records").groupBy("company_id", F.date_trunc("month", "date").cast("date").alias("month")).agg(F.round(F.sum("amount"), 4).alias("amount"))


_MONTHS = "months AS (SELECT company_id, CAST(date_trunc('month', date) AS DATE) AS month, round(sum(amount), 4) AS amount FROM records GROUP BY 1, 2)"
_SERIES = "series AS (SELECT ascii(substr(country_code, 2, 1)) - 65 AS id, date, round(sum(amount), 4) AS amount FROM records GROUP BY 1, 2)"


def series(t):
    """Amount of each country and day; countries are numbered from 0."""
    return t("records").groupBy((F.ascii(F.substring("country_code", 2, 1)) - 65).alias("id"), "date").agg(F.round(F.sum("amount"), 4).alias("amount"))


@query(
    "win01_value_spikes",
    f"""WITH {_MONTHS} SELECT company_id, month, round(amount / lag(amount) OVER w - 1, 6) AS change FROM months WINDOW w AS (PARTITION
    BY company_id ORDER BY month) QUALIFY amount / lag(amount) OVER w - 1 > 1""",
)
def win01(t):
    m = months(t).withColumn("change", W.change("amount", W.ordered(["company_id"], ["month"])))
    return m.filter("change > 1").select("company_id", "month", r(F.col("change")).alias("change"))


@query(
    "win02_lags",
    f"""WITH {_SERIES} SELECT id, date, lag(amount, 1) OVER w AS l1, lag(amount, 7) OVER w AS l7, lag(amount, 30) OVER w AS l30 FROM
    series WINDOW w AS (PARTITION BY id ORDER BY date)""",
)
def win02(t):
    w = W.ordered(["id"], ["date"])
    return series(t).select("id", "date", *[F.lag("amount", n).over(w).alias(f"l{n}") for n in (1, 7, 30)])


@query(
    "win03_rolling_7",
    f"""WITH {_SERIES} SELECT id, date, CASE WHEN count(*) OVER w = 7 THEN round(avg(amount) OVER w, 4) END AS mean7, CASE WHEN count(*)
    OVER w = 7 THEN round(stddev_samp(amount) OVER w, 3) END AS std7 FROM series WINDOW w AS (PARTITION BY id ORDER BY date
    ROWS 6 PRECEDING)""",
)
def win03(t):
    w = W.last_n(["id"], ["date"], 7)
    return series(t).select("id", "date", W.full(r(F.avg("amount").over(w), 4), w, 7).alias("mean7"),
        W.full(r(F.stddev_samp("amount").over(w), 3), w, 7).alias("std7"))


@query(
    "win04_sma_bollinger",
    """SELECT symbol, ts::DATE AS day, hour(ts) AS hour, CASE WHEN count(*) OVER a = 20 THEN round(avg(close) OVER a, 6) END AS
    sma20, CASE WHEN count(*) OVER b = 50 THEN round(avg(close) OVER b, 6) END AS sma50, CASE WHEN count(*) OVER a = 20 THEN
    round(avg(close) OVER a + 2 * stddev_samp(close) OVER a, 6) END AS upper FROM bars WINDOW a AS (PARTITION BY symbol ORDER
    BY ts ROWS 19 PRECEDING), b AS (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING)""",
)
def win04(t):
    a, b = W.last_n(["symbol"], ["ts"], 20), W.last_n(["symbol"], ["ts"], 50)
    c = F.col("close")
    return t("bars").select("symbol", F.col("ts").cast("date").alias("day"), F.hour("ts").alias("hour"), W.full(r(F.avg(c).over(a)),
        a, 20).alias("sma20"), W.full(r(F.avg(c).over(b)), b, 50).alias("sma50"), W.full(r(F.avg(c).over(a) + 2 * F.stddev_samp(c).over(a)),
        a, 20).alias("upper"))


_RSI = "d AS (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars), rsi AS (SELECT symbol, ts, CASE WHEN count(d) OVER w = 14 THEN 100 - 100 / (1 + avg(greatest(d, 0)) OVER w / nullif(avg(greatest(-d, 0)) OVER w, 0)) END AS rsi FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING))"


def with_rsi(t):
    w, o = W.last_n(["symbol"], ["ts"], 14), W.ordered(["symbol"], ["ts"])
    d = t("bars").withColumn("d", F.col("close") - F.lag("close").over(o))
    up, down = F.avg(F.greatest("d", F.lit(0.0))).over(w), F.avg(F.greatest(-F.col("d"), F.lit(0.0))).over(w)
    known = F.count("d").over(w) == 14
    return d.withColumn("rsi", F.when(known, 100 - 100 / (1 + up / F.nullif(down, F.lit(0.0)))))


@query("win05_rsi", f"WITH {_RSI} SELECT symbol, epoch_ms(ts) // 1000 AS at, round(rsi, 4) AS rsi FROM rsi")
def win05(t):
    return with_rsi(t).select("symbol", F.unix_timestamp("ts").alias("at"), r(F.col("rsi"), 4).alias("rsi"))


@query(
    "win06_macd",
    """WITH b AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars) SELECT a.symbol,
    epoch_ms(a.ts) // 1000 AS at, round(sum(b.close * pow(11.0 / 13, a.i - b.i)) / sum(pow(11.0 / 13, a.i - b.i)) - sum(b.close
    * pow(25.0 / 27, a.i - b.i)) / sum(pow(25.0 / 27, a.i - b.i)), 6) AS macd FROM b a JOIN b ON a.symbol = b.symbol AND
    b.i <= a.i GROUP BY 1, 2""",
)
def win06(t):
    x = O.ewm_means(t("bars").select("symbol", "ts", "close"), ["symbol"], ["ts"], "close", (12, 26))
    return x.select("symbol", F.unix_timestamp("ts").alias("at"), r(F.col("ewm_12") - F.col("ewm_26")).alias("macd"))


@query("win07_lead_target", "SELECT symbol, epoch_ms(ts) // 1000 AS at, lead(close, 3) OVER (PARTITION BY symbol ORDER BY ts) AS target FROM bars")
def win07(t):
    return t("bars").select("symbol", F.unix_timestamp("ts").alias("at"), F.lead("close", 3).over(W.ordered(["symbol"], ["ts"])).alias("target"))


@query(
    "win08_fill",
    """WITH b AS (SELECT symbol, ts, CASE WHEN volume > 2 THEN close END AS c FROM bars) SELECT symbol, epoch_ms(ts) // 1000 AS
    at, coalesce(first_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED
    FOLLOWING), last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS filled FROM
    b""",
)
def win08(t):
    b = t("bars").withColumn("c", F.when(F.col("volume") > 2, F.col("close")))
    return b.select("symbol", F.unix_timestamp("ts").alias("at"), W.fill("c", W.ordered(["symbol"], ["ts"])).alias("filled"))


@query(
    "win09_trend_slope",
    f"""WITH {_MONTHS}, k AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY month DESC) AS k FROM months) SELECT
    company_id, round(regr_slope(amount, 10 - k), 4) AS slope, CASE WHEN regr_slope(amount, 10 - k) > 1000 THEN 'rising'
    WHEN regr_slope(amount, 10 - k) < -1000 THEN 'falling' ELSE 'stable' END AS trend, round(stddev_samp(amount), 3) AS volatility
    FROM k WHERE k <= 10 GROUP BY 1""",
)
def win09(t):
    g = W.recent(months(t), ["company_id"], ["month"], 10).groupBy("company_id").agg(F.regr_slope("amount", 10 - F.col("k")).alias("s"),
        r(F.stddev_samp("amount"), 3).alias("volatility"))
    return g.select("company_id", r(F.col("s"), 4).alias("slope"), F.when(F.col("s") > 1000, "rising").when(F.col("s") < -1000,
        "falling").otherwise("stable").alias("trend"), "volatility")


@query(
    "win10_recent_against_previous",
    f"""WITH {_MONTHS}, k AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY month DESC) AS k FROM months) SELECT
    company_id, round(avg(amount) FILTER (WHERE k <= 10) / avg(amount) FILTER (WHERE k BETWEEN 11 AND 20) - 1, 6) AS change
    FROM k WHERE k <= 20 GROUP BY 1""",
)
def win10(t):
    k = F.col("k")
    g = W.recent(months(t), ["company_id"], ["month"], 20).groupBy("company_id")
    return g.agg(r(F.avg(F.when(k <= 10, F.col("amount"))) / F.avg(F.when(k > 10, F.col("amount"))) - 1).alias("change"))


@query(
    "win11_count_last_hour",
    """SELECT transaction_id, n FROM (SELECT transaction_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL
    1 HOUR PRECEDING AND CURRENT ROW) AS n FROM transactions) WHERE n > 1""",
)
def win11(t):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-3_600_000_000, 0)
    return t("transactions").select("transaction_id", rows().over(w).alias("n")).filter("n > 1")


@query(
    "win12_last_3_against_earlier",
    f"""WITH {_MONTHS}, k AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY month DESC) AS k FROM months) SELECT
    company_id, round(avg(amount) FILTER (WHERE k <= 3) / avg(amount) FILTER (WHERE k > 3) - 1, 6) AS change FROM k GROUP
    BY 1 HAVING abs(avg(amount) FILTER (WHERE k <= 3) / avg(amount) FILTER (WHERE k > 3) - 1) > 0.2""",
)
def win12(t):
    k = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("month")))
    g = months(t).withColumn("k", k).groupBy("company_id").agg((F.avg(F.when(F.col("k") <= 3,
        F.col("amount"))) / F.avg(F.when(F.col("k") > 3, F.col("amount"))) - 1).alias("c"))
    return g.filter("abs(c) > 0.2").select("company_id", r(F.col("c")).alias("change"))


@query(
    "win13_first_difference_outliers",
    """WITH d AS (SELECT symbol, ts, abs(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS d FROM bars), s AS (SELECT
    symbol, avg(d) + 2 * stddev_pop(d) AS cut FROM d GROUP BY 1) SELECT symbol, epoch_ms(ts) // 1000 AS at, round(d, 6) AS
    jump FROM d JOIN s USING (symbol) WHERE d > cut""",
)
def win13(t):
    d = t("bars").withColumn("d", F.abs(F.col("close") - F.lag("close").over(W.ordered(["symbol"], ["ts"]))))
    d = joins.map_back(d, "symbol", (F.avg("d") + 2 * F.stddev_pop("d")).alias("cut"))
    return d.filter("d > cut").select("symbol", F.unix_timestamp("ts").alias("at"), r(F.col("d")).alias("jump"))


@query("win14_peaks")
def win14(t):
    """Peaks and valleys of closing prices by symbol, and of all prices in time as one series."""
    b = t("bars").select("symbol", F.unix_timestamp("ts").alias("at"), "close", (-F.col("close")).alias("down"))
    every = t("events").select(F.lit("all").alias("symbol"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("value").alias("close"), (-F.col("value")).alias("down"))
    x = b.unionByName(every)
    found = [P.find_peaks(x, ["symbol"], ["at", "close"], c).select("symbol", "at", "close", F.lit(kind).alias("kind"), r(F.col("prominence")).alias("prominence")) for c,
        kind in (("close", "peak"), ("down", "valley"))]
    return found[0].unionByName(found[1])


@query(
    "win15_category_cap",
    """SELECT user_id, event_id, category FROM (SELECT * FROM interactions QUALIFY row_number() OVER (PARTITION BY user_id, category
    ORDER BY price DESC, event_id) <= 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY price DESC, event_id) <=
    10""",
)
def win15(t):
    return W.capped(t("interactions"), ["user_id"], "category", [F.desc("price"), F.col("event_id")], 2, 10).select("user_id", "event_id", "category")


@query(
    "win16_linear_weighted_baseline",
    f"""WITH {_MONTHS} SELECT company_id, round(sum(amount * i) / sum(i), 4) AS baseline FROM (SELECT *, row_number() OVER (PARTITION
    BY company_id ORDER BY month) AS i FROM months) GROUP BY 1""",
)
def win16(t):
    i = F.row_number().over(W.ordered(["company_id"], ["month"]))
    return months(t).withColumn("i", i).groupBy("company_id").agg(r(F.sum(F.col("amount") * F.col("i")) / F.sum("i"), 4).alias("baseline"))


@query(
    "win17_mean_gap",
    """SELECT user_id, count(*) AS hits, round(avg(gap), 3) AS mean_gap FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts))
    OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events) GROUP BY 1 HAVING count(*) > 10 AND avg(gap)
    < 40000""",
)
def win17(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = t("events").withColumn("us", us).withColumn("gap", (F.col("us") - F.lag("us").over(W.ordered(["user_id"], ["us", "event_id"]))) / 1e6)
    return e.groupBy("user_id").agg(rows().alias("hits"), F.avg("gap").alias("g")).filter("hits > 10 AND g < 40000").select("user_id",
        "hits", r(F.col("g"), 3).alias("mean_gap"))


@query(
    "win18_ratio_to_group",
    """SELECT pk, round(amount / avg(amount) OVER (PARTITION BY hs_code), 6) AS ratio, round((amount - avg(amount) OVER (PARTITION
    BY hs_code)) / stddev_samp(amount) OVER (PARTITION BY hs_code), 6) AS z FROM records""",
)
def win18(t):
    x = joins.map_back(t("records"), "hs_code", F.avg("amount").alias("m"), F.stddev_samp("amount").alias("d"))
    return x.select("pk", r(F.col("amount") / F.col("m")).alias("ratio"), r((F.col("amount") - F.col("m")) / F.col("d")).alias("z"))


@query(
    "win19_comparable_rows",
    """SELECT pk, round(sum(amount) OVER w, 4) AS total, count(*) OVER w AS n, CASE WHEN stddev_pop(amount) OVER w > 0 AND count(*)
    OVER w > 2 THEN abs(amount - avg(amount) OVER w) > 2 * stddev_pop(amount) OVER w END AS deviates FROM records WINDOW
    w AS (PARTITION BY hs_code, company_id ORDER BY date, pk ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
)
def win19(t):
    w = W.last_n(["hs_code", "company_id"], ["date", "pk"], 20, current=False)
    m, s, n = F.avg("amount").over(w), F.stddev_pop("amount").over(w), rows().over(w)
    return t("records").select("pk", r(F.sum("amount").over(w), 4).alias("total"), n.alias("n"), F.when((s > 0) & (n > 2),
        F.abs(F.col("amount") - m) > 2 * s).alias("deviates"))


@query(
    "win20_returns_volatility",
    """WITH p AS (SELECT symbol, ts, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars) SELECT
    symbol, round(stddev_samp(ret) * sqrt(252), 6) AS volatility, round(arg_max(close, ts) / arg_min(close, ts) - 1, 6) AS
    total_return FROM p GROUP BY 1""",
)
def win20(t):
    p = t("bars").withColumn("ret", W.change("close", W.ordered(["symbol"], ["ts"])))
    return p.groupBy("symbol").agg(r(F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("volatility"), r(F.max_by("close",
        "ts") / F.min_by("close", "ts") - 1).alias("total_return"))


@query(
    "win21_sector_tier",
    """SELECT symbol, CASE WHEN arg_max(close, ts) / arg_min(close, ts) - 1 > 0.05 THEN 'growing' WHEN arg_max(close, ts) / arg_min(close,
    ts) - 1 < -0.05 THEN 'shrinking' ELSE 'stable' END AS tier FROM bars GROUP BY 1""",
)
def win21(t):
    g = t("bars").groupBy("symbol").agg((F.max_by("close", "ts") / F.min_by("close", "ts") - 1).alias("x"))
    return g.select("symbol", F.when(F.col("x") > 0.05, "growing").when(F.col("x") < -0.05, "shrinking").otherwise("stable").alias("tier"))


@query("win22_history_tail", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def win22(t):
    return W.recent(t("events"), ["user_id"], ["ts", "event_id"], 50).select("user_id", "event_id")


@query(
    "win23_ordered_split",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= floor(0.8 * count(*) OVER (PARTITION
    BY user_id)) AS train FROM events""",
)
def win23(t):
    n = rows().over(Window.partitionBy("user_id"))
    return t("events").select("user_id", "event_id", (F.row_number().over(W.ordered(["user_id"], ["ts", "event_id"])) <= F.floor(0.8 * n)).alias("train"))


_RUNS = "x AS (SELECT *, event_type IN ('error', 'click') AS hit FROM events), y AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM x), runs AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM y)"


def failure_runs(t):
    return W.runs_of(t("events"), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("error", "click"))


@query(
    "win24_failure_runs",
    f"""WITH {_RUNS} SELECT event_id, CAST(run AS BIGINT) AS run, CASE WHEN run >= 5 THEN 'high' ELSE 'medium' END AS level FROM
    runs WHERE run >= 3""",
)
def win24(t):
    return failure_runs(t).filter("run >= 3").select("event_id", "run", F.when(F.col("run") >= 5, "high").otherwise("medium").alias("level"))


@query(
    "win25_moving_anomaly",
    """SELECT symbol, epoch_ms(ts) // 1000 AS at FROM (SELECT symbol, ts, close, avg(close) OVER w AS m, stddev_samp(close) OVER
    w AS s, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING)) WHERE n > 10 AND abs(close - m) > 2 * s""",
)
def win25(t):
    w = W.ordered(["symbol"], ["ts"]).rowsBetween(Window.unboundedPreceding, -1)
    b = t("bars").withColumns({"m": F.avg("close").over(w), "s": F.stddev_samp("close").over(w), "n": rows().over(w)})
    return b.filter("n > 10 AND abs(close - m) > 2 * s").select("symbol", F.unix_timestamp("ts").alias("at"))


@query(
    "win26_trailing_mean",
    """SELECT symbol, epoch_ms(ts) // 1000 AS at, round(avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING), 6)
    AS usage FROM bars""",
)
def win26(t):
    return t("bars").select("symbol", F.unix_timestamp("ts").alias("at"), r(F.avg("volume").over(W.last_n(["symbol"], ["ts"], 10))).alias("usage"))


@query(
    "win27_last_50_pattern",
    """WITH k AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50) SELECT
    user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, arg_max(value, (ts, event_id)) > arg_min(value,
    (ts, event_id)) AS improving FROM k GROUP BY 1""",
)
def win27(t):
    at = F.struct("ts", "event_id")
    return W.recent(t("events"), ["user_id"], ["ts", "event_id"], 50).groupBy("user_id").agg(r(F.avg("value")).alias("mean"),
        r(F.stddev_pop("value")).alias("deviation"), (F.max_by("value", at) > F.min_by("value", at)).alias("improving"))


@query(
    "fcs04_accuracy",
    f"""WITH {_SERIES}, p AS (SELECT id, amount, lag(amount, 7) OVER (PARTITION BY id ORDER BY date) AS f FROM series) SELECT id,
    round(avg(abs(amount - f)), 4) AS mae, round(sqrt(avg((amount - f) * (amount - f))), 4) AS rmse, round(100 * avg(abs(amount
    - f) / amount), 6) AS mape, round(avg(f - amount), 4) AS bias, round(greatest(0, 100 - 100 * avg(abs(amount - f) / amount)),
    6) AS accuracy FROM p WHERE f IS NOT NULL GROUP BY 1""",
)
def fcs04(t):
    p = series(t).withColumn("f", F.lag("amount", 7).over(W.ordered(["id"], ["date"]))).filter("f IS NOT NULL")
    e = F.col("amount") - F.col("f")
    mape = 100 * F.avg(F.abs(e) / F.col("amount"))
    return p.groupBy("id").agg(r(F.avg(F.abs(e)), 4).alias("mae"), r(F.sqrt(F.avg(e * e)), 4).alias("rmse"), r(mape).alias("mape"),
        r(F.avg(-e), 4).alias("bias"), r(F.greatest(F.lit(0.0), 100 - mape)).alias("accuracy"))


_SIGNAL = f"""{_RSI}, f AS (SELECT b.symbol, b.ts, b.close, b.volume, rsi, CASE WHEN count(*) OVER a = 20 THEN avg(close) OVER a END AS s20, CASE WHEN count(*) OVER c = 50 THEN avg(close) OVER c END AS s50,
    CASE WHEN count(*) OVER a = 20 THEN stddev_samp(close) OVER a END AS sd FROM bars b JOIN rsi ON rsi.symbol = b.symbol AND rsi.ts = b.ts
    WINDOW a AS (PARTITION BY b.symbol ORDER BY b.ts ROWS 19 PRECEDING), c AS (PARTITION BY b.symbol ORDER BY b.ts ROWS 49 PRECEDING)),
    sig AS (SELECT *, coalesce(nullif(concat_ws(', ', CASE WHEN rsi < 30 THEN 'oversold' WHEN rsi > 70 THEN 'overbought' END,
    CASE WHEN close > s20 AND s20 > s50 THEN 'golden_cross' WHEN close < s20 AND s20 < s50 THEN 'death_cross' END,
    CASE WHEN close > s20 + 2 * sd THEN 'breakout_upper' WHEN close < s20 - 2 * sd THEN 'breakout_lower' END), ''), 'neutral') AS signal FROM f)"""


def signals(t):
    """Bars with their indicators and signal."""
    a, b = W.last_n(["symbol"], ["ts"], 20), W.last_n(["symbol"], ["ts"], 50)
    c = F.col("close")
    x = with_rsi(t).withColumns({"s20": W.full(F.avg(c).over(a), a, 20), "s50": W.full(F.avg(c).over(b), b, 50), "sd": W.full(F.stddev_samp(c).over(a), a, 20)})
    s20, wide = F.col("s20"), 2 * F.col("sd")
    return x.withColumn("signal", C.technical_signal(c, F.col("rsi"), s20, F.col("s50"), s20 + wide, s20 - wide))


@query("fcs07_technical_signal", f"WITH {_SIGNAL} SELECT symbol, epoch_ms(ts) // 1000 AS at, signal FROM sig")
def fcs07(t):
    return signals(t).select("symbol", F.unix_timestamp("ts").alias("at"), "signal")


@query(
    "fcs08_overall_rating",
    f"""WITH {_SIGNAL}, z AS (SELECT symbol, date_trunc('day', ts) AS day, arg_max(signal, ts) AS signal, arg_max(close, ts) / 20 AS pe, avg(close) / 250 - 1 AS mood,
    100 * (arg_max(s20, ts) / arg_max(s50, ts) - 1) AS change FROM sig GROUP BY 1, 2),
    p AS (SELECT symbol, day, CASE WHEN contains(signal, 'golden_cross') THEN 20 WHEN contains(signal, 'oversold') THEN 15 ELSE 0 END
    + CASE WHEN pe >= 10 AND pe <= 25 THEN 20 WHEN pe <> 0 AND pe < 15 THEN 15 ELSE 0 END + CASE WHEN mood > 0.1 THEN 20 WHEN mood > -0.1 THEN 10 ELSE 0 END
    + CASE WHEN change > 10 THEN 20 WHEN change > 0 THEN 10 ELSE 0 END AS points FROM z)
    SELECT symbol, strftime(day, '%Y-%m-%d') AS day, points, CASE WHEN points >= 70 THEN 'strong_buy' WHEN points >= 50 THEN 'buy' WHEN points >= 30 THEN 'hold' ELSE 'sell' END AS rating FROM p""",
)
def fcs08(t):
    """A rating for each symbol and day: the last signal, a price ratio, the day's mean against the middle price, and the averages' slope."""
    last = lambda c: F.max_by(c, "ts")
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts")))
    z = signals(t).groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(last("signal").alias("signal"), (last("close") / 20).alias("pe"),
        (F.avg("close") / 250 - 1).alias("mood"), (100 * (known("s20") / known("s50") - 1)).alias("change"))
    points = C.rating_points(F.col("signal"), F.col("pe"), F.col("mood"), F.col("change"))
    return z.select("symbol", F.date_format("day", "yyyy-MM-dd").alias("day"), points.alias("points"), C.rating(points).alias("rating"))


@query(
    "fcs10_opportunities",
    """WITH m AS (SELECT hs_code, avg(amount) FILTER (WHERE year(date) = 2000) AS a, avg(amount) FILTER (WHERE year(date) = 1999)
    AS b FROM records GROUP BY 1) SELECT hs_code, round(100 * (a / b - 1), 6) AS expected FROM m WHERE 100 * (a / b - 1)
    > 2""",
)
def fcs10(t):
    y = F.year("date")
    g = t("records").groupBy("hs_code").agg((100 * (F.avg(F.when(y == 2000, F.col("amount"))) / F.avg(F.when(y == 1999, F.col("amount"))) - 1)).alias("e"))
    return g.filter("e > 2").select("hs_code", r(F.col("e")).alias("expected"))
