"""Daily bars and technical indicators, one table for all symbols.

Rolling values are windows over a symbol's days, null until the frame is full. The recursive ones (exponential means)
run in one pass over each symbol's days in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bars_of(ticks: DataFrame, symbol: Column, at: Column, value: Column, tie: Column, unit: str = "day") -> DataFrame:
    """(symbol, date, open, high, low, close, volume) of each unit of time; ties in time are broken by ``tie``."""
    day = F.date_trunc(unit, at).cast("date")
    order = F.struct(at, tie)
    return ticks.groupBy(symbol.alias("symbol"), day.alias("date")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def weekly(bars: DataFrame) -> DataFrame:
    """Bars by week (an addition: the original gets weekly bars from its source)."""
    return bars.groupBy("symbol", F.date_trunc("week", "date").cast("date").alias("week")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume")
    )


def _frame(n: int):
    return Window.partitionBy("symbol").orderBy("date").rowsBetween(1 - n, 0)


def _full(value: Column, of: Column, n: int) -> Column:
    return F.when(F.count(of).over(_frame(n)) == n, value)


def moving_average(n: int, c: str = "close") -> Column:
    return _full(F.avg(c).over(_frame(n)), F.col(c), n)


def with_moving_averages(bars: DataFrame, sizes: tuple[int, ...] = (5, 10, 20, 60)) -> DataFrame:
    return bars.withColumns({f"MA{n}": moving_average(n) for n in sizes})


def with_bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Mean of n closes, and two sample deviations around it."""
    mid, spread = moving_average(n), _full(F.stddev_samp("close").over(_frame(n)), F.col("close"), n)
    return bars.withColumns({"BOLL_mid": mid, "BOLL_upper": mid + spread * width, "BOLL_lower": mid - spread * width})


def with_rsi(bars: DataFrame, sizes: tuple[int, ...] = (6, 12, 24)) -> DataFrame:
    """From simple means of gains and losses; the first day counts as no change, no loss in the frame gives null."""
    change = F.col("close") - F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    moved = bars.withColumns({"_gain": F.when(change > 0, change).otherwise(0.0), "_loss": F.when(change < 0, -change).otherwise(0.0)})
    out = {}
    for n in sizes:
        gain, loss = F.avg("_gain").over(_frame(n)), F.avg("_loss").over(_frame(n))
        out[f"RSI_{n}"] = _full(100 - 100 / (1 + F.try_divide(gain, F.when(F.max("_loss").over(_frame(n)) > 0, loss))), F.col("_gain"), n)
    return moved.withColumns(out).drop("_gain", "_loss")


def with_rsv(bars: DataFrame, n: int = 9) -> DataFrame:
    low, high = F.min("low").over(_frame(n)), F.max("high").over(_frame(n))
    value = F.try_divide(F.col("close") - low, F.nullif(high - low, F.lit(0.0))) * 100
    return bars.withColumn("RSV", F.when((F.count("low").over(_frame(n)) == n) & (F.count("high").over(_frame(n)) == n), value))


def exponential_mean(values: np.ndarray, alpha: float) -> np.ndarray:
    """Recursive mean seeded with the first value. After gaps the old mean's weight has decayed by their length; a gap itself repeats it."""
    return pd.Series(values).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def _recursive(parts: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
    df = parts.sort_values("date")
    close, rsv = df["close"].to_numpy(float), df["RSV"].to_numpy(float)
    df["MACD_DIF"] = exponential_mean(close, 2 / 13) - exponential_mean(close, 2 / 27)
    df["MACD_DEA"] = exponential_mean(df["MACD_DIF"].to_numpy(), 2 / 10)
    df["MACD_HIST"] = 2 * (df["MACD_DIF"] - df["MACD_DEA"])
    df["KDJ_K"] = exponential_mean(rsv, 1 / 3)
    df["KDJ_D"] = exponential_mean(df["KDJ_K"].to_numpy(), 1 / 3)
    df["KDJ_J"] = 3 * df["KDJ_K"] - 2 * df["KDJ_D"]
    return df[["symbol", "date", "MACD_DIF", "MACD_DEA", "MACD_HIST", "KDJ_K", "KDJ_D", "KDJ_J"]].replace({np.nan: None})


def recursive_indicators(bars: DataFrame) -> DataFrame:
    """(symbol, date, MACD_DIF, MACD_DEA, MACD_HIST, KDJ_K, KDJ_D, KDJ_J). A group is one symbol's days."""
    schema = "symbol string, date date, MACD_DIF double, MACD_DEA double, MACD_HIST double, KDJ_K double, KDJ_D double, KDJ_J double"
    return with_rsv(bars).select("symbol", "date", "close", "RSV").groupBy("symbol").applyInPandas(_recursive, schema)


def with_indicators(bars: DataFrame) -> DataFrame:
    """All sixteen columns."""
    rolling = with_bollinger(with_rsi(with_moving_averages(bars)))
    return rolling.join(recursive_indicators(bars), ["symbol", "date"])


def latest(bars: DataFrame, n: int, least: int = 0) -> DataFrame:
    """The last n days of each symbol that has ``least`` days, with ``back`` (1: the last day)."""
    whole = Window.partitionBy("symbol")
    ranked = bars.withColumn("back", F.row_number().over(whole.orderBy(F.desc("date"))))
    return ranked.withColumn("_n", F.count(F.lit(1)).over(whole)).filter((F.col("_n") >= least) & (F.col("back") <= n)).drop("_n")


def market_summary(indicated: DataFrame, shown: int = 10, least: int = 30) -> DataFrame:
    """(symbol, market_data): the last days' lines and the last day's indicators; symbols with fewer than ``least`` days have none."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in indicated.columns else F.lit("")
    line = F.concat(
        F.lit("日期:"), show("date"), F.lit(", 开:"), show("open"), F.lit(", 高:"), show("high"), F.lit(", 低:"), show("low"), F.lit(", 收:"), show("close"),
        F.lit(", 量:"), show("volume"), F.lit(", 涨跌幅:"), show("pct_change"), F.lit("%"),
    )
    last = latest(indicated, shown, least)
    number = lambda c, digits: F.when(F.col(c).isNull(), "nan").otherwise(F.format_string(f"%.{digits}f", c))
    parts = [F.concat(F.lit(f"{c}="), number(c, 4 if c.startswith("MACD") else 2)) for c in ("MACD_DIF", "MACD_DEA", "RSI_6", "RSI_12", "KDJ_K", "KDJ_D", "KDJ_J")]
    footer = F.concat(F.lit("\n最新技术指标: "), F.concat_ws(", ", *parts))
    lines = last.withColumns({"_line": line, "_footer": footer}).groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("date", "_line"))).alias("l"), F.max_by("_footer", "date").alias("f")
    )
    return lines.select("symbol", F.concat(F.array_join(F.transform("l", lambda x: x["_line"]), "\n"), "f").alias("market_data"))
