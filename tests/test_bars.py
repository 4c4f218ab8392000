import datetime

import numpy as np
import pandas as pd
import pytest

from millrace.operators import bars as B


def table(spark, closes, highs=None, lows=None):
    day = datetime.date(2024, 1, 1)
    rows = [("s", day + datetime.timedelta(i), c, (highs or closes)[i], (lows or closes)[i]) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, close double, high double, low double")


def test_exponential_mean_over_a_gap():
    got = B.exponential_mean(np.array([np.nan, 1, np.nan, 4]), 1 / 3)
    assert np.isnan(got[0]) and np.allclose(got[1:], [1, 1, 2.2857142857])


def test_relative_strength(spark):
    rising = B.with_rsi(table(spark, [float(i) for i in range(10)])).orderBy("date").toPandas()
    assert rising["RSI_6"].isna().all()  # no loss in the frame
    closes = [10.0, 9.0, 11.0, 10.0, 12.0, 13.0, 11.0, 12.0]
    got = B.with_rsi(table(spark, closes)).orderBy("date").toPandas()["RSI_6"]
    assert got[:5].isna().all() and not np.isnan(got[5])  # the first day counts as no change
    change = pd.Series(closes).diff()
    gain, loss = change.where(change > 0, 0).rolling(6).mean(), (-change.where(change < 0, 0)).rolling(6).mean()
    assert np.allclose(got[5:], (100 - 100 / (1 + gain / loss))[5:])


def test_all_indicators_against_pandas(spark):
    rng = np.random.default_rng(4)
    close = np.round(100 + rng.normal(0, 1, 80).cumsum(), 2)
    high, low = close + rng.random(80), close - rng.random(80)
    close[30:45] = high[30:45] = low[30:45] = 50.0  # a flat range gives no RSV
    got = B.with_indicators(table(spark, close.tolist(), high.tolist(), low.tolist())).orderBy("date").toPandas()
    c = pd.Series(close)
    assert np.allclose(got["MA20"], c.rolling(20).mean(), equal_nan=True)
    assert np.allclose(got["BOLL_upper"], c.rolling(20).mean() + 2 * c.rolling(20).std(), equal_nan=True)
    dif = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    assert np.allclose(got["MACD_DIF"], dif) and np.allclose(got["MACD_DEA"], dif.ewm(span=9, adjust=False).mean())
    lo, hi = pd.Series(low).rolling(9).min(), pd.Series(high).rolling(9).max()
    k = ((c - lo) / (hi - lo).replace(0, np.nan) * 100).ewm(com=2, adjust=False).mean()
    assert np.allclose(got["KDJ_K"].astype(float), k, equal_nan=True)
    d = k.ewm(com=2, adjust=False).mean()
    assert np.allclose(got["KDJ_J"].astype(float), 3 * k - 2 * d, equal_nan=True)


def test_summary(spark):
    assert B.market_summary(B.with_indicators(table(spark, [1.0] * 29))).count() == 0
    text = B.market_summary(B.with_indicators(table(spark, [1.0] * 30))).first().market_data
    lines = text.split("\n")
    assert len(lines) == 11 and lines[-1].startswith("最新技术指标: MACD_DIF=0.0000") and "RSI_6=nan" in lines[-1]
    assert lines[0].startswith("日期:2024-01-21") and "收:1.0" in lines[0]


@pytest.mark.parametrize("n, least, rows", [(3, 0, 3), (3, 6, 0), (9, 0, 5)])
def test_latest(spark, n, least, rows):
    assert B.latest(table(spark, [1.0] * 5), n, least).count() == rows
