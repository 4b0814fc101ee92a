"""Constant groups and zero prices: no query stops at a division by zero."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

DAYS = [dt.date(2024, 1, 2) + dt.timedelta(i) for i in range(3)]


def spearman(a, b):
    rank = lambda v: [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]
    x, y = rank(a), rank(b)
    mx, my = sum(x) / len(x), sum(y) / len(y)
    return sum((i - mx) * (j - my) for i, j in zip(x, y)) / (sum((i - mx) ** 2 for i in x) * sum((j - my) ** 2 for j in y)) ** 0.5


def test_information_coefficients_leave_out_constant_dates(spark):
    from panelweave.operators.stats import information_coefficients

    scores = [3.0, 1.0, 2.0, 2.0, 5.0, 4.0]
    futures = {DAYS[0]: [0.3, 0.1, 0.1, 0.2, 0.4, 0.5], DAYS[1]: [0.1] * 6, DAYS[2]: [0.2, 0.5, 0.1, 0.4, 0.3, 0.0]}
    rows = [(f"T{i}", d, s if d != DAYS[2] else 7.0, f) for d, fs in futures.items() for i, (s, f) in enumerate(zip(scores, fs))]
    got = information_coefficients(spark.createDataFrame(rows, "ticker string, date date, s double, f double"), "s", "f").collect()
    assert [(r.date, r.n) for r in got] == [(DAYS[0], 6)] and got[0].ic == pytest.approx(spearman(scores, futures[DAYS[0]]))


def test_neutral_weights_with_constant_and_repeated_exposures(spark):
    from panelweave.operators.backtest import neutral_weights

    rows = [(d, f"T{i}", 0.1 * i, 1.0 if d == DAYS[0] else float(i % 3), 2.0 * (i % 3)) for d in DAYS for i in range(8)]
    df = spark.createDataFrame(rows, "date date, ticker string, probability double, a double, b double")
    got = neutral_weights(df, ["a", "b"]).groupBy("date").agg(F.sum("w").alias("net"), F.sum(F.abs("w")).alias("gross"), F.sum(F.col("w") * F.col("b")).alias("b")).collect()
    assert len(got) == 3 and all(r.gross == pytest.approx(2.0) and abs(r.net) < 1e-9 and abs(r.b) < 1e-9 for r in got)


def test_zero_prices_give_nulls(spark):
    from panelweave.operators.labels import forward_returns
    from panelweave.operators.prices import price_features
    from panelweave.operators.universe import price_checks

    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(90)]
    rows = [("A", d, 0.0 if 10 <= i < 75 else 5.0, 0, False) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "ticker string, date date, close double, volume long, _filled boolean")
    got = {r.date: r for r in price_features(df).collect()}
    assert got[days[20]].return_5d is None and got[days[20]].volume_ratio_20d is None and got[days[70]].ma_gap_50d is None
    ahead = {r.date: r for r in forward_returns(df, horizons=(5,)).collect()}
    assert ahead[days[20]].future_return_5d is None and ahead[days[5]].future_return_5d == -1.0
    assert price_checks(df).first().rows == 90
