"""Signals from each ticker's own prices, and the market they are set against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.frames import by_ticker, ratio, rolling
from panelweave.functions.shared import settle

YEAR = 252


def _change(column: str, sessions: int) -> Column:
    return ratio(column, F.lag(column, sessions).over(by_ticker())) - 1


def corwin_schultz(df: DataFrame, to: str = "cs_spread") -> DataFrame:
    """Two-day high-low spread estimate with the overnight gap taken out, floor 0."""
    by = by_ticker()
    before = F.lag("close").over(by)
    shift = F.coalesce(F.greatest(before - F.col("high"), F.lit(0.0)), F.lit(0.0)) - F.coalesce(F.greatest(F.col("low") - before, F.lit(0.0)), F.lit(0.0))
    df = df.withColumns({"_h": F.col("high") + shift, "_l": F.col("low") + shift, "_h1": F.lag("high").over(by), "_l1": F.lag("low").over(by)})
    square = lambda top, under: F.pow(F.ln(F.when(under > 0, top / under)), 2)
    beta = square(F.col("_h1"), F.col("_l1")) + square(F.col("_h"), F.col("_l"))
    gamma = F.when(F.col("_h1").isNotNull(), square(F.greatest("_h1", "_h"), F.least("_l1", "_l")))
    k = 3 - 2 * 2**0.5
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
    spread = 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))
    return df.withColumn(to, F.when(F.abs(spread) < float("inf"), F.greatest(spread, F.lit(0.0)))).drop("_h", "_l", "_h1", "_l1")


def price_features(prices: DataFrame) -> DataFrame:
    """Returns, momentum, risk and liquidity of a dense panel (ticker, date, close,
    _filled and, where present, volume, high, low). The market return is a table of
    a row a date that goes to all tasks, so all windows follow one exchange of the
    prices on the ticker, and no wide row is shuffled; the returns it is the mean of are
    taken where the calendar's windows have sorted the prices already."""
    by = by_ticker()
    prices = settle(prices.withColumn("return_1d", _change("close", 1)), "dense-prices")  # read twice
    clipped = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.col("return_1d")))
    real = F.when(~F.col("_filled"), clipped)
    market = settle(prices.groupBy("date").agg(F.avg(real).alias("market_return_1d")).withColumnRenamed("date", "_date"), "market-returns")
    df = prices.withColumns(
        {
            "return_5d": _change("close", 5),
            "return_20d": _change("close", 20),
            "momentum_60d": _change("close", 60),
            "momentum_12_1": ratio(F.lag("close", 21).over(by), F.lag("close", YEAR).over(by)) - 1,
        }
    )
    wanted = {"_mean50": ("mean", "close", 50, 50), "_top": ("max", "close", YEAR, 126), "_std20": ("std", "return_1d", 20, 20)}
    if "volume" in df.columns:
        wanted["_volume20"] = ("mean", "volume", 20, 20)
    if {"high", "low"} <= set(df.columns):
        df = corwin_schultz(df, "_spread")
        wanted["cs_spread_21d"] = ("mean", "_spread", 21, 10)
    df = rolling(df, wanted)
    df = df.withColumns({"ma_gap_50d": ratio("close", "_mean50") - 1, "high_52w": ratio("close", "_top"), "volatility_20d": F.col("_std20") * YEAR**0.5})
    if "volume" in df.columns:
        df = df.withColumn("volume_ratio_20d", ratio("volume", "_volume20"))
    df = df.withColumn("_r", real).join(F.broadcast(market), F.col("date") == F.col("_date"), "left").drop("_date")
    paired = F.col("_r").isNotNull() & F.col("market_return_1d").isNotNull()
    df = df.withColumns({"_x": F.when(paired, F.col("_r")), "_m": F.when(paired, F.col("market_return_1d"))})
    df = df.withColumns({"_xm": F.col("_x") * F.col("_m"), "_mm": F.col("_m") * F.col("_m")})
    df = rolling(df, {f"_mean{c}": ("mean", c, YEAR, 126) for c in ("_x", "_m", "_xm", "_mm")})
    mean = {c: F.col(f"_mean{c}") for c in ("_x", "_m", "_xm", "_mm")}
    spread = mean["_mm"] - mean["_m"] * mean["_m"]
    df = df.withColumn("beta_252", F.when(spread > 1e-14 * mean["_mm"], (mean["_xm"] - mean["_x"] * mean["_m"]) / spread))
    df = df.withColumn("_e", F.col("_x") - F.lag("beta_252").over(by) * F.col("_m"))
    df = rolling(df, {"_sum": ("sum", "_e", 231, 126), "_std": ("std", "_e", 231, 126), "_std63": ("std", "_e", 63, 42), "max_return_21": ("max", "_r", 21, 15)})
    risk = F.lag("_std", 21).over(by) * 231**0.5
    df = df.withColumns({"idio_vol_63": F.col("_std63") * YEAR**0.5, "residual_momentum": F.when(risk != 0, F.lag("_sum", 21).over(by) / risk)})
    return df.drop("_spread", "_mean50", "_top", "_std20", "_volume20", "_r", "_x", "_m", "_xm", "_mm", "_e", "_sum", "_std", "_std63", *[f"_mean{c}" for c in mean])
