"""Session calendar: dense rows for every ticker, bounded forward fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.frames import by_ticker

SESSION_SHARE = 0.2
FILL_SESSIONS = 5


def day_counts(prices: DataFrame) -> DataFrame:
    """(date, n): how many tickers traded on each date."""
    return prices.groupBy("date").agg(F.count_distinct("ticker").alias("n"))


def session_calendar(prices: DataFrame, share: float = SESSION_SHARE) -> DataFrame:
    """(date, session_no): dates on which at least `share` of the busiest day so far traded."""
    return sessions(day_counts(prices), share)


def sessions(counts: DataFrame, share: float = SESSION_SHARE, busiest: int = 0) -> DataFrame:
    """The calendar of `day_counts`; `busiest` is what the busiest day before their first had."""
    so_far = F.max("n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    open_days = counts.withColumn("most", F.greatest(so_far, F.lit(busiest))).filter(F.col("n") >= share * F.col("most"))
    return open_days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("session_no"))


def session_grid(prices: DataFrame, known: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """(ticker, date): the rows of `on_calendar`."""
    spans = prices.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    if known is not None:
        before = known.select("ticker", F.col("first").alias("_first"))
        spans = spans.join(before, "ticker", "left").withColumn("first", F.least("first", "_first")).drop("_first")
    days = F.broadcast((session_calendar(prices) if days is None else days).select("date"))
    return spans.join(days, F.col("date").between(F.col("first"), F.col("last"))).select("ticker", "date")


def on_calendar(prices: DataFrame, fill: int = FILL_SESSIONS, known: DataFrame | None = None, days: DataFrame | None = None, grid: DataFrame | None = None) -> DataFrame:
    """A row for each session between a ticker's first and last price; `known`
    (ticker, first) names tickers with prices before the table begins; `days` is
    the calendar, where it is known already; `grid` is the `session_grid`, where more
    columns lie beside it that go with the prices.

    Missing sessions are flagged `_filled`; closes are carried at most `fill`
    sessions and split factors without limit. The calendar has one row a date,
    so it is broadcast to the tickers' spans.
    """
    dense = (session_grid(prices, known, days) if grid is None else grid).join(prices.withColumn("_real", F.lit(True)), ["ticker", "date"], "left")
    dense = dense.withColumn("_filled", F.col("_real").isNull()).drop("_real")
    carried = {c: F.last(c, ignorenulls=True).over(by_ticker().rowsBetween(-fill, 0)) for c in ("close", "raw_close") if c in dense.columns}
    if "split_factor" in dense.columns:
        carried["split_factor"] = F.last("split_factor", ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    return dense.withColumns(carried)


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last by `order`."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_at", at).filter("_at = 1").drop("_at")
