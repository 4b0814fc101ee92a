"""New sessions appended to the price features without reading all history again.

Every feature looks back a bounded number of sessions, so a table of the prices of
the last `DEPTH` sessions, each ticker's first date and the busiest day so far are
enough to compute the rows of the sessions that follow. They are saved beside the
panel; an append reads and rewrites only them, however long the history is.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.shared import settle
from panelweave.operators.calendar import day_counts, on_calendar, sessions
from panelweave.operators.prices import price_features
from panelweave.sources.store import read, write

#: Residual momentum looks back furthest: 21 sessions, over 231 residuals, each by a
#: beta of the 252 sessions before it; some more for gaps that prices are carried over.
DEPTH = 520


@dataclass
class State:
    """Prices of the last sessions, (ticker, first) of all tickers ever priced, the
    last session whose rows are out, and the most prices of a day so far."""

    recent: DataFrame
    known: DataFrame
    upto: date | None
    busiest: int

    def save(self, root: str) -> None:
        spark = self.recent.sparkSession
        write(self.recent, f"{root}/recent")
        write(self.known, f"{root}/known")
        write(spark.createDataFrame([(self.upto, self.busiest)], "upto date, busiest long"), f"{root}/progress")

    @staticmethod
    def load(spark: SparkSession, root: str) -> State | None:
        progress = read(spark, f"{root}/progress")
        if progress is None:
            return None
        row = progress.first()
        return State(read(spark, f"{root}/recent"), read(spark, f"{root}/known"), row.upto, row.busiest)


def append(state: State | None, prices: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, State]:
    """(feature rows of the sessions after `state`, the state after them). Prices of
    dates that are out already are left aside; without a state all sessions are new.
    Rows equal those of the whole history up to rounding; split factors are carried
    over gaps of up to `depth` sessions."""
    if state is None:
        rows = settle(prices, "recent-prices")  # read by each step below
        known, busiest = rows.select("ticker", F.col("date").alias("first")), 0
    else:
        new = prices.filter(F.col("date") > F.lit(state.upto)) if state.upto is not None else prices
        rows = settle(state.recent.unionByName(new, allowMissingColumns=True), "recent-prices")
        known, busiest = state.known.unionByName(rows.select("ticker", F.col("date").alias("first"))), state.busiest
    known = settle(known.groupBy("ticker").agg(F.min("first").alias("first")), "known-tickers")
    counts = settle(day_counts(rows), "day-counts")
    calendar = sessions(counts, busiest=busiest)
    features = price_features(on_calendar(rows, known=known, days=calendar))
    days = [r.date for r in calendar.orderBy("date").collect()]  # a row a date, `depth` and the new ones
    most = counts.agg(F.max("n")).first()[0] or 0
    if not days:
        return features, State(rows, known, None if state is None else state.upto, max(busiest, most))
    if state is not None and state.upto is not None:
        features = features.filter(F.col("date") > F.lit(state.upto))
    kept = rows.filter(F.col("date") >= F.lit(days[max(0, len(days) - depth)]))
    return features, State(kept, known, days[-1], max(busiest, most))
