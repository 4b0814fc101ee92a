"""News features as a stream: sentiment by ticker and market date, with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.news import LABELS


def daily_sentiment(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(date, ticker, news_count, sentiment_sum) of a stream of (event_id, ticker,
    ts, title, sentiment): repeats are dropped within the watermark, windows are
    market days, which end at 16:00."""
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    rows = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    day = F.window("ts", "1 day", startTime="16 hours")
    score = F.coalesce(F.try_element_at(table, F.lower("sentiment")), F.lit(0.0))
    found = rows.groupBy(day.alias("w"), "ticker").agg(F.count("title").alias("news_count"), F.sum(score).alias("sentiment_sum"))
    return found.select(F.to_date("w.end").alias("date"), "ticker", "news_count", "sentiment_sum")
