"""Headline sentiment and news features, in built-in functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.frames import roll
from panelweave.operators.asof import to_next_session

# Word lists of the finance lexicon, and labels of scored feeds.
POSITIVE = """
beat beats exceeded exceeds exceeding outperform outperformed outperforms strong stronger strongest growth grew gain gains
gained raises raised raise upgrade upgraded upgrades bullish record surge surged surges rally rallied rallies jump jumped
soar soared soars profitable profitability improve improved improvement improves improving expand expands expanded expansion
boost boosted boosts approval approved wins won award awarded breakthrough robust rebound rebounded rebounds optimistic upbeat
accelerate accelerated accelerating tops topped favorable success successful efficiency upside momentum outpaced
""".split()
NEGATIVE = """
miss misses missed weak weaker weakness pressure pressured contract contracts contraction downgrade downgraded downgrades
bearish lawsuit lawsuits sued sues decline declined declines declining fall fell falls drop dropped drops plunge plunged
plunges slump slumped slumps loss losses losing cut cuts layoff layoffs recall recalls investigation probe fraud bankruptcy
bankrupt default defaults warning warns warned disappointing disappoint disappointed concern concerns headwind headwinds
slowdown slowing underperform underperformed underperforms delay delayed delays fined penalty penalties impairment writedown
restatement restate resign resigns resigned halt halted shortfall downturn deficit litigation subpoena breach tumble tumbled
tumbles sink sank sinks crash crashed
""".split()
NEGATORS = ["not", "no", "never", "without", "didn't", "doesn't", "isn't", "wasn't", "won't", "cannot", "can't"]
LABELS = {"positive": 1.0, "bullish": 1.0, "neutral": 0.0, "negative": -1.0, "bearish": -1.0}


def lexicon_score(text: Column, positive: Iterable[str] = POSITIVE, negative: Iterable[str] = NEGATIVE) -> Column:
    """(positive - negative) / (positive + negative) of the words found; a negator
    among the three words before turns a hit; 0 without hits.

    One fold over the words keeps the sum, the hits and the distance to the last
    negator, so the text is split once.
    """
    good, bad = list(positive), list(negative)

    def step(acc: Column, word: Column) -> Column:
        sign = F.when(word.isin(good), 1).when(word.isin(bad), -1).otherwise(0)
        turned = F.when(acc["ago"] <= 3, -sign).otherwise(sign)
        ago = F.when(word.isin(NEGATORS), 1).otherwise(F.least(acc["ago"] + 1, F.lit(9)))
        return F.struct((acc["total"] + turned).alias("total"), (acc["hits"] + F.abs(sign)).alias("hits"), ago.alias("ago"))

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("hits"), F.lit(9).alias("ago"))
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z']+)"))
    score = F.aggregate(tokens, start, step, lambda acc: F.when(acc["hits"] > 0, acc["total"] / acc["hits"]).otherwise(0.0))
    return F.coalesce(score, F.lit(0.0))


def load_dictionary(df: DataFrame) -> tuple[list[str], list[str]]:
    """Word lists of a master dictionary table: a non-zero column lists the word.
    The dictionary is a few thousand words, collected to literals."""
    listed = lambda c: [r.w for r in df.filter(~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("0", "")).select(F.lower("Word").alias("w")).distinct().collect()]
    return listed("Positive"), listed("Negative")


def provided_scores(news: DataFrame) -> DataFrame:
    """`sentiment_score`: given numbers if most parse, else the feed's labels, else
    the lexicon on title and summary."""
    if "sentiment" in news.columns:
        number = F.expr("try_cast(sentiment AS DOUBLE)")
        share = news.agg(F.avg(number.isNotNull().cast("int"))).first()[0] or 0
        if share > 0.5:
            return news.withColumn("sentiment_score", F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), number)), F.lit(0.0)))
        table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
        return news.withColumn("sentiment_score", F.coalesce(F.try_element_at(table, F.lower(F.trim(F.col("sentiment").cast("string")))), F.lit(0.0)))
    text = F.concat_ws(" ", "title", *([F.coalesce("summary", F.lit(""))] if "summary" in news.columns else []))
    return news.withColumn("sentiment_score", lexicon_score(text))


def market_date(ts: Column) -> Column:
    """Date on which news can move the market: from 16:00 on, the next day."""
    return F.date_add(F.to_date(ts), (F.hour(ts) >= 16).cast("int"))


def market_time(text: Column, zone: str = "America/New_York") -> Column:
    """Naive market time of a timestamp's text: one with an offset is converted,
    one without is taken as it is."""
    aware = text.rlike(r"\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})$")
    stamp = F.try_to_timestamp(text)
    return F.when(aware, F.convert_timezone(F.current_timezone(), F.lit(zone), stamp.cast("timestamp_ntz"))).otherwise(stamp.cast("timestamp_ntz"))


def daily_news(news: DataFrame) -> DataFrame:
    """(ticker, date, news_count, sentiment_sum)."""
    return provided_scores(news).groupBy("ticker", "date").agg(F.count("title").alias("news_count"), F.sum("sentiment_score").alias("sentiment_sum"))


def headlines(news: DataFrame) -> DataFrame:
    """What a reader of the news needs, with its score, by ticker and date."""
    scored = provided_scores(news)
    held = [c for c in ("ticker", "date", "title", "summary", "sentiment", "source", "url") if c in scored.columns]
    return scored.select(*held, "sentiment_score").orderBy("ticker", "date")


def align(daily: DataFrame, prices: DataFrame) -> DataFrame:
    """News moved to the ticker's next session and summed again."""
    moved = to_next_session(daily, prices)
    return moved.groupBy("ticker", F.col("session").alias("date")).agg(F.sum("news_count").alias("news_count"), F.sum("sentiment_sum").alias("sentiment_sum"))


def news_features(df: DataFrame, aligned: DataFrame) -> DataFrame:
    """Count and mean sentiment of the last 20 sessions; unknown without news."""
    return news_windows(df.join(aligned, ["ticker", "date"], "left"))


def news_windows(df: DataFrame) -> DataFrame:
    df = df.fillna(0, ["news_count", "sentiment_sum"])
    df = df.withColumns({"news_count_20d": roll("sum", "news_count", 20, 1), "_s": roll("sum", "sentiment_sum", 20, 1)})
    return df.withColumn("sentiment_20d", F.when(F.col("news_count_20d") > 0, F.col("_s") / F.col("news_count_20d"))).drop("_s")
