"""Queries on membership, filings, earnings, insiders, macro and news."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import events, filings, news, universe
from panelweave.operators.calendar import on_calendar
from panelweave.plans.panel_queries import dense_sql, features, features_sql
from panelweave.plans.proxies import VIEWS, view, with_sql
from panelweave.plans.registry import query


def cte(name: str) -> str:
    return f"{name} AS ({VIEWS[name].replace('{', '').replace('}', '')})"


@query(
    with_sql("panel", "membership") + " SELECT p.ticker, date, count(start_date) + count(end_date) >= 0 AND bool_or(m.ticker IS NOT NULL AND (start_date IS NULL OR date >= start_date) AND (end_date IS NULL OR date < end_date)) AS in_index FROM panel p LEFT JOIN membership m ON p.ticker = m.ticker GROUP BY 1, 2"
)
def c4_membership_flags(spark, sf_dir):
    return universe.flag_members(view(spark, sf_dir, "panel"), view(spark, sf_dir, "membership")).select("ticker", "date", "in_index")


@query(
    with_sql("changes") + """, cur AS (SELECT DISTINCT user_id AS ticker FROM events WHERE user_id % 3 = 0),
    s AS (SELECT c.*, coalesce(lag(kind) OVER (PARTITION BY c.ticker ORDER BY date DESC), CASE WHEN cur.ticker IS NOT NULL THEN 'removed' ELSE 'added' END) AS later FROM changes c LEFT JOIN cur ON c.ticker = cur.ticker),
    e AS (SELECT ticker, date, kind, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS nxt, row_number() OVER (PARTITION BY ticker ORDER BY date) AS no FROM s WHERE kind <> later)
    SELECT ticker, date AS start_date, nxt AS end_date FROM e WHERE kind = 'added' UNION ALL SELECT ticker, NULL, date FROM e WHERE no = 1 AND kind = 'removed'
    UNION ALL SELECT ticker, NULL, NULL FROM cur WHERE ticker NOT IN (SELECT ticker FROM e)"""
)
def c3_membership_intervals(spark, sf_dir):
    current = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("ticker")).filter("ticker % 3 = 0").distinct()
    return universe.membership(current, view(spark, sf_dir, "changes"), "1900-01-01")


@query(
    with_sql("panel") + """, g AS (SELECT *, date - lag(date) OVER (PARTITION BY ticker ORDER BY date) AS gap, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS mv FROM panel),
    sp AS (SELECT ticker, min(date) AS a, max(date) AS b FROM panel GROUP BY 1)
    SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, min(date) AS start, max(date) AS "end", count(*) FILTER (abs(mv) > 0.4) AS extreme_daily_moves, CAST(max(gap) AS INTEGER) AS longest_gap_days, count(*) - count(DISTINCT (ticker, date)) AS duplicate_rows,
      (SELECT count(*) FROM sp WHERE b < (SELECT max(date) FROM panel) - 10) AS tickers_ending_early, (SELECT round(median((b - a) / 365.25), 1) FROM sp) AS median_history_years FROM g"""
)
def c11_price_checks(spark, sf_dir):
    return universe.price_checks(view(spark, sf_dir, "panel"))


@query(
    with_sql("panel", "membership") + """, q AS (SELECT *, lag(close, 62) OVER (PARTITION BY ticker ORDER BY date) AS qa FROM panel),
    l AS (SELECT ticker, max(date) AS last_date, arg_max(close, date) AS c, arg_max(coalesce(qa, -1), date) AS q FROM q GROUP BY 1), e AS (SELECT ticker, max(end_date) AS left_on FROM membership GROUP BY 1)
    SELECT l.ticker, last_date, '' AS reason, CASE WHEN q > 0 AND c / q - 1 < -0.5 THEN -0.3 ELSE 0.0 END::DOUBLE AS delisting_return FROM l LEFT JOIN e USING (ticker) WHERE last_date < (SELECT max(date) FROM panel) - 10 AND (left_on IS NULL OR last_date < left_on + 38)"""
)
def c7_delistings(spark, sf_dir):
    return universe.delistings(view(spark, sf_dir, "panel"), None, view(spark, sf_dir, "membership"))


QUARTERS = with_sql("facts") + """, q AS (SELECT *, period_end - lag(period_end) OVER (PARTITION BY ticker ORDER BY period_end) AS gap FROM facts),
    t AS (SELECT ticker, period_end, sum(val) OVER w AS ttm, max(filed) OVER w AS available, count(*) OVER w AS n, sum(CAST(abs(gap - 91) <= 11 AS INT)) OVER (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ok FROM q WINDOW w AS (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


def facts_table(spark, sf_dir):
    """The quarterly proxy as facts of one metric: a quarter starts on its first day."""
    rows = view(spark, sf_dir, "facts")
    start = F.add_months(F.date_add("period_end", 1), -3)
    return rows.select(F.col("ticker").alias("cik"), F.lit("revenue").alias("metric"), F.lit(0).alias("priority"), start.alias("start"), F.col("period_end").alias("end"), "val", "filed", F.lit("10-Q").alias("form"), F.lit("a").alias("accn"))


@query(QUARTERS + " SELECT ticker AS cik, period_end AS \"end\", round(ttm, 4) AS ttm, available FROM t WHERE n = 4 AND ok = 3")
def f3_trailing_year(spark, sf_dir):
    return filings.trailing_year(facts_table(spark, sf_dir)).select("cik", "end", F.round("ttm", 4).alias("ttm"), "available")


@query(QUARTERS + ", v AS (SELECT * FROM t WHERE n = 4 AND ok = 3) SELECT a.ticker AS cik, a.period_end AS \"end\", round(a.ttm / b.ttm - 1, 6) AS growth FROM v a LEFT JOIN v b ON a.ticker = b.ticker AND b.period_end BETWEEN a.period_end - 385 AND a.period_end - 345")
def f9_growth(spark, sf_dir):
    ttm = filings.trailing_year(facts_table(spark, sf_dir))
    return filings.growth(ttm).select("cik", "end", F.round("value", 6).alias("growth"))


SUE = with_sql("facts") + """, p AS (SELECT a.ticker, a.period_end, a.filed, a.val / 1e5 - b.val / 1e5 AS s FROM facts a LEFT JOIN facts b ON a.ticker = b.ticker AND b.period_end BETWEEN a.period_end - 385 AND a.period_end - 345),
    l AS (SELECT *, lag(s) OVER (PARTITION BY ticker ORDER BY period_end) AS ls FROM p),
    d AS (SELECT *, CASE WHEN count(ls) OVER w >= 4 THEN stddev_samp(ls) OVER w END AS sc FROM l WINDOW w AS (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
    sue AS (SELECT ticker, period_end, filed + 1 AS available, greatest(-10, least(10, s / sc)) AS sue FROM d WHERE sc > 0 AND s IS NOT NULL)"""


def eps_table(spark, sf_dir):
    return view(spark, sf_dir, "facts").select("ticker", "period_end", (F.col("val") / 1e5).alias("eps"), "filed")


@query(SUE + " SELECT ticker, period_end, available, round(sue, 5) AS sue FROM sue")
def f14_surprises(spark, sf_dir):
    return events.surprises(eps_table(spark, sf_dir)).select("ticker", "period_end", "available", F.round("sue", 5).alias("sue"))


@query(
    SUE + ", " + cte("panel") + ", j AS (SELECT p.ticker, p.date, s.available, s.sue FROM panel p ASOF LEFT JOIN sue s ON p.ticker = s.ticker AND p.date >= s.available) SELECT ticker, date, CASE WHEN date - available <= 120 THEN round(sue, 5) END AS sue FROM j"
)
def j5_sue_as_of(spark, sf_dir):
    df = events.earnings(view(spark, sf_dir, "panel").select("ticker", "date"), eps_table(spark, sf_dir), None)
    return df.select("ticker", "date", F.round("sue", 5).alias("sue"))


@query(
    QUARTERS + ", " + cte("panel") + ", pit AS (SELECT ticker, ttm, available FROM t WHERE n = 4 AND ok = 3), j AS (SELECT p.ticker, p.date, x.available, x.ttm FROM panel p ASOF LEFT JOIN pit x ON p.ticker = x.ticker AND p.date > x.available) SELECT ticker, date, CASE WHEN date - available <= 550 THEN available END AS as_of, CASE WHEN date - available <= 550 THEN round(ttm, 4) END AS revenue FROM j"
)
def j4_fundamentals_as_of(spark, sf_dir):
    pit = filings.trailing_year(facts_table(spark, sf_dir)).select(F.col("cik").alias("ticker"), F.col("available").alias("available_date"), F.col("end").alias("period_end"), F.col("ttm").alias("revenue_ttm"))
    none = F.lit(None).cast("double")
    pit = pit.withColumns({c: none for c in events.FLOWS if c != "revenue_ttm"})
    df = events.fundamentals(view(spark, sf_dir, "panel").select("ticker", "date", "close"), pit)
    return df.select("ticker", "date", F.col("fundamentals_as_of").alias("as_of"), F.round("revenue", 4).alias("revenue"))


@query(
    dense_sql() + ", " + cte("insiders") + """, al AS (SELECT i.*, d.date AS session FROM insiders i ASOF JOIN dense d ON i.ticker = d.ticker AND i.filed + 1 <= d.date),
    dy AS (SELECT ticker, session AS date, count(DISTINCT CASE WHEN code = 'P' THEN accession END) AS n, sum(CASE WHEN code = 'P' THEN value ELSE 0 END) AS b, sum(CASE WHEN code = 'P' THEN 0 ELSE value END) AS s FROM al GROUP BY 1, 2),
    j AS (SELECT d.ticker, d.date, coalesce(n, 0) AS n, coalesce(b, 0) - coalesce(s, 0) AS net FROM dense d LEFT JOIN dy USING (ticker, date))
    SELECT ticker, date, CAST(sum(n) OVER w AS BIGINT) AS insider_purchases_90d, round(sum(net) OVER w, 2) AS insider_net_90d FROM j WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"""
)
def f16_insider_features(spark, sf_dir):
    df = events.insiders(on_calendar(view(spark, sf_dir, "panel")).select("ticker", "date"), view(spark, sf_dir, "insiders"))
    return df.select("ticker", "date", F.col("insider_purchases_90d").cast("long").alias("insider_purchases_90d"), F.round("insider_net_90d", 2).alias("insider_net_90d"))


@query(
    with_sql("panel", "macro") + """, m AS (SELECT date AS md, vix, tbill_3m, vix / lag(vix, 20) OVER (ORDER BY date) - 1 AS vix_change_20d, CASE WHEN count(vix) OVER w >= 126 THEN (vix - avg(vix) OVER w) / stddev_samp(vix) OVER w END AS vix_regime FROM macro WINDOW w AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
    d AS (SELECT DISTINCT date FROM panel), j AS (SELECT d.date, m.* FROM d ASOF LEFT JOIN m ON d.date > m.md)
    SELECT p.ticker, p.date, round(vix, 6) AS vix, round(tbill_3m, 6) AS tbill_3m, round(vix_change_20d, 6) AS vix_change_20d, round(vix_regime, 6) AS vix_regime FROM panel p JOIN j USING (date)"""
)
def f17_macro_features(spark, sf_dir):
    df = events.macro(view(spark, sf_dir, "panel").select("ticker", "date"), view(spark, sf_dir, "macro"))
    return df.select("ticker", "date", *[F.round(c, 6).alias(c) for c in ("vix", "tbill_3m", "vix_change_20d", "vix_regime")])


NEWS = dense_sql("daily") + ", " + cte("news") + """, n AS (SELECT ticker, CAST(ts AS DATE) + CASE WHEN hour(ts) >= 16 THEN 1 ELSE 0 END AS date, title, CASE sentiment WHEN 'positive' THEN 1.0 WHEN 'bullish' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END AS s FROM news),
    dn AS (SELECT ticker, date, count(title) AS c, sum(s) AS s FROM n GROUP BY 1, 2), al AS (SELECT dn.ticker, d.date, sum(c) AS c, sum(s) AS s FROM dn ASOF JOIN dense d ON dn.ticker = d.ticker AND dn.date <= d.date GROUP BY 1, 2)"""


def dated_news(spark, sf_dir):
    return view(spark, sf_dir, "news").withColumn("date", news.market_date(F.col("ts")))


@query(NEWS + " SELECT ticker, date, c AS news_count, CAST(s AS DOUBLE) AS sentiment_sum FROM dn")
def n4_daily_news(spark, sf_dir):
    return news.daily_news(dated_news(spark, sf_dir))


@query(
    NEWS + """, j AS (SELECT d.ticker, d.date, coalesce(c, 0) AS c, coalesce(s, 0) AS s FROM dense d LEFT JOIN al USING (ticker, date))
    SELECT ticker, date, CAST(sum(c) OVER w AS BIGINT) AS news_count_20d, CASE WHEN sum(c) OVER w > 0 THEN round(sum(s) OVER w / sum(c) OVER w, 6) END AS sentiment_20d FROM j WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
)
def n6_news_features(spark, sf_dir):
    dense = on_calendar(view(spark, sf_dir, "daily")).select("ticker", "date")
    df = news.news_features(dense, news.align(news.daily_news(dated_news(spark, sf_dir)), dense))
    return df.select("ticker", "date", F.col("news_count_20d").cast("long").alias("news_count_20d"), F.round("sentiment_20d", 6).alias("sentiment_20d"))


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query(
    "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS t FROM documents), "
    f"h AS (SELECT doc_id, i, CASE WHEN list_contains({_list(news.POSITIVE + ['the', 'tion'])}, t[i]) THEN 1 WHEN list_contains({_list(news.NEGATIVE + ['of', 'er'])}, t[i]) THEN -1 ELSE 0 END AS s, "
    f"CASE WHEN i > 1 AND len(list_filter(t[greatest(1, i - 3):i - 1], lambda x: list_contains({_list(news.NEGATORS)}, x))) > 0 THEN -1 ELSE 1 END AS f FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM w)) "
    "SELECT w.doc_id, round(coalesce(r, 0), 6) AS score FROM w LEFT JOIN (SELECT doc_id, sum(s * f) / nullif(sum(abs(s)), 0) AS r FROM h GROUP BY 1) USING (doc_id)"
)
def n1_lexicon_score(spark, sf_dir):
    """The lexicon with two frequent syllables on either side, so that the invented prose has hits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    score = news.lexicon_score(F.col("text"), news.POSITIVE + ["the", "tion"], news.NEGATIVE + ["of", "er"])
    return docs.select("doc_id", F.round(score, 6).alias("score"))
