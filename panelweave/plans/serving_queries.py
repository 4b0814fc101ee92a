"""Analyst queries on the weekly panel's last date."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import crosssection, serving
from panelweave.plans.event_queries import cte
from panelweave.plans.panel_queries import RANKED, USABLE, companies_cte, features, features_sql, rank_sql, usable
from panelweave.plans.proxies import view, with_sql
from panelweave.plans.registry import query

SCORED = (
    features_sql() + ", " + companies_cte() + f""", u AS (SELECT * FROM features WHERE {USABLE}),
    pr AS (SELECT *, """ + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {rank_sql(c, 'date')} / count({c}) OVER (PARTITION BY date) END AS {c}_xs_rank" for c in RANKED) + """ FROM u),
    nw AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM pr),
    sus AS (SELECT ticker FROM nw WHERE n <= 5 AND abs(return_1d) > 0.4),
    sc AS (SELECT w.*, company_name, sector, industry, round(return_20d_xs_rank, 9) AS model_probability FROM nw w JOIN companies USING (ticker) WHERE n = 1 AND date >= (SELECT max(date) FROM nw) - 7 AND ticker NOT IN (SELECT ticker FROM sus) AND return_20d_xs_rank IS NOT NULL),
    scored AS (SELECT *, row_number() OVER (ORDER BY model_probability DESC, ticker) AS rank, count(*) OVER () AS out_of FROM sc)"""
)
ROW = "ticker, company_name AS company, sector, rank, round(model_probability, 6) AS model_probability, round(return_5d, 6) AS return_5d, round(return_20d, 6) AS return_20d, round(momentum_60d, 6) AS momentum_60d, round(volatility_20d, 6) AS volatility_20d"


def scored(spark, sf_dir):
    df = usable(features(spark, sf_dir))
    ranked = crosssection.percentile_ranks(serving.late_rows(df), RANKED).withColumn("score", F.round("return_20d_xs_rank", 9))
    return serving.score_snapshot(ranked, "score", history=df).join(view(spark, sf_dir, "companies"), "ticker")


def six(df):
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else f.name for f in df.schema])


@query(SCORED + f" SELECT {ROW} FROM scored ORDER BY model_probability DESC, ticker LIMIT 10")
def q4_rank_stocks(spark, sf_dir):
    return six(serving.rank_stocks(scored(spark, sf_dir), 10))


@query(SCORED + f", m AS (SELECT *, count(*) OVER () AS matches FROM scored WHERE lower(sector) = 'europe' AND model_probability >= 0.3 AND volatility_20d <= 9) SELECT {ROW}, matches FROM m ORDER BY momentum_60d DESC NULLS LAST, ticker LIMIT 15")
def q5_screen(spark, sf_dir):
    return six(serving.screen(scored(spark, sf_dir), sector="Europe", min_probability=0.3, max_volatility=9, sort_by="momentum_60d"))


@query(SCORED + " SELECT sector, count(*) AS stocks, round(avg(model_probability), 6) AS mean_up_probability, round(avg(return_20d), 6) AS mean_return_20d, round(avg(volatility_20d), 6) AS mean_volatility, arg_min(ticker, rank) AS top_ranked FROM scored GROUP BY 1")
def q12_sector_summary(spark, sf_dir):
    return six(serving.sector_summary(scored(spark, sf_dir)))


@query(
    SCORED + """, k AS (SELECT *, greatest(1, CAST(round_even(out_of * 0.2, 0) AS INT)) AS k FROM scored)
    SELECT ticker, company_name AS company, rank, out_of, CASE WHEN rank <= k THEN 'favourable' WHEN rank > out_of - k THEN 'unfavourable' ELSE 'neutral' END AS stance FROM k"""
)
def q3_q17_stance(spark, sf_dir):
    return serving.snapshot(scored(spark, sf_dir), None).select("ticker", "company", "rank", "out_of", "stance")


@query(
    SCORED + """, s AS (SELECT ticker, company_name, sector, rank, CAST(upper(CAST(ticker AS VARCHAR)) = 'SUPPLIER#00000001' AS INT) * 4 + CAST(starts_with(upper(CAST(ticker AS VARCHAR)), 'SUPPLIER#00000001') AS INT) * 2 + CAST(contains(upper(company_name), 'SUPPLIER#00000001') AS INT) * 3
      + CAST(len(list_filter(string_split_regex(upper(company_name), '\\s+'), lambda w: starts_with(w, 'SUPPLIER#00000001'))) > 0 AS INT) AS score FROM scored)
    SELECT ticker, company_name AS company, sector, score, rank FROM s WHERE score > 0 ORDER BY score DESC, rank LIMIT 5"""
)
def q2_search_companies(spark, sf_dir):
    return serving.search_companies(scored(spark, sf_dir), "supplier#00000001")


@query(
    with_sql("panel") + """, h AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 252), r AS (SELECT *, close / lag(close) OVER w - 1 AS r, max(close) OVER w AS top FROM h WINDOW w AS (PARTITION BY ticker ORDER BY date))
    SELECT ticker, min(date) AS start_date, max(date) AS end_date, count(*) AS trading_days, round(arg_min(close, date), 6) AS start_close, round(arg_max(close, date), 6) AS end_close, round(arg_max(close, date) / arg_min(close, date) - 1, 6) AS total_return,
      round(stddev_samp(r) * sqrt(252), 6) AS annualised_volatility, round(min(close / top - 1), 6) AS max_drawdown, round(max(close), 6) AS high, round(min(close), 6) AS low, round(arg_max(close, date) / max(close) - 1, 6) AS distance_from_high FROM r GROUP BY ticker"""
)
def q7_price_history(spark, sf_dir):
    return six(serving.price_history(view(spark, sf_dir, "panel"), None).drop("series"))


@query(
    with_sql("macro") + """, x AS (SELECT unnest([{'series': 'vix', 'value': vix}, {'series': 'tbill_3m', 'value': tbill_3m}], recursive := true), date FROM macro), e AS (SELECT max(date) AS e FROM macro)
    SELECT series, (SELECT e FROM e) AS as_of, round(arg_max(value, date), 6) AS latest, round(arg_max(value, date) FILTER (date <= (SELECT e FROM e) - 365), 6) AS year_ago,
      round(avg(CASE WHEN value <= (SELECT arg_max(y.value, y.date) FROM x y WHERE y.series = x.series) THEN 1 ELSE 0 END) FILTER (date >= (SELECT e FROM e) - 3652), 6) AS percentile_10y FROM x GROUP BY series"""
)
def q10_macro_snapshot(spark, sf_dir):
    return six(serving.macro_snapshot(view(spark, sf_dir, "macro")))


@query(SCORED + " SELECT max(date) AS as_of_date, count(*) AS stocks_ranked, string_agg(DISTINCT sector, ', ' ORDER BY sector) AS sectors, (SELECT min(date) FROM u) AS history_start, (SELECT max(date) FROM u) AS history_end, (SELECT count(DISTINCT ticker) FROM u) AS tickers, (SELECT count(*) FROM u) AS rows, (SELECT count(DISTINCT ticker) FROM u) - count(*) AS left_out FROM scored")
def q1_overview(spark, sf_dir):
    return serving.overview(usable(features(spark, sf_dir)), scored(spark, sf_dir))


@query(SCORED + ", l AS (SELECT ticker, unnest([" + ", ".join(f"{{'signal': '{c}', 'percentile': {c}_xs_rank}}" for c in RANKED) + "], recursive := true) FROM scored) SELECT ticker, signal, round(percentile, 6) AS percentile FROM l WHERE percentile IS NOT NULL")
def q19_percentile_profile(spark, sf_dir):
    return six(serving.percentile_profile(scored(spark, sf_dir), None))


@query(with_sql("macro") + ", t AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i FROM macro WHERE date >= (SELECT max(date) FROM macro) - 3652) SELECT date, round(vix, 6) AS vix, round(tbill_3m, 6) AS tbill_3m FROM t WHERE i % 2 = 0")
def q20_macro_series(spark, sf_dir):
    return six(serving.macro_series(view(spark, sf_dir, "macro")))


@query(with_sql("changes") + " SELECT date, ticker, kind FROM changes QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 10")
def q11_index_changes(spark, sf_dir):
    return serving.index_changes(view(spark, sf_dir, "changes"), each=True)


@query(with_sql("membership") + " SELECT ticker, bool_or(end_date IS NULL) AS currently_in_index, count(*) AS periods FROM membership GROUP BY 1")
def q11_currently_in(spark, sf_dir):
    return serving.currently_in(view(spark, sf_dir, "membership"))


@query(with_sql("panel") + " SELECT ticker, date, round(close, 6) AS close, volume FROM panel QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 100")
def q23_price_series(spark, sf_dir):
    return six(serving.price_series(view(spark, sf_dir, "panel"), None, 100))


@query(with_sql("news") + ", d AS (SELECT ticker, CAST(ts AS DATE) AS date, title, count(*) AS n FROM news GROUP BY 1, 2, 3) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC, title) <= 8")
def q8_recent_news(spark, sf_dir):
    daily = view(spark, sf_dir, "news").groupBy("ticker", F.to_date("ts").alias("date"), "title").agg(F.count("*").alias("n"))
    return serving.recent_news(daily.withColumn("source", F.col("n")), None).withColumnRenamed("source", "n")
