"""Further queries: cleaning, windows of research, curves, decay, serving tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelweave.functions.frames import by_ticker, ratio
from panelweave.functions.shared import shared_dir
from panelweave.operators import backtest as bt
from panelweave.operators import appending, labels, serving, universe, validation
from panelweave.operators.asof import asof, to_next_session
from panelweave.operators.stats import information_coefficients
from panelweave.plans.backtest_queries import BOOKS, CONFIG, predictions
from panelweave.plans.event_queries import SUE, cte
from panelweave.plans.panel_queries import FEATURES, RANKED, USABLE, features, features_sql, rank_sql, rounded, shown, usable
from panelweave.plans.proxies import view, with_sql
from panelweave.plans.registry import query
from panelweave.plans.serving_queries import ROW, SCORED, scored, six
from panelweave.sources import files
from panelweave.sources.store import Dataset, read, record_ranking, save_artifact


@query(
    with_sql("panel", "membership") + """, fm AS (SELECT *, greatest(coalesce(start_date, DATE '1995-06-01'), DATE '1995-06-01') AS a, coalesce(end_date, (SELECT max(date) FROM panel)) AS b FROM membership WHERE ticker % 5 <> 0),
    wd AS (SELECT ticker, greatest(0, (b - DATE '1900-01-01') // 7 * 5 + least((b - DATE '1900-01-01') % 7, 5) - (a - DATE '1900-01-01') // 7 * 5 - least((a - DATE '1900-01-01') % 7, 5)) AS days, (SELECT count(*) FROM panel p WHERE p.ticker = fm.ticker AND p.date >= a AND p.date < b) AS n, end_date FROM fm)
    SELECT p.ticker, p.date FROM panel p LEFT JOIN wd USING (ticker) WHERE wd.ticker IS NULL OR (NOT (days > 0 AND n / days < 0.5) AND (end_date IS NULL OR p.date <= end_date + 45))"""
)
def c5_c6_clean_former(spark, sf_dir):
    """A weekly panel covers a fifth of the weekdays, so former members with long spells go."""
    spans = view(spark, sf_dir, "membership")
    return universe.clean_former(view(spark, sf_dir, "panel"), spans, spans.filter("ticker % 5 = 0").select("ticker"), "1995-06-01").select("ticker", "date")


@query(
    with_sql("panel") + """, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS no FROM (SELECT DISTINCT date FROM panel)), c AS (SELECT min(no) AS c FROM d WHERE date >= DATE '2000-01-03'),
    f AS (SELECT ticker, date, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS r FROM panel)
    SELECT ticker, f.date, CASE WHEN no + 6 < (SELECT c FROM c) THEN round(r, 6) END AS future_return_5d FROM f JOIN d USING (date) WHERE f.date < DATE '2000-01-03'"""
)
def l6_research_window(spark, sf_dir):
    df = view(spark, sf_dir, "panel").withColumn("future_return_5d", ratio(F.lead("close", 5).over(by_ticker()), "close") - 1)
    return six(labels.research_window(df, "2000-01-03").select("ticker", "date", "future_return_5d"))


@query(with_sql("daily") + ", e AS (SELECT user_id AS ticker, event_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'error'), s AS (SELECT ticker, date AS session FROM daily WHERE volume >= 2) SELECT e.ticker, event_id, session FROM e ASOF JOIN s ON e.ticker = s.ticker AND e.d <= s.session")
def j7_next_session(spark, sf_dir):
    """Each event moved to the ticker's next day with two rows or more."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'error'").select(F.col("user_id").alias("ticker"), "event_id", F.to_date("ts").alias("date"))
    return to_next_session(events, view(spark, sf_dir, "daily").filter("volume >= 2")).select("ticker", "event_id", "session")


@query(
    BOOKS + """, c AS (SELECT date, strategy, exp(sum(ln(1 + gross - cost)) OVER (PARTITION BY strategy ORDER BY date)) AS growth FROM bt)
    SELECT strategy, date, round(growth, 5) AS growth, round(growth / max(growth) OVER (PARTITION BY strategy ORDER BY date) - 1, 5) AS drawdown FROM c"""
)
def b22_curves(spark, sf_dir):
    found = bt.curves(bt.backtest(predictions(spark, sf_dir), CONFIG))
    return found.select("strategy", "date", F.round("growth", 5).alias("growth"), F.round("drawdown", 5).alias("drawdown"))


@query(
    BOOKS + f""", z AS (SELECT date, {rank_sql("probability", "period")} AS a, {rank_sql("tradable_return", "period")} AS b FROM xs), ic AS (SELECT date, corr(a, b) AS ic FROM z GROUP BY date HAVING min(a) < max(a) AND min(b) < max(b))
    SELECT date, round(ic, 6) AS ic, CASE WHEN count(ic) OVER w >= 6 THEN round(avg(ic) OVER w, 6) END AS rolling_ic FROM ic WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""
)
def b23_rolling_ic(spark, sf_dir):
    return six(bt.rolling_ic(bt.rebalance_ic(predictions(spark, sf_dir), CONFIG)).select("date", "ic", "rolling_ic"))


@query(
    BOOKS + """, a AS (SELECT avg(gross) FILTER (strategy = 'long_only') - avg(gross) FILTER (strategy = 'benchmark') AS g, avg(turnover) FILTER (strategy = 'long_only') - avg(turnover) FILTER (strategy = 'benchmark') AS t,
      avg(gross) FILTER (strategy = 'long_short') AS lg, avg(turnover) FILTER (strategy = 'long_short') AS lt FROM bt) SELECT round(g / t * 10000, 4) AS long_only_vs_equal_weight_bps, round(lg / lt * 10000, 4) AS long_short_bps FROM a"""
)
def b18_break_even(spark, sf_dir):
    found = bt.break_even(bt.backtest(predictions(spark, sf_dir), CONFIG))
    return found.select(F.round("long_only_vs_equal_weight_bps", 4).alias("long_only_vs_equal_weight_bps"), F.round("long_short_bps", 4).alias("long_short_bps"))


@query(
    features_sql() + f""", u AS (SELECT *, {", ".join(f"lead(close, {h}) OVER w / close - 1 AS f{h}" for h in validation.DECAY)} FROM features WHERE {USABLE} WINDOW w AS (PARTITION BY ticker ORDER BY date)),
    d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM u)), x AS (SELECT u.*, unnest([{", ".join(f"{{'horizon': {h}, 'f': f{h}}}" for h in validation.DECAY)}], recursive := true) FROM u JOIN d USING (date) WHERE i % 5 = 0),
    s AS ({" UNION ALL ".join(f"SELECT '{c}' AS signal, horizon, date, {c} AS v, f FROM x" for c in RANKED)}),
    y AS (SELECT * FROM s WHERE v IS NOT NULL AND f IS NOT NULL), z AS (SELECT signal, horizon, date, {rank_sql("v", "signal, horizon, date")} AS a, {rank_sql("f", "signal, horizon, date")} AS b FROM y),
    ic AS (SELECT signal, horizon, date, corr(a, b) AS ic FROM z GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND min(a) < max(a) AND min(b) < max(b)) SELECT signal, CAST(horizon AS INTEGER) AS horizon, round(avg(ic), 6) AS ic_mean, count(*) AS dates FROM ic GROUP BY signal, horizon"""
)
def v9_ic_decay(spark, sf_dir):
    return six(validation.ic_decay(usable(features(spark, sf_dir)), RANKED))


@query(
    SUE + f""", r AS (SELECT available, period_end, sue, {rank_sql("sue", "period_end")} AS a FROM sue), s AS (SELECT period_end, count(*) AS n, avg(sue) AS m FROM r GROUP BY 1 HAVING count(*) >= 5)
    SELECT period_end AS date, n, round(m, 5) AS mean_sue FROM s"""
)
def f14_sue_by_quarter(spark, sf_dir):
    from panelweave.operators.events import surprises
    from panelweave.plans.event_queries import eps_table

    found = surprises(eps_table(spark, sf_dir)).groupBy(F.col("period_end").alias("date")).agg(F.count("*").alias("n"), F.avg("sue").alias("mean_sue"))
    return found.filter("n >= 5").select("date", "n", F.round("mean_sue", 5).alias("mean_sue"))


@query(
    features_sql() + f", u AS (SELECT * FROM features WHERE {USABLE}), l AS (SELECT ticker, date, return_1d * 40 AS return_1d, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM u), w AS (SELECT ticker, arg_max(date, abs(return_1d)) AS date, arg_max(return_1d, abs(return_1d)) AS move FROM l WHERE n <= 20 GROUP BY 1) SELECT ticker, date, round(move, 6) AS move FROM w WHERE abs(move) > 0.4"
)
def q16_data_warning(spark, sf_dir):
    """Moves forty times as large, so that some are suspect."""
    df = usable(features(spark, sf_dir)).withColumn("return_1d", F.col("return_1d") * 40)
    return six(serving.data_warning(df))


@query(SCORED + f", k AS (SELECT *, greatest(1, CAST(round_even(out_of * 0.2, 0) AS INT)) AS k FROM scored) SELECT {ROW}, round(momentum_12_1, 6) AS momentum_12_1, round(beta_252, 6) AS beta_252, CASE WHEN rank <= k THEN 'favourable' WHEN rank > out_of - k THEN 'unfavourable' ELSE 'neutral' END AS stance FROM k")
def q18_screener_table(spark, sf_dir):
    return six(serving.screener_table(scored(spark, sf_dir)))


@query(SCORED + " SELECT ticker, rank, out_of FROM scored WHERE ticker IN (3, 7, 11)")
def q6_compare(spark, sf_dir):
    return serving.compare(scored(spark, sf_dir), [3, 7, 11, 7]).select("ticker", "rank", "out_of")


@query(with_sql("panel") + ", d AS (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS i FROM (SELECT DISTINCT date FROM panel)) SELECT ticker, p.date FROM panel p JOIN d USING (date) WHERE i % 5 = 0")
def m8_non_overlapping(spark, sf_dir):
    return validation.non_overlapping(view(spark, sf_dir, "panel").select("ticker", "date"), 5)


@query(
    "WITH " + cte("companies") + " SELECT ticker, company_name, sector, CASE WHEN ticker % 7 = 0 THEN NULL ELSE 'SIC ' || lpad(CAST(CAST(ticker * 37 % 9000 + 100 AS INT) // 100 AS VARCHAR), 2, '0') END AS industry FROM companies"
)
def c8_c10_company_industries(spark, sf_dir):
    code = F.when(F.col("ticker") % 7 != 0, (F.col("ticker") * 37 % 9000 + 100).cast("int"))
    return view(spark, sf_dir, "companies").select("ticker", "company_name", "sector", universe.sic_industry(code).alias("industry"))


@query(
    features_sql() + f""", u AS (SELECT * FROM features WHERE {USABLE} AND return_20d IS NOT NULL), f AS (SELECT *, lead(close, 1) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS nx FROM u),
    z AS (SELECT date, {rank_sql("return_20d", "date")} AS a, {rank_sql("nx", "date")} AS b FROM f WHERE nx IS NOT NULL), ic AS (SELECT date, corr(a, b) AS ic FROM z GROUP BY 1 HAVING count(*) >= 5),
    n AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i FROM ic) SELECT round(avg(ic), 6) AS ic_mean, round(avg(ic) FILTER (i % 5 = 0) / stddev_samp(ic) FILTER (i % 5 = 0) * sqrt(count(*) FILTER (i % 5 = 0)), 5) AS ic_tstat_nonoverlap, round(avg(CAST(ic > 0 AS INT)), 6) AS ic_positive_share, count(*) AS ic_days FROM n"""
)
def v2_ic_summary(spark, sf_dir):
    df = usable(features(spark, sf_dir)).withColumn("nx", ratio(F.lead("close", 1).over(by_ticker()), "close") - 1)
    found = validation.ic_summary(information_coefficients(df, "return_20d", "nx"), 5)
    return six(found.select("ic_mean", F.round("ic_tstat_nonoverlap", 5).alias("ic_tstat_nonoverlap"), "ic_positive_share", "ic_days"))


@query(with_sql("macro") + ", e AS (SELECT event_id, CAST(ts AS DATE) AS d FROM events) SELECT event_id, m.date AS known, round(vix, 6) AS vix FROM e ASOF LEFT JOIN macro m ON e.d > m.date")
def j6_events_as_of_macro(spark, sf_dir):
    """What was known of the economy before each event: no key, so rows lie in ranges of time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.to_date("ts").alias("d"))
    return six(asof(events, view(spark, sf_dir, "macro").withColumnRenamed("date", "known"), "d", "known", ["vix"], strict=True).drop("d"))


@query(
    "WITH r AS (SELECT event_type, ts AS seen, max(event_id) AS before FROM events WHERE value > 50 GROUP BY 1, 2) "
    "SELECT event_id, e.event_type, before, CAST(seen AS DATE) AS seen_on FROM events e ASOF LEFT JOIN r ON e.event_type = r.event_type AND e.ts > r.seen"
)
def j4_few_keys_as_of(spark, sf_dir):
    """The large event of the same type before each event: a handful of keys hold all rows."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts", "value")
    large = events.filter("value > 50").groupBy("event_type", F.col("ts").alias("seen")).agg(F.max("event_id").alias("before"))
    found = asof(events, large, "ts", "seen", ["before"], ["event_type"], strict=True, spread=True)
    return found.select("event_id", "event_type", "before", F.to_date("seen").alias("seen_on"))


@query(
    with_sql("panel", "companies", "membership") + """, k AS (SELECT DISTINCT ticker FROM panel), rq AS (SELECT ticker + CASE WHEN ticker % 9 = 0 THEN 100000 ELSE 0 END AS ticker FROM companies), ms AS (SELECT ticker FROM rq WHERE ticker NOT IN (SELECT ticker FROM k)),
    ls AS (SELECT ticker, max(date) AS last_date FROM panel GROUP BY 1 HAVING max(date) < (SELECT max(date) FROM panel) - 10), en AS (SELECT ticker, max(end_date) AS left_on FROM membership GROUP BY 1),
    dl AS (SELECT ls.ticker, ls.ticker % 2 = 0 AS bad FROM ls LEFT JOIN en USING (ticker) WHERE left_on IS NULL OR last_date < left_on + 38)
    SELECT (SELECT count(*) FROM rq) AS requested, (SELECT count(*) FROM ms) AS missing, (SELECT string_agg(CAST(ticker AS VARCHAR), ',' ORDER BY ticker) FROM (SELECT * FROM ms ORDER BY ticker LIMIT 15)) AS missing_examples,
      (SELECT count(*) FROM companies WHERE ticker % 13 = 0) AS failed, (SELECT string_agg(CAST(ticker AS VARCHAR), ',' ORDER BY ticker) FROM (SELECT ticker FROM companies WHERE ticker % 13 = 0 ORDER BY ticker LIMIT 5)) AS failed_examples,
      (SELECT count(*) FROM dl) AS stocks_ending_early, (SELECT count(*) FILTER (bad) FROM dl) AS assumed_performance_delistings"""
)
def c12_requests_failures_and_delistings(spark, sf_dir):
    """A ninth of the names asked for is unknown, a thirteenth of the filings failed, every second early end was a failure."""
    prices, companies = view(spark, sf_dir, "panel"), view(spark, sf_dir, "companies")
    asked = companies.select((F.col("ticker") + F.when(F.col("ticker") % 9 == 0, 100000).otherwise(0)).alias("ticker"))
    failures = companies.filter("ticker % 13 = 0").select("ticker", F.lit("no facts").alias("reason"))
    reasons = companies.select("ticker", F.when(F.col("ticker") % 2 == 0, "Chapter 11 filing").otherwise("merged").alias("reason"))
    gone = universe.delisting_returns(universe.delistings(prices, reasons, view(spark, sf_dir, "membership")))
    found = universe.data_quality(prices, companies, requested=asked, failures=failures, delistings=gone)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x["ticker"].cast("string")), ",").alias(c)
    return found.select("requested", "missing", listed("missing_examples"), "failed", listed("failed_examples"), "stocks_ending_early", "assumed_performance_delistings")


def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(with_sql("panel", "companies", "macro") + " SELECT ticker, date, round(close, 6) AS close, sector, round(vix, 6) AS vix FROM panel LEFT JOIN companies USING (ticker) LEFT JOIN macro USING (date)")
def k1_s21_dataset_round_trip(spark, sf_dir):
    """The dataset saved to a folder and loaded again; tables that are None stay so."""
    path = scratch(spark, "dataset")
    Dataset(view(spark, sf_dir, "panel"), companies=view(spark, sf_dir, "companies"), macro=view(spark, sf_dir, "macro")).save(path)
    again = Dataset.load(spark, path)
    if again.news is not None or again.eps is not None:
        raise ValueError("tables that were not saved came back")
    found = again.prices.join(again.companies.select("ticker", "sector"), "ticker", "left").join(again.macro.select("date", "vix"), "date", "left")
    return six(found.select("ticker", "date", "close", "sector", "vix"))


@query(with_sql("panel") + " SELECT CAST(ticker AS VARCHAR) AS ticker, date, round(close, 6) AS close, CAST(volume AS DOUBLE) AS volume FROM panel")
def s1_prices_from_csv(spark, sf_dir):
    """Prices landed as comma-separated files under other names of columns."""
    path = scratch(spark, "prices")
    named = view(spark, sf_dir, "panel").select(F.col("ticker").alias("Symbol"), F.col("date").alias("Date"), F.col("close").alias("Adj Close"), F.col("volume").alias("Volume"))
    save_artifact(named, path, "csv")
    return six(files.price_folder(spark, [path]).select("ticker", "date", "close", F.col("volume").cast("double").alias("volume")))


@query(SCORED + " SELECT ticker, date, rank, round(model_probability, 6) AS model_probability FROM scored")
def k5_rankings_recorded(spark, sf_dir):
    """A ranking recorded twice for one date is there once."""
    path = scratch(spark, "rankings")
    rows = scored(spark, sf_dir).select("ticker", "date", "rank", "model_probability")
    for shown in (rows.limit(3), rows):
        record_ranking(shown, path)
    return six(read(spark, path).select("ticker", "date", "rank", "model_probability"))


@query(features_sql() + f" SELECT ticker, date, {shown(FEATURES)} FROM features WHERE {USABLE}")
def t20_panel_in_two_appends(spark, sf_dir):
    """The price features of the weeks to 1995, then those after from the saved state."""
    path, weeks = scratch(spark, "panel-state"), view(spark, sf_dir, "panel")
    first, state = appending.append(None, weeks.filter("date < DATE '1996-01-01'"))
    state.save(path)
    later, _ = appending.append(appending.State.load(spark, path), weeks.filter("date >= DATE '1996-01-01'"))
    return rounded(usable(first.unionByName(later)), ["ticker", "date"], FEATURES)
