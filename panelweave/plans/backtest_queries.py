"""Queries on portfolios of the weekly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.frames import ppf_sql, rounded
from panelweave.functions.shared import settle_once
from panelweave.operators import backtest as bt
from panelweave.operators.stats import newey_west
from panelweave.plans.panel_queries import USABLE, companies_cte, features_sql, labels_sql, rank_sql, sectors, with_next_week
from panelweave.plans.registry import query

CONFIG = bt.Config(holding_days=4, cost_bps=10, borrow_bps=30)
STAGGERED = bt.Config(holding_days=4, exit_quantile=0.4, smooth_days=3, cost_model="spread", offsets=(0, 1, 2, 3))


def predictions(spark, sf_dir, *extra):
    """The percentile of the last month's return as score, the next week's as return;
    signals that are not named in `extra` are not computed."""
    from panelweave.operators.crosssection import percentile_ranks

    def make():
        df = with_next_week(spark, sf_dir, "return_20d", *[c for c in extra if c != "return_20d"])
        df = percentile_ranks(df.select("date", "ticker", "return_20d", "tradable_return_5d", *[c for c in extra if c != "return_20d"]), ["return_20d"])
        return df.select("date", "ticker", F.round("return_20d_xs_rank", 9).alias("probability"), F.col("tradable_return_5d").alias("tradable_return"), *extra)

    return settle_once(spark, make, "predictions", sf_dir, *extra)


PREDICTIONS = (
    features_sql() + ", " + labels_sql(5) + f""", u AS (SELECT * FROM features WHERE {USABLE}),
    predictions AS (SELECT date, ticker, round({rank_sql("return_20d", "date")} / count(return_20d) OVER (PARTITION BY date), 9) AS probability, tradable_return_5d AS tradable_return, beta_252, volatility_20d FROM u JOIN labels USING (ticker, date)),
    p AS (SELECT * FROM predictions WHERE tradable_return IS NOT NULL AND probability IS NOT NULL)"""
)
BOOKS = PREDICTIONS + """, d AS (SELECT date, count(*) AS names, row_number() OVER (ORDER BY date) - 1 AS no FROM p GROUP BY date),
    rb AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS period FROM d WHERE no % 4 = 0 AND names >= 5),
    xs AS (SELECT p.*, names, period, row_number() OVER (PARTITION BY period ORDER BY probability DESC, ticker) AS up, greatest(1, CAST(round_even(names * 0.2, 0) AS INT)) AS k FROM p JOIN rb USING (date)),
    book AS (SELECT period, date, ticker, 'long_only' AS strategy, 1.0 / k AS w, tradable_return AS r FROM xs WHERE up <= k
      UNION ALL SELECT period, date, ticker, 'long_short', 1.0 / k, tradable_return FROM xs WHERE up <= k
      UNION ALL SELECT period, date, ticker, 'long_short', -1.0 / k, tradable_return FROM xs WHERE names - up + 1 <= k
      UNION ALL SELECT period, date, ticker, 'benchmark', 1.0 / names, tradable_return FROM xs),
    ends AS (SELECT *, w * (1 + r) / sum(abs(w * (1 + r))) OVER (PARTITION BY period, strategy) * sum(abs(w)) OVER (PARTITION BY period, strategy) AS e FROM book),
    moved AS (SELECT coalesce(n.period, o.period + 1) AS period, coalesce(n.strategy, o.strategy) AS strategy, abs(coalesce(w, 0) - coalesce(e, 0)) AS t
      FROM book n FULL JOIN (SELECT period, strategy, ticker, e FROM ends) o ON n.period = o.period + 1 AND n.strategy = o.strategy AND n.ticker = o.ticker),
    tr AS (SELECT period, strategy, sum(t) AS turnover FROM moved GROUP BY 1, 2),
    bt AS (SELECT b.period, b.date, b.strategy, any_value(names) AS names, sum(w * r) AS gross, any_value(turnover) AS turnover,
      any_value(turnover) * 0.001 + CASE WHEN b.strategy = 'long_short' THEN 0.003 * 4 / 252 * sum(greatest(-w, 0)) ELSE 0 END AS cost
      FROM book b JOIN tr USING (period, strategy) JOIN rb USING (period) GROUP BY 1, 2, 3)"""


@query(BOOKS + " SELECT period, date, strategy, names, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(cost, 6) AS cost, round(gross - cost, 6) AS net FROM bt")
def b2_b11_backtest(spark, sf_dir):
    found = bt.backtest(predictions(spark, sf_dir), CONFIG)
    return found.select(F.col("period").cast("long").alias("period"), "date", "strategy", "names", *[F.round(c, 6).alias(c) for c in ("gross", "turnover", "cost", "net")])


@query(
    BOOKS + """, n AS (SELECT *, gross - cost AS net FROM bt), c AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY strategy ORDER BY period)) AS g FROM n),
    m AS (SELECT *, g / max(g) OVER (PARTITION BY strategy ORDER BY period) - 1 AS dd FROM c),
    a AS (SELECT avg(l.net - b.net) / stddev_samp(l.net - b.net) * sqrt(63) AS ir FROM n l JOIN n b USING (period) WHERE l.strategy = 'long_only' AND b.strategy = 'benchmark')
    SELECT strategy, count(*) AS periods, round(exp(sum(ln(1 + net))) - 1, 5) AS total_return, round(pow(exp(sum(ln(1 + net))), 63.0 / count(*)) - 1, 5) AS cagr, round(stddev_samp(net) * sqrt(63), 5) AS ann_volatility,
      round(avg(net) / stddev_samp(net) * sqrt(63), 5) AS sharpe, round(avg(CAST(net > 0 AS INT)), 5) AS hit_rate, round(min(dd), 5) AS max_drawdown, round(avg(CASE WHEN period > 0 THEN turnover END), 5) AS avg_turnover,
      round(avg(cost) * 63, 5) AS cost_drag, CASE WHEN strategy = 'long_only' THEN round((SELECT ir FROM a), 5) END AS information_ratio FROM m GROUP BY strategy"""
)
def b13_b15_summary(spark, sf_dir):
    found = bt.summary(bt.backtest(predictions(spark, sf_dir), CONFIG), CONFIG)
    values = ["total_return", "cagr", "ann_volatility", "sharpe", "hit_rate", "max_drawdown", "avg_turnover", "cost_drag", "information_ratio"]
    return found.select("strategy", "periods", *[F.round(c, 5).alias(c) for c in values])


@query(
    BOOKS + """, lv AS (SELECT strategy, unnest([0.0, 5.0, 10.0, 20.0, 40.0])::DOUBLE AS cost_bps, gross, turnover FROM bt WHERE strategy <> 'benchmark')
    SELECT strategy, cost_bps, round(pow(exp(sum(ln(1 + gross - turnover * cost_bps / 10000))), 63.0 / count(*)) - 1, 5) AS cagr,
      round(avg(gross - turnover * cost_bps / 10000) / stddev_samp(gross - turnover * cost_bps / 10000) * sqrt(63), 5) AS sharpe FROM lv GROUP BY 1, 2"""
)
def b18_cost_sensitivity(spark, sf_dir):
    found = bt.cost_sensitivity(bt.backtest(predictions(spark, sf_dir), CONFIG), CONFIG)
    return found.select("strategy", "cost_bps", F.round("cagr", 5).alias("cagr"), F.round("sharpe", 5).alias("sharpe"))


@query(
    BOOKS + """, q AS (SELECT period, tradable_return AS r, least(5, greatest(1, (row_number() OVER (PARTITION BY period ORDER BY probability, ticker) * 5 + names - 1) // names)) AS quantile FROM xs),
    dq AS (SELECT period, quantile, avg(r) AS r FROM q GROUP BY 1, 2) SELECT CAST(quantile AS INT) AS quantile, round(avg(r), 6) AS mean_return, count(*) AS observations FROM dq GROUP BY 1"""
)
def b16_quantile_returns(spark, sf_dir):
    found = bt.quantile_returns(predictions(spark, sf_dir), CONFIG)
    return found.select("quantile", F.round("mean_return", 6).alias("mean_return"), "observations")


#: Four offsets at once: smoothed scores, books under a buffer by a recursive fold,
#: costs by each name's spread, returns of the periods.
BUFFERED = PREDICTIONS.replace("WITH ", "WITH RECURSIVE ", 1).replace("beta_252, volatility_20d FROM u", "cs_spread_21d FROM u") + """,
    sm AS (SELECT * REPLACE (avg(probability) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS probability) FROM p),
    dd AS (SELECT date, count(*) AS names, row_number() OVER (ORDER BY date) - 1 AS no FROM sm GROUP BY date),
    rr AS (SELECT date, names, run, row_number() OVER (PARTITION BY run ORDER BY date) - 1 AS period FROM dd, (SELECT unnest([0, 1, 2, 3]) AS run) WHERE no >= run AND (no - run) % 4 = 0 AND names >= 5),
    x0 AS (SELECT sm.*, names, run, period, row_number() OVER (PARTITION BY run, period ORDER BY probability DESC, ticker) AS up, greatest(1, CAST(round_even(names * 0.2, 0) AS INT)) AS k,
      greatest(1, CAST(round_even(names * 0.4, 0) AS INT)) AS leave, median(cs_spread_21d) OVER (PARTITION BY run, period) AS middle FROM sm JOIN rr USING (date)),
    xs AS (SELECT *, 0.001 * CASE WHEN middle > 0 THEN coalesce(greatest(0.25, least(4.0, cs_spread_21d / middle)), 1.0) ELSE 1.0 END AS unit FROM x0),
    sides AS (SELECT *, unnest([1, -1]) AS side, unnest([up, names - up + 1]) AS rk FROM xs),
    pl AS (SELECT run, side, period, any_value(k) AS k, any_value(leave) AS leave, list(ticker ORDER BY rk) AS ns FROM sides GROUP BY 1, 2, 3),
    hold AS (SELECT run, side, period, ns[1:k] AS held FROM pl WHERE period = 0 UNION ALL
      SELECT run, side, period, list_concat(stay, list_filter(ns, lambda t: NOT list_contains(stay, t))[1:k - len(stay)]) FROM
        (SELECT pl.*, list_filter(ns[1:leave], lambda t: list_contains(h.held, t))[1:k] AS stay FROM hold h JOIN pl ON pl.run = h.run AND pl.side = h.side AND pl.period = h.period + 1)),
    picked AS (SELECT run, side, period, unnest(held) AS ticker, side / len(held) AS w FROM hold),
    book AS (SELECT run, period, ticker, 'long_only' AS strategy, w, tradable_return AS r FROM picked JOIN xs USING (run, period, ticker) WHERE side = 1
      UNION ALL SELECT run, period, ticker, 'long_short', w, tradable_return FROM picked JOIN xs USING (run, period, ticker)
      UNION ALL SELECT run, period, ticker, 'benchmark', 1.0 / names, tradable_return FROM xs),
    ends AS (SELECT *, w * (1 + r) / sum(abs(w * (1 + r))) OVER b * sum(abs(w)) OVER b AS e FROM book WINDOW b AS (PARTITION BY run, period, strategy)),
    moved AS (SELECT run, period, strategy, ticker, sum(w) AS w, sum(e) AS e FROM (SELECT run, period, strategy, ticker, w, 0.0 AS e FROM book UNION ALL SELECT run, period + 1, strategy, ticker, 0.0, e FROM ends) GROUP BY ALL),
    tr AS (SELECT run, period, strategy, sum(abs(w - e)) AS turnover, sum(abs(w - e) * coalesce(unit, mid)) AS cost FROM moved JOIN (SELECT run, period, median(unit) AS mid FROM xs GROUP BY ALL) USING (run, period)
      LEFT JOIN (SELECT run, period, ticker, unit FROM xs) USING (run, period, ticker) GROUP BY ALL),
    bt AS (SELECT run, period, strategy, any_value(turnover) AS turnover, any_value(cost) AS cost, sum(w * r) - any_value(cost) AS net FROM book JOIN tr USING (run, period, strategy) GROUP BY ALL)"""


@query(
    BUFFERED + """, s AS (SELECT run, strategy, CASE WHEN product(1 + net) > 0 THEN pow(product(1 + net), 63.0 / count(*)) - 1 ELSE -1 END AS cagr, avg(net) / nullif(stddev_samp(net), 0) * sqrt(63) AS sharpe FROM bt GROUP BY ALL)
    SELECT strategy, count(DISTINCT run) AS offsets, round(avg(cagr), 5) AS cagr_mean, round(min(cagr), 5) AS cagr_min, round(max(cagr), 5) AS cagr_max, round(avg(sharpe), 5) AS sharpe_mean, round(min(sharpe), 5) AS sharpe_min, round(max(sharpe), 5) AS sharpe_max FROM s GROUP BY strategy"""
)
def b4_b17_staggered_buffered(spark, sf_dir):
    """All four starting weeks of a buffered, spread-costed strategy in one job."""
    found = bt.staggered(bt.summary(bt.backtest(predictions(spark, sf_dir, "cs_spread_21d"), STAGGERED), STAGGERED))
    return found.select("strategy", "offsets", *[F.round(c, 5).alias(c) for c in found.columns if c not in ("strategy", "offsets")])


@query(BUFFERED + " SELECT run, period, strategy, round(turnover, 6) AS turnover, round(cost, 8) AS cost, round(net, 6) AS net FROM bt")
def b4_buffered_books(spark, sf_dir):
    """Turnover, cost and net return of every period of every offset."""
    found = bt.backtest(predictions(spark, sf_dir, "cs_spread_21d"), STAGGERED)
    return found.select("run", F.col("period").cast("long").alias("period"), "strategy", F.round("turnover", 6).alias("turnover"), F.round("cost", 8).alias("cost"), F.round("net", 6).alias("net"))


@query(
    BOOKS + ", " + companies_cte() + """, sx AS (SELECT x.period, x.ticker, tradable_return AS r, sector, count(*) OVER (PARTITION BY period, sector) AS n, row_number() OVER (PARTITION BY period, sector ORDER BY probability DESC, x.ticker) AS u FROM xs x JOIN companies c ON x.ticker = c.ticker),
    sk AS (SELECT *, greatest(1, CAST(round_even(n * 0.2, 0) AS INT)) AS kk FROM sx WHERE n >= 4)
    SELECT period, round(avg(r) FILTER (u <= kk), 6) AS long_only, round(avg(r) FILTER (u <= kk) - avg(r) FILTER (n - u + 1 <= kk), 6) AS long_short FROM sk GROUP BY period"""
)
def b5_sector_neutral(spark, sf_dir):
    config = bt.Config(holding_days=4, neutralize="sector")
    found = bt.backtest(sectors(spark, sf_dir, predictions(spark, sf_dir)), config).filter("strategy <> 'benchmark'")
    return found.groupBy(F.col("period").cast("long").alias("period")).pivot("strategy", ["long_only", "long_short"]).agg(F.round(F.first("gross"), 6))


@query(
    BOOKS + f""", z AS (SELECT period, date, {rank_sql("probability", "period")} AS a, {rank_sql("tradable_return", "period")} AS b FROM xs), ic AS (SELECT date, corr(a, b) AS ic, count(*) AS n FROM z GROUP BY date HAVING min(a) < max(a) AND min(b) < max(b)),
    e AS (SELECT *, ic - avg(ic) OVER () AS x, count(*) OVER () AS nn FROM ic), l AS (SELECT *, floor(4 * pow(nn / 100.0, 2.0 / 9)) AS g, row_number() OVER (ORDER BY date) AS i FROM e),
    v AS (SELECT sum(CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (a.i - b.i) / (a.g + 1)) END * a.x * b.x) / max(a.nn) AS var FROM l a JOIN l b ON b.i <= a.i AND a.i - b.i <= a.g)
    SELECT count(*) AS n, round(avg(ic), 6) AS mean, round(avg(ic) / sqrt((SELECT var FROM v) / count(*)), 5) AS t FROM ic"""
)
def v1_i1_rebalance_ic(spark, sf_dir):
    ic = bt.rebalance_ic(predictions(spark, sf_dir), CONFIG)
    return newey_west(ic, "ic").select("n", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"))


@query(
    PREDICTIONS + f""", b AS (SELECT * FROM predictions WHERE beta_252 IS NOT NULL AND probability IS NOT NULL), a AS (SELECT *, ({rank_sql("probability", "date")} - 0.5) / count(probability) OVER (PARTITION BY date) AS p1 FROM b),
    z AS (SELECT *, 0.02 * coalesce(volatility_20d, median(volatility_20d) OVER (PARTITION BY date), 0.3) * sqrt(5 / 252.0) * ({ppf_sql("p1")}) AS alpha FROM a),
    c AS (SELECT *, beta_252 - avg(beta_252) OVER (PARTITION BY date) AS x, alpha - avg(alpha) OVER (PARTITION BY date) AS y FROM z),
    r AS (SELECT *, y - CASE WHEN sum(x * x) OVER (PARTITION BY date) > 1e-18 THEN sum(x * y) OVER (PARTITION BY date) / sum(x * x) OVER (PARTITION BY date) ELSE 0 END * x AS res FROM c)
    SELECT date, ticker, round(res / nullif(sum(abs(res)) OVER (PARTITION BY date), 0) * 2, 6) AS w FROM r"""
)
def b21_neutral_weights(spark, sf_dir):
    """Long-short weights without net beta."""
    return bt.neutral_weights(predictions(spark, sf_dir, "beta_252", "volatility_20d").filter("beta_252 IS NOT NULL"), ["beta_252"]).select("date", "ticker", rounded("w", 6).alias("w"))
