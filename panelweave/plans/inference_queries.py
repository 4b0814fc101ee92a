"""Queries on validation, attribution and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import backtest as bt
from panelweave.operators import inference, validation
from panelweave.plans.backtest_queries import BOOKS, CONFIG, PREDICTIONS, predictions
from panelweave.plans.panel_queries import RANKED, USABLE, features, features_sql, rank_sql, usable, with_next_week
from panelweave.plans.proxies import view, with_sql
from panelweave.plans.registry import query
from panelweave.plans.serving_queries import six


def returns(spark, sf_dir):
    found = bt.backtest(predictions(spark, sf_dir), CONFIG)
    return found.groupBy("date").pivot("strategy", ["long_only", "long_short", "benchmark"]).agg(F.first("net"))


@query(
    with_sql("panel") + """, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS no, count(*) OVER () AS n, lag(date, 6) OVER (ORDER BY date) AS e FROM (SELECT DISTINCT date FROM panel)),
    k AS (SELECT *, no - n // 2 AS k, n - n // 2 AS m FROM d WHERE no >= n // 2), f AS (SELECT *, CASE WHEN k < m % 5 * (m // 5 + 1) THEN k // (m // 5 + 1) ELSE m % 5 + (k - m % 5 * (m // 5 + 1)) // (m // 5) END + 1 AS fold FROM k)
    SELECT CAST(fold AS INT) AS fold, arg_min(e, date) AS train_end, min(date) AS test_start, max(date) AS test_end FROM f GROUP BY 1"""
)
def m12_folds(spark, sf_dir):
    return validation.folds(view(spark, sf_dir, "panel"), 5, 0.5, 5)


@query(
    PREDICTIONS + """, c AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY probability, date, ticker) AS rn FROM p),
    b AS (SELECT *, greatest(1, CAST(ceil((rn - 1) * 10 / (n - 1)) AS INT)) AS bucket FROM c) SELECT bucket, round(avg(probability), 6) AS mean_predicted, round(avg(CAST(tradable_return > 0 AS INT)), 6) AS actual_rate, count(*) AS rows FROM b GROUP BY 1"""
)
def v5_calibration(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("target", (F.col("tradable_return") > 0).cast("int"))
    return six(validation.calibration(rows))


@query(
    PREDICTIONS + f", r AS (SELECT *, {rank_sql('probability', 'one')} AS rk FROM (SELECT *, 1 AS one FROM p)) SELECT round((sum(CASE WHEN tradable_return > 0 THEN rk END) - count(*) FILTER (tradable_return > 0) * (count(*) FILTER (tradable_return > 0) + 1) / 2) / (count(*) FILTER (tradable_return > 0) * count(*) FILTER (tradable_return <= 0)), 6) AS auc FROM r"
)
def v3_auc(spark, sf_dir):
    rows = predictions(spark, sf_dir).filter("tradable_return IS NOT NULL").withColumn("label", (F.col("tradable_return") > 0).cast("int"))
    return six(validation.auc(rows, "label", "probability"))


@query(
    features_sql() + f", u AS (SELECT *, lead(close, 1) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS nx FROM features WHERE {USABLE}), x AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS signal, date, {c} AS v, nx FROM u" for c in RANKED)
    + f"), y AS (SELECT * FROM x WHERE v IS NOT NULL AND nx IS NOT NULL), z AS (SELECT signal, date, {rank_sql('v', 'signal, date')} AS a, {rank_sql('nx', 'signal, date')} AS b FROM y), ic AS (SELECT signal, date, corr(a, b) AS ic FROM z GROUP BY 1, 2 HAVING count(*) >= 5) "
    "SELECT signal, round(avg(ic), 6) AS ic_mean, round(avg(CAST(ic > 0 AS INT)), 6) AS ic_positive_share, count(*) AS ic_days FROM ic GROUP BY 1"
)
def v7_signal_report(spark, sf_dir):
    from panelweave.functions.frames import by_ticker, ratio

    df = usable(features(spark, sf_dir)).withColumn("nx", ratio(F.lead("close", 1).over(by_ticker()), "close") - 1)
    found = validation.signal_report(df, RANKED, "nx", 1)
    return six(found.select("signal", "ic_mean", "ic_positive_share", "ic_days"))


@query(
    features_sql() + f", u AS (SELECT * FROM features WHERE {USABLE}), x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS signal, {c} AS x FROM u" for c in RANKED)
    + ") SELECT signal, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(skewness(x), 5) AS skew, round(kurtosis(x), 5) AS kurtosis, round(quantile_cont(x, 0.01), 6) AS p01, round(quantile_cont(x, 0.99), 6) AS p99, round(avg(CAST(x IS NULL AS INT)), 6) AS missing FROM x GROUP BY 1"
)
def v10_exploratory(spark, sf_dir):
    found = validation.exploratory(usable(features(spark, sf_dir)), RANKED)
    return six(found.withColumns({c: F.round(c, 5) for c in ("skew", "kurtosis")}))


@query(
    PREDICTIONS + f""", m AS (SELECT date, ticker, momentum_12_1, tradable_return_5d AS r FROM u JOIN labels USING (ticker, date) WHERE momentum_12_1 IS NOT NULL AND tradable_return_5d IS NOT NULL),
    k AS (SELECT date, r, {rank_sql("momentum_12_1", "date")} / count(*) OVER (PARTITION BY date) AS p FROM m)
    SELECT date, CASE WHEN count(*) >= 30 THEN round(avg(r) FILTER (p >= 0.7) - avg(r) FILTER (p <= 0.3), 6) END AS "MOM" FROM k GROUP BY 1"""
)
def a1_factor_returns(spark, sf_dir):
    df = with_next_week(spark, sf_dir, "momentum_12_1")
    return six(inference.factor_returns(df.select("date", "ticker", "momentum_12_1", "tradable_return_5d"), "tradable_return_5d"))


@query(
    BOOKS + """, n AS (SELECT date, sum(CASE WHEN strategy = 'long_only' THEN gross - cost END) AS y, sum(CASE WHEN strategy = 'benchmark' THEN gross - cost END) AS x FROM bt GROUP BY 1)
    SELECT round(regr_intercept(y, x) * 63, 6) AS alpha_annual, round(regr_slope(y, x), 6) AS beta_benchmark, round(regr_r2(y, x), 6) AS r_squared, count(*)::DOUBLE AS periods FROM n"""
)
def a2_attribution(spark, sf_dir):
    found = inference.attribute(returns(spark, sf_dir), "long_only", ["benchmark"], CONFIG.per_year)
    row = {k: round(found[k], 6) for k in ("alpha_annual", "beta_benchmark", "r_squared", "periods")}
    return spark.createDataFrame([row], "alpha_annual double, beta_benchmark double, r_squared double, periods double")


def _draws_sql(reps: int = 2000, seed: int = 42) -> str:
    """CTEs after `o` (i from 0, nn periods): every place of every repetition, `idx`."""
    u = lambda what: f"(CAST('0x' || substr(md5(concat_ws(':', '{seed}', rep, block, '{what}')), 1, 13) AS BIGINT) / 4503599627370496.0)"
    return f"""c AS (SELECT max(nn) AS nn, greatest(2.0, pow(max(nn), 1 / 3.0)) AS mb FROM o), c2 AS (SELECT *, CAST(least(nn, ceil(nn / mb + 8 * sqrt(nn / mb)) + 8) AS BIGINT) AS most FROM c),
    rbl AS (SELECT rep, unnest(range(most)) AS block, nn, mb, most FROM c2, range({reps}) t(rep)),
    dz AS (SELECT *, CAST(least(nn, 1 + floor(ln(1 - {u("size")}) / ln(1 - 1 / mb))) AS BIGINT) AS size, CAST(floor({u("start")} * nn) AS BIGINT) AS start FROM rbl),
    df AS (SELECT *, sum(size) OVER (PARTITION BY rep ORDER BY block) - size AS first FROM dz),
    dk AS (SELECT rep, start, CASE WHEN block = most - 1 THEN nn - first ELSE least(size, nn - first) END AS size, nn FROM df WHERE first < nn),
    pl AS (SELECT rep, CAST((start + k) % nn AS BIGINT) AS idx FROM (SELECT *, unnest(range(CAST(size AS BIGINT))) AS k FROM dk))"""


@query(
    BOOKS + f""", o AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS nn FROM (SELECT date, max(gross - cost) FILTER (strategy = 'long_only') AS s1, max(gross - cost) FILTER (strategy = 'long_short') AS s2, max(gross - cost) FILTER (strategy = 'benchmark') AS s3 FROM bt GROUP BY 1)),
    {_draws_sql()}, x AS (SELECT rep, unnest(['long_only', 'long_short', 'benchmark']) AS strategy, unnest([s1, s2, s3]) AS r FROM pl JOIN o ON idx = i),
    y AS (SELECT rep, strategy, CASE WHEN product(1 + r) > 0 THEN pow(product(1 + r), 63.0 / count(*)) - 1 ELSE -1 END AS cagr, avg(r) / nullif(stddev_samp(r), 0) * sqrt(63) AS sharpe FROM x GROUP BY 1, 2)
    SELECT strategy, round(quantile_cont(cagr, 0.025), 5) AS cagr_low, round(quantile_cont(cagr, 0.975), 5) AS cagr_high, round(quantile_cont(sharpe, 0.025), 5) AS sharpe_low, round(quantile_cont(sharpe, 0.975), 5) AS sharpe_high, round(avg(CAST(sharpe <= 0 AS INT)), 6) AS prob_sharpe_not_positive FROM y GROUP BY 1"""
)
def i4_bootstrap_performance(spark, sf_dir):
    """Intervals of all three books over 2,000 resamples."""
    found = inference.bootstrap_performance(returns(spark, sf_dir), ["long_only", "long_short", "benchmark"], CONFIG.per_year)
    return six(found.withColumns({c: F.round(c, 5) for c in ("cagr_low", "cagr_high", "sharpe_low", "sharpe_high")}))


@query(
    BOOKS + f""", o AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS nn FROM (SELECT date, max(gross - cost) FILTER (strategy = 'long_only') AS y, max(gross - cost) FILTER (strategy = 'benchmark') AS x FROM bt GROUP BY 1)),
    {_draws_sql()}, a AS (SELECT rep, regr_intercept(y, x) * 63 AS alpha FROM pl JOIN o ON idx = i GROUP BY 1)
    SELECT round(quantile_cont(alpha, 0.025), 5) AS alpha_low, round(quantile_cont(alpha, 0.975), 5) AS alpha_high, round(avg(CAST(alpha <= 0 AS INT)), 6) AS prob_alpha_not_positive FROM a"""
)
def i5_bootstrap_alpha(spark, sf_dir):
    found = inference.bootstrap_alpha(returns(spark, sf_dir), "long_only", ["benchmark"], CONFIG.per_year)
    return six(found.withColumns({c: F.round(c, 5) for c in ("alpha_low", "alpha_high")}))


@query(
    BOOKS + """, n AS (SELECT date, max(gross - cost) FILTER (strategy = 'long_only') AS s1, max(gross - cost) FILTER (strategy = 'long_short') AS s2, max(gross - cost) FILTER (strategy = 'benchmark') AS s3 FROM bt GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM n), p2 AS (SELECT *, least(12, n // 4) // 2 * 2 AS sp FROM o), q AS (SELECT *, n // sp AS z, n % sp AS m FROM p2),
    b AS (SELECT *, CASE WHEN i < m * (z + 1) THEN i // (z + 1) ELSE m + (i - m * (z + 1)) // z END AS block FROM q), l AS (SELECT block, no, x FROM (SELECT block, unnest([1, 2, 3]) AS no, unnest([s1, s2, s3]) AS x FROM b)),
    s AS (SELECT block, no, sum(x) AS s, sum(x * x) AS q, count(*) AS c FROM l GROUP BY 1, 2), h AS (SELECT id FROM range(4096) t(id) WHERE bit_count(id) = 6 AND (SELECT max(sp) FROM p2) = 12),
    g AS (SELECT id, no, (id >> block) & 1 AS side, sum(s) AS s, sum(q) AS q, sum(c) AS c FROM h CROSS JOIN s GROUP BY 1, 2, 3), r AS (SELECT id, no, side, CASE WHEN (q - s * s / c) / (c - 1) > 0 THEN s / c / sqrt((q - s * s / c) / (c - 1)) END AS sr FROM g),
    k AS (SELECT a.id, a.no, a.sr AS ins, row_number() OVER (PARTITION BY a.id ORDER BY b.sr NULLS LAST, a.no) AS place FROM r a JOIN r b ON a.id = b.id AND a.no = b.no AND a.side = 1 AND b.side = 0),
    w AS (SELECT id, place / 4.0 AS share FROM k WHERE ins IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ins DESC, no) = 1)
    SELECT round(avg(CAST(ln(share / (1 - share)) <= 0 AS INT)), 6) AS pbo, count(*) AS combinations, 3 AS strategies, 12 AS splits FROM w"""
)
def i9_overfitting_probability(spark, sf_dir):
    return six(inference.overfitting_probability(returns(spark, sf_dir), ["long_only", "long_short", "benchmark"], 12))


@query(
    with_sql("macro") + """, f AS (SELECT date, vix / 1000 AS "F" FROM macro) SELECT date, CASE WHEN count("F") OVER w = 5 THEN round(exp(sum(ln(1 + "F")) OVER w) - 1, 6) END AS "F" FROM f WINDOW w AS (ORDER BY date ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING)"""
)
def a4_compound_factors(spark, sf_dir):
    daily = view(spark, sf_dir, "macro").select("date", (F.col("vix") / 1000).alias("F"))
    return six(inference.compound_factors(daily, 5))
