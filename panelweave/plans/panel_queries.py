"""Queries on the price panel: calendar, features, labels, cross-section."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.frames import avg_rank, group_count, ppf_sql
from panelweave.functions.shared import settle_once
from panelweave.operators import crosssection, labels, prices
from panelweave.operators.calendar import on_calendar, session_calendar
from panelweave.operators.stats import information_coefficients
from panelweave.plans.proxies import VIEWS, view, with_sql
from panelweave.plans.registry import query

Y = "252"


def rounded(df: DataFrame, keys: Sequence[str], values: Sequence[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in values])


def shown(values: Sequence[str], digits: int = 6) -> str:
    return ", ".join(f"round({v}, {digits}) AS {v}" for v in values)


def dense_sql(panel: str = "panel") -> str:
    """CTEs after `panel`: sessions, dense (with fill flags and carried closes)."""
    cols = "p.high, p.low, p.volume" if panel == "panel" else "p.volume"
    return f"""{with_sql(panel)}, counts AS (SELECT date, count(DISTINCT ticker) AS n FROM {panel} GROUP BY date),
    sessions AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS session_no FROM (SELECT *, max(n) OVER (ORDER BY date) AS most FROM counts) WHERE n >= 0.2 * most),
    spans AS (SELECT ticker, min(date) AS a, max(date) AS b FROM {panel} GROUP BY ticker),
    grid AS (SELECT ticker, date FROM spans JOIN sessions ON date BETWEEN a AND b),
    dense AS (SELECT g.ticker, g.date, p.ticker IS NULL AS filled, {cols},
      last_value(p.close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS close
      FROM grid g LEFT JOIN {panel} p ON g.ticker = p.ticker AND g.date = p.date)"""


def roll_sql(how: str, col: str, n: int, least: int) -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {w} >= {least} THEN {how}({col}) {w} END"


def features_sql() -> str:
    lag = lambda c, n: f"lag({c}, {n}) OVER (PARTITION BY ticker ORDER BY date)"
    return f"""{dense_sql()},
    f1 AS (SELECT *, close / {lag("close", 1)} - 1 AS return_1d, close / {lag("close", 5)} - 1 AS return_5d, close / {lag("close", 20)} - 1 AS return_20d,
      close / {lag("close", 60)} - 1 AS momentum_60d, {lag("close", 21)} / {lag("close", 252)} - 1 AS momentum_12_1,
      close / ({roll_sql("avg", "close", 50, 50)}) - 1 AS ma_gap_50d, close / ({roll_sql("max", "close", 252, 126)}) AS high_52w,
      volume / ({roll_sql("avg", "volume", 20, 20)}) AS volume_ratio_20d,
      coalesce(greatest({lag("close", 1)} - high, 0), 0) - coalesce(greatest(low - {lag("close", 1)}, 0), 0) AS shift, {lag("high", 1)} AS h1, {lag("low", 1)} AS l1 FROM dense),
    f2 AS (SELECT *, CASE WHEN NOT filled THEN greatest(-0.5, least(0.5, return_1d)) END AS r,
      pow(ln(h1 / l1), 2) + pow(ln((high + shift) / (low + shift)), 2) AS bt,
      pow(ln(greatest(h1, high + shift) / least(l1, low + shift)), 2) AS gm FROM f1),
    f3 AS (SELECT *, avg(r) OVER (PARTITION BY date) AS market_return_1d, (sqrt(2 * bt) - sqrt(bt)) / (3 - 2 * sqrt(2)) - sqrt(gm / (3 - 2 * sqrt(2))) AS al FROM f2),
    f4 AS (SELECT *, CASE WHEN r IS NOT NULL THEN market_return_1d END AS m, CASE WHEN high IS NOT NULL AND h1 IS NOT NULL THEN greatest(2 * (exp(al) - 1) / (1 + exp(al)), 0) END AS sp FROM f3),
    f5 AS (SELECT *, r * m AS rm, m * m AS mm FROM f4),
    f6 AS (SELECT *, {roll_sql("avg", "r", 252, 126)} AS er, {roll_sql("avg", "m", 252, 126)} AS em, {roll_sql("avg", "rm", 252, 126)} AS erm, {roll_sql("avg", "mm", 252, 126)} AS emm FROM f5),
    f7 AS (SELECT *, (erm - er * em) / nullif(emm - em * em, 0) AS beta_252 FROM f6),
    f8 AS (SELECT *, r - {lag("beta_252", 1)} * m AS e FROM f7),
    f9 AS (SELECT *, {roll_sql("sum", "e", 231, 126)} AS es, {roll_sql("stddev_samp", "e", 231, 126)} AS ed FROM f8),
    features AS (SELECT *, {roll_sql("stddev_samp", "return_1d", 20, 20)} * sqrt(252) AS volatility_20d, {roll_sql("stddev_samp", "e", 63, 42)} * sqrt(252) AS idio_vol_63,
      {roll_sql("max", "r", 21, 15)} AS max_return_21, {roll_sql("avg", "sp", 21, 10)} AS cs_spread_21d,
      {lag("es", 21)} / nullif({lag("ed", 21)} * sqrt(231), 0) AS residual_momentum FROM f9)"""


FEATURES = [
    "return_1d", "return_5d", "return_20d", "momentum_60d", "momentum_12_1", "volatility_20d", "ma_gap_50d", "volume_ratio_20d", "market_return_1d",
    "beta_252", "idio_vol_63", "residual_momentum", "max_return_21", "high_52w", "cs_spread_21d",
]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly panel with its price features, computed once a session and folder."""
    return settle_once(spark, lambda: prices.price_features(on_calendar(view(spark, sf_dir, "panel"))), "features", sf_dir)


REAL = "NOT _filled AND return_5d IS NOT NULL AND return_20d IS NOT NULL AND volatility_20d IS NOT NULL"


def usable(df: DataFrame) -> DataFrame:
    """Real sessions past the warm-up."""
    return df.filter(REAL)


def with_next_week(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The given features and the next week's returns of usable rows. All rows go to
    the tickers' windows, so only what is needed does, and one mark of use."""
    rows = features(spark, sf_dir).select("ticker", "date", "close", F.coalesce(F.expr(REAL), F.lit(False)).alias("_use"), *columns)
    return labels.forward_returns(rows, horizons=(5,)).filter("_use").drop("_use")


USABLE = "NOT filled AND return_5d IS NOT NULL AND return_20d IS NOT NULL AND volatility_20d IS NOT NULL"


def labels_sql(h: int) -> str:
    """CTE `labels` after `dense`: forward and tradable return of one horizon."""
    ahead = lambda n: f"CASE WHEN ended AND togo < {n} THEN final ELSE lead(close, {n}) OVER w END"
    return f"""base AS (SELECT *, count(*) OVER (PARTITION BY ticker) - row_number() OVER (PARTITION BY ticker ORDER BY date) AS togo,
      max(date) OVER (PARTITION BY ticker) < (SELECT max(date) FROM dense) - 10 AS ended,
      last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM dense),
    labels AS (SELECT ticker, date, ({ahead(h)}) / close - 1 AS future_return_{h}d, ({ahead(h + 1)}) / lead(close, 1) OVER w - 1 AS tradable_return_{h}d FROM base WINDOW w AS (PARTITION BY ticker ORDER BY date))"""


def rank_sql(col: str, keys: str) -> str:
    """Average rank of the non-null values of a column within the keys."""
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {col} NULLS LAST) + (count({col}) OVER (PARTITION BY {keys}, {col}) - 1) / 2.0)"


@query(dense_sql() + " SELECT date, session_no FROM sessions")
def t1_session_calendar(spark, sf_dir):
    return session_calendar(view(spark, sf_dir, "panel")).select("date", F.col("session_no").cast("long").alias("session_no"))


@query(dense_sql("daily") + " SELECT ticker, date, filled, round(close, 6) AS close, volume FROM dense")
def t2_t3_dense_daily(spark, sf_dir):
    dense = on_calendar(view(spark, sf_dir, "daily"))
    return dense.select("ticker", "date", F.col("_filled").alias("filled"), F.round("close", 6).alias("close"), "volume")


@query(features_sql() + f" SELECT ticker, date, {shown(FEATURES)} FROM features WHERE {USABLE}")
def t18_price_features(spark, sf_dir):
    return rounded(usable(features(spark, sf_dir)), ["ticker", "date"], FEATURES)


@query(
    dense_sql() + ", " + labels_sql(5) + ", l21 AS (SELECT ticker AS t, date AS d, future_return_21d, tradable_return_21d FROM (" + "WITH " + labels_sql(21) + " SELECT * FROM labels)) "
    "SELECT ticker, date, round(future_return_5d, 6) AS future_return_5d, round(tradable_return_5d, 6) AS tradable_return_5d, round(future_return_21d, 6) AS future_return_21d, "
    "round(tradable_return_21d, 6) AS tradable_return_21d, CASE WHEN future_return_5d IS NOT NULL THEN CAST(future_return_5d > 0 AS DOUBLE) END AS target_up_5d FROM labels JOIN l21 ON ticker = t AND date = d"
)
def l1_l3_forward_returns(spark, sf_dir):
    df = labels.forward_returns(on_calendar(view(spark, sf_dir, "panel")))
    return rounded(df, ["ticker", "date"], ["future_return_5d", "tradable_return_5d", "future_return_21d", "tradable_return_21d", "target_up_5d"])


def sectors(spark, sf_dir, df: DataFrame) -> DataFrame:
    """Companies are one row a ticker; the planner broadcasts them if they are small."""
    return df.join(view(spark, sf_dir, "companies").select("ticker", "sector", "industry"), "ticker", "left")


def companies_cte() -> str:
    return f"companies AS ({VIEWS['companies'].replace('{', '').replace('}', '')})"


@query(
    features_sql() + ", " + labels_sql(5) + ", " + companies_cte() + f""",
    u AS (SELECT f.*, sector, future_return_5d, future_return_5d / greatest(volatility_20d, 0.05) AS s FROM features f JOIN labels USING (ticker, date) JOIN companies USING (ticker) WHERE {USABLE}),
    v AS (SELECT *, median(future_return_5d) OVER (PARTITION BY date) AS md, count(future_return_5d) OVER (PARTITION BY date) AS n, count(s) OVER (PARTITION BY date) AS ns,
      median(future_return_5d) OVER (PARTITION BY date, sector) AS smd, count(future_return_5d) OVER (PARTITION BY date, sector) AS sn, count(s) OVER (PARTITION BY date, sector) AS sns,
      {rank_sql("s", "date")} AS rk, {rank_sql("s", "date, sector")} AS srk FROM u)
    SELECT ticker, date, CASE WHEN future_return_5d IS NOT NULL AND n >= 4 THEN CAST(future_return_5d > md AS DOUBLE) END AS target_beat_median_5d,
      CASE WHEN future_return_5d IS NOT NULL AND sn >= 4 THEN CAST(future_return_5d > smd AS DOUBLE) END AS target_beat_sector_5d,
      CASE WHEN future_return_5d IS NOT NULL AND n >= 4 THEN round((rk - 0.5) / ns, 6) END AS target_rank_market_5d,
      CASE WHEN future_return_5d IS NOT NULL AND sn >= 4 THEN round((srk - 0.5) / sns, 6) END AS target_rank_sector_5d FROM v"""
)
def l4_l5_relative_targets(spark, sf_dir):
    df = labels.forward_returns(features(spark, sf_dir), horizons=(5,))
    df = labels.relative_targets(sectors(spark, sf_dir, usable(df)), (5,))
    return rounded(df, ["ticker", "date"], ["target_beat_median_5d", "target_beat_sector_5d", "target_rank_market_5d", "target_rank_sector_5d"])


RANKED = ["return_20d", "momentum_60d", "momentum_12_1", "volatility_20d"]


@query(
    features_sql() + f", u AS (SELECT * FROM features WHERE {USABLE}), v AS (SELECT ticker, date, "
    + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {rank_sql(c, 'date')} / count({c}) OVER (PARTITION BY date) END AS {c}_xs_rank, CASE WHEN {c} IS NOT NULL THEN ({rank_sql(c, 'date')} - 0.5) / count({c}) OVER (PARTITION BY date) END AS {c}_p" for c in RANKED)
    + " FROM u) SELECT ticker, date, " + ", ".join(f"round({c}_xs_rank, 6) AS {c}_xs_rank, round({ppf_sql(f'{c}_p')}, 6) AS {c}_z" for c in RANKED) + " FROM v"
)
def x6_x7_ranks(spark, sf_dir):
    df = usable(features(spark, sf_dir)).select("ticker", "date", *RANKED)
    df = crosssection.gaussian_ranks(crosssection.percentile_ranks(df, RANKED), RANKED)
    return rounded(df, ["ticker", "date"], [f"{c}_{e}" for c in RANKED for e in ("xs_rank", "z")])


@query(
    features_sql() + ", " + companies_cte() + f""", u AS (SELECT f.*, sector, industry, count(*) OVER (PARTITION BY date, industry) AS n FROM features f JOIN companies USING (ticker) WHERE {USABLE}),
    g AS (SELECT *, CASE WHEN n >= 5 THEN industry ELSE sector END AS industry_group FROM u)
    SELECT ticker, date, industry_group, round(return_5d - median(return_5d) OVER (PARTITION BY date, industry_group), 6) AS return_5d_vs_industry,
      round(return_20d - median(return_20d) OVER (PARTITION BY date, industry_group), 6) AS return_20d_vs_industry,
      round(avg(momentum_12_1) OVER (PARTITION BY date, industry_group), 6) AS industry_momentum,
      round(return_20d - median(return_20d) OVER (PARTITION BY date, sector), 6) AS return_20d_vs_sector FROM g"""
)
def x2_x5_relative_returns(spark, sf_dir):
    df = crosssection.relative_returns(sectors(spark, sf_dir, usable(features(spark, sf_dir))))
    return rounded(df, ["ticker", "date", "industry_group"], ["return_5d_vs_industry", "return_20d_vs_industry", "industry_momentum", "return_20d_vs_sector"])


@query(
    dense_sql() + ", " + labels_sql(5) + """, m AS (SELECT ticker, date, filled, lag(close, 21) OVER (PARTITION BY ticker ORDER BY date) / lag(close, 252) OVER (PARTITION BY ticker ORDER BY date) - 1 AS momentum_12_1 FROM dense),
    j AS (SELECT m.*, future_return_5d AS f FROM m JOIN labels USING (ticker, date) WHERE NOT filled AND momentum_12_1 IS NOT NULL AND future_return_5d IS NOT NULL),
    """ + f"k AS (SELECT date, {rank_sql('momentum_12_1', 'date')} AS a, {rank_sql('f', 'date')} AS b FROM j), ic AS (SELECT date, corr(a, b) AS ic FROM k GROUP BY date HAVING count(*) >= 5 AND min(a) < max(a) AND min(b) < max(b)) "
    "SELECT CAST(year(date) AS INT) AS year, count(*) AS dates, round(avg(ic), 6) AS mean_ic FROM ic GROUP BY 1"
)
def flagship_momentum_ic(spark, sf_dir):
    df = labels.forward_returns(on_calendar(view(spark, sf_dir, "panel")), horizons=(5,))
    from panelweave.functions.frames import by_ticker, ratio

    momentum = ratio(F.lag("close", 21).over(by_ticker()), F.lag("close", 252).over(by_ticker())) - 1
    df = df.withColumn("momentum_12_1", momentum).filter("NOT _filled")
    ic = information_coefficients(df, "momentum_12_1", "future_return_5d")
    return ic.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("dates"), F.round(F.avg("ic"), 6).alias("mean_ic"))
