"""From the tables of a dataset to the feature panel, in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.frames import clean
from panelweave.functions.shared import settle
from panelweave.operators import crosssection, events, labels, news, universe
from panelweave.operators.calendar import on_calendar, session_grid
from panelweave.operators.prices import price_features
from panelweave.sources.store import Dataset

WARM_UP = ("return_5d", "return_20d", "volatility_20d")
#: Signals that are ranked and standardised within each date, where the panel has them.
RANKED = (
    "return_5d", "return_20d", "momentum_60d", "momentum_12_1", "residual_momentum", "volatility_20d", "idio_vol_63", "max_return_21", "beta_252", "high_52w", "volume_ratio_20d",
    "return_5d_vs_industry", "return_20d_vs_industry", "return_20d_vs_sector", "industry_momentum", "sentiment_20d", "market_cap", "earnings_yield", "sales_yield", "book_to_market",
    "profit_margin", "roe", "gross_profitability", "accruals", "asset_growth", "net_issuance", "sue", "ear", "insider_purchases_90d", "insider_net_value_90d",
)


def past_warm_up(df: DataFrame, needed: tuple[str, ...] = WARM_UP) -> DataFrame:
    """Real sessions on which the first signals are known; infinities become null first."""
    rows = df.filter(~F.col("_filled")).drop("_filled") if "_filled" in df.columns else df
    return clean(rows).dropna(subset=list(needed))


#: What relative returns, targets and products are made of, and the ranked columns behind the products.
PEERS = ("ticker", "date", "in_index", "sector", "industry", "volatility_20d", "return_5d", "return_20d", "momentum_12_1", "vix_regime")
PRODUCTS = {"reversal_x_vix": ("return_5d_vs_industry", "return_5d"), "momentum_x_vix": ("momentum_12_1",)}


def cross_section(df: DataFrame, horizons=labels.HORIZONS, columns: tuple[str, ...] = RANKED, only: Sequence[str] | None = None) -> DataFrame:
    """Relative returns, ranks, normal scores, relative targets and regime products,
    all after one exchange by date; where `only` names the columns that are read, no
    others go there or are ranked."""
    futures = [f"future_return_{h}d" for h in horizons]
    if only is not None:
        behind = {c for name, of in PRODUCTS.items() if name in only for c in of}
        columns = tuple(c for c in columns if c in behind or f"{c}_xs_rank" in only or f"{c}_z" in only)
        df = df.select(*[c for c in df.columns if c in {*only, *columns, *PEERS, *futures}])
    df = crosssection.relative_returns(df.repartition("date"))
    held, before = [c for c in columns if c in df.columns], list(df.columns)
    df = labels.relative_targets(df, horizons)
    targets = [c for c in df.columns if c not in before]
    if only is not None:
        df = df.select(*[c for c in df.columns if c in {*only, *held, "ticker", "date", "in_index", "vix_regime"}])
    if held:
        df = crosssection.ranks_and_scores(df, held)
    df = df.select(*[c for c in df.columns if c not in targets], *[c for c in targets if c in df.columns])
    df = crosssection.regime_interactions(df)
    return df if only is None else df.select(*only)


def _with_events(prices: DataFrame, data: Dataset) -> DataFrame:
    """The dense prices with what filings, earnings, news and insiders hold for each
    session. These are joined to tickers and dates alone, so no features are shuffled
    for them; all windows over them come after, with those of the prices."""
    found = sessions = session_grid(prices)
    if data.fundamentals is not None:
        found = events.filed(found, data.fundamentals)
    if data.eps is not None:
        found = events.surprised(found, data.eps, data.earnings_dates)
    if data.earnings_dates is not None:
        found = found.join(events.release_sessions(data.earnings_dates, sessions), ["ticker", "date"], "left")
    if data.news is not None:
        found = found.join(news.align(news.daily_news(data.news), sessions), ["ticker", "date"], "left")
    if data.insiders is not None:
        found = found.join(events.insider_days(data.insiders, sessions), ["ticker", "date"], "left")
    return on_calendar(prices, grid=found)


def research_features(data: Dataset, horizons=labels.HORIZONS, columns: tuple[str, ...] = RANKED, only: Sequence[str] | None = None) -> DataFrame:
    """One row per ticker and session: signals, labels and what was known of filings,
    earnings, insiders, the economy and the news. Tables that are not there leave
    their columns out. All windows by ticker follow one exchange on the ticker.
    `only` names the columns to return, where not all are read."""
    prices = settle(data.prices.dropDuplicates(["ticker", "date"]), "prices")
    df = price_features(_with_events(prices, data))
    stopped = universe.delisting_returns(data.delistings) if data.delistings is not None else None
    df = labels.forward_returns(df, stopped, horizons)
    if data.news is not None:
        df = news.news_windows(df)
    if data.companies is not None:
        own = [c for c in data.companies.columns if c == "ticker" or c not in df.columns]
        df = df.join(data.companies.select(*own).dropDuplicates(["ticker"]), "ticker", "left")
    if data.membership is not None:
        df = universe.flag_members(df, data.membership)
    if data.fundamentals is not None:
        df = events.filed_ratios(df)
    if data.earnings_dates is not None:
        df = events.after_releases(df)
    if data.insiders is not None:
        df = events.insider_windows(df)
    if data.macro is not None:
        df = events.macro(df, data.macro, prices)
    return cross_section(past_warm_up(df), horizons, columns, only)
