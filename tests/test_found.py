"""Cases that a review found: each failed before its change."""

import datetime as dt

from pyspark.sql import functions as F


def test_neutral_weights_keep_the_sign_of_0_as_their_sql_does(spark, monkeypatch):
    duckdb = __import__("pytest").importorskip("duckdb")
    from panelweave.plans import backtest_queries as plans
    from panelweave.plans.registry import ORACLE_SQL

    rows = [(dt.date(2024, 1, 5), t, p, 0.0, b, v) for t, (p, b, v) in enumerate([(0.1, 1.0, 0.2), (0.3, 2.0, 0.2), (0.5, 0.0, 0.2), (0.7, 2.0, 0.2), (0.9, 1.0, 0.2 * (1 + 3e-7))])]
    schema = "date date, ticker long, probability double, tradable_return double, beta_252 double, volatility_20d double"
    monkeypatch.setattr(plans, "predictions", lambda *_: spark.createDataFrame(rows, schema))
    got = {r.ticker: repr(r.w) for r in plans.b21_neutral_weights(spark, "").collect()}
    values = ", ".join(f"(DATE '{d}', {t}, {p!r}::DOUBLE, {r!r}::DOUBLE, {b!r}::DOUBLE, {v!r}::DOUBLE)" for d, t, p, r, b, v in rows)
    sql = f"WITH predictions(date, ticker, probability, tradable_return, beta_252, volatility_20d) AS (VALUES {values})" + ORACLE_SQL["b21_neutral_weights"].removeprefix(plans.PREDICTIONS)
    want = {t: repr(w) for _, t, w in duckdb.sql(sql).fetchall()}
    assert got == want and want[2] == "-0.0"


def test_importance_reads_every_row(spark):
    from types import SimpleNamespace

    from panelweave.operators import models

    n, seen = 24_000, []

    def score(df):
        seen.append(df.count())
        return df.withColumn("probability", F.col("x"))

    df = spark.range(n).select(F.lit(dt.date(2024, 1, 5)).alias("date"), F.col("id").alias("ticker"), (F.col("id") % 7919).cast("double").alias("x"), F.rand(3).alias("noise"), (F.col("id") % 7919).cast("double").alias("target"))
    model = SimpleNamespace(numeric=["x", "noise"], categorical=[], score=score)
    models.importance(model, df, repeats=2).collect()
    assert max(seen) >= n * (1 + 2 * 2)
    got = {r.feature: r for r in models.importance(model, df, repeats=2, block=5_000).collect()}
    assert abs(got["x"].importance_mean - 1) < 0.03 and abs(got["noise"].importance_mean) < 1e-12


def test_rank_correlation_of_buckets_is_that_of_all_rows(spark):
    import numpy as np

    from panelweave.functions.ordered import mean_places
    from panelweave.operators.stats import information_coefficients, rank_correlations

    rng = np.random.default_rng(3)
    y = rng.integers(0, 40, 900).astype(float)
    rows = [(k, float(s), float(t)) for k in (0, 1, 2) for s, t in zip(np.round(y / 9 + rng.normal(0, 2, 900), 1) if k < 2 else np.ones(900), y, strict=True)]
    df = spark.createDataFrame(rows, "key int, s double, y double")
    want = {r.key: r.ic for r in information_coefficients(df, "s", "y", ["key"]).collect()}
    placed = mean_places(df.filter("key = 0"), "y").select("y", "_place").distinct()
    for cuts in ([], [1.0], [-1.0, 0.5, 0.5, 2.0, 3.3]):
        got = {r.key: r.ic for r in rank_correlations(df.join(placed, "y"), "s", "_place", "key", cuts).collect()}
        assert set(got) == set(want) == {0, 1} and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_events_go_to_tickers_and_dates_before_the_features(spark):
    """The panel has one exchange by ticker and one by date after its prices are settled;
    `only` gives the same columns as the whole panel."""
    import random

    from panelweave.operators.assembly import research_features
    from panelweave.sources.store import Dataset

    rng, days = random.Random(8), [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(90)]
    prices = spark.createDataFrame([(t, d, 50 + rng.random(), 51 + rng.random(), 49 + rng.random(), 100.0) for t in range(8) for d in days if rng.random() < 0.97], "ticker long, date date, close double, high double, low double, volume double")
    news = spark.createDataFrame([(t, d, "x", rng.choice(["positive", "negative"])) for t in range(8) for d in days[::7]], "ticker long, date date, title string, sentiment string")
    pit = spark.createDataFrame([(t, days[k], days[k - 5], *[rng.random() + 1 for _ in range(6)]) for t in range(8) for k in (10, 50)], "ticker long, available_date date, period_end date, revenue_ttm double, net_income_ttm double, equity double, liabilities double, shares_outstanding double, revenue_growth_yoy double")
    eps = spark.createDataFrame([(t, days[0] - dt.timedelta(91 * k - 60), rng.random(), days[0] - dt.timedelta(91 * k - 70)) for t in range(8) for k in range(16)], "ticker long, period_end date, eps double, filed date")
    releases = spark.createDataFrame([(t, days[k]) for t in range(8) for k in (31, 62)], "ticker long, date date")
    insiders = spark.createDataFrame([(t, days[k], k, rng.choice("PS"), 5.0) for t in range(8) for k in (20, 21, 40)], "ticker long, filed date, accession long, code string, value double")
    panel = research_features(Dataset(prices, news=news, fundamentals=pit, eps=eps, earnings_dates=releases, insiders=insiders), horizons=(5,))
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
    some = ["ticker", "date", "sue", "ear", "news_count_20d", "insider_purchases_90d", "book_to_market", "sue_xs_rank", "return_5d_z", "target_rank_market_5d"]
    found = research_features(Dataset(prices, news=news, fundamentals=pit, eps=eps, earnings_dates=releases, insiders=insiders), horizons=(5,), only=some)
    want = {(r.ticker, r.date): r for r in panel.select(some).collect()}
    got = {(r.ticker, r.date): r for r in found.collect()}
    assert found.columns == some and len(got) > 400 and set(got) == set(want)
    assert all(got[k][c] == want[k][c] or abs(got[k][c] - want[k][c]) < 1e-12 for k in got for c in some[2:])
    assert sum(r.sue is not None for r in got.values()) > 50 and sum(r.ear is not None for r in got.values()) > 50


def test_the_index_of_runs_is_not_broadcast(spark):
    from panelweave.operators.serving import containing

    texts = spark.range(300).select("id", F.col("id").cast("string").alias("u"), F.format_string("NAME%05d", "id").alias("n"))
    asked = spark.createDataFrame([("E0001",), ("299",), ("nothing",)], "_q string")
    found = containing(texts, "id", ["u", "n"], asked)
    assert sorted((r._q, r.id) for r in found.collect()) == sorted([("E0001", i) for i in range(10, 20)] + [("299", 299)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_gram" in plan


def test_tables_on_the_way_are_deleted(spark):
    import glob
    import random

    from panelweave.functions import shared
    from panelweave.operators import models
    from panelweave.operators.labels import Target

    there = lambda label: glob.glob(f"{shared.shared_dir(spark).removeprefix('file:')}/{label}-*/")
    shared.drop_settled(spark)
    table = shared.settle_once(spark, lambda: shared.settle(spark.range(5), "on-the-way").withColumn("x", F.lit(1)), "kept", "k")
    assert table.count() == 5 and there("kept") and not there("on-the-way")
    rng, days = random.Random(6), [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(60)]
    rows = [(d, f"T{t}", x, 1.0, rng.random(), float(x > 0), x * 0.01, x * 0.01) for d in days for t in range(12) for x in [rng.gauss(0, 1)]]
    df = spark.createDataFrame(rows, "date date, ticker string, x double, unread double, target_rank_market_5d double, target_beat_median_5d double, future_return_5d double, tradable_return_5d double")
    found = models.walk_forward(df, "ridge", ["x"], Target(5, "market", "rank"), n_splits=2)
    other = models.walk_forward(df, "logistic_regression", ["x"], Target(5, "market", "binary"), n_splits=2, categorical=())
    assert not there("labelled") and len(there("predictions")) == 2
    assert found.predictions.count() == other.predictions.count() > 300 and found.metrics.count() == 2 and other.metrics.count() == 2
    shared.drop_settled(spark)
