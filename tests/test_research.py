"""Assembly, setups side by side, holdout, robustness, evidence, landed files."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

DAYS = [dt.date(2022, 1, 3) + dt.timedelta(i) for i in range(700)]
DAYS = [d for d in DAYS if d.weekday() < 5][:420]


@pytest.fixture(scope="module")
def prices(spark):
    rng = random.Random(4)
    rows = []
    for t in range(12):
        price = 50.0
        for d in DAYS:
            price *= 1 + rng.gauss(0.0003, 0.015)
            rows.append((f"T{t}", d, price, price * 1.01, price * 0.99, rng.randint(100, 900)))
    return spark.createDataFrame(rows, "ticker string, date date, close double, high double, low double, volume long")


@pytest.fixture(scope="module")
def panel(spark, prices):
    from panelweave.functions.shared import settle
    from panelweave.operators.assembly import research_features
    from panelweave.sources.store import Dataset

    companies = spark.createDataFrame([(f"T{t}", f"Company {t}", "AB"[t % 2], None) for t in range(12)], "ticker string, company_name string, sector string, industry string")
    members = spark.createDataFrame([(f"T{t}", None, dt.date(2023, 1, 2) if t == 0 else None) for t in range(11)], "ticker string, start_date date, end_date date")
    stopped = spark.createDataFrame([("T5", DAYS[-40], "bankrupt", -0.3)], "ticker string, last_date date, reason string, delisting_return double")
    cut = prices.filter((F.col("ticker") != "T5") | (F.col("date") <= F.lit(DAYS[-40])))
    return settle(research_features(Dataset(cut, companies=companies, membership=members, delistings=stopped), horizons=(5,)), "panel")


def test_panel_is_past_the_warm_up_and_ranked_among_members(panel):
    row = panel.agg(F.count_if(F.col("volatility_20d").isNull()).alias("unknown"), F.count("*").alias("n"), F.max(F.when(~F.col("in_index"), F.col("momentum_60d_xs_rank"))).alias("outside")).first()
    assert row.unknown == 0 and row.n > 4000 and row.outside is None and "_filled" not in panel.columns
    assert {"return_20d_vs_sector", "target_rank_sector_5d", "return_5d_z", "high_52w_xs_rank"} <= set(panel.columns)
    last = panel.filter("ticker = 'T5'").orderBy(F.desc("date")).first()
    assert last.future_return_5d == pytest.approx(-0.3)


def test_panel_without_other_tables(prices):
    from panelweave.operators.assembly import research_features
    from panelweave.sources.store import Dataset

    df = research_features(Dataset(prices), horizons=(5,))
    assert df.filter("target_beat_median_5d IS NOT NULL").count() > 3000 and "sector" not in df.columns


def test_shrinkage_equals_numpy(spark):
    from panelweave.operators.research import shrinkage

    rng = np.random.default_rng(3)
    days, names = 40, 7
    x = rng.normal(0, 0.02, (days, names)) + rng.normal(0, 0.01, (days, 1))
    x[rng.random((days, names)) < 0.1] = 0.0
    rows = [(f"T{i}", dt.date(2024, 1, 1) + dt.timedelta(t), float(x[t, i])) for t in range(days) for i in range(names) if x[t, i]]
    got = shrinkage(spark.createDataFrame(rows, "ticker string, date date, return_1d double"), 30).first()
    y = x[-30:] - x[-30:].mean(0)
    cov = y.T @ y / 30
    mu, d2 = np.trace(cov) / names, ((cov - np.trace(cov) / names * np.eye(names)) ** 2).sum() / names
    b2 = ((y**2).T @ (y**2) / 30 - cov**2).sum() / names / 30
    assert got.mean_variance == pytest.approx(mu) and got.shrinkage == pytest.approx(min(b2, d2) / d2)


def test_robustness_counts_trials_of_the_same_horizon(spark):
    from panelweave.operators.research import robustness

    rng = np.random.default_rng(1)
    days = [dt.date(2023, 1, 1) + dt.timedelta(7 * i) for i in range(60)]
    r = rng.normal(0.002, 0.01, (60, 3))
    returns = spark.createDataFrame([(d, *map(float, v)) for d, v in zip(days, r)], "date date, long_only double, long_short double, benchmark double")
    trials = [(f"t{k}", d, float(rng.normal(0, 0.01))) for k in range(3) for d in days] + [("other", days[0] + dt.timedelta(3 + i), 0.01 * i) for i in range(60) if i % 7]
    got = {(x.series, x.figure): x.value for x in robustness(returns, spark.createDataFrame(trials, "trial string, date date, r double"), 10, splits=6).collect()}
    assert got["trials", "counted"] == 10 and got["trials", "same_horizon"] == 3 and got["pbo", "strategies"] == 3 and got["pbo", "combinations"] == 20
    assert 0 <= got["long_short", "deflated_sharpe"] <= got["long_short", "probabilistic_sharpe"] <= 1


def test_short_series_have_no_sharpe(spark):
    from panelweave.operators.research import sharpe_per_period

    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0), ("b", 3.0), ("c", 1.0), ("c", 1.0), ("c", 1.0)], "k string, x double")
    assert {r.k: r.s for r in df.groupBy("k").agg(sharpe_per_period("x").alias("s")).collect()} == {"a": None, "b": pytest.approx(2.0), "c": None}


def test_overfitting_takes_the_first_of_equal_bests(spark):
    from panelweave.operators.inference import overfitting_probability

    rng = np.random.default_rng(8)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(i), x, x, 0.5) for i, x in enumerate(rng.normal(0, 1, 32).tolist())]
    got = overfitting_probability(spark.createDataFrame(rows, "date date, a double, b double, c double"), ["a", "b", "c"], 4).first()
    assert got.combinations == 6 and got.pbo == 1.0  # the first of two equal series ranks first of three


def test_experiments_and_holdout(panel, tmp_path, spark):
    from panelweave.operators.labels import Target
    from panelweave.operators.research import evaluate_holdout, experiments
    from panelweave.sources.store import read

    signals = ["return_5d_z", "volatility_20d_z"]
    table, trials = experiments(panel, signals, [Target(5, "market", "rank")], n_splits=2, categorical=())
    row = table.first()
    assert row.model == "ridge" and row.production and row.rebalances > 10 and trials.count() == row.rebalances
    log = str(tmp_path / "log")
    for before in (0, 1):
        got = evaluate_holdout(panel, "ridge", signals, "2023-04-03", log, Target(5, "market", "rank"), n_splits=1, categorical=()).first()
        assert got.previous_evaluations == before and got.holdout_end >= dt.date(2023, 7, 1)
    assert read(spark, log, "json").count() == 2


def test_constructions_side_by_side(panel):
    from panelweave.operators.backtest import Config
    from panelweave.operators.research import construction_table

    predictions = panel.select("date", "ticker", F.col("return_20d_xs_rank").alias("probability"), F.col("tradable_return_5d").alias("tradable_return"))
    got = {r.construction: r for r in construction_table(predictions, Config(), {"plain": {}, "held": {"exit_quantile": 0.5}}).collect()}
    assert got["plain"].production and not got["held"].production and got["held"].long_only_turnover < got["plain"].long_only_turnover


def test_evidence_reads_what_was_saved(spark, tmp_path):
    from panelweave.operators import serving
    from panelweave.sources.store import write

    root = str(tmp_path)
    assert serving.model_evidence(spark, root) == {} and serving.backtest_evidence(spark, root) == {}
    write(spark.createDataFrame([("ridge", 0.02, 7)], "model string, ic_mean double, seconds int"), f"{root}/model_comparison")
    write(spark.createDataFrame([(f"f{i}", float(i)) for i in range(12)], "feature string, importance_mean double"), f"{root}/feature_importance")
    write(spark.createDataFrame([("model_probability", 5), ("return_5d", 5)], "signal string, horizon int"), f"{root}/ic_decay")
    write(spark.createDataFrame([("long_only", 0.1)], "strategy string, cagr double"), f"{root}/backtest_summary")
    write(spark.createDataFrame([(DAYS[0],), (DAYS[5],)], "date date"), f"{root}/backtest_returns")
    got = serving.model_evidence(spark, root)
    assert got["model_comparison"].columns == ["model", "ic_mean"] and got["ic_decay"].count() == 1
    assert [r.feature for r in got["feature_importance"].collect()] == [f"f{i}" for i in range(11, 3, -1)]
    assert serving.backtest_evidence(spark, root)["period"].first().rebalances == 2


def test_landed_files_and_quarters(spark, tmp_path):
    from panelweave.operators import news
    from panelweave.sources import files

    (tmp_path / "AAA.csv").write_text("date,close,volume\n2024-01-02,10,5\n2024-01-03,11,6\n")
    (tmp_path / "info.csv").write_text("symbol,sector\naaa,Energy\n")
    (tmp_path / "news.csv").write_text("ticker,date,title,sentiment\nAAA,2024-01-02 17:00:00,Up,positive\n")
    data, quality = files.landed(spark, [str(tmp_path / "AAA.csv")], str(tmp_path / "info.csv"), str(tmp_path / "news.csv"))
    assert data.prices.count() == 2 and quality.first().with_sector == 1
    row = news.headlines(data.news).first()
    assert (row.title, row.sentiment_score, row.date) == ("Up", 1.0, dt.date(2024, 1, 3))
    series = spark.createDataFrame([("SPY", DAYS[0], 5.0, 4.0), ("SPY", DAYS[1], 6.0, None), ("X", DAYS[0], 1.0, 1.0)], "ticker string, date date, close double, adj_close double")
    assert {r.date: r.close for r in files.benchmark_series(series, "SPY").collect()} == {DAYS[0]: 4.0, DAYS[1]: 6.0}
    q = tmp_path / "2024q1"
    q.mkdir()
    (q / "SUBMISSION.tsv").write_text("ACCESSION_NUMBER\tFILING_DATE\tISSUERCIK\na1\t05-JAN-2024\t7\n")
    (q / "NONDERIV_TRANS.tsv").write_text("ACCESSION_NUMBER\tTRANS_CODE\tTRANS_SHARES\tTRANS_PRICEPERSHARE\na1\tP\t10\t2\na1\tP\t10\t2\n")
    ciks = spark.createDataFrame([(7, "AAA")], "cik long, ticker string")
    trades, failed = files.insider_quarters(spark, {"2024Q1": str(q), "2024Q2": str(tmp_path / "none")}, ciks)
    assert [tuple(r)[0] for r in trades.collect()] == ["AAA"] and len(failed) == 1 and failed[0].startswith("2024Q2")


def test_search_by_runs_of_characters(spark):
    """Against a scan of all names for every part."""
    from panelweave.operators.serving import containing

    rng = random.Random(9)
    names = [(i, "".join(rng.choice("AB C") for _ in range(rng.randint(0, 14))) or None, f"T{i}") for i in range(120)] + [(500, None, None)]
    parts = [("A",), ("AB",), ("ABC",), ("A C", ), ("BBAA",), ("T1",), ("ZZZ",), ("",), ("AB C AB",)]
    got = containing(spark.createDataFrame(names, "k int, name string, t string"), "k", ["name", "t"], spark.createDataFrame(parts, "_q string"))
    expected = {(q, k) for (q,) in parts if q for k, name, t in names if q in (name or "") or q in (t or "")}
    found = [(r._q, r.k) for r in got.collect()]
    assert len(found) == len(expected) and set(found) == expected
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("tile", [3, 256])
def test_covariance_in_tiles_equals_numpy(spark, tile):
    from panelweave.operators.backtest import pair_covariance

    rng = np.random.default_rng(12)
    days, names = 50, 8
    x = rng.normal(0, 0.02, (days, names))
    gap = rng.random((days, names)) < 0.2
    rows = [(f"T{i}", dt.date(2024, 1, 1) + dt.timedelta(t), None if gap[t, i] else float(x[t, i])) for t in range(days) for i in range(names)]
    got = {(r.a, r.b): r.cov for r in pair_covariance(spark.createDataFrame(rows, "ticker string, date date, return_1d double"), 30, tile).collect()}
    y = np.where(gap, 0, x)[-30:]
    cov = np.cov(y.T, bias=True)
    assert len(got) == names * (names + 1) // 2
    for (a, b), c in got.items():
        assert a <= b and c == pytest.approx(cov[int(a[1:]), int(b[1:])], abs=1e-15)
    assert pair_covariance(spark.createDataFrame([], "ticker string, date date, return_1d double")).count() == 0


def test_importance_in_one_plan(spark):
    from panelweave.operators import models

    rng = random.Random(4)
    rows = [(dt.date(2024, 1, 1), f"T{i}", x, rng.gauss(0, 1), 1.0, 0.5 + 0.1 * x + rng.gauss(0, 0.02), "AB"[i % 2]) for i in range(300) for x in [rng.gauss(0, 1)]]
    df = spark.createDataFrame(rows, "date date, ticker string, x double, noise double, same double, target double, sector string")
    jobs = []
    for names in (["x", "noise"], ["x", "noise", "same"]):
        model = models.fit("ridge", df, names, ["sector"], "rank")
        spark.sparkContext.setJobGroup(f"importance-{len(names)}", "importance")
        got = models.importance(model, df, repeats=3).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"importance-{len(names)}")))
        assert [r.feature for r in got][0] == "x" and len(got) == len(names) and got[0].importance_mean > 0.5
        assert all(abs(r.importance_mean) < 0.05 for r in got[1:])
    spark.sparkContext.setJobGroup("", "")
    assert abs(jobs[1] - jobs[0]) <= 2


def test_covariance_in_strips_of_tiles(spark):
    """Tiles lie in a bounded number of strips, so a tile is sent as often however many there are."""
    from panelweave.operators.backtest import pair_covariance

    rng = np.random.default_rng(5)
    days, names = 12, 21
    x = rng.normal(0, 0.02, (days, names))
    rows = [(f"T{i:02}", dt.date(2024, 1, 1) + dt.timedelta(t), float(x[t, i])) for t in range(days) for i in range(names)]
    df = spark.createDataFrame(rows, "ticker string, date date, return_1d double")
    for strips in (1, 3, 32):
        got = pair_covariance(df, 12, 2, strips=strips).collect()
        assert len(got) == len({(r.a, r.b) for r in got}) == names * (names + 1) // 2
        cov = np.cov(x.T, bias=True)
        assert all(r.a <= r.b and r.cov == pytest.approx(cov[int(r.a[1:]), int(r.b[1:])], abs=1e-15) for r in got)


def test_buffered_books_of_many_names(spark, monkeypatch):
    """Held names are looked up in a set, and a row of the fold takes a bounded number of names."""
    from panelweave.operators import backtest as bt

    rng = random.Random(9)
    rows = []
    for period in range(7):
        order = rng.sample(range(40), 40)
        rows += [(0, 1, period, name, place + 1, 8, 16) for place, name in enumerate(order)]
    ranked = spark.createDataFrame(rows, "run int, side int, period int, ticker long, _rank int, _k int, _exit int")
    held, expected = [], set()
    for period in range(7):
        names = [r[3] for r in rows if r[2] == period]
        stay = [n for n in names[:16] if n in held][:8]
        held = stay + [n for n in names if n not in stay][: 8 - len(stay)]
        expected |= {(period, n) for n in held}
    monkeypatch.setattr(bt, "MOST_NAMES", 60)
    folded = []
    monkeypatch.setattr(bt, "settle", lambda df, label, real=bt.settle: folded.append(label) or real(df, label))
    found = bt.buffered(ranked, ["run", "side"])
    assert {(r.period, r.ticker) for r in found.collect()} == expected
    assert folded.count("held-names") == 4  # two periods of 24 names at a time
