"""Hand-computed cases of the research operators."""

import datetime as dt
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

D = dt.date


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def weekdays(n, start=D(2024, 1, 2)):
    out, day = [], start
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(1)
    return out


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(3)
    rows = []
    for t in range(8):
        price = 100.0
        for day in weekdays(300):
            price *= 1 + rng.gauss(0, 0.02)
            rows.append((f"T{t}", day, price, price * 1.01, price * 0.99, rng.randint(100, 900)))
    return frame(spark, rows, "ticker string, date date, close double, high double, low double, volume long")


class TestCalendar:
    def test_returns_follow_sessions_not_rows(self, spark):
        from panelweave.operators.calendar import on_calendar
        from panelweave.operators.prices import price_features

        days = weekdays(30)
        rows = [("A", d, 100 * 1.01**i) for i, d in enumerate(days) if i not in (22, 23)] + [("B", d, 50.0) for d in days]
        df = price_features(on_calendar(frame(spark, rows, "ticker string, date date, close double")))
        got = {(r.ticker, r.date): r for r in df.collect()}
        assert got["A", days[25]].return_5d == pytest.approx(1.01**5 - 1) and got["A", days[22]]._filled and got["A", days[23]].close == pytest.approx(100 * 1.01**21)

    def test_thin_days_are_no_sessions(self, spark):
        from panelweave.operators.calendar import session_calendar

        days = weekdays(3)
        rows = [(f"T{i}", d) for i in range(10) for d in (days[0], days[2])] + [("T1", days[1])]
        assert [r.date for r in session_calendar(frame(spark, rows, "ticker string, date date")).orderBy("date").collect()] == [days[0], days[2]]

    def test_features_do_not_see_the_future(self, panel):
        from panelweave.operators.calendar import on_calendar
        from panelweave.operators.prices import price_features

        cut = weekdays(300)[279]
        whole = price_features(on_calendar(panel)).filter(F.col("date") <= cut).orderBy("ticker", "date").toPandas()
        early = price_features(on_calendar(panel.filter(F.col("date") <= cut))).orderBy("ticker", "date").toPandas()
        pd.testing.assert_frame_equal(whole, early)


class TestLabels:
    def test_stopped_tickers_keep_their_return(self, spark):
        from panelweave.operators.labels import forward_returns

        days = weekdays(40)
        rows = [("LIVE", d, 100.0) for d in days] + [("STALE", d, 100.0) for d in days[:38]] + [("GONE", d, 50.0 + 10 * (i == 19)) for i, d in enumerate(days[:20])] + [("BUST", d, 100.0) for d in days[:20]]
        lost = frame(spark, [("BUST", -0.3)], "ticker string, delisting_return double")
        got = {(r.ticker, r.date): r for r in forward_returns(frame(spark, rows, "ticker string, date date, close double"), lost).collect()}
        assert got["GONE", days[17]].future_return_5d == pytest.approx(0.2) and got["BUST", days[17]].future_return_5d == pytest.approx(-0.3)
        assert got["STALE", days[36]].future_return_5d is None and got["LIVE", days[38]].future_return_5d is None
        assert got["GONE", days[19]].tradable_return_5d is None

    def test_targets(self):
        from panelweave.operators.labels import Target

        assert Target(21, "sector", "rank").column == "target_rank_sector_21d" and Target(5, "market", "binary").column == "target_beat_median_5d"
        with pytest.raises(ValueError):
            Target(7)

    def test_labels_stop_before_the_holdout(self, panel):
        from panelweave.operators.labels import forward_returns, research_window

        days = weekdays(300)
        rows = research_window(forward_returns(panel), str(days[200]))
        last = rows.filter("future_return_5d IS NOT NULL").agg(F.max("date")).first()[0]
        assert last == days[193] and rows.agg(F.max("date")).first()[0] == days[199]


class TestAsof:
    @pytest.mark.parametrize("direction", ["backward", "forward"])
    @pytest.mark.parametrize("strict", [False, True])
    def test_equals_pandas(self, spark, direction, strict):
        from panelweave.operators.asof import asof

        rng = np.random.default_rng(1)
        left = pd.DataFrame({"k": rng.integers(0, 4, 200), "t": rng.integers(0, 60, 200), "id": range(200)}).sort_values("t")
        right = pd.DataFrame({"k": rng.integers(0, 4, 80), "u": rng.integers(0, 60, 80), "v": range(80)}).sort_values(["u", "v"])
        exp = pd.merge_asof(left, right, left_on="t", right_on="u", by="k", direction=direction, allow_exact_matches=not strict).sort_values("id")
        got = asof(spark.createDataFrame(left), spark.createDataFrame(right), "t", "u", ["v"], ["k"], direction, strict, ["v"]).orderBy("id").toPandas()
        assert [None if pd.isna(x) else int(x) for x in got.v] == [None if pd.isna(x) else int(x) for x in exp.v]

    def test_nearest_goes_back_on_ties(self, spark):
        from panelweave.operators.asof import asof_nearest

        left = frame(spark, [(1, D(2024, 1, 10)), (2, D(2024, 3, 1))], "k int, t date")
        right = frame(spark, [(1, D(2024, 1, 8), "a"), (1, D(2024, 1, 12), "b"), (2, D(2024, 1, 1), "c")], "k int, u date, v string")
        assert {r.k: r.v for r in asof_nearest(left, right, "t", "u", ["v"], ["k"], 20).collect()} == {1: "a", 2: None}


class TestUniverse:
    def test_membership_walk(self, spark):
        from panelweave.operators.universe import membership, unresolved

        rng = random.Random(4)
        for _ in range(4):
            now = {t for t in "ABCDEF" if rng.random() < 0.5}
            days = [D(2020, 1, 1) + dt.timedelta(30 * i) for i in range(12)]
            changes = [(d, rng.choice("ABCDEF"), rng.choice(["added", "removed"])) for d in days]
            state, spans, odd = {t: None for t in now}, [], 0
            for d, t, kind in reversed(changes):
                if kind == "added":
                    if t in state:
                        spans.append((t, d, state.pop(t)))
                    else:
                        odd += 1
                elif t in state:
                    odd += 1
                else:
                    state[t] = d
            spans += [(t, None, e) for t, e in state.items()]
            current = frame(spark, [(t,) for t in now], "ticker string")
            table = frame(spark, changes, "date date, ticker string, kind string")
            got = [tuple(r) for r in membership(current, table, "2000-01-01").collect()]
            assert sorted(got, key=str) == sorted(spans, key=str) and unresolved(current, table, "2000-01-01").count() == odd

    def test_delistings(self, spark):
        from panelweave.operators.universe import delistings

        days = weekdays(300)
        rows = [("LIVE", d, 10.0) for d in days] + [("MERGED", d, 10.0) for d in days[:200]] + [("DROPPED", d, 10.0) for d in days[:200]]
        rows += [("CRASH", d, 10.0 if i < 190 else 2.0) for i, d in enumerate(days[:200])]
        spans = frame(spark, [("DROPPED", None, days[200] - dt.timedelta(50))], "ticker string, start_date date, end_date date")
        got = {r.ticker: r.delisting_return for r in delistings(frame(spark, rows, "ticker string, date date, close double"), None, spans).collect()}
        assert got == {"MERGED": 0.0, "CRASH": -0.3}

    def test_reused_symbols_and_late_rows_go(self, spark):
        from panelweave.operators.universe import clean_former

        days = weekdays(260, D(2020, 1, 1))
        rows = [(t, d, 1.0) for t in ("IN", "OUT") for d in days] + [("REUSED", d, 1.0) for d in days[200:]]
        spans = frame(spark, [("OUT", None, days[100]), ("REUSED", None, days[150])], "ticker string, start_date date, end_date date")
        got = clean_former(frame(spark, rows, "ticker string, date date, close double"), spans, frame(spark, [("IN",)], "ticker string"), str(days[0]))
        last = {r.ticker: r.d for r in got.groupBy("ticker").agg(F.max("date").alias("d")).collect()}
        assert set(last) == {"IN", "OUT"} and last["IN"] == days[-1] and last["OUT"] <= days[100] + dt.timedelta(45)

    def test_sectors(self, spark):
        from panelweave.operators.universe import sic_industry, sic_sector

        df = frame(spark, [(2834,), (3571,), (6798,), (6021,), (3612,), (9999,), (None,)], "sic int")
        got = [tuple(r) for r in df.select(sic_sector(F.col("sic")), sic_industry(F.col("sic"))).collect()]
        assert got == [("Health Care", "SIC 28"), ("Information Technology", "SIC 35"), ("Real Estate", "SIC 67"), ("Financials", "SIC 60"), ("Industrials", "SIC 36"), (None, "SIC 99"), (None, None)]

    def test_unsplit(self, spark):
        from panelweave.sources.files import unsplit

        days = weekdays(4)
        df = frame(spark, [("A", d, p, s) for d, p, s in zip(days, (10.0, 10.0, 5.0, 5.0), (0.0, 0.0, 2.0, 3.0))], "ticker string, date date, close double, split_ratio double")
        assert [r.raw_close for r in unsplit(df).orderBy("date").collect()] == [60.0, 60.0, 15.0, 5.0]


def fact(start, end, val, filed, form="10-Q", accn="a", unit="USD"):
    return {"start": start, "end": end, "val": val, "filed": filed, "form": form, "accn": accn}


class TestFilings:
    def facts(self, spark):
        quarters = [("2022-01-01", "2022-03-31", 10, "2022-05-01"), ("2022-04-01", "2022-06-30", 11, "2022-08-01"), ("2022-07-01", "2022-09-30", 12, "2022-11-01")]
        revenue = [fact(*q) for q in quarters] + [fact("2022-01-01", "2022-12-31", 50, "2023-02-15", "10-K"), fact("2023-01-01", "2023-03-31", 14, "2023-05-01"), fact("2022-01-01", "2022-03-31", 99, "2023-05-01")]
        shares = [{"end": "2022-12-31", "val": v, "filed": "2023-02-15", "form": "10-K", "accn": "x"} for v in (6, 4)]
        instant = lambda v: {"units": {"USD": [{"end": "2022-12-31", "val": v, "filed": "2023-02-15", "form": "10-K", "accn": "x"}]}}
        body = {"cik": 7, "facts": {"us-gaap": {"Revenues": {"units": {"USD": revenue}}, "Assets": instant(500), "StockholdersEquity": instant(300)}, "dei": {"EntityCommonStockSharesOutstanding": {"units": {"shares": shares}}}}}
        return frame(spark, [(json.dumps(body),)], "value string")

    def test_timeline(self, spark):
        from panelweave.operators.filings import timeline
        from panelweave.sources.documents import company_facts

        got = {str(r.available_date): r for r in timeline(company_facts(self.facts(spark))).collect()}
        year, next_quarter = got["2023-02-15"], got["2023-05-01"]
        assert (year.revenue_ttm, year.shares_outstanding, year.liabilities, str(year.period_end)) == (50, 10, 200, "2022-12-31")
        assert next_quarter.revenue_ttm == 54 and str(next_quarter.period_end) == "2023-03-31"

    def test_year_to_date_values(self, spark):
        from panelweave.operators.filings import quarters

        rows = [("2022-01-01", "2022-03-31", 10.0, "2022-05-01"), ("2022-01-01", "2022-06-30", 30.0, "2022-08-01"), ("2022-01-01", "2022-09-30", 60.0, "2022-11-01"), ("2022-01-01", "2022-12-31", 100.0, "2023-02-01")]
        df = frame(spark, [(1, "m", 0, *map(D.fromisoformat, r[:2]), r[2], D.fromisoformat(r[3])) for r in rows], "cik int, metric string, priority int, start date, end date, val double, filed date")
        got = {str(r.end): (str(r.start), r.val) for r in quarters(df).collect()}
        assert got == {"2022-03-31": ("2022-01-01", 10.0), "2022-06-30": ("2022-04-01", 20.0), "2022-09-30": ("2022-07-01", 30.0), "2022-12-31": ("2022-10-01", 40.0)}

    def test_releases(self, spark):
        from panelweave.sources.documents import recent_filings, release_dates, submissions

        recent = {"form": ["8-K", "8-K", "10-Q", "8-K"], "filingDate": ["2024-05-02", "2024-05-03", "2024-05-04", "2024-06-01"], "acceptanceDateTime": ["2024-05-02T16:05:00.000Z", "2024-05-03T08:00:00.000Z", "", ""], "items": ["2.02,9.01", "2.02", "", "2.02"], "accessionNumber": ["0-1-2", "0-1-3", "0-1-4", "0-1-5"], "primaryDocument": list("abcd"), "reportDate": ["", "", "2024-03-31", ""]}
        df = submissions(frame(spark, [(json.dumps({"cik": "5", "sic": "2834", "sicDescription": "x", "filings": {"recent": recent}}),)], "value string"))
        assert sorted(str(r.date) for r in release_dates(df).collect()) == ["2024-05-03", "2024-06-01"]
        assert recent_filings(df, "http://x/", ("10-Q",)).first().url == "http://x/5/014/c"


class TestEvents:
    def test_strict_and_aged_fundamentals(self, spark):
        from panelweave.operators.events import FLOWS, fundamentals

        pit = frame(spark, [("A", D(2024, 1, 10), 100.0, 10.0, None, -5.0, 40.0, 2.0)], "ticker string, available_date date, " + ", ".join(f"{c} double" for c in FLOWS))
        df = frame(spark, [("A", d, 50.0) for d in (D(2024, 1, 10), D(2024, 1, 11), D(2025, 12, 1))], "ticker string, date date, close double")
        got = {r.date: r for r in fundamentals(df, pit).collect()}
        assert got[D(2024, 1, 10)].market_cap is None and got[D(2024, 1, 11)].market_cap == 100.0 and got[D(2024, 1, 11)].book_to_market is None
        assert got[D(2024, 1, 11)].pe_ratio == 10.0 and got[D(2025, 12, 1)].fundamentals_as_of is None

    def test_market_time(self, spark):
        from panelweave.operators.news import market_date, market_time

        df = frame(spark, [("2024-03-01T21:30:00Z",), ("2024-03-01 09:30:00",), ("2024-03-01T16:00:00-05:00",)], "t string")
        got = [str(r[0]) for r in df.select(market_date(market_time(F.col("t")))).collect()]
        assert got == ["2024-03-02", "2024-03-01", "2024-03-02"]

    def test_lexicon(self, spark):
        from panelweave.operators.news import lexicon_score

        df = frame(spark, [("Profits beat, growth strong",), ("did not miss and no loss",), ("misses badly; not a word more until gains",), ("nothing here",), (None,)], "t string")
        assert [r[0] for r in df.select(lexicon_score(F.col("t"))).collect()] == [1.0, 1.0, 0.0, 0.0, 0.0]


class TestBacktest:
    @pytest.fixture(scope="class")
    def predictions(self, spark):
        rng = random.Random(7)
        rows = [(d, f"T{i:02}", rng.random(), rng.gauss(0, 0.03), "AB"[i % 2]) for d in weekdays(60) for i in range(20)]
        return frame(spark, rows, "date date, ticker string, probability double, tradable_return double, sector string")

    def loop(self, rows, config):
        """The same strategies, period by period."""
        out, prev = {}, {}
        days = sorted({r.date for r in rows})[:: config.holding_days]
        for p, day in enumerate(days):
            cs = sorted((r for r in rows if r.date == day), key=lambda r: (-r.probability, r.ticker))
            k = max(1, round(len(cs) * config.quantile))
            leave = max(k, round(len(cs) * (config.exit_quantile or config.quantile)))

            def pick(order, held):
                stay = [t for t in order[:leave] if t in held][:k] if leave > k else []
                return stay + [t for t in order if t not in stay][: k - len(stay)]

            order = [r.ticker for r in cs]
            tops = pick(order, set(prev.get("tops", ())))
            lows = pick(order[::-1], set(prev.get("lows", ())))
            books = {"long_only": {t: 1 / k for t in tops}, "benchmark": {t: 1 / len(cs) for t in order}}
            books["long_short"] = {t: books["long_only"].get(t, 0) for t in tops} | {t: -1 / k for t in lows}
            r = {x.ticker: x.tradable_return for x in cs}
            for name, w in books.items():
                old = prev.get(name, {})
                traded = sum(abs(w.get(t, 0) - old.get(t, 0)) for t in set(w) | set(old))
                out[p, name] = (sum(v * r[t] for t, v in w.items()), traded, traded * config.cost_bps / 1e4)
                moved = {t: v * (1 + r[t]) for t, v in w.items()}
                scale = sum(map(abs, w.values())) / sum(map(abs, moved.values()))
                prev[name] = {t: v * scale for t, v in moved.items()}
            prev |= {"tops": tops, "lows": lows}
        return out

    @pytest.mark.parametrize("exit_quantile", [None, 0.5])
    def test_equals_a_loop(self, predictions, exit_quantile):
        from panelweave.operators.backtest import Config, backtest

        config = Config(exit_quantile=exit_quantile)
        exp = self.loop(predictions.collect(), config)
        got = {(r.period, r.strategy): (r.gross, r.turnover, r.cost) for r in backtest(predictions, config).collect()}
        assert set(got) == set(exp) and all(got[k] == pytest.approx(exp[k]) for k in exp)

    def test_offsets_are_one_job(self, predictions):
        from panelweave.operators.backtest import Config, backtest, staggered, summary

        config = Config(offsets=(0, 1, 2))
        found = backtest(predictions, config)
        alone = backtest(predictions, Config(offsets=(2,)))
        pick = lambda df: sorted((r.date, r.strategy, round(r.net, 12)) for r in df.filter("run = 2").collect())
        assert pick(found) == pick(alone)
        assert {r.offsets for r in staggered(summary(found, config)).collect()} == {3}

    def test_neutral_weights(self, spark):
        from panelweave.operators.backtest import neutral_weights

        rng = random.Random(1)
        df = frame(spark, [(D(2024, 1, 2), f"T{i}", rng.random(), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(40)], "date date, ticker string, probability double, beta double, size double")
        rows = neutral_weights(df, ["beta", "size"]).collect()
        assert abs(sum(r.w for r in rows)) < 1e-9 and abs(sum(r.w * r.beta for r in rows)) < 1e-9 and abs(sum(r.w * r["size"] for r in rows)) < 1e-9
        assert sum(abs(r.w) for r in rows) == pytest.approx(2.0)


class TestInference:
    def test_hac_equals_numpy(self, spark):
        from panelweave.operators.inference import hac_regression

        rng = np.random.default_rng(5)
        n = 80
        x = rng.normal(size=(n, 2))
        y = 0.3 + x @ [1.0, -0.5] + rng.normal(size=n)
        df = frame(spark, [(D(2024, 1, 1) + dt.timedelta(i), float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)], "date date, y double, a double, b double")
        got = hac_regression(df, "y", ["a", "b"], lags=3)
        X = np.column_stack([np.ones(n), x])
        inv = np.linalg.inv(X.T @ X)
        coef = inv @ X.T @ y
        s = X * (y - X @ coef)[:, None]
        meat = s.T @ s + sum((1 - k / 4) * (s[k:].T @ s[:-k] + (s[k:].T @ s[:-k]).T) for k in (1, 2, 3))
        assert got["coef"] == pytest.approx(coef) and got["se_hac"] == pytest.approx(np.sqrt(np.diag(inv @ meat @ inv) * n / (n - 3)))

    def test_newey_west(self, spark):
        from panelweave.operators.stats import newey_west

        x = np.random.default_rng(2).normal(0.2, 1, 50)
        df = frame(spark, [(D(2024, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(x)], "date date, v double")
        d = x - x.mean()
        var = d @ d / 50 + sum(2 * (1 - k / 5) * (d[k:] @ d[:-k]) / 50 for k in range(1, 5))
        assert newey_west(df, "v", lags=4).first().t == pytest.approx(x.mean() / math.sqrt(var / 50))

    def test_bootstrap_blocks(self, spark):
        from panelweave.operators.inference import bootstrap_indices

        rows = bootstrap_indices(spark, 50, 40, 5.0).orderBy("rep", "t").collect()
        steps = [(b.idx - a.idx) % 50 == 1 for a, b in zip(rows, rows[1:]) if a.rep == b.rep]
        assert len(rows) == 2000 and 0.74 < np.mean(steps) < 0.88 and {r.idx for r in rows} == set(range(50))

    def test_overfitting(self, spark):
        from panelweave.operators.inference import overfitting_probability

        rng = np.random.default_rng(3)
        rows = [(D(2020, 1, 1) + dt.timedelta(i), *map(float, rng.normal(0, 1, 3)), float(rng.normal(0.8, 1))) for i in range(120)]
        df = frame(spark, rows, "date date, a double, b double, c double, skilled double")
        good = overfitting_probability(df, ["a", "b", "c", "skilled"], 8).first()
        assert good.combinations == 70 and good.pbo < 0.1

    def test_sharpes(self, spark):
        """Against the closed forms, with the standard library's normal distribution."""
        from statistics import NormalDist

        from panelweave.operators.inference import best_by_luck, sharpe_tests

        rng, normal = np.random.default_rng(6), NormalDist()
        trials = [0.1, -0.1, 0.05, 0.0]
        luck = best_by_luck(frame(spark, [(x,) for x in (*trials, None, float("nan"))], "sharpe double"), 100)
        spread = np.std(trials, ddof=1)
        bar = spread * ((1 - 0.5772156649015329) * normal.inv_cdf(1 - 1 / 100) + 0.5772156649015329 * normal.inv_cdf(1 - 1 / (100 * math.e)))
        assert tuple(luck.first()) == (100, pytest.approx(bar, rel=1e-7))
        assert tuple(best_by_luck(frame(spark, [(0.1,)], "sharpe double")).first()) == (1, 0.0)
        assert tuple(best_by_luck(frame(spark, [], "sharpe double")).first()) == (0, 0.0)
        x = {"a": rng.gamma(2, 1, 40) - 1.7, "flat": np.ones(40), "short": rng.normal(0, 1, 9)}
        got = sharpe_tests(frame(spark, [(k, float(v)) for k, r in x.items() for v in r] + [("a", None)], "series string, r double"), luck).collect()
        assert [r.series for r in got] == ["a"]
        r = x["a"]
        n, d, s = len(r), r - r.mean(), r.std(ddof=1)
        g = (d**3).mean() / (d**2).mean() ** 1.5 * math.sqrt(n * (n - 1)) / (n - 2)
        k = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ((d**4).mean() / (d**2).mean() ** 2 - 3) + 6) + 3
        sr = r.mean() / s
        wide = math.sqrt(1 - g * sr + (k - 1) / 4 * sr * sr)
        assert got[0].sharpe_per_period == pytest.approx(sr) and got[0].trials == 100
        assert got[0].probabilistic_sharpe == pytest.approx(normal.cdf(sr * math.sqrt(n - 1) / wide), abs=1e-7)
        assert got[0].deflated_sharpe == pytest.approx(normal.cdf((sr - bar) * math.sqrt(n - 1) / wide), abs=1e-7)

    @pytest.mark.parametrize("mean_block", [1.0, 3.7, 500.0])
    def test_resampled_sums_equal_the_places_one_by_one(self, spark, mean_block):
        from panelweave.operators.inference import block_draws, block_sums, bootstrap_indices, numbered

        rng = np.random.default_rng(5)
        values = rng.normal(0, 1, 37).tolist()
        series = numbered(frame(spark, [(D(2024, 1, 1) + dt.timedelta(i), v) for i, v in enumerate(values)], "date date, r double"))
        got = {r.rep: r for r in block_sums(series, block_draws(spark, 37, 60, mean_block, 3), 37, {"s": F.col("r"), "q": F.col("r") * F.col("r"), "n": F.lit(1.0)}).collect()}
        places = {}
        for r in bootstrap_indices(spark, 37, 60, mean_block, 3).collect():
            places.setdefault(r.rep, {})[r.t] = r.idx
        assert len(got) == len(places) == 60
        for rep, own in places.items():
            assert sorted(own) == list(range(37))
            assert got[rep].n == pytest.approx(37) and got[rep].s == pytest.approx(sum(values[i] for i in own.values())) and got[rep].q == pytest.approx(sum(values[i] ** 2 for i in own.values()))

    def test_bootstrap_of_lost_books(self, spark):
        """A period that loses all or more leaves no growth."""
        from panelweave.operators.inference import bootstrap_performance

        rows = [(D(2024, 1, 1) + dt.timedelta(i), -1.0 if i % 4 == 0 else 0.1, 0.01) for i in range(40)]
        got = {r.strategy: r for r in bootstrap_performance(frame(spark, rows, "date date, lost double, flat double"), ["lost", "flat"], 52.0, reps=50).collect()}
        assert got["lost"].cagr_low == -1.0 and got["flat"].cagr_low == pytest.approx(1.01**52 - 1) and got["flat"].sharpe_low is None

    def test_normals(self, spark):
        from statistics import NormalDist

        from panelweave.functions.frames import cdf, ppf

        df = frame(spark, [(0.001,), (0.02,), (0.3,), (0.5,), (0.9,), (0.999,)], "p double")
        for r in cdf(ppf(df, "p", "x"), "x", "q").collect():
            assert r.x == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-7, abs=1e-8) and r.q == pytest.approx(r.p, rel=1e-7)


class TestModels:
    def test_walk_forward_finds_a_signal(self, spark):
        from panelweave.operators import models
        from panelweave.operators.labels import Target

        rng = random.Random(2)
        rows = []
        for d in weekdays(60):
            for i in range(20):
                x = rng.gauss(0, 1)
                f = 0.01 * x + rng.gauss(0, 0.01)
                rows.append((d, f"T{i}", x, rng.gauss(0, 1), "AB"[i % 2], f, f, min(1.0, max(0.0, 0.5 + 10 * f)), float(f > 0)))
        df = frame(spark, rows, "date date, ticker string, x double, noise double, sector string, future_return_5d double, tradable_return_5d double, target_rank_market_5d double, target_beat_median_5d double")
        found = models.walk_forward(df, "ridge", ["x", "noise", "absent"], Target(5, "market", "rank"), n_splits=2)
        assert found.model.numeric == ["x", "noise"] and all(r.ic_mean > 0.4 and r.auc > 0.7 for r in found.metrics.collect())
        assert models.summarise("ridge", found, Target()).first().ic_mean > 0.4
        best = models.importance(found.model, found.predictions.select("date", "ticker", "target").join(df, ["date", "ticker"]), repeats=1).first()
        assert best.feature == "x"

    def test_binary_and_saved(self, spark, tmp_path):
        from panelweave.operators import models

        rng = random.Random(3)
        rows = [(D(2024, 1, 1), f"T{i}", x, float(x + rng.gauss(0, 0.3) > 0)) for i in range(200) for x in [rng.gauss(0, 1)]]
        df = frame(spark, rows, "date date, ticker string, x double, target double")
        model = models.fit("logistic_regression", df, ["x"], [], "binary", params={"C": 1.0})
        model.save(str(tmp_path / "m"))
        again = models.Model.load(str(tmp_path / "m")).score(df).orderBy("ticker").collect()
        assert [r.probability for r in again] == pytest.approx([r.probability for r in model.score(df).orderBy("ticker").collect()])
        assert np.corrcoef([r.x for r in again], [r.probability for r in again])[0, 1] > 0.8
        with pytest.raises(ValueError):
            models.fit("ridge", df, ["x"], [], "binary")


class TestSources:
    def test_price_folder(self, spark, tmp_path):
        from panelweave.sources.files import price_folder

        (tmp_path / "aaa.csv").write_text("Date,Adj Close,Volume\n2024-01-02,10.5,100\n2024-01-03,oops,5\n")
        (tmp_path / "b.csv").write_text("Symbol,Date,Close\nbbb,2024-01-02,7\n,2024-01-02,7\n")
        got = price_folder(spark, [str(tmp_path / "aaa.csv"), str(tmp_path / "b.csv")]).orderBy("ticker").collect()
        assert [(r.ticker, r.close, r.volume) for r in got] == [("AAA", 10.5, 100.0), ("BBB", 7.0, None)]

    def test_factors_and_macro(self, spark):
        from panelweave.sources.files import factor_file, macro

        text = "This file\nwas made\n\n,Mkt-RF,SMB ,RF\n20240102, 1.50,-0.20,0.01\n20240103,-99.99, 0.10,0.01\n\n Annual\n,Mkt-RF,SMB,RF\n20230101,9,9,9\n"
        got = factor_file(frame(spark, [(text,)], "value string"), {"Mkt-RF": "MKT", "SMB": "SMB", "RF": "RF"}).orderBy("date").collect()
        assert [(str(r.date), r.MKT, r.SMB) for r in got] == [("2024-01-02", 0.015, -0.002), ("2024-01-03", None, 0.001)]
        ten, bill = frame(spark, [("2024-01-02", "4.0"), ("2024-01-03", ".")], "DATE string, DGS10 string"), frame(spark, [("2024-01-02", "5.0"), ("2024-01-04", "5.1")], "DATE string, DTB3 string")
        rows = {str(r.date): r for r in macro({"treasury_10y": ten, "tbill_3m": bill}).collect()}
        assert len(rows) == 3 and rows["2024-01-02"].term_spread == -1.0 and rows["2024-01-03"].treasury_10y is None

    def test_feeds(self, spark):
        from panelweave.sources.documents import cik_map, headline_items, rss_items

        rss = "<rss><channel><item><title>Up</title><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><description>d</description><link>l</link></item><item><title>Down</title><pubDate>x</pubDate><description/><link/></item></channel></rss>"
        assert [(r.title, str(r.ts)) for r in rss_items(frame(spark, [("A", rss)], "ticker string, value string")).orderBy(F.desc("title")).collect()] == [("Up", "2024-01-01 10:00:00"), ("Down", "None")]
        assert headline_items(frame(spark, [("A", '[{"datetime": 1704103200, "headline": "H", "summary": "s", "source": "x", "url": "u"}, {"datetime": 1, "headline": " "}]')], "ticker string, value string")).count() == 1
        assert cik_map(frame(spark, [('{"0": {"cik_str": 5, "ticker": "brk-b"}}',)], "value string")).first().ticker == "BRK.B"

    def test_insiders(self, spark):
        from panelweave.sources.files import insider_trades, quarters_since

        subs = frame(spark, [("1", "10", "05-JAN-2024"), ("2", "99", "05-JAN-2024")], "accession_number string, issuercik string, filing_date string")
        trades = frame(spark, [("1", "P", "10", "2.5"), ("1", "P", "10", "2.5"), ("1", "A", "10", "2"), ("2", "P", "1", "1")], "accession_number string, trans_code string, trans_shares string, trans_pricepershare string")
        got = insider_trades(subs, trades, frame(spark, [(10, "X")], "cik long, ticker string")).collect()
        assert [(r.ticker, str(r.filed), r.code, r.value) for r in got] == [("X", "2024-01-05", "P", 25.0)]
        assert [tuple(r) for r in quarters_since(spark, "2023-05-01", "2024-02-10").collect()] == [(2023, 2), (2023, 3), (2023, 4)]

    def test_wide_and_pick(self, spark):
        from panelweave.sources.files import pick_table, wide_to_long

        df = frame(spark, [(D(2024, 1, 2), 1.0, -1.0, 5.0, 6.0)], "date date, `Close|A` double, `Close|B` double, `Volume|A` double, `Volume|B` double")
        assert [(r.ticker, r.close, r.volume) for r in wide_to_long(df).collect()] == [("A", 1.0, 5.0)]
        heads = {"x/one.csv": ["Symbol", "Date", "Close"], "x/two.csv": ["Headline", "Date"]}
        assert pick_table(heads, ["ticker", "date", "close"]) == "x/one.csv" and pick_table(heads, ["title", "date"], ["two.csv"]) == "x/two.csv" and pick_table(heads, ["eps"]) is None

    def test_dataset_round_trip_and_rankings(self, spark, tmp_path):
        from panelweave.sources.store import Dataset, append_log, read, record_ranking

        prices = frame(spark, [("A", D(2024, 1, 2), 1.0)], "ticker string, date date, close double")
        Dataset(prices, macro=prices).save(str(tmp_path / "d"))
        Dataset(prices).save(str(tmp_path / "d"))
        again = Dataset.load(spark, str(tmp_path / "d"))
        assert again.prices.count() == 1 and again.macro is None
        for n in (1.0, 2.0):
            record_ranking(frame(spark, [("A", D(2024, 1, 3), n)], "ticker string, date date, rank double"), str(tmp_path / "r"))
        record_ranking(frame(spark, [("A", D(2024, 1, 4), 3.0)], "ticker string, date date, rank double"), str(tmp_path / "r"))
        assert sorted(r["rank"] for r in read(spark, str(tmp_path / "r")).collect()) == [2.0, 3.0]
        append_log(prices, str(tmp_path / "log"))
        append_log(prices, str(tmp_path / "log"))
        assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_streaming_equals_batch(spark, tmp_path):
    from panelweave.streaming.news import daily_sentiment

    rows = [(i % 40, i % 3, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * (i % 40)), "t", ["positive", "negative", "other"][i % 3]) for i in range(60)]
    df = frame(spark, rows, "event_id long, ticker long, ts timestamp, title string, sentiment string")
    df.filter("event_id < 40").dropDuplicates(["event_id"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = daily_sentiment(stream).writeStream.format("memory").queryName("news_out").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(60)
    got = spark.table("news_out").agg(F.sum("news_count"), F.count("*")).first()
    days = {(r.ticker, r.ts.date() + dt.timedelta(r.ts.hour >= 16)) for r in spark.read.parquet(str(tmp_path / "in")).collect()}
    assert got[0] == 40 and got[1] == len(days)


def test_serving_checks_its_arguments(spark):
    from panelweave.operators import serving

    scored = frame(spark, [("BRK.B", "Berk", "Fin", 1, 0.9), ("AA", "Alpha Co", "Tech", 2, 0.5), ("AB", None, "Biotech", 3, 0.1)], "ticker string, company_name string, sector string, rank int, model_probability double")
    assert [r.ticker for r in serving.rank_stocks(scored, 1, "bottom").collect()] == ["AB"] and [r.ticker for r in serving.in_sector(scored, "tech").collect()] == ["AA"]
    assert {r.ticker for r in serving.in_sector(scored, "ech").collect()} == {"AA", "AB"}
    asked = frame(spark, [("$brk-b",), ("nope",)], "asked string")
    assert {r.asked: r.ticker for r in serving.resolve(scored, scored, asked).collect()} == {"$brk-b": "BRK.B", "nope": None}
    for bad in (lambda: serving.rank_stocks(scored, 0), lambda: serving.screen(scored, sort_by="x"), lambda: serving.compare(scored, ["AA"])):
        with pytest.raises(ValueError):
            bad()


def test_entry_points():
    import __spark_entry__ as e

    assert "flagship_momentum_ic" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_equal_tickers_have_equal_prices(spark, tmp_path):
    """Whatever the order of the rows: a sum of doubles differs in the last bit, and ranks break the tie."""
    from panelweave.plans.proxies import view

    rng = random.Random(3)
    prices = [rng.randint(90_000, 10_500_000) / 100 for _ in range(6000)]
    orders = [sorted(prices), sorted(prices, reverse=True), *[rng.sample(prices, 6000) for _ in range(6)]]
    rows = [(ticker, dt.datetime(2024, 1, 1), 3.0, p) for ticker, order in enumerate(orders) for p in order]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    closes = [r.close for r in view(spark, str(tmp_path), "panel").collect()]
    assert len(closes) == 8 and len(set(closes)) == 1
    assert closes[0] == pytest.approx(100 + 10 * math.log(math.fsum(prices) / 18_000), abs=1e-12)
