"""Features appended session by session equal those of the whole history."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

DAYS = [d for d in (dt.date(2019, 1, 1) + dt.timedelta(i) for i in range(1100)) if d.weekday() < 5][:760]


@pytest.fixture(scope="module")
def prices(spark):
    """Gaps, a ticker that starts late, one that stops and comes back, a thin holiday."""
    rng = random.Random(6)
    rows = []
    for t in range(7):
        price = 40.0 + t
        for i, d in enumerate(DAYS):
            price *= 1 + rng.gauss(0.0004, 0.015)
            if (t == 1 and i < 300) or (t == 2 and 100 < i < 690) or (i == 720 and t) or rng.random() < 0.01:
                continue
            rows.append((f"T{t}", d, price, price * 1.01, price * 0.99, float(rng.randint(100, 900))))
    return spark.createDataFrame(rows, "ticker string, date date, close double, high double, low double, volume double")


def test_two_appends_equal_all_at_once(spark, prices, tmp_path):
    from panelweave.operators.appending import State, append
    from panelweave.operators.calendar import on_calendar
    from panelweave.operators.prices import price_features

    whole = price_features(on_calendar(prices)).filter("NOT _filled")
    parts, state = [], None
    for a, b in ((0, 600), (600, 725), (725, 760)):
        some = prices.filter(F.col("date").between(F.lit(DAYS[a]), F.lit(DAYS[b - 1])))
        rows, state = append(state, some)
        parts.append(rows.filter("NOT _filled").toPandas())
        state.save(str(tmp_path / f"s{b}"))
        state = State.load(spark, str(tmp_path / f"s{b}"))
        assert state.recent.select("date").distinct().count() <= 521
    import pandas as pd

    keys = ["ticker", "date"]
    got, expected = (x.sort_values(keys).reset_index(drop=True) for x in (pd.concat(parts), whole.toPandas()))
    assert len(got) == len(expected) and (got[keys] == expected[keys]).all().all()
    for c in expected.columns.difference([*keys, "_filled"]):
        assert (got[c].isna() == expected[c].isna()).all(), c
        assert ((got[c] - expected[c]).abs().fillna(0) < 1e-9).all(), c
    assert expected["residual_momentum"].notna().sum() > 500


def test_new_prices_are_read_once(spark, prices, tmp_path):
    """Calendar, spans, features and state come from one reading of what is appended."""
    from panelweave.operators.appending import State, append

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    few = prices.filter(F.col("date") < F.lit(DAYS[60])).localCheckpoint()
    watched = few.mapInArrow(counted, few.schema)
    parts, state, path = [watched.filter(F.col("date") < F.lit(DAYS[30])), watched.filter(F.col("date") >= F.lit(DAYS[30]))], None, str(tmp_path / "state")
    for part in parts:
        rows, state = append(state, part)
        state.save(path)
        state = State.load(spark, path)
        rows.count()
    assert read.value == 2 * few.count()


def test_nothing_new(spark, prices):
    from panelweave.operators.appending import State, append

    few = prices.filter(F.col("date") < F.lit(DAYS[30]))
    _, state = append(None, few)
    rows, again = append(state, few.limit(5))
    assert rows.count() == 0 and again.upto == state.upto and again.busiest == state.busiest
    assert State.load(spark, "/nowhere/at/all") is None


def test_no_wide_row_is_shuffled_for_the_market(spark):
    from panelweave.operators.calendar import on_calendar
    from panelweave.operators.prices import price_features

    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(40)]
    rows = [(f"T{t}", d, 50.0 + t + (i * (t + 3)) % 7) for t in range(4) for i, d in enumerate(days)]
    df = price_features(on_calendar(spark.createDataFrame(rows, "ticker string, date date, close double")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(date" not in plan
    got = {(r.ticker, r.date): r for r in df.collect()}
    own = [got[f"T{t}", days[9]].return_1d for t in range(4)]
    assert abs(got["T0", days[9]].market_return_1d - sum(own) / 4) < 1e-15
