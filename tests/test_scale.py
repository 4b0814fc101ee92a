"""Plans whose sorts must not grow with all history."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from panelweave.functions.frames import avg_rank, group_count, places
from panelweave.operators import crosssection, serving


def _panel(spark, n=40, weeks=8):
    rows = [(t, date(2020, 1, 6) + timedelta(7 * w), ((t * 7919 + w * 104729) % 101) / 500 - 0.1, 0.5 if (t, w) == (3, weeks - 2) else 0.01) for t in range(n) for w in range(weeks) if not (t == 5 and w > weeks - 4)]
    return spark.createDataFrame(rows, "ticker long, date date, return_20d double, return_1d double")


def test_snapshot_ranks_only_late_rows(spark):
    df = _panel(spark)
    late = serving.late_rows(df)
    assert late.count() == 39 + 39  # the last week and the one seven days before it
    ranked = lambda rows: crosssection.percentile_ranks(rows, ["return_20d"])
    shown = lambda got: [tuple(r) for r in got.select("ticker", "date", "return_20d_xs_rank", "rank").orderBy("rank").collect()]
    got = shown(serving.score_snapshot(ranked(late), "return_20d_xs_rank", history=df))
    assert got == shown(serving.score_snapshot(ranked(df), "return_20d_xs_rank")) and len(got) == 38  # 3 moved, 5 is stale
    member = df.withColumn("in_index", F.col("date") < "2020-02-17")  # no newest row of a member but ticker 5's
    assert {r.date for r in serving.late_rows(member).select("date").collect()} > {date(2020, 2, 3)}
    assert [r.ticker for r in serving.score_snapshot(ranked(member), "return_20d_xs_rank").collect()] == [5]


def test_places_of_all_columns_in_one_exchange(spark):
    rows = [(d, t, [None, float("nan"), 0.0, -0.0, 1.5, 2.0, -3.0, float("inf")][(t * 5 + d) % 8], None if d == 2 else float(t % 4), t % 3 > 0) for d in range(4) for t in range(30)]
    df = spark.createDataFrame(rows, "d int, t int, a double, b double, m boolean")
    plain = lambda c, m: (avg_rank(c, ["d"], m), group_count(c, ["d"], m))
    for m in (None, F.col("m")):
        got = places(df, ["a", "b"], ["d"], m)
        exp = df.select("d", "t", *[e.alias(n) for c in "ab" for e, n in zip(plain(c, m), (f"_place_{c}", f"_known_{c}"), strict=True)])
        show = lambda x: sorted(map(str, x.select("d", "t", "_place_a", "_known_a", "_place_b", "_known_b").collect()))
        assert show(got) == show(exp)
    assert places(df.limit(0), ["a"], ["d"]).count() == 0
    found = crosssection.gaussian_ranks(crosssection.percentile_ranks(df.withColumn("date", F.col("d")), ["a", "b"]).drop("a_xs_rank", "b_xs_rank"), ["a", "b"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Window" not in plan  # the group is sorted by its date alone


def test_only_what_is_needed_goes_to_the_tickers_windows(spark, sf_dir="/root/testdata/sf0.001"):
    from panelweave.operators import labels
    from panelweave.plans.panel_queries import features, usable, with_next_week

    got = with_next_week(spark, sf_dir, "momentum_12_1")
    assert got.columns == ["ticker", "date", "close", "momentum_12_1", "future_return_5d", "tradable_return_5d", "target_up_5d"]
    exp = usable(labels.forward_returns(features(spark, sf_dir), horizons=(5,))).select(*got.columns)
    assert got.exceptAll(exp).count() == 0 and exp.count() == got.count() > 0


def test_share_counts_take_one_exchange(spark, tmp_path):
    """Facts meet by company, metric and period once, with no sums before that, which
    would hold nearly every line; the exchange has the parts that are set."""
    import datetime as dt

    from panelweave.queries import QUERIES

    day = dt.datetime(1995, 3, 2)
    rows = [(7, "A", day, 45, 10.0), (7, "A", day, 45, 5.0), (7, "A", day, 46, 90.0), (7, "R", day, 1, 2.5), (8, "A", day, 3, 1.0)]
    lines = spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_shipdate timestamp, l_orderkey long, l_extendedprice double")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    df = QUERIES["f4_f5_share_counts"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    assert plan.index("Exchange") > plan.rindex("HashAggregate(")
    got = sorted((r.cik, r.metric, r.value, r.available) for r in df.collect())
    assert got == [(7, "A", 15.0, dt.date(1995, 3, 2)), (7, "R", 2.5, dt.date(1995, 3, 3)), (8, "A", 1.0, dt.date(1995, 3, 5))]
