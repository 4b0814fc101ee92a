"""As-of joins whose rows are dealt to ranges of time, against a scan."""

import random

import pytest
from pyspark.sql import functions as F


def tables(spark, keys, n=300, seed=3):
    """Key 0 holds most rows; whole stretches have no right row."""
    rng = random.Random(seed)
    pick = lambda: 0 if rng.random() < 0.8 else rng.choice([*range(keys), None])
    left = [(pick(), rng.choice([None, *range(200)]), i) for i in range(n)]
    right = [(pick(), rng.choice([None, *range(20), *range(150, 180)]), k, rng.random()) for k in range(n // 4)]
    return left, right, spark.createDataFrame(left, "k int, t int, i int"), spark.createDataFrame(right, "k int, u int, tie int, v double")


def scan(left, right, keyed, direction, strict):
    out = {}
    for k, t, i in left:
        ok = [(u, tie, v) for rk, u, tie, v in right if t is not None and u is not None and (not keyed or rk == k) and ((u < t if strict else u <= t) if direction == "backward" else (u > t if strict else u >= t))]
        best = (max if direction == "backward" else min)(ok, key=lambda x: x[:2], default=None)
        out[i] = None if best is None else best[2]
    return out


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_spread_equals_a_scan(spark, keyed, direction, strict):
    from panelweave.operators.asof import asof

    left, right, a, b = tables(spark, 4)
    if keyed:  # null keys match each other in a window, as rows of one group
        left, right = ([r for r in t if r[0] is not None] for t in (left, right))
        a, b = a.filter("k IS NOT NULL"), b.filter("k IS NOT NULL")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = asof(a, b.select("u", "tie", "v", *(["k"] if keyed else [])), "t", "u", ["v"], ["k"] if keyed else [], direction, strict, ["tie"], spread=True)
        found = {r.i: r.v for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == scan(left, right, keyed, direction, strict)


def test_no_task_sees_all_rows(spark):
    from panelweave.operators.asof import asof

    _, _, a, b = tables(spark, 1)
    got = asof(a.drop("k"), b.select("u", "v"), "t", "u", ["v"])
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert got.count() == 300
    windows = [line for line in plan.splitlines() if "Window" in line and "_r" in line and "last(" in line]
    assert windows and all("_range" in w for w in windows)


def test_empty_sides(spark):
    from panelweave.operators.asof import asof

    _, _, a, b = tables(spark, 2)
    assert asof(a.limit(0), b.select("u", "v"), "t", "u", ["v"]).count() == 0
    assert asof(a, b.select("u", "v").limit(0), "t", "u", ["v"]).filter(F.col("v").isNotNull()).count() == 0
