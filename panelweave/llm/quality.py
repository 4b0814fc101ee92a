"""Quality rules with thresholds that adapt to each language and source.

Every metric is kept as an integer in thousandths and counted in buckets whose
width grows with the value (1/16 of it at most). Bucket counts add up, so the
counts are a mergeable quantile sketch: sketches of sources merge into the
sketch of a language, and those into the one of the corpus. A group's upper
fence is its third quartile plus a multiple of the spread between quartiles,
with a least slack; mean word length has a lower fence too. A group of under
`min_rows` documents takes its language's sketch, and a small language takes
that of the corpus. Documents are then joined with their group's fences.

Rows: null and empty texts have no words and fail the base rule; null languages
and sources form groups of their own; repeated rows are judged one by one; an
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import SPACE, broadcast_if_small, settle

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "#*$%&|<>"
#: metric -> (numerator, denominator, least slack above the quartile, both fences)
METRICS = {
    "word_len": ("word_chars", "n_words", 2500, True),
    "symbol_rate": ("n_symbols", "n_words", 100, False),
    "dup_line_rate": ("n_dup_lines", "n_lines", 500, False),
    "repeat_rate": ("n_repeat_words", "n_words", 450, False),
}


def with_base(df: DataFrame) -> DataFrame:
    """Base counts of `text`, by built-in functions only.

    Repeated windows: the hashes of all 3-word windows are sorted with their
    positions; a window whose hash stands beside an equal one is repeated, and
    each repeated window adds the words up to the next one (3 at most). Two
    different windows of one text share a 64-bit hash with a chance below 1e-10
    even at 20,000 words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    df = df.withColumns({"_words": words, "_lines": lines})
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "_windows": F.when(
                F.size("_words") >= 4,
                F.transform(
                    F.sequence(F.lit(0), F.size("_words") - 3),
                    lambda i: F.struct(
                        F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"),
                        i.alias("i"),
                    ),
                ),
            ),
        }
    ).drop("_words", "_lines")
    df = df.withColumn("_windows", F.sort_array("_windows"))
    twice = F.filter(
        "_windows",
        lambda x, k: (x["h"] == F.get("_windows", k - 1)["h"]) | (x["h"] == F.get("_windows", k + 1)["h"]),
    )
    df = df.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_windows", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bucket(value: Column) -> Column:
    """Bucket number: the value itself below 32, then 16 buckets to each doubling."""
    bits = F.length(F.bin(value))
    return F.when(value < 32, value).otherwise((bits - 5) * 16 + F.expr("shiftright(v, length(bin(v)) - 5)"))


def bucket_floor(number: Column) -> Column:
    """Least value in a bucket."""
    shift = F.floor((number - 16) / 16).cast("int")
    return F.when(number < 32, number).otherwise((number - shift * 16) * F.pow(F.lit(2.0), shift)).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, b, n): bucket counts of documents that pass the base rule."""
    values = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), F.floor(1000 * F.col(top) / F.greatest(F.col(under), F.lit(1))).cast("long").alias("v"))
            for name, (top, under, _, _) in METRICS.items()
        ]
    )
    rows = measured.filter(~F.col("base_failed")).select("lang", "source", F.explode(values).alias("m")).select("lang", "source", "m.*")
    return rows.withColumn("b", bucket(F.col("v"))).groupBy("lang", "source", "metric", "b").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of the sketches merged over `keys`."""
    merged = sketch.groupBy(*keys, "metric", "b").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumns({"upto": F.sum("n").over(by.orderBy("b")), "total": F.sum("n").over(by)})
    first = lambda part: bucket_floor(F.min(F.when(4 * F.col("upto") >= part * F.col("total"), F.col("b"))))
    return ranked.groupBy(*keys, "metric").agg(F.max("total").alias("rows"), first(1).alias("q1"), first(3).alias("q3"))


def fences(sketch: DataFrame, spread: int = 4, min_rows: int = 100) -> DataFrame:
    """One row per (lang, source) with `<metric>_lo` and `<metric>_hi`."""
    own = quartiles(sketch, ["lang", "source"])
    of_lang = quartiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("metric").alias("lm"), F.struct("rows", "q1", "q3").alias("of_lang"))
    whole = quartiles(sketch, []).select(F.col("metric").alias("wm"), F.struct("rows", "q1", "q3").alias("whole"))
    joined = own.join(of_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("lm")))
    joined = joined.join(whole, F.col("metric") == F.col("wm"))
    use = (
        F.when(F.col("rows") >= min_rows, F.struct("rows", "q1", "q3"))
        .when(F.col("of_lang.rows") >= min_rows, F.col("of_lang"))
        .otherwise(F.col("whole"))
    )
    joined = joined.withColumn("use", use)
    columns = []
    for name, (_, _, slack, two_sided) in METRICS.items():
        reach = F.greatest(spread * (F.col("use.q3") - F.col("use.q1")), F.lit(slack))
        pick = lambda c: F.max(F.when(F.col("metric") == name, c))
        columns.append(pick(F.col("use.q3") + reach).alias(f"{name}_hi"))
        columns.append(pick(F.col("use.q1") - reach if two_sided else F.lit(0)).alias(f"{name}_lo"))
    return joined.groupBy("lang", "source").agg(*columns)


def judge(documents: DataFrame, spread: int = 4, min_rows: int = 100) -> DataFrame:
    """Every document with its base counts, `base_failed`, `kept` and `reasons`."""
    measured = with_base(documents.select("doc_id", "lang", "source", "text")).drop("text")
    measured = settle(measured.withColumn("base_failed", base_failed()), "quality")
    limits = settle(fences(sketches(measured), spread, min_rows), "fences")
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = measured.join(
        broadcast_if_small(limits, limits.count()),
        F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")),
        "left",
    )
    rate = {name: F.floor(1000 * F.col(top) / F.greatest(F.col(under), F.lit(1))) for name, (top, under, _, _) in METRICS.items()}
    off = {name: (rate[name] > F.col(f"{name}_hi")) | (rate[name] < F.col(f"{name}_lo")) for name in METRICS}
    reasons = F.filter(F.array(F.when(F.col("base_failed"), F.lit("base")), *[F.when(c, F.lit(name)) for name, c in off.items()]), lambda x: x.isNotNull())
    return joined.withColumn("reasons", reasons).withColumn("kept", F.size("reasons") == 0).drop("_lang", "_source", *[f"{m}_{e}" for m in METRICS for e in ("lo", "hi")])
