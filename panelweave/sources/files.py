"""Scans of landed files: prices, fundamentals, news, macro and factor tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.operators.news import market_time

# Header names that stand for a column of the library.
ALIASES = {
    "symbol": "ticker", "stock": "ticker", "adj_close": "close", "adjusted_close": "close", "closing_price": "close", "headline": "title",
    "pubdate": "date", "published_date": "date", "datetime": "date", "marketcap": "market_cap", "trailingpe": "pe_ratio", "totalrevenue": "revenue",
    "profitmargins": "profit_margin", "debttoequity": "debt_to_equity", "returnonequity": "roe",
}


def normal_name(name: str) -> str:
    plain = re.sub(r"[ \-/]", "_", name.strip().lower())
    return ALIASES.get(plain, plain)


def normalise_columns(df: DataFrame) -> DataFrame:
    """Headers in lower case with underscores and aliases resolved; of columns that
    come to one name the first is kept."""
    seen, columns = set(), []
    for i, name in enumerate(df.columns):
        if normal_name(name) not in seen:
            seen.add(normal_name(name))
            columns.append((i, normal_name(name)))
    unique = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return unique.select(*[F.col(f"_{i}").alias(n) for i, n in columns])


def read_csv(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame:
    return spark.read.csv(path if isinstance(path, str) else list(path), header=True, sep=sep)


def require(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} has no {', '.join(missing)}")
    return df


def number(name: str) -> Column:
    """A number, or null for text, NaN and infinities."""
    value = F.expr(f"try_cast(`{name}` AS DOUBLE)")
    return F.when(F.abs(value) < float("inf"), value)


def prices(df: DataFrame) -> DataFrame:
    """Ticker in capitals, date, numeric columns; rows without any of the keys go."""
    df = require(normalise_columns(df), ["ticker", "date", "close"], "prices")
    values = {c: number(c) for c in ("open", "high", "low", "close", "raw_close", "volume") if c in df.columns}
    df = df.withColumns({"ticker": F.upper(F.trim("ticker")), "date": F.expr("try_cast(date AS DATE)")} | values)
    return df.dropna(subset=["ticker", "date", "close"])


def price_folder(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of per-ticker files; a file without a ticker column is named after it.

    Files are grouped by header, so there is one scan for each kind of file.
    """
    kinds: dict[tuple, list[str]] = {}
    for path in paths:
        kinds.setdefault(tuple(read_csv(spark, path).columns), []).append(path)
    parts = []
    for header, files in kinds.items():
        df = read_csv(spark, files)
        if "ticker" not in map(normal_name, header):
            df = df.withColumn("ticker", F.regexp_extract("_metadata.file_name", r"^(.*)\.csv$", 1))
        parts.append(prices(df))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def fundamentals(df: DataFrame) -> DataFrame:
    """One row a ticker: the last in file order."""
    df = require(normalise_columns(df), ["ticker"], "fundamentals").withColumn("ticker", F.upper(F.trim("ticker")))
    last = Window.partitionBy("ticker").orderBy(F.desc("_id"))
    ordered = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_n", F.row_number().over(last))
    return ordered.filter("_n = 1 AND ticker IS NOT NULL").drop("_n", "_id")


def news(df: DataFrame) -> DataFrame:
    """Title (or summary, content, description), market time and session date."""
    df = normalise_columns(df)
    texts = [c for c in ("title", "summary", "content", "description") if c in df.columns]
    if not texts:
        raise ValueError("news has no title")
    df = require(df.withColumn("title", F.coalesce(*texts)), ["ticker", "date"], "news")
    if "sentiment" not in df.columns and "lm_sentiment" in df.columns:
        df = df.withColumnRenamed("lm_sentiment", "sentiment")
    df = df.withColumns({"ticker": F.upper(F.trim("ticker")), "ts": market_time(F.trim("date"))})
    late = (F.hour("ts") >= 16).cast("int")
    return df.withColumn("date", F.date_add(F.to_date("ts"), late)).dropna(subset=["ticker", "date"])


def pick_table(headers: dict[str, Sequence[str]], wanted: Sequence[str], candidates: Sequence[str] = ()) -> str | None:
    """The file for a table: a candidate by name, else the header that holds most
    of the wanted columns (at least half)."""
    by_name = {path.rsplit("/", 1)[-1].lower(): path for path in headers}
    for name in candidates:
        if name.lower() in by_name:
            return by_name[name.lower()]
    score = {path: len(set(wanted) & set(map(normal_name, names))) for path, names in headers.items()}
    best = max(sorted(score), key=score.get, default=None)
    return best if best is not None and 2 * score[best] >= len(wanted) else None


def wide_to_long(df: DataFrame, sep: str = "|") -> DataFrame:
    """Columns `<field>|<ticker>` beside `date` to rows (ticker, date, fields); rows
    without a positive finite close go."""
    names = [c for c in df.columns if sep in c]
    fields = sorted({c.split(sep)[0] for c in names})
    long = df.unpivot("date", names, "name", "value")
    parts = F.split("name", re.escape(sep))
    wide = long.select("date", parts[0].alias("field"), parts[1].alias("ticker"), "value").groupBy("ticker", "date").pivot("field", fields).agg(F.first("value"))
    wide = wide.toDF(*map(normal_name, wide.columns))
    return positive(wide)


def positive(df: DataFrame) -> DataFrame:
    return df.filter((F.col("close") > 0) & (F.col("close") < float("inf")))


def drop_unfinished(df: DataFrame, now) -> DataFrame:
    """Without today's bar while the session runs (before 16:30 market time)."""
    if (now.hour, now.minute) >= (16, 30):
        return df
    return df.filter(F.col("date") < F.lit(now.date()))


def unsplit(df: DataFrame) -> DataFrame:
    """`split_factor`, the product of later splits, and the price as traded."""
    later = Window.partitionBy("ticker").orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    ratio = F.when(F.col("split_ratio") > 0, F.col("split_ratio")).otherwise(1.0)
    df = df.withColumn("_s", ratio).withColumn("split_factor", F.coalesce(F.product("_s").over(later), F.lit(1.0)))
    return df.withColumn("raw_close", F.col("close") * F.col("split_factor")).drop("_s")


def benchmark_series(df: DataFrame, symbol: str) -> DataFrame:
    """(date, close) of one symbol: adjusted where there is an adjusted close."""
    close = F.coalesce("adj_close", "close") if "adj_close" in df.columns else F.col("close")
    return df.filter(F.col("ticker") == symbol).select("date", close.alias("close")).dropDuplicates(["date"])


def live_prices(df: DataFrame) -> DataFrame:
    """Close adjusted for dividends; highs and lows on the same basis."""
    adjusted = F.coalesce("adj_close", "close")
    factor = F.try_divide(adjusted, "close")
    bands = {c: F.col(c) * factor for c in ("high", "low") if c in df.columns}
    out = df.withColumns(bands | {"close": adjusted})
    return out.select("ticker", "date", "close", "volume", "raw_close", *bands, *[c for c in ("split_factor",) if c in df.columns])


def macro(parts: dict[str, DataFrame]) -> DataFrame:
    """Series (date, value), '.' for missing, joined on date; the term spread."""
    named = []
    for name, df in parts.items():
        first, value = df.columns[:2]
        named.append(df.select(F.expr(f"try_cast(`{first}` AS DATE)").alias("date"), number(value).alias(name)).dropna(subset=["date"]))
    out = reduce(lambda a, b: a.join(b, "date", "outer"), named)
    if {"treasury_10y", "tbill_3m"} <= set(out.columns):
        out = out.withColumn("term_spread", F.col("treasury_10y") - F.col("tbill_3m"))
    return out


def factor_file(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Daily factors from a whole file as `value`: the first block of lines that
    start with a date, percent to fractions. `columns` maps header names."""
    block = F.regexp_extract("value", r"(?s)([^\n]*\n(?:\s*\d{8}\s*,[^\n]*\n?)+)", 1)
    lines = df.select(F.split(F.regexp_replace(block, "\r", ""), "\n").alias("lines"))
    header = F.transform(F.split(F.get("lines", F.lit(0)), ","), lambda c: F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]", "")))
    rows = lines.select(header.alias("header"), F.explode(F.slice("lines", 2, 1_000_000)).alias("line")).filter(F.col("line").rlike(r"^\s*\d{8}\s*,"))
    cells = rows.select("header", F.split("line", r"\s*,\s*").alias("c"))
    out = cells.select(F.to_date(F.trim(F.get("c", F.lit(0))), "yyyyMMdd").alias("date"), *[F.get("c", F.array_position("header", re.sub(r"[^a-z0-9]", "", name.lower())).cast("int") - 1).alias(to) for name, to in columns.items()])
    value = {to: F.expr(f"try_cast(`{to}` AS DOUBLE)") for to in columns.values()}
    return out.withColumns({to: F.when(v > -99, v / 100) for to, v in value.items()})


def join_factors(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "date", "outer"), parts)


def quarters_since(spark: SparkSession, start: str, today: str) -> DataFrame:
    """(year, quarter) from the start's quarter to the last complete one."""
    first, last = F.trunc(F.lit(start).cast("date"), "quarter"), F.add_months(F.trunc(F.lit(today).cast("date"), "quarter"), -3)
    days = spark.range(1).select(F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 3 MONTH"))).alias("d")).select(F.explode("d").alias("d"))
    return days.select(F.year("d").alias("year"), F.quarter("d").alias("quarter"))


def insider_trades(submissions: DataFrame, trades: DataFrame, ciks: DataFrame) -> DataFrame:
    """Open-market trades (codes P and S) of the issuers asked for, each once."""
    subs = submissions.select("accession_number", F.expr("try_cast(issuercik AS LONG)").alias("cik"), F.to_date(F.expr("try_to_timestamp(filing_date, 'dd-MMM-yyyy')")).alias("filed"))
    subs = subs.join(F.broadcast(ciks.select("cik", "ticker")) if ciks.count() <= 50_000 else ciks.select("cik", "ticker"), "cik")
    rows = trades.filter(F.col("trans_code").isin("P", "S")).select("accession_number", F.col("trans_code").alias("code"), (number("trans_shares") * number("trans_pricepershare")).alias("value"))
    joined = subs.join(rows, "accession_number").filter("filed IS NOT NULL AND value > 0")
    return joined.select("ticker", "filed", F.col("accession_number").alias("accession"), "code", "value").distinct()


def insider_quarters(spark: SparkSession, folders: dict[str, str], ciks: DataFrame) -> tuple[DataFrame | None, list[str]]:
    """Trades of all quarters' folders (SUBMISSION.tsv, NONDERIV_TRANS.tsv), each
    once, and the quarters that could not be read. The loop is over quarters."""
    parts, failed = [], []
    for quarter, folder in sorted(folders.items()):
        try:
            subs, trans = (normalise_columns(read_csv(spark, f"{folder}/{name}.tsv", "\t")) for name in ("SUBMISSION", "NONDERIV_TRANS"))
            parts.append(insider_trades(subs, trans, ciks))
        except AnalysisException as e:  # a missing or malformed quarter does not stop the rest
            failed.append(f"{quarter}: {e.getCondition()}")
    trades = reduce(lambda a, b: a.unionByName(b), parts).distinct() if parts else None
    return trades, failed


def landed(spark: SparkSession, price_paths: Sequence[str], company_path: str | None = None, news_path: str | None = None):
    """The dataset of landed files, and one row of its quality figures."""
    from panelweave.operators.universe import data_quality
    from panelweave.sources.store import Dataset

    table = lambda path, kind: kind(read_csv(spark, path)) if path else None
    data = Dataset(price_folder(spark, price_paths), companies=table(company_path, fundamentals), news=table(news_path, news))
    companies = data.companies if data.companies is not None else data.prices.select("ticker").distinct()
    missing = {"sector": F.lit(None).cast("string")} if "sector" not in companies.columns else {}
    return data, data_quality(data.prices, companies.withColumns(missing))


def constituents(df: DataFrame) -> DataFrame:
    from panelweave.operators.universe import normalise_ticker

    out = normalise_columns(df).withColumn("ticker", normalise_ticker(F.col("ticker")))
    return out.filter("ticker IS NOT NULL").dropDuplicates(["ticker"])


def index_changes(df: DataFrame) -> DataFrame:
    from panelweave.operators.universe import normalise_ticker

    out = normalise_columns(df).withColumns({"date": F.expr("try_cast(date AS DATE)"), "added": normalise_ticker(F.col("added")), "removed": normalise_ticker(F.col("removed"))})
    return out.filter("date IS NOT NULL").dropDuplicates().orderBy(F.desc("date"))


def change_kinds(changes: DataFrame) -> DataFrame:
    """(date, ticker, kind) rows of a table with `added` and `removed` columns."""
    both = F.array(F.struct(F.col("added").alias("ticker"), F.lit("added").alias("kind")), F.struct(F.col("removed").alias("ticker"), F.lit("removed").alias("kind")))
    return changes.select("date", F.explode(both).alias("x")).select("date", "x.*").filter("ticker IS NOT NULL")
