"""Reading and writing the library's tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dataset:
    """The tables of a research run; those that are not there are None."""

    prices: DataFrame
    companies: DataFrame | None = None
    news: DataFrame | None = None
    fundamentals: DataFrame | None = None
    macro: DataFrame | None = None
    membership: DataFrame | None = None
    index_changes: DataFrame | None = None
    index_prices: DataFrame | None = None
    eps: DataFrame | None = None
    earnings_dates: DataFrame | None = None
    insiders: DataFrame | None = None
    factors: DataFrame | None = None
    delistings: DataFrame | None = None

    def save(self, root: str) -> None:
        """Every table as Parquet under its name; one that is None leaves no file."""
        spark = self.prices.sparkSession
        for f in fields(self):
            table = getattr(self, f.name)
            if table is not None:
                write(table, f"{root}/{f.name}")
            else:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{f.name}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    @staticmethod
    def load(spark: SparkSession, root: str) -> Dataset:
        return Dataset(**{f.name: read(spark, f"{root}/{f.name}") for f in fields(Dataset)})


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame | None:
    """The table, or None where there is none."""
    try:
        return spark.read.format(form).load(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def save_artifact(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A result as parquet, csv (with header) or json lines."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else getattr(writer, form)(path)


def record_ranking(scored: DataFrame, path: str) -> None:
    """Today's ranking into its date's partition; a rerun replaces that date alone."""
    scored.write.mode("overwrite").partitionBy("date").option("partitionOverwriteMode", "dynamic").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a log that is never rewritten."""
    df.write.mode("append").json(path)
