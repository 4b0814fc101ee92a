"""What several corpus operators share: shared tables, words, components."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.shared import settle

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

__all__ = ["SPACE", "WORD", "arrow_batches", "broadcast_if_small", "code_points", "components", "crc_remainder", "settle", "slices", "utf8", "word_count"]


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Plans that run inside pass at most so many rows at a time to Python: whole texts
    make batches of the default size large, in the JVM's own memory too."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def broadcast_if_small(df: DataFrame, rows: int, most: int = 50_000) -> DataFrame:
    """Hint a broadcast of a settled table only if its counted rows fit `most`;
    beyond that the join shuffles and adaptive execution splits skewed keys."""
    return F.broadcast(df) if rows <= most else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo `parts`; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and the row offsets; null is empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the row offsets."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(lengths)])


def slices(texts: list[str], most: int = 1_000_000):
    """Index ranges of consecutive texts with about `most` characters in all."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def components(edges: DataFrame, label: str) -> DataFrame:
    """Smallest node reachable from every node of an edge list (a, b).

    Alternating large-star and small-star rounds; each is an aggregate by node
    joined back on the node (which adaptive execution can split for a hub), so
    neighbours are never gathered in one task, and each is written to the
    shared folder. Returns (node, root) with a row for every node of an edge.
    Null ends and loops are ignored; an empty list gives an empty result.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    pairs = pairs.filter("a <> b").distinct()
    now = settle(pairs, label)
    sign = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = settle(small.select("e.*").filter("a <> b").distinct(), label)
        # equal counts and hash sums two rounds running: the stars are stable
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == sign:
            break
        sign = seen
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
