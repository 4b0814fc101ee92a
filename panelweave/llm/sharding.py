"""Uniform shuffling into shards of exact sizes by a hypergeometric matrix.

Rows lie in `parts` virtual partitions, dealt by a hash of the id and the text.
Their counts and the exact shard sizes (rows at most one apart) are the margins
of a communication matrix, whose entries are drawn as a uniform random
permutation of all rows would fill it: each partition's row of counts is
multivariate hypergeometric given what the shards have left. Each partition then
permutes its rows (a seeded hash orders them) and sends the first run to shard
0, the next to shard 1 and so on; each shard permutes what arrives by another
seeded hash, in buckets whose offsets are summed beforehand, so no task sorts a
whole shard.

The law is `rows`. Only the matrix is drawn outside Spark, from one count for
each partition (`parts` numbers, MOST_PARTS at most).

Rows: null texts have size 1 and no checksum; a null id is dealt like any other;
repeated rows tie in the orders and are interchangeable; an empty table gives an
empty result; columns of the input that clash with those added are replaced.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.llm.common import settle

MOST_PARTS = 16_384


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among `draws` without replacement, by inversion from the mode
    outwards: some standard deviations of steps, at any population."""
    low, high = max(0, draws - bad), min(good, draws)
    if low >= high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(log(good, mode) + log(bad, draws - mode) - log(good + bad, draws))
    u = rng.random() - p
    down = up = mode
    p_down = p_up = p
    while u > 0 and (down > low or up < high):
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of each partition for each shard; shard sizes differ by one at most."""
    rng, total = random.Random(seed), sum(counts)
    left = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for count in counts:
        remaining, row = sum(left), []
        for j in range(shards):
            remaining -= left[j]
            n = hypergeometric(rng, left[j], remaining, count) if remaining else count
            row.append(n)
            count -= n
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def _table(spark: SparkSession, matrix: list[list[int]]) -> DataFrame:
    """(part, upto): running sums of each partition's counts by shard."""
    rows = []
    for part, row in enumerate(matrix):
        sums = [sum(row[: j + 1]) for j in range(len(row))]
        rows.append(f"({part}, array({', '.join(f'{n}L' for n in sums)}))")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(part, upto)")


def shuffle_into_shards(documents: DataFrame, shards: int = 16, seed: int = 29, part_rows: int = 2_000, bucket_rows: int = 20_000) -> DataFrame:
    """`documents` with `shard` and `slot`, the place in the shard from 0."""
    digest = next(c for c in ("text", "text_crc32") if c in documents.columns)
    packed = F.struct(*[c for c in documents.columns if c not in ("shard", "slot")]).alias("row")
    rows = documents.select(F.xxhash64(F.lit(seed), "doc_id", digest).alias("_order"), packed)
    total = rows.count()
    parts = max(1, min(MOST_PARTS, -(-total // part_rows)))
    part = F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), F.lit(parts)).cast("int")
    counted = {r.part: r.n for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    matrix = _table(documents.sparkSession, communication_matrix([counted.get(p, 0) for p in range(parts)], shards, seed))
    rows = rows.withColumn("_part", part)
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_order"))
    rows = rows.withColumn("_place", place).join(F.broadcast(matrix), F.col("_part") == F.col("part")).drop("part")
    rows = rows.withColumn("shard", F.size(F.filter("upto", lambda n: n < F.col("_place")))).drop("upto", "_place", "_part")
    # the second permutation: buckets in order of the hash, then rows within
    buckets = max(1, -(-total // (shards * bucket_rows)))
    again = F.xxhash64(F.lit(seed + 2), "_order")
    bucket = F.floor(F.shiftrightunsigned(again, 11) / float(1 << 53) * buckets).cast("int")
    rows = rows.withColumns({"_again": F.shiftrightunsigned(again, 1), "_bucket": F.least(bucket, F.lit(buckets - 1))})
    within = Window.partitionBy("shard", "_bucket")
    rows = rows.withColumn("_at", F.row_number().over(within.orderBy("_again")) - 1)
    if buckets > 1:
        rows = settle(rows, "shards")
        sums = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = sums.select(F.col("shard").alias("_s"), F.col("_bucket").alias("_b"), before.alias("_before"))
        rows = rows.join(offsets, (F.col("shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    else:
        rows = rows.withColumn("_before", F.lit(0))
    slot = (F.col("_before") + F.col("_at")).cast("long")
    return rows.select("row.*", "shard", slot.alias("slot"))


def shards(documents: DataFrame, n: int = 16, seed: int = 29) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    digest = documents.select("doc_id", size.alias("size"), F.crc32(F.col("text")).cast("long").alias("text_crc32"))
    dealt = shuffle_into_shards(digest, n, seed)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
