"""Mixing sources to target weights by Sainte-Laguë apportionment of blocks.

Targets: sources in code-point order (null last) weigh 5, 2, 1 and so on; they
share `share` times all words, and a target stops at `most` times its source's
words, the excess being reshared by weight until none is above.

Quotas: a source's documents are dealt by a hash into shards of about
`shard_words` words; a shard is laid out in the order of a seeded hash and cut
into blocks of `block_words` words (of equally many: the shard's words over the
nearest whole number of blocks). All blocks of the mix are allocated to the
sources by highest quotients of their targets (target over 1, 3, 5, ...), and a
source's quota to its shards by highest quotients of their blocks, which gives an
integer quota for each shard. A quota of q over n blocks takes every block q div n
times, and q mod n blocks once more: those that follow one another, around the
shard's end, from a block that the seed draws. So every block is as likely, and
all documents but those at the ends of the run are taken whole. A source's taken
words differ from its target by half a block, and rounding, whatever the size.

Rows: null texts have no words and take none; repeated rows (same id and text)
share a shard and are laid out one after another, in any order; null ids are
dealt by their texts; a null source is a source;
an empty table gives an empty result. Further columns pass through untouched,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import broadcast_if_small, settle, word_count

WEIGHTS = (5, 2, 1)


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add `target` to (source, source_size); one row per source.

    With sources ordered by words per weight, those before some place are capped
    and the rest share what is left at one rate; the rate is the first that
    caps none of the rest.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    weighed = sources.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rate = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    rated = weighed.withColumn("rate", F.when(rate * F.col("w") <= F.col("cap"), rate))
    level = F.coalesce(F.max("rate").over(whole), F.lit(float("inf")))
    return rated.withColumn("target", F.least("cap", level * F.col("w"))).drop("w", "cap", "rate")


def apportion(rows: DataFrame, within: list[str], claim: Column, seats: Column, tie: list[str]) -> DataFrame:
    """Add `quota`: the Sainte-Laguë share of `seats` for each row's `claim`.

    A row's quota differs from its exact share x by at most 1/2 + x n / (2 seats)
    for n rows, so only quotients that near are ranked: some 5 n in all.
    """
    by = Window.partitionBy(*within)
    rows = rows.withColumn("_seats", seats).withColumn("_x", claim * F.col("_seats") / F.sum(claim).over(by)).withColumn("_n", F.count("*").over(by))
    reach = F.ceil(1.5 + F.col("_x") * F.col("_n") / (2 * F.greatest(F.col("_seats"), F.lit(1))))
    rows = rows.withColumn("_low", F.greatest(F.lit(0), F.floor("_x") - reach).cast("long"))
    tried = rows.withColumn("_k", F.explode(F.sequence("_low", (F.floor("_x") + reach).cast("long"))))
    quotient = F.col("_x") / (2 * F.col("_k") + 1)
    ranked = tried.withColumn("_rank", F.row_number().over(by.orderBy(F.desc(quotient), *tie)))
    keys = [c for c in rows.columns if not c.startswith("_")]
    base = F.sum(F.when(F.col("_k") == F.col("_low"), F.col("_low")).otherwise(0)).over(by)
    won = ranked.withColumn("_base", base).groupBy(*keys).agg(F.max("_low").alias("low"), F.sum((F.col("_rank") <= F.col("_seats") - F.col("_base")).cast("long")).alias("won"))
    return won.withColumn("quota", F.col("low") + F.col("won")).drop("low", "won")


def plan(sized: DataFrame, seed: int, share: float, most: float, shard_words: int, block_words: int) -> tuple[DataFrame, DataFrame]:
    """Sources with targets and shard counts; shards with how often they are taken
    whole (`full`) and the words of their run: from `low` to `high`, and from the
    shard's first word to `wrapped`."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(sources, share, most).withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("int"))
    sources = settle(sources, "sources")
    shards = deal(sized, sources, seed).groupBy("source", "source_size", "target", "shard").agg(F.sum("size").alias("words"))
    shards = shards.withColumn("blocks", F.greatest(F.round(F.col("words") / block_words), F.lit(1)).cast("long")).filter("words > 0")
    of_source = shards.groupBy("source").agg(F.sum("blocks").alias("blocks"), F.max("target").alias("target"), F.max("source_size").alias("source_size"))
    claim = F.col("target") / F.col("source_size") * F.col("blocks")
    quotas = apportion(of_source, [], claim, F.round(F.sum(claim).over(Window.partitionBy())).cast("long"), ["source"])
    quotas = quotas.select(F.col("source").alias("_source"), F.col("quota").alias("source_quota"))
    joined = shards.join(quotas, F.col("source").eqNullSafe(F.col("_source"))).select("source", "shard", "words", "blocks", "source_quota")
    dealt = apportion(joined, ["source"], F.col("blocks").cast("double"), F.col("source_quota"), ["shard"])
    dealt = dealt.withColumn("quota", F.least(F.col("quota"), F.floor(F.col("blocks") * F.lit(most))))
    dealt = dealt.withColumns({"full": F.floor(F.col("quota") / F.col("blocks")), "rest": F.col("quota") % F.col("blocks"), "begin": F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.col("blocks"))})
    edge = lambda block: F.ceil(block * F.col("words") / F.col("blocks")).cast("long")  # noqa: E731  first word of a block
    end = F.col("begin") + F.col("rest")
    runs = {"low": edge(F.col("begin")), "high": edge(F.least(end, F.col("blocks"))), "wrapped": edge(F.greatest(end - F.col("blocks"), F.lit(0)))}
    return sources, settle(dealt.withColumns(runs).select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "full", *runs), "quotas")


def deal(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Join documents with their source's row and deal them into its shards."""
    named = sources.withColumnRenamed("source", "_source")
    joined = sized.join(broadcast_if_small(named, named.count()), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return joined.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "th"), F.col("n_shards")).cast("int")).drop("n_shards")


def mix(documents: DataFrame, seed: int = 17, share: float = 1.5, most: float = 2.0, shard_words: int = 2_000_000, block_words: int = 50, carry: bool = True) -> DataFrame:
    """Documents with size, source_size, target, taken and `pieces`: an array of
    (first word, words, times) of the passages that are taken of the document.

    With `carry` false only doc_id and source are kept of the input; else `row`
    holds its columns, whatever their names, and `text` stands beside it.
    """
    size, th = word_count(F.col("text")), F.xxhash64("text")
    sized = settle(documents.select("doc_id", "source", size.alias("size"), th.alias("th")), "sizes")
    sources, shards = plan(sized, seed, share, most, shard_words, block_words)
    others = F.struct("doc_id", *[c for c in documents.columns if c not in ("doc_id", "text")])
    rows = documents.select("doc_id", "source", size.alias("size"), th.alias("th"), "text", others.alias("row")) if carry else sized
    rows = deal(rows, sources, seed)
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "th"), "doc_id", "th")
    rows = rows.withColumn("_start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard"))
    rows = rows.join(broadcast_if_small(shards, shards.count()), same, "left")

    def run(low: Column, high: Column) -> Column:
        a, b = F.greatest(low, F.col("_start")), F.least(high, F.col("_start") + F.col("size"))
        return F.struct((a - F.col("_start")).alias("first"), (b - a).alias("words"), F.lit(1).alias("times"))

    whole = F.struct(F.lit(0).cast("long").alias("first"), F.col("size").alias("words"), F.col("full").cast("int").alias("times"))
    pieces = F.array(whole, run(F.lit(0).cast("long"), F.col("wrapped")), run(F.col("low"), F.col("high")))
    pieces = F.filter(pieces, lambda p: (p["words"] > 0) & (p["times"] > 0))
    rows = rows.withColumn("pieces", F.when((F.col("size") > 0) & F.col("full").isNotNull(), pieces))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"] * p["times"])
    rows = rows.withColumn("taken", F.coalesce(taken, F.lit(0).cast("long")))
    return rows.drop("_start", "_source", "_shard", "full", "low", "high", "wrapped", "th")


def mixed_texts(documents: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of `documents`: a row for each time that a
    passage of a document is taken. Passages are the whole text as it is, or a
    stretch of its words that follow one another, each with the white space after it."""
    rows = mix(documents, **options).withColumn("_p", F.explode("pieces"))
    rows = rows.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_p.times"))))
    # split before every word: each part is a word with the white space after it
    parts = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 2).otherwise(1)
    cut = F.array_join(F.slice(parts, (F.col("_p.first") + lead).cast("int"), F.col("_p.words").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("_p.words") == F.col("size"), F.col("text")).otherwise(cut))
    changed = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.length("text").cast(documents.schema["n_chars"].dataType)
    return rows.select(*[(changed[c] if c in changed else F.col("row")[c]).alias(c) for c in documents.columns])


def takings(documents: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(documents, carry=False, **options).select("doc_id", "size", "source_size", "target", "taken")
