"""A corpus pipeline over `documents`: toxic documents go, near copies go, leaked
benchmark passages go, sources are mixed to their targets and the mix is sharded.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before
it kept and returns the columns of `documents`; the last adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import decontaminate, mixing, sharding, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, learned from the labels of `docs`, is below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs.select("*", F.col("text").alias("_kept")), model)
    return scored.filter("toxicity < 0.5").withColumnRenamed("_kept", "text").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose sets of five-word shingles have a
    similarity of 0.8 or more."""
    return simhash.keep_one(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target sizes: whole documents, and a passage where a shard's run ends."""
    return mixing.mixed_texts(docs.select(*COLUMNS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in 16 shards of equal size, in random order, with shard and slot."""
    return sharding.shuffle_into_shards(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The first stage is a trained classifier, which SQL does not express; the tests
#: hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder in between."""
    from panelweave.llm.common import settle

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, f"stage-{name}")
    return docs
