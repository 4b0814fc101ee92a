"""One registered query for each corpus operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import decontaminate, hardnegatives, html, language, linededup, maxent, mixing, quality, sharding, simhash, tokens, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base rule and adaptive verdict of every document."""
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", F.concat_ws(",", "reasons").alias("reasons"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.takings(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.classify(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shards(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat, or nearly, one that is kept elsewhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("_th"))
    found = linededup.verdicts(docs).withColumnsRenamed({"doc_id": "_id", "th": "_t"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_t"))
    rows = docs.drop("text").join(found, same, "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.size(removed).alias("n_removed"), removed.alias("removed_lines"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place in a document that overlaps a benchmark item."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "n_words", "n_equal")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor; labels of every seventh id are moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(table(spark, sf_dir, "embeddings"), moved)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the leading eight components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document."""
    return maxent.score_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_extraction": op2_html_extraction,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_source_mixing": op5_source_mixing,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_language_id": op7_language_id,
    "op8_sharding": op8_sharding,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_whitening": op12_whitening,
    "op13_lm_scoring": op13_lm_scoring,
}

#: The base counts and fences of op1 once more: windows of words are compared as
#: words, and the metrics are (name, numerator, denominator, slack, two-sided).
OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
w AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM s),
g AS (SELECT rid, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
t AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g WHERE c IS NOT NULL),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM t WHERE n > 1) GROUP BY rid),
m AS (SELECT s.rid, doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines FROM s LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS (SELECT rid, lang, source, base_failed, unnest([{'metric': 'word_len', 'v': 1000 * word_chars // greatest(n_words, 1), 'slack': 2500, 'two': true}, {'metric': 'symbol_rate', 'v': 1000 * n_symbols // greatest(n_words, 1), 'slack': 100, 'two': false},
  {'metric': 'dup_line_rate', 'v': 1000 * n_dup_lines // greatest(n_lines, 1), 'slack': 500, 'two': false}, {'metric': 'repeat_rate', 'v': 1000 * n_repeat_words // greatest(n_words, 1), 'slack': 450, 'two': false}], recursive := true) FROM b),
k AS (SELECT lang, source, metric, CASE WHEN v < 32 THEN v ELSE (length(bin(v)) - 5) * 16 + (v >> (length(bin(v)) - 5)) END AS b, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
f AS (SELECT *, CASE WHEN b < 32 THEN b ELSE (b - (b - 16) // 16 * 16) * (1::BIGINT << ((b - 16) // 16)) END AS low FROM k),
q1 AS (SELECT lang, source, metric, low, sum(n) OVER o AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM f WINDOW o AS (PARTITION BY lang, source, metric ORDER BY b)),
own AS (SELECT lang, source, metric, max(total) AS n, min(low) FILTER (4 * upto >= total) AS a, min(low) FILTER (4 * upto >= 3 * total) AS c FROM q1 GROUP BY ALL),
q2 AS (SELECT lang, metric, low, sum(n) OVER o AS upto, sum(n) OVER (PARTITION BY lang, metric) AS total FROM f WINDOW o AS (PARTITION BY lang, metric ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lng AS (SELECT lang, metric, max(total) AS n, min(low) FILTER (4 * upto >= total) AS a, min(low) FILTER (4 * upto >= 3 * total) AS c FROM q2 GROUP BY ALL),
q3 AS (SELECT metric, low, sum(n) OVER o AS upto, sum(n) OVER (PARTITION BY metric) AS total FROM f WINDOW o AS (PARTITION BY metric ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
whl AS (SELECT metric, max(total) AS n, min(low) FILTER (4 * upto >= total) AS a, min(low) FILTER (4 * upto >= 3 * total) AS c FROM q3 GROUP BY ALL),
u AS (SELECT own.lang, own.source, own.metric, CASE WHEN own.n >= 100 THEN own.a WHEN lng.n >= 100 THEN lng.a ELSE whl.a END AS a, CASE WHEN own.n >= 100 THEN own.c WHEN lng.n >= 100 THEN lng.c ELSE whl.c END AS c
  FROM own JOIN lng ON own.lang IS NOT DISTINCT FROM lng.lang AND own.metric = lng.metric JOIN whl ON own.metric = whl.metric),
j AS (SELECT v.rid, list(v.metric ORDER BY list_position(['word_len', 'symbol_rate', 'dup_line_rate', 'repeat_rate'], v.metric)) FILTER (v.v > u.c + greatest(4 * (u.c - u.a), slack) OR v.v < CASE WHEN two THEN u.a - greatest(4 * (u.c - u.a), slack) ELSE 0 END) AS off
  FROM v LEFT JOIN u ON v.lang IS NOT DISTINCT FROM u.lang AND v.source IS NOT DISTINCT FROM u.source AND v.metric = u.metric GROUP BY v.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND off IS NULL AS kept, array_to_string(list_concat(CASE WHEN base_failed THEN ['base'] ELSE [] END, coalesce(off, [])), ',') AS reasons FROM b JOIN j USING (rid)
"""

OP11_SQL = """
WITH r AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
p AS (SELECT * FROM (SELECT anchor, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor, place ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op11_hard_negatives": OP11_SQL}
