"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes
log-count ratios.

Features are the hashed 4- to 6-grams present in a text (lower case, all but
letters as spaces). From labelled texts the log-count ratio of each n-gram,
log((p + 1) / (P + 2)) - log((n + 1) / (N + 2)) over texts that hold it, is
counted by a Spark aggregate; the `features` n-grams that differ most between
the classes by a two-sample test are kept and a logistic regression is fitted on
presence times ratio. The bound on the labelled rows is `per_class` of either
class, those with the lowest hash of their id; the intercept is then set back to
the classes' true shares.

Rows: labels that are null are left out, a document labelled more than once is
toxic if one label says so; null and empty texts have no feature and get the
score of the intercept; repeated rows are scored alike; with no labels of one
class every score is 0 or 1 as that class says (to 1e-20; 0 without labels); an empty table
gives an empty result. Further columns of the inputs are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import crc_remainder, settle, slices
from panelweave.llm.grams import hashed, letter_codes

ORDERS = (4, 5, 6)
BITS = 21


def present(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) pairs, each once, of the n-grams that the texts hold; of the
    slots for which `wanted` is true, where given."""
    codes, offsets, _ = letter_codes(texts)
    parts = []
    for n in ORDERS:
        row, slot = hashed(codes, offsets, n, BITS)
        if wanted is not None:
            held = np.flatnonzero(wanted[slot])
            row, slot = row[held], slot[held]
        parts.append(row.astype(np.int64) << BITS | slot)
    pairs = np.sort(np.concatenate(parts))
    pairs = pairs[np.diff(pairs, prepend=-1) > 0]
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _count(batches):
    """Texts of either class that hold each slot, summed over the task."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        toxic, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for a, b in slices(texts):
            row, slot = present(texts[a:b])
            for y in (0, 1):
                counts[y] += np.bincount(slot[toxic[a:b][row] == y], minlength=1 << BITS).astype(np.int32)
    held = np.flatnonzero(counts.any(0))
    for part in np.array_split(held, len(held) // 100_000 + 1):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, counts[1, part].astype(np.int64), counts[0, part].astype(np.int64))], ["slot", "p", "n"])


def _features(slots: np.ndarray):
    """(toxic, n, held): for each batch of texts, their labels, how many features
    each holds, and the features' numbers one text after another, in bytes."""

    def run(batches):
        where = np.full(1 << BITS, -1, np.int32)
        where[slots] = np.arange(len(slots))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts, held = [], []
            for a, b in slices(texts):
                row, slot = present(texts[a:b], where >= 0)
                counts.append(np.bincount(row, minlength=b - a).astype(np.int32))
                held.append(where[slot].astype(np.uint16))
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int8)
            columns = [np.concatenate(x).tobytes() for x in ([y], [*counts, np.zeros(0, np.int32)], [*held, np.zeros(0, np.uint16)])]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in columns], ["toxic", "n", "held"])

    return run


def logistic(counts: np.ndarray, columns: np.ndarray, ratio: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 300, part: int = 500_000) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps on the ridge log-loss.

    Row i holds the next `counts[i]` of `columns`, each with the value of its
    column in `ratio`. Sums go over some `part` entries at a time, so beside the
    columns themselves nothing is held for every entry.
    """
    n, width = len(y), len(ratio)
    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + part, part)).clip(0, n))

    def each():
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield a, b, np.repeat(np.arange(b - a), counts[a:b]), columns[ends[a] : ends[b]]

    def times(w):
        scaled, out = ratio * w, np.zeros(n)
        for a, b, row, column in each():
            out[a:b] = np.bincount(row, scaled[column], b - a)
        return out

    def back(g):
        out = np.zeros(width)
        for a, b, row, column in each():
            out += np.bincount(column, g[a:b][row], width)
        return ratio * out

    v = np.ones(width)
    for _ in range(15):  # largest eigenvalue of X'X, for the step
        v = back(times(v))
        top = np.linalg.norm(v) or 1.0
        v /= top
    step = 1 / (0.25 * (top / n + 1) + ridge)
    w = last = np.zeros(width + 1)
    for k in range(rounds):
        z = w + (k / (k + 3)) * (w - last)
        g = 1 / (1 + np.exp(-np.clip(times(z[:-1]) + z[-1], -30, 30))) - y
        gradient = np.append(back(g) / n + ridge * z[:-1], g.mean())
        last, w = w, z - step * gradient
    return w[:-1], float(w[-1])


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 12_000, features: int = 4096) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, intercept) learned from labelled rows outside the held-out
    fifth; 65,536 features at most, so that each is a number of two bytes."""
    if features > 1 << 16:
        raise ValueError("65,536 features at most")
    marks = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.filter(crc_remainder(F.col("doc_id"), 5) != 0)
    share = marks.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    if not share.n or share.p in (0, share.n):
        p = (share.p or 0) / (share.n or 1)
        return np.zeros(0, np.int64), np.zeros(0), 50.0 if p == 1 else -50.0
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = marks.filter("toxic = 1").orderBy(*order).limit(per_class).unionByName(marks.filter("toxic = 0").orderBy(*order).limit(2 * per_class))
    drawn = settle(drawn.select(F.col("doc_id").alias("_id"), "toxic"), "toxic-rows")  # 3 * per_class rows at most
    texts = documents.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("toxic", F.coalesce("text", F.lit("")).alias("text"))
    texts = settle(texts, "toxic-texts")
    sizes = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p_all, n_all = sizes.get(1, 0), sizes.get(0, 0)
    if not p_all or not n_all:
        return np.zeros(0, np.int64), np.zeros(0), math.log((share.p + 0.5) / (share.n - share.p + 0.5))
    texts = texts.repartition(max(1, min(64, (p_all + n_all) // 500)))
    counts = texts.mapInArrow(_count, "slot long, p long, n long").groupBy("slot").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    rate = (F.col("p") + F.col("n")) / (p_all + n_all)
    gap = (F.col("p") / p_all - F.col("n") / n_all) / F.sqrt(rate * (1 - rate) + 1e-6)
    best = counts.filter("p + n >= 3").withColumn("gap", F.abs(gap)).orderBy(F.desc("gap"), "slot").limit(features).collect()
    slots = np.array([r.slot for r in best], np.int64)
    ratio = np.array([math.log((r.p + 1) / (p_all + 2)) - math.log((r.n + 1) / (n_all + 2)) for r in best])
    held = texts.mapInArrow(_features(slots), "toxic binary, n binary, held binary").collect()
    y, counts, columns = (np.concatenate([np.frombuffer(r[k], kind) for r in held]) for k, kind in enumerate((np.int8, np.int32, np.uint16)))
    del held
    weights, intercept = logistic(counts, columns, ratio, y.astype(float))
    intercept += math.log(share.p / (share.n - share.p)) - math.log(p_all / n_all)
    return slots, weights * ratio, intercept


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """All columns of `documents` but the text, with `toxicity` from 0 to 1."""
    slots, weights, intercept = model
    at = documents.columns.index("text")

    def run(batches):
        table = np.zeros(1 << BITS)
        table[slots] = weights
        wanted = table != 0
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            total = []
            for a, b in slices(texts):
                row, slot = present(texts[a:b], wanted)
                total.append(np.bincount(row, table[slot], b - a))
            z = np.concatenate([*total, np.zeros(0)]) + intercept
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=names)

    names = [c for c in documents.columns if c != "text"] + ["toxicity"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name != "text"]
    return documents.mapInArrow(run, ", ".join([*fields, "toxicity double"]))


def classify(documents: DataFrame, labels: DataFrame, per_class: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(documents.select("doc_id", "text"), fit(documents, labels, per_class))
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
