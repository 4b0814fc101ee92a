"""Language identification by bit-sliced Bloom filters of character n-grams.

Training counts the hashed 4-grams of every labelled text per language. An
n-gram belongs to every language in which its frequency is at least `share` of
its highest frequency in any language, and to none if seen under `least` times.
One table holds a Bloom filter per language, sliced by bit: its cell is a word
with one bit for each language, so ANDing the cells of an n-gram's two hashes
returns the set of all languages that contain it. A text is decided by the
number of its n-grams in each language, from which the share expected of false
positives (fill squared) is taken off.

Rows: null languages are not learned from; null texts and texts without a letter
are `und` with score 0; ties go to the first language by name; a text whose
n-grams are all unknown gets the first language with score 0; repeated rows
count and are predicted alike; without training rows all are `und`; an empty
table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import crc_remainder, settle, slices
from panelweave.llm.grams import hashed, letter_codes

ORDER, SLOT_BITS, CELL_BITS, HASHES = 4, 22, 21, 2


def cells(slot: np.ndarray) -> list[np.ndarray]:
    """Cell numbers of a slot, one for each hash."""
    found = []
    for k in range(HASHES):
        h = (slot.astype(np.uint64) + np.uint64(k + 1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        found.append((h >> np.uint64(64 - CELL_BITS)).astype(np.int64))
    return found


def _count(langs: list[str]):
    """Occurrences of each slot in each language, merged within the task."""
    number = {name: i for i, name in enumerate(langs)}

    def merged(parts):
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

    def rows(keys, n):
        for i in range(0, len(keys), 100_000):
            k = keys[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k >> SLOT_BITS), pa.array(k & ((1 << SLOT_BITS) - 1)), pa.array(n[i : i + 100_000])], ["lang", "slot", "n"])

    def run(batches):
        parts = []
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                codes, offsets, _ = letter_codes(texts[a:b])
                row, slot = hashed(codes, offsets, ORDER, SLOT_BITS)
                parts.append(np.unique(lang[a:b][row] << SLOT_BITS | slot, return_counts=True))
                if len(parts) >= 16:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > 4_000_000:  # keeps the task's memory bounded
                        yield from rows(*parts.pop())
        if parts:
            yield from rows(*merged(parts))

    return run


class Filters:
    """Languages by name, the table of cells, the share of cells set for each."""

    def __init__(self, langs: list[str], bits: np.ndarray, slot: np.ndarray):
        """`bits`: a row for each slot, a bit for each language that contains it."""
        self.langs = langs
        self.table = np.zeros((1 << CELL_BITS, max(1, -(-len(langs) // 64))), np.uint64)
        for where in cells(slot):
            for w in range(bits.shape[1]):
                np.bitwise_or.at(self.table[:, w], where, bits[:, w])
        self.fill = np.array([(self.table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(langs))])

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        known = [t or "" for t in texts]
        for a, b in slices(known):
            codes, offsets, has = letter_codes(known[a:b])
            row, slot = hashed(codes, offsets, ORDER, SLOT_BITS)
            first, *rest = cells(slot)
            sets = self.table[first]
            for where in rest:
                sets &= self.table[where]
            total = np.bincount(row, minlength=b - a)
            hits = np.zeros((b - a, max(1, len(self.langs))))
            for i, fill in enumerate(self.fill):
                false = fill**HASHES
                n = np.bincount(row, (sets[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1), b - a)
                hits[:, i] = np.maximum(0, (n - total * false) / max(1e-9, 1 - false))
            best = hits.argmax(1)
            ok = has & (len(self.langs) > 0)
            names += [self.langs[k] if good else "und" for k, good in zip(best, ok, strict=True)]
            scores.append(np.where(ok, hits.max(1) / np.maximum(hits.sum(1), 1e-9), 0.0))
        return names, np.concatenate([*scores, np.zeros(0)])


def learn(documents: DataFrame, share: float = 0.25, least: int = 5) -> Filters:
    """Filters from rows outside the held-out third with a language and a text.

    What reaches the driver is bounded: for each of the 2**SLOT_BITS slots a bit for
    each language, packed into words of 64 languages. With every slot in use and 64
    languages or fewer that is 64 MB; the filter itself has 2**CELL_BITS words.
    """
    rows = documents.filter((crc_remainder(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not langs:
        return Filters([], np.zeros((0, 1), np.uint64), np.zeros(0, np.int64))
    counts = rows.select("lang", "text").mapInArrow(_count(langs), "lang long, slot long, n long")
    counts = settle(counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")), "language-counts")
    total = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    of_lang = F.element_at(F.create_map(*[F.lit(x) for pair in total.items() for x in pair]), F.col("lang"))
    rate = counts.filter(F.col("n") >= least).withColumn("rate", F.col("n") / of_lang)
    most = rate.groupBy("slot").agg(F.max("rate").alias("most"), F.collect_list(F.struct("rate", "lang")).alias("all"))
    kept = F.filter("all", lambda x: x["rate"] >= share * F.col("most"))

    def word(w: int):  # the bits of languages 64 w to 64 w + 63
        none = F.lit(0).cast("long")
        bit = lambda x: F.when(F.floor(x["lang"] / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (x["lang"] % 64).cast("int"))).otherwise(none)
        return F.aggregate(kept, none, lambda bits, x: bits.bitwiseOR(bit(x))).alias(f"w{w}")

    words_of = [word(w) for w in range(-(-len(langs) // 64))]
    held = most.select(F.col("slot").cast("int").alias("slot"), *words_of).toPandas()
    bits = held.drop(columns="slot").to_numpy(np.int64).view(np.uint64)
    return Filters(langs, bits, held.slot.to_numpy(np.int64))


def identify(documents: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            names, scores = shared.value.decide(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def classify(documents: DataFrame) -> DataFrame:
    found = identify(documents, learn(documents))
    return found.select("doc_id", (crc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
