"""Benchmark decontamination by spaced seeds.

A seed mask keeps some of the words in a window and ignores the others, so a
window's hash is unmoved by substitutions at ignored places. The masks' hashes
of all benchmark windows are matched with those of every window of every
document; each hit puts an item at one place over the document, where aligned
words are compared one by one. The longest stretch in which the share of equal
words is `identity` or more must reach `overlap` words, or all of a shorter item.
An item and a row that share very many seeds, because few words repeat in both, are
compared at every place instead, longest overlaps first, and give their longest
stretch alone; all others give every place. Words are runs of ASCII letters and digits
and non-ASCII characters, in lower case, so marks and layout play no part. Items
shorter than a mask are looked up by all their words.

Equal items are looked for once. The different texts are sent to the executors in
blocks of `block_items` items and `item_words` words at most, and every block
meets all documents in one pass over them. So what is broadcast is bounded, and a
pass costs as much as reading; a benchmark of ten million words takes five.

Rows: null and empty texts and items match nothing; repeated items are reported
each, repeated documents too; empty tables give an empty result; further columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import broadcast_if_small, settle, utf8
from panelweave.llm.wordhash import parts, words

#: Windows of 7 to 10 words of which 5 are compared.
#: Pairs of equal seeds for each word of an item and a row above which pairs are not listed.
DENSE = 8
MASKS = ("1101011", "11100101", "101100011", "1100010101")


def mask_hash(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the kept words of every window; none if there are fewer words."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, len(mask), np.uint64)
    for k, kept in enumerate(mask):
        if kept == "1":
            total = (total ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(32)
    return total


@dataclass
class Items:
    """Words of a block of items in one array, and its seeds by mask."""

    ids: list
    flat: np.ndarray
    begin: np.ndarray
    seeds: dict[str, tuple[np.ndarray, ...]]  # mask -> hashes in order, item, first of its places, their number; places in flat

    @staticmethod
    def of(rows: list[tuple[object, str]]) -> Items:
        ids, hashes = [], []
        for item, text in rows:
            column = pa.array([text or ""])
            h, _, _ = words(*utf8(column))
            if len(h):
                ids.append(item)
                hashes.append(h)
        begin = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int64)
        by_mask: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        longest = max(map(len, MASKS))
        for i, h in enumerate(hashes):
            for mask in MASKS if len(h) >= longest else ["1" * len(h)]:
                found = mask_hash(h, mask)
                by_mask.setdefault(mask, []).append((found, begin[i] + np.arange(len(found))))
        seeds = {}
        for mask, found in by_mask.items():
            hashes_of = np.concatenate([x for x, _ in found])
            places = np.concatenate([x for _, x in found])
            order = np.argsort(hashes_of, kind="stable")  # places of an item stay in order
            hashes_of, places = hashes_of[order], places[order]
            item = np.searchsorted(begin, places, "right") - 1
            first = np.flatnonzero(np.append(True, (hashes_of[1:] != hashes_of[:-1]) | (item[1:] != item[:-1]))[: len(places)])
            seeds[mask] = hashes_of[first], item[first], first, np.diff(np.append(first, len(places))), places
        return Items(ids, np.concatenate([*hashes, np.zeros(0, np.uint64)]), begin, seeds)

    def hits(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place of the item's first word in h, row) of every seed hit, each
        once, and (item, row) of those that share more than `DENSE` pairs of equal
        seeds for each of their words, as texts of few words do: theirs are not listed."""
        found, dense = [], [np.zeros((0, 2), np.int64)]
        size, length = np.diff(self.begin), np.bincount(row)
        small = np.zeros(1 << 20, bool)
        for mask, (seeds, item, first, count, places) in self.seeds.items():
            windows = mask_hash(h, mask)
            same = row[: len(windows)] == row[len(mask) - 1 : len(mask) - 1 + len(windows)]
            small[:] = False
            small[seeds >> np.uint64(44)] = True
            at = np.flatnonzero(small[windows >> np.uint64(44)] & same)
            at = at[np.lexsort((at, windows[at], row[at]))]
            of, where = windows[at], row[at]
            group = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (where[1:] != where[:-1]))[: len(at)])
            many = np.diff(np.append(group, len(at)))  # places of a hash in a row
            low = np.searchsorted(seeds, of[group], "left")
            n = np.searchsorted(seeds, of[group], "right") - low
            g = np.repeat(np.arange(len(group)), n)
            s = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(g))  # items with that hash
            pairs = many[g] * count[s]
            key, pair = np.unique(item[s] * (len(length) + 1) + where[group[g]], return_inverse=True)
            own, of_row = np.divmod(key, len(length) + 1)
            over = np.bincount(pair, pairs, len(key)) > DENSE * (size[own] + length[of_row]) if len(key) else np.zeros(0, bool)
            dense.append(np.stack([own[over], of_row[over]], 1))
            g, s, pairs = (x[~over[pair]] for x in (g, s, pairs))
            which = np.repeat(np.arange(len(g)), pairs)
            k = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            a, b = np.divmod(k, count[s[which]])
            here, there = at[group[g[which]] + a], places[first[s[which]] + b]
            found.append(np.stack([item[s[which]], here - (there - self.begin[item[s[which]]]), row[here]], 1))
        every = np.unique(np.concatenate([*found, np.zeros((0, 3), np.int64)]), axis=0)
        return every, np.unique(np.concatenate(dense), axis=0)

    def overlaps(self, h: np.ndarray, row: np.ndarray, overlap: int, identity: float):
        """(row, item id, first word in the row, words, equal words) of verified places;
        of an item and a row with many equal seeds the longest alone."""
        hits, dense = self.hits(h, row)
        listed = {tuple(d) for d in dense.tolist()}

        def at(item, start, r):
            mine = self.flat[self.begin[item] : self.begin[item + 1]]
            a, b = np.searchsorted(row, r, "left"), np.searchsorted(row, r, "right")
            low, high = max(start, a), min(start + len(mine), b)
            equal = h[low:high] == mine[low - start : high - start]
            x, y = longest_stretch(equal, identity)
            n, same = y - x, int(equal[x:y].sum())
            return (int(r), self.ids[item], int(low + x - a), n, same) if n >= min(overlap, len(mine)) else None

        for item, start, r in hits.tolist():
            if (item, r) not in listed and (found := at(item, start, r)):
                yield found
        for item, r in dense.tolist():
            a, b = int(np.searchsorted(row, r, "left")), int(np.searchsorted(row, r, "right"))
            size = int(self.begin[item + 1] - self.begin[item])
            starts = np.arange(a - size + 1, b)
            reach = np.minimum(starts + size, b) - np.maximum(starts, a)  # words side by side
            best = None
            for k in np.argsort(-reach, kind="stable").tolist():
                if best and reach[k] <= best[3]:
                    break
                found = at(item, int(starts[k]), r)
                if found and (best is None or found[3] > best[3]):
                    best = found
            if best:
                yield best


def longest_stretch(equal: np.ndarray, identity: float) -> tuple[int, int]:
    """Longest stretch in which the share of equal words is `identity` or more."""
    whole = round(1000 * identity)
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1000 - whole, -whole))])
    lowest = np.minimum.accumulate(sums)
    begin = np.searchsorted(-lowest, -sums)  # first place with a sum as low
    end = int((np.arange(len(sums)) - begin).argmax())
    return int(begin[end]), end


def _blocks(texts: DataFrame, block_items: int, item_words: int):
    """Lists of (key, text) of different texts, each of `block_items` items and
    `item_words` words at most; a longer text is a block of its own."""
    weight = F.size(F.split("text", " ")).cast("long")
    n, total = texts.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    parts = 16 * max(1, -(-n // block_items), -(-total // item_words))
    part = F.pmod(F.xxhash64("key"), F.lit(parts))
    sizes = texts.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(weight).alias("words")).orderBy("part").collect()  # 16 rows a block
    held: list[int] = []
    items = words_in = 0
    for row in [*sizes, None]:
        if held and (row is None or items + row.n > block_items or words_in + row.words > item_words):
            block = texts.filter(part.isin(held)).collect() if len(sizes) > len(held) else texts.collect()
            for i in range(0, len(block), block_items):
                yield [(r.key, r.text) for r in block[i : i + block_items]]
            held, items, words_in = [], 0, 0
        if row is not None:
            held.append(row.part)
            items, words_in = items + row.n, words_in + row.words


def overlaps(documents: DataFrame, texts: DataFrame, overlap: int, identity: float, block_items: int, item_words: int) -> DataFrame:
    """doc_id, th (a hash of the text), key, first_word, n_words, n_equal: a row for
    each text of `texts` (key, text) and place in a document that overlap."""
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("th"))
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, th long, key long, first_word long, n_words long, n_equal long"
    found = documents.sparkSession.createDataFrame([], schema)
    for block in _blocks(texts, block_items, item_words):
        shared = documents.sparkSession.sparkContext.broadcast(Items.of(block))

        def run(batches, shared=shared):
            for batch in batches:
                data, offsets = utf8(batch.column(1))
                for a, b in parts(data, offsets):
                    h, _, row = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    hits = list(shared.value.overlaps(h, row, overlap, identity))
                    if hits:
                        take = pa.array([a + x[0] for x in hits])
                        rest = [pa.array(x, pa.int64()) for x in zip(*[x[1:] for x in hits], strict=True)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), *rest], ["doc_id", "th", "key", "first_word", "n_words", "n_equal"])

        found = found.unionByName(rows.mapInArrow(run, schema))
    return found


def different_texts(benchmark: DataFrame) -> DataFrame:
    """(key, text) of the benchmark's texts, each once; the key is a hash of the text."""
    rows = benchmark.select(F.xxhash64("text").alias("key"), "text").filter("text <> ''")
    return settle(rows.dropDuplicates(["key"]), "benchmark-texts")


def matches(documents: DataFrame, benchmark: DataFrame, overlap: int = 12, identity: float = 0.8, block_items: int = 20_000, item_words: int = 2_000_000) -> DataFrame:
    """doc_id, th (a hash of the text), item_id, first_word, n_words, n_equal: a
    row for each item and place in a document that overlap."""
    found = overlaps(documents, different_texts(benchmark), overlap, identity, block_items, item_words)
    ids = settle(benchmark.select("item_id", F.xxhash64("text").alias("_key")).filter("text <> ''"), "benchmark-ids")
    joined = found.join(broadcast_if_small(ids, ids.count()), F.col("key") == F.col("_key"))
    return joined.select("doc_id", "th", "item_id", "first_word", "n_words", "n_equal")


def clean(documents: DataFrame, benchmark: DataFrame, overlap: int = 12, identity: float = 0.8, block_items: int = 20_000, item_words: int = 2_000_000) -> DataFrame:
    """Documents without those that overlap a benchmark item."""
    found = overlaps(documents, different_texts(benchmark), overlap, identity, block_items, item_words)
    hits = settle(found.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), "leaks")
    same = documents["doc_id"].eqNullSafe(hits["_id"]) & (F.xxhash64(documents["text"]) == hits["_th"])
    n = hits.count()
    return documents.join(F.broadcast(hits) if n <= 50_000 else hits, same, "left_anti")
