"""SimHash near-duplicates of documents by bit-sliced comparison.

`near_duplicates` links fingerprints at few differing bits. `keep_one` takes one
document of each group of texts whose sets of shingles are similar: candidates
come from a longer SimHash by the same comparison and are verified by the sets.

Words of the text (A-Z in lower case) form shingles of `width` words, repeats
included; a bit of the 64-bit fingerprint is set if it is in over half of the
shingles' XXH64 values. Documents are grouped by fingerprint first, so exact
copies cost one fingerprint however many there are; distinct fingerprints are
linked by `bitslice.links`, and components of the links are the groups.

Rows: null texts and texts without a word have fingerprint zero and link like
any other; ties in votes leave the bit 0; repeated rows stay and share a group; a
null doc_id is never the smallest unless all are null; an empty table gives an
empty result. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.bitslice import close_pairs, links, stars, whole_buckets
from panelweave.llm.common import broadcast_if_small, components, settle


def shingles(text: bytes, width: int) -> list[bytes]:
    """Shingles of the text's words, repeats included; of all words if they are fewer."""
    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    return [line[a:b] for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)]


def votes(found: list[bytes], digest, bits: int, part: int = 200_000) -> np.ndarray:
    """Bits set in over half of the shingles' digests, packed; voted in parts."""
    total = np.zeros(bits, np.int64)
    for i in range(0, len(found), part):
        digests = b"".join([digest(x) for x in found[i : i + part]])
        total += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, bits // 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(found))


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of one text as an unsigned number."""
    from xxhash import xxh64_digest

    return int.from_bytes(votes(shingles(text, width), lambda x: xxh64_digest(x, seed), 64).tobytes(), "big")


def with_fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), th (a hash of the text) of every row."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint((t or "").encode(), width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "th", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("th"))
    return rows.mapInArrow(run, f"doc_id {kind}, th long, fp long")


def groups(documents: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, th, fp, component_id of every document."""
    prints = settle(with_fingerprints(documents, width), "fingerprints")
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), radius, radius + 2), "fingerprint-links")
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = named.select("fp", "root").join(lowest, "root").select(F.col("fp").alias("_fp"), "component_id", "root")
    return prints.join(ids, F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicates(documents: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    found = groups(documents, width, radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")




# Groups by the similarity of the texts: SimHash finds candidates, which are verified.


PRINT = ["f0", "f1", "f2", "f3"]
COMPARED = 128  # bits that are compared; keys are drawn from all


def long_print(text: bytes, width: int) -> np.ndarray:
    """256-bit SimHash of the text's set of shingles, packed."""
    from xxhash import xxh3_128_digest

    return votes(list(set(shingles(text, width))), lambda x: xxh3_128_digest(x) + xxh3_128_digest(x, 1), 64 * len(PRINT))


def long_prints(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, th and a 256-bit SimHash, in four longs, of every row's set of shingles."""

    def run(batches):
        for batch in batches:
            prints = [long_print((t or "").encode(), width) for t in batch.column(1).to_pylist()]
            f = np.concatenate([*prints, np.zeros(0, np.uint8)]).view(np.int64).reshape(-1, len(PRINT))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(x) for x in f.T]], ["doc_id", "th", *PRINT])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("th"))
    return rows.mapInArrow(run, f"doc_id {kind}, th long, " + ", ".join(f"{f} long" for f in PRINT))


def spread(bits: int, agree: float) -> list[float]:
    """Chance of each distance of two prints that agree on a bit with chance `agree`."""
    return [math.comb(bits, d) * (1 - agree) ** d * agree ** (bits - d) for d in range(bits + 1)]


def search_plan(n: int, similarity: float, recall: float) -> tuple[int, int, int]:
    """(bits of a key, number of keys, radius) for n texts.

    Texts of shingle similarity s have a cosine of 2 s / (1 + s) or more and agree
    on each bit with chance 1 - angle / pi. Keys are as long as leaves some 64
    texts to a bucket, which are compared at once. All keys of a pair depend on
    its distance d: each is shared with chance C(all - d, bits) / C(all, bits).
    They are as many as find a pair of just the similarity with chance `recall`
    over the distances it can have, whatever n is (closer pairs more surely);
    the radius, 4 deviations above the mean distance, is counted as a loss too.
    """
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = min(30, max(8, round(math.log2(max(n, 2))) - 6))
    radius = math.floor(COMPARED * (1 - agree) + 4 * math.sqrt(COMPARED * agree * (1 - agree)))
    lost = sum(spread(COMPARED, agree)[radius + 1 :])
    width = 64 * len(PRINT)
    chance, shared = spread(width, agree), [math.comb(width - d, bits) / math.comb(width, bits) for d in range(width + 1)]
    missed = lambda tables: lost + sum(c * (1 - p) ** tables for c, p in zip(chance, shared, strict=True))
    low, high = 0, 1
    while missed(high) > 1 - recall:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if missed(middle) <= 1 - recall else (middle, high)
    return bits, high, radius


def key_masks(bits: int, tables: int) -> list[list[int]]:
    """The bits of each key, as a mask for each word of a print."""
    rng = random.Random(128)
    drawn = [rng.sample(range(64 * len(PRINT)), bits) for _ in range(tables)]
    return [[sum(1 << b % 64 for b in key if b // 64 == k) for k in range(len(PRINT))] for key in drawn]


def _candidates(radius: int):
    def run(batches):
        for key, f0, f1, th in whole_buckets(batches, 4):
            prints = np.stack([f0, f1], 1).astype(np.int64).view(np.uint64)
            root = stars(len(th), close_pairs(key, prints, radius))
            linked = np.flatnonzero(root != np.arange(len(th)))
            yield pa.RecordBatch.from_arrays([pa.array(th[linked]), pa.array(th[root[linked]])], ["a", "b"])

    return run


def candidate_links(nodes: DataFrame, n: int, similarity: float, recall: float) -> DataFrame:
    """Edges between texts (th and print) that share a key and lie within the radius."""
    bits, tables, radius = search_plan(n, similarity, recall)
    keys = []
    for t, masks in enumerate(key_masks(bits, tables)):
        held = [F.col(f).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for f, m in zip(PRINT, masks, strict=True) if m]
        keys.append(F.xxhash64(F.lit(t), *held))
    rows = nodes.select(F.explode(F.array(*keys)).alias("key"), "f0", "f1", "th")
    links = rows.repartition("key").sortWithinPartitions("key", "th").mapInArrow(_candidates(radius), "a long, b long")
    # a text has a link for each key at most; its links become one, and those of its other ends to the same end
    ends = links.groupBy("a").agg(F.collect_set("b").alias("ends")).withColumn("b", F.array_min("ends"))
    return ends.select(F.explode(F.concat(F.array("a"), "ends")).alias("a"), "b").filter("a <> b").distinct()


def _alike(width: int, similarity: float):
    """Edges between texts of a group whose sets of shingles are as similar."""

    def sets(text: str) -> np.ndarray:
        from xxhash import xxh64_intdigest

        return np.unique(np.array([xxh64_intdigest(x) for x in shingles(text.encode(), width)], np.uint64))

    def run(batches):
        held: list[tuple[int, int, np.ndarray]] = []
        group = None
        for batch in batches:
            for at, side, th, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != group:
                    yield from edges(held)
                    group, held = at, []
                held.append((side, th, sets(text or "")))
        yield from edges(held)

    def edges(held):
        root, found = list(range(len(held))), []
        crossing = bool(held) and held[0][0] != held[-1][0]  # two tiles meet; each has a group of its own

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for j, (side, th, mine) in enumerate(held):
            for i in range(j):
                if top(i) == top(j) or (crossing and held[i][0] == side):
                    continue
                other = held[i][2]
                few, many = sorted((len(mine), len(other)))
                if few < similarity * many:
                    continue
                both = len(np.intersect1d(mine, other, assume_unique=True)) if few else 0
                if (both >= similarity * (few + many - both)) if many else True:
                    found.append((th, held[i][1]))
                    root[top(j)] = top(i)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return run


def similar_groups(documents: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.99, tile: int = 1000) -> DataFrame:
    """(th, root, keeper): every distinct text, its group and the row that stays.

    Equal texts are one node. Bit-sliced comparison in buckets links candidates;
    a candidate component is verified by the texts' own sets of shingles, in
    tiles: members are dealt into tiles of about `tile`, and every two tiles of
    a component meet in one group, so no task holds more than two tiles.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    prints = long_prints(documents, width)
    nodes = settle(prints.groupBy("th").agg(*[F.min(f).alias(f) for f in PRINT], F.min(order).alias("first")), "texts")
    near = components(candidate_links(nodes.select("th", *PRINT), nodes.count(), similarity, recall), "near-texts")
    near = settle(near, "candidates")
    size = near.groupBy("root").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = near.join(size, "root").join(nodes.select(F.col("th").alias("node"), F.col("first.id").alias("_id")), "node")
    side = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = settle(dealt.select("root", "tiles", side.alias("side"), F.col("node").alias("_th"), "_id"), "tiles")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th"))
    texts = documents.select("doc_id", "text").join(broadcast_if_small(dealt, dealt.count(), 200_000), same)
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.xxhash64("root", F.least("side", o), F.greatest("side", o)))
    rows = texts.select(F.explode(pairs).alias("group"), "side", "_th", "text").repartition("group").sortWithinPartitions("group", "side", "_th")
    links_of = components(rows.mapInArrow(_alike(width, similarity), "a long, b long"), "similar-texts")
    named = nodes.join(links_of, F.col("th") == F.col("node"), "left").select("th", "first", F.coalesce("root", "th").alias("root"))
    stays = named.groupBy("root").agg(F.min(F.struct("first", "th")).alias("keeper"))
    return named.select("th", "root").join(stays, "root")


def keep_one(documents: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Documents without all but one of each group: the smallest id stays (null
    last), of equal ids the smallest text hash, of equal rows any one."""
    found = similar_groups(documents, width, similarity).select("keeper").distinct()
    kept = settle(found.select(F.col("keeper.first.id").alias("_id"), F.col("keeper.th").alias("_th")), "keepers")
    same = documents["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(documents["text"]) == kept["_th"])
    rows = documents.join(kept, same, "left_semi")
    keys = documents.select("doc_id", F.xxhash64("text").alias("th"))
    if keys.groupBy("doc_id", "th").count().filter("count > 1").isEmpty():
        return rows
    packed = rows.select("doc_id", F.xxhash64("text").alias("th"), F.struct("*").alias("row"))
    return packed.dropDuplicates(["doc_id", "th"]).select("row.*")
