"""Hamming neighbours within buckets by bit-sliced comparison, and the Spark
stage that finds them among distinct 64-bit fingerprints.

Fingerprints of a bucket are stored vertically: plane b holds bit b of 64
fingerprints in each machine word. Comparing one fingerprint with 64 others is
one XOR a plane; the distances of all 64 are kept in bitwise counters, a
carry-save adder of as many planes as the radius needs with a sticky overflow.
After every 8 planes the blocks of 64 whose distances all exceed the radius are
abandoned.

Buckets: the 64 bits are cut into blocks. Fingerprints at `radius` differing
bits or fewer agree on at least blocks - radius of them, so each combination of
that many blocks, with their bits, is a key, and any linked pair shares a key.
A key that holds more than `hot` fingerprints is cut again: its remaining bits
go into radius + 1 blocks, of which the pair must share one.

`packed_buckets` is the form for many keys of random bits: a task packs its
prints by key into arrays, so that a key costs the shuffle the bytes of a print
instead of a row.
"""

from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import broadcast_if_small, settle

ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above the radius."""
    above, equal = over.copy(), ~over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def close_pairs(bucket: np.ndarray, prints: np.ndarray, radius: int, most: int = 1 << 16):
    """Yield (i, j), i < j: rows of one bucket at `radius` bits or fewer. Rows are
    sorted by bucket; `most` blocks of 64 are compared at a time. Fingerprints
    are words of 64 bits, or rows of several words."""
    prints = prints.reshape(len(bucket), -1)
    edge = np.append(np.diff(bucket, prepend=bucket[:1]) != 0, True)[: len(bucket) + 1]
    edge[:1] = True
    shared = np.flatnonzero(~(edge[:-1] & edge[1:]))  # rows that are not alone in their bucket
    if len(shared) < len(bucket):
        for i, j in close_pairs(bucket[shared], prints[shared], radius, most) if len(shared) else ():
            yield shared[i], shared[j]
        return
    n, width = prints.shape
    first = np.flatnonzero(np.diff(bucket, prepend=~bucket[:1]) != 0)
    size = np.diff(np.append(first, n))
    at = np.arange(n) - np.repeat(first, size)  # place within the bucket
    lane = (at % 64).astype(np.uint64)
    words = -(-size // 64)  # of each bucket
    base = np.concatenate([[0], np.cumsum(words)])
    word = np.repeat(base[:-1], size) + at // 64
    head = np.flatnonzero(at % 64 == 0)  # first row of each word
    if not n:
        return
    bit = lambda of, b: of[:, b // 64] >> np.uint64(b % 64) & ONE
    planes = [np.bitwise_or.reduceat(bit(prints, b) << lane, head) for b in range(64 * width)]
    valid = np.bitwise_or.reduceat(ONE << lane, head)
    # a row meets its own word (later lanes only) and the later words of its bucket
    reach = np.repeat(base[1:], size) - word
    reach[np.repeat(size, size) == 1] = 0
    ends = np.cumsum(reach)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        steps = reach[start:stop]
        row = np.repeat(np.arange(start, stop), steps)
        step = np.arange(len(row)) - np.repeat(np.cumsum(steps) - steps, steps)
        start = stop
        if not len(row):
            continue
        w = word[row] + step
        alive = valid[w] & np.where(step == 0, ~((ONE << lane[row]) | ((ONE << lane[row]) - ONE)), ALL)
        counters = [np.zeros(len(row), np.uint64) for _ in range(max(1, radius.bit_length()))]
        over = np.zeros(len(row), np.uint64)
        mine = prints[row]
        for b in range(64 * width):
            carry = planes[b][w] ^ (np.uint64(0) - bit(mine, b))
            for k, counter in enumerate(counters):
                counters[k], carry = counter ^ carry, counter & carry
            over |= carry
            if b % 8 == 7:
                alive = alive & ~exceeds(counters, over, radius)
                held = np.flatnonzero(alive)
                if len(held) < len(alive):
                    row, w, mine, alive, over = row[held], w[held], mine[held], alive[held], over[held]
                    counters = [c[held] for c in counters]
                if not len(row):
                    break
        if len(row):
            bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            pair, lanes = np.nonzero(bits)
            yield row[pair], head[w[pair]] + lanes


def stars(n: int, pairs) -> np.ndarray:
    """Smallest row reachable from each row over pairs that come in parts."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def whole_buckets(batches, columns: int):
    """Merge Arrow batches sorted by their first column so that no bucket is cut."""
    rest = None
    for batch in batches:
        part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        part = part if rest is None else [np.concatenate(x) for x in zip(rest, part, strict=True)]
        if not len(part[0]):
            continue
        cut = int(np.searchsorted(part[0], part[0][-1], "left"))
        if cut:
            yield [x[:cut] for x in part]
        rest = [x[cut:] for x in part]
    if rest is not None and len(rest[0]):
        yield rest


def block_bits(blocks: int, width: int = 64) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of each block."""
    edges = [round(width * k / blocks) for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _bits(fp: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << n) - 1))


def keyed(prints: DataFrame, radius: int, blocks: int, hot: int) -> DataFrame:
    """`prints` with `key`: a row for each key of each row's fingerprint `fp`."""
    cut = block_bits(blocks)
    tables = list(combinations(range(blocks), blocks - radius))
    keys = [F.xxhash64(F.lit(t), *[_bits(F.col("fp"), *cut[k]) for k in table]) for t, table in enumerate(tables)]
    rows = prints.select("*", F.posexplode(F.array(*keys)).alias("t", "key"))
    # Full keys are looked for in a sixteenth of the fingerprints, by hash: cutting
    # a key loses no pair, so a wrong guess costs time only.
    part = 16 if hot >= 1600 else 1
    full = rows.filter(F.pmod(F.xxhash64("fp"), F.lit(part)) == 0).groupBy("key").count().filter(F.col("count") * part > hot)
    full = settle(full.select(F.col("key").alias("_hot")), "hot-buckets")
    n = full.count()
    if not n:
        return rows.drop("t")
    rows = rows.join(broadcast_if_small(full, n), F.col("key") == F.col("_hot"), "left")
    finer = []
    for table in tables:
        free = [bit for k, (low, size) in enumerate(cut) if k not in table for bit in range(low, low + size)]
        edges = [round(len(free) * k / (radius + 1)) for k in range(radius + 2)]
        masks = [sum(1 << bit for bit in free[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        finer.append(F.array(*[F.xxhash64("key", F.lit(p), F.col("fp").bitwiseAND(F.lit(m))) for p, m in enumerate(signed)]))
    again = F.element_at(F.array(*finer), F.col("t") + 1)
    keys_of = F.when(F.col("_hot").isNull(), F.array("key")).otherwise(again)
    return rows.select(*prints.columns, F.explode(keys_of).alias("key"))


def _star_edges(radius: int):
    def run(batches):
        for key, fp in whole_buckets(batches, 2):
            prints = fp.astype(np.int64).view(np.uint64)
            root = stars(len(fp), close_pairs(key, prints, radius))
            linked = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], ["a", "b"])

    return run


def links(prints: DataFrame, radius: int, blocks: int, hot: int = 20_000) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `fp` as all pairs at
    `radius` bits or fewer do: within a bucket, each to its group's first."""
    rows = keyed(prints, radius, blocks, hot).select("key", "fp")
    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "fp")
    return sorted_rows.mapInArrow(_star_edges(radius), "a long, b long")


def key_plan(n: int, cosine: float, recall: float, bucket: int, width: int = 64) -> list[int]:
    """Masks of the keys for n prints of `width` bits: each some random bits.

    Keys are as long as leaves some `bucket` prints to each. Two prints of sets
    with the cosine given agree on a bit with chance 1 - angle / pi; given their
    distance d, a key is shared with chance C(width - d, bits) / C(width, bits).
    There are as many keys as find them with chance `recall` over d, for every n.
    """
    agree = 1 - math.acos(cosine) / math.pi
    bits = min(width // 2, max(6, round(math.log2(max(n, 1) / bucket)))) if n > bucket else 6
    chance = [math.comb(width, d) * (1 - agree) ** d * agree ** (width - d) for d in range(width + 1)]
    shared = [math.comb(width - d, bits) / math.comb(width, bits) for d in range(width + 1)]
    tables = 1
    while sum(c * (1 - p) ** tables for c, p in zip(chance, shared, strict=True)) > 1 - recall:
        tables += 1
    rng = random.Random(64)
    return [sum(1 << b for b in rng.sample(range(width), bits)) for _ in range(tables)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def _pack(masks: list[int], slots: int, most: int = 500_000):
    """(t, slot, f0, f1): for every key t, the prints of a task by slot of the key."""

    def rows(held):
        f0, f1 = (np.concatenate(x) for x in zip(*held, strict=True))
        for t, mask in enumerate(masks):
            slot = (_mixed((f0.view(np.uint64) & np.uint64(mask)) + np.uint64(1)) >> np.uint64(32)) % np.uint64(slots)
            order = np.argsort(slot, kind="stable")
            found, first = np.unique(slot[order], return_index=True)
            ends = np.append(first[1:], len(order))
            a, b = f0[order], f1[order]
            columns = [pa.array(np.full(len(found), t, np.int32)), pa.array(found.astype(np.int32))]
            columns += [pa.array([x[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary()) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(columns, ["t", "slot", "f0", "f1"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)))
            n += batch.num_rows
            if n >= most:
                yield from rows(held)
                held, n = [], 0
        if n:
            yield from rows(held)

    return run


def _unpack(masks: list[int], hot: int, clusters):
    """(cluster, f0, f1, key) from packed prints in order of t and slot: what
    `clusters` finds, with no key; the prints of a bucket of over `hot`, with its key."""

    def found(t, held):
        f0, f1 = (np.concatenate(x) for x in zip(*held, strict=True))
        key = f0.view(np.uint64) & np.uint64(masks[t])
        order = np.argsort(key, kind="stable")
        key, f0, f1 = key[order], f0[order], f1[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        full = np.repeat(np.diff(np.append(first, len(key))) > hot, np.diff(np.append(first, len(key))))
        cluster, member = clusters(key[~full], f0[~full], f1[~full])
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(member), pa.nulls(len(member), pa.int32()), pa.nulls(len(member), pa.int64())], ["cluster", "f0", "f1", "key"])
        if full.any():
            of = _mixed(key[full] + np.uint64(t)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(of), pa.int64()), pa.array(f0[full]), pa.array(f1[full]), pa.array(of)], ["cluster", "f0", "f1", "key"])

    def run(batches):
        at, held = None, []
        for batch in batches:
            for t, slot, f0, f1 in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (t, slot) != at:
                    if held:
                        yield from found(at[0], held)
                    at, held = (t, slot), []
                held.append((np.frombuffer(f0, np.int64), np.frombuffer(f1, np.int32)))
        if held:
            yield from found(at[0], held)

    return run


def _tiles(clusters):
    def run(batches):
        for key, f0, f1 in whole_buckets(batches, 3):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in clusters(key, f0, f1)], ["cluster", "f0"])

    return run


def packed_buckets(prints: DataFrame, masks: list[int], clusters, slot_rows: int = 250_000, hot: int = 20_000) -> DataFrame:
    """(cluster, f0): what `clusters(key, f0, f1)`, rows in order of the key, finds
    in the buckets of the distinct prints (f0 of 64 bits, f1 of 32) by every mask.

    Each key's prints go to slots of about `slot_rows`. A bucket of over `hot`
    prints is dealt into tiles, of which every two meet in a task.
    """
    slots = max(1, -(-prints.count() // slot_rows))
    packed = prints.mapInArrow(_pack(masks, slots), "t int, slot int, f0 binary, f1 binary")
    met = packed.repartition(slots * len(masks), "t", "slot").sortWithinPartitions("t", "slot")
    met = settle(met.mapInArrow(_unpack(masks, hot, clusters), "cluster long, f0 long, f1 int, key long").distinct(), "buckets")
    found = met.filter("key IS NULL").select("cluster", "f0")
    full = met.filter("key IS NOT NULL")
    if full.isEmpty():
        return found
    tiles = full.groupBy("key").agg(F.ceil(2 * F.count("*") / hot).cast("int").alias("tiles"))
    side = F.pmod(F.xxhash64("f0"), F.col("tiles"))
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda o: F.xxhash64("key", F.least(side, o), F.greatest(side, o)))
    rows = full.join(tiles, "key").select(F.explode(meet).alias("key"), "f0", "f1")
    again = rows.repartition("key").sortWithinPartitions("key", "f0").mapInArrow(_tiles(clusters), "cluster long, f0 long")
    return found.unionByName(again)
