"""Hard negatives for anchors, read from Hilbert-ordered blocks by their zone maps.

Every component x of a vector becomes the whole number floor(256 x). Rows are
ordered along a Hilbert curve through the dimensions of largest variance and
written to the shared folder as Parquet rows of some blocks each (a chunk), with
the smallest and largest value of every dimension for each chunk and each block:
the zone maps. Interval arithmetic on a zone bounds the inner product of an
anchor with all rows of the zone from below and above.

1. Each anchor meets the chunk that holds it; the k-th score found there is a floor
   for its positives. It then reads the other chunks of its label whose upper
   bound reaches the floor, and in them only such blocks.
2. Each positive gives a window of scores for negatives. The anchor's own chunk
   gives each window a floor; then the anchor reads the chunks, and in them the
   blocks, whose bounds meet one of its windows above that window's floor.

Chunks and the anchors that read them meet by chunk in one shuffle: a chunk moves
once, anchors once for each chunk that they read. A task holds one chunk and one
batch of anchors. Floors only skip what cannot be among the first k, so the
result is exact. Scores are exact: whole numbers in floating point as long as 53
bits hold every sum, then in 64-bit integers.

Rows: rows without an id or a label, null vectors and vectors with a null, NaN or
infinite component take no part; a vector shorter than the longest counts 0 for
its missing components; rows that repeat an id are rows of their own, as anchors,
as positives of each other and as negatives; ties go to the smaller id; anchors
without a positive, and positives without a negative in the window, have no row;
positives with a score under 0 have none, as the window is empty; an empty table
gives an empty result. Sums of products beyond a long are an error. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import settle
from panelweave.llm.whitening import exact_product, matrix, whole_vectors

SCALE = 256.0
BLOCK, BLOCKS, ROW_BITS = 1024, 16, 14  # rows of a block, blocks of a chunk, bits of a row's number in its chunk
CURVE_DIMS, CURVE_BITS = 8, 7
CHUNK = "chunk long, ids binary, labels binary, x binary, low array<long>, high array<long>, block_low binary, block_high binary, held array<int>"
ANCHOR = "anchor long, anchor_id long, label int, home long, ax array<long>"
LEAST = np.iinfo(np.int64).min


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole coordinates under 2**bits.

    The coordinates' bits are turned from the highest down: a set bit inverts the
    lower bits of the first coordinate, a clear one exchanges them with it; a Gray
    code over the result gives the digits of the place, one from each coordinate.
    """
    x = axes.astype(np.int64).T.copy()
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(x)):
            is_set = (x[i] >> b & 1).astype(bool)
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(is_set, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            place = place << 1 | (row >> b & 1)
    return place


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of `a` with any vector between
    the rows of `low` and `high`, by interval arithmetic: (rows of a, zones)."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return exact_product(up, low.T) + exact_product(down, high.T), exact_product(up, high.T) + exact_product(down, low.T)


def first_of(group: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k rows of each group with the highest scores, ties by id."""
    order = np.lexsort((ids, -scores, group))
    g = group[order]
    first = np.flatnonzero(np.diff(g, prepend=g[:1] - 1) != 0)
    place = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[place < k]


class Found:
    """The k best (score, id) of each of n groups, kept as rows come."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.full(n, LEAST) if floor is None else floor.copy()
        self.group = self.ids = self.scores = np.zeros(0, np.int64)

    def add(self, group: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.group, self.ids, self.scores = (np.concatenate(x) for x in ((self.group, group), (self.ids, ids), (self.scores, scores)))
        kept = first_of(self.group, self.ids, self.scores, self.k)
        self.group, self.ids, self.scores = self.group[kept], self.ids[kept], self.scores[kept]
        full = np.flatnonzero(np.bincount(self.group, minlength=len(self.floor)) >= self.k)
        worst = np.full(len(self.floor), np.iinfo(np.int64).max)
        np.minimum.at(worst, self.group, self.scores)
        self.floor[full] = np.maximum(self.floor[full], worst[full])


class Chunk:
    """Decoded columns of a chunk row."""

    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int32)
        d = len(row["block_low"]) // 8 // -(-len(self.ids) // BLOCK)
        self.x = np.frombuffer(row["x"], f"i{len(row['x']) // (len(self.ids) * d)}").reshape(-1, d).astype(np.int64)
        self.low, self.high = (np.frombuffer(row[c], np.int64).reshape(-1, d) for c in ("block_low", "block_high"))
        self.key = row["chunk"]

    def blocks(self, a: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows, lower bounds, upper bounds for each row of a) of each block, those
        of the highest bounds first, so that floors rise early."""
        low, high = bounds(a, self.low, self.high)
        for k in np.argsort(-high.max(0, initial=LEAST), kind="stable"):
            yield slice(k * BLOCK, min((k + 1) * BLOCK, len(self.ids))), low[:, k], high[:, k]

    def positives(self, anchor: np.ndarray, label: np.ndarray, a: np.ndarray, floor: np.ndarray, k: int, part: int = 256) -> Found:
        """`anchor`: its number, chunk << ROW_BITS | row."""
        found = Found(len(anchor), k, floor)
        for rows, _, high in self.blocks(a):
            labels, number = self.labels[rows], self.key << ROW_BITS | np.arange(rows.start, rows.stop)
            due = np.flatnonzero((high >= found.floor) & np.isin(label, labels))
            for some in np.array_split(due, -(-len(due) // part)) if len(due) else ():
                s = exact_product(a[some], self.x[rows].T)
                ok = (label[some, None] == labels) & (anchor[some, None] != number) & (s >= found.floor[some, None])
                i, j = np.nonzero(ok)
                found.add(some[i], self.ids[rows][j], s[i, j])
        return found

    def negatives(self, label: np.ndarray, a: np.ndarray, windows: np.ndarray, floor: np.ndarray, k: int, part: int = 64) -> Found:
        """Groups are anchor * positives + positive; `windows` (anchors, positives)
        holds the positives' scores, under 0 where there is none."""
        n, w = windows.shape
        found = Found(n * w, k, np.maximum(floor, -(-4 * windows // 5)).ravel())
        for rows, low, high in self.blocks(a):
            labels = self.labels[rows]
            meets = (high[:, None] >= found.floor.reshape(n, w)) & (low[:, None] <= windows) & (windows >= 0)
            other = len(np.unique(labels)) > 1 or label != labels[0]
            due = np.flatnonzero(meets.any(1) & other)
            for some in np.array_split(due, -(-len(due) // part)) if len(due) else ():
                s = exact_product(a[some], self.x[rows].T)
                apart = label[some, None] != labels
                for p in range(w):
                    group = some * w + p
                    ok = apart & meets[some, p, None] & (s <= windows[some, p, None]) & (s >= found.floor[group, None])
                    i, j = np.nonzero(ok)
                    if len(i):
                        found.add(group[i], self.ids[rows][j], s[i, j])
        return found


# ----------------------------------------------------------------- the blocks


def _placed(dims: list[int], low: np.ndarray, step: np.ndarray, width: int):
    def run(batches):
        for batch in batches:
            x = matrix(batch.column(2), width, 0)[:, dims]
            cell = np.clip(((x - low) / step), 0, (1 << CURVE_BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cell, CURVE_BITS))], ["vec_id", "label", "x", "place"])

    return run


def _packed(width: int):
    """Chunks of a task's rows, which come in the order of the curve."""

    def chunk(key, parts):
        ids, labels, x = (np.concatenate(p) for p in zip(*parts, strict=True))
        edge = np.arange(0, len(ids), BLOCK)
        low, high = np.minimum.reduceat(x, edge), np.maximum.reduceat(x, edge)
        small = x.astype(np.promote_types(np.min_scalar_type(int(low.min())), np.min_scalar_type(-int(high.max()) - 1)))
        columns = [[key], [ids.tobytes()], [labels.astype(np.int32).tobytes()], [small.tobytes()], [low.min(0).tolist()], [high.max(0).tolist()], [low.tobytes()], [high.tobytes()], [np.unique(labels).tolist()]]
        kinds = [pa.int64(), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 2, pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in CHUNK.split(", ")])

    def run(batches):
        key, parts, held, most = TaskContext.get().partitionId() << 15, [], 0, BLOCK * BLOCKS
        for batch in batches:
            ids, labels, x = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), width, 0))
            while len(ids):
                take = most - held
                parts.append((ids[:take], labels[:take], x[:take]))
                held += len(parts[-1][0])
                ids, labels, x = ids[take:], labels[take:], x[take:]
                if held == most:
                    yield chunk(key, parts)
                    key, parts, held = key + 1, [], 0
        if held:
            yield chunk(key, parts)

    return run


def write_blocks(embeddings: DataFrame, label: Column, key: str = "vec_id", column: str = "embedding") -> DataFrame | None:
    """The rows in chunks along the curve, in the shared folder; None without rows."""
    rows = whole_vectors(embeddings.filter(F.col(key).isNotNull() & label.isNotNull()), column, SCALE, 0, F.col(key).cast("long").alias("vec_id"), label.cast("int").alias("label"))
    each = rows.select(F.posexplode("x").alias("dim", "v"))
    spread = each.groupBy("dim").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.max(F.abs("v")).alias("most")).collect()  # a row for each dimension
    width = 1 + max((s.dim for s in spread), default=-1)
    if not rows.limit(1).count():
        return None
    if width * max((s.most for s in spread), default=0) ** 2 >= 1 << 62:
        raise ValueError("sums of products beyond a long")
    if not width:
        rows, width, dims = rows.withColumn("x", F.array(F.lit(0).cast("long"))), 1, [0]
        low = step = np.ones(1)
    else:
        chosen = sorted(sorted(spread, key=lambda s: (-s.std, s.dim))[:CURVE_DIMS], key=lambda s: s.dim)
        dims = [s.dim for s in chosen]
        low = np.array([s.mean - 3 * s.std for s in chosen])  # cells cover 3 deviations either way
        step = np.array([max(6 * s.std, 1.0) / (1 << CURVE_BITS) for s in chosen])
    placed = rows.mapInArrow(_placed(dims, low, step, width), "vec_id long, label int, x array<long>, place long")
    ordered = placed.repartitionByRange("place", "vec_id").sortWithinPartitions("place", "vec_id")
    return settle(ordered.mapInArrow(_packed(width), CHUNK), "vector-blocks")


# ----------------------------------------------------------------- the search


def _columns(batch: pa.RecordBatch, at: int) -> dict:
    return {n: batch.column(i)[at].as_py() for i, n in enumerate(batch.schema.names)}


def _stack(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A list column of equal sizes as rows of a matrix."""
    column = batch.column(batch.schema.names.index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _meetings(batches):
    """(chunk, its visitors): rows come by chunk, the chunk itself (visitor 0) first."""
    chunk = None
    for batch in batches:
        key, kind = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("chunk", "kind"))
        edge = np.flatnonzero((np.diff(key, prepend=key[:1] - 1) != 0) | (kind == 0) | (np.append(0, kind[:-1]) == 0))
        for a, b in zip(edge, np.append(edge[1:], len(key)), strict=True):
            if kind[a] == 0:
                chunk = Chunk(_columns(batch, a))
            else:
                yield chunk, batch.slice(a, b - a)


def _own(every: int):
    """(ANCHOR, scores): the anchors among a chunk's rows with their first positives there."""

    def run(k):
        def each(batches):
            for batch in batches:
                for at in range(batch.num_rows):
                    c = Chunk(_columns(batch, at))
                    own = np.flatnonzero(c.ids % every == 0)
                    number = c.key << ROW_BITS | own
                    found = c.positives(number, c.labels[own], c.x[own], np.full(len(own), LEAST), k)
                    columns = [number, c.ids[own], c.labels[own], np.full(len(own), c.key), c.x[own].tolist(), found.floor]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()), strict=True)], ["anchor", "anchor_id", "label", "home", "ax", "floor"])

        return each

    return run


def _read_positives(k: int):
    def run(batches):
        for c, v in _meetings(batches):
            column = lambda n: v.column(v.schema.names.index(n)).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
            anchor = column("anchor")
            found = c.positives(anchor, column("label"), _stack(v, "ax"), column("floor"), k)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[found.group]), pa.array(found.ids), pa.array(found.scores)], ["anchor", "positive_id", "positive_score"])

    return run


def _read_negatives(k: int):
    def run(batches):
        for c, v in _meetings(batches):
            column = lambda n: v.column(v.schema.names.index(n)).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
            anchor, windows = column("anchor"), _stack(v, "windows")
            found = c.negatives(column("label"), _stack(v, "ax"), windows, _stack(v, "floors"), k)
            w = windows.shape[1]
            columns = [anchor[found.group // w], found.group % w, found.ids, found.scores]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "place", "negative_id", "negative_score"])

    return run


def _choose(test, width: int):
    """(anchor, chunk) where `test` says that the anchor must read the chunk's zone.
    Rows come by pack of zones, the zones of the pack (kind 0) first."""

    def run(batches):
        zones, pack = [], None
        for batch in batches:
            names = batch.schema.names
            key, kind = (batch.column(names.index(c)).to_numpy() for c in ("pack", "kind"))
            edge = np.flatnonzero((np.diff(key, prepend=key[:1] - 1) != 0) | (np.diff(kind, prepend=kind[:1]) != 0))
            for a, b in zip(edge, np.append(edge[1:], len(key)), strict=True):
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    if key[a] != pack:
                        zones, pack = [], key[a]
                    zones.append(part)
                    continue
                chunk = np.concatenate([z.column(names.index("chunk")).to_numpy() for z in zones])
                low, high = (np.concatenate([_stack(z, c) for z in zones]) for c in ("low", "high"))
                held = [h for z in zones for h in z.column(names.index("held")).to_pylist()]
                label = part.column(names.index("label")).to_numpy()
                home = part.column(names.index("home")).to_numpy()
                least, most = bounds(_stack(part, "ax"), low, high)
                every, of = np.unique(np.append(label, [y for h in held for y in h]), return_inverse=True)
                own = np.zeros((len(chunk), len(every)), bool)
                own[np.repeat(np.arange(len(chunk)), [len(h) for h in held]), of[len(label) :]] = True
                same = own[:, of[: len(label)]].T
                other = ~(same & (own.sum(1) == 1))
                i, j = np.nonzero(test(part, least, most, same, other) & (home[:, None] != chunk))
                yield pa.RecordBatch.from_arrays([part.column(names.index("anchor")).take(pa.array(i)), pa.array(chunk[j])], ["anchor", "chunk"])

    return run


def _for_positives(part, least, most, same, other):
    return same & (most >= part.column(part.schema.names.index("floor")).to_numpy()[:, None])


def _for_negatives(part, least, most, same, other):
    windows, floors = _stack(part, "windows"), _stack(part, "floors")
    reach = np.zeros(most.shape, bool)
    for w in range(windows.shape[1]):
        floor = np.maximum(floors[:, w], -(-4 * windows[:, w] // 5))
        reach |= (windows[:, w] >= 0)[:, None] & (most >= floor[:, None]) & (least <= windows[:, w, None])
    return other & reach


def _chosen(anchors: DataFrame, blocks: DataFrame, test, zones_in_pack: int = 512) -> DataFrame:
    """(anchor, chunk): which chunks' zones each anchor must read beside its own."""
    n = blocks.count()
    packs = -(-n // zones_in_pack)
    zones = blocks.select("chunk", "low", "high", "held").withColumns({"pack": F.pmod(F.xxhash64("chunk"), F.lit(packs)), "kind": F.lit(0)})
    asked = anchors.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long"))).alias("pack"), F.lit(1).alias("kind"))
    both = zones.unionByName(asked, allowMissingColumns=True).repartition("pack").sortWithinPartitions("pack", "kind")
    return both.mapInArrow(_choose(test, n), "anchor long, chunk long")


def _visit(visitors: DataFrame, blocks: DataFrame, read, schema: str) -> DataFrame:
    """Visitors (with `chunk`) meet the chunks that they read, each in one task."""
    needed = blocks.drop("low", "high", "held").join(visitors.select("chunk").distinct(), "chunk", "left_semi")
    both = needed.withColumn("kind", F.lit(0)).unionByName(visitors.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    tasks = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.count() // 16)
    return both.repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(read, schema)


def _top(rows: DataFrame, keys: list[str], score: str, row: str, k: int) -> DataFrame:
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), row))
    return rows.withColumn("rank", best).filter(F.col("rank") <= k)


def mine(embeddings: DataFrame, label: Column | None = None, every: int = 100, positives: int = 5, negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score:
    for every row whose id is divisible by `every`, its first `positives` rows of
    the same label, and for each the first `negatives` rows of other labels that
    score at least 0.8 times as much and at most as much."""
    blocks = write_blocks(embeddings, F.col("label") if label is None else label)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if blocks is None:
        return embeddings.sparkSession.createDataFrame([], empty)
    anchors = settle(blocks.mapInArrow(_own(every)(positives), f"{ANCHOR}, floor long"), "anchors")

    found = "anchor long, positive_id long, positive_score long"
    own = anchors.withColumn("chunk", F.col("home"))  # its floor is the k-th score there, so the same rows are found again
    far = anchors.join(_chosen(anchors, blocks, _for_positives), "anchor")
    read = _visit(own.unionByName(far), blocks, _read_positives(positives), found)
    best = settle(_top(read, ["anchor"], "positive_score", "positive_id", positives).withColumnRenamed("rank", "place"), "positives")

    by_place = F.array(*[F.coalesce(F.max(F.when(F.col("place") == p + 1, F.col("positive_score"))), F.lit(-1)) for p in range(positives)])
    windows = anchors.drop("floor").join(best.groupBy("anchor").agg(by_place.alias("windows")), "anchor")
    windows = settle(windows.withColumn("floors", F.array_repeat(F.lit(int(LEAST)), positives)), "windows")
    found = "anchor long, place long, negative_id long, negative_score long"
    keys = ["anchor", "place"]
    home = _visit(windows.withColumn("chunk", F.col("home")), blocks, _read_negatives(negatives), found)
    home = settle(home, "home-negatives")
    full = _top(home, keys, "negative_score", "negative_id", negatives).filter(F.col("rank") == negatives)
    floor_of = [F.coalesce(F.max(F.when(F.col("place") == p, F.col("negative_score"))), F.lit(int(LEAST))) for p in range(positives)]
    floors = full.groupBy("anchor").agg(F.array(*floor_of).alias("_floors"))
    asking = settle(windows.join(floors, "anchor", "left").withColumn("floors", F.coalesce("_floors", "floors")).drop("_floors"), "windows")
    far = asking.join(_chosen(asking, blocks, _for_negatives), "anchor")
    read = _visit(far, blocks, _read_negatives(negatives), found).unionByName(home)
    chosen = _top(read, keys, "negative_score", "negative_id", negatives).withColumn("place", F.col("place") + 1)
    named = anchors.select("anchor", "anchor_id").join(best, "anchor").join(chosen, keys)
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
