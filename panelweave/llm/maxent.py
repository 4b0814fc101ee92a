"""Language-model scores from a hashed maximum-entropy model with classes.

Text is lower-cased (A-Z) and cut at ASCII white space; one end token follows.
The model is P(word | two words before) = P(class | context) P(word | class, context).

- The `WORDS` most frequent training tokens are head words, in classes of `MEMBERS`
  by frequency; the end token is a class of its own; every other token, known or
  not, is in a tail class by its last two bytes. Context words are head words, tail
  classes, the end or the start of the text.
- P(class | context) is a softmax over features of the word before (bigram), the
  word before that (skip) and both (trigram); within a head class a softmax over
  the bigram and the trigram. Trigram features are hashed into tables of `ROWS`
  rows. Within a tail class a word has the share (c + 1) / (sum + 1) of its
  training count c, and any unknown word 1 / (sum + 1), so all sum to 1.

Everything that training needs from the corpus is gathered by Spark over all
training documents: exact counts of all tokens (by 64-bit hash, two of 10**9 tokens
share one with chance 0.03), and counts of all (context, class or word)
triples, summed by slice of the word before. Training takes gradient steps, each
weight's divided by a bound of its curvature: in a round every slice updates the
weights of its own features in the task that holds its counts; only the table of
`skip`, which all slices share, is summed and updated on the driver between rounds.
The tables do not grow with the corpus. Scoring gathers the
rows of a batch's distinct triples. Counts of tail tokens are looked up in a
shuffle by hash, so no vocabulary is ever held in one place.

Rows: null and empty texts have the end token alone; repeated rows count and are
scored alike; a null id counts as ''; without training rows every token is unknown
and the score equals the base score; an empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.shared import drop
from panelweave.llm.common import arrow_batches, crc_remainder, settle, utf8
from panelweave.llm.wordhash import parts, token_values, words

WORDS, MEMBERS, TAILS = 1024, 32, 63  # head words, words of a class, tail classes
GROUPS = WORDS // MEMBERS
CLASSES = GROUPS + TAILS + 1  # the end is the last class
END, START = WORDS + TAILS, WORDS + TAILS + 1
SYMBOLS = START + 1
SLICES, ROWS = 512, 1 << 14  # slices of the words before, rows of a hashed table
FREQUENT = 1 << 17  # tokens whose counts are sent to all tasks
END_HASH = np.uint64(0x9E3779B97F4A7C15)
ROUNDS, STEPS, RIDGE, MOMENTUM = 4, 2, 1.0, 0.5


# ------------------------------------------------------------------------ text


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, last two bytes, row) of the tokens of each row, each row's end included."""
    h, start, row = words(data, offsets, token_values())
    n = len(offsets) - 1
    inside = token_values()[data] != 0
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    last[edge - 1] |= inside[edge - 1]
    stop = np.flatnonzero(last)
    lower = np.arange(256, dtype=np.uint16)
    lower[65:91] += 32
    suffix = lower[data[stop]] | np.where(stop > start, lower[data[np.maximum(stop - 1, 0)]], 0) << np.uint16(8)
    at = np.arange(len(h)) + row
    of = np.bincount(row, minlength=n)
    ends = np.cumsum(of) + np.arange(n)
    out_h, out_s, out_r = np.empty(len(h) + n, np.uint64), np.zeros(len(h) + n, np.uint16), np.repeat(np.arange(n), of + 1)
    out_h[at], out_s[at] = h, suffix
    out_h[ends] = END_HASH
    return out_h, out_s, out_r


def _sliced(column: pa.Array, most: int = 1_000_000, rows: int = 1000):
    """(tokens of the rows, first row, row after) of some bytes of a text column at a
    time; no copy is made of more than `rows` texts."""
    for start in range(0, len(column), rows):
        data, offsets = utf8(column.slice(start, rows).fill_null(""))
        for a, b in parts(data, offsets, most):
            cut = offsets[a : b + 1]
            yield *tokens(data[cut[0] : cut[-1]], cut - cut[0]), start + a, start + b


def merged(keys: list[np.ndarray], counts: list[np.ndarray], *more: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, the sums of their counts, and further columns that depend on the key."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
    found = every[first]
    del every
    return found, np.add.reduceat(np.concatenate(counts)[order], first).astype(np.int64) if len(first) else np.zeros(0, np.int64), *(np.concatenate(m)[order[first]] for m in more)


# ---------------------------------------------------------------- token counts


def _by_bucket(columns: tuple[np.ndarray, ...], bucket: np.ndarray, names: list[str], key: str = "bucket"):
    """One row for each bucket with the bytes of its part of each column."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    first = np.flatnonzero(np.diff(b, prepend=b[:1] - 1) != 0)
    edge = np.append(first, len(b))
    packed = [[c[order[i:j]].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)] for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(b[first].astype(np.int32)), *[pa.array(p, pa.binary()) for p in packed]], [key, *names])


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(56)).astype(np.int64)


def _count_tokens(most: int = 1_000_000):
    def run(batches):
        held = []
        for batch in batches:
            for h, s, _, _, _ in _sliced(batch.column(0)):
                found, first, n = np.unique(h, return_index=True, return_counts=True)
                held.append((found, n, s[first]))
                if sum(len(x[0]) for x in held) > most:
                    held = [merged(*map(list, zip(*held, strict=True)))]
                    if len(held[0][0]) > most // 2:  # keeps the task's memory bounded
                        yield rows(held.pop())
        if held:
            yield rows(merged(*map(list, zip(*held, strict=True))))

    def rows(counted):
        h, n, s = counted
        return _by_bucket((h, n, s), _bucket(h), ["h", "n", "s"])

    return run


def _merge(kinds: tuple, key: str, names: list[str]):
    """Sum the packed counts of each key; rows come by key."""

    def done(k, held):
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in merged(*map(list, zip(*held, strict=True)))]], [key, *names])

    def run(batches):
        now, held, size = None, [], 0
        for batch in batches:
            for i, k in enumerate(batch.column(0).to_pylist()):
                if k != now and held:
                    yield done(now, held)
                    held, size = [], 0
                now = k
                held.append(tuple(np.frombuffer(batch.column(c + 1)[i].as_buffer(), kind) for c, kind in enumerate(kinds)))
                size += len(held[-1][0])
                if size > 1_000_000 and len(held) > 1:
                    held = [merged(*map(list, zip(*held, strict=True)))]
                    size = len(held[0][0]) // 2
        if held:
            yield done(now, held)

    return run


def token_counts(texts: DataFrame) -> DataFrame:
    """(bucket, h, n, s): hashes, counts and last two bytes of the tokens of `text`,
    packed in order of the hash, in the shared folder."""
    packed = texts.select("text").mapInArrow(_count_tokens(), "bucket int, h binary, n binary, s binary")
    ordered = packed.repartition("bucket").sortWithinPartitions("bucket")
    return settle(ordered.mapInArrow(_merge((np.uint64, np.int64, np.uint16), "bucket", ["h", "n", "s"]), "bucket int, h binary, n binary, s binary"), "token-counts")


def _unpacked(batch: pa.RecordBatch, i: int):
    return (np.frombuffer(batch.column(batch.schema.names.index(c))[i].as_buffer(), kind) for c, kind in (("h", np.uint64), ("n", np.int64), ("s", np.uint16)))


def _sizes(batches):
    """(n, words, occurrences): how many tokens of a bucket occur n times, n cut to 8 bits."""
    for batch in batches:
        for i in range(batch.num_rows):
            h, n, _ = _unpacked(batch, i)
            shift = np.maximum(np.frexp(n.astype(np.float64))[1] - 8, 0)
            least, where, words_of = np.unique(n >> shift << shift, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(least), pa.array(words_of), pa.array(np.bincount(where, n, len(least)).astype(np.int64))], ["n", "words", "total"])


def _over(least: int):
    """(h, n) of the tokens of a bucket that occur at least so often."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                h, n, _ = _unpacked(batch, i)
                yield pa.RecordBatch.from_arrays([pa.array(h[n >= least].view(np.int64)), pa.array(n[n >= least])], ["h", "n"])

    return run


def _tail_mass(head: np.ndarray):
    """(suffix, words, occurrences) of the tokens of a bucket that are not head words."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                h, n, s = _unpacked(batch, i)
                rest = ~np.isin(h, head)
                suffix, where, words_of = np.unique(s[rest], return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(suffix.astype(np.int32)), pa.array(words_of), pa.array(np.bincount(where, n[rest], len(suffix)).astype(np.int64))], ["suffix", "words", "total"])

    return run


@dataclass
class Vocabulary:
    """Head words by count, the tail class of each suffix, totals; the counts of
    `FREQUENT` tokens at most, in order of their hashes."""

    total: int  # training tokens
    distinct: int
    head: np.ndarray  # hashes, END_HASH left out
    head_counts: np.ndarray
    end_count: int
    frequent: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint64))
    frequent_counts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    tail_of: np.ndarray = field(default_factory=lambda: np.zeros(1 << 16, np.int16))
    tail_sums: np.ndarray = field(default_factory=lambda: np.zeros(TAILS))  # of count + 1

    def __post_init__(self):
        # a table without clashes from some bits of the hash to the head word
        for self.turn in range(1, 1000):
            slot = self._slot(self.head)
            if len(np.unique(slot)) == len(slot):
                break
        self.table = np.full(1 << 20, -1, np.int16)
        self.table[self._slot(self.head)] = np.arange(len(self.head))

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(2 * self.turn + 1) >> np.uint64(44)).astype(np.int64)

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Training counts of frequent tokens, 0 for others."""
        at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
        return np.where(self.frequent[at] == h, self.frequent_counts[at], 0)

    def symbols(self, h: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        found = self.table[self._slot(h)].astype(np.int64)
        known = found >= 0
        known[known] = self.head[found[known]] == h[known]
        out = np.where(known, found, WORDS + self.tail_of[suffix])
        out[h == END_HASH] = END
        return out


def vocabulary(counts: DataFrame) -> Vocabulary:
    """What the driver holds: the most frequent tokens, up to `FREQUENT` and however
    many there are of them, and the mass of each pair of last bytes."""
    sizes = counts.mapInArrow(_sizes, "n long, words long, total long").groupBy("n").agg(F.sum("words").alias("words"), F.sum("total").alias("total")).collect()
    sizes.sort(key=lambda r: -r.n)
    least, room = 1 << 62, FREQUENT
    for r in sizes:
        room -= r.words
        if room < 0:
            break
        least = r.n
    best = counts.mapInArrow(_over(least), "h long, n long").toArrow()
    h, n = best.column(0).to_numpy().astype(np.int64).view(np.uint64), best.column(1).to_numpy().astype(np.int64)
    order = np.argsort(h)
    h, n = h[order], n[order]
    end = counts.filter(F.col("bucket") == int(_bucket(END_HASH))).mapInArrow(_of_end, "n long").agg(F.sum("n")).first()[0]
    top = np.lexsort((h, -n))[: WORDS + 1]
    top = top[h[top] != END_HASH][:WORDS]
    vocab = Vocabulary(sum(r.total for r in sizes), sum(r.words for r in sizes), h[top], n[top], end or 0)
    if len(h):
        vocab.frequent, vocab.frequent_counts = h, n
    mass = counts.mapInArrow(_tail_mass(np.append(h[top], END_HASH)), "suffix int, words long, total long").groupBy("suffix").agg(F.sum("words").alias("words"), F.sum("total").alias("total")).collect()
    mass.sort(key=lambda r: (-r.total, r.suffix))
    vocab.tail_of[:] = TAILS - 1
    for k, r in enumerate(mass):
        vocab.tail_of[r.suffix] = min(k, TAILS - 1)
        vocab.tail_sums[min(k, TAILS - 1)] += r.words + r.total
    return vocab


def _of_end(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            h, n, _ = _unpacked(batch, i)
            yield pa.RecordBatch.from_arrays([pa.array(n[h == END_HASH])], ["n"])


# ------------------------------------------------------------------- the model


def contexts(symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Key of (word before, word before that, word) for each token."""
    a, b = np.full(len(symbol), START), np.full(len(symbol), START)
    a[1:] = np.where(row[1:] == row[:-1], symbol[:-1], START)
    b[2:] = np.where(row[2:] == row[:-2], symbol[:-2], START)
    return (a * SYMBOLS + b) * SYMBOLS + symbol


def slice_of(a: np.ndarray) -> np.ndarray:
    return a * 40503 % 65521 % SLICES


def _hashed(slices: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row of a hashed feature: within the part of the table that its slice owns."""
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    part = ROWS // SLICES
    return slices * part + (h >> np.uint64(40)).astype(np.int64) % part


def class_of(symbol: np.ndarray) -> np.ndarray:
    return np.where(symbol < WORDS, symbol // MEMBERS, symbol - WORDS + GROUPS)


def class_rows(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Table rows of the features of a class after the word b a."""
    return {"bigram": a, "skip": b, "trigram": _hashed(slice_of(a), a * SYMBOLS + b)}


def word_rows(a: np.ndarray, b: np.ndarray, group: np.ndarray) -> dict[str, np.ndarray]:
    """Table rows of the features of a word of a head class."""
    return {"word": a * GROUPS + group, "words": _hashed(slice_of(a), (a * SYMBOLS + b) * GROUPS + group)}


SHAPES = {"bigram": (SYMBOLS, CLASSES), "skip": (SYMBOLS, CLASSES), "trigram": (ROWS, CLASSES), "word": (SYMBOLS * GROUPS, MEMBERS), "words": (ROWS, MEMBERS)}


def tables() -> dict[str, np.ndarray]:
    return {k: np.zeros(shape, np.float32) for k, shape in SHAPES.items()}


@dataclass
class Weights:
    """Log shares of classes and of words within head classes, and the tables of
    weights that features add to them."""

    class_bias: np.ndarray
    word_bias: np.ndarray
    tables: dict[str, np.ndarray] = field(default_factory=tables)

    def softmax(self, rows: dict[str, np.ndarray], bias: np.ndarray) -> np.ndarray:
        """Probabilities of each row's outcomes."""
        z = bias
        for k, at in rows.items():
            z = z + self.tables[k][at]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def of(self, level: "Level") -> np.ndarray:
        return self.softmax(level.rows, self.class_bias if level.width == CLASSES else self.word_bias[level.group])

    def log10(self, key: np.ndarray, part: int = 10_000) -> np.ndarray:
        """log10 of P(class) and, of a head word, P(word | class), for distinct keys."""
        out = np.empty(len(key))
        for i in range(0, len(key), part):
            classes, members = levels(key[i : i + part])
            p = self.of(classes)[classes.at, classes.outcome].astype(np.float64)
            p[members.of] *= self.of(members)[members.at, members.outcome]
            out[i : i + part] = np.log10(p)
        return out


@dataclass
class Level:
    """The softmaxes of some triples at one level: feature rows of each, and for
    the triples `of` which of them it is (`at`) and its outcome."""

    width: int
    rows: dict[str, np.ndarray]
    group: np.ndarray | None
    of: np.ndarray
    at: np.ndarray
    outcome: np.ndarray


def levels(key: np.ndarray) -> tuple[Level, Level]:
    ab, y = np.divmod(key, SYMBOLS)
    pair, at = np.unique(ab, return_inverse=True)
    classes = Level(CLASSES, class_rows(*np.divmod(pair, SYMBOLS)), None, np.arange(len(key)), at, class_of(y))
    head = np.flatnonzero(y < WORDS)
    group, member = np.divmod(y[head], MEMBERS)
    combo, at = np.unique(ab[head] * GROUPS + group, return_inverse=True)
    pair, group = np.divmod(combo, GROUPS)
    return classes, Level(MEMBERS, word_rows(*np.divmod(pair, SYMBOLS), group), group, head, at, member)


def gather(key: np.ndarray, count: np.ndarray, weights: Weights | None, total: dict[str, np.ndarray], part: int = 10_000) -> float:
    """Add the observed counts (without weights) or the expected counts of every
    feature to `total`; the log likelihood. Keys are distinct and in order."""
    likelihood, i = 0.0, 0
    while i < len(key):
        j = min(i + part, len(key))
        if j < len(key):  # contexts stay whole
            j = int(np.searchsorted(key, (key[j] // SYMBOLS + 1) * SYMBOLS))
        for level in levels(key[i:j]):
            n, size = count[i:j][level.of].astype(np.float64), len(next(iter(level.rows.values())))
            if not size:
                continue
            if weights is None:
                values = np.bincount(level.at * level.width + level.outcome, n, size * level.width).reshape(size, -1)
            else:
                values = weights.of(level)
                likelihood += float((n * np.log(values[level.at, level.outcome])).sum())
                values *= np.bincount(level.at, n, size)[:, None]
            for k, at in level.rows.items():
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1) != 0)
                total[k][at[order][first]] += np.add.reduceat(values[order], first, axis=0).astype(np.float32)
        i = j
    return likelihood


def biases(vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Log shares of the classes, and of the words of each head class."""
    n = np.zeros(WORDS)
    n[: len(vocab.head_counts)] = vocab.head_counts
    groups = n.reshape(GROUPS, MEMBERS)
    share = np.concatenate([groups.sum(1), vocab.tail_sums, [vocab.end_count]]) + 1
    inside = np.where(np.arange(WORDS).reshape(groups.shape) < len(vocab.head_counts), np.log(groups + 1e-9), -1e9)
    return np.log(share / share.sum()).astype(np.float32), (inside - np.log(groups.sum(1, keepdims=True) + 1e-9)).astype(np.float32)


def slope(observed: np.ndarray, mean: np.ndarray, weights: np.ndarray, together: int) -> np.ndarray:
    """Gradient of the penalised likelihood, each weight's divided by a bound of its
    curvature; `together` features act on one softmax."""
    return (observed - mean - RIDGE * weights) / (together * (np.maximum(observed, mean) + RIDGE))


# ---------------------------------------------------------- training in rounds


def _count_triples(vocab: Vocabulary, most: int = 1_000_000):
    def rows(k, n):
        return _by_bucket((k, n), slice_of(k // SYMBOLS**2), ["k", "n"], "slice")

    def run(batches):
        keys, counts, size = [], [], 0
        for batch in batches:
            for h, s, row, _, _ in _sliced(batch.column(0)):
                k, n = np.unique(contexts(vocab.symbols(h, s), row), return_counts=True)
                keys.append(k)
                counts.append(n)
                size += len(k)
                if size > most:
                    k, n = merged(keys, counts)
                    keys, counts, size = [k], [n], len(k)
                    if size > most // 2:  # keeps the task's memory bounded
                        yield rows(k, n)
                        keys, counts, size = [], [], 0
        if keys:
            yield rows(*merged(keys, counts))

    return run


def _owned(k: int) -> dict[str, np.ndarray]:
    """Table rows that only contexts of slice k use; `skip` has none."""
    a = np.flatnonzero(slice_of(np.arange(SYMBOLS)) == k)
    hashed = np.arange(k * (ROWS // SLICES), (k + 1) * (ROWS // SLICES))
    return {"bigram": a, "trigram": hashed, "word": (a[:, None] * GROUPS + np.arange(GROUPS)).ravel(), "words": hashed}


TOGETHER = {"bigram": 3, "skip": 3, "trigram": 3, "word": 2, "words": 2}


def _state(k: int, packed: bytes | None) -> dict[str, list[np.ndarray]]:
    """[weights, speed, observed counts] of the rows that slice k owns, by table."""
    values, out, start = None if packed is None else np.frombuffer(packed, np.float32), {}, 0
    for t, at in _owned(k).items():
        shape = (3, len(at), SHAPES[t][1])
        size = int(np.prod(shape))
        out[t] = list(np.zeros(shape, np.float32) if values is None else values[start : start + size].reshape(shape).copy())
        start += size
    return out


def _local_steps(class_bias: np.ndarray, word_bias: np.ndarray, skip: np.ndarray, steps: int):
    """Each slice takes some steps on the rows that it owns, with the shared `skip`
    table as it is. A task's observed and expected counts of `skip` are a last row,
    with the numbers of the table's rows that it used as state."""

    def run(batches):
        names = ["slice", "k", "n", "state", "seen", "mean"]
        kinds = [pa.int32(), *[pa.binary()] * 5]
        seen, every = np.zeros(skip.shape, np.float32), np.zeros(skip.shape, np.float32)
        for batch in batches:
            for i in range(batch.num_rows):
                raw = [batch.column(batch.schema.names.index(c))[i] for c in names[:4]]
                number, key, count = raw[0].as_py(), *(np.frombuffer(x.as_buffer(), np.int64) for x in raw[1:3])
                state, owned = _state(number, raw[3].as_py()), _owned(number)
                weights, observed = Weights(class_bias, word_bias), tables()
                weights.tables["skip"] = skip
                gather(key, count, None, observed)
                for _ in range(steps):
                    mean = tables()
                    for t, at in owned.items():
                        weights.tables[t][at] = state[t][0]
                    gather(key, count, weights, mean)
                    for t, at in owned.items():
                        w, v, o = state[t]
                        o[:] = observed[t][at]
                        v[:] = MOMENTUM * v + slope(o, mean[t][at], w, TOGETHER[t])
                        w += v
                seen += observed["skip"]
                every += mean["skip"]
                packed = np.concatenate([x.ravel() for t in owned for x in state[t]]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number, raw[1].as_py(), raw[2].as_py(), packed, None, None), kinds, strict=True)], names)
        used = np.flatnonzero(seen.any(1) | every.any(1))
        last = (None, None, None, used.tobytes(), seen[used].tobytes(), every[used].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, kinds, strict=True)], names)

    return run


def _added(batches):
    """Sums of the observed and of the expected counts of `skip` over a task; the
    rows that a slice's task used come as numbers and values."""
    seen, mean = np.zeros((2, *SHAPES["skip"]))
    for batch in batches:
        for i in range(batch.num_rows):
            used = np.frombuffer(batch.column(0)[i].as_buffer(), np.int64)
            for total, c in ((seen, 1), (mean, 2)):
                total[used] += np.frombuffer(batch.column(c)[i].as_buffer(), np.float32).reshape(len(used), total.shape[1])
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (seen, mean)], ["seen", "mean"])


def train(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Weights learned from the `text` column in so many rounds.

    A slice owns its rows of all tables but `skip`. In a round each slice takes
    `STEPS` steps on its own rows, where its counts are; then the driver adds the
    slices' counts of `skip`, a small table, and takes a step on that.
    """
    columns = "slice int, k binary, n binary"
    triples = texts.select("text").mapInArrow(_count_triples(vocab), columns)
    triples = triples.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merge((np.int64, np.int64), "slice", ["k", "n"]), columns)
    now = settle(triples, "context-counts").withColumn("state", F.lit(None).cast("binary"))
    weights = Weights(*biases(vocab))
    speed = np.zeros(SHAPES["skip"])
    for _ in range(rounds):
        run = _local_steps(weights.class_bias, weights.word_bias, weights.tables["skip"], STEPS)
        before, now = now, settle(now.filter("slice IS NOT NULL").select("slice", "k", "n", "state").mapInArrow(run, f"{columns}, state binary, seen binary, mean binary"), "slices")
        drop(before)
        parts = now.filter("slice IS NULL").select("state", "seen", "mean").coalesce(4).mapInArrow(_added, "seen binary, mean binary").collect()  # 4 tables
        seen, mean = (sum(np.frombuffer(p[c], np.float64) for p in parts).reshape(speed.shape) for c in (0, 1))
        speed = MOMENTUM * speed + slope(seen, mean, weights.tables["skip"], TOGETHER["skip"])
        weights.tables["skip"] = (weights.tables["skip"] + speed).astype(np.float32)
    for r in now.filter("slice IS NOT NULL").select("slice", "state").collect():  # a model in all
        for t, at in _owned(r["slice"]).items():
            weights.tables[t][at] = _state(r["slice"], r["state"])[t][0]
    return weights


# --------------------------------------------------------------------- scoring

DOC = "n_tokens array<long>, n_known array<long>, base array<double>, score array<double>"


def _score(shared, kind: pa.DataType):
    """For some documents at a time (`part`): a row with their sums over tokens of
    known count, and for each bucket of hashes a row with the other tokens."""

    def run(batches):
        vocab, weights = shared.value
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            for h, s, row, a, b in _sliced(batch.column(1)):
                symbol, c = vocab.symbols(h, s), vocab.counts(h)
                c[symbol == END] = vocab.end_count
                triple, where = np.unique(contexts(symbol, row), return_inverse=True)
                p = weights.log10(triple)[where]
                tail = (symbol >= WORDS) & (symbol < END)
                p[tail] -= np.log10(vocab.tail_sums[symbol[tail] - WORDS] + 1)
                seen = np.log10(c + 1.0)
                p[tail] += seen[tail]
                n = b - a
                sums = [np.bincount(row, minlength=n), np.bincount(row, c > 0, n).astype(np.int64), np.bincount(row, seen, n), np.bincount(row, p, n)]
                asked = np.flatnonzero(c == 0)
                found = _by_bucket((row[asked].astype(np.int32), h[asked]), _bucket(h[asked]), ["rows", "h"])
                m = found.num_rows
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in (batch.column(0).slice(a, n), *map(pa.array, sums))]
                blank = [pa.nulls(m, x.type) for x in lists]
                columns = [pa.array(np.full(m + 1, part)), pa.concat_arrays([pa.array([None], pa.int32()), found.column(0)])]
                columns += [pa.concat_arrays([x, y]) for x, y in zip(lists, blank, strict=True)]
                columns += [pa.concat_arrays([pa.array([None], pa.binary()), found.column(c)]) for c in (1, 2)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "bucket", "doc_id", "n_tokens", "n_known", "base", "score", "rows", "h"])
                part += 1

    return run


def _look_up(batches):
    """(part, rows, counts) of asked tokens; a bucket's counts (part null) come first."""
    now, hashes, counts = None, None, None
    for batch in batches:
        bucket, part, rows, h, n = (batch.column(batch.schema.names.index(c)) for c in ("bucket", "part", "rows", "h", "n"))
        out = []
        for i, k in enumerate(bucket.to_pylist()):
            if not part[i].is_valid:
                now, hashes, counts = k, np.frombuffer(h[i].as_buffer(), np.uint64), np.frombuffer(n[i].as_buffer(), np.int64)
                continue
            if k != now:  # no training token in this bucket
                continue
            asked, row = np.frombuffer(h[i].as_buffer(), np.uint64), np.frombuffer(rows[i].as_buffer(), np.int32)
            at = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
            known = hashes[at] == asked
            out.append((part[i].as_py(), row[known].tobytes(), counts[at[known]].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["part", "rows", "n"])


def _finish(vocab: Vocabulary, kind: pa.DataType):
    """Rows of documents from their sums (n null) and the counts looked up for them;
    rows come by part, sums first."""
    smooth = np.log10(vocab.total + vocab.distinct + 1.0)

    def done(ids, n, known, base, score):
        return pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(known), pa.array(base - n * smooth), pa.array(score)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    def run(batches):
        now = None
        for batch in batches:
            names = batch.schema.names
            ids, rows, n = (batch.column(names.index(c)) for c in ("doc_id", "rows", "n"))
            sums = [batch.column(names.index(c)) for c in ("n_tokens", "n_known", "base", "score")]
            for i in range(batch.num_rows):
                if not n[i].is_valid:
                    if now is not None:
                        yield done(*now)
                    now = (ids[i].values, *[np.array(x[i].values) for x in sums])
                    continue
                row, c = np.frombuffer(rows[i].as_buffer(), np.int32), np.frombuffer(n[i].as_buffer(), np.int64)
                size, more = len(now[0]), np.log10(c + 1.0)
                extra = np.bincount(row, more, size)
                now = (now[0], now[1], now[2] + np.bincount(row, minlength=size), now[3] + extra, now[4] + extra)
        if now is not None:
            yield done(*now)

    return run


def score(documents: DataFrame, counts: DataFrame, vocab: Vocabulary, weights: Weights) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every document."""
    shared = documents.sparkSession.sparkContext.broadcast((vocab, weights))
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"part long, bucket int, doc_id array<{kind}>, {DOC}, rows binary, h binary"
    sums = settle(documents.select("doc_id", "text").mapInArrow(_score(shared, kind), schema), "score-sums")
    asked = sums.filter("bucket IS NOT NULL").select("bucket", "part", "rows", "h").unionByName(counts.select("bucket", "h", "n"), allowMissingColumns=True)
    asked = asked.repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_first("part"))
    looked_up = asked.mapInArrow(_look_up, "part long, rows binary, n binary")
    both = sums.filter("bucket IS NULL").drop("bucket", "h", "rows").unionByName(looked_up, allowMissingColumns=True)
    both = both.repartition("part").sortWithinPartitions("part", F.col("n").isNotNull())
    return both.mapInArrow(_finish(vocab, kind), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def score_documents(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every
    document, learned from those outside the held-out seventh."""
    held_out = crc_remainder(F.col("doc_id"), 7) == 2
    texts = documents.filter(~held_out)
    with arrow_batches(documents.sparkSession, 1000):
        counts = token_counts(texts)
        vocab = vocabulary(counts)
        scored = score(documents, counts, vocab, train(texts, vocab, rounds))
    columns = {"held_out": held_out, "train_tokens": F.lit(vocab.total).cast("long")}
    if not vocab.total:  # every token is the one unknown, with chance 1
        columns["score"] = F.lit(0.0)
    return scored.withColumns(columns).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
