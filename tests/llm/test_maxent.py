"""The language model against a plain version of itself, and on awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from .conftest import crc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return [*WORD.findall(lower(text)), None]


def corpus(n=90, seed=2):
    """Two kinds of text, in which the word before tells much of the next."""
    rng = random.Random(seed)
    first, second = [f"ka{i}" for i in range(30)], [f"zo{i}" for i in range(30)]
    out = []
    for i in range(n):
        words, own = [], first if i % 2 else second
        while len(words) < rng.randint(5, 60):
            k = rng.randrange(30)
            words += [own[k], own[(k * 7 + 1) % 30], "The" if i % 2 else "la"]
        out.append((i, " ".join(words) + rng.choice(["", " rare%d," % i])))
    return out


def plain(rows, rounds):
    """Scores by loops over tokens; hashes of features and the step's constants are the module's."""
    from panelweave.llm import maxent as m

    docs = [tokens(t) for _, t in rows]
    train = [d for d, (i, _) in zip(docs, rows, strict=True) if crc(i, 7) != 2]
    count = Counter(w for d in train for w in d)
    total, distinct = sum(count.values()), len(count)
    hashes = {}
    for d in docs:
        h, s, _ = m.tokens(*_bytes(" ".join(w for w in d if w is not None)))
        hashes |= {w: (int(x), int(y)) for w, x, y in zip(d, h, s, strict=True)}
    ranked = sorted((w for w in count if w is not None), key=lambda w: (-count[w], hashes[w][0]))
    head = {w: k for k, w in enumerate(ranked[: m.WORDS])}
    mass = Counter()
    for w in ranked[m.WORDS :]:
        mass[hashes[w][1]] += count[w]
    order = {s: min(k, m.TAILS - 1) for k, s in enumerate(sorted(mass, key=lambda s: (-mass[s], s)))}
    tail_sums = Counter()
    for w in ranked[m.WORDS :]:
        tail_sums[order[hashes[w][1]]] += count[w] + 1
    symbol = lambda w: m.END if w is None else head[w] if w in head else m.WORDS + order.get(hashes[w][1], m.TAILS - 1)

    def triples(d):
        a = b = m.START
        for w in d:
            y = symbol(w)
            yield a, b, y, w
            a, b = y, a

    shares = np.zeros(m.CLASSES)
    inside = np.zeros((m.GROUPS, m.MEMBERS))
    for w, k in head.items():
        shares[k // m.MEMBERS] += count[w]
        inside[k // m.MEMBERS, k % m.MEMBERS] = count[w]
    for k, s in tail_sums.items():
        shares[m.GROUPS + k] += s
    shares[-1] = count[None]
    bias = np.log((shares + 1) / (shares + 1).sum())
    with np.errstate(divide="ignore"):
        word_bias = np.log(inside)
    tables = {k: {} for k in m.SHAPES}

    def softmax(bias, rows):
        z = bias + sum(tables[k].get(int(r), 0) for k, r in rows.items())
        e = np.exp(z - z.max())
        return e / e.sum()

    def levels(a, b, y):
        c = m.class_of(np.array([y]))[0]
        one = np.array([a]), np.array([b])
        yield bias, {k: v[0] for k, v in m.class_rows(*one).items()}, c
        if y < m.WORDS:
            yield word_bias[c], {k: v[0] for k, v in m.word_rows(*one, np.array([c])).items()}, y % m.MEMBERS

    speed = {k: {} for k in m.SHAPES}
    for step in range(rounds * m.STEPS):
        seen, mean = ({k: {} for k in m.SHAPES} for _ in range(2))
        for d in train:
            for a, b, y, _ in triples(d):
                for base, rows_of, outcome in levels(a, b, y):
                    p = softmax(base, rows_of)
                    for k, r in rows_of.items():
                        seen[k].setdefault(int(r), np.zeros(len(p)))[outcome] += 1
                        mean[k].setdefault(int(r), np.zeros(len(p)))[:] += p
        for k in tables:
            if k == "skip" and step % m.STEPS < m.STEPS - 1:  # the shared table waits for the end of the round
                continue
            for r in seen[k]:
                w = tables[k].get(r, np.zeros(m.SHAPES[k][1]))
                g = seen[k][r] - mean[k][r] - m.RIDGE * w
                together = 3 if k in ("bigram", "skip", "trigram") else 2
                speed[k][r] = m.MOMENTUM * speed[k].get(r, 0) + g / (together * (np.maximum(seen[k][r], mean[k][r]) + m.RIDGE))
                tables[k][r] = w + speed[k][r]
    out = {}
    for (i, _), d in zip(rows, docs, strict=True):
        score = 0.0
        for a, b, y, w in triples(d):
            for base, rows_of, outcome in levels(a, b, y):
                score += math.log10(softmax(base, rows_of)[outcome])
            if m.WORDS <= y < m.END:
                score += math.log10((count[w] + 1) / (tail_sums[y - m.WORDS] + 1))
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in d)
        out[i] = (crc(i, 7) == 2, len(d), sum(count[w] > 0 for w in d), total, base, score)
    return out


def _bytes(text):
    import pyarrow as pa

    from panelweave.llm.common import utf8

    return utf8(pa.array([text]))


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_the_plain_version(spark, parts):
    from panelweave.llm import maxent

    rows = corpus(40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    expected = plain(rows, 2)
    for r in maxent.score_documents(df, rounds=2).collect():
        *exact, base, score = expected[r.doc_id]
        assert [r.held_out, r.n_tokens, r.n_known, r.train_tokens] == exact
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=2e-4)


def test_tail_words_equal_the_plain_version(spark):
    """More distinct words than there are head words, so that tails and look-ups count."""
    from panelweave.llm import maxent

    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 4000}{rng.choice('xyz')}" for _ in range(120))) for i in range(60)]
    expected = plain(rows, 1)
    for r in maxent.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect():
        *exact, base, score = expected[r.doc_id]
        assert [r.held_out, r.n_tokens, r.n_known, r.train_tokens] == exact
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=2e-4)


def test_context_helps_on_held_out_texts(spark):
    from panelweave.llm import maxent

    found = maxent.score_documents(spark.createDataFrame(corpus(120), "doc_id long, text string")).filter("held_out").collect()
    assert len(found) > 5 and sum(r.score for r in found) > 0.8 * sum(r.base_score for r in found)


def test_awkward_rows(spark, docs, rows, none):
    from panelweave.llm import maxent

    found = maxent.score_documents(docs, rounds=1).collect()
    count = Counter(w for r in rows if crc(r[0], 7) != 2 for w in tokens(r[1]))
    total = sum(count.values())
    expected = sorted(((r[0], crc(r[0], 7) == 2, len(tokens(r[1])), sum(count[w] > 0 for w in tokens(r[1])), total) for r in rows), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in found), key=str) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert maxent.score_documents(none).count() == 0
    only_held_out = docs.filter("doc_id IN (%s)" % ",".join(str(i) for i in range(200) if crc(i, 7) == 2))
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in maxent.score_documents(only_held_out).collect())


def test_probabilities_sum_to_one():
    from panelweave.llm import maxent as m

    rng = np.random.default_rng(1)
    w = m.Weights(np.log(rng.dirichlet(np.ones(m.CLASSES))), np.log(rng.dirichlet(np.ones(m.MEMBERS), m.GROUPS)))
    for t in w.tables.values():
        t[:] = rng.normal(size=t.shape) * 0.3
    for a, b in ((m.START, m.START), (5, m.START), (m.WORDS + 3, 17)):
        key = (a * m.SYMBOLS + b) * m.SYMBOLS + np.arange(m.END + 1)
        assert (10 ** w.log10(key)).sum() == pytest.approx(1, abs=1e-5)


def test_gather_is_the_gradient():
    """Observed less expected counts are the slope of the log likelihood."""
    from panelweave.llm import maxent as m

    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 40, 300) * m.SYMBOLS**2 + rng.integers(0, 40, 300) * m.SYMBOLS + rng.integers(0, 60, 300))
    n = rng.integers(1, 9, len(key))
    w = m.Weights(np.zeros(m.CLASSES), np.zeros((m.GROUPS, m.MEMBERS)))
    for t in w.tables.values():
        t[:] = rng.normal(size=t.shape) * 0.1
    seen, mean = m.tables(), m.tables()
    m.gather(key, n, None, seen)
    m.gather(key, n, w, mean)
    for name in w.tables:
        g = seen[name] - mean[name]
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        sides = []
        for e in (0.05, -0.1):
            w.tables[name][at] += e
            sides.append(m.gather(key, n, w, m.tables()))
        w.tables[name][at] += 0.05
        assert (sides[0] - sides[1]) / 0.1 == pytest.approx(g[at], rel=0.02)
