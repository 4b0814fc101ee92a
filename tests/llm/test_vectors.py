"""Hard negatives and whitening against brute force, and on awkward rows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

SCHEMA = "vec_id long, embedding array<float>, label int, x string, chunk string, anchor string, place string, kind string, n string"


def made(n=700, d=12, seed=3):
    """Clusters, many copies of one vector, ties, repeated rows, then rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    rows = []
    for i in range(n):
        label = int(rng.integers(0, 6))
        v = centres[label] + rng.normal(size=d) * 0.7
        rows.append([i, (v / np.linalg.norm(v)).round(2).tolist(), label])
    for i in range(150, 350):  # one vector, one or two labels
        rows[i][1], rows[i][2] = rows[100][1], i % 2
    rows += [rows[200], rows[7], rows[100]]
    good = rows[5][1]
    rows += [[None, good, 1], [900, None, 1], [901, good, None], [902, [*good[:3], None, *good[4:]], 1], [903, [float("nan"), *good[1:]], 1], [904, [float("inf"), *good[1:]], 2], [1000, good[:5], 3], [1001, [], 3]]
    return [(*r, *["clash"] * 6) for r in rows]


def usable(rows):
    return [(r[0], r[1], r[2]) for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]


def brute(rows, d=12):
    rows = usable(rows)
    x = [[int(np.floor(256 * np.float64(np.float32(c)))) for c in v] + [0] * (d - len(v)) for _, v, _ in rows]
    scores = (np.array(x) @ np.array(x).T).tolist()
    out = []
    for a, (anchor, _, label) in enumerate(rows):
        if anchor % 100:
            continue
        ranked = sorted((i for i in range(len(rows)) if i != a), key=lambda i: (-scores[a][i], rows[i][0]))
        for p in [i for i in ranked if rows[i][2] == label][:5]:
            s = scores[a][p]
            hard = [i for i in ranked if rows[i][2] != label and 80 * s <= 100 * scores[a][i] <= 100 * s]
            out += [(anchor, rows[p][0], r, rows[i][0], s, scores[a][i]) for r, i in enumerate(hard[:5], 1)]
    return sorted(out)


class TestHardNegatives:
    @pytest.mark.parametrize("parts", [1, 7])
    def test_equals_brute_force(self, spark, parts):
        from panelweave.llm import hardnegatives

        rows = made()
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = hardnegatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sorted(map(tuple, got)) == brute(rows)

    def test_the_query_moves_labels(self, spark, tmp_path):
        from panelweave.llm import queries

        rows = [(*r[:2], None if r[2] is None else r[2] % 10, *r[3:]) for r in made(400, seed=8)]
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
        got = sorted(map(tuple, queries.op11_hard_negatives(spark, str(tmp_path)).collect()))
        moved = [(r[0], r[1], (r[2] + 1) % 10 if r[0] is not None and r[2] is not None and r[0] % 7 == 0 else r[2]) for r in rows]
        assert got == brute(moved)

    def test_empty_and_single(self, spark):
        from panelweave.llm import hardnegatives

        assert hardnegatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
        for v in ([0.5] * 4, []):
            assert hardnegatives.mine(spark.createDataFrame([(0, v, 1)], "vec_id long, embedding array<float>, label int")).count() == 0

    def test_large_components(self, spark):
        from panelweave.llm import hardnegatives

        schema = "vec_id long, embedding array<double>, label int"
        rows = [(i, [3e5 + i, -2e5 * (i % 3)], i % 2) for i in range(6)]
        assert sorted(map(tuple, hardnegatives.mine(spark.createDataFrame(rows, schema)).collect())) == brute_doubles(rows)
        with pytest.raises(ValueError, match="beyond a long"):
            hardnegatives.mine(spark.createDataFrame([(0, [1e12], 1), (1, [1e12], 1)], schema))

    def test_curve_moves_one_cell_at_a_time(self):
        from panelweave.llm.hardnegatives import hilbert

        for d, bits in ((2, 4), (3, 3), (4, 2)):
            cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
            place = hilbert(cells, bits)
            assert sorted(place) == list(range(len(cells)))
            assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()

    @given(st.integers(0, 10**6))
    @settings(max_examples=50, deadline=None)
    def test_bounds_hold(self, seed):
        from panelweave.llm.hardnegatives import bounds

        rng = np.random.default_rng(seed)
        zones = rng.integers(-40, 40, (5, 9, 6))
        a = rng.integers(-40, 40, (7, 6))
        low, high = bounds(a, zones.min(1), zones.max(1))
        scores = np.einsum("ad,zrd->azr", a, zones)
        assert (low[:, :, None] <= scores).all() and (scores <= high[:, :, None]).all()

    def test_clusters_read_fewer_blocks(self, spark):
        from panelweave.llm import hardnegatives as h
        from pyspark.sql import functions as F

        rng = np.random.default_rng(1)
        centres = np.eye(8)
        rows = [(i, (centres[i % 8] + rng.normal(size=8) * 0.02).tolist(), i % 8) for i in range(1600)]
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            blocks = h.write_blocks(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("label"))
            anchors = blocks.mapInArrow(h._own(100)(5), f"{h.ANCHOR}, floor long")
            read, all_pairs = h._chosen(anchors, blocks, h._for_positives).count(), anchors.count() * (blocks.count() - 1)
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert all_pairs > 0 and read < 0.5 * all_pairs


def brute_doubles(rows):
    out, x = [], [[int(np.floor(256 * c)) for c in v] for _, v, _ in rows]
    dot = lambda i, j: sum(a * b for a, b in zip(x[i], x[j], strict=True))
    for a in range(len(rows)):
        if rows[a][0] % 100 == 0:
            ranked = sorted((i for i in range(len(rows)) if i != a), key=lambda i: (-dot(a, i), rows[i][0]))
            for p in [i for i in ranked if rows[i][2] == rows[a][2]][:5]:
                hard = [i for i in ranked if rows[i][2] != rows[a][2] and 80 * dot(a, p) <= 100 * dot(a, i) <= 100 * dot(a, p)]
                out += [(rows[a][0], rows[p][0], r, rows[i][0], dot(a, p), dot(a, i)) for r, i in enumerate(hard[:5], 1)]
    return sorted(out)


class TestWhitening:
    def test_equals_numpy(self, spark):
        from panelweave.llm import whitening

        rows = made(500, seed=4)
        got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
        kept = [(r[0], r[1]) for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
        x = np.array([[int(np.floor(1024 * np.float64(np.float32(c)))) + 100_000 for c in v] + [100_000] * (12 - len(v)) for _, v in kept])
        n = len(x)
        values, vectors = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
        values, vectors = values[::-1], vectors[:, ::-1]
        z = (x - x.mean(0)) @ vectors[:, :8] / np.sqrt(values[:8])
        assert len(got) == 8 * n and {r.n for r in got} == {n}
        by_id = {}
        for (vec_id, _), own, row in zip(kept, z, x, strict=True):
            by_id.setdefault(vec_id, []).append((own, sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, x.sum(0), strict=True))))
        for k in range(8):
            ours = {}
            for r in got:
                if r.component == k + 1:
                    ours.setdefault(r.vec_id, []).append((r.whitened, r.deviation))
            sign = np.sign(sum(a[0] * b[0][k] for i in ours for a, b in zip(ours[i][:1], by_id[i][:1], strict=True)))
            for i, found in ours.items():
                expected = sorted((sign * own[k], dev) for own, dev in by_id[i])
                assert np.allclose(sorted(found), expected, rtol=1e-9, atol=1e-9)
                assert sorted(f[1] for f in found) == sorted(e[1] for e in expected)
        for r in got:
            assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-9

    def test_does_not_depend_on_partitions(self, spark):
        from panelweave.llm import whitening

        df = spark.createDataFrame(made(400, seed=5), SCHEMA)
        fits = [whitening.fit(whitening.whole_vectors(df.repartition(k), "embedding", 1024.0, 100_000)) for k in (1, 6)]
        assert fits[0].sums == fits[1].sums and (fits[0].values == fits[1].values).all() and (fits[0].vectors == fits[1].vectors).all()

    def test_low_rank_and_empty(self, spark):
        from panelweave.llm import whitening

        schema = "vec_id long, embedding array<double>"
        assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
        assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
        assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], schema)).count() == 0
        line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(20)]
        got = whitening.whiten(spark.createDataFrame(line, schema)).collect()
        assert len(got) == 20 and all(r.component == 1 and abs(r.explained - 1) < 1e-12 for r in got)

    def test_deviation_beyond_a_long(self, spark):
        from panelweave.llm import whitening

        for d, expected in ((1, 2**60), (9, None)):
            rows = [(i, [2.0**19 * (i % 2) + 2.0**-10 * (k == 1) * (i > 1) for k in range(d)]) for i in range(4)]
            got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
            assert got and all(r.deviation == expected for r in got)

    @given(st.integers(0, 10**6), st.integers(1, 12), st.booleans())
    @settings(max_examples=60, deadline=None)
    def test_counts_by_inertia(self, seed, d, zero_diagonal):
        from panelweave.llm.whitening import above

        rng = np.random.default_rng(seed)
        m = rng.normal(size=(d, d))
        m += m.T
        if zero_diagonal:
            np.fill_diagonal(m, 0)
        values = np.linalg.eigvalsh(m)
        for shift in (0.0, *(values[1:] + values[:-1]) / 2):
            if np.abs(values - shift).min() > 1e-9:
                assert above(m, shift) == (values > shift).sum()

    @given(st.integers(0, 10**6))
    @settings(max_examples=30, deadline=None)
    def test_leading_pairs_with_equal_values(self, seed):
        from panelweave.llm.whitening import leading

        rng = np.random.default_rng(seed)
        d = int(rng.integers(2, 14))
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        values = np.sort(rng.choice([0.0, 1.0, 1.0, 2.5, 2.5 + 1e-7, 7.0], d))[::-1]
        m = q @ np.diag(values) @ q.T
        found, vectors = leading((m + m.T) / 2, 8)
        expected = values[values > 0][:8]
        assert np.allclose(found, expected, atol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-12)
        assert np.allclose(m @ vectors, vectors * found, atol=1e-10)
