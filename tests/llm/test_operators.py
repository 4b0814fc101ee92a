"""Every operator against a plain version of itself, and on awkward rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from .conftest import crc, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


class TestQuality:
    def test_base_counts(self, docs, rows):
        from panelweave.llm import quality

        found = sorted(map(tuple, quality.judge(docs).select("doc_id", *quality.BASE, "base_failed").collect()), key=str)
        expected = []
        for doc_id, text, *_ in rows:
            w = words(text)
            grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
            often = Counter(grams)
            repeated = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
            seen, dups = set(), 0
            for line in (text or "").split("\n"):
                if words(line):
                    dups += line in seen
                    seen.add(line)
            expected.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w)))
        assert found == sorted(expected, key=str)

    def test_repeats_and_lines(self, spark):
        from panelweave.llm import quality

        text = "a b c d a b c e a b\nline one\nline one\n\n\nline one"
        row = quality.with_base(spark.createDataFrame([(text,)], "text string")).first()
        assert (row.n_words, row.n_dup_lines, row.n_repeat_words) == (16, 2, 6 + 0 + 6)

    def test_bad_documents_go_and_good_stay(self, spark):
        import random

        from panelweave.llm import quality

        rng = random.Random(1)
        good = [(i, prose(rng, 120), "en", "s") for i in range(200)]
        bad = [(1000 + i, " ".join(w + "%%%" for w in prose(rng, 120).split()), "en", "s") for i in range(10)]
        df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
        kept = {r.doc_id for r in quality.judge(df).filter("kept").collect()}
        assert kept == set(range(200))

    def test_buckets_keep_order_and_floor(self, spark):
        from panelweave.llm import quality

        df = spark.range(0, 5000).withColumnRenamed("id", "v").withColumn("b", quality.bucket(F.col("v")))
        got = df.withColumn("f", quality.bucket_floor(F.col("b"))).orderBy("v").collect()
        assert all(x.b <= y.b for x, y in zip(got, got[1:]))
        assert all(r.f <= r.v and r.v - r.f <= r.v / 16 for r in got)

    def test_verdicts_equal_sql(self, docs, spark, tmp_path):
        import duckdb

        from panelweave.llm import queries

        docs.drop("size", "shard", "score", "h").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
        duck = duckdb.connect()
        duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        found = queries.op1_quality_rules(spark, str(tmp_path))
        names = sorted(found.columns)
        exp = duck.sql(f"SELECT {', '.join(names)} FROM ({queries.OP1_SQL})").fetchall()
        assert sorted(map(str, exp)) == sorted(str(tuple(r)) for r in found.select(*names).collect())

    def test_empty(self, none):
        from panelweave.llm import quality

        assert quality.judge(none).count() == 0


class TestHtml:
    PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="page header">
    <header><a href="/">Site</a></header><nav><ul><li><a href="/x">X</a></li></ul></nav><div class="ad">Buy these things now, they are cheap and very good.</div>
    <article><h1>Title &amp; more</h1><p><b>First   paragraph<br>goes on here &lt;b&gt; with text.<p>Second&nbsp;one follows, without an end tag</article>
    <aside><p>Some other stories you may like to read today.</p></aside><div id="comments"><p>I think that this is a very good article, thank you.</p></div>
    <form><label>Mail</label><button>Go</button></form><footer>&copy; me &middot; Words in the footer.</footer></body></html>"""

    def test_article_only(self):
        from panelweave.llm import html

        assert html.main_text(self.PAGE) == "Title & more\nFirst paragraph goes on here <b> with text.\nSecond one follows, without an end tag"

    @pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("<div", ""), ("<!-- cut", ""), ("<script>never ends", ""), ("<p>A plain paragraph of text.</p>", "A plain paragraph of text."), ("<nav>only a menu</nav>", "")])
    def test_odd_pages(self, page, text):
        from panelweave.llm import html

        assert html.main_text(page) == text

    def test_long_page(self):
        from panelweave.llm import html

        page = "<article>" + "<p>Some words stand here.</p><div class=ads>buy now</div>" * 5000 + "</article>"
        assert html.main_text(page) == "\n".join(["Some words stand here."] * 5000)

    @given(st.integers(0, 10**6))
    @settings(max_examples=60, deadline=None)
    def test_cut_is_minimal(self, seed):
        from itertools import product

        from panelweave.llm import html

        rng = np.random.default_rng(seed)
        n = 7
        excess = rng.uniform(-3, 3, n).tolist()
        edges = [(i, j, float(rng.uniform(0, 2))) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side):
            return sum(x for x, s in zip(excess, side) if x > 0 and not s) - sum(x for x, s in zip(excess, side) if x < 0 and s) + sum(w for a, b, w in edges if side[a] != side[b])

        assert cost(html.min_cut(excess, edges)) == pytest.approx(min(cost(s) for s in product([False, True], repeat=n)))

    PROSE = ["Where the river bends, the old mill still turns and grinds the corn of the valley each year.", "Yes.", "It was built by the monks, who kept the water rights for three hundred years and more, and sold them late.", "They left in May.", "The miller of today has other plans for the wheel, and for the long stone barn that stands beside it."]

    def page(self, marked: bool, core: bool) -> str:
        body, part = ("article" if core else "div"), (lambda name: f' class="{name}"' if marked else "")
        text = "".join(f"<p>{t}</p>" for t in self.PROSE)
        menu = "".join(f'<li><a href="/{i}">Page {i}</a></li>' for i in range(5))
        return f"<body><div{part('menu')}><ul>{menu}</ul></div><div{part('ad')}>Buy cheap shoes.</div><{body}><h1>The old mill</h1>{text}</{body}><div{part('footer')}>Contact us</div></body>"

    @pytest.mark.parametrize("marked", [True, False])
    @pytest.mark.parametrize("core", [True, False])
    def test_the_cut_decides(self, marked, core):
        """The classifier alone drops the title and a short paragraph, with or without
        names of classes and an article element; the cut keeps them."""
        from panelweave.llm import html

        page = self.page(marked, core)
        assert html.main_text(page).split("\n") == ["The old mill", *self.PROSE]
        found = html.blocks(page)
        alone = [b.text for b in found if html.odds(b, core) >= 0]
        assert core or set(self.PROSE) - set(alone) == {"Yes."} and "The old mill" not in alone

    def test_pages_of_the_table(self, spark):
        """All pages of the smallest table: the text is that of the article element,
        found by a plain pattern; of most even without article elements and classes."""
        import os
        from html import unescape

        from panelweave.llm import html

        path = "/root/testdata/sf0.001/pages.parquet"
        if not os.path.exists(path):
            pytest.skip("no test tables")

        def article(page):
            inside = re.search("<article>(.*?)</article>", re.sub("<!--.*?-->", "", page, flags=re.S), re.S)[1]
            parts = [" ".join(unescape(re.sub("</?b>", "", t.replace("<br>", " "))).split()) for t in re.split("</?(?:h1|p)>", inside)]
            return "\n".join(t for t in parts if t)

        pages = spark.read.parquet(path)
        got = {r.page_id: r.text for r in html.extract(pages).collect()}
        rows = pages.collect()
        assert got == {r.page_id: article(r.html) for r in rows}
        plain = [re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", re.sub(r'\sclass="[^"]*"', "", r.html)) for r in rows]
        right = sum(html.main_text(p) == article(r.html) for p, r in zip(plain, rows))
        assert right >= 0.85 * len(rows)  # the others hold two short lines, or end in a licence line

    def test_table(self, spark):
        from panelweave.llm import html

        df = spark.createDataFrame([(1, "u", self.PAGE, "x"), (2, None, None, "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")
        got = html.extract(df).collect()
        assert sorted((r.page_id, r.n_chars) for r in got) == [(1, len(html.main_text(self.PAGE))), (2, 0), (2, 0)]
        assert html.extract(df.limit(0)).count() == 0


class TestToxicity:
    def labelled(self, spark):
        import random

        rng = random.Random(2)
        rows, marks = [], []
        for i in range(400):
            toxic = i % 5 == 0
            text = prose(rng, 60) + (" you idiot and clown " if toxic else " my friend and guest ") + prose(rng, 60)
            rows.append((i, text))
            marks.append((i, int(toxic)))
        return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")

    def test_held_out_accuracy(self, spark):
        from panelweave.llm import toxicity

        docs, labels = self.labelled(spark)
        got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
        held = [r for r in got.values() if r.held_out]
        assert len(got) == 400 and {r.doc_id for r in held} == {i for i in range(400) if crc(i, 5) == 0}
        assert all(r.predicted == int(r.doc_id % 5 == 0) for r in held)

    def test_awkward(self, docs, none, rows, spark):
        from panelweave.llm import toxicity

        _, labels = self.labelled(spark)
        got = toxicity.classify(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        empties = {round(r.score, 12) for r in got if r.doc_id in (100, 101, 102)}
        assert len(empties) == 1
        assert toxicity.classify(none, labels).count() == 0
        assert all(r.score < 1e-20 and r.predicted == 0 for r in toxicity.classify(docs, labels.limit(0)).collect())
        assert all(r.score == 1.0 for r in toxicity.classify(docs, labels.filter("toxic = 1")).collect())

    def test_logistic_finds_the_optimum(self):
        from panelweave.llm.toxicity import logistic

        rng = np.random.default_rng(0)
        x = rng.integers(0, 2, (300, 4)).astype(float)
        y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [2, -1, 0, 0.5] - 0.5)))).astype(float)
        r, c = np.nonzero(x)
        ratio = np.array([1.0, -0.5, 2.0, 0.7])
        for part in (64, 10**6):
            w, b = logistic(np.bincount(r, minlength=300), c, ratio, y, ridge=1e-3, rounds=3000, part=part)
            p = 1 / (1 + np.exp(-(x * ratio @ w + b)))
            assert np.abs((x * ratio).T @ (p - y) / 300 + 1e-3 * w).max() < 1e-4


class TestTokens:
    def path(self):
        return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")

    def test_counts(self, docs, none, rows):
        from panelweave.llm import tokens

        plain = tokens.load(self.path())
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, self.path(), chunk=2000, overlap=64).collect())
        exp = []
        for doc_id, text, *_ in rows:
            n = len(plain.encode(text or "", add_special_tokens=False).ids)
            exp.append((str(doc_id), len((text or "").encode()), n, n > 2048))
        assert got == sorted(exp)
        assert tokens.count_tokens(none, self.path()).count() == 0

    @given(st.text(alphabet=st.sampled_from(list("ab'sé \n̈🤦<|endoftext|>1#")), min_size=0, max_size=400))
    @settings(max_examples=150, deadline=None)
    def test_splicing_is_exact(self, text):
        from panelweave.llm import tokens

        counted = tokens.Counted(self.path(), chunk=40, overlap=8)
        whole = len(counted.tokenizer.encode(text, add_special_tokens=False).ids)
        assert tokens.count_huge(counted.tokenizer, text, 40, 8) == whole
        assert counted.counts([text]) == [whole]


class TestMixing:
    def brute_targets(self, sizes):
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        left, capped = 1.5 * sum(sizes.values()), {}
        while True:
            free = [s for s in order if s not in capped]
            total = sum(weight[s] for s in free)
            over = [s for s in free if left * weight[s] / total > 2 * sizes[s] + 1e-9]
            if not over:
                return capped | {s: left * weight[s] / total for s in free}
            for s in over:
                capped[s] = 2.0 * sizes[s]
            left = 1.5 * sum(sizes.values()) - sum(capped.values())

    def test_takings(self, docs, none, rows):
        from panelweave.llm import mixing

        got = mixing.takings(docs).collect()
        sizes, taken, target = defaultdict(int), defaultdict(int), {}
        source = {r[0]: r[3] for r in rows}
        for doc_id, text, _, s, *_ in rows:
            sizes[s] += len(words(text))
        expected = self.brute_targets(sizes)
        for r in got:
            taken[source[r.doc_id]] += r.taken
            target[source[r.doc_id]] = r.target
            assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[source[r.doc_id]]
        assert len(got) == len(rows)
        for s in sizes:
            assert target[s] == pytest.approx(expected[s]) and abs(taken[s] - expected[s]) <= max(2, 0.01 * expected[s])
        assert sorted(map(str, got)) == sorted(map(str, mixing.takings(docs.repartition(7)).collect()))
        assert mixing.takings(none).count() == 0

    def test_many_shards(self, docs):
        from panelweave.llm import mixing

        got = mixing.mix(docs, shard_words=500, block_words=7).select("source", "target", "size", "taken", "pieces").collect()
        taken, target = Counter(), {}
        for r in got:
            assert r.taken == sum(p.words * p.times for p in r.pieces or []) and all(0 <= p.first and p.first + p.words <= r.size for p in r.pieces or [])
            taken[r.source] += r.taken
            target[r.source] = r.target
        assert all(abs(taken[s] - t) <= max(10, 0.02 * t) for s, t in target.items())

    def test_texts_hold_the_words_taken(self, docs, none):
        from panelweave.llm import mixing

        count = lambda df: df.select(F.sum(F.size(F.filter(F.split("text", mixing.word_count.__globals__["SPACE"]), lambda w: w != "")))).first()[0]
        mixed = mixing.mixed_texts(docs)
        assert count(mixed) == mixing.takings(docs).agg(F.sum("taken")).first()[0]
        assert mixed.columns == docs.columns and mixing.mixed_texts(none).count() == 0

    @pytest.mark.parametrize("copies", [1, 4])
    def test_texts_are_passages_at_every_size(self, docs, rows, spark, copies):
        """Most texts are whole; the others are stretches of their document, two to a shard at most."""
        from panelweave.llm import mixing

        more = docs.filter("doc_id IS NOT NULL").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        more = more.withColumns({"doc_id": F.col("doc_id") * 10 + F.col("k"), "text": F.concat("text", F.lit(" "), F.col("k").cast("string"))}).drop("k")
        source = defaultdict(set)
        for r in more.collect():
            source[r.doc_id].add(r.text)
        mixed = mixing.mixed_texts(more).collect()
        assert all(any(r.text in t for t in source[r.doc_id] if t) for r in mixed)
        cut = [r for r in mixed if r.text not in source[r.doc_id]]
        assert len(cut) <= 3 * more.select("source").distinct().count()

    def test_apportionment(self, spark):
        from panelweave.llm import mixing

        votes = [("a", 53.0), ("b", 24.0), ("c", 23.0), ("d", 0.4)]
        df = spark.createDataFrame(votes, "s string, v double")
        for seats in (1, 7, 100):
            got = {r.s: r.quota for r in mixing.apportion(df, [], F.col("v"), F.lit(seats), ["s"]).collect()}
            won = Counter()
            for _ in range(seats):
                won[max(votes, key=lambda x: x[1] / (2 * won[x[0]] + 1))[0]] += 1
            assert got == {s: won[s] for s, _ in votes}


class TestSimhash:
    def brute(self, rows):
        from xxhash import xxh64_intdigest

        prints = []
        for _, text, *_ in rows:
            w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
            grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
            h = [xxh64_intdigest(g.encode(), 42) for g in grams]
            prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
        root = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    a, b = root[i], root[j]
                    root = [min(a, b) if r in (a, b) else r for r in root]
        low = {}
        for i, r in enumerate(root):
            if rows[i][0] is not None:
                low[r] = min(low.get(r, 1 << 60), rows[i][0])
        return sorted((str(rows[i][0]), f"{prints[i]:016x}", low.get(r)) for i, r in enumerate(root))

    def test_groups(self, docs, none, rows):
        from panelweave.llm import simhash

        got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
        assert got == self.brute(rows)
        assert simhash.near_duplicates(none).count() == 0

    @pytest.mark.parametrize("radius", [1, 2, 3, 6])
    @pytest.mark.parametrize("width", [1, 2])
    def test_bit_sliced_pairs(self, radius, width):
        from panelweave.llm.bitslice import close_pairs

        rng = np.random.default_rng(radius)
        n = 900
        bucket = np.sort(rng.integers(0, 20, n))
        base = rng.integers(0, 1 << 63, (15, width), np.uint64)[rng.integers(0, 15, n)]
        for _ in range(4):
            base = base ^ np.where(rng.random((n, width)) < 0.4, np.uint64(1) << rng.integers(0, 64, (n, width)).astype(np.uint64), np.uint64(0))
        got = {(int(i), int(j)) for a, b in close_pairs(bucket, base, radius, 1000) for i, j in zip(a, b)}
        distance = lambda i, j: sum(int(x).bit_count() for x in base[i] ^ base[j])
        assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if bucket[i] == bucket[j] and distance(i, j) <= radius}

    def test_full_buckets_are_cut_without_loss(self, spark):
        from panelweave.llm.bitslice import links
        from panelweave.llm.common import components

        rng = np.random.default_rng(3)
        base = int(rng.integers(0, 1 << 62))
        prints = {base}
        for _ in range(400):
            prints.add(base ^ (1 << int(rng.integers(0, 20))) ^ (1 << int(rng.integers(0, 20))) ^ (1 << int(rng.integers(40, 60))))
        df = spark.createDataFrame([(p,) for p in prints], "fp long")
        one, two = (sorted(map(tuple, components(links(df, 2, 4, hot), "t").collect())) for hot in (10**6, 5))
        assert one == two and len(one) > 300

    def test_components(self, spark):
        from panelweave.llm.common import components

        edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (103, 103), (200, 201), (None, 5)]
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "c").collect()}
        assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}

    def test_one_of_each_group_stays(self, docs, none, rows):
        from panelweave.llm import simhash

        kept = sorted(str(r.doc_id) for r in simhash.keep_one(docs).select("doc_id").collect())
        texts = [r[1] for r in rows]
        assert "3" in kept and not {"104", "105", "106"} & set(kept)
        assert kept.count("7") == 1 and len(kept) == len(rows) - 4 - 2  # three copies, the repeated row, two of the empty texts
        assert simhash.keep_one(none).count() == 0 and simhash.keep_one(docs).columns == docs.columns and len(texts) == len(rows)

    def test_similarity_decides(self, spark):
        import random

        from panelweave.llm import simhash

        rng = random.Random(9)
        base = prose(rng, 400).split()
        close = [*base[:200], "other", *base[201:]]
        far = [w if i % 12 else "other" + w for i, w in enumerate(base)]
        df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(close)), (3, " ".join(far))], "doc_id long, text string")
        assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [1, 3]
        groups = [{tuple(sorted(x)) for x in [tuple(r) for r in simhash.similar_groups(df, tile=t).select("th", "root").collect()]} for t in (1, 1000)]
        assert groups[0] == groups[1]

    @pytest.mark.parametrize("n", [1000, 60_000, 10**6, 10**7])
    def test_recall_does_not_depend_on_the_number_of_texts(self, n):
        from panelweave.llm import simhash

        bits, tables, radius = simhash.search_plan(n, 0.8, 0.99)
        masks = np.array(simhash.key_masks(bits, tables), np.uint64)
        assert len(masks) == tables and all(sum(map(int.bit_count, m)) == bits for m in masks.tolist())
        found, pairs = 0, 1000
        for i in range(pairs):  # of 180 shingles in all, 144 are in both sets: a similarity of just 0.8
            a, b = (np.frombuffer(simhash.long_print(" ".join(f"w{i}x{k}" for k in ks).encode(), 1), np.uint64) for ks in (range(162), [*range(144), *range(162, 180)]))
            a_b = a ^ b
            near = int(np.bitwise_count(a_b[:2]).sum()) <= radius
            found += near and bool(((masks & a_b) == 0).all(axis=1).any())
        assert found >= 980

    def test_repeats_do_not_part_like_sets(self, spark):
        import random

        from panelweave.llm import simhash

        rng = random.Random(10)
        rows = []
        for i in range(20):
            text, passage = prose(rng, 300), prose(rng, 60)
            rows += [(2 * i, f"{text} {passage}"), (2 * i + 1, " ".join([text] + [passage] * 8))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == list(range(0, 40, 2))


class TestLanguage:
    def test_held_out(self, spark, none):
        import random

        from panelweave.llm import language

        rng = random.Random(4)
        stock = {"en": ["the", "and", "with", "where", "thing"], "de": ["der", "und", "nicht", "schön", "über"], "zz": ["qixa", "wozu", "pluq", "vexa"]}
        rows = [(i, " ".join(rng.choice(stock[k]) for _ in range(80)), k) for i in range(300) for k in [list(stock)[i % 3]]]
        rows += [(900, None, "en"), (901, " 12 !", "en"), (902, "the and with where", None), (903, "", "de")]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = {r.doc_id: r for r in language.classify(df).collect()}
        assert all(got[i].lang_pred == k for i, t, k in rows[:300]) and got[902].lang_pred == "en"
        assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 903)] == [("und", 0.0)] * 3
        assert all(got[i].held_out == (crc(i, 3) == 1) for i in got) and all(0 <= r.score <= 1 for r in got.values())
        assert language.classify(none.select("doc_id", "text", "lang", "source")).count() == 0

    def test_filters_have_no_false_negatives(self):
        from panelweave.llm import language

        rng = np.random.default_rng(1)
        lang, slot = rng.integers(0, 70, 5000), rng.integers(0, 1 << language.SLOT_BITS, 5000)
        bits = np.zeros((5000, 2), np.uint64)
        bits[np.arange(5000), lang // 64] = np.uint64(1) << (lang % 64).astype(np.uint64)
        f = language.Filters([f"l{i:02}" for i in range(70)], bits, slot)
        sets = f.table[language.cells(slot)[0]] & f.table[language.cells(slot)[1]]
        assert all(int(sets[i, lang[i] // 64]) >> int(lang[i] % 64) & 1 for i in range(5000))

    def test_a_hundred_languages(self, spark):
        import random

        from panelweave.llm import language

        rng = random.Random(7)
        stock = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for i in range(100)}
        rows = [(i, " ".join(rng.choice(stock[k]) for _ in range(60)), k) for i in range(800) for k in [f"l{i % 100:03}"]]
        got = language.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
        assert sum(r.lang_pred == f"l{r.doc_id % 100:03}" for r in got) >= 0.99 * len(got)

    def test_sets_equal_a_plain_count(self, docs, rows):
        """Languages of every n-gram, against counts by dictionary."""
        from panelweave.llm import language
        from panelweave.llm.grams import hashed, letter_codes

        counts = defaultdict(Counter)
        for doc_id, text, lang, *_ in rows:
            if lang and text is not None and crc(doc_id, 3) != 1:
                codes, offsets, _ = letter_codes([text])
                counts[lang].update(hashed(codes, offsets, language.ORDER, language.SLOT_BITS)[1].tolist())
        total = {k: sum(c.values()) for k, c in counts.items()}
        f = language.learn(docs)
        for slot in set().union(*counts.values()):
            rate = {k: c[slot] / total[k] for k, c in counts.items() if c[slot] >= 5}
            exp = {k for k, r in rate.items() if r >= 0.25 * max(rate.values())}
            cells = [f.table[c[0], 0] for c in language.cells(np.array([slot]))]
            got = {k for i, k in enumerate(f.langs) if int(cells[0] & cells[1]) >> i & 1}
            assert exp <= got

    def test_awkward(self, docs, rows):
        from panelweave.llm import language

        got = language.classify(docs).collect()
        assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"en", "de", "und"}


class TestSharding:
    def test_shards(self, docs, none, rows):
        from zlib import crc32

        from panelweave.llm import sharding

        got = sharding.shards(docs).collect()
        count = Counter(r.shard for r in got)
        assert len(got) == len(rows) and max(count.values()) - min(count[j] for j in range(16)) <= 1
        for j, n in count.items():
            assert sorted(r.slot for r in got if r.shard == j) == list(range(n))
        exp = sorted((str(i), len((t or "").encode()) + 1, None if t is None else crc32(t.encode())) for i, t, *_ in rows)
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == exp
        assert sharding.shards(none).count() == 0

    def test_buckets_and_parts(self, spark):
        from panelweave.llm import sharding

        df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("slot"))
        got = sharding.shuffle_into_shards(df, 7, part_rows=100, bucket_rows=50).collect()
        count = Counter(r.shard for r in got)
        assert sorted(count.values()) == [714, 714, 714, 714, 714, 715, 715]
        assert all(sorted(r.slot for r in got if r.shard == j) == list(range(n)) for j, n in count.items())
        # no shard favours a stretch of ids
        mean = [np.mean([r.doc_id for r in got if r.shard == j]) for j in range(7)]
        assert max(abs(m - 2500) for m in mean) < 5 * 1443 / 714**0.5

    def test_matrix(self):
        from panelweave.llm import sharding

        matrix = sharding.communication_matrix([5, 0, 13, 7, 1000], 4, 3)
        assert [sum(r) for r in matrix] == [5, 0, 13, 7, 1000] and sorted(map(sum, zip(*matrix))) == [256, 256, 256, 257]

    def test_hypergeometric_law(self):
        import random

        from panelweave.llm.sharding import hypergeometric

        rng = random.Random(0)
        drawn = [hypergeometric(rng, 30, 70, 20) for _ in range(20000)]
        assert np.mean(drawn) == pytest.approx(6, abs=0.06) and np.var(drawn) == pytest.approx(20 * 0.3 * 0.7 * 80 / 99, abs=0.15)
        assert hypergeometric(rng, 0, 5, 3) == 0 and hypergeometric(rng, 5, 0, 3) == 3 and hypergeometric(rng, 2, 3, 5) == 2


class TestLines:
    def test_exact_and_fuzzy(self, spark):
        import random

        from panelweave.llm import linededup

        rng = random.Random(8)
        line = prose(rng, 60)
        near = line.replace(line.split()[30], "swapped", 1)
        other = prose(rng, 60)
        df = spark.createDataFrame([(1, f"{line}\n{other}\nshort one"), (2, f"{line.upper()}!\nshort one\n\n{prose(rng, 40)}"), (3, near), (4, None), (5, ""), (6, f"{other}\n{other}")], "doc_id long, text string")
        got = {r.doc_id: (r.n_lines, r.removed) for r in linededup.verdicts(df).collect()}
        assert got[1] == (3, []) and got[2] == (3, [0]) and got[3] == (1, [0]) and got[6] == (2, [0, 1])
        assert 4 not in got and 5 not in got
        clean = {r.doc_id: r.text for r in linededup.dedup(df).collect()}
        assert clean[6] == "" and clean[4] is None and clean[5] == "" and clean[1] == f"{line}\n{other}\nshort one"

    def test_recall_at_the_defaults(self, spark):
        """Lines of 8 to 80 words with words changed, left out and put in, against
        the edit similarity of all pairs."""
        import random

        from panelweave.llm import linededup

        rng = random.Random(14)
        lines = []
        for i in range(150):
            line = prose(rng, (8, 15, 30, 80)[i % 4]).split()
            lines.append(line)
            for _ in range(2):
                near = list(line)
                for _ in range(rng.choice((1, 1, 2)) * len(line) // 15 + 1):
                    k = rng.randrange(len(near))
                    near[k : k + 1] = rng.choice(([], ["swapped"], [near[k], "added"]))
                lines.append(near)
        texts = [" ".join(x) for x in lines]
        pairs = [(i, j) for i in range(len(texts)) for j in range(i) if abs(len(texts[i]) - len(texts[j])) < 40 and texts[i] != texts[j] and linededup.alike(texts[i], texts[j], 0.8)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        gone = {r.doc_id for r in linededup.verdicts(df).filter(F.size("removed") > 0).collect()}
        found = [i in gone or j in gone for i, j in pairs]
        assert len(pairs) > 150 and sum(found) >= 0.9 * len(pairs)
        root = list(range(len(texts)))  # nothing goes that is not linked to a line that stays
        for i, j in pairs:
            root = [root[j] if r == root[i] else r for r in root]
        assert all(any(root[k] == root[i] and k not in gone for k in range(len(texts))) for i in gone)

    def test_no_link_is_left_out(self, spark):
        """Lines with characters changed, left out and put in all over, which move most
        words and many bits of a SimHash, against all pairs."""
        import random

        from panelweave.llm import linededup

        rng = random.Random(16)
        texts = []
        for i in range(80):
            line = prose(rng, (6, 12, 25, 60)[i % 4])
            texts.append(line)
            for share in (0.05, 0.1, 0.16, 0.21):
                near = list(line)
                for _ in range(int(share * len(near))):
                    k = rng.randrange(len(near))
                    near[k : k + 1] = rng.choice(([], [rng.choice("xyzéß漢")], [near[k], rng.choice("uvw")]))
                texts.append("".join(near))
        texts = [t for t in map(linededup.normal, texts) if t.count(" ") >= 4]  # shorter ones always stay
        rng.shuffle(texts)
        root = list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                if linededup.alike(texts[i], texts[j], 0.8) and root[i] != root[j]:
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for options in ({}, {"tile": 40}):
            gone = {r.doc_id for r in linededup.verdicts(df, **options).filter(F.size("removed") > 0).collect()}
            assert gone == {i for i, r in enumerate(root) if r != i} and len(gone) > 200

    def test_tiles_meet_without_a_shuffle(self, spark):
        """Rows shuffled grow as the lines, not as lines times the tiles that they meet."""
        import random

        from panelweave.llm.editjoin import similar
        from panelweave.llm.linededup import alike

        def shuffled():
            jvm, sc = spark._jvm, spark.sparkContext
            none = jvm.java.util.ArrayList()
            stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(jvm.double, 0), none)
            return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

        rng = random.Random(17)
        texts = [prose(rng, 12) for _ in range(400)]
        texts += [t.replace("the", "thx") for t in texts[:5]]
        lines = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "h long, root long, text string")
        before = shuffled()
        found = {frozenset(r) for r in similar(lines, 0.8, alike, tile=40).collect()}
        assert shuffled() - before < 4 * len(texts)
        due = [(i, j) for i in range(len(texts)) for j in range(i) if alike(texts[i], texts[j], 0.8)]
        assert found == {frozenset(p) for p in due} and len(found) >= 4
        assert similar(lines.limit(0), 0.8, alike).count() == 0

    def test_one_large_cluster_in_tiles(self, spark):
        import random

        from panelweave.llm import linededup

        rng = random.Random(15)
        base = prose(rng, 40).split()
        rows = [(i, " ".join([*base[: i % 40], f"w{i}", *base[i % 40 + 1 :]])) for i in range(120)] + [(500, prose(rng, 40))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for options in ({}, {"tile": 16}):
            gone = {r.doc_id for r in linededup.verdicts(df, **options).filter(F.size("removed") > 0).collect()}
            assert gone == set(range(1, 120))

    def test_full_buckets_meet_in_tiles(self, spark):
        from panelweave.llm.bitslice import key_plan, packed_buckets
        from panelweave.llm.linededup import _clusters

        rng = np.random.default_rng(5)
        prints = [(int(f) ^ (1 << int(b)), 7) for f in rng.integers(0, 1 << 62, 30) for b in rng.integers(0, 60, 8)]
        df = spark.createDataFrame(list(set(prints)), "f0 long, f1 int")
        masks = key_plan(1000, 0.9, 0.9, 256)
        whole, cut = ({r.f0 for r in packed_buckets(df, masks, _clusters(4), slot_rows=50, hot=hot).collect()} for hot in (10**6, 4))
        assert whole == cut and len(whole) > 200

    def test_awkward(self, docs, none, rows):
        from panelweave.llm import linededup

        assert linededup.dedup(docs).count() == len(rows) and linededup.dedup(docs).columns == docs.columns
        assert linededup.verdicts(none).count() == 0

    @given(st.text(alphabet="abc ", max_size=70), st.text(alphabet="abc ", max_size=70))
    @settings(max_examples=200, deadline=None)
    def test_edit_distance(self, a, b):
        from panelweave.llm.linededup import alike, edit_distance

        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        assert edit_distance(a, b) == row[-1]
        assert alike(a, b, 0.8) == (row[-1] <= int(0.2 * max(len(a), len(b)) + 1e-9))

    def test_bit_sums(self):
        from panelweave.llm.linededup import bit_sums

        h = np.random.default_rng(0).integers(0, 1 << 63, 1000, np.uint64)
        first, count = np.array([0, 10, 500]), np.array([10, 490, 500])
        exp = [[int((h[a : a + n] >> np.uint64(k) & np.uint64(1)).sum()) for k in range(64)] for a, n in zip(first, count)]
        assert (bit_sums(h, first, count) == exp).all() and (bit_sums(h, first, count, 7) == exp).all()


class TestDecontamination:
    def test_planted(self, spark):
        import random

        from panelweave.llm import decontaminate

        rng = random.Random(6)
        items = [(i, prose(rng, 14 + i)) for i in range(20)] + [(50, "four words stand here"), (51, None), (52, "")]
        rows = []
        for i, text in items[:20]:
            w = text.split()
            w[5], w[11] = "changed", "again"
            rows.append((i, prose(rng, 50) + " " + " ".join(w).upper().replace(" ", ",  ") + " " + prose(rng, 50)))
        rows += [(100, "here " + items[20][1] + " too"), (101, prose(rng, 300)), (102, None), (103, ""), (104, " ".join(items[3][1].split()[:8]))]
        docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
        assert got == {(i, i) for i in range(20)} | {(100, 50)}
        assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench, block_items=5).collect()} == got
        assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [101, 102, 103, 104]
        assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.matches(docs.limit(0), bench).count() == 0

    def test_awkward(self, docs, rows, spark):
        from panelweave.llm import decontaminate

        bench = spark.createDataFrame([(1, rows[5][1], "x")], "item_id long, text string, th string")
        assert {r.doc_id for r in decontaminate.matches(docs, bench).collect()} == {5}

    def test_repeated_items_and_bounded_blocks(self, spark):
        import random

        from panelweave.llm import decontaminate

        rng = random.Random(13)
        text = prose(rng, 30)
        bench = spark.createDataFrame([(i, text) for i in range(3000)] + [(5000 + i, prose(rng, 20)) for i in range(200)], "item_id long, text string")
        docs = spark.createDataFrame([(1, f"{prose(rng, 20)} {text} {prose(rng, 20)}"), (2, prose(rng, 60))], "doc_id long, text string")
        got = decontaminate.matches(docs, bench, block_items=50).collect()
        assert {r.doc_id for r in got} == {1} and sorted(r.item_id for r in got) == list(range(3000))
        texts = decontaminate.different_texts(bench)
        blocks = list(decontaminate._blocks(texts, 50, 700))
        assert sum(map(len, blocks)) == 201 and all(len(b) <= 50 and (len(b) == 1 or sum(len(t.split()) for _, t in b) <= 700) for b in blocks)

    @pytest.mark.parametrize("words_of, least", [(8, 0.7), (12, 0.95), (20, 0.99)])
    def test_recall_with_a_fifth_substituted(self, words_of, least):
        """Places of items with substitutions up to the identity, against comparing
        every place word by word; items under ten words are looked up whole."""
        import random

        import pyarrow as pa

        from panelweave.llm.common import utf8
        from panelweave.llm.decontaminate import MASKS, Items
        from panelweave.llm.wordhash import words as hashed_words

        rng = random.Random(words_of)
        found = 0
        for _ in range(300):
            item = prose(rng, words_of).split()
            copy = list(item)
            for k in rng.sample(range(words_of), words_of // 5 if words_of >= max(map(len, MASKS)) else 0):
                copy[k] = "other"
            text = f"{prose(rng, 15)} {' '.join(copy)} {prose(rng, 15)}"
            h, _, row = hashed_words(*utf8(pa.array([text])))
            found += any(True for _ in Items.of([(1, " ".join(item))]).overlaps(h, row, 12, 0.8))
        assert found >= least * 300

    def test_item_across_two_rows(self, spark):
        import random

        from panelweave.llm import decontaminate

        rng = random.Random(12)
        item = prose(rng, 40).split()
        rows = [(1, prose(rng, 30) + " " + " ".join(item[:20])), (2, " ".join(item[20:]) + " " + prose(rng, 30))]
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
        got = sorted((r.doc_id, r.first_word, r.n_words) for r in decontaminate.matches(docs, bench).collect())
        assert [(d, n >= 20) for d, _, n in got] == [(1, True), (2, True)] and got[1][1] == 0
        assert decontaminate.clean(docs, bench).count() == 0

    @pytest.mark.parametrize("period", [1, 2, 7])
    def test_repeated_words_make_no_product(self, period):
        import resource
        import time

        import pyarrow as pa

        from panelweave.llm.common import utf8
        from panelweave.llm.decontaminate import Items
        from panelweave.llm.wordhash import words as hashed_words

        word = [f"w{k}" for k in range(period)]
        item, text = " ".join(word[k % period] for k in range(5000)), " ".join(word[k % period] for k in range(20_000))
        h, _, row = hashed_words(*utf8(pa.array(["some other words", text])))
        before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
        found = list(Items.of([(1, item), (2, "quite another text of more than ten words that is not there")]).overlaps(h, row, 12, 0.8))
        assert time.perf_counter() - began < 5 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
        assert [(r, key, n, same) for r, key, _, n, same in found] == [(1, 1, 5000, 5000)]

    def test_dense_pairs_give_what_all_places_give(self):
        import random

        import pyarrow as pa

        from panelweave.llm import decontaminate
        from panelweave.llm.common import utf8
        from panelweave.llm.wordhash import words as hashed_words

        seen = 0
        for seed in range(20):
            rng = random.Random(seed)
            make = lambda n: " ".join("a" if rng.random() < 0.93 else rng.choice("bcdef") for _ in range(n))  # noqa: B023, E731
            items, texts = [(k, make(40)) for k in range(3)], [make(120) for _ in range(3)]
            h, _, row = hashed_words(*utf8(pa.array(texts)))
            best = {}
            for key, text in items:
                mine, *_ = hashed_words(*utf8(pa.array([text])))
                for r in range(3):
                    own = h[row == r]
                    for start in range(-39, 120):
                        low, high = max(start, 0), min(start + 40, 120)
                        x, y = decontaminate.longest_stretch(own[low:high] == mine[low - start : high - start], 0.8)
                        if y - x >= 12:
                            best[r, key] = max(best.get((r, key), 0), y - x)
            got = {}
            for r, key, _, n, _ in decontaminate.Items.of(items).overlaps(h, row, 12, 0.8):
                got[r, key] = max(got.get((r, key), 0), n)
            assert set(got) <= set(best) and all(got[k] <= best[k] for k in got)
            _, dense = decontaminate.Items.of(items).hits(h, row)
            assert all(got.get((r, items[i][0])) == best.get((r, items[i][0])) for i, r in dense.tolist())
            seen += len(dense)
        assert seen > 20

    @given(st.lists(st.booleans(), max_size=40))
    @settings(max_examples=200, deadline=None)
    def test_longest_stretch(self, flags):
        from panelweave.llm.decontaminate import longest_stretch

        a, b = longest_stretch(np.array(flags, bool), 0.8)
        best = max([j - i for i in range(len(flags) + 1) for j in range(i, len(flags) + 1) if sum(flags[i:j]) * 10 >= 8 * (j - i)])
        assert b - a == best and sum(flags[a:b]) * 10 >= 8 * (b - a)


class TestLostText:
    """Elements whose end is missing, or that hold words, cost no text around them."""

    LONG = "It stands in the article with quite enough of its own words to be kept there."

    @pytest.mark.parametrize("inside", ["<svg/>", "<svg viewBox='0 0 1 1' />", "<svg><text>label</text></svg>", "<object data=x>", "<object data='x'></object>", "<iframe src=x></iframe>", "<select><option>a</select>", "<math></math>"])
    def test_paragraphs_around(self, inside):
        from panelweave.llm.html import main_text

        page = f"<html><body><article><p>{self.LONG}</p>{inside}<p>{self.LONG} Again.</p></article></body></html>"
        assert main_text(page) == f"{self.LONG}\n{self.LONG} Again."

    @pytest.mark.parametrize("tag", ["svg", "select", "iframe", "noscript"])
    def test_without_an_end_they_stop_with_their_parent(self, tag):
        from panelweave.llm.html import main_text

        page = f"<body><article><p>{self.LONG}</p><div><{tag}>gone</div><p>{self.LONG} Again.</p></article></body>"
        assert main_text(page) == f"{self.LONG}\n{self.LONG} Again."

    def test_words_of_formulas_and_fallbacks_stay(self):
        from panelweave.llm.html import main_text

        page = f"<article><p>{self.LONG} So <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> holds.</p><object data=f><p>{self.LONG} As a fallback.</p></object></article>"
        assert main_text(page) == f"{self.LONG} So x = 2 holds.\n{self.LONG} As a fallback."

    def test_deep_nesting_takes_linear_time(self):
        import time

        from panelweave.llm.html import main_text

        for opened, closed in (("".join(f"<x{i % 7}>" for i in range(50_000)), ""), ("<div>" * 50_000, "</section>" * 50_000), ("<li>" * 50_000, "")):
            began = time.perf_counter()
            assert main_text(f"<article>{opened}<p>{self.LONG}</p>{closed}</article>") == self.LONG
            assert time.perf_counter() - began < 2


def test_columns_of_any_name_pass_through(docs, spark):
    from panelweave.llm import decontaminate, linededup, mixing, sharding, simhash

    names = ["_id", "_th", "removed", "row", "part", "upto", "_order", "_place", "target", "taken", "pieces", "words", "blocks", "root", "node", "th", "_row"]
    df = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    bench = spark.createDataFrame([(1, "no such passage is in any of these documents at all")], "item_id long, text string")
    for out in (simhash.keep_one(df), decontaminate.clean(df, bench), linededup.dedup(df), mixing.mixed_texts(df), sharding.shuffle_into_shards(df)):
        assert [c for c in out.columns if c not in ("shard", "slot")] == [c for c in df.columns if c not in ("shard", "slot")]
        for r in out.filter("doc_id IS NOT NULL").collect():
            assert all(r[n] == f"{n}{r.doc_id}" for n in names) and r["size"] == "clash"


def test_near_copies_link_in_proportion(spark):
    """A large group of near copies gives some links for each text, not one for each key that two of them share."""
    from panelweave.llm import simhash
    from panelweave.llm.common import components

    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in simhash.PRINT]
    flip = lambda word: word ^ sum({1 << rng.randrange(64) for _ in range(4)})
    signed = lambda word: word - (1 << 64) if word >> 63 else word
    rows = [tuple(signed(flip(w)) for w in base) + (th,) for th in range(400)]
    nodes = spark.createDataFrame(rows, ", ".join(f"{f} long" for f in simhash.PRINT) + ", th long")
    links = simhash.candidate_links(nodes, 100_000, 0.8, 0.99)
    found = links.distinct().collect()
    assert {r.root for r in components(links, "t").collect()} == {0} and len({x for r in found for x in r}) == 400
    assert len(found) < 2 * 400
