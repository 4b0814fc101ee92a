"""The pipeline's stages over the smallest tables against brute force."""

import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile("[a-z0-9\u0080-\U0010ffff]+")


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returns, with rows of null ids, null and empty texts and repeats put in."""
    import corpus_pipeline
    from panelweave.functions.shared import settle

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    odd = spark.createDataFrame([(None, "a short text of no id, written for this test alone", None, None, 50), (900001, None, "en", "src1", None), (900002, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.filter("doc_id < 3"))
    found = [("input", docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SF), name)
        found.append((name, docs.collect()))
        if name != "sharding":
            assert docs.columns == corpus_pipeline.COLUMNS
    return dict(found)


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_toxic_documents_go(kept, spark):
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    stay = {r.doc_id for r in kept["toxicity"]}
    assert len(toxic & stay) <= 0.2 * len(toxic) and len(clean - stay) <= 0.05 * len(clean)


def test_one_of_each_near_group_stays(kept):
    rows = kept["toxicity"]
    sets = [shingles(r.text) for r in rows]
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    near = set()
    for group in at.values():
        near |= {(a, b) for a in group[:40] for b in group[:40] if a < b}
    root = list(range(len(rows)))
    for a, b in sorted(near) + [(i, j) for i in range(len(rows)) for j in range(i) if not sets[i] and not sets[j]]:
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            root = [root[a] if r == root[b] else r for r in root]
    groups = len(set(root))
    assert len(kept["near_dedup"]) <= groups + 0.02 * len(rows) and len(kept["near_dedup"]) >= groups
    assert {r.doc_id for r in kept["near_dedup"]} <= {r.doc_id for r in rows}


def test_leaked_passages_go(kept, spark):
    """All of an item, or 12 of its words running, as plain words."""
    words = lambda text: PLAIN.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 12]) for w in items for i in range(max(1, len(w) - 11)) if w}
    short = {len(g) for g in grams}
    leaked = lambda text: any(tuple(w[i : i + n]) in grams for w in [words(text)] for n in short for i in range(len(w) - n + 1))
    assert not [r.doc_id for r in kept["decontamination"] if leaked(r.text)]
    gone = {r.doc_id for r in kept["near_dedup"]} - {r.doc_id for r in kept["decontamination"]}
    exact = {r.doc_id for r in kept["near_dedup"] if leaked(r.text)}
    assert exact <= gone and len(gone - exact) <= 0.1 * len(kept["near_dedup"])


def test_mixed_texts_are_whole_or_passages(kept):
    texts = defaultdict(set)
    for r in kept["decontamination"]:
        texts[r.doc_id].add(r.text)
    rows = kept["mixing"]
    assert all(any(r.text in t for t in texts[r.doc_id] if t) for r in rows)
    assert sum(r.text in texts[r.doc_id] for r in rows) >= 0.8 * len(rows)
    size = lambda rs: sum(len(WORD.findall(r.text or "")) for r in rs)
    assert size(rows) == pytest.approx(1.5 * size(kept["decontamination"]), rel=0.02)


def test_shards_are_even_and_hold_the_mix(kept):
    rows = kept["sharding"]
    count = Counter(r.shard for r in rows)
    assert len(count) == 16 and max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in count.items())
    plain = lambda rs: sorted(map(str, (tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rs)))
    assert plain(rows) == plain(kept["mixing"])


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_is_the_stages_one_after_another(spark):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, SF)
    assert found.columns == [*corpus_pipeline.COLUMNS, "shard", "slot"] and found.agg(F.max("shard")).first()[0] == 15
