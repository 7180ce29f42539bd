"""Operators over whole tables against brute force, with the cases that each defines."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from loomgrid.core.lineage import components
from loomgrid.llm import embedding, lm, neardup, toxicity

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == roots({*range(41), 100, 101, 102}, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    random.seed(3)
    pool = [f"w{i}" for i in range(300)]
    texts = {0: None, 1: "", 2: "  ", 3: "one two", 4: "One two", 5: "a b c d"}
    base = [random.choice(pool) for _ in range(120)]
    for i in range(10, 90):  # a chain: each is a small change of one before
        t = list(base if i % 9 == 0 else texts[i - 1].split() if i > 10 else base)
        for _ in range(random.randint(0, 5)):
            t[random.randrange(len(t))] = random.choice(pool)
        texts[i] = " ".join(t)
    rows = [(i, t, 1) for i, t in texts.items()] + [(10, texts[10], 1), (None, "a b c d", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(set(sets), links)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 16))
    x[50:100] = x[:50] + 0.12 * rng.normal(size=(50, 16))
    x[100:110] = x[0]
    rows = [(i, [float(np.float32(v)) for v in r], i % 2 if i < 140 else None) for i, r in enumerate(x)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [None] * 16, 0), (204, [1.0, 2.0], 0), (205, [1.0, 2.0], 0), (206, [], 1), (207, [2.0, 4.1], 0), (208, [3.0], 1), (209, [5.0], 1), (210, [-5.0], 1), (None, [5.0], 1), (211, [1.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [(i, np.array(v, np.float64), y) for i, v, y in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / math.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.98]
    want, n = roots({r[0] for r in rows}, links), collections.Counter(x for p in links for x in p)
    got = embedding.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(9001, None), (9002, ""), (9002, "")], "doc_id long, text string"))
    texts = [(r.doc_id, [*words(r.text), None]) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in texts if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = {i: (held(i), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for i, t in texts}
    got = lm.score(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6 * max(1, -w[4])
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert lm.score(docs.limit(0)).count() == 0


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    w = rng.normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32)
    rows = rng.integers(0, lm.ROWS, size=(20, 4))
    assert np.allclose(np.exp(lm.log_softmax(w, rows)).sum(1), 1, atol=1e-5)


def toxic_rows():
    random.seed(5)
    plain = [f"word{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(400):
        t = [random.choice(plain) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                t[random.randrange(30)] = random.choice(["vile", "nasty", "awful", "foul"])
        rows.append((i, " ".join(t), "s"))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    rows += [(1000, None, "s"), (1001, "", "s"), (None, "vile nasty", "s"), (3, rows[3][1], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __toxicity string")
    known = spark.createDataFrame([*labels, (None, 1), (5000, 1), (7, None)], "doc_id long, toxic int")
    index = toxicity.fit(docs, known)
    got = toxicity.score(docs, index).select("doc_id", "text", "__toxicity.*").collect()
    assert len(got) == len(rows)
    y = dict(labels)
    tested = [r for r in got if r.held_out and r.doc_id in y]
    assert len(tested) > 50 and all(r.predicted == y[r.doc_id] for r in tested)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.predicted for r in got if not r.text} == {0}
    # block-max traversal gives the cosines of a plain scan
    dense = np.zeros((len(index.ids), len(index.vocabulary)))
    for t in range(len(index.vocabulary)):
        a, b = index.starts[t, 0], index.starts[t, -1]
        dense[index.example[a:b], t] = index.weight[a:b]
    q = np.zeros(len(index.vocabulary))
    q[:3] = [0.2, 0.5, 0.8]
    i, c = index.nearest(np.arange(3), q[:3])
    assert np.allclose(c, np.sort(dense @ q)[::-1][: len(c)])
    # a text without a term of the vocabulary has only an equal text for a neighbour
    one = next(i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 3 != 1)
    more = spark.createDataFrame([*rows, (one, "seen once only", "s"), (3000, "seen once only", "s"), (3001, "seen once", "s")], docs.schema)
    odd = toxicity.score(more, toxicity.fit(more, known.unionByName(spark.createDataFrame([(one, 1)], known.schema)))).filter("doc_id >= 3000").select("doc_id", "__toxicity.*")
    found = {r.doc_id: r for r in odd.collect()}
    assert (found[3000].neighbours, found[3000].cosines, found[3001].neighbours) == ([one], [1.0], []) and found[3000].score > found[3001].score
    none = toxicity.fit(docs, known.limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).select("__toxicity.*").collect()} == {0}
    assert toxicity.score(docs.limit(0), index).count() == 0


@pytest.mark.parametrize("case", ["full", "empty"])
def test_pipeline_stages(spark, tmp_path, case):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60")
    docs = docs.unionByName(docs.filter("doc_id < 3")) if case == "full" else docs.limit(0)
    at = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in at.select("doc_id").collect()}
        out = stage(spark, at, SF)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        assert {r.doc_id for r in out.select("doc_id").collect()} <= before
        at = out
    left = spark.read.parquet(str(tmp_path / "2"))
    assert left.count() == left.select("doc_id").distinct().count()
    assert (at.count() > 0) == (case == "full")


def test_word_groups_are_languages(spark):
    rng = random.Random(4)
    tongues = [[f"{x}{i}" for i in range(150)] for x in "abc"]
    rows = [(" ".join(rng.choices(t, [1 / (k + 1) for k in range(150)], k=60)),) for t in tongues for _ in range(60)]
    counts = collections.Counter(w for (t,) in rows for w in t.split())
    by_count = sorted(counts, key=lambda w: (-counts[w], w))
    from loomgrid.llm._text import hash_word

    groups = lm.word_groups(spark.createDataFrame(rows, "text string"), np.array([hash_word(w.encode()) for w in by_count], np.uint64))
    of = collections.defaultdict(set)
    for w, g in zip(by_count, groups.tolist(), strict=True):
        of[g].add(w[0])
    assert all(len(x) == 1 for x in of.values()) and set().union(*of.values()) == set("abc")
    k = lm.head_classes(np.array([counts[w] for w in by_count]), groups)
    assert len(set(k[: lm.OWN].tolist())) == lm.OWN and k.max() < lm.CLASSES - 1 and k.min() == 0
