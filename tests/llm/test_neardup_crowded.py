"""Near copies whose common part is mostly a passage that many unlike texts share, and ids with several texts."""

import random
import re

import pytest

from loomgrid.llm import neardup
from tests.llm.test_corpus import roots, words


def brute(rows, percent=80):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)))
    links = [
        (a, b) for a in sets for b in sets if a < b
        and any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])
    ]
    return roots(set(sets), links), links


@pytest.mark.parametrize("crowd", [8, 64])
def test_links_of_crowded_lists(spark, monkeypatch, crowd):
    monkeypatch.setattr(neardup, "CROWD", crowd)
    monkeypatch.setattr(neardup, "LEADERS", 1)
    rng = random.Random(5)
    passage = [f"q{i}" for i in range(400)]
    rows = []
    for i in range(0, 300, 2):  # the passage is from a third to seven eighths of each text
        taken = passage[: rng.choice([40, 100, 250, 400])]
        n_own = int(len(taken) * rng.choice([0.15, 0.2, 0.3, 0.5, 1, 2]))
        own = [f"s{i}_{k}" for k in range(n_own)]
        changed = own[: max(0, n_own - rng.randrange(1, 2 + len(taken) // 4))]
        rows += [(i, " ".join(taken + own)), (i + 1, " ".join(taken + changed + [f"t{i}"]))]
    want, links = brute(rows)
    assert len(links) > 50 and len(set(want.values())) > 80
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_an_id_with_several_texts_is_one_node(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b), (9, b), (9, c), (12, c.replace("c59", "other")), (20, "one text of its own")] + [(30, a + " x " + b)] * 50
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == {3: 3, 5: 3, 9: 3, 12: 3, 20: 20, 30: 30}


def test_ids_must_be_integers(spark):
    with pytest.raises(ValueError):
        neardup.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def around_one_passage(rng, sizes, own):
    """Texts of one passage, a few words of which are replaced, and a near copy of every third."""
    rows = []
    for i, size in enumerate(sizes):
        text = [f"p{k}" for k in range(size)]
        for at in rng.sample(range(size), own(size)):
            text[at] = f"s{i}_{at}"
        rows.append((2 * i, " ".join(text)))
        if i % 3 == 0:
            rows.append((2 * i + 1, " ".join(text[: size - size // 12])))
    return rows


@pytest.mark.parametrize(
    ("low", "high", "passes"),
    [(420, 500, [32, 512]), (430, 640, [32, 512, 8192])],
    ids=["whole", "around the size of a sketch"],
)
def test_whole_sets_meet_once(spark, monkeypatch, low, high, passes):
    """Crowded texts whose sets are whole in a pass are settled there, and only with larger ones do they go on."""
    monkeypatch.setattr(neardup, "CROWD", 8)
    monkeypatch.setattr(neardup, "LEADERS", 1)
    monkeypatch.setattr(neardup, "LED", 1)
    seen, candidates = [], neardup.Search.candidates
    monkeypatch.setattr(neardup.Search, "candidates", lambda self, held, retained: seen.append(retained) or candidates(self, held, retained))
    rng = random.Random(8)
    rows = around_one_passage(rng, [rng.randrange(low, high) for _ in range(60)], lambda size: size // 40 + rng.randrange(size // 40))
    want, links = brute(rows)
    assert len(links) > 15 and len(set(want.values())) > 30
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert seen == passes


def rows_met_by_value(spark, run):
    """Rows out of all joins on one value each, while ``run`` goes."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, rows = store.executionsList().size(), 0
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    done = store.executionsList()
    for i in range(before, done.size()):
        nodes, values = store.planGraph(done.apply(i).executionId()).allNodes(), store.executionMetrics(done.apply(i).executionId())
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if "Join" in node.name() and re.search(r"Join \[v#\d+L\], \[v#\d+L\]", node.desc()):
                for metric in (node.metrics().apply(j) for j in range(node.metrics().size())):
                    if metric.name() == "number of output rows" and values.get(metric.accumulatorId()).isDefined():
                        rows += int(values.get(metric.accumulatorId()).get().replace(",", ""))
    return rows


def test_crowded_values_are_not_looked_up_by_a_join(spark, monkeypatch):
    """A finer pass over texts of one passage has 16 times the values, nearly all crowded, and no row for each."""
    monkeypatch.setattr(neardup, "CROWD", 8)
    monkeypatch.setattr(neardup, "LEADERS", 1)
    monkeypatch.setattr(neardup, "LED", 1)
    rng = random.Random(8)
    rows = around_one_passage(rng, [rng.randrange(420, 500) for _ in range(60)], lambda size: size // 40 + rng.randrange(size // 40))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_met_by_value(spark, lambda: neardup.near_duplicates(docs).collect())
    assert 0 < got < 32 * len(rows)


@pytest.mark.parametrize("crowd", [4, 256])
def test_links_at_the_threshold_between_unlike_sizes(spark, monkeypatch, crowd):
    """The larger set has all of the smaller one, which is four fifths of it, or both have eight ninths in common."""
    monkeypatch.setattr(neardup, "CROWD", crowd)
    monkeypatch.setattr(neardup, "LEADERS", 1)
    monkeypatch.setattr(neardup, "LED", 1)
    rows, n = [], 0
    for size in (5, 10, 15, 20, 25, 30, 40, 50, 100, 400, 500, 600):
        for i in range(6):
            passage = [f"p{k}" for k in range(size * 6 // 10)]
            own = [f"s{size}_{i}_{k}" for k in range(size + 3 - len(passage))]
            text = passage + own
            rows += [(n, " ".join(text)), (n + 1, " ".join(text[: len(text) - size // 5 + (i % 2)]))]
            nine = text[: len(text) - size // 9]
            rows += [(n + 2, " ".join(nine + [f"u{n}_{k}" for k in range(size // 9)]))]
            n += 3
    want, links = brute(rows)
    assert len(links) > 100 and len(set(want.values())) > 60
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
