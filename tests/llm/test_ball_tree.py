import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tierflow.llm import ball_tree
from tierflow.llm.ball_tree import BallTree, Best, Items, ranked_search, search


def terms_of(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in found]


def brute(docs, items, top):
    counted = [(d, Counter(terms_of(t))) for d, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    rows = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            score = 0
            if c:
                m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
                for t in set(terms_of(text)) & set(c):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc if doc is not None else 0, doc))
        rows += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top], start=1)]
    return sorted(rows, key=repr)


def make(seed, n_docs=300, n_items=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.randint(0, 80))) for i in range(n_docs)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)]  # equal scores
    docs += [(None, docs[3][1]), (5, None), (6, ""), docs[3], docs[3], (2000, "W1! \u00c9t\u00e9 w2"), (2001, text(5000))]
    items = [(i, text(rng.randint(1, 30))) for i in range(n_items)]
    items += [(3, docs[3][1]), (90, None), (91, ""), (92, "nobody has these"), (None, "w5 w6 \u00c9t\u00e9"), (93, "w1 W1 w1")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("seed,top,leaf,block,max_words", [(0, 10, 64, 4096, 10**6), (1, 10, 4, 50, 60), (2, 3, 1, 7, 10**6), (3, 1, 2, 4096, 25)])
def test_against_all_documents(spark, seed, top, leaf, block, max_words):
    docs, items = make(seed)
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, score int")
    tests = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, doc_id int")
    found = ranked_search(frame, tests, top=top, max_words=max_words, block_docs=block, leaf_docs=leaf)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items, top)


def test_blocks_of_a_task():
    """One task over many blocks carries its best documents along."""
    docs, items = make(7)
    number, lists = {}, []
    for _, text in items:
        if terms_of(text):
            lists.append(sorted(number.setdefault(t, len(number)) for t in set(terms_of(text))))
    block = Items(np.cumsum([0, *map(len, lists)]), np.array([t for x in lists for t in x]))
    rng = random.Random(1)
    rows = [{t: rng.randint(0, 10**10) for t in rng.sample(range(len(number)), 20)} for _ in range(500)]
    rows += [dict(rows[0])] * 100
    best = [Best(10) for _ in lists]
    looked = 0
    for low in range(0, len(rows), 150):
        part = rows[low : low + 150]
        starts = np.cumsum([0, *map(len, part)])
        tree = BallTree(starts, np.array([t for r in part for t in r]), np.array([v for r in part for v in r.values()]), len(number), 8)
        looked += search(tree, list(range(low, low + len(part))), block, best)
    for terms, b in zip(lists, best):
        every = sorted(((-sum(r.get(t, 0) for t in terms), i) for i, r in enumerate(rows)))
        assert [(-s, i) for s, i in b.rows()] == [x for x in every if x[0] < 0][:10]
    assert looked < len(lists) * sum(-(-150 // 8) for _ in range(4)) * 2


def test_bounds_hold_and_copies_have_no_radius():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(300, size=rng.integers(1, 40), replace=False)) for _ in range(400)]
    rows += [rows[0]] * 300
    starts = np.cumsum([0, *map(len, rows)])
    values = rng.integers(0, 2 * 10**10, starts[-1])
    size = len(rows[0])
    for i in range(400, 700):
        values[starts[i] : starts[i] + size] = values[:size]
    items = Items(np.array([0, 5, 60, 61]), np.concatenate([rng.choice(300, 5, False), rng.choice(300, 55, False), [7]]))
    tree = BallTree(starts, np.concatenate(rows), values, 300, 16)
    bounds = tree.bounds(items)
    for node in range(len(tree.rows)):
        for item in range(3):
            wanted = np.zeros(300, dtype=np.int64)
            wanted[items.of(item)] = 1
            assert tree.scores(node, wanted)[1].max() <= bounds[node, item]
    copies = [r for n, r in enumerate(tree.radii) if tree.children[n] is None and (tree.rows[n] >= 400).all()]
    assert copies and max(copies) < 1e-4 * max(tree.radii)


def test_empty_tables_and_other_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "name string, body string")
    items = spark.createDataFrame([("q", "x")], "question string, body string")
    names = {"id_column": "name", "text_column": "body", "item_column": "question", "item_text": "body"}
    assert [(r.item_id, r.rank, r.doc_id) for r in ranked_search(docs, items, **names).orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]
    assert ranked_search(docs.limit(0), items, **names).collect() == []
    assert ranked_search(docs, items.limit(0), **names).collect() == []
    assert ranked_search(docs, items.limit(0), **names).dtypes == [("item_id", "string"), ("rank", "int"), ("doc_id", "string"), ("score", "bigint")]


def test_fixed_values():
    assert ball_tree.weight(10, 3) == math.floor(1000 * math.log(22 / 7))
    assert ball_tree.damping(5, 10, 100) == 10 + 45
