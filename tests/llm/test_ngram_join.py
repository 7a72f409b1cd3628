import random
from collections import defaultdict

import pytest

from tierflow.llm import ngram_join as module
from tierflow.llm.common import fold_words
from tierflow.llm.components import connected_components
from tierflow.llm.ngram_join import choose_bands, keep_one_of_each, near_duplicates, ngram_groups, ngram_join


def grams(text):
    w = fold_words((text or "").encode())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def roots(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def brute(rows):
    sets = {grams(t) for _, t in rows} - {frozenset()}
    order = sorted(sets, key=lambda s: sorted(s))
    links = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if len(a & b) >= 0.8 * len(a | b)]
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    at = {s: i for i, s in enumerate(order)}
    group = roots(range(len(order)), [(at[a], at[b]) for a, b in links])
    ids = defaultdict(list)
    for doc_id, text in rows:
        if grams(text) and doc_id is not None:
            ids[group[at[grams(text)]]].append(doc_id)
    out = []
    for doc_id, text in rows:
        s = grams(text)
        out.append((doc_id, min(ids[group[at[s]]], default=None), degree[s]) if s else (doc_id, doc_id, 0))
    return out, len(links)


def make(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvw") + rng.choice("xyz") + rng.choice("0123456789")
    rows = []
    for group in range(12):
        base = [word() for _ in range(rng.randint(30, 300))]
        for _ in range((40 if group == 0 else rng.choice([1, 2, 3, 6]))):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    rows += [(1000 + i, t) for i, t in enumerate(["", None, "!!", "one", "One.", "a b c d e", "A, b c d E!", "tail " * 30_000])]
    return rows + [(None, "one"), (5, rows[5][1]), (5, rows[5][1])]


@pytest.mark.parametrize("seed,block", [(0, 256), (1, 5), (2, 1)])
def test_against_all_pairs(spark, seed, block):
    rows = make(seed)
    expected, n = brute(rows)
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, class_id int")
    found = near_duplicates(frame, block_texts=block)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert n > 20


def test_links_carry_pairs(spark):
    rows = make(3)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    joined = ngram_join(frame)
    pairs = [(bytes(r.mark), bytes(p), s) for r in joined.links.collect() for p, s in zip(r.partners, r.similarities)]
    assert len({frozenset(p[:2]) for p in pairs}) == len(pairs) == brute(rows)[1]
    assert all(0.8 <= s < 1 for *_, s in pairs)


def test_one_stays(spark):
    rows = make(4)
    frame = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id bigint, text string, its_doc string, its_key int")
    kept = keep_one_of_each(frame)
    expected, _ = brute(rows)
    wanted = sorted({c for (i, t), (_, c, _) in zip(rows, expected) if grams(t)}) + [1000, 1001, 1002]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted)
    assert kept.columns == frame.columns


@pytest.mark.parametrize("seed,block", [(5, 256), (6, 8), (7, 2)])
def test_groups_are_those_of_all_links(spark, seed, block):
    """One to three turns and the rest pair by pair give the groups that all links give, chains and
    neighbouring families in one bucket included."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(200)]
    rows = make(seed)
    for step in range(30):  # a chain: neighbours are similar, its ends are not
        rows.append((2000 + step, " ".join(base[step * 4 : step * 4 + 120])))
    for family in range(3):  # families that share most words, yet not 0.8 of their n-grams
        words = [w if i % 30 else f"f{family}{i}" for i, w in enumerate(base)]
        for i in range(25):
            words[rng.randrange(200)] = f"x{i}"
            rows.append((3000 + 100 * family + i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected, _ = brute(rows)
    rows_found, groups = ngram_groups(frame, block_texts=block)
    joined = ngram_join(frame, block_texts=block)
    assert {tuple(map(bytes, r)) for r in groups.collect()} == {tuple(map(bytes, r)) for r in joined.groups.collect()}
    kept = {r.doc_id for r in keep_one_of_each(frame, block_texts=block).collect()}
    wanted = {c for (_, t), (_, c, _) in zip(rows, expected) if grams(t)} | {i for i, t in rows if not grams(t)}
    assert kept == wanted and rows_found.count() == len(rows)


def test_groups_are_looked_up_once_a_text(spark, monkeypatch):
    """A text in many buckets joins its group once, however many near-copies there are."""
    seen, plain = [], module._grouped

    def spy(texts, groups):
        if groups is not None:
            seen.append((texts.count(), texts.select("mark").distinct().count()))
        return plain(texts, groups)

    monkeypatch.setattr(module, "_grouped", spy)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]])) for i in range(40)]
    kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"), block_texts=4)
    assert [r.doc_id for r in kept.collect()] == [0]
    assert seen and all(n == marks for n, marks in seen)


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates(frame).count() == 0
    assert keep_one_of_each(frame).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(None, 1)]
    found = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    real = [e for e in edges if None not in e]
    expected = roots({n for e in real for n in e}, real)
    assert {tuple(r) for r in found.collect()} == {(n, r) for n, r in expected.items() if n != r}


@pytest.mark.parametrize("threshold,recall", [(0.5, 0.99), (0.8, 0.9999), (0.95, 0.999), (1.0, 0.9)])
def test_bands_reach_recall(threshold, recall):
    bands, rows = choose_bands(threshold, recall)
    assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 128
