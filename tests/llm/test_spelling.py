import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tierflow.llm import spelling
from tierflow.llm.spelling import one_edit, spelling_variants


def plain_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(docs, min_length, every):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if every:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [x for x in words if plain_near(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(rows)


def make(seed, n_docs=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aeiourstnéÀÿ×") for _ in range(rng.randint(3, 8))) for _ in range(30)]

    def noisy(w):
        at, kind = rng.randrange(len(w)), rng.random()
        return w[:at] + ("" if kind < 0.3 else rng.choice("aeé")) + (w[at + 1 :] if kind < 0.6 else w[at:])

    weights = [1 / (i + 1) for i in range(len(base))]
    text = lambda: " ".join(
        (lambda w: noisy(w) if rng.random() < 0.2 else w)(rng.choices(base, weights)[0]) for _ in range(60)
    )
    docs = [(i, text().title() if i % 3 else text()) for i in range(n_docs)]
    return [*docs, (7, None), (8, ""), (None, "aeiourst nostalgia"), docs[0], docs[0], (99, "ß漢字 ‐ 12 x" + "a" * 50 + " " + "a" * 51), (98, "a" * 50 + " " + "a" * 51 + " " + "b" * 300 + " " + "b" * 300 + " " + "b" * 301 + " " + "b" * 301)]


@pytest.mark.parametrize("seed,subtree_words,every", [(0, 30_000, None), (1, 5, 31), (2, 1, 5), (3, 40, 7)])
def test_against_all_pairs(spark, seed, subtree_words, every):
    docs = make(seed)
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, word string")
    found = spelling_variants(frame, min_length=3, delete_every=every, subtree_words=subtree_words)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == brute(docs, 3, every)


def test_chain_of_forms(spark):
    counts = {"wandering": 3000, "wandring": 250, "wanding": 20, "waning": 2}
    docs = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())]
    found = {r.word: r for r in spelling_variants(spark.createDataFrame(docs, "doc_id int, text string"), min_length=5).collect()}
    assert [found[w].root for w in counts] == ["wandering"] * 4
    assert [found[w].form for w in counts] == [None, "wandering", "wandring", "wanding"]


def test_words_of_one_vector_in_parts(spark, monkeypatch):
    """More words with one vector than a subtree may hold: anagrams and their neighbours."""
    rng = random.Random(5)
    words = {"".join(rng.sample("abcdefg", 7)) for _ in range(120)}
    words |= {w[:3] + rng.choice("abcxyz") + w[4:] for w in list(words)[:60]}
    docs = [(1, " ".join(sorted(words) * 2))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = spelling_variants(frame, subtree_words=3)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == brute(docs, 7, None)


def test_ids_of_any_type_and_empty_tables(spark):
    frame = spark.createDataFrame([("a-1", "letters letters"), ("b", "lettters " * 2)], "doc_id string, text string")
    assert {r.word: r.n_near for r in spelling_variants(frame).collect()} == {"letters": 1, "lettters": 1}
    assert spelling_variants(frame.limit(0)).collect() == []
    assert spelling_variants(frame.withColumn("text", frame.text.substr(1, 3))).collect() == []


def test_one_edit_against_plain():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 6)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(1, 6)))
        assert one_edit(a.encode(), b.encode()) == plain_near(a, b)


def test_vectors_stay_in_a_byte():
    assert spelling.vectors_of([b"a" * 300, b"ab"], np.arange(256) % spelling.LEVELS).max() == 255
