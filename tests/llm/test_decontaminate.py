import hashlib
import random

import pyarrow as pa
import pytest

from tierflow.llm.common import fold_words
from tierflow.llm.decontaminate import WordAutomaton, _scan_rows, contamination, remove_matches


def brute(text, items, window):
    words, hit, names = fold_words((text or "").encode()), set(), set()
    for name, body in items:
        item = fold_words((body or "").encode())
        size = min(window, len(item))
        grams = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                names.add(str(name))
    return len(words), len(hit), sorted(names)


def make(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, text(rng.randint(0, 14))) for i in range(6)] + [(2, text(12)), (9, None), (8, "")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(50, None), (51, ""), (1, "A b"), (1, "A b")]
    return docs, items


@pytest.mark.parametrize("seed", range(6))
def test_automaton_lengths(seed):
    docs, items = make(seed)
    automaton = WordAutomaton([(n, fold_words((t or "").encode())) for n, t in items], 4)
    whole = [" " + " ".join(x.decode() for x in fold_words((t or "").encode())) + " " for _, t in items]
    for _, text in docs:
        words = fold_words((text or "").encode())
        for end, length in enumerate(automaton.lengths(words), start=1):
            inside = lambda n: any(" " + b" ".join(words[end - n : end]).decode() + " " in w for w in whole)  # noqa: E731,B023
            assert length == max((n for n in range(1, end + 1) if inside(n)), default=0)


@pytest.mark.parametrize("seed,max_words", [(0, 1000), (1, 1000), (2, 5), (3, 20)])
def test_against_brute_force(spark, seed, max_words):
    docs, items = make(seed)
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, n_words int")
    tests = spark.createDataFrame([(n, t) for n, t in items], "item_id bigint, text string")
    found = contamination(frame, tests, window=4, max_words=max_words).collect()
    expected = []
    for doc_id, text in docs:
        n, hit, names = brute(text, items, 4)
        expected.append((doc_id, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0))
    assert sorted(map(tuple, found)) == sorted(expected)


def test_groups_cut_the_same_texts(spark, medium_dir):
    docs = spark.read.parquet(f"{medium_dir}/documents.parquet")
    tests = spark.read.parquet(f"{medium_dir}/benchmark.parquet")
    odd = spark.createDataFrame([(-1, None, "x"), (None, "", "x"), (None, None, None)], "doc_id long, text string, source string")
    docs = docs.select("doc_id", "text", docs.source.alias("items"), docs.lang.alias("its_key"))
    docs = docs.unionAll(docs.limit(20)).unionAll(odd.select("doc_id", "text", "source", "source"))
    one, many = (sorted(map(tuple, contamination(docs, tests, max_words=n).collect()), key=str) for n in (200_000, 300))
    assert one == many and sum(r[-1] for r in one) > 10
    one, many = (sorted(map(tuple, remove_matches(docs, tests, max_words=n).collect()), key=str) for n in (200_000, 300))
    assert one == many and len(one) > 900


def test_automata_are_built_once_a_piece(monkeypatch):
    built = []
    made = WordAutomaton.__init__
    monkeypatch.setattr(WordAutomaton, "__init__", lambda self, *a, **k: (built.append(1), made(self, *a, **k))[1])
    rows = []
    for group, piece in [(0, 0), (0, 1), (3, 0)]:
        rows += [(group, piece, False, f"{group}-{i}", None, f"a b{i} c{group} d") for i in range(5)]
        rows += [(group, piece, True, None, f"{group}{piece}{i}".encode(), f"x A B{i % 5} C3 d") for i in range(50)]
    names = ["group", "piece", "is_text", "name", "key", "text"]
    whole = pa.table({n: list(c) for n, c in zip(names, zip(*rows))})
    found = pa.Table.from_batches(list(_scan_rows(whole.to_batches(max_chunksize=7), 4)))
    assert len(built) == 3 and found.num_rows == 150
    for key, spans, items in zip(*(found[c].to_pylist() for c in found.column_names)):
        hit = key.startswith(b"3")
        assert spans == ([{"first": 1, "end": 5}] if hit else [])
        assert items == ([f"3-{int(key[2:]) % 5}"] if hit else [])


def test_long_items_are_cut_with_overlap(spark):
    words = [f"w{i}" for i in range(1000)]
    tests = spark.createDataFrame([("long", " ".join(words))], "item_id string, text string")
    frame = spark.createDataFrame([(i, " ".join(words[i : i + 10])) for i in range(991)], "doc_id long, text string")
    assert {(r.n_hit, r.n_items) for r in contamination(frame, tests, max_words=100).collect()} == {(10, 1)}


def test_removal(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [
        (1, "Start here, " + item.upper().replace(" ", ", ") + "! And the end of a longer é text with words.", 7),
        (2, item, 9),
        (3, None, None),
        (4, "", 0),
        (None, "clean", 5),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    tests = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    found = remove_matches(frame, tests)
    assert found.schema == frame.schema
    cut = "Start here, ! And the end of a longer é text with words."
    assert {tuple(r) for r in found.collect()} == {(1, cut, len(cut)), (3, None, None), (4, "", 0), (None, "clean", 5)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination(docs, none).first().n_hit == 0
    assert contamination(docs.filter("false"), none).count() == 0
    assert remove_matches(docs, none).count() == 1
