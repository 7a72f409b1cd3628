import random
import re

import numpy as np
import pytest

from tierflow.llm.repeats import PREFIX, Suffix, anchors_of, judge_repeats, remove_repeats, repeats_in, routed


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(docs, window):
    """Rows with one id are one document; a null id is larger than all others."""
    order = lambda d: (d is None, d if d is not None else 0)
    least = {}
    for d, text in docs:
        w = words_of(text)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            least[g] = min(least.get(g, (True, 0)), order(d)) if g in least else order(d)
    rows = []
    for d, text in docs:
        w, gone = words_of(text), set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < order(d):
                gone.update(range(i, i + window))
        rows.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(rows, key=repr)


def make(seed, letters="abcdefghij", n_docs=60):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    passage, long = text(9), text(120)
    docs = []
    for i in range(n_docs):
        parts = [text(rng.randint(0, 25))]
        if i % 3 == 0:
            parts += [passage, text(rng.randint(0, 12))]
        if i % 5 == 0:
            w = long.split()
            w[rng.randrange(len(w))] = "changed"
            parts = [" ".join(w)]
        if i % 7 == 0:
            parts = ["\t".join(parts), "\x0b\n", passage, passage]
        docs.append((i, " ".join(parts)))
    docs += [(1000, docs[0][1]), (1001, docs[0][1]), (-5, docs[9][1]), (None, docs[3][1]), (None, long), (None, long)]
    docs += [(4, long), (4, passage + " " + long), docs[6], docs[6], (70, None), (71, ""), (72, "a\u00a0b \u2003 c"), (73, long * 3)]
    rng.shuffle(docs)
    return docs


def rows_of(frame):
    return sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in frame.collect()), key=repr)


@pytest.mark.parametrize(
    "seed,letters,window,group_rows,tree_rows",
    [(0, "abcdefghij", 6, 50_000, 100_000), (1, "abc", 6, 50_000, 50), (2, "ab", 8, 1, 20), (3, "abcdef", 13, 2, 1), (4, "abc", 13, 50_000, 7)],
)
def test_against_all_windows(spark, seed, letters, window, group_rows, tree_rows):
    docs = make(seed, letters)
    frame = spark.createDataFrame([(d, t, 3) for d, t in docs], "doc_id bigint, text string, j int")
    found = judge_repeats(frame, window=window, group_rows=group_rows, tree_rows=tree_rows)
    assert rows_of(found) == brute(docs, window)


def test_spans_and_texts(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [("b", f"Start {passage}\n end"), ("a", passage), ("c", f"x  y {passage} z p0 p1"), ("d", "short one"), ("e", passage)]
    frame = spark.createDataFrame(rows, "name string, body string")
    found = {r.doc_id: r for r in remove_repeats(frame, id_column="name", text_column="body").collect()}
    assert {k: r.text for k, r in found.items()} == {"a": passage, "b": "Start end", "c": "x y z p0 p1", "d": "short one", "e": ""}
    assert [tuple(s) for s in found["c"].spans] == [(2, 22)]
    assert (found["e"].n_words, found["e"].n_removed) == (20, 20)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    assert judge_repeats(frame).collect() == []
    with pytest.raises(ValueError):
        judge_repeats(frame, window=PREFIX)


@pytest.mark.parametrize("seed", range(5))
def test_anchors_cover_every_window(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abcd") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))).encode() for _ in range(30)]
    found = anchors_of(texts, 9, PREFIX)
    of_window = {}
    for text, h, at, low, high in zip(*(x.tolist() for x in found[:5])):
        base = found.first[text]
        for s in range(low - base, high - base + 1):
            assert (text, s) not in of_window and s <= at - base <= s + 9 - PREFIX
            of_window[text, s] = (at - base - s, h)
    whole = {}
    for t, text in enumerate(texts):
        words = text.split()
        for s in range(len(words) - 8):
            # Equal windows have equal anchors, in whatever text.
            assert whole.setdefault(tuple(words[s : s + 9]), of_window.pop((t, s))) == whole[tuple(words[s : s + 9])]
    assert not of_window


@pytest.mark.parametrize("depths", [(5,), (5, 6), (5, 6, 7, 8, 9), (6,)])
def test_parts_of_crowded_prefixes_keep_their_windows(depths):
    words = [b"w%d" % i for i in range(14)]

    class Crowded:
        def __contains__(self, pair):
            return pair[0] in depths

    parts = list(routed(1, words, 4, 0, Crowded(), 9, 5))
    windows = sorted(tuple(p.words.split()[p.left - e : p.left - e + 9]) for p in parts for e in range(p.least, p.left + 1))
    assert windows == sorted(tuple(words[s : s + 9]) for s in range(5))


def test_nodes_of_a_group():
    """Three suffixes with one prefix: two share what lies to the right, two what lies to the left."""
    suffixes = [Suffix(1, 1, 0, b"x a b c d e f"), Suffix(1, 1, 0, b"x a b c d e g"), Suffix(1, 1, 0, b"y a b c d e f")]
    found = repeats_in(suffixes, np.array([3, 2, 1]), np.array([3, 2, 1]), 6, 5)
    # Suffix 0 shares its window 0 (a .. f) with suffix 2 and its window 1 (x a .. e) with suffix 1.
    assert sorted(zip(*(x.tolist() for x in found))) == [(0, 0, 0, 1), (0, 1, 1, 2)]
