import random

import pytest

from tierflow.llm.common import fold_words
from tierflow.llm.licenses import PHRASES, TEMPLATES, Template, TemplateIndex, license_report, needed, run_length, scan_licenses, template_words


def brute(text, templates, threshold=0.8):
    """Every run of every length, by definition: name -> containment."""
    words, found = fold_words(text.encode()), {}
    for t in templates:
        own = set(template_words(t.text))
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + run_length(t.text)) + 1):
                run = set(words[i:j])
                if any(x.encode() in run for x in t.without) or not all(x.encode() in run for x in t.needs):
                    continue
                n = len(own & run)
                if own and n >= needed(len(own), threshold):
                    found[t.name] = max(found.get(t.name, 0), n / len(own))
    return found


def labels_of(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.labels for r in license_report(frame).orderBy("doc_id").collect()]


@pytest.mark.parametrize(
    "text,labels",
    [
        ("Released under the Apache License", ""),
        ("Licensed under CC BY 4.0", "cc-by,cc-by-4.0"),
        ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"),
        ("This work is licensed under the GNU General Public License, version 2", "gpl,gpl-2.0"),
        ("This work is licensed under the GNU General Public License, version 3", "gpl,gpl-3.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3", "gpl,lgpl-3.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc-4.0"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
        ("The film was released under the new label; a driver license is required", ""),
        ("Released under the MIT License", "mit"),
        ("Released " + "and so on " * 20 + "under the MIT License", "mit"),
        ("released " * 3 + "far " * 30 + "under " + "far " * 30 + "the mit " + "far " * 30 + "license", ""),
        ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
        ("Licensed under the Apache License, Version 1.1", "apache-1.1"),
    ],
)
def test_siblings_are_told_apart(text, labels):
    index = TemplateIndex(TEMPLATES, {}, 0.8)
    words = fold_words(text.encode())
    joined = " ".join(w.decode() for w in words)
    base = {label for p, label in PHRASES.items() if f" {p} " in f" {joined} "}
    assert ",".join(sorted(base | {t.label for _, t, _ in index.match(words)})) == labels


def test_wrapped_headers(spark):
    by = {t.name: t for t in TEMPLATES}
    wrap = lambda text, n: "\n # ".join(" ".join(w) for w in (text.split()[i : i + n] for i in range(0, len(text.split()), n)))
    texts = [wrap(by[n].text, 9) for n in ("mit-text", "bsd", "apache-2.0-header", "mpl-2.0")]
    assert labels_of(spark, ["one two\n" + t + "\nthree" for t in texts]) == ["mit", "bsd", "apache-2.0", "mpl-2.0"]


@pytest.mark.parametrize("seed", range(4))
def test_index_against_all_runs(seed):
    rng = random.Random(seed)
    templates = [
        Template(f"t{i}", f"l{i % 3}", " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))), tuple(rng.sample("abc", rng.randint(0, 1))), tuple(rng.sample("xyz", rng.randint(0, 2))))
        for i in range(8)
    ]
    templates = [t for t in templates if set(t.needs) <= set(t.text.split())] + [Template("none", "none", "...")]
    index = TemplateIndex(templates, {b"a": 9, b"b": 3, b"c": 7}, 0.8)
    for _ in range(60):
        text = " ".join(rng.choice("abcdefghijxyz") for _ in range(rng.randint(0, 40)))
        found = index.match(fold_words(text.encode()))
        assert {t.name: share for _, t, share in found} == brute(text, templates)
        for first, t, _ in found:
            assert fold_words(text.encode())[first] in template_words(t.text)


def test_report_and_odd_rows(spark):
    rows = [
        (1, "All rights reserved. ALL RIGHTS RESERVED", 1), (2, None, 1), (3, "", 1), (None, "cc by", 1), (4, "é" * 10, 1), (4, "é" * 10, 1),
        (5, "word " * 5000 + "Released under the MIT License", 1),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, labels int")
    found = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in license_report(frame).collect()}
    assert found == {
        (1, 6, 2, 0, 3, "reserved", "reserved", 1.0), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0),
        (None, 2, 1, 0, 0, "cc-by", "cc-by", 1.0), (4, 1, 0, None, None, "", "", 0.0), (5, 5005, 0, None, None, "", "mit", 1.0),
    }
    assert license_report(frame).count() == len(rows)
    blocks = scan_licenses(frame).filter("doc_id = 5").first().blocks
    assert [(b.first_word, b.name, b.containment) for b in blocks] == [(5000, "mit", 1.0)]
    assert license_report(frame.limit(0)).count() == 0
