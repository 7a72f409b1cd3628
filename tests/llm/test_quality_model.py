import math
import random
import zlib

import numpy as np
import pytest

from tierflow.llm.quality_model import (
    _MARKS,
    FEATURES,
    MAX_PAIRS,
    PAIRS_PER_LOSER,
    bradley_terry,
    features,
    fit_quality,
    keep_quality,
    predict_quality,
    score_quality,
)


def test_pairwise_loss_is_minimal():
    rng = np.random.default_rng(3)
    differences = rng.normal(size=(400, 4)) + [1, 0.5, 0, -0.3]
    weights = bradley_terry(differences, ridge=0.1)

    def loss(w):
        return np.log1p(np.exp(-differences @ w)).sum() + 0.05 * w @ w

    for _ in range(50):
        assert loss(weights) <= loss(weights + rng.normal(size=4) * 0.01)


@pytest.mark.parametrize("text", [b"", b"\n\n", "é漢".encode(), b"a " * 50_000])
def test_features_of_odd_texts(text):
    assert len(features(text)) == FEATURES and np.isfinite(features(text)).all()


def test_held_out_accuracy(spark, medium_dir):
    docs = spark.read.parquet(f"{medium_dir}/documents.parquet")
    labels = spark.read.parquet(f"{medium_dir}/labels.parquet")
    found = predict_quality(docs, labels)
    both = found.join(labels, "doc_id").filter("held_out").toPandas()
    assert found.count() == docs.count()
    assert len(both) > 60 and (both.predicted == both.quality).mean() > 0.93
    kept = keep_quality(docs, labels)
    assert kept.schema == docs.schema and kept.count() == found.filter("predicted = 1").count()


def test_odd_rows(spark):
    rows = [(1, "good text here", "x"), (2, None, "x"), (3, "", "x"), (None, "a", "x"), (1, "good text here", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame(
        [(1, 1), (1, None), (2, 0), (3, None), (None, 1)], "doc_id bigint, quality int"
    )
    found = predict_quality(docs, labels).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    assert by[2].score == by[3].score
    model = fit_quality(docs, labels.filter("false"))
    assert {r.score for r in score_quality(docs, model).collect()} == {0.7}
    assert predict_quality(docs.filter("false"), labels).count() == 0


def plain_features(text):
    kinds = dict.fromkeys(("upper", "lower", "digit", "blank", "mark"), 0)
    marks = dict.fromkeys(_MARKS, 0)
    words, word = [], b""
    for byte in text + b" ":
        char = bytes([byte])
        if b"A" <= char <= b"Z" or b"a" <= char <= b"z" or b"0" <= char <= b"9" or byte >= 128:
            word += char.lower() if byte < 128 else char
        elif word:
            words.append(word)
            word = b""
    for byte in text:
        char = bytes([byte])
        if byte < 128:
            kind = "upper" if b"A" <= char <= b"Z" else "lower" if b"a" <= char <= b"z" else "digit" if char.isdigit() else None
            kinds[kind or ("blank" if char in b"\t\n\r " else "mark")] += 1
        if byte in marks:
            marks[byte] += 1
    size, n = max(1, len(text)), max(1, len(words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    again = sum(1 for i in range(1, len(words)) if words[i] == words[i - 1])
    shares = [kinds[k] / size for k in ("upper", "lower", "digit", "mark", "blank")]
    rest = [size / n, len(set(words)) / n, again / n, 1 - len(set(lines)) / max(1, len(lines)), len(lines) / n]
    return [math.log(1 + len(words)), *shares, *rest, *(math.log(marks[m] / n + 1e-3) for m in _MARKS)]


def test_against_plain_loops(spark):
    """Features letter by letter, the pairs one by one, plain ascent of the likelihood, a sorted quantile."""
    rng = random.Random(4)
    rows, rated = [], []
    for i in range(160):
        words = [rng.choice(["the", "Cat", "sat", "on", "é", "42", "mat."]) for _ in range(rng.randint(5, 40))]
        quality = i % 3 > 0
        if not quality:
            words += ["buy", "buy", "###", "$$$"] * rng.randint(0, 4)
        rows.append((i, " ".join(words) + "\n" * (i % 2)))
        rated.append((i, int(quality)))
    rows += [(500, ""), (501, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame(rated, "doc_id bigint, quality int")
    may = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    x = {i: plain_features((t or "").encode()) for i, t in rows}
    for i, text in rows:
        assert np.allclose(features((text or "").encode()), x[i])
    known = [(i, y) for i, y in rated if may(i)]
    mean = [sum(x[i][k] for i, _ in known) / len(known) for k in range(FEATURES)]
    spread = [math.sqrt(sum((x[i][k] - mean[k]) ** 2 for i, _ in known) / len(known)) + 1e-6 for k in range(FEATURES)]
    z = {i: np.array([min(6, max(-6, (v - m) / s)) for v, m, s in zip(x[i], mean, spread)]) for i in x}
    good, bad = [i for i, y in known if y], [i for i, y in known if not y]
    each = max(1, min(PAIRS_PER_LOSER, MAX_PAIRS // len(bad)))
    drawn = np.random.default_rng(7).choice([at for at, (_, y) in enumerate(known) if y], each * len(bad))
    pairs = [(known[w][0], bad[n // each]) for n, w in enumerate(drawn)]
    assert all(w in good for w, _ in pairs)
    gaps = np.array([z[w] - z[b] for w, b in pairs])
    weights = np.zeros(FEATURES)
    rate = 1 / (np.linalg.norm(gaps, 2) ** 2 / 4 + 0.1)
    momentum, before = 0.0, weights
    for _ in range(60_000):
        ahead = weights + momentum * (weights - before)
        before, weights = weights, ahead + rate * (gaps.T @ (1 / (1 + np.exp(gaps @ ahead))) - 0.1 * ahead)
        momentum = 0.995
    raw = {i: float(z[i] @ weights) for i in z}
    ordered = sorted(raw[i] for i, _ in known)
    place = len(bad) / len(known) * (len(known) - 1)
    low = int(place)
    cut = ordered[low] + (place - low) * (ordered[min(low + 1, len(ordered) - 1)] - ordered[low])
    deviation = math.sqrt(sum((v - sum(ordered) / len(ordered)) ** 2 for v in ordered) / len(ordered))
    model = fit_quality(docs, labels)
    assert np.allclose(model.weights, weights, atol=1e-4) and abs(model.cut - cut) < 1e-3
    for row in predict_quality(docs, labels).collect():
        at = max(-40.0, min(40.0, (raw[row.doc_id] - cut) / (deviation / 4 + 1e-9) + math.log(0.7 / 0.3)))
        assert abs(row.score - 1 / (1 + math.exp(-at))) < 1e-3
        assert row.held_out == (not may(row.doc_id))
        if abs(raw[row.doc_id] - cut) > 1e-3:
            assert row.predicted == (raw[row.doc_id] > cut)


def test_sample_may_be_small(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(2000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id bigint, quality int")
    assert fit_quality(docs, labels, max_labelled=20).weights.shape == (FEATURES,)


def test_keep_quality_odd_rows(spark):
    rows = [(i, "good words stand here in order", "x") for i in range(20)] + [(30, None, "x"), (31, "", None), (None, "a", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(30, 0), (31, 0)], "doc_id bigint, quality int")
    docs = docs.unionAll(docs.filter("doc_id < 2"))
    kept = keep_quality(docs, labels)
    expected = [r.doc_id for r in predict_quality(docs, labels).filter("predicted = 1").collect()]
    assert kept.schema == docs.schema and len(expected) > 20
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(expected, key=str)
    assert keep_quality(docs.filter("false"), labels).count() == 0
