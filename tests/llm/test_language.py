import itertools
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tierflow.llm import language
from tierflow.llm.common import learnable
from tierflow.llm.language import (
    LanguageModel,
    _viterbi,
    fit_languages,
    identify_languages,
    keep_languages,
    predict_languages,
)


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_against_all_paths(seed):
    rng = np.random.default_rng(seed)
    sizes = [3, 0, 5, 1, 4, 0]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    emission = rng.normal(size=(len(doc), 3)).astype(np.float32) * 2
    label = _viterbi(emission, doc, len(sizes), 1.5)
    for d, n in enumerate(sizes):
        e = emission[doc == d]

        def total(path):
            return sum(e[i, p] for i, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))

        best = max((total(p) for p in itertools.product(range(3), repeat=n)), default=0)
        assert total(label[doc == d].tolist()) == pytest.approx(best, abs=1e-4)


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        lang, parts = rng.choice([("aa", "ka lo mi ta"), ("bb", "xe zu qo wy"), ("cc", "жа шо ци")])
        words = ["".join(rng.choice(parts.split()) for _ in range(3)) for _ in range(40)]
        rows.append((i, " ".join(words), lang))
    return fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


def test_spans_and_odd_texts(spark, trained):
    rows = [
        (1, "kalomi talota! xezu wyqo, zuxe 12 жашо циша"),
        (2, None),
        (3, ""),
        (4, "12 — ²!"),
        (None, "kalo"),
        (None, "kalo"),
        (5, "漢字"),
        (6, "kalomi " * 30_000),
    ]
    frame = spark.createDataFrame([(i, t, "no") for i, t in rows], "doc_id bigint, text string, lang_pred string")
    found = identify_languages(frame, trained, penalty=1.0).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    assert [(s.start, s.end, s.lang) for s in by[1].spans] == [(0, 13, "aa"), (15, 30, "bb"), (34, 43, "cc")]
    for i in (2, 3, 4):
        assert (by[i].spans, by[i].lang_pred, by[i].score) == ([], "und", 0.0)
    assert by[5].lang_pred in trained.languages
    assert (by[6].lang_pred, by[6].score, len(by[6].spans)) == ("aa", 1.0, 1)


def test_nothing_to_learn(spark):
    frame = spark.createDataFrame([(1, "text", None), (2, None, None)], "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in predict_languages(frame).collect()} == {"und"}
    assert predict_languages(frame.filter("false")).count() == 0


def test_held_out_accuracy(spark, medium_dir):
    docs = spark.read.parquet(f"{medium_dir}/documents.parquet")
    truth = pq.read_table(f"{medium_dir}/documents.parquet", columns=["doc_id", "lang"]).to_pandas()
    found = predict_languages(docs).toPandas().merge(truth, on="doc_id")
    held = found[found.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97
    kept = keep_languages(docs)
    assert kept.schema == docs.schema and kept.count() == docs.count()


def test_mixed_and_unlearned_texts_go(spark, medium_dir):
    """The pipeline's stage, and without its limits the unlearned script alone."""
    docs = spark.read.parquet(f"{medium_dir}/documents.parquet")
    pure = [r for r in docs.filter("length(text) between 900 and 4000").orderBy("doc_id").collect()]
    by = {lang: [r.text for r in pure if r.lang == lang] for lang in ("de", "en", "es", "fr")}
    planted = []
    for (a, b), part in itertools.product(itertools.combinations(by, 2), (0.5, 0.6, 0.7)):
        for one, other in zip(by[a][:5], by[b][:5]):
            planted.append(("mixed", one[: int(800 * part)] + "\n" + other[: int(800 * (1 - part))]))
    planted += [("script", "漢字仮名 交じり文の例 " * n) for n in (1, 30)]
    planted += [("script", by["en"][0][:200] + "漢字仮名 交じり文の例 " * 30)]
    planted += [("unlearned", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. " * n) for n in (1, 9)]
    # No language given: nothing is learned from them.
    rows = [(-1 - i, text, None, kind, len(text)) for i, (kind, text) in enumerate(planted)]
    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    both = table.union(spark.createDataFrame(rows, table.schema)).cache()
    kept = corpus_pipeline.language(spark, both, medium_dir).select("doc_id", "source").collect()
    gone = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in kept}
    assert [r.source for r in kept if r.doc_id < 0] == []
    # The table has a few texts in two languages of its own; one-language texts stay.
    assert len(gone) <= 10
    lax = {r.source for r in keep_languages(both).filter("doc_id < 0").collect()}
    assert "script" not in lax and "mixed" in lax


def test_signs_beyond_the_table_are_no_letters(spark):
    model = LanguageModel(("a", "b"), np.zeros((language.BUCKETS, 2), np.float32), np.ones((language.SCRIPTS, 2), bool))
    flag = "\U0001F3F4\U000E0067\U000E0062\U000E007F"
    rows = [(1, flag), (2, "\U000F0001"), (3, "\U000E0101 12"), (4, "\U00020000 12")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.lang_pred for r in identify_languages(frame, model).collect()}
    assert [found[i] for i in (1, 2, 3)] == ["und"] * 3 and found[4] != "und"


def test_all_texts_that_may_be_learned_are_counted(spark):
    """40,000 texts and 12 of another language whose ids come last by hash: any bound leaves these out."""
    ids = spark.range(10**6, 10**6 + 20_000)
    late = ids.filter(learnable(F.col("id")) & (F.xxhash64(F.col("id").cast("string")) > int(0.95 * 2**63))).limit(12)
    rng = random.Random(4)

    def text(parts):
        return " ".join("".join(rng.choice(parts.split()) for _ in range(3)) for _ in range(12))

    rows = [(r.id, text("xe zu qo wy"), "bb") for r in late.collect()]
    assert len(rows) == 12
    rows += [(i, text("ka lo mi ta"), "aa") for i in range(40_000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for typical in (True, False):
        kept = keep_languages(frame, min_score=0.5, typical=typical)
        assert kept.columns == frame.columns and kept.filter("lang = 'bb'").count() == 12
        assert kept.filter("lang = 'aa'").count() > 39_900
    found = {r.lang_pred for r in identify_languages(frame.filter("lang = 'bb'"), fit_languages(frame, max_docs=None)).collect()}
    assert found == {"bb"}


def test_limits_are_quantiles_of_all_texts(spark):
    rng = np.random.default_rng(3)
    fits = rng.normal(-6, 1, 5001)
    frame = spark.createDataFrame([(i % 2, float(x)) for i, x in enumerate(fits)], "lang int, fit double")
    for row in language._floors(frame).collect():
        low, middle = np.quantile(fits[row.lang :: 2], [language.FLOOR_QUANTILE, 0.5])
        assert row.floor == pytest.approx(middle - language.FLOOR_REACH * (middle - low), abs=0.02)


def test_more_languages_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(language, "TASK_LANGUAGES", 2)
    rows = [(i, "abc def " * (i % 5 + 1), f"l{i % 5}") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1)
    assert fit_languages(frame, max_docs=None).languages == ("l0", "l1", "l2", "l3", "l4")
