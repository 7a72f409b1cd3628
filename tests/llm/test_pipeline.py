import zlib

import numpy as np
import sentencepiece
from test_decontaminate import brute
from test_ngram_join import grams, roots

import corpus_pipeline
from tierflow.llm.common import fold_words
from tierflow.llm.language import predict_languages
from tierflow.llm.quality_model import predict_quality
from tierflow.llm.queries import tokenizer_file


def test_stages_against_plain_loops(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    by = dict(corpus_pipeline.STAGES)

    scored = {r.doc_id for r in predict_quality(docs, labels).filter("predicted = 1").collect()}
    good = by["quality"](spark, docs, small_dir).cache()
    assert good.schema == docs.schema and {r.doc_id for r in good.collect()} == scored
    named = {r.doc_id for r in predict_languages(good).filter("lang_pred <> 'und' AND score >= 0.5").collect()}
    known = by["language"](spark, good, small_dir).cache()
    assert known.schema == docs.schema and {r.doc_id for r in known.collect()} == named

    rows = {r.doc_id: r.text for r in known.collect()}
    sets = {i: grams(t) for i, t in rows.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = roots(list(sets), pairs)
    single = by["near_duplicates"](spark, known, small_dir).cache()
    assert {r.doc_id for r in single.collect()} == set(group.values()) and single.columns == docs.columns

    clean = by["decontamination"](spark, single, small_dir).cache()
    assert clean.schema == single.schema
    after = {r.doc_id: r.text for r in clean.collect()}
    for doc_id in set(group.values()):
        n, hit, _ = brute(rows[doc_id], items, 10)
        assert (doc_id in after) == (hit <= 0.5 * n)
        if doc_id in after:
            assert len(fold_words(after[doc_id].encode())) == n - hit

    ids = by["tokens"](spark, clean, small_dir).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    assert sorted(r.doc_id for r in ids) == sorted(after)
    for row in ids:
        expected = library.encode(after[row.doc_id])
        assert row.ids == expected and row.ids_crc32 == zlib.crc32(np.array(expected, "<u4").tobytes())
    assert corpus_pipeline.run(spark, small_dir).count() == len(ids)


def test_empty_table(spark, tmp_path, small_dir):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{small_dir}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
