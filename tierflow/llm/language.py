"""Operator 7: language identification with script ranges and Viterbi over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.llm.common import batch, col, learnable, map_arrow

# First code point of each range and its script; 0 means no script of its own.
SCRIPT_RANGES = (
    (0x0000, 0), (0x0041, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0),
    (0x0750, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 0), (0x0B80, 9), (0x0C00, 0), (0x0E00, 10),
    (0x0E80, 0), (0x10A0, 11), (0x1100, 12), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 13),
    (0x3100, 0), (0x3400, 14), (0xA000, 0), (0xAC00, 12), (0xD7B0, 0), (0xF900, 14), (0xFB00, 1), (0xFB10, 0),
    (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 0), (0xFF21, 1), (0xFF66, 13), (0xFFA0, 0), (0x20000, 14),
)
SCRIPTS = 15
BUCKETS = 1 << 16
FIT_DOCS = 20_000
SWITCH_PENALTY = 8.0
STEP_CHARS = 500_000
# Languages whose counts a task holds at once.
TASK_LANGUAGES = 64
# Letters of another language count as such where that language explains them better by this much a
# letter; less is chance.
CLEAR_GAIN = 1.0
# A text as likely as those learned: allowance for short ones in standard deviations of a trigram, and
# how far below the median one may lie, as a multiple of the distance of the learned quantile.
SHORT_ALLOWANCE = 15.0
FLOOR_QUANTILE = 0.05
FLOOR_REACH = 5.0

_TABLE = 0x20000
_starts, _scripts = (np.array(x) for x in zip(*SCRIPT_RANGES))
_SCRIPT = _scripts[np.searchsorted(_starts, np.arange(_TABLE), side="right") - 1].astype(np.int8)
_LETTER = np.array([chr(c).isalpha() for c in range(_TABLE)])


@dataclass(frozen=True)
class LanguageModel:
    """``scores[bucket, language]``: log probability of a letter trigram; ``uses[script, language]``:
    whether the language is written in the script."""

    languages: tuple[str, ...]
    scores: np.ndarray
    uses: np.ndarray

    @cached_property
    def spread(self) -> np.ndarray:
        """Standard deviation of the log probability of a trigram of each language."""
        p = np.exp(self.scores.astype(np.float64))
        return np.sqrt((p * (self.scores - (p * self.scores).sum(axis=0)) ** 2).sum(axis=0))


@dataclass(frozen=True)
class _Words:
    """Words of several texts, one after the other: document, place in the document's text, trigram
    buckets of their letters (from ``first`` on), script."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    buckets: np.ndarray
    first: np.ndarray
    script: np.ndarray


def _words(texts: list[str]) -> _Words:
    """Runs of letters. A trigram is a letter with its two neighbours, 0 outside the word."""
    # Lowering may change the number of characters (one letter does); such texts stay as they are.
    low = [x if len(x) == len(t) else t for t, x in ((t, t.lower()) for t in texts)]
    code = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.minimum(code, _TABLE - 1)
    letter = _LETTER[inside]
    high = np.flatnonzero(code >= _TABLE)
    if len(high):
        kinds, which = np.unique(code[high], return_inverse=True)
        letter[high] = np.array([chr(c).isalpha() for c in kinds.tolist()])[which]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).astype(np.int8))).reshape(-1, 2)
    lengths = np.array([len(t) for t in low], dtype=np.int64)
    offsets = np.cumsum(lengths + 1) - lengths - 1
    doc = np.searchsorted(offsets, edges[:, 0], side="right") - 1
    masked = np.where(letter, code, 0).astype(np.uint64)
    before = np.concatenate(([0], masked[:-1])).astype(np.uint64)
    after = np.concatenate((masked[1:], [0])).astype(np.uint64)
    # Fixed odd multipliers of a multiplicative hash.
    mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (masked * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (after * np.uint64(0x165667B19E3779F9))) * np.uint64(0xD6E8FEB86659FD93)
    buckets = (mixed[letter] >> np.uint64(48)).astype(np.int64)
    sizes = edges[:, 1] - edges[:, 0]
    place = edges - offsets[doc][:, None]
    script = np.where(code[edges[:, 0]] < _TABLE, _SCRIPT[inside[edges[:, 0]]], 14)
    return _Words(doc, place[:, 0], place[:, 1], buckets, np.cumsum(sizes) - sizes, script)


def _steps(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``STEP_CHARS`` characters together, with the number of the first."""
    low, size = 0, 0
    for i, text in enumerate(texts):
        if i > low and size + len(text) > STEP_CHARS:
            yield low, texts[low:i]
            low, size = i, 0
        size += len(text)
    if low < len(texts):
        yield low, texts[low:]


def _usable(id_column: str, lang_column: str) -> Column:
    """Whether a document may be learned and has a language."""
    return learnable(col(id_column)) & col(lang_column).isNotNull()


def _learned_from(
    docs: DataFrame, id_column: str, text_column: str, lang_column: str, max_docs: int | None
) -> DataFrame:
    """``d, t, l``: id, text and language of all documents that may be learned, or of about ``max_docs``."""
    usable = docs.filter(_usable(id_column, lang_column)).select(
        col(id_column).alias("d"), col(text_column).alias("t"), col(lang_column).cast("string").alias("l")
    )
    if max_docs is None:
        return usable
    n = usable.count()
    share = min(1.0, max_docs / n) if n else 1.0
    if share < 1:
        # The whole range of the hash, so that the share may be as small as it has to be.
        usable = usable.filter(F.xxhash64(F.col("d").cast("string")) < int(share * 2**64) - 2**63)
    return usable


def fit_languages(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    max_docs: int | None = FIT_DOCS,
) -> LanguageModel:
    """Trigram and script counts of documents that may be learned (``learnable``) and have a language.

    About ``max_docs`` of them, chosen by a hash of the id, are read, or all without that limit; the counts
    are made and added up in tasks. The driver gets one row per language and bucket or script at most. With nothing to learn
    from, the model has no language and predicts none.
    """
    return _fit(_learned_from(docs, id_column, text_column, lang_column, max_docs))


def _fit(usable: DataFrame) -> LanguageModel:
    def rows_of(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, its in counts.items():
            there = np.flatnonzero(its)
            there = there if len(there) else np.array([0])
            yield batch(
                {
                    "lang": ([lang] * len(there), pa.string()),
                    "feature": (there, pa.int32()),
                    "n": (its[there], pa.int64()),
                }
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column(1).to_pylist(), b.column(0).to_pylist()):
                by.setdefault(lang, []).append(text or "")
            for lang, texts in by.items():
                if lang not in counts:
                    if len(counts) == TASK_LANGUAGES:
                        yield from rows_of(counts)
                        counts = {}
                    counts[lang] = np.zeros(BUCKETS + SCRIPTS, dtype=np.int64)
                for _, part in _steps(texts):
                    words = _words(part)
                    counts[lang][:BUCKETS] += np.bincount(words.buckets, minlength=BUCKETS)
                    counts[lang][BUCKETS:] += np.bincount(words.script, minlength=SCRIPTS)
        yield from rows_of(counts)

    rows = map_arrow(usable.select("t", "l"), run, "lang string, feature int, n bigint")
    table = rows.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(table["lang"].to_pylist()))
    counts = np.zeros((BUCKETS + SCRIPTS, len(names)))
    at = np.array([names.index(x) for x in table["lang"].to_pylist()], dtype=np.int64)
    counts[table["feature"].to_numpy(), at] = table["n"].to_numpy()
    grams, scripts = counts[:BUCKETS] + 0.01, counts[BUCKETS:]
    scores = np.log(grams / grams.sum(axis=0)).astype(np.float32)
    # A language uses a script if a hundredth of its words are written in it.
    uses = scripts >= np.maximum(1, scripts.sum(axis=0) / 100)
    return LanguageModel(tuple(names), scores, uses)


def _emissions(words: _Words, model: LanguageModel) -> np.ndarray:
    """Score of each word in each language, relative to its best. A script narrows the languages to
    those that use it; one that no language uses narrows nothing."""
    if not len(words.doc):
        return np.zeros((0, len(model.languages)), dtype=np.float32)
    # Trigrams overlap, so a word's evidence is counted half.
    scores = np.add.reduceat(model.scores[words.buckets], words.first, axis=0) / 2
    uses = model.uses | ~model.uses.any(axis=1, keepdims=True)
    uses[0] = True
    scores[~uses[words.script]] -= 1000
    return scores - scores.max(axis=1, keepdims=True)


def _viterbi(emission: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float) -> np.ndarray:
    """Best language of each word. All documents advance together, word by word: staying is free, a
    switch to another language costs ``penalty``. Ties prefer staying, then the first language."""
    lengths = np.bincount(doc, minlength=n_docs)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    longest = int(lengths[0]) if n_docs else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    label = np.zeros(len(doc), dtype=np.int32)
    if not longest:
        return label
    came = np.zeros(emission.shape, dtype=np.int32)
    state = np.zeros((n_docs, emission.shape[1]), dtype=np.float32)
    own = np.arange(emission.shape[1])
    for t in range(longest):
        k = active[t]
        at, now = starts[:k] + t, state[:k]
        if t:
            best = now.argmax(axis=1)
            jump = now[np.arange(k), best] - np.float32(penalty)
            stay = now >= jump[:, None]
            came[at] = np.where(stay, own, best[:, None])
            now = np.where(stay, now, jump[:, None])
        now = now + emission[at]
        state[:k] = now - now.max(axis=1, keepdims=True)
    last = state.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        label[at] = last[:k]
        last[:k] = came[at, last[:k]]
    return label


@dataclass(frozen=True)
class _Evidence:
    """Per text: number of the language with most letters, its share of all letters, its lead, and the
    likelihood of its letters with the allowance for short texts."""

    best: np.ndarray
    share: np.ndarray
    lead: np.ndarray
    fit: np.ndarray


def _evidence(words: _Words, labels: np.ndarray, n: int, model: LanguageModel) -> _Evidence:
    """The lead is the share of letters in the language, or not clearly in another, less the share of all
    others, 0 at least. Letters in a script that no learned language uses are no evidence for any."""
    many = len(model.languages)
    size = words.end - words.start
    at = words.doc * many + labels
    best = np.bincount(at, size, minlength=n * many).reshape(n, many).argmax(axis=1)
    main = best[words.doc]
    used = model.uses.any(axis=1)[words.script]
    weights = np.bincount(at, size * used, minlength=n * many).reshape(n, many)
    letters = np.maximum(np.bincount(words.doc, size, minlength=n), 1)
    mine = theirs = np.zeros(len(size))
    if len(size):
        theirs = np.add.reduceat(model.scores[words.buckets, np.repeat(labels, size)], words.first, dtype=np.float64)
        mine = np.add.reduceat(model.scores[words.buckets, np.repeat(main, size)], words.first, dtype=np.float64)
    gain = np.bincount(at, (theirs - mine) * used, minlength=n * many).reshape(n, many)
    foreign = np.where(gain >= CLEAR_GAIN * np.maximum(weights, 1), weights, 0)
    own = weights[np.arange(n), best]
    clear = (weights.sum(axis=1) - foreign.sum(axis=1)) / letters
    mean = np.bincount(words.doc, mine * (used & (labels == main)), minlength=n) / np.maximum(own, 1)
    fit = mean + SHORT_ALLOWANCE * model.spread[best] / np.sqrt(np.maximum(own, 1))
    return _Evidence(best, own / letters, np.maximum(2 * clear - 1, 0), fit)


SPANS = "doc_id bigint, spans array<struct<start:int,end:int,lang:string>>, lang_pred string, score double"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def _label(texts: list[str], model: LanguageModel, penalty: float) -> list[tuple[list[dict], str, float]]:
    words = _words(texts)
    labels = _viterbi(_emissions(words, model), words.doc, len(texts), penalty)
    evidence = _evidence(words, labels, len(texts), model)
    breaks = np.flatnonzero((np.diff(words.doc, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
    ends = np.append(breaks, len(labels))[1:] - 1
    found: list[list[dict]] = [[] for _ in texts]
    for doc, lang, start, end in zip(
        words.doc[breaks].tolist(),
        labels[breaks].tolist(),
        words.start[breaks].tolist(),
        words.end[ends].tolist(),
    ):
        found[doc].append({"start": start, "end": end, "lang": model.languages[lang]})
    return [
        (spans, model.languages[best], lead) if spans else (spans, "und", 0.0)
        for spans, best, lead in zip(found, evidence.best.tolist(), evidence.lead.tolist())
    ]


def identify_languages(
    docs: DataFrame,
    model: LanguageModel,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    penalty: float = SWITCH_PENALTY,
) -> DataFrame:
    """Per document ``doc_id, spans, lang_pred, score``.

    Words are runs of letters. ``spans`` are stretches of words with one language, by character. The
    predicted language has most letters; equal shares go to the first name. ``score`` is its lead: 1 in
    one language alone, 0 in two by halves, 0.5 at three letters to one; letters of another language
    count where that language explains them clearly better (``CLEAR_GAIN``), and letters in a script
    that no learned language uses count against all. Text that is null or has no letter gives no span, ``und`` and 0, and so does every text if
    the model knows no language. Repeated rows and null ids give a row each; other columns are not
    looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found: list[tuple[list[dict], str, float]] = []
            for _, part in _steps(texts):
                known = bool(shared.value.languages)
                found += _label(part, shared.value, penalty) if known else [([], "und", 0.0)] * len(part)
            yield batch(
                {
                    "doc_id": (b.column(0), pa.int64()),
                    "spans": ([s for s, _, _ in found], _SPANS),
                    "lang_pred": ([x for _, x, _ in found], pa.string()),
                    "score": ([x for _, _, x in found], pa.float64()),
                }
            )

    return map_arrow(docs.select(col(id_column).cast("bigint"), col(text_column)), run, SPANS)


def predict_languages(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """Fit on the documents that may be learned and label all: ``doc_id, held_out, lang_pred, score``."""
    names = {"id_column": id_column, "text_column": text_column}
    model = fit_languages(docs, **names, **options)
    return identify_languages(docs, model, **names).select(
        "doc_id", (~learnable(F.col("doc_id")) & F.col("doc_id").isNotNull()).alias("held_out"), "lang_pred", "score"
    )


def _judge(texts: list[str], model: LanguageModel) -> _Evidence:
    words = _words(texts)
    labels = _viterbi(_emissions(words, model), words.doc, len(texts), SWITCH_PENALTY)
    return _evidence(words, labels, len(texts), model)


def _floors(judged: DataFrame) -> DataFrame:
    """``lang, floor`` from ``lang, fit`` of all texts that were learned: the least likelihood of a text in each
    language. Likelihoods are counted by thousandths first, so that no task holds a row per text."""
    low, middle = FLOOR_QUANTILE, 0.5
    counts = judged.groupBy("lang", F.round("fit", 3).alias("fit")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy("lang").agg(F.percentile("fit", F.array(F.lit(low), F.lit(middle)), F.col("n")).alias("q"))
    lowest, median = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    return found.select("lang", (median - FLOOR_REACH * (median - lowest)).alias("floor"))


def fit_floors(usable: DataFrame, model: LanguageModel) -> np.ndarray:
    """Per language the least likelihood of a text in it, from the texts that were learned. Texts of a
    language that gave no sample are not held against one."""
    floors = np.full(len(model.languages), -np.inf)
    if not model.languages:
        return floors
    shared = usable.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in _steps([t or "" for t in b.column(0).to_pylist()]):
                found = _judge(part, shared.value)
                there = found.share > 0
                yield batch({"lang": (found.best[there], pa.int32()), "fit": (found.fit[there], pa.float64())})

    for row in _floors(map_arrow(usable.select("t"), run, "lang int, fit double")).collect():
        floors[row.lang] = row.floor
    return floors


def keep_languages(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    max_docs: int | None = None,
    min_share: float = 0.5,
    min_score: float = 0.0,
    typical: bool = False,
) -> DataFrame:
    """``docs`` whose text has a learned language. Columns and rows are otherwise as they were.

    ``min_share`` of all letters are in the predicted language, and its lead over all else, the score of
    ``identify_languages``, is ``min_score`` or more; letters in a script that no learned language uses
    are in none. With ``typical`` the letters of the language must also be about as likely in it as those of the
    texts it was learned from, which a text in an unlearned language of a learned script is not; a language that
    none of these texts is in has no such limit.

    Counts and limits come from all documents that may be learned and have a language, or with ``max_docs``
    from about so many.
    """
    usable = _learned_from(docs, id_column, text_column, lang_column, max_docs)
    fitted = _fit(usable)
    floors = fit_floors(usable, fitted) if typical else np.full(len(fitted.languages), -np.inf)
    model = docs.sparkSession.sparkContext.broadcast((fitted, floors))
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, floors = model.value
        for b in batches:
            keep: list[bool] = []
            for _, part in _steps([t or "" for t in b.column(at).to_pylist()]):
                if not learned.languages:
                    keep += [False] * len(part)
                    continue
                x = _judge(part, learned)
                good = (x.share > 0) & (x.share >= min_share) & (x.lead >= min_score) & (x.fit >= floors[x.best])
                keep += good.tolist()
            yield b.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
