"""Operator 10: benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tierflow.functions.naming import free_name
from tierflow.llm.common import FOLD, batch, col, fold_words, map_arrow, saved, texts_of
from tierflow.llm.ngram_join import ngram_sets

WINDOW = 10
AUTOMATON_WORDS = 200_000
# Items up to this size, and one automaton's words, are sent to every task; more are searched by groups.
SHARED_BYTES = 16 << 20
FILTER_BITS = 1 << 27
PIECE_TEXTS = 20_000


class WordAutomaton:
    """Suffix automaton of several word sequences, with what decontamination asks of its states.

    A state stands for the word strings that end at the same places. ``length`` is its longest
    string, ``link`` the state of the longest suffix that ends at more places. After a document word,
    the state and the matched length give the longest string ending there that occurs in any item.
    """

    def __init__(self, items: Iterable[tuple[str | None, Sequence[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        ends: list[tuple[int, str | None]] = []  # state after each place where a window ends
        short: list[tuple[int, int, str | None]] = []
        for name, words in items:
            if not words:
                continue
            self.shortest = min(self.shortest, len(words))
            state = 0
            for place, word in enumerate(words, start=1):
                state = self._extend(state, self.vocabulary.setdefault(word, len(self.vocabulary)))
                if place >= window:
                    ends.append((state, name))
            if len(words) < window:
                short.append((state, len(words), name))
        self._mark(ends, short)

    def _extend(self, last: int, word: int) -> int:
        """Append a word after ``last``; the state may exist already from an earlier item."""
        if word in self.next[last]:
            known = self.next[last][word]
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, word, known)
        state = self._add(self.length[last] + 1, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at < 0:
            self.link[state] = 0
        else:
            known = self.next[at][word]
            fits = self.length[known] == self.length[at] + 1
            self.link[state] = known if fits else self._split(at, word, known)
        return state

    def _add(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, at: int, word: int, known: int) -> int:
        """A state of its own for the shorter strings of ``known``."""
        copy = self._add(self.length[at] + 1, dict(self.next[known]))
        self.link[copy] = self.link[known]
        self.link[known] = copy
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _upto(self, state: int, length: int) -> int:
        """The suffix state whose strings include the one of ``length`` words."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _mark(self, ends, short) -> None:
        self.full: dict[int, set] = {}  # window state -> items with that window
        for state, name in ends:
            self.full.setdefault(self._upto(state, self.window), set()).add(name)
        self.brief: dict[int, dict[int, set]] = {}  # state -> length of a whole short item -> items
        for state, length, name in short:
            self.brief.setdefault(self._upto(state, length), {}).setdefault(length, set()).add(name)

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        edges = self.next
        while word not in edges[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            matched = self.length[state]
        return edges[state][word], matched + 1

    def lengths(self, words: Sequence[bytes]) -> list[int]:
        """Longest match ending at each word."""
        state, matched, found = 0, 0, []
        for word in words:
            known = self.vocabulary.get(word)
            state, matched = (0, 0) if known is None else self.step(state, matched, known)
            found.append(matched)
        return found

    def scan(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans ``(first, end)`` of word numbers, apart and in order, and the items hit."""
        get = self.vocabulary.get
        ids = [get(w) for w in words]
        spans: list[tuple[int, int]] = []
        items: set = set()
        known = np.array([i is not None for i in ids], dtype=bool)
        # A match lies inside a run of words that the items know; shorter runs cannot hold one.
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        for low, high in edges.reshape(-1, 2)[np.diff(edges.reshape(-1, 2), axis=1)[:, 0] >= self.shortest].tolist():
            self._scan_run(ids, low, high, spans, items)
        return spans, items

    def _scan_run(self, ids, low: int, high: int, spans: list, items: set) -> None:
        window, state, matched = self.window, 0, 0
        for place in range(low, high):
            state, matched = self.step(state, matched, ids[place])
            hit = 0
            if matched >= window:
                hit = window
                items |= self.full[self._upto(state, window)]
            if self.brief:
                at, have = state, matched
                while at > 0:
                    for length, names in self.brief.get(at, {}).items():
                        if length <= have:
                            hit = max(hit, length)
                            items |= names
                    at = self.link[at]
                    have = self.length[at]
            if hit:
                first = place + 1 - hit
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, place + 1))


def item_pieces(
    benchmark: DataFrame, item_id: str, text: str, window: int = WINDOW, max_words: int = AUTOMATON_WORDS
) -> DataFrame:
    """``name, words, n``: distinct items with words, written once. An item of many words is cut into pieces that
    share ``window - 1`` words, so each run of ``window`` words lies whole in a piece and no piece fills a group."""
    most = max(4 * window, max_words // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, pieces, sizes = [], [], []
            for name, body in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                words = fold_words(body)
                for low in range(0, max(len(words) - window + 1, min(len(words), 1)), most - window + 1):
                    names.append(name)
                    pieces.append(b" ".join(words[low : low + most]).decode())
                    sizes.append(len(words[low : low + most]))
            yield batch({"name": (names, pa.string()), "words": (pieces, pa.string()), "n": (sizes, pa.int64())})

    rows = map_arrow(benchmark.select(col(item_id).cast("string"), col(text)), run, "name string, words string, n bigint")
    return saved(rows.distinct(), "benchmark-items")


_built: dict[bytes, WordAutomaton] = {}


def _automaton(group, window: int) -> WordAutomaton:
    """The automaton of a group; the last one built stays in the Python worker."""
    key = hashlib.sha256(repr((group, window)).encode()).digest()
    if key not in _built:
        _built.clear()
        _built[key] = WordAutomaton([(n, t.split()) for n, t in group], window)
    return _built[key]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    done: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if done and done[-1][1] >= first:
            done[-1] = done[-1][0], max(end, done[-1][1])
        else:
            done.append((first, end))
    return done


def _scan_batch(texts: list[bytes], group, window: int) -> list[tuple[list[tuple[int, int]], set]]:
    """Per text its hit spans and items."""
    automaton = _automaton(group, window)
    return [automaton.scan(fold_words(text)) for text in texts]


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
SPANS = "array<struct<first:bigint,end:bigint>>"
MATCHES = f"doc_id bigint, n_words bigint, spans {SPANS}, items array<string>"


def _found_columns(found: list[tuple[list[tuple[int, int]], set]]) -> list[pa.Array]:
    spans = pa.array([[{"first": f, "end": e} for f, e in s] for s, _ in found], _SPANS)
    return [spans, pa.array([sorted(x for x in i if x is not None) for _, i in found], pa.list_(pa.string()))]


def _hits(texts: DataFrame, bits: np.ndarray, lengths: list[int], window: int) -> DataFrame:
    """``key, hash`` of runs of words that pass the filter, from ``key, text``; ``lengths`` are those of short items."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, hashes = [], []
            for key, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                runs = np.unique(np.concatenate([ngram_sets([text], n)[0] for n in (window, *lengths)]))
                passed = runs[_passes(runs, shared.value)].view(np.int64).tolist()
                keys += [key] * len(passed)
                hashes += passed
            yield batch({"key": (keys, pa.binary()), "hash": (hashes, pa.int64())})

    return map_arrow(texts, run, "key binary, hash bigint")


def _places(hashes: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(n_bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def _passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    a, b = _places(hashes, len(bits) * 64)
    bit = lambda at: (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
    return (bit(a) & bit(b)).astype(bool)


def _filter_bits(runs: DataFrame) -> np.ndarray:
    """Bloom filter of ``runs.hash`` with about 16 bits a run and at most ``FILTER_BITS`` (16 MB): beyond that
    more runs pass to the exact join, no other result follows. Words of the filter are combined in tasks."""
    n_bits = max(64, min(FILTER_BITS, 1 << (16 * max(1, runs.count())).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), n_bits))
            values = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield batch({"at": ((at >> np.uint64(6)).astype(np.int64), pa.int64()), "bits": (values, pa.int64())})

    table = map_arrow(runs.select("hash"), run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    got = table.toArrow()
    bits = np.zeros(n_bits // 64, dtype=np.uint64)
    bits[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return bits


def _item_runs(items: DataFrame, window: int) -> DataFrame:
    """``hash, group`` of every run of ``window`` words of an item, or of all words of a shorter one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                runs = ngram_sets([text], window)[0].view(np.int64)
                yield batch({"hash": (runs, pa.int64()), "group": ([group] * len(runs), pa.int32())})

    rows = map_arrow(items.select("group", "words"), run, "hash bigint, `group` int")
    return saved(rows.distinct(), "benchmark-runs")


def _scan_rows(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows ``group, piece, is_text, name, key, text``, the items of a group and piece before its texts, to
    ``key, spans, items``. One automaton is held at a time and built once for all texts of the piece."""
    at, items, automaton = None, [], None
    for b in batches:
        keys, found = [], []
        groups, pieces, is_text, names, marks = (b.column(i).to_pylist() for i in range(5))
        for *here, text_row, name, key, text in zip(groups, pieces, is_text, names, marks, texts_of(b.column(5))):
            if here != at:
                at, items, automaton = here, [], None
            if not text_row:
                items.append((name, text.split()))
                continue
            automaton = automaton or WordAutomaton(items, window)
            keys.append(key)
            found.append(automaton.scan(fold_words(text)))
        columns = [pa.array(keys, pa.binary()), *_found_columns(found)]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "spans", "items"])


def _scan_groups(dealt: DataFrame, window: int) -> DataFrame:
    run = lambda batches: _scan_rows(batches, window)
    return map_arrow(dealt, run, f"key binary, spans {SPANS}, items array<string>")


def _merge_groups(found: DataFrame) -> DataFrame:
    """One row per text: its spans of all groups joined where they touch, its items once."""
    rows = found.groupBy("key").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [_merged([(s["first"], s["end"]) for s in row]) for row in b.column(1).to_pylist()]
            columns = _found_columns(list(zip(spans, map(set, b.column(2).to_pylist()))))
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["its_key", "spans", "items"])

    return saved(map_arrow(rows, run, f"its_key binary, spans {SPANS}, items array<string>"), "benchmark-matches")


def _by_groups(docs: DataFrame, text_column: str, items: DataFrame, n_groups: int, window: int) -> DataFrame:
    """``its_key, spans, items`` of the texts that hold a run of an item; the key is a hash of the text.

    Items go to groups by hash. Runs of words are hashed on both sides; those of the texts pass a filter of
    bounded size and are joined with the items' runs, which gives the groups each text must be searched for.
    Only these texts are sent on, to the automata of those groups; a group with many texts is dealt in pieces.
    """
    group = F.pmod(F.xxhash64("name", "words"), F.lit(n_groups)).cast("int")
    items = saved(items.withColumn("group", group), "benchmark-groups")
    runs = _item_runs(items, window)
    lengths = sorted(r.n for r in items.filter(F.col("n") < window).select("n").distinct().collect())
    text = col(text_column)
    texts = docs.filter(text.isNotNull()).select(F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))
    hits = _hits(texts, _filter_bits(runs), lengths, window)
    # Copies of one text, and a passage that very many share, are one row each before they meet the runs.
    hits = saved(hits.distinct(), "benchmark-hits")
    wanted = saved(hits.join(runs, "hash").select("key", "group").distinct(), "benchmark-candidates")
    sizes = wanted.groupBy(F.col("group").alias("g")).agg(F.ceil(F.count(F.lit(1)) / PIECE_TEXTS).cast("int").alias("pieces"))
    sizes = saved(sizes, "benchmark-pieces")
    keys = wanted.select(F.col("key").alias("k")).distinct()
    needed = saved(texts.join(keys, F.col("key") == F.col("k"), "left_semi").dropDuplicates(["key"]), "benchmark-texts")
    named = wanted.join(sizes, F.col("group") == F.col("g")).select(
        "group", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int").alias("piece"), F.col("key").alias("k")
    )
    none = F.lit(None)
    searched = named.join(needed, F.col("k") == F.col("key")).select(
        "group", "piece", F.lit(True).alias("is_text"), none.cast("string").alias("name"), "key", "text"
    )
    searching = items.join(sizes, F.col("group") == F.col("g")).select(
        "group", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(False).alias("is_text"),
        "name", none.cast("binary").alias("key"), F.col("words").alias("text"),
    )
    dealt = searched.unionAll(searching).repartition("group", "piece").sortWithinPartitions("group", "piece", "is_text")
    return _merge_groups(_scan_groups(dealt, window))


Found = list[tuple[list[tuple[int, int]], set]]


def _with_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str,
    item_column: str,
    item_text: str,
    window: int,
    max_words: int,
    finish: Callable[[pa.RecordBatch, Found], pa.RecordBatch],
    schema: str | StructType,
) -> DataFrame:
    """``finish`` over batches of ``docs`` with the hit spans and items of each row, in one pass of Python.

    Items of at most ``max_words`` words and ``SHARED_BYTES`` together are one automaton, sent to every task.
    More are searched by groups (``_by_groups``), where nothing but a filter of bounded size is sent to all.
    """
    items = item_pieces(benchmark, item_column, item_text, window, max_words)
    size = F.octet_length("words") + F.octet_length(F.coalesce("name", F.lit("")))
    zero = F.lit(0)
    total = items.agg(F.coalesce(F.sum("n"), zero).alias("n"), F.coalesce(F.sum(size), zero).alias("size")).first()
    at, width = docs.columns.index(text_column), len(docs.columns)
    if total.n <= max_words and total.size <= SHARED_BYTES:
        group = sorted(((r.name, r.words.encode()) for r in items.collect()), key=lambda x: (x[0] is None, x[0] or "", x[1]))
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield finish(b, _scan_batch(texts_of(b.column(at)), shared.value, window))

        return map_arrow(docs, scan, schema)
    found = _by_groups(docs, text_column, items, -(-2 * total.n // max_words), window)
    its_key, spans, names = (free_name(docs, n) for n in ("its_key", "spans", "items"))
    found = found.select(F.col("its_key").alias(its_key), F.col("spans").alias(spans), F.col("items").alias(names))
    key = F.unhex(F.md5(col(text_column).cast("binary")))
    joined = docs.join(found, key == col(its_key), "left").select(*(col(c) for c in [*docs.columns, spans, names]))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(width).to_pylist(), b.column(width + 1).to_pylist())
            matches = [([(x["first"], x["end"]) for x in s or []], set(i or [])) for s, i in rows]
            yield finish(pa.RecordBatch.from_arrays(b.columns[:width], names=b.schema.names[:width]), matches)

    return map_arrow(joined, take, schema)


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """Where test items occur in documents: ``doc_id, n_words, spans, items``.

    Words are ``fold_words`` of the whole text. Every run of ``window`` words of an item counts, and
    an item with fewer words as a whole. ``spans`` are the hit word ranges (``end`` not included),
    apart and in order; ``items`` the distinct items, sorted as strings. Null or empty text has no
    words, hence no span. A null item id is matched but not named. An item that occurs twice in the
    table is one item; one without words matches nothing. An empty benchmark gives no spans, an empty
    table of documents no rows. One row per document row, repeated rows and null ids included; other
    columns are not looked at. A text is searched whole, by one task for each group it shares a run with.
    """
    rows = docs.select(col(id_column).cast("bigint").alias("doc_id"), col(text_column).alias("text"))

    def finish(b: pa.RecordBatch, found: Found) -> pa.RecordBatch:
        n_words = pa.array([len(fold_words(t)) for t in texts_of(b.column(1))], pa.int64())
        columns = [b.column(0), n_words, *_found_columns(found)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "spans", "items"])

    return _with_matches(rows, benchmark, "text", item_column, item_text, window, max_words, finish, MATCHES)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``: words inside a
    match, items with a match, SHA-256 of their ids joined by commas, and whether there is any."""
    found = benchmark_matches(docs, benchmark, **options)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["first"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without its words ``first`` to ``end`` of each span and what stands between them."""
    word = np.frombuffer(text.translate(FOLD), dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8))).reshape(-1, 2)
    parts, at = [], 0
    for first, end in spans:
        parts.append(text[at : edges[first][0]])
        at = int(edges[end - 1][1])
    return b"".join([*parts, text[at:]])


def remove_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_column: str = "text",
    size_column: str | None = "n_chars",
    item_column: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_coverage: float = 0.5,
    max_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """``docs`` without benchmark passages, columns as they were.

    Every span of ``window`` or more matching words is cut out of the text, from its first to its
    last word, and ``size_column`` (if the table has it) is set to the new length. A document goes
    when more than ``max_coverage`` of its words are hit. Documents without a match, null and empty
    texts among them, stay as they are; repeated rows are all treated alike, and columns of any name pass
    through. An empty table gives no rows.
    """
    at = docs.columns.index(text_column)
    size_at = docs.columns.index(size_column) if size_column in docs.columns else None

    def finish(b: pa.RecordBatch, matches: Found) -> pa.RecordBatch:
        texts = texts_of(b.column(at))
        found = [spans for spans, _ in matches]
        hit = [sum(e - f for f, e in spans) for spans in found]
        keep = [not n or n / len(fold_words(t)) <= max_coverage for n, t in zip(hit, texts)]
        changed = {i: _without(texts[i], s).decode() for i, s in enumerate(found) if s and keep[i]}
        columns = list(b.columns)
        if changed:
            old = columns[at].to_pylist()
            columns[at] = pa.array([changed.get(i, x) for i, x in enumerate(old)], columns[at].type)
            if size_at is not None:
                sizes = columns[size_at].to_pylist()
                new = [len(changed[i]) if i in changed else x for i, x in enumerate(sizes)]
                columns[size_at] = pa.array(new, columns[size_at].type)
        return pa.RecordBatch.from_arrays(columns, names=b.schema.names).filter(pa.array(keep, pa.bool_()))

    return _with_matches(docs, benchmark, text_column, item_column, item_text, window, max_words, finish, docs.schema)
