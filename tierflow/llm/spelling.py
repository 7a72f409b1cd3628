"""Operator 11: spelling variants of words, found with a trie of letter-group counts.

Letters are dealt to groups. A word's vector holds how often each group occurs in it, and the trie
arranges words by these counts, one level per group. One inserted letter adds one to one count, one
deleted letter takes one away, a replaced letter does both or neither. So the search for the near words
of a word goes down the trie with a budget of one surplus and one deficit, and what it finds in the
leaves is compared letter by letter.

The vocabulary is not gathered anywhere. The top of the trie is known to all tasks: the prefixes of
vectors that more than ``subtree_words`` words share, a number with a proven bound. Below it lie the
subtrees, each searched in one task by its own words and by those that reach it with budget left. To
meet each pair once, a search may spend its deficit only after its surplus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tierflow.llm.common import batch, col, map_arrow, released, saved

MIN_LENGTH = 7
MIN_COUNT = 2
FORM_RATIO = 10
DELETE_EVERY = 31
# Levels of the trie: letters of their own, most frequent first, then groups of the others.
OWN_LETTERS = 10
LEVELS = 16
SUBTREE_WORDS = 30_000
MAX_SUBTREES = 20_000
LEAF_WORDS = 8
PAIRS_AT_ONCE = 250_000
FLUSH_WORDS = 200_000
# Words up to this length are compared as rows of a matrix, longer ones one by one.
MATRIX_WIDTH = 40

# Letters are the code points A-Z, a-z and U+00C0 to U+00FF, so a word fits one byte per code point.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str) -> list[bytes]:
    """Maximal runs of letters with A-Z lowered, one byte (Latin-1) per code point."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def altered(run: bytes, seed: int, every: int) -> bytes:
    """``run`` without one code point where ``every`` divides the CRC-32 of ``<id>:<run>``; ``seed`` is
    the CRC-32 of ``<id>:``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count_words(min_length: int, every: int | None):
    def flush(counts: dict[bytes, int]) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in counts]
        return batch({"word": (words, pa.string()), "n": (list(counts.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seed = zlib.crc32(f"{doc_id or ''}:".encode())
                # Only a run as long as that can give a word as long as that.
                for word, n in Counter([r for r in runs_of(text or "") if len(r) >= min_length]).items():
                    if every:
                        word = altered(word, seed, every)
                        if len(word) < min_length:
                            continue
                    counts[word] = counts.get(word, 0) + n
                if len(counts) >= FLUSH_WORDS:
                    yield flush(counts)
                    counts = {}
        if counts:
            yield flush(counts)

    return run


def vocabulary(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    delete_every: int | None = None,
) -> DataFrame:
    """``word, n``: distinct words of ``min_length`` code points or more with their occurrences in all
    documents, from ``min_count`` on.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF of the whole text, A-Z lowered. With
    ``delete_every``, typing errors are planted: a run for which that number divides the CRC-32 of
    ``<id>:<run>`` loses the code point at that value modulo its length. Ids may be of any type; a null
    id counts as empty. Null or empty texts and an empty table have no words; repeated rows count each
    time; other columns are not looked at. A text of any length is one row of one task, which holds its
    words at once. Counts are added up inside tasks before the shuffle, so a word that every document
    has is one row per task.
    """
    rows = docs.select(col(id_column).cast("string").alias("id"), col(text_column).alias("text"))
    counted = map_arrow(rows, _count_words(min_length, delete_every), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _bytes_of(words: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in words.to_pylist()]


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, dtype=np.int64)
    for b in batches:
        total += np.bincount(np.frombuffer(b"".join(_bytes_of(b.column(0))), dtype=np.uint8), minlength=256)
    found = np.flatnonzero(total)
    yield batch({"letter": (found.astype(np.int32), pa.int32()), "n": (total[found], pa.int64())})


def letter_groups(words: DataFrame) -> np.ndarray:
    """Level of each letter (by its byte): frequent letters have levels of their own, the others are
    dealt to the remaining levels so that these are about as frequent. At most 256 rows reach the driver."""
    counted = words.select("word").mapInArrow(_letter_counts, "letter int, n bigint")
    rows = counted.groupBy("letter").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "letter").collect()
    level = np.zeros(256, dtype=np.int64)
    load = [0] * LEVELS
    for place, row in enumerate(rows):
        at = place if place < OWN_LETTERS else min(range(OWN_LETTERS, LEVELS), key=lambda i: (load[i], i))
        level[row.letter] = at
        load[at] += row.n
    return level


def vectors_of(words: list[bytes], level: np.ndarray) -> np.ndarray:
    """How often each letter group occurs in each word; 255 stands for 255 and more."""
    letters = np.frombuffer(b"".join(words), dtype=np.uint8)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    place = np.repeat(np.arange(len(words)) * LEVELS, lengths) + level[letters]
    counts = np.bincount(place, minlength=len(words) * LEVELS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(-1, LEVELS)


def crowded_prefixes(words: DataFrame, level: np.ndarray, limit: int) -> dict[bytes, int]:
    """Prefixes of vectors that more than ``limit`` words share, with their number of words: at most
    ``LEVELS / limit`` of the vocabulary's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = Counter(v.tobytes() for v in vectors_of(_bytes_of(b.column(0)), level))
            yield batch({"v": (list(vectors), pa.binary()), "n": (list(vectors.values()), pa.int64())})

    vectors = words.select("word").mapInArrow(run, "v binary, n bigint").groupBy("v").agg(F.sum("n").alias("n"))
    lengths = F.sequence(F.lit(1), F.lit(LEVELS))
    prefixes = vectors.select(F.explode(F.transform(lengths, lambda d: F.substring("v", F.lit(1), d))).alias("p"), "n")
    rows = prefixes.groupBy("p").agg(F.sum("n").alias("n")).filter(F.col("n") > limit).collect()
    return {bytes(r.p): r.n for r in rows}


def _steps_down(own: np.ndarray, spent: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Which searches may enter the child with ``count`` letters of the level's group, and what they
    have spent there: 0 nothing, 1 the surplus, 2 the deficit as well."""
    more = own - count
    free = more == 0
    pays = ((more == 1) & (spent == 0)) | ((more == -1) & (spent == 1))
    enters = np.flatnonzero(free | pays)
    return enters, spent[enters] + pays[enters]


def _route(vectors: np.ndarray, crowded: dict[bytes, int], n_words: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Depth-first through the top of the trie: each subtree below it with the searches that reach it."""
    start = np.arange(len(vectors))
    stack = [(b"", start, np.zeros(len(vectors), dtype=np.int8))]
    while stack:
        prefix, at, spent = stack.pop()
        depth = len(prefix)
        if depth == LEVELS or (crowded.get(prefix, 0) if depth else n_words) == 0:
            yield prefix, at, spent
            continue
        own = vectors[at, depth].astype(np.int16)
        counts = np.unique(own)
        for count in np.unique(np.concatenate((counts, counts[counts > 0] - 1, counts[counts < 255] + 1))).tolist():
            enters, left = _steps_down(own, spent, count)
            if len(enters):
                stack.append((prefix + bytes([count]), at[enters], left))


def _routed(words: DataFrame, level: np.ndarray, crowded: dict[bytes, int], n_words: int, limit: int) -> DataFrame:
    """``subtree, part, held, spent, word, n``: each word in its own subtree, and as a search in the
    others that it reaches. A single vector with more than ``limit`` words is cut into parts, and
    searches go to each part."""
    shared = words.sparkSession.sparkContext.broadcast(crowded)
    top = n_words if n_words > limit else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoded = _bytes_of(b.column(0))
            vectors = vectors_of(encoded, level)
            rows: list[tuple] = []
            for prefix, at, spent in _route(vectors, shared.value, top):
                home = (vectors[at, : len(prefix)] == np.frombuffer(prefix, dtype=np.uint8)).all(axis=1)
                parts = max(-(-shared.value.get(prefix, 0) // limit), 1) if len(prefix) == LEVELS else 1
                own = np.array([zlib.crc32(encoded[i]) % parts for i in at]) if parts > 1 else np.zeros(len(at))
                rows += [([prefix] * len(at), [part] * len(at), home & (own == part), spent, at) for part in range(parts)]
            at = pa.array(np.concatenate([r[4] for r in rows]))
            yield batch(
                {
                    "subtree": ([x for r in rows for x in r[0]], pa.binary()),
                    "part": ([x for r in rows for x in r[1]], pa.int32()),
                    "held": (np.concatenate([r[2] for r in rows]), pa.bool_()),
                    "spent": (np.concatenate([r[3] for r in rows]).astype(np.int32), pa.int32()),
                    "word": (b.column(0).take(at), pa.string()),
                    "n": (b.column(1).take(at), pa.int64()),
                }
            )

    schema = "subtree binary, part int, held boolean, spent int, word string, n bigint"
    return words.select("word", "n").mapInArrow(run, schema)


class Subtree:
    """A subtree below ``depth`` levels: the words held, in the order of their vectors, so that each
    node is a range of them; and the searches that reach it."""

    def __init__(self, words: list[bytes], held: np.ndarray, spent: np.ndarray, level: np.ndarray, depth: int):
        self.words, self.spent, self.depth = words, spent, depth
        self.vectors = vectors_of(words, level)
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.rank = np.empty(len(words), dtype=np.int64)
        self.rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        held = np.flatnonzero(held)
        self.order = held[np.lexsort(self.vectors[held].T[::-1])]
        self.sorted = self.vectors[self.order]
        letters = np.frombuffer(b"".join(words), dtype=np.uint8)
        bits = np.left_shift(np.uint64(1), (letters & 63).astype(np.uint64))
        # Letters that occur an odd number of times: one edit changes at most two bits.
        starts = np.cumsum(self.lengths) - self.lengths
        self.parity = np.bitwise_xor.reduceat(bits, starts) if len(words) else bits
        width = int(min(self.lengths.max(initial=0), MATRIX_WIDTH)) + 1
        self.matrix = np.zeros((len(words), width), dtype=np.uint8)
        column = np.arange(len(letters)) - np.repeat(starts, self.lengths)
        fits = column < width
        self.matrix[np.repeat(np.arange(len(words)), self.lengths)[fits], column[fits]] = letters[fits]

    def _candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Depth-first search: ``(searching words, held words, spent)`` of each leaf reached."""
        stack = [(0, len(self.order), self.depth, np.arange(len(self.words)), self.spent)]
        while stack:
            low, high, depth, at, spent = stack.pop()
            if depth == LEVELS or high - low <= LEAF_WORDS:
                some = max(1, PAIRS_AT_ONCE // max(high - low, 1))
                for cut in range(0, len(at), some):
                    a = at[cut : cut + some]
                    yield np.repeat(a, high - low), np.tile(self.order[low:high], len(a)), np.repeat(spent[cut : cut + some], high - low)
                continue
            column = self.sorted[low:high, depth]
            edges = [low, *(np.flatnonzero(column[1:] != column[:-1]) + low + 1).tolist(), high]
            own = self.vectors[at, depth].astype(np.int16)
            for first, end in zip(edges, edges[1:]):
                enters, left = _steps_down(own, spent, int(self.sorted[first, depth]))
                if len(enters):
                    stack.append((first, end, depth + 1, at[enters], left))

    def _near(self, a: np.ndarray, b: np.ndarray, spent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that differ by one edit, ``a`` not shorter; each pair comes from one side only."""
        longer = self.lengths[a] - self.lengths[b]
        same = longer == 0
        # Equal vectors see each other from both sides, others only where the surplus came first.
        keep = (longer == 1) | (same & ((spent > 0) | (self.rank[a] > self.rank[b])))
        keep &= np.bitwise_count(self.parity[a] ^ self.parity[b]) <= 2
        a, b, same = a[keep], b[keep], same[keep]
        width = self.matrix.shape[1]
        short = self.lengths[a] < width
        x, y = self.matrix[a], self.matrix[b]
        differs = x != y
        near = same & (np.count_nonzero(differs, axis=1) == 1)
        first = differs.argmax(axis=1)
        behind = (x[:, 1:] != y[:, :-1]) & (np.arange(width - 1) >= first[:, None])
        near |= ~same & ~behind.any(axis=1)
        for i in np.flatnonzero(~short).tolist():
            near[i] = one_edit(self.words[a[i]], self.words[b[i]])
        return a[near], b[near]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        waiting: list[tuple[np.ndarray, ...]] = []
        size = 0

        def check() -> None:
            if waiting:
                found.append(self._near(*(np.concatenate(x) for x in zip(*waiting))))
                waiting.clear()

        for some in self._candidates():
            waiting.append(some)
            size += len(some[0])
            if size >= PAIRS_AT_ONCE:
                check()
                size = 0
        check()
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter turns one word into the other."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    low, high = 0, len(b)
    while low < high:  # length of the common prefix, by halves
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return a[low + 1 :] == (b[low + 1 :] if len(a) == len(b) else b[low:])


def _search(level: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        words = _bytes_of(table.column("word"))
        n = table.column("n").to_numpy()
        held = table.column("held").to_numpy(zero_copy_only=False)
        spent = table.column("spent").to_numpy().astype(np.int8)
        tree = Subtree(words, held, spent, level, len(table.column("subtree")[0].as_py()))
        a, b = tree.pairs()
        word, other = np.concatenate((a, b)), np.concatenate((b, a))
        order = np.lexsort((tree.rank[other], -n[other], word))
        word, other = word[order], other[order]
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else word
        near = np.diff(np.append(first, len(word)))
        return pa.table(
            {
                "word": pa.array([words[i].decode("latin-1") for i in word[first]], pa.string()),
                "near": pa.array(near, pa.int64()),
                "best_n": pa.array(n[other[first]], pa.int64()),
                "best": pa.array([words[i].decode("latin-1") for i in other[first]], pa.string()),
            }
        )

    return run


def near_words(words: DataFrame, n_words: int, subtree_words: int = SUBTREE_WORDS) -> DataFrame:
    """``word, n_near, best_n, best`` of every word of ``words`` (``word, n``) with near words: how many
    they are, and the most frequent of them (the smallest of equals)."""
    limit = max(subtree_words, n_words // MAX_SUBTREES)
    level = letter_groups(words)
    crowded = crowded_prefixes(words, level, limit) if n_words > limit else {}
    routed = _routed(words, level, crowded, n_words, limit)
    found = routed.groupBy("subtree", "part").applyInArrow(
        _search(level), "word string, near bigint, best_n bigint, best string"
    )
    best = F.min(F.struct((-F.col("best_n")).alias("rest"), "best")).alias("m")
    merged = found.groupBy("word").agg(F.sum("near").alias("n_near"), best)
    return merged.select("word", "n_near", (-F.col("m.rest")).alias("best_n"), F.col("m.best").alias("best"))


def roots_of(forms: DataFrame) -> DataFrame:
    """``word, root`` of every row of ``forms`` (``word, form``), which must not run in circles: the last
    word that its forms lead to. Each round doubles the steps taken."""
    current = saved(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = current.select(F.col("word").alias("at"), F.col("root").alias("further"))
        changed = Observation()
        current = saved(
            current.join(further, F.col("root") == F.col("at"), "left")
            .observe(changed, F.count("further").alias("n"))
            .select("word", F.coalesce("further", "root").alias("root")),
            "spelling-roots",
        )
        if not changed.get["n"]:
            return current


def spelling_variants(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    form_ratio: int = FORM_RATIO,
    delete_every: int | None = None,
    subtree_words: int = SUBTREE_WORDS,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the vocabulary (see ``vocabulary``).

    Two words are near if one inserted, deleted or replaced code point turns one into the other. A
    word's ``form`` is its near word with the largest ``n`` (of equals the smallest in code point order),
    if that is at least ``form_ratio`` times its own; ``form_n`` is that word's ``n``. ``root`` follows
    the forms to the last, and is the word itself without a form. Words without near words have
    ``n_near`` 0. No words give no rows; nulls, empty and long texts and repeated rows as in
    ``vocabulary``. ``subtree_words`` bounds what a task holds, not what is found.
    """
    if form_ratio < 2:
        raise ValueError("form_ratio must be 2 or more, or forms could run in circles")
    options = {"id_column": id_column, "text_column": text_column, "min_length": min_length, "min_count": min_count}
    words = saved(vocabulary(docs, delete_every=delete_every, **options), "spelling-words")
    near = saved(near_words(words, words.count(), subtree_words), "spelling-near")
    released(docs.sparkSession)
    found = words.join(near.withColumnRenamed("word", "its_word"), F.col("word") == F.col("its_word"), "left")
    has = F.col("best_n") >= form_ratio * F.col("n")
    forms = found.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(has, F.col("best")).alias("form"),
        F.when(has, F.col("best_n")).alias("form_n"),
    )
    forms = saved(forms, "spelling-forms")
    roots = roots_of(forms.filter("form IS NOT NULL")).withColumnRenamed("word", "its_word")
    return forms.join(roots, F.col("word") == F.col("its_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
