"""Operator 13: passages that documents share, found with prefix-partitioned suffix trees.

A passage of ``window`` words that two documents share holds the same words, so whatever is chosen by
the words alone is chosen in both. In every window the ``PREFIX``-word string with the smallest hash is
its anchor, about one word in five. Only suffixes that begin at anchors enter a tree (a sparse suffix
tree), and only those whose first ``PREFIX`` words occur in two documents: first a count by hash finds
these. A suffix is cut where its last window ends, and carries the words before it up to where its first
window begins, for a repeat goes on to the left as well.

Suffixes are split into groups by their first words: by ``PREFIX`` of them, and by one word more for as
long as a group is too large for a task. Windows that a longer prefix no longer fits in go their own way,
by all of their words. Equal suffixes are one leaf with its smallest and largest document, put together
before the shuffle, so a passage that a third of all documents have is one row per task. A group's subtree
is held as its suffixes in order with the lengths of their common prefixes: internal nodes are the ranges
of suffixes that share a length. A node deep enough that a window, seen from its anchor, lies inside it,
together with the words to the left, gives the documents that share this window.

A word goes if a window that covers it also starts in a document with a smaller id. Exact copies of a
document need no tree: all but the smallest are found by their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from tierflow.llm.common import col, map_arrow, released, saved, texts_of
from tierflow.llm.ngram_join import _mixed, _power_tables, _steps

WINDOW = 13
PREFIX = 5
# Suffixes that a group may hold before its prefix is made longer, and most groups that this may ask for.
GROUP_ROWS = 50_000
MAX_CROWDED = 10_000
# Suffixes that a task works on at once, and distinct ones it gathers before they are sent.
TREE_ROWS = 100_000
FLUSH_ROWS = 60_000


class Anchors(NamedTuple):
    """Anchors of several texts: number of the text, hash, place of the anchor and of the first word of
    its first and last window. Places count the words of all texts; ``first`` has those of each text."""

    text: np.ndarray
    hash: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and the number of words of each text."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    blank = (joined == 32) | ((joined >= 9) & (joined <= 13))
    # The last byte is a blank, so changes come in pairs: begin and end of a word.
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8))).reshape(-1, 2)
    up, down = _power_tables(len(joined) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(joined * up[: len(joined)], dtype=np.uint64)))
    hashes = (sums[edges[:, 1]] - sums[edges[:, 0]]) * down[edges[:, 0]]
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(edges[:, 0], ends))))
    return _mixed(hashes + (edges[:, 1] - edges[:, 0]).astype(np.uint64)), counts


def anchors_of(texts: Sequence[bytes], window: int = WINDOW, size: int = PREFIX) -> Anchors:
    """The anchors of all windows of ``window`` words. Windows with the same anchor are neighbours."""
    hashes, counts = word_hashes(texts)
    first = np.concatenate(([0], np.cumsum(counts)))
    if len(hashes) < window:
        none = np.empty(0, dtype=np.int64)
        return Anchors(none, none, none, none, none, first)
    grams = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
    for j in range(size):
        grams = _mixed(grams + hashes[j : j + len(grams)] * np.uint64(2 * j + 1))
    text = np.repeat(np.arange(len(texts)), counts)
    windows = np.flatnonzero(text[: len(hashes) - window + 1] == text[window - 1 :])
    spread = np.lib.stride_tricks.sliding_window_view(grams, window - size + 1)
    at = windows + spread[windows].argmin(axis=1)
    if not len(at):
        at = windows
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else at
    ends = np.append(starts[1:], len(at)) - 1 if len(at) else at
    place = at[starts]
    return Anchors(text[place], grams[place].view(np.int64), place, windows[starts], windows[ends], first)


class Suffix(NamedTuple):
    """A suffix as it goes to a group: ``words`` from the first word of its first window to the last word
    of its last one. The anchor is word ``left``; the last window begins ``least`` words before it."""

    route: int
    left: int
    least: int
    words: bytes

    def mark(self) -> bytes:
        return hashlib.blake2b(b"%d %d " % (self.left, self.least) + self.words, digest_size=16).digest()


def _hash(words: Sequence[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def routed(route: int, words: list[bytes], left: int, least: int, crowded, window: int, size: int) -> Iterator[Suffix]:
    """A suffix by its group, in several parts if prefixes of it are ``crowded`` (pairs of their length and
    hash). The windows of the parts are those of the suffix."""
    depth = size
    while (depth, route) in crowded:
        ends_here = window - depth
        if least <= ends_here <= left:
            own = words[left - ends_here : left - ends_here + window]
            yield Suffix(_hash(own), ends_here, ends_here, b" ".join(own))
        depth += 1
        most = window - depth
        if most < least:
            return
        if left > most:
            words, left = words[left - most :], most
        route = _hash(words[left : left + depth])
    yield Suffix(route, left, least, b" ".join(words))


def _suffixes(texts: list[bytes], wanted: list[list[int]], crowded, window: int, size: int) -> Iterator[tuple[int, int, Suffix]]:
    """Number of the text, place of the anchor in it, and suffix, for the anchors with a wanted hash."""
    for start, some in _steps(texts):
        found = anchors_of(some, window, size)
        words = [t.split() for t in some]
        sets = [set(wanted[start + i]) for i in range(len(some))]
        first = found.first.tolist()
        for text, h, at, low, high in zip(*(x.tolist() for x in found[:5])):
            if h in sets[text]:
                base = first[text]
                own = words[text][low - base : high - base + window]
                for suffix in routed(h, own, at - low, at - high, crowded, window, size):
                    yield start + text, at - base, suffix


def _schema(id_type: DataType | None, fields: str) -> StructType:
    """Fields as text; those of type ``ID`` get the type of the ids."""
    return StructType.fromDDL(fields.replace(" ID", f" {id_type.simpleString()}") if id_type else fields)


def _batch(schema: StructType, *columns) -> pa.RecordBatch:
    kinds = [to_arrow_type(f.dataType) for f in schema]
    arrays = [c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def _document_anchors(rows: DataFrame, key: str, window: int, size: int) -> DataFrame:
    """``h, <key>``: hashes of the anchors of each document, once each."""
    schema = _schema(rows.schema[key].dataType, f"h bigint, {key} ID")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, some in _steps(texts_of(b.column(1))):
                found = anchors_of(some, window, size)
                order = np.lexsort((found.hash, found.text))
                text, h = found.text[order], found.hash[order]
                once = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])))) if len(h) else order
                yield _batch(schema, h[once], b.column(0).take(pa.array(start + text[once], pa.int64())))

    return map_arrow(rows.select(key, "text"), run, schema)


def _smaller(low: str, own: str):
    """Whether a document ``low`` is smaller than ``own``; a null id is larger than all others."""
    return F.col(low).isNotNull() & (F.col(own).isNull() | (F.col(low) < F.col(own)))


def _copies(rows: DataFrame, window: int) -> DataFrame:
    """``j, copied``: documents with a smaller exact copy, and the MD5 of their text. Texts too short to
    hold a window are left out."""
    texts = rows.filter(F.octet_length("text") >= 2 * window - 1).select("j", "id", F.md5(F.col("text").cast("binary")).alias("m"))
    several = texts.groupBy("m").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = several.select(F.col("m").alias("its_m"), "least")
    found = texts.join(several, F.col("m") == F.col("its_m")).filter(_smaller("least", "id"))
    return found.groupBy("j").agg(F.min("m").alias("copied"))


def _without(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    kept, at = [], 0
    for first, end in spans:
        kept += words[at:first]
        at = end
    return kept + words[at:]


def _ending(words: list[bytes], digest: bool) -> str:
    text = b" ".join(words)
    return hashlib.sha256(text).hexdigest() if digest else text.decode()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    done: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if done and done[-1][1] >= first:
            done[-1] = done[-1][0], max(end, done[-1][1])
        else:
            done.append((first, end))
    return done


_JUDGED = "id ID, n_words bigint, n_removed bigint, spans array<struct<first:bigint,end:bigint>>, kept string"


def _settle(schema: StructType, window: int, digest: bool):
    """Documents without a wanted anchor and exact copies are done; the others keep text and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, spans, kept, left = [], [], [], [], []
            for text, copied, hashes in zip(texts_of(b.column(2)), b.column(3).to_pylist(), b.column(4).is_valid().to_pylist()):
                words = text.split()
                gone = len(words) if copied and len(words) >= window else 0
                open_ = hashes and not copied
                sizes.append(len(words))
                removed.append(None if open_ else gone)
                spans.append(None if open_ else [{"first": 0, "end": gone}] if gone else [])
                kept.append(None if open_ else _ending([] if gone else words, digest))
                left.append(text if open_ else None)
            open_rows = pa.array([x is not None for x in left])
            hashes = pc.if_else(open_rows, b.column(4), pa.scalar(None, b.column(4).type))
            texts = pa.array(left, pa.binary()).cast(pa.string())
            yield _batch(schema, b.column(0), sizes, removed, spans, kept, b.column(1), texts, hashes)

    return run


def _gathered(batches: Iterator[pa.RecordBatch], crowded, window: int, size: int, only=None) -> Iterator[dict[Suffix, list]]:
    """Distinct suffixes of a task's documents, with smallest and largest id, and whether one is null."""
    found: dict[Suffix, list] = {}
    for b in batches:
        ids = b.column(0).to_pylist()
        wanted = b.column(2).to_pylist()
        if only is not None:
            wanted = [[h for h in x if (size, h) in only] for x in wanted]
        for text, _, suffix in _suffixes(texts_of(b.column(1)), wanted, crowded, window, size):
            i = ids[text]
            seen = found.get(suffix)
            if seen is None:
                found[suffix] = [i, i, i is None]
            elif i is None:
                seen[2] = True
            elif seen[0] is None:
                seen[:2] = i, i
            elif i < seen[0]:
                seen[0] = i
            elif i > seen[1]:
                seen[1] = i
        if len(found) >= FLUSH_ROWS:
            yield found
            found = {}
    if found:
        yield found


def _crowded(candidates: DataFrame, repeated: DataFrame, group_rows: int, window: int, size: int) -> frozenset:
    """Pairs of length and hash of the prefixes that more suffixes share than a group may hold:
    ``MAX_CROWDED`` for each length at most."""
    total = repeated.agg(F.sum("docs")).first()[0] or 0
    limit = max(group_rows, total // MAX_CROWDED)
    crowded = {(size, r.h) for r in repeated.filter(F.col("docs") > limit).collect()}
    if not crowded:
        return frozenset()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _gathered(batches, frozenset(), window, size, crowded):
            depths, hashes = [], []
            for suffix in found:
                words = suffix.words.split()[suffix.left :]
                depths += range(size + 1, len(words) + 1)
                hashes += [_hash(words[:d]) for d in range(size + 1, len(words) + 1)]
            yield _batch(schema, depths, hashes)

    schema = _schema(None, "depth int, h bigint")
    counts = map_arrow(candidates.select("id", "text", "hashes"), run, schema).groupBy("depth", "h").count()
    return frozenset(crowded | {(r.depth, r.h) for r in counts.filter(F.col("count") > limit).collect()})


def _classes(rows: np.ndarray, route: np.ndarray | None) -> np.ndarray:
    """The tree of the sequences in ``rows``: for each depth from 0 on and each row, the number of the
    node of that depth that it lies below. Rows are put in order, and the lengths of the prefixes that
    neighbours share tell where one node ends and the next begins."""
    keys = [*rows.T[::-1]] + ([] if route is None else [route])
    order = np.lexsort(keys) if keys else np.arange(len(rows))
    differs = np.ones((len(rows), rows.shape[1] + 1), dtype=bool)
    differs[1:, :-1] = rows[order][1:] != rows[order][:-1]
    shared = differs.argmax(axis=1)
    shared[0] = -1
    if route is not None:
        shared[1:][route[order][1:] != route[order][:-1]] = -1
    found = np.empty((rows.shape[1] + 1, len(rows)), dtype=np.int64)
    for depth in range(rows.shape[1] + 1):
        found[depth, order] = np.cumsum(shared < depth)
    return found


def repeats_in(suffixes: list[Suffix], low: np.ndarray, high: np.ndarray, window: int, size: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that a smaller document than some holder of the suffix has: number of the suffix,
    first and last window of the run (words before the anchor), and the smallest document. ``low`` and
    ``high`` are the smallest and largest document of each suffix."""
    codes: dict[bytes, int] = {}
    flat = np.array([codes.setdefault(w, len(codes)) for s in suffixes for w in s.words.split(b" ")], dtype=np.int64)
    left = np.array([s.left for s in suffixes])
    least = np.array([s.least for s in suffixes])
    route = np.array([s.route for s in suffixes])
    lengths = left + window - least
    anchor = np.cumsum(lengths) - lengths + left
    step = np.arange(window)
    right = np.where(step < (window - least)[:, None], flat[np.minimum(anchor[:, None] + step, len(flat) - 1)], -1)
    back = np.arange(window - size)
    before = np.where(back < left[:, None], flat[np.maximum(anchor[:, None] - 1 - back, 0)], -1)
    on, behind = _classes(right, route), _classes(before, None)
    rows, windows, smallest = [], [], []
    for e in range(window - size + 1):
        here = np.flatnonzero((least <= e) & (e <= left))
        both = on[window - e, here] * (len(suffixes) + 1) + behind[e, here]
        _, node = np.unique(both, return_inverse=True)
        least_doc = np.full(len(here), np.iinfo(np.int64).max)
        np.minimum.at(least_doc, node, low[here])
        hit = least_doc[node] < high[here]
        rows.append(here[hit])
        windows.append(np.full(int(hit.sum()), e))
        smallest.append(least_doc[node][hit])
    row, at, doc = np.concatenate(rows), np.concatenate(windows), np.concatenate(smallest)
    order = np.lexsort((at, row))
    row, at, doc = row[order], at[order], doc[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(row)) - 1 if len(row) else starts
    return row[starts], at[starts], at[ends], doc[starts]


def _groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Whole groups, gathered to about ``rows`` suffixes; the batches come in the order of routes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held)
            route = table.column(0).to_numpy()
            cut = int(np.searchsorted(route, route[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
                size -= cut
    if held:
        yield pa.Table.from_batches(held)


def _trees(schema: StructType, window: int, size: int, tree_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, tree_rows):
            columns = [table.column(i).to_pylist() for i in range(7)]
            docs = sorted({x for c in columns[4:6] for x in c if x is not None})
            rank = {x: i for i, x in enumerate(docs)}
            place: dict[Suffix, int] = {}
            low, high = [], []
            for route, left, least, words, lo, hi, none in zip(*columns):
                a, b = rank.get(lo, len(docs)), len(docs) if none else rank[hi]
                at = place.setdefault(Suffix(route, left, least, words), len(place))
                if at == len(low):
                    low.append(a)
                    high.append(b)
                else:
                    low[at], high[at] = min(low[at], a), max(high[at], b)
            suffixes = list(place)
            row, first, last, doc = repeats_in(suffixes, np.array(low), np.array(high), window, size)
            marks = [suffixes[r].mark() for r in row.tolist()]
            yield _batch(schema, marks, first, last, [docs[d] for d in doc.tolist()])

    return run


def _occurrences(schema: StructType, crowded, window: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, places, marks = [], [], []
            for text, at, suffix in _suffixes(texts_of(b.column(1)), b.column(2).to_pylist(), crowded.value, window, size):
                rows.append(text)
                places.append(at)
                marks.append(suffix.mark())
            take = pa.array(rows, pa.int64())
            yield _batch(schema, marks, b.column(0).take(take), b.column(3).take(take), places)

    return run


def _finish(schema: StructType, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, spans, kept = [], [], []
            for text, found in zip(texts_of(b.column(2)), b.column(3).to_pylist()):
                gone = merged([(x["first"], x["end"]) for x in found or ()])
                removed.append(sum(end - first for first, end in gone))
                spans.append([{"first": first, "end": end} for first, end in gone])
                kept.append(_ending(_without(text.split(), gone), digest))
            yield _batch(schema, b.column(0), b.column(1), removed, spans, kept)

    return run


def judge_repeats(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    digest: bool = False,
    group_rows: int = GROUP_ROWS,
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """``id, n_words, n_removed, spans, kept`` of every document row: words, removed words, the ranges of
    these (by word, end not included, apart and in order) and what is left, its words joined by one blank;
    with ``digest`` the SHA-256 of that in place of the text.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A word goes if a ``window`` of consecutive
    words that covers it also starts in a document with a smaller id; all windows are judged on the input.
    A null text is empty, and a text of fewer words than a window loses nothing. Ids may be of any type with
    an order; a null id is larger than all others. Rows with one id are one document, whatever their texts:
    they take nothing from each other, and identical rows lose the same. An empty table gives no rows.
    Other columns are not looked at. A text of any length is one row of one task, which holds its words.
    ``group_rows`` and ``tree_rows`` bound what a task holds, not what is found.
    """
    if window <= PREFIX:
        raise ValueError(f"window must be more than {PREFIX}")
    spark, size = docs.sparkSession, PREFIX
    text = F.coalesce(col(text_column).cast("string"), F.lit(""))
    rows = docs.select(col(id_column).alias("id"), text.alias("text"))
    # Tells documents apart by id and text; a chance meeting only asks for more anchors than needed.
    rows = rows.withColumn("j", F.xxhash64("id", "text"))
    id_type = rows.schema["id"].dataType

    counted = _document_anchors(rows, "id", window, size).groupBy("h").agg(
        F.min("id").alias("lo"), F.max("id").alias("hi"), F.bool_or(F.col("id").isNull()).alias("none"), F.count(F.lit(1)).alias("docs")
    )
    shared = F.col("lo").isNotNull() & ((F.col("lo") < F.col("hi")) | F.col("none"))
    repeated = saved(counted.filter(shared).select("h", "docs"), "repeats-anchors")
    wanted = repeated.select(F.col("h").alias("its_h"))
    lists = _document_anchors(rows, "j", window, size).join(wanted, F.col("h") == F.col("its_h"), "left_semi")
    lists = lists.groupBy("j").agg(F.collect_set("h").alias("hashes"))
    marks = saved(lists.join(_copies(rows, window), "j", "full"), "repeats-documents")
    released(spark)

    its = marks.select(F.col("j").alias("its_j"), "hashes", "copied")
    copied = F.coalesce(F.md5(F.col("text").cast("binary")) == F.col("copied"), F.lit(False))
    marked = rows.join(its, F.col("j") == F.col("its_j"), "left").select("id", "j", "text", copied.alias("copied"), "hashes")
    judged = _schema(id_type, _JUDGED)
    settled_schema = _schema(id_type, _JUDGED + ", j bigint, text string, hashes array<bigint>")
    settled = saved(map_arrow(marked, _settle(settled_schema, window, digest), settled_schema), "repeats-settled")
    released(spark)
    candidates = settled.filter(F.col("text").isNotNull())

    crowded = spark.sparkContext.broadcast(_crowded(candidates, repeated, group_rows, window, size))
    suffix_schema = _schema(id_type, "route bigint, left int, least int, words binary, lo ID, hi ID, none boolean")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _gathered(batches, crowded.value, window, size):
            yield _batch(suffix_schema, *zip(*((*s, *v) for s, v in found.items())))

    suffixes = map_arrow(candidates.select("id", "text", "hashes"), gather, suffix_schema)
    grouped = suffixes.repartition("route").sortWithinPartitions("route")
    found_schema = _schema(id_type, "its_mark binary, first int, last int, least_id ID")
    found = saved(grouped.mapInArrow(_trees(found_schema, window, size, tree_rows), found_schema), "repeats-found")
    released(spark)

    place_schema = _schema(id_type, "mark binary, id ID, j bigint, at bigint")
    places = map_arrow(candidates.select("id", "text", "hashes", "j"), _occurrences(place_schema, crowded, window, size), place_schema)
    hits = places.join(found, F.col("mark") == F.col("its_mark")).filter(_smaller("least_id", "id"))
    span = F.struct((F.col("at") - F.col("last")).alias("first"), (F.col("at") - F.col("first") + window).alias("end"))
    spans = hits.groupBy(F.col("j").alias("its_j")).agg(F.collect_set(span).alias("found"))
    last = candidates.join(spans, F.col("j") == F.col("its_j"), "left").select("id", "n_words", "text", "found")
    done = settled.filter(F.col("text").isNull()).select(*judged.names)
    return done.unionAll(map_arrow(last, _finish(judged, digest), judged))


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, text, spans, n_words, n_removed``: every document without the passages that a document
    with a smaller id has, its remaining words joined by one blank. Rules and odd cases as in
    ``judge_repeats``; a null text comes back empty."""
    found = judge_repeats(docs, **options)
    return found.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), "spans", "n_words", "n_removed")


def repeat_report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``: SHA-256 of what ``remove_repeats`` leaves."""
    found = judge_repeats(docs, digest=True, **options)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
