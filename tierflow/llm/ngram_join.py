"""Operator 2: n-gram Jaccard join by MinHash banding, with full verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.functions.naming import free_name
from tierflow.llm.common import FOLD, batch, col, map_arrow, saved, texts_of
from tierflow.llm.components import connected_components

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
STEP_BYTES = 500_000
# A bucket is cut into blocks of about this many texts or n-grams; pairs of blocks are dealt out.
BLOCK_TEXTS = 256
BLOCK_NGRAMS = 4_000_000
# Blocks of groups are smaller: texts known to be connected do not meet again.
GROUP_NGRAMS = 1_000_000
# How often the texts of a large bucket are compared with one of them, and how many of them a task takes.
STAR_TURNS = 3
STAR_TEXTS = 5_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: most rows (fewest chance meetings) for which a pair at the threshold meets in
    some band with probability ``recall``, within ``max_hashes`` hash functions."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= max_hashes or rows == 1:
            return bands, rows
    raise AssertionError


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_ODD, _ODD_INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def ngram_sets(texts: list[bytes], size: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct n-grams of each text as 64-bit hashes; words are ``fold_words``. A text of fewer
    words than ``size`` has one n-gram of all of them, a text without words has none.

    A word's hash is a polynomial of its bytes, taken from running sums over all texts together. Two
    n-grams share a hash with probability 2**-64.
    """
    joined = np.frombuffer(b"\n".join(texts).translate(FOLD) + b" ", dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.cumsum(lengths + 1) - lengths - 1
    edges = np.flatnonzero(np.diff(np.concatenate(([False], joined != 32)).astype(np.int8))).reshape(-1, 2)
    up, down = _power_tables(len(joined) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(joined.astype(np.uint64) * up[: len(joined)], dtype=np.uint64)))
    words = (sums[edges[:, 1]] - sums[edges[:, 0]]) * down[edges[:, 0]]
    words = _mixed(words + (edges[:, 1] - edges[:, 0]).astype(np.uint64))
    first = np.searchsorted(edges[:, 0], offsets).tolist() + [len(words)]
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    found = []
    for low, high in zip(first, first[1:]):
        n = high - low
        total = np.zeros(max(n - size + 1, min(n, 1)), dtype=np.uint64)
        for j in range(min(size, n)):
            total = _mixed(total + padded[low + j : low + j + len(total)] * np.uint64(2 * j + 1))
        found.append(np.unique(total))
    return found


def _hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, n + 1, dtype=np.uint64)
    return _mixed(at * _ODD), _mixed(at * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> list[list[int] | None]:
    """One signed 64-bit hash per band, which differs between bands; None for an empty set."""
    full = [s for s in sets if len(s)]
    if not full:
        return [None] * len(sets)
    grams = np.concatenate(full)
    starts = np.cumsum([0, *[len(s) for s in full[:-1]]])
    flips, factors = _hash_functions(bands * rows)
    work = np.empty_like(grams)
    out = np.zeros((len(full), bands), dtype=np.uint64)
    for band in range(bands):
        state = np.full(len(full), band + 1, dtype=np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            np.bitwise_xor(grams, flips[k], out=work)
            np.multiply(work, factors[k], out=work)
            state = _mixed(state * _ODD + np.minimum.reduceat(work, starts))
        out[:, band] = state
    values = iter(out.view(np.int64).tolist())
    return [next(values) if len(s) else None for s in sets]


def _steps(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    low, size = 0, 0
    for i, text in enumerate(texts):
        if i > low and size + len(text) > STEP_BYTES:
            yield low, texts[low:i]
            low, size = i, 0
        size += len(text)
    if low < len(texts):
        yield low, texts[low:]


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, text_key, text``; the key tells rows with the same id and different texts apart."""
    text = F.coalesce(col(text_column), F.lit(""))
    return docs.select(col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _signatures(rows: DataFrame, size: int, bands: int, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks, hashes = [], []
            for _, part in _steps(texts_of(b.column(2))):
                sets = ngram_sets(part, size)
                marks += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                hashes += band_hashes(sets, bands, n)
            yield batch(
                {
                    "doc_id": (b.column(0), pa.int64()),
                    "text_key": (b.column(1), pa.int64()),
                    "mark": (marks, pa.binary()),
                    "bands": (hashes, pa.list_(pa.int64())),
                }
            )

    return saved(map_arrow(rows, run, "doc_id bigint, text_key bigint, mark binary, bands array<bigint>"), "signatures")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """``mark, buckets, text`` to ``mark, buckets, grams, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(2))
            for low, part in _steps(texts):
                sets = ngram_sets(part, size)
                yield batch(
                    {
                        "mark": (b.column(0).slice(low, len(part)), pa.binary()),
                        "buckets": (b.column(1).slice(low, len(part)), pa.list_(pa.int64())),
                        "grams": ([s.tobytes() for s in sets], pa.binary()),
                        "n": ([len(s) for s in sets], pa.int64()),
                    }
                )

    return saved(map_arrow(rows, run, "mark binary, buckets array<bigint>, grams binary, n bigint"), "ngram-sets")


@dataclass
class _Block:
    """Texts of one bucket that are compared with each other, or two blocks with one another."""

    marks: list[bytes]
    sides: list[int]
    earlier: list[np.ndarray]
    grams: list[np.ndarray]
    groups: list[bytes]

    def links(self, threshold: float, crossed: bool) -> Iterator[tuple[int, int, float]]:
        """Pairs at the threshold, each once: between sides if ``crossed``, else among all. A pair that
        also meets in an earlier bucket is left to that one. With ``groups``, only pairs that join two
        groups: a pair whose texts are known to be connected is not looked at."""
        labels = np.unique(np.array(self.groups, dtype=object), return_inverse=True)[1] if self.groups else None
        sizes = np.array([len(g) for g in self.grams])
        _, ids = np.unique(np.concatenate(self.grams), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        # A value of its own keeps each text's list of buckets from being empty.
        before = [np.append(e, -1 - i) for i, e in enumerate(self.earlier)]
        met_sizes = np.array([len(e) for e in before])
        _, met_ids = np.unique(np.concatenate(before), return_inverse=True)
        met_starts = np.cumsum(met_sizes) - met_sizes
        present = np.zeros(ids.max() + 1, dtype=np.int32)
        met = np.zeros(met_ids.max() + 1, dtype=np.int32)
        sides = np.array(self.sides)
        for i in range(len(self.marks)):
            if crossed and sides[i] != sides.min():
                continue
            j = np.flatnonzero(sides != sides[i]) if crossed else np.arange(i + 1, len(self.marks))
            if labels is not None:
                j = j[labels[j] != labels[i]]
            j = j[np.minimum(sizes[j], sizes[i]) >= threshold * np.maximum(sizes[j], sizes[i])]
            if not len(j):
                continue
            own, own_met = ids[starts[i] : starts[i] + sizes[i]], met_ids[met_starts[i] : met_starts[i] + met_sizes[i]]
            present[own], met[own_met] = 1, 1
            common = np.add.reduceat(present[ids], starts)[j]
            again = np.add.reduceat(met[met_ids], met_starts)[j]
            present[own], met[own_met] = 0, 0
            share = common / (sizes[j] + sizes[i] - common)
            for k in np.flatnonzero((share >= threshold) & (again == 0)).tolist():
                at = int(j[k])
                if labels is not None:
                    if labels[at] == labels[i]:
                        continue
                    labels[labels == labels[at]] = labels[i]
                yield i, at, float(share[k])


LINKS = "mark binary, root binary, n_links bigint, partners array<binary>, similarities array<double>"


def _block_links(block: _Block, threshold: float, crossed: bool) -> pa.RecordBatch | None:
    n = len(block.marks)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    degree, partners, shares = [0] * n, [[] for _ in range(n)], [[] for _ in range(n)]
    for i, j, share in block.links(threshold, crossed):
        degree[i] += 1
        degree[j] += 1
        partners[i].append(block.marks[j])
        shares[i].append(share)
        a, b = find(i), find(j)
        if block.marks[a] > block.marks[b]:
            a, b = b, a
        root[b] = a
    linked = [i for i in range(n) if degree[i]]
    if not linked:
        return None
    return batch(
        {
            "mark": ([block.marks[i] for i in linked], pa.binary()),
            "root": ([block.marks[find(i)] for i in linked], pa.binary()),
            "n_links": ([degree[i] for i in linked], pa.int64()),
            "partners": ([partners[i] for i in linked], pa.list_(pa.binary())),
            "similarities": ([shares[i] for i in linked], pa.list_(pa.float64())),
        }
    )


def _verify(dealt: DataFrame, threshold: float) -> DataFrame:
    """Rows ``bucket, i, j, side, mark, buckets, grams`` and perhaps ``group``, neighbours by bucket and
    block pair, to links. A task holds one block pair at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, _Block([], [], [], [], [])
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in range(3))))
            rest = [b.column(c).to_pylist() for c in range(3, 7)]
            groups = b.column(7).to_pylist() if b.num_columns > 7 else None
            for row, (at, side, mark, buckets, grams) in enumerate(zip(keys, *rest)):
                if at != key:
                    if key and (found := _block_links(block, threshold, key[1] != key[2])):
                        yield found
                    key, block = at, _Block([], [], [], [], [])
                own = np.array(buckets, dtype=np.int64)
                block.marks.append(mark)
                block.sides.append(side)
                block.earlier.append(own[own < at[0]])
                block.grams.append(np.frombuffer(grams, dtype=np.uint64))
                if groups:
                    block.groups.append(groups[row])
        if key and (found := _block_links(block, threshold, key[1] != key[2])):
            yield found

    return map_arrow(dealt, run, LINKS)


def _buckets(texts: DataFrame) -> DataFrame:
    """``mark, bucket``: the buckets with two texts or more that each text is in. Of buckets with the
    same members one is kept, for it brings together the same pairs."""
    members = texts.select("mark", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("mark")).alias("x"), F.bit_xor(F.xxhash64(F.lit("b"), "mark")).alias("y")
    )
    several = saved(
        sizes.filter("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("kept")).select("kept"), "buckets"
    )
    return members.join(several, F.col("bucket") == F.col("kept")).select("mark", "bucket")


@dataclass(frozen=True)
class NgramJoin:
    """``rows``: ``doc_id, text_key, mark`` of every document row, the mark (of its n-gram set) null
    without words. ``links``: what ``LINKS`` says, per text and block. ``groups``: ``node, component``
    of texts whose group has a smaller mark."""

    rows: DataFrame
    links: DataFrame
    groups: DataFrame


def ngram_join(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = NGRAM,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    block_texts: int = BLOCK_TEXTS,
    block_ngrams: int = BLOCK_NGRAMS,
) -> NgramJoin:
    """All pairs of different texts whose n-gram sets have a Jaccard similarity of ``threshold``.

    Texts with the same n-gram set are one text from here on, so copies multiply nothing. Texts meet
    in a bucket when all hashes of a band agree; bands and rows follow from ``recall``, the probability
    that a pair right at the threshold meets. Every pair of a bucket is checked on its full sets, by
    the first bucket it meets in. A large bucket is cut into blocks, and pairs of blocks are dealt out
    over tasks; a task emits a row per text with its links, not a row per pair. The texts themselves
    are read twice; only those in a bucket reach the second shuffle's other side.
    """
    rows, sets, _ = _prepared(docs, id_column, text_column, size, threshold, recall)
    return NgramJoin(rows, *_linked(sets, threshold, block_texts, block_ngrams))


def _prepared(
    docs: DataFrame, id_column: str, text_column: str, size: int, threshold: float, recall: float
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``doc_id, text_key, mark`` of all rows; n-gram sets of the texts that share a bucket; ``mark, bucket``."""
    bands, rows_per_band = choose_bands(threshold, recall)
    keyed = _keyed(docs, id_column, text_column)
    rows = _signatures(keyed, size, bands, rows_per_band)
    texts = rows.filter("mark IS NOT NULL").dropDuplicates(["mark"])
    texts = saved(texts, "texts")
    found = saved(_buckets(texts), "bucket-members")
    wanted = found.groupBy("mark").agg(F.array_sort(F.collect_list("bucket")).alias("buckets"))
    chosen = wanted.join(texts.select(F.col("mark").alias("m"), "doc_id", "text_key"), F.col("mark") == F.col("m"))
    chosen = saved(
        chosen.select("mark", "buckets", F.col("doc_id").alias("d"), F.col("text_key").alias("k")), "candidates"
    )
    same = F.col("text_key").eqNullSafe(F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))
    # Repeated rows of one document would join twice.
    sets = _sets(keyed.join(chosen, same).select("mark", "buckets", "text"), size)
    sets = sets.dropDuplicates(["mark"]) if _has_repeats(rows) else sets
    return rows.drop("bands"), sets, found


def _has_repeats(rows: DataFrame) -> bool:
    return not rows.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty()


def _linked(sets: DataFrame, threshold: float, block_texts: int, block_ngrams: int) -> tuple[DataFrame, DataFrame]:
    members = sets.select(F.explode("buckets").alias("bucket"), "mark", "buckets", "grams", "n")
    blocks = F.greatest(F.ceil(F.col("texts") / block_texts), F.ceil(F.col("size") / block_ngrams)).cast("int")
    large = (
        sets.select(F.explode("buckets").alias("large"), "n")
        .groupBy("large")
        .agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("size"))
        .select("large", F.least(blocks, F.col("texts").cast("int")).alias("blocks"))
        .filter("blocks > 1")
    )
    large = saved(large, "large-buckets")
    cut = members.join(large, F.col("bucket") == F.col("large"), "left")
    cut = cut.withColumn("side", F.pmod(F.xxhash64("mark"), F.coalesce("blocks", F.lit(1))).cast("int"))
    others = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    pairs = cut.select("bucket", "side", "mark", "buckets", "grams", F.explode(others).alias("other"))
    dealt = pairs.select(
        "bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "mark", "buckets", "grams"
    )
    near = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "mark")
    links = saved(_verify(near, threshold), "links")
    return links, connected_components(links.filter("root <> mark").select("mark", "root"))


def _grouped(texts: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``texts`` (a row per ``mark``) with ``group``: the smallest text known to be connected, or the text itself."""
    if groups is None:
        return texts.withColumn("group", F.col("mark"))
    known = texts.join(groups, F.col("mark") == F.col("node"), "left")
    return known.withColumn("group", F.coalesce("component", "mark")).drop("node", "component")


def _members(sets: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``bucket, mark, group, n``. Groups are looked up once for each text, not for each of its buckets and each
    use, so what they give is written."""
    known = _grouped(sets.select("mark", "buckets", "n"), groups)
    members = known.select(F.explode("buckets").alias("bucket"), "mark", "group", "n")
    return members if groups is None else saved(members, "group-members")


def _open_buckets(members: DataFrame, least: int = 1) -> DataFrame:
    """Buckets of more than ``least`` texts in two groups or more, from ``bucket, mark, group, n``:
    ``open, main`` (the group with most texts) and texts and n-grams in all and in the main group."""
    groups = members.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("size"))
    buckets = groups.groupBy(F.col("bucket").alias("open")).agg(
        F.max(F.struct("texts", "group", "size")).alias("m"),
        F.sum("texts").alias("texts"),
        F.sum("size").alias("size"),
        F.count(F.lit(1)).alias("groups"),
    )
    buckets = buckets.filter((F.col("groups") > 1) & (F.col("texts") > least))
    return saved(
        buckets.select(
            "open", F.col("m.group").alias("main"), "texts", "size", F.col("m.texts").alias("main_texts"), F.col("m.size").alias("main_size")
        ),
        "open-buckets",
    )


def _star_links(members: DataFrame, sets: DataFrame, buckets: DataFrame, threshold: float, turn: int) -> DataFrame:
    """``mark, root``: links of the texts of each bucket with one text of it, chosen by a hash outside the
    main group. The work grows with the number of texts; a text that very many are compared with goes to
    several tasks."""
    inside = members.join(buckets.select("open", "main"), F.col("bucket") == F.col("open")).drop("open")
    order = F.xxhash64(F.lit(turn), "mark")
    leaders = inside.filter("group <> main").groupBy(F.col("bucket").alias("led")).agg(
        F.min(F.struct(order.alias("o"), "mark", "group")).alias("x")
    )
    leaders = saved(leaders.select("led", F.col("x.mark").alias("leader"), F.col("x.group").alias("its_group")), "leaders")
    pairs = inside.join(leaders, F.col("bucket") == F.col("led")).filter("group <> its_group")
    pairs = saved(pairs.select("leader", "mark").distinct(), "star-pairs")
    pieces = F.ceil(F.count(F.lit(1)) / STAR_TEXTS).cast("int")
    sizes = saved(pairs.groupBy(F.col("leader").alias("whose")).agg(pieces.alias("pieces")), "star-pieces")
    grams = sets.select(F.col("mark").alias("m"), "grams")
    piece = F.pmod(F.xxhash64("mark"), F.col("pieces")).cast("int").alias("piece")
    dealt = pairs.join(sizes, F.col("leader") == F.col("whose")).select("leader", piece, "mark")
    followers = dealt.join(grams, F.col("mark") == F.col("m")).select("leader", "piece", F.lit(True).alias("follows"), "mark", "grams")
    heads = sizes.join(grams, F.col("whose") == F.col("m")).select(
        F.col("whose").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
        F.lit(False).alias("follows"), F.col("m").alias("mark"), "grams",
    )
    near = followers.unionAll(heads).repartition("leader", "piece").sortWithinPartitions("leader", "piece", "follows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, dtype=np.uint64)
        for b in batches:
            found = []
            leaders, follows, marks, grams = (b.column(i).to_pylist() for i in (0, 2, 3, 4))
            for leader, follows_it, mark, blob in zip(leaders, follows, marks, grams):
                its = np.frombuffer(blob, dtype=np.uint64)
                if not follows_it:
                    own = its
                elif min(len(own), len(its)) >= threshold * max(len(own), len(its)):
                    at = np.minimum(np.searchsorted(own, its), len(own) - 1)
                    common = int((own[at] == its).sum())
                    if common / (len(its) + len(own) - common) >= threshold:
                        found.append((mark, leader))
            yield batch({"mark": ([m for m, _ in found], pa.binary()), "root": ([r for _, r in found], pa.binary())})

    return saved(map_arrow(near, run, "mark binary, root binary"), "star-links")


def _remaining_links(
    sets: DataFrame, members: DataFrame, groups: DataFrame | None, threshold: float, block_texts: int, block_ngrams: int
) -> DataFrame:
    """``mark, root``: links between groups. The main group of a large bucket is not compared with itself, so
    its texts are sent only to blocks of the others."""
    buckets = _open_buckets(members)
    cut = lambda texts, size: F.least(F.greatest(F.ceil(texts / block_texts), F.ceil(size / block_ngrams)), texts).cast("int")
    main = cut(F.col("main_texts"), F.col("main_size"))
    rest = cut(F.col("texts") - F.col("main_texts"), F.col("size") - F.col("main_size"))
    one = cut(F.col("texts"), F.col("size")) == 1
    buckets = saved(
        buckets.select("open", "main", F.when(one, 0).otherwise(main).alias("front"), F.when(one, 1).otherwise(rest).alias("back")),
        "open-blocks",
    )
    placed = _grouped(sets, groups).select(F.explode("buckets").alias("bucket"), "mark", "buckets", "grams", "group")
    placed = placed.join(buckets, F.col("bucket") == F.col("open"))
    in_main = (F.col("group") == F.col("main")) & (F.col("front") > 0)
    side = F.when(in_main, F.pmod(F.xxhash64("mark"), F.col("front"))).otherwise(F.col("front") + F.pmod(F.xxhash64("mark"), F.col("back")))
    others = F.sequence(F.when(in_main, F.col("front")).otherwise(0), F.col("front") + F.col("back") - 1)
    placed = placed.select("bucket", side.cast("int").alias("side"), "mark", "buckets", "grams", "group", F.explode(others).alias("other"))
    dealt = placed.select(
        "bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "mark", "buckets", "grams", "group"
    )
    near = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "mark")
    return saved(_verify(near, threshold).filter("root <> mark").select("mark", "root"), "links")


def ngram_groups(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = NGRAM,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    block_texts: int = BLOCK_TEXTS,
    block_ngrams: int = GROUP_NGRAMS,
) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``groups`` of ``ngram_join`` without its links: the same groups with less work.

    The texts of each bucket of more than ``block_texts`` are first compared with one text of it, up to
    ``STAR_TURNS`` times with another one. Texts connected by then are in one group and not compared with
    each other; all other pairs of a bucket are, so no connection is lost. Copies of one text with small
    changes cost in proportion to their number. Texts that share a bucket and lie in different groups still
    meet pair by pair.
    """
    rows, sets, members = _prepared(docs, id_column, text_column, size, threshold, recall)
    groups, edges = None, None
    members = members.select("bucket", "mark", F.col("mark").alias("group"), F.lit(1).alias("n"))
    for turn in range(STAR_TURNS):
        buckets = _open_buckets(members, block_texts)
        if buckets.isEmpty():
            break
        found = _star_links(members, sets, buckets, threshold, turn)
        edges = found if edges is None else edges.unionAll(found)
        groups = connected_components(edges)
        members = _members(sets, groups)
    members = _members(sets, None) if groups is None else members
    found = _remaining_links(sets, members, groups, threshold, block_texts, block_ngrams)
    return rows, connected_components(found if edges is None else edges.unionAll(found))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per document row ``doc_id, class_id, n_links``.

    A class is a group of documents connected by links; ``class_id`` is its smallest id. ``n_links``
    is the number of different texts whose n-gram sets are similar to the threshold; texts with the
    same set count as one and are in one class without a link. Null and empty texts and texts without
    words are not compared: each is its own class. Null ids are left out of the minimum; repeated rows
    give a row each and share a class; other columns are not looked at. An empty table gives no rows.
    """
    joined = ngram_join(docs, **options)
    rows = joined.rows
    degree = joined.links.groupBy(F.col("mark").alias("linked")).agg(F.sum("n_links").alias("n_links"))
    texts = rows.filter("mark IS NOT NULL").groupBy("mark").agg(F.min("doc_id").alias("least"))
    grouped = texts.join(joined.groups, F.col("mark") == F.col("node"), "left").select(
        "mark", "least", F.coalesce("component", "mark").alias("group")
    )
    grouped = saved(grouped.join(degree, F.col("mark") == F.col("linked"), "left").drop("linked"), "groups")
    ids = saved(
        grouped.groupBy(F.col("group").alias("g")).agg(F.min("least").alias("class_id")), "group-ids"
    )
    labels = saved(
        grouped.join(ids, F.col("group") == F.col("g")).select(
            F.col("mark").alias("m"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")
        ),
        "labels",
    )
    # The labels are a written table, so a mark that very many copies share can be split.
    with_words = rows.filter("mark IS NOT NULL").join(labels, F.col("mark") == F.col("m"))
    without = rows.filter("mark IS NULL").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")
    )
    return with_words.select("doc_id", "class_id", "n_links").unionAll(without)


def keep_one_of_each(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id (then text hash); columns
    as they were. Documents without words (null and empty texts too) all stay. Of identical rows one stays.
    Rows with a null id count as larger than any other. An empty table gives no rows."""
    every, groups = ngram_groups(docs, id_column=id_column, text_column=text_column, **options)
    rows = every.filter("mark IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    texts = rows.groupBy("mark").agg(first.alias("first"))
    grouped = texts.join(groups, F.col("mark") == F.col("node"), "left")
    kept = grouped.groupBy(F.coalesce("component", "mark").alias("g")).agg(F.min("first").alias("first"))
    its_doc, its_key = free_name(docs, "its_doc"), free_name(docs, "its_key")
    kept = saved(kept.select(F.col("first.doc_id").alias(its_doc), F.col("first.text_key").alias(its_key)), "kept")
    without = every.filter("mark IS NULL").select(F.col("doc_id").alias(its_doc), F.col("text_key").alias(its_key))
    stays = kept.unionAll(without.distinct())
    key = F.xxhash64(F.coalesce(col(text_column), F.lit("")))
    same = (key == F.col(its_key)) & col(id_column).cast("bigint").eqNullSafe(F.col(its_doc))
    left = docs.join(stays, same, "left_semi")
    if not _has_repeats(rows):
        return left
    repeated = rows.groupBy("doc_id", "text_key").count().filter("count > 1")
    repeated = saved(repeated.select(F.col("doc_id").alias(its_doc), F.col("text_key").alias(its_key)), "repeated")
    once = left.join(repeated, same, "left_semi").dropDuplicates([id_column, text_column])
    return left.join(repeated, same, "left_anti").unionByName(once)
