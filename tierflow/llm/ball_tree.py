"""Operator 12: ranked lexical search, exact, with ball trees over sparse document vectors.

A document's vector has one number per term, the weight of the term times its damped frequency, so the
score for an item is the sum over the item's terms. Only terms of items are kept: others add nothing to
any score. A task cuts its documents into blocks and builds a ball tree over each: a ball has a centroid
and a radius, and no document in it scores more than the centroid does plus radius times the root of the
number of terms. Balls are searched best first for each item until no bound reaches the tenth best score
found so far, which a task carries from block to block. Bounds are rounded up, scores are integers.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tierflow.llm.common import batch, col, fold_words, map_arrow, saved, texts_of

TOP = 10
# Documents of a block and of a leaf, and terms that a block may hold.
BLOCK_DOCS = 4096
BLOCK_TERMS = 4_000_000
LEAF_DOCS = 64
# Items are searched in blocks of about this many words.
ITEM_WORDS = 500_000
# A part of a split has at least this share of the ball.
LEAST_SHARE = 0.1

# Fixed values of the score.
WEIGHT_SCALE = 1000
TF_SCALE = 1_000_000_000
LENGTH_PERCENT = 90


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def damping(n: int, n_docs: int, total: int) -> int:
    """``m`` of a document of ``n`` terms."""
    return 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * n_docs) // total


@dataclass
class Items:
    """Items as lists of term numbers, one behind the other; sent to every task."""

    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def of(self, item: int) -> np.ndarray:
        return self.terms[self.starts[item] : self.starts[item + 1]]

    def __len__(self) -> int:
        return len(self.starts) - 1


def _item_blocks(items: DataFrame, item_column: str, text_column: str, max_words: int) -> Iterator[tuple[list, dict, Items]]:
    """Blocks of items with a term: their ids, the numbers of their terms, and the items themselves. The
    driver holds one block, of ``max_words`` words and one more item at most."""
    rows = items.select(col(item_column).alias("id"), col(text_column).cast("string").alias("text"))
    ids: list = []
    number: dict[bytes, int] = {}
    lists: list[list[int]] = []
    size = 0

    def block() -> tuple[list, dict, Items]:
        starts = np.cumsum([0, *map(len, lists)])
        return ids, number, Items(starts, np.array([t for x in lists for t in x], dtype=np.int64))

    for row in rows.toLocalIterator():
        terms = set(fold_words((row.text or "").encode()))
        if not terms:
            continue
        if lists and size + len(terms) > max_words:
            yield block()
            ids, number, lists, size = [], {}, [], 0
        ids.append(row.id)
        lists.append(sorted(number.setdefault(t, len(number)) for t in terms))
        size += len(terms)
    if lists:
        yield block()


def _count_terms(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for b in batches:
            sizes, terms, tfs = [], [], []
            for text in texts_of(b.column(1)):
                words = fold_words(text)
                known = [(number[w], n) for w, n in Counter(words).items() if w in number]
                sizes.append(len(words))
                terms.append([t for t, _ in known])
                tfs.append([n for _, n in known])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(tfs, pa.list_(pa.int64())),
                ],
                names=["id", "size", "terms", "tfs"],
            )

    return run


def term_counts(docs: DataFrame, number: dict[bytes, int], id_column: str, text_column: str) -> DataFrame:
    """``id, size, terms, tfs`` per document row: all its terms counted, those of items by number."""
    rows = docs.select(col(id_column).alias("id"), col(text_column).alias("text"))
    schema = StructType(
        [
            StructField("id", rows.schema["id"].dataType),
            StructField("size", LongType()),
            StructField("terms", ArrayType(IntegerType())),
            StructField("tfs", ArrayType(LongType())),
        ]
    )
    return map_arrow(rows, _count_terms(docs.sparkSession.sparkContext.broadcast(number)), schema)


class BallTree:
    """Ball tree over the rows of a sparse matrix of non-negative integers (``starts, terms, values``), at
    least one row, at least one entry in each.

    ``bounds`` gives, for every ball and item, a number that no row of the ball exceeds."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, n_terms: int, leaf: int = LEAF_DOCS):
        self.starts, self.terms, self.values, self.n_terms, self.leaf = starts, terms, values, n_terms, leaf
        self.real = values.astype(np.float64)
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.norms = np.bincount(row, self.real**2, minlength=len(starts) - 1)
        self.rows: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.centroids: list[tuple[np.ndarray, np.ndarray]] = []
        self.radii: list[float] = []
        self._scratch = np.zeros(n_terms)
        self._rounding = (max(int(np.diff(starts).max()), n_terms) + 16) * np.finfo(np.float64).eps
        self._build(np.arange(len(starts) - 1))

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of ``rows`` and the starts of each row among them."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        first = np.cumsum(sizes) - sizes
        return np.arange(sizes.sum()) - np.repeat(first - self.starts[rows], sizes), first

    def _dots(self, at: np.ndarray, first: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.real[at] * dense[self.terms[at]], first)

    def _distances(self, rows, at, first, dense: np.ndarray, norm: float) -> np.ndarray:
        return np.maximum(self.norms[rows] - 2 * self._dots(at, first, dense) + norm, 0)

    def _row(self, row: int) -> np.ndarray:
        dense = np.zeros(self.n_terms)
        low, high = self.starts[row], self.starts[row + 1]
        dense[self.terms[low:high]] = self.real[low:high]
        return dense

    def _build(self, rows: np.ndarray) -> None:
        stack = [(rows, -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            node = len(self.rows)
            if parent >= 0:
                pair = list(self.children[parent] or (0, 0))
                pair[side] = node
                self.children[parent] = tuple(pair)
            at, first = self._entries(rows)
            centroid = np.bincount(self.terms[at], self.real[at], minlength=self.n_terms) / len(rows)
            norm = float(centroid @ centroid)
            far = self._distances(rows, at, first, centroid, norm)
            # A sum of k products is off by k roundings of the largest square at most, which may be far
            # more than the difference of the squares.
            slack = 4 * self._rounding * (self.norms[rows].max() + norm)
            held = np.flatnonzero(centroid)
            self.rows.append(rows)
            self.children.append(None)
            self.centroids.append((held, centroid[held]))
            self.radii.append(math.sqrt(far.max() + slack) * (1 + 1e-9))
            if len(rows) > self.leaf:
                for s, part in enumerate(self._split(rows, at, first, far)):
                    stack.append((part, node, s))

    def _split(self, rows, at, first, far) -> tuple[np.ndarray, np.ndarray]:
        """By the nearer of two rows that are far apart, but with a least share for each part."""
        one = self._row(rows[far.argmax()])
        to_one = self._distances(rows, at, first, one, float(one @ one))
        two = self._row(rows[to_one.argmax()])
        lead = to_one - self._distances(rows, at, first, two, float(two @ two))
        order = np.argsort(lead, kind="stable")
        least = max(1, int(LEAST_SHARE * len(rows)))
        cut = min(max(int(np.searchsorted(lead[order], 0, side="right")), least), len(rows) - least)
        return rows[order[:cut]], rows[order[cut:]]

    def bounds(self, items: Items) -> np.ndarray:
        """Ball by item; 0 where no row of the ball has a term of the item."""
        found = np.zeros((len(self.rows), len(items)))
        roots = np.sqrt(np.diff(items.starts))
        for node, (held, values) in enumerate(self.centroids):
            self._scratch[held] = values
            base = np.add.reduceat(self._scratch[items.terms], items.starts[:-1])
            self._scratch[held] = 0
            found[node] = np.where(base > 0, (base + self.radii[node] * roots) * (1 + 1e-9) + 1, 0)
        return found

    def scores(self, node: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a ball and their exact scores; ``wanted`` is 1 for the item's terms, else 0."""
        rows = self.rows[node]
        at, first = self._entries(rows)
        sums = np.concatenate(([0], np.cumsum(self.values[at] * wanted[self.terms[at]])))
        return rows, sums[np.append(first[1:], len(at))] - sums[first]


class Best:
    """The best documents of one item so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, top: int):
        self.top, self.kept = top, []

    @property
    def least(self) -> int:
        """Scores below this cannot enter."""
        return -self.kept[-1][0] if len(self.kept) == self.top else 1

    def add(self, scores: list[int], ids: list) -> None:
        rows = [(-s, (i is None, 0 if i is None else i)) for s, i in zip(scores, ids)]
        self.kept = heapq.nsmallest(self.top, [*self.kept, *rows])

    def rows(self) -> Iterator[tuple[int, object]]:
        return ((-s, None if none else i) for s, (none, i) in self.kept)


def search(tree: BallTree, ids: list, items: Items, best: list[Best]) -> int:
    """Best-first search of each item; returns the number of leaves looked into."""
    bounds = tree.bounds(items)
    wanted = np.zeros(tree.n_terms, dtype=np.int64)
    looked = 0
    for item in np.flatnonzero(bounds[0] > 0).tolist():
        found, bound = best[item], bounds[:, item]
        heap = [(-bound[0], 0)]
        terms = items.of(item)
        wanted[terms] = 1
        while heap and -heap[0][0] >= found.least:
            _, node = heapq.heappop(heap)
            children = tree.children[node]
            if children is None:
                looked += 1
                rows, scores = tree.scores(node, wanted)
                good = np.flatnonzero(scores >= found.least)
                if len(good):
                    found.add(scores[good].tolist(), [ids[r] for r in rows[good].tolist()])
            else:
                for child in children:
                    if bound[child] > 0:
                        heapq.heappush(heap, (-bound[child], child))
        wanted[terms] = 0
    return looked


def _blocks(batches: Iterator[pa.RecordBatch], block_docs: int) -> Iterator[tuple[list, list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Documents with a term of an item, in blocks: ids, sizes, starts, terms and frequencies."""
    ids: list = []
    sizes: list[int] = []
    lengths: list[np.ndarray] = []
    terms: list[np.ndarray] = []
    tfs: list[np.ndarray] = []

    def block():
        starts = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
        return ids, sizes, starts, np.concatenate(terms).astype(np.int64), np.concatenate(tfs)

    held = 0
    for b in batches:
        if not b.num_rows:
            continue
        ids += b.column(0).to_pylist()
        sizes += b.column(1).to_pylist()
        lengths.append(np.diff(b.column(2).offsets.to_numpy()))
        terms.append(b.column(2).flatten().to_numpy())
        tfs.append(b.column(3).flatten().to_numpy())
        held += len(terms[-1])
        if len(ids) >= block_docs or held >= BLOCK_TERMS:
            yield block()
            ids, sizes, lengths, terms, tfs, held = [], [], [], [], [], 0
    if ids:
        yield block()


def _searcher(shared, n_docs: int, total: int, top: int, sizes_of: tuple[int, int], id_type: pa.DataType):
    block_docs, leaf_docs = sizes_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        best = [Best(top) for _ in range(len(items))]
        for ids, sizes, starts, terms, tfs in _blocks(batches, block_docs):
            damped = np.repeat(np.array([8 * damping(n, n_docs, total) for n in sizes], dtype=np.int64), np.diff(starts))
            values = items.weights[terms] * ((TF_SCALE * tfs) // (1000 * tfs + damped))
            search(BallTree(starts, terms, values, len(items.weights), leaf_docs), ids, items, best)
        rows = [(item, i, score) for item, b in enumerate(best) for score, i in b.rows()]
        yield batch(
            {
                "item": ([r[0] for r in rows], pa.int32()),
                "doc_id": ([r[1] for r in rows], id_type),
                "score": ([r[2] for r in rows], pa.int64()),
            }
        )

    return run


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    max_words: int = ITEM_WORDS,
    block_docs: int = BLOCK_DOCS,
    leaf_docs: int = LEAF_DOCS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item the ``top`` documents with the highest scores above
    0, ranks from 1, equal scores by ascending id.

    Terms are ``fold_words`` of the whole text. Documents are all rows: a repeated row is ranked again, a
    null or empty text has no terms and no rank, a null id comes behind all others of its score. An item
    is a row too, so a repeated item has its ranks again; one without terms has none, a null item id is
    kept. Terms that no document has add nothing. Ids may be of any type with an order; columns come out
    as ``doc_id`` and ``item_id`` whatever their names, other columns are not looked at. Empty tables give
    no rows. Items are searched in blocks of ``max_words`` words, each against all documents; a text of
    any length is one row of one task. A task gives ``top`` rows an item at most.
    """
    spark = docs.sparkSession
    id_field, item_field = docs.schema[id_column].dataType, items.schema[item_column].dataType
    schema = StructType([StructField("item", IntegerType()), StructField("doc_id", id_field), StructField("score", LongType())])
    names = StructType([StructField("item", IntegerType()), StructField("item_id", item_field)])
    found = None
    for ids, number, block in _item_blocks(items, item_column, item_text, max_words):
        counted = saved(term_counts(docs, number, id_column, text_column), "search-terms")
        sums = counted.agg(F.count_if(F.col("size") > 0).alias("n"), F.sum("size").alias("total")).first()
        if not sums.n:
            continue
        frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        # One row per term of the block's items.
        df = {r.term: r.df for r in frequency.collect()}
        block.weights = np.array([weight(sums.n, df.get(t, 0)) for t in range(len(number))], dtype=np.int64)
        shared = spark.sparkContext.broadcast(block)
        run = _searcher(shared, sums.n, sums.total, top, (block_docs, leaf_docs), _arrow_type(id_field))
        ranked = counted.filter(F.size("terms") > 0).mapInArrow(run, schema)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = ranked.withColumn("rank", place).filter(F.col("rank") <= top)
        named = spark.createDataFrame(list(enumerate(ids)), names)
        ranked = ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        empty = StructType([names["item_id"], StructField("rank", IntegerType()), *schema.fields[1:]])
        return spark.createDataFrame([], empty)
    return found


def _arrow_type(data_type) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)
