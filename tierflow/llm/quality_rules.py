"""Operator 1: quality rules, with the frequency of lines across the documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tierflow.llm.common import col, saved

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A line is boilerplate of a host beyond this many different documents, however large the host is.
LINE_DOCS = 20
# Where asked for, fewer documents are enough in hosts of which they are more than this share.
FEW_LINE_DOCS = 5
LINE_SHARE = 0.001
# Words that must be left of a document when boilerplate is taken away.
LEFT_SHARE = 0.5
BROADCAST_BYTES = 32 << 20
# Up to this many different windows of a text are looked up one by one.
FEW_WINDOWS = 24


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _words(text: Column) -> Column:
    """Words of a text; the empty text has none."""
    trimmed = F.trim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _count_of(text: str, characters: str) -> Column:
    """Occurrences of some ASCII characters; taking them out one by one is searching for bytes."""
    rest = F.col(text)
    for character in characters:
        rest = F.replace(rest, F.lit(character), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest)


def _lowered(line: Column) -> Column:
    """A-Z lowered and nothing else: lowering ASCII lines as they are, others letter by letter."""
    plain = F.octet_length(line) == F.char_length(line)
    return F.when(plain, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def _rows(docs: DataFrame, id_column: str, text_column: str, host_column: str) -> DataFrame:
    text = F.coalesce(col(text_column), F.lit(""))
    return docs.select(
        col(id_column).alias("doc_id"),
        text.alias("text"),
        F.coalesce(col(host_column).cast("string"), F.lit("")).alias("host"),
        F.xxhash64(text).alias("text_hash"),
    )


def base_counts(rows: DataFrame) -> DataFrame:
    """``doc_id, text_hash`` with the counts of the base rules, each from the row's whole text.

    Repeated words: three-word windows are hashed and the hashes sorted; equal neighbours are windows
    found twice or more, and the places of these, in order, tell how many words they cover. Few different
    ones are looked up in all windows; for many, the windows are sorted once more with their places. Sorting
    keeps the work of a long text at n log n without leaving the row.
    """
    split = rows.select(
        "doc_id",
        "text_hash",
        _count_of("text", SYMBOLS).cast("bigint").alias("n_symbols"),
        _words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), _has_word).alias("lines"),
    )
    plain = ["doc_id", "text_hash", "n_symbols"]
    last = F.greatest(F.size("words") - 2, F.lit(0))
    hashes = F.transform(
        F.slice("words", F.lit(1), last),
        lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)),
    )
    hashed = split.select(
        *plain,
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.size("words").cast("bigint").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        hashes.alias("hashes"),
    )
    plain += ["word_chars", "n_words", "n_dup_lines"]
    ordered = hashed.select(*plain, "hashes", F.sort_array("hashes").alias("ordered"))
    equal = F.array_distinct(F.filter("ordered", lambda h, i: F.coalesce(F.get("ordered", i - 1) == h, F.lit(False))))
    marked = ordered.select(*plain, "hashes", equal.alias("equal"))
    many = F.size("equal") > FEW_WINDOWS
    pairs = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    paired = marked.select(*plain, "hashes", "equal", F.when(many, pairs).alias("pairs"))
    beside = lambda x, i: F.coalesce(F.get("pairs", i)["h"] == x["h"], F.lit(False))
    twice = F.filter("pairs", lambda x, i: beside(x, i - 1) | beside(x, i + 1))
    far = F.sort_array(F.transform(twice, lambda x: x["i"]))
    each = F.transform("hashes", lambda h, i: F.when(F.array_contains("equal", h), i))
    near = F.array_compact(each)
    none = F.array().cast("array<int>")
    places = F.when(F.size("equal") == 0, none).when(many, far).otherwise(near)
    found = paired.select(*plain, places.alias("places"))
    covered = F.transform(
        "places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - p, F.lit(3))).cast("bigint")
    )
    total = F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return found.select(*plain, total.alias("n_repeat_words"))


def host_lines(rows: DataFrame) -> DataFrame:
    """``doc_id, text_hash, host, place, line, n``: each line with a word by its number, as the hash
    of its normal form (A-Z lowered, runs of blanks as one, trimmed), and its number of words."""
    lines = rows.select("doc_id", "text_hash", "host", F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    # Only what is not one blank already has to be replaced.
    spaced = F.trim(F.regexp_replace(_lowered(F.col("raw")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))
    normal = lines.select("doc_id", "text_hash", "host", "place", spaced.alias("normal")).filter("normal <> ''")
    words = F.octet_length("normal") - F.octet_length(F.replace("normal", F.lit(" "), F.lit(""))) + 1
    return normal.select(
        "doc_id", "text_hash", "host", "place", F.xxhash64("normal").alias("line"), words.cast("bigint").alias("n")
    )


def _line_counts(rows: DataFrame, min_docs: int, few_docs: int | None, share: float) -> DataFrame:
    """``host, line, docs, limit``: different documents of each line, and beyond how many it is boilerplate.
    Only hosts where the share asks for more than ``few_docs`` have an entry of sizes."""
    pairs = host_lines(rows).select("host", "line", "text_hash").distinct()
    counts = pairs.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
    if few_docs is None:
        return counts.withColumn("limit", F.lit(float(min_docs)))
    sizes = rows.select("host", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.filter(F.lit(share) * F.col("size") > few_docs).withColumnRenamed("host", "its_host")
    often = counts.filter(F.col("docs") > min(few_docs, min_docs))
    placed = often.join(large, F.col("host") == F.col("its_host"), "left").drop("its_host")
    by_share = F.greatest(F.lit(float(few_docs)), F.coalesce(F.lit(share) * F.col("size"), F.lit(0.0)))
    return placed.withColumn("limit", F.least(F.lit(float(min_docs)), by_share))


def boilerplate_lines(
    rows: DataFrame, min_docs: int = LINE_DOCS, few_docs: int | None = None, share: float = LINE_SHARE
) -> tuple[DataFrame, int]:
    """``host, line`` above the limit, written to the shared folder, and their number.

    Documents are told apart by their text, so exact copies count once. Repetitions are dropped before
    the shuffle and counts are then taken per key in tasks, so a line that most documents have does not
    meet in one task.
    """
    above = _line_counts(rows, min_docs, few_docs, share).filter(F.col("docs") > F.col("limit"))
    counted = Observation()
    listed = saved(above.select("host", "line").observe(counted, F.count(F.lit(1)).alias("n")), "boilerplate")
    return listed, counted.get["n"]


def removed_lines(rows: DataFrame, boilerplate: DataFrame, n_lines: int) -> DataFrame:
    """``its_doc, its_hash, removed`` of documents with a boilerplate line: number and words of each."""
    marks = boilerplate.select(F.col("host").alias("its_host"), F.col("line").alias("its_line"))
    # 100 bytes an entry; a longer list is joined by shuffle, where a crowded line can be split since
    # both sides are plain rows.
    marks = F.broadcast(marks) if n_lines * 100 <= BROADCAST_BYTES else marks
    same = (F.col("host") == F.col("its_host")) & (F.col("line") == F.col("its_line"))
    # A set: identical rows of the table have the same lines.
    return (
        host_lines(rows)
        .join(marks, same)
        .groupBy(F.col("doc_id").alias("its_doc"), F.col("text_hash").alias("its_hash"))
        .agg(F.collect_set(F.struct("place", "n")).alias("removed"))
    )


def _with_removed(frame: DataFrame, removed: DataFrame) -> DataFrame:
    same = F.col("doc_id").eqNullSafe(F.col("its_doc")) & (F.col("text_hash") == F.col("its_hash"))
    return frame.join(removed, same, "left").drop("its_doc", "its_hash")


def apply_quality_rules(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    min_docs: int = LINE_DOCS,
    few_docs: int | None = None,
    share: float = LINE_SHARE,
    left_share: float = LEFT_SHARE,
) -> DataFrame:
    """Per document the base counts, ``base_failed``, ``n_removed_words`` and ``kept``.

    A document is kept if the base rules pass and, once the boilerplate lines of its host are taken
    away, ``left_share`` of its words are left. A line is boilerplate when more than ``min_docs``
    different documents of the host have it, in small and large hosts alike. With ``few_docs`` a line is
    boilerplate too when more than ``few_docs`` different documents, and more than ``share`` of the
    host's, have it. Null or empty text has no words and fails the base rules. A null host is a host like any other. Documents with the same
    text count once for line frequencies, and each gets its row; so do repeated rows and null ids.
    Other columns are not looked at. An empty table gives no rows.
    """
    rows = _rows(docs, id_column, text_column, host_column)
    listed, n_lines = boilerplate_lines(rows, min_docs, few_docs, share)
    judged = _with_removed(base_counts(rows), removed_lines(rows, listed, n_lines))
    gone = F.aggregate(
        F.coalesce("removed", F.array().cast("array<struct<place:int,n:bigint>>")),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x["n"],
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(*counts, failed.alias("base_failed"), gone.alias("n_removed_words")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= left_share * F.col("n_words"))
    )


def remove_boilerplate(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    min_docs: int = LINE_DOCS,
    few_docs: int | None = None,
    share: float = LINE_SHARE,
    left_share: float = LEFT_SHARE,
) -> DataFrame:
    """``doc_id, text``: the texts without the boilerplate lines of their host, depleted documents
    left out. Rules and odd cases as in ``apply_quality_rules``; null text comes back empty."""
    rows = _rows(docs, id_column, text_column, host_column)
    listed, n_lines = boilerplate_lines(rows, min_docs, few_docs, share)
    marked = _with_removed(rows, removed_lines(rows, listed, n_lines))
    places = F.transform("removed", lambda x: x["place"])
    left = F.array_join(
        F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.coalesce(places, F.array().cast("array<int>")), i)),
        "\n",
    )
    cleaned = marked.select("doc_id", "text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(left).alias("left"))
    words = lambda c: F.size(_words(F.col(c)))
    return cleaned.filter(words("left") >= left_share * words("text")).select("doc_id", F.col("left").alias("text"))
