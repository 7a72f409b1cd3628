"""Operator 6: URL rules and a list of blocked URLs behind a blocked Bloom filter."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.llm.common import col, saved

# Rules asked for, as verdict, host and path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Runs of symbols in its html that put a page on the list of the registered query, and its links.
JUNK = "[#*%]{3}"
LINKS = '<a href="(/[^"]*)"'
# Query parameters that do not change what a URL shows.
TRACKING = "^(utm_[a-z]*|ref|fbclid|gclid)(=|$)"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)"
WORDS = 8
BITS_PER_URL = 12
MAX_BLOCKS = 1 << 17


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def canonical_url(url: Column) -> Column:
    """Host, path without a trailing slash, and the sorted query without tracking parameters; scheme
    and fragment do not count. Null for null and for text without ``://``."""
    query = F.split(F.regexp_extract(url, PARTS, 3), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda p: ~p.rlike(TRACKING) & (p != ""))), "&")
    whole = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""), F.lit("?"), kept)
    return F.when(F.instr(url, "://") > 0, whole)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (null without one): its host or a subdomain of
    it, and a path that begins with the rule's. Equally long rules go by order of the list."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2]))[::-1]:
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return text, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def _masks(url: Column) -> list[Column]:
    """One bit in each 64-bit word of a block, six bits of a second hash choosing each."""
    bits = F.xxhash64(url, F.lit("bits"))
    one = F.lit(1).cast("bigint")
    places = (F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS))
    return [F.call_function("shiftleft", one, place) for place in places]


def bloom_blocks(n_urls: int, max_blocks: int = MAX_BLOCKS) -> int:
    """Blocks of 512 bits: about 12 bits per URL, ``max_blocks`` at most. Beyond that the filter lets
    more URLs through to the exact join; results stay the same."""
    return max(1, min(max_blocks, 1 << math.ceil(math.log2(max(1, n_urls) * BITS_PER_URL / 512 + 1))))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """``block, w0..w7`` of the column ``listed_url``; a block without URLs has no row."""
    url = F.col("listed_url")
    masked = listed.select(_block(url, blocks).alias("block"), *(m.alias(f"m{i}") for i, m in enumerate(_masks(url))))
    return masked.groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)))


def junk_urls(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``url`` of pages whose html holds a run of junk symbols, and of what these link to on their own host.
    A link need not be a page that the table holds. Null html holds neither; null urls are left out."""
    junk = pages.filter(col(html_column).rlike(JUNK) & col(url_column).isNotNull())
    links = F.transform(
        F.array_distinct(F.regexp_extract_all(col(html_column), F.lit(LINKS), F.lit(1))),
        lambda x: F.concat(F.lit("http://"), host_of(col(url_column)), x),
    )
    return junk.select(F.explode(F.concat(F.array(col(url_column)), links)).alias("url"))


def listed_urls(urls: DataFrame, url_column: str = "url") -> DataFrame:
    """Distinct canonical URLs, written once: the filter and the exact join both read them."""
    listed = urls.select(canonical_url(col(url_column)).alias("listed_url"))
    return saved(listed.filter(F.col("listed_url").isNotNull()).distinct(), "listed-urls")


def judge_urls(
    pages: DataFrame,
    blocked: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    *,
    id_column: str = "page_id",
    url_column: str = "url",
    blocked_column: str = "url",
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """Per page ``page_id, host, path, rule, verdict, listed``.

    A page whose canonical URL is on the list ``blocked`` gets ``block``, any other ``allow``, unless
    a rule fits, which goes first. Every page is tested against the Bloom filter, which is broadcast
    (72 bytes a block, at most 9.4 MB with the default); only its possible hits are shuffled to the
    exact join, where a crowded URL can be split because the list is a written table. Null and
    malformed URLs have an empty host and path, fit no rule and are never listed. Repeated rows and
    null ids give a row each; an empty list blocks nothing, an empty table of pages gives no rows; other
    columns are not looked at.
    """
    listed = listed_urls(blocked, blocked_column)
    blocks = bloom_blocks(listed.count(), max_blocks)
    url = F.col("u")
    rows = pages.select(col(id_column).alias("page_id"), col(url_column).alias("u"))
    rows = rows.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical_url(url).alias("c"))
    words = F.broadcast(bloom_filter(listed, blocks))
    hit = reduce(Column.__and__, [F.col(f"w{i}").bitwiseAND(m) != 0 for i, m in enumerate(_masks(F.col("c")))])
    tested = rows.join(words, _block(F.col("c"), blocks) == F.col("block"), "left").select(
        "page_id", "host", "path", "c", F.coalesce(hit & F.col("c").isNotNull(), F.lit(False)).alias("maybe")
    )
    checked = tested.filter("maybe").join(listed, F.col("c") == F.col("listed_url"), "left")
    columns = ["page_id", "host", "path"]
    found = checked.select(*columns, F.col("listed_url").isNotNull().alias("listed")).unionAll(
        tested.filter(~F.col("maybe")).select(*columns, F.lit(False).alias("listed"))
    )
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return found.select(*columns, rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "listed")
