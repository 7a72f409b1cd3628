"""Registered queries of the dealt operators, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.llm.ball_tree import TOP, ranked_search
from tierflow.llm.common import read_table
from tierflow.llm.decontaminate import contamination
from tierflow.llm.language import predict_languages
from tierflow.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, license_report, run_length
from tierflow.llm.ngram_join import near_duplicates
from tierflow.llm.pieces import encode_pieces
from tierflow.llm.quality_model import predict_quality
from tierflow.llm.quality_rules import FEW_LINE_DOCS, LEFT_SHARE, LINE_DOCS, LINE_SHARE, apply_quality_rules
from tierflow.llm.repeats import WINDOW as REPEAT_WORDS
from tierflow.llm.repeats import repeat_report
from tierflow.llm.spelling import DELETE_EVERY, FORM_RATIO, MIN_COUNT, MIN_LENGTH, spelling_variants
from tierflow.llm.token_counts import count_tokens
from tierflow.llm.token_files import token_files
from tierflow.llm.url_filter import JUNK, LINKS, RULES, TRACKING, judge_urls, junk_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; other installations pass their own path to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


# Windows of 10 words, or of a whole shorter item; documents by word number.
ORACLES["op10_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 10) AS n FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
places AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT p.doc_id, p.i, p.n, v.item_id FROM places p JOIN windows v ON p.n = v.n AND p.g = v.g),
covered AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM hits))
  GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query
def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(read_table(spark, sf_dir, "documents"))


_WORDS = (
    "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
def _template_row(t) -> str:
    words = lambda some: "[" + ", ".join(f"'{w}'" for w in some) + "]::VARCHAR[]"
    return f"('{t.label}', '{t.text}', {words(t.needs)}, {words(t.without)}, {run_length(t.text)})"


# Plain containment of every template in every run that begins with one of its words, without an index.
ORACLES["op5_license_scans"] = f"""
WITH phrases AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{v}')" for p, v in PHRASES.items())}) AS t(phrase, label)),
templates AS (
  SELECT row_number() OVER () AS t_no, label, list_distinct({_WORDS.format("body")}) AS t, needs, without, reach
  FROM (VALUES {", ".join(map(_template_row, TEMPLATES))}) AS t(label, body, needs, without, reach)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
places AS (
  SELECT doc_id, i, p.label
  FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d) s, phrases p
  WHERE w[i + 1] = split_part(phrase, ' ', 1)
    AND array_to_string(list_slice(w, i + 1, i + len(string_split(phrase, ' '))), ' ') = phrase),
base AS (
  SELECT doc_id, count(*) AS n, min(i) AS first_word, max(i) AS last_word,
    list_sort(list_distinct(list(label))) AS labels
  FROM places GROUP BY doc_id),
possible AS (
  SELECT r, doc_id, w, t_no FROM d, templates WHERE len(list_intersect(t, w)) >= {THRESHOLD} * len(t) - 1e-9),
starts AS (SELECT r, doc_id, w, t_no, unnest(range(1, len(w) + 1)) AS i FROM possible),
runs AS (
  SELECT doc_id, label, t, needs, without, list_slice(w, i, i + reach - 1) AS s
  FROM starts JOIN templates USING (t_no) WHERE list_contains(t, w[i])),
cut AS (
  SELECT *, list_min(list_filter(list_transform(without, lambda x: list_position(s, x)), lambda p: p > 0)) AS e FROM runs),
own AS (SELECT doc_id, label, t, needs, CASE WHEN e IS NULL THEN s ELSE list_slice(s, 1, e - 1) END AS s FROM cut),
matches AS (
  SELECT doc_id, label, len(list_intersect(t, s)) / len(t) AS containment
  FROM own WHERE len(list_intersect(t, s)) >= {THRESHOLD} * len(t) - 1e-9 AND len(list_intersect(needs, s)) = len(needs)),
method AS (SELECT doc_id, max(containment) AS best, list_distinct(list(label)) AS labels FROM matches GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ',')
    AS labels,
  CASE WHEN coalesce(n, 0) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN method USING (doc_id)
"""


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(read_table(spark, sf_dir, "documents"))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is made from the html of pages: those with junk symbols and what they link to."""
    pages = read_table(spark, sf_dir, "pages")
    return judge_urls(pages, junk_urls(pages))


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLES["op6_url_filters"] = rf"""
WITH p AS (
  SELECT page_id, url, html, row_number() OVER () AS n,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)', 2) AS path,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)', 3) AS query
  FROM pages),
c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN concat(host, regexp_replace(path, '/+$', ''), '?',
    array_to_string(list_sort(list_filter(string_split(query, '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))), '&')) END AS canonical
  FROM p),
links AS (
  SELECT host, unnest(regexp_extract_all(html, '{LINKS}', 1)) AS link FROM c
  WHERE url IS NOT NULL AND regexp_matches(html, '{JUNK}')),
parts AS (
  SELECT host, regexp_extract(link, '([^?#]*)\??([^#]*)', 1) AS path, regexp_extract(link, '([^?#]*)\??([^#]*)', 2) AS query
  FROM links),
listed AS (
  SELECT canonical FROM c WHERE canonical IS NOT NULL AND regexp_matches(html, '{JUNK}')
  UNION
  SELECT concat(host, regexp_replace(path, '/+$', ''), '?',
    array_to_string(list_sort(list_filter(string_split(query, '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))), '&')) FROM parts),
fits AS (
  SELECT n, rule, verdict
  FROM (SELECT n, r.host || r.path AS rule, verdict,
          row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.path) DESC) AS place
        FROM c JOIN (SELECT * FROM (VALUES {_RULE_ROWS}) AS t(verdict, host, path)) r
          ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path))
  WHERE place = 1)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  listed.canonical IS NOT NULL AS listed
FROM c LEFT JOIN fits USING (n) LEFT JOIN listed ON c.canonical = listed.canonical
"""


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of more than ``LINE_DOCS`` documents of a host, or of fewer that are a share of it."""
    return apply_quality_rules(read_table(spark, sf_dir, "documents"), few_docs=FEW_LINE_DOCS)


_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op1_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host,
    regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w
  FROM documents),
lines AS (
  SELECT r, host, text, raw,
    trim(regexp_replace({_LOWER.format("raw")}, '[ 	-
]+', ' ', 'g')) AS line
  FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS raw FROM d)
  WHERE translate(raw, {_BLANKS}, '') <> ''),
dup AS (SELECT r, count(*) - count(DISTINCT raw) AS n FROM lines GROUP BY r),
windows AS (
  SELECT r, i, concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT r, i FROM windows JOIN (SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1) USING (r, g)),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
sizes AS (SELECT host, count(DISTINCT text) AS size FROM d GROUP BY host),
boilerplate AS (
  SELECT host, line
  FROM (SELECT host, line, count(DISTINCT text) AS docs FROM lines GROUP BY host, line) JOIN sizes USING (host)
  WHERE docs > {LINE_DOCS} OR (docs > {FEW_LINE_DOCS} AND docs > {LINE_SHARE}::DOUBLE * size)),
removed AS (
  SELECT r, sum(len(string_split(line, ' '))) AS n FROM lines JOIN boilerplate USING (host, line) GROUP BY r),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(translate(text, {_BLANKS}, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN repeated USING (r) LEFT JOIN removed USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND n_words - n_removed_words >= {LEFT_SHARE}::DOUBLE * n_words AS kept
FROM counts
"""


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


# All pairs with an n-gram in common, and their closure.
ORACLES["op2_ngram_join"] = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
grams AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS gram
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)),
sets AS (SELECT r, count(*) AS n, md5(string_agg(gram, '|' ORDER BY gram)) AS k FROM grams GROUP BY r),
texts AS (SELECT k, min(r) AS r, min(n) AS n FROM sets GROUP BY k),
held AS (SELECT k, gram FROM texts JOIN grams USING (r)),
pairs AS (
  SELECT a.k AS ka, b.k AS kb, count(*) AS c FROM held a JOIN held b ON a.gram = b.gram AND a.k < b.k GROUP BY a.k, b.k),
links AS (
  SELECT ka, kb FROM pairs JOIN texts ta ON ta.k = ka JOIN texts tb ON tb.k = kb
  WHERE c::DOUBLE / (ta.n + tb.n - c) >= 0.8::DOUBLE),
edges AS (SELECT ka, kb FROM links UNION ALL SELECT kb, ka FROM links),
reach AS (
  SELECT DISTINCT ka AS k, ka AS root FROM edges
  UNION SELECT kb, root FROM reach JOIN edges ON ka = k),
groups AS (SELECT k, min(root) AS root FROM reach GROUP BY k),
degree AS (SELECT ka AS k, count(*) AS n_links FROM edges GROUP BY ka),
labelled AS (
  SELECT doc_id, coalesce(root, sets.k) AS g, coalesce(n_links, 0) AS n_links
  FROM d JOIN sets USING (r) LEFT JOIN groups ON groups.k = sets.k LEFT JOIN degree ON degree.k = sets.k)
SELECT doc_id, min(doc_id) OVER (PARTITION BY g) AS class_id, CAST(n_links AS BIGINT) AS n_links FROM labelled
UNION ALL SELECT doc_id, doc_id, 0 FROM d WHERE len(w) = 0
"""


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"), delete_every=DELETE_EVERY)


# CRC-32 is computed byte by byte from a table made by its rule. Near words are joined on what is left
# when one code point is taken away.
ORACLES["op11_spelling_variants"] = f"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS c FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
found AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, {_LOWER.format("run")} AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
      string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
        ELSE [CAST(195 AS BIGINT), CAST(unicode(x) - 64 AS BIGINT)] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM found, tab),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % {DELETE_EVERY} = 0
          THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
less AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
longer AS (SELECT DISTINCT l.word AS a, w.word AS b FROM less l JOIN words w ON w.word = l.d),
near AS (
  SELECT a, b FROM longer UNION ALL SELECT b, a FROM longer
  UNION ALL SELECT x.word, y.word FROM less x JOIN less y ON x.i = y.i AND x.d = y.d AND x.word <> y.word),
best AS (
  SELECT a, count(*) AS n_near, max(n) AS form_n, arg_min(b, (-n, b)) AS form FROM near JOIN words ON word = b GROUP BY a),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {FORM_RATIO} * n THEN form END AS form,
    CASE WHEN form_n >= {FORM_RATIO} * n THEN form_n END AS form_n
  FROM words LEFT JOIN best ON a = word),
walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NOT NULL),
roots AS (
  SELECT walk.word, walk.at AS root FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM forms JOIN roots USING (word)
"""


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


# Every document with a term of the item is scored.
ORACLES["op12_ranked_search"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
sums AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d),
damped AS (SELECT r, doc_id, 100 - 90 + ((90 * len(w) * n_docs) // total) AS m FROM d, sums WHERE len(w) > 0),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS weight FROM df, sums),
i AS (
  SELECT i, item_id, unnest(list_distinct({_WORDS.format("coalesce(text, '')")})) AS t
  FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
scores AS (
  SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
    CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN tf USING (t) JOIN weights USING (t) JOIN damped USING (r) GROUP BY i, r),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""


@query
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(read_table(spark, sf_dir, "documents"))


# Every window by its words, and the smallest document that it starts in.
ORACLES["op13_substring_dedup"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + {REPEAT_WORDS - 1}), ' ') AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {REPEAT_WORDS - 2})) AS i FROM d)),
least AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + {REPEAT_WORDS})) AS p
  FROM windows JOIN least USING (g) WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL)),
kept AS (
  SELECT r, list(word ORDER BY p) AS words
  FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(coalesce(words, [])) AS BIGINT) AS n_removed,
  sha256(array_to_string(coalesce(words, []), ' ')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
