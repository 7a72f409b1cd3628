import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tierflow.llm.chunks import Kept
from tierflow.llm.queries import tokenizer_file
from tierflow.llm.token_counts import SpanEncoder, attribute, count_tokens, line_sections

PATH = tokenizer_file("byte_bpe_50k.json")
ODD = [
    "", "  ", "  a  b ", "x ", " lead", "a\n b\n\n c\t d \n e", "Σας é 漢字\n\nab\t c\r\nd", "😀 x🇩🇪 😀", "it's don't 's", "a\n",
    "\n a", " ", " x <|endoftext|> y", "a b　 c", "one.\ntwo, three!!\n\n\nfour\n", "long text. " * 4000 + "end",
]


def plain(text):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    return library.encode(text, add_special_tokens=False).offsets


def test_cached_spans_equal_whole_texts():
    found = SpanEncoder(PATH).spans(ODD)
    assert [[tuple(s) for s in x.tolist()] for x in found] == [plain(t) for t in ODD]


def brute(spans, starts, ends, rule):
    counts, outside, crossing = [0.0] * len(starts), 0.0, 0

    def section(at):
        return next((i for i, (s, e) in enumerate(zip(starts, ends)) if s <= at < e), None)

    def slot(at):  # gaps are told apart by how many sections end before them
        inside = section(at)
        return (inside, True) if inside is not None else (sum(e <= at for e in ends), False)

    for start, end in spans:
        owners = [slot(at) for at in range(start, max(end, start + 1))]
        crossing += len(set(owners)) > 1
        if rule == "first":
            shares = {owners[0]: 1.0}
        elif rule == "most":
            best = max(dict.fromkeys(owners), key=lambda o: owners.count(o))
            shares = {best: 1.0}
        else:
            shares = {o: owners.count(o) / len(owners) for o in set(owners)}
        for (i, inside), share in shares.items():
            if inside:
                counts[i] += share
            else:
                outside += share
    return counts, crossing, outside


@pytest.mark.parametrize("rule", ["first", "most", "split"])
@pytest.mark.parametrize("seed", range(6))
def test_attribution_against_single_characters(rule, seed):
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(60), 30))
    spans = list(zip(cuts, cuts[1:]))
    edges = sorted(rng.sample(range(62), 12))
    starts, ends = edges[0::2], edges[1::2]
    if seed % 2:
        starts = [starts[0], *ends[:-1]]
    counts, crossing, outside = attribute(np.array(spans), np.array(starts), np.array(ends), rule)
    expected = brute(spans, starts, ends, rule)
    assert counts.tolist() == pytest.approx(expected[0])
    assert (crossing, outside) == (expected[1], pytest.approx(expected[2]))


def test_counts(spark):
    rows = [(i, "src", "en", t, 1) for i, t in enumerate(ODD)] + [(None, None, None, None, 1), (4, "s", "e", "x", 1), (4, "s", "e", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string, n_tokens int")
    found = count_tokens(frame, PATH, section_chars=4).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    for i, text in enumerate(ODD):
        if i == 4:
            continue
        row, spans = by[i], plain(f"src\nen\n{text}")
        assert row.n_tokens == len(spans) == pytest.approx(sum(row.fields.values()) + row.outside)
        assert "".join(text[s.start : s.end] for s in row.sections) == text
        counts, crossing, _ = brute(spans, [0, 4, 7], [3, 6, 7 + len(text)], "first") if text else ([1, 1, 0], 0, 0)
        assert [row.fields[f] for f in ("source", "lang", "text")] == counts
        starts, ends = line_sections(text, 4)
        inner = brute(spans, [7 + s for s in starts], [7 + e for e in ends], "first")[0]
        if len(text) < 1000:
            assert [s.tokens for s in row.sections] == inner
    assert by[None].fields == {"source": 0.0, "lang": 0.0, "text": 0.0} and by[None].n_tokens > 0
    assert count_tokens(frame.filter("false"), PATH).count() == 0
    with pytest.raises(ValueError):
        count_tokens(frame, PATH, rule="other")


def test_a_part_is_looked_up_once_a_batch(monkeypatch):
    asked = []
    kept = Kept.get, Kept.__getitem__
    monkeypatch.setattr(Kept, "get", lambda self, *a: asked.append(a[0]) or kept[0](self, *a), raising=False)
    monkeypatch.setattr(Kept, "__getitem__", lambda self, a: asked.append(a) or kept[1](self, a), raising=False)
    texts = ["some Words öften,\n" * 2000, "", "words again, öften. Some"]
    found = SpanEncoder(PATH).spans(texts)
    assert [[tuple(s) for s in x.tolist()] for x in found] == [plain(t) for t in texts]
    assert len(asked) < 50


PARTS = [
    " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c", "\x00", "\x85", "\xa0", "\u2028", "\u3000", "a", "the", "Hello", "é", "ö.", "漢字",
    "e\u0301", "42", "²", "'", "'s", "'ll", "’s", "!!", "...", "…", "_", "<|endoftext|>", "😀", "🇩🇪", "%%%", "\x7f",
]


def across_blanks(parts):
    """Merges of white space with what precedes it."""
    model = parts["model"]
    as_pair = isinstance(model["merges"][0], list)
    for one, two in ["ĊĠ", "ĉĠ", "©Ġ", "ĉĊ", "!Ġ"]:
        model["vocab"].setdefault(one + two, max(model["vocab"].values()) + 2)
        model["merges"].insert(0, [one, two] if as_pair else f"{one} {two}")


OTHERS = {
    "as it is": lambda parts: None,
    "merges across blanks": across_blanks,
    "prefix": lambda parts: parts["pre_tokenizer"].update(add_prefix_space=True),
    "no pattern": lambda parts: parts["pre_tokenizer"].update(use_regex=False),
}


@pytest.mark.parametrize("kind", OTHERS)
def test_cuts_change_nothing(kind, tmp_path):
    with open(PATH) as file:
        parts = json.load(file)
    OTHERS[kind](parts)
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(parts))
    library = Tokenizer.from_file(str(path))
    library.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(2000)] + [a + b for a in PARTS for b in PARTS]
    tokens = SpanEncoder(str(path))
    for _ in range(2):
        found = [x for low in range(0, len(texts), 100) for x in tokens.spans(texts[low : low + 100])]
        assert [[tuple(s) for s in x.tolist()] for x in found] == [e.offsets for e in library.encode_batch(texts, add_special_tokens=False)]
        tokens.cache = Kept(50, 10_000)


@pytest.mark.parametrize("rule", ["first", "most", "split"])
@pytest.mark.parametrize("fields", [("text",), ("lang", "text"), ("text", "lang")])
def test_counts_of_each_document_of_a_batch(spark, rule, fields):
    rng = random.Random(1)
    some = [["".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(2)] for _ in range(60)]
    rows = [(i, *texts) for i, texts in enumerate(some)]
    frame = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").coalesce(1)

    def with_gaps(text, n):
        starts = list(range(1, len(text) + 9, 5))  # the last ones end behind the text
        return starts, [s + 3 for s in starts]

    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    found = count_tokens(frame, PATH, fields=fields, separator="é-", rule=rule, sections_of=with_gaps).collect()
    for row in found:
        values = [dict(zip(("lang", "text"), some[row.doc_id]))[f] for f in fields]
        starts = [sum(len(v) + 2 for v in values[:i]) for i in range(len(values))]
        ends = [s + len(v) for s, v in zip(starts, values)]
        spans = library.encode("é-".join(values), add_special_tokens=False).offsets
        counts, crossing, outside = brute(spans, starts, ends, rule)
        assert (row.n_tokens, row.n_crossing) == (len(spans), crossing)
        assert [row.fields[f] for f in fields] == pytest.approx(counts) and row.outside == pytest.approx(outside)
        from_, to = with_gaps(values[-1], 500)
        inner = brute(spans, [starts[-1] + s for s in from_], [starts[-1] + s for s in to], rule)[0]
        assert [(s.start, s.end) for s in row.sections] == list(zip(from_, to))
        assert [s.tokens for s in row.sections] == pytest.approx(inner)
    assert len(found) == len(rows)
