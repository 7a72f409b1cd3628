import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tierflow.llm import simple8b
from tierflow.llm.chunks import Kept, WordEndEncoder
from tierflow.llm.queries import tokenizer_file
from tierflow.llm.token_files import token_files

PATH = tokenizer_file("word_bpe_49k.json")
ODD = [
    "", "  ", "Hi<|endoftext|> You", "<|EndOfText|>", "it's don't. 'S x's, — a—, b c d", "Σας ΣΑΣ. İstanbul",
    "a" * 5000 + "!!?", "x.,y.", "'s 's.", "é. É, 漢字. 漢字", "\x1c a\x1fb", "1234. 5.,", "İ- İ.() aİ, b", "word " * 3000,
]


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 9000])
@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 2**31, 2**60, 2**64 - 1])
def test_round_trip(n, high):
    rng = np.random.default_rng(n)
    values = rng.integers(0, high, n, dtype=np.uint64)
    values[rng.integers(0, max(n, 1), n // 3)] = 0
    data = simple8b.encode(values)
    assert (simple8b.decode(data) == values).all()
    for start, count in ((0, 0), (0, n), (n // 2, n - n // 2), (n // 3, n // 5)):
        assert (simple8b.decode_range(data, start, count) == values[start : start + count]).all()


def test_cached_pieces_equal_whole_texts():
    library = Tokenizer.from_file(PATH)
    expected = [library.encode(t, add_special_tokens=False).ids for t in ODD]
    assert [x.tolist() for x in WordEndEncoder(PATH).encode([t.encode() for t in ODD])] == expected


def test_random_texts_equal_the_library():
    rng = random.Random(4)
    parts = ["a", "B", "The", "é", "ß", "İ", "Σ", " ", " ", "\n", "\xa0", "́", "‍", "'s", "'LL", ".", ",", "!!", "—", "_", "1",
             "²", "漢", "한", "ا", "😀", "<|", "<|endoftext|>", "\x00", "\x1c", "\x85", "ǅ", "ﬁ", "K", "()"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    library = Tokenizer.from_file(PATH)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in WordEndEncoder(PATH).encode([t.encode() for t in texts])] == expected


def test_files_against_plain_loop(spark):
    rows = [(i * 7 % 13, t, "x") for i, t in enumerate(ODD)] + [(20, None, "x"), (3, "again", "y"), (3, "again", "y")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, start string")
    found = sorted(map(tuple, token_files(frame, PATH).collect()), key=lambda r: r[1])
    library = Tokenizer.from_file(PATH)
    assert [r[0] for r in found] == sorted(r[0] for r in rows)
    crc, at = {}, 0
    for doc_id, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        crc.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for doc_id, start, n, value in found:
        assert start == at
        at += n
        assert (n, value) in crc[doc_id]


def test_empty_table(spark):
    assert token_files(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_a_word_is_looked_up_once_a_batch(monkeypatch):
    asked = []
    kept = Kept.get, Kept.__getitem__
    monkeypatch.setattr(Kept, "get", lambda self, *a: asked.append(a[0]) or kept[0](self, *a), raising=False)
    monkeypatch.setattr(Kept, "__getitem__", lambda self, a: asked.append(a) or kept[1](self, a), raising=False)
    texts = [b"some Words often, " * 2000, b"", b"words again"]
    library = Tokenizer.from_file(PATH)
    expected = [library.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in WordEndEncoder(PATH).encode(texts)] == expected
    assert len(asked) < 50


def test_new_words_of_plain_letters_equal_the_library():
    rng = random.Random(5)
    words = {"".join(rng.choice("etaoinshrdluvzq") for _ in range(rng.randint(1, 30))) for _ in range(2000)}
    words = [w.encode() for w in sorted(words)]
    pieces = WordEndEncoder(PATH)
    assert pieces.letters is not pieces.library
    expected = [e.ids for e in pieces.library.encode_batch([w.decode() for w in words], add_special_tokens=False)]
    pieces._learn(set(words))
    assert [np.frombuffer(pieces.cache[w], "<u4").tolist() for w in words] == expected


def test_cuts_between_letters_digits_and_punctuation():
    rng = random.Random(7)
    parts = [*"abyz019.,!?;:#*$%&|-_()/\"+='", "'s", "'re", "é", "́", " ", "\n", "Z"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    pieces = WordEndEncoder(PATH)
    assert pieces.cuts[ord("a"), ord(",")] and not pieces.cuts[ord("a"), ord("'")]
    expected = [e.ids for e in pieces.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in pieces.encode([t.encode() for t in texts])] == expected
