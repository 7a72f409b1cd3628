import random
import struct

import pytest
import sentencepiece

from tierflow.llm.chunks import Kept
from tierflow.llm.pieces import BPE, BYTE, CONTROL, NORMAL, UNIGRAM, UNKNOWN, PieceEncoder, decode_pieces, encode_pieces
from tierflow.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")
ODD = [
    "", "  ", "  a  b ", "x ", "▁ a ▁▁b", " lead", "Σας é 漢字\n\nab\t c\r\nd", "a\0b c", "😀 x🇩🇪", "....,,,!!! ...", "a" * 3000,
    "<s> </s> <unk> <0x41>", "\n", "\n \n", "a   b    c     d", "á ​", "the word, the word. The end", "long text " * 5000,
]


def field(number, kind, value):
    def varint(n):
        out = bytearray()
        while True:
            out.append(n & 127 | (128 if n > 127 else 0))
            n >>= 7
            if not n:
                return bytes(out)

    key = varint(number << 3 | kind)
    return key + (varint(value) if kind == 0 else value if kind == 5 else varint(len(value)) + value)


def model_file(kind, words, trim):
    """A small model, written by hand: control pieces, bytes, letters and some words."""
    pieces = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL), ("</s>", 0.0, CONTROL)]
    pieces += [(f"<0x{i:02X}>", 0.0, BYTE) for i in range(256)]
    pieces += [(w, -1.5 - i * 0.37, NORMAL) for i, w in enumerate(words)]
    data = b""
    for piece, score, sort in pieces:
        data += field(1, 2, field(1, 2, piece.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, sort))
    trainer = field(3, 0, kind) + field(35, 0, 1) + field(40, 0, 0) + field(41, 0, 1) + field(42, 0, 2)
    normaliser = field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, int(trim)) + field(5, 0, 1)
    return data + field(2, 2, trainer) + field(3, 2, normaliser)


@pytest.mark.parametrize("kind", [UNIGRAM, BPE])
@pytest.mark.parametrize("trim", [False, True])
def test_hand_made_models(tmp_path, kind, trim):
    words = ["▁", "th", "▁th", "▁the", "he", "in", "▁in", "ing", "er", "▁a", "an", "and", "▁and", *"abcdeghinrt.,"]
    path = tmp_path / "small.model"
    path.write_bytes(model_file(kind, words, trim))
    reference = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["the thing and the hen", "andering. inthe, a", "", "zz the é", "the  two   gaps ", " lead"]
    pieces = PieceEncoder(str(path), 1)
    found = [x.tolist() for x in pieces.encode(texts)]
    assert found == reference.encode(texts)
    assert pieces.decode(found) == reference.decode(found)


def test_parity_and_round_trip(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(None, None, 1), (0, "again", 1), (0, "again", 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    encoded = encode_pieces(frame, PATH)
    found = encoded.collect()
    assert len(found) == len(rows) and all(r.parity and r.round_trip for r in found)
    reference = sentencepiece.SentencePieceProcessor(model_file=PATH)
    by = {i: t for i, t, _ in rows[: len(ODD)]}
    for row in found:
        if row.doc_id:
            assert row.ids == reference.encode(by[row.doc_id]) and row.n_tokens == len(row.ids)
    texts = decode_pieces(encoded, PATH).filter("doc_id > 0").collect()
    for row in texts:
        assert row.text == by[row.doc_id].replace("▁", " ")
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert {tuple(r) for r in decode_pieces(odd, PATH).collect()} == {(1, None), (2, "")}
    assert encode_pieces(frame.filter("false"), PATH).count() == 0


def test_a_part_is_looked_up_once_a_batch(monkeypatch):
    asked = []
    kept = Kept.get, Kept.__getitem__
    monkeypatch.setattr(Kept, "get", lambda self, *a: asked.append(a[0]) or kept[0](self, *a), raising=False)
    monkeypatch.setattr(Kept, "__getitem__", lambda self, a: asked.append(a) or kept[1](self, a), raising=False)
    texts = [" ".join(["some Words, often\nmet"] * 2000), "", "met again"]
    reference = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert [x.tolist() for x in PieceEncoder(PATH, 1).encode(texts)] == reference.encode(texts)
    assert len(asked) < 60


@pytest.mark.parametrize("turns", [False, True])
def test_random_texts_equal_the_reference(turns):
    rng = random.Random(6)
    parts = ["a", "B", "The", "ing", "é", "ß", "Σ", " ", " ", " ", "\n", "\t", "\xa0", "\0", "́", "'s", ".", ",", "!!", "—", "_", "12", "漢", "😀", "▁", "<s>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [t.strip(" ").replace("▁", "").replace("  ", " ") for t in texts]
    reference = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = PieceEncoder(PATH, 1)
    if turns:
        pieces.cache = Kept(500, 100_000)
    for low in range(0, len(texts), 100):
        some = texts[low : low + 100]
        found = pieces.encode(some)
        assert [x.tolist() for x in found] == reference.encode(some)
        assert pieces.decode(found) == reference.decode(reference.encode(some))
