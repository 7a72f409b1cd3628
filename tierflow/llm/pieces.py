"""Operator 3: SentencePiece encoding and decoding on the tokenizers library."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tierflow.llm.chunks import CACHE_BYTES, Kept, encoder, joined_ids
from tierflow.llm.common import batch, col, map_arrow

MARK = "▁"
STEP_DOCS = 128
CACHE_ENTRIES = 400_000

# Field numbers, kinds and defaults of the public model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            if kind == 2:
                size, at = varint(at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class PieceModel:
    """What encoding needs of a model file."""

    kind: int
    pieces: tuple[tuple[str, float, int], ...]
    unknown: int
    byte_fallback: bool
    character_map: bytes
    dummy_prefix: bool
    trim_blanks: bool

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        pieces, trainer, normaliser = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        kind = trainer.get(3, UNIGRAM)
        if kind not in (UNIGRAM, BPE) or trainer.get(24, 0) or not normaliser.get(5, 1):
            raise ValueError("only unigram and BPE models with a leading white space mark are supported")
        return cls(
            kind,
            tuple(pieces),
            next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN),
            bool(trainer.get(35, 0)),
            normaliser.get(2, b""),
            bool(normaliser.get(3, 1)),
            bool(normaliser.get(4, 1)),
        )


def _bpe(model: PieceModel):
    """Every way to join two pieces into a third, better scores first, then lower ids."""
    from tokenizers import models

    ids = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
    joins = []
    for piece, score, kind in model.pieces:
        if kind in (NORMAL, USER):
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in ids and right in ids:
                    joins.append((-score, ids[piece], ids[left], ids[right], left, right))
    merges = [(left, right) for *_, left, right in sorted(joins)]
    unknown = model.pieces[model.unknown][0]
    return models.BPE(ids, merges, unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)


def _back() -> list:
    from tokenizers import decoders

    return [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]


def build_tokenizer(model: PieceModel):
    """The model as a tokenizers pipeline: character map, white space, pieces, and the way back."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.kind == BPE:
        tokenizer = Tokenizer(_bpe(model))
    else:
        scores = [(piece, score) for piece, score, _ in model.pieces]
        tokenizer = Tokenizer(models.Unigram(scores, model.unknown, model.byte_fallback))
    steps = []
    if model.character_map:
        steps.append(normalizers.Precompiled(model.character_map))
    if model.trim_blanks:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([*_back(), *strip])
    return tokenizer


class PieceEncoder:
    """Encodes texts with a model file; the parts of a BPE model's texts are encoded once and kept.

    Merging can only join two symbols if some piece holds the last character of the one next to the
    first of the other. Where no piece has two neighbours, a text can be cut between them without
    changing its ids. White space marks begin parts and, in such a model, follow nothing but marks;
    line ends and punctuation often cannot join either. Characters are told by their last and first
    bytes, which may only miss a cut. Texts where that does not hold (leading, doubled or trailing
    blanks, the mark itself) are encoded whole.
    """

    RUN = 500

    def __init__(self, path: str, threads: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as file:
            self.model = PieceModel.parse(file.read())
        from tokenizers import Tokenizer, decoders, normalizers

        self.library = build_tokenizer(self.model)
        self.raw = Tokenizer.from_str(self.library.to_str())
        self.raw.normalizer = normalizers.Sequence([])
        pairs = {p[i : i + 2] for p, _, _ in self.model.pieces for i in range(len(p) - 1)}
        self.begins = np.array([p[0] == MARK for p, _, _ in self.model.pieces])
        apart = not any(p[1] == MARK and p[0] != MARK for p in pairs)
        plain = self.model.kind == BPE and not self.model.character_map and not self.model.trim_blanks
        lines = not any("\n" in p for p in pairs)
        known = self.model.byte_fallback or any(p == MARK for p, _, _ in self.model.pieces)
        self.parted = plain and apart and lines and known and self.model.dummy_prefix
        self.cuts = self._cuts(pairs)
        line = self.raw.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 and line[0] != self.model.unknown else None
        self.cache = Kept(CACHE_ENTRIES, CACHE_BYTES)
        single = Tokenizer.from_str(self.library.to_str())
        single.decoder = decoders.Sequence(_back())
        known = len(self.model.pieces)
        texts = single.decode_batch([[i] for i in range(known)], skip_special_tokens=False)
        self.texts = pa.array(texts, pa.large_string()).view(pa.large_binary())
        self.high = np.array([kind == BYTE and int(piece[3:5], 16) > 127 for piece, _, kind in self.model.pieces])

    def _cuts(self, pairs: set[str]) -> np.ndarray:
        """Whether a text, its marks written as blanks, may be cut between two bytes."""
        cuts = np.ones((256, 256), dtype=bool)
        cuts[:, 0x80:0xC0] = False  # inside a character
        for one, two in pairs:
            cuts[one.replace(MARK, " ").encode()[-1], two.replace(MARK, " ").encode()[0]] = False
        if not self.model.byte_fallback:
            # Unknown characters that follow each other become one piece.
            known = np.zeros(256, dtype=bool)
            known[[ord(p.replace(MARK, " ")) for p, _, _ in self.model.pieces if p == MARK or len(p) == 1 and p < "\x80"]] = True
            cuts &= known[:, None] | known
        # A mark stands before each word and, as a blank, before each text.
        cuts[:, 0x20] = True
        return cuts

    def _batch(self, tokenizer, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _learn_runs(self, parts: list[bytes], between: str, firsts: Callable[[np.ndarray], np.ndarray]) -> None:
        """Parts are joined, many in one text, and told apart by ``firsts``: where in the ids of a run
        the parts begin. The texts are one batch, which the library's threads share."""
        texts = [p.decode().replace(" ", MARK) for p in parts]
        runs = range(0, len(parts), self.RUN)
        found = self._batch(self.raw, [between.join(texts[low : low + self.RUN]) for low in runs])
        for low, data in zip(runs, found):
            some = parts[low : low + self.RUN]
            at = firsts(np.frombuffer(data, "<u4"))
            if len(at) == len(some):
                starts = (4 * at).tolist()
                ends = [a - 4 * len(between) for a in starts[1:]] + [len(data)]
                self.cache.update((p, data[a:b]) for p, a, b in zip(some, starts, ends))
            else:
                self.cache.update(zip(some, self._batch(self.raw, texts[low : low + self.RUN])))

    def _learn(self, missing: set[bytes]) -> None:
        """As a cut before a mark or around a line end changes nothing, the ids of a part with a mark
        begin with the next piece that has one, those of other parts behind the next line end."""
        marked, others, alone = [], [], []
        rest = alone if self.line is None else others
        for part in missing:
            (marked if part[:1] == b" " else alone if part == b"\n" else rest).append(part)
        self._learn_runs(marked, "", lambda ids: np.flatnonzero(self.begins[ids]))
        self._learn_runs(others, "\n", lambda ids: np.append(0, np.flatnonzero(ids == self.line) + 1))
        self.cache.update(zip(alone, self._batch(self.raw, [p.decode() for p in alone])))

    def _whole(self, text: str) -> bool:
        """Whether a text has to stay whole."""
        return not self.parted or "  " in text or MARK in text or text[:1] == " " or text[-1:] == " "

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text, without begin and end pieces; an empty text has none."""
        self.cache.turn()
        whole = [self._whole(t) for t in texts]
        # The blank stands for the mark before the first word.
        cuttable = [b" " + t.encode() if t and not w else b"" for t, w in zip(texts, whole)]
        found = joined_ids(cuttable, self.cuts, self.cache, self._learn)
        rest = iter(self._batch(self.library, [t for t, w in zip(texts, whole) if t and w]))
        return [np.frombuffer(next(rest), "<u4") if t and w else f for t, w, f in zip(texts, whole, found)]

    def decode(self, ids: Sequence[Sequence[int]]) -> list[str]:
        """Text of each list of ids. The decoder treats pieces one by one, except that it puts bytes
        beyond ASCII together; lists with such bytes go to it whole, the others are put together from
        what it has given for each piece."""
        flat = np.concatenate([np.empty(0, np.int64), *(np.asarray(row, np.int64) for row in ids)])
        borders = np.cumsum([0, *map(len, ids)])
        whole = (np.diff(np.concatenate(([0], np.cumsum(self.high[flat])))[borders]) > 0).tolist()
        rest = iter(self.library.decode_batch([list(map(int, r)) for r, w in zip(ids, whole) if w], skip_special_tokens=False))
        _, ends, data = self.texts.take(pa.array(flat)).buffers()
        at = np.frombuffer(ends, np.int64, len(flat) + 1)[borders].tolist() if len(flat) else [0] * len(borders)
        data = memoryview(data or b"")
        texts = [next(rest) if w else str(data[a:b], "utf-8") for w, a, b in zip(whole, at, at[1:])]
        blank = self.model.dummy_prefix
        return [t[1:] if blank and not w and t[:1] == " " else t for t, w in zip(texts, whole)]


def _reference(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _normal(reference, texts: list[str], model: PieceModel) -> list[str]:
    """Texts as the SentencePiece library normalises them, without the marks."""
    plain = [t.replace(MARK, " ") for t in reference.normalize(texts)]
    return [t[1:] if model.dummy_prefix and t[:1] == " " else t for t in plain]


PIECES = "doc_id bigint, ids array<int>, n_tokens bigint, ids_crc32 bigint, parity boolean, round_trip boolean"


def encode_pieces(
    docs: DataFrame,
    model_path: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    threads: int = 2,
    verify: bool = True,
    keep_ids: bool = True,
) -> DataFrame:
    """Per document ``doc_id, ids, n_tokens, ids_crc32, parity, round_trip``, from its whole text.

    Texts are encoded in batches by ``threads`` threads of the tokenizers library. With ``verify``,
    ``parity`` says whether the SentencePiece library gives the same ids for the whole text, and
    ``round_trip`` whether decoding the ids gives the text back as that library normalises it; else
    both are null. A null text counts as empty
    and has no ids. ``ids`` is null without ``keep_ids``. Repeated rows and null ids give a row each;
    other columns are not looked at. ``model_path`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(PieceEncoder, model_path, threads)
        reference = encoder(_reference, model_path) if verify else None
        for b in batches:
            for low in range(0, b.num_rows, STEP_DOCS):
                part = b.slice(low, STEP_DOCS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = pieces.encode(texts)
                same = back = [None] * len(texts)
                if verify:
                    same = [f.tolist() == e for f, e in zip(found, reference.encode(texts, num_threads=1))]
                    back = [t == r for t, r in zip(pieces.decode(found), _normal(reference, texts, pieces.model))]
                lists = pa.nulls(len(texts), pa.list_(pa.int32()))
                if keep_ids:
                    # Numpy's arrays laid end to end, which Arrow takes over as they are.
                    borders = np.cumsum([0, *map(len, found)], dtype=np.int32)
                    lists = pa.ListArray.from_arrays(borders, np.concatenate(found).astype(np.int32))
                yield batch(
                    {
                        "doc_id": (part.column(0), pa.int64()),
                        "ids": (lists, pa.list_(pa.int32())),
                        "n_tokens": ([len(f) for f in found], pa.int64()),
                        "ids_crc32": ([zlib.crc32(f.tobytes()) for f in found], pa.int64()),
                        "parity": (same, pa.bool_()),
                        "round_trip": (back, pa.bool_()),
                    }
                )

    return map_arrow(docs.select(col(id_column).cast("bigint"), col(text_column)), run, PIECES)


def decode_pieces(
    encoded: DataFrame, model_path: str, *, id_column: str = "doc_id", ids_column: str = "ids", threads: int = 2
) -> DataFrame:
    """``doc_id, text`` from ids. Null ids give null text, no ids the empty text; an id outside the
    model is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(PieceEncoder, model_path, threads)
        for b in batches:
            ids = b.column(1).to_pylist()
            known = len(pieces.model.pieces)
            if any(not 0 <= x < known for row in ids if row for x in row):
                raise ValueError("an id is outside the model")
            texts = iter(pieces.decode([x for x in ids if x is not None]))
            text = [None if x is None else next(texts) for x in ids]
            yield batch({"doc_id": (b.column(0), pa.int64()), "text": (text, pa.string())})

    return map_arrow(encoded.select(col(id_column).cast("bigint"), col(ids_column)), run, "doc_id bigint, text string")
