"""Operator 9: token counts of fields and sections from one encoding of the whole document."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm.chunks import CACHE_BYTES, CACHE_ENTRIES, Kept, encoder, joined_ids
from tierflow.llm.common import batch, col, map_arrow

STEP_DOCS = 128
RULES = ("first", "most", "split")
# The letters of byte-level tokens: printable characters of Latin-1 stand for their own byte, those from
# the 256th on for the other bytes in their order.
_PRINTABLE = {chr(b): b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
LETTERS = _PRINTABLE | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in _PRINTABLE)}


class SpanEncoder:
    """Token spans for byte-level BPE, found from the bytes of each token.

    Where the splitter is the well-known one of byte_bpe_50k, texts are cut where it parts them too:
    between ASCII letters, digits and punctuation, and before white space that follows one of them.
    White space after other bytes, which may be white space as well, is cut off where no token holds
    the two, for then a cut only parts what is never merged. Arrow numbers the different parts of a
    batch; new ones are encoded by the library, many in one text, and the sizes of their tokens are
    kept. With other splitters texts are encoded whole.
    """

    RUN = 500
    BLANKS = b"\t\n\r "
    # A byte-level splitter with its own pattern, which adds nothing.
    SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        if self.library.normalizer is not None or "ByteLevel" not in str(self.library.pre_tokenizer):
            raise ValueError("this tokenizer is not a byte-level BPE without normaliser")
        parts = json.loads(self.library.to_str())
        model, splitter = parts["model"], parts["pre_tokenizer"]
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.parted = (
            all(splitter.get(k) == v for k, v in self.SPLITTER.items())
            and all(t["special"] for t in parts["added_tokens"])
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and vocab.keys() >= LETTERS.keys()
        )
        # Each letter of a token stands for a byte.
        self.sizes = np.zeros(max(vocab.values(), default=0) + 1, dtype="<u4")
        for token, number in vocab.items():
            self.sizes[number] = len(token)
        kinds = np.zeros(256, dtype=int)
        for byte in range(33, 127):
            kinds[byte] = 1 if chr(byte).isalpha() else 2 if chr(byte).isdigit() else 3
        self.cuts = self._cuts(vocab, kinds)
        # First bytes of parts before which a line end may stand, last ones that any white space may follow.
        self.firsts = {*self.BLANKS, *np.flatnonzero(kinds).tolist()}
        self.lasts = set(np.flatnonzero(self.cuts[:, list(self.BLANKS)].all(axis=1)).tolist())
        # By part: the bytes of each of its tokens.
        self.cache = Kept(CACHE_ENTRIES // 2, CACHE_BYTES)

    def _cuts(self, vocab: Iterable[str], kinds: np.ndarray) -> np.ndarray:
        """Whether a text may be cut between two bytes that follow each other."""
        cuts = (kinds[:, None] != kinds) & (kinds[:, None] > 0) & (kinds > 0)
        cuts[ord("'")] = False  # 's and the like are one part
        cuts[:, list(self.BLANKS)] = True
        for one, two in {pair for token in vocab for pair in zip(token, token[1:])}:
            one, two = LETTERS.get(one), LETTERS.get(two)
            if one is not None and two is not None and two in self.BLANKS and not kinds[one]:
                cuts[one, two] = False
        return cuts

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        """Bytes of each token."""
        return [self.sizes[e.ids] for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: set[bytes]) -> None:
        """Parts that begin with white space may follow others in one text, for it would be cut there.
        Before those that do not, a line end is put, which is a token then."""
        runs, alone = [], []
        for part in missing:
            (runs if part[0] in self.firsts and part[-1] in self.lasts else alone).append(part)
        for low in range(0, len(runs), 64 * self.RUN):
            some = [runs[a : a + self.RUN] for a in range(low, min(low + 64 * self.RUN, len(runs)), self.RUN)]
            units = [[p if p[0] in self.BLANKS else b"\n" + p for p in run] for run in some]
            for parts, run, sizes in zip(some, units, self._encoded([b"".join(run).decode() for run in units])):
                at = np.cumsum(sizes, dtype=np.int64)
                ends = np.searchsorted(at, np.cumsum(np.fromiter(map(len, run), np.int64, len(run)))) + 1
                raw, cuts = sizes.tobytes(), [0, *(4 * ends).tolist()]
                self.cache.update(
                    (p, raw[a if len(p) == len(u) else a + 4 : b]) for p, u, a, b in zip(parts, run, cuts, cuts[1:])
                )
        self.cache.update((p, s.tobytes()) for p, s in zip(alone, self._encoded([p.decode() for p in alone])))

    def laid_out(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts (UTF-8) laid end to end: the first and the end character of each token, where the
        tokens of each text begin and end, and how many characters lie before each byte. Tokens that
        share the bytes of one character all have that character's span."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        before = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=before[1:])
        if self.parted:
            self.cache.turn()
            found = joined_ids(texts, self.cuts, self.cache, self._learn)
            sizes = np.concatenate([np.empty(0, "<u4"), *found])
            ends = np.cumsum(sizes, dtype=np.int64)
            first, last = before[ends - sizes + 1] - 1, before[ends]
        else:
            whole = self.library.encode_batch([t.decode() for t in texts], add_special_tokens=False)
            found = [np.array(e.offsets, np.int64).reshape(-1, 2) for e in whole]
            shifts = before[np.cumsum([0, *map(len, texts)])]
            first, last = np.concatenate([np.empty((0, 2), np.int64), *(f + n for f, n in zip(found, shifts))]).T
        return first, last, np.cumsum([0, *map(len, found)]), before

    def spans(self, texts: Sequence[str]) -> list[np.ndarray]:
        """First and end character of each token of each text."""
        first, last, borders, _ = self.laid_out([t.encode() for t in texts])
        chars = np.cumsum([0, *map(len, texts)]).tolist()
        both = np.stack((first, last), axis=1)
        return [both[a:b] - n for a, b, n in zip(borders.tolist(), borders[1:].tolist(), chars)]


def _placed(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, list[int]]:
    """Tokens of each section and gap (see ``attribute``), and the numbers of the tokens that cross a
    boundary. Slot 2i + 1 is section i, even slots are the gaps around them. Tokens are in order, so
    the boundaries are looked up among them, not the other way round."""
    edges = np.empty(2 * len(starts), dtype=np.int64)
    edges[0::2], edges[1::2] = starts, ends
    low, high = np.searchsorted(last, edges, side="right"), np.searchsorted(first, edges, side="left")
    counts = np.diff(np.concatenate(([0], high, [len(first)]))).astype(float)
    over = sorted({k for a, b in zip(low[low < high].tolist(), high[low < high].tolist()) for k in range(a, b)})
    if not over:
        return counts, []
    crossing = []
    bounds = np.concatenate(([np.iinfo(np.int64).min], edges, [np.iinfo(np.int64).max]))
    from_ = np.searchsorted(edges, first[over], side="right")
    to = np.searchsorted(edges, last[over] - 1, side="right")
    counts -= np.bincount(from_, minlength=len(counts))
    for k, start, end, a, b in zip(over, first[over].tolist(), last[over].tolist(), from_.tolist(), to.tolist()):
        shares = [(slot, max(0, min(end, int(bounds[slot + 1])) - max(start, int(bounds[slot])))) for slot in range(a, b + 1)]
        shares = [(slot, size) for slot, size in shares if size]
        if len(shares) > 1:
            crossing.append(k)
        if rule == "first":
            counts[shares[0][0]] += 1
        elif rule == "most":
            counts[max(shares, key=lambda s: (s[1], -s[0]))[0]] += 1
        else:
            for slot, size in shares:
                counts[slot] += size / (end - start)
    return counts, crossing


def attribute(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, int, float]:
    """Tokens of each section, the number of tokens that cross a boundary, and what lies outside.

    Tokens are in order. Sections are sorted and apart; gaps may lie between them. The rule says where
    a token goes that does not lie in one section: ``first`` to the section of its first character,
    ``most`` to the one with most of its characters (the earlier of equals), ``split`` to all by their
    share of its characters. A gap counts like a section; what falls there is outside.
    """
    counts, crossing = _placed(spans[:, 0], spans[:, 1], starts, ends, rule)
    return counts[1::2], len(crossing), float(counts[0::2].sum())


def line_sections(text: str, n: int) -> tuple[list[int], list[int]]:
    """Sections of about ``n`` characters that end with a line: each takes whole lines until it has
    ``n`` characters or more; the line end belongs to its line."""
    starts, ends, at = [], [], 0
    while at < len(text):
        cut = text.find("\n", max(at + n - 1, at))
        end = len(text) if cut < 0 else cut + 1
        starts.append(at)
        ends.append(end)
        at = end
    return starts, ends


COUNTS = (
    "doc_id bigint, n_tokens bigint, n_crossing bigint, outside double, "
    "fields map<string,double>, sections array<struct<start:int,end:int,tokens:double>>"
)
_FIELDS = pa.map_(pa.string(), pa.float64())
_SECTION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.float64())])
_SECTIONS = pa.list_(_SECTION)


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_column: str = "doc_id",
    fields: Sequence[str] = ("source", "lang", "text"),
    separator: str = "\n",
    section_chars: int = 500,
    rule: str = "first",
    sections_of: Callable[[str, int], tuple[list[int], list[int]]] = line_sections,
) -> DataFrame:
    """Tokens per field and per section of the last field.

    The fields are joined with ``separator`` and encoded once, whole. Token spans are then joined with
    the spans of the fields and, separately, with those of the sections; ``rule`` (see ``attribute``)
    places tokens that cross a boundary. ``n_crossing`` counts tokens across field boundaries and
    separators, ``outside`` what fell to separators: the fields and ``outside`` sum up to
    ``n_tokens``. Sections are given by their place in the last field; their sum is that field's count
    but for tokens shared with what precedes it.

    A null field counts as empty and has 0 tokens. A document of empty fields still has the tokens of
    its separators. Repeated rows and null ids give a row each; other columns are not looked at.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(SpanEncoder, tokenizer_path)
        for b in batches:
            for low in range(0, b.num_rows, STEP_DOCS):
                part = b.slice(low, STEP_DOCS)
                values = [c.cast(pa.large_binary()) for c in part.columns[1:]]
                joined = pc.binary_join_element_wise(*values, pa.scalar(separator.encode(), pa.large_binary()))
                first, last, borders, before = tokens.laid_out(joined.to_pylist())
                # Fields and separators by turns, one document after the other.
                sizes = np.full((part.num_rows, 2 * len(names)), len(separator.encode()), dtype=np.int64)
                sizes[:, 0::2] = np.stack([pc.binary_length(v).to_numpy(zero_copy_only=False) for v in values], axis=1)
                sizes[:, -1] = 0
                places = before[np.cumsum(np.append(0, sizes))]
                counts, crossing = _placed(first, last, places[0:-1:2], places[1::2], rule)
                outside = counts[0:-1:2].reshape(-1, len(names)).sum(axis=1)
                n_crossing = np.bincount(np.searchsorted(borders, crossing, side="right") - 1, minlength=part.num_rows)
                found = [sections_of(t, section_chars) for t in part.column(len(names)).to_pylist()]
                cuts = np.cumsum([0, *(len(starts) for starts, _ in found)])
                starts, ends = (np.array([x for f in found for x in f[side]], dtype=np.int64) for side in (0, 1))
                # A section may end behind its text, but holds no tokens of the next one.
                docs_at, lasts_at = places[0 :: 2 * len(names)], places[2 * len(names) - 2 : -1 : 2 * len(names)]
                begin, shift, end = (np.repeat(x, np.diff(cuts)) for x in (docs_at[:-1], lasts_at, docs_at[1:]))
                inside = (np.clip(x + shift, begin, end) for x in (starts, ends))
                inner = _placed(first, last, *inside, rule)[0][1::2]
                sections = pa.StructArray.from_arrays(
                    [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(inner)], fields=list(_SECTION)
                )
                rows = np.arange(part.num_rows + 1, dtype=np.int32)
                keys = pa.array(names * part.num_rows, pa.string())
                yield batch(
                    {
                        "doc_id": (part.column(0), pa.int64()),
                        "n_tokens": (np.diff(borders), pa.int64()),
                        "n_crossing": (n_crossing, pa.int64()),
                        "outside": (outside, pa.float64()),
                        "fields": (pa.MapArray.from_arrays(rows * len(names), keys, pa.array(counts[1::2])), _FIELDS),
                        "sections": (pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), sections), _SECTIONS),
                    }
                )

    selected = [F.coalesce(col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(names)]
    return map_arrow(docs.select(col(id_column).cast("bigint").alias("d"), *selected), run, COUNTS)
