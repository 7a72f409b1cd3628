"""Tokenising by cached pieces, for tokenizers whose result for a text is the concatenation of the
results for its pieces.

Encoding is by far the dearest step, and most pieces of a text have been met before. Every id comes
from the tokenizers library; only repeated calls are saved. What is kept is bounded (see ``Kept``), and
results do not depend on it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Sequence
from itertools import filterfalse

import numpy as np
import pyarrow as pa

# Rayon threads of a forked worker can hang; Spark already runs one task per core.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE_ENTRIES = 800_000
CACHE_BYTES = 256 << 20


class Kept(dict):
    """What has been encoded, by piece, in two generations. When the newer one is half of what may be
    kept, it becomes the older one, which still answers: what is asked for again moves back, what is
    not is forgotten with the next turn. So frequent pieces stay, and memory is bounded by entries and by
    bytes."""

    def __init__(self, entries: int = CACHE_ENTRIES, size: int = CACHE_BYTES):
        super().__init__()
        self.older: dict = {}
        self.entries, self.bytes, self.used = entries // 2, size // 2, 0

    def __missing__(self, piece):
        value = self[piece] = self.older[piece]
        return value

    def knows(self, piece) -> bool:
        return piece in self or piece in self.older

    def unknown(self, pieces: Iterable) -> set:
        """Those of ``pieces`` that are not kept; the call counts them as kept from now on."""
        # Not a set's difference, which would go through all that is kept.
        missing = set(filterfalse(self.__contains__, pieces))
        again = {p: self.older[p] for p in missing if p in self.older}
        self.update(again)
        # A piece, its value and its place in the table.
        self.used += sum(map(len, missing)) * 3 + 200 * len(missing)
        return missing.difference(again)

    def values_of(self, pieces: list, learn: Callable[[set], None]) -> list:
        """What is kept for each of ``pieces``, which are all different, after ``learn`` has kept the rest."""
        found = list(map(self.get, pieces))
        missing = [i for i, value in enumerate(found) if value is None]
        learn(self.unknown([pieces[i] for i in missing]))
        for i in missing:
            found[i] = self[pieces[i]]
        return found

    def turn(self) -> None:
        if len(self) > self.entries or self.used > self.bytes:
            self.older, self.used = dict(self), 0
            self.clear()


def joined_ids(
    texts: Sequence[bytes], cuts: np.ndarray, kept: Kept, learn: Callable[[set[bytes]], None], blanks: bytes = b""
) -> list[np.ndarray]:
    """Ids of each text (UTF-8), from its pieces. ``cuts`` says for any two bytes that follow each other
    whether a text is cut between them; texts are always cut from each other.
    ``blanks`` are cut off and left out. Numpy cuts, Arrow numbers the different pieces and lays their
    ids side by side, so a piece is looked up once, however often the texts hold it."""
    joined = b"".join(texts)
    if not joined:
        return [np.empty(0, "<u4")] * len(texts)
    data = np.frombuffer(joined, np.uint8)
    begins = np.ones(len(data), dtype=bool)
    neighbours = data[:-1].astype(np.uint16)
    neighbours <<= 8
    neighbours |= data[1:]
    begins[1:] = cuts.reshape(-1)[neighbours]
    borders = np.cumsum([0, *map(len, texts)])
    begins[borders[borders < len(data)]] = True
    starts = np.flatnonzero(begins)
    sizes = np.diff(starts, append=len(data))
    if blanks:
        word = ~np.isin(data[starts], np.frombuffer(blanks, np.uint8))
        starts, sizes, joined = starts[word], sizes[word], joined.translate(None, blanks)
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(joined)]
    numbered = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), buffers).dictionary_encode()
    different = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
    ids = pa.array(kept.values_of(different, learn), pa.large_binary()).take(numbered.indices)
    _, ends, found = ids.buffers()
    if not len(ids) or not found:
        return [np.empty(0, "<u4")] * len(texts)
    borders = np.searchsorted(starts, borders)
    at = (np.frombuffer(ends, np.int64, len(ids) + 1)[borders] // 4).tolist()
    flat = np.frombuffer(found, "<u4", at[-1])
    return [flat[a:b] for a, b in zip(at, at[1:])]


_encoders: dict[tuple, object] = {}


def encoder(kind: type, *args):
    """One encoder of each kind and model per Python worker."""
    key = (kind, *args)
    if key not in _encoders:
        _encoders[key] = kind(*args)
    return _encoders[key]


class WordEndEncoder:
    """For byte-level BPE with word ends whose splitter drops white space, such as word_bpe_49k.

    A text is cut at ASCII white space, where the normaliser and the splitter cut too, and, if the
    splitter is a known one, between an ASCII letter or digit and ASCII punctuation. ASCII letters
    are lowered before the cache is asked, as the normaliser lowers them later. A chunk that ends in
    ASCII punctuation after another letter is stored as the letters and the punctuation, which the
    splitter parts as well. New words of letters are encoded together in one call, one after the other, and
    told apart by the word-end mark that the last id of each carries. Where normaliser and splitter
    leave lower-case ASCII letters as they are, such words go to the library's model past both. Texts
    with ``<|`` may hold special tokens, which are matched before lowering; they go to the library whole.
    """

    TAIL = b".,!?;:#*$%&|-_()/\"+="
    BLANKS = b"\t\n\x0b\x0c\r "
    # Normalisers and splitters that neither change nor part lower-case ASCII letters.
    NORMALISERS = (
        {"type": "NFC"},
        {"type": "Lowercase"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    )
    LETTERS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        kinds = str(self.library.normalizer), str(self.library.pre_tokenizer)
        mark = self.library.model.end_of_word_suffix
        if "Lowercase" not in kinds[0] or "\\s" not in kinds[1] or not mark:
            raise ValueError("this tokenizer does not lower case, split at white space and mark word ends")
        self.ends_word = np.zeros(self.library.get_vocab_size(), dtype=bool)
        for token, number in self.library.get_vocab().items():
            self.ends_word[number] = token.endswith(mark)
        at_blanks = self._at_blanks()
        self.letters = at_blanks or self.library
        plain, tail, blank = (np.zeros(256, dtype=bool) for _ in range(3))
        plain[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
        tail[list(self.TAIL)] = blank[list(self.BLANKS)] = True
        self.cuts = blank[:, None] | blank
        if at_blanks:
            self.cuts |= plain[:, None] & tail | tail[:, None] & plain
        self.cache = Kept()

    def _at_blanks(self):
        """The model behind a splitter at blanks, None where lower-case ASCII letters may come to it otherwise."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        parts = json.loads(self.library.to_str())
        steps, splitters = parts["normalizer"].get("normalizers"), parts["pre_tokenizer"].get("pretokenizers")
        if not steps or any(s not in self.NORMALISERS for s in steps) or not splitters or len(splitters) != 2:
            return None
        split, alphabet = splitters
        same = split.get("pattern") == {"Regex": self.LETTERS} and split["behavior"] == "Removed" and split["invert"]
        model = parts["model"]
        options = ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        if not same or alphabet["type"] != "ByteLevel" or alphabet["add_prefix_space"] or alphabet["use_regex"] or model["dropout"]:
            return None
        merges = [tuple(m) for m in model["merges"]]
        # No word comes twice, so the model need not keep any.
        given = {o: model[o] for o in options if model[o] is not None}
        plain = Tokenizer(models.BPE(model["vocab"], merges, cache_capacity=0, **given))
        plain.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        return plain

    def _whole(self, texts: Sequence[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _learn_words(self, words: list[bytes], tokenizer, run: int) -> None:
        for low in range(0, len(words), 64 * run):
            runs = [words[a : a + run] for a in range(low, min(low + 64 * run, len(words)), run)]
            texts = [b" ".join(r).decode() for r in runs]
            for some, found in zip(runs, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(found.ids, dtype="<u4")
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) == len(some) and (not len(ids) or ends[-1] == len(ids)):
                    raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                    self.cache.update((w, raw[a:b]) for w, a, b in zip(some, cuts, cuts[1:]))
                else:
                    self.cache.update(zip(some, self._whole([w.decode() for w in some])))

    def _learn(self, missing: set[bytes]) -> None:
        cache, split, words, others, letters = self.cache, {}, set(), set(), set()
        for chunk in missing:
            body = chunk.rstrip(self.TAIL)
            if body.isalpha():  # ASCII letters
                letters.add(body)
                if len(body) < len(chunk):
                    split[chunk] = body, chunk[len(body) :]
                continue
            text = body.decode()
            # Lowering may turn a letter into a letter and a mark, which the splitter parts from the
            # letter and joins to punctuation that follows.
            plain = text.isalpha() and text.lower().isalpha()
            if plain and len(body) == len(chunk):
                words.add(chunk)
            elif body and len(body) < len(chunk) and text[-1].isalpha() and text[-1].lower().isalpha():
                split[chunk] = body, chunk[len(body) :]
                (words if plain else others).add(body)
            else:
                others.add(chunk)
        others.update(tail for _, tail in split.values())
        letters, words, rest = ([x for x in some if not cache.knows(x)] for some in (letters, words, others))
        self._learn_words(letters, self.letters, 200)
        self._learn_words(words, self.library, 1000)
        cache.update(zip(rest, self._whole([x.decode() for x in rest])))
        for chunk, (body, tail) in split.items():
            cache[chunk] = cache[body] + cache[tail]

    def encode(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8), as the library's ``encode(text, add_special_tokens=False)``."""
        self.cache.turn()
        whole = [b"<|" in t for t in texts]
        # The blank behind each text parts it from the next.
        lowered = [b" " if w else t.lower() + b" " for t, w in zip(texts, whole)]
        found = joined_ids(lowered, self.cuts, self.cache, self._learn, self.BLANKS)
        for i, text in enumerate(texts):
            if whole[i]:
                found[i] = np.frombuffer(self._whole([text.decode()])[0], dtype="<u4")
        return found
