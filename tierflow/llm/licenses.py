"""Operator 5: licence scans by an exact set-similarity join of runs of words with licence templates."""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm.common import FOLD, batch, col, map_arrow, texts_of

# Phrases asked for, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

@dataclass(frozen=True)
class Template:
    """A notice and the label it stands for. A run that matches holds all words of ``needs`` and none of
    ``without``, which tell it from its siblings."""

    name: str
    label: str
    text: str
    needs: tuple[str, ...] = ()
    without: tuple[str, ...] = ()


def _creative_commons() -> Iterator[Template]:
    long = {"nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
    for parts in ((), ("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        for version in ("3.0", "4.0"):
            major = version[0]
            label = "-".join(["cc-by", *parts, version])
            names = "-".join(["Attribution", *(long[p].title() for p in parts)])
            yield Template(
                label,
                label,
                f"This work is licensed under a Creative Commons {names} {version} International License",
                ("creative", "commons", "attribution", *(long[p] for p in parts), major),
                tuple(w for p, w in long.items() if p not in parts),
            )
            short = "-".join(["BY", *(p.upper() for p in parts)])
            yield Template(
                f"{label}-short",
                label,
                f"Licensed under CC {short} {version}",
                ("cc", "by", *parts, major),
                tuple(p for p in long if p not in parts),
            )


def _gnu() -> Iterator[Template]:
    kinds = {"gpl": ("", ()), "lgpl": ("Lesser ", ("lesser",)), "agpl": ("Affero ", ("affero",))}
    for kind, (word, needs) in kinds.items():
        others = tuple(w for w in ("lesser", "affero") if w not in needs)
        for version in ("2", "3"):
            yield Template(
                f"{kind}-{version}.0",
                f"{kind}-{version}.0",
                f"This work is licensed under the GNU {word}General Public License, version {version}",
                ("gnu", "public", *needs, version),
                others,
            )
        yield Template(
            f"{kind}-header",
            kind,
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            f"{word}General Public License as published by the Free Software Foundation",
            ("gnu", "public", *needs),
            others,
        )


# Usual one-line notices and opening sentences of public licences.
TEMPLATES: tuple[Template, ...] = (
    Template("apache-1.1", "apache-1.1", "Licensed under the Apache License, Version 1.1", ("apache", "1")),
    Template("apache-2.0", "apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache", "2")),
    Template(
        "apache-2.0-header",
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
        ("apache", "2"),
    ),
    Template(
        "bsd",
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
        ("redistribution", "binary"),
    ),
    Template(
        "cc0-1.0",
        "cc0-1.0",
        "To the extent possible under law, the author has waived all copyright and related rights to this work",
        ("waived", "copyright"),
    ),
    Template("mit", "mit", "Released under the MIT License", ("mit",)),
    Template(
        "mit-text",
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction",
        ("granted", "software"),
    ),
    Template(
        "mpl-2.0",
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one",
        ("mozilla", "2"),
    ),
    Template(
        "unlicense",
        "unlicense",
        "This is free and unencumbered software released into the public domain",
        ("unencumbered", "domain"),
    ),
    *_creative_commons(),
    *_gnu(),
)
THRESHOLD = 0.8


def template_words(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def needed(n: int, threshold: float) -> int:
    """Distinct words that a run must have of a template of ``n``."""
    return max(1, math.ceil(threshold * n - 1e-9))


def run_length(text: str) -> int:
    """Words of a run at most: the template's own and a quarter of them, two at least."""
    n = len(template_words(text))
    return n + max(2, n // 4)


def token_frequencies(docs: DataFrame, templates: Sequence[Template], text_column: str = "text") -> dict[bytes, int]:
    """In how many documents each template word occurs; the result has one entry per distinct word of the
    templates, whatever the size of the corpus."""
    vocabulary = frozenset(w for t in templates for w in template_words(t.text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for b in batches:
            for text in texts_of(b.column(0)):
                counts.update(vocabulary.intersection(text.translate(FOLD).split()))
        yield batch({"token": (list(counts), pa.binary()), "n": (list(counts.values()), pa.int64())})

    rows = map_arrow(docs.select(col(text_column)), run, "token binary, n bigint")
    return {bytes(r.token): r.n for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()}


class TemplateIndex:
    """Finds the templates that some run of a text's words contains to the threshold.

    Template words have one global order, rare ones first. A template of n words of which k must be found
    shows one of its first n - k + 1 in every text with a matching run (prefix). A text needs k template
    words at all (length). Where both have the same word for the first time, the words after it on the
    shorter side must still suffice (position). Only for what is left are the runs gone through.
    """

    def __init__(self, templates: Sequence[Template], frequency: Mapping[bytes, int], threshold: float):
        sets = {t: frozenset(template_words(t.text)) for t in templates}
        sets = {t: s for t, s in sets.items() if s}
        order = sorted(frozenset().union(*sets.values()), key=lambda t: (frequency.get(t, 0), t))
        self.rank = {token: i for i, token in enumerate(order)}
        self.sets = {t: frozenset(self.rank[w] for w in words) for t, words in sets.items()}
        self.need = {t: needed(len(s), threshold) for t, s in self.sets.items()}
        self.window = {t: run_length(t.text) for t in sets}
        self.all_of = {t: frozenset(w.encode() for w in t.needs) for t in sets}
        self.none_of = {t: frozenset(w.encode() for w in t.without) for t in sets}
        self.prefixes: dict[int, list[tuple[Template, int]]] = {}
        for t, ranks in self.sets.items():
            for place, rank in enumerate(sorted(ranks)[: len(ranks) - self.need[t] + 1]):
                self.prefixes.setdefault(rank, []).append((t, place))
        self.openers = frozenset(order[rank] for rank in self.prefixes)

    def candidates(self, held: frozenset[bytes] | set[bytes]) -> list[Template]:
        """Templates of whose distinct words a text has enough, and all that are needed."""
        block = sorted(self.rank[w] for w in held if w in self.rank)
        found: list[Template] = []
        seen: set[Template] = set()
        for j, rank in enumerate(block):
            for t, i in self.prefixes.get(rank, ()):
                if t in seen:
                    continue
                seen.add(t)
                ranks, need = self.sets[t], self.need[t]
                if len(block) < need or min(len(ranks) - i, len(block) - j) < need:
                    continue
                if self.all_of[t] <= held and len(ranks.intersection(block)) >= need:
                    found.append(t)
        return found

    def match(self, words: list[bytes]) -> list[tuple[int, Template, float]]:
        """First word, template and containment of the best run of each template that has one, the first
        of equals. A run begins and ends with a word of the template."""
        found = []
        places: dict[bytes, list[int]] = {}
        held = set(words)
        for t in self.candidates(held):
            wanted = template_words(t.text)
            for w in {*wanted, *self.none_of[t]} & held - places.keys():
                places[w] = [i for i, x in enumerate(words) if x == w]
            events = sorted((i, w) for w in {*wanted, *self.none_of[t]} & held for i in places[w])
            best = self._best_run(t, events)
            if best:
                found.append((best[0], t, best[1]))
        return sorted(found, key=lambda x: (x[0], x[1].name))

    def _best_run(self, t: Template, events: list[tuple[int, bytes]]) -> tuple[int, float] | None:
        size, need, window = len(self.sets[t]), self.need[t], self.window[t]
        inside: Counter[bytes] = Counter()
        run: deque[tuple[int, bytes]] = deque()
        best: tuple[int, float] | None = None
        for place, word in events:
            if word in self.none_of[t]:
                inside.clear()
                run.clear()
                continue
            run.append((place, word))
            inside[word] += 1
            while place - run[0][0] >= window:
                gone = run.popleft()[1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
            if len(inside) >= need and len(inside) / size > (best[1] if best else 0.0) and self.all_of[t] <= inside.keys():
                best = run[0][0], len(inside) / size
        return best


def _phrase_places(words: list[bytes], phrases: list[tuple[bytes, str]]) -> tuple[list[int], set[str]]:
    line = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    for phrase, label in phrases:
        at = line.find(phrase)
        while at >= 0:
            places.append(line.count(b" ", 0, at))
            labels.add(label)
            at = line.find(phrase, at + 1)
    return places, labels


SCAN = (
    "doc_id bigint, n_words bigint, places array<bigint>, base_labels array<string>, "
    "blocks array<struct<first_word:bigint,name:string,label:string,containment:double>>"
)
_BLOCKS = pa.list_(
    pa.struct([("first_word", pa.int64()), ("name", pa.string()), ("label", pa.string()), ("containment", pa.float64())])
)


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Licence phrases and template matches: ``doc_id, n_words, places, base_labels, blocks``.

    Words are ``fold_words`` of the whole text. ``places`` are the word numbers where a phrase begins, in
    ascending order. ``blocks`` has an entry for the best run of each template that has one: consecutive
    words, inside a line or across lines, at most a quarter more than the template's (see ``run_length``),
    with ``threshold`` or more of its distinct words, all that it needs, and none that it must not have.
    Templates without a word never match. Word frequencies are counted over all documents first; they
    decide the order of work, never the result. ``id_column`` must be a whole number. Null or empty text has
    no words and no match; repeated rows and null ids give a row each; an empty table gives none; other
    columns are not looked at. A text of any length is one row of one task, which holds its words.
    """
    index = TemplateIndex(templates, token_frequencies(docs, templates, text_column), threshold)
    wanted = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, places, labels, blocks = [], [], [], []
            for text in texts_of(b.column(1)):
                words = text.translate(FOLD).split()
                at, base = _phrase_places(words, wanted)
                found = [] if index.openers.isdisjoint(words) else index.match(words)
                counts.append(len(words))
                places.append(sorted(at))
                labels.append(sorted(base))
                blocks.append(
                    [{"first_word": i, "name": t.name, "label": t.label, "containment": share} for i, t, share in found]
                )
            yield batch(
                {
                    "doc_id": (b.column(0), pa.int64()),
                    "n_words": (counts, pa.int64()),
                    "places": (places, pa.list_(pa.int64())),
                    "base_labels": (labels, pa.list_(pa.string())),
                    "blocks": (blocks, _BLOCKS),
                }
            )

    return map_arrow(docs.select(col(id_column).cast("bigint"), col(text_column)), run, SCAN)


def license_report(docs: DataFrame, **options) -> DataFrame:
    """Per document ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``. The
    score is 1 with a phrase, else the largest containment of a template, else 0."""
    found = scan_licenses(docs, **options)
    best = F.coalesce(F.array_max(F.transform("blocks", lambda x: x["containment"])), F.lit(0.0))
    every = F.array_distinct(F.concat("base_labels", F.transform("blocks", lambda x: x["label"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
