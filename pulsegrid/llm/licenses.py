"""License scan: exact set-similarity join of text blocks with license templates, by containment.

Blocks are lines and, across line breaks, windows of the whole text's words, as licenses stand wrapped in files. Templates are
sorted into classes by length; the windows of a class have twice as many words as its longest template and overlap by half, so any
template, wrapped in any way, lies whole in one. A block meets a template when it holds at least THRESHOLD of the template's
distinct words, among them all that tell it from others (a license's name or version). Tokens are ordered by their frequency
over all documents, rarest first. The least overlap a is ceil(THRESHOLD * size), so one of a template's first size - a + 1
tokens must be in a fitting block (prefix filter); blocks of fewer than a tokens can't fit (length filter); and the tokens that
both sides still have after a shared one must suffice (positional filter). What passes is verified. Templates are a parameter
of bounded size and their index is broadcast; documents never move.

Base phrases are places where given words stand one after the other, apart from the join.

Defined results: null and empty texts have no words and no labels, null places and a score of zero. Rows are scanned one by one:
repeated rows alike, also those without a doc_id, and an empty table gives none. Templates of equal containment tie and are all
reported. A very long text takes time in proportion to its words. Columns other than doc_id and the text are not looked at.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, only

#: Words of the shortest class of windows.
WINDOW, THRESHOLD = 16, 0.8
_WORD = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

#: Phrases of the base scan and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: A label, words that must be (or, after a minus, must not be) in the block, and the text. Statements by which works are put under a license,
#: and the grants of the licenses themselves, as published.
TEMPLATES = [
    ("mit", "mit", "Released under the MIT License."),
    ("mit", "sublicense software", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "charge obtaining", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache-2", "apache 2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "apache 2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("cc-by-nc", "by nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "creative attribution -noncommercial -sharealike", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "cc0", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal."),
    ("gpl-3", "gnu general 3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2", "gnu general 2", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl", "gnu general -lesser", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl-3", "gnu general 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2", "gnu general 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "lesser", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "redistribution binary", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "redistribution binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "permission fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", "mozilla 2", "Licensed under the Mozilla Public License, Version 2.0."),
    ("mpl-2", "mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "unencumbered", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "warranty damages", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
]


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased; words of digits, letters and everything beyond ASCII."""
    return text.encode().lower().translate(_WORD).split()


def window_of(template: str) -> int:
    """Words of the windows for a template: at least twice its own, so that half a window holds it; a power of two, so that
    templates share windows."""
    need = max(WINDOW, 2 * len(words_of(template)))
    return 1 << (need - 1).bit_length()


def windows(words: list[bytes], window: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first word's number, words) of windows that overlap by half."""
    for k in range(0, max(1, len(words) - window // 2), window // 2):
        if words[k : k + window]:
            yield k, words[k : k + window]


def blocks(text: str, sizes: Sequence[int] = (WINDOW,)) -> Iterator[tuple[int, int, list[bytes]]]:
    """(window's class, first word's number, words) of each block; a window of the text that is a block of a line comes once."""
    lines = [words_of(line) for line in text.split("\n")]
    words = [w for line in lines for w in line]
    for size in sizes:
        at, seen = 0, set()
        for line in lines:
            for k, block in windows(line, size):
                seen.add((at + k, len(block)))
                yield size, at + k, block
            at += len(line)
        for k, block in windows(words, size):
            if (k, len(block)) not in seen:
                yield size, k, block


def token_frequencies(docs: DataFrame, vocabulary: Sequence[bytes], text: str = "text") -> DataFrame:
    """(token, n): documents of the whole corpus that hold a template's token; one row a token."""
    wanted = frozenset(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = defaultdict(int)
        for _, texts in chunks(batches, text):
            for t in texts:
                for w in wanted.intersection(words_of(t)):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    return only(docs, text).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Index:
    """Templates as sorted token lists, and the tokens of their prefixes for each class of windows."""

    def __init__(self, templates: Sequence[tuple[str, str, str]], frequency: dict[bytes, int], threshold: float):
        known = {w for _, _, t in templates for w in words_of(t)}
        self.order = {w: i for i, w in enumerate(sorted(known, key=lambda w: (frequency.get(w, 0), w)))}
        self.labels = [label for label, _, _ in templates]
        split = [need.split() for _, need, _ in templates]
        self.needed = [frozenset(self.order[w.encode()] for w in own if w[0] != "-") for own in split]
        self.barred = [frozenset(self.order[w[1:].encode()] for w in own if w[0] == "-") for own in split]
        self.tokens = [sorted({self.order[w] for w in words_of(t)}) for _, _, t in templates]
        self.least = [math.ceil(threshold * len(t) - 1e-9) for t in self.tokens]
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (tokens, least, (_, _, text)) in enumerate(zip(self.tokens, self.least, templates)):
            for place, token in enumerate(tokens[: len(tokens) - least + 1]):
                self.prefix[window_of(text)][token].append((k, place))
        self.prefix = {size: dict(own) for size, own in sorted(self.prefix.items())}
        self.shortest = {size: min(self.least[k] for places in own.values() for k, _ in places) for size, own in self.prefix.items()}
        names = {i: w for w, i in self.order.items()}
        self.first_words = {size: frozenset(names[i] for i in own) for size, own in self.prefix.items()}

    def sizes(self, words: set[bytes]) -> list[int]:
        """The classes of windows of which a text can meet a template."""
        return [size for size, first in self.first_words.items() if not first.isdisjoint(words)]

    def matches(self, size: int, words: list[bytes]) -> dict[int, float]:
        """The templates of a class that a block meets, and how much of each it contains."""
        if self.first_words[size].isdisjoint(words):
            return {}
        have = sorted({self.order[w] for w in words if w in self.order})
        passed: set[int] = set()
        for i, token in enumerate(have[: max(0, len(have) - self.shortest[size] + 1)]):
            for k, place in self.prefix[size].get(token, ()):
                most = min(i, place) + min(len(have) - i, len(self.tokens[k]) - place)
                if len(have) >= self.least[k] and most >= self.least[k]:
                    passed.add(k)
        own = set(have)
        shared = {k: sum(t in own for t in self.tokens[k]) for k in passed if self.needed[k] <= own and self.barred[k].isdisjoint(own)}
        return {k: n / len(self.tokens[k]) for k, n in shared.items() if n >= self.least[k]}


def phrase_places(words: list[bytes], phrases: Sequence[tuple[bytes, str]]) -> list[tuple[int, str]]:
    """(first word's number, label) wherever a phrase's words stand one after the other."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases:
        at, counted, number = joined.find(phrase), 0, 0
        while at >= 0:
            number += joined.count(b" ", counted, at)
            counted = at
            found.append((number, label))
            at = joined.find(phrase, at + 1)
    return found


SCHEMA = "doc_id long, n_words long, places array<struct<word:long,label:string>>, matches array<struct<label:string,word:long,n_words:long,containment:double>>"


def scan(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """(doc_id, n_words, places of base phrases, matches of blocks with templates) of every row."""
    known = sorted({w for _, _, t in templates for w in words_of(t)})
    frequency = {r["token"].encode(): r["n"] for r in token_frequencies(docs, known, text).collect()}  # a row a template token
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, frequency, threshold))
    sought = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases]
    needed = [frozenset(words_of(p)) for p, _ in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch, texts in chunks(batches, text):
            sizes, places, matches = [], [], []
            for t in texts:
                words = words_of(t)
                sizes.append(len(words))
                there = set(words)
                hits = phrase_places(words, sought) if any(n <= there for n in needed) else []
                places.append([{"word": a, "label": b} for a, b in hits])
                sizes_here = own.sizes(there)
                met = [(k, at, len(b), c) for size, at, b in blocks(t, sizes_here) for k, c in own.matches(size, b).items()] if sizes_here else []
                matches.append([{"label": own.labels[k], "word": at, "n_words": n, "containment": c} for k, at, n, c in met])
            place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
            match = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(places, place), pa.array(matches, match)], names=["doc_id", "n_words", "places", "matches"])

    return only(docs, "doc_id", text).mapInArrow(run, SCHEMA)
