"""License scans: templates with markup, compiled into automata over words.

A template is license wording in which ``<<beginOptional>> ... <<endOptional>>``
encloses words that may be missing (regions nest) and ``<<var;match=...>>`` stands for words
that may be replaced: ``match=0-12`` by any so many words, ``match=a b|c`` by one of the
alternatives. All other words are mandatory, in this order, with nothing between
them; case, marks and white space do not count. A template becomes a
nondeterministic automaton over words, then a deterministic table of (state, word), and
the tables of all templates are one. A task turns a text into numbers of known words (0
for any other) and runs the table from every word that can start a template, all
starts at once; what it accepts is a place. A place is only kept if its known words
are right byte by byte.

``base`` templates are plain phrases: each of their places counts, overlapping ones too. Of
other templates a place inside an earlier one of the same template is left out. A
label's strength is m / (m + 4) with m the fewest words its template accepts; a text's score
is the greatest strength it has, 0 without any.

Defined cases: a null text is empty; without words all counts are 0, labels are the
empty string, first_word and last_word null, score 0; rows are scanned one by one, so null or repeated
ids and repeated rows stay as they are; very long texts are scanned whole; extra columns are
ignored; a template that accepts no word, or starts with a region of any words, is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import Roll, mix, slices, text_bytes, whole_text


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False


# Phrases whose places are counted, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_OPT, _END = "<<beginOptional>>", "<<endOptional>>"
_VERSION = "<<var;match=1|2|3|4>> <<var;match=0|1|5>>"


def _optional(text: str) -> str:
    return f"{_OPT}{text}{_END}"


# Names by which texts refer to a license, after "licensed under the" and the like.
NAMES = {
    "mit": ("MIT License", "MIT", "Expat License"),
    "apache-2": (f"Apache {_optional('Software')} License {_optional('version')} <<var;match=2|v2>>", "Apache <<var;match=2|v2>>"),
    "bsd-2": ("BSD 2 clause", "2 clause BSD", "simplified BSD"),
    "bsd-3": ("BSD 3 clause", "3 clause BSD", "<<var;match=new|revised|modified>> BSD"),
    "isc": ("ISC License",),
    "mpl-2": ("Mozilla Public License <<var;match=version 2|v 2|v2|2>>", "MPL <<var;match=2|v2>>"),
    "gpl-2": (f"{_optional('GNU')} <<var;match=GPLv2|GPL 2|GPL v2|GPL version 2>>", "GNU General Public License <<var;match=version 2|v 2|v2|2>>"),
    "gpl-3": (f"{_optional('GNU')} <<var;match=GPLv3|GPL 3|GPL v3|GPL version 3>>", "GNU General Public License <<var;match=version 3|v 3|v3|3>>"),
    "lgpl-3": (f"{_optional('GNU')} <<var;match=LGPLv3|LGPL 3|LGPL v3|LGPL version 3>>", "GNU Lesser General Public License <<var;match=version 3|v 3|v3|3>>"),
    "agpl-3": (f"{_optional('GNU')} <<var;match=AGPLv3|AGPL 3|AGPL v3|AGPL version 3>>", "GNU Affero General Public License <<var;match=version 3|v 3|v3|3>>"),
    "cc0": ("CC0", "Creative Commons Zero"),
    "cc-by": (f"CC BY {_VERSION}", f"Creative Commons Attribution {_VERSION}"),
    "cc-by-sa": (f"CC BY SA {_optional(_VERSION)}", "Creative Commons Attribution <<var;match=ShareAlike|Share Alike>>"),
    "cc-by-nd": (f"CC BY ND {_optional(_VERSION)}", "Creative Commons Attribution <<var;match=NoDerivatives|NoDerivs|No Derivatives>>"),
    "cc-by-nc": (f"CC BY NC {_VERSION}", f"Creative Commons Attribution <<var;match=NonCommercial|Non Commercial>> {_VERSION}"),
    "cc-by-nc-sa": ("CC BY NC SA", "Creative Commons Attribution <<var;match=NonCommercial|Non Commercial>> <<var;match=ShareAlike|Share Alike>>"),
    "cc-by-nc-nd": ("CC BY NC ND", "Creative Commons Attribution <<var;match=NonCommercial|Non Commercial>> <<var;match=NoDerivatives|NoDerivs|No Derivatives>>"),
}
# Identifiers after "SPDX-License-Identifier:".
IDENTIFIERS = {
    "mit": "MIT", "apache-2": "Apache 2 0", "bsd-2": "BSD 2 Clause", "bsd-3": "BSD 3 Clause", "isc": "ISC", "mpl-2": "MPL 2 0",
    "gpl-2": "GPL 2 0", "gpl-3": "GPL 3 0", "lgpl-3": "LGPL 3 0", "agpl-3": "AGPL 3 0", "cc0": "CC0 1 0", "unlicense": "Unlicense",
}
_VERBS = "<<var;name=verb;match=licensed|released|distributed|published|available|provided|shared|used|redistributed>>"
_NOTICE = f"<<var;match=This program|This software|This library|{{0}}>> is free software {_optional('<<var;match=0-2>>')} you can redistribute it and or modify it under the terms of the"
_LATER = f"as published by the Free Software Foundation <<var;match=either version {{0}} of the License or at your option any later version|version {{0}} of the License|version {{0}}>>"
_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. <<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_THIRD = """<<beginOptional>>3<<endOptional>> Neither the name of <<var;match=1-20>> nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;match=1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
# Wording of licenses and of the notices that grant them.
WORDINGS = (
    ("mit", f"""{_optional('<<var;match=The MIT License|MIT License>>')} {_optional('MIT')} {_optional('Copyright <<var;match=0-12>>')}
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
so, subject to the following conditions: The above copyright notice and this permission notice {_optional('including the next paragraph')}
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL <<var;match=1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", f"""Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd-2", f"{_CONDITIONS} {_DISCLAIMER}"),
    ("bsd-3", f"{_CONDITIONS} {_THIRD} {_DISCLAIMER}"),
    ("apache-2", f"""Licensed under the Apache License, Version 2.0 {_optional('the "License"')} you may not use this file except in compliance
with the License. You may obtain a copy of the License at <<var;match=1-10>> Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied."""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at"""),
    ("gpl-2", f"{_NOTICE.format('It')} GNU General Public License {_LATER.format(2)}"),
    ("gpl-3", f"{_NOTICE.format('It')} GNU General Public License {_LATER.format(3)}"),
    ("lgpl-3", f"{_NOTICE.format('It')} GNU Lesser General Public License {_LATER.format(3)}"),
    ("agpl-3", f"{_NOTICE.format('It')} GNU Affero General Public License {_LATER.format(3)}"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""),
)


def _built_in() -> tuple[Template, ...]:
    out = [Template(label, text, base=True) for text, label in PHRASES]
    out += [Template(label, text) for label, text in WORDINGS]
    under = f"{_VERBS} under {_optional('the terms of')} {_optional('<<var;match=the|a|an>>')}"
    out += [Template(label, f"{under} {name}") for label, names in NAMES.items() for name in names]
    out += [Template(label, f"SPDX License Identifier {name}") for label, name in IDENTIFIERS.items()]
    return tuple(out)


# ---- markup ---------------------------------------------------------------------

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


@dataclass(frozen=True)
class Any:
    """Between ``least`` and ``most`` words of any kind."""

    least: int
    most: int


@dataclass(frozen=True)
class Choice:
    """One of several sequences."""

    ways: tuple[tuple, ...]


def _replaceable(options: str) -> Any | Choice:
    settings = dict(part.split("=", 1) for part in options.split(";") if "=" in part)
    match = settings["match"]
    if span := re.fullmatch(r"(\d+)-(\d+)", match):
        return Any(int(span[1]), int(span[2]))
    return Choice(tuple(tuple(words_of(way)) for way in match.split("|")))


def parse(text: str) -> tuple:
    """Markup as a sequence of words, ``Any`` and ``Choice``; an optional region is a choice with nothing."""
    open_regions: list[list] = [[]]
    for mark, plain in re.findall(r"<<(.*?)>>|((?:(?!<<).)+)", text, re.S):
        if mark.startswith("beginOptional"):
            open_regions.append([])
        elif mark.startswith("endOptional"):
            if len(open_regions) < 2:
                raise ValueError("endOptional without beginOptional")
            region = tuple(open_regions.pop())
            open_regions[-1].append(Choice((region, ())))
        elif mark.startswith("var"):
            open_regions[-1].append(_replaceable(mark))
        elif mark:
            raise ValueError(f"unknown markup {mark!r}")
        else:
            open_regions[-1].extend(words_of(plain))
    if len(open_regions) != 1:
        raise ValueError("beginOptional without endOptional")
    return tuple(open_regions[0])


def fewest(items: Sequence) -> int:
    """Words of the shortest text the sequence accepts."""
    total = 0
    for item in items:
        total += item.least if isinstance(item, Any) else min(map(fewest, item.ways)) if isinstance(item, Choice) else 1
    return total


def regex(items: Sequence) -> str:
    """The same wording as an expression over words that are each followed by a space."""
    out = ""
    for item in items:
        if isinstance(item, Any):
            out += f"(?:[^ ]+ ){{{item.least},{item.most}}}"
        elif isinstance(item, Choice):
            out += "(?:" + "|".join(map(regex, item.ways)) + ")"
        else:
            out += f"{item} "
    return out


def strength(template: Template) -> float:
    m = fewest(parse(template.text))
    return m / (m + 4)


# ---- automata -------------------------------------------------------------------


class Wording:
    """Nondeterministic automaton of one template: moves by a word (None for any) and free moves."""

    def __init__(self, items: Sequence):
        self.moves: list[list[tuple[str | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.end = self._sequence(items, 0)

    def _state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _step(self, at: int, word: str | None) -> int:
        to = self._state()
        self.moves[at].append((word, to))
        return to

    def _sequence(self, items: Sequence, at: int) -> int:
        for item in items:
            if isinstance(item, Any):
                for _ in range(item.least):
                    at = self._step(at, None)
                skip = [at]
                for _ in range(item.most - item.least):
                    skip.append(at := self._step(at, None))
                at = self._state()
                for s in skip:
                    self.free[s].append(at)
            elif isinstance(item, Choice):
                ends = [self._sequence(way, at) for way in item.ways]
                at = self._state()
                for s in ends:
                    self.free[s].append(at)
            else:
                at = self._step(at, item)
        return at

    def closure(self, states) -> frozenset[int]:
        seen = set(states)
        todo = list(seen)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def table(self) -> tuple[list[dict[str | None, int]], list[bool]]:
        """Deterministic states, the first being the start: next state by word (None: any other word), and which accept."""
        numbers = {self.closure([0]): 0}
        order, rows = list(numbers), []
        for states in order:
            moves = [m for s in states for m in self.moves[s]]
            row = {}
            for word in {w for w, _ in moves}:
                to = self.closure(t for w, t in moves if w is None or w == word)
                if to not in numbers:
                    numbers[to] = len(numbers)
                    order.append(to)
                row[word] = numbers[to]
            rows.append(row)
        return rows, [self.end in states for states in order]


class Automaton:
    """All templates in one table. State 0 is dead; words are numbered from 1, 0 is any other word."""

    def __init__(self, templates: Sequence[Template]):
        tables = []
        for t in templates:
            rows, accepts = Wording(parse(t.text)).table()
            if accepts[0] or None in rows[0] or not rows[0]:
                raise ValueError(f"a template must start with a given word: {t.text[:60]!r}")
            tables.append((rows, accepts))
        self.words = sorted({w for rows, _ in tables for row in rows for w in row if w is not None})
        number = {w: i for i, w in enumerate(self.words, 1)}
        size = 1 + sum(len(rows) for rows, _ in tables)
        self.next = np.zeros((size, len(number) + 1), np.int32)
        self.accepts = np.zeros(size, bool)
        self.template = np.full(size, -1, np.int32)
        starts: list[list[int]] = [[] for _ in range(len(number) + 1)]
        offset = 1
        for k, (rows, accepts) in enumerate(tables):
            for i, row in enumerate(rows):
                here = offset + i
                self.next[here] = offset + row[None] if None in row else 0
                for w, to in row.items():
                    if w is not None:
                        self.next[here, number[w]] = offset + to
            for w, to in rows[0].items():
                starts[number[w]].append(offset + to)
            self.accepts[offset : offset + len(rows)] = accepts
            self.template[offset : offset + len(rows)] = k
            offset += len(rows)
        self.n_starts = np.array([len(s) for s in starts])
        self.first_start = np.cumsum(self.n_starts) - self.n_starts
        self.starts = np.array([s for several in starts for s in several], np.int32)
        self.base = np.array([t.base for t in templates])

    def run(self, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, first token, one past the last token) of the longest text accepted from each start.

        ``ends`` has for each token one past the last token of its text.
        """
        counts = self.n_starts[tokens]
        at = np.repeat(np.arange(len(tokens)), counts)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        state = self.starts[self.first_start[tokens[at]] + inside]
        template, start, found = self.template[state], at, np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        while len(live):
            done = self.accepts[state]
            found[live[done]] = at[done] + 1
            at = at + 1
            more = at < ends[at - 1]
            live, at, state = live[more], at[more], state[more]
            state = self.next[state, tokens[at]]
            alive = state > 0
            live, at, state = live[alive], at[alive], state[alive]
        hit = found > 0
        return template[hit], start[hit], found[hit]


_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of the first word of each row, n + 1 long) of words of letters, digits and other than ASCII."""
    inside = _INSIDE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


class Scanner:
    """Places of the templates in the texts of a record batch."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.roll = automaton, Roll(fold_case=True)
        words = [w.encode() for w in automaton.words]
        self.words = [b"", *words]
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        keys = self._keys(data, ends - [len(w) for w in words], ends)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def _keys(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self.roll.load(data)
        return mix(self.roll.spans(starts, ends) + (ends - starts).astype(np.uint64))

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words per row; and of every place its row, template, first word and one past the last, counted in the row)."""
        data, offsets = text_bytes(texts)
        starts, ends, bounds = _word_spans(data, offsets) if len(data) else (*[np.zeros(0, np.int64)] * 2, np.zeros(len(offsets), np.int64))
        n_words = np.diff(bounds)
        none = np.zeros(0, np.int64)
        if not len(starts):
            return n_words, none, none, none, none
        keys = self._keys(data, starts, ends)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        tokens = np.where(self.keys[place] == keys, self.order[place] + 1, 0)
        template, first, stop = self.automaton.run(tokens, np.repeat(bounds[1:], n_words))
        keep = np.array([self._right(data, starts[a:b], ends[a:b], tokens[a:b]) for a, b in zip(first, stop, strict=True)], dtype=bool)
        template, first, stop = template[keep], first[keep], stop[keep]
        order = np.lexsort((first, template))
        template, first, stop = template[order], first[order], stop[order]
        # One past the furthest word so far of the same template; a place that does not pass it lies inside.
        reach = np.maximum.accumulate(template.astype(np.int64) * (len(starts) + 1) + stop) if len(stop) else none
        outer = np.ones(len(stop), bool)
        outer[1:] = (template[1:] != template[:-1]) | (template[1:].astype(np.int64) * (len(starts) + 1) + stop[1:] > reach[:-1])
        keep = outer | self.automaton.base[template]
        template, first, stop = template[keep], first[keep], stop[keep]
        row = np.searchsorted(bounds, first, side="right") - 1
        order = np.lexsort((template, first, row))
        shift = bounds[row]
        return n_words, row[order], template[order], (first - shift)[order], (stop - shift)[order]

    def _right(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tokens: np.ndarray) -> bool:
        return all(
            not t or data[a:b].tobytes().lower() == self.words[t]
            for a, b, t in zip(starts.tolist(), ends.tolist(), tokens.tolist(), strict=True)
        )


_PLACE = "struct<template: int, first: bigint, stop: bigint>"


def scan(docs: DataFrame, templates: Sequence[Template] | None = None) -> DataFrame:
    """(doc_id, n_words, places) of every row; a place has template, label, base, strength, first, stop and whole.

    ``first`` and ``stop`` are the place's first word and one past its last; ``whole`` says that it is the whole text.
    """
    templates = TEMPLATES if templates is None else tuple(templates)
    automaton = Automaton(templates)
    rows = docs.select("doc_id", whole_text(docs).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(automaton)
        for batch in slices(batches, "text"):
            n_words, row, template, first, stop = scanner.scan(batch.column("text"))
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            fields = [pa.array(template, pa.int32()), pa.array(first, pa.int64()), pa.array(stop, pa.int64())]
            places = pa.StructArray.from_arrays(fields, names=["template", "first", "stop"])
            lists = pa.ListArray.from_arrays(pa.array(offsets), places)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), lists], names=["doc_id", "n_words", "_places"]
            )

    found = rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, _places array<{_PLACE}>")
    about = F.array(
        *[F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(strength(t)).alias("strength")) for t in templates]
    )
    named = F.transform(
        "_places",
        lambda p: F.struct(
            p["template"].alias("template"),
            *[F.get(about, p["template"])[c].alias(c) for c in ("label", "base", "strength")],
            p["first"].alias("first"), p["stop"].alias("stop"),
            ((p["first"] == 0) & (p["stop"] == F.col("n_words"))).alias("whole"),
        ),
    )
    return found.select("doc_id", "n_words", named.alias("places"))


TEMPLATES = _built_in()


def digest(docs: DataFrame) -> DataFrame:
    listed = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    found = scan(docs).withColumn("_base", F.filter("places", lambda p: p["base"]))
    starts = F.transform("_base", lambda p: p["first"])
    return found.select(
        "doc_id", "n_words", F.size("_base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed("_base").alias("base_labels"), listed("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["strength"])), F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    """The templates as expressions over the joined words."""
    plain = "abcdefghijklmnopqrstuvwxyz"
    starts, names = [], []
    for k, (phrase, label) in enumerate(PHRASES):
        n = len(phrase.split())
        same = " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(phrase.split(), 1))
        starts.append(f"list_filter(range(0, n_words - {n - 1}), lambda i: {same}) AS s{k}")
        names.append(f"CASE WHEN len(s{k}) > 0 THEN '{label}' END")
    hits = [
        f"CASE WHEN regexp_matches(t, ' {regex(parse(t.text))}') THEN {{'label': '{t.label}', 'strength': {strength(t)!r}::DOUBLE}} END"
        for t in TEMPLATES
    ]
    every = " || ".join(f"s{k}" for k in range(len(PHRASES)))
    tidy = lambda x: f"coalesce(array_to_string(list_sort(list_distinct({x})), ','), '')"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{plain.upper()}', '{plain}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT doc_id, w, len(w)::BIGINT AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d),
f AS (SELECT doc_id, n_words, {', '.join(starts)}, list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL) AS hits FROM e)
SELECT doc_id, n_words, len({every})::BIGINT AS n_base, list_min({every}) AS first_word, list_max({every}) AS last_word,
  {tidy(f"list_filter([{', '.join(names)}], lambda x: x IS NOT NULL)")} AS base_labels,
  {tidy("list_transform(hits, lambda x: x.label)")} AS labels, coalesce(list_max(list_transform(hits, lambda x: x.strength)), 0.0) AS score
FROM f"""


ORACLE = _oracle()
