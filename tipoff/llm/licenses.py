"""Licence notices by templates: optional and replaceable regions, compiled to one automaton.

A template is a line of words. `[[ ... ]]` may be absent, `{{name|a-b}}` stands for a to b words
of any kind (a holder's name); all else is mandatory and has to stand there word for word. The
templates become one nondeterministic automaton over words, whose sets of states are made into
states of a table as texts lead to them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import kept

#: Phrases and labels that every scan has (fixed values).
BASE = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))

#: Wording of public licences and their notices, as templates (fixed values).
TEMPLATES = (
    ("gpl-2.0", "[[under the terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[0]] [[of the license]] [[or at your option any later version]]"),
    ("gpl-3.0", "[[under the terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[0]] [[of the license]] [[or at your option any later version]]"),
    ("apache-2.0", "licensed under the apache license version 2 0 [[the license you may not use this file except in compliance with the license]]"),
    ("cc-by-4.0", "licensed under {{article|0-1}} cc by 4 0 [[international]] [[license]]"),
    ("cc-by-sa-4.0", "licensed under {{article|0-1}} cc by sa 4 0 [[international]] [[license]]"),
    ("cc-by-nc-4.0", "licensed under {{article|0-1}} cc by nc 4 0 [[international]] [[license]]"),
    ("cc-by-4.0", "creative commons attribution 4 0 international [[public]] license"),
    ("mit-notice", "[[copyright {{holders|1-8}}]] {{verb|1-1}} under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{holders|1-12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc-text", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "[[3]] neither the name of {{holder|1-12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
)

#: Bytes that are no part of a word become blanks; A-Z become a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: States of the table before it is made anew; texts made to reach many cannot fill a worker.
STATES = 20_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def parse(markup: str) -> list:
    """The template as a list of words, ("opt", list) and ("any", least, most)."""
    stack: list[list] = [[]]
    for opens, closes, least, most, word in re.findall(r"(\[\[)|(\]\])|\{\{[^|}]*\|(\d+)-(\d+)\}\}|([^\s\[\]{}]+)", markup):
        if opens:
            stack.append([])
        elif closes:
            inner = stack.pop()
            stack[-1].append(("opt", inner))
        elif most:
            stack[-1].append(("any", int(least), int(most)))
        else:
            stack[-1].append(word.encode())
    if len(stack) != 1:
        raise ValueError(f"regions that don't close: {markup}")
    return stack[0]


def mirrored(items: list) -> list:
    return [("opt", mirrored(x[1])) if x[0] == "opt" else x for x in reversed(items)]


def longest(items: list) -> int:
    """Words of the longest text that the items accept."""
    return sum(longest(x[1]) if x[0] == "opt" else x[2] if x[0] == "any" else 1 for x in items)


class Automaton:
    """Several templates over words. States of the table are sets of states of the templates;
    with `anywhere`, a template may begin at every word."""

    def __init__(self, templates: list[list], anywhere: bool):
        self.moves: list[list] = []  # of a template's state: (word or None for any, next)
        self.skips: list[list] = []  # next without a word
        self.ends: dict[int, int] = {}
        starts = []
        for k, items in enumerate(templates):
            first = self._state()
            self.ends[self._add(items, first)] = k
            starts.append(first)
        self.anywhere = anywhere
        self.start = self._closed(starts)
        self._clear()

    def _state(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def _add(self, items: list, at: int) -> int:
        """Adds the states that lead from `at` through the items; the last of them."""
        for item in items:
            if item[0] == "opt":
                past = self._add(item[1], at)
                self.skips[at].append(past)
                at = past
            elif item[0] == "any":
                chain = [at]
                for _ in range(item[2]):
                    chain.append(self._state())
                    self.moves[chain[-2]].append((None, chain[-1]))
                at = self._state()
                for s in chain[item[1] :]:
                    self.skips[s].append(at)
            else:
                following = self._state()
                self.moves[at].append((item, following))
                at = following
        return at

    def _closed(self, states) -> frozenset:
        out, todo = set(states), list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def _clear(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.rows: list[dict | None] = []
        self.other: list[int] = []
        self.found: list[tuple] = []
        self._number(self.start)

    def _number(self, states: frozenset) -> int:
        at = self.number.get(states)
        if at is None:
            at = self.number[states] = len(self.sets)
            self.sets.append(states)
            self.rows.append(None)
            self.other.append(-1)
            self.found.append(tuple(sorted({self.ends[s] for s in states if s in self.ends})))
        return at

    def _fill(self, at: int) -> dict:
        by: dict = {None: set()}
        for s in self.sets[at]:
            for word, following in self.moves[s]:
                by.setdefault(word, set()).add(following)
        begin = self.start if self.anywhere else frozenset()
        row = {w: self._number(self._closed(to | by[None]) | begin) for w, to in by.items() if w is not None}
        self.other[at] = self._number(self._closed(by[None]) | begin)
        self.rows[at] = row
        return row

    def hits(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(place of the last word, template) for every place where a template is accepted."""
        out, at = [], self._number(self.start)
        rows, other, found = self.rows, self.other, self.found
        for k, word in enumerate(words):
            row = rows[at]
            if row is None:
                if len(self.sets) > STATES:
                    held = self.sets[at]
                    self._clear()
                    at, rows, other, found = self._number(held), self.rows, self.other, self.found
                row = self._fill(at)
            at = row.get(word, other[at])
            if found[at]:
                out += [(k, t) for t in found[at]]
            if not self.anywhere and not self.sets[at]:
                break
        return out


@dataclass
class Scanner:
    """Places of the templates in a text: for each last word, the longest one that ends there."""

    labels: list[str]
    base: int
    whole: Automaton
    backwards: list[Automaton]
    most: list[int]
    fixed: list[bool]

    @classmethod
    def of(cls, base, templates) -> Scanner:
        parsed = [parse(m) for _, m in (*base, *templates)]
        fixed = [all(isinstance(x, bytes) for x in p) for p in parsed]
        return cls([x for x, _ in (*base, *templates)], len(base), Automaton(parsed, True), [Automaton([mirrored(p)], False) for p in parsed], [longest(p) for p in parsed], fixed)

    def scan(self, text: str) -> tuple[int, int, list[tuple[int, int, int]]]:
        """Number of words, words that places cover, and places (template, first, last word)."""
        words = words_of(text)
        places = []
        for end, t in self.whole.hits(words):
            size = self.most[t]
            if not self.fixed[t]:
                back = words[max(0, end + 1 - size) : end + 1][::-1]
                size = self.backwards[t].hits(back)[-1][0] + 1
            places.append((t, end - size + 1, end))
        covered = reach = 0
        for _, a, b in sorted(places, key=lambda p: p[1]):
            covered += max(0, b + 1 - max(a, reach))
            reach = max(reach, b + 1)
        return len(words), covered, places


FOUND = "n_words long, n_covered long, places array<struct<label string, base boolean, first long, last long>>"


def with_licenses(docs: DataFrame, text_col: str = "text", out_col: str = "licenses", base=BASE, templates=TEMPLATES) -> DataFrame:
    """All columns of docs and `out_col` struct: n_words, n_covered long (words in places),
    places array of (label, base, first, last): every place of a base phrase; for templates,
    the longest place that ends at a word, for each word where one can end.

    A null text counts as empty: no words and no places. Texts are read whole, long ones too;
    places of different templates may overlap; repeated rows are scanned alike; a column of
    docs named `out_col` is replaced; an empty table gives no rows.
    """

    @F.arrow_udf(FOUND)
    def scanned(texts: pa.Array) -> pa.Array:
        scanner = kept("licenses", (base, templates), lambda: Scanner.of(base, templates))
        kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64())]))
        n_words, n_covered, places = [], [], []
        for text in texts:
            n, covered, found = scanner.scan(text.as_py() or "")
            n_words.append(n)
            n_covered.append(covered)
            places.append([{"label": scanner.labels[t], "base": t < scanner.base, "first": a, "last": b} for t, a, b in found])
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_covered, pa.int64()), pa.array(places, kind)], ["n_words", "n_covered", "places"])

    kept_columns = [F.col(f"`{c}`") for c in docs.columns if c != out_col]
    return docs.select(*kept_columns, scanned(F.col(f"`{text_col}`")).alias(out_col))


def summary(found: F.Column) -> dict[str, F.Column]:
    """Digest columns of a `licenses` column: places of base phrases and their smallest and
    largest first word, labels (distinct, sorted, joined by commas), and score: the share of
    the words that stand in a place, 0 without words."""
    base = F.filter(found["places"], lambda p: p["base"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    first = F.transform(base, lambda p: p["first"])
    return {
        "n_words": found["n_words"],
        "n_base": F.size(base).cast("long"),
        "first_word": F.array_min(first),
        "last_word": F.array_max(first),
        "base_labels": joined(base),
        "labels": joined(found["places"]),
        "score": F.coalesce(F.try_divide(found["n_covered"].cast("double"), found["n_words"].cast("double")), F.lit(0.0)),
    }
