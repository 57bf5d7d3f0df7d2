"""Template automata against a search of every place by regular expressions."""

import random
import re

import pytest

from tipoff.llm import licenses
from tipoff.llm.queries import _pattern

BASE = (("ab", "a b"), ("c", "c"))
TEMPLATES = (("t1", "x [[y [[z]]]] {{n|1-3}} a"), ("t2", "{{n|0-2}} b [[c c]]"), ("t3", "[[a]] [[b]] d"), ("t4", "a a a"), ("t5", "y {{n|2-2}} [[x]]"))


def brute(text, base, templates):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    out = []
    for k, (label, markup) in enumerate((*base, *templates)):
        pattern = re.compile(_pattern(licenses.parse(markup)))
        for end in range(len(words)):
            for start in range(end + 1):
                if pattern.fullmatch("".join(" " + w for w in words[start : end + 1])):
                    out.append((label, k < len(base), start, end))
                    break
    return words, sorted(out)


def test_every_place_by_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdxyz") for _ in range(rng.randint(0, 25))) for _ in range(150)] + ["A,B;c", "é a\x00b", "a b　c"]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, licenses int, places int")
    got = licenses.with_licenses(docs, base=BASE, templates=TEMPLATES).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for r, text in zip(got, texts):
        words, places = brute(text, BASE, TEMPLATES)
        assert r["licenses"]["n_words"] == len(words) and r["places"] == 2
        assert sorted(tuple(p) for p in r["licenses"]["places"]) == places
        assert r["licenses"]["n_covered"] == len({w for _, _, a, b in places for w in range(a, b + 1)})


def test_table_made_anew_gives_the_same(monkeypatch):
    scanner = licenses.Scanner.of(BASE, TEMPLATES)
    text = " ".join(random.Random(4).choices("abcdxyz", k=5000))
    want = scanner.scan(text)
    monkeypatch.setattr(licenses, "STATES", 3)
    assert licenses.Scanner.of(BASE, TEMPLATES).scan(text) == want


def test_public_wording(spark):
    mit = dict(licenses.TEMPLATES)["mit-text"]
    own = re.sub(r"\[\[.*?\]\] ", "", re.sub(r"\{\{.*?\}\}", "the authors or copyright holders", mit))
    texts = [
        ("Released under the MIT License.", "mit", "mit,mit-notice"),
        ("Licensed under the Apache License, Version 2.0.", "apache", "apache,apache-2.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by", "cc-by,cc-by-nc-4.0"),
        ("This is licensed under the GNU General Public License, version 3.", "gpl", "gpl,gpl-3.0"),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "gpl", "gpl,gpl-2.0"),
        (own.upper(), "", "mit-text"),
        (own.replace("without restriction", "with restriction"), "", ""),
        ("MIT Licensed", "", ""),
        (None, "", ""),
        ("", "", ""),
        ("cc by " * 100_000, "cc-by", "cc-by"),
    ]
    docs = spark.createDataFrame([(k, t[0]) for k, t in enumerate(texts)], "doc_id long, text string")
    found = licenses.with_licenses(docs)
    got = found.select("doc_id", *(c.alias(n) for n, c in licenses.summary(found["licenses"]).items())).orderBy("doc_id").collect()
    assert [(r["base_labels"], r["labels"]) for r in got] == [t[1:] for t in texts]
    assert (got[10]["n_base"], got[10]["first_word"], got[10]["last_word"], got[10]["score"]) == (100_000, 0, 199_998, 1.0)
    assert got[8][1:5] == got[9][1:5] == (0, 0, None, None) and got[8]["score"] == 0
    assert got[4]["score"] == 1 and 0 < got[3]["score"] < 1
    assert licenses.with_licenses(docs.limit(0)).count() == 0


def test_markup_has_to_close():
    with pytest.raises(ValueError):
        licenses.parse("a [[b")
