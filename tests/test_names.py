"""Fuzzy names: bit-parallel scores against the table of a subsequence, the gram index against
all pairs."""

import random

import pytest

from tipoff.functions import names as nm
from tipoff.operators import naming


def by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for k, y in enumerate(b, 1):
            corner, row[k] = row[k], corner + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_common_subsequences():
    rng = random.Random(1)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    pairs = [(word(rng.choice([0, 1, 5, 20, 63, 64, 65, 130]), s), word(rng.choice([0, 1, 7, 30, 64, 90]), s)) for s in ("ab", "abcdefghij ", "aé日😀") for _ in range(150)]
    assert list(nm.common_subsequences(*zip(*pairs))) == [by_table(a, b) for a, b in pairs]
    assert list(nm.common_subsequences([], [])) == []


def test_sorted_tokens(spark):
    names = ["b a", "", None, " x　a\tZ ", "é e", "one"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "name string").select(nm.sorted_tokens("name")).collect()]
    assert got == [None if n is None else " ".join(sorted(n.split())) for n in names]


@pytest.mark.parametrize("least", [30.0, 60.0, 75.0, 85.0, 100.0])
def test_index_finds_every_pair(spark, least):
    rng = random.Random(7)
    parts = ["north", "south", "state", "st", "saint", "carolina", "tech", "a", "é", "mary", "marys", "johns"]
    made = lambda: " ".join(sorted(rng.choice(parts) + rng.choice(["", "", "x", "yz"]) for _ in range(rng.randint(0, 3))))
    a, b = ({made() for _ in range(120)} | {"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(40)} | {""} for _ in range(2))
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    got = {(r["key_a"], r["key_b"]): r["score"] for r in naming.similar(frame(a), frame(b), least).collect()}
    every = {(x, y): 200.0 * by_table(x, y) / (len(x) + len(y)) if x or y else 100.0 for x in a for y in b}
    want = {p: s for p, s in every.items() if s >= least}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def test_no_side_is_crossed(spark):
    frame = spark.createDataFrame([("a b",)], "key string")
    plan = naming.similar(frame, frame, 85.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_best_of_ties_is_the_first(spark):
    known = naming.lookup(spark.createDataFrame([("abcdefgy", 1, 0), ("abcdefgx", 2, 1), ("x st", 3, 2), ("st x", 4, 3), (None, 5, 4)], "name string, TeamID long, row int"))
    names = spark.createDataFrame([("abcdefgz",), ("ST X ",), (None,), ("",), ("qq",)], "name string")
    got = {r["name"]: (r["TeamID"], r["how"]) for r in naming.fuzzy(names, known, 80).collect()}
    assert got == {"abcdefgz": (2, "fuzzy"), "ST X ": (4, "fuzzy")}
    assert naming.fuzzy(names.limit(0), known).count() == naming.fuzzy(names, known.limit(0)).count() == 0
