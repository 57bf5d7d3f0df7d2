"""Filter orders against playing every order over the rows."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from tipoff.llm import filteraudit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(rows):
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    for doc, text, part in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), doc is not None and doc > least[text]]
        yield doc, part or "", "".join(x for x, f in zip("ABCDE", fails) if f)


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    by_part = defaultdict(Counter)
    for doc, part, fails in failing(rows):
        by_part[part][fails, doc in good, doc in toxic] += 1
    out = []
    for part, cells in by_part.items():
        steps, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            for s, x in enumerate(order):
                t = Counter()
                for (fails, g, tx), n in cells.items():
                    gone = any(y in fails for y in order[:s])
                    here = x in fails and not gone
                    t["kept"] += n * (not gone and not here)
                    t["removed"] += n * here
                    t["redundant"] += n * (x in fails and gone)
                    t["unique"] += n * (fails == x)
                    t["good"] += n * (here and g)
                    t["toxic"] += n * (here and tx)
                shapley[x] += t["removed"]
                steps.append((part, "".join(order), s + 1, *(t[k] for k in ("kept", "removed", "redundant", "unique", "good", "toxic"))))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in steps]
    return sorted(out)


def ran(spark, rows, labels, partitions):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, mask int, at string").repartition(5)
    held = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        return sorted(tuple(r) for r in filteraudit.audit(docs, held).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def hard_rows():
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("ab cd ef gh $ij KL mn".split()) + str(rng.randint(0, 300)) for _ in range(n))
    same, long = prose(210), prose(120_000)
    texts = [prose(rng.choice([5, 150, 199, 200, 260])) for _ in range(60)] + [same] * 90 + [None, "", "", "A", "a\x0bb c", "x " * 250, long, long]
    rows = [(k, t, rng.choice(["en", "de", None, ""])) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(None, same, "en"), (None, same, None), (60, same, "en"), (60, same, "en"), (60, same, "fr"), (149, same, "en"), (-5, prose(3), "en"), (None, prose(220), "zz")]


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_every_order_by_brute_force(spark, partitions):
    rows = hard_rows()
    labels = [(k, k % 3 % 2, k % 4 // 2) for k in range(0, 150, 2)] + [(60, 1, 0), (60, 0, 1), (None, 1, 1), (4000, 1, 1)]
    got = ran(spark, rows, labels, partitions)
    assert got == brute(rows, labels) and len(got) == 600 * len({p or "" for _, _, p in rows})


def test_one_text_over_many_ranges(spark):
    rows = [(k, "same text", "en") for k in range(500, 0, -1)] + [(0, "other", "en")]
    got = ran(spark, rows, [(1, 1, 0)], 16)
    assert got == brute(rows, [(1, 1, 0)])


def test_equal_fingerprints_of_different_texts(spark, monkeypatch):
    """With one fingerprint for all texts, ranges part them anywhere; whole texts still decide."""
    rows = [(k, f"text {k % 7}", "en") for k in range(300)] + [(3, "text 3", "en"), (None, "text 1", "de")]
    real = filteraudit.F

    class Same:
        def __getattr__(self, name):
            return (lambda *a: real.lit(5).cast("long")) if name == "xxhash64" else getattr(real, name)

    monkeypatch.setattr(filteraudit, "F", Same())
    assert ran(spark, rows, [], 12) == brute(rows, [])


def test_empty_tables(spark):
    assert ran(spark, [], [], 4) == []
    assert len(ran(spark, [(1, "a", "en")], [], 4)) == 600
