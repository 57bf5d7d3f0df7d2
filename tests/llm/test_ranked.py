"""The threshold algorithm against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tipoff.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    terms = [(d, TERM.findall((t or "").translate(LOW))) for d, t in docs]
    terms = [(d, len(t), Counter(t)) for d, t in terms if t]
    n_docs, n_terms = len(terms), sum(n for _, n, _ in terms)
    df = Counter(t for _, _, c in terms for t in c)
    pooled = {}
    for i, t in items:
        pooled.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOW)))
    out = []
    for item, asked in pooled.items():
        scores = []
        for doc, n, c in terms:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                scores.append((score, doc))
        scores.sort(key=lambda r: (-r[0], r[1] is not None, r[1] or 0))
        out += [(item, r + 1, doc, s) for r, (s, doc) in enumerate(scores[:k])]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, score int").repartition(4), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("segment", [40, 1 << 20])
def test_equal_to_all_scores(spark, monkeypatch, segment):
    monkeypatch.setattr(ranked, "SEGMENT", segment)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)] + ["É", "日本", "MiXed", "x-y"]
    prose = lambda n: " ".join(words[min(int(rng.expovariate(0.12)), 43)] for _ in range(n))
    docs = [(k, prose(rng.randint(1, 60))) for k in range(300)] + [(k, "tie w39") for k in range(400, 460)] + [(None, "tie w39"), (7, "w39"), (7, "w39"), (8, None), (9, ""), (10, "-- !"), (11, prose(50_000))]
    items = [(k, prose(rng.randint(1, 12))) for k in range(12)] + [(50, "tie"), (51, "TIE tie w39"), (52, None), (53, "absent"), (50, "w1"), (None, "日本 É")]
    got = ranked.search(*frames(spark, docs, items), k=5).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items, 5)
    got = ranked.search(*frames(spark, docs, items), k=5, block_bytes=64).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items, 5)


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        got = ranked.search(d, i)
        assert got.collect() == [] and dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_stops_before_all_are_seen():
    """A rare term with a high impact settles the best; the long list of a common one is left."""
    rng = np.random.default_rng(1)
    n = 50_000
    rare = np.arange(n) < 30
    per_doc = 1 + rare.astype(int)
    term = np.concatenate([[0, 1] if r else [1] for r in rare])
    count = np.where(term == 0, 5, rng.integers(1, 4, len(term)))
    segment = ranked.Segment(pa.array(np.arange(n)), np.full(n, 100), term, count, per_doc, n, 100 * n)
    best = ranked.Best(20)
    assert segment.search(np.array([0, 1]), np.array([9000, 3]), best) < n // 50
    assert len(best.rows) == 20 and all(i < 30 for _, i in best.rows)
