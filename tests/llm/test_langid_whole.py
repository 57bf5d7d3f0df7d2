"""Filters and floors of language identification come from all rows."""

import random

import pytest

from tipoff.llm import langid


def test_floors_and_filters_see_every_row(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    rows = [(k, "xx", " ".join(rng.choice(words) for _ in range(8))) for k in range(7_000)]
    rows += [(7_000 + k, "xx", f"{words[k % 60]} zzqy{k % 2} 1") for k in range(140)]  # 2 in 100, half known
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    assert langid.sampled(df).count() == len(rows)
    filters = langid.fit(df)
    plain = langid.fit(df.where("doc_id < 7000"))
    scores = sorted(r["score"] for r in langid.predict(df, plain).collect())
    least = {r["lang_pred"]: r["least"] for r in langid.least_scores(df, plain, 2.0).collect()}
    assert least["xx"] == pytest.approx(scores[int(0.01 * len(scores)) - 1] / 2, rel=0.02)
    both = {r["doc_id"]: r["score"] for r in langid.predict(df, filters).collect()}
    assert min(both.values()) > 0.8  # but for n-grams of one row or two
