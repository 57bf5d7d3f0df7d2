"""The pipeline on a small fixture, each stage against a brute-force version of it."""

import os
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tipoff.llm import queries
from tipoff.llm.common import settle

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(4)
    stems = {"xx": ["tion", "the", "ing", "and", "or"], "yy": ["schen", "ung", "der", "ü", "ge"]}
    prose = lambda k, n: " ".join("".join(rng.choice(stems[k]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, prose("xx" if i % 3 else "yy", 60 + i), "xx" if i % 3 else "yy", "s", 1) for i in range(120)]
    passage = prose("xx", 30)
    near = rows[1][1].split()
    near[3] = "edited"
    rows += [(200, rows[5][1], "xx", "s", 1), (201, " ".join(near), None, "s", 1), (202, None, "xx", "s", 1), (203, "123 456", None, "s", 1), (204, "", None, "s", 1), (205, "日本語" * 40, None, "s", 1)]
    rows += [(210, prose("xx", 40) + " " + passage, None, "s", 1), (211, prose("xx", 45) + " " + passage + " é" + prose("xx", 5), None, None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, held = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, str(tmp_path)), name)
        if name != "pack":
            assert out.columns == docs.columns
        docs, held[name] = out, out
    ids = {n: {r["doc_id"] for r in d.collect()} for n, d in held.items()}
    assert ids["language_id"] == {r[0] for r in rows} - {202, 203, 204, 205}
    assert ids["near_duplicates"] == ids["language_id"] - {200, 201}
    left = {r["doc_id"]: r for r in held["repeated_passages"].collect()}
    assert set(left) == ids["near_duplicates"] and passage in left[210]["text"]
    assert passage[10:-10] not in left[211]["text"] and left[211]["n_chars"] == len(left[211]["text"])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = held["pack"].collect()
    assert sum(r["length"] for r in packed) == sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in left.values())
    again = sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert again == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed)


def test_different_texts_of_one_id_stay(spark, tmp_path):
    rng = random.Random(9)
    prose = lambda: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(60))
    one, two, three, four, five = (prose() for _ in range(5))
    rows = [(None, one), (None, two), (None, two), (1, three), (1, four), (2, three + " end"), (2, five)]
    docs = spark.createDataFrame([(i, t, "xx", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(left, key=str) == sorted([(None, one), (None, two), (1, three), (1, four), (2, five)], key=str)


ODD = ["score", "lang_pred", "least", "kept", "spans", "__key", "__node", "a.b", "rest", "has_letter", "node", "key", "first_id", "block", "least id", "id"]


def odd_docs(spark, n_chars=True):
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(["tion", "the", "ing", "and", "or"]) + str(rng.randint(0, 999)) + rng.choice("aeiou") for _ in range(n))
    passage = prose(15)
    rows = [(k, prose(50), "xx") for k in range(40)] + [(None, prose(60), "xx"), (None, prose(60), None), (7, prose(40), "xx"), (50, passage + prose(30), None), (51, prose(30) + passage, None), (60, prose(110_000), "xx")]
    rows += [(0, rows[0][1], "xx"), (70, rows[1][1], "xx"), (71, None, "xx"), (72, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mark = F.concat(F.lit("m"), F.xxhash64("doc_id", "text", "lang").cast("string"))
    docs = docs.select("*", *([F.length("text").cast("int").alias("n_chars")] if n_chars else []), *(F.concat(mark, F.lit(c)).alias(c) for c in ODD))
    return settle(docs, "odd"), rows


@pytest.mark.parametrize("n_chars", [True, False])
def test_columns_of_any_name_come_back(spark, tmp_path, n_chars):
    docs, rows = odd_docs(spark, n_chars)
    given = {(r["doc_id"], r["text"]): r for r in docs.collect()}
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        found = out.collect()
        marks = {r["score"]: r for r in given.values()}
        assert found and all(r[c] == marks[r["score"]][c] for r in found for c in others)
        assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        if name == "near_duplicates":
            assert sorted((r["doc_id"] for r in found), key=str) == sorted([k for k in range(40)] + [None, None, 7, 50, 51, 60, 71], key=str)
        if name == "repeated_passages":
            assert len(found) == len(rows)
            if n_chars:
                assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in found)
        else:
            assert all(r["text"] == marks[r["score"]]["text"] for r in found)
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in rows}


@pytest.mark.parametrize("k", range(4))
def test_empty_table_of_any_columns(spark, tmp_path, k):
    docs, _ = odd_docs(spark)
    out = corpus_pipeline.STAGES[k][1](spark, docs.limit(0), str(tmp_path))
    assert out.count() == 0 and (k == 3 or out.columns == docs.columns)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_are_registered():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)}
    assert os.path.isdir(SF)
