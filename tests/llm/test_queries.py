"""The queries over a folder of hard rows: their columns and types, and their rows against
the SQL twins or against the libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tipoff.llm import queries

EXTRA = "shard int, slot int, kept string, spans string, class_id string, lang_pred string, score string, sequence_id string, offset string, n_tokens string"
COLUMNS = {
    "op1_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op2_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op4_bpe_round_trip": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op5_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op6_lz_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op7_histogram_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_prob_minhash": "doc_id bigint, class_id bigint",
    "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_threshold_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op12_license_templates": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op13_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
}


def documents():
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice(["ta", "ne", "shi", "ür", "ok"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    same, passage = prose(90), prose(20)
    near = same.split()
    near[44] = "edited"
    texts = [prose(60) for _ in range(30)] + [same] * 40 + [" ".join(near), passage + " " + prose(30), prose(30) + " " + passage + "　é", None, "", "", "12 34", "<|endoftext|>", "ab " * 300, "under the MIT\tLicense, CC-BY; Licensed under a CC BY-NC 4.0", "CAPITAL $1"]
    rows = list(enumerate(texts)) + [(500, prose(150_000)), (501, "long " * 60_000), (502, prose(5)), (502, prose(5)), (502, None), (None, prose(80)), (None, same)]
    return [(i, t, ("xx", "yy", None)[k % 3], "s" if k % 2 else None) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("hard"))
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string")
    docs = docs.selectExpr("*", "cast(length(text) as long) n_chars", *(f"cast(doc_id as {x.split()[1]}) {x.split()[0]}" for x in EXTRA.split(", ")))
    docs.repartition(5).write.parquet(f"{out}/documents.parquet")
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=16)], 7) for i in range(300)] + [(300, None, 1), (320, [0.0] * 16, 1), (340, [float("nan")] * 16, 1), (360, [None] + [1.0] * 15, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score int").write.parquet(f"{out}/embeddings.parquet")
    said = ["", None, "<|im_end|>\n", "<\\|x|>", "ü😀\nb", "<|part|>"]
    talk = [(c, t, ("system", "user", "assistant", None)[(c + t) % 4], said[(c * t) % 6], "x") for c in range(20) for t in range(6)] + [(3, 2, "assistant", "tie", "x")] * 2 + [(None, None, "assistant", "none", "x")]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string, formatted string").write.parquet(f"{out}/conversations.parquet")
    asked = [(1, "Tane shi ok ürok ok", "x"), (2, "ta ta long", "x"), (2, "AB ab", "y"), (3, None, "x"), (4, "", "x"), (5, "none-of these", "x"), (None, "ok", "x")]
    spark.createDataFrame(asked, "item_id long, text string, rank string").write.parquet(f"{out}/benchmark.parquet")
    held = [(k, k % 3 % 2, k % 5 % 2, 1) for k in range(0, 90, 2)] + [(502, 1, 0, 1), (502, 0, 1, 1), (None, 1, 1, 1), (9999, 1, 1, 1)]
    spark.createDataFrame(held, "doc_id long, quality int, toxic int, n int").write.parquet(f"{out}/labels.parquet")
    return out


def ran(spark, folder, name):
    df = queries.queries()[name](spark, folder)
    found = dict(df.dtypes)
    for column in COLUMNS[name].split(", "):
        assert found[column.split()[0]] == column.split()[1], column
    return df.collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(x.split()[0] for x in COLUMNS[name].split(", "))
    assert sorted((tuple(r[c] for c in names) for r in ran(spark, folder, name)), key=str) == sorted(cursor.fetchall(), key=str)


def test_counts_and_round_trip(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    counts, trips = [], []
    for doc, text, *_ in documents():
        ids = library.encode(text or "", add_special_tokens=False).ids
        counts.append((doc, len((text or "").encode()), len(ids), len(ids) > 512))
        trips.append((doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in ran(spark, folder, "op1_token_counts")]
    assert sorted(got, key=str) == sorted(counts, key=str)
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in ran(spark, folder, "op4_bpe_round_trip")]
    assert sorted(got, key=str) == sorted(trips, key=str)


def test_packing(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc, text, *_ in documents():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(doc, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    rows = ran(spark, folder, "op2_best_fit_packing")
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(held) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_neighbours(spark, folder):
    rows = ran(spark, folder, "op3_nearest_neighbours")
    by = defaultdict(list)
    for r in rows:
        by[r["query_id"]].append(r)
    assert set(by) == set(range(0, 300, 20))
    for query, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert all((-a["score"], a["vec_id"]) < (-b["score"], b["vec_id"]) for a, b in zip(found, found[1:]))
        assert query not in {r["vec_id"] for r in found} and {r["vec_id"] for r in found} <= set(range(300))


def test_fingerprints_of_edited_texts(spark, folder):
    rows = ran(spark, folder, "op6_lz_fingerprints")
    assert len(rows) == len(documents())
    texts = {d[0]: d[1] or "" for d in documents() if d[0] is not None and d[0] < 500}
    by = {r["doc_id"]: r for r in rows}
    for doc in range(len(texts) - 1):
        cut, following = len(texts[doc]) // 4, texts[doc + 1]
        edited = texts[doc][: len(texts[doc]) - cut] + following[:cut]
        assert (by[doc]["n_chars"], by[doc]["edited_sha256"]) == (len(texts[doc]), hashlib.sha256(edited.encode()).hexdigest())
        assert (by[doc]["near_next"] == 1) >= (texts[doc] == following)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert len({by[d]["fingerprint"] for d in range(30, 70)}) == 1


def test_shards(spark, folder):
    rows = ran(spark, folder, "op7_histogram_shards")
    want = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in documents()]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


def test_predictions(spark, folder):
    rows = ran(spark, folder, "op10_language_id")
    texts = documents()
    assert len(rows) == len(texts) and {r["lang_pred"] for r in rows} <= {"xx", "yy", "und"}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    blank = {d for d, t, *_ in texts if d is not None and d < 500 and not any(c.isalpha() for c in t or "")}
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} >= blank
