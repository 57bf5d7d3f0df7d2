import hashlib
import random
import struct
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tipoff.llm import bytebpe, packing, tokencount

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
POOL = ["a", "B", "th", "the", " ", "  ", "\n", "\t", "'s", "'LL", "'", "é", "é", "ß", "İ", "Σ", "ς", "中", "😀", "½", "7", "2024", ".", ",,", "%%", "\x00", "\x1c", "\x85", "　", "�", "꟎", "<|endoftext|>", "<|endof", "क़"]


def texts(n=400, seed=3):
    rng = random.Random(seed)
    out = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*out, "", None, "a" * 3000, "the the " * 4000, out[0], out[0]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"clash{i}") for i, t in enumerate(texts())]
    rows += [(None, "null id", "x"), (5, "same id, other text", "y"), (5, "same id, other text", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3).cache()


def test_encode_and_decode_as_the_library(docs):
    library = Tokenizer.from_file(BYTE)
    out = bytebpe.decode(bytebpe.encode(docs, BYTE), BYTE).collect()
    assert len(out) == docs.count()
    for r in out:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_every_token_encodes_to_itself_as_the_library_says():
    core = bytebpe.Backtracker(bytebpe.read_file(BYTE))
    library = Tokenizer.from_file(BYTE)
    rng = random.Random(1)
    words = [" " + "".join(rng.choice("abcdeghinorstu") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    assert [core.encode(w) for w in words] == [e.ids for e in library.encode_batch(words)]


def test_decode_of_broken_and_unknown_ids(spark):
    library = Tokenizer.from_file(BYTE)
    bad = [[128, 129], [50256, 0], [], [447]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate([*bad, None, [-1, 99999999, None, 0]])], "k int, ids array<int>")
    got = [r["decoded"] for r in bytebpe.decode(df, BYTE).orderBy("k").collect()]
    assert got == [library.decode(b, skip_special_tokens=False) for b in bad] + ["", "!"]


@pytest.mark.parametrize("head", [0, 5, 1 << 17])
def test_token_counts_do_not_depend_on_the_head(docs, head):
    library = Tokenizer.from_file(BYTE)
    got = sorted(map(tuple, tokencount.token_counts(docs, BYTE, head=head).collect()), key=str)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()), key=str)
    assert got == want


def test_word_pieces_and_packing(docs):
    library = Tokenizer.from_file(WORD)
    rows = packing.pack_documents(docs, WORD).collect()
    held = {}
    for r in docs.collect():
        held.setdefault(r["doc_id"], []).append([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0])
    for r in rows:
        assert any(zlib.crc32(struct.pack(f"<{r['length']}I", *ids[r["start"] : r["start"] + r["length"]])) == r["ids_crc32"] for ids in held[r["doc_id"]] if r["start"] + r["length"] <= len(ids))
    total = sum(len(x) for v in held.values() for x in v)
    assert sum(r["length"] for r in rows) == total
    check_packed([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048, -(-total // 2048))


def check_packed(places, capacity, most):
    sequences = {}
    for s, offset, length in places:
        sequences.setdefault(s, []).append((offset, length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= most + 1


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 30) for _ in range(rng.randint(0, 300))] + [7] * rng.choice((0, 200))
    counts = {n: lengths.count(n) for n in set(lengths)}
    places, ranks = [], {}
    for length, first, count, sequence, offset in packing.plan(counts, 30):
        assert first == ranks.get(length, 0)
        ranks[length] = first + count
        places += [(sequence + k, offset, length) for k in range(count)]
    assert ranks == counts
    assert len({s for s, _, _ in places}) == best_fit_decreasing(lengths, 30)
    check_packed(places, 30, len(places))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bytebpe.encode(empty, BYTE).count() == 0
    assert tokencount.token_counts(empty, BYTE).count() == 0
    assert packing.pack_documents(empty, WORD).count() == 0


def test_lengths_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 40)], "k int, length long"), ["k"], capacity=30)
    with pytest.raises(ValueError):
        packing.check_drops_space(bytebpe.read_file(BYTE))


def test_digest_of_ids(spark, docs):
    from pyspark.sql import functions as F

    r = bytebpe.encode(docs.where("doc_id = 3"), BYTE).select("ids", F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("h")).first()
    assert r["h"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()


def test_equal_rows_without_id_are_ranked_by_many_tasks(spark):
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one and the same row").alias("text"))
    packed = packing.pack_documents(docs, WORD)
    length = packed.first()["length"]
    each = 2048 // length
    fill = packed.groupBy("sequence_id").agg(F.count("*").alias("n"), F.countDistinct("offset").alias("places"), F.max("offset").alias("last"))
    assert fill.where(f"n <> places or last <> (n - 1) * {length}").count() == 0
    assert packed.count() == 100_000 and fill.count() == -(-100_000 // each)
    seen = []
    plain = packing.rank_within

    def spy(df, group, order, rank, salts):
        cell = F.pmod(F.xxhash64(*(F.col(c) for c in order)), F.lit(salts))
        seen.extend(r["count"] for r in df.groupBy(cell).count().collect())
        return plain(df, group, order, rank, salts)

    packing.rank_within = spy
    try:
        packing.pack_documents(docs, WORD)
    finally:
        packing.rank_within = plain
    assert len(seen) == 8 and max(seen) < 2 * 100_000 / 8
