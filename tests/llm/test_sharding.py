import pytest
from pyspark.sql import functions as F

from tipoff.llm import sharding


def place(spark, rows, shards, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, size long, shard string").withColumns({"key": F.lit("x"), "slot": F.lit(1), "row": F.lit(None).cast("string")})
    return df, sharding.shard(df, "size", ["text"], ["doc_id"], shards, **options).collect()


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_bytes_are_near_equal_with_a_hot_group(spark, shards):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}", 16 + i % 40, "x") for i in range(6000)] + [(None, None, 16, "x"), (1, "t1", 17, "x")]
    df, out = place(spark, rows, shards)
    assert len(out) == len(rows)
    sizes, slots = {}, {}
    for r in out:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean = sum(sizes.values()) / shards
    assert set(sizes) == set(range(shards))
    assert all(abs(v - mean) <= 0.011 * mean + 56 for v in sizes.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("row", [(7, "same", 50, "x"), (None, None, 50, "x")])
def test_equal_rows_part(spark, row):
    rows = [row] * 500 + [(i, f"t{i}", 50, "x") for i in range(500)]
    _, out = place(spark, rows, 10)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out) == sorted((str(i), str(t)) for i, t, _, _ in rows)
    sizes = [sum(r["size"] for r in out if r["shard"] == k) for k in range(10)]
    assert all(abs(s - 5000) <= 25 + 50 for s in sizes)
    assert all(r["key"] == "x" for r in out)


def test_placement_against_a_sort(spark):
    rows = [(i, "hot" if i % 2 else f"t{i}", 16 + i % 9, "x") for i in range(900)] + [(5, "hot", 21, "x")] * 300
    df, out = place(spark, rows, 7)
    keys = df.select(*(sharding._key(c).alias(c) for c in ("text", "doc_id")), "size").collect()
    order = sorted((r["text"], r["doc_id"], r["size"]) for r in keys)
    hashed = {(r["t"], r["i"]): (r["text"], r["doc_id"]) for r in df.select(F.col("text").alias("t"), F.col("doc_id").alias("i"), sharding._key("text").alias("text"), sharding._key("doc_id").alias("doc_id")).collect()}
    mine = sorted((r["shard"], *hashed[r["text"], r["doc_id"]], r["size"]) for r in out)
    assert [m[1:] for m in mine] == order  # one order, cut at boundaries
    assert all(sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(m[0] == k for m in mine))) for k in range(7))
    total, slack = sum(r[2] for r in rows), 0.005 * sum(r[2] for r in rows) / 7
    for k in range(1, 7):
        assert abs(sum(m[3] for m in mine if m[0] < k) - k * total / 7) <= slack + 25


def test_small_groups_stay_together(spark):
    rows = [(i, f"t{i // 4}", 100, "x") for i in range(8000)]
    _, out = place(spark, rows, 5, tolerance=0.02)
    homes = {}
    for r in out:
        homes.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


def test_few_and_no_rows(spark):
    assert place(spark, [], 4)[1] == []
    assert len(place(spark, [(1, "a", 16, "x")], 4)[1]) == 1
    assert len(place(spark, [(1, "a", 0, "x"), (1, "a", 0, "x")], 4)[1]) == 2


def test_law_columns(spark, tmp_path):
    from tipoff.llm.queries import op7_histogram_shards

    df = spark.createDataFrame([(1, "é"), (2, None)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in op7_histogram_shards(spark, str(tmp_path)).collect()}
    assert (out[1]["size"], out[2]["size"], out[2]["text_crc32"]) == (18, 16, 0)
    assert out[1]["law"] == "bytes" and out[1]["grown_shard"] is None
    assert F is not None
