"""What filters do to one another: every order of them, from one set of additive counters.

Each document gets a mask of the filters that it fails. Duplicates are found by a sort:
documents are dealt out in ranges of (text fingerprint, id), sorted by (fingerprint, text, id),
and each is compared with the one before it. The mask of a document and its part are all that
goes on; counters of (part, mask) add up, and all orders are read off them.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import settle

#: Words are what stands between these (fixed).
BLANKS = r"[\x20\x09-\x0D]+"


def text_rules(text: F.Column) -> dict[str, F.Column]:
    """Failure conditions on a text that is not null: under 200 words, under half of the words
    distinct, over 3 % capitals, a character of #$%&*|."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _sorted_runs(docs: DataFrame, rules, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """id, part, mask, and for rows that a row of an earlier range may precede: at, sha. The
    highest bit of the mask is set where a smaller id of the same range has the same text.
    Rows without a mask are no documents: the least ids of the last fingerprint of a range."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), part.alias("part"), F.xxhash64(text).alias("at"), F.monotonically_increasing_id().alias("row"))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_id = F.col("id").asc_nulls_last()
    dealt = rows.repartitionByRange(ranges, "at", by_id, "row").sortWithinPartitions("at", "text", by_id)
    failing = rules(F.col("text"))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failing.values())), F.lit(0))
    bit = 1 << len(failing)

    def compare(batches):
        edge = held = None  # fingerprint that the range begins with; (at, text, first id) of the run so far
        begun: list = []  # (text, first id) of the runs of the last fingerprint so far
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts, parts, at, masks = (batch.column(k) for k in range(5))
            if held is None:
                edge = at[0].as_py()
                held = (at.slice(0, 1), texts.slice(0, 1), ids.slice(0, 1))
                begun = [(texts[0], ids[0])]
            marks = np.append(held[0].to_numpy(), at.to_numpy())
            all_texts, all_ids = pa.concat_arrays([held[1], texts]), pa.concat_arrays([held[2], ids])
            n = batch.num_rows
            same = (marks[1:] == marks[:-1]) & pc.equal(all_texts.slice(1), all_texts.slice(0, n)).to_numpy(zero_copy_only=False)
            first = np.maximum.accumulate(np.where(same, 0, np.arange(1, n + 1)))  # 0: the run that came in
            firsts = all_ids.take(pa.array(first))
            later = pc.fill_null(pc.greater(ids, firsts), False).to_numpy(zero_copy_only=False)
            open_ = (marks[1:] == edge) & ~later & pc.is_valid(ids).to_numpy(zero_copy_only=False)
            shas = [hashlib.sha256(texts[k].as_buffer()).digest() if o else None for k, o in enumerate(open_)] if open_.any() else [None] * n
            out = [ids, parts, pa.array((masks.to_numpy() | np.where(later, bit, 0)).astype(np.int32)), pa.array(marks[1:], pa.int64(), mask=~open_), pa.array(shas, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["id", "part", "mask", "at", "sha"])
            if marks[-1] != marks[0]:
                begun = []
            begun += [(texts[k], ids[k]) for k in np.flatnonzero(~same & (marks[1:] == marks[-1]))]
            held = (at.slice(n - 1), texts.slice(n - 1), firsts.slice(n - 1))
        if held is not None:
            n = len(begun)
            shas = [hashlib.sha256(text.as_buffer()).digest() for text, _ in begun]
            out = [pa.array([i.as_py() for _, i in begun], ids.type), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array([marks[-1]] * n, pa.int64()), pa.array(shas, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["id", "part", "mask", "at", "sha"])

    kind = docs.schema[id_col].dataType.simpleString()
    return dealt.select("id", "text", "part", "at", mask.cast("int").alias("mask")).mapInArrow(compare, f"id {kind}, part string, mask int, at long, sha binary")


def masks(docs: DataFrame, rules=text_rules, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per row of docs: id, part string, mask int. Bit k of the mask: rule k fails;
    the bit above them: a row with a smaller id has the same text.

    Only the first fingerprint of a range can have begun in an earlier one. Of its texts, the
    rows of the least id in the range are left open, and settled by the least of all ranges
    that begin or end with it.
    Null texts count as empty; a null part is the empty string; a null id is neither smaller
    than another nor larger; rows that repeat an id and a text do not precede one another; a
    long text is compared whole; an empty table gives no rows; other columns are not read.
    """
    runs = settle(_sorted_runs(docs, rules, id_col, text_col, part_col), "runs")
    bit = 1 << len(rules(F.lit("")))
    edges = runs.where("at is not null")
    least = edges.groupBy("at", "sha").agg(F.min("id").alias("least"))
    late = F.col("mask").bitwiseOR(F.when(F.col("id") > F.col("least"), bit).otherwise(0))
    closed = edges.where("mask is not null").join(least, ["at", "sha"]).select("id", "part", late.alias("mask"))
    return runs.where("at is null").select("id", "part", "mask").union(closed)


def counters(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic long: documents, those labelled of quality 1, and toxic.
    Rows are counted by id before they meet the labels; an id with several labels has the
    highest of each; null ids have none."""
    held = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    own = masked.groupBy("id", "part", "mask").agg(F.count("*").alias("n")).join(held, "id", "left")
    labelled = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return own.groupBy("part", "mask").agg(F.sum("n").alias("n"), labelled("quality").alias("good"), labelled("toxic").alias("toxic"))


def interactions(counted: DataFrame, letters: str) -> DataFrame:
    """A row per part, order of all letters and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley long. A part has at most 2^letters counters.

    A document that fails k filters goes with each of them first in 1/k of all orders; that is
    its share in the sum over orders (shapley)."""
    n_orders = math.factorial(len(letters))
    steps = [
        {"filter_order": "".join(o), "step": s + 1, "bit": 1 << letters.index(o[s]), "before": sum(1 << letters.index(x) for x in o[:s])}
        for o in itertools.permutations(letters)
        for s in range(len(o))
    ]
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, bit int, before int>>")
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = parts.select("part", "cells", F.explode(plan).alias("at")).select("part", "cells", "at.*")

    def total(what, where):
        return F.aggregate("cells", F.lit(0).cast("long"), lambda out, c: out + F.when(where(c["mask"]), what(c)).otherwise(F.lit(0).cast("long")))

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~gone(m)
    n = lambda c: c["n"]
    return rows.select(
        "part", "filter_order", "step",
        total(n, lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda m: fails(m) & gone(m)).alias("redundant"),
        total(n, lambda m: m == F.col("bit")).alias("unique_fails"),
        total(lambda c: c["good"], here).alias("good_lost"),
        total(lambda c: c["toxic"], here).alias("toxic_lost"),
        total(lambda c: c["n"] * (F.lit(n_orders) / F.bit_count(c["mask"])).cast("long"), fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, rules=text_rules, duplicates: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """`interactions` of the rules and the filter of duplicates over docs; see `masks` and
    `counters` for nulls, ties and repeated rows."""
    letters = "".join(rules(F.lit(""))) + duplicates
    masked = masks(docs, rules, id_col, text_col, part_col)
    return interactions(counters(masked, labels, id_col), letters)
