"""Lempel-Ziv phrase fingerprints.

A text is parsed into phrases (each the shortest string not yet in the text's own
dictionary), the phrase set is hashed, and a one-permutation minimum-hash signature of the
set is the fingerprint. Texts that compress each other share phrases and so bins.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 128
_SHIFT = BINS.bit_length() - 1
_EDGES = np.arange(BINS + 1, dtype=np.uint64)


_ODD = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


class Phrases:
    """A text's dictionary as a tree: a phrase is its parent and one more code point, so a step
    costs the same however long phrases grow. marks[n] hashes phrase n, 0 is the empty one."""

    def __init__(self):
        self.steps: dict[int, int] = {}
        self.marks = [1]

    def parse(self, text: str, node: int = 0) -> int:
        """Adds the phrases of text, going on from a pending one; returns what is pending."""
        steps, marks = self.steps, self.marks
        for c in np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).tolist():
            key = node << 21 | c
            child = steps.get(key)
            if child is None:
                steps[key] = len(marks)
                marks.append(((marks[node] ^ c) * _ODD + 1) & _WORD)
                node = 0
            else:
                node = child
        return node

    def until(self, n: int) -> Phrases:
        """As it was when it had n phrases."""
        out = Phrases()
        out.steps, out.marks = dict(islice(self.steps.items(), n)), self.marks[: n + 1]
        return out

    def hashes(self) -> np.ndarray:
        h = np.array(self.marks[1:], np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def signature(values: np.ndarray) -> np.ndarray:
    """The least hash of each bin, in 16 bits; 0 marks an empty bin."""
    out = np.zeros(BINS, dtype=np.uint16)
    if len(values):
        keys = np.sort((values << np.uint64(64 - _SHIFT)) | (values >> np.uint64(_SHIFT)))
        at = np.searchsorted(keys, _EDGES[:-1] << np.uint64(64 - _SHIFT))
        ends = np.append(at[1:], len(keys))
        full = ends > at
        least = keys[at[full]]
        out[full] = (least % np.uint64(65535)).astype(np.uint16) + 1
    return out


def to_text(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u2")


def fingerprint(text: str) -> str:
    phrases = Phrases()
    phrases.parse(text)
    return to_text(signature(phrases.hashes()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of two phrase sets, 0 to 1; two empty sets are alike."""
    used = (a != 0) | (b != 0)
    n = int(used.sum())
    if not n:
        return 1.0
    share, chance = float(((a == b) & used).sum()) / n, 1 / 65535
    return min(1.0, max(0.0, (share - chance) / (1 - chance)))


def with_fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """All columns plus `out_col`; null counts as empty (whose fingerprint is all zeros)."""

    @F.pandas_udf("string")
    def of(texts):
        return texts.map(lambda t: fingerprint(t or ""))

    return docs.withColumn(out_col, of(F.coalesce(F.col(text_col), F.lit(""))))


def _buckets(ids: DataFrame, n: int) -> tuple[F.Column, list]:
    """A column that cuts the order by (id, h) into about n even ranges (null first), and for
    each range in use: (range, is not null, id, h) of its first row. ids: id, and h from 0 to
    2^63 - 1. An id that holds several ranges' rows is cut by h."""
    shares = [k / n for k in range(1, n)] or [0.5]
    row = ids.agg(F.percentile_approx("id", shares, 10_000).alias("cuts"), F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
    found = row["cuts"] or []
    cuts = sorted(set(found))
    times = [1 + row["nulls"] * n // max(1, row["n"]), *(found.count(c) for c in cuts)]
    bucket, held = F.lit(0), F.col("id").isNull()
    if cuts:
        # Binary search: from the largest power of two down, step on while the cut is not above.
        edges = F.array(*(F.lit(c) for c in cuts))
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))

        def step(at, size):
            to = at + size
            return F.when((to <= len(cuts)) & (F.get(edges, F.least(to, F.lit(len(cuts))) - 1) <= F.col("id")), to).otherwise(at)

        bucket = F.when(F.col("id").isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), step))
        held = held | F.coalesce(F.get(edges, bucket - 1) == F.col("id"), F.lit(False))
    parts = F.get(F.array(*map(F.lit, times)), bucket)
    part = F.when(held, F.shiftright(F.shiftright("h", 32) * parts, 31)).otherwise(parts)
    bucket = bucket * (max(times) + 1) + part.cast("int")
    least = ids.groupBy(bucket.alias("b")).agg(F.min(F.struct(F.col("id").isNotNull().alias("set"), "id", "h")).alias("m"))
    return bucket, sorted(((r["b"], r["m"]["set"], r["m"]["id"], r["m"]["h"]) for r in least.collect()), key=lambda r: r[0])


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: `id_col`, n_chars long, edited_sha256, fingerprint,
    edited_fingerprint string, near_edited, near_next double.

    The edited text ends, for the last quarter of its code points (rounded down), in the
    first as many (or all) of the next row's text; next goes by id (nulls first; equal ids
    by a hash of the text, then the text), and after the last comes the first. A single row is
    its own next. Null texts count as empty. Texts move once: ranges of that order are dealt
    out, each with a copy of the first row of the range after it; rows of one id are cut into
    several ranges where they are many, rows equal in id and text stay in one (which streams).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("h"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucket, heads = _buckets(rows.select("id", "h"), 2 * parts)
    if not heads:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    before = [heads[k - 1][0] for k in range(len(heads))]
    table = spark.createDataFrame([(b, p, i, h) for (b, _, i, h), p in zip(heads, before)], f"b int, previous int, first {docs.schema[id_col].dataType.simpleString()}, least long")
    own = rows.withColumn("b", bucket)
    starts = (F.col("h") == F.col("least")) & F.col("id").eqNullSafe(F.col("first"))
    ahead = own.join(F.broadcast(table), "b").where(starts).groupBy("previous").agg(F.first("id").alias("id"), F.min("text").alias("text"), F.first("h").alias("h"))
    dealt = (
        own.select("b", F.lit(0).alias("ahead"), "id", "text", "h")
        .union(ahead.select(F.col("previous"), F.lit(1), "id", "text", "h"))
        .repartition(parts, "b")
        .sortWithinPartitions("b", "ahead", F.col("id").asc_nulls_first(), "h", "text")
        .drop("h")
    )

    def work(batches):
        out: list[tuple] = []
        last = None  # the row that waits for its next: (bucket, id, text, what parsed gives)
        closed = None  # the bucket whose last row has met its next

        def parsed(text):
            k, phrases = len(text) - len(text) // 4, Phrases()
            pending = phrases.parse(text[:k])
            at = len(phrases.marks) - 1, pending
            phrases.parse(text[k:], pending)
            return k, at, phrases, signature(phrases.hashes())

        def finish(row, text, sig):
            _, i, mine, (k, (n, pending), phrases, own_sig) = row
            tail = text[: len(mine) - k]
            edited = phrases.until(n)
            edited.parse(tail, pending)
            changed = signature(edited.hashes())
            digest = hashlib.sha256((mine[:k] + tail).encode("utf-8")).hexdigest()
            out.append((i, len(mine), digest, to_text(own_sig), to_text(changed), likeness(own_sig, changed), likeness(own_sig, sig)))

        for batch in batches:
            for b, is_ahead, i, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if b == closed:
                    continue  # further copies of a row ahead
                details = parsed(text)
                if last is not None:
                    finish(last, text, details[3])
                last = None if is_ahead else (b, i, text, details)
                closed = b if is_ahead else None
                if len(out) >= 256:
                    yield as_batch(out)
                    out = []
        if out:
            yield as_batch(out)

    fields = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def as_batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return dealt.mapInArrow(work, schema).withColumnRenamed("id", id_col)
