"""Token counts of whole texts without ids: pieces are counted once per distinct pre-token.

1. Distinct pre-tokens of the corpus with their document frequency (combined per task, then
   one shuffle), each counted once by the tokenizer.
2. Per-document pre-token frequencies. The commonest pre-tokens, at most `head` of them,
   are a table that every task holds (a bounded broadcast); all others join by a shuffle on
   the pre-token. Which pre-tokens are in the head changes the cost only, not the counts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.bytebpe import PreTokenizer, built, library, read_file
from tipoff.llm.common import kept, settle

#: Pre-tokens that go to every task at most.
HEAD = 1 << 17
#: Distinct pre-tokens that a task gathers before it hands them on.
FLUSH = 150_000


def distinct_pretokens(docs: DataFrame, spec, text_col: str) -> DataFrame:
    """(piece, docs): each distinct pre-token with the number of rows that hold it."""

    def work(batches):
        splitter = built(PreTokenizer, spec.value)
        found: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["piece", "docs"])
            found.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    found.update(set(splitter.split(text)))
                    if len(found) > FLUSH:
                        yield flush()
        yield flush()

    parts = docs.select(F.col(text_col)).mapInArrow(work, "piece string, docs long")
    return parts.groupBy("piece").agg(F.sum("docs").alias("docs"))


def count_pieces(pretokens: DataFrame, spec) -> DataFrame:
    """Adds `pieces`: how many tokens the pre-token is, counted by the library."""

    @F.pandas_udf("int")
    def pieces(values):
        tokenizer = built_library(spec.value)
        return values.__class__([len(x.ids) for x in tokenizer.encode_batch_fast(values.tolist(), add_special_tokens=False)], dtype="int32")

    return pretokens.withColumn("pieces", pieces("piece"))


def built_library(spec: str):
    return kept("bytebpe", ("library", hash(spec)), lambda: library(spec))


def head_of(counted: DataFrame, head: int) -> dict[str, int]:
    """The commonest pre-tokens, at most `head`: a floor on document frequency is found from
    a histogram of its logarithm, so that no sort and no large result reach the driver."""
    level = F.floor(F.log2("docs") * 16).cast("int")
    room, floor = head, None
    for row in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if row["count"] > room:
            break
        room, floor = room - row["count"], row["level"]
    if floor is None:
        return {}
    return {r["piece"]: r["pieces"] for r in counted.where(level >= floor).select("piece", "pieces").collect()}


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per row of docs: `id_col`, n_bytes long, n_tokens long.

    Null and empty texts have 0 bytes and 0 tokens. Rows with the same id, or repeated
    whole, each keep a row of their own; a null id stays null; columns other than the two
    named are not read; an empty table gives no rows. A long text is handled whole.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_file(tokenizer_path))
    counted = settle(count_pieces(distinct_pretokens(docs, spec, text_col), spec), "pieces")
    common = spark.sparkContext.broadcast(head_of(counted, head))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))

    def work(batches):
        # The row of a document itself has a key that no pre-token can be: pre-tokens never
        # hold white space before a digit, but for one leading blank.
        splitter, known = built(PreTokenizer, spec.value), common.value
        for batch in batches:
            row_of, id_of, size_of, text_of = (batch.column(k).to_pylist() for k in range(4))
            keys, rows_, ids, sizes, counts = [], [], [], [], []
            for row, i, size, text in zip(row_of, id_of, size_of, text_of):
                total, rest = 0, 0
                if text:
                    for piece, n in Counter(splitter.split(text)).items():
                        found = known.get(piece)
                        if found is None:
                            keys.append(piece)
                            counts.append(n)
                            rest += 1
                        else:
                            total += n * found
                keys.append(f"  {row}")
                counts.append(total)
                rows_ += [row] * (rest + 1)
                ids += [None] * rest + [i]
                sizes += [None] * rest + [size]
                if len(keys) > 50_000:
                    yield batch_of(keys, rows_, ids, sizes, counts)
                    keys, rows_, ids, sizes, counts = [], [], [], [], []
            yield batch_of(keys, rows_, ids, sizes, counts)

    def batch_of(keys, rows_, ids, sizes, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.array(rows_, dtype=np.int64)), pa.array(ids, pa.string()), pa.array(sizes, pa.int64()), pa.array(np.array(counts, dtype=np.int64))], names=["piece", "row", "id", "n_bytes", "n"])

    frequencies = rows.mapInArrow(work, "piece string, row long, id string, n_bytes long, n long")
    # A document's own row has its size and stands for tokens; every other must have met its piece.
    missed = F.raise_error(F.lit("a pre-token without a count")).cast("int")
    known = F.when(F.col("n_bytes").isNotNull(), 1).otherwise(F.coalesce("pieces", missed))
    joined = frequencies.join(counted.select("piece", "pieces"), "piece", "left")
    return (
        joined.groupBy("row")
        .agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * known).alias("n_tokens"))
        .select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_tokens")
    )
