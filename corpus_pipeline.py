"""A training-data pipeline: language ID, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read back as the next stage's docs. All but the last return the columns of docs, in order.
docs have doc_id, text and lang; all other columns, whatever their names, pass through as they
are (but for n_chars, if there, which follows a text that is cut). Null texts count as empty;
null and repeated ids, ties and repeated rows are settled as each stage says; texts are handled
whole, however long; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.llm import langid, neardup, packing, substrings
from tipoff.llm.common import settle, small_batches, table

#: Below this share of known n-grams a text is in none of the learnt languages; lower for a
#: language whose own held-back rows score low.
LEAST_SCORE = 0.3


def _carried(docs: DataFrame) -> DataFrame:
    """id, text, lang and, as one struct, all columns but the text: no name of docs can meet
    one of an operator's."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")
    return docs.select("doc_id", "text", "lang", rest)


def _as_given(found: DataFrame, docs: DataFrame, **changed: F.Column) -> DataFrame:
    """The columns of docs, out of `rest` but for the text and those given."""
    own = {"text": F.col("text"), **changed}
    return found.select(*(own.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that no learnt language explains. Without
    any labelled document nothing can be judged, and only the former go. Rows of a null id are
    judged, never learnt from; each row is judged by its text alone, so repeated ones alike."""
    small_batches(spark)
    carried = _carried(docs)
    labelled = carried.select("doc_id", "text", "lang")
    learnable = langid.learnable(labelled)
    filters = langid.fit(labelled.where(learnable))
    judged = langid.predict(carried.select("text", "rest", F.col("text").rlike(r"\p{L}").alias("has_letter")), filters).where("has_letter")
    if filters.languages:
        least = settle(langid.least_scores(labelled.where(~learnable), filters, LEAST_SCORE), "least")
        judged = judged.join(F.broadcast(least), "lang_pred").where("score >= least")  # a row for each language
    return _as_given(judged, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the least id (null ids last); of
    different texts of the class that share this id, one, and of equal rows of it, one."""
    small_batches(spark)
    carried = _carried(docs)
    firsts = neardup.firsts(carried.select("doc_id", "text")).select(F.col("id").alias("first_id"), "node")
    keyed = carried.select("doc_id", "text", "rest", neardup.node_of(F.col("text")).alias("key"))
    same = (F.col("key") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    return _as_given(keyed.join(firsts, same, "left_semi").dropDuplicates(["key"]), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a document with a smaller id holds go; characters
    cut by a passage's edge go with it. Every document stays, with what is left of it. A null
    id is smaller than all others; rows of one id take nothing from one another."""
    small_batches(spark)
    left = substrings.remove_repeats(_carried(docs).select("doc_id", "text", "rest"), as_text=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        cut = F.length(text).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.size("spans") > 0, cut).otherwise(F.col("rest.n_chars"))
    return _as_given(left, docs, **changed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in as few sequences of 2048 tokens as best fit makes; columns of
    docs but doc_id and text end here. Null and repeated ids are packed row by row."""
    small_batches(spark)
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("pack", pack),
]

#: SQL can express none of the four stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
