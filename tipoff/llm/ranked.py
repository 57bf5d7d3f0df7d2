"""Ranked lexical search by the threshold algorithm over segments of an impact-sorted index.

A pass over the texts writes a forward index: for each document its length and the counts of
the terms that any item asks for. Document frequencies and lengths are summed over it. Then each
task cuts its part of the index into segments; a segment has, for each term, its documents in
order of impact. For an item the lists of its terms are read in turn, deeper and deeper; each
document met is looked up in the forward index and scored whole. When the sum of what comes next
in the lists is below the k-th best score so far (of this and earlier segments of the task), no
unseen document can be among the best, and the segment is left.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff.llm.common import settle, shared_dir, small_batches, tidy

#: Item texts that are searched for at once, in bytes; more go in several passes.
BLOCK_BYTES = 8 << 20
#: Postings of a segment, and of the first step down its lists.
SEGMENT, STEP = 1 << 20, 16
#: A document's k in the impact of a term is 12/1000 of m = 100 - 25 + 25 * length / mean.
ONE, SATURATION = 1_000_000_000, 12

#: What is no part of a term becomes a blank; A-Z become a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def forward_index(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """id, n long (terms of the text), terms, counts array<int>: numbers of the vocabulary's
    terms that the document holds, ascending, and how often. Documents without terms have n 0."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        number = {t: k for k, t in enumerate(sent.value)}
        for batch in batches:
            sizes, offsets, terms, counts = [], [0], [], []
            for text in batch.column(1):
                found = terms_of(text.as_py())
                sizes.append(len(found))
                held = sorted((number[t], c) for t, c in Counter(filter(number.__contains__, found)).items())
                terms += [t for t, _ in held]
                counts += [c for _, c in held]
                offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "counts"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(work, f"id {kind}, n long, terms array<int>, counts array<int>")


class Segment:
    """Lists of some documents by term and falling impact, and their forward index."""

    def __init__(self, ids: pa.Array, sizes, term, count, per_doc, n_docs: int, n_terms: int):
        m = 75 + 25 * sizes * n_docs // n_terms
        self.doc = np.repeat(np.arange(len(sizes)), per_doc)
        self.term, self.start = term, np.append(0, np.cumsum(per_doc))
        self.impact = ONE * count // (1000 * count + SATURATION * m[self.doc])
        order = np.lexsort((-self.impact, term))
        self.by_doc, self.by_impact = self.doc[order], self.impact[order]
        self.lists = np.searchsorted(term[order], np.arange(term.max(initial=-1) + 2))
        self.seen = np.zeros(len(sizes), dtype=bool)
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids

    def score(self, docs, weight):
        """Forward look-ups: the whole score of each of the documents."""
        size = self.start[docs + 1] - self.start[docs]
        ends = np.cumsum(size)
        at = np.repeat(self.start[docs] - (ends - size), size) + np.arange(ends[-1])
        return np.add.reduceat(weight[self.term[at]] * self.impact[at], ends - size)

    def search(self, terms, weight, best: Best) -> int:
        """Puts the documents of the highest scores into `best`; how many were looked up."""
        terms = terms[terms < len(self.lists) - 1]
        a, b = self.lists[terms], self.lists[terms + 1]
        terms, a, b = terms[a < b], a[a < b], b[a < b]
        w, depth, step = weight[terms], 0, STEP
        self.seen[:] = False
        looked_up = 0
        while True:
            left = np.minimum(a + depth, b)
            next_ = np.where(left < b, self.by_impact[np.minimum(left, len(self.by_impact) - 1)], 0)
            threshold = int((w * next_).sum())
            if threshold == 0 or threshold < best.least():
                return looked_up
            size = np.minimum(left + step, b) - left
            ends = np.cumsum(size)
            met = np.unique(self.by_doc[np.repeat(left - (ends - size), size) + np.arange(ends[-1])])
            met = met[~self.seen[met]]
            self.seen[met] = True
            if len(met):
                looked_up += len(met)
                best.add(self.score(met, weight), met, self)
            depth, step = depth + step, step * 2


class Best:
    """The k highest scores above 0 and their ids; equal scores by id, null first."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.k else 0

    def add(self, scores, docs, segment: Segment) -> None:
        keep = scores >= max(1, self.least())
        if not keep.any():
            return
        scores, docs = scores[keep], docs[keep]
        if len(docs) > 4 * self.k:  # ties with the k-th stay
            floor = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, docs = scores[scores >= floor], docs[scores >= floor]
        ids = segment.ids.take(pa.array(docs)).to_pylist()
        new = zip(scores.tolist(), ids)
        self.rows = sorted(itertools.chain(self.rows, new), key=lambda r: (-r[0], r[1] is not None, r[1] if r[1] is not None else 0))[: self.k]


def _ranked(index: DataFrame, wanted: list[tuple[int, list[int], list[int]]], n_vocabulary: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item int, id, score long: the k best of each task for each item. wanted: number of the
    item, its terms and their weights."""
    sent = index.sparkSession.sparkContext.broadcast([(i, np.array(t, dtype=np.int64), np.array(w, dtype=np.int64)) for i, t, w in wanted])
    kind = index.schema["id"].dataType.simpleString()

    def segments(batches):
        held, postings = [], 0
        for batch in batches:
            held.append(batch)
            postings += len(batch.column(2).flatten())
            if postings >= SEGMENT:
                yield held
                held, postings = [], 0
        if held:
            yield held

    def work(batches):
        best = {i: Best(k) for i, _, _ in sent.value}
        weight = np.zeros(n_vocabulary, dtype=np.int64)
        arrow = None
        for held in segments(batches):
            joined = pa.Table.from_batches(held).combine_chunks()
            ids, sizes, terms, counts = (joined.column(c).combine_chunks() for c in range(4))
            arrow = ids.type
            per_doc = terms.value_lengths().to_numpy()
            segment = Segment(ids, sizes.to_numpy(), terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64), per_doc, n_docs, n_terms)
            for item, asked, w in sent.value:
                weight[asked] = w
                segment.search(asked, weight, best[item])
                weight[asked] = 0
            del segment, joined
            tidy()
        rows = [(item, i, s) for item, b in best.items() for s, i in b.rows]
        if rows:
            item, ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, arrow), pa.array(scores, pa.int64())], names=["item", "id", "score"])

    return index.select("id", "n", "terms", "counts").where("n > 0").mapInArrow(work, f"item int, id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`item_col`, rank int, `id_col`, score long: the k documents of the highest scores above
    0 for each item, equal scores by ascending id (nulls first).

    Null texts hold no terms; a document without terms counts in no figure; rows with one id
    (or none) are documents of their own, and rows that tie in score and id take any of their
    ranks; rows with one item id are one item with all their terms; items without a term that
    a document holds, and all items over an empty table, have no rows. Other columns are not
    read. Long texts are read whole. Items are searched for in blocks of about `block_bytes`;
    only a block's terms, and what is counted of them, are sent about.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = F.struct(F.col(f"`{item_col}`").alias("item_id"))
    asked = items.select(key.alias("key"), F.col(f"`{item_text_col}`").alias("text")).where("text is not null")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    kinds = {"item": items.schema[item_col].dataType.simpleString(), "id": docs.schema[id_col].dataType.simpleString()}
    out = spark.createDataFrame([], f"item_id {kinds['item']}, rank int, id {kinds['id']}, score long")
    for block in range(blocks):
        texts: dict = {}
        for r in asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).collect():
            texts.setdefault(r["key"]["item_id"], Counter()).update(terms_of(r["text"]))
        vocabulary = sorted(set().union(*texts.values())) if texts else []
        if not vocabulary:
            continue
        index = settle(forward_index(docs, vocabulary, id_col, text_col), "index")
        sizes = index.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        if not sizes["docs"]:
            continue
        held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        idf = F.floor(1000 * F.log((2.0 * sizes["docs"] + 2) / (2.0 * F.col("df") + 1)))
        weights = {vocabulary[r["term"]]: (r["term"], r["w"]) for r in held.select("term", idf.cast("long").alias("w")).collect()}
        names, wanted = [], []
        for item, (name, terms) in enumerate(texts.items()):
            pairs = sorted((weights[t][0], weights[t][1] * c) for t, c in terms.items() if t in weights and weights[t][1])
            if pairs:
                names.append((item, name))
                wanted.append((item, [t for t, _ in pairs], [w for _, w in pairs]))
        if not wanted:
            continue
        named = F.broadcast(spark.createDataFrame(names, f"item int, item_id {kinds['item']}"))
        found = _ranked(index, wanted, len(vocabulary), sizes["docs"], sizes["terms"], k)
        # Tasks' bests meet by item in two steps, so that no task gets those of all tasks.
        best = F.desc("score"), F.asc_nulls_first("id")
        first = Window.partitionBy("item", "part").orderBy(*best)
        last = Window.partitionBy("item").orderBy(*best)
        some = found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        ranked = some.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
        out = out.union(ranked.join(named, "item").select("item_id", "rank", "id", "score"))
    return out.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
