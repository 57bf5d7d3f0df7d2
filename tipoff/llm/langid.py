"""Language identification with bit-sliced Bloom filters of character n-grams.

Every cell of a table holds a bitmask with a bit per language (a table for each 64 of them); the AND of the cells that an
n-gram hashes to gives all languages whose filter holds it. A text's n-grams are counted per
language by those bits, the counts are corrected for each filter's false positives, and the
language with most decides.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import settle, tidy

N = 4
PROBES = 3
#: An n-gram takes part if two rows of a language have it and they are this part of its rows, or
#: if they are a hundredth; this bounds the model, whatever the number of rows.
RARE = 1 / 3_000
#: Cells of a table: a power of two that has CELLS_EACH for each n-gram of the largest filter,
#: within these bounds.
CELLS_EACH, CELL_BITS = 10, (16, 23)
#: An n-gram belongs to a language if the share of that language's rows with it is at least
#: this part of the largest share among languages.
SHARE = 0.5

_LETTERS = None


def letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a blank."""
    global _LETTERS
    if _LETTERS is None:
        is_letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), dtype=bool, count=0x110000)
        _LETTERS = np.where(is_letter, np.arange(0x110000), 32).astype(np.uint32)
    return _LETTERS


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each n-gram, its 64-bit hash, letters per row) of whole texts: lower case,
    every run of other characters one blank, a blank at both ends."""
    texts = [f" {t.lower()} " for t in texts]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    codes = letters()[np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)]
    row = np.repeat(np.arange(len(texts)), sizes)
    blank = codes == 32
    drop = np.zeros(len(codes), dtype=bool)
    drop[1:] = blank[1:] & blank[:-1] & (row[1:] == row[:-1])
    count = np.bincount(row[~blank], minlength=len(texts))
    codes, row = codes[~drop].astype(np.uint64), row[~drop]
    if len(codes) < N:
        return np.empty(0, np.int64), np.empty(0, np.uint64), count
    whole = row[N - 1 :] == row[: len(row) - N + 1]
    h = np.zeros(len(codes) - N + 1, dtype=np.uint64)
    for k in range(N):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - N + 1 + k]
    h, row = h[whole], row[: len(row) - N + 1][whole]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return row, h, count


def cells(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (h * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)[probe])) >> np.uint64(64 - bits)


class Filters:
    """The learnt model: languages, a cell table for each 64 of them, and each filter's
    false-positive rate."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table
        self.bits = table.shape[1].bit_length() - 1
        fill = np.array([float(self.bit(table[k // 64], k).mean()) for k in range(len(languages))])
        self.chance = fill**PROBES

    @staticmethod
    def bit(mask: np.ndarray, k: int) -> np.ndarray:
        return (mask >> mask.dtype.type(k % 64)) & mask.dtype.type(1)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        row, h, n_letters = grams(texts)
        if not self.languages or not len(texts):
            return ["und"] * len(texts), np.zeros(len(texts))
        total = np.bincount(row, minlength=len(texts)).astype(float)
        places, hits = [cells(h, k, self.bits) for k in range(PROBES)], []
        for word, table in enumerate(self.table):
            mask = table[places[0]]
            for place in places[1:]:
                mask &= table[place]
            hits += [np.bincount(row, weights=self.bit(mask, k), minlength=len(texts)) for k in range(word * 64, min(word * 64 + 64, len(self.languages)))]
        hits = np.stack(hits)
        true = np.maximum(0, hits - total * self.chance[:, None]) / (1 - self.chance[:, None])
        best = true.argmax(axis=0)
        score = np.clip(true.max(axis=0) / np.maximum(total, 1), 0, 1)
        named = [self.languages[b] if n else "und" for b, n in zip(best, n_letters)]
        return named, np.where(n_letters > 0, score, 0.0)


def learnable(docs: DataFrame) -> F.Column:
    """Rows that may be learnt from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


def sampled(docs: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", fit_rows: int | None = None, fit_chars: int | None = None) -> DataFrame:
    """(label, text): every row; where a bound is given, of each label about `fit_rows` rows and
    `fit_chars` characters at most, by a hash of id and text, and always the row of least hash.
    Texts stay whole; rows without label or text are left out, and rows of a bounded sample
    that repeat id and text count once."""
    known = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("place"))
    if fit_rows is None and fit_chars is None:
        return known.select("label", "text")
    sizes = known.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min("place").alias("least"))
    bounds = [fit_rows / F.col("n")] * (fit_rows is not None) + [fit_chars / F.greatest(F.col("chars"), F.lit(1))] * (fit_chars is not None)
    share = F.least(F.lit(1.0), F.lit(1.0), *bounds)
    # A row for each label, however many documents there are.
    held = known.join(F.broadcast(sizes.select("label", "least", F.ceil(share * (1 << 30)).alias("limit"))), "label")
    return held.where((F.pmod("place", F.lit(1 << 30)) < F.col("limit")) | (F.col("place") == F.col("least"))).dropDuplicates(["label", "place"]).select("label", "text")


def fit(docs: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", fit_rows: int | None = None, fit_chars: int | None = None) -> Filters:
    """Learns filters from all rows of docs with text and label (of a bounded sample, if bounds
    are given: see `sampled`), of all languages: every n-gram that is not rare takes part, and
    tables have room for them. Bits are set by a distributed OR; only cells in use reach the
    driver. A language without any n-gram has an empty filter.
    """
    spark = docs.sparkSession
    sample = sampled(docs, label_col, text_col, id_col, fit_rows, fit_chars)
    sample = sample if fit_rows is None and fit_chars is None else settle(sample, "sample")
    taken = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    languages = sorted(taken)
    if not languages:
        return Filters([], np.zeros((0, 1 << CELL_BITS[0]), np.uint8))
    codes = spark.createDataFrame([(n, k, taken[n]) for k, n in enumerate(languages)], "label string, lang int, taken long")

    def work(batches):
        tidy("langid")
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), dtype=np.int32), batch.column(1).to_pylist()
            for k in np.unique(langs):
                held = []
                for i in np.flatnonzero(langs == k):
                    held.append(np.unique(grams([texts[i]])[1]))
                values, counts = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, dtype=np.int32)), pa.array(values.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "docs"])
        tidy()

    seen = sample.join(F.broadcast(codes), "label").select("lang", "text").mapInArrow(work, "lang int, gram long, docs long").groupBy("gram", "lang").agg(F.sum("docs").alias("docs"))
    share = F.col("docs") / F.col("taken")
    shares = settle(seen.join(F.broadcast(codes.select("lang", "taken")), "lang").withColumn("share", share).where(((F.col("docs") >= 2) & (F.col("share") >= RARE)) | (F.col("share") >= 0.01)).select("gram", "lang", "share"), "grams")
    top = shares.groupBy("gram").agg(F.max("share").alias("top"))
    fair = settle(shares.join(top, "gram").where(F.col("share") >= SHARE * F.col("top")).select("gram", "lang"), "fair")
    most = max((r["count"] for r in fair.groupBy("lang").count().collect()), default=1)
    bits = min(CELL_BITS[1], max(CELL_BITS[0], (CELLS_EACH * most - 1).bit_length()))

    def place(batches):
        for batch in batches:
            h, lang = batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy()
            bit = pa.array((np.uint64(1) << (lang % 64).astype(np.uint64)).astype(np.int64))
            for k in range(PROBES):
                yield pa.RecordBatch.from_arrays([pa.array(cells(h, k, bits).astype(np.int32)), pa.array(lang // 64), bit], names=["cell", "word", "bit"])

    held = fair.mapInArrow(place, "cell int, word int, bit long").groupBy("cell", "word").agg(F.bit_or("bit").alias("bits")).toArrow()
    dtype = next(t for t, wide in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(languages) <= wide or wide == 64)
    table = np.zeros((-(-len(languages) // 64), 1 << bits), dtype=dtype)
    table[held.column("word").to_numpy(), held.column("cell").to_numpy()] = held.column("bits").to_numpy().astype(np.uint64).astype(dtype)
    return Filters(languages, table)


def least_scores(docs: DataFrame, filters: Filters, highest: float, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(lang_pred, least): for each learnt language, the score below which a text is not taken
    for it: half of what all but one in a hundred of its rows in docs reach (rows that the
    filters were not learnt from, all of them), and `highest` at most."""
    judged = predict(sampled(docs, label_col, text_col, id_col), filters, "text").where("label = lang_pred")
    found = judged.groupBy("lang_pred").agg(F.percentile_approx("score", 0.01, 10_000).alias("p"))
    every = docs.sparkSession.createDataFrame([(n,) for n in filters.languages], "lang_pred string")
    return every.join(found, "lang_pred", "left").select("lang_pred", F.least(F.lit(highest), F.col("p") / 2).alias("least"))


def predict(docs: DataFrame, filters: Filters, text_col: str = "text", chars: int = 300_000) -> DataFrame:
    """All columns of docs plus lang_pred string and score double (0 to 1: the corrected
    share of the text's n-grams that the language's filter holds).

    Null texts and texts without a letter are `und` with score 0; ties go to the language
    first in alphabetical order; whole texts count, in groups of about `chars` characters.
    Columns named lang_pred and score are replaced. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.table))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    base = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = base.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    at = kept.index(text_col)
    built: dict = {}

    def work(batches):
        tidy("langid")
        if "model" not in built:
            built["model"] = Filters(*shared.value)
        model = built["model"]
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            named: list[str] = []
            scores: list[np.ndarray] = []
            start, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= chars or i == len(texts) - 1:
                    a, b = model.predict(texts[start : i + 1])
                    named += a
                    scores.append(b)
                    start, size = i + 1, 0
            score = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(named, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])
        tidy()

    return base.mapInArrow(work, schema)
