"""Best-fit packing planned on the histogram of lengths.

Best-fit decreasing depends only on how many pieces have each length, so it runs on the
counts (at most `capacity` of them) and yields runs: "the pieces of this length with ranks
a to b go to sequences s to s + b - a at offset o". Pieces find their run by length and rank.
"""

from __future__ import annotations

import bisect
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff.llm.bytebpe import byte_letters, library, read_file
from tipoff.llm.common import kept, settle, tidy

CAPACITY = 2048
CACHE_ENTRIES = 100_000


#: Marks that may follow a word; no apostrophe, which the pre-tokeniser can join to letters.
MARKS = ".,;:!?%$#*&|()[]{}\"<>/=+-_~^@`\\"


class ChunkEncoder:
    """Ids of whole texts as little-endian uint32 bytes, for vocabularies whose pre-tokeniser
    drops white space: what stands between white space is encoded once by the library.

    A chunk of letters and then marks is two pre-tokens, so its word goes to the library's
    model by itself and is remembered without marks and case; other chunks go whole.
    """

    def __init__(self, spec: str):
        self.library = library(spec)
        self.model = self.library.model
        self.normal = self.library.normalizer.normalize_str
        self.letters = byte_letters()
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}
        self.strict = regex.compile(r"\P{White_Space}+")
        self.odd = regex.compile("[\x1c-\x1f]")  # str.split() takes these for white space

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            mapped = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            found = self.words[word] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return found

    def _learn(self, chunks: set) -> None:
        whole = []
        for c in chunks:
            core = c.rstrip(MARKS)
            word = core.lower() if core.isascii() else self.normal(core)
            if word.isalpha() and core.isalpha():
                self.cache[c] = self._word(word) + self._word(c[len(core) :])
            else:
                whole.append(c)
        for c, e in zip(whole, self.library.encode_batch_fast(whole, add_special_tokens=False)):
            self.cache[c] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_ENTRIES or len(self.words) > CACHE_ENTRIES:
            self.cache, self.words = {}, {"": b""}
        cache, out = self.cache, []
        for text in texts:
            chunks = self.strict.findall(text) if self.odd.search(text) else text.split()
            try:
                out.append(b"".join(map(cache.__getitem__, chunks)))
            except KeyError:
                self._learn(set(chunks).difference(cache))
                out.append(b"".join(map(cache.__getitem__, chunks)))
        return out


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: `id_col`, piece int, start long, length int, ids_le binary (unsigned
    little-endian 32-bit ids).

    A document is its ids and then `end_id`; only documents of over `capacity` ids are cut,
    each piece but the last to exactly that. A null text counts as empty: one piece, the end
    id. Repeated rows give repeated pieces; an empty table gives none. The tokenizer must
    drop white space (checked).
    """
    spec_text = read_file(tokenizer_path)
    check_drops_space(spec_text)
    spec = docs.sparkSession.sparkContext.broadcast(spec_text)
    end, step = array("I", [end_id]).tobytes(), 4 * capacity
    chosen = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        tidy("packing")
        encoder = kept("packing", hash(spec.value), lambda: ChunkEncoder(spec.value))
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                owner, number, parts = [], [], []
                for row, ids in enumerate(encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                    ids += end
                    n = -(-len(ids) // step)
                    owner += [row] * n
                    number += range(n)
                    parts += [ids] if n == 1 else [ids[p : p + step] for p in range(0, len(ids), step)]
                number = np.array(number, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int32())), pa.array(number), pa.array(number.astype(np.int64) * capacity), pa.array([len(p) // 4 for p in parts], pa.int32()), pa.array(parts, pa.binary())],
                    names=["id", "piece", "start", "length", "ids_le"],
                )
        tidy()

    return chosen.mapInArrow(work, f"id {id_type}, piece int, start long, length int, ids_le binary").withColumnRenamed("id", id_col)


def check_drops_space(spec: str) -> None:
    split = next((p for p in json.loads(spec).get("pre_tokenizer", {}).get("pretokenizers", []) if p["type"] == "Split"), None)
    if split is None or split["behavior"] != "Removed" or not split["invert"]:
        raise ValueError("chunks are independent only if the pre-tokeniser drops white space")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, count, first sequence, offset).

    `room` keeps groups of sequences with the same space left. The tightest group that fits
    takes as many pieces per sequence as it holds, since after each piece its sequences are
    the tightest still.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # the keys of room, sorted
    opened = 0

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            if left not in room:
                room[left] = []
                bisect.insort(sizes, left)
            room[left].append((first, count))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} does not fit {capacity}")

        def fill(left: int, first: int, count: int) -> None:
            nonlocal todo, rank
            each = left // length
            full = min(count, todo // each)
            rest = min(each - 1, todo - full * each) if full < count else 0
            for n, start, k in ((full, first, each), (min(rest, 1), first + full, rest)):
                for slot in range(k if n else 0):
                    runs.append((length, rank, n, start, capacity - left + slot * length))
                    rank += n
                    todo -= n
                if n:
                    put(left - k * length, start, n)
            used = full + min(rest, 1)
            put(left, first + used, count - used if left < capacity else 0)

        while todo:
            k = bisect.bisect_left(sizes, length)
            if k < len(sizes):
                left = sizes[k]
                first, count = room[left].pop()
                if not room[left]:
                    del room[left], sizes[k]
                fill(left, first, count)
            else:
                each = capacity // length
                fresh = -(-todo // each)
                fill(capacity, opened, fresh)
                opened += fresh
    return runs


def rank_within(df: DataFrame, group: str, order: list[str], rank: str, salts: int) -> DataFrame:
    """Adds a gapless rank from 0 within each value of `group`, however large the group is:
    it is dealt to `salts` cells, rows are numbered within a cell, and the cells' counts,
    summed over the cells before, give the rest. Rows move once, by (group, cell)."""
    cell = F.pmod(F.xxhash64(*(F.col(c) for c in order)), F.lit(salts)).cast("int")
    df = df.withColumn("__cell", cell)
    before = Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = df.groupBy(group, "__cell").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = Window.partitionBy(group, "__cell").orderBy(*order)
    numbered = df.withColumn("__in", F.row_number().over(inside) - 1)
    return numbered.join(bases.select(group, "__cell", "__base"), [group, "__cell"]).withColumn(rank, F.col("__base") + F.col("__in")).drop("__cell", "__base", "__in")


def pack(pieces: DataFrame, order: list[str], length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """All columns of pieces plus sequence_id long and offset long.

    `order` names columns that tell rows apart; rows equal in all of them are still placed
    one by one, by one task of their length (pack_documents numbers rows to avoid that).
    Lengths must be 1 to `capacity` (others raise an error; a null length too).
    An empty table packs to an empty table. Columns named sequence_id and offset are replaced;
    other names may be any. The plan has at most a few runs per length and
    group of sequences: its size depends on `capacity`, not on the rows.
    """
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    by = [f"by{k}" for k in range(len(order))]
    slim = pieces.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("piece"), F.col(f"`{length_col}`").alias("length"), *(F.col(f"`{c}`").alias(b) for c, b in zip(order, by)))
    counted = slim.groupBy("length").agg(F.count("*").alias("n")).collect()
    runs = plan({r["length"]: r["n"] for r in counted}, capacity)
    planned = spark.createDataFrame(runs, "size long, first long, count long, sequence long, offset long")
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked = rank_within(slim, "length", by, "rank", salts)
    fits = (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count"))
    return ranked.join(F.broadcast(planned), fits).select("piece.*", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of documents, each with its place: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset. Ids stay where they were made; only their checksum and
    length take part in planning (token_pieces gives the ids). Pieces are numbered as they are
    written, so that any number of rows equal in all columns is ranked by many tasks."""
    pieces = token_pieces(docs, tokenizer_path, capacity=capacity)
    slim = settle(pieces.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids_le").alias("ids_crc32"), F.monotonically_increasing_id().alias("row")), "pieces")
    return pack(slim, ["doc_id", "piece", "ids_crc32", "row"], capacity=capacity).drop("row")
