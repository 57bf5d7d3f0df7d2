"""Exact substring dedup across documents by suffix arrays over shared contexts.

A byte goes if a string of `length` bytes that covers it also starts in a document with a
smaller id. Anchors make this a matter of small groups: in every such string the bytes of
least hash among its `gram`-byte windows are an anchor, so equal strings hold equal anchors
at equal offsets.

1. Documents are packed into blocks of some MB (written once; all later steps read those).
2. Each block sends the hashes of its anchors to hash buckets; a bucket answers which of
   them occur in more than one document.
3. Blocks send those anchors' contexts (all bytes that a string with the anchor can cover),
   each distinct context once with its least id. A bucket joins the contexts of an anchor
   into one symbol string, leaving out what all of them share, and sorts its suffixes by
   grouping; neighbours in that order with the same leading symbols are equal strings, and
   their least id goes back to the blocks.
4. Blocks mark the strings whose least id is below their own document's.

An anchor with very many different contexts (a line that stands in documents of all kinds) would
be one task's work in step 3. Buckets therefore also count contexts; of an anchor with HOT or
more, blocks send the strings themselves, each distinct one once with its least id, to buckets
of their own by the strings' hashes.

Every exchange carries compressed columns of anchors or contexts, not rows per position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import settle, tidy
from tipoff.llm.suffixes import suffix_array

LENGTH = 50
BLOCK_BYTES = 4 << 20
#: Text bytes per hash bucket; the number of buckets follows the corpus.
BUCKET_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).min
NEVER = np.iinfo(np.int64).max
_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOW = 17  # bits of a key that choose its bucket, at least
_MOST = 25  # and at most: 128 TB at BUCKET_BYTES
_HIGH = np.uint64((1 << 39) - 1)  # of the others, those that are sent beside a flag in 5 bytes
#: Contexts that are sorted at a time, about; those of one anchor always together.
SECTION = 1 << 14
#: Contexts of one anchor, about, from which its strings are sent instead.
HOT = 1 << 15
#: Occurrences of an anchor in a block that are counted beside its key (fewer count as one), and
#: from which on it is the different contexts that are counted.
OFTEN, RECOUNT = 4, 64
LEVEL = 9  # of compression: what is written is read over again or crosses the network


def _shrink(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True)


def _grown(data: bytes) -> int:
    return int.from_bytes(data[:8], "little")


def _grow(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=_grown(data), codec="zstd", asbytes=True)


def _sliding(take, values: np.ndarray, width: int) -> np.ndarray:
    """take (minimum or maximum) over every window of `width` values."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = take(out[:-have], out[have:]), have * 2
    return take(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def _hash(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _key(h: np.ndarray) -> np.ndarray:
    """Anchors have small hashes; their keys are even again."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_ODD)
    return h ^ (h >> np.uint64(29))


def _fold(rows: np.ndarray, factor: int = _ODD) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    out = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        out = (out ^ (out >> np.uint64(33))) * np.uint64(factor) + (rows[:, c].astype(np.uint64) + np.uint64(1))
    return out ^ (out >> np.uint64(32))


def _equal(whole: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each distinct row, number of its distinct one). Hashes find the equal ones;
    should rows of one hash differ, their bytes tell them apart."""
    _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
    if len(first) < len(rows) and any((rows[k : k + (1 << 14)] != rows[first[inverse[k : k + (1 << 14)]]]).any() for k in range(0, len(rows), 1 << 14)):
        _, first, inverse = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, inverse


class Shape:
    """Lengths that follow from the string length."""

    def __init__(self, length: int):
        self.length = length
        self.gram = max(1, length // 2 - 1)
        self.side = length - self.gram  # bytes of a string beside its anchor
        self.width = 2 * self.side + self.gram

    def anchors(self, data: np.ndarray, offsets: np.ndarray, slice_bytes: int = 1 << 18):
        """(position, 64-bit key, document) of each anchor in a block."""
        at, keys, owner, first, n = [], [], [], 0, len(offsets) - 1
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + slice_bytes, side="right")) - 1)
            p, k = self._anchors(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            p = p + offsets[first]
            at.append(p)
            keys.append(k)
            owner.append(np.searchsorted(offsets[first + 1 : last + 1], p, side="right") + first)
            first = last
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        return join(at, np.int64), join(keys, np.uint64), join(owner, np.int64)

    def _anchors(self, x, ends):
        n = len(x)
        if n < self.length:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h, have, powers = x.astype(np.uint64) + np.uint64(1), 1, {}
        powers[1] = h
        while have * 2 <= self.gram:
            h = h[:-have] * np.uint64(pow(_ODD, have, 1 << 64)) + h[have:]
            have *= 2
            powers[have] = h
        rest = self.gram - have
        for size in sorted(powers, reverse=True):  # lengths that are no power of two
            if rest >= size:
                tail = powers[size][have:]
                h = h[: len(tail)] * np.uint64(pow(_ODD, size, 1 << 64)) + tail
                have, rest = have + size, rest - size
        h = _hash(h)
        least = _sliding(np.minimum, h, self.side + 1)
        for end in ends[1:-1]:  # strings never cross documents
            least[max(0, end - self.length + 1) : end] = 0
        pad = np.zeros(self.side, np.uint64)
        chosen = np.flatnonzero((_sliding(np.maximum, np.concatenate([pad, least, pad]), self.side + 1) == h) & (h != 0))
        return chosen, _key(h[chosen])

    def contexts(self, data, offsets, at, owner) -> np.ndarray:
        """Bytes on both sides of each anchor within its document, and how many they are:
        uint8 columns left count, right count, then the context."""
        out = np.zeros((len(at), self.width + 2), np.uint8)
        column = np.arange(self.width, dtype=np.int32)
        for k in range(0, len(at), 1 << 13):  # a matrix of places for a few at a time
            a, o = at[k : k + (1 << 13)], owner[k : k + (1 << 13)]
            left = np.minimum(self.side, a - offsets[o])
            right = np.minimum(self.side, offsets[o + 1] - a - self.gram)
            where = np.clip((a - self.side).astype(np.int32)[:, None] + column, 0, len(data) - 1)
            inside = (column >= (self.side - left)[:, None]) & (column < (self.side + self.gram + right)[:, None])
            out[k : k + (1 << 13), 0], out[k : k + (1 << 13), 1] = left, right
            out[k : k + (1 << 13), 2:] = data[where] * inside
        return out

    def names(self, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of whole records, and the keys of their anchors."""
        anchor = np.zeros(len(records), np.uint64)
        for c in range(self.side + 2, self.side + 2 + self.gram):
            anchor = anchor * np.uint64(_ODD) + (records[:, c].astype(np.uint64) + np.uint64(1))
        return _fold(records), _key(_hash(anchor))

    def strings(self, records: np.ndarray, anchor: np.ndarray):
        """For each number of bytes before the anchor: it, the records that have such a string,
        and these strings, each after four bytes of its anchor's key."""
        left, right = records[:, 0].astype(np.int64), records[:, 1].astype(np.int64)
        tag = (anchor >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(-1, 4)
        for before in range(self.side + 1):
            fits = np.flatnonzero((before <= left) & (self.side - before <= right))
            begin = 2 + self.side - before
            yield before, fits, np.concatenate([tag[fits], records[fits, begin : begin + self.length]], axis=1)

    def different(self, data, offsets, at, owner, key) -> np.ndarray:
        """How many different contexts each key has, keys ascending; `key` is sorted."""
        whole = [self.names(self.contexts(data, offsets, at[k : k + (1 << 14)], owner[k : k + (1 << 14)]))[0] for k in range(0, len(at), 1 << 14)]
        number = np.cumsum(np.append(False, key[1:] != key[:-1]))
        whole = np.concatenate(whole)
        order = np.lexsort((whole, number))
        whole, number = whole[order], number[order]
        new = np.append(True, (whole[1:] != whole[:-1]) | (number[1:] != number[:-1]))
        return np.bincount(number[new])

    def distinct(self, records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each record, key of its anchor, first record of each distinct one, number of
        its distinct one)."""
        whole, anchor = self.names(records)
        return whole, anchor, *_equal(whole, records)

    def _longest(self, group: np.ndarray, sides: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """How much of its side (bytes outwards from the anchor) each record shares with some
        other record of its group, at most."""
        n = len(group)
        rows = np.concatenate([group.astype(">u8").view(np.uint8).reshape(n, 8), sides, sizes[:, None].astype(np.uint8)], axis=1)
        order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), kind="stable")
        x, have, own = sides[order], sizes[order], group[order]
        alike = (x[1:] == x[:-1]) & (np.arange(x.shape[1]) < np.minimum(have[1:], have[:-1])[:, None])
        same = np.where(own[1:] == own[:-1], np.logical_and.accumulate(alike, axis=1).sum(axis=1), 0)
        out = np.empty(n, np.int64)
        out[order] = np.maximum(np.append(same, 0), np.append(0, same)) if n else 0
        return out

    def least_ids(self, records: np.ndarray, ids: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """For distinct records and each number of bytes before the anchor (0 to side): the
        least id among records that hold the same string there; NEVER where there is none.

        Left out of the symbol string: what no other record of the anchor shares (no equal
        string reaches there) and what all of them share (it tells none apart). Anchors have
        nothing to do with each other, so some of them are worked on at a time.
        """
        out = np.empty((self.side + 1, len(records)), np.int64)
        order = np.argsort(anchor, kind="stable")
        by = anchor[order]
        starts = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.empty(0, np.int64)
        cuts = starts[np.unique(np.searchsorted(starts, np.arange(0, starts[-1] + 1, SECTION)))] if len(by) else starts
        for first, last in zip(cuts, np.append(cuts[1:], len(by))):
            pick = order[first:last]
            out[:, pick] = self._least(records[pick], ids[pick], by[first:last])
        return out

    def _least(self, records: np.ndarray, ids: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        side = self.side
        left, right, body = records[:, 0].astype(np.int64), records[:, 1].astype(np.int64), records[:, 2:]
        before = np.arange(side + 1)[:, None]
        out = np.where((before <= left) & (side - before <= right), ids, NEVER)
        far_left = self._longest(anchor, body[:, side - 1 :: -1] if side else body[:, :0], left)
        far_right = self._longest(anchor, body[:, side + self.gram :], right)
        live = np.flatnonzero(far_left + far_right >= side)
        # Records with the same anchor stand together, in the order of the anchors' keys.
        live = live[np.argsort(anchor[live], kind="stable")]
        if len(live):
            out[:, live] = np.minimum(out[:, live], self._sorted(body[live], ids[live], anchor[live], far_left[live], far_right[live]))
        return out

    def _sorted(self, body, ids, anchor, left, right) -> np.ndarray:
        n, side = len(body), self.side
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        group, firsts = np.cumsum(new) - 1, np.flatnonzero(new)
        head = firsts[group]

        def shared(columns, sizes):
            alike, out = np.ones(len(firsts), bool), np.zeros(len(firsts), np.int64)
            for k, c in enumerate(columns):
                alike &= np.logical_and.reduceat((body[:, c] == body[head, c]) & (k < sizes), firsts)
                out += alike
            return out[group]

        cut_right = shared(range(side + self.gram, self.width), right)
        cut_left = shared(range(side - 1, -1, -1), left)
        # One row of symbols per record: what is left of the left side, the anchor's own
        # symbol, what is left of the right side, and a stop. 0 ends the whole string.
        rows = np.empty((n, 2 * side + 2), np.int64)
        rows[:, :side], rows[:, side] = body[:, :side].astype(np.int64) + 2, 258 + group
        rows[:, side + 1 : -1], rows[:, -1] = body[:, side + self.gram :].astype(np.int64) + 2, 1
        column = np.arange(2 * side + 2)
        keep = (column >= (side - left)[:, None]) & (column < (side - cut_left)[:, None])
        keep |= (column == side) | (column == 2 * side + 1)
        keep |= (column > (side + cut_right)[:, None]) & (column <= (side + right)[:, None])
        symbols = np.append(rows[keep], 0)
        sizes = keep.sum(axis=1)
        middle = np.cumsum(sizes) - sizes + (left - cut_left)  # where each anchor's symbol is
        rank = np.empty(len(symbols), np.int64)
        rank[suffix_array(symbols)] = np.arange(len(symbols))
        out = np.full((side + 1, n), NEVER)
        for before in range(side + 1):
            after = side - before
            fits = np.flatnonzero((before <= left) & (after <= right))
            if not len(fits):
                continue
            own = np.maximum(0, before - cut_left[fits])
            begin = middle[fits] - own
            span = own + 1 + np.maximum(0, after - cut_right[fits])
            by = np.argsort(rank[begin], kind="stable")
            fits, begin, span = fits[by], begin[by], span[by]
            same = group[fits[1:]] == group[fits[:-1]]
            for k in range(int(span.max())):
                a, b = (symbols[np.minimum(x + k, len(symbols) - 1)] for x in (begin[:-1], begin[1:]))
                same &= (a == b) | (k >= span[1:])
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            out[before, fits] = np.repeat(np.minimum.reduceat(ids[fits], starts), np.diff(np.append(starts, len(fits))))
        return out


def _load(blob: bytes, id_col: str, text_col: str):
    """A block: its table, ids, bytes and document offsets."""
    table = pa.ipc.open_stream(blob).read_all()
    text = pc.fill_null(table.column(text_col).combine_chunks().cast(pa.large_binary()), b"")
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    raw = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.empty(0, np.uint8)
    ids = pc.fill_null(table.column(id_col).cast(pa.int64()), NO_ID).to_numpy()
    return table, ids, raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _blocks(docs: DataFrame, text_col: str) -> DataFrame:
    """(block, blob): consecutive rows of docs, with all columns, as one compressed table."""
    at = docs.columns.index(text_col)

    def work(batches):
        tidy("substrings")
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as w:
                w.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([f"{part}-{number}"]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "blob"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            first = 0
            for i, s in enumerate(sizes):
                size += int(s)
                if size >= BLOCK_BYTES:
                    held.append(batch.slice(first, i + 1 - first))
                    yield block()
                    number, held, size, first = number + 1, [], 0, i + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield block()
        tidy("substrings")

    return docs.mapInArrow(work, "block string, blob binary")


def _five(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _by_bucket(bucket: np.ndarray):
    """Stable order by bucket, and (bucket, slice) of each that is in use."""
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    return order, list(zip(used.tolist(), first.tolist(), np.append(first[1:], len(bucket)).tolist()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """All columns of docs plus kept binary (the bytes that stay) and spans
    array<struct<start long, length long>> (the maximal runs of bytes that go). With
    `as_text`, kept is a string, without characters of which a part is gone.

    Ids are integers; a null id counts as smaller than all others. Null texts are empty. Rows
    with equal ids do not remove each other's bytes; equal texts under different ids lose all
    covered bytes but in the least id. Texts under `length` bytes stay. Whole texts count; an
    empty table gives no rows. Contexts and strings are compared byte by byte; answers find
    their way back to their own block's contexts by 96 bits of hashes.
    """
    spark = docs.sparkSession
    shape = Shape(length)
    taken = [c for c in docs.columns if c not in ("kept", "spans")]
    docs = docs.select(*(F.col(f"`{c}`") for c in taken))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    least = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES)
    buckets = min(1 << _MOST, 1 << (int(least) - 1).bit_length())
    low = np.uint64(max(_LOW, buckets.bit_length() - 1))
    blocks = settle(_blocks(docs, text_col), "blocks")

    def send_keys(batches):
        tidy("substrings")
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, _, data, offsets = _load(blob.as_py(), id_col, text_col)
                at, key, owner = shape.anchors(data, offsets)
                order = np.argsort(key, kind="stable")
                at, key, owner = at[order], key[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
                many = owner[first] != owner[np.append(first[1:], len(key)) - 1] if len(key) else np.empty(0, bool)
                times = np.diff(np.append(first, len(key)))
                again = np.repeat(times >= RECOUNT, times)
                if again.any():
                    times[times >= RECOUNT] = shape.different(data, offsets, at[again], owner[again], key[again])
                key = key[first]
                value = (((key >> low) & _HIGH) << np.uint64(1)) | many.astype(np.uint64)
                bucket = (key & np.uint64(buckets - 1)).astype(np.int64)
                order, parts = _by_bucket(bucket)
                value, times = value[order], times[order].astype("<u4")
                often = [np.flatnonzero(times[i:j] >= OFTEN).astype("<u4") for _, i, j in parts]
                often = [w.tobytes() + times[i:j][w].tobytes() if len(w) else None for w, (_, i, j) in zip(often, parts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _, _ in parts], pa.int64()), pa.array([name] * len(parts), pa.string()), pa.array([_five(value[i:j]) for _, i, j in parts], pa.binary()), pa.array(often, pa.binary())],
                    names=["bucket", "block", "data", "often"],
                )
        tidy("substrings")

    def find_shared(table: pa.Table) -> pa.Table:
        tidy("substrings")
        names, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
        values = [_from_five(x.as_py()) for x in table.column("data")]
        flat = np.concatenate(values)
        _, inverse, counts = np.unique(flat >> np.uint64(1), return_inverse=True, return_counts=True)
        counts = counts + np.bincount(inverse, weights=(flat & np.uint64(1)).astype(float), minlength=len(counts))
        shared = counts[inverse] >= 2
        times, at = np.ones(len(flat)), 0
        for v, w in zip(values, table.column("often").to_pylist()):
            if w:
                place, number = np.frombuffer(w, "<u4").reshape(2, -1)
                times[at + place] = number
            at += len(v)
        hot = (np.bincount(inverse, weights=times) >= HOT)[inverse] if len(flat) else shared
        flat = (flat >> np.uint64(1) << np.uint64(1)) | hot.astype(np.uint64)
        out, at = [], 0
        for name, v in zip(names, values):
            here = at + np.flatnonzero(shared[at : at + len(v)])
            at += len(v)
            if len(here):
                out.append((bucket, name, _five(flat[here])))
        return pa.table({"bucket": pa.array([o[0] for o in out], pa.int64()), "block": pa.array([o[1] for o in out], pa.string()), "data": pa.array([o[2] for o in out], pa.binary())})

    schema = "bucket long, block string, data binary"
    shared = blocks.mapInArrow(send_keys, f"{schema}, often binary").groupBy("bucket").applyInArrow(find_shared, schema)

    def send_contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        tidy("substrings")
        rows = []
        if left.num_rows and right.num_rows:
            name = left.column("block")[0].as_py()
            _, ids, data, offsets = _load(left.column("blob")[0].as_py(), id_col, text_col)
            values = [_from_five(d.as_py()) for d in right.column("data")]
            wanted = np.concatenate([((v >> np.uint64(1)) << low) | np.uint64(b.as_py()) for b, v in zip(right.column("bucket"), values)])
            order = np.argsort(wanted)
            wanted, hot = wanted[order], (np.concatenate(values)[order] & np.uint64(1)).astype(bool)
            at, key, owner = shape.anchors(data, offsets)
            short = (((key >> low) & _HIGH) << low) | (key & np.uint64(buckets - 1))
            place = np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)
            hit = wanted[place] == short
            at, owner, hot = at[hit], owner[hit], hot[place[hit]]
            records = shape.contexts(data, offsets, at, owner)
            _, anchor, first, inverse = shape.distinct(records)
            low_id, high_id = np.full(len(first), NEVER), np.full(len(first), NO_ID)
            np.minimum.at(low_id, inverse, ids[owner])
            np.maximum.at(high_id, inverse, ids[owner])
            records, anchor, hot = records[first], anchor[first], hot[first]

            def send(bucket, records, low_id, many):
                order, parts = _by_bucket(bucket.astype(np.int64))
                for b, i, j in parts:
                    pick = order[i:j]
                    body = np.ascontiguousarray(low_id[pick]).view(np.uint8).reshape(-1, 8).T.tobytes() + many[pick].tobytes() + records[pick].tobytes()
                    rows.append((b, name, _shrink(body)))

            few = np.flatnonzero(~hot)
            send(anchor[few] & np.uint64(buckets - 1), records[few], low_id[few], high_id[few] > low_id[few])
            if hot.any():
                low_id, high_id = low_id[hot], high_id[hot]
                for _, fits, found in shape.strings(records[hot], anchor[hot]):
                    whole = _fold(found)
                    one, inverse = _equal(whole, found)
                    least, most = np.full(len(one), NEVER), np.full(len(one), NO_ID)
                    np.minimum.at(least, inverse, low_id[fits])
                    np.maximum.at(most, inverse, high_id[fits])
                    send((whole[one] & np.uint64(buckets - 1)) + np.uint64(buckets), found[one], least, most > least)
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([r[1] for r in rows], pa.string()), "data": pa.array([r[2] for r in rows], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        tidy("substrings")
        bucket = table.column("bucket")[0].as_py()
        hot = bucket >= buckets
        size = length + 4 if hot else shape.width + 2
        names, lows, manys, bodies = table.column("block").to_pylist(), [], [], []
        for d in table.column("data"):
            raw = _grow(d.as_py())
            n = len(raw) // (size + 9)
            lows.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view(np.int64).ravel())
            manys.append(np.frombuffer(raw, bool, n, 8 * n).copy())
            bodies.append(np.frombuffer(raw, np.uint8, n * size, 9 * n).reshape(n, size))
        records, low = np.concatenate(bodies), np.concatenate(lows)
        bodies = raw = None
        if hot:
            whole = _fold(records)
            first, inverse = _equal(whole, records)
            tag = (_fold(records, int(_MIX)) >> np.uint64(32)).astype(np.uint32)
        else:
            whole, anchor, first, inverse = shape.distinct(records)
            tag = (anchor >> np.uint64(32)).astype(np.uint32)
        ids = np.full(len(first), NEVER)
        np.minimum.at(ids, inverse, low)
        least = ids[None, :] if hot else shape.least_ids(records[first], ids, anchor[first])
        out, at = [], 0
        for name, mine, many in zip(names, lows, manys):
            part = inverse[at : at + len(mine)]
            useful = many | (least[:, part].min(axis=0) < mine)
            if useful.any():
                here = slice(at, at + len(mine))
                body = whole[here][useful].tobytes() + tag[here][useful].tobytes() + least[:, part[useful]].tobytes()
                if hot:
                    body += np.ascontiguousarray(records[here][useful, :4]).tobytes()
                out.append((bucket, name, _shrink(body)))
            at += len(mine)
        return pa.table({"bucket": pa.array([o[0] for o in out], pa.int64()), "block": pa.array([o[1] for o in out], pa.string()), "data": pa.array([o[2] for o in out], pa.binary())})

    by_block = lambda df: df.groupBy("block")
    contexts = by_block(blocks).cogroup(by_block(shared)).applyInArrow(send_contexts, schema)
    answers = contexts.groupBy("bucket").applyInArrow(answer, schema)
    final = docs.withColumn("kept", F.lit("") if as_text else F.lit(b"")).withColumn("spans", F.lit(None).cast("array<struct<start:long,length:long>>"))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        tidy("substrings")
        table, ids, data, offsets = _load(left.column("blob")[0].as_py(), id_col, text_col)
        gone = np.zeros(len(data) + 1, np.int32)
        is_hot = np.array([b >= buckets for b in right.column("bucket").to_pylist()], bool)
        replies = right.column("data")
        at, key, owner = shape.anchors(data, offsets) if len(is_hot) else (None, None, None)

        def cover(begin):
            np.add.at(gone, begin, 1)
            np.add.at(gone, begin + length, -1)

        def places(keys):
            """Of anchors whose keys begin as one of `keys`: positions and documents, some at a time."""
            high = (key >> np.uint64(32)).astype(np.uint32)
            near = keys[np.minimum(np.searchsorted(keys, high), len(keys) - 1)] == high
            here, who = at[near], owner[near]
            for k in range(0, len(here), 1 << 14):
                yield here[k : k + (1 << 14)], who[k : k + (1 << 14)]

        if len(is_hot) > is_hot.sum():
            few = [d for d, h in zip(replies, is_hot) if not h]
            counts = [_grown(d.as_py()) // (8 * (shape.side + 2) + 4) for d in few]
            found, tags, least = np.empty(sum(counts), np.uint64), np.empty(sum(counts), np.uint32), np.empty((shape.side + 1, sum(counts)), np.int64)
            end = 0
            for n, d in zip(counts, few):
                raw, here = _grow(d.as_py()), slice(end, end + n)
                found[here], tags[here] = np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint32, n, 8 * n)
                least[:, here] = np.frombuffer(raw, np.int64, n * (shape.side + 1), 12 * n).reshape(shape.side + 1, n)
                end += n
            keys, order = np.unique(tags), np.argsort(found)
            found, tags = found[order], tags[order]
            for a, o in places(keys):
                whole, anchor = shape.names(shape.contexts(data, offsets, a, o))
                place = np.minimum(np.searchsorted(found, whole), len(found) - 1)
                hit = np.flatnonzero((found[place] == whole) & (tags[place] == (anchor >> np.uint64(32)).astype(np.uint32)))
                a, mine, place = a[hit], ids[o[hit]], order[place[hit]]
                for before in range(shape.side + 1):
                    cover(a[least[before, place] < mine] - before)
        if is_hot.any():
            raw = [_grow(d.as_py()) for d, h in zip(replies, is_hot) if h]
            column = lambda kind, at: np.concatenate([np.frombuffer(r, kind, len(r) // 24, at * (len(r) // 24)) for r in raw])
            found, tags, least, keys = column(np.uint64, 0), column(np.uint32, 8), column(np.int64, 12), np.unique(column("<u4", 20))
            order = np.argsort(found)
            found, tags, least = found[order], tags[order], least[order]
            for a, o in places(keys):
                records = shape.contexts(data, offsets, a, o)
                for before, fits, string in shape.strings(records, shape.names(records)[1]):
                    whole = _fold(string)
                    place = np.minimum(np.searchsorted(found, whole), len(found) - 1)
                    hit = (found[place] == whole) & (least[place] < ids[o[fits]])
                    fits, place, string = fits[hit], place[hit], string[hit]
                    cover(a[fits[tags[place] == (_fold(string, int(_MIX)) >> np.uint64(32)).astype(np.uint32)]] - before)
        gone = np.cumsum(gone[:-1]) > 0
        kept, spans = [], []
        for i in range(len(ids)):
            a, b = offsets[i], offsets[i + 1]
            here = gone[a:b]
            if not here.any():
                kept.append(data[a:b].tobytes())
                spans.append([])
                continue
            kept.append(data[a:b][~here].tobytes())
            edge = np.flatnonzero(np.diff(np.concatenate([[0], here.view(np.int8), [0]])))
            spans.append([{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2])])
        if as_text:
            kept = [k.decode("utf-8", "ignore") for k in kept]
        return table.append_column("kept", pa.array(kept, pa.string() if as_text else pa.binary())).append_column("spans", pa.array(spans, span_type))

    return by_block(blocks).cogroup(by_block(answers)).applyInArrow(mark, final.schema)
