"""Near-duplicate classes by ProbMinHash.

Every shingle of a text is a Poisson process whose rate is its weight; arrivals fall into
random registers, each register keeps the shingle that came first, and a text is done when no
later arrival can come first anywhere. Two texts agree in a register with the probability
Jaccard likeness of their weighted shingles. All weights are 1 here, so that signatures
estimate the plain likeness that decides, however often a shingle repeats. Registers make bands; texts that share a band
are compared: first by signature, then exactly.

Equal texts are one node from the start. A shared band compares its members with one member
of it, first the one that meets most texts, not with each other. Where members are still apart
but the band has linked some, one of each component meets another one in the next round, until
its members are one component or a round links none of them. At last, in every band that still
holds several components, all pairs across them that have not met are compared, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import settle, tidy

WORDS = 5
SIMILARITY = 0.8
REGISTERS = 128
BANDS = 32
#: How far an estimate may be below the threshold before a pair is left out: seven standard
#: errors of 128 registers at 0.8.
SLACK = 0.25
CACHE_ENTRIES = 100_000
#: Texts of a band, and bytes of their sets, that a task compares with as many others at a
#: time, about.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Pairs of one text that a task compares at a time, about.
PER = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Hashes of all runs of `words` words (white space parts them) of a text, and how often
    each occurs. A text of fewer words has one shingle, all of them; an empty one has none."""

    def __init__(self, words: int):
        self.words = words
        self.cache: dict[str, int] = {}

    def hashes(self, text: str) -> np.ndarray:
        parts = text.split()
        cache = self.cache
        try:
            h = np.fromiter(map(cache.__getitem__, parts), np.uint64, len(parts))
        except KeyError:
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
            for p in set(parts):
                if p not in cache:
                    cache[p] = xxhash.xxh3_64_intdigest(p.encode())
            h = np.fromiter(map(cache.__getitem__, parts), np.uint64, len(parts))
        n = min(self.words, len(h))
        if not n:
            return h
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = _mix(out + h[k : len(h) - n + 1 + k] + _ODD)
        return out


def prob_minhash(shingles: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The shingle that arrives first in each register; all 0 where there is no shingle."""
    out = np.zeros(registers, np.uint64)
    if not len(shingles):
        return out
    first = np.full(registers, np.inf)
    now, live, turn = np.zeros(len(shingles)), np.arange(len(shingles)), 0
    while len(live):
        each = max(1, 4 * registers // len(live))
        count = np.arange(turn, turn + each, dtype=np.uint64)
        draw = _mix(shingles[live][:, None] + (count + np.uint64(1)) * _ODD)
        gap = -np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weights[live][:, None]
        times = now[live][:, None] + np.cumsum(gap, axis=1)
        now[live] = times[:, -1]
        where = (_mix(draw ^ _ODD) % np.uint64(registers)).astype(np.int64).ravel()
        flat = times.ravel()
        late_first = np.argsort(-flat, kind="stable")
        where, flat = where[late_first], flat[late_first]
        better = flat < first[where]
        who = np.repeat(shingles[live], each)[late_first]
        first[where[better]] = flat[better]  # the earliest arrival is written last
        out[where[better]] = who[better]
        live = live[now[live] < first.max()]
        turn += each
    return out


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """(node, bands array<long>, signature binary: 16 bits a register) of distinct texts;
    texts without words have no bands."""
    rows = BANDS and REGISTERS // BANDS

    def work(batches):
        tidy("neardup")
        shingler, done = Shingler(words), set()
        for batch in batches:
            nodes, bands, marks = [], [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node in done:
                    continue
                if len(done) < CACHE_ENTRIES:
                    done.add(node)
                h = np.unique(shingler.hashes(text or ""))
                if not len(h):
                    continue
                sig = prob_minhash(h, np.ones(len(h)))
                band = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD
                for k in range(rows):
                    band = _mix(band + sig.reshape(BANDS, rows)[:, k])
                nodes.append(node)
                bands.append(band.astype(np.int64))
                marks.append((_mix(sig) & np.uint64(0xFFFF)).astype("<u2").tobytes())
            flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
            offsets = np.arange(len(nodes) + 1, dtype=np.int32) * BANDS
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(marks, pa.binary())], names=["node", "bands", "signature"])
        tidy()

    made = docs.select("node", "text").mapInArrow(work, "node binary, bands array<long>, signature binary")
    return made.groupBy("node").agg(F.first("bands").alias("bands"), F.first("signature").alias("signature"))


def _deal(pairs: DataFrame) -> DataFrame:
    """(f, g, salt) of pairs (f, g, n), each once. In a round a text f may meet any number of
    others (n of them in the largest band), g only one per band: f's rows are dealt to groups
    of about PER, and its values are sent to each of these."""
    salt = F.pmod(F.xxhash64("g"), F.ceil(F.col("n") / PER)).cast("int")
    return pairs.groupBy("f", "g").agg(F.max("n").alias("n")).withColumn("salt", salt)


def _beside(dealt: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Adds `column` of values (node, column) for both ends of dealt pairs, as x (of f) and y."""
    salts = dealt.groupBy("f").agg(F.max("salt").alias("most"))
    named = values.select(F.col("node").alias("f"), F.col(column).alias("x")).join(salts, "f").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("most")))).drop("most")
    # Always merge joins: whether a side is small enough to be sent to all would depend on the
    # table's size, and so would the plan.
    return dealt.hint("merge").join(values.select(F.col("node").alias("g"), F.col(column).alias("y")), "g").hint("merge").join(named, ["f", "salt"])


def _estimated(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """(f, g, n, near): the share of registers in which f and g agree."""

    @F.pandas_udf("double")
    def near(a, b):
        if not len(a):
            return a.astype("float64")
        x, y = (np.frombuffer(b"".join(s), "<u2").reshape(len(s), REGISTERS) for s in (a, b))
        return a.__class__((x == y).mean(axis=1))

    near = near.asNondeterministic()  # else a filter on it is a second Python node in the same task
    return _beside(_deal(pairs), signatures, "signature").select("f", "g", "n", near("x", "y").alias("near"))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (f, g, n), as (a, b), whose sets of shingles have at least that
    Jaccard likeness."""

    def work(batches):
        tidy("neardup")
        for batch in batches:
            good, mine, last = [], None, None
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.as_buffer(), np.frombuffer(y.as_buffer(), np.uint64)
                if last is None or not x.equals(last):
                    last, mine = x, np.frombuffer(x, np.uint64)
                both = _common(mine, y)
                good.append(both > 0 and both >= similarity * (len(mine) + len(y) - both))
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])
        tidy()

    return _beside(_deal(pairs), sets, "shingles").select(F.col("f").alias("a"), F.col("g").alias("b"), "x", "y").mapInArrow(work, "a binary, b binary")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles binary: the sorted 64-bit hashes of its shingles) of (node, text)."""

    def work(batches):
        tidy("neardup")
        shingler = Shingler(words)
        for batch in batches:
            made = [np.unique(shingler.hashes(t)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "shingles"])
        tidy()

    return texts.select("node", "text").mapInArrow(work, "node binary, shingles binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's connected component. Labels spread along
    links and then jump to their own label's label; a round writes and rereads its labels."""
    both = settle(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "links")
    labels = settle(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        lower = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old")
        step = settle(moved, "labels")
        labels = step.select("node", "label")
        if not step.where("label <> old").limit(1).count():
            return labels


def _meetings(bands: DataFrame, turn: int) -> DataFrame:
    """(band, f, g, n): within each band, the member that stands first (f) and one member of
    each other component; n components. In the first round a text stands before those that meet
    fewer texts in all their bands (a text that others were copied from meets most); later
    rounds draw lots."""
    order = F.struct(F.lit(0).alias("x"), F.xxhash64("band", "node", F.lit(turn)).alias("lot"), "node") if turn else F.struct((-F.col("met")).alias("x"), F.xxhash64("node").alias("lot"), "node")
    members = settle(bands.groupBy("band", "label").agg(F.min(order).alias("m")), "chosen")
    firsts = members.groupBy("band").agg(F.min("m").alias("first"), F.count("*").alias("n")).where("n > 1").select("band", F.col("first.node").alias("f"), "n")
    return members.select("band", F.col("m.node").alias("g")).join(firsts, "band").where("f <> g").select("band", "f", "g", "n")


def _alike(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """For pairs (i, j) of positions in sets: whether their Jaccard likeness is that large.
    Values that several sets hold make columns of 0 and 1; a matrix product counts them."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    times = np.diff(np.append(first, len(flat)))
    column = np.repeat(np.cumsum(times > 1) - 1, times)
    shared = np.repeat(times > 1, times)
    owner, column = owner[shared], column[shared]
    rows, cols = np.unique(i), np.unique(j)
    both = np.zeros((len(rows), len(cols)), np.float32)
    n = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, n, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        held = np.zeros((len(sets), min(4096, n - start)), np.float32)
        held[owner[a:b], column[a:b] - start] = 1
        both += held[rows] @ held[cols].T
    common = both[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.int64)
    return (common > 0) & (common >= similarity * (sizes[i] + sizes[j] - common))


def _rest(shared: DataFrame, labels: DataFrame, signatures: DataFrame, sets: DataFrame, least: float, similarity: float) -> DataFrame:
    """Links (a, b) across the components that are left in a band, all pairs of it compared:
    by signature (agreement of `least` at the least) and then by sets. A pair is compared in
    the first band it shares. (Two texts alone in a band have met.)

    A band is cut into blocks of about BLOCK texts and BLOCK_BYTES of sets, and each pair of
    blocks is a group of its own; a group gives enough of its links to join what they join.
    """
    named = shared.where("size > 2").join(labels, "node")
    parted = named.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band")
    open_ = settle(named.join(parted, "band", "left_semi").join(signatures.select("node", "signature", "bands"), "node").join(sets, "node"), "open")
    weight = open_.groupBy("band").agg(F.sum(F.octet_length("shingles")).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES))
    sides = open_.join(weight, "band").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    sides = sides.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = sides.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "label", "bands", "signature", "shingles")

    def work(group):
        tidy("neardup")
        band, low, high = group.column("band")[0].as_py(), group.column("low")[0].as_py(), group.column("high")[0].as_py()
        block = group.column("block").to_numpy()
        nodes = group.column("node").to_pylist()
        node, label = (np.unique(np.array(group.column(c).to_pylist(), dtype=object), return_inverse=True)[1] for c in ("node", "label"))
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), BANDS)
        marks = np.frombuffer(b"".join(group.column("signature").to_pylist()), "<u2").reshape(len(node), REGISTERS)
        above = np.flatnonzero(block == high)
        a, b = [], []
        for i in np.flatnonzero(block == low):
            js = above[node[above] > node[i]] if low == high else above
            js = js[label[js] != label[i]]
            js = js[bands[i][(bands[js] == bands[i]).argmax(axis=1)] == band]
            js = js[(marks[js] == marks[i]).mean(axis=1) >= least]
            a.append(np.full(len(js), i))
            b.append(js)
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        if len(a):
            used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            held = group.column("shingles").take(pa.array(used)).to_pylist()
            good = _alike([np.frombuffer(h, np.uint64) for h in held], place[: len(a)], place[len(a) :], similarity)
            a, b = a[good], b[good]
        home, out = {}, []
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = label[i], label[j]
            while x in home:
                x = home[x]
            while y in home:
                y = home[y]
            if x != y:
                home[x] = y
                out.append((nodes[i], nodes[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return rows.groupBy("band", "low", "high").applyInArrow(work, "a binary, b binary")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links, from those before: only what the links join moves."""
    joined = _labelled(links, labels).where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    moved = components(joined).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return settle(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def _labelled(pairs: DataFrame, labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    left = labels.select(F.col("node").alias(a), F.col("label").alias("la"))
    right = labels.select(F.col("node").alias(b), F.col("label").alias("lb"))
    return pairs.join(left, a).join(right, b)


def _named(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(id, node) of each row of docs, and (node, least id, label) of each distinct text."""
    id_ = F.col(id_col).alias("id")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(id_, node_of(F.col(text_col)).alias("node"), text.alias("text"))
    rows = settle(keyed.select("id", "node"), "rows")
    nodes = settle(rows.groupBy("node").agg(F.min("id").alias("least")), "nodes")
    signatures = settle(_signatures(keyed, words), "signatures")
    bands = signatures.select("node", F.explode("bands").alias("band"))
    busy = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    shared = settle(bands.join(busy, "band"), "shared")
    members = settle(shared.groupBy("node").agg(F.sum("size").alias("met")).join(nodes, "node").select("node", "met", F.col("least").alias("id")), "members")
    same = (keyed["node"] == members["node"]) & keyed["id"].eqNullSafe(members["id"])
    texts = keyed.join(members.hint("merge"), same, "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = settle(_sets(texts, words), "sets")
    labels = settle(members.select("node", F.col("node").alias("label")), "labels")
    active = settle(shared.join(members.select("node", "met", F.col("node").alias("label")), "node").select("band", "node", "met", "label"), "active")
    turn = 0
    while True:
        # Pairs of this round by likeness; a text's likeliest partner first, others only where
        # that left them apart. A band that has linked nothing in a round waits for the last one.
        met = settle(_meetings(active, turn), "met")
        near = settle(_estimated(met, signatures).where(F.col("near") >= similarity - SLACK), "near")
        if not near.limit(1).count():
            break
        pair = F.struct("near", "f", "g", "n")
        ends = near.select(F.col("f").alias("node"), pair.alias("m")).union(near.select("g", pair))
        best = ends.groupBy("node").agg(F.max("m").alias("m")).select("m.f", "m.g", "m.n").distinct()
        links = settle(_verified(best, sets, similarity), "links")
        labels = _relabel(labels, links)
        rest = _labelled(near.join(best, ["f", "g"], "left_anti"), labels, "f", "g").where("la <> lb").select("f", "g", "n")
        more = settle(_verified(rest, sets, similarity), "links")
        if more.limit(1).count():
            labels = _relabel(labels, more)
        linked = links.union(more).withColumnsRenamed({"a": "f", "b": "g"})
        alive = met.join(linked, ["f", "g"], "left_semi").select("band").distinct()
        renamed = active.drop("label").join(alive, "band", "left_semi").join(labels, "node")
        parted = renamed.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band")
        active = settle(renamed.join(parted, "band", "left_semi").select("band", "node", "met", "label"), "active")
        if not active.limit(1).count():
            break
        turn += 1
    last = settle(_rest(shared, labels, signatures, sets, similarity - SLACK, similarity), "links")
    if last.limit(1).count():
        labels = _relabel(labels, last)
    return rows, nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: `id_col` and class_id, the least id of its class.

    Equal texts are one class (null counts as empty, and all empty texts are one class);
    texts whose sets of five-word shingles have a Jaccard likeness of 0.8 or more are linked,
    and linked texts share a class. Texts of fewer words are one shingle. Null ids take part
    (a class of null ids only has a null class id); rows with equal ids each get a row; other
    columns are not read; an empty table gives no rows.
    """
    rows, named = _named(docs, id_col, text_col, words, similarity)
    lowest = named.groupBy("label").agg(F.min("least").alias("class_id"))
    least = named.join(lowest, "label").select("node", "class_id")
    return rows.join(least, "node").select(F.col("id").alias(id_col), "class_id")


def node_of(text: F.Column) -> F.Column:
    """The key of a text: equal texts share it, and null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, node): the one text of each class that stays, that of the least id (null ids last)
    and, of several with this id, of the least node."""
    _, named = _named(docs, id_col, text_col, words, similarity)
    least = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), "node"))
    return named.groupBy("label").agg(least.alias("m")).select("m.id", "m.node")
