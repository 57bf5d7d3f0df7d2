"""Boosted trees by histograms, all models of a task at once.

Folds, held-out seasons and trials of a search differ in the rows they leave out and in their
parameters; they read the same rows. Rows with the same bins go the same way in every tree, so
gradients only need the weights and labels drawn among them. There are two ways to grow:

* Few different bins (team pairs of a season, however many games): a job adds up, for some tens
  of trees, what each model draws of each bins' rows, and grows the models by model, each from
  these sums. Work of the trees doesn't grow with the rows; every row is still drawn by itself.
  For the losses of a search, where all rows fit into a task and are not too many for each
  different bins, a task draws and grows one model from the first tree to the last.
* Many: one job a level grows the next level of a tree of every model: tasks sum gradients by
  (model, node, feature, bin) over their rows, the sums meet by (model, node, feature), and each
  gives its best cut. A row per model, node and feature comes back, whatever the number of rows.
  Margins are written every few trees.

Both draw the same rows and grow the same trees.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.operators.ratings import written

#: Cuts of a feature; trees between two writes of the margins; rows of a partition; bytes of
#: the sums that a task holds (more models or nodes take more jobs). Different bins under
#: 2 * PART_ROWS are few. Bytes of a row of runs, without its bins; rows for each different bins
#: up to which every model draws by itself.
BINS, CUT, PART_ROWS, HELD_BYTES, ROW_BYTES, DRAWN_APART = 64, 25, 50_000, 64 << 20, 28, 50


@dataclass(frozen=True)
class Spec:
    """One model: the fold whose rows it never learns from (None: it learns from all), and its
    parameters, by default the published ones."""

    held_out: int | None = None
    trees: int = 300
    depth: int = 4
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    seed: int = 42
    l2: float = 1.0
    least_weight: float = 1.0


@dataclass
class Tree:
    """Nodes in heap order (children of k: 2k + 1, 2k + 2). feature -1: a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    null_left: np.ndarray
    value: np.ndarray

    @classmethod
    def grown(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros(n, bool), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf (of those so far) that each row comes to."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(max(1, len(self.feature).bit_length() - 1)):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            b = bins[rows, np.where(inner, f, 0)]
            left = np.where(b == 0, self.null_left[at], b <= self.cut[at])
            at = np.where(inner, 2 * at + np.where(left, 1, 2), at)
        return at


@dataclass
class Boosted:
    """Fitted models: edges of each column's bins, and the trees of each spec."""

    columns: list[str]
    edges: list[np.ndarray]
    specs: list[Spec]
    trees: list[list[Tree]] = field(default_factory=list)

    def margins(self, bins: np.ndarray, model: int) -> np.ndarray:
        out = np.zeros(len(bins))
        for tree in self.trees[model]:
            out += tree.value[tree.nodes(bins)]
        return out


def edges_of(rows: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Ascending cuts of each column by approximate quantiles, at most bins - 1. Columns are
    grouped, so that the sketches of one meet apart from those of the others."""
    shares = [k / bins for k in range(1, bins)]
    cells = F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"`{c}`").cast("double").alias("v")) for k, c in enumerate(columns))))
    found = {r["k"]: r["cuts"] for r in rows.select(cells).groupBy("k").agg(F.percentile_approx("v", shares, 10_000).alias("cuts")).collect()} if columns else {}  # a row per column
    return [np.unique(np.array(found.get(k) if found.get(k) is not None else [], dtype=np.float64)) for k in range(len(columns))]


def binned(batch: pa.RecordBatch, first: int, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of the columns from `first` on: 0 for null and NaN, 1 up to the first cut, ..."""
    out = np.zeros((batch.num_rows, len(edges)), np.uint8)
    for k, e in enumerate(edges):
        x = batch.column(first + k).to_numpy(zero_copy_only=False).astype(np.float64)
        out[:, k] = np.where(np.isnan(x), 0, np.searchsorted(e, x, side="left") + 1)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32) if width else np.zeros(len(rows) + 1, np.int32)), pa.py_buffer(rows)])


def _array(column: pa.Array, kind, width: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), width)


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64: well spread numbers from close ones."""
    x, moved = x.copy(), np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.right_shift(x, np.uint64(shift), out=moved)
        x ^= moved
        if factor is not None:
            x *= np.uint64(factor)
    return x


def _is_drawn(at: np.ndarray, seed: int, share: float, turn: int) -> np.ndarray:
    """Whether the tree of this turn learns from each row: its 53 highest bits, as a share."""
    salt = _mixed(np.array([turn * 1_000_003 + seed], dtype=np.uint64))[0]
    below = math.ceil(share * 2.0**53) << 11
    return _mixed(at ^ salt) < np.uint64(below) if below < 1 << 64 else np.ones(len(at), bool)


STATE = "label double, weight double, fold int, at long, bins binary"


def _state(rows: DataFrame, columns: list[str], edges: list[np.ndarray], keys: list[str], label: str, weight: str | None, fold: str | None) -> DataFrame:
    """keys and STATE: bins of all columns."""
    given = F.col(f"`{label}`").cast("double")
    own = rows.select(
        *(F.col(f"`{k}`") for k in keys),
        F.coalesce(given, F.lit(0.0)).alias("label"),
        F.when(given.isNull(), 0.0).otherwise(F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0)) if weight else F.lit(1.0)).alias("weight"),
        (F.coalesce(F.col(f"`{fold}`").cast("int"), F.lit(-1)) if fold else F.lit(-1)).alias("fold"),
        F.xxhash64(*(F.col(f"`{c}`") for c in [*keys, label])).alias("at"),
        *(F.col(f"`{c}`").cast("double") for c in columns),
    )
    n_keys = len(keys)

    def work(batches):
        for batch in batches:
            bins = binned(batch, n_keys + 4, edges)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n_keys + 4)), _binary(bins)], names=[*keys, "label", "weight", "fold", "at", "bins"])

    kept = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return own.mapInArrow(work, f"{kept}, {STATE}" if keys else STATE)


def _added(bins: np.ndarray, margins: np.ndarray, block: list[dict[int, Tree]], models) -> np.ndarray:
    """Margins of the models with the trees of the block, all of them walked down at once."""
    out = margins.copy()
    own = [(m, trees[m]) for trees in block for m in models if m in trees]
    if not own or not len(bins):
        return out
    size = max(len(t.feature) for _, t in own)
    stacked = [np.concatenate([np.pad(getattr(t, x), (0, size - len(t.feature)), constant_values=-1 if x == "feature" else 0) for _, t in own]) for x in ("feature", "cut", "null_left", "value")]
    feature, cut, null_left, value = stacked
    first = np.arange(len(own))[:, None] * size
    flat, start = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
    at = np.zeros((len(own), len(bins)), np.int64)
    for _ in range(size.bit_length() - 1):
        node = at + first
        f = feature[node]
        b = flat[start + np.maximum(f, 0)]
        left = np.where(b == 0, null_left[node], b <= cut[node])
        at = np.where(f >= 0, 2 * at + 2 - left, at)
    moved = value[at + first]
    for k, (m, _) in enumerate(own):
        out[:, m] += moved[k]
    return out


def _sums(specs: list[Spec], width: int, step: float, block, growing: dict[int, Tree], frontier: dict[int, list[int]], used: dict[int, np.ndarray], turn: int):
    """Of a task's rows: for each model, open node and feature, sums of gradients and second
    derivatives by bin, rounded to steps of which all sums are exact."""
    bins_n = BINS + 1
    place = {m: {n: k for k, n in enumerate(nodes)} for m, nodes in frontier.items()}

    def work(batches):
        held = {m: np.zeros((2, len(nodes), len(used[m]), bins_n)) for m, nodes in frontier.items()}
        for batch in batches:
            c = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            bins, n_models = _array(c["bins"], np.uint8, width), len(specs)
            margins = _added(bins, _array(c["margins"], np.float64, n_models), block, frontier)
            label, weight, fold = (c[x].to_numpy() for x in ("label", "weight", "fold"))
            at = c["at"].to_numpy().view(np.uint64)
            for m, nodes in frontier.items():
                s = specs[m]
                drawn = _is_drawn(at, s.seed, s.rows, turn)
                lookup = np.full(len(growing[m].feature), -1, np.int64)
                lookup[list(place[m])] = list(place[m].values())
                node = lookup[growing[m].nodes(bins)]
                take = np.flatnonzero(drawn & (node >= 0) & ((fold != s.held_out) if s.held_out is not None else True))
                if not len(take):
                    continue
                p = 1 / (1 + np.exp(-margins[take, m]))
                g, h = weight[take] * (p - label[take]), weight[take] * np.maximum(p * (1 - p), 1e-16)
                cells = ((node[take, None] * len(used[m]) + np.arange(len(used[m]))) * bins_n + bins[take[:, None], used[m]]).ravel()
                for k, x in enumerate((np.rint(g * step) / step, np.rint(h * step) / step)):
                    held[m][k] += np.bincount(cells, np.repeat(x, len(used[m])), held[m][k].size).reshape(held[m][k].shape)
        rows = [(m, n, int(f), held[m][:, k, j].tobytes()) for m, nodes in frontier.items() for k, n in enumerate(nodes) for j, f in enumerate(used[m])]
        if rows:
            model, node, feature, sums = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(model, pa.int32()), pa.array(node, pa.int32()), pa.array(feature, pa.int32()), pa.array(sums, pa.binary())], names=["model", "node", "feature", "sums"])

    return work


def best_cuts(sums: np.ndarray, l2: float | np.ndarray, least: float | np.ndarray, block: int = 250) -> dict[str, np.ndarray]:
    """The best cut of each row of sums (rows, 2, bins): gain (0: none), cut, null_left, and the
    sums on the left and of all. Bin 0 holds nulls, which go to the side that gains more. Goes by
    blocks that a processor's cache holds."""
    l2, least = (np.broadcast_to(x, len(sums)) for x in (l2, least))
    parts = [_best_cuts(sums[k : k + block], l2[k : k + block], least[k : k + block]) for k in range(0, len(sums), block)]
    return {name: np.concatenate([x[name] for x in parts]) for name in parts[0]}


def _best_cuts(sums: np.ndarray, l2: np.ndarray, least: np.ndarray) -> dict[str, np.ndarray]:
    n, sums = len(sums), np.ascontiguousarray(sums.transpose(1, 2, 0))
    total_g, total_h = sums.sum(axis=1)
    left = _running(sums[:, 1:])[:, :-1]
    best = {"gain": np.zeros(n), "cut": np.zeros(n, np.int32), "null_left": np.zeros(n, bool), "left_g": np.zeros(n), "left_h": np.zeros(n)}
    for nulls_left in (False, True):
        if nulls_left:
            own = np.flatnonzero(sums[:, 0].any(axis=0))
            if not len(own):
                break
            a, b = left[:, :, own] + sums[:, :1, own]
        else:
            own, (a, b) = np.arange(n), left
        g, h, l2_own, least_own = (x if len(own) == n else x[own] for x in (total_g, total_h, l2, least))
        c, d = g - a, h - b
        closed = b < least_own
        closed |= d < least_own
        d += l2_own
        c *= c
        c /= d
        np.add(b, l2_own, out=d)
        gain = a * a
        gain /= d
        gain += c
        np.copyto(gain, -np.inf, where=closed)
        k, at = np.argmax(gain, axis=0), np.arange(len(own))
        top = gain[k, at] - g * g / (h + l2_own)
        better = np.flatnonzero(top > best["gain"][own] + 1e-12)
        k, at = k[better], at[better]
        for name, x in (("gain", top[better]), ("cut", k + 1), ("null_left", nulls_left), ("left_g", a[k, at]), ("left_h", b[k, at])):
            best[name][own[at]] = x
    return best | {"g": total_g, "h": total_h}


def _running(x: np.ndarray) -> np.ndarray:
    """Running sums along axis 1, of BINS places: within eighths, then of the eighths before."""
    eighths = x.reshape(len(x), 8, BINS // 8, -1)
    out = np.empty(eighths.shape)
    out[:, :, 0] = eighths[:, :, 0]
    for k in range(1, BINS // 8):
        np.add(out[:, :, k - 1], eighths[:, :, k], out=out[:, :, k])
    for k in range(1, 8):
        out[:, k] += out[:, k - 1, -1:]
    return out.reshape(x.shape)


CUTS = "model int, node int, feature int, gain double, cut int, null_left boolean, left_g double, left_h double, g double, h double"


def _cuts(specs: list[Spec]):
    def work(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for m, n, f, sums in zip(*(batch.column(k).to_pylist() for k in range(4))):
                x = np.frombuffer(sums).reshape(2, -1)
                held[m, n, f] = held[m, n, f] + x if (m, n, f) in held else x
        if held:
            keys = sorted(held)
            l2, least = (np.array([getattr(specs[m], x) for m, _, _ in keys]) for x in ("l2", "least_weight"))
            best = best_cuts(np.stack([held[k] for k in keys]), l2, least)
            out = [pa.array(c, pa.int32()) for c in zip(*keys)]
            out += [pa.array(best["gain"]), pa.array(best["cut"].astype(np.int32)), pa.array(best["null_left"]), *(pa.array(best[x]) for x in ("left_g", "left_h", "g", "h"))]
            yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in CUTS.split(", ")])

    return work


def _groups(frontier: dict[int, list[int]], used: dict[int, np.ndarray]):
    """Models whose sums fit into a task together."""
    group, held = {}, 0
    for m, nodes in frontier.items():
        size = 16 * (BINS + 1) * len(nodes) * len(used[m])
        if group and held + size > HELD_BYTES:
            yield group
            group, held = {}, 0
        group[m] = nodes
        held += size
    if group:
        yield group


def _level(state: DataFrame, parts: int, step: float, booster: Boosted, block, growing, frontier, used, turn: int) -> list:
    out = []
    for group in _groups(frontier, used):
        sums, cuts = _sums(booster.specs, len(booster.columns), step, block, {m: growing[m] for m in group}, group, {m: used[m] for m in group}, turn), _cuts(booster.specs)
        dealt = min(parts, 1 + sum(len(n) * len(used[m]) for m, n in group.items()) // 200)
        met = state.mapInArrow(sums, "model int, node int, feature int, sums binary").repartition(dealt, "model", "node", "feature").mapInArrow(cuts, CUTS)
        out += met.collect()  # a row per model, node and feature
    return out


RUNS = "bins binary, at binary, label binary, weight binary, fold binary"


def _runs(width: int):
    """Rows in order of their bins: a row for each run of equal bins in a batch, with the rest of
    its rows side by side."""

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _array(batch.column(0), np.uint8, width)
            first = np.concatenate([[0], 1 + np.flatnonzero((bins[1:] != bins[:-1]).any(axis=1))])
            sizes = np.diff(np.append(first, len(bins)))
            held = [batch.column(k).to_numpy() for k in range(1, 5)]
            yield pa.RecordBatch.from_arrays([_binary(bins[first]), *(_ragged(x, sizes) for x in held)], names=[x.split()[0] for x in RUNS.split(", ")])

    return work


def _ragged(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of consecutive values, so many for each row."""
    values = np.ascontiguousarray(values)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * np.int32(values.dtype.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of `_ragged`, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def _pieces(batch: pa.RecordBatch, runs: int, most: int = 1 << 18):
    """Consecutive runs of a batch with not many more than `most` rows together."""
    offsets = np.frombuffer(batch.column(1).buffers()[1], np.int32)[batch.column(1).offset :][: batch.num_rows + 1] // 8
    start = 0
    while start < batch.num_rows:
        end = min(max(start + 1, int(np.searchsorted(offsets, offsets[start] + most))), start + runs, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def _drawn_sums(specs: list[Spec], turns: range):
    """Of runs: for each model with trees among these turns, sums by turn of the weights it draws
    and of weight by label, where there are any."""
    folds_out = [s.held_out for s in specs]
    draws = sorted({(s.seed, s.rows) for s in specs if s.trees > turns.start})

    def work(batches):
        for batch in (piece for batch in batches for piece in _pieces(batch, runs=1 + 50_000 // len(turns))):
            at, sizes = _flat(batch.column(1), np.int64)
            label, weight, fold = (_flat(batch.column(k), kind)[0] for k, kind in ((2, np.float64), (3, np.float64), (4, np.int32)))
            run, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
            folds, fold = np.unique(fold, return_inverse=True)
            cell, size = run * len(folds) + fold, n * len(folds)
            learnt = {m: np.array([f != folds_out[m] if folds_out[m] is not None else True for f in folds], np.float64) for m in range(len(specs))}
            of = {m: np.zeros((n, len(turns), 2)) for m, s in enumerate(specs) if s.trees > turns.start}
            for k, turn in enumerate(turns):
                for seed, share in draws:
                    own = np.where(_is_drawn(at.view(np.uint64), seed, share, turn), weight, 0.0)
                    both = [np.bincount(cell, x, size).reshape(n, len(folds)) for x in (own, own * label)]
                    for m in of:
                        if (specs[m].seed, specs[m].rows) == (seed, share):
                            of[m][:, k] = np.stack([x @ learnt[m] for x in both], axis=1)
            for m, sums in of.items():
                some = np.flatnonzero(sums.any(axis=(1, 2)))
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), m, np.int32)), batch.column(0).take(pa.array(some)), _binary(sums[some].reshape(len(some), -1))], names=["model", "bins", "sums"])

    return work


TREES = "model int, turn int, feature binary, cut binary, null_left binary, value binary"


def _grown(booster: Boosted, turns: range):
    """Of the sums of `_drawn_sums`, all rows of a model in one task: its trees of these turns."""
    width, specs = len(booster.columns), booster.specs

    def work(batches):
        held: dict[int, list] = {}
        for batch in batches:
            model = batch.column(0).to_numpy()
            bins, sums = _array(batch.column(1), np.uint8, width), _array(batch.column(2), np.float64, 2 * len(turns))
            for m in np.unique(model):
                held.setdefault(int(m), []).append((bins[model == m], sums[model == m]))
        for m in list(held):
            bins, sums = (np.concatenate(x) for x in zip(*held.pop(m)))
            different, first, place = np.unique(np.ascontiguousarray(bins).view(np.dtype((np.void, width))).ravel(), return_index=True, return_inverse=True)
            del bins
            bins = different.view(np.uint8).reshape(-1, width)
            if len(first) < len(sums):  # bins that several tasks or batches have
                order = np.argsort(place, kind="stable")
                total = np.add.reduceat(sums[order], np.flatnonzero(np.diff(place[order], prepend=-1)))
            else:
                total = sums[first]
            del sums
            total = total.reshape(len(bins), len(turns), 2)
            margins, columns = booster.margins(bins, m), np.ascontiguousarray(bins.T)
            order = _order(columns)
            out = []
            for k, turn in enumerate(turns):
                if turn < specs[m].trees:
                    p = 1 / (1 + np.exp(-margins))
                    tree, at = _tree(specs[m], turn, columns, order, p * total[:, k, 0] - total[:, k, 1], total[:, k, 0] * np.maximum(p * (1 - p), 1e-16))
                    margins += tree.value[at]
                    out.append((m, turn, *(getattr(tree, x).tobytes() for x in ("feature", "cut", "null_left", "value"))))
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in TREES.split(", ")])

    return work


def _tree(s: Spec, turn: int, columns: np.ndarray, order: list, g: np.ndarray, h: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A tree of one model, from gradients and second derivatives of each bins, and the leaf that
    each comes to. columns: a row of bins for each feature; order: see `_order`.

    Of two children only the one with fewer bins is added up; the other's sums are what is left
    of the parent's. For that, g and h are rounded to where all sums are exact."""
    used, tree, size = _drawn(s, turn, len(columns)), Tree.grown(s.depth), BINS + 1
    at, flat, own = np.zeros(len(g), np.int64), columns.ravel(), np.flatnonzero(h)
    step = _step(max(np.abs(g).sum(), np.abs(h).sum()))
    g, h = np.rint(g * step) / step, np.rint(h * step) / step
    moving, place = np.arange(len(at)), np.zeros(len(at), np.int64)  # bins in open nodes, those that teach or not
    nodes, is_open = np.zeros(1, np.int64), np.ones(1, bool)
    sums, both = np.zeros((1, len(used), 2, size)), g + 1j * h
    for j, f in enumerate(used):
        rows, first, bins = order[f]
        root = np.add.reduceat(both.take(rows), first)
        sums[0, j, 0, bins], sums[0, j, 1, bins] = root.real, root.imag
    g, h = g[own], h[own]
    while True:
        found = best_cuts((sums if is_open.all() else sums[is_open]).reshape(-1, 2, size), s.l2, s.least_weight)
        first = found["gain"].reshape(-1, len(used)).argmax(axis=1)  # of equal features
        best = {name: x.reshape(len(first), -1)[np.arange(len(first)), first] for name, x in found.items()}
        tree.value[nodes[is_open]] = -s.rate * best["g"] / (best["h"] + s.l2)
        cut = best["gain"] > 0
        if not cut.any():
            break
        parents = np.flatnonzero(is_open)[cut]
        split, feature, best = nodes[parents], used[first[cut]], {name: x[cut] for name, x in best.items()}
        tree.feature[split], tree.cut[split], tree.null_left[split] = feature, best["cut"], best["null_left"]
        side_g, side_h = (np.stack([best[f"left_{x}"], best[x] - best[f"left_{x}"]]) for x in "gh")
        children = np.stack([2 * split + 1, 2 * split + 2])
        tree.value[children] = -s.rate * side_g / (side_h + s.l2)
        # All bins of cut nodes move to a child.
        rank = np.full(len(tree.feature), -1)
        rank[split] = np.arange(len(split))
        place = rank[at[moving]]
        moving, place = moving[place >= 0], place[place >= 0]
        goes_left = np.arange(size) <= best["cut"][:, None]
        goes_left[:, 0] = best["null_left"]
        at[moving] = children[1][place] - goes_left.ravel()[place * size + flat[(feature * len(at))[place] + moving]]
        opens = (side_h >= _least_cut(s)) & (split < (1 << (s.depth - 1)) - 1)
        some = opens.any(axis=0)
        if not some.any():
            break
        # The smaller children are added up, the larger ones are what is left.
        children, parents, opens, leaf = children[:, some], parents[some], opens[:, some], at[own]
        taught = np.bincount(leaf, minlength=len(tree.feature))[children]
        small = np.argmin(taught, axis=0)
        pairs = np.arange(len(small))
        rank = np.full(len(tree.feature), -1)
        rank[children[small, pairs]] = pairs
        rank[children[1 - small, pairs]] = len(pairs)
        rank = rank[leaf]
        rows = np.flatnonzero((rank >= 0) & (rank < len(pairs)))
        before, sums = sums, np.empty((2 * len(pairs), *sums.shape[1:]))
        of_small = _node_sums([columns[f].take(own[rows]) for f in used], g[rows], h[rows], rank[rows], sums[: len(pairs)])
        np.subtract(before[parents], of_small, out=sums[len(pairs) :])
        nodes, is_open = (np.concatenate([x[small, pairs], x[1 - small, pairs]]) for x in (children, opens))
        stay = np.flatnonzero(rank >= 0)
        if len(stay) < 0.7 * len(own):
            own, g, h = own[stay], g[stay], h[stay]
    return tree, at


def _order(columns: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each feature, the places in order of their bins, where each bin starts, and the bins."""
    out = []
    for column in columns:
        rows = np.argsort(column, kind="stable")
        bins, first = np.unique(column[rows], return_index=True)
        out.append((rows, first, bins))
    return out


def _node_sums(columns: list[np.ndarray], g: np.ndarray, h: np.ndarray, node: np.ndarray, out: np.ndarray) -> np.ndarray:
    """(nodes, features, 2, bins): sums of g and h by bin of each feature."""
    first, cells = node * (BINS + 1), np.empty(len(node), np.int64)
    for j, bins in enumerate(columns):
        np.add(first, bins, out=cells)
        for k, x in enumerate((g, h)):
            out[:, j, k] = np.bincount(cells, x, len(out) * (BINS + 1)).reshape(len(out), -1)
    return out


def _step(most: float) -> float:
    """How many steps make 1, if sums of so much are to be exact. Cuts that part rows alike are
    then equal to the last bit, however their rows lie: the first of them is taken."""
    return 2.0 ** (51 - math.frexp(most)[1])


def _least_cut(s: Spec) -> float:
    """Second derivatives that a node has at least, if it can be cut (but for rounding)."""
    return 2 * s.least_weight * (1 - 1e-9)


def _fit_few(runs: DataFrame, booster: Boosted, different: int) -> None:
    """Grows all models from runs with few different bins, a block of trees a job: as many as
    keep a model's sums within HELD_BYTES."""
    specs, block = booster.specs, max(CUT, HELD_BYTES // (16 * max(1, different)))
    for start in range(0, max((s.trees for s in specs), default=0), block):
        turns = range(start, min(start + block, max(s.trees for s in specs)))
        sums = runs.mapInArrow(_drawn_sums(specs, turns), "model int, bins binary, sums binary")
        for r in sorted(sums.repartitionById(len(specs), "model").mapInArrow(_grown(booster, turns), TREES).collect(), key=lambda r: r["turn"]):  # a block a model
            kinds = (np.int16, np.int16, bool, np.float64)
            booster.trees[r["model"]].append(Tree(*(np.frombuffer(r[x], kind).copy() for x, kind in zip(("feature", "cut", "null_left", "value"), kinds))))
    for s, trees in zip(specs, booster.trees):  # a model that draws nothing has trees of one leaf
        trees += [Tree.grown(s.depth) for _ in range(s.trees - len(trees))]


LOSSES = "model int, loss double, n long"


def _held_out(specs: list[Spec], width: int):
    """Of all runs, once for each model: its log loss over the rows with a weight whose fold it
    held out, added up, and their number. Its trees are not kept."""

    def work(batches):
        held: dict[int, list] = {}
        for batch in batches:
            models = batch.column(0).to_numpy()
            for m in np.unique(models):
                own = batch.filter(pa.array(models == m))
                values, sizes = zip(*(_flat(own.column(k), kind) for k, kind in ((2, np.uint64), (3, np.float64), (4, np.float64), (5, np.int32))))
                held.setdefault(int(m), []).append((_array(own.column(1), np.uint8, width), sizes[0], *values))
        for m in list(held):
            s, (bins, sizes, at, label, weight, fold) = specs[m], (np.concatenate(x) for x in zip(*held.pop(m)))
            different, place = np.unique(np.ascontiguousarray(bins).view(np.dtype((np.void, width))).ravel(), return_inverse=True)
            columns, place = np.ascontiguousarray(different.view(np.uint8).reshape(-1, width).T), np.repeat(place, sizes)
            out = (fold == s.held_out) & (weight > 0)
            own_place, own_label = place[out], label[out]
            learnt = (fold != s.held_out) & (weight != 0) if s.held_out is not None else weight != 0
            place, at, label, weight = place[learnt], at[learnt], label[learnt], weight[learnt]
            margins = np.zeros(len(different))
            order, won_weight = _order(columns), weight * label
            for turn in range(s.trees):
                drawn = _is_drawn(at, s.seed, s.rows, turn)
                total, won = (np.bincount(place, x * drawn, len(margins)) for x in (weight, won_weight))
                p = 1 / (1 + np.exp(-margins))
                tree, leaf = _tree(s, turn, columns, order, p * total - won, total * np.maximum(p * (1 - p), 1e-16))
                margins += tree.value[leaf]
            p = np.clip(1 / (1 + np.exp(-margins[own_place])), 1e-15, 1 - 1e-15)
            loss = -(own_label * np.log(p) + (1 - own_label) * np.log(1 - p)).sum()
            yield pa.RecordBatch.from_pydict({"model": pa.array([m], pa.int32()), "loss": [float(loss)], "n": [len(own_place)]})

    return work


def held_out_losses(made: Prepared, specs: list[Spec]) -> list[tuple[float, int]] | None:
    """Of each spec, the log loss (p within 1e-15 of 0 and 1) added up over the rows with a weight
    whose fold it held out, and their number. None if the rows don't fit into a task, or are so many
    that drawing them for each model takes longer. Models grow side by side, the first ones first."""
    held = made.rows * ROW_BYTES + made.different * len(made.columns)
    if made.runs is None or not specs or held > HELD_BYTES or made.rows > DRAWN_APART * made.different:
        return None
    models = made.runs.sparkSession.range(0, len(specs), 1, len(specs)).select(F.col("id").cast("int").alias("model"))
    found = models.crossJoin(F.broadcast(made.runs)).mapInArrow(_held_out(specs, len(made.columns)), LOSSES).collect()  # a row a model
    by = {r["model"]: (r["loss"], r["n"]) for r in found}
    return [by[m] for m in range(len(specs))]


def _margins_of(booster: Boosted):
    width, models = len(booster.columns), len(booster.specs)

    def work(batches):
        for batch in batches:
            bins = _array(batch.column(0), np.uint8, width)
            margins = np.stack([booster.margins(bins, m) for m in range(models)], axis=1) if models else np.zeros((len(bins), 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(margins)], names=["bins", "margins"])

    return work


@dataclass
class Prepared:
    """Rows that models grow from: edges of the bins, and keys with STATE but for the margins,
    written; if few bins are different, how many (at most) and the runs of equal ones, else the
    steps that gradients are rounded to."""

    spark: SparkSession
    columns: list[str]
    edges: list[np.ndarray]
    state: DataFrame
    rows: int
    parts: int
    different: int = 0
    runs: DataFrame | None = None
    step: float = 1.0

    def release(self) -> None:
        if self.runs is not None:
            self.runs.unpersist()


def _read(df: DataFrame, name: str) -> DataFrame:
    """df, written. Plans of one shape, over and over: nothing to re-plan at run time."""
    session = df.sparkSession.newSession()
    session.conf.set("spark.sql.adaptive.enabled", "false")
    return session.read.schema(df.schema).parquet(*written(df, name).inputFiles())


def prepare(rows: DataFrame, columns: list[str], keys: list[str], label: str = "label", weight: str | None = "weight", fold: str | None = "fold") -> Prepared:
    """Bins of all rows, for as many fits as read them; `release` it after the last."""
    spark = rows.sparkSession
    edges = edges_of(rows, columns)
    state = _state(rows, columns, edges, keys, label, weight, fold)
    n = rows.count()
    parts = min(max(1, n // PART_ROWS), 16 * max(1, spark.sparkContext.defaultParallelism))
    made = Prepared(spark, columns, edges, state, n, parts)
    if not n:
        return made
    made.state = state = _read(state, "state")
    few = 2 * PART_ROWS
    different = state.select("bins").distinct().limit(few).count() if columns else few
    if different < few:
        # Equal bins meet in a task, in a few if they have millions of rows.
        dealt = state.repartition(max(parts, spark.sparkContext.defaultParallelism), "bins", F.pmod("at", F.lit(1 + n // (40 * PART_ROWS)))).sortWithinPartitions("bins")
        made.different, made.runs = different, _read(dealt.select("bins", "at", "label", "weight", "fold").mapInArrow(_runs(len(columns)), RUNS), "runs").persist()
    else:
        made.step = _step(state.agg(F.sum(F.abs("weight") * (1 + F.abs("label")))).first()[0])
    return made


def fit(rows: DataFrame, columns: list[str], specs: list[Spec], keys: list[str], label: str = "label", weight: str | None = "weight", fold: str | None = "fold") -> tuple[Boosted, DataFrame]:
    """Fits all specs; also gives keys, label, weight, fold and margins binary (a double for
    each spec) of every row, so that held-out rows are scored already.

    Nulls and NaN in columns are a bin of their own; rows without a label or a weight teach
    nothing (label 0, weight 0) and are scored; a null fold (-1) is no spec's; rows equal in
    keys and label are drawn alike; an empty table gives models without trees. Keys have other
    names than the columns that are given.
    """
    made = prepare(rows, columns, keys, label, weight, fold)
    out = grown(made, specs)
    made.release()
    return out


def grown(made: Prepared, specs: list[Spec]) -> tuple[Boosted, DataFrame]:
    """`fit` of prepared rows."""
    spark, columns, state, parts = made.spark, made.columns, made.state, made.parts
    booster = Boosted(columns, made.edges, specs, [[] for _ in specs])
    zeros = F.lit(bytes(8 * len(specs))).alias("margins")
    if not made.rows:
        return booster, state.select("*", zeros).drop("bins", "at")
    if made.runs is not None:
        _fit_few(made.runs, booster, made.different)
        margins = made.runs.select("bins").distinct().mapInArrow(_margins_of(booster), "bins binary, margins binary")
        final = written(state.drop("at").join(F.broadcast(margins), "bins").drop("bins"), "boosted")  # under `few` rows
        return booster, spark.read.schema(final.schema).parquet(*final.inputFiles())

    def settled(df: DataFrame) -> DataFrame:
        return _read(df, "margins").coalesce(parts).persist()

    state = settled(state.select("*", zeros).repartition(parts))
    block: list[dict[int, Tree]] = []  # trees that the written margins don't have yet
    for turn in range(max((s.trees for s in specs), default=0)):
        active = [m for m, s in enumerate(specs) if turn < s.trees]
        growing = {m: Tree.grown(specs[m].depth) for m in active}
        used = {m: _drawn(specs[m], turn, len(columns)) for m in active}
        frontier = {m: [0] for m in active}
        while frontier:
            found = _level(state, parts, made.step, booster, block, growing, frontier, used, turn)
            frontier = _grow(found, specs, growing)
        block.append(growing)
        for m in active:
            booster.trees[m].append(growing[m])
        if len(block) == CUT:
            state, before = settled(_with_margins(state, block, booster)), state
            before.unpersist()
            block = []
    out = _with_margins(state, block, booster) if block else state
    final = written(out.drop("bins", "at"), "boosted")
    state.unpersist()
    return booster, spark.read.schema(final.schema).parquet(*final.inputFiles())


def _drawn(spec: Spec, turn: int, width: int) -> np.ndarray:
    """The columns that a tree may use."""
    take = max(1, math.ceil(spec.columns * width))
    return np.sort(np.random.default_rng([spec.seed, turn]).permutation(width)[:take])


def _grow(found: list, specs: list[Spec], growing: dict[int, Tree]) -> dict[int, list[int]]:
    """Cuts open nodes where that gains; the nodes that are open now."""
    best: dict[tuple, object] = {}
    for r in sorted(found, key=lambda r: (r["model"], r["node"], -r["gain"], r["feature"])):
        best.setdefault((r["model"], r["node"]), r)
    frontier: dict[int, list[int]] = {}
    for (m, n), r in best.items():
        tree, s = growing[m], specs[m]
        leaf = lambda g, h: -s.rate * g / (h + s.l2)  # noqa: B023, E731
        tree.value[n] = leaf(r["g"], r["h"])
        if r["gain"] <= 0:
            continue
        tree.feature[n], tree.cut[n], tree.null_left[n] = r["feature"], r["cut"], r["null_left"]
        tree.value[2 * n + 1] = leaf(r["left_g"], r["left_h"])
        tree.value[2 * n + 2] = leaf(r["g"] - r["left_g"], r["h"] - r["left_h"])
        if n < (1 << (s.depth - 1)) - 1:  # its children are above the last level
            open_ = [k for k, h in ((2 * n + 1, r["left_h"]), (2 * n + 2, r["h"] - r["left_h"])) if h >= _least_cut(s)]
            if open_:
                frontier.setdefault(m, []).extend(open_)
    return frontier


def _with_margins(state: DataFrame, block, booster: Boosted) -> DataFrame:
    width, models = len(booster.columns), len(booster.specs)

    def work(batches):
        for batch in batches:
            names = batch.schema.names
            k = names.index("margins")
            bins = _array(batch.column(names.index("bins")), np.uint8, width)
            margins = _added(bins, _array(batch.column(k), np.float64, models), block, range(models))
            yield batch.set_column(k, "margins", _binary(margins))

    return state.mapInArrow(work, state.schema)


def unpacked(scored: DataFrame, models: int) -> DataFrame:
    """`margins` as an array of doubles, one for each spec."""
    kind = pa.list_(pa.float64())

    @F.arrow_udf("array<double>")
    def doubles(packed: pa.Array) -> pa.Array:
        x = _array(packed, np.float64, models)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, models), pa.int32()), pa.array(x.ravel())).cast(kind)

    return scored.withColumn("margins", doubles("margins"))


def held_out_scores(scored: DataFrame, specs: list[Spec]) -> DataFrame:
    """raw, p of each row by the model that held out its fold, in place of margins; rows of
    other folds go. Each fold is held out by one spec at most."""
    at = F.lit(-1)
    for m, s in enumerate(specs):
        at = F.when(F.col("fold") == s.held_out, m).otherwise(at) if s.held_out is not None else at
    own = unpacked(scored, len(specs)).withColumn("__at", at).where("__at >= 0")
    return own.withColumn("raw", F.get("margins", F.col("__at"))).withColumn("p", 1 / (1 + F.exp(-F.col("raw")))).drop("margins", "__at")


def scores(rows: DataFrame, booster: Boosted, model: int = 0) -> DataFrame:
    """All columns of rows, and raw, p by one model: for rows that were not there at the fit."""
    sent = rows.sparkSession.sparkContext.broadcast(booster)

    @F.arrow_udf("double")
    def margin(*columns: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays(list(columns), names=[str(k) for k in range(len(columns))])
        return pa.array(sent.value.margins(binned(batch, 0, sent.value.edges), model))

    raw = margin(*(F.col(f"`{c}`").cast("double") for c in booster.columns))
    return rows.withColumn("raw", raw).withColumn("p", 1 / (1 + F.exp(-F.col("raw"))))
