"""Histogram sort: shards of near-equal bytes along a key, found by counting.

Candidate boundaries split the key range evenly; one pass counts the exact bytes and rows
between them; each splitter keeps the candidate nearest to its target if that is within
tolerance, and otherwise looks again inside the one stretch that holds its target. The
documents move once, after all splitters stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import settle
from tipoff.llm.packing import rank_within

#: Candidates counted per pass; the counts that reach the driver are at most so many.
PROBES = 8192
TOP = 1 << 62
LEVELS = ("key", "tie", "row")


def _key(*columns) -> F.Column:
    """A hash from 0 to 2^62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2)


def _passes(keys: DataFrame, column: str, within, targets: dict[int, float], below: float, tolerance: float, narrow) -> dict[int, int]:
    """Boundaries on one integer column: target number -> least key of the right side.

    `below`: bytes before all these rows. `narrow(k, value)` takes over where a single key
    holds more bytes than the tolerance allows.
    """
    found: dict[int, int] = {}
    open_: dict[tuple[int, int, float], list[int]] = {(0, TOP, below): list(targets)}
    while open_:
        each = max(2, PROBES // len(open_))
        case, step_of = None, []
        for n, (lo, hi, _) in enumerate(open_):
            step = max(1, -(-(hi - lo) // each))
            step_of.append(step)
            here = (F.col(column) >= lo) & (F.col(column) < hi)
            value = F.lit(n * (each + 1)) + F.expr(f"(`{column}` - {lo}L) div {step}L")
            case = F.when(here, value) if case is None else case.when(here, value)
        rows = keys.where(within) if within is not None else keys
        counts = rows.groupBy(case.alias("probe")).agg(F.sum("size").alias("bytes")).where("probe is not null").collect()
        held: dict[int, dict[int, int]] = {}
        for r in counts:
            n, k = divmod(r["probe"], each + 1)
            held.setdefault(n, {})[k] = r["bytes"]
        again: dict[tuple[int, int, float], list[int]] = {}
        for n, ((lo, hi, start), wanted) in enumerate(open_.items()):
            step, edges, total = step_of[n], [(lo, start)], start
            for k in sorted(held.get(n, {})):
                edges.append((lo + k * step, total))
                total += held[n][k]
                edges.append((min(hi, lo + (k + 1) * step), total))
            for t in wanted:
                edge, at = min(edges, key=lambda e: abs(e[1] - targets[t]))
                if abs(at - targets[t]) <= tolerance:
                    found[t] = edge
                    continue
                (a, under), (b, _) = next((x, y) for x, y in zip(edges, edges[1:]) if x[1] <= targets[t] <= y[1] and x[0] < y[0])
                if b - a > 1:
                    again.setdefault((a, b, under), []).append(t)
                else:
                    found[t] = narrow(t, a, under, edge)
        open_ = again
    return found


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, ...]]:
    """Ascending (key, tie, row) of the first document of shards 1 to shards - 1. Each level
    takes over where one value of the level before exceeds the tolerance at a boundary."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    targets = {k: k * total / shards for k in range(1, shards)}
    cuts: dict[int, tuple[int, ...]] = {}

    def level(fixed: tuple[int, ...], wanted: list[int], below: float) -> None:
        column, deeper = LEVELS[len(fixed)], {}
        within = None
        for name, value in zip(LEVELS, fixed):
            within = (F.col(name) == value) if within is None else within & (F.col(name) == value)

        def narrow(t, value, under, edge):
            deeper.setdefault((value, under), []).append(t)
            return edge

        found = _passes(keys, column, within, {t: targets[t] for t in wanted}, below, slack, narrow)
        cuts.update({t: (*fixed, v) for t, v in found.items()})
        if len(fixed) + 1 < len(LEVELS):
            for (value, under), again in deeper.items():  # at most shards - 1 of them
                level((*fixed, value), again, under)

    level((), list(targets), 0)
    return sorted((*c, *(0,) * (len(LEVELS) - len(c))) for c in cuts.values())


def shard(docs: DataFrame, size_col: str, key_cols: list[str], tie_cols: list[str], shards: int, tolerance: float = 0.005) -> DataFrame:
    """All columns of docs plus shard int (0 to shards - 1) and slot long (gapless from 0).

    Rows are ordered by a hash of `key_cols`, then one of `tie_cols`, then a number of the row
    itself; each shard's bytes (sum of `size_col`, not null, not negative) are within about
    `tolerance` of the mean, or of it and the largest single row. Rows with equal keys stay
    together unless together they exceed the tolerance just where a boundary falls; then they
    part by tie, and rows equal in both by row. Nulls hash like any value; an empty table gives
    no rows. Columns named shard and slot are replaced; other names of docs may be any.

    The rows are written once, with their numbers, so that all passes and the last exchange see
    the same ones whatever is lost and computed anew.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    whole = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc")
    numbered = docs.select(whole, F.col(f"`{size_col}`").alias("size"), _key(*key_cols).alias("key"), _key(*tie_cols).alias("tie"), F.monotonically_increasing_id().alias("row"))
    keyed = settle(numbered.withColumn("row", _key("key", "row")), "keyed")
    case = F.lit(shards - 1)
    for n, cut in reversed(list(enumerate(splitters(keyed.select("size", *LEVELS), shards, tolerance)))):
        before = F.struct(*LEVELS) < F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(LEVELS, cut)))
        case = F.when(before, n).otherwise(case)
    salts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rank_within(keyed.drop("size").withColumn("shard", case.cast("int")), "shard", list(LEVELS), "slot", salts)
    return placed.select("doc.*", "shard", "slot")
