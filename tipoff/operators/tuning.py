"""Search over parameters by tree-structured Parzen estimators.

Trials so far are split into the best and the rest; each parameter gets a density of either, a
mixture of normals around its trials and an even prior. Candidates drawn from the density of the
best are ranked by the ratio of the two. Several trials of a batch are proposed one after another
(those in the making count among the rest) and evaluated together, so that their models grow in
the same jobs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.operators import boosting
from tipoff.operators.boosting import Spec


@dataclass(frozen=True)
class Range:
    low: float
    high: float
    log: bool = False
    whole: bool = False

    def value(self, u: float):
        """The value at a share of the range."""
        a, b = (math.log(self.low), math.log(self.high)) if self.log else (self.low - 0.5 * self.whole, self.high + 0.5 * self.whole)
        x = a + min(max(u, 0.0), 1.0) * (b - a)
        x = math.exp(x) if self.log else x
        return int(min(max(round(x), self.low), self.high)) if self.whole else min(max(x, self.low), self.high)


#: Parameters of boosted trees and their ranges, as published (fixed values).
SPACE = {"trees": Range(100, 500, whole=True), "depth": Range(2, 8, whole=True), "rate": Range(0.01, 0.3, log=True), "rows": Range(0.6, 1.0), "columns": Range(0.6, 1.0)}


class Parzen:
    """Even prior and a normal around each point, cut off at 0 and 1; a point's width is the
    distance to its farther neighbour, within bounds that shrink as points come in."""

    def __init__(self, points: list[float]):
        self.points = np.sort(np.array(points, dtype=np.float64))
        ends = np.concatenate([[0.0], self.points, [1.0]])
        gaps = np.diff(ends)
        self.width = np.clip(np.maximum(gaps[:-1], gaps[1:]), 1 / min(100, 1 + len(points)), 1.0) if len(points) else np.zeros(0)

    def draw(self, rng: np.random.Generator) -> float:
        k = rng.integers(len(self.points) + 1)
        if k == len(self.points):
            return float(rng.random())
        while True:
            u = rng.normal(self.points[k], self.width[k])
            if 0 <= u <= 1:
                return float(u)

    def density(self, u: float) -> float:
        total = 1.0
        for x, w in zip(self.points, self.width):
            inside = 0.5 * (math.erf((1 - x) / (w * math.sqrt(2))) - math.erf(-x / (w * math.sqrt(2))))
            total += math.exp(-0.5 * ((u - x) / w) ** 2) / (w * math.sqrt(2 * math.pi)) / inside
        return total / (1 + len(self.points))


@dataclass
class Trial:
    place: int
    at: dict[str, float]
    params: dict
    loss: float = math.nan


def search(evaluate: Callable[[list[dict]], list[float]], space: dict[str, Range], trials: int = 50, batch: int = 5, startup: int = 10, candidates: int = 24, best_share: float = 0.2, seed: int = 42) -> list[Trial]:
    """Trials, the least loss first (the earlier on ties). A loss that is no number counts as
    worse than any; the same seed gives the same proposals for the same losses."""
    rng = np.random.default_rng(seed)
    done: list[Trial] = []
    while len(done) < trials:
        making: list[Trial] = []
        for _ in range(min(batch, trials - len(done))):
            if len(done) < startup:
                at = {name: float(rng.random()) for name in space}
            else:
                ranked = sorted(done, key=lambda t: (not math.isfinite(t.loss), t.loss if math.isfinite(t.loss) else 0.0, t.place))
                n_best = max(1, math.ceil(best_share * len(ranked)))
                good = {name: Parzen([t.at[name] for t in ranked[:n_best]]) for name in space}
                rest = {name: Parzen([t.at[name] for t in ranked[n_best:] + making]) for name in space}
                at = {}
                for name in space:
                    drawn = [good[name].draw(rng) for _ in range(candidates)]
                    at[name] = max(drawn, key=lambda u: good[name].density(u) / rest[name].density(u))  # noqa: B023
            making.append(Trial(len(done) + len(making), at, {name: r.value(at[name]) for name, r in space.items()}))
        for trial, loss in zip(making, evaluate([t.params for t in making])):
            trial.loss = float(loss)
        done += making
    return sorted(done, key=lambda t: (not math.isfinite(t.loss), t.loss if math.isfinite(t.loss) else 0.0, t.place))


def held_out_losses(made: boosting.Prepared, folds: list[int], options: list[dict]) -> list[float]:
    """Log loss of each option over rows whose fold was held out; all models of all options grow
    side by side, those with the most levels first."""
    first = sorted(range(len(options)), key=lambda t: -(s := Spec(**options[t])).trees * s.depth)
    specs = [Spec(k, **options[t]) for t in first for k in folds]
    sums = boosting.held_out_losses(made, specs)
    if sums is not None:
        found = {}
        for at, t in enumerate(first):
            loss, n = (sum(x) for x in zip(*sums[at * len(folds) : (at + 1) * len(folds)]))
            found[t] = loss / n if n else math.nan
        return [found[t] for t in range(len(options))]
    _, scored = boosting.grown(made, specs)
    at = F.array_position(F.array(*map(F.lit, folds)), F.col("fold")).cast("int") - 1
    own = boosting.unpacked(scored, len(specs)).where((at >= 0) & (F.col("weight") > 0)).withColumn("at", at)
    every = own.select("label", F.inline(F.array(*(F.struct(F.lit(t).alias("trial"), F.get("margins", k * len(folds) + F.col("at")).alias("raw")) for k, t in enumerate(first)))))
    p = F.greatest(F.least(1 / (1 + F.exp(-F.col("raw"))), F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = -F.avg(F.col("label") * F.ln(p) + (1 - F.col("label")) * F.ln(1 - p))
    found = {r["trial"]: r["loss"] for r in every.groupBy("trial").agg(loss.alias("loss")).collect()}
    return [found.get(t, math.nan) for t in range(len(options))]


def tune(rows: DataFrame, columns: list[str], space: dict[str, Range] = SPACE, trials: int = 50, batch: int = 5, startup: int = 10, seed: int = 42, by: str = "Season") -> list[Trial]:
    """Trials of boosted trees by season-held-out log loss, the best first (ML7). Rows are put
    into bins once for all batches."""
    made = boosting.prepare(rows.withColumn("fold", F.col(by).cast("int")), columns, ["game_id"])
    folds = [r[0] for r in made.state.select("fold").where("fold >= 0").distinct().orderBy("fold").collect()]  # a row per season
    tried = search(lambda options: held_out_losses(made, folds, options), space, trials, batch, startup, seed=seed)
    made.release()
    return tried
