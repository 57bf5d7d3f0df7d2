"""Opponent-adjusted efficiency: a fixpoint over all seasons at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.functions.scalars import efficiency
from tipoff.operators.features import KEY, _with_last_day
from tipoff.operators.lineage import written

#: Rounds between two lineage cuts.
CUT = 5
#: Ratings (a row per team and season, four numbers) that are sent to every task at most;
#: meetings of a task.
SMALL_ROWS, TASK_ROWS = 500_000, 50_000


def weighted_games(tg: DataFrame, half_life: float) -> DataFrame:
    """Efficiencies of each game and its recency weight."""
    aged = _with_last_day(tg).where(F.col("poss") > 0)
    weight = F.exp(-F.lit(0.6931471805599453 / half_life) * (F.col("last_day") - F.col("DayNum")))
    return aged.select(*KEY, "OppID", efficiency("pts", "poss").alias("oe"), efficiency("opp_pts", "poss").alias("de"), F.col("poss").alias("tempo"), F.when(F.col("loc") == "H", 1.0).otherwise(0.0).alias("home"), weight.alias("w"))


def meetings(games: DataFrame) -> DataFrame:
    """Sums of weighted and plain figures by team and opponent: a round only scales them by the
    opponent's rating, so games themselves are read once."""
    weighted = [F.sum(F.col("w") * F.col(c)).alias(f"w_{c}") for c in ("oe", "de", "home", "tempo")]
    plain = [F.sum(c).alias(f"s_{c}") for c in ("oe", "de", "tempo")]
    return games.groupBy(*KEY, "OppID").agg(*weighted, *plain, F.sum("w").alias("w"), F.count("*").alias("n"))


def _mean(column: str) -> F.Column:
    return F.sum(f"s_{column}") / F.sum("n")


def start_ratings(met: DataFrame) -> DataFrame:
    return met.groupBy(*KEY).agg(_mean("oe").alias("r_oe"), _mean("de").alias("r_de"))


def dealt(met: DataFrame, rows: int) -> DataFrame:
    """So many meetings dealt by team, kept, over as few tasks as they ask for: a round with
    ratings that are sent about then moves a row a team."""
    return met.repartition(max(1, -(-rows // TASK_ROWS)), *KEY).persist()


def step(met: DataFrame, ratings: DataFrame, hca: float, small: bool = False) -> DataFrame:
    """One round: every rating from the opponents' ratings of the round before; meetings have
    their league's means. `small`: the ratings were counted and fit every task."""
    other = ratings.select("Season", F.col("TeamID").alias("OppID"), F.col("r_oe").alias("o_oe"), F.col("r_de").alias("o_de"))
    rated = met.join(F.broadcast(other) if small else other, ["Season", "OppID"], "left")
    edge = F.col("w_home") * (hca / 2)
    oe = F.col("w_oe") * (F.col("l_de") / F.coalesce("o_de", "l_de")) - edge
    de = F.col("w_de") * (F.col("l_oe") / F.coalesce("o_oe", "l_oe")) + edge
    return rated.groupBy(*KEY).agg((F.sum(oe) / F.sum("w")).alias("r_oe"), (F.sum(de) / F.sum("w")).alias("r_de"))


def adjusted_tempo(met: DataFrame) -> DataFrame:
    """Weighted tempo against the opponents' mean tempo, out of meetings (IT2)."""
    mean = met.groupBy("Season", F.col("TeamID").alias("OppID")).agg(_mean("tempo").alias("o_tempo"))
    league = met.groupBy("Season").agg(_mean("tempo").alias("l_tempo"))
    rated = met.join(mean, ["Season", "OppID"], "left").join(F.broadcast(league), "Season")
    value = F.col("w_tempo") * F.col("l_tempo") / F.coalesce("o_tempo", "l_tempo")
    return rated.groupBy(*KEY).agg((F.sum(value) / F.sum("w")).alias("adj_tempo"))


def adjusted_efficiency(tg: DataFrame, rounds: int = 15, half_life: float = 30.0, hca: float = 3.5, history: bool = False):
    """(Season, TeamID, adj_oe, adj_de, adj_em, adj_tempo) after so many rounds (IT1).

    Ratings start from plain means and move by weighted means, all at once. With `history`,
    also the greatest change of the last round per season (IT3).
    """
    met = written(meetings(weighted_games(tg, half_life)), "meetings")
    league = written(met.groupBy("Season").agg(_mean("oe").alias("l_oe"), _mean("de").alias("l_de")), "league")
    ratings, before = written(start_ratings(met), "start"), None
    small = ratings.count() <= SMALL_ROWS
    held = met.join(F.broadcast(league), "Season")
    held = dealt(held, met.count()) if small else held
    for k in range(rounds):
        before, ratings = ratings, step(held, ratings, hca, small)
        if k % CUT == CUT - 1 or k == rounds - 1:
            ratings = written(ratings, f"round{k}")
    if small:
        held.unpersist()
    out = ratings.join(adjusted_tempo(met), KEY).select(*KEY, F.col("r_oe").alias("adj_oe"), F.col("r_de").alias("adj_de"), (F.col("r_oe") - F.col("r_de")).alias("adj_em"), "adj_tempo")
    if not history:
        return out
    old = before.select(*KEY, F.col("r_oe").alias("old"))
    return out, ratings.join(old, KEY).groupBy("Season").agg(F.max(F.abs(F.col("r_oe") - F.col("old"))).alias("max_change"))


def adjusted_sql(rounds: int, half_life: float = 30.0, hca: float = 3.5) -> str:
    """The same as common table expressions: wg, then r0 to r<rounds>."""
    parts = [f"""
wg AS (
  SELECT "Season", "TeamID", "OppID", 100.0::DOUBLE * pts / poss AS oe, 100.0::DOUBLE * opp_pts / poss AS de, poss AS tempo,
    CASE WHEN loc = 'H' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS home,
    exp(-({0.6931471805599453 / half_life!r}::DOUBLE) * (max("DayNum") OVER (PARTITION BY "Season") - "DayNum")) AS w FROM tg WHERE poss > 0),
league AS (SELECT "Season", avg(oe) AS l_oe, avg(de) AS l_de, avg(tempo) AS l_tempo FROM wg GROUP BY 1),
r0 AS (SELECT "Season", "TeamID", avg(oe) AS r_oe, avg(de) AS r_de FROM wg GROUP BY 1, 2)"""]
    for k in range(rounds):
        parts.append(f"""
r{k + 1} AS (
  SELECT g."Season", g."TeamID",
    sum(w * (oe * (l_de / coalesce(o.r_de, l_de)) - home * {hca / 2!r}::DOUBLE)) / sum(w) AS r_oe,
    sum(w * (de * (l_oe / coalesce(o.r_oe, l_oe)) + home * {hca / 2!r}::DOUBLE)) / sum(w) AS r_de
  FROM wg g JOIN league l ON l."Season" = g."Season" LEFT JOIN r{k} o ON o."Season" = g."Season" AND o."TeamID" = g."OppID" GROUP BY 1, 2)""")
    parts.append("""
tempo AS (
  SELECT g."Season", g."TeamID", sum(w * tempo * l_tempo / coalesce(m, l_tempo)) / sum(w) AS adj_tempo
  FROM wg g JOIN league l ON l."Season" = g."Season"
  LEFT JOIN (SELECT "Season" AS s, "TeamID" AS o, avg(tempo) AS m FROM wg GROUP BY 1, 2) ON s = g."Season" AND o = g."OppID" GROUP BY 1, 2)""")
    return ",".join(parts)
