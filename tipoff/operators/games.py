"""Game rows to team rows, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff.functions.scalars import possessions
from tipoff.operators.lineage import written
from tipoff.sources.adapter import BOX


def team_games(games: DataFrame) -> DataFrame:
    """Two rows per game, one from each side, out of one scan."""
    poss = (possessions("WFGA", "WOR", "WTO", "WFTA") + possessions("LFGA", "LOR", "LTO", "LFTA")) / 2

    def side(own, other, win, loc):
        return F.struct(
            F.col(f"{own}TeamID").alias("TeamID"), F.col(f"{other}TeamID").alias("OppID"),
            F.col(f"{own}Score").alias("pts"), F.col(f"{other}Score").alias("opp_pts"),
            F.lit(win).cast("long").alias("win"), loc.alias("loc"),
            *(F.col(own + b).alias(b) for b in BOX), *(F.col(other + b).alias(f"opp_{b}") for b in BOX),
        )

    away = F.when(F.col("WLoc") == "H", "A").when(F.col("WLoc") == "A", "H").otherwise("N")
    both = F.array(side("W", "L", 1, F.col("WLoc")), side("L", "W", 0, away))
    return games.select("game_id", "Season", "DayNum", "system", poss.alias("poss"), F.inline(both))


def _side_sql(own: str, other: str, win: int, loc: str) -> str:
    box = ", ".join(f'"{own}{b}" AS "{b}"' for b in BOX) + ", " + ", ".join(f'"{other}{b}" AS "opp_{b}"' for b in BOX)
    poss = " + ".join(f'("{s}FGA" - "{s}OR" + "{s}TO" + 0.475::DOUBLE * "{s}FTA")' for s in "WL")
    return f"""SELECT game_id, "Season", "DayNum", system, ({poss}) / 2 AS poss, "{own}TeamID" AS "TeamID", "{other}TeamID" AS "OppID",
    "{own}Score" AS pts, "{other}Score" AS opp_pts, CAST({win} AS BIGINT) AS win, {loc} AS loc, {box} FROM games"""


TEAM_GAMES_SQL = f"""
tg AS (
  {_side_sql("W", "L", 1, '"WLoc"')}
  UNION ALL
  {_side_sql("L", "W", 0, "CASE \"WLoc\" WHEN 'H' THEN 'A' WHEN 'A' THEN 'H' ELSE 'N' END")})"""


def numbered(rows: DataFrame, by: str, *order) -> DataFrame:
    """Adds rn long: the place of a row in its group's order, from 0 without gaps. Rows are
    dealt out in ranges of the order and numbered there; what ranges before hold of the group
    is added. A group of any size is in as many tasks as it takes."""
    ranges = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(ranges, F.col(by), *order).sortWithinPartitions(F.col(by), *order)
    placed = written(dealt.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    held = placed.groupBy(F.col(by).alias("__by"), part.alias("__part")).agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("__by").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = held.withColumn("__start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    met = placed.withColumn("__own", part).join(starts, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__own") == F.col("__part")))
    return met.select(*(F.col(c) for c in rows.columns), (F.col("__start") + F.col("__at") - F.col("__first")).alias("rn"))


def games_from_rows(rows: DataFrame) -> DataFrame:
    """One game out of each two consecutive team rows of a year (YEAR, BY_YEAR_NO descending):
    different rounds and ties are skipped, an odd last row is left over."""
    entry = F.struct("SCORE", "TEAM_NO", "TEAM", "SEED")
    met = numbered(rows, "YEAR", F.desc("BY_YEAR_NO")).withColumn("pair", F.floor(F.col("rn") / 2))
    joined = met.groupBy("YEAR", "pair").agg(
        F.count("*").alias("n"), F.min("CURRENT_ROUND").alias("Round"), F.max("CURRENT_ROUND").alias("other_round"),
        F.max(entry).alias("w"), F.min(entry).alias("l"),
    )
    return joined.where("n = 2 and Round = other_round and w.SCORE > l.SCORE").select(
        F.col("YEAR").alias("Season"),
        F.col("w.TEAM_NO").alias("WTeamID"), F.col("w.TEAM").alias("WTeam"), F.col("w.SEED").alias("WSeed"), F.col("w.SCORE").alias("WScore"),
        F.col("l.TEAM_NO").alias("LTeamID"), F.col("l.TEAM").alias("LTeam"), F.col("l.SEED").alias("LSeed"), F.col("l.SCORE").alias("LScore"),
        "Round",
    )
