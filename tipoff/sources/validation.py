"""Checks of ingested tables."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

GAME_COLUMNS = ("Season", "DayNum", "WTeamID", "WScore", "LTeamID", "LScore")


def require_columns(df: DataFrame, columns, name: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks columns: {missing}")
    return df


def season_report(games: DataFrame, few: int = 1000) -> DataFrame:
    """One row per season: games, ids, null keys, impossible scores, and whether it is thin."""
    return games.groupBy("Season").agg(
        F.count("*").alias("games"), F.count_distinct("game_id").alias("ids"),
        F.count_if(F.col("WTeamID").isNull() | F.col("LTeamID").isNull()).alias("null_keys"),
        F.count_if(F.col("WScore") <= F.col("LScore")).alias("bad_scores"), (F.count("*") < few).alias("few_games"),
    )


def refuse_null_keys(games: DataFrame) -> DataFrame:
    """Fails, when it runs, on a game without season or teams."""
    bad = F.col("Season").isNull() | F.col("WTeamID").isNull() | F.col("LTeamID").isNull()
    return games.withColumn("Season", F.when(bad, F.raise_error(F.lit("a game lacks its season or a team"))).otherwise(F.col("Season")))


def watched(games: DataFrame, seasons: list[int]) -> tuple[DataFrame, Observation]:
    """The games, and figures of them that come with whatever job runs over them first: no scan
    of its own (PF13). `verdict` reads them. seasons: those whose games are counted."""
    seen = Observation()
    null_key = F.col("Season").isNull() | F.col("WTeamID").isNull() | F.col("LTeamID").isNull()
    each = [F.count_if(F.col("Season") == s).alias(f"season_{s}") for s in seasons]
    return games.observe(seen, F.count(F.lit(1)).alias("games"), F.count_if(null_key).alias("null_keys"), F.count_if(F.col("WScore") <= F.col("LScore")).alias("bad_scores"), *each), seen


def verdict(seen: Observation, few: int = 1000) -> dict[str, int]:
    """The figures, after a job has run: null keys are an error, thin seasons a warning."""
    found = seen.get
    if found["null_keys"]:
        raise ValueError(f"{found['null_keys']} games lack their season or a team")
    thin = sorted(k.removeprefix("season_") for k, n in found.items() if k.startswith("season_") and n < few)
    if thin:
        warnings.warn(f"under {few} games in seasons: {', '.join(thin)}", stacklevel=2)
    return found
