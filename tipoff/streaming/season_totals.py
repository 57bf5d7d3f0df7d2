"""Season totals per team that follow a stream of game rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.operators.games import team_games


def read_games(spark: SparkSession, folder: str, schema, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of games in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def season_totals(games: DataFrame) -> DataFrame:
    """Games, wins, points for and against per season and team; state is a row per team and
    season. Works on a stream (update or complete mode) and on a table alike."""
    return team_games(games).groupBy("Season", "TeamID").agg(
        F.count("*").alias("games"), F.sum("win").alias("wins"), F.sum("pts").alias("pts"), F.sum("opp_pts").alias("opp_pts")
    )
