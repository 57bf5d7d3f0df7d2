"""Game log, seeds, rankings and lines out of the order tables, and the same as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Box-score columns of a side, as an expression of part key p, line number n, order key o.
BOX = {
    "FGM": "20 + {p} % 17",
    "FGA": "45 + {p} % 25",
    "FGM3": "4 + {p} % 9",
    "FTM": "2 + {p} % 4",
    "FTA": "5 + {p} % 20",
    "OR": "3 + {o} % 12",
    "DR": "15 + ({o} + {p}) % 14",
    "TO": "5 + ({p} + {n}) % 15",
}
TEAMS, FIRST_TEAM = 128, 1101
TOURNEY_DAY, CONF_DAY = 330, 300
#: Order lines of a task, at most about.
TASK_LINES = 500_000
REGIONS = ("W", "X", "Y", "Z")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def game_log(spark: SparkSession, sf_dir: str, season: int | None = None) -> DataFrame:
    """One row per game: consecutive lines of an order meet. One exchange on the order key
    serves the join and the window. With a season, only its dates are read from the orders."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderpriority")
    if season is not None:
        day = lambda y: F.lit(f"{y}-01-01").cast(orders.schema["o_orderdate"].dataType)
        orders = orders.where((F.col("o_orderdate") >= day(season)) & (F.col("o_orderdate") < day(season + 1)))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    score = F.lit(40) + F.floor("l_quantity").cast("long")
    side = F.struct(F.col("l_partkey").alias("p"), F.col("l_linenumber").cast("long").alias("n"), score.alias("score"), (FIRST_TEAM + F.col("l_partkey") % TEAMS).alias("team"))
    met = (
        _dealt(items, orders)
        .withColumn("rn", F.row_number().over(order))
        .withColumn("a", side)
        .withColumn("b", F.lead("a").over(order))
        .where("rn % 2 = 1 and b is not null and a.team <> b.team and a.score <> b.score")
    )
    met = met.withColumn("w", F.when(F.expr("a.score > b.score"), F.col("a")).otherwise(F.col("b"))).withColumn("l", F.when(F.expr("a.score > b.score"), F.col("b")).otherwise(F.col("a")))
    box = [F.expr(e.format(p=f"{s.lower()}.p", n=f"{s.lower()}.n", o="l_orderkey")).cast("long").alias(s + name) for s in "WL" for name, e in BOX.items()]
    line = F.when(F.expr("a.p % 37 <> 0"), (F.expr("a.p % 61") - 30) / F.lit(2.0))
    return met.select(
        (F.col("l_orderkey") * 100 + F.col("rn")).alias("game_id"),
        F.year("o_orderdate").cast("long").alias("Season"),
        F.dayofyear("o_orderdate").cast("long").alias("DayNum"),
        F.col("w.team").alias("WTeamID"), F.col("w.score").alias("WScore"),
        F.col("l.team").alias("LTeamID"), F.col("l.score").alias("LScore"),
        F.when(F.col("l_returnflag") == "R", "H").when(F.col("l_returnflag") == "A", "A").otherwise("N").alias("WLoc"),
        *box,
        F.col("a.team").alias("home_id"), F.col("b.team").alias("road_id"),
        F.col("a.score").alias("hscore"), F.col("b.score").alias("rscore"), line.alias("line"),
        F.col("o_orderpriority").alias("system"),
    )


def _box_sql(side: str) -> str:
    key, number = ("wp", "wn") if side == "W" else ("lp", "ln")
    return ", ".join(f'CAST({e.format(p=key, n=number, o="l_orderkey")} AS BIGINT) AS "{side}{name}"' for name, e in BOX.items())


def _dealt(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines with their orders, dealt by order over as many tasks as their number asks for, so
    that a task's share doesn't grow with the input. A small table takes the session's tasks."""
    lines = items.count()  # from the files' footers
    parts = -(-lines // TASK_LINES)
    if parts > int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        items, orders = items.repartition(parts, "l_orderkey"), orders.repartition(parts, "l_orderkey")
    return items.join(orders, "l_orderkey")


GAMES_SQL = f"""
met0 AS (
  SELECT l.l_orderkey, o.o_orderdate, o.o_orderpriority, l.l_returnflag, l.l_partkey AS ap, CAST(l.l_linenumber AS BIGINT) AS an,
    40 + CAST(floor(l.l_quantity) AS BIGINT) AS a_score, row_number() OVER w AS rn,
    lead(l.l_partkey) OVER w AS bp, lead(CAST(l.l_linenumber AS BIGINT)) OVER w AS bn,
    lead(40 + CAST(floor(l.l_quantity) AS BIGINT)) OVER w AS b_score
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WINDOW w AS (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice)),
met AS (
  SELECT *, CASE WHEN a_score > b_score THEN ap ELSE bp END AS wp, CASE WHEN a_score > b_score THEN bp ELSE ap END AS lp,
    CASE WHEN a_score > b_score THEN an ELSE bn END AS wn, CASE WHEN a_score > b_score THEN bn ELSE an END AS ln
  FROM met0 WHERE rn % 2 = 1 AND bp IS NOT NULL AND ap % {TEAMS} <> bp % {TEAMS} AND a_score <> b_score),
games AS (
  SELECT l_orderkey * 100 + rn AS game_id, CAST(year(o_orderdate) AS BIGINT) AS "Season", CAST(dayofyear(o_orderdate) AS BIGINT) AS "DayNum",
    {FIRST_TEAM} + wp % {TEAMS} AS "WTeamID", greatest(a_score, b_score) AS "WScore", {FIRST_TEAM} + lp % {TEAMS} AS "LTeamID", least(a_score, b_score) AS "LScore",
    CASE l_returnflag WHEN 'R' THEN 'H' WHEN 'A' THEN 'A' ELSE 'N' END AS "WLoc",
    {_box_sql("W")}, {_box_sql("L")},
    {FIRST_TEAM} + ap % {TEAMS} AS home_id, {FIRST_TEAM} + bp % {TEAMS} AS road_id, a_score AS hscore, b_score AS rscore,
    CASE WHEN ap % 37 <> 0 THEN CAST(ap % 61 - 30 AS DOUBLE) / 2 END AS line, o_orderpriority AS system
  FROM met)"""


def seeds(games: DataFrame, by_team: bool = False) -> DataFrame:
    """(Season, TeamID, rank, Seed): the 64 teams with most points; region by turns.
    `by_team`: games are team rows already."""
    from tipoff.operators.games import team_games

    order = Window.partitionBy("Season").orderBy(F.desc("total"), "TeamID")
    totals = (games if by_team else team_games(games)).groupBy("Season", "TeamID").agg(F.sum("pts").alias("total"))
    ranked = totals.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 64")
    region = F.element_at(F.array(*map(F.lit, REGIONS)), ((F.col("rank") - 1) % 4 + 1).cast("int"))
    return ranked.select("Season", "TeamID", "rank", F.concat(region, F.lpad(((F.col("rank") - 1) / 4).cast("int") + 1, 2, "0")).alias("Seed"))


SEEDS_SQL = f"""
seeds AS (
  SELECT "Season", "TeamID", rank,
    substr('{"".join(REGIONS)}', CAST((rank - 1) % 4 + 1 AS INT), 1) || lpad(CAST((rank - 1) // 4 + 1 AS VARCHAR), 2, '0') AS "Seed",
    CAST((rank - 1) // 4 + 1 AS BIGINT) AS seed_no, CAST((rank - 1) % 4 AS BIGINT) AS region_no
  FROM (SELECT *, row_number() OVER (PARTITION BY "Season" ORDER BY total DESC, "TeamID") AS rank
    FROM (SELECT "Season", "TeamID", sum(pts) AS total FROM tg GROUP BY ALL)) WHERE rank <= 64)"""


def tourney_games(games: DataFrame, seeded: DataFrame) -> DataFrame:
    """Late games between two seeded teams (semi-joins on both sides)."""
    field = seeded.select("Season", "TeamID")
    late = games.where(F.col("DayNum") > TOURNEY_DAY)
    first = late.join(field.withColumnRenamed("TeamID", "WTeamID"), ["Season", "WTeamID"], "left_semi")
    return first.join(field.withColumnRenamed("TeamID", "LTeamID"), ["Season", "LTeamID"], "left_semi").select(*games.columns)


TOURNEY_SQL = f"""
tourney AS (
  SELECT g.* FROM games g
  WHERE g."DayNum" > {TOURNEY_DAY}
    AND EXISTS (SELECT 1 FROM seeds s WHERE s."Season" = g."Season" AND s."TeamID" = g."WTeamID")
    AND EXISTS (SELECT 1 FROM seeds s WHERE s."Season" = g."Season" AND s."TeamID" = g."LTeamID"))"""


def conferences(games: DataFrame, nation: DataFrame, by_team: bool = False) -> DataFrame:
    """(Season, TeamID, ConfAbbrev): teams that played, each in the conference of a nation."""
    from tipoff.operators.games import team_games

    played = (games if by_team else team_games(games)).select("Season", "TeamID").distinct()
    names = nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("ConfAbbrev"))
    return played.join(F.broadcast(names), F.col("TeamID") % 25 == F.col("k")).select("Season", "TeamID", "ConfAbbrev")


CONF_SQL = """
conf AS (
  SELECT DISTINCT t."Season", t."TeamID", n.n_name AS "ConfAbbrev" FROM tg t JOIN nation n ON t."TeamID" % 25 = n.n_nationkey)"""


def rankings(games: DataFrame, by_team: bool = False) -> DataFrame:
    """(Season, RankingDayNum, SystemName, TeamID, OrdinalRank): each system ranks, every 30
    days, the teams it has seen by their point margin so far that month."""
    from tipoff.operators.games import team_games

    day = (F.floor(F.col("DayNum") / 30) * 30).cast("long")
    margins = (games if by_team else team_games(games)).groupBy("Season", day.alias("RankingDayNum"), F.col("system").alias("SystemName"), "TeamID").agg(F.sum(F.col("pts") - F.col("opp_pts")).alias("margin"))
    order = Window.partitionBy("Season", "RankingDayNum", "SystemName").orderBy(F.desc("margin"), "TeamID")
    return margins.select("Season", "RankingDayNum", "SystemName", "TeamID", F.row_number().over(order).cast("long").alias("OrdinalRank"))


RANKINGS_SQL = """
rankings AS (
  SELECT "Season", day AS "RankingDayNum", system AS "SystemName", "TeamID",
    row_number() OVER (PARTITION BY "Season", day, system ORDER BY margin DESC, "TeamID") AS "OrdinalRank"
  FROM (SELECT "Season", CAST(("DayNum" // 30) * 30 AS BIGINT) AS day, system, "TeamID", sum(pts - opp_pts) AS margin FROM tg GROUP BY ALL))"""
