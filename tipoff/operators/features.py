"""Team-season features. Every function takes frames keyed by (Season, TeamID) and handles
all seasons at once; shuffles are on that key, after partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff.functions.scalars import efficiency, ratio, seed_number
from tipoff.operators.medians import medians

KEY = ["Season", "TeamID"]
KINDS = ("efg", "to_rate", "or_rate", "ft_rate")


def _box_columns(tg: DataFrame) -> list[str]:
    return [c for c in tg.columns if c.removeprefix("opp_").isupper() or c.endswith("FGM3")]


def _factors() -> list[F.Column]:
    """The eight ratios out of summed box columns."""

    def side(p, q):
        c = lambda n: F.col(p + n)
        return [
            ratio(c("FGM") + 0.5 * c("FGM3"), c("FGA")), ratio(c("TO"), c("FGA") + 0.475 * c("FTA") + c("TO")),
            ratio(c("OR"), c("OR") + F.col(q + "DR")), ratio(c("FTM"), c("FGA")),
        ]

    return [x.alias(f"{name}_{k}") for name, p, q in (("off", "", "opp_"), ("def", "opp_", "")) for k, x in zip(KINDS, side(p, q))]


def four_factors(tg: DataFrame) -> DataFrame:
    """Shooting, turnovers, rebounds and free throws, for and against (F1)."""
    sums = tg.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in _box_columns(tg)))
    return sums.select(*KEY, *_factors())


def season_features(tg: DataFrame, top: DataFrame, last_n: int = 10, days: int = 30, trend_days: int = 45, least: int = 3) -> DataFrame:
    """four_factors, rolling, form, road_win_pct, late_season and trajectory side by side. Games
    don't move: tasks add them up by team, but for the few that may be a team's last and the
    different opponents late in the season. A team without rows for one has nulls there."""
    best = top.select("Season", F.col("TeamID").alias("OppID"), F.lit(True).alias("vs_top"))
    rows = _with_last_day(tg).join(F.broadcast(best), ["Season", "OppID"], "left")
    age, real, margin = F.col("last_day") - F.col("DayNum"), F.col("poss") > 0, F.col("pts") - F.col("opp_pts")
    recent = real & (age < days)
    late, trend = real & (age <= days) & F.col("vs_top"), real & (age <= trend_days)
    of = lambda when, x: F.when(when, x)
    oe, de = F.avg(of(late, efficiency("pts", "poss"))), F.avg(of(late, efficiency("opp_pts", "poss")))
    day, wide = of(trend, F.col("DayNum").cast("double")), margin.cast("double")
    slope = lambda y: F.when(F.count(day) >= least, F.regr_slope(of(trend, y), day))
    sums = rows.groupBy(*KEY).agg(
        *(F.sum(c).alias(c) for c in _box_columns(tg)),
        (100.0 * F.sum(of(recent, F.col("pts"))) / F.sum(of(recent, F.col("poss")))).alias("rolling_oe"),
        (100.0 * F.sum(of(recent, F.col("opp_pts"))) / F.sum(of(recent, F.col("poss")))).alias("rolling_de"),
        F.avg(of(recent, F.col("win"))).alias("win_pct_30d"),
        F.avg("pts").alias("__pts"),
        F.avg("win").alias("season_win_pct"),
        F.avg(margin).alias("season_avg_mov"),
        F.avg(of(F.col("loc").isin("A", "N"), F.col("win"))).alias("road_win_pct"),
        oe.alias("late_adj_oe"), de.alias("late_adj_de"), (oe - de).alias("late_adj_em"),
        slope(100 * wide / F.col("poss")).alias("efficiency_trend"),
        slope(wide).alias("margin_trend"),
    )
    last = last_games(tg, last_n).groupBy(*KEY).agg(F.avg("win").alias("win_pct_last10"), F.avg(margin).alias("avg_mov_last10"), F.avg("pts").alias("__last"))
    met = rows.where(late).groupBy(*KEY, "OppID").agg(F.count("*").alias("n")).groupBy(*KEY).agg(F.count("*").alias("late_sos"))
    out = sums.join(last, KEY, "left").join(met, KEY, "left").withColumn("scoring_trend", F.col("__last") - F.col("__pts"))
    return out.select(*KEY, *_factors(), *(c for c in out.columns if c not in (*KEY, *_box_columns(tg), "__last", "__pts")))


def last_games(tg: DataFrame, n: int) -> DataFrame:
    """KEY, pts, opp_pts, win of a team's last n games; games of a day go by id. Days are counted
    first: only those of the last days that hold n are put in order."""
    days = tg.groupBy(*KEY, "DayNum").agg(F.count("*").alias("games"))
    later = Window.partitionBy(*KEY).orderBy(F.desc("DayNum")).rowsBetween(Window.unboundedPreceding, -1)  # a row per day
    since = days.withColumn("later", F.coalesce(F.sum("games").over(later), F.lit(0))).where(F.col("later") < n).groupBy(*KEY).agg(F.min("DayNum").alias("since"))
    order = Window.partitionBy(*KEY).orderBy(F.desc("DayNum"), F.desc("game_id"))
    few = tg.join(F.broadcast(since), KEY).where(F.col("DayNum") >= F.col("since")).select(*KEY, "DayNum", "game_id", "pts", "opp_pts", "win")
    return few.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).drop("rn", "DayNum", "game_id")


def rolling(tg: DataFrame, days: int = 30) -> DataFrame:
    """Ratio of sums over the last days of a season, first day excluded."""
    recent = _with_last_day(tg).where((F.col("DayNum") > F.col("last_day") - days) & (F.col("poss") > 0))
    return recent.groupBy(*KEY).agg(
        (100.0 * F.sum("pts") / F.sum("poss")).alias("rolling_oe"),
        (100.0 * F.sum("opp_pts") / F.sum("poss")).alias("rolling_de"),
        F.avg("win").alias("win_pct_30d"),
    )


def _with_last_day(tg: DataFrame) -> DataFrame:
    """The season's last day on every row: a row per season is joined back, which moves no
    games (a window over a whole season would put it into one task)."""
    return tg.join(F.broadcast(tg.groupBy("Season").agg(F.max("DayNum").alias("last_day"))), "Season")


def form(tg: DataFrame, last_n: int = 10) -> DataFrame:
    """Last games against the whole season; games of a day go by id."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("DayNum"), F.desc("game_id"))
    last = F.col("rn") <= last_n
    margin = F.col("pts") - F.col("opp_pts")
    return tg.withColumn("rn", F.row_number().over(order)).groupBy(*KEY).agg(
        F.avg(F.when(last, F.col("win"))).alias("win_pct_last10"),
        F.avg(F.when(last, margin)).alias("avg_mov_last10"),
        (F.avg(F.when(last, F.col("pts"))) - F.avg("pts")).alias("scoring_trend"),
        F.avg("win").alias("season_win_pct"),
        F.avg(margin).alias("season_avg_mov"),
    )


def road_win_pct(tg: DataFrame) -> DataFrame:
    """Wins among away and neutral games."""
    return tg.where(F.col("loc").isin("A", "N")).groupBy(*KEY).agg(F.avg("win").alias("road_win_pct"))


def conf_strength(conf: DataFrame, ratings: DataFrame) -> DataFrame:
    """A conference's mean rating, back on its members."""
    rated = conf.join(ratings.select(*KEY, "adj_em"), KEY, "left")
    mean = rated.groupBy("Season", "ConfAbbrev").agg(F.avg("adj_em").alias("conf_strength"))
    return conf.join(mean, ["Season", "ConfAbbrev"]).select(*KEY, "conf_strength")


def latest_rankings(ranks: DataFrame, systems: list[str], filter_first: bool = True) -> DataFrame:
    """Rankings of a season's last day: that of the systems asked for, or that of all (where
    a system whose own last day is earlier vanishes)."""
    wanted = ranks.where(F.col("SystemName").isin(systems))
    last = (wanted if filter_first else ranks).groupBy("Season").agg(F.max("RankingDayNum").alias("RankingDayNum"))
    return wanted.join(F.broadcast(last), ["Season", "RankingDayNum"])


def ranking_columns(latest: DataFrame, systems: list[str]) -> DataFrame:
    """A column per system and the mean of those that ranked the team."""
    wide = latest.groupBy(*KEY).pivot("SystemName", systems).agg(F.max("OrdinalRank"))
    mean = latest.groupBy(*KEY).agg(F.avg("OrdinalRank").alias("rank_composite"))
    names = {s: "rank_" + "".join(c if c.isalnum() else "_" for c in s.lower()) for s in systems}
    return wide.withColumnsRenamed(names).join(mean, KEY)


def seed_numbers(seeds: DataFrame) -> DataFrame:
    return seeds.select(*KEY, seed_number("Seed").cast("long").alias("seed"))


def top_teams(latest: DataFrame, n: int) -> DataFrame:
    """The n teams of a season with the least mean rank."""
    order = Window.partitionBy("Season").orderBy("rank_mean", "TeamID")
    mean = latest.groupBy(*KEY).agg(F.avg("OrdinalRank").alias("rank_mean"))
    return mean.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= n)


def first_source(sources: list[DataFrame], n: int) -> DataFrame:
    """(Season, TeamID, rank_mean, place): the n best of (Season, TeamID, rank) of the first
    source that knows a season, later ones only for seasons that none before has (W7). In
    every source ranks are averaged by team."""
    out, known = None, None
    for source in sources:
        mean = source.groupBy(*KEY).agg(F.avg("rank").alias("rank_mean"))
        if known is not None:
            mean = mean.join(F.broadcast(known), "Season", "left_anti")  # a row per season
        have = mean.select("Season").distinct()
        known = have if known is None else known.union(have)
        out = mean if out is None else out.unionByName(mean)
    order = Window.partitionBy("Season").orderBy("rank_mean", "TeamID")
    return out.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= n)


def with_placeholders(df: DataFrame, teams: DataFrame, columns: list[str]) -> DataFrame:
    """A row of column medians for each of teams (Season, TeamID) that df has none of (PF10);
    columns of teams that df has too come from there."""
    own = [c for c in columns if c not in teams.columns]
    middle = medians(df, own)
    missing = teams.join(df.select(*KEY), KEY, "left_anti")
    filler = lambda c: F.col(c) if c in teams.columns else F.lit(middle.get(c)).cast(df.schema[c].dataType)
    return df.unionByName(missing.select(*(filler(c).alias(c) for c in df.columns)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def leaders(df: DataFrame, column: str, n: int, *ties: str) -> DataFrame:
    """The n rows with the largest value, numbered from 1; equal ones by `ties` (TeamID, if none
    are given) (W8)."""
    order = [F.desc(column), *(ties or ("TeamID",))]
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))  # n rows


def late_season(tg: DataFrame, top: DataFrame, days: int = 30) -> DataFrame:
    """Mean efficiencies late in the season against the best (F9); `late_sos` is the number
    of different such opponents."""
    best = top.select("Season", F.col("TeamID").alias("OppID"))
    late = _with_last_day(tg).where((F.col("DayNum") >= F.col("last_day") - days) & (F.col("poss") > 0))
    met = late.join(F.broadcast(best), ["Season", "OppID"], "left_semi")
    oe, de = F.avg(efficiency("pts", "poss")), F.avg(efficiency("opp_pts", "poss"))
    return met.groupBy(*KEY).agg(oe.alias("late_adj_oe"), de.alias("late_adj_de"), (oe - de).alias("late_adj_em"), F.count_distinct("OppID").alias("late_sos"))


def trajectory(tg: DataFrame, days: int = 45, least: int = 3) -> DataFrame:
    """Slopes of efficiency margin and margin over the last days."""
    late = _with_last_day(tg).where((F.col("DayNum") >= F.col("last_day") - days) & (F.col("poss") > 0))
    margin = (F.col("pts") - F.col("opp_pts")).cast("double")
    day = F.col("DayNum").cast("double")
    return late.groupBy(*KEY).agg(
        F.count("*").alias("n"),
        F.regr_slope(100 * margin / F.col("poss"), day).alias("efficiency_trend"),
        F.regr_slope(margin, day).alias("margin_trend"),
    ).where(F.col("n") >= least).drop("n")


def conf_tourney(games: DataFrame) -> DataFrame:
    """Wins of every team that took part, and whether it won its conference's last game
    (F11). games: Season, ConfAbbrev, DayNum, game_id, WTeamID, LTeamID."""
    played = games.select("Season", F.inline(F.array(F.struct(F.col("WTeamID").alias("TeamID"), F.lit(1).alias("w")), F.struct(F.col("LTeamID").alias("TeamID"), F.lit(0).alias("w")))))
    wins = played.groupBy(*KEY).agg(F.sum("w").alias("conf_tourney_wins"))
    champs = games.groupBy("Season", "ConfAbbrev").agg(F.max_by("WTeamID", F.struct("DayNum", "game_id")).alias("TeamID")).select(*KEY).distinct().withColumn("c", F.lit(1))
    return wins.join(champs, KEY, "left").select(*KEY, "conf_tourney_wins", F.coalesce("c", F.lit(0)).cast("long").alias("conf_tourney_champ"))


def market_records(games: DataFrame, cutoff_day: int | None = None) -> DataFrame:
    """Two rows per lined game: the spread and the margin as each side sees them."""
    kept = games if cutoff_day is None else games.where(F.col("DayNum") <= cutoff_day)
    margin = F.col("hscore") - F.col("rscore")
    side = lambda team, spread, m, road: F.struct(F.col(team).alias("TeamID"), spread.alias("team_spread"), m.alias("margin"), F.lit(road).alias("is_road"))
    both = F.array(side("home_id", -F.col("line"), margin, 0), side("road_id", F.col("line"), -margin, 1))
    return kept.where(F.col("line").isNotNull()).select("Season", "DayNum", "game_id", F.inline(both)).where("margin is not null")


def market(records: DataFrame, least: int = 3) -> DataFrame:
    """Spread aggregates (F12). Recency runs through all home games and then all road games,
    each in order, with a half-life of half the games. records are read twice: settle them
    before."""
    order = Window.partitionBy(*KEY).orderBy("is_road", "DayNum", "game_id")
    held = records.groupBy(*(F.col(k).alias(f"__{k}") for k in KEY)).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    n, same = F.col("n").cast("double"), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEY]
    weighed = records.join(F.broadcast(held), same).withColumn("age", F.col("n") - F.row_number().over(order))  # a row per team and season
    weighed = weighed.withColumn("w", F.exp(F.lit(-0.6931471805599453) * F.col("age") / F.greatest(n / 2, F.lit(1.0))))
    beat = F.col("margin") + F.col("team_spread")
    wins, losses = F.count_if(beat > 0), F.count_if(beat < 0)
    return weighed.groupBy(*KEY).agg(
        F.avg("team_spread").alias("vegas_avg_spread"),
        F.avg("margin").alias("vegas_avg_margin"),
        F.when(wins + losses > 0, wins / (wins + losses)).otherwise(0.5).alias("vegas_ats_pct"),
        (F.sum(F.col("w") * F.col("team_spread")) / F.sum("w")).alias("vegas_power_rating"),
        F.stddev_pop(beat).alias("vegas_consistency"),
        F.count("*").alias("vegas_game_count"),
    )


def market_trend(records: DataFrame, days: int = 30, least: int = 5, late_least: int = 2) -> DataFrame:
    """Mean spread of the last days less that of the season."""
    late = F.col("DayNum") >= F.col("last_day") - days
    return _with_last_day(records).groupBy(*KEY).agg(
        F.count("*").alias("n"), F.count_if(late).alias("k"),
        (F.avg(F.when(late, F.col("team_spread"))) - F.avg("team_spread")).alias("vegas_late_spread_delta"),
    ).where((F.col("n") >= least) & (F.col("k") >= late_least)).drop("n", "k")


def side_by_side(parts: list[DataFrame]) -> DataFrame:
    """All numeric parts (different columns, a row per key each) beside one another, for every
    key that any of them has (F14, J1, J8): one grouping puts them together, and each part is
    computed once."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.groupBy(*KEY).agg(*(F.max(c).alias(c) for c in rows.columns if c not in KEY))


def feature_columns(df: DataFrame, exclude=("Season", "TeamID", "game_id", "label", "weight")) -> list[str]:
    """Numeric columns but the keys (PF7)."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short") and f.name not in exclude]


def null_fractions(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_fraction), in one pass (PF8)."""
    shares = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("null_fraction")) for c in columns))
    return shares.select(F.inline(pairs))


def drop_sparse(df: DataFrame, columns: list[str], limit: float) -> DataFrame:
    """Without the columns of which more than `limit` is null."""
    held = {r["column"]: r["null_fraction"] for r in null_fractions(df, columns).collect()}  # a row per column
    return df.drop(*(c for c, v in held.items() if v is not None and v > limit))


def fill_medians(df: DataFrame, columns: list[str], of: DataFrame | None = None) -> DataFrame:
    """Nulls become the column's exact median (PF10, A12), of the rows of `of` where given, so
    that a model's held-out rows do not fill themselves. df is read twice: settle it before."""
    middle = medians(df if of is None else of, columns)
    rest = [c for c in df.columns if c not in columns]
    return df.select(*(F.col(f"`{c}`") for c in rest), *(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(middle[c]).cast("double")).alias(c) for c in columns))
