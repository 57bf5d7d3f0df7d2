"""Queries over game logs and team-season features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipoff.functions.scalars import clip, efficiency, line_to_prob, seed_baseline, seed_number, shrink
from tipoff.operators import features as fx
from tipoff.operators import ratings as rt
from tipoff.operators.games import TEAM_GAMES_SQL, games_from_rows, team_games
from tipoff.plans.registry import ORACLES, register
from tipoff.sources import adapter as ad

G, TG = ad.GAMES_SQL, ad.GAMES_SQL + "," + TEAM_GAMES_SQL
SEEDED = TG + "," + ad.SEEDS_SQL
SYSTEMS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
SYSTEMS_SQL = ", ".join(f"'{s}'" for s in SYSTEMS)


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def tg(spark, sf):
    return team_games(ad.game_log(spark, sf))


@register("game_log", f'WITH {G} SELECT * FROM games')
def game_log(spark, sf):
    return ad.game_log(spark, sf)


@register("team_games", f'WITH {TG} SELECT game_id, "Season", "DayNum", "TeamID", "OppID", pts, opp_pts, win, loc, round(poss, 6) AS poss FROM tg')
def team_rows(spark, sf):
    return rounded(tg(spark, sf).select("game_id", "Season", "DayNum", "TeamID", "OppID", "pts", "opp_pts", "win", "loc", "poss"), "poss")


@register("possessions", f'WITH {TG} SELECT "Season", count(*) AS n, round(avg(poss), 6) AS avg_poss, round(avg(100.0::DOUBLE * pts / poss), 6) AS avg_oe, min(poss) AS low, max(poss) AS high FROM tg WHERE poss > 0 GROUP BY 1')
def possessions(spark, sf):
    out = tg(spark, sf).where("poss > 0").groupBy("Season").agg(F.count("*").alias("n"), F.avg("poss").alias("avg_poss"), F.avg(efficiency("pts", "poss")).alias("avg_oe"), F.min("poss").alias("low"), F.max("poss").alias("high"))
    return rounded(out, "avg_poss", "avg_oe")


def _ff_sql() -> str:
    parts = []
    for name, p, q in (("off", "", "opp_"), ("def", "opp_", "")):
        c = lambda n: f'sum("{p}{n}")::DOUBLE'
        parts += [
            f"round(({c('FGM')} + 0.5::DOUBLE * {c('FGM3')}) / {c('FGA')}, 6) AS {name}_efg",
            f"round({c('TO')} / ({c('FGA')} + 0.475::DOUBLE * {c('FTA')} + {c('TO')}), 6) AS {name}_to_rate",
            f"round({c('OR')} / ({c('OR')} + sum(\"{q}DR\")), 6) AS {name}_or_rate",
            f"round({c('FTM')} / {c('FGA')}, 6) AS {name}_ft_rate",
        ]
    return ", ".join(parts)


@register("four_factors", f'WITH {TG} SELECT "Season", "TeamID", {_ff_sql()} FROM tg GROUP BY 1, 2')
def four_factors(spark, sf):
    out = fx.four_factors(tg(spark, sf))
    return rounded(out, *out.columns[2:])


LAST = '(SELECT *, max("DayNum") OVER (PARTITION BY "Season") AS last_day FROM {})'


@register("rolling_30d", f"""WITH {TG} SELECT "Season", "TeamID", round(100.0::DOUBLE * sum(pts) / sum(poss), 6) AS rolling_oe, round(100.0::DOUBLE * sum(opp_pts) / sum(poss), 6) AS rolling_de, round(avg(win), 6) AS win_pct_30d
 FROM {LAST.format('tg')} WHERE "DayNum" > last_day - 30 AND poss > 0 GROUP BY 1, 2""")
def rolling_30d(spark, sf):
    out = fx.rolling(tg(spark, sf))
    return rounded(out, *out.columns[2:])


@register("recent_form", f"""WITH {TG} SELECT "Season", "TeamID", round(avg(CASE WHEN rn <= 10 THEN win END), 6) AS win_pct_last10, round(avg(CASE WHEN rn <= 10 THEN pts - opp_pts END), 6) AS avg_mov_last10,
 round(avg(CASE WHEN rn <= 10 THEN pts END) - avg(pts), 6) AS scoring_trend, round(avg(win), 6) AS season_win_pct, round(avg(pts - opp_pts), 6) AS season_avg_mov
 FROM (SELECT *, row_number() OVER (PARTITION BY "Season", "TeamID" ORDER BY "DayNum" DESC, game_id DESC) AS rn FROM tg) GROUP BY 1, 2""")
def recent_form(spark, sf):
    out = fx.form(tg(spark, sf))
    return rounded(out, *out.columns[2:])


@register("road_win_pct", f"""WITH {TG} SELECT "Season", "TeamID", round(avg(win), 6) AS road_win_pct FROM tg WHERE loc IN ('A', 'N') GROUP BY 1, 2""")
def road_win_pct(spark, sf):
    return rounded(fx.road_win_pct(tg(spark, sf)), "road_win_pct")


@register("conf_strength", f"""WITH {TG},{ad.CONF_SQL}, em AS (SELECT "Season", "TeamID", avg(100.0::DOUBLE * (pts - opp_pts) / poss) AS adj_em FROM tg WHERE poss > 0 GROUP BY 1, 2)
 SELECT c."Season", c."TeamID", round(avg(em.adj_em) OVER (PARTITION BY c."Season", "ConfAbbrev"), 6) AS conf_strength FROM conf c LEFT JOIN em ON em."Season" = c."Season" AND em."TeamID" = c."TeamID" """)
def conf_strength(spark, sf):
    games = ad.game_log(spark, sf)
    em = team_games(games).where("poss > 0").groupBy(*fx.KEY).agg(F.avg(efficiency(F.col("pts") - F.col("opp_pts"), "poss")).alias("adj_em"))
    return rounded(fx.conf_strength(ad.conferences(games, ad.table(spark, sf, "nation")), em), "conf_strength")


RK = TG + "," + ad.RANKINGS_SQL


def _latest_sql(filter_first: bool) -> str:
    inner = f"WHERE \"SystemName\" IN ({SYSTEMS_SQL})" if filter_first else ""
    return f"""latest AS (SELECT r.* FROM rankings r JOIN (SELECT "Season", max("RankingDayNum") AS d FROM rankings {inner} GROUP BY 1) m
 ON m."Season" = r."Season" AND m.d = r."RankingDayNum" WHERE "SystemName" IN ({SYSTEMS_SQL}))"""


def latest(spark, sf, filter_first=True):
    return fx.latest_rankings(ad.rankings(ad.game_log(spark, sf)), SYSTEMS, filter_first)


@register("massey_latest", f'WITH {RK}, {_latest_sql(True)} SELECT * FROM latest')
def massey_latest(spark, sf):
    return latest(spark, sf)


@register("massey_latest_all", f'WITH {RK}, {_latest_sql(False)} SELECT * FROM latest')
def massey_latest_all(spark, sf):
    return latest(spark, sf, False)


PIVOT = ", ".join(f"""max("OrdinalRank") FILTER (WHERE "SystemName" = '{s}') AS rank_{s.lower().replace('-', '_')}""" for s in SYSTEMS)


@register("massey_pivot", f'WITH {RK}, {_latest_sql(True)} SELECT "Season", "TeamID", {PIVOT}, round(avg("OrdinalRank"), 6) AS rank_composite FROM latest GROUP BY 1, 2')
def massey_pivot(spark, sf):
    return rounded(fx.ranking_columns(latest(spark, sf), SYSTEMS), "rank_composite")


@register("massey_composite", f'WITH {RK}, {_latest_sql(True)} SELECT "Season", "TeamID", round(avg("OrdinalRank"), 6) AS rank_composite FROM latest GROUP BY 1, 2')
def massey_composite(spark, sf):
    return rounded(latest(spark, sf).groupBy(*fx.KEY).agg(F.avg("OrdinalRank").alias("rank_composite")), "rank_composite")


@register("seed_parse", f"""WITH {SEEDED} SELECT "Season", "TeamID", "Seed", coalesce(try_cast(nullif(regexp_extract("Seed", '(\\d+)', 1), '') AS BIGINT), 16) AS seed_no FROM seeds""")
def seed_parse(spark, sf):
    return ad.seeds(ad.game_log(spark, sf)).select("Season", "TeamID", "Seed", seed_number("Seed").cast("long").alias("seed_no"))


TOP = f"""top AS (SELECT * FROM (SELECT "Season", "TeamID", avg("OrdinalRank") AS rank_mean, row_number() OVER (PARTITION BY "Season" ORDER BY avg("OrdinalRank"), "TeamID") AS place FROM latest GROUP BY 1, 2) WHERE place <= 50)"""


@register("top_n_teams", f'WITH {RK}, {_latest_sql(True)}, {TOP} SELECT "Season", "TeamID", round(rank_mean, 6) AS rank_mean, place FROM top')
def top_n_teams(spark, sf):
    return rounded(fx.top_teams(latest(spark, sf), 50), "rank_mean")


def _efficiency(rounds):
    sql = f"""WITH {TG},{rt.adjusted_sql(rounds)} SELECT r."Season", r."TeamID", round(r_oe, 5) AS adj_oe, round(r_de, 5) AS adj_de, round(r_oe - r_de, 5) AS adj_em, round(adj_tempo, 5) AS adj_tempo
 FROM r{rounds} r JOIN tempo t ON t."Season" = r."Season" AND t."TeamID" = r."TeamID" """

    @register(f"adj_efficiency_k{rounds}", sql)
    def query(spark, sf):
        out = rt.adjusted_efficiency(tg(spark, sf), rounds)
        return rounded(out, *out.columns[2:], digits=5)


for _rounds in (1, 5, 10, 15):
    _efficiency(_rounds)


@register("adj_tempo", f'WITH {TG},{rt.adjusted_sql(0)} SELECT "Season", "TeamID", round(adj_tempo, 6) AS adj_tempo FROM tempo')
def adj_tempo(spark, sf):
    return rounded(rt.adjusted_tempo(rt.written(rt.meetings(rt.weighted_games(tg(spark, sf), 30.0)), "meetings")), "adj_tempo")


@register("efficiency_delta", f"""WITH {TG},{rt.adjusted_sql(3)} SELECT a."Season", round(max(abs(a.r_oe - b.r_oe)), 6) AS max_change FROM r3 a JOIN r2 b ON a."Season" = b."Season" AND a."TeamID" = b."TeamID" GROUP BY 1""")
def efficiency_delta(spark, sf):
    return rounded(rt.adjusted_efficiency(tg(spark, sf), 3, history=True)[1], "max_change")


@register("recency_weights", f'WITH {TG},{rt.adjusted_sql(0)} SELECT "Season", "TeamID", round(sum(w), 6) AS weight, round(max(w), 6) AS newest FROM wg GROUP BY 1, 2')
def recency_weights(spark, sf):
    return rounded(rt.weighted_games(tg(spark, sf), 30.0).groupBy(*fx.KEY).agg(F.sum("w").alias("weight"), F.max("w").alias("newest")), "weight", "newest")


@register("late_season", f"""WITH {RK}, {_latest_sql(True)}, {TOP} SELECT t."Season", t."TeamID", round(avg(100.0::DOUBLE * pts / poss), 6) AS late_adj_oe, round(avg(100.0::DOUBLE * opp_pts / poss), 6) AS late_adj_de,
 round(avg(100.0::DOUBLE * pts / poss) - avg(100.0::DOUBLE * opp_pts / poss), 6) AS late_adj_em, count(DISTINCT "OppID") AS late_sos
 FROM {LAST.format('tg')} t WHERE "DayNum" >= last_day - 30 AND poss > 0 AND EXISTS (SELECT 1 FROM top p WHERE p."Season" = t."Season" AND p."TeamID" = t."OppID") GROUP BY 1, 2""")
def late_season(spark, sf):
    out = fx.late_season(tg(spark, sf), fx.top_teams(latest(spark, sf), 50))
    return rounded(out, "late_adj_oe", "late_adj_de", "late_adj_em")


@register("trajectory", f"""WITH {TG} SELECT "Season", "TeamID", round(regr_slope(100 * (pts - opp_pts)::DOUBLE / poss, "DayNum"::DOUBLE), 5) AS efficiency_trend, round(regr_slope((pts - opp_pts)::DOUBLE, "DayNum"::DOUBLE), 5) AS margin_trend
 FROM {LAST.format('tg')} WHERE "DayNum" >= last_day - 45 AND poss > 0 GROUP BY 1, 2 HAVING count(*) >= 3""")
def trajectory(spark, sf):
    return rounded(fx.trajectory(tg(spark, sf)), "efficiency_trend", "margin_trend", digits=5)


CONF_GAMES = f"""cg AS (SELECT g."Season", a."ConfAbbrev", g."DayNum", g.game_id, g."WTeamID", g."LTeamID" FROM games g JOIN conf a ON a."Season" = g."Season" AND a."TeamID" = g."WTeamID"
 JOIN conf b ON b."Season" = g."Season" AND b."TeamID" = g."LTeamID" WHERE a."ConfAbbrev" = b."ConfAbbrev" AND g."DayNum" >= {ad.CONF_DAY})"""


def conference_games(games, conf):
    a, b = (conf.select("Season", F.col("TeamID").alias(f"{s}TeamID"), F.col("ConfAbbrev").alias(f"c{s}")) for s in "WL")
    late = games.where(F.col("DayNum") >= ad.CONF_DAY).join(a, ["Season", "WTeamID"]).join(b, ["Season", "LTeamID"])
    return late.where("cW = cL").select("Season", F.col("cW").alias("ConfAbbrev"), "DayNum", "game_id", "WTeamID", "LTeamID")


@register("conf_tourney", f"""WITH {TG},{ad.CONF_SQL}, {CONF_GAMES}, champs AS (SELECT DISTINCT "Season", arg_max("WTeamID", "DayNum" * 1000000000 + game_id) AS t FROM cg GROUP BY "Season", "ConfAbbrev"),
 played AS (SELECT "Season", "WTeamID" AS t, 1 AS w FROM cg UNION ALL SELECT "Season", "LTeamID", 0 FROM cg)
 SELECT p."Season", p.t AS "TeamID", CAST(sum(w) AS BIGINT) AS conf_tourney_wins, CAST(max(CASE WHEN c.t IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS conf_tourney_champ
 FROM played p LEFT JOIN champs c ON c."Season" = p."Season" AND c.t = p.t GROUP BY 1, 2""")
def conf_tourney(spark, sf):
    games = ad.game_log(spark, sf)
    return fx.conf_tourney(conference_games(games, ad.conferences(games, ad.table(spark, sf, "nation"))))


MARKET = f"""mk AS (SELECT "Season", "DayNum", game_id, home_id AS "TeamID", -line AS team_spread, hscore - rscore AS margin, 0 AS is_road FROM games WHERE line IS NOT NULL AND "DayNum" <= {ad.TOURNEY_DAY}
 UNION ALL SELECT "Season", "DayNum", game_id, road_id, line, rscore - hscore, 1 FROM games WHERE line IS NOT NULL AND "DayNum" <= {ad.TOURNEY_DAY})"""


def market_rows(spark, sf):
    return fx.market_records(ad.game_log(spark, sf), ad.TOURNEY_DAY)


@register("vegas_features", f"""WITH {G}, {MARKET}, m2 AS (SELECT *, count(*) OVER (PARTITION BY "Season", "TeamID") AS n, row_number() OVER (PARTITION BY "Season", "TeamID" ORDER BY is_road, "DayNum", game_id) AS rn FROM mk),
 m3 AS (SELECT *, exp(-0.6931471805599453::DOUBLE * (n - rn) / greatest(n / 2.0::DOUBLE, 1.0::DOUBLE)) AS w FROM m2 WHERE n >= 3)
 SELECT "Season", "TeamID", round(avg(team_spread), 6) AS vegas_avg_spread, round(avg(margin), 6) AS vegas_avg_margin,
 round(CASE WHEN count(*) FILTER (WHERE margin + team_spread <> 0) > 0 THEN count(*) FILTER (WHERE margin + team_spread > 0)::DOUBLE / count(*) FILTER (WHERE margin + team_spread <> 0) ELSE 0.5 END, 6) AS vegas_ats_pct,
 round(sum(w * team_spread) / sum(w), 6) AS vegas_power_rating, round(stddev_pop(margin + team_spread), 6) AS vegas_consistency, count(*) AS vegas_game_count FROM m3 GROUP BY 1, 2""")
def vegas_features(spark, sf):
    out = fx.market(rt.written(market_rows(spark, sf), "lines"))
    return rounded(out, *out.columns[2:-1])


@register("vegas_trend", f"""WITH {G}, {MARKET} SELECT "Season", "TeamID", round(avg(CASE WHEN "DayNum" >= last_day - 30 THEN team_spread END) - avg(team_spread), 6) AS vegas_late_spread_delta
 FROM {LAST.format('mk')} GROUP BY 1, 2 HAVING count(*) >= 5 AND count(*) FILTER (WHERE "DayNum" >= last_day - 30) >= 2""")
def vegas_trend(spark, sf):
    return rounded(fx.market_trend(market_rows(spark, sf)), "vegas_late_spread_delta")


#: The full matrix by source: each part's columns, and the query whose rows they are.
PARTS = {
    "four_factors": [f"{side}_{k}" for side in ("off", "def") for k in fx.KINDS],
    "rolling_30d": ["rolling_oe", "rolling_de", "win_pct_30d"],
    "recent_form": ["win_pct_last10", "avg_mov_last10", "scoring_trend", "season_win_pct", "season_avg_mov"],
    "road_win_pct": ["road_win_pct"],
    "late_season": ["late_adj_oe", "late_adj_de", "late_adj_em", "late_sos"],
    "trajectory": ["efficiency_trend", "margin_trend"],
    "adj_efficiency_k15": ["adj_oe", "adj_de", "adj_em", "adj_tempo"],
    "conf_strength": ["conf_strength"],
    "massey_pivot": ["rank_1_urgent", "rank_2_high", "rank_3_medium", "rank_5_low", "rank_composite"],
    "conf_tourney": ["conf_tourney_wins", "conf_tourney_champ"],
    "vegas_features": ["vegas_avg_spread", "vegas_avg_margin", "vegas_ats_pct", "vegas_power_rating", "vegas_consistency", "vegas_game_count"],
    "vegas_trend": ["vegas_late_spread_delta"],
}
MATRIX_COLUMNS = [*(c for cs in PARTS.values() for c in cs), "seed"]
DIGITS = {c: 5 for part in ("trajectory", "adj_efficiency_k15") for c in PARTS[part]}
#: The columns of the four published lineages, as far as the game log has their sources.
LINEAGES = {
    "a": [*PARTS["adj_efficiency_k15"], *PARTS["four_factors"], *PARTS["rolling_30d"], *PARTS["recent_form"], *PARTS["road_win_pct"], *PARTS["conf_strength"], *PARTS["massey_pivot"], "seed"],
    "b": [*PARTS["adj_efficiency_k15"], *PARTS["four_factors"], *PARTS["recent_form"], *PARTS["massey_pivot"], *PARTS["vegas_features"], "seed"],
    "c": [*PARTS["adj_efficiency_k15"], *PARTS["four_factors"], *PARTS["late_season"], *PARTS["trajectory"], *PARTS["conf_tourney"], *PARTS["vegas_features"], *PARTS["vegas_trend"], *PARTS["massey_pivot"], "seed"],
    "d": MATRIX_COLUMNS,
}
_KEYED = " UNION ".join(f'SELECT "Season", "TeamID" FROM mx_{n}' for n in PARTS)
MATRIX = ", ".join(f"mx_{n} AS ({ORACLES[n]})" for n in PARTS) + f""", mx AS (SELECT k."Season", k."TeamID", {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for cs in PARTS.values() for c in cs)}, CAST(seeds.seed_no AS DOUBLE) AS seed
 FROM ({_KEYED} UNION SELECT "Season", "TeamID" FROM seeds) k {" ".join(f'LEFT JOIN mx_{n} ON mx_{n}."Season" = k."Season" AND mx_{n}."TeamID" = k."TeamID"' for n in PARTS)}
 LEFT JOIN seeds ON seeds."Season" = k."Season" AND seeds."TeamID" = k."TeamID")"""


def matrix(spark, sf, games=None):
    """All feature groups of every team and season. The game log and its team rows are settled
    once; each part then reads the columns it needs."""
    games = rt.written(ad.game_log(spark, sf), "games") if games is None else games
    rows = rt.written(team_games(games), "team_games")
    ranked = rt.written(fx.latest_rankings(ad.rankings(rows, True), SYSTEMS), "latest")
    conf = ad.conferences(rows, ad.table(spark, sf, "nation"), True)
    em = rows.where("poss > 0").groupBy(*fx.KEY).agg(F.avg(efficiency(F.col("pts") - F.col("opp_pts"), "poss")).alias("adj_em"))
    lined = fx.market_records(games, ad.TOURNEY_DAY)
    parts = [
        fx.season_features(rows, fx.top_teams(ranked, 50)), rt.adjusted_efficiency(rows, 15), fx.conf_strength(conf, em),
        fx.ranking_columns(ranked, SYSTEMS), fx.conf_tourney(conference_games(games, conf)), fx.market(lined), fx.market_trend(lined),
        fx.seed_numbers(ad.seeds(rows, True)),
    ]
    out = fx.side_by_side(parts)
    return out.select(*fx.KEY, *(F.round(F.col(c).cast("double"), DIGITS.get(c, 6)).alias(c) for c in MATRIX_COLUMNS))


@register("feature_matrix", f"""WITH {SEEDED}, {MATRIX} SELECT * FROM mx""")
def feature_matrix(spark, sf):
    return matrix(spark, sf)


def _lineage(name):
    columns = LINEAGES[name]

    @register(f"feature_matrix_{name}", f"""WITH {SEEDED}, {MATRIX} SELECT "Season", "TeamID", {", ".join(columns)} FROM mx""")
    def query(spark, sf):
        return matrix(spark, sf).select(*fx.KEY, *columns)


for _name in ("a", "b", "c"):
    _lineage(_name)


@register("null_fraction", f"""WITH {SEEDED}, {MATRIX} """ + " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS null_fraction FROM mx""" for c in MATRIX_COLUMNS))
def null_fraction(spark, sf):
    return rounded(fx.null_fractions(matrix(spark, sf), MATRIX_COLUMNS), "null_fraction")


@register("median_impute", f"""WITH {SEEDED}, {MATRIX} SELECT "Season", "TeamID", {", ".join(f"round(coalesce({c}, (SELECT median({c}) FROM mx)), 6) AS {c}" for c in MATRIX_COLUMNS)} FROM mx""")
def median_impute(spark, sf):
    return rounded(fx.fill_medians(rt.written(matrix(spark, sf), "matrix"), MATRIX_COLUMNS), *MATRIX_COLUMNS)


@register("validation", f"""WITH {G} SELECT "Season", count(*) AS games, count(DISTINCT game_id) AS ids, count(*) FILTER (WHERE "WTeamID" IS NULL OR "LTeamID" IS NULL) AS null_keys,
 count(*) FILTER (WHERE "WScore" <= "LScore") AS bad_scores, count(*) < 1000 AS few_games FROM games GROUP BY 1""")
def validation(spark, sf):
    from tipoff.sources.validation import season_report

    return season_report(ad.game_log(spark, sf))


@register("missing_teams", f"""WITH {SEEDED} SELECT t."Season", t."TeamID" FROM (SELECT DISTINCT "Season", "TeamID" FROM tg) t WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s."Season" = t."Season" AND s."TeamID" = t."TeamID")""")
def missing_teams(spark, sf):
    games = ad.game_log(spark, sf)
    return team_games(games).select(*fx.KEY).distinct().join(ad.seeds(games), fx.KEY, "left_anti")


@register("placeholder_teams", f"""WITH {TG}, m AS (SELECT "Season", "TeamID", round(avg(win) FILTER (WHERE loc = 'A'), 6) AS away_win_pct, round(avg(pts), 6) AS avg_pts FROM tg WHERE "TeamID" % 3 > 0 GROUP BY 1, 2)
 SELECT * FROM m UNION ALL SELECT t."Season", t."TeamID", round((SELECT median(away_win_pct) FROM m), 6), round((SELECT median(avg_pts) FROM m), 6) FROM (SELECT DISTINCT "Season", "TeamID" FROM tg) t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m."Season" = t."Season" AND m."TeamID" = t."TeamID")""")
def placeholder_teams(spark, sf):
    rows = tg(spark, sf)
    known = rows.where("TeamID % 3 > 0").groupBy(*fx.KEY).agg(F.avg(F.when(F.col("loc") == "A", F.col("win"))).alias("away_win_pct"), F.avg("pts").alias("avg_pts"))
    columns = ["away_win_pct", "avg_pts"]
    return rounded(fx.with_placeholders(rounded(known, *columns), rows.select(*fx.KEY).distinct(), columns), *columns)


@register("seed_counts", f'WITH {SEEDED} SELECT seed_no, count(*) AS n FROM seeds GROUP BY 1')
def seed_counts(spark, sf):
    return fx.value_counts(fx.seed_numbers(ad.seeds(ad.game_log(spark, sf))).withColumnRenamed("seed", "seed_no"), "seed_no")


@register("top_in_turn", f"""WITH {RK}, {_latest_sql(True)}, s1 AS (SELECT "Season", "TeamID", avg("OrdinalRank") AS r FROM latest WHERE "SystemName" = '1-URGENT' AND "Season" % 2 = 0 GROUP BY 1, 2),
 u AS (SELECT * FROM s1 UNION ALL SELECT "Season", "TeamID", avg("OrdinalRank") FROM latest WHERE "Season" NOT IN (SELECT "Season" FROM s1) GROUP BY 1, 2)
 SELECT "Season", "TeamID", round(r, 6) AS rank_mean, place FROM (SELECT *, row_number() OVER (PARTITION BY "Season" ORDER BY r, "TeamID") AS place FROM u) WHERE place <= 100""")
def top_in_turn(spark, sf):
    ranked = latest(spark, sf).withColumnRenamed("OrdinalRank", "rank")
    first = ranked.where((F.col("SystemName") == "1-URGENT") & (F.col("Season") % 2 == 0))
    return rounded(fx.first_source([first, ranked], 100), "rank_mean")


@register("seed_baseline", f"""WITH {SEEDED},{ad.TOURNEY_SQL} SELECT t.game_id, round(1 / (1 + exp(-0.15::DOUBLE * (l.seed_no - w.seed_no))), 6) AS p FROM tourney t
 JOIN seeds w ON w."Season" = t."Season" AND w."TeamID" = t."WTeamID" JOIN seeds l ON l."Season" = t."Season" AND l."TeamID" = t."LTeamID" """)
def seed_baseline_query(spark, sf):
    games = ad.game_log(spark, sf)
    field = ad.seeds(games)
    side = lambda s: fx.seed_numbers(field).select("Season", F.col("TeamID").alias(f"{s}TeamID"), F.col("seed").alias(f"{s}seed"))
    met = ad.tourney_games(games, field).join(side("W"), ["Season", "WTeamID"]).join(side("L"), ["Season", "LTeamID"])
    return rounded(met.select("game_id", seed_baseline("Wseed", "Lseed").alias("p")), "p")


def phi_sql(x: str) -> str:
    from tipoff.functions.scalars import PHI_SCALE, PHI_TERMS

    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {PHI_SCALE}::DOUBLE * abs({x})))"
    poly = "0.0::DOUBLE"
    for c in reversed(PHI_TERMS):
        poly = f"(({poly} + ({c}::DOUBLE)) * {t})"
    tail = f"(exp(-({x}) * ({x}) / 2) / 2.5066282746310002::DOUBLE * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1.0::DOUBLE - {tail} ELSE {tail} END)"


@register("line_to_prob", f'WITH {G} SELECT game_id, line, round({phi_sql("(line / 11.0::DOUBLE)")}, 6) AS p FROM games WHERE line IS NOT NULL')
def line_prob(spark, sf):
    return ad.game_log(spark, sf).where("line is not null").select("game_id", "line", F.round(line_to_prob("line"), 6).alias("p"))


@register("shrink", f'WITH {G} SELECT game_id, round(greatest(least({phi_sql("(line / 11.0::DOUBLE)")} * 0.8::DOUBLE + 0.5::DOUBLE * 0.2::DOUBLE, 0.9::DOUBLE), 0.1::DOUBLE), 6) AS p FROM games WHERE line IS NOT NULL')
def shrink_query(spark, sf):
    return ad.game_log(spark, sf).where("line is not null").select("game_id", F.round(clip(shrink(line_to_prob("line"), 0.2), 0.1, 0.9), 6).alias("p"))


@register("tourney_from_rows", f"""WITH {SEEDED},{ad.TOURNEY_SQL}, rows AS (
   SELECT "Season" AS y, game_id * 2 + 1 AS k, "WTeamID" AS t, "WScore" AS s FROM tourney UNION ALL SELECT "Season", game_id * 2, "LTeamID", "LScore" FROM tourney),
 n AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY k DESC) - 1 AS rn FROM rows)
 SELECT a.y AS "Season", CASE WHEN a.s > b.s THEN a.t ELSE b.t END AS "WTeamID", greatest(a.s, b.s) AS "WScore", CASE WHEN a.s > b.s THEN b.t ELSE a.t END AS "LTeamID", least(a.s, b.s) AS "LScore"
 FROM n a JOIN n b ON a.y = b.y AND b.rn = a.rn + 1 WHERE a.rn % 2 = 0 AND a.s <> b.s""")
def tourney_from_rows(spark, sf):
    games = ad.game_log(spark, sf)
    played = ad.tourney_games(games, ad.seeds(games))
    side = lambda s, k: F.struct((F.col("game_id") * 2 + k).alias("BY_YEAR_NO"), F.col(f"{s}TeamID").alias("TEAM_NO"), F.col(f"{s}TeamID").cast("string").alias("TEAM"), F.lit(1).alias("SEED"), F.col(f"{s}Score").alias("SCORE"))
    rows = played.select(F.col("Season").alias("YEAR"), F.lit(64).alias("CURRENT_ROUND"), F.inline(F.array(side("W", 1), side("L", 0))))
    return games_from_rows(rows).select("Season", "WTeamID", "WScore", "LTeamID", "LScore")
