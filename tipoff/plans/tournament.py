"""Queries over training pairs, metrics, brackets and pools."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tipoff.functions.scalars import line_to_prob, logistic
from tipoff.operators import bracket as br
from tipoff.operators import features as fx
from tipoff.operators import matchups as mu
from tipoff.operators import ratings as rt
from tipoff.operators import tuning
from tipoff.operators.games import team_games
from tipoff.operators.lineage import shared_folder
from tipoff.plans.features import MATRIX, MATRIX_COLUMNS, RK, SEEDED, TOP, _latest_sql, latest, matrix, phi_sql, rounded
from tipoff.plans.registry import register
from tipoff.sources import adapter as ad
from tipoff.sources import readers, sinks

#: How many tournaments are simulated, and the lottery's seed.
SIMS, RANDOM_SEED = 10_000, 42
FEATURES = MATRIX_COLUMNS

ORDER_SQL = "[" + ", ".join(map(str, br.SEED_ORDER)) + "]"
#: Bracket teams of every season with their slot, and the win probability of every ordered pair.
FIELD = f"""field AS (SELECT s."Season", s."TeamID", s.seed_no AS seed, CAST(s.region_no * 16 + list_position({ORDER_SQL}, CAST(s.seed_no AS INT)) - 1 AS BIGINT) AS slot, r.rating
   FROM seeds s JOIN (SELECT "Season", "TeamID", avg(pts - opp_pts) AS rating FROM tg GROUP BY 1, 2) r ON r."Season" = s."Season" AND r."TeamID" = s."TeamID"),
 pp AS MATERIALIZED (SELECT a."Season", a."TeamID" AS "TeamID_a", b."TeamID" AS "TeamID_b", 1 / (1 + exp(-(0.1::DOUBLE * (a.rating - b.rating)))) AS p FROM field a JOIN field b ON a."Season" = b."Season" AND a."TeamID" <> b."TeamID")"""
BASE = f"{SEEDED},{FIELD}"
KEY, MET = ["Season", "TeamID_a", "TeamID_b"], '"Season", "TeamID_a", "TeamID_b"'


def field(games):
    """Every season's bracket: 64 teams with seed, slot and rating."""
    rows = team_games(games)
    rating = rows.groupBy(*fx.KEY).agg(F.avg(F.col("pts") - F.col("opp_pts")).alias("rating"))
    teams = ad.seeds(rows, True).select("Season", "TeamID", F.substring("Seed", 1, 1).alias("region"), F.expr("cast(substring(Seed, 2) as bigint)").alias("seed"))
    return br.slots(teams, ad.REGIONS).join(rating, fx.KEY)


def pair_probs(teams):
    return br.all_pairs(teams, ["TeamID", "rating"]).select(*KEY, logistic(F.lit(0.1) * (F.col("rating_a") - F.col("rating_b"))).alias("p"))


def three(spark, sf):
    """Games, brackets and chances of pairs; games and brackets are settled, since rounds and
    lines read them again."""
    games = rt.written(ad.game_log(spark, sf), "games")
    teams = rt.written(field(games), "field")
    return games, teams, pair_probs(teams)


def both(spark, sf):
    teams = rt.written(field(ad.game_log(spark, sf)), "field")
    return teams, pair_probs(teams)


@register("pair_probs", f'WITH {BASE} SELECT {MET}, round(p, 6) AS p FROM pp')
def pair_probs_query(spark, sf):
    return rounded(both(spark, sf)[1], "p")


@register("pairs_exported", f'WITH {BASE} SELECT "Season", "TeamID_a", "TeamID_b", round_even(p, 4) AS p FROM pp WHERE "TeamID_a" < "TeamID_b"')
def pairs_exported(spark, sf):
    """Every season's chances, written as JSON by the tasks that have them and read back."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/pairs.json"
    sinks.write_pair_json(both(spark, sf)[1], path)
    return readers.pair_probabilities(spark, path)


#: One line per pair of bracket teams: the season's last game between them.
LINES = f"""lines AS (SELECT g."Season", home_id AS "TeamID_a", road_id AS "TeamID_b", arg_max(line, "DayNum" * 1000000000 + game_id) AS spread FROM games g
   JOIN field h ON h."Season" = g."Season" AND h."TeamID" = g.home_id JOIN field r ON r."Season" = g."Season" AND r."TeamID" = g.road_id WHERE line IS NOT NULL GROUP BY 1, 2, 3),
 pl AS (SELECT pp.*, coalesce(l.spread, -m.spread) AS spread FROM pp LEFT JOIN lines l ON l."Season" = pp."Season" AND l."TeamID_a" = pp."TeamID_a" AND l."TeamID_b" = pp."TeamID_b"
   LEFT JOIN lines m ON m."Season" = pp."Season" AND m."TeamID_a" = pp."TeamID_b" AND m."TeamID_b" = pp."TeamID_a"),
 bp AS (SELECT {MET}, p, CASE WHEN spread IS NULL THEN p ELSE 0.65::DOUBLE * p + 0.35::DOUBLE * {phi_sql('(spread / 11.0::DOUBLE)')} END AS p_blended FROM pl)"""


def lines(games, teams):
    games = games.where(F.col("line").isNotNull())
    for side in ("home_id", "road_id"):
        games = games.join(teams.select("Season", F.col("TeamID").alias(side)), ["Season", side], "left_semi")
    return games.groupBy("Season", F.col("home_id").alias("TeamID_a"), F.col("road_id").alias("TeamID_b")).agg(F.max_by("line", F.struct("DayNum", "game_id")).alias("spread"))


@register("blend_lines", f'WITH {BASE},{LINES} SELECT {MET}, round(p, 6) AS p, round(p_blended, 6) AS p_blended FROM bp')
def blend_lines(spark, sf):
    games, teams, probs = three(spark, sf)
    return rounded(br.blend_lines(probs, lines(games, teams)), "p", "p_blended")


def adv_sql() -> str:
    out = ['a0 AS (SELECT "Season", slot, "TeamID", 1.0::DOUBLE AS r0 FROM field)']
    for r in range(1, 7):
        half = 1 << (r - 1)
        kept = ", ".join(f"a.r{k}" for k in range(r))
        out.append(f"""a{r} AS MATERIALIZED (SELECT a."Season", a.slot, a."TeamID", {kept}, a.r{r - 1} * sum(b.r{r - 1} * pp.p) AS r{r} FROM a{r - 1} a
   JOIN a{r - 1} b ON a."Season" = b."Season" AND b.slot // {half} = CASE WHEN (a.slot // {half}) % 2 = 0 THEN a.slot // {half} + 1 ELSE a.slot // {half} - 1 END
   JOIN pp ON pp."Season" = a."Season" AND pp."TeamID_a" = a."TeamID" AND pp."TeamID_b" = b."TeamID" GROUP BY a."Season", a.slot, a."TeamID", {kept})""")
    return ",\n ".join(out)


ADV = adv_sql()


@register("exact_advancement", f'WITH {BASE},{ADV} SELECT "Season", slot, "TeamID", {", ".join(f"round(r{r}, 6) AS " + chr(34) + f"R{r}" + chr(34) for r in range(1, 7))} FROM a6')
def exact_advancement(spark, sf):
    return rounded(br.exact_advancement(*both(spark, sf)), *(f"R{r}" for r in range(1, 7)))


def sim_sql(n: int) -> str:
    out = [f's0 AS (SELECT f."Season", n.sim, f.slot, f."TeamID" FROM (SELECT unnest(range({n})) AS sim) n, field f)']
    for r in range(1, 7):
        lot = f"CAST(('0x' || substr(md5('{RANDOM_SEED}|' || a.\"Season\" || '|' || a.sim || '|{r}|' || (a.slot // 2)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
        out.append(f"""s{r} AS MATERIALIZED (SELECT a."Season", a.sim, a.slot // 2 AS slot, CASE WHEN {lot} < pp.p THEN a."TeamID" ELSE b."TeamID" END AS "TeamID"
   FROM s{r - 1} a JOIN s{r - 1} b ON a."Season" = b."Season" AND a.sim = b.sim AND a.slot % 2 = 0 AND b.slot = a.slot + 1 JOIN pp ON pp."Season" = a."Season" AND pp."TeamID_a" = a."TeamID" AND pp."TeamID_b" = b."TeamID")""")
    out.append("won AS (" + " UNION ALL ".join(f'SELECT "Season", sim, CAST({r} AS BIGINT) AS round, slot, "TeamID" FROM s{r}' for r in range(1, 7)) + ")")
    return ",\n ".join(out)


@register("monte_carlo", f'WITH {BASE},{sim_sql(SIMS)} SELECT "Season", "TeamID", round, round(count(*) / {SIMS}.0::DOUBLE, 6) AS p FROM won GROUP BY 1, 2, 3')
def monte_carlo(spark, sf):
    return rounded(br.advancement(br.simulate(*both(spark, sf), SIMS, RANDOM_SEED), SIMS), "p")


def fill_sql(score: str = "r{r}") -> str:
    """Winners of each pair by score, the upper on ties: f0 to f6, and picks."""
    out = ["f0 AS (SELECT slot AS pos, * FROM a6)"]
    for r in range(1, 7):
        s = score.format(r=r)
        out.append(f"f{r} AS (SELECT pos // 2 AS pos, * EXCLUDE (pos, k) FROM (SELECT *, row_number() OVER (PARTITION BY \"Season\", pos // 2 ORDER BY {s} DESC, pos) AS k FROM f{r - 1}) WHERE k = 1)")
    out.append("picks AS (" + " UNION ALL ".join(f'SELECT "Season", CAST({r} AS BIGINT) AS round, pos AS slot, "TeamID" FROM f{r}' for r in range(1, 7)) + ")")
    return ",\n ".join(out)


def chalk_of(adv):
    return br.fill(adv, lambda r: F.col(f"R{r}"))


@register("chalk", f'WITH {BASE},{ADV},{fill_sql()} SELECT * FROM picks')
def chalk(spark, sf):
    return chalk_of(br.exact_advancement(*both(spark, sf)))


@register("ev", f'WITH {BASE},{ADV},{fill_sql("r{r} * (1 << ({r} - 1))")} SELECT * FROM picks')
def ev(spark, sf):
    return br.fill(br.exact_advancement(*both(spark, sf)), lambda r: F.col(f"R{r}") * (1 << (r - 1)))


def pair_fill_sql(table: str = "pp", p: str = "p") -> str:
    out = ['c0 AS (SELECT "Season", slot, "TeamID" FROM field)']
    for r in range(1, 7):
        out.append(f"""g{r} AS MATERIALIZED (SELECT a."Season", a.slot // 2 AS slot, a."TeamID" AS a, b."TeamID" AS b, t.{p} AS p FROM c{r - 1} a JOIN c{r - 1} b ON a."Season" = b."Season" AND a.slot % 2 = 0 AND b.slot = a.slot + 1
   JOIN {table} t ON t."Season" = a."Season" AND t."TeamID_a" = a."TeamID" AND t."TeamID_b" = b."TeamID"), c{r} AS (SELECT "Season", slot, CASE WHEN p >= 0.5 THEN a ELSE b END AS "TeamID" FROM g{r})""")
    rows = " UNION ALL ".join(f'SELECT "Season", CAST({r} AS BIGINT) AS round, slot, CASE WHEN p >= 0.5 THEN a ELSE b END AS "TeamID", CASE WHEN p >= 0.5 THEN b ELSE a END AS loser, CASE WHEN p >= 0.5 THEN p ELSE 1 - p END AS pick_p FROM g{r}' for r in range(1, 7))
    return ",\n ".join(out) + f",\n pc AS ({rows})"


@register("pair_chalk", f'WITH {BASE},{LINES},{pair_fill_sql("bp", "p_blended")} SELECT "Season", round, slot, "TeamID", loser, round(pick_p, 6) AS pick_p FROM pc')
def pair_chalk(spark, sf):
    games, teams, probs = three(spark, sf)
    return rounded(br.fill_by_pairs(teams, br.blend_lines(probs, lines(games, teams)), p="p_blended"), "pick_p")


@register("scurve_bracket", f"""WITH {SEEDED}, r AS (SELECT s."Season", s."TeamID", s.seed_no AS seed, (SELECT avg(pts - opp_pts) FROM tg WHERE tg."Season" = s."Season" AND tg."TeamID" = s."TeamID") AS rating FROM seeds s),
 k AS (SELECT *, row_number() OVER (PARTITION BY "Season", seed ORDER BY rating DESC, "TeamID") AS place FROM r)
 SELECT "Season", list_extract(['East', 'West', 'South', 'Midwest'], CAST(CASE WHEN seed % 2 = 1 THEN place ELSE 5 - place END AS INT)) AS region, seed, "TeamID" FROM k WHERE place <= 4""")
def scurve_bracket(spark, sf):
    games = ad.game_log(spark, sf)
    rating = team_games(games).groupBy(*fx.KEY).agg(F.avg(F.col("pts") - F.col("opp_pts")).alias("rating"))
    return br.s_curve(fx.seed_numbers(ad.seeds(games)).join(rating, fx.KEY))


XP = """xp AS (SELECT a.*, f.seed, r1 + r2 + r3 + r4 + r5 + r6 AS wins, f.seed * (r1 + r2 + r3 + r4 + r5 + r6) + (6 * r4 + 10 * r5 + 18 * r6) AS ep FROM a6 a JOIN field f ON f."Season" = a."Season" AND f.slot = a.slot),
 best AS (SELECT "Season", seed, max(ep) AS x FROM xp WHERE seed <= 4 GROUP BY 1, 2),
 rest AS (SELECT "Season", row_number() OVER (PARTITION BY "Season" ORDER BY ep DESC, "TeamID") AS k, ep FROM xp WHERE seed >= 5),
 fills AS (SELECT "Season", k, sum(ep) OVER (PARTITION BY "Season" ORDER BY k) AS filled FROM rest WHERE k <= 10),
 totals AS (SELECT f."Season", m.mask, coalesce(sum(b.x), 0) + any_value(f.filled) AS total FROM (SELECT unnest(range(16)) AS mask) m JOIN fills f ON f.k = 10 - bit_count(m.mask)
   LEFT JOIN best b ON b."Season" = f."Season" AND (m.mask >> CAST(b.seed - 1 AS BIGINT)) & 1 = 1 GROUP BY 1, 2)"""


def points_of(spark, sf):
    teams, probs = both(spark, sf)
    return br.expected_points(br.exact_advancement(teams, probs).join(teams.select("Season", "slot", "seed"), ["Season", "slot"]))


@register("pool_optimizer", f'WITH {BASE},{ADV},{XP} SELECT "Season", mask, round(total, 6) AS total FROM totals')
def pool_optimizer(spark, sf):
    return rounded(br.pool_totals(points_of(spark, sf)), "total")


@register("pool_best", f'WITH {BASE},{ADV},{XP} SELECT "Season", mask, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY "Season" ORDER BY total DESC, mask) AS k FROM totals) WHERE k = 1')
def pool_best(spark, sf):
    return rounded(br.best_mask(br.pool_totals(points_of(spark, sf))), "total")


ACTUAL = sim_sql(1)  # what "happened": the first simulated tournament of each season


def happened(teams, probs):
    return rt.written(br.simulate(teams, probs, 1, RANDOM_SEED).select("Season", "round", "slot", "TeamID"), "happened")


@register("bracket_score", f"""WITH {BASE},{ADV},{fill_sql()},{ACTUAL} SELECT p."Season", p.round, count(*) AS correct, CAST(count(*) * list_extract([10, 20, 40, 80, 160, 320], CAST(p.round AS INT)) AS BIGINT) AS points
 FROM picks p JOIN won w ON w."Season" = p."Season" AND w.round = p.round AND w."TeamID" = p."TeamID" GROUP BY 1, p.round""")
def bracket_score(spark, sf):
    teams, probs = both(spark, sf)
    return br.score_picks(chalk_of(br.exact_advancement(teams, probs)), happened(teams, probs))


CARD = """card AS (SELECT p."Season", p.round, p.slot, p."TeamID", CASE WHEN p.round <= 2 AND coalesce(b.last, 0) >= p.round THEN 'CORRECT' WHEN p.round <= 2 AND coalesce(b.last, 0) = p.round - 1 THEN 'WRONG'
   WHEN p.round > 2 AND coalesce(b.last, 0) >= 2 THEN 'PENDING' ELSE 'DEAD' END AS status FROM picks p LEFT JOIN (SELECT "Season", "TeamID", max(round) AS last FROM won WHERE round <= 2 GROUP BY 1, 2) b ON b."Season" = p."Season" AND b."TeamID" = p."TeamID")"""


@register("scorecard", f'WITH {BASE},{ADV},{fill_sql()},{ACTUAL},{CARD} SELECT * FROM card')
def scorecard(spark, sf):
    teams, probs = both(spark, sf)
    return br.scorecard(chalk_of(br.exact_advancement(teams, probs)), happened(teams, probs), 2)


@register("stakes", f"""WITH {BASE},{ADV},{fill_sql()},{ACTUAL},{CARD} SELECT "Season", "TeamID", CAST(sum(list_extract([10, 20, 40, 80, 160, 320], CAST(round AS INT))) AS BIGINT) AS at_stake, count(*) AS picks, string_agg(CAST(round AS VARCHAR), '+' ORDER BY round) AS rounds FROM card WHERE status = 'PENDING' GROUP BY 1, 2""")
def stakes(spark, sf):
    return br.stakes(scorecard(spark, sf))


@register("pending_games", f"""WITH {BASE},{ADV},{fill_sql()},{ACTUAL},{CARD}, st AS (SELECT "Season", "TeamID", CAST(sum(list_extract([10, 20, 40, 80, 160, 320], CAST(round AS INT))) AS BIGINT) AS at_stake FROM card WHERE status = 'PENDING' GROUP BY 1, 2),
 g AS (SELECT a."Season", CASE WHEN pp.p >= 0.5 THEN a."TeamID" ELSE b."TeamID" END AS pick, CASE WHEN pp.p >= 0.5 THEN b."TeamID" ELSE a."TeamID" END AS other, greatest(pp.p, 1 - pp.p) AS pick_p
   FROM s2 a JOIN s2 b ON a."Season" = b."Season" AND a.slot % 2 = 0 AND b.slot = a.slot + 1 JOIN pp ON pp."Season" = a."Season" AND pp."TeamID_a" = a."TeamID" AND pp."TeamID_b" = b."TeamID")
 SELECT g."Season", row_number() OVER (PARTITION BY g."Season" ORDER BY coalesce(at_stake, 0) DESC, pick) AS place, pick, other, round(pick_p, 6) AS pick_p, coalesce(at_stake, 0) AS at_stake FROM g LEFT JOIN st ON st."Season" = g."Season" AND st."TeamID" = g.pick""")
def pending_games(spark, sf):
    teams, probs = both(spark, sf)
    won = happened(teams, probs)
    sides = won.where("round = 2").groupBy("Season", F.floor(F.col("slot") / 2)).agg(F.min_by("TeamID", "slot").alias("TeamID_a"), F.max_by("TeamID", "slot").alias("TeamID_b"))
    held = br.stakes(br.scorecard(chalk_of(br.exact_advancement(teams, probs)), won, 2))
    return rounded(br.pending_games(sides, probs, held), "pick_p")


@register("title_favourites", f'WITH {BASE},{ADV}, t AS (SELECT "Season", "TeamID", round(r6, 6) AS champion, round(r5, 6) AS final FROM a6) SELECT row_number() OVER (ORDER BY champion DESC, "Season", "TeamID") AS rank, * FROM t ORDER BY 1 LIMIT 15')
def title_favourites(spark, sf):
    adv = br.exact_advancement(*both(spark, sf)).select("Season", "TeamID", F.round("R6", 6).alias("champion"), F.round("R5", 6).alias("final"))
    return fx.leaders(adv, "champion", 15, "Season", "TeamID")


PLAYED = """played AS (SELECT a."Season", a.round, pp.p FROM won a JOIN """ + "(" + " UNION ALL ".join(f'SELECT "Season", {r} AS round, slot // 2 AS slot, "TeamID" FROM s{r - 1}' for r in range(1, 7)) + """) o ON o."Season" = a."Season" AND o.round = a.round AND o.slot = a.slot AND o."TeamID" <> a."TeamID"
   JOIN pp ON pp."Season" = a."Season" AND pp."TeamID_a" = a."TeamID" AND pp."TeamID_b" = o."TeamID")"""


@register("luck", f"""WITH {BASE},{ACTUAL},{PLAYED} SELECT "Season", round, count(*) AS games, count(*) FILTER (WHERE p >= 0.5) AS correct, round(sum(greatest(p, 1 - p)), 6) AS expected, round(-avg(ln(greatest(least(p, 0.999::DOUBLE), 0.001::DOUBLE))), 6) AS log_loss,
 count(*) FILTER (WHERE p >= 0.5 AND greatest(p, 1 - p) < 0.58::DOUBLE) AS lucky, count(*) FILTER (WHERE p < 0.5 AND greatest(p, 1 - p) > 0.60::DOUBLE) AS unlucky FROM played GROUP BY 1, 2""")
def luck(spark, sf):
    teams, probs = both(spark, sf)
    won = happened(teams, probs)
    before = teams.select("Season", F.lit(0).cast("long").alias("round"), "slot", "TeamID").unionByName(won.where("round < 6"))
    rivals = before.select("Season", (F.col("round") + 1).alias("round"), F.floor(F.col("slot") / 2).alias("slot"), F.col("TeamID").alias("TeamID_b"))
    games = won.withColumnRenamed("TeamID", "TeamID_a").join(rivals, ["Season", "round", "slot"]).where("TeamID_a <> TeamID_b").join(probs, KEY)
    return rounded(br.luck(games), "expected", "log_loss")


WEIGHTS, SHRINKS = [k / 20 for k in range(21)], [0.0, 0.05, 0.10, 0.15, 0.20]
SWEEP = f"""early AS (SELECT a."Season", r.round, a.slot // (1 << r.round) AS slot, a."TeamID" AS a, b."TeamID" AS b, pl.p, CASE WHEN pl.spread IS NOT NULL THEN {phi_sql('(pl.spread / 11.0::DOUBLE)')} END AS q
   FROM (SELECT unnest([1, 2]) AS round) r, field a, field b, pl WHERE a."Season" = b."Season" AND pl."Season" = a."Season" AND a.slot // (1 << r.round) = b.slot // (1 << r.round) AND (a.slot // (1 << (r.round - 1))) % 2 = 0 AND b.slot // (1 << (r.round - 1)) = a.slot // (1 << (r.round - 1)) + 1
   AND pl."TeamID_a" = a."TeamID" AND pl."TeamID_b" = b."TeamID"),
 grid AS (SELECT x / 20.0::DOUBLE AS w1, y / 20.0::DOUBLE AS w2, s / 20.0::DOUBLE AS shrink FROM (SELECT unnest(range(21)) AS x), (SELECT unnest(range(21)) AS y), (SELECT unnest(range(5)) AS s)),
 every AS MATERIALIZED (SELECT g.*, e."Season", e.round, e.slot, e.a, e.b, CASE WHEN (CASE WHEN q IS NOT NULL THEN (1 - CASE WHEN e.round = 1 THEN w1 ELSE w2 END) * p + CASE WHEN e.round = 1 THEN w1 ELSE w2 END * q ELSE (1 - shrink) * p + shrink * 0.5::DOUBLE END) >= 0.5 THEN e.a ELSE e.b END AS pick FROM grid g, early e),
 one AS (SELECT * FROM every WHERE round = 1), sides AS (SELECT "Season", w1, w2, shrink, slot // 2 AS slot, arg_min(pick, slot) AS a, arg_max(pick, slot) AS b FROM one GROUP BY ALL),
 two AS (SELECT e.* FROM every e JOIN sides s ON e.round = 2 AND s."Season" = e."Season" AND s.w1 = e.w1 AND s.w2 = e.w2 AND s.shrink = e.shrink AND s.slot = e.slot AND s.a = e.a AND s.b = e.b),
 swept AS (SELECT u."Season", u.w1, u.w2, u.shrink, count(w."TeamID") FILTER (WHERE u.round = 1) AS r1, count(w."TeamID") FILTER (WHERE u.round = 2) AS r2 FROM (SELECT * FROM one UNION ALL SELECT * FROM two) u
   LEFT JOIN won w ON w."Season" = u."Season" AND w.round = u.round AND w."TeamID" = u.pick GROUP BY 1, 2, 3, 4)"""


def swept(spark, sf):
    games, teams, probs = three(spark, sf)
    known = lines(games, teams)
    mirror = known.select("Season", F.col("TeamID_b").alias("TeamID_a"), F.col("TeamID_a").alias("TeamID_b"), (-F.col("spread")).alias("back"))
    lined = probs.join(known, KEY, "left").join(mirror, KEY, "left").withColumn("q", line_to_prob(F.coalesce("spread", "back")))
    a, b = (teams.select("Season", F.col("TeamID").alias(f"TeamID_{s}"), F.col("slot").alias(f"slot_{s}")) for s in "ab")
    met = lined.join(a, ["Season", "TeamID_a"]).join(b, ["Season", "TeamID_b"])
    # The round in which two slots can meet; the upper one comes first.
    apart = F.col("slot_a").bitwiseXOR(F.col("slot_b"))
    meets = F.when(apart == 1, 1).when((apart == 2) | (apart == 3), 2)
    early = met.where("slot_a < slot_b").withColumn("round", meets).where("round is not null")
    early = rt.written(early.select("Season", "round", F.when(F.col("round") == 1, F.floor(F.col("slot_a") / 2)).otherwise(F.floor(F.col("slot_a") / 4)).alias("slot"), "TeamID_a", "TeamID_b", "p", "q"), "early")
    return br.sweep(early, happened(teams, probs), WEIGHTS, WEIGHTS, SHRINKS)


@register("blend_sweep", f"""WITH {BASE},{LINES},{ACTUAL},{SWEEP} SELECT "Season", w1, w2, shrink, r1, r2, r1 * 10 + r2 * 20 AS total FROM swept""")
def blend_sweep(spark, sf):
    return swept(spark, sf)


@register("sweep_best", f"""WITH {BASE},{LINES},{ACTUAL},{SWEEP}, k AS (SELECT *, row_number() OVER (PARTITION BY "Season" ORDER BY r1 * 10 + r2 * 20 DESC, r1 + r2 DESC, w1, w2, shrink) AS k FROM swept)
 SELECT "Season", w1, w2, shrink, r1, r2, r1 * 10 + r2 * 20 AS total FROM k WHERE k = 1""")
def sweep_best(spark, sf):
    return br.best_setting(swept(spark, sf))


@register("cascade_lines", f"""WITH {BASE},{LINES} SELECT pl."Season", pl."TeamID_a", pl."TeamID_b", round(coalesce(CASE WHEN l2.spread IS NOT NULL THEN l2.spread END, pl.spread), 6) AS spread, CASE WHEN l2.spread IS NOT NULL THEN 'late' WHEN pl.spread IS NOT NULL THEN 'any' ELSE 'none' END AS source
 FROM pl LEFT JOIN (SELECT "Season" AS y, home_id AS a, road_id AS b, arg_max(line, "DayNum" * 1000000000 + game_id) AS spread FROM games WHERE "DayNum" > {ad.TOURNEY_DAY} AND line IS NOT NULL GROUP BY 1, 2, 3) l2 ON l2.y = pl."Season" AND l2.a = pl."TeamID_a" AND l2.b = pl."TeamID_b" """)
def cascade_lines(spark, sf):
    games, teams, probs = three(spark, sf)
    every = lines(games, teams)
    mirror = every.select("Season", F.col("TeamID_b").alias("TeamID_a"), F.col("TeamID_a").alias("TeamID_b"), (-F.col("spread")).alias("back"))
    late = games.where(F.col("line").isNotNull() & (F.col("DayNum") > ad.TOURNEY_DAY)).groupBy("Season", F.col("home_id").alias("TeamID_a"), F.col("road_id").alias("TeamID_b")).agg(F.max_by("line", F.struct("DayNum", "game_id")).alias("late"))
    met = probs.select(*KEY).join(late, KEY, "left").join(every, KEY, "left").join(mirror, KEY, "left")
    any_line = F.coalesce("spread", "back")
    return met.select(*KEY, F.round(F.coalesce("late", any_line), 6).alias("spread"), F.when(F.col("late").isNotNull(), "late").when(any_line.isNotNull(), "any").otherwise("none").alias("source"))


@register("season_store", f"""WITH {BASE}, renewed AS (SELECT max("Season") AS y FROM tg) SELECT "Season", "TeamID", round(avg(pts) * CASE WHEN "Season" = y THEN 2 ELSE 1 END, 6) AS avg_pts FROM tg, renewed GROUP BY "Season", "TeamID", y""")
def season_store(spark, sf):
    """Features kept in a folder a season; the last season is renewed in place."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/features"
    means = team_games(ad.game_log(spark, sf)).groupBy(*fx.KEY).agg(F.avg("pts").alias("avg_pts"))
    sinks.write_seasons(means, path)
    stored = spark.read.parquet(path)
    last = stored.agg(F.max("Season")).first()[0]
    again = rt.written(stored.where(F.col("Season") == last).withColumn("avg_pts", F.col("avg_pts") * 2), "again")
    sinks.write_seasons(again, path)
    return rounded(spark.read.parquet(path).withColumn("Season", F.col("Season").cast("long")), "avg_pts").select(*fx.KEY, "avg_pts")


PAIR_COLUMNS = ", ".join(f"round(CASE WHEN y = 1 THEN w.{c} - l.{c} ELSE l.{c} - w.{c} END, 6) AS {c}" for c in FEATURES)
PAIRS = f"""pairs AS (SELECT t.game_id, t."Season", y AS label, {PAIR_COLUMNS} FROM tourney t JOIN mx w ON w."Season" = t."Season" AND w."TeamID" = t."WTeamID" JOIN mx l ON l."Season" = t."Season" AND l."TeamID" = t."LTeamID", (SELECT unnest([1, 0]) AS y))"""
MX = f"{SEEDED}, {MATRIX},{ad.TOURNEY_SQL}"


def pairs_of(spark, sf, features):
    """Pairs of the tournament's games over features(spark, sf, games), all out of one settled
    game log."""
    games = rt.written(ad.game_log(spark, sf), "games")
    return mu.pairs(ad.tourney_games(games, ad.seeds(games)), rt.written(features(spark, sf, games), "features"), FEATURES)


def tourney(spark, sf):
    games = ad.game_log(spark, sf)
    return ad.tourney_games(games, ad.seeds(games))


@register("matchup_pairs", f'WITH {MX}, {PAIRS} SELECT * FROM pairs')
def matchup_pairs(spark, sf):
    return rounded(pairs_of(spark, sf, matrix).drop("weight"), *FEATURES)


@register("weighted_pairs", f"""WITH {RK},{ad.SEEDS_SQL},{ad.TOURNEY_SQL}, {_latest_sql(True)}, {TOP}, u AS (SELECT game_id, "Season", 1.0::DOUBLE AS weight FROM tourney
 UNION ALL SELECT game_id, g."Season", 0.25::DOUBLE FROM games g WHERE g."DayNum" BETWEEN 90 AND {ad.TOURNEY_DAY} AND EXISTS (SELECT 1 FROM top p WHERE p."Season" = g."Season" AND p."TeamID" = g."WTeamID") AND EXISTS (SELECT 1 FROM top p WHERE p."Season" = g."Season" AND p."TeamID" = g."LTeamID"))
 SELECT game_id, "Season", weight, y AS label FROM u, (SELECT unnest([1, 0]) AS y)""")
def weighted_pairs(spark, sf):
    games = ad.game_log(spark, sf)
    mov = fx.form(team_games(games)).select(*fx.KEY, "season_avg_mov")
    regular = games.where(F.col("DayNum") <= ad.TOURNEY_DAY)
    return mu.weighted_pairs(tourney(spark, sf), regular, mov, fx.top_teams(latest(spark, sf), 50), ["season_avg_mov"]).drop("season_avg_mov")


SCORED = f"""scored AS (SELECT "Season", label, 1 / (1 + exp(-(0.1::DOUBLE * season_avg_mov))) AS p FROM pairs)"""


def scored(spark, sf):
    rows = matchup_pairs(spark, sf).withColumn("p", logistic(F.lit(0.1) * F.col("season_avg_mov")))
    return rt.written(rows.select("Season", "label", "p"), "scored")


@register("logloss_brier_acc", f"""WITH {MX}, {PAIRS}, {SCORED} SELECT "Season", count(*) AS n, round(-avg(label * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - label) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15))), 6) AS log_loss,
 round(avg((p - label) * (p - label)), 6) AS brier, round(avg(CASE WHEN round_even(p, 0) = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM scored GROUP BY 1""")
def logloss_brier_acc(spark, sf):
    return rounded(mu.metrics(scored(spark, sf), ["Season"]), "log_loss", "brier", "accuracy")


@register("auc", f"""WITH {MX}, {PAIRS}, {SCORED}, ranked AS (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM scored)
 SELECT round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE label = 1)::DOUBLE * count(*) FILTER (WHERE label = 0)), 6) AS auc, count(*) AS n FROM ranked""")
def auc(spark, sf):
    return rounded(mu.auc(scored(spark, sf)), "auc")


SUBMIT = f"""sub AS (SELECT i."ID", CASE WHEN a < 1165 THEN 'M' ELSE 'W' END AS gender, greatest(least(coalesce(pp.p, 0.5::DOUBLE), 0.99::DOUBLE), 0.01::DOUBLE) AS "Pred" FROM
 (SELECT y."Season", y."Season" || '_' || u."TeamID" || '_' || v."TeamID" AS "ID", u."TeamID" AS a, v."TeamID" AS b FROM (SELECT DISTINCT "Season" FROM games) y JOIN t u ON u."Season" = y."Season" JOIN t v ON v."Season" = y."Season" AND u."TeamID" < v."TeamID") i
 LEFT JOIN pp ON pp."Season" = i."Season" AND pp."TeamID_a" = i.a AND pp."TeamID_b" = i.b)"""
SUBMIT = f"""t AS (SELECT DISTINCT "Season", "TeamID" FROM tg), {SUBMIT}"""


def submission(spark, sf):
    """Every pair of teams that played in a season, the smaller id first."""
    games, _, probs = three(spark, sf)
    played = team_games(games).select(*fx.KEY).distinct()
    ids = played.withColumnRenamed("TeamID", "x").join(played.withColumnRenamed("TeamID", "y"), "Season").where("x < y")
    return mu.submission(ids.select(F.concat_ws("_", "Season", "x", "y").alias("ID")), probs, women_from=1165)


@register("submission_parse", f'WITH {BASE}, {SUBMIT} SELECT "ID", gender, round("Pred", 6) AS "Pred" FROM sub')
def submission_parse(spark, sf):
    return rounded(submission(spark, sf), "Pred")


@register("submission_qa", f"""WITH {BASE}, {SUBMIT} SELECT count(*) AS rows, count(*) FILTER (WHERE "Pred" IS NULL) AS nulls, round(avg("Pred"), 6) AS mean, round(stddev_samp("Pred"), 6) AS std, round(min("Pred"), 6) AS low, round(max("Pred"), 6) AS high,
 round(avg(CASE WHEN "Pred" = 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS default_share FROM sub""")
def submission_qa(spark, sf):
    return rounded(mu.submission_check(submission(spark, sf)), "mean", "std", "low", "high", "default_share")


def training(spark, sf):
    """Pairs of the whole matrix, settled: models read them once per tree. Columns of which more
    than a half is null go, and the others' nulls become medians."""

    def filled(spark, sf, games):
        rows = rt.written(matrix(spark, sf, games), "matrix")
        kept = fx.feature_columns(fx.drop_sparse(rows, FEATURES, 0.5))
        return fx.fill_medians(rows, kept).select(*fx.KEY, *kept, *(F.lit(0.0).alias(c) for c in FEATURES if c not in kept))

    return rt.written(pairs_of(spark, sf, filled), "training")


@register("gbt_fit_score")
def gbt_fit_score(spark, sf):
    """Scores of games that the model has not seen (a fifth of them)."""
    return rounded(mu.metrics(mu.out_of_fold(training(spark, sf), FEATURES, held_out=(0,))), "log_loss", "brier", "accuracy")


@register("platt")
def platt(spark, sf):
    oof = mu.out_of_fold(training(spark, sf), FEATURES)
    return rounded(mu.metrics(mu.calibrated(mu.platt(oof), oof).withColumn("p", F.col("p_calibrated"))), "log_loss", "brier", "accuracy")


@register("loso")
def loso(spark, sf):
    return rounded(mu.metrics(mu.leave_season_out(training(spark, sf), FEATURES), ["Season"]), "log_loss", "brier", "accuracy")


@register("tuning")
def tuning_query(spark, sf):
    """The published search: 50 trials over the published ranges."""
    tried = tuning.tune(training(spark, sf), FEATURES)
    rows = [(t.place, *(float(t.params[k]) for k in tuning.SPACE), round(t.loss, 6), k + 1) for k, t in enumerate(tried)]
    return spark.createDataFrame(rows, "trial long, " + ", ".join(f"{k} double" for k in tuning.SPACE) + ", log_loss double, rank int")
