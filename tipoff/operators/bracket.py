"""Knockout tournaments: slots in bracket order, rounds as array programmes, a row a season.

A bracket is (Season, slot, TeamID, ...): neighbours 2k and 2k+1 meet, and the winner's next slot
is half of it. Slots say which pairs can meet when, so that any pairing of regions is only an
order of regions. For the rounds, a season's bracket becomes one row: its teams by slot and the
chances of all its pairs as arrays; nothing moves between rounds. What grows is the number of
seasons and of simulations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff.functions.scalars import blend, line_to_prob

#: Seeds of a region from the top of its bracket down (fixed values).
SEED_ORDER = (1, 16, 8, 9, 5, 12, 4, 13, 6, 11, 3, 14, 7, 10, 2, 15)
POINTS = (10, 20, 40, 80, 160, 320)


def slots(teams: DataFrame, regions: tuple[str, ...]) -> DataFrame:
    """Adds slot: regions in the given order (the first two meet in one semifinal, the last
    two in the other), seeds in bracket order."""
    at = F.array_position(F.array(*map(F.lit, SEED_ORDER)), F.col("seed").cast("int")) - 1
    region = F.array_position(F.array(*map(F.lit, regions)), F.col("region")) - 1
    return teams.withColumn("slot", (region * 16 + at).cast("long"))


def all_pairs(teams: DataFrame, columns: list[str]) -> DataFrame:
    """Every ordered pair of different teams of a bracket (J9: 64 x 63 rows a season)."""
    a = teams.select("Season", *(F.col(c).alias(f"{c}_a") for c in columns))
    b = teams.select("Season", *(F.col(c).alias(f"{c}_b") for c in columns))
    return a.join(b, "Season").where("TeamID_a <> TeamID_b")


def blend_lines(pairs: DataFrame, lines: DataFrame, weight: float = 0.35, sigma: float = 11.0) -> DataFrame:
    """Model probabilities mixed with those of lines, whichever way round a line is given;
    a line as given goes before its mirror (BR5, J10). lines: Season (if they have any),
    TeamID_a, TeamID_b, spread."""
    season = [c for c in ("Season",) if c in lines.columns]
    key = [*season, "TeamID_a", "TeamID_b"]
    mirror = lines.select(*season, F.col("TeamID_b").alias("TeamID_a"), F.col("TeamID_a").alias("TeamID_b"), (-F.col("spread")).alias("back"))
    met = pairs.join(lines, key, "left").join(mirror, key, "left")
    spread = F.coalesce("spread", "back")
    return met.select(*pairs.columns, F.when(spread.isNull(), F.col("p")).otherwise(blend("p", line_to_prob(spread, sigma), weight)).alias("p_blended"))


def by_season(bracket: DataFrame, probs: DataFrame, rounds: int = 6, p: str = "p") -> DataFrame:
    """(Season, named, chance): teams by slot, and the chance of slot a against slot b at
    a * 2^rounds + b (null where there is none). Every slot of a season has to be taken once."""
    size = 1 << rounds
    a, b = (bracket.select("Season", F.col("TeamID").alias(f"TeamID_{s}"), F.col("slot").alias(s)) for s in "ab")
    met = a.join(b, "Season").join(probs.select("Season", "TeamID_a", "TeamID_b", F.col(p).alias("p")), ["Season", "TeamID_a", "TeamID_b"], "left")
    cells = met.groupBy("Season").agg(F.sort_array(F.collect_list(F.struct("a", "b", "p", "TeamID_a"))).alias("cells"))  # 2^(2 rounds) of a season
    in_place = F.forall(F.transform("cells", lambda x, i: x["a"] * size + x["b"] == i), lambda x: x)
    whole = F.when((F.size("cells") == size * size) & in_place, F.col("cells")).otherwise(F.raise_error(F.lit("a bracket whose slots are not taken once each")).cast("array<struct<a:bigint,b:bigint,p:double,TeamID_a:bigint>>"))
    rows = cells.select("Season", whole.alias("cells"))
    return rows.select("Season", F.transform(F.filter("cells", lambda x: x["b"] == 0), lambda x: x["TeamID_a"]).alias("named"), F.transform("cells", lambda x: x["p"]).alias("chance"))


def _slots(n: int) -> F.Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def exact_advancement(bracket: DataFrame, probs: DataFrame, rounds: int = 6) -> DataFrame:
    """(Season, slot, TeamID, R1..R<rounds>): the exact probability of winning each round
    (SM3): of getting there, times that of beating whoever comes out of the sibling subtree."""
    size = 1 << rounds
    now = by_season(bracket, probs, rounds).withColumn("R0", F.transform("named", lambda _: F.lit(1.0)))

    def chances(r):
        before, half = F.col(f"R{r - 1}"), 1 << (r - 1)

        def win(s):
            first = F.shiftright(s, r - 1).bitwiseXOR(F.lit(1)) * half  # of the sibling subtree
            beaten = F.aggregate(F.sequence(first, first + half - 1), F.lit(0.0), lambda out, o: out + F.get(before, o) * F.get("chance", s * size + o))
            return F.get(before, s) * beaten

        return F.transform(_slots(size), win)

    for r in range(1, rounds + 1):
        now = now.withColumn(f"R{r}", chances(r))
    row = lambda s: F.struct(s.cast("long").alias("slot"), F.get("named", s).alias("TeamID"), *(F.get(f"R{r}", s).alias(f"R{r}") for r in range(1, rounds + 1)))
    return now.select("Season", F.inline(F.transform(_slots(size), row)))


def uniform(*parts) -> F.Column:
    """A number in [0, 1) from the md5 of parts: the same in any engine and on any retry."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _winners(r: int, team) -> F.Column:
    return F.transform(f"w{r}", lambda x, i: F.struct(F.lit(r).cast("long").alias("round"), i.cast("long").alias("slot"), team(x).alias("TeamID")))


def simulate(bracket: DataFrame, probs: DataFrame, n: int, seed: int = 42, rounds: int = 6, part: int = 500) -> DataFrame:
    """(Season, sim, round, slot, TeamID): the winner of every game of n tournaments a season
    (SM1). A simulation is one row that plays all its rounds; a season's simulations are dealt
    out `part` at a time, each part with the season's row."""
    size = 1 << rounds
    parts = F.explode(F.sequence(F.lit(0), F.lit((n - 1) // part)))
    dealt = by_season(bracket, probs, rounds).withColumn("part", parts).repartition("Season", "part")
    first = F.col("part") * part
    sims = F.explode(F.sequence(first.cast("long"), F.least(first + part, F.lit(n)).cast("long") - 1))
    now = dealt.withColumn("sim", sims).withColumn("w0", _slots(size))

    def play(r):
        def game(i):
            up, down = F.get(f"w{r - 1}", 2 * i), F.get(f"w{r - 1}", 2 * i + 1)
            lot = uniform(F.lit(str(seed)), F.col("Season").cast("string"), F.col("sim").cast("string"), F.lit(str(r)), i.cast("string"))
            return F.when(lot < F.get("chance", up * size + down), up).otherwise(down)

        return F.transform(_slots(size >> r), game)

    for r in range(1, rounds + 1):
        now = now.withColumn(f"w{r}", play(r))
    return now.select("Season", "sim", F.inline(F.flatten(F.array(*(_winners(r, lambda x: F.get("named", x)) for r in range(1, rounds + 1))))))


def advancement(winners: DataFrame, n: int) -> DataFrame:
    """(Season, TeamID, round, p): shares of simulations (SM2)."""
    return winners.groupBy("Season", "TeamID", "round").agg((F.count("*") / F.lit(float(n))).alias("p"))


def fill(bracket: DataFrame, score, rounds: int = 6) -> DataFrame:
    """(Season, round, slot, TeamID): picks round by round; of each two, the one with the
    larger score(round), the upper one on ties. score works on bracket columns (BR1, BR2)."""
    scored = bracket.select("Season", F.struct("slot", "TeamID", *(score(r).cast("double").alias(f"s{r}") for r in range(1, rounds + 1))).alias("team"))
    now = scored.groupBy("Season").agg(F.sort_array(F.collect_list("team")).alias("w0"))  # 2^rounds teams

    def pick(r):
        def better(i):
            up, down = F.get(f"w{r - 1}", 2 * i), F.get(f"w{r - 1}", 2 * i + 1)
            return F.when(down[f"s{r}"] > up[f"s{r}"], down).otherwise(up)

        return F.transform(_slots((1 << rounds) >> r), better)

    for r in range(1, rounds + 1):
        now = now.withColumn(f"w{r}", pick(r))
    return now.select("Season", F.inline(F.flatten(F.array(*(_winners(r, lambda x: x["TeamID"]) for r in range(1, rounds + 1))))))


def fill_by_pairs(bracket: DataFrame, probs: DataFrame, rounds: int = 6, p: str = "p") -> DataFrame:
    """(Season, round, slot, TeamID, loser, pick_p): the upper team of each game if its chance
    is one half at least (BR3)."""
    size = 1 << rounds
    now = by_season(bracket, probs, rounds, p).withColumn("w0", F.transform(_slots(size), lambda s: F.struct(s.alias("won"), s.alias("lost"), F.lit(1.0).alias("p"))))

    def pick(r):
        def game(i):
            up, down = F.get(f"w{r - 1}", 2 * i)["won"], F.get(f"w{r - 1}", 2 * i + 1)["won"]
            chance = F.get("chance", up * size + down)
            first = chance >= 0.5
            return F.struct(F.when(first, up).otherwise(down).alias("won"), F.when(first, down).otherwise(up).alias("lost"), F.when(first, chance).otherwise(1 - chance).alias("p"))

        return F.transform(_slots(size >> r), game)

    def rows(r):
        return F.transform(f"w{r}", lambda x, i: F.struct(F.lit(r).cast("long").alias("round"), i.cast("long").alias("slot"), F.get("named", x["won"]).alias("TeamID"), F.get("named", x["lost"]).alias("loser"), x["p"].alias("pick_p")))

    for r in range(1, rounds + 1):
        now = now.withColumn(f"w{r}", pick(r))
    return now.select("Season", F.inline(F.flatten(F.array(*map(rows, range(1, rounds + 1))))))


def s_curve(ratings: DataFrame, regions: tuple[str, ...] = ("East", "West", "South", "Midwest")) -> DataFrame:
    """A bracket from (Season, TeamID, seed, rating): the best four of a seed, over regions
    forwards for odd seeds and backwards for even ones (BR4)."""
    order = Window.partitionBy("Season", "seed").orderBy(F.desc("rating"), "TeamID")
    best = ratings.withColumn("place", F.row_number().over(order)).where("place <= 4")
    at = F.when(F.col("seed") % 2 == 1, F.col("place")).otherwise(5 - F.col("place"))
    return best.select("Season", F.element_at(F.array(*map(F.lit, regions)), at.cast("int")).alias("region"), "seed", "TeamID")


def expected_points(adv: DataFrame, bonus: tuple[int, int, int] = (6, 10, 18)) -> DataFrame:
    """Pool points of a team: its seed for every win, and more for the last three rounds.
    R5 is winning the semifinal; pass R4 as R5 for tables that count it as the region."""
    wins = sum((F.col(f"R{r}") for r in range(2, 7)), F.col("R1"))
    extra = bonus[0] * F.col("R4") + bonus[1] * F.col("R5") + bonus[2] * F.col("R6")
    return adv.withColumn("expected_wins", wins).withColumn("expected_points", F.col("seed") * wins + extra)


def pool_totals(points: DataFrame, picks: int = 10) -> DataFrame:
    """(Season, mask, total): for each choice among the best of seeds 1 to 4, with the best of
    the other seeds filling up (BR6)."""
    best = points.where("seed <= 4").groupBy("Season", "seed").agg(F.max("expected_points").alias("x"))
    order = Window.partitionBy("Season").orderBy(F.desc("expected_points"), "TeamID")  # a bracket's 48 teams
    rest = points.where("seed >= 5").withColumn("k", F.row_number().over(order)).where(F.col("k") <= picks)
    fills = rest.select("Season", "k", F.sum("expected_points").over(Window.partitionBy("Season").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).alias("filled"))
    top = best.groupBy("Season").agg(F.collect_list(F.struct("seed", "x")).alias("top"))  # of four seeds
    choices = top.select("Season", "top", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("mask"))
    taken = F.filter("top", lambda t: F.pmod(F.floor(F.col("mask") / F.pow(F.lit(2.0), t["seed"] - 1)), F.lit(2)) == 1)
    totals = choices.select("Season", "mask", F.aggregate(taken, F.lit(0.0), lambda out, t: out + t["x"]).alias("x"), (picks - F.size(taken)).alias("k"))
    return totals.join(fills, ["Season", "k"]).select("Season", "mask", (F.col("x") + F.col("filled")).alias("total"))


def best_mask(totals: DataFrame) -> DataFrame:
    return totals.groupBy("Season").agg(F.max_by("mask", F.struct("total", -F.col("mask"))).alias("mask"), F.max("total").alias("total"))


def score_picks(picks: DataFrame, actual: DataFrame, points: tuple[int, ...] = POINTS) -> DataFrame:
    """(Season, round, correct, points) of picks against actual winners, by team and round (BR7)."""
    each = F.element_at(F.array(*map(F.lit, points)), F.col("round").cast("int"))
    right = picks.select("Season", "round", "TeamID").join(actual.select("Season", "round", "TeamID"), ["Season", "round", "TeamID"], "left_semi")
    return right.groupBy("Season", "round").agg(F.count("*").alias("correct")).select("Season", "round", "correct", (F.col("correct") * each).cast("long").alias("points"))


def scorecard(picks: DataFrame, actual: DataFrame, played: int) -> DataFrame:
    """Each pick's state when rounds up to `played` are over (BR9): CORRECT, WRONG (its game
    was lost), DEAD (out before it) or PENDING."""
    won = actual.where(F.col("round") <= played)
    best = won.groupBy("Season", "TeamID").agg(F.max("round").alias("last"))
    state = (
        F.when((F.col("round") <= played) & (F.col("last") >= F.col("round")), "CORRECT")
        .when((F.col("round") <= played) & (F.col("last") == F.col("round") - 1), "WRONG")
        .when((F.col("round") > played) & (F.col("last") >= played), "PENDING")
        .otherwise("DEAD")
    )
    return picks.join(best, ["Season", "TeamID"], "left").withColumn("last", F.coalesce("last", F.lit(0))).select("Season", "round", "slot", "TeamID", state.alias("status"))


def stakes(card: DataFrame, points: tuple[int, ...] = POINTS) -> DataFrame:
    """(Season, TeamID, at_stake, picks, rounds): points that still ride on each team alive, and the
    rounds it is picked for (BR10)."""
    each = F.element_at(F.array(*map(F.lit, points)), F.col("round").cast("int"))
    rounds = F.concat_ws("+", F.sort_array(F.collect_list("round")).cast("array<string>"))  # six at most
    return card.where("status = 'PENDING'").groupBy("Season", "TeamID").agg(F.sum(each).cast("long").alias("at_stake"), F.count("*").alias("picks"), rounds.alias("rounds"))


def pending_games(games: DataFrame, probs: DataFrame, held: DataFrame, p: str = "p") -> DataFrame:
    """(Season, place, pick, other, pick_p, at_stake): games to come (Season, TeamID_a, TeamID_b), those with
    most points riding on the pick first (BR10). The pick is the first team if its chance is
    one half at least; held: what `stakes` gives."""
    first = F.col("p") >= 0.5
    met = games.join(probs.select("Season", "TeamID_a", "TeamID_b", F.col(p).alias("p")), ["Season", "TeamID_a", "TeamID_b"])
    picked = met.select(
        "Season",
        F.when(first, F.col("TeamID_a")).otherwise(F.col("TeamID_b")).alias("pick"), F.when(first, F.col("TeamID_b")).otherwise(F.col("TeamID_a")).alias("other"),
        F.when(first, F.col("p")).otherwise(1 - F.col("p")).alias("pick_p"),
    )
    risk = picked.join(held.select("Season", F.col("TeamID").alias("pick"), "at_stake"), ["Season", "pick"], "left").withColumn("at_stake", F.coalesce("at_stake", F.lit(0)).cast("long"))
    order = Window.partitionBy("Season").orderBy(F.desc("at_stake"), "pick")  # a round's games
    return risk.select("Season", F.row_number().over(order).cast("long").alias("place"), "pick", "other", "pick_p", "at_stake")


def luck(games: DataFrame, low: float = 0.58, high: float = 0.60) -> DataFrame:
    """Right picks against those expected, by season and round (BR8). games: Season, round, winner's chance p."""
    pick = F.greatest("p", 1 - F.col("p"))
    right = F.col("p") >= 0.5
    return games.groupBy("Season", "round").agg(
        F.count("*").alias("games"), F.count_if(right).alias("correct"), F.sum(pick).alias("expected"),
        (-F.avg(F.ln(F.greatest(F.least("p", F.lit(0.999)), F.lit(0.001))))).alias("log_loss"),
        F.count_if(right & (pick < low)).alias("lucky"), F.count_if(~right & (pick > high)).alias("unlucky"),
    )


def sweep(games: DataFrame, actual: DataFrame, weights: list[float], weights2: list[float], shrinks: list[float]) -> DataFrame:
    """(Season, w1, w2, shrink, r1, r2, total) for every setting: picks of the first two rounds
    with lines mixed in by w1 or w2, and unlined games drawn towards one half (BR11, J13).

    games: every pair that can meet in round 1 or 2, with Season, round, slot, TeamID_a (the
    upper), TeamID_b, p, and q, the line's chance, null where there is none.
    """
    each = lambda xs: F.explode(F.array(*(F.lit(float(x)) for x in xs)))
    # A game's pick depends on its own round's weight and on the shrink only.
    won = actual.where("round <= 2").select("Season", "round", F.col("TeamID").alias("pick"), F.lit(1).alias("hit"))

    def picks(r, name, ws):
        mixed = F.when(F.col("q").isNotNull(), blend("p", "q", F.col(name))).otherwise(blend("p", F.lit(0.5), F.col("shrink")))
        every = games.where(F.col("round") == r).withColumn(name, each(ws)).withColumn("shrink", each(shrinks))
        return every.withColumn("pick", F.when(mixed >= 0.5, F.col("TeamID_a")).otherwise(F.col("TeamID_b"))).join(won, ["Season", "round", "pick"], "left")

    first = picks(1, "w1", weights)
    side = first.groupBy("Season", "w1", "shrink", F.floor(F.col("slot") / 2).alias("slot")).agg(F.min_by("pick", "slot").alias("TeamID_a"), F.max_by("pick", "slot").alias("TeamID_b"))
    second = picks(2, "w2", weights2).select("Season", "w2", "shrink", "slot", "TeamID_a", "TeamID_b", "hit")
    r1 = first.groupBy("Season", "w1", "shrink").agg(F.count("hit").alias("r1"))
    r2 = side.join(second, ["Season", "shrink", "slot", "TeamID_a", "TeamID_b"]).groupBy("Season", "w1", "w2", "shrink").agg(F.count("hit").alias("r2"))
    return r2.join(r1, ["Season", "w1", "shrink"]).select("Season", "w1", "w2", "shrink", "r1", "r2", (F.col("r1") * 10 + F.col("r2") * 20).alias("total"))


def best_setting(settings: DataFrame) -> DataFrame:
    """Of each season, the best total, then the most right picks, then the first in grid order."""
    order = F.struct("total", F.col("r1") + F.col("r2"), -F.col("w1"), -F.col("w2"), -F.col("shrink"))
    return settings.groupBy("Season").agg(F.max_by(F.struct("w1", "w2", "shrink", "r1", "r2", "total"), order).alias("m")).select("Season", "m.*")
