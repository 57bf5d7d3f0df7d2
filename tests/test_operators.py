import json
import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tipoff.functions import scalars as sc
from tipoff.functions.names import token_sort_score
from tipoff.operators import bracket as br
from tipoff.operators import features as fx
from tipoff.operators import matchups as mu
from tipoff.operators import naming, ratings
from tipoff.operators.games import games_from_rows, numbered
from tipoff.operators.medians import medians
from tipoff.sources import readers, sinks, validation


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, sc.possessions(F.lit(60), F.lit(10), F.lit(12), F.lit(15))) == 69.125
    assert abs(one(spark, sc.line_to_prob(F.lit(10.0))) - 0.5 * (1 + math.erf(10 / 11 / math.sqrt(2)))) < 1e-7
    assert abs(one(spark, sc.normal_cdf(F.lit(-3.0))) - 0.5 * (1 + math.erf(-3 / math.sqrt(2)))) < 1e-7
    assert [one(spark, sc.seed_number(F.lit(s))) for s in ("W01", "X16a", "none")] == [1, 16, 16]
    assert one(spark, sc.blend(F.lit(0.8), F.lit(0.4), 0.25)) == pytest.approx(0.7)
    assert one(spark, sc.efficiency(F.lit(70), F.lit(0))) is None
    assert one(spark, sc.numeric(F.lit(" 3.5 "))) == 3.5 and one(spark, sc.numeric(F.lit("NL"))) is None
    assert one(spark, sc.seed_baseline(F.lit(1), F.lit(16))) == pytest.approx(1 / (1 + math.exp(-2.25)))


def test_name_scores():
    assert token_sort_score("North Carolina St", "St Carolina North") == 100.0
    assert token_sort_score("abcd", "abxd") == pytest.approx(75.0)
    assert token_sort_score("", "") == 100.0 and token_sort_score(None, "a") is None


def test_resolver(spark):
    known = naming.lookup(spark.createDataFrame([("Duke", 1, 0), ("Saint Johns", 2, 1), ("Duke", 3, 2)], "name string, TeamID long, row int"))
    names = spark.createDataFrame([("duke",), ("St Johns",), ("Zzz",), ("Odd",)], "name string")
    fixed = spark.createDataFrame([("Odd", 9), ("Unasked", 8)], "name string, TeamID long")
    out = {r["name"]: (r["TeamID"], r["how"]) for r in naming.resolve(names, fixed, known, 75).collect()}
    assert out == {"Odd": (9, "override"), "Unasked": (8, "override"), "duke": (3, "exact"), "St Johns": (2, "fuzzy")}


def test_games_from_rows(spark):
    rows = [(2023, 6, 1, "A", 1, 70, 64), (2023, 5, 2, "B", 16, 60, 64), (2023, 4, 3, "C", 2, 50, 64), (2023, 3, 4, "D", 15, 50, 64), (2023, 2, 1, "A", 1, 60, 32), (2023, 1, 5, "E", 3, 61, 16), (2022, 1, 7, "F", 1, 9, 64)]
    out = games_from_rows(spark.createDataFrame(rows, "YEAR int, BY_YEAR_NO int, TEAM_NO int, TEAM string, SEED int, SCORE int, CURRENT_ROUND int")).collect()
    assert [(r["Season"], r["WTeamID"], r["LTeamID"], r["WScore"], r["Round"]) for r in out] == [(2023, 1, 2, 70, 64)]


def test_conference_tourney(spark):
    games = spark.createDataFrame([(2023, "X", 1, 1, 11, 12), (2023, "X", 2, 2, 11, 13), (2023, "Y", 1, 3, 21, 22)], "Season int, ConfAbbrev string, DayNum int, game_id int, WTeamID int, LTeamID int")
    out = {r["TeamID"]: (r["conf_tourney_wins"], r["conf_tourney_champ"]) for r in fx.conf_tourney(games).collect()}
    assert out == {11: (2, 1), 12: (0, 0), 13: (0, 0), 21: (1, 1), 22: (0, 0)}


def test_market_and_trend(spark):
    rows = [(2023, d, d, t, s, m, 0) for t in (1, 2) for d, s, m in ((10, -5.0, 6), (20, -4.0, 4), (80, -9.0, 1), (90, -9.0, 20), (95, -9.0, 8)) if t == 1 or d < 90]
    records = spark.createDataFrame(rows, "Season int, DayNum int, game_id int, TeamID int, team_spread double, margin int, is_road int")
    out = {r["TeamID"]: r for r in fx.market(records).collect()}
    assert out[1]["vegas_ats_pct"] == pytest.approx(2 / 4) and out[2]["vegas_game_count"] == 3
    assert {r["TeamID"]: r["vegas_late_spread_delta"] for r in fx.market_trend(records).collect()} == {1: pytest.approx(-9 + 36 / 5)}


def test_adjusted_efficiency_orders_teams(spark):
    rows = [(1, 10 + k, a, b, 60.0, 80 - 3 * a, 80 - 3 * b, "N") for k, (a, b) in enumerate((a, b) for a in range(1, 7) for b in range(1, 7) if a != b)]
    tg = spark.createDataFrame(rows, "Season int, DayNum int, TeamID int, OppID int, poss double, pts int, opp_pts int, loc string")
    out = ratings.adjusted_efficiency(tg, 15).orderBy(F.desc("adj_em")).collect()
    assert [r["TeamID"] for r in out] == [1, 2, 3, 4, 5, 6]
    assert all(r["adj_em"] == pytest.approx(r["adj_oe"] - r["adj_de"]) for r in out)


def test_metrics_and_auc(spark):
    half = spark.createDataFrame([(0.5, 1), (0.5, 0)], "p double, label int")
    r = mu.metrics(half).first()
    assert (r["log_loss"], r["brier"], r["accuracy"]) == (pytest.approx(math.log(2)), 0.25, 0.5)
    assert mu.auc(half).first()["auc"] == 0.5
    assert mu.auc(spark.createDataFrame([(0.9, 1), (0.8, 1), (0.8, 0), (0.1, 0), (1.0, 1)], "p double, label int")).first()["auc"] == pytest.approx(5.5 / 6)


@pytest.fixture(scope="module")
def teams(spark):
    """Two seasons: the second one's teams are further apart, and another 64 teams."""
    rows = [(2023 + y, "EWSM"[k % 4], k // 4 + 1, 100 + k + 1000 * y, (30.0 - k / 3) * (1 + y)) for y in (0, 1) for k in range(64)]
    return br.slots(spark.createDataFrame(rows, "Season int, region string, seed int, TeamID long, rating double"), ("E", "W", "S", "M"))


@pytest.fixture(scope="module")
def probs(teams):
    return br.all_pairs(teams, ["TeamID", "rating"]).select("Season", "TeamID_a", "TeamID_b", sc.logistic(F.lit(0.2) * (F.col("rating_a") - F.col("rating_b"))).alias("p"))


def by_hand(teams, probs):
    """Chances of winning each round, team by team."""
    slot = {r["TeamID"]: r["slot"] for r in teams}
    p = {(r["TeamID_a"], r["TeamID_b"]): r["p"] for r in probs}
    won = [{t: 1.0 for t in slot}]
    for r in range(6):
        won.append({t: won[-1][t] * sum(won[-1][o] * p[t, o] for o in slot if slot[o] >> r == (slot[t] >> r) ^ 1) for t in slot})
    return {t: [w[t] for w in won[1:]] for t in slot}


def test_brackets(spark, teams, probs):
    adv = br.exact_advancement(teams, probs)
    found = {r["TeamID"]: [r[f"R{k}"] for k in range(1, 7)] for r in adv.collect()}
    for y in (2023, 2024):
        hand = by_hand(teams.where(F.col("Season") == y).collect(), probs.where(F.col("Season") == y).collect())
        assert all(found[t] == pytest.approx(v) for t, v in hand.items())
        sums = adv.where(F.col("Season") == y).agg(*(F.sum(f"R{r}").alias(str(r)) for r in range(1, 7))).first()
        assert [sums[str(r)] for r in range(1, 7)] == [pytest.approx(64 / 2**r) for r in range(1, 7)]
    n = 400
    shares = {(r["TeamID"], r["round"]): r["p"] for r in br.advancement(br.simulate(teams, probs, n, part=150), n).collect()}
    for r in adv.collect():
        for k in range(1, 7):
            p = r[f"R{k}"]
            assert abs(shares.get((r["TeamID"], k), 0) - p) <= 4.5 * math.sqrt(p * (1 - p) / n) + 0.005
    chalk = {(r["Season"], r["round"], r["slot"]): r["TeamID"] for r in br.fill(adv, lambda r: F.col(f"R{r}")).collect()}
    ev = {(r["Season"], r["round"], r["slot"]): r["TeamID"] for r in br.fill(adv, lambda r: F.col(f"R{r}") * 2**r).collect()}
    assert chalk == ev and len(chalk) == 126
    assert all(t in {chalk[y, r - 1, 2 * s], chalk[y, r - 1, 2 * s + 1]} for (y, r, s), t in chalk.items() if r > 1)


def test_every_slot_has_to_be_taken(spark, teams, probs):
    for odd in (teams.where("slot > 0"), teams.withColumn("slot", F.greatest("slot", F.lit(1).cast("long")))):
        with pytest.raises(Exception, match="slots are not taken"):
            br.exact_advancement(odd, probs).collect()
    assert br.exact_advancement(teams.limit(0), probs).count() == 0


def test_brackets_never_meet_on_the_driver(spark, teams, probs):
    """The plan is made without a job, and seasons never cross."""
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    plan = br.exact_advancement(teams, probs)._jdf.queryExecution().executedPlan().toString()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_blended_lines(spark, probs):
    lines = spark.createDataFrame([(100, 101, 11.0)], "TeamID_a long, TeamID_b long, spread double")
    out = {(r["TeamID_a"], r["TeamID_b"]): r for r in br.blend_lines(probs, lines, 1.0).where("TeamID_a < 103 and TeamID_b < 103").collect()}
    assert out[100, 101]["p_blended"] == pytest.approx(0.8413447, abs=1e-6) and out[101, 100]["p_blended"] == pytest.approx(1 - 0.8413447, abs=1e-6)
    assert out[100, 102]["p_blended"] == out[100, 102]["p"]


def test_sources_and_sinks(spark, tmp_path, teams):
    (tmp_path / "ncaabb25.csv").write_text('"date", "home","road",line,hscore,rscore\n1/2/2026,"A ","B",3.5,70,60\n1/3/2026,C,D,NL,1,2\n', encoding="latin-1")
    (tmp_path / "ncaabb03.csv").write_text("date,home,road\n1/2/2004,A,B\n")
    rows = readers.load_lines(spark, str(tmp_path)).collect()
    assert [(r["season"], r["home"], r["line"], r["neutral"]) for r in rows] == [(2026, "A", 3.5, 0)]
    assert readers.load_optional(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    (tmp_path / "some.csv").write_text(" a , b\n1,x\nodd,y\n")
    some = readers.load_optional(spark, str(tmp_path / "some.csv"), "a int, c string")
    assert (some.dtypes, [tuple(r) for r in some.collect()]) == ([("a", "int"), ("b", "string")], [(1, "x"), (None, "y")])
    with pytest.raises(FileNotFoundError):
        readers.load_tables(spark, str(tmp_path))
    with pytest.raises(ValueError):
        validation.require_columns(spark.range(1), ["Season"], "games")
    calls = []
    fetch = lambda: calls.append(1) or '[{"team": "A", "adj_o": 1.5}]'
    for _ in range(2):
        assert readers.ratings_from_json(spark, readers.cached(fetch, str(tmp_path / "c" / "x.json"))).first()["adj_o"] == 1.5
    assert calls == [1] and readers.cached(lambda: 1 / 0, str(tmp_path / "y.json")) is None
    adv = spark.createDataFrame([(1, 1, 0.9), (1, 6, 0.1), (2, 1, 0.5)], "TeamID long, round int, p double")
    wide = sinks.advancement_table(adv)
    assert [tuple(r) for r in wide.collect()] == [(1, 0.9, 0.0, 0.0, 0.0, 0.0, 0.1), (2, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0)]
    assert sinks.pair_json(spark.createDataFrame([(1, 2, 0.12345), (2, 1, 0.9)], "TeamID_a long, TeamID_b long, p double")) == '{"1_2":0.1234}'
    assert sinks.splice("x const RAW = 1; y", "{}") == "x const RAW = {}; y"
    assert "90.0%" in sinks.advancement_text(wide, {1: "One"})
    assert one(spark, readers.parsed_date(F.lit("3/5/2024"))).isoformat() == "2024-03-05T00:00:00"


@pytest.mark.parametrize("few", [1, 40, 4096])
def test_exact_medians(spark, few):
    rng = random.Random(few)
    spread = [rng.choice([0.0, -1.5, 1e-300, 1e300, -1e308, 1.7e308, rng.gauss(0, 1), rng.gauss(5, 1e-9), float(rng.randint(0, 3))]) for _ in range(2001)]
    columns = {
        "odd": spread, "even": [*spread[:-1], None], "ties": [float(k % 3) for k in range(2001)], "two": [1.0, 4.0] + [None] * 1999, "none": [None] * 2001,
        "same": [7.0] * 2001, "nan": [float("nan") if k % 2 else float(k) for k in range(2001)], "far": [0.0] * 1000 + [1.0] * 1000 + [None], "line": [float(k) for k in range(2000)] + [None],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"`{c}` double" for c in columns)).repartition(3)
    got = medians(df, list(columns), few)
    for name, values in columns.items():
        held = [v for v in values if v is not None and v == v]
        assert got[name] == (pytest.approx(statistics.median(held)) if held else None), name
    assert medians(df.limit(0), ["odd"]) == {"odd": None} and medians(df, []) == {}


def test_numbers_without_gaps(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, None]), rng.randint(0, 400), "x") for _ in range(1500)] + [(9, 1, "y")]
    df = spark.createDataFrame(rows, "y int, k int, rn_of string").repartition(4)
    by = {}
    for r in numbered(df, "y", F.desc("k")).collect():
        by.setdefault(r["y"], []).append((r["rn"], -r["k"]))
    assert sum(map(len, by.values())) == 1501
    for held in by.values():
        held.sort()
        assert [n for n, _ in held] == list(range(len(held))) and [k for _, k in held] == sorted(k for _, k in held)
    assert numbered(df.limit(0), "y", F.desc("k")).count() == 0


def test_lines_of_drifting_files(spark, tmp_path):
    files = {
        "ncaabb03.csv": '"date","home","hscore","road","rscore","line","lineavg","neutral"\n11/1/2002,"Duke, NC",80,"UNC",70,-3.5,x,1\n11/2/2002,A,1,B,2,.,x,0\n',
        "ncaabb04.csv": "date, road,rscore ,home,line\n11/3/2003,Caf\xe9,60,Home,4\n\n",
        "ncaabb05.csv": "line,date,home,road,hscore\n2.5,2004-11-04, C ,D,50\n1,2004-11-05,E,F,51,extra\n",
        "ncaabb06.csv": "date,home,road\n1/1/2006,G,H\n",
        "ncaabb07.csv": "",
        "other.csv": "date,home,road,line\n1/1/2007,I,J,1\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="latin-1")
    got = sorted(tuple(r) for r in readers.load_lines(spark, f"file://{tmp_path}").collect())
    assert got == [
        (2004, "11/1/2002", "Duke, NC", "UNC", 80.0, 70.0, -3.5, 1), (2005, "11/3/2003", "Home", "Caf\xe9", None, 60.0, 4.0, 0),
        (2006, "2004-11-04", "C", "D", 50.0, None, 2.5, 0), (2006, "2004-11-05", "E", "F", 51.0, None, 1.0, 0),
    ]
    (tmp_path / "empty").mkdir()
    none = readers.load_lines(spark, str(tmp_path / "empty"))
    assert none.count() == 0 and none.dtypes == readers.load_lines(spark, str(tmp_path)).dtypes


def test_seasons_are_renewed_and_pruned(spark, tmp_path):
    path = str(tmp_path / "features")
    sinks.write_seasons(spark.createDataFrame([(2001, 1, 0.5), (2002, 1, 0.6), (2003, 1, 0.7)], "Season int, TeamID int, x double"), path)
    sinks.write_seasons(spark.createDataFrame([(2002, 2, 0.9)], "Season int, TeamID int, x double"), path)
    stored = spark.read.parquet(path)
    assert sorted((r["Season"], r["TeamID"], r["x"]) for r in stored.collect()) == [(2001, 1, 0.5), (2002, 2, 0.9), (2003, 1, 0.7)]
    plan = stored.where("Season = 2003")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Season" in plan and len(stored.where("Season = 2003").select("x").inputFiles()) >= 1


def test_validation_in_passing(spark):
    rows = [(1, 2001, 10, 60, 11, 50), (2, 2001, 10, 60, 12, 61), (3, 2002, 11, 70, 12, 60)]
    games = spark.createDataFrame(rows, "game_id int, Season int, WTeamID int, WScore int, LTeamID int, LScore int")
    passed, seen = validation.watched(games, [2001, 2002])
    assert passed.groupBy("WTeamID").count().count() == 2
    with pytest.warns(UserWarning, match="2002"):
        figures = validation.verdict(seen, few=2)
    report = {r["Season"]: r for r in validation.season_report(games).collect()}
    assert figures["games"] == sum(r["games"] for r in report.values()) and figures["bad_scores"] == sum(r["bad_scores"] for r in report.values()) == 1
    assert all(figures[f"season_{y}"] == r["games"] for y, r in report.items())
    odd = games.withColumn("LTeamID", F.when(F.col("game_id") < 3, F.col("LTeamID")))
    passed, seen = validation.watched(odd, [])
    passed.count()
    with pytest.raises(ValueError):
        validation.verdict(seen)
    with pytest.raises(Exception, match="lacks its season or a team"):
        validation.refuse_null_keys(odd).select("Season").collect()
    assert validation.refuse_null_keys(games).count() == 3


def test_pairs_as_json_parts(spark, tmp_path, probs):
    for name, pairs in (("all", probs.repartition(7)), ("one", probs.where("Season = 2023").drop("Season")), ("none", probs.limit(0))):
        path = str(tmp_path / name)
        sinks.write_pair_json(pairs, path)
        parts = sorted(p for p in os.listdir(path) if p.startswith("part"))
        joined = json.loads("".join((tmp_path / name / p).read_text() for p in parts))
        keys = [c for c in ("Season", "TeamID_a", "TeamID_b") if c in pairs.columns]
        want = {"_".join(str(r[c]) for c in keys): round(r["p"], 4) for r in pairs.where("TeamID_a < TeamID_b").collect()}
        assert joined == want and (name != "all" or len(parts) > 1)
        back = readers.pair_probabilities(spark, path).collect()
        assert {"_".join(str(r[c]) for c in keys): r["p"] for r in back} == want and len(back) == len(want)
    (tmp_path / "whole.json").write_text(sinks.pair_json(probs.where("Season = 2024")))
    back = readers.pair_probabilities(spark, str(tmp_path / "whole.json"))
    assert back.count() == 64 * 63 // 2 and back.first()["Season"] is None


def test_other_sources_and_sinks(spark, tmp_path, teams):
    (tmp_path / "MMasseyOrdinals.csv").write_text("Season,RankingDayNum,SystemName,TeamID,OrdinalRank\n2023,1,POM,5,2\n2023,1,SAG,5,3\n2023,1,XXX,5,4\n")
    assert sorted(r["SystemName"] for r in readers.rankings_of(spark, str(tmp_path / "MMasseyOrdinals.csv"), ["POM", "SAG"]).collect()) == ["POM", "SAG"]
    assert readers.ratings_from_csv(spark, "Team,1,Comp\nA,2,3.5\n").first()["Comp"] == 3.5 and readers.ratings_from_csv(spark, None) is None
    (tmp_path / "config.yaml").write_text("data: {raw: x}\nseasons: {}\nefficiency: {}\nmodel: {}\nbracket: {n: 2}\n")
    assert readers.load_config(str(tmp_path / "config.yaml")).bracket == {"n": 2}
    (tmp_path / "short.yaml").write_text("data: {}\n")
    with pytest.raises(ValueError, match="seasons"):
        readers.load_config(str(tmp_path / "short.yaml"))
    with pytest.raises(FileNotFoundError):
        readers.load_config(str(tmp_path / "absent.yaml"))
    (tmp_path / "bracket.csv").write_text("Region,Seed,TeamID,TeamName\n" + "".join(f"East,{k},{k},T{k}\n" for k in range(64)))
    assert readers.load_bracket(spark, str(tmp_path / "bracket.csv")).count() == 64
    with pytest.raises(ValueError, match="64"):
        readers.load_bracket(spark, str(tmp_path / "bracket.csv"), 32)
    (tmp_path / "odd.csv").write_text("Region,Seed\nEast,1\n")
    with pytest.raises(ValueError, match="TeamID"):
        readers.load_bracket(spark, str(tmp_path / "odd.csv"))
    adv = spark.createDataFrame([(1, 1, 0.9), (1, 6, 0.1), (2, 1, 0.5)], "TeamID long, round int, p double")
    sinks.write_csv(sinks.advancement_table(adv), str(tmp_path / "adv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "adv"))
    assert back.columns == ["TeamID", *(f"R{r}" for r in range(1, 7))] and [r["TeamID"] for r in back.collect()] == ["1", "2"]
    two = spark.createDataFrame([(1, "A", 1, "E"), (2, "B", 2, "W")], "TeamID long, name string, seed int, region string")
    assert json.loads(sinks.bracket_json(two, adv)) == {"1": {"name": "A", "seed": 1, "region": "E", "advancement": {"1": 0.9, "6": 0.1}}, "2": {"name": "B", "seed": 2, "region": "W", "advancement": {"1": 0.5}}}


def test_medians_and_sparse_columns(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 4.0, 2.0)], "k int, a double, b double")
    assert [r["a"] for r in fx.fill_medians(df, ["a"]).orderBy("k").collect()] == [1.0, 2.5, 4.0]
    assert fx.drop_sparse(df, ["a", "b"], 0.5).columns == ["k", "a"]


def test_stream_of_games(spark, tmp_path):
    from tipoff.sources.adapter import game_log
    from tipoff.streaming.season_totals import read_games, season_totals

    games = game_log(spark, "/root/testdata/sf0.001")
    games.repartition(3).write.parquet(str(tmp_path / "games"))
    stream = season_totals(read_games(spark, str(tmp_path / "games"), games.schema, 1))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, season_totals(games).collect()))
