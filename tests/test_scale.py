"""What a task holds and what moves must not grow with the games."""

import pytest
from pyspark.sql import functions as F

from tipoff.operators import features as fx
from tipoff.operators import ratings as rt
from tipoff.operators.games import team_games
from tipoff.sources import adapter as ad


def test_game_log_is_dealt_by_its_size(spark, monkeypatch):
    whole = sorted(map(tuple, ad.game_log(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(ad, "TASK_LINES", 200)  # about 6,000 lines
    dealt = ad.game_log(spark, "/root/testdata/sf0.001")
    rows = dealt.withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in rows}) > 20  # the session has 8 tasks
    assert sorted(tuple(r)[:-1] for r in rows) == whole and len(whole) > 2000


def test_last_games_are_found_by_days(spark):
    rows = [(2000 + k % 2, 1 + k % 3, 7 * k % 11, k, 50 + k % 9, 50 + k % 7, k % 2) for k in range(90)]
    tg = spark.createDataFrame(rows, "Season long, TeamID long, DayNum long, game_id long, pts long, opp_pts long, win long")
    found = {}
    for r in fx.last_games(tg, 4).collect():
        found.setdefault((r["Season"], r["TeamID"]), []).append((r["pts"], r["opp_pts"], r["win"]))
    for key in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: (-r[2], -r[3]))[:4]
        assert sorted(found[key]) == sorted(r[4:] for r in own)


def test_season_features_move_no_games(spark):
    rows = team_games(ad.game_log(spark, "/root/testdata/sf0.001"))
    top = rows.select("Season", "TeamID").distinct().where("TeamID % 3 = 0")
    out = fx.season_features(rows, top)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan  # which sorts all games of a task beyond 128 teams
    late = {(r["Season"], r["TeamID"]): r["late_sos"] for r in fx.late_season(rows, top).collect()}
    form = {(r["Season"], r["TeamID"]): r for r in fx.form(rows).collect()}
    got = out.collect()
    assert len(got) == len(form) and late
    for r in got:
        key = (r["Season"], r["TeamID"])
        assert r["late_sos"] == late.get(key)
        assert all(r[c] == pytest.approx(form[key][c]) for c in ("win_pct_last10", "avg_mov_last10", "scoring_trend", "season_win_pct", "season_avg_mov"))


def test_rounds_of_ratings_read_kept_meetings(spark, monkeypatch):
    rows = team_games(ad.game_log(spark, "/root/testdata/sf0.001"))
    plans, step = [], rt.step

    def seen(*given):
        plans.append(step(*given)._jdf.queryExecution().executedPlan().toString())
        return step(*given)

    monkeypatch.setattr(rt, "step", seen)
    out = {(r["Season"], r["TeamID"]): r["adj_em"] for r in rt.adjusted_efficiency(rows, 2).collect()}
    assert len(plans) == 2 and "InMemoryRelation" in plans[0]  # meetings are kept, dealt by team
    assert "l_oe" in plans[0] and plans[0].count("BroadcastExchange") == 2  # ratings, and once for all rounds the league
    monkeypatch.setattr(rt, "SMALL_ROWS", 0)
    for r in rt.adjusted_efficiency(rows, 2).collect():
        assert out.pop((r["Season"], r["TeamID"])) == pytest.approx(r["adj_em"])
    assert not out
