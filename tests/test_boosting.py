"""Boosting of many models at once: cuts against every cut, models against one another."""

import dataclasses
import math

import numpy as np
import pytest

from tipoff.operators import boosting, matchups, tuning
from tipoff.operators.boosting import Spec
from tipoff.plans import tournament
from tipoff.sources import sinks


def table(spark, n=600, seed=1, partitions=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        x = [float(v) if rng.random() > 0.1 else None for v in rng.normal(size=4)]
        margin = 1.5 * (x[0] or -1) + (x[1] or 0) ** 2 - 1
        rows.append((k, int(rng.random() < 1 / (1 + math.exp(-margin))), 1.0 if k % 5 else 0.25, k % 4, *x))
    return spark.createDataFrame(rows, "game_id long, label long, weight double, part int, a double, b double, c double, d double").repartition(partitions), rows


COLUMNS = ["a", "b", "c", "d"]


def loss(rows):
    return -sum(math.log(r["p"] if r["label"] else 1 - r["p"]) for r in rows) / len(rows)


def test_first_cut_is_the_best_of_all(spark):
    df, rows = table(spark, 60)  # fewer values than bins: every cut is there
    booster, _ = boosting.fit(df, COLUMNS, [Spec(None, trees=1, depth=1, rows=1.0, columns=1.0)], ["game_id"], fold="part")
    best = 0.0
    for f in range(4):
        xs = sorted({r[4 + f] for r in rows if r[4 + f] is not None})
        for cut in xs[:-1]:
            for nulls_left in (True, False):
                side = [0.0, 0.0, 0.0, 0.0]
                for r in rows:
                    left = nulls_left if r[4 + f] is None else r[4 + f] <= cut
                    side[0 if left else 2] += r[2] * (0.5 - r[1])
                    side[1 if left else 3] += r[2] * 0.25
                gl, hl, gr, hr = side
                if min(hl, hr) >= 1:
                    best = max(best, gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1))
    tree = booster.trees[0][0]
    g = {k: -tree.value[k] / 0.05 for k in (0, 1, 2)}  # g / (h + 1)
    f, cut = tree.feature[0], booster.edges[tree.feature[0]][tree.cut[0] - 1]
    h = [0.0, 0.0]
    for r in rows:
        x = r[4 + f]
        h[int(not (tree.null_left[0] if x is None else x <= cut))] += r[2] * 0.25
    gain = g[1] ** 2 * (h[0] + 1) + g[2] ** 2 * (h[1] + 1) - g[0] ** 2 * (sum(h) + 1)
    assert best > 1 and gain == pytest.approx(best)


def test_learns_and_is_the_same_however_rows_are_dealt(spark, monkeypatch):
    df, _ = table(spark)
    specs = [Spec(k, trees=12, depth=3, rate=0.25) for k in range(4)]
    one, scored = boosting.fit(df, COLUMNS, specs, ["game_id"], fold="part")
    monkeypatch.setattr(boosting, "PART_ROWS", 100)
    monkeypatch.setattr(boosting, "HELD_BYTES", 1 << 16)
    monkeypatch.setattr(boosting, "CUT", 5)
    many, again = boosting.fit(df, COLUMNS, specs, ["game_id"], fold="part")
    assert len(one.trees) == 4 and all(len(t) == 12 for t in one.trees)
    for a, b in zip(sum(one.trees, []), sum(many.trees, [])):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value)
    out = boosting.held_out_scores(scored, specs).collect()
    assert len(out) == 600 and loss(out) < 0.56  # 0.69 without learning
    same = {r["game_id"]: r["raw"] for r in boosting.held_out_scores(again, specs).collect()}
    assert all(r["raw"] == pytest.approx(same[r["game_id"]]) for r in out)
    fresh = boosting.scores(df, one, 2).where("part = 2").collect()
    by = {r["game_id"]: r["raw"] for r in out}
    assert fresh and all(r["raw"] == pytest.approx(by[r["game_id"]]) for r in fresh)


def test_many_games_of_few_pairs_take_few_jobs(spark, monkeypatch):
    df, _ = table(spark, 300)
    copies = df.crossJoin(spark.range(6).withColumnRenamed("id", "copy")).selectExpr("game_id * 6 + copy as game_id", "if(copy = 5, 1 - label, label) as label", "weight", "cast((game_id + copy) % 4 as int) as part", *COLUMNS)
    specs = [Spec(k, trees=30, depth=2, rate=0.2) for k in range(4)] + [Spec(None, trees=7, depth=1, rows=0.6, seed=5)]
    spark.sparkContext.setJobGroup("few", "")
    few, scored = boosting.fit(copies, COLUMNS, specs, ["game_id"], fold="part")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs < 30  # neither a level nor a tree is a job
    monkeypatch.setattr(boosting, "PART_ROWS", 100)  # 300 different rows are many then
    many, again = boosting.fit(copies, COLUMNS, specs, ["game_id"], fold="part")
    assert [len(t) for t in few.trees] == [30] * 4 + [7]
    for a, b in zip(sum(few.trees, []), sum(many.trees, [])):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value)
    left, right = ({r["game_id"]: r["margins"] for r in boosting.unpacked(x, 5).collect()} for x in (scored, again))
    assert len(left) == 1800 and left.keys() == right.keys() and all(np.allclose(left[k], right[k]) for k in left)


def test_more_trees_of_few_rows_take_no_more_jobs(spark):
    df, _ = table(spark, 120)
    taken = {}
    for trees in (5, 3 * boosting.CUT):
        spark.sparkContext.setJobGroup(f"trees{trees}", "")
        booster, _ = boosting.fit(df, COLUMNS, [Spec(k, trees=trees, depth=2) for k in range(2)], ["game_id"], fold="part")
        taken[trees] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees{trees}"))
        assert [len(t) for t in booster.trees] == [trees] * 2
    spark.sparkContext.setJobGroup("rest", "")
    assert len(set(taken.values())) == 1


def test_calibration_reads_pairs_not_games(spark):
    rows = [(k % 7 / 3 - 1, int(k % 3 > 0), 1.0) for k in range(210)] + [(9.0, 0, 0.25)] * 10
    oof = spark.createDataFrame(rows, "raw double, label long, weight double")
    model = matchups.platt(oof)
    assert model.summary.predictions.count() == 14  # of 210 games
    a, b = model.coefficients[0], model.intercept
    p = [1 / (1 + math.exp(-a * r[0] - b)) for r in rows[:210]]
    assert sum(p) == pytest.approx(140, abs=1e-3) and sum(x * r[0] for x, r in zip(p, rows)) == pytest.approx(sum(r[0] * r[1] for r in rows[:210]), abs=1e-3)


def test_held_out_labels_are_not_seen(spark):
    df, rows = table(spark, 300)
    turned = spark.createDataFrame([(r[0], 1 - r[1] if r[3] == 0 else r[1], *r[2:]) for r in rows], df.schema)
    specs = [Spec(0, trees=5, rows=1.0), Spec(1, trees=5, rows=1.0)]
    a, _ = boosting.fit(df, COLUMNS, specs, ["game_id"], fold="part")
    b, _ = boosting.fit(turned, COLUMNS, specs, ["game_id"], fold="part")
    assert all((x.feature == y.feature).all() and np.allclose(x.value, y.value) for x, y in zip(a.trees[0], b.trees[0]))
    assert any((x.value != y.value).any() for x, y in zip(a.trees[1], b.trees[1]))


def test_models_of_different_sizes(spark):
    df, _ = table(spark, 200)
    specs = [Spec(None, trees=3, depth=1), Spec(None, trees=6, depth=5, columns=0.5), Spec(1, trees=0)]
    booster, scored = boosting.fit(df, COLUMNS, specs, ["game_id"], fold="part")
    assert [len(t) for t in booster.trees] == [3, 6, 0] and [len(t.feature) for t in (booster.trees[0][0], booster.trees[1][0])] == [3, 63]
    assert {r["margins"][2] for r in boosting.unpacked(scored, 3).collect()} == {0.0}
    assert all(len({int(f) for f in t.feature if f >= 0}) <= 2 for t in booster.trees[1])


def test_empty_and_unlabelled(spark):
    df, _ = table(spark, 60)
    booster, scored = boosting.fit(df.limit(0), COLUMNS, [Spec(0, trees=3)], ["game_id"], fold="part")
    assert booster.trees == [[]] and scored.count() == 0
    half = df.selectExpr("game_id", "if(game_id % 2 = 0, label, null) as label", "weight", "part", *COLUMNS)
    a, scored = boosting.fit(half, COLUMNS, [Spec(None, trees=3, rows=1.0)], ["game_id"], fold="part")
    assert scored.count() == 60
    b, _ = boosting.fit(half.where("label is not null"), COLUMNS, [Spec(None, trees=3, rows=1.0)], ["game_id"], fold="part")
    assert a.trees[0][0].value[0] == pytest.approx(b.trees[0][0].value[0])


def test_saved_models_score_alike(spark, tmp_path):
    df, _ = table(spark, 150)
    booster, _ = boosting.fit(df, COLUMNS, [Spec(None, trees=4), Spec(1, trees=2, depth=2)], ["game_id"], fold="part")
    digest = sinks.save_model(spark, booster, f"{tmp_path}/model", {"b": 1, "a": [2]}, {"log_loss": 0.5})
    again, about = sinks.load_model(spark, f"{tmp_path}/model")
    assert about == {"config_md5": digest, "metrics": {"log_loss": 0.5}} and digest == sinks.save_model(spark, booster, f"{tmp_path}/model", {"a": [2], "b": 1}, {})
    for m in (0, 1):
        a, b = (sorted((r["game_id"], r["p"]) for r in boosting.scores(df, x, m).collect()) for x in (booster, again))
        assert a == b


def bowl(params):
    """Least (0) at one point; depth matters most."""
    return 3 * ((params["depth"] - 4) / 6) ** 2 + (math.log(params["rate"] / 0.05) / 3) ** 2 + ((params["trees"] - 350) / 400) ** 2 + ((params["rows"] - 0.9) / 0.4) ** 2 + 0.1 * (params["columns"] - 0.7) ** 2


def test_parzen_search_beats_random_search():
    found, drawn = [], []
    for seed in range(12):
        tried = tuning.search(lambda ps: [bowl(p) for p in ps], tuning.SPACE, trials=50, batch=5, seed=seed)
        assert len(tried) == 50 and [t.loss for t in tried] == sorted(t.loss for t in tried)
        assert all(r.low <= t.params[k] <= r.high for t in tried for k, r in tuning.SPACE.items())
        found.append(tried[0].loss)
        drawn.append(tuning.search(lambda ps: [bowl(p) for p in ps], tuning.SPACE, trials=50, batch=5, startup=50, seed=seed)[0].loss)
    assert sum(found) < 0.7 * sum(drawn) and sum(a < b for a, b in zip(found, drawn)) >= 9


def test_search_repeats_itself_and_bears_failures():
    odd = lambda ps: [math.nan if p["depth"] > 6 else bowl(p) for p in ps]
    a, b = (tuning.search(odd, tuning.SPACE, trials=20, batch=4, seed=3) for _ in range(2))
    assert [t.params for t in a] == [t.params for t in b] and math.isfinite(a[0].loss)
    assert {tuning.SPACE["depth"].value(u / 100) for u in range(101)} == set(range(2, 9))


def test_tuning_by_season(spark):
    df, _ = table(spark, 240)
    rows = df.withColumn("Season", df["part"] + 2000)
    space = {**tuning.SPACE, "trees": tuning.Range(2, 6, whole=True), "depth": tuning.Range(1, 3, whole=True)}
    tried = tuning.tune(rows, COLUMNS, space, trials=4, batch=2, startup=2)
    assert len(tried) == 4 and 0 < tried[0].loss <= tried[-1].loss < 0.7
    best = tried[0].params
    scored = boosting.held_out_scores(boosting.fit(df.withColumnRenamed("part", "fold"), COLUMNS, specs := [Spec(k, **best) for k in range(4)], ["game_id"])[1], specs).collect()
    assert loss(scored) == pytest.approx(tried[0].loss)


def test_tuning_puts_rows_into_bins_once(spark, monkeypatch):
    df, _ = table(spark, 80)
    calls, edges_of = [], boosting.edges_of
    monkeypatch.setattr(boosting, "edges_of", lambda *a: calls.append(1) or edges_of(*a))
    space = {**tuning.SPACE, "trees": tuning.Range(1, 2, whole=True), "depth": tuning.Range(1, 2, whole=True)}
    assert len(tuning.tune(df.withColumn("Season", df["part"]), COLUMNS, space, trials=3, batch=1, startup=3)) == 3
    assert len(calls) == 1  # not one a batch


def test_tuning_query_is_the_published_search(spark, monkeypatch):
    df, _ = table(spark, 80)
    rows = df.selectExpr("game_id", "part + 2000 as Season", "label", "weight", *(f"{COLUMNS[k % 4]} * {k + 1} as {c}" for k, c in enumerate(tournament.FEATURES)))
    monkeypatch.setattr(tournament, "training", lambda spark, sf: rows)
    monkeypatch.setattr(tuning, "held_out_losses", lambda made, folds, options: [bowl(o) for o in options])
    out = tournament.tuning_query(spark, "").orderBy("rank").collect()
    assert sorted(r["trial"] for r in out) == list(range(50)) and [r["rank"] for r in out] == list(range(1, 51))
    assert all(100 <= r["trees"] <= 500 and 2 <= r["depth"] <= 8 and 0.01 <= r["rate"] <= 0.3 for r in out)
    assert max(r["trees"] for r in out) > 400 and max(r["depth"] for r in out) == 8
    assert [r["log_loss"] for r in out] == sorted(r["log_loss"] for r in out)


def test_losses_of_models_grown_apart(spark, monkeypatch):
    df, _ = table(spark, 300)
    copies = df.crossJoin(spark.range(3).withColumnRenamed("id", "copy")).selectExpr("game_id * 3 + copy as game_id", "if(game_id % 11 = 0, null, label) as label", "if(game_id % 7 = 0, null, weight) as weight", "cast(nullif(part, 3) as int) as fold", *COLUMNS)
    made = boosting.prepare(copies, COLUMNS, ["game_id"])
    options = [{"trees": 3, "depth": 1, "rate": 0.3}, {"trees": 30, "depth": 6, "rate": 0.1, "rows": 0.6, "columns": 0.6}, {"trees": 0}]
    spark.sparkContext.setJobGroup("apart", "")
    apart = tuning.held_out_losses(made, [0, 1, 2, 9], options)  # no row has fold 9
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("apart"))
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs <= 3  # whatever the number of trees
    assert boosting.held_out_losses(dataclasses.replace(made, different=10), [Spec(0)]) is None  # 90 rows of each
    monkeypatch.setattr(boosting, "HELD_BYTES", 1000)  # rows don't fit into a task then
    assert boosting.held_out_losses(made, [Spec(0)]) is None
    assert apart == pytest.approx(tuning.held_out_losses(made, [0, 1, 2, 9], options))
    assert apart[2] == pytest.approx(math.log(2)) and len(set(apart)) == 3
    assert math.isnan(tuning.held_out_losses(made, [9], [{"trees": 1}])[0])
    made.release()


def test_cuts_that_part_rows_alike_are_taken_in_order(spark, monkeypatch):
    df, _ = table(spark, 400)
    alike = df.selectExpr("game_id", "label", "weight", "part", "a", "b", "-b as c", "3 * a as d", "-a as e", "b * b * b as f")
    columns = ["a", "b", "c", "d", "e", "f"]
    specs = [Spec(k, trees=10, depth=6, rate=0.2, columns=1.0) for k in range(4)]
    few, _ = boosting.fit(alike, columns, specs, ["game_id"], fold="part")
    monkeypatch.setattr(boosting, "PART_ROWS", 100)
    many, _ = boosting.fit(alike.repartition(5), columns, specs, ["game_id"], fold="part")
    for a, b in zip(sum(few.trees, []), sum(many.trees, [])):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value)
    assert not {3, 5} & {int(f) for t in sum(few.trees, []) for f in t.feature}  # as good as the first two


def test_cuts_against_plain_sums():
    rng = np.random.default_rng(4)
    sums = rng.normal(size=(600, 2, boosting.BINS + 1))
    sums[:, 1] = np.abs(sums[:, 1]) * (rng.random((600, boosting.BINS + 1)) < 0.3)
    sums[:, 0] *= sums[:, 1] > 0
    sums[::2, :, 0] = 0
    found = boosting.best_cuts(sums, 1.0, 2.0)
    for k, (g, h) in enumerate(sums):
        best = (0.0, 0, False)
        for nulls_left in (False, True):
            for cut in range(1, boosting.BINS):
                a, b = (x[1 : cut + 1].sum() + nulls_left * x[0] for x in (g, h))
                c, d = g.sum() - a, h.sum() - b
                gain = a * a / (b + 1) + c * c / (d + 1) - g.sum() ** 2 / (h.sum() + 1)
                if b >= 2 and d >= 2 and gain > best[0] + 1e-9:
                    best = (gain, cut, nulls_left)
        assert found["gain"][k] == pytest.approx(best[0]) and (found["cut"][k], found["null_left"][k]) == best[1:]
