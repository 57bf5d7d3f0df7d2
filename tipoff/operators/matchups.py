"""Training pairs, metrics and models over team-season features."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff.functions.scalars import clip
from tipoff.operators import boosting


def pairs(games: DataFrame, features: DataFrame, columns: list[str], weight: float = 1.0) -> DataFrame:
    """Two mirrored rows per game: differences winner less loser with label 1, and back with
    label 0 (ML1). A game goes if either side has no features (J4)."""
    w = features.select("Season", F.col("TeamID").alias("WTeamID"), *(F.col(c).alias(f"w_{c}") for c in columns))
    l_ = features.select("Season", F.col("TeamID").alias("LTeamID"), *(F.col(c).alias(f"l_{c}") for c in columns))
    met = games.select("game_id", "Season", "WTeamID", "LTeamID").join(w, ["Season", "WTeamID"]).join(l_, ["Season", "LTeamID"])
    side = lambda a, b, y: F.struct(*((F.col(f"{a}_{c}") - F.col(f"{b}_{c}")).cast("double").alias(c) for c in columns), F.lit(y).cast("long").alias("label"))
    return met.select("game_id", "Season", F.lit(weight).alias("weight"), F.inline(F.array(side("w", "l", 1), side("l", "w", 0))))


def weighted_pairs(tourney: DataFrame, regular: DataFrame, features: DataFrame, top: DataFrame, columns: list[str], from_day: int = 90, weight: float = 0.25) -> DataFrame:
    """Tournament pairs with weight 1, and late regular games between two of their season's
    best with less (ML2)."""
    best = top.select("Season", "TeamID")
    late = regular.where(F.col("DayNum") >= from_day)
    for side in ("WTeamID", "LTeamID"):
        late = late.join(F.broadcast(best.withColumnRenamed("TeamID", side)), ["Season", side], "left_semi")
    return pairs(tourney, features, columns).unionByName(pairs(late, features, columns, weight))


def metrics(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """Log loss (clipped at 1e-15), Brier score and accuracy (halves go to even: 0) (ML6)."""
    p, y = clip("p", 1e-15, 1 - 1e-15), F.col("label")
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"),
        (-F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"),
        F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier"),
        F.avg((F.rint("p") == y).cast("double")).alias("accuracy"),
    )


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve by ranks. Scores are counted per value first; the running
    count over values is a prefix sum per range of values, so no task holds all rows."""
    values = scored.groupBy("p").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    cut = F.floor(F.col("p") * 256)
    cells = values.groupBy(cut.alias("cell")).agg(F.sum("n").alias("cn"))
    base = cells.select("cell", F.coalesce(F.sum("cn").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("cell").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.withColumn("cell", cut).join(F.broadcast(base), "cell").withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    rank_sum = F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2))
    n1, n = F.sum("pos"), F.sum("n")
    return ranked.agg(((rank_sum - n1 * (n1 + 1) / 2) / (n1 * (n - n1))).alias("auc"), n.alias("n"))


def fold(column: str = "game_id", folds: int = 5) -> F.Column:
    """Mirror rows of a game share a fold."""
    return F.pmod(F.xxhash64(column), F.lit(folds)).cast("int")


def out_of_fold(rows: DataFrame, columns: list[str], folds: int = 5, held_out: tuple[int, ...] | None = None, **options) -> DataFrame:
    """Every row (of the folds in `held_out`, if given) scored by a model that has not seen its
    game; the models of all folds grow together (ML3)."""
    specs = [boosting.Spec(k, **options) for k in (range(folds) if held_out is None else held_out)]
    _, scored = boosting.fit(rows.withColumn("fold", fold(folds=folds)), columns, specs, ["game_id", "Season"])
    return boosting.held_out_scores(scored, specs)


def platt(oof: DataFrame):
    """Logistic calibration of raw margins, on tournament rows (weight 1) (ML4). Rows equal in
    margin and label (games of the same teams) are one with their number as its weight, so that
    the rounds of the fit read team pairs, not games."""
    counted = oof.where("weight = 1").groupBy("raw", "label").agg(F.count("*").cast("double").alias("n"))
    rows = VectorAssembler(inputCols=["raw"], outputCol="raw_vec").transform(counted)
    return LogisticRegression(featuresCol="raw_vec", labelCol="label", weightCol="n", predictionCol="_y", rawPredictionCol="_r", probabilityCol="calibrated").fit(rows)


def calibrated(model, scored: DataFrame) -> DataFrame:
    out = model.transform(VectorAssembler(inputCols=["raw"], outputCol="raw_vec").transform(scored))
    return out.withColumn("p_calibrated", vector_to_array("calibrated")[1]).drop("raw_vec", "_y", "_r", "calibrated")


def leave_season_out(rows: DataFrame, columns: list[str], **options) -> DataFrame:
    """Rows of each season scored by a model of the others (ML5); the models of all seasons
    grow together."""
    seasons = [r["Season"] for r in rows.select("Season").distinct().orderBy("Season").collect()]
    specs = [boosting.Spec(s, **options) for s in seasons]
    _, scored = boosting.fit(rows.withColumn("fold", F.col("Season").cast("int")), columns, specs, ["game_id", "Season"])
    return boosting.held_out_scores(scored, specs)


def submission(ids: DataFrame, probs: DataFrame, women_from: int = 3000) -> DataFrame:
    """(ID, gender, Pred): an ID is Season_a_b; pairs without a score get one half, and all
    are kept within [0.01, 0.99] (S4, ML8, ML10)."""
    part = F.split("ID", "_")
    keyed = ids.select("ID", part[0].cast("long").alias("Season"), part[1].cast("long").alias("TeamID_a"), part[2].cast("long").alias("TeamID_b"))
    met = keyed.join(probs.select("Season", "TeamID_a", "TeamID_b", "p"), ["Season", "TeamID_a", "TeamID_b"], "left")
    return met.select("ID", F.when(F.col("TeamID_a") < women_from, "M").otherwise("W").alias("gender"), clip(F.coalesce("p", F.lit(0.5)), 0.01, 0.99).alias("Pred"))


def submission_check(sub: DataFrame) -> DataFrame:
    """One row of quality figures."""
    return sub.agg(
        F.count("*").alias("rows"), F.count_if(F.col("Pred").isNull()).alias("nulls"), F.avg("Pred").alias("mean"), F.stddev_samp("Pred").alias("std"),
        F.min("Pred").alias("low"), F.max("Pred").alias("high"), F.avg((F.col("Pred") == 0.5).cast("double")).alias("default_share"),
    )
