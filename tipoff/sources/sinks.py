"""Sinks: features by season, advancement tables, JSON exports, models."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.operators.boosting import Boosted, Spec, Tree

ROUNDS = range(1, 7)


def write_seasons(df: DataFrame, path: str) -> None:
    """Parquet, a folder per season, which later filters prune; seasons that df holds are
    renewed in place, others stay (IO6)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("Season").parquet(path)


def advancement_table(adv: DataFrame) -> DataFrame:
    """(TeamID, R1..R6) from (TeamID, round, p), missing rounds 0, best first (IO11)."""
    wide = adv.groupBy("TeamID").pivot("round", list(ROUNDS)).agg(F.max("p"))
    return wide.select("TeamID", *(F.coalesce(F.col(str(r)), F.lit(0.0)).alias(f"R{r}") for r in ROUNDS)).orderBy(F.desc("R6"), "TeamID")


def write_csv(table: DataFrame, path: str) -> None:
    """A bracket-sized table as one file."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def pair_json(pairs: DataFrame) -> str:
    """`lo_hi: p` of every pair, p rounded half to even at four digits (IO12)."""
    low = pairs.where("TeamID_a < TeamID_b").select(F.concat_ws("_", "TeamID_a", "TeamID_b").alias("k"), F.bround("p", 4).alias("p"))
    held = low.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "p")))).alias("m")).select(F.to_json("m")).first()[0]
    return held or "{}"


def write_pair_json(pairs: DataFrame, path: str) -> None:
    """The same object as text parts that executors write, an entry a line in order of keys, so
    that the parts one after another are the object (IO12). Keys are `season_lo_hi` where pairs
    have a Season. No row comes to the driver but the first key."""
    parts = [c for c in ("Season", "TeamID_a", "TeamID_b") if c in pairs.columns]
    rows = pairs.where("TeamID_a < TeamID_b").select(F.struct(*parts).alias("k"), F.bround("p", 4).alias("p"))
    first = rows.agg(F.min("k").alias("k")).first()["k"]
    opening = F.when(F.to_json("k") == F.lit(None if first is None else _json_of(first)), "{").otherwise(",")
    entry = F.concat(opening, F.lit('"'), F.concat_ws("_", *(F.col(f"k.{c}").cast("string") for c in parts)), F.lit('":'), F.coalesce(F.col("p").cast("string"), F.lit("null")))
    lines = rows.select(F.lit(0).alias("end"), "k", entry.alias("value"))
    closing = pairs.sparkSession.range(1).select(F.lit(1).alias("end"), F.lit(None).cast(rows.schema["k"].dataType).alias("k"), F.lit("{}" if first is None else "}").alias("value"))
    n = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = lines.union(closing).repartitionByRange(n, "end", "k").sortWithinPartitions("end", "k")
    ordered.select("value").write.mode("overwrite").text(path)


def _json_of(row) -> str:
    return json.dumps(row.asDict(), separators=(",", ":"))


def bracket_json(teams: DataFrame, adv: DataFrame) -> str:
    """Per team of one bracket its name, seed, region and advancement by round."""
    rounds = adv.groupBy("TeamID").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("round").cast("string"), F.col("p"))))).alias("advancement"))
    rows = teams.join(rounds, "TeamID", "left").select("TeamID", F.struct("name", "seed", "region", "advancement").alias("v"))
    held = F.collect_list(F.struct(F.col("TeamID").cast("string").alias("k"), "v"))  # a bracket's
    in_order = F.array_sort(held, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    return rows.agg(F.to_json(F.map_from_entries(in_order))).first()[0]


def splice(html: str, data: str, name: str = "RAW") -> str:
    """Puts JSON in place of a page's `const NAME = ...;` (IO13)."""
    mark = f"const {name} = "
    at = html.index(mark) + len(mark)
    return html[:at] + data + html[html.index(";", at) :]


NODES = "model int, tree int, node int, feature int, cut int, null_left boolean, value double"


def save_model(spark: SparkSession, booster: Boosted, path: str, config: dict, metrics: dict) -> str:
    """The trees as Parquet, a row per node in use, and beside them a line of JSON: columns,
    bins, parameters, metrics and the config's hash (IO14, C2). Any file system of Spark's."""
    digest = hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()
    rows = [
        (m, t, n, int(tree.feature[n]), int(tree.cut[n]), bool(tree.null_left[n]), float(tree.value[n]))
        for m, trees in enumerate(booster.trees) for t, tree in enumerate(trees)
        for n in range(len(tree.feature)) if n == 0 or tree.feature[(n - 1) // 2] >= 0
    ]
    spark.createDataFrame(rows, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    about = {"config_md5": digest, "metrics": metrics, "columns": booster.columns, "edges": [e.tolist() for e in booster.edges], "specs": [vars(s) for s in booster.specs]}
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return digest


def load_model(spark: SparkSession, path: str) -> tuple[Boosted, dict]:
    """What `save_model` wrote: the models, and {config_md5, metrics}."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    specs = [Spec(**s) for s in about["specs"]]
    trees = [[Tree.grown(s.depth) for _ in range(s.trees)] for s in specs]
    for m, t, n, *values in spark.read.schema(NODES).parquet(f"{path}/trees").collect():  # a model's nodes
        for name, v in zip(("feature", "cut", "null_left", "value"), values):
            getattr(trees[m][t], name)[n] = v
    edges = [np.array(e, dtype=np.float64) for e in about["edges"]]
    return Boosted(about["columns"], edges, specs, trees), {k: about[k] for k in ("config_md5", "metrics")}


def advancement_text(table: DataFrame, names: dict[int, str]) -> str:
    """A printed table, a line per team (IO15)."""
    lines = [f"{'Team':<20}" + "".join(f"{f'R{r}':>8}" for r in ROUNDS)]
    for row in table.collect():  # a bracket's teams
        lines.append(f"{names.get(row['TeamID'], str(row['TeamID'])):<20}" + "".join(f"{100 * row[f'R{r}']:>7.1f}%" for r in ROUNDS))
    return "\n".join(lines)
