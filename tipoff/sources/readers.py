"""Sources: explicit schemas, optional tables, yearly line files, cached downloads, config."""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.functions.scalars import numeric
from tipoff.sources.validation import require_columns

_BOX = ("FGM", "FGA", "FGM3", "FGA3", "FTM", "FTA", "OR", "DR", "Ast", "TO", "Stl", "Blk", "PF")
_GAME = "Season int, DayNum int, WTeamID int, WScore int, LTeamID int, LScore int, WLoc string, NumOT int, " + ", ".join(f"{s}{b} int" for s in "WL" for b in _BOX)

#: File stem and schema of each table; the leading letter of men's and women's files comes
#: before it.
TABLES = {
    "regular_season": ("RegularSeasonDetailedResults", _GAME),
    "tourney": ("NCAATourneyDetailedResults", _GAME),
    "teams": ("Teams", "TeamID int, TeamName string"),
    "seeds": ("NCAATourneySeeds", "Season int, Seed string, TeamID int"),
    "rankings": ("MasseyOrdinals", "Season int, RankingDayNum int, SystemName string, TeamID int, OrdinalRank int"),
    "conferences": ("Conferences", "ConfAbbrev string, Description string"),
    "team_conferences": ("TeamConferences", "Season int, TeamID int, ConfAbbrev string"),
}


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with a header and a known schema; malformed rows fail (IO1, IO4). Filters
    and column choices reach the scan."""
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).option("mode", "FAILFAST").csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _matches(spark: SparkSession, pattern: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop))


def load_tables(spark: SparkSession, folder: str, letter: str = "M") -> dict[str, DataFrame]:
    """All tables of a folder; a missing file is an error (IO1)."""
    out = {}
    for name, (stem, schema) in TABLES.items():
        path = f"{folder}/{letter}{stem}.csv"
        if not _exists(spark, path):
            raise FileNotFoundError(path)
        out[name] = read_csv(spark, path, schema)
    return out


def load_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An empty table where the file is missing; blanks around header names are cut (IO2).
    Columns that the schema names get its types (text that is no such value: null); others
    stay text."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.option("header", True).csv(path)
    types = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
    named = raw.toDF(*(c.strip() for c in raw.columns))
    return named.select(*((F.col(f"`{c}`").try_cast(types[c]) if c in types else F.col(f"`{c}`")).alias(c) for c in named.columns))


def rankings_of(spark: SparkSession, path: str, systems: list[str]) -> DataFrame:
    """Only the systems asked for; Spark reads the file in splits (IO3)."""
    return read_csv(spark, path, TABLES["rankings"][1]).where(F.col("SystemName").isin(systems))


NEEDED = ("date", "home", "road", "line")
LINE_COLUMNS = ("date", "home", "hscore", "road", "rscore", "line", "neutral")


def clean_lines(raw: DataFrame, season) -> DataFrame:
    """Quotes off names and columns, numbers or null, neutral 0 where absent, rows without a
    line gone (IO5, S5, S8)."""
    raw = raw.toDF(*(c.strip().strip('"') for c in raw.columns))
    require_columns(raw, NEEDED, "lines")
    for c in ("hscore", "rscore", "neutral"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    name = lambda c: F.btrim(F.trim(F.col(c)), F.lit('"'))
    return raw.select(
        season.cast("int").alias("season"), F.col("date"), name("home").alias("home"), name("road").alias("road"),
        numeric("hscore").alias("hscore"), numeric("rscore").alias("rscore"), numeric("line").alias("line"),
        F.coalesce(numeric("neutral"), F.lit(0.0)).cast("int").alias("neutral"),
    ).where("line is not null")


def season_of(path) -> F.Column:
    """ncaabbYY.csv holds the season that ends in the year after (S3)."""
    return F.nullif(F.regexp_extract(path, r"ncaabb(\d{2})\.csv", 1), F.lit("")).cast("int") + 2001


def load_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All yearly line files of a folder on any file system, whose columns drift (IO5).

    One read brings every line with its file. A line that names all needed columns is its
    file's header; a table of (file, position of each column), a row a file, tells where the
    other lines have their values. Files without such a header are left out; a folder without
    files gives no rows.
    """
    pattern = f"{folder}/ncaabb[0-9][0-9].csv"
    if not _matches(spark, pattern):
        empty = "season int, date string, home string, road string, hscore double, rscore double, line double, neutral int"
        return spark.createDataFrame([], empty)
    whole = spark.read.schema("text string").option("sep", "\x01").option("quote", "").option("encoding", "ISO-8859-1").csv(pattern)
    rows = whole.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"), "text").where("text is not null")
    names = F.transform(F.split("text", ","), lambda x: F.trim(F.btrim(F.trim(x), F.lit('"'))))
    is_header = F.size(F.array_intersect(names, F.array(*map(F.lit, NEEDED)))) == len(NEEDED)
    at = lambda c: F.nullif(F.array_position("names", c).cast("int"), F.lit(0)) - 1
    headers = rows.where(is_header).groupBy("file").agg(F.first(names).alias("names"), F.first(F.size(names)).alias("width"))
    places = headers.select("file", "width", *(at(c).alias(f"at_{c}") for c in LINE_COLUMNS))
    widest = places.agg(F.max("width")).first()[0] or 1
    cells = F.from_csv("text", F.lit(", ".join(f"c{k} string" for k in range(widest))), {"ignoreLeadingWhiteSpace": "true"})
    data = rows.where(~is_header).join(places, "file").select("file_name", *(f"at_{c}" for c in LINE_COLUMNS), cells.alias("cells"))
    listed = F.array(*(F.col(f"cells.c{k}") for k in range(widest)))
    value = lambda c: F.when(F.col(f"at_{c}").isNotNull(), F.get(listed, F.col(f"at_{c}")))
    raw = data.select("file_name", *(value(c).alias(c) for c in LINE_COLUMNS))
    return clean_lines(raw, season_of(F.col("file_name")))


def parsed_date(column) -> F.Column:
    """Dates as they come: month first, or ISO."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.try_to_timestamp(c, F.lit("M/d/yyyy")), F.try_to_timestamp(c, F.lit("M/d/yy")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))


def cached(fetch, path: str, ttl_hours: float = 24.0) -> str | None:
    """Text from a file younger than `ttl_hours`, else from fetch(), then kept; None if that
    fails (IO7, IO8, D2). For small reference tables, on the driver."""
    if os.path.exists(path) and time.time() - os.path.getmtime(path) < ttl_hours * 3600:
        with open(path, encoding="utf-8") as f:
            return f.read()
    try:
        text = fetch()
    except Exception:  # noqa: BLE001  any failure of a download means "not available"
        return None
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return text


def ratings_from_json(spark: SparkSession, text: str | None) -> DataFrame | None:
    return None if text is None else spark.createDataFrame(json.loads(text))


def ratings_from_csv(spark: SparkSession, text: str | None) -> DataFrame | None:
    return None if text is None else spark.read.option("header", True).option("inferSchema", True).csv(spark.sparkContext.parallelize(text.splitlines(), 1))


@dataclass(frozen=True)
class Config:
    """Settings by section; unknown sections are refused."""

    data: dict = field(default_factory=dict)
    seasons: dict = field(default_factory=dict)
    efficiency: dict = field(default_factory=dict)
    matching: dict = field(default_factory=dict)
    model: dict = field(default_factory=dict)
    massey: dict = field(default_factory=dict)
    bracket: dict = field(default_factory=dict)


def load_config(path: str, required: tuple[str, ...] = ("data", "seasons", "efficiency", "model", "bracket")) -> Config:
    """A YAML file with these sections (IO9)."""
    import yaml

    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path, encoding="utf-8") as f:
        held = yaml.safe_load(f) or {}
    missing = [s for s in required if s not in held]
    if missing:
        raise ValueError(f"config lacks sections: {missing}")
    return Config(**held)


def load_bracket(spark: SparkSession, path: str, teams: int = 64) -> DataFrame:
    """Region, Seed, TeamID, TeamName of exactly so many teams (IO10)."""
    raw = spark.read.option("header", True).csv(path)
    require_columns(raw, ("Region", "Seed", "TeamID", "TeamName"), "bracket")
    out = read_csv(spark, path, "Region string, Seed int, TeamID int, TeamName string")
    n = out.count()
    if n != teams:
        raise ValueError(f"a bracket has {teams} teams, not {n}")
    return out


def pair_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """(TeamID_a, TeamID_b, p) from a JSON object of `lo_hi: p`, with Season first where keys
    are `season_lo_hi` (JS1): a file of one line, or parts with an entry a line."""
    body = F.btrim("value", F.lit(" ,"))
    whole = F.concat(F.when(body.startswith("{"), "").otherwise("{"), body, F.when(body.endswith("}"), "").otherwise("}"))
    entries = spark.read.text(path).where("trim(value) not in ('', '{', '}')").select(F.explode(F.from_json(whole, "map<string,double>")).alias("k", "p"))
    ids = F.split("k", "_")
    n = F.size(ids)
    out = entries.select(F.when(n == 3, ids[0]).cast("long").alias("Season"), F.get(ids, n - 2).cast("long").alias("TeamID_a"), F.get(ids, n - 1).cast("long").alias("TeamID_b"), "p")
    return out
