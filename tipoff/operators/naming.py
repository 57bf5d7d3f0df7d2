"""Names of other sources to team ids: overrides, then exact, then fuzzy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.functions.names import indel_score, sorted_tokens
from tipoff.functions.scalars import clean_name

#: Lengths of grams, those with the fewest names first.
GRAMS = (3, 2, 1)


def lookup(pairs: DataFrame, name: str = "name", key: str = "TeamID", order: str = "row") -> DataFrame:
    """One id per name, the last row's where a name repeats."""
    return pairs.where(F.col(name).isNotNull()).groupBy(clean_name(name).alias("clean")).agg(F.max_by(key, order).alias(key))


def exact(names: DataFrame, known: DataFrame) -> DataFrame:
    return names.select("name").distinct().withColumn("clean", clean_name("name")).join(known, "clean").select("name", "TeamID", F.lit("exact").alias("how"))


def _common_length(a: Column, b: Column, least: float) -> Column:
    """The least common subsequence with which names of lengths a and b score `least`; a hair
    less where the product is whole, so that rounding loses no pair."""
    return F.ceil((a + b) * F.lit(least / 200) - F.lit(1e-9))


def _shared_grams(a: Column, b: Column, least: float, q: int) -> Column:
    """Grams of length q that two such names share at least: of the common subsequence's, each
    character that it leaves out of either name breaks q - 1 at most."""
    common = _common_length(a, b, least)
    return common - (q - 1) - (q - 1) * (a + b - 2 * common)


def _grams(keys: DataFrame) -> DataFrame:
    """key, n, q, gram, at: every gram of every length, repeats numbered; at is the place of a
    gram that the key holds once, and null of others."""
    q = F.explode(F.array(*(F.lit(x) for x in GRAMS)))
    starts = F.sequence(F.lit(1), F.col("n") - F.col("q") + 1)
    all_ = F.transform(starts, lambda i: F.substring(F.col("key"), i, F.col("q")))
    sorted_ = F.array_sort(all_)
    # A gram's number: its place in the sorted list less the place of the first like it.
    number = lambda g, i: (i + 1 - F.array_position(sorted_, g)).cast("string")
    once = lambda g: F.size(F.filter(sorted_, lambda x: x == g)) == 1
    numbered = F.transform(sorted_, lambda g, i: F.struct(F.concat(g, F.lit("\x00"), number(g, i)).alias("gram"), F.when(once(g), F.array_position(all_, g)).cast("int").alias("at")))
    rows = keys.select("key", "n", q.alias("q")).where(F.col("n") >= F.col("q"))
    return rows.select("key", "n", "q", F.explode(numbered).alias("g")).select("key", "n", "q", "g.gram", "g.at")


def _prefixes(grams: DataFrame, counts: DataFrame, least: float, own: str, other: str) -> DataFrame:
    """key and, for each length of a partner, the rarest of its grams: so many that a partner
    that shares enough grams shares one of these."""
    ranked = grams.join(counts, ["q", "gram"], "left").groupBy("key", "n", "q").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram", "at"))).alias("grams"))  # of one name
    low, high = least / (200 - least), (200 - least) / least
    partners = F.sequence(F.greatest(F.lit(1), F.ceil(F.col("n") * low - 1e-9)).cast("int"), F.floor(F.col("n") * high + 1e-9).cast("int"))
    rows = ranked.select("key", "n", "q", "grams", F.explode(partners).alias("m"))
    wanted = None  # the first length of gram that is sure to be shared
    for q in reversed(GRAMS):
        sure = _shared_grams(F.col("n"), F.col("m"), least, q) >= 1
        wanted = F.lit(q) if wanted is None else F.when(sure, q).otherwise(wanted)
    shared = None
    for q in GRAMS:
        each = _shared_grams(F.col("n"), F.col("m"), least, q)
        shared = F.when(F.col("q") == q, each).otherwise(shared) if shared is not None else F.when(F.col("q") == q, each)
    rows = rows.where(F.col("q") == wanted).withColumn("take", F.size("grams") - shared + 1).where("take > 0")
    first = F.slice("grams", F.lit(1), F.col("take").cast("int"))
    return rows.select(F.col("key").alias(f"key_{own}"), F.col("n").alias(f"n_{own}"), F.col("m").alias(f"n_{other}"), "q", F.explode(first).alias("g")).select(f"key_{own}", f"n_{own}", f"n_{other}", "q", "g.gram", F.col("g.at").alias(f"at_{own}"))


def similar(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(key_a, key_b, score): every pair of keys of the two sides that scores `least` or more
    (over 0). Keys are distinct strings with sorted tokens, in a column key.

    Each side gives, for every length that a partner can have, its rarest grams; pairs that meet
    on one are scored. No pair that can reach `least` is left out, and sides are never crossed.
    """
    if not 0 < least <= 100:
        raise ValueError("least has to be over 0, and 100 at most")
    a, b = (_grams(x.select("key", F.length("key").alias("n"))) for x in (left, right))
    counts = b.groupBy("q", "gram").agg(F.count("*").alias("held"))
    met = _prefixes(a, counts, least, "a", "b").join(_prefixes(b, counts, least, "b", "a"), ["n_a", "n_b", "q", "gram"])
    # A gram of the common subsequence stands behind what either name has left out before it.
    common = _common_length(F.col("n_a"), F.col("n_b"), least)
    shift = F.col("at_a") - F.col("at_b")
    met = met.where(F.coalesce((shift <= F.col("n_a") - common) & (-shift <= F.col("n_b") - common), F.lit(True)))
    scored = met.select("key_a", "key_b").distinct().withColumn("score", indel_score("key_a", "key_b")).where(F.col("score") >= least)
    empty = left.where("key = ''").select(F.col("key").alias("key_a")).join(right.where("key = ''").select(F.col("key").alias("key_b")), F.col("key_a") == F.col("key_b"))
    return scored.union(empty.withColumn("score", F.lit(100.0)))


def fuzzy(names: DataFrame, known: DataFrame, least: float = 85.0) -> DataFrame:
    """The best-scoring known name, the first in order on ties, if it reaches `least`."""
    wanted = names.select("name").distinct().where("name is not null").withColumn("key", sorted_tokens(clean_name("name")))
    teams = known.where("clean is not null").groupBy(sorted_tokens("clean").alias("key")).agg(F.min("clean").alias("other"), F.min_by("TeamID", "clean").alias("TeamID"))
    pairs = similar(wanted.select("key").distinct(), teams.select("key"), least)
    met = pairs.join(teams.withColumnRenamed("key", "key_b"), "key_b")
    best = met.groupBy(F.col("key_a").alias("key")).agg(F.min_by("TeamID", F.struct(-F.col("score"), "other")).alias("TeamID"))
    return wanted.join(best, "key").select("name", "TeamID", F.lit("fuzzy").alias("how"))


def resolve(names: DataFrame, overrides: DataFrame, known: DataFrame, least: float = 85.0) -> DataFrame:
    """(name, TeamID, how): all overrides, even for names not asked for, then exact matches,
    then fuzzy ones for the rest (S7)."""
    fixed = overrides.select("name", "TeamID", F.lit("override").alias("how"))
    rest = names.select("name").distinct().join(fixed, "name", "left_anti")
    same = exact(rest, known)
    return fixed.unionByName(same).unionByName(fuzzy(rest.join(same, "name", "left_anti"), known, least))
