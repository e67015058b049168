"""An archetype against the whole field, from its matchups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.intervals import Z, verdict
from .metagame import top_archetypes

#: Matches of an even record that every matchup is given; opponents in the field; small samples.
PRIOR, FIELD, FEW = 10, 40, 30


def shares(decks: DataFrame, size: int = FIELD) -> DataFrame:
    """``opp_archetype, weight``: the commonest archetypes' shares, scaled to sum to 1."""
    top = top_archetypes(decks, size)
    total = top.agg(F.sum("decks").alias("total"))
    return top.crossJoin(F.broadcast(total)).select(F.col("archetype").alias("opp_archetype"), (F.col("decks") / F.col("total")).alias("weight"))


def against(decks: DataFrame, matchups: DataFrame, size: int = FIELD) -> DataFrame:
    """Per archetype and field opponent: weight, shrunk win rate and its variance.

    A mirror counts as even and certain; an opponent never met has the prior alone. The
    field has at most ``size`` rows, so it is broadcast.
    """
    field = F.broadcast(shares(decks, size))
    mine = field.select(F.col("opp_archetype").alias("archetype"))
    pairs = mine.join(field)  # at most size * size rows
    half = PRIOR / 2
    joined = pairs.join(matchups.select("archetype", "opp_archetype", "wins", "matches"), ["archetype", "opp_archetype"], "left").fillna(0, ["wins", "matches"])
    mirror = F.col("archetype") == F.col("opp_archetype")
    a, n = F.col("wins") + half, F.col("matches") + PRIOR
    p = a / n
    return joined.select("archetype", "opp_archetype", "weight", "wins", "matches", F.when(mirror, 0.5).otherwise(p).alias("rate"), F.when(mirror, 0.0).otherwise(a * (n - a) / (n * n * (n + 1))).alias("variance"))


def estimate(rows: DataFrame) -> DataFrame:
    """Expected win rate against the field with an interval, from ``against``."""
    out = rows.groupBy("archetype").agg(F.sum(F.col("weight") * F.col("rate")).alias("expected"), F.sqrt(F.sum(F.col("weight") * F.col("weight") * F.col("variance"))).alias("sd"))
    return out.withColumns({"low": F.col("expected") - Z * F.col("sd"), "high": F.col("expected") + Z * F.col("sd")})


def costliest(rows: DataFrame) -> DataFrame:
    """The opponent that takes most from each archetype: largest weight * (0.5 - rate)."""
    cost = F.col("weight") * (F.lit(0.5) - F.col("rate"))
    first = F.row_number().over(W.partitionBy("archetype").orderBy(F.desc("cost"), "opp_archetype"))
    return rows.withColumn("cost", F.round(cost, 12)).withColumn("place", first).filter("place = 1 and cost > 0").select("archetype", "opp_archetype", "cost")


def field_map(decks: DataFrame, matchups: DataFrame, min_matches: int = 8, size: int = FIELD) -> DataFrame:
    """Opponents met often enough: width is the share among them, height the rate less a half."""
    met = matchups.filter(F.col("matches") >= min_matches).join(F.broadcast(shares(decks, size)), "opp_archetype")
    width = F.col("weight") / F.sum("weight").over(W.partitionBy("archetype"))
    return met.select("archetype", "opp_archetype", width.alias("width"), (F.col("win_rate") - 0.5).alias("height"))


def groups(matchups: DataFrame) -> DataFrame:
    """Each matchup as favored, behind or could be even, with its verdict; small samples come last."""
    low, high = F.col("ci_low"), F.col("ci_high")
    name = F.when(low > 0.5, "favored").when(high < 0.5, "behind").otherwise("could be even")
    return matchups.select("archetype", "opp_archetype", "matches", "win_rate", name.alias("field_group"), verdict(low, high).alias("verdict"), (F.col("matches") < FEW).alias("few"))


def in_short(matchups: DataFrame) -> DataFrame:
    """Per archetype its surest good and bad matchup: the bound farthest on its side of a half."""
    best = F.max_by("opp_archetype", F.struct("ci_low", F.col("opp_archetype")))
    worst = F.min_by("opp_archetype", F.struct("ci_high", F.col("opp_archetype")))
    return matchups.groupBy("archetype").agg(best.alias("surest_good"), F.max("ci_low").alias("good_low"), worst.alias("surest_bad"), F.min("ci_high").alias("bad_high"))


def in_short_lists(lists: DataFrame, against_rest: DataFrame, sizes: DataFrame, kinds: DataFrame, options: DataFrame) -> DataFrame:
    """Per archetype: its commonest build, the build farthest from its other lists, its most open card.

    ``against_rest`` compares builds (group, path) with the rest, ``sizes`` counts their
    lists. Open is the card that varies whose commonest option is least common.
    """
    first = lambda df, *order: df.withColumn("_n", F.row_number().over(W.partitionBy("group").orderBy(*order))).filter("_n = 1").drop("_n")
    common = first(sizes, F.desc("lists"), "path").select("group", F.col("path").alias("common_build"))
    far = first(against_rest.withColumn("delta", F.round("delta", 9)), F.desc(F.abs("delta")), "path").select("group", F.col("path").alias("far_build"), F.col("delta").alias("far_delta"))
    share = F.when(F.col("kind") == "count", F.col("share")).otherwise(F.greatest("play_rate", 1 - F.col("play_rate")))
    tops = options.join(kinds.filter("kind <> 'fixed' and play_rate >= 0.03"), ["group", "card"]).groupBy("group", "card").agg(F.max(share).alias("open_share"))
    open_ = first(tops, "open_share", "card").select("group", F.col("card").alias("open_card"), "open_share")
    groups_ = lists.select("group").distinct()
    return groups_.join(common, "group", "left").join(far, "group", "left").join(open_, "group", "left").withColumnRenamed("group", "archetype")
