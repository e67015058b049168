"""Shares, win rates and matchups of archetypes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.intervals import widen, with_interval
from ..functions.labels import recency
from ..tables import UNKNOWN, Tables
from .filters import SCOPES, known_opponent, non_mirror, with_list



def record(*more: Column) -> list[Column]:
    """Aggregates of a record: wins (draws are halves) and matches."""
    return [F.sum("score").alias("wins"), F.count(F.lit(1)).alias("matches"), *more]


def meta_share(decks: DataFrame, *keys: str) -> DataFrame:
    """Lists per archetype and their share of all, unknown ones included; per ``keys`` if given."""
    counts = decks.groupBy(*keys, "archetype").agg(F.count(F.lit(1)).alias("decks"))
    total = F.sum("decks").over(W.partitionBy(*keys)) if keys else None
    if total is None:  # one row, so the join is with a scalar
        counts = counts.crossJoin(F.broadcast(counts.agg(F.sum("decks").alias("all_decks"))))
        return counts.select("archetype", "decks", (F.col("decks") / F.col("all_decks")).alias("share"))
    return counts.withColumn("share", F.col("decks") / total)


def adjusted(table: DataFrame, lifts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with pilot_lift, lift_sd, adj_win_rate and its interval.

    ``lifts`` has, per keys, the summed lift and ``lift_sums``, the same per replicate.
    """
    n = F.col("matches").cast("double")
    spread = F.aggregate(F.col("lift_sums"), F.lit(0.0), lambda a, x: a + x) / F.size("lift_sums")
    square = F.aggregate(F.col("lift_sums"), F.lit(0.0), lambda a, x: a + (x - spread) * (x - spread))
    sd = F.when(F.size("lift_sums") >= 2, F.sqrt(square / (F.size("lift_sums") - 1))).otherwise(0.0)
    joined = table.join(lifts, list(keys), "left").withColumns({"pilot_lift": F.when(n > 0, F.coalesce("lift", F.lit(0.0)) / n), "lift_sd": F.when(n > 0, F.coalesce(sd, F.lit(0.0)) / n)})
    joined = joined.withColumn("adj_win_rate", F.col("win_rate") - F.col("pilot_lift"))
    low, high = widen(F.col("win_rate"), F.col("ci_low"), F.col("ci_high"), F.col("adj_win_rate"), F.col("lift_sd"))
    return joined.withColumns({"adj_ci_low": low, "adj_ci_high": high}).drop("lift", "lift_sums")


def archetype_summary(decks: DataFrame, matches: DataFrame, pilot=None) -> DataFrame:
    """Share and non-mirror win rate of every archetype; with ``pilot`` also the adjusted one."""
    nm = non_mirror(matches)
    perf = with_interval(nm.groupBy("archetype").agg(*record()))
    if pilot is not None:
        perf = adjusted(perf, pilot.sums(nm, ["archetype"]), ["archetype"])
    return meta_share(decks).join(perf, "archetype", "left").fillna(0, ["matches"])


def matchup_table(matches: DataFrame, min_matches: int = 1, pilot=None) -> DataFrame:
    """Record and interval of every ordered pair of different, known archetypes."""
    keys = ["archetype", "opp_archetype"]
    nm = known_opponent(non_mirror(matches))
    table = with_interval(nm.groupBy(*keys).agg(*record()))
    if pilot is not None:
        table = adjusted(table, pilot.sums(nm, keys), keys)
    return table.filter(F.col("matches") >= min_matches)


def matchup_matrix(matchups: DataFrame, archetypes: Sequence[str], value: str = "win_rate") -> DataFrame:
    """One row and one column per given archetype, in that order; null where there is no cell."""
    sub = matchups.filter(F.col("archetype").isin(*archetypes) & F.col("opp_archetype").isin(*archetypes))
    wide = sub.groupBy("archetype").pivot("opp_archetype", list(archetypes)).agg(F.first(value))
    rows = matchups.sparkSession.createDataFrame([(i, a) for i, a in enumerate(archetypes)], "place int, archetype string")
    return F.broadcast(rows).join(wide, "archetype", "left").orderBy("place").drop("place")


def top_archetypes(decks: DataFrame, n: int) -> DataFrame:
    """The n known archetypes with most lists, ties in alphabetical order."""
    return meta_share(decks.filter(F.col("archetype") != UNKNOWN)).orderBy(F.desc("decks"), "archetype").limit(n)


def scope_comparison(tables: Tables, scopes: Mapping[str, Sequence[str] | None] = SCOPES, archetypes: Sequence[str] | None = None) -> DataFrame:
    """Every scope's share and win rate side by side, one pass over decks and one over matches.

    ``skew`` tells that the online and paper intervals are disjoint. Counts that are missing
    are 0, shares and rates stay null.
    """
    inside = {n: F.lit(True) if s is None else F.coalesce(F.col("source").isin(*s), F.lit(False)) for n, s in scopes.items()}
    decks = tables.decks.groupBy("archetype").agg(*(F.count_if(t).alias(f"{n}_decks") for n, t in inside.items()))
    totals = decks.agg(*(F.sum(f"{n}_decks").alias(f"{n}_all") for n in scopes))
    nm = non_mirror(tables.matches)
    perf = nm.groupBy("archetype").agg(*(c for n, t in inside.items() for c in (F.sum(F.when(t, F.col("score"))).alias(f"{n}_wins"), F.count_if(t).alias(f"{n}_matches"))))
    out = decks.crossJoin(F.broadcast(totals)).join(perf, "archetype", "left")
    for n in scopes:
        share = F.when(F.col(f"{n}_decks") > 0, F.col(f"{n}_decks") / F.col(f"{n}_all"))
        out = out.withColumn(f"{n}_matches", F.when(F.col(f"{n}_decks") > 0, F.coalesce(f"{n}_matches", F.lit(0))).otherwise(F.lit(0)).cast("long")).withColumn(f"{n}_share", share)
        out = with_interval(out, f"{n}_wins", f"{n}_matches").withColumnsRenamed({"win_rate": f"{n}_win_rate", "ci_low": f"{n}_ci_low", "ci_high": f"{n}_ci_high"})
    apart = (F.col("online_ci_low") > F.col("paper_ci_high")) | (F.col("paper_ci_low") > F.col("online_ci_high"))
    out = out.withColumn("skew", F.coalesce(apart, F.lit(False)))
    out = out.select("archetype", *(f"{n}_{c}" for n in scopes for c in ("decks", "share", "matches", "win_rate", "ci_low", "ci_high")), "skew")
    if archetypes is not None:
        rows = tables.decks.sparkSession.createDataFrame([(i, a) for i, a in enumerate(archetypes)], "place int, archetype string")
        counts = [f"{n}_{c}" for n in scopes for c in ("decks", "matches")]
        out = F.broadcast(rows).join(out, "archetype", "left").fillna(0, counts).fillna(False, ["skew"]).orderBy("place").drop("place")
    return out


def coverage(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Events per source and type; a source's matches stand on its first row alone."""
    counts = events.groupBy("source", "event_type").agg(F.count(F.lit(1)).alias("events"))
    played = matches.groupBy("source").agg(F.expr("count(1) div 2").alias("matches"))
    first = F.row_number().over(W.partitionBy("source").orderBy("event_type")) == 1
    return counts.join(played, "source", "left").withColumn("matches", F.when(first, F.coalesce("matches", F.lit(0))).otherwise(0).cast("long"))


def source_contribution(tables: Tables, end: Column) -> DataFrame:
    """Per source: events, lists, matches, non-mirror rows, those with a known opponent, and weight."""
    none = F.lit(None)
    parts = [
        tables.events.select("source", F.lit("e").alias("kind"), none.cast("date").alias("date"), none.cast("string").alias("archetype"), none.cast("string").alias("opp_archetype")),
        tables.decks.select("source", F.lit("d"), none.cast("date"), none.cast("string"), none.cast("string")),
        tables.matches.select("source", F.lit("m"), "date", "archetype", "opp_archetype"),
    ]
    rows = parts[0].union(parts[1]).union(parts[2])
    m = F.col("kind") == "m"
    nm = m & (F.col("archetype") != UNKNOWN) & (F.col("archetype") != F.col("opp_archetype"))
    return rows.groupBy("source").agg(
        F.count_if(F.col("kind") == "e").alias("events"), F.count_if(F.col("kind") == "d").alias("decks"),
        F.expr("count_if(kind = 'm') div 2").alias("matches"), F.count_if(nm).alias("non_mirror"),
        F.count_if(nm & (F.col("opp_archetype") != UNKNOWN)).alias("known_opponent"),
        F.sum(F.when(m, recency(F.col("date"), end) / 2).otherwise(0.0)).alias("weight"),
    )


def modal(df: DataFrame, key: str, value: str) -> DataFrame:
    """The commonest value per key, the smallest of equally common ones, '' without any."""
    return df.groupBy(key).agg(F.coalesce(F.mode(value, deterministic=True), F.lit("")).alias(value))


def deck_records(matches: DataFrame, *keys: str) -> DataFrame:
    """Non-mirror record of every list."""
    return with_list(non_mirror(matches)).groupBy("deck_id", *keys).agg(*record())
