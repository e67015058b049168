"""Domain tables from an order-processing schema, for tests and benchmarks.

An order is a list: its customer the player, its market segment the archetype (unknown
without line items), its region the source, its week and region the event. Within an event
neighbouring orders meet; an order's games are its price in hundreds of thousands. Cards are
the brands of the parts, on the side board where the line is open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import UNKNOWN, Tables

SCOPES = {"online": ("AMERICA", "EUROPE"), "paper": ("AFRICA", "ASIA", "MIDDLE EAST"), "combined": None}
END = "2001-08-01"


def load(spark: SparkSession, sf_dir: str) -> Tables:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_regionkey", "r_name")
    people = read("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "r_regionkey", "r_name")
    lines = read("lineitem")
    listed = lines.select(F.col("l_orderkey").alias("listed")).distinct()
    date = F.col("o_orderdate").cast("date")
    week = F.floor(F.datediff(date, F.lit("1995-01-01").cast("date")) / 7)
    orders = read("orders").join(people, F.col("o_custkey") == F.col("c_custkey")).join(listed, F.col("o_orderkey") == F.col("listed"), "left").select(
        F.col("o_orderkey").alias("deck_id"), (week * 10 + F.col("r_regionkey")).cast("long").alias("event_id"), date.alias("date"), F.col("r_name").alias("source"),
        F.col("o_custkey").cast("string").alias("player"), F.col("o_orderstatus").alias("result"),
        F.when(F.col("listed").isNull(), UNKNOWN).otherwise(F.col("c_mktsegment")).alias("archetype"),
        F.floor(F.col("o_totalprice") / 100000).cast("int").alias("games"), F.col("o_orderpriority").alias("color"),
    )
    decks = orders.select("deck_id", "event_id", "date", "source", "player", "result", "archetype", "color", F.lit(False).alias("is_fallback"), F.lit(False).alias("is_conflict"), F.col("archetype").alias("candidates"))
    events = orders.groupBy("event_id", "source").agg(F.min("date").alias("date"), F.count(F.lit(1)).cast("int").alias("players"))
    kind = F.when(F.col("players") >= 10, "challenge").otherwise("league")
    events = events.select("event_id", "date", F.concat("source", F.lit(" "), F.col("event_id").cast("string")).alias("name"), "source", kind.alias("event_type"), F.col("event_id").cast("string").alias("uri"), "players")
    return Tables(events, decks, _cards(lines, read("part")), _matches(orders))


def variants(spark: SparkSession, sf_dir: str) -> Tables:
    """The same lists with cards that have builds, slots and copy counts to find.

    Urgent orders hold one pair of cards and the others another pair; two cards share four
    places in proportions that follow the order's number; one card comes in two numbers, one
    in or out, one always the same.
    """
    t = load(spark, sf_dir)
    k = F.col("deck_id")
    urgent = F.substring("color", 1, 1) < "3"
    crates = F.lit(4) - (k % 3 == 0).cast("long") - (k % 7 == 0).cast("long")
    counts = {"Express": F.when(urgent, 4), "Courier": F.when(urgent, 4), "Freight": F.when(~urgent, 4), "Barge": F.when(~urgent, 4), "Crate": crates, "Pallet": 4 - crates, "Fuel": 17 + k % 2, "Manifest": F.lit(4), "Insurance": F.when(F.floor(k / 5) % 3 == 0, 2)}
    entries = F.array(*(F.struct(F.lit(c).alias("card"), F.lit("main").alias("board"), F.coalesce(n, F.lit(0)).cast("long").alias("count")) for c, n in counts.items()))
    return Tables(t.events, t.decks, t.decks.select("deck_id", F.inline(entries)).filter("count > 0"), t.matches)


def _cards(lines: DataFrame, parts: DataFrame) -> DataFrame:
    board = F.when(F.col("l_linestatus") == "O", "side").otherwise("main")
    return lines.join(parts.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("deck_id"), F.col("p_brand").alias("card"), board.alias("board")).agg(F.sum("l_quantity").cast("long").alias("count"))


def _matches(orders: DataFrame) -> DataFrame:
    order = W.partitionBy("event_id").orderBy("deck_id")
    who = ("deck_id", "player", "archetype", "games")
    ranked = orders.withColumn("n", F.row_number().over(order) - 1).withColumn("b", F.lead(F.struct(*who)).over(order))
    pairs = ranked.filter("n % 2 = 0 and b is not null").select("event_id", "date", "source", F.col("deck_id").alias("match_id"), F.struct(*who).alias("a"), "b")

    def side(k: int, me: str, other: str):
        own = lambda x: F.when(F.col(f"{x}.archetype") != UNKNOWN, F.col(f"{x}.deck_id"))
        won, lost = F.col(f"{me}.games"), F.col(f"{other}.games")
        return F.struct(
            F.lit(k).alias("side"), F.col(f"{me}.player").alias("player"), F.col(f"{other}.player").alias("opponent"), own(me).alias("deck_id"), own(other).alias("opp_deck_id"),
            won.alias("games_won"), lost.alias("games_lost"), F.lit(0).alias("games_drawn"), F.when(won > lost, 1.0).when(won < lost, 0.0).otherwise(0.5).alias("score"),
            F.col(f"{me}.archetype").alias("archetype"), F.col(f"{other}.archetype").alias("opp_archetype"),
        )

    both = pairs.select("match_id", "event_id", "date", "source", F.explode(F.array(side(0, "a", "b"), side(1, "b", "a"))).alias("s"))
    return both.select("match_id", "s.side", "event_id", "date", "source", F.lit("1").alias("round"), *(f"s.{c}" for c in ("player", "opponent", "deck_id", "opp_deck_id", "games_won", "games_lost", "games_drawn", "score", "archetype", "opp_archetype")))
