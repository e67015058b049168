"""Nested tournament files to the four domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import BYES, event_type
from ..operators.classify import RuleSet, classify
from ..tables import UNKNOWN, Tables

CARDS = "array<struct<CardName: string, Count: long>>"
SCHEMA = f"""Tournament struct<Date: string, Name: string, Uri: string, Formats: string>, Standings array<struct<Player: string>>,
Decks array<struct<Player: string, Result: string, Mainboard: {CARDS}, Sideboard: {CARDS}>>,
Rounds array<struct<RoundName: string, Matches: array<struct<Player1: string, Player2: string, Result: string>>>>, _corrupt_record string"""


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per readable file under ``root``/Tournaments, with its path; damaged files are skipped."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{root}/Tournaments")
    return raw.withColumn("path", F.col("_metadata.file_path")).filter("_corrupt_record is null").drop("_corrupt_record")


def first_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order: a window, for dropping duplicates picks any."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def board(cards: Column) -> Column:
    """Map from card to copies; of entries with one name the last counts."""
    entries = F.filter(F.coalesce(cards, F.array().cast(CARDS)), lambda c: c["CardName"].isNotNull())
    names = F.array_distinct(F.transform(entries, lambda c: c["CardName"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda c: c["CardName"] == n), -1)["Count"]))


def _size(column: str) -> Column:
    return F.coalesce(F.size(column), F.lit(0))


def load(spark: SparkSession, root: str, rules: RuleSet, fmt: str) -> Tables:
    """Read, filter and label all tournaments of a format.

    The first file of each address counts, in path order. Ids are dense and follow path and
    list order; numbering them needs one ordered pass over the events, of which there is one
    row per tournament.
    """
    return tables_of(read_files(spark, root), rules, fmt)


def tables_of(files: DataFrame, rules: RuleSet, fmt: str) -> Tables:
    """The tables of documents in the form of ``SCHEMA`` with the path of each."""
    files = files.filter(F.lower(F.coalesce("Tournament.Formats", F.lit(""))) == fmt.lower())
    parts = F.split("path", "/")
    files = files.withColumn("uri", F.coalesce(F.nullif(F.col("Tournament.Uri"), F.lit("")), "path"))
    files = first_per(files, "uri", parts)
    kept = F.filter(F.transform(F.coalesce("Decks", F.expr("array()").cast(f"array<struct<Player: string, Result: string, Mainboard: {CARDS}, Sideboard: {CARDS}>>")), lambda d: F.struct(d["Player"].alias("player"), d["Result"].alias("result"), board(d["Mainboard"]).alias("main"), board(d["Sideboard"]).alias("side"))), lambda d: F.size(d["main"]) > 0)
    files = files.withColumn("lists", kept)
    ordered = W.orderBy(parts)
    counted = files.select("path", F.size("lists").alias("n"))
    numbered = counted.select("path", (F.row_number().over(ordered) - 1).cast("long").alias("event_id"), (F.sum("n").over(ordered) - F.col("n")).cast("long").alias("first_deck"))
    source = F.regexp_extract("path", "/Tournaments/([^/]+)/", 1)
    files = files.join(numbered, "path").withColumns({"source": source, "date": F.try_to_date(F.substring("Tournament.Date", 1, 10), "yyyy-MM-dd"), "name": F.col("Tournament.Name")})
    players = F.when(_size("Standings") > 0, _size("Standings")).otherwise(_size("Decks"))
    events = files.select("event_id", "date", "name", "source", event_type(source, F.col("name")).alias("event_type"), "uri", players.cast("int").alias("players"))

    lists = files.select("event_id", "date", "source", "first_deck", F.posexplode("lists").alias("pos", "d")).select("event_id", "date", "source", (F.col("first_deck") + F.col("pos")).alias("deck_id"), "d.*")
    named = classify(lists.select("deck_id", "main", "side"), rules)
    decks = lists.join(named, "deck_id").select("deck_id", "event_id", "date", "source", "player", "result", "archetype", "color", "is_fallback", "is_conflict", "candidates")
    both = F.array(*(F.struct(F.lit(b).alias("board"), F.map_entries(b).alias("cards")) for b in ("main", "side")))
    deck_cards = lists.select("deck_id", F.explode(both).alias("b")).select("deck_id", "b.board", F.explode("b.cards").alias("c")).select("deck_id", F.col("c.key").alias("card"), "board", F.col("c.value").alias("count"))
    return Tables(events, decks, deck_cards, _matches(files, decks))


def _matches(files: DataFrame, decks: DataFrame) -> DataFrame:
    rounds = files.select("event_id", "date", "source", F.posexplode("Rounds").alias("r", "round"))
    rows = rounds.select("event_id", "date", "source", F.col("round.RoundName").alias("round_name"), "r", F.posexplode("round.Matches").alias("m", "x"))
    games = F.transform(F.split(F.coalesce("x.Result", F.lit("")), "-"), lambda p: F.trim(p).try_cast("int"))
    rows = rows.withColumn("g", games).filter((F.size("g") == 3) & ~F.exists("g", lambda v: v.isNull())).filter("g[0] + g[1] + g[2] <> 0")
    real = lambda c: ~F.coalesce(F.col(c).isin(*BYES), F.lit(False))
    rows = rows.filter(real("x.Player1") & real("x.Player2"))
    match_id = F.shiftleft(F.col("event_id"), 32) + F.shiftleft(F.col("r").cast("long"), 16) + F.col("m")

    def side(k: int, me: str, opp: str, won: int, lost: int) -> Column:
        gw, gl = F.col("g")[won], F.col("g")[lost]
        score = F.when(gw > gl, 1.0).when(gw < gl, 0.0).otherwise(0.5)
        return F.struct(F.lit(k).alias("side"), F.col(f"x.{me}").alias("player"), F.col(f"x.{opp}").alias("opponent"), gw.alias("games_won"), gl.alias("games_lost"), F.col("g")[2].alias("games_drawn"), score.alias("score"))

    sides = F.array(side(0, "Player1", "Player2", 0, 1), side(1, "Player2", "Player1", 1, 0))
    rows = rows.select(match_id.alias("match_id"), "event_id", "date", "source", F.col("round_name").alias("round"), F.explode(sides).alias("s")).select("match_id", "event_id", "date", "source", "round", "s.*")
    last = decks.groupBy("event_id", "player").agg(F.max_by(F.struct("deck_id", "archetype"), "deck_id").alias("d"))
    for who, deck, label in (("player", "deck_id", "archetype"), ("opponent", "opp_deck_id", "opp_archetype")):
        mine = last.select(F.col("event_id").alias("_e"), F.col("player").alias("_p"), F.col("d.deck_id").alias(deck), F.col("d.archetype").alias(label))
        rows = rows.join(mine, (F.col("event_id") == F.col("_e")) & F.col(who).eqNullSafe(F.col("_p")), "left").drop("_e", "_p").fillna(UNKNOWN, [label])
    return rows.select("match_id", "side", "event_id", "date", "source", "round", "player", "opponent", "deck_id", "opp_deck_id", "games_won", "games_lost", "games_drawn", "score", "archetype", "opp_archetype")
