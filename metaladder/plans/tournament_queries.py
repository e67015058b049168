"""The tournament-file source over documents made of the order tables, with SQL twins.

A week's orders of a region are a tournament, in the nested form of ``tournaments.SCHEMA``
with everything that real files hold: repeated addresses and missing ones, other formats,
dates that are none, lists without a main board, repeated card entries, byes, results that
do not parse, players without a list or a name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lineage
from ..operators import cards, classify, metagame
from ..sources import orders, tournaments
from ..tables import Tables
from . import oracle as O
from . import report as reports
from .metagame_queries import tidy

FORMAT = "Standard"
SOURCES = ("MTGO", "Manatrader", "MTGmelee", "CardsRealm", "Topdeck")  # by region key
NAMES = ("Standard Challenge 32", "League Cup", "Super Qualifier", "Showcase Final", "A Preliminary", "Open Day")
RULES = classify.RuleSet((classify.Rule("GenericFirstBrand", False, (("InMainboard", ("Brand#1",)),)), classify.Rule("SecondBrand", True, (("InMainboard", ("Brand#2",)),))))


def _pick(values, k):
    return F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str, days: int = 7) -> DataFrame:
    """One nested document per ``days`` days and region, with its path."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    part, lines = read("part").select("p_partkey", "p_brand"), read("lineitem")
    entry = F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q"), F.col("p_brand").alias("card"))
    board = lambda b: F.transform(F.array_sort(F.collect_list(F.when(F.col("l_linestatus") == b, entry))), lambda e: F.struct(e["card"].alias("CardName"), e["q"].alias("Count")))
    boards = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(board("F").alias("main"), board("O").alias("side"))
    places = read("nation").select("n_nationkey", F.col("n_regionkey").alias("rk"))
    people = read("customer").select("c_custkey", "c_nationkey").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "rk")
    rows = read("orders").join(people, F.col("o_custkey") == F.col("c_custkey")).join(boards, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    week = F.floor(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) / days)
    one = F.struct(F.col("o_orderkey").alias("k"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("p"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("r"), F.floor(F.col("o_totalprice") / 100000).cast("int").alias("g"), "main", "side")
    events = rows.groupBy(week.alias("week"), "rk").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)).alias("o"))
    e = F.col("week") * 10 + F.col("rk")
    other = lambda b: F.when(b["c"] % 17 == 0, "-").when(b["c"] % 19 != 0, b["p"])
    result = lambda a, b: F.when(a["k"] % 13 == 0, "x-1").when(a["k"] % 29 != 0, F.concat_ws("-", a["g"].cast("string"), b["g"].cast("string"), (a["k"] % 2).cast("string")))
    pairs = F.transform(F.expr("filter(sequence(0, size(o) - 1), i -> i % 2 = 0 and i + 1 < size(o))"), lambda i: F.struct(F.col("o")[i]["p"].alias("Player1"), other(F.col("o")[i + 1]).alias("Player2"), result(F.col("o")[i], F.col("o")[i + 1]).alias("Result")))
    turn = lambda r: F.filter("pairs", lambda _, i: i % 2 == r)
    rounds = F.array(*(F.struct(F.lit(f"Round {r + 1}").alias("RoundName"), turn(r).alias("Matches")) for r in range(2)))
    source = _pick(SOURCES, F.col("rk"))
    return events.withColumn("pairs", pairs).select(
        F.concat(F.lit("mem:/Tournaments/"), source, F.lit("/"), F.lpad(F.col("week").cast("string"), 5, "0"), F.lit(".json")).alias("path"),
        F.struct(
            F.when(e % 11 == 5, "soon").otherwise(F.concat(F.date_add(F.lit("1995-01-01").cast("date"), (F.col("week") * days).cast("int")).cast("string"), F.lit("T10:00:00"))).alias("Date"),
            _pick(NAMES, e % 6).alias("Name"),
            F.when(e % 7 == 3, "").otherwise(F.concat(F.lit("http://t/"), F.floor(F.col("week") / 2).cast("string"), F.lit("/"), F.col("rk").cast("string"))).alias("Uri"),
            F.when(e % 4 == 3, "Other").when(e % 4 == 2, "STANDARD").when(e % 41 != 0, "standard").alias("Formats"),
        ).alias("Tournament"),
        F.transform(F.expr("slice(o, 1, cast((week * 10 + rk) % 3 as int))"), lambda x: F.struct(x["p"].alias("Player"))).alias("Standings"),
        F.transform("o", lambda x: F.struct(x["p"].alias("Player"), x["r"].alias("Result"), x["main"].alias("Mainboard"), x["side"].alias("Sideboard"))).alias("Decks"),
        rounds.alias("Rounds"),
    )


def _loaded(spark, sf_dir) -> Tables:
    return tournaments.tables_of(lineage.cut(documents(spark, sf_dir)), RULES, FORMAT)


def tournament_events(spark, sf_dir):
    return _loaded(spark, sf_dir).events


def tournament_decks(spark, sf_dir):
    return _loaded(spark, sf_dir).decks


def tournament_cards(spark, sf_dir):
    return _loaded(spark, sf_dir).deck_cards


def tournament_matches(spark, sf_dir):
    return _loaded(spark, sf_dir).matches.drop("match_id")


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The documents as JSON files, one each, and a damaged one; returns their folder."""
    root = lineage.workspace(spark, "files")
    docs = lineage.cut(documents(spark, sf_dir, 182))
    for k, source in enumerate(SOURCES):
        docs.filter(F.contains("path", F.lit(f"/{source}/"))).coalesce(1).drop("path").write.option("maxRecordsPerFile", 1).json(f"{root}/Tournaments/{source}")
    reports.write_text(spark, f"{root}/Tournaments/{SOURCES[0]}/broken.json", '{"Tournament": {"Uri": "http://broken", "Formats": "standard"')
    return root


def tournament_files(spark, sf_dir):
    """Files read back: of each address with a main board, its event and how much it holds."""
    files = tournaments.read_files(spark, _written(spark, sf_dir)).filter(F.col("Tournament.Uri") != "")
    per = files.groupBy(F.col("Tournament.Uri").alias("uri"), F.regexp_extract("path", "/Tournaments/([^/]+)/", 1).alias("source"))
    matches = F.aggregate(F.transform("Rounds", lambda r: F.size(r["Matches"])), F.lit(0), lambda a, n: a + n)
    copies = F.aggregate(F.flatten(F.transform("Decks", lambda d: F.concat(*(F.coalesce(d[b], F.array().cast(tournaments.CARDS)) for b in ("Mainboard", "Sideboard"))))), F.lit(0).cast("long"), lambda a, c: a + c["Count"])
    return per.agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("Decks")).alias("lists"), F.sum(matches).alias("matches"), F.sum(copies).alias("copies"))


def parquet_round_trip(spark, sf_dir):
    """The four tables written as Parquet, read back and counted by source."""
    path = lineage.workspace(spark, "tables")
    orders.load(spark, sf_dir).write(path)
    t = Tables.read(spark, path)
    return metagame.source_contribution(t, F.lit(orders.END).cast("date")).select("source", "events", "decks", "matches", "non_mirror", "known_opponent")


def csv_round_trip(spark, sf_dir):
    """The summary written as one CSV file with a header and read back."""
    path = lineage.workspace(spark, "csv")
    t = orders.load(spark, sf_dir)
    reports.csv(tidy(metagame.archetype_summary(t.decks, t.matches)).orderBy(F.desc("decks"), "archetype"), path)
    return spark.read.option("header", True).schema("archetype string, decks long, share double, wins double, matches long, win_rate double, ci_low double, ci_high double").csv(path)


def markdown_lines(spark, sf_dir):
    """The summary as lines of a Markdown table, percentages without decimals."""
    t = orders.load(spark, sf_dir)
    rows = metagame.archetype_summary(t.decks, t.matches).orderBy(F.desc("decks"), "archetype").collect()
    text = reports.markdown(["archetype", "lists", "share", "win rate"], [(r.archetype, r.decks, reports.percent(r.share), reports.percent(r.win_rate)) for r in rows])
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line long, text string")


def card_pictures(spark, sf_dir):
    """Every card beside its picture in an optional table, by name or front face, and its place on the sheets."""
    t = orders.load(spark, sf_dir)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_partkey")
    images = parts.groupBy(F.when(F.substring("p_brand", -1, 1) == "5", F.concat("p_brand", F.lit(" // Back"))).otherwise(F.col("p_brand")).alias("name")).agg(F.concat(F.lit("img/"), F.min("p_partkey").cast("string")).alias("picture")).filter("name not like '%7'")
    return cards.pictures(t.deck_cards, images)


def land_names(spark, sf_dir):
    """Names of the lands of a rule set."""
    return classify.land_names(spark, classify.RuleSet(lands={f"Brand#{i}": c for i, c in enumerate("WUBRG", 1)}))


QUERIES = {f.__name__: f for f in (tournament_events, tournament_decks, tournament_cards, tournament_matches, tournament_files, parquet_round_trip, csv_round_trip, markdown_lines, card_pictures, land_names)}


def _files(days: int = 7) -> str:
    pick = lambda values, k: f"[{', '.join(repr(v) for v in values)}][CAST({k} AS BIGINT) + 1]"
    return f"""o AS (SELECT o_orderkey AS k, 'p' || o_custkey AS p, o_custkey AS c, o_orderstatus AS r, CAST(floor(o_totalprice / 100000) AS INTEGER) AS g, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // {days} AS week, n_regionkey AS rk
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT week, rk, week * 10 + rk AS e, {pick(SOURCES, 'rk')} AS source, {pick(NAMES, '(week * 10 + rk) % 6')} AS name, count(*) AS n,
  CASE WHEN (week * 10 + rk) % 11 <> 5 THEN DATE '1995-01-01' + CAST(week * {days} AS INTEGER) END AS date,
  CASE WHEN (week * 10 + rk) % 7 <> 3 THEN 'http://t/' || (week // 2) || '/' || rk END AS address,
  'mem:/Tournaments/' || {pick(SOURCES, 'rk')} || '/' || lpad(CAST(week AS VARCHAR), 5, '0') || '.json' AS path,
  CASE WHEN (week * 10 + rk) % 4 = 3 THEN 'other' WHEN (week * 10 + rk) % 4 = 2 THEN 'standard' WHEN (week * 10 + rk) % 41 <> 0 THEN 'standard' END AS fmt FROM o GROUP BY ALL)"""


_KEPT = """kept AS (SELECT *, row_number() OVER (ORDER BY source, week) - 1 AS event_id FROM (SELECT *, coalesce(address, path) AS uri, row_number() OVER (PARTITION BY coalesce(address, path) ORDER BY source, week) AS rn FROM f WHERE fmt = 'standard') WHERE rn = 1),
entries AS (SELECT k, board, card, count FROM (SELECT l_orderkey AS k, CASE WHEN l_linestatus = 'O' THEN 'side' ELSE 'main' END AS board, p_brand AS card, CAST(l_quantity AS BIGINT) AS count, row_number() OVER (PARTITION BY l_orderkey, l_linestatus, p_brand ORDER BY l_linenumber DESC, l_quantity DESC) AS rn FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE rn = 1),
named AS (SELECT k, bool_or(card = 'Brand#1') AS a, bool_or(card = 'Brand#2') AS b FROM entries WHERE board = 'main' GROUP BY k),
lists AS (SELECT row_number() OVER (ORDER BY source, kept.week, o.k) - 1 AS deck_id, event_id, date, source, p AS player, r AS result, CASE WHEN a THEN 'First Brand' WHEN b THEN 'Colorless Second Brand' ELSE 'Unknown' END AS archetype, 'C' AS color, false AS is_fallback, a AND b AS is_conflict,
  CASE WHEN a AND b THEN 'First Brand|Colorless Second Brand' WHEN a THEN 'First Brand' WHEN b THEN 'Colorless Second Brand' ELSE '' END AS candidates, o.k FROM o JOIN kept ON o.week = kept.week AND o.rk = kept.rk JOIN named ON named.k = o.k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY week, rk ORDER BY k) - 1 AS i FROM o),
met AS (SELECT event_id, date, source, 'Round ' || CAST((a.i // 2) % 2 + 1 AS VARCHAR) AS round, a.p AS pa, CASE WHEN b.c % 19 <> 0 THEN b.p END AS pb, a.g AS ga, b.g AS gb, CAST(a.k % 2 AS INTEGER) AS gd
  FROM ranked a JOIN ranked b ON a.week = b.week AND a.rk = b.rk AND b.i = a.i + 1 JOIN kept ON kept.week = a.week AND kept.rk = a.rk WHERE a.i % 2 = 0 AND b.c % 17 <> 0 AND a.k % 13 <> 0 AND a.k % 29 <> 0 AND a.g + b.g + a.k % 2 <> 0),
sides AS (SELECT 0 AS side, event_id, date, source, round, pa AS player, pb AS opponent, ga AS games_won, gb AS games_lost, gd AS games_drawn FROM met UNION ALL SELECT 1, event_id, date, source, round, pb, pa, gb, ga, gd FROM met),
last AS (SELECT event_id, player, max(deck_id) AS deck_id, arg_max(archetype, deck_id) AS archetype FROM lists GROUP BY ALL)"""


def _q(select: str, days: int = 7, more: str = _KEPT) -> str:
    return f"WITH {_files(days)}{',' if more else ''}\n{more}\n{select}"


ORACLE_SQL = {
    "tournament_events": _q("""SELECT event_id, date, name, source, CASE WHEN source = 'MTGO' THEN CASE WHEN contains(lower(name), 'challenge') THEN 'challenge' WHEN contains(lower(name), 'league') THEN 'league' WHEN contains(lower(name), 'qualifier') THEN 'qualifier' WHEN contains(lower(name), 'showcase') THEN 'showcase' WHEN contains(lower(name), 'preliminary') THEN 'preliminary' ELSE 'other' END WHEN source = 'Manatrader' THEN 'other' ELSE 'paper' END AS event_type, uri, CAST(CASE WHEN e % 3 = 0 THEN n ELSE least(n, e % 3) END AS INTEGER) AS players FROM kept"""),
    "tournament_decks": _q("SELECT deck_id, event_id, date, source, player, result, archetype, color, is_fallback, is_conflict, candidates FROM lists"),
    "tournament_cards": _q("SELECT deck_id, card, board, count FROM lists JOIN entries USING (k)"),
    "tournament_matches": _q("SELECT side, s.event_id, date, source, round, s.player, opponent, m.deck_id, t.deck_id AS opp_deck_id, games_won, games_lost, games_drawn, CASE WHEN games_won > games_lost THEN 1.0::DOUBLE WHEN games_won < games_lost THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS score, coalesce(m.archetype, 'Unknown') AS archetype, coalesce(t.archetype, 'Unknown') AS opp_archetype FROM sides s LEFT JOIN last m ON m.event_id = s.event_id AND m.player = s.player LEFT JOIN last t ON t.event_id = s.event_id AND t.player = s.opponent"),
    "tournament_files": _q("SELECT address AS uri, source, count(*) AS files, CAST(sum(n) AS BIGINT) AS lists, CAST(sum(n // 2) AS BIGINT) AS matches, CAST(sum(c) AS BIGINT) AS copies FROM f JOIN (SELECT week, rk, sum(q) AS c FROM o JOIN (SELECT l_orderkey AS k, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1) USING (k) GROUP BY ALL) USING (week, rk) WHERE address IS NOT NULL GROUP BY ALL", 182, ""),
    "parquet_round_trip": O.query("SELECT source, events, decks, matches, non_mirror, known_opponent FROM (SELECT source, count(*) AS events FROM events GROUP BY 1) JOIN (SELECT source, count(*) AS decks FROM decks GROUP BY 1) USING (source) JOIN (SELECT source, count(*) // 2 AS matches, count(*) FILTER (archetype <> 'Unknown' AND archetype <> opp_archetype) AS non_mirror, count(*) FILTER (archetype <> 'Unknown' AND archetype <> opp_archetype AND opp_archetype <> 'Unknown') AS known_opponent FROM matches GROUP BY 1) USING (source)"),
    "csv_round_trip": O.query(f"SELECT archetype, decks, {O.rounded('share')}, wins, coalesce(matches, 0) AS matches, {O.rounded('win_rate, ci_low, ci_high')} FROM (SELECT *, {O.rates()} FROM share LEFT JOIN perf USING (archetype))", O.SUMMARY),
    "markdown_lines": O.query("SELECT * FROM (SELECT row_number() OVER (ORDER BY decks DESC, archetype) + 1 AS line, '| ' || archetype || ' | ' || decks || ' | ' || CAST(round_even(share * 100, 0) AS INTEGER) || '% | ' || coalesce(CAST(round_even(wins / matches * 100, 0) AS INTEGER) || '%', '') || ' |' AS text FROM share LEFT JOIN perf USING (archetype)) UNION ALL SELECT 0, '| archetype | lists | share | win rate |' UNION ALL SELECT 1, '| --- | --- | --- | --- |'", O.SUMMARY),
    "card_pictures": O.query("SELECT card, picture, CAST((row_number() OVER (ORDER BY card) - 1) // 9 AS BIGINT) AS sheet, CAST((row_number() OVER (ORDER BY card) - 1) % 9 AS BIGINT) AS spot FROM (SELECT DISTINCT card FROM deck_cards) LEFT JOIN (SELECT p_brand AS card, 'img/' || min(p_partkey) AS picture FROM part WHERE p_brand NOT LIKE '%7' GROUP BY p_brand) USING (card)"),
    "land_names": "SELECT * FROM (VALUES ('Brand#1'), ('Brand#2'), ('Brand#3'), ('Brand#4'), ('Brand#5')) t(land)",
}
