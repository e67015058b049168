"""The rule engine over the order tables: brands as cards, one rule of every condition kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import classify as C
from ..sources import orders
from ..tables import UNKNOWN
from . import oracle as O

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_b = lambda *n: tuple(f"Brand#{i}" for i in n)
RULES = (
    C.Rule("InMain", True, (("InMainboard", _b(11)), ("TwoOrMoreInMainboard", _b(12, 13, 14, 11))), (C.Rule("InMainVariant", False, (("InSideboard", _b(15)),)), C.Rule("OtherVariant", True, (("OneOrMoreInSideboard", _b(21, 22)),)))),
    C.Rule("GenericSideDeck", False, (("InSideboard", _b(23)), ("DoesNotContainMainboard", _b(24)))),
    C.Rule("EitherBoard", True, (("InMainOrSideboard", _b(25)), ("DoesNotContain", _b(31)), ("OneOrMoreInMainboard", _b(32, 33)))),
    C.Rule("TwoSide", False, (("TwoOrMoreInSideboard", _b(34, 35, 41)),)),
    C.Rule("TwoEither", False, (("TwoOrMoreInMainOrSideboard", _b(42, 43)), ("DoesNotContainSideboard", _b(44)))),
    C.Rule("AnyEither", False, (("OneOrMoreInMainOrSideboard", _b(45, 51)), ("InMainboard", _b(52)))),
)
FALLBACKS = (C.Rule("SmallPile", False, common=_b(11, 12, 13)), C.Rule("OtherPile", True, common=_b(13, 21)), C.Rule("BigPile", False, common=_b(21, 22, 23, 24)))
LANDS = {f"Brand#{i}": c for i, c in ((11, "W"), (12, "U"), (13, "B"), (14, "R"), (15, "G"), (21, "WU"), (22, "BRG"))}
SPELLS = {f"Brand#{i}": c for i, c in ((31, "W"), (32, "U"), (33, "B"), (34, "R"), (35, "G"), (41, "UB"), (42, "C"))}
SET = C.RuleSet(RULES, FALLBACKS, LANDS, SPELLS)


def boards(t):
    """deck_id and the two card maps of every list."""
    entry = lambda b: F.collect_list(F.when(F.col("board") == b, F.struct("card", "count")))
    return t.deck_cards.groupBy("deck_id").agg(F.map_from_entries(entry("main")).alias("main"), F.map_from_entries(entry("side")).alias("side"))


def _classified(spark, sf_dir):
    return C.classify(boards(orders.load(spark, sf_dir)), SET)


def _sql_condition(kind: str, cards) -> str:
    has = lambda board, c: f"list_contains({board}, '{c}')"
    both = lambda c: [has("main", c), has("side", c)]
    count = lambda tests: " + ".join(f"CAST({x} AS INTEGER)" for x in tests)
    table = {
        "InMainboard": has("main", cards[0]), "InSideboard": has("side", cards[0]), "InMainOrSideboard": " OR ".join(both(cards[0])),
        "OneOrMoreInMainboard": " OR ".join(has("main", c) for c in cards), "OneOrMoreInSideboard": " OR ".join(has("side", c) for c in cards),
        "OneOrMoreInMainOrSideboard": " OR ".join(x for c in cards for x in both(c)), "TwoOrMoreInMainboard": count(has("main", c) for c in cards) + " >= 2",
        "TwoOrMoreInSideboard": count(has("side", c) for c in cards) + " >= 2", "TwoOrMoreInMainOrSideboard": count(x for c in cards for x in both(c)) + " >= 2",
        "DoesNotContain": f"NOT ({' OR '.join(both(cards[0]))})", "DoesNotContainMainboard": f"NOT {has('main', cards[0])}", "DoesNotContainSideboard": f"NOT {has('side', cards[0])}",
    }
    return f"({table[kind]})"


def _sql_holds(rule) -> str:
    return "(" + " AND ".join(_sql_condition(*c) for c in rule.conditions) + ")"


def _sql_title(rule) -> str:
    name = C.spaced(rule.name)
    return f"cn || ' {name}'" if rule.include_color else f"'{name}'"


def _sql_rows() -> str:
    rows, place = [], 0
    for rule in RULES:
        for v in rule.variants:
            place += 1
            rows.append(f"SELECT deck_id, {len(rule.conditions) + len(v.conditions)} AS cost, {place} AS place, {_sql_title(v)} AS name FROM named WHERE {_sql_holds(rule)} AND {_sql_holds(v)}")
        place += 1
        no_variant = "".join(f" AND NOT {_sql_holds(v)}" for v in rule.variants)
        rows.append(f"SELECT deck_id, {len(rule.conditions)}, {place}, {_sql_title(rule)} FROM named WHERE {_sql_holds(rule)}{no_variant}")
    return " UNION ALL ".join(rows)


def _letters(kind, c: str) -> str:
    cards = ", ".join(f"'{k}'" for k, v in kind.items() if c in v)
    return f"coalesce(sum(count) FILTER (card IN ({cards})), 0) > 0"


_color = " || ".join(f"CASE WHEN {_letters(LANDS, c)} AND {_letters(SPELLS, c)} THEN '{c}' ELSE '' END" for c in C.LETTERS)
_name = "CASE color " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.COLOR_NAMES.items()) + " END"
_weight = lambda r: f"coalesce(sum(count) FILTER (card IN ({', '.join(repr(c) for c in r.common)})), 0)"
PARTS = (
    f"colored AS (SELECT deck_id, CASE WHEN c = '' THEN 'C' ELSE c END AS color FROM (SELECT deck_id, {_color} AS c FROM deck_cards GROUP BY deck_id))",
    f"named AS (SELECT deck_id, color, {_name} AS cn, main, side FROM colored JOIN (SELECT deck_id, coalesce(list(card) FILTER (board = 'main'), []) AS main, coalesce(list(card) FILTER (board = 'side'), []) AS side FROM deck_cards GROUP BY deck_id) USING (deck_id))",
    f"hit AS ({_sql_rows()})",
    "best AS (SELECT deck_id, count(*) AS n, arg_min(name, (cost, place)) AS name, string_agg(name, '|' ORDER BY cost, place) AS candidates FROM hit GROUP BY deck_id)",
    "fb AS (SELECT deck_id, name FROM (SELECT w.*, row_number() OVER (PARTITION BY deck_id ORDER BY weight DESC, few, place) AS rn FROM (" + " UNION ALL ".join(f"SELECT deck_id, {_weight(r)} AS weight, count(*) AS entries, {len(r.common)} AS few, {k} AS place, any_value({_sql_title(r)}) AS name FROM deck_cards JOIN named USING (deck_id) GROUP BY deck_id" for k, r in enumerate(FALLBACKS)) + ") w) WHERE rn = 1 AND weight > 0 AND weight / greatest(1, entries)::DOUBLE > 0.1)",
)


def rule_hits(spark, sf_dir):
    return _classified(spark, sf_dir).select("deck_id", "is_conflict", "candidates")


def rule_resolution(spark, sf_dir):
    return _classified(spark, sf_dir).select("deck_id", "archetype", "is_fallback")


def deck_color(spark, sf_dir):
    return C.colors(boards(orders.load(spark, sf_dir)), LANDS, SPELLS)


def fallback_pick(spark, sf_dir):
    b = boards(orders.load(spark, sf_dir))
    rows = b.join(C.colors(b, LANDS, SPELLS), "deck_id")
    names = F.create_map(*(F.lit(x) for pair in C.COLOR_NAMES.items() for x in pair))
    return rows.select("deck_id", C.fallback(FALLBACKS, F.col("main"), F.col("side"), names[F.col("color")]).alias("name")).filter("name is not null")


def display_names(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct()
    return parts.select("p_name", labels.spaced(F.concat(F.lit("Generic"), F.regexp_replace(F.initcap("p_name"), " ", ""))).alias("name"))


def last_wins_board(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    side = F.when(F.col("l_linestatus") == "O", "side").otherwise("main")
    last = lines.groupBy(F.col("l_orderkey").alias("deck_id"), F.col("p_brand").alias("card"), side.alias("board")).agg(F.max_by(F.col("l_quantity").cast("long"), F.struct("l_linenumber", F.col("l_quantity"))).alias("count"))
    return last


def normalized_players(spark, sf_dir):
    return labels.normalized_names(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_name")


def first_event_per_key(spark, sf_dir):
    from ..sources.tournaments import first_per

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "event_id")
    return first_per(events, "user_id", F.col("event_type"), F.col("event_id"))


QUERIES |= {f.__name__: f for f in (rule_hits, rule_resolution, deck_color, fallback_pick, display_names, last_wins_board, normalized_players, first_event_per_key)}
ORACLE_SQL |= {
    "rule_hits": O.query("SELECT deck_id, coalesce(n, 0) > 1 AS is_conflict, coalesce(candidates, '') AS candidates FROM named LEFT JOIN best USING (deck_id)", *PARTS),
    "rule_resolution": O.query(f"SELECT deck_id, coalesce(best.name, fb.name, '{UNKNOWN}') AS archetype, best.name IS NULL AND fb.name IS NOT NULL AS is_fallback FROM named LEFT JOIN best USING (deck_id) LEFT JOIN fb USING (deck_id)", *PARTS),
    "deck_color": O.query("SELECT * FROM colored", *PARTS),
    "fallback_pick": O.query("SELECT * FROM fb", *PARTS),
    "display_names": "SELECT DISTINCT p_name, trim(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g')) AS name FROM part",
    "last_wins_board": "SELECT deck_id, card, board, count FROM (SELECT l_orderkey AS deck_id, CASE WHEN l_linestatus = 'O' THEN 'side' ELSE 'main' END AS board, p_brand AS card, CAST(l_quantity AS BIGINT) AS count, row_number() OVER (PARTITION BY l_orderkey, p_brand, CASE WHEN l_linestatus = 'O' THEN 'side' ELSE 'main' END ORDER BY l_linenumber DESC, l_quantity DESC) AS rn FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE rn = 1",
    "normalized_players": "SELECT DISTINCT c_name, lower(trim(regexp_replace(c_name, '\\s+', ' ', 'g'))) AS key FROM customer",
    "first_event_per_key": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS rn FROM events) WHERE rn = 1",
}
