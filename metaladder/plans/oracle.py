"""SQL fragments shared by the twins of the queries."""

BASE = """listed AS (SELECT DISTINCT l_orderkey FROM lineitem),
decks AS (SELECT o_orderkey AS deck_id, CAST((date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 7) * 10 + r_regionkey AS BIGINT) AS event_id,
  CAST(o_orderdate AS DATE) AS date, r_name AS source, CAST(o_custkey AS VARCHAR) AS player, o_orderpriority AS color,
  CASE WHEN l_orderkey IS NULL THEN 'Unknown' ELSE c_mktsegment END AS archetype, CAST(floor(o_totalprice / 100000) AS INTEGER) AS games
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN listed ON o_orderkey = l_orderkey),
paired AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY deck_id) - 1 AS rn FROM decks),
pairs AS (SELECT a.event_id, a.date, a.source, a.deck_id AS match_id, a.deck_id AS da, b.deck_id AS db, a.player AS pa, b.player AS pb, a.archetype AS aa, b.archetype AS ab, a.games AS ga, b.games AS gb
  FROM paired a JOIN paired b ON a.event_id = b.event_id AND b.rn = a.rn + 1 WHERE a.rn % 2 = 0),
matches AS (SELECT match_id, 0 AS side, event_id, date, source, pa AS player, pb AS opponent, CASE WHEN aa <> 'Unknown' THEN da END AS deck_id, CASE WHEN ab <> 'Unknown' THEN db END AS opp_deck_id,
    CASE WHEN ga > gb THEN 1.0::DOUBLE WHEN ga < gb THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS score, aa AS archetype, ab AS opp_archetype FROM pairs
  UNION ALL SELECT match_id, 1, event_id, date, source, pb, pa, CASE WHEN ab <> 'Unknown' THEN db END, CASE WHEN aa <> 'Unknown' THEN da END,
    CASE WHEN gb > ga THEN 1.0::DOUBLE WHEN gb < ga THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END, ab, aa FROM pairs),
deck_cards AS (SELECT l_orderkey AS deck_id, p_brand AS card, CASE WHEN l_linestatus = 'O' THEN 'side' ELSE 'main' END AS board, CAST(sum(l_quantity) AS BIGINT) AS count
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
events AS (SELECT event_id, source, min(date) AS date, CAST(count(*) AS BIGINT) AS players, CASE WHEN count(*) >= 10 THEN 'challenge' ELSE 'league' END AS event_type FROM decks GROUP BY event_id, source),
nm AS (SELECT * FROM matches WHERE archetype <> 'Unknown' AND archetype <> opp_archetype)"""

Z = "1.959964::DOUBLE"
SCOPES = {"online": "('AMERICA', 'EUROPE')", "paper": "('AFRICA', 'ASIA', 'MIDDLE EAST')", "combined": "('AMERICA', 'EUROPE', 'AFRICA', 'ASIA', 'MIDDLE EAST')"}


def query(select: str, *more: str) -> str:
    """``select`` behind the base tables and further named ones."""
    return "WITH " + ",\n".join([BASE, *more]) + "\n" + select


def wilson(w: str, n: str, side: str) -> str:
    w, n = f"({w})", f"nullif(({n})::DOUBLE, 0)"
    base = f"(1 + {Z} * {Z} / {n})"
    centre = f"(({w} / {n} + {Z} * {Z} / (2 * {n})) / {base})"
    half = f"({Z} * sqrt({w} / {n} * (1 - {w} / {n}) / {n} + {Z} * {Z} / (4 * {n} * {n})) / {base})"
    bound = f"greatest(0.0::DOUBLE, {centre} - {half})" if side == "low" else f"least(1.0::DOUBLE, {centre} + {half})"
    return f"CASE WHEN {n} > 0 THEN {bound} END"


def newcombe(w1: str, n1: str, w2: str, n2: str, side: str) -> str:
    p1, p2 = f"(({w1}) / nullif(({n1})::DOUBLE, 0))", f"(({w2}) / nullif(({n2})::DOUBLE, 0))"
    if side == "low":
        a, b, sign = f"({p1} - ({wilson(w1, n1, 'low')}))", f"(({wilson(w2, n2, 'high')}) - {p2})", "-"
    else:
        a, b, sign = f"(({wilson(w1, n1, 'high')}) - {p1})", f"({p2} - ({wilson(w2, n2, 'low')}))", "+"
    return f"{p1} - {p2} {sign} sqrt({a} * {a} + {b} * {b})"


def rates(w: str = "wins", n: str = "matches") -> str:
    return f"{w} / nullif({n}::DOUBLE, 0) AS win_rate, {wilson(w, n, 'low')} AS ci_low, {wilson(w, n, 'high')} AS ci_high"


RECORD = "sum(score) AS wins, count(*) AS matches"
SUMMARY = f"perf AS (SELECT archetype, {RECORD} FROM nm GROUP BY archetype), share AS (SELECT archetype, count(*) AS decks, count(*) / (SELECT count(*) FROM decks)::DOUBLE AS share FROM decks GROUP BY archetype)"
MATCHUPS = f"mu AS (SELECT *, {rates()} FROM (SELECT archetype, opp_archetype, {RECORD} FROM nm WHERE opp_archetype <> 'Unknown' GROUP BY ALL))"


def rounded(columns: str, digits: int = 9) -> str:
    return ", ".join(f"round({c.strip()}, {digits}) AS {c.strip()}" for c in columns.split(","))
