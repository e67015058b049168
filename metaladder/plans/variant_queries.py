"""Builds, slots and copy counts over lists that have some, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import builds as B
from ..operators import decisions as D
from ..operators import field, metagame, records
from ..operators.filters import known_opponent, non_mirror, with_list
from ..sources import orders
from ..tables import UNKNOWN
from . import oracle as O
from .decision_queries import EVERY, LISTS, MOMENTS, X
from .metagame_queries import tidy

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

CARDS = """deck_cards_v AS (SELECT deck_id, card, board, CAST(count AS BIGINT) AS count FROM (SELECT deck_id, 'main' AS board, unnest(['Express', 'Courier', 'Freight', 'Barge', 'Crate', 'Pallet', 'Fuel', 'Manifest', 'Insurance']) AS card,
  unnest([u * 4, u * 4, 4 - u * 4, 4 - u * 4, c, 4 - c, 17 + deck_id % 2, 4, CASE WHEN (deck_id // 5) % 3 = 0 THEN 2 ELSE 0 END]) AS count FROM (SELECT deck_id, CASE WHEN substr(color, 1, 1) < '3' THEN 1 ELSE 0 END AS u, 4 - CAST(deck_id % 3 = 0 AS INTEGER) - CAST(deck_id % 7 = 0 AS INTEGER) AS c FROM decks)) WHERE count > 0)"""
ALL = (LISTS, CARDS, X.replace("FROM deck_cards", "FROM deck_cards_v"), EVERY, MOMENTS)
_KNOWN = "opp_archetype <> 'Unknown'"
_SIDES = ("wins_a", "matches_a", "wins_b", "matches_b")
_DIFF = f"round(wins_a / matches_a - wins_b / matches_b, 9) AS delta, round({O.newcombe(*_SIDES, 'low')}, 9) AS low, round({O.newcombe(*_SIDES, 'high')}, 9) AS high"
TALLY = ("pl AS (SELECT deck_id, sum(score) AS w, count(*) AS n FROM nm WHERE deck_id IS NOT NULL GROUP BY 1)", f"plo AS (SELECT deck_id, opp_archetype, sum(score) AS w, count(*) AS n FROM nm WHERE deck_id IS NOT NULL AND {_KNOWN} GROUP BY ALL)")


def query(sql: str | None = None):
    def register(fn):
        def run(spark, sf_dir):
            t = orders.variants(spark, sf_dir)
            lists = t.decks.filter(F.col("archetype") != UNKNOWN).select(F.col("archetype").alias("group"), "deck_id")
            return tidy(fn(t, lists, D.copies(lists, t.deck_cards, "main"), with_list(non_mirror(t.matches))))

        QUERIES[fn.__name__] = run
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def _tree_sql() -> list[str]:
    """Named tables n0 .. n3 (group, deck_id, path, open) and q0 .. q2, the question of each open node."""
    out = ["n0 AS MATERIALIZED (SELECT \"group\", deck_id, '' AS path, true AS open FROM lists JOIN size USING (\"group\") WHERE lists >= 80)", "fl AS (SELECT \"group\", greatest(15, floor(lists * 0.07 + 1e-9)) AS floor FROM size)"]
    key = '"group", path'
    for i in range(B.DEPTH):
        out += [
            f"z{i} AS MATERIALIZED (SELECT {key}, count(*) AS n FROM n{i} WHERE open GROUP BY ALL)",
            f'x{i} AS MATERIALIZED (SELECT {key}, deck_id, card, count FROM n{i} JOIN x USING ("group", deck_id) WHERE open)',
            f"m{i} AS MATERIALIZED (SELECT {key}, card, sum(count)::DOUBLE AS s, sum(count * count)::DOUBLE AS q FROM x{i} GROUP BY ALL)",
            f"a{i} AS (SELECT {key}, ask, unnest(range(CAST(low AS BIGINT) + 1, top + 1)) AS k FROM (SELECT {key}, card AS ask, max(count) AS top, CASE WHEN count(*) < any_value(n) THEN 0 ELSE min(count) END AS low FROM x{i} JOIN z{i} USING ({key}) GROUP BY {key}, card))",
            f"r{i} AS MATERIALIZED (SELECT {key}, ask, k, deck_id FROM a{i} JOIN x{i} USING ({key}) WHERE card = ask AND count >= k)",
            f"b{i} AS MATERIALIZED (SELECT {key}, ask, k, nr, n FROM (SELECT {key}, ask, k, count(*) AS nr FROM r{i} GROUP BY ALL) JOIN z{i} USING ({key}) JOIN fl USING (\"group\") WHERE nr >= floor AND n - nr >= floor)",
            f"i{i} AS MATERIALIZED (SELECT {key}, ask, k, card, sum(count)::DOUBLE AS sr, sum(count * count)::DOUBLE AS qr FROM r{i} JOIN x{i} USING ({key}, deck_id) GROUP BY ALL)",
            f"g{i} AS (SELECT {key}, ask, k, round((base - rest) / base, 10) AS gain FROM (SELECT {key}, ask, k, sum(q - s * s / n) AS base, sum(coalesce(qr, 0) - coalesce(sr, 0) * coalesce(sr, 0) / nr + (q - coalesce(qr, 0)) - (s - coalesce(sr, 0)) * (s - coalesce(sr, 0)) / (n - nr)) AS rest FROM b{i} JOIN m{i} USING ({key}) LEFT JOIN i{i} USING ({key}, ask, k, card) WHERE card <> ask GROUP BY ALL) WHERE base > 1e-9)",
            f"q{i} AS MATERIALIZED (SELECT {key}, ask, k, gain FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY gain DESC, ask, k) AS rn FROM g{i}) WHERE rn = 1 AND gain >= 0.04)",
            f"n{i + 1} AS MATERIALIZED (SELECT t.\"group\", t.deck_id, CASE WHEN open AND ask IS NOT NULL THEN t.path || ask || CASE WHEN coalesce(count, 0) >= k THEN '>=' ELSE '<' END || k || ';' ELSE t.path END AS path, open AND ask IS NOT NULL AS open, t.path AS old, ask IS NOT NULL AND coalesce(count, 0) >= k AS yes FROM n{i} t LEFT JOIN q{i} q ON t.open AND q.\"group\" = t.\"group\" AND q.path = t.path LEFT JOIN x ON x.\"group\" = t.\"group\" AND x.deck_id = t.deck_id AND x.card = q.ask)",
        ]
    return out


def path_text():
    """A path as "card>=threshold;" or "card<threshold;", one after another."""
    step = lambda q: F.concat(q["card"], F.when(q["yes"] == 1, ">=").otherwise("<"), q["threshold"].cast("string"), F.lit(";"))
    return F.array_join(F.transform("path", step), "")


TREE = (*ALL, *_tree_sql())
_ASKED = " UNION ALL ".join(f'SELECT q{i}."group", q{i}.path, ask AS card, k AS threshold, round(gain, 9) AS gain, t.lists, t.yes, t.lists - t.yes AS "no" FROM q{i} JOIN (SELECT "group", old AS path, count(*) AS lists, CAST(sum(CAST(yes AS INTEGER)) AS BIGINT) AS yes FROM n{i + 1} WHERE open GROUP BY ALL) t USING ("group", path)' for i in range(B.DEPTH))


@query(O.query(f"{_ASKED}", *TREE))
def tree_questions(t, lists, x, nm):
    return B.grow(lists, x)[1].withColumn("path", path_text())


@query(O.query('SELECT "group", path, count(*) AS lists, round(count(*) / any_value(n)::DOUBLE, 9) AS share FROM n3 JOIN (SELECT "group", lists AS n FROM size) USING ("group") GROUP BY ALL', *TREE))
def build_leaves(t, lists, x, nm):
    return B.leaves(B.tree(lists, x)).select("group", path_text().alias("path"), "lists", "share")


def _leaf_sql(keys: str, tally: str) -> str:
    also = ", opp_archetype" if "opp" in keys else ""
    return f"own AS (SELECT {keys}, sum(w) AS wins_a, CAST(sum(n) AS BIGINT) AS matches_a FROM n3 JOIN {tally} USING (deck_id) GROUP BY ALL), rest AS (SELECT *, w - wins_a AS wins_b, n - matches_a AS matches_b FROM own JOIN (SELECT \"group\"{also}, sum(wins_a) AS w, CAST(sum(matches_a) AS BIGINT) AS n FROM own GROUP BY ALL) USING (\"group\"{also}) WHERE n > matches_a)"


@query(O.query(f'SELECT "group", path, wins_a, matches_a, wins_b, matches_b, {_DIFF} FROM rest', *TREE, *TALLY, _leaf_sql('"group", path', "pl")))
def build_against_rest(t, lists, x, nm):
    rows = B.leaf_records(B.tree(lists, x), records.per_list(nm))[1]
    return rows.select("group", path_text().alias("path"), *_SIDES, "delta", "low", "high")


_SCORE = f"round((wins_a / matches_a - wins_b / matches_b) / greatest((({O.newcombe(*_SIDES, 'high')}) - ({O.newcombe(*_SIDES, 'low')})) / 2, 1e-9), 9)"


def _surest_sql(rows: str, keys: str, least: int) -> str:
    return f"SELECT {keys}, opp_archetype, wins_a, matches_a, wins_b, matches_b, score, CASE WHEN score > 0 AND up <= 3 THEN 'best' ELSE 'worst' END AS side FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, opp_archetype) AS up, row_number() OVER (PARTITION BY {keys} ORDER BY score, opp_archetype DESC) AS down FROM (SELECT *, {_SCORE} AS score FROM {rows} WHERE matches_a >= {least} AND matches_b >= {least})) WHERE (score > 0 AND up <= 3) OR (score < 0 AND down <= 3)"


@query(O.query(_surest_sql("rest", '"group", path', 10), *TREE, *TALLY, _leaf_sql('"group", path, opp_archetype', "plo")))
def build_opponents(t, lists, x, nm):
    rows = B.leaf_records(B.tree(lists, x), records.per_list(known_opponent(nm), None, "opp_archetype"), by="opp_archetype")[1]
    return records.surest(rows.withColumn("path", path_text()), ["group", "path"], 10).select("group", "path", "opp_archetype", *_SIDES, "score", "side")


_MOVES = " UNION ALL ".join(f'SELECT "group", path, asked, card, round(sy / ny::DOUBLE, 9) AS mean_yes, round(sn / nn::DOUBLE, 9) AS mean_no FROM (SELECT t."group", t.old AS path, ask AS asked, card, sum(CASE WHEN yes THEN count ELSE 0 END) AS sy, sum(CASE WHEN yes THEN 0 ELSE count END) AS sn FROM n{i + 1} t JOIN q{i} q ON q."group" = t."group" AND q.path = t.old JOIN x ON x."group" = t."group" AND x.deck_id = t.deck_id WHERE open AND card <> ask GROUP BY ALL) JOIN (SELECT "group", old AS path, count(*) FILTER (yes) AS ny, count(*) FILTER (NOT yes) AS nn FROM n{i + 1} WHERE open GROUP BY ALL) USING ("group", path)' for i in range(B.DEPTH))


@query(O.query(f"SELECT \"group\", path, asked, card, mean_yes, mean_no, round(mean_yes - mean_no, 9) AS move FROM (SELECT *, row_number() OVER (PARTITION BY \"group\", path ORDER BY abs(round(mean_yes - mean_no, 9)) DESC, card) AS rn FROM ({_MOVES}) WHERE abs(mean_yes - mean_no) >= 0.5) WHERE rn <= 8", *TREE))
def build_moves(t, lists, x, nm):
    members, asked = B.grow(lists, x)
    return B.moves(members, x, asked).withColumn("path", path_text())


_KIND = "kind AS (SELECT \"group\", card, play_rate, CASE WHEN top >= 0.85 THEN 'fixed' WHEN play_rate >= 0.85 THEN 'count' ELSE 'inout' END AS kind FROM (SELECT \"group\", card, max(share) AS top, sum(CASE WHEN copies > 0 THEN share ELSE 0 END) AS play_rate FROM every GROUP BY ALL))"
_TWO = "two AS (SELECT \"group\", card, max(copies) AS more, min(copies) AS fewer FROM (SELECT *, row_number() OVER (PARTITION BY \"group\", card ORDER BY copies DESC) AS rn FROM every JOIN kind USING (\"group\", card) WHERE kind = 'count' AND copies > 0 AND share >= 0.05) WHERE rn <= 2 GROUP BY ALL HAVING max(copies) > min(copies))"


@query(O.query(f"SELECT *, {_DIFF} FROM (SELECT \"group\", card, more, fewer, sum(CASE WHEN count = more THEN w ELSE 0 END) AS wins_a, CAST(sum(CASE WHEN count = more THEN n ELSE 0 END) AS BIGINT) AS matches_a, sum(CASE WHEN count = fewer THEN w ELSE 0 END) AS wins_b, CAST(sum(CASE WHEN count = fewer THEN n ELSE 0 END) AS BIGINT) AS matches_b FROM two JOIN x USING (\"group\", card) JOIN pl USING (deck_id) GROUP BY ALL) WHERE matches_a > 0 AND matches_b > 0", *ALL, *TALLY, _KIND, _TWO))
def count_choice(t, lists, x, nm):
    return D.count_choice(lists, x, records.per_list(nm)).select("group", "card", "more", "fewer", *_SIDES, "delta", "low", "high")


def _options(tally: str, also: str) -> str:
    return f"""tot AS (SELECT "group"{also}, sum(w) AS tw, CAST(sum(n) AS BIGINT) AS tn FROM lists JOIN {tally} USING (deck_id) GROUP BY ALL),
held AS (SELECT "group", card, kind, play_rate, CASE WHEN kind = 'count' THEN CAST(count AS VARCHAR) ELSE 'yes' END AS option{also}, sum(w) AS w, CAST(sum(n) AS BIGINT) AS n FROM x JOIN kind USING ("group", card) JOIN {tally} USING (deck_id) WHERE kind <> 'fixed' AND play_rate >= 0.03 GROUP BY ALL),
sided AS (SELECT * FROM held UNION ALL SELECT "group", card, kind, play_rate, CASE WHEN kind = 'count' THEN '0' ELSE 'no' END AS option{also}, tw - w AS w, tn - n AS n FROM (SELECT "group", card, kind, play_rate{also}, sum(w) AS w, CAST(sum(n) AS BIGINT) AS n FROM held GROUP BY ALL) JOIN tot USING ("group"{also}) WHERE tn > n),
opt AS (SELECT "group", card, option, CASE WHEN kind = 'count' THEN share WHEN option = 'yes' THEN play_rate ELSE 1 - play_rate END AS share{also}, w AS wins_a, n AS matches_a, tw - w AS wins_b, tn - n AS matches_b FROM sided JOIN tot USING ("group"{also}) LEFT JOIN (SELECT "group", card, CAST(copies AS VARCHAR) AS option, share FROM every) s USING ("group", card, option) WHERE kind = 'inout' OR share >= 0.05)"""


@query(O.query('SELECT "group", card, option, round(share, 9) AS share, wins_a AS wins, matches_a AS matches, 0.0::DOUBLE AS lift, 0.0::DOUBLE AS lift_sd FROM opt', *ALL, *TALLY, _KIND, _options("pl", "")))
def option_records(t, lists, x, nm):
    return D.option_sides(lists, x, records.per_list(nm))[0]


@query(O.query(f'SELECT "group", card, option, round(share, 9) AS share, {", ".join(_SIDES)}, {_DIFF}, round(wins_a / matches_a - wins_b / matches_b, 9) AS delta_adj FROM opt WHERE matches_b > 0', *ALL, *TALLY, _KIND, _options("pl", "")))
def option_against_rest(t, lists, x, nm):
    return D.option_sides(lists, x, records.per_list(nm))[1].select("group", "card", "option", "share", *_SIDES, "delta", "low", "high", "delta_adj")


@query(O.query(_surest_sql("(SELECT * FROM opt WHERE option <> 'no' AND matches_b > 0)", '"group", card, option', 30), *ALL, *TALLY, _KIND, _options("plo", ", opp_archetype")))
def option_opponents(t, lists, x, nm):
    rows = D.option_sides(lists, x, records.per_list(known_opponent(nm), None, "opp_archetype"), by="opp_archetype")[1]
    return records.surest(rows, ["group", "card", "option"]).select("group", "card", "option", "opp_archetype", *_SIDES, "score", "side")


@query()
def builds_tree(t, lists, x, nm):
    found, _ = B.builds(lists, x, D.SIZES["main"])
    return found.withColumns({"path": path_text(), "typical": F.array_join(F.array_sort(F.transform(F.map_entries("typical"), lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string")))), ", ")})


@query()
def slots(t, lists, x, nm):
    return B.slots(lists, x).withColumns({"cards": F.array_join("cards", ", "), "splits": F.to_json("splits")})


# The slots that these lists have follow from how their cards are made, so SQL can check what is done with them.
_SETS = (("Barge", "Courier"), ("Crate", "Pallet"), ("Freight", "Express"))
_FILL = "fill AS (" + " UNION ALL ".join(f"SELECT \"group\", deck_id, '{a}' AS p, '{b}' AS q, coalesce(max(CASE WHEN card = '{a}' THEN count END), 0) AS a, coalesce(max(CASE WHEN card = '{b}' THEN count END), 0) AS b FROM lists LEFT JOIN x USING (\"group\", deck_id) GROUP BY ALL" for a, b in _SETS) + ")"


@query(O.query("SELECT \"group\", p || ', ' || q AS cards, CASE WHEN a >= b THEN p ELSE q END AS lead, count(*) AS lists, round(count(*) / any_value(n)::DOUBLE, 9) AS share FROM fill JOIN (SELECT \"group\", lists AS n FROM size) USING (\"group\") WHERE a + b > 0 GROUP BY ALL", *ALL, _FILL))
def slot_leads(t, lists, x, nm):
    return B.slot_leads(lists, x, B.slots(lists, x)).withColumn("cards", F.array_join("cards", ", "))


_SPLITS = "splits AS (SELECT \"group\", p, q, a, b, count(*) AS lists, CAST(sum(n) AS BIGINT) AS m, sum(w) AS w, row_number() OVER (PARTITION BY \"group\", p ORDER BY count(*) DESC, a, b) AS rn FROM fill LEFT JOIN pl USING (deck_id) GROUP BY \"group\", p, q, a, b)"


@query(O.query("SELECT \"group\", p || ', ' || q AS cards, a || ' ' || b AS split, round(lists / n::DOUBLE, 9) AS share, w AS wins, m AS matches FROM splits JOIN (SELECT \"group\", lists AS n FROM size) USING (\"group\") WHERE rn <= 4 AND lists / n::DOUBLE >= 0.05", *ALL, *TALLY, _FILL, _SPLITS))
def slot_splits(t, lists, x, nm):
    rows = B.slot_choice(lists, x, B.slots(lists, x), records.per_list(nm))[0]
    return rows.select("group", F.array_join("cards", ", ").alias("cards"), F.array_join(F.transform("split", lambda v: v.cast("string")), " ").alias("split"), "share", "wins", "matches")


@query(O.query(f"SELECT *, {_DIFF} FROM (SELECT \"group\", p || ', ' || q AS cards, max(CASE WHEN rn = 1 THEN a || ' ' || b END) AS first, max(CASE WHEN rn = 2 THEN a || ' ' || b END) AS second, max(CASE WHEN rn = 1 THEN w END) AS wins_a, max(CASE WHEN rn = 1 THEN m END) AS matches_a, max(CASE WHEN rn = 2 THEN w END) AS wins_b, max(CASE WHEN rn = 2 THEN m END) AS matches_b FROM splits GROUP BY ALL)", *ALL, *TALLY, _FILL, _SPLITS))
def slot_choice(t, lists, x, nm):
    rows = B.slot_choice(lists, x, B.slots(lists, x), records.per_list(nm))[1]
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ").alias(c)
    return rows.select("group", F.array_join("cards", ", ").alias("cards"), text("first"), text("second"), *_SIDES, "delta", "low", "high")


@query(O.query(f"""SELECT l."group" AS archetype, c.path AS common_build, w.path AS far_build, round(w.delta, 9) AS far_delta, d.card AS open_card, round(d.top, 9) AS open_share FROM (SELECT DISTINCT "group" FROM lists) l
LEFT JOIN (SELECT "group", path FROM (SELECT "group", path, row_number() OVER (PARTITION BY "group" ORDER BY count(*) DESC, path) AS rn FROM n3 GROUP BY "group", path) WHERE rn = 1) c ON c."group" = l."group"
LEFT JOIN (SELECT "group", path, delta FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY abs(delta) DESC, path) AS rn FROM (SELECT "group", path, round(wins_a / matches_a - wins_b / matches_b, 9) AS delta FROM rest)) WHERE rn = 1) w ON w."group" = l."group"
LEFT JOIN (SELECT "group", card, top FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY top, card) AS rn FROM (SELECT "group", card, max(CASE WHEN kind = 'count' THEN share ELSE greatest(play_rate, 1 - play_rate) END) AS top FROM every JOIN kind USING ("group", card) WHERE kind <> 'fixed' AND play_rate >= 0.03 GROUP BY ALL)) WHERE rn = 1) d ON d."group" = l."group\"""", *TREE, *TALLY, _KIND, _leaf_sql('"group", path', "pl")))
def in_short_lists(t, lists, x, nm):
    members = B.tree(lists, x).withColumn("path", path_text())
    tallies = records.per_list(nm)
    return field.in_short_lists(lists, B.leaf_records(members, tallies)[1], members.groupBy("group", "path").agg(F.count(F.lit(1)).alias("lists")), D.kinds(lists, x), D.options(lists, x, 0.0))


@query()
def card_order(t, lists, x, nm):
    return B.clustered(lists, x)


@query(O.query(f"SELECT archetype, round(a.wins / a.matches - b.wins / b.matches, 9) AS delta, round({O.newcombe('a.wins', 'a.matches', 'b.wins', 'b.matches', 'low')} - 0.01::DOUBLE, 9) AS shift_low, round({O.newcombe('a.wins', 'a.matches', 'b.wins', 'b.matches', 'high')} - 0.01::DOUBLE, 9) AS shift_high FROM (SELECT archetype, {O.RECORD} FROM nm WHERE source IN {O.SCOPES['online']} GROUP BY 1) a JOIN (SELECT archetype, {O.RECORD} FROM nm WHERE source IN {O.SCOPES['paper']} GROUP BY 1) b USING (archetype)"))
def shifted_difference(t, lists, x, nm):
    """Online against paper records, with a lift of two points and of one taken out."""
    online = F.col("source").isin(*orders.SCOPES["online"])
    part = lambda test, lift: non_mirror(t.matches).filter(test).groupBy("archetype").agg(*metagame.record()).withColumns({"lift": F.col("matches") * F.lit(lift), "lift_sums": F.array().cast("array<double>")})
    return records.against(part(online, 0.02), part(~online, 0.01), ["archetype"]).select("archetype", "delta", "shift_low", "shift_high")
