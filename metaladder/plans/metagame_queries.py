"""Queries of the relational operators over the order tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import intervals, labels
from ..operators import cards, field, filters, metagame
from ..sources import orders
from . import oracle as O

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def query(sql: str | None = None):
    """Register a function of (tables) under its name, with its twin."""

    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(orders.load(spark, sf_dir))
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def end():
    return F.lit(orders.END).cast("date")


def tidy(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that summation order does not show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


R = O.rounded
MU_COLUMNS = f"archetype, opp_archetype, wins, matches, {R('win_rate, ci_low, ci_high')}"


@query(O.query(f"SELECT archetype, decks, {R('share')} FROM share", O.SUMMARY))
def meta_share(t):
    return tidy(metagame.meta_share(t.decks))


@query(O.query(f"SELECT archetype, decks, {R('share')}, wins, coalesce(matches, 0) AS matches, {R('win_rate, ci_low, ci_high')} FROM (SELECT *, {O.rates()} FROM share LEFT JOIN perf USING (archetype))", O.SUMMARY))
def archetype_summary(t):
    return tidy(metagame.archetype_summary(t.decks, t.matches))


@query(O.query(f"SELECT {MU_COLUMNS} FROM mu", O.MATCHUPS))
def matchup_table(t):
    return tidy(metagame.matchup_table(t.matches))


@query(O.query(f"SELECT {MU_COLUMNS} FROM mu WHERE matches >= 560", O.MATCHUPS))
def matchup_table_min(t):
    return tidy(metagame.matchup_table(t.matches, 560))


@query(O.query("SELECT archetype, " + ", ".join(f"round(max(CASE WHEN opp_archetype = '{s}' THEN win_rate END), 9) AS \"{s}\"" for s in SEGMENTS) + " FROM mu GROUP BY archetype", O.MATCHUPS))
def matchup_matrix(t):
    return tidy(metagame.matchup_matrix(metagame.matchup_table(t.matches), SEGMENTS))


_scope = ", ".join(
    f"coalesce({s}_decks, 0) AS {s}_decks, round({s}_decks / nullif(sum({s}_decks) OVER (), 0)::DOUBLE, 9) AS {s}_share, coalesce({s}_matches, 0) AS {s}_matches, round({s}_wins / nullif({s}_matches::DOUBLE, 0), 9) AS {s}_win_rate, "
    f"round({O.wilson(f'{s}_wins', f'{s}_matches', 'low')}, 9) AS {s}_ci_low, round({O.wilson(f'{s}_wins', f'{s}_matches', 'high')}, 9) AS {s}_ci_high"
    for s in O.SCOPES
)
_by_scope = [f"d AS (SELECT archetype, {', '.join(f'count(*) FILTER (source IN {v}) AS {s}_decks' for s, v in O.SCOPES.items())} FROM decks GROUP BY archetype)", f"m AS (SELECT archetype, {', '.join(f'sum(score) FILTER (source IN {v}) AS {s}_wins, count(*) FILTER (source IN {v}) AS {s}_matches' for s, v in O.SCOPES.items())} FROM nm GROUP BY archetype)"]


@query(O.query(f"SELECT *, coalesce(online_ci_low > paper_ci_high OR paper_ci_low > online_ci_high, false) AS skew FROM (SELECT archetype, {_scope} FROM d LEFT JOIN m USING (archetype))", *_by_scope))
def scope_comparison(t):
    return tidy(metagame.scope_comparison(t, orders.SCOPES))


@query(O.query("SELECT source, event_type, count(*) AS events, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY event_type) = 1 THEN (SELECT count(*) // 2 FROM matches m WHERE m.source = e.source) ELSE 0 END AS matches FROM events e GROUP BY source, event_type"))
def coverage(t):
    return metagame.coverage(t.events, t.matches)


_WEIGHT = f"pow(0.5::DOUBLE, greatest(0, date_diff('day', date, DATE '{orders.END}')) / 182.5::DOUBLE)"


@query(O.query(f"SELECT source, (SELECT count(*) FROM events e WHERE e.source = s.source) AS events, (SELECT count(*) FROM decks d WHERE d.source = s.source) AS decks, count(*) // 2 AS matches, count(*) FILTER (archetype <> 'Unknown' AND archetype <> opp_archetype) AS non_mirror, count(*) FILTER (archetype <> 'Unknown' AND archetype <> opp_archetype AND opp_archetype <> 'Unknown') AS known_opponent, round(sum({_WEIGHT} / 2), 6) AS weight FROM matches s GROUP BY source"))
def source_contribution(t):
    return tidy(metagame.source_contribution(t, end()), 6)


@query(O.query(f"SELECT source, round(sum({_WEIGHT}), 6) AS weight, count(*) AS n FROM matches GROUP BY source"))
def recency_weight_by_source(t):
    return tidy(t.matches.groupBy("source").agg(F.sum(labels.recency(F.col("date"), end())).alias("weight"), F.count(F.lit(1)).alias("n")), 6)


_periods = "cell AS (SELECT * FROM (VALUES (30), (90), (180)) p(period), (VALUES " + ", ".join(f"('{s}')" for s in O.SCOPES) + ") s(scope))"
_in_cell = f"date_diff('day', date, DATE '{orders.END}') BETWEEN 0 AND period - 1 AND (" + " OR ".join(f"(scope = '{s}' AND source IN {v})" for s, v in O.SCOPES.items()) + ")"


@query(O.query(f"SELECT period, scope, archetype, wins, matches, {R('win_rate, ci_low, ci_high')} FROM (SELECT *, {O.rates()} FROM (SELECT period, scope, archetype, {O.RECORD} FROM nm JOIN cell ON {_in_cell} GROUP BY ALL))", _periods))
def period_scope_cells(t):
    rows = filters.cells(filters.non_mirror(t.matches), end(), scopes=orders.SCOPES)
    return tidy(intervals.with_interval(rows.groupBy("period", "scope", "archetype").agg(*metagame.record())))


@query(O.query("SELECT board, card, count(*) AS n, CAST(sum(count) AS BIGINT) AS copies FROM deck_cards JOIN decks USING (deck_id) WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30' AND source IN ('AMERICA', 'EUROPE') GROUP BY ALL"))
def filter_period_semi(t):
    kept = filters.restrict(t, "1997-01-01", "1998-06-30", scope="online", scopes=orders.SCOPES)
    return kept.deck_cards.groupBy("board", "card").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("copies"))


@query(O.query(f"SELECT deck_id, {O.RECORD} FROM nm WHERE deck_id IS NOT NULL GROUP BY deck_id"))
def deck_records(t):
    return metagame.deck_records(t.matches)


@query(O.query("SELECT archetype, board, card, count(DISTINCT deck_id) AS decks, round(avg(count), 9) AS avg_copies, round(count(DISTINCT deck_id) / (SELECT count(*) FROM decks x WHERE x.archetype = d.archetype)::DOUBLE, 9) AS play_rate FROM deck_cards JOIN decks d USING (deck_id) GROUP BY archetype, board, card"))
def card_play_rates(t):
    return tidy(cards.play_rates(t.decks, t.deck_cards))


def _effects(group: str, where: str) -> str:
    keys = group.replace("opponent", "opp_archetype AS opponent")
    sides = ("wins_with", "matches_with", "wins_without", "matches_without")
    return O.query(
        f"SELECT {group}, card, decks_with, decks_without, round(decks_with / d_tot::DOUBLE, 9) AS play_rate, round(avg_copies, 9) AS avg_copies, wins_with, matches_with, wins_without, matches_without, round(wins_with / matches_with, 9) AS win_rate_with, round(wins_without / matches_without, 9) AS win_rate_without, "
        f"round(wins_with / matches_with - wins_without / matches_without, 9) AS delta, round({O.newcombe(*sides, 'low')}, 9) AS delta_ci_low, round({O.newcombe(*sides, 'high')}, 9) AS delta_ci_high "
        f"FROM (SELECT *, w_tot - wins_with AS wins_without, n_tot - matches_with AS matches_without, d_tot - decks_with AS decks_without FROM inside JOIN total USING ({group})) WHERE decks_with >= 5 AND decks_without >= 5 AND matches_with >= 1 AND matches_without >= 1",
        f"rec AS (SELECT {keys}, deck_id, {O.RECORD} FROM nm WHERE deck_id IS NOT NULL {where} GROUP BY ALL)",
        f"total AS (SELECT {group}, sum(wins) AS w_tot, CAST(sum(matches) AS BIGINT) AS n_tot, count(DISTINCT deck_id) AS d_tot FROM rec GROUP BY {group})",
        f"inside AS (SELECT {group}, card, sum(wins) AS wins_with, CAST(sum(matches) AS BIGINT) AS matches_with, count(DISTINCT deck_id) AS decks_with, avg(count) AS avg_copies FROM rec JOIN deck_cards USING (deck_id) WHERE board = 'main' GROUP BY {group}, card)",
    )


@query(_effects("archetype", ""))
def card_effects(t):
    return tidy(cards.effects(t.decks, t.deck_cards, t.matches))


@query(_effects("archetype, opponent", "AND opp_archetype <> 'Unknown'"))
def card_effects_by_opponent(t):
    return tidy(cards.effects(t.decks, t.deck_cards, t.matches, by_opponent=True))


_pair = ("a.wins", "a.matches", "b.wins", "b.matches")


@query(O.query(f"SELECT a.archetype, a.opp_archetype AS first_opponent, b.opp_archetype AS second_opponent, round({O.newcombe(*_pair, 'low')}, 9) AS low, round({O.newcombe(*_pair, 'high')}, 9) AS high FROM mu a JOIN mu b ON a.archetype = b.archetype AND a.opp_archetype < b.opp_archetype", O.MATCHUPS))
def newcombe_pairs(t):
    mu = metagame.matchup_table(t.matches)
    a = mu.select("archetype", F.col("opp_archetype").alias("first_opponent"), F.col("wins").alias("w1"), F.col("matches").alias("n1"))
    b = mu.select("archetype", F.col("opp_archetype").alias("second_opponent"), F.col("wins").alias("w2"), F.col("matches").alias("n2"))
    low, high = intervals.newcombe(F.col("w1"), F.col("n1"), F.col("w2"), F.col("n2"))
    both = a.join(b, "archetype").filter("first_opponent < second_opponent")
    return tidy(both.select("archetype", "first_opponent", "second_opponent", low.alias("low"), high.alias("high")))


@query(O.query("SELECT archetype, color FROM (SELECT archetype, color, row_number() OVER (PARTITION BY archetype ORDER BY count(*) DESC, color) AS rn FROM decks GROUP BY archetype, color) WHERE rn = 1"))
def modal_color(t):
    return metagame.modal(t.decks, "archetype", "color")


@query(O.query("SELECT player, archetype FROM (SELECT player, archetype, row_number() OVER (PARTITION BY player ORDER BY count(*) DESC, archetype) AS rn FROM decks GROUP BY player, archetype) WHERE rn = 1"))
def modal_archetype(t):
    return metagame.modal(t.decks, "player", "archetype")


@query(O.query("SELECT CAST(year(date) AS VARCHAR) || 'Q' || CAST(quarter(date) AS VARCHAR) AS quarter, source, count(*) AS n FROM decks GROUP BY ALL"))
def quarter_labels(t):
    return t.decks.groupBy(labels.quarter(F.col("date")).alias("quarter"), "source").agg(F.count(F.lit(1)).alias("n"))


@query(O.query("SELECT archetype, decks FROM share WHERE archetype <> 'Unknown' ORDER BY decks DESC, archetype LIMIT 3", O.SUMMARY))
def top_archetypes(t):
    return metagame.top_archetypes(t.decks, 3).drop("share")


_FIELD = [O.SUMMARY, O.MATCHUPS, "field AS (SELECT archetype AS opp_archetype, decks / sum(decks) OVER ()::DOUBLE AS weight FROM (SELECT archetype, decks FROM share WHERE archetype <> 'Unknown' ORDER BY decks DESC, archetype LIMIT 40))",
    "vs AS (SELECT m.opp_archetype AS archetype, f.opp_archetype, weight, CASE WHEN m.opp_archetype = f.opp_archetype THEN 0.5::DOUBLE ELSE a / n END AS rate, CASE WHEN m.opp_archetype = f.opp_archetype THEN 0.0::DOUBLE ELSE a * (n - a) / (n * n * (n + 1)) END AS variance FROM (SELECT opp_archetype FROM field) m, field f LEFT JOIN LATERAL (SELECT coalesce(max(wins), 0) + 5.0::DOUBLE AS a, coalesce(max(matches), 0) + 10.0::DOUBLE AS n FROM mu WHERE mu.archetype = m.opp_archetype AND mu.opp_archetype = f.opp_archetype) ON true)"]


@query(O.query(f"SELECT archetype, {R('expected, sd')}, round(expected - {O.Z} * sd, 9) AS low, round(expected + {O.Z} * sd, 9) AS high FROM (SELECT archetype, sum(weight * rate) AS expected, sqrt(sum(weight * weight * variance)) AS sd FROM vs GROUP BY archetype)", *_FIELD))
def field_estimate(t):
    return tidy(field.estimate(field.against(t.decks, metagame.matchup_table(t.matches))))


@query(O.query("SELECT archetype, opp_archetype, round(cost, 9) AS cost FROM (SELECT *, weight * (0.5 - rate) AS cost, row_number() OVER (PARTITION BY archetype ORDER BY round(weight * (0.5 - rate), 12) DESC, opp_archetype) AS rn FROM vs) WHERE rn = 1 AND cost > 0", *_FIELD))
def costliest_matchup(t):
    return tidy(field.costliest(field.against(t.decks, metagame.matchup_table(t.matches))))


@query(O.query("SELECT archetype, opp_archetype, round(weight / sum(weight) OVER (PARTITION BY archetype), 9) AS width, round(win_rate - 0.5, 9) AS height FROM mu JOIN field USING (opp_archetype) WHERE matches >= 8", *_FIELD))
def field_map(t):
    return tidy(field.field_map(t.decks, metagame.matchup_table(t.matches)))


@query(O.query("SELECT archetype, opp_archetype, matches, round(win_rate, 9) AS win_rate, CASE WHEN ci_low > 0.5 THEN 'favored' WHEN ci_high < 0.5 THEN 'behind' ELSE 'could be even' END AS field_group, CASE WHEN ci_low > 0.5 OR ci_high < 0.5 THEN 'clear' ELSE 'lean' END AS verdict, matches < 30 AS few FROM mu", O.MATCHUPS))
def clear_lean(t):
    return tidy(field.groups(metagame.matchup_table(t.matches)))


@query(O.query("SELECT archetype, arg_max(opp_archetype, (ci_low, opp_archetype)) AS surest_good, round(max(ci_low), 9) AS good_low, arg_min(opp_archetype, (ci_high, opp_archetype)) AS surest_bad, round(min(ci_high), 9) AS bad_high FROM mu GROUP BY archetype", O.MATCHUPS))
def in_short(t):
    return tidy(field.in_short(metagame.matchup_table(t.matches)))
