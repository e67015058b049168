"""Queries of the list-variant operators over the order tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators.filters import non_mirror, with_list
from ..sources import orders
from ..tables import UNKNOWN
from . import oracle as O
from .metagame_queries import tidy

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        def run(spark, sf_dir):
            t = orders.load(spark, sf_dir)
            lists = t.decks.filter(F.col("archetype") != UNKNOWN).select(F.col("archetype").alias("group"), "deck_id")
            return tidy(fn(t, lists, D.copies(lists, t.deck_cards, "main")))

        QUERIES[fn.__name__] = run
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


LISTS = "lists AS (SELECT archetype AS \"group\", deck_id FROM decks WHERE archetype <> 'Unknown'), size AS (SELECT \"group\", count(*) AS lists FROM lists GROUP BY ALL)"
X = 'xx AS (SELECT "group", deck_id, card, CAST(sum(count) AS BIGINT) AS count FROM deck_cards JOIN lists USING (deck_id) WHERE board = \'main\' GROUP BY ALL HAVING sum(count) > 0), x AS (SELECT * FROM xx SEMI JOIN (SELECT "group", card FROM xx GROUP BY ALL HAVING count(*) >= 3) k USING ("group", card))'
EVERY = 'every AS (SELECT "group", card, copies, lists, lists / n::DOUBLE AS share FROM (SELECT "group", card, count AS copies, count(*) AS lists FROM x GROUP BY ALL UNION ALL SELECT "group", card, 0, n - count(*) FROM x JOIN (SELECT "group", lists AS n FROM size) USING ("group") GROUP BY "group", card, n HAVING n > count(*)) JOIN (SELECT "group", lists AS n FROM size) USING ("group"))'
MOMENTS = 'm AS (SELECT "group", card, sum(count)::DOUBLE AS s, sum(count * count)::DOUBLE AS q, count(*) AS p FROM x GROUP BY ALL), pp AS (SELECT a."group", a.card AS card_a, b.card AS card_b, a.s AS s_a, b.s AS s_b, a.q AS q_a, b.q AS q_b, a.p AS p_a, b.p AS p_b, lists AS n, coalesce(c.cross_, 0)::DOUBLE AS c, coalesce(joint, 0) AS joint FROM m a JOIN m b ON a."group" = b."group" AND a.card < b.card JOIN size ON size."group" = a."group" LEFT JOIN (SELECT a."group", a.card AS ca, b.card AS cb, sum(a.count * b.count) AS cross_, count(*) AS joint FROM x a JOIN x b ON a."group" = b."group" AND a.deck_id = b.deck_id AND a.card < b.card GROUP BY ALL) c ON c."group" = a."group" AND c.ca = a.card AND c.cb = b.card)'
ALL = (LISTS, X, EVERY, MOMENTS)


@query(O.query('SELECT "group", card, copies, lists, round(share, 9) AS share FROM every WHERE share >= 0.05', *ALL))
def copy_options(t, lists, x):
    return D.options(lists, x, D.MIN_OPTION)


@query(O.query("SELECT \"group\", card, round(play_rate, 9) AS play_rate, modal_copies, CASE WHEN top >= 0.85 THEN 'fixed' WHEN play_rate >= 0.85 THEN 'count' ELSE 'inout' END AS kind FROM (SELECT \"group\", card, max(share) AS top, sum(CASE WHEN copies > 0 THEN share ELSE 0 END) AS play_rate, arg_max(copies, (lists, -copies)) AS modal_copies FROM every GROUP BY ALL)", *ALL))
def card_kind(t, lists, x):
    return D.kinds(lists, x)


@query(O.query('SELECT "group", card, CAST(max(nth) AS BIGINT) AS copies FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY n DESC, card, nth) AS rn FROM (SELECT "group", card, nth, count(*) AS n FROM (SELECT "group", card, unnest(range(1, count + 1)) AS nth FROM x) GROUP BY ALL)) WHERE rn <= 60 GROUP BY "group", card', *ALL))
def typical_list(t, lists, x):
    return D.typical_list(lists, x, D.SIZES["main"])


_va, _vb, _vt = "(q_a / n - (s_a / n) * (s_a / n))", "(q_b / n - (s_b / n) * (s_b / n))", "((q_a + q_b + 2 * c) / n - ((s_a + s_b) / n) * ((s_a + s_b) / n))"


@query(O.query(f'SELECT "group", card_a, card_b, round(CASE WHEN {_va} + {_vb} > 1e-12 THEN {_vt} / ({_va} + {_vb}) ELSE 1 END, 9) AS ratio FROM pp', *ALL))
def slot_pair_ratio(t, lists, x):
    return D.slot_ratios(lists, x)


@query(O.query('SELECT "group", card_a, card_b, round(CASE WHEN n * q_a - s_a * s_a > 1e-9 AND n * q_b - s_b * s_b > 1e-9 THEN (n * c - s_a * s_b) / sqrt(n * q_a - s_a * s_a) / sqrt(n * q_b - s_b * s_b) END, 9) AS corr FROM pp', *ALL))
def copy_corr(t, lists, x):
    return D.correlations(lists, x)


@query(O.query("SELECT \"group\", card_a, card_b, joint AS \"both\", p_a - joint AS only_a, p_b - joint AS only_b, n - p_a - p_b + joint AS neither, round(phi, 9) AS phi, CASE WHEN phi <= -0.02 AND least(p_a - joint, p_b - joint) >= 5 AND joint * n <= 0.6 * p_a * p_b THEN 'swap' WHEN phi >= 0.02 AND joint >= 5 THEN 'with' END AS relation FROM (SELECT *, (n * joint - p_a * p_b) / nullif(sqrt((p_a * (n - p_a))::DOUBLE * (p_b * (n - p_b))::DOUBLE), 0) AS phi FROM pp)", *ALL))
def swap_pairs_phi(t, lists, x):
    return D.swaps(lists, x, apart=-0.02, together=0.02)


_SPLIT = (
    'r AS (SELECT a."group", ask, k, x.deck_id FROM (SELECT "group", ask, unnest(range(CAST(low AS BIGINT) + 1, top + 1)) AS k FROM (SELECT x."group", card AS ask, max(count) AS top, CASE WHEN count(*) < any_value(lists) THEN 0 ELSE min(count) END AS low FROM x JOIN size ON size."group" = x."group" GROUP BY x."group", card)) a JOIN x ON x."group" = a."group" AND x.card = a.ask AND x.count >= a.k)',
    'b AS (SELECT * FROM (SELECT r."group", ask, k, count(*) AS nr, any_value(lists) AS n FROM r JOIN size ON size."group" = r."group" GROUP BY r."group", ask, k) WHERE nr >= greatest(15, floor(n * 0.07 + 1e-9)) AND n - nr >= greatest(15, floor(n * 0.07 + 1e-9)))',
    'i AS (SELECT r."group", ask, k, card, sum(count)::DOUBLE AS sr, sum(count * count)::DOUBLE AS qr FROM r JOIN x ON x."group" = r."group" AND x.deck_id = r.deck_id GROUP BY ALL)',
    'g AS (SELECT "group", ask, k, round((base - rest) / base, 10) AS gain FROM (SELECT b."group", b.ask, b.k, sum(q - s * s / n) AS base, sum(coalesce(qr, 0) - coalesce(sr, 0) * coalesce(sr, 0) / nr + (q - coalesce(qr, 0)) - (s - coalesce(sr, 0)) * (s - coalesce(sr, 0)) / (n - nr)) AS rest FROM b JOIN m ON m."group" = b."group" AND m.card <> b.ask LEFT JOIN i ON i."group" = b."group" AND i.ask = b.ask AND i.k = b.k AND i.card = m.card GROUP BY ALL) WHERE base > 1e-9)',
)


@query(O.query('SELECT "group", ask AS card, k AS threshold, round(gain, 9) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY gain DESC, ask, k) AS rn FROM g) WHERE rn = 1', *ALL, *_SPLIT))
def best_split_level1(t, lists, x):
    return D.first_split(lists, x)


def _against(keys: str) -> tuple[str, ...]:
    mu = ' AND opp_archetype <> \'Unknown\'' if "opp" in keys else ""
    return (
        f'pl AS (SELECT {keys}, deck_id, {O.RECORD} FROM nm JOIN lists USING (deck_id) WHERE deck_id IS NOT NULL{mu} GROUP BY ALL)',
        f'tot AS (SELECT {keys}, sum(wins) AS w, CAST(sum(matches) AS BIGINT) AS n FROM pl GROUP BY {keys})',
        f'ins AS (SELECT {keys}, card, sum(wins) AS wins_with, CAST(sum(matches) AS BIGINT) AS matches_with FROM pl JOIN x USING ("group", deck_id) GROUP BY {keys}, card)',
        f'ab AS (SELECT *, w - wins_with AS wins_without, n - matches_with AS matches_without FROM ins JOIN tot USING ({keys}))',
    )


_sides = ("wins_with", "matches_with", "wins_without", "matches_without")


@query(O.query(f'SELECT "group", card, wins_with, matches_with, wins_without, matches_without, round(wins_with / matches_with - wins_without / matches_without, 9) AS delta, round({O.newcombe(*_sides, "low")}, 9) AS low, round({O.newcombe(*_sides, "high")}, 9) AS high FROM ab WHERE matches_with >= 1 AND matches_without >= 1', *ALL, *_against('"group"')))
def option_vs_rest(t, lists, x):
    return D.with_against_without(lists, x, with_list(non_mirror(t.matches)))


_SCORE = f"round((wins_with / matches_with - wins_without / matches_without) / greatest((({O.newcombe(*_sides, 'high')}) - ({O.newcombe(*_sides, 'low')})) / 2, 1e-9), 9)"


@query(O.query("SELECT \"group\", card, opp_archetype, wins_with, matches_with, wins_without, matches_without, score, CASE WHEN score > 0 AND best <= 3 THEN 'best' ELSE 'worst' END AS side FROM (SELECT *, row_number() OVER (PARTITION BY \"group\", card ORDER BY score DESC, opp_archetype) AS best, row_number() OVER (PARTITION BY \"group\", card ORDER BY score, opp_archetype DESC) AS worst FROM (SELECT *, " + _SCORE + " AS score FROM ab WHERE matches_with >= 30 AND matches_without >= 30)) WHERE (score > 0 AND best <= 3) OR (score < 0 AND worst <= 3)", *ALL, *_against('"group", opp_archetype')))
def option_best_worst_opponents(t, lists, x):
    rows = D.with_against_without(lists, x, with_list(non_mirror(t.matches)), by_opponent=True, least=D.MU_MIN_MATCHES)
    return D.surest_opponents(rows)


@query(O.query('SELECT "group", card, least(copies, 4) AS copies, round(sum(share), 9) AS share FROM every GROUP BY "group", card, least(copies, 4)', *ALL))
def copy_distribution(t, lists, x):
    return D.copy_distribution(lists, x)


@query(O.query("SELECT * FROM (SELECT \"group\", card, CASE WHEN p / n >= 0.85 THEN 'core' WHEN p / n >= 0.08 AND p >= 5 THEN 'flex' WHEN p >= 3 THEN 'spice' END AS tier, round(p / n, 9) AS play_rate, round(a, 9) AS avg_copies, (p / n >= 0.85 AND top / p < 0.75) AS varies FROM (SELECT \"group\", card, sum(c)::DOUBLE AS p, max(c) AS top, sum(count * c) / sum(c) AS a, any_value(lists)::DOUBLE AS n FROM (SELECT \"group\", card, count, count(*) AS c FROM x GROUP BY ALL) JOIN size USING (\"group\") GROUP BY \"group\", card)) WHERE tier IS NOT NULL", *ALL))
def card_tiers(t, lists, x):
    return D.tiers(lists, x)
