"""Row filters over the domain tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import UNKNOWN, Tables

#: The sources of each scope; None is every source.
SCOPES: dict[str, tuple[str, ...] | None] = {
    "online": ("MTGO", "Manatrader"),
    "paper": ("MTGmelee", "CardsRealm", "Topdeck"),
    "combined": None,
}
PERIOD_DAYS = (30, 90, 180)


def restrict(tables: Tables, since: str | None = None, until: str | None = None, sources: Sequence[str] | None = None, scope: str = "combined", scopes: Mapping[str, Sequence[str] | None] = SCOPES) -> Tables:
    """Rows between two dates (both included), from some sources, of one scope.

    Rows without a date fail any date bound. ``deck_cards`` keeps the cards of kept decks.
    """
    if scope not in scopes:
        raise ValueError(f"unknown scope {scope!r}; there are {', '.join(scopes)}")
    tests = []
    if since:
        tests.append(F.col("date") >= F.lit(since).cast("date"))
    if until:
        tests.append(F.col("date") <= F.lit(until).cast("date"))
    tests += [F.col("source").isin(*names) for names in (sources, scopes[scope]) if names]

    def keep(df: DataFrame) -> DataFrame:
        for test in tests:
            df = df.filter(test)
        return df

    kept = tables.map(keep, "events", "decks", "matches")
    if not tests:
        return kept
    return kept.map(lambda cards: cards.join(kept.decks.select("deck_id"), "deck_id", "left_semi"), "deck_cards")


def non_mirror(matches: DataFrame) -> DataFrame:
    """Rows whose own archetype is known and differs from the opponent's, known or not."""
    return matches.filter((F.col("archetype") != UNKNOWN) & (F.col("archetype") != F.col("opp_archetype")))


def known_opponent(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("opp_archetype") != UNKNOWN)


def with_list(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("deck_id").isNotNull())


def cells(df: DataFrame, end, periods: Sequence[int] = PERIOD_DAYS, scopes: Mapping[str, Sequence[str] | None] = SCOPES) -> DataFrame:
    """Each row once per (period, scope) cell that it belongs to; cells overlap.

    ``end`` is a date Column; a period is the given number of days up to it, both ends included.
    """
    age = F.datediff(end, F.col("date"))
    recent = df.filter((age >= 0) & (age < max(periods)))
    spans = F.filter(F.array(*(F.lit(p) for p in periods)), lambda p: age < p)
    names = F.filter(F.array(*(F.when(F.lit(True) if s is None else F.col("source").isin(*s), F.lit(n)) for n, s in scopes.items())), lambda x: x.isNotNull())
    return recent.withColumn("period", F.explode(spans)).withColumn("scope", F.explode(names))
