"""The four tables of the domain and their schemas as DDL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

UNKNOWN = "Unknown"

EVENTS = "event_id long, date date, name string, source string, event_type string, uri string, players int"
DECKS = "deck_id long, event_id long, date date, source string, player string, result string, archetype string, color string, is_fallback boolean, is_conflict boolean, candidates string"
DECK_CARDS = "deck_id long, card string, board string, count long"
MATCHES = "match_id long, side int, event_id long, date date, source string, round string, player string, opponent string, deck_id long, opp_deck_id long, games_won int, games_lost int, games_drawn int, score double, archetype string, opp_archetype string"


@dataclass(frozen=True)
class Tables:
    """Lazy tables. A match has two rows, one per side; (match_id, side) is its key."""

    events: DataFrame
    decks: DataFrame
    deck_cards: DataFrame
    matches: DataFrame

    def map(self, fn: Callable[[DataFrame], DataFrame], *names: str) -> Tables:
        return replace(self, **{n: fn(getattr(self, n)) for n in names})

    def write(self, path: str) -> None:
        """Parquet under ``path``; events, decks and matches are partitioned by source."""
        for name in ("events", "decks", "matches"):
            getattr(self, name).write.mode("overwrite").partitionBy("source").parquet(f"{path}/{name}")
        self.deck_cards.write.mode("overwrite").parquet(f"{path}/deck_cards")

    @classmethod
    def read(cls, spark, path: str) -> Tables:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("events", "decks", "deck_cards", "matches")))
