"""Reports: CSV tables, a Markdown page and the JSON payload of a dashboard.

Player names are inputs of the model and occur in no output.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels, paired
from ..functions.intervals import with_interval
from ..lineage import cut
from ..operators import cards, decisions, field, filters, metagame, ratings
from ..operators.builds import builds
from ..tables import UNKNOWN, Tables

SKILL_MATCHES, CARD_ARCHETYPES, MIN_PLAY = 150, 30, 0.05


def percent(x: float | None) -> str:
    return "" if x is None else f"{x:.0%}"


def points(x: float | None) -> str:
    """Signed percentage points with one decimal; no negative zero."""
    return "" if x is None else f"{round(100 * x, 1) + 0.0:+.1f}"


def markdown(header: Sequence[str], rows: Sequence[Sequence]) -> str:
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *map(line, rows)])


def csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; the tables of a report are small."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def pilot_of(tables: Tables, end: str, scope: str, scopes: Mapping, sources: Sequence[str] | None = None, since: str | None = None, bootstrap: int = ratings.BOOTSTRAP) -> ratings.Pilot:
    """The fit of one scope's matches, not filtered by date."""
    rows = filters.restrict(tables, sources=sources, scope=scope, scopes=scopes).matches
    pilot = ratings.fit(rows, end, keep_since=since, bootstrap=bootstrap)
    pilot.lifts = cut(pilot.lifts)
    return pilot


def last_date(tables: Tables) -> str:
    return str(tables.matches.agg(F.max("date")).first()[0])


def report(tables: Tables, out: str, since: str | None = None, until: str | None = None, sources: Sequence[str] | None = None, scope: str = "combined", scopes: Mapping = filters.SCOPES, top: int = 15, min_matches: int = 8, bootstrap: int = ratings.BOOTSTRAP) -> None:
    """Write archetypes.csv, matchups.csv, matchup_matrix.csv and README.md under ``out``."""
    period = filters.restrict(tables, since, until, sources)
    t = filters.restrict(period, scope=scope, scopes=scopes)
    pilot = pilot_of(tables, until or last_date(tables), scope, scopes, sources, since, bootstrap)
    summary = metagame.archetype_summary(t.decks, t.matches, pilot)
    if pilot.skill is not None:
        summary = summary.join(pilot.skill.filter(F.col("matches") >= SKILL_MATCHES).select("archetype", "sensitivity", F.col("ci_low").alias("sens_low"), F.col("ci_high").alias("sens_high")), "archetype", "left")
    summary = cut(summary)
    matchups = cut(metagame.matchup_table(t.matches, pilot=pilot))
    names = [r.archetype for r in metagame.top_archetypes(t.decks, top).orderBy(F.desc("decks"), "archetype").collect()]
    matrix = metagame.matchup_matrix(matchups.filter(F.col("matches") >= min_matches), names)
    csv(summary.orderBy(F.desc("decks"), "archetype"), f"{out}/archetypes.csv")
    csv(matchups.orderBy("archetype", F.desc("matches"), "opp_archetype"), f"{out}/matchups.csv")
    csv(matrix, f"{out}/matchup_matrix.csv")
    rows = summary.orderBy(F.desc("decks"), "archetype").limit(top).collect()
    sections = [
        f"# Metagame, {scope}",
        markdown(["source", "type", "events", "matches"], [(r.source, r.event_type, r.events, r.matches or "") for r in metagame.coverage(t.events, t.matches).orderBy("source", "event_type").collect()]),
        markdown(["archetype", "lists", "share", "win rate", "interval", "pilot", "adjusted"], [(r.archetype, r.decks, percent(r.share), percent(r.win_rate), f"{percent(r.ci_low)}-{percent(r.ci_high)}" if r.matches else "", points(r.pilot_lift), percent(r.adj_win_rate)) for r in rows]),
        markdown(["archetype", *names], [[r.archetype, *(percent(r[n]) for n in names)] for r in matrix.collect()]),
        markdown(["archetype", *(f"{s} {c}" for s in scopes for c in ("share", "win rate")), "skew"], [[r.archetype, *(percent(r[f"{s}_{c}"]) for s in scopes for c in ("share", "win_rate")), "yes" if r.skew else ""] for r in metagame.scope_comparison(period, scopes, names).collect()]),
    ]
    write_text(tables.matches.sparkSession, f"{out}/README.md", "\n\n".join(sections) + "\n")


def write_text(spark, path: str, text: str) -> None:
    """A small text file through the file system of its path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def card_report(tables: Tables, archetype: str, out: str, board: str = "main", min_decks: int = 5, pilot: ratings.Pilot | None = None) -> DataFrame:
    """Effects and play rates of one archetype's cards as CSV; an unknown archetype names similar ones."""
    if not tables.decks.filter(F.col("archetype") == archetype).limit(1).count():
        near = [r.archetype for r in tables.decks.filter(F.contains(F.lower("archetype"), F.lit(archetype.lower()))).select("archetype").distinct().orderBy("archetype").collect()]
        raise ValueError(f"no lists of {archetype!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
    decks = tables.decks.filter(F.col("archetype") == archetype)
    slug = "-".join(archetype.lower().split())
    impact = cut(cards.effects(decks, tables.deck_cards, tables.matches, board=board, min_decks=min_decks, pilot=pilot).drop("archetype"))
    csv(impact.orderBy(F.desc("delta_adj" if pilot else "delta"), "card"), f"{out}/cards-{slug}-impact.csv")
    csv(cards.play_rates(decks, tables.deck_cards).drop("archetype").orderBy("board", F.desc("play_rate"), "card"), f"{out}/cards-{slug}-play-rates.csv")
    return impact


def payload(tables: Tables, scopes: Mapping = filters.SCOPES, periods: Sequence[int] = filters.PERIOD_DAYS, bootstrap: int = ratings.BOOTSTRAP, archetypes: int = 40) -> dict:
    """Nested plain data for every (period, scope) cell; one fit per scope serves all its periods.

    Summaries and matchups of all cells come from one pass over overlapping cells.
    """
    end = tables.decks.agg(F.max("date")).first()[0]
    last = F.lit(end)
    plain = lambda r: {k: (round(v, 4) if isinstance(v, float) else v) for k, v in r.asDict().items()}
    nm = filters.non_mirror(tables.matches)
    cell = ["period", "scope"]
    share = cut(metagame.meta_share(filters.cells(tables.decks, last, periods, scopes), *cell))
    perf = with_interval(filters.cells(nm, last, periods, scopes).groupBy(*cell, "archetype").agg(*metagame.record()))
    summary = share.join(perf, [*cell, "archetype"], "left").fillna(0, ["matches"]).collect()
    mu = with_interval(filters.cells(filters.known_opponent(nm), last, periods, scopes).groupBy(*cell, "archetype", "opp_archetype").agg(*metagame.record())).collect()
    methods = {"lookback_days": ratings.LOOKBACK_DAYS, "half_life_days": labels.HALF_LIFE_DAYS, "deck_penalty": paired.DECK_PENALTY, "penalty_grid": list(ratings.GRID), "folds": ratings.FOLDS, "bootstrap": bootstrap, "slope_penalty": ratings.SLOPE_PENALTY, "skill_matches": SKILL_MATCHES}
    thresholds = {"lists": decisions.MIN_LISTS, "core": decisions.CORE, "option": decisions.MIN_OPTION, "opponent_matches": decisions.MU_MIN_MATCHES, "play_rate": MIN_PLAY, "card_archetypes": CARD_ARCHETYPES, "archetypes": archetypes}
    out: dict = {"end": str(end), "methods": methods, "thresholds": thresholds, "scopes": {n: sorted(s) if s else None for n, s in scopes.items()}, "cells": {}, "colors": {r.archetype: r.color for r in metagame.modal(tables.decks, "archetype", "color").collect()}}
    for scope in scopes:
        pilot = pilot_of(tables, str(end), scope, scopes, since=str(tables.decks.select(F.date_sub(last, max(periods) - 1)).first()[0]), bootstrap=bootstrap)
        for days in periods:
            since = str(tables.decks.select(F.date_sub(last, days - 1)).first()[0])
            t = filters.restrict(tables, since, str(end), scope=scope, scopes=scopes)
            here = lambda rows: [plain(r) for r in rows if r.period == days and r.scope == scope]  # noqa: B023, E731
            own = sorted(here(summary), key=lambda r: (-r["decks"], r["archetype"]))
            named = [r["archetype"] for r in own if r["archetype"] != UNKNOWN][:archetypes]
            carded = t.decks.filter(F.col("archetype").isin(*named[:CARD_ARCHETYPES]))
            effects = cards.effects(carded, t.deck_cards, t.matches, min_decks=3, min_matches=10, pilot=pilot).filter(F.col("play_rate") >= MIN_PLAY)
            out["cells"][f"{days}/{scope}"] = {
                "summary": own,
                "matchups": [r for r in here(mu) if r["archetype"] in named and r["opp_archetype"] in named],
                "field": [plain(r) for r in field.estimate(field.against(t.decks, metagame.matchup_table(t.matches))).collect()],
                "cards": [plain(r) for r in effects.collect()],
                "sources": [plain(r) for r in metagame.source_contribution(t, last).collect()],
                "skill": [plain(r) for r in pilot.skill.filter(F.col("matches") >= SKILL_MATCHES).collect()] if pilot.skill is not None else [],
                "builds": _builds(t),
            }
    return out


def _builds(t: Tables) -> dict:
    lists = t.decks.filter(F.col("archetype") != UNKNOWN).select(F.col("archetype").alias("group"), "deck_id")
    out: dict = {}
    big = [r.group for r in decisions.sizes(lists).filter(F.col("lists") >= decisions.MIN_LISTS).collect()]  # archetypes
    if not big:
        return out
    lists = lists.filter(F.col("group").isin(*big))
    for board, size in decisions.SIZES.items():
        found, _ = builds(lists, decisions.copies(lists, t.deck_cards, board), size)
        for r in found.collect():
            out.setdefault(r.group, {}).setdefault(board, []).append({"name": r.name, "lists": r.lists, "share": round(r.share, 3), "path": [list(q) for q in r.path], "list": dict(r.typical or {})})
    return out


def embedded(data: dict) -> str:
    """JSON that may stand inside a script element."""
    return json.dumps(data, ensure_ascii=False, separators=(",", ":")).replace("</", "<\\/")


def write_payload(data: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(embedded(data))
