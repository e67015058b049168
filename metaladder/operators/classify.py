"""Labelling card lists by a declarative rule set.

Rules are few and live on the driver: they are compiled to Column expressions over one row
per list with two card maps, so labelling is one projection without a join. Only colours,
whose catalogue has thousands of cards, are looked up by a join.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import UNKNOWN

LETTERS = "WUBRG"
MIN_SIMILARITY = 0.1
#: The name of every set of colours, in the order of LETTERS.
COLOR_NAMES = {
    "W": "Mono White", "U": "Mono Blue", "B": "Mono Black", "R": "Mono Red", "G": "Mono Green",
    "WU": "Azorius", "WB": "Orzhov", "WR": "Boros", "WG": "Selesnya", "UB": "Dimir",
    "UR": "Izzet", "UG": "Simic", "BR": "Rakdos", "BG": "Golgari", "RG": "Gruul",
    "WUB": "Esper", "WUR": "Jeskai", "WUG": "Bant", "WBR": "Mardu", "WBG": "Abzan",
    "WRG": "Naya", "UBR": "Grixis", "UBG": "Sultai", "URG": "Temur", "BRG": "Jund",
    "WUBR": "WUBR", "WBRG": "WBRG", "WUBG": "WUBG", "WURG": "WURG", "UBRG": "UBRG",
    "WUBRG": "5c", "C": "Colorless",
}


@dataclass(frozen=True)
class Rule:
    """``conditions`` are (kind, cards); a fallback has only ``common`` cards."""

    name: str
    include_color: bool = False
    conditions: tuple[tuple[str, tuple[str, ...]], ...] = ()
    variants: tuple[Rule, ...] = ()
    common: tuple[str, ...] = ()

    @classmethod
    def parse(cls, data: dict) -> Rule:
        """From the JSON form; conditions without cards count for nothing."""
        return cls(
            data["Name"],
            bool(data.get("IncludeColorInName")),
            tuple((c["Type"], tuple(c["Cards"])) for c in data.get("Conditions") or () if c.get("Cards")),
            tuple(map(cls.parse, data.get("Variants") or ())),
            tuple(data.get("CommonCards") or ()),
        )


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...] = ()
    fallbacks: tuple[Rule, ...] = ()
    lands: Mapping[str, str] = field(default_factory=dict)
    spells: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def read(cls, root: str, fmt: str) -> RuleSet:
        """From a folder of rule files; files in order of name, later colours override earlier."""
        base = Path(root) / "Formats"
        load = lambda p: json.loads(p.read_text(encoding="utf-8-sig"))
        lands: dict[str, str] = {}
        spells: dict[str, str] = {}
        for path in (base / "card_colors.json", base / fmt / "color_overrides.json"):
            if path.exists():
                data = load(path)
                lands |= {x["Name"]: x["Color"] for x in data.get("Lands") or ()}
                spells |= {x["Name"]: x["Color"] for x in data.get("NonLands") or ()}
        rules = lambda kind: tuple(Rule.parse(load(p)) for p in sorted((base / fmt / kind).glob("*.json")))
        return cls(rules("Archetypes"), rules("Fallbacks"), lands, spells)


def land_names(spark, rules: RuleSet) -> DataFrame:
    """``land``: the names under which the rule files list lands."""
    return spark.createDataFrame([(x,) for x in sorted(rules.lands)], "land string")


def spaced(name: str) -> str:
    """The driver-side twin of ``labels.spaced``."""
    return " ".join(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name.replace("Generic", "")).split())


def condition(kind: str, cards: Sequence[str], main: Column, side: Column) -> Column:
    """Whether a list satisfies one condition; ``main`` and ``side`` are arrays of card names."""
    m = [F.array_contains(main, c) for c in cards]
    s = [F.array_contains(side, c) for c in cards]
    both = {"Mainboard": [m], "Sideboard": [s], "MainOrSideboard": [m, s]}
    either = lambda tests: F.exists(F.array(*tests), lambda x: x)
    match = re.fullmatch(r"(In|OneOrMoreIn|TwoOrMoreIn)(Mainboard|Sideboard|MainOrSideboard)", kind)
    if match:
        boards = both[match[2]]
        if match[1] == "In":
            return either([b[0] for b in boards])
        if match[1] == "OneOrMoreIn":
            return either([x for b in boards for x in b])
        return F.size(F.filter(F.array(*(x for b in boards for x in b)), lambda x: x)) >= 2
    match = re.fullmatch(r"DoesNotContain(Mainboard|Sideboard|)", kind)
    if match:
        return ~either([b[0] for b in both[match[1] or "MainOrSideboard"]])
    raise ValueError(f"unknown condition kind: {kind}")


def holds(rule: Rule, main: Column, side: Column) -> Column:
    """Whether a list satisfies all conditions of a rule."""
    out = F.lit(True)
    for kind, cards in rule.conditions:
        out = out & condition(kind, cards, main, side)
    return out


def title(rule: Rule, color_name: Column) -> Column:
    name = spaced(rule.name)
    return F.trim(F.concat(color_name, F.lit(f" {name}"))) if rule.include_color else F.lit(name)


def hits(rules: Sequence[Rule], main: Column, side: Column, color_name: Column) -> Column:
    """Array of (cost, place, name) of the rules that hold, cheapest first, then file order.

    Variants that hold stand in for their rule and cost its conditions and their own.
    """
    found, place = [], 0
    for rule in rules:
        base = holds(rule, main, side)
        variants = [holds(v, main, side) for v in rule.variants]
        plain = base
        for test, v in zip(variants, rule.variants):
            plain = plain & ~test
            place += 1
            found.append(F.when(base & test, F.struct(F.lit(len(rule.conditions) + len(v.conditions)).alias("cost"), F.lit(place).alias("place"), title(v, color_name).alias("name"))))
        place += 1
        found.append(F.when(plain, F.struct(F.lit(len(rule.conditions)).alias("cost"), F.lit(place).alias("place"), title(rule, color_name).alias("name"))))
    if not found:
        return F.expr("cast(array() as array<struct<cost: int, place: int, name: string>>)")
    return F.array_sort(F.array_compact(F.array(*found)))


def fallback(rules: Sequence[Rule], main: Column, side: Column, color_name: Column, least: float = MIN_SIMILARITY) -> Column:
    """Name of the best fallback, or null: most copies of common cards, then fewest common cards, then file order."""
    entries = F.concat(F.map_values(main), F.map_values(side))
    scored = []
    for place, rule in enumerate(rules):
        listed = F.array(*(F.lit(c) for c in dict.fromkeys(rule.common))) if rule.common else F.array().cast("array<string>")
        weight = F.lit(0).cast("long")
        for board in (main, side):
            weight = weight + F.aggregate(F.map_values(F.map_filter(board, lambda k, _: F.array_contains(listed, k))), F.lit(0).cast("long"), lambda a, n: a + n)
        scored.append(F.struct(weight.alias("weight"), F.lit(-len(rule.common)).alias("few"), F.lit(-place).alias("first"), title(rule, color_name).alias("name")))
    if not scored:
        return F.lit(None).cast("string")
    best = F.array_max(F.array(*scored))
    similar = best["weight"] / F.greatest(F.lit(1), F.size(entries))
    return F.when((best["weight"] > 0) & (similar > least), best["name"])


def colors(boards: DataFrame, lands: Mapping[str, str], spells: Mapping[str, str]) -> DataFrame:
    """``deck_id, color``: letters with a land and a spell in the list, ``C`` without any."""
    catalogue = [(c, lands.get(c, ""), spells.get(c, "")) for c in sorted({*lands, *spells})]
    table = F.broadcast(boards.sparkSession.createDataFrame(catalogue, "card string, land string, spell string"))  # a rule file's cards
    entries = boards.select("deck_id", F.explode(F.concat(F.map_entries("main"), F.map_entries("side"))).alias("e")).select("deck_id", F.col("e.key").alias("card"), F.col("e.value").alias("count"))
    copies = lambda kind, c: F.sum(F.when(F.contains(F.col(kind), F.lit(c)), F.col("count")).otherwise(0))
    has = [F.when((copies("land", c) > 0) & (copies("spell", c) > 0), F.lit(c)).otherwise("").alias(c) for c in LETTERS]
    found = entries.join(table, "card").groupBy("deck_id").agg(F.concat(*has).alias("color"))
    return boards.select("deck_id").join(found, "deck_id", "left").select("deck_id", F.when(F.coalesce("color", F.lit("")) == "", "C").otherwise(F.col("color")).alias("color"))


def classify(boards: DataFrame, rules: RuleSet) -> DataFrame:
    """``deck_id, archetype, color, is_fallback, is_conflict, candidates`` of lists.

    ``boards`` has deck_id and maps main and side from card to copies. Candidates are the
    names of all rules that hold, joined by a bar; more than one is a conflict.
    """
    names = F.create_map(*(F.lit(x) for pair in COLOR_NAMES.items() for x in pair))
    rows = boards.join(colors(boards, rules.lands, rules.spells), "deck_id").withColumn("color_name", names[F.col("color")])
    main, side = F.col("main"), F.col("side")
    rows = rows.withColumn("hits", hits(rules.rules, F.map_keys(main), F.map_keys(side), F.col("color_name")))
    rows = rows.withColumn("fallback", F.when(F.size("hits") == 0, fallback(rules.fallbacks, main, side, F.col("color_name"))))
    first = F.when(F.size("hits") > 0, F.col("hits")[0]["name"])
    return rows.select(
        "deck_id", F.coalesce(first, "fallback", F.lit(UNKNOWN)).alias("archetype"), "color", F.col("fallback").isNotNull().alias("is_fallback"),
        (F.size("hits") > 1).alias("is_conflict"), F.array_join(F.transform("hits", lambda h: h["name"]), "|").alias("candidates"),
    )
