"""Labels derived from names and dates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HALF_LIFE_DAYS = 182.5
BYES = ("-", "", "BYE", "Bye", "bye")
#: Kinds of events of the one source whose names tell, in order of precedence.
NAMED_KINDS = ("challenge", "league", "qualifier", "showcase", "preliminary")
NAMED_SOURCE = "MTGO"
PAPER_SOURCES = ("MTGmelee", "Topdeck", "CardsRealm")


def normalized(name: object) -> str:
    """Compatibility form, white space collapsed and trimmed, case folded; no string gives ''."""
    return " ".join(unicodedata.normalize("NFKC", name).split()).casefold() if isinstance(name, str) else ""


@F.pandas_udf(StringType())
def _normalized(names: pd.Series) -> pd.Series:
    return names.map(normalized)


def normalized_names(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column with their ``key``; Spark has neither NFKC nor case folding."""
    return df.select(column).distinct().withColumn("key", _normalized(column))


def with_keys(df: DataFrame, **keys: str) -> DataFrame:
    """``df`` plus a normalised key for each ``key=column``; every distinct name is converted once."""
    names = df.select(F.explode(F.array(*(F.col(c) for c in keys.values()))).alias("name")).distinct()
    coded = names.withColumn("key", _normalized("name"))
    for key, column in keys.items():
        df = df.join(coded.select(F.col("name").alias(f"_{key}"), F.col("key").alias(key)), df[column] == F.col(f"_{key}"), "left").drop(f"_{key}")
        df = df.withColumn(key, F.coalesce(key, F.lit("")))
    return df


def quarter(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def recency(date: Column, end: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """Half for every ``half_life`` days before ``end``; later dates weigh 1."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0), F.datediff(end, date)) / F.lit(half_life))


def event_type(source: Column, name: Column) -> Column:
    lowered = F.lower(F.coalesce(name, F.lit("")))
    kind = F.lit("other")
    for k in reversed(NAMED_KINDS):
        kind = F.when(F.contains(lowered, F.lit(k)), F.lit(k)).otherwise(kind)
    return F.when(source == NAMED_SOURCE, kind).when(source.isin(*PAPER_SOURCES), "paper").otherwise("other")


def spaced(name: Column) -> Column:
    """A rule's name without "Generic", its words split at case changes, blanks collapsed."""
    split = F.regexp_replace(F.regexp_replace(name, "Generic", ""), "(?<=[a-z])(?=[A-Z])", " ")
    return F.trim(F.regexp_replace(split, r"\s+", " "))


def folded(card: Column) -> Column:
    """The plain name of a snow-covered card."""
    return F.regexp_replace(card, "^Snow-Covered ", "")


def sheet(place: Column, per_sheet: int = 9) -> tuple[Column, Column]:
    """Sheet and spot of the n-th picture (from 1) when sheets hold ``per_sheet`` of them."""
    return F.floor((place - 1) / per_sheet), (place - 1) % per_sheet
