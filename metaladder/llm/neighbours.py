"""Each row beside the row with the next larger id, without sorting everything into one task.

Ids are dealt into ranges whose bounds come from quantiles of the ids alone. A range also
gets a copy of the first row of the range after it, so a sorted stream over a partition sees
every row with its successor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids at most that are gathered on the driver as range bounds, and bytes a range aims at.
MAX_RANGES, RANGE_BYTES = 4096, 16 << 20


def _place(bounds: list[int], column: str):
    """How many of the sorted bounds lie below a value, by a search of two levels."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    array = lambda values: F.array(*map(F.lit, values))
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col(column)))
    coarse = below(array(bounds[step - 1 :: step]))
    return coarse * step + below(F.slice(array(bounds), coarse * step + 1, F.lit(step)))


def ranged(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` plus ``range`` and ``tail``, sorted by (range, tail, id, text) inside partitions.

    ``tail`` marks the copy of the next range's first row (in the last range: of the very
    first row). Ranges without rows do not occur. Ids are not null; rows that repeat one lie
    in one range, ordered by their text. There are as many ranges as the texts' bytes ask
    for, ``MAX_RANGES`` at most.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_column).alias("id"))
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    parts = min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    quantiles = ids.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 10_000).alias("q")).first()["q"] if parts > 1 else []
    place = _place(sorted(set(quantiles or [])), id_column)
    firsts = sorted((r.lowest, r.range) for r in docs.withColumn("range", place).groupBy("range").agg(F.min(id_column).alias("lowest")).collect())
    before = {lowest: firsts[k - 1][1] for k, (lowest, _) in enumerate(firsts)}  # k = 0 takes the last range
    if not before:
        return docs.withColumns({"range": F.lit(0), "tail": F.lit(False)})
    also = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col(id_column))
    spots = F.array_compact(F.array(F.struct(place.alias("range"), F.lit(False).alias("tail")), F.when(also.isNotNull(), F.struct(also.alias("range"), F.lit(True).alias("tail")))))
    dealt = docs.select("*", F.inline(spots))
    return dealt.repartitionByRange(parts, "range").sortWithinPartitions("range", "tail", id_column, text)
