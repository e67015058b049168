"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells (source, language, topic). The cells' token weights are raked to
the target share of every source, language and topic in turn, for a fixed number of rounds;
weights that would ask a cell for more tokens than it has are clipped to what it has after
each round. A document is then drawn with its cell's probability, by a hash of its id, so the
same document is drawn at any parallelism and after any retry.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

DIMENSIONS = ("source", "lang", "topic")
#: Target shares go with a dimension's tokens to this power: below 1 lifts the small ones.
TEMPERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
#: First needle found decides; ``prose`` otherwise.
TOPICS = (("legal", ("License", "Copyright")), ("contact", ("@", "http")), ("markup", ("%%%", "###")), ("shouting", ("!!",)))
FRACTION, ROUNDS, SEED = 0.3, 10, "mix-1"
BROADCAST_CELLS = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column, topics: Sequence[tuple[str, Sequence[str]]] = TOPICS) -> Column:
    """Name of the first topic one of whose needles occurs in the text, else ``prose``."""
    out = F.lit("prose")
    for name, needles in reversed(topics):
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.contains(text, F.lit(needle))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that cells are made of: mix_source, mix_lang, mix_topic, mix_tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({
        "mix_source": F.coalesce(F.col("source"), F.lit("")),
        "mix_lang": F.coalesce(F.col("lang"), F.lit("")),
        "mix_topic": topic_of(text),
        "mix_tokens": F.regexp_count(text, F.lit(WORD)).cast("long"),
    })


def targets(cells: DataFrame, dimension: str, wanted: float | Mapping[str, float]) -> DataFrame:
    """``dimension, share`` (shares sum to 1): tempered by a power, or the given weights.

    Values without a given weight get share 0, given values without tokens are left out.
    """
    held = cells.groupBy(dimension).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    if isinstance(wanted, Mapping):
        weight = F.lit(0.0)
        for value, x in wanted.items():
            weight = F.when(F.col(dimension) == value, F.lit(float(x))).otherwise(weight)
    else:
        weight = F.pow(F.col("tokens").cast("double"), F.lit(float(wanted)))
    held = held.select(dimension, weight.alias("weight"))
    total = held.agg(F.sum("weight").alias("total"))
    return held.crossJoin(F.broadcast(total)).select(dimension, F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(0.0).alias("share"))  # one row


def rake(cells: DataFrame, base: str, *, wanted: Mapping[str, float | Mapping[str, float]] = TEMPERS, fraction: float = FRACTION, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (one column per key of ``wanted``, and tokens) with weight and probability.

    ``weight`` is the cell's share of the drawn tokens, ``probability`` = least(1, budget *
    weight / tokens) where the budget is ``fraction`` of all tokens. Cells without tokens get
    probability 0. Marginals are partial aggregates joined back, so a dimension value that
    holds most cells is never gathered in one task.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    budget = max(1.0, fraction * total)
    dims, kept = list(wanted), [c for c in cells.columns if c != "tokens"]
    shares = {d: storage.materialise(targets(cells, d, wanted[d]), base, f"target-{d}") for d in dims}
    now = cells.withColumn("weight", F.col("tokens") / F.lit(float(max(1, total))))
    for turn in range(rounds):
        for d in dims:
            sums = now.groupBy(d).agg(F.sum("weight").alias("held")).join(shares[d], d)
            factor = sums.select(d, F.when(F.col("held") > 0, F.col("share") / F.col("held")).otherwise(0.0).alias("factor"))
            now = now.join(factor, d, "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).drop("factor")
        now = now.withColumn("weight", F.least(F.col("weight"), F.col("tokens") / F.lit(budget)))
        now = storage.materialise(now.select(*kept, "tokens", "weight"), base, f"raked-{turn}")
    return now.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(budget) * F.col("weight") / F.col("tokens"))).otherwise(0.0))


def drawn(doc_id: Column, probability: Column, seed: str = SEED) -> Column:
    """Whether the id's hash, read as a number in [0, 1), lies below the probability."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return u < probability


def mix(docs: DataFrame, *, wanted: Mapping[str, float | Mapping[str, float]] = TEMPERS, fraction: float = FRACTION, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """``docs`` plus topic, n_tokens, probability and selected.

    ``docs`` has doc_id, text, source, lang; its other columns pass through, except those of
    the four names added. A null source, language or text counts as an empty one; a text
    without words is never drawn. Repeated rows share their cell and, with equal ids, the
    decision. An empty table gives an empty table.
    """
    if unknown := set(wanted) - set(DIMENSIONS):
        raise ValueError(f"unknown dimensions: {sorted(unknown)}")
    base = storage.workspace(docs.sparkSession, "mix")
    keys = {f"mix_{d}": d for d in DIMENSIONS}
    plain = storage.unclashed(docs, "doc_id", "text", "source", "lang").drop("topic", "n_tokens", "probability", "selected")
    marked = features(plain)
    cells = storage.materialise(marked.groupBy(*keys).agg(F.sum("mix_tokens").alias("tokens")), base, "cells")
    raked = rake(cells, base, wanted={f"mix_{d}": wanted[d] for d in wanted}, fraction=fraction, rounds=rounds)
    raked = raked.select(*keys, F.col("probability").alias("mix_p"))
    if raked.count() <= BROADCAST_CELLS:
        raked = F.broadcast(raked)
    joined = marked.join(raked, list(keys), "left")
    p = F.coalesce("mix_p", F.lit(0.0))
    return joined.select(*plain.columns, F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), p.alias("probability"), (drawn(F.col("doc_id"), p, seed) & (F.col("mix_tokens") > 0)).alias("selected"))


def oracle(rounds: int = ROUNDS, fraction: float = FRACTION, seed: str = SEED) -> str:
    """DuckDB SQL for the columns of the op4 query."""
    topic = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(coalesce(text, ''), '{x}')" for x in needles) + f" THEN '{name}'" for name, needles in TOPICS) + " ELSE 'prose' END"
    steps = [
        f"d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL)",
        "w_0 AS MATERIALIZED (SELECT *, CAST(tokens AS DOUBLE) / greatest(1, (SELECT sum(tokens) FROM cells)) AS weight FROM cells)",
    ]
    for dim, power in TEMPERS.items():
        steps.append(f"t_{dim} AS MATERIALIZED (SELECT {dim}, pow(CAST(sum(tokens) AS DOUBLE), {power}) AS x FROM cells GROUP BY ALL HAVING sum(tokens) > 0)")
    last = "w_0"
    for turn in range(rounds):
        for k, dim in enumerate(DIMENSIONS):
            value = f"w.weight * coalesce(t.x / (SELECT sum(x) FROM t_{dim}) / m.held, 0)"
            if k == len(DIMENSIONS) - 1:
                value = f"least({value}, w.tokens / greatest(1.0, {fraction} * (SELECT sum(tokens) FROM cells)))"
            steps.append(f"w_{turn}_{dim} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, w.tokens, {value} AS weight FROM {last} w LEFT JOIN (SELECT {dim}, sum(weight) AS held FROM {last} GROUP BY ALL HAVING sum(weight) > 0) m USING ({dim}) LEFT JOIN t_{dim} t USING ({dim}))")
            last = f"w_{turn}_{dim}"
    steps.append(f"p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, greatest(1.0, {fraction} * (SELECT sum(tokens) FROM cells)) * weight / tokens) ELSE 0 END AS p FROM {last})")
    unit = f"CAST(CAST('0x' || substr(md5('{seed}:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / {16**13}.0"
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability, ({unit} < p AND n_tokens > 0) AS selected FROM d JOIN p USING (source, lang, topic)"
