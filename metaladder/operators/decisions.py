"""What the lists of an archetype agree on, and where they differ: the relational part.

Copy counts stay in long form, one row per (list, card); a card that a list does not play is
an absent row and counts as zero. ``lists`` tables have (group, deck_id), where the group is
whatever lists are compared within: an archetype, or a build of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import lineage
from ..functions.intervals import Z, newcombe
from ..functions.labels import folded
from . import records
from .filters import known_opponent
from .metagame import record

#: Thresholds; each is a share of lists unless its name says otherwise.
MIN_LISTS, CORE, MIN_OPTION, MIN_CARD_LISTS = 80, 0.85, 0.05, 3
MU_MIN_MATCHES, MU_TOP = 30, 3
SIZES = {"main": 60, "side": 15}


def copies(lists: DataFrame, deck_cards: DataFrame, board: str, min_lists: int = MIN_CARD_LISTS) -> DataFrame:
    """``group, deck_id, card, count`` on a board: snow-covered names folded by sum, cards of too few lists gone."""
    used = deck_cards.filter(F.col("board") == board).select("deck_id", folded(F.col("card")).alias("card"), "count")
    rows = used.join(lists.select("group", "deck_id"), "deck_id").groupBy("group", "deck_id", "card").agg(F.sum("count").alias("count")).filter("count > 0")
    often = rows.groupBy("group", "card").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_lists)
    return rows.join(often.select("group", "card"), ["group", "card"], "left_semi")


def sizes(lists: DataFrame) -> DataFrame:
    return lists.groupBy("group").agg(F.count_distinct("deck_id").alias("lists"))


def options(lists: DataFrame, x: DataFrame, min_share: float = 0.03) -> DataFrame:
    """``group, card, copies, lists, share``: every copy count, 0 included, in enough of the lists."""
    played = x.groupBy("group", "card", F.col("count").alias("copies")).agg(F.count(F.lit(1)).alias("lists"))
    n = sizes(lists).withColumnRenamed("lists", "all")
    zero = played.groupBy("group", "card").agg(F.sum("lists").alias("some")).join(n, "group").select("group", "card", F.lit(0).cast("long").alias("copies"), (F.col("all") - F.col("some")).alias("lists")).filter("lists > 0")
    return played.unionByName(zero).join(n, "group").withColumn("share", F.col("lists") / F.col("all")).filter(F.col("share") >= min_share).drop("all")


def kinds(lists: DataFrame, x: DataFrame) -> DataFrame:
    """``group, card, play_rate, modal_copies, kind``.

    fixed: one copy count, 0 included, in ``CORE`` of the lists; count: nearly all play it,
    in different numbers; inout: the rest. The smallest of equally common counts is modal.
    """
    return _kinds(options(lists, x, 0.0))


def _kinds(every: DataFrame) -> DataFrame:
    top = F.max_by("copies", F.struct("lists", -F.col("copies")))
    out = every.groupBy("group", "card").agg(F.max("share").alias("top_share"), top.alias("modal_copies"), F.sum(F.when(F.col("copies") > 0, F.col("share")).otherwise(0.0)).alias("play_rate"))
    kind = F.when(F.col("top_share") >= CORE, "fixed").when(F.col("play_rate") >= CORE, "count").otherwise("inout")
    return out.select("group", "card", "play_rate", "modal_copies", kind.alias("kind"))


def typical_list(lists: DataFrame, x: DataFrame, size: int) -> DataFrame:
    """``group, card, copies``: the ``size`` commonest (card, nth copy) pairs put together."""
    nth = x.select("group", "card", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("nth")).groupBy("group", "card", "nth").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("group").orderBy(F.desc("n"), "card", "nth"))
    return nth.withColumn("place", place).filter(F.col("place") <= size).groupBy("group", "card").agg(F.max("nth").cast("long").alias("copies"))


def _pairs(lists: DataFrame, x: DataFrame) -> DataFrame:
    """Per group and two cards a < b: list count and the moments of both copy counts."""
    one = x.groupBy("group", "card").agg(F.sum("count").cast("double").alias("s"), F.sum(F.col("count") * F.col("count")).cast("double").alias("q"), F.count(F.lit(1)).alias("p"))
    a = one.select("group", *(F.col(c).alias(f"{c}_a") for c in ("card", "s", "q", "p")))
    b = one.select("group", *(F.col(c).alias(f"{c}_b") for c in ("card", "s", "q", "p")))
    xa = x.select("group", "deck_id", F.col("card").alias("card_a"), F.col("count").alias("ca"))
    xb = x.select("group", "deck_id", F.col("card").alias("card_b"), F.col("count").alias("cb"))
    both = xa.join(xb, ["group", "deck_id"]).filter("card_a < card_b").groupBy("group", "card_a", "card_b").agg(F.sum(F.col("ca") * F.col("cb")).cast("double").alias("cross"), F.count(F.lit(1)).alias("joint"))
    pairs = a.join(b, "group").filter("card_a < card_b")  # cards of one group: a bounded catalogue
    return pairs.join(both, ["group", "card_a", "card_b"], "left").fillna(0, ["cross", "joint"]).join(sizes(lists), "group")


def slot_ratios(lists: DataFrame, x: DataFrame) -> DataFrame:
    """``group, card_a, card_b, ratio``: Var(a + b) / (Var a + Var b), population variances; 1 without any."""
    n = F.col("lists").cast("double")
    var = lambda s, q: q / n - (s / n) * (s / n)
    va, vb = var(F.col("s_a"), F.col("q_a")), var(F.col("s_b"), F.col("q_b"))
    total = var(F.col("s_a") + F.col("s_b"), F.col("q_a") + F.col("q_b") + 2 * F.col("cross"))
    return _pairs(lists, x).select("group", "card_a", "card_b", F.when(va + vb > 1e-12, total / (va + vb)).otherwise(1.0).alias("ratio"))


def correlations(lists: DataFrame, x: DataFrame) -> DataFrame:
    """``group, card_a, card_b, corr``: Pearson correlation of copy counts; null for a constant one."""
    n = F.col("lists").cast("double")
    dev = lambda s, q: n * q - s * s
    da, db = dev(F.col("s_a"), F.col("q_a")), dev(F.col("s_b"), F.col("q_b"))
    return _pairs(lists, x).select("group", "card_a", "card_b", F.when((da > 1e-9) & (db > 1e-9), (n * F.col("cross") - F.col("s_a") * F.col("s_b")) / F.sqrt(da) / F.sqrt(db)).alias("corr"))


def swaps(lists: DataFrame, x: DataFrame, apart: float = -0.15, together: float = 0.30, least: int = 5) -> DataFrame:
    """``group, card_a, card_b, both, only_a, only_b, neither, phi, relation`` from presence alone.

    swap: phi <= ``apart``, each is played without the other in ``least`` lists, and both
    together in at most 0.6 of the lists expected by chance; with: phi >= ``together`` and both in ``least`` lists.
    """
    n = F.col("lists")
    p = _pairs(lists, x).withColumns({"both": F.col("joint"), "only_a": F.col("p_a") - F.col("joint"), "only_b": F.col("p_b") - F.col("joint"), "neither": n - F.col("p_a") - F.col("p_b") + F.col("joint")})
    spread = (F.col("p_a") * (n - F.col("p_a"))).cast("double") * (F.col("p_b") * (n - F.col("p_b"))).cast("double")
    p = p.withColumn("phi", F.when(spread > 0, (n * F.col("joint") - F.col("p_a") * F.col("p_b")) / F.sqrt(spread)))
    swap = (F.col("phi") <= apart) & (F.least("only_a", "only_b") >= least) & (F.col("both") * n <= 0.6 * F.col("p_a") * F.col("p_b"))
    relation = F.when(swap, "swap").when((F.col("phi") >= together) & (F.col("both") >= least), "with")
    return p.select("group", "card_a", "card_b", "both", "only_a", "only_b", "neither", "phi", relation.alias("relation"))


def first_split(lists: DataFrame, x: DataFrame, min_share: float = 0.07, min_lists: int = 15, floors: DataFrame | None = None) -> DataFrame:
    """``group, card, threshold, gain``: the one question that best predicts the rest of a list.

    Gain is the share of the other cards' squared error that splitting by "at least
    ``threshold`` copies" removes. Each side needs ``min_share`` of the lists and
    ``min_lists``, or what ``floors`` (group, floor) says. Ties go to the first card, then the lowest threshold.
    """
    n = sizes(lists)
    steps = x.groupBy("group", "card").agg(F.max("count").alias("top"), F.min("count").alias("least"), F.count(F.lit(1)).alias("p")).join(n, "group")
    low = F.when(F.col("p") < F.col("lists"), F.lit(0)).otherwise(F.col("least"))
    asked = steps.withColumn("low", low).filter("top > low").select("group", F.col("card").alias("ask"), F.explode(F.expr("sequence(cast(low as int) + 1, cast(top as int))")).alias("k"))
    right = asked.join(x.withColumnRenamed("card", "ask"), ["group", "ask"]).filter("count >= k").select("group", "ask", "k", "deck_id")
    big = right.groupBy("group", "ask", "k").agg(F.count(F.lit(1)).alias("nr")).join(n, "group").withColumn("nl", F.col("lists") - F.col("nr"))
    if floors is None:
        floor = F.greatest(F.lit(min_lists).cast("long"), F.floor(F.col("lists") * min_share + 1e-9))
    else:
        big, floor = big.join(floors, "group"), F.col("floor")
    big = big.filter((F.col("nr") >= floor) & (F.col("nl") >= floor))
    inside = right.join(x, ["group", "deck_id"]).groupBy("group", "ask", "k", "card").agg(F.sum("count").cast("double").alias("sr"), F.sum(F.col("count") * F.col("count")).cast("double").alias("qr"))
    all_ = x.groupBy("group", "card").agg(F.sum("count").cast("double").alias("s"), F.sum(F.col("count") * F.col("count")).cast("double").alias("q"))
    rows = big.join(all_, "group").filter("card <> ask").join(inside, ["group", "ask", "k", "card"], "left").fillna(0.0, ["sr", "qr"])
    sse = lambda s, q, m: q - s * s / m
    s, q, sr, qr = (F.col(c) for c in ("s", "q", "sr", "qr"))
    summed = rows.groupBy("group", "ask", "k").agg(F.sum(sse(s, q, F.col("lists"))).alias("base"), F.sum(sse(sr, qr, F.col("nr")) + sse(s - sr, q - qr, F.col("nl"))).alias("left"))
    gains = summed.filter("base > 1e-9").withColumn("gain", F.round((F.col("base") - F.col("left")) / F.col("base"), 10))
    place = F.row_number().over(W.partitionBy("group").orderBy(F.desc("gain"), "ask", "k"))
    return gains.withColumn("place", place).filter("place = 1").select("group", F.col("ask").alias("card"), F.col("k").cast("long").alias("threshold"), "gain")


def option_lists(lists: DataFrame, x: DataFrame) -> DataFrame:
    """``group, card, deck_id, played``: every list beside every card of its group."""
    cards = x.select("group", "card").distinct()
    return lists.select("group", "deck_id").join(cards, "group").join(x, ["group", "card", "deck_id"], "left").select("group", "card", "deck_id", (F.coalesce("count", F.lit(0)) > 0).alias("played"))


def with_against_without(lists: DataFrame, x: DataFrame, nm: DataFrame, by_opponent: bool = False, least: int = 1) -> DataFrame:
    """Per card: record of the lists that play it, of those that do not, and the difference's interval.

    ``nm`` are non-mirror rows with lists. The lists without a card are the group's total
    less those with it. Nothing is returned where a side has fewer than ``least`` matches.
    """
    keys = ["group"]
    rows = nm.join(lists.select("group", "deck_id"), "deck_id")
    if by_opponent:
        rows, keys = known_opponent(rows), ["group", "opp_archetype"]
    per_list = rows.groupBy(*keys, "deck_id").agg(*record())
    total = per_list.groupBy(*keys).agg(F.sum("wins").alias("w"), F.sum("matches").alias("n"))
    inside = per_list.join(x.select("group", "deck_id", "card"), ["group", "deck_id"]).groupBy(*keys, "card").agg(F.sum("wins").alias("wins_with"), F.sum("matches").alias("matches_with"))
    out = inside.join(total, keys).withColumns({"wins_without": F.col("w") - F.col("wins_with"), "matches_without": F.col("n") - F.col("matches_with")}).filter((F.col("matches_with") >= least) & (F.col("matches_without") >= least)).drop("w", "n")
    sides = [F.col(c) for c in ("wins_with", "matches_with", "wins_without", "matches_without")]
    low, high = newcombe(*sides)
    return out.withColumns({"delta": sides[0] / sides[1] - sides[2] / sides[3], "low": low, "high": high})


def surest_opponents(rows: DataFrame, sd: Column | None = None, least: int = MU_MIN_MATCHES, top: int = MU_TOP) -> DataFrame:
    """The opponents that a card helps and hurts most surely, ``top`` each way.

    ``rows`` come from ``with_against_without(by_opponent=True)``. The score is the
    difference over its half width, widened by ``sd`` where given.
    """
    width = (F.col("high") - F.col("low")) / 2
    half = F.hypot(width, F.lit(Z) * sd) if sd is not None else width
    scored = rows.filter((F.col("matches_with") >= least) & (F.col("matches_without") >= least)).withColumn("score", F.round(F.col("delta") / F.greatest(half, F.lit(1e-9)), 9))
    over = W.partitionBy("group", "card")
    ranked = scored.withColumns({"best": F.row_number().over(over.orderBy(F.desc("score"), "opp_archetype")), "worst": F.row_number().over(over.orderBy("score", F.desc("opp_archetype")))})
    better, worse = (F.col("score") > 0) & (F.col("best") <= top), (F.col("score") < 0) & (F.col("worst") <= top)
    return ranked.filter(better | worse).select("group", "card", "opp_archetype", "wins_with", "matches_with", "wins_without", "matches_without", "score", F.when(better, "best").otherwise("worst").alias("side"))


def copy_distribution(lists: DataFrame, x: DataFrame, most: int = 4) -> DataFrame:
    """``group, card, copies, share`` with all counts from ``most`` up together."""
    return options(lists, x, 0.0).groupBy("group", "card", F.least("copies", F.lit(most).cast("long")).alias("copies")).agg(F.sum("share").alias("share"))


def tiers(lists: DataFrame, x: DataFrame) -> DataFrame:
    """``group, card, tier, play_rate, avg_copies, varies``: core, flex or spice.

    Core is played by ``CORE`` of the lists and varies if its modal count among them has less
    than 0.75; flex by 8 % and five lists; spice by three. The rest is left out.
    """
    per = x.groupBy("group", "card", "count").agg(F.count(F.lit(1)).alias("n")).groupBy("group", "card").agg(F.sum("n").alias("p"), F.max("n").alias("m"), (F.sum(F.col("count") * F.col("n")) / F.sum("n")).alias("avg_copies"))
    per = per.join(sizes(lists), "group").withColumn("play_rate", F.col("p") / F.col("lists"))
    tier = F.when(F.col("play_rate") >= CORE, "core").when((F.col("play_rate") >= 0.08) & (F.col("p") >= 5), "flex").when(F.col("p") >= 3, "spice")
    return per.withColumn("tier", tier).filter("tier is not null").select("group", "card", "tier", "play_rate", "avg_copies", ((F.col("tier") == "core") & (F.col("m") / F.col("p") < 0.75)).alias("varies"))


def count_choice(lists: DataFrame, x: DataFrame, tallies: DataFrame, replicates: int = 0) -> DataFrame:
    """For cards that nearly all play in different numbers: the two highest listed copy counts compared.

    ``group, card, more, fewer`` and the columns of ``records.against``, lists with more
    copies first. Counts in less than ``MIN_OPTION`` of the lists are not listed.
    """
    counted = kinds(lists, x).filter("kind = 'count'").select("group", "card")
    listed = options(lists, x, MIN_OPTION).join(counted, ["group", "card"])
    high = F.row_number().over(W.partitionBy("group", "card").orderBy(F.desc("copies")))
    two = listed.filter("copies > 0").withColumn("place", high).filter("place <= 2").groupBy("group", "card").agg(F.max("copies").alias("more"), F.min("copies").alias("fewer")).filter("more > fewer")
    held = x.join(two, ["group", "card"])
    keys = ["group", "card", "more", "fewer"]
    side = lambda c: records.of(held.filter(F.col("count") == F.col(c)).select(*keys, "deck_id"), tallies, keys, replicates)
    return records.against(side("more"), side("fewer"), keys)


def option_sides(lists: DataFrame, x: DataFrame, tallies: DataFrame, replicates: int = 0, *, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, comparisons with the group's other lists) of every option of the cards that vary.

    Options are the listed copy counts of a count card, 0 included, and yes and no of an
    in-or-out card: ``group, card, option, share``. With ``by`` (a column of the tallies) the
    comparisons are per value of it, those of "no" left out, for they mirror "yes". Lists
    that do not play a card are the group less those that do.
    """
    kind = _varying(kinds(lists, x))
    also = [by] if by else []
    everyone = records.of(lists.select("group", "deck_id"), tallies, ["group", *also], replicates)
    own = records.of(_players(x, kind), tallies, ["group", "card", "option", *also], replicates)
    sides = _sides(kind, options(lists, x, MIN_OPTION), own, everyone, replicates, by)
    return records.shown(sides), _compared(sides, everyone, by)


def surest_options(lists: DataFrame, x: DataFrame, nm: DataFrame, pilot) -> DataFrame:
    """Every option of ``option_sides`` against the group's other lists, pilots taken out.

    Columns are those of ``records.against`` with opp_archetype, score and side: a row without
    opp_archetype compares over all opponents, unknown ones included, and has no score and no
    side; the others are the known opponents where ``records.surest`` finds the option to do
    best and worst. ``nm`` are non-mirror rows with lists. Lifts are added up once, per option
    and opponent, and no list carries its replicates.
    """
    every = lineage.cut(options(lists, x, 0.0))  # as all that is cut here, referred to several times
    kind = lineage.cut(_varying(_kinds(every)))
    everyone = lists.select("group", F.lit("").alias("card"), F.lit("").alias("option"), "deck_id")  # no option has this name
    sets = _players(x, kind).unionByName(everyone)
    rows = lineage.cut(sets.join(nm.select("match_id", "side", "deck_id", "opp_archetype", "score"), "deck_id").drop("deck_id"))
    tallies = lineage.cut(records.of_rows(rows, pilot, ["group", "card", "option", "opp_archetype"]))

    def compared(tallies: DataFrame, by: str | None) -> DataFrame:
        also = [by] if by else []
        own, everyone = tallies.filter("option <> ''"), tallies.filter("option = ''")
        own, everyone = (lineage.cut(records.summed(t, [*k, *also], pilot.replicates, few=True)) for t, k in ((own, ["group", "card", "option"]), (everyone, ["group"])))
        sides = _sides(kind, every.filter(F.col("share") >= MIN_OPTION), own, everyone, pilot.replicates, by)
        return _compared(lineage.cut(sides), everyone, by)

    met = records.surest(compared(known_opponent(tallies), "opp_archetype"), ["group", "card", "option"])
    none = F.lit(None)
    overall = compared(tallies, None).withColumns({"opp_archetype": none.cast("string"), "score": none.cast("double"), "side": none.cast("string")})
    return overall.select(met.columns).unionByName(met)


def _varying(kind: DataFrame) -> DataFrame:
    return kind.filter("kind <> 'fixed' and play_rate >= 0.03").select("group", "card", "kind", "play_rate")


def _players(x: DataFrame, kind: DataFrame) -> DataFrame:
    """``group, card, option, deck_id`` of the lists that play a card that varies."""
    label = F.when(F.col("kind") == "count", F.col("count").cast("string")).otherwise("yes")
    return x.join(kind, ["group", "card"]).select("group", "card", label.alias("option"), "deck_id")


def _sides(kind: DataFrame, listed: DataFrame, own: DataFrame, everyone: DataFrame, replicates: int, by: str | None) -> DataFrame:
    """Tallies of all options with their shares, from those of the options that are played and of whole groups."""
    also = [by] if by else []
    playing = records.summed(own, ["group", "card", *also], replicates, few=True).join(kind.select("group", "card", "kind"), ["group", "card"])
    absent = records.outside(playing, everyone, ["group", *also]).withColumn("option", F.when(F.col("kind") == "count", "0").otherwise("no"))
    listed = listed.join(kind.filter("kind = 'count'"), ["group", "card"]).select("group", "card", F.col("copies").cast("string").alias("option"), "share")
    both = F.explode(F.array(F.struct(F.lit("yes").alias("option"), F.col("play_rate").alias("share")), F.struct(F.lit("no").alias("option"), (1 - F.col("play_rate")).alias("share"))))
    listed = listed.unionByName(kind.filter("kind = 'inout'").select("group", "card", both.alias("o")).select("group", "card", "o.*"))
    return own.unionByName(absent.drop("kind")).join(listed, ["group", "card", "option"])


def _compared(sides: DataFrame, everyone: DataFrame, by: str | None) -> DataFrame:
    also = [by] if by else []
    compared = sides if not by else sides.filter("option <> 'no'")
    return records.against(compared, records.outside(compared, everyone, ["group", *also]), ["group", "card", "option", "share", *also])
