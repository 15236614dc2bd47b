"""Phrases that describe a group of texts: frequent, long and not saying the same twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .stored import stored

#: Words of the shortest and longest phrase, texts that it must be in, phrases of a group.
SHORTEST, LONGEST, LEAST, MOST = 2, 12, 2, 6


def same_wording(a: Column, b: Column) -> Column:
    """Whether the longest run of words in both covers 60 % of the shorter one or more; so they share a run of just that length."""
    run = F.floor((F.least(F.size(a), F.size(b)) * 6 + 9) / 10).cast("int")
    return F.arrays_overlap(text.ngrams(a, run), text.ngrams(b, run))


def mine(rows: DataFrame, group: str, words: str, weight: str, most: int = MOST) -> DataFrame:
    """(group, phrase, n, share, place): up to most phrases of each group's texts (words, standing for weight texts each).

    Phrases of two texts or more rank by share of the texts times length, then length, then alphabet.  The best is taken and
    all with the same wording as a taken one are left out, until there are enough.  Each turn is one aggregate over
    the counted phrases, so no task holds a group.  The best comes first, the others by share.
    A text of fewer than two words has no phrase; a group without any has no row.
    """
    grams = F.array_distinct(F.flatten(F.array(*[text.ngrams(F.col(words), n) for n in range(SHORTEST, LONGEST + 1)])))
    counted = rows.select(group, weight, F.explode(grams).alias("phrase")).groupBy(group, "phrase").agg(F.sum(weight).alias("n")).where(F.col("n") >= LEAST)
    found = stored(counted.withColumn("words", F.split("phrase", " ")))
    order = F.struct((-F.col("n") * F.size("words")).alias("score"), (-F.size("words")).alias("length"), "phrase")
    pick = F.min_by(F.struct("phrase", "words", "n"), order).alias("pick")
    chosen = stored(found.groupBy(group).agg(pick).select(group, F.array("pick").alias("taken")))
    for _ in range(most - 1):
        left = found.join(chosen, group).where(~F.exists("taken", lambda t: same_wording(t["words"], F.col("words"))))
        chosen = stored(chosen.join(left.groupBy(group).agg(pick), group, "left").select(group, F.array_compact(F.array_append("taken", F.col("pick"))).alias("taken")))  # one row per group
    cards = rows.groupBy(group).agg(F.sum(weight).alias("cards"))
    listed = chosen.select(group, F.posexplode("taken").alias("turn", "p")).join(cards, group)
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("turn") > 0, F.desc("p.n"), "p.phrase"))
    return listed.select(group, "p.phrase", "p.n", (F.col("p.n") / F.col("cards")).alias("share"), place.cast("long").alias("place"))
