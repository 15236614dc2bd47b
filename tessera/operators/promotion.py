"""Abilities promoted to the leaf that they are nearest to, unless one of the gates refuses.

Evidence of a leaf is counted from its members in three aggregates: shares of the terms that a token can't see (zones, players, counters), members by token set, and by token set and
signature.  Candidates meet these counts in joins on the leaf; no leaf's members come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the gates, effect types that tokens tell too little about, terms that they don't see.
THRESHOLD, MIN_TOKENS, MAX_LEAF, GENERIC_LEAF, BLIND_SHARE, MIN_SHARE = 0.90, 3, 300, 500, 0.20, 0.15
EXCLUDED = ["ChangeZone", "ChangeZoneAll", "Bounce", "Discard", "Counter", "PutCounter", "PutCounterAll", "RemoveCounter", "MoveCounters", "MultiplyCounter", "GivePlayerCounter"]
ZONES = ["graveyard", "exile", "library", "battlefield", "hand"]
PLAYERS = ["opponent", "each player", "target player", "that player"]
COUNTER = r"([+-]\d+/[+-]\d+|[a-z]+) counters?\b"
NO_COUNTER = "a an the that those any each one more of this target no all other another its their your two three x not to and or you it spell can't cannot unless then if".split() + ["+1/+1"]


def blind_terms(text: Column) -> Column:
    """Zones, players and kinds of counters that a text names."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = [F.when(low.rlike(rf"\b{w}"), F.lit(f"{kind}:{w}")) for kind, words in (("zone", ZONES), ("player", PLAYERS)) for w in words]
    counters = F.filter(F.regexp_extract_all(low, F.lit(COUNTER), F.lit(1)), lambda w: ~w.isin(NO_COUNTER))
    return F.array_distinct(F.concat(F.array_compact(F.array(*named)), F.transform(counters, lambda w: F.concat(F.lit("counter:"), w))))


def nearest_leaf(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(item, leaf, score): the leaf of the nearest centroid (leaf, token, w) by the tokens that it shares with an item (item, token, w); ties by leaf."""
    dots = vectors.join(centroids.select("leaf", "token", F.col("w").alias("c")), "token").groupBy("item", "leaf").agg(F.sum(F.col("w") * F.col("c")).alias("s"))
    best = dots.groupBy("item").agg(F.min_by(F.struct("leaf", "s"), F.struct(-F.round("s", 9), F.col("leaf"))).alias("b"))
    return best.select("item", "b.leaf", F.col("b.s").alias("score"))


def gates(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """(item, leaf, gate) of candidates: the first gate that refuses, null where none does.

    candidates: item, leaf, score, tokens (sorted), signature, text, type, scoped, modal, flagged; members: leaf, item, tokens (sorted), signature, text."""
    key = lambda: F.array_join("tokens", "\n").alias("key")
    sizes = members.groupBy("leaf").agg(F.count_distinct("item").alias("size"))
    said = members.select("leaf", "item", F.explode(blind_terms(F.col("text"))).alias("term")).groupBy("leaf", "term").agg(F.count_distinct("item").alias("n"))
    usual = said.join(sizes, "leaf").where(F.col("n") >= BLIND_SHARE * F.col("size")).select("leaf", "term", F.lit(True).alias("usual"))
    same = members.where(F.size("tokens") > 0).select("leaf", key(), "signature").groupBy("leaf", "key", "signature").agg(F.count(F.lit(1)).alias("k"))
    every = same.groupBy("leaf", "key").agg(F.sum("k").alias("all"))
    odd = candidates.select("item", "leaf", F.explode(blind_terms(F.col("text"))).alias("term")).join(usual, ["leaf", "term"], "left").where("usual is null").select("item", F.lit(True).alias("odd")).distinct()
    x = candidates.withColumn("key", F.array_join("tokens", "\n")).join(sizes, "leaf", "left").join(odd, "item", "left").join(every, ["leaf", "key"], "left").join(same, ["leaf", "key", "signature"], "left")
    n, size = F.size("tokens"), F.coalesce("size", F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    k, seen = F.coalesce("k", F.lit(0)), F.coalesce("all", F.lit(0))
    gate = (
        F.when(n == 0, "no_tokens")
        .when(F.coalesce("score", F.lit(0.0)) < THRESHOLD, "below")
        .when((n == 1) | (size >= GENERIC_LEAF), "generic_leaf")
        .when((n < MIN_TOKENS) | (size > MAX_LEAF), "in_between")
        .when(F.trim(F.coalesce("text", F.lit(""))) == "", "no_text")
        .when(yes("flagged"), "flagged")
        .when(yes("modal"), "modal")
        .when(F.col("type").isin(EXCLUDED) | yes("scoped"), "type")
        .when(yes("odd"), "wording")
        .when(seen < 2, "structure_unknown")
        .when((k < 2) | (k < MIN_SHARE * seen), "structure")
    )
    return x.select("item", "leaf", gate.alias("gate"))
