"""Ranked search over groups and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import osa_distance
from ..functions.text import fold


def did_you_mean(words: DataFrame, vocabulary: DataFrame, real: DataFrame | None = None) -> DataFrame:
    """(word, suggestion): for words (word) that are not known, the nearest of vocabulary (term, n): one change up to 7
    letters, else two, and the same first letter or its first two swapped; nearest, then most frequent, then first."""
    odd = words.select("word").distinct().where((F.length("word") >= 4) & ~F.col("word").rlike("[0-9]"))
    odd = odd.join(vocabulary.select(F.col("term").alias("word")), "word", "left_anti")
    if real is not None:
        odd = odd.join(real.select("word"), "word", "left_anti")
    most = F.when(F.length("word") <= 7, 1).otherwise(2)
    heads = lambda c: F.array_distinct(F.array(F.substring(c, 1, 1), F.substring(c, 2, 1)))
    left = odd.withColumn("head", F.explode(heads("word")))
    right = vocabulary.withColumn("head", F.substring("term", 1, 1))
    near = left.join(right, "head").where(F.abs(F.length("word") - F.length("term")) <= most)
    near = near.where((F.substring("word", 1, 1) == F.substring("term", 1, 1)) | ((F.substring("word", 1, 1) == F.substring("term", 2, 1)) & (F.substring("word", 2, 1) == F.substring("term", 1, 1))))
    near = near.withColumn("d", osa_distance(2)("word", "term")).where(F.col("d") <= most)
    place = F.row_number().over(Window.partitionBy("word").orderBy("d", F.desc("n"), "term"))
    return near.withColumn("place", place).where("place = 1").select("word", F.col("term").alias("suggestion"), "d")


def find_name(names: DataFrame, query: str, limit: int = 40) -> DataFrame:
    """Names (id, name; faces and other if there are) by exact, prefix, word prefix, inner match of a name or a face, then the sides of "A // B" that are a name.

    What is no card (other) comes after all cards; then the shorter, the first, the least id.  An empty query finds nothing."""
    extra = [c for c in ("faces", "other") if c in names.columns]
    x = names if "faces" in extra else names.withColumn("faces", F.expr("cast(array() as array<string>)"))
    x = x if "other" in extra else x.withColumn("other", F.lit(False))
    q = fold(F.lit(query))
    keys = F.transform(F.concat(F.array("name"), F.coalesce("faces", F.expr("cast(array() as array<string>)"))), fold)
    x = x.withColumn("__keys", keys)
    some = lambda test: F.exists("__keys", lambda k: F.coalesce(test(k), F.lit(False)))
    tier = F.when(some(lambda k: k == q), 0).when(some(lambda k: k.startswith(q)), 1).when(some(lambda k: F.contains(F.concat(F.lit(" "), k), F.concat(F.lit(" "), q))), 2).when(some(lambda k: F.contains(k, q)), 3)
    if "//" in query:
        for side in query.split("//"):
            p = fold(F.lit(side))
            tier = tier.when((p != "") & F.array_contains("__keys", p), 4)
    found = x.withColumn("tier", tier).where((q != "") & F.col("tier").isNotNull()).withColumn("other", F.coalesce("other", F.lit(False)))
    out = found.orderBy("other", "tier", F.length("name"), "name", "id").limit(limit)
    return out.select("id", "name", *(["other"] if "other" in extra else []), "tier")
