"""Loose groups: fields of a signature taken away until a group is large enough, large groups split again, small remains folded.

Each family has its own fields, most important first.  Rows whose whole key has fewer than LEAST cards lose its last field, and so on down to the effect type; groups of more than OVER
cards are then split by further fields, in order, into parts that have LEAST cards or more, as long as a field can split them; what stays below LEAST goes to one
bucket a family.  Counts are of distinct cards, summed before the shuffle; there are as many rounds as fields, and each round writes its keys once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stored

LEAST, OVER, WIDE = 10, 50, 100


def _by_family(lists: dict[str, list[str]], default: list[str], k: int) -> tuple[Column, Column]:
    """(name, value) of the k-th field of a row's family; null beyond its fields."""
    cases = {f: fields[k] for f, fields in lists.items() if len(fields) > k}
    name = value = None
    for family, field in cases.items():
        at = F.col("family") == family
        name = F.when(at, F.lit(field)) if name is None else name.when(at, F.lit(field))
        value = F.when(at, F.col(field)) if value is None else value.when(at, F.col(field))
    rest = ~F.col("family").isin(list(lists)) if lists else F.lit(True)
    if len(default) > k:
        name = F.when(rest, F.lit(default[k])) if name is None else name.when(rest, F.lit(default[k]))
        value = F.when(rest, F.col(default[k])) if value is None else value.when(rest, F.col(default[k]))
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if name is None else (name, value)


def _cards(rows: DataFrame, key: str) -> DataFrame:
    """(key, cards): distinct cards of each key."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("card").alias("cards"))


def _marked(rows: DataFrame, key: str, keys: DataFrame, mark: str) -> DataFrame:
    """rows with a mark where their key is one of keys; rows without a key meet nothing, each in a place of its own, so that they are no hot key."""
    own = F.coalesce(F.col(key), F.concat(F.lit("\0"), F.col("item").cast("string")))
    return rows.withColumn("__at", own).join(keys.select(F.col(key).alias("__at"), F.lit(True).alias(mark)), "__at", "left").drop("__at")


def _named(name: Column, value: Column) -> Column:
    """One field of a key; its length stands before the value, so that no value runs into the next field."""
    shown = F.coalesce(value, F.lit(""))
    return F.concat(F.lit("|"), name, F.lit("="), F.length(shown).cast("string"), F.lit(":"), shown)


def loose_groups(rows: DataFrame, fields: dict[str, list[str]], refine: dict[str, list[str]], default: list[str], least: int = LEAST, over: int = OVER) -> DataFrame:
    """(item, card, family, key, kind, cards) for rows (item, card, family, type and the fields); item is unique.  kind: group, catchall (over WIDE cards) or bucket."""
    deepest = max([len(default), *map(len, fields.values())])
    x = rows.withColumn("key", F.lit(None).cast("string")).withColumn("base", F.concat(F.col("family"), F.lit("/"), F.col("type")))
    for k in range(deepest):
        name, value = _by_family(fields, default, k)
        x = x.withColumns({f"n{k}": name, f"p{k}": F.when(name.isNotNull(), _named(name, value))})
    for level in range(deepest, -1, -1):
        whole = F.concat("base", F.lit(f"#{level}"), *[F.col(f"p{k}") for k in range(level)])  # null where the family has fewer fields
        x = stored(x.withColumn("try", F.when(F.col("key").isNull(), whole)))
        large = _cards(x, "try").where((F.col("cards") >= least) | F.lit(level == 0))
        x = _marked(x, "try", large, "ok").withColumn("key", F.coalesce("key", F.when(F.col("ok"), F.col("try")))).drop("ok", "try")
    x = x.withColumn("top", F.col("key"))
    first = True
    for k in range(max(map(len, refine.values()), default=0)):
        name, value = _by_family(refine, [], k)
        x = stored(x.withColumn("split", F.when(F.coalesce(value, F.lit("")) != "", F.concat("key", _named(name, value)))))
        if first:  # only groups that were large before any split
            x = _marked(x, "top", _cards(x, "top").where(F.col("cards") > over), "wide")
            first = False
        large, parts = _cards(x, "key").where(F.col("cards") > over), _cards(x, "split").where(F.col("cards") >= least)
        x = _marked(_marked(x, "key", large, "more"), "split", parts, "part").withColumn("key", F.when(F.col("wide") & F.col("more") & F.col("part"), F.col("split")).otherwise(F.col("key"))).drop("more", "part", "split")
    x = stored(x.select("item", "card", "family", "key"))
    small = _cards(x, "key").where(F.col("cards") < least).select("key", F.lit(True).alias("small"))
    x = stored(x.join(small, "key", "left").withColumn("key", F.when(F.col("small"), F.concat("family", F.lit("/OTHER"))).otherwise(F.col("key"))).drop("small"))
    kind = F.when(F.col("key") == F.concat("family", F.lit("/OTHER")), "bucket").when(F.col("cards") > WIDE, "catchall").otherwise("group")
    return x.join(_cards(x, "key"), "key").select("item", "card", "family", "key", kind.alias("kind"), "cards")
