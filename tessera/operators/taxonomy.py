"""Signature taxonomy: rarest-field-first backoff, fixed levels, folds, leaves and their tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signature(fields: list[str], dropped: Column | None = None) -> Column:
    """Fields with a value as name=value, in order, those of a dropped array left out."""
    parts = []
    for f in fields:
        shown = F.concat(F.lit(f"{f}="), F.col(f).cast("string"))
        keep = (F.coalesce(F.col(f).cast("string"), F.lit("")) != "") & (~F.array_contains(dropped, F.lit(f)) if dropped is not None else F.lit(True))
        parts.append(F.when(keep, shown))
    return F.concat_ws(";", *parts)


def rarity(reference: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """(kind, field, value, n) of each field's values in the reference rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in fields])).alias("c")
    return reference.select(F.col(kind).alias("kind"), cells).groupBy("kind", "c.field", "c.value").agg(F.count(F.lit(1)).alias("n"))


def backoff_rarest(reference: DataFrame, target: DataFrame, item: str, kind: str, fields: list[str], guarded: str | None = None, least: int = 5) -> DataFrame:
    """Each target row's finest signature that least reference rows share: (item, signature, level, n), null if none does.

    Fields are dropped by rarity of their value within the kind, ties in the order of fields; the guarded
    field stays if nothing else has a value.  As rarity is fixed, so is each row's order of drops: a row
    yields its prefixes, a reference count per set of dropped fields decides, and no loop is needed.  Reference
    rows are counted once per distinct set, of which there are far fewer than rows.
    """
    text = lambda f: F.coalesce(F.col(f).cast("string"), F.lit(""))
    rows = target.select(F.col(item).alias("item"), F.col(kind).alias("kind"), *[text(f).alias(f) for f in fields])
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f).alias("field"), F.col(f).alias("value")) for i, f in enumerate(fields)])).alias("c")
    cells = rows.select("item", "kind", values).select("item", "kind", "c.place", "c.field", "c.value").where("value <> ''")
    cells = cells.join(rarity(reference, kind, fields), ["kind", "field", "value"], "left")
    order = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "field"))), lambda c: c["field"])
    drops = cells.groupBy("item").agg(order.alias("drops"))
    rows = rows.join(drops, "item", "left").withColumn("drops", F.coalesce("drops", F.array().cast("array<string>")))
    if guarded:
        alone = reduce(lambda a, b: a & b, [F.col(f) == "" for f in fields if f != guarded], F.lit(True))
        rows = rows.withColumn("drops", F.when(alone, F.array_remove("drops", guarded)).otherwise(F.col("drops")))
    steps = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.size("drops")))).withColumn("dropped", F.array_sort(F.slice("drops", F.lit(1), F.col("level"))))
    masks = steps.select("kind", "dropped").distinct()
    whole = reference.select(F.col(kind).alias("kind"), *[text(f).alias(f) for f in fields]).groupBy("kind", *fields).agg(F.count(F.lit(1)).alias("rows"))
    masked = lambda f: F.when(F.array_contains("dropped", F.lit(f)), "").otherwise(F.col(f)).alias(f)
    # a distinct reference signature meets the sets of dropped fields that occur in its own kind; Spark sends these only if their size allows it
    counts = whole.join(masks, "kind").select("dropped", "kind", "rows", *[masked(f) for f in fields]).groupBy("dropped", "kind", *fields).agg(F.sum("rows").alias("n"))
    keyed = steps.select("item", "level", "dropped", "kind", *[masked(f) for f in fields])
    found = keyed.join(counts, ["dropped", "kind", *fields]).where(F.col("n") >= least)
    best = found.groupBy("item").agg(F.min_by(F.struct("level", "n", *fields), "level").alias("b"))
    best = best.select("item", "b.*").select("item", "level", "n", signature(fields).alias("signature"))
    return rows.select("item", "kind").join(best, "item", "left")


def backoff_levels(rows: DataFrame, item: str, levels: list[list[str]], least: int) -> DataFrame:
    """The first of fixed levels (lists of columns, finest first) that least rows share."""
    for i, fields in enumerate(levels):
        rows = rows.withColumn(f"__n{i}", F.count(F.lit(1)).over(Window.partitionBy(*fields)))
    level = F.coalesce(*[F.when(F.col(f"__n{i}") >= least, i) for i in range(len(levels))])
    return rows.select(item, level.alias("level"))


def cap_fold(rows: DataFrame, kind: str, field: str, least: int) -> DataFrame:
    """A field's values that a kind has fewer than least times become other."""
    n = F.count(F.lit(1)).over(Window.partitionBy(kind, field))
    return rows.withColumn(field, F.when(n < least, "other").otherwise(F.col(field)))


def tree_rollup(members: DataFrame, family: str, node: str, leaf: str, item: str, hide: int = 5, roll: int = 10) -> DataFrame:
    """Distinct items of leaves, nodes and families in one pass, and what becomes of small leaves."""
    out = members.groupingSets([[family], [family, node], [family, node, leaf]], family, node, leaf).agg(F.grouping_id(family, node, leaf).alias("g"), F.count_distinct(item).alias("n"))
    shown = F.when(F.col("g") > 0, "total").when(F.col("n") < hide, "hidden").when(F.col("n") < roll, "rolled up").otherwise("shown")
    return out.select(family, node, leaf, "n", shown.alias("state"))


def sibling_rule(leaves: DataFrame, items: DataFrame, leaf: str, item: str, fields: str) -> DataFrame:
    """Items whose set of fields is that of exactly one leaf."""
    key = F.array_join(F.array_sort(fields), ";")
    one = leaves.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.first(leaf).alias(leaf)).where("n = 1")
    return items.withColumn("key", key).join(one.select("key", leaf), "key").select(item, leaf)
