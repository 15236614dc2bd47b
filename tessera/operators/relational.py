"""Relational building blocks: encoding, overlays, ranks, fusion, facets, sections, comparison of builds."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dictionary_encode(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with their place in sorted order and their count; values are few, as they are facets."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("code", (F.row_number().over(Window.orderBy(value)) - 1).cast("int"))


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """df, failing on a key that occurs twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn("__n", n).withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.col(key).cast("string")))).otherwise(F.col("__n"))).where("__n >= 1").drop("__n")


def overlay_replace(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of base with the values of over where it has the key; a null of over leaves the value, a key that base lacks is an error."""
    own = [c for c in over.columns if c != key]
    joined = base.withColumn("__base", F.lit(True)).join(over.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in own]), F.col(key) == F.col("__key"), "full")
    known = F.when(F.col("__base").isNull(), F.raise_error(F.concat(F.lit("overlay of an unknown key "), F.coalesce(F.col("__key").cast("string"), F.lit("null")))).cast("boolean")).otherwise(True)
    return joined.where(known).select(*[F.coalesce(f"__{c}", c).alias(c) if c in own else F.col(c) for c in base.columns])


def missing_keys(over: DataFrame, base: DataFrame, key: str) -> DataFrame:
    return over.join(base.select(key), key, "left_anti")


def dedup_first(df: DataFrame, key: Column, order: list[Column], text: str, owner: str) -> DataFrame:
    """One row per key: first text in order, number of occurrences, owners."""
    return df.groupBy(key.alias("effect_id")).agg(F.min_by(text, F.struct(*order)).alias("raw_text"), F.count(F.lit(1)).alias("occurrence_count"), F.array_sort(F.collect_set(owner)).alias("owners"))


def competition_rank(df: DataFrame, score: str, by: list[str] | None = None, digits: int = 9) -> DataFrame:
    """1, 1, 3 ranks by descending score; scores equal to digits tie.

    Without by all rows are one list, too long for one task at scale: scores fall into steps of a sixteenth of an octave,
    of which there are a few hundred; ranks are counted within steps and moved by the rows of all higher ones.
    """
    value = F.round(score, digits)
    if by:
        return df.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(value.desc())))
    octave = lambda x: F.floor(F.log2(x) * 16)
    step = F.when(value > 0, octave(value)).when(value < 0, -200_000 - octave(-value)).otherwise(-100_000)
    stepped = df.withColumn("__step", step)
    counts = stepped.groupBy("__step").agg(F.count(F.lit(1)).alias("n"))
    above = counts.select("__step", (F.sum("n").over(Window.orderBy(F.desc("__step"))) - F.col("n")).alias("__above"))
    inside = F.rank().over(Window.partitionBy("__step").orderBy(value.desc()))
    return stepped.join(F.broadcast(above), "__step").withColumn("rank", (inside + F.col("__above")).cast("long")).drop("__step", "__above")


def fuse_ranks(ranked: list[DataFrame], item: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + rank)."""
    parts = reduce(lambda a, b: a.unionByName(b), [r.select(item, "rank") for r in ranked])
    return parts.groupBy(item).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def max_with_arg(df: DataFrame, group: str, score: str, arg: str, order: str) -> DataFrame:
    """Greatest score of a group and what has it; ties go to the first in order."""
    best = F.max_by(F.struct(F.col(score), F.col(arg)), F.struct(F.col(score), -F.col(order))).alias("b")
    return df.groupBy(group).agg(best).select(group, F.col(f"b.{score}").alias(score), F.col(f"b.{arg}").alias(arg))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each step of a chain of filters, in one pass: columns step names."""
    passed, out = F.lit(True), []
    for name, test in steps:
        passed = passed & F.coalesce(test, F.lit(False))
        out.append(F.count_if(passed).alias(name))
    return df.agg(*out)


def facet_counts(df: DataFrame, filters: dict[str, Column], facets: dict[str, str]) -> DataFrame:
    """Counts of each facet's values over rows that pass all other filters (facet, value, n)."""
    keep = {name: reduce(lambda a, b: a & b, [t for k, t in filters.items() if k != name], F.lit(True)) for name in facets}
    rows = F.explode(F.array(*[F.when(F.coalesce(keep[n], F.lit(False)), F.struct(F.lit(n).alias("facet"), F.col(c).cast("string").alias("value"))) for n, c in facets.items()])).alias("f")
    return df.select(rows).where("f is not null").groupBy(F.col("f.facet").alias("facet"), F.col("f.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def union_pages(rows: DataFrame, item: str, section: str) -> DataFrame:
    """Each item once, in the section of least number, with the later ones as also."""
    groups = rows.select(item, section).distinct().groupBy(item).agg(F.array_sort(F.collect_list(section)).alias("s"))
    return groups.select(item, F.col("s")[0].alias("section"), F.expr("slice(s, 2, size(s))").alias("also"))


def collisions(df: DataFrame, name: str, ident: str) -> DataFrame:
    """Names with several ids: number of ids and the one that is kept (the least)."""
    return df.groupBy(name).agg(F.count_distinct(ident).alias("ids"), F.min(ident).alias("kept")).where("ids > 1")


def compare_builds(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """Full join of two builds: same, moved, added or lost."""
    a = old.select(*key, F.col(value).alias("before"), F.lit(True).alias("__a"))
    b = new.select(*key, F.col(value).alias("after"), F.lit(True).alias("__b"))
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "lost").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("moved")
    return a.join(b, key, "full").select(*key, "before", "after", state.alias("state"))


def first_cause(causes: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first cause that holds, and all that do."""
    first = F.coalesce(*[F.when(t, F.lit(n)) for n, t in causes])
    every = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in causes]))
    return first, every


def share_threshold(df: DataFrame, group: str, fact: str, item: str, least: float) -> DataFrame:
    """Facts that at least this share of a group's items has; the share counts as the decimal number that is written, not as the double beside it."""
    size = df.groupBy(group).agg(F.count_distinct(item).alias("size"))
    facts = df.groupBy(group, fact).agg(F.count_distinct(item).alias("n"))
    return facts.join(size, group).where(F.col("n") >= F.lit(Decimal(str(least))) * F.col("size")).select(group, fact, "n", "size")


def quantiles(df: DataFrame, group: str, value: str, at: dict[str, float]) -> DataFrame:
    """Per group the exact quantiles of a number, interpolated between neighbours, named by at; nulls don't count.

    Values are counted in steps of 1/2048 of an octave; only steps that hold a place which is asked for are looked at value by value.
    """
    v = F.col(value).cast("double")
    octave = lambda x: F.floor(F.least(F.log2(x) * 2048, F.lit(3e6)))  # noqa: E731  infinity has a step of its own
    step = F.when(F.isnan(v), 9_000_000).when(v > 0, octave(v)).when(v < 0, -9_000_000 - octave(-v)).otherwise(-4_000_000)
    rows = df.where(v.isNotNull()).select(F.col(group).alias("g"), v.alias("v"), step.alias("step"))
    counts = rows.groupBy("g", "step").agg(F.count(F.lit(1)).alias("n"))
    whole, upto = Window.partitionBy("g"), Window.partitionBy("g").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"total": F.sum("n").over(whole), "before": F.sum("n").over(upto) - F.col("n")})
    exact = {name: (F.col("total") - 1) * F.lit(float(q)) for name, q in at.items()}
    places = F.array(*[F.struct(F.lit(name).alias("name"), near(x).cast("long").alias("place"), (x - F.floor(x)).alias("part")) for name, x in exact.items() for near in (F.floor, F.ceil)])
    here = F.filter(F.array_distinct(places), lambda p: (p["place"] >= F.col("before")) & (p["place"] < F.col("before") + F.col("n")))
    wanted = counts.select("g", "step", "before", F.explode(here).alias("p")).select("g", "step", "before", "p.*")
    a, b = rows.alias("a"), wanted.select("g", "step", "before").distinct().alias("b")
    found = a.join(b, F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.step") == F.col("b.step"))).groupBy("a.g", "a.step", "b.before", "a.v").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("g", "step").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("first", F.col("before") + F.sum("n").over(inside) - F.col("n")).alias("f")
    same = F.col("f.g").eqNullSafe(F.col("w.g")) & (F.col("f.step") == F.col("w.step")) & (F.col("w.place") >= F.col("f.first")) & (F.col("w.place") < F.col("f.first") + F.col("f.n"))
    ends = found.join(wanted.alias("w"), same).groupBy("f.g", "w.name").agg(F.min_by("f.v", "w.place").alias("low"), F.max_by("f.v", "w.place").alias("high"), F.max("w.part").alias("part"))
    ends = ends.withColumn("q", F.when(F.col("part") == 0, F.col("low")).otherwise((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high")))
    ends = ends.groupBy("g").agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in at]).alias("e")
    groups = df.select(group).distinct().alias("d")
    return groups.join(ends, F.col(f"d.{group}").eqNullSafe(F.col("e.g")), "left").select(F.col(f"d.{group}").alias(group), *at)


def histogram(df: DataFrame, group: str, value: str, bins: int, name: str) -> DataFrame:
    """Per group how many values fall into each of the bins, as an array named name; null, NaN and infinity fall into none.

    Bins are of one width and the same for all groups, from the least to the greatest value of all, which is in the last bin; if all values are one, it is in the bin past the middle.
    """
    v = F.col(value).cast("double")
    rows = df.select(group, F.when(F.abs(v) < float("inf"), v).alias("v"))
    ends = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    at = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
    place = F.when(F.col("v").isNull(), None).when(F.col("high") > F.col("low"), at).otherwise(bins // 2)
    placed = rows.crossJoin(F.broadcast(ends)).select(group, place.alias("place"))
    return placed.groupBy(group).agg(F.array(*[F.count_if(F.col("place") == i) for i in range(bins)]).alias(name))
