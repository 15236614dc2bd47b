"""Hand edits as an event log: latest wins, resolved against a build, applied in whole batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(edits: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last edit of each key; clear removes it."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return edits.withColumn("__n", F.row_number().over(w)).where("__n = 1 and action <> 'clear'").drop("__n")


def resolve(edits: DataFrame, members: DataFrame, items: DataFrame, groups: DataFrame) -> DataFrame:
    """(oid, gid, action, state): add, remove, mark, orphan, redundant or stale against members (oid, gid)."""
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    x = edits.join(flag(items.select("oid"), "__i"), "oid", "left").join(flag(groups.select("gid"), "__g"), "gid", "left").join(flag(members.select("oid", "gid"), "__m"), ["oid", "gid"], "left")
    state = (
        F.when(F.col("__i").isNull() | F.col("__g").isNull(), "orphan")
        .when((F.col("action") == "add") & F.col("__m").isNotNull(), "redundant")
        .when((F.col("action") == "remove") & F.col("__m").isNull(), "stale")
        .when(F.col("action") == "nofit", "mark")
        .otherwise(F.col("action"))
    )
    return x.select("oid", "gid", "action", state.alias("state"))


def effective(members: DataFrame, resolved: DataFrame) -> DataFrame:
    """Members after adds and removes."""
    out = members.select("oid", "gid").join(resolved.where("state = 'remove'").select("oid", "gid"), ["oid", "gid"], "left_anti")
    return out.unionByName(resolved.where("state = 'add'").select("oid", "gid")).distinct()


def _counted(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with the number of rows of equal keys, nulls being equal; summed before the shuffle, so a frequent key is no task's load."""
    counts = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias(name))
    if not keys:
        return rows.join(F.broadcast(counts))  # one row
    return rows.join(counts, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*[f"__{k}" for k in keys])


def batch_errors(batch: DataFrame, known: DataFrame, most: int = 100, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, oid, gid, error) of a batch's bad rows: too many rows, a pair twice, an unknown item, a score out of 0 to 1.

    Rows of equal values in by are one batch; without by all rows are.
    """
    x = batch.join(known.select("oid").distinct().withColumn("__k", F.lit(True)), "oid", "left")
    x = _counted(_counted(x, list(by), "__n"), [*by, "oid", "gid"], "__t")
    error = F.when(F.col("__n") > most, "too many").when(F.col("__t") > 1, "duplicate").when(F.col("__k").isNull(), "unknown").when(~F.coalesce(F.col("score").between(0, 1), F.lit(False)), "score")
    return x.select(*by, "oid", "gid", error.alias("error")).where("error is not null")


def apply_batch(edits: DataFrame, batch: DataFrame, known: DataFrame) -> DataFrame:
    """edits and the batch, or edits alone if any of its rows is bad: all or nothing."""
    bad = batch_errors(batch, known).agg(F.count(F.lit(1)).alias("bad"))
    good = batch.join(F.broadcast(bad), how="inner", on=F.col("bad") == 0).select("oid", "gid", "action")
    return edits.select("oid", "gid", "action").unionByName(good).distinct()
