"""Tags rolled up to their roots along any number of parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored


def roots(tags: DataFrame) -> DataFrame:
    """(tag, root, depth) for tags (tag, parents): every tag without known parents that a tag reaches, and by how many steps at least.

    Parents that are no tags count nowhere; a tag that reaches no root, as in a ring, is its own.  A round follows the pairs that are new, so rounds are as many
    as the longest of the shortest ways, and rings end."""
    known = stored(tags.select("tag", "parents").dropDuplicates(["tag"]))
    up = known.select("tag", F.explode("parents").alias("parent")).join(known.select(F.col("tag").alias("parent")), "parent", "left_semi").distinct()
    up = stored(up)
    reach = new = stored(known.select("tag", F.col("tag").alias("at"), F.lit(0).alias("depth")))
    step = 0
    while True:
        step += 1
        new = new.join(up.withColumnsRenamed({"tag": "at", "parent": "next"}), "at").select("tag", F.col("next").alias("at")).distinct()
        new = stored(new.join(reach.select("tag", "at"), ["tag", "at"], "left_anti").withColumn("depth", F.lit(step)))
        if not new.limit(1).count():
            break
        reach = stored(reach.unionByName(new))
    top = known.join(up.select("tag"), "tag", "left_anti").select(F.col("tag").alias("at"))
    found = reach.join(top, "at").select("tag", F.col("at").alias("root"), "depth")
    alone = known.join(found.select("tag"), "tag", "left_anti").select("tag", F.col("tag").alias("root"), F.lit(0).alias("depth"))
    return found.unionByName(alone)


def rollup(items: DataFrame, rooted: DataFrame) -> DataFrame:
    """(root, tags, items, depth): tags below a root, and distinct items (item, tag) of these."""
    size = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("tags"), F.max("depth").alias("depth"))
    held = items.join(rooted.select("tag", "root"), "tag").groupBy("root").agg(F.count_distinct("item").alias("items"))
    return size.join(held, "root", "left").select("root", "tags", F.coalesce("items", F.lit(0)).alias("items"), "depth")
