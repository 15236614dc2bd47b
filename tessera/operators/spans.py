"""Where an effect stands in its line: what comes before it is cut, and clauses that read as a later effect of its chain.

What reads as an effect is learned: words over-represented in lines of one effect alone, by smoothed log-odds.  Lines are cut into clauses at marks outside
quotes and brackets by a small helper; words of clauses then meet the learned words in a join, and the first clause that reads as another effect of
the chain ends the span.  A clause such as "If you do" goes with what follows.  Spans (before, own, after) partition the line; where a cut would leave nothing, none is made.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.passages import outside

#: Words of learned anchors, words that say nothing, openings of clauses that belong to the next, restrictions, bounds of the learning.
WORD = r"[a-z][a-z'\-]+"
STOP = (
    "a an the of to and or it its this that these those their them they you your each any all up for from on in into onto with at as by if then than one two three four five six x may can "
    "target card cards creature creatures player players opponent opponents control controls under his her until turn end"
).split()
LEAD_IN = r"(?i)^((if|when) (you|they|that player|he or she|its controller) (do|don't|does|doesn't|did|didn't|can't|cannot)\b.*|until (end of turn|your next turn|the end of (your|the) next turn)|this turn|for as long as .*|(then )?(if|unless) .*)$"
RESTRICTION = r"(?i)^(activate only|activate this ability only|this ability triggers only|any player may activate|spend only)"
SEPARATOR = r"\.\s+|;\s+|, then |, and | and (?!/)|, (?=[a-z])"
SUPPORT, SHARE, TOP, THRESHOLD = 5, 0.03, 25, 1.5
_CUT = "struct<start:int,end:int,how:array<string>,sentences:int,first_stop:int,parts:array<struct<s:int,e:int>>>"


def learn_anchors(samples: DataFrame) -> DataFrame:
    """(effect, word, odds): up to TOP words of each effect by how much more likely they are in its lines; samples: effect, line, name (its words don't count)."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(WORD), F.lit(0)))
    own = F.array_except(found, F.array_union(F.lit(STOP), F.regexp_extract_all(F.lower(F.coalesce("name", F.lit(""))), F.lit(WORD), F.lit(0))))
    x = samples.where("effect is not null and line is not null")
    sizes = x.groupBy("effect").agg(F.count(F.lit(1)).alias("ne"))
    total = sizes.agg(F.sum("ne").alias("all"))
    per = x.select("effect", F.explode(own).alias("word")).groupBy("effect", "word").agg(F.count(F.lit(1)).alias("c"))
    every = per.groupBy("word").agg(F.sum("c").alias("t"))
    y = per.join(sizes, "effect").join(every, "word").join(F.broadcast(total)).withColumn("no", F.col("all") - F.col("ne"))  # one row of sums
    y = y.where((F.col("ne") >= SUPPORT) & (F.col("no") > 0) & (F.col("c") >= F.greatest(F.lit(float(SUPPORT)), SHARE * F.col("ne"))))
    odds = F.log(((F.col("c") + 0.5) / (F.col("ne") + 1.0)) / ((F.col("t") - F.col("c") + 0.5) / (F.col("no") + 1.0)))
    best = y.withColumn("odds", odds).where("odds > 0").groupBy("effect").agg(F.array_sort(F.collect_list(F.struct((-F.col("odds")).alias("o"), "word"))).alias("w"))  # words of one effect with its least support
    return best.select("effect", F.explode(F.slice("w", 1, TOP)).alias("w")).select("effect", "w.word", F.round(-F.col("w.o"), 3).alias("odds"))


def cut(line: str | None, bucket: str | None) -> dict | None:
    """Bounds of a line without cost or condition and restrictions, and its clauses, as offsets."""
    if line is None:
        return None
    start, end, how = 0, len(line), []
    if bucket == "abilities":
        found = outside(line, r": ")
        if found and found[0][1] < end:
            start, how = found[0][1], ["cost"]
    elif bucket in ("triggers", "replacements") and re.match(r"(when|whenever|at|if|as)\b", line, re.I):
        found = [b for a, b in outside(line, ", ") if not re.match(r", (?:[^,]*, )?(?:or|and)\b", line[a:])]
        if found and found[0] < end:
            start, how = found[0], ["condition"]
    stops = lambda: [(start + a, start + b) for a, b in outside(line[start:end], r"\.\s+")]
    kept = end
    while (inner := stops()) and re.match(RESTRICTION, line[inner[-1][1] : end]):
        end = inner[-1][0] + 1
    if end < kept:
        how.append("restriction")
    parts, at = [], start
    for a, b in [(start + a, start + b) for a, b in outside(line[start:end], SEPARATOR)] + [(end, end)]:
        if a < at:
            continue
        stop = a + 1 if line[a : a + 1] == "." and a < end else a
        if line[at:stop].strip():
            parts.append({"s": at, "e": stop})
        at = b
    inner = stops()
    return {"start": start, "end": end, "how": how, "sentences": len(inner) + 1, "first_stop": inner[0][0] + 1 if inner else end, "parts": parts}


def narrowed(lines: DataFrame, anchors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """lines (item, bucket, line, chain) with start, end and how of the first effect of the chain; item is unique."""
    cutter = F.pandas_udf(lambda line, bucket: pd.DataFrame([cut(x, b) or {"start": 0, "end": 0, "how": [], "sentences": 0, "first_stop": 0, "parts": []} for x, b in zip(line, bucket)]), _CUT)
    x = lines.withColumn("cut", cutter("line", "bucket")).withColumns({"top": F.get("chain", F.lit(0)), "subs": F.array_distinct(F.filter(F.slice("chain", 2, F.greatest(F.size("chain"), F.lit(1))), lambda e: e != F.get("chain", F.lit(0))))})
    clause = lambda p: F.substring(F.col("line"), p["s"] + 1, p["e"] - p["s"])
    x = x.withColumn("leads", F.transform("cut.parts", lambda p: clause(p).rlike(LEAD_IN)))
    last = F.size("cut.parts") - 1
    first = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: (k == last) | ~F.get("leads", k))), F.lit(0))
    x = x.withColumn("first", first)
    split = x.where((F.size("subs") > 0) & (F.size("cut.parts") > 1))
    pieces = split.select("item", "top", "subs", F.posexplode(F.transform("cut.parts", clause)).alias("k", "clause"))
    words = pieces.select("item", "top", "subs", "k", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("clause"), F.lit(WORD), F.lit(0)))).alias("word"))
    scored = words.join(anchors, "word").where((F.col("effect") == F.col("top")) | F.array_contains("subs", F.col("effect")))
    scored = scored.groupBy("item", "k", "effect", "top").agg(F.sum("odds").alias("s")).groupBy("item", "k").agg(F.coalesce(F.max(F.when(F.col("effect") == F.col("top"), F.col("s"))), F.lit(0.0)).alias("mine"), F.max(F.when(F.col("effect") != F.col("top"), F.col("s"))).alias("theirs"))
    other = scored.where((F.col("theirs") > threshold) & (F.col("theirs") > F.col("mine"))).groupBy("item").agg(F.collect_set("k").alias("others"))
    x = x.join(other, "item", "left")
    led = lambda k: F.coalesce(F.get("leads", k), F.lit(False)) & (k > F.col("first"))
    opens = F.transform(F.filter("others", lambda k: (k > F.col("first")) & (~led(k) | (k == last))), lambda k: F.when((k > 0) & led(k - 1), k - 1).otherwise(k))
    stop = F.array_min(opens)
    kept = F.array_max(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: (k < stop) & ((k == F.col("first")) | ((k > F.col("first")) & ~F.get("leads", k)))))
    x = x.withColumn("kept", F.get("cut.parts", kept)["e"])
    aligned = (F.size("subs") > 0) & (F.col("cut.sentences") > 1) & (F.col("cut.sentences") == F.size("chain"))
    end = F.when(F.col("kept") < F.col("cut.end"), F.col("kept")).when(aligned, F.col("cut.first_stop")).otherwise(F.col("cut.end"))
    how = F.when(end < F.col("cut.end"), F.array_append("cut.how", "sub-effect")).otherwise(F.col("cut.how"))
    x = x.withColumns({"how": how, "stop": end})
    shown = F.length(F.regexp_replace(F.substring(F.col("line"), F.lit(1), F.col("stop")), "[ ,;]+$", ""))
    x = x.withColumn("stop", shown)
    sound = F.col("stop") > F.col("cut.start")
    return x.select(*lines.columns, F.when(sound, F.col("cut.start")).otherwise(0).alias("start"), F.when(sound, F.col("stop")).otherwise(F.length("line")).alias("end"), F.when(sound & (F.size("how") > 0), F.col("how")).otherwise(F.array(F.lit("none"))).alias("how"))
