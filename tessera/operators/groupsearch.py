"""Search over named groups: an inverted index of their words, tiers of matches, a second search for misspelt words.

Many queries run at once.  Their words meet the index on whole words, or on the first three letters where a word may go on, so only postings of
the asked words are read; a group becomes a candidate in a field that holds all words asked for, or all but one of three or more.  Tiers are then told
on candidates alone, by array functions over the names of a group.

Tiers: 0 a name, 1 an alias or the slug, 2 a name starts with it, 3 all words are in a name; 3.1 and 3.2 the same where a word that stands for itself is met only as the
start of a longer one; 3.5 all but one of three or more words; 4 all words in an alias or the slug; 4.5 a drafted alias; 4.9 a hand group without members;
5 all words in the description; 6 in the family path.  Groups whose description is an example line come apart, as do families.

A query with fewer than three hits by name has each unknown word replaced by the nearest group word, and hits of the second search follow those of the first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, stem, variants
from .search import did_you_mean
from .stored import stored

#: Words that a search leaves out, ranks of layers, endings of a word that is still the same.
STOP = "a an the of to and or for in on at by with from your you it its that this is are be as".split()
LAYERS = {"l": 0, "k": 1, "r": 1, "m": 1, "t": 2, "o": 3, "c": 4, "h": 5, "y": 6}
ENDINGS = "^(s|es|ed|d|ing|er|ers|ings)?$"
PREFIX, FEW = 3, 3


def _stems(x: Column) -> Column:
    return F.transform(F.filter(F.split(fold(x), " "), lambda w: w != ""), stem)


def _core_key(name: Column) -> Column:
    """Stems of a name without what follows a dash or stands in parentheses."""
    return F.array_join(_stems(F.regexp_replace(F.regexp_replace(name, " — .*$", ""), r" \([^)]*\)", "")), " ")


@dataclass
class Index:
    """entries by gid; postings (word, gid, field); aliases by key; words of groups with their counts."""

    entries: DataFrame
    postings: DataFrame
    aliases: DataFrame
    words: DataFrame


def build(entries: DataFrame, aliases: DataFrame | None = None) -> Index:
    """entries: gid, name, extras (other names), slug, path, description, draft, layer, size, auto, placed; aliases: phrase, gid, place, hand."""
    spark = entries.sparkSession
    if aliases is None:
        kind = entries.schema["gid"].dataType.simpleString()
        aliases = spark.createDataFrame([], f"phrase string, gid {kind}, place bigint, hand boolean")
    named = F.concat(F.array("name"), F.coalesce("extras", F.expr("cast(array() as array<string>)")))
    names = F.transform(named, lambda n: F.struct(_stems(n).alias("ns"), F.array_join(_stems(n), " ").alias("key"), _core_key(n).alias("core")))
    described = F.filter(_stems(F.coalesce("description", F.lit(""))), lambda w: ~w.isin(STOP) & (F.length(w) >= 2))
    held = entries.select(
        "gid", "name", "layer", names.alias("names"), _stems(F.coalesce("slug", F.lit(""))).alias("slug"), described.alias("described"), _stems(F.coalesce("path", F.lit(""))).alias("path"),
        (F.coalesce("draft", F.lit(False)) & F.coalesce(F.col("description").startswith("Example"), F.lit(False))).alias("example"), ((F.col("layer") == "h") & (F.coalesce("placed", F.lit(0)) == 0)).alias("bare"),
        F.round(F.log10(F.col("size") + 1.0) - F.when(F.col("auto"), 0.3).otherwise(0.0), 6).alias("score"),
    )
    held = stored(held)
    fields = {"n": F.flatten(F.transform("names", lambda v: v["ns"])), "s": F.col("slug"), "d": F.col("described"), "p": F.col("path")}
    each = [held.select("gid", F.lit(f).alias("field"), F.explode(F.array_distinct(c)).alias("word")) for f, c in fields.items()]
    postings = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]).withColumn("prefix", F.substring("word", 1, PREFIX))
    known = aliases.select(F.array_join(_stems(F.col("phrase")), " ").alias("key"), "phrase", "gid", "place", "hand").join(held.select("gid"), "gid", "left_semi")
    split = lambda c: F.explode(F.filter(F.split(fold(c), " "), lambda w: F.length(w) >= 3)).alias("term")
    told = entries.select(split(F.col("name"))).unionAll(entries.select(split(F.coalesce("slug", F.lit(""))))).unionAll(aliases.select("phrase").distinct().select(split(F.col("phrase"))))
    return Index(held, stored(postings), stored(known), stored(told.groupBy("term").agg(F.count(F.lit(1)).alias("n"))))


def _asked(index: Index, queries: DataFrame, real: DataFrame | None, fixes: bool) -> DataFrame:
    """(qid, key, all, core): stems of a query, its words (v, whole) and those that count; queries: qid, q (folded)."""
    words = queries.select("qid", F.posexplode(F.split("q", " ")).alias("pos", "word")).where("word <> ''")
    own = index.words.select(stem(F.col("term")).alias("stem")).distinct().withColumn("own", F.lit(True))
    x = words.withColumn("v", variants(F.col("word"))).withColumn("stem", F.col("v")[0]).join(own, "stem", "left")
    if real is not None:
        is_real = real.select(F.col("word").alias("r")).distinct()
        found = x.select("qid", "pos", F.explode(F.array_union(F.array("word"), "v")).alias("r")).join(is_real, "r", "left_semi").select("qid", "pos").distinct().withColumn("real", F.lit(True))
        x = x.join(found, ["qid", "pos"], "left")
    else:
        x = x.withColumn("real", F.lit(None).cast("boolean"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    whole, v = (yes("own") | yes("real"), F.when(yes("own"), F.slice("v", 1, 1)).otherwise(F.col("v"))) if fixes else (F.lit(False), F.col("v"))
    x = x.select("qid", F.struct("pos", "word", "stem", v.alias("v"), whole.alias("whole"), F.col("word").isin(STOP).alias("stop"), yes("own").alias("own"), yes("real").alias("real")).alias("t"))
    x = x.groupBy("qid").agg(F.array_sort(F.collect_list("t")).alias("all"))  # the words of one query
    core = F.filter("all", lambda t: ~t["stop"])
    return x.select("qid", F.array_join(F.transform("all", lambda t: t["stem"]), " ").alias("key"), "all", F.when(F.size(core) > 0, core).otherwise(F.col("all")).alias("core"))


def _meets(t: Column, w: Column, prefix: Column) -> Column:
    """Whether a word of a query meets a word: it is one of its forms or, with prefix, starts with one of three letters or more."""
    return F.exists(t["v"], lambda v: (w == v) | (prefix & (F.length(v) >= PREFIX) & w.startswith(v)))


def _same(t: Column, w: Column) -> Column:
    """The word itself or an inflection of it, perhaps with its last letter doubled."""

    def inflected(v: Column) -> Column:
        rest = F.substr(w, F.length(v) + 1)
        doubled = F.when(F.substring(rest, 1, 1) == F.right(v, F.lit(1)), F.substr(rest, F.lit(2))).otherwise(rest)
        return w.startswith(v) & (rest.rlike(ENDINGS) | doubled.rlike(ENDINGS))

    return F.exists(t["v"], inflected)


def _all(words: Column, tokens: Column, how) -> Column:
    return (F.size(words) > 0) & (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.exists(words, lambda w: how(t, w)))


def literal(index: Index, asked: DataFrame, fixes: bool) -> DataFrame:
    """(qid, gid, tier, why, via, place) of all groups that a query meets, the best tier of each."""
    tokens = asked.select("qid", F.size("core").alias("n"), F.posexplode("core").alias("k", "t")).select("qid", "n", "k", F.explode("t.v").alias("v"))
    long = tokens.where(F.length("v") >= PREFIX).withColumn("prefix", F.substring("v", 1, PREFIX))
    exact = tokens.where(F.length("v") < PREFIX)
    near = index.postings.join(long, "prefix").where(F.col("word").startswith(F.col("v"))).select("qid", "n", "gid", "field", "k")
    near = near.unionByName(index.postings.join(exact, F.col("word") == F.col("v")).select("qid", "n", "gid", "field", "k"))
    met = near.groupBy("qid", "n", "gid", "field").agg(F.count_distinct("k").alias("met")).where((F.col("met") == F.col("n")) | ((F.col("field") == "n") & (F.col("n") >= FEW) & (F.col("met") == F.col("n") - 1)))
    x = met.select("qid", "gid").distinct().join(index.entries, "gid").join(asked, "qid")
    any_name = lambda f: F.exists("names", f)
    last = F.size("all") - 1
    loose = lambda t, w: _meets(t, w, F.lit(True))
    strict = lambda t, w: F.when(t["whole"], _same(t, w)).otherwise(_meets(t, w, F.lit(True)))
    in_order = lambda v, how: (F.size(v["ns"]) >= F.size("all")) & F.forall(F.transform("all", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda p: how(p["t"], F.get(v["ns"], p["i"]), p["i"]))
    starts = any_name(lambda v: in_order(v, lambda t, w, i: _meets(t, w, i == last)))
    starts_whole = any_name(lambda v: in_order(v, lambda t, w, i: F.when(t["whole"], _same(t, w)).otherwise(_meets(t, w, i == last))))
    every, every_whole = any_name(lambda v: _all(v["ns"], F.col("core"), loose)), any_name(lambda v: _all(v["ns"], F.col("core"), strict))
    most = any_name(lambda v: F.size(F.filter("core", lambda t: F.exists(v["ns"], lambda w: loose(t, w)))) >= F.size("core") - 1)
    whole = lambda c, otherwise, yes: F.when(c, yes).otherwise(otherwise) if fixes else F.lit(yes)
    told = lambda tier, why, place=0: F.struct(tier.cast("double").alias("tier"), F.lit(why).alias("why"), F.lit(place).cast("long").alias("place"))
    match = (
        F.when(any_name(lambda v: (v["key"] == F.col("key")) | (v["core"] == F.col("key"))), told(F.lit(0), "name"))
        .when(F.array_join("slug", " ") == F.col("key"), told(F.lit(1), "slug", 50))
        .when(starts, told(whole(starts_whole, whole(every_whole, F.lit(3.1), 3.0), 2.0), "name"))
        .when(every, told(whole(every_whole, F.lit(3.2), 3.0), "name"))
        .when((F.size("core") >= FEW) & most, told(F.lit(3.5), "most"))
        .when(_all(F.col("slug"), F.col("core"), loose), told(F.lit(4), "slug"))
        .when(_all(F.col("described"), F.col("core"), lambda t, w: _meets(t, w, F.lit(False))) & (F.array_max(F.transform("core", lambda t: F.length(t["word"]))) >= 3), told(F.lit(5), "description"))
        .when(_all(F.col("path"), F.col("core"), loose), told(F.lit(6), "family"))
    )
    own = x.withColumn("m", match).where("m is not null").select("qid", "gid", "m.tier", "m.why", F.lit("").alias("via"), "m.place")
    same = index.aliases.join(asked.select("qid", "key"), "key")
    same = same.select("qid", "gid", F.when(F.col("hand"), 1.0).otherwise(4.5).alias("tier"), F.lit("alias").alias("why"), F.col("phrase").alias("via"), F.col("place").cast("long").alias("place"))
    phrases = index.aliases.where("hand").select("key", "phrase").distinct().withColumn("ws", F.split("key", " "))
    spoken = phrases.withColumn("word", F.explode(F.array_distinct("ws"))).withColumn("prefix", F.substring("word", 1, PREFIX))
    reach = spoken.join(long, "prefix").where(F.col("word").startswith(F.col("v"))).select("qid", "n", "key", "phrase", "k").unionByName(spoken.join(exact, F.col("word") == F.col("v")).select("qid", "n", "key", "phrase", "k"))
    reach = reach.groupBy("qid", "n", "key", "phrase").agg(F.count_distinct("k").alias("met")).where("met = n").join(asked.select("qid", F.col("key").alias("asked")), "qid").where("key <> asked")
    part = reach.select("qid", "key", "phrase").join(index.aliases.where("hand"), ["key", "phrase"]).select("qid", "gid", F.lit(4.0).alias("tier"), F.lit("alias").alias("why"), F.col("phrase").alias("via"), F.lit(0).cast("long").alias("place"))
    found = own.unionByName(same).unionByName(part)
    order = F.struct("tier", "place", F.when((F.col("why") == "alias") & (F.col("tier") == 4), 1).otherwise(0).alias("late"), "via", "why")
    best = found.groupBy("qid", "gid").agg(F.min_by(F.struct("tier", "why", "via", "place"), order).alias("b"))
    return best.select("qid", "gid", "b.tier", "b.why", "b.via", "b.place")


def _shown(index: Index, found: DataFrame, fixes: bool) -> DataFrame:
    x = found.join(index.entries.select("gid", "name", "layer", "example", "bare", "score"), "gid")
    section = F.when(F.col("why") == "family", "family")
    if fixes:
        section = section.when((F.col("why") == "description") & F.col("example"), "example")
        x = x.withColumn("tier", F.when(F.col("bare") & (F.col("tier") >= 2) & (F.col("tier") < 4.9) & (F.col("why") != "family"), 4.9).otherwise(F.col("tier")))
    return x.withColumn("section", section.otherwise("groups"))


def _by_name() -> Column:
    return (F.col("section") == "groups") & ((F.col("tier") <= 4.5) | (F.col("tier") == 4.9))


def corrected(index: Index, queries: DataFrame, asked: DataFrame, real: DataFrame | None) -> DataFrame:
    """(qid, q) of the queries in which an unknown word has a near one; queries: qid, q."""
    words = asked.select("qid", F.explode("all").alias("t")).select("qid", "t.pos", "t.word", "t.v", "t.stop", "t.real")
    odd = words.where((F.length("word") >= 4) & ~F.col("stop") & ~F.col("real") & ~F.col("word").rlike("[0-9]"))
    forms = index.words.select(stem(F.col("term")).alias("form")).distinct()
    known = odd.select("word", F.explode("v").alias("form")).join(forms, "form", "left_semi").select("word")
    starts = index.words.withColumn("prefix", F.substring("term", 1, PREFIX)).join(odd.select("word").distinct().withColumn("prefix", F.substring("word", 1, PREFIX)), "prefix").where(F.col("term").startswith(F.col("word"))).select("word")
    unknown = odd.select("word").distinct().join(known.unionAll(starts).distinct(), "word", "left_anti")
    nearest = did_you_mean(unknown, index.words)
    changed = words.join(odd.select("qid", "pos").withColumn("odd", F.lit(True)), ["qid", "pos"], "left").join(nearest.select("word", "suggestion"), "word", "left")
    new = F.when(F.col("odd"), F.coalesce("suggestion", "word")).otherwise(F.col("word"))
    out = changed.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", new.alias("w")))), lambda p: p["w"]), " ").alias("q"), F.bool_or(new != F.col("word")).alias("moved"))
    return out.where("moved").select("qid", "q")


def search(index: Index, queries: DataFrame, real: DataFrame | None = None, fixes: bool = True) -> DataFrame:
    """(qid, section, gid, name, tier, why, via, place, score, layer, meant) for queries (qid, text): all that is met; meant: the corrected query that met it.

    real: words (word) that are no misspellings; without such a list no word is corrected."""
    q = queries.select("qid", fold(F.col("text")).alias("q")).where(F.length("q") >= 2)
    asked = stored(_asked(index, q, real, fixes))
    first = stored(_shown(index, literal(index, asked, fixes), fixes).withColumn("meant", F.lit(None).cast("string")))
    out = first
    if real is not None:
        hits = first.groupBy("qid").agg(F.count_if(_by_name()).alias("hits"))
        few = asked.join(hits.where(F.col("hits") >= FEW), "qid", "left_anti")
        again = stored(corrected(index, q, few, real))
        second = _shown(index, literal(index, _asked(index, again, real, fixes), fixes), fixes).where(_by_name())
        second = stored(second.join(first.where("section = 'groups'").select("qid", "gid"), ["qid", "gid"], "left_anti").join(again.select("qid", F.col("q").alias("meant")), "qid"))
        out = first.unionByName(second)
    return out.select("qid", "section", "gid", "name", "tier", "why", "via", "place", "score", "layer", "meant")


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The first of each query's sections, as a page shows them, with their rank; tasks keep no more than most of a query before these meet."""
    layer = F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair])
    order = [F.col("meant").isNotNull(), F.col("tier"), F.when(F.col("tier") == 1, F.col("place")).otherwise(0), F.desc("score"), F.try_element_at(layer, F.col("layer")), F.col("name"), F.col("gid")]
    rank = F.row_number().over(Window.partitionBy("qid", "section").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)
