"""Conditions that a text states and its parse tree lacks.

One pass turns trees into rows of their entries (path of keys, key, kind and type of the value); families of evidence are a table of rules over these rows,
counted per item and compared with the conditions counted in the text.  Nothing below a condition or a restriction counts again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types of constraints that only say when, of delays, of conditions on what was done, of what could not be read; fields that stand for a condition.
TIMING = ["AsSorcery", "AsInstant", "OnlyOnceEachTurn", "OnlyOnce", "MaxTimesEachTurn", "OncePerTurn", "OncePerGame", "OnlyDuringYourTurn", "OnlyDuringOpponentsTurn", "OnlyDuringYourMainPhase", "DuringYourTurn", "DuringYourUpkeep", "NthSpellThisTurn", "NthDrawThisTurn", "BeforeAttackersDeclared", "BeforeCombatDamage", "DuringCombat"]
DELAYED = ["AtNextPhase", "AtNextPhaseForPlayer", "WheneverEvent", "WhenNextEvent", "WhenDies", "WhenDiesOrExiled", "WhenLeavesPlayFiltered", "WhenEntersBattlefield"]
DONE = ["IfYouDo", "WhenYouDo", "IfAPlayerDoes"]
UNREAD = ["Unimplemented", "Unrecognized"]
STRUCTURAL = ["damage_modification", "combat_scope", "unless_filter"]
FAMILIES = ["DO", "FLIP", "RESTR", "GEN"]
#: Who did or did not, what a coin or a clash gave, ifs that are no conditions, the event of a replacement.
WHO = "you|they|he or she|that player|the player|each player|a player|that creature's controller|its controller|its owner|that opponent|an opponent|the opponent|that permanent's controller|one or more players|no one|nobody|[a-z]+ player"
DO = rf"\bif (?:{WHO}) (?:do|does|did|don't|doesn't|didn't|do not|does not|did not|can't|cannot|can)\b(?=\s*(?:[,.;:]|$|so\b|instead\b|then\b|that way\b))"
FLIP = r"\bif (?:you|they|that player|he or she|[a-z]+ player|it) (?:win|lose|wins|loses|won|lost)\b"
NO_CONDITION = [r"\bif able\b", r"\bif possible\b", r"\b(?:even|as) if\b"]
EVENT = r"\bif\b[^,.]*?\b(?:would|tapped for mana)\b"


def stated(text: Column, bucket: Column) -> dict[str, Column]:
    """Conditions of each family in a text without reminders and quotes; a restricting sentence counts once, and so do not the ifs in it after "only"."""
    t = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\([^()]*\)", " "), "[\"“][^\"”]*[\"”]", " "))
    for pattern in NO_CONDITION:
        t = F.regexp_replace(t, pattern, " ")
    t = F.when(bucket == "replacements", F.regexp_replace(t, EVENT, " ")).otherwise(t)
    flips = F.regexp_replace(t, DO, " ")
    rest = F.regexp_replace(flips, FLIP, " ")
    sentences = F.split(rest, r"\. |\n|; ")
    ifs = lambda x: F.regexp_count(x, F.lit(r"\bif\b"))
    before = lambda s: F.regexp_replace(s, r"(?s)\bonly\b.*", "")
    general = F.aggregate(sentences, F.lit(0), lambda n, s: n + ifs(before(s)))
    limited = F.size(F.filter(sentences, lambda s: ifs(s) > ifs(before(s))))
    return {"DO": F.regexp_count(t, F.lit(DO)), "FLIP": F.regexp_count(flips, F.lit(FLIP)), "RESTR": limited, "GEN": general}


def entries(tree: object) -> list[tuple[str, str, str, str | None, bool]]:
    """(path, key, kind, type, whether it holds something) of all entries of a tree; items of a list have the list's key and []."""
    out, todo = [], [("", tree)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, list):
            todo += [(path, x) for x in node]
        if not isinstance(node, dict):
            continue
        effect = node.get("effect")
        if isinstance(effect, dict) and effect.get("type") == "FlipCoin" and (effect.get("win_effect") or effect.get("lose_effect")) and node.get("sub_ability"):
            out.append((path, "#flip", "object", None, True))  # what follows the branches of a coin runs whatever it shows
        for key, value in node.items():
            for name, v in [(key, value)] + ([(f"{key}[]", x) for x in value] if isinstance(value, list) else []):
                kind = "object" if isinstance(v, dict) else "list" if isinstance(v, list) else "null" if v is None else "scalar"
                named = v.get("type") if kind == "object" else None
                out.append((path, name, kind, named if isinstance(named, str) else None, bool(v)))
                if kind == "object" or name.endswith("[]"):
                    todo.append((f"{path}/{name}", v))
    return out


def nodes(df: DataFrame, item: str, tree: str) -> DataFrame:
    """Rows (item, path, key, kind, type, holds) of JSON trees."""
    kind = df.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, raw in enumerate(batch.column(1).to_pylist()):
                found = entries(json.loads(raw)) if raw else []
                rows += found
                at += [k] * len(found)
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds)]], ["item", "path", "key", "kind", "type", "holds"])

    return df.select(item, tree).mapInArrow(run, f"item {kind}, path string, key string, kind string, type string, holds boolean")


def _family() -> Column:
    """The family that an entry is evidence of; WILD backs any, STRUCT is a branch that lost its end."""
    key, kind, named, holds = F.col("key"), F.col("kind"), F.col("type"), F.col("holds")
    inside = F.concat("path", F.lit("/"))
    in_condition = inside.rlike(r"/condition(\[\])?/")
    barred = in_condition | inside.rlike(r"/activation_restrictions(\[\])?/")
    restricted = F.col("path").rlike(r"^(?!.*/activation_restrictions(\[\])?/.*/activation_restrictions\[\]/).*/activation_restrictions\[\]/data$") & ~in_condition & (key == "condition") & (kind != "null")
    of = lambda names: F.coalesce(named.isin(names), F.lit(False))
    condition = F.when(kind == "object", F.when(of(UNREAD), "WILD").when(of(DONE), "DO").when(~of(DELAYED), "GEN")).when(kind != "null", "GEN")
    return (
        F.when(key == "#flip", "STRUCT")
        .when(restricted, "RESTR")
        .when(barred, None)
        .when(key == "condition", condition)
        .when((key == "conditions") & holds, "GEN")
        .when((key == "constraint") & (kind == "object") & ~of(TIMING), "GEN")
        .when((key == "activation_restrictions[]") & ~of(TIMING) & ~of(["RequiresCondition"]), "RESTR")
        .when((key == "decline") & holds, "DO")
        .when(key.isin("win_effect", "lose_effect") & holds, "FLIP")
        .when((key == "else_ability") & holds, "WILD")
        .when(key.isin(STRUCTURAL) & holds, "GEN")
    )


def evidence(df: DataFrame, item: str, tree: str) -> DataFrame:
    """(item, one count per family, wild, struct) of the trees that have any evidence."""
    found = nodes(df, item, tree).withColumn("family", _family()).where("family is not null")
    return found.groupBy("item").agg(*[F.count_if(F.col("family") == f).alias(f"has_{f}") for f in FAMILIES], F.count_if(F.col("family") == "WILD").alias("wild"), F.count_if(F.col("family") == "STRUCT").alias("struct"))


def drops(df: DataFrame, item: str, bucket: str, text: str, tree: str) -> DataFrame:
    """(item, tier, missing, short) of items whose text has conditions that the tree lacks: A if a family is missing, B if one has too few."""
    need = df.select(F.col(item).alias("item"), *[c.alias(f"need_{f}") for f, c in stated(F.col(text), F.col(bucket)).items()])
    x = need.join(evidence(df, item, tree), "item", "left").fillna(0)
    lacks = lambda f: F.when((F.col(f"need_{f}") > 0) & (F.col(f"has_{f}") == 0) & (F.col("wild") == 0), f)
    few = lambda f: F.when((F.col(f"has_{f}") > 0) & (F.col(f"has_{f}") < F.col(f"need_{f}")), f)
    x = x.withColumns({"missing": F.array_compact(F.array(*[lacks(f) for f in FAMILIES])), "short": F.array_compact(F.array(*[few(f) for f in FAMILIES], F.when(F.col("struct") > 0, "STRUCT")))})
    tier = F.when(F.size("missing") > 0, "A").when(F.size("short") > 0, "B")
    return x.select("item", tier.alias("tier"), "missing", "short").where("tier is not null")
