"""Pages of abilities: a table of predicates over parse trees, told for all pages in one pass.

What the predicates ask of a tree is a row of columns, made once over VARIANT (unions and composite costs unrolled as deep as the input has them); each page is a line of data that says
which values of which columns it takes, and is compiled to one condition.  A tree is on every page whose condition holds.

Defined cases: a tree that is null or no JSON is on no page; a mode that is an object has the name of its first key, Unknown before others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signature import at, entries, is_object, items, let, name_of, set_at, text

BUFFS = ["AddPower", "AddToughness"]
ATTACHED = ["EnchantedBy", "EquippedBy", "FortifiedBy"]
_OTHERS = dict(mode=["Continuous"], affected_typed=True, affected_named=True, affected_self=False, attached=False)
_ACTIVATED = dict(kind=["Activated"], described=True)
_ENTERS = dict(mode=["ChangesZone"], destination=["Battlefield"])
_DIES = dict(mode=["ChangesZone"], origin=["Battlefield"], destination=["Graveyard"])
#: The pages of each bucket and what they take.  A list: one of these; has: an array with one of these; only: an array of just these; but: none of these.
PAGES: dict[str, dict[str, dict]] = {
    "triggers": {
        "trig.enters": _ENTERS | dict(card_self=True, chapter=False),
        "trig.enters-other": _ENTERS | dict(card_typed=True, lands=False),
        "trig.landfall": _ENTERS | dict(card_typed=True, lands=True),
        "trig.dies": _DIES | dict(card_self=True),
        "trig.dies-other": _DIES | dict(card_typed=True),
        "trig.leaves": dict(mode=["LeavesBattlefield"]),
        "trig.attacks": dict(mode=["Attacks", "AttacksOrBlocks", "EntersOrAttacks"]),
        "trig.you-attack": dict(mode=["YouAttack"]),
        "trig.blocks": dict(mode=["Blocks", "AttacksOrBlocks"]),
        "trig.combat-damage": dict(mode=["DamageDone", "DamageDoneOnceByController"], damage_kind=["CombatOnly"]),
        "trig.upkeep": dict(mode=["Phase"], phase=["Upkeep"]),
        "trig.end-step": dict(mode=["Phase"], phase=["End"]),
        "trig.begin-combat": dict(mode=["Phase"], phase=["BeginCombat"]),
        "trig.cast": dict(mode=["SpellCast", "SpellCastOrCopy"], card_is_self=False),
        "trig.draw": dict(mode=["Drawn"]),
        "trig.counter-added": dict(mode=["CounterAdded"], chapter=False),
        "trig.life-gained": dict(mode=["LifeGained"]),
        "trig.becomes-target": dict(mode=["BecomesTarget"]),
    },
    "abilities": {
        "act.mana-abilities": _ACTIVATED | dict(effect=["Mana"]),
        "act.tap": _ACTIVATED | dict(costs=("has", ["Tap"]), effect=("but", ["Mana", "Attach"])),
        "act.mana": _ACTIVATED | dict(costs=("only", ["Mana"]), effect=("but", ["Mana", "Attach"])),
        "act.sacrifice": _ACTIVATED | dict(costs=("has", ["Sacrifice"])),
        "act.discard": _ACTIVATED | dict(discards=True),
        "act.exile-gy": _ACTIVATED | dict(exiles=True),
        "act.remove-counter": _ACTIVATED | dict(costs=("has", ["RemoveCounter"])),
        "act.pay-life": _ACTIVATED | dict(costs=("has", ["PayLife"])),
        "act.loyalty": dict(kind=["Activated"], costs=("has", ["Loyalty"])),
    },
    "static_abilities": {
        "stat.anthem": _OTHERS | dict(mods=("has", BUFFS)),
        "stat.keyword-grant": _OTHERS | dict(mods=("has", ["AddKeyword"])),
        "stat.attached-bonus": dict(mode=["Continuous"], attached=True, mods=("has", [*BUFFS, "AddKeyword"])),
        "stat.cost-reduce": dict(mode=["ReduceCost", "ReduceAbilityCost"]),
        "stat.cost-raise": dict(mode=["RaiseCost"]),
        "stat.cant-block": dict(mode=["CantBlock", "CantAttackOrBlock"]),
        "stat.cant-attack": dict(mode=["CantAttack", "CantAttackOrBlock"]),
        "stat.evasion": dict(mode=["CantBeBlocked", "CantBeBlockedBy"]),
        "stat.cant-be-countered": dict(mode=["CantBeCountered"]),
        "stat.cant-untap": dict(mode=["CantUntap"]),
        "stat.must-attack": dict(mode=["MustAttack"]),
    },
    "replacements": {
        "repl.etb-tapped": dict(event=["Moved", "ChangeZone"], executed=["Tap"]),
        "repl.etb-counters": dict(event=["Moved", "ChangeZone"], executed=["PutCounter"], saga=False),
        "repl.damage": dict(event=["DamageDone"]),
        "repl.dies-exile": dict(executed=["ChangeZone"], leaves=True),
    },
}


def _anywhere(v: Column, levels: int, test) -> Column:
    """Whether a test holds of a filter or of a part of its unions."""
    own = F.coalesce(test(v), F.lit(False))
    if not levels:
        return own
    return own | (F.coalesce(text(v, "type") == "Or", F.lit(False)) & F.exists(items(v, "filters"), lambda x: _anywhere(x, levels - 1, test)))


def _costs(v: Column, levels: int) -> Column:
    """All single costs of a cost."""
    own = F.when(is_object(v), F.array(v)).otherwise(F.expr("cast(array() as array<variant>)"))
    if not levels:
        return own
    return F.when(F.coalesce(text(v, "type") == "Composite", F.lit(False)), F.flatten(F.transform(items(v, "costs"), lambda x: _costs(x, levels - 1)))).otherwise(own)


def features(df: DataFrame, item: str, bucket: str, tree: str) -> DataFrame:
    """(item, bucket and the columns that PAGES ask for) of ability trees."""
    deep = df.agg(F.max(F.regexp_count(tree, F.lit(r'"filters"\s*:'))).alias("f"), F.max(F.regexp_count(tree, F.lit(r'"costs"\s*:'))).alias("c")).first()
    unions, costs = deep["f"] or 0, deep["c"] or 0
    node = F.col("node")
    x = df.select(F.col(item).alias("item"), F.col(bucket).alias("bucket"), F.try_parse_json(tree).alias("node"))
    x = x.withColumns({"card": at(node, "valid_card"), "hit": at(node, "affected"), "parts": let(at(node, "cost"), lambda c: _costs(c, costs)), "said": F.coalesce(text(node, "description"), F.lit(""))})
    mode = at(node, "mode")
    named = F.when(is_object(mode), F.when(F.exists(entries(mode), lambda e: e["key"] == "Unknown"), "Unknown").otherwise(entries(mode)[0]["key"])).otherwise(name_of(mode))
    is_self = lambda v: text(v, "type") == "SelfRef"
    is_attached = lambda v: (text(v, "type") == "AttachedTo") | F.exists(F.filter(items(v, "properties"), is_object), lambda p: F.coalesce(text(p, "type").isin(ATTACHED), F.lit(False)))
    typed = lambda v: F.coalesce(text(v, "type").isin("Typed", "Or"), F.lit(False))
    first = lambda f: F.when(is_object(f), entries(f)[0]["key"]).otherwise(F.try_variant_get(f, "$", "string"))
    of = lambda name: F.transform("parts", lambda p: text(p, name))
    part = lambda kind, test: F.exists("parts", lambda p: F.coalesce((text(p, "type") == kind) & test(p), F.lit(False)))
    executed = text(at(node, "execute.effect"), "type")
    event = text(node, "event")
    return x.select(
        "item", "bucket", named.alias("mode"), text(node, "destination").alias("destination"), text(node, "origin").alias("origin"), text(node, "phase").alias("phase"), text(node, "damage_kind").alias("damage_kind"), text(node, "kind").alias("kind"),
        F.col("said").rlike(r"^Chapter \d").alias("chapter"), (F.col("said") != "").alias("described"), F.col("said").contains("Saga ETB").alias("saga"), _anywhere(F.col("card"), unions, is_self).alias("card_self"), F.coalesce(is_self(F.col("card")), F.lit(False)).alias("card_is_self"),
        typed(F.col("card")).alias("card_typed"), (F.transform(items(F.col("card"), "type_filters"), first) == F.array(F.lit("Land"))).alias("lands"), text(at(node, "effect"), "type").alias("effect"), of("type").alias("costs"),
        part("Discard", lambda p: ~set_at(p, "self_ref")).alias("discards"), part("Exile", lambda p: text(p, "zone") == "Graveyard").alias("exiles"), F.transform(F.filter(items(node, "modifications"), is_object), lambda m: text(m, "type")).alias("mods"),
        typed(F.col("hit")).alias("affected_typed"), ((F.size(items(F.col("hit"), "type_filters")) > 0) | F.coalesce(text(F.col("hit"), "type") == "Or", F.lit(False))).alias("affected_named"), _anywhere(F.col("hit"), unions, is_self).alias("affected_self"),
        _anywhere(F.col("hit"), unions, is_attached).alias("attached"), event.alias("event"), executed.alias("executed"), (((event == "Moved") & F.coalesce(text(node, "destination_zone") == "Graveyard", F.lit(False))) | (event == "Destroy")).alias("leaves"),
    )


def condition(wanted: dict) -> Column:
    """One page's line as a condition."""

    def one(name: str, want) -> Column:
        c = F.col(name)
        if isinstance(want, bool):
            return c == want
        if isinstance(want, list):
            return c.isin(want)
        how, values = want
        if how == "but":
            return ~F.coalesce(c.isin(values), F.lit(False))
        return F.exists(c, lambda v: v.isin(values)) & (F.lit(True) if how == "has" else F.forall(c, lambda v: v.isin(values)))

    return F.coalesce(reduce(lambda a, b: a & b, [one(n, w) for n, w in wanted.items()]), F.lit(False))


def pages(df: DataFrame, item: str, bucket: str, tree: str, table: dict[str, dict[str, dict]] = PAGES) -> DataFrame:
    """(page, item) for every page that a tree is on."""
    cases = [F.when((F.col("bucket") == b) & condition(w), F.lit(page)) for b, lines in table.items() for page, w in lines.items()]
    return features(df, item, bucket, tree).select(F.explode(F.array_compact(F.array(*cases))).alias("page"), "item")
