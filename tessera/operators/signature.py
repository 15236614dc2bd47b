"""Signatures of abilities: twenty fields of a parse tree, as expressions over VARIANT.

A tree is one ability (bucket abilities, triggers, replacements or static_abilities) as JSON.  What a field needs of the tree is unrolled into column
expressions, as many levels of unions and of chained steps as the deepest tree of the input has (counted in one pass before), so that nothing is cut
and no row leaves the JVM.  Stages are columns of their own, each computed once.

Defined cases: a tree that is null, no JSON or no object, and one without a typed effect (outside replacements), has blank fields and usable = false; unknown
effect types are of the family Other; counts below a repeat are looked for two levels deep.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families of effect types, wrapper effects, core types, searches, names of what an effect points at.
FAMILIES = {
    "Destroy": ["Destroy", "DestroyAll"],
    "Damage": ["DealDamage", "DamageAll", "DamageEachPlayer", "Fight"],
    "Life": ["GainLife", "LoseLife", "SetLifeTotal"],
    "Zone change": ["ChangeZone", "ChangeZoneAll", "Bounce", "PutAtLibraryPosition", "PutOnTopOrBottom", "PhaseOut", "Shuffle"],
    "Library": ["SearchLibrary", "Dig", "ExileTop", "RevealTop", "RevealUntil", "ExileFromTopUntil", "Scry", "Surveil", "Mill", "Seek", "Explore", "ExploreAll", "Discover", "Learn", "Conjure"],
    "Card draw": ["Draw", "Connive"],
    "Discard / hand": ["Discard", "RevealHand"],
    "Sacrifice": ["Sacrifice", "ChooseAndSacrificeRest"],
    "Counters": ["PutCounter", "PutCounterAll", "RemoveCounter", "MoveCounters", "MultiplyCounter", "Proliferate", "GivePlayerCounter", "Adapt", "Monstrosity", "Bolster", "Double", "LoseAllPlayerCounters", "GainEnergy", "TimeTravel"],
    "Tokens": ["Token", "CopyTokenOf", "Investigate", "Incubate", "Populate", "Amass", "Forage"],
    "Mana": ["Mana"],
    "Pump / grant": ["Pump", "PumpAll", "GenericEffect", "SwitchPT", "DoublePT", "DoublePTAll", "Animate", "BlightEffect"],
    "Tap / untap": ["Tap", "TapAll", "Untap", "UntapAll", "Detain"],
    "Counter spell": ["Counter", "ChangeTargets"],
    "Copy": ["CopySpell", "BecomeCopy"],
    "Control": ["GainControl", "ExchangeControl", "ControlNextTurn"],
    "Cast / play": ["CastFromZone", "GrantCastingPermission", "GrantNextSpellAbility", "ReduceNextSpellCost"],
    "Combat": ["ForceBlock", "Goad", "RemoveFromCombat", "AdditionalCombatPhase"],
    "Attach": ["Attach"],
    "Protection": ["Regenerate", "PreventDamage"],
    "Transform / face": ["Transform", "BecomePrepared", "Manifest", "ManifestDread", "SetDayNight"],
    "Game / player": ["WinTheGame", "LoseTheGame", "ExtraTurn", "SkipNextTurn", "BecomeMonarch", "CreateEmblem", "VentureIntoDungeon", "RingTemptsYou", "SetClassLevel", "SolveCase", "GiftDelivery", "RollDie", "FlipCoin", "FlipCoins", "FlipCoinUntilLose", "CollectEvidence", "Suspect", "AddRestriction"],
    "Choice / wrapper": ["Choose", "TargetOnly", "PayCost", "CreateDelayedTrigger"],
    "Keyword-handled": ["RuntimeHandled"],
}
WRAPPERS = ["TargetOnly", "Choose", "PayCost", "CreateDelayedTrigger"]
CORE_TYPES = ["Artifact", "Battle", "Card", "Creature", "Enchantment", "Instant", "Kindred", "Land", "Permanent", "Planeswalker", "Sorcery", "Spell", "Tribal"]
SEARCHES = ["SearchLibrary", "Dig", "RevealUntil", "Seek", "ExileFromTopUntil", "RevealTop", "Discover"]
TARGET_KEYS = ["target", "filter", "valid_card", "affected", "valid_target"]
OBJECTS = {"SelfRef": "self", "Any": "any target", "Player": "player", "Controller": "you", "TriggeringPlayer": "triggering player", "DefendingPlayer": "defending player", "ParentTargetController": "its controller", "ParentTarget": "parent"}
PLAYERS = ["player", "you", "triggering player", "defending player", "its controller"]
POWER_CHANGES = ["AddPower", "AddToughness", "AddDynamicPower", "AddDynamicToughness"]
SIGNS = {"+": "boost", "-": "shrink", "+/-": "mixed", "0": "zero", "?": "unknown"}
RECIPIENTS = {"Opponent": "opponents", "All": "each player"}
#: The twenty fields.
FIELDS = ["fam", "rtype", "ftype", "frm", "to", "ctr", "who", "mods", "obj", "ctrl", "quant", "props", "kw", "dur", "cond", "wrap", "chain", "tok", "sign", "recip"]
UNWRAPPED = 4

_PARTS = "struct<core:string,ctrl:string,details:array<string>,zones:array<string>>"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once: it is the variable of a lambda, so plans stay linear in the levels unrolled."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def kind(v: Column) -> Column:
    """STRING, OBJECT, ARRAY, BIGINT ... of a variant; null for SQL null, VOID for JSON null."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v) == "OBJECT", F.lit(False))


def text(v: Column, path: str) -> Column:
    """A string at a path; null where something else stands."""
    found = at(v, path)
    return F.when(kind(found) == "STRING", F.try_variant_get(found, "$", "string"))


def items(v: Column, path: str) -> Column:
    return F.coalesce(at(v, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))


def set_at(v: Column, path: str) -> Column:
    """Whether a path holds a value that counts: no null, false, 0, empty text, list or object."""
    return F.coalesce(~F.to_json(at(v, path)).isin("null", "false", "0", '""', "[]", "{}"), F.lit(False))


def entries(v: Column) -> Column:
    return F.coalesce(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), F.expr("cast(array() as array<struct<key:string,value:variant>>)"))


def _strings(*values: Column) -> Column:
    return F.array_compact(F.array(*values)) if values else F.expr("cast(array() as array<string>)")


def _distinct(values: Column, sep: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(values))), sep)


def _member(x: Column) -> Column:
    """A JSON value as text: a string bare, all else as JSON."""
    return F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x))


def name_of(v: Column) -> Column:
    """An enum value: a string itself, an object the names of its keys."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(is_object(v), F.array_join(F.array_sort(F.transform(entries(v), lambda e: e["key"])), ",")).otherwise(F.to_json(v))


def shape_tag(v: Column) -> Column:
    """One element of a list of type filters or properties, with the scalars that it carries: Non:Artifact, NotColor:Black."""
    scalar = lambda x: kind(x).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE", "BOOLEAN")

    def typed(own: Column) -> Column:
        ordered = F.array_sort(F.transform(own, lambda e: F.struct(e["key"].alias("key"), F.when(scalar(e["value"]), _member(e["value"])).alias("shown"))))
        rest = F.array_compact(F.transform(F.filter(ordered, lambda e: e["key"] != "type"), lambda e: e["shown"]))
        return let(rest, lambda r: F.when(F.size(r) > 0, F.concat(F.lit(":"), F.array_join(r, ","))).otherwise(""))

    single = lambda e: F.concat(e["key"], F.when(scalar(e["value"]), F.concat(F.lit(":"), _member(e["value"]))).otherwise(""))
    tagged = let(entries(v), lambda own: F.when(text(v, "type").isNotNull(), F.concat(text(v, "type"), typed(own))).when(F.size(own) == 1, let(own[0], single)).otherwise(F.substring(F.to_json(v), 1, 40)))
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(is_object(v), tagged)


def target_of(effect: Column) -> Column:
    """What an effect points at: the first of the keys that holds an object."""
    return F.coalesce(*[F.when(is_object(at(effect, k)), at(effect, k)) for k in TARGET_KEYS])


def target_shape(v: Column) -> Column:
    """Structure of a target: its type and, for typed ones, filters, controller and properties."""
    tags = lambda path: F.array_sort(F.array_compact(F.transform(items(v, path), lambda t: shape_tag(t))))
    props = tags("properties")
    typed = F.concat(F.lit("Typed["), F.array_join(tags("type_filters"), ","), F.lit("]@"), F.coalesce(text(v, "controller"), F.lit("Any")), F.when(F.size(props) > 0, F.concat(F.lit("{"), F.array_join(props, ","), F.lit("}"))).otherwise(""))
    return F.when(is_object(v), F.when(text(v, "type") == "Typed", typed).otherwise(text(v, "type")))


def effect_features(effect: Column, name: Column) -> Column:
    """Tokens at three resolutions: an effect's (or static mode's) name, name with target shape, target shape; an empty list without a name."""
    shape = target_shape(F.coalesce(*[at(effect, k) for k in TARGET_KEYS]))
    bound = lambda s: F.array_compact(F.array(name, F.concat(name, F.lit("|tgt:"), s), F.when(name.isNotNull(), F.concat(F.lit("tgt:"), s))))
    return let(shape, bound)


def features(df: DataFrame, bucket: str, tree: str) -> DataFrame:
    """df with the feature tokens of each ability: of its effect, or of a static's mode and what it affects."""
    node = F.try_parse_json(tree)
    effect = F.when(F.col(bucket) == "abilities", at(node, "effect")).when(F.col(bucket).isin("triggers", "replacements"), at(node, "execute.effect")).otherwise(node)
    x = df.withColumn("__effect", effect)
    name = F.when(F.col(bucket) == "static_abilities", F.concat(F.lit("eff:static:"), name_of(at(F.col("__effect"), "mode")))).otherwise(F.concat(F.lit("eff:"), text(F.col("__effect"), "type")))
    return x.withColumn("__name", name).withColumn("features", effect_features(F.col("__effect"), F.col("__name"))).drop("__effect", "__name")


def _made(core: Column, ctrl: Column, details: Column, zones: Column) -> Column:
    return F.struct(core.alias("core"), ctrl.alias("ctrl"), details.alias("details"), zones.alias("zones")).cast(_PARTS)


def _leaf(v: Column, implied: dict[str, str]) -> Column:
    base = lambda t: F.element_at(F.split(t, ":"), -1)
    known = F.create_map(*[F.lit(x) for pair in implied.items() for x in pair]) if implied else None
    in_zone = lambda p: F.coalesce(text(p, "type") == "InZone", F.lit(False))

    def cores(named: Column, sub: Column) -> Column:
        if not implied:
            return named
        return let(F.array_distinct(F.array_compact(F.transform(sub, lambda t: F.try_element_at(known, base(t))))), lambda learnt: F.when((F.size(named) == 0) & (F.size(learnt) == 1), learnt).otherwise(named))

    def typed(tags: Column) -> Column:
        named = F.array_sort(F.filter(tags, lambda t: base(t).isin(CORE_TYPES)))
        sub = F.array_sort(F.filter(tags, lambda t: ~base(t).isin(CORE_TYPES)))
        core = let(cores(named, sub), lambda c: F.when(F.size(c) > 0, F.array_join(c, "+")).otherwise("object"))
        props = F.filter(items(v, "properties"), is_object)
        zones = F.transform(F.filter(props, in_zone), lambda p: text(p, "zone"))
        others = F.array_sort(F.transform(F.filter(props, lambda p: ~in_zone(p)), lambda p: shape_tag(p)))
        return _made(core, F.coalesce(text(v, "controller"), F.lit("-")), F.concat(sub, others), zones)

    own = let(text(v, "type"), lambda t: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in OBJECTS.items() for x in pair]), t), t, F.lit("-")))
    tags = F.array_compact(F.transform(items(v, "type_filters"), lambda t: shape_tag(t)))
    return F.when(text(v, "type") == "Typed", let(tags, typed)).otherwise(_made(own, F.lit("-"), _strings(), _strings()))


def object_parts(v: Column, levels: int, implied: dict[str, str] | None = None) -> Column:
    """(core, ctrl, details, zones) of a target, with unions of unions down to a number of levels."""
    implied = implied or {}
    nothing = _made(F.lit("-"), F.lit("-"), _strings(), _strings())
    union = lambda x: F.coalesce(text(x, "type").isin("Or", "And"), F.lit(False))

    def joined(kind_: Column, of: Column) -> Column:
        gathered = lambda name: F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform(of, lambda p: p[name])))))
        core = let(F.array_sort(F.array_distinct(F.transform(of, lambda p: p["core"]))), lambda c: F.when(F.size(c) == 0, kind_).when(kind_ == "Or", F.array_join(c, "|")).otherwise(F.array_join(c, "&")))
        ctrl = let(F.array_distinct(F.transform(of, lambda p: p["ctrl"])), lambda c: F.when(F.size(c) == 1, c[0]).otherwise("mixed"))
        return _made(core, ctrl, gathered("details"), gathered("zones"))

    def level(left: int, x: Column) -> Column:
        own = _leaf(x, implied)
        if left:
            below = F.transform(items(x, "filters"), lambda y: level(left - 1, y))
            own = F.when(union(x), let(below, lambda of: joined(text(x, "type"), of))).otherwise(own)
        return F.when(is_object(x), own).otherwise(nothing)

    return let(v, lambda x: level(levels, x))


def _repeated(execution: Column) -> Column:
    """The filter of the object count that an ability repeats for."""
    whole = at(execution, "repeat_for")
    inner = F.transform(entries(whole), lambda e: e["value"])
    below = F.flatten(F.transform(inner, lambda x: F.transform(entries(x), lambda e: e["value"])))
    counts = F.filter(F.concat(F.array(whole), inner, below), lambda x: F.coalesce((text(x, "type") == "ObjectCount") & is_object(at(x, "filter")), F.lit(False)))
    return F.when(is_object(whole), at(F.get(counts, F.lit(0)), "filter"))


def _resolved(v: Column, execution: Column) -> Column:
    """A target, or what the ability repeats for where the target is its parent's."""
    return F.when(text(v, "type") == "ParentTarget", F.coalesce(_repeated(execution), v)).otherwise(v)


def step_verb(step: Column, core: Column) -> Column:
    """Type of a step's effect with destination, counter and object: ChangeZone>Hand@Creature."""
    after = lambda mark, c: F.coalesce(F.concat(F.lit(mark), F.nullif(c, F.lit(""))), F.lit(""))
    effect = at(step, "effect")
    return F.concat(F.coalesce(text(effect, "type"), F.lit("?")), after(">", text(effect, "destination")), after("/", F.lower(text(effect, "counter_type"))), after("@", F.nullif(core, F.lit("-"))))


def _sign(value: Column) -> Column:
    """+, -, 0 or ? of a quantity: a number, a fixed one or a variable; none is 0."""
    number = lambda n: F.when(n > 0, "+").when(n < 0, "-").otherwise("0")
    one = lambda v: F.when(v.isNull() | (kind(v) == "VOID"), "0").when(kind(v) == "BIGINT", let(F.try_variant_get(v, "$", "long"), number)).otherwise("?")
    named = lambda v: F.when(v.startswith("-"), "-").when(v != "", "+").otherwise("?")
    composed = F.when(text(value, "type") == "Fixed", let(at(value, "value"), one)).when(text(value, "type") == "Variable", let(F.coalesce(text(value, "value"), F.lit("")), named)).otherwise("?")
    return F.when(is_object(value), composed).otherwise(one(value))


def sign_class(effect: Column, statics: Column) -> Column:
    """boost, shrink, mixed, zero or unknown change of power and toughness; '' without one."""
    changes = F.filter(F.flatten(F.transform(statics, lambda s: items(s, "modifications"))), lambda m: F.coalesce(text(m, "type").isin(POWER_CHANGES), F.lit(False)))
    signs = F.transform(changes, lambda m: F.when(text(m, "type").startswith("AddDynamic"), "?").otherwise(let(at(m, "value"), _sign)))
    pumped = F.when(text(effect, "type").isin("Pump", "PumpAll"), F.transform(F.array(at(effect, "power"), at(effect, "toughness")), lambda v: _sign(v))).otherwise(_strings())

    def shown(every: Column) -> Column:
        moved = F.array_sort(F.array_distinct(F.filter(every, lambda s: s != "0")))
        named = let(moved, lambda m: F.when(F.size(m) == 0, SIGNS["0"]).when(F.size(m) == 2, SIGNS["+/-"]).when(m[0] == "+", SIGNS["+"]).otherwise(SIGNS["-"]))
        return F.when(F.size(every) == 0, "").when(F.array_contains(every, "?"), SIGNS["?"]).otherwise(named)

    return let(F.concat(pumped, signs), shown)


def _static_family(mode: Column) -> Column:
    limits = mode.startswith("Cant") | mode.startswith("Must") | mode.isin("BlockRestriction", "ExtraBlockers", "CanAttackWithDefender")
    return F.when(mode == "Continuous", "Static: continuous").when(mode.isin("ReduceCost", "RaiseCost"), "Static: cost change").when(limits, "Static: restriction").otherwise("Static: other rule")


def _attached(parts: Column) -> Column:
    """Equipped and enchanted objects have that in their type and not in their details."""
    marks = {"EquippedBy": "equipped", "EnchantedBy": "enchanted"}
    is_mark = lambda d: reduce(lambda a, b: a | b, [d.startswith(m) for m in marks])
    held = F.array_sort(F.array_distinct(F.transform(F.filter(parts["details"], is_mark), lambda d: F.when(d.startswith("Equipped"), marks["EquippedBy"]).otherwise(marks["EnchantedBy"]))))
    core = F.when((F.size(held) > 0) & (parts["core"] != "-"), F.concat(parts["core"], F.lit("["), F.array_join(held, "+"), F.lit("]"))).otherwise(parts["core"])
    return _made(core, parts["ctrl"], F.filter(parts["details"], lambda d: ~is_mark(d)), parts["zones"])


def depths(df: DataFrame, tree: str) -> tuple[int, int]:
    """Upper bounds of the levels of unions and of chained steps, in one pass."""
    seen = df.agg(F.max(F.regexp_count(tree, F.lit(r'"filters"\s*:'))).alias("unions"), F.max(F.regexp_count(tree, F.lit(r'"sub_ability"\s*:'))).alias("steps")).first()
    return seen["unions"] or 0, seen["steps"] or 0


def implied_cores(pairs: DataFrame, subtype: str, core: str, least: float = 0.8) -> DataFrame:
    """(subtype, core): the core type that at least a share of a subtype's rows have."""
    each = pairs.groupBy(F.col(subtype).alias("subtype"), F.col(core).alias("core")).agg(F.count(F.lit(1)).alias("n"))
    top = each.groupBy("subtype").agg(F.max_by("core", F.struct("n", "core")).alias("core"), F.max("n").alias("top"), F.sum("n").alias("n"))
    return top.where(F.col("top") >= least * F.col("n")).select("subtype", "core")


def signatures(df: DataFrame, item: str, bucket: str, tree: str, implied: dict[str, str] | None = None) -> DataFrame:
    """(item, the twenty FIELDS, usable) of abilities given as JSON trees with their bucket."""
    implied = implied or {}
    unions, deep = depths(df, tree)
    node, none = F.col("node"), F.lit(None).cast("variant")
    x = df.select(F.col(item).alias("item"), F.col(bucket).alias("bucket"), F.try_parse_json(tree).alias("node"))
    run = F.when(F.col("bucket") == "abilities", node).when(F.col("bucket").isin("triggers", "replacements"), at(node, "execute"))
    x = x.withColumn("run", run).withColumn("effect", at(F.col("run"), "effect"))
    typed = is_object(F.col("effect")) & text(F.col("effect"), "type").isNotNull()
    modal = (text(F.col("effect"), "type") == "GenericEffect") & ~set_at(F.col("effect"), "static_abilities") & set_at(F.col("run"), "mode_abilities")
    shape = F.when(F.col("bucket") == "static_abilities", "static").when(typed & modal, "modal").when(typed, "effect").when(F.col("bucket") == "replacements", "replacement").otherwise("none")
    x = x.withColumns({"shape": F.when(is_object(node), shape).otherwise("none"), "wraps": _strings(), "outer": none})
    for _ in range(UNWRAPPED):
        effect, run = F.col("effect"), F.col("run")
        later = (text(effect, "type") == "CreateDelayedTrigger") & is_object(at(effect, "effect"))
        inner = F.when(later, at(effect, "effect")).when(is_object(at(run, "sub_ability")), at(run, "sub_ability"))
        x = x.withColumn("inner", F.when((F.col("shape") == "effect") & text(effect, "type").isin(WRAPPERS), inner))
        go = is_object(at(F.col("inner"), "effect"))
        x = x.withColumn("go", go).withColumns({
            "wraps": F.when(F.col("go"), F.concat("wraps", F.array(text(effect, "type")))).otherwise(F.col("wraps")), "outer": F.when(F.col("go"), effect).otherwise(F.col("outer")),
            "run": F.when(F.col("go"), F.col("inner")).otherwise(run), "effect": F.when(F.col("go"), at(F.col("inner"), "effect")).otherwise(effect),
        })
    effect, run = F.col("effect"), F.col("run")
    steps = F.filter(F.array(*[at(run, ".".join(["sub_ability"] * k)) for k in range(1, deep + 1)]), is_object) if deep else F.expr("cast(array() as array<variant>)")
    own = F.when(F.col("shape") == "static", at(node, "affected")).when(F.col("shape") == "replacement", at(node, "valid_card")).otherwise(_resolved(target_of(effect), run))
    x = x.withColumns({"rtype": F.coalesce(text(effect, "type"), F.lit("")), "steps": steps, "own": own})
    of_step = lambda s: let(target_of(at(s, "effect")), lambda t: _resolved(t, s))
    spells = F.filter(F.transform(entries(at(node, "mode")), lambda e: at(e["value"], "spell_filter")), is_object)
    x = x.withColumns({"modes": F.filter(items(run, "mode_abilities"), is_object), "spells": F.when(F.col("shape") == "static", spells).otherwise(F.expr("cast(array() as array<variant>)")), "shown": F.slice("steps", 1, 3)})
    targets = F.concat(F.array(F.col("own"), target_of(F.col("outer"))), "spells", F.transform("shown", of_step), F.transform("modes", of_step))
    x = x.withColumn("objects", F.transform(targets, lambda v: object_parts(v, unions, implied)))  # all targets of an ability through one expression
    first = F.get("objects", F.lit(0))
    passed = first["core"].isin("TrackedSet", "parent") & (F.col("shape") == "effect") & (F.get("objects", F.lit(1))["core"] != "-")
    at_spells, at_steps = F.lit(3), F.size("spells") + 3
    x = x.withColumns({
        "parts": let(F.when(passed, F.get("objects", F.lit(1))).otherwise(first), _attached),
        "spells": F.transform(F.slice("objects", at_spells, F.size("spells")), lambda p: F.concat(F.lit("/spell:"), _attached(p)["core"])),
        "verbs": F.zip_with("shown", F.slice("objects", at_steps, F.size("shown")), lambda s, p: step_verb(s, p["core"])),
        "mode_verbs": F.zip_with("modes", F.slice("objects", at_steps + F.size("shown"), F.size("modes")), lambda s, p: step_verb(s, p["core"])),
    })
    rt, o, verbs, modes = F.col("rtype"), F.col("parts.core"), F.col("verbs"), _distinct(F.col("mode_verbs"), ">")
    statics = F.when(F.col("shape") == "static", F.array(node)).when(rt == "GenericEffect", items(effect, "static_abilities")).otherwise(F.expr("cast(array() as array<variant>)"))
    x = x.withColumns({"statics": statics, "mode": name_of(at(node, "mode"))})
    changes = F.filter(F.flatten(F.transform("statics", lambda s: items(s, "modifications"))), is_object)
    x = x.withColumn("changes", changes)
    added = F.transform(F.filter("changes", lambda m: F.coalesce(text(m, "type") == "AddKeyword", F.lit(False))), lambda m: _member(at(m, "keyword")))
    granted = F.transform(items(effect, "keywords"), lambda k: F.when(is_object(k), entries(k)[0]["key"]).otherwise(_member(k)))
    static_modes = F.flatten(F.transform("statics", lambda s: F.when(is_object(at(s, "mode")), F.transform(entries(at(s, "mode")), lambda e: e["key"])).otherwise(_strings(F.when(text(s, "mode") != "Continuous", text(s, "mode"))))))
    mods = F.transform("changes", lambda m: text(m, "type"))
    types = F.transform(items(effect, "types"), _member)
    token_core = F.array_sort(F.filter(types, lambda t: t.isin(CORE_TYPES)))
    token = F.concat(F.transform(F.array_sort(F.filter(types, lambda t: ~t.isin(CORE_TYPES))), lambda t: F.concat(F.lit("sub:"), t)), _strings(F.concat(F.lit("name:"), text(effect, "name"))))
    produced = at(effect, "produced")
    effect_obj = F.when(rt == "Token", F.when(F.size(token_core) > 0, F.array_join(token_core, "+")).otherwise("token")).when(rt == "Mana", F.coalesce(F.when(is_object(produced), text(produced, "type")).otherwise(_member(produced)), F.lit("mana"))).otherwise(o)
    there = F.coalesce(text(effect, "destination"), F.lit(""))
    found = F.coalesce(F.get(F.filter(F.transform("steps", lambda s: text(at(s, "effect"), "destination")), lambda d: F.coalesce(d, F.lit("")) != ""), F.lit(0)), F.lit(""))
    to = F.when(rt.isin("Bounce", "BounceAll"), "Hand").when(rt.isin("PutAtLibraryPosition", "PutOnTopOrBottom"), "Library").when(rt.isin(SEARCHES) & (there == ""), found).otherwise(there)
    most = F.coalesce(F.nullif(at(run, "multi_target.max", "long"), F.lit(0)), F.lit(2))
    quant = F.when(rt.endswith("All") | (rt == "DamageEachPlayer"), "all").when(set_at(run, "repeat_for"), "each").when(is_object(at(run, "multi_target")) & (most > 1), "multi").when(o != "-", "one").otherwise("-")
    scope = at(run, "player_scope")
    who = F.when(is_object(scope) & set_at(scope, "type"), F.concat(F.lit("scope:"), text(scope, "type"))).when(o.isin(PLAYERS), o).otherwise(F.coalesce(text(effect, "player"), F.lit("")))
    family = F.create_map(*[F.lit(v) for fam, names in FAMILIES.items() for name in names for v in (name, fam)])
    ftype = F.when(rt == "ExploreAll", "Explore").when(rt.endswith("All"), F.regexp_replace(rt, "All$", "")).otherwise(rt)
    kept = F.transform(F.filter(entries(node), lambda e: (kind(e["value"]) == "STRING") & ~e["key"].isin("description", "event", "mode")), lambda e: F.concat(e["key"], F.lit("="), _member(e["value"])))
    event = F.coalesce(_member(at(node, "event")), F.lit("None"))
    filter_type = text(at(effect, "player_filter"), "type")
    recipient = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in RECIPIENTS.items() for v in pair]), filter_type), F.lower(filter_type), F.lit(""))
    condition = lambda v: F.when(set_at(v, "condition"), "cond").otherwise("")

    def by(empty: str = "", **cases: Column) -> Column:
        """The value for the shape of the ability; where it is none or blank, empty."""
        value = reduce(lambda rest, one: F.when(F.col("shape") == one[0], one[1]).otherwise(rest), cases.items(), F.lit(None))
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(empty))

    fields = {
        "fam": by("none", static=_static_family(F.col("mode")), replacement=F.lit("Replacement"), modal=F.lit("Choice / wrapper"), effect=F.coalesce(F.try_element_at(family, rt), F.lit("Other"))),
        "rtype": by("none", static=F.concat(F.lit("static:"), F.col("mode")), replacement=F.concat(F.lit("repl:"), event), modal=F.lit("Modal"), effect=rt),
        "ftype": by("none", static=F.concat(F.lit("static:"), F.col("mode")), replacement=F.concat(F.lit("repl:"), event), modal=F.lit("Modal"), effect=ftype),
        "frm": by(static=F.array_join("parts.zones", ","), effect=F.coalesce(F.nullif(text(effect, "origin"), F.lit("")), F.get("parts.zones", F.lit(0)))),
        "to": by(effect=to),
        "ctr": by(effect=F.lower(F.coalesce(F.nullif(text(effect, "counter_type"), F.lit("")), text(effect, "counter_kind")))),
        "who": by(effect=who),
        "mods": by(static=_distinct(mods, ","), effect=_distinct(F.concat(static_modes, mods), ",")),
        "obj": by("-", static=F.concat(o, F.array_join("spells", "")), replacement=o, effect=effect_obj),
        "ctrl": by("-", static=F.col("parts.ctrl"), replacement=F.col("parts.ctrl"), effect=F.col("parts.ctrl")),
        "quant": by("-", effect=quant),
        "props": by(static=F.array_join("parts.details", "|"), replacement=F.array_join(F.concat("parts.details", F.array_sort(kept)), "|"), effect=F.array_join("parts.details", "|")),
        "kw": by(static=_distinct(added, "|"), effect=_distinct(F.concat(added, granted), "|")),
        "dur": by(effect=F.coalesce(F.nullif(text(effect, "duration"), F.lit("")), text(run, "duration"))),
        "cond": by(static=condition(node), effect=condition(run)),
        "wrap": by(modal=F.lit("Modal"), effect=F.array_join("wraps", ">")),
        "chain": by(modal=F.concat(F.lit("modes:"), modes), effect=F.concat(F.array_join(verbs, ">"), F.when(F.size("steps") > 3, "+").otherwise(""))),
        "tok": by(effect=F.when(rt == "Token", F.array_join(token, "|")).otherwise("")),
        "sign": by(static=sign_class(none, F.col("statics")), effect=sign_class(effect, F.col("statics"))),
        "recip": by(effect=F.when(rt.isin("DamageEachPlayer", "DamageAll") & set_at(at(effect, "player_filter"), "type"), recipient)),
    }
    return x.select("item", *[fields[f].alias(f) for f in FIELDS], (F.col("shape") != "none").alias("usable"))
