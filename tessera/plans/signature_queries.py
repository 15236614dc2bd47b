"""Signatures of abilities and what stands on them.

The trees are made of documents by shape: each of SHAPES gives the JSON of an ability, with $P the document's source and $T a small number, and the fields
that a reader takes from it by hand.  The SQL knows these fields alone and never reads a tree.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conditions as D
from ..operators import loose as L
from ..operators import pages as A
from ..operators import promotion as P
from ..operators import signature as G
from ..operators import similarity as S
from ..operators import variant as V
from ..operators.stored import stored
from .registry import query

#: (bucket, tree, fields that are not blank).
SHAPES = [
    ("abilities", '{"effect":{"type":"Destroy","target":{"type":"Typed","type_filters":["Creature",{"Non":"Artifact"}],"controller":"Opponent","properties":[{"type":"NotColor","color":"$P"},"Plain"]}},"condition":{"type":"If"}}',
     dict(fam="Destroy", rtype="Destroy", ftype="Destroy", obj="Creature+Non:Artifact", ctrl="Opponent", quant="one", props="NotColor:$P", cond="cond")),
    ("abilities", '{"effect":{"type":"DestroyAll","target":{"type":"Or","filters":[{"type":"Typed","type_filters":["Land"],"controller":"You"},{"type":"And","filters":[{"type":"Typed","type_filters":["Creature"],"controller":"You"},{"type":"Typed","type_filters":["Artifact"],"controller":"You","properties":[{"type":"InZone","zone":"Graveyard"}]}]}]}}}',
     dict(fam="Destroy", rtype="DestroyAll", ftype="Destroy", frm="Graveyard", obj="Artifact&Creature|Land", ctrl="You", quant="all")),
    ("abilities", '{"effect":{"type":"Pump","target":{"type":"Or","filters":[{"type":"SelfRef"},{"type":"Typed","type_filters":[{"Subtype":"$B"}],"controller":"You","properties":[{"type":"EquippedBy","by":"it"}]}]},"power":2,"toughness":{"type":"Fixed","value":-$T},"duration":"EndOfTurn"}}',
     dict(fam="Pump / grant", rtype="Pump", ftype="Pump", obj="$C|self[equipped]", ctrl="mixed", quant="one", props="Subtype:$B", dur="EndOfTurn", sign="$S")),
    ("triggers", '{"execute":{"effect":{"type":"TargetOnly"},"sub_ability":{"effect":{"type":"ChangeZone","origin":"Graveyard","destination":"Hand","target":{"type":"SelfRef"}},"sub_ability":{"effect":{"type":"PutCounter","counter_type":"P1P1","target":{"type":"Typed","type_filters":["Creature"]}},"sub_ability":{"effect":{"type":"Draw"}}}}}}',
     dict(fam="Zone change", rtype="ChangeZone", ftype="ChangeZone", frm="Graveyard", to="Hand", obj="self", quant="one", wrap="TargetOnly", chain="PutCounter/p1p1@Creature>Draw")),
    ("triggers", '{"execute":{"effect":{"type":"CreateDelayedTrigger","effect":{"effect":{"type":"DealDamage","target":{"type":"ParentTarget"}},"duration":"UntilNext"},"target":{"type":"Player"}}}}',
     dict(fam="Damage", rtype="DealDamage", ftype="DealDamage", who="player", obj="player", quant="one", dur="UntilNext", wrap="CreateDelayedTrigger")),
    ("abilities", '{"effect":{"type":"SearchLibrary","filter":{"type":"Typed","type_filters":["Land"]}},"sub_ability":{"effect":{"type":"Shuffle"},"sub_ability":{"effect":{"type":"ChangeZone","destination":"Battlefield"},"sub_ability":{"effect":{"type":"Tap"},"sub_ability":{"effect":{"type":"Draw"}}}}}}',
     dict(fam="Library", rtype="SearchLibrary", ftype="SearchLibrary", to="Battlefield", obj="Land", quant="one", chain="Shuffle>ChangeZone>Battlefield>Tap+")),
    ("abilities", '{"effect":{"type":"GenericEffect"},"mode_abilities":[{"effect":{"type":"Draw"}},{"effect":{"type":"Bounce","target":{"type":"Any"}}},{"effect":{"type":"Draw"}}]}',
     dict(fam="Choice / wrapper", rtype="Modal", ftype="Modal", wrap="Modal", chain="modes:Bounce@any target>Draw")),
    ("abilities", '{"effect":{"type":"GenericEffect","static_abilities":[{"mode":"CantBlock","modifications":[{"type":"AddKeyword","keyword":"Flying"},{"type":"AddPower","value":$T}]},{"mode":{"MustAttack":1}},{"mode":"Continuous"}],"target":{"type":"Typed","type_filters":["Creature"],"properties":[{"type":"EnchantedBy"}]},"keywords":["Haste",{"Ward":2}]}}',
     dict(fam="Pump / grant", rtype="GenericEffect", ftype="GenericEffect", mods="AddKeyword,AddPower,CantBlock,MustAttack", obj="Creature[enchanted]", quant="one", kw="Flying|Haste|Ward", sign="$Z")),
    ("static_abilities", '{"mode":"Continuous","affected":{"type":"Typed","type_filters":["Creature"],"controller":"You","properties":[{"type":"InZone","zone":"Battlefield"},{"type":"Other","n":$T,"deep":{"x":1}}]},"modifications":[{"type":"AddDynamicPower"},{"type":"AddKeyword","keyword":{"Ward":"$P"}}],"condition":{"type":"Metalcraft"}}',
     dict(fam="Static: continuous", rtype="static:Continuous", ftype="static:Continuous", frm="Battlefield", mods="AddDynamicPower,AddKeyword", obj="Creature", ctrl="You", props="Other:$T", kw='{"Ward":"$P"}', cond="cond", sign="unknown")),
    ("static_abilities", '{"mode":{"ReduceCost":{"amount":1,"spell_filter":{"type":"Typed","type_filters":["Instant"]}}},"affected":{"type":"Controller"}}',
     dict(fam="Static: cost change", rtype="static:ReduceCost", ftype="static:ReduceCost", obj="you/spell:Instant")),
    ("static_abilities", '{"mode":"CantAttack","affected":{"type":"TriggeringPlayer"}}', dict(fam="Static: restriction", rtype="static:CantAttack", ftype="static:CantAttack", obj="triggering player")),
    ("replacements", '{"event":"Draw","mode":"Optional","description":"no","player":"$P","valid_card":{"type":"Typed","type_filters":["Spell"],"controller":"You"}}',
     dict(fam="Replacement", rtype="repl:Draw", ftype="repl:Draw", obj="Spell", ctrl="You", props="player=$P")),
    ("replacements", '{"event":"Enter","execute":{"effect":{"type":"PutCounterAll","counter_kind":"LORE","target":{"type":"Typed","type_filters":["Permanent"]}},"player_scope":{"type":"$P"}}}',
     dict(fam="Counters", rtype="PutCounterAll", ftype="PutCounter", ctr="lore", who="scope:$P", obj="Permanent", quant="all")),
    ("abilities", '{"effect":{"type":"Token","types":["Creature","Goblin","Artifact","$B"],"name":"Thing $T"},"repeat_for":{"type":"Count"}}',
     dict(fam="Tokens", rtype="Token", ftype="Token", obj="Artifact+Creature", quant="each", tok="sub:$B|sub:Goblin|name:Thing $T")),
    ("abilities", '{"effect":{"type":"Mana","produced":{"type":"Any$T"}},"multi_target":{"max":3}}', dict(fam="Mana", rtype="Mana", ftype="Mana", obj="Any$T", quant="multi")),
    ("triggers", '{"execute":{"effect":{"type":"DamageEachPlayer","player_filter":{"type":"Opponent"},"player":"Owner"}}}',
     dict(fam="Damage", rtype="DamageEachPlayer", ftype="DamageEachPlayer", who="Owner", quant="all", recip="opponents")),
    ("abilities", '{"effect":{"type":"Bounce","target":{"type":"ParentTarget"}},"repeat_for":{"type":"Ref","qty":{"type":"ObjectCount","filter":{"type":"Typed","type_filters":["Enchantment"]}}}}',
     dict(fam="Zone change", rtype="Bounce", ftype="Bounce", to="Hand", obj="Enchantment", quant="each")),
    ("abilities", '{"effect":{"type":"ExploreAll","valid_target":{"type":"Odd$T"}}}', dict(fam="Library", rtype="ExploreAll", ftype="Explore", obj="Odd$T", quant="all")),
    ("abilities", '{"effect":{"type":"DamageAll","target":{"type":"Or","filters":[]},"player_filter":{"type":"Attacker"}}}', dict(fam="Damage", rtype="DamageAll", ftype="Damage", obj="Or", ctrl="mixed", quant="all", recip="attacker")),
    ("abilities", '{"effect":{"type":"NewThing","target":"$P"},"duration":"Forever"}', dict(fam="Other", rtype="NewThing", ftype="NewThing", dur="Forever")),
    ("abilities", '{"effect":"$P"}', dict()),
    ("triggers", "no tree $P", dict()),
    ("abilities", '{"effect":{"type":"Pump","target":{"type":"DefendingPlayer"},"power":{"type":"Variable","value":"-X"},"toughness":{"type":"Variable","value":"-X"}}}',
     dict(fam="Pump / grant", rtype="Pump", ftype="Pump", who="defending player", obj="defending player", quant="one", sign="shrink")),
    ("abilities", '{"effect":{"type":"PutOnTopOrBottom","target":{"type":"ParentTargetController"}},"sub_ability":{"effect":{"type":"Scry"}},"multi_target":{"max":1}}',
     dict(fam="Zone change", rtype="PutOnTopOrBottom", ftype="PutOnTopOrBottom", to="Library", who="its controller", obj="its controller", quant="one", chain="Scry")),
    ("abilities", '{"effect":{"type":"Regenerate","target":{"type":"Typed","type_filters":["Creature"]},"note":"$P"}}', dict(fam="Protection", rtype="Regenerate", ftype="Regenerate", obj="Creature", quant="one")),
    ("abilities", '{"effect":{"type":"Rare $P $T","target":{"type":"Typed","type_filters":["Land"]}}}', dict(fam="Other", rtype="Rare $P $T", ftype="Rare $P $T", obj="Land", quant="one")),
]
BLANK = dict(fam="none", rtype="none", ftype="none", obj="-", ctrl="-", quant="-")


def abilities(read):
    """Documents as abilities, a shape for each id in turn: item, card, bucket, tree."""
    o = read("documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), "n_chars").withColumn("k", (F.col("doc_id") % len(SHAPES)).cast("int"))
    filled = F.get(F.lit([s[1] for s in SHAPES]), F.col("k"))
    number = (F.col("n_chars") % 5).cast("string")
    for mark, value in (("$P", F.col("source")), ("$T", number), ("$B", F.concat(F.lit("Brand#"), number))):
        filled = F.replace(filled, F.lit(mark), value)
    return o.select(F.col("doc_id").alias("item"), F.col("source").alias("card"), F.get(F.lit([s[0] for s in SHAPES]), F.col("k")).alias("bucket"), filled.alias("tree"))


def subtype_pairs(read):
    """A subtype and a core type for each part; brands 1 and 2 have two core types, the others one."""
    brand = F.concat(F.lit("Brand#"), (F.col("p_partkey") % 5).cast("string"))
    core = F.when((F.col("p_partkey") % 5).isin(1, 2) & (F.col("p_size") % 2 == 0), "Land").otherwise("Creature")
    return read("part").select(brand.alias("brand"), core.alias("core"))


def implied(read) -> dict[str, str]:
    """Subtypes and their core types; a vocabulary, so bounded by the game and not by the data."""
    return {r["subtype"]: r["core"] for r in G.implied_cores(subtype_pairs(read), "brand", "core").collect()}


_EXPECTED = ", ".join("(" + ", ".join([str(k)] + ["'" + (BLANK | fields).get(f, "").replace("'", "''") + "'" for f in G.FIELDS] + [str(bool(fields)).lower()]) + ")" for k, (_, _, fields) in enumerate(SHAPES))
_FILL = "replace(replace(replace(replace(replace(replace({f}, '$P', source), '$T', (n_chars % 5)::varchar), '$B', 'Brand#' || (n_chars % 5)), '$C', case when n_chars % 5 in (1, 2) then 'object' else 'Creature' end), '$S', case when n_chars % 5 = 0 then 'boost' else 'mixed' end), '$Z', case when n_chars % 5 = 0 then 'zero' else 'boost' end)"
SIGNATURES = f"""want(k, {", ".join(f'"{f}"' for f in G.FIELDS)}, usable) as (values {_EXPECTED}),
sig as (select doc_id item, source as card, {", ".join(_FILL.format(f=f'"{f}"') + f' as "{f}"' for f in G.FIELDS)}, usable from (select doc_id, coalesce(source, 'none') source, n_chars from documents) join want on doc_id % {len(SHAPES)} = k)"""


def signed(read):
    return G.signatures(abilities(read), "item", "bucket", "tree", implied(read))


@query("sig_fields", f"with {SIGNATURES} select * exclude (card) from sig")
def sig_fields(read):
    return signed(read)


#: (type token, target shape) of each of SHAPES, by hand; none where an ability has no effect.
FEATURES = [
    ("eff:Destroy", "Typed[Creature,Non:Artifact]@Opponent{NotColor:$P,Plain}"), ("eff:DestroyAll", "Or"), ("eff:Pump", "Or"), ("eff:TargetOnly", None), ("eff:CreateDelayedTrigger", "Player"), ("eff:SearchLibrary", "Typed[Land]@Any"),
    ("eff:GenericEffect", None), ("eff:GenericEffect", "Typed[Creature]@Any{EnchantedBy}"), ("eff:static:Continuous", "Typed[Creature]@You{InZone:Battlefield,Other:$T}"), ("eff:static:ReduceCost", "Controller"), ("eff:static:CantAttack", "TriggeringPlayer"), (None, None),
    ("eff:PutCounterAll", "Typed[Permanent]@Any"), ("eff:Token", None), ("eff:Mana", None), ("eff:DamageEachPlayer", None), ("eff:Bounce", "ParentTarget"), ("eff:ExploreAll", "Odd$T"), ("eff:DamageAll", "Or"), ("eff:NewThing", None),
    (None, None), (None, None), ("eff:Pump", "DefendingPlayer"), ("eff:PutOnTopOrBottom", "ParentTargetController"), ("eff:Regenerate", "Typed[Creature]@Any"), ("eff:Rare $P $T", "Typed[Land]@Any"),
]
_TOKENS = ", ".join(f"({k}, '{t}')" for k, (kind, shape) in enumerate(FEATURES) for t in ([kind] if kind else []) + ([f"{kind}|tgt:{shape}", f"tgt:{shape}"] if shape else []))


@query("card_features", f"with t(k, t) as (values {_TOKENS}) select coalesce(source, 'none') card, {_FILL.format(f='t').replace('source', "coalesce(source, 'none')")} token, count(*) n from documents join t on doc_id % {len(SHAPES)} = k group by 1, 2")
def card_features(read):
    """Tokens of the abilities of a card (here a source), counted: effect types, types with target shapes, target shapes."""
    x = G.features(abilities(read), "bucket", "tree")
    return x.select("card", F.explode("features").alias("token")).groupBy("card", "token").agg(F.count(F.lit(1)).alias("n"))


#: Fields of the families, most important first, and what large groups are split by.
LOOSE = {"Zone change": ["to", "frm", "ctrl"], "Destroy": ["ctrl", "obj", "props"], "Pump / grant": ["quant", "obj", "sign"], "Damage": ["who", "obj"], "Tokens": ["quant", "tok"]}
REFINE = {"Destroy": ["quant", "obj"], "Pump / grant": ["sign", "mods"], "Library": ["chain", "obj"], "Zone change": ["obj"], "Tokens": ["tok"], "Counters": ["who"]}
DEFAULT = ["obj"]


def _case(lists, k, value, default=()):
    own = [f"when '{f}' then {value(x[k])}" for f, x in lists.items() if len(x) > k]
    rest = value(default[k]) if len(default) > k else "null"
    return f"case when fam not in ({', '.join(repr(f) for f in lists)}) then {rest} else case fam {' '.join(own)} end end" if own else rest


def _loose_sql() -> str:
    one = lambda f: "'|" + f + "=' || length(\"" + f + "\") || ':' || \"" + f + "\""
    deepest = max(map(len, LOOSE.values()))
    ctes = ["l0 as (select item, item // 2 card, fam, fam || '/' || ftype base, " + ", ".join(f"{_case(LOOSE, k, one, DEFAULT)} p{k}" for k in range(deepest)) + ", " + ", ".join(f'"{f}"' for f in sorted({f for x in REFINE.values() for f in x})) + ", null::varchar k from sig where usable)"]
    at = 0
    for level in range(deepest, -1, -1):
        whole = f"base || '#{level}'" + "".join(f" || p{k}" for k in range(level))
        ctes.append(f"t{at} as (select *, case when k is null then {whole} end tr from l{at})")
        ctes.append(f"l{at + 1} as (select t.* exclude (k, tr), coalesce(t.k, case when {level} = 0 or c >= {L.LEAST} then t.tr end) k from t{at} t left join (select tr, count(distinct card) c from t{at} group by 1) using (tr))")
        at += 1
    ctes.append(f"w as (select l.*, k as whole, k as part from l{at} l)")
    ctes.append("r0 as (select w.*, n from w join (select whole, count(distinct card) n from w group by 1) using (whole))")
    for k in range(max(map(len, REFINE.values()))):
        value = _case(REFINE, k, lambda f: f"""case when "{f}" <> '' then part || {one(f)} end""")
        ctes.append(f"s{k} as (select *, {value} sp from r{k})")
        ctes.append(f"r{k + 1} as (select s.* exclude (part, sp), case when n > {L.OVER} and cp > {L.OVER} and cs >= {L.LEAST} then sp else part end part from s{k} s left join (select part, count(distinct card) cp from s{k} group by 1) using (part) left join (select sp, count(distinct card) cs from s{k} group by 1) using (sp))")
    last = max(map(len, REFINE.values()))
    ctes.append(f"f as (select item, card, fam, case when c < {L.LEAST} then fam || '/OTHER' else part end grp from r{last} join (select part, count(distinct card) c from r{last} group by 1) using (part))")
    return ", ".join(ctes) + f" select item, card, fam as family, grp as key, case when grp = fam || '/OTHER' then 'bucket' when n > {L.WIDE} then 'catchall' else 'group' end kind, n as cards from f join (select grp, count(distinct card) n from f group by 1) using (grp)"


@query("loose_groups", f"with {SIGNATURES}, {_loose_sql()}")
def loose_groups(read):
    """Loose groups of the abilities, two to a card."""
    x = signed(read).where("usable").withColumnsRenamed({"fam": "family", "ftype": "type"}).withColumn("card", F.floor(F.col("item") / 2))
    return L.loose_groups(x, LOOSE, REFINE, DEFAULT)


#: Of the string fields of each effect but its type, and its chained steps, by hand.
SIGNED = {2: "duration=EndOfTurn|0", 3: "|1", 5: "|2", 12: "counter_kind=LORE|0", 13: "name=Thing $T|0", 15: "player=Owner|0", 19: "target=$P|0", 23: "|1", 24: "note=$P|0"}
_TOKS = ", ".join(f"({k}, '{t}')" for k, (kind, shape) in enumerate(FEATURES) for t in ([kind] if kind else []) + ([f"{kind}|tgt:{shape}", f"tgt:{shape}"] if shape else []))
_SIGN = ", ".join(f"({k}, '{SIGNED.get(k, '|0')}', '{(kind or '').removeprefix('eff:')}')" for k, (kind, _) in enumerate(FEATURES))


def signed_effect(x):
    """The string fields of an ability's own effect but its type, with the number of chained steps, two at most."""
    node = F.try_parse_json("tree")
    run = F.when(F.col("bucket") == "abilities", node).otherwise(G.at(node, "execute"))
    x = x.withColumn("run", run).withColumn("effect", G.at(F.col("run"), "effect"))
    strings = F.transform(F.filter(G.entries(F.col("effect")), lambda e: (G.kind(e["value"]) == "STRING") & (e["key"] != "type")), lambda e: F.concat(e["key"], F.lit("="), F.try_variant_get(e["value"], "$", "string")))
    steps = F.when(G.at(F.col("run"), "sub_ability.sub_ability").isNotNull(), "2").when(G.at(F.col("run"), "sub_ability").isNotNull(), "1").otherwise("0")
    signature = F.concat(F.array_join(F.array_sort(strings), ","), F.lit("|"), steps)
    return x.withColumns({"signature": signature, "type": G.text(F.col("effect"), "type"), "scoped": G.set_at(F.col("run"), "player_scope"), "modal": G.set_at(F.col("run"), "mode_abilities")}).drop("run", "effect", "tree", "bucket")


@query("ability_promotion", f"""with t0(k, t) as (values {_TOKS}), s0(k, sg, leaf) as (values {_SIGN}), d as (select doc_id item, coalesce(source, 'none') source, n_chars, doc_id % {len(SHAPES)} k, case when doc_id % 10 = 5 then 'an opponent loses, graveyard' when doc_id % 15 = 0 then '  ' else 'target player draws, graveyard' end tx from documents where doc_id % {len(SHAPES)} not in (8, 9, 10, 11, 20, 21)),
tk as (select item, {_FILL.format(f='t')} t from d join t0 using (k)), ks as (select item, count(*) n, array_to_string(list_sort(list(t)), chr(10)) ky from tk group by 1), sn as (select item, k, tx, {_FILL.format(f='sg')} sg, {_FILL.format(f='leaf')} own from d join s0 using (k)),
idf as (select t, ln((1 + (select count(*) from d))::double / (1 + count(*))) + 1 v from tk group by 1), un as (select item, t, v / sqrt(sum(v * v) over (partition by item)) w from tk join idf using (t)),
mb as (select * from sn where item % 5 <> 0), sz as (select own leaf, count(*) size from mb group by 1), ce as (select own leaf, t, sum(w) / any_value(size) m from un join mb using (item) join sz on leaf = own group by 1, 2), cn as (select leaf, t, m / sqrt(sum(m * m) over (partition by leaf)) c from ce),
dt as (select item, leaf, sum(w * c) s from un join cn using (t) where item % 5 = 0 group by 1, 2), be as (select item, leaf, s from dt qualify row_number() over (partition by item order by round(s, 9) desc, leaf) = 1),
sa as (select own leaf, ky, sg, count(*) k from mb join ks using (item) group by 1, 2, 3), ev as (select leaf, ky, sum(k) n from sa group by 1, 2),
op as (select own leaf, avg((tx like '%opponent%')::int) o, avg((tx like 'target%')::int) p, avg((tx like '%graveyard%')::int) g from mb group by 1)
select c.item, be.leaf, case when s < 0.9 then 'below' when ks.n = 1 or size >= 500 then 'generic_leaf' when ks.n < 3 or size > 300 then 'in_between' when trim(tx) = '' then 'no_text' when c.item % 8 = 0 then 'flagged' when c.k = 6 then 'modal' when c.k in (12, 16) then 'type'
 when (tx like '%opponent%' and o < 0.2) or (tx like 'target%' and p < 0.2) or (tx like '%graveyard%' and g < 0.2) then 'wording' when coalesce(ev.n, 0) < 2 then 'structure_unknown' when coalesce(sa.k, 0) < 2 or sa.k < 0.15 * ev.n then 'structure' end gate
from sn c join be using (item) join ks using (item) join sz on sz.leaf = be.leaf join op on op.leaf = be.leaf left join ev on ev.leaf = be.leaf and ev.ky = ks.ky left join sa on sa.leaf = be.leaf and sa.ky = ks.ky and sa.sg = c.sg""")
def ability_promotion(read):
    """Every fifth ability against the leaves of the others, leaves being effect types."""
    x = G.features(abilities(read).where("bucket <> 'static_abilities'"), "bucket", "tree").where("size(features) > 0")
    i = F.col("item")
    text = F.when(i % 10 == 5, "an opponent loses, graveyard").when(i % 15 == 0, "  ").otherwise("target player draws, graveyard")
    x = stored(signed_effect(x).withColumns({"tokens": F.array_sort("features"), "text": text, "flagged": i % 8 == 0}))
    members = x.where("item % 5 <> 0").withColumn("leaf", F.col("type"))
    vectors = stored(S.weighted(x, "item", "tokens", smooth=True))
    found = P.nearest_leaf(vectors.where("item % 5 = 0"), S.centroids(vectors, members.select("item", "leaf"), "leaf"))
    return P.gates(x.where("item % 5 = 0").join(found, "item"), members)


#: (text, tree, tier, families missing, families short): what a reader finds dropped.
STATED = [
    ("Draw a card.", '{"effect":{"type":"Draw"}}', None, "", ""),
    ("If you control $P, draw.", '{"effect":{"type":"Draw"}}', "A", "GEN", ""),
    ("If you control $P, draw.", '{"effect":{"type":"Draw"},"condition":{"type":"Controls","x":{"condition":{"type":"IfYouDo"}}}}', None, "", ""),
    ("If you do, draw. If it is red, gain life.", '{"sub_ability":{"condition":{"type":"IfYouDo"},"effect":{"type":"Draw"}}}', "A", "GEN", ""),
    ("If it is red, draw. If it is blue, gain life.", '{"effect":{"type":"Draw"},"conditions":[{"type":"Red"}]}', "B", "", "GEN"),
    ("If it is red, draw.", '{"effect":{"type":"Draw"},"condition":{"type":"WhenDies"}}', "A", "GEN", ""),
    ("If you do, draw.", '{"effect":{"type":"Draw"},"condition":{"type":"Unrecognized","text":"$P"}}', None, "", ""),
    ("If it is red, draw.", '{"effect":{"type":"Draw"},"constraint":{"type":"OnlyOnce"}}', "A", "GEN", ""),
    ("If it is red, draw.", '{"effect":{"type":"Draw","steps":[[{"constraint":{"type":"$P"}}]]}}', None, "", ""),
    ("If you do, draw.", '{"mode":{"decline":{"type":"Sacrifice"}}}', None, "", ""),
    ("If you do, draw. If you do, draw.", '{"mode":{"decline":{"type":"Sacrifice"}}}', "B", "", "DO"),
    ("If it is red, draw.", '{"else_ability":{"effect":{"type":"Draw"}}}', None, "", ""),
    ("If it is red, draw.", '{"effect":{"type":"DealDamage","combat_scope":"$P"}}', None, "", ""),
    ("Draw.", '{"effect":{"type":"FlipCoin","win_effect":{"type":"Draw"}},"sub_ability":{"effect":{"type":"Tap"}}}', "B", "", "STRUCT"),
    ("Draw.", None, None, "", ""),
    ("Attack each turn if able, even if tapped (If you do, draw.) and say \"if it is red\".", '{"effect":{"type":"Draw"}}', None, "", ""),
    ("Activate only if it is red or if it is blue. If you win the flip, draw.", '{"effect":{"type":"FlipCoin","win_effect":{"type":"Draw"}},"activation_restrictions":[{"type":"AsSorcery"},{"type":"OnlyOnce"}]}', "A", "RESTR", ""),
    ("Activate only if it is red or if it is blue.", '{"activation_restrictions":[{"type":"RequiresCondition","data":{"condition":{"type":"Red","condition":{"type":"IfYouDo"}}}}]}', None, "", ""),
    ("If that player does, draw; if they can't, gain life.", '{"sub_ability":{"condition":{"type":"IfAPlayerDoes"}}}', "B", "", "DO"),
]
_STATED = ", ".join(f"({k}, {f"'{t}'" if t else 'null'}, '{m}', '{s}')" for k, (_, _, t, m, s) in enumerate(STATED))


@query("condition_drop_detect", f"with w(k, tier, missing, short) as (values {_STATED}) select doc_id item, tier, missing, short from documents join w on doc_id % {len(STATED)} = k where tier is not null")
def condition_drop_detect(read):
    """Documents as abilities with a text and a tree, some of whose conditions are in the text alone."""
    x = read("documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source")).withColumn("k", (F.col("doc_id") % len(STATED)).cast("int"))
    filled = lambda place: F.replace(F.get(F.lit([s[place] or "" for s in STATED]), F.col("k")), F.lit("$P"), F.col("source"))
    x = x.select("doc_id", F.lit("abilities").alias("bucket"), filled(0).alias("text"), F.nullif(filled(1), F.lit("")).alias("tree"))
    return D.drops(x, "doc_id", "bucket", "text", "tree").select("item", "tier", F.array_join("missing", ",").alias("missing"), F.array_join("short", ",").alias("short"))


_TYPED = '{"type":"Typed","type_filters":["Creature"]}'
_SELF = '{"type":"Or","filters":[{"type":"Typed","type_filters":["Creature"]},{"type":"Or","filters":[{"type":"SelfRef"}]}]}'
_COST = '{"type":"Composite","costs":[{"type":"Mana"},{"type":"Composite","costs":[{"type":"%s"%s}]}]}'
#: (bucket, tree, pages that a reader puts it on).
PAGED = [
    ("triggers", '{"mode":"ChangesZone","destination":"Battlefield","valid_card":{"type":"SelfRef"}}', "trig.enters"),
    ("triggers", '{"mode":"ChangesZone","destination":"Battlefield","valid_card":{"type":"SelfRef"},"description":"Chapter 2 of $P"}', ""),
    ("triggers", f'{{"mode":"ChangesZone","destination":"Battlefield","valid_card":{_SELF}}}', "trig.enters trig.enters-other"),
    ("triggers", '{"mode":"ChangesZone","destination":"Battlefield","valid_card":{"type":"Typed","type_filters":["Land"]}}', "trig.landfall"),
    ("triggers", '{"mode":"ChangesZone","destination":"Battlefield","valid_card":{"type":"Typed","type_filters":[{"Land":1}]}}', "trig.landfall"),
    ("triggers", '{"mode":"ChangesZone","origin":"Battlefield","destination":"Graveyard","valid_card":{"type":"SelfRef"}}', "trig.dies"),
    ("triggers", f'{{"mode":"ChangesZone","origin":"Battlefield","destination":"Graveyard","valid_card":{_TYPED}}}', "trig.dies-other"),
    ("triggers", '{"mode":"ChangesZone","origin":"Hand","destination":"Graveyard","valid_card":{"type":"SelfRef"}}', ""),
    ("triggers", '{"mode":"LeavesBattlefield"}', "trig.leaves"), ("triggers", '{"mode":"AttacksOrBlocks"}', "trig.attacks trig.blocks"), ("triggers", '{"mode":"YouAttack"}', "trig.you-attack"),
    ("triggers", '{"mode":{"DamageDone":1},"damage_kind":"CombatOnly"}', "trig.combat-damage"), ("triggers", '{"mode":"DamageDone","damage_kind":"$P"}', ""),
    ("triggers", '{"mode":"Phase","phase":"Upkeep"}', "trig.upkeep"), ("triggers", '{"mode":"Phase","phase":"End"}', "trig.end-step"), ("triggers", '{"mode":"Phase","phase":"BeginCombat"}', "trig.begin-combat"),
    ("triggers", f'{{"mode":"SpellCast","valid_card":{_TYPED}}}', "trig.cast"), ("triggers", '{"mode":"SpellCastOrCopy","valid_card":{"type":"SelfRef"}}', ""), ("triggers", '{"mode":"Drawn"}', "trig.draw"),
    ("triggers", '{"mode":"CounterAdded"}', "trig.counter-added"), ("triggers", '{"mode":"LifeGained"}', "trig.life-gained"), ("triggers", '{"mode":"BecomesTarget"}', "trig.becomes-target"), ("triggers", '{"mode":{"Unknown":"Drawn","A":1}}', ""),
    ("abilities", '{"kind":"Activated","description":"$P","effect":{"type":"Mana"},"cost":{"type":"Tap"}}', "act.mana-abilities"), ("abilities", '{"kind":"Activated","description":"x","effect":{"type":"Draw"},"cost":' + _COST % ("Tap", "") + "}", "act.tap"),
    ("abilities", '{"kind":"Activated","description":"x","effect":{"type":"Draw"},"cost":' + _COST % ("Mana", "") + "}", "act.mana"), ("abilities", '{"kind":"Activated","description":"x","effect":{"type":"Attach"},"cost":{"type":"Mana"}}', ""),
    ("abilities", '{"kind":"Activated","description":"x","cost":' + _COST % ("Sacrifice", "") + "}", "act.sacrifice"), ("abilities", '{"kind":"Activated","cost":{"type":"Sacrifice"}}', ""),
    ("abilities", '{"kind":"Activated","description":"x","cost":' + _COST % ("Discard", "") + "}", "act.discard"), ("abilities", '{"kind":"Activated","description":"x","cost":' + _COST % ("Discard", ',"self_ref":true') + "}", ""),
    ("abilities", '{"kind":"Activated","description":"x","cost":' + _COST % ("Exile", ',"zone":"Graveyard"') + "}", "act.exile-gy"), ("abilities", '{"kind":"Activated","description":"x","cost":{"type":"RemoveCounter"}}', "act.remove-counter"),
    ("abilities", '{"kind":"Activated","description":"x","cost":{"type":"PayLife"}}', "act.pay-life"), ("abilities", '{"kind":"Activated","cost":{"type":"Loyalty"}}', "act.loyalty"), ("abilities", '{"kind":"Spell","description":"x","cost":{"type":"Tap"}}', ""),
    ("static_abilities", f'{{"mode":"Continuous","affected":{_TYPED},"modifications":[{{"type":"AddPower"}},{{"type":"AddKeyword"}}]}}', "stat.anthem stat.keyword-grant"), ("static_abilities", f'{{"mode":"Continuous","affected":{_SELF},"modifications":[{{"type":"AddPower"}}]}}', ""),
    ("static_abilities", '{"mode":"Continuous","affected":{"type":"Or","filters":[{"type":"Typed","type_filters":["Creature"],"properties":[{"type":"EquippedBy"}]}]},"modifications":[{"type":"AddToughness"}]}', "stat.attached-bonus"),
    ("static_abilities", '{"mode":{"ReduceCost":{}}}', "stat.cost-reduce"), ("static_abilities", '{"mode":"RaiseCost"}', "stat.cost-raise"), ("static_abilities", '{"mode":"CantAttackOrBlock"}', "stat.cant-block stat.cant-attack"), ("static_abilities", '{"mode":{"CantBeBlockedBy":"$P"}}', "stat.evasion"),
    ("static_abilities", '{"mode":"CantBeCountered"}', "stat.cant-be-countered"), ("static_abilities", '{"mode":"CantUntap"}', "stat.cant-untap"), ("static_abilities", '{"mode":"MustAttack"}', "stat.must-attack"), ("static_abilities", '{"mode":"Continuous","affected":{"type":"Typed"},"modifications":[{"type":"AddPower"}]}', ""),
    ("replacements", '{"event":"Moved","execute":{"effect":{"type":"Tap"}}}', "repl.etb-tapped"), ("replacements", '{"event":"ChangeZone","execute":{"effect":{"type":"PutCounter"}}}', "repl.etb-counters"), ("replacements", '{"event":"Moved","execute":{"effect":{"type":"PutCounter"}},"description":"Saga ETB"}', ""),
    ("replacements", '{"event":"DamageDone"}', "repl.damage"), ("replacements", '{"event":"Moved","destination_zone":"Graveyard","execute":{"effect":{"type":"ChangeZone"}}}', "repl.dies-exile"), ("replacements", '{"event":"Destroy","execute":{"effect":{"type":"ChangeZone"}}}', "repl.dies-exile"),
    ("replacements", '{"event":"Moved","destination_zone":"$P","execute":{"effect":{"type":"ChangeZone"}}}', ""), ("triggers", "no tree", ""), ("none", '{"mode":"Drawn"}', ""),
]
_PAGED = ", ".join(f"({k}, '{p}')" for k, (_, _, own) in enumerate(PAGED) for p in own.split())


@query("ability_page_predicates", f"with w(k, page) as (values {_PAGED}) select page, doc_id as item from documents join w on doc_id % {len(PAGED)} = k")
def ability_page_predicates(read):
    """Documents as abilities on the pages of all four kinds."""
    x = read("documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source")).withColumn("k", (F.col("doc_id") % len(PAGED)).cast("int"))
    x = x.select("doc_id", F.get(F.lit([p[0] for p in PAGED]), F.col("k")).alias("bucket"), F.replace(F.get(F.lit([p[1] for p in PAGED]), F.col("k")), F.lit("$P"), F.col("source")).alias("tree"))
    return A.pages(x, "doc_id", "bucket", "tree")


#: (tree, gaps as kind, category, text): $P is the name of the item, $N a number.
GAPS = [
    ('{"abilities":[{"effect":{"type":"Unimplemented","name":"scry","description":"$P, the Old scries  $N cards."}}]}', [("Unimplemented", "Unimplemented:scry", "~ scries N cards")]),
    ('{"triggers":[{"mode":{"Unknown":"When $P sees $N."},"execute":{"effect":{"type":"GenericEffect"}}}]}', [("unmodelled", "Unknown trigger mode", "when ~ sees N"), ("GenericEffect", "GenericEffect[?]", "GenericEffect[?]")]),
    ('{"abilities":[{"modal":true,"mode_abilities":[1],"effect":{"type":"GenericEffect"}}]}', []), ('{"abilities":[{"effect":{"type":"GenericEffect","static_abilities":[{"mode":"CantBlock"}]}}]}', []),
    ('{"abilities":[{"condition":{"type":"Unrecognized","text":"If $N, or $N:"},"effect":{"type":"Draw"}}],"replacements":[{"execute":{"effect":{"type":"Unimplemented"}}}]}', [("unmodelled", "Unrecognized condition", "if N, or N"), ("Unimplemented", "Unimplemented:None", "")]),
]
_GAPS = ", ".join(f"({k}, '{a}', '{b}', '{c}')" for k, (_, found) in enumerate(GAPS) for a, b, c in found)


@query("gap_fragments", f"with w(k, kind, category, text) as (values {_GAPS}) select kind, category, w.text as text, count(*) n, count(distinct doc_id) items from documents join w on doc_id % {len(GAPS)} = k group by 1, 2, 3")
def gap_fragments(read):
    """What could not be read in the trees of documents, as counted fragments."""
    x = read("documents").select("doc_id", F.concat(F.lit("Elf "), F.col("doc_id").cast("string"), F.lit(", the Old")).alias("name"), (F.col("doc_id") % len(GAPS)).cast("int").alias("k"), F.col("n_chars").cast("string").alias("n"))
    tree = F.replace(F.replace(F.get(F.lit([g[0] for g in GAPS]), F.col("k")), F.lit("$P"), F.substring_index("name", ",", 1)), F.lit("$N"), F.coalesce("n", F.lit("0")))
    found = V.gap_fragments(x.withColumn("tree", tree), "doc_id", "name", "tree")
    return found.groupBy("kind", "category", "text").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item").alias("items"))
