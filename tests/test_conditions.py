"""Stated conditions by a walk over each if; evidence in trees by recursion."""

import json
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import conditions as C


def stated_by_force(text, bucket):
    t = re.sub(r"\([^()]*\)", " ", text or "").lower()
    t = re.sub("[\"“][^\"”]*[\"”]", " ", t)
    for p in C.NO_CONDITION:
        t = re.sub(p, " ", t)
    if bucket == "replacements":
        t = re.sub(C.EVENT, " ", t)
    out, limited = Counter(), set()
    for m in re.finditer(r"\bif\b", t):
        start = max([0] + [x.end() for x in re.finditer(r"\. |\n|; ", t) if x.end() <= m.start()])
        if re.match(C.DO, t[m.start() :]):
            out["DO"] += 1
        elif re.match(C.FLIP, t[m.start() :]):
            out["FLIP"] += 1
        elif re.search(r"\bonly\b", t[start : m.start()]):
            limited.add(start)
        else:
            out["GEN"] += 1
    out["RESTR"] = len(limited)
    return {f: out[f] for f in C.FAMILIES}


def test_stated_equals_force(spark):
    rng = random.Random(3)
    pieces = ["If you do, ", "if it is red", "if they can't.", " only ", "even if ", "if able", ". ", "; ", "\n", "(if x) ", "\"if y\" ", "if that player loses ", "draw", " if a card would leave, ", "If you win the flip", ", "]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 9))) if i else None, rng.choice(["abilities", "replacements"])) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, t string, b string")
    got = {r["i"]: {f: r[f] for f in C.FAMILIES} for r in df.select("i", *[c.alias(f) for f, c in C.stated(F.col("t"), F.col("b")).items()]).collect()}
    for i, t, b in rows:
        assert got[i] == stated_by_force(t, b), t


def evidence_by_force(node, out, barred=False):
    if isinstance(node, list):
        for x in node:
            evidence_by_force(x, out, barred)
    if not isinstance(node, dict):
        return
    eff = node.get("effect")
    if isinstance(eff, dict) and eff.get("type") == "FlipCoin" and (eff.get("win_effect") or eff.get("lose_effect")) and node.get("sub_ability"):
        out["STRUCT"] += 1
    for k, v in node.items():
        t = v.get("type") if isinstance(v, dict) else None
        below = barred or k == "condition" or k == "activation_restrictions"
        if not barred:
            if k == "condition" and isinstance(v, dict):
                fam = "WILD" if t in C.UNREAD else "DO" if t in C.DONE else None if t in C.DELAYED else "GEN"
            elif k == "condition":
                fam = "GEN" if v is not None else None
            elif k == "conditions" or k in C.STRUCTURAL:
                fam = "GEN" if v else None
            elif k == "constraint":
                fam = "GEN" if isinstance(v, dict) and t not in C.TIMING else None
            elif k in ("win_effect", "lose_effect"):
                fam = "FLIP" if v else None
            else:
                fam = {"decline": "DO", "else_ability": "WILD"}.get(k) if v else None
            if fam:
                out[fam] += 1
            if k == "activation_restrictions" and isinstance(v, list):
                for r in v:
                    rt = r.get("type") if isinstance(r, dict) else None
                    if rt == "RequiresCondition":
                        data = r.get("data")
                        out["RESTR"] += isinstance(data, dict) and data.get("condition") is not None
                    elif rt not in C.TIMING:
                        out["RESTR"] += 1
        evidence_by_force(v, out, below)


def test_evidence_equals_recursion(spark):
    rng = random.Random(5)
    names = ["condition", "conditions", "constraint", "decline", "win_effect", "else_ability", "effect", "sub_ability", "combat_scope", "data", "other"]
    types = ["IfYouDo", "WhenDies", "Unrecognized", "OnlyOnce", "Red", "FlipCoin", None]

    def tree(depth):
        if depth == 0:
            return rng.choice([None, 0, "x", [], {}, True])
        node = {n: rng.choice([tree(depth - 1), [tree(depth - 1), [tree(depth - 1)]]]) for n in rng.sample(names, rng.randrange(0, 5))}
        if rng.random() < 0.7 and (t := rng.choice(types)):
            node["type"] = t
        if rng.random() < 0.3:
            node["activation_restrictions"] = [rng.choice([{"type": "RequiresCondition", "data": {"condition": rng.choice([None, {"type": "Red", "condition": {"type": "IfYouDo"}}])}}, {"type": "AsSorcery"}, {"type": "Odd"}, "word"]) for _ in range(2)]
        return node

    trees = [None, {}] + [tree(rng.randrange(1, 5)) for _ in range(300)]
    df = spark.createDataFrame([(i, None if t is None else json.dumps(t)) for i, t in enumerate(trees)], "i long, t string")
    got = {r["item"]: {**{f: r[f"has_{f}"] for f in C.FAMILIES}, "WILD": r["wild"], "STRUCT": r["struct"]} for r in C.evidence(df, "i", "t").collect()}
    for i, t in enumerate(trees):
        out = Counter()
        evidence_by_force(t, out)
        want = {f: out[f] for f in [*C.FAMILIES, "WILD", "STRUCT"]}
        assert got.get(i, dict.fromkeys(want, 0)) == want, json.dumps(t)


def test_gap_fragments(spark):
    from tessera.operators import variant

    rows = [
        (1, "Red Elf, Old", json.dumps([{"type": "Unimplemented", "description": "Red Elf, Old and Red Elf draw 12  cards."}, {"type": "Unrecognized"}])),
        (2, None, json.dumps({"mode": {"Unknown": {"a": 1}}, "x": {"type": "GenericEffect", "static_abilities": []}})),
        (3, "", json.dumps({"modal": True, "mode_abilities": [1], "effect": {"type": "GenericEffect"}})),
        (4, "n", None),
    ]
    got = {tuple(r) for r in variant.gap_fragments(spark.createDataFrame(rows, "i long, n string, t string"), "i", "n", "t").collect()}
    assert got == {(1, "Unimplemented", "Unimplemented:None", "~ and ~ draw N cards"), (1, "unmodelled", "Unrecognized condition", ""), (2, "unmodelled", "Unknown trigger mode", '{"a": N}'), (2, "GenericEffect", "GenericEffect[?]", "GenericEffect[?]")}
