"""Gates of promotion one by one; roots of tags with rings and unknown parents."""

import random

from pyspark.sql import functions as F

from tessera.operators import hierarchy, promotion

KIND = "leaf string, item long, tokens array<string>, signature string, text string"


def test_each_gate_refuses(spark):
    toks, text = ["a", "b", "c"], "Put it into the graveyard with a charge counter and a +1/+1 counter"
    members = [("L", i, toks, "s" if i < 9 else "rare", text) for i in range(10)] + [("Big", 100 + i, toks, "s", text) for i in range(301)] + [("Huge", 1000 + i, toks, "s", text) for i in range(500)] + [("One", 5000, toks, "s", text)]
    row = lambda i, leaf="L", score=0.95, tokens=toks, signature="s", text=text, type="Draw", scoped=False, modal=False, flagged=False: (i, leaf, score, tokens, signature, text, type, scoped, modal, flagged)
    cases = {
        1: (row(1), None), 2: (row(2, tokens=[]), "no_tokens"), 3: (row(3, score=0.89), "below"), 4: (row(4, tokens=["a"]), "generic_leaf"), 5: (row(5, leaf="Huge"), "generic_leaf"), 6: (row(6, tokens=["a", "b"]), "in_between"),
        7: (row(7, leaf="Big"), "in_between"), 8: (row(8, text=" "), "no_text"), 9: (row(9, flagged=True), "flagged"), 10: (row(10, modal=True), "modal"), 11: (row(11, type="Bounce"), "type"), 12: (row(12, scoped=True), "type"),
        13: (row(13, text="each player"), "wording"), 14: (row(14, text="a lore counter"), "wording"), 15: (row(15, leaf="One"), "structure_unknown"), 16: (row(16, tokens=["x", "y", "z"]), "structure_unknown"),
        17: (row(17, signature="other"), "structure"), 18: (row(18, signature="rare"), "structure"), 19: (row(19, text=None), "no_text"), 20: (row(20, score=None), "below"), 21: (row(21, text="a +1/+1 counter and the counter"), None),
    }
    c = spark.createDataFrame([v[0] for v in cases.values()], "item long, leaf string, score double, tokens array<string>, signature string, text string, type string, scoped boolean, modal boolean, flagged boolean")
    got = {r["item"]: r["gate"] for r in promotion.gates(c, spark.createDataFrame(members, KIND)).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_nearest_leaf_breaks_ties_by_name(spark):
    v = spark.createDataFrame([(1, "t", 1.0), (2, "u", 1.0), (3, "z", 1.0)], "item long, token string, w double")
    c = spark.createDataFrame([("B", "t", 0.5), ("A", "t", 0.5), ("B", "u", 0.9), ("A", "u", 0.1)], "leaf string, token string, w double")
    assert {tuple(r) for r in promotion.nearest_leaf(v, c).collect()} == {(1, "A", 0.5), (2, "B", 0.9)}


def test_roots_equal_force(spark):
    rng = random.Random(6)
    parents = {t: [rng.randrange(60) for _ in range(rng.choice([0, 1, 1, 2, 3]))] for t in range(50)}  # 50 to 59 are no tags; rings arise
    parents |= {100: [101], 101: [100], 102: [101], 103: [103], 104: []}
    for k in range(105, 130):
        parents[k] = [k - 1]

    def reach(t):
        seen, todo = {t: 0}, [t]
        while todo:
            now = todo.pop(0)
            for p in parents[now]:
                if p in parents and p not in seen:
                    seen[p] = seen[now] + 1
                    todo.append(p)
        return seen

    want = set()
    for t in parents:
        ends = {(t, a, d) for a, d in reach(t).items() if not any(p in parents for p in parents[a])}
        want |= ends or {(t, t, 0)}
    rooted = hierarchy.roots(spark.createDataFrame([(t, p) for t, p in parents.items()], "tag long, parents array<long>"))
    assert {tuple(r) for r in rooted.select("tag", "root", "depth").collect()} == want
    items = spark.createDataFrame([(i, t) for i in range(40) for t in (i % 7, 129, 100)] + [(1, 999)], "item long, tag long")
    got = {r["root"]: r["items"] for r in hierarchy.rollup(items, rooted).collect()}
    assert got[104] == 40 and got[100] == 40 and got == {r: len({i for i in range(40) for t in (i % 7, 129, 100) if any(w[0] == t and w[1] == r for w in want)}) for r in {w[1] for w in want}}
    assert hierarchy.roots(spark.createDataFrame([], "tag long, parents array<long>")).count() == 0
    assert rooted.agg(F.max("depth")).first()[0] == 25
