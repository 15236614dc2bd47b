"""Suggested groups against a dense definition; calibration; signatures on deep and broken trees."""

import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import signature, suggest


def by_force(members, queries, k, kept):
    """members: (gid, owner, line, weight, terms); queries: (q, owner, excluded, terms)."""
    docs = [m[4] for m in members] + [q[3] for q in queries]
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items() if n >= 2}

    def vector(d):
        v = {t: (1 + math.log(c)) * idf[t] for t, c in Counter(d).items() if t in idf}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    groups = sorted({m[0] for m in members})
    size = {g: max(1, len({m[1] for m in members if m[0] == g and m[1] is not None})) for g in groups}
    lines = [vector(m[4]) for m in members]
    out = {}
    for q, owner, excluded, terms in queries:
        own = vector(terms)
        sim = [-1 if owner is not None and m[1] == owner else round(sum(x * v.get(t, 0) for t, x in own.items()) * m[3], 9) for m, v in zip(members, lines)]
        best = {g: max(s for s, m in zip(sim, members) if m[0] == g) for g in groups}
        mass = dict.fromkeys(groups, 0.0)
        for s, _, g in sorted((-s, m[2], m[0]) for s, m in zip(sim, members) if s > 0)[:k]:
            mass[g] += s * s
        z = lambda d: {g: (d[g] - np.mean(list(d.values()))) / (np.std(list(d.values())) + 1e-9) for g in groups}
        a, b = z(best), z({g: mass[g] / size[g] ** 0.25 for g in groups})
        ranked = sorted((-round(a[g] + b[g], 6), g, a[g] + b[g]) for g in groups if g not in excluded)[:kept]
        out[q] = [(g, s) for _, g, s in ranked]
    return out


@pytest.mark.parametrize("block,chunk", [(10_000, 10_000), (12, 7)])
def test_suggestions_equal_force(spark, block, chunk):
    rng = random.Random(block)
    words = [f"w{i}" for i in range(40)]
    line = lambda: [rng.choice(words[: rng.choice([6, 40])]) for _ in range(rng.randrange(0, 7))]
    groups = ["huge"] * 40 + [f"g{i}" for i in range(15)] * 3 + ["alone"]
    members = [(g, rng.choice([None, *range(20)]), i, rng.choice([1.0, 0.6]), line()) for i, g in enumerate(groups)]
    members[-1] = ("alone", 3, members[-1][2], 1.0, ["w1", "w2"])
    queries = [(i, rng.choice([None, *range(20), 3]), rng.sample([f"g{j}" for j in range(15)] + ["huge"], rng.randrange(3)), line()) for i in range(25)]
    queries.append((99, 3, [], ["w1", "w2"]))
    m = spark.createDataFrame(members, "gid string, owner long, line long, weight double, terms array<string>").repartition(3)
    q = spark.createDataFrame(queries, "q long, owner long, excluded array<string>, terms array<string>")
    got = defaultdict(list)
    for r in suggest.suggestions(m, q, k=6, kept=4, block=block, chunk=chunk).orderBy("q", "place").collect():
        got[r["q"]].append((r["gid"], r["score"]))
    want = by_force(members, queries, 6, 4)
    assert set(got) == set(want)
    for k in want:
        assert [g for g, _ in got[k]] == [g for g, _ in want[k]]
        assert np.allclose([s for _, s in got[k]], [s for _, s in want[k]], atol=1e-6)


def test_suggestions_of_nothing(spark):
    m = spark.createDataFrame([], "gid string, owner long, line long, weight double, terms array<string>")
    q = spark.createDataFrame([(1, 1, [], ["a"])], "q long, owner long, excluded array<string>, terms array<string>")
    assert suggest.suggestions(m, q).count() == 0
    assert suggest.suggestions(m, q.where("false")).count() == 0


def test_isotonic_curve_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 30):
        x, y = np.sort(rng.choice(50, n)).astype(float), rng.integers(0, 2, n).astype(float)
        px, py = suggest.isotonic_curve(x, y)
        assert py == sorted(py) and px == sorted(px)
        fit = [max(min(np.mean(y[j : k + 1]) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
        runs = {(px[i], px[i + 1]): py[i] for i in range(0, len(px), 2)}
        assert all(any(a <= x[i] <= b and abs(v - fit[i]) < 1e-12 for (a, b), v in runs.items()) for i in range(n))


def test_confidence_bounds_and_buckets(spark):
    found = spark.createDataFrame([(1, "a", 5.0, 2, "text"), (2, "a", 5.0, 9, "text"), (3, "a", -9.0, 2, "text"), (4, "a", 5.0, 2, "reminder")], "owner long, gid string, score double, n_tokens int, kind string")
    curves = {"all": ([0.0, 10.0], [0.0, 1.0]), 2: ([0.0, 1.0], [1.0, 1.0])}
    got = {r["owner"]: r["confidence"] for r in suggest.confident(found, curves).collect()}
    assert got == {1: 0.5, 2: 0.99, 3: 0.02, 4: 0.25}
    hits = suggest.calibration(found, spark.createDataFrame([(1, "a")], "owner long, gid string"), own_curve=1)
    assert set(hits) == {"all", 0, 2} and hits["all"][1][-1] == pytest.approx(1 / 3)


def test_signature_of_deep_and_broken_trees(spark):
    typed = lambda t: {"type": "Typed", "type_filters": [t], "controller": "You"}
    deep = typed("Creature")
    for k in range(6):
        deep = {"type": "Or" if k % 2 else "And", "filters": [deep, typed("Land" if k % 2 else "Artifact")]}
    chain = {"effect": {"type": "Draw"}}
    for _ in range(9):
        chain = {"effect": {"type": "Draw"}, "sub_ability": chain}
    rows = [(1, "abilities", json.dumps({"effect": {"type": "Tap", "target": deep}})), (2, "abilities", json.dumps(chain)), (3, "abilities", None), (4, "abilities", "[1]"), (5, None, "{}"), (6, "triggers", '{"execute":null}'), (7, "abilities", '{"effect":{"type":7}}')]
    out = {r["item"]: r for r in signature.signatures(spark.createDataFrame(rows, "item long, bucket string, tree string"), "item", "bucket", "tree").collect()}
    assert out[1]["obj"].count("|") == 3 and "Creature" in out[1]["obj"] and out[1]["ctrl"] == "You"
    assert out[2]["chain"] == "Draw>Draw>Draw+"
    for i in (3, 4, 5, 6, 7):
        assert not out[i]["usable"] and [out[i][f] for f in ("fam", "ftype", "obj", "quant", "who", "chain")] == ["none", "none", "-", "-", "", ""]


def test_implied_cores(spark):
    pairs = spark.createDataFrame([("Elf", "Creature")] * 9 + [("Elf", "Land")] + [("Saga", "Creature"), ("Saga", "Enchantment")], "s string, c string")
    assert [tuple(r) for r in signature.implied_cores(pairs, "s", "c").collect()] == [("Elf", "Creature")]


def test_shape_tags(spark):
    cases = {'"Creature"': "Creature", '{"Non":"Artifact"}': "Non:Artifact", '{"type":"NotColor","color":"Black","n":2}': "NotColor:Black,2", '{"Any":{"x":1}}': "Any", "null": None, "7": None, '{"type":"X"}': "X"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", signature.shape_tag(F.parse_json("t")).alias("s"))
    assert {r["t"]: r["s"] for r in df.collect()} == cases
