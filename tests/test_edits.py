"""Versioned tables, batches and their undoing, spans, names in texts, loose groups."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import batches, containment, loose, relational, spans
from tessera.sources.versions import Conflict, Versions


def test_versions_survive_a_failed_write(spark, tmp_path):
    at = Versions(spark, f"file://{tmp_path}/t", keep=2)
    assert at.current() is None and at.read() is None and at.names() == []
    first = at.write(spark.range(3))
    with pytest.raises(PySparkException):
        at.write(spark.range(9).withColumn("x", F.when(F.col("id") == 5, F.raise_error(F.lit("no"))).otherwise(F.lit(1))))
    assert at.current() == first and at.read().count() == 3 and at.names() == [first]
    assert not [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith(("_aside", "_next"))]
    with pytest.raises(Conflict):
        at.write(spark.range(1), expected="v-0")
    assert at.read().count() == 3
    second = at.write({"table": spark.range(5), "other": spark.range(1)}, expected=first)
    assert at.read().count() == 5 and at.read("other").count() == 1 and at.read(version=first).count() == 3
    at.restore(first)
    assert at.read().count() == 3
    with pytest.raises(ValueError):
        at.restore("v-9")
    at.restore(second)
    for n in range(4):
        at.write(spark.range(n + 10))
    assert len(at.names()) == 3 and at.read().count() == 13


def test_batches_idempotence_conflicts_and_undo(spark, tmp_path):
    cards, groups = spark.range(10).select(F.col("id").alias("oid")), spark.createDataFrame([("a", True), ("b", True), ("old", False)], "gid string, offered boolean")
    members = spark.createDataFrame([(0, "a", True), (1, "a", False)], "oid long, gid string, precise boolean")
    log = batches.EditLog(spark, f"file://{tmp_path}/log")
    rows = lambda *x: spark.createDataFrame(list(x), "oid long, gid string, action string, score double")
    state = lambda: sorted(tuple(r) for r in log.table("edits").collect())
    apply = lambda name, items, **more: {k: v for k, v in log.apply(name, items, cards, groups, members, **more).items() if k in ("code", "changed", "revision")}
    one = rows((1, "b", "add", 0.5), (2, batches.NOFIT, "nofit", None))
    assert apply("x", one) == {"code": 200, "changed": True, "revision": 1}
    assert apply("x", one.orderBy(F.desc("oid"))) == {"code": 200, "changed": False, "revision": 1}
    assert apply("x", rows((1, "b", "add", 0.5))) == {"code": 409, "changed": False, "revision": 1}
    before = state()
    two = rows((1, "b", "remove", None), (2, "a", "add", 1.0), (3, "a", "add", 1.0))
    assert apply("y", two)["code"] == 409 and state() == before
    assert apply("y", two, override=True, revision=0)["code"] == 409 and state() == before
    assert apply("y", two, override=True, revision=1)["changed"]
    assert state() == [(1, "b", "remove", "y"), (2, "a", "add", "y"), (3, "a", "add", "y")]
    assert log.undo("y")["changed"] and state() == before
    assert not log.undo("y")["changed"] and log.undo("z")["code"] == 404
    assert apply("y", two, override=True)["code"] == 409
    apply("w", rows((1, "b", "remove", None)), override=True)
    apply("v", rows((1, "b", "add", None)), override=True)
    log.undo("w")
    assert [s for s in state() if s[0] == 1] == [(1, "b", "add", "v")]
    bad = {
        (99, "a", "add", 0.1): 404, (1, "zz", "add", 0.1): 422, (1, "old", "add", 0.1): 422, (0, "a", "add", 0.1): 409, (5, "a", "add", 2.0): 422, (5, "a", "move", 0.1): 400,
        (5, batches.NOFIT, "add", 0.1): 400, (None, "a", "add", 0.1): 400, (5, "a", None, 0.1): 400,
    }
    got = batches.refusals(rows(*bad), cards, groups, members, log.table("edits").where("false")).collect()
    assert Counter((r["oid"], r["gid"], r["code"]) for r in got) == Counter((k[0], k[1], v) for k, v in bad.items() if (k[0], k[1]) != (5, "a")) + Counter({(5, "a", 422): 1, (5, "a", 400): 2})


def test_overlay_of_an_unknown_key_is_an_error(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert sorted(map(tuple, relational.overlay_replace(base, spark.createDataFrame([(2, "B")], "k long, v string"), "k").collect())) == [(1, "a"), (2, "B")]
    with pytest.raises(PySparkException):
        relational.overlay_replace(base, spark.createDataFrame([(3, "c")], "k long, v string"), "k").collect()


def test_names_equal_force(spark):
    rng = random.Random(2)
    names = ["Red Elf, the Old", "red", "Elf", "İzmir", "a.b", "the Old", None, " , x"]
    texts = [None, "", "İzmir RED ELF, THE OLD elf red-elf redelf a.b axb"] + [" ".join(rng.choice(["red", "Elf", "the", "Old", "the Old", "elves,", "a.b!"]) for _ in range(30)) for _ in range(20)]
    t = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    n = spark.createDataFrame([(x,) for x in names], "n string")
    want = set()
    for name in names:
        for v in {name.lower(), name.lower().split(",")[0].strip()} if name else ():
            if v.strip():
                for i, x in enumerate(texts):
                    low = (x or "").replace("İ", "\0").lower().replace("\0", "İ")
                    for p in range(len(low)):
                        edge = lambda a, b: a >= 0 and b < len(low) and bool(re.match(r"\w", low[a])) and bool(re.match(r"\w", low[b]))
                        if low.startswith(v, p) and not edge(p - 1, p) and not edge(p + len(v) - 1, p + len(v)):
                            want.add((i, name, v, p + 1))
    for most in (1 << 20, 8):
        got = [tuple(r) for r in containment.contained(t, "i", "t", n, "n", most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert containment.contained(t, "i", "t", n.where("false"), "n").count() == 0


def test_cuts_partition_lines():
    rng = random.Random(4)
    pieces = ["draw a card", "{T}: ", "When it enters, ", ". ", ", then ", " and ", "\"gain: life. now\"", "(a, b) ", "If you do, ", "Activate only once.", "; "]
    for _ in range(300):
        line = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 8)))
        for bucket in ("abilities", "triggers", None):
            c = spans.cut(line, bucket)
            assert 0 <= c["start"] <= c["end"] <= len(line)
            at = c["start"]
            for p in c["parts"]:
                assert at <= p["s"] < p["e"] <= c["end"]
                assert re.fullmatch(r"[\s.,;]*(then|and)?[\s.,;]*((then|and)[\s.,;]*)*", line[at : p["s"]]) is not None
                at = p["e"]
    assert spans.cut(None, None) is None


def narrow_by_force(line, bucket, chain, anchors, threshold):
    """The walk over clauses, one after the other."""
    c = spans.cut(line, bucket)
    top, subs, end, how = chain[0], [e for e in chain[1:] if e != chain[0]], c["end"], list(c["how"])
    text = [line[p["s"] : p["e"]] for p in c["parts"]]
    score = lambda e, t: sum(anchors.get(e, {}).get(w, 0) for w in set(re.findall(spans.WORD, t.lower())))
    other = lambda t: max(score(e, t) for e in subs) > max(threshold, score(top, t))
    if subs and len(text) > 1:
        k = 0
        while k + 1 < len(text) and re.match(spans.LEAD_IN, text[k]):
            k += 1
        kept = c["parts"][k]["e"]
        for j in range(k + 1, len(text)):
            lead = re.match(spans.LEAD_IN, text[j]) and j + 1 < len(text)
            if other(text[j + 1] if lead else text[j]):
                break
            if not lead:
                kept = c["parts"][j]["e"]
        if kept < end:
            end, how = kept, how + ["sub-effect"]
    if subs and "sub-effect" not in how and c["sentences"] > 1 and c["sentences"] == len(chain):
        end, how = c["first_stop"], how + ["sub-effect"]
    end = len(re.sub("[ ,;]+$", "", line[:end]))
    return (c["start"], end, how or ["none"]) if end > c["start"] else (0, len(line), ["none"])


def test_spans_equal_a_walk(spark):
    rng = random.Random(8)
    verbs = {"Draw": "draw two cards", "Gain": "gain some life", "Break": "destroy it quickly", "Odd": "frobnicate"}
    joins = [", then ", " and ", ". ", ". If you do, ", ", ", "; ", ". Until end of turn, "]
    rows = []
    for i in range(200):
        chain = [rng.choice(list(verbs)) for _ in range(rng.randrange(1, 4))]
        line = verbs[chain[0]]
        for e in chain[1:]:
            line += rng.choice(joins) + rng.choice([verbs[e], "it stays", verbs[e] + " and looks"])
        rows.append((i, rng.choice(["abilities", "triggers", "static_abilities"]), rng.choice(["", "{T}: ", "When it comes, ", "If you do, "]) + line + rng.choice(["", ".", ". Activate only once."]), chain))
    anchors = {"Draw": {"draw": 3.0, "two": 1.0}, "Gain": {"gain": 2.0, "life": 1.0}, "Break": {"destroy": 1.0, "quickly": 1.0}}
    a = spark.createDataFrame([(e, w, o) for e, t in anchors.items() for w, o in t.items()], "effect string, word string, odds double")
    x = spark.createDataFrame(rows, "item long, bucket string, line string, chain array<string>")
    got = {r["item"]: (r["start"], r["end"], r["how"]) for r in spans.narrowed(x, a).collect()}
    for i, bucket, line, chain in rows:
        assert got[i] == narrow_by_force(line, bucket, chain, anchors, spans.THRESHOLD), (line, chain)


def test_learnt_anchors_equal_force(spark):
    import math

    rng = random.Random(1)
    words = ["draw", "gain", "burn", "zap", "name", "the"]
    samples = [(rng.choice("AB"), " ".join(rng.choice(words) for _ in range(4)), rng.choice([None, "Name"])) for _ in range(80)]
    per, total, n = defaultdict(Counter), Counter(), Counter()
    for e, line, name in samples:
        own = set(line.split()) - {"the"} - ({"name"} if name else set())
        per[e].update(own)
        total.update(own)
        n[e] += 1
    want = {(e, w, round(math.log(((c + 0.5) / (n[e] + 1)) / ((total[w] - c + 0.5) / (80 - n[e] + 1))), 3)) for e in per for w, c in per[e].items() if c >= max(5, 0.03 * n[e]) and (c + 0.5) / (n[e] + 1) > (total[w] - c + 0.5) / (80 - n[e] + 1)}
    got = {tuple(r) for r in spans.learn_anchors(spark.createDataFrame(samples, "effect string, line string, name string")).collect()}
    assert got == want


def test_no_large_group_that_a_field_could_split(spark):
    rng = random.Random(3)
    rows = [(i, i // 2, rng.choice("FG"), rng.choice("tu"), rng.choice(["x", "y", ""]), rng.choice([None, "p", "q", "r"]), rng.choice("mn")) for i in range(600)]
    x = spark.createDataFrame(rows, "item long, card long, family string, type string, a string, b string, c string")
    out = loose.loose_groups(x, {"F": ["a", "b"]}, {"F": ["c"], "G": ["b"]}, ["a"], least=8, over=20).collect()
    assert len(out) == 600 and {r["kind"] for r in out} >= {"group"}
    cards, values = defaultdict(set), defaultdict(lambda: defaultdict(set))
    for r in out:
        cards[r["key"]].add(r["card"])
        field = {"F": 6, "G": 5}[r["family"]]
        values[r["key"]][rows[r["item"]][field]].add(r["card"])
    for key, own in cards.items():
        assert len(own) >= 8 or key.endswith("/OTHER")
        mark = {"F": "|c=", "G": "|b="}[key[0]]
        if len(own) > 20 and mark not in key:
            assert not any(v and len(c) >= 8 for v, c in values[key].items()), key
