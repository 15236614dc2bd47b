"""License scans, embedding whitening and the filter audit."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, same
from pyspark.sql import functions as F

from tessera.llm import op11_licenses as licenses
from tessera.llm import op12_whitening as whitening
from tessera.llm import op13_filters as filters
from tessera.llm import registry

FOLDER = "/root/testdata/sf0.001"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"


@pytest.mark.parametrize("name", ["op11_license_scan", "op13_filter_audit"])
def test_equals_sql(spark, name):
    same(registry.queries()[name](spark, FOLDER), connect(FOLDER), registry.oracle_sql()[name])


# ---- op11

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(licenses.WORD, (text or "").translate(LOW))


def places_by_force(text, phrases):
    w = split(text)
    return sorted((label, s) for label, p in phrases for s in range(len(w)) if w[s : s + len(p.split())] == p.split())


def found_by_force(texts, templates, least):
    """(label, start, score) of the templates by text: every lane of every template, its rare words looked for one by one."""
    ws = [split(t) for t in texts]
    df = {w: sum(w in own for own in map(set, ws)) for _, t, _ in templates for w in split(t)}
    idf = {w: math.log((1 + len(ws)) / (1 + n)) + 1 for w, n in df.items()}
    out = []
    for own in ws:
        hits = set()
        for label, text, keys in templates:
            t = split(text)
            rare = sorted(set(t), key=lambda w: (-round(idf[w], 9), w))[: licenses.RARE]
            total = sum(idf[w] for w in rare)
            for lane in range(-len(t) // 8 - 3, len(own) // 8 + 2):
                offsets = range(lane * 8, lane * 8 + 16)
                there = [w for w in rare if any(0 <= q + o < len(own) and own[q + o] == w for q in range(len(t)) if t[q] == w for o in offsets)]
                score = sum(idf[w] for w in there) / total
                if score < least:
                    continue
                ok = True
                for key in keys:
                    k = split(key)
                    at = next(q for q in range(len(t)) if t[q : q + len(k)] == k)
                    ok &= any(own[s : s + len(k)] == k for s in range(max(0, lane * 8 + at - 8), lane * 8 + at + 25))
                if ok:
                    hits.add((label, max(0, lane * 8), round(score, 9)))
        out.append(sorted(hits))
    return out


def license_texts():
    rng = random.Random(5)
    common = "the of license under software copy this free is by nc cc version 2 mit apache public to any".split()
    noise = lambda n: " ".join(rng.choice(common) for _ in range(n))
    edited = MIT.replace("hereby granted, ", "hereby granted, ").replace("associated ", "all associated ")
    missing = MIT.replace("free of charge", "for a fee")  # most rare words, but not the mandatory phrase
    texts = [None, "", "   ", "UNDER the\nMIT license; under the mit license", "cc-by-nc cc by nc 4.0 CC BY", "apache license, version 2.0", "under the mit licensed", MIT, edited, missing]
    texts += [noise(30) + " " + MIT + " " + noise(9), "word " * 40000 + MIT, noise(3000), "nc " * 500 + "cc by nc", MIT + " " + MIT, "\U0001f600 cc\U0001f600by nc cc by nc"]
    texts += [" ".join(rng.choice(split(t) + common) for _ in range(rng.randrange(1, 60))) for _, t, _ in licenses.TEMPLATES for _ in range(3)]
    return texts + [t for _, t, _ in licenses.TEMPLATES]


def test_op11_equals_force(spark):
    texts = license_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    want = found_by_force(texts, licenses.TEMPLATES, licenses.LEAST)
    assert sum(map(bool, want)) > 12
    for i, t in enumerate(texts):
        r = rows[i]
        assert r["n_words"] == len(split(t))
        assert sorted((x["label"], x["start"]) for x in r["places"]) == places_by_force(t, licenses.PHRASES)
        assert sorted({(x["label"], x["start"], round(x["score"], 9)) for x in r["found"]}) == want[i], t
        base = sorted({x["label"] for x in r["places"]})
        assert r["base_labels"] == base and r["labels"] == sorted(set(base) | {x[0] for x in want[i]})
        assert 0 <= r["score"] <= 1 and (r["score"] == 0) == (not r["labels"])
    assert "mit" in rows[8]["labels"] and "mit" not in rows[9]["labels"]


def test_op11_finds_each_template(spark):
    texts = [t for _, t, _ in licenses.TEMPLATES]
    docs = spark.createDataFrame(enumerate("some words first " + t + " and more after" for t in texts), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in rows[i]["labels"], label


def test_op11_names_and_empty(spark):
    docs = spark.createDataFrame([(1, "cc by nc", "x", "y", 3), (1, "cc by nc", "x", "y", 4), (None, None, "x", "y", 5)], "doc_id long, text string, `a.b` string, __words string, SCORE long")
    out = licenses.scan(docs)
    assert out.columns == ["doc_id", "text", "a.b", "__words", "n_words", "places", "found", "base_labels", "labels", "score"]
    assert sorted(r["n_words"] for r in out.collect()) == [0, 3, 3]
    assert licenses.scan(docs.where("false")).count() == 0
    alone = licenses.scan(docs, phrases=[], templates=[]).collect()
    assert all(r["labels"] == [] and r["score"] == 0 for r in alone)


def test_op11_plan_has_no_python(spark):
    plan = licenses.query(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---- op12


def whitened_by_force(vectors):
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    deviation = [sum((n * r[i] - sums[i]) ** 2 for i in range(d)) for r in x]
    centred = np.array([[(n * r[i] - sums[i]) / n for i in range(d)] for r in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return n, deviation, centred, e, u


def vectors(n=157, d=12, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(3, 0.5, d) + rng.normal(size=d) * 5).astype(np.float32)


def test_op12_equals_force(spark):
    v = vectors()
    bad = [None, [], [None] * 12, [1.0] * 11 + [float("nan")], [float("inf")] + [0.0] * 11, [1.0] * 11]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist()), (3, v[3].tolist())] + [(1000 + k, x) for k, x in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    out = whitening.whiten(df).toPandas()
    good = np.vstack([v, v[:1], v[3:4]])
    n, deviation, centred, e, u = whitened_by_force(good)
    assert len(out) == n * 8 and set(out["n"]) == {n} and not (set(out["vec_id"].dropna()) & set(range(1000, 1006)))
    for i in range(len(v)):
        own = out[out["vec_id"] == i]
        assert len(own) == (16 if i == 3 else 8)
        assert {int(x) for x in own["deviation"]} == {deviation[i]}
    mine = out[out["vec_id"].isin(range(len(v)))].drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (centred @ u[:, :8] / np.sqrt(e[:8]))[: len(v)]
    for k in range(8):
        sign = np.sign(mine[:, k] @ want[:, k])
        assert np.abs(mine[:, k] * sign - want[:, k]).max() < 1e-9
    share = out.drop_duplicates("component").sort_values("component")["explained"].to_numpy()
    assert np.abs(share / (e[:8] / e.sum()) - 1).max() < 1e-9 and out["identity_error"].max() < 1e-9


def test_op12_digits_survive_a_far_mean(spark):
    """Entries far from 0: centring in doubles after a product would lose the spread."""
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, size=(300, 5)) / 1024 + 1e9
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    out = whitening.whiten(df).toPandas()
    n, deviation, centred, e, u = whitened_by_force(v)
    assert out["identity_error"].max() < 1e-9 and out["component"].max() == 5
    assert [int(x) for x in out.drop_duplicates("vec_id").sort_values("vec_id")["deviation"]] == deviation


def test_op12_wide_numbers_are_exact():
    rng = np.random.default_rng(2)
    for scale in (1 << 10, 1 << 25, 1 << 40, 1 << 53):
        x = rng.integers(-scale, scale, size=(40, 6))
        sums = whitening.exact_sums(x)
        assert sums == [sum(int(v) for v in c) for c in x.T]
        for n in (40, 10**6, 10**12):
            d, squares = whitening.centred(x, n, sums)
            exact = [[n * int(v) - s for v, s in zip(r, sums)] for r in x]
            assert squares == [sum(v * v for v in r) for r in exact]
            assert np.allclose(d, [[v / n for v in r] for r in exact], rtol=1e-15)


def test_op12_tree_equals_one_factorisation(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    v = vectors(200, 6)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<float>").repartition(9)
    n, _, centred, e, _ = whitened_by_force(v)
    x = (np.floor(v.astype(float) * 1024) + 100000).astype(np.int64)
    r = whitening._factor(df.select("v"), 6, n, whitening.exact_sums(x))
    assert np.abs(np.linalg.svd(r)[1] ** 2 / n / e - 1).max() < 1e-12


def test_op12_slices_and_lengths(monkeypatch):
    monkeypatch.setattr(whitening, "SLICE", 6)
    column = pa.array([[1.0, 2.0], None, [3.0], [4.0, 5.0], [6.0, None], [7.0, 8.0], [9.0, 9.0]], pa.list_(pa.float32()))
    found = [(at.tolist(), x.tolist()) for at, x in whitening.integers(column, 2)]
    assert [a for at, _ in found for a in at] == [0, 3, 5, 6] and len(found) > 1
    assert {x.shape[1] for _, x in whitening.integers(column)} == {1, 2}


def test_op12_degenerate(spark):
    kind = "vec_id long, embedding array<float>"
    alone = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], kind)).collect()
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(20)], kind)).collect()
    assert {r["component"] for r in flat if r["whitened"] is not None} == {1} and max(r["identity_error"] for r in flat) < 1e-9
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    none = whitening.whiten(spark.createDataFrame([], kind))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    far = whitening.whiten(spark.createDataFrame([(i, [1e30 * (-1) ** i, 1.0]) for i in range(4)], kind)).collect()
    assert len(far) == 8 and all(int(r["deviation"]) == (4 * 2**53) ** 2 for r in far)
    text_ids = whitening.whiten(spark.createDataFrame([("a", [1.0], 1), ("b", [3.0], 2)], "vec_id string, embedding array<float>, n long"))
    assert dict(text_ids.dtypes)["vec_id"] == "string" and text_ids.count() == 2


# ---- op13


def audit_by_force(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = any(i is not None and j is not None and j < i and (x or "") == t for j, x, _ in docs)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
        rows.append((source or "", {f for f, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, shapley, table = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                redundant = sum(f in r[1] and bool(r[1] & set(order[:k])) for r in own)
                table.append((part, "".join(order), k + 1, len(left), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [t[:-1] + (shapley[t[-1]],) for t in table]
    return sorted(out)


NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(spark, docs, labels, more=""):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    known = spark.createDataFrame(labels, "id long, quality int, toxic int").select("id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return d, known


def test_op13_equals_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(90)]
    texts = [None, "", "a" * 50, "#", " \t\n", "ÀÉ   x", "x " * 5000] + [" ".join(rng.choice(vocabulary[: rng.choice([20, 90])]) + rng.choice(["", "", "A", "|"]) for _ in range(rng.randrange(60, 90))) for _ in range(10)]
    texts += [" ".join(vocabulary[:60]), " ".join(vocabulary[:60]).upper()]
    docs = [(rng.choice([None, *range(150)]), rng.choice(texts), rng.choice([None, "", "a", "b"])) for _ in range(300)]
    labels = [(rng.choice([None, *range(170)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(200)]
    d, known = audit(spark, docs, labels)
    got = sorted(tuple(r[c] for c in NAMES) for r in filters.audit(d.repartition(5), known).collect())
    assert got == audit_by_force(docs, labels)


def test_op13_heavy_groups_take_the_other_way(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 == 0 else f"k{i % 40}") for i in range(600)] + [(None, "a"), (5, "k5")], "id long, hash string")
    want = sorted((r["id"] is None, r["id"] or 0, r["hash"]) for r in rows.collect())
    for heavy in (1, 3, 1000):
        out = filters.repeated(rows, "hash", "id", heavy).collect()
        assert sorted((r["id"] is None, r["id"] or 0, r["hash"]) for r in out) == want
        first = {}
        for r in out:
            if r["id"] is not None:
                first[r["hash"]] = min(r["id"], first.get(r["hash"], r["id"]))
        assert all(r["E"] == (r["id"] is not None and r["id"] > first[r["hash"]]) for r in out)


def test_op13_bitmaps_equal_counting():
    rng = np.random.default_rng(4)
    for rows in (1, 7, 8, 9, 1000):
        parts = rng.integers(0, 5, rows)
        parts = np.unique(parts, return_inverse=True)[1]
        fails, labels = rng.random((5, rows)) < 0.3, rng.random((2, rows)) < 0.5
        table = filters.bitmap_counts(parts, fails, labels)
        for p in range(parts.max() + 1):
            for chosen in range(32):
                alive = (parts == p) & ~np.any([fails[f] for f in range(5) if chosen >> f & 1] or [np.zeros(rows, bool)], axis=0)
                assert table[p, chosen].tolist() == [alive.sum(), (alive & labels[0]).sum(), (alive & labels[1]).sum()]


def test_op13_empty_and_many_parts(spark, monkeypatch):
    d, known = audit(spark, [], [])
    out = filters.audit(d, known)
    assert out.count() == 0 and out.columns == NAMES
    monkeypatch.setattr(filters, "HELD_PARTS", 3)
    docs = [(i, "#", f"s{i % 17}") for i in range(100)]
    d, known = audit(spark, docs, [])
    assert sorted(tuple(r[c] for c in NAMES) for r in filters.audit(d, known).collect()) == audit_by_force(docs, [])


# ---- names of columns in the stages


@pytest.mark.parametrize("stage", ["op1", "op4", "op6", "op8"])
def test_stages_keep_columns_of_any_name(spark, stage):
    from tessera.llm import op1_ngram_join, op4_secrets, op6_decontaminate, op8_language

    text = "the quick brown fox jumps over the lazy dog while seven cats watch from a wall nearby today "
    rows = [(i, text * 2 + f"number {i * 7} password = abcdefgh{i}", "en", "s", 9, "x", "y") for i in range(6)]
    dotted = "a.b" if stage in ("op1", "op6") else "a_b"  # Spark's own map functions refuse a dot
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, `{dotted}` string, __secrets string")
    run = {"op1": op1_ngram_join.stage, "op4": op4_secrets.stage, "op6": lambda d: op6_decontaminate.stage(d, spark.createDataFrame([(1, "no such words here")], "item_id long, text string")), "op8": op8_language.stage}[stage]
    out = run(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[dotted] == "x" and r["__secrets"] == "y" for r in got)
    if stage == "op4":
        assert all("[secret]" in r["text"] and "abcdefgh" not in r["text"] for r in got)
