"""Removal and grouping operators against their definitions."""

import collections
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import connect, same
from pyspark.sql import functions as F

from tessera.llm import op1_ngram_join, op2_substrings, op3_bytes, op10_embeddings
from tessera.llm.induced import suffix_order
from tessera.llm.partenum import Threshold, shingle_sets, signatures
from tessera.llm.words import LOWER, SPACED, text_buffer, tokenize

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(120))
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "One"),
    (6, LONG),
    (7, LONG),
    (7, LONG),
    (8, LONG + " tail"),
    (9, "é" * 60 + " " + LONG[:300]),
    (10, "x" * 70000),
    (11, "y" + "x" * 70000),
    (12, "one two three"),
    (None, LONG),
]


def odd(spark):
    rows = [(i, t, "a", 3) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, component_id int")


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def group_by_force(rows, n, num, den):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = words_of((t or "").translate(fold))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    meet = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            meet[g].append(i)
    both = collections.Counter((b, a) for v in meet.values() for x, a in enumerate(v) for b in v[:x])
    for (a, b), k in both.items():
        if den * k >= num * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5)])
def test_op1_equals_all_pairs(spark, n, num, den):
    rows = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    # a chain of near copies in which the ends are too far apart, and a group with a common part
    base = [f"t{i}" for i in range(200)]
    for k in range(12):
        rows.append((1000 + k, " ".join(base[: 2 * k] + [f"z{j}" for j in range(2 * k, 0, -1)] + base[2 * k :])))
        rows.append((2000 + k, " ".join(base[:100] + [f"q{k}_{j}" for j in range(60)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in op1_ngram_join.group(df, shingle=n, num=num, den=den).collect())
    assert got == group_by_force(rows, n, num, den)


@pytest.mark.parametrize("across", [0, 4])
def test_op1_in_chunks(spark, monkeypatch, across):
    monkeypatch.setattr(op1_ngram_join, "CHUNK", 4)
    monkeypatch.setattr(op1_ngram_join, "ACROSS", across)
    base = [f"t{i}" for i in range(150)]
    rows = [(k, " ".join(base[:k] + [f"n{k}"] + base[k + 1 : 140] + [f"m{j}" for j in range(k % 9)])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in op1_ngram_join.group(df, shingle=3, num=9, den=10).collect()) == group_by_force(rows, 3, 9, 10)


def test_op1_rounds_read_only_what_is_open(spark, monkeypatch):
    """A group of near copies with one odd member is done after one round, and only signatures with open pairs are written again."""
    rng, written = np.random.default_rng(5), {}
    base = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    rows = [(i, " ".join(base[:j] + [f"x{i}"] + base[j + 1 :])) for i, j in enumerate(rng.integers(0, 400, 40).tolist())]
    rows.append((100, " ".join(base[:200] + [f"y{x}" for x in range(200)])))
    rows += [(200 + i, " ".join([f"z{i // 2}_{x}" for x in range(60)] + [f"u{i}"])) for i in range(40)]
    write = op1_ngram_join.Scratch.write
    monkeypatch.setattr(op1_ngram_join.Scratch, "write", lambda self, df, name: written.setdefault(name, write(self, df, name)))
    monkeypatch.setattr(op1_ngram_join.Scratch, "drop", lambda self, *names: None)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in op1_ngram_join.group(df, shingle=3, num=9, den=10).collect()) == group_by_force(rows, 3, 9, 10)
    members, roots = written["members"], written["roots0"]
    assert "roots1" not in written
    pairs_only = members.groupBy("sig").count().where("count = 2")
    assert pairs_only.count() > 0 and roots.join(pairs_only, "sig").count() == 0
    assert roots.count() <= members.count() - members.select("sig").distinct().count() - pairs_only.count()
    table = spark.createDataFrame([(1, i, 0) for i in range(300)] + [(1, 300, 300)] + [(2, i, 7) for i in range(50)], "sig long, node long, root long")
    assert op1_ngram_join._open_pairs(table) == 300


def test_op1_later_rounds_only_compare_what_is_outside_a_wide_group(spark, monkeypatch):
    """Small signatures wait for the last round, and in a wide one nobody of its largest component is compared again."""
    rng, sent = np.random.default_rng(8), []
    base = [f"w{x}" for x in range(300)]
    rows = [(i, " ".join(base[:j] + [f"x{i}"] + base[j + 1 :])) for i, j in enumerate(rng.integers(0, 300, 40).tolist())]
    rows += [(50 + i, " ".join(base[:230] + [f"y{i}_{x}" for x in range(70)])) for i in range(3)]
    rows += [(100 + 3 * g + i, " ".join([f"z{g}_{x}" for x in range(120)] + [f"u{g}_{i}_{x}" for x in range(25)])) for g in range(24) for i in range(3)]
    monkeypatch.setattr(op1_ngram_join, "WIDE", 20, raising=False)
    monkeypatch.setattr(op1_ngram_join, "ACROSS", 0)
    one = op1_ngram_join._pass_sketch
    monkeypatch.setattr(op1_ngram_join, "_pass_sketch", lambda pairs, *rest: sent.append(pairs.count()) or one(pairs, *rest))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in op1_ngram_join.group(df, shingle=3, num=4, den=5).collect()) == group_by_force(rows, 3, 4, 5)
    assert sent[0] >= 24 + 40 and len(sent) > 1 and all(1 <= n < 24 for n in sent[1:])


def test_op1_odd_rows(spark):
    got = collections.defaultdict(set)
    for i, n, c in op1_ngram_join.group(odd(spark)).collect():
        got[i].add((n, c))
    assert got[1] == {(0, 1)} and got[2] == {(0, 2)} and got[4] == {(1, 4)} and got[5] == {(1, 4)} and got[7] == {(116, 6)} and got[None] == {(116, 6)}
    kept = sorted((r["doc_id"] or -1) for r in op1_ngram_join.stage(odd(spark)).collect())
    assert kept == [-1, 1, 2, 3, 4, 6, 9, 10, 11, 12]
    empty = odd(spark).limit(0)
    assert op1_ngram_join.group(empty).count() == 0 and op1_ngram_join.stage(empty).columns == empty.columns


def test_partenum_shares_a_signature():
    rng = np.random.default_rng(5)
    at = Threshold(9, 10)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        drop = int(rng.integers(0, max(1, n // 9) + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 64, int(rng.integers(0, n // 9 + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 10 * both >= 9 * (len(a) + len(b) - both):
            sigs, first = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), at)
            assert set(sigs[: first[1]].tolist()) & set(sigs[first[1] :].tolist())


def test_sketches_never_lose_a_link():
    rng = np.random.default_rng(6)
    at = Threshold(9, 10)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[int(rng.integers(0, n // 9 + 1)) :], rng.integers(0, 1 << 64, int(rng.integers(0, n // 9 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 10 * both >= 9 * (len(a) + len(b) - both):
            assert op1_ngram_join.may_link(op1_ngram_join.sketch(a), op1_ngram_join.sketch(b), len(a), len(b), at)


def test_words_match_the_pattern():
    import pyarrow as pa

    texts = ["Ab c\x1fd\x85e f", None, "", "  x\ty\n", "é" * 10 + "\x0b" + "Z", "q" * 5_000_000 + " end"]
    t = tokenize(*text_buffer(pa.array(texts)), SPACED, LOWER)
    for i, x in enumerate(texts):
        own = [bytes(t.buffer[a:b]).decode() for a, b in zip(t.start[t.of(i)], t.end[t.of(i)])]
        assert own == words_of(x)
    same_hash = tokenize(*text_buffer(pa.array(["AB x", "ab x"])), SPACED, LOWER)
    assert same_hash.hash[0] == same_hash.hash[2] and same_hash.hash[1] == same_hash.hash[3] != same_hash.hash[0]
    sets, first, whole = shingle_sets(same_hash, 3)
    assert whole[0] == whole[1] and np.diff(first).tolist() == [1, 1]


def test_op2_equals_sql(spark):
    same(op2_substrings.query(spark, FOLDER), connect(FOLDER), op2_substrings.ORACLE)


def test_op2_odd_rows(spark):
    got = {}
    for r in op2_substrings.remove_repeats(odd(spark)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(s) for s in r["removed_spans"]], len(r["kept_text"].split())))
    assert got[1] == got[2] == got[3] == [(0, [], 0)] and got[6] == [(120, [], 120)]
    assert got[7] == [(120, [(0, 120)], 0)] * 2 and got[8] == [(121, [(0, 120)], 1)] and got[None] == [(120, [(0, 120)], 0)]
    assert op2_substrings.remove_repeats(odd(spark).limit(0)).count() == 0


def remove_words_by_force(rows, window):
    least = {}
    for i, t in rows:
        w = words_of(t)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            least[k] = min(i, least.get(k, i))
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


def test_op2_routes_frequent_anchors_apart(spark, monkeypatch):
    from tessera.llm import anchors

    monkeypatch.setattr(anchors.hot_anchors, "__defaults__", (40_000, 3, 2, 1 << 20))
    rng = np.random.default_rng(1)
    common = [f"c{i}" for i in range(80)]
    rows = [(i, " ".join([f"a{x}" for x in rng.integers(0, 40, 60)] + common + [f"b{x}" for x in rng.integers(0, 40, 30)] + (common[:55] if i % 3 == 0 else []))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = sorted((r["doc_id"], r["kept_text"]) for r in op2_substrings.remove_repeats(df).collect())
    assert got == remove_words_by_force(rows, 50)
    got3 = sorted(tuple(r) for r in digest(op3_bytes.remove_repeats(df)).collect())
    assert got3 == sorted(op3_bytes.brute_force(rows))
    for module in (op2_substrings, op3_bytes):  # frequent windows in two levels, as if there were thousands of slices
        monkeypatch.setattr(module, "FAN", 1e-3)
    assert sorted((r["doc_id"], r["kept_text"]) for r in op2_substrings.remove_repeats(df).collect()) == got
    assert sorted(tuple(r) for r in digest(op3_bytes.remove_repeats(df)).collect()) == got3


def digest(out):
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return out.select("doc_id", "n_bytes", removed, F.size("removed_spans").cast("long"), F.sha2("kept_bytes", 256))


def test_op3_equals_the_definition(spark):
    rows = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    assert sorted(tuple(r) for r in op3_bytes.query(spark, FOLDER).collect()) == sorted(op3_bytes.brute_force(rows))


def test_op3_repetitive_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "".join(rng.choice(list("ab"), int(rng.integers(0, 400))))) for i in range(40)]
    rows += [(100 + i, "ab" * int(rng.integers(0, 200))) for i in range(10)] + [(200, None), (201, "ü" * 100), (202, "ü" * 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in digest(op3_bytes.remove_repeats(df)).collect()) == sorted(op3_bytes.brute_force(rows))
    got = {r["doc_id"]: r["n_bytes"] - len(r["kept_bytes"]) for r in op3_bytes.remove_repeats(odd(spark)).collect()}
    assert got[6] == 0 and got[7] == len(LONG) and got[10] == 0 and got[11] == 70000 and got[None] == len(LONG)
    assert op3_bytes.remove_repeats(odd(spark).limit(0)).count() == 0


def test_op3_sorts_no_copies_of_a_text(spark, monkeypatch):
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    base = [text(500) for _ in range(6)]
    rows = [(100 * i + k, t) for k in range(9) for i, t in enumerate(base)]
    rows += [(2000, base[0][:200] + text(80) + base[1][100:300]), (2001, base[5][:300]), (2002, base[5][:300]), (5, text(49)), (2003, None), (2004, ""), (2005, "")]
    rows += [(2006, text(49))] + [(2007 + k, rows[-4][1]) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sorted_bytes, whole = [], op3_bytes.find_repeats

    def watched(candidates, *rest):
        sorted_bytes.append(candidates.agg(F.sum(F.octet_length("text"))).first()[0])
        return whole(candidates, *rest)

    monkeypatch.setattr(op3_bytes, "find_repeats", watched)
    assert sorted(tuple(r) for r in digest(op3_bytes.remove_repeats(df)).collect()) == sorted(op3_bytes.brute_force(rows))
    assert sorted_bytes[0] <= 6 * 500 + 480 + 300
    null = spark.createDataFrame([(7, base[0]), (7, base[0]), (None, base[0]), (None, base[0]), (None, base[1]), (None, base[1])], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_bytes"] - len(r["kept_bytes"])) for r in op3_bytes.remove_repeats(null).collect()) == [("7", 0)] * 2 + [("None", 0)] * 2 + [("None", 500)] * 2
    monkeypatch.setattr(op3_bytes, "FAN", 1e-3)
    assert sorted(tuple(r) for r in digest(op3_bytes.remove_repeats(df)).collect()) == sorted(op3_bytes.brute_force(rows))


def test_op3_pieces_of_frequent_anchors_hold_several_windows():
    data = np.random.default_rng(6).integers(97, 123, 6000, dtype=np.uint8)
    own = op3_bytes.Slice(pa.array([data.tobytes().decode()]))
    hot = np.unique(own.anchor)
    found = op3_bytes._codes(own.anchor[own.first], 16).tobytes()
    packed, _ = op3_bytes._pieces(own, np.zeros(1, np.int64), np.zeros(1, np.int64), [found], 16, 16, hot, 1)
    _, _, start, count, text = op3_bytes._unpack(list(packed.values()))
    assert count.sum() == 6000 - 49 and len(text) < 12 * 6000
    assert op3_bytes.spread(data, np.arange(5951)).tolist() == own.spread(np.arange(5951)).tolist()


def test_suffixes_in_order_with_and_without_spilling():
    rng = np.random.default_rng(1)
    for trial in range(80):
        t = []
        for _ in range(int(rng.integers(1, 8))):
            t += rng.integers(1, int(rng.integers(2, 5)), int(rng.integers(0, 60))).tolist() + [0]
        t = np.array(t, np.uint8)
        data = t.tobytes()
        order, lcp = (np.concatenate(x).tolist() for x in zip(*suffix_order(t, 50, memory=256 * 40 if trial % 2 else 1 << 20)))
        keys = [data[i : data.index(0, i) + 1][:50] for i in order]
        assert sorted(order) == list(range(len(t))) and keys == sorted(keys)
        for a, b, n in zip(keys, keys[1:], lcp[1:]):
            inside = min(len(a), len(b)) - (min(len(a), len(b)) < 50)
            same = next((i for i in range(inside) if a[i] != b[i]), inside)
            assert n == same if same < inside else n >= inside


def test_a_shard_larger_than_memory_is_sorted_within_it():
    import tracemalloc

    rng = np.random.default_rng(3)
    base, memory = rng.integers(97, 123, 200_000).astype(np.uint8), 1 << 20
    text = np.concatenate([np.append(base[k : k + 400], 0) for k in rng.integers(0, 199_000, 20_000)]).astype(np.uint8)
    tracemalloc.start()
    n, before = 0, None
    for at, lcp in suffix_order(text, 50, memory):
        n += len(at)
        assert len(at) <= 1 << 18
        before = at[-1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert before is not None and n == len(text) and peak < 24 * memory < 4 * len(text)


def test_op3_confirms_bytes_where_hashes_agree(monkeypatch):
    monkeypatch.setattr(op3_bytes, "mix", lambda x: x & np.uint64(1))
    rng = np.random.default_rng(8)
    pieces = ["".join(rng.choice(list("abc"), 60)) for _ in range(6)]
    pieces += pieces[:3]
    data = "".join(pieces).encode()
    ids = np.arange(9, dtype=np.int64)
    piece, place = op3_bytes.sort_shard(ids, np.zeros(9, np.int32), np.full(9, 11, np.int32), np.frombuffer(data, np.uint8))
    assert sorted(zip(piece.tolist(), place.tolist())) == [(p, q) for p in (6, 7, 8) for q in range(11)]
    at = np.arange(9) * 60
    assert op3_bytes._known(np.frombuffer(data, np.uint8), at, np.zeros(9, np.uint64), ids).tolist() == [False] * 6 + [True, False, False]


def test_op10_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + rng.normal(scale=0.03 * (1 + i % 3), size=16)).tolist(), i % 60 % 4) for i in range(900)]
    rows += [(2000 + i, rows[0][1], 0) for i in range(30)] + [(2100, [x * 3 for x in rows[0][1]], 0)]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] + [1.0] * 15, 1), (3003, rows[0][1], None), (3004, [None] + [1.0] * 15, 1), (3005, [], 1), (3006, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in op10_embeddings.near_duplicates(df).collect()}
    x = np.array([r[1] for r in rows if r[0] < 3000])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, label = np.array([r[0] for r in rows if r[0] < 3000]), np.array([r[2] for r in rows if r[0] < 3000])
    link = (x @ x.T >= 0.98 - 1e-12) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    want = link.sum(axis=1)
    found = np.array([got[i]["n_links"] for i in ids])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()
    for i in range(3000, 3007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[2000]["component_id"] == 0 and not got[2000]["kept"]
    assert op10_embeddings.near_duplicates(df.limit(0)).count() == 0


def test_op10_in_chunks_counts_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(op10_embeddings, "CHUNK", 16)
    rng = np.random.default_rng(7)
    v = rng.normal(size=16)
    rows = [(i, (v + rng.normal(scale=0.02, size=16)).tolist(), 1) for i in range(100)]
    got = {r["vec_id"]: r["n_links"] for r in op10_embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.98).sum(axis=1) - 1
    assert [got[i] for i in range(100)] == want.tolist()


def test_op10_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    noisy = rows.unionByName(rows.select((F.col("vec_id") + 10_000).alias("vec_id"), F.transform("embedding", lambda x: (x * 1.0 + 0.01 * F.sin(x * 1000)).cast("float")).alias("embedding"), "label"))
    got = op10_embeddings.near_duplicates(noisy).toPandas().set_index("vec_id")
    pdf = noisy.toPandas().set_index("vec_id")
    x = np.stack(pdf["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.98) & (pdf["label"].to_numpy()[:, None] == pdf["label"].to_numpy()[None])
    want = link.sum() - len(x)
    assert want > 0 and got["n_links"].sum() >= 0.9 * want


def test_op1_tells_regular_sequences_apart(spark):
    """Sums of powers modulo 2**64 agree for two texts that differ by the swap of two words in a Thue-Morse order."""
    order = [bin(i).count("1") % 2 for i in range(4096)]
    texts = [" ".join(f"u{i} {'xy'[o ^ swap]}" for i, o in enumerate(order)) for swap in (0, 1)]
    long = ["".join("xy"[o ^ swap] for o in order) for swap in (0, 1)]
    df = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, long[0] + " a b c"), (4, long[1] + " a b c")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in op1_ngram_join.group(df, shingle=3, num=9, den=10).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_op1_splits_a_node_of_two_sequences(spark, monkeypatch):
    from tessera.llm import partenum

    rows = [(i, " ".join(f"w{i // 2}_{j}" for j in range(30))) for i in range(12)]
    real = partenum.sequences
    monkeypatch.setattr(partenum, "sequences", lambda values, first, seed=0: real(values, first, seed) & np.uint64(1))
    sets, first, node = shingle_sets(tokenize(*text_buffer(__import__("pyarrow").array([t for _, t in rows])), SPACED, LOWER), 5)
    assert len(set(node.tolist())) <= 2
    monkeypatch.undo()
    _, _, node, check = op1_ngram_join._sets(__import__("pyarrow").array([t for _, t in rows]), 5, np.zeros(0, np.uint64))
    split = np.sort(np.unique(node)[:3])
    _, _, apart, again = op1_ngram_join._sets(__import__("pyarrow").array([t for _, t in rows]), 5, split)
    assert (check == again).all() and len(np.unique(apart)) == 6 and ((apart != node) == np.isin(node, split)).all()


def test_partenum_keeps_unlike_sets_apart():
    rng = np.random.default_rng(2)
    for at, most in ((Threshold(4, 5), 6_000), (Threshold(9, 10), 600)):
        sets = [np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64)) for _ in range(3000)]
        sigs, _ = signatures(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))), at)
        counts = np.unique(sigs, return_counts=True)[1]
        assert (counts * (counts - 1) // 2).sum() < most and counts.max() < 30


@pytest.mark.parametrize("num,den", [(4, 5), (9, 10)])
def test_partenum_shares_a_signature_at_every_size(num, den):
    rng = np.random.default_rng(5)
    at = Threshold(num, den)
    for n in [*range(1, 60), 80, 120, 200, 333, 700, 1500]:
        for _ in range(12):
            common = int(rng.integers(max(1, n * num // den), n + 1))
            a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[:common], rng.integers(0, 1 << 64, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if den * both >= num * (len(a) + len(b) - both):
                sigs, first = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), at)
                assert set(sigs[: first[1]].tolist()) & set(sigs[first[1] :].tolist()), (n, len(a), len(b), both)


def test_op1_one_row_of_an_id_stays_in_every_run(spark):
    rows = [(1, f"text number {i} of one id " * 9, i) for i in range(20)]
    got = {r["v"] for parts in (1, 3, 7) for r in op1_ngram_join.stage(spark.createDataFrame(rows, "doc_id long, text string, v int").repartition(parts)).collect()}
    assert len(got) == 1


def test_op10_vectors_without_an_id_and_ids_of_text(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(None, v, 1), (None, v, 1), (1 << 60, v, 1), ((1 << 60) + 1, [1.0, 2.0, 3.001], 1), (None, [9.0, -1.0, 0.0], 2), (5, [9.0, -1.0, 0.0], 3)]
    got = op10_embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got) == sorted([(0, 3, 1 << 60, False)] * 2 + [(1 << 60, 3, 1 << 60, True), ((1 << 60) + 1, 3, 1 << 60, False), (0, 0, 0, True), (5, 0, 5, True)])
    text = [(None if i is None else f"v{i}", x, label) for i, x, label in rows]
    got = {r["vec_id"]: r["component_id"] for r in op10_embeddings.near_duplicates(spark.createDataFrame(text, "vec_id string, embedding array<double>, label int")).where("vec_id is not null").collect()}
    assert got == {f"v{1 << 60}": f"v{1 << 60}", f"v{(1 << 60) + 1}": f"v{1 << 60}", "v5": "v5"}


def test_op10_pivots_grow_with_the_root():
    count = op10_embeddings.pivot_count
    assert count(1000, 64) == 512 and count(10**6, 64) == 2000 and count(4 * 10**6, 64) == 4000 and count(10**9, 64) == 8192 and count(10**9, 4096) == 512


def test_removal_keeps_columns_of_any_name(spark):
    names = ["__id", "__key", "__doc", "__starts", "__found", "__text", "id", "part", "starts"]
    df = spark.createDataFrame([(i, LONG + f" {i}", *[f"mine{i}"] * len(names)) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for out in (op2_substrings.remove_repeats(df), op3_bytes.remove_repeats(df)):
        for r in out.collect():
            assert all(r[n] == f"mine{r['doc_id']}" for n in names)


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(1, 2), (2, 1)], [(i, i + 1) for i in range(150)], [(5, i) for i in range(40)], [(900 - i, 893 - i) for i in range(200)], [(i * 37 % 101, i * i % 103) for i in range(60)]])
def test_components_equal_brute_force(spark, pairs):
    from tessera.llm.components import components
    from tessera.llm.scratch import Scratch

    least = {x: x for p in pairs for x in p}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    rows = components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark)).collect()
    assert sorted((r["a"], r["b"]) for r in rows) == sorted((x, m) for x, m in least.items() if x != m)
