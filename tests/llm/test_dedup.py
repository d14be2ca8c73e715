"""Near duplicates, repeated passages and neighbours against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.llm import near_dedup, nearest_neighbours, substring_dedup

SMALL = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, key string, id string, label string, tid string, spans string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, *["clash"] * 5) for i, t in rows], DDL)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
    return words


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def bag(text):
    words = near_dedup._WORD.findall(text.lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute_classes(rows):
    bags = [bag(t or "") for _, t in rows]
    by_shingle = defaultdict(list)
    for i, b in enumerate(bags):
        for s in b:
            by_shingle[s].append(i)
    pairs = {(x, y) for ids in by_shingle.values() for x in ids for y in ids if x < y}
    links = [(x, y) for x, y in pairs if sum((bags[x] & bags[y]).values()) >= 0.8 * sum((bags[x] | bags[y]).values()) - 1e-9]
    links += [(x, y) for x in range(len(rows)) for y in range(x) if (rows[x][1] or "") == (rows[y][1] or "")]
    of = components(range(len(rows)), links)
    least = defaultdict(list)
    for i, c in of.items():
        least[c].append(rows[i][0])
    return sorted((str(rows[i][0]), str(min((x for x in least[c] if x is not None), default=None)), len(least[c])) for i, c in of.items())


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        shingle = rng.integers(0, 2**63, 50).astype(np.uint64)
        a = rng.integers(0, 9, 50)
        b = np.where(rng.random(50) < 0.5, a, rng.integers(0, 9, 50))
        row, both, weight = np.repeat([0, 1], 50), np.concatenate([shingle, shingle]), np.concatenate([a, b])
        used = weight > 0
        p = near_dedup.bag_min_hash(row[used], both[used], weight[used], 3, m=400)
        errors.append((p[0] == p[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
        assert not p[2].any()
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.04


def test_classes_equal_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([30, 100, 300]))]
        rows += [" ".join(edited(rng, base, rng.choice([0, 0, 1, 2, 4, 9]))) for _ in range(rng.choice([1, 3, 12]))]
    rows += [None, "", "one two", "one two", "One, two!", "...", "z " * 3000, "z " * 2900, "z " * 1000]
    rows = [(i, t) for i, t in enumerate(rows)] + [(3, "repeated id"), (None, "no id"), (0, rows[0])]
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"]) for r in near_dedup.near_duplicate_classes(documents(spark, rows)).collect())
    assert got == brute_classes(rows)


def test_chain_of_texts_is_one_class(spark):
    """Neighbours in a chain are similar, its ends are not."""
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([f"y{i}" for i in range(4 * k)] + words[4 * k :])) for k in range(20)]
    assert {r["class_id"] for r in near_dedup.near_duplicate_classes(documents(spark, rows)).collect()} == {0}


def test_one_of_each_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (4, text + " more"), (4, text + " more"), (9, "alone"), (None, "alone"), (None, None)]
    kept = near_dedup.one_of_each(documents(spark, rows))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("4", text + " more"), ("9", "alone"), ("None", None)], key=lambda r: r[0])
    assert kept.columns == documents(spark, rows).columns
    assert near_dedup.near_duplicate_classes(documents(spark, [])).count() == 0
    assert near_dedup.one_of_each(documents(spark, [])).count() == 0


def test_near_dedup_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"]) for r in near_dedup.op2_near_dedup(spark, SMALL).collect())
    assert got == brute_classes(rows)


def brute_removal(rows, window):
    split = [substring_dedup.words_of(t or "") for _, t in rows]
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    low = {}
    for i, w in zip(ids, split):
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            low[x] = min(low.get(x, i), i)
    out = []
    for (doc_id, _), i, w in zip(rows, ids, split):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if low[tuple(w[k : k + window])] < i:
                gone[k : k + window] = True
        out.append((str(doc_id), len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("few", [2, 400])
def test_removal_equals_brute_force(spark, monkeypatch, few):
    """Few rows a bucket: most minimisers take the way of the hot ones."""
    defaults = substring_dedup.repeated_spans.__defaults__
    monkeypatch.setattr(substring_dedup.repeated_spans, "__defaults__", (*defaults[:-1], few))
    rng = random.Random(11)
    passages = [" ".join(f"p{rng.randint(0, 500)}" for _ in range(n)) for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(60):
        parts = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(0, 60))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(passages))
        rows.append((i, rng.choice([" ", "\n", "\t \r"]).join(parts)))
    rows += [(60, None), (61, ""), (62, "as " * 400), (63, "as " * 300), (63, passages[4]), (63, passages[4]), (None, passages[4] + " end"), (70, "é\xa0x " * 60), (71, "é\xa0x " * 55)]
    got = substring_dedup.remove_repeats(documents(spark, rows))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_words"]) for r in got.collect()) == brute_removal(rows, 50)


def test_repeated_rows_take_linear_time(spark):
    """5,000 rows alike in id and text, and as many with a null id: one set of spans each."""
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(1, passage)] + [(2, passage + " end")] * 5000 + [(None, passage)] * 5000
    df = documents(spark, rows).withColumn("id", F.coalesce("doc_id", F.lit(2**63 - 1))).withColumn("key", F.xxhash64("text"))
    got = {r["id"]: r["spans"] for r in substring_dedup.repeated_spans(df.select("id", "key", "text")).collect()}
    assert set(got) == {2, 2**63 - 1} and all(len(s) <= 120 for s in got.values())
    kept = substring_dedup.remove_repeats(documents(spark, rows)).groupBy("doc_id", "n_removed", "kept_words").count().collect()
    assert sorted((str(r["doc_id"]), r["n_removed"], r["count"]) for r in kept) == [("1", 0, 1), ("2", 120, 5000), ("None", 120, 5000)]


def test_kept_text_keeps_its_form(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage), (2, f"One\nline.\n{passage}\nLast  line."), (3, "as it\n is ")]
    got = {r["doc_id"]: r["kept_text"] for r in substring_dedup.remove_repeats(documents(spark, rows)).collect()}
    assert got == {1: passage, 2: "One\nline.\nLast  line.", 3: "as it\n is "}
    assert substring_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_removal_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in brute_removal(rows, 50)]
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.op9_substring_dedup(spark, SMALL).collect()) == want


def brute_neighbours(vectors, asked, top=10):
    out = {}
    for q in asked:
        d = [(float(np.sqrt(((np.array(v) - np.array(vectors[q])) ** 2).sum())), i) for i, v in vectors.items() if i != q]
        out[q] = sorted(d)[:top]
    return out


def test_neighbours_recall(spark):
    d = "/root/testdata/sf0.01"
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    rows = nearest_neighbours.op3_nearest_neighbours(spark, d).collect()
    want = brute_neighbours(vectors, [v for v in vectors if v % 100 == 0])
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert set(got) == set(want) and all(len(v) == 10 and v == sorted(v) for v in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    exact = {(q, i): s for q, v in brute_neighbours(vectors, want, len(vectors)).items() for s, i in v}
    assert all(abs(s - exact[q, i]) < 1e-9 for q, v in got.items() for s, i in v)


def test_neighbours_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (100, [0.0, 2.0]), (200, None), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<double>, node string, rank string")
    got = defaultdict(list)
    for r in nearest_neighbours.query_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    assert got == {0: [(1, 0.0), (2, 0.0), (3, round(2**0.5, 9)), (100, round(5**0.5, 9))], 100: [(3, 1.0), (0, round(5**0.5, 9)), (1, round(5**0.5, 9)), (2, round(5**0.5, 9))]}
    assert nearest_neighbours.query_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 2 else [float(i), 1.0, 0.5]) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest_neighbours.query_neighbours(df, F.col("vec_id") == 201).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 3, 5, 7, 9, 11, 13, 15, 17, 19] and all(r["score"] == 0 for r in got)


def test_repeated_rows_hide_no_ids(spark):
    """One row that stands 60 times leaves the places of the other ids with its vector."""
    rows = [(1, [1.0, 2.0])] * 60 + [(i, [1.0, 2.0]) for i in range(2, 9)] + [(9, [4.0, 6.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = nearest_neighbours.query_neighbours(df, F.col("vec_id") == 1).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 0.0) for i in range(2, 9)] + [(9, 5.0)]


def test_recall_of_many_leaves(spark):
    """The table holds many times LEAF vectors, so that the method and no comparison of all pairs is measured."""
    n = 3000
    assert n >= 10 * nearest_neighbours.LEAF
    x = np.random.default_rng(3).normal(size=(n, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in nearest_neighbours.query_neighbours(df, F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    d = ((x[::100, None].astype(float) - x[None]) ** 2).sum(2)
    want = {q * 100: set(np.argsort(row)[1:11].tolist()) for q, row in enumerate(d)}
    assert set(got) == set(want) and sum(len(got[q] & want[q]) for q in want) >= 0.9 * 10 * len(want)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_close_family_and_far_outliers(spark, kind):
    """A family of 400 far closer than half precision tells apart, and outliers at a million radii."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 8))
    x[:400] = x[0] + 1e-5 * rng.normal(size=(400, 8))
    x[780:] = 1e7 + 1e4 * rng.normal(size=(20, 8))
    x = x[rng.permutation(800)].astype(np.float32 if kind == "float" else np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    asked = range(0, 800, 20)
    want = {q: [i for _, i in v] for q, v in brute_neighbours({i: v.astype(float) for i, v in enumerate(x)}, asked).items()}
    got = defaultdict(list)
    for r in nearest_neighbours.query_neighbours(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert sum(len(set(got[q]) & set(want[q])) for q in asked) >= 0.98 * 10 * len(asked)


def test_large_pivots_are_dealt_anew(spark):
    """Pairs of a hub's members that one descent keeps apart meet in another, also when their edges are old."""
    x = np.random.default_rng(8).normal(size=(400, 4)).astype(np.float32)
    points = cut_of(spark, [(i, b"f" + v.tobytes()) for i, v in enumerate(x)], "node long, held binary")
    star = cut_of(spark, [(i, 0, float(((x[i] - x[0]) ** 2).sum()), i == 1) for i in range(1, 400)], "node long, near long, d double, new boolean")
    found = [{(r["node"], r["near"]) for r in nearest_neighbours.descend(star, points, 10, salt).collect()} for salt in (0, 1)]
    assert all(len(f) > 3000 for f in found) and found[0] - found[1] and found[1] - found[0]


def cut_of(spark, rows, ddl):
    return nearest_neighbours.cut(spark.createDataFrame(rows, ddl))


def test_hubs_go_to_several_tasks(spark):
    """A pivot with most of the edges is found, dealt by its members, and yields the edges of its groups; small tables have none."""
    x = np.random.default_rng(9).normal(size=(3000, 4)).astype(np.float32)
    points = cut_of(spark, [(i, b"f" + v.tobytes()) for i, v in enumerate(x)], "node long, held binary")
    star = cut_of(spark, [(i, 0, float(((x[i] - x[0]) ** 2).sum()), True) for i in range(1, 3000)], "node long, near long, d double, new boolean")
    hubs = nearest_neighbours.hubs_of(star, 2999)
    assert [(r["pivot"], r["parts"]) for r in hubs.collect()] == [(0, 2)]
    assert nearest_neighbours.hubs_of(star.limit(100), 100) is None
    exact = ((x[:, None].astype(float) - x[None]) ** 2).sum(2)
    rows = nearest_neighbours.descend(star, points, 5, 0, hubs).collect()
    # The hub itself is no member of its groups and has no edges here.
    assert {r["node"] for r in rows} == set(range(1, 3000)) and all(abs(exact[r["node"], r["near"]] - r["d"]) < 1e-6 for r in rows)


def test_pieces_of_runs():
    """Runs come whole, or from twice the limit on in pieces, whatever the batches."""
    keys = [1] * 3 + [2] * 11 + [3] + [4] * 8
    for size in (1, 2, 5, 23):
        batches = [pa.record_batch([pa.array(keys[i : i + size])], names=["key"]) for i in range(0, len(keys), size)]
        got = [(c[0].tolist(), b, e) for c, b, e in nearest_neighbours._pieces(iter([*batches[:1], batches[0].slice(0, 0), *batches[1:]]), lambda b: (b.column(0).to_numpy(),), 4)]
        assert [k for c, _, _ in got for k in c] == keys
        assert [(c[0], len(c), b, e) for c, b, e in got] == [(1, 3, True, True), (2, 4, True, False), (2, 7, False, True), (3, 1, True, True), (4, 4, True, False), (4, 4, False, True)]
    assert not list(nearest_neighbours._pieces(iter([]), lambda b: (b.column(0).to_numpy(),), 4))
