"""Manifest, shards and hard negatives against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import hard_negatives, merkle_manifest, sharding

DDL = "doc_id long, source string, lang string, n_chars long, text string, id string, hash string, pos long, n long, shard int, size long, before long, _id long, _part int, row long"
TEXTS = [None, "", "a", "A b", "ÄB 漢字 😀", "x" * 30_000, "Word " * 9_000, "1:2", "-", "a"]


def documents(spark, rows):
    return spark.createDataFrame([(*r, *["clash", "clash", *[7] * 8]) for r in rows], DDL).repartition(3)


def rows_of(n, langs, seed=3):
    rng = random.Random(seed)
    return [(i, rng.choice(["s", None]), rng.choice(langs), rng.choice([None, i]), rng.choice(TEXTS)) for i in range(n)]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    i, source, lang, n_chars, text = row
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n_chars, text)))


def proof(nodes, at):
    """The root of nodes and the siblings of one of them, by level as (before, after)."""
    beside = []
    while len(nodes) > 1:
        run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
        beside.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        nodes, at = [h("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)], at // 8
    return nodes[0], beside


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    leaves = {g: [leaf(r) for r in groups[g]] for g in order}
    subroots = [proof(leaves[g], 0)[0] for g in order]
    out = []
    for k, g in enumerate(order):
        root, upper = proof(subroots, k)
        for at, r in enumerate(groups[g]):
            subroot, lower = proof(leaves[g], at)
            folded = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                folded = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for before, after in lower + upper:
                folded = h(before + folded + after)
            out.append((r[0], leaf(r), subroot, root, h("".join(b + a for b, a in lower + upper)), folded, folded == root))
    return out


def query_manifest(df):
    lowered = [F.translate("text", merkle_manifest.UPPER, merkle_manifest.LOWER) if c == "text" else F.col(c) for c in merkle_manifest.COLUMNS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle_manifest.verified(merkle_manifest.manifest(df, claimed=F.when(tampered, merkle_manifest.leaf_hash(lowered))))
    return [tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


MANIFESTS = {
    "languages of many sizes": rows_of(150, ["en"] * 8 + ["de", None, "", "ü"]) + [(1000 + i, "s", f"l{i}", 1, "t") for i in range(12)],
    "one document": [(5, None, "en", 1, "Text")],
    "one language": rows_of(64, ["en"]),
    "one above a full tree": rows_of(65, [None]),
    "ties and repeats": [(7, "s", "en", 1, "A")] * 20 + [(7, "s", "en", 1, "b"), (None, None, "en", None, None), (None, "s", "en", 2, "C"), (-3, "s", "en", 1, "D")],
    "none": [],
}


@pytest.mark.parametrize("name", MANIFESTS)
def test_manifest_equals_brute_force(spark, name):
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(query_manifest(documents(spark, MANIFESTS[name])), key=key) == sorted(brute_manifest(MANIFESTS[name]), key=key)


def test_manifest_is_the_same_for_other_partitions(spark):
    df = documents(spark, rows_of(200, ["en", "de"]))
    assert sorted(query_manifest(df.repartition(1))) == sorted(query_manifest(df.repartition(17)))


def test_offsets_are_joined_without_broadcast_where_there_are_many(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "FEW_OFFSETS", 0)
    rows = MANIFESTS["languages of many sizes"]
    assert sorted(query_manifest(documents(spark, rows))) == sorted(brute_manifest(rows))


def brute_shards(rows, n):
    sized = sorted(((zlib.crc32((t or "").encode()), len((t or "").encode()) + 16, i is not None, i or 0) for i, *_, t in rows))
    total, before, slots, out = sum(x[1] for x in sized), 0, Counter(), []
    for crc, size, known, i in sized:
        k = n * (2 * before + size) // (2 * total)
        out.append((i if known else None, size, crc, k, slots[k]))
        slots[k] += 1
        before += size
    return out


SHARDS = {
    "mixed": rows_of(300, ["en"]),
    "copies": [(i, None, "en", 1, "copy of a text") for i in range(200)] + rows_of(100, ["en"], 8),
    "repeated rows": [(4, None, "en", 1, "again")] * 50 + [(None, None, None, None, None)] * 3 + [(None, None, None, None, "again")],
    "fewer rows than shards": rows_of(4, ["en"]),
    "none": [],
}


@pytest.mark.parametrize("name", SHARDS)
def test_shards_equal_brute_force(spark, name):
    got = sharding.shard(documents(spark, SHARDS[name]), 7).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_shards(SHARDS[name], 7), key=key)


def test_shards_are_off_their_target_by_less_than_a_row(spark):
    rows = SHARDS["copies"]
    got = sharding.shard(documents(spark, rows), 5).groupBy("shard").agg(F.sum("size").alias("b"), F.max("size").alias("m")).collect()
    mean = sum(r.b for r in got) / 5
    assert len(got) == 5 and all(abs(r.b - mean) <= max(x.m for x in got) for r in got)


def test_sharding_runs_no_python(spark):
    plan = sharding.shard(documents(spark, rows_of(20, ["en"])), 3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


VDDL = "vec_id long, embedding array<double>, label int, row long, anchor long, ints string, a int, r int, rank int, positives string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "c", 1, 1, 1, "c") for r in rows], VDDL).repartition(3)


def brute_negatives(rows):
    good, seen = [], set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * x) for x in v]
        key = (i, label, tuple(v))
        if sum(x * x for x in ints) >= 2**61 or key in seen:
            continue
        seen.add(key)
        good.append((i, (label + 1) % 10 if i % 7 == 0 else label, ints))
    out = []
    for i, label, v in good:
        if i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in good if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            inside = [(t, j) for t, j, m in scored if m != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j) in enumerate(inside)]
    return sorted(out)


def gaussian(n, d, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    scale = spread ** -np.arange(d)
    labels = rng.integers(0, 4, n)
    centres = rng.normal(size=(4, d))
    return [(i, [float(x) for x in (rng.normal(size=d) * 0.5 + centres[labels[i]]) * scale], int(labels[i])) for i in range(n)]


SPECIAL = [
    (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (50, [1.0], 1), (100, [], 2), (150, None, 1), (200, [float("nan"), 1.0], 1), (250, [float("inf"), 1.0], 1), (300, [None, 1.0], 1), (350, [1.0, 1.0], None),
    (None, [1.0, 2.0], 1), (400, [1e300, 0.0], 1), (450, [0.0, 0.0], 3), (1, [1.0, 2.0], 2), (2, [1.0, 1.5], 1), (3, [1.0, 1.5], 1), (4, [0.9, 1.2], 2), (5, [0.9, 1.2], 3), (6, [0.9, 1.2], 2), (8, [-1.0, -2.0], 1),
    (7, [0.8, 1.3, 5.0], 0), (0, [-1.0, 0.5], 1), (-50, [0.7, 1.4], 2), (9, [-0.0, 0.001], 3),
]
MINED = {
    "even axes": gaussian(400, 12, 1),
    "few strong axes": gaussian(500, 24, 2, 1.3),
    "one component": gaussian(120, 1, 3),
    "copies and ties": [(i, [0.5, 0.25, 0.125], i % 3) for i in range(160)] + [(1000 + i, [0.4, 0.2, 0.1], i % 3) for i in range(60)],
    "special": SPECIAL,
    "no anchors": [(1, [1.0], 1), (2, [1.0], 2)],
    "none": [],
}


@pytest.mark.parametrize("name", MINED)
@pytest.mark.parametrize("blocks", [(16_384, 2_048, 64), (37, 3, 2)])
def test_negatives_equal_brute_force(spark, monkeypatch, name, blocks):
    for c, v in zip(("BLOCK_ROWS", "BLOCK_ANCHORS", "TILE"), blocks, strict=True):
        monkeypatch.setattr(hard_negatives, c, v)
    rows = hard_negatives.moved_labels(hard_negatives.taking_part(vectors(spark, MINED[name])))
    got = hard_negatives.mine(rows, F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(MINED[name])


def test_bounds_discard_pairs_and_keep_the_best():
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(size=(600, 32)) * 1.4 ** -np.arange(32)).astype(np.int64)
    turn = hard_negatives.Rotation.of((x.T @ x).astype(float))
    y = x @ turn.axes
    i, j = hard_negatives._bounded(y[:20], y, 32, turn.slack, np.ones((20, 600), bool), lambda low, high: high >= hard_negatives._kth(low, 5)[:, None])
    assert len(i) < 20 * 600 / 4
    score = x[:20] @ x.T
    for a in range(20):
        assert set(np.argsort(-score[a])[:5]) <= set(j[i == a])


def test_any_orthogonal_matrix_gives_the_same(spark):
    rows = MINED["few strong axes"]
    axes = np.linalg.qr(np.random.default_rng(9).normal(size=(24, 24)))[0]
    turn = hard_negatives.Rotation(axes, hard_negatives.Rotation.of(np.eye(24)).slack + 1e-10)
    table = hard_negatives.taking_part(vectors(spark, rows)).select(F.col("vec_id").alias("anchor"), "vec_id", "label", hard_negatives.integers(F.col("vector"), 24).alias("ints")).toArrow()
    best = [hard_negatives._positives(t, 5)(table.slice(0, 40), table).sort_by([("anchor", "ascending"), ("positive_score", "descending"), ("positive_id", "ascending")]) for t in (turn, hard_negatives.Rotation.of(np.eye(24)))]
    assert best[0].num_rows == 200 and best[0].equals(best[1])
