"""Hard negatives: rows of other labels that score closely below a positive, found by bounds after a PCA rotation.

Vectors become integers, so scores are exact. An orthogonal rotation by the
principal axes of all rows (the eigenvectors of their second moments, which is what inner products
are made of) puts most of a product into its leading components. A pair starts
with those alone: the partial product, give or take the product of the norms of
what remains and a slack for rounding, bounds its score from both sides. Pairs
whose bounds cannot enter a result go; those that may get more
components; what survives all levels is scored by the integers themselves. Any
orthogonal matrix gives the same results, so the rotation only decides the cost.

Anchors meet all rows in blocks: a block of anchors and a block of rows are one
group of bounded size, whatever labels or vectors are common. Each gives the
best few of an anchor in that block, and a ranked window makes them the best of all. Two passes
are needed, for what a negative must score depends on the anchor's positives.

Rows take no part whose label, id or vector is null, that hold a null or a
component that is not finite, or whose integers' squares sum to 2^61 or more (their scores would not
fit a long). Rows alike in all columns count once; an id with several rows stands for
each, "other" rows being those of other ids. Vectors of unequal length
are continued by zeros. An anchor without positives or negatives gives no row, and so does
an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import cut, table

SCALE = 256
ANCHOR_EVERY, MOVED_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: Rows and anchors of a block, and anchors that are bounded at a time.
BLOCK_ROWS, BLOCK_ANCHORS, TILE = 16_384, 2_048, 64
#: Shares of the components after which pairs are bounded anew.
LEVELS = (8, 4, 2)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def taking_part(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """vec_id, label and vector (doubles) of the rows that take part, each distinct one once."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * SCALE).cast("double"), F.lit(2.0))) < 2.0**61
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(good).where(fits).distinct()


def moved_labels(rows: DataFrame) -> DataFrame:
    """Where the id is divisible by 7 the label is the next one."""
    return rows.withColumn("label", F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))


def integers(vector: Column, dims: int) -> Column:
    """floor(256 x) of each component, continued by zeros."""
    return F.concat(F.transform(vector, lambda x: F.floor(x * SCALE)), F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(vector)))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Rotation(NamedTuple):
    """An orthogonal matrix, strongest axes first, and what its products may be off, as a share of the norms."""

    axes: np.ndarray
    slack: float

    @classmethod
    def of(cls, moments: np.ndarray) -> Rotation:
        axes = np.linalg.eigh(moments)[1][:, ::-1]
        d = len(axes)
        defect = float(np.linalg.norm(axes.T @ axes - np.eye(d)))
        return cls(np.ascontiguousarray(axes), 2 * defect + 16 * d * (d**0.5 + 1) * 2.0**-53)


def rotation(rows: DataFrame, dims: int) -> Rotation:
    """From the second moments of all rows (ints): each task sums its own; dims^2 numbers reach the driver."""

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), dims).astype(np.float64)
                total += x.T @ x
        i, j = np.divmod(np.arange(dims * dims), dims)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "m": total.ravel()})

    sums = rows.select("ints").mapInArrow(moments, "i long, j long, m double").groupBy("i", "j").agg(F.sum("m").alias("m")).collect()
    out = np.zeros((dims, dims))
    for i, j, m in sums:
        out[i, j] = m
    return Rotation.of((out + out.T) / 2)


def _bounded(a: np.ndarray, b: np.ndarray, dims: int, slack: float, allowed: np.ndarray, useful: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (of rotated a and b) that are allowed and that no level of bounds shows to be useless."""
    alive, product = allowed, np.zeros(allowed.shape)
    loose = slack * np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :] + 1e-9
    done = 0
    for upto in sorted({max(1, dims // x) for x in LEVELS}):
        if upto == done:
            continue
        if alive.mean() > 0.1:
            product += a[:, done:upto] @ b[:, done:upto].T
        else:
            i, j = np.nonzero(alive)
            product[i, j] += np.einsum("ij,ij->i", a[i, done:upto], b[j, done:upto])
        rest = np.linalg.norm(a[:, upto:], axis=1)[:, None] * np.linalg.norm(b[:, upto:], axis=1)[None, :] + loose
        low, high = np.where(alive, product - rest, -np.inf), np.where(alive, product + rest, -np.inf)
        alive = alive & useful(low, high)
        done = upto
    return np.nonzero(alive)


def _kth(low: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -inf where there are fewer."""
    return np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] >= k else np.full(len(low), -np.inf)


def _scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, most: int = 50_000) -> np.ndarray:
    parts = [np.einsum("ij,ij->i", a[i[k : k + most]], b[j[k : k + most]]) for k in range(0, len(i), most)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, int)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[rank < k]


class _Side(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    ints: np.ndarray
    turned: np.ndarray

    @classmethod
    def of(cls, t: pa.Table, axes: np.ndarray) -> _Side:
        ints = _matrix(t["ints"], len(axes))
        return cls(t["vec_id"].to_numpy(), t["label"].to_numpy(), ints, ints.astype(np.float64) @ axes)


def _positives(turn: Rotation, k: int):
    def best(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """The first k rows of the block with an anchor's label, for each anchor."""
        dims = len(turn.axes)
        out = {"anchor": [], "positive_id": [], "positive_score": []}
        if anchors.num_rows and rows.num_rows:
            a, b, keys = _Side.of(anchors, turn.axes), _Side.of(rows, turn.axes), anchors["anchor"].to_numpy()
            for label in np.intersect1d(a.labels, b.labels):
                mine, theirs = np.flatnonzero(a.labels == label), np.flatnonzero(b.labels == label)
                for at in range(0, len(mine), TILE):
                    p = mine[at : at + TILE]
                    other = a.ids[p][:, None] != b.ids[theirs][None, :]
                    i, j = _bounded(a.turned[p], b.turned[theirs], dims, turn.slack, other, lambda low, high: high >= _kth(low, k)[:, None])
                    i, j = p[i], theirs[j]
                    score = _scores(a.ints, b.ints, i, j)
                    kept = _first(i, score, b.ids[j], k)
                    for name, v in zip(out, (keys[i[kept]], b.ids[j[kept]], score[kept]), strict=True):
                        out[name].append(v)
        return pa.table({c: np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for c, v in out.items()})

    return best


def _negatives(turn: Rotation, most: int, k: int):
    names = ("anchor", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")

    def best(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """The first k rows of the block with another label within the window of each of an anchor's positives."""
        dims = len(turn.axes)
        out: dict[str, list] = {c: [] for c in names}
        if anchors.num_rows and rows.num_rows:
            a, b, keys = _Side.of(anchors, turn.axes), _Side.of(rows, turn.axes), anchors["anchor"].to_numpy()
            given = anchors["positives"].to_pylist()
            # A window [low, high] for each positive; an empty one where there is none.
            score_of, id_of = np.full((len(given), most), -1, np.int64), np.zeros((len(given), most), np.int64)
            for r, ps in enumerate(given):
                for c, p in enumerate(ps):
                    score_of[r, c], id_of[r, c] = max(-1, p["positive_score"]), p["positive_id"]
            low_of, high_of = (score_of + 1) // 2, score_of - (score_of + 19) // 20
            high_of[score_of < 0] = -1
            low_of[score_of < 0] = 0
            for at in range(0, len(given), TILE):
                p = slice(at, at + TILE)
                lows, highs = low_of[p], high_of[p]

                def useful(low: np.ndarray, high: np.ndarray) -> np.ndarray:
                    found = np.zeros(low.shape, bool)
                    for c in range(most):
                        least, top = lows[:, c : c + 1], highs[:, c : c + 1]
                        sure = np.where((low >= least) & (high <= top), low, -np.inf)
                        found |= (least <= top) & (high >= np.maximum(least, _kth(sure, k)[:, None])) & (low <= top)
                    return found

                differ = a.labels[p][:, None] != b.labels[None, :]
                i, j = _bounded(a.turned[p], b.turned, dims, turn.slack, differ, useful)
                i = i + at
                score = _scores(a.ints, b.ints, i, j)
                for c in range(most):
                    inside = np.flatnonzero((score >= low_of[i, c]) & (score <= high_of[i, c]))
                    kept = inside[_first(i[inside], score[inside], b.ids[j[inside]], k)]
                    ik, jk = i[kept], j[kept]
                    for name, v in zip(names, (keys[ik], np.full(len(ik), c), a.ids[ik], id_of[ik, c], score_of[ik, c], b.ids[jk], score[kept]), strict=True):
                        out[name].append(v)
        return pa.table({c: np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for c, v in out.items()})

    return best


def _meet(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, best, schema: str) -> DataFrame:
    """best of each block of anchors with each block of rows."""
    a, r = -(-n_anchors // BLOCK_ANCHORS), -(-n_rows // BLOCK_ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = anchors.withColumn("a", block("anchor", a)).withColumn("r", every(r))
    right = rows.withColumn("r", block("row", r)).withColumn("a", every(a)).drop("row")
    right = right.toDF(*right.columns)  # columns of its own: anchors are some of the rows
    return left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(lambda x, y: best(x, y), schema)


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Hard negatives of the anchors among rows(vec_id, label, vector) as taking_part gives them.

    An anchor's positives are its first rows of the same label; for each, the first rows of other
    labels whose score is 50 to 95 hundredths of the positive's.
    """
    held = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    n, dims, n_anchors = held.agg(F.count("*"), F.max(F.size("vector")), F.count(F.when(anchor, 1))).head()
    if not n_anchors or not dims:
        return rows.sparkSession.createDataFrame([], RESULT)
    whole = held.select("row", "vec_id", "label", integers(F.col("vector"), dims).alias("ints"))
    turn = rotation(whole, dims)
    anchors = whole.where(anchor).withColumnRenamed("row", "anchor")
    ranked = lambda df, keys, score, other: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), other)))
    near = _meet(anchors, whole, n_anchors, n, _positives(turn, positives), "anchor long, positive_id long, positive_score long")
    first = cut(ranked(near, ["anchor"], "positive_score", "positive_id").where(F.col("rank") <= positives))
    listed = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives"))
    far = _meet(
        anchors.join(listed, "anchor"), whole, n_anchors, n, _negatives(turn, positives, negatives),
        "anchor long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    found = ranked(far, ["anchor", "place"], "negative_score", "negative_id").where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every fiftieth embedding among all."""
    rows = moved_labels(taking_part(table(spark, sf_dir, "embeddings")))
    return mine(rows, F.col("vec_id") % ANCHOR_EVERY == 0)


OP13_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""
