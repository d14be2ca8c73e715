"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node with its smallest ids (no more of them than can be
asked for). Random projection trees, grown on a bounded sample (``SAMPLE``
vectors), give every node first neighbours: those in its leaf. Leaves are small
(about ``LEAF`` vectors), so only tables of that size are compared pair by pair.

NN-descent then joins neighbours of neighbours. Each edge sends the vector of
either end to the other, the pivot; at a pivot all that meet are compared, and a
pair nearer than what one of them has so far becomes a candidate edge. A node
keeps its ``K`` nearest. Pairs of which both came by old edges are not compared
again. The members of a pivot with over ``2 * GROUP`` are compared in groups of ``GROUP``: none of
them is left out, but pairs of different groups are not compared at that pivot. Each
descent deals them differently, and in such groups pairs of old edges are compared too, as they may not
have met. A pivot that holds over a ``HUBS``-th of all edges is dealt to several tasks; there
are fewer than twice ``HUBS`` of those. Large leaves are dealt too, differently in each tree. The descent ends when of 200 edges
less than one changes; each change makes an edge shorter, so it ends.

A query starts at its own node and its neighbours, and goes on from all of its ``BEAM`` nearest nodes
that it has not left from yet, by edges of either direction, until there are none, or until it has left from
``BEAM`` nodes and a round brought none of its nearest. Of what it has met it keeps the nodes it has left from and the
``KEEP`` nearest; others may be met again, which changes nothing. The nearest found are ranked by their distance on the original vectors.

A round of a descent has three shuffles (members, pivots, nodes), a round of the search four (nodes left from, new pairs,
vectors, queries). What a round leaves is written in few files, so that reading it takes no more tasks than its rows ask for.

Building and searching compare the vectors as they are given (single precision if
the column is, else double), scaled by a power of two, which changes no digit. Distances are
double precision, of pairs that are kept from the differences themselves, so
those within a close family and of far outliers are told apart. Recall is measured against brute force by the tests (0.9 is asked
for). Vectors that are null, zero, or hold null or non-finite components take no
part, nor do those of another length than the most frequent one and null ids.
Ties go to smaller ids; repeated rows with one id and vector are one; of a query, rows
with its id are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quarryline.llm.common import cut, table

K = 20
TREES = 8
LEAF = 200
SAMPLE = 4096
ENOUGH = 0.005
BEAM = 300
KEEP = 10 * BEAM
GROUP = 96
HUBS = 1000
#: Rows to a file of what a round leaves: nodes, edges and queries.
EACH_NODE, EACH_EDGE, EACH_QUERY = 10_000, 100_000, 200


def kept(df: DataFrame, rows: int, each: int) -> DataFrame:
    """df from a checkpoint, in files of about ``each`` rows, but no fewer than the cores ask for and no more than df has."""
    return cut(df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each))))


def usable(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """vec_id and vector (double) of the rows that take part, and their number."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null and size(vector) > 0")
    good = rows.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0))
    lengths = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    n, count = (lengths[0]["n"], lengths[0]["count"]) if lengths else (0, 0)
    return good.where(F.size("vector") == n), count


def nodes_of(rows: DataFrame, ids: int) -> DataFrame:
    """node (the smallest id), ids (the smallest ones) and vector of each distinct vector."""
    # Repeated rows go first, else they would take the places of other ids. The rank's limit is taken in each task before the shuffle.
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.select("vec_id", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector")).distinct().withColumn("rank", rank).where(F.col("rank") <= ids)
    return few.groupBy("vector").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("node", "ids", "vector")


class _Trees:
    """Random projection trees over a sample, with random hyperplanes below their leaves."""

    def __init__(self, sample: np.ndarray, n: int, trees: int, leaf: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
        known = max(0, min(depth, int(np.log2(max(1, len(sample) / 16)))))
        self.trees = []
        for _ in range(trees):
            levels, at = [], np.zeros(len(sample), np.int64)
            for d in range(known):
                lines, cuts = np.zeros((2**d, sample.shape[1])), np.zeros(2**d)
                for node in range(2**d):
                    here = sample[at == node]
                    a, b = (here[rng.integers(len(here))] for _ in range(2)) if len(here) else (rng.normal(size=sample.shape[1]), 0)
                    lines[node] = a - b if np.any(a != b) else rng.normal(size=sample.shape[1])
                    cuts[node] = np.median(here @ lines[node]) if len(here) else 0
                levels.append((lines, cuts))
                at = 2 * at + ((sample * lines[at]).sum(1) > cuts[at])
            lines = rng.normal(size=(depth - known, sample.shape[1]))
            self.trees.append((levels, lines, np.median(sample @ lines.T, axis=0)))

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        for levels, lines, cuts in self.trees:
            at = np.zeros(len(x), np.int64)
            for rows, limits in levels:
                at = 2 * at + ((x * rows[at]).sum(1) > limits[at])
            for line, limit in zip(lines, cuts, strict=True):
                at = 2 * at + (x @ line > limit)
            yield at


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors; the first byte of each tells their kind, and all are of one length."""
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    bytes_ = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(n, -1)
    return np.ascontiguousarray(bytes_[:, 1:]).view(np.float32 if bytes_[0, 0] == ord("f") else np.float64).astype(np.float64)


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared distances, from differences: norms less products would lose those of a close family."""
    d = np.empty((len(x), len(x)))
    step = max(1, 100_000 // x.size)
    for i in range(0, len(x), step):
        y = x[i : i + step, None] - x[None]
        d[i : i + step] = np.einsum("ijk,ijk->ij", y, y)
    np.fill_diagonal(d, np.inf)
    return d


_EDGE = "node long, near long, d double"


def _edges(node: list, near: list, d: list) -> pa.RecordBatch:
    join = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.empty(0, kind))
    return pa.record_batch([join(node, np.int64), join(near, np.int64), join(d, np.float64)], names=["node", "near", "d"])


Columns = tuple[np.ndarray, ...]


def _pieces(batches: Iterator[pa.RecordBatch], columns: Callable[[pa.RecordBatch], Columns], most: int) -> Iterator[tuple[Columns, bool, bool]]:
    """Each run of equal first columns, whole or, from 2 * most rows on, in pieces of ``most`` and a last one; whether a piece begins and ends its run."""
    rest, begun = None, False
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows:
            now = columns(batch)
            now = now if rest is None else tuple(np.concatenate(both) for both in zip(rest, now, strict=True))
        elif batch is None and rest is not None:
            now = rest
        else:
            continue
        key = now[0]
        ends = [*(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
        at = 0
        for end in ends:
            while end - at >= 2 * most:
                yield tuple(c[at : at + most] for c in now), not begun, False
                begun, at = True, at + most
            if batch is None or end < len(key):
                yield tuple(c[at:end] for c in now), not begun, True
                begun, at = False, end
        rest = tuple(c[at:] for c in now)


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node."""
    rank = F.row_number().over(Window.partitionBy("node").orderBy("d", "near"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def bounded_sample(nodes: DataFrame, n: int) -> np.ndarray:
    """About SAMPLE vectors, by a hash of the node, in order of node; at most twice as many."""
    share = min(1.0, SAMPLE / n)
    rows = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < share * 1_000_000).orderBy("node").limit(2 * SAMPLE).select("vector").collect()
    return np.array([r["vector"] for r in rows or nodes.limit(1).select("vector").collect()])


def first_graph(points: DataFrame, sample: np.ndarray, n: int, k: int, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """node, near, d (squared) from the leaves of the trees; points has node and held."""
    forest = _Trees(sample, n, trees, leaf)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for t, leaves in enumerate(forest.leaves(_matrix(batch.column(1)))):
                    yield pa.record_batch([pa.array(leaves * trees + t), batch.column(0), batch.column(1)], names=["leaf", "node", "held"])

    placed = points.mapInArrow(place, "leaf long, node long, held binary")
    # Leaves are split at random where they are large.
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / (3 * leaf)).alias("parts"))
    dealt = placed.join(sizes, "leaf").select(F.xxhash64("leaf", F.pmod(F.xxhash64("node", "leaf"), "parts")).alias("leaf"), "node", "held")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, ids, x), _, _ in _pieces(batches, lambda b: (b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))), 4 * leaf):
            if len(ids) < 2:
                continue
            m = min(k, len(ids) - 1)
            d = _squares(x)
            best = np.argpartition(d, m - 1, axis=1)[:, :m]
            yield _edges([np.repeat(ids, m)], [ids[best].ravel()], [np.take_along_axis(d, best, 1).ravel()])

    found = dealt.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(compare, _EDGE)
    return nearest(found.groupBy("node", "near").agg(F.min("d").alias("d")), k)


def descend(graph: DataFrame, points: DataFrame, k: int, salt: int = 0, hubs: DataFrame | None = None) -> DataFrame:
    """The graph (node, near, d, new) after one join of neighbours of neighbours; salt tells how large pivots are dealt, hubs (pivot, parts) which go to several tasks."""
    ends = graph.select(F.col("node").alias("pivot"), F.col("near").alias("member"), "new").union(graph.select(F.col("near").alias("pivot"), F.col("node").alias("member"), "new"))
    place = F.xxhash64("member", F.lit(salt))
    if hubs is not None:
        ends = ends.join(F.broadcast(hubs), "pivot", "left").withColumn("pivot", F.xxhash64("pivot", F.pmod(place, F.coalesce("parts", F.lit(1))))).drop("parts")
    bound = graph.groupBy("node").agg(F.max("d").alias("worst"), F.count("*").alias("has"))
    carried = points.join(bound, "node", "left").select(F.col("node").alias("member"), "held", F.when(F.col("has") >= k, F.col("worst")).otherwise(float("inf")).alias("worst"))
    met = ends.join(carried, "member").select("pivot", "member", "held", "worst", "new", place.alias("place"))

    def columns(batch: pa.RecordBatch) -> Columns:
        return tuple(_matrix(batch.column(i)) if i == 2 else batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, near, ds, rows = [], [], [], 0
        for (_, ids, x, worst, new), begins, ends_here in _pieces(batches, columns, GROUP):
            whole = begins and ends_here
            if whole and not new.any():
                continue
            # An edge that both ends hold has brought its member twice.
            ids, at, which = np.unique(ids, return_index=True, return_inverse=True)
            if len(ids) < 2:
                continue
            fresh = np.zeros(len(ids), bool)
            fresh[which[new]] = True
            d = _squares(x[at])
            if whole:
                d[~(fresh[:, None] | fresh[None])] = np.inf
            i, j = np.nonzero(d < worst[at][:, None])
            if len(i):
                node.append(ids[i])
                near.append(ids[j])
                ds.append(d[i, j])
                rows += len(i)
                if rows > 100_000:
                    yield _edges(node, near, ds)
                    node, near, ds, rows = [], [], [], 0
        yield _edges(node, near, ds)

    found = met.repartition("pivot").sortWithinPartitions("pivot", "place").mapInArrow(compare, _EDGE)
    both = graph.select("node", "near", "d", F.lit(False).alias("new")).union(found.select("node", "near", "d", F.lit(True)))
    merged = both.repartition("node").groupBy("node", "near").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    return nearest(merged, k)


def hubs_of(graph: DataFrame, edges: int) -> DataFrame | None:
    """pivot and parts of the pivots that hold over a HUBS-th of the edges: fewer than twice HUBS, as an edge has two ends."""
    least = max(edges / HUBS, 20 * GROUP)
    found = graph.groupBy("near").count().where(F.col("count") > least).select("near", F.ceil(F.col("count") / least).cast("long")).collect()
    return graph.sparkSession.createDataFrame(found, "pivot long, parts long") if found else None


def build(points: DataFrame, sample: np.ndarray, n: int, k: int = K, leaf: int = LEAF) -> DataFrame:
    """node, near and d (squared) of the neighbour graph."""
    graph = kept(first_graph(points, sample, n, k, leaf=leaf).withColumn("new", F.lit(True)), n * k, EACH_EDGE)
    salt, new = 0, n * k
    while new > ENOUGH * n * k:
        graph = kept(descend(graph, points, k, salt, hubs_of(graph, n * k)), n * k, EACH_EDGE)
        new = graph.where("new").count()
        salt += 1
    return graph.select("node", "near", "d")


_STATE = "query long, held binary, nodes array<long>, ds array<double>, left array<boolean>, going array<long>"


def search(queries: DataFrame, points: DataFrame, graph: DataFrame, n: int, k: int = K, beam: int = BEAM, top: int = 10) -> DataFrame:
    """query and nodes, the nearest first, that the queries (query, start, held) have met."""
    count = queries.count()
    some = queries.select("held").first()
    single = some is not None and some["held"][:1] == b"f"
    links = kept(graph.select("node", "near").union(graph.select("near", "node")).distinct(), 2 * n * k, EACH_EDGE)
    nodes = points.select(F.col("node").alias("near"), F.col("held").alias("found"))
    around = graph.select(F.col("node").alias("start"), F.struct("d", "near").alias("edge"))
    first = queries.join(around, "start", "left").groupBy("query", "start").agg(F.first("held").alias("held"), F.array_sort(F.collect_list("edge")).alias("edges"))
    ids, ds = F.concat(F.array("start"), F.col("edges.near")), F.concat(F.array(F.lit(0.0)), F.col("edges.d"))
    state = kept(first.select("query", "held", ids.alias("nodes"), ds.alias("ds"), F.transform(ids, lambda x: F.lit(True)).alias("left"), ids.alias("going")), count, EACH_QUERY)

    def columns(batch: pa.RecordBatch) -> Columns:
        states = np.empty(batch.num_rows, object)
        states[:] = batch.column(3).to_pylist()
        return batch.column(0).to_numpy(), batch.column(1).fill_null(0).to_numpy(), _matrix(batch.column(2)), states

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (query, near, x, states), begins, ends in _pieces(batches, columns, 4096):
            if begins:
                asked, state = x[0], states[0]
                met, d, left = np.array(state["nodes"], np.int64), np.array(state["ds"]), np.array(state["left"], bool)
                before = np.sort(d)[: top + 1]
                near, x = near[1:], x[1:]
            met, d = np.concatenate([met, near]), np.concatenate([d, ((x - asked) ** 2).sum(1)])
            left = np.concatenate([left, np.zeros(len(near), bool)])
            order = np.lexsort((met, d))
            order = order[(np.arange(len(order)) < KEEP) | left[order]]
            met, d, left = met[order], d[order], left[order]
            if ends:
                ended = left.sum() >= beam and np.array_equal(before, d[: top + 1])
                going = np.flatnonzero(~left[:beam]) if not ended else np.empty(0, np.int64)
                left[going] = True
                held = (b"f" if single else b"d") + asked.astype(np.float32 if single else np.float64).tobytes()
                yield pa.record_batch([pa.array(query[:1]), pa.array([held], pa.binary()), pa.array([met]), pa.array([d]), pa.array([left]), pa.array([met[going]], pa.list_(pa.int64()))], names=["query", "held", "nodes", "ds", "left", "going"])

    while not state.where("size(going) > 0").isEmpty():
        going = state.select("query", F.explode("going").alias("node"))
        known = state.select("query", F.explode("nodes").alias("near"))
        onward = going.join(links, "node").select("query", "near").distinct().join(known, ["query", "near"], "left_anti")
        fresh = onward.join(nodes, "near").select("query", "near", F.col("found").alias("held"), F.lit(None).cast("struct<nodes: array<long>, ds: array<double>, left: array<boolean>>").alias("state"))
        own = state.select("query", F.lit(None).cast("long").alias("near"), "held", F.struct("nodes", "ds", "left").alias("state"))
        state = kept(own.union(fresh).repartition("query").sortWithinPartitions("query", "near").mapInArrow(step, _STATE), count, EACH_QUERY)
    return state.select("query", "nodes")


def query_neighbours(df: DataFrame, is_query: Column, top: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``top`` nearest found of each row for which is_query (over vec_id) holds."""
    rows, count = usable(df, id_col, vector_col)
    nodes = kept(nodes_of(rows, top + 1), count, EACH_NODE)
    n = nodes.count()
    if n == 0:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = bounded_sample(nodes, n)
    single = df.schema[vector_col].dataType == ArrayType(FloatType())
    # Single precision needs none: its squares are within double precision.
    scale = 1.0 if single else 2.0 ** -min(1000, max(-1000, int(np.frexp(np.abs(sample).max())[1])))
    points = kept(nodes.select("node", "vector").mapInArrow(lambda batches: _held(batches, scale, single), "node long, held binary"), n, EACH_NODE)
    asked = rows.where(is_query).distinct().join(nodes.select("vector", F.col("node").alias("start")), "vector").select("vec_id", "start")
    # Queries of one vector are one search.
    starts = asked.select(F.col("start").alias("query")).distinct().withColumn("start", F.col("query")).join(points, F.col("start") == F.col("node")).select("query", "start", "held")
    found = search(starts, points, build(points, sample * scale, n), n, top=top)
    # Scaling aside these distances are those of the scores; some more than asked for are scored, as sums may round otherwise.
    best = found.select("query", F.explode(F.slice("nodes", 1, 4 * top + 10)).alias("node"))
    vectors = nodes.select("node", "ids", "vector")
    pairs = best.join(vectors, "node").join(nodes.select(F.col("node").alias("query"), F.col("vector").alias("asked")), "query")
    scored = pairs.select("query", "ids", "vector", "asked").mapInArrow(_scored, "query long, ids array<long>, score double")
    every = asked.join(scored, F.col("start") == F.col("query")).select(F.col("vec_id").alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _held(batches: Iterator[pa.RecordBatch], scale: float, single: bool) -> Iterator[pa.RecordBatch]:
    """The vectors' bytes behind one that tells their kind."""
    mark, kind = (b"f", np.float32) if single else (b"d", np.float64)
    for batch in batches:
        if batch.num_rows:
            x = (_rows(batch.column(1)) * scale).astype(kind)
            yield pa.record_batch([batch.column(0), pa.array([mark + v.tobytes() for v in x], pa.binary())], names=["node", "held"])


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            d = np.sqrt(((_rows(batch.column(2)) - _rows(batch.column(3))) ** 2).sum(1))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(d)], names=["query", "ids", "score"])


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each vector whose id is divisible by 100."""
    return query_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
