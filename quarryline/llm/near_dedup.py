"""Near-duplicate classes by BagMinHash.

A text is a bag of shingles of five words (lower-cased runs of letters and
digits; a shorter text is one shingle, a text without words has none). Two texts
are linked if the weighted Jaccard similarity of their bags is 0.8 or more,
and a class is a connected component of the links.

1. Signatures. A shingle's weight is its count, discretised into unit cells. The
   cells of a shingle are grouped into dyadic blocks of 1, 2, 4, ... cells, and each
   block has a Poisson process whose rate is its size, seeded by the shingle. A
   point has a time, a register and a cell of its block, and counts for a text if
   the cell is below its weight. A register keeps its earliest point, so two texts
   agree in a register with the probability of their weighted Jaccard. Points are
   made only up to the time by which all registers are likely filled, and longer
   where one is not.
2. Bands of ``ROWS`` registers meet in buckets: at the threshold two texts miss all
   ``BANDS`` with a probability of 3e-5. Equal texts are one node from the start.
3. Of the texts in buckets with others, shingles that no second one of these
   texts has cannot overlap, which bounds a text's similarity to any other: most
   texts that share a passage only, or that are edited too far, are out before any
   comparison, exactly.
4. In a bucket, the text with the largest share of common shingles is the centre,
   and all others are compared with it (multiset overlap, exactly): as many pairs as
   texts. Across the components that a bucket still holds, two texts either share
   a shingle that at most ``RARE`` texts have, and meet by it, or overlap in
   frequent shingles only, and are compared if there are enough of those, in the first of
   the buckets that they share. So no link
   between texts that met in a bucket is lost, pairs within a component are never
   listed, and texts that differ from their original in ways of their own do not
   meet each other.
5. Components by contraction of the links, as Spark joins: after a round few links are left.

The result has a row for each row of the input: doc_id, class_id (smallest doc_id
of the class) and class_size (rows). Null texts are empty, and all empty texts are
one class. Texts are identified by 64-bit hashes. Repeated rows are copies; a null
id is in a class like others; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import chunks, cut, table, text_or_empty
from quarryline.llm.substring_dedup import powers

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
RARE = 20
REGISTERS = BANDS * ROWS

#: A word, as _words finds it.
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _is_word() -> np.ndarray:
    """Whether a code point is a letter, a digit or an underscore."""
    return np.array([c == 0x5F or (not 0xD800 <= c < 0xE000 and chr(c).isalnum()) for c in range(0x110000)])


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word, in order: a polynomial in its characters, from running sums over all texts."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in low])])
    first = np.zeros(len(points) + 1, bool)
    first[offsets] = True
    inside = _is_word()[points]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    up, down = powers(1 << max(20, len(points).bit_length()))
    sums = np.cumsum(_mixed(points.astype(np.uint64) + _MIX) * up[: len(points)])
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return _mixed((sums[ends] - before) * down[starts]), np.searchsorted(offsets, starts, side="right") - 1


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each shingle, as often as it occurs."""
    hashes, doc = _words(texts)
    lengths = np.bincount(doc, minlength=len(texts))
    at = np.arange(len(doc)) - (np.cumsum(lengths) - lengths)[doc]
    starts = np.flatnonzero((at + size <= lengths[doc]) | ((at == 0) & (lengths[doc] < size)))
    left = np.minimum(lengths[doc[starts]] - at[starts], size)
    out = np.zeros(len(starts), np.uint64)
    for k in range(size):
        here = k < left
        out[here] = out[here] * _MIX + hashes[starts[here] + k]
    return doc[starts], _mixed(out + left.astype(np.uint64))


def bags(row: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) with each shingle of a row once, in order."""
    if not len(row):
        return row, shingle, np.empty(0, np.int64)
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])]))
    return row[first], shingle[first], np.diff(np.append(first, len(row)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def bag_min_hash(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_rows: int, m: int = REGISTERS) -> np.ndarray:
    """The signature of each row: the point in each of m registers (0 in a row without shingles)."""
    points = np.zeros((n_rows, m), np.uint64)
    total = np.bincount(row, weight, n_rows)
    wanted = np.flatnonzero(total)
    limit = np.zeros(n_rows)
    limit[wanted] = m * (np.log(m) + 3) / total[wanted]
    # Block b of a shingle has the cells from 2**b - 1 to 2**(b + 1) - 2.
    blocks = []
    for b in range(int(weight.max(initial=0)).bit_length()):
        has = np.flatnonzero(weight >= 2**b)
        if len(has):
            blocks.append((has, np.full(len(has), b)))
    if not blocks:
        return points
    of = np.concatenate([x[0] for x in blocks])
    level = np.concatenate([x[1] for x in blocks])
    size = np.exp2(level)
    below = np.minimum(weight[of] - (size - 1), size)
    seed, doc = _mixed(shingle[of] + _MIX * (level + 1).astype(np.uint64)), row[of]
    while len(wanted):
        chosen = np.zeros(n_rows, bool)
        chosen[wanted] = True
        live = np.flatnonzero(chosen[doc])
        time, step = np.zeros(len(live)), 0
        got = []
        while len(live):
            step += 1
            draw = _mixed(seed[live] + np.uint64(int(_MIX) * 2 * step % 2**64))
            time = time - np.log(_uniform(draw)) / size[live]
            on = time <= limit[doc[live]]
            live, time, draw = live[on], time[on], draw[on]
            more = _mixed(draw ^ np.uint64(0xD6E8FEB86659FD93))
            register = (more & np.uint64(0xFFFFFFFF)) % np.uint64(m)
            cell = (more >> np.uint64(32)).astype(np.float64) * 2.0**-32 * size[live]
            fits = cell < below[live]
            got.append((doc[live][fits] * m + register[fits].astype(np.int64), time[fits], draw[fits]))
        slot, time, draw = (np.concatenate(x) for x in zip(*got, strict=True))
        earliest = np.full(n_rows * m, np.inf)
        np.minimum.at(earliest, slot, time)
        first = time == earliest[slot]
        points.reshape(-1)[slot[first]] = draw[first] | np.uint64(1)
        open_ = (points == 0).any(axis=1)
        wanted = wanted[open_[wanted]]
        points[wanted] = 0
        limit[wanted] *= 3
    return points


def band_keys(points: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.empty((len(points), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(points), b + 1, np.uint64)
        for r in range(rows):
            key = _mixed(key * _MIX + points[:, b * rows + r])
        out[:, b] = key
    return out.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # copies that this task has met already
    for part, texts in chunks(batches, most=500_000):
        ids = part.column(0).to_pylist()
        new = [i for i, t in enumerate(ids) if t not in seen and not seen.add(t)]
        if len(seen) > 1_000_000:
            seen.clear()
        row, shingle, weight = bags(*shingles([texts[i] for i in new]))
        keys = band_keys(bag_min_hash(row, shingle, weight, len(new)))
        n = np.bincount(row, weight, len(new)).astype(np.int32)
        full = np.flatnonzero(n)
        yield pa.record_batch(
            [pa.array([ids[new[i]] for i in full.tolist()], pa.int64()), pa.array(n[full]), pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), pa.array(keys[full].reshape(-1)))],
            names=["tid", "n", "keys"],
        )


def _numbered(texts: list[str]) -> list[np.ndarray]:
    """The bag of each text as a sorted set: the k-th occurrence of a shingle is an element of its own."""
    row, shingle, weight = bags(*shingles(texts))
    ends = np.cumsum(weight)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - weight, weight)
    every = np.repeat(shingle, weight)
    every = np.where(place > 0, _mixed(every + _MIX * place.astype(np.uint64)), every)
    cuts = np.searchsorted(np.repeat(row, weight), np.arange(1, len(texts)))
    return [np.sort(x) for x in np.split(every, cuts)]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches, most=500_000):
        yield pa.record_batch([part.column(0), pa.array([v.tobytes() for v in _numbered(texts)], pa.binary())], names=["tid", "bag"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            bags_ = part.column(1).to_pylist()
            tid = np.repeat(part.column(0).to_numpy(), [len(b) // 8 for b in bags_])
            yield pa.record_batch([pa.array(tid), pa.array(np.frombuffer(b"".join(bags_), np.int64))], names=["tid", "element"])


def _similar(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            good, last, kept = [], None, None
            for i, (x, y) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                if y is not last:
                    last, kept = y, np.frombuffer(y, np.uint64)
                a = np.frombuffer(x, np.uint64)
                short, long_ = (a, kept) if len(a) < len(kept) else (kept, a)
                both = int((long_[np.searchsorted(long_, short).clip(max=len(long_) - 1)] == short).sum())
                if both >= threshold * (len(a) + len(kept) - both) - 1e-9:
                    good.append(i)
            take = pa.array(good, pa.int64())
            yield pa.record_batch([part.column(0).take(take), part.column(1).take(take)], names=["a", "b"])


def linked(pairs: DataFrame, bags_: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose bags are similar."""
    left, right = bags_.select(F.col("tid").alias("a"), F.col("bag").alias("bag_a")), bags_.select(F.col("tid").alias("b"), F.col("bag").alias("bag_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(lambda batches: _similar(batches, threshold), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and label (one node of its component) of each node of the edges (a, b).

    Each round maps a node to the smallest of itself and its neighbours and the edges with it, so that
    most edges become one or none. Nodes are hashes, so chains of them are in no order and shrink by a share.
    """
    low, high = lambda a, b: F.least(a, b).alias("a"), lambda a, b: F.greatest(a, b).alias("b")
    edges = cut(edges.select(low("a", "b"), high("a", "b")).where("a < b").distinct())
    steps = [edges.select(F.col("a").alias("node"), F.col("a").alias("to")).limit(0)]
    while not edges.isEmpty():
        near = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        to = cut(near.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("to")))
        steps.append(to)
        moved = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = cut(moved.select(low("x", "y"), high("x", "y")).where("a < b").distinct())
    labels = steps.pop().withColumnRenamed("to", "label")
    for to in steps[:0:-1]:
        labels = to.join(labels.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("label", "to").alias("label"))
    return cut(labels)


def _possible(a: str, b: str, threshold: float, shared: str = "common") -> Column:
    """Whether so many shared shingles allow the threshold: the overlap has at least threshold / (1 + threshold) of both sizes."""
    most = F.least(F.col(f"{a}.{shared}"), F.col(f"{b}.{shared}"))
    return most * (1 + threshold) >= threshold * (F.col(f"{a}.n") + F.col(f"{b}.n")) - 1e-6


def text_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """tid and label of the texts that are linked to another text; docs has tid and text."""
    sketch = cut(docs.select("tid", "text").mapInArrow(_sketch, "tid long, n int, keys array<long>"))
    keys = sketch.select("tid", "n", F.explode("keys").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("tid").alias("low"), F.max("tid").alias("high")).where("low < high").select("key")
    members = cut(keys.join(buckets, "key").select("key", "tid", "n"))
    texts = docs.groupBy("tid").agg(F.first("text").alias("text"))
    bags_ = cut(texts.join(members.select("tid").distinct(), "tid", "left_semi").select("tid", "text").mapInArrow(_vectors, "tid long, bag binary"))
    # Shingles that one, or few, of these texts have.
    elements = bags_.mapInArrow(_elements, "tid long, element long")
    few = elements.groupBy("element").agg(F.count("*").alias("texts")).where(F.col("texts") <= RARE)
    rare = cut(elements.join(few, "element").select("element", "tid", "texts"))
    counts = rare.groupBy("tid").agg(F.count("*").alias("rare"), F.count_if(F.col("texts") == 1).alias("alone"))
    judged = members.distinct().join(counts, "tid", "left").select("key", "tid", "n", *((F.col("n") - F.coalesce(c, F.lit(0))).alias(k) for c, k in (("alone", "common"), ("rare", "frequent"))))
    judged = cut(judged.where(F.col("common") >= threshold * F.col("n") - 1e-6))
    centre = judged.groupBy("key").agg(F.max(F.struct(F.round(F.col("common") / F.col("n"), 3).alias("share"), "n", "tid", "common")).alias("c"))
    centre = centre.select("key", "c.*")
    pairs = judged.alias("x").join(centre.alias("c"), "key").where((F.col("x.tid") != F.col("c.tid")) & _possible("x", "c", threshold))
    pairs = cut(pairs.select(F.least("x.tid", "c.tid").alias("a"), F.greatest("x.tid", "c.tid").alias("b")).distinct())
    edges = cut(linked(pairs, bags_, threshold))
    labels = components(edges)
    # Pairs across the components of a bucket.
    named = judged.join(labels.withColumnRenamed("node", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    split = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("texts")).where("low < high and texts > 2").select("key")
    open_ = named.join(split, "key", "left_semi")
    open_ = cut(open_.join(open_.groupBy("tid").agg(F.collect_set("key").alias("keys")), "tid"))
    apart = F.expr("x.tid < y.tid and x.label <> y.label")
    # Texts that meet in several buckets are a pair in the first of them only.
    here = F.expr("array_min(array_intersect(x.keys, y.keys)) = x.key")
    alike = open_.alias("x").join(open_.alias("y"), F.expr("x.key = y.key") & apart & _possible("x", "y", threshold, "frequent") & here)
    by_rare = rare.where("texts > 1").join(open_.select("tid", "n", "common", "label").distinct(), "tid").select("element", "tid", "n", "common", "label")
    alike_rare = by_rare.alias("x").join(by_rare.alias("y"), F.expr("x.element = y.element") & apart & _possible("x", "y", threshold))
    across = alike.select(F.col("x.tid").alias("a"), F.col("y.tid").alias("b")).union(alike_rare.select(F.col("x.tid").alias("a"), F.col("y.tid").alias("b")))
    further = cut(linked(across.distinct().join(pairs, ["a", "b"], "left_anti"), bags_, threshold))
    if not further.isEmpty():
        labels = components(edges.union(further))
    return labels.select(F.col("node").alias("tid"), "label")


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and class_size of each row."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(df[text_col]).alias("text")).withColumn("tid", F.xxhash64("text"))
    labels = text_classes(docs.select("tid", "text"), threshold)
    copies = docs.groupBy("tid").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    named = copies.join(labels, "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    classes = named.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"))
    by_text = named.select("tid", "label").join(classes, "label").select("tid", "class_id", "class_size")
    return docs.select("doc_id", "tid").join(by_text, "tid").select("doc_id", "class_id", "class_size")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The row with the smallest id of each class, with all its columns; of repeated rows one."""
    docs = df.withColumn("_tid", F.xxhash64(text_or_empty(df[text_col])))
    labels = text_classes(docs.select(F.col("_tid").alias("tid"), text_or_empty(df[text_col]).alias("text")), threshold)
    copies = docs.select(F.col("_tid").alias("tid"), id_col).groupBy("tid").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))).alias("k"))
    named = copies.join(labels, "tid", "left").select(F.coalesce("label", "tid").alias("label"), F.struct("k.none", "k.id", "tid").alias("k"))
    chosen = named.groupBy("label").agg(F.min("k").alias("k")).select(F.col("k.tid").alias("_tid"), F.col("k.id").alias("_id"))
    return docs.join(chosen, (docs["_tid"] == chosen["_tid"]) & docs[id_col].eqNullSafe(chosen["_id"])).select(docs["_tid"], *(docs[c] for c in df.columns)).dropDuplicates(["_tid", id_col]).select(*df.columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of each document."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
