"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. The vector of a letter n-gram
binds the vectors of its letters (a product), each rotated by its place. A text
is the bundle (sum) of the vectors of its n-grams, a run of other characters
counting as one space; a language's prototype is the bundle of the unit vectors
of its texts. A text has the language whose prototype has the largest cosine
with it, and that cosine (0 if negative) as its score.

The bundle of a text is computed from the counts of its distinct n-grams, the
vectors of which a task keeps (``KEPT`` of them; beyond that it begins anew). a-z have vectors of their own; all other letters
share ``OTHER`` vectors by code point, so neighbouring letters of an alphabet
differ.

Training reads about ``TRAIN_DOCS`` texts of each language (a bounded sample, by a
hash of id and text; rows alike in both count once, so neither null nor repeated
ids enlarge it), sums integers and so gives the same prototypes however the
rows are partitioned. A text that is null or has no letter is ``und`` with score
0; a table without labelled rows gives ``und`` for all. Ties go to the language
first in order. Repeated rows repeat, an empty table gives an empty result,
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import bucket_of, chunks, table, text_or_empty

N_DIMS = 512
OTHER = 101
N_CLASSES = 128
#: Vectors of n-grams that a task keeps.
KEPT = 32_768
#: N-grams that are summed at a time.
PART = 4096
TRAIN_DOCS = 4000
UNKNOWN = "und"
_SCALE = 1 << 20


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point: 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + c % OTHER if c > 127 else c - 64
    return out


class Grams:
    """The vectors of the n-grams met so far."""

    def __init__(self, dims: int = N_DIMS, seed: int = 20240501):
        self.letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (N_CLASSES, dims))
        self.row = np.full(N_CLASSES**3, -1, np.int32)
        self.vectors = np.zeros((1024, dims), np.int8)
        self.known = 0

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """The row of each of these distinct n-grams, at most PART."""
        if self.known + np.count_nonzero(self.row[grams] < 0) > KEPT:
            self.row.fill(-1)
            self.known = 0
        if len(new := grams[self.row[grams] < 0]):
            a, b, c = new // N_CLASSES**2, new // N_CLASSES % N_CLASSES, new % N_CLASSES
            made = np.roll(self.letters[a], 2, axis=1) * np.roll(self.letters[b], 1, axis=1) * self.letters[c]
            while self.known + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            self.vectors[self.known : self.known + len(new)] = made
            self.row[new] = np.arange(self.known, self.known + len(new))
            self.known += len(new)
        return self.row[grams]

    def bundle(self, text: str) -> np.ndarray | None:
        """The sum of the vectors of a text's n-grams; None without a letter."""
        kinds = _classes()[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
        if not kinds.any():
            return None
        kinds = np.concatenate([[0], kinds, [0]]).astype(np.int32)
        kinds = kinds[np.concatenate([[True], (kinds[1:] != 0) | (kinds[:-1] != 0)])]
        grams = (kinds[:-2] * N_CLASSES + kinds[1:-1]) * N_CLASSES + kinds[2:]
        grams, count = np.unique(grams, return_counts=True)
        total = np.zeros(self.vectors.shape[1], np.float32)
        for at in range(0, len(grams), PART):
            rows = self.rows(grams[at : at + PART])
            total += count[at : at + PART].astype(np.float32) @ self.vectors[rows].astype(np.float32)
        return total


@lru_cache(maxsize=2)
def _grams(dims: int) -> Grams:
    return Grams(dims)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS, dims: int = N_DIMS) -> dict[str, np.ndarray]:
    """A prototype of unit length for each language of the labelled rows."""
    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(df[text_col]).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    counts = rows.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return {}
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, most / r["count"]))))
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text")).where(F.pmod("key", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    sample = keyed.groupBy("key", "lang").agg(F.first("text").alias("text")).repartition(16, "key").select("key", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part, texts in chunks(batches):
            for text, lang in zip(texts, part.column(2).to_pylist(), strict=True):
                if (v := _grams(dims).bundle(text)) is not None:
                    unit = np.rint(v.astype(np.float64) * (_SCALE / max(np.linalg.norm(v), 1e-9))).astype(np.int64)
                    sums[lang] = sums[lang] + unit if lang in sums else unit
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "sum"])

    total: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(run, "lang string, sum binary").collect():  # 16 for each language at most
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["sum"], np.int64)
    return {k: v / max(np.linalg.norm(v), 1.0) for k, v in sorted(total.items())}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score of each row, and the columns of ``keep``."""
    names = [*prototypes]
    matrix = np.array([prototypes[k] for k in names], np.float32) if names else None
    dims = matrix.shape[1] if names else N_DIMS
    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(df[text_col]).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            langs, scores = [], []
            for text in texts:
                v = _grams(dims).bundle(text) if names else None
                if v is None or not (length := float(np.linalg.norm(v))):
                    langs.append(UNKNOWN if v is None else names[0])
                    scores.append(0.0)
                    continue
                cosines = matrix @ v / length
                best = int(cosines.argmax())
                langs.append(names[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.record_batch(
                [part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *(part.column(2 + i) for i in range(len(keep)))],
                names=["doc_id", "lang_pred", "score", *keep],
            )
        _grams.cache_clear()  # a worker goes on to other tasks

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}", "lang_pred string", "score double", *(f"`{c}` {kinds[f'keep_{c}']}" for c in keep)]))


def held_out() -> Column:
    return bucket_of("doc_id", 4) == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each whole document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    prototypes = train(docs.where(~held_out()))
    return predict(docs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
