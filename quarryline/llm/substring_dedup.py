"""Removal of repeated passages by super-k-mers.

A window is ``window`` consecutive words of one document; a window that also
starts in a document with a smaller id is repeated, and each word that a
repeated window covers is removed. The copy in the smallest id stays.

The minimiser of a window is the smallest hash of its runs of ``MINIMISER`` words.
Consecutive windows with the same minimiser make a super-k-mer and travel as
one packed string of words. Equal windows have equal minimisers, so:

1. Each document gives its minimisers, as numbers. Those of one document only
   cannot head a repeated window; a count drops them.
2. For the super-k-mers that are left, documents pack the words, and a packed
   string goes to the bucket of its minimiser.
3. A bucket collapses equal strings and sorts the windows of different ones: in
   each run of equal windows the smallest id keeps its copy, and strings with
   larger ids get the spans of their repeated windows.
4. Minimisers with more than ``FEW`` super-k-mers (passages in very many documents)
   have no bucket. Each task sends each of their strings once, with its smallest
   id; windows of the distinct strings are aggregated to their smallest id before
   the shuffle, under 128-bit digests, and each occurrence of a string looks up
   its windows. So a hot passage costs rows that are spread over all tasks.
5. Spans go back to their documents, which cut the words.

Words are compared, not hashes of them, but for the digests of hot windows.

A null text has no words. Documents with equal ids do not remove from each
other; a null id counts as larger than all. Repeated rows are treated alike. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import chunks, cut, slices, table, text_or_empty

WINDOW = 50
#: Words in a minimiser.
MINIMISER = 8
#: Super-k-mers of a minimiser up to which one task takes them.
FEW = 400

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BREAKS = str.maketrans("\t\n\x0b\x0c\r", "     ")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return [w for w in text.translate(_BREAKS).split(" ") if w] if text else []


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2 ** 64, and of its inverse."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 2**64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_BYTES = np.random.default_rng(50).integers(1, 2**63, 256).astype(np.uint64)
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[[0x20, *range(0x09, 0x0E)]] = True


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word of a string column, in order, from its UTF-8 bytes.

    A word's hash is a polynomial in its bytes: the difference of two running
    sums, shifted to the word's start.
    """
    empty = np.empty(0, np.uint64), np.empty(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return empty
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    inside = ~_IS_BREAK[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    up, down = powers(1 << max(20, len(data).bit_length()))
    sums = np.cumsum(_BYTES[data] * up[: len(data)])
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return _mixed((sums[ends] - before) * down[starts]), np.searchsorted(offsets, starts, side="right") - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _super_kmers(hashes: np.ndarray, doc: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first window, number of windows, minimiser) of each super-k-mer of documents that stand one after another."""
    span, n = window - size + 1, len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        grams = grams * _MIX + hashes[k : len(hashes) - size + 1 + k]
    low, width = _mixed(grams), 1
    while width * 2 <= span:  # the smallest of twice as many runs
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n])
    inside = doc[:n] == doc[window - 1 :]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | (low[1:] != low[:-1]) | (doc[1:n] != doc[: n - 1])
    first = np.flatnonzero(starts)
    ends = np.flatnonzero(inside & np.concatenate([~inside[1:] | starts[1:], [True]]))
    return first, ends - first + 1, low[first].view(np.int64)


def _sketch(column: pa.Array, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, number of windows, minimiser) of each super-k-mer."""
    hashes, doc = _word_hashes(column)
    first, n, mini = _super_kmers(hashes, doc, window, size)
    lengths = np.bincount(doc, minlength=len(column))
    row = doc[first]
    return row, first - (np.cumsum(lengths) - lengths)[row], n, mini


def _merged(repeated: np.ndarray, start: int, window: int) -> Iterator[tuple[int, int]]:
    """The word spans of runs of repeated windows."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], repeated, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        yield start + a, start + b - 1 + window


def _windows(packed: str, window: int) -> list[str]:
    words = packed.split(" ")
    return [" ".join(words[k : k + window]) for k in range(len(words) - window + 1)]


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _bucket(strings: list[tuple[str, int]], window: int) -> dict[str, np.ndarray]:
    """The smallest id of each window, for each distinct string of a minimiser."""
    smallest: dict[str, int] = {}
    for packed, id_ in strings:
        if smallest.get(packed, id_) >= id_:
            smallest[packed] = id_
    if len(smallest) == 1:
        return {packed: np.array([id_]) for packed, id_ in smallest.items()}  # for all its windows
    order = list(smallest)
    windows = [(w, smallest[packed], i, k) for i, packed in enumerate(order) for k, w in enumerate(_windows(packed, window))]
    windows.sort()
    low = [np.empty(len(p.split(" ")) - window + 1, np.int64) for p in order]
    last, least = None, 0
    for w, id_, i, k in windows:
        if w != last:
            last, least = w, id_
        low[i][k] = least
    return dict(zip(order, low, strict=True))


_OUT = "id long, key long, start int, stop int, sid binary, words string"
_ARROW_OUT = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("sid", pa.binary()), ("words", pa.string())])


def repeated_spans(df: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, few: int = FEW) -> DataFrame:
    """id, key and spans (array of start and stop, in words; not merged) of the rows of df (id, key, text) with repeated windows.

    id and key name a row together; rows alike in both are alike.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=2, most=1_000_000):
            row, start, n, mini = _sketch(part.column(2), window, minimiser)
            at = pa.array(row)
            yield pa.record_batch([part.column(0).take(at), part.column(1).take(at), pa.array(mini), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["id", "key", "mini", "start", "n"])

    heads = df.mapInArrow(sketch, "id long, key long, mini long, start int, n int")
    shared = heads.groupBy("mini").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("rows")).where("low < high")
    kept = heads.join(shared.select("mini", (F.col("rows") > few).alias("hot")), "mini")
    # A set: repeated rows have the same heads.
    kept = kept.groupBy("id", "key").agg(F.collect_set(F.struct("mini", "start", "n", "hot")).alias("heads"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        for part, texts in chunks(batches, text=2, most=500_000):
            row, mini, start, sids, packed = [], [], [], [], []
            for i, (text, id_, heads) in enumerate(zip(texts, part.column(0).to_pylist(), part.column(3).to_pylist(), strict=True)):
                words = words_of(text)
                for h in heads:
                    string, sid = " ".join(words[h["start"] : h["start"] + h["n"] + window - 1]), None
                    if h["hot"]:
                        sid = _digest(string)
                        if sent.get(sid, id_ + 1) <= id_:
                            string = None  # sent before, with an id as small
                        elif len(sent) < 200_000:
                            sent[sid] = id_
                    row.append(i)
                    mini.append(h["mini"])
                    start.append(h["start"])
                    sids.append(sid)
                    packed.append(string)
            at = pa.array(row, pa.int64())
            yield pa.record_batch([part.column(0).take(at), part.column(1).take(at), pa.array(mini, pa.int64()), pa.array(start, pa.int32()), pa.array(sids, pa.binary()), pa.array(packed, pa.string())], names=["id", "key", "mini", "start", "sid", "words"])

    strings = df.join(kept, ["id", "key"]).select("id", "key", "text", "heads").mapInArrow(pack, "id long, key long, mini long, start int, sid binary, words string")
    # Hot strings stay spread; the others meet those of their minimiser.
    route = F.when(F.col("sid").isNull(), F.xxhash64("mini")).otherwise(F.xxhash64("id", "key", "start"))
    routed = strings.withColumn("route", route).repartition("route").sortWithinPartitions("mini")

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []

        def flush() -> Iterator[tuple]:
            low = _bucket([(h[4], h[0]) for h in held], window)
            for id_, key, start, _, packed in held:
                least = low[packed]
                if len(least) == 1:
                    if least[0] < id_:
                        yield id_, key, start, start + packed.count(" ") + 1, None, None
                else:
                    for a, b in _merged(least < id_, start, window):
                        yield id_, key, a, b, None, None

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 6
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _ARROW_OUT.types, strict=True)], schema=_ARROW_OUT)

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for id_, key, mini, start, sid, packed, _ in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if sid is not None:
                        out.append((id_, key, start, None, sid, packed))
                        continue
                    if held and held[0][3] != mini:
                        out.extend(flush())
                        held.clear()
                    held.append((id_, key, start, mini, packed))
                if len(out) > 2000:
                    yield made()
        if held:
            out.extend(flush())
        yield made()

    done = cut(routed.mapInArrow(bucket, _OUT))
    spans = done.where("sid is null").select("id", "key", "start", "stop").union(_hot_spans(done.where("sid is not null"), window))
    return spans.groupBy("id", "key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def _hot_spans(rows: DataFrame, window: int) -> DataFrame:
    """Spans of the occurrences (id, key, start, sid) of strings, of which some rows have the words."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                row, place, digests = [], [], []
                for i, packed in enumerate(part.column(2).to_pylist()):
                    found = [_digest(w) for w in _windows(packed, window)]
                    row += [i] * len(found)
                    place += range(len(found))
                    digests += found
                take = pa.array(row, pa.int64())
                yield pa.record_batch([part.column(0).take(take), part.column(1).take(take), pa.array(place, pa.int32()), pa.array(digests, pa.binary())], names=["sid", "id", "place", "window"])

    distinct = rows.where("words is not null").groupBy("sid").agg(F.min("id").alias("id"), F.first("words").alias("words"))
    windows = distinct.select("sid", "id", "words").mapInArrow(explode, "sid binary, id long, place int, window binary")
    least = windows.groupBy("window").agg(F.min("id").alias("low"))
    known = windows.join(least, "window").groupBy("sid").agg(F.collect_list(F.struct("place", "low")).alias("lows"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[tuple] = []
                for id_, key, start, lows in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    low = np.empty(len(lows), np.int64)
                    for x in lows:
                        low[x["place"]] = x["low"]
                    out += [(id_, key, a, b) for a, b in _merged(low < id_, start, window)]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _ARROW_OUT.types[:4], strict=True)], names=["id", "key", "start", "stop"])

    return rows.select("sid", "id", "key", "start").join(known, "sid").select("id", "key", "start", "lows").mapInArrow(spans, "id long, key long, start int, stop int")


def kept_places(n: int, spans: list[dict] | None) -> list[tuple[int, int]]:
    """The runs of words that no span covers."""
    out, at = [], 0
    for s in sorted((s["start"], s["stop"]) for s in spans or ()):
        if s[0] > at:
            out.append((at, s[0]))
        at = max(at, s[1])
    return [*out, (at, n)] if at < n else out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_words (joined by one space), kept_text and the columns of ``keep``, for each row of df.

    kept_text is the text itself if nothing is removed, else what stood from
    each kept run's first word to the next removed word, as it stood.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(df[text_col]).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(2**63 - 1))).withColumn("key", F.xxhash64("text"))
    spans = repeated_spans(rows.select("id", "key", "text"), window)
    joined = rows.join(spans, ["id", "key"], "left").select("doc_id", "text", "spans", *(f"keep_{c}" for c in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            total, removed, words_kept, texts_kept = [], [], [], []
            for text, spans in zip(texts, part.column(2).to_pylist(), strict=True):
                words = words_of(text)
                total.append(len(words))
                if not spans:
                    removed.append(0)
                    words_kept.append(" ".join(words))
                    texts_kept.append(text)
                    continue
                runs = kept_places(len(words), spans)
                removed.append(len(words) - sum(b - a for a, b in runs))
                words_kept.append(" ".join([w for a, b in runs for w in words[a:b]]))
                at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
                texts_kept.append("".join([text[at[a] : at[b]] for a, b in runs]))
            yield pa.record_batch(
                [part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(words_kept, pa.string()), pa.array(texts_kept, pa.string()), *part.columns[3:]],
                names=["doc_id", "n_words", "n_removed", "kept_words", "kept_text", *keep],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return joined.mapInArrow(run, ", ".join(["doc_id long, n_words long, n_removed long, kept_words string, kept_text string", *(f"`{c}` {kinds[f'keep_{c}']}" for c in keep)]))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole document without the words of windows that documents with smaller ids have."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


#: Words of all texts, windows by their words, and what the windows cover whose words start in an earlier document.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place, len(words) AS n FROM d),
p AS (SELECT doc_id, place, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS digest FROM w WHERE n >= 50),
f AS (SELECT digest, min(doc_id) AS first FROM p WHERE place <= n - 49 GROUP BY digest),
c AS (SELECT DISTINCT doc_id, unnest(range(place, place + 50)) AS place FROM p JOIN f USING (digest) WHERE place <= n - 49 AND doc_id > first),
k AS (SELECT doc_id, count(c.place) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (c.place IS NULL) AS kept FROM w LEFT JOIN c USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
