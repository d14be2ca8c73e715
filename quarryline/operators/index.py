"""A persistent inverted index: full-text search without a scan of the texts.

The index is a folder of Parquet tables, written in segments:

    postings/segment=/bucket=   token, field, key, positions; sorted by token in each bucket of tokens
    tokens/segment=             token, field, bucket, df: the vocabulary, sorted by token
    heads/segment=/bucket=      variant, head: what is left of the first letters of tokens without one or two of them
    keys/segment=               the keys that a segment has anew or has removed
    commits/segment=,base=      markers, written last: what is not committed, or lies before the last base, is not read

A search looks up the query's words in the vocabulary (equal, by prefix as a range of
the sorted tokens, within some typos by shared variants of first letters), and then reads only
the buckets of the tokens found; scores are those of ``search.matches``. A bucket that is
too large for a task is split when it is written, so no token is too common.

A segment's rows take the place of earlier ones with the same key. A batch that runs
again under its number writes the same segment again. ``compact`` folds the live
postings of all segments into one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators.search import words_of
from quarryline.sources.shared import cut, names, remove, write_marker

#: Letters of a token whose deletions are kept, and how many of them may go. Tokens
#: within so many typos share a variant of their first letters.
EDIT_PREFIX, EDITS = 8, 2
EXACT, PREFIX, TYPO = 1.0, 0.75, 0.5
#: Tokens named in the scan's own filter; more are left to the join.
NAMED_TOKENS = 200


def allowed_typos(token: str, most: int) -> int:
    """One from four letters, two from seven."""
    return min(most, 0 if len(token) < 4 else 1 if len(token) < 7 else 2)


def variants(word: str, most: int = EDITS) -> set[str]:
    """The first letters of a word, and what is left without up to so many of them."""
    level = {word[:EDIT_PREFIX]}
    found = set(level)
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        found |= level
    return found


#: Which letters go (from 1; beyond the prefix: none), for up to two deletions.
_NONE = EDIT_PREFIX + 1
_DELETIONS = [(_NONE, _NONE), *((i, _NONE) for i in range(1, EDIT_PREFIX + 1)), *combinations(range(1, EDIT_PREFIX + 1), 2)]


def _edits(tokens: DataFrame) -> DataFrame:
    """head and variant, once for all tokens(token) that begin with the same letters: there are far fewer heads than tokens, and the more texts, the fewer new ones."""
    heads = tokens.select(F.substring("token", 1, EDIT_PREFIX).alias("head")).distinct()
    each = heads.select("head", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _DELETIONS))).alias("d"))
    there = lambda c: (F.col(c) == _NONE) | (F.col(c) <= F.length("head"))
    part = lambda a, n: F.substring(F.col("head"), a, n)
    i, j = F.col("d.i"), F.col("d.j")
    variant = F.concat(part(F.lit(1), i - 1), part(i + 1, F.greatest(j - i - 1, F.lit(0))), part(j + 1, F.lit(EDIT_PREFIX)))
    return each.where(there("d.i") & there("d.j")).select("head", variant.alias("variant"))


def _with_positions(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, token and positions: each token of a row once; a row's tokens are sorted and cut into runs, without a shuffle."""
    sorted_ = rows.select(key, F.sort_array(F.transform(T.tokens(F.col(column), False), lambda t, i: F.struct(t.alias("t"), i.alias("i")))).alias("s"))
    first = lambda x, k: F.when((k == 0) | (F.get(F.col("s"), k - 1)["t"] != x["t"]), k)
    starts = sorted_.select(key, "s", F.array_compact(F.transform("s", first)).alias("b"))
    run = lambda b, n: F.slice("s", b + 1, F.coalesce(F.get(F.col("b"), n + 1), F.size("s")) - b)
    each = starts.select(key, F.explode(F.transform("b", lambda b, n: F.struct(F.get(F.col("s"), b)["t"].alias("token"), F.transform(run(b, n), lambda y: y["i"]).alias("positions")))).alias("x"))
    return each.select(key, "x.token", "x.positions")


@dataclass(frozen=True)
class Index:
    """A folder, the key of its rows and its type, the text columns (weightier ones first) and the number of token buckets."""

    spark: SparkSession = field(repr=False)
    path: str
    key: str
    columns: tuple[str, ...]
    kind: str = "long"
    buckets: int = 64

    # Writing

    def add(self, rows: DataFrame, segment: int | None = None) -> int:
        """Puts rows in, in place of those with the same keys; each key stands once in rows. Returns the segment."""
        n = self._next() if segment is None else segment
        self._write_keys(rows.select(self.key), n)
        each = [_with_positions(rows, self.key, c).select(self._bucket("token").alias("bucket"), "token", F.lit(i).alias("field"), self.key, "positions") for i, c in enumerate(self.columns)]
        self._write(reduce(DataFrame.unionByName, each), n)
        return self._commit(n, min([n, *self._segments()]))

    def drop(self, keys: DataFrame, segment: int | None = None) -> int:
        """Takes the rows of these keys out."""
        n = self._next() if segment is None else segment
        self._write_keys(keys.select(self.key), n)
        return self._commit(n, min([n, *self._segments()]))

    def compact(self) -> int:
        """One segment of all that is live; the earlier ones go."""
        earlier, n = self._segments(), self._next()
        if not earlier:
            raise ValueError(f"nothing is indexed in {self.path}")
        self._write(self._live(self._read("postings")).drop("segment"), n)
        self._write_keys(self._live(self._read("keys")).where(F.lit(False)).select(self.key), n)
        self._commit(n, n)
        for old in earlier:
            self._forget(old)
            for name in ("postings", "tokens", "heads", "keys"):
                remove(self.spark, f"{self.path}/{name}/segment={old:09d}")
        return n

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _write(self, postings: DataFrame, n: int) -> None:
        where = lambda name: f"{self.path}/{name}/segment={n:09d}"
        # Spark splits what is too large and joins what is small.
        postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", self.key).write.mode("overwrite").partitionBy("bucket").parquet(where("postings"))
        written = self.spark.read.schema(postings.schema).parquet(where("postings"))
        counts = written.groupBy("token", "field", "bucket").agg(F.count("*").alias("df"))
        counts.orderBy("token").write.mode("overwrite").parquet(where("tokens"))
        edits = _edits(self.spark.read.parquet(where("tokens"))).withColumn("bucket", self._bucket("variant"))
        edits.hint("rebalance", "bucket").sortWithinPartitions("bucket", "variant").write.mode("overwrite").partitionBy("bucket").parquet(where("heads"))

    def _write_keys(self, keys: DataFrame, n: int) -> None:
        keys.distinct().write.mode("overwrite").parquet(f"{self.path}/keys/segment={n:09d}")

    def _commit(self, n: int, base: int) -> int:
        """A marker that segments from base up to n count."""
        self._forget(n)
        write_marker(self.spark, f"{self.path}/commits/segment={n:09d},base={base:09d}")
        return n

    def _forget(self, n: int) -> None:
        for name in names(self.spark, f"{self.path}/commits"):
            if name.startswith(f"segment={n:09d},"):
                remove(self.spark, f"{self.path}/commits/{name}")

    # Reading

    def _segments(self) -> list[int]:
        """The numbers of the committed segments that count."""
        found = [[int(x.partition("=")[2]) for x in name.split(",")] for name in names(self.spark, f"{self.path}/commits") if name.startswith("segment=")]
        return [n for n, _ in found if n >= max(base for _, base in found)]

    def _next(self) -> int:
        return max(self._segments(), default=-1) + 1

    def _read(self, name: str, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """A table of the committed segments, of these buckets only; None where nothing is."""
        there = set(names(self.spark, f"{self.path}/{name}"))
        paths = [f"{self.path}/{name}/segment={n:09d}" for n in self._segments() if f"segment={n:09d}" in there]
        if buckets is not None:
            paths = [f"{p}/{b}" for p in paths for b in names(self.spark, p) if b in {f"bucket={k}" for k in buckets}]
        return self.spark.read.schema(self._schema(name)).option("basePath", f"{self.path}/{name}").parquet(*paths) if paths else None

    def _schema(self, name: str) -> str:
        """Given to the reader, so that it opens no file for it and empty tables have it too."""
        kept = {"tokens": "token string, field int, bucket int, df long", "heads": "head string, variant string, bucket int"}
        return kept.get(name, f"{self.key} {self.kind}" + ", token string, field int, positions array<int>, bucket int" * (name == "postings")) + ", segment int"

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (key, segment) that no later segment has anew or has removed."""
        segments = self._segments()
        if len(segments) < 2:
            return rows
        later = self._read("keys").where(F.col("segment") > min(segments)).groupBy(self.key).agg(F.max("segment").alias("_last"))
        return rows.join(later, self.key, "left").where(F.col("_last").isNull() | (F.col("segment") >= F.col("_last"))).drop("_last")

    def tokens_of(self, wanted: Sequence[str], typos: int = 2, prefix: bool = True) -> DataFrame:
        """term, token, bucket and q: the indexed tokens that each word stands for."""
        if (vocabulary := self._read("tokens")) is None:
            raise ValueError(f"nothing is indexed in {self.path}")
        found = []
        for i, word in enumerate(wanted):
            at = lambda df, q, i=i: df.select(F.lit(i).alias("term"), "token", self._bucket("token").alias("bucket"), F.lit(q).alias("q"))
            found.append(at(vocabulary.where(F.col("token") == word), EXACT))
            if prefix and i == len(wanted) - 1:
                found.append(at(vocabulary.where(F.startswith("token", F.lit(word))), PREFIX))
            if most := allowed_typos(word, typos):
                shared = sorted(variants(word, most))
                where = self.spark.sql("SELECT 1").select(F.explode(F.array(*map(F.lit, shared))).alias("v")).select(self._bucket("v")).distinct().collect()
                near = self._read("heads", [r[0] for r in where])
                if near is not None:
                    heads = near.where(F.col("variant").isin(shared)).select("head")
                    begun = vocabulary.join(heads, F.substring("token", 1, EDIT_PREFIX) == F.col("head"), "left_semi")
                    found.append(at(begun.where(F.levenshtein("token", F.lit(word), most) >= 0), TYPO))
        return reduce(DataFrame.unionByName, found).groupBy("term", "token", "bucket").agg(F.max("q").alias("q"))

    def postings_of(self, matched: DataFrame) -> DataFrame:
        """The live postings of tokens, from their buckets alone. matched is a checkpoint."""
        buckets = [r[0] for r in matched.select("bucket").distinct().collect()]  # at most as many as the index has
        postings = self._read("postings", buckets)
        if postings is None:  # no token was found
            postings = self._read("postings").where(F.lit(False))
        few = [r[0] for r in matched.select("token").distinct().limit(NAMED_TOKENS + 1).collect()]
        if len(few) <= NAMED_TOKENS:
            postings = postings.where(F.col("token").isin(few))
        return self._live(postings.join(matched.drop("bucket"), "token"))

    def _contribution(self) -> Column:
        n = len(self.columns)
        return F.col("q") * (F.lit(float(n)) - F.col("field")) / F.lit(float(n))

    def matches(self, query: str, typos: int = 2, prefix: bool = True) -> DataFrame:
        """The key and text_match of the rows in which each word matches, as ``search.matches`` gives them."""
        wanted = words_of(query)
        if not wanted:
            raise ValueError("a query needs a word")
        return self._scored(self.postings_of(cut(self.tokens_of(wanted, typos, prefix))), len(wanted))

    def _scored(self, postings: DataFrame, terms: int) -> DataFrame:
        best = postings.groupBy(self.key, "term").agg(F.max(self._contribution()).alias("s"))
        return best.groupBy(self.key).agg(F.sum("s").alias("text_match"), F.count("*").alias("n")).where(F.col("n") == terms).select(self.key, "text_match")

    def top(self, query: str, k: int, typos: int = 2, prefix: bool = True) -> DataFrame:
        """The k best of matches, ties to smaller keys, reading as few postings as the bounds allow.

        What a token adds in a column is known before its postings are read. Tokens
        that add most are read first; a row that lacks one of them for some word can reach at most
        the other words' best and the best that was not read. Once the k-th score is above
        that, the rest is not read.
        """
        wanted = words_of(query)
        if not wanted:
            raise ValueError("a query needs a word")
        matched = cut(self.tokens_of(wanted, typos, prefix))
        fields = self._read("tokens").select("token", "field").distinct()
        steps = matched.join(fields, "token").select("term", self._contribution().alias("c")).distinct().collect()  # words x columns x 3
        levels = sorted({r.c for r in steps}, reverse=True)
        ceiling = [max((r.c for r in steps if r.term == t), default=None) for t in range(len(wanted))]
        rows: list = []
        if None not in ceiling:
            for at, level in enumerate(levels):
                read = matched.where(F.col("q") >= level)  # a column weighs at most 1
                hits = self._scored(self.postings_of(read).where(self._contribution() >= level), len(wanted))
                rows = hits.orderBy(F.desc("text_match"), F.asc(self.key)).limit(k).collect()
                rest = levels[at + 1] if at + 1 < len(levels) else None
                if rest is None or (len(rows) == k and rows[-1]["text_match"] > max(sum(ceiling) - c + min(c, rest) for c in ceiling)):
                    break
        return self.spark.createDataFrame([tuple(r) for r in rows], f"{self.key} {self.kind}, text_match double")

    def phrase(self, query: str) -> DataFrame:
        """The key and the number of places (in any column) where the words stand side by side, in order."""
        wanted = words_of(query)
        if not wanted:
            raise ValueError("a phrase needs a word")
        places = self.postings_of(cut(self.tokens_of(wanted, 0, False)))
        starts = places.select(self.key, "field", "term", F.transform("positions", lambda p: p - F.col("term")).alias("starts"))
        met = starts.groupBy(self.key, "field").agg(F.collect_list("starts").alias("s")).where(F.size("s") == len(wanted))
        both = F.aggregate(F.slice("s", 2, len(wanted)), F.col("s")[0], lambda a, b: F.array_intersect(a, b)) if len(wanted) > 1 else F.col("s")[0]
        return met.select(self.key, F.size(both).alias("n")).where("n > 0").groupBy(self.key).agg(F.sum("n").alias("places"))
