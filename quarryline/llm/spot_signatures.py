"""Document fingerprints by spot signatures, in DataFrame functions only.

A spot is an anchor (a very common word); its signature is the anchor and the
two content words that follow it, anchors between them left out. Of anchors in
a row the last counts. Each text also has a signature for each pair of adjacent words,
with a mark before the first and one after the last. So texts of all lengths, and with many or
few anchors, have the same kinds of signatures, and a small edit changes few of them. A
text without a letter or digit has one for each three characters, or, shorter than that, for its
whole self. A signature that a text repeats counts as often: its k-th
occurrence is an element of its own. The set of the elements' hashes, in
order, is the fingerprint; likeness is the Jaccard of two sets (1 of two
empty ones: only empty texts have none).

Near-duplicates are searched by length: sets whose sizes differ by more than
the threshold allows are never compared. A set lies in one class of size and
probes it and the next one; within a class it meets only sets that share one of
its rarest signatures (as many as a similarity at the threshold must share one of),
and each pair met is compared once, exactly. Equal sets are collapsed before that.

The next document (in order of id, then text; after the last the first) is
found within ranges of ids that hold about ``RANGE_DOCS`` documents each, and across
ranges from their first rows, so no task sees the whole order. A null id comes
last, a null text is empty; repeated rows are documents of their own; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import documents, table

#: Common words of the languages that the corpus has.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "of", "on", "or", "she", "that", "the", "there", "this", "to", "was", "with",
    "als", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "im", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "avec", "dans", "de", "du", "elle", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "un", "une",
    "al", "con", "del", "el", "las", "los", "no", "para", "por", "se", "su", "y",
)
RANGE_DOCS = 1024
#: The driver holds a number for each range; beyond so many ranges, ranges hold more documents and sort with spills.
MOST_RANGES = 16_384

#: No group repeats without being possessive: Java's matcher would recurse once for each repetition.
_EQUAL = "([0-9A-F]{8})(?: \\1)*+"
_GRAM = "(?s)(?=(...))"


def with_signatures(df: DataFrame, text_col: str = "text", out: str = "hashes") -> DataFrame:
    """df with the hashes of the text's signatures (64-bit numbers from 2 ** 31 to 2 ** 32), distinct and in order.

    The steps are columns of their own, so that each is computed once.
    """
    text, names = F.col(text_col), [f"_{out}_{k}" for k in ("words", "steps", "content", "sorted", "runs")]
    words, steps, content, ordered, runs = map(F.col, names)
    df = df.withColumn(names[0], F.concat(F.array(F.lit("^")), F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), F.array(F.lit("$"))))
    # Each word with the one before it.
    last = F.size(words) - 1
    df = df.withColumn(names[1], F.zip_with(F.slice(words, F.lit(1), last), F.slice(words, F.lit(2), last), lambda a, b: F.struct(a.alias("before"), b.alias("word"))))
    df = df.withColumn(names[2], F.filter(steps, lambda s: ~s["word"].isin(*ANCHORS)))
    pairs = F.transform(steps, lambda s: _high(F.hash(s["before"], s["word"])))
    # A content word right after an anchor, and the next content word.
    chain = lambda s, t: F.when(s["before"].isin(*ANCHORS) & (t["word"] != "$"), _high(F.hash(s["before"], s["word"], t["word"])))
    spots = F.filter(F.zip_with(content, F.slice(content, F.lit(2), F.size(content)), chain), lambda h: h.isNotNull())
    one = lambda s: _high(F.hash(s))
    wordless = F.when(F.char_length(text) < 3, F.array(one(text))).otherwise(F.transform(F.regexp_extract_all(F.lower(text), F.lit(_GRAM), 1), one))
    hashed = F.when(text == "", F.array().cast("array<bigint>")).when(last == 1, wordless).otherwise(F.concat(spots, pairs))
    df = df.withColumn(names[3], F.sort_array(hashed))
    # Equal ones stand together: the first keeps its hash, the k-th gets one of its own.
    repeats = F.filter(ordered, lambda h, i: h == F.get(ordered, i - 1))
    digits = F.array_join(F.transform(repeats, F.hex), " ")
    df = df.withColumn(names[4], F.regexp_extract_all(digits, F.lit(_EQUAL), 0))
    numbered = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), ((F.length(r) + 1) / 9).cast("int")), lambda k: _high(F.hash(F.substring(r, 1, 8), k)))))
    return df.withColumn(out, F.when(F.size(runs) == 0, ordered).otherwise(F.sort_array(F.array_distinct(F.concat(ordered, numbered))))).drop(*names)


def _high(h: Column) -> Column:
    """31 bits of a hash below a one, so that all have eight hexadecimal digits."""
    return h.cast("long").bitwiseAND(0x7FFFFFFF) + F.lit(0x80000000)


def fingerprint(hashes: Column) -> Column:
    """The set as text, eight hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(hashes, F.hex), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets of hashes."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / F.greatest(union, F.lit(1)))


def _cuts_below(col: str, cuts: list[int]) -> Column:
    """How many of the cuts, in order, the column reaches: first among the heads of about as many groups as a group has cuts."""
    step = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    reached = lambda several: F.size(F.filter(several, lambda c: c <= F.col(col)))
    heads = reached(F.array(*(F.lit(g[0]) for g in groups)))
    inner = F.get(F.array(*(F.lit(g) for g in groups)), heads - 1)
    return F.when(heads == 0, 0).otherwise((heads - 1) * step + reached(inner))


def with_next(df: DataFrame, made: Callable[[DataFrame], DataFrame], columns: tuple[str, ...], range_docs: int = RANGE_DOCS) -> DataFrame:
    """doc_id, text, the columns that ``made`` adds and, as next_*, text and those of the next row in order of id."""
    n = df.count()
    p = max(1, min(MOST_RANGES, -(-n // range_docs)))
    cuts = df.select(F.percentile_approx("doc_id", [k / p for k in range(1, p)], max(10_000, 20 * p)).alias("c")).first()["c"] if p > 1 and n else None
    place = _cuts_below("doc_id", sorted(set(cuts))) if cuts else F.lit(0)
    placed = df.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(p + 1)).otherwise(place))
    names = ["text", *columns]
    full = made(placed.repartition("range"))
    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_last(), "text")
    full = full.withColumn("next", F.lead(F.struct(*names)).over(order))
    # At most MOST_RANGES + 1 first rows, each with the next range's beside it.
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text")
    firsts = placed.groupBy("range").agg(F.min(key).alias("first")).select("range", F.col("first.text").alias("text"))
    firsts = made(firsts)
    every = Window.orderBy("range")
    first = F.struct(*names)
    follows = firsts.select("range", F.coalesce(F.lead(first).over(every), F.first(first).over(every)).alias("follow"))
    return full.join(follows.hint("shuffle_hash"), "range", "left").select("doc_id", *names, *(F.coalesce(F.col("next"), F.col("follow"))[k].alias(f"next_{k}") for k in names))


def near_duplicates(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (a, b, likeness) of set representatives at the threshold or above; a < b.

    The representative of equal sets is their smallest id: ``members`` gives it
    for each document. Empty texts take no part.
    """
    sets = members(df, id_col, text_col).where(F.size("hashes") > 0).groupBy("hashes").agg(F.min("doc_id").alias("rep"))
    step = math.log(1 / threshold)
    sized = sets.withColumn("n", F.size("hashes")).withColumn("class", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    flat = sized.select("rep", "n", "class", F.explode("hashes").alias("h"))
    often = flat.groupBy("h").agg(F.count("*").alias("df"))
    ranked = flat.join(often, "h").groupBy("rep", "n", "class").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("rare"))
    # Sets of n hashes that reach the threshold share one of the n - ceil(threshold n) + 1 rarest of each.
    rarest = F.slice("rare", 1, F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1)
    keys = ranked.select("rep", "n", "class", F.explode(F.transform(rarest, lambda r: r["h"])).alias("h"))
    probes = keys.withColumn("class", F.explode(F.array(F.col("class"), F.col("class") + 1)))
    a, b = probes.alias("a"), keys.alias("b")
    fits = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.rep") < F.col("b.rep")))
    met = a.join(b, ["h", "class"]).where(fits & (F.col("a.n") >= threshold * F.col("b.n"))).select(F.col("a.rep").alias("x"), F.col("b.rep").alias("y")).distinct()
    left, right = (sets.select(F.col("rep").alias(k), F.col("hashes").alias(f"h_{k}")) for k in ("x", "y"))
    compared = met.join(left, "x").join(right, "y").withColumn("likeness", likeness(F.col("h_x"), F.col("h_y"))).where(F.col("likeness") >= threshold)
    return compared.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")


def members(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and hashes of each row."""
    return with_signatures(documents(df, id_col, text_col)).select("doc_id", "hashes")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document."""
    rows = with_next(documents(table(spark, sf_dir, "documents")), with_signatures, ("hashes",))
    n = F.char_length("text")
    tail = F.floor(n / 4).cast("int")
    edited = rows.select("doc_id", n.cast("long").alias("n_chars"), "hashes", "next_hashes", F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next_text", F.lit(1), tail)).alias("edited"))
    edited = with_signatures(edited, "edited", "edited_hashes")
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("hashes")).alias("fingerprint"),
        fingerprint(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
