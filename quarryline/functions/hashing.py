"""Identifiers and hashed bag-of-words embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.sets import dot

# Fixed values of the rolling hash.
SEED, PRIME, BITS = 2166136261, 16777619, 2**32


def fragment_id(url: Column, heading: Column, content: Column) -> Column:
    return F.md5(F.concat(*(F.coalesce(c, F.lit("")) for c in (url, heading, content))))


def token_bucket(token: Column, buckets: int = 256) -> Column:
    """The hash bucket of a token.

    The state is xored with each character as a signed 32-bit number and
    multiplied in double precision, so the low bits of large products are lost
    as they are in the stored embeddings.
    """

    def step(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(F.ascii(c).cast("long"))
        x = F.when(x >= 2**31, x - BITS).otherwise(x)
        return F.pmod((x.cast("double") * float(PRIME)).cast("long"), F.lit(BITS))

    return F.pmod(F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), F.lit(SEED).cast("long"), step), F.lit(buckets)).cast("int")


def embedding(toks: Column, buckets: int = 256) -> Column:
    """Token counts by bucket, scaled to length 1 (all zero without tokens)."""
    hashed = F.transform(toks, lambda t: token_bucket(t, buckets))
    counts = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter(hashed, lambda h: h == b)).cast("double"))
    return F.transform(counts, lambda x: x / F.greatest(F.sqrt(dot(counts, counts)), F.lit(1.0)))


def bucket_counts(df: DataFrame, key: str, toks: str, buckets: int = 256) -> DataFrame:
    """key, bucket and n, aggregated; each distinct token of a key is hashed once."""
    each = df.select(key, F.explode(toks).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    return each.groupBy(key, token_bucket(F.col("token"), buckets).alias("bucket")).agg(F.sum("n").alias("n"))


def embeddings(df: DataFrame, key: str, toks: str, buckets: int = 256) -> DataFrame:
    """key and embedding, from aggregated counts."""
    counts = bucket_counts(df, key, toks, buckets).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("n").cast("double")))).alias("m"), F.sum(F.col("n") * F.col("n")).alias("s"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)) / F.sqrt("s"))
    return counts.select(key, dense.alias("embedding"))
