"""Integrity checks of schemas and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def schema_frame(df: DataFrame) -> DataFrame:
    """name and type of the columns."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "name string, type string")


def schema_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """name and status (missing, mismatched or extra) of columns (name, type) that differ."""
    e, a = expected.select("name", F.col("type").alias("expected")), actual.select("name", F.col("type").alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("expected") != F.col("actual"), "mismatched")
    return e.join(a, "name", "full_outer").withColumn("status", status).where("status is not null").select("name", "expected", "actual", "status")


def duplicates(df: DataFrame, value: str, owner: str) -> DataFrame:
    """Values with several owners."""
    return df.groupBy(value).agg(F.sort_array(F.collect_set(owner)).alias("owners")).where(F.size("owners") > 1)


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def missing_references(df: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not a known key."""
    return df.where(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def synonym_is_verb(verbs: DataFrame) -> DataFrame:
    """Synonyms (id, synonyms) that are also the id of another verb."""
    each = verbs.select("id", F.explode("synonyms").alias("synonym"))
    return each.join(verbs.select(F.col("id").alias("synonym")), "synonym", "left_semi").where("synonym <> id")


def evolved(old: StructType, new: StructType) -> StructType:
    """The old columns and those of new that it has not."""
    return StructType([*old.fields, *(f for f in new.fields if f.name not in old.fieldNames())])
