"""A Merkle manifest of a dataset, with the proof of every row.

Each row is a leaf: the hash of its columns, each written with its length. The
leaves of a group (a language) form a tree in order of id, in which every 8
consecutive nodes of a level become one parent; the roots of the groups form
the tree of the dataset in the same way. A parent keeps its preimage, that is its
children's hashes, 64 characters each, one after the other.

A leaf finds its proof in the preimages of its ancestors, joined from the top down (each
parent hands its path to its children, so only a path for every 8 leaves is
shuffled): what is left of a preimage without the leaf's own slot are the
siblings, and a preimage with another hash in that slot is what a changed leaf
would have given.

Leaves are ordered by ranges of (group, id, hash) and numbered by offsets of the
partitions, so a group of any size is dealt to many tasks; a parent is a group of
at most 8 rows. A tree of n leaves has log8(n) levels, each one job on an eighth of the rows.

A null column is written as ``-``. A null group is a group of its own, the
first; a null id comes first, and is never tampered with by the query. Equal ids are
ordered by their hashes; rows alike in all columns are leaves of their own. A
lone leaf is the root of its group, a lone group that of the dataset; without any
sibling the proof is the hash of the empty text. An empty table gives an empty
result; columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import crc32_sql, cut, in_order, table

FAN = 8
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: A table of offsets (a row for each partition and group that meet) is broadcast only up to so many rows.
FEW_OFFSETS = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<slot:int,preimage:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """``-`` for null, else the byte count of the value as text, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(columns: Sequence[Column]) -> Column:
    return digest(F.concat(*map(field, columns)))


def _numbered(leaves: DataFrame) -> DataFrame:
    """``group, id, hash, ...`` with ``pos`` (from 0 in its group) and ``n`` (leaves of the group)."""
    placed = in_order(leaves, "group", "id", "hash")
    met = cut(placed.groupBy("_part", "group").agg(F.count("*").alias("rows"), F.min("_id").alias("first")))
    whole = Window.partitionBy("group")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = met.select("_part", "group", "first", before.alias("before"), F.sum("rows").over(whole).alias("n"))
    offsets = F.broadcast(offsets) if met.count() <= FEW_OFFSETS else offsets
    return placed.join(offsets, ["_part", "group"]).withColumn("pos", F.col("_id") - F.col("first") + F.col("before")).drop("_part", "_id", "first", "before")


def _parents(nodes: DataFrame, *payload: str) -> DataFrame:
    """``group, k, n`` (nodes of the group below), the children in order, their preimage and its hash (the child's own, if the group has no other)."""
    kids = F.sort_array(F.collect_list(F.struct("pos", "hash", *payload)))
    met = nodes.groupBy("group", F.expr(f"pos div {FAN}").alias("k"), "n").agg(kids.alias("kids"))
    preimage = F.array_join(F.transform("kids", lambda x: x["hash"]), "")
    held = met.withColumn("preimage", preimage)
    return held.withColumn("hash", F.when(F.col("n") > 1, digest(F.col("preimage"))).otherwise(F.col("kids")[0]["hash"]))


#: The nodes of the level above n.
_ABOVE = f"((n + {FAN - 1}) div {FAN})"


def _levels(nodes: DataFrame, *payload: str) -> list[DataFrame]:
    """The parents of each level, from the leaves up to where each group has one node; the first level keeps its leaves."""
    levels = [cut(_parents(nodes, *payload))]
    most = levels[0].agg(F.max("n")).head()[0] or 0
    while (most := -(-most // FAN)) > 1:
        below = levels[-1].where(f"{_ABOVE} > 1").select("group", F.col("k").alias("pos"), "hash", F.expr(_ABOVE).alias("n"))
        levels.append(cut(_parents(below).drop("kids")))
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """group and the hash of its last node."""
    each = [level.where(f"{_ABOVE} = 1").select("group", "hash") for level in levels]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def _with_paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Each leaf (``kid``) with its path: slots and preimages from its parent up to the top of its group, then the top's own path and columns.

    tops: a row for each group with path and more columns.
    """
    more = [c for c in tops.columns if c not in ("group", "path")]
    known = None
    for level in reversed(levels):
        here = level.select("group", "k", "n", "preimage", *(["kids"] if "kids" in level.columns else []))
        found = here.where(f"{_ABOVE} = 1").join(tops, "group")
        if known is not None:
            above = known.select("group", F.col("k").alias("up"), F.col("path").alias("upper"), F.col("preimage").alias("upper_preimage"), *more)
            inner = here.where(f"{_ABOVE} > 1").withColumn("up", F.expr(f"k div {FAN}")).join(above, ["group", "up"])
            step = F.array(F.struct(F.expr(f"cast(k % {FAN} as int)").alias("slot"), F.col("upper_preimage").alias("preimage")))
            found = found.unionByName(inner.withColumn("path", F.concat(step, "upper")).drop("up", "upper", "upper_preimage"))
        known = found
    leaves = known.select("group", "n", "preimage", "path", *more, F.explode("kids").alias("kid"))
    own = F.array(F.struct(F.expr(f"cast(kid.pos % {FAN} as int)").alias("slot"), "preimage"))
    return leaves.withColumn("path", F.when(F.col("n") > 1, F.concat(own, "path")).otherwise(F.col("path"))).drop("n", "preimage")


def siblings(path: Column) -> Column:
    """The hashes beside those of the path, level by level, left to right: each preimage without the path's slot."""
    cut_out = lambda s: F.concat(F.substring(s["preimage"], F.lit(1), s["slot"] * HEX), F.substring(s["preimage"], s["slot"] * HEX + HEX + 1, F.lit(FAN * HEX)))
    return F.array_join(F.transform(path, cut_out), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path: spliced into each preimage in turn."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.overlay(s["preimage"], h, s["slot"] * HEX + 1, F.lit(HEX))))


def manifest(df: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", claimed: Column | None = None) -> DataFrame:
    """For each row its id, leaf, subroot, root, the path of (slot, preimage) up to the root, and the claimed leaf (null without one).

    claimed: the leaf hash that a row claims, over the columns of df; it changes no tree.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null first, else in the order of bytes
    read = df.select(group.alias("group"), F.col(id_col).alias("id"), leaf_hash([F.col(c) for c in columns]).alias("hash"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))
    levels = _levels(_numbered(cut(read)), "id", "claimed")
    # The tree of the groups: one group, whose ids are the groups.
    roots = _levels(_numbered(_tops(levels).select(F.lit("").alias("group"), F.col("group").alias("id"), "hash")), "id")
    root = _tops(roots).select("group", F.array().cast(_PATH).alias("path"), F.col("hash").alias("root"))
    subroots = cut(_with_paths(roots, root).select(F.col("kid.id").alias("group"), "path", F.col("kid.hash").alias("subroot"), "root"))
    return _with_paths(levels, subroots).select(F.col("kid.id").alias(id_col), F.col("kid.hash").alias("leaf"), "subroot", "root", "path", F.col("kid.claimed").alias("claimed"))


def verified(proofs: DataFrame) -> DataFrame:
    """A manifest with proof_sha256, the folded root of the claimed leaf (else the row's own), and whether it is the root."""
    folded = fold(F.coalesce("claimed", "leaf"), F.col("path"))
    return proofs.withColumns({"proof_sha256": digest(siblings(F.col("path"))), "folded_root": folded}).withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents by language, and what proofs say where a text was lower-cased."""
    docs = table(spark, sf_dir, "documents")
    lowered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in COLUMNS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    proofs = manifest(docs, claimed=F.when(tampered, leaf_hash(lowered)))
    return verified(proofs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql(levels: int = 7, upper: int = 3) -> str:
    """DuckDB SQL for the query, for at most 8 ** levels documents of a language and 8 ** upper languages."""

    def row(text: str) -> str:
        value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
        return "sha256(" + " || ".join(value(text if c == "text" else c) for c in COLUMNS) + ")"

    crc = crc32_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")
    parts = [
        f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, {row('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {row(f"translate(text, '{UPPER}', '{LOWER}')")} END AS claimed FROM documents)",
        "t0 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM d)",
    ]

    def climb(name: str, count: int) -> None:
        for i in range(1, count + 1):
            n = "n" if i == 1 else "(n + 7) // 8"
            parts.append(f"{name}{i} AS (SELECT grp, pos // 8 AS pos, {n} AS n, string_agg(h, '' ORDER BY pos) AS pre, CASE WHEN {n} = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {name}{i - 1} GROUP BY grp, pos // 8, {n})")

    climb("t", levels)
    parts.append(f"u0 AS (SELECT '' AS grp, grp AS own, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM t{levels})")
    climb("u", upper)
    parts.append(f"f0 AS (SELECT t0.doc_id, t0.leaf, t0.grp, t0.pos, u0.pos AS upos, u0.h AS subroot, (SELECT h FROM u{upper}) AS root, coalesce(claimed, leaf) AS f, '' AS sib FROM t0 JOIN u0 ON u0.own = t0.grp)")
    at = 0
    for name, count, pos in (("t", levels, "pos"), ("u", upper, "upos")):
        for i in range(1, count + 1):
            slot = f"(f{at}.{pos} // {8 ** (i - 1)}) % 8"
            left, right = f"left(x.pre, (64 * ({slot}))::BIGINT)", f"substr(x.pre, (64 * ({slot}) + 65)::BIGINT)"
            same = f"x.grp = f{at}.grp" if name == "t" else "x.grp = ''"
            parts.append(f"f{at + 1} AS (SELECT f{at}.* REPLACE (CASE WHEN x.n = 1 THEN f ELSE sha256({left} || f || {right}) END AS f, CASE WHEN x.n = 1 THEN sib ELSE sib || {left} || {right} END AS sib) FROM f{at} JOIN {name}{i} x ON {same} AND x.pos = f{at}.{pos} // {8 ** i})")
            at += 1
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{at}"


OP11_SQL = _sql()
