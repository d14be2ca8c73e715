"""SentencePiece encoding and decoding by a table of distinct chunks.

The normaliser turns each space into a mark and puts one mark before the
text. If no piece of the vocabulary has a mark after another character, no
merge crosses the place before a run of marks, so a text falls apart into
chunks (marks and the characters up to the next mark) that are segmented
independently. A chunk is segmented once for all its occurrences that a worker
meets: the table is bounded, lives with the Python worker and so serves many
tasks, and ids are joined back by position. Nothing is shuffled: a table for
the whole corpus would need a shuffle of each word of each document.

Vocabularies whose pieces cross marks, that remove extra spaces, or that
change characters are encoded text by text with the library.

Null and empty texts give the begin and end ids and an empty decoded text.
Rows are independent: repeated rows repeat, an empty table gives an empty
result, other columns are not read.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import Memo, chunks, documents, table

MARK = "▁"
#: Longer chunks are segmented but not kept in the table.
KEEP_CHARS = 128


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def pack_ids(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Codec:
    def __init__(self, model: str, table_size: int = 250_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as schema

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = schema.ModelProto()
        proto.ParseFromString(self.sp.serialized_model_proto())
        rules = proto.normalizer_spec
        self.separable = (
            rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
            and not proto.trainer_spec.treat_whitespace_as_suffix and proto.trainer_spec.model_type == proto.trainer_spec.BPE
            and not any(MARK in p.piece.lstrip(MARK) or p.type == p.USER_DEFINED for p in proto.pieces)
        )
        self.begin, self.end = pack_ids([self.sp.bos_id()]), pack_ids([self.sp.eos_id()])
        self.memo = Memo(table_size)

    def _segment(self, keys: list[str]) -> list[tuple[bytes, str]]:
        ids = self.sp.encode(keys, num_threads=1)
        decoded = self.sp.decode(ids, num_threads=1)
        return [(pack_ids(x), d) for x, d in zip(ids, decoded, strict=True)]

    def _parts(self, text: str) -> list[str] | None:
        """The chunks without their first mark; None if the text must be encoded whole."""
        if MARK in text:
            text = text.replace(MARK, " ")
        parts = text.split(" ")
        if "" not in parts:
            return parts
        if parts[-1] == "":
            return None
        joined, marks = [], 0
        for p in parts:
            if p:
                joined.append(" " * marks + p)
                marks = 0
            else:
                marks += 1
        return joined

    def encode_decode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """ids of each text with begin and end, as little-endian unsigned 32-bit integers, and the text decoded from them."""
        split = [self._parts(t) if self.separable and t else None for t in texts]
        known = self.memo.take({k for parts in split if parts for k in parts if len(k) <= KEEP_CHARS}, self._segment)
        ids, decoded = [], []
        for text, parts in zip(texts, split, strict=True):
            if parts is None:
                got = self.sp.encode(text) if text else []
                ids.append(self.begin + pack_ids(got) + self.end)
                decoded.append(self.sp.decode(got) if got else "")
                continue
            try:
                found = [known[k] for k in parts]
            except KeyError:
                found = [known[k] if len(k) <= KEEP_CHARS else self._segment([k])[0] for k in parts]
            a, b = zip(*found, strict=True)
            ids.append(self.begin + b"".join(a) + self.end)
            decoded.append(" ".join(b))
        return ids, decoded

    def decode(self, packed: list[bytes | None]) -> list[str]:
        return self.sp.decode([np.frombuffer(x or b"", "<u4").tolist() for x in packed], num_threads=1)


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    return Codec(model)


def encode_decode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit, with begin and end), decoded, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            ids, decoded = codec(model).encode_decode(texts)
            yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of each row's ids (binary as from encode_decode; null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.record_batch([part.column(0), pa.array(codec(model).decode(part.column(1).to_pylist()), pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole document encoded and decoded; digests of the ids and of the decoded text."""
    coded = encode_decode(table(spark, sf_dir, "documents"), default_model())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
