"""Packing of documents into sequences of a fixed number of tokens.

Tokens: byte-level BPE never merges across pre-tokens, and a place before a
space is a pre-token's start unless white space stands on both sides of it.
Texts are split there and each distinct chunk is tokenised once for all its
occurrences that a task meets (a bounded table);
texts with such white space are tokenised whole. Each document ends with an end id.

Packing is sum-of-squares: a piece goes where the sum, over all residual gaps,
of the squared number of open sequences with that gap becomes smallest; a new
sequence is one of the choices. Pieces are dealt to buckets by a hash of their
place in the input, so each bucket has a bounded number of small rows however large a
source or a group of copies is, however many rows share an id and however long
texts are, and a bucket packs on its own, larger pieces first. A bucket leaves a few open sequences; with thousands of pieces in it
they do not count.

A null text is empty and has only the end id. Repeated rows are packed each. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import Memo, chunks, documents, table
from quarryline.llm.sentencepiece_codec import pack_ids

SEQUENCE = 2048
END_ID = 0
#: Pieces in a bucket, about; byte-level ids stand for a byte or more, so there are never over four times as many.
BUCKET_PIECES = 50_000
KEEP_CHARS = 64
#: Fixed: the pre-tokens of byte-level vocabularies.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_TANGLED = re.compile(r"\s \s")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Ids as by the tokenizers library, chunk by chunk.

    Where ids follow the order of the merges, single chunks are segmented by
    tiktoken with the ranks of the same file, which gives the same ids faster;
    else, and for texts that cannot be split, by the tokenizers library.
    """

    def __init__(self, path: str, table_size: int = 200_000):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        spec = json.loads(self.lib.to_str())
        # A text that has one of these is left whole to the library: it is one id there, and may take the spaces beside it.
        added = [re.escape(x["content"]) for x in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(sorted(added, key=len, reverse=True))) if added else None
        before = spec.get("pre_tokenizer") or {}
        self.separable = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.memo = Memo(table_size)
        self.fast = None
        model = spec["model"]
        if self.separable and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            byte_of, vocab = _byte_of(), {t: i for t, i in model["vocab"].items() if i not in {x["id"] for x in spec["added_tokens"]}}
            merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
            if [vocab[m] for m in merged] == list(range(256, 256 + len(merged))) and len(vocab) == 256 + len(merged):
                import tiktoken

                ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
                self.fast = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def _single(self, chunks: list[str]) -> list[bytes]:
        if self.fast is None:
            return self._whole(chunks)
        return [pack_ids(self.fast(c)) for c in chunks]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [pack_ids(e.ids) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without an end id."""
        whole = [i for i, t in enumerate(texts) if not self.separable or _TANGLED.search(t) or (self.added and self.added.search(t))]
        out: list[bytes | None] = [None] * len(texts)
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = ids
        split = [None if ids is not None else t.split(" ") for t, ids in zip(texts, out, strict=True)]
        # The key of a chunk that starts with a space has none; the first chunk of a text is looked up apart.
        later = {k for parts in split if parts for k in parts[1:] if len(k) <= KEEP_CHARS}
        known = self.memo.take(later, lambda keys: self._single([" " + k for k in keys]))
        first = self._single([parts[0] if parts else "" for parts in split])
        for i, parts in enumerate(split):
            if parts is None:
                continue
            try:
                out[i] = first[i] + b"".join([known[k] for k in parts[1:]])
            except KeyError:
                out[i] = first[i] + b"".join([known[k] if len(k) <= KEEP_CHARS else self._single([" " + k])[0] for k in parts[1:]])
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def token_pieces(df: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit) of each document, its end id with it.

    Only a document of more than ``size`` ids is cut: into pieces of that
    size, the first of which may be shorter.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            rows, piece, start, length, ids = [], [], [], [], []
            for row, got in enumerate(tokenizer(path).encode(texts)):
                got += end
                n = len(got) // 4
                at, k = 0, 0
                while at < n:
                    to = at + ((n - at) % size or size)
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    ids.append(got[4 * at : 4 * to])
                    at, k = to, k + 1
            yield pa.record_batch(
                [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"],
            )
        tokenizer(path).memo.clear()  # a worker goes on to other tasks

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the place in it of each piece, packed in the order given."""
    count = np.zeros(size + 1, np.int64)  # open sequences by gap; a full one is not open
    waiting: list[list[int]] = [[] for _ in range(size + 1)]
    taken: list[int] = []
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        # Moving a sequence from gap g to g - n changes the sum by 2 (count[g - n] - count[g] + 1).
        gain = 2 * (count[: size + 1 - n] - count[n:]) + 2
        gain[0] = 1 - 2 * count[n]
        gain[count[n:] == 0] = np.iinfo(np.int64).max
        left = int(gain.argmin())
        fresh = 2 * count[size - n] + 1 if n < size else 0
        if gain[left] <= fresh and count[left + n]:
            s = waiting[left + n].pop()
            count[left + n] -= 1
        else:
            s, left = len(taken), size - n
            taken.append(0)
        sequence[i], offset[i] = s, taken[s]
        taken[s] += n
        if left:
            waiting[left].append(s)
            count[left] += 1
    return sequence, offset


def pack(pieces: DataFrame, n_buckets: int, size: int = SEQUENCE) -> DataFrame:
    """pieces (doc_id, piece, length of 1 to ``size`` and any other columns) with sequence_id and offset."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), size)
        return rows.assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    bucket = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, n_buckets)))
    return pieces.groupBy(bucket.alias("bucket")).applyInPandas(run, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens; one row for each piece."""
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = token_pieces(docs, default_tokenizer()).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    about = docs.agg(F.sum(1 + F.coalesce(F.floor(F.octet_length("text") / (4 * SEQUENCE)), F.lit(0)))).first()[0] or 0
    return pack(pieces, -(-about // BUCKET_PIECES))
