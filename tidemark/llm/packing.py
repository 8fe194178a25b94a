"""Vector bin packing of examples into training sequences under several limits at once.

An example has a demand in every dimension (tokens, segments, loss-bearing tokens). A sequence is
filled one example at a time with the one whose demand has the largest dot product with what the
sequence still has room for, both as fractions of the limits; when nothing fits, the next sequence
begins. Examples are dealt evenly to groups of bounded size, which are packed independently.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage, worker_cache

SEQUENCE = 2048
END_ID = 1
#: Per sequence: tokens, segments, loss-bearing tokens (the first token of a segment bears none).
LIMITS = {"length": SEQUENCE, "segments": 256, "loss_tokens": SEQUENCE - 1}
#: Examples packed together in one task.
GROUP_ROWS = 50_000

# The published split pattern and the special token of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
# A blank before a non-blank always begins a piece of SPLIT, so a text may be cut there.
_CUT = re.compile(r" (?=\S)")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable stand-in character of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenBytes(dict):
    """piece after a blank -> its ids as little-endian 32-bit bytes, remembering at most ``keep`` pieces."""

    def __init__(self, path: str, keep: int = 400_000):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        byte_of = _byte_of()
        ranks = {bytes(map(byte_of.__getitem__, k)): v for k, v in vocab.items() if k != SPECIAL}
        self.plain = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(path)
        self.keep = keep

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.keep:
            self.clear()
        ids = self[piece] = self.raw(" " + piece)
        return ids

    def raw(self, text: str) -> bytes:
        return array("I", self.plain.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:  # the tokenizer reads its special token inside a text as one id
            return array("I", self.full.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = _CUT.split(text)
        return self.raw(first) + b"".join(map(self.__getitem__, rest))


def _tokenise(path: str, sequence: int, end_id: int):
    def run(batches):
        code = worker_cache("tokens", path, lambda: TokenBytes(path))
        end = array("I", [end_id]).tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                ids, texts = b.column(0).slice(lo, 2000).to_pylist(), b.column(1).slice(lo, 2000)
                out: list[list] = [[], [], [], [], []]
                for doc, text in zip(ids, texts, strict=True):
                    body = code.encode(text.as_py() or "") + end
                    total = len(body) // 4
                    for at in range(0, total, sequence):
                        piece = body[4 * at:4 * (at + sequence)]
                        for column, v in zip(out, (doc, at, len(piece) // 4, zlib.crc32(piece), total), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids and the end id, cut at ``sequence``."""
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(_tokenise(path or vocabulary_path(), sequence, end_id),
                        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"))


def fill(demands: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """(sequence, place in it) of each row of ``demands`` by the dot-product heuristic."""
    if (demands > limits).any():
        raise ValueError("an example exceeds a limit on its own")
    kinds, kind_of = np.unique(demands, axis=0, return_inverse=True)
    kind_of = kind_of.reshape(-1)
    waiting = np.split(np.argsort(kind_of, kind="stable"), np.cumsum(np.bincount(kind_of, minlength=len(kinds)))[:-1])
    left = np.array([len(w) for w in waiting])
    share = kinds / limits
    out = np.empty((len(demands), 2), np.int64)
    live, sequence = np.arange(len(kinds)), 0
    while len(live):
        room, place, fits = limits.astype(np.int64).copy(), 0, live
        while len(fits := fits[(kinds[fits] <= room).all(axis=1) & (left[fits] > 0)]):
            best = fits[len(fits) - 1 - np.argmax((share[fits] @ (room / limits))[::-1])]
            left[best] -= 1
            out[waiting[best][left[best]]] = sequence, place
            room -= kinds[best]
            place += 1
        live = live[left[live] > 0]
        sequence += 1
    return out


def _pack(limits: dict[str, int], group_rows: int):
    names, most = list(limits), np.array(list(limits.values()))

    def flush(rows: pd.DataFrame, first: int):
        placed = fill(rows[names].to_numpy(np.int64), most)
        rows = rows.assign(sequence_id=first + placed[:, 0], _place=placed[:, 1]).sort_values(["sequence_id", "_place"])
        rows["offset"] = rows.groupby("sequence_id")[names[0]].cumsum() - rows[names[0]]
        rows["sequence_id"] += rows.pop("_task").to_numpy(np.int64) << 40
        return rows.drop(columns="_place"), first + int(placed[:, 0].max()) + 1

    def run(batches):
        held, size, first = [], 0, 0
        for b in batches:
            for lo in range(0, len(b), group_rows):
                held.append(b.iloc[lo:lo + group_rows])
                size += len(held[-1])
                if size >= group_rows:
                    out, first = flush(pd.concat(held, ignore_index=True), first)
                    held, size = [], 0
                    yield out
        if size:
            yield flush(pd.concat(held, ignore_index=True), first)[0]

    return run


def pack(examples: DataFrame, limits: dict[str, int], group_rows: int = GROUP_ROWS) -> DataFrame:
    """``examples`` with sequence_id and offset: whole examples, within every limit of each sequence.

    ``limits`` names demand columns (not null, not negative) and their limits; the first is the one
    that offsets count. Columns named sequence_id or offset are replaced. An example that exceeds a limit on its own raises. Rows are dealt evenly
    (repeated rows too) into groups of about ``group_rows``; a group is one task's work.
    """
    examples = examples.drop("sequence_id", "offset", "_task", "_place")
    groups = max(1, math.ceil(examples.count() / group_rows))
    dealt = examples.repartition(groups).withColumn("_task", F.spark_partition_id().cast("long"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.schema)
    return dealt.mapInPandas(_pack(limits, group_rows), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, limits: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Takes doc_id and text (other columns unused); a null or empty text is the end id alone. Repeated
    rows are packed one by one. An empty table gives no rows.
    """
    limits = limits or LIMITS
    cut = stage(pieces(docs, path, min(limits["length"], limits["loss_tokens"] + 1)), "packing-pieces")
    wanted = (cut.withColumn("segments", F.lit(1).cast("long"))
              .withColumn("loss_tokens", F.greatest(F.col("length") - 1, F.lit(0))))
    return pack(wanted, limits).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
