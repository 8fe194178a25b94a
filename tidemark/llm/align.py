"""Cross-tokenizer alignment with corpus-wide counts of linked token pairs.

Two tokenizers cut the same bytes; where tokens of both end at one byte, a group ends. Every A token
of a group is linked with every B token of it. How many documents link a pair of ids is counted by
minimal perfect hashing:

1. the documents are tokenized once, and their ids written (two bytes an id where the vocabulary allows);
   a pass over the ids gives each task's distinct pairs with their document counts, in parts by
   a hash of the pair;
2. the distinct pairs of a part (tree-wise: first per salt, then per part) get a minimal perfect hash:
   levels of bit arrays, each pair at the first level where no other pair shares its bit, its number
   being the rank of that bit; the pairs are kept in this order, so that a lookup is verified;
3. partial counts become dense vectors indexed by the hash and are summed tree-wise the same way;
4. a second pass over the ids looks the counts up.

Hash and counts go to the tasks in slices of a bounded number of pairs. One slice is enough for some
millions of distinct pairs; beyond that the second pass is repeated per slice and the results are
added up, so that the answer is whole at every size. At most |A| x |B| pairs exist.

Texts are aligned by whole arrays: byte offsets of the token ends, those that both have, groups by
running counts. Both tokenizers always cut before a single blank (no piece of B has a blank after another
character; white space on both sides of it is left whole for A), so the ids of the stretches between such
blanks are remembered by the worker.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix, stage, worker_cache
from tidemark.llm.packing import SPECIAL, SPLIT, _byte_of
from tidemark.session import staged

#: Parts of the pairs, and salts of a part's first summing level.
PARTS, SALTS = 128, 8
#: Pairs whose hash and counts go to the tasks at once (about 17 bytes each).
SLICE_KEYS = 4_000_000
#: Distinct pairs that a task holds before it hands them on.
HELD_KEYS = 2_000_000
#: Bits per key of a hash level.
GAMMA = 2
#: Stretches that a worker remembers; characters tokenized and bytes of A's ids aligned at once; links of a group that are listed one by one.
KEEP_UNITS, CHUNK_CHARS, CHUNK_IDS, LISTED = 500_000, 1_000_000, 500_000, 4_096

_CUT = re.compile(r"(?<=[^ ]) (?=\S)|(?<=\S) (?=[^ ])")
#: Texts without these are cut at every blank.
_ODD = re.compile(r"\A | \Z|  |\s \s")
_SEED = np.uint64(0x9E3779B97F4A7C15)


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers(dict):
    """Both tokenizers; stretch -> B's ids as 32-bit bytes, remembered; None where B's bytes are not those of the text.

    ``ids_of_a`` remembers A's ids of the same stretches."""

    def __init__(self, path_a: str, path_b: str):
        super().__init__()
        self.ids_of_a: dict[str, bytes] = {}
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte_of = _byte_of()
        ranks = {bytes(map(byte_of.__getitem__, k)): v for k, v in vocab.items() if k != SPECIAL}
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.size_a = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size_a[list(ranks.values())] = [len(k) for k in ranks]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self.piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.size_b = np.array([len(x) for x in self.bytes_b])
        if any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(len(self.bytes_b))):
            raise ValueError(f"{path_b}: a piece goes on after a blank, texts cannot be cut before blanks")
        self.kinds = [np.min_scalar_type(len(x) - 1) for x in (self.size_a, self.size_b)]  # of written ids
        # an id with what follows it in the digest's text
        self.spelled = [f"{i}{mark}" for i in range(max(len(self.size_a), len(self.size_b))) for mark in (",", "|", ";", "")]

    def piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of A and B of each text after a blank, None where B's bytes are not those of the text."""
        if len(self) > KEEP_UNITS:
            self.clear()
            self.ids_of_a.clear()
        cut = [_CUT.split(t) if _ODD.search(t) else t.split(" ") for t in texts]
        new = list(set().union(*cut).difference(self))
        for unit, ids in zip(new, self.b.encode(new, num_threads=1), strict=True):
            same = b"".join(map(self.bytes_b.__getitem__, ids)) == b" " + unit.encode()
            self[unit] = array("i", ids).tobytes() if same else None
        # A takes the stretches as one text, which it cuts before each; those that begin or end with white space alone
        whole = [u for u in new if u and not u[0].isspace() and not u[-1].isspace()]
        ids = np.array(self.a.encode_ordinary(" " + " ".join(whole)) if whole else [], np.int32)
        ends = np.cumsum([len(u.encode()) + 1 for u in whole])
        ends = (4 * (np.searchsorted(np.cumsum(self.size_a[ids]), ends) + 1)).tolist()
        ids = ids.tobytes()
        for unit, i, j in zip(whole, [0, *ends], ends, strict=False):
            self.ids_of_a[unit] = ids[i:j]
        for unit in set(new).difference(whole):
            self.ids_of_a[unit] = array("i", self.a.encode_ordinary(" " + unit)).tobytes()
        out = []
        for units in cut:
            found = list(map(self.__getitem__, units))
            out.append(None if None in found else (b"".join(map(self.ids_of_a.__getitem__, units)), b"".join(found)))
        return out


class Aligned(NamedTuple):
    """Aligned texts: one entry per text, token and group; tokens and groups in the order of the texts."""

    on: np.ndarray  # which texts have tokens; the others stand in none of the arrays below
    ids: tuple[np.ndarray, np.ndarray]
    group: tuple[np.ndarray, np.ndarray]
    text_of: np.ndarray  # text (among those with tokens) of each group
    sizes: tuple[np.ndarray, np.ndarray]  # tokens of each group

    def links(self):
        """Runs of (group, pair, times) of every link; a group of very many links gives each distinct pair once."""
        size_a, size_b = self.sizes
        few = size_a * size_b <= LISTED
        a = np.flatnonzero(few[self.group[0]])
        group = self.group[0][a]
        n = size_b[group]
        first = np.cumsum(size_b) - size_b
        b = np.repeat(first[group] - np.cumsum(n) + n, n) + np.arange(n.sum())
        yield np.repeat(group, n), np.repeat(self.ids[0][a], n) << 32 | self.ids[1][b], 1
        for g in np.flatnonzero(~few):
            (x, nx), (y, ny) = (np.unique(self.ids[k][self.group[k] == g], return_counts=True) for k in (0, 1))
            for lo in range(0, len(x), 64):
                yield (np.full(len(x[lo:lo + 64]) * len(y), g), (x[lo:lo + 64, None] << 32 | y[None, :]).ravel(),
                       (nx[lo:lo + 64, None] * ny[None, :]).ravel())


def align_ids(tokenizers: Tokenizers, a: list[bytes | None], b: list[bytes | None]) -> Aligned:
    """Takes the written ids of both tokenizers, None for a text without tokens."""
    on = np.array([x is not None for x in a], bool)
    both = [[x for x in column if x is not None] for column in (a, b)]
    ids = tuple(np.frombuffer(b"".join(x), kind).astype(np.int64) for x, kind in zip(both, tokenizers.kinds, strict=True))
    ends = np.cumsum(tokenizers.size_a[ids[0]]), np.cumsum(tokenizers.size_b[ids[1]])
    at = np.searchsorted(ends[1], ends[0])  # in every text the last tokens of both end together
    cut = [ends[1][at] == ends[0], np.zeros(len(ids[1]), bool)]
    cut[1][at[cut[0]]] = True
    group = tuple(np.cumsum(c) - c for c in cut)
    n = int(cut[0].sum())
    text_a = np.repeat(np.arange(len(both[0])), [len(x) // tokenizers.kinds[0].itemsize for x in both[0]])
    return Aligned(on, ids, group, text_a[cut[0]], tuple(np.bincount(g, minlength=n) for g in group))


def spell(tokenizers: Tokenizers, x: Aligned) -> list[str]:
    """a1,a2|b1;a3|b2,b3 of each text with tokens."""
    size_a, size_b = x.sizes
    last = np.append(x.text_of[1:] != x.text_of[:-1], True) if len(x.text_of) else np.zeros(0, bool)
    codes = np.empty(len(x.ids[0]) + len(x.ids[1]), np.int64)
    begin = np.cumsum(size_a + size_b) - size_a - size_b
    for ids, group, size, shift, end in ((x.ids[0], x.group[0], size_a, 0, np.ones(len(last), np.int64)),
                                         (x.ids[1], x.group[1], size_b, size_a, 2 + last)):
        place = np.arange(len(ids)) - (np.cumsum(size) - size)[group]
        mark = np.where(place == size[group] - 1, end[group], 0)
        codes[(begin + shift)[group] + place] = 4 * ids + mark
    cut = np.searchsorted(x.text_of, np.arange(int(x.on.sum()) + 1))
    cut = np.append(begin, len(codes))[cut].tolist()
    codes = codes.tolist()
    return ["".join(map(tokenizers.spelled.__getitem__, codes[i:j])) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def runs(texts: list, most: int) -> list[tuple[int, int]]:
    """(from, to) of runs of texts, or of their ids, of bounded size."""
    out, lo, held = [], 0, 0
    for i, t in enumerate(texts):
        if i > lo and held + len(t or "") > most:
            out.append((lo, i))
            lo, held = i, 0
        held += len(t or "")
    return [*out, (lo, len(texts))] if texts else out


def _encoded(path_a: str, path_b: str):
    def run(batches):
        tokenizers = worker_cache("tokenizers", (path_a, path_b), lambda: Tokenizers(path_a, path_b))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in runs(texts, CHUNK_CHARS):
                found = iter(tokenizers.encode([t for t in texts[lo:hi] if t]))
                both = [next(found) if t else None for t in texts[lo:hi]]
                a, b = ([x and np.frombuffer(x[k], np.int32).astype(kind).tobytes() for x in both] for k, kind in enumerate(tokenizers.kinds))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(a, pa.binary()), pa.array(b, pa.binary())],
                                                 names=["doc_id", "a", "b"])

    return run


def token_ids(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, a, b): the ids of both tokenizers, null where a text has no tokens; written once."""
    return staged(docs.mapInArrow(_encoded(path_a, path_b), "doc_id long, a binary, b binary"), "align-ids")


def _aligned(path_a: str, path_b: str, batches):
    """(doc_ids, tokenizers, Aligned) of runs of token_ids."""
    tokenizers = worker_cache("tokenizers", (path_a, path_b), lambda: Tokenizers(path_a, path_b))
    for batch in batches:
        a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for lo, hi in runs(a, CHUNK_IDS):
            yield batch.column(0).slice(lo, hi - lo), tokenizers, align_ids(tokenizers, a[lo:hi], b[lo:hi])


def sums(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of each run of ``size`` rows."""
    out = np.zeros((len(size), *rows.shape[1:]), np.int64)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(rows, (np.cumsum(size) - size)[some], axis=0)
    return out


# -- distinct pairs and their partial counts -------------------------------------------------------------


def part_of(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys.view(np.uint64) * _SEED) >> np.uint64(40)).astype(np.int64) % PARTS


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.zeros(len(k), np.int64)
    np.add.at(n, at, np.concatenate(counts))
    return k, n


def _partial(path_a: str, path_b: str):
    def rows(keys, counts):
        k, n = add_up(keys, counts)
        part = part_of(k)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(PARTS + 1))
        some = np.flatnonzero(np.diff(cut))
        k, n = k[order], n[order]
        salt = TaskContext.get().partitionId() % SALTS
        return pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([salt] * len(some), pa.int32()),
             pa.array([k[cut[p]:cut[p + 1]].tobytes() for p in some], pa.binary()),
             pa.array([n[cut[p]:cut[p + 1]].tobytes() for p in some], pa.binary())], names=["part", "salt", "keys", "counts"])

    def run(batches):
        keys, counts, held = [], [], 0
        for _, _, x in _aligned(path_a, path_b, batches):
            found = list(x.links())
            text, pair = (np.concatenate(v) for v in zip(*((x.text_of[g], k) for g, k, _ in found), strict=True))
            if len(found) > 1:
                order = np.argsort(text, kind="stable")
                text, pair = text[order], pair[order]
            cut = np.searchsorted(text, np.arange(int(x.on.sum()) + 1))
            once = np.concatenate([np.zeros(0, np.int64), *(np.unique(pair[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True))])
            k, n = np.unique(once, return_counts=True)
            keys.append(k)
            counts.append(n)
            held += len(k)
            if held > HELD_KEYS:
                keys, counts = ([v] for v in add_up(keys, counts))
                held = len(keys[0])
                if held > HELD_KEYS // 2:
                    yield rows(keys, counts)
                    keys, counts, held = [], [], 0
        if held:
            yield rows(keys, counts)

    return run


# -- minimal perfect hash ---------------------------------------------------------------------------------


def level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((keys.view(np.uint64) ^ np.uint64(level + 1)) * _SEED + np.uint64(level))


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each level, bit words of all levels, keys in the order of their numbers) for distinct keys."""
    sizes, words, order, level = [], [], [], 0
    while len(keys):
        size = -(-GAMMA * len(keys) // 64)
        at = (level_hash(keys, level) % np.uint64(64 * size)).astype(np.int64)
        alone = np.bincount(at, minlength=64 * size)[at] == 1
        bits = np.zeros(64 * size, np.uint8)
        bits[at[alone]] = 1
        words.append(np.packbits(bits, bitorder="little").view(np.uint64))
        order.append(keys[alone][np.argsort(at[alone])])
        sizes.append(size)
        keys, level = keys[~alone], level + 1
    return (np.array(sizes, np.int64), np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate([np.zeros(0, np.int64), *order]))


class Hash:
    """The perfect hashes of some parts as one: numbers of keys, -1 for a key that none of them holds."""

    def __init__(self, parts: list[int], sizes: list[np.ndarray], words: list[np.ndarray], keys: list[np.ndarray]):
        depth = max(map(len, sizes), default=0)
        self.size, self.base = np.zeros((depth, PARTS), np.uint64), np.zeros((depth, PARTS), np.int64)
        first = 0
        for p, s in zip(parts, sizes, strict=True):
            self.size[:len(s), p] = 64 * s
            self.base[:len(s), p] = 64 * (first + np.cumsum(s) - s)
            first += int(s.sum())
        self.words = np.concatenate([np.zeros(0, np.uint64), *words])
        self.rank = np.cumsum(np.bitwise_count(self.words).astype(np.int64)) - np.bitwise_count(self.words)
        self.keys = np.concatenate([np.zeros(0, np.int64), *keys])

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out, left, part = np.full(len(keys), -1), np.arange(len(keys)), part_of(keys)
        for level in range(len(self.size)):
            size = self.size[level, part[left]]
            left, size = left[size > 0], size[size > 0]
            at = self.base[level, part[left]] + (level_hash(keys[left], level) % size).astype(np.int64)
            word, bit = self.words[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (word & bit) != 0
            out[left[hit]] = (self.rank[at >> 6] + np.bitwise_count(word & (bit - np.uint64(1))))[hit]
            left = left[~hit]
        known = np.flatnonzero(out >= 0)
        out[known[self.keys[out[known]] != keys[known]]] = -1  # verified by the key itself
        return out


class Table(NamedTuple):
    """Counts of one slice of the pairs, and the highest count of each A id over all pairs."""

    hash: Hash
    counts: np.ndarray
    best: np.ndarray

    def counts_of(self, keys: np.ndarray) -> np.ndarray:
        at = self.hash.numbers(keys)
        return np.where(at >= 0, self.counts[at], 0) if len(self.counts) else np.zeros(len(keys), np.int64)

    def is_best(self, keys: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (count > 0) & (count == self.best[keys >> 32])


def _ints(column) -> list[np.ndarray]:
    return [np.frombuffer(v, np.int64) for v in column]


def _distinct(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"part": [key[0]], "keys": [np.unique(np.concatenate(_ints(rows["keys"]))).tobytes()]})


def _hashed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    sizes, words, keys = perfect_hash(np.unique(np.concatenate(_ints(rows["keys"]))))
    return pd.DataFrame({"part": [key[0]], "n": [len(keys)], "sizes": [sizes.tobytes()], "words": [words.tobytes()], "keys": [keys.tobytes()]})


def _hash_of(row) -> Hash:
    return Hash([int(row["part"])], [np.frombuffer(row["sizes"], np.int64)], [np.frombuffer(row["words"], np.uint64)],
                [np.frombuffer(row["keys"], np.int64)])


def _dense(key: tuple, rows: pd.DataFrame, hashes: pd.DataFrame) -> pd.DataFrame:
    """Partial counts of one part and salt as a dense vector indexed by the part's hash."""
    if not len(rows):
        return pd.DataFrame({"part": [], "counts": []})
    h = _hash_of(hashes.iloc[0])
    total = np.zeros(len(h.keys), np.int64)
    for k, n in zip(_ints(rows["keys"]), _ints(rows["counts"]), strict=True):
        total[h.numbers(k)] += n  # the keys of a row are distinct
    return pd.DataFrame({"part": [key[0]], "counts": [total.tobytes()]})


def _summed(key: tuple, hashes: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
    return hashes.assign(counts=[np.sum(_ints(vectors["counts"]), axis=0, dtype=np.int64).tobytes()])


def _highest(batches):
    for b in batches:
        for keys, counts in zip(b.column(0), b.column(1), strict=True):
            a = np.frombuffer(keys.as_py(), np.int64) >> 32
            top = np.zeros(int(a.max(initial=-1)) + 1, np.int64)
            np.maximum.at(top, a, np.frombuffer(counts.as_py(), np.int64))
            some = np.flatnonzero(top)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(top[some])], names=["a", "best"])


def count_pairs(ids: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """part, n, sizes, words, keys, counts: one row per part, the hash of its pairs with their document counts."""
    partial = stage(ids.mapInArrow(
        _partial(path_a, path_b), "part int, salt int, keys binary, counts binary"), "align-partial")
    keys = partial.select("part", "salt", "keys").groupBy("part", "salt").applyInPandas(_distinct, "part int, keys binary")
    hashes = stage(keys.groupBy("part").applyInPandas(_hashed, "part int, n long, sizes binary, words binary, keys binary"), "align-hash")
    salted = hashes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dense = (partial.groupBy("part", "salt").cogroup(salted.groupBy("part", "salt"))
             .applyInPandas(_dense, "part int, counts binary"))
    return stage(hashes.groupBy("part").cogroup(dense.groupBy("part"))
                 .applyInPandas(_summed, hashes.schema.simpleString()[7:-1].replace(":", " ") + ", counts binary"), "align-counts")


# -- second pass -------------------------------------------------------------------------------------------

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _look_up(path_a: str, path_b: str, shipped):
    def run(batches):
        parts, sizes, words, keys, counts, best = shipped.value
        table = Table(Hash(parts, sizes, words, keys), counts, best)
        for doc_id, tokenizers, x in _aligned(path_a, path_b, batches):
            per_group = np.zeros((len(x.text_of), 6), np.int64)  # n_a, n_b, groups, links, best, count
            for k, v in enumerate((*x.sizes, 1, x.sizes[0] * x.sizes[1])):
                per_group[:, k] = v
            for group, pair, times in x.links():
                pair, at = np.unique(pair, return_inverse=True)  # each pair is looked up once
                count = table.counts_of(pair)
                is_best, count = table.is_best(pair, count)[at], count[at]
                if len(group):
                    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                    per_group[group[first], 4] += np.add.reduceat(times * is_best, first)
                    per_group[group[first], 5] += np.add.reduceat(times * count, first)
            totals, sha = np.zeros((len(x.on), 6), np.int64), np.full(len(x.on), "", object)
            totals[x.on] = sums(per_group, np.bincount(x.text_of, minlength=int(x.on.sum())))
            sha[x.on] = [hashlib.sha256(t.encode()).hexdigest() for t in spell(tokenizers, x)]
            yield pa.RecordBatch.from_arrays([doc_id, *[pa.array(totals[:, k]) for k in range(6)], pa.array(sha, pa.string())],
                                             names=[c.split()[0] for c in RESULT.split(", ")])

    return run


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, slice_keys: int = SLICE_KEYS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``docs`` (doc_id, text; others unused).

    Null and empty texts, and texts whose bytes tokenizer B does not give back, have no tokens: zeros and
    an empty digest. Every row counts as a document, rows without a doc_id and with a repeated one too.
    An empty table gives none.
    """
    spark = docs.sparkSession
    path_a, path_b = (given or own for given, own in zip((path_a, path_b), vocabularies(), strict=True))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ids = token_ids(docs, path_a, path_b)
    table = count_pairs(ids, path_a, path_b)
    top = table.select("keys", "counts").mapInArrow(_highest, "a long, best long").groupBy("a").agg(F.max("best").alias("best"))
    top = np.array([tuple(r) for r in top.collect()], np.int64).reshape(-1, 2)  # at most a row per A id
    best = np.zeros(int(top[:, 0].max(initial=0)) + 1, np.int64)
    best[top[:, 0]] = top[:, 1]

    slices, size = [[]], 0
    for r in table.select("part", "n").orderBy("part").collect():  # PARTS rows
        if slices[-1] and size + r.n > slice_keys:
            slices.append([])
            size = 0
        slices[-1].append(r.part)
        size += r.n
    out = []
    for parts in slices:
        rows = table.where(F.col("part").isin(parts)).collect()  # at most slice_keys pairs, or one part
        columns = [[np.frombuffer(r[c], kind) for r in rows] for c, kind in (("sizes", np.int64), ("words", np.uint64), ("keys", np.int64))]
        counts = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["counts"], np.int64) for r in rows]])
        shipped = spark.sparkContext.broadcast(([r["part"] for r in rows], *columns, counts, best))
        out.append(ids.mapInArrow(_look_up(path_a, path_b, shipped), RESULT))
    if len(out) == 1:
        return out[0]
    # rows of one id and digest have the same links; what each slice found of them is added up
    key = ["doc_id", "groups_sha256"]
    out = [stage(df, "align-slice") for df in out]
    more = [df.groupBy(*key).agg(F.max("n_best").alias("b"), F.max("count_sum").alias("c")) for df in out]
    total = reduce(DataFrame.unionByName, more).groupBy(*key).agg(F.sum("b").alias("b"), F.sum("c").alias("c")).toDF("i", "g", "b", "c")
    on = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("groups_sha256") == F.col("g"))
    return out[0].drop("n_best", "count_sum").join(total, on).select(
        *["doc_id", "n_a", "n_b", "n_groups", "n_links"], F.col("b").alias("n_best"), F.col("c").alias("count_sum"), "groups_sha256")


def op11(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
