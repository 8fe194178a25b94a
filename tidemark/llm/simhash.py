"""SimHash near-duplicates found by anchor points of a covering code.

A fingerprint has 64 bits. Its first bits are cut into blocks, one per perfect code: every word of a
block lies within the code's covering radius of exactly one code word. An anchor is one code word per
block. A fingerprint lives at its home anchor (the nearest code word of each block) and visits every
anchor that is further away by at most the threshold, in all blocks together. Two fingerprints that
differ in at most ``threshold`` bits differ in at most so many in the blocks together, so each of them
visits the home of the other: comparing the visitors of an anchor with those who live there misses no
pair, whatever the data.

Two Golay codes of 23 bits make 2**24 anchors and about 61 visits a fingerprint; a third block
(``HAMMING``) makes 2**35 anchors and about 150 visits, for tables of some 10**10 distinct
fingerprints. The work is linear but for anchors with many dwellers; these are cut into blocks of
bounded size by both sides, so that no task gets an unbounded group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage, texts, worker_cache
from tidemark.llm.components import connected_components

SEED = 42
#: Bits that may differ, and words of a shingle.
THRESHOLD, WORDS = 2, 3
# Length, generator polynomial and covering radius of the perfect binary codes.
GOLAY, HAMMING = (23, 0b110001110101, 3), (15, 0b10011, 1)
#: Dwellers and visitors that one comparison block of an anchor holds on either side.
HOMES, VISITS = 2_048, 16_384
#: Shingles hashed at once.
RUN = 65_536
#: The bits of every byte, highest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles with repeats; 0 without words."""
    w = text.lower().split()
    if not w:
        return 0
    width = min(words, len(w))
    flat = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(w) - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    digest = xxhash.xxh64_digest  # big-endian bytes
    ones = np.zeros((8, 256), np.int64)
    for lo in range(0, len(starts), RUN):
        h = b"".join([digest(flat[a:b], SEED) for a, b in zip(starts[lo:lo + RUN], ends[lo:lo + RUN], strict=True)])
        of_byte = np.frombuffer(h, np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[k] += np.bincount(of_byte[:, k], minlength=256)
    return int.from_bytes(np.packbits(2 * (ones @ BITS) > len(starts)).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches):
        for b in batches:
            found = np.fromiter((fingerprint(t, words) for t in texts(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long): one row per row of ``docs`` (doc_id, text)."""
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(_fingerprints(words), "doc_id long, fp long"))


class PerfectCode:
    """Cyclic perfect code: for a word, the error patterns that lead to code words up to ``extra`` bits
    beyond the covering radius, listed by how far beyond."""

    def __init__(self, length: int, generator: int, radius: int, extra: int):
        self.length, self.check = length, generator.bit_length() - 1
        rest = []
        for i in range(length):  # x**i modulo the generator
            r = 1 << i
            for top in range(i, self.check - 1, -1):
                if r >> top & 1:
                    r ^= generator << (top - self.check)
            rest.append(r)
        self.rest = np.array(rest, np.int64)
        patterns, level = [], []
        for weight in range(radius + extra + 1):
            for bits in combinations(range(length), weight):
                patterns.append(sum(1 << k for k in bits))
                level.append(max(0, weight - radius))
        patterns, level = np.array(patterns, np.int64), np.array(level)
        syndrome = self.syndrome(patterns)
        order = np.lexsort((level, syndrome))
        self.pattern = patterns[order]
        cells = (syndrome * (extra + 1) + level)[order]
        count = np.bincount(cells, minlength=(extra + 1) << self.check)
        self.count = count.reshape(-1, extra + 1)
        self.first = (np.cumsum(count) - count).reshape(-1, extra + 1)

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for i, r in enumerate(self.rest):
            out ^= np.where(words >> i & 1, r, 0)
        return out

    def near(self, words: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, message of a code word) for every code word ``level`` bits beyond the radius of row's word."""
        s = self.syndrome(words)
        n, first = self.count[s, level], self.first[s, level]
        row = np.repeat(np.arange(len(words)), n)
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return row, (words[row] ^ self.pattern[at]) >> self.check  # the code is systematic


def anchors(fps: np.ndarray, codes: list[PerfectCode], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of every anchor that each fingerprint visits."""
    row, anchor, spent = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64)
    at = 0
    for code in codes:
        words = (fps >> np.uint64(at)).astype(np.int64) & ((1 << code.length) - 1)
        at += code.length
        parts = []
        for level in range(threshold + 1):
            hit, message = code.near(words, level)
            # every anchor so far of the fingerprint goes on with each of these code words, while it has bits left
            size = np.bincount(hit, minlength=len(fps))
            begin = np.cumsum(size) - size
            may = np.flatnonzero(spent + level <= threshold)
            n = size[row[may]]
            old = np.repeat(may, n)
            new = np.repeat(begin[row[may]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            parts.append((row[old], anchor[old] << (code.length - code.check) | message[new], spent[old] + level))
        row, anchor, spent = (np.concatenate(x) for x in zip(*parts, strict=True))
    return row, anchor, spent == 0


def _codes(shapes, threshold: int) -> list[PerfectCode]:
    return worker_cache("codes", (tuple(shapes), threshold), lambda: [PerfectCode(*s, threshold) for s in shapes])


def _visit(shapes, threshold: int):
    def run(batches):
        codes = _codes(shapes, threshold)
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                fps = b.column(0).slice(lo, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                row, anchor, home = anchors(fps, codes, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[row].view(np.int64)), pa.array(home)],
                                                 names=["anchor", "fp", "home"])

    return run


def _block_links(homes: np.ndarray, rows: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is similar in one block: at most one per row and a forest over the homes."""
    root = np.arange(len(homes))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for r in range(0, len(rows), 2048):
        part = rows[r:r + 2048]
        lead = np.full(len(part), -1)  # the first similar home of each row
        for h in range(0, len(homes), 512):
            hit = np.bitwise_count(homes[h:h + 512, None] ^ part[None, :]) <= threshold
            some = hit.any(axis=0)
            lead = np.where((lead < 0) & some, h + hit.argmax(axis=0), lead)
            a, b = np.nonzero(hit)
            for pair in np.unique((a + h) * len(homes) + lead[b]):  # homes that one row is similar to
                x, y = find(pair // len(homes)), find(pair % len(homes))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((homes[[max(x, y)]], homes[[min(x, y)]]))
        on = np.flatnonzero(lead >= 0)
        out.append((part[on], homes[lead[on]]))
    return out


def _compare(threshold: int):
    """Links (a, b) out of rows (anchor, hb, gb, fp, home), sorted so that the dwellers of a block come first."""

    def links(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        size = np.diff(np.append(begin, len(fp)))
        homes = np.add.reduceat(home.astype(np.int64), begin)
        # one dweller: all rows of the block against it at once
        one = np.flatnonzero((homes == 1) & (size > 1))
        n = size[one] - 1
        rows = np.repeat(begin[one] + 1 - np.cumsum(n) + n, n) + np.arange(n.sum())
        lone = np.repeat(begin[one], n)
        hit = np.bitwise_count(fp[rows] ^ fp[lone]) <= threshold
        found = [(fp[rows[hit]], fp[lone[hit]])]
        for k in np.flatnonzero(homes > 1):
            found += _block_links(fp[begin[k]:begin[k] + homes[k]], fp[begin[k]:begin[k] + size[k]], threshold)
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        on = a != b
        return pa.RecordBatch.from_arrays([pa.array(a[on].view(np.int64)), pa.array(b[on].view(np.int64))], names=["a", "b"])

    def run(batches):
        rest = None
        for b in batches:
            key = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
            now = [key, b.column(3).to_numpy(zero_copy_only=False).view(np.uint64), b.column(4).to_numpy(zero_copy_only=False)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            last = np.flatnonzero((now[0] != now[0][-1]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0  # the last block may go on in the next batch
            rest = [x[cut:] for x in now]
            if cut:
                yield links(*[x[:cut] for x in now])
        if rest is not None and len(rest[0]):
            yield links(*rest)

    return run


def similar_links(fps: DataFrame, threshold: int = THRESHOLD, codes=(GOLAY, GOLAY)) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fps`` (fp long) within ``threshold`` bits."""
    visits = fps.mapInArrow(_visit(codes, threshold), "anchor long, fp long, home boolean")
    count = visits.groupBy("anchor").agg(F.count("*").alias("rows"), F.count_if("home").alias("homes"))
    busy = stage(count.where((F.col("homes") > 0) & (F.col("rows") > VISITS))
                 .select("anchor", F.ceil(F.col("homes") / HOMES).cast("int").alias("nh"),
                         F.ceil(F.col("rows") / VISITS).cast("int").alias("ng")), "simhash-busy")
    cut = visits.join(busy, "anchor", "left")
    hb, gb = (F.coalesce(F.pmod(F.xxhash64("fp", F.lit(k)), F.col(n)), F.lit(0)).cast("int") for k, n in ((1, "nh"), (2, "ng")))
    each = [F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1) for n in (F.col("nh"), F.col("ng"))]
    # at a busy anchor every block of dwellers meets every block of visitors, dwellers among the visitors
    dwell = cut.where("home").select("anchor", hb.alias("hb"), F.explode(each[1]).alias("gb"), "fp", F.lit(True).alias("home"))
    visit = (cut.where("NOT home OR nh IS NOT NULL")
             .select("anchor", F.explode(each[0]).alias("hb"), gb.alias("gb"), "fp", F.lit(False).alias("home")))
    rows = dwell.unionByName(visit).repartition("anchor", "hb", "gb")
    return rows.sortWithinPartitions("anchor", "hb", "gb", F.col("home").desc()).mapInArrow(_compare(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, codes=(GOLAY, GOLAY)) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs`` (doc_id, text; others unused).

    Null and empty texts and texts without words have fingerprint zero and are linked like any other.
    A text of fewer words is one shingle. A repeated doc_id stands for one document: its fingerprints
    are linked to each other. Rows without a doc_id link nothing and have no component_id. An empty
    table gives none.
    """
    prof = stage(fingerprints(docs, words), "simhash-fingerprints")
    known = prof.where("doc_id IS NOT NULL")
    fps = stage(known.groupBy("fp").agg(F.min("doc_id").alias("doc")), "simhash-distinct")
    links = similar_links(fps.select("fp"), threshold, codes)
    again = known.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("doc_id", "b")
    same = known.join(again, "doc_id").select(F.col("fp").alias("a"), "b")
    of_fp = connected_components(stage(links.unionByName(same), "simhash-links"))
    placed = fps.join(of_fp, fps["fp"] == of_fp["node"], "left").select("fp", "doc", F.coalesce("component", "fp").alias("component"))
    low = placed.groupBy("component").agg(F.min("doc").alias("component_id"))
    table = stage(placed.join(low, "component").select("fp", "component_id"), "simhash-components")
    return prof.join(table, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op12(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
