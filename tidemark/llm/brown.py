"""Class-based n-gram scoring: exchange clustering of words, class transitions, word emissions.

Counts cover every training token. Every word that training holds at least ``LEAST`` times is clustered
by the exchange algorithm over the bigrams of the whole training part, until the likelihood stops
gaining; rarer and unseen words belong to a form class (length and whether there are digits, other signs
or non-ASCII bytes). P(text) is the product of P(class | previous class) * P(word | class), both
add-one smoothed; an end token closes each text and begins the next history.

What is sent to tasks whole is bounded by parameters: the class table (classes squared), and of up to ``MAP_WORDS``
words that move the hashes, classes and counts. With more of them, classes meet the bigrams in a join, and only the ``HEAD`` most
frequent words are sent to score texts; those that are not sent meet their texts in a join. Words are told apart by a
64-bit hash in the bigrams, and where their classes and counts are looked up.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage, texts
from tidemark.session import staging_path

#: Least count of a word that exchange clustering moves between classes, and their number.
LEAST, CLASSES = 2, 48
#: Most frequent words whose counts are sent to every task where not all moving words are.
HEAD = 100_000
#: Moving words whose classes are sent to every task: 17 bytes each for the counts and scores, one or two a round.
MAP_WORDS = 32_000_000
FOLDS, HELD_OUT = 7, 2
#: The end token as a word; real words hold no blank.
END = b" "
FORMS = 40


def form(word: bytes) -> int:
    """Form class (0 .. FORMS-1) of a word that is not clustered: length band, digits, signs, non-ASCII bytes."""
    plain = word.isalpha()
    kind = 0 if plain else 1 if any(48 <= c < 58 for c in word) else 2 if max(word) > 127 else 3
    return kind * 10 + min(len(word), 20) // 2 - (len(word) >= 20)


#: What a byte says of its word: 1 a digit, 2 no ASCII, 4 another sign, 0 a letter.
SIGNS = np.array([0 if bytes([k]).isalpha() else 1 if 48 <= k < 58 else 2 if k > 127 else 4 for k in range(256)], np.uint8)


def forms(words: list[bytes]) -> np.ndarray:
    """``form`` of many words, none of them empty."""
    if not words:
        return np.zeros(0, np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    signs = np.bitwise_or.reduceat(SIGNS[np.frombuffer(b"".join(words), np.uint8)], np.cumsum(size) - size)
    kind = np.array([0, 1, 2, 1, 3, 1, 2, 1])[signs]
    return kind * 10 + np.minimum(size, 20) // 2 - (size >= 20)


def is_held_out(doc_id):
    """crc32 of the id as text, mod FOLDS; a null id counts as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == HELD_OUT


def _count_words(batches):
    counts: Counter[bytes] = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        for t in texts(b.column(0)):
            counts.update(t.lower().split())
            counts[END] += 1
            if len(counts) > 500_000:
                yield out()
                counts.clear()
    if counts:
        yield out()


def _forms(batches):
    for b in batches:
        words = list(texts(b.column(0)))
        kinds = forms(words)
        kinds[[k for k, w in enumerate(words) if w == END]] = -1
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.int64()), b.column(1)], names=["word", "form", "n"])


def word_counts(train: DataFrame) -> DataFrame:
    """(word binary, form, n) over whole texts: ASCII-lower-cased words and one END a text (form -1)."""
    return (train.select(F.col("text").cast("string")).mapInArrow(_count_words, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(_forms, "word binary, form long, n long"))


def frequent(counts: DataFrame, most: int, *more: str) -> list[tuple]:
    """(word, n, further columns), most frequent first: every word at or above a count that at most ``most`` words reach."""
    band = F.floor(F.log2("n") * 16)
    bands = counts.groupBy(band.alias("band")).count().collect()  # at most 16 bands a doubling
    least, have = None, 0
    for b, n in sorted(bands, reverse=True):
        if (have := have + n) > most:
            break
        least = b
    if least is None:
        return []
    rows = counts.where(band >= least).select("word", "n", *more).collect()
    return sorted(((bytes(r["word"]), *r[1:]) for r in rows), key=lambda x: (-x[1], x[0]))


class _Numbers(dict):
    """word -> running number."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _bigrams(batches):
    known, parts, held = _Numbers(), [], 0

    def out():
        size = len(known)
        keys, n = np.unique(np.concatenate([x * size + y for x, y in parts]), return_counts=True)
        name = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in known), np.uint64, size).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(name[keys // size]), pa.array(name[keys % size]), pa.array(n.astype(np.int64))],
                                          names=["a", "b", "n"])

    for batch in batches:
        for t in texts(batch.column(0)):
            w = [END, *t.lower().split(), END]
            s = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
            parts.append((s[:-1], s[1:]))
            held += len(s)
            if held > 4_000_000:
                yield out()
                known, parts, held = _Numbers(), [], 0
    if parts:
        yield out()


def bigram_counts(train: DataFrame) -> DataFrame:
    """(a, b, n): how often word b follows word a (as xxhash64), over all training texts."""
    return (train.select(F.col("text").cast("string")).mapInArrow(_bigrams, "a long, b long, n long")
            .groupBy("a", "b").agg(F.sum("n").alias("n")))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300)) * (x > 0)


#: Counts of a class beside a word whose gains are taken from a table instead of computed word by word.
FEW = 4


def step_gains(table: np.ndarray, choices: int) -> np.ndarray:
    """[side, v, c, b]: what v more neighbours of class c give a cell of class b; ``table`` by rows, then by columns."""
    t = np.stack([table[:choices].T, table[:, :choices]])
    return np.stack([_xlogx(t + v) - _xlogx(t) for v in range(FEW + 1)], axis=1)


def best_classes(left: np.ndarray, right: np.ndarray, both: np.ndarray, own: np.ndarray, table: np.ndarray,
                 choices: int, steps: np.ndarray | None = None) -> np.ndarray:
    """For each word (row) the class (< choices) under which the class bigram likelihood is largest.

    left[w, c]: how often class c stands before the word, right[w, c]: after it (the word itself counted
    in its present class ``own``); both: how often the word follows itself. ``steps``: step_gains of the table.

    Logarithms are taken only where a word's own counts change a cell; the others are the same for all words.
    """
    steps = step_gains(table, choices) if steps is None else steps
    l, r = left.astype(float), right.astype(float)
    rows, b = np.arange(len(own)), np.arange(choices)
    l[rows, own] -= both
    r[rows, own] -= both
    gain = np.zeros((len(own), choices))
    for x, y, t, step in ((r, l, table, steps[0]), (l, r, table.T, steps[1])):  # the table is meant without the word
        w, c = np.nonzero(x != 0)
        if not len(w):
            continue
        v, o = x[w, c], own[w]
        few = np.minimum(v, FEW).astype(np.int64)
        more = np.take(step.reshape(-1, choices), few * len(table) + c, axis=0)
        plain = (v <= FEW) & (c != o)
        k = np.flatnonzero(plain)  # of these only the cell of the word's own class holds the word
        n = t[o[k], c[k]] - v[k]
        more[k, o[k]] = _xlogx(n + v[k]) - _xlogx(n)
        k = np.flatnonzero(~plain)
        cells = np.ascontiguousarray(t[:choices].T)
        n, before, ks, at = np.take(cells, c[k], axis=0), np.take(_xlogx(cells), c[k], axis=0), np.arange(len(k)), np.flatnonzero(c[k] == o[k])
        n[ks, o[k]] -= v[k]
        n[at] -= y[w[k[at]], :choices]
        n[at, o[k[at]]] -= both[w[k[at]]]
        before[ks, o[k]] = _xlogx(n[ks, o[k]])
        before[at] = _xlogx(n[at])
        n += v[k, None]
        more[k] = _xlogx(n) - before
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        gain[w[first]] += np.add.reduceat(more, first, axis=0)
    lb, rb, twice = l[:, :choices], r[:, :choices], both[:, None]
    w, c = np.nonzero((lb > 0) & (rb > 0) | (twice > 0))  # row and column of the class meet there; else nothing changes
    x, y, z = rb[w, c], lb[w, c], both[w]
    corner = table[c, c] - np.where(c == own[w], l[w, c] + r[w, c] + z, 0)
    gain[w, c] += _xlogx(corner + x + y + z) - _xlogx(corner + x) - _xlogx(corner + y) + _xlogx(corner)
    for x, sums, other in ((r, table.sum(axis=1), lb), (l, table.sum(axis=0), rb)):
        n, all_ = sums[:choices], x.sum(axis=1) + both
        size, at = np.unique(all_, return_inverse=True)
        less = (_xlogx(n + size[:, None]) - _xlogx(n))[at]
        w, c = np.nonzero(other > 0)
        w, c = np.append(w, rows), np.append(c, own)
        n = n[c] - other[w, c] - np.where(c == own[w], all_[w], 0)
        less[w, c] = _xlogx(n + all_[w]) - _xlogx(n)
        gain -= less
    return np.argmax(gain + 1e-9 * (b == own[:, None]), axis=1)


def best_class(left: np.ndarray, right: np.ndarray, both: float, own: int, table: np.ndarray, choices: int) -> int:
    """``best_classes`` of one word."""
    return int(best_classes(left[None], right[None], np.array([both]), np.array([own]), table, choices)[0])


def likelihood(table: np.ndarray) -> float:
    """The part of the log likelihood of all bigrams that depends on the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def _exchange(table: np.ndarray, choices: int):
    size = len(table)

    def run(batches):
        steps = step_gains(table, choices)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                own, near = part.column(1).to_numpy(), part.column(2)
                w = np.repeat(np.arange(len(own)), near.value_lengths().to_numpy())
                side, c, n = (near.flatten().field(i).to_numpy() for i in range(3))
                counts = np.zeros((3, len(own), size))  # before, after, the word itself
                np.add.at(counts, (side, w, c), n)
                best = best_classes(counts[0], counts[1], counts[2, :, 0], own, table, choices, steps)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.int64())], names=["w", "c"])

    return run


def exchange_classes(bigrams: DataFrame, words: DataFrame, classes: int = CLASSES,
                     rounds: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """((w, c) of all ``words``, class bigram table) after exchange clustering.

    Takes (w, form, moves): words that move start dealt out by hash and go, one half of them each round,
    to the class of the largest likelihood given all others; END and the form classes stay. Without
    ``rounds`` this ends, with the best classes seen, when two rounds have not raised the likelihood.
    """
    total = classes + 1 + FORMS
    fixed = words.where("NOT moves").select("w", (F.col("form") + classes + 1).alias("c"))
    state = stage(words.where("moves").select("w", F.pmod(F.xxhash64("w"), F.lit(classes)).cast("long").alias("c")), "lm-state")
    best, k = None, 0
    while True:
        known = state.unionByName(fixed)
        after = stage(bigrams.join(known.withColumnRenamed("w", "b"), "b").groupBy(F.col("a").alias("w"), "c")
                      .agg(F.sum("n").alias("n")), "lm-after")
        table = np.zeros((total, total))
        for i, j, n in (after.withColumnRenamed("c", "j").join(known, "w").groupBy("c", "j").agg(F.sum("n")).collect()):
            table[i, j] = n  # at most classes squared
        done = rounds is not None and k >= rounds
        if done or rounds is None and k % 2 == 0:
            gained = done or best is None or likelihood(table) > likelihood(best[1])
            if gained:
                best = known, table
            if done or not gained:
                return best
        half = f"pmod({{}}, 2) = {k % 2}"
        before = (bigrams.where(half.format("b")).join(known.withColumnRenamed("w", "a"), "a")
                  .groupBy(F.col("b").alias("w"), "c").agg(F.sum("n").alias("n")))
        itself = bigrams.where("a = b AND " + half.format("a")).select(F.col("a").alias("w"), F.lit(0).cast("long").alias("c"), "n")
        sides = (before.withColumn("side", F.lit(0)).unionByName(after.where(half.format("w")).withColumn("side", F.lit(1)))
                 .unionByName(itself.withColumn("side", F.lit(2))))
        near = sides.groupBy("w").agg(F.collect_list(F.struct("side", "c", "n")).alias("near"))  # at most 2 * total + 1 each
        moved = state.join(near, "w").select("w", "c", "near").mapInArrow(_exchange(table, classes), "w long, c long")
        state = stage(moved.unionByName(state.where("NOT " + half.format("w"))), "lm-state")
        k += 1


# -- the same exchange with the word -> class map in every task ------------------------------------------


def _packed(batches):
    """Longs, small numbers and counts of many rows as three binary values."""
    for b in batches:
        columns = [b.column(k).to_numpy().astype(kind) for k, kind in enumerate((np.int64, np.int8, np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in columns], names=["w", "c", "n"])


def _places(hashes: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in ``hashes`` (0 if it is not there), and whether it is there."""
    if not len(hashes):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)).view(np.int64)
    order = np.argsort(h)  # in order, the places are found without a walk through all of memory for each
    at = np.empty(len(words), np.int64)
    at[order] = np.minimum(np.searchsorted(hashes, h[order]), len(hashes) - 1)
    there = hashes[at] == h
    return np.where(there, at, 0), there


def _symbols(hashes: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Place of each word in ``hashes``; a word that is not there: their number, plus 0 for END, plus 1 + its form."""
    at, there = _places(hashes, words)
    other = np.flatnonzero(~there)
    at[other] = len(hashes) + 1 + forms([words[k] for k in other.tolist()])
    at[[k for k in other.tolist() if words[k] == END]] = len(hashes)
    return at


def _symbol_bigrams(shipped):
    def run(batches):
        hashes = shipped.value
        known, parts, held = _Numbers(), [], 0

        def out():
            cut = np.cumsum([len(x) for x in parts[:-1]]) - 1  # where a text ends and the next begins
            symbol = _symbols(hashes, list(known))
            known.clear()
            s = symbol[np.concatenate(parts)]
            parts.clear()
            keys = s[:-1] << 32
            keys |= s[1:]
            del s
            keys = np.delete(keys, cut.astype(np.int64))
            keys.sort()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(np.diff(first, append=len(keys)))], names=["ab", "n"])

        for batch in batches:
            for t in texts(batch.column(0)):
                w = [END, *t.lower().split(), END]
                parts.append(np.fromiter(map(known.__getitem__, w), np.int32, len(w)))
                held += len(w)
                if held > 4_000_000:
                    yield out()
                    held = 0
        if parts:
            yield out()

    return run


#: Neighbours that one row of the adjacency lists holds; a word with more has rows of its own.
ROW_PAIRS = 200_000


def _adjacency(batches):
    """Rows (w << 32 | nb, 3 * n + side), sorted, as lists w, side, nb, n: whole words together, a word of more than ROW_PAIRS in pieces.

    The words are written once each, with the lengths of their lists behind them. The counts take as many bytes as the largest needs."""

    def row(part, split):
        first = np.flatnonzero(np.append(True, part[0][1:] != part[0][:-1]))
        runs = np.concatenate([part[0][first], np.diff(first, append=len(part[0])).astype(np.int32)])
        part = [runs, *part[1:3], part[3].astype(np.min_scalar_type(part[3].max()))]
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in part] + [pa.array([split], pa.bool_())],
                                          names=["w", "side", "nb", "n", "split"])

    rest, alone = None, None  # alone: the word whose pieces are being written
    for b in batches:
        wnb, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        now = [(wnb >> 32).astype(np.int32), (n % 3).astype(np.int8), (wnb & 0xFFFFFFFF).astype(np.int32), n // 3]
        rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
        while len(rest[0]) > ROW_PAIRS:
            w = rest[0]
            if alone is not None and w[0] == alone or w[0] == w[ROW_PAIRS]:
                alone = w[0]
                cut = min(int(np.searchsorted(w, alone, "right")), ROW_PAIRS)
                yield row([v[:cut] for v in rest], True)
            else:
                cut = int(np.searchsorted(w, w[ROW_PAIRS], "left"))  # the last word may go on
                yield row([v[:cut] for v in rest], False)
            rest = [v[cut:] for v in rest]
    if rest is not None and len(rest[0]):
        if alone is not None and rest[0][0] == alone:
            cut = int(np.searchsorted(rest[0], alone, "right"))
            yield row([v[:cut] for v in rest], True)
            rest = [v[cut:] for v in rest]
        if len(rest[0]):
            yield row(rest, False)


def _dealt(shipped, parts: int):
    """Bigrams of the texts as blocks (part, w, nb, 3 * n + side): each for the part of either word.

    A part is a range of words of one half; the neighbours of a ``hot`` word are dealt over all parts of its half.
    Bigrams without a moving word go to the part 2 * parts."""

    def run(batches):
        hashes, hot = shipped.value
        v = len(hashes)
        odd = (hashes & 1).astype(np.int8)
        ranges = (2 * (np.arange(v) * parts // max(v, 1)) + odd).astype(np.int32)
        for bigrams in _symbol_bigrams(SimpleNamespace(value=hashes))(batches):
            ab, n = bigrams.column(0).to_numpy(), bigrams.column(1).to_numpy()
            a, b = ab >> 32, ab & 0xFFFFFFFF
            still, itself, after, before = (a >= v) & (b >= v), (a == b) & (a < v), a < v, b < v
            w = np.concatenate([a[still], a[itself], a[after], b[before]]).astype(np.int32)
            nb = np.concatenate([b[still], b[itself], b[after], a[before]]).astype(np.int32)
            m = np.concatenate([3 * n[still] + 1, 3 * n[itself] + 2, 3 * n[after] + 1, 3 * n[before]])
            m = m.astype(np.min_scalar_type(m.max()))
            del ab, a, b, n
            part = np.append(ranges, 2 * parts)[np.minimum(w, v)]
            dealt = np.flatnonzero(np.append(hot, False)[np.minimum(w, v)])
            part[dealt] = 2 * (nb[dealt] % parts) + odd[w[dealt]]
            order = np.argsort(part.astype(np.int16) if 2 * parts < 32_000 else part, kind="stable")  # radix sort of small numbers
            part, w, nb, m = part[order], w[order], nb[order], m[order]
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for lo, hi in zip(starts, np.append(starts[1:], len(part)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([int(part[lo])], pa.int32()), *(pa.array([x[lo:hi].tobytes()], pa.binary()) for x in (w, nb, m)),
                                                  pa.array([m.itemsize], pa.int32())], names=["part", "w", "nb", "m", "size"])

    return run


def _summed(batches):
    """(part, wnb, 3 * n + side), sorted and summed, of blocks that come in the order of their parts."""
    now, blocks = None, []

    def out():
        key, n = (np.concatenate([x[k] for x in blocks]) for k in range(2))
        order = np.argsort(key)
        key, n = key[order], n[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return now, key[first] // 3, np.add.reduceat(n, first) * 3 + key[first] % 3

    for b in batches:
        for part, w, nb, m, size in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if part != now and blocks:
                yield out()
                blocks.clear()
            now = part
            m = np.frombuffer(m, f"u{size}")
            wnb = (np.frombuffer(w, np.int32).astype(np.int64) << 32) | np.frombuffer(nb, np.int32)
            blocks.append((wnb * 3 + m % 3, (m // 3).astype(np.int64)))
    if blocks:
        yield out()


def _neighbour_lists(shipped, parts: int):
    """The rows of ``_adjacency`` with the half whose words they hold (2: no moving word), and of these the bigrams within the half."""

    def run(batches):
        hashes, hot = shipped.value
        v, odd = len(hashes), (hashes & 1).astype(np.int8)
        for part, wnb, m in _summed(batches):
            half = 2 if part == 2 * parts else part % 2
            alone = hot[wnb >> 32] if half < 2 else np.zeros(len(wnb), bool)
            groups = [(~alone, False)] + [(alone & (wnb >> 32 == w), True) for w in np.unique(wnb[alone] >> 32)]
            for which, split in groups:
                if not which.any():
                    continue
                for row in _adjacency([pa.RecordBatch.from_arrays([pa.array(wnb[which]), pa.array(m[which])], names=["wnb", "n"])]):
                    w, side, nb, n = _lists(row, 0)
                    k = np.flatnonzero((side == 1) & (nb < v)) if half < 2 else np.zeros(0, np.int64)
                    k = k[odd[nb[k]] == half]
                    yield pa.RecordBatch.from_arrays([*row.columns[:4], pa.array([split or row.column(4)[0].as_py()], pa.bool_()),
                                                      *(pa.array([x[k].tobytes()], pa.binary()) for x in (w, nb, n)),
                                                      pa.array([half], pa.int32())], names=["w", "side", "nb", "n", "split", "a", "b", "ab", "half"])

    return run


def _lists(b, i):
    runs, side, nb = (np.frombuffer(b.column(k)[i].as_buffer(), kind) for k, kind in enumerate((np.int32, np.int8, np.int32)))
    n = b.column(3)[i].as_buffer()
    return np.repeat(*np.split(runs, 2)), side, nb, np.frombuffer(n, f"u{n.size // len(nb)}")


def _class_bigrams(shipped, total: int, first_fixed: int):
    """Cells of the class bigram table that the lists hold; every bigram with a moving word is counted once."""

    def run(batches):
        of, table = shipped.value, np.zeros(total * total)
        for b in batches:
            for i in range(b.num_rows):
                w, side, nb, n = _lists(b, i)
                a, c = of[w].astype(np.int64), of[nb].astype(np.int64)
                after, before = side == 1, (side == 0) & (nb >= first_fixed)
                table += np.bincount(np.concatenate([a[after] * total + c[after], c[before] * total + a[before]]),
                                     weights=np.concatenate([n[after], n[before]]), minlength=total * total)
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(table[some].astype(np.int64))], names=["cell", "n"])

    return run


def _word_counts_of(of, w, side, nb, n, total: int):
    """words, (3, words, classes) counts before, after and of the word itself; ``w`` is sorted."""
    new = np.append(True, w[1:] != w[:-1])
    words, at = w[new], np.cumsum(new) - 1
    cells = (side.astype(np.int64) * len(words) + at) * total + np.where(side == 2, 0, of[nb])
    return words, np.bincount(cells, weights=n, minlength=3 * len(words) * total).reshape(3, len(words), total)


def _change(own: np.ndarray, best: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What the moves of words add to the class bigram table while their neighbours stay."""
    rows, move = np.arange(len(own)), np.zeros(left.shape)
    move[rows, best] += 1
    move[rows, own] -= 1
    return move.T @ right + left.T @ move


def _moves(shipped, table: np.ndarray, choices: int):
    """Words that change class with their new classes, and last what that adds to the table (``_change``)."""
    total = len(table)

    def run(batches):
        of, steps, change = shipped.value, step_gains(table, choices), np.zeros_like(table)
        for b in batches:
            for i in range(b.num_rows):
                w, side, nb, n = _lists(b, i)
                starts = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                for lo in range(0, len(starts), 500):
                    s = slice(starts[lo], starts[lo + 500] if lo + 500 < len(starts) else len(w))
                    words, counts = _word_counts_of(of, w[s], side[s], nb[s], n[s], total)
                    own = of[words].astype(np.int64)
                    best = best_classes(counts[0], counts[1], counts[2, :, 0], own, table, choices, steps)
                    k = np.flatnonzero(best != own)
                    if len(k):
                        change += _change(own[k], best[k], counts[0, k], counts[1, k])
                        yield pa.RecordBatch.from_arrays([pa.array([words[k].astype(np.int32).tobytes()], pa.binary()),
                                                          pa.array([best[k].astype(np.int8).tobytes()], pa.binary()), pa.array([None], pa.binary())],
                                                         names=["w", "c", "change"])
        yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([b""], pa.binary()), pa.array([change.tobytes()], pa.binary())],
                                         names=["w", "c", "change"])

    return run


def _both_moved(shipped, total: int):
    """What the table gets besides ``_change`` from bigrams of two words that both changed class."""

    def run(batches):
        old, new = shipped.value
        moved, change = old != new, np.zeros(total * total)
        for batch in batches:
            for a, b, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not a:
                    continue
                a, b = np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)
                n = np.frombuffer(n, f"u{len(n) // len(a)}")
                k = np.flatnonzero(moved[a])
                k = k[moved[b[k]]]
                a, b, n = a[k], b[k], n[k]
                for x, y, sign in ((old, old, 1), (new, new, 1), (old, new, -1), (new, old, -1)):
                    change += sign * np.bincount(x[a].astype(np.int64) * total + y[b], weights=n, minlength=total * total)
        yield pa.RecordBatch.from_arrays([pa.array([change.tobytes()], pa.binary())], names=["change"])

    return run


def _pieces(shipped, total: int):
    def run(batches):
        of = shipped.value
        for b in batches:
            for i in range(b.num_rows):
                words, counts = _word_counts_of(of, *_lists(b, i), total)
                s, _, c = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), words[0], np.int64)), pa.array(s), pa.array(c),
                                                  pa.array(counts[s, 0, c].astype(np.int64))], names=["w", "side", "c", "n"])

    return run


def _classes_of(shipped):
    def run(batches):
        hashes, of = shipped.value
        for b in batches:
            w, fixed = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = np.searchsorted(hashes, w)
            c = np.where(fixed >= 0, fixed, of[np.minimum(at, len(of) - 1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.astype(np.int64))], names=["w", "c"])

    return run


#: Tokens of the neighbour lists that one part takes; a word with more of them is dealt over all parts.
PART_TOKENS = 1_000_000


def exchange_in_map(train: DataFrame, words: DataFrame, classes: int = CLASSES,
                    rounds: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes of the moving words, their counts, their classes with those of the fixed ones behind, class bigram table).

    For at most MAP_WORDS moving words and fewer than 128 classes. Moving words are numbered by the order of their
    hashes and the others stand for their class from the start, so the bigrams are summed over far fewer pairs. They are
    written once, as the neighbours of each word, apart for each half (and for words in pieces); a round reads the lists of the half that moves.
    The class table is counted once; then each round adds what its moves change: for every word as if its neighbours
    stayed, and a correction for bigrams of two moved words. These counts are whole numbers, so the table stays exact.
    """
    spark, total = train.sparkSession, classes + 1 + FORMS
    n = F.col("n") if "n" in words.columns else F.lit(0)
    moving = words.where("moves").select("w", F.pmod(F.xxhash64("w"), F.lit(classes)).cast("long").alias("c"), n.cast("long").alias("n"))
    rows = moving.mapInArrow(_packed, "w binary, c binary, n binary").collect()  # 17 bytes a word
    hashes, start, times = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[k], kind) for r in rows)])
                            for k, kind in enumerate((np.int64, np.int8, np.int64)))
    del rows
    order = np.argsort(hashes)
    hashes, times = hashes[order], times[order]
    of = np.concatenate([start[order], np.arange(classes, total, dtype=np.int8)])
    v, parts = len(hashes), int(times.sum()) // PART_TOKENS + 1

    shipped = spark.sparkContext.broadcast((hashes, times > PART_TOKENS))
    blocks = (train.select(F.col("text").cast("string"))
              .mapInArrow(_dealt(shipped, parts), "part int, w binary, nb binary, m binary, size int"))
    path = staging_path(spark, "lm-lists")
    made = (blocks.repartition("part").sortWithinPartitions("part")
            .mapInArrow(_neighbour_lists(shipped, parts), "w binary, side binary, nb binary, n binary, split boolean, a binary, b binary, ab binary, half int"))
    made.write.mode("errorifexists").option("compression", "zstd").partitionBy("half", "split").parquet(path)
    lists = spark.read.schema(made.schema).parquet(path)
    shipped.destroy()
    columns = ["w", "side", "nb", "n"]

    table = np.zeros(total * total)
    sent = spark.sparkContext.broadcast(of)
    for r in lists.where("half = 2").select(*columns).toLocalIterator():  # bigrams without a moving word, at most classes squared
        a, b = (x - v + classes for x in (np.repeat(*np.split(np.frombuffer(r.w, np.int32), 2)), np.frombuffer(r.nb, np.int32)))
        np.add.at(table, a * total + b, np.frombuffer(r.n, f"u{len(r.n) // len(b)}"))
    for cell, n in (lists.where("half < 2").select(*columns).mapInArrow(_class_bigrams(sent, total, v), "cell long, n long")
                    .groupBy("cell").agg(F.sum("n")).collect()):
        table[cell] += n  # at most classes squared
    table = table.reshape(total, total)
    sent.destroy()
    have_split = {h for h, in lists.where("split").select("half").distinct().collect()}

    best, k = None, 0
    while True:
        done = rounds is not None and k >= rounds
        if done or rounds is None and k % 2 == 0:
            gained = done or best is None or likelihood(table) > likelihood(best[1])
            if gained:
                best = of, table
            if done or not gained:
                return hashes, times, *best
        half, old = lists.where(f"half = {k % 2}"), of
        sent, of, table = spark.sparkContext.broadcast(old), old.copy(), table.copy()
        now = table.copy()
        for r in half.where("NOT split").select(*columns).mapInArrow(_moves(sent, now, classes), "w binary, c binary, change binary").collect():
            of[np.frombuffer(r.w, np.int32)] = np.frombuffer(r.c, np.int8)  # five bytes a moved word, one table a task
            if r.change:
                table += np.frombuffer(r.change).reshape(total, total)
        if k % 2 in have_split:
            split: dict[int, np.ndarray] = {}
            for w, side, c, n in (half.where("split").select(*columns).mapInArrow(_pieces(sent, total), "w long, side long, c long, n long")
                                  .groupBy("w", "side", "c").agg(F.sum("n")).collect()):  # words of over ROW_PAIRS neighbours or PART_TOKENS tokens
                split.setdefault(w, np.zeros((3, total)))[side, c] = n
            for w, (left, right, itself) in split.items():
                of[w] = best_class(left, right, itself[0], int(old[w]), now, classes)
                if of[w] != old[w]:
                    table += _change(old[w:w + 1], of[w:w + 1], left[None], right[None])
        sent.destroy()
        sent = spark.sparkContext.broadcast((old, of))
        for r in half.select("a", "b", "ab").mapInArrow(_both_moved(sent, total), "change binary").collect():
            table += np.frombuffer(r.change).reshape(total, total)
        sent.destroy()
        k += 1


def _known_of(words: DataFrame, hashes: np.ndarray, of: np.ndarray, classes: int) -> DataFrame:
    """(w, c) of all ``words``."""
    sent = words.sparkSession.sparkContext.broadcast((hashes, of))
    known = words.select("w", F.when(F.col("moves"), F.lit(-1)).otherwise(F.col("form") + classes + 1).cast("long").alias("c"))
    return known.mapInArrow(_classes_of(sent), "w long, c long")


def exchange_by_map(train: DataFrame, words: DataFrame, classes: int = CLASSES, rounds: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """What ``exchange_classes`` returns, by ``exchange_in_map``."""
    hashes, _, of, table = exchange_in_map(train, words, classes, rounds)
    return _known_of(words, hashes, of, classes), table


def _profile_texts(log_next, shipped, end_n, end, base_log, log_emit_of, whole):
    """Per text: log10 sums over the words whose counts were sent; other words, and pairs with one, are listed for a join.

    A pair holds a class or, below 0, -1 - the place in ``rest``. ``whole``: every word from LEAST on was sent, so
    any other word of a training text stands once in the training part."""
    def run(batches):
        hashes, n_of_place, c_of_place = shipped.value
        known, names = _Numbers(), []
        base, emit, c, sent = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)
        cells, total = log_next.reshape(-1), len(log_next)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                if len(known) > 500_000:
                    known, names, base, emit, c, sent = _Numbers(), [], base[:0], emit[:0], c[:0], sent[:0]
                rows = []
                for t in texts(part.column(1)):
                    w = [END, *t.lower().split(), END]
                    rows.append(np.fromiter(map(known.__getitem__, w), np.int64, len(w)))
                new = list(itertools.islice(reversed(known), len(known) - len(names)))[::-1]
                names += new
                at, there = _places(hashes, new)
                of, n = np.full(len(new), end, np.int64), np.ones(len(new))
                of[there], n[there] = c_of_place[at[there]], n_of_place[at[there]]
                other = np.flatnonzero(~there)
                of[other] = end + 1 + forms([new[k] for k in other.tolist()])
                if new and new[0] == END:  # the first word of all
                    of[0], n[0], there[0] = end, end_n, True
                logs = np.log10(n + 1)
                base, emit = np.concatenate([base, logs - base_log]), np.concatenate([emit, logs - log_emit_of[of]])
                c, sent = np.concatenate([c, of]), np.concatenate([sent, there])

                size = np.array([len(s) for s in rows])
                s, begin = np.concatenate(rows), np.cumsum(size) - size
                of = c[s]
                trans = cells[of[:-1] * total + of[1:]]  # the last of a text leads to the next text
                trans[begin[1:] - 1] = 0
                sums = [size - 1, *(np.add.reduceat(v, begin) for v in (base[s], emit[s], np.append(trans, 0)))]
                sums[1] -= base[s[begin]]  # the end token stands at both sides of a text
                sums[2] -= emit[s[begin]]
                lists: list[list] = [[[] for _ in rows] for _ in range(4)]
                held = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                for k in np.flatnonzero(~np.logical_and.reduceat(sent[s], begin) & (held if whole else True)).tolist():
                    ids = rows[k]
                    ok = sent[ids]
                    rest, place, times = np.unique(ids[~ok], return_inverse=True, return_counts=True)
                    of = c[ids]
                    of[~ok] = -1 - place
                    x, y = of[:-1], of[1:]
                    plain = (x >= 0) & (y >= 0)
                    for column, v in zip(sums, (np.count_nonzero(ok) - 1, base[ids[:-1]][ok[:-1]].sum(), emit[ids[:-1]][ok[:-1]].sum(),
                                                log_next[x[plain], y[plain]].sum()), strict=True):
                        column[k] = v
                    for column, v in zip(lists, ([names[w] for w in rest], times, x[~plain], y[~plain]), strict=True):
                        column[k] = v
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(2), pa.array([len(s) - 1 for s in rows], pa.int64()), pa.array(sums[0], pa.int64()),
                     *(pa.array(v, pa.float64()) for v in sums[1:]),
                     pa.array(lists[0], pa.list_(pa.binary())), *(pa.array(v, pa.list_(pa.int64())) for v in lists[1:])],
                    names=["doc_id", "held_out", "n_tokens", "head_known", "base", "emit", "trans", "rest", "times", "first", "second"])

    return run


def _finish_texts(log_next, log_emit_of, base_log, first_form):
    """Adds what the words outside the head give, by their classes and counts (``tail``, by place in ``rest``)."""
    def run(batches):
        for b in batches:
            known, base, score = [], [], []
            for r in b.select(["head_known", "base", "emit", "trans", "rest", "times", "first", "second", "tail"]).to_pylist():
                c = np.array([first_form + form(w) for w in r["rest"]], np.int64)
                n, times = np.zeros(len(c)), np.array(r["times"], float)
                for x in r["tail"] or ():
                    c[x["k"]], n[x["k"]] = x["c"], x["n"]
                x, y = np.array(r["first"], np.int64), np.array(r["second"], np.int64)
                if len(x):
                    x, y = (np.where(z < 0, c[np.maximum(-1 - z, 0)], z) for z in (x, y))
                logs = np.log10(n + 1)
                known.append(r["head_known"] + int(times[n > 0].sum()))
                base.append(r["base"] + float((times * (logs - base_log)).sum()))
                score.append(r["emit"] + r["trans"] + float((times * (logs - log_emit_of[c])).sum() + log_next[x, y].sum()))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in ("doc_id", "held_out", "n_tokens")), pa.array(known, pa.int64()),
                 pa.array(base, pa.float64()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, core_words: int | None = None, classes: int = CLASSES, rounds: int | None = None,
                head_words: int = HEAD, map_words: int = MAP_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity per row of ``docs``.

    Takes doc_id and text (null: empty, so one end token). Repeated rows train and are scored one by
    one. With no training row at all, every count is 0 and N and V are 0. ``core_words`` clusters so
    many of the most frequent words instead of all from LEAST on. More moving words than ``map_words`` are
    clustered by joins, with the same result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("held_out", is_held_out(F.col("doc_id")))
    train = docs.where(~F.col("held_out"))
    counts = stage(word_counts(train).withColumn("w", F.xxhash64("word")), "lm-words")
    n_all, vocab = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if core_words is None:
        words = counts.select("w", "form", "n", F.expr(f"form >= 0 AND n >= {LEAST}").alias("moves"))
    else:
        core = [(bytearray(w),) for w, _ in frequent(counts, core_words + 1) if w != END][:core_words]
        chosen = spark.createDataFrame(core, "word binary").withColumn("moves", F.lit(True))
        words = counts.join(F.broadcast(chosen), "word", "left").select("w", "form", "n", F.coalesce("moves", F.lit(False)).alias("moves"))
    whole = words.where("moves").count() <= map_words and classes + 1 + FORMS < 128
    if whole:
        hashes, times, of, table = exchange_in_map(train, words, classes, rounds)
    else:
        known, table = exchange_classes(stage(bigram_counts(train), "lm-bigrams"), words, classes, rounds)
    total = len(table)
    log_next = np.log10((table + 1) / (table.sum(axis=1, keepdims=True) + total))

    # emissions: a class's training tokens and distinct words; one more word stands for the unseen
    n_words = np.zeros(total)
    if whole and core_words is None:  # each word from LEAST on is in the map; others are sought in texts held out only
        n_words += np.bincount(of[:len(hashes)], minlength=total)
        classed = counts.where(f"form >= 0 AND n < {LEAST}").select("word", "n", (F.col("form") + classes + 1).alias("c"))
        head = hashes, times, of[:len(hashes)]
    else:
        if whole:
            known = _known_of(words, hashes, of, classes)
        classed = stage(counts.where("form >= 0").join(known, "w").select("word", "n", "c"), "lm-classes")
        hot = frequent(classed, head_words, "c")
        names = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w, _, _ in hot), np.uint64, len(hot)).view(np.int64)
        order = np.argsort(names)
        head = names[order], np.array([x[1] for x in hot], np.int64)[order], np.array([x[2] for x in hot], np.int8)[order]
    for c, n in classed.groupBy("c").count().collect():  # at most classes rows
        n_words[c] += n
    n_words[classes] = 1
    log_emit_of = np.log10(table.sum(axis=0) + n_words + 1)
    base_log = math.log10(n_all + vocab + 1)

    end = counts.where("form < 0").select("n").first()
    prof = docs.select("doc_id", "text", "held_out").mapInArrow(
        _profile_texts(log_next, spark.sparkContext.broadcast(head), end["n"] if end else 0, classes, base_log, log_emit_of, whole and core_words is None),
        "doc_id long, held_out boolean, n_tokens long, head_known long, base double, emit double, trans double, "
        "rest array<binary>, times array<long>, first array<long>, second array<long>")
    prof = stage(prof.withColumn("row", F.monotonically_increasing_id()), "lm-profile")  # written once: ids stay

    rest = prof.select("row", F.posexplode("rest").alias("k", "word"))
    tail = (rest.join(classed, "word").groupBy("row")  # words that training never saw are left to their form
            .agg(F.collect_list(F.struct("k", "c", "n")).alias("tail")))
    out = prof.join(tail, "row", "left").mapInArrow(
        _finish_texts(log_next, log_emit_of, base_log, classes + 1),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    end_known = F.lit(0 if n_all else 1)  # the end token is known as soon as anything was learned
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") - end_known).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op10(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
