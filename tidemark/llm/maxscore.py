"""Ranked lexical search by MaxScore with pair bounds.

``build`` cuts the documents into blocks of bounded size and writes one inverted index per block.
``weigh`` turns the lists of the terms that are asked for into impact lists and precomputes, for pairs
of terms, the intersection list with its joint maximum impact. ``search`` takes the queries through
the blocks:

* a pair of terms adds at most ``max(joint maximum, maximum of a, maximum of b)`` to a document, which
  is far below the sum of the two maxima where the terms seldom meet;
* while the bounds of the weakest pairs stay below the score of the k-th document so far, their lists
  are not opened (a document with nothing else cannot get in);
* where the bound fails only by the joint maximum, the short intersection list is opened instead of
  the two lists;
* documents that are found are scored list by list, dropped as soon as the bounds of what is left
  cannot lift them, and only then looked up in the lists that were not opened.

Skipping never changes the result: a document that equals the k-th score is still looked at. Scores are
64-bit integers. A first pass over a few blocks gives every query a score to
start from.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage, texts

TOP = 20
#: Documents and terms (repeats included) of one index block; a longer text is a block of its own.
BLOCK_DOCS, BLOCK_TERMS = 1_024, 750_000
#: Blocks of a written file: its reader holds all of them, however much a task has.
FILE_BLOCKS = 8
#: Queries and query terms that go through the index together.
QUERY_BLOCK, QUERY_TERMS = 2_000, 400_000
#: Files of the lists that are searched first for a score to start from.
FIRST = 2
#: Every ASCII byte but letters and digits parts terms; A-Z are lower-cased.
PARTS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()

INDEX = "doc_ids array<long>, n array<int>, terms array<binary>, begin array<int>, place array<int>, tf array<int>"
LISTS = ("doc_ids array<long>, term array<int>, begin array<int>, place array<int>, impact array<long>, "
         "pair array<int>, pair_begin array<int>, pair_place array<int>, pair_max array<long>")


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(PARTS).split()


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def _ints(values, kind=pa.int32()) -> pa.Array:
    return pa.array(np.asarray(values), kind)


def _row(schema: str, *columns: pa.Array) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], names=names)


def _block(ids: list, words: list[np.ndarray], vocabulary: dict) -> pa.RecordBatch:
    per = [np.unique(w, return_counts=True) for w in words]
    term, tf = (np.concatenate(x) for x in zip(*per, strict=True))
    place = np.repeat(np.arange(len(per)), [len(t) for t, _ in per])
    spelled = sorted(vocabulary)
    rank = np.empty(len(spelled), np.int64)
    rank[[vocabulary[t] for t in spelled]] = np.arange(len(spelled))
    order = np.argsort(rank[term] * len(per) + place) if len(term) else term
    begin = np.concatenate(([0], np.cumsum(np.bincount(rank[term], minlength=len(spelled))))) if len(spelled) else [0]
    return _row(INDEX, pa.array(ids, pa.int64()), _ints([len(w) for w in words]), pa.array(spelled, pa.binary()),
                _ints(begin), _ints(place[order]), _ints(tf[order]))


def _index(batches):
    ids, words, vocabulary, size = [], [], _Numbers(), 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
            found = terms_of(text)
            if ids and (len(ids) >= BLOCK_DOCS or size + len(found) > BLOCK_TERMS):
                yield _block(ids, words, vocabulary)
                ids, words, vocabulary, size = [], [], _Numbers(), 0
            ids.append(doc)
            words.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
            size += len(found)
    if ids:
        yield _block(ids, words, vocabulary)


class Index(NamedTuple):
    blocks: DataFrame
    documents: int  # with at least one term
    terms: int  # with repeats


def build(docs: DataFrame) -> Index:
    """Block index of ``docs`` (doc_id, text), written to the shared folder: one row per block."""
    blocks = stage(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_index, INDEX), "search-index", FILE_BLOCKS)
    size = blocks.select(F.explode("n").alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Index(blocks, size[0], size[1])


class Query(NamedTuple):
    key: int
    pairs: list[tuple[int, int]]  # places in the asked terms; the second is -1 for a term alone
    times: list[tuple[int, int]]


def _frequencies(asked: pa.Array):
    def run(batches):
        total = np.zeros(len(asked), np.int64)
        for b in batches:
            for terms, begin in zip(b.column(0), b.column(1), strict=True):
                at = pc.index_in(asked, value_set=terms.values)
                hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                at = at.drop_null().to_numpy()
                begin = begin.values.to_numpy()
                total[hit] += begin[at + 1] - begin[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([_ints(some), _ints(total[some], pa.int64())], names=["term", "df"])

    return run


def weights(index: Index, asked: list[bytes]) -> np.ndarray:
    """Weight of each asked term: floor(1000 ln((2N + 2) / (2 df + 1)))."""
    found = (index.blocks.select("terms", "begin").mapInArrow(_frequencies(pa.array(asked, pa.binary())), "term int, df long")
             .groupBy("term").agg(F.sum("df").alias("df")).collect())  # at most a row per asked term
    df = {r.term: r.df for r in found}
    return np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(asked))], np.int64)


def _weigh(asked: pa.Array, weight: np.ndarray, pairs: np.ndarray, documents: int, terms: int):
    def lists(row) -> pa.RecordBatch:
        ids, n, spelled, begin, place, tf = (x.values for x in row)
        begin, place, tf = begin.to_numpy(), place.to_numpy(), tf.to_numpy().astype(np.int64)
        m = 75 + 25 * n.to_numpy().astype(np.int64) * documents // max(terms, 1)
        at = pc.index_in(asked, value_set=spelled)
        term = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        at = at.drop_null().to_numpy()
        size = begin[at + 1] - begin[at]
        cut = np.concatenate(([0], np.cumsum(size)))
        rows = np.repeat(begin[at] - cut[:-1], size) + np.arange(cut[-1])
        place, tf = place[rows], tf[rows]
        impact = np.repeat(weight[term], size) * (1_000_000_000 * tf // (1000 * tf + 12 * m[place]))
        where = np.full(len(asked), -1)
        where[term] = np.arange(len(term))
        met, met_begin, met_place, met_max = [], [0], [np.empty(0, np.int32)], []
        for k in np.flatnonzero((where[pairs] >= 0).all(axis=1)) if len(pairs) else ():
            (a, b), (c, d) = ((cut[i], cut[i + 1]) for i in where[pairs[k]])
            both, x, y = np.intersect1d(place[a:b], place[c:d], assume_unique=True, return_indices=True)
            if len(both):
                met.append(k)
                met_begin.append(met_begin[-1] + len(both))
                met_place.append(both)
                met_max.append((impact[a:b][x] + impact[c:d][y]).max())
        return _row(LISTS, ids, _ints(term), _ints(cut), _ints(place), _ints(impact, pa.int64()), _ints(met, pa.int32()),
                    _ints(met_begin), _ints(np.concatenate(met_place)), _ints(met_max, pa.int64()))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield lists([b.column(k)[i] for k in range(6)])

    return run


def weigh(index: Index, asked: list[bytes], pairs: list[tuple[int, int]]) -> DataFrame:
    """Impact lists of the asked terms and intersection lists of the asked pairs, one row per block, written to the shared folder."""
    fn = _weigh(pa.array(asked, pa.binary()), weights(index, asked), np.array(pairs, np.int64).reshape(-1, 2), index.documents, index.terms)
    return stage(index.blocks.mapInArrow(fn, LISTS), "search-lists", FILE_BLOCKS)


class _Top:
    """The best documents of one query so far, best first."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, floor
        self.score, self.doc, self.none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """What a document needs at least."""
        return max(self.floor, 1, int(self.score[-1]) if len(self.score) == self.k else 1)

    def add(self, score, doc, none):
        score, doc, none = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.none, none)))
        order = np.lexsort((doc, none, -score))[:self.k]
        self.score, self.doc, self.none = score[order], doc[order], none[order]


def best_of_block(lists: dict, n: int, joint: dict, query: Query, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of every document of a block that reaches ``least``, and no wrong scores.

    lists: term -> (places, impacts, maximum); joint: pair -> (places, joint maximum).
    """
    units = []  # bound, bound without the intersection, intersection, lists
    for pair, times in zip(query.pairs, query.times, strict=True):
        on = [(*lists[t], c) for t, c in zip(pair, times, strict=True) if t in lists]
        if len(on) == 2:
            # c_a a + c_b b <= min(c) (a + b) + what is over of the one that is asked for more often
            low = min(c for *_, c in on)
            over = sum((c - low) * top for _, _, top, c in on)
            apart = max(c * top for _, _, top, c in on)
            both, top = joint.get(pair, (None, 0))
            units.append((max(apart, low * top + over if both is not None else 0), apart, both, on))
        elif on:
            units.append((on[0][2] * on[0][3], on[0][2] * on[0][3], None, on))
    units.sort(key=lambda u: u[0])
    score, found, shut, bound = np.zeros(n, np.int64), np.zeros(n, bool), [], 0
    for u in units:
        if bound + u[0] < least:
            bound += u[0]
            shut.append(u)
        elif u[2] is not None and bound + u[1] < least:
            bound += u[1]
            found[u[2]] = True
            shut.append(u)
        else:
            for place, impact, _, c in u[3]:
                score[place] += c * impact
                found[place] = True
    at = np.flatnonzero(found)
    rest = sum(u[0] for u in shut)
    for u in reversed(shut):
        at = at[score[at] + rest >= least]
        rest -= u[0]
        for place, impact, _, c in u[3] if len(at) else ():
            if 16 * len(at) < len(place):
                k = np.minimum(np.searchsorted(place, at), len(place) - 1)
                score[at] += np.where(place[k] == at, c * impact[k], 0)
            else:
                score[place] += c * impact
    at = at[score[at] >= least]
    return at, score[at]


def _search(queries: list[Query], pairs: list[tuple[int, int]], k: int, floors: dict[int, int]):
    def run(batches):
        top = {q.key: _Top(k, floors.get(q.key, 0)) for q in queries}
        for b in batches:
            for i in range(b.num_rows):
                ids, term, cut, place, impact, met, met_cut, met_place, met_max = (b.column(c)[i].values for c in range(9))
                none = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                place, impact, cut, met_place = place.to_numpy(), impact.to_numpy(), cut.to_numpy(), met_place.to_numpy()
                lists = {t: (place[x:y], impact[x:y], int(impact[x:y].max()))
                         for t, x, y in zip(term.to_pylist(), cut[:-1], cut[1:], strict=True)}
                joint = {pairs[p]: (met_place[x:y], top_) for p, x, y, top_ in
                         zip(met.to_pylist(), met_cut.to_pylist()[:-1], met_cut.to_pylist()[1:], met_max.to_pylist(), strict=True)}
                for q in queries:
                    at, score = best_of_block(lists, len(ids), joint, q, top[q.key].least)
                    if len(at):
                        top[q.key].add(score, ids[at], none[at])
        for key, t in top.items():
            if len(t.score):
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(t.score), pa.int32()), pa.array(t.doc, pa.int64(), mask=t.none),
                                                  pa.array(t.score)], names=["query", "doc_id", "score"])

    return run


def _matched(counts: list[Counter], weight: dict[bytes, int], number: dict[bytes, int]) -> list[Query]:
    """Each query's terms matched two by two in the order of their weights, the heaviest first."""
    out = []
    for key, count in enumerate(counts):
        order = sorted(count, key=lambda t: (-weight[t], t))
        two = [order[i:i + 2] for i in range(0, len(order), 2)]
        out.append(Query(key, [(number[t[0]], number[t[1]] if len(t) > 1 else -1) for t in two],
                         [(count[t[0]], count[t[1]] if len(t) > 1 else 0) for t in two]))
    return out


def _query_blocks(queries: DataFrame):
    """Lists of (item_id, Counter of terms), bounded by queries and terms; queries without terms are left out."""
    block, size = [], 0
    for r in queries.select("item_id", F.col("text").cast("binary").alias("text")).distinct().toLocalIterator():
        count = Counter(terms_of(bytes(r.text or b"")))
        if not count:
            continue
        if block and (len(block) == QUERY_BLOCK or size + len(count) > QUERY_TERMS):
            yield block
            block, size = [], 0
        block.append((r.item_id, count))
        size += len(count)
    if block:
        yield block


def search(index: Index, queries: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents with a score above 0 of each of ``queries`` (item_id, text).

    Equal scores by ascending doc_id, a document without a doc_id after those that have one. Every row
    of the documents is a document of its own, repeated doc_ids too. Rows of ``queries`` that are equal
    are one query; several texts under one item_id are ranked apart. Null and empty texts on either side match nothing;
    an empty table gives no rows.
    """
    out = []
    for block in _query_blocks(queries):
        asked = sorted(set().union(*(c for _, c in block)))
        number = {t: i for i, t in enumerate(asked)}
        weight = dict(zip(asked, weights(index, asked).tolist(), strict=True))
        plan = _matched([c for _, c in block], weight, number)
        pairs = sorted({p for q in plan for p in q.pairs if p[1] >= 0})
        lists = weigh(index, asked, pairs)

        def best(rows: DataFrame, floors: dict[int, int], plan=plan, pairs=pairs):
            w = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
            return (rows.mapInArrow(_search(plan, pairs, k, floors), "query int, doc_id long, score long")
                    .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))

        first = lists.sparkSession.read.schema(LISTS).parquet(*lists.inputFiles()[:FIRST])
        start = best(first, {}).where(F.col("rank") == k).select("query", "score").collect()  # at most a row per query
        found = stage(best(lists, {r["query"]: r["score"] for r in start}), "search-found")
        names = queries.sparkSession.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], "query int, item_id long")
        out.append(found.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return queries.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out)


def op13(spark, sf_dir: str) -> DataFrame:
    index = build(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
tf AS (SELECT r, doc_id, len(ws) AS n, w, count(*) AS tf FROM (SELECT r, doc_id, ws, unnest(ws) AS w FROM d) GROUP BY r, doc_id, len(ws), w),
s AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS big_n, CAST(sum(len(ws)) AS BIGINT) AS big_l FROM d),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
q AS (SELECT item_id, w, count(*) AS c FROM (SELECT item_id, unnest({_WORDS}) AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, w),
sc AS (SELECT item_id, doc_id, r, CAST(sum(c * CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT)
                                      * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
       FROM q JOIN tf USING (w) JOIN df USING (w), s GROUP BY item_id, doc_id, r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
      FROM sc WHERE score > 0)
SELECT * FROM k WHERE rank <= 20"""
