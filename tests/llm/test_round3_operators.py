"""Token pair alignment, SimHash groups and ranked search, each against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import EDGE, docs_of, edge  # noqa: F401
from tidemark.llm import align, maxscore, simhash

HARD = [(1, None), (2, ""), (3, " "), (4, "  a  b\n c"), (5, "▁x"), (5, "x ▁ y"), (5, "x ▁ y"), (None, "café 世界\U0001f600 <|endoftext|> </s> don't"),
        (7, "\x00\x1c a \x1d b\x85 c  d 　 e"), (8, "ab " * 4000), (9, "\U0001f600" * 50), (10, "\r\n\t x"), (11, "A tail "), (12, "É́ ﬁ ½"), (13, "a \n b\t \tc \n\n d\n e \u00a0 f\u2003 g \x1f h"), (14, " a "), (15, "\n \n")]


# -- alignment ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def whole_text():
    """Both tokenizers on whole texts, as the contract states them."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = align.vocabularies()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    byte = align._byte_of()

    def run(text):
        if not text:
            return None
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled = ([bytes(byte[c] for c in a.id_to_token(i)) for i in ids[0]],
                   [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]])
        if any(b"".join(s) != (" " + text).encode() for s in spelled):
            return None
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelled]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            a_to, b_to = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append((ids[0][i:a_to], ids[1][j:b_to]))
            i, j = a_to, b_to
        return groups

    return run


def brute_alignment(rows, whole_text):
    found = [(d, whole_text(t)) for d, t in rows]
    count = Counter()
    for _, groups in found:
        count.update({(x, y) for a, b in groups or () for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = Counter()
    for d, groups in found:
        links = [(x, y) for a, b in groups or () for x in a for y in b]
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups or ())
        out[(d, sum(len(a) for a, _ in groups or ()), sum(len(b) for _, b in groups or ()), len(groups or ()), len(links),
             sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links),
             hashlib.sha256(said.encode()).hexdigest() if groups else "")] += 1
    return out


@pytest.mark.parametrize("slice_keys", [align.SLICE_KEYS, 40])
def test_alignment_matches_whole_texts(docs_of, whole_text, slice_keys):
    rng = random.Random(5)
    rows = HARD + [(i, " ".join(rng.choice(["the", "Über", "naïve", "x1", "don't", "\n", "", "世", "foo/bar"]) for _ in range(30)) or "x") for i in range(20, 40)]
    got = align.align(docs_of(rows), slice_keys=slice_keys)
    assert Counter(tuple(r) for r in got.collect()) == brute_alignment(rows, whole_text)


def test_alignment_of_empty_table(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_are_tokenized_once(docs_of):
    """the look-up works on written ids, it does not tokenize the texts a second time."""
    got = align.align(docs_of([(1, "a few words"), (2, "a few more words"), (3, None)]))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan and got.count() == 3


def test_perfect_hash_is_minimal_and_verified():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 47, 50_000))
    part = align.part_of(keys)
    built = [align.perfect_hash(keys[part == p]) for p in range(align.PARTS)]
    h = align.Hash(list(range(align.PARTS)), *map(list, zip(*built, strict=True)))
    assert sorted(h.numbers(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(np.arange(1 << 50, (1 << 50) + 20_000), keys)
    assert (h.numbers(others) == -1).all()
    assert (align.Hash([], [], [], []).numbers(keys) == -1).all()


def test_groups_of_very_many_links_give_each_pair_once(docs_of, whole_text, monkeypatch):
    monkeypatch.setattr(align, "LISTED", 2)
    rows = [*HARD, (30, "Übermäßig naïve 世界世界 foo/bar"), (31, "😀😁" * 20 + " x")]
    assert Counter(tuple(r) for r in align.align(docs_of(rows)).collect()) == brute_alignment(rows, whole_text)


# -- SimHash ------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_groups(rows, bits=2):
    """(doc_id, fingerprint) -> smallest doc_id reachable; rows of one doc_id are one document."""
    known = [(d, brute_fingerprint(t)) for d, t in rows if d is not None]
    low = {k: k[0] for k in known}
    changed = True
    while changed:
        changed = False
        for x in low:
            for y in low:
                if (x[0] == y[0] or (x[1] ^ y[1]).bit_count() <= bits) and low[y] < low[x]:
                    low[x], changed = low[y], True
    return Counter((d, f"{(f := brute_fingerprint(t)):016x}", None if d is None else low[d, f]) for d, t in rows)


def test_simhash_matches_brute_force(edge, docs_of):
    rng = random.Random(3)
    base = [f"w{rng.randrange(90)}" for _ in range(400)]
    near = []
    for i in range(100, 140):
        t = list(base)
        t[rng.randrange(400)] = "changed"
        near.append((i, " ".join(t)))
    rows = [*EDGE, *near, (200, "two words"), (201, "Two  WORDS"), (101, "a second text under one id"), (202, "a second text under one id")]
    got = simhash.near_duplicates(docs_of(rows))
    assert Counter(tuple(r) for r in got.collect()) == brute_groups(rows)


def test_simhash_of_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("codes", [(simhash.GOLAY, simhash.GOLAY), (simhash.GOLAY, simhash.GOLAY, simhash.HAMMING)])
def test_every_pair_within_the_threshold_meets_at_both_homes(codes):
    rng = np.random.default_rng(2)
    made = simhash._codes(codes, 2)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 500, dtype=np.uint64)
    y = x.copy()
    for _ in range(2):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    (rx, ax, hx), (ry, ay, hy) = (simhash.anchors(v, made, 2) for v in (x, y))
    assert (np.bincount(rx[hx], minlength=len(x)) == 1).all() and len(set(zip(rx.tolist(), ax.tolist(), strict=True))) == len(rx)
    assert set(zip(rx[hx].tolist(), ax[hx].tolist(), strict=True)) <= set(zip(ry.tolist(), ay.tolist(), strict=True))
    assert set(zip(ry[hy].tolist(), ay[hy].tolist(), strict=True)) <= set(zip(rx.tolist(), ax.tolist(), strict=True))


def test_busy_anchors_are_cut_into_blocks_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOMES", 8)
    monkeypatch.setattr(simhash, "VISITS", 32)
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre}
    for _ in range(300):  # one crowd, few bits apart
        v = centre
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            v ^= 1 << int(b)
        fps.add(v)
    fps |= {int(v) for v in rng.integers(0, 1 << 62, 200)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = [tuple(r) for r in simhash.similar_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]

    def groups(pairs):
        root = {f: f for f in signed}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in pairs:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return {f: find(f) for f in signed}

    u = np.array(signed, np.int64).view(np.uint64)
    want = [(signed[i], signed[j]) for i, j in zip(*np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 2), strict=True) if i < j]
    assert groups(links) == groups(want) and len(want) > 100


# -- ranked search --------------------------------------------------------------------------------------


def brute_search(docs, items, k=20):
    def terms(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    bags = [(d, Counter(terms(t))) for d, t in docs]
    big_n, big_l = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in sorted(set(items), key=repr):
        asked = Counter(terms(text))
        scored = []
        for d, b in bags:
            s = sum(c * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                    * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * (75 + 25 * b.total() * big_n // big_l))) for t, c in asked.items() if b[t])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, n + 1, d, -s) for n, (s, _, d) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:k])]
    return Counter(out)


def text_of(rng, words, n):
    return " ".join(words[min(int(rng.expovariate(1 / 25)), len(words) - 1)] + rng.choice(["", ",", "."]) for _ in range(n))


@pytest.mark.parametrize("block", [(4096, 3_000_000), (7, 400)])
def test_search_matches_brute_force(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(maxscore, "BLOCK_DOCS", block[0])
    monkeypatch.setattr(maxscore, "BLOCK_TERMS", block[1])
    rng = random.Random(8)
    words = [f"Term{i}" if i % 3 else f"tērm{i}" for i in range(300)]
    docs = EDGE + [(i, text_of(rng, words, rng.randrange(1, 120))) for i in range(20, 260)] + [(400 + i, "term1 same text") for i in range(30)]
    items = [(i, text_of(rng, words, rng.randrange(1, 40))) for i in range(12)] + \
        [(20, None), (21, ""), (22, "!!"), (23, "nowhere"), (24, "term1 term1 same"), (24, "term1 term1 same"), (25, "no id here"), (None, "term4 x")]
    q = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, score int")
    got = maxscore.search(maxscore.build(docs_of(docs)), q)
    assert Counter(tuple(r) for r in got.collect()) == brute_search(docs, items)


def test_query_blocks_rank_like_one(spark, docs_of, monkeypatch):
    docs = [(i, f"alpha beta{i % 7} gamma{i % 3}") for i in range(60)]
    items = spark.createDataFrame([(i, f"alpha beta{i} gamma1") for i in range(5)], "item_id long, text string")
    index = maxscore.build(docs_of(docs))
    whole = sorted(maxscore.search(index, items, 4).collect())
    monkeypatch.setattr(maxscore, "QUERY_BLOCK", 2)
    assert sorted(maxscore.search(index, items, 4).collect()) == whole and len(whole) == 20


def test_a_file_of_the_index_holds_few_blocks_however_large_its_task(spark, docs_of, monkeypatch):
    """A reader holds a file's blocks at once: a file with all blocks of a task grows with what the task reads."""
    docs = [(i, f"alpha beta{i % 7} gamma{i % 3}") for i in range(40)]
    items = spark.createDataFrame([(i, f"alpha beta{i} gamma1") for i in range(5)], "item_id long, text string")
    whole = sorted(maxscore.search(maxscore.build(docs_of(docs)), items, 4).collect())
    monkeypatch.setattr(maxscore, "BLOCK_DOCS", 2)
    monkeypatch.setattr(maxscore, "FILE_BLOCKS", 3, raising=False)
    index = maxscore.build(docs_of(docs).coalesce(1))
    blocks = [r["count"] for r in index.blocks.groupBy(F.input_file_name()).count().collect()]
    assert sum(blocks) == 20 and max(blocks) == 3
    assert sorted(maxscore.search(index, items, 4).collect()) == whole and len(whole) == 20


def test_search_of_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert maxscore.search(maxscore.build(none), items).count() == 0
    assert maxscore.search(maxscore.build(docs_of([(1, "a")])), items.where("false")).count() == 0


def test_pair_bounds_open_fewer_lists():
    """Two heavy terms that never meet: their lists stay shut where independent maxima would open them."""
    n = 1000
    even, odd, weak = np.arange(0, n, 2), np.arange(1, n, 2), np.arange(n)
    read = []

    class Impacts(np.ndarray):
        def __getitem__(self, at):
            read.append(len(at) if hasattr(at, "__len__") else 1)
            return super().__getitem__(at)

    lists = {0: (even, np.full(len(even), 60).view(Impacts), 60), 1: (odd, np.full(len(odd), 60).view(Impacts), 60),
             2: (weak, np.where(weak == 5, 100, 1), 100)}
    query = maxscore.Query(0, [(0, 1), (2, -1)], [(1, 1), (1, 0)])
    at, score = maxscore.best_of_block(lists, n, {}, query, 100)
    assert at.tolist() == [5] and score.tolist() == [160]
    assert sum(read) == 2  # one look into each list of the pair, for document 5 alone
    assert maxscore.best_of_block(lists, n, {}, query, 161)[0].tolist() == []
