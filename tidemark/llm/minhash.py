"""MinHash near-duplicates by tensored banding, with every link confirmed on the full sets.

Two small collections of ``m`` half keys are computed per text (each half key is ``half`` MinHash
values); table (i, j) uses half i of the first collection with half j of the second. So m*m tables
cost 2*m*half hash functions instead of m*m*2*half. A pair of similarity s shares a bucket with
probability (1 - (1 - s**half)**m)**2: 0.9996 at s = 0.8 and 0.99998 at 0.85 for half=3, m=12.

Links are confirmed without listing the pairs of a bucket:

1. texts with equal shingle sets become one representative;
2. each bucket takes its most shared member as leader, and every text is held against the one
   leader that it meets in most tables; confirmed links are joined to components;
3. each text that still shares a bucket with another component is held against that whole
   component (the smaller component's texts against the larger one's, in blocks of bounded size),
   and the components are joined again. Where the components of many shared buckets form a dense
   cluster, its texts are instead held against the whole cluster at once, which is the same
   comparisons and more, without a row for each pair.

After step 3 every two texts of one bucket are in one component or were compared in full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WordHash, list_of_longs, mix, stage, texts, worker_cache
from tidemark.llm.components import connected_components

HALF, TABLES = 3, 12
#: Shingles and texts that one verification block holds on either side.
BLOCK_SHINGLES, BLOCK_ROWS = 200_000, 4_096
#: Parts of the rows of one component when they meet its block counts.
SALTS = 16


def shingle_set(text: bytes, words: int, known: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle as a whole."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    width = min(words, len(w))
    n = len(w) - width + 1
    with np.errstate(over="ignore"):
        z = np.full(n, width, np.uint64)
        for k in range(width):
            z = mix(z * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(z)


def half_keys(sets: list[np.ndarray], half: int, m: int, seed: int) -> np.ndarray:
    """(len(sets), 2*m) half keys; all sets must have an element."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 1 << 62, 2 * m * half, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    xor = rng.integers(0, 1 << 63, 2 * m * half, dtype=np.uint64)
    out = np.empty((len(sets), 2 * m), np.uint64)
    done = 0
    with np.errstate(over="ignore"):
        while done < len(sets):  # runs of sets that stay in the cache
            end, size = done, 0
            while end < len(sets) and (end == done or size + len(sets[end]) <= 32_768):
                size += len(sets[end])
                end += 1
            flat = np.concatenate(sets[done:end])
            starts = np.cumsum([0] + [len(s) for s in sets[done:end - 1]])
            for key in range(2 * m):
                z = np.full(end - done, key + 1, np.uint64)
                for f in range(key * half, (key + 1) * half):
                    z = mix(z * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((flat ^ xor[f]) * mul[f], starts))
                out[done:end, key] = z
            done = end
    return out


def _profile(words: int, half: int, m: int, seed: int):
    def run(batches):
        known = worker_cache("words", 1, WordHash)
        for b in batches:
            ids = b.column(0)
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = [shingle_set(t, words, known) for t in texts(part.column(1))]
                full = [s for s in sets if len(s)]
                keys = np.zeros((len(sets), 2 * m), np.uint64)
                if full:
                    keys[[i for i, s in enumerate(sets) if len(s)]] = half_keys(full, half, m, seed)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, 512), b.column(2).slice(lo, 512), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 for s in sets], pa.int64()),
                     list_of_longs(keys[:, :m]), list_of_longs(keys[:, m:])],
                    names=["doc_id", "text_key", "n_shingles", "set_key", "ha", "hb"])

    return run


def profiles(docs: DataFrame, words: int, half: int = HALF, m: int = TABLES, seed: int = 11) -> DataFrame:
    """doc_id, text_key and set_key (hashes of the text and of its set), n_shingles, half keys of both collections."""
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key())
            .mapInArrow(_profile(words, half, m, seed),
                        "doc_id long, text_key long, n_shingles long, set_key long, ha array<long>, hb array<long>"))


def text_key():
    """64-bit hash of the text: with the doc_id it names a row, where a doc_id stands on rows of different texts."""
    return F.xxhash64(F.col("text").cast("string")).alias("text_key")


def _verify(words: int, percent: int):
    """One block of member texts v against one block of asking texts u: for each u, a link to each other
    component that has a similar text in the block."""

    def run(_, members: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        known = worker_cache("words", 1, WordHash)
        found: list[tuple[int, int]] = []
        if len(members) and len(asking):
            sets = [shingle_set(t or b"", words, known) for t in members["body"]]
            sizes = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            ids, parts = members["v"].to_numpy(), members["vc"].to_numpy()
            for u, part, body in zip(asking["u"], asking["uc"], asking["body"], strict=True):
                s = shingle_set(body or b"", words, known)
                lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                lo, n = lo[hi > lo], (hi - lo)[hi > lo]
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else lo
                both = np.bincount(owner[at], minlength=len(sets))
                hit = np.flatnonzero((100 * both >= percent * (sizes + len(s) - both)) & (parts != part))
                found += [(u, ids[hit[k]]) for k in np.unique(parts[hit], return_index=True)[1]]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def confirm(asking: DataFrame, members: DataFrame, bodies: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between texts u of asking(u, uc, cid) and texts v of members(v, vc, cid).

    uc and vc are the components that they are in already. bodies(doc, n, body) has the texts. Both sides of a cid are cut into blocks by their shingle
    counts; a block meets each block of the other side, so no task gets an unbounded group.
    """
    def blocks(col):
        return F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)), F.ceil(F.count("*") / F.lit(BLOCK_ROWS))).cast("int").alias(col)

    def salted(df, by):  # the rows of a large cid meet its block counts in many tasks
        return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))

    size = bodies.select("doc", "n")
    nu = asking.join(size.withColumnRenamed("doc", "u"), "u").groupBy("cid").agg(blocks("nu"))
    nv = members.join(size.withColumnRenamed("doc", "v"), "v").groupBy("cid").agg(blocks("nv"))
    counts = nu.join(nv, "cid").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = (salted(members, "v").join(counts, ["cid", "salt"])
            .select("cid", "v", "vc", F.pmod(F.xxhash64("v"), F.col("nv")).cast("int").alias("bv"),
                    F.explode(F.sequence(F.lit(0), F.col("nu") - 1)).alias("bu"))
            .join(bodies.select(F.col("doc").alias("v"), "body"), "v"))
    right = (salted(asking, "u").join(counts, ["cid", "salt"])
             .select("cid", "u", "uc", F.pmod(F.xxhash64("u"), F.col("nu")).cast("int").alias("bu"),
                     F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("bv"))
             .join(bodies.select(F.col("doc").alias("u"), "body"), "u"))
    left = left.select("cid", "bu", "bv", "v", "vc", "body").toDF("vcid", "vbu", "vbv", "v", "vc", "body")
    right = right.select("cid", "bu", "bv", "u", "uc", "body").toDF("ucid", "ubu", "ubv", "u", "uc", "body")
    return (left.groupBy("vcid", "vbu", "vbv").cogroup(right.groupBy("ucid", "ubu", "ubv"))
            .applyInPandas(_verify(words, percent), "a long, b long"))


def _cross(placed: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asking(u, uc, cid) and members(v, vc, cid) that hold every two components of a bucket together.

    placed(bucket, node, component, members): buckets with several components; whole(component, v):
    the texts of components of two and more.
    """
    parts = placed.select("bucket", "component", "members").distinct()
    low = parts.groupBy("bucket").agg(F.min("component").alias("b"), F.count("*").alias("parts"))
    cluster = stage(connected_components(parts.join(low, "bucket").select(F.col("component").alias("a"), "b"))
                    .select(F.col("node").alias("component"), F.col("component").alias("cluster")), "minhash-clusters")
    # rows that a join by bucket would make, against comparisons of the whole cluster
    by_bucket = (placed.groupBy("bucket").agg(F.count("*").alias("texts"), F.min("component").alias("component")).join(low, "bucket")
                 .join(cluster, "component").groupBy("cluster").agg(F.sum(F.col("texts") * (F.col("parts") - 1)).alias("rows")))
    size = (parts.select("component", "members").distinct().join(cluster, "component").groupBy("cluster")
            .agg(F.sum("members").alias("texts"), F.max(F.struct("members", "component")).alias("top")))
    dense = (size.join(by_bucket, "cluster")
             .where("CAST(texts AS DOUBLE) * (texts - top.members) <= 8 * CAST(rows AS DOUBLE)")
             .select("cluster", F.col("top.component").alias("top")))
    dense = stage(cluster.join(dense, "cluster"), "minhash-dense")

    other = placed.select("bucket", F.col("component").alias("cid"), F.col("members").alias("cid_members")).distinct()
    sparse = placed.join(dense.select("component"), "component", "left_anti")
    by_pair = (sparse.join(other, "bucket").where("struct(members, component) < struct(cid_members, cid)")
               .select(F.col("node").alias("u"), F.col("component").alias("uc"), "cid").distinct())
    by_cluster = (placed.select("node", "component").distinct().join(dense, "component").where("component <> top")
                  .select(F.col("node").alias("u"), F.col("component").alias("uc"), (-F.col("cluster") - 1).alias("cid")))
    asking = stage(by_pair.unionByName(by_cluster), "minhash-asking")

    def texts_of(targets):  # (component, cid); a component without a link is its one text
        return (targets.join(whole, "component", "left")
                .select(F.coalesce("v", "component").alias("v"), F.col("component").alias("vc"), "cid"))

    members = (texts_of(by_pair.select(F.col("cid").alias("component"), "cid").distinct())
               .unionByName(texts_of(dense.select("component", (-F.col("cluster") - 1).alias("cid")))))
    return asking, stage(members, "minhash-members")


def text_groups(docs: DataFrame, words: int = 5, percent: int = 80, half: int = HALF, m: int = TABLES) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, component (a set_key): one row per row of ``docs`` (doc_id, text).

    Sets are told apart by 63-bit hashes. Groups of near-duplicate texts, whatever doc_id they stand under; rows with equal sets have one
    set_key and component. Rows without words or without a doc_id take no part: component NULL.
    """
    prof = stage(profiles(docs, words, half, m), "minhash-profile")
    live = prof.where("n_shingles > 0 and doc_id is not null")
    # one representative per distinct set, known by the set's key
    reps = stage(live.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key", "n_shingles", "ha", "hb")).alias("r"))
                 .select(F.col("set_key").alias("doc"), "r.doc_id", "r.text_key", F.col("r.n_shingles").alias("n"), "r.ha", "r.hb"),
                 "minhash-reps")
    rows = (reps.select("doc", "hb", F.posexplode("ha").alias("i", "a"))
            .select("doc", "i", "a", F.posexplode("hb").alias("j", "b"))
            .select(F.xxhash64("i", "j", "a", "b").alias("bucket"), "doc"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    buckets = stage(rows.join(shared, "bucket"), "minhash-buckets")

    # 2: the most shared member leads its bucket; each text meets the leader of most of its buckets
    degree = buckets.groupBy("doc").agg(F.sum(F.col("size") - 1).alias("degree"))
    ranked = stage(buckets.join(degree, "doc").select("bucket", "doc", "degree"), "minhash-ranked")
    lead = (ranked.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("doc")).alias("neg"))).alias("top"))
            .select("bucket", (-F.col("top.neg")).alias("leader"), F.col("top.degree").alias("rank")))
    first = (ranked.join(lead, "bucket").where("doc <> leader")
             .groupBy(F.col("doc").alias("u"), F.col("leader").alias("cid"))
             .agg(F.count("*").alias("shared"), F.max("rank").alias("rank"))
             .groupBy("u").agg(F.max(F.struct("shared", "rank", "cid")).alias("best"))
             .select("u", F.col("best.cid").alias("cid")))
    first = stage(first, "minhash-first")
    # it grows with the documents: merged at every size, never sent whole to the tasks
    wanted = reps.select("doc", "n", "doc_id", "text_key").join(degree.select("doc"), "doc", "left_semi").hint("merge")
    bodies = stage(docs.select(F.col("doc_id").cast("long"), text_key(), F.col("text").cast("string").cast("binary").alias("body"))
                   .join(wanted, ["doc_id", "text_key"]).select("doc", "n", "body").dropDuplicates(["doc"]), "minhash-bodies")
    leaders = first.select(F.col("cid").alias("v"), F.col("cid").alias("vc"), "cid").distinct()
    links = stage(confirm(first.withColumn("uc", F.col("u")), leaders, bodies, words, percent), "minhash-links1")

    # 3: what still shares a bucket with another component is held against the whole of it
    comp = connected_components(links)
    comp = comp.join(comp.groupBy("component").agg(F.count("*").alias("members")), "component")
    placed = (ranked.select("bucket", F.col("doc").alias("node")).join(comp, "node", "left")
              .select("bucket", "node", F.coalesce("component", "node").alias("component"),
                      F.coalesce("members", F.lit(1)).alias("members")))
    present = placed.select("bucket", "component", "members").distinct()
    mixed = present.groupBy("bucket").agg(F.count("*").alias("parts")).where("parts > 1").select("bucket")
    placed = stage(placed.join(mixed, "bucket", "left_semi"), "minhash-mixed")
    whole = comp.select("component", F.col("node").alias("v"))
    asking, members = _cross(placed, whole)
    late = stage(confirm(asking, members, bodies, words, percent), "minhash-links2")
    final = connected_components(links.unionByName(late))

    of_set = final.select(F.col("node").alias("set_key"), "component")
    takes_part = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return (prof.select("doc_id", "text_key", "n_shingles", "set_key").join(of_set, "set_key", "left")
            .select("doc_id", "text_key", "n_shingles", "set_key", F.when(takes_part, F.coalesce("component", "set_key")).alias("component")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, half: int = HALF, m: int = TABLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text; others unused).

    Null or empty texts and texts without words have n_shingles 0 and are linked with nothing (but the
    other rows of their doc_id). Texts shorter than ``words`` words are one shingle. A repeated doc_id stands for one document of
    several rows: its texts are linked to each other, so all its rows get one component (kept is true
    on every row of a kept id). Rows without a doc_id link nothing: component_id null, kept true. An
    empty table gives none.
    """
    found = stage(text_groups(docs, words, percent, half, m), "minhash-groups")
    live = found.where("component IS NOT NULL").select("doc_id", "component")
    # groups of texts that one doc_id stands in are one
    again = live.groupBy("doc_id").agg(F.min("component").alias("b"), F.max("component").alias("top")).where("b < top").select("doc_id", "b")
    joined = connected_components(stage(live.join(again, "doc_id").select(F.col("component").alias("a"), "b").distinct(), "minhash-joined"))
    whole = live.groupBy("component").agg(F.min("doc_id").alias("low")).join(joined.toDF("component", "whole"), "component", "left")
    whole = whole.select("component", "low", F.coalesce("whole", "component").alias("whole"))
    low = whole.groupBy("whole").agg(F.min("low").alias("component_id"))
    lowest = whole.join(low, "whole").select("component", "component_id")
    # rows without words take the component of their doc_id's other rows
    bare = found.where("component IS NULL AND doc_id IS NOT NULL").select("doc_id").distinct()
    of_id = (live.join(bare, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("component"))
             .join(lowest, "component").select("doc_id", F.col("component_id").alias("of_id")))
    out = found.join(lowest, "component", "left").join(of_id, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "of_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, words=2, percent=80)
