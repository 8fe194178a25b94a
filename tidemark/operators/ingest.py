"""Ingest transforms: parsing, ragged unions, vertical splits, concept denormalisation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import parse_yyyymmdd, parse_yyyymmdd_strict
from tidemark.session import staged


def parse_batch(df: DataFrame, date_cols: Sequence[str] = (), bool_cols: Sequence[str] = (),
                strict: bool = False) -> DataFrame:
    """``YYYYMMDD`` / ``YYYY-MM-DD`` strings -> dates (invalid -> NULL unless strict),
    0/1 flags -> booleans."""
    parse = parse_yyyymmdd_strict if strict else parse_yyyymmdd
    out = df
    for c in date_cols:
        out = out.withColumn(c, parse(c))
    for c in bool_cols:
        out = out.withColumn(c, F.col(c).cast("int").cast("boolean"))
    return out


def union_ragged(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; a column missing from one frame is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def split_detail(df: DataFrame, keys: Sequence[str], text_col: str) -> tuple[DataFrame, DataFrame]:
    """Narrow table without the large text + detail table with the non-empty texts."""
    narrow = df.drop(text_col)
    detail = (df.select(*keys, text_col)
              .where(F.col(text_col).isNotNull() & (F.col(text_col) != F.lit(""))))
    return narrow, detail


#: Rows of the concept table that one task makes.
TASK_ROWS = 10_000_000
#: Parts of a concept that make up a task's rows: with several to a task the tasks come out even.
TASK_PARTS = 4
#: Members of a part, about: a quote meets them as one array.
PART_MEMBERS = 1024


def concept_denorm(quotes: DataFrame, members: DataFrame | None, meta: DataFrame,
                   key: str = "index_code") -> DataFrame:
    """Concept quotes x members (many-to-many on the concept code) + a name/type
    lookup that defaults to ''. Without members, member columns are NULL.

    ``meta`` has one row per concept, so the lookup join never fans out; it is
    left to the optimizer to broadcast it when its size allows.

    A concept has few quotes and may have very many members. Members are dealt over parts of about ``PART_MEMBERS``,
    each an array, the quotes of a (concept, month) are one row with an array of at most the days of the month, so
    only arrays are moved; the member x day rows come out of them after the join. Quotes without a date form arrays
    of their own. A quote is followed by all members of a part: in a written result its values are runs, which take
    hardly any room, and the members repeat at short distances.

    Both sides of the join are small beside its result, so nothing that Spark plans by size would spread
    the work: the rows of each concept are counted first, a task gets ``TASK_ROWS`` of the result, ``TASK_PARTS`` parts
    of a large concept to a task. Quotes are repeated for the parts of their own concept only. The join is a
    merge at every size: it streams quotes, and the rows that it makes of one of them, a part's members, are held at once.
    """
    if members is None:
        q = quotes.join(meta, key, "left").withColumn("ts_code", F.lit(None).cast("string")).withColumn("name", F.lit(None).cast("string"))
    else:
        sizes = staged(_counts(quotes, members, key), "concept-sizes")
        rows = F.col("__l") * F.col("__r")
        tasks = sizes.select(F.coalesce(F.sum(rows), F.lit(0))).first()[0] // TASK_ROWS + 1
        most = F.greatest(F.floor(rows * TASK_PARTS / TASK_ROWS), F.floor(F.col("__r") / PART_MEMBERS)) + 1
        sizes = sizes.select(key, F.least(most, "__r").cast("int").alias("__parts"))

        def part(n):
            return F.concat(F.col(key).cast("string"), F.lit("/"), n.cast("string")).alias("__part")

        members = (members.join(sizes, key).select(part(F.pmod(F.xxhash64("ts_code", "name"), "__parts")), F.struct("ts_code", "name").alias("__m"))
                   .repartition(tasks, "__part").groupBy("__part").agg(F.collect_list("__m").alias("__m")))
        undated = F.concat(F.lit("-"), F.pmod(F.xxhash64(*quotes.columns), F.lit(256)).cast("string"))
        months = (quotes.withColumn("__month", F.coalesce(F.date_format("trade_date", "yyyyMM"), undated)).groupBy(key, "__month")
                  .agg(F.collect_list(F.struct(*[c for c in quotes.columns if c != key])).alias("__q")))
        q = (months.join(meta, key, "left").join(sizes, key).withColumn("__n", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
             .select(key, "index_name", "index_type", "__q", part(F.col("__n"))).repartition(tasks, "__part")
             .select(key, "index_name", "index_type", "__part", F.inline("__q"))
             .join(members.hint("merge"), "__part").select(*quotes.columns, "index_name", "index_type", F.inline("__m")))
    return q.select(
        key, F.coalesce("index_name", F.lit("")).alias("index_name"),
        F.coalesce("index_type", F.lit("")).alias("index_type"),
        "trade_date", "open", "high", "low", "close", "pre_close", "pct_chg", "vol", "amount", "ts_code", "name")


def _counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows per key on both sides, of the keys that both have."""
    lc = left.groupBy(key).agg(F.count(F.lit(1)).alias("__l"))
    rc = right.groupBy(key).agg(F.count(F.lit(1)).alias("__r"))
    return lc.join(rc, key)


def join_row_count(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Row count of ``left JOIN right USING (key)`` without building the join:
    ``sum over keys of n_left(k) * n_right(k)`` from two partial aggregates."""
    return _counts(left, right, key).agg(F.coalesce(F.sum(F.col("__l") * F.col("__r")), F.lit(0)).cast("bigint").alias("rows"))
