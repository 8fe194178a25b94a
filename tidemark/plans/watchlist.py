"""Watchlist: vendor (code, market, tag) rows -> canonical symbols with sorted tags,
plus kept-per-market and skipped-per-market counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import canonical_symbol, symbol_suffix
from tidemark.sources.bindings import MarketData


def _mapped(md: MarketData) -> DataFrame:
    w = md.watchlist_input()
    return w.select("code", "market", "tag", canonical_symbol("code", "market").alias("ts_code"))


def watchlist_tags(md: MarketData) -> DataFrame:
    """One row per canonical symbol with its distinct tags, sorted and comma-joined.

    ``collect_set`` is combined map-side and a symbol's set is bounded by the
    number of distinct tags, so no group grows with the data."""
    m = _mapped(md).where(F.col("ts_code").isNotNull())
    return m.groupBy("ts_code").agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"),
                                    F.count_distinct("tag").alias("n_tags"))


def write_watchlist(tags: DataFrame, path: str) -> str:
    """File sink of the watchlist: one JSON object per symbol with its sorted tag list,
    written by the executors (replaces the hand-written YAML file)."""
    (tags.select("ts_code", F.split("tags", ",").alias("tags"))
     .write.mode("overwrite").json(path))
    return path


def watchlist_markets(md: MarketData) -> DataFrame:
    """('kept', suffix, symbols) and ('skipped', market, rows)."""
    m = _mapped(md)
    kept = (m.where(F.col("ts_code").isNotNull()).select("ts_code").distinct()
            .groupBy(symbol_suffix("ts_code").alias("key")).agg(F.count(F.lit(1)).alias("cnt"))
            .select(F.lit("kept").alias("kind"), "key", "cnt"))
    skipped = (m.where(F.col("ts_code").isNull()).groupBy(F.col("market").alias("key"))
               .agg(F.count(F.lit(1)).alias("cnt")).select(F.lit("skipped").alias("kind"), "key", "cnt"))
    return kept.unionByName(skipped)


QUERIES = {"watchlist_tags": watchlist_tags, "watchlist_markets": watchlist_markets}

_MAP = """
SELECT code, market, tag,
  CASE
    WHEN market IS NULL OR market = '' THEN NULL
    WHEN upper(market) IN ('SH', 'ST', 'SHETF') THEN code || '.SH'
    WHEN upper(market) IN ('SZ', 'SZETF') THEN code || '.SZ'
    WHEN upper(market) = 'BJ' THEN code || '.BJ'
    WHEN upper(market) = '177' THEN
      CASE WHEN length(regexp_replace(code, '^[HK]*[hk]*', '')) < 5
           THEN lpad(regexp_replace(code, '^[HK]*[hk]*', ''), 5, '0')
           ELSE regexp_replace(code, '^[HK]*[hk]*', '') END || '.HK'
    WHEN upper(market) IN ('185', '169', '217') THEN code || '.US'
    WHEN upper(market) = 'CYB' AND (starts_with(code, '300') OR starts_with(code, '301')) THEN code || '.SZ'
    WHEN upper(market) = 'KC' AND (starts_with(code, '688') OR starts_with(code, '787')) THEN code || '.SH'
    ELSE NULL END AS ts_code
FROM v_watch_in"""

ORACLE = {
    "watchlist_tags": f"""
SELECT ts_code, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, count(DISTINCT tag) AS n_tags
FROM ({_MAP}) WHERE ts_code IS NOT NULL GROUP BY ts_code""",
    "watchlist_markets": f"""
SELECT 'kept' AS kind, split_part(ts_code, '.', -1) AS key, count(*) AS cnt
FROM (SELECT DISTINCT ts_code FROM ({_MAP}) WHERE ts_code IS NOT NULL) GROUP BY 2
UNION ALL
SELECT 'skipped', market, count(*) FROM ({_MAP}) WHERE ts_code IS NULL GROUP BY market""",
}
