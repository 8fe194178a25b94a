"""Text helpers: rating classes and vendor-code -> canonical symbol.

All of them are plain Column expressions (no Python UDFs).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the source application's for identical results).
# Rating words: a rating containing any BUY word is "buy", else any SELL word
# is "sell", else "hold"; a NULL/empty rating has class "".
RATING_BUY_WORDS = ["买入", "买", "buy"]
RATING_SELL_WORDS = ["卖出", "卖", "sell"]
# Market code -> symbol suffix, applied directly.
MARKET_SUFFIX = {
    "SH": ".SH",
    "ST": ".SH",
    "SZ": ".SZ",
    "BJ": ".BJ",
    "SHETF": ".SH",
    "SZETF": ".SZ",
    "177": ".HK",
    "185": ".US",
    "169": ".US",
    "217": ".US",
}
# Market code -> (code prefixes, suffix), applied only when the code starts with a prefix.
MARKET_PREFIX_SUFFIX = {
    "CYB": (("300", "301"), ".SZ"),
    "KC": (("688", "787"), ".SH"),
}
# Hong Kong codes are padded to this many digits.
HK_CODE_WIDTH = 5
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rating_class(c) -> Column:
    r = F.lower(_c(c))
    buy = F.lit(False)
    for w in RATING_BUY_WORDS:
        buy = buy | r.contains(w)
    sell = F.lit(False)
    for w in RATING_SELL_WORDS:
        sell = sell | r.contains(w)
    return (F.when(_c(c).isNull() | (_c(c) == ""), F.lit(""))
            .when(buy, F.lit("buy"))
            .when(sell, F.lit("sell"))
            .otherwise(F.lit("hold")))


def _zero_fill(s: Column, width: int) -> Column:
    # pad on the left, never truncate a longer code
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def canonical_symbol(code, market) -> Column:
    """Vendor (code, market) -> canonical ``CODE.SUFFIX``; NULL when it must be skipped."""
    code_c, mkt = _c(code), F.upper(_c(market))
    suffix_map = F.create_map(*[F.lit(x) for kv in MARKET_SUFFIX.items() for x in kv])
    suffix = F.element_at(suffix_map, mkt)
    hk_digits = F.regexp_replace(code_c, "^[HK]*[hk]*", "")
    direct = (F.when(suffix == F.lit(".HK"), F.concat(_zero_fill(hk_digits, HK_CODE_WIDTH), suffix))
              .otherwise(F.concat(code_c, suffix)))
    out = F.when(mkt.isNull() | (mkt == ""), F.lit(None).cast("string"))
    out = out.when(suffix.isNotNull(), direct)
    for m, (prefixes, sfx) in MARKET_PREFIX_SUFFIX.items():
        starts = F.lit(False)
        for p in prefixes:
            starts = starts | code_c.startswith(p)
        out = out.when((mkt == m) & starts, F.concat(code_c, F.lit(sfx)))
    return out.otherwise(F.lit(None).cast("string"))


def symbol_suffix(c) -> Column:
    return F.substring_index(_c(c), ".", -1)
