"""Declared schemas of the logical market tables (``TableSpec``).

A ``TableSpec`` carries what the generic operators need: the StructType, the
key columns used by upserts, the date column used by statistics and gap scans,
and the slot a stored row lies in (an expression over key columns, so a key can
never move between slots).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

S, D, DT, B, L, TS = (T.StringType(), T.DoubleType(), T.DateType(), T.BooleanType(),
                      T.LongType(), T.TimestampType())


def _struct(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    keys: tuple[str, ...]
    date_col: str | None = None
    kind: str = "time_series"  # time_series | calendar | research | broker | survey | master | concept
    slot: str = "'all'"

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema.fields]

    @property
    def mark_key(self) -> str | None:
        """The column whose values have a high-water mark of their own."""
        key = "exchange" if self.kind == "calendar" else "ts_code"
        return key if key in self.columns and self.kind in ("time_series", "research", "survey", "calendar") else None

    @property
    def mark_kind(self) -> str:
        return "exchange" if self.kind == "calendar" else "symbol"

    def validate_keys(self, keys=None) -> tuple[str, ...]:
        keys = tuple(keys or self.keys)
        missing = [k for k in keys if k not in self.columns]
        if missing:
            raise ValueError(f"{self.name}: key column(s) {missing} not in schema")
        return keys


BY_YEAR = "year({})"
BAR_COLS = [("ts_code", S), ("trade_date", DT), ("open", D), ("high", D), ("low", D), ("close", D)]

# The column names of the technical factor table, by the rules of their families.
ADJUSTMENTS = ("bfq", "hfq", "qfq")
FACTOR_MARKET = ("pre_close", "change", "pct_chg", "vol", "amount", "turnover_rate", "turnover_rate_f", "volume_ratio", "pe",
                 "pe_ttm", "pb", "ps", "ps_ttm", "dv_ratio", "dv_ttm", "total_share", "float_share", "free_share", "total_mv",
                 "circ_mv", "adj_factor")
FACTOR_DAYS = ("downdays", "updays", "lowdays", "topdays")
FACTOR_INDICATORS = (
    "asi asit atr bbi bias1 bias2 bias3 boll_lower boll_mid boll_upper brar_ar brar_br cci cr dfma_dif dfma_difma dmi_adx dmi_adxr "
    "dmi_mdi dmi_pdi dpo madpo emv maemv expma_12 expma_50 kdj kdj_d kdj_k ktn_down ktn_mid ktn_upper macd macd_dea macd_dif mass "
    "ma_mass mfi mtm mtmma obv psy psyma roc maroc taq_down taq_mid taq_up trix trma vr wr wr1 xsii_td1 xsii_td2 xsii_td3 xsii_td4").split()
FACTOR_PERIODS = {"ema": (5, 10, 20, 30, 60, 90, 250), "ma": (5, 10, 20, 30, 60, 90, 250), "rsi": (6, 12, 24)}
FACTOR_COLS = [
    *[f"{p}{a}" for p in ("open", "high", "low", "close") for a in ("", "_hfq", "_qfq")], *FACTOR_MARKET,
    *[f"{i}_{a}" for i in FACTOR_INDICATORS for a in ADJUSTMENTS], *FACTOR_DAYS,
    *[f"{i}_{a}_{n}" for i, periods in FACTOR_PERIODS.items() for a in ADJUSTMENTS for n in periods]]

SPECS: dict[str, TableSpec] = {
    "stock_basic": TableSpec("stock_basic", _struct(
        ("ts_code", S), ("symbol", S), ("name", S), ("fullname", S), ("cnspell", S), ("area", S),
        ("industry", S), ("market", S), ("exchange", S), ("list_status", S), ("list_date", DT)),
        ("ts_code",), None, "master"),
    "daily": TableSpec("daily", _struct(*BAR_COLS, ("pre_close", D), ("change", D), ("pct_chg", D),
                                        ("vol", D), ("amount", D)),
                       ("ts_code", "trade_date"), "trade_date", slot=BY_YEAR.format("trade_date")),
    "weekly": TableSpec("weekly", _struct(*BAR_COLS, ("vol", D), ("amount", D)),
                        ("ts_code", "trade_date"), "trade_date", slot=BY_YEAR.format("trade_date")),
    "adj_factor": TableSpec("adj_factor", _struct(("ts_code", S), ("trade_date", DT), ("adj_factor", D)),
                            ("ts_code", "trade_date"), "trade_date", slot=BY_YEAR.format("trade_date")),
    "daily_basic": TableSpec("daily_basic", _struct(
        ("ts_code", S), ("trade_date", DT), ("close", D), ("turnover_rate", D), ("volume_ratio", D),
        ("pe", D), ("pe_ttm", D), ("pb", D), ("ps", D), ("ps_ttm", D), ("dv_ratio", D),
        ("total_mv", D), ("circ_mv", D)), ("ts_code", "trade_date"), "trade_date", slot=BY_YEAR.format("trade_date")),
    "trade_cal": TableSpec("trade_cal", _struct(("exchange", S), ("cal_date", DT), ("is_open", B),
                                                ("pretrade_date", DT)),
                           ("exchange", "cal_date"), "cal_date", "calendar"),
    "report_rc": TableSpec("report_rc", _struct(
        ("ts_code", S), ("report_date", DT), ("report_title", S), ("report_type", S), ("org_name", S),
        ("author_name", S), ("quarter", S), ("eps", D), ("pe", D), ("rating", S), ("max_price", D)),
        ("ts_code", "report_date", "org_name", "author_name", "quarter"), "report_date", "research",
        BY_YEAR.format("report_date")),
    "broker_recommend": TableSpec("broker_recommend", _struct(("month", S), ("broker", S), ("ts_code", S),
                                                              ("name", S)),
                                  ("month", "broker", "ts_code"), "month", "broker", "substring(month, 1, 4)"),
    "stk_surv": TableSpec("stk_surv", _struct(
        ("ts_code", S), ("name", S), ("surv_date", DT), ("fund_visitors", S), ("rece_place", S),
        ("rece_mode", S), ("rece_org", S), ("org_type", S), ("comp_rece", S)),
        ("ts_code", "surv_date", "rece_org"), "surv_date", "survey", BY_YEAR.format("surv_date")),
    "stk_surv_detail": TableSpec("stk_surv_detail", _struct(("ts_code", S), ("surv_date", DT), ("rece_org", S),
                                                            ("content", S)),
                                 ("ts_code", "surv_date", "rece_org"), "surv_date", "survey", BY_YEAR.format("surv_date")),
    "hk_us_basic": TableSpec("hk_us_basic", _struct(("ts_code", S), ("name", S), ("enname", S)),
                             ("ts_code",), None, "master"),
    "ths_index": TableSpec("ths_index", _struct(
        ("index_code", S), ("index_name", S), ("index_type", S), ("trade_date", DT), ("open", D), ("high", D),
        ("low", D), ("close", D), ("pre_close", D), ("pct_chg", D), ("vol", D), ("amount", D),
        ("ts_code", S), ("name", S)), ("index_code", "trade_date", "ts_code"), "trade_date", "concept",
        BY_YEAR.format("trade_date")),
    "stk_factor_pro": TableSpec("stk_factor_pro", _struct(("ts_code", S), ("trade_date", DT), *[(c, D) for c in FACTOR_COLS]),
                                ("ts_code", "trade_date"), "trade_date", slot=BY_YEAR.format("trade_date")),
}

TIME_SERIES_TABLES = ("daily", "weekly", "adj_factor", "daily_basic", "stk_factor_pro")
RESEARCH_TABLES = ("report_rc",)
BROKER_TABLES = ("broker_recommend",)
SURVEY_TABLES = ("stk_surv",)
MASTER_TABLES = ("stock_basic", "hk_us_basic")
BASE_TABLE_PRIORITY = ("stock_basic", "trade_cal", "hk_us_basic")


def spec(name: str) -> TableSpec:
    return SPECS[name]


def init_tables(spark, root: str, names=None, drop_existing: bool = False) -> dict[str, str]:
    """Create empty Parquet tables with the declared schemas under ``root``
    (``drop_existing`` replaces them, which is how a schema upgrade is done)."""
    paths = {}
    for name in names or SPECS:
        path = f"{root.rstrip('/')}/{name}"
        mode = "overwrite" if drop_existing else "ignore"
        spark.createDataFrame([], SPECS[name].schema).write.mode(mode).parquet(path)
        paths[name] = path
    return paths
