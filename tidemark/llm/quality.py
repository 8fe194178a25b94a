"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations are bit operations.

``ledger`` adds to each row the measurements and one ``fail_bits`` integer (bit k: rule k failed).
A policy is a version with two masks: a document goes when a hard rule failed or more soft rules
failed than allowed. Changing a policy, comparing versions or asking what one rule does alone reads
the ledger and never the texts. Everything is JVM-side SQL; a row is measured by itself, without a
shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS

#: Rule k of the ledger: (name, condition under which it fails, over the measurements).
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("short_mean_word", "word_chars < 2 * n_words"),
    ("long_mean_word", "word_chars > 20 * n_words"),
    ("symbol_heavy", "100 * n_symbols > 30 * n_words"),
    ("some_symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "n_lines >= 3 AND 100 * n_dup_lines > 50 * n_lines"),
    ("some_duplicate_lines", "n_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    ("shouting", "100 * n_shouted > 60 * n_words"),
    ("exclamations", "100 * n_bangs > 30 * n_words"),
    ("bullet_lines", "n_lines >= 3 AND 100 * n_bullet_lines > 90 * n_lines"),
    ("ellipsis_lines", "n_lines >= 3 AND 100 * n_ellipsis_lines > 30 * n_lines"),
    ("few_distinct_words", "n_words >= 50 AND 100 * n_distinct_words < 10 * n_words"),
    ("number_heavy", "100 * n_numbers > 50 * n_words"),
]
RULE_BIT = {name: k for k, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted", "n_bangs",
            "n_bullet_lines", "n_ellipsis_lines", "n_distinct_words", "n_numbers")


@dataclass(frozen=True)
class Policy:
    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    soft_allowed: int = 0

    @staticmethod
    def mask(names: tuple[str, ...]) -> int:
        return sum(1 << RULE_BIT[n] for n in names)

    def keeps(self, bits: Column) -> Column:
        hard = bits.bitwiseAND(F.lit(self.mask(self.hard)).cast("long")) == 0
        return hard & (F.bit_count(bits.bitwiseAND(F.lit(self.mask(self.soft)).cast("long"))) <= self.soft_allowed)

    def keeps_sql(self, bits: str = "fail_bits") -> str:
        return (f"(({bits} & {self.mask(self.hard)}) = 0 "
                f"AND bit_count({bits} & {self.mask(self.soft)}) <= {self.soft_allowed})")


POLICIES = {
    "v1": Policy("v1", hard=BASE),
    "v2": Policy("v2", hard=BASE + ("short_mean_word", "long_mean_word", "symbol_heavy", "duplicate_lines", "shouting",
                                    "exclamations", "few_distinct_words", "number_heavy"),
                 soft=("some_symbols", "some_duplicate_lines", "bullet_lines", "ellipsis_lines"), soft_allowed=1),
}
CURRENT = "v2"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once wherever the optimizer puts the expression."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the MEASURES columns of its text column (null: empty, all measures 0).

    Window equality is by a 64-bit hash of the three words.
    """
    t = "_t"
    df = df.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    space = SPACE_CLASS.replace("\\", "\\\\")
    df = (df.withColumn("_ws", F.expr(rf"array_remove(split({t}, '[{space}]+'), '')"))
          .withColumn("_lines", F.expr(rf"filter(split({t}, '\n'), l -> rlike(l, '[^{space}]'))")))
    long = {
        "n_words": "size(_ws)",
        "word_chars": "length(array_join(_ws, ''))",
        "n_symbols": f"regexp_count({t}, '[#*$%&|<>]')",
        "n_dup_lines": "size(_lines) - size(array_distinct(_lines))",
        "n_repeat_words": _let(
            "ws", "_ws", _let(
                "grams", "CASE WHEN size(ws) >= 3 THEN transform(sequence(0, size(ws) - 3), "
                "i -> xxhash64(get(ws, i), get(ws, i + 1), get(ws, i + 2))) ELSE array() END", _let(
                    "pairs", "CASE WHEN size(array_distinct(grams)) < size(grams) "
                    "THEN array_sort(transform(grams, (g, i) -> struct(g AS g, i AS i))) ELSE array() END",
                    "aggregate(array_sort(transform(filter(pairs, (x, k) -> x.g <=> get(pairs, k - 1).g "
                    "OR x.g <=> get(pairs, k + 1).g), x -> x.i)), struct(0 AS total, -3 AS last), "
                    "(a, p) -> struct(a.total + least(3, p - a.last) AS total, p AS last), a -> a.total)"))),
        "n_lines": "size(_lines)",
        "n_shouted": f"regexp_count({t}, '[A-Z]{{2,}}')",
        "n_bangs": f"length({t}) - length(replace({t}, '!', ''))",
        "n_bullet_lines": "size(filter(_lines, l -> startswith(l, '- ') OR startswith(l, '* ') OR startswith(l, '• ')))",
        "n_ellipsis_lines": "size(filter(_lines, l -> endswith(l, '...') OR endswith(l, '…')))",
        "n_distinct_words": "size(array_distinct(_ws))",
        "n_numbers": rf"regexp_count({t}, '(?<![^{space}])[0-9][0-9.,:/%-]*+(?![^{space}])')",  # words that are numbers
    }
    df = df.withColumns({k: F.expr(f"CAST({v} AS BIGINT)") for k, v in long.items()})
    return df.drop("_t", "_ws", "_lines")


def fail_bits_sql() -> str:
    return " + ".join(f"(CASE WHEN {cond} THEN {1 << k} ELSE 0 END)" for k, (_, cond) in enumerate(RULES))


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with measurements and fail_bits; columns that have these names already are replaced."""
    return measure(df.drop(*MEASURES, "fail_bits"), text).withColumn("fail_bits", F.expr(f"CAST({fail_bits_sql()} AS BIGINT)"))


def apply_policies(rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """A boolean ``kept_<version>`` for each policy, from the ledger alone."""
    return rows.withColumns({f"kept_{p.version}": p.keeps(F.col("fail_bits")) for p in policies})


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """rule, failed, failed_alone, kept_without: what each rule does, from counts by fail_bits.

    failed_alone counts rows on which no other rule of the policy failed; kept_without is how many
    rows the policy keeps once the rule is struck from it. No rows for an empty ledger's rules but zeros.
    """
    used = policy.mask(policy.hard + policy.soft)
    by_bits = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << k).cast("long").alias("bit"))
                               for n, k in RULE_BIT.items() if used >> k & 1])).alias("r")
    each = by_bits.select("fail_bits", "n", rule).select("fail_bits", "n", "r.rule", "r.bit")
    hit, rest = F.col("fail_bits").bitwiseAND(F.col("bit")), F.col("fail_bits").bitwiseAND(F.bitwise_not("bit"))
    own = F.col("fail_bits").bitwiseAND(F.lit(used).cast("long"))
    return each.groupBy("rule").agg(
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(own == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(policy.keeps(rest), F.col("n")).otherwise(0)).alias("kept_without"))


def judge(docs: DataFrame, policy: Policy | None = None) -> DataFrame:
    """doc_id, the contract's measurements, base_failed, kept, fail_bits for every row of ``docs``.

    Takes doc_id and text; a null text is empty (and so fails few_words). Repeated rows are judged
    one by one, rows with a null doc_id too.
    """
    policy = policy or POLICIES[CURRENT]
    bits = F.col("fail_bits")
    failed = bits.bitwiseAND(F.lit(Policy.mask(BASE)).cast("long")) != 0
    return ledger(docs.select(F.col("doc_id").cast("long"), "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & policy.keeps(bits)).alias("kept"), "fail_bits")


def op8(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    space = r"[\x20\x09-\x0D]+"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{space}'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: NOT regexp_full_match(l, '[\x20\x09-\x0D]*')) AS ls FROM t),
g AS (SELECT doc_id, i, ws[i + 1] AS a, ws[i + 2] AS b, ws[i + 3] AS c
      FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 2)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + o.k) AS n FROM d, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines,
             len(regexp_extract_all(t, '[A-Z]{{2,}}')) AS n_shouted, length(t) - length(replace(t, '!', '')) AS n_bangs,
             len(list_filter(ls, lambda l: starts_with(l, '- ') OR starts_with(l, '* ') OR starts_with(l, '• '))) AS n_bullet_lines,
             len(list_filter(ls, lambda l: suffix(l, '...') OR suffix(l, '…'))) AS n_ellipsis_lines,
             len(list_distinct(ws)) AS n_distinct_words, len(list_filter(ws, lambda x: regexp_full_match(x, '[0-9][0-9.,:/%-]*'))) AS n_numbers
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST({fail_bits_sql()} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (fail_bits & {Policy.mask(BASE)}) <> 0 AS base_failed,
       (fail_bits & {Policy.mask(BASE)}) = 0 AND {POLICIES[CURRENT].keeps_sql()} AS kept, fail_bits FROM f"""


ORACLE = _oracle()
