"""Mixing sources to target weights: token weights raked to several marginals at once, then sampled.

Tokens are summed by cell (source x language x topic). Iterative proportional fitting scales the
cells until the weighted tokens of every dimension have the target shares. The first dimension may
have any number of values: a sweep fits each of them in the task that holds its cells and returns
one sum per combination of the other dimensions, which are few (COMBINATIONS at most) and are fitted
on the driver.
A document is then sampled with probability min(1, rate * weight of its cell), the rate calibrated to
the token budget, by a hash of its id: the same rows give the same sample on any cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, stage

#: Targets: a dimension's share is its share of the tokens to this power, so that small categories gain.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Share of all tokens that the sample is to have.
BUDGET = 0.5
#: Raking ends when no marginal is off by more than this share, or after so many sweeps (marginals
#: that the cells cannot reach together never meet).
TOLERANCE, SWEEPS = 1e-6, 30
SEED = 17
#: Most combinations of the dimensions but the first.
COMBINATIONS = 10_000


def topic_of(text: Column) -> Column:
    """A document's register by plain marks: legal, contact, noisy or prose (null text: prose)."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    return (F.when(low.contains("licen") | low.contains("rights reserved") | low.contains("copyright"), F.lit("legal"))
            .when(t.contains("@"), F.lit("contact"))
            .when(F.regexp_count(t, F.lit("[#*$%&|<>]")) * 50 > F.length(t), F.lit("noisy")).otherwise(F.lit("prose")))


def token_count(text: Column) -> Column:
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), "")
    return F.size(words).cast("long")


def _draw(seed: int) -> Column:
    """Uniform in [0, 1) by the document's id and text."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 53)) / F.lit(float(1 << 53))


class Raking:
    """Cells (dimensions, tokens) raked to power targets; ``weights()`` has the cells with their weight.

    The weighted tokens sum to the tokens.
    """

    def __init__(self, cells: DataFrame, powers: dict[str, float], tolerance: float = TOLERANCE, sweeps: int = SWEEPS):
        self.wide, *self.narrow = list(powers)
        self.cells = cells
        combos = cells.groupBy(*self.narrow).agg(F.sum("tokens").alias("tokens")).limit(COMBINATIONS + 1).toPandas()
        if len(combos) > COMBINATIONS:
            raise ValueError(f"more than {COMBINATIONS} combinations of {self.narrow}: put the dimension with many values first")
        self.combos = combos.sort_values(self.narrow, ignore_index=True)
        self.total = float(self.combos["tokens"].sum())
        self.codes = {d: self.combos[d].astype("category").cat.codes.to_numpy() for d in self.narrow}
        self.goal = {d: self._shares(np.bincount(self.codes[d], self.combos["tokens"]), powers[d]) for d in self.narrow}
        self.factor = np.ones(len(self.combos))
        if self.total:
            self._fit(float(powers[self.wide]), tolerance, sweeps)

    @staticmethod
    def _shares(tokens: np.ndarray, power: float) -> np.ndarray:
        return tokens ** power / (tokens ** power).sum() if len(tokens) else tokens

    def _fit(self, power: float, tolerance: float, sweeps: int) -> None:
        spark = self.cells.sparkSession
        numbered = spark.createDataFrame(self.combos[self.narrow].assign(k=range(len(self.combos))))
        rows = (self.cells.join(F.broadcast(numbered), self.narrow).groupBy(self.wide)  # as many as combinations
                .agg(F.sum("tokens").alias("tokens"), F.collect_list(F.struct("k", F.col("tokens").cast("double").alias("t"))).alias("cells"))
                .withColumn("p", F.pow(F.col("tokens").cast("double"), F.lit(power))))
        rows = stage(rows.select(self.wide, "p", F.col("cells.k").alias("k"), F.col("cells.t").alias("t")), "mix-table")
        powered = rows.agg(F.sum("p")).first()[0]
        self.rows = rows.select(self.wide, (F.col("p") * F.lit(self.total / powered)).alias("goal"), "k", "t")
        before = self.factor
        for _ in range(sweeps):
            sums = self._sweep(before)
            table, off = np.sum([r["m"] for r in sums], axis=0), max(r["off"] for r in sums)
            if off <= tolerance:
                break
            before, factors = self.factor, {d: np.ones(len(self.goal[d])) for d in self.narrow}
            factors = self._narrow(table, factors, tolerance / 10)
            self.factor = np.prod([factors[d][self.codes[d]] for d in self.narrow], axis=0) if self.narrow else self.factor

    def _narrow(self, table, factors, tolerance):
        for _ in range(1000):
            off = 0.0
            for d in self.narrow:
                now = table * np.prod([factors[e][self.codes[e]] for e in self.narrow], axis=0)
                have = np.bincount(self.codes[d], now, minlength=len(self.goal[d]))
                step = np.where(have > 0, self.goal[d] * self.total / np.where(have > 0, have, 1), 1)
                factors[d], off = factors[d] * step, max(off, np.abs(step - 1).max())
            if off <= tolerance:
                break
        return factors

    def _sweep(self, before: np.ndarray) -> list:
        """Per task: tokens by combination once the first dimension is fitted, and how far it was off."""
        factor = self.factor
        first = before is factor

        def run(batches):
            m, off = np.zeros(len(factor)), 0.0
            for b in batches:
                r = np.repeat(np.arange(len(b)), b["k"].map(len))
                k, t = (np.concatenate([np.asarray(x) for x in b[c]]) if len(b) else np.empty(0) for c in ("k", "t"))
                k, goal = k.astype(np.int64), b["goal"].to_numpy()
                new = np.bincount(r, t * factor[k], minlength=len(b))
                old = np.bincount(r, t * before[k], minlength=len(b))
                off = max(off, 1.0 if first else float(np.abs(new / old - 1).max(initial=0)))
                m += np.bincount(k, t * (goal / new)[r], minlength=len(factor))
            yield pd.DataFrame({"m": [m], "off": [off]})

        return self.rows.mapInPandas(run, "m array<double>, off double").collect()  # a row a task

    def _by_wide(self, fn, schema: str) -> DataFrame:
        factor, wide = self.factor, self.wide

        def run(batches):
            for b in batches:
                for value, goal, k, t in zip(b[wide], b["goal"], b["k"], b["t"], strict=True):
                    k, t = np.asarray(k, np.int64), np.asarray(t)
                    yield from fn(value, k, t, factor[k] * goal / (t * factor[k]).sum())

        return self.rows.mapInPandas(run, schema)

    def weights(self) -> DataFrame:
        """(dimensions, weight) of every cell."""
        if not self.total:
            return self.cells.select(self.wide, *self.narrow, F.lit(1.0).alias("weight"))
        names = self.combos[self.narrow].astype(str).to_numpy()
        columns = [self.wide, *self.narrow, "weight"]

        def cells(value, k, t, w):
            yield pd.DataFrame([(value, *names[i], x) for i, x in zip(k, w, strict=True)], columns=columns)

        return self._by_wide(cells, ", ".join(f"`{d}` string" for d in columns[:-1]) + ", weight double")

    def rate(self, budget: float) -> float:
        """The rate r at which the expected tokens, each cell taken with min(1, r * weight), are the budget."""
        want, rate = budget * self.total, 0.0
        for _ in range(64 if self.total else 0):  # each step settles at least one more capped cell or ends
            at = rate

            def sums(value, k, t, w, at=at):
                full = w * at >= 1
                yield pd.DataFrame({"capped": [t[full].sum()], "free": [(t * w)[~full].sum()]})

            capped, free = self._by_wide(sums, "capped double, free double").agg(F.sum("capped"), F.sum("free")).first()
            if not free or (want - capped) / free <= at * (1 + 1e-12):
                break
            rate = (want - capped) / free
        return rate


def _keyed(docs: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """Dimension values as text; null is a value of its own."""
    return docs.withColumns({d: F.coalesce(c.cast("string"), F.lit("\u0000null")) for d, c in dims.items()})


def _default_dims() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text"))}


def mix(docs: DataFrame, budget: float = BUDGET, powers: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, sampled per row of ``docs``.

    Takes doc_id, text, lang and source. A null text has no tokens, a null source or language is a
    category of its own. Rows equal in id and text share their draw. An empty table gives no rows.
    """
    powers = powers or POWERS
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "lang", "source")
    rows = _keyed(rows, _default_dims()).select("doc_id", *powers, token_count(F.col("text")).alias("tokens"), _draw(seed).alias("_u"))
    rows = stage(rows, "mix-documents")
    cells = stage(rows.groupBy(*powers).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "mix-cells")
    raked = Raking(cells, powers)
    fitted, rate = stage(raked.weights(), "mix-weights"), raked.rate(budget)
    out = rows.join(fitted, list(powers), "left")
    p = F.least(F.lit(1.0), F.coalesce("weight", F.lit(1.0)) * F.lit(rate))
    shown = [F.when(F.col(d) != "\u0000null", F.col(d)).alias(d) for d in powers]
    return out.withColumn("probability", p).select(
        "doc_id", *shown, "tokens", F.coalesce("weight", F.lit(1.0)).alias("weight"), "probability",
        (F.col("_u") < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, budget: float = BUDGET, powers: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """The sampled rows of ``docs``, all columns as they are."""
    powers = powers or POWERS
    names = docs.columns
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"), F.col("lang"), F.col("source"))
    keyed = _keyed(rows, _default_dims())
    cells = stage(keyed.groupBy(*powers).agg(F.sum(token_count(F.col("text"))).alias("tokens")).where("tokens > 0"), "mix-cells")
    raked = Raking(cells, powers)
    fitted, rate = stage(raked.weights(), "mix-weights"), raked.rate(budget)
    p = F.least(F.lit(1.0), F.coalesce("weight", F.lit(1.0)) * F.lit(rate))
    return keyed.join(fitted, list(powers), "left").where(_draw(seed) < p).select(*[F.col(f"row.{n}") for n in names])


def op9(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
