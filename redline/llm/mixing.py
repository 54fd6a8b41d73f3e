"""Mixing sources to target weights by iterative proportional fitting.

The token weights of all documents are summed per cell (source, language, topic).  Raking scales
the cells until each margin of each dimension holds its target share: in turn, a dimension's factors
become target / margin under the other factors.  Cells are summed and weighted by Spark.  Their factors are
fitted on the driver where all cells take at most ``MAX_DRIVER_BYTES`` there, and by joins beyond,
where only convergence figures come to the driver: the steps are the same.

Targets per dimension: a dict of shares for some values, and the rest of the weight tempered over
the other values (share ** ``alpha``, renormalised).  Values without tokens get none.

Sampling: a cell's documents are kept with probability min(1, rate * raked / present tokens); the
rate is calibrated so that the expected tokens meet the budget while no probability exceeds one.
A document's draw is a hash of its id and the seed: repeatable, and independent of partitioning.

Defined cases: null values of a dimension are a value of their own; documents without tokens are
in no margin and get the probability of their cell (1 if the cell has no tokens); a null id is
drawn like any other value; a target of 0 gives its value no weight; repeated rows count each and are drawn alike; an empty table gives no
rows; all other columns, whatever their names, pass through.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.llm.common import stored

ROUNDS, TOLERANCE = 100, 1e-5
DIMS = ("d0", "d1", "d2")
#: Most bytes of cells (their values, and 64 a cell) that are collected for raking.
MAX_DRIVER_BYTES = 8 << 20


def tempered_targets(cells: DataFrame, dim: str, alpha: float, fixed: dict | None = None) -> DataFrame:
    """(value, target): ``fixed`` shares, the rest tempered over the other values with tokens."""
    fixed = fixed or {}
    own = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("n").alias("n"))
    named = F.create_map(*[F.lit(x) for kv in fixed.items() for x in (kv[0], float(kv[1]))])[F.col("value")] \
        if fixed else F.lit(None).cast("double")
    own = own.filter(F.col("n") > 0).withColumn("named", named).withColumn(
        "soft", F.when(F.col("named").isNull(), F.pow("n", F.lit(alpha))))
    sums = own.agg(F.sum("named").alias("all_named"), F.sum("soft").alias("all_soft")).first()
    got, soft = sums["all_named"] or 0.0, sums["all_soft"] or 0.0
    # Named shares fill what is left to them; all of it, where no other value exists.
    free = max(0.0, 1.0 - sum(fixed.values())) if soft else 0.0
    scale = (1.0 - free) / got if got else 0.0
    rest = (free if got else 1.0) / soft if soft else 0.0
    return own.select("value", F.coalesce(F.col("named") * scale, F.col("soft") * rest).alias("target"))


def _weighted(cells: DataFrame, factors: dict[str, DataFrame]) -> DataFrame:
    """The cells with w, their raked weight: n times the factors of their values."""
    out = cells.withColumn("w", F.col("n").cast("double"))
    for dim, f in factors.items():
        # Merge joins: the driver would build a table for each of the many small broadcasts.
        f = f.select(F.col("value").alias("_v"), F.col("f").alias("_f")).hint("merge")
        out = (out.join(f, F.col(dim).cast("string").eqNullSafe(F.col("_v")))
               .withColumn("w", F.col("w") * F.col("_f")).select(*DIMS, "n", "w"))
    return out


def _factors_by_joins(cells: DataFrame, targets: list[DataFrame], rounds: int, tolerance: float) -> tuple[dict, float]:
    """The dimensions' factors, a job or two per step, and how far the last round moved them."""
    factors = {d: t.select("value", F.lit(1.0).alias("f")) for d, t in zip(DIMS, targets, strict=True)}
    moved = 0.0
    for _ in range(rounds):
        moved = 0.0
        for dim, t in zip(DIMS, targets, strict=True):
            others = _weighted(cells, {d: f for d, f in factors.items() if d != dim})
            margin = others.groupBy(F.col(dim).cast("string").alias("m")).agg(F.sum("w").alias("s"))
            last = factors[dim].select(F.col("value").alias("lv"), F.col("f").alias("lf"))
            fitted = (t.join(margin.hint("merge"), F.col("value").eqNullSafe(F.col("m")))
                      .join(last.hint("merge"), F.col("value").eqNullSafe(F.col("lv")))
                      .select("value", F.coalesce(F.try_divide("target", "s"), F.lit(0.0)).alias("f"), "lf"))
            fitted = stored(fitted, "mix-factors")
            moved = max(moved, fitted.agg(F.max(F.abs(F.try_divide("f", "lf") - 1))).first()[0] or 0.0)
            factors[dim] = fitted.select("value", "f")
        if moved <= tolerance:
            break
    return factors, moved


def _factors_on_driver(cells: DataFrame, targets: list[DataFrame], rounds: int, tolerance: float) -> tuple[dict, float]:
    """The same over collected cells, for a number of them that ``_fits_driver`` has checked."""
    rows = cells.select(*[F.col(d).cast("string") for d in DIMS], "n").collect()
    n = np.array([r["n"] for r in rows], float)
    values = [[r["value"] for r in t.collect()] for t in targets]
    shares = [np.array([r["target"] for r in t.collect()], float) for t in targets]
    at = [{v: i for i, v in enumerate(vs)} for vs in values]
    codes = [np.array([a[r[d]] for r in rows], int) for d, a in zip(DIMS, at, strict=True)]
    f = [np.ones(len(vs)) for vs in values]
    moved = 0.0
    for _ in range(rounds):
        moved = 0.0
        for k, share in enumerate(shares):
            w = n * np.prod([f[j][codes[j]] for j in range(len(DIMS)) if j != k], axis=0)
            margin = np.bincount(codes[k], w, len(share))
            fitted = np.divide(share, margin, out=np.zeros(len(share)), where=margin > 0)
            step = np.divide(fitted, f[k], out=np.ones(len(share)), where=f[k] > 0)
            moved = max(moved, float(np.abs(step - 1).max(initial=0.0)))
            f[k] = fitted
        if moved <= tolerance:
            break
    session = cells.sparkSession
    return {d: session.createDataFrame(list(zip(vs, x.tolist(), strict=True)), "value string, f double")
            for d, vs, x in zip(DIMS, values, f, strict=True)}, moved


def _fits_driver(cells: DataFrame) -> bool:
    size = F.lit(64) + sum(F.coalesce(F.octet_length(F.col(d).cast("string")), F.lit(0)) for d in DIMS)
    return (cells.agg(F.sum(size.cast("long"))).first()[0] or 0) <= MAX_DRIVER_BYTES


def rake(cells: DataFrame, targets: list[DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(d0, d1, d2, n, w): ``cells(d0, d1, d2, n)`` with w raked to the targets, summing to 1.

    A step sets the factors of one dimension to target / margin under the other factors (0 where the
    margin is 0).  Stops when a round moves no factor by more than ``tolerance`` in proportion;
    targets that no weights meet (empty cells) never settle, which is warned of after ``rounds``
    rounds, and the last weights count."""
    cells = cells.filter(F.col("n") > 0)
    targets = [t.select(F.col("value").cast("string"), "target") for t in targets]
    fit = _factors_on_driver if _fits_driver(cells) else _factors_by_joins
    factors, moved = fit(cells, targets, rounds, tolerance)
    if moved > tolerance:
        warnings.warn(f"raking: after {rounds} rounds a factor still moves by {moved:.2g} in proportion", stacklevel=2)
    return stored(_weighted(cells, factors), "mix-cells")


def calibrated_rate(raked: DataFrame, budget: float) -> float:
    """The rate with which sum of min(n, rate * w) meets ``budget`` (in tokens; at most all).

    Each round fixes the cells that the rate takes whole and solves for the others."""
    rate = float(budget)
    for _ in range(100):
        whole = F.col("n") <= rate * F.col("w")
        full, soft = raked.agg(F.sum(F.when(whole, F.col("n")).otherwise(0)), F.sum(F.when(~whole, F.col("w")).otherwise(0.0))).first()
        if not soft:
            return rate
        nxt = max(rate, (budget - full) / soft)
        if math.isclose(nxt, rate, rel_tol=1e-12):
            return nxt
        rate = nxt
    raise RuntimeError("the rate did not settle")


def draw(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 11) / F.lit(float(2 ** 53))


def mix(df: DataFrame, weight: Column, dims: tuple[Column, Column, Column], fixed: tuple = (None, None, None),
        alpha: tuple = (0.7, 1.0, 0.5), keep_share: float = 0.7, id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """(row: the input row as a struct, d0, d1, d2, weight, probability, selected).

    ``keep_share`` of all tokens is the budget; ``fixed`` and ``alpha`` give the targets of the
    three dimensions (source, language, topic)."""
    rows = df.select(F.struct("*").alias("row"), *[d.alias(n) for d, n in zip(dims, DIMS, strict=True)],
                     weight.cast("long").alias("weight"))
    cells = stored(rows.groupBy(*DIMS).agg(F.sum("weight").alias("n")), "mix-margins")
    targets = [stored(tempered_targets(cells, d, a, f), "mix-targets") for d, a, f in zip(DIMS, alpha, fixed, strict=True)]
    raked = rake(cells, targets)
    total = cells.agg(F.sum("n")).first()[0] or 0
    rate = calibrated_rate(raked, keep_share * total)
    p = raked.select(*[F.col(d).alias(f"p{d}") for d in DIMS],
                     F.least(F.lit(1.0), F.lit(rate) * F.col("w") / F.col("n")).alias("p"))
    on = F.lit(True)
    for d in DIMS:
        on = on & F.col(d).eqNullSafe(F.col(f"p{d}"))
    probability = F.coalesce("p", F.lit(1.0))
    return rows.join(p, on, "left").select(
        "row", *DIMS, "weight", probability.alias("probability"),
        (draw(F.col("row").getField(id_col), seed) < probability).alias("selected"))


def topic_by_terms(text: Column, topics: dict[str, tuple[str, ...]], other: str = "other") -> Column:
    """The first topic of which the text holds a term."""
    c = F.lit(other)
    for name, terms in reversed(list(topics.items())):
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.coalesce(F.contains(text, F.lit(t)), F.lit(False))
        c = F.when(hit, name).otherwise(c)
    return c
