"""Per-feature scaling.

Fit: per column, all values >= 0 -> keep (min, range) and map to
``(x - min) / range`` when the range is positive, else leave the column as
is; a column with negatives is divided by its largest absolute value.  No
clamping at apply time.  (``MinMaxScaler`` is not used: it maps a constant
column to 0.5.)

The fit is one global aggregate with ``4 * dim`` accumulators (partial
aggregation per task, one row out); the factors are a bounded model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class ScalerModel:
    non_negative: list[bool]
    minimum: list[float]
    rng: list[float]
    max_abs: list[float]

    @property
    def dim(self) -> int:
        return len(self.minimum)

    def apply(self, f: Column) -> Column:
        """Scaled ``ARRAY<DOUBLE>``: ``zip_with`` against inlined factors."""
        facts = F.array(*[
            F.struct(F.lit(self.non_negative[k]).alias("nn"),
                     F.lit(float(self.minimum[k])).alias("mn"),
                     F.lit(float(self.rng[k])).alias("rg"),
                     F.lit(float(self.max_abs[k])).alias("ab"))
            for k in range(self.dim)])
        return F.zip_with(f, facts, lambda x, s: F.when(
            s["nn"], F.when(s["rg"] > 0, (x - s["mn"]) / s["rg"]).otherwise(x))
            .otherwise(F.when(s["ab"] > 0, x / s["ab"]).otherwise(x)))


def _aggregates(f: Column, dim: int):
    out = []
    for k in range(dim):
        x = F.get(f, k)
        out += [F.min(x).alias(f"mn{k}"), F.max(x).alias(f"mx{k}"),
                F.max(F.abs(x)).alias(f"ab{k}")]
    return out


def scaler_fit(examples: DataFrame, dim: int, col: str = "f") -> ScalerModel:
    """Fit on the ``dim``-wide ``col`` arrays of ``examples``."""
    row = examples.agg(*_aggregates(F.col(col), dim)).first()
    nonneg, mins, rngs, maxabs = [], [], [], []
    for k in range(dim):
        mn, mx, ab = row[f"mn{k}"], row[f"mx{k}"], row[f"ab{k}"]
        mn = 0.0 if mn is None else float(mn)
        mx = 0.0 if mx is None else float(mx)
        nonneg.append(mn >= 0)
        mins.append(mn)
        rngs.append(mx - mn)
        maxabs.append(0.0 if ab is None else float(ab))
    return ScalerModel(nonneg, mins, rngs, maxabs)


def scaler_factors(examples: DataFrame, dim: int, col: str = "f") -> DataFrame:
    """A8 as a table: ``(idx, non_negative, min, max, range, max_abs)`` per
    feature, computed lazily from one aggregate row."""
    agg = examples.agg(*_aggregates(F.col(col), dim))
    rows = [F.struct(F.lit(k).cast("int").alias("idx"),
                     (F.col(f"mn{k}") >= 0).alias("non_negative"),
                     F.col(f"mn{k}").alias("min"), F.col(f"mx{k}").alias("max"),
                     (F.col(f"mx{k}") - F.col(f"mn{k}")).alias("range"),
                     F.col(f"ab{k}").alias("max_abs")) for k in range(dim)]
    return agg.select(F.inline(F.array(*rows)))


def scale(examples: DataFrame, model: ScalerModel, col: str = "f",
          out: str | None = None) -> DataFrame:
    """Apply fitted factors (inlined constants, no join)."""
    return examples.withColumn(out or col, model.apply(F.col(col)))
